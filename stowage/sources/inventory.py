"""The file_inventory data source: files and folders of a tree, hidden and empty ones included, as a batch or a stream.

One partition per folder of the first level (and one for the root's own entries); executors list their own part. The tree must be one
that executors can list, such as a shared mount.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "kind string, rel_path string, name string, size bigint, mtime_epoch bigint, walk_seq bigint, head binary"
HEAD, SETTLE_S, _SHARD = 32, 3, 1 << 40


class Shard(InputPartition):
    """A folder of the first level, or the root's own files. since, until: only entries changed after the one and up to the other (ns)."""

    def __init__(self, number: int, folder: str, deep: bool, since: int | None = None, until: int | None = None):
        self.number, self.folder, self.deep, self.since, self.until = number, folder, deep, since, until

    def holds(self, path: str) -> bool:
        if self.since is None:
            return True
        try:
            stat = os.stat(path)
        except OSError:
            return False
        return self.since < max(stat.st_mtime_ns, stat.st_ctime_ns) <= self.until


def _entry(root: str, path: str, kind: str, seq: int, head: bool) -> tuple:
    try:
        stat = os.stat(path)
        size, mtime = (stat.st_size if kind == "file" else 0), int(stat.st_mtime)
    except OSError:
        size, mtime = 0, 0
    data = None
    if head and kind == "file":
        try:
            with open(path, "rb") as f:
                data = f.read(HEAD)
        except OSError:
            data = b""
    rel = os.path.relpath(path, root).replace(os.sep, "/")
    return kind, rel, os.path.basename(path), size, mtime, seq, data


def listing(root: str, shard: Shard, head: bool) -> Iterator[tuple]:
    seq = shard.number * _SHARD
    if not shard.deep:
        for name in sorted(os.listdir(shard.folder)):
            path = os.path.join(shard.folder, name)
            if not os.path.isdir(path) and shard.holds(path):
                yield _entry(root, path, "file", seq, head)
                seq += 1
        return
    for folder, below, names in os.walk(shard.folder):
        below.sort()
        if shard.holds(folder):
            yield _entry(root, folder, "dir", seq, head)
        seq += 1
        for name in sorted(names):
            if shard.holds(path := os.path.join(folder, name)):
                yield _entry(root, path, "file", seq, head)
            seq += 1


def shards(root: str, since: int | None = None, until: int | None = None) -> list[Shard]:
    folders = sorted(e.path for e in os.scandir(root) if e.is_dir(follow_symlinks=False))
    return [Shard(0, root, False, since, until), *(Shard(i + 1, f, True, since, until) for i, f in enumerate(folders))]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.head = os.path.abspath(options["path"]), options.get("head", "false") == "true"

    def partitions(self) -> list[Shard]:
        return shards(self.root)

    def read(self, partition: Shard) -> Iterator[tuple]:
        return listing(self.root, partition, self.head)


class StreamReader(DataSourceStreamReader):
    """Each batch: the entries changed since the last one, listed by the executors.

    An entry's change is the later of its modification and its inode's change, so files that keep an old time show too. Batches end
    settle seconds before now: what is younger may still be written to and comes with a later batch.
    """

    def __init__(self, options: dict):
        self.root, self.head = os.path.abspath(options["path"]), options.get("head", "false") == "true"
        self.settle = float(options.get("settle", SETTLE_S))

    def initialOffset(self) -> dict:
        return {"ns": -1}

    def latestOffset(self) -> dict:
        return {"ns": time.time_ns() - int(self.settle * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        return shards(self.root, start["ns"], end["ns"])

    def read(self, partition: Shard) -> Iterator[tuple]:
        return listing(self.root, partition, self.head)

    def commit(self, end: dict) -> None:
        pass


class FileInventory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_inventory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def read_inventory(spark: SparkSession, root: str, head: bool = False) -> DataFrame:
    spark.dataSource.register(FileInventory)
    return spark.read.format("file_inventory").option("path", root).option("head", str(head).lower()).load()


def files(inventory: DataFrame) -> DataFrame:
    return inventory.where("kind = 'file'")


def dirs(inventory: DataFrame) -> DataFrame:
    return inventory.where("kind = 'dir'").select("rel_path", "mtime_epoch", "walk_seq")
