"""Digests that read as little as they can: size first, then head and tail, then the whole file in pieces, by path on the executors."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.operators.ranges import stored

#: Bytes of the head, and of the tail, that are read first; bytes read at once of whole files.
EDGE, PIECE = 1 << 16, 1 << 20
#: Bytes to be read by a task; the number of tasks is named, since rows of a path and a size would be put in few.
TASK = 1 << 28


def _edge(path: str, size: int) -> tuple[str, int]:
    with open(path, "rb") as f:
        if size <= 2 * EDGE:
            data = f.read(2 * EDGE)
        else:
            data = f.read(EDGE)
            f.seek(-EDGE, os.SEEK_END)
            data += f.read(EDGE)
    return hashlib.sha1(data).hexdigest(), len(data)


def _whole(path: str, size: int) -> tuple[str, int]:
    digest, n = hashlib.sha1(), 0
    with open(path, "rb") as f:
        while piece := f.read(PIECE):
            digest.update(piece)
            n += len(piece)
    return digest.hexdigest(), n


def _read(files: DataFrame, root: str, name: str, digest: Callable[[str, int], tuple[str, int]]) -> DataFrame:
    """(rel_path, name, name_read) of files: each is read once, by the task that holds its row, and what was read is stored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for rel, size in zip(pdf["rel_path"], pdf["size"], strict=True):
                try:
                    found.append(digest(os.path.join(root, rel), int(size)))
                except OSError:
                    found.append((None, 0))
            yield pd.DataFrame({"rel_path": pdf["rel_path"], name: [f[0] for f in found], f"{name}_read": [f[1] for f in found]})

    files = stored(files.select("rel_path", "size"), f"{name}-wanted")
    most = F.least("size", F.lit(2 * EDGE)) if digest is _edge else F.col("size")
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, (files.agg(F.sum(most)).first()[0] or 0) // TASK + 1)
    dealt = files.repartition(tasks, "rel_path")
    return stored(dealt.mapInPandas(run, f"rel_path string, {name} string, {name}_read long"), name)


def _shared(rows: DataFrame, by: list[str]) -> DataFrame:
    groups = rows.groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 1").select(*by)
    return rows.join(groups, by, "left_semi")


def progressive_digests(files: DataFrame, root: str) -> DataFrame:
    """files (rel_path, size, ...; paths below root, distinct) with edge, sha1 and read, the bytes read of each now.

    Only files whose size another shares have an edge, the digest of their first and last EDGE bytes; only those whose size and edge
    another shares are read to their end, PIECE bytes at a time, and have a sha1 (files of 2 * EDGE bytes or fewer are whole already). So
    files with copies have a sha1 and all others that have one differ in it. Empty and unreadable files have none. Digests that files
    have already, in columns edge and sha1, are taken over unread. root must be where all executors see it.
    """
    for c in ("edge", "sha1"):
        if c not in files.columns:
            files = files.withColumn(c, F.lit(None).cast("string"))
    files = stored(files, "files")
    candidates = _shared(files.where("size > 0"), ["size"])
    edges = _read(candidates.where("edge is null"), root, "new_edge", _edge)
    small = F.col("size") <= 2 * EDGE
    rows = files.join(edges, "rel_path", "left").withColumn("edge", F.coalesce("edge", "new_edge"))
    rows = rows.withColumn("sha1", F.coalesce("sha1", F.when(small, F.col("edge"))))
    whole = _read(_shared(rows.where("edge is not null"), ["size", "edge"]).where("sha1 is null"), root, "new_sha1", _whole)
    rows = rows.join(whole, "rel_path", "left").withColumn("sha1", F.coalesce("sha1", "new_sha1"))
    read = F.coalesce("new_edge_read", F.lit(0)) + F.coalesce("new_sha1_read", F.lit(0))
    return rows.withColumn("read", read).drop("new_edge", "new_edge_read", "new_sha1", "new_sha1_read")
