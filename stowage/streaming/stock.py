"""Watching a whole tree: a stored inventory, what has changed since, and plans over all of it rather than over what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stowage.operators.ranges import stored
from stowage.sources import inventory as I
from stowage.sources.progressive import progressive_digests

#: Complete snapshots that are kept; older ones are removed when a new one is complete.
KEPT = 2
_COLUMNS = ["rel_path", "name", "size", "mtime_epoch", "walk_seq", "edge", "sha1"]


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def snapshots(spark: SparkSession, state: str, prefix: str = "snapshot-") -> list[int]:
    """Numbers of the complete snapshots of a state folder, in order: those whose writing ended with Spark's mark of success."""
    fs, place = _folder(spark, state)
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and fs.exists(_folder(spark, f"{state}/{n}/_SUCCESS")[1]))


def stock(spark: SparkSession, state: str) -> DataFrame | None:
    """The files of the last complete snapshot, or None before the first."""
    numbers = snapshots(spark, state)
    return spark.read.parquet(f"{state}/snapshot-{numbers[-1]}") if numbers else None


def changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(rel_path, change) of files that are new, changed (in size or time) or gone. Paths are distinct on either side."""
    then = before.select("rel_path", F.col("size").alias("_size"), F.col("mtime_epoch").alias("_mtime"))
    both = now.select("rel_path", "size", "mtime_epoch").join(then, "rel_path", "full_outer")
    same = F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime_epoch").eqNullSafe(F.col("_mtime"))
    change = F.when(F.col("_size").isNull(), "new").when(F.col("size").isNull(), "gone").when(~same, "changed")
    return both.select("rel_path", change.alias("change")).where("change is not null")


def take_stock(spark: SparkSession, root: str, state: str, planner: Callable[[DataFrame], DataFrame], out: str) -> dict[str, int]:
    """One pass over the tree; gives how many files are new, changed and gone ({} if none, and then nothing is written).

    The tree is listed by the executors and held against the last snapshot. Digests of files that are as they were are taken over; of
    the others only those are read that may have copies anywhere in the tree. The planner gets all files, so a copy of a file seen
    long ago is found, and when a kept file goes, another is kept. Its plan goes to out/batch=n, then the files to state/snapshot-n. The
    end of the latter closes the pass: after a crash the next pass takes the same number and writes both anew.
    """
    listed = stored(I.files(I.read_inventory(spark, root)).drop("kind", "head"), "listed")
    numbers = snapshots(spark, state)
    before = stock(spark, state)
    if before is None:
        before = spark.createDataFrame([], "rel_path string, name string, size long, mtime_epoch long, walk_seq long, edge string, sha1 string")
    changed = stored(changes(listed, before), "changes")
    found = {r.change: r["count"] for r in changed.groupBy("change").count().collect()}
    if not found:
        return {}
    known = before.select("rel_path", "edge", "sha1").join(changed, "rel_path", "left_anti")
    files = stored(progressive_digests(listed.join(known, "rel_path", "left"), root).select(*_COLUMNS), "stock")
    number = numbers[-1] + 1 if numbers else 0
    planner(files).write.mode("overwrite").parquet(f"{out}/batch={number}")
    files.write.mode("overwrite").parquet(f"{state}/snapshot-{number}")
    for old in numbers[: 1 - KEPT]:
        fs, place = _folder(spark, f"{state}/snapshot-{old}")
        fs.delete(place, True)
    return found


def watch_tree(stream: DataFrame, root: str, state: str, planner: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Takes stock whenever the stream of the tree (file_inventory) gives a batch, an empty one too, since what is gone shows in none."""

    def run(batch: DataFrame, _: int) -> None:
        take_stock(batch.sparkSession, root, state, planner, out)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="4 seconds")).start()
