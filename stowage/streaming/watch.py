"""Streams over inventories: watch and plan, sessions, and duplicates by digest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch(stream: DataFrame, planner: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Plans each batch of new files and appends the plan to out (Parquet). The file_inventory source holds files back until they have
    settled (its option settle).

    once: plan what is there and stop (to be run by a scheduler); else keep watching.
    """

    def plan(batch: DataFrame, number: int) -> None:
        plans = planner(batch).persist()
        if number == 0 or not plans.isEmpty():
            plans.write.mode("overwrite").parquet(f"{out}/batch={number}")
        plans.unpersist()

    writer = stream.writeStream.foreachBatch(plan).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="4 seconds")).start()


def sessions(stream: DataFrame, minutes: int = 40, late: str = "1 hour", by: str = "album") -> DataFrame:
    """Gap sessions per key, each given out once the watermark has passed it."""
    gap = F.session_window("taken_at", f"{max(2, minutes)} minutes")
    out = stream.withWatermark("taken_at", late).groupBy(by, gap.alias("w")).agg(F.count("*").alias("n"), F.min("taken_at").alias("start_at"), F.max("taken_at").alias("end_at"))
    return out.select(by, "start_at", "end_at", "n")


def first_of_digest(stream: DataFrame, late: str = "1 day", time: str = "mtime") -> DataFrame:
    """The first file seen of each size and digest within the watermark (arrival order, not the batch planner's keep rule)."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["size", "sha1"])


def new_metrics(batch: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], keys: tuple = ("rel_path", "size", "mtime_epoch")) -> DataFrame:
    """Metrics of those files of a batch that the cache doesn't know."""
    return compute(batch.join(cache.select(*keys), list(keys), "left_anti"))


def live_tally(stream: DataFrame, category: str = "category") -> DataFrame:
    return stream.groupBy(category).agg(F.count("*").alias("n"))
