"""A table of metrics that is kept from run to run: only what is new or changed is computed, and written back by bucket.

A folder holds versions (version=n/bucket=b, Parquet) and heads (head-n, a small Parquet table that names the version of each bucket). A
pass writes those buckets anew that something was computed for, then a head; its mark of success is the switch. A pass that was lost
before it leaves the last head in force, and the next one takes the same number. One pass at a time may write to a folder.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stowage.operators.ranges import stored
from stowage.streaming.stock import _folder, snapshots

#: Buckets of a new cache (the number stays with the cache; take more for more than some 10^8 files); heads that are kept, so that tables read before a pass can be read after it.
BUCKETS, KEPT = 64, 2
KEYS = ["rel_path", "size", "mtime_epoch"]


def people_signature(people: list[tuple[str, int]] | None, threshold: float | None = None) -> str | None:
    """What metrics that name people hang on: the names, their numbers of samples and the threshold. None if people aren't named."""
    return None if people is None else hashlib.sha256(json.dumps([sorted(people), threshold]).encode()).hexdigest()


def _head(spark: SparkSession, path: str) -> tuple[int, dict[int, int], int]:
    """(number of the last head, version of each bucket that is there, number of buckets); (-1, {}, 0) before the first."""
    numbers = snapshots(spark, path, "head-")
    if not numbers:
        return -1, {}, 0
    rows = spark.read.parquet(f"{path}/head-{numbers[-1]}").collect()
    return numbers[-1], {r.bucket: r.version for r in rows if r.bucket >= 0}, next(r.version for r in rows if r.bucket < 0)


def read_metrics(spark: SparkSession, path: str) -> DataFrame | None:
    """All cached rows (rel_path, size, mtime_epoch, sig, metrics, bucket), one per path, or None if there are none."""
    _, versions, _ = _head(spark, path)
    parts = [f"{path}/version={v}/bucket={b}" for b, v in versions.items()]
    return spark.read.option("basePath", path).parquet(*parts).drop("version") if parts else None


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("rel_path"), F.lit(buckets)).cast("int").alias("bucket")


def upsert(spark: SparkSession, path: str, fresh: DataFrame, buckets: int = BUCKETS) -> int:
    """Puts the rows fresh (rel_path, size, mtime_epoch, sig, metrics; paths distinct) in the place of those of their paths; gives how
    many buckets were written anew. The others are neither read nor written."""
    number, versions, known = _head(spark, path)
    buckets = known or buckets
    fresh = stored(fresh.withColumn("bucket", _bucket(buckets)), "fresh")
    touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]
    if not touched:
        return 0
    old = [f"{path}/version={versions[b]}/bucket={b}" for b in touched if b in versions]
    rows = fresh
    if old:
        kept = spark.read.option("basePath", path).parquet(*old).drop("version").join(fresh.select("rel_path"), "rel_path", "left_anti")
        rows = kept.unionByName(fresh, allowMissingColumns=True)
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={number + 1}")
    versions |= dict.fromkeys(touched, number + 1)
    table = spark.createDataFrame([*versions.items(), (-1, buckets)], "bucket int, version int")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/head-{number + 1}")
    _sweep(spark, path)
    return len(touched)


def _sweep(spark: SparkSession, path: str) -> None:
    """Removes heads but the last KEPT, and buckets of versions that no kept head names."""
    fs, place = _folder(spark, path)
    numbers = snapshots(spark, path, "head-")
    for n in numbers[:-KEPT]:
        fs.delete(_folder(spark, f"{path}/head-{n}")[1], True)
    named = {(r.version, r.bucket) for n in numbers[-KEPT:] for r in spark.read.parquet(f"{path}/head-{n}").collect()}
    for version in [s.getPath() for s in fs.listStatus(place) if s.getPath().getName().startswith("version=")]:
        v = int(version.getName()[8:])
        there = [s.getPath() for s in fs.listStatus(version) if s.getPath().getName().startswith("bucket=")]
        dead = [b for b in there if (v, int(b.getName()[7:])) not in named]
        for b in [version] if len(dead) == len(there) else dead:
            fs.delete(b, True)


def metrics_of(files: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], sig: str | None = None, limit: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The metrics of files (rel_path, size, mtime_epoch and whatever compute needs; paths distinct), computed only where the cache has none.

    compute: gives metrics by rel_path; files that it leaves out or marks unreadable are tried again the next time. A cached row counts if
    size and time are the file's and, if people are named (sig isn't None), the signature is the same. With a limit the first so many
    files by path are computed, and the cache is neither read nor written. Empty input gives no rows; rows without a path take no part.
    """
    spark, files = files.sparkSession, files.where("rel_path is not null")
    if limit is not None:
        first = stored(files.orderBy("rel_path").limit(limit), "first")
        return _readable(compute(first)).join(first.select(*KEYS), "rel_path")
    fits = lambda rows: rows.where(F.col("sig").eqNullSafe(F.lit(sig)) if sig is not None else F.lit(True))
    cached = read_metrics(spark, path)
    missing = files if cached is None else files.join(fits(cached).select(*KEYS), KEYS, "left_anti")
    missing = stored(missing, "missing")
    found = _readable(compute(missing)).drop("size", "mtime_epoch").join(missing.select(*KEYS), "rel_path")
    upsert(spark, path, found.withColumn("sig", F.lit(sig).cast("string")), buckets)
    cached = read_metrics(spark, path)
    if cached is None:
        return found
    return fits(cached).drop("bucket", "sig").join(files.select(*KEYS), KEYS)


def _readable(metrics: DataFrame) -> DataFrame:
    return metrics.where("not coalesce(unreadable, false)") if "unreadable" in metrics.columns else metrics


def watch_metrics(stream: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], checkpoint: str, sig: str | None = None, once: bool = True) -> StreamingQuery:
    """Keeps the metrics of a stream of files (file_inventory) up to date. Of several versions of a file in one batch the newest counts; a
    batch that is run again after a crash computes only what was lost."""

    def run(batch: DataFrame, _: int) -> None:
        newest = batch.groupBy("rel_path").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "rel_path"]), F.struct("mtime_epoch", "size")).alias("r"))
        metrics_of(newest.select("rel_path", "r.*"), path, compute, sig)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="4 seconds")).start()
