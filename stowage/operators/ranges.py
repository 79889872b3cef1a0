"""What stood before, across tables dealt by ranges: no key, however many rows it has, goes through one task.

Rows are stored sorted, range by range, with a number that grows along each range. Within a range the row before is the one above; at the
border between two ranges it is the last row of the range before, of which there is one per range.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.operators.components import use_checkpoint_dir


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage, and is computed once."""
    path = f"{use_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(rows: DataFrame, order: list[str | Column]) -> DataFrame:
    """rows stored in the order, with _part, the range, and _at, which grows along the whole table."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return stored(sorted_.withColumn("_part", F.shiftright("_at", 33)), "ranges")


def with_previous(table: DataFrame, by: list[str], cols: list[str], name: str = "previous") -> DataFrame:
    """A ranged table with a struct of cols of the row before, if that has the same values in the columns by, else null."""
    own, ranges = F.struct(*by, *cols), Window.partitionBy(F.lit(0)).orderBy("_part")
    borders = table.groupBy("_part").agg(F.max_by(own, "_at").alias("_last")).select("_part", F.lag("_last").over(ranges).alias("_border"))
    rows = table.withColumn("_above", F.lag(own).over(Window.partitionBy("_part").orderBy("_at"))).join(borders, "_part")
    before = F.coalesce("_above", "_border")
    same = F.lit(True)
    for c in by:
        same = same & before[c].eqNullSafe(F.col(c))
    return rows.withColumn(name, F.when(before.isNotNull() & same, F.struct(*(before[c].alias(c) for c in cols)))).drop("_above", "_border")


def with_place(table: DataFrame, by: list[str], name: str = "place") -> DataFrame:
    """A table ranged by the columns by (no nulls there) and others, with each row's place from 0 among those equal in by."""
    heads = table.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    ranges = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*by, "_part", (F.coalesce(F.sum("_n").over(ranges), F.lit(0)) - F.col("_first")).alias("_shift"))
    return table.join(heads, [*by, "_part"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_shift")


def with_running_sum(table: DataFrame, value: str, name: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """A ranged table with the sum of value over all rows up to this one; extra: more sums of the same kind, by name."""
    sums = {name: F.col(value), **(extra or {})}
    table = table.withColumns({f"_v{i}": v for i, v in enumerate(sums.values())})
    ranges = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = table.groupBy("_part").agg(*(F.sum(f"_v{i}").alias(f"_s{i}") for i in range(len(sums))))
    heads = heads.select("_part", *(F.coalesce(F.sum(f"_s{i}").over(ranges), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    rows = table.withColumns({n: F.sum(f"_v{i}").over(inside) for i, n in enumerate(sums)}).join(heads, "_part")
    rows = rows.withColumns({n: F.col(n) + F.col(f"_b{i}") for i, n in enumerate(sums)})
    return rows.drop(*(f"_{k}{i}" for k in "vb" for i in range(len(sums))))
