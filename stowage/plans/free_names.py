"""Free names for many files that want one: the r-th number that isn't taken, found by ranks over stored ranges.

However many files want a name, they are sorted in ranges and get their place by one row per name and range; no name goes through one
task, group or window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.operators.ranges import ranged, with_place


def free_numbers(wanted: DataFrame, taken: DataFrame, by: str = "k", order: str = "op_seq") -> DataFrame:
    """The rows wanted, with free: 1, 2, ... in their order, leaving out the numbers t that taken (by, t) names for the same by.

    The r-th wanted row has as many taken numbers below its own as there are j with t_j - j < r. So where both are merged by r and
    t_j - j (at a tie the wanted row first), its place from 1 is the number. by isn't null, taken rows are distinct.
    """
    ranks = with_place(ranged(wanted, [by, order]), [by], "_r").drop("_part", "_at")
    gaps = with_place(ranged(taken.select(by, F.col("t").cast("long")), [by, "t"]), [by], "_j")
    gaps = gaps.select(by, (F.col("t") - F.col("_j") - 1).alias("_key"), F.lit(1).alias("_kind"))
    rows = ranks.withColumn("_key", F.col("_r") + 1).drop("_r").withColumn("_kind", F.lit(0))
    both = with_place(ranged(rows.unionByName(gaps, allowMissingColumns=True), [by, "_key", "_kind"]), [by], "_place")
    return both.where("_kind = 0").withColumn("free", F.col("_place") + 1).drop("_key", "_kind", "_place", "_part", "_at")


def settle_alike(arrive: DataFrame, now: DataFrame) -> DataFrame:
    """(op_seq, final, outcome) of arrivals (k, op_seq, path, size, sha1), where all of a cluster k want one path and none of its files
    leaves; now: the files (k, path, size, sha1) that stand there.

    The path goes to the file that stands there, else to the first arrival. Arrivals of its bytes (by size and a digest that isn't
    null) are merged, the others get free numbers in order of op_seq.
    """
    name = F.element_at(F.split("path", "/"), -1)
    cut = F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)
    wants = arrive.groupBy("k").agg(F.min("path").alias("path"), F.min("op_seq").alias("first_op"), F.min_by(F.struct("size", "sha1"), "op_seq").alias("first"))
    wants = wants.withColumn("tail", cut).withColumn("head", F.expr("concat(substring(path, 1, length(path) - length(tail)), '_')"))
    stands = now.select("k", "path", F.struct("size", "sha1").alias("stands"))
    wants = wants.join(stands, ["k", "path"], "left")
    rows = arrive.join(wants.select("k", "head", "tail", "first_op", F.coalesce("stands", "first").alias("holder"), F.col("stands").isNull().alias("open")), "k")
    takes = F.col("open") & (F.col("op_seq") == F.col("first_op"))
    same = F.col("sha1").isNotNull() & (F.col("size") == F.col("holder.size")) & (F.col("sha1") == F.col("holder.sha1"))
    rows = rows.withColumn("outcome", F.when(takes, "moved").when(F.coalesce(same, F.lit(False)), "merged").otherwise("renamed"))
    middle = F.expr("substring(path, length(head) + 1, length(path) - length(head) - length(tail))")
    taken = now.join(wants.select("k", "head", "tail"), "k").where(F.expr("startswith(path, head) and endswith(path, tail)")).select("k", middle.alias("t"))
    taken = taken.where(F.col("t").rlike("^[1-9][0-9]{0,17}$"))
    renamed = free_numbers(rows.where("outcome = 'renamed'").select("k", "op_seq", "head", "tail"), taken)
    renamed = renamed.select("op_seq", F.concat("head", F.col("free").cast("string"), "tail").alias("final"), F.lit("moved").alias("outcome"))
    return rows.where("outcome <> 'renamed'").select("op_seq", F.col("path").alias("final"), "outcome").union(renamed)
