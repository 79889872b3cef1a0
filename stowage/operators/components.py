"""Connected components of an edge table by repeated contraction, for graphs of any size."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def use_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir, or the one set on the context. Where there is neither, a session on one machine
    gets a folder of its own; on a cluster that is an error, as executors don't share local folders."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(shared)
        return shared
    if not spark.sparkContext.getCheckpointDir():
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stowage-"))
    return spark.sparkContext.getCheckpointDir()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component), one per node of the edge table; the component is named by its smallest node.

    Each round hooks every node to its smallest neighbour, shortens the resulting trees by pointer jumping and contracts the edges
    to tree roots, so the edge table shrinks each time. Hooking is a min() aggregate that combines before the shuffle, so a hub of
    any degree is fine. Null ends and self-loops are dropped unless the node has no other edge (then it is its own component).
    """
    spark = edges.sparkSession
    use_checkpoint_dir(spark)
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null")
    e = e.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct().checkpoint()
    labels = e.select(F.explode(F.array("lo", "hi")).alias("node")).distinct().withColumn("component", F.col("node"))
    live = e.where("lo < hi")
    while not live.isEmpty():
        parent = live.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("up")).checkpoint()  # up < node: a forest
        while True:
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            jumped = parent.join(above, "up", "left").select("node", F.coalesce("upper", "up").alias("up"), F.col("upper").isNotNull().alias("moved")).checkpoint()
            parent = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        up = parent.select(F.col("node").alias("component"), "up")
        labels = labels.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component")).checkpoint()
        lo, hi = parent.select(F.col("node").alias("lo"), F.col("up").alias("lo_up")), parent.select(F.col("node").alias("hi"), F.col("up").alias("hi_up"))
        live = live.join(hi, "hi").join(lo, "lo", "left").select(F.coalesce("lo_up", "lo").alias("x"), F.col("hi_up").alias("y"))
        live = live.where("x <> y").select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct().checkpoint()
    return labels
