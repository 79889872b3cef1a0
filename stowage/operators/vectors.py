"""Unit vectors of faces: best matches against a registry of any size, and clusters of a set of any size by merging centroids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions import columns as K
from stowage.functions import rules as R
from stowage.operators.ranges import stored

#: Vectors of a block; vectors or centroids of a group that one task clusters; rounds of merging at most without progress of a hundredth.
BLOCK, GROUP, IDLE = 2048, 4096, 2


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ids, m, centre, angle) of up to BLOCK vectors (id, v): their middle direction and the largest angle to it."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.slice(lo, BLOCK)
            order = np.argsort(part.column("id").to_numpy(), kind="stable")
            ids, m = part.column("id").to_numpy()[order], _matrix(part.column("v"))[order]
            centre = _unit(m.sum(0))
            angle = float(np.arccos(np.clip(_unit(m) @ centre, -1, 1)).max(initial=0)) if centre.any() else np.pi
            yield pa.RecordBatch.from_pylist([{"ids": ids.tolist(), "m": np.ascontiguousarray(m).tobytes(), "centre": centre.tolist(), "angle": angle}], schema=pa.schema([("ids", pa.list_(pa.int64())), ("m", pa.binary()), ("centre", pa.list_(pa.float64())), ("angle", pa.float64())]))


def _in_blocks(rows: DataFrame, name: str) -> DataFrame:
    """rows (id, v) as stored blocks with a number from 0; vectors with equal signs of their first components come together."""
    sign = F.transform(F.slice("v", 1, 16), lambda c: (c > 0).cast("int"))
    made = stored(rows.repartitionByRange(sign, "id").sortWithinPartitions(sign, "id").mapInArrow(_blocks, "ids array<long>, m binary, centre array<double>, angle double").withColumn("at", F.monotonically_increasing_id()), name)
    return made


def _scored(least: float) -> Callable:
    """A task over pairs of blocks (ids, m, to, k): each vector's best of the other block, if alike enough, ties to the smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, y = (np.frombuffer(row[c], np.float64).reshape(len(row[i]), -1) for c, i in (("m", "ids"), ("k", "to")))
                sims = np.round(x @ y.T, 6)
                best = sims.argmax(1)
                top = sims[np.arange(len(x)), best]
                keep = top >= least
                yield pa.RecordBatch.from_arrays([pa.array(np.array(row["ids"])[keep]), pa.array(top[keep]), pa.array(np.array(row["to"])[best[keep]])], names=["id", "sim", "match"])

    return run


def best_match(rows: DataFrame, registry: DataFrame, least: float) -> DataFrame:
    """(id, match, sim) of unit vectors (id, v): the most alike of the registry's (id, v) by cosine rounded to 6 places, if it reaches
    least; ties to the smaller id. Ids are unique.

    Both sides come in blocks; pairs of blocks are scored as products, except those whose middles are so far apart that nothing in them
    can reach least. Neither side is sent whole: a block meets the registry's blocks one by one, and bests are combined by a maximum.
    """
    asked, known = _in_blocks(rows, "asked"), _in_blocks(registry, "known")
    heads = known.select(F.col("at").alias("k_at"), F.col("centre").alias("k_centre"), F.col("angle").alias("k_angle"))
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), K.cosine(F.col("centre"), F.col("k_centre"))))) - F.col("angle") - F.col("k_angle")
    near = asked.select("at", "centre", "angle").join(heads, F.cos(F.greatest(F.lit(0.0), apart)) >= least - 1e-5).select("at", "k_at")
    both = near.join(asked.select("at", "ids", "m"), "at").join(known.select(F.col("at").alias("k_at"), F.col("ids").alias("to"), F.col("m").alias("k")), "k_at")
    found = both.select("ids", "m", "to", "k").mapInArrow(_scored(least), "id long, sim double, match long")
    best = found.groupBy("id").agg(F.max(F.struct("sim", (-F.col("match")).alias("order"))).alias("b"))
    return best.select("id", (-F.col("b.order")).alias("match"), F.col("b.sim").alias("sim"))


def _greedy(ids: np.ndarray, sums: np.ndarray, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In order of id, each (sum, count) joins the nearest centroid so far if their cosine reaches the threshold, or founds one."""
    order = np.argsort(ids, kind="stable")
    centres, total, many, first = np.zeros_like(sums), np.zeros_like(sums), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    made = 0
    for i in order:
        sims = centres[:made] @ _unit(sums[i])
        at = int(sims.argmax()) if made else 0
        if not made or sims[at] < threshold:
            at, made = made, made + 1
            first[at] = ids[i]
        total[at] += sums[i]
        many[at] += counts[i]
        centres[at] = _unit(total[at])
    return first[:made], total[:made], many[:made]


def merged_centroids(rows: DataFrame, threshold: float = R.FACE_CLUSTER, group: int = GROUP, seed: int = 7) -> DataFrame:
    """Centroids (id, total, n) of unit vectors (id, v): id is the smallest id that founded it, total the sum of n vectors.

    Vectors are dealt to groups that a task holds, and each group is clustered greedily in order of id. The centroids of all groups are
    dealt again, by the sides of random planes on which they lie, so that like ones meet, and merged the same way; with other planes each
    round, until one group holds all, or two rounds merged less than a hundredth. A crowded side is split by hash.
    """
    micro = rows.select("id", F.col("v").alias("total"), F.lit(1).cast("long").alias("n"))
    rng, idle, rounds, before = np.random.default_rng(seed), 0, 0, rows.count()
    first = rows.select(F.size("v").alias("d")).first()
    dim = first.d if first else 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, total, n = _greedy(pdf["id"].to_numpy(), np.array(pdf["total"].to_list(), float), pdf["n"].to_numpy(), threshold)
        return pd.DataFrame({"id": ids, "total": list(total), "n": n})

    while True:
        many = max(1, -(-before // group))
        planes = rng.normal(size=(max(0, (many - 1).bit_length()), dim))
        side = F.lit("") if rounds == 0 or many == 1 else F.concat(F.lit(""), *(F.when(K.cosine(F.col("total"), F.array(*map(F.lit, p.tolist()))) > 0, "1").otherwise("0") for p in planes))
        dealt = stored(micro.withColumn("side", side), "dealt")
        crowd = dealt.groupBy("side").agg(F.ceil(F.count("*") / group).cast("long").alias("parts"))
        dealt = dealt.join(crowd, "side").withColumn("part", F.pmod(F.xxhash64("id", F.lit(rounds)), F.col("parts")))
        micro = stored(dealt.groupBy("side", "part").applyInPandas(run, "id long, total array<double>, n long"), "centroids")
        after = micro.count()
        idle = idle + 1 if rounds and after > 0.99 * before else 0
        rounds += 1
        if many == 1 or idle == IDLE:
            return micro
        before = after


def merged_clusters(faces: DataFrame, threshold: float = R.FACE_CLUSTER, group: int = GROUP) -> DataFrame:
    """vec_id, cluster, sim: each face with the nearest of merged_centroids; a cluster is named by its smallest vec_id.

    Sets of any size, without blocks or known names. Unlike greedy_clusters, which is true to the order of all faces, groups are
    clustered side by side, so borders between clusters that touch may fall elsewhere; where clusters lie further apart than the
    threshold, and each within it, both give the same. Null and zero vectors take no part; ids are unique.
    """
    rows = stored(faces.select(F.col("vec_id").cast("long").alias("id"), K.unit(F.col("embedding")).cast("array<double>").alias("v")).where("id is not null and v is not null"), "faces")
    centres = merged_centroids(rows, threshold, group).select("id", K.unit(F.col("total")).alias("v")).where("v is not null")
    found = stored(best_match(rows, centres, -2.0), "matches")
    names = found.groupBy("match").agg(F.min("id").alias("cluster"))
    return found.join(names, "match").select(F.col("id").alias("vec_id"), "cluster", "sim")
