"""All pairs of 64-bit hashes within a Hamming distance, by an index over bands whose width follows the number of hashes.

The bits are cut into bands with thresholds t that fulfil sum(t + 1) = d + 1, so two hashes within d bits differ in at most t bits of one
band at least. Hashes of an equal band value form lists; each list is paired with those of all values within t bits, and the pairs of
lists are compared as arrays. Few wide bands bring fewer comparisons but more pairs of lists: `bands` takes the cut that costs least.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.operators.ranges import stored

#: Hashes of a list at most, about; what a pair of lists costs, in comparisons; comparisons made at once; those that make a table.
LIST, PAIR_COST, AT_ONCE, TABLE = 256, 3000, 1 << 17, 512
#: So many hashes fit a task (8 MB).
HELD = 1 << 20


def _cut(m: int, d: int) -> list[tuple[int, int, int]]:
    """m bands (shift, bits, t) of 64 bits; wider ones have the larger thresholds."""
    edges = [64 * i // m for i in range(m + 1)]
    widths = sorted(((b - a, a) for a, b in zip(edges, edges[1:], strict=False)), reverse=True)
    low, more = divmod(d + 1 - m, m)
    return [(shift, bits, low + (k < more)) for k, (bits, shift) in enumerate(widths)]


def _masks(bits: int, t: int) -> int:
    return sum(comb(bits, k) for k in range(t + 1))


@lru_cache
def bands(n: int, d: int) -> tuple[tuple[int, int, int], ...]:
    """The cut that is cheapest for n random hashes: fewer, wider bands as log2(n) grows. A band of threshold -1 isn't looked at."""

    def cost(cut: list[tuple[int, int, int]]) -> float:
        looked = [(bits, _masks(bits, t)) for _, bits, t in cut if t >= 0]
        return sum(PAIR_COST * min(n, 2**bits) * v / 2 + n * n * v / 2 ** (bits + 1) for bits, v in looked)

    fit = [_cut(m, d) for m in range(2, 33)]
    fit = [c for c in fit if all(bits <= 62 and _masks(bits, t) <= 60_000 for _, bits, t in c)]
    return tuple(min(fit, key=cost))


def _near(values: list[np.ndarray], sizes: list[np.ndarray], d: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, xs, ys) within d bits of pairs of lists: values, and sizes of the lists of each row. Long lists are compared row by row as
    tables, short ones many rows at once; either holds AT_ONCE comparisons, or one table, at a time."""
    begins = [np.cumsum(s) - s for s in sizes]
    work = sizes[0] * sizes[1]
    held, many = [], 0
    for r in np.flatnonzero(work >= TABLE):
        x, y = (v[b[r] : b[r] + s[r]] for v, b, s in zip(values, begins, sizes, strict=True))
        at = np.flatnonzero(np.bitwise_count(np.bitwise_xor.outer(x, y).view(np.uint64)).ravel() <= d)
        if len(at):
            held.append((np.full(len(at), r), x[at // len(y)], y[at % len(y)]))
            many += len(at)
        if many >= AT_ONCE:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, many = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))
    short = np.flatnonzero(work < TABLE)
    done = np.cumsum(work[short])
    cuts = [0, *(np.flatnonzero(np.diff(done // AT_ONCE)) + 1).tolist(), len(short)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        part = short[lo:hi]
        rows = np.repeat(part, work[part])
        inner = np.arange(len(rows)) - np.repeat(np.cumsum(work[part]) - work[part], work[part])
        x = values[0][begins[0][rows] + inner // sizes[1][rows]]
        y = values[1][begins[1][rows] + inner % sizes[1][rows]]
        at = np.flatnonzero(np.bitwise_count((x ^ y).view(np.uint64)) <= d)
        yield rows[at], x[at], y[at]


def _compared(cut: tuple, d: int) -> object:
    """A task over pairs of lists (i, xs, ys, same): the pairs within d bits, each only from the first band that finds it."""
    ones = [np.uint64(((1 << bits) - 1) << shift) for shift, bits, _ in cut]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            band, same = batch.column("i").to_numpy(zero_copy_only=False), batch.column("same").to_numpy(zero_copy_only=False)
            lists = [batch.column(c) for c in ("xs", "ys")]
            sizes = [np.diff(c.offsets.to_numpy()).astype(np.int64) for c in lists]
            values = [c.flatten().to_numpy(zero_copy_only=False) for c in lists]
            for row, x, y in _near(values, sizes, d):
                differ = (x ^ y).view(np.uint64)
                keep = (~same[row] | (x < y)) & (x != y)
                for i in range(len(cut)):
                    if cut[i][2] >= 0:
                        keep &= (band[row] <= i) | (np.bitwise_count(differ & ones[i]) > cut[i][2])
                x, y = x[keep], y[keep]
                columns = [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))]
                yield pa.RecordBatch.from_arrays([batch.column("block").take(pa.array(row[keep])), *columns], names=["block", "pa", "pb"])

    return run


def _lists(rows: DataFrame, n: int) -> DataFrame:
    """(block, i, v, part, xs): the hashes of each band value in lists of about LIST. Among so few that a task can hold all of them, lists
    are cut after they are made; else values with many hashes are counted first and dealt to their lists by hash."""
    if n <= HELD:
        whole = rows.groupBy("block", "i", "v").agg(F.collect_list("phash").alias("all"))
        cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / LIST).cast("int")), lambda k: F.slice("all", k * LIST + 1, F.lit(LIST)))
        return whole.select("block", "i", "v", F.posexplode(cuts).alias("part", "xs"))
    full = stored(rows.groupBy("block", "i", "v").count().where(F.col("count") > LIST).select("block", "i", "v", F.ceil(F.col("count") / LIST).alias("lists")), "full")
    dealt = rows.join(full, (rows.block.eqNullSafe(full.block)) & (rows.i == full.i) & (rows.v == full.v), "left")
    part = F.coalesce(F.pmod(F.xxhash64(rows.phash), full.lists), F.lit(0))
    return dealt.groupBy(rows.block, rows.i, rows.v, part.alias("part")).agg(F.collect_list(rows.phash).alias("xs"))


def near_hashes(distinct: DataFrame, d: int) -> DataFrame:
    """Pairs (block, pa < pb) of the distinct rows (block, phash) that share a block and differ in at most d bits, each once.

    Exact for any d below 64. A value that very many hashes share is split into several lists, so no task holds all of them. How many
    comparisons hashes of no structure take grows with n ** 1.8 at d = 16, and with n ** 1.5 at d = 8.
    """
    distinct = stored(distinct, "hashes")
    n = max(1, distinct.count())
    cut = bands(n, d)
    value = [F.shiftrightunsigned("phash", shift).bitwiseAND(F.lit((1 << bits) - 1)) for shift, bits, _ in cut]
    keys = F.array(*(F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate(value) if cut[i][2] >= 0))
    rows = distinct.select("block", F.explode(keys).alias("k"), "phash").select("block", "k.i", "k.v", "phash")
    lists = stored(_lists(rows, n), "lists")
    masks = [[sum(1 << b for b in flips) for k in range(t + 1) for flips in combinations(range(bits), k)] for _, bits, t in cut]
    sent = lists.sparkSession.createDataFrame([(i, m) for i, ms in enumerate(masks) for m in ms], "i int, mask long")
    # one side names the values at or above its own within the threshold; the masks are at most 60,000 numbers a band
    asks = lists.join(F.broadcast(sent), "i").select("block", "i", F.col("v").bitwiseXOR(F.col("mask")).alias("w"), "v", "part", "xs").where("w >= v")
    there = lists.select(F.col("block").alias("b2"), F.col("i").alias("i2"), F.col("v").alias("w2"), F.col("part").alias("part2"), F.col("xs").alias("ys"))
    met = asks.join(there, asks.block.eqNullSafe(there.b2) & (asks.i == there.i2) & (asks.w == there.w2) & ((asks.w > asks.v) | (asks.part <= there.part2)))
    both = met.select("block", "i", "xs", "ys", ((F.col("v") == F.col("w")) & (F.col("part") == F.col("part2"))).alias("same"))
    kind = distinct.schema["block"].dataType.simpleString()
    return both.mapInArrow(_compared(cut, d), f"block {kind}, pa long, pb long")
