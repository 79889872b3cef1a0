"""Vector codes by product quantisation, fitted on all vectors with Drake and Hamerly's adaptive bounds.

A vector's integer components are cut into parts, each with a codebook of its own. After the first round, which looks at all entries, a
part keeps its own entry, its b closest others with lower bounds on their distances in ascending order, and one outer bound for all the
rest. When the entries move, bounds fall by as much, and only entries whose bound lies below the distance to the own entry are looked at.
Bounds are rounded down and kept as the upper halves of 32-bit floats; whatever they leave open is decided by integer distances.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm import common as C

#: Bounds kept per part at first, as a share of the entries, and at least; b falls to what certifies this share of all parts.
FIRST, LEAST, CERTIFIED = 8, 2, 0.95
#: Rows worked on at once, by the numbers that a part of them takes.
CELLS = 1 << 20
_STATE = "id long, label {label}, x array<long>, own binary, near binary, lower binary, outer binary, used binary"


def _packed(bound: np.ndarray) -> np.ndarray:
    """Non-negative bounds, rounded down to the upper half of a 32-bit float."""
    return (np.nextafter(bound.astype(np.float32), np.float32(0)).view(np.uint32) >> 16).astype(np.uint16)


def _unpacked(packed: np.ndarray) -> np.ndarray:
    return (packed.astype(np.uint32) << 16).view(np.float32).astype(np.float64)


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to all entries; an error if 64 bits could not hold them."""
    most = 2 * int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if most * most * x.shape[1] >= 2**62:
        raise ValueError("a component is too large for distances in 64-bit integers")
    return (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)


def look_at_all(x: np.ndarray, book: np.ndarray, b: int) -> tuple[np.ndarray, ...]:
    """(own entry, its squared distance, b nearest others, their lower bounds, outer bound) of one part of the vectors."""
    gap = squared(x, book)
    order = np.argsort(gap, axis=1, kind="stable")  # equal distances: the lower index first
    far = np.sqrt(np.take_along_axis(gap, order[:, 1 : b + 2], 1).astype(np.float64))
    outer = far[:, b] if far.shape[1] > b else np.full(len(x), np.float64(3e38))
    return order[:, 0], np.take_along_axis(gap, order[:, :1], 1)[:, 0], order[:, 1 : b + 1], far[:, :b], outer


def look_again(x: np.ndarray, book: np.ndarray, moved: np.ndarray, own: np.ndarray, near: np.ndarray, lower: np.ndarray, outer: np.ndarray, b: int) -> tuple[np.ndarray, ...]:
    """As look_at_all, after the entries have moved by so much, from what was kept; and how many bounds each row needed (more than are
    kept: all entries were looked at)."""
    kept = near.shape[1]
    gap = ((x - book[own]) ** 2).sum(1)
    bounds = np.concatenate([lower - moved[near], outer[:, None] - moved.max(initial=0)], 1).clip(0)
    bounds = np.minimum.accumulate(bounds[:, ::-1], 1)[:, ::-1]
    sure = np.sqrt(gap.astype(np.float64))[:, None] * (1 + 1e-9) < bounds * (1 - 1e-9)
    used = np.where(sure.any(1), sure.argmax(1), kept + 1)
    own, near, lower, outer = own.copy(), near.copy(), bounds[:, :kept].copy(), bounds[:, kept].copy()
    some = np.flatnonzero((used > 0) & (used <= kept))
    if len(some):
        among = np.concatenate([own[some, None], near[some]], 1)
        exact = ((x[some, None, :] - book[among]) ** 2).sum(2)
        looked = np.arange(kept + 1) <= used[some, None]
        least = np.where(looked, exact, np.iinfo(np.int64).max).min(1)
        best = np.where(looked & (exact == least[:, None]), among, len(book)).min(1)
        rank = np.where(looked, np.sqrt(exact.astype(np.float64)), np.concatenate([np.zeros((len(some), 1)), lower[some]], 1))
        rank[among == best[:, None]] = -1
        order = np.argsort(rank, axis=1, kind="stable")
        own[some], gap[some] = best, least
        near[some], lower[some] = np.take_along_axis(among, order, 1)[:, 1:], np.take_along_axis(rank, order, 1)[:, 1:]
    open_ = np.flatnonzero(used > kept)
    if b < kept:
        outer, near, lower = np.minimum(outer, lower[:, b]), near[:, :b], lower[:, :b]
    if len(open_):
        own[open_], gap[open_], near[open_], lower[open_], outer[open_] = look_at_all(x[open_], book, min(b, kept))
    return own, gap, near, lower, outer, used


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, kind).reshape(len(column), -1)


def _bytes(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _cells(a: np.ndarray) -> pa.Array:
    """One binary value per row."""
    a = np.ascontiguousarray(a)
    return pa.array([r.tobytes() for r in a], pa.binary())


def _chunks(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    step = max(1, CELLS // cells)
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            yield batch.slice(lo, step)


def _assign(books, moved, b: int, kept: int | None, last: bool) -> Callable:
    """A task over rows (id, label, x, and with kept the state of b kept bounds): to new states, or at last to codes and errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = books.value
        parts, entries, width = book.shape
        for batch in _chunks(batches, max(entries, (b + 1) * width)):
            x = _matrix(batch.column("x"), np.int64).reshape(batch.num_rows, parts, width)
            if kept is not None:
                own, outer = _bytes(batch.column("own"), np.uint8, parts).astype(np.int64), _unpacked(_bytes(batch.column("outer"), np.uint16, parts))
                near = _bytes(batch.column("near"), np.uint8, parts, kept).astype(np.int64)
                lower = _unpacked(_bytes(batch.column("lower"), np.uint16, parts, kept))
                found = [look_again(x[:, p], book[p], moved.value[p], own[:, p], near[:, p], lower[:, p], outer[:, p], b) for p in range(parts)]
            else:
                found = [(*look_at_all(x[:, p], book[p], b), np.full(len(x), 255)) for p in range(parts)]
            own, gap, near, lower, outer, used = (np.stack(v, 1) for v in zip(*found, strict=True))
            if last:
                codes = [c.tobytes().hex() for c in own.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(gap.sum(1), pa.int64())], ["id", "label", "code", "error"])
            else:
                state = [_cells(own.astype(np.uint8)), _cells(near.astype(np.uint8)), _cells(_packed(lower)), _cells(_packed(outer)), _cells(used.clip(max=255).astype(np.uint8))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("x"), *state], ["id", "label", "x", "own", "near", "lower", "outer", "used"])

    return run


def _sums(parts: int, entries: int, width: int) -> Callable:
    """A task over states (x, own, used): one row per part and entry with the count and sums of its parts, and one per part with entry
    -1 - u and the count of parts that needed u bounds."""
    names = ["part", "entry", "n", *(f"s{i}" for i in range(width))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, many, needs = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64), np.zeros((parts, 256), np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), np.int64).reshape(-1, width)
            at = (_bytes(batch.column("own"), np.uint8, parts) + np.arange(parts) * entries).ravel()
            order = np.argsort(at, kind="stable")
            cells, first = np.unique(at[order], return_index=True)
            if len(cells):
                total[cells] += np.add.reduceat(x[order], first, axis=0)
            many += np.bincount(at, minlength=parts * entries)
            used = _bytes(batch.column("used"), np.uint8, parts)
            for p in range(parts):
                needs[p] += np.bincount(used[:, p], minlength=256)
        cells, (p, u) = np.flatnonzero(many), np.nonzero(needs)
        zero = np.zeros(len(p), np.int64)
        columns = [np.concatenate(c) for c in ([cells // entries, p], [cells % entries, -1 - u], [many[cells], needs[p, u]], *([total[cells, i], zero] for i in range(width)))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """Rows (id, label, v), without vectors that are null or hold null or non-finite components."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.where(F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list]:
    """(rows (id, label, code, error, label_error), the final codebooks as nested lists of integers: part, entry, position).

    Components become floor(scale * x). A codebook starts as that part of the vectors with the smallest ids (null ids last, ties by
    components; fewer vectors: fewer entries); each round assigns every part to the nearest entry, ties to the lower index, and replaces
    entries by the floors of their means; unused ones stay. A last assignment gives the codes: two hex digits per part, so 256 entries at
    most. error: squared distances summed over parts; label_error: errors summed over equal labels, nulls together. Repeated rows and
    ids count as often as they come. Vectors whose length isn't the most common one (ties: the shorter) or can't be cut into the parts are
    left out. Components too large for exact 64-bit distances (beyond some 2^29 after scaling) are an error. An empty table gives no rows.

    Codebooks, moves and sums are parts x entries rows at most, however many vectors there are; states are written once per round, and
    those of the round before removed.
    """
    spark, label = vectors.sparkSession, vectors.schema[label_col].dataType.simpleString()
    rows = usable(vectors, id_col, vec_col, label_col).where((F.size("v") > 0) & (F.size("v") % parts == 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return spark.createDataFrame([], f"id long, label {label}, code string, error long, label_error long"), [[] for _ in range(parts)]
    dim, width = common.n, common.n // parts
    x = F.transform("v", lambda c: F.floor(c * scale))
    state = rows.where(F.size("v") == dim).select("id", "label", x.alias("x"))
    start = np.array([r.x for r in state.orderBy(F.col("id").isNull(), "id", "x").limit(entries).collect()], np.int64)
    entries = len(start)
    books = np.ascontiguousarray(start.reshape(entries, parts, width).transpose(1, 0, 2))
    moved, kept = np.zeros(books.shape[:2]), None
    b = min(max(LEAST, entries // FIRST), entries - 1)
    send = spark.sparkContext.broadcast
    for _ in range(rounds):
        before, had = state, kept
        state = C.stored(state.mapInArrow(_assign(send(books), send(moved), b, kept, False), _STATE.format(label=label)), "bounds")
        C.forget(*([before] if had is not None else []))
        schema = "part long, entry long, n long, " + ", ".join(f"s{i} long" for i in range(width))
        partial = state.select("x", "own", "used").mapInArrow(_sums(parts, entries, width), schema)
        totals = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(width))).collect()
        fresh, needs = books.copy(), np.zeros(256, np.int64)
        for r in totals:
            if r.entry >= 0:
                fresh[r.part, r.entry] = [r[f"s{i}"] // r.n for i in range(width)]
            else:
                needs[-1 - r.entry] += r.n
        moved = np.nextafter(np.sqrt(((fresh - books) ** 2).sum(2).astype(np.float64)), np.inf)
        kept, books = b, fresh
        if had is not None:
            b = min(b, max(LEAST, int(np.searchsorted(np.cumsum(needs), math.ceil(CERTIFIED * needs.sum())))))
    coded = C.stored(state.mapInArrow(_assign(send(books), send(moved), b, kept, True), f"id long, label {label}, code string, error long"), "codes")
    C.forget(*([state] if kept is not None else []))
    labels = C.sent(C.stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label-errors"))
    return coded.join(labels, F.col("label").eqNullSafe(F.col("of"))).drop("of"), books.tolist()


def codebooks_digest(books: list) -> str:
    """SHA-256 of all components as decimals, by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(str(c) for part in books for entry in part for c in entry).encode()).hexdigest()


def duckdb_sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """The query's rows, with all distances computed in every round (for vectors of one length)."""
    width = f"(len(x) // {parts})"
    gap = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    sql = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS r, vec_id, label, x FROM (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(c::DOUBLE * {scale}) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)),
part AS MATERIALIZED (SELECT r, p, x[p * {width} + 1 : (p + 1) * {width}] AS v FROM kept, (SELECT unnest(range({parts})) AS p)),
c0 AS MATERIALIZED (SELECT p, r AS e, v FROM part WHERE r < {entries})"""
    for i in range(rounds + 1):
        sql += f""",
a{i} AS MATERIALIZED (SELECT p.r, p.p, any_value(p.v) AS v, min(struct_pack(gap := CAST({gap} AS BIGINT), e := c.e)) AS best FROM part p JOIN c{i} c USING (p) GROUP BY p.r, p.p),
m{i} AS (SELECT p, best.e AS e, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT p, best, unnest(range(len(v))) AS i, unnest(v) AS x FROM a{i}) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS v FROM m{i} GROUP BY p, e) n USING (p, e))"""
    return sql + f""",
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds}),
code AS (SELECT r, string_agg(lower(printf('%02x', best.e)), '' ORDER BY p) AS code, CAST(sum(best.gap) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN code USING (r), book"""
