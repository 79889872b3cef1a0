"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of one full-dimensional codeword from each of several codebooks. Codebooks come from k-means on residuals,
then alternate with least squares on a bounded sample; encoding is a beam search. A code keeps its reconstruction's squared norm, so a
squared distance is |q|^2 - 2 <q, x'> + |x'|^2 with <q, x'> a sum of table look-ups. The best by code are reranked on exact distances.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm import common as C

#: Vectors the fit takes at most (those with the smallest hash of id); codebooks and codewords each; beam; alternations of the fit.
SAMPLE, BOOKS, WORDS, BEAM, TURNS = 8000, 16, 256, 6, 2
#: Candidates reranked per query: so many times the square root of the number of vectors, but RERANK at least; vectors per index shard;
#: queries that are sent to the tasks at once, and scored together.
RERANK, GROWTH, SHARD, QUERIES, TOGETHER = 800, 4, 20_000, 4096, 256


def _encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes by beam search: after each codebook the partial sums with the least squared error are kept."""
    n, rows = len(x), np.arange(len(x))[:, None]
    codes, sums = np.zeros((n, 1, 0), np.uint8), np.zeros((n, 1, x.shape[1]), np.float32)
    for book in books:
        left = x[:, None, :] - sums
        cost = (left**2).sum(2)[:, :, None] - 2 * left @ book.T + (book**2).sum(1)
        flat = cost.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        parent, word = best // len(book), best % len(book)
        sums = sums[rows, parent] + book[word]
        codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], 2)
        last = flat[rows, best]
    return codes[np.arange(n), np.argmin(last, 1)]


def fit(x: np.ndarray, seed: int = 5) -> np.ndarray:
    """Codebooks (BOOKS, words, dim). Fewer vectors than codewords: the words repeat."""
    rng = np.random.default_rng(seed)
    left, books = x.astype(np.float32).copy(), []
    for _ in range(BOOKS):
        book = left[rng.choice(len(left), WORDS, replace=len(left) < WORDS)].copy()
        for _ in range(8):
            near = np.argmin((book**2).sum(1) - 2 * left @ book.T, 1)
            count = np.bincount(near, minlength=WORDS)
            total = np.stack([np.bincount(near, weights=left[:, d], minlength=WORDS) for d in range(left.shape[1])], 1)
            book[count > 0] = (total[count > 0] / count[count > 0, None]).astype(np.float32)
        left -= book[np.argmin((book**2).sum(1) - 2 * left @ book.T, 1)]
        books.append(book)
    books = np.stack(books)
    for _ in range(TURNS):
        codes = np.concatenate([_encode(x[i : i + 1000], books) for i in range(0, len(x), 1000)])
        at = codes.astype(np.int64) + np.arange(BOOKS) * WORDS
        gram, right = np.zeros((BOOKS * WORDS, BOOKS * WORDS)), np.zeros((BOOKS * WORDS, x.shape[1]))
        for m in range(BOOKS):
            np.add.at(right, at[:, m], x)
            for k in range(BOOKS):
                np.add.at(gram, (at[:, m], at[:, k]), 1.0)
        books = np.linalg.solve(gram + 0.1 * np.eye(len(gram)), right + 0.1 * books.reshape(-1, x.shape[1])).reshape(books.shape).astype(np.float32)
    return books


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (id, v): without null ids, and without vectors that are null, empty, zero or hold null or non-finite components."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def build_index(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """Stored rows (shard, ids, codes, norms), each of at most SHARD vectors: every row is coded."""
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo in range(0, batch.num_rows, SHARD):
                part = batch.slice(lo, SHARD)
                x = _matrix(part.column("v")).astype(np.float32)
                codes = np.concatenate([_encode(x[i : i + 500], sent.value) for i in range(0, len(x), 500)])
                sums = sum(book[codes[:, m]] for m, book in enumerate(sent.value))
                yield pa.RecordBatch.from_pylist([{"shard": shard, "ids": part.column("id").to_numpy().tobytes(), "codes": codes.tobytes(), "norms": (sums**2).sum(1).astype(np.float32).tobytes()}], schema=pa.schema([("shard", pa.int64()), ("ids", pa.binary()), ("codes", pa.binary()), ("norms", pa.binary())]))
                shard += 1

    return C.stored(rows.mapInArrow(run, "shard long, ids binary, codes binary, norms binary"), "codes")


def _merged(parts: list[tuple[np.ndarray, np.ndarray]], rerank: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the rerank best of several lists, ties to the smaller id."""
    ids, score = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    best = np.lexsort((ids, score))[:rerank]
    return ids[best], score[best]


def _scan(books, queries, rerank: int):
    """Per task and query one row with the rerank best ids by code, ties to the smaller id, of all shards that the task met."""
    schema = pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        q_ids, all_queries = queries.value
        for batch in batches:
            for row in batch.to_pylist():
                ids, norms = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["norms"], np.float32)
                codes = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1)
                order = np.argsort(ids, kind="stable")
                ids, norms, codes = ids[order], norms[order], codes[order]
                for lo in range(0, len(q_ids), TOGETHER):
                    q = all_queries[lo : lo + TOGETHER]
                    tables = np.einsum("mwd,qd->mqw", books.value, q)
                    for i, q_id in enumerate(q_ids[lo : lo + TOGETHER].tolist()):
                        score = norms.copy()
                        for m in range(codes.shape[1]):
                            score -= 2 * tables[m, i][codes[:, m]]
                        near = _smallest(score, min(len(ids), rerank + 1))
                        near = near[ids[near] != q_id][:rerank]
                        own = (ids[near], score[near])
                        best[q_id] = _merged([best[q_id], own], rerank) if q_id in best else own
        items = list(best.items())
        for lo in range(0, len(items), 64):
            yield pa.RecordBatch.from_pylist([{"query_id": q, "ids": i, "scores": s} for q, (i, s) in items[lo : lo + 64]], schema=schema)

    return run


def _smallest(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest, ties to the earlier place."""
    limit = np.partition(score, k - 1)[k - 1]
    less, equal = np.flatnonzero(score < limit), np.flatnonzero(score == limit)
    near = np.concatenate([less, equal[: k - len(less)]])
    return near[np.lexsort((near, score[near]))]


def _fit_task(sample: pd.DataFrame) -> pd.DataFrame:
    x = np.stack(sample.sort_values("id")["v"].to_numpy()).astype(np.float32)
    return pd.DataFrame({"books": [fit(x).tobytes()]})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", rerank: int | None = None) -> DataFrame:
    """Rows (query_id, rank from 1, vec_id, score): each query's k nearest found by Euclidean distance, its own id left out.

    Distances are exact, in double precision on the original vectors; ties go to the smaller id. Unusable vectors (see usable), and those
    of another length than most have (ties: the smaller length), take no part on either side. Repeated rows of an id count as one (the
    least). The query set is stated by the caller; it is sent to the index's shards in blocks of QUERIES, so no index row is shuffled.
    rerank: candidates per query that are compared exactly; None: by RERANK and GROWTH.
    """
    spark = vectors.sparkSession
    all_ = usable(vectors, id_col, vec_col)
    lengths = all_.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, whole = lengths["n"], F.size("v") == lengths["n"]
    rerank = max(RERANK, int(GROWTH * lengths["count"] ** 0.5)) if rerank is None else rerank
    rows = C.stored(all_.where(whole).groupBy("id").agg(F.min("v").alias("v")), "vectors")
    asked = C.stored(usable(queries, id_col, vec_col).where(whole).groupBy("id").agg(F.min("v").alias("v")), "queries")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    found = sample.groupBy(F.lit(0).alias("all")).applyInPandas(_fit_task, "books binary").first()
    books = np.frombuffer(found.books, np.float32).reshape(BOOKS, WORDS, dim)
    index, sent = build_index(rows, books), spark.sparkContext.broadcast(books)
    blocks, best = max(1, -(-asked.count() // QUERIES)), None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toPandas()
        some = (part["id"].to_numpy(np.int64), np.array(part["v"].to_list(), np.float32).reshape(len(part), dim))
        scanned = index.mapInArrow(_scan(sent, spark.sparkContext.broadcast(some), rerank), "query_id long, ids array<long>, scores array<float>")
        best = scanned if best is None else best.union(scanned)

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, _ = _merged([(np.asarray(i, np.int64), np.asarray(s, np.float32)) for i, s in zip(pdf["ids"], pdf["scores"], strict=True)], rerank)
        return pd.DataFrame({"query_id": key[0], "id": ids})

    near = best.groupBy("query_id").applyInPandas(merge, "query_id long, id long")
    exact = near.join(rows, "id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("qv")), "query_id")
    gap = F.sqrt(F.aggregate(F.zip_with("v", "qv", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    exact = exact.select("query_id", F.col("id").alias("vec_id"), gap.alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return exact.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
