"""Shared helpers: reading tables, writing working tables to the shared folder, hashing words of whole texts in numpy."""

from __future__ import annotations

import ctypes
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage.operators.components import use_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, and survives lost executors."""
    path = f"{use_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove the files of stored tables that nothing unfinished reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def sent(table: DataFrame, most: int = 32 << 20) -> DataFrame:
    """A stored table, marked to be broadcast if its rows as JSON take at most so many bytes together; else as it is."""
    size = table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 64).alias("n")).first().n
    return F.broadcast(table) if (size or 0) <= most else table


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Rows with idx, their place from 0 in the order among those equal in the columns by (no nulls there), and n, how many those are.

    No key goes through one task: the rows are dealt by ranges of (by, order) and stored with a number that grows within each range;
    what comes before is one count per key and range.
    """
    part = F.shiftright("_at", 33).alias("_part")
    ranged = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    kept = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), name)
    heads = kept.groupBy(*by, part).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = sent(stored(heads.select(*by, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(w).alias("n")), f"{name}-heads"))
    return kept.withColumn("_part", part).join(heads, [*by, "_part"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


#: Bytes at about which an Arrow batch of rows for Python ends, unless the session sets a bound itself. Spark's own 64 MB is a buffer of up
#: to 64 MB for each task's texts, in the executor and again in the Python worker.
BATCH_BYTES, _BATCH_CONF = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def give_back() -> None:
    """Hand memory that is free, but kept by Arrow's pool or the C library, back to the system (with C libraries that can)."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of about BATCH_BYTES. Spark keeps Python workers from task to task, so each task gives its
    memory back at its end; else the most that any step took stays beside the executor through all later ones."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF, None) is None:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(whole, schema)


def crc_mod(doc_id: object, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = {0x20, *range(0x09, 0x0E)}
#: Byte classes of the two word definitions, over UTF-8 after lower-casing A-Z.
BLANK_WORDS = np.array([b not in _SPACE for b in range(256)])
ALNUM_WORDS = np.array([b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A for b in range(256)])
_BYTE = np.random.default_rng(20260101).integers(1, 2**63, 256, dtype=np.uint64)
_K = np.uint64(0x9E3779B97F4A7C15)
_LONG = 48


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix1(x: int) -> np.uint64:
    return mix(np.array([x & (2**64 - 1)], np.uint64))[0]


def word_hashes(texts: list[str | None], word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, in order, and the offsets at which each text's words begin (one more than texts)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    data = np.frombuffer(b"\n".join(raw).translate(_LOWER) + b"\n", np.uint8)
    inside = word_bytes[data]
    inside[ends - 1] = False
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    length = stops - starts
    out = np.full(len(starts), 7, np.uint64)
    at, j = np.flatnonzero(length <= _LONG), 0
    left, pos = length[at], starts[at]
    while len(at):
        out[at] = (out[at] ^ _BYTE[data[pos + j]]) * _K + (out[at] >> np.uint64(29))
        j += 1
        keep = left > j
        if not keep.all():
            at, left, pos = at[keep], left[keep], pos[keep]
    for i in np.flatnonzero(length > _LONG):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : stops[i]].tobytes(), 11)
    return mix(out), np.concatenate([[0], np.searchsorted(starts, ends)])


def by_bytes(texts: list[str | None], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters together, so that numpy's work arrays stay small."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def parts(batches: Iterator[pa.RecordBatch], most: int = 1 << 21, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut into parts of about so many bytes of text, so that few texts at a time are Python strings; none is empty."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = np.cumsum(size, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(lo, hi - lo) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) if hi > lo)


def gram_hashes(words: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; a text of fewer words has one, of the whole sequence."""
    weights = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    m = max(0, len(words) - n + 1)
    all_ = np.zeros(m, np.uint64)
    for j in range(n):
        all_ += words[j : j + m] * weights[j]
    all_ = mix(all_)
    for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
        k = hi - lo
        if k >= n:
            yield np.unique(all_[lo : hi - n + 1])
        elif k:
            yield mix((words[lo:hi] * weights[:k]).sum(keepdims=True) + mix1(int(k) + 1000))
        else:
            yield np.zeros(0, np.uint64)
