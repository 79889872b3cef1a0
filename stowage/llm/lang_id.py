"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle): out-of-place distance of the most frequent n-grams."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm import common as C

#: n-grams in a profile; distinct n-grams a task gathers before it passes its counts on; languages that are sent to the tasks at once.
PROFILE, FLUSH, LANGUAGES_AT_ONCE = 400, 300_000, 1000
_LETTER = np.array([chr(i).isalpha() and not 0xD800 <= i < 0xE000 for i in range(0x10000)])
_BITS = np.int64(21)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the letter n-grams of 1 to 3, lower-cased; 1 stands for a run of other characters. A code is exact: 21 bits a
    character."""
    cp = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _LETTER[np.minimum(cp, 0xFFFF)]
    for i in np.flatnonzero(cp > 0xFFFF):
        letter[i] = chr(cp[i]).isalpha()
    cp = np.where(letter, cp, 1)
    cp = cp[np.append(True, (cp[1:] != 1) | (cp[:-1] != 1))]
    two = (cp[:-1] << _BITS) | cp[1:]
    three = ((two[:-1] << _BITS) | cp[2:])[cp[1:-1] != 1] if len(cp) > 2 else two[:0]
    codes = np.sort(np.concatenate([cp[cp != 1], two, three]))
    at = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[at], np.diff(np.append(at, len(codes)))


def top(codes: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent codes, most frequent first, ties to the smaller code."""
    return codes[np.argsort(-counts, kind="stable")[:k]]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    held: dict[str, list] = defaultdict(list)

    def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
        codes, back = np.unique(np.concatenate([c for c, _ in held[lang]]), return_inverse=True)
        held[lang] = [(codes, np.bincount(back, weights=np.concatenate([n for _, n in held[lang]]), minlength=len(codes)).astype(np.int64))]
        return held[lang][0]

    def flush() -> Iterator[pa.RecordBatch]:
        for lang in list(held):
            codes, n = merged(lang)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], schema=schema)
        held.clear()

    waiting = 0
    for batch in C.parts(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            held[lang].append(grams(text))
            waiting += len(held[lang][-1][0])
            if waiting > FLUSH:
                waiting = sum(len(merged(x)[0]) for x in list(held))
                if waiting > FLUSH / 2:
                    yield from flush()
                    waiting = 0
    yield from flush()


def profiles(labelled: DataFrame, k: int = PROFILE) -> DataFrame:
    """Rows (lang, gram, rank from 0): the k most frequent n-grams of each language, counted over all the given rows (lang, text)."""
    total = labelled.where("lang is not null and text is not null").select("lang", "text").mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return total.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("lang", "gram", (F.col("place") - 1).alias("rank"))


class Model:
    def __init__(self, rows: list):
        self.langs = sorted({r.lang for r in rows})
        place = {x: i for i, x in enumerate(self.langs)}
        self.codes = np.array(sorted({r.gram for r in rows}), np.int64)
        self.rank = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for r in rows:
            self.rank[np.searchsorted(self.codes, r.gram), place[r.lang]] = r.rank

    def predict(self, text: str | None, k: int) -> tuple[str, float]:
        """(language, score); `und` and 0 for a text without a letter or a model without languages."""
        own = top(*grams(text), k)
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        at = np.where(self.codes[at] == own, at, len(self.codes))
        rank = self.rank[at]
        far = np.where(rank < 0, k, np.abs(rank - np.arange(len(own))[:, None])).sum(0)
        best = int(np.argmin(far))
        return self.langs[best], 1.0 - float(far[best]) / (k * len(own))


def predict(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = PROFILE) -> DataFrame:
    """One row (doc_id, lang_pred, score) per row of docs, learned from train's (text, lang).

    `und` with score 0 for a null text, one without a letter, or where nothing could be learned. The score is 1 less the share of the
    largest possible out-of-place distance; equal distances go to the first language by name. Rows of train without text or lang are
    passed over, repeated rows count each time. Extra columns are ignored.
    """
    known = C.stored(profiles(train, k), "profiles")
    langs = C.stored(known.select("lang").distinct().withColumn("set", F.floor((F.row_number().over(Window.orderBy("lang")) - 1) / LANGUAGES_AT_ONCE)), "languages")  # one row a language
    sets = (langs.agg(F.max("set")).first()[0] or 0) + 1
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.col(text_col).cast("string").alias("text"))
    for s in range(sets):
        rows = known.join(langs.where(F.col("set") == s), "lang").select("lang", "gram", "rank").collect()
        out = out.mapInArrow(_better(docs.sparkSession.sparkContext.broadcast(Model(rows)), k), "doc_id long, lang_pred string, score double, text string")
    return out.drop("text")


def _better(model, k: int):
    """The rows with the model's language where its score is higher than what they have; equal scores keep the language that they have,
    the first by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.parts(batches):
            had = zip(batch.column("lang_pred").to_pylist(), batch.column("score").to_pylist(), strict=True)
            found = [model.value.predict(t, k) for t in batch.column("text").to_pylist()]
            best = [f if h[0] == "und" or f[1] > h[1] else h for h, f in zip(had, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in best], pa.string()), pa.array([f[1] for f in best], pa.float64()), batch.column("text")], names=["doc_id", "lang_pred", "score", "text"])

    return run
