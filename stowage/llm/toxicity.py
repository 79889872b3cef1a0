"""Toxicity by averaged subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word's vector is the mean of the embeddings of its hashed character n-grams and of the word itself, so a misspelling shares most of
its vector with the word it hides. A text's vector is the mean of its words' vectors, in which a word that occurs c times weighs
c ** DAMP and PAD words of nothing take part. Embeddings of n-grams whose shares differ too little between the classes for the number of
labelled texts are nothing, others count by how sure the difference is: few labels then don't lead to texts learned by heart. All of
this is linear in the embeddings: for the fit a text is one sparse vector over n-gram buckets, and the trained model reduces to one
number per bucket. Texts are read whole, as arrays of code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm import common as C

#: The fit takes at most so many labelled documents of each class (label: bound), those with the smallest hash of doc_id.
SAMPLE = {0: 5000, 1: 2500}
#: ODDS: what the toxic texts of the sample count together in the fit, as a share of what the others count.
BUCKET_BITS, DIM, SCALE, EPOCHS, BATCH, RATE, DECAY, ODDS = 17, 4, 60.0, 12, 250, 0.03, 0.1, 0.5
BUCKETS = 1 << BUCKET_BITS
#: A word counts as often as it occurs to the power DAMP; PAD words of nothing are averaged in; a run without blanks counts as one word
#: for each RUN characters or part of them.
DAMP, PAD, RUN = 0.5, 50, 32
#: The least difference, in standard errors, of an n-gram's root share between the classes for it to take part: at 4, some 8 of 2^17
#: buckets would by chance alone.
SURE = 4.0
#: Few labelled texts are gone through more often than EPOCHS, until there have been so many batches.
STEPS = 400
#: Bytes of text taken at once: the arrays of their n-grams take about a hundred times as much.
PART = 1 << 19
#: Of a code point: 2 blank, 1 letter, digit or other sign of words, 0 anything else, which is left out, so that i.d.i.o.t is idiot.
_KIND = np.array([2 if chr(i).isspace() else int(chr(i).isalnum()) if not 0xD800 <= i < 0xE000 else 0 for i in range(0x10000)], np.uint8)
_FACTORS = C.mix(np.arange(101, 112, dtype=np.uint64)) | np.uint64(1)
_SHIFT = np.uint64(64 - BUCKET_BITS)


class Words:
    """The distinct words of each of some texts: text (number), weight, and per word its n-grams' buckets (grams, at: where each begins).

    A word's n-grams are those of 3 and 4 of its characters with a border on either side, and the word itself.
    """

    def __init__(self, texts: list[str | None]):
        low = [(t or "").lower() for t in texts]
        ends = np.cumsum([len(t) + 1 for t in low])
        cp = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _KIND[np.minimum(cp, 0xFFFF)]
        for i in np.flatnonzero(cp > 0xFFFF):
            kind[i] = chr(cp[i]).isalnum()
        kept = np.flatnonzero(kind)
        cp = np.where(kind[kept] == 1, cp[kept], 0).astype(np.uint64)  # blanks are 0 and serve as borders
        cp = np.concatenate([np.zeros(1, np.uint64), cp, np.zeros(2, np.uint64)])
        inside = cp != 0
        starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        length = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1 - starts
        text = np.searchsorted(ends, kept[starts - 1], "right") if len(starts) else starts
        place = np.arange(int(length.sum()), dtype=np.uint64) - np.repeat(np.cumsum(length) - length, length).astype(np.uint64)
        letters = cp[inside] * (C.mix(place + np.uint64(977)) | np.uint64(1))
        name = C.mix(np.add.reduceat(letters, np.cumsum(length) - length)) if len(starts) else cp[:0]
        # one entry per text and word, in the order of their first places
        key = name + C.mix(text.astype(np.uint64) + np.uint64(1))
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        order = np.argsort(first)
        first, count = first[order], count[order]
        self.n, self.text, size = len(texts), text[first], length[first]
        self.weight = count**DAMP * (1 + (size - 1) // RUN)
        self.size = np.maximum(2 * size, 2)  # n-grams of 3: size, of 4: size - 1, and the word
        self.at = np.cumsum(self.size) - self.size
        grams = np.zeros(int(self.size.sum()), np.uint64)
        position = np.repeat(starts[first] - self.at, self.size) + np.arange(len(grams))  # the k-th n-gram of a word begins at starts - 1 + k
        k, own = np.arange(len(grams)) - np.repeat(self.at, self.size), np.repeat(size, self.size)
        three, four = np.flatnonzero(k < own), np.flatnonzero((k >= own) & (k < 2 * own - 1))
        p, q = position[three] - 1, position[four] - own[four] - 1
        a, b, c, d, e, f, g = _FACTORS[:7]
        grams[three] = cp[p] * a + cp[p + 1] * b + cp[p + 2] * c
        grams[four] = cp[q] * d + cp[q + 1] * e + cp[q + 2] * f + cp[q + 3] * g
        grams[self.at + self.size - 1] = name[first] * _FACTORS[7]
        self.grams = ((grams * _FACTORS[8]) >> _SHIFT).astype(np.int32)

    def total(self) -> np.ndarray:
        """What each text's words weigh together, with PAD."""
        return PAD + np.bincount(self.text, self.weight, self.n)

    def features(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text (buckets, shares): what each bucket's embedding counts in its vector."""
        share = np.repeat(self.weight / self.size / self.total()[self.text], self.size)
        bounds = np.searchsorted(np.repeat(self.text, self.size), np.arange(self.n + 1))
        out = []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            buckets, back = np.unique(self.grams[lo:hi], return_inverse=True)
            out.append((buckets, np.bincount(back, share[lo:hi], len(buckets)).astype(np.float32)))
        return out

    def log_odds(self, value: np.ndarray, bias: float) -> np.ndarray:
        if not len(self.at):
            return np.full(self.n, bias)
        mean = np.add.reduceat(value[self.grams], self.at, dtype=np.float64) / self.size
        return bias + np.bincount(self.text, mean * self.weight, self.n) / self.total()


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.parts(batches, PART):
        rows = Words(batch.column("text").to_pylist()).features()
        cols = [batch.column("label"), batch.column("id"), pa.array([b for b, _ in rows], pa.list_(pa.int32())), pa.array([s for _, s in rows], pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays(cols, names=["label", "id", "buckets", "shares"])


def certainty(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """Per bucket, a tenth of the standard errors between the classes' means of its root share; 0 below SURE."""
    sums, squares = np.zeros((2, BUCKETS)), np.zeros(BUCKETS)
    for (buckets, shares), label in zip(rows, labels, strict=True):
        sums[label, buckets] += np.sqrt(shares.astype(np.float64))
        squares[buckets] += shares
    n = np.bincount(labels, minlength=2)
    spread = np.maximum(squares / n.sum() - (sums.sum(0) / n.sum()) ** 2, 1e-12)
    errors = np.abs(sums[1] / n[1] - sums[0] / n[0]) / np.sqrt(spread * (1 / n[0] + 1 / n[1]))
    return np.where(errors >= SURE, errors / 10, 0).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 11) -> tuple[np.ndarray, float]:
    """(number per bucket, bias) from texts' features of both classes: embeddings and softmax weights trained together by Adam on the
    cross entropy, in fixed batches; the embeddings decay, and the rate falls to nothing, so that the last batches don't decide. Where no
    n-gram is sure, the numbers are 0."""
    sure = certainty(rows, labels)
    rows = [(b[sure[b] > 0], (s * sure[b])[sure[b] > 0]) for b, s in rows]
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    counts = np.where(labels == 1, ODDS * (labels == 0).sum() / (labels == 1).sum(), 1.0)
    order = rng.permutation(len(rows))
    parts = [order[lo : lo + BATCH] for lo in range(0, len(order), BATCH)]
    epochs = max(EPOCHS, -(-STEPS // len(parts)))
    for _ in range(epochs):
        for part in (parts[k] for k in rng.permutation(len(parts))):
            e, w, b = params
            at = np.concatenate([rows[i][0] for i in part])
            share = np.concatenate([rows[i][1] for i in part]) * np.float32(SCALE)
            owner = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            hidden = np.stack([np.bincount(owner, e[at, d] * share, len(part)) for d in range(DIM)], 1).astype(np.float32)
            logits = hidden @ w + b
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1
            p *= (counts[part] / counts[part].sum())[:, None]
            back = (p @ w.T).astype(np.float32)
            grads = [np.stack([np.bincount(at, back[owner, d] * share, BUCKETS) for d in range(DIM)], 1), hidden.T @ p, p.sum(0)]
            rate = RATE * (1 - step / (epochs * len(parts)))
            e *= 1 - rate * DECAY
            step += 1
            for m, v, q, g in zip(first, second, params, grads, strict=True):
                m += 0.1 * (g.astype(np.float32) - m)
                v += 0.01 * (g.astype(np.float32) ** 2 - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    e, w, b = params
    return (SCALE * sure * (e @ (w[:, 1] - w[:, 0]))).astype(np.float32), float(b[1] - b[0])


def _probabilities(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, bias = model.value
        for batch in C.parts(batches, PART):
            scores = 1 / (1 + np.exp(-np.clip(Words(batch.column("text").to_pylist()).log_odds(value, bias), -500, 500)))
            at = batch.schema.get_field_index("text")
            cols = [batch.column(i) for i in range(batch.num_columns) if i != at] + [pa.array(scores, pa.float64()), batch.column(at)]
            yield pa.RecordBatch.from_arrays(cols, names=[n for n in batch.schema.names if n != "text"] + ["_score", "text"])

    return run


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float]:
    """The model of labelled documents whose crc32(id) mod 5 isn't 0, a bounded sample of each class; without both classes it is neutral
    but for a bias to the class present (none: to 0). Of an id's labels the larger counts, of its texts the one with the smallest hash."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where(f"id is not null and label in (0, 1) and not ({held_out_sql('id', 5, 0)})")
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    by_hash = [known.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(SAMPLE[y]) for y in SAMPLE]
    sample = by_hash[0].union(by_hash[1])
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")
    texts = texts.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = C.in_arrow(texts.select("label", "id", "text"), _features, "label int, id long, buckets array<int>, shares array<float>")
    found = C.in_arrow(rows.repartition(1), _fit_task, "value binary, bias double").collect()
    return np.frombuffer(found[0].value, np.float32), found[0].bias


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fit of the whole sample, in one task: its size is bounded by SAMPLE, and the driver holds none of it."""
    rows: list[tuple] = []
    for batch in batches:
        for i in range(batch.num_rows):
            buckets, shares = (batch.column(c)[i].values.to_numpy().copy() for c in ("buckets", "shares"))
            rows.append((batch.column("id")[i].as_py(), batch.column("label")[i].as_py(), buckets, shares))
    rows.sort(key=lambda r: r[0])
    y = np.array([r[1] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        value, bias = np.zeros(BUCKETS, np.float32), 5.0 if len(y) and y[0] else -5.0
    else:
        value, bias = fit([r[2:] for r in rows], y)
    yield pa.RecordBatch.from_pylist([{"value": value.tobytes(), "bias": bias}])


def held_out_sql(col: str, n: int, rest: int) -> str:
    return f"crc32(cast(cast({col} as string) as binary)) % {n} = {rest}"


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, with toxic_score (0 to 1) and toxic_predicted (1 if the score is 0.5 or more).

    Scores read the text alone. Null and wordless texts get the model's bias as their log-odds. Repeated rows keep a row each. A column
    of docs that is named like a result is left as it is and the result goes under llm_toxic_score or llm_toxic_predicted.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_on(docs, labels, id_col, text_col))
    keep = [f"_c{i}" for i in range(len(docs.columns))]
    named = docs.toDF(*keep)
    text = keep[docs.columns.index(text_col)]
    sent = named.withColumn("text", F.col(text).cast("string")).drop(text)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sent.drop("text").schema) + ", _score double, text string"
    out = C.in_arrow(sent, _probabilities(model), schema)
    cols = [F.col("text" if k == text else k).alias(c) for k, c in zip(keep, docs.columns, strict=True)]
    names = [n if n not in docs.columns else f"llm_{n}" for n in ("toxic_score", "toxic_predicted")]
    return out.select(*cols, F.col("_score").alias(names[0]), (F.col("_score") >= 0.5).cast("int").alias(names[1]))
