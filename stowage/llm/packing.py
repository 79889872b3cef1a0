"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences, with certified bin counts.

Pieces are dealt to groups of bounded size by hash; each group runs best-fit decreasing. A lower bound from dual-feasible functions
certifies a group whose bin count can't be beaten. Groups with a gap exchange documents: POOL of them pool the
pieces of their bins that have room left, and rerun; the new packing counts only if it has fewer bins.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm import common as C

#: Pieces per group at the start; groups that pool their open bins in a round; rounds (so a pool is of POOL ** ROUNDS groups' open bins at
#: most); part of a sequence that may stay free in a closed bin; bytes of words that a task remembers; what an entry takes besides its
#: characters and ids.
GROUP_PIECES, POOL, ROUNDS, SLACK, MEMO_BYTES, ENTRY = 50_000, 4, 3, 64, 160 << 20, 220
#: Bytes of text taken at once; the more, the fewer runs are looked up twice.
#: Words encoded at once, as the tokenizer's own results are large.
PART, AT_ONCE = 1 << 22, 200

_BLANKS = bytes.maketrans(b"\t\n\r", b"   ")
#: A word of Latin letters (below U+0130, the first that isn't lower-cased into one letter), and ASCII marks after it.
_LATIN = r"A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}"
_PLAIN = rf"^(?P<word>[{_LATIN}]+)(?P<marks>[.,;:!?%&*$#]*) ?$"


class _Memo:
    """Token ids of blank-separated runs of text: neither normaliser nor splitting of the tokenizer reaches across ASCII blanks.

    Latin letters (which the tokenizer lower-cases) and ASCII marks after them are tokens of their own, so a word is learnt once for all
    marks, and many new words are encoded in one string, to be cut where a token ends a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        if path not in _TOKENIZERS:  # a worker keeps it from task to task; what it remembers of texts goes with the task
            tokenizer = Tokenizer.from_file(path)
            vocabulary = tokenizer.get_vocab()
            ends = np.zeros(1 + max(vocabulary.values()), bool)
            ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
            _TOKENIZERS[path] = tokenizer, ends
        self.tokenizer, self.ends = _TOKENIZERS[path]
        self.forget()

    def forget(self) -> None:
        self.entry: dict[str, int] = {}  # entry e has ids[starts[e] : starts[e + 1]]
        self.ids, self.starts, self.size = np.zeros(0, "<u4"), np.zeros(1, np.int64), 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, keys: list[str]) -> None:
        """Makes all the keys, distinct words or other runs, known. Over MEMO_BYTES, what was known before is forgotten."""
        if self.size > MEMO_BYTES:
            self.forget()
        words, others, ids, lengths = [], [], [self.ids], [np.diff(self.starts)]
        for key in keys:
            if key not in self.entry:
                plain = key.isalpha() and (key.isascii() or max(key) < "\u0130")
                (words if plain else others).append(key)
        for lo in range(0, len(words), AT_ONCE):
            some = words[lo : lo + AT_ONCE]
            ids += self.encode([" ".join(some)])
            stops = np.flatnonzero(self.ends[ids[-1]]) + 1
            if len(stops) != len(some):
                raise ValueError("a word of Latin letters isn't one token run of this tokenizer")
            lengths.append(np.diff(stops, prepend=0))
        for lo in range(0, len(others), AT_ONCE):
            some = self.encode(others[lo : lo + AT_ONCE])
            ids += some
            lengths.append(np.array([len(x) for x in some]))
        self.entry.update((key, e) for e, key in enumerate(chain(words, others), len(self.entry)))
        self.size += ENTRY * (len(words) + len(others)) + sum(map(len, words)) + sum(map(len, others)) + sum(x.nbytes for x in ids[1:])
        self.ids, self.starts = np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])

    def of(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct runs, one after another, and where each begins (one more than runs)."""
        found = pc.extract_regex(runs, _PLAIN)
        word, marks = (pc.struct_field(found, i) for i in range(2))
        keys = pc.coalesce(pc.utf8_lower(word), pc.utf8_rtrim(runs, characters=" ")).dictionary_encode()
        marks = pc.fill_null(marks, "").dictionary_encode()
        texts, after = (x.dictionary.to_numpy(zero_copy_only=False).tolist() for x in (keys, marks))
        self.learn(list(dict.fromkeys(chain(texts, after))))
        entries = np.empty((len(runs), 2), np.int64)
        for i, (known, column) in enumerate(((texts, keys), (after, marks))):
            entries[:, i] = np.array([self.entry[k] for k in known], np.int64)[column.indices.to_numpy()]
        ids, starts = _gather(self.ids, self.starts, entries.ravel())
        return ids, starts[::2]


_TOKENIZERS: dict[str, tuple] = {}


def _gather(ids: np.ndarray, starts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids[starts[e] : starts[e + 1]] of each entry e, one after another, and where each begins (one more than entries)."""
    length = np.diff(starts)[entries]
    at = np.concatenate([[0], np.cumsum(length)])
    return ids[np.repeat(starts[entries] - at[:-1], length) + np.arange(at[-1])], at


def token_ids(texts: pa.Array, memo: _Memo) -> Iterator[np.ndarray]:
    """The ids of each text; null is empty. Blanks cut the texts into runs within Arrow's own buffer, and each distinct run is looked up once."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
    data = (texts.buffers()[2] or pa.py_buffer(b""))[ends[0] : ends[-1]].to_pybytes().translate(_BLANKS)
    ends = ends - ends[0]
    cut = np.append(False, np.frombuffer(data, np.uint8) == 0x20)
    cut[ends] = True
    cuts = np.flatnonzero(cut)
    runs = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
    ids, at = _gather(*memo.of(runs.dictionary), runs.indices.to_numpy())
    for lo, hi in pairwise(at[np.searchsorted(cuts, ends)].tolist()):
        yield ids[lo:hi]


def pieces_of(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored rows (doc_id, piece, start, length, ids_crc32, uid) of all documents; only longer ones than a sequence are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, memo = TaskContext.get().partitionId() << 36, _Memo(path)
        for batch in C.parts(batches, PART):
            rows = []
            for doc, tokens in zip(batch.column("doc").to_pylist(), token_ids(batch.column("text"), memo), strict=True):
                data = np.append(tokens, np.array([end_id], "<u4"))
                for k, at in enumerate(range(0, len(data), capacity)):
                    part = data[at : at + capacity]
                    rows.append((doc, k, at, len(part), zlib.crc32(part.tobytes()), uid))
                    uid += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), *[pa.int64()] * 4), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "uid"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return C.stored(C.in_arrow(docs, run, "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"), "pieces")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of the bin-count bounds of three families of dual-feasible functions, in whole numbers.

    The total length; Fekete and Schepers' U(eps), where items over capacity - eps count whole and those under eps not at all; and
    Lueker's u(k), which rounds (k + 1) * length / capacity down unless it is whole.
    """
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    n_from, total = np.cumsum(count[::-1])[::-1], np.concatenate([[0], np.cumsum(count * size)])
    eps = np.arange(1, capacity // 2 + 1)
    whole = np.append(n_from, 0)[capacity - eps + 1]
    middle = total[capacity - eps + 1] - total[eps]
    best = max(best, int((whole + -(-middle // capacity)).max(initial=0)))
    for k in range(1, 33):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, k * size, (scaled // capacity) * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: bin and offset of each item, and the number of bins. Bins wait by their room, found by a bit set."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, used = 0, 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b, used = capacity, used, used + 1
        bins[i], offsets[i] = b, capacity - room
        left = room - n
        if left:
            if not by_room[left]:
                rooms |= 1 << left
            by_room[left].append(b)
    return bins, offsets, used


_PLACED = "uid long, length long, sequence_id long, offset long, old_group long, closed boolean, bins long, bound long"


def _pack(capacity: int, number: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "uid"], ascending=[False, True])
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets, used = best_fit(lengths, capacity)
        fill = np.bincount(bins, weights=lengths)
        name = (number << 56) + (int(key[0]) << 32)
        return pd.DataFrame({"uid": pdf["uid"], "length": lengths, "sequence_id": name + bins, "offset": offsets, "old_group": int(key[0]), "closed": fill[bins] > capacity - capacity / SLACK, "bins": used, "bound": lower_bound(lengths, capacity)})

    return run


def best_fit_packing(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids by the tokenizer file at path, then end_id; a null or empty text is end_id alone. Documents that repeat an id
    are packed as documents of their own; a null id stays null. No documents give no rows. Extra columns are ignored.
    """
    pieces = pieces_of(docs, path, capacity, end_id, id_col, text_col)
    whole = pieces.where(F.col("length") == capacity).select("uid", (F.col("uid") + (1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    groups = -(-rest.count() // GROUP_PIECES) or 1
    placed = rest.withColumn("group", F.pmod(F.xxhash64("uid"), F.lit(groups))).groupBy("group").applyInPandas(_pack(capacity, 0), _PLACED)
    placed, done = C.stored(placed, "packed"), whole
    final = lambda df: df.select("uid", "sequence_id", "offset")
    for turn in range(1, ROUNDS + 1):
        gap = F.col("bins") > F.col("bound")
        if groups == 1 or placed.where(gap).isEmpty():
            break
        groups = -(-groups // POOL)
        pooled = placed.where(gap & ~F.col("closed")).withColumn("group", F.floor(F.col("old_group") / POOL).cast("long"))
        done = done.union(final(placed.where(~gap | F.col("closed"))))
        again = C.stored(pooled.select("uid", "length", "group").groupBy("group").applyInPandas(_pack(capacity, turn), _PLACED), "packed")
        had = pooled.groupBy("group").agg(F.countDistinct("sequence_id").alias("had"))
        better = again.groupBy(F.col("old_group").alias("group")).agg(F.max("bins").alias("now")).join(had, "group").where("now < had").select("group")
        done = done.union(final(pooled.join(better, "group", "left_anti")))
        placed = again.join(better.withColumnRenamed("group", "old_group"), "old_group", "left_semi")
    done = done.union(final(placed))
    return pieces.join(done, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
