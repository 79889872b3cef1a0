"""Benchmark decontamination on a distributed positional inverted index.

The training texts are cut into blocks; for each block and benchmark term the index stores the ascending token positions of that term
(as deltas; documents of a block lie a gap apart, so no match spans two). The index is partitioned by document and a block is one row, so
lists of different terms of one block meet where the block is read, without a shuffle. A query phrase is answered by intersecting
offset-adjusted lists from its rarest term on; rarity is the term's count over the whole index. Proximity search takes the same lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm import common as C

#: Tokens per block of the index; free positions between documents; windows searched in one pass over the index; distinct words of a
#: benchmark up to which they are sent to the tasks, so that the index holds no others (8 bytes each; beyond, it holds all words).
BLOCK_TOKENS, GAP, WINDOWS_AT_ONCE, MOST_TERMS = 400_000, 64, 200_000, 2_000_000
#: A block: its documents (base = position of the first word in the block) and its ascending terms with their numbers of positions; deltas
#: holds the positions of all terms, one term after the other, each but a term's first as the distance from the one before.
_INDEX = "block long, docs array<long>, bases array<long>, n_words array<long>, terms array<long>, counts array<int>, deltas array<int>"
_FIELDS = pa.schema([("block", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("docs", "bases", "n_words", "terms")), *((c, pa.list_(pa.int32())) for c in ("counts", "deltas"))])
_HITS = pa.schema([("block", pa.int64()), ("slot", pa.int32()), ("item", pa.string()), ("start", pa.int64()), ("length", pa.int64())])


def item_windows(items: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (item string, terms array<long>): each run of width consecutive words of an item, or all its words if fewer; distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("item").to_pylist(), batch.column("text").to_pylist()
            for lo, hi in C.by_bytes(texts):
                words, at = C.word_hashes(texts[lo:hi], C.ALNUM_WORDS)
                words, out = words.view(np.int64), []
                for item, a, b in zip(ids[lo:hi], at[:-1], at[1:], strict=True):
                    out += [{"item": item, "terms": words[i : min(i + width, b)].tolist()} for i in range(a, max(a + 1, b - width + 1)) if b > a]
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("item", pa.string()), ("terms", pa.list_(pa.int64()))]))

    items = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return C.in_arrow(items, run, "item string, terms array<long>").distinct()


def build_index(docs: DataFrame, terms: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: one row per block, with its documents and its terms' positions (see _INDEX).

    terms: sorted distinct term hashes to index; None: every word. Null and wordless texts are documents of no words.
    """
    wanted = terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.zeros(1 << 16, bool)
        if wanted is not None:
            low[wanted & 0xFFFF] = True
        block = TaskContext.get().partitionId() << 32
        for batch in C.parts(batches, BLOCK_TOKENS * 6):
            ids, texts = batch.column("doc"), batch.column("text").to_pylist()
            count = len(texts)
            words, at = C.word_hashes(texts, C.ALNUM_WORDS)
            words, n = words.view(np.int64), np.diff(at)
            base = at[:-1] + GAP * np.arange(count)
            terms, where = (np.unique(words), np.arange(len(words))) if wanted is None else (wanted, np.flatnonzero(low[words & 0xFFFF]))
            found = np.searchsorted(terms, words[where])
            good = terms[np.minimum(found, len(terms) - 1)] == words[where] if len(terms) else np.zeros(len(where), bool)
            where, found = where[good], found[good]
            order = np.argsort(found, kind="stable")
            found, place = found[order], (where + np.repeat(GAP * np.arange(count), n)[where])[order]
            cut = np.flatnonzero(np.diff(found, prepend=-1))
            deltas = np.diff(place, prepend=0)
            deltas[cut] = place[cut]
            row = [[ids.to_pylist()], [base], [n], [terms[found[cut]]], [np.diff(np.append(cut, len(found)))], [deltas]]
            yield pa.RecordBatch.from_arrays([pa.array([block]), *(pa.array(c, f.type) for c, f in zip(row, list(_FIELDS)[1:], strict=True))], schema=_FIELDS)
            block += 1

    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return C.stored(C.in_arrow(docs, run, _INDEX), "postings")


class Windows:
    """A bounded set of query windows, each with its terms ordered from the rarest in the index."""

    def __init__(self, rows: list, counts: dict[int, int]):
        self.items = np.array([r["item"] for r in rows], object)
        width = max((len(r["terms"]) for r in rows), default=1)
        self.length = np.array([len(r["terms"]) for r in rows], np.int64)
        self.terms = np.zeros((len(rows), width), np.int64)
        self.offset = np.zeros((len(rows), width), np.int64)
        for i, r in enumerate(rows):
            order = sorted(range(len(r["terms"])), key=lambda j: (counts.get(r["terms"][j], 0), j))
            self.offset[i, : len(order)] = order
            self.terms[i, : len(order)] = [r["terms"][j] for j in order]


def _starts(terms: np.ndarray, lists: list[np.ndarray], q: Windows, slop: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, start, length) of the matches in one block: exact phrases, or within slop further words and in any order."""
    at = np.zeros(1 + max((int(p[-1]) for p in lists), default=0) + GAP, np.int32)
    for k, p in enumerate(lists):
        at[p] = k + 1
    code = np.searchsorted(terms, q.terms)
    code = np.where(terms[np.minimum(code, len(terms) - 1)] == q.terms, code, -1) if len(terms) else np.full(q.terms.shape, -1)
    # a block that lacks any of a window's terms can't hold it; the places after a window's length are padding
    present = np.flatnonzero(((code >= 0) | (np.arange(q.terms.shape[1]) >= q.length[:, None])).all(1) & (q.length > 0))
    size = np.array([len(lists[k]) for k in code[present, 0]], np.int64)
    window = np.repeat(present, size)
    rare = np.concatenate([lists[k] for k in code[present, 0]]) if len(present) else np.zeros(0, np.int64)
    if slop is None:
        start = rare - q.offset[window, 0]
        for j in range(1, q.terms.shape[1]):
            active = q.length[window] > j
            place = start + q.offset[window, j]
            ok = (place >= 0) & (place < len(at)) & (start >= 0)
            hit = np.zeros(len(window), bool)
            hit[ok] = at[place[ok]] == code[window[ok], j] + 1
            keep = ~active | hit
            window, start = window[keep], start[keep]
        return window, start, q.length[window]
    found = []
    for w, p in zip(window, rare, strict=True):
        need, reach = np.bincount(code[w, : q.length[w]] + 1, minlength=len(terms) + 1), int(q.length[w]) + slop
        for s in range(max(0, p - reach + 1), p + 1):
            if (np.bincount(at[s : s + reach], minlength=len(need))[need > 0] >= need[need > 0]).all():
                own = np.flatnonzero(need[at[s : s + reach]])
                found.append((w, s + own[0], own[-1] - own[0] + 1))
                break
    w, s, n = (np.array(c, np.int64) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    return w, s, n


def _searcher(query, slop: int | None):
    """Matches of the broadcast windows in blocks of the index, one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = query.value
        for batch in batches:
            for i in range(batch.num_rows):
                block, docs, base, n, terms, counts, deltas = (batch.column(c)[i] for c in _FIELDS.names)
                base, n, terms, counts, deltas = (x.values.to_numpy() for x in (base, n, terms, counts, deltas))
                # the sum of all deltas less what the terms before have summed to is a term's own running sum
                cut, total = np.cumsum(counts)[:-1], np.cumsum(deltas, dtype=np.int64)
                before = np.concatenate([np.zeros(1, np.int64), total[cut - 1]])[: len(counts)]
                places = total - np.repeat(before, counts)
                window, start, length = _starts(terms, np.split(places, cut) if len(counts) else [], q, slop)
                doc = np.searchsorted(base, start, "right") - 1
                inside = (start - base[doc]) < n[doc]
                window, start, length, doc = window[inside], start[inside], length[inside], doc[inside]
                found = (np.full(len(doc), block.as_py()), doc, q.items[window], start - base[doc], length)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, _HITS, strict=True)], schema=_HITS)

    return run


def search(index: DataFrame, windows: DataFrame, slop: int | None = None) -> DataFrame:
    """Rows (block, slot, item, start, length): places of the windows' matches, start counted in words of the document.

    slop None: exact phrases. Otherwise all words of a window, in any order, within its length plus slop words. Windows are taken in
    sets of at most WINDOWS_AT_ONCE, each searched where the index's blocks are read, so what goes to the tasks is bounded.
    """
    spark = index.sparkSession
    windows = C.stored(windows, "windows")
    if slop is not None and (windows.agg(F.max(F.size("terms"))).first()[0] or 0) + slop > GAP:
        raise ValueError(f"a window and its slop may be {GAP} words together")
    sets = max(1, -(-windows.count() // WINDOWS_AT_ONCE))
    out = None
    for k in range(sets):
        part = windows.where(F.expr(f"pmod(xxhash64(item, terms), {sets}) = {k}"))
        wanted = part.select(F.explode("terms").alias("term")).distinct()
        terms = index.select(F.inline(F.arrays_zip("terms", "counts")).alias("term", "n"))
        counts = terms.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
        query = spark.sparkContext.broadcast(Windows(part.collect(), {r.term: r.n for r in counts.collect()}))
        found = C.in_arrow(index, _searcher(query, slop), "block long, slot int, item string, start long, length long")
        out = found if out is None else out.union(found)
    return out


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256, contaminated.

    Words are runs of bytes 0-9, a-z (A-Z lowered) and non-ASCII. Null and wordless texts have no words, such items no windows; no items
    at all leave every document clean. Repeated documents keep a row each; items that repeat an id count as one. A null item_id can't be
    named and takes no part. Extra columns are ignored.
    """
    windows = C.stored(item_windows(items.where(F.col("item_id").isNotNull()), width), "windows")
    terms = windows.select(F.explode("terms").alias("term")).distinct()
    few = terms.limit(MOST_TERMS + 1).count() <= MOST_TERMS
    index = build_index(docs, np.sort(np.array([r.term for r in terms.collect()] or [0], np.int64)) if few else None, id_col, text_col)
    ends = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "length"))),
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("end")),
        lambda s, x: F.struct((s["sum"] + F.greatest(F.lit(0).cast("long"), x["start"] + x["length"] - F.greatest(s["end"], x["start"]))).alias("sum"), F.greatest(s["end"], x["start"] + x["length"]).alias("end")),
        lambda s: s["sum"],
    )
    hits = search(index, windows).groupBy("block", "slot").agg(ends.alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    rows = index.select("block", F.posexplode(F.arrays_zip("docs", "n_words")).alias("slot", "d")).select("block", "slot", F.col("d.docs").alias("doc_id"), "d.n_words")
    rows = rows.join(hits, ["block", "slot"], "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(items_).cast("long").alias("n_items"), F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
