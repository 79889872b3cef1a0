"""Exact n-gram Jaccard self-join with vertical partitioning of the global n-gram order.

The global order of n-grams is the order of their 64-bit hashes. Candidates: the order is cut into F fragments, F some more than the
largest symmetric difference D that two linked sets of that size can have, so two linked sets agree wholly on F - D fragments at least
(pigeonhole); a fragment that sets share is an equi-join key. Verification: the order is cut into FRAGMENTS ranges; the overlaps of a
pair are counted for each range by itself, in tasks of their own, and summed per pair.

Links are found without expanding groups of copies: every bucket of equal fragments is compared as a star around a leader first. Only
buckets which then hold more than one component are compared further, across components: two sets can link only if they share as many
fragments as two linked sets of their sizes must. In small buckets such pairs are rows; in large ones tasks of two blocks of documents
tell only which documents hang together by such pairs, and whole families of them are then compared block by block, again fragment by
fragment, with no pair leaving a task but what joins components. So no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm import common as C
from stowage.operators.components import connected_components

#: Kinds of rows: first of its fragment key in a chunk, later holder of a key, set of a chunk, document, document without an id.
KEY, HELD, SET, DOC, NO_ID = 0, 1, 2, 3, 4
#: doc: the first document of the set in its chunk. a, b: of HELD rows the key's first document and the key, of SET rows the second half
#: of the set's mark. n: size of the set. id: of SET rows the smallest id of the set in its chunk, of DOC rows the document's own.
_ROW = "pkey long, kind int, doc long, a long, b long, n long, id long"
#: A fragment of a set, with the documents that the set is held against and whether others are held against it.
_RANGE = "doc long, leads array<long>, leading boolean, fragment int, size long, grams binary"
_SALTS = [int(C.mix1(i + 77)) for i in range(4)]
#: Ranges of the order in which overlaps are counted; most documents of a bucket joined as pairs of rows; documents per block of a larger one;
#: documents up to which the list of those with candidates is sent to the tasks instead of shuffling all texts (8 bytes each).
FRAGMENTS, SMALL, BLOCK, SENT_DOCS = 4, 32, 2048, 1_000_000
#: The low bits of a fragment key hold the number of its size band.
_BAND_BITS = 7


def size_bands(percent: int) -> np.ndarray:
    """Limits of size bands, so wide that two linked sets lie in one band or in neighbouring ones."""
    limits = [1]
    while limits[-1] < 1 << 40:
        limits.append(max(limits[-1] * 4 // 3, limits[-1] * 100 // percent) + 1)
    return np.array(limits, np.int64)


def most_different(total: int, percent: int) -> int:
    """The largest symmetric difference of two linked sets of so many elements together."""
    return total * (100 - percent) // (100 + percent)


def fragment_keys(grams: np.ndarray, percent: int, bands: np.ndarray) -> np.ndarray:
    """Keys of the fragments of one sorted set, for its own size band and, if a linked set can lie there, the next.

    With D the most by which linked sets of the band differ, D + s fragments leave s equal ones. A set with s or more empty fragments
    might share only empty ones; it is cut again under another order (and at the last order gives keys for empty ones too). s is twice
    the number of empty fragments to be expected in the smallest sets, so this is rare. So two linked sets that differ by d share at
    least D - d + 1 keys of the band.
    """
    n, out = len(grams), []
    smallest = percent * (100 + percent) / (100 * 2 * (100 - percent) * max(4 / 3, 100 / percent)) if percent < 100 else 50.0
    share = 2 * np.exp(-smallest)
    k = int(np.searchsorted(bands, n, "right")) - 1
    for band in [k, k + 1] if 100 * n >= percent * bands[k + 1] else [k]:
        most = most_different(int(2 * (bands[band + 1] - 1)), percent)
        spare = 2 + int(most * share) if most else 1
        count = most + spare
        for level, salt in enumerate(_SALTS):
            g = grams if not level else np.sort(C.mix(grams ^ np.uint64(salt)))
            edges = np.searchsorted(((g >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32), np.arange(count + 1))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mix(g))])
            name = C.mix(np.arange(count, dtype=np.uint64) + C.mix1((band << 8) + level))
            keys = C.mix((sums[edges[1:]] - sums[edges[:-1]]) ^ name)
            keys = (keys >> np.uint64(_BAND_BITS) << np.uint64(_BAND_BITS)) | np.uint64(band)
            full = edges[1:] > edges[:-1]
            empty = count - int(full.sum())
            last = level + 1 == len(_SALTS)
            out.append(keys if last and empty >= spare else keys[full])
            if empty < spare:
                break
    return np.unique(np.concatenate(out))


def _postings(n: int, percent: int):
    """Rows of _ROW for each chunk of documents. Copies of a set are no more than a DOC row, and later holders of a key name the first in
    the chunk as their leader and are spread by their own id, so that a group of copies sends one row per chunk and key to the key's
    own task."""
    bands = size_bands(percent)

    def of_chunk(docs: list, ids: list, texts: list) -> list[np.ndarray]:
        rows, sets, keys, owners, sizes = [], {}, [], [], []
        for doc, id_, grams in zip(docs, ids, C.gram_hashes(*C.word_hashes(texts, C.BLANK_WORDS), n), strict=True):
            size = len(grams)
            if doc is None:
                rows.append((len(rows), NO_ID, 0, 0, 0, size, 0))
                continue
            own = int(C.mix1(doc).view(np.int64))
            mark = tuple(int(C.mix(grams ^ np.uint64(s)).sum().view(np.int64)) for s in _SALTS[:2]) if size else (own, doc)
            if mark not in sets:
                sets[mark] = [doc, size, id_]
                keys.append(fragment_keys(grams, percent, bands) if size else grams)
                owners.append(np.full(len(keys[-1]), doc, np.int64))
                sizes.append(np.full(len(keys[-1]), size, np.int64))
            sets[mark][2] = min(sets[mark][2], id_)
            rows.append((own, DOC, sets[mark][0], 0, 0, size, id_))
        rows += [(mark[0], SET, doc, mark[1], 0, size, id_) for mark, (doc, size, id_) in sets.items()]
        cols = [np.array([r[c] for r in rows], np.int64) for c in range(7)]
        if keys:
            key, owner, size = np.concatenate(keys), np.concatenate(owners), np.concatenate(sizes)
            _, first, back = np.unique(key, return_index=True, return_inverse=True)
            leader = owner[first][back]
            held = np.ones(len(key), bool)
            held[first] = False
            first.sort()  # document by document: rows that differ in nothing but the key are half as long in the shuffle's files
            none, more = np.zeros(len(first), np.int64), np.zeros(int(held.sum()), np.int64)
            spread = C.mix(key[held] + owner[held].view(np.uint64)).view(np.int64)
            lead = (key[first].view(np.int64), none + KEY, owner[first], none, none, size[first], none)
            rest = (spread, more + HELD, owner[held], leader[held], key[held].view(np.int64), size[held], more)
            cols = [np.concatenate(c) for c in zip(cols, lead, rest, strict=True)]
        return cols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.parts(batches):
            cols = of_chunk(*(batch.column(c).to_pylist() for c in ("doc", "id", "text")))
            for at in range(0, len(cols[0]), 50_000):
                part = [pa.array(c[at : at + 50_000]) for c in cols]
                part[1] = part[1].cast(pa.int32())
                yield pa.RecordBatch.from_arrays(part, names=["pkey", "kind", "doc", "a", "b", "n", "id"])

    return run


def _ranges(n: int):
    """Rows of _RANGE of texts: each set cut into FRAGMENTS ranges of the global order; empty ranges have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.parts(batches):
            rows: list[tuple] = []
            for i, g in enumerate(C.gram_hashes(*C.word_hashes(batch.column("text").to_pylist(), C.BLANK_WORDS), n)):
                cut = np.searchsorted(((g >> np.uint64(32)) * np.uint64(FRAGMENTS)) >> np.uint64(32), np.arange(FRAGMENTS + 1))
                rows += [(i, f, len(g), g[x:y].tobytes()) for f, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]
            if rows:
                at, *cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)]
                kept = [batch.column(c).take(at) for c in ("doc", "leads", "leading")]
                yield pa.RecordBatch.from_arrays([*kept, *cols], names=["doc", "leads", "leading", "fragment", "size", "grams"])

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, common, total): the overlap of a pair's two sets within one fragment, and the sizes of the whole sets together."""
    for batch in batches:
        common, last, x = [], None, None
        for ga, gb in zip(batch.column("ga"), batch.column("gb"), strict=True):
            if (raw := ga.as_py()) != last:
                last, x = raw, np.frombuffer(raw, np.uint64)
            y = np.frombuffer(gb.as_py(), np.uint64)
            common.append(int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum()))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), batch.column("total")], names=["a", "b", "common", "total"])


def _roles(pairs: DataFrame) -> DataFrame:
    """Rows (doc, leads, leading) of pairs (a, b): the documents that doc is held against as b, and whether it is an a itself."""
    sides = pairs.select(F.col("b").alias("doc"), F.col("a").alias("lead")).union(pairs.select("a", F.lit(None).cast("long")).distinct())
    return sides.groupBy("doc").agg(F.collect_list("lead").alias("leads"), F.bool_or(F.col("lead").isNull()).alias("leading"))


def _verified(ranges: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b), named by the roles in ranges, whose sets link. Each fragment of a pair is a row and a task's work of its own;
    partial overlaps are summed. No document that takes no part is shuffled, and none that only leads more than once."""
    left = ranges.select(F.explode("leads").alias("a"), F.col("doc").alias("b"), "fragment", F.col("size").alias("nb"), F.col("grams").alias("gb"))
    right = ranges.where("leading").select(F.col("doc").alias("a"), "fragment", F.col("size").alias("na"), F.col("grams").alias("ga"))
    joined = left.join(right, ["a", "fragment"]).select("a", "b", "ga", "gb", (F.col("na") + F.col("nb")).alias("total"))
    partial = C.in_arrow(joined, _overlaps, "a long, b long, common long, total long")
    whole = partial.groupBy("a", "b").agg(F.sum("common").alias("i"), F.max("total").alias("total"))
    return whole.where(F.expr(f"100 * i >= {percent} * (total - i)")).select("a", "b")


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(f"{x} <> {y}").select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _least_shared(percent: int, total: str) -> Column:
    """How many keys of the column key's band two linked sets of total elements share at least."""
    most = [most_different(int(2 * (b - 1)), percent) for b in size_bands(percent)[1:]]
    band = F.col("key").bitwiseAND((1 << _BAND_BITS) - 1).cast("int")
    return F.greatest(F.lit(1), F.element_at(F.lit(most), band + 1) - F.floor(F.expr(f"({total}) * {100 - percent} / {100 + percent}")) + 1)


def _by_rows(open_: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) across components of small buckets, joined as rows, that share keys enough within a band to link."""
    x = open_.select("key", F.col("doc").alias("x"), F.col("n").alias("nx"), "component")
    y = open_.select("key", F.col("doc").alias("y"), F.col("n").alias("ny"), F.col("component").alias("other"))
    met = x.join(y, "key").where("component < other").withColumn("need", _least_shared(percent, "nx + ny")).where(f"100 * least(nx, ny) >= {percent} * greatest(nx, ny)")
    band = F.col("key").bitwiseAND((1 << _BAND_BITS) - 1)
    shared = met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), band.alias("band")).agg(F.count("*").alias("m"), F.first("need").alias("need"))
    return shared.where("m >= need").select("a", "b")


def _joined(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> pd.DataFrame:
    """Pairs (a, b) that join all documents which hang together by links between left and right: a star for each group, not the links."""
    docs, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    none, at_left, at_right = np.int32(len(docs)), place[: len(left)], place[len(left) :]
    label = np.arange(len(docs), dtype=np.int32)
    while True:
        least = label.copy()
        np.minimum.at(least, at_right, np.where(link, label[at_left][:, None], none).min(0, initial=none))
        np.minimum.at(least, at_left, np.where(link, label[at_right][None, :], none).min(1, initial=none))
        least = least[least]
        if (least == label).all():
            break
        label = least
    far = np.flatnonzero(label != np.arange(len(docs)))
    return pd.DataFrame({"a": docs[far], "b": docs[label[far]]})


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many codes each of left shares with each of right, by products of incidence matrices over a bounded number of codes."""
    owner = [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in (left, right)]
    codes = [np.concatenate(side) if side else np.zeros(0, np.uint64) for side in (left, right)]
    both = np.intersect1d(*codes)
    shared = np.zeros((len(left), len(right)), np.float32)
    for k in range(2):
        at = np.minimum(np.searchsorted(both, codes[k]), max(len(both) - 1, 0))
        met = both[at] == codes[k] if len(both) else np.zeros(len(at), bool)
        order = np.argsort(at[met], kind="stable")
        codes[k], owner[k] = at[met][order], owner[k][met][order]
    for lo in range(0, len(both), 1024):
        has = []
        for k, side in enumerate((left, right)):
            x, y = np.searchsorted(codes[k], [lo, lo + 1024])
            has.append(np.zeros((len(side), 1024), np.float32))
            has[k][owner[k][x:y], codes[k][x:y] - lo] = 1
        shared += has[0] @ has[1].T
    return shared


def _dealt(rows: DataFrame, by: str, n: str) -> DataFrame:
    """Each row for all pairs (p, q) of blocks that its own block takes part in; n documents of a group make n / BLOCK blocks."""
    blocks = F.ceil(F.col(n) / BLOCK)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return rows.select(by, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), *[c for c in rows.columns if c not in (by, "other", n)])


def _possible(large: DataFrame, open_: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that join documents of large buckets which hang together by pairs across components that share keys enough to link:
    every two blocks of a bucket's documents meet in a task with their documents' keys of the bucket's band."""
    band = F.col("key").bitwiseAND((1 << _BAND_BITS) - 1)
    keys = open_.join(large.select("doc").distinct(), "doc", "left_semi").groupBy("doc", band.alias("band")).agg(F.collect_list("key").alias("keys"))
    dealt = _dealt(large.withColumn("band", band), "key", "all").join(keys, ["doc", "band"])
    most = [most_different(int(2 * (b - 1)), percent) for b in size_bands(percent)[1:]]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (pdf[pdf["own"] == k] for k in key[1:])
        shared = _common(x["keys"].to_list(), y["keys"].to_list())
        nx, ny = x["n"].to_numpy(np.int32)[:, None], y["n"].to_numpy(np.int32)[None, :]
        fits = shared >= np.maximum(1, most[int(pdf["band"].iloc[0])] + 1 - most_different(nx + ny, percent))
        fits &= 100 * np.minimum(nx, ny).astype(np.int64) >= percent * np.maximum(nx, ny).astype(np.int64)
        fits &= x["component"].to_numpy()[:, None] != y["component"].to_numpy()[None, :]
        return _joined(fits, x["doc"].to_numpy(), y["doc"].to_numpy())

    return dealt.groupBy("key", "p", "q").applyInPandas(run, "a long, b long")


def _in_families(families: DataFrame, ranges: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that join linked documents of different components within each family (doc, family, component, n): every two blocks
    of its documents meet in a task, which sums the partial overlaps of all their pairs fragment by fragment."""
    dealt = _dealt(ranges.join(families, "doc"), "family", "n")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for k in key[1:]:
            side = pdf[pdf["own"] == k]
            docs, first, at = np.unique(side["doc"].to_numpy(), return_index=True, return_inverse=True)
            grams = [[np.zeros(0, np.uint64)] * len(docs) for _ in range(FRAGMENTS)]
            for i, fragment, raw in zip(at, side["fragment"], side["grams"], strict=True):
                grams[fragment][i] = np.frombuffer(raw, np.uint64)
            sides.append((docs, side["component"].to_numpy()[first], side["size"].to_numpy()[first], grams))
        (x, cx, nx, gx), (y, cy, ny, gy) = sides
        shared = sum(_common(a, b) for a, b in zip(gx, gy, strict=True)).astype(np.int64)
        link = (100 * shared >= percent * (nx[:, None] + ny[None, :] - shared)) & (cx[:, None] != cy[None, :])
        return _joined(link, x, y)

    return dealt.groupBy("family", "p", "q").applyInPandas(run, "a long, b long")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, n_shingles, component_id) per document with an id; documents link when 100 * |A n B| >= percent * |A u B|.

    A null or wordless text has an empty set, links with nothing and is its own component. A text of fewer than n words has its whole
    word sequence as one shingle. Rows that repeat an id keep a row each and share the id's links. Rows without an id keep a row too,
    with a null component. Extra columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # rows are told apart by id and text, so that two texts of one id are compared each by itself
    docs = docs.select(F.when(F.col("id").isNotNull(), F.xxhash64("id", "text")).alias("doc"), "text", "id")
    w = Window.partitionBy("pkey", "kind", F.when(F.col("kind") == SET, F.col("a")))
    rows = C.in_arrow(docs, _postings(n, percent), _ROW).withColumns({"lead": F.min("doc").over(w), "held": F.count("*").over(w)})
    rows = C.stored(rows.where(f"kind <> {KEY} or held > 1").drop("held"), "buckets")
    per_doc = C.stored(rows.where(F.col("kind").isin(SET, DOC, NO_ID)), "per-doc")  # small, and needed to the end; the buckets go early
    of = {kind: (rows if kind in (KEY, HELD) else per_doc).where(F.col("kind") == kind) for kind in (KEY, HELD, SET, DOC, NO_ID)}
    sets = of[SET].select("doc", F.col("lead").alias("rep"), "id")
    later = sets.where("doc <> rep").select("doc", "rep").distinct()
    held = of[HELD].select(F.col("b").alias("key"), "doc", F.col("a").alias("lead"), "n")
    bucket = of[KEY].select(F.col("pkey").alias("key"), "doc", "lead", "n").union(held)
    # the chunk's first holder of a key may have lost its own row, if no other chunk has the key; its size is its set's
    firsts = held.select("key", F.col("lead").alias("doc")).distinct().join(of[SET].select("doc", "n"), "doc").select("key", "doc", "n")
    members = bucket.select("key", "doc", "n").union(firsts)
    members = C.stored(members.join(later, "doc", "left").select("key", F.coalesce("rep", "doc").alias("doc"), "n").distinct(), "members")

    star = bucket.where("doc <> lead").groupBy("doc", "lead", F.col("key").bitwiseAND((1 << _BAND_BITS) - 1).alias("band")).agg(F.count("*").alias("m"), F.first("key").alias("key"), F.first("n").alias("n"))
    # a star only saves work: what it doesn't compare stays open. The leader's size isn't known here, so the larger bound holds
    star = star.where(F.col("m") >= _least_shared(percent, f"n + n * 100 / {percent}")).select("doc", "lead").distinct()
    for c in ("doc", "lead"):
        star = star.join(later.withColumnRenamed("doc", c), c, "left").withColumn(c, F.coalesce("rep", c)).drop("rep")
    tested = C.stored(_pairs(star, "doc", "lead"), "pairs")
    C.forget(rows)
    wanted = C.stored(members.select("doc").distinct(), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= SENT_DOCS else wanted
    # a document's part in the pairs is told where its copies meet anyway
    texts = docs.select("doc", "text").join(wanted, "doc", "left_semi").dropDuplicates(["doc"]).join(_roles(tested), "doc", "left")
    cut = C.stored(C.in_arrow(texts, _ranges(n), _RANGE), "ranges")
    found = connected_components(C.stored(_verified(cut, percent), "links"))
    ranges = cut.drop("leads", "leading")

    inside = members.join(found.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", "n", F.coalesce("component", "doc").alias("component"))
    whole = inside.groupBy("key").agg(F.count("*").alias("all"), F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    open_ = C.stored(inside.join(whole.select("key", "all"), "key"), "open")
    C.forget(members)
    pairs = _by_rows(open_.where(F.col("all") <= SMALL), percent).distinct().join(tested, ["a", "b"], "left_anti")
    more = _verified(ranges.join(C.sent(C.stored(_roles(pairs), "roles")), "doc"), percent)
    large = open_.where(F.col("all") > SMALL)
    families = connected_components(C.stored(_possible(large, open_, percent), "possible")).select(F.col("node").alias("doc"), F.col("component").alias("family"))
    families = families.join(large.select("doc", "component").distinct(), "doc").join(families.groupBy("family").agg(F.count("*").alias("n")), "family")
    families = C.sent(C.stored(families, "families"))
    more = C.stored(more.union(_in_families(families, ranges, percent)), "links")
    C.forget(cut, open_)

    # from here on a set goes by its smallest id, so that components are named by it; an id that several texts share joins their sets
    reps = C.stored(sets.groupBy("rep").agg(F.min("id").alias("node")), "sets")
    at = lambda x: reps.select(F.col("rep").alias(x), F.col("node").alias(f"{x}_node"))
    edges = found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)
    edges = edges.join(at("a"), "a").join(at("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    every = of[DOC].select("id", "n", "doc").join(later, "doc", "left").select("id", "n", F.coalesce("rep", "doc").alias("rep"))
    twice = of[DOC].groupBy("id").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where("x <> y").select("id")
    shared = every.join(twice, "id").join(reps, "rep").select(F.col("id").alias("a"), F.col("node").alias("b"))
    named = connected_components(edges.union(shared))
    named = reps.join(named, "node", "left").select("rep", F.coalesce("component", "node").alias("component"))
    out = every.join(named, "rep").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return out.union(of[NO_ID].select(F.lit(None).cast("long"), "n", F.lit(None).cast("long")))
