"""The ten operators against brute force, exact round trips or held-out accuracy, with nulls, empty texts, ties, repeated rows, empty tables
and clashing extra columns."""

import hashlib
import html
import itertools
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stowage.llm import additive_quant as AQ
from stowage.llm import common as C
from stowage.llm import decontaminate as DC
from stowage.llm import html_text as H
from stowage.llm import lang_id as L
from stowage.llm import license_scan as LS
from stowage.llm import ngram_join as NJ
from stowage.llm import packing as PK
from stowage.llm import pii
from stowage.llm import queries as Q
from stowage.llm import token_counts as TC
from stowage.llm import toxicity as TX

SF = "/root/testdata/sf0.001"
lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"doc": F.lit(1), "key": F.lit("x")}).repartition(parts)


def brute_groups(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_rows(seed, n=260):
    rng = random.Random(seed)
    words = [*"abcdefg", *(f"x{i}" for i in range(30))]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 8, 12, 13, 25, 40, 80]))] for _ in range(30)]
    rows = []
    for k in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice("abcdefg")
        rows.append((k, " ".join(w)))
    return [*rows, (9000, None), (9001, ""), (9002, " \n")]


@pytest.mark.parametrize("n,percent,small", [(3, 90, 12), (1, 70, 2)])
def test_jaccard_against_brute_force(spark, monkeypatch, n, percent, small):
    monkeypatch.setattr(NJ, "SMALL", small)
    monkeypatch.setattr(NJ, "BLOCK", 5 if small == 2 else 256)
    monkeypatch.setattr(NJ, "SENT_DOCS", 5 if small == 2 else 10**6)
    rows = near_rows(n)
    got = {r[0]: (r[1], r[2]) for r in NJ.jaccard_components(docs_of(spark, rows), n, percent).collect()}
    assert got == brute_groups(rows, n, percent)


def test_jaccard_repeated_and_missing_ids(spark):
    rows = [(5, "q1 q2 q3 q4"), (5, "z1 z2 z3 z4 z5"), (3, "q1 q2 q3 q4"), (2, "z1 z2 z3 z4 z5"), (None, "a b")]
    got = Counter((r[0], r[2]) for r in NJ.jaccard_components(docs_of(spark, rows), 3, 90).collect())
    assert got == {(5, 2): 2, (3, 2): 1, (2, 2): 1, (None, None): 1}
    assert NJ.jaccard_components(docs_of(spark, rows).limit(0), 3, 90).count() == 0


def test_repeated_rows_near_a_half_similar_document(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    words = [f"w{i}" for i in range(300)]
    a, b = " ".join(words[:200]), " ".join(words[60:260])  # similarity about 0.54
    rows = [(1, a), (1, a), (1, a), (2, b), (2, b), (3, a), (7, "p q r s t u"), (7, "k l m n o p")]
    assert Counter(map(tuple, NJ.jaccard_components(docs_of(spark, rows), 3, 80).select("doc_id", "component_id").collect())) == {(1, 1): 3, (2, 2): 2, (3, 1): 1, (7, 7): 2}
    item = "b1 b2 b3 b4 b5 b6 b7 b8 b9 b10"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = docs_of(spark, [*rows, (None, a), (None, f"x {item} y"), (7, f"z {item}"), (None, "clean one")])
    one = pipeline.one_of_near_duplicates(spark, docs, str(tmp_path))
    left = pipeline.drop_contaminated(spark, C.stored(one, "one"), str(tmp_path)).select("doc_id", "text").collect()
    assert Counter(map(tuple, left)) == Counter([(1, a), (2, b), (7, "p q r s t u"), (7, "k l m n o p"), (None, "clean one")])


def test_first_holders_go_document_by_document():
    """Rows of one document stand together, so that what is equal in them takes next to nothing in the shuffle's files."""
    docs = pa.RecordBatch.from_pydict({"doc": [11, 12, 13], "id": [1, 2, 3], "text": [" ".join(f"{d}w{i}" for i in range(400)) for d in "abc"]})
    rows = pa.Table.from_batches(list(NJ._postings(5, 80)(iter([docs])))).to_pandas()
    first = rows[rows["kind"] == NJ.KEY]["doc"].to_numpy()
    assert set(first) == {11, 12, 13} and (np.diff(first) != 0).sum() == 2


def test_only_documents_that_take_part_are_held_against_others(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long")
    roles = {r.doc: (sorted(r.leads), r.leading) for r in NJ._roles(pairs).collect()}
    assert roles == {1: ([], True), 2: ([1], True), 3: ([1, 2], False)}
    grams = [np.arange(k, 200 + k, dtype=np.uint64).tobytes() for k in range(4)]
    rows = [(d, *roles.get(d, (None, None)), 0, 200, bytearray(grams[d - 1])) for d in (1, 2, 3, 4)]
    ranges = spark.createDataFrame(rows, NJ._RANGE)
    assert {tuple(r) for r in NJ._verified(ranges, 98).collect()} == {(1, 2), (2, 3), (1, 3)}
    assert {tuple(r) for r in NJ._verified(ranges, 99).collect()} == {(1, 2), (2, 3)}


def test_fragments_of_linked_sets_meet():
    rng = np.random.default_rng(1)
    bands = NJ.size_bands(90)
    for n in (10, 11, 19, 40, 200, 900):
        for _ in range(60):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            most = n * 10 // 190  # this many replaced keeps the similarity at 0.9
            b = np.unique(np.concatenate([a[most:], rng.integers(0, 2**63, most).astype(np.uint64)]))
            assert set(NJ.fragment_keys(a, 90, bands)) & set(NJ.fragment_keys(b, 90, bands))


def brute_hits(rows, items, width):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = word.findall(lower(t))
        for k in range(max(1, len(w) - width + 1)) if w else []:
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = word.findall(lower(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= ids
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(1)
    some = ["a", "b", "c", "é1", "Dd"]
    items = [(i, " ".join(rng.choice(some) for _ in range(rng.choice([0, 1, 2, 3, 5])))) for i in range(12)] + [(50, None), (3, "b b a")]
    rows = [(i, rng.choice([" ", ". "]).join(rng.choice([*some, "z", "q"]) for _ in range(rng.choice([0, 1, 2, 5, 9, 30])))) for i in range(200)] + [(1, None), (1, "a"), (7, "")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("slot", F.lit(1))
    got = DC.contamination(docs_of(spark, rows), bench, 3)
    assert sorted(map(tuple, got.collect()), key=str) == brute_hits(rows, items, 3)
    assert DC.contamination(docs_of(spark, rows), bench.limit(0), 3).where("contaminated").count() == 0


def test_decontamination_terms_that_only_other_blocks_have(spark):
    # each partition is a block: the first lacks 5 and common, which the second has often
    items = [(1, "1 2 3 4 5 6 7 8 9 10"), (2, "common rare"), (3, "rare common")]
    first = [(1, "1 2 3 4 X 6 7 8 9 10"), (2, "Y rare"), (3, "rare Y"), (4, "1 2 3 4"), (5, "Y Y rare")]
    second = [(6, "5 5 5 common common common common common common common common"), (7, "1 2 3 4 5 6 7 8 9 10"), (8, "a common rare b"), (9, "rare common"), (10, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(spark.sparkContext.parallelize(first + second, 2), "doc_id long, text string")
    got = DC.contamination(docs, bench, 10)
    assert sorted(map(tuple, got.collect()), key=str) == brute_hits(first + second, items, 10)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 6])))) for i in range(60)]
    rows = [(i, " ".join(rng.choices([*words, "z"], k=rng.choice([1, 2, 4, 9])))) for i in range(300)]
    got = DC.contamination(docs_of(spark, rows, 40), spark.createDataFrame(items, "item_id long, text string"), 3)
    assert sorted(map(tuple, got.collect()), key=str) == brute_hits(rows, items, 3)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x a y b z c"), (2, "c b a"), (3, "a q q q q b c")], "doc_id long, text string").coalesce(1)
    windows = DC.item_windows(spark.createDataFrame([(9, "a b c")], "item_id long, text string"), 10)
    index = DC.build_index(docs, np.sort(C.word_hashes(["a b c"], C.ALNUM_WORDS)[0].view(np.int64)))
    assert sorted(r.slot for r in DC.search(index, windows, 2).collect()) == [0, 1]
    assert DC.search(index, windows).count() == 0


@pytest.mark.parametrize("capacity,group", [(4096, 50_000), (600, 50)])
def test_packing(spark, monkeypatch, capacity, group):
    monkeypatch.setattr(PK, "GROUP_PIECES", group)
    path = public_tokenizers.path("word_bpe_49k.json")
    odd = [(5000, None), (5001, ""), (5002, "A  b\t\n <|endoftext|>x y é é z ́z ΑΣ ΣΑΣ. it's 12ab Éa,,"), (1, "dup"), (None, "no id")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    tokenizer, want, got, bins = Tokenizer.from_file(path), Counter(), Counter(), {}
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.update((r.doc_id, k, at, len(p := np.array(ids[at : at + capacity], "<u4")), zlib.crc32(p.tobytes())) for k, at in enumerate(range(0, len(ids), capacity)))
    rows = PK.best_fit_packing(docs, path, capacity).collect()
    for r in rows:
        got[tuple(r)[:5]] += 1
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *itertools.accumulate(n for _, n in parts)][:-1] and sum(n for _, n in parts) <= capacity
    assert len(bins) <= 1.06 * sum(r.length for r in rows) / capacity + 1


def test_lower_bound_holds():
    rng = random.Random(2)
    for _ in range(200):
        lengths = np.array([rng.randrange(1, 13) for _ in range(rng.randrange(1, 7))])
        best = len(lengths)
        # the exact bin count, by filling bins one after another over all orders
        for order in itertools.permutations(lengths.tolist()):
            used, room = 0, 0
            for n in order:
                used, room = (used + 1, 12 - n) if n > room else (used, room - n)
            best = min(best, used)
        assert PK.lower_bound(lengths, 12) <= best <= PK.best_fit(lengths, 12)[2]


def test_token_counts_against_longest_match(spark):
    for words, start in (([b"a", b"b", b"ab", b"abc", b"bcd", b" ", b" a", b" abx", b"abcdx", b"d"], b" "), ([b"ab", b"b", b"bca"], b"")):
        known, rng = set(words), random.Random(3)

        def plain(w, known=known, start=start):
            s, n = start + w.encode(), 0
            while s:
                k = next((k for k in range(len(s), 0, -1) if s[:k] in known), 0)
                if not k:
                    return 1, 1
                s, n = s[k:], n + 1
            return n, 0

        auto = TC.LongestMatch(words, start)
        for w in ("".join(rng.choice("abcdx") for _ in range(rng.randrange(1, 9))) for _ in range(2000)):
            assert auto.count(w) == plain(w)
    rows = [(1, "ab  abc\tzz"), (2, None), (2, " \n")]
    got = {tuple(r) for r in TC.token_counts(docs_of(spark, rows), [bytes([b]) for b in range(256)]).collect()}
    assert got == {(1, 3, 3 + 4 + 3, 0), (2, 0, 0, 0)}


def test_nearest_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    odd = spark.sql("SELECT * FROM VALUES (100000L, CAST(NULL AS ARRAY<FLOAT>), 1), (100100L, array_repeat(CAST(0 AS FLOAT), 64), 1), (100200L, array_repeat(CAST('NaN' AS FLOAT), 64), 1) AS t(vec_id, embedding, label)")
    got, e = {}, rows.toPandas()
    for r in Q.nearest(rows.union(odd), rows.union(odd).where("vec_id % 100 = 0"), 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids, x = e.vec_id.to_numpy(), np.stack(e.embedding.to_numpy()).astype(float)
    hit = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        own = sorted(got[ids[i]])
        assert [o[0] for o in own] == list(range(1, 11)) and all(abs(s - d[ids == v][0]) < 1e-12 for _, v, s in own)
        hit += len({v for _, v, _ in own} & set(ids[np.lexsort((ids, d))[:10]]))
    assert len(got) == (ids % 100 == 0).sum() and hit >= 0.9 * 10 * len(got)
    assert AQ.nearest(rows.limit(0), rows.limit(0)).count() == 0


def test_page_text(spark):
    page = '<html><head><title>t</title></head><body><div class="cookie-notice">We</div><nav>m</nav><article><h1>One &amp; <b>two</b></h1><p>a\n b<p class="ad">Buy<p>c<br>d<aside>s</aside></article><section id="comments"><article>me</article></section><footer>f</footer>'
    bare = "<body><div>Site</div><div>Page {}</div><p>text {}</p><div>Imprint</div>"
    rows = [(1, "http://a.b/x", page), (2, "http://a.b/y", None), (3, "http://h.c/d/1", bare.format(1, 1)), (4, "http://h.c/d/2", bare.format(2, 2)), (4, "http://h.c/d/2", bare.format(2, 2)), (5, None, bare.format(5, 5)), (6, "http://h.c/e", "")]
    got = Counter((r.page_id, r.text, r.n_chars) for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    two = "Page {0}\n\ntext {0}"
    alone = "Site\n\nPage 5\n\ntext 5\n\nImprint"
    assert got == {(1, "One & two\n\na b\n\nc d", 19): 1, (2, "", 0): 1, (3, two.format(1), 14): 1, (4, two.format(2), 14): 2, (5, alone, len(alone)): 1, (6, "", 0): 1}
    tags = re.compile(r"</?(?:p|h1)[^>]*>")
    for r in duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet'").fetchall():
        main = re.search(r"<article>(.*?)(?:</article>|<footer)", r[0], re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in tags.split(main)]
        assert [t for t, inside in H.blocks(r[0]) if inside] == [w for w in want if w]


def test_pages_with_an_article_are_differenced_too(spark):
    """The site's unmarked lines outweigh the article until they are deleted; the passage that both articles hold comes back."""
    page = "<body><div>{}</div><p>no. {}</p><article><h1>Title {}</h1><p>A passage of both</p></article></body>"
    rows = [(i, f"http://h.c/d/{i}", page.format("The site says this on each page. " * 20, i, i)) for i in (1, 2)]
    got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i}\n\nA passage of both" for i in (1, 2)}


def test_neighbours_over_several_ranges(spark):
    n = 60_000  # over 10 MB
    lines = F.array(F.col("id"), *(F.xxhash64("id", F.lit(k)) for k in range(24)))
    pages = spark.range(n, numPartitions=8).select(F.lit("h").alias("host"), F.format_string("/p/%06d", "id").alias("path"), F.col("id").alias("digest"), lines.alias("lines"))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = H.neighbours(pages).select(F.substring("path", 4, 6).cast("long").alias("id"), F.get("near", F.lit(0)).alias("near"))
        want = F.when(F.col("id") == 0, 1).otherwise(F.col("id") - 1)
        assert got.agg(F.count("*"), F.count_if(F.col("near") == want)).first() == (n, n)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_lcs(monkeypatch):
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert len(a) - len(H.unshared(a, b)) == t[-1][-1]
        monkeypatch.setattr(H, "CELLS", 6)
        assert len(a) - len(H.unshared(a, b)) == t[-1][-1]
        monkeypatch.undo()
    both = list(range(0, 40_000, 2)) + list(range(7))
    assert H.unshared(list(range(20_000)), both) == [i for i in range(20_000) if i % 2]


def test_page_text_of_teasers_and_telling_names(spark):
    """An article in an unmarked part beside teasers that are marked, thin articles, and names that only hold a word of menus or adverts."""
    site = '<body><div>Our site</div><div id="content"><h1>Head {0}</h1><p>Long true text of page {0}, which is all of it.</p></div>'
    cards = "<article>More one</article><article>More two</article><div>Imprint</div>"
    thin = "<main>More one</main><div>Imprint</div>"
    named = '<article><p class="ad-free">No adverts</p><p class="notice-of-meeting">We meet</p><p class="social-history">Of towns</p><p id="sharecropping">Land</p>'
    named += '<div class="cookie-banner">Ok?</div><div class="relatedPosts">More</div><div id="comments-list">Me</div><div class="x ad">Buy</div></article>'
    rows = [(k, f"http://s.t/{'thin' if k > 3 else 'cards'}/{k}", site.format(k) + (thin if k > 3 else cards)) for k in range(1, 7)] + [(9, "http://n.o/", named)]
    got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Head {k}\n\nLong true text of page {k}, which is all of it." for k in range(1, 7)} | {9: "No adverts\n\nWe meet\n\nOf towns\n\nLand"}


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, "12 !?"), (-3, "")], "doc_id long, text string")
    held = F.expr(TX.held_out_sql("doc_id", 4, 2))
    got = L.predict(docs.select("doc_id", "text").union(odd), docs.where(~held)).join(docs.select("doc_id", "lang", held.alias("held")), "doc_id", "left").collect()
    assert {r.lang_pred for r in got if r.doc_id < 0} == {"und"} and all(0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.held]
    assert sum(r.lang == r.lang_pred for r in test) >= 0.97 * len(test)
    assert {r.lang_pred for r in L.predict(docs.limit(5), docs.limit(0)).collect()} == {"und"}


def test_license_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(map(tuple, Q.op7_license_scan(spark, SF).collect()), key=str) == sorted(con.execute(Q.ORACLE["op7_license_scan"]).fetchall(), key=str)
    rows = [(1, "x\nReleased under the MIT license"), (2, None), (3, "")]
    assert {tuple(r) for r in Q.license_scan(docs_of(spark, rows)).collect()} == {(1, "MIT", 1.0, 1), (2, None, 0.0, 0), (3, None, 0.0, 0)}
    whole = {name: text for name, text in LS.TEMPLATES if len(text) > 500}
    wrapped = lambda t, n=9: "\n# ".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    rows = [(i, f"#!/bin/x\nCopyright someone\n\n# {wrapped(t)}\n\ncode = 1\n" + "more code here\n" * 200) for i, t in enumerate(whole.values())]
    rows += [(90, "It is a long paragraph. This file is Released under the MIT License. And it goes on and on."), (91, "permission is " * 50), (92, "mit"), (92, "mit")]
    got = {r.doc_id: r.license_id for r in Q.license_scan(docs_of(spark, rows)).collect()}
    assert {i: got[i] for i in range(len(whole))} == dict(enumerate(whole)) and got[90] == "MIT" and got[91] is None
    assert Q.license_scan(docs_of(spark, rows).limit(0)).count() == 0


def test_pseudonyms(spark):
    key = b"k"
    assert len({tuple(pii.permute(list(x), [3, 4, 5], key, "t")) for x in itertools.product(range(3), range(4), range(5))}) == 60
    text = "a b@c.org 4111 1111 1111 1111 DE89 3704 0044 0532 0130 00, 2024-02-30 2024-02-29 078-05-1120 +1 (337) 555-7349 10.0.0.1 300.1.1.1 1234567890123456"
    new, counts = pii.pseudonymise(text, key)
    assert counts == {"email": 1, "iban": 1, "ip": 1, "date": 1, "ssn": 1, "phone": 1, "card": 1}
    assert "2024-02-30" in new and "1234567890123456" in new and pii.luhn(re.sub(r"\D", "", re.search(r"\d{4} \d{4} \d{4} \d{4} D", new).group())) == 0
    assert pii.pseudonymise(f"x {text} y", key)[0] == f"x {new} y"
    rows = [(1, text), (2, None), (3, "plain 12"), (3, "plain 12")]
    out = pii.pseudonyms(docs_of(spark, rows).withColumn("n_card", F.lit(7)), key)
    assert Counter((r.doc_id, r.text, r.n_card, r.pii_n_card) for r in out.collect()) == {(1, new, 7, 1): 1, (2, None, 7, 0): 1, (3, "plain 12", 7, 0): 2}


def test_pseudonyms_beside_other_text():
    key = b"k"
    for kind, value, texts in (
        ("card", "4111 1111 1111 1111", ["{} 05/27", "{} 123", "12 {}", "12 34 {} 05/27", "12-{}-77", "1.50 {}", "+1 337 555 7349 {}", "{} 05-27-2024"]),
        ("card", "4111111111111111", ["{} 123", "12 {}", "12 {} 123", "{} 12345", "9 8 7 6 5 4 3 {}"]),
        ("card", "4111-1111-1111-1111", ["{}-123456", "{} 05"]),
        ("iban", "BE68 5390 0754 7034", ["{} OK", "{} FROM THEM", "XY34 {}", "{} 12"]),
        ("phone", "+44 20 7946 0958", ["{} 2021", "{} 4111 1111 1111 1111"]),
        ("ip", "8.8.8.8", ["{}", "at {}"]),
    ):
        alone = pii.pseudonymise(value, key)[0]
        assert alone != value
        for text in texts:
            new, counts = pii.pseudonymise(text.format(value), key)
            assert counts.get(kind) == 1 and alone in new, (text, new)
    both = "4111 1111 1111 1111 5500 0000 0000 0004"
    assert pii.pseudonymise(both, key)[1] == {"card": 2}
    assert pii.pseudonymise("4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", key)[1] == {"card": 1}
    for plain in ("1 2 3 4 5 6 7 8 9 10 11 12 13 14", "1234567890123456 12", "v1.2 7."):
        assert pii.pseudonymise(plain, key) == (plain, {})


def test_toxicity_scores_every_row(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = docs.limit(2).withColumns({"doc_id": F.col("doc_id") - 5000, "text": F.when(F.col("doc_id") % 2 == 0, F.lit(""))})
    got = TX.toxicity(docs.union(odd).withColumn("_score", F.lit(9)), labels)
    assert got.columns == [*docs.columns, "_score", "toxic_score", "toxic_predicted"] and got.where("toxic_score is null or toxic_score < 0 or toxic_score > 1").count() == 0
    assert TX.toxicity(docs.limit(3), labels.limit(0)).where("toxic_predicted = 1").count() == 0


def test_toxicity_held_out(spark):
    """Only rows that the model hasn't learned from, as they are and with words misspelled in ways that no row shows."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    held = labels.where(F.expr(TX.held_out_sql("doc_id", 5, 0)) & F.col("toxic").isNotNull()).join(docs, "doc_id")
    value, bias = TX.fit_on(docs, labels)
    rows = held.select("toxic", "text").collect()
    score = lambda texts: np.concatenate([TX.Words([t]).log_odds(value, bias) for t in texts])
    good, bad = (score([r.text for r in rows if r.toxic == y]) for y in (0, 1))
    assert (good >= 0).mean() < 0.01 and (bad >= 0).mean() > 0.85 and np.mean(bad[:, None] > good[None, :]) > 0.95
    words = re.compile(r"\b(pathetic|worthless|disgusting)\b", re.I)
    told = [r.text for r in rows if r.toxic == 1 and len(words.findall(r.text or "")) > 1]
    spelled = score([words.sub(lambda m: m[0][:-1] + m[0][-2:], t) for t in told])  # the last letter twice: patheticc
    assert len(told) >= 10 and (spelled >= 0).mean() > 0.8
    clean = [r.text for r in rows if r.toxic == 0 and r.text]
    assert (score([f"{t} patheticc worthlesss disgustingg" for t in clean]) > score(clean)).mean() > 0.95


def test_pipeline_keeps_columns(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in pipeline.STAGES:
        before, docs = docs, C.stored(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == before.columns and 0 < docs.count() <= n
            n = docs.count()
    assert docs.select("doc_id").distinct().count() == n
    assert Path(pipeline.__file__).name == "corpus_pipeline.py"


def plain_words(text):
    """{word: occurrences} by definition: blank-separated runs of the lower-cased text without signs that aren't letters or digits."""
    runs = ("".join(c for c in r if c.isalnum()) for r in (text or "").lower().split())
    return Counter(r for r in runs if r)


def test_toxicity_score_by_definition(spark):
    factor = [int(f) for f in TX._FACTORS]
    low = (1 << 64) - 1
    mixed = lambda x: int(C.mix1(x & low))

    def buckets(word):
        s = [0, *map(ord, word), 0]
        name = mixed(sum(c * (mixed(i + 977) | 1) for i, c in enumerate(s[1:-1])))
        grams = [sum(c * f for c, f in zip(s[i : i + 3], factor, strict=False)) for i in range(len(s) - 2)]
        grams += [sum(c * f for c, f in zip(s[i : i + 4], factor[3:], strict=False)) for i in range(len(s) - 3)] + [name * factor[7]]
        return [((g & low) * factor[8] & low) >> (64 - TX.BUCKET_BITS) for g in grams]

    value, bias = np.random.default_rng(1).normal(0, 9, TX.BUCKETS).astype(np.float32), -0.7
    rng = random.Random(8)
    texts = [None, "", " . ", "Id.i-o_t idiot, IDIOT x", "a", "\u4f60" * 100 + " \U0001d400z", "y" * 5000, "one two one two " * 900, "\ud800 lone"]
    texts += [" ".join("".join(rng.choice("abé.Z0") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(40))) for _ in range(50)]
    want = []
    for t in texts:
        weight = {w: n**TX.DAMP * (1 + (len(w) - 1) // TX.RUN) for w, n in plain_words(t).items()}
        want.append(bias + sum(x * np.mean([float(value[b]) for b in buckets(w)]) for w, x in weight.items()) / (TX.PAD + sum(weight.values())))
    words = TX.Words(texts)
    assert np.allclose(words.log_odds(value, bias), want, rtol=1e-9, atol=1e-9)
    for (at, share), w in zip(words.features(), want, strict=True):  # what the fit sees is the same text
        assert abs(float((value[at].astype(float) * share).sum()) + bias - w) < 1e-3
    assert np.array_equal(words.log_odds(value, bias), np.concatenate([TX.Words([t]).log_odds(value, bias) for t in texts]))


def test_toxicity_odd_tables(spark):
    docs = docs_of(spark, [(i, f"good calm text {i}" if i % 2 else f"you scum {i}") for i in range(40)] + [(None, "scum"), (1, None), (1, "scum"), (1, "scum")]).withColumn("toxic_score", F.lit("mine"))
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)] + [(None, 1), (3, None), (4, 7), (1, 1)], "doc_id long, toxic int")
    got = TX.toxicity(docs, labels)
    assert got.columns == [*docs.columns, "llm_toxic_score", "toxic_predicted"] and got.count() == 44
    scores = {(r.doc_id, r.text): r.llm_toxic_score for r in got.collect()}
    assert scores[(2, "you scum 2")] > scores[(3, "good calm text 3")] and {r.toxic_score for r in got.collect()} == {"mine"}
    assert TX.toxicity(docs.limit(0), labels).count() == 0 and TX.toxicity(docs, labels.limit(0)).where("toxic_predicted = 1").count() == 0


def test_neighbours_are_the_nearest_that_are_no_copies(spark):
    rng, rows = random.Random(4), []
    for host, kinds in (("a", 3), ("b", 1), ("c", 5), ("d", 2)):
        for i in range(120):
            rows.append((host, f"/{rng.randrange(3)}/{i:03d}", rng.randrange(kinds) if i % 50 < 10 else 0))
    pages = spark.createDataFrame([(h, p, d, [d, k]) for k, (h, p, d) in enumerate(rows)], "host string, path string, digest long, lines array<long>")
    lines = {(h, p, d): [d, k] for k, (h, p, d) in enumerate(rows)}
    want = {}
    for host in "abcd":
        own = sorted(x for x in lines if x[0] == host)
        for i, (_, path, digest) in enumerate(own):
            before = next((x for x in reversed(own[:i]) if x[2] != digest), None)
            after = next((x for x in own[i + 1 :] if x[2] != digest), None)

            def shared(x, path=path):
                return -1 if x is None else sum(1 for _ in itertools.takewhile(lambda ab: ab[0] == ab[1], zip(path.split("/"), x[1].split("/"), strict=False)))

            if before or after:
                want[(host, path, digest)] = lines[before if shared(before) >= shared(after) else after]
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("2", "40"):  # 40 ranges: some hold nothing but copies of one page
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert {(r.host, r.path, r.digest): r.near for r in H.neighbours(pages).collect()} == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_page_text_of_copies_hosts_and_empty_tables(spark):
    bare = "<body><div>Site</div><div>Page {0}</div><p>text {0} of the page which is long enough</p><p>more {0}</p><div>Imprint</div>"
    rows = [(i, f"http://h.c/d/{min(i, 3)}{'x' * (i < 3)}", bare.format(min(i, 3))) for i in range(1, 6)] + [(i, f"http://one.org/{i}", bare.format("same")) for i in (7, 8)] + [(9, "http://h.d/d/1", bare.format(9)), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("x"), "host": F.lit(1)})
    got = {r.page_id: r.text for r in H.main_text(pages).collect()}
    two = "Page {0}\n\ntext {0} of the page which is long enough\n\nmore {0}"
    assert {i: got[i] for i in range(1, 6)} == {i: two.format(min(i, 3)) for i in range(1, 6)}  # copies of page 3 have pages 1 and 2 as partners
    assert got[7] == got[8] == "Site\n\n" + two.format("same") + "\n\nImprint" and got[9].startswith("Site") and got[None] == ""
    assert H.main_text(pages.limit(0)).count() == 0


def plain_profile(texts, k):
    """[n-gram] of 1 to 3 letters by definition: most frequent first, ties by code points; a gap between words is a blank."""
    count = Counter()
    for t in texts:
        s = re.sub(" +", " ", "".join(c if c.isalpha() and not 0xD800 <= ord(c) < 0xE000 else " " for c in f" {t or ''} ".lower()))
        count.update(c for c in s if c != " ")
        count.update(s[i : i + 2] for i in range(len(s) - 1))
        count.update(s[i : i + 3] for i in range(len(s) - 2) if s[i + 1] != " ")
    return [g for g, _ in sorted(count.items(), key=lambda x: (-x[1], len(x[0]), [1 if c == " " else ord(c) for c in x[0]]))][:k]


@pytest.mark.parametrize("at_once", [1000, 2])
def test_language_by_definition(spark, monkeypatch, at_once):
    monkeypatch.setattr(L, "LANGUAGES_AT_ONCE", at_once)
    rng = random.Random(6)
    alphabets = {"a": "abcd", "b": "abxy", "c": "äßéø", "d": "abcd", "e": "wxyz"}
    train = [(i, lang, " ".join("".join(rng.choice(x) for _ in range(rng.randrange(1, 6))) for _ in range(9))) for i, (lang, x) in enumerate(sorted(alphabets.items()) * 4)]
    train += [(90, None, "zzz"), (91, "a", None), (92, "e", "")]
    docs = [(i, t) for i, _, t in train] + [(200 + i, "".join(rng.choice("abcdxyzäß .1") for _ in range(40))) for i in range(30)] + [(300, None), (301, ""), (302, "12 ."), (303, "x" * 50_000), (304, "\U0001d400 a")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(docs_of(spark, docs), spark.createDataFrame(train, "doc_id long, lang string, text string"), k=20).collect()}
    profiles = {lang: {g: i for i, g in enumerate(plain_profile([t for _, x, t in train if x == lang], 20))} for lang in alphabets}
    for i, t in docs:
        own = plain_profile([t], 20)
        if not own:
            assert got[i] == ("und", 0.0)
            continue
        far = {lang: sum(abs(p[g] - i) if g in p else 20 for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert got[i] == (best, pytest.approx(1 - far[best] / (20 * len(own)))), (t, far)


def test_dates_stay_apart_and_phones_stay_valid():
    key, seen = b"k", {}
    for d in range(1, 32):
        for m in range(1, 32):
            for y in ("2020", "2021"):
                s = f"{d:02d}/{m:02d}/{y}"
                if (new := pii.calendar_date(s, key)) is not None:
                    assert new not in seen and pii.calendar_date(new, key) is not None and pii._read_date(*new.split("/"))[0] == pii._read_date(*s.split("/"))[0]
                    seen[new] = s
                else:
                    assert d > 12 and m > 12 or d > 31 or not pii._read_date(f"{d:02d}", f"{m:02d}", y)[0]
    assert pii.calendar_date("31/12/1850", key) is None
    rng, new = random.Random(1), set()
    for _ in range(500):
        s = f"+1 ({rng.randrange(2, 10)}{rng.randrange(100):02d}) {rng.randrange(2, 10)}{rng.randrange(100):02d}-{rng.randrange(10000):04d}"
        out = pii.phone(s, key)
        assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", out)
        new.add(out)
    assert len(new) > 490
    assert re.fullmatch(r"\+44 [1-9]\d \d{4} \d{4}", pii.phone("+44 20 7946 0958", key))


def test_pseudonyms_of_long_texts_and_empty_tables(spark):
    import time

    text = " ".join(f"{1 + i % 28:02d}/{1 + i % 12:02d}/{1950 + i % 100}" for i in range(40_000))
    began = time.time()
    _, counts = pii.pseudonymise(text, b"k")
    assert counts == {"date": 40_000} and time.time() - began < 30
    assert pii.pseudonyms(docs_of(spark, [(1, "x")]).limit(0), b"k").count() == 0


def test_decontamination_with_more_terms_than_are_sent(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 6])))) for i in range(40)]
    rows = [(i, " ".join(rng.choices([*words, "z"], k=rng.choice([0, 1, 4, 60])))) for i in range(200)] + [(900, "z " * 200_000 + "w1 w2 w3")]
    monkeypatch.setattr(DC, "MOST_TERMS", 3)
    monkeypatch.setattr(DC, "WINDOWS_AT_ONCE", 20)
    got = DC.contamination(docs_of(spark, rows, 5), spark.createDataFrame(items, "item_id long, text string"), 3)
    assert sorted(map(tuple, got.collect()), key=str) == brute_hits(rows, items, 3)


def test_nearest_reranks_a_part_only(spark):
    """4000 vectors and 150 candidates, so that the codes decide; a tight group of copies and vectors of another length among them."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4000, 16))
    x[1000:1400] = x[5] + rng.normal(0, 0.02, (400, 16))
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, [1.0, 2.0]), (5100, None), (5200, [0.0] * 16), (5300, [1.0] * 15 + [float("inf")]), (5400, []), (None, [1.0] * 16), (7, x[7].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in AQ.nearest(df, df.where("vec_id % 100 = 0"), 10, rerank=150).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert sorted(got) == list(range(0, 4000, 100))
    hit = 0
    for i, found in got.items():
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hit += len(set(found) & set(np.lexsort((np.arange(4000), d))[:10].tolist()))
    assert hit >= 0.9 * 10 * len(got)


def test_empty_tables_and_long_texts(spark):
    none = docs_of(spark, [(1, "x")]).limit(0)
    path = public_tokenizers.path("word_bpe_49k.json")
    assert PK.best_fit_packing(none, path).count() == 0
    assert TC.token_counts(none, [b"a"]).count() == 0
    assert DC.contamination(none, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    assert L.predict(none, spark.createDataFrame([("a", "x y")], "lang string, text string")).count() == 0
    long = "lorem ipsum dolor " * 100_000
    rows = PK.best_fit_packing(docs_of(spark, [(1, long)]), path).collect()
    assert sum(r.length for r in rows) == len(Tokenizer.from_file(path).encode(long, add_special_tokens=False).ids) + 1
    assert TC.token_counts(docs_of(spark, [(1, long)]), TC.byte_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))).first().n_words == 300_000
    assert [tuple(r) for r in NJ.jaccard_components(docs_of(spark, [(1, long), (2, long + "x")]), 3, 90).orderBy("doc_id").collect()] == [(1, 3, 1), (2, 4, 2)]


def test_pipeline_stages_with_nulls_repeats_and_no_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    columns = "doc_id long, text string, lang string, source string, n_chars long, toxic_score string, component_id string, _row_key string"
    card = "4111 1111 1111 1111"
    rows = [(i, f"calm words here number {i} and so on" if i % 2 else f"you total scum idiot {i}", "en", "s", 5, "t", "c", "k") for i in range(40)]
    rows += [(None, None, None, None, None, None, None, None), (None, "calm", None, None, 1, None, None, None), (41, "", "", "", 0, "", "", ""), (43, f"calm {card}", "en", "s", 9, "t", "c", "k"), (45, "calm", "x", "y", 4, "t", "c", "k"), (45, "calm", "x", "y", 4, "t", "c", "k")]
    docs = spark.createDataFrame(rows, columns)
    spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b", "calm words here number 3 and so on")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    kept = pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {1, 3, 41, 43, 45} <= {r.doc_id for r in kept.collect()}
    one = pipeline.one_of_near_duplicates(spark, docs, str(tmp_path))
    assert Counter(r.text for r in one.collect())["calm"] == 1 and one.where("text is null").count() == 1 and one.where("text = 'calm'").first().doc_id == 45
    clean = pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert clean.count() == docs.count() - 1 and clean.where("doc_id = 3").count() == 0
    private = pipeline.without_personal_data(spark, docs, str(tmp_path))
    assert private.where(F.col("text").contains(card)).count() == 0 and private.count() == docs.count() and private.where("text is null").first().n_chars is None
    assert pipeline.packed(spark, docs, str(tmp_path)).count() == docs.count()
