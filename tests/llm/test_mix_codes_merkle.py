"""Operators 11 to 13 against SQL over the given tables, brute force on small ones, and odd rows."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.llm import common as C
from stowage.llm import merkle as M
from stowage.llm import queries as Q
from stowage.llm import source_mix as X
from stowage.llm import vector_codes as V

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["op11_source_mix", "op12_vector_codes", "op13_merkle_manifest"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    found = con.execute(Q.ORACLE[name])
    names = [c[0] for c in found.description]
    got = Q.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(names).collect()), key=str) == sorted(found.fetchall(), key=str)


def written(spark, tmp_path, rows, name="documents", schema=DOCS):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def odd_docs(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = rng.choice([None, "", " \t\n", "\n".join("wörd" for _ in range(rng.randint(1, 90))), "one two\x0bthree\n", "a\xa0b c\n\n"])
        rows.append((i, text, rng.choice([None, "en", "xx"]), rng.choice([None, "", "a", "a", "a", "a", "ß", "b\x00", "c"]), rng.choice([None, -1, 7])))
    return [*rows, *rows[:9], (None, "x\n", None, "a", None), (None, None, None, None, None), (None, None, None, None, None)]


def level_targets(sizes, weights, most=3):
    """By definition: share, hold what is above, share what is left over, until none is above."""
    target, free = dict.fromkeys(sizes, 0.0), set(sizes)
    left = float(sum(sizes.values()))
    while free:
        each = left / sum(weights[s] for s in free)
        over = {s for s in free if each * weights[s] > most * sizes[s] + 1e-9}
        for s in over or free:
            target[s] = float(most * sizes[s]) if over else each * weights[s]
        left -= sum(target[s] for s in over)
        free -= over or free
    return target


def test_mix_targets_and_copies(spark, tmp_path):
    rows = odd_docs(300)
    got = Q.op11_source_mix(spark, written(spark, tmp_path, rows)).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = level_targets(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    source = {r[0]: r[3] for r in rows if r[0] is not None}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        if r.doc_id is not None:
            s = source[r.doc_id]
            assert r.size == size(rows[r.doc_id][1]) and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
            taken[s] += r.taken
            rate = want[s] / sizes[s] if sizes[s] else 0
            assert not r.size or int(rate + 1e-9) <= r.taken // r.size <= int(rate) + 1
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(90, 0.02 * want[s]), s
    again = Q.op11_source_mix(spark, str(tmp_path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_holds_small_sources_in_turn(spark):
    sizes = {"a": 10, "b": 1000, "c": 4, "d": 100, "e": 0}
    table = C.stored(spark.createDataFrame([(g, s, i % 3 + 1) for i, (g, s) in enumerate(sizes.items())], "g string, source_size long, weight long"), "w")
    got = {r.g: r.target for r in X.targets(table, 3).collect()}
    assert got == pytest.approx(level_targets(sizes, {g: i % 3 + 1 for i, g in enumerate(sizes)})) and sum(got.values()) == pytest.approx(1114)


def test_mix_emits_documents(spark, tmp_path):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), "en", f"s{i % 3}", 0, i) for i in range(90)], DOCS + ", g int").withColumn("u", F.lit("kept"))
    plan = C.stored(X.mix_plan(docs), "plan")
    out = X.mixed(docs, plan)
    assert out.columns == [*docs.columns, "copy"]
    assert out.groupBy("doc_id").count().exceptAll(plan.where("copies > 0").select("id", F.col("copies").cast("long"))).isEmpty()
    assert out.count() == plan.agg(F.sum("copies")).first()[0] and out.where("copy > 2 or u <> 'kept'").isEmpty()


def test_empty_tables(spark, tmp_path):
    sf = written(spark, tmp_path, [])
    written(spark, tmp_path, [(1, None, None)], "embeddings", "vec_id long, embedding array<float>, label int")
    for q in (Q.op11_source_mix, Q.op12_vector_codes, Q.op13_merkle_manifest):
        assert q(spark, sf).count() == 0
    some = written(spark, tmp_path / "b", [(1, None, None, None, None), (2, "", "x", None, 0)])
    assert [(r.size, r.taken) for r in Q.op11_source_mix(spark, some).collect()] == [(0, 0), (0, 0)]


def plain_codes(vectors, parts=16, entries=64, rounds=2):
    kept = sorted((v for v in vectors if v[1] is not None and all(c is not None and np.isfinite(c) for c in v[1])), key=lambda v: (v[0] is None, v[0] or 0, [int(np.floor(256 * c)) for c in v[1]]))
    x = np.array([[int(np.floor(256 * float(c))) for c in v[1]] for v in kept], np.int64).reshape(len(kept), parts, -1)
    books = x[:entries].copy()
    for turn in range(rounds + 1):
        gaps = ((x[:, None] - books[None]) ** 2).sum(3)
        own = gaps.argmin(1)
        if turn < rounds:
            for p in range(parts):
                for e in range(len(books)):
                    if (own[:, p] == e).any():
                        books[e, p] = x[own[:, p] == e, p].sum(0) // (own[:, p] == e).sum()
    error = gaps.min(1).sum(1)
    digest = hashlib.sha256(",".join(map(str, books.transpose(1, 0, 2).ravel().tolist())).encode()).hexdigest()
    label = {}
    for v, e in zip(kept, error, strict=True):
        label[v[2]] = label.get(v[2], 0) + int(e)
    return [(v[0], bytes(o.astype(np.uint8)).hex(), int(e), label[v[2]], digest) for v, o, e in zip(kept, own, error, strict=True)]


@pytest.mark.parametrize("n,dim", [(400, 32), (40, 16), (1, 16), (2, 48)])
def test_codes_by_definition(spark, tmp_path, n, dim):
    rng = np.random.default_rng(n)
    centres = rng.normal(0, 1, (20, dim))
    rows = [(int(i), (centres[i % 20] + rng.normal(0, 0.1, dim)).astype(np.float32).tolist(), [None, 1, 2][i % 3]) for i in range(n)]
    rows += [*rows[:3], (None, rows[0][1], 5), (n + 1, [0.0] * dim, None), (n + 2, [None] * dim, 1), (n + 3, [float("nan")] * dim, 1), (n + 4, [float("-inf")] * dim, 1), (n + 5, None, 1)]
    sf = written(spark, tmp_path, rows, "embeddings", "vec_id long, embedding array<float>, label int")
    got = Q.op12_vector_codes(spark, sf).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_codes(rows), key=str)


def test_codes_of_clashing_columns_and_odd_lengths(spark):
    rows = [(i, [float(i % 5), float(i % 7)], i % 2, "a", b"b", i) for i in range(30)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string, own binary, of int")
    found, books = V.compress(vectors.union(vectors.limit(1).withColumn("embedding", F.array(F.lit(1.0)))), parts=2, entries=4)
    assert found.columns == ["id", "label", "code", "error", "label_error"] and found.count() == 30 and len(books) == 2 and len(books[0]) == 4
    with pytest.raises(Exception, match="too large"):
        V.compress(vectors.withColumn("embedding", F.array(F.lit(1e30), F.lit(-1e30))), parts=2)[0].collect()


@pytest.mark.parametrize("b", [1, 2, 5, 8])
def test_bounds_certify_what_a_full_look_finds(b):
    rng = np.random.default_rng(b)
    for spread in (3, 40, 4000):
        x, book = rng.integers(-spread, spread, (500, 3)), rng.integers(-spread, spread, (24, 3))
        own, _, near, lower, outer = V.look_at_all(x, book, 8)
        pack = lambda v: V._unpacked(V._packed(v))
        for turn in range(4):
            fresh = book + rng.integers(-2, 3, book.shape) * (rng.random((24, 1)) < 0.5)
            moved = np.nextafter(np.sqrt(((fresh - book) ** 2).sum(1).astype(float)), np.inf)
            book = fresh
            own, gap, near, lower, outer, used = V.look_again(x, book, moved, own, near, pack(lower), pack(outer), min(b, near.shape[1]))
            want = V.look_at_all(x, book, 1)
            assert (own == want[0]).all() and (gap == want[1]).all()
            true = V.squared(x, book)
            assert (pack(lower) ** 2 <= np.take_along_axis(true, near, 1) + 1e-6).all()
            rest = np.ones_like(true, bool)
            np.put_along_axis(rest, near, False, 1)
            np.put_along_axis(rest, own[:, None], False, 1)
            assert (pack(outer) ** 2 <= np.where(rest, true, np.inf).min(1) + 1e-6).all()
            assert turn or spread < 40 or (used == 0).mean() > 0.3


def field(v):
    s = None if v is None else str(v)
    return "-" if s is None else f"{len(s.encode())}:{s}"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb_list(leaves):
    """(root, the siblings of each leaf, level by level as (left, right))."""
    level, at, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for k, i in enumerate(at):
            run = runs[i // 3]
            proofs[k].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        at, level = [i // 3 for i in at], [H(*r) for r in runs]
    return (level[0] if level else None), proofs


def plain_manifest(rows):
    leaf = lambda r, text: H(field(r[0]), field(r[3]), field(r[2]), field(r[4]), field(text))
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda t: t[:3])
        trees[s] = climb_list([t[2] for t in groups[s]])
    root, ways = climb_list([trees[s][0] for s in names])
    out = []
    for s, way in zip(names, ways, strict=True):
        for (_, _, h, r), proof in zip(groups[s], trees[s][1], strict=True):
            fold = h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None:
                fold = leaf(r, r[1].replace("\n", ""))
            for left, right in [*proof, *way]:
                fold = H(left, fold, right)
            out.append((r[0], h, trees[s][0], root, H(*(a + b for a, b in [*proof, *way])), fold, fold == root))
    return out


@pytest.mark.parametrize("n,levels", [(0, 7), (1, 7), (30, 7), (420, 2), (420, 1), (2300, 7)])
def test_merkle_by_definition(spark, tmp_path, monkeypatch, n, levels):
    monkeypatch.setattr(M, "LEVELS", levels)
    rows = odd_docs(n, seed=n)
    got = Q.op13_merkle_manifest(spark, written(spark, tmp_path, rows)).collect()
    want = plain_manifest(rows)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert n < 30 or {r.verified for r in got} == {True, False}


def test_merkle_keeps_other_columns(spark):
    leaves = spark.createDataFrame([(i, f"s{i % 2}", f"{i:064x}", "kept", i, i) for i in range(9)], "doc_id long, source string, h string, path2 string, g int, idx int")
    got = M.manifest(leaves, "h", "source", ["doc_id"])
    assert got.columns == [*leaves.columns, "subroot", "root", "path"] and got.select(leaves.columns).exceptAll(leaves).isEmpty()
    assert got.where(M.folded(F.col("h"), F.col("path")) != F.col("root")).isEmpty()
