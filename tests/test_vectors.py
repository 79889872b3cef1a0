"""Best matches against brute force, merged clusters, and sessions of one timeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.operators import rollup as U
from stowage.operators import similarity as S
from stowage.operators import vectors as V


def unit_rows(x):
    return [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("block", [4, 2048])
def test_best_match_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    rng = np.random.default_rng(1)
    middles = rng.normal(0, 1, (9, 20))
    x, y = (middles[rng.integers(0, 9, n)] + rng.normal(0, 0.5, (n, 20)) for n in (150, 70))
    rows, known = (spark.createDataFrame(unit_rows(v), "id long, v array<double>").repartition(3) for v in (x, np.concatenate([y, y[:3]])))
    sims = np.round(np.array([v for _, v in unit_rows(x)]) @ np.array([v for _, v in unit_rows(y)]).T, 6)
    for least in (0.8, -2.0):
        want = {(i, int(s.argmax()), s.max()) for i, s in enumerate(sims) if s.max() >= least}
        got = [tuple(r) for r in V.best_match(rows, known, least).collect()]
        assert len(got) == len(want) and {(a, b) for a, b, _ in got} == {(a, b) for a, b, _ in want}
    assert V.best_match(rows.limit(0), known, 0.0).count() == 0 and V.best_match(rows, known.limit(0), 0.0).count() == 0


def test_registries_that_are_sent_and_that_are_not(spark, monkeypatch):
    faces = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    people = S.people_vectors(faces)
    rows = lambda: {(r.vec_id, r.label, round(r.sim, 5)) for r in S.nearest_person(faces, people, 0.2).collect()}
    sent = rows()
    monkeypatch.setattr(S, "SENT", 0)
    assert rows() == sent and sent


@pytest.mark.parametrize("group", [40, 4096])
def test_merged_clusters_find_what_lies_apart(spark, group):
    rng = np.random.default_rng(3)
    middles = np.linalg.qr(rng.normal(0, 1, (24, 24)))[0][:15]
    owner = rng.integers(0, 15, 400)
    x = middles[owner] + rng.normal(0, 0.06, (400, 24))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, [0.0] * 24, 0), (901, None, 0)]
    faces = spark.createDataFrame(rows, "vec_id long, embedding array<double>, all int").repartition(5)
    got = V.merged_clusters(faces, 0.6, group).collect()
    first = {}
    for i, o in enumerate(owner):
        first.setdefault(o, i)
    assert {(r.vec_id, r.cluster) for r in got} == {(i, first[o]) for i, o in enumerate(owner)} and len(got) == 400
    ordered = {r.vec_id: r.cluster for r in S.greedy_clusters(faces, "all", 0.6).collect()}
    assert len({(ordered[r.vec_id], r.cluster) for r in got}) == len(first)
    assert V.merged_clusters(faces.where("vec_id >= 900"), 0.6, group).count() == 0


def test_merged_centroids_hold_every_vector(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame(unit_rows(rng.normal(0, 1, (300, 6))), "id long, v array<double>")
    made = V.merged_centroids(rows, 0.7, group=25).collect()
    assert sum(r.n for r in made) == 300 and len({r.id for r in made}) == len(made) < 150
    assert np.allclose(np.sum([r.total for r in made], 0), np.sum([r.v for r in rows.collect()], 0))
    again = V.merged_centroids(rows.repartition(7), 0.7, group=25).collect()
    assert {(r.id, r.n) for r in again} == {(r.id, r.n) for r in made}


def plain_sessions(rows, gap):
    out = []
    for t, i in sorted(rows):
        if not out or t - out[-1][-1][0] > gap:
            out.append([])
        out[-1].append((t, i))
    return [(len(s), s[0][0], s[-1][0], f"f{s[len(s) // 2][1]}") for s in out]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_one_timeline_over_many_ranges(spark, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        rng = np.random.default_rng(2)
        t = np.cumsum(rng.choice([0, 1, 2399, 2400, 2401, 9000], 700, p=[0.1, 0.5, 0.1, 0.1, 0.1, 0.1])) + 100
        rows = [(int(x), i) for i, x in enumerate(t)]
        captures = spark.createDataFrame([(i, f"f{i}", x, i % 2) for x, i in rows], "walk_seq long, rel_path string, s long, album int").withColumn("taken_at", F.timestamp_seconds("s")).repartition(6)
        got = U.timeline_sessions(captures).orderBy("session").collect()
        seen = lambda rows: [(r.n, int(r.start_at.timestamp()), int(r.end_at.timestamp()), r.rep) for r in rows]
        assert seen(got) == plain_sessions(rows, 2400) and [r.session for r in got] == list(range(len(got)))
        by = U.timeline_sessions(captures.withColumn("album", F.when(F.col("album") > 0, F.col("album"))), by=("album",)).orderBy("album", "session").collect()
        assert seen(by) == plain_sessions([r for r in rows if r[1] % 2 == 0], 2400) + plain_sessions([r for r in rows if r[1] % 2], 2400)
        assert by[0].session == 0 and by[0].suggested == got[0].suggested
        nulls = captures.withColumn("taken_at", F.lit(None).cast("timestamp"))
        assert [(r.n, r.rep) for r in U.timeline_sessions(nulls).collect()] == [(700, "f350")] and U.timeline_sessions(nulls.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
