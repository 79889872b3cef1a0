"""The cache of metrics: what is computed in each pass, what survives a lost pass, and which buckets are written."""

import os

import pytest
from pyspark.sql import functions as F

from stowage.streaming import metric_cache as C


def files_of(spark, rows):
    return spark.createDataFrame(rows, "rel_path string, size long, mtime_epoch long")


class Compute:
    """Metrics that tell what they were asked for."""

    def __init__(self):
        self.asked = []

    def __call__(self, df):
        self.asked.append(sorted(r.rel_path for r in df.collect()))
        return df.select("rel_path", (F.col("size") * 2).alias("focus"), F.col("rel_path").startswith("bad").alias("unreadable"))


def focus(df):
    return {r.rel_path: r.focus for r in df.collect()}


def test_only_misses_are_computed(spark, tmp_path):
    path, go = str(tmp_path / "cache"), Compute()
    rows = [(f"f{i}", i, 100) for i in range(30)] + [("bad", 5, 100)]
    good = {p: s * 2 for p, s, _ in rows if p != "bad"}
    assert focus(C.metrics_of(files_of(spark, rows), path, go)) == good
    assert focus(C.metrics_of(files_of(spark, rows), path, go)) == good
    assert len(go.asked[0]) == 31 and go.asked[1] == ["bad"]
    changed = [("f1", 77, 100), ("f2", 2, 101), *rows[3:], ("new", 9, 9)]
    old = C.metrics_of(files_of(spark, rows), path, go)
    assert focus(C.metrics_of(files_of(spark, changed), path, go)) == {p: s * 2 for p, s, _ in changed if p != "bad"}
    assert go.asked[3] == ["bad", "f1", "f2", "new"]
    assert focus(old) == good  # a table of the pass before can still be read
    cached = C.read_metrics(spark, path)
    assert cached.count() == 31 and cached.select("rel_path").distinct().count() == 31  # f0 is remembered, though it is gone
    none = C.metrics_of(files_of(spark, []), str(tmp_path / "none"), go)
    assert none.count() == 0 and C.metrics_of(files_of(spark, [(None, 1, 1)]), path, go).count() == 0


def test_people_and_limit(spark, tmp_path):
    path, go = str(tmp_path / "cache"), Compute()
    files = files_of(spark, [("a", 1, 1), ("b", 2, 2), ("c", 3, 3)])
    sigs = [C.people_signature([("x", 2)], 70), C.people_signature([("x", 3)], 70), C.people_signature(None)]
    assert sigs[0] != sigs[1] and sigs[2] is None and C.people_signature([("y", 1), ("x", 2)]) == C.people_signature([("x", 2), ("y", 1)])
    for sig in (sigs[0], sigs[0], sigs[1], sigs[2], sigs[0]):
        assert focus(C.metrics_of(files, path, go, sig)) == {"a": 2, "b": 4, "c": 6}
    assert [len(a) for a in go.asked] == [3, 0, 3, 0, 3]
    assert focus(C.metrics_of(files, path, go, sigs[0], limit=2)) == {"a": 2, "b": 4} and go.asked[-1] == ["a", "b"]
    before = sorted(os.listdir(path))
    C.metrics_of(files_of(spark, [("z", 1, 1)]), path, go, limit=1)
    assert sorted(os.listdir(path)) == before


def test_a_lost_pass_and_untouched_buckets(spark, tmp_path, monkeypatch):
    path, go = str(tmp_path / "cache"), Compute()
    rows = [(f"f{i}", i, 1) for i in range(40)]
    C.metrics_of(files_of(spark, rows), path, go)
    more = [*rows, ("late", 7, 7)]
    session = type(spark)

    def lost(*_, **__):
        raise RuntimeError("lost between write and switch")

    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="lost"):
        m.setattr(session, "createDataFrame", lost)
        C.metrics_of(spark.range(1).selectExpr("'late' AS rel_path", "7L AS size", "7L AS mtime_epoch"), path, go)
    assert os.path.exists(f"{path}/version=1") and C._head(spark, path)[0] == 0 and C.read_metrics(spark, path).count() == 40
    assert focus(C.metrics_of(files_of(spark, more), path, go)) == {p: s * 2 for p, s, _ in more}
    assert go.asked[-1] == ["late"]
    assert len([n for n in os.listdir(f"{path}/version=1") if n.startswith("bucket=")]) == 1
    for k in range(3):
        C.metrics_of(files_of(spark, [("late", 7, 8 + k)]), path, go)
    heads = sorted(n for n in os.listdir(path) if n.startswith("head-"))
    assert heads == ["head-3", "head-4"] and C.read_metrics(spark, path).count() == 41
    assert sorted(n for n in os.listdir(path) if n.startswith("version=")) == ["version=0", "version=3", "version=4"]


def test_stream(spark, tmp_path):
    path, go = str(tmp_path / "cache"), Compute()
    for k, rows in enumerate(([("a", 1, 1), ("a", 2, 2), ("b", 1, 1)], [("b", 1, 1), ("c", 4, 4)])):
        files_of(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("rel_path string, size long, mtime_epoch long").parquet(str(tmp_path / "in"))
        assert C.watch_metrics(stream, path, go, str(tmp_path / "ck")).awaitTermination(90)
        assert go.asked[k] == [["a", "b"], ["c"]][k]
    assert focus(C.read_metrics(spark, path)) == {"a": 4, "b": 2, "c": 8}
