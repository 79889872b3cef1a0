"""Listing by rounds of open folders gives what walking the tree gives, in its order, from many tasks."""

import os

import pytest
from pyspark.sql import functions as F

from stowage.sources import frontier as L
from stowage.sources import inventory as I


def rows(df):
    return [tuple(r) for r in df.orderBy("walk_seq").select("kind", "rel_path", "name", "size", "mtime_epoch", "head").collect()]


@pytest.mark.parametrize("entries", [1, 5, 10_000])
def test_same_as_walking(spark, tmp_path, monkeypatch, entries):
    for rel in ("z", "a/f2", "a/f10", "a/b/c/d/deep", "a.b/x", "a/b.txt", "é/ü", ".hidden/.h", "m/n/o"):
        path = tmp_path / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(rel)
    (tmp_path / "empty/below").mkdir(parents=True)
    os.symlink(tmp_path / "a", tmp_path / "m/link")
    os.symlink(tmp_path / "nowhere", tmp_path / "m/broken")
    monkeypatch.setattr(L, "ENTRIES", entries)
    got = rows(L.list_tree(spark, str(tmp_path), head=True))
    assert got == rows(I.read_inventory(spark, str(tmp_path), head=True)) and len(got) == 21  # 10 files and 11 folders
    part = rows(L.list_tree(spark, str(tmp_path), head=True, below="a"))
    assert part == [r for r in got if r[1].startswith("a/")]
    assert rows(L.list_tree(spark, str(tmp_path / "empty/below"))) == [] and rows(L.list_tree(spark, str(tmp_path / "missing"))) == []


def test_one_top_folder_is_listed_by_many_tasks(spark, tmp_path, monkeypatch):
    for k in range(60):
        (tmp_path / f"top/d{k}").mkdir(parents=True)
        for i in range(50):
            (tmp_path / f"top/d{k}/{i}").touch()
    monkeypatch.setattr(L, "ENTRIES", 100)
    monkeypatch.setattr(L, "stored", lambda df, name: kept.append(real(df.withColumn("task", F.spark_partition_id()), name)) or kept[-1].drop("task"))
    kept, real = [], L.__dict__["ranged"].__globals__["stored"]
    got = L.list_tree(spark, str(tmp_path))
    assert got.count() == 60 * 51 + 1
    assert len(kept) > 1 and kept[1].select("task").distinct().count() > 1
    assert got.select(F.spark_partition_id().alias("task")).distinct().count() > 1
