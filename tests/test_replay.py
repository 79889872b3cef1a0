"""Undo and redo in journal order, against a sequential replay of the same records."""

import random

import pytest
from pyspark.sql import functions as F

from stowage.operators import ranges as G
from stowage.plans import manifest as M
from stowage.plans.replay import replay


def inventory(spark, rows):
    return spark.createDataFrame([(p, p.rsplit("/", 1)[-1], i) for p, i in rows.items()], "rel_path string, name string, content long").repartition(3)


def plain(there, steps):
    """(paths, outcomes) by going through the steps."""
    there, ok = dict(there), {}
    for seq, kind, frm, to in sorted(steps):
        done = frm in there and frm != to and (kind == "drop" or to is not None) and (kind in ("drop", "force") or to not in there)
        if done:
            content = there[frm] if kind == "copy" else there.pop(frm)
            if kind != "drop":
                there[to] = content
        ok[seq] = done
    return there, ok


def check(spark, there, steps):
    files, done = replay(inventory(spark, there), spark.createDataFrame(steps, "seq long, kind string, frm string, to string").repartition(2))
    want, ok = plain(there, steps)
    rows = files.collect()
    assert {r.rel_path: r.content for r in rows} == want and len(rows) == len(want)
    assert all(r.name == r.rel_path.rsplit("/", 1)[-1] for r in rows)
    assert {r.seq: r.ok for r in done.collect()} == ok


@pytest.mark.parametrize("seed", range(3))
def test_random_steps_equal_a_sequential_replay(spark, seed):
    rng = random.Random(seed)
    paths = [f"{a}/{b}" for a in "pqr" for b in range(5)]
    there = {p: i for i, p in enumerate(paths) if rng.random() < 0.5}
    kinds = ["move"] * 4 + (["copy", "drop", "force"] if seed % 2 else [])
    steps = []
    for i in range(70):
        kind = rng.choice(kinds)
        steps.append((i * 3 - 50, kind, rng.choice(paths), None if kind == "drop" else rng.choice(paths)))
    check(spark, there, [*steps, (999, "move", None, "p/0"), (1000, "move", "p/0", None)])


@pytest.mark.parametrize("blocked", [False, True])
def test_long_chains_take_few_rounds(spark, monkeypatch, blocked):
    n, rounds = 200, []
    monkeypatch.setattr(G, "stored", lambda df, name="table", f=G.stored: rounds.append(name) or f(df, name))
    there = {f"c{i + 1}": i for i in range(n)} | ({"c0": 999} if blocked else {})
    check(spark, there, [(i, "move", f"c{i + 1}", f"c{i}") for i in range(n)])
    assert rounds.count("nodes") < 14 and rounds.count("carried") < 14
    turns = [(3 * i + k, "move", a, b) for i in range(15) for k, (a, b) in enumerate([("x", "t"), ("y", "x"), ("t", "y")])]
    check(spark, {"x": 1, "y": 2}, turns)


def test_nothing_to_do(spark):
    check(spark, {"a": 1}, [])
    check(spark, {}, [(1, "move", "a", "b")])


def journal(spark, rows, schema="op_seq long, op string, src string, dst string, outcome string"):
    return spark.createDataFrame(rows, schema)


def paths(df):
    return {r.rel_path: r.content for r in df.collect()}


def test_undo_frees_places_in_order(spark):
    """Files a, c; a to b, then c to a: back in the other order, and forth again."""
    done = journal(spark, [(1, "move", "a", "b", "moved"), (2, "move", "c", "a", "moved")])
    now = inventory(spark, {"b": 1, "a": 3})
    assert paths(back := M.undo(now, done)) == {"a": 1, "c": 3}
    assert paths(M.redo(back, done)) == {"b": 1, "a": 3}
    swap = journal(spark, [(1, "move", "a", "t", "moved"), (2, "move", "b", "a", "moved"), (3, "move", "t", "b", "moved"), (4, "move", "q", "r", "missing")])
    assert paths(M.undo(inventory(spark, {"a": 2, "b": 1}), swap)) == {"a": 1, "b": 2}


def test_copies_and_compressions(spark):
    rows = [(1, "copy", "a", "x/a", "moved", None), (2, "compress", "p.png", "p.jpg", "moved", "O/p.png"), (3, "compress", "q.jpg", "q.jpg", "moved", "O/q.jpg"), (4, "compress", "gone", "gone", "moved", "O/gone"), (5, "compress", "s", "O/s", "moved", "O/s"), (6, "move", "x/a", "x/b", "moved", None)]
    done = journal(spark, rows, "op_seq long, op string, src string, dst string, outcome string, backup string")
    now = inventory(spark, {"a": 1, "x/b": 1, "p.jpg": 20, "O/p.png": 2, "q.jpg": 30, "O/q.jpg": 3, "O/s": 5})
    manifest, undone, left = M.undo_entry(now, done)
    assert paths(manifest) == {"a": 1, "p.png": 2, "q.jpg": 3, "s": 5}
    assert sorted(r.op_seq for r in undone.collect()) == [1, 2, 3, 5, 6] and [r.op_seq for r in left.collect()] == [4]
    assert paths(M.redo(inventory(spark, {"a": 1}), done)) == {"a": 1, "x/b": 1}


def test_history_of_a_partial_undo(spark):
    there = {"A/1": 1, "B/2": 2, "B/3": 3, "z": 9}
    first = journal(spark, [(1, "move", "1", "A/1", "moved"), (2, "move", "2", "B/2", "moved"), (3, "move", "3", "B/3", "moved"), (4, "move", "y", "B/y", "missing")])
    history, undone = M.history_record(None, None, first, "/r", "e1", F.lit(1.0), "sort")
    history, undone = M.history_record(history, undone, journal(spark, [(1, "move", "o", "z", "moved")]), "/r", "e2", F.lit(2.0), "other")
    manifest, history, undone = M.history_undo(history, undone, inventory(spark, there | {"2": 77}), "/r", "e1", ["B"])
    assert paths(manifest) == {"A/1": 1, "B/2": 2, "3": 3, "2": 77, "z": 9}  # 2 is occupied: its record stays
    assert {(r.entry_id, r.moves, r.undoable, r.redoable) for r in M.history_list(history, undone).collect()} == {("e1", 2, False, False), ("e2", 1, True, False), ("e1/0", 1, False, True)}
    manifest, history, undone = M.history_undo(history, undone, manifest, "/r", "e2")
    assert paths(manifest)["o"] == 9
    assert [(r.entry_id, r.redoable) for r in M.history_list(history, undone).where("not undoable and entry_id <> 'e1'").orderBy("entry_id").collect()] == [("e1/0", False), ("e2", True)]
    manifest, history, undone = M.history_redo(history, undone, manifest, "/r")
    manifest, history, undone = M.history_redo(history, undone, manifest, "/r")
    assert paths(manifest) == {"A/1": 1, "B/2": 2, "B/3": 3, "2": 77, "z": 9} and undone.isEmpty()
    assert [r.entry_id for r in M.history_list(history).where("undoable").collect()] == ["e1/0"]
    assert M.history_redo(history, undone, manifest, "/r")[0] is manifest
    manifest, history, undone = M.history_undo(history, undone, manifest, "/r", "e2")
    _, after = M.history_record(history, undone, first.where("op_seq > 3"), "/r", "e3", F.lit(9.0), "nothing")
    assert after.count() == 1
    _, after = M.history_record(history, undone, first, "/r", "e3", F.lit(9.0), "new")
    assert after.isEmpty()


def test_folder_records(spark):
    dirs = spark.createDataFrame([("a",), ("a/b",), ("a/b/c",), ("k",), ("k/full",), ("k/empty",)], "rel_path string")
    before, after = inventory(spark, {"a/b/x": 1, "k/full/y": 2}), inventory(spark, {"new/deep/x": 1, "k/full/y": 2})
    ops = spark.createDataFrame([("mkdir", "made/by/hand"), ("mkdir", "k"), *(("rmdir", p) for p in ("a/b/c", "a/b", "a", "k/full", "k", "no"))], "kind string, src string")
    left, records = M.folder_records(dirs, before, after, ops)
    assert {(r.op, r.dst) for r in records.collect()} == {("mkdir", p) for p in ("new", "new/deep", "made", "made/by", "made/by/hand")} | {("rmdir", p) for p in ("a", "a/b", "a/b/c")}
    assert {r.rel_path for r in left.collect()} == {"k", "k/full", "k/empty", "new", "new/deep", "made", "made/by", "made/by/hand"}
    back = M.undo_folders(left, before, records)
    assert {r.rel_path for r in back.collect()} == {"k", "k/full", "k/empty"}


def test_rows_before_across_ranges(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(1000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("v"), "id").repartition(5)
        table = G.ranged(rows, ["k", "id"])
        assert table.select("_part").distinct().count() > 2
        got = {r.id: r.previous for r in G.with_previous(table, ["k"], ["id", "v"]).collect()}
        assert all((got[i] is None) if i < 3 else (got[i].id == i - 3 and got[i].v == (i - 3 if (i - 3) % 7 else None)) for i in range(1000))
        total, order = 0, sorted(range(1000), key=lambda i: (i % 3, i))
        sums = {r.id: r.s for r in G.with_running_sum(table, "id", "s").collect()}
        for i in order:
            total += i
            assert sums[i] == total
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_tables_of_a_journal_are_not_sent_to_all(spark):
    """Small files are no sign of a small table: what grows with the journal is joined by shuffles, not through the driver."""
    manifest = spark.createDataFrame([(i, f"p{i}", f"p{i}") for i in range(20)], "walk_seq long, rel_path string, name string")
    journal = spark.createDataFrame([(-i, "move", f"p{i}", f"p{i + 1}", "moved") for i in range(20)], "op_seq long, op string, src string, dst string, outcome string")
    after = M.redo(manifest.where("walk_seq < 20"), journal)
    assert "BroadcastHashJoin" not in after._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.rel_path for r in after.collect()) == sorted(f"p{i + 1}" for i in range(20))
