"""Progressive digests and plans over a stored inventory, on trees of real files."""

import hashlib
import os

from pyspark.sql import functions as F

from stowage.plans import planners as P
from stowage.sources import inventory as I
from stowage.sources import progressive as G
from stowage.streaming import stock as T


def put(root, rel, data):
    path = root / rel
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_only_possible_copies_are_read(spark, tmp_path):
    big = bytes(range(256)) * 2048  # 512 KB
    middle = big[: len(big) // 2] + b"!" + big[len(big) // 2 + 1 :]
    tree = {"big/a": big, "big/b": big, "big/other_middle": middle, "big/other_head": b"!" + big[1:], "big/lone": big + b"x", "s/a": b"one", "s/b": b"one", "s/c": b"two", "zero": b"", "zero2": b""}
    for rel, data in tree.items():
        put(tmp_path, rel, data)
    files = I.files(I.read_inventory(spark, str(tmp_path))).drop("kind", "head")
    gone = files.limit(1).withColumns({"rel_path": F.lit("gone"), "name": F.lit("gone"), "size": F.lit(3).cast("long")})
    got = {r.rel_path: r for r in G.progressive_digests(files.union(gone), str(tmp_path)).collect()}
    sha = lambda rel: hashlib.sha1(tree[rel]).hexdigest()
    for rel in ("big/a", "big/b", "big/other_middle", "s/a", "s/b", "s/c"):
        assert got[rel].sha1 == sha(rel)
    assert {k for k, r in got.items() if r.sha1 is None} == {"big/other_head", "big/lone", "zero", "zero2", "gone"}
    edges = 2 * G.EDGE
    assert {k: r.read for k, r in got.items()} == {"big/a": edges + len(big), "big/b": edges + len(big), "big/other_middle": edges + len(big), "big/other_head": edges, "big/lone": 0, "s/a": 3, "s/b": 3, "s/c": 3, "zero": 0, "zero2": 0, "gone": 0}
    again = G.progressive_digests(spark.createDataFrame([(r.rel_path, r.size, r.edge, r.sha1) for r in got.values() if r.rel_path != "gone"], "rel_path string, size long, edge string, sha1 string"), str(tmp_path))
    assert again.agg(F.sum("read")).first()[0] == 0 and {r.rel_path: r.sha1 for r in again.collect()} == {k: r.sha1 for k, r in got.items() if k != "gone"}
    none = G.progressive_digests(files.limit(0), str(tmp_path))
    assert none.count() == 0 and {"edge", "sha1", "read"} <= set(none.columns)


def test_digest_of_a_file_beyond_two_gigabytes(tmp_path):
    """Sparse, so it takes no room; what is read is bounded by PIECE."""
    path, size = str(tmp_path / "huge"), (1 << 31) + 77
    with open(path, "wb") as f:
        f.truncate(size)
        f.seek(1 << 30)
        f.write(b"middle")
    want = hashlib.sha1()
    with open(path, "rb") as f:
        for piece in iter(lambda: f.read(1 << 24), b""):
            want.update(piece)
    assert G._whole(path, size) == (want.hexdigest(), size)
    assert G._edge(path, size) == (hashlib.sha1(bytes(2 * G.EDGE)).hexdigest(), 2 * G.EDGE)


def plans(spark, out, number):
    return {(r.src, r.dst) for r in spark.read.parquet(f"{out}/batch={number}").collect()}


def test_plans_over_the_whole_tree(spark, tmp_path):
    root, state, out = tmp_path / "tree", str(tmp_path / "state"), str(tmp_path / "out")
    take = lambda: T.take_stock(spark, str(root), state, P.duplicates, out)
    put(root, "a/x.txt", b"same words")
    put(root, "a/y.txt", b"other")
    assert T.stock(spark, state) is None and take() == {"new": 2} and plans(spark, out, 0) == set()
    put(root, "a/b/copy.txt", b"same words")  # a copy of an earlier batch's file
    assert take() == {"new": 1} and plans(spark, out, 1) == {("a/b/copy.txt", "Duplicates_Review/copy.txt")}
    assert take() == {} and T.snapshots(spark, state) == [0, 1]
    put(root, "a/b/c/third.txt", b"same words")
    os.remove(root / "a/x.txt")  # the kept one goes: the shallowest of the others is kept
    put(root, "a/y.txt", b"changed in size")
    assert take() == {"new": 1, "gone": 1, "changed": 1} and plans(spark, out, 2) == {("a/b/c/third.txt", "Duplicates_Review/third.txt")}
    assert T.snapshots(spark, state) == [1, 2]

    # a crash between the plan and the end of the snapshot: the pass is done again under its number
    put(root, "a/z.txt", b"changed in size")
    os.remove(root / "a/b/c/third.txt")

    def fails(files):
        raise RuntimeError("lost")

    try:
        T.take_stock(spark, str(root), state, fails, out)
    except RuntimeError:
        pass
    os.makedirs(f"{state}/snapshot-3")  # begun and not ended
    assert T.snapshots(spark, state) == [1, 2]
    assert take() == {"new": 1, "gone": 1} and plans(spark, out, 3) == {("a/z.txt", "Duplicates_Review/z.txt")}
    assert {r.rel_path for r in T.stock(spark, state).collect()} == {"a/b/copy.txt", "a/y.txt", "a/z.txt"}


def test_watching_a_tree(spark, tmp_path):
    root, state, out = tmp_path / "tree", str(tmp_path / "state"), str(tmp_path / "out")
    put(root, "x", b"same words")
    for k, change in enumerate((lambda: put(root, "d/copy", b"same words"), lambda: os.remove(root / "x"))):
        change()
        stream = spark.readStream.format("file_inventory").option("path", str(root)).option("settle", -5).load()
        assert T.watch_tree(stream, str(root), state, P.duplicates, out, str(tmp_path / "ck")).awaitTermination(90)
        assert plans(spark, out, k) == ({("d/copy", "Duplicates_Review/copy")} if k == 0 else set())
