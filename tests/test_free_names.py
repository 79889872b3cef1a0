"""Free names by ranks over ranges, against numbers handed out one by one."""

import random

import pytest
from pyspark.sql import functions as F

from stowage.plans import manifest as M
from stowage.plans import planners as P
from stowage.plans.free_names import free_numbers
from tests.test_inventory import brute_apply, inventory


def test_free_numbers(spark):
    rng = random.Random(3)
    taken = {k: rng.sample(range(1, 40), rng.randrange(20)) for k in "abcd"} | {"e": [10**17]}
    wanted = [(k, i) for k in "abcef" for i in rng.sample(range(1000), rng.randrange(1, 30))]
    got = free_numbers(spark.createDataFrame(wanted, "k string, op_seq long"), spark.createDataFrame([(k, t) for k in taken for t in taken[k]], "k string, t long"))
    want = []
    for k in "abcef":
        free = (i for i in range(1, 1000) if i not in taken.get(k, []))
        want += [(k, i, next(free)) for i in sorted(i for kk, i in wanted if kk == k)]
    assert sorted((r.k, r.op_seq, r.free) for r in got.collect()) == sorted(want)
    none = spark.createDataFrame([], "k string, op_seq long")
    assert free_numbers(none, spark.createDataFrame([], "k string, t long")).count() == 0


def ops_of(spark, ops):
    return spark.createDataFrame([(i, "move", a, b) for i, a, b in ops], "op_seq long, kind string, src string, dst string")


@pytest.mark.parametrize("seed", range(3))
def test_many_want_one_name(spark, seed):
    """Names without, with one and with two dots, numbers that stand already (also such as 01), same bytes, no digest, occupied or not."""
    rng = random.Random(seed)
    names = ["index.html", "README", ".hidden", "a.tar.gz", "x_1.t", "end."]
    standing = [(f"out/{n}", rng.choice([1, 2]), rng.choice("pq")) for n in names if rng.random() < 0.5]
    for n in names:
        base, dot, ext = n.rpartition(".")
        base, ext = (base, dot + ext) if base and ext else (n, "")
        standing += [(f"out/{base}_{i}{ext}", 1, "p") for i in rng.sample(["1", "2", "3", "5", "01", "9"], 3)]
    moved = [(f"{folder}/{n}", rng.choice([1, 2]), rng.choice(["p", "q", "r", None])) for folder in "abcdefgh" for n in (*names, "x.t" if seed else "end._1")]  # the last makes a cluster that is replayed
    files = list(dict((p, (p, s, d)) for p, s, d in standing + moved).values())
    rng.shuffle(moved)
    ops = [(i, p, f"out/{p.split('/')[1]}") for i, (p, _, _) in enumerate(moved)]
    manifest, journal = M.apply(inventory(spark, files), ops_of(spark, ops))
    there, log = brute_apply([(p, s, d if d is not None else f"none {i}") for i, (p, s, d) in enumerate(files)], ops)
    assert sorted((r.src, r.dst, r.outcome) for r in journal.collect()) == sorted(log)
    assert {r.rel_path for r in manifest.collect()} == set(there)


def test_a_hundred_thousand_of_one_name(spark):
    n = 100_000
    files = spark.range(n).select(F.col("id").alias("walk_seq"), F.concat(F.lit("d"), "id", F.lit("/index.html")).alias("rel_path"), F.lit("index.html").alias("name"), F.lit(1).cast("long").alias("size"), F.sha1(F.col("id").cast("string")).alias("sha1"), F.lit(0).cast("long").alias("mtime_epoch"))
    ops = files.select(F.col("walk_seq").alias("op_seq"), F.lit("move").alias("kind"), F.col("rel_path").alias("src"), F.lit("index.html").alias("dst"))
    _, journal = M.apply(files, ops)
    number = F.regexp_extract("dst", r"^index_(\d+)\.html$", 1)
    wrong = journal.where(~F.when(F.col("op_seq") == 0, F.col("dst") == "index.html").otherwise(number == F.col("op_seq").cast("string")))
    assert journal.count() == n and wrong.count() == 0
    flat = files.withColumn("rel_path", F.concat(F.lit("d/index"), "walk_seq", F.lit(".html"))).withColumn("name", F.concat(F.lit("index"), "walk_seq", F.lit(".html")))
    named = P.rename(flat, "page")
    assert named.select("dst").distinct().count() == n and named.where(F.col("dst") == F.concat(F.lit("d/page_"), F.col("reason").cast("long") - 1, F.lit(".html"))).count() == n - 1
