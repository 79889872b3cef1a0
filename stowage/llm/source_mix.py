"""Mixing sources to target weights, with DataFrame functions only.

Words are summed per source, targets follow from the weights and a bound on repetition, and a source's rate is target / size. A document
comes floor(rate) times, plus one more time if a number drawn from its hash is below the fraction of the rate. A source has SEEDS such
draws, and takes the one whose words come nearest to its target: each is as fair as the other, but long documents make some miss by far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm import common as C

WORD = r"[^\x20\x09-\x0D]+"
#: Draws per source; each takes DIGITS hex digits of a SHA-256.
SEEDS, DIGITS = 32, 8
_PER = 64 // DIGITS


def _draws(key: Column) -> Column:
    """SEEDS numbers from 0 to 1 (not reached), the same for the same key in any run."""
    digests = F.transform(F.sequence(F.lit(0), F.lit(SEEDS // _PER - 1)), lambda i: F.sha2(F.concat(i.cast("string"), F.lit(":"), key), 256))
    cut = lambda d: F.transform(F.sequence(F.lit(0), F.lit(_PER - 1)), lambda j: F.conv(F.substring(d, j * DIGITS + 1, F.lit(DIGITS)), 16, 10).cast("double") / 16.0**DIGITS)
    return F.flatten(F.transform(digests, cut))


def targets(sources: DataFrame, most: int) -> DataFrame:
    """sources (source, source_size, weight) with target: all sizes are shared by weight, none gets more than most times its size, and
    what is over is shared again by weight until none is above.

    Each round only sends two sums to the driver: the level (words per weight) rises as sources are held at their bound, which takes
    few rounds, since a round holds every source that its level fills.
    """
    total = sources.agg(F.sum("source_size").cast("decimal(38,0)").alias("t"), F.sum("weight").alias("w")).first()
    words, weight = total.t or 0, total.w or 0
    above = lambda words, weight: F.lit(most).cast("decimal(38,0)") * F.col("source_size") * F.lit(weight) < F.col("weight") * F.lit(words).cast("decimal(38,0)")
    while weight:
        held = sources.where(above(words, weight)).agg(F.coalesce(F.sum(F.col("source_size").cast("decimal(38,0)") * most), F.lit(0)).alias("t"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()
        left = ((total.t or 0) - held.t, (total.w or 0) - held.w)
        if left == (words, weight):
            break
        words, weight = left
    shared = F.col("weight") * F.lit(float(words)) / F.lit(float(weight or 1))
    whole = F.col("source_size").cast("double") * most
    return sources.withColumn("target", F.when(F.lit(weight == 0) | above(words, weight or 1), whole).otherwise(F.least(shared, whole)))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows (id, source, size, source_size, target, copies), one per row of docs: how often the mix takes it.

    size: words of the text (null: 0). Sources in code point order, null last, weigh the weights in turn. copies is floor(rate) or one
    more, never over most. The draw hangs on id and text alone, so reruns agree, and rows equal in both share it. A source without words
    has target 0 and no copies. Sources are numbered and their targets found on a table of sources; rows of a large source meet in no
    task, as sums combine before the shuffle and the rates are sent, or joined where there are too many sources.
    """
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    group = F.coalesce(F.concat(F.lit("0"), F.col(source_col)), F.lit("1"))  # null last, and no null in a join
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    sized = C.stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), group.alias("g"), size.alias("size"), key.alias("key")), "sized")
    sources = C.numbered(sized.groupBy("g").agg(F.sum("size").alias("source_size")).withColumn("all", F.lit(0)), ["all"], ["g"], "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("idx") % len(weights) + 1).cast("int")).cast("long")
    aimed = targets(C.stored(sources.select("g", "source_size", weight.alias("weight")), "weights"), most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = C.stored(aimed.select("g", "source_size", "target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("part")), "rates")
    drawn = sized.join(C.sent(rates), "g").withColumn("u", _draws(F.col("key")))
    won = F.array(*(F.sum(F.when(F.get("u", F.lit(i)) < F.col("part"), F.col("size")).otherwise(0)) for i in range(SEEDS)))
    seeds = drawn.groupBy("g").agg(won.alias("won"), F.first("source_size").alias("s"), F.first("target").alias("t"), F.first("whole").alias("f"))
    miss = F.transform("won", lambda x, i: F.struct(F.abs(x + F.col("f") * F.col("s") - F.col("t")).alias("miss"), i.alias("seed")))
    best = C.stored(rates.join(seeds.select("g", F.array_min(miss)["seed"].alias("seed")), "g"), "seeds")
    taken = sized.join(C.sent(best), "g").withColumn("u", F.get(_draws(F.col("key")), F.col("seed")))
    copies = F.least(F.lit(most), F.col("whole") + (F.col("u") < F.col("part")).cast("long"))
    return taken.select("id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mixed(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mix itself: the rows of docs, each as often as the plan says, with copy (from 0). Ids must be unique and not null here.

    The plan has one narrow row per document, so the join is one of equals; texts are repeated after it.
    """
    times = plan.where("copies > 0").select(F.col("id").alias("_mix_id"), F.col("copies").alias("_mix_copies"))
    taken = docs.join(times, F.col(id_col) == F.col("_mix_id"))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_mix_copies") - 1))).drop("_mix_id", "_mix_copies")


def duckdb_sql(most: int = 3) -> str:
    """The query's rows: targets by holding one more source at a time in the order of size per weight."""
    draws = f"list_transform(range({SEEDS}), lambda i: ('0x' || substr(sha256((i // {_PER}) || ':' || key), CAST(i % {_PER} * {DIGITS} + 1 AS BIGINT), {DIGITS}))::BIGINT / {16**DIGITS}.0::DOUBLE)"
    return f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
  coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
o AS (SELECT *, coalesce(sum(source_size) OVER w, 0) AS held, coalesce(sum(weight) OVER w, 0) AS off, sum(source_size) OVER () AS words, sum(weight) OVER () AS weights
  FROM s WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT words - {most} * held AS words, weights - off AS weights FROM o WHERE {most} * source_size * (weights - off) >= weight * (words - {most} * held) ORDER BY off LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN {most} * source_size * l.weights < weight * l.words THEN {most}.0::DOUBLE * source_size ELSE weight * l.words::DOUBLE / l.weights::DOUBLE END AS target FROM s, level l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t),
u AS (SELECT doc_id, d.source, size, source_size, target, floor(rate) AS whole, rate - floor(rate) AS part, {draws} AS u FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
e AS (SELECT source, size, source_size, target, whole, part, unnest(u) AS u, unnest(range({SEEDS})) AS seed FROM u),
m AS (SELECT source, seed, abs(sum(CASE WHEN u < part THEN size ELSE 0 END) + any_value(whole * source_size - target)) AS miss FROM e GROUP BY source, seed),
b AS (SELECT source, arg_min(seed, struct_pack(m := miss, s := seed)) AS seed FROM m GROUP BY source)
SELECT doc_id, size, source_size, target, (size * least({most}, whole + CASE WHEN u[seed + 1] < part THEN 1 ELSE 0 END))::BIGINT AS taken FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source"""
