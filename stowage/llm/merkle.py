"""A Merkle manifest of a dataset by lag and lead windows.

Leaves are numbered within their group, and cut into blocks of FANOUT ** LEVELS consecutive ones, so that all siblings of the lowest
LEVELS levels lie in one block (fewer levels, where the largest group needs no more). Within a block the node of level l stands in the row of its first leaf: its siblings are found by lag and
lead of fixed offsets (1 and 2 times FANOUT ** l), masked by the node's slot and the length of its run, and the rows of first children
hash the parents. The blocks' tops are the leaves of the next pass, the groups' roots those of the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm import common as C

#: At most so many levels in one pass: 2187 leaves a block, which a window holds in memory.
FANOUT, LEVELS = 3, 7
PATH = "array<struct<left:string,right:string>>"


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of the values in turn: `-` for null, else the bytes of its text in UTF-8, `:` and the text. Integers are decimal."""
    shown = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in shown)), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right (of nothing, if there are none)."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def climb(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes (g, idx, n, h, more) with block, path (siblings up to the block's top) and, in a block's first row, its top."""
    rows = nodes.withColumns({"block": F.floor(F.col("idx") / FANOUT**levels).cast("long"), "h0": F.col("h")})
    w = Window.partitionBy("g", "block").orderBy("idx")
    for level in range(levels):
        step, own = FANOUT**level, f"h{level}"
        node, many = F.floor(F.col("idx") / step).cast("long"), F.col("n") > step
        slot = node % FANOUT
        run = F.least(F.lit(FANOUT), F.ceil(F.col("n") / step) - node + slot)
        near = {"a": F.lag(own, 2 * step), "b": F.lag(own, step), "c": F.lead(own, step), "d": F.lead(own, 2 * step)}
        rows = rows.withColumns({k: F.when((F.col("idx") % step == 0) & many, v.over(w)) for k, v in near.items()})
        left = F.when(slot == 2, F.concat("a", "b")).when(slot == 1, F.col("b")).otherwise("")
        right = F.when(run - slot == 3, F.concat("c", "d")).when(run - slot == 2, F.col("c")).otherwise("")
        first = F.col("idx") % (step * FANOUT) == 0
        above = F.when(first, F.when(many, F.sha2(F.concat(own, right), 256)).otherwise(F.col(own)))
        rows = rows.withColumns({f"s{level}": F.when((F.col("idx") % step == 0) & many, F.struct(left.alias("left"), right.alias("right"))), f"h{level + 1}": above})
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    path = F.array(*(F.last(f"s{level}", ignorenulls=True).over(so_far) for level in range(levels)))
    return rows.select(*nodes.columns, "block", F.filter(path, lambda s: s.isNotNull()).cast(PATH).alias("path"), F.col(f"h{levels}").alias("top"))


def _tree(nodes: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the climbed rows of nodes, the roots (g, root) and, by (g, block), the path that goes on from a block's top)."""
    passes, largest = [], nodes.agg(F.max("n").alias("n")).first().n or 1
    while largest > 1 or not passes:
        levels = next(k for k in range(1, LEVELS + 1) if k == LEVELS or FANOUT**k >= largest)
        block, largest = FANOUT**levels, -(-largest // FANOUT**levels)
        passes.append(C.stored(climb(nodes, levels), f"{name}-{len(passes)}"))
        nodes = passes[-1].where(F.col("idx") % block == 0).select("g", F.col("block").alias("idx"), F.ceil(F.col("n") / block).cast("long").alias("n"), F.col("top").alias("h"))
    on = nodes.select("g", F.col("idx").alias("block"), F.array().cast(PATH).alias("on"))
    for p in reversed(passes[1:]):
        on = p.join(on, ["g", "block"]).select("g", F.col("idx").alias("block"), F.concat("path", "on").alias("on"))
    return passes[0], nodes.select("g", F.col("h").alias("root")), on


def manifest(leaves: DataFrame, leaf_col: str, group_col: str, order_cols: list[str]) -> DataFrame:
    """leaves with subroot, root and path: the root of their group's tree, that of all, and the siblings on the way there.

    Leaves of a group ascend by the order columns (nulls first), ties by leaf digest; rows equal in all that are equal leaves, whose
    places among each other don't matter. While several nodes remain, every three consecutive ones become the hash of their digests (the
    last run may be shorter, even one). Groups ascend as bytes, null first; their roots are the leaves of the last tree. Groups of any
    size are dealt by ranges and blocks, and no leaf is sent anywhere. An empty table gives no rows. Other columns stay; those of leaves
    may have any names, as they travel in a struct.
    """
    ids = [F.col(c).alias(f"o{i}") for i, c in enumerate(order_cols)]
    group = F.coalesce(F.concat(F.lit("1"), F.col(group_col).cast("string")), F.lit("0"))
    rows = leaves.select(group.alias("g"), *ids, F.col(leaf_col).alias("h"), F.struct(*leaves.columns).alias("row"))
    rows = C.stored(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    order = [f"o{i}" for i in range(len(order_cols))]
    placed = C.numbered(rows, ["g"], [*order, "h", "tie"], "placed").select("g", "idx", "n", "h", "row")
    low, subroots, on = _tree(placed, "nodes")
    subroots = C.stored(subroots, "subroots")
    tops = C.numbered(subroots.select(F.lit("").alias("g"), "root", F.col("g").alias("group")), ["g"], ["group"], "groups")
    high, roots, high_on = _tree(tops.select("g", "idx", "n", F.col("root").alias("h"), "group"), "groups")
    top = roots.first()
    root = F.lit(top.root if top else None).cast("string")
    ends = high.join(high_on, ["g", "block"]).select(F.col("group").alias("g"), F.col("h").alias("subroot"), F.concat("path", "on").alias("end"))
    rest = C.stored(on.join(ends, "g").select("g", "block", "subroot", F.concat("on", "end").alias("rest")), "paths")
    return low.join(C.sent(rest), ["g", "block"]).select("row.*", "subroot", root.alias("root"), F.concat("path", "rest").alias("path"))


def duckdb_sql(fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> str:
    """The query's rows: nodes by a recursion over levels, then each leaf's fold by another."""
    shown = lambda names: "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in names) + ")"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda k: ascii(k)::BIGINT)), lambda c, b: {bits}), 4294967295)"
    up = "SELECT g, level + 1, idx // 3, ((any_value(n) + 2) // 3)::BIGINT, sha256(string_agg(h, '' ORDER BY idx)) FROM {t} WHERE n > 1 GROUP BY g, level, idx // 3"
    return f"""WITH RECURSIVE d AS (SELECT *, '1' || source AS gs FROM documents),
leaf AS (SELECT doc_id, coalesce(gs, '0') AS g, {shown(fields)} AS h,
  CASE WHEN doc_id IS NOT NULL AND {crc} % 2 = 0 THEN {shown(fields[:-1]).removesuffix(")")} || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS bad FROM d),
base AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM leaf),
low(g, level, idx, n, h) AS (SELECT g, 0, idx, n, h FROM base UNION ALL {up.format(t="low")}),
sub AS (SELECT g, level AS depth, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1),
high(g, level, idx, n, h) AS (SELECT '', 0, place, n, subroot FROM sub UNION ALL {up.format(t="high")}),
root AS (SELECT level AS height, h AS root FROM high WHERE n = 1),
node AS (SELECT g, level, idx, n, h FROM low WHERE n > 1 UNION ALL SELECT s.g, s.depth + h.level, h.idx, h.n, h.h FROM high h CROSS JOIN sub s WHERE h.n > 1),
way AS (SELECT b.g, b.idx AS leaf, l.level, CASE WHEN l.level < s.depth THEN b.idx // (3 ** l.level)::BIGINT ELSE s.place // (3 ** (l.level - s.depth))::BIGINT END AS idx
  FROM base b JOIN sub s USING (g) CROSS JOIN root r JOIN (SELECT unnest(range(40)) AS level) l ON l.level < s.depth + r.height),
side AS (SELECT w.g, w.leaf, w.level, coalesce(string_agg(k.h, '' ORDER BY k.idx) FILTER (k.idx < w.idx), '') AS lefts, coalesce(string_agg(k.h, '' ORDER BY k.idx) FILTER (k.idx > w.idx), '') AS rights
  FROM way w JOIN node k ON k.g = w.g AND k.level = w.level AND k.idx // 3 = w.idx // 3 GROUP BY ALL),
fold(g, leaf, level, h) AS (SELECT g, idx, 0, coalesce(bad, h) FROM base UNION ALL
  SELECT f.g, f.leaf, f.level + 1, sha256(s.lefts || f.h || s.rights) FROM fold f JOIN side s ON s.g = f.g AND s.leaf = f.leaf AND s.level = f.level),
proof AS (SELECT g, leaf, string_agg(lefts || rights, '' ORDER BY level) AS p FROM side GROUP BY g, leaf),
ends AS (SELECT g, leaf, arg_max(h, level) AS folded_root FROM fold GROUP BY g, leaf)
SELECT b.doc_id, b.h AS leaf, s.subroot, r.root, sha256(coalesce(p.p, '')) AS proof_sha256, e.folded_root, e.folded_root = r.root AS verified
FROM base b JOIN sub s USING (g) CROSS JOIN root r JOIN ends e ON e.g = b.g AND e.leaf = b.idx LEFT JOIN proof p ON p.g = b.g AND p.leaf = b.idx"""
