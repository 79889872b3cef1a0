"""Journal records replayed in their order, without going through them one by one.

A step takes a file from a path (move, copy, force, drop) if one is there and, for move and copy, no other is at the target. So whether a
path holds a file after a step hangs on what its two paths held before: after a move the source does iff both did, the target iff one
did. These values form a graph whose edges lead to the step that touched the path last. A value with one known neutral side is the other
side's value: such pointers are shortened by jumping, so a chain of n records takes log n rounds; only values that hang on two open ones
wait. What content a path ends with is found by jumping along the steps that carried it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.operators import ranges as G

#: Kinds of steps: force replaces what is at the target, drop has no target.
MOVE, COPY, FORCE, DROP = "move", "copy", "force", "drop"


def _spread(table: DataFrame) -> DataFrame:
    """A side of a join that grows with the journal: never sent through the driver, however few bytes its files seem to have."""
    return table.hint("merge")


def _settled(op: Column, x: Column, y: Column) -> Column:
    """The value of (x and y) or (x or y), null while it is open."""
    return F.when(op == "and", F.when(~F.coalesce(x, F.lit(True)) | ~F.coalesce(y, F.lit(True)), F.lit(False)).when(x & y, F.lit(True))).otherwise(F.when(F.coalesce(x, F.lit(False)) | F.coalesce(y, F.lit(False)), F.lit(True)).when(~x & ~y, F.lit(False)))


def _resolve(nodes: DataFrame) -> DataFrame:
    """(id, val) of nodes (id, op, xv, xr, yv, yr): each side has a value v or refers to another node r; the graph has no circle."""
    ways = lambda t: t.withColumn("val", _settled(F.col("op"), F.col("xv"), F.col("yv"))).withColumn("to", F.when(F.col("val").isNull(), F.when(F.col("xr").isNull() | (F.col("xr") == F.col("yr")), F.col("yr")).when(F.col("yr").isNull(), F.col("xr"))))
    nodes = G.stored(ways(nodes), "nodes")
    while not nodes.where("val is null").isEmpty():
        seen = nodes.select("id", "val", "to")
        for side in "xy":
            r, v = f"{side}r", f"{side}v"
            of = seen.select(F.col("id").alias(r), F.col("val").alias("_v"), F.col("to").alias("_to"))
            nodes = nodes.join(_spread(of), r, "left").withColumns({v: F.coalesce(v, "_v"), r: F.when(F.col("_v").isNull(), F.coalesce("_to", r))}).drop("_v", "_to")
        nodes = G.stored(ways(nodes.drop("val", "to")), "nodes")
    return nodes.select("id", "val")


def _outcomes(manifest: DataFrame, steps: DataFrame) -> DataFrame:
    """steps with ok: whether each was done, replayed in order of seq."""
    touch = steps.select("seq", F.explode(F.array(F.struct(F.lit(0).alias("role"), F.col("frm").alias("path")), F.struct(F.lit(1).alias("role"), F.col("to").alias("path")))).alias("t")).select("seq", "t.role", "t.path").where("path is not null")
    touch = G.with_previous(G.ranged(touch, ["path", "seq"]), ["path"], ["seq", "role"])
    first = F.col("previous").isNull()
    here = manifest.select(F.col("rel_path").alias("path"), F.lit(True).alias("there")).distinct()
    at = touch.join(_spread(here), "path", "left").select("seq", "role", F.when(first, F.coalesce("there", F.lit(False))).alias("v"), (F.col("previous.seq") * 2 + F.col("previous.role")).alias("r"))
    side = lambda k, f: F.max(F.when(F.col("role") == k, F.col(f)))
    known = at.groupBy("seq").agg(side(0, "v").alias("xv"), side(0, "r").alias("xr"), side(1, "v").alias("yv"), side(1, "r").alias("yr"))
    rows = G.stored(steps.join(_spread(known), "seq").withColumn("yv", F.when(F.col("kind") == DROP, F.lit(False)).otherwise(F.col("yv"))), "steps")
    open_ = rows.where("xr is not null or yr is not null")
    if not open_.isEmpty():
        flag = lambda v: F.lit(v).cast("boolean")
        x, y = [F.col("xv"), F.col("xr")], [F.col("yv"), F.col("yr")]
        none = [flag(None), F.lit(None).cast("long")]
        gone, same = [flag(False), none[1]], [flag(True), none[1]]
        source = F.when(F.col("kind") == MOVE, F.struct(*_named(x, y))).when(F.col("kind") == COPY, F.struct(*_named(x, same))).otherwise(F.struct(*_named(gone, gone)))
        node = lambda role, op, sides: rows.where(F.lit(role == 0) | (F.col("kind") != DROP)).select((F.col("seq") * 2 + role).alias("id"), F.lit(op).alias("op"), sides.alias("s")).select("id", "op", "s.*")
        found = _resolve(node(0, "and", source).union(node(1, "or", F.struct(*_named(x, y)))))
        for s in "xy":
            rows = rows.join(_spread(found.select(F.col("id").alias(f"{s}r"), F.col("val").alias("_v"))), f"{s}r", "left").withColumn(f"{s}v", F.coalesce(f"{s}v", "_v")).drop("_v")
    free = F.col("kind").isin(DROP, FORCE) | ~F.col("yv")
    return rows.select(*steps.columns, (F.col("xv") & free).alias("ok"))


def _named(x: list[Column], y: list[Column]) -> list[Column]:
    return [c.alias(n) for c, n in zip([*x, *y], ["xv", "xr", "yv", "yr"], strict=True)]


def replay(manifest: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the manifest after the steps, the steps with ok) for steps (seq, kind, frm, to, ...), no two of one seq.

    Equal to going through them by seq: a step is done if its frm is there and, for move and copy, its to isn't. A manifest without
    repeated paths keeps that property. Steps with a null path do nothing; a step from a path to itself isn't done.
    """
    real = F.col("frm").isNotNull() & (F.col("to").isNotNull() | (F.col("kind") == DROP)) & ~F.col("frm").eqNullSafe(F.col("to"))
    done = G.stored(_outcomes(manifest, steps.where(real)).unionByName(steps.where(~real).withColumn("ok", F.lit(False))), "outcomes")
    ok = done.where("ok")
    reads = F.struct(F.when(F.col("kind") == COPY, F.lit("read")).otherwise("out").alias("event"), F.col("frm").alias("path"))
    events = ok.select("seq", F.explode(F.array(reads, F.struct(F.lit("in").alias("event"), F.col("to").alias("path")))).alias("e")).select("seq", "e.event", "e.path").where("path is not null")
    events = G.stored(G.with_previous(G.ranged(events, ["path", "seq"]), ["path"], ["seq"]), "events")
    # the content that a step carries is that of the step before at its source, or what lay there at first
    carried = G.stored(events.where("event <> 'in'").select("seq", F.when(F.col("previous").isNull(), F.col("path")).alias("root"), F.col("previous.seq").alias("up")), "carried")
    while not carried.where("root is null").isEmpty():
        above = carried.select(F.col("seq").alias("up"), F.col("root").alias("_root"), F.col("up").alias("_up"))
        carried = G.stored(carried.join(_spread(above), "up", "left").select("seq", F.coalesce("root", "_root").alias("root"), F.when(F.coalesce("root", "_root").isNull(), F.col("_up")).alias("up")), "carried")
    last = events.where("event <> 'read'").groupBy("path").agg(F.max_by("event", "seq").alias("event"), F.max("seq").alias("seq"))
    new = last.where("event = 'in'").join(_spread(carried.select("seq", "root")), "seq").select(F.col("path").alias("_to"), F.col("root").alias("rel_path"))
    name = F.element_at(F.split("_to", "/"), -1)
    came = manifest.join(_spread(new), "rel_path").withColumns({"rel_path": F.col("_to")} | ({"name": name} if "name" in manifest.columns else {})).select(manifest.columns)
    return manifest.join(_spread(last.select(F.col("path").alias("rel_path"))), "rel_path", "left_anti").select(manifest.columns).union(came), done
