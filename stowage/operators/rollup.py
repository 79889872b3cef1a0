"""Folder rollups, totals and reclaimable space. Folder sums come from exploding each file's path prefixes, so one shuffle on the folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions import columns as K
from stowage.functions import rules as R
from stowage.operators import ranges as G
from stowage.plans import planners as P


def folder_rollup(files: DataFrame, depth: int = 3, cap_names: tuple = ()) -> DataFrame:
    """Per folder down to depth: level, name, kb, files, subs (immediate sub-folders). Below a folder named in cap_names nothing shows."""
    rows = P.ancestors(files, depth)
    if cap_names:
        above = F.slice("dir_segs", F.lit(1), F.col("level") - 1)
        rows = rows.where(~F.exists(above, lambda s: F.lower(s).isin([x.lower() for x in cap_names])))
    child = F.get("dir_segs", F.col("level"))
    first = rows.groupBy("folder", "level", child.alias("child")).agg(F.sum("size").alias("bytes"), F.count("*").alias("files"))
    out = first.groupBy("folder", "level").agg(F.floor(F.sum("bytes") / 1024).cast("long").alias("kb"), F.sum("files").alias("files"), F.count("child").alias("subs"))
    return out.select("folder", K.folder_of("folder").alias("parent"), "level", F.element_at(F.split("folder", "/"), -1).alias("name"), "kb", "files", "subs")


def root_meta(files: DataFrame) -> DataFrame:
    return P.with_names(files).agg(F.floor(F.sum("size") / 1024).cast("long").alias("root_kb"), F.count("*").alias("root_files"), F.count_if(F.col("depth") == 0).alias("root_loose"))


def dir_stats(files: DataFrame, folder: str) -> DataFrame:
    inside = files.where(F.col("rel_path").startswith(folder.rstrip("/") + "/"))
    return inside.agg(F.count("*").alias("files"), F.floor(F.coalesce(F.sum("size"), F.lit(0)) / 1024).cast("long").alias("kb"))


def level_counts(folders: DataFrame) -> DataFrame:
    return folders.agg(*(F.count_if(F.col("level") == i).alias(f"n_l{i}") for i in (1, 2, 3)), F.sum(F.when(F.col("level") == 1, F.col("kb"))).alias("kb"), F.sum(F.when(F.col("level") == 1, F.col("files"))).alias("files"))


def share_of_parent(folders: DataFrame) -> DataFrame:
    """kb as a percentage of the parent's (top level: of the largest top folder), at least 0.8 if there is any."""
    top = folders.where("level = 1").agg(F.max("kb").alias("top_kb"))
    up = folders.select(F.col("folder").alias("parent"), F.col("kb").alias("parent_kb"))
    rows = folders.join(up, "parent", "left").join(F.broadcast(top), F.lit(True), "left")
    base = F.when(F.col("level") == 1, F.col("top_kb")).otherwise(F.col("parent_kb"))
    share = F.when(F.col("kb") > 0, F.greatest(F.lit(0.8), F.when(base > 0, F.col("kb") * 100.0 / base).otherwise(F.lit(0.8)))).otherwise(F.lit(0.0))
    return rows.select("folder", "level", "kb", F.round(share, 4).alias("share"))


def tagged(folders: DataFrame) -> DataFrame:
    tag = K.folder_tag()
    return folders.select("folder", "level", "kb", tag.alias("tag"), K.folder_note(tag).alias("note"))


def of_tag(folders: DataFrame, tag: str) -> DataFrame:
    """The folders whose top folder has the tag; all of them for 'all'."""
    return folders if tag == "all" else folders.where(K.folder_tag(F.split("folder", "/")[0]) == tag)


def report(folders: DataFrame) -> DataFrame:
    """One row per top folder, largest first: name, kb, files, subs, cat, note, children (two levels of folders nested by kb). To be
    written as JSON or Parquet beside root_meta and level_counts."""
    node = F.struct("name", "kb", "files", "subs")
    third = folders.where("level = 3").groupBy("parent").agg(F.array_sort(F.collect_list(F.struct((-F.col("kb")).alias("order"), node.alias("node")))).alias("c"))
    second = folders.where("level = 2").join(third.withColumnRenamed("parent", "folder"), "folder", "left")
    below = F.transform(F.coalesce("c", F.array().cast(third.schema["c"].dataType)), lambda x: x["node"])
    second = second.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct((-F.col("kb")).alias("order"), F.struct("name", "kb", "files", "subs", below.alias("children")).alias("node")))).alias("d"))
    top = folders.where("level = 1").join(second.withColumnRenamed("parent", "folder"), "folder", "left")
    children = F.transform(F.coalesce("d", F.array().cast(second.schema["d"].dataType)), lambda x: x["node"])
    tag = K.folder_tag()
    return top.select("name", "kb", "files", "subs", tag.alias("cat"), K.folder_note(tag).alias("note"), children.alias("children")).orderBy(F.desc("kb"), "name")


def reclaimable_by_tag(folders: DataFrame) -> DataFrame:
    return tagged(folders.where("level = 1")).agg(F.coalesce(F.sum(F.when(F.col("tag").isin("reclaim", "extracted"), F.col("kb"))), F.lit(0)).alias("kb"))


def search_with_ancestors(folders: DataFrame, query: str) -> DataFrame:
    """Folders that match, or that a match lies below."""
    hit = folders.where(F.lower("name").contains(query.lower())).withColumn("segs", F.split("folder", "/"))
    up = hit.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("segs")), lambda i: F.array_join(F.slice("segs", F.lit(1), i), "/"))).alias("folder"))
    return folders.join(up, "folder", "left_semi")


def reclaim(files: DataFrame, as_of_epoch: int, policy=K.SafetyPolicy()) -> DataFrame:
    """What could be freed: copies, junk, and files both large and old (all of them counted; the total leaves these out)."""
    dup = P.duplicates(files, policy).agg(F.count("*").alias("dup_n"), F.coalesce(F.sum(F.floor(F.col("size") / 1024)), F.lit(0)).cast("long").alias("dup_kb"))
    junk = P.junk(files, policy).agg(F.count("*").alias("junk_n"), F.coalesce(F.sum(F.floor(F.col("size") / 1024)), F.lit(0)).cast("long").alias("junk_kb"))
    old = P.eligible(files, policy).where((F.col("size") >= R.RECLAIM_BYTES) & (F.col("mtime_epoch") != 0) & (F.col("mtime_epoch") < as_of_epoch - R.RECLAIM_DAYS * 86400) & (F.size("dir_segs") > 0))
    old = old.agg(F.count("*").alias("old_n"), F.coalesce(F.sum(F.floor(F.col("size") / 1024)), F.lit(0)).cast("long").alias("old_kb"))
    return dup.join(junk, F.lit(True)).join(old, F.lit(True)).withColumn("total_kb", F.col("dup_kb") + F.col("junk_kb"))


def large_old(files: DataFrame, as_of_epoch: int, top: int = 25, policy=K.SafetyPolicy()) -> DataFrame:
    rows = P.eligible(files, policy).where((F.col("size") >= R.RECLAIM_BYTES) & (F.col("mtime_epoch") != 0) & (F.col("mtime_epoch") < as_of_epoch - R.RECLAIM_DAYS * 86400))
    return rows.select("rel_path", "size", "mtime_epoch").orderBy(F.desc("size"), "rel_path").limit(top)


def change_signature(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("mtime_epoch").alias("newest"))


def sessions(captures: DataFrame, minutes: int = 40, by: str = "album", name_ordinals: bool = True) -> DataFrame:
    """Gap sessions per key: a new one starts after a gap of more than the minutes (2 at least). One row per session."""
    gap = max(2, minutes) * 60
    w = Window.partitionBy(by).orderBy("taken_at", "walk_seq")
    t = F.unix_timestamp("taken_at")
    rows = captures.withColumn("fresh", (F.coalesce(t - F.lag(t).over(w), F.lit(0)) > gap).cast("int"))
    rows = rows.withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(by, "session")
    rows = rows.withColumns({"k": F.row_number().over(own.orderBy("taken_at", "walk_seq")), "all": F.count("*").over(own)})
    middle = F.max(F.when(F.col("k") == F.floor(F.col("all") / 2) + 1, F.col("rel_path")))
    out = rows.groupBy(by, "session").agg(F.count("*").alias("n"), F.min("taken_at").alias("start_at"), F.max("taken_at").alias("end_at"), middle.alias("rep"))
    names = _session_name()
    cols = [by, "session", "n", "start_at", "end_at", "rep"]
    return out.select(*cols, *([names.alias("suggested")] if name_ordinals else []))


def timeline_sessions(captures: DataFrame, minutes: int = 40, by: tuple[str, ...] = ()) -> DataFrame:
    """As sessions, for one timeline of any length (or one per value of the columns by, however long): no key goes through one task.

    The timeline is stored in ranges; gaps at their borders, the numbers of sessions and the places of rows take one row per range. What a
    session holds is summed before it is shuffled, and its middle file is the row at its first place plus half its number. A null
    taken_at counts as 0, the first second of 1970.
    """
    gap, by = max(2, minutes) * 60, list(by)
    rows = captures.select(*by, "walk_seq", "rel_path", "taken_at", F.coalesce(F.unix_timestamp("taken_at"), F.lit(0)).alias("_t"))
    table = G.with_previous(G.ranged(rows, [*by, "_t", "walk_seq"]), by, ["_t"])
    fresh = F.col("previous").isNull() | (F.col("_t") - F.col("previous._t") > gap)
    table = G.stored(table.select(*by, "rel_path", "taken_at", "_part", "_at", fresh.cast("long").alias("fresh"), F.lit(1).cast("long").alias("one")), "gaps")
    placed = G.stored(G.with_running_sum(table, "fresh", "number", {"place": F.col("one")}), "placed")
    out = placed.groupBy(*by, "number").agg(F.count("*").alias("n"), F.min("taken_at").alias("start_at"), F.max("taken_at").alias("end_at"), F.min("place").alias("first"))
    out = G.stored(out.withColumn("place", F.col("first") + F.floor(F.col("n") / 2)), "sessions")
    out = out.join(placed.select("place", F.col("rel_path").alias("rep")), "place")
    if by:
        keys = [f"_k{i}" for i in range(len(by))]
        heads = out.groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True))).agg(F.min("number").alias("head"))
        out = out.join(heads, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys, strict=True)]).withColumn("session", F.col("number") - F.col("head"))
    else:
        out = out.withColumn("session", F.col("number") - 1)
    return out.select(*by, "session", "n", "start_at", "end_at", "rep", _session_name().alias("suggested"))


def _session_name() -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, R.SESSION_NAMES)), F.col("session").cast("int")), F.concat(F.lit("Session "), (F.col("session") + 1).cast("string")))


def compression_totals(results: DataFrame) -> DataFrame:
    """Over (path, before, after, converted): a result counts if it is smaller or was converted."""
    ok = (F.col("after") < F.col("before")) | F.col("converted")
    kb = lambda v: F.floor(F.coalesce(F.sum(F.when(ok, v)), F.lit(0)) / 1024).cast("long")
    out = results.agg(F.count_if(ok).alias("compressed"), F.count_if(~ok).alias("skipped"), kb(F.col("before")).alias("before_kb"), kb(F.col("after")).alias("after_kb"), kb(F.col("before") - F.col("after")).alias("saved_kb"))
    return out.withColumn("pct", F.when(F.col("before_kb") > 0, F.round(F.col("saved_kb") * 100.0 / F.col("before_kb"), 1)).otherwise(0.0))


def compression_estimate(results: DataFrame, all_files: DataFrame) -> DataFrame:
    """Savings measured on a part, scaled by bytes to all candidates."""
    ok = (F.col("after") < F.col("before")) | F.col("converted")
    part = results.agg(F.sum("before").alias("seen"), F.sum(F.when(ok, F.col("before") - F.col("after")).otherwise(0)).alias("saved"), F.avg(ok.cast("double")).alias("share"))
    total = all_files.agg(F.sum("size").alias("total"), F.count("*").alias("n"))
    return part.join(total, F.lit(True)).select("n", F.floor(F.col("saved") * F.col("total") / F.col("seen") / 1024).cast("long").alias("saved_kb"), F.floor(F.col("n") * F.col("share")).cast("long").alias("hits"))
