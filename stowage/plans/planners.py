"""Planners: pure functions from an inventory DataFrame to a plan DataFrame (kind, src, dst, reason, size, walk_seq)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions import columns as K
from stowage.functions import rules as R
from stowage.operators.components import use_checkpoint_dir
from stowage.operators.ranges import ranged, with_place
from stowage.operators.ranges import stored
from stowage.plans import manifest as M


def with_names(files: DataFrame) -> DataFrame:
    """Adds segs, dir_segs, dir, depth, ext and stem to an inventory (walk_seq, rel_path, name, size, ...)."""
    return files.withColumn("segs", K.segments()).withColumns({"dir_segs": F.slice("segs", 1, F.greatest(F.size("segs") - 1, F.lit(0))), "dir": K.folder_of(), "depth": K.depth_of(), "ext": K.ext_of(), "stem": K.stem_of()})


def eligible(files: DataFrame, policy: K.SafetyPolicy = K.SafetyPolicy(), recursive: bool = True) -> DataFrame:
    """Files a planner may move: not protected, and without recursion only those of the root."""
    rows = with_names(files)
    inside = F.size("dir_segs") > 0
    rows = rows.where(~policy.protected_file())
    return rows.where(~inside | ~policy.protected_dir(F.col("dir_segs"))) if recursive else rows.where(~inside)


def first_segment_not_in(names: list[str]) -> Column:
    return ~F.coalesce(F.get("segs", F.lit(0)).isin(names), F.lit(False))


def moves(rows: DataFrame, folder: Column, reason: Column) -> DataFrame:
    dst = F.when(folder == "", F.col("name")).otherwise(F.concat(folder, F.lit("/"), F.col("name")))
    return rows.select(F.lit("move").alias("kind"), F.col("rel_path").alias("src"), dst.alias("dst"), reason.alias("reason"), "size", "walk_seq")


def junk(files: DataFrame, policy=K.SafetyPolicy(), custom=K.CustomRules(), recursive: bool = True) -> DataFrame:
    rows = eligible(files, policy, recursive).where(first_segment_not_in([R.JUNK_REVIEW])).withColumn("why", K.junk_reason(custom=custom))
    return moves(rows.where("why is not null"), F.lit(R.JUNK_REVIEW), F.col("why"))


def by_type(files: DataFrame, policy=K.SafetyPolicy(), custom=K.CustomRules(), recursive: bool = True) -> DataFrame:
    rows = eligible(files, policy, recursive).where(first_segment_not_in(R.TOP_BUCKETS)).withColumn("category", K.category_of("ext", custom))
    return moves(rows, F.col("category"), F.col("category"))


def by_size(files: DataFrame, policy=K.SafetyPolicy(), recursive: bool = True) -> DataFrame:
    rows = eligible(files, policy, recursive).where(first_segment_not_in([t for _, t in R.TIERS])).withColumn("tier", K.size_tier())
    return moves(rows, F.col("tier"), F.col("tier"))


def by_date(files: DataFrame, by: str = "month", exif: DataFrame | None = None, policy=K.SafetyPolicy(), recursive: bool = True) -> DataFrame:
    """Images and videos into folders of their capture time (exif: rel_path, taken_at), else their modification time."""
    rows = eligible(files, policy, recursive).where(K.category_of().isin("Images", "Videos"))
    rows = rows.join(exif.select("rel_path", "taken_at"), "rel_path", "left") if exif is not None else rows.withColumn("taken_at", F.lit(None).cast("timestamp"))
    rows = rows.withColumn("sub", K.date_subpath(K.effective_time(F.col("taken_at"), F.col("mtime_epoch")), by))
    there = F.slice("segs", F.lit(1), F.size(F.split("sub", "/"))) == F.split("sub", "/")
    return moves(rows.where(~there), F.col("sub"), F.col("sub"))


def with_folders(plan: DataFrame, nested: bool = False) -> DataFrame:
    """The plan and a mkdir for each folder that its moves lead to (nested: and for each folder above it)."""
    folder = K.folder_of("dst")
    made = plan.where("kind = 'move'").select((F.explode(F.concat(M._prefixes(folder), F.array(folder))) if nested else folder).alias("src")).where("src <> ''").distinct()
    cols = {c: F.lit(None).cast(t) for c, t in plan.dtypes if c not in ("kind", "src")}
    return plan.unionByName(made.withColumns({"kind": F.lit("mkdir"), **cols}).select(plan.columns))


def by_location(files: DataFrame, gps: DataFrame, policy=K.SafetyPolicy(), recursive: bool = True, places: int | None = 3) -> DataFrame:
    """Images with coordinates (gps: walk_seq, lat, lon) into Places/<place>, rounded to so many decimals (None: not rounded)."""
    rows = eligible(files, policy, recursive).where(K.is_image() & first_segment_not_in(["Places"])).join(gps, "walk_seq").withColumn("place", K.place_key(places=places))
    return moves(rows, F.concat(F.lit("Places/"), F.col("place")), F.col("place"))


def location_counts(files: DataFrame, gps: DataFrame, policy=K.SafetyPolicy(), recursive: bool = True) -> DataFrame:
    """One row: total (images that get a place) and no_gps (images without coordinates)."""
    rows = eligible(files, policy, recursive).where(K.is_image() & first_segment_not_in(["Places"])).join(gps.select("walk_seq", F.lit(True).alias("has")), "walk_seq", "left")
    return rows.agg(F.count("has").alias("total"), F.count_if(F.col("has").isNull()).alias("no_gps"))


def flatten(files: DataFrame, policy=K.SafetyPolicy()) -> DataFrame:
    return moves(eligible(files, policy).where(F.size("dir_segs") > 0), F.lit(""), F.lit("flatten"))


def image_files(files: DataFrame, policy=K.SafetyPolicy(), recursive: bool = True) -> DataFrame:
    """Pictures that may be looked at and aren't filed in a photo folder yet."""
    return eligible(files, policy, recursive).where(K.is_image() & first_segment_not_in(list(R.PHOTO_FOLDERS.values())))


def compressible_files(files: DataFrame, heic: bool = False, policy=K.SafetyPolicy()) -> DataFrame:
    return eligible(files, policy).where(K.is_compressible(heic=heic) & first_segment_not_in(R.GENERATED_FOLDERS))


def ancestors(files: DataFrame, levels: int | None = None) -> DataFrame:
    """One row per file and folder above it (folder, level); root-level files give none."""
    n = F.size("dir_segs") if levels is None else F.least(F.size("dir_segs"), F.lit(levels))
    return with_names(files).where(F.size("dir_segs") > 0).withColumn("level", F.explode(F.sequence(F.lit(1), n))).withColumn("folder", F.array_join(F.slice("dir_segs", F.lit(1), F.col("level")), "/"))


def empty_folders(dirs: DataFrame, files: DataFrame, policy=K.SafetyPolicy()) -> DataFrame:
    """Folders (rel_path) without any file below, deepest first."""
    free = dirs.where(~policy.protected_dir(K.segments())).join(ancestors(files).select(F.col("folder").alias("rel_path")), "rel_path", "left_anti")
    return free.select(F.lit("rmdir").alias("kind"), F.col("rel_path").alias("src"), K.depth_of().alias("depth")).orderBy(F.desc("depth"), "src")


def remove_folders(dirs: DataFrame, policy=K.SafetyPolicy()) -> DataFrame:
    """What flatten ends with: every unprotected folder, deepest first."""
    return dirs.where(~policy.protected_dir(K.segments())).select(F.lit("rmdir").alias("kind"), F.col("rel_path").alias("src"), K.depth_of().alias("depth")).orderBy(F.desc("depth"), "src")


def _of_shared_size(files: DataFrame, policy) -> DataFrame:
    """Files that may have copies. The size filter comes before the digest, so digests of unique sizes are never needed (nor computed, if
    the column is lazy)."""
    rows = eligible(files, policy).where((F.col("size") > 0) & first_segment_not_in([R.DUP_REVIEW]))
    return rows.join(rows.groupBy("size").count().where("count > 1").select("size"), "size", "left_semi").where("sha1 is not null")


def _kept_first() -> Column:
    return F.struct("depth", F.length("rel_path").alias("length"), "walk_seq", "rel_path")


def duplicates_ranked(files: DataFrame, policy=K.SafetyPolicy()) -> DataFrame:
    """Files of equal size and digest with their rank: the shallowest, then shortest path, then first walked has 1 and is kept, the others 2."""
    return _ranked(_of_shared_size(files, policy), ["size", "sha1"], _kept_first())


def _ranked(rows: DataFrame, by: list[str], order: Column) -> DataFrame:
    """Rows of groups of two or more with n and rank: 1 for the group's first row by an order that ends with walk_seq, else 2. The first
    rows are found by an aggregate, which combines before the shuffle, so a group of any size is fine."""
    groups = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1")
    return rows.join(groups.select(*by, "n", F.col("first.walk_seq").alias("kept")), by).withColumn("rank", F.when(F.col("walk_seq") == F.col("kept"), 1).otherwise(2)).drop("kept")


def duplicates(files: DataFrame, policy=K.SafetyPolicy()) -> DataFrame:
    return moves(duplicates_ranked(files, policy).where("rank > 1"), F.lit(R.DUP_REVIEW), F.lit("duplicate"))


def duplicate_groups(files: DataFrame, top: int = 200, policy=K.SafetyPolicy()) -> DataFrame:
    """The largest groups: size, sha1, n, keep, wasted_kb, members (joined by |)."""
    rows = _of_shared_size(files, policy)
    largest = rows.groupBy("size", "sha1").agg(F.count("*").alias("n"), F.min(_kept_first())["rel_path"].alias("keep")).where("n > 1").orderBy(F.desc("size"), "sha1").limit(top)
    members = eligible(files, policy).where(first_segment_not_in([R.DUP_REVIEW])).select("size", "sha1", "rel_path").join(F.broadcast(largest), ["size", "sha1"])  # member lists only of these
    out = members.groupBy("size", "sha1", "n", "keep").agg(F.array_join(F.array_sort(F.collect_list("rel_path")), "|").alias("members"))
    return out.select("size", "sha1", "n", "keep", (F.floor(F.col("size") / 1024) * (F.col("n") - 1)).cast("long").alias("wasted_kb"), "members").orderBy(F.desc("size"), "sha1")


def similar_names(files: DataFrame, policy=K.SafetyPolicy(), recursive: bool = True) -> DataFrame:
    rows = eligible(files, policy, recursive).where(first_segment_not_in([R.SIMILAR_REVIEW])).withColumn("norm", K.similar_key(F.col("stem")))
    rows = stored(rows.select("rel_path", "name", "ext", "size", "walk_seq", "norm"), "keyed")  # the key takes eight passes: once is enough
    ranked = _ranked(rows, ["norm", "ext"], F.struct(F.length("name").alias("length"), "name", "walk_seq"))
    return moves(ranked.where("rank > 1"), F.lit(R.SIMILAR_REVIEW), F.col("norm"))


def cleanup(files: DataFrame, policy=K.SafetyPolicy(), custom=K.CustomRules()) -> DataFrame:
    """Junk, then duplicates, then type; a source goes to the first stage that claims it. Paths are taken to be unique."""
    rows = _claims(files, policy, custom).withColumn("stage", K.cases([(F.col(c), F.lit(i + 1)) for i, c in enumerate(("is_junk", "is_copy", "is_typed"))])).where("stage is not null")
    folder = F.element_at(F.array(F.lit(R.JUNK_REVIEW), F.lit(R.DUP_REVIEW), F.col("category")), F.col("stage"))
    reason = F.element_at(F.array(F.col("why"), F.lit("duplicate"), F.col("category")), F.col("stage"))
    return rows.select(F.lit("move").alias("kind"), F.col("rel_path").alias("src"), F.concat(folder, F.lit("/"), F.col("name")).alias("dst"), reason.alias("reason"), "size", "walk_seq", "stage")


def _claims(files: DataFrame, policy, custom) -> DataFrame:
    """The eligible files with what each stage of cleanup says of them: one pass, and a join with the copies."""
    rows = eligible(files, policy).withColumns({"why": K.junk_reason(custom=custom), "category": K.category_of("ext", custom)})
    copies = duplicates_ranked(files, policy).where("rank > 1").select("rel_path", F.lit(True).alias("is_copy"))
    junk_, typed = F.col("why").isNotNull() & first_segment_not_in([R.JUNK_REVIEW]), first_segment_not_in(R.TOP_BUCKETS)
    return rows.join(copies, "rel_path", "left").withColumns({"is_junk": junk_, "is_typed": typed, "is_copy": F.coalesce("is_copy", F.lit(False))})


def cleanup_folders(files: DataFrame, policy=K.SafetyPolicy(), custom=K.CustomRules()) -> DataFrame:
    """The mkdirs (kind, src) of cleanup: each stage makes its folders, also for files that an earlier stage has claimed."""
    each = [("is_junk", F.lit(R.JUNK_REVIEW)), ("is_copy", F.lit(R.DUP_REVIEW)), ("is_typed", F.col("category"))]
    made = F.array_compact(F.array(*(F.when(F.col(c), folder) for c, folder in each)))
    return _claims(files, policy, custom).select(F.explode(made).alias("src")).distinct().select(F.lit("mkdir").alias("kind"), "src")


def numbered(rows: DataFrame, order: list[Column], start: int) -> DataFrame:
    """A running number n in the given order, without one partition for all: ranks within ranges, plus each range's offset.

    The ranged rows are checkpointed with their part: evaluated twice, ranges may differ in number and borders.
    """
    use_checkpoint_dir(rows.sparkSession)
    ranged = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).checkpoint()
    offsets = ranged.groupBy("part").count().withColumn("offset", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = ranged.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    return inner.join(F.broadcast(offsets.select("part", "offset")), "part").withColumn("n", F.col("n") + F.col("offset") + (start - 1)).drop("part", "offset")


def rename(files: DataFrame, template: str = "{orig}", start: int = 1, pad: int = 3, only_ext: str = "", policy=K.SafetyPolicy(), recursive: bool = True) -> DataFrame:
    """New names by a template of {orig} {n} {seq} {date} {category} {parent} {ext}, numbered by lower-case name.

    Every file of the extension takes a number, also those whose name doesn't change. A name taken earlier in the plan within a folder
    gets the least free _k. Names can only clash within a folder, a stem without its last numbers and an extension: where all of such a
    cluster want one name they are numbered over ranges, and only clusters that mix such names go through Python.
    """
    rows = eligible(files, policy, recursive)
    if only_ext:
        rows = rows.where(F.col("ext") == only_ext.lower().lstrip("."))
    rows = numbered(rows, [F.lower("name"), F.col("walk_seq")], start)
    date = F.date_format(F.timestamp_seconds("mtime_epoch"), "yyyy-MM-dd")
    parent = F.coalesce(F.get("dir_segs", F.size("dir_segs") - 1), F.lit(""))
    number = K.zero_filled(F.col("n"), pad)
    base = K.safe_name(K.from_template(template, {"orig": F.col("stem"), "n": number, "seq": number, "date": F.coalesce(date, F.lit("")), "category": K.category_of(), "parent": parent, "ext": F.col("ext")}))
    rows = rows.withColumns({"base": base, "tail": F.when(F.col("ext") != "", F.concat(F.lit("."), F.element_at(F.split("name", r"\."), -1))).otherwise("")})
    rows = rows.where(F.lower(F.concat("base", "tail")) != F.lower("name"))
    rows = rows.withColumn("cluster", F.concat_ws("\0", "dir", F.regexp_replace(F.lower("base"), r"(_\d+)+$", ""), F.lower("tail")))
    crowd = rows.groupBy("cluster").agg(F.count("*").alias("all"), F.min(F.lower("base")).alias("least"), F.max(F.lower("base")).alias("most"), F.count_distinct(F.lower("base")).alias("names")).where("all > names")
    rows = rows.join(crowd, "cluster", "left")
    cols = ["rel_path", "dir", "size", "walk_seq", "n", "new"]
    plain = rows.where("all is null").withColumn("new", F.concat("base", "tail"))
    same = with_place(ranged(rows.where("least = most"), ["cluster", "n"]), ["cluster"], "k")
    same = same.withColumn("new", F.concat("base", F.when(F.col("k") > 0, F.concat(F.lit("_"), F.col("k").cast("string"))).otherwise(""), "tail"))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, new, next_ = set(), [], {}
        for base_, tail in zip(*(pdf.sort_values("n")[x] for x in ("base", "tail")), strict=True):
            name, k = base_ + tail, next_.get(base_.lower(), 0)
            while name.lower() in taken:
                k += 1
                name = f"{base_}_{k}{tail}"
            next_[base_.lower()] = k
            taken.add(name.lower())
            new.append(name)
        return pdf.sort_values("n").assign(new=new)[cols]

    mixed = rows.where("least <> most").select("cluster", "rel_path", "dir", "size", "walk_seq", "n", "base", "tail")
    mixed = mixed.groupBy("cluster").applyInPandas(settle, "rel_path string, dir string, size long, walk_seq long, n long, new string")
    out = plain.select(cols).unionByName(same.select(cols)).unionByName(mixed)
    dst = F.when(F.col("dir") == "", F.col("new")).otherwise(F.concat_ws("/", "dir", "new"))
    return out.select(F.lit("move").alias("kind"), F.col("rel_path").alias("src"), dst.alias("dst"), F.col("n").cast("string").alias("reason"), "size", "walk_seq")


def rename_sample(files: DataFrame, template: str, n: int = 6, **options) -> DataFrame:
    return rename(files, template, **options).orderBy(F.col("reason").cast("long")).limit(n)


def fix_extensions(files: DataFrame, heads: DataFrame, sort: bool = False, policy=K.SafetyPolicy(), recursive: bool = True) -> DataFrame:
    """Files without an extension get the one their bytes show. heads: rel_path, head, names (of a zip's entries, may be null)."""
    rows = eligible(files, policy, recursive).where("ext = ''").join(heads, "rel_path", "left").withColumn("found", K.detect_type())
    rows = rows.withColumn("found", F.when(F.col("found") == "zip", K.refine_zip(F.coalesce("names", F.array().cast("array<string>")))).otherwise(F.col("found"))).where("found is not null")
    rows = rows.withColumn("name", F.concat(F.rtrim("name", F.lit(".")), F.lit("."), F.col("found")))
    return moves(rows, K.category_of("found") if sort else F.col("dir"), F.col("found"))


def assignments(files: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(moves, skipped) of a user's table (rel_path, category): foreign paths are skipped, files already there dropped."""
    rows = with_names(files).join(chosen.select("rel_path", "category"), "rel_path")
    plan = moves(rows.where(F.col("dir") != F.col("category")), F.col("category"), F.col("category"))
    return plan, chosen.join(files.select("rel_path"), "rel_path", "left_anti")


PLANNERS: dict[str, Callable[..., DataFrame]] = {
    "junk": junk, "type": by_type, "size": by_size, "date": by_date, "location": by_location, "flatten": flatten, "duplicates": duplicates,
    "similar": similar_names, "cleanup": cleanup, "rename": rename, "fix_extensions": fix_extensions, "empty": empty_folders,
}


def without_folders(plan: DataFrame, folders: list[str]) -> DataFrame:
    """The plan without moves out of exactly these folders."""
    return plan.where((F.col("kind") != "move") | ~K.folder_of("src").isin(folders)) if folders else plan


def source_folders(plan: DataFrame) -> DataFrame:
    return plan.where("kind = 'move'").groupBy(K.folder_of("src").alias("folder")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "folder")


def summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("reason").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def counts(plan: DataFrame) -> DataFrame:
    kinds = {f"{k}s": F.count_if(F.col("kind") == k) for k in ("move", "mkdir", "rmdir")}
    return plan.agg(*(v.alias(k) for k, v in kinds.items()), F.count("*").alias("total"))


def preview(plan: DataFrame, n: int = 200) -> DataFrame:
    return plan.orderBy("walk_seq", "src").limit(n).withColumn("text", K.op_text())


def moved_summary(plan: DataFrame, n: int = 12) -> DataFrame:
    folder = K.folder_of("dst")
    return plan.where("kind = 'move'").groupBy(F.when(folder == "", "(root)").otherwise(folder).alias("folder")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "folder").limit(n)


def search(files: DataFrame, query: str, n: int = 300, policy=K.SafetyPolicy()) -> DataFrame:
    """Files whose name holds the query; protected folders are passed over. Sorted before it is cut off."""
    rows = with_names(files).where((F.size("dir_segs") == 0) | ~policy.protected_dir(F.col("dir_segs"))).where(F.lower("name").contains(query.lower()))
    return rows.select("rel_path", "name", "size").orderBy(F.lower("name"), "rel_path").limit(n)
