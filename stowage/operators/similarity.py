"""Perceptual-hash neighbours and groups, face vectors and photo categories."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions import columns as K
from stowage.functions import rules as R
from stowage.operators.components import connected_components
from stowage.operators.hamming import near_hashes
from stowage.operators.ranges import stored
from stowage.operators.vectors import best_match
from stowage.plans import planners as P

#: Bytes of a registry of people that are sent to all tasks.
SENT = 8 << 20


def hamming_pairs(rows: DataFrame, d: int = R.PHOTO_DUP, block: str | None = None) -> DataFrame:
    """Pairs a < b of ids (walk_seq) whose hashes differ in at most d bits; null hashes pair with nothing.

    Distinct hashes are paired (see near_hashes), so blank pictures that share a hash don't meet each other there; the ids of equal and
    near hashes are joined in afterwards. With block, only pairs of the same block.
    """
    key = [F.col(block).alias("block")] if block else [F.lit(0).alias("block")]
    ids = rows.where("phash is not null").select("walk_seq", "phash", *key)
    distinct = ids.select("phash", "block").distinct()
    near = near_hashes(distinct, d)
    near = near.union(distinct.select("block", "phash", "phash"))
    left, right = ids.select("block", F.col("phash").alias("pa"), F.col("walk_seq").alias("x")), ids.select("block", F.col("phash").alias("pb"), F.col("walk_seq").alias("y"))
    pairs = near.join(left, ["block", "pa"]).join(right, ["block", "pb"]).where((F.col("pa") != F.col("pb")) | (F.col("x") < F.col("y")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), K.hamming(F.col("pa"), F.col("pb")).alias("bits"))


def near_duplicate_groups(rows: DataFrame, d: int = R.PHOTO_DUP) -> DataFrame:
    """Single-linkage groups of two or more: walk_seq, group_id (its least id). Equal hashes are one node of the graph."""
    distinct = rows.where("phash is not null").groupBy("phash").agg(F.min("walk_seq").alias("walk_seq"))
    found = connected_components(hamming_pairs(distinct, d).select("a", "b"))
    out = rows.where("phash is not null").join(distinct.withColumnRenamed("walk_seq", "node"), "phash").join(found, "node", "left")
    out = out.select("walk_seq", F.coalesce("component", "node").alias("group_id"))
    return out.join(out.groupBy("group_id").count().where("count > 1").select("group_id"), "group_id", "left_semi").select("walk_seq", "group_id")


def near_duplicate_sizes(groups: DataFrame, files: DataFrame) -> DataFrame:
    """Per group: n, keep (the largest file, first by path), extra_kb of the others."""
    rows = groups.join(files.select("walk_seq", "rel_path", "size"), "walk_seq").withColumn("kb", F.floor(F.col("size") / 1024))
    w = Window.partitionBy("group_id").orderBy(F.desc("size"), "rel_path")
    rows = rows.withColumn("r", F.row_number().over(w))
    return rows.groupBy("group_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("r") == 1, F.col("rel_path"))).alias("keep"), F.coalesce(F.sum(F.when(F.col("r") > 1, F.col("kb"))), F.lit(0)).cast("long").alias("extra_kb"))


def leader_groups(rows: DataFrame, d: int) -> DataFrame:
    """walk_seq, leader: in order of id, each row joins the first leader within d bits or becomes one.

    Rows of an equal hash follow the first of them, so only that one takes part in the rounds.

    The leaders are the lexicographically first independent set of the pair graph. In each round the open rows without a smaller open
    neighbour lead; their larger neighbours are led, and the pairs of both are dropped. Rows never led are leaders.
    """
    firsts = stored(rows.where("phash is not null").groupBy("phash").agg(F.min("walk_seq").alias("walk_seq")), "firsts")
    pairs = stored(hamming_pairs(firsts, d).select("a", "b"), "pairs")
    live, led = pairs, pairs.select(F.col("b").alias("id")).limit(0)
    while not live.isEmpty():
        heads = stored(live.select("a").distinct().join(live.select(F.col("b").alias("a")).distinct(), "a", "left_anti"), "heads")
        now = stored(live.join(heads, "a", "left_semi").select(F.col("b").alias("id")).distinct(), "led")
        live = live.join(heads, "a", "left_anti").join(now.withColumnRenamed("id", "a"), "a", "left_anti").join(now.withColumnRenamed("id", "b"), "b", "left_anti")
        live, led = stored(live, "live"), led.union(now)
    first = pairs.join(led.withColumnRenamed("id", "a"), "a", "left_anti").join(led.withColumnRenamed("id", "b"), "b", "left_semi").groupBy(F.col("b").alias("walk_seq")).agg(F.min("a").alias("of"))
    found = firsts.join(first, "walk_seq", "left").select("phash", F.coalesce("of", "walk_seq").alias("leader"))
    return rows.select("walk_seq", "phash").join(found, "phash").select("walk_seq", "leader")


def leader_duplicates(rows: DataFrame, d: int = R.PHOTO_DUP) -> DataFrame:
    """walk_seq, leader, is_dup: of each leader's group all but the best (focus * max(1, pixels), first on ties) are duplicates."""
    # either is read more than once, here and by a second pass over what the first leaves
    rows = stored(rows.select("walk_seq", "phash", (F.col("focus") * F.greatest(F.lit(1), F.col("pixels"))).alias("worth")), "rows")
    groups = stored(leader_groups(rows, d).join(rows.select("walk_seq", "worth"), "walk_seq"), "groups")
    best = groups.groupBy("leader").agg(F.min_by("walk_seq", F.struct(-F.col("worth"), "walk_seq")).alias("best"))
    return groups.join(best, "leader").select("walk_seq", "leader", (F.col("walk_seq") != F.col("best")).alias("is_dup"))


def duplicate_and_similar(rows: DataFrame) -> DataFrame:
    """walk_seq, is_dup, is_similar: a second pass with the wider distance over what the first leaves."""
    dup = leader_duplicates(rows, R.PHOTO_DUP).select("walk_seq", "is_dup")
    left = rows.join(dup.where("not is_dup").select("walk_seq"), "walk_seq", "left_semi")
    similar = leader_duplicates(left, R.PHOTO_SIMILAR).select("walk_seq", F.col("is_dup").alias("is_similar"))
    return dup.join(similar, "walk_seq", "left").select("walk_seq", "is_dup", F.coalesce("is_similar", F.lit(False)).alias("is_similar"))


def people_vectors(faces: DataFrame) -> DataFrame:
    """label, vec: the mean of each person's unit vectors, made unit again."""
    flat = faces.where("label is not null").select("label", F.posexplode(K.unit(F.col("embedding"))).alias("pos", "x"))
    mean = flat.groupBy("label", "pos").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vec"))
    return mean.select("label", K.unit(F.col("vec")).alias("vec"))


def nearest_person(faces: DataFrame, people: DataFrame, least: float = R.FACE_NAME) -> DataFrame:
    """vec_id, label, sim: the person most like the face, if alike enough. people: (label, vec), a registry of any size: one of SENT bytes
    at most is sent as one row of arrays, a larger one is met in blocks (see best_match)."""
    people = stored(people.where("vec is not null").select("label", "vec"), "people")
    own = faces.select("vec_id", K.unit(F.col("embedding")).alias("v")).where("v is not null")
    if (people.agg(F.sum(F.size("vec") * 8 + 16)).first()[0] or 0) > SENT:
        found = best_match(own.select(F.col("vec_id").alias("id"), F.col("v").cast("array<double>").alias("v")), people.select(F.col("label").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("v")), least)
        return found.select(F.col("id").alias("vec_id"), F.col("match").cast(people.schema["label"].dataType).alias("label"), "sim")
    known = people.agg(F.array_sort(F.collect_list(F.struct("label", "vec"))).alias("people"))
    scored = F.transform("people", lambda p: F.struct(F.round(K.cosine(F.col("v"), p["vec"]), 6).alias("sim"), (-p["label"]).alias("order"), p["label"].alias("label")))
    best = own.join(F.broadcast(known), F.lit(True)).select("vec_id", F.array_max(scored).alias("b"))
    return best.where(F.col("b.sim") >= least).select("vec_id", F.col("b.label").alias("label"), F.col("b.sim").alias("sim"))


def _in_order(vectors: np.ndarray, threshold: float, at_once: int = 256) -> np.ndarray:
    """The cluster of each vector, in order: that whose sum so far is most alike (the first at ties), if enough, else a new one.

    A block of vectors is held against all sums at once; sums that the block itself changes or makes are looked at again one by one.
    A vector with parts that aren't finite is alike to none.
    """
    vectors = np.where(np.isfinite(vectors).all(1, keepdims=True), vectors, 0.0)
    found = np.zeros(len(vectors), np.int64)
    sums = np.zeros((at_once, vectors.shape[1]))
    units, made = np.zeros_like(sums), 0
    for lo in range(0, len(vectors), at_once):
        block = vectors[lo : lo + at_once]
        while made + len(block) > len(sums):
            sums, units = np.concatenate([sums, np.zeros_like(sums)]), np.concatenate([units, np.zeros_like(units)])
        sims = block @ units[:made].T
        changed: dict[int, int] = {}  # sum: its place in own
        own = np.zeros((len(block), vectors.shape[1]))
        for i, v in enumerate(block):
            tops = [(float(sims[i].max()), -int(sims[i].argmax()))] if made and sims.shape[1] else []
            if changed:
                again, names = own[: len(changed)] @ v, np.fromiter(changed, np.int64)
                tops.append((float(again.max()), -int(names[again == again.max()].min())))
            top, best = max(tops, default=(-np.inf, 0))
            best = -best
            if top < threshold:
                best, made = made, made + 1
            sums[best] += v
            units[best] = sums[best] / (np.linalg.norm(sums[best]) or 1)
            own[changed.setdefault(best, len(changed))] = units[best]
            if best < sims.shape[1]:
                sims[:, best] = -np.inf
            found[lo + i] = best
    return found


def greedy_clusters(faces: DataFrame, block: str, threshold: float = R.FACE_CLUSTER) -> DataFrame:
    """Order-true centroid clustering within each block (an album or day): vec_id, block, cluster. Blocks must fit a task."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        return pd.DataFrame({"vec_id": pdf["vec_id"], "block": str(key[0]), "cluster": _in_order(np.stack(pdf["v"].to_list()).astype(float), threshold)})

    rows = faces.select("vec_id", F.col(block).alias("b"), K.unit(F.col("embedding")).alias("v")).where("v is not null")
    return rows.groupBy("b").applyInPandas(run, "vec_id long, block string, cluster long")


def photo_category(enabled: set[str] | None = None) -> Column:
    """The first enabled bucket whose flag holds; null if the bucket of the number of faces is off."""
    on = lambda k: F.lit(enabled is None or k in enabled)
    name = R.PHOTO_FOLDERS
    by_faces = {"scenery": F.col("faces") == 0, "single": F.col("faces") == 1, "couple": F.col("faces") == 2, "group": F.col("faces") >= 3}
    flags = {"screenshot": F.col("is_screenshot"), "document": F.col("is_document"), "best": F.col("is_best"), "blurry": F.col("is_blurry"), "duplicate": F.col("is_dup"), "similar": F.col("is_similar")}
    return K.cases([(on(k) & cond, F.lit(name[k])) for k, cond in [*flags.items(), *by_faces.items()]])


def photo_flags(metrics: DataFrame, blur: float = R.PHOTO_BLUR, best: float = R.PHOTO_BEST) -> DataFrame:
    rows = metrics.withColumn("focus", F.round("focus", 1)).withColumn("quality", K.quality())
    shot = K.is_screenshot()
    document = (F.col("faces") == 0) & (F.col("saturation") < 22) & (F.col("brightness") > 185) & (F.col("edge") > 18) & ~shot
    return rows.withColumns({"is_screenshot": shot, "is_document": document, "is_blurry": F.col("focus") < blur, "is_best": F.col("quality") >= best})


def photo_categories(metrics: DataFrame, groups: DataFrame | None = None, enabled: set[str] | None = None, detail: bool = False) -> DataFrame:
    """walk_seq, quality, category of pictures with metrics; groups: walk_seq, is_dup, is_similar. detail: with the flags as well."""
    rows = photo_flags(metrics)
    rows = rows.join(groups, "walk_seq", "left") if groups is not None else rows
    rows = rows.withColumns({c: F.lit(False) for c in ("is_dup", "is_similar") if c not in rows.columns})
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_dup", "is_similar")})
    flags = ["focus", "faces", "is_blurry", "is_dup", "is_similar", "is_screenshot", "is_document"] if detail else []
    return rows.select("walk_seq", "quality", *flags, photo_category(enabled).alias("category"))


def photo_plan(files: DataFrame, metrics: DataFrame, enabled: set[str] | None = None, limit: int | None = None, policy=K.SafetyPolicy(), recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """(plan, items) of an inventory and its picture metrics (walk_seq, phash, focus, faces, ...; unreadable pictures have none).

    Pictures that aren't filed yet get flags, duplicate and similar marks if those buckets are on, and a category; films go straight to
    their folder if that bucket is on. limit: the first so many pictures by walk_seq. Items have a row for each, also without category.
    """
    on = lambda k: enabled is None or k in enabled
    there = P.eligible(files, policy, recursive).where(P.first_segment_not_in(list(R.PHOTO_FOLDERS.values())))
    pictures = there.where(K.is_image())
    pictures = pictures.orderBy("walk_seq").limit(limit) if limit else pictures
    pictures = pictures.select("walk_seq", "rel_path", "name", "size")
    rows = metrics.drop("name").join(pictures.select("walk_seq", "name"), "walk_seq")
    marks = None
    if on("duplicate"):
        marks = leader_duplicates(rows, R.PHOTO_DUP).select("walk_seq", "is_dup")
    if on("similar"):
        left = rows if marks is None else rows.join(marks.where("is_dup").select("walk_seq"), "walk_seq", "left_anti")
        similar = leader_duplicates(left, R.PHOTO_SIMILAR).select("walk_seq", F.col("is_dup").alias("is_similar"))
        marks = similar.withColumn("is_dup", F.lit(False)) if marks is None else marks.join(similar, "walk_seq", "left")
    found = photo_categories(rows, marks, enabled, detail=True)
    items = pictures.join(found, "walk_seq", "left").withColumn("video", F.lit(False))
    if on("video"):
        films = there.where(K.is_video()).select("walk_seq", "rel_path", "name", "size", F.lit(R.PHOTO_FOLDERS["video"]).alias("category"), F.lit(True).alias("video"))
        items = items.unionByName(films, allowMissingColumns=True)
    return P.moves(items.where("category is not null"), F.col("category"), F.col("category")), items


def cached(files: DataFrame, cache: DataFrame, keys: tuple = ("rel_path", "size", "mtime_epoch", "sig")) -> tuple[DataFrame, DataFrame]:
    """(rows with cached metrics, rows still to be computed)."""
    keys = list(keys)
    return files.join(cache, keys), files.join(cache.select(keys), keys, "left_anti")
