"""The life of a plan as table transforms: apply to the inventory, journal, verify, undo, redo, history and audit.

Store a plan before it is applied (a lazy plan could come out differently the second time).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions import columns as K
from stowage.operators.components import use_checkpoint_dir
from stowage.operators.ranges import stored
from stowage.plans.free_names import settle_alike
from stowage.plans.replay import COPY, DROP, FORCE, MOVE, replay

KEEP = 20


def _cluster(path: Column) -> tuple[Column, Column]:
    """(folder, name without numbers such as _1 before a dot or the end): paths of others can't clash with these, nor can their free names."""
    return K.folder_of(path), F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(_\d+)+(?=\.|$)", "")


def _free_name(path: str, taken: dict, known: dict) -> str:
    """The least free name base_i; known: up to which i a path's names are taken, as long as none of them is given up."""
    folder, slash, name = path.rpartition("/")
    dot = name.rfind(".")
    base, ext = (name[:dot], name[dot:]) if 0 < dot < len(name) - 1 else (name, "")
    i = known.get(path, 1)
    while f"{folder}{slash}{base}_{i}{ext}" in taken:
        i += 1
    known[path] = i
    return f"{folder}{slash}{base}_{i}{ext}"


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """Replays one name cluster in order. A row is a file that is there (op_seq -1), a leaving (gone) or an arrival."""
    there: dict = {}
    known: dict = {}
    out = []
    for r in pdf.sort_values(["op_seq", "gone"], ascending=[True, False]).itertuples():
        if r.op_seq < 0:
            there[r.path] = (r.size, r.sha1)
        elif r.gone:
            there.pop(r.path, None)
            known.clear()
        else:
            final, outcome = r.path, "moved"
            if r.path in there:
                if there[r.path] == (r.size, r.sha1) and r.sha1 is not None:
                    outcome = "merged"
                else:
                    final = _free_name(r.path, there, known)
            if outcome == "moved":
                there[final] = (r.size, r.sha1)
            out.append((r.op_seq, final, outcome))
    return pd.DataFrame(out, columns=["op_seq", "final", "outcome"])


def apply(files: DataFrame, ops: DataFrame, copy: bool = False) -> tuple[DataFrame, DataFrame]:
    """(new manifest, journal) of the ops (op_seq, kind, src, dst) over an inventory (walk_seq, rel_path, name, size, sha1, ...).

    In op order: an occupied target of the same bytes is merged (the source stays), of other bytes gives the mover the least free _i.
    A missing source is logged as such. Clusters of names that clash, where all arrivals want one path and no file leaves, get their
    numbers by ranks over ranges. Only clusters that mix wanted paths, or that files also leave, go through Python; they are replayed
    until no outcome changes, as a merged source that stays can block a name elsewhere. That ends, since an outcome hangs on earlier
    ops alone.
    """
    wanted = ops.where("kind = 'move' and src <> dst").select("op_seq", "src", "dst")
    asked = stored(wanted.join(files.select(F.col("rel_path").alias("src"), "size", "sha1"), "src", "left").select("op_seq", "src", "dst", "size", "sha1"), "asked")
    live, missing = asked.where("size is not null"), asked.where("size is null")
    key = lambda p: F.xxhash64(*_cluster(F.col(p)))  # noqa: E731  (two clusters that share a number are settled as one)
    now = files.select(key("rel_path").alias("k"), F.lit(-1).cast("long").alias("op_seq"), F.lit(False).alias("gone"), F.col("rel_path").alias("path"), "size", "sha1")
    came = live.withColumn("k", key("dst"))
    ends = came.select("k", F.lit(1).alias("n"), F.lit(0).alias("old")).union(now.select("k", F.lit(0), F.lit(1)))
    met = stored(ends.groupBy("k").agg(F.sum("n").alias("n"), F.max("old").alias("old")).where("n > 1 or (n = 1 and old = 1)").select("k"), "met")
    journal = _journal(came.join(met, "k", "left_anti").select("op_seq", "src", F.col("dst").alias("final"), F.lit("moved").alias("outcome")), copy)
    if not met.isEmpty():
        contested = stored(came.join(met, "k", "left_semi"), "contested")
        leave = live.select(key("src").alias("k"), "op_seq", F.lit(True).alias("gone"), F.col("src").alias("path"), "size", "sha1")
        leave = stored((leave.limit(0) if copy else leave).join(met, "k", "left_semi"), "leave")
        done = _contested(contested, stored(now.join(met, "k", "left_semi"), "now"), leave)
        journal = journal.union(_journal(contested.select("op_seq", "src").join(done, "op_seq"), copy))
    journal = stored(journal.union(missing.select("op_seq", F.lit("move"), "src", "dst", F.lit("missing"))), "journal")
    if copy:
        return files, journal
    moved = journal.where("outcome = 'moved'").select(F.col("src").alias("rel_path"), F.col("dst").alias("_to"))
    new = {"rel_path": F.coalesce("_to", "rel_path")}
    if "name" in files.columns:
        new["name"] = F.when(F.col("_to").isNull(), F.col("name")).otherwise(F.element_at(F.split("_to", "/"), -1))
    return files.join(moved, "rel_path", "left").withColumns(new).select(files.columns), journal


def _journal(done: DataFrame, copy: bool) -> DataFrame:
    return done.select("op_seq", F.lit("copy" if copy else "move").alias("op"), "src", F.col("final").alias("dst"), "outcome")


def _contested(came: DataFrame, now: DataFrame, leave: DataFrame) -> DataFrame:
    """(op_seq, final, outcome) of the arrivals of clusters that others want, too, or where files stand (now); leave: files that go."""
    arrive = came.select("k", "op_seq", F.lit(False).alias("gone"), F.col("dst").alias("path"), "size", "sha1")
    crowd = arrive.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("path").alias("paths")).join(now.select("k", F.lit(1).alias("old")).distinct(), "k", "left")
    hard = crowd.where("n > paths or old = 1").select("k")
    easy = arrive.join(hard, "k", "left_anti").select("op_seq", F.col("path").alias("final"), F.lit("moved").alias("outcome"))
    alike = stored(crowd.where("paths = 1 and (n > paths or old = 1)").select("k").join(leave.select("k").distinct(), "k", "left_anti"), "alike")
    ranked = stored(settle_alike(arrive.join(alike, "k", "left_semi"), now.join(alike, "k", "left_semi")), "ranked")
    hard = stored(hard.join(alike, "k", "left_anti"), "hard")
    stays = ranked.where("outcome = 'merged'").select("op_seq")
    while True:
        rows = arrive.union(now).union(leave.join(stays, "op_seq", "left_anti").select(arrive.columns))
        settled = stored(rows.join(hard, "k", "left_semi").groupBy("k").applyInPandas(_settle, "op_seq long, final string, outcome string").union(ranked), "settled")
        merged = settled.where("outcome = 'merged'").select("op_seq")
        if leave.isEmpty() or merged.exceptAll(stays).isEmpty() and stays.exceptAll(merged).isEmpty():
            return easy.union(settled)
        stays = merged


def verify(before: DataFrame, after: DataFrame, copies: int = 0) -> DataFrame:
    """One row: counts agree, and no content (size, digest) was lost."""
    lost = before.select("size", "sha1").exceptAll(after.select("size", "sha1")).agg(F.count("*").alias("lost"))
    return before.agg(F.count("*").alias("before")).join(after.agg(F.count("*").alias("after")), F.lit(True)).join(lost, F.lit(True)).withColumn("ok", (F.col("after") == F.col("before") + copies) & (F.col("lost") == 0))


def top_folder(path: str = "dst") -> Column:
    return F.when(F.col(path).contains("/"), F.split(path, "/")[0]).otherwise("")


def _undo_steps(journal: DataFrame) -> DataFrame:
    """Steps (seq, kind, frm, to, op_seq, last) that take the journal back, its last record first. A compress record has two: what was
    written goes (unless it is the backup), then the backup takes the original's place."""
    backup = F.col("backup") if "backup" in journal.columns else F.lit(None).cast("string")
    one = lambda i, kind, frm, to, last: F.struct((-2 * F.col("op_seq") + i).alias("seq"), F.lit(kind).alias("kind"), frm.alias("frm"), to.alias("to"), F.lit(last).alias("last"))
    none, src, dst = F.lit(None).cast("string"), F.col("src"), F.col("dst")
    squeezed = F.array(one(0, DROP, F.when(dst != backup, dst), none, False), one(1, FORCE, backup, src, True))
    steps = F.when(F.col("op") == "move", F.array(one(0, MOVE, dst, src, True))).when(F.col("op") == "copy", F.array(one(0, DROP, dst, none, True))).when(F.col("op") == "compress", squeezed)
    return journal.select("op_seq", F.explode(steps).alias("s")).select("s.*", "op_seq")


def undo_entry(manifest: DataFrame, journal: DataFrame, only_folders: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the manifest, the records undone, those that stay) when a journal is taken back record by record, the last first.

    A move goes back if its target is there and its source free at that moment, a copy's target is dropped. Of a compress record (src:
    the original, dst: what was written, backup: where the original went) what was written goes and the backup takes the original's
    place. Records are told apart by op_seq, which orders them. only_folders: just those whose target's top folder is one of these.
    """
    real = journal.where("op in ('move', 'copy', 'compress')")
    real = real.where("outcome = 'moved'") if "outcome" in journal.columns else real
    asked = real.where(top_folder().isin(only_folders)) if only_folders is not None else real
    manifest, done = replay(manifest, _undo_steps(asked))
    undone = done.where("ok and last").select("op_seq")
    return manifest, journal.join(undone, "op_seq", "left_semi"), journal.join(undone, "op_seq", "left_anti")


def undo(manifest: DataFrame, journal: DataFrame, only_folders: list[str] | None = None) -> DataFrame:
    """The manifest before the journal (see undo_entry)."""
    return undo_entry(manifest, journal, only_folders)[0]


def undo_folders(dirs: DataFrame, manifest: DataFrame, journal: DataFrame) -> DataFrame:
    """The folders (rel_path) left when those that the journal made (op mkdir, folder in dst) and that are empty now are taken away."""
    above = lambda rows: rows.select(F.explode(_prefixes(F.col("rel_path"))).alias("rel_path")).distinct()
    made = journal.where("op = 'mkdir'").select(F.col("dst").alias("rel_path")).distinct()
    kept = dirs.join(made, "rel_path", "left_anti").select("rel_path")
    used = above(manifest).union(above(kept)).distinct()
    return dirs.join(made.join(used, "rel_path", "left_anti"), "rel_path", "left_anti").select(dirs.columns)


def _prefixes(path: Column) -> Column:
    """The folders above a path, from the top."""
    segs = F.split(path, "/")
    return F.when(F.size(segs) > 1, F.transform(F.sequence(F.lit(1), F.size(segs) - 1), lambda i: F.array_join(F.slice(segs, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def redo(manifest: DataFrame, journal: DataFrame) -> DataFrame:
    """The manifest with the journal done again, record by record: moves and copies whose source is there and whose target is free at
    that moment. Compress records aren't done again."""
    rows = journal.where("op in ('move', 'copy')")
    rows = rows.where("outcome = 'moved'") if "outcome" in journal.columns else rows
    return replay(manifest, rows.select(F.col("op_seq").alias("seq"), F.when(F.col("op") == "copy", COPY).otherwise(MOVE).alias("kind"), F.col("src").alias("frm"), F.col("dst").alias("to")))[0]


def folder_records(dirs: DataFrame, before: DataFrame, after: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the folders (rel_path) after the ops, journal rows (op, src, dst)) of a plan that was applied: before and after are its manifests.

    A folder is made, and journalled, if it is new and was asked for (mkdir) or lies above a file's new place. A folder asked to go (rmdir,
    the deepest first, after all moves) goes if nothing is left below it: no file, and no folder that stays.
    """
    above = lambda t: t.select(F.explode(_prefixes(F.col("rel_path"))).alias("rel_path"))
    asked = ops.where("kind = 'mkdir'").select(F.col("src").alias("rel_path"))
    have = stored(dirs.select("rel_path").union(above(before)).distinct(), "folders")
    moved = after.select("rel_path").join(before.select("rel_path"), "rel_path", "left_anti")
    made = stored(asked.union(above(asked)).union(above(moved)).distinct().join(have, "rel_path", "left_anti"), "made")
    full, leave = have.union(made), ops.where("kind = 'rmdir'").select(F.col("src").alias("rel_path")).distinct()
    stay = full.join(leave, "rel_path", "left_anti")
    kept = above(after).union(above(stay)).distinct()
    gone = stored(full.join(leave, "rel_path", "left_semi").join(kept, "rel_path", "left_anti"), "gone")
    record = lambda t, op: t.select(F.lit(op).alias("op"), F.lit(None).cast("string").alias("src"), F.col("rel_path").alias("dst"))
    return full.join(gone, "rel_path", "left_anti"), record(made, "mkdir").union(record(gone, "rmdir"))


def restore_originals(manifest: DataFrame, backup: str) -> DataFrame:
    """Everything under the backup folder back to its place; what replaced it (the same name, or .jpg or .jpeg) goes."""
    prefix = backup.rstrip("/") + "/"
    kept = manifest.where(F.col("rel_path").startswith(prefix)).withColumn("to", F.substring(F.col("rel_path"), F.lit(len(prefix) + 1), F.length("rel_path")))
    base = F.regexp_replace("to", r"\.[^./]+$", "")
    gone = kept.select(F.explode(F.array("to", F.concat(base, F.lit(".jpg")), F.concat(base, F.lit(".jpeg")))).alias("rel_path")).distinct()
    rest = manifest.where(~F.col("rel_path").startswith(prefix)).join(gone, "rel_path", "left_anti").select(manifest.columns)
    return rest.union(kept.withColumns({"rel_path": F.col("to"), "name": F.element_at(F.split("to", "/"), -1)}).select(manifest.columns))


def history_append(history: DataFrame | None, journal: DataFrame, root: str, entry_id: str, ts: Column, label: str) -> DataFrame:
    """History rows (root, entry_id, ts, label, op_seq, op, src, dst): entries without a move aren't added, the last KEEP per root stay.

    The rows are checkpointed, so that the plan doesn't grow from entry to entry.
    """
    use_checkpoint_dir(journal.sparkSession)
    fresh = journal.where("outcome = 'moved'").select(F.lit(root).alias("root"), F.lit(entry_id).alias("entry_id"), ts.alias("ts"), F.lit(label).alias("label"), "op_seq", "op", "src", "dst")
    return _last_kept((fresh if history is None else history.unionByName(fresh)).checkpoint())


def _last_kept(rows: DataFrame) -> DataFrame:
    """The rows of the KEEP newest entries of each root."""
    entries = rows.select("root", "entry_id", "ts").distinct().withColumn("r", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("ts"), F.desc("entry_id"))))
    return rows.join(entries.where(F.col("r") <= KEEP).select("root", "entry_id"), ["root", "entry_id"], "left_semi")


def history_record(history: DataFrame | None, undone: DataFrame | None, journal: DataFrame, root: str, entry_id: str, ts: Column, label: str) -> tuple[DataFrame, DataFrame | None]:
    """(history with a new entry, see history_append; undone rows without the root's, as a new operation ends redoing). A journal without
    a move or copy adds no entry and leaves what may be redone."""
    if journal.where("outcome = 'moved'").isEmpty():
        return history_append(history, journal, root, entry_id, ts, label), undone
    return history_append(history, journal, root, entry_id, ts, label), None if undone is None else undone.where(F.col("root") != root)


def history_undone(history: DataFrame, undone: DataFrame | None, root: str, entry_id: str) -> tuple[DataFrame, DataFrame]:
    """(history without an entry, undone rows with it on top), where the manifest is kept elsewhere; see history_undo."""
    use_checkpoint_dir(history.sparkSession)
    here = (F.col("root") == root) & (F.col("entry_id") == entry_id)
    moved = history.where(here).withColumn("pos", F.lit(_top(undone, root)).cast("long"))
    return history.where(~here).checkpoint(), (moved if undone is None else undone.unionByName(moved)).checkpoint()


def _top(undone: DataFrame | None, root: str) -> int:
    """How many undone entries the root has had on its stack: the next one's pos."""
    found = None if undone is None else undone.where(F.col("root") == root).agg(F.max("pos").alias("pos")).first().pos
    return 0 if found is None else found + 1


def history_undo(history: DataFrame, undone: DataFrame | None, manifest: DataFrame, root: str, entry_id: str, only_folders: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifest, history, undone) after an entry of the root was taken back; pos orders what may be redone, the last first.

    A whole entry leaves the history for the undone rows, also the records that couldn't be taken back. With only_folders, records not
    taken back stay in the entry, and those taken back go on the stack as an entry of their own (`<id>/<pos>`); if none is left, the
    entry goes as a whole.
    """
    here = (F.col("root") == root) & (F.col("entry_id") == entry_id)
    entry = stored(history.where(here), "entry")
    manifest, back, left = undo_entry(manifest, entry, only_folders)
    pos, rest = _top(undone, root), history.where(~here)
    if only_folders is not None and not left.where("op in ('move', 'copy', 'compress')").isEmpty():
        history = rest.unionByName(left)
        moved = back.withColumn("entry_id", F.lit(f"{entry_id}/{pos}"))
    else:
        history, moved = rest, entry
    moved = moved.withColumn("pos", F.lit(pos).cast("long"))
    return manifest, stored(history, "history"), stored(moved if undone is None else undone.unionByName(moved), "undone")


def history_redo(history: DataFrame, undone: DataFrame, manifest: DataFrame, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifest, history, undone) after the root's entry undone last was done again; it becomes the newest of the history's last KEEP
    (its ts is 1 more than the newest, unless it is later). Nothing to redo: all as it was."""
    pos = _top(undone, root) - 1
    if pos < 0:
        return manifest, history, undone
    here = (F.col("root") == root) & (F.col("pos") == pos)
    entry = stored(undone.where(here).drop("pos"), "entry")
    newest = history.where(F.col("root") == root).agg(F.max("ts").alias("ts")).first().ts
    if newest is not None:
        entry = entry.withColumn("ts", F.when(F.col("ts") > newest, F.col("ts")).otherwise(F.lit(newest) + 1).cast(history.schema["ts"].dataType))
    return redo(manifest, entry), stored(_last_kept(history.unionByName(entry)), "history"), stored(undone.where(~here), "undone")


def history_list(history: DataFrame, undone: DataFrame | None = None) -> DataFrame:
    """root, entry_id, ts, label, moves, undoable (the root's newest entry), redoable (of undone entries the one undone last)."""
    entry = ["root", "entry_id", "ts", "label"]
    rows = history.groupBy(entry).agg(F.count("*").alias("moves"), F.lit(None).cast("long").alias("pos"))
    newest = rows.groupBy("root").agg(F.max(F.struct("ts", "entry_id")).alias("top"))
    rows = rows.join(newest, "root").withColumn("undoable", F.struct("ts", "entry_id") == F.col("top")).select(*entry, "moves", "undoable", F.lit(False).alias("redoable"))
    if undone is None:
        return rows
    back = undone.groupBy(entry).agg(F.count("*").alias("moves"), F.max("pos").alias("pos"))
    last = back.groupBy("root").agg(F.max("pos").alias("last"))
    return rows.union(back.join(last, "root").select(*entry, "moves", F.lit(False), F.col("pos") == F.col("last")))


def history_folders(history: DataFrame) -> DataFrame:
    return history.groupBy("root", "entry_id", top_folder().alias("folder")).agg(F.count("*").alias("n"))


def audit(journal: DataFrame) -> DataFrame:
    """Flat rows (src, dst) of what was done, for a CSV file."""
    return journal.where("outcome = 'moved'").select("op_seq", "src", "dst")


def recipe(files: DataFrame, planners: list) -> tuple[DataFrame, list[DataFrame]]:
    """A chain of planners: each plans over the inventory that the one before left; the last manifest and the journals."""
    journals = []
    for i, planner in enumerate(planners):
        files = stored(files, "manifest") if i else files  # it is read several times
        plan = planner(files)
        files, journal = apply(files, plan.select(F.col("walk_seq").alias("op_seq"), "kind", "src", "dst"))
        journals.append(journal)
    return files, journals
