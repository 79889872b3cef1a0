"""Edge rows of the rules, planners on small inventories, manifests, sources over a tree made here, and streams."""

import os
import random
import re
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.functions import columns as K
from stowage.functions import rules as R
from stowage.operators import rollup as U
from stowage.operators import similarity as S
from stowage.operators.components import connected_components
from stowage.plans import manifest as M
from stowage.plans import planners as P
from stowage.sources import content as C
from stowage.sources import inventory as I
from stowage.sources import pixels
from stowage.streaming import watch as W


def values(spark, rows, expr, schema="name string"):
    return [r[0] for r in spark.createDataFrame([(i, *((r,) if not isinstance(r, tuple) else r)) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(expr).collect()]


def inventory(spark, rows):
    """rows: (path, size, digest)."""
    return spark.createDataFrame([(i, p, p.rsplit("/", 1)[-1], s, 1704067200 + i, d) for i, (p, s, d) in enumerate(rows)], "walk_seq long, rel_path string, name string, size long, mtime_epoch long, sha1 string")


def test_extensions_and_stems(spark):
    names = [".jpg", "a.", "a..", "x.tar.gz", "NoExt", ".a.b", "É.JPG", ""]
    assert values(spark, names, K.ext_of()) == ["", "", "", "gz", "", "b", "jpg", ""]
    assert values(spark, names, K.stem_of()) == [".jpg", "a.", "a..", "x.tar", "NoExt", ".a", "É", ""]
    assert values(spark, [".jpg", "a"], K.lenient_ext()) == ["jpg", ""]


def test_tiers(spark):
    sizes = [0, 1048575, 1048576, 5242879, 5242880, 20971520, 52428799, 52428800]
    assert [t[0] for t in values(spark, sizes, K.size_tier(), "size long")] == list("55443221")


def test_junk(spark):
    rows = [("a.jpg", 0), ("~$x.docx", 1), ("X.TMP", 1), ("a.part", 1), ("a.foo", 1), ("a.txt", 1)]
    custom = K.CustomRules(junk=(".FOO",))
    assert values(spark, rows, K.junk_reason(custom=custom), "name string, size long") == ["zero-byte", "temp", ".tmp", ".part", ".foo", None]


def test_types_by_bytes(spark):
    heads = [bytes.fromhex(m) + b"...." for m, _ in R.MAGIC] + [b"\x00\x00\x00\x18ftypmp42", b"", b"ab"]
    assert values(spark, [bytearray(h) for h in heads], K.detect_type(), "head binary") == [e for _, e in R.MAGIC] + ["mp4", None, None]
    names = [["word/a"], ["xl/a"], ["ppt/a"], ["classes.dex"], ["xl/a", "word/a"], ["z"]]
    assert values(spark, names, K.refine_zip(), "names array<string>") == ["docx", "xlsx", "pptx", "apk", "docx", "zip"]


def test_similar_names_against_fixpoint(spark):
    pattern = re.compile(R.COPY_SUFFIX, re.I)

    def plain(s):
        t = s.strip()
        while (u := pattern.sub("", t).strip()) != t:
            t = u
        return (t or s).lower()

    rng = random.Random(3)
    stems = ["IMG (1)", "a - copy 2", "a_copy", "2024-01-05", " copy", "copy", "a (1) (2)", "A copies x"]
    stems += ["".join(rng.choice(["a", "B", " ", "-", "_", "copy", "copie", "(1)", "2", " copy"]) for _ in range(rng.randrange(1, 8))) for _ in range(500)]
    stems += ["a" + " (1)" * 15, "b" + "-1" * 40, "c" + " copy" * 20 + "_copy x" + " (2)" * 9]
    assert values(spark, stems, K.similar_key(F.col("name"))) == [plain(s) for s in stems]


def test_names_templates_and_places(spark):
    assert values(spark, ['a/b:*c', "  x   y. ", "..", ""], K.safe_name(F.col("name"))) == ["a_b_c", "x y", "file", "file"]
    assert values(spark, [5, 12345], K.zero_filled(F.col("n"), 3), "n long") == ["005", "12345"]
    assert values(spark, ["x"], K.from_template(" {orig}-{n} ", {"orig": F.lit("{n}"), "n": F.lit("7")})) == ["7-7"]
    assert values(spark, ["Ann Lee!", "??"], K.person_folder(F.col("name"))) == ["Ann_Lee", "Person"]
    assert values(spark, [(10.12345, -0.5)], K.place_key(), "lat double, lon double") == ["10.123_-0.5"]
    assert values(spark, ["Screen Shot 1", "SCR-1", "img"], K.is_screenshot()) == [True, True, False]
    assert values(spark, [5, 3000, 3 * 1024**2], K.human_size(), "kb long") == ["5 KB", "2.9 MB", "3.00 GB"]
    assert values(spark, ["DCIM", "WhatsApp", ".x", "Documents", "Backup1", "zzz"], K.folder_tag()) == ["media", "extracted", "system", "documents", "reclaim", "personal"]
    assert values(spark, ["my_ringtones", "old alarms", "android backup", "Alarms", "MIUI", ".config", "x"], K.folder_tag()) == ["personal", "personal", "reclaim", "system", "system", "system", "personal"]
    assert values(spark, ["media", "personal"], K.folder_note("name")) == ["Organised media library", "Personal / misc"]
    assert values(spark, [None], K.date_subpath(F.col("t")), "t timestamp") == ["Undated"]


def test_safety(spark):
    files = inventory(spark, [("Android/x", 1, "a"), ("a/Sent/b", 1, "b"), (".git/x", 1, "c"), ("Images", 1, "d"), (".nomedia", 1, "e"), ("MIUI/x", 1, "f"), ("ok/x", 1, "g"), ("mine/x", 1, "h")])
    kept = lambda **k: {r.rel_path for r in P.eligible(files, K.SafetyPolicy(**k)).collect()}
    assert kept() == {"Images", "ok/x", "mine/x"}
    assert kept(include_hidden=True, extra=("Mine",)) == {"Images", "ok/x", ".git/x"}
    assert {r.src for r in P.by_type(files).collect()} == {"ok/x", "mine/x"}  # a root file named like a bucket is passed over


def test_plans_are_idempotent_and_claim_once(spark):
    rng = random.Random(1)
    files = inventory(spark, [(f"f{i % 7}/n{i}{rng.choice(['.jpg', '.tmp', '.pdf', ''])}", rng.choice([0, 5, 7]), f"d{rng.randrange(6)}") for i in range(80)])
    for planner in (P.by_type, P.by_size):
        after, _ = M.apply(files, planner(files).withColumn("op_seq", F.col("walk_seq")))
        assert planner(after).count() == 0 and after.count() == 80
    plan = P.cleanup(files)
    assert plan.select("src").distinct().count() == plan.count()
    ranked = P.duplicates_ranked(files)
    assert ranked.where("rank = 1").count() == ranked.select("size", "sha1").distinct().count()


def test_rename_clashes(spark):
    files = inventory(spark, [("d/b.txt", 1, "x"), ("d/a.txt", 1, "y"), ("d/x_1.txt", 1, "z"), ("e/X.TXT", 1, "w")])
    got = {r.src: r.dst for r in P.rename(files, "x").collect()}
    assert got == {"d/a.txt": "d/x.txt", "d/b.txt": "d/x_1.txt", "d/x_1.txt": "d/x_2.txt"}
    assert [r.dst for r in P.rename_sample(files, "{n}-{orig}", 2).collect()] == ["d/001-a.txt", "d/002-b.txt"]


def test_numbers_over_several_ranges(spark):
    n = 120_000  # over 10 MB with the pad, about 1 MB of sort columns
    rows = spark.range(n, numPartitions=8).select((F.col("id") * 7919 % n).alias("k"), F.concat(*(F.sha2(F.concat(F.col("id").cast("string"), F.lit(x)), 256) for x in "ab")).alias("pad"))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = P.numbered(rows, [F.col("k")], 1)
        assert got.agg(F.count("*"), F.count_if(F.col("n") == F.col("k") + 1), F.count_distinct("pad")).first() == (n, n, n)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def brute_apply(files, ops):
    there, out = {p: (s, d) for p, s, d in files}, []
    for _, src, dst in ops:
        if src not in there:
            out.append((src, dst, "missing"))
        elif dst in there and there[dst] == there[src]:
            out.append((src, dst, "merged"))
        else:
            if dst in there:
                folder, slash, name = dst.rpartition("/")
                base, dot, ext = name.rpartition(".")
                base, ext = (base, dot + ext) if base and ext else (name, "")
                i = 1
                while f"{folder}{slash}{base}_{i}{ext}" in there:
                    i += 1
                dst = f"{folder}{slash}{base}_{i}{ext}"
            there[dst] = there.pop(src)
            out.append((src, dst, "moved"))
    return there, out


@pytest.mark.parametrize("seed", range(2))
def test_apply_against_replay_and_undo(spark, seed):
    rng = random.Random(seed)
    files = [(f"{a}/{n}.t", rng.choice([1, 2]), rng.choice("pq")) for a in "abcd" for n in ("x", "x_1", "y") if rng.random() < 0.8]
    ops = [(i, p, f"out/{p.split('/')[1]}") for i, (p, _, _) in enumerate(files)] + [(99, "no/file", "out/z")]
    manifest, journal = M.apply(inventory(spark, files), spark.createDataFrame([(i, "move", a, b) for i, a, b in ops], "op_seq long, kind string, src string, dst string"))
    there, log = brute_apply(files, ops)
    assert {r.rel_path: (r.size, r.sha1) for r in manifest.collect()} == there
    assert sorted((r.src, r.dst, r.outcome) for r in journal.collect()) == sorted(log)
    back = M.undo(manifest, journal)
    assert {r.rel_path for r in back.collect()} == {p for p, _, _ in files}
    assert {r.rel_path for r in M.redo(back, journal).collect()} == set(there)
    assert M.verify(inventory(spark, files), manifest).first().ok
    assert {r.rel_path for r in M.undo(manifest, journal, ["elsewhere"]).collect()} == set(there)


def test_history_and_restore(spark):
    journal = spark.createDataFrame([(1, "move", "a", "Images/a", "moved"), (2, "move", "b", "b2", "merged")], "op_seq long, op string, src string, dst string, outcome string")
    h = None
    for i in range(22):
        h = M.history_append(h, journal, "/r", f"e{i:02d}", F.lit(float(i)), "type")
    assert h.count() == M.KEEP and M.history_list(h).where("undoable").first().entry_id == "e21"
    assert M.history_folders(h).where("folder = 'Images'").count() == M.KEEP
    files = inventory(spark, [("Originals_Backup/p/a.png", 5, "x"), ("p/a.jpg", 2, "y"), ("p/b.png", 1, "z")])
    older, undone = M.history_undone(h, None, "/r", "e21")
    older, undone = M.history_undone(older, undone, "/r", "e20")
    listed = {r.entry_id: (r.undoable, r.redoable) for r in M.history_list(older, undone).collect()}
    assert listed["e19"] == (True, False) and listed["e20"] == (False, True) and listed["e21"] == (False, False) and len(listed) == M.KEEP
    assert {r.rel_path for r in M.restore_originals(files, "Originals_Backup").collect()} == {"p/a.png", "p/b.png"}


def test_undo_and_redo_of_copies_compressions_and_folders(spark):
    files = inventory(spark, [("a/x", 1, "p"), ("b/y.jpg", 2, "q"), ("Originals_Backup/b/y.png", 9, "r"), ("c/x", 1, "p")])
    journal = spark.createDataFrame([(1, "copy", "a/x", "c/x", "moved", None), (2, "compress", "b/y.png", "b/y.jpg", "moved", "Originals_Backup/b/y.png"), (3, "mkdir", None, "c", "made", None), (4, "mkdir", None, "d/e", "made", None), (5, "mkdir", None, "b", "made", None)], "op_seq long, op string, src string, dst string, outcome string, backup string")
    back = M.undo(files, journal)
    paths = lambda m: {r.rel_path for r in m.collect()}
    assert paths(back) == {"a/x", "b/y.png"}
    assert paths(M.redo(back.where("rel_path = 'a/x'"), journal)) == {"a/x", "c/x"}
    dirs = spark.createDataFrame([(d,) for d in ("a", "b", "c", "d", "d/e", "Originals_Backup")], "rel_path string")
    assert paths(M.undo_folders(dirs, back, journal)) == {"a", "b", "d", "Originals_Backup"}
    assert paths(M.undo_folders(dirs, files, journal)) == {"a", "b", "c", "d", "Originals_Backup"}


def test_folders_of_plans_and_reports(spark):
    files = inventory(spark, [("a/p.jpg", 5, "1"), ("b/p.jpg", 5, "1"), ("b/c/d/q.tmp", 3, "2"), ("b/c/r.pdf", 2048, "3"), (".x/y.pdf", 9, "4")])
    assert {(r.kind, r.src) for r in P.with_folders(P.by_type(files)).where("kind = 'mkdir'").collect()} == {("mkdir", f) for f in ("Images", "Other", "Documents/PDFs")}
    assert {r.src for r in P.with_folders(P.by_type(files), nested=True).where("kind = 'mkdir'").collect()} == {"Images", "Other", "Documents", "Documents/PDFs"}
    assert {r.src for r in P.cleanup_folders(files).collect()} == {"Junk_Files_Review", "Duplicates_Review", "Images", "Other", "Documents/PDFs"}
    gps = spark.createDataFrame([(0, 1.0, 2.0)], "walk_seq long, lat double, lon double")
    assert tuple(P.location_counts(files, gps).first()) == (1, 1)
    folders = U.folder_rollup(files)
    top = {r.name: r for r in U.report(folders).collect()}
    assert [c.name for c in top["b"].children] == ["c"] and [c.name for c in top["b"].children[0].children] == ["d"] and top["a"].children == [] and top[".x"].cat == "system"
    assert {r.folder for r in U.of_tag(folders, "personal").collect()} == {"a", "b", "b/c", "b/c/d"} and U.of_tag(folders, "all").count() == folders.count()


def test_photo_plan(spark):
    files = inventory(spark, [("a/1.jpg", 5, "1"), ("a/2.jpg", 5, "2"), ("a/3.jpg", 5, "3"), ("a/4.mp4", 5, "4"), ("Couples/5.jpg", 5, "5"), ("a/6.jpg", 5, "6"), ("a/7.png", 5, "7")])
    rows = [(0, 0, 150.0, 1), (1, 1, 100.0, 1), (2, (1 << 13) - 1, 90.0, 2), (4, 0, 9.0, 0), (5, -1, 80.0, 3)]
    metrics = spark.createDataFrame([(*r, 100, 50.0, 100.0, 1.0) for r in rows], "walk_seq long, phash long, focus double, faces int, pixels long, saturation double, brightness double, edge double")
    plan, items = S.photo_plan(files, metrics)
    assert {r.src: r.dst for r in plan.collect()} == {"a/1.jpg": "Portraits_Single/1.jpg", "a/2.jpg": "Duplicates/2.jpg", "a/3.jpg": "Similar_Extras/3.jpg", "a/4.mp4": "Videos/4.mp4", "a/6.jpg": "Group_Photos/6.jpg"}
    assert {r.rel_path: r.category for r in items.collect()}["a/7.png"] is None and items.count() == 6
    assert {r.src for r in S.photo_plan(files, metrics, {"single", "couple"}, limit=3)[0].collect()} == {"a/1.jpg", "a/2.jpg", "a/3.jpg"}


def test_stream_offsets(tmp_path):
    reader = I.StreamReader({"path": str(tmp_path), "settle": "0"})
    rows = lambda a, b: {r[1] for p in reader.partitions(a, b) for r in reader.read(p) if r[0] == "file"}
    (tmp_path / "d").mkdir()
    (tmp_path / "d/one").write_text("1")
    first = reader.latestOffset()
    assert rows(reader.initialOffset(), first) == {"d/one"}
    (tmp_path / "two").write_text("2")
    os.utime(tmp_path / "two", (5, 5))  # an old time doesn't hide it
    assert rows(first, reader.latestOffset()) == {"two"}
    assert I.StreamReader({"path": str(tmp_path)}).latestOffset()["ns"] < reader.latestOffset()["ns"] - 2.5e9  # unsettled files wait


def test_sessions_and_rollup(spark):
    t = "2024-01-01 10:00:00"
    rows = spark.createDataFrame([(1, "a", 0), (2, "a", 2400), (3, "a", 4801), (4, "b", 0), (5, "a", 4801)], "walk_seq long, album string, s int")
    rows = rows.select("walk_seq", "album", (F.lit(t).cast("timestamp") + F.make_dt_interval(secs=F.col("s"))).alias("taken_at"), F.concat(F.lit("p"), "walk_seq").alias("rel_path"))
    got = {(r.album, r.session): (r.n, r.rep) for r in U.sessions(rows).collect()}
    assert got == {("a", 0): (2, "p2"), ("a", 1): (2, "p5"), ("b", 0): (1, "p4")}
    files = inventory(spark, [("a/b/c/d/x", 2048, "1"), ("a/y", 1024, "2"), ("z", 10, "3")])
    assert {(r.folder, r.kb, r.files, r.subs) for r in U.folder_rollup(files).collect()} == {("a", 3, 2, 1), ("a/b", 2, 1, 1), ("a/b/c", 2, 1, 1)}


def test_components_and_leaders(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    want = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    hashes = [(i, rng.choice([0, 1 << 40, -1]) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6)))) for i in range(60)]
    hashes = [(i, (h & (2**64 - 1)) - (1 << 64) if h >> 63 & 1 else h & (2**64 - 1)) for i, h in hashes]
    leaders, of = [], {}
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    for i, h in hashes:
        of[i] = next((j for j, g in leaders if bits(h, g) <= 8), i)
        if of[i] == i:
            leaders.append((i, h))
    df = spark.createDataFrame(hashes, "walk_seq long, phash long")
    assert {r.walk_seq: r.leader for r in S.leader_groups(df, 8).collect()} == of
    pairs = {(a, b) for a, x in hashes for b, y in hashes if a < b and bits(x, y) <= 8}
    assert {(r.a, r.b) for r in S.hamming_pairs(df, 8).collect()} == pairs


def jpeg(app1=b"Exif\0\0"):
    seg = lambda m, d: b"\xff" + bytes([m]) + struct.pack(">H", len(d) + 2) + d
    return b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xE1, app1) + seg(0xE2, b"icc") + seg(0xFE, b"hi") + seg(0xDA, b"\0") + b"data\xff\xd9"


def tiff():
    date = b"2024:05:06 07:08:09\0"
    head = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x8769, 4, 1, 26) + struct.pack("<I", 0)
    return head + struct.pack("<H", 1) + struct.pack("<HHII", 36867, 2, len(date), 44) + struct.pack("<I", 0) + date


@pytest.fixture
def tree(tmp_path):
    for d in ("e/f", "Android/data", "docs"):
        os.makedirs(tmp_path / d)
    (tmp_path / "zero").write_bytes(b"")
    (tmp_path / ".hidden").write_bytes(b"h")
    (tmp_path / "_under.txt").write_bytes(b"u")
    (tmp_path / "Android/data/x").write_bytes(b"x")
    (tmp_path / "docs/photo").write_bytes(jpeg(b"Exif\0\0" + tiff()))
    with zipfile.ZipFile(tmp_path / "docs/report", "w") as z:
        for n in ("a", "word/document.xml", "b"):
            z.writestr(n, "x")
    return str(tmp_path)


def test_sources(spark, tree):
    inv = I.read_inventory(spark, tree, head=True)
    files = I.files(inv)
    assert {r.rel_path for r in files.collect()} == {"zero", ".hidden", "_under.txt", "Android/data/x", "docs/photo", "docs/report"}
    assert {r.src for r in P.empty_folders(I.dirs(inv), files).collect()} == {"e/f", "e"}
    raw = C.bytes_of(spark, tree + "/docs")
    names = C.zip_entries(raw).select(F.concat(F.lit("docs/"), F.regexp_extract("path", "[^/]+$", 0)).alias("rel_path"), "names")
    heads = files.select("rel_path", "head").join(names, "rel_path", "left")
    plan = {r.src: r.dst for r in P.fix_extensions(files.select("walk_seq", "rel_path", "name", "size"), heads).collect()}
    assert plan == {"docs/photo": "docs/photo.jpg", "docs/report": "docs/report.docx"}
    assert [str(r.taken_at) for r in C.exif(raw.where("path like '%photo'")).collect()] == ["2024-05-06 07:08:09"]
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4s", 2, b"abcd") + b"xx0000" + struct.pack(">I4s", len(tiff()), b"eXIf") + tiff() + b"0000"
    assert [C.exif_of(x)[0] for x in (png, tiff(), png[:40], b"II*\0")] == ["2024:05:06 07:08:09"] * 2 + [None] * 2
    saved = {r.path.rsplit("/", 1)[-1]: (r.before, r.after) for r in C.jpeg_savings(raw).collect()}
    assert saved["report"][1] is None and saved["photo"][0] - saved["photo"][1] == len(tiff()) + 6 + 4 + 6
    assert C.digests(raw).count() == 2


def test_dump_history_and_pixels(spark, tmp_path):
    import base64

    e = lambda s: base64.b64encode(s.encode()).decode()
    lines = spark.createDataFrame([("ROOT|10|2|1",), ("DF|100|40|60",), (f"L1|{e('a')}|{e('a')}|8|2|1",), (f"L2|{e('a/b')}|{e('b')}|3|1|0",), ("END",)], "value string")
    folders, root, disk = C.listing_dump(lines)
    assert [(r.folder, r.parent, r.level, r.kb) for r in folders.orderBy("level").collect()] == [("a", "", 1, 8), ("a/b", "a", 2, 3)]
    assert root.first().root_kb == 10 and disk.first().free_kb == 60
    (tmp_path / "h.json").write_text('[{"id": "1", "ts": 5.0, "label": "t", "journal": [{"op": "move", "src": "a", "dst": "b"}, {"op": "mkdir", "path": "c"}, {"op": "compress", "orig": "o", "backup": "k"}]}]')
    assert [tuple(r) for r in C.audit_export(C.read_history(spark, str(tmp_path / "h.json"))).collect()] == [(5.0, "t", "a", "b"), (5.0, "t", "o", "k")]
    ramp = np.tile(np.arange(90, dtype=np.uint8), (40, 1))
    m = pixels.metrics_of(ramp.tobytes(), 40, 90, 1)
    assert m[4] == -1 and m[2] == 0 and m[5] == 3600  # every pixel is brighter than the one to its left


def test_streams(spark, tree, tmp_path_factory):
    tmp_path = tmp_path_factory.mktemp("out")
    inv = I.read_inventory(spark, tree)
    stream = spark.readStream.format("file_inventory").option("path", tree).option("settle", -5).load().where("kind = 'file'")
    out = str(tmp_path / "plans")
    W.watch(stream, lambda b: P.by_type(b.select("walk_seq", "rel_path", "name", "size")), out, str(tmp_path / "ck")).awaitTermination(90)
    want = {(r.src, r.dst) for r in P.by_type(I.files(inv).select("walk_seq", "rel_path", "name", "size")).collect()}
    assert {(r.src, r.dst) for r in spark.read.parquet(out).collect()} == want
    path = str(tmp_path / "in")
    spark.sql("SELECT 'a' AS album, timestamp'2024-01-01 10:00:00' AS taken_at, 1L AS size, 'd' AS sha1 UNION ALL SELECT 'a', timestamp'2024-01-01 10:40:00', 1L, 'd' UNION ALL SELECT 'b', timestamp'2024-01-03 00:00:00', 2L, 'e'").coalesce(1).write.parquet(path)
    src = spark.readStream.schema("album string, taken_at timestamp, size long, sha1 string").parquet(path)
    for name, df in (("s1", W.sessions(src)), ("s2", W.first_of_digest(src, time="taken_at").select("sha1"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(90)
    assert spark.table("s2").count() == 2
    assert [r.n for r in spark.table("s1").collect()] == [2]


def test_apply_without_clashes_settles_no_names(spark, monkeypatch):
    """Where no name is wanted twice or taken, only the moves are joined; a single clash is settled as before."""
    files = spark.createDataFrame([(i, f"a/f{i}.bin", f"f{i}.bin", i, str(i)) for i in range(1, 5)], "walk_seq long, rel_path string, name string, size long, sha1 string")
    ops = files.select(F.col("walk_seq").alias("op_seq"), F.lit("move").alias("kind"), F.col("rel_path").alias("src"), F.concat(F.lit("b/"), "name").alias("dst"))
    clash = files.union(spark.createDataFrame([(9, "b/f1.bin", "f1.bin", 7, "x")], files.schema))
    after = M.apply(clash, ops)[0]
    assert sorted(r.rel_path for r in after.collect()) == ["b/f1.bin", "b/f1_1.bin", "b/f2.bin", "b/f3.bin", "b/f4.bin"]
    monkeypatch.setattr(M, "settle_alike", None)
    after, journal = M.apply(files, ops)
    assert sorted((r.rel_path, r.name, r.sha1) for r in after.collect()) == [(f"b/f{i}.bin", f"f{i}.bin", str(i)) for i in range(1, 5)]
    assert {r.outcome for r in journal.collect()} == {"moved"}
