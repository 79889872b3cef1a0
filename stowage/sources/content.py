"""Jobs over file bytes (path, content): digests, zip entries, EXIF time and place, JPEG savings; and text formats of listings and history."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions import columns as K

ENTRIES = 40


def bytes_of(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, content of the files that Spark's binary reader lists (not hidden or empty ones)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "content")


def digests(contents: DataFrame) -> DataFrame:
    """path, sha1 in the JVM. Unreadable files have no row."""
    return contents.select("path", F.sha1("content").alias("sha1"))


def digests_of_doubles(files: DataFrame, contents: DataFrame) -> DataFrame:
    """Digests only of files whose size another file shares: the others' bytes are never hashed."""
    twice = files.where("size > 0").groupBy("size").count().where("count > 1").select("size")
    return digests(contents.join(files.join(twice, "size", "left_semi").select(F.col("rel_path").alias("path")), "path", "left_semi"))


def _zip_names(data: bytes) -> list[str]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return z.namelist()[:ENTRIES]
    except Exception:  # noqa: BLE001  any damage to the container means no entries
        return []


def zip_entries(contents: DataFrame) -> DataFrame:
    """path, names (first entries) of contents that begin like a zip."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "names": pdf["content"].map(_zip_names)})

    return contents.where(F.hex(F.substring("content", 1, 4)) == "504B0304").mapInPandas(run, "path string, names array<string>")


def _tiff_part(data: bytes) -> bytes | None:
    """Where a picture's tags are: after the mark of a JPEG's segment, in a PNG's eXIf chunk, or a TIFF itself."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] == b"\xff\xd8" and (at := data.find(b"Exif\0\0")) >= 0:
        return data[at + 6 :]
    at = 8 if data[:8] == b"\x89PNG\r\n\x1a\n" else len(data)
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"eXIf":
            return data[at + 8 : at + 8 + size]
        at += 12 + size
    return None


def exif_of(data: bytes) -> tuple[str | None, float | None, float | None]:
    """(time text, latitude, longitude) of the EXIF block of a JPEG, PNG or TIFF; anything odd gives nulls."""
    try:
        tiff = _tiff_part(data)
        if tiff is None:
            return None, None, None
        order = "<" if tiff[:2] == b"II" else ">"
        get = lambda fmt, p: struct.unpack_from(order + fmt, tiff, p)

        def entries(p: int) -> dict[int, tuple]:
            return {t: (kind, n, q + 8) for q in range(p + 2, p + 2 + 12 * get("H", p)[0], 12) for t, kind, n in [get("HHI", q)]}

        def text(e: tuple) -> str:
            p = get("I", e[2])[0] if e[1] > 4 else e[2]
            return tiff[p : p + e[1]].split(b"\0")[0].decode("ascii")

        def degrees(e: tuple) -> float:
            v = get("6I", get("I", e[2])[0])
            return v[0] / v[1] + v[2] / v[3] / 60 + v[4] / v[5] / 3600

        first = entries(get("I", 4)[0])
        sub = entries(get("I", first[0x8769][2])[0]) if 0x8769 in first else {}
        time = next((text(d[t])[:19] for d, t in ((sub, 36867), (sub, 36868), (first, 306)) if t in d), None)
        lat = lon = None
        if 0x8825 in first:
            g = entries(get("I", first[0x8825][2])[0])
            if 2 in g and 4 in g:
                lat = round(degrees(g[2]) * (-1 if 1 in g and text(g[1]).upper() == "S" else 1), 6)
                lon = round(degrees(g[4]) * (-1 if 3 in g and text(g[3]).upper() == "W" else 1), 6)
        return time, lat, lon
    except Exception:  # noqa: BLE001  a broken header means no metadata
        return None, None, None


def exif(contents: DataFrame) -> DataFrame:
    """path, taken_at, lat, lon of JPEG, PNG and TIFF contents; other files and broken tags have nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [exif_of(bytes(x)) for x in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "taken": [r[0] for r in rows], "lat": [r[1] for r in rows], "lon": [r[2] for r in rows]})

    rows = contents.mapInPandas(run, "path string, taken string, lat double, lon double")
    return rows.select("path", F.try_to_timestamp("taken", F.lit("yyyy:MM:dd HH:mm:ss")).alias("taken_at"), "lat", "lon")


def stripped_jpeg(data: bytes) -> bytes | None:
    """The JPEG without application segments 1 and 3 to 15 and comments; null if it isn't well formed."""
    if data[:2] != b"\xff\xd8":
        return None
    out, p = [data[:2]], 2
    while p + 4 <= len(data):
        if data[p] != 0xFF:
            return None
        mark, n = data[p + 1], struct.unpack_from(">H", data, p + 2)[0]
        if mark == 0xDA:
            return b"".join([*out, data[p:]])
        if n < 2 or p + 2 + n > len(data):
            return None
        if not (mark == 0xE1 or 0xE3 <= mark <= 0xEF or mark == 0xFE):
            out.append(data[p : p + 2 + n])
        p += 2 + n
    return None


def jpeg_savings(contents: DataFrame) -> DataFrame:
    """path, before, after (null: not a well-formed JPEG), converted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            new = [stripped_jpeg(bytes(x)) for x in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "before": pdf["content"].map(len), "after": pd.array([None if n is None else len(n) for n in new], "Int64"), "converted": False})

    return contents.mapInPandas(run, "path string, before long, after long, converted boolean")


def listing_dump(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(folders, root, disk) of a dump's text lines (value): L<n>|path|name|kb|files|subs in base 64, ROOT|…, DF|….

    A folder's parent is the path above it, so the lines may come in any order. END and anything else is passed over.
    """
    f = F.split("value", r"\|")
    rows = lines.select(f.alias("f")).withColumn("tag", F.get("f", F.lit(0)))
    number = lambda i: F.get("f", F.lit(i)).try_cast("bigint")
    plain = lambda i: F.unbase64(F.get("f", F.lit(i))).cast("string")
    folders = rows.where(F.col("tag").rlike("^L[0-9]+$")).select(plain(1).alias("folder"), K.folder_of(plain(1)).alias("parent"), F.substring("tag", 2, 9).cast("int").alias("level"), plain(2).alias("name"), number(3).alias("kb"), number(4).alias("files"), number(5).alias("subs"))
    return folders, rows.where("tag = 'ROOT'").select(number(1).alias("root_kb"), number(2).alias("root_files"), number(3).alias("root_loose")), rows.where("tag = 'DF'").select(number(1).alias("total_kb"), number(2).alias("used_kb"), number(3).alias("free_kb"))


HISTORY = "id string, ts double, label string, root string, journal array<struct<op:string,src:string,dst:string,path:string,orig:string,backup:string,written:string>>"


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """History entries of a JSON file (a list or one object; damaged text gives none)."""
    return spark.read.schema(HISTORY).option("multiLine", "true").option("mode", "PERMISSIVE").json(path).where("id is not null")


def audit_export(history: DataFrame) -> DataFrame:
    """(ts, label, src, dst) of moves, copies and compressions (original to backup); made and removed folders don't show."""
    rows = history.select("ts", "label", F.explode("journal").alias("j")).where("j.op in ('move', 'copy', 'compress')")
    squeezed = F.col("j.op") == "compress"
    return rows.select("ts", "label", F.when(squeezed, F.col("j.orig")).otherwise(F.col("j.src")).alias("src"), F.when(squeezed, F.col("j.backup")).otherwise(F.col("j.dst")).alias("dst"))


def transfer_manifest(files: DataFrame) -> DataFrame:
    """Pictures and films with the relative folder they go to; a step up becomes _."""
    return files.where(K.is_image() | K.is_video()).select("rel_path", "size", F.regexp_replace(K.folder_of(), r"\.\.", "_").alias("target_dir"))
