"""Scalar rules as column expressions over inventory columns (rel_path, name, size, mtime_epoch, ...). All run in the JVM."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from stowage.functions import rules as R


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit_map(d: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in d.items()))


def cases(pairs, default=None) -> Column:
    """CASE WHEN over (condition, value) pairs in order."""
    out = None
    for cond, value in pairs:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default) if out is not None else F.lit(default)


def ext_of(name="name") -> Column:
    """Lower-case text after the last dot; empty if that dot is first or last."""
    return F.lower(F.regexp_extract(c(name), r"(?s)^.+\.([^.]+)$", 1))


def lenient_ext(name="name") -> Column:
    return F.lower(F.regexp_extract(c(name), r"\.([^.]*)$", 1))


def stem_of(name="name") -> Column:
    return F.when(ext_of(name) != "", F.regexp_replace(c(name), r"\.[^.]+$", "")).otherwise(c(name))


@dataclass(frozen=True)
class CustomRules:
    """Overrides ext -> folder and further junk extensions; keys are lower-cased, leading dots and empty values dropped."""

    ext: dict = field(default_factory=dict)
    junk: tuple = ()

    @property
    def overrides(self) -> dict:
        return {k.lower().lstrip("."): v for k, v in self.ext.items() if k.lower().lstrip(".") and v}

    @property
    def junk_exts(self) -> list:
        return [*R.JUNK_EXTS, *(x.lower().lstrip(".") for x in self.junk if x.lower().lstrip("."))]


def category_of(ext: str | Column = "ext", custom: CustomRules = CustomRules()) -> Column:
    return F.coalesce(lit_map({**R.EXT_CATEGORY, **custom.overrides})[c(ext)], F.lit("Other"))


def detect_type(head="head") -> Column:
    """File type by leading bytes; null if unknown. A box named ftyp comes before all others."""
    starts = [(F.hex(F.substring(c(head), 1, len(m) // 2)) == m.upper(), F.lit(ext)) for m, ext in R.MAGIC]
    return cases([(F.hex(F.substring(c(head), 5, 4)) == "66747970", F.lit("mp4")), *starts])


def refine_zip(names="names") -> Column:
    joined = F.array_join(c(names), "\n")
    return cases([(joined.contains(mark), F.lit(ext)) for mark, ext in R.ZIP_MARKS], "zip")


def size_tier(size="size") -> Column:
    return cases([(c(size) >= mib * 1024**2, F.lit(name)) for mib, name in R.TIERS[:-1]], R.TIERS[-1][1])


def junk_reason(name="name", size="size", custom: CustomRules = CustomRules()) -> Column:
    low, ext = F.lower(c(name)), ext_of(name)
    return cases([(c(size) == 0, F.lit("zero-byte")), (ext.isin(custom.junk_exts), F.concat(F.lit("."), ext)), (c(name).startswith("~$") | low.endswith(".tmp"), F.lit("temp"))])


def is_image(name="name") -> Column:
    return ext_of(name).isin(R.IMAGE_EXTS)


def is_video(name="name") -> Column:
    return ext_of(name).isin(R.VIDEO_EXTS)


def is_compressible(name="name", heic: bool = False) -> Column:
    return lenient_ext(name).isin(["jpg", "jpeg", "png", *(["heic", "heif"] if heic else [])])


def segments(path="rel_path") -> Column:
    return F.filter(F.split(c(path), "/"), lambda x: (x != "") & (x != "."))


def folder_of(path="rel_path") -> Column:
    return F.regexp_replace(c(path), r"/?[^/]*$", "")


def depth_of(path="rel_path") -> Column:
    return F.size(F.split(c(path), "/")) - 1


def under_root(root: str, path="rel_path") -> Column:
    """The path is the root or lies below it."""
    return (c(path) == root.rstrip("/")) | c(path).startswith(root.rstrip("/") + "/")


_BLANKS = r"^\s+|\s+$"
PASSES = 8


def similar_key(stem: Column) -> Column:
    """The stem without copy suffixes, lower-case: passes that each strip one suffix, until nothing changes; an empty result falls back
    to the stem. PASSES passes do for all but stems with more suffixes, which get as many as their length allows."""
    once = lambda s: F.regexp_replace(F.regexp_replace(s, "(?iU)" + R.COPY_SUFFIX, ""), "(?U)" + _BLANKS, "")
    passes = lambda s, n: F.aggregate(F.sequence(F.lit(1), n), s, lambda s, _: once(s))
    done = passes(F.regexp_replace(stem, "(?U)" + _BLANKS, ""), F.lit(PASSES))
    done = F.when(once(done) == done, done).otherwise(passes(done, F.greatest(F.lit(1), F.length(done))))
    return F.lower(F.when(done == "", stem).otherwise(done))


def safe_name(s: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(s, r'[\\/:*?"<>|]+', "_"), r"\s+", " ")
    return F.coalesce(F.nullif(F.regexp_replace(s, r"^[ .]+|[ .]+$", ""), F.lit("")), F.lit("file"))


def zero_filled(n: Column, pad: int) -> Column:
    s = n.cast("string")
    return F.when(F.length(s) < pad, F.lpad(s, pad, "0")).otherwise(s)


def from_template(template: str, values: dict[str, Column]) -> Column:
    """Literal replacement of {key} in the order of values, so later keys also expand inside earlier values; trimmed."""
    out = F.lit(template)
    for key, value in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), value)
    return F.regexp_replace(out, _BLANKS, "")


def date_subpath(ts: Column, by: str = "month") -> Column:
    shapes = {"year": ["yyyy"], "day": ["yyyy", "yyyy-MM", "yyyy-MM-dd"]}.get(by, ["yyyy", "yyyy-MM"])
    return F.when(ts.isNull(), "Undated").otherwise(F.concat_ws("/", *(F.date_format(ts, f) for f in shapes)))


def effective_time(taken: Column, mtime: Column) -> Column:
    return F.coalesce(taken, F.timestamp_seconds(F.nullif(mtime, F.lit(0))))


def place_key(lat="lat", lon="lon", places: int | None = 3) -> Column:
    """places: decimals of the coordinates; None: all that they have."""
    return F.concat_ws("_", *((c(x) if places is None else F.round(c(x), places)).cast("string") for x in (lat, lon)))


def person_folder(name: Column) -> Column:
    s = F.regexp_replace(F.trim(F.regexp_replace(name, "[^A-Za-z0-9 _-]", "")), " ", "_")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("Person"))


def is_screenshot(name="name") -> Column:
    low = F.lower(c(name))
    return cases([(low.contains(m), F.lit(True)) for m in R.SCREENSHOT_MARKS], low.startswith("scr-"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def folder_tag(name="name") -> Column:
    low = F.lower(c(name))
    found = lambda words: cases([(low.contains(w), F.lit(True)) for w in words.split()], F.lit(False))
    keyword = [(low.startswith(".") | low.isin(R.FOLDER_SYSTEM), F.lit("system")), *((found(w), F.lit(tag)) for tag, w in R.FOLDER_KEYWORDS)]
    return F.coalesce(lit_map(R.FOLDER_EXACT)[low], cases(keyword, F.lit("personal")))


def folder_note(tag="tag") -> Column:
    return lit_map(R.FOLDER_NOTES)[c(tag)]


def human_size(kb="kb") -> Column:
    k = c(kb)
    return cases([(k >= 1024**2, F.format_string("%.2f GB", k / 1024.0**2)), (k >= 1024, F.format_string("%.1f MB", k / 1024.0))], F.format_string("%d KB", k.cast("long")))


def op_text(kind="kind", src="src", dst="dst") -> Column:
    return cases([(c(kind) == "move", F.concat(F.lit("MOVE "), c(src), F.lit(" -> "), c(dst))), (c(kind) == "mkdir", F.concat(F.lit("MKDIR "), c(src)))], F.concat(F.lit("RMDIR "), c(src)))


def quality(focus="focus", brightness="brightness", faces="faces") -> Column:
    light = F.greatest(F.lit(0.0), 1 - F.abs(c(brightness) - 128) / 128)
    return F.round(0.55 * F.least(c(focus) / 300, F.lit(1.0)) + 0.30 * light + 0.15 * (c(faces) > 0).cast("int"), 3)


@dataclass(frozen=True)
class SafetyPolicy:
    """What must not be touched: system and private folders, hidden things unless asked for, and names added by the user."""

    include_hidden: bool = False
    extra: tuple = ()

    def protected_dir(self, segs: Column) -> Column:
        first = [*R.PROTECTED_FIRST, *(x.lower() for x in self.extra)]
        any_ = F.exists(segs, lambda s: F.lower(s).isin(R.PROTECTED_ANY))
        out = (F.size(segs) == 0) | F.lower(F.get(segs, F.lit(0))).isin(first) | any_
        return out if self.include_hidden else out | F.exists(segs, lambda s: s.startswith("."))

    def protected_file(self, name="name") -> Column:
        media = c(name) == ".nomedia"
        return media if self.include_hidden else media | c(name).startswith(".")
