"""Main text of web pages: nearest-URL page differencing of what structure leaves, checked against the article that a page marks.

A page is cut into blocks of text. Blocks in menus, headers, footers, sidebars, notices, adverts, forms, comments and the like are left
out by tag, role, class or id. Every page is paired with the page of the same host that is nearest by URL path and isn't a copy of it,
both pages' lines are aligned by longest common subsequence, and the shared lines, which are the site's and not the page's, are deleted.
Pages whose LONGEST longest blocks are the same are copies.

What differencing leaves is then held against the page's marks. If the page marks one article, which holds at least half of the text of
the blocks or half of what differencing leaves of them, lines outside it go and lines inside it come back: pages repeat one another's
passages, so differencing takes true text there. Else (nothing is marked, or several parts are, such as teasers, or a thin one) it stays
as it is.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stowage.llm import common as C

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Content that isn't markup up to the end tag; elements without content; elements that don't break a line of text.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img"}
_CLOSED_BY = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_OUT_TAGS = {"nav", "footer", "aside", "form", "head", "button", "select", "dialog", "menu", "svg", "object", "canvas", "audio", "video", "fieldset"}
_OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: A class name or id is out if it holds one of these words and else only words of layout: "cookie-banner" is, "ad-free" isn't.
_OUT_WORDS = re.compile(
    r"ads?|advert\w*|adsense|banners?|sponsor\w*|promos?|promotions?|sidebar\w*|menus?|menubar|nav|navbar|navigation|breadcrumbs?|footer|masthead|cookies?|cookie\w*|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscri\w+|signup|shar(?:e|ing)|social\w*|related\w*|recommend\w*|comments?|commentlist|disqus|reply|replies|respond|widgets?|toolbar|pagination|pager|skiplink|hidden"
)
_LAYOUT_WORDS = re.compile(
    r"|\d+|[a-z]|area|articles?|bars?|block|blog|bottom|box|buttons?|cards?|center|col|column|container|content|div|feed|fixed|form|global|group|header|icons?|inner|items?|js|left|links?|list|main|media|menu|mobile|modules?|news|outer|page|panel|post|posts|primary|right|row|secondary|section|site|slot|small|sticky|stories|tools|top|unit|user|widget|wrap|wrapper|wide"
)
_WORD_BREAK = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")
#: Of the text that structure or differencing leaves, what a marked article must hold at least to be trusted.
TRUSTED = 0.5
#: Cells of one table of common subsequences; longer pairs of pages are halved first, so memory is bounded by their lines.
CELLS = 1 << 20
_BLANK = re.compile(r"\s+")
#: So many of a page's longest blocks tell whether it is a copy of another: what pages of a site share is short beside an article.
LONGEST = 3


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}


def _out_name(name: str) -> bool:
    words = _WORD_BREAK.split(name)
    if "".join(words).lower() in ("skiplink", "sidebar"):
        return True
    words = [w.lower() for w in words]
    out = [bool(_OUT_WORDS.fullmatch(w)) for w in words]
    return any(out) and all(o or _LAYOUT_WORDS.fullmatch(w) for o, w in zip(out, words, strict=True))


def _left_out(tag: str, attrs: dict[str, str], in_main: bool) -> bool:
    if tag in _OUT_TAGS or (tag == "header" and not in_main) or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if attrs.get("role", "").lower() in _OUT_ROLES or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    return tag not in ("html", "body") and any(_out_name(n) for n in f"{attrs.get('class', '')} {attrs.get('id', '')}".split())


def _is_main(tag: str, attrs: dict[str, str]) -> bool:
    return tag in ("article", "main") or attrs.get("role", "").lower() in ("main", "article") or attrs.get("itemprop", "") == "articleBody"


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, number of the outermost marked article that it stands in, 0: none) of the page's blocks in order, without those that are
    left out by structure."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, int]] = []  # tag, left out, in which article
    now: list[str] = []
    state, articles = (False, 0), 0

    def close() -> None:
        if now:
            text = _BLANK.sub(" ", html.unescape("".join(now))).strip()
            now.clear()
            if text and not state[0]:
                out.append((text, state[1]))

    def settle() -> tuple[bool, int]:
        return (stack[-1][1], stack[-1][2]) if stack else (False, 0)

    page, at = page or "", 0
    while m := _TOKEN.search(page, at):
        if not state[0]:
            now.append(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag or tag in _VOID:
            if tag == "br":
                now.append(" ")
            elif tag == "hr":
                close()
            continue
        if m[1]:
            if tag not in _INLINE:
                close()
            if any(s[0] == tag for s in stack) and (tag not in _CLOSED_BY or stack[-1][0] == tag or tag in [s[0] for s in stack[-3:]]):
                close() if tag not in _INLINE else None
                while stack.pop()[0] != tag:
                    pass
                state = settle()
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        attrs = _attributes(m[3]) if m[3].strip() else {}
        if tag in _INLINE:
            if not _left_out(tag, attrs, bool(state[1])) or m[3].rstrip().endswith("/"):
                continue
        close()
        while stack and stack[-1][0] in _CLOSED_BY and tag not in _INLINE and (_CLOSED_BY[stack[-1][0]] is None or tag in _CLOSED_BY[stack[-1][0]]):
            stack.pop()
            state = settle()
        if m[3].rstrip().endswith("/"):
            continue
        dropped, article = settle()
        dropped = dropped or _left_out(tag, attrs, bool(article))
        if not article and not dropped and _is_main(tag, attrs):
            articles = article = articles + 1
        stack.append((tag, dropped, article))
        state = settle()
    if not state[0]:
        now.append(page[at:])
    close()
    return out


def url_key(url: str | None) -> tuple[str, str]:
    """(host, path) for pairing: lower-case host without www. or m., path without query, fragment, page suffix and closing slash."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", (url or "").split("#")[0].split("?")[0]
    return re.sub(r"^(www|m)\.", "", m[1].lower()), re.sub(r"(/index)?(\.[a-z]{2,5})?/*$", "", m[2])


def marked_text(found: list[tuple[str, int]], left: list[int]) -> list[str] | None:
    """The blocks of the one marked article that holds at least TRUSTED of the characters of all blocks, or of those at the places left by
    differencing; None if there is no such article."""
    if len({a for _, a in found if a}) != 1:
        return None

    def held(rows: list[tuple[str, int]]) -> bool:
        return bool(rows) and sum(len(t) for t, a in rows if a) >= TRUSTED * sum(len(t) for t, _ in rows)

    return [t for t, a in found if a] if held(found) or held([found[i] for i in left]) else None


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lengths of the longest common subsequences of a with each beginning of b."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.where(b == x, row[:-1] + 1, row[1:]))
    return row


def _kept(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Marks of a's entries (in pieces, in order) that aren't in a longest common subsequence with b: a is halved where the halves'
    subsequences are longest together, until a table fits."""
    if not len(a) or not len(b):
        return [np.ones(len(a), bool)]
    if len(a) > 1 and (len(a) + 1) * (len(b) + 1) > CELLS:
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        return _kept(a[:half], b[:cut]) + _kept(a[half:], b[cut:])
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        diagonal = np.where(b == a[i], table[i + 1, 1:] + 1, table[i + 1, :-1])
        table[i, :-1] = np.maximum.accumulate(diagonal[::-1])[::-1]
    keep, i, j = np.zeros(len(a), bool), 0, 0
    while i < len(a):
        if j < len(b) and a[i] == b[j]:
            i, j = i + 1, j + 1
        elif j < len(b) and table[i, j + 1] >= table[i + 1, j]:
            j += 1
        else:
            keep[i] = True
            i += 1
    return [keep]


def unshared(own: list[int], other: list[int]) -> list[int]:
    """Places of own's lines that aren't in a longest common subsequence with other's. Lines that only one page has take no part."""
    a, b = np.array(own, np.int64), np.array(other, np.int64)
    common = np.flatnonzero(np.isin(a, b))
    keep = np.ones(len(a), bool)
    if len(common):
        keep[common] = np.concatenate(_kept(a[common], b[np.isin(b, a)]))
    return np.flatnonzero(keep).tolist()


_KEYS = "host string, path string, digest long, lines array<long>"
_BODIES = "page_id long, url string, host string, path string, digest long, body binary, articles array<int>"


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def _key(url: str | None, found: list[tuple[str, int]]) -> tuple[str, str, int]:
    longest = sorted({t for t, _ in found}, key=lambda t: (-len(t), t))[:LONGEST]
    return (*url_key(url), _hash("\n".join(longest)))


def _parse(bodies: bool) -> Callable:
    """A task over pages: what they are paired by, with the hashes of their lines; or (bodies) with their blocks, packed as they are
    shuffled. No block holds a line break."""
    fields = [("host", pa.string()), ("path", pa.string()), ("digest", pa.int64())]
    fields = [("page_id", pa.int64()), ("url", pa.string()), *fields, ("body", pa.binary()), ("articles", pa.list_(pa.int32()))] if bodies else [*fields, ("lines", pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.parts(batches, column="html"):
            rows = []
            for page_id, url, page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                found = blocks(page)
                key = _key(url, found)
                rows.append((page_id, url, *key, zlib.compress("\n".join(t for t, _ in found).encode()), [a for _, a in found]) if bodies else (*key, [_hash(t) for t, _ in found]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))

    return run


def _other_before(rows: DataFrame, w: WindowSpec, name: str) -> DataFrame:
    """Adds the last page before each, in the window's order, that has another digest or host than it: what stood before its run began."""
    last = F.lag("page").over(w)
    begins = last.isNotNull() & ((last["host"] != F.col("page.host")) | (last["digest"] != F.col("page.digest")))
    return rows.withColumn("_began", F.when(begins, last)).withColumn(name, F.last("_began", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_began")


def neighbours(parsed: DataFrame) -> DataFrame:
    """Rows (host, path, digest, near): each distinct page of a host with the lines of the one nearest by path that isn't its copy.

    Nearest: of the nearest pages of another digest before and after it in path order, the one with the longer common path; ties to the
    one before. Pages are put in order by range, so that a host of any size is spread over tasks; the borders between ranges are joined up
    by three rows a range. The ranged pages are stored with their part, since another evaluation may draw other borders.
    """
    keys = parsed.groupBy("host", "path", "digest").agg(F.min("lines").alias("lines"))
    page = F.struct("host", "path", "digest", "lines")
    ranged = C.stored(keys.repartitionByRange("host", "path", "digest").select(page.alias("page"), F.spark_partition_id().alias("part")), "ranged")
    order = ["page.host", "page.path", "page.digest"]
    up, down = Window.partitionBy("part").orderBy(*order), Window.partitionBy("part").orderBy(*(F.desc(c) for c in order))
    inner = C.stored(_other_before(_other_before(ranged, up, "before"), down, "after"), "inner")
    # of each range its first and last page, and what other page stands next to the run of each; in order they show what other ranges need
    ends = inner.groupBy("part").agg(*(f(F.struct("page.host", "page.path", "page.digest", "page", "before", "after")).alias(n) for n, f in (("first", F.min), ("last", F.max))))
    places = F.array(F.struct(F.lit(0).alias("at"), F.col("first.page").alias("page")), F.struct(F.lit(1).alias("at"), F.col("first.after").alias("page")), F.struct(F.lit(2).alias("at"), F.col("last.before").alias("page")), F.struct(F.lit(3).alias("at"), F.col("last.page").alias("page")))
    row = ends.select("part", F.explode(places).alias("x")).select("part", "x.at", "x.page").where("page is not null")
    across = Window.orderBy("part", "at"), Window.orderBy(F.desc("part"), F.desc("at"))  # four rows a range
    row = _other_before(_other_before(row, across[0], "before"), across[1], "after")
    border = row.groupBy("part").agg(F.max(F.when(F.col("at") == 0, F.col("before"))).alias("from_before"), F.max(F.when(F.col("at") == 3, F.col("after"))).alias("from_after"))
    both = inner.join(F.broadcast(border), "part").select("page.*", F.coalesce("before", "from_before").alias("before"), F.coalesce("after", "from_after").alias("after"))

    def alike(other: str):
        same = F.col(f"{other}.host") == F.col("host")
        mine, its = F.split("path", "/"), F.split(F.col(f"{other}.path"), "/")
        shared = F.aggregate(F.zip_with(mine, its, lambda a, b: F.coalesce(a == b, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, x: F.struct((s["n"] + (s["go"] & x).cast("int")).alias("n"), (s["go"] & x).alias("go")), lambda s: s["n"])
        return F.coalesce(F.when(same, shared), F.lit(-1))

    a, b = alike("before"), alike("after")
    near = F.when((a >= b) & (a >= 0), F.col("before.lines")).when(b >= 0, F.col("after.lines"))
    return both.select("host", "path", "digest", near.alias("near")).where("near is not null")


def _differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for body, articles, near in zip(*(batch.column(c).to_pylist() for c in ("body", "articles", "near")), strict=True):
            own = zlib.decompress(body).decode().split("\n") if articles else []
            left = unshared([_hash(t) for t in own], near or [])
            main = marked_text(list(zip(own, articles, strict=True)), left)
            texts.append("\n\n".join([own[i] for i in left] if main is None else main))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text (empty if none), n_chars.

    Null and empty html has no text. A null or odd URL counts as a page of the nameless host. Repeated rows keep a row each and get the
    same text. A page that has no other on its host but copies has nothing to be compared with and keeps its lines. Extra columns are
    ignored.
    """
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    near = neighbours(C.stored(pages.mapInArrow(_parse(False), _KEYS), "lines"))
    # pages are parsed again rather than stored: their text lies on the disk once, packed, as it is shuffled
    paired = pages.mapInArrow(_parse(True), _BODIES).join(near, ["host", "path", "digest"], "left").select("page_id", "url", "body", "articles", "near")
    return paired.mapInArrow(_differenced, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
