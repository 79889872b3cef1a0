"""Format-preserving pseudonyms for personal data by a keyed Feistel permutation.

A found value is validated, split into the digits that may change (each with its radix), and permuted within its own format: the result
is again valid of its kind, has the same length and punctuation, and is the same wherever the value occurs, so documents stay linked.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm import common as C

ROUNDS = 8
KINDS = ("iban", "email", "secret", "ip", "date", "ssn", "phone", "card")


def permute(digits: list[int], radix: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed bijection of digit vectors of the given radices: a Feistel network over its two halves as whole numbers."""
    half = (len(digits) + 1) // 2
    sizes, value = [1, 1], [0, 0]
    for i, (d, r) in enumerate(zip(digits, radix, strict=True)):
        side = int(i >= half)
        value[side], sizes[side] = value[side] * r + d, sizes[side] * r
    mark = f"{tweak}:{','.join(map(str, radix))}".encode()
    for k in range(ROUNDS):
        side = k % 2
        hashed = hashlib.blake2b(mark + b"%d:%d" % (k, value[1 - side]), key=key, digest_size=32).digest()
        value[side] = (value[side] + int.from_bytes(hashed, "big")) % sizes[side]
    out = [0] * len(digits)
    for side, places in ((1, range(len(digits) - 1, half - 1, -1)), (0, range(half - 1, -1, -1))):
        for i in places:
            value[side], out[i] = divmod(value[side], radix[i])
    return out


def _chars(s: str) -> tuple[list[int], list[int], list[str]]:
    """Digits, radices and alphabets of the ASCII letters and digits of s; anything else stays where it is."""
    alphabets = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    own = [next((a for a in alphabets if c in a), "") for c in s]
    return [a.index(c) for c, a in zip(s, own, strict=True) if a], [len(a) for a in own if a], own


def _rewrite(s: str, key: bytes, kind: str, only: str = "") -> str:
    """s with its letters and digits (or only those of one alphabet) permuted within their classes."""
    digits, radix, own = _chars(s)
    if only:
        own = [only if c in only else "" for c in s]
        digits, radix = [only.index(c) for c in s if c in only], [len(only)] * sum(c in only for c in s)
    new = iter(permute(digits, radix, key, kind))
    return "".join(a[next(new)] if a else c for c, a in zip(s, own, strict=True))


def _walk(s: str, step: Callable[[str], str], valid: Callable[[str], bool]) -> str:
    """Cycle walking: the permutation's first further value that is valid, itself a permutation of the valid values."""
    s = step(s)
    while not valid(s):
        s = step(s)
    return s


def luhn(digits: str) -> int:
    """The Luhn sum mod 10; 0 for a valid number."""
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(digits))) % 10


def _fill(form: str, digits: str) -> str:
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in form)


def card(s: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", s)
    if luhn(digits) or len(set(digits)) == 1:
        return None
    body = _rewrite(digits[:-1], key, "card")
    return _fill(s, body + str(-luhn(body + "0") % 10))


def phone(s: str, key: bytes) -> str | None:
    """The country's digits stay. A digit that may only be 2 to 9 in valid numbers of the 10-digit plan (the first of the area and of the
    exchange), or only 1 to 9 elsewhere (the first), stays within those; one that breaks this stays within the others."""
    digits = re.sub(r"\D", "", s)
    country = 1 if s.startswith("+1") else 2 if s.startswith("+") else 0
    if not 10 <= len(digits) <= 15:
        return None
    own = [int(c) for c in digits[country:]]
    least = {0: 2, 3: 2} if country < 2 and len(own) == 10 else {0: 1}
    low = [least.get(i, 0) if d >= least.get(i, 0) else 0 for i, d in enumerate(own)]
    high = [10 if d >= least.get(i, 0) else least[i] for i, d in enumerate(own)]
    new = permute([d - a for d, a in zip(own, low, strict=True)], [b - a for a, b in zip(low, high, strict=True)], key, "phone:" + ",".join(map(str, low)))
    return _fill(s, digits[:country] + "".join(str(d + a) for d, a in zip(new, low, strict=True)))


def ssn(s: str, key: bytes) -> str | None:
    good = lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[4:6] != "00" and x[7:] != "0000"
    return _walk(s, lambda x: _rewrite(x, key, "ssn"), good) if good(s) else None


def ip(s: str, key: bytes) -> str | None:
    octets = [int(o) for o in s.split(".")]
    if any(o > 255 for o in octets) or any(len(o) > 1 and o[0] == "0" for o in s.split(".")):
        return None
    return ".".join(map(str, permute(octets, [256] * 4, key, "ip")))


_FIRST, _DAYS = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1900, 1, 1).toordinal()


def calendar_date(s: str, key: bytes) -> str | None:
    """Days of 1900 to 2099, as year-month-day, or day and month (in this order, else month and day) before the year. The new date is
    one that is read in the same order, so that two dates never become one."""
    a, mark, b, _, c = re.split(r"([-/.])", s)
    order, day = _read_date(a, b, c)
    if not 0 <= day < _DAYS:
        return None
    while True:
        high, low = permute([day // 512, day % 512], [-(-_DAYS // 512), 512], key, "date")
        day = high * 512 + low
        if day < _DAYS:
            new = date.fromordinal(day + _FIRST)
            text = {"y": f"{new.year}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
            parts = [text[x] for x in order]
            if _read_date(*parts)[0] == order:
                return mark.join(parts)


def _read_date(a: str, b: str, c: str) -> tuple[str, int]:
    """(order, day since 1900) of the first reading that is a date; day -1 if none is."""
    for order in ("ymd",) if len(a) == 4 else ("dmy", "mdy"):
        part = dict(zip(order, (a, b, c), strict=True))
        try:
            return order, date(int(part["y"]), int(part["m"]), int(part["d"])).toordinal() - _FIRST
        except ValueError:
            continue
    return "", -1


def iban(s: str, key: bytes) -> str | None:
    flat = s.replace(" ", "")
    number = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97
    if not 15 <= len(flat) <= 34 or number(flat) != 1:
        return None
    body = _rewrite(flat[4:], key, "iban")
    new = iter(flat[:2] + f"{98 - number(flat[:2] + '00' + body):02d}" + body)
    return "".join(c if c == " " else next(new) for c in s)


def email(s: str, key: bytes) -> str | None:
    local, _, host = s.partition("@")
    return f"{_rewrite(local, key, 'email')}@{host}"


def secret(s: str, key: bytes) -> str | None:
    return _rewrite(s, key, "secret", "0123456789abcdef" if s == s.lower() else "0123456789ABCDEF")


#: In order of precedence where two begin at one place.
RULES: tuple[tuple[str, str, Callable[[str, bytes], str | None]], ...] = (
    ("email", r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", email),
    ("secret", r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])", secret),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])", iban),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)", ip),
    ("date", r"(?<![\d/.-])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?![\d/-])", calendar_date),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", ssn),
    ("phone", r"(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+])\+(?!1[ .(-])\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w+(])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)", phone),
    ("card", r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])", card),
)
_COMPILED = tuple((kind, re.compile(pattern), change) for kind, pattern, change in RULES)
_MAYBE = re.compile(r"@|\d[\d.]|\d[ -]\d|[0-9a-f]{32}|[0-9A-F]{32}")
_RUN, _DIGITS = re.compile(r"\d(?:[ -]?\d){12,}"), re.compile(r"\d+")


def _spans(kind: str, pattern: re.Pattern, text: str) -> Iterator[list[tuple[int, int]]]:
    """For each place where a value may begin, the spans to try there, longest first.

    A match may have swallowed what follows the value, so ibans and phones are also tried up to each separator inside the match.
    """
    at = 0
    while m := pattern.search(text, at):
        a, b = m.span()
        cuts = [e for e in range(b - 1, a, -1) if text[e] in " .-" and pattern.fullmatch(text, a, e)] if kind in ("iban", "phone") else []
        yield [(a, b), *((a, e) for e in cuts)]
        at = a + 1 if kind in ("iban", "phone") else b


def _card_spans(pattern: re.Pattern, text: str) -> Iterator[list[tuple[int, int]]]:
    """As _spans, in each run of digit groups: what the pattern takes, then spans of whole groups.

    Those spans' groups have four digits or more but for the last, as on any card; else Luhn's sum alone would let one list of small
    numbers in ten windows pass.
    """
    for run in _RUN.finditer(text):
        groups, greedy = [g.span() for g in _DIGITS.finditer(text, *run.span())], run.start()
        for i, (a, _) in enumerate(groups):
            tries = []
            if a >= greedy and (m := pattern.match(text, a)):
                tries, greedy = [m.span()], m.end()
            size = 0
            if i or a == 0 or text[a - 1] not in ".-":
                for x, b in groups[i:]:
                    size += b - x
                    if 13 <= size <= 19 and (b < run.end() or text[b : b + 1] != "-") and (a, b) not in tries:
                        tries.append((a, b))
                    if b - x < 4 or size >= 19:
                        break
            yield sorted(tries, key=lambda t: -t[1])


def pseudonymise(text: str | None, key: bytes) -> tuple[str | None, dict[str, int]]:
    """(text with each validated value replaced, number of values by kind)."""
    counts: dict[str, int] = {}
    if not text or not _MAYBE.search(text):
        return text, counts
    taken: list[tuple[int, int, str]] = []  # in order, without overlaps
    for kind, pattern, change in _COMPILED:
        for tries in _card_spans(pattern, text) if kind == "card" else _spans(kind, pattern, text):
            for a, b in tries:
                at = bisect_left(taken, (a,))
                if at and taken[at - 1][1] > a or at < len(taken) and taken[at][0] < b:
                    continue
                if (new := change(text[a:b], key)) is not None:
                    taken.insert(at, (a, b, new))
                    counts[kind] = counts.get(kind, 0) + 1
                    break
    out, at = [], 0
    for a, b, new in taken:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), counts


def pseudonyms(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """All columns of docs with the text pseudonymised, and n_<kind> for each of KINDS.

    Null stays null, and a text without personal data stays as it is, byte for byte. Repeated rows keep a row each and get the same
    pseudonyms. A column of docs that is named like a count is left as it is and the count goes under pii_n_<kind>.
    """
    names = [f"n_{k}" if f"n_{k}" not in docs.columns else f"pii_n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.parts(batches):
            done = [pseudonymise(t, key) for t in batch.column("text").to_pylist()]
            cols = [pa.array([t for t, _ in done], pa.string()) if n == "text" else batch.column(n) for n in batch.schema.names]
            cols += [pa.array([c.get(k, 0) for _, c in done], pa.int32()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names + [f"_n{i}" for i in range(len(KINDS))])

    keep = ["text" if c == text_col else f"_c{i}" for i, c in enumerate(docs.columns)]
    sent = docs.toDF(*keep).withColumn("text", F.col("text").cast("string"))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in sent.schema] + [f"_n{i} int" for i in range(len(KINDS))])
    return C.in_arrow(sent, run, schema).toDF(*docs.columns, *names)
