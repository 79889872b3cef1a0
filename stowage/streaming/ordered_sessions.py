"""Gap sessions of a stream with what the built-in session window can't keep: middle file, ordinal number and suggested name.

Per key the state holds what the watermark hasn't reached yet, the open session (number of files, first and last time, and its files from
the middle on, which is all that later files can make the middle of), and how many sessions were given out. So it is bounded by half an
open session and by what arrives within the allowed lateness. Timers, in event time, take up what the watermark has passed.

Keys are dealt by hash to a fixed number of buckets; a bucket's keys share one row of state and one timer, as a call of Python for each key
costs far more than the work on its files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stowage.operators.rollup import _session_name

#: One row per bucket: what each key has of its own, with the lengths of its parts of the lists that follow, which stand one after another.
_STATE = """keys array<string>, given array<int>, n array<long>, start array<long>, last array<long>, tails array<int>, waits array<int>,
  tail array<string>, times array<long>, seqs array<long>, paths array<string>"""
_SECOND = 1_000_000


class _Timeline:
    """One key's state as lists; times in microseconds."""

    def __init__(self, state: tuple | None):
        self.given, self.n, self.start, self.last, tail, *waiting = state or (0, 0, 0, 0, [], [], [], [])
        self.tail, self.waiting = list(tail), list(zip(*waiting, strict=True))
        self.done: list[tuple] = []

    def close(self) -> None:
        self.done.append((self.given, self.n, self.start, self.last, self.tail[0]))
        self.given, self.n, self.tail = self.given + 1, 0, []

    def advance(self, now: int, gap: int) -> None:
        """Takes up, in order, what lies at or before now; closes the session that nothing after now can belong to."""
        self.waiting.sort()
        ready = sum(t <= now for t, _, _ in self.waiting)
        dropped = 0  # how many at the front of tail lie before the middle
        for t, _, path in self.waiting[:ready]:
            if self.n and t // _SECOND - self.last // _SECOND > gap:
                self.tail, dropped = self.tail[dropped:], 0
                self.close()
            if not self.n:
                self.start = t
            self.tail.append(path)
            self.n, self.last = self.n + 1, t
            dropped += self.n % 2 == 0
        self.tail, self.waiting = self.tail[dropped:], self.waiting[ready:]
        if self.n and now // _SECOND - self.last // _SECOND > gap:
            self.close()

    def wake(self, gap: int) -> int | None:
        """The time, in microseconds, at which something is to be done next."""
        times = [self.waiting[0][0]] if self.waiting else []
        return min([*times, (self.last // _SECOND + gap + 1) * _SECOND] if self.n else times, default=None)

    def state(self) -> tuple:
        times, seqs, paths = (list(c) for c in zip(*self.waiting, strict=True)) if self.waiting else ([], [], [])
        return self.given, self.n, self.start, self.last, self.tail, times, seqs, paths


def _packed(lines: dict[str | None, _Timeline]) -> tuple:
    """A bucket's timelines as a row of _STATE."""
    given, n, start, last, tail, times, seqs, paths = zip(*(line.state() for line in lines.values()), strict=True)
    own = (list(c) for c in (lines, given, n, start, last, map(len, tail), map(len, times)))
    return *own, *([x for part in c for x in part] for c in (tail, times, seqs, paths))


def _unpacked(state: tuple | None) -> dict[str | None, _Timeline]:
    if state is None:
        return {}
    keys, given, n, start, last, tails, waits, tail, *waiting = state
    lines, at, upto = {}, 0, 0
    for key, *own, a, b in zip(keys, given, n, start, last, tails, waits, strict=True):
        lines[key] = _Timeline((*own, tail[at : at + a], *(c[upto : upto + b] for c in waiting)))
        at, upto = at + a, upto + b
    return lines


def ordered_sessions(stream: DataFrame, minutes: int = 40, late: str = "1 hour", by: str = "album", buckets: int = 1024) -> DataFrame:
    """Sessions (by, session, n, start_at, end_at, rep, suggested) as the batch operator gives them, each once the watermark has passed it.

    Files (by, taken_at, walk_seq, rel_path) are ordered by time and walk_seq however they arrive. A file later than the watermark is
    dropped, as it would change what was given out; one without a time takes no part. Times without a zone are taken in the session's. The last session of a key stays open until files of
    any key move the watermark past its end. A bucket's keys are read and written together, so buckets should be so many that its state
    fits a task; it can't be changed while a stream's state is kept.
    """
    gap = max(2, minutes) * 60

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lines = _unpacked(state.get if state.exists else None)
        if not state.hasTimedOut:
            for pdf in frames:
                for name, *file in zip(pdf["key"].tolist(), pdf["us"].tolist(), pdf["walk_seq"].tolist(), pdf["rel_path"].tolist(), strict=True):
                    if (line := lines.get(name)) is None:
                        line = lines[name] = _Timeline(None)
                    line.waiting.append(tuple(file))
        now = state.getCurrentWatermarkMs() * 1000
        for line in lines.values():
            line.advance(now, gap)
        state.update(_packed(lines))
        if (wake := min((w for line in lines.values() if (w := line.wake(gap)) is not None), default=None)) is not None:
            state.setTimeoutTimestamp(max(wake, now + 1000) // 1000 + (wake % 1000 > 0))
        if done := [(name, *session) for name, line in lines.items() for session in line.done]:
            yield pd.DataFrame(done, columns=["key", "session", "n", "start", "end", "rep"])

    kind = stream.schema["taken_at"].dataType
    rows = stream.where("taken_at is not null").withColumn("taken_at", F.col("taken_at").cast("timestamp")).withWatermark("taken_at", late)
    rows = rows.select(F.col(by).cast("string").alias("key"), "taken_at", F.unix_micros("taken_at").alias("us"), F.col("walk_seq").cast("long").alias("walk_seq"), "rel_path")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    found = rows.groupBy("bucket").applyInPandasWithState(run, "key string, session int, n long, start long, end long, rep string", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("key").cast(stream.schema[by].dataType).alias(by), "session", "n", F.timestamp_micros("start").cast(kind).alias("start_at"), F.timestamp_micros("end").cast(kind).alias("end_at"), "rep", _session_name().alias("suggested"))
