"""Sessions of a stream against those of the batch operator over the same files."""

import random

from stowage.operators import rollup as U
from stowage.streaming.ordered_sessions import _packed, _Timeline, _unpacked, ordered_sessions

SCHEMA = "album string, taken_at timestamp, walk_seq long, rel_path string"


def test_timeline_against_all_at_once():
    """However the watermark moves, sessions are those of the sorted files, and the state keeps no more than half a session."""
    rng = random.Random(5)
    for _ in range(200):
        at, rows = 0, []
        for i in range(rng.randrange(1, 40)):
            at += rng.choice([0, 1, 119, 120, 121, 500]) * 1_000_000 + rng.choice([0, 1, 999_999])
            rows.append((at, i, f"f{i}"))
        want = []
        for t, _, path in rows:
            if want and t // 1_000_000 - want[-1][-1][0] // 1_000_000 <= 120:
                want[-1].append((t, path))
            else:
                want.append([(t, path)])
        line, got, cut, now = _Timeline(None), [], 0, 0
        while cut < len(rows):
            upto = min(len(rows), cut + rng.randrange(1, 6))
            part = rows[cut:upto]
            rng.shuffle(part)
            line = _Timeline(line.state())
            line.waiting += part
            now = max(now, rows[upto - 1][0] - rng.choice([0, 1, 10**9])) if upto < len(rows) and rows[upto][0] > rows[upto - 1][0] else now
            line.advance(now, 120)
            got += line.done
            assert len(line.tail) == (line.n + 1) // 2
            assert line.wake(120) is None or line.wake(120) > now
            cut = upto
        line = _Timeline(line.state())
        line.advance(at + 10**9, 120)
        got += line.done
        assert got == [(i, len(s), s[0][0], s[-1][0], s[len(s) // 2][1]) for i, s in enumerate(want)]
        assert line.wake(120) is None and line.state()[1:2] == (0,)


def test_stream_against_batch(spark, tmp_path):
    rng = random.Random(1)
    files, base = [], 1_700_000_000
    for album in ("a", "b", None):
        at = base
        for i in range(60):
            at += rng.choice([0, 30, 2400, 2401, 9000])
            files.append((at, album, len(files), f"{album}/{i}"))
    files.sort(key=str)
    late = 3600
    parts = [files[i : i + 40] for i in range(0, len(files), 40)]
    path, done = str(tmp_path / "in"), []
    rows = lambda part: spark.createDataFrame([(a, t, w, p) for t, a, w, p in part], "album string, t long, walk_seq long, rel_path string").selectExpr("album", "timestamp_seconds(t) AS taken_at", "walk_seq", "rel_path")
    for part in [*parts, [(files[-1][0] + 10 * late, "end", 9999, "end/x")]]:
        rng.shuffle(part)
        rows(part).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(SCHEMA).parquet(path)
        out = ordered_sessions(stream).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
        assert out.trigger(availableNow=True).start().awaitTermination(120)
        done.append(spark.read.parquet(str(tmp_path / "out")).count())
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    want = U.sessions(rows(files)).select("album", "session", "n", "start_at", "end_at", "rep", "suggested")
    assert got == sorted(map(tuple, want.collect()), key=str)
    assert done == sorted(done) and 0 < done[2] < done[-1]  # given out on the way
    assert {r[-1] for r in got if r[1] == 10} == {"Session 11"}


def test_keys_of_a_bucket_share_a_state():
    """No row of state, and so no call of Python, for each key; every key comes out of the bucket's row as it went in."""
    rng = random.Random(3)
    lines = {key: _Timeline(None) for key in (None, "", "a", "b", "c")}
    for line in lines.values():
        line.waiting = [(rng.randrange(10**12), i, rng.choice([None, f"f{i}"])) for i in range(rng.randrange(9))]
        line.advance(rng.randrange(10**12), 2400)
    row = _packed(lines)
    assert len(row) == 11 and len(row[0]) == 5
    assert {k: v.state() for k, v in _unpacked(row).items()} == {k: v.state() for k, v in lines.items()}
    assert _unpacked(None) == {}
