"""Pairs of hashes within a distance, against all pairs."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from stowage.operators import hamming as H
from stowage.operators import similarity as S


@pytest.mark.parametrize("n", [1, 50, 3000, 10**5, 10**7, 10**9])
@pytest.mark.parametrize("d", [0, 1, 8, 16, 30])
def test_bands_leave_no_pair_out(n, d):
    cut = H.bands(n, d)
    assert sum(bits for _, bits, _ in cut) == 64 and sum(t + 1 for _, _, t in cut) == d + 1
    assert sorted(b for s, n_, _ in cut for b in range(s, s + n_)) == list(range(64))


def test_bands_widen_with_the_number_of_hashes():
    widest = [max(bits for _, bits, _ in H.bands(10**k, 16)) for k in range(2, 10)]
    assert widest == sorted(widest) and widest[-1] > widest[0]


@pytest.mark.parametrize("d,size,held", [(0, 256, 1 << 20), (8, 256, 10), (16, 3, 1 << 20), (16, 3, 10), (40, 256, 1 << 20)])
def test_pairs_equal_brute_force(spark, monkeypatch, d, size, held):
    monkeypatch.setattr(H, "LIST", size)
    monkeypatch.setattr(H, "HELD", held)
    monkeypatch.setattr(H, "AT_ONCE", 500)
    rng = np.random.default_rng(d)
    h = rng.integers(-(2**63), 2**63 - 1, 260)
    for i in range(130):
        h[i + 130] = h[i] ^ sum(1 << int(b) for b in rng.choice(63, min(40, rng.integers(0, d + 3)), replace=False))
    h[:40] = (h[0] & ~0xFFFF) | rng.integers(0, 2**16, 40)  # many that share most bands
    h[3] = h[4] = 0
    rows = [(i, int(x), i % 2) for i, x in enumerate(h)] + [(900, None, 0), (901, None, 1)]
    df = spark.createDataFrame(rows, "walk_seq long, phash long, album int").repartition(5)
    bits = np.bitwise_count((h[:, None] ^ h[None, :]).view(np.uint64))
    want = {(i, j, int(bits[i, j])) for i in range(260) for j in range(i + 1, 260) if bits[i, j] <= d}
    got = [tuple(r) for r in S.hamming_pairs(df, d).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {tuple(r) for r in S.hamming_pairs(df, d, block="album").collect()} == {p for p in want if p[0] % 2 == p[1] % 2}
    assert S.hamming_pairs(df.limit(0), d).count() == 0


def test_comparing_lists_takes_little_memory():
    """Pairs of short and long lists against plain comparison; what is held at once is a small part of all comparisons."""
    rng = np.random.default_rng(3)
    xs, ys = ([rng.integers(-(2**63), 2**63 - 1, n) for _ in range(40) for n in (3, 256)] for _ in range(2))
    for x, y in zip(xs, ys, strict=True):
        y[:2] = x[:2] ^ 5
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 80), pa.array([0] * 80), pa.array(xs), pa.array(ys), pa.array([False] * 80)], names=["block", "i", "xs", "ys", "same"])
    run = H._compared(((0, 64, 64),), 12)
    tracemalloc.start()
    got = [(min(a, b), max(a, b)) for out in run(iter([batch])) for a, b in zip(out["pa"].to_pylist(), out["pb"].to_pylist(), strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = [(min(a, b), max(a, b)) for x, y in zip(xs, ys, strict=True) for a in x.tolist() for b in y.tolist() if ((a ^ b) & (2**64 - 1)).bit_count() <= 12]
    assert sorted(got) == sorted(want) and len(got) >= 160 and peak < 8 << 20


def test_clusters_in_order_are_quick_and_true_to_order():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    v = centres[rng.integers(0, 40, 1500)] + rng.normal(size=(1500, 16)) * rng.choice([0.1, 0.6], (1500, 1))
    v[700:710] = v[5]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    sums, want = [], []
    for x in v:
        sims = [x @ s / np.linalg.norm(s) for s in sums]
        best = int(np.argmax(sims)) if sims and max(sims) >= 0.6 else len(sims)
        sums[best:] = [sums[best] + x, *sums[best + 1 :]] if best < len(sums) else [x]
        want.append(best)
    assert S._in_order(v, 0.6).tolist() == want and len(sums) > 40
    assert S._in_order(v[:0], 0.6).tolist() == [] and S._in_order(v, 0.6, at_once=7).tolist() == want
    odd = np.array([[1.0, 0.0], [np.nan, 0.0], [1.0, 0.0], [np.nan, 1.0], [0.0, 1.0]])
    assert S._in_order(odd, 0.6).tolist() == [0, 1, 0, 2, 3]
    many = rng.normal(size=(20_000, 16))
    start = time.perf_counter()
    S._in_order(many / np.linalg.norm(many, axis=1, keepdims=True), 0.9)
    assert time.perf_counter() - start < 20


def test_leaders_are_found_once(spark):
    """The result reads stored tables only: a plan that joins it to more, or a second pass over it, doesn't do the work anew."""
    rows = spark.range(12).selectExpr("id AS walk_seq", "id div 3 * 1048575 AS phash", "double(id % 5) AS focus", "1 AS pixels")
    found = S.leader_duplicates(rows, 2)
    assert "Range" not in found._jdf.queryExecution().optimizedPlan().toString()
    # the hash of 3, 4 and 5 is two bits from those of 6 and up, so these follow it; 4 and 9 are its best, 4 the first
    assert {r.walk_seq for r in found.where("not is_dup").collect()} == {2, 4}
