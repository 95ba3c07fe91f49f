"""Hard negatives against brute force: ties, repeats, zero, huge and odd vectors, lengths that differ, small blocks, a hot vector."""

import math
import random

import numpy as np

from undula.llm import hard_negatives as H

ROWS = "vec_id long, embedding array<double>, label int, id long, q int, size int, at long, rank int"


def brute(rows):
    v = []
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        q = [math.floor(256 * x) for x in e]
        if math.sqrt(sum(float(x) * x for x in q)) < 2**31:
            v.append((i, int(math.fmod(label + 1, 10)) if i % 7 == 0 else label, q))
    out = []
    for i in sorted({i for i, *_ in v if i % 100 == 0}):
        label, _, q = min((b, len(q), q) for a, b, q in v if a == i)
        scores = [(-sum(map(int.__mul__, q, p)), j, b == label) for j, b, p in v if j != i and len(p) == len(q)]
        for s, j, _ in sorted(x for x in scores if x[2])[:5]:
            near = sorted(x for x in scores if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s)[:5]
            out += [(i, j, k, n, -s, -t) for k, (t, n, _) in enumerate(near, 1)]
    return sorted(out)


def given(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], ROWS)


def mined(df):
    got = H.mined(df)
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    return sorted(tuple(r) for r in got.collect())


def small(monkeypatch, seeds=30):
    for name, value in (("LEAST", 40), ("MOST", 40), ("SEEDS", seeds)):
        monkeypatch.setattr(H, name, value)


def odd_rows():
    rng = np.random.default_rng(4)
    rows = []
    for i in range(-200, 700):
        center = np.eye(6)[i % 3] * (1 + i % 4)
        e = (center + rng.normal(size=6) * 0.3).tolist()
        rows.append((i, e, int(rng.integers(-2, 12)) if i % 11 else None))
    rows += [(1000 + k, [0.5, 0.5, 0.0, 0.0, 0.0, 0.0], k % 2) for k in range(0, 400)]  # a hot vector: ties everywhere
    rows += [(2000, None, 1), (2001, [], 1), (2100, [], 2), (2002, [None, 1.0], 1), (2003, [float("nan")] * 6, 1), (2200, [float("inf")] * 6, 1), (None, [1.0] * 6, 1)]
    rows += [(2300 + 100 * k, [0.0] * 6, k % 2) for k in range(4)] + [(2301 + k, [-1e-5] * 6, k % 3) for k in range(4)]
    rows += [(3000 + 50 * k, [1.0, -2.0, 0.25 * k], k % 2) for k in range(12)]  # another length
    rows += [(4000 + 50 * k, [1e6 * (k + 1), 3e6 + k / 256, 1.0, 0.0, 0.0, 4e6], k % 2) for k in range(8)]  # products beyond 2^53
    rows += [(5000, [1e30] * 6, 1), (5100, [9e6] * 6, 1)]
    return rows + rows[:40] + [(400, [9.0] * 6, 1)]


def test_odd_rows_equal_brute_force(spark, monkeypatch):
    small(monkeypatch)
    rows = odd_rows()
    assert mined(given(spark, rows)) == brute(rows)


def test_without_a_useful_sample(spark, monkeypatch):
    small(monkeypatch, 0)
    rows = [r for r in odd_rows() if r[0] is not None and r[0] < 500]
    want = brute(rows)
    assert want and mined(given(spark, rows)) == want


def test_nothing_to_mine(spark):
    assert mined(given(spark, [])) == [] and mined(given(spark, [(100, [1.0], 1)])) == [] and mined(given(spark, [(1, [1.0], 1), (2, [1.0], 2)])) == []


def test_pruning_loses_nothing_and_prunes():
    rng, rand = np.random.default_rng(1), random.Random(2)
    centers = rng.normal(size=(20, 16))
    q = centers[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 16)) * 0.2
    q = np.floor(256 * q / np.sqrt((q**2).sum(1, keepdims=True)))  # a bucket: about one length
    block, seen = H.Block(np.arange(2000), np.zeros(2000, np.int64), q), []
    for _ in range(200):
        own = q[rand.randrange(2000)]
        norm = float(np.sqrt((own**2).sum()))
        least = int(rand.uniform(0.75, 1.02) * norm * block.longest)
        rows = block.candidates(own, norm, least)
        assert set(np.flatnonzero(q @ own >= least)) <= set(rows.tolist())
        assert (block.products(own, norm, rows) == (q @ own).astype(np.int64)[rows]).all()
        seen.append(len(rows))
    assert np.mean(seen) < 600
    assert block.candidates(own, norm, 0) is None and len(block.candidates(own, norm, int(2 * norm * block.longest))) == 0
