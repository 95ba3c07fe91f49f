"""Spectral queries cover whole records and the first mode."""

import numpy as np

from undula.operators import decompose, spectral
from undula.plans import spectra
from undula.sources import tables as S


def test_regridded_records_reach_their_last_sample(spark, sf):
    size = {r["record"]: r["count"] for r in S.event_samples(spark, sf).groupBy("record").count().collect()}
    got = {r["record"]: (r["count"], r["max(t)"]) for r in spectra.sig_regrid_record(spark, sf).groupBy("record").agg({"*": "count", "t": "max"}).withColumnRenamed("count(1)", "count").collect()}
    assert got == {k: (2 * n - 2, 2 * n - 2.5) for k, n in size.items() if n > 1}


def test_mode_spectra_are_of_the_first_mode(spark, sf):
    windows = {}
    for r in spectra.price_windows(spark, sf).collect():
        windows.setdefault((r["record"], r["segment_id"]), []).append((r["i"], r["x"]))
    per = {}
    for (record, _), x in windows.items():
        modes, _ = decompose.decompose(np.array([v for _, v in sorted(x)]))
        if modes:
            per.setdefault(record, []).append(spectral.welch_values(modes[0], 20.0, 64)[1])
    want = {k: np.mean(v, 0)[:17] for k, v in per.items()}
    got = {}
    for r in spectra.emd_record_psd(spark, sf).orderBy("record", "freq").collect():
        got.setdefault(r["record"], []).append(r["psd"])
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], rtol=1e-6, atol=1e-5) for k in want)
    for r in spectra.emd_class_psd(spark, sf).collect():
        k = round(r["freq"] * 64 / 20)
        for name, label in (("term", 0), ("preterm", 1)):
            have = [v[k] for key, v in want.items() if int(key) % 2 == label]
            assert r[name] is None if not have else np.isclose(r[name], np.mean(have), rtol=1e-6, atol=1e-5)


def test_overlapping_windows_equal_transforms(spark):
    rng = np.random.default_rng(2)
    rows = [(s, i, float(v)) for s, n in enumerate((7, 8, 9, 21, 64)) for i, v in enumerate(rng.normal(size=n))]
    df = spark.createDataFrame(rows, "s int, i int, x double")
    for size in (8, 9):
        got = {}
        for r in spectral.welch_windows(df, ["s"], size, 20.0).orderBy("s", "freq").collect():
            got.setdefault(r["s"], []).append((r["freq"], r["psd"]))
        for s, n in enumerate((7, 8, 9, 21, 64)):
            x = np.array([v for k, _, v in rows if k == s])
            if n < size:
                assert s not in got
            else:
                assert np.allclose(got[s], np.stack(spectral.welch_values(x, 20.0, size), 1), atol=1e-12)


def test_autocorrelation_equals_sums_of_products(spark):
    rng = np.random.default_rng(3)
    signals = [rng.normal(size=n) for n in (1, 2, 3, 5, 64, 700, 64)] + [np.ones(9), np.array([1.0, np.nan, 2.0, 3.0])]
    df = spark.createDataFrame([(s, i, float(v)) for s, x in enumerate(signals) for i, v in enumerate(x)], "s int, i int, x double")
    got = {}
    for r in spectral.autocorrelation(df, ["s"], 400).orderBy("s", "lag").collect():
        got.setdefault(r["s"], []).append(r["r"])
    for s, x in enumerate(signals):
        d = x - x.mean()
        flat = len(x) < 3 or not np.isfinite(x).all() or np.abs(d).max() <= 1e-8
        want = [1.0] if flat else [(d[: len(x) - k] * d[k:]).sum() / ((d * d).sum() + 1e-12) for k in range(min(400, len(x) - 1) + 1)]
        assert np.allclose(got[s], want, atol=1e-12)


def plain_spline(at, value, n):
    """Natural cubic spline at 0 ... n - 1 by a full system of equations."""
    h, slope = np.diff(at), np.diff(value) / np.diff(at)
    a, b = np.eye(len(at)), np.zeros(len(at))
    for k in range(1, len(at) - 1):
        a[k, k - 1 : k + 2], b[k] = (h[k - 1], 2 * (h[k - 1] + h[k]), h[k]), 6 * (slope[k] - slope[k - 1])
    m = np.linalg.solve(a, b)
    j = np.clip(np.searchsorted(at, np.arange(n), side="right") - 1, 0, len(h) - 1)
    d = np.arange(n) - at[j]
    return value[j] + d * (slope[j] - h[j] * (2 * m[j] + m[j + 1]) / 6) + d**2 * m[j] / 2 + d**3 * (m[j + 1] - m[j]) / (6 * h[j])


def test_envelopes_of_a_batch_equal_plain_splines():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(30, 50)), 1)
    top, _ = decompose._extrema(x)
    got = decompose._envelopes(x, top)
    for row, mark, have in zip(x, top, got, strict=True):
        at = np.flatnonzero(mark)
        knots = np.concatenate((-at[:2][::-1], at, 2 * 49 - at[-2:][::-1])).astype(float)
        values = np.concatenate((row[at[:2][::-1]], row[at], row[at[-2:][::-1]]))
        assert np.allclose(have, plain_spline(knots, values, 50), atol=1e-9)


def test_rows_are_decomposed_as_one_by_one():
    x = np.cumsum(np.random.default_rng(5).normal(size=(20, 120)), axis=1)
    x[3], x[4] = 0.0, np.arange(120)
    modes, rest = decompose.decompose_rows(x)
    for row, own, left in zip(x, modes, rest, strict=True):
        one, residual = decompose.decompose(row)
        assert len(one) == len(own) and all(np.array_equal(a, b) for a, b in zip(one, own, strict=True)) and np.array_equal(left, residual)
        assert np.allclose(sum(own, left), row)
