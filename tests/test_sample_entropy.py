"""Sample entropy on a grid: counts of brute force on dense, tied and far-off signals, and few comparisons on a flat one."""

import numpy as np
import pytest

from undula.operators import features as X


def brute(x, m, r):
    t = np.lib.stride_tricks.sliding_window_view(x, m + 1)
    tol, b, a = r * x.std(), 0, 0
    for i in range(len(t) - 1):
        near = np.abs(t[i + 1 :] - t[i]) <= tol
        first = near[:, :m].all(1)
        b, a = b + int(first.sum()), a + int((first & near[:, m]).sum())
    return b, a


def table(spark, signals):
    return spark.createDataFrame([(s, i, float(v)) for s, x in signals.items() for i, v in enumerate(x)], "s string, i int, x double")


def flat(n):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.01, n)
    x[rng.choice(n, 20, replace=False)] = 50
    return x


@pytest.mark.parametrize(("m", "r"), [(2, 0.1), (2, 0.5), (1, 0.2), (3, 0.3)])
def test_counts_equal_brute_force(spark, m, r):
    rng = np.random.default_rng(m)
    given = {
        "normal": rng.normal(size=300),
        "tied": rng.normal(size=300).round(1),
        "steps": np.repeat(rng.integers(0, 4, 60), 5).astype(float),
        "far": rng.normal(size=200).round(2) + 1e6,
        "flat": flat(400),
        "sine": np.sin(np.arange(300) / 5),
        "constant": np.ones(50),
    }
    got = {k["s"]: (k["b"], k["a"]) for k in X.sample_entropy(table(spark, given), ["s"], m=m, r=r).collect()}
    assert got == {k: brute(x, m, r) if x.std() > 0 else (0, 0) for k, x in given.items()}


def test_a_flat_signal_takes_few_comparisons(spark):
    x = flat(20000)
    samples = table(spark, {"flat": x})
    templates = X.template_cells(samples, ["s"])
    met = X.cell_pairs(templates, ["s"])
    rows = met.count() + X.compared_templates(templates, met, ["s"]).count()
    want = brute(x, 2, 0.1)
    got = X.sample_entropy(samples, ["s"]).first()
    assert (got["b"], got["a"]) == want and want[0] > 190_000_000
    assert rows < want[0] / 10
