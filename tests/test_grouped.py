"""Linear models of all folds at once against plain solvers, with nulls, constant columns and folds of one label."""

import numpy as np
import pytest

from undula.operators import grouped as L

K, REPEATS = 3, 2


@pytest.fixture(scope="module")
def given(spark):
    rng = np.random.default_rng(3)
    rows, split = [], []
    for record in range(18):
        for repeat in range(REPEATS):
            split.append((repeat, f"r{record}", int((record // 2 * (repeat + 1) + repeat) % K)))
        for s in range(6):
            x = rng.normal(size=4) + [record % 2, 0, -0.5 * (record % 2), 0]
            rows.append((record * 6 + s, f"r{record}", record % 2, *[None if rng.random() < 0.05 else float(v) for v in x[:3]], 7.0))
    df = spark.createDataFrame(rows, "segment_id long, record string, label int, a double, b double, c double, d double")
    return rows, split, L.assigned(df.repartition(3), ["a", "b", "c", "d"], spark.createDataFrame(split, "repeat int, record string, fold int"), REPEATS, K)


def plain(rows, split, group):
    """Standardised training rows, labels and balanced weights of a group, and its validation rows."""
    fold = {r: f for t, r, f in split if t == group // K}
    x, y = np.array([[np.nan if v is None else v for v in r[3:]] for r in rows]), np.array([r[2] for r in rows])
    train = np.array([fold[r[1]] != group % K for r in rows])
    x = np.where(np.isnan(x), np.nanmean(x[train], 0), x)
    s = x[train].std(0)
    z = np.where(s > 0, (x - x[train].mean(0)) / np.where(s > 0, s, 1), 0)
    z = np.hstack((z, np.ones((len(z), 1))))
    n = np.bincount(y[train], minlength=2)
    return z, y, train, (n.sum() / (2 * n))[y]


def descend(gradient, w, rounds=40_000, rate=2e-3):
    for _ in range(rounds):
        w = w - rate * gradient(w)
    return w


def test_logistic_and_its_scores(given):
    rows, split, data = given
    got = L.logistic(data)
    for g in (0, 4):
        z, y, train, s = plain(rows, split, g)
        p = lambda w: 1 / (1 + np.exp(-z[train] @ w))  # noqa: B023, E731
        want = descend(lambda w: z[train].T @ (0.5 * s[train] * (p(w) - y[train])) + w * [1, 1, 1, 1, 0], np.zeros(5))  # noqa: B023
        assert np.allclose(got[g], want, atol=1e-6) and got[g][3] == 0
    found = {(r["repeat"], r["segment_id"]): r for r in L.linear_scores(data, got).collect()}
    assert len(found) == REPEATS * len(rows)
    for g in range(REPEATS * K):
        z, y, train, _ = plain(rows, split, g)
        for k in np.flatnonzero(~train):
            r = found[g // K, rows[k][0]]
            assert r["fold"] == g % K and np.isclose(r["score"], 1 / (1 + np.exp(-z[k] @ got[g])))


def test_support_vectors_and_platt(given):
    rows, split, data = given
    model = L.support(data)
    link = L.platt(data, model)
    for g in (1, 5):
        z, y, train, s = plain(rows, split, g)
        side = 2 * y[train] - 1
        want = descend(lambda w: z[train].T @ (-4 * s[train] * side * np.maximum(1 - side * (z[train] @ w), 0)) + w * [1, 1, 1, 1, 0], np.zeros(5), rate=5e-4)  # noqa: B023
        assert np.allclose(z @ model[g], z @ want, atol=1e-6)
        m, n = z[train] @ model[g], np.bincount(y[train])
        t = np.where(y[train] > 0, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
        p = 1 / (1 + np.exp(-(link[g, 0] * m + link[g, 1])))
        assert abs((p - t).sum()) < 1e-6 and abs(((p - t) * m).sum()) < 1e-6 and link[g, 0] > 0


def test_one_label_and_no_rows(spark):
    df = spark.createDataFrame([(k, f"r{k}", int(k > 1), float(k)) for k in range(6)], "segment_id long, record string, label int, a double")
    split = spark.createDataFrame([(0, f"r{k}", int(k > 2)) for k in range(6)], "repeat int, record string, fold int")
    data = L.assigned(df, ["a"], split, 1, 2)
    assert data.taught().tolist() == [False, True]
    scores = {r["segment_id"]: r["score"] for r in L.linear_scores(data, L.logistic(data)).collect()}
    assert scores[0] == 0 and 0 < scores[5] < 1
    empty = L.assigned(df.limit(0), ["a"], split, 1, 2)
    assert L.linear_scores(empty, L.logistic(empty)).count() == 0 and not empty.taught().any()
