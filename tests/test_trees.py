"""Trees of all folds at once: against a plain grower, with nulls and ties; bags, boosting's loss, odd tables."""

import numpy as np
import pytest

from undula.operators import grouped as L
from undula.operators import trees as T

K, REPEATS = 3, 2


def table(spark, count=20, seed=5):
    rng = np.random.default_rng(seed)
    rows, split = [], []
    for record in range(count):
        split += [(t, f"r{record}", int((record // 2 * (t + 1) + t) % K)) for t in range(REPEATS)]
        for s in range(5):
            x = np.round(rng.normal(size=3) + [0.8 * (record % 2), 0, 0], 1)
            rows.append((record * 5 + s, f"r{record}", record % 2, *[None if rng.random() < 0.04 else float(v) for v in x], 1.0))
    df = spark.createDataFrame(rows, "segment_id long, record string, label int, a double, b double, c double, d double")
    return rows, split, L.assigned(df, ["a", "b", "c", "d"], spark.createDataFrame(split, "repeat int, record string, fold int"), REPEATS, K)


def plain(x, y, cuts, depth):
    """A function from rows to scores: the best of all splits by Gini impurity, the first of equal ones."""
    value, best = y.mean(), (1e-7, None)
    good = lambda v: ((v == 0).sum() ** 2 + (v == 1).sum() ** 2) / max(len(v), 1)
    if depth:
        for f in range(x.shape[1]):
            for c in cuts[f]:
                left = x[:, f] <= c
                if left.any() and not left.all():
                    gain = round(good(y[left]) + good(y[~left]) - good(y), 9)
                    if gain > best[0]:
                        best = gain, (f, c)
    if best[1] is None:
        return lambda v: value
    f, c = best[1]
    left = x[:, f] <= c
    sides = plain(x[left], y[left], cuts, depth - 1), plain(x[~left], y[~left], cuts, depth - 1)
    return lambda v: sides[int(v[f] > c)](v)


@pytest.mark.parametrize("few", [20_000, 0])
@pytest.mark.parametrize("depth", [3, 30])
def test_trees_equal_a_plain_grower(spark, monkeypatch, depth, few):
    monkeypatch.setattr(T, "FEW", few)
    rows, split, folds = table(spark)
    data = T.binned(folds)
    got = {(r["repeat"], r["segment_id"]): r for r in T.scored(data, T.tree(data, depth)).collect()}
    assert len(got) == REPEATS * len(rows)
    x, y = np.array([[np.nan if v is None else v for v in r[3:]] for r in rows]), np.array([r[2] for r in rows])
    for g in range(REPEATS * K):
        fold = {r: f for t, r, f in split if t == g // K}
        train = np.array([fold[r[1]] != g % K for r in rows])
        full = np.where(np.isnan(x), np.nanmean(x[train], 0), x)
        want = plain(full[train], y[train], data.cuts, depth)
        for k in np.flatnonzero(~train):
            assert np.isclose(got[g // K, rows[k][0]]["score"], want(full[k]), atol=1e-9)


def test_small_blocks_and_chunks_change_nothing(spark, monkeypatch):
    _, _, folds = table(spark)
    data = T.binned(folds)
    grown = lambda: T.forest(data, trees=7, depth=4, together=11)
    one = grown()
    monkeypatch.setattr(T, "CELLS", 1)
    monkeypatch.setattr(T, "PAIRS", 5)
    monkeypatch.setattr(T, "DENSE", 0)
    same(one, grown())
    assert data.chunks > 1
    monkeypatch.setattr(T, "FEW", 0)
    data = T.binned(folds)
    assert data.chunks == 1
    assert len(one.root) == 7 * folds.groups and len({tuple(one.feature[[r, one.child[r]]]) for r in one.root}) > 1


@pytest.mark.parametrize("parts", [0, 1, 2])
def test_sparse_cells_equal_dense_ones(monkeypatch, parts):
    rng = np.random.default_rng(3)
    added = [(rng.integers(0, 60, 200), rng.random((200, 2))) for _ in range(parts)]
    dense = T._Cells(60, 2)
    monkeypatch.setattr(T, "DENSE", 0)
    sparse = T._Cells(60, 2)
    for cells in (dense, sparse):
        for code, sums in added:
            cells.add(code, sums)
    for lo, hi in ((0, 25), (25, 60), (7, 8)):
        assert np.allclose(dense.between(lo, hi), sparse.between(lo, hi))
    assert all(np.allclose(a, b) for a, b in zip(dense.filled(), sparse.filled(), strict=True))


def test_cells_that_one_pass_adds_unmerged(spark, monkeypatch):
    """All rows of a level in one part, more cells than an array holds, several blocks: as the forest's query has it."""
    _, _, folds = table(spark)
    data = T.binned(folds)
    assert data.chunks > 1
    grown = lambda: T.forest(data, trees=7, depth=4)
    one = grown()
    monkeypatch.setattr(T, "CELLS", 1)
    monkeypatch.setattr(T, "DENSE", 0)
    same(one, grown())


def same(one, two):
    for name in ("group", "root", "feature", "cut", "child"):
        assert (getattr(one, name) == getattr(two, name)).all()
    assert np.allclose(one.value, two.value)


def test_bags_are_poisson():
    times = T._bag(np.arange(20_000), np.arange(3))
    assert abs(times.mean() - 1) < 0.02 and abs(times.var() - 1) < 0.05 and abs(np.corrcoef(times[:, 0], times[:, 1])[0, 1]) < 0.03


def test_boosting_lowers_the_loss_at_every_round(spark, monkeypatch):
    rows, split, folds = table(spark)
    monkeypatch.setattr(T, "EVERY", 2)
    monkeypatch.setattr(T, "FEW", 0)
    data = T.binned(folds)
    model = T.boosted(data, rounds=5, depth=2)
    x = np.array([[np.nan if v is None else v for v in r[3:]] for r in rows])
    y, bins, losses = np.array([r[2] for r in rows]), T._bins(x, data.cuts), []
    for g in range(folds.groups):
        fold = {r: f for t, r, f in split if t == g // K}
        train = np.flatnonzero([fold[r[1]] != g % K for r in rows])
        f, own = np.full(len(train), model.start[g]), np.flatnonzero(model.trees.group == g)
        losses = []
        for t in own:
            losses.append(np.logaddexp(0, f).mean() - (y[train] * f).mean())
            leaf = model.trees.leaf(bins, data.means, train, np.full(len(train), t))
            p = 1 / (1 + np.exp(-f))
            for node in np.unique(leaf):  # each leaf's step is Newton's on the residuals so far
                at = leaf == node
                assert np.isclose(model.trees.value[node], (y[train][at] - p[at]).sum() / (p[at] * (1 - p[at])).sum())
            f = f + model.rate * model.trees.value[leaf]
        losses.append(np.logaddexp(0, f).mean() - (y[train] * f).mean())
        assert len(own) == 5 and (np.diff(losses) < 0).all()
    assert all(0 < r["score"] < 1 for r in T.scored(data, model).collect())


def test_odd_tables(spark):
    df = spark.createDataFrame([(k, f"r{k}", int(k > 1), 3.0) for k in range(6)], "segment_id long, record string, label int, a double")
    split = spark.createDataFrame([(0, f"r{k}", int(k > 2)) for k in range(6)], "repeat int, record string, fold int")
    data = T.binned(L.assigned(df, ["a"], split, 1, 2))  # nothing to split, and a fold of one label
    for model in (T.tree(data), T.forest(data, 3), T.boosted(data, 2)):
        scores = {r["segment_id"]: r["score"] for r in T.scored(data, model).collect()}
        assert scores[0] == 0 and 0 <= scores[5] <= 1
    empty = T.binned(L.assigned(df.limit(0), ["a"], split, 1, 2))
    assert T.scored(empty, T.forest(empty, 2)).count() == 0
