"""Trees that are grown and used within a task: as those that come to the driver, and as those of many rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_trees import table
from undula.operators import trees as T


def scores(df, *more):
    return {tuple(r[c] for c in ("segment_id", "repeat", *more)): r["score"] for r in df.collect()}


def alike(one, two):
    assert one.keys() == two.keys() and len(one) > 0
    assert all(np.isclose(one[k], two[k], atol=1e-9) for k in one)


def test_scores_within_tasks_equal_scores_of_collected_trees(spark):
    _, _, folds = table(spark)
    data = T.binned(folds)
    assert data.chunks > 1
    for own, model in ((T.tree_scores(data), T.tree(data)), (T.forest_scores(data, None, 7, 4), T.forest(data, 7, 4)), (T.boosted_scores(data, 5, 2), T.boosted(data, 5, 2))):
        assert own.columns == T.scored(data, model).columns
        alike(scores(own), scores(T.scored(data, model)))
    rows = folds.rows.select("segment_id", "label", "x", F.lit(1).alias("repeat"), F.lit(2).alias("fold"), F.explode(F.array(F.lit("p"), F.lit("q"))).alias("kind"))
    alike(scores(T.forest_scores(data, rows, 7, 4), "kind"), scores(T.scored(data, T.forest(data, 7, 4), rows), "kind"))


def test_boosting_dealt_by_trees_equals_boosting_dealt_by_rows(spark, monkeypatch):
    _, _, folds = table(spark)
    few = scores(T.boosted_scores(T.binned(folds), 6, 3))
    monkeypatch.setattr(T, "FEW", 0)
    data = T.binned(folds)
    assert data.chunks == 1
    alike(few, scores(T.boosted_scores(data, 6, 3)))


def test_tables_over_the_old_limit_are_dealt_by_trees(spark):
    """102,564 rows took the path by rows, whose cells filled the executors."""
    assert T.FEW * T.WIDE >= 615_384 * 64
    assert T.binned(table(spark)[2]).rows.columns == ["id", "segment_id", "record", "label", "own", "draw", "bins"]  # without x: rows are sent compact


@pytest.mark.parametrize("weights", [(1.0, 1.0), (0.7, 1.9)])
def test_runs_find_the_splits_of_histograms(weights):
    rng = np.random.default_rng(2)
    nodes, bins, n = 40, 16, 300
    at, b, y, times = rng.integers(0, nodes, n), rng.integers(0, bins, n), rng.integers(0, 2, n), rng.integers(1, 4, n)
    w = np.array(weights)
    h = np.bincount((at * bins + b) * 2 + y, times, nodes * bins * 2).reshape(nodes, 1, bins, 2) * w
    want, got = T._best(h, "class"), T._runs(at * bins + b, (y, times), bins, nodes, w)
    assert np.allclose(want[0], got[0]) and np.allclose(want[4], got[3])
    split = want[0] > 0
    assert (want[2] == got[1])[split].all() and np.allclose(want[3][split], got[2][split])


@pytest.mark.parametrize("kind", ["class", "residual"])
def test_a_histogram_may_be_the_rest_of_its_parents(monkeypatch, kind):
    rng = np.random.default_rng(4)
    n, d, bins = 3000, 5, 8
    rows = T._Whole(2, np.zeros((2, d), np.uint8))
    rows.id, rows.draw, rows.own = np.arange(n), np.arange(n), (np.arange(n) % 2)[:, None].astype(np.int16)
    rows.bins = rng.integers(0, bins, (n, d)).astype(np.uint8)
    rows.label = (rows.bins[:, 0] + rng.integers(0, bins, n) > bins).astype(np.uint8)
    sums = np.stack((rng.normal(size=n // 2), rng.random(n // 2))) if kind == "residual" else None
    own = T._Grower(np.zeros(1, int), 2, 6, d, bins, False, kind, None, 0, np.ones((2, 2)), rows.means, np.ones(2, bool))
    one = own.alone(rows, 0, sums)
    monkeypatch.setattr(T, "CELLS", 0)  # a feature at a time, each counted
    two = own.alone(rows, 0, sums)
    assert len(one[0].feature) > 20 and (one[2] == two[2]).all()
    for name in ("feature", "cut", "child"):
        assert (getattr(one[0], name) == getattr(two[0], name)).all()
    assert np.allclose(one[0].value, two[0].value)
