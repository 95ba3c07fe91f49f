"""A run taken up again fits what is missing, broken or out of date, and ends with an unbroken run's results."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.operators import evaluate as E
from undula.operators import grouped as L
from undula.operators import models as M
from undula.operators import runs as J
from undula.operators import splits as P

NAMES = ["f1", "f2"]


class Stopped(Exception):
    pass


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    data = [(f"r{k % 20}", k, k % 20 % 2, float(rng.normal() + k % 20 % 2), float(rng.normal())) for k in range(80)]
    return spark.createDataFrame(data, "record string, segment_id int, label int, f1 double, f2 double").cache()


def bayes(calls, stop_at=None, parameters="a"):
    def predict(rows, split):
        numbers = sorted(r[0] for r in split.select("repeat").distinct().collect())
        if stop_at is not None and stop_at in numbers:
            raise Stopped
        calls.append(numbers)
        return E.record_scores(M.naive_bayes(P.expanded(rows, split), NAMES).filter("not train"), ["repeat", "fold"])

    return J.Study("NB", parameters, predict)


def logistic(calls):
    def predict(rows, split):
        numbers = sorted(r[0] for r in split.select("repeat").distinct().collect())
        calls.append(numbers)
        data = L.assigned(rows, NAMES, split, len(numbers))
        scored = E.record_scores(L.linear_scores(data, L.logistic(data)), ["repeat", "fold"])
        return scored.withColumn("repeat", F.element_at(F.array(*[F.lit(n) for n in numbers]), F.col("repeat") + 1))

    return J.Study("Logistic Regression", "c=0.5", predict)


def stored(spark, path):
    return sorted((r["model"], r["repeat"], r["fold"], r["record"], r["label"], round(r["score"], 9)) for r in J.results(spark, path).collect())


def test_a_stopped_run_goes_on(spark, rows, tmp_path):
    path, straight = str(tmp_path / "a"), str(tmp_path / "b")
    J.resume(rows, NAMES, [bayes([]), logistic([])], 3, straight)
    calls = []
    with pytest.raises(Stopped):
        J.resume(rows, NAMES, [bayes(calls, stop_at=2)], 3, path, at_a_time=1)
    assert calls == [[0], [1]]
    again, linear = [], []
    done = J.resume(rows, NAMES, [bayes(again), logistic(linear)], 3, path)
    assert again == [[2]] and linear == [[0, 1, 2]]
    assert {(r["model"], r["repeat"]) for r in done.collect() if not r["fitted"]} == {("NB", 0), ("NB", 1)}
    assert stored(spark, path) == stored(spark, straight) and len(stored(spark, path)) == 2 * 3 * 20
    J.resume(rows, NAMES, [bayes(again), logistic(linear)], 3, path)
    assert len(again) == len(linear) == 1


def test_what_is_broken_or_out_of_date_is_fitted_again(spark, rows, tmp_path):
    path, calls = str(tmp_path / "a"), []
    J.resume(rows, NAMES, [bayes([])], 3, path, at_a_time=1)
    want = stored(spark, path)
    for f in glob.glob(f"{path}/experiment=run/model=NB/repeat=1/*.parquet"):
        os.remove(f)
    part = J.results(spark, path).filter("repeat = 2 and record <> 'r3'").collect()
    J.write_results(spark.createDataFrame(part, J.RESULTS), path)
    J.resume(rows, NAMES, [bayes(calls)], 3, path)
    assert calls == [[1, 2]] and stored(spark, path) == want
    J.resume(rows, NAMES, [bayes(calls, parameters="b")], 2, path)
    assert calls[1:] == [[0, 1]]
    J.resume(rows.withColumn("f1", F.col("f1") * 2), NAMES, [bayes(calls, parameters="b")], 1, path)
    assert calls[2:] == [[0]]
    before = len(stored(spark, path))
    J.resume(rows, NAMES, [bayes(calls)], 1, path, experiment="other")
    assert calls[3:] == [[0]] and len(stored(spark, path)) == before + 20


def test_incomplete_fits_raise(spark, rows, tmp_path):
    lame = J.Study("lame", "", lambda rows, split: split.filter("record <> 'r1'").withColumn("score", F.lit(0.5)))
    with pytest.raises(RuntimeError, match="lame"):
        J.resume(rows, NAMES, [lame], 2, str(tmp_path / "a"))
    with pytest.raises(ValueError):
        J.resume(rows, NAMES, [lame], 31, str(tmp_path / "a"))
