"""Feature plans stay small: what the driver plans, compiles and keeps doesn't depend on the data, but it has to fit its memory."""

import re

import numpy as np

from undula.operators import features as X
from undula.plans import signals, spectra


def exchanges(df):
    return len(re.findall(r"(?m)^\W*Exchange", df._jdf.queryExecution().executedPlan().toString()))


def test_sample_entropy_deals_segments_out_no_more(spark, sf):
    assert exchanges(signals.feat_sampen(spark, sf)) == 0


def test_long_segments_are_counted_as_short_ones(spark, monkeypatch):
    rng = np.random.default_rng(1)
    given = {"long": rng.normal(size=300).round(1), "short": rng.normal(size=50).round(1), "flat": np.ones(200), "tiny": np.ones(2)}
    rows = [(s, i, None if s == "long" and i % 90 == 7 else float(v)) for s, x in given.items() for i, v in enumerate(x)]
    samples = spark.createDataFrame(rows, "s string, i int, x double")
    want = sorted(map(tuple, X.sample_entropy(samples, ["s"]).collect()))
    assert len(want) == 4
    monkeypatch.setattr(X, "LONG", 100)
    assert sorted(map(tuple, X.sample_entropy(samples, ["s"]).collect())) == want


def test_all_features_move_segments_once_a_part(spark, sf):
    plan = signals.feat_all_wide(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") < 20 and plan.count("Exchange") < 40  # both were over 50


def test_recordings_are_dealt_out_once(spark, sf):
    """By record, for the place of a sample and for its segment: a shuffle of all samples less."""
    assert exchanges(spectra.price_windows(spark, sf)) == exchanges(signals.windows(spark, sf)) == 1
