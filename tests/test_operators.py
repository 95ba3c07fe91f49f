"""Hand-computed and brute-force cases of the operators."""

import time
import itertools
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from undula.functions import columns as C
from undula.operators import assemble as A
from undula.operators import decompose as D
from undula.operators import evaluate as E
from undula.operators import features as X
from undula.operators import importance as I
from undula.operators import models as M
from undula.operators import reports as R
from undula.operators import runs as J
from undula.operators import segments as G
from undula.operators import spectral as W
from undula.operators import splits as P
from undula.plans import evaluation
from undula.sources import sinks, tables

SIGNALS = {
    "ramp": [float(i) for i in range(10)], "constant": [3.0] * 20, "spike": [0.0] * 10 + [5.0] + [0.0] * 9, "plateau": [0.0, 0.0, 4.0, 4.0, 4.0, 0.0, 0.0],
    "short": [1.0, 2.0, 1.0, 2.0], "broken": [1.0] * 10 + [float("nan")] + [2.0] * 9,
}


def signals(spark, given):
    return spark.createDataFrame([(k, i, x) for k, v in given.items() for i, x in enumerate(v)], "s string, i int, x double")


def test_features_of_hand_made_signals(spark):
    rows = {r["s"]: r for r in X.all_features(signals(spark, SIGNALS), ["s"], fs=20.0).collect()}
    assert rows["ramp"]["DASDV"] == pytest.approx(1) and rows["ramp"]["MTKE"] == pytest.approx(1) and rows["ramp"]["perm_entropy"] == pytest.approx(0, abs=1e-9)
    assert rows["constant"]["SE"] == 0 and rows["constant"]["sampen"] is None and rows["constant"]["PEAK_RATE"] == 0 and rows["constant"]["PEAK_AMP_MEAN"] is None
    spike = rows["spike"]
    assert spike["PEAK_RATE"] == pytest.approx(1) and spike["BURST_RATE"] == pytest.approx(1) and spike["PEAKS_PER_BURST_MEAN"] == 1
    assert spike["PEAK_AMP_CV"] is None and spike["IPI_MEAN"] is None and spike["PEAK_AMP_MEAN"] == 5 and spike["PW_MEAN"] == pytest.approx(1 / 20)
    for k in ("short", "broken"):
        assert all(rows[k][f] is None for f in X.FEATURES)


def test_flat_top_counts_once_in_its_middle(spark):
    m = X.threshold(signals(spark, {"p": SIGNALS["plateau"]}), ["s"], 0.0)
    assert [(r["p"], r["h"]) for r in X.peaks(m, ["s"], 1).collect()] == [(3, 4.0)]


@pytest.mark.parametrize("gap,kept", [(5, 1), (6, 2)])
def test_suppression_boundary(spark, gap, kept):
    x = [0.0] * 30
    x[10], x[10 + gap] = 5.0, 4.0
    m = X.threshold(signals(spark, {"p": x}), ["s"], 0.0)
    assert X.peaks(m, ["s"], 6).count() == kept


def test_peaks_and_widths_against_brute_force(spark):
    rng = np.random.default_rng(1)
    given = {str(k): np.abs(rng.normal(size=60)).round(2).tolist() for k in range(5)}
    m = X.threshold(signals(spark, given), ["s"], 0.1)
    found = X.peaks(m, ["s"], 4)
    got = {(r["s"], r["p"]): (r["prominence"], r["width"]) for r in X.widths(m, found, ["s"]).collect()}
    want = {}
    for k, x in given.items():
        x = np.array(x)
        th = np.median(x) + 0.1 * (np.median(np.abs(x - np.median(x))) + 1e-12)
        cand, i = [], 1
        while i < len(x) - 1:
            j = i
            while j + 1 < len(x) and x[j + 1] == x[i]:
                j += 1
            if j + 1 < len(x) and x[i - 1] < x[i] > x[j + 1] and x[i] >= th:
                cand.append((i + j) // 2)
            i = j + 1
        kept = []
        for p in sorted(cand, key=lambda p: (x[p], p), reverse=True):
            if all(abs(p - q) >= 4 for q in kept):
                kept.append(p)
        for p in kept:
            lo = p
            while lo > 0 and x[lo - 1] <= x[p]:
                lo -= 1
            hi = p
            while hi < len(x) - 1 and x[hi + 1] <= x[p]:
                hi += 1
            prom = x[p] - max(x[lo : p + 1].min(), x[p : hi + 1].min())
            e = x[p] - prom / 2
            a = p
            while x[a] > e:
                a -= 1
            b = p
            while x[b] > e:
                b += 1
            left = a + ((e - x[a]) / (x[a + 1] - x[a]) if x[a] < e else 0)
            right = b - ((e - x[b]) / (x[b - 1] - x[b]) if x[b] < e else 0)
            want[(k, p)] = (prom, right - left)
    assert got.keys() == want.keys()
    for key, v in want.items():
        assert got[key] == pytest.approx(v)


def test_sample_and_permutation_entropy_against_brute_force(spark):
    rng = np.random.default_rng(2)
    given = {str(k): rng.normal(size=80).round(1).tolist() for k in range(3)}
    s = signals(spark, given)
    got = {r["s"]: (r["b"], r["a"]) for r in X.sample_entropy(s, ["s"], r=0.3).collect()}
    perm = {r["s"]: r["perm_entropy"] for r in X.permutation_entropy(s, ["s"]).collect()}
    for k, x in given.items():
        x = np.array(x)
        tol, n = 0.3 * x.std(), len(x) - 2
        b = a = 0
        for i, j in itertools.combinations(range(n), 2):
            if max(abs(x[i] - x[j]), abs(x[i + 1] - x[j + 1])) <= tol:
                b += 1
                a += abs(x[i + 2] - x[j + 2]) <= tol
        assert got[k] == (b, a)
        counts = {}
        for i in range(n):
            q = tuple(np.argsort(x[i : i + 3], kind="stable"))
            counts[q] = counts.get(q, 0) + 1
        p = np.array([*counts.values()]) / n
        assert perm[k] == pytest.approx(-(p * np.log(p)).sum() / math.log(6), abs=1e-9)


def test_burst_break_is_strict(spark):
    f = spark.createDataFrame([("a", p) for p in (0, 38, 78, 120)], "s string, p int")  # gaps 1.9, 2.0, 2.1 s
    assert [r["burst"] for r in X.bursts(f, ["s"], 20.0, 2.0).orderBy("p").collect()] == [1, 1, 1, 2]


def test_markers(spark):
    notes = {"over": "BC BC EC", "orphan": "EC", "mixed": "BC BD EC ED", "none": "BC"}
    rows = [(k, i, i, n) for k, v in notes.items() for i, n in enumerate(v.split())] + [("flat", 3, 0, "BC"), ("flat", 3, 1, "EC")]
    a = spark.createDataFrame(rows, "record string, sample long, seq long, note string")
    assert sorted(map(tuple, G.marker_pairs(a, "BC", "EC").collect())) == [("mixed", 0, 2), ("over", 1, 2)]
    assert sorted(map(tuple, G.annotated_intervals(a).collect())) == [("mixed", 0, 2), ("mixed", 1, 3), ("over", 1, 2)]


def test_windows_drop_the_tail(spark):
    sizes = spark.createDataFrame([("a", 31), ("b", 15), ("c", 32)], "record string, n_samples long")
    assert sorted((r["record"], r["start_sample"]) for r in G.fixed_windows(sizes, 16).collect()) == [("a", 0), ("c", 0), ("c", 16)]


def test_empty_segments_keep_their_number(spark):
    iv = spark.createDataFrame([("a", 0, 5), ("a", 6, 6), ("a", 7, 9)], "record string, start_sample long, end_sample long")
    assert sorted(r["segment_id"] for r in G.numbered(iv, "m", 20.0).collect()) == [0, 2]


def test_header_comments(spark):
    text = ["# Age 31", "#\tParity\t2", "## Smoker no way", "# Lone", "#  ", "# comments:", "# Age 33", "x Weight 1"]
    lines = spark.createDataFrame([("r", i, t) for i, t in enumerate(text)], "k string, pos int, line string")
    assert tables.header_comments(lines, "k", "line", "pos").first()["comments"] == {"Age": "33", "Parity": "2", "Smoker": "no way"}
    with pytest.raises(PySparkException):
        tables.header_files(spark, "/nowhere/*.hea").count()


def test_metrics_edge_cases(spark):
    rows = [("perfect", 1, 0.9), ("perfect", 0, 0.1), ("inverted", 1, 0.1), ("inverted", 0, 0.9), ("tied", 1, 0.5), ("tied", 0, 0.5), ("one", 1, 0.4), ("one", 1, 0.6)]
    s = spark.createDataFrame(rows, "model string, label int, score double")
    auc = {r[0]: r[1] for r in E.roc_auc(s, ["model"]).collect()}
    ap = {r[0]: r[1] for r in E.average_precision(s, ["model"]).collect()}
    th = {r[0]: r[1] for r in E.thresholds(s, ["model"]).collect()}
    assert (auc["perfect"], auc["inverted"], auc["tied"], auc["one"]) == (1, 0, 0.5, None)
    assert (ap["perfect"], ap["inverted"], ap["tied"], ap["one"]) == (1, 0.5, 0.5, None)
    assert (th["perfect"], th["one"]) == (0.9, 0.5)
    m = {r["model"]: r for r in E.binary_metrics(E.applied(s, E.thresholds(s, ["model"]), ["model"]), ["model"]).collect()}
    assert m["one"]["specificity"] is None and m["one"]["balanced_accuracy"] == 0.5 and m["one"]["mcc"] == 0
    with pytest.raises(ValueError):
        E.record_scores(s, [], "mode")
    with pytest.raises(ValueError):
        E.thresholds(s, ["model"], "loss")


def test_consensus_guards(spark):
    def votes(n, ones):
        return spark.createDataFrame([("r", 1, k, int(k < ones), 0.5) for k in range(n)], "record string, label int, repeat int, prediction int, score double")

    assert E.consensus(votes(30, 16), [], 30).first()["consensus"] == 1
    for bad in (votes(30, 15), votes(29, 20)):
        with pytest.raises(PySparkException):
            E.consensus(bad, [], 30).collect()


def test_labels_and_names(spark):
    names = spark.createDataFrame([("rec_p001",), ("x_T1",), ("x_n",), ("solo",)], "record string")
    assert [r[0] for r in names.select(C.parse_label()).collect()] == [1, 0, -1, -1]
    with pytest.raises(PySparkException):
        P.record_labels(spark.createDataFrame([("a", 0), ("a", 1)], "record string, label int")).collect()
    with pytest.raises(PySparkException):
        A.normalised_models(spark.createDataFrame([("XYZ",)], "model string")).collect()
    assert A.normalised_models(spark.createDataFrame([("Random Forest",)], "model string")).first()["model"] == "RF"
    with pytest.raises(ValueError):
        A.families(["ch1_UNKNOWN"])
    assert A.families(["ch1_LOG"])["Temporal energy features"] == ["ch1_LOG"]
    with pytest.raises(ValueError):
        tables.key_column(spark.range(1))
    with pytest.raises(ValueError):
        C.mode_number("imfs", 0)
    with pytest.raises(ValueError):
        tables.required(spark.range(1), ["score"])
    assert A.main_first([1, 2, 3], 2) == [2, 1, 3]


def test_repeated_record_raises(spark):
    p = spark.createDataFrame([("m", "r", 1, 0.5, 1)] * 2, "model string, record string, label int, score double, prediction int")
    with pytest.raises(PySparkException):
        E.repeat_metrics(p, ["model"]).collect()


def test_folds(spark):
    rec = spark.createDataFrame([(f"{'pt'[k % 2]}_{k}", 1 - k % 2) for k in range(26)], "record string, label int")
    f = P.folds(rec, 3).collect()
    assert all(sum(r["repeat"] == k for r in f) == 26 for k in range(3))
    for k in range(3):
        sizes = [sorted(sum(r["fold"] == i and r["repeat"] == k and r["label"] == y for r in f) for y in (0, 1)) for i in range(5)]
        assert sorted(map(tuple, sizes)) == [(2, 3)] * 4 + [(3, 3)]
    e = P.expanded(rec.withColumn("x", F.lit(1.0)), P.folds(rec, 1))
    assert G.leaks(e.filter("train"), e.filter("not train"), ["repeat", "fold", "record"]).count() == 0


def test_decomposition_sums_to_the_signal():
    t = np.arange(400) / 20
    x = np.sin(2 * np.pi * 0.5 * t) + 0.7 * np.sin(2 * np.pi * 3 * t)
    modes, rest = D.decompose(x)
    assert 1 <= len(modes) <= 4 and np.allclose(sum(modes) + rest, x, atol=1e-9)
    assert np.corrcoef(modes[0], np.sin(2 * np.pi * 3 * t))[0, 1] > 0.95
    for bad in ([1, 2, 3], [1, 2, np.nan, 4, 5, 6]):
        with pytest.raises(ValueError):
            D.decompose(np.array(bad, float))
    modes, rest = D.decompose(np.arange(20.0))
    assert modes == [] and (rest == np.arange(20)).all()


def test_missing_modes_have_no_features(spark):
    d = D.decomposition(signals(spark, {"line": SIGNALS["ramp"]}), ["s"])
    assert D.component(d, ["s"], 1).count() == 0 and D.components(d, ["s"]).count() == 10


def test_spectra(spark):
    x = np.random.default_rng(3).normal(size=16)
    s = signals(spark, {"a": x.tolist()})
    one = sorted(map(tuple, W.welch(s, ["s"], 20.0, 16).select("freq", "psd").collect()))
    two = sorted(map(tuple, W.welch_single(s, ["s"], 16, 20.0).select("freq", "psd").collect()))
    assert np.allclose(one, two)
    short = W.welch(signals(spark, {"b": [1.0] * 5}), ["s"]).collect()
    assert [(r["freq"], r["psd"]) for r in short] == [(0.0, None)]
    r = {(x["s"], x["lag"]): x["r"] for x in W.autocorrelation(signals(spark, {"c": [2.0] * 9, "a": x.tolist()}), ["s"], 3).collect()}
    assert r[("c", 0)] == 1.0 and ("c", 1) not in r and r[("a", 0)] == pytest.approx(1)


def test_permuting_a_constant_family_changes_nothing(spark, sf):
    rows = evaluation.split_rows(spark, sf).withColumn("f3", F.lit(1.0))
    train = rows.filter("train")
    out = I.importance(rows.filter("not train"), {"constant": ["f3"]}, lambda v: M.naive_bayes(train.unionByName(v), ["f1", "f2"]).filter("not train"), "segment_id")
    assert all(abs(r["decrease_ap"]) < 1e-12 for r in out.collect())


@pytest.mark.parametrize("name", ["Logistic Regression", "SVM", "Decision Tree", "Random Forest", "Gradient Boosting", "MLP", "boosted-deep"])
def test_presets_exist(spark, name):
    assert M.presets(3, 100, trees=5)[name] is not None


def test_single_class_scores_zero(spark):
    rows = spark.createDataFrame([(0, 0, "a", 1, 0.5, True), (0, 0, "b", 1, 0.7, False)], "repeat int, fold int, record string, label int, f1 double, train boolean")
    assert {r["score"] for r in M.naive_bayes(rows, ["f1"]).collect()} == {0.0}
    assert {r["score"] for r in M.fitted(rows, ["f1"], "Decision Tree").collect()} == {0.0}
    assert {r["score"] for r in M.quadratic_discriminant(rows, ["f1"]).collect()} == {0.0}


def test_svm_scores_are_probabilities(spark):
    rng = np.random.default_rng(0)
    data = [(0, 0, f"r{k}", k % 2, float(rng.normal() + k % 2), k < 40) for k in range(60)]
    rows = spark.createDataFrame(data, "repeat int, fold int, record string, label int, f1 double, train boolean")
    s = [r["score"] for r in M.fitted(rows, ["f1"], "SVM").collect()]
    assert len(s) == 60 and all(0 <= x <= 1 for x in s)


def test_runs_and_sinks(spark, tmp_path):
    models = spark.createDataFrame([("a",), ("b",)], "model string")
    with pytest.raises(ValueError):
        J.tasks(models, 31)
    with pytest.raises(ValueError):
        J.selected(models, ["c"], "model")
    assert J.selected(models, ["a"], "model").count() == 1
    path = str(tmp_path / "results")
    rows = spark.createDataFrame([("e", "a", 0, 1.0), ("e", "b", 0, 2.0)], "experiment string, model string, repeat int, score double")
    J.write_results(rows, path)
    J.write_results(rows.filter("model = 'a'").withColumn("score", F.lit(9.0)), path)
    assert sorted(r["score"] for r in spark.read.parquet(path).collect()) == [2.0, 9.0]
    one = J.table_digest(rows).first()[0]
    assert one == J.table_digest(rows.orderBy(F.desc("model"))).first()[0] != J.table_digest(rows.limit(1)).first()[0]
    sinks.write_csv(rows, str(tmp_path / "csv"), 4)
    assert sorted(r["score"] for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()) == ["1.0000", "2.0000"]
    sinks.write_features(rows.withColumns({"mode": F.lit("m"), "feature_source": F.lit("imf1")}), str(tmp_path / "features"))
    assert tables.feature_table(spark, str(tmp_path / "features")).filter("mode = 'm'").count() == 2
    with pytest.raises(FileNotFoundError):
        sinks.publication({"a": None})
    s = rows.select("model", F.col("score").alias("record_mcc_mean"), F.lit(1).alias("other"))
    assert sinks.publication({"x": s, "y": s}).columns == ["experiment", "model", "record_mcc_mean"]


def test_picks_and_checked_tables(spark, tmp_path):
    rec = spark.createDataFrame([("t_2", 0), ("p_9", 1), ("p_3", 1)], "record string, label int")
    assert tables.pick_record(rec).first()["record"] == "p_3" and tables.pick_record(rec.filter("label = 0")).first()["record"] == "t_2"
    assert tables.pick_record(rec, "p_9").count() == 1
    seg = spark.createDataFrame([("ch1", 0, 1.0)], "channel string, segment_id int, x double")
    assert tables.pick_segment(seg, "ch1", 0).count() == 1
    for bad in (lambda: tables.pick_record(rec, "x"), lambda: tables.pick_segment(seg, "ch1", 4), lambda: tables.pick_segment(seg, "ch9", 0)):
        with pytest.raises(ValueError):
            bad()
    spark.createDataFrame([("Naive Bayes", 0.5)], "model string, record_mcc_mean double").write.parquet(str(tmp_path / "s"))
    assert tables.summary_table(spark, str(tmp_path / "s")).first()["model"] == "NB"
    with pytest.raises(ValueError):
        tables.prediction_table(spark, str(tmp_path / "s"))
    checked = {r["check"]: r["ok"] for r in A.problems(rec, 4).collect()}
    assert checked == {"row_count": False, "one_label_per_record": True, "labels_known": True}


def test_failed_check_raises(spark):
    ok = R.checks({"same": (spark.sql("select 1L"), spark.sql("select 1L"))})
    assert R.required(ok).first()["ok"]
    with pytest.raises(PySparkException):
        R.required(R.checks({"off": (spark.sql("select 1L"), spark.sql("select 2L"))})).collect()


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = tables.price_samples(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "ReadSchema: struct<l_orderkey" in plan


def test_widths_of_many_peaks_equal_plain_scans():
    rng = np.random.default_rng(6)
    for n, rel in [(3, 0.5), (17, 0.5), (60, 0.5), (60, 1.5)] * 20:
        v = np.round(rng.normal(size=n), 1)
        p = rng.choice(n, min(n, 8), replace=False)
        prominence, width = X._measures(v, p, v[p], rel)
        for k, at in enumerate(p):
            h = v[at]
            left = max((j for j in range(at) if v[j] > h), default=-1)
            right = min((j for j in range(at + 1, n) if v[j] > h), default=n)
            low = max(v[left + 1 : at + 1].min(), v[at:right].min())
            level, ends = h - (h - low) * rel, []
            for side, places in ((-1, range(at - 1, -1, -1)), (1, range(at + 1, n))):
                j = next((j for j in places if v[j] <= level), None)
                ends.append(np.nan if j is None else j - side * ((level - v[j]) / (v[j - side] - v[j]) if v[j] < level else 0.0))
            assert prominence[k] == h - low and np.array_equal(width[k], ends[1] - ends[0], equal_nan=True)


def test_widths_of_a_long_segment_take_seconds():
    v = np.random.default_rng(7).normal(size=100_000)
    p = np.sort(np.random.default_rng(8).choice(100_000, 10_000, replace=False))
    began = time.perf_counter()
    X._measures(v, p, v[p], 0.5)
    assert time.perf_counter() - began < 5
