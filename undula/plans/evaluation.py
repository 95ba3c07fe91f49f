"""Queries on folds, models, metrics, importance, description and runs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.functions import columns as C
from undula.operators import assemble as A
from undula.operators import describe as D
from undula.operators import evaluate as E
from undula.operators import grouped as L
from undula.operators import importance as I
from undula.operators import models as M
from undula.operators import runs as J
from undula.operators import segments as G
from undula.operators import splits as P
from undula.operators import trees as T
from undula.sources import tables as S
from undula.sources.sinks import kept, work_folder

QUERIES, SQL = {}, {}
BY = ["model", "repeat"]
FEATURES = ["f1", "f2", "f3"]
REPEATS = 30

ML = """ml AS (SELECT vec_id AS segment_id, (CASE WHEN label % 2 = 1 THEN 'p' ELSE 't' END) || '_' || (vec_id % 13) AS record, CAST(label % 2 AS INTEGER) AS label,
 embedding[1]::DOUBLE AS f1, embedding[2]::DOUBLE AS f2, embedding[3]::DOUBLE AS f3 FROM embeddings)"""
SC = """sc AS (SELECT ['RF','NB','LR'][vec_id % 3 + 1] AS model, CAST((vec_id // 3) % 2 AS INTEGER) AS repeat, CAST(vec_id % 13 % 5 AS INTEGER) AS fold,
 (CASE WHEN label % 2 = 1 THEN 'p' ELSE 't' END) || '_' || (vec_id % 13) AS record, CAST(label % 2 AS INTEGER) AS label, floor(embedding[1]::DOUBLE * 20 + label % 2) / 20 AS score FROM embeddings)"""
RS = SC + ", rs AS (SELECT model, repeat, fold, record, min(label) AS label, max(score) AS score FROM sc GROUP BY model, repeat, fold, record)"


def cumulative_sql(by: str) -> str:
    return f""", g AS (SELECT {by}, score, count(*) FILTER (label = 1) AS ph, count(*) FILTER (label = 0) AS nh FROM rs GROUP BY ALL),
 cu AS (SELECT *, sum(ph) OVER d AS tp, sum(nh) OVER d AS fp, sum(ph) OVER v AS pos, sum(nh) OVER v AS neg FROM g WINDOW d AS (PARTITION BY {by} ORDER BY score DESC), v AS (PARTITION BY {by}))"""


CU = RS + cumulative_sql("model, repeat")
TH = CU + """, mc AS (SELECT *, coalesce((tp * (neg - fp) - fp * (pos - tp))::DOUBLE / nullif(sqrt((tp + fp)::DOUBLE * pos * neg * (neg - fp + pos - tp)), 0), 0) AS m FROM cu),
 th AS (SELECT model, repeat, score AS threshold FROM mc QUALIFY row_number() OVER (PARTITION BY model, repeat ORDER BY round(m, 12) DESC, score) = 1),
 pr AS (SELECT rs.*, threshold, CAST(score >= threshold AS INTEGER) AS prediction FROM rs JOIN th USING (model, repeat))"""
FOLDS = ML + """, rec AS (SELECT DISTINCT record, label FROM ml), rp AS (SELECT CAST(range AS INTEGER) AS repeat FROM range(30)),
 rk AS (SELECT repeat, record, label, row_number() OVER (PARTITION BY repeat, label ORDER BY md5(record || ':' || CAST(42 + repeat AS VARCHAR)), record) - 1 AS rank FROM rec, rp),
 fo AS (SELECT repeat, record, label, CAST((CASE WHEN label = 1 THEN (SELECT count(*) FROM rec WHERE label = 0) ELSE 0 END + rank) % 5 AS INTEGER) AS fold FROM rk)"""
EX = FOLDS + ", ex AS (SELECT ml.*, fo.repeat, f.fold, f.fold <> fo.fold AS train FROM ml JOIN fo ON fo.record = ml.record, (SELECT CAST(range AS INTEGER) AS fold FROM range(5)) f)"
_MV = ", ".join(f"avg({f}) AS m_{f}, var_pop({f}) AS v_{f}" for f in FEATURES)
_LD = lambda s: f"ln({s}.n / (a.n + b.n)) - 0.5 * (" + " + ".join(f"ln(2 * pi() * ({s}.v_{f} + 1e-9 * top + 1e-300)) + ({f} - {s}.m_{f}) * ({f} - {s}.m_{f}) / ({s}.v_{f} + 1e-9 * top + 1e-300)" for f in FEATURES) + ")"
NB = EX + f""", st AS (SELECT repeat, fold, label, count(*)::DOUBLE AS n, {_MV} FROM ex WHERE train GROUP BY repeat, fold, label),
 tv AS (SELECT repeat, fold, greatest({", ".join(f"var_pop({f})" for f in FEATURES)}) AS top FROM ex WHERE train GROUP BY repeat, fold),
 nb AS (SELECT ex.*, 1 / (1 + exp(least(({_LD("a")}) - ({_LD("b")}), 700))) AS score FROM ex JOIN tv USING (repeat, fold)
  JOIN st a ON a.repeat = ex.repeat AND a.fold = ex.fold AND a.label = 0 JOIN st b ON b.repeat = ex.repeat AND b.fold = ex.fold AND b.label = 1)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame) -> DataFrame:
    return df.select([F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def scores(spark, d) -> DataFrame:
    """Record scores with their fold."""
    return E.record_scores(S.segment_scores(spark, d), [*BY, "fold"])


def predictions(spark, d) -> DataFrame:
    s = scores(spark, d)
    return E.applied(s, E.thresholds(s, BY), BY)


def split_rows(spark, d, repeats: int = REPEATS) -> DataFrame:
    ml = S.ml_features(spark, d, 3)
    return P.expanded(ml, P.folds(P.record_labels(ml), repeats))


@query(f"WITH {FOLDS} SELECT * FROM fo")
def cv_record_folds(spark, d):
    return P.folds(P.record_labels(S.ml_features(spark, d, 3)), REPEATS)


@query(f"WITH {FOLDS} SELECT repeat, fold, string_agg(record, ',' ORDER BY record) AS validation_records, count(*) AS n_validation, count(*) FILTER (label = 1) AS n_validation_preterm, 26 - count(*) AS n_train FROM fo GROUP BY repeat, fold")
def cv_split_report(spark, d):
    return P.split_report(cv_record_folds(spark, d))


@query(f"WITH {EX} SELECT DISTINCT repeat, fold, record FROM ex e WHERE train AND EXISTS (SELECT 1 FROM ex v WHERE v.repeat = e.repeat AND v.fold = e.fold AND v.record = e.record AND NOT v.train)")
def cv_leaks(spark, d):
    e = split_rows(spark, d)
    return G.leaks(e.filter("train"), e.filter("not train"), ["repeat", "fold", "record"])


@query(f"WITH {ML} SELECT CAST(t.fold AS BIGINT) AS fold, t.record FROM (SELECT DISTINCT f.range AS fold, record FROM ml, range(5) f WHERE segment_id % 5 <> f.range) t JOIN (SELECT DISTINCT segment_id % 5 AS fold, record FROM ml) v USING (fold, record)")
def cv_segment_leaks(spark, d):
    """Records on both sides when segments, not records, are dealt out to folds."""
    ml = S.ml_features(spark, d, 3).select("record", (F.col("segment_id") % 5).alias("own"))
    rows = ml.select("record", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("fold"))
    return G.leaks(rows.filter("own <> fold"), rows.filter("own = fold"), ["fold", "record"])


@query("SELECT record, CASE WHEN n = 0 THEN 'missing' ELSE 'repeated' END AS problem FROM (SELECT CAST(o.c AS VARCHAR) AS record, coalesce(n, 0) AS n FROM (SELECT c_custkey AS c FROM customer) o LEFT JOIN (SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1) k USING (c)) WHERE n = 0 OR n > 1")
def cv_coverage(spark, d):
    want = S.read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("record"))
    return G.coverage(want, S.read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("record")))


@query(f"WITH {EX}, h AS (SELECT segment_id, repeat, fold, train, CASE WHEN f1 > 0.1 THEN NULL ELSE f1 END AS f1 FROM ex), m AS (SELECT repeat, fold, avg(f1) AS m FROM h WHERE train GROUP BY ALL) SELECT segment_id, repeat, fold, round(coalesce(f1, m), 6) AS f1 FROM h JOIN m USING (repeat, fold) WHERE NOT train")
def cv_imputed(spark, d):
    rows = split_rows(spark, d).withColumn("f1", F.when(~(F.col("f1") > 0.1), F.col("f1")))
    return r6(P.imputed(rows, ["f1"]).filter("not train").select("segment_id", "repeat", "fold", "f1"))


@query(f"WITH {EX}, m AS (SELECT repeat, fold, avg(f1) AS m, stddev_pop(f1) AS s FROM ex WHERE train GROUP BY ALL) SELECT segment_id, repeat, fold, round((f1 - m) / s, 6) AS f1 FROM ex JOIN m USING (repeat, fold) WHERE NOT train")
def cv_standardised(spark, d):
    return r6(P.standardised(split_rows(spark, d), ["f1"]).filter("not train").select("segment_id", "repeat", "fold", "f1"))


@query(f"WITH {EX}, c AS (SELECT repeat, fold, label, count(*) AS n FROM ex WHERE train GROUP BY ALL) SELECT repeat, fold, label, round(sum(n) OVER (PARTITION BY repeat, fold) / (2.0 * n), 6) AS weight FROM c")
def cv_class_weights(spark, d):
    return r6(P.class_weights(split_rows(spark, d)))


@query(f"WITH {NB} SELECT repeat, fold, record, label, round(max(score), 6) AS score FROM nb WHERE NOT train GROUP BY repeat, fold, record, label")
def cv_gnb_oof(spark, d):
    s = M.naive_bayes(split_rows(spark, d), FEATURES)
    return r6(E.record_scores(s.filter("not train"), ["repeat", "fold"])).select("repeat", "fold", "record", "label", "score")


def oof_predictions(scored: DataFrame) -> DataFrame:
    """Validation records with thresholds that the fold's own training records chose."""
    by = ["repeat", "fold"]
    train = E.record_scores(scored.filter("train"), by)
    return E.applied(E.record_scores(scored.filter("not train"), by), E.thresholds(train, by), by)


@query(f"""WITH {NB}, tr AS (SELECT repeat, fold, record, min(label) AS label, max(score) AS score FROM nb WHERE train GROUP BY 1, 2, 3), va AS (SELECT repeat, fold, record, min(label) AS label, max(score) AS score FROM nb WHERE NOT train GROUP BY 1, 2, 3),
 g AS (SELECT repeat, fold, score, count(*) FILTER (label = 1) AS ph, count(*) FILTER (label = 0) AS nh FROM tr GROUP BY ALL),
 cu AS (SELECT *, sum(ph) OVER d AS tp, sum(nh) OVER d AS fp, sum(ph) OVER v AS pos, sum(nh) OVER v AS neg FROM g WINDOW d AS (PARTITION BY repeat, fold ORDER BY score DESC), v AS (PARTITION BY repeat, fold)),
 mc AS (SELECT *, coalesce((tp * (neg - fp) - fp * (pos - tp))::DOUBLE / nullif(sqrt((tp + fp)::DOUBLE * pos * neg * (neg - fp + pos - tp)), 0), 0) AS m FROM cu),
 th AS (SELECT repeat, fold, score AS threshold FROM mc QUALIFY row_number() OVER (PARTITION BY repeat, fold ORDER BY round(m, 12) DESC, score) = 1),
 p AS (SELECT repeat, label, CAST(score >= threshold AS INTEGER) AS prediction FROM va JOIN th USING (repeat, fold))
 SELECT repeat, count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 0 AND prediction = 0) AS tn FROM p GROUP BY repeat""")
def cv_gnb_repeat_confusion(spark, d):
    p = oof_predictions(M.naive_bayes(split_rows(spark, d), FEATURES))
    return E.binary_metrics(p, ["repeat"]).select("repeat", "tp", "fp", "fn", "tn")


@query(f"WITH {SC} SELECT model, repeat, record, round(max(score), 6) AS max, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.75), 6) AS q75 FROM sc GROUP BY model, repeat, record")
def eval_record_scores(spark, d):
    s = S.segment_scores(spark, d)
    out = None
    for how in ("max", "mean", "q75"):
        part = E.record_scores(s, BY, how).select(*BY, "record", F.round("score", 6).alias(how))
        out = part if out is None else out.join(part, [*BY, "record"])
    return out


@query(f"WITH {TH} SELECT model, repeat, threshold FROM th")
def eval_threshold_mcc(spark, d):
    return E.thresholds(scores(spark, d), BY)


@query(f"WITH {TH} SELECT model, repeat, fold, record, label, score, threshold, prediction FROM pr")
def eval_applied(spark, d):
    return predictions(spark, d).select("model", "repeat", "fold", "record", "label", "score", "threshold", "prediction")


METRICS_SQL = TH + """, c AS (SELECT model, repeat, count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 0 AND prediction = 0) AS tn FROM pr GROUP BY ALL),
 bm AS (SELECT model, repeat, tp, fp, fn, tn, (tp + tn) / (tp + tn + fp + fn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, tn / nullif(tn + fp, 0) AS specificity, tp / nullif(tp + fn, 0) AS sensitivity,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 AS balanced_accuracy,
  coalesce((tp * tn - fp * fn)::DOUBLE / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc FROM c),
 au AS (SELECT model, repeat, sum(nh * (tp - ph / 2.0::DOUBLE)) / nullif(max(pos) * max(neg), 0) AS roc_auc, sum(ph / nullif(pos, 0) * (tp / (tp + fp))) AS average_precision FROM cu GROUP BY ALL),
 me AS (SELECT * FROM bm JOIN au USING (model, repeat))"""
_COLS = ["accuracy", "precision", "recall", "specificity", "sensitivity", "f1", "balanced_accuracy", "mcc", "roc_auc", "average_precision"]


@query(f"WITH {METRICS_SQL} SELECT model, repeat, tp, fp, fn, tn, {', '.join(f'round({c}, 6) AS {c}' for c in _COLS)}, (SELECT count(*) FROM rs WHERE rs.model = me.model AND rs.repeat = me.repeat) AS n_records FROM me")
def eval_metrics_repeat(spark, d):
    return r6(E.repeat_metrics(predictions(spark, d), BY))


@query(f"WITH {METRICS_SQL} SELECT model, {', '.join(f'round(avg({c}), 4) AS record_{c}_mean' for c in _COLS)} FROM me GROUP BY model")
def eval_summary(spark, d):
    s = E.summary(E.repeat_metrics(predictions(spark, d), BY), ["model"])
    return s.select("model", *[F.round(c, 4).alias(c) for c in s.columns[1:]])


@query(f"WITH {METRICS_SQL}, s AS (SELECT model, avg(balanced_accuracy) AS b FROM me GROUP BY model) SELECT model, round(b, 6) AS record_balanced_accuracy_mean FROM s ORDER BY round(b, 12) DESC, model LIMIT 1")
def eval_best_model(spark, d):
    s = E.summary(E.repeat_metrics(predictions(spark, d), BY), ["model"], ["balanced_accuracy"])
    return r6(E.best_model(s, []))


@query(f"WITH {CU} SELECT model, repeat, round(sum(nh * (tp - ph / 2.0::DOUBLE)) / nullif(max(pos) * max(neg), 0), 6) AS roc_auc FROM cu GROUP BY ALL")
def eval_roc_auc(spark, d):
    return r6(E.roc_auc(scores(spark, d), BY))


@query(f"WITH {CU} SELECT model, repeat, round(sum(ph / nullif(pos, 0) * (tp / (tp + fp))), 6) AS average_precision FROM cu GROUP BY ALL")
def eval_average_precision(spark, d):
    return r6(E.average_precision(scores(spark, d), BY))


@query(f"WITH {RS}{cumulative_sql('model')} SELECT a.model, n_rows, roc_auc, average_precision FROM (SELECT model, round(sum(nh * (tp - ph / 2.0::DOUBLE)) / nullif(max(pos) * max(neg), 0), 6) AS roc_auc, round(sum(ph / nullif(pos, 0) * (tp / (tp + fp))), 6) AS average_precision FROM cu GROUP BY model) a JOIN (SELECT model, count(*) AS n_rows FROM rs GROUP BY model) b USING (model)")
def eval_pooled(spark, d):
    s, by = scores(spark, d), ["model"]
    return r6(E.roc_auc(s, by).join(E.average_precision(s, by), by).join(s.groupBy(by).agg(F.count("*").alias("n_rows")), by))


@query(f"""WITH {RS}{cumulative_sql('model')}, p AS (SELECT model, 'roc' AS curve, score AS threshold, fp / neg AS x, tp / pos AS y FROM cu UNION ALL SELECT model, 'pr', score, tp / pos, tp / (tp + fp) FROM cu
 UNION ALL SELECT DISTINCT model, 'roc', CAST(NULL AS DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE FROM cu UNION ALL SELECT DISTINCT model, 'pr', CAST(NULL AS DOUBLE), 0.0::DOUBLE, 1.0::DOUBLE FROM cu) SELECT model, curve, threshold, round(x, 6) AS x, round(y, 6) AS y FROM p""")
def eval_roc_pr_points(spark, d):
    return r6(E.curves(scores(spark, d), ["model"]))


@query(f"""WITH {TH}, cl AS (SELECT CAST(range // 2 AS INTEGER) AS label, CAST(range % 2 AS INTEGER) AS prediction FROM range(4)), k AS (SELECT model, label, prediction, count(*) AS n FROM pr GROUP BY ALL),
 f AS (SELECT m.model, cl.label, cl.prediction, coalesce(n, 0) AS n FROM (SELECT DISTINCT model FROM pr) m CROSS JOIN cl LEFT JOIN k ON k.model = m.model AND k.label = cl.label AND k.prediction = cl.prediction)
 SELECT model, label, prediction, n, round(n / greatest(sum(n) OVER (PARTITION BY model, label), 1), 6) AS share FROM f""")
def eval_confusion(spark, d):
    return r6(E.confusion(predictions(spark, d), ["model"]))


VOTES = "sc AS (SELECT (CASE WHEN label % 2 = 1 THEN 'p' ELSE 't' END) || '_' || (vec_id % 13) AS record, CAST(label % 2 AS INTEGER) AS label, CAST((vec_id // 13) % 3 AS INTEGER) AS repeat, max(floor(embedding[1]::DOUBLE * 20 + label % 2) / 20) AS score FROM embeddings GROUP BY ALL)"


@query(f"WITH {VOTES} SELECT record, label, CAST(count(*) FILTER (score >= 0.6) * 2 > count(*) AS INTEGER) AS consensus, round(count(*) FILTER (score >= 0.6) / count(*), 6) AS vote_fraction, round(avg(score), 6) AS mean_score, count(*) AS n_votes FROM sc GROUP BY record, label")
def eval_consensus(spark, d):
    ids = S.read(spark, d, "embeddings").select("vec_id", (F.col("label") % 2).cast("int").alias("label"), F.col("embedding")[0].cast("double").alias("e"))
    rows = ids.select(F.concat_ws("_", F.when(F.col("label") == 1, "p").otherwise("t"), (F.col("vec_id") % 13).cast("string")).alias("record"), "label", (F.floor(F.col("vec_id") / 13) % 3).cast("int").alias("repeat"), (F.floor(F.col("e") * 20 + F.col("label")) / 20).alias("score"))
    voted = E.record_scores(rows, ["repeat"]).withColumn("prediction", (F.col("score") >= 0.6).cast("int"))
    return r6(E.consensus(voted, [], 3))


@query(f"""WITH {TH}, f AS (SELECT model, repeat, fold, max(threshold) AS threshold, count(*) AS n_val_records, count(*) FILTER (label = prediction) / count(*) AS accuracy FROM pr GROUP BY model, repeat, fold)
 SELECT model, repeat, fold, threshold, n_val_records, round(accuracy, 6) AS accuracy FROM f""")
def eval_fold_metrics(spark, d):
    p, by = predictions(spark, d), [*BY, "fold"]
    sizes = p.groupBy(by).agg(F.max("threshold").alias("threshold"), F.count_distinct("record").alias("n_val_records"))
    return r6(E.binary_metrics(p, by).join(sizes, by).select(*by, "threshold", "n_val_records", "accuracy"))


@query(f"WITH {METRICS_SQL}, s AS (SELECT model, avg(mcc) AS m FROM me GROUP BY model) SELECT model, CASE model WHEN 'LR' THEN 1 WHEN 'RF' THEN 4 WHEN 'NB' THEN 6 END AS rank, round(m, 4) AS record_mcc_mean FROM s ORDER BY rank")
def eval_ordered_summary(spark, d):
    s = E.summary(E.repeat_metrics(predictions(spark, d), BY), ["model"], ["mcc"])
    return A.normalised_models(s).select("model", "rank", F.round("record_mcc_mean", 4).alias("record_mcc_mean")).orderBy("rank")


@query(f"""WITH {ML}, n AS (SELECT *, segment_id % 5 AS fold FROM ml), a AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY segment_id) AS k FROM n),
 b AS (SELECT fold, f1, f2, row_number() OVER (PARTITION BY fold ORDER BY md5('0:pair:' || fold || ':' || segment_id), segment_id) AS k FROM n)
 SELECT a.segment_id, a.fold, b.f1, b.f2, a.f3 FROM a JOIN b USING (fold, k)""")
def imp_joint_permutation(spark, d):
    rows = S.ml_features(spark, d, 3).withColumn("fold", F.col("segment_id") % 5)
    return I.permuted(rows, ["f1", "f2"], ["fold"], "segment_id", "0:pair").select("segment_id", "fold", "f1", "f2", "f3")


@query(f"WITH {ML}, p AS (SELECT record, count(DISTINCT label) AS n FROM ml GROUP BY record) SELECT 'row_count' AS \"check\", true AS ok UNION ALL SELECT 'one_label_per_record', max(n) <= 1 FROM p UNION ALL SELECT 'labels_known', count(*) FILTER (label NOT IN (0, 1)) = 0 FROM ml")
def asm_checks(spark, d):
    return A.problems(S.ml_features(spark, d, 3))


@query(f"WITH {ML} SELECT segment_id, record, 'ch1_LOG' AS feature, f1 AS value, 'Temporal energy features' AS family FROM ml UNION ALL SELECT segment_id, record, 'ch1_SE', f2, 'Entropy features' FROM ml UNION ALL SELECT segment_id, record, 'ch2_PEAK_RATE', f3, 'Burst and peak features' FROM ml")
def asm_tall_families(spark, d):
    wide = S.ml_features(spark, d, 3).select("segment_id", "record", F.col("f1").alias("ch1_LOG"), F.col("f2").alias("ch1_SE"), F.col("f3").alias("ch2_PEAK_RATE"))
    names = [c for c in A.feature_columns(wide) if c != "segment_id"]
    family = F.create_map(*[F.lit(x) for g, cols in A.families(names).items() for c in cols for x in (c, g)])
    return A.tall(wide, ["segment_id", "record"], names).withColumn("family", family[F.col("feature")])


IMP = NB + f""", va AS (SELECT *, row_number() OVER (PARTITION BY repeat, fold ORDER BY segment_id) AS k FROM ex WHERE NOT train),
 dr AS (SELECT va.*, g, row_number() OVER (PARTITION BY g, repeat, fold ORDER BY md5('0:' || g || ':' || repeat || ':' || fold || ':' || segment_id), segment_id) AS dk FROM va, (SELECT unnest(['first', 'rest']) AS g)),
 mv AS (SELECT va.segment_id, va.record, va.label, va.repeat, va.fold, va.train, o.g, CASE WHEN o.g = 'first' THEN o.f1 ELSE va.f1 END AS f1, CASE WHEN o.g = 'rest' THEN o.f2 ELSE va.f2 END AS f2, CASE WHEN o.g = 'rest' THEN o.f3 ELSE va.f3 END AS f3
  FROM va JOIN dr o ON o.repeat = va.repeat AND o.fold = va.fold AND o.dk = va.k
  UNION ALL SELECT segment_id, record, label, repeat, fold, train, 'base', f1, f2, f3 FROM va),
 ms AS (SELECT mv.*, 1 / (1 + exp(least(({_LD("a")}) - ({_LD("b")}), 700))) AS score FROM mv JOIN tv USING (repeat, fold)
  JOIN st a ON a.repeat = mv.repeat AND a.fold = mv.fold AND a.label = 0 JOIN st b ON b.repeat = mv.repeat AND b.fold = mv.fold AND b.label = 1),
 mr AS (SELECT g, repeat, record, min(label) AS label, max(score) AS score FROM ms GROUP BY g, repeat, record),
 mg AS (SELECT g, repeat, score, count(*) FILTER (label = 1) AS ph, count(*) FILTER (label = 0) AS nh FROM mr GROUP BY ALL),
 mu AS (SELECT *, sum(ph) OVER d AS tp, sum(nh) OVER d AS fp, sum(ph) OVER v AS pos FROM mg WINDOW d AS (PARTITION BY g, repeat ORDER BY score DESC), v AS (PARTITION BY g, repeat)),
 ma AS (SELECT g, repeat, sum(ph / pos * (tp / (tp + fp))) AS ap FROM mu GROUP BY g, repeat),
 im AS (SELECT x.repeat, CAST(0 AS INTEGER) AS permutation, x.g AS feature_group, CAST(CASE x.g WHEN 'first' THEN 1 ELSE 2 END AS INTEGER) AS n_features, b.ap AS baseline_ap, x.ap AS permuted_ap, b.ap - x.ap AS decrease_ap FROM ma x JOIN ma b ON b.repeat = x.repeat AND b.g = 'base' WHERE x.g <> 'base')"""
_GROUPS = {"first": ["f1"], "rest": ["f2", "f3"]}


@query(f"WITH {IMP} SELECT repeat, permutation, feature_group, n_features, round(baseline_ap, 6) AS baseline_ap, round(permuted_ap, 6) AS permuted_ap, round(decrease_ap, 6) AS decrease_ap FROM im")
def imp_grouped_nb(spark, d):
    """Grouped permutation importance with naive Bayes as the model; its parameters are fitted on training rows only."""
    return r6(grouped_nb(spark, d))


def grouped_nb(spark, d) -> DataFrame:
    rows = split_rows(spark, d)
    train = rows.filter("train")

    def score(validation: DataFrame) -> DataFrame:
        return M.naive_bayes(train.unionByName(validation, allowMissingColumns=True).select(validation.columns), FEATURES).filter("not train")

    return I.importance(rows.filter("not train"), _GROUPS, score, "segment_id")


@query(f"WITH {IMP} SELECT feature_group, round(avg(decrease_ap), 6) AS mean_decrease_ap, count(DISTINCT repeat) AS n_repeats, count(DISTINCT permutation) AS n_permutations, count(*) AS n, CAST(max(n_features) AS INTEGER) AS n_features FROM im GROUP BY feature_group")
def imp_summary(spark, d):
    return r6(I.importance_summary(grouped_nb(spark, d)))


@query()
def imp_grouped_forest(spark, d):
    """Grouped permutation importance with the forest, at the preset's size: every fold's forest is grown once and scores all permutations."""
    data = T.binned(grouped_folds(spark, d, FEATURES, FOREST_REPEATS))
    validation = split_rows(spark, d, FOREST_REPEATS).filter("not train")
    moved = I.all_permuted(validation, _GROUPS, ["repeat", "fold"], "segment_id", 1).unionByName(validation.withColumns({"permutation": F.lit(-1), "feature_group": F.lit("base")}))
    rows = moved.select("repeat", "fold", "permutation", "feature_group", "record", "label", F.array(*FEATURES).cast("array<double>").alias("x"))
    scored = kept(T.forest_scores(data, rows))
    by = ["repeat", "permutation", "feature_group"]
    ap = E.average_precision(E.record_scores(scored, by), by)
    base = ap.filter("permutation < 0").select("repeat", F.col("average_precision").alias("baseline_ap"))
    out = ap.filter("permutation >= 0").withColumnRenamed("average_precision", "permuted_ap").join(base, "repeat")
    return r6(out.withColumn("decrease_ap", F.col("baseline_ap") - F.col("permuted_ap")))


LONG = ML + ", ln AS (SELECT record, label, segment_id, 'ch1' AS channel, 'A' AS feature, f1 AS value FROM ml UNION ALL SELECT record, label, segment_id, 'ch2', 'A', CASE WHEN f2 > 0.1 THEN NULL ELSE f2 END FROM ml UNION ALL SELECT record, label, segment_id, 'ch1', 'B', f3 FROM ml), sg AS (SELECT record, label, segment_id, feature, avg(value) AS value FROM ln GROUP BY ALL), rm AS (SELECT record, label, feature, avg(value) AS value FROM sg GROUP BY ALL)"


def long_values(spark, d) -> DataFrame:
    ml = S.ml_features(spark, d, 3)
    row = lambda c, f, v: F.struct(F.lit(c).alias("channel"), F.lit(f).alias("feature"), v.alias("value"))
    return ml.select("record", "label", "segment_id", F.inline(F.array(row("ch1", "A", F.col("f1")), row("ch2", "A", F.when(~(F.col("f2") > 0.1), F.col("f2"))), row("ch1", "B", F.col("f3")))))


@query(f"WITH {LONG} SELECT record, label, feature, round(value, 6) AS value FROM rm")
def desc_record_means(spark, d):
    return r6(D.record_means(long_values(spark, d)))


EFFECT = LONG + """, g AS (SELECT feature, count(value) FILTER (label = 1) AS n1, count(value) FILTER (label = 0) AS n0, avg(value) FILTER (label = 1) AS m1, avg(value) FILTER (label = 0) AS m0, var_samp(value) FILTER (label = 1) AS v1, var_samp(value) FILTER (label = 0) AS v0 FROM rm GROUP BY feature),
 ef AS (SELECT feature, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) AS cohen_d, round(m1, 6) AS preterm_mean, round(m0, 6) AS term_mean FROM g)"""


@query(f"WITH {EFFECT} SELECT * FROM ef")
def desc_cohens_d(spark, d):
    return r6(D.effects(D.record_means(long_values(spark, d))))


@query(f"WITH {EFFECT} SELECT ef.*, CASE feature WHEN 'A' THEN 2 ELSE 1 END AS n_channels, CASE feature WHEN 'A' THEN 'ch1,ch2' ELSE 'ch1' END AS channels FROM ef")
def desc_effect_table(spark, d):
    return r6(D.effect_table(long_values(spark, d)))


@query(f"WITH {LONG} SELECT feature, label, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75 FROM rm GROUP BY feature, label")
def desc_quartiles(spark, d):
    return r6(D.quartiles(D.record_means(long_values(spark, d))))


@query("SELECT o_orderpriority AS model, CAST(r AS INTEGER) AS repeat FROM (SELECT DISTINCT o_orderpriority FROM orders), range(3) t(r) EXCEPT SELECT o_orderpriority, CAST(o_orderkey % 3 AS INTEGER) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 499000")
def run_pending_tasks(spark, d):
    o = S.read(spark, d, "orders")
    models = o.select(F.col("o_orderpriority").alias("model")).distinct()
    want = J.tasks(models, 3).withColumn("fingerprint", J.fingerprint(F.col("model"), F.lit("v1")))
    done = o.filter((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 499000)).select(F.col("o_orderpriority").alias("model"), (F.col("o_orderkey") % 3).cast("int").alias("repeat"), F.lit("completed").alias("status")).withColumn("fingerprint", J.fingerprint(F.col("model"), F.lit("v1")))
    return J.pending(want, done).select("model", "repeat")


@query("SELECT c_mktsegment AS model, sha256(c_mktsegment || '|' || CAST(count(*) AS VARCHAR) || '|folds=5') AS fingerprint FROM customer GROUP BY c_mktsegment")
def run_fingerprints(spark, d):
    g = S.read(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("model")).agg(F.count("*").alias("n"))
    return g.select("model", J.fingerprint(F.col("model"), F.col("n").cast("string"), F.lit("folds=5")).alias("fingerprint"))


@query(f"WITH {RS} SELECT model, repeat, count(DISTINCT fold) = 5 AND count(DISTINCT record) = 26 AND count(*) = 26 AS valid FROM rs GROUP BY model, repeat")
def run_validity(spark, d):
    return J.validity(scores(spark, d).withColumn("fingerprint", F.lit("v1")), 5, 26, "v1")


@query("WITH r AS (SELECT 'rec_' || CASE c_mktsegment WHEN 'BUILDING' THEN 'P' WHEN 'MACHINERY' THEN 'x' ELSE 't' END || c_custkey AS record FROM customer) SELECT record, CASE WHEN record LIKE 'rec_P%' THEN 1 WHEN record LIKE 'rec_t%' THEN 0 ELSE -1 END AS label FROM r UNION ALL SELECT 'solo', -1")
def fn_parse_label(spark, d):
    c = S.read(spark, d, "customer")
    prefix = F.when(F.col("c_mktsegment") == "BUILDING", "P").when(F.col("c_mktsegment") == "MACHINERY", "x").otherwise("t")
    names = c.select(F.concat(F.lit("rec_"), prefix, F.col("c_custkey").cast("string")).alias("record"))
    return names.union(spark.sql("select 'solo'")).select("record", C.parse_label().alias("label"))


@query("SELECT c_custkey, round_even(c_acctbal / 7, 4) AS v FROM customer")
def fn_rounded(spark, d):
    return C.rounded(S.read(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 7).alias("v")))


@query("SELECT CAST(vec_id AS VARCHAR) AS record, CAST(label AS INTEGER) AS label, try_cast(CASE WHEN vec_id % 7 = 0 THEN 'bad' ELSE CAST(vec_id AS VARCHAR) END AS DOUBLE) AS a FROM embeddings")
def fn_feature_matrix(spark, d):
    e = S.read(spark, d, "embeddings")
    raw = e.select(F.col("vec_id").cast("string").alias("name"), "label", F.lit("x").alias("mode"), F.when(F.col("vec_id") % 7 == 0, "bad").otherwise(F.col("vec_id").cast("string")).alias("a"))
    return A.feature_matrix(S.with_record(raw))


@query("WITH l AS (SELECT CAST(user_id AS VARCHAR) AS record, value FROM events), a AS (SELECT 'annotated_interval_imf' || (CAST(record AS INTEGER) % 6) AS experiment, count(*) AS n FROM l GROUP BY ALL) SELECT experiment, n FROM a WHERE regexp_matches(experiment, '^(annotated_interval|fixed_3min)_imf[1-4]$')")
def fn_publication_subset(spark, d):
    e = S.event_samples(spark, d).withColumns({"mode": F.lit("annotated_interval"), "feature_source": F.concat(F.lit("imf"), (F.col("record").cast("int") % 6).cast("string"))})
    named = e.groupBy(C.experiment_name().alias("experiment")).agg(F.count("*").alias("n"))
    return named.filter(F.col("experiment").rlike("^(annotated_interval|fixed_3min)_imf[1-4]$"))


_ZS = ", ".join(f"(ex.{f} - m_{f}) / s_{f} AS {f}" for f in FEATURES)
_ZM = ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in FEATURES)
#: Repeats and columns of the models that one plan trains for all folds.
ALL_REPEATS, FOREST_REPEATS, ALL_FEATURES = REPEATS, 2, [f"f{k + 1}" for k in range(64)]


def grouped_folds(spark, d, features: list[str] = ALL_FEATURES, repeats: int = ALL_REPEATS) -> L.Folds:
    ml = S.ml_features(spark, d, len(features))
    return L.assigned(ml, features, P.folds(P.record_labels(ml), repeats), repeats)


def oof(scored: DataFrame) -> DataFrame:
    return r6(E.record_scores(scored, ["repeat", "fold"]))


@query()
def model_logistic_oof(spark, d):
    """Logistic regression of all 150 folds at once, over all columns."""
    data = grouped_folds(spark, d)
    return oof(L.linear_scores(data, L.logistic(data)))


def _newton_sql(steps: int = 9) -> str:
    """Newton's steps of the three-column logistic unrolled: sums of a step, elimination column by column, back substitution."""
    n, x = 4, ["z.f1", "z.f2", "z.f3", "1.0::DOUBLE"]
    parts = [f"""w0 AS MATERIALIZED (SELECT DISTINCT repeat, fold, {", ".join(f"0.0::DOUBLE AS w{i}" for i in range(n))} FROM zs)"""]
    for t in range(steps):
        z = " + ".join(f"w{i} * {x[i]}" for i in range(n))
        grad = ", ".join(f"sum(0.5::DOUBLE * s * (p - label) * {x[i].replace('z.', '')})" + (f" + max(w{i})" if i < 3 else "") + f" AS a{i}{n}" for i in range(n))
        curve = ", ".join(f"sum(0.5::DOUBLE * s * p * (1 - p) * {x[i].replace('z.', '')} * {x[j].replace('z.', '')})" + (" + 1.0::DOUBLE" if i == j < 3 else "") + f" AS a{i}{j}" for i in range(n) for j in range(n))
        keep = ", ".join(f"max(w{i}) AS w{i}" for i in range(n))
        parts.append(f"e{t}_0 AS MATERIALIZED (SELECT repeat, fold, {keep}, {curve}, {grad} FROM (SELECT z.*, w0, w1, w2, w3, 1 / (1 + exp(-({z}))) AS p FROM zs z JOIN w{t} USING (repeat, fold)) GROUP BY repeat, fold)")
        for c in range(n - 1):
            cells = ", ".join(f"a{i}{j} - a{i}{c} * a{c}{j} / a{c}{c} AS a{i}{j}" if i > c else f"a{i}{j}" for i in range(n) for j in range(n + 1))
            parts.append(f"e{t}_{c + 1} AS MATERIALIZED (SELECT repeat, fold, w0, w1, w2, w3, {cells} FROM e{t}_{c})")
        sql = f"SELECT * FROM e{t}_{n - 1}"
        for i in reversed(range(n)):
            sql = f"SELECT *, (a{i}{n}{''.join(f' - a{i}{j} * d{j}' for j in range(i + 1, n))}) / a{i}{i} AS d{i} FROM ({sql})"
        parts.append(f"w{t + 1} AS MATERIALIZED (SELECT repeat, fold, {', '.join(f'w{i} - d{i} AS w{i}' for i in range(n))} FROM ({sql}))")
    return ", ".join(parts)


@query(f"""WITH {EX}, zm AS (SELECT repeat, fold, {_ZM}, count(*) AS n, count(*) FILTER (label = 1) AS n1 FROM ex WHERE train GROUP BY repeat, fold),
 zs AS MATERIALIZED (SELECT ex.label, ex.repeat, ex.fold, n / (2.0::DOUBLE * CASE WHEN label = 1 THEN n1 ELSE n - n1 END) AS s, {_ZS} FROM ex JOIN zm USING (repeat, fold) WHERE train), {_newton_sql()}
 SELECT repeat, fold, name, round(value, 6) AS value FROM (SELECT repeat, fold, unnest(['f1', 'f2', 'f3', 'intercept']) AS name, unnest([w0, w1, w2, w3]) AS value FROM w9)""")
def model_logistic_coefficients(spark, d):
    """(repeat, fold, name, value): coefficients of the logistic regression of all 150 folds, over three columns."""
    data = grouped_folds(spark, d, FEATURES)
    w = L.logistic(data)
    rows = [(g // data.k, g % data.k, n, float(v)) for g in range(data.groups) for n, v in zip([*FEATURES, "intercept"], w[g], strict=True)]
    return r6(spark.createDataFrame(rows, "repeat int, fold int, name string, value double"))


@query()
def model_forest_oof(spark, d):
    """Forests at the preset's size, over all columns; a forest of 500 trees for each fold of FOREST_REPEATS repeats."""
    data = T.binned(grouped_folds(spark, d, repeats=FOREST_REPEATS))
    return oof(T.forest_scores(data))


@query()
def model_svm_oof(spark, d):
    """Linear support vector machines of all 150 folds at once, over all columns, with Platt's probabilities."""
    data = grouped_folds(spark, d)
    model = L.support(data)
    return oof(L.linear_scores(data, model, L.platt(data, model)))


@query()
def model_tree_oof(spark, d):
    """Decision trees of all 150 folds at once, over all columns."""
    data = T.binned(grouped_folds(spark, d))
    return oof(T.tree_scores(data))


_STEPS = [k / 20 for k in range(-8, 9)]


def _level_sql(t: int) -> str:
    """The best split of every node of level t, and the side that its rows go to, null where it doesn't split."""
    by = ", ".join(["repeat", "fold", *[f"s{k}" for k in range(t)]])
    node = " AND ".join(["b.repeat = a.repeat", "b.fold = a.fold", *[f"b.s{k} IS NOT DISTINCT FROM a.s{k}" for k in range(t)]])
    good = lambda s: f"({s}0 * {s}0 + {s}1 * {s}1) / ({s}0 + {s}1)"
    return f"""c{t} AS (SELECT {by}, f, c, (count(*) FILTER (x <= c AND label = 0))::DOUBLE AS l0, (count(*) FILTER (x <= c AND label = 1))::DOUBLE AS l1, (count(*) FILTER (x > c AND label = 0))::DOUBLE AS r0,
  (count(*) FILTER (x > c AND label = 1))::DOUBLE AS r1, (count(*) FILTER (label = 0))::DOUBLE AS t0, (count(*) FILTER (label = 1))::DOUBLE AS t1
  FROM (SELECT *, unnest([1, 2, 3]) AS f, unnest([f1, f2, f3]) AS x FROM n{t} WHERE train), (SELECT k / 20.0::DOUBLE AS c FROM range(-8, 9) r(k)) GROUP BY ALL),
 b{t} AS (SELECT * FROM (SELECT *, round({good("l")} + {good("r")} - {good("t")}, 9) AS gain FROM c{t} WHERE l0 + l1 > 0 AND r0 + r1 > 0) WHERE gain > 1e-7 QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY gain DESC, f, c) = 1),
 n{t + 1} AS MATERIALIZED (SELECT a.*, CASE WHEN b.f IS NULL THEN NULL ELSE CAST((CASE b.f WHEN 1 THEN a.f1 WHEN 2 THEN a.f2 ELSE a.f3 END) > b.c AS INTEGER) END AS s{t} FROM n{t} a LEFT JOIN b{t} b ON {node})"""


@query(f"""WITH {EX}, n0 AS MATERIALIZED (SELECT segment_id, record, label, repeat, fold, train, f1, f2, f3 FROM ex), {_level_sql(0)}, {_level_sql(1)},
 v AS (SELECT repeat, fold, s0, s1, avg(label) AS score FROM n2 WHERE train GROUP BY ALL)
 SELECT n2.repeat, n2.fold, record, CAST(min(label) AS INTEGER) AS label, round(max(score), 6) AS score FROM n2 JOIN v ON v.repeat = n2.repeat AND v.fold = n2.fold AND v.s0 IS NOT DISTINCT FROM n2.s0 AND v.s1 IS NOT DISTINCT FROM n2.s1
 WHERE NOT train GROUP BY n2.repeat, n2.fold, record""")
def model_shallow_tree_oof(spark, d):
    """Trees of depth 2 of all 150 folds over three columns and fixed thresholds."""
    data = T.binned(grouped_folds(spark, d, FEATURES), cuts=[_STEPS] * len(FEATURES))
    return oof(T.tree_scores(data, 2))


@query()
def model_boosting_oof(spark, d):
    """Gradient boosting of all 150 folds at once, over all columns, at the preset's size."""
    data = T.binned(grouped_folds(spark, d))
    return oof(T.boosted_scores(data))


@query()
def model_boosted_deep_oof(spark, d):
    """Deeper boosted trees over all columns, for the folds of FOREST_REPEATS repeats."""
    data = T.binned(grouped_folds(spark, d, repeats=FOREST_REPEATS))
    return oof(T.boosted_scores(data, depth=6))


@query()
def model_perceptron_oof(spark, d):
    return r6(model_oof(spark, d, "MLP"))


_CV = ", ".join(f"0.5::DOUBLE * covar_samp({FEATURES[i]}, {FEATURES[j]}) + {0.5 if i == j else 0.0}::DOUBLE AS c{i}{j}" for i in range(3) for j in range(i, 3))


def _qda(y: str) -> str:
    """Log of a class's share times its density but for what both classes share; the 3 x 3 inverse by cofactors."""
    c = lambda i, j: f"{y}.c{min(i, j)}{max(i, j)}"
    det = f"({c(0, 0)} * ({c(1, 1)} * {c(2, 2)} - {c(1, 2)} * {c(1, 2)}) - {c(0, 1)} * ({c(0, 1)} * {c(2, 2)} - {c(1, 2)} * {c(0, 2)}) + {c(0, 2)} * ({c(0, 1)} * {c(1, 2)} - {c(1, 1)} * {c(0, 2)}))"
    cof = {(0, 0): f"{c(1, 1)} * {c(2, 2)} - {c(1, 2)} * {c(1, 2)}", (1, 1): f"{c(0, 0)} * {c(2, 2)} - {c(0, 2)} * {c(0, 2)}", (2, 2): f"{c(0, 0)} * {c(1, 1)} - {c(0, 1)} * {c(0, 1)}",
           (0, 1): f"{c(0, 2)} * {c(1, 2)} - {c(0, 1)} * {c(2, 2)}", (0, 2): f"{c(0, 1)} * {c(1, 2)} - {c(0, 2)} * {c(1, 1)}", (1, 2): f"{c(0, 1)} * {c(0, 2)} - {c(0, 0)} * {c(1, 2)}"}
    r = lambda i: f"(z.{FEATURES[i]} - {y}.m_{FEATURES[i]})"
    form = " + ".join(f"{1 if i == j else 2} * ({cof[i, j]}) * {r(i)} * {r(j)}" for i, j in cof)
    return f"ln({y}.n) - 0.5 * (ln({det}) + ({form}) / {det})"


@query(f"""WITH {EX}, zm AS (SELECT repeat, fold, {_ZM} FROM ex WHERE train GROUP BY repeat, fold), z AS (SELECT ex.record, ex.label, ex.repeat, ex.fold, ex.train, {_ZS} FROM ex JOIN zm USING (repeat, fold)),
 q AS (SELECT repeat, fold, label, count(*)::DOUBLE AS n, {", ".join(f"avg({f}) AS m_{f}" for f in FEATURES)}, {_CV} FROM z WHERE train GROUP BY repeat, fold, label),
 s AS (SELECT z.*, 1 / (1 + exp(({_qda("a")}) - ({_qda("b")}))) AS score FROM z JOIN q a ON a.repeat = z.repeat AND a.fold = z.fold AND a.label = 0 JOIN q b ON b.repeat = z.repeat AND b.fold = z.fold AND b.label = 1)
 SELECT repeat, fold, record, CAST(min(label) AS INTEGER) AS label, round(max(score), 6) AS score FROM s WHERE NOT train GROUP BY repeat, fold, record""")
def model_qda_oof(spark, d):
    s = M.quadratic_discriminant(P.standardised(split_rows(spark, d), FEATURES), FEATURES)
    return r6(E.record_scores(s.filter("not train"), ["repeat", "fold"]))


def model_oof(spark, d, name: str) -> DataFrame:
    """Out-of-fold record scores of an MLlib model over FOREST_REPEATS repeats (each fold is a job of its own), at the presets' sizes."""
    rows = P.standardised(split_rows(spark, d, FOREST_REPEATS), FEATURES)
    s = M.fitted(rows, FEATURES, name)
    return E.record_scores(s.filter("not train"), ["repeat", "fold"])


def nb_study() -> J.Study:
    def predict(rows: DataFrame, split: DataFrame) -> DataFrame:
        return E.record_scores(M.naive_bayes(P.expanded(rows, split), FEATURES).filter("not train"), ["repeat", "fold"])

    return J.Study("NB", "smoothing=1e-9", predict)


def qda_study(regular: float = 0.5) -> J.Study:
    def predict(rows: DataFrame, split: DataFrame) -> DataFrame:
        scored = M.quadratic_discriminant(P.standardised(P.expanded(rows, split), FEATURES), FEATURES, regular=regular)
        return E.record_scores(scored.filter("not train"), ["repeat", "fold"])

    return J.Study("QDA", f"regular={regular}", predict)


@query(f"""WITH p AS (SELECT 'NB' AS model, * FROM ({SQL["cv_gnb_oof"]}) UNION ALL SELECT 'QDA', repeat, fold, record, label, score FROM ({SQL["model_qda_oof"]}))
 SELECT model, repeat, count(*) AS n, count(DISTINCT fold) AS folds, round(sum(score), 6) AS total, NOT (model = 'NB' AND repeat < 10) AS fitted FROM p GROUP BY model, repeat""")
def run_resumed(spark, d):
    """Thirty repeats of two models, taken up after a run that stopped at ten of one model and had five of the other with another parameter."""
    ml, path = kept(S.ml_features(spark, d, 3)), work_folder(spark)
    J.resume(ml, FEATURES, [nb_study()], 10, path)
    J.resume(ml, FEATURES, [qda_study(0.25)], 5, path)
    done = J.resume(ml, FEATURES, [nb_study(), qda_study()], REPEATS, path)
    scored = r6(J.results(spark, path)).groupBy("model", "repeat").agg(F.count("*").alias("n"), F.count_distinct("fold").alias("folds"), F.round(F.sum("score"), 6).alias("total"))
    return scored.join(done.select("model", "repeat", "fitted"), ["model", "repeat"])
