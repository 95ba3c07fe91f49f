"""Queries that write tables and read them back, and picks, with their SQL.

What is written goes to a new folder below the one that executors share, and is the query's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.functions import columns as C
from undula.operators import assemble as A
from undula.operators import evaluate as E
from undula.operators import features as X
from undula.operators import runs as J
from undula.operators import segments as G
from undula.plans import evaluation as V
from undula.plans.signals import EV, KEYS, PAIRS, REC, WIN, r6, seg_annotated_union, tall, windows
from undula.plans.signals import labelled as recordings
from undula.sources import sinks as K
from undula.sources import tables as S

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def both_modes(spark, d) -> DataFrame:
    """(mode, feature_source, record, segment_id, DASDV, LOG) of fixed and annotated segments."""
    fixed = X.energy(windows(spark, d), KEYS).withColumn("mode", F.lit("fixed_3min"))
    ev = S.event_samples(spark, d).select("record", "n", "x")
    cut = G.sliced(ev, G.numbered(seg_annotated_union(spark, d), "annotated_interval", 20.0).select("record", "segment_id", "start_sample", "end_sample"))
    annotated = X.energy(cut.withColumn("i", F.col("n") - F.col("start_sample")), KEYS).withColumn("mode", F.lit("annotated_interval"))
    return r6(A.stacked([fixed, annotated]).withColumn("feature_source", F.lit("time_domain")).drop("MTKE"))


@query(f"""WITH {PAIRS}, sz AS (SELECT record, count(*) AS size FROM ev GROUP BY record),
 s AS (SELECT 'fixed_3min' AS mode, ev.record, CAST(n // 16 AS INTEGER) AS segment_id, n AS i, x FROM ev JOIN sz USING (record) WHERE n < size // 16 * 16
  UNION ALL SELECT 'annotated_interval', ev.record, k.segment_id, n, x FROM ev JOIN (SELECT *, CAST(row_number() OVER (PARTITION BY record ORDER BY start_sample, end_sample) - 1 AS INTEGER) AS segment_id FROM iv) k ON k.record = ev.record AND n >= start_sample AND n < end_sample),
 l AS (SELECT *, lag(x) OVER (PARTITION BY mode, record, segment_id ORDER BY i) AS a FROM s)
 SELECT mode, 'time_domain' AS feature_source, record, segment_id, round(coalesce(sqrt(avg((x - a) * (x - a))), 0), 6) AS "DASDV", round(exp(avg(ln(abs(x) + 1e-12))), 6) AS "LOG" FROM l GROUP BY ALL""")
def io_features(spark, d):
    """A feature table of both modes, written by mode and source and read back."""
    path = K.work_folder(spark)
    K.write_features(both_modes(spark, d), path)
    return S.feature_table(spark, path).withColumn("record", F.col("record").cast("string"))


@query(f"WITH {V.TH} SELECT 'fixed_3min_' || lower(model) AS experiment, model, CAST(repeat AS INTEGER) AS repeat, fold, record, label, score, prediction FROM pr")
def io_predictions(spark, d):
    """Predictions written by experiment and read back with their columns checked."""
    path = K.work_folder(spark)
    p = V.predictions(spark, d).withColumn("experiment", F.concat(F.lit("fixed_3min_"), F.lower("model")))
    K.write_experiment(p, path)
    return S.prediction_table(spark, path).select("experiment", "model", "repeat", "fold", "record", "label", "score", "prediction")


@query(f"WITH {V.METRICS_SQL}, s AS (SELECT model, avg(mcc) AS m, avg(roc_auc) AS r FROM me GROUP BY model) SELECT model, CAST(CASE model WHEN 'LR' THEN 1 WHEN 'RF' THEN 4 WHEN 'NB' THEN 6 END AS INTEGER) AS rank, printf('%.4f', m) AS record_mcc_mean, printf('%.4f', r) AS record_roc_auc_mean FROM s")
def io_summary(spark, d):
    """A summary exported as text with four decimals and read back with short model names."""
    path = f"{K.work_folder(spark)}/summary.csv"
    s = E.summary(E.repeat_metrics(V.predictions(spark, d), V.BY), ["model"], ["mcc", "roc_auc"])
    K.write_csv(s, path, 4)
    return S.summary_table(spark, path).select("model", "rank", "record_mcc_mean", "record_roc_auc_mean")


@query(f"WITH {V.METRICS_SQL}, s AS (SELECT repeat, model, round(avg(accuracy), 4) AS record_accuracy_mean, round(avg(f1), 4) AS record_f1_mean FROM me GROUP BY repeat, model) SELECT 'annotated_interval_imf' || (repeat + 1) AS experiment, model, record_accuracy_mean, record_f1_mean FROM s")
def io_publication(spark, d):
    """Model and mean columns of several experiments' summaries, one below the other."""
    m = E.repeat_metrics(V.predictions(spark, d), V.BY)
    tables = {f"annotated_interval_imf{k + 1}": E.summary(m.filter(F.col("repeat") == k), ["model"], ["accuracy", "f1"]).withColumn("rank", F.lit(1)) for k in range(2)}
    out = K.publication(tables)
    return out.select("experiment", "model", *[F.round(c, 4).alias(c) for c in ("record_accuracy_mean", "record_f1_mean")])


@query(f"WITH {V.RS} SELECT 'a' AS experiment, model, CAST(repeat AS INTEGER) AS repeat, count(*) AS n, round(sum(CASE WHEN model = 'NB' THEN score + 1 ELSE score END), 6) AS total FROM rs GROUP BY model, repeat")
def run_written_results(spark, d):
    """Results of all tasks are written, those of one model again with other scores; each task has one result, the last."""
    path = K.work_folder(spark)
    s = V.scores(spark, d).withColumn("experiment", F.lit("a"))
    J.write_results(s, path)
    J.write_results(s.filter("model = 'NB'").withColumn("score", F.col("score") + 1), path)
    J.write_results(s.filter("model = 'NB'").withColumn("score", F.col("score") + 1), path)
    return spark.read.parquet(path).groupBy("experiment", "model", "repeat").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total"))


@query("SELECT o_orderpriority AS model, CAST(r AS INTEGER) AS repeat, n FROM (SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1), range(2) t(r)")
def run_selected_tasks(spark, d):
    """Tasks of the named models only."""
    models = S.read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(F.count("*").alias("n"))
    return J.tasks(J.selected(models, ["1-URGENT", "5-LOW"], "model"), 2).select("model", "repeat", "n")


@query("SELECT 'rec_' || CASE c_mktsegment WHEN 'BUILDING' THEN 'p' WHEN 'MACHINERY' THEN 'x' ELSE 't' END || CAST(c_custkey AS VARCHAR) AS record, '' AS \"RecType\", '' AS \"Gestation\", '' AS \"Rectime\", CAST(c_nationkey AS VARCHAR) AS \"Age\", '' AS \"Parity\", '' AS \"Abortions\", CASE WHEN c_custkey % 10 = 3 THEN c_mktsegment ELSE '' END AS \"Weight\", '' AS \"Placental_position\", '' AS \"Smoker\" FROM customer")
def rep_demographics(spark, d):
    """The nine demographic columns of header comments; what a header lacks is empty."""
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    weight = F.when(F.col("c_custkey") % 10 == 3, F.array(pair("Weight", F.col("c_mktsegment")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    comments = F.map_from_entries(F.concat(F.array(pair("Age", F.col("c_nationkey").cast("string"))), weight))
    keyed = S.read(spark, d, "customer").select("c_custkey", comments.alias("comments"))
    return S.recordings(spark, d).join(keyed, "c_custkey").select("record", *C.demographics())


@query(f"WITH {REC} SELECT record, label FROM rec WHERE label IN (0, 1) ORDER BY label DESC, record LIMIT 1")
def src_picked_record(spark, d):
    """The recording that is shown where none is named: the first preterm one."""
    return S.pick_record(S.cohort(recordings(spark, d))).select("record", "label")


@query(f"WITH {EV}, sz AS (SELECT record, count(*) AS size FROM ev GROUP BY record) SELECT record, segment_id, i, x FROM (SELECT record, CAST(n // 16 AS INTEGER) AS segment_id, CAST(n % 16 AS INTEGER) AS i, x2 AS x FROM ev JOIN sz USING (record) WHERE n < size // 16 * 16) WHERE segment_id = 1")
def src_picked_segment(spark, d):
    """The second segment of the second channel of every recording."""
    return S.pick_segment(tall(spark, d), "ch2", 1).select("record", "segment_id", "i", "x")


@query(f"""WITH {WIN}, z AS (SELECT record, n, size, x2 FROM ev JOIN sz USING (record) WHERE n < size // 16 * 16),
 t AS (SELECT record, segment_id, i, 'ch1_LOG' AS feature, x FROM w UNION ALL SELECT record, CAST(n // 16 AS INTEGER), CAST(n % 16 AS INTEGER), 'ch2_LOG', x2 FROM z)
 SELECT record, segment_id, feature, round(exp(avg(ln(abs(x) + 1e-12))), 6) AS value FROM t GROUP BY ALL""")
def asm_suffix_columns(spark, d):
    """The columns of one feature in a wide table, all channels, as rows."""
    wide = A.wide(X.energy(tall(spark, d), [*KEYS, "channel"]), KEYS, ["ch1", "ch2"], ["DASDV", "LOG", "MTKE"])
    return r6(A.tall(wide, KEYS, A.with_suffix(wide, "LOG")))


@query("SELECT vec_id, CAST(embedding[3] AS DOUBLE) AS third, CAST(embedding[len(embedding)] AS DOUBLE) AS last, CAST(NULL AS DOUBLE) AS beyond FROM embeddings")
def fn_mode_number(spark, d):
    """Components by their number from one; a number beyond them gives nothing."""
    e = S.read(spark, d, "embeddings")
    size = 64
    return e.select("vec_id", C.mode_number("embedding", 3).cast("double").alias("third"), C.mode_number("embedding", size).cast("double").alias("last"), C.mode_number("embedding", size + 1).cast("double").alias("beyond"))


@query("SELECT vec_id, CAST(place AS INTEGER) AS place, CAST(number AS INTEGER) AS number, CAST(embedding[number] AS DOUBLE) AS value FROM embeddings, (VALUES (0, 3), (1, 1), (2, 2), (3, 4)) t(place, number)")
def asm_main_mode(spark, d):
    """Components of every row, the main one first, none twice."""
    order = A.main_first([1, 2, 3, 4], 3)
    each = F.posexplode(F.array(*[F.struct(F.lit(k).alias("number"), C.mode_number("embedding", k).cast("double").alias("value")) for k in order])).alias("place", "s")
    return S.read(spark, d, "embeddings").select("vec_id", each).select("vec_id", "place", "s.number", "s.value")
