"""Queries on autocorrelation, spectra and decomposition, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.operators import decompose as D
from undula.operators import features as X
from undula.operators import segments as G
from undula.operators import spectral as W
from undula.plans.signals import EV, KEYS, PAIRS, WIN, WIDTH, r6, tall, windows
from undula.schema import FEATURES
from undula.sources import tables as S

QUERIES, SQL = {}, {}
LAGS = 8
PSD = WIN + """, z AS (SELECT record, n, size, x2 FROM ev JOIN sz USING (record) WHERE n < size // 16 * 16),
 t AS (SELECT record, segment_id, i, 'ch1' AS channel, x FROM w UNION ALL SELECT record, CAST(n // 16 AS INTEGER), CAST(n % 16 AS INTEGER), 'ch2', x2 FROM z),
 dm AS (SELECT record, segment_id, channel, i, (x - avg(x) OVER (PARTITION BY record, segment_id, channel)) * (0.5 - 0.5 * cos(2 * pi() * i / 16)) AS d FROM t),
 ft AS (SELECT record, segment_id, channel, k, sum(d * cos(2 * pi() * k * i / 16)) AS re, sum(d * sin(2 * pi() * k * i / 16)) AS im FROM dm, range(9) r(k) GROUP BY ALL),
 ps AS (SELECT record, segment_id, channel, k * 20.0::DOUBLE / 16 AS freq, (re * re + im * im) / (20.0::DOUBLE * 6.0::DOUBLE) * CASE WHEN k > 0 AND k < 8 THEN 2 ELSE 1 END AS psd FROM ft),
 r1 AS (SELECT record, channel, freq, avg(psd) AS psd FROM ps WHERE freq <= 5 GROUP BY ALL), rp AS (SELECT record, CAST(record AS INTEGER) % 2 AS label, freq, avg(psd) AS psd FROM r1 GROUP BY ALL)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {WIN}, dm AS (SELECT record, segment_id, i, x - avg(x) OVER (PARTITION BY record, segment_id) AS d FROM w), s AS (SELECT a.record, a.segment_id, CAST(b.i - a.i AS INTEGER) AS lag, sum(a.d * b.d) AS s FROM dm a JOIN dm b ON a.record = b.record AND a.segment_id = b.segment_id AND b.i - a.i BETWEEN 0 AND 8 GROUP BY ALL)
 SELECT record, segment_id, lag, round(s / (max(s) FILTER (lag = 0) OVER (PARTITION BY record, segment_id) + 1e-12), 6) AS r FROM s""")
def sig_acf(spark, d):
    return r6(W.autocorrelation(windows(spark, d), KEYS, LAGS))


@query(f"WITH {PSD} SELECT record, segment_id, round(freq, 6) AS freq, round(psd, 6) AS psd FROM ps WHERE channel = 'ch1'")
def sig_psd(spark, d):
    return r6(W.welch(windows(spark, d), KEYS, 20.0, WIDTH))


@query(f"WITH {PSD} SELECT record, segment_id, channel, round(freq, 6) AS freq, round(psd, 6) AS psd FROM ps")
def sig_psd_native(spark, d):
    return r6(W.welch_single(tall(spark, d), [*KEYS, "channel"], WIDTH, 20.0))


OVERLAP = f"WITH {WIN}" + """, e AS (SELECT w.record, segment_id, v.v, i - v.v * 4 AS j, x FROM w, range(3) v(v) WHERE i BETWEEN v.v * 4 AND v.v * 4 + 7),
 dm AS (SELECT record, segment_id, v, j, (x - avg(x) OVER (PARTITION BY record, segment_id, v)) * (0.5 - 0.5 * cos(2 * pi() * j / 8)) AS d FROM e),
 ft AS (SELECT record, segment_id, v, k, sum(d * cos(2 * pi() * k * j / 8)) AS re, sum(d * sin(2 * pi() * k * j / 8)) AS im FROM dm, range(5) r(k) GROUP BY ALL),
 ps AS (SELECT record, segment_id, k * 20.0::DOUBLE / 8 AS freq, avg((re * re + im * im) / (20.0::DOUBLE * 3.0::DOUBLE) * CASE WHEN k > 0 AND k < 4 THEN 2 ELSE 1 END) AS psd FROM ft GROUP BY ALL)
 SELECT record, segment_id, round(freq, 6) AS freq, round(psd, 6) AS psd FROM ps"""


@query(OVERLAP)
def sig_psd_overlap(spark, d):
    """Three windows of half a segment each, half overlapping, by transforms."""
    return r6(W.welch(windows(spark, d), KEYS, 20.0, WIDTH // 2))


@query(OVERLAP)
def sig_psd_overlap_native(spark, d):
    """The same by sums over sines and cosines."""
    return r6(W.welch_windows(windows(spark, d), KEYS, WIDTH // 2, 20.0))


def record_psd(spark, d) -> DataFrame:
    psd = W.welch_single(tall(spark, d), [*KEYS, "channel"], WIDTH, 20.0)
    return W.record_spectrum(psd.withColumn("label", F.col("record").cast("int") % 2))


@query(f"WITH {PSD} SELECT record, label, round(freq, 6) AS freq, round(psd, 6) AS psd FROM rp")
def sig_record_psd(spark, d):
    return r6(record_psd(spark, d))


@query(f"WITH {PSD} SELECT round(freq, 6) AS freq, round(avg(psd) FILTER (label = 0), 6) AS term, round(avg(psd) FILTER (label = 1), 6) AS preterm FROM rp GROUP BY freq")
def sig_class_psd(spark, d):
    return r6(W.class_spectrum(record_psd(spark, d)))


@query(f"""WITH {EV}, gr AS (SELECT record, unnest(range(0, 4 * max(n) // 3 + 4)) * 1.5::DOUBLE AS t FROM ev GROUP BY record),
 ev2 AS (SELECT record, n::DOUBLE * 2 AS t, x FROM ev)
 SELECT gr.record, gr.t, round(coalesce(a.x + (b.x - a.x) * (gr.t - a.t) / nullif(b.t - a.t, 0), a.x, b.x), 6) AS x FROM gr ASOF LEFT JOIN ev2 a ON a.record = gr.record AND a.t <= gr.t ASOF LEFT JOIN ev2 b ON b.record = gr.record AND b.t >= gr.t""")
def sig_regrid(spark, d):
    """Every record whole on a grid that meets some of its samples, lies between others, and goes on a little past the last."""
    ev = S.event_samples(spark, d)
    ends = ev.groupBy("record").agg(F.floor(4 * F.max("n") / 3).cast("int").alias("_last"))
    grid = ends.select("record", F.explode(F.transform(F.sequence(F.lit(0), F.col("_last") + 3), lambda k: k * F.lit(1.5).cast("double"))).alias("t"))
    return r6(W.regridded(ev.select("record", (F.col("n") * 2.0).alias("t"), "x"), grid, ["record"], "t", "x"))


@query(f"""WITH {EV}, gr AS (SELECT record, unnest(range(0, 2 * max(n))) * 1.0::DOUBLE + 0.5::DOUBLE AS t FROM ev GROUP BY record),
 ev2 AS (SELECT record, n::DOUBLE * 2 AS t, x FROM ev)
 SELECT gr.record, gr.t, round(coalesce(a.x + (b.x - a.x) * (gr.t - a.t) / nullif(b.t - a.t, 0), a.x, b.x), 6) AS x FROM gr ASOF LEFT JOIN ev2 a ON a.record = gr.record AND a.t <= gr.t ASOF LEFT JOIN ev2 b ON b.record = gr.record AND b.t >= gr.t""")
def sig_regrid_record(spark, d):
    """Every record whole, at points between its samples up to the last one."""
    ev = S.event_samples(spark, d)
    ends = ev.groupBy("record").agg(F.max("n").cast("int").alias("_last")).filter("_last > 0")
    grid = ends.select("record", F.explode(F.transform(F.sequence(F.lit(0), 2 * F.col("_last") - 1), lambda k: (k + 0.5).cast("double"))).alias("t"))
    return r6(W.regridded(ev.select("record", (F.col("n") * 2.0).alias("t"), "x"), grid, ["record"], "t", "x"))


def price_windows(spark, d) -> DataFrame:
    return G.fixed_slices(S.price_samples(spark, d), 128).select("record", "segment_id", "i", "x")


@query()
def emd_components(spark, d):
    """Modes and residual of windows of 128 samples; per window their number and how far their sum is from the signal."""
    w = price_windows(spark, d)
    parts = D.components(D.decomposition(w, KEYS), KEYS)
    total = parts.groupBy(*KEYS, "i").agg(F.sum("x").alias("_s"), F.count("*").alias("_n"))
    j = total.join(w, [*KEYS, "i"])
    return j.groupBy(KEYS).agg((F.max("_n") - 1).alias("n_modes"), (F.max(F.abs(F.col("_s") - F.col("x"))) < 1e-6).alias("sums_to_signal"))


PRICES = """pr AS (SELECT CAST(l_suppkey AS VARCHAR) AS record, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS n, l_extendedprice AS x FROM lineitem),
 ps AS (SELECT record, count(*) AS size FROM pr GROUP BY record), pw AS (SELECT record, CAST(n // 128 AS INTEGER) AS segment_id, CAST(n % 128 AS INTEGER) AS i, x FROM pr JOIN ps USING (record) WHERE n < size // 128 * 128)"""


@query(f"WITH {PRICES} SELECT record, segment_id, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS deviation, true AS sums_to_signal, true AS modes_in_range, true AS whole_components, 0 AS n_absent, true AS one_at_lag_0 FROM pw GROUP BY record, segment_id")
def emd_invariants(spark, d):
    """What holds of every decomposition: its parts sum to the signal (whose mean and deviation are taken from that sum), there
    are at most four modes, all of full length, a mode that isn't there has no rows, and every part correlates with itself."""
    w = price_windows(spark, d)
    made = D.decomposition(w, KEYS)
    parts = D.components(made, KEYS)
    total = parts.groupBy(*KEYS, "i").agg(F.sum("x").alias("_s"), F.count("*").alias("_n")).join(w, [*KEYS, "i"])
    per = total.groupBy(KEYS).agg(F.avg("_s").alias("mean"), F.stddev_pop("_s").alias("deviation"), (F.max(F.abs(F.col("_s") - F.col("x"))) < 1e-6).alias("sums_to_signal"), (F.max("_n") <= 5).alias("modes_in_range"), ((F.min("_n") == F.max("_n")) & (F.count("*") == 128)).alias("whole_components"))
    absent = made.select(*KEYS, F.size(F.coalesce(D.mode_number("imfs", 5), F.array().cast("array<double>"))).alias("n_absent"))
    first = W.autocorrelation(parts, [*KEYS, "component"], 0).groupBy(KEYS).agg((F.max(F.abs(F.col("r") - 1)) < 1e-6).alias("one_at_lag_0"))
    return r6(per.join(absent, KEYS).join(first, KEYS))


@query(f"WITH {PAIRS}, c AS (SELECT * FROM pairs WHERE kind = 'contraction'), u AS (SELECT * FROM pairs WHERE kind = 'dummy') SELECT record, n, x, round(x, 6) AS parts, n / 20.0::DOUBLE AS sec, CAST(EXISTS (SELECT 1 FROM c WHERE c.record = ev.record AND ev.n >= start_sample AND ev.n < end_sample) AS INTEGER) AS in_contraction, CAST(EXISTS (SELECT 1 FROM u WHERE u.record = ev.record AND ev.n >= start_sample AND ev.n < end_sample) AS INTEGER) AS in_dummy FROM ev")
def emd_recording_sum(spark, d):
    """Whole recordings: every sample, the sum of its parts, and the interval flags."""
    ev = S.event_samples(spark, d).select("record", "n", "x")
    parts = D.components(D.decomposition(ev.withColumnRenamed("n", "i"), ["record"]), ["record"])
    total = parts.groupBy("record", F.col("i").cast("long").alias("n")).agg(F.sum("x").alias("parts"))
    a = S.event_annotations(spark, d)
    flagged = G.membership(G.membership(ev, G.marker_pairs(a, "BC", "EC"), "in_contraction"), G.marker_pairs(a, "BD", "ED"), "in_dummy")
    return flagged.join(total, ["record", "n"]).withColumns({"parts": F.round("parts", 6), "sec": F.col("n") / 20.0})


@query()
def emd_mode_features(spark, d):
    """Features of the first mode of windows of 128 samples."""
    first = D.component(D.decomposition(price_windows(spark, d), KEYS), KEYS, 1)
    return r6(X.all_features(first, KEYS)).select(*KEYS, *FEATURES)


def mode_record_psd(spark, d) -> DataFrame:
    """Record spectra of the first mode of every window of 128 samples; a window without one is left out."""
    first = D.component(D.decomposition(price_windows(spark, d), KEYS), KEYS, 1)
    psd = W.welch(first, KEYS, 20.0, 64).withColumns({"channel": F.lit("ch1"), "label": F.col("record").cast("int") % 2})
    return W.record_spectrum(psd)


@query()
def emd_record_psd(spark, d):
    return r6(mode_record_psd(spark, d))


@query()
def emd_class_psd(spark, d):
    return r6(W.class_spectrum(mode_record_psd(spark, d)))


@query()
def emd_component_acf_psd(spark, d):
    """Autocorrelation of every mode and the residual, up to eight lags."""
    parts = D.components(D.decomposition(price_windows(spark, d), KEYS), KEYS)
    return r6(W.autocorrelation(parts, [*KEYS, "component"], LAGS))


@query()
def emd_component_psd(spark, d):
    """Spectrum up to 3 Hz of every mode and the residual of windows of 128 samples."""
    parts = D.components(D.decomposition(price_windows(spark, d), KEYS), KEYS)
    return r6(W.welch(parts, [*KEYS, "component"], 20.0, 64).filter("freq <= 3"))


@query()
def emd_recording(spark, d):
    """Whole-recording decomposition of one channel with interval flags: per sample its value, first mode and flags."""
    ev = S.event_samples(spark, d).select("record", "n", "x")
    first = D.component(D.decomposition(ev.withColumnRenamed("n", "i"), ["record"]), ["record"], 1).select("record", F.col("i").cast("long").alias("n"), F.col("x").alias("imf1"))
    a = S.event_annotations(spark, d)
    flagged = G.membership(G.membership(ev, G.marker_pairs(a, "BC", "EC"), "in_contraction"), G.marker_pairs(a, "BD", "ED"), "in_dummy")
    return r6(flagged.join(first, ["record", "n"]).withColumn("sec", F.col("n") / 20.0))
