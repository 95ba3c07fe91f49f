"""Descriptive statistics of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def record_means(values: DataFrame) -> DataFrame:
    """(record, label, feature, value) of (record, label, segment_id, channel, feature, value): the mean over channels within
    a segment first, then over segments; nulls are skipped at both stages."""
    per = values.groupBy("record", "label", "segment_id", "feature").agg(F.avg("value").alias("value"))
    return per.groupBy("record", "label", "feature").agg(F.avg("value").alias("value"))


def effects(means: DataFrame) -> DataFrame:
    """(feature, cohen_d, preterm_mean, term_mean): difference of means over the pooled sample deviation; null if a class has
    fewer than two values or nothing is spread."""
    fine = means.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    of = lambda f, y: f(F.when(F.col("label") == y, F.col("value")))
    g = fine.groupBy("feature").agg(*[of(f, y).alias(f"{n}{y}") for y in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / F.nullif(F.col("n1") + F.col("n0") - 2, F.lit(0))
    d = F.when((F.col("n0") >= 2) & (F.col("n1") >= 2) & (pooled > 0), (F.col("m1") - F.col("m0")) / F.sqrt(F.nullif(F.greatest(pooled, F.lit(0.0)), F.lit(0.0))))
    return g.select("feature", d.alias("cohen_d"), F.col("m1").alias("preterm_mean"), F.col("m0").alias("term_mean"))


def effect_table(values: DataFrame) -> DataFrame:
    """Effects with the number and list of channels used."""
    used = values.groupBy("feature").agg(F.sort_array(F.collect_set("channel")).alias("_c"))
    return effects(record_means(values)).join(used, "feature").select("feature", "cohen_d", "preterm_mean", "term_mean", F.size("_c").alias("n_channels"), F.array_join("_c", ",").alias("channels"))


def quartiles(means: DataFrame) -> DataFrame:
    q = F.percentile("value", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)]))
    return means.groupBy("feature", "label").agg(q.alias("_q")).select("feature", "label", *[F.col("_q")[k].alias(n) for k, n in enumerate(("q25", "median", "q75"))])
