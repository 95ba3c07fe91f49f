"""Repeated folds that never split a record, and per-fold statistics of training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.schema import FOLDS, SEED


def record_labels(rows: DataFrame, key: str = "record") -> DataFrame:
    """One row per record; two labels of a record raise."""
    g = rows.groupBy(key).agg(F.min("label").alias("label"), F.max("label").alias("_m"))
    return g.select(key, F.when(F.col("label") == F.col("_m"), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("several labels: "), F.col(key).cast("string"))).cast("int")).alias("label"))


def folds(records: DataFrame, repeats: int, k: int = FOLDS, seed: int = SEED, key: str = "record") -> DataFrame:
    """(repeat, record, label, fold): per repeat, records shuffled within their label by a hash and dealt to k folds in turn.

    Records are ranked within (repeat, label), and a label starts dealing where the smaller labels stopped, so fold sizes
    and class counts differ by one at most and no window holds more than one label's records of one repeat.
    """
    r = records.select(key, "label").crossJoin(F.broadcast(records.sparkSession.range(repeats).select(F.col("id").cast("int").alias("repeat"))))
    rank = F.row_number().over(Window.partitionBy("repeat", "label").orderBy(F.md5(F.concat_ws(":", F.col(key), (F.lit(seed) + F.col("repeat")).cast("string"))), key))
    sizes = records.groupBy("label").agg(F.count("*").alias("_n"))
    before = sizes.alias("a").join(F.broadcast(sizes.alias("b")), F.col("b.label") < F.col("a.label"), "left").groupBy("a.label").agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    out = r.withColumn("_rank", rank - 1).join(F.broadcast(before), "label")
    return out.select("repeat", key, "label", ((F.col("_before") + F.col("_rank")) % k).cast("int").alias("fold"))


def split_report(split: DataFrame, key: str = "record") -> DataFrame:
    """Per repeat and fold: the sorted validation records, and how many records train and validate."""
    val = split.groupBy("repeat", "fold").agg(F.array_join(F.sort_array(F.collect_list(key)), ",").alias("validation_records"), F.count("*").alias("n_validation"), F.count_if(F.col("label") == 1).alias("n_validation_preterm"))
    total = split.groupBy("repeat").agg(F.count("*").alias("_n"))
    return val.join(total, "repeat").select("repeat", "fold", "validation_records", "n_validation", "n_validation_preterm", (F.col("_n") - F.col("n_validation")).alias("n_train"))


def expanded(rows: DataFrame, split: DataFrame, k: int = FOLDS, key: str = "record") -> DataFrame:
    """Rows of every (repeat, fold) with `train` true or false: each row trains k - 1 times and validates once a repeat."""
    each = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    j = rows.join(split.select("repeat", key, F.col("fold").alias("_own")), key)
    return j.withColumn("fold", each).withColumn("train", F.col("fold") != F.col("_own")).drop("_own")


def _train(column, condition=None):
    return F.when(F.col("train") if condition is None else F.col("train") & condition, column)


def imputed(rows: DataFrame, features: list[str], by: tuple[str, ...] = ("repeat", "fold")) -> DataFrame:
    """Nulls replaced by the training rows' mean of the fold; a feature without any stays null."""
    means = rows.groupBy(*by).agg(*[F.avg(_train(F.col(f))).alias(f"_m_{f}") for f in features])
    return rows.join(means, list(by)).withColumns({f: F.coalesce(f, f"_m_{f}") for f in features}).drop(*[f"_m_{f}" for f in features])


def standardised(rows: DataFrame, features: list[str], by: tuple[str, ...] = ("repeat", "fold")) -> DataFrame:
    """Centred and scaled by the training rows' mean and population deviation; no spread gives 0."""
    stats = rows.groupBy(*by).agg(*[f(_train(F.col(x))).alias(f"_{n}_{x}") for x in features for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = {x: F.when(F.col(x).isNotNull(), F.coalesce((F.col(x) - F.col(f"_m_{x}")) / F.nullif(F.col(f"_s_{x}"), F.lit(0.0)), F.lit(0.0))) for x in features}
    return rows.join(stats, list(by)).withColumns(scaled).drop(*[f"_{n}_{x}" for x in features for n in "ms"])


def class_weights(rows: DataFrame, by: tuple[str, ...] = ("repeat", "fold")) -> DataFrame:
    """(by, label, weight) of balanced training weights n / (2 n_c)."""
    n = rows.filter("train").groupBy(*by, "label").agg(F.count("*").alias("_c"))
    return n.withColumn("weight", F.sum("_c").over(Window.partitionBy(*by)) / (2.0 * F.col("_c"))).drop("_c")
