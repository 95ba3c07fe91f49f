"""Reports and consistency checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_report(intervals: DataFrame) -> DataFrame:
    """Counts per record, per class and in all, by one rollup."""
    return intervals.rollup("class", "record").agg(F.count("*").alias("n_intervals"))


def window_report(sizes: DataFrame, width: int) -> DataFrame:
    """How many records have how many whole windows."""
    return sizes.groupBy(F.floor(F.col("n_samples") / width).alias("n_windows")).agg(F.count("*").alias("n_records"))


def checks(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(check, expected, actual, ok) of pairs of frames of one value each."""
    rows = [e.toDF("expected").crossJoin(a.toDF("actual")).select(F.lit(k).alias("check"), F.col("expected").cast("long"), F.col("actual").cast("long")) for k, (e, a) in pairs.items()]
    return reduce(DataFrame.union, rows).withColumn("ok", F.col("expected") == F.col("actual"))


def required(checked: DataFrame) -> DataFrame:
    """`checked`, or an error when it is used if a check failed."""
    return checked.withColumn("ok", F.when(F.col("ok"), True).otherwise(F.raise_error(F.concat(F.lit("check failed: "), F.col("check"))).cast("boolean")))
