"""Assembling feature tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.schema import FAMILIES, META, MODELS


def wide(features: DataFrame, keys: list[str], channels: list[str], names: list[str]) -> DataFrame:
    """One row per segment with <channel>_<feature> columns. Names are given, so no extra job looks for them."""
    pick = [F.max(F.when(F.col("channel") == c, F.col(n))).alias(f"{c}_{n}") for c in channels for n in names]
    return features.groupBy(keys).agg(*pick)


def tall(table: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, feature, value) of a wide table."""
    return table.unpivot(keys, names, "feature", "value")


def stacked(tables: list[DataFrame]) -> DataFrame:
    """Feature tables of several modes and sources as one; a column that one lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in META]


def feature_matrix(df: DataFrame) -> DataFrame:
    """record, label and features as doubles; what isn't a number becomes null. A table without labels raises."""
    if "label" not in df.columns:
        raise ValueError("the table has no label column")
    return df.select(F.col("record").cast("string"), F.col("label").cast("int"), *[F.nullif(F.col(c).try_cast("double"), F.lit(float("nan"))).alias(c) for c in feature_columns(df)])


def main_first(numbers: list[int], main: int) -> list[int]:
    return list(dict.fromkeys([main, *numbers]))


def with_suffix(df: DataFrame, feature: str) -> list[str]:
    return sorted(c for c in df.columns if c.endswith("_" + feature))


def families(names: list[str]) -> dict[str, list[str]]:
    """Feature columns of each family, by suffix; one that fits none raises."""
    out = {g: [c for c in names if any(c == s or c.endswith("_" + s) for s in suffixes)] for g, suffixes in FAMILIES.items()}
    if left := sorted(set(names) - {c for v in out.values() for c in v}):
        raise ValueError(f"columns of no family: {left}")
    return out


def model_dimension(spark) -> DataFrame:
    """(name, short, rank): long and short names both lead to a row."""
    rows = [(alias, short, k) for k, (name, short) in enumerate(MODELS) for alias in dict.fromkeys((name, short))]
    return spark.createDataFrame(rows, "name string, short string, rank int")


def normalised_models(df: DataFrame, column: str = "model") -> DataFrame:
    """Short model names and their rank. The dimension has a fixed number of rows, so it is broadcast. An unknown name raises."""
    dim = F.broadcast(model_dimension(df.sparkSession))
    j = df.join(dim, df[column] == dim["name"], "left")
    short = F.when(F.col("short").isNotNull(), F.col("short")).otherwise(F.raise_error(F.concat(F.lit("unknown model: "), F.col(column))))
    return j.withColumn(column, short).drop("name", "short")


def problems(table: DataFrame, expected_rows: int | None = None) -> DataFrame:
    """(check, ok) of a feature table: its size, one label per record, labels 0 or 1."""
    per = table.groupBy("record").agg(F.count_distinct("label").alias("n"))
    size = table.agg(F.count("*").alias("v")).select(F.lit("row_count").alias("check"), (F.col("v") == F.lit(expected_rows)).alias("ok") if expected_rows is not None else F.lit(True).alias("ok"))
    one = per.agg(F.coalesce(F.max("n"), F.lit(0)).alias("v")).select(F.lit("one_label_per_record").alias("check"), (F.col("v") <= 1).alias("ok"))
    known = table.agg(F.count_if(~F.col("label").isin(0, 1)).alias("v")).select(F.lit("labels_known").alias("check"), (F.col("v") == 0).alias("ok"))
    return size.union(one).union(known)
