"""Writing feature, result and curve tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession) -> str:
    """A new folder where driver and executors can both write, below the session's checkpoint folder; removed when the driver ends.

    Where none is set, a session whose tasks all run in the driver's process takes its warehouse; one on a cluster has to set it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{shared or spark.conf.get('spark.sql.warehouse.dir')}/tables-{uuid.uuid4()}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def kept(df: DataFrame) -> DataFrame:
    """`df` written once to a work folder and read from there: lineage is cut, and lost executors lose nothing of it."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_features(features: DataFrame, path: str) -> None:
    """One table for all modes and sources, partitioned by them."""
    features.write.mode("overwrite").partitionBy("mode", "feature_source").parquet(path)


def write_experiment(results: DataFrame, path: str) -> None:
    """Detail tables in full precision; only the experiments in `results` are replaced."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("experiment").parquet(path)


def as_text(df: DataFrame, places: int) -> DataFrame:
    """Floating-point columns as text of fixed decimals, for exports that are read by people."""
    return df.select([F.format_string(f"%.{places}f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, places: int | None = None) -> None:
    (as_text(df, places) if places is not None else df).write.mode("overwrite").option("header", True).csv(path)


def publication(tables: dict[str, DataFrame | None]) -> DataFrame:
    """Model and mean columns of every experiment's summary, one below the other; a missing table raises."""
    if missing := sorted(k for k, v in tables.items() if v is None):
        raise FileNotFoundError(f"missing: {missing}")
    out = None
    for name, t in tables.items():
        part = t.select(F.lit(name).alias("experiment"), "model", *[c for c in t.columns if c.endswith("_mean")])
        out = part if out is None else out.unionByName(part)
    return out
