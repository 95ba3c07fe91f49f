"""What several operators of this subpackage use."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _shared_folder(df: DataFrame) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    A session on a cluster has to name it in `spark.checkpoint.dir`. One whose tasks all run in the driver's own process
    (master local) shares every folder with itself and uses `spark-checkpoints` below the warehouse where none is named.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or f"{df.sparkSession.conf.get('spark.sql.warehouse.dir')}/spark-checkpoints")
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder, lineage cut."""
    _shared_folder(df)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(labels: DataFrame, column: str, allowed: Column, most: int) -> DataFrame:
    """(doc_id, label) of ids that are allowed to give labels: one row an id, about `most` rows at most.

    The sample is taken by a hash of the id, so it is small enough to be broadcast whatever the table's size.
    """
    known = labels.filter(allowed & F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    share = most / max(most, labels.count())
    return known.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < int(share * 1_000_000))


def written(df: DataFrame) -> DataFrame:
    """As `checkpointed`, but as Parquet: smaller for many narrow rows. Removed when the driver ends."""
    sc = df.sparkSession.sparkContext
    path = f"{_shared_folder(df)}/{uuid.uuid4()}"
    df.write.parquet(path)
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(place)
    return df.sparkSession.read.schema(df.schema).parquet(path)
