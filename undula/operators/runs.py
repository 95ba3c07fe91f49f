"""Incremental runs: fingerprints, pending and valid results, idempotent writes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.operators.splits import folds, record_labels
from undula.schema import FOLDS, REPEATS, SEED

RESULTS = "experiment string, model string, repeat int, fold int, record string, label int, score double, fingerprint string"


def table_digest(df: DataFrame) -> DataFrame:
    """One row whose digest doesn't depend on the order of `df`'s rows: counts and sums of row hashes, hashed."""
    row = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.sum(row.cast("decimal(38,0)")).cast("string"), F.bit_xor(row).cast("string")), 256).alias("digest"))


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def tasks(models: DataFrame, repeats: int) -> DataFrame:
    if not 1 <= repeats <= REPEATS:
        raise ValueError(f"repeats must be from 1 to {REPEATS}")
    return models.crossJoin(F.broadcast(models.sparkSession.range(repeats).select(F.col("id").cast("int").alias("repeat"))))


def pending(expected: DataFrame, done: DataFrame) -> DataFrame:
    """Expected tasks without a completed result of the same fingerprint."""
    fine = done.filter("status = 'completed'").select("model", "repeat", "fingerprint").distinct()
    return expected.join(fine, ["model", "repeat", "fingerprint"], "left_anti")


def validity(results: DataFrame, n_folds: int, n_records: int, fingerprint: str) -> DataFrame:
    """(model, repeat, valid) of prediction rows: right fingerprint, all folds, every record once."""
    g = results.groupBy("model", "repeat").agg(F.count_distinct("fold").alias("_f"), F.count_distinct("record").alias("_r"), F.count("*").alias("_n"), F.count_if(F.col("fingerprint") != fingerprint).alias("_x"))
    return g.select("model", "repeat", ((F.col("_f") == n_folds) & (F.col("_r") == n_records) & (F.col("_n") == n_records) & (F.col("_x") == 0)).alias("valid"))


def selected(dimension: DataFrame, names: list[str], column: str = "name") -> DataFrame:
    """Rows of the named members; an unknown name raises."""
    known = {r[0] for r in dimension.select(column).distinct().collect()}
    if missing := [n for n in names if n not in known]:
        raise ValueError(f"unknown: {missing}")
    return dimension.filter(F.col(column).isin(names))


def write_results(results: DataFrame, path: str, keys: tuple[str, ...] = ("experiment", "model", "repeat")) -> None:
    """Replaces only the partitions that `results` has, so a task that runs again leaves one result."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


@dataclass(frozen=True)
class Study:
    """A model, the parameters its results depend on, and `predict(rows, split)`: (repeat, fold, record, label, score) of the split's validation records."""

    model: str
    parameters: str
    predict: Callable[[DataFrame, DataFrame], DataFrame]


def results(spark: SparkSession, path: str) -> DataFrame:
    """The results at `path`; none where nothing has been written."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], RESULTS)
    return spark.read.schema(RESULTS).parquet(path).select([c.split()[0] for c in RESULTS.split(", ")])


def whole(stored: DataFrame, expected: DataFrame, split: DataFrame) -> DataFrame:
    """(model, repeat, fingerprint, status) of tasks; `completed` if their rows are the split's records, each once in its fold with a score, and all have the task's fingerprint."""
    want = split.groupBy("repeat").agg(F.count("*").alias("_want"))
    right = split.select("repeat", "fold", "record", "label", F.lit(True).alias("_right"))
    rows = stored.select("model", "repeat", "fold", "record", "label", "score", F.col("fingerprint").alias("_f")).join(right, ["repeat", "fold", "record", "label"], "left")
    fine = F.col("_right").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score") & (F.col("_f") == F.col("fingerprint"))
    g = rows.join(expected, ["model", "repeat"]).groupBy("model", "repeat", "fingerprint").agg(F.count("*").alias("_n"), F.count_if(fine).alias("_fine"), F.count_distinct("record").alias("_records"))
    ok = (F.col("_n") == F.col("_want")) & (F.col("_fine") == F.col("_want")) & (F.col("_records") == F.col("_want"))
    return g.join(want, "repeat").select("model", "repeat", "fingerprint", F.when(ok, "completed").otherwise("broken").alias("status"))


def resume(rows: DataFrame, features: list[str], studies: list[Study], repeats: int, path: str, experiment: str = "run", k: int = FOLDS, seed: int = SEED, at_a_time: int = REPEATS) -> DataFrame:
    """(model, repeat, fingerprint, fitted): every study's repeats, of which only those without a whole, up-to-date result at `path` are fitted.

    `rows` has record, label and `features`. A task's fingerprint covers the rows, the features, the model with its parameters
    and the folds. `at_a_time` repeats of a model are fitted and written together, so a run that is stopped loses these at
    most; what a stopped write left is found broken and fitted again. Results of other experiments, models and repeats stay.
    A fit whose results aren't whole raises, after all others are written. What comes to the driver is the list of pending tasks.
    """
    spark = rows.sparkSession
    digest = table_digest(rows.select("record", "label", *features)).first()[0]
    split = folds(record_labels(rows), repeats, k, seed)
    models = spark.createDataFrame([(s.model, s.parameters) for s in studies], "model string, parameters string")
    name = fingerprint(F.lit(digest), F.lit(",".join(features)), F.col("model"), F.col("parameters"), F.lit(f"folds={k},seed={seed}"))
    expected = tasks(models, repeats).select("model", "repeat", name.alias("fingerprint"))
    left = lambda: pending(expected, whole(results(spark, path).filter(F.col("experiment") == experiment), expected, split)).collect()
    todo = {(r["model"], r["repeat"]): r["fingerprint"] for r in left()}
    for s in studies:
        mine = sorted(n for model, n in todo if model == s.model)
        for numbers in (mine[i : i + at_a_time] for i in range(0, len(mine), at_a_time)):
            scored = s.predict(rows, split.filter(F.col("repeat").isin(numbers)))
            named = scored.withColumns({"experiment": F.lit(experiment), "model": F.lit(s.model), "fingerprint": F.lit(todo[s.model, numbers[0]])})
            write_results(named.select([F.col(c.split()[0]).cast(c.split()[1]) for c in RESULTS.split(", ")]).repartition("repeat", "fold"), path)
    if todo and (broken := sorted((r["model"], r["repeat"]) for r in left())):
        raise RuntimeError(f"results that aren't whole: {broken}")
    fitted = spark.createDataFrame([(*task, True) for task in todo], "model string, repeat int, fitted boolean")
    return expected.join(fitted, ["model", "repeat"], "left").withColumn("fitted", F.coalesce("fitted", F.lit(False)))
