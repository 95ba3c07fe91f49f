"""Reading recordings, samples, annotations and feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undula.functions.columns import number


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def header_comments(lines: DataFrame, key: str, line: str, order: str) -> DataFrame:
    """(key, comments map) of header lines: `#` lines, key and value split at the first white space, the last of a key wins.

    Blank lines, `comments:` markers and lines of one word are left out.
    """
    clean = F.trim(F.translate(line, "\t", " "))
    parts = lines.filter(F.trim(line).startswith("#")).select(key, order, F.trim(F.regexp_replace(clean, "^#+", "")).alias("_text")).filter("_text <> '' and lower(_text) not like 'comments:%'")
    kv = parts.select(key, order, F.regexp_extract("_text", r"^(\S+)\s+(.*)$", 1).alias("_k"), F.trim(F.regexp_extract("_text", r"^(\S+)\s+(.*)$", 2)).alias("_v")).filter("_k <> '' and _v <> ''")
    return kv.groupBy(key, "_k").agg(F.max_by("_v", order).alias("_v")).groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_k", "_v")))).alias("comments"))


def header_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(record, comments) of header files; a pattern without files raises, as any missing path does."""
    files = spark.read.text(pattern, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*)\.hea$", 1).alias("record"), "value")
    return header_comments(files.select("record", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line")), "record", "line", "pos")


def selected_channels(samples: DataFrame, channels: list[str]) -> DataFrame:
    """The filter reaches a Parquet scan."""
    return samples.filter(F.col("channel").isin(channels))


def rate_mismatches(recordings: DataFrame, fs: float, tolerance: float = 1e-6) -> DataFrame:
    return recordings.agg(F.count_if(F.abs(F.col("fs") - fs) > tolerance).alias("mismatches"), F.count("*").alias("recordings"))


def cohort(recordings: DataFrame) -> DataFrame:
    return recordings.filter(F.col("label").isin(0, 1))


def key_column(df: DataFrame) -> str:
    """`record`, or else the older `name`."""
    for c in ("record", "name"):
        if c in df.columns:
            return c
    raise ValueError("the table has neither a record nor a name column")


def with_record(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed(key_column(df), "record")


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def feature_table(spark: SparkSession, path: str, schema: str | None = None, header: bool = True) -> DataFrame:
    """A feature table from Parquet, or from CSV with a given schema (all strings without one: no inference pass)."""
    if path.endswith(".csv"):
        reader = spark.read.option("header", header)
        return (reader.schema(schema) if schema else reader).csv(path)
    return spark.read.parquet(path)


# The shared test tables as recordings: rules are in FIXTURES.md.


def sample_index() -> Column:
    return F.row_number().over(Window.partitionBy("record").orderBy("ts", "event_id")).cast("long") - 1


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record, n, x, x2, note, seq): two channels and a marker for every sample."""
    e = read(spark, sf_dir, "events").withColumn("record", F.col("user_id").cast("string"))
    note = F.create_map(*[F.lit(v) for kv in {"signup": "BC", "purchase": "EC", "view": "BD", "error": "ED"}.items() for v in kv])[F.col("event_type")]
    return e.select("record", sample_index().alias("n"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("x2"), note.alias("note"), F.col("event_id").alias("seq"))


def long_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_samples(spark, sf_dir)
    return s.select("record", "n", F.stack(F.lit(2), F.lit("ch1"), "x", F.lit("ch2"), "x2").alias("channel", "x"))


def event_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_samples(spark, sf_dir).filter("note is not null").select("record", F.col("n").alias("sample"), "seq", "note")


def price_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("record").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = read(spark, sf_dir, "lineitem").withColumn("record", F.col("l_suppkey").cast("string"))  # by which windows and segments deal out too
    return rows.select("record", (F.row_number().over(w).cast("long") - 1).alias("n"), F.col("l_extendedprice").alias("x"))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record, label, fs) from customers: names p_ / t_ / x_ by market segment."""
    c = read(spark, sf_dir, "customer")
    prefix = F.when(F.col("c_mktsegment") == "BUILDING", "p").when(F.col("c_mktsegment") == "MACHINERY", "x").otherwise("t")
    return c.select(F.concat_ws("_", F.lit("rec"), F.concat(prefix, F.col("c_custkey").cast("string"))).alias("record"), F.when(F.col("c_custkey") % 10 == 3, 25.0).otherwise(20.0).alias("fs"), "c_acctbal", "c_custkey")


def ml_features(spark: SparkSession, sf_dir: str, count: int = 4) -> DataFrame:
    """(segment_id, record, label, f1 ...): 26 records, 13 of each label."""
    e = read(spark, sf_dir, "embeddings")
    label = (F.col("label") % 2).cast("int")
    record = F.concat_ws("_", F.when(label == 1, "p").otherwise("t"), (F.col("vec_id") % 13).cast("string"))
    return e.select(F.col("vec_id").alias("segment_id"), record.alias("record"), label.alias("label"), *[number(F.col("embedding")[k]).alias(f"f{k + 1}") for k in range(count)])


def segment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, repeat, fold, record, label, score): scores with many ties for three models and two repeats."""
    e = read(spark, sf_dir, "embeddings")
    label = (F.col("label") % 2).cast("int")
    record = F.concat_ws("_", F.when(label == 1, "p").otherwise("t"), (F.col("vec_id") % 13).cast("string"))
    model = F.element_at(F.array(F.lit("RF"), F.lit("NB"), F.lit("LR")), (F.col("vec_id") % 3 + 1).cast("int"))
    fold = (F.col("vec_id") % 13 % 5).cast("int")
    return e.select(model.alias("model"), (F.floor(F.col("vec_id") / 3) % 2).cast("int").alias("repeat"), fold.alias("fold"), record.alias("record"), label.alias("label"), (F.floor(F.col("embedding")[0].cast("double") * 20 + label) / 20).alias("score"))


def pick_record(recordings: DataFrame, name: str | None = None) -> DataFrame:
    """The named recording; without a name the first preterm one, or else the first. An unknown name raises."""
    if name is None:
        return recordings.orderBy(F.desc(F.col("label") == 1), "record").limit(1)
    found = recordings.filter(F.col("record") == name)
    if found.isEmpty():
        raise ValueError(f"no recording {name!r}")
    return found


def pick_segment(samples: DataFrame, channel: str, segment_id: int) -> DataFrame:
    """Samples of one channel and segment; one that isn't there raises."""
    found = samples.filter((F.col("channel") == channel) & (F.col("segment_id") == segment_id))
    if found.isEmpty():
        raise ValueError(f"no segment {segment_id} of channel {channel!r}")
    return found


def summary_table(spark: SparkSession, path: str) -> DataFrame:
    """A summary with short model names and their rank; an unknown model raises."""
    from undula.operators.assemble import normalised_models

    return normalised_models(required(feature_table(spark, path), ["model"]))


def prediction_table(spark: SparkSession, path: str) -> DataFrame:
    """Predictions with the columns that reports need; a missing one raises."""
    return required(feature_table(spark, path), ["model", "repeat", "record", "label", "score", "prediction"])
