"""Cutting recordings into segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.schema import MARKERS


def marker_pairs(annotations: DataFrame, start: str, end: str) -> DataFrame:
    """(record, start_sample, end_sample): an end marker closes the last start; other markers and orphan ends are ignored.

    A start overwrites an open one; a pair of no length is dropped. A window over each record's two markers.
    """
    w = Window.partitionBy("record").orderBy("sample", "seq")
    a = annotations.filter(F.col("note").isin(start, end)).withColumns({"_note": F.lag("note").over(w), "_sample": F.lag("sample").over(w)})
    return a.filter((F.col("note") == end) & (F.col("_note") == start) & (F.col("sample") > F.col("_sample"))).select("record", F.col("_sample").alias("start_sample"), F.col("sample").alias("end_sample"))


def annotated_intervals(annotations: DataFrame) -> DataFrame:
    """Intervals of all kinds; equal ones count once."""
    pairs = [marker_pairs(annotations, *m) for m in MARKERS.values()]
    return pairs[0].union(pairs[1]).distinct()


def lengths(samples: DataFrame) -> DataFrame:
    return samples.groupBy("record").agg(F.count("*").alias("n_samples"))


def fixed_windows(sizes: DataFrame, width: int) -> DataFrame:
    """Windows of `width` samples side by side; an incomplete tail is dropped, a shorter record has none."""
    whole = sizes.filter(F.col("n_samples") >= width)
    return whole.select("record", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_samples") - width, F.lit(width).cast("long"))).alias("start_sample")).withColumn("end_sample", F.col("start_sample") + width)


def numbered(intervals: DataFrame, mode: str, fs: float) -> DataFrame:
    """Segments numbered from 0 in the order of their bounds; empty ones are numbered too, then dropped."""
    w = Window.partitionBy("record").orderBy("start_sample", "end_sample")
    out = intervals.withColumn("segment_id", (F.row_number().over(w) - 1).cast("int")).filter("end_sample > start_sample")
    sec = {k.replace("sample", "sec"): F.col(k).cast("double") / fs for k in ("start_sample", "end_sample")}
    return out.select(F.lit(mode).alias("mode"), "record", "segment_id", "start_sample", "end_sample").withColumns(sec)


def sliced(samples: DataFrame, segments: DataFrame, width: int = 256) -> DataFrame:
    """Samples with the segments [start_sample, end_sample) that hold them; overlapping segments repeat samples.

    Segments stand once in every bin of `width` samples that they touch, and meet the samples of their bins only: both sides are dealt
    out by record and bin, so a long record is spread, and a segment meets fewer than 2 `width` samples that it doesn't hold.
    """
    last = F.floor((F.col("end_sample") - 1) / width)
    bins = segments.filter("end_sample > start_sample").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start_sample") / width), last)))
    met = samples.withColumn("_bin", F.floor(F.col("n") / width)).join(bins, ["record", "_bin"]).drop("_bin")
    return met.filter((F.col("n") >= F.col("start_sample")) & (F.col("n") < F.col("end_sample")))


def fixed_slices(samples: DataFrame, width: int) -> DataFrame:
    """As `sliced` with `fixed_windows`, by arithmetic on the index: no join. Adds segment_id and i, the place in it."""
    w = Window.partitionBy("record")
    whole = samples.withColumn("_size", F.count("*").over(w)).filter(F.col("n") < F.floor(F.col("_size") / width) * width)
    return whole.withColumns({"segment_id": F.floor(F.col("n") / width).cast("int"), "i": (F.col("n") % width).cast("int")}).drop("_size")


def membership(samples: DataFrame, intervals: DataFrame, flag: str) -> DataFrame:
    """`samples` (record, n, ...) with 1 where an interval [start, end) holds the sample, else 0."""
    inside = sliced(samples.select("record", "n"), intervals.select("record", "start_sample", "end_sample")).select("record", "n").distinct().withColumn(flag, F.lit(1))
    return samples.join(inside, ["record", "n"], "left").withColumn(flag, F.coalesce(flag, F.lit(0)))


def boundaries(sizes: DataFrame, width: int, fs: float) -> DataFrame:
    """Instants of fixed boundaries, up to the last sample."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_samples") - 1, F.lit(width).cast("long")))
    return sizes.filter("n_samples > 0").select("record", at.alias("sample")).withColumn("sec", F.col("sample") / fs)


def leaks(train: DataFrame, validation: DataFrame, keys: list[str]) -> DataFrame:
    """Records on both sides of a split; must be empty."""
    return train.select(*keys).distinct().join(validation.select(*keys).distinct(), keys, "left_semi")


def coverage(expected: DataFrame, seen: DataFrame, key: str = "record") -> DataFrame:
    """(key, problem) of keys that are missing, extra or repeated in `seen`."""
    counts = seen.groupBy(key).agg(F.count("*").alias("n"))
    e = expected.select(key).distinct()
    parts = {"missing": e.join(counts, key, "left_anti"), "extra": counts.join(e, key, "left_anti").select(key), "repeated": counts.filter("n > 1").select(key)}
    return parts["missing"].withColumn("problem", F.lit("missing")).unionByName(parts["extra"].withColumn("problem", F.lit("extra"))).unionByName(parts["repeated"].withColumn("problem", F.lit("repeated")))
