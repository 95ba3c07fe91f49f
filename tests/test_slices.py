"""Slicing by bins: what brute force finds, and rows out of the join that grow with the segments, not with their square."""

import random

from pyspark.sql import functions as F

from undula.operators import segments as G

SAMPLES, SEGMENTS = "record string, n long, x double", "record string, segment_id int, start_sample long, end_sample long"


def test_slices_equal_brute_force(spark):
    rng = random.Random(2)
    samples = [(r, n, float(n)) for r in "abc" for n in range(-20, 300)]
    segments = [(r, k, s, s + rng.choice((0, 1, 7, 8, 40, -3))) for r in "abd" for k, s in enumerate(rng.randrange(-30, 310) for _ in range(40))]
    segments += [("a", 90, 8, 16), ("a", 91, 8, 16), ("a", 92, None, 16), ("a", 93, 3, None)]
    got = G.sliced(spark.createDataFrame(samples, SAMPLES), spark.createDataFrame(segments, SEGMENTS), width=8)
    assert got.columns == ["record", "n", "x", "segment_id", "start_sample", "end_sample"]
    want = [(r, n, x, k, s, e) for r, n, x in samples for q, k, s, e in segments if q == r and s is not None and e is not None and s <= n < e]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert G.sliced(spark.createDataFrame([], SAMPLES), spark.createDataFrame(segments, SEGMENTS)).count() == 0


def test_pairs_that_meet_grow_with_the_segments(spark):
    """One record, segments of 100 samples side by side: the join may make three rows a sample, whatever the number of segments."""
    for count in (40, 400):
        samples = spark.range(count * 100).select(F.lit("r").alias("record"), F.col("id").alias("n"), F.lit(0.0).alias("x"))
        segments = spark.range(count).select(F.lit("r").alias("record"), F.col("id").cast("int").alias("segment_id"), (F.col("id") * 100).alias("start_sample"), (F.col("id") * 100 + 100).alias("end_sample"))
        met = F.count("*").alias("met")
        bins = segments.select("segment_id", F.explode(F.sequence(F.floor(F.col("start_sample") / 64), F.floor((F.col("end_sample") - 1) / 64))).alias("b"))
        pairs = samples.select(F.floor(F.col("n") / 64).alias("b")).join(bins, "b").agg(met).first()["met"]
        assert G.sliced(samples, segments, 64).count() == count * 100 and pairs <= 3 * count * 100
