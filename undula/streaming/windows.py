"""Energy features of fixed windows while samples arrive, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.schema import EPS


def window_energy(samples: DataFrame, width: int, lateness: str = "1 hour") -> DataFrame:
    """(record, segment_id, DASDV, LOG, MTKE) of complete windows of a stream of (record, n, ts, x), in update mode.

    A window's samples are its state, at most `width` of them; it is emitted when all are there and its state goes when the
    watermark has passed its last sample's period. The values are those of the batch operator.
    """
    period = F.window("ts", "365 days")
    held = samples.withWatermark("ts", lateness).groupBy(period, "record", F.floor(F.col("n") / width).cast("int").alias("segment_id")).agg(F.sort_array(F.collect_set(F.struct("n", "x"))).alias("_s"))
    full = held.filter(F.size("_s") == width).withColumn("v", F.transform("_s", lambda s: s["x"]))
    at = lambda k: F.element_at("v", k)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x) / F.size(a)
    steps, middles = F.sequence(F.lit(2), F.lit(width)), F.sequence(F.lit(2), F.lit(width - 1))
    return full.select(
        "record", "segment_id",
        F.sqrt(mean(F.transform(steps, lambda k: (at(k) - at(k - 1)) * (at(k) - at(k - 1))))).alias("DASDV"),
        F.exp(mean(F.transform("v", lambda x: F.ln(F.abs(x) + EPS)))).alias("LOG"),
        mean(F.transform(middles, lambda k: at(k) * at(k) - at(k - 1) * at(k + 1))).alias("MTKE"),
    )
