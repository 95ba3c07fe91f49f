"""Autocorrelation and spectra."""

from __future__ import annotations

from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.schema import EPS, FS


def autocorrelation(samples: DataFrame, keys: list[str], max_lag: int) -> DataFrame:
    """(keys, lag, r): autocorrelation of the demeaned signal up to `max_lag` samples (at most size - 1), over r[0] + eps.

    A signal of fewer than three samples, with a null or non-finite one, or without spread has lag 0 with value 1 only.
    Each segment is one row with its values as an array: samples are shuffled once, by segment. The sums over all lags come from the
    power of one transform padded by the largest lag (Wiener and Khinchin), segments of one length together.
    """

    @F.pandas_udf("array<double>")
    def sums_of(parts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(parts), index=parts.index, dtype=object)
        known = parts[parts.notna()]
        sizes = known.map(len)
        for n in sizes.unique():
            at, lags = sizes.index[sizes == n], min(max_lag, int(n) - 1) + 1
            padded = 1 << (int(n) + lags - 1).bit_length()
            for k in range(0, len(at), rows := max(1, (1 << 20) // padded)):
                d = np.stack(known[at[k : k + rows]].to_list())
                sums = np.fft.irfft(np.abs(np.fft.rfft(d, padded)) ** 2, padded)[:, :lags]
                out[at[k : k + rows]] = list(sums)
        return out

    finite = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda v: v["x"])
    s = samples.groupBy(keys).agg(ordered.alias("_x"), F.count("*").cast("int").alias("_n"), F.bool_and(finite).alias("_ok"), F.avg("x").alias("_mean"))
    s = s.withColumn("_d", F.when(F.col("_ok"), F.transform("_x", lambda v: v - F.col("_mean"))))
    s = s.withColumn("_flat", ~F.col("_ok") | (F.col("_n") < 3) | (F.array_max(F.transform("_d", F.abs)) <= 1e-8))
    sums = s.select(*keys, sums_of(F.when(~F.col("_flat"), F.col("_d"))).alias("_s"))
    values = F.coalesce(F.transform("_s", lambda v: v / (F.element_at("_s", 1) + EPS)), F.array(F.lit(1.0)))
    return sums.select(*keys, F.posexplode(values).alias("lag", "r"))


def welch_values(x: np.ndarray, fs: float, nperseg: int) -> tuple[np.ndarray, np.ndarray]:
    """Welch's estimate: periodic Hann window, half overlap, mean removed, one-sided density."""
    n = min(nperseg, len(x))
    if n < 8:
        return np.zeros(1), np.full(1, np.nan)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    starts = np.arange(0, len(x) - n + 1, n - n // 2)
    parts = np.stack([x[s : s + n] for s in starts])
    power = np.abs(np.fft.rfft((parts - parts.mean(1, keepdims=True)) * window)) ** 2 / (fs * (window**2).sum())
    power[:, 1 : -1 if n % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(n, 1 / fs), power.mean(0)


def welch(samples: DataFrame, keys: list[str], fs: float = FS, nperseg: int = 1024) -> DataFrame:
    """(keys, freq, psd): one transform per segment, which is all that a task holds at a time; too short: frequency 0, null."""

    @F.pandas_udf("array<struct<freq:double,psd:double>>")
    def spectrum(xs: pd.Series) -> pd.Series:
        out = []
        for x in xs:
            f, p = welch_values(np.asarray(x, float), fs, nperseg)
            out.append([(float(a), None if np.isnan(b) else float(b)) for a, b in zip(f, p, strict=True)])
        return pd.Series(out)

    values = samples.groupBy(keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("x"))
    return values.select(*keys, F.inline(spectrum("x")))


def welch_single(samples: DataFrame, keys: list[str], size: int, fs: float = FS) -> DataFrame:
    """As `welch` for segments of exactly `size` samples in one window, by sums over sines and cosines: no Python.

    Cost grows with size squared, so it serves short segments.
    """
    w = 0.5 - 0.5 * F.cos(2 * pi * F.col("i") / size)
    s = samples.withColumn("_d", (F.col("x") - F.avg("x").over(Window.partitionBy(keys))) * w)
    k = F.explode(F.sequence(F.lit(0), F.lit(size // 2)))
    angle = 2 * pi * F.col("k") * F.col("i") / size
    parts = s.withColumn("k", k).groupBy(*keys, "k").agg(F.sum(F.col("_d") * F.cos(angle)).alias("_re"), F.sum(F.col("_d") * F.sin(angle)).alias("_im"))
    norm = fs * sum((0.5 - 0.5 * np.cos(2 * pi * i / size)) ** 2 for i in range(size))
    twice = F.when((F.col("k") > 0) & (F.col("k") < size / 2), 2.0).otherwise(1.0)
    return parts.select(*keys, (F.col("k") * fs / size).alias("freq"), ((F.col("_re") * F.col("_re") + F.col("_im") * F.col("_im")) / float(norm) * twice).alias("psd"))


def welch_windows(samples: DataFrame, keys: list[str], size: int, fs: float = FS) -> DataFrame:
    """As `welch` for segments of `size` samples or more, by sums over sines and cosines: no Python, any number of windows.

    Every sample goes to the windows that hold it (two at most, of half overlap); a window's mean is taken off, and what is
    left of it is summed by frequency. Cost grows with size a sample, so it serves short windows. Shorter segments give no rows.
    """
    step = size - size // 2
    own = [*keys, "_w"]
    s = samples.withColumn("_size", F.count("*").over(Window.partitionBy(keys))).filter(F.col("_size") >= size)
    last = F.floor((F.col("_size") - size) / step).cast("int")
    from_, to = F.greatest(F.lit(0), F.floor((F.col("i") - size) / step).cast("int") + 1), F.least(last, F.floor(F.col("i") / step).cast("int"))
    s = s.withColumn("_w", F.explode(F.when(from_ <= to, F.sequence(from_, to)))).withColumn("_i", F.col("i") - F.col("_w") * step)
    s = s.withColumn("_d", (F.col("x") - F.avg("x").over(Window.partitionBy(own))) * (0.5 - 0.5 * F.cos(2 * pi * F.col("_i") / size)))
    angle = 2 * pi * F.col("k") * F.col("_i") / size
    parts = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(size // 2))))
    parts = parts.groupBy(*own, "k").agg(F.sum(F.col("_d") * F.cos(angle)).alias("_re"), F.sum(F.col("_d") * F.sin(angle)).alias("_im"))
    norm = fs * sum((0.5 - 0.5 * np.cos(2 * pi * i / size)) ** 2 for i in range(size))
    twice = F.when((F.col("k") > 0) & (F.col("k") < size / 2), 2.0).otherwise(1.0)
    power = (F.col("_re") * F.col("_re") + F.col("_im") * F.col("_im")) / float(norm) * twice
    return parts.groupBy(*keys, "k").agg(F.avg(power).alias("psd")).select(*keys, (F.col("k") * fs / size).alias("freq"), "psd")


def record_spectrum(psd: DataFrame, max_freq: float = 5.0) -> DataFrame:
    """(record, label, freq, psd): the mean over a channel's segments, then over channels; not a flat mean."""
    per = psd.filter(F.col("freq") <= max_freq).groupBy("record", "label", "channel", "freq").agg(F.avg("psd").alias("psd"))
    return per.groupBy("record", "label", "freq").agg(F.avg("psd").alias("psd"))


def class_spectrum(records: DataFrame) -> DataFrame:
    """(freq, term, preterm): mean spectra of both classes side by side."""
    return records.groupBy("freq").pivot("label", [0, 1]).agg(F.avg("psd")).withColumnsRenamed({"0": "term", "1": "preterm"})


def regridded(curve: DataFrame, grid: DataFrame, keys: list[str], x: str = "freq", y: str = "psd") -> DataFrame:
    """(keys, x, y) at the grid's points (keys, x), interpolated linearly; beyond the ends the end values hold."""
    both = curve.select(*keys, x, F.col(y).alias("_y"), F.lit(0).alias("_g")).union(grid.select(*keys, x, F.lit(None).cast("double"), F.lit(1)))
    back = Window.partitionBy(keys).orderBy(x, "_g").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(keys).orderBy(F.desc(x), "_g").rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col("_y").isNotNull(), F.struct(F.col(x).alias("x"), F.col("_y").alias("y")))
    b = both.withColumns({"_b": F.last(known, ignorenulls=True).over(back), "_a": F.last(known, ignorenulls=True).over(ahead)}).filter("_g = 1")
    step = F.nullif(F.col("_a.x") - F.col("_b.x"), F.lit(0.0))
    inside = F.coalesce(F.col("_b.y") + (F.col("_a.y") - F.col("_b.y")) * (F.col(x) - F.col("_b.x")) / step, F.col("_b.y"), F.col("_a.y"))
    return b.select(*keys, x, inside.alias(y))
