"""Features of segments. `keys` name a segment; its samples are rows with their place `i` and value `x`."""

from __future__ import annotations

from functools import reduce
from itertools import product
from math import factorial, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.functions.columns import safe_cv
from undula.schema import EPS, FEATURES, FS, MIN_DISTANCE_SEC, PERM_M, PERM_TAU, REL_HEIGHT, SAMPEN_M, SAMPEN_R, SAMPEN_TAU, SHANNON_BINS, THRESHOLD_K
from undula.sources.sinks import kept


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def gate(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, size, ok): ok if there are five samples or more and all are finite."""
    return samples.groupBy(keys).agg(F.count("*").alias("size"), ((F.count("*") >= 5) & F.bool_and(_finite(F.col("x")))).alias("ok"))


def energy(samples: DataFrame, keys: list[str]) -> DataFrame:
    """DASDV, LOG and MTKE: one window and one aggregate on the same keys, so one shuffle."""
    w = Window.partitionBy(keys).orderBy("i")
    s = samples.select(*keys, "x", F.lag("x").over(w).alias("_p"), F.lead("x").over(w).alias("_q"))
    dasdv = F.coalesce(F.sqrt(F.avg((F.col("x") - F.col("_p")) * (F.col("x") - F.col("_p")))), F.lit(0.0))
    mtke = F.coalesce(F.avg(F.col("x") * F.col("x") - F.col("_p") * F.col("_q")), F.lit(0.0))
    return s.groupBy(keys).agg(dasdv.alias("DASDV"), F.exp(F.avg(F.ln(F.abs("x") + EPS))).alias("LOG"), mtke.alias("MTKE"))


def threshold(samples: DataFrame, keys: list[str], k: float = THRESHOLD_K, mode: str = "abs") -> DataFrame:
    """`samples` with y (magnitude or value) and th = median + k * (median deviation + eps) of the segment."""
    if mode not in ("abs", "pos"):
        raise ValueError(f"unknown peak mode {mode!r}")
    w = Window.partitionBy(keys)
    s = samples.withColumn("y", F.abs("x") if mode == "abs" else F.col("x")).withColumn("_m", F.median("y").over(w))
    return s.withColumn("th", F.col("_m") + k * (F.median(F.abs(F.col("y") - F.col("_m"))).over(w) + EPS)).drop("_m")


def candidates(marked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p, h, th) of local maxima of y: a flat top counts once, in its middle, and edges never do."""
    w = Window.partitionBy(keys).orderBy("i")
    runs = marked.withColumn("_new", F.when(F.lag("y").over(w) == F.col("y"), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    tops = runs.groupBy(*keys, "_run").agg(F.min("i").alias("_l"), F.max("i").alias("_r"), F.first("y").alias("h"), F.first("th").alias("th"))
    r = Window.partitionBy(keys).orderBy("_run")
    top = tops.withColumns({"_b": F.lag("h").over(r), "_a": F.lead("h").over(r)}).filter("_b < h and _a < h")
    return top.select(*keys, F.floor((F.col("_l") + F.col("_r")) / 2).cast("int").alias("p"), "h", "th")


def peaks(marked: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """(keys, p, h) of candidates of at least th, the tallest first, none closer than `distance` samples to a kept one.

    Of equals the later goes first. The greedy choice is a fold over one segment's candidates.
    """
    high = candidates(marked, keys).filter("h >= th")
    ranked = high.groupBy(keys).agg(F.sort_array(F.collect_list(F.struct("h", "p")), asc=False).alias("c"))
    kept = F.aggregate("c", F.array().cast("array<struct<h:double,p:int>>"), lambda a, c: F.when(F.forall(a, lambda k: F.abs(k["p"] - c["p"]) >= distance), F.concat(a, F.array(c))).otherwise(a))
    return ranked.select(*keys, F.inline(kept)).select(*keys, "p", "h")


class _Ranges:
    """Least and greatest values of any range, from tables over ranges of powers of two; nearest places by descent through them."""

    def __init__(self, v: np.ndarray):
        self.n, self.low, self.high = len(v), [v], [v]
        while 2 << (len(self.low) - 1) <= self.n:
            half = 1 << (len(self.low) - 1)
            self.low.append(np.minimum(self.low[-1][:-half], self.low[-1][half:]))
            self.high.append(np.maximum(self.high[-1][:-half], self.high[-1][half:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least value of first ... last, both included."""
        level = np.frexp(last - first + 1)[1] - 1
        out = np.empty(len(first))
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.low[k][first[at]], self.low[k][last[at] - (1 << k) + 1])
        return out

    def nearest(self, start: np.ndarray, side: int, passed) -> np.ndarray:
        """The nearest place beyond `start` on one side that ends the run of places whose ranges are `passed(low, high, which)`; -1 or n if none does."""
        free = start.copy() if side < 0 else start + 1  # the run's open end
        for k in range(len(self.low) - 1, -1, -1):
            size = 1 << k
            which = np.flatnonzero(free >= size if side < 0 else free + size <= self.n)
            at = free[which] - size if side < 0 else free[which]
            which = which[passed(self.low[k][at], self.high[k][at], which)]
            free[which] += side * size
        return free - 1 if side < 0 else free


def _measures(v: np.ndarray, p: np.ndarray, h: np.ndarray, rel_height: float) -> tuple[np.ndarray, np.ndarray]:
    """(prominence, width) of peaks p of height h: N log N for the values and log N for each peak."""
    ranges = _Ranges(v)
    left, right = (ranges.nearest(p, side, lambda low, high, which: high <= h[which]) for side in (-1, 1))
    base = np.maximum(ranges.least(left + 1, p), ranges.least(p, right - 1))
    level = h - (h - base) * rel_height
    ends = []
    for side in (-1, 1):
        k = ranges.nearest(p, side, lambda low, high, which: low > level[which])
        inside = (k >= 0) & (k < ranges.n)
        at = np.where(inside, k, p)
        below, above = v[at], v[np.where(inside, k - side, p)]
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(below < level, (level - below) / (above - below), 0.0)
        ends.append(np.where(inside, k - side * step, np.nan))
    return h - base, ends[1] - ends[0]


def widths(marked: DataFrame, found: DataFrame, keys: list[str], rel_height: float = REL_HEIGHT) -> DataFrame:
    """(keys, p, h, prominence, width): width in samples at `rel_height` of the prominence, crossings interpolated; null if one is missing.

    A segment is one row with its values and its peaks as arrays; values aren't repeated for peaks, nor scanned for each.
    """

    @F.pandas_udf("prominence array<double>, width array<double>")
    def measured(values: pd.Series, places: pd.Series, heights: pd.Series) -> pd.DataFrame:
        rows = [_measures(np.asarray(v, float), np.asarray(p, np.int64), np.asarray(h, float), rel_height) for v, p, h in zip(values, places, heights, strict=True)]
        return pd.DataFrame({"prominence": [a for a, _ in rows], "width": [[None if np.isnan(x) else x for x in w] for _, w in rows]})

    values = marked.groupBy(keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "y"))), lambda s: s["y"]).alias("_v"))
    tops = found.groupBy(keys).agg(F.sort_array(F.collect_list(F.struct("p", "h"))).alias("_t"))
    both = values.join(tops, keys).select(*keys, F.col("_t.p").alias("_p"), F.col("_t.h").alias("_h"), measured("_v", "_t.p", "_t.h").alias("_m"))
    rows = F.arrays_zip(F.col("_p").alias("p"), F.col("_h").alias("h"), F.col("_m.prominence").alias("prominence"), F.col("_m.width").alias("width"))
    return both.select(*keys, F.inline(rows)).toDF(*keys, "p", "h", "prominence", "width")


def bursts(found: DataFrame, keys: list[str], fs: float, tau: float) -> DataFrame:
    """`found` with gap (seconds to the peak before) and burst (from 1): a gap above tau begins a new one."""
    w = Window.partitionBy(keys).orderBy("p")
    gaps = found.withColumn("gap", (F.col("p") - F.lag("p").over(w)) / fs)
    return gaps.withColumn("burst", F.sum(F.when(F.col("gap") > tau, 1).otherwise(0)).over(w) + 1)


def burst_table(marked: DataFrame, found: DataFrame, keys: list[str], fs: float, tau: float) -> DataFrame:
    """Per sample: y, th, is_peak, and the burst that it lies in (0: none)."""
    grouped = bursts(found, keys, fs, tau)
    spans = grouped.groupBy(*keys, "burst").agg(F.min("p").alias("_f"), F.max("p").alias("_l"))
    inside = marked.join(spans, keys).filter("i >= _f and i <= _l").select(*keys, "i", "burst")
    is_peak = found.select(*keys, F.col("p").alias("i"), F.lit(1).alias("is_peak"))
    out = marked.select(*keys, "i", "y", "th").join(is_peak, [*keys, "i"], "left").join(inside, [*keys, "i"], "left")
    return out.withColumns({"is_peak": F.coalesce("is_peak", F.lit(0)), "burst": F.coalesce("burst", F.lit(0).cast("long"))})


def peak_features(marked: DataFrame, keys: list[str], fs: float = FS, tau: float = 2.0, distance: int | None = None, rel_height: float = REL_HEIGHT) -> DataFrame:
    """The eight peak and burst features. Rates are 0 without peaks; descriptors are null where undefined."""
    found = peaks(marked, keys, distance if distance is not None else max(1, round(MIN_DISTANCE_SEC * fs)))
    wide = bursts(widths(marked, found, keys, rel_height), keys, fs, tau)
    per = wide.groupBy(keys).agg(
        F.count("*").alias("_n"), F.avg("h").alias("PEAK_AMP_MEAN"), F.when(F.count("*") >= 2, safe_cv(F.avg("h"), F.stddev_pop("h"))).alias("PEAK_AMP_CV"),
        F.avg("gap").alias("IPI_MEAN"), F.when(F.count("*") >= 3, safe_cv(F.avg("gap"), F.stddev_pop("gap"))).alias("IPI_CV"),
        (F.avg("width") / fs).alias("PW_MEAN"), F.max("burst").alias("_b"),
    )
    sizes = marked.groupBy(keys).agg(F.count("*").alias("_size"))
    duration = F.col("_size") / F.lit(fs + EPS) + EPS
    out = sizes.join(per, keys, "left").withColumns({
        "PEAK_RATE": F.coalesce("_n", F.lit(0)) / duration,
        "BURST_RATE": F.coalesce("_b", F.lit(0)) / duration,
        "PEAKS_PER_BURST_MEAN": F.col("_n") / F.col("_b"),
    })
    return out.select(*keys, *FEATURES[:8])


def delay_embedding(samples: DataFrame, keys: list[str], m: int, tau: int = 1) -> DataFrame:
    """(keys, i, t0 ... ): m values tau apart from every place that has them; none if only one place has."""
    w = Window.partitionBy(keys).orderBy("i")
    cols = {f"t{j}": F.lead("x", j * tau).over(w) for j in range(m)}
    s = samples.withColumns(cols).withColumn("_size", F.count("*").over(Window.partitionBy(keys)))
    reach = (m - 1) * tau
    return s.filter(F.col("i") < F.col("_size") - reach).filter(F.col("_size") - reach > 1).select(*keys, "i", *cols)


def permutation_entropy(samples: DataFrame, keys: list[str], m: int = PERM_M, tau: int = PERM_TAU) -> DataFrame:
    """Entropy of ordinal patterns over ln(m!); ties are ordered by position; 0 with fewer than two patterns' places."""
    e = delay_embedding(samples, keys, m, tau)
    pattern = F.transform(F.array_sort(F.array(*[F.struct(F.col(f"t{j}").alias("x"), F.lit(j).alias("k")) for j in range(m)])), lambda s: s["k"])
    counts = e.select(*keys, F.array_join(pattern, "").alias("q")).groupBy(*keys, "q").agg(F.count("*").alias("c"))
    p = F.col("c") / (F.sum("c").over(Window.partitionBy(keys)) + EPS)
    ent = counts.withColumn("_p", p).groupBy(keys).agg((-F.sum(F.col("_p") * F.ln(F.col("_p") + EPS)) / log(factorial(m))).alias("perm_entropy"))
    return samples.select(keys).distinct().join(ent, keys, "left").withColumn("perm_entropy", F.coalesce("perm_entropy", F.lit(0.0)))


def shannon_entropy(samples: DataFrame, keys: list[str], bins: int = SHANNON_BINS) -> DataFrame:
    """Entropy (nats) of an equal-width histogram over the segment's range; the last bin is closed; null below two samples."""
    w = Window.partitionBy(keys)
    s = samples.select(*keys, "x", F.min("x").over(w).alias("_lo"), F.max("x").over(w).alias("_hi"))
    bin_ = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("x") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins), F.lit(bins - 1))).otherwise(0)
    counts = s.groupBy(*keys, bin_.alias("_bin")).agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(w)
    return counts.withColumn("_p", p).groupBy(keys).agg(F.when(F.sum("c") >= 2, F.abs(-F.sum(F.col("_p") * F.ln("_p")))).alias("SE"))


#: Cells of the grid of sample entropy in one tolerance.
GRID = 8


def template_cells(samples: DataFrame, keys: list[str], m: int = SAMPEN_M, r: float = SAMPEN_R, tau: int = SAMPEN_TAU) -> DataFrame:
    """(keys, c0 .. cm, _tol, t0 .. tm, n): distinct templates of m + 1 values, how often they occur, and their cell in a grid of GRID cells a tolerance."""
    w = Window.partitionBy(keys)
    o = Window.partitionBy(keys).orderBy("i")
    values, cells = [f"t{j}" for j in range(m + 1)], [f"c{j}" for j in range(m + 1)]
    s = samples.withColumns({t: F.lead("x", j * tau).over(o) for j, t in enumerate(values)})
    s = s.withColumns({"_tol": r * F.stddev_pop("x").over(w), "_low": F.min("x").over(w)}).filter(F.col(values[m]).isNotNull() & (F.col("_tol") > 0))
    s = s.withColumns({c: F.floor((F.col(t) - F.col("_low")) / F.col("_tol") * GRID) for c, t in zip(cells, values, strict=True)})
    return s.groupBy(*keys, *cells, "_tol", *values).agg(F.count("*").alias("n"))


def cell_pairs(templates: DataFrame, keys: list[str], m: int = SAMPEN_M) -> DataFrame:
    """(keys, c0 .., d0 .., pairs, first, last) of pairs of cells, a cell with itself included, whose templates may be alike in their first m values.

    `first`: the cells lie so near that all their templates are; `last`: whether the values after these are alike, null if
    the cells don't tell. Cells meet in blocks of the first m coordinates and their neighbours. A cell of margin on either side
    of the tolerance leaves room for rounding.
    """
    cells, others, block = [f"c{j}" for j in range(m + 1)], [f"d{j}" for j in range(m + 1)], [f"_g{j}" for j in range(m)]
    at = {g: F.floor(F.col(f"c{j}") / (GRID + 2)) for j, g in enumerate(block)}
    one = templates.groupBy(*keys, *cells).agg(F.sum("n").alias("n")).withColumns(at)
    around = F.array(*[F.struct(*[(F.col(g) + k).alias(g) for g, k in zip(block, step, strict=True)]) for step in product((-1, 0, 1), repeat=m)])
    two = one.select(*keys, *[F.col(c).alias(d) for c, d in zip(cells, others, strict=True)], F.col("n").alias("_n"), F.inline(around))
    apart = [F.abs(F.col(c) - F.col(d)) for c, d in zip(cells, others, strict=True)]
    met = one.join(two, [*keys, *block]).filter(F.struct(*cells) <= F.struct(*others))
    for a in apart[:m]:
        met = met.filter(a <= GRID + 1)
    pairs = F.when(F.struct(*cells) == F.struct(*others), F.expr("n * (n - 1) div 2")).otherwise(F.col("n") * F.col("_n"))
    last = F.when(apart[m] <= GRID - 2, True).when(apart[m] >= GRID + 2, False)
    return met.select(*keys, *cells, *others, pairs.alias("pairs"), (F.greatest(*apart[:m], F.lit(0)) <= GRID - 2).alias("first"), last.alias("last"))


def compared_templates(templates: DataFrame, met: DataFrame, keys: list[str], m: int = SAMPEN_M) -> DataFrame:
    """(keys, first, pairs, b, a) of pairs of templates in those cells that don't tell: whether m and m + 1 values are alike."""
    cells, others, values = [f"c{j}" for j in range(m + 1)], [f"d{j}" for j in range(m + 1)], [f"t{j}" for j in range(m + 1)]
    unsure = met.filter(~F.col("first") | F.col("last").isNull()).select(*keys, *cells, *others, "first")
    right = templates.select(*keys, *[F.col(c).alias(d) for c, d in zip(cells, others, strict=True)], *[F.col(t).alias(f"_{t}") for t in values], F.col("n").alias("_n"))
    both = unsure.join(templates, [*keys, *cells]).join(right, [*keys, *others])
    alike = [F.abs(F.col(t) - F.col(f"_{t}")) <= F.col("_tol") for t in values]
    b = reduce(lambda x, y: x & y, alike[:m])
    return both.select(*keys, "first", (F.col("n") * F.col("_n")).alias("pairs"), b.alias("b"), (b & alike[m]).alias("a"))


#: Values of a batch whose templates are compared together; samples up to which a segment's templates are compared as one array.
BATCH_VALUES, LONG = 1 << 18, 1 << 15


def segment_values(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v, sd): one row for each segment, with its values by place and their deviation."""
    s = samples.groupBy(keys).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("_s"), F.stddev_pop("x").alias("sd"))
    return s.select(*keys, F.transform("_s", lambda s: s["x"]).alias("v"), "sd")


def _alike(x: np.ndarray, tol: np.ndarray, m: int, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of values: pairs of templates that are alike in m and in m + 1 values; all pairs a certain distance apart at a time. A template whose last value is missing is none."""
    count = x.shape[1] - m * tau
    known = ~np.isnan(x[:, m * tau :])
    whole = known.all()
    b, a = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for d in range(1, count):
        near = np.abs(x[:, d:] - x[:, :-d]) <= tol[:, None]
        first = near[:, : count - d].copy()
        for j in range(1, m):
            first &= near[:, j * tau : j * tau + count - d]
        if not whole:
            first &= known[:, d:] & known[:, : count - d]
        b += first.sum(1)
        first &= near[:, m * tau : m * tau + count - d]
        a += first.sum(1)
    return b, a


def alike_templates(values: str, tol: Column, m: int = SAMPEN_M, tau: int = SAMPEN_TAU) -> Column:
    """(b, a) of segments' values: how many pairs of templates are alike in m and in m + 1 values. Segments of a batch that have one length are compared together."""

    @F.pandas_udf("b long, a long")
    def counted(xs: pd.Series, tols: pd.Series) -> pd.DataFrame:
        t, sizes = tols.to_numpy(float), np.array([0 if x is None else len(x) for x in xs], np.int64)
        out = np.zeros((len(xs), 2), np.int64)
        fit = (t > 0) & (sizes > m * tau)
        for n in np.unique(sizes[fit]):
            same, step = np.flatnonzero(fit & (sizes == n)), max(1, BATCH_VALUES // int(n))
            for k in range(0, len(same), step):
                part = same[k : k + step]
                out[part] = np.column_stack(_alike(np.stack([np.asarray(xs.iloc[i], float) for i in part]), t[part], m, tau))
        return pd.DataFrame(out, columns=["b", "a"])

    return counted(values, tol)


def sample_entropy(samples: DataFrame, keys: list[str], m: int = SAMPEN_M, r: float = SAMPEN_R, tau: int = SAMPEN_TAU) -> DataFrame:
    """(keys, b, a, sampen): -ln(A/B) over unordered pairs of templates within r standard deviations, point by point.

    A segment is one row, whose templates are compared as arrays, nothing is dealt out. Segments of over LONG samples, where there are any,
    are dealt out instead: their templates are counted by cells of a grid over all their values. Pairs of cells that lie wholly within the
    tolerance, or wholly beyond, are counted without looking at a template; templates are compared only where the tolerance cuts through.
    """
    return _entropies(kept(segment_values(samples, keys)), keys, m, r, tau)


def _entropies(values: DataFrame, keys: list[str], m: int, r: float, tau: int) -> DataFrame:
    """`sample_entropy` of a written table of `segment_values`."""
    long = values.filter(F.size("v") > LONG)
    counts = values.filter(F.size("v") <= LONG).select(*keys, alike_templates("v", r * F.col("sd"), m, tau).alias("_c")).select(*keys, "_c.b", "_c.a")
    if not long.isEmpty():
        counts = counts.unionByName(_grid_counts(long.select(*keys, F.posexplode("v").alias("i", "x")), keys, m, r, tau))
    return counts.withColumn("sampen", F.when((F.col("a") > 0) & (F.col("b") > 0), -F.ln(F.col("a") / F.col("b"))))


def _grid_counts(samples: DataFrame, keys: list[str], m: int, r: float, tau: int) -> DataFrame:
    """(keys, b, a) of long segments, by cells of the grid."""
    templates = kept(template_cells(samples, keys, m, r, tau))
    met = cell_pairs(templates, keys, m)
    sure = met.groupBy(keys).agg(F.sum(F.when(F.col("first"), F.col("pairs"))).alias("b"), F.sum(F.when(F.col("first") & F.col("last"), F.col("pairs"))).alias("a"))
    seen = compared_templates(templates, met, keys, m)
    seen = seen.groupBy(keys).agg(F.sum(F.when(~F.col("first") & F.col("b"), F.col("pairs"))).alias("b"), F.sum(F.when(F.col("a"), F.col("pairs"))).alias("a"))
    counts = sure.unionByName(seen).groupBy(keys).agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    return samples.select(keys).distinct().join(counts, keys, "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("b", "a")})


def all_features(samples: DataFrame, keys: list[str], fs: float = FS, tau: float = 2.0, k: float = THRESHOLD_K, bins: int = SHANNON_BINS, r: float = SAMPEN_R, distance: int | None = None) -> DataFrame:
    """The 14 features of every segment, all null where the gate isn't passed.

    Segments are written once, a row each, and every part deals them out alike, so its windows and joins move nothing more. Peaks and bursts,
    the longest part, are written too: what the driver plans and compiles at a time stays small.
    """
    values = kept(segment_values(samples, keys))
    passed = (F.size("v") >= 5) & F.forall("v", _finite)
    rows = values.filter(passed)
    good = rows.repartition(*keys).select(*keys, F.posexplode("v").alias("i", "x"))
    peaked = kept(peak_features(threshold(good, keys, k), keys, fs, tau, distance))
    out = values.select(keys)
    for p in (peaked, energy(good, keys), shannon_entropy(good, keys, bins), permutation_entropy(good, keys), _entropies(rows, keys, SAMPEN_M, r, SAMPEN_TAU).select(*keys, "sampen")):
        out = out.join(p, keys, "left")
    return out.select(*keys, *FEATURES)
