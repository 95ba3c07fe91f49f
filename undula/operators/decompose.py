"""Empirical mode decomposition of segments (Huang et al., 1998)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.functions.columns import mode_number

MODES = 4


#: Values of a batch that are sifted together; it changes no result.
BATCH_VALUES = 1 << 18


def _extrema(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each row has its maxima and its minima; a flat stretch goes on as before."""
    d = np.sign(np.diff(x, axis=1))
    last = np.maximum.accumulate(np.where(d != 0, np.arange(d.shape[1]), 0), axis=1)
    turn = np.diff(np.take_along_axis(d, last, 1), axis=1)
    top, low = np.zeros(x.shape, bool), np.zeros(x.shape, bool)
    top[:, 1:-1], low[:, 1:-1] = turn < 0, turn > 0
    return top, low


def _bends(h: np.ndarray, slope: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Second derivatives at the knots (knots x rows) of natural cubic splines, all rows solved together; 0 beyond a row's knots."""
    m = np.zeros((len(h) + 1, h.shape[1]))
    diagonal, right = 2 * (h[:-1] + h[1:]), 6 * np.diff(slope, axis=0)
    c, r = np.zeros_like(diagonal), np.zeros_like(diagonal)
    for k in range(len(diagonal)):  # Thomas' algorithm, a knot of every row at a time
        inside = k < total - 2
        under = np.where(inside, diagonal[k] - (h[k] * c[k - 1] if k else 0), 1.0)
        c[k] = np.where(inside, h[k + 1] / under, 0.0)
        r[k] = np.where(inside, (right[k] - (h[k] * r[k - 1] if k else 0)) / under, 0.0)
    for k in range(len(diagonal) - 1, -1, -1):
        m[k + 1] = r[k] - c[k] * m[k + 2]
    return m


def _envelopes(x: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Natural cubic splines through each row's marked values, the outer two mirrored at the ends.

    Every row has a mark, none at its ends, so there are three knots or more and they ascend.
    """
    rows, n = x.shape
    count = marks.sum(1)
    edge = np.minimum(count, 2)
    total = count + 2 * edge
    row, col = np.nonzero(marks)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    back = count[row] - 1 - rank
    # beyond a row's knots steps of one follow, which nothing reads
    at = np.tile(np.arange(total.max(), dtype=float)[:, None], rows) + 3 * n
    value = np.zeros(at.shape)
    first, last = rank < edge[row], back < edge[row]
    for place, knot, which in ((edge[row] + rank, col, slice(None)), (edge[row] - 1 - rank, -col, first), ((edge + count)[row] + back, 2 * (n - 1) - col, last)):
        at[place[which], row[which]] = knot[which]
        value[place[which], row[which]] = x[row[which], col[which]]
    h = np.diff(at, axis=0)
    slope = np.diff(value, axis=0) / h
    m = _bends(h, slope, total)
    j = np.clip(edge[:, None] + np.cumsum(marks, axis=1) - 1, 0, (total - 2)[:, None]).T
    of = lambda a, k: np.take_along_axis(a, k, 0)
    d, hh, m0, m1 = np.arange(n)[:, None] - of(at, j), of(h, j), of(m, j), of(m, j + 1)
    b = of(slope, j) - hh * (2 * m0 + m1) / 6
    return (of(value, j) + d * (b + d * (m0 / 2 + d * (m1 - m0) / (6 * hh)))).T


def _oscillates(top: np.ndarray, low: np.ndarray) -> np.ndarray:
    return top.any(1) & low.any(1) & (top.sum(1) + low.sum(1) >= 3)


def decompose_rows(x: np.ndarray, modes: int = MODES, sifts: int = 100, tolerance: float = 0.2) -> tuple[list[list[np.ndarray]], np.ndarray]:
    """(modes of each row, residuals) of signals of one length (rows x samples), as `decompose` gives them one by one."""
    out, rest = [[] for _ in x], x.copy()
    for _ in range(modes):
        live = np.flatnonzero(_oscillates(*_extrema(rest)))
        if not len(live):
            break
        h, going = rest[live], np.arange(len(live))
        for _ in range(sifts):
            part = h[going]
            top, low = _extrema(part)
            fine = _oscillates(top, low)
            going, part = going[fine], part[fine]
            if not len(going):
                break
            mean = (_envelopes(part, top[fine]) + _envelopes(part, low[fine])) / 2
            share = (mean**2).sum(1) / np.maximum((part**2).sum(1), 1e-300)
            h[going] = part - mean
            going = going[share >= tolerance**2 / 10]
        for k, mode in zip(live, h, strict=True):
            out[k].append(mode)
        rest[live] -= h
    return out, rest


def _checked(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float).ravel()
    if len(x) < 5 or not np.isfinite(x).all():
        raise ValueError("a signal of five finite samples or more is needed")
    return x


def decompose(x: np.ndarray, modes: int = MODES, sifts: int = 100, tolerance: float = 0.2) -> tuple[list[np.ndarray], np.ndarray]:
    """(modes, residual): at most `modes` oscillations, none padded; together they are the signal.

    Sifting subtracts the mean of both envelopes until its energy share is below `tolerance` squared over ten, or `sifts`
    times; a signal with fewer than three extrema isn't sifted further. Fewer than five samples or a non-finite one raise.
    """
    out, rest = decompose_rows(_checked(x)[None], modes, sifts, tolerance)
    return out[0], rest[0]


def decomposition(samples: DataFrame, keys: list[str], modes: int = MODES) -> DataFrame:
    """(keys, imfs, residual): arrays of each segment's modes, worked out once for all of them.

    Every segment is one row of a map, so segments run in parallel; those of a batch that have one length are sifted together,
    BATCH_VALUES values at a time. A segment that can't be decomposed raises.
    """

    @F.pandas_udf("imfs array<array<double>>, residual array<double>")
    def split(xs: pd.Series) -> pd.DataFrame:
        rows = [_checked(x) for x in xs]
        sizes, found = np.array([len(x) for x in rows]), [None] * len(rows)
        for n in np.unique(sizes):
            same, step = np.flatnonzero(sizes == n), max(1, BATCH_VALUES // int(n))
            for k in range(0, len(same), step):
                part = same[k : k + step]
                for i, imfs, residual in zip(part, *decompose_rows(np.stack([rows[i] for i in part]), modes), strict=True):
                    found[i] = (imfs, residual)  # arrays: as numbers of Python they would take five times the memory
        return pd.DataFrame(found, columns=["imfs", "residual"])

    values = samples.groupBy(keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("x"))
    return values.select(*keys, split("x").alias("d")).select(*keys, "d.imfs", "d.residual")


def component(decomposed: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, i, x) of the k-th mode; segments that have fewer have no rows, so that their features are missing, not zero."""
    return decomposed.select(*keys, F.posexplode(mode_number("imfs", k)).alias("i", "x"))


def components(decomposed: DataFrame, keys: list[str], modes: int = MODES) -> DataFrame:
    """(keys, component, i, x) of all modes and the residual."""
    names = F.transform(F.sequence(F.lit(1), F.size("imfs")), lambda k: F.concat(F.lit("IMF"), k.cast("string")))
    every = F.when(F.size("imfs") > 0, F.arrays_zip(names.alias("c"), F.col("imfs").alias("v")))
    parts = decomposed.select(*keys, F.inline(every).alias("component", "v")).union(decomposed.select(*keys, F.lit("residual"), "residual"))
    return parts.select(*keys, "component", F.posexplode("v").alias("i", "x"))
