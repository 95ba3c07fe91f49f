"""Linear models of all folds of all repeats in one plan: rows stay once, and a pass over them sums what every group's next step needs.

A group is a (repeat, fold); its training rows are those that the repeat deals to other folds. Rows carry the fold of each repeat as an
array instead of being repeated for every group. A step of all groups is one pass: each partition adds up loss, gradient and curvature
of every group, the sums are combined by group, and the small systems are solved from these. So the number of jobs is that of steps, not of folds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.schema import FOLDS
from undula.sources.sinks import kept


@dataclass
class Folds:
    """Rows (the kept columns, label, x, own) and, by group, the training rows' means, deviations and counts by label."""

    rows: DataFrame
    keep: list[str]
    repeats: int
    k: int
    mean: np.ndarray
    scale: np.ndarray
    count: np.ndarray

    @property
    def groups(self) -> int:
        return self.repeats * self.k

    def weights(self) -> np.ndarray:
        """Balanced weights of both labels by group; 0 where a label is missing."""
        total = self.count.sum(1, keepdims=True)
        return np.divide(total, 2.0 * self.count, out=np.zeros_like(self.count), where=self.count > 0)

    def taught(self) -> np.ndarray:
        """Groups whose training rows have both labels."""
        return (self.count > 0).all(1)


def arrays(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (nulls as NaN), labels and folds by repeat."""
    return np.array(b["x"].tolist(), np.float64).reshape(len(b), -1), b["label"].to_numpy(np.int64), np.array(b["own"].tolist(), np.int64).reshape(len(b), -1)


def trains(own: np.ndarray, k: int) -> np.ndarray:
    """Rows x groups: whether a row trains a group."""
    return (own[:, :, None] != np.arange(k)).reshape(len(own), -1)


def summed(rows: DataFrame, partial: Callable[[pd.DataFrame], np.ndarray], keys: int, width: int) -> np.ndarray:
    """keys x width: `partial` of batches, added up. Partitions hand on one row a key; those of a key are added one by one."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                total = partial(b) if total is None else total + partial(b)
        if total is not None:
            yield pd.DataFrame({"key": np.arange(keys, dtype=np.int32), "value": [r.tobytes() for r in np.ascontiguousarray(total, np.float64)]})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for key, value in zip(b["key"], b["value"], strict=True):
                v = np.frombuffer(value)
                total[key] = total[key] + v if key in total else v
        if total:
            yield pd.DataFrame({"key": list(total), "value": [v.tobytes() for v in total.values()]})

    out = np.zeros((keys, width))
    for r in rows.mapInPandas(parts, "key int, value binary").repartition("key").mapInPandas(added, "key int, value binary").collect():
        out[r["key"]] = np.frombuffer(r["value"])
    return out


def assigned(rows: DataFrame, features: list[str], split: DataFrame, repeats: int, k: int = FOLDS, key: str = "record", keep: tuple[str, ...] = ("segment_id", "record")) -> Folds:
    """`rows` with their folds of `split` (repeat, key, fold), one for each repeat from 0; records that the split leaves out are left out.

    Training means stand in for nulls; a deviation is that of the training rows with these in place. Two passes.
    """
    own = split.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("repeat", "fold"))).alias("own")).select(key, F.transform("own", lambda v: v["fold"]).alias("own"))
    x = F.array(*[F.col(f).cast("double") for f in features]).alias("x")
    data = rows.join(own.filter(F.size("own") == repeats), key).select(*keep, F.col("label").cast("int").alias("label"), x, "own")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    data = kept(data.repartition(cores, *keep) if data.rdd.getNumPartitions() < cores else data)
    d, groups = len(features), repeats * k

    def counts(b: pd.DataFrame) -> np.ndarray:
        x, y, own = arrays(b)
        t = trains(own, k).T.astype(np.float64)
        known = ~np.isnan(x)
        return np.hstack((t @ np.where(known, x, 0), t @ known, t @ np.eye(2)[y]))

    s = summed(data, counts, groups, 2 * d + 2)
    mean, n = s[:, :d] / np.maximum(s[:, d : 2 * d], 1), s[:, 2 * d :]
    centre = mean.mean(0)

    def squares(b: pd.DataFrame) -> np.ndarray:
        x, _, own = arrays(b)
        t = trains(own, k).T.astype(np.float64)
        x = np.nan_to_num(x - centre)
        return np.hstack((t @ x, t @ (x * x)))

    q = summed(data, squares, groups, 2 * d)
    spread = np.maximum(q[:, d:] - q[:, :d] ** 2 / np.maximum(s[:, d : 2 * d], 1), 0) / np.maximum(n.sum(1, keepdims=True), 1)
    spread[spread <= 1e-18 * (1 + mean**2)] = 0
    return Folds(data, list(keep), repeats, k, mean, np.sqrt(spread), n)


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Centred and scaled with a last column of ones; no spread gives 0, a null the mean."""
    z = np.divide(x - mean, scale, out=np.zeros_like(x), where=scale > 0)
    return np.hstack((np.nan_to_num(z), np.ones((len(x), 1))))


def _newton(data: Folds, width: int, penalty: np.ndarray, measure, steps: int = 60, tolerance: float = 1e-9) -> np.ndarray:
    """Groups x width parameters that minimise loss + penalty / 2 w^2. `measure(x, y, group, w)` gives loss, gradient and curvature.

    A group whose objective has risen goes back half of its step, the others take their next one.
    """
    groups, k, taught = data.groups, data.k, data.taught()
    w, best, at, step = np.zeros((groups, width)), np.full(groups, np.inf), np.zeros((groups, width)), np.zeros((groups, width))
    for _ in range(steps):

        def partial(b: pd.DataFrame, w=w) -> np.ndarray:
            x, y, own = arrays(b)
            t, out = trains(own, k), np.zeros((groups, 1 + width + width * width))
            for g in np.flatnonzero(taught):
                rows = t[:, g]
                if rows.any():
                    loss, gradient, curvature = measure(x[rows], y[rows], g, w[g])
                    out[g] = np.concatenate(([loss], gradient, curvature.ravel()))
            return out

        s = summed(data.rows, partial, groups, 1 + width + width * width)
        value = s[:, 0] + 0.5 * (penalty * w * w).sum(1)
        fine = value <= best + 1e-12 * np.abs(np.where(np.isfinite(best), best, 0))
        at[fine], best[fine] = w[fine], value[fine]
        step[~fine] *= 0.5
        gradient = s[fine, 1 : 1 + width] + penalty * w[fine]
        curvature = s[fine, 1 + width :].reshape(-1, width, width) + np.eye(width) * (penalty + 1e-10)
        step[fine] = -np.linalg.solve(curvature, gradient[:, :, None])[:, :, 0]
        if np.abs(step[taught]).max(initial=0) <= tolerance * (1 + np.abs(at[taught]).max(initial=0)):
            break
        w = at + step
    return at


def _logistic(z: np.ndarray, x: np.ndarray, target: np.ndarray, weight: np.ndarray | float) -> tuple[float, np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    h = weight * p * (1 - p)
    return float((weight * (np.logaddexp(0, z) - target * z)).sum()), x.T @ (weight * (p - target)), (x * h[:, None]).T @ x


def logistic(data: Folds, c: float = 0.5) -> np.ndarray:
    """Groups x (features + 1): coefficients on standardised features, intercept last, by iteratively reweighted least squares.

    Minimises w^2 / 2 + c times the loss with balanced weights; the intercept isn't penalised. A group with one label has zeros.
    """
    weights, mean, scale = data.weights(), data.mean, data.scale
    d = mean.shape[1]

    def measure(x, y, g, w):
        x = standard(x, mean[g], scale[g])
        return _logistic(x @ w, x, y, c * weights[g][y])

    return _newton(data, d + 1, np.append(np.ones(d), 0.0), measure)


def support(data: Folds, c: float = 2.0) -> np.ndarray:
    """As `logistic`, for the squared hinge loss: Newton's steps over the rows within the margin."""
    weights, mean, scale = data.weights(), data.mean, data.scale
    d = mean.shape[1]

    def measure(x, y, g, w):
        x, side = standard(x, mean[g], scale[g]), 2.0 * y - 1
        short = np.maximum(1 - side * (x @ w), 0)
        s = c * weights[g][y]
        inside = x[short > 0]
        return float((s * short**2).sum()), x.T @ (-2 * s * side * short), (inside * (2 * s[short > 0])[:, None]).T @ inside

    return _newton(data, d + 1, np.append(np.ones(d), 0.0), measure)


def platt(data: Folds, model: np.ndarray) -> np.ndarray:
    """Groups x 2: slope and shift of Platt's logistic over the training rows' margins, with his smoothed targets."""
    mean, scale, n = data.mean, data.scale, data.count

    def measure(x, y, g, w):
        z = np.column_stack((standard(x, mean[g], scale[g]) @ model[g], np.ones(len(x))))
        return _logistic(z @ w, z, np.where(y > 0, (n[g, 1] + 1) / (n[g, 1] + 2), 1 / (n[g, 0] + 2)), 1.0)

    return _newton(data, 2, np.array([1e-9, 0.0]), measure)


def linear_scores(data: Folds, model: np.ndarray, link: np.ndarray | None = None) -> DataFrame:
    """(kept columns, label, repeat, fold, score) of every validation row: P(label 1), 0 for groups that had one label to learn from."""
    mean, scale, k, keep, taught = data.mean, data.scale, data.k, data.keep, data.taught()

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x, y, own = arrays(b)
            for r in range(own.shape[1]):
                score = np.zeros(len(b))
                for f in range(k):
                    at, g = np.flatnonzero(own[:, r] == f), r * k + f
                    if len(at) and taught[g]:
                        z = standard(x[at], mean[g], scale[g]) @ model[g]
                        z = z if link is None else link[g, 0] * z + link[g, 1]
                        score[at] = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                yield b[[*keep, "label"]].assign(repeat=np.int32(r), fold=own[:, r].astype(np.int32), score=score)

    types = dict(data.rows.dtypes)
    return data.rows.mapInPandas(scored, ", ".join([*[f"{c} {types[c]}" for c in keep], "label int, repeat int, fold int, score double"]))
