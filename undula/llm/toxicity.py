"""Toxicity scores by a factorization machine over hashed terms.

Every term of a text (words, and the beginnings of longer ones) is hashed into one of BUCKETS buckets, all of which the machine
weighs: none is picked or left out. Of every pair of a text's buckets the machine adds the inner product of their factors, so
that two terms can tell what neither tells alone. It is trained in epochs: each partition of the fitting rows runs adaptive
gradient steps from the same parameters, and the parameters that partitions come to are averaged for the next epoch. Buckets
weigh by how many fitting texts have them: little where that is few, and, in the second of two runs, also where it is most. A
fifth of the fitting rows picks run and epoch and calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.shared import checkpointed, labelled, table
from undula.llm.tokens import tokens

#: Labelled rows that the model is fitted on, on average. Beyond them a sample by a hash of the id is taken.
FIT_ROWS = 40_000
#: Buckets of hashed terms (as bits); bytes of a word's beginning; and partitions that train side by side.
BITS, PREFIX, PARTS = 18, 6, 4
BUCKETS = 1 << BITS
FACTORS, EPOCHS = 8, 6
#: Steps of weights and factors, their shrinkage towards zero, and the factors' spread at the start.
STEP, FACTOR_STEP, SHRINK, FACTOR_SHRINK, START = 0.3, 0.2, 1e-2, 3e-3, 0.1
#: Fitting texts at which a bucket's value is half of what frequent ones have; powers of inverse frequency that are tried.
HALF, POWERS = 20.0, (0, 1)
#: Rows that an epoch takes at least, in more passes over fewer.
EPOCH_ROWS = 4000
TOXIC = 0.5
#: Buckets whose changes are sent in one row, in half precision, so that the driver holds little at once.
SENT = 1 << 14
_U, _F, _SMALL = np.uint64, np.float32, np.float16
_MARK = _U(0x9E3779B97F4A7C15)


def buckets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of a string column, some texts at a time, in order: every word and every longer word's beginning, once a text."""
    for t in tokens(column):
        long = t.hi - t.lo > PREFIX
        rows = np.concatenate((t.rows, t.rows[long])).astype(np.int64)
        names = np.concatenate((t.names(), (t.names(PREFIX) ^ _MARK)[long]))
        both = np.unique(rows << BITS | (names >> _U(64 - BITS)).astype(np.int64))
        yield both >> BITS, both & (BUCKETS - 1)


@dataclass
class Machine:
    """intercept + sum of w x + sum over pairs of <v, v'> x x'; x is a bucket's value over the root of a text's length."""

    value: np.ndarray
    intercept: float
    linear: np.ndarray
    factors: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def x(self, at: np.ndarray) -> np.ndarray:
        u = self.value[at]
        return u / max(1e-9, float((u * u).sum())) ** 0.25

    def raw(self, rows: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
        """Of `count` texts with buckets (row, bucket), rows ascending."""
        out = np.full(count, self.intercept)
        if len(rows):
            first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            u = self.value[at]
            scale = np.maximum(1e-9, np.add.reduceat(u * u, first)) ** 0.25
            x = u / np.repeat(scale, np.diff(np.append(first, len(rows))))
            v = self.factors[at] * x[:, None]
            pairs = 0.5 * (np.add.reduceat(v, first) ** 2 - np.add.reduceat(v * v, first)).sum(1)
            out[rows[first]] += np.add.reduceat(self.linear[at] * x, first) + pairs
        return out

    def score(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -35, 35)))

    def steps(self, texts: list[np.ndarray], labels: np.ndarray, weight: float, pace: float) -> np.ndarray:
        """One pass of adaptive gradient steps; returns the buckets touched. Parameters change in place."""
        g_linear, g_factors, g_one = np.ones(BUCKETS), np.ones_like(self.factors), 1.0
        for at, y in zip(texts, labels, strict=True):
            x = self.x(at)
            w, v = self.linear[at], self.factors[at]
            vx = v * x[:, None]
            total = vx.sum(0)
            z = self.intercept + w @ x + 0.5 * (total @ total - (vx * vx).sum())
            miss = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) * (weight if y else 1.0)
            g = miss * x
            g_linear[at] += g * g
            step = pace * STEP / np.sqrt(g_linear[at])
            self.linear[at] = _towards_zero(w - step * g, step * SHRINK)
            g = miss * x[:, None] * (total - vx)
            g_factors[at] += g * g
            step = pace * FACTOR_STEP / np.sqrt(g_factors[at])
            self.factors[at] = _towards_zero(v - step * g, step * FACTOR_SHRINK)
            g_one += miss * miss
            self.intercept -= pace * STEP * miss / np.sqrt(g_one)
        return np.unique(np.concatenate(texts)) if texts else np.zeros(0, np.int64)


def _spread(rng: np.random.Generator) -> np.ndarray:
    """Factors at the start, drawn some rows at a time."""
    out = np.empty((BUCKETS, FACTORS), _F)
    for block in np.split(out, 16):
        block[:] = rng.normal(size=block.shape) * START
    return out


def _towards_zero(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.maximum(0.0, np.abs(x) - by)


def _calibration(raw: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope of Platt's logistic over raw scores, the shift that puts 0.5 at the cut with fewest mistakes, and the mean loss.

    Labels are a little smoothed, as Platt did. Of equal cuts the middle one is taken.
    """
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    x, w = np.column_stack((raw, np.ones(len(raw)))), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (target - p))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -35, 35))), 1e-12, 1 - 1e-12)
    by = np.argsort(raw, kind="stable")
    missed = np.concatenate(([0.0], np.cumsum(y[by]))) + np.concatenate((np.cumsum((1 - y[by])[::-1])[::-1], [0.0]))
    best = np.flatnonzero(missed == missed.min())
    cuts = np.concatenate(([raw.min() - 1], (raw[by][1:] + raw[by][:-1]) / 2, [raw.max() + 1]))
    return float(w[0]), float(-w[0] * cuts[best[len(best) // 2]]), float(-(target * np.log(p) + (1 - target) * np.log(1 - p)).mean())


def _as_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, label, part) of a batch of (text, label, part)."""
    for b in batches:
        found = [np.zeros(0, np.int32)] * b.num_rows
        for rows, at in buckets(b.column(0)):
            ends = np.flatnonzero(np.append(np.diff(rows), 1)) + 1 if len(rows) else []
            for k, part in zip(rows[np.asarray(ends, int) - 1], np.split(at, ends)[:-1] if len(ends) else [], strict=True):
                found[k] = part.astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), b.column(1), b.column(2)], ["at", "label", "part"])


def fit(known: DataFrame, epochs: int = EPOCHS) -> Machine:
    """A machine fitted on (text, label, part); rows with part = 0 calibrate. What comes to the driver is bounded by BUCKETS and FIT_ROWS."""
    rows = checkpointed(known.select("text", F.col("label").cast("int"), F.col("part").cast("int")).mapInArrow(_as_rows, "at array<int>, label int, part int").repartition(PARTS))
    total, bad = rows.agg(F.count("*"), F.sum("label")).first()
    rng = np.random.default_rng(1)
    machine = Machine(np.zeros(BUCKETS, _F), 0.0, np.zeros(BUCKETS, _F), _spread(rng))
    learn = rows.filter("part > 0")
    n, k = learn.agg(F.count("*"), F.sum("label")).first()
    if not n or not k or k == n:
        share = bad / total if total else 0.5
        machine.factors[:] = 0
        machine.intercept = float(np.clip(np.log((share + 1e-6) / (1 - share + 1e-6)), -6, 6))
        return machine
    seen = learn.select(F.explode("at").alias("at")).groupBy("at").count().toArrow()
    texts = np.zeros(BUCKETS)
    texts[seen.column("at").to_numpy()] = seen.column("count").to_numpy()
    del seen
    weight, passes = float(np.sqrt((n - k) / k)), int(np.clip(-(-EPOCH_ROWS // n), 1, 20))
    machine.intercept = float(np.log(k / (n - k)))
    best, least = machine, np.inf
    for power in POWERS:
        rarity = np.log((n + 1) / (texts + 1)) / np.log(n + 1)
        run = Machine((texts / (texts + min(HALF, n / 20)) * rarity**power).astype(_F), machine.intercept, machine.linear, machine.factors)
        found, loss = _trained(rows, run, epochs, weight, passes)
        if best is machine or loss < least:
            best, least = found, loss
    return best


def _trained(rows: DataFrame, machine: Machine, epochs: int, weight: float, passes: int) -> tuple[Machine, float]:
    """The machine of the epoch with the least loss on the calibrating rows, calibrated; the last one where those don't tell."""
    spark, learn = rows.sparkSession, rows.filter("part > 0")
    best, least = machine, np.inf
    sent = spark.sparkContext.broadcast(machine)  # one machine at a time is out, some 11 MB
    for epoch in range(epochs):

        def train(batches: Iterator[pd.DataFrame], sent=sent, pace=(1 + epoch) ** -0.5) -> Iterator[pd.DataFrame]:
            part = pd.concat([pd.DataFrame({"at": [], "label": []}), *batches], ignore_index=True)
            if len(part):
                own = sent.value
                own = Machine(own.value, own.intercept, own.linear.copy(), own.factors.copy())
                rng = np.random.default_rng(len(part))
                order = np.concatenate([rng.permutation(len(part)) for _ in range(passes)])
                touched = own.steps([np.asarray(part["at"][i], np.int64) for i in order], part["label"].to_numpy(int)[order], weight, pace)
                old = sent.value
                for k, some in enumerate(np.split(touched, np.searchsorted(touched, np.arange(SENT, BUCKETS, SENT)))):
                    linear, factors = own.linear[some] - old.linear[some], own.factors[some] - old.factors[some]
                    yield pd.DataFrame({"at": [some.astype(np.int32).tobytes()], "linear": [linear.astype(_SMALL).tobytes()], "factors": [factors.astype(_SMALL).tobytes()], "intercept": [0.0 if k else own.intercept], "n": [len(part)], "own": [0 if k else len(part)]})

        came = learn.select("at", "label").mapInPandas(train, "at binary, linear binary, factors binary, intercept double, n long, own long").toArrow()
        machine = _averaged(machine, came)
        del came
        sent.destroy()
        sent = spark.sparkContext.broadcast(machine)

        def evaluate(batches: Iterator[pd.DataFrame], now=sent) -> Iterator[pd.DataFrame]:
            for b in batches:
                at = np.concatenate([np.asarray(a, np.int64) for a in b["at"]] or [np.zeros(0, np.int64)])
                yield pd.DataFrame({"raw": now.value.raw(np.repeat(np.arange(len(b)), b["at"].map(len)), at, len(b)), "label": b["label"]})

        check = rows.filter("part = 0").select("at", "label").mapInPandas(evaluate, "raw double, label int").toArrow()
        raw, label = check.column("raw").to_numpy(), check.column("label").to_numpy().astype(float)
        if not 0 < label.sum() < len(label):
            best = machine
            continue
        slope, shift, loss = _calibration(raw, label)
        if loss < least and slope > 0:
            best, least = Machine(machine.value, machine.intercept, machine.linear, machine.factors, slope, shift), loss
    sent.destroy()
    return best, least


def _averaged(machine: Machine, came: pa.Table) -> Machine:
    """The machine with its parameters' changes averaged over the partitions that touched them, each by its rows.

    A partition's changes come as rows of SENT buckets at most, which are added one at a time; the first of them also has its intercept.
    """
    linear, factors, n = np.zeros(BUCKETS, _F), np.zeros(machine.factors.shape, _F), np.zeros(BUCKETS, _F)
    intercept = rows = 0.0
    for b in came.to_batches(1):
        (r,) = b.to_pylist()
        at = np.frombuffer(r["at"], np.int32)
        linear[at] += _F(r["n"]) * np.frombuffer(r["linear"], _SMALL)
        factors[at] += _F(r["n"]) * np.frombuffer(r["factors"], _SMALL).reshape(-1, factors.shape[1])
        n[at] += r["n"]
        intercept, rows = intercept + r["own"] * r["intercept"], rows + r["own"]
    np.maximum(n, 1, out=n)
    linear /= n
    linear += machine.linear
    factors /= n[:, None]
    factors += machine.factors
    return Machine(machine.value, intercept / rows, linear, factors)


def scored(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, toxic: float = TOXIC) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs` (doc_id, text; others are ignored).

    Only ids whose CRC-32 as text isn't divisible by 5 give labels (`labels`: doc_id, toxic); nulls are left out, of several
    labels of an id the largest counts. Null text counts as empty: it has no terms and gets the intercept's score, as any
    text of terms that no fitting row has. A null id is held out. With labels of one kind only, all scores are their share.
    Repeated rows stay and score alike; an empty table gives no rows. Scoring is a map over rows; nothing is shuffled.
    """
    crc = F.crc32(F.col("doc_id").cast("string")) % 5
    known = labelled(labels, "toxic", crc != 0, fit_rows)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select("doc_id", text).join(F.broadcast(known), "doc_id").select("text", "label", F.pmod(F.xxhash64("doc_id"), F.lit(5)).alias("part"))
    sent = docs.sparkSession.sparkContext.broadcast(fit(rows))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        raw = np.full(len(texts), sent.value.intercept)
        for r, at in buckets(pa.array(texts, pa.large_string())):
            if len(r):
                raw[r[0] : r[-1] + 1] = sent.value.raw(r - r[0], at, r[-1] - r[0] + 1)
        return pd.Series(sent.value.score(raw))

    done = docs.select("doc_id", F.coalesce(crc == 0, F.lit(True)).alias("held_out"), score(text).alias("score"))
    return done.withColumn("predicted", (F.col("score") >= toxic).cast("int"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
