"""Quality scores: document statistics, random Fourier features, ridge by normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.shared import checkpointed, labelled, table

#: Labelled rows that a model is fitted on, on average. Beyond them a sample by a hash of the id is taken.
FIT_ROWS = 100_000
FEATURES, RIDGE, SEED = 256, 1e-3, 7
KEEP = 0.7
_CODES = np.zeros(256, np.int64)  # 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 white space, 5 sentence marks, 6 quotes and the like, 7 beyond ASCII
for _group, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:?", b"'\"()-"), 1):
    _CODES[[*_bytes]] = _group
_CODES[0x80:] = 7
STATISTICS = ("log_bytes", "lower", "upper", "digit", "space", "mark", "quote", "beyond", "bang", "bar", "other", "word_length", "log_line", "distinct", "repeated_next", "repeated_line")


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; all zero for one without a character."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * len(STATISTICS)
    n = len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    groups = np.bincount(_CODES, counts, minlength=8) / n
    bang, bar = counts[0x21] / n, counts[0x7C] / n
    words = data.lower().split()
    lines = [x for x in data.split(b"\n") if x]
    w = max(1, len(words))
    same = sum(map(bytes.__eq__, words, words[1:])) if len(words) > 1 else 0
    return [
        float(np.log1p(n)), *groups[1:8].tolist(), float(bang), float(bar), float(groups[0] - bang - bar),
        float(np.log1p(sum(map(len, words)) / w)), float(np.log1p(n / max(1, len(lines)))),
        len(set(words)) / w, same / w, 1 - len(set(lines)) / max(1, len(lines)),
    ]


class FourierFeatures:
    """cos(Wx + b) with Gaussian W: inner products approximate a Gaussian kernel of the standardised statistics."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, count: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.turn = rng.normal(size=(len(mean), count)) / np.sqrt(len(mean))
        self.shift = rng.uniform(0, 2 * np.pi, count)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.sqrt(2 / len(self.shift)) * np.cos(np.clip((x - self.mean) / self.scale, -8, 8) @ self.turn + self.shift)
        return np.column_stack((np.ones(len(z)), z))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(-1, len(STATISTICS))


def fit(rows: DataFrame, ridge: float = RIDGE) -> tuple[FourierFeatures, np.ndarray, np.ndarray, np.ndarray]:
    """Features, ridge weights, and the calibration's boundaries and values, from (x array<double>, label, part).

    Every partition of the fitting rows adds up its normal equations; their sums (one small matrix for each of a bounded
    number of partitions) are solved on the driver. Rows with part = 0 are left out of them and calibrate instead.
    """
    sums = rows.select([f(F.col("x")[k]).alias(f"{f.__name__}{k}") for k in range(len(STATISTICS)) for f in (F.avg, F.stddev_pop)]).first()
    mean = np.array([sums[f"avg{k}"] or 0.0 for k in range(len(STATISTICS))])
    scale = np.array([sums[f"stddev_pop{k}"] or 0.0 for k in range(len(STATISTICS))])
    lift = FourierFeatures(mean, np.where(scale > 1e-9, scale, 1.0))
    size = FEATURES + 1

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right = np.zeros((size, size)), np.zeros(size)
        for b in batches:
            z = lift(_matrix(b["x"]))
            left += z.T @ z
            right += z.T @ b["label"].to_numpy(float)
        yield pd.DataFrame({"e": [np.column_stack((left, right)).tobytes()]})

    parts = rows.filter("part > 0").mapInPandas(equations, "e binary").collect()
    total = sum((np.frombuffer(r["e"]).reshape(size, size + 1) for r in parts), np.zeros((size, size + 1)))
    count = max(1.0, total[0, 0])
    weights = np.linalg.solve(total[:, :-1] + ridge * count * np.diag([1e-9] + [1.0 / size] * FEATURES), total[:, -1])

    @F.pandas_udf("double")
    def raw(x: pd.Series) -> pd.Series:
        return pd.Series(lift(_matrix(x)) @ weights)

    held = rows.filter("part = 0").select(raw("x").alias("raw"), F.col("label").cast("double").alias("label"))
    if held.isEmpty():
        return lift, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0])
    model = IsotonicRegression(featuresCol="v", labelCol="label").fit(VectorAssembler(inputCols=["raw"], outputCol="v").transform(held))
    return lift, weights, model.boundaries.toArray(), model.predictions.toArray()


def scored(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, keep: float = KEEP, carry: tuple[str, ...] = (), unfitted: float = 0.5) -> DataFrame:
    """(doc_id, carry, held_out, score, predicted) for every row of `docs` (doc_id, text; others are ignored).

    Only ids whose CRC-32 as text leaves a remainder other than 2 by 4 give labels (`labels`: doc_id, quality); nulls are
    left out, of several labels of an id the largest counts. The score is the calibrated ridge score, by a hundredth blended
    with the uncalibrated one so that ties keep their order. Null text counts as empty and is scored like any other; a null
    id is held out; without a label every score is `unfitted`. Repeated rows stay; an empty table gives no rows.
    """

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return texts.map(statistics)

    own = checkpointed(docs.select("doc_id", *carry, measured(F.col("text").cast("string")).alias("x")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))
    known = labelled(labels, "quality", F.crc32(F.col("doc_id").cast("string")) % 4 != 2, fit_rows)
    rows = checkpointed(own.join(F.broadcast(known), "doc_id").select("x", "label", F.pmod(F.xxhash64("doc_id"), F.lit(5)).alias("part")).repartition(16))
    if rows.filter("part > 0").isEmpty():
        return own.select("doc_id", *carry, held_out.alias("held_out"), F.lit(unfitted).alias("score"), F.lit(int(keep <= unfitted)).alias("predicted"))
    lift, weights, at, value = fit(rows)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        raw = lift(_matrix(x)) @ weights
        return pd.Series(np.clip(0.99 * np.interp(raw, at, value) + 0.01 * np.clip((raw + 1) / 3, 0, 1), 0, 1))

    done = own.select("doc_id", *carry, held_out.alias("held_out"), score("x").alias("score"))
    return done.withColumn("predicted", (F.col("score") >= keep).cast("int"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
