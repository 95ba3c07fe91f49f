"""Hard negatives by coordinate pruning in buckets of vector length (after LEMP, Teflioudi et al., 2015).

Vectors are dealt into blocks of about equal length, and every block keeps lists of its directions sorted by coordinate. A query asks
for products of some least score; by the block's longest vector that is a least cosine, and the angle it allows around the query bounds what
each coordinate of a direction can be. The query's largest coordinates are its focus: their feasible ranges, read from the sorted lists,
are intersected, and only what is in all of them is multiplied, in integers. Blocks whose longest vector can't reach the score aren't visited.
A sample of all rows gives each query its first bound: the last of the best that the sample has. Bounds only tell what can't be
in the result, so it is exact. Anchors go to the blocks, in streams; a block never holds more than its rows and a batch of anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undula.llm.shared import table, written

SCALE, EVERY, FLIPPED, CLASSES = 256, 100, 7, 10
#: Positives of an anchor, and negatives of each of them.
BEST = 5
#: Ratio of the lengths of a bucket; rows of a block at least and at most; parts that a table is cut into between these. None changes a result.
RATIO, LEAST, MOST, PARTS = 1.05, 4096, 262_144, 64
#: Focus coordinates of a query, and rows of the sample that gives first bounds.
FOCUS, SEEDS = 4, 2048
_SLACK, _LOW, _HIGH = 1e-9, -(1 << 62), 1 << 62
_KEY = ["size", "bucket", "chunk"]
_ROWS = "size int, bucket int, chunk int, kind int, id long, label long, same boolean, q array<int>, low array<long>, low_id array<long>, high array<long>"


def prepared(vectors: DataFrame) -> DataFrame:
    """(id, label, q, size, norm, bucket, at) of the rows that take part: q is floor(256 x) of every component, `at` tells rows apart.

    Rows with a null id, label or vector, a null or non-finite component, or a q whose squared length is 2^62 or more (so that a product
    might not be a long) take no part. Labels of ids divisible by 7 go one on, modulo 10.
    """
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull())
    rows = rows.filter(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    rows = rows.select("id", "label", F.transform("x", lambda v: F.floor(v * SCALE)).alias("q"))
    square = F.aggregate("q", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    rows = rows.withColumn("norm", F.sqrt(square)).filter(F.col("norm") < 2.0**31)
    label = F.when(F.col("id") % FLIPPED == 0, F.try_add("label", F.lit(1)) % CLASSES).otherwise(F.col("label"))
    bucket = F.when(F.col("norm") < 1, -1).otherwise(F.floor(F.log("norm") / float(np.log(RATIO)))).cast("int")
    q = F.transform("q", lambda v: v.try_cast("int"))
    return rows.select("id", label.alias("label"), q.alias("q"), F.size("q").alias("size"), "norm", bucket.alias("bucket"), F.monotonically_increasing_id().alias("at"))


class Block:
    """Rows of about one length, and their directions' coordinates sorted, list by list as they are asked for."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray):
        self.ids, self.labels, self.q = ids, labels, q
        self.norms = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        self.longest = float(self.norms.max(initial=0))
        self.unit = q / np.maximum(self.norms, 1e-300)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = order, self.unit[order, f]
        return self.lists[f]

    def candidates(self, q: np.ndarray, norm: float, least: int, focus: int = FOCUS) -> np.ndarray | None:
        """Rows whose product with q can be `least`; None: all."""
        if least <= 0:
            return None
        reach = norm * self.longest
        if reach * (1 + _SLACK) < least:
            return np.zeros(0, np.int64)
        spread = np.arccos(min(1.0, least / reach)) + 1e-7
        at = np.argsort(-np.abs(q), kind="stable")[:focus]
        angle = np.arccos(np.clip(q[at] / norm, -1, 1))
        low, high = np.cos(np.minimum(np.pi, angle + spread)) - _SLACK, np.cos(np.maximum(0, angle - spread)) + _SLACK
        ranges = []
        for f, a, b in zip(at.tolist(), low, high, strict=True):
            order, values = self.sorted_list(f)
            ranges.append(order[np.searchsorted(values, a, "left") : np.searchsorted(values, b, "right")])
        shortest = min(range(len(ranges)), key=lambda k: len(ranges[k]))
        rows = ranges[shortest]
        for k, f in enumerate(at):
            if k != shortest and len(rows):
                v = self.unit[rows, f]
                rows = rows[(v >= low[k]) & (v <= high[k])]
        return rows

    def products(self, q: np.ndarray, norm: float, rows: np.ndarray | None) -> np.ndarray:
        """Exact: below 2^53 doubles hold every partial sum, beyond that integers do."""
        some = self.q if rows is None or 2 * len(rows) > len(self.q) else self.q[rows]
        if norm * self.longest < 2.0**52:
            out = (some.astype(np.float64, copy=False) @ q.astype(np.float64)).astype(np.int64)
        else:
            out = some.astype(np.int64) @ q.astype(np.int64)
        return out if rows is None or some is not self.q else out[rows]

    def best(self, q: np.ndarray, own: int, label: int, same: bool, low: np.ndarray, low_id: np.ndarray, high: np.ndarray, count: int) -> list[tuple[int, int, int]]:
        """(target, score, id): for each target the best rows of the same or of other labels, up to its `high` and no worse than (low, low_id)."""
        norm = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
        rows = self.candidates(q, norm, int(low.min()))
        if rows is not None and not len(rows):
            return []
        score = self.products(q, norm, rows)
        ids, labels = (self.ids, self.labels) if rows is None else (self.ids[rows], self.labels[rows])
        fine = (ids != own) & ((labels == label) == same) & (score >= low.min())
        score, ids, out = score[fine], ids[fine], []
        for t in range(len(high)):
            at = np.flatnonzero((score <= high[t]) & ((score > low[t]) | (score == low[t]) & (ids <= low_id[t])))
            if len(at) > count:  # what ties with the last one stays until ids tell
                at = at[score[at] >= np.partition(score[at], len(at) - count)[len(at) - count]]
                at = at[np.lexsort((ids[at], -score[at]))[:count]]
            out += [(int(high[t]), int(score[k]), int(ids[k])) for k in at]
        return out


def _stacked(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def _answers(count: int):
    def answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(anchor_id, high, score, id) of blocks that follow one another, each one's rows before its queries."""
        now, parts, block = None, [], None
        for b in batches:
            if not len(b):
                continue
            key = b[[*_KEY, "kind"]].to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(b)]
            out: list[tuple[int, int, int, int]] = []
            for i, j in zip(cuts, cuts[1:], strict=False):
                part, k = b.iloc[i:j], tuple(key[i, :3])
                if k != now:
                    now, parts, block = k, [], None
                if not key[i, 3]:
                    parts.append((part["id"].to_numpy(np.int64), part["label"].to_numpy(np.int64), _stacked(part["q"])))
                    continue
                if block is None and parts:
                    block, parts = Block(*(np.concatenate(x) for x in zip(*parts, strict=True))), []
                for r in part.itertuples():
                    low, low_id, high = (np.asarray(x, np.int64) for x in (r.low, r.low_id, r.high))
                    out += [(r.id, *x) for x in block.best(np.asarray(r.q), r.id, r.label, r.same, low, low_id, high, count)]
            yield pd.DataFrame(out, columns=["anchor_id", "high", "score", "id"])

    return answers


def _bounded(queries: DataFrame, seeds: list[Block], count: int) -> DataFrame:
    """Queries whose bounds (low, low_id) are raised to the last of the sample's `count` best, where it has so many."""
    sent = queries.sparkSession.sparkContext.broadcast({s.q.shape[1]: s for s in seeds})

    def raised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lows, ids = [], []
            for r in b.itertuples():
                low, low_id, high = (np.array(x, np.int64) for x in (r.low, r.low_id, r.high))
                if (seed := sent.value.get(r.size)) is not None:
                    found = seed.best(np.asarray(r.q), r.id, r.label, r.same, low, low_id, high, count)
                    for t, h in enumerate(high):
                        own = sorted((-s, i) for x, s, i in found if x == h)
                        if len(own) == count:
                            low[t], low_id[t] = -own[-1][0], own[-1][1]
                lows.append(low)
                ids.append(low_id)
            yield b.assign(low=lows, low_id=ids)

    return queries.mapInPandas(raised, queries.schema)


def _searched(rows: DataFrame, blocks: DataFrame, queries: DataFrame, count: int) -> DataFrame:
    """(anchor_id, high, rank, id, score): the best `count` of every query's target. `queries`: id, label, same, q, size, norm, low, low_id, high."""
    none = F.lit(None).cast("array<long>")
    place = F.pmod(F.xxhash64("at"), F.col("chunks")).cast("int")
    given = rows.join(F.broadcast(blocks), ["size", "bucket"]).select("size", "bucket", place.alias("chunk"), F.lit(0).alias("kind"), "id", "label", F.lit(False).alias("same"), "q", none.alias("low"), none.alias("low_id"), none.alias("high"))
    met = queries.join(F.broadcast(blocks), "size").filter(F.col("norm") * F.col("longest") * (1 + 1e-6) >= F.array_min("low"))
    asked = met.withColumn("chunk", F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int")))).select("size", "bucket", "chunk", F.lit(1).alias("kind"), "id", "label", "same", "q", "low", "low_id", "high")
    dealt = given.union(asked).repartition(*_KEY).sortWithinPartitions(*_KEY, "kind")
    found = dealt.mapInPandas(_answers(count), "anchor_id long, high long, score long, id long")
    order = Window.partitionBy("anchor_id", "high").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def mined(vectors: DataFrame, anchors: Column | None = None, best: int = BEST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of `vectors` (vec_id, embedding, label; others are ignored).

    Anchors are the rows that `anchors` tells (of the columns id and label; by default ids divisible by 100). An anchor's positives are its first `best`
    other rows of its label; for each, the first `best` rows of other labels with 80 p <= 100 n <= 100 p are returned, p and n being
    the scores. Only vectors of one length meet. Rows that repeat an id count each, but never with an anchor of that id; an anchor that is given more
    than once is the smallest of its rows. What takes no part is told in `prepared`. No anchor or no partner: no rows.
    """
    rows = written(prepared(vectors))
    total = rows.count()
    size = int(np.clip(total // PARTS, LEAST, MOST))
    blocks = written(rows.groupBy("size", "bucket").agg(F.ceil(F.count("*") / size).alias("chunks"), F.max("norm").alias("longest")))
    share = int(1_000_000 * SEEDS / max(SEEDS, total))
    sample = rows.filter(F.pmod(F.xxhash64("at", F.lit(5)), F.lit(1_000_000)) < share).select("id", "label", "q", "size").toPandas()
    seeds = [Block(s["id"].to_numpy(np.int64), s["label"].to_numpy(np.int64), _stacked(s["q"])) for _, s in sample.groupby("size")]
    is_anchor = F.col("id") % EVERY == 0 if anchors is None else anchors
    first = rows.filter(is_anchor).groupBy("id").agg(F.min(F.struct("label", "size", "q", "norm")).alias("x"))
    first = written(first.select("id", "x.*"))
    one = lambda v: F.array(F.lit(v).cast("long"))
    columns = ["id", "label", "same", "q", "size", "norm", "low", "low_id", "high"]
    queries = first.withColumns({"same": F.lit(True), "low": one(_LOW), "low_id": one(_HIGH), "high": one(_HIGH)}).select(columns)
    found = _searched(rows, blocks, written(_bounded(queries, seeds, best)), best)
    positives = written(found.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    high = F.array_sort(F.collect_set("positive_score")).alias("high")
    targets = positives.filter("positive_score >= 0").groupBy(F.col("anchor_id").alias("id")).agg(high)
    low = F.expr("transform(high, p -> p - p div 5)")  # four fifths, upwards
    queries = first.join(targets, "id").withColumns({"same": F.lit(False), "low": low, "low_id": F.transform("high", lambda p: F.lit(_HIGH))}).select(columns)
    found = _searched(rows, blocks, written(_bounded(queries, seeds, best)), best)
    negatives = found.select("anchor_id", F.col("high").alias("positive_score"), F.col("rank").cast("int"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.join(negatives, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(table(spark, sf_dir, "embeddings"))
