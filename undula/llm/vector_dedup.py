"""Embedding near-duplicates by product quantisation: inverted lists, residual codes, table distances, exact rerank.

Vectors are normalised, so a cosine of `limit` is a distance of `radius` = sqrt(2 - 2 limit). Every vector has one home list,
that of its nearest coarse centroid, where its residual is kept as sub-space codes with the length of what the codes lose.
It probes the list of every centroid whose bisecting plane with its own is within half the radius. Two vectors within the
radius of each other whose homes differ lie on either side of their homes' plane, so one of them is within half the radius
of it and probes the other's list: the probes are sufficient. In a list, table lookups give the distances of a probe to the coded
vectors; one that exceeds the radius by more than the code's loss can't be a link (triangle inequality). What is left is
compared exactly, and a pair that meets in both lists counts in the smaller one. Nothing is lost on the way, so recall is 1 but for rounding.

The index has the dimensions of the commonest length. Vectors of another length are indexed by their first dimensions, or with
zeros after their last: that brings no two vectors further apart, so all bounds hold. Only vectors of one length meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.components import components
from undula.llm.shared import checkpointed, table

LIMIT = 0.98
#: Vectors that centroids and codes are fitted on; every vector is indexed.
FIT_ROWS = 65_536
#: (FIT_ROWS is about how many vectors fit the index, drawn by a hash of their ids.)
#: Codes of a sub-space, dimensions of one, and most inverted lists: as many as FIT_ROWS can place, reached at a billion vectors.
CODES, SUB, LISTS = 32, 4, FIT_ROWS // 4
#: Vectors of a list, or probes of one, that meet in a task; larger lists are compared in blocks.
BLOCK = 2048
_SLACK = 1e-6


@dataclass
class Index:
    """Coarse centroids (lists x d) and, for each sub-space of residuals, its codes."""

    centroids: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]

    def home(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.centroids.T - 0.5 * (self.centroids**2).sum(1), axis=1)

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and the length of what they lose."""
        codes = np.empty((len(rest), len(self.books)), np.uint8)
        lost = np.zeros(len(rest))
        for k, book in enumerate(self.books):
            part = rest[:, self.cuts[k] : self.cuts[k + 1]]
            codes[:, k] = np.argmax(part @ book.T - 0.5 * (book**2).sum(1), axis=1)
            lost += ((part - book[codes[:, k]]) ** 2).sum(1)
        return codes, np.sqrt(lost)

    def distances(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Of every residual to every coded vector, squared, by summing one table for each sub-space."""
        out = np.zeros((len(rest), len(codes)))
        for k, book in enumerate(self.books):
            part = rest[:, self.cuts[k] : self.cuts[k + 1]]
            lookup = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)
            out += lookup[:, codes[:, k]]
        return np.maximum(out, 0)

    def probes(self, x: np.ndarray, home: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists that can hold something within the radius."""
        c = self.centroids
        length = (c**2).sum(1)
        gain = x @ c.T - 0.5 * length
        own = c[home]
        apart = np.sqrt(np.maximum((own**2).sum(1)[:, None] + length - 2 * own @ c.T, 0))
        near = gain[np.arange(len(x)), home][:, None] - gain <= (radius + _SLACK) * apart + _SLACK
        return np.nonzero(near)


def _cluster(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(3)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = np.argmax(x @ c.T - 0.5 * (c**2).sum(1), axis=1)
        n = np.bincount(at, minlength=len(c))
        sums = np.stack([np.bincount(at, x[:, j], minlength=len(c)) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def build(sample: np.ndarray, lists: int) -> Index:
    centroids = _cluster(sample, lists)
    rest = sample - centroids[np.argmax(sample @ centroids.T - 0.5 * (centroids**2).sum(1), axis=1)]
    cuts = [*range(0, sample.shape[1], SUB), sample.shape[1]]
    return Index(centroids, [_cluster(rest[:, i:j], CODES) for i, j in zip(cuts, cuts[1:], strict=False)], cuts)


def _unit(column: pd.Series) -> np.ndarray:
    """Directions of vectors of one length; scaled by the largest component first, so that no square over- or underflows."""
    x = np.array(column.tolist(), np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _placed(column: pd.Series, d: int) -> np.ndarray:
    """The first d dimensions of the directions of vectors of any length."""
    size = column.map(len).to_numpy()
    out = np.zeros((len(column), d))
    for n in np.unique(size):
        out[size == n, : min(n, d)] = _unit(column[size == n])[:, :d]
    return out


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node that pairs (a, b) of nodes below n reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(index: Index, limit: float, radius: float):
    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Links of the probes to the vectors at home: weights of both sides' links, and a tree that connects what links."""
        at_home, cell = rows["home"].to_numpy(), int(key[2])
        homes, probes = rows[at_home], rows[~at_home]
        none = pd.DataFrame({"rep": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
        if not len(homes) or not len(probes):
            return none
        y, center = _unit(homes["e"]), index.centroids[cell]
        d = len(center)
        ids, probe_ids = homes["rep"].to_numpy(np.int64), probes["rep"].to_numpy(np.int64)
        weight, probe_weight, own = homes["w"].to_numpy(np.int64), probes["w"].to_numpy(np.int64), probes["own"].to_numpy(np.int64)
        codes, lost = index.encode(_placed(homes["e"], d) - center)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(0, len(probes), 512):
            x = _unit(probes["e"].iloc[k : k + 512])
            i, j = np.nonzero(np.sqrt(index.distances(_placed(probes["e"].iloc[k : k + 512], d) - center, codes)) <= radius + lost + _SLACK)
            if 20 * len(i) > len(x) * len(y):
                link = (x @ y.T)[i, j] >= limit
            else:
                link = np.concatenate([np.einsum("nd,nd->n", x[i[s : s + 65536]], y[j[s : s + 65536]]) >= limit for s in range(0, len(i), 65536)] or [np.zeros(0, bool)])
            link &= probe_ids[k + i] != ids[j]
            found.append((k + i[link], j[link]))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        cross = own[i] != cell
        if cross.any():  # whether the vector at home probes the other's list too
            lists = homes["lists"].to_numpy()
            known = np.unique(np.concatenate([a * np.int64(1 << 32) + np.asarray(lists[a], np.int64) for a in np.unique(j[cross])]))
            asked = j * np.int64(1 << 32) + own[i]
            at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
            keep = ~cross | (known[at] != asked) | (cell < own[i])
            i, j, cross = i[keep], j[keep], cross[keep]
        if not len(i):
            return none
        nodes, place = np.unique(np.concatenate((probe_ids[i], ids[j])), return_inverse=True)
        root = nodes[_roots(place[: len(i)], place[len(i) :], len(nodes))]
        n = np.zeros(len(nodes), np.int64)
        np.add.at(n, place[: len(i)], weight[j])
        np.add.at(n, place[len(i) :][cross], probe_weight[i[cross]])
        return pd.DataFrame({"rep": nodes, "n": n, "root": root})

    return compare


def linked(vectors: DataFrame, limit: float = LIMIT, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors` (vec_id, embedding, label; others are ignored).

    Vectors link if their labels are equal and not null and their cosine is `limit` or more. A vector that is null, zero or
    empty or has a null or non-finite component links with nothing, as does a row with a null id or label: no links, its own
    component. Vectors of different lengths don't link. Cosines are those of the vectors scaled by their largest components,
    so components near the limits of doubles are compared like any others. n_links counts other rows, component_id is the
    smallest id that links reach. Equal vectors of a label are compared once. Each list is compared in blocks of bounded size; a block
    returns counts and a tree over what it links, never all pairs. An empty table gives no rows.
    """
    radius = float(np.sqrt(2 - 2 * limit))
    number = kind if (kind := dict(vectors.dtypes)["embedding"]) in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast(number).alias("e"))
    sound = F.size("e").__gt__(0) & ~F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("e", lambda v: v != 0)
    fine = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & sound)
    reps = fine.groupBy("label", "e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"))
    total = reps.count()
    drawn = F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(1_000_000_000)) < int(1_000_000_000 * min(1.0, fit_rows / max(total, 1)))
    sample = reps.filter(drawn).select("rep", "e").toPandas().sort_values("rep", ignore_index=True)
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not total:
        return alone
    if not len(sample):
        sample = reps.select("rep", "e").limit(1).toPandas()
    d = int(sample["e"].map(len).mode()[0])
    index = build(_placed(sample["e"], d), int(np.clip(np.sqrt(total / 4), 4, LISTS)))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 2048):
                part = b.iloc[k : k + 2048]
                x = _placed(part["e"], d)
                home = index.home(x)
                at, lists = index.probes(x, home, radius / 2)
                per = np.split(lists, np.cumsum(np.bincount(at, minlength=len(part)))[:-1])
                kept = part.assign(cell=home, home=True, own=home, lists=pd.Series([v.tolist() for v in per], index=part.index))
                both = pd.concat((kept, part.iloc[at].assign(cell=lists, home=False, own=home[at], lists=None)))
                yield both[["label", "size", "cell", "home", "own", "lists", "rep", "w", "e"]]

    kind = dict(rows.dtypes)["label"]
    cells = reps.withColumn("size", F.size("e")).mapInPandas(placed, f"label {kind}, size int, cell int, home boolean, own int, lists array<int>, rep long, w long, e {number}")
    large = cells.groupBy("label", "size", "cell").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("p")).filter(f"h > {BLOCK} or p > {BLOCK}")
    split = cells.join(large, ["label", "size", "cell"], "left").withColumns({k: F.coalesce(F.ceil(F.col(k) / BLOCK), F.lit(1)).cast("int") for k in ("h", "p")})
    own = F.xxhash64("rep")
    i = F.when(F.col("home"), F.array(F.pmod(own, "h").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("h") - 1))
    j = F.when(F.col("home"), F.sequence(F.lit(0), F.col("p") - 1)).otherwise(F.array(F.pmod(own, "p").cast("int")))
    dealt = split.withColumn("i", F.explode(i)).withColumn("j", F.explode(j)).select("label", "size", "cell", "i", "j", "home", "own", "lists", "rep", "w", "e")
    met = checkpointed(dealt.groupBy("label", "size", "cell", "i", "j").applyInPandas(_compare(index, limit, radius), "rep long, n long, root long"))
    counts = met.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(met.filter("rep <> root"), "rep", "root")
    named = reps.join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("label", "e", "w", "rep", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "rep").alias("root"))
    linked_rows = fine.join(named, ["label", "e"]).select("vec_id", (F.col("n") + F.col("w") - 1).alias("n_links"), F.col("root").alias("component_id"), (F.col("vec_id") == F.col("root")).alias("kept"))
    others = rows.filter(~F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & sound, F.lit(False)))
    return linked_rows.union(others.select("vec_id", F.lit(0).cast("long"), "vec_id", F.lit(True)))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))
