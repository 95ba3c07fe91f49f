"""Trees of all folds at once, grown level by level from histograms.

Rows stay where they are: a pass over them routes every row down every tree whose group it trains, and adds it to the histogram of the open
node it comes to, keyed by (tree, node, feature, bin). Partitions hand on their cells, sparse and combined; cells of a block of nodes
meet in one task, which picks each node's best split. What comes to the driver is the trees, never rows. A level of all trees of all
folds is one job, whatever the number of trees and folds; a decision tree, a forest and a round of boosting differ in what they sum.

Of up to FEW rows (a byte a value) trees instead of rows are dealt over tasks: each has all rows, and grows its share of the trees whole, one by
one; `tree_scores`, `forest_scores` and `boosted_scores` also score there, so that trees don't leave their task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.operators.grouped import Folds, trains
from undula.schema import SEED
from undula.sources.sinks import kept

#: Rows (of WIDE values) up to which trees, not rows, are dealt over tasks.
FEW, WIDE = 1_000_000, 64
#: Bins of a feature; (row, tree) pairs that are routed together; cells of a block of nodes; most cells that a task keeps as one array; rounds of boosting between written scores.
BINS, PAIRS, CELLS, DENSE, EVERY = 64, 2_000_000, 1 << 20, 1 << 22, 10
_NULL, _LEAST = 255, 1e-7
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, 1, 2, 3, 4, 5, 6, 7]))
_U, _TWICE = np.uint64, np.arange(256) * 2


@dataclass
class Binned:
    """Rows (id, the kept columns, label, own, bins, draw) of `folds`, thresholds by feature (x <= threshold goes left), and the bins of the groups' means.

    Of few rows each of `chunks` chunks gets all, and grows its share of the trees alone; of many rows there is one chunk.
    """

    folds: Folds
    rows: DataFrame
    cuts: list[np.ndarray]
    means: np.ndarray
    chunks: int


@dataclass
class Forest:
    """Trees in flat arrays: a node with feature -1 is a leaf, others go to `child`, or the node after it for bins above `cut`."""

    group: np.ndarray
    root: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    value: np.ndarray

    def leaf(self, bins: np.ndarray, means: np.ndarray, row: np.ndarray, tree: np.ndarray) -> np.ndarray:
        """Nodes that rows come to in trees; a null goes where its group's mean would."""
        at = self.root[tree].copy()
        moving = np.flatnonzero(self.feature[at] >= 0)
        while len(moving):
            here = at[moving]
            f = self.feature[here]
            b = bins[row[moving], f]
            if (lost := b == _NULL).any():
                b = np.where(lost, means[self.group[tree[moving]], f], b)
            at[moving] = self.child[here] + (b > self.cut[here])
            moving = moving[self.feature[at[moving]] >= 0]
        return at

    def totals(self, bins: np.ndarray, means: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Sum of the values of all trees of each row's group; trees are ordered by group."""
        out = np.zeros(len(bins))
        for g in np.unique(group):
            lo, hi = np.searchsorted(self.group, [g, g + 1])
            rows = np.flatnonzero(group == g)
            step = max(1, PAIRS // max(1, hi - lo))
            for i in range(0, len(rows) if hi > lo else 0, step):
                some = rows[i : i + step]
                at = self.leaf(bins, means, np.repeat(some, hi - lo), np.tile(np.arange(lo, hi), len(some)))
                out[some] = self.value[at].reshape(len(some), -1).sum(1)
        return out


def binned(folds: Folds, bins: int = BINS, cuts: list[list[float]] | None = None) -> Binned:
    """Thresholds are given, or approximate quantiles of all rows' values (all but the largest distinct ones, where these are few)."""
    d = folds.mean.shape[1]
    if cuts is None:
        share = F.array(*[F.lit(k / bins) for k in range(1, bins)])
        found = folds.rows.agg(*[F.percentile_approx(F.col("x")[k], share, 10_000).alias(f"q{k}") for k in range(d)]).first()
        top = folds.rows.agg(*[F.max(F.col("x")[k]).alias(f"t{k}") for k in range(d)]).first()
        cuts = [[v for v in sorted(set(found[k] or ())) if v < top[k]] for k in range(d)]
    edges = [np.asarray(c, np.float64) for c in cuts]

    rows = folds.rows.select(F.monotonically_increasing_id().alias("id"), *folds.keep, "label", "own", F.xxhash64(*folds.keep).alias("draw"), "x")
    rows = kept(_placed(rows, edges))
    few = folds.rows.count() <= FEW and folds.rows.count() * d <= FEW * WIDE
    return Binned(folds, rows, edges, _bins(folds.mean, edges), max(2, folds.rows.sparkSession.sparkContext.defaultParallelism) if few else 1)


def _placed(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """`rows` with bins, a byte a value, for x."""
    names = [c for c in rows.columns if c != "x"]
    types = dict(rows.dtypes)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.array(b["x"].tolist(), np.float64).reshape(len(b), -1)
                yield b[names].assign(bins=[r.tobytes() for r in _bins(x, edges)])

    return rows.mapInPandas(placed, ", ".join([*[f"{c} {types[c]}" for c in names], "bins binary"]))


def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], axis=1).astype(np.uint8)
    out[np.isnan(x)] = _NULL
    return out


def _codes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def _bag(draw: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """How often rows are drawn for trees: Poisson of mean 1 from a hash of both."""
    h = (draw[:, None].astype(_U) + _U(SEED)) ^ ((tree.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> _U(shift))) * _U(by)
    return np.searchsorted(_POISSON, ((h ^ (h >> _U(31))) >> _U(11)).astype(np.float64) / 2.0**53, "right")


class _Cells:
    """Sums of histogram cells: one array where there are few, else codes and sums that are merged now and then."""

    def __init__(self, size: int, width: int):
        self.dense = np.zeros((size, width)) if size <= DENSE else None
        self.width = width
        self.some: list[tuple[np.ndarray, np.ndarray]] = []
        self.ordered = False

    def add(self, code: np.ndarray, sums: np.ndarray) -> None:
        if self.dense is not None:
            for c in range(sums.shape[1]):
                self.dense[:, c] += np.bincount(code, sums[:, c], len(self.dense))
        else:
            self.some.append((code, sums))
            self.ordered = False
            if sum(len(c) for c, _ in self.some) > 4 * PAIRS:
                self.some = [_merged(self.some)]

    def filled(self) -> tuple[np.ndarray, np.ndarray]:
        if self.dense is None:
            if not self.ordered:  # a single part has unordered and repeated codes too
                self.some = [_merged(self.some) if self.some else (np.zeros(0, np.int64), np.zeros((0, self.width)))]
                self.ordered = True
            return self.some[0]
        code = np.flatnonzero(self.dense.any(1))
        return code, self.dense[code]

    def between(self, lo: int, hi: int) -> np.ndarray:
        if self.dense is not None:
            return self.dense[lo:hi]
        code, sums = self.filled()
        i, j = np.searchsorted(code, [lo, hi])
        out = np.zeros((hi - lo, self.width))
        out[code[i:j] - lo] = sums[i:j]
        return out


def _merged(cells: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, place = np.unique(np.concatenate([c for c, _ in cells]), return_inverse=True)
    value = np.concatenate([v for _, v in cells])
    return code, np.stack([np.bincount(place, value[:, k], len(code)) for k in range(value.shape[1])], axis=1)


def _purity(s: np.ndarray) -> np.ndarray:
    """Sum of squares over the sum of both labels' weights; sums over an axis of two would take most of the time."""
    a, b = s[..., 0], s[..., 1]
    return (a * a + b * b) / np.maximum(a + b, 1e-300)


def _best(h: np.ndarray, kind: str) -> tuple[np.ndarray, ...]:
    """Of histograms (nodes, features, bins, sums): gain, feature, bin, sums of the left side and of the whole of each node's best split."""
    left = np.cumsum(h, axis=2)
    total = left[:, :, -1:, :]
    left, right = left[:, :, :-1], total - left[:, :, :-1]
    if kind == "class":
        filled = (left[..., 0] + left[..., 1] > 1e-12) & (right[..., 0] + right[..., 1] > 1e-9)
        good = _purity
    else:
        good = lambda s: s[..., 1] ** 2 / np.maximum(s[..., 0], 1e-300)
        filled = (left[..., 0] > 0.5) & (right[..., 0] > 0.5)
    gain = np.where(filled, good(left) + good(right) - good(total), -1.0)
    flat = np.round(gain.reshape(len(h), -1), 9)  # sums differ in their last digits by the order of partitions; the first of equal splits is taken
    at = flat.argmax(1)
    f, b = np.divmod(at, h.shape[2] - 1)
    n = np.arange(len(h))
    return flat[n, at], f, b, left[n, f, b], total[n, 0, 0]


class _Whole:
    """All rows of a task, compact, and the training rows of one group at a time; a null's bin is there that of its group's mean."""

    def __init__(self, k: int, means: np.ndarray):
        self.k, self.means, self.taken, self.parts = k, means, -1, []

    def add(self, b: pd.DataFrame) -> None:
        """Rows that train, and rows (group 0 or more) that a score is asked of."""
        asked = b["group"].to_numpy() >= 0
        a, b = b[asked], b[~asked]
        own = np.array(b["own"].tolist(), np.int16).reshape(len(b), len(self.means) // self.k)
        bins = [np.frombuffer(b"".join(r["bins"]), np.uint8).reshape(len(r), self.means.shape[1]) for r in (b, a)]
        self.parts.append((b["id"].to_numpy(np.int64), b["label"].to_numpy(np.uint8), own, b["draw"].to_numpy(np.int64), bins[0], a["id"].to_numpy(np.int64), a["group"].to_numpy(np.int64), bins[1]))

    def close(self) -> _Whole:
        self.id, self.label, self.own, self.draw, self.bins, self.at, self.group, self.asked = (np.concatenate(p) for p in zip(*self.parts, strict=True))
        self.parts = []
        return self

    def take(self, g: int) -> None:
        if self.taken != g:
            rows = np.flatnonzero(self.own[:, g // self.k] != g % self.k)
            self.taken, self.y, self.drawn, self.x = g, self.label[rows].astype(np.int64), self.draw[rows], self._filled(self.bins[rows], g)
            self.columns = np.ascontiguousarray(self.x.T)

    def _filled(self, bins: np.ndarray, g: int) -> np.ndarray:
        return np.where(bins == _NULL, self.means[g], bins) if (bins == _NULL).any() else bins

    def held_out(self, g: int, given: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids and bins of the rows that a group scores."""
        if given:
            rows = np.flatnonzero(self.group == g)
            return self.at[rows], self._filled(self.asked[rows], g)
        rows = np.flatnonzero(self.own[:, g // self.k] == g % self.k)
        return self.id[rows], self._filled(self.bins[rows], g)


def _runs(key: np.ndarray, c: np.ndarray, bins: int, nodes: int, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """As `_best` of one feature and class sums, from each row's cell (node and bin) and label with its count: only cells that rows come to are looked at."""
    packed = np.sort((key * 2 + c[0]) * 16 + c[1])
    times, y, cell = packed & 15, packed >> 4 & 1, packed >> 5
    ends = np.flatnonzero(np.append(cell[1:] != cell[:-1], True))
    run = np.stack((np.cumsum(times * (1 - y)), np.cumsum(times * y)), axis=1)[ends]  # whole numbers, so sums are exact
    node = cell[ends] // bins
    last = np.flatnonzero(np.append(node[1:] != node[:-1], True))
    before = np.zeros((nodes + 1, 2), np.int64)
    before[node[last] + 1] = run[last]
    before = np.maximum.accumulate(before, axis=0)
    left = (run - before[node]) * weights
    total = np.diff(before, axis=0) * weights
    whole = total[node]
    right = whole - left
    gain = np.round(np.where(right[:, 0] + right[:, 1] > 1e-9, _purity(left) + _purity(right) - _purity(whole), -1.0), 9)
    first = np.append(0, last[:-1] + 1)
    top = np.full(nodes, -1.0)
    top[node[last]] = np.maximum.reduceat(gain, first)
    at = np.flatnonzero(gain == top[node])[::-1]
    pick = np.zeros(nodes, np.int64)
    pick[node[at]] = at  # the first of equals stays
    return top, cell[ends][pick] % bins, left[pick], total


@dataclass
class _Grower:
    """What the growing of `group`'s trees needs besides rows; see `grow`."""

    group: np.ndarray
    k: int
    depth: int
    features: int
    bins: int
    bag: bool
    kind: str
    offset: object
    first_tree: int
    weights: np.ndarray
    means: np.ndarray
    taught: np.ndarray

    @property
    def width(self) -> int:
        return 2 if self.kind == "class" else 3

    @property
    def node_cells(self) -> int:
        return self.features * self.bins

    @property
    def per_block(self) -> int:
        return max(1, CELLS // (self.node_cells * self.width))

    def roots(self, trees: np.ndarray) -> tuple[Forest, np.ndarray]:
        """Trees (by their numbers) of one node each, and the nodes that are open."""
        n = len(trees)
        start = Forest(self.group[trees], np.arange(n), np.full(n, -1, np.int16), np.zeros(n, np.uint8), np.zeros(n, np.int64), np.zeros(n))
        return start, np.flatnonzero(self.taught[start.group]) if self.bins > 1 else np.zeros(0, np.int64)

    def drawn(self, count: int, rng: np.random.Generator) -> np.ndarray:
        """Features that open nodes take."""
        d = self.means.shape[1]
        if self.features == d:
            return np.tile(np.arange(d, dtype=np.int16), (count, 1))
        return np.sort(np.argsort(rng.random((count, d)), axis=1)[:, : self.features], axis=1).astype(np.int16)

    def add(self, cells: _Cells, rows: pd.DataFrame, trees: np.ndarray, forest: Forest, slot: np.ndarray, drawn: np.ndarray) -> None:
        """Adds rows to the cells of the open nodes that they come to."""
        step = max(1, PAIRS // max(len(trees), self.node_cells // self.bins * 8))
        for i in range(0, len(rows), step):
            part = rows.iloc[i : i + step]
            own, y, bin_of = np.array(part["own"].tolist(), np.int64).reshape(len(part), -1), part["label"].to_numpy(np.int64), _codes(part["bins"])
            times = trains(own, self.k)[:, forest.group].astype(np.float64)
            if self.bag:
                times *= _bag(part["draw"].to_numpy(), trees + self.first_tree)
            row, tree = np.nonzero(times)
            at = slot[forest.leaf(bin_of, self.means, row, tree)]
            row, tree, at = row[at >= 0], tree[at >= 0], at[at >= 0]
            w, group = times[row, tree], forest.group[tree]
            if self.kind == "class":
                sums = np.zeros((len(at), 2))
                sums[np.arange(len(at)), y[row]] = w * (self.weights[group, y[row]] if self.bag else 1.0)
            else:
                p = 1 / (1 + np.exp(-self.offset(part, bin_of, np.unique(forest.group))[row, group]))
                sums = np.column_stack((w, w * (y[row] - p), w * p * (1 - p)))
            f = drawn[at]
            code = bin_of[row[:, None], f].astype(np.int64)
            if (lost := code == _NULL).any():
                code = np.where(lost, self.means[group[:, None], f], code)
            code += (at[:, None] * self.features + np.arange(self.features)) * self.bins
            cells.add(code.ravel(), np.repeat(sums, self.features, axis=0))

    def picked(self, h: np.ndarray, first: int) -> np.ndarray:
        """One row for each node of a histogram, the first of them open node `first`: its number, gain, feature, bin, sums of the left side and of all."""
        gain, f, cut, left, total = _best(h.reshape(-1, self.features, self.bins, self.width), self.kind)
        return np.column_stack((first + np.arange(len(gain)), gain, f, cut, left, total))

    def split(self, forest: Forest, opened: np.ndarray, drawn: np.ndarray, found: np.ndarray, level: int) -> np.ndarray:
        """Splits the open nodes of a level as `found` (rows of `picked`); returns the nodes that are open then."""
        width, which, total = self.width, found[:, 0].astype(np.int64), found[:, 4 + self.width :]
        if not level:
            forest.value[opened[which]] = _value(total, self.kind)
        split = (found[:, 1] > _LEAST) & (level < self.depth)
        which, left, total = which[split], found[split, 4 : 4 + width], total[split]
        node, n = opened[which], len(forest.feature)
        forest.feature[node] = drawn[which, found[split, 2].astype(np.int64)]
        forest.cut[node] = found[split, 3].astype(np.uint8)
        forest.child[node] = n + 2 * np.arange(len(node))
        sides = np.stack((left, total - left), axis=1).reshape(-1, width)
        more = len(sides)
        forest.feature = np.concatenate((forest.feature, np.full(more, -1, np.int16)))
        forest.cut = np.concatenate((forest.cut, np.zeros(more, np.uint8)))
        forest.child = np.concatenate((forest.child, np.zeros(more, np.int64)))
        forest.value = np.concatenate((forest.value, _value(sides, self.kind)))
        impure = (sides.min(1) > 1e-9) if self.kind == "class" else (sides[:, 0] > 1.5)
        return n + np.flatnonzero(impure) if level + 1 < self.depth else np.zeros(0, np.int64)

    def alone(self, rows: _Whole, tree: int, sums: np.ndarray | None = None) -> tuple[Forest, np.ndarray, np.ndarray]:
        """All levels of a tree over rows that are all here, the training rows it takes, and the nodes that these come to.

        `sums` are residuals and curvatures of the training rows. Where a node takes all features, the histograms of the larger of two sides are
        what their parent's has besides the smaller.
        """
        forest, opened = self.roots(np.array([tree]))
        g = int(self.group[tree])
        rows.take(g)
        here, y, times = np.arange(len(rows.y)), rows.y, np.ones(len(rows.y), np.int64)
        if self.bag:
            times = _bag(rows.drawn, np.array([tree + self.first_tree]))[:, 0]
            here = np.flatnonzero(times)
            times = times.astype(np.int64)
        weights = self.weights[g] if self.bag else np.ones(2)
        came, rng = np.zeros(len(rows.y), np.int64), np.random.default_rng([SEED, tree + self.first_tree])
        taken, everything, before, pairs = here, self.features == self.means.shape[1], None, None
        for level in range(self.depth + 1):
            if not len(opened):
                break
            count = len(opened)
            slot = np.full(len(forest.feature), -1, np.int64)
            slot[opened] = np.arange(count)
            drawn = self.drawn(count, rng)
            at = slot[came[here]]
            here, at = here[at >= 0], at[at >= 0]
            dense = count * self.bins <= max(len(here), 4 * self.bins) or self.kind != "class"
            whole = dense and count * self.node_cells * self.width <= 4 * CELLS
            if whole:
                held = self._halves(rows, here, at, times, sums, before, pairs, slot, count) if before is not None else self._dense(rows, here, at, times, sums, count, range(self.features), drawn)
                before = held if everything else None
                if self.bag:
                    held = held * weights
                found = self.picked(held, 0)
            else:
                before, found = None, np.column_stack((np.arange(count), np.full((count, 3), -1.0), np.zeros((count, 2 * self.width))))
                for f in range(self.features):
                    if dense:
                        h = self._dense(rows, here, at, times, sums, count, [f], drawn)
                        gain, _, cut, left, total = _best(h * weights if self.bag else h, self.kind)
                    else:
                        bin_of = rows.columns[f][here] if everything else rows.x[here, drawn[at, f]]
                        gain, cut, left, total = _runs(at * self.bins + bin_of, (y[here], times[here]), self.bins, count, weights)
                    better = gain > found[:, 1] if f else np.ones(count, bool)
                    found[better, 1:] = np.column_stack((gain, np.full(count, f), cut, left, total))[better]
            parents, n = opened, len(forest.feature)
            opened = self.split(forest, opened, drawn, found, level)
            node = came[here]
            moved = forest.feature[node] >= 0
            here, node = here[moved], node[moved]
            came[here] = forest.child[node] + (rows.x.ravel()[here * rows.x.shape[1] + forest.feature[node]] > forest.cut[node])
            pairs = np.flatnonzero(forest.feature[parents] >= 0), n
        return forest, taken, came

    def _dense(self, rows: _Whole, here: np.ndarray, at: np.ndarray, times: np.ndarray, sums: np.ndarray | None, count: int, features, drawn: np.ndarray | None = None) -> np.ndarray:
        """Histograms (nodes, features, bins, sums) of some features (or drawn ones) of rows at open nodes."""
        size, out = count * self.bins, np.empty((count, len(features), self.bins, self.width))
        every = drawn is None or self.features == self.means.shape[1]
        all_rows = len(here) == len(rows.y)
        base = at * self.bins
        if self.kind == "class":
            base = base * 2 + rows.y[here]
            w = times[here].astype(np.float64) if self.bag else None
        else:
            r, c = (sums[0], sums[1]) if all_rows else (sums[0][here], sums[1][here])
        flat, begins = rows.x.ravel(), here * rows.x.shape[1]
        for k, f in enumerate(features):
            bin_of = (rows.columns[f] if all_rows else rows.columns[f][here]) if every else flat[begins + drawn[:, f].astype(np.int64)[at]]
            if self.kind == "class":
                out[:, k] = np.bincount(base + _TWICE[bin_of], w, 2 * size).reshape(count, self.bins, 2)
            else:
                code = base + bin_of
                for j, w in enumerate((None, r, c)):
                    out[:, k, :, j] = np.bincount(code, w, size).reshape(count, self.bins)
        return out

    def _halves(self, rows: _Whole, here: np.ndarray, at: np.ndarray, times: np.ndarray, sums: np.ndarray | None, before: np.ndarray, pairs: tuple, slot: np.ndarray, count: int) -> np.ndarray:
        """Histograms of open nodes: of each pair of sides the one with fewer rows is counted, the other is the rest of its parent."""
        which, n = pairs
        sizes, slots = np.bincount(at, minlength=count), slot[n : n + 2 * len(which)].reshape(-1, 2)
        both = (slots >= 0).all(1)
        small = np.where(both, np.where(sizes[slots[:, 0]] <= sizes[slots[:, 1]], 0, 1), np.where(slots[:, 0] >= 0, 0, 1))
        counted = slots[np.arange(len(which)), small]
        some = np.flatnonzero(counted >= 0)
        order = np.full(count, -1, np.int64)
        order[counted[some]] = np.arange(len(some))
        mine = order[at]
        own = self._dense(rows, here[mine >= 0], mine[mine >= 0], times, sums, len(some), range(self.features))
        out = np.empty((count, *own.shape[1:]))
        out[counted[some]] = own
        rest = np.flatnonzero(both[some])
        out[slots[some[rest], 1 - small[some[rest]]]] = before[which[some[rest]]] - own[rest]
        return out

    def boosted(self, rows: _Whole, g: int, rounds: int, rate: float, start: float) -> list[Forest]:
        """All rounds of a group over rows that are all here."""
        rows.take(g)
        f, out = np.full(len(rows.y), start), []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            tree, _, came = self.alone(rows, g, np.stack((rows.y - p, p * (1 - p))))
            f += rate * tree.value[came]
            out.append(tree)
        return out


_FIELDS = ["group", "root", "feature", "cut", "child", "value"]


def _dealt(data: Binned, asked: DataFrame | None = None) -> DataFrame:
    """All rows, and those (id, group, bins) that scores are asked of, once in every chunk, a chunk a task."""
    rows = data.rows.select("id", F.lit(-1).alias("group"), "label", "own", "draw", "bins")
    if asked is not None:
        rows = rows.union(asked.select("id", "group", F.lit(0), F.array().cast("array<int>"), F.lit(0).cast("long"), "bins"))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(data.chunks - 1))))
    return rows.repartitionByRange(data.chunks, "chunk")


def _chunks(batches: Iterator[pd.DataFrame], k: int, means: np.ndarray) -> Iterator[tuple[int, _Whole]]:
    """The chunks of a task, usually one."""
    found: dict[int, _Whole] = {}
    for b in batches:
        for c, part in b.groupby("chunk"):
            found.setdefault(int(c), _Whole(k, means)).add(part)
    for c, rows in found.items():
        yield c, rows.close()


def _shares(data: Binned, own: _Grower, rounds: tuple[int, float, np.ndarray] | None = None) -> Forest:
    """The trees of all chunks; `rounds` (number, rate, starts) are of boosting."""
    chunks, k, means, group = data.chunks, data.folds.k, data.means, own.group

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk, rows in _chunks(batches, k, means):
            for t in range(chunk, len(group), chunks):
                f = own.alone(rows, t)[0] if rounds is None else joined(own.boosted(rows, t, rounds[0], rounds[1], rounds[2][t]))
                yield pd.DataFrame({"tree": [t], **{c: [getattr(f, c).tobytes()] for c in _FIELDS}})

    came = _dealt(data).mapInPandas(whole, "tree long, " + ", ".join(f"{c} binary" for c in _FIELDS)).collect()
    types = dict(zip(_FIELDS, ("i8", "i8", "i2", "u1", "i8", "f8"), strict=True))
    some = [Forest(*[np.frombuffer(r[c], t) for c, t in types.items()]) for r in sorted(came, key=lambda r: r["tree"])]
    return joined(some) if some else own.roots(np.arange(len(group)))[0]


def _told(data: Binned, own: _Grower, per: int, rows: DataFrame | None = None, rounds: tuple[int, float, np.ndarray] | None = None) -> DataFrame:
    """As `scored`, of models of `per` trees a group that are grown and used in the same task: a task gives its trees' sums for the rows that their group scores."""
    chunks, k, means, taught, group, given = data.chunks, data.folds.k, data.means, data.folds.taught(), own.group, rows is not None
    if given:
        table = kept(_placed(rows.withColumn("id", F.monotonically_increasing_id()).withColumn("group", (F.col("repeat") * k + F.col("fold")).cast("int")), data.cuts))
        ask = table.select("id", "group", "bins")
    else:
        table, ask = data.rows.select("id", *data.folds.keep, "label", "own"), None

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk, all_rows in _chunks(batches, k, means):
            trees = np.arange(chunk, len(group), chunks)
            for g in np.unique(group[trees]):
                ids, bins = all_rows.held_out(g, given)
                total = np.zeros(len(ids))
                at = np.arange(len(ids))
                for t in trees[group[trees] == g] if taught[g] and len(ids) else []:
                    for f in [own.alone(all_rows, t)[0]] if rounds is None else own.boosted(all_rows, g, rounds[0], rounds[1], rounds[2][g]):
                        total += f.value[f.leaf(bins, means, at, np.zeros(len(ids), np.int64))]
                yield pd.DataFrame({"id": ids, "repeat": np.int32(g // k), "total": total})

    sums = _dealt(data, ask).mapInPandas(whole, "id long, repeat int, total double")
    if per > 1:
        sums = sums.groupBy("id", "repeat").agg(F.sum("total").alias("total"))
    if rounds is None:
        score = F.col("total") / per
    else:
        starts = F.array(*[F.lit(float(v)) for v in rounds[2]])
        known = F.array(*[F.lit(bool(v)) for v in taught])
        g = (F.col("repeat") * k + F.col("fold")).cast("int")
        score = F.when(known[g], 1 / (1 + F.exp(-(starts[g] + rounds[1] * F.col("total"))))).otherwise(0.0)
    if given:
        return table.join(sums.drop("repeat"), "id").select(*[c for c in rows.columns if c != "x"], score.alias("score"))
    both = table.join(sums, "id").withColumn("fold", F.col("own")[F.col("repeat")])
    return both.select(*data.folds.keep, "label", "repeat", "fold", score.alias("score"))


def _grower(data: Binned, group: np.ndarray, depth: int, features: int, bag: bool, kind: str, offset=None, first_tree: int = 0) -> _Grower:
    bins = max([len(c) for c in data.cuts], default=0) + 1
    return _Grower(group, data.folds.k, depth, features, bins, bag, kind, offset, first_tree, data.folds.weights(), data.means, data.folds.taught())


def grow(data: Binned, rows: DataFrame, group: np.ndarray, depth: int, features: int, bag: bool, kind: str, offset=None, first_tree: int = 0) -> Forest:
    """Trees of the given groups, ordered by group. `kind` "class" sums weights by label and splits by Gini impurity, "residual" sums counts, residuals and curvature of the logistic loss.

    A node takes `features` of all features, drawn anew; `bag` draws rows for each tree, with balanced weights. `offset(frame, bins, some)` gives rows x groups
    scores, right for some groups, that residuals are taken from.
    """
    own = _grower(data, group, depth, features, bag, kind, offset, first_tree)
    if data.chunks > 1:
        return _shares(data, own)
    trees, rng = np.arange(len(group)), np.random.default_rng([SEED, first_tree])
    forest, opened = own.roots(trees)
    block_cells = own.per_block * own.node_cells
    for level in range(depth + 1):
        if not len(opened):
            break
        slot = np.full(len(forest.feature), -1, np.int64)
        slot[opened] = np.arange(len(opened))
        drawn, count = own.drawn(len(opened), rng), len(opened)
        sent = rows.sparkSession.sparkContext.broadcast((forest, slot, drawn))

        def parts(batches: Iterator[pd.DataFrame], sent=sent, count=count) -> Iterator[pd.DataFrame]:
            cells = _Cells(count * own.node_cells, own.width)
            for b in batches:
                if len(b):
                    own.add(cells, b, trees, *sent.value)
            code, value = cells.filled()
            cuts = np.flatnonzero(np.diff(code // block_cells)) + 1
            for c, v in zip(np.split(code, cuts), np.split(value, cuts), strict=True):
                if len(c):
                    n = int(c[0] // block_cells)
                    yield pd.DataFrame({"block": [n], "code": [(c - n * block_cells).astype(np.int32).tobytes()], "value": [v.tobytes()]})

        def picked(batches: Iterator[pd.DataFrame], count=count) -> Iterator[pd.DataFrame]:
            blocks: dict[int, np.ndarray] = {}
            for b in batches:
                for n, code, value in zip(b["block"], b["code"], b["value"], strict=True):
                    if n not in blocks:
                        blocks[n] = np.zeros((min(own.per_block, count - n * own.per_block) * own.node_cells, own.width))
                    blocks[n][np.frombuffer(code, np.int32)] += np.frombuffer(value).reshape(-1, own.width)
            for n, h in blocks.items():
                yield pd.DataFrame({"found": [own.picked(h, n * own.per_block).tobytes()]})

        came = rows.mapInPandas(parts, "block int, code binary, value binary").repartition("block").mapInPandas(picked, "found binary").collect()
        sent.destroy()
        found = np.concatenate([np.frombuffer(r["found"]).reshape(-1, 4 + 2 * own.width) for r in came] or [np.zeros((0, 4 + 2 * own.width))])
        opened = own.split(forest, opened, drawn, found[np.argsort(found[:, 0])], level)
    return forest if (np.diff(group) >= 0).all() else joined([forest])


def _value(sums: np.ndarray, kind: str) -> np.ndarray:
    if kind == "class":
        return sums[:, 1] / np.maximum(sums.sum(1), 1e-300)
    return np.clip(sums[:, 1] / np.maximum(sums[:, 2], 1e-12), -1e6, 1e6)


def joined(forests: list[Forest]) -> Forest:
    """One forest of several, its trees ordered by group."""
    nodes = np.cumsum([0, *[len(f.feature) for f in forests]])[:-1]
    group = np.concatenate([f.group for f in forests])
    order = np.argsort(group, kind="stable")
    flat = lambda name: np.concatenate([getattr(f, name) for f in forests])
    child, root = (np.concatenate([getattr(f, name) + n for f, n in zip(forests, nodes, strict=True)]) for name in ("child", "root"))
    return Forest(group[order], root[order], flat("feature"), flat("cut"), child, flat("value"))


def tree(data: Binned, depth: int = 30) -> Forest:
    """A decision tree of every group over all features, without weights."""
    return grow(data, data.rows, np.arange(data.folds.groups), depth, data.folds.mean.shape[1], False, "class")


def forest(data: Binned, trees: int = 500, depth: int = 15, together: int = 8000) -> Forest:
    """`trees` trees of every group over bagged rows with balanced weights; nodes draw the root of the number of features."""
    features = max(1, int(np.sqrt(data.folds.mean.shape[1])))
    group = np.repeat(np.arange(data.folds.groups), trees)
    return joined([grow(data, data.rows, group[i : i + together], depth, features, True, "class", first_tree=i) for i in range(0, len(group), together)])


@dataclass
class Boosted:
    """Starting log odds by group, the step size, trees of all rounds, and the mean training loss by round and group."""

    start: np.ndarray
    rate: float
    trees: Forest


def _starts(folds: Folds) -> np.ndarray:
    n = folds.count
    return np.where(folds.taught(), np.log(np.maximum(n[:, 1], 1e-9) / np.maximum(n[:, 0], 1e-9)), 0.0)


def boosted(data: Binned, rounds: int = 100, depth: int = 3, rate: float = 0.1) -> Boosted:
    """Gradient boosting of every group on the logistic loss. Scores are a column that is written every few rounds; later rounds' trees are added in the tasks."""
    folds = data.folds
    start = _starts(folds)
    if data.chunks > 1:
        own = _grower(data, np.arange(folds.groups), depth, folds.mean.shape[1], False, "residual")
        return Boosted(start, rate, _shares(data, own, (rounds, rate, start)))
    rows, recent, done = data.rows.withColumn("f", F.lit(None).cast("array<double>")), [], []
    means, groups = data.means, np.arange(folds.groups)

    def add(trees: list[Forest]):
        def scores(part: pd.DataFrame, bins: np.ndarray, some: np.ndarray) -> np.ndarray:
            out = np.tile(start, (len(part), 1)) if part["f"].iloc[0] is None else np.array(part["f"].tolist(), np.float64)
            row, tree = np.repeat(np.arange(len(part)), len(some)), np.tile(some, len(part))
            for t in trees:
                out[:, some] += rate * t.value[t.leaf(bins, means, row, tree)].reshape(len(part), -1)
            return out

        return scores

    for k in range(rounds):
        done.append(grow(data, rows, groups, depth, folds.mean.shape[1], False, "residual", add(recent)))
        recent = [*recent, done[-1]]
        if len(recent) == EVERY and k + 1 < rounds:
            scores = add(recent)

            def moved(batches: Iterator[pd.DataFrame], scores=scores) -> Iterator[pd.DataFrame]:
                for b in batches:
                    if len(b):
                        yield b.assign(f=list(scores(b, _codes(b["bins"]), groups)))

            rows, recent = kept(rows.mapInPandas(moved, rows.schema)), []
    return Boosted(start, rate, joined(done) if done else grow(data, rows, groups, 0, 1, False, "residual", add([])))


def tree_scores(data: Binned, depth: int = 30) -> DataFrame:
    """`scored` of `tree`."""
    if data.chunks == 1:
        return scored(data, tree(data, depth))
    return _told(data, _grower(data, np.arange(data.folds.groups), depth, data.folds.mean.shape[1], False, "class"), 1)


def forest_scores(data: Binned, rows: DataFrame | None = None, trees: int = 500, depth: int = 15) -> DataFrame:
    """`scored` of `forest`."""
    if data.chunks == 1:
        return scored(data, forest(data, trees, depth), rows)
    features = max(1, int(np.sqrt(data.folds.mean.shape[1])))
    return _told(data, _grower(data, np.repeat(np.arange(data.folds.groups), trees), depth, features, True, "class"), trees, rows)


def boosted_scores(data: Binned, rounds: int = 100, depth: int = 3, rate: float = 0.1) -> DataFrame:
    """`scored` of `boosted`."""
    if data.chunks == 1:
        return scored(data, boosted(data, rounds, depth, rate))
    own = _grower(data, np.arange(data.folds.groups), depth, data.folds.mean.shape[1], False, "residual")
    return _told(data, own, 1, None, (rounds, rate, _starts(data.folds)))


def scored(data: Binned, model: Forest | Boosted, rows: DataFrame | None = None) -> DataFrame:
    """`rows` (repeat, fold, x, ...) with score, P(label 1); by default the validation rows of every repeat, with the kept columns, label, repeat and fold.

    The mean of a group's trees or the logistic of their sum; 0 for groups that had one label to learn from.
    """
    folds, k, cuts, means, taught = data.folds, data.folds.k, data.cuts, data.means, data.folds.taught()
    if rows is None:
        rows = folds.rows.select(*folds.keep, "label", "x", F.posexplode("own").alias("repeat", "fold"))
    sent = rows.sparkSession.sparkContext.broadcast(model)
    names = [c for c in rows.columns if c != "x"]
    types = dict(rows.dtypes)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for b in batches:
            if not len(b):
                continue
            group = b["repeat"].to_numpy(np.int64) * k + b["fold"].to_numpy(np.int64)
            bins = _bins(np.array(b["x"].tolist(), np.float64).reshape(len(b), -1), cuts)
            if isinstance(own, Boosted):
                p = 1 / (1 + np.exp(-(own.start[group] + own.rate * own.trees.totals(bins, means, group))))
            else:
                p = own.totals(bins, means, group) / np.maximum(1, np.searchsorted(own.group, group, "right") - np.searchsorted(own.group, group))
            yield b[names].assign(score=np.where(taught[group], p, 0.0))

    return rows.mapInPandas(score, ", ".join([*[f"{c} {types[c]}" for c in names], "score double"]))
