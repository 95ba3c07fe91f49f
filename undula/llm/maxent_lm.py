"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

Counts of all training tokens are one aggregate. The FREQUENT most frequent words make classes of MEMBERS words each, by rank;
every other word is in a class of its ending. P(word | history) = P(class | history) P(word | class, history). Both factors are softmaxes
over sums of weight rows that features of the history name by hashing: the word before (n-gram), the two before together (n-gram),
and the second and third before alone (skips); words that aren't frequent stand in features by their ending. In a class of endings words
share by their discounted counts, and what the discount frees is the unknown word's. Over the distinct training tokens and one unknown
token, the outcomes of the base score, the probabilities sum to one.

Weights start at zero above the logarithms of counts. They are trained in ROUNDS, each over another share of the training texts:
a task runs adaptive gradient steps on minibatches of all their tokens from the same weights, and a row's changes are averaged over the tasks that touched it,
weighted by how often. Only changed rows are shuffled. Scoring is a map in sparse NumPy batches; what the LIST of frequent
words doesn't hold is looked up in all counts by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.shared import table, written
from undula.llm.tokens import SLICE, _powers, mix

#: Words in classes of their own, words of a class, classes of endings, and most words that every task knows; scores depend on the first three.
FREQUENT, MEMBERS, TAILS, LIST = 2048, 64, 32, 1 << 18
HEADS = FREQUENT // MEMBERS
#: Rows of hashed weights (as bits), and features of a history.
BITS, FEATURES = 15, 4
#: Rounds of training.
ROUNDS = 3
#: Training tokens of a task at least; positions of a minibatch; size of steps.
TASK_TOKENS, BATCH, STEP = 2_000_000, 2048, 0.5
DISCOUNT = 0.5
_ENDINGS, _ROWS, _CHUNK, _LAYERS = 4096, 512, 8192, 8
#: Bits of names by which the list is entered. Weights whose exponentials can be multiplied in single precision, and sums of those that are trusted.
_FIRST, _WITHIN, _TRUSTED = 20, 20.0, (1e-25, 1e26)
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_PAD, _END, _NONE = _U(1), _U(2), np.float32(-1e9)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_CHANGED = pa.schema([("weights", pa.int32()), ("block", pa.int32()), ("touched", pa.binary()), ("change", pa.binary())])
_VALUE = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))[_LOWER]
#: Rows of weights that a code alone names: as the word before, the second and the third before.
_ALONE = [(mix(np.arange(FREQUENT + _ENDINGS + 1, dtype=_U) << _U(2) | _U(k)) >> _U(64 - BITS)).astype(np.uint16) for k in range(3)]


@dataclass
class Slice:
    """Tokens of texts first..first + texts, each text after three pads: names and endings of all places, texts of the tokens and where they stand."""

    first: int
    texts: int
    name: np.ndarray
    ending: np.ndarray
    row: np.ndarray
    place: np.ndarray


def _running(part: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Running sums of the bytes' values times powers, from zero on, in blocks that stay in a core's cache."""
    sums = np.zeros(len(part) + 1, _U)
    for i in range(0, len(part), 1 << 16):
        values = _VALUE.take(part[i : i + (1 << 16)])
        values *= up[i : i + len(values)]
        values[:1] += sums[i : i + 1]
        np.cumsum(values, out=sums[i + 1 : i + 1 + len(values)])
    return sums


def slices(column: pa.Array) -> Iterator[Slice]:
    """Tokens of a string column, some texts at a time: words between white space, A-Z lowered, and one end a text. Null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    k = 0
    while k < len(column):
        m = max(k + 1, int(np.searchsorted(offsets, offsets[k] + SLICE, side="right")) - 1)
        part, cuts = data[offsets[k] : offsets[m]], offsets[k : m + 1] - offsets[k]
        word = (part != 0x20) & (part - np.uint8(0x09) > 0x0D - 0x09)
        opens = word.copy()
        opens[1:] &= ~word[:-1]
        begun = cuts[:-1][cuts[:-1] < len(part)]
        opens[begun] = word[begun]
        closes = np.zeros(len(part) + 1, bool)
        closes[1:] = word
        closes[1:-1] &= ~word[1:] | opens[1:]
        lo, hi = np.flatnonzero(opens), np.flatnonzero(closes)
        up, down = _powers(max(1, len(part)))
        sums = _running(part, up)
        low, ending = part + (part - np.uint8(0x41) < 26) * np.uint8(0x20), np.zeros(len(lo), np.int64)
        for back in (1, 2, 3):
            ending = ending << 8 | np.where(hi - back >= lo, low[np.maximum(hi - back, 0)], 0)
        text = np.searchsorted(cuts[1:], lo, side="right")
        count = np.bincount(text, minlength=m - k)
        ends = np.cumsum(count) + 4 * np.arange(1, m - k + 1) - 1
        place = np.arange(len(lo)) + 4 * text + 3
        n = len(lo) + 4 * (m - k)
        name, endings = np.full(n, _PAD), np.full(n, -1, np.int64)
        name[place] = mix((sums[hi] - sums[lo]) * down[lo]) if len(lo) else name[:0]
        endings[place], name[ends], endings[ends] = ending, _END, -2
        taken = np.zeros(n, bool)
        taken[place] = taken[ends] = True
        yield Slice(k, m - k, name, endings, np.repeat(np.arange(m - k), count + 1), np.flatnonzero(taken))
        k = m


def tail(ending: np.ndarray) -> np.ndarray:
    """Classes of endings: of the last two bytes."""
    return ((((ending >> 8).astype(_U) + _U(1)) * _GOLD) >> _U(40)).astype(np.int64) % TAILS


@dataclass
class Model:
    """Names of the list, ascending, with their counts and ranks; totals; sizes of the classes of endings (tokens, types); biases; weight rows."""

    names: np.ndarray
    counts: np.ndarray
    ranks: np.ndarray
    total: int
    types: int
    tail_tokens: np.ndarray
    tail_types: np.ndarray
    class_bias: np.ndarray = field(init=False)
    word_bias: np.ndarray = field(init=False)
    classes: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, HEADS + TAILS), np.float32))
    words: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, MEMBERS), np.float32))
    _entries: np.ndarray | None = field(init=False, default=None)
    _raised: tuple[list, list] | None = field(init=False, default=None)

    def __post_init__(self):
        by_rank = np.zeros(FREQUENT)
        top = self.ranks < FREQUENT
        by_rank[self.ranks[top]] = self.counts[top]
        with np.errstate(divide="ignore"):
            heads = np.log(by_rank.reshape(HEADS, MEMBERS).sum(1))
            self.word_bias = np.maximum(np.log(by_rank).reshape(HEADS, MEMBERS), _NONE).astype(np.float32)
        bias = np.concatenate((heads, np.log(self.tail_tokens + 0.5)))
        self.class_bias = np.maximum(bias - np.log(self.total + 0.5 * TAILS), _NONE).astype(np.float32)
        unknown = (DISCOUNT * self.tail_types + 0.5) / (self.tail_tokens + 0.5)
        self.unknown = np.concatenate((np.zeros(HEADS), unknown)).astype(np.float32)

    def found(self, name: np.ndarray) -> np.ndarray:
        """Places in the list, -1 for what isn't in it. Names are spread evenly, so their first bits lead to a place a step or so away."""
        if not len(self.names):
            return np.full(len(name), -1)
        if self._entries is None:
            of = np.bincount((self.names >> _U(64 - _FIRST)).astype(np.int64), minlength=1 << _FIRST)
            self._entries = (np.cumsum(of) - of).clip(max=len(self.names) - 1).astype(np.int32)
        at = self._entries.take((name >> _U(64 - _FIRST)).astype(np.int64)).astype(np.int64)
        before = np.flatnonzero(self.names[at] < name)
        while len(before := before[at[before] < len(self.names) - 1]):
            at[before] += 1
            before = before[self.names[at[before]] < name[before]]
        return np.where(self.names[at] == name, at, -1)

    def coded(self, s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all places: place in the list, class, and code in features."""
        at = self.found(s.name)
        rank = np.where(at >= 0, self.ranks[at], FREQUENT) if len(self.names) else np.full(len(at), FREQUENT)
        head = rank < FREQUENT
        code = np.where(head, rank, FREQUENT + ((s.ending.astype(_U) * _GOLD) >> _U(52)).astype(np.int64) % _ENDINGS)
        code[s.ending == -1] = FREQUENT + _ENDINGS
        return np.where(head, rank | 1 << 40, at), np.where(head, rank // MEMBERS, HEADS + tail(s.ending)), code

    @staticmethod
    def histories(code: np.ndarray) -> np.ndarray:
        """Rows of weights that the history before every place names (features x places); those of the pads mean nothing."""
        out = np.zeros((FEATURES, len(code)), np.uint16)
        for k, rows in enumerate(_ALONE):
            out[k, k + 1 :] = rows.take(code[: -k - 1])
        both = code.astype(_U)
        out[3, 2:] = mix((both[1:-1] << _U(16) | both[:-2]) << _U(2) | _U(3)) >> _U(64 - BITS)
        return out

    @classmethod
    def features(cls, code: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Rows of weights that the history before each place names."""
        return cls.histories(code).take(place, axis=1)

    @staticmethod
    def rows_of_words(features: np.ndarray, head: np.ndarray) -> np.ndarray:
        return (((features.astype(_U) << _U(6) | head.astype(_U)) * _GOLD) >> _U(64 - BITS)).astype(np.int64)

    @staticmethod
    def _softmax(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logits, their exponentials, sums of these)."""
        z = weights.take(rows[0], axis=0)
        for r in rows[1:]:
            z += weights.take(r, axis=0)
        z += bias
        if z.max(initial=0) > 60:
            np.minimum(z, np.float32(60), out=z)
        e = np.exp(z)
        return z, e, e @ np.ones(e.shape[1], np.float32)

    def logs(self, features: np.ndarray, cls: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural logs of P(class) or, of frequent words (member >= 0), of P(word); and of P(unknown)."""
        own, total, unknown = self._sums(0, features, cls, np.zeros(len(cls), np.int64))
        out = own.astype(np.float64) - np.log(total)
        unknown = np.log(np.maximum(unknown, np.float32(1e-37))) - np.log(total)
        of = np.flatnonzero(member >= 0)
        if len(of):
            own, total, _ = self._sums(1, self.rows_of_words(features.take(of, axis=1), cls[of]), member[of], cls[of])
            out[of] += own - np.log(total)
        return out, unknown

    def _sums(self, k: int, rows: np.ndarray, target: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Of positions: the target's logit, the sum of all exponentials, that of the unknown word; over classes (k 0) or the words of class `group` (k 1).

        Exponentials of weights are taken once a model; those of sums are products of these unless a weight or a sum is out of range.
        """
        weights, bias = (self.words, self.word_bias) if k else (self.classes, self.class_bias[None])
        if self._raised is None:
            raised = [np.exp(w) if np.abs(w).max() <= _WITHIN else None for w in (self.classes, self.words)]
            self._raised = raised, [np.exp(self.class_bias[None]), np.exp(self.word_bias)]
        powers, shares = (x[k] for x in self._raised)
        if powers is not None:
            e = powers.take(rows[0], axis=0)
            for r in rows[1:]:
                e *= powers.take(r, axis=0)
            own = np.log(e[np.arange(len(target)), target]) + bias[group, target]
            total, unknown = (np.vecdot(e, shares.take(group, axis=0)), None) if k else (e @ np.stack((shares[0], shares[0] * self.unknown), 1)).T
            if _TRUSTED[0] < total.min(initial=1) and total.max(initial=1) < _TRUSTED[1]:
                return own, total, unknown
        z, e, total = self._softmax(weights, rows, bias.take(group, axis=0) if k else bias)
        return z[np.arange(len(target)), target], total, None if k else e @ self.unknown

    def learn(self, features: np.ndarray, cls: np.ndarray, member: np.ndarray, state: Changes, step: float) -> None:
        """One minibatch."""
        of = np.flatnonzero(member >= 0)
        rows = self.rows_of_words(features.take(of, axis=1), cls[of])
        for k, (weights, f, bias, target) in enumerate(((self.classes, features, self.class_bias, cls), (self.words, rows, self.word_bias[cls[of]], member[of]))):
            if f.shape[1]:
                used = Used(f)
                own = weights.take(used.at, axis=0)
                _, e, total = self._softmax(own, used.place, bias)
                e /= total[:, None]
                e[np.arange(len(target)), target] -= 1
                own -= state.change(k, used, e, step)
                _whole(weights)[used.at] = _whole(own)


def _whole(weights: np.ndarray) -> np.ndarray:
    """Rows as single values, which are written faster."""
    return weights.view(np.dtype((np.void, weights.shape[1] * weights.itemsize))).ravel()


class Used:
    """Distinct rows of weights of a minibatch, most used first (`at`, `count`), and where its `rows` (features x positions) stand among them (`place`)."""

    def __init__(self, rows: np.ndarray):
        flat = rows.ravel().astype(np.uint16)  # sorted by radix; rows and places of a minibatch have no more than 16 bits
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        count = np.diff(np.append(first, len(flat)))
        by = np.argsort((len(flat) - count).astype(np.uint16), kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        place = np.empty(len(flat), np.int64)
        place[order] = np.repeat(rank, count)
        self.at, self.count, self.place = flat[first[by]].astype(np.int64), count[by], place.reshape(rows.shape)
        self.first, self.position = first[by], order % rows.shape[1]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of every distinct row the sum of the values of its positions. The first few are added for all rows at once, the rest row by row."""
        out = values.take(self.position[self.first], axis=0)
        more_than = np.searchsorted(-self.count, -np.arange(1, _LAYERS + 1)).tolist()
        for k, n in enumerate(more_than[:-1], 1):
            if not n:
                return out
            out[:n] += values.take(self.position[self.first[:n] + k], axis=0)
        n = more_than[-1]
        if n:
            more = self.count[:n] - _LAYERS
            starts = np.cumsum(more) - more
            place = np.repeat(self.first[:n] + _LAYERS - starts, more) + np.arange(more.sum())
            out[:n] += np.add.reduceat(values.take(self.position[place], axis=0), starts, axis=0)
        return out


class Changes:
    """Squared gradients of rows, and how many positions touched them, in one task."""

    def __init__(self):
        self.squares = [np.ones(1 << BITS, np.float32) for _ in range(2)]
        self.touched = [np.zeros(1 << BITS, np.int64) for _ in range(2)]

    def change(self, k: int, used: Used, gradient: np.ndarray, step: float) -> np.ndarray:
        """What a step takes off the rows that are used."""
        g = used.sums(gradient)
        self.touched[k][used.at] += used.count
        squares = self.squares[k].take(used.at) + np.einsum("ij,ij->i", g, g) / 4
        self.squares[k][used.at] = squares
        g *= (np.float32(step) / np.sqrt(squares))[:, None]
        return g


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, tail, n) of (text), counted slice by slice."""
    for b in batches:
        for s in slices(b.column(0)):
            name = s.name[s.place]
            order = np.argsort(name)  # a name's tokens have one ending, so any of them will do
            name = name[order]
            first = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
            ends, n = tail(s.ending[s.place[order[first]]]), np.diff(np.append(first, len(name)))
            yield pa.RecordBatch.from_arrays([pa.array(name[first].view(np.int64)), pa.array(ends.astype(np.int8)), pa.array(n)], ["name", "tail", "n"])


def counted(texts: DataFrame) -> DataFrame:
    """(name, tail, n) of every distinct token of `texts` (text), written."""
    found = texts.select(F.col("text").cast("string")).mapInArrow(_counted, "name long, tail byte, n long")
    return written(found.groupBy("name").agg(F.min("tail").alias("tail"), F.sum("n").alias("n")))


def start(counts: DataFrame) -> Model:
    """A model without weights. What comes to the driver: the LIST most frequent words at most, and sums by class."""
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    size = F.floor(F.log2("n") * 16).cast("int")
    held, least = 0, None
    for r in sorted(counts.groupBy(size.alias("size")).count().collect(), reverse=True):
        if (held := held + r["count"]) > LIST:
            break
        least = r["size"]
    top = counts.filter(size >= least).select("name", "tail", "n").toArrow() if least is not None else pa.table({"name": pa.array([], pa.int64()), "tail": pa.array([], pa.int8()), "n": pa.array([], pa.int64())})
    name, ends, n = (top.column(c).to_numpy() for c in ("name", "tail", "n"))
    name = name.view(_U)
    rank = np.empty(len(n), np.int64)
    rank[np.lexsort((name, -n))] = np.arange(len(n))
    tokens, kinds = np.zeros(TAILS), np.zeros(TAILS)
    for r in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("c")).collect():
        tokens[r["tail"]], kinds[r["tail"]] = r["n"], r["c"]
    head = rank < FREQUENT
    tokens -= np.bincount(ends[head], n[head], TAILS)
    kinds -= np.bincount(ends[head], minlength=TAILS)
    order = np.argsort(name)
    return Model(name[order], n[order], rank[order], int(total), int(types), tokens, kinds)


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(weights, block, touched, change) summed by (weights, block) and averaged over what touched each row; a sum a block is held."""
    sums: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        for r in b.to_pylist():
            touched = np.frombuffer(r["touched"], np.int32)
            change = np.frombuffer(r["change"], np.float16).reshape(-1, HEADS + TAILS if not r["weights"] else MEMBERS)
            n, total = sums.setdefault((r["weights"], r["block"]), (np.zeros(_ROWS, np.int64), np.zeros((_ROWS, change.shape[1]), np.float32)))
            at = np.flatnonzero(touched)
            n += touched
            total[at] += change * touched[at].astype(np.float32)[:, None]
    for (k, block), (n, total) in sums.items():
        at = np.flatnonzero(n)
        mean = (total[at] / n[at].astype(np.float32)[:, None]).astype(np.float16)
        yield pa.RecordBatch.from_pylist([{"weights": k, "block": block, "touched": n.clip(0, 1 << 30).astype(np.int32).tobytes(), "change": mean.tobytes()}], schema=_CHANGED)


def _round(texts: DataFrame, model: Model, pace: float) -> None:
    """One round over all tokens of `texts`; changes the model's weights."""
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        weights = own.classes, own.words
        own.classes, own.words = own.classes.copy(), own.words.copy()
        state = Changes()
        try:
            for b in batches:
                for s in slices(b.column(0)):
                    rng = np.random.default_rng(len(s.name))
                    at, cls, code = own.coded(s)
                    features, member = own.histories(code), _member(at)
                    places = rng.permutation(s.place)
                    for i in range(0, len(places), BATCH):
                        place = places[i : i + BATCH]
                        own.learn(features.take(place, axis=1), cls[place], member[place], state, STEP * pace)
            for k, (new, old) in enumerate(zip((own.classes, own.words), weights, strict=True)):
                for block in range(0, len(new), _ROWS):
                    touched = state.touched[k][block : block + _ROWS].clip(0, 1 << 30).astype(np.int32)
                    at = np.flatnonzero(touched)
                    if len(at):
                        change = (new[block + at] - old[block + at]).astype(np.float16)
                        yield pa.RecordBatch.from_pylist([{"weights": k, "block": block // _ROWS, "touched": touched.tobytes(), "change": change.tobytes()}], schema=_CHANGED)
        finally:
            own.classes, own.words = weights  # the broadcast value serves the worker's next task too

    kind = "weights int, block int, touched binary, change binary"
    changes = texts.mapInArrow(train, kind).repartition("weights", "block").mapInArrow(_averaged, kind).toArrow()
    sent.destroy()
    for r in changes.to_pylist():
        at = r["block"] * _ROWS + np.flatnonzero(np.frombuffer(r["touched"], np.int32))
        weights = model.words if r["weights"] else model.classes
        model._raised = None
        weights[at] += np.frombuffer(r["change"], np.float16).reshape(len(at), -1).astype(np.float32)


def _member(at: np.ndarray) -> np.ndarray:
    return np.where(at >= 1 << 40, (at & ((1 << 40) - 1)) % MEMBERS, -1)


def fit(texts: DataFrame, counts: DataFrame) -> Model:
    """A model of `texts` (doc_id, text), whose tokens are `counts`. Every token of every text is trained on, in one of the rounds."""
    model = start(counts)
    if not model.total:
        return model
    parts = texts.select(F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(ROUNDS)).alias("part"))
    for k in range(ROUNDS):
        tasks = max(1, -(-model.total // (ROUNDS * TASK_TOKENS)))
        _round(parts.filter(F.col("part") == k).select("text").coalesce(tasks), model, (1 + k) ** -0.5)
    return model


_SUMS = "n_tokens long, n_known long, base double, natural double, rare array<struct<name: long, tail: byte, m: int, p: float, u: float>>"


def _measured(sent, ids: pa.Field):
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, at, ...) of (doc_id, at, text): sums over tokens of the list, and the other tokens with their logs, by text and name."""
        model = sent.value
        whole = model.total + 0.5 * (model.types + 1)
        by_rank = np.argsort(model.ranks) if len(model.ranks) else np.zeros(1, np.int64)
        base_of, tail_of = np.log10((model.counts + 0.5) / whole), np.log(np.maximum(model.counts - DISCOUNT, 1e-9))
        for b in batches:
            for s in slices(b.column(2)):
                at, cls, code = model.coded(s)
                at, cls = at[s.place], cls[s.place]
                member = _member(at)
                listed = np.where(member >= 0, by_rank[np.where(member >= 0, at & ((1 << 40) - 1), 0)], at)
                log, unknown, features = np.empty(len(at)), np.empty(len(at)), model.histories(code)
                for i in range(0, len(at), _CHUNK):
                    part = slice(i, i + _CHUNK)
                    log[part], unknown[part] = model.logs(features.take(s.place[part], axis=1), cls[part], member[part])
                in_tail = member < 0
                log[in_tail] -= np.log(model.tail_tokens + 0.5)[cls[in_tail] - HEADS]
                known = listed >= 0
                few = in_tail & known
                log[few] += tail_of[listed[few]]
                of = s.row[known]
                # without known tokens NumPy's weighted counts are whole numbers
                sums = [np.bincount(of, minlength=s.texts), *(np.bincount(of, x, s.texts).astype(np.float64) for x in (base_of[listed[known]], log[known]))]
                r = np.flatnonzero(~known)
                r = r[np.lexsort((s.name[s.place[r]], s.row[r]))]
                row, name = s.row[r], s.name[s.place[r]]
                first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (name[1:] != name[:-1])))) if len(r) else r
                m = np.diff(np.append(first, len(r))) if len(r) else r
                p, u = (np.add.reduceat(x[r], first).astype(np.float32) if len(r) else np.zeros(0, np.float32) for x in (log, unknown))
                fields = [pa.array(name[first].view(np.int64)), pa.array((cls[r[first]] - HEADS).astype(np.int8)), pa.array(m.astype(np.int32)), pa.array(p), pa.array(u)]
                ends = np.concatenate(([0], np.cumsum(np.bincount(row[first], minlength=s.texts)))).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, ["name", "tail", "m", "p", "u"]))
                ids, rows = (b.column(c).slice(s.first, s.texts) for c in (0, 1))
                columns = [ids, rows, pa.array(np.bincount(s.row, minlength=s.texts)), *map(pa.array, (sums[0].astype(np.int64), sums[1], sums[2])), rare]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "at", "n_tokens", "n_known", "base", "natural", "rare"])

    return measured


def scored(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of `docs` (doc_id, text; others are ignored).

    `counts` are those that the model was made of. Null texts have one token, their end. Repeated rows stay and score alike; very long texts
    are taken one at a time. Without training tokens every token is unknown with probability one and both scores are 0. An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("at"), F.col("text").cast("string").alias("text"))
    done = written(rows.mapInArrow(_measured(sent, kind), f"doc_id {kind}, at long, {_SUMS}"))
    whole = model.total + 0.5 * (model.types + 1)
    rare = done.select("at", F.explode("rare").alias("r")).select("at", "r.*").join(counts.select("name", "n"), "name", "left")
    known = F.col("n").isNotNull()
    base = F.col("m") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / whole)
    log = F.when(known, F.col("p") + F.col("m") * F.log(F.coalesce("n", F.lit(1)) - DISCOUNT)).otherwise(F.col("u").cast("double"))
    more = rare.groupBy("at").agg(F.sum(F.when(known, F.col("m")).otherwise(0)).alias("k"), F.sum(base).alias("b"), F.sum(log).alias("s"))
    out = done.drop("rare").join(more, "at", "left").fillna(0, ["k", "b", "s"])
    score = (F.col("natural") + F.col("s")) / float(np.log(10))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.col("k")).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + F.col("b")).alias("base_score"), score.alias("score"))


def op11_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all `documents`, learnt from those whose CRC-32 of the id isn't 1 modulo 5; a null id is held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(True))
    learn = docs.filter(~held_out)
    counts = counted(learn)
    model = fit(learn, counts)
    return scored(docs, model, counts).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
