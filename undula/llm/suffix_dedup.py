"""Removing repeated substrings by anchor (minimizer) matching over Spark sorts, in place of prefix doubling.

Every start of a `length`-byte string is a position. Positions get a rank (here: a name, equal for equal strings) for a
short length first and are sorted by pairs of ranks at growing lengths; a position drops out as soon as its rank is unique
and is settled as soon as an equal string is known to start earlier.

The first round doesn't sort every position but runs of them: `length`-byte strings pick the `gram`-byte string of lowest
name inside them (the rightmost of equals), so equal strings pick equal ones, and neighbours mostly pick the same one. A
run of positions with one pick is a unit, about one for (length - gram) / 2 bytes. Its pair of ranks is the name of the
picked gram and the name of all bytes that the unit's strings cover. Sorted by that pair and position, a unit that follows
one of the same pair is repeated as a whole; the first of a pair has a string in common with others only if its gram has
another pair. Only those few units are taken apart, first into stretches of STRETCH positions, whose ranks are the name of
what all strings of the stretch share and the name of all it covers, then into single positions, whose ranks are two names
of the `length`-byte string; sorted again each time, all but the first of a pair are repeated.

Names are polynomials over bytes modulo 2**64 with a final mix; equality is decided by 128 bits (in the first round by a
64-bit name within an equal 64-bit name).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.shared import table, written

LENGTH, GRAM = 100, 24
#: Positions of a stretch, the second round's unit.
STRETCH = 8
#: Bytes whose positions are ranked at a time; neighbours overlap, so it bounds memory and changes no result.
BLOCK = 1 << 19
_U = np.uint64
_LOW = _U((1 << 20) - 1)
_NO_ID = -(1 << 63)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_UNITS = "key long, ctx long, doc long, sub long, lo int, n int, at int"
_NARROW = _U((1 << 48) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


class Names:
    """Names of substrings of a block of bytes, from prefix sums of byte values times powers of an odd base."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int):
        n = len(data)
        if base not in self._powers or len(self._powers[base][0]) < n:
            room = max(n, BLOCK + 2 * LENGTH)
            up, down = np.full(room, base, _U), np.full(room, pow(base, -1, 1 << 64), _U)
            up[0] = down[0] = 1
            self._powers[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        up, self.down = self._powers[base]
        values = _mix(np.arange(1, 257, dtype=_U) * _U(base))
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(values[data] * up[:n], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        """Of all substrings of `length` bytes."""
        out = self.sums[length:] - self.sums[:-length]
        out *= self.down[: len(out)]
        return _mix(out)

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mix((self.sums[hi] - self.sums[lo]) * self.down[lo] + (hi - lo).astype(_U))


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while 2 * have <= width:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    return out if have == width else np.minimum(out[: len(x) - width + 1], out[width - have : width - have + len(x) - width + 1])


def units(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, first position, positions less one, pick less first position, gram name, name of all bytes) of the units of texts laid end to end.

    `ends` are the texts' ends in `data`. Positions are in `data`.
    """
    for at in range(0, max(0, len(data) - length + 1), BLOCK):
        part = data[at : at + BLOCK + length - 1]
        count = len(part) - length + 1
        own = np.searchsorted(ends, np.arange(at, at + count), side="right")
        valid = np.arange(at, at + count) + length <= ends[np.minimum(own, len(ends) - 1)]
        if not valid.any():
            continue
        names = Names(part, _BASES[0])
        grams = names.every(gram)
        code = (grams & ~_LOW) | (_LOW - np.arange(len(grams), dtype=_U))
        pick = (_LOW - (_window_min(code, length - gram + 1) & _LOW)).astype(np.int64)
        starts = np.concatenate(([True], (pick[1:] != pick[:-1]) | (own[1:] != own[:-1]) | (valid[1:] != valid[:-1])))
        lo = np.flatnonzero(starts)
        hi = np.append(lo[1:], count) - 1
        lo, hi = lo[valid[lo]], hi[valid[lo]]
        picked = pick[lo]
        whole = names.of(lo, hi + length)
        yield own[lo], lo + at, hi - lo, picked - lo, grams[picked], _mix(whole ^ _mix((picked - lo).astype(_U) + _U(1)))


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a string column laid end to end, and starts and ends in them."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    return data, offsets[:-1], offsets[1:]


def _rows(*columns: np.ndarray) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    names = [c.split()[0] for c in _UNITS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == _U else c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _settle_here(key, ctx, doc, sub, lo, n, at) -> pa.RecordBatch:
    """Settles what a batch alone shows: of equal pairs the first stays, the others are repeated (n < 0 marks them).

    A pair that is frequent everywhere so reaches the shuffle once per batch. Settled units that follow each other in a text
    become one row; settled rows get keys that spread them.
    """
    ctx = ctx & _NARROW  # the other bits would only widen the shuffle; a pair is compared within an equal 64-bit key
    by = np.lexsort((lo, sub, doc, ctx, key))
    key, ctx, doc, sub, lo, n, at = (x[by] for x in (key, ctx, doc, sub, lo, n, at))
    first = np.concatenate(([True], (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1]))) if len(key) else np.zeros(0, bool)
    lead = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0)) if len(key) else np.zeros(0, np.int64)
    again = (doc != doc[lead]) | (sub != sub[lead]) | (lo != lo[lead])
    new = ~again  # a repeated row of the table is the first itself, and stays
    doc_, sub_, lo_, n_ = doc[again], sub[again], lo[again], n[again]
    by = np.lexsort((lo_, sub_, doc_))
    doc_, sub_, lo_, n_ = doc_[by], sub_[by], lo_[by], n_[by]
    if len(doc_):
        opens = np.concatenate(([True], (doc_[1:] != doc_[:-1]) | (sub_[1:] != sub_[:-1]) | (lo_[1:] != lo_[:-1] + n_[:-1] + 1)))
        start = np.flatnonzero(opens)
        last = np.append(start[1:], len(doc_)) - 1
        doc_, sub_, n_, lo_ = doc_[start], sub_[start], lo_[last] + n_[last] - lo_[start], lo_[start]
    spread = _mix(doc_.astype(_U) + _mix(lo_.astype(_U)))
    both = lambda x, y: np.concatenate((x[new], y))
    return _rows(both(key, spread), both(ctx, np.zeros(len(lo_), _U)), both(doc, doc_), both(sub, sub_), both(lo, lo_), both(n, -1 - n_), both(at, np.zeros_like(lo_)))


def _rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, ctx and position: settled ones (n < 0), and firsts of a pair whose key has another pair."""
    none = np.zeros(1, np.int64)
    last = None  # key, ctx and position of the first of the last pair
    held = None  # the first of the last key as long as its key has one pair
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ctx, doc, sub, lo, n, pick = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        known = n < 0
        first = np.concatenate(([True], (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])))
        if last is not None and (key[0], ctx[0]) == last[:2]:
            first[0] = False
        lead = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
        at = [np.where(lead >= 0, x[lead], last[k] if last else 0) for k, x in ((2, doc), (3, sub), (4, lo))]
        again = ~first & ~known & ((doc != at[0]) | (sub != at[1]) | (lo != at[2]))
        zero = none.repeat((m := known | again).sum())
        yield _rows(zero, zero, doc[m], sub[m], lo[m], np.where(known, n, -1 - n)[m], zero)
        rows = np.flatnonzero(first & ~known)
        tops = [x[rows] for x in (key, ctx, doc, sub, lo, n, pick)]
        if held is not None:
            tops = [np.concatenate((np.array([h], x.dtype), x)) for h, x in zip(held, tops, strict=True)]
        k = tops[0]
        if len(k):
            same = k[1:] == k[:-1]
            shared = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            if held is None and last is not None:  # the last key's firsts have gone on already
                shared |= k == last[0]
            yield _rows(*(x[shared] for x in tops))
            held = None if shared[-1] else tuple(x[-1] for x in tops)
        if lead[-1] >= 0:
            last = tuple(x[lead[-1]] for x in (key, ctx, doc, sub, lo))


def _sorted_round(ranked: DataFrame) -> DataFrame:
    """Sorts pairs of ranks and reranks; keys are dealt out by hash, so equal keys meet."""
    return ranked.repartition("key").sortWithinPartitions("key", "ctx", "doc", "sub", "lo").mapInArrow(_rerank, _UNITS)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, sub, text): doc orders the documents (a null id first); sub tells rows of one id apart by their text.

    Where ids are unique, sub is 0, so that it takes no room in shuffles.
    """
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    unique = docs.select(doc.alias("doc")).groupBy("doc").count().filter("count > 1").isEmpty()
    return docs.select(doc.alias("doc"), (F.lit(0).cast("long") if unique else F.crc32(whole)).alias("sub"), whole.alias("text"))


def _apart(data: np.ndarray, start: np.ndarray, n: np.ndarray, pick: np.ndarray, length: int, single: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(unit, positions from its start, positions less one, key, ctx) of the positions, or the stretches, of units in `data`.

    Units begin at `start` (ascending) and have n + 1 positions. Stretches are laid out from the pick, so that equal strings
    lie in equal ones.
    """
    for at in range(0, len(data), BLOCK):
        i, j = np.searchsorted(start, (at, at + BLOCK))
        if i == j:
            continue
        count = n[i:j] + 1
        part = data[at : at + BLOCK + int(count.max()) + length]
        unit = np.repeat(np.arange(j - i), count)
        step = np.arange(len(unit)) - np.repeat(np.cumsum(count) - count, count)
        pos = (start[i:j] - at)[unit] + step
        names = Names(part, _BASES[0])
        if single:
            yield unit + i, step, np.zeros(len(step), np.int64), names.of(pos, pos + length), Names(part, _BASES[1]).of(pos, pos + length)
            continue
        off = pick[i:j][unit] - step  # pick less position
        grid = off // STRETCH
        first = np.flatnonzero(np.concatenate(([True], (unit[1:] != unit[:-1]) | (grid[1:] != grid[:-1]))))
        last = np.append(first[1:], len(unit)) - 1
        core = (pos + off - grid * STRETCH)[first]
        key = _mix(names.of(core, core + length - STRETCH + 1) ^ _mix(grid[first].astype(_U) + _U(7)))
        ctx = _mix(names.of(pos[first], pos[last] + length) ^ _mix((pos[first] - core + 64).astype(_U)))
        yield unit[first] + i, step[first], last - first, key, ctx


def repeats(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, sub, lo, n): strings of `length` bytes that start at lo, lo + 1, ..., lo + n and also start earlier."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, starts, ends = _texts(b.column(2))
            doc, sub = (b.column(k).to_numpy() for k in (0, 1))
            found = [*units(data, ends, length, gram)]
            if found:
                own, lo, n, pick, key, ctx = (np.concatenate(x) for x in zip(*found, strict=True))
                yield _settle_here(key, ctx, doc[own], sub[own], lo - starts[own], n, pick)

    def apart(single: bool):
        def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                data, starts, _ = _texts(b.column(2))
                doc, sub = (b.column(k).to_numpy() for k in (0, 1))
                todo = b.column(3)
                row = np.repeat(np.arange(b.num_rows), todo.value_lengths().to_numpy(zero_copy_only=False))
                lo, n, pick = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in todo.flatten().flatten())
                by = np.argsort(starts[row] + lo, kind="stable")
                row, lo, n, pick = row[by], lo[by], n[by], pick[by]
                found = [*_apart(data, starts[row] + lo, n, pick, length, single)]
                if found:
                    unit, step, more, key, ctx = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield _settle_here(key, ctx, doc[row[unit]], sub[row[unit]], lo[unit] + step, more, np.zeros(len(unit), np.int64))

        return take

    def next_round(before: DataFrame, single: bool) -> DataFrame:
        todo = before.filter("n >= 0").groupBy("doc", "sub").agg(F.collect_list(F.struct("lo", "n", "at")).alias("todo"))
        return _sorted_round(keyed.join(todo, ["doc", "sub"]).mapInArrow(apart(single), _UNITS))

    by_unit = written(_sorted_round(keyed.mapInArrow(named, _UNITS)).select("doc", "sub", "lo", "n", "at"))
    by_stretch = next_round(by_unit, False)
    by_position = next_round(by_stretch, True)
    settled = reduce(DataFrame.union, [x.filter("n < 0").select("doc", "sub", "lo", "n") for x in (by_unit, by_stretch, by_position)])
    return settled.select("doc", "sub", "lo", (-1 - F.col("n")).alias("n"))


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of `docs` (doc_id, text; others are ignored).

    Texts are UTF-8 bytes, null as empty. A byte is removed if a `length`-byte string that covers it starts earlier too, in
    a smaller doc_id or before in the same text; `kept` are the other bytes (binary: a cut can split a character). A null
    doc_id comes before all others. Rows of one id with different texts are documents in the order of their texts' CRC-32;
    rows equal in id and text count as one document and get the same result. An empty table gives no rows.
    """

    @F.pandas_udf("n_removed long, n_spans long, kept binary")
    def cut(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = []
        for text, run in zip(texts, runs, strict=True):
            data = text.encode("utf-8", "surrogatepass")
            if run is None or not len(run):
                out.append((0, 0, data))
                continue
            flat = np.array([(r["lo"], r["n"]) for r in run], np.int64)
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, flat[:, 0], 1)
            np.add.at(edge, flat[:, 0] + flat[:, 1] + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes()))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept"])

    keyed = _keyed(docs)
    runs = repeats(keyed, length, gram).groupBy("doc", "sub").agg(F.collect_list(F.struct("lo", "n")).alias("runs"))
    doc_id = F.when(F.col("doc") != _NO_ID, F.col("doc")).cast(dict(docs.dtypes)["doc_id"]).alias("doc_id")
    done = keyed.join(runs, ["doc", "sub"], "left").select(doc_id, F.octet_length("text").cast("long").alias("n_bytes"), cut("text", "runs").alias("c"))
    return done.select("doc_id", "n_bytes", "c.n_removed", "c.n_spans", F.sha2("c.kept", 256).alias("kept_sha256"), "c.kept")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).drop("kept")
