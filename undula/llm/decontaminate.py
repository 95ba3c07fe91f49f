"""Benchmark decontamination by greedy string tiling over shared-token seeds."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undula.llm.shared import checkpointed, table, written
from undula.llm.tokens import BASE, mix, token_names

#: Tokens of a seed, which is also the shortest tile.
SEED = 5
#: Share of an item's tokens that tiles must cover.
COVERAGE = 0.5
#: Bits of the filter that keeps tokens away from the join that can't match. Fixed; it bounds what is broadcast (8 MB).
FILTER_BITS = 1 << 26
#: Most seeds of items that are broadcast; more are joined by a shuffle.
BROADCAST = 1_000_000
#: A seed with more than this part of all rows of documents' seeds is hot and split by document; so there are at most this many hot ones.
HOT = 1_000
_U = np.uint64
_INVERSE = pow(BASE, -1, 1 << 64)


def seeds_of(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, name of `size` tokens from there) of every seed of a string column, and tokens per row."""
    rows, names = token_names(column)
    counts = np.bincount(rows, minlength=len(column)) if len(rows) else np.zeros(len(column), np.int64)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    if len(rows) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), counts
    roll = np.zeros(len(names) - size + 1, np.uint64)
    for j in range(size):
        roll = roll * np.uint64(BASE) + names[j : len(names) - size + 1 + j]
    whole = rows[: len(roll)] == rows[size - 1 :]
    return rows[: len(roll)][whole], at[: len(roll)][whole], mix(roll[whole]), counts


def _windows(at: np.ndarray, names: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first position, running hash) of every n seeds in a row that are all free."""
    if len(at) < n:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    sums, powers = np.zeros(len(at) + 1, _U), np.full(len(at), BASE, _U)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    np.cumsum(names * powers, out=sums[1:])
    taken = np.concatenate(([0], np.cumsum(~free)))
    k = np.flatnonzero((at[n - 1 :] - at[: len(at) - n + 1] == n - 1) & (taken[n:] == taken[: len(at) - n + 1]))
    back = np.full(len(at), _INVERSE, _U)
    back[0] = 1
    return at[k], (sums[k + n] - sums[k]) * np.multiply.accumulate(back)[k]


def tiles(here: np.ndarray, doc: np.ndarray, item: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling (Wise, 1993) of one document and one item: (position in doc, in item, length), as marked.

    `item` names the item's seeds of `size` tokens in order; `doc` those of the document that are among them, and `here`
    (ascending) where. Running hashes of Karp and Rabin over n seeds, on both sides, show whether n + size - 1 unmarked tokens
    match; the largest such n is found by halving, and its matches are marked, of equals the one first in the item, then in the
    document. So it goes on with shorter ones until nothing of `size` tokens is left. Memory follows the two lengths.
    """
    _, both = np.unique(np.concatenate((item, doc)), return_inverse=True)
    values = mix(both.astype(_U) + _U(1))
    item, doc, there = values[: len(item)], values[len(item) :], np.arange(len(item))
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    out: list[tuple[int, int, int]] = []

    def common(n: int) -> tuple[np.ndarray, ...] | None:
        j, b = _windows(there, item, free_item, n)
        i, a = _windows(here, doc, free_doc, n)
        seen = np.isin(a, b)
        return (i[seen], a[seen], j, b) if seen.any() else None

    most = min(len(item), len(doc))
    while most:
        low, high, found = 0, most, None
        while low < high:
            n = (low + high + 1) // 2
            if got := common(n):
                low, found = n, got
            else:
                high = n - 1
        if not low:
            break
        i, a, j, b = found
        by = np.lexsort((i, a))
        i, a = i[by], a[by]
        first, last = np.searchsorted(a, b, side="left"), np.searchsorted(a, b, side="right")
        next_of: dict[int, int] = {}
        tokens, free_to_item = low + size - 1, -1
        marked: list[int] = []  # starts of this length's tiles in the document, ascending
        for q in range(len(j)):
            if j[q] < free_to_item or first[q] == last[q]:
                continue
            at = next_of.get(int(first[q]), int(first[q]))
            while at < last[q] and _overlaps(marked, int(i[at]), tokens):
                at += 1
            next_of[int(first[q])] = at
            if at == last[q]:
                continue
            out.append((int(i[at]), int(j[q]), tokens))
            insort(marked, int(i[at]))
            free_to_item = int(j[q]) + tokens
            # a seed is free as long as none of its tokens is marked
            free_item[max(0, j[q] - size + 1) : j[q] + tokens] = False
            lo, hi = np.searchsorted(here, (i[at] - size + 1, i[at] + tokens))
            free_doc[lo:hi] = False
        most = low - 1
    return out


def _overlaps(starts: list[int], at: int, n: int) -> bool:
    k = bisect_left(starts, at)
    return (k < len(starts) and starts[k] < at + n) or (k > 0 and starts[k - 1] + n > at)


_ROWS = "id long, at int, name long, tokens int"


def _seed_rows(size: int, bits: np.ndarray | None = None, whole: bool = False):
    """Rows of the seeds of (id, text): those in the filter; with `whole`, only of texts that have no more tokens."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, at, name, counts = seeds_of(b.column(1), size)
            if whole:
                only = counts[row] == size
                row, at, name = row[only], at[only], name[only]
            if bits is not None:
                slot = (name & _U(FILTER_BITS - 1)).astype(np.int64)
                may = bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 > 0
                row, at, name = row[may], at[may], name[may]
            ids = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row], pa.int64()), pa.array(at, pa.int32()), pa.array(name.view(np.int64)), pa.array(counts[row], pa.int32())], ["id", "at", "name", "tokens"])

    return rows


def _filter(seeds: DataFrame) -> np.ndarray:
    """The bits of all seeds' names, folded by Spark into words of 32 bits; at most FILTER_BITS / 32 rows come back."""
    slot = F.col("name").bitwiseAND(FILTER_BITS - 1)
    word = F.shiftright(slot, 5).alias("word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(31).cast("int"))
    rows = seeds.groupBy(word).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 32, "<u4")
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).astype("<u4")
    return out.view(np.uint8)


def _hits(docs: DataFrame, theirs: DataFrame, size: int) -> DataFrame:
    """(doc_id, here, name) of the documents' seeds of `size` tokens that pass the filter of the items' seeds."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter(theirs))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _seed_rows(size, bits.value)(batches)

    return docs.mapInArrow(hits, _ROWS).select(F.col("id").alias("doc_id"), F.col("at").alias("here"), "name")


def _met(docs: DataFrame, theirs: DataFrame, size: int) -> DataFrame:
    """(doc_id, item_id, item_tokens) of documents and items of `size` tokens that share a seed, once for each row of a document's seeds."""
    named = theirs.select("item_id", "name", "item_tokens").distinct()
    return _hits(docs, theirs, size).join(F.broadcast(named) if theirs.count() <= BROADCAST else named, "name")


def candidates(found: DataFrame, theirs: DataFrame, size: int, coverage: float, broadcast: bool) -> DataFrame:
    """(doc_id, item_id) once each, of pairs that may reach the threshold: all of those, and few others.

    Tiles cover at most `size` tokens for each seed of the item that matches, so a pair has to match a certain number of the
    item's seeds. An item's most frequent seeds, one fewer than that number, can then be left out: the pair matches another.
    So a seed that all documents and items share makes no pairs, unless it alone can reach the threshold. Seeds that are hot
    all the same are split by document where items aren't broadcast.
    """
    rows = found.select("doc_id", "name").distinct()
    often = checkpointed(rows.groupBy("name").agg(F.count("*").alias("often")))
    longest = Window.partitionBy("item_id")
    seeds = theirs.select("item_id", "there", "name", F.max("item_tokens").over(longest).alias("item_tokens")).distinct().join(often, "name")
    need = F.ceil(F.col("item_tokens") * coverage / size - 1e-9)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("often"), "there", "name"))
    kept = seeds.withColumn("rank", rank).filter(F.col("rank") >= need).select("item_id", "name").distinct()
    if broadcast:
        return rows.join(F.broadcast(kept), "name").select("doc_id", "item_id").distinct()
    total = often.agg(F.coalesce(F.sum("often"), F.lit(0))).first()[0]
    least = total // HOT + 1
    hot = F.broadcast(often.filter(F.col("often") >= least).select("name", F.floor(F.col("often") / least).alias("parts")))
    parts = F.coalesce("parts", F.lit(0))
    ours = rows.join(hot, "name", "left").select("doc_id", "name", F.pmod(F.xxhash64("doc_id"), parts + 1).alias("part"))
    split = kept.join(hot, "name", "left").select("item_id", "name", F.explode(F.sequence(F.lit(0).cast("long"), parts)).alias("part"))
    return ours.join(split, ["name", "part"]).select("doc_id", "item_id").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest, item_tokens): items of which a document holds `coverage` or more.

    `docs` has doc_id and text, `benchmark` item_id and text; others are ignored. Coverage is the share of an item's tokens
    in tiles of `size` or more tokens, so passages that were put in another order count in full. An item shorter than a
    seed is its own seed: a document that holds all its tokens in a row covers it in full, by one tile; an item without
    tokens is never found. Seeds of documents pass a fixed-size filter of the items' seeds before they are written; documents
    and items that share enough of them (named by 64 bits) are paired, and a pair's seeds are then tiled. Null or empty texts
    match nothing; rows with a null id are left out; of rows with equal ids the seeds are taken together, an item's tokens
    being the longest one's. Empty tables give no rows.
    """
    given = lambda t, key: t.filter(F.col(key).isNotNull()).select(F.col(key).cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ours, items = given(docs, "doc_id"), given(benchmark, "item_id")
    seeds = lambda n, whole: checkpointed(items.mapInArrow(_seed_rows(n, whole=whole), _ROWS).select(F.col("id").alias("item_id"), F.col("at").alias("there"), "name", F.col("tokens").alias("item_tokens")))
    theirs = seeds(size, False)
    few = theirs.count() <= BROADCAST

    @F.pandas_udf("covered long, n_tiles long, longest long")
    def tiled(matches: pd.Series, names: pd.Series, tokens: pd.Series) -> pd.DataFrame:
        out = []
        for m, item, n in zip(matches, names, tokens, strict=True):
            item = np.asarray(item, np.int64)
            here, doc = np.array([x["here"] for x in m], np.int64), np.array([x["name"] for x in m], np.int64)
            mine = np.isin(doc, item)
            here, doc = here[mine], doc[mine]
            found = []
            if np.isin(item, doc).sum() * size >= n * coverage:  # fewer seeds can't reach the threshold
                by = np.argsort(here, kind="stable")
                fresh = np.concatenate(([True], np.diff(here[by]) > 0))
                found = tiles(here[by][fresh], doc[by][fresh], item, size)
            out.append((sum(t[2] for t in found), len(found), max((t[2] for t in found), default=0)))
        return pd.DataFrame(out, columns=["covered", "n_tiles", "longest"])

    found = written(_hits(ours, theirs, size))
    pairs = checkpointed(candidates(found, theirs, size, coverage, few))
    held = found.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("here", "name")).alias("m"))
    whole = theirs.groupBy("item_id").agg(F.transform(F.sort_array(F.collect_set(F.struct("there", "name"))), lambda x: x["name"]).alias("names"), F.max("item_tokens").cast("long").alias("item_tokens"))
    able = pairs.join(held, "doc_id").join(F.broadcast(whole) if few else whole, "item_id")
    done = able.select("doc_id", "item_id", tiled("m", "names", "item_tokens").alias("t"), "item_tokens").select("doc_id", "item_id", (F.col("t.covered") / F.col("item_tokens")).alias("coverage"), "t.n_tiles", "t.longest", "item_tokens")
    done = done.filter(F.col("coverage") >= coverage)
    for n in range(1, size):
        short = seeds(n, True)
        if not short.isEmpty():
            met = _met(ours, short, n).select("doc_id", "item_id", F.lit(1.0).alias("coverage"), F.lit(1).cast("long").alias("n_tiles"), F.lit(n).cast("long").alias("longest"), F.col("item_tokens").cast("long").alias("item_tokens"))
            done = done.union(met.distinct())
    return done


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
