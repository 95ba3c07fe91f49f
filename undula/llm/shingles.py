"""Near-duplicates by word shingles: fingerprints that meet in the middle, then short min-wise ones, verified by exact Jaccard similarity.

The balls of `simhash` come first: fingerprints of five-word shingles that differ in two bits or fewer meet in a variant. They
find copies with few changes, but at a similarity of 0.8 some ten of 64 bits differ, and balls of that radius can't be
emitted. So every set of shingles also has BANDS fingerprints of WIDTH minima each. Two sets of similarity s share one with
probability 1 - (1 - s ** WIDTH) ** BANDS: at s = 0.8 all but some three in a million pairs meet, above it more. What meets is
compared by its whole sets, so nothing is linked wrongly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.llm import simhash
from undula.llm.components import components
from undula.llm.shared import checkpointed, written

SHINGLE, BANDS, WIDTH = 5, 32, 5
#: The least similarity of a link, as a fraction.
ABOVE, BELOW = 4, 5
#: Minima (their low bytes) that must be equal before whole sets are compared.
AGREE = 96
#: Most names of sets that are broadcast, so that other sets aren't shuffled.
BROADCAST = 1_000_000
#: Rounds in which a fingerprint's sets are compared with one of them, before all that are still apart are compared.
STARS = 2
#: Sets of a block that ask, and hashes of a block that answer; neither changes a result.
ASKS, ROOM = 256, 1 << 20
#: Shingles whose minima are taken at a time, and texts whose results a task holds.
_BLOCK, _TEXTS = 1 << 12, 256
_RNG = np.random.default_rng(5)
_TURN, _FLIP = _RNG.integers(0, 1 << 63, (2, BANDS * WIDTH), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct XXH64 of a text's shingles, ascending; words as in `simhash.fingerprint`, fewer than a shingle make one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: max(1, len(words) - shingle + 1)].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    return np.unique(np.fromiter((digest(joined[i:j]) for i, j in zip(starts, ends, strict=True)), np.uint64, len(starts)))


def minima(own: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * WIDTH, ~np.uint64(0))
    for k in range(0, len(own), _BLOCK):
        low = np.minimum(low, ((own[k : k + _BLOCK] ^ _FLIP[:, None]) * _TURN[:, None]).min(1))
    return low


def _name(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64))


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, own, n, fp, bands, sketch) of (key, text), some texts at a time."""
    for b in batches:
        for k in range(0, len(b), _TEXTS):
            part, out = b.iloc[k : k + _TEXTS], []
            for text in part["text"]:
                s = shingle_set(text)
                low = minima(s)
                bands = np.array([xxhash.xxh64_intdigest(row.tobytes(), j) for j, row in enumerate(low.reshape(BANDS, WIDTH))], np.uint64)
                sketch = ((low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()
                out.append((_name(s), len(s), simhash.fingerprint(text, SHINGLE), bands.view(np.int64), sketch))
            yield pd.DataFrame(out, columns=["own", "n", "fp", "bands", "sketch"]).assign(key=part["key"].to_numpy())[["key", "own", "n", "fp", "bands", "sketch"]]


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(own, hashes) of (text), some texts at a time."""
    for b in batches:
        for k in range(0, len(b), _TEXTS):
            sets = [shingle_set(t) for t in b["text"].iloc[k : k + _TEXTS]]
            yield pd.DataFrame({"own": [_name(s) for s in sets], "hashes": [s.view(np.int64) for s in sets]})


def _agree(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([np.count_nonzero(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)) for x, y in zip(a, b, strict=True)], dtype="int32")


def _alike(a: Column, b: Column, common: Column) -> Column:
    return BELOW * common >= ABOVE * (a + b - common)


def _in_balls(sets: DataFrame) -> DataFrame:
    """(a, b) of sets whose fingerprints meet in a variant, as many as connect every group of fingerprints."""
    first = sets.groupBy("fp").agg(F.min("own").alias("first"))
    same = sets.select("own", "fp").join(first, "fp").select(F.col("first").alias("a"), F.col("own").alias("b"))
    met = simhash.links(first.select("fp"))
    for side in ("a", "b"):
        met = met.withColumnRenamed(side, "fp").join(first, "fp").drop("fp").withColumnRenamed("first", side)
    both = same.union(met.select("a", "b")).filter("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _in_stars(places: DataFrame, star: int) -> DataFrame:
    """(a, b) of every set and one set of each of its bands, if they aren't connected yet and have sizes that allow a link.

    The one set is found by a combined aggregate and joined back, so that a band that very many sets share is never gathered.
    """
    lowest = F.min(F.struct(F.xxhash64("own", F.lit(star)).alias("h"), "own", "n", "root")).alias("x")
    one = places.groupBy("band").agg(lowest, F.count("*").alias("c")).filter("c > 1").select("band", "x")
    both = places.select("band", F.struct("own", "n", "root").alias("y")).join(one, "band").select("x", "y")
    both = both.filter("x.own <> y.own and x.root <> y.root").filter(_alike(F.col("x.n"), F.col("y.n"), F.least("x.n", "y.n")))
    return both.select(F.least("x.own", "y.own").alias("a"), F.greatest("x.own", "y.own").alias("b")).distinct()


def _compared(block: pd.DataFrame) -> pd.DataFrame:
    """(a, b) links of the sets of a block that ask, with those that answer and share a band: one for each root that a set reaches."""
    asks, rest = (block[block["ask"] == x].reset_index(drop=True) for x in (True, False))
    if not len(asks) or not len(rest):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    sizes = rest["hashes"].map(len).to_numpy(np.int64)
    flat = np.concatenate([*rest["hashes"], *asks["hashes"]])
    codes, flat = np.unique(flat, return_inverse=True)
    marked, ends = np.zeros(len(codes), bool), np.concatenate(([0], np.cumsum(sizes)))
    bands, root, own, found = np.stack(rest["bands"].to_list()), rest["root"].to_numpy(), rest["own"].to_numpy(), []
    at = int(ends[-1])
    for x in asks.itertuples():
        n = len(x.hashes)
        mine, at = flat[at : at + n], at + n
        near = np.flatnonzero((root != x.root) & (BELOW * np.minimum(sizes, n) >= ABOVE * np.maximum(sizes, n)))
        near = near[(bands[near] == np.asarray(x.bands)).any(1)]
        if not len(near):
            continue
        marked[mine] = True
        size = sizes[near]
        starts = np.cumsum(size) - size
        common = np.add.reduceat(marked[flat[np.repeat(ends[near] - starts, size) + np.arange(size.sum())]].astype(np.int64), starts)
        marked[mine] = False
        near = near[BELOW * common >= ABOVE * (size + n - common)]
        near = near[np.unique(root[near], return_index=True)[1]]
        found.append((np.full(len(near), x.own, np.int64), own[near]))
    return pd.DataFrame({"a": np.concatenate([a for a, _ in found] or [own[:0]]), "b": np.concatenate([b for _, b in found] or [own[:0]])})


def _in_blocks(places: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) links between what is still apart in some band, compared in blocks; no pair becomes a row unless it links.

    In every band those outside its most frequent component ask and all answer. Sets that ask for one component are kept together,
    about ASKS, and each set that shares a band with one of them goes to their block once; blocks are cut again by ROOM. A band
    names the blocks that ask in it as bits of 64 blocks a word, and a set's words are or-ed before they become rows, so however
    many bands a set and a block share, they meet in one row.
    """
    counted = places.groupBy("band", "root").agg(F.count("*").alias("c"))
    top = counted.groupBy("band").agg(F.max(F.struct("c", "root"))["root"].alias("top"), F.count("*").alias("roots")).filter("roots > 1").select("band", "top")
    met = written(places.join(top, "band").select("own", "n", "root", "band", "top"))
    asking = met.filter("root <> top").groupBy("own").agg(F.min("top").alias("top"))
    many = asking.groupBy("top").agg(F.ceil(F.count("*") / ASKS).alias("parts"))
    blocks = max(1, -(-asking.count() // ASKS))
    block = F.pmod(F.pmod(F.xxhash64("top"), F.lit(blocks)) + F.pmod(F.xxhash64("own", F.lit(3)), F.col("parts")), F.lit(blocks))
    asking = written(asking.join(many, "top").select("own", block.alias("block")))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("block", F.lit(64)).cast("int"))
    word = F.floor(F.col("block") / 64).alias("word")
    asked = met.filter("root <> top").join(asking, "own").groupBy("band", word).agg(F.bit_or(bit).alias("bits"))
    answers = met.select("own", "n", "root", "band").join(asked, "band").groupBy("own", "n", "root", "word").agg(F.bit_or("bits").alias("bits"))
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("getbit", F.col("bits"), k) == 1)
    answers = written(answers.select("own", "n", "root", F.explode(F.transform(set_bits, lambda k: F.col("word") * 64 + k)).alias("block")))
    room = answers.groupBy("block").agg(F.ceil(F.sum(F.col("n") + 64) / ROOM).alias("chunks"))
    chunk = F.pmod(F.xxhash64("own", F.lit(4)), F.col("chunks"))
    root = met.select("own", "root").distinct()
    asks = asking.join(root, "own").join(room, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    places_of = asks.select("own", "root", "block", "chunk", F.lit(True).alias("ask"))
    places_of = places_of.union(answers.join(room, "block").select("own", "root", "block", chunk.alias("chunk"), F.lit(False).alias("ask")))
    whole = written(_whole_sets(answers.select("own").distinct(), sets, texts).join(sets.select("own", "bands"), "own"))
    return places_of.join(whole, "own").groupBy("block", "chunk").applyInPandas(_compared, "a long, b long").distinct()


def _whole_sets(some: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(own, hashes) of some sets, made anew from one text of each."""
    asked = written(sets.select("own", "key").join(some, "own").select("key"))
    asked = F.broadcast(asked) if asked.count() <= BROADCAST else asked
    again = texts.join(asked, "key", "left_semi").dropDuplicates(["key"])
    return again.select("text").mapInPandas(_whole, "own long, hashes array<long>")


def groups(docs: DataFrame) -> DataFrame:
    """(key, own, root) for every row of `docs` (key, text): rows of one root are near-duplicates, linked directly or not.

    Sets link at a Jaccard similarity of ABOVE / BELOW or more; texts without words are equal. Copies share a set and are
    compared once. A pair that other links already connect isn't compared. Whole sets are made anew from the texts of those
    that are compared, and only of those. An empty table gives no rows; null texts count as empty, repeated rows stay.
    """
    agree = F.pandas_udf(_agree, "int")
    texts = docs.select("key", F.col("text").cast("string").alias("text"))
    rows = written(texts.mapInPandas(_measured, "key long, own long, n int, fp long, bands array<long>, sketch binary"))
    of = [F.min(c).alias(c) for c in ("key", "n", "fp", "bands", "sketch")]
    sets = written(rows.groupBy("own").agg(*of))
    places = written(sets.select("own", F.col("n").cast("long").alias("n"), F.explode("bands").alias("band")))
    roots, links, tested = None, [], []

    def now() -> DataFrame:
        if roots is None:
            return places.withColumn("root", F.col("own"))
        return places.join(roots.withColumnRenamed("node", "own"), "own", "left").withColumn("root", F.coalesce("root", "own"))

    for star in range(STARS):
        pairs = _in_stars(now(), star)
        if not star:
            pairs = pairs.union(_in_balls(sets)).distinct()
        for known in tested:
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        pairs = written(pairs)
        if pairs.isEmpty():
            continue
        tested.append(pairs)
        for side in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("own").alias(side), F.col("sketch").alias(f"s{side}")), side)
        pairs = written(pairs.filter(agree("sa", "sb") >= AGREE).select("a", "b"))
        whole = written(_whole_sets(pairs.select(F.col("a").alias("own")).union(pairs.select("b")).distinct(), sets, texts))
        j = pairs.join(whole.select(F.col("own").alias("a"), F.col("hashes").alias("ha")), "a").join(whole.select(F.col("own").alias("b"), F.col("hashes").alias("hb")), "b")
        fine = j.filter(_alike(F.size("ha"), F.size("hb"), F.size(F.array_intersect("ha", "hb")))).select("a", "b")
        links.append(checkpointed(fine))
        roots = components(reduce(DataFrame.union, links), "a", "b")
    if roots is not None or not places.isEmpty():
        more = checkpointed(_in_blocks(written(now()), sets, texts))
        if not more.isEmpty():
            roots = components(reduce(DataFrame.union, [*links, more]), "a", "b")
    out = rows.select("key", "own")
    if roots is None:
        return out.withColumn("root", F.col("own"))
    return out.join(roots.withColumnRenamed("node", "own"), "own", "left").select("key", "own", F.coalesce("root", "own").alias("root"))
