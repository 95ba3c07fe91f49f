"""Packing token sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import base64
import heapq
import zlib
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.shared import checkpointed, table

WINDOW, END_ID = 2048, 1
#: A document's rest beyond its full windows is cut every so many tokens; smaller pieces level windows better.
GRAIN = 512
#: Documents that are packed together, on average. It doesn't grow with the input; more blocks do. And blocks of a task.
BLOCK, PER_TASK = 2048, 4


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes, equal to the ids that `tokenizers` gives for the .json file.

    The .tiktoken file holds the same vocabulary as ranks and its library encodes faster; texts that hold a special token's
    string go to `tokenizers` itself, as do those that are too much for the other library's patterns (a run of a million spaces).
    """

    def __init__(self, json_path: str, ranks_path: str):
        self.whole = tokenizers.Tokenizer.from_file(json_path)
        self.whole.no_padding()
        self.whole.no_truncation()
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not any(x in text for x in self.special):
            try:
                return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
            except ValueError:  # its patterns' stack is bounded
                pass
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str) -> Encoder:
    return Encoder(json_path, ranks_path)


def cuts(n: int, window: int, grain: int) -> list[int]:
    """Where the pieces of a document of n tokens end: every `window` while it fills one, then every `grain`."""
    full = n // window * window
    return [*range(window, full + 1, window), *range(full + grain, n, grain), *([n] if n > full else [])]


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """The indexes of `sizes` in k subsets of near-equal sums, by Karmarkar and Karp's differencing generalised to k.

    Every item starts as a partial partition of k sums, all zero but one. The two partial partitions with the largest
    spread are merged, the large sums of one onto the small ones of the other, until one is left. Zero sums aren't stored.
    """
    if k == 1:
        return [[*range(len(sizes))]]
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]  # (-spread, tie, sums descending with the tree of their items)
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        apart = max(0, k - len(a))  # as many of b's largest sums meet zeros of a
        both = a + b[:apart]
        for at, (s, tree) in zip(range(len(a) - 1, -1, -1), b[apart:], strict=False):
            both[at] = (both[at][0] + s, (both[at][1], tree))
        both.sort(key=itemgetter(0), reverse=True)
        if len(both) == k and (low := both[-1][0]):
            both = [(s - low, tree) for s, tree in both]
        heapq.heappush(heap, (-(both[0][0] - (both[-1][0] if len(both) == k else 0)), tie, both))
        tie += 1
    out = []
    for _, tree in heap[0][2] if heap else []:
        items, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                items.append(x)
        out.append(items)
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """`sizes` (each at most `capacity`) in as few near-equal windows as differencing fits; one more whenever one overflows."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = difference(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return found
        k += 1


def packed(
    docs: DataFrame, json_path: str | None = None, ranks_path: str | None = None, window: int = WINDOW, grain: int = GRAIN, block: int = BLOCK
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `docs` has doc_id and text; others are ignored. A null text counts as empty and is its end id alone. Full windows of
    a document are sequences of their own. The rests, cut every `grain` tokens, are packed in blocks of about `block`
    documents, dealt out by the row's own number, so that rows equal in id and text spread like any others; the number of
    blocks follows the number of rows. Sequence ids are unique, not gapless. Repeated rows are packed each; null ids stay
    null; an empty table gives no rows.
    """
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    end = np.array([END_ID], "<u4").tobytes()

    @F.pandas_udf("n long, crcs array<long>")
    def encoded(texts: pd.Series) -> pd.DataFrame:
        n, crcs = [], []
        for t in texts:
            ids = memoryview(encoder(json_path, ranks_path).ids(t) + end)
            to = cuts(len(ids) // 4, window, grain)
            n.append(len(ids) // 4)
            crcs.append([zlib.crc32(ids[4 * i : 4 * j]) for i, j in zip([0, *to], to, strict=False)])
        return pd.DataFrame({"n": n, "crcs": crcs})

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "n"], kind="stable")
        full, rest = [], []
        for doc, n, crcs in zip(rows["doc_id"], rows["n"], rows["crcs"], strict=True):
            to = cuts(n, window, grain)
            for i, j, crc in zip([0, *to], to, crcs, strict=False):
                (full if j - i == window else rest).append((doc, i, j - i, crc, n))
        out, base = [], int(key[0]) << 32
        for piece in full:
            out.append((*piece, base, 0))
            base += 1
        for w in windows([p[2] for p in rest], window) if rest else []:
            at = 0
            for i in sorted(w):
                out.append((*rest[i], base, at))
                at += rest[i][2]
            base += 1
        made = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        return made.astype({"doc_id": "Int64"})

    own = checkpointed(docs.select(F.col("doc_id").cast("long"), encoded(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("e")).select("doc_id", "e.*"))
    blocks = max(1, round(own.count() / block))
    # the checkpoint's partitions are files, so a row keeps its number however often it is read
    placed = own.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))).repartition(-(-blocks // PER_TASK), "block")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.groupBy("block").applyInPandas(pack, schema)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
