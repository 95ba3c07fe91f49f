"""Token counts by heap-and-linked-list byte-pair merging: initial symbols less merges, without token ids."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.chunks import MEMO, ChunkMemo, batches, torn
from undula.llm.shared import table

LIMIT = 512
#: Symbols that are merged at a time; a longer piece is taken alone. It bounds memory and changes no count.
SYMBOLS = 2_000_000
_BARRIER = 0xFFFF


def _byte_symbols() -> dict[int, str]:
    """The printable stand-in of every byte in a byte-level vocabulary: itself if printable Latin-1, else 256, 257, ..."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class MergeCounter:
    """Counts what a byte-level BPE makes of texts."""

    def __init__(self, path: str, memo: int = MEMO):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        vocab, merges = said["model"]["vocab"], said["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        if len(vocab) > _BARRIER:
            raise ValueError(f"a vocabulary of up to {_BARRIER} symbols is supported")
        self.symbol = np.array([vocab[c] for _, c in sorted(_byte_symbols().items())], np.uint32)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.uint32)
        self.same = np.array([a == b for a, b in pairs], bool)
        special = [t["content"] for t in said.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.pieces: dict[str, int] = {}
        self.chunks = ChunkMemo(self._chunk_counts, memo)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, -1 for a pair that doesn't merge."""
        key = left << np.uint32(16) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], np.int32(-1))

    def merged(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of every piece when the adjacent pair of lowest rank is merged until none has a rank.

        The pieces share one heap of ranks and one linked list (`after`, `before`) with barriers between them: the lowest
        rank is popped and its pairs are merged together, the leftmost of overlapping ones first. A pair with the symbol
        just made has a higher rank than that symbol, so no popped rank comes back. `pair` has the rank of the pair that
        starts at a position, so that what a merge has changed since it was pushed is skipped. Count: initial symbols
        minus merges, which are the positions that died.
        """
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        total = len(data) + len(pieces)
        s = np.full(total, _BARRIER, np.uint32)
        s[np.arange(len(data)) + np.repeat(np.arange(len(pieces)), lengths)] = self.symbol[data]
        after, before = np.arange(1, total + 1, dtype=np.int32), np.arange(-1, total - 1, dtype=np.int32)
        pair, stamp = np.full(total, -1, np.int32), np.zeros(total, np.int32)
        pair[:-1] = self.rank(s[:-1], s[1:])
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def push(at: np.ndarray) -> None:
            ranks = pair[at]
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            if not len(at):
                return
            by = np.argsort(ranks, kind="stable")
            at, ranks = at[by], ranks[by]
            edges = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(at)]
            for r, i, j in zip(ranks[edges[:-1]].tolist(), edges[:-1], edges[1:], strict=True):
                if r in waiting:
                    waiting[r].append(at[i:j])
                else:
                    waiting[r] = [at[i:j]]
                    heapq.heappush(heap, r)

        push(np.arange(total, dtype=np.int32))
        step = 0
        while heap:
            r = heapq.heappop(heap)
            i = np.concatenate(waiting.pop(r))
            i = i[pair[i] == r]
            if self.same[r] and len(i) > 1:  # in a run of equal symbols every other pair, from the left
                i.sort()
                runs = np.concatenate(([True], after[i[:-1]] != i[1:]))
                place = np.arange(len(i)) - np.maximum.accumulate(np.where(runs, np.arange(len(i)), 0))
                i = i[place % 2 == 0]
            if not len(i):
                continue
            step += 1
            j = after[i]
            k = after[j]
            s[i] = self.made[r]
            pair[j] = -2
            after[i] = k
            before[k] = i
            stamp[i] = step
            p = before[i]
            p = p[(p >= 0) & (stamp[p] != step)]
            pair[i] = self.rank(s[i], s[k])
            pair[p] = self.rank(s[p], s[after[p]])
            push(np.concatenate((i, p)))
        ends = np.cumsum(lengths + 1)
        alive = np.concatenate(([0], np.cumsum(pair != -2)))
        return alive[ends] - alive[ends - lengths - 1] - 1

    def _learn(self, pieces: set[str]) -> None:
        missing = [p for p in pieces if p not in self.pieces]
        data = [p.encode("utf-8", "surrogatepass") for p in missing]
        start, held = 0, 0
        for n, x in enumerate(data):
            held += len(x)
            if held >= SYMBOLS or n == len(data) - 1:
                self.pieces.update(zip(missing[start : n + 1], self.merged(data[start : n + 1]).tolist(), strict=True))
                start, held = n + 1, 0

    def _chunk_counts(self, chunks: list[str]) -> list[int]:
        cut = [(" " + c,) if c.isalpha() else self.split(" " + c) for c in chunks]
        self._learn({p for c in cut for p in c})
        known = self.pieces
        return [sum(known[p] for p in c) for c in cut]

    def counts(self, texts: Iterable[str | None]) -> list[int]:
        """Tokens of every text. A special token's string counts as one and parts what stands around it."""
        out: list[int] = []
        for batch in batches([t or "" for t in texts]):
            chunked, loose, ones = [], [], []
            for t in batch:
                parts, n = [t], 0
                if self.special is not None and self.special.search(t):
                    parts, n = self.special.split(t), sum(1 for _ in self.special.finditer(t))
                ones.append(n)
                if len(parts) == 1 and t and not torn(t):
                    first, *rest = t.split(" ")
                    chunked.append(rest)
                    loose.append(self.split(first))
                else:
                    chunked.append([])
                    loose.append([p for x in parts for p in self.split(x)])
            if len(self.pieces) > self.chunks.most:
                self.pieces.clear()
            self.chunks.learn(chunked)
            self._learn({p for x in loose for p in x})
            chunk, piece = self.chunks.__getitem__, self.pieces.__getitem__
            out += [n + sum(map(chunk, c)) + sum(map(piece, x)) for n, c, x in zip(ones, chunked, loose, strict=True)]
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    """One for each worker process and vocabulary."""
    return MergeCounter(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of `docs` (doc_id, text; others are ignored).

    `path` is a byte-level BPE file (.json). Null text counts as empty: no bytes, no tokens. Null ids and repeated rows
    stay as they are; an empty table gives no rows. A map over rows: nothing is shuffled.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series(counter(path).counts(texts), dtype="int64")

    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counted = docs.select("doc_id", F.octet_length(whole).cast("long").alias("n_bytes"), tokens(whole).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
