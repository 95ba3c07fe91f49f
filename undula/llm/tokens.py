"""Tokens of text columns and their names, as arrays over whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
BASE = 0xC2B2AE3D27D4EB4F
#: Bytes of texts that are worked on at a time; a longer text is taken alone. It bounds memory and changes no result.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int, cache: dict[str, tuple[np.ndarray, np.ndarray]] = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if "p" not in cache or len(cache["p"][0]) < n:
        up, down = np.full(n, BASE, _U), np.full(n, pow(BASE, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        cache["p"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return cache["p"]


#: Bytes of tokens: ASCII letters and digits, and all of characters beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_VALUE = mix(np.arange(1, 257, dtype=_U))


class Tokens:
    """Tokens of the texts of a slice: rows of the column they stand in, starts and ends in the slice's bytes."""

    def __init__(self, part: np.ndarray, cuts: np.ndarray, first_row: int):
        word = _WORD[part]
        opens = word.copy()
        opens[1:] &= ~word[:-1]
        begun = cuts[:-1][cuts[:-1] < len(part)]
        opens[begun] = word[begun]  # a token never goes on into the next text
        closes = np.zeros(len(part) + 1, bool)
        closes[1:] = word
        closes[1:-1] &= ~word[1:] | opens[1:]
        self.lo, self.hi = np.flatnonzero(opens), np.flatnonzero(closes)
        self.rows = np.searchsorted(cuts[1:], self.lo, side="right") + first_row
        up, self.down = _powers(len(part))
        self.sums = np.zeros(len(part) + 1, _U)
        np.cumsum(_VALUE[part] * up[: len(part)], out=self.sums[1:])

    def names(self, longest: int | None = None) -> np.ndarray:
        """64 bits of every token's bytes (of its first `longest`), the same wherever it stands: Karp and Rabin's rolling form."""
        hi = self.hi if longest is None else np.minimum(self.hi, self.lo + longest)
        return mix((self.sums[hi] - self.sums[self.lo]) * self.down[self.lo])


def tokens(column: pa.Array) -> Iterator[Tokens]:
    """Tokens of a string column, some texts at a time: lower case, runs of letters, digits and characters beyond ASCII."""
    column = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    k = 0
    while k < len(column):  # as many texts as fit a slice, one at least
        m = max(k + 1, int(np.searchsorted(offsets, offsets[k] + SLICE, side="right")) - 1)
        if offsets[m] > offsets[k]:
            yield Tokens(data[offsets[k] : offsets[m]], offsets[k : m + 1] - offsets[k], k)
        k = m


def token_names(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, name) of every token of a string column."""
    found = [(t.rows, t.names()) for t in tokens(column)]
    return (np.concatenate([r for r, _ in found]), np.concatenate([n for _, n in found])) if found else (np.zeros(0, np.int64), np.zeros(0, _U))
