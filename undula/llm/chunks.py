"""Cutting texts into chunks that a byte-level BPE with the usual split pattern treats apart.

A text is split at single spaces. Every chunk but the first takes the space before it along. The split pattern gives the
same pieces for the chunks as for the whole text unless a space stands between two white-space characters (or one and the
end), where a run would be torn; such texts are treated whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

#: Characters of text that are worked on at a time, one text at least; and entries of a memo. Neither changes a result.
BATCH, MEMO = 8_000_000, 500_000
_TORN = re.compile(r"\s \s|\s \Z")


def torn(text: str) -> bool:
    """Whether chunks of `text` can't be treated apart."""
    return _TORN.search(text) is not None


def batches(texts: Iterable[str], size: int = BATCH) -> Iterator[list[str]]:
    out, held = [], 0
    for t in texts:
        out.append(t)
        held += len(t)
        if held >= size:
            yield out
            out, held = [], 0
    if out:
        yield out


class ChunkMemo(dict):
    """Values of chunks; `work` gets the list of those of a batch that are missing and returns their values in order."""

    def __init__(self, work: Callable[[list[str]], Iterable], most: int = MEMO):
        super().__init__()
        self.work, self.most = work, most

    def learn(self, chunked: Iterable[list[str]]) -> None:
        """Makes every chunk of a batch known. A memo that has grown too large is emptied first."""
        if len(self) > self.most:
            self.clear()
        found: set[str] = set()
        for chunks in chunked:
            found.update(chunks)
        missing = list(found.difference(self))
        self.update(zip(missing, self.work(missing), strict=True))
