"""The trie of conversations against brute force: nulls, ties, repeats, turnless and very long conversations, one hot sequence."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from undula.llm import prefix_trie

ROWS = "conv_id long, turn long, role string, text string, depth long, n long, k1 long, name string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) if children[node] else 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[x] for x in children[node])
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
        for node, m in members.items()
    )


def given(spark, rows):
    return spark.createDataFrame([(*r, 7, 7, 7, "x") for r in rows], ROWS)


def nodes(df, band=prefix_trie.BAND):
    got = prefix_trie.trie(prefix_trie.grafted(prefix_trie.numbered(df)), band)
    assert dict(got.dtypes) == {k: "bigint" for k in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")} | {"ends_sha256": "string"}
    return sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0], r[1]))


def odd_rows(seed):
    rng = random.Random(seed)
    rows = [(None, 0, "user", "nobody's"), (None, 1, None, None)]
    for c in [*range(-120, 20), *range(300, 320), 2**40, 5005, -(2**40)]:
        for turn in range(rng.choice((1, 1, 2, 3, 9))):
            rows.append((c, rng.choice((turn, turn, None, 0)), rng.choice(("user", "a", None, "")), rng.choice(("x", "y", "", None, "é日", "longer text"))))
    return rows + rows[5:40:3]


@pytest.mark.parametrize("band", [2, 4])
def test_odd_rows_equal_brute_force(spark, band):
    rows = odd_rows(band)
    assert nodes(given(spark, rows), band) == brute(rows)


def test_a_hot_conversation_and_a_hot_ending(spark):
    """One conversation of a third of all rows, far deeper than a band of bands, and one that 3,000 others copy."""
    rows = [(7, k, "user", f"t{k % 5}") for k in range(3000)] + [(1000 + 100 * k, 0, "user", "hello") for k in range(3000)] + [(1000 + 100 * k, 1, "a", "hi") for k in range(0, 3000, 2)]
    block, heavy = prefix_trie.BLOCK, prefix_trie.HEAVY
    prefix_trie.BLOCK, prefix_trie.HEAVY = 64, 10
    try:
        assert nodes(given(spark, rows)) == brute(rows)
    finally:
        prefix_trie.BLOCK, prefix_trie.HEAVY = block, heavy


def test_turnless_and_empty(spark):
    lone = [(c, 0, "user", "z") for c in range(501, 520)]  # their base is absent: those that graft keep no turn
    assert nodes(given(spark, lone)) == brute(lone)
    assert nodes(given(spark, [])) == [] and nodes(given(spark, [(None, 1, "a", "b")])) == []
    long_text = [(1, 0, "user", "é" * 3_000_000), (101, 0, "user", "é" * 3_000_000)]
    assert nodes(given(spark, long_text)) == brute(long_text)
