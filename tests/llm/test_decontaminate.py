"""Pairs that decontamination tiles: all that may reach the threshold, and no product of a seed that everything shares."""

import random

import pytest

from undula.llm import decontaminate as D

LINE = "terms of use apply here"


def frames(spark, n, rng):
    say = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    items = [(j, f"{say(20)} {LINE} {say(20)}") for j in range(n)]
    docs = [(j, f"{say(30)} {LINE} {say(30)}") for j in range(n)]
    docs += [(n + j, f"{say(10)} {items[j][1]} {say(10)}") for j in range(5)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def pairs(spark, docs, items, broadcast):
    seeds = items.mapInArrow(D._seed_rows(D.SEED), D._ROWS).selectExpr("id AS item_id", "at AS there", "name", "tokens AS item_tokens")
    return D.candidates(D._hits(docs, seeds, D.SEED), seeds, D.SEED, D.COVERAGE, broadcast)


@pytest.mark.parametrize("broadcast", [True, False])
def test_a_seed_in_all_items_and_documents_stays_linear(spark, broadcast):
    docs, items = frames(spark, 2000, random.Random(1))
    assert sorted(map(tuple, pairs(spark, docs, items, broadcast).collect())) == [(2000 + j, j) for j in range(5)]


@pytest.mark.parametrize("most", [D.BROADCAST, 0])
def test_leaks_with_a_shared_line(spark, monkeypatch, most):
    monkeypatch.setattr(D, "BROADCAST", most)
    docs, items = frames(spark, 100, random.Random(2))
    got = D.contaminated(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["coverage"]) for r in got) == [(100 + j, j, 1.0) for j in range(5)]


@pytest.mark.parametrize("most", [D.BROADCAST, 0])
def test_pairs_lose_nothing(spark, monkeypatch, most):
    monkeypatch.setattr(D, "BROADCAST", most)
    monkeypatch.setattr(D, "HOT", 20)
    rng = random.Random(3)
    say = lambda k: " ".join(rng.choice("abc") for _ in range(k))
    items = [(j, say(rng.randint(5, 40))) for j in range(25)]
    docs = [(j, " ".join(rng.choice([say(8), " ".join(rng.choice(items)[1].split()[: rng.randint(3, 30)])]) for _ in range(4))) for j in range(40)]
    seeds = lambda t: {tuple(t.split()[i : i + D.SEED]) for i in range(len(t.split()) - D.SEED + 1)}
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    kept = set(map(tuple, pairs(spark, d, b, most > 0).collect()))
    for k, text in docs:
        own = seeds(text)
        for j, item in items:
            words = item.split()
            n = sum(tuple(words[i : i + D.SEED]) in own for i in range(len(words) - D.SEED + 1))
            assert n * D.SEED < len(words) * D.COVERAGE or (k, j) in kept
    assert {(r["doc_id"], r["item_id"]) for r in D.contaminated(d, b).collect()} <= kept
