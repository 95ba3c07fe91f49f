"""The pipeline's stages do the whole job: links by shingles, rows judged one by one."""

import itertools
import random

import corpus_pipeline
from undula.llm import shingles

STAGE = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string"


def five(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Keys of rows by the smallest index that links of 0.8 or more reach."""
    sets, root = [five(t) for t in rows], list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if not sets[a] | sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    return root


def test_near_duplicates_equal_brute_force_jaccard(spark, sf):
    real = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    rng = random.Random(8)
    chain = [f"w{rng.randint(0, 900)}" for _ in range(300)]
    near = [" ".join(chain)]
    for _ in range(6):  # each alike the one before, the last unlike the first
        chain = [f"v{rng.randint(0, 900)}" if rng.random() < 0.015 else w for w in chain]
        near.append(" ".join(chain))
    texts = [*real, *near, "", None, "one", "ONE", "one two three", real[0]]
    got = STAGE["near_duplicates"](spark, spark.createDataFrame(list(enumerate(texts)), SCHEMA), sf)
    want = brute(texts)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(want))


def test_blocks_link_what_brute_force_links(spark, monkeypatch):
    """Near copies around the limit, in small blocks, with and without stars before them."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(f"v{rng.randint(0, 9000)}" if rng.random() < 0.02 else w for w in base) for _ in range(60)]
    texts += [f"other {k % 4} words of {k} texts that stand alone" for k in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    want = {frozenset(k for k, r in enumerate(brute(texts)) if r == root) for root in brute(texts)}
    assert 2 < len(want) < 60 and max(map(len, want)) > 10
    monkeypatch.setattr(shingles, "ASKS", 4)
    monkeypatch.setattr(shingles, "ROOM", 2000)
    for stars in (0, 2):
        monkeypatch.setattr(shingles, "STARS", stars)
        groups = {}
        for r in shingles.groups(docs).collect():
            groups.setdefault(r["root"], set()).add(r["key"])
        assert {frozenset(g) for g in groups.values()} == want
    assert shingles.groups(docs.limit(0)).count() == 0


def test_minima_of_a_long_text(monkeypatch):
    own = shingles.shingle_set(" ".join(str(k * k) for k in range(700)))
    want = shingles.minima(own)
    monkeypatch.setattr(shingles, "_BLOCK", 64)
    assert (shingles.minima(own) == want).all() and len(own) == 696


def test_rows_are_judged_one_by_one(spark, sf, tmp_path):
    item = " ".join(f"item{k}" for k in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clean = ["one quiet river ran through the old town today", "a second unrelated text on tables and chairs"]
    rows = [(None, f"so {item} it is"), (4, item), (4, clean[0]), (None, clean[1]), (5, clean[0]), (4, clean[1])]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = lambda name: sorted(((r["doc_id"], r["text"]) for r in STAGE[name](spark, docs, str(tmp_path)).collect()), key=repr)
    assert kept("quality") == sorted(rows, key=repr)  # no label, no model
    assert kept("decontamination") == sorted(rows[2:], key=repr)
    assert kept("near_duplicates") == sorted([rows[1], rows[2], rows[5]], key=repr)  # the first is alike the second (16 of 19 shingles)


def test_columns_named_like_keys_stay(spark, sf):
    rows = [(1, "some clean words of a text that goes on and on", 77, 5), (2, "other clean words of another text, and no more", 78, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key long, _KEY_ long")
    for name in ("quality", "near_duplicates", "decontamination", "personal_data"):
        got = {r["doc_id"]: (r["_key"], r["_KEY_"]) for r in STAGE[name](spark, docs, sf).collect()}
        assert set(got.items()) <= {(1, (77, 5)), (2, (78, 6))} and (got or name == "quality")
