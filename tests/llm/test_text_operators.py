"""Token counts, packing, suffix and SimHash duplicates against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

from undula.llm import components, packing, simhash, suffix_dedup, token_count

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, u long, v long, n long, block int"
ODD = [None, "", " ", "\n \n", "a", "  a  b ", "x <|endoftext|> y<|endoftext|>", "don't I'LL 123 ४५ ²½x", "é" * 300, "日本語 テスト  x\r\n y", "aaaa" * 200 + "b", "ab " * 500, "tail  ", "a\n \n b"]


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names clash with those that operators use inside."""
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, 2, 3, 4, 5) for i, t in zip(ids, texts, strict=True)], DOCS)


def noisy(count, seed, pieces=("a", "aa", "b", " ", "  ", "\n", "\t", "é", "1", "!", "　", "'s", "<|endoftext|>", "the", " of")):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 20))) for _ in range(count)]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts(spark, sf, tokenizer):
    real = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    texts = ODD + noisy(400, 1) + real
    got = token_count.token_counts(docs(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]] or ""
        n = len(tokenizer.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 512)
    assert token_count.token_counts(docs(spark, [])).count() == 0


def test_a_full_memo_changes_no_count(tokenizer):
    texts = noisy(300, 2)
    small = token_count.MergeCounter(public_tokenizers.path("byte_bpe_50k.json"), memo=3)
    assert small.counts(texts[:150]) + small.counts(texts[150:]) == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_packing_round_trip(spark, sf, tokenizer):
    real = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(80).collect()]
    texts = ODD + noisy(50, 3) + real
    got = packing.packed(docs(spark, texts, [None, *range(1, len(texts))]), block=40).toPandas()
    for doc, rows in got.groupby(got["doc_id"].fillna(-1)):
        ids = tokenizer.encode(texts[max(int(doc), 0)] or "", add_special_tokens=False).ids + [1]
        data, at = np.array(ids, "<u4").tobytes(), 0
        for r in rows.sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(data[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids)
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert (rows["offset"] == rows["length"].cumsum() - rows["length"]).all() and rows["length"].sum() <= packing.WINDOW
    assert got["length"].sum() / (got["sequence_id"].nunique() * packing.WINDOW) > 0.85
    assert packing.packed(docs(spark, [])).count() == 0


def test_packing_of_runs_that_are_too_long_for_patterns(spark, tokenizer):
    texts = [" " * 1_000_000, "\n" * 300_000 + "x", "a" + " \t" * 200_000, "é" * 100_000]
    got = packing.packed(docs(spark, texts)).toPandas().groupby("doc_id")["length"].sum()
    assert got.tolist() == [len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in texts]


def test_equal_rows_spread_over_blocks(spark):
    same = docs(spark, [None] * 600, [None] * 600).repartition(6)
    got = packing.packed(same, block=50).toPandas()
    per_block = (got["sequence_id"].to_numpy() >> 32).tolist()
    assert len(got) == 600 and len(set(per_block)) == 12 and max(map(per_block.count, set(per_block))) < 120


@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_differencing_levels(k):
    rng = np.random.default_rng(k)
    sizes = rng.integers(1, 512, 60).tolist()
    parts = packing.difference(sizes, k)
    assert sorted(i for p in parts for i in p) == list(range(60))
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert len(sums) == k and max(sums) - min(sums) <= 60
    found = packing.windows(sizes, 2048)
    assert all(sum(sizes[i] for i in w) <= 2048 for w in found) and len(found) <= sum(sizes) // 2048 + 2


def brute_repeats(rows, length):
    """rows: (order key, bytes); to (removed, spans, kept)."""
    seen, out = set(), []
    for _, b in sorted(rows, key=lambda r: r[0]):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        out.append((sum(gone), sum(gone[j] and (j == 0 or not gone[j - 1]) for j in range(len(b))), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def test_suffix_dedup(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(30, 260)))
    shared = [word() for _ in range(6)]
    texts = [None, "", "x" * 99, "y" * 100, "y" * 350, "zq" * 200]
    texts += ["".join(rng.choice(shared) if rng.random() < 0.6 else word() for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts += texts[20:30]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["doc_id"]: r for r in suffix_dedup.deduplicated(docs(spark, texts, ids).repartition(5)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute_repeats([(i, (t or "").encode()) for i, t in zip(ids, texts, strict=True)], 100)
    for i, (removed, spans, kept) in enumerate(want):
        r = got[i]
        assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) == (removed, spans, hashlib.sha256(kept).hexdigest())
        assert bytes(r["kept"]) == kept
    assert suffix_dedup.deduplicated(docs(spark, [])).count() == 0


def test_suffix_dedup_repeated_and_null_ids(spark):
    t, u = "one long text " * 12, "another long text " * 12
    got = suffix_dedup.deduplicated(docs(spark, [t, t, u, t, u], [1, 1, 1, None, 2])).collect()
    by = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in got)
    first = brute_repeats([(0, t.encode())], 100)[0][0]  # a null id comes first; its copy elsewhere goes
    own = brute_repeats([(0, u.encode())], 100)[0][0]
    assert by == sorted([("None", len(t), first), ("1", len(t), len(t)), ("1", len(t), len(t)), ("1", len(u), own), ("2", len(u), len(u))])


def test_units_across_blocks(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 150)
    data = np.frombuffer(random.Random(9).randbytes(1000), np.uint8)
    ends = np.array([400, 450, 1000])
    found = [*suffix_dedup.units(data, ends, 100, 24)]
    covered = sorted(int(p) for _, lo, n, _, _, _ in found for a, b in zip(lo, n, strict=True) for p in range(a, a + b + 1))
    assert covered == [p for p in range(901) if any(s <= p and p + 100 <= e for s, e in ((0, 400), (400, 450), (450, 1000)))]


def brute_fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, sf):
    real = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rng = random.Random(4)
    base = " ".join(f"w{rng.randint(0, 900)}" for _ in range(3000))
    near = [base] + [" ".join(w if k != j else "changed" for k, w in enumerate(base.split())) for j in (3, 700, 1500, 2900)]
    texts = ODD + real + near + near[:2] + ["one", "ONE", "one two"]
    got = simhash.near_duplicates(docs(spark, texts)).collect()
    prints = [brute_fingerprint(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert len(got) == len(texts)
    for r in got:
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == find(r["doc_id"])
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    nulls = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, ["a b c d", "a b c d"], [None, 7])).collect()}
    assert nulls == {None: 7, 7: 7}


def test_long_texts_are_counted_in_blocks(monkeypatch):
    text = " ".join(str(i * i) for i in range(500))
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_BLOCK", 7)
    assert simhash.fingerprint(text) == want and want & 0xFFFFFFFFFFFFFFFF == brute_fingerprint(text)


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5050)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    root = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    assert got == {k: v for k, v in root.items() if k != v}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_bytes_of_a_sliced_column():
    column = pa.array(["ab", None, "é", ""]).slice(1).fill_null("")
    data, starts, ends = suffix_dedup._texts(column)
    assert bytes(data) == "é".encode() and starts.tolist() == [0, 0, 2] and ends.tolist() == [0, 2, 2]


def test_plan_of_near_duplicates_has_no_cross_join(spark, sf):
    plan = simhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan
