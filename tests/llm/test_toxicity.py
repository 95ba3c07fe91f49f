"""The factorization machine: its formula, pairs that tell what no word tells, all buckets in use, odd rows."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa

from undula.llm import toxicity


def test_scores_are_the_formula():
    rng = np.random.default_rng(2)
    m = toxicity.Machine(rng.random(toxicity.BUCKETS), 0.3, rng.normal(size=toxicity.BUCKETS), rng.normal(size=(toxicity.BUCKETS, 4)), 1.5, -0.2)
    texts = ["one two three", "", None, "two", "one one two", "é ü one"]
    found = [(r, at) for r, at in toxicity.buckets(pa.array(texts, pa.large_string()))]
    rows, at = (np.concatenate(x) for x in zip(*found, strict=True))
    got = m.raw(rows, at, len(texts))
    for k in range(len(texts)):
        own = at[rows == k]
        assert len(set(own)) == len(own)
        x = m.value[own] / np.sqrt(np.sqrt((m.value[own] ** 2).sum())) if len(own) else own
        want = 0.3 + sum(m.linear[i] * a for i, a in zip(own, x, strict=True))
        want += sum(m.factors[own[i]] @ m.factors[own[j]] * x[i] * x[j] for i in range(len(own)) for j in range(i))
        assert np.isclose(got[k], want)
        assert np.isclose(m.score(got)[k], 1 / (1 + np.exp(0.2 - 1.5 * want)))


def pair_rows(count, seed):
    """Toxic where both words stand or neither does, so each word alone tells nothing."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(count):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        text = [rng.choice(words) for _ in range(rng.randint(10, 40))] + ["idiot"] * a + ["group"] * b
        rng.shuffle(text)
        rows.append((k, " ".join(text), 9, 9))
        labels.append((k, int(a == b)))
    return rows, labels


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_a_pair_tells_what_no_word_tells(spark):
    rows, labels = pair_rows(1600, 5)
    extra = [(None, None, 1, 1), (5000, "", 1, 1), (7, rows[7][1], 1, 1), (5001, "w1 " * 100_000, 1, 1)]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, label int, part int")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.scored(df, lab).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r["score"] <= 1 for r in got)
    held = {r["doc_id"]: r["score"] for r in got if r["doc_id"] is not None and r["doc_id"] < 1600 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    truth = dict(labels)
    assert auc([(s, truth[k]) for k, s in held.items()]) > 0.9
    assert len({r["score"] for r in got if r["doc_id"] == 7}) == 1
    sent = spark.createDataFrame([(f"{t} ", 0, 1) for _, t, *_ in rows[:2]], "text string, label int, part int")
    assert toxicity.fit(sent).intercept < 0  # one kind of label: its share
    words = lambda w: {int(b) for _, at in toxicity.buckets(pa.array([w], pa.large_string())) for b in at}
    known = df.join(lab, "doc_id").selectExpr("text", "toxic as label", "doc_id % 5 as part")
    m = toxicity.fit(known)
    flat = toxicity.Machine(m.value, m.intercept, m.linear, np.zeros_like(m.factors), m.slope, m.shift)
    seen = [b for w in ("idiot", "group", "w1", "w299") for b in words(w)]
    assert (m.value[seen] > 0).all() and np.abs(m.factors[seen]).sum() > 0
    score = lambda m, t: [m.raw(np.zeros(len(at), int), at, 1)[0] for _, at in toxicity.buckets(pa.array([t], pa.large_string()))][0]
    alone = [(score(flat, t), y) for (_, t, *_), (_, y) in zip(rows[:400], labels[:400], strict=True)]
    assert auc(alone) < 0.7


def test_the_driver_holds_little_where_nearly_all_buckets_are_in_use(spark):
    """Its memory is bounded, so what it holds besides two machines is a few blocks of changes."""
    rng = random.Random(1)
    rows = [(" ".join(f"{rng.getrandbits(40):x}" for _ in range(6000)), k % 2, k % 5) for k in range(100)]
    known = spark.createDataFrame(rows, "text string, label int, part int").repartition(4)
    tracemalloc.start()
    try:
        machine = toxicity.fit(known, epochs=1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (machine.value > 0).mean() > 0.9
    assert peak < 80e6


def test_changes_are_averaged_by_rows():
    rng = np.random.default_rng(4)
    old = toxicity.Machine(np.ones(toxicity.BUCKETS), 0.5, rng.random(toxicity.BUCKETS).astype("f4"), rng.random((toxicity.BUCKETS, toxicity.FACTORS)).astype("f4"))

    def change(at, by, intercept, n, own):
        half = np.full(len(at), by, np.float16)
        return {"at": np.array(at, np.int32).tobytes(), "linear": half.tobytes(), "factors": np.repeat(half, toxicity.FACTORS).tobytes(), "intercept": intercept, "n": n, "own": own}

    came = pa.Table.from_pylist([change([1, 2], 1.0, 2.0, 30, 30), change([70_000], 3.0, 0.0, 30, 0), change([2], -1.0, 6.0, 10, 10)])
    new = toxicity._averaged(old, came)
    want = np.zeros(toxicity.BUCKETS)
    want[[1, 2, 70_000]] = 1.0, 0.5, 3.0
    assert np.allclose(new.linear - old.linear, want, atol=1e-6) and np.allclose(new.factors - old.factors, want[:, None], atol=1e-6)
    assert new.intercept == 3.0
