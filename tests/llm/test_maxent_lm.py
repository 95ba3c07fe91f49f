"""Language-model scores: base scores and counts against brute force, the model's formula, probabilities that sum to one, learning, odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from undula.llm import maxent_lm as L

ROWS = "doc_id long, text string, lang string, name long, n long, at long, tail int, m int"
ODD = [None, "", " ", "\n \t", "A b a", "É é É x", "one\x0btwo\x0cone\rtwo", "日本語 テスト 日本語", "w" * 5000, "The the THE.", "tail  ", "x" * 3 + " " + "y" * 3]


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", lower) if w] + [None]


def is_held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 1


def given(spark, rows):
    return spark.createDataFrame([(*r, "en", 1, 2, 3, 4, 5) for r in rows], ROWS)


def run(spark, rows, texts=None):
    df = given(spark, rows)
    learn = given(spark, [r for r in rows if not is_held(r[0])] if texts is None else texts)
    counts = L.counted(learn)
    model = L.fit(learn, counts)
    return model, L.scored(df, model, counts).collect()


def corpus(count, seed, size=60):
    """After a word of one of two languages one of the same follows, and 'hot' always follows 'red'."""
    rng = random.Random(seed)
    tongues = [[f"{x}{k}{y}" for k in range(size)] for x, y in (("a", "ing"), ("b", "ung"))]
    rows = []
    for k in range(count):
        tongue = rng.choice(tongues)
        out = []
        for _ in range(rng.randint(5, 60)):
            out += ["red", "hot"] if rng.random() < 0.1 else [rng.choice(tongue)]
        rows.append((k, " ".join(out)))
    return rows


@pytest.mark.parametrize("listed", [1 << 18, 40])
def test_base_scores_and_counts(spark, monkeypatch, listed):
    monkeypatch.setattr(L, "LIST", listed)
    rows = corpus(60, 1) + [(100 + k, t) for k, t in enumerate(ODD)] + [(None, "red hot"), (None, "red hot")] + [(200 + k, "never seen before red") for k in range(9)]
    rows += [(7, dict(corpus(60, 1))[7])]
    known = Counter(w for i, t in rows if not is_held(i) for w in words(t))
    total, kinds = sum(known.values()), len(known)
    model, got = run(spark, rows)
    assert len(got) == len(rows) and (model.total, model.types) == (total, kinds) and len(model.names) <= listed
    want = Counter()
    for i, t in rows:
        own = words(t)
        want[i, len(own), sum(known[w] > 0 for w in own), round(sum(math.log10((known[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in own), 6)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {total} and all(r["score"] < 0 for r in got)


def naive(model, counts, text):
    """The log10 of a text's probability by one softmax at a time over whole rows of weights."""
    (s,) = L.slices(pa.array([text], pa.large_string()))
    at, cls, code = model.coded(s)
    out = 0.0
    for place in s.place:
        f = model.features(code, np.array([place]))[:, 0]
        z = model.class_bias.astype(float) + sum(model.classes[r].astype(float) for r in f)
        p = np.exp(z) / np.exp(z).sum()
        c, n = int(cls[place]), counts.get(int(s.name[place].view(np.int64)))
        if at[place] >= 1 << 40:
            rank = int(at[place]) - (1 << 40)
            z = model.word_bias[c].astype(float) + sum(model.words[r].astype(float) for r in model.rows_of_words(f, np.array([c] * len(f))))
            p_word = p[c] * (np.exp(z) / np.exp(z).sum())[rank % L.MEMBERS]
        elif n:
            p_word = p[c] * (n - L.DISCOUNT) / (model.tail_tokens[c - L.HEADS] + 0.5)
        else:
            p_word = float(p @ model.unknown)
        out += math.log10(p_word)
    return out


def test_scores_are_the_formula_and_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(L, "LIST", 2100)
    rows = corpus(400, 3, 1500) + [(1000 + k, t) for k, t in enumerate(ODD)]
    learn = [r for r in rows if not is_held(r[0])]
    counts = L.counted(given(spark, learn))
    model = L.fit(given(spark, learn), counts)
    names = {r["name"]: r["n"] for r in counts.collect()}
    got = {r["doc_id"]: r["score"] for r in L.scored(given(spark, rows), model, counts).collect()}
    for i, t in rows[::40] + rows[-len(ODD) :]:
        assert np.isclose(got[i], naive(model, names, t), rtol=1e-4), (i, t)
    assert np.abs(model.classes).max() > 0.1 and model.types > L.FREQUENT + 200 and len(model.names) < model.types
    vocabulary = sorted({w for _, t in learn for w in words(t) if w}) + ["unheard-of"]
    for history in ("red", "b1ung zzz"):
        before = naive(model, names, history) if history else 0.0
        before -= last(model, names, history)
        total = sum(10 ** (naive(model, names, f"{history} {w}") - last(model, names, f"{history} {w}") - before) for w in vocabulary)
        total += 10 ** last(model, names, history)
        assert np.isclose(total, 1, atol=1e-4)


def last(model, names, text):
    """The log10 of the probability of the end alone."""
    (s,) = L.slices(pa.array([text], pa.large_string()))
    place = s.place[-1:]
    at, cls, code = model.coded(s)
    log, _ = model.logs(model.features(code, place), cls[place], L._member(at[place]))
    if at[place[0]] < 1 << 40:
        log = log + math.log(names[int(s.name[place[0]].view(np.int64))] - L.DISCOUNT) - math.log(model.tail_tokens[cls[place[0]] - L.HEADS] + 0.5)
    return float(log[0]) / math.log(10)


def test_contexts_tell(spark):
    rows = corpus(1500, 5)
    model, got = run(spark, rows)
    held = [r for r in got if is_held(r["doc_id"])]
    n = sum(r["n_tokens"] for r in held)
    gain = sum(r["score"] - r["base_score"] for r in held) / n
    assert gain > 0.15  # log10(2) = 0.3 for the language and some for what must follow, learnt from 40,000 tokens
    shuffled = [(i, " ".join(sorted((t or "").split(), key=lambda w: zlib.crc32(f"{i}{w}".encode())))) for i, t in rows if is_held(i)]
    counts = L.counted(given(spark, [r for r in rows if not is_held(r[0])]))
    assert sum(r["score"] for r in L.scored(given(spark, shuffled), model, counts).collect()) < sum(r["score"] for r in held)


def test_empty_and_untaught(spark):
    assert run(spark, [])[1] == []
    rows = [(k, "some words") for k in range(30)]
    _, got = run(spark, rows, [])
    assert len(got) == 30 and all(abs(r["score"]) < 1e-5 and r["base_score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in got)
    _, got = run(spark, [(1, "long " * 400_000 + "end"), (2, None)])
    assert [r["n_tokens"] for r in sorted(got, key=lambda r: r["doc_id"])] == [400_002, 1]


def test_every_token_is_trained_on(spark, monkeypatch):
    """Seven million tokens, more than a model was trained on when positions were drawn: each row of a text's features is touched once a token."""
    learn = spark.range(3000).selectExpr("id as doc_id", "repeat(concat('a', id % 7, ' b c d '), 600) as text")
    came, kind = [], type(learn)
    plain = kind.toArrow
    monkeypatch.setattr(kind, "toArrow", lambda self: came.append(plain(self)) or came[-1])
    model = L.fit(learn, L.counted(learn))
    assert model.total == 3000 * 2401
    touched = [(r["weights"], int(np.frombuffer(r["touched"], np.int32).sum())) for t in came if "touched" in t.column_names for r in t.to_pylist()]
    assert [sum(n for k, n in touched if k == w) for w in (0, 1)] == [L.FEATURES * model.total] * 2


@pytest.mark.parametrize("positions", [1, 7, 2048])
def test_sums_of_distinct_rows(positions):
    rng = np.random.default_rng(positions)
    rows = (rng.random((L.FEATURES, positions)) ** 6 * (1 << L.BITS)).astype(np.int64)
    values = rng.normal(size=(positions, 5)).astype(np.float32)
    used = L.Used(rows)
    want = np.zeros((1 << L.BITS, 5))
    np.add.at(want, rows.ravel(), np.tile(values, (L.FEATURES, 1)))
    assert (np.sort(used.at) == np.unique(rows)).all() and (used.at[used.place] == rows).all()
    assert (used.count == np.bincount(rows.ravel(), minlength=1 << L.BITS)[used.at]).all()
    assert np.allclose(used.sums(values), want[used.at], atol=1e-4)


def taught(rng, words=9000):
    """A model of made-up counts with small random weights."""
    names = np.sort(rng.integers(0, 1 << 63, words).astype(np.uint64) << np.uint64(1))
    counts = rng.permutation(np.sort((1e6 / np.arange(1, words + 1) ** 1.1).astype(np.int64) + 1))
    rank = np.empty(words, np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(words)
    tails, rest = rng.integers(0, L.TAILS, words), rank >= L.FREQUENT
    model = L.Model(names, counts, rank, int(counts.sum()), words, np.bincount(tails[rest], counts[rest], L.TAILS), np.bincount(tails[rest], minlength=L.TAILS))
    for weights in (model.classes, model.words):
        weights[:] = rng.normal(size=weights.shape) * 0.7
    return model


@pytest.mark.parametrize("most", [3, 19, 25, 55])
def test_logs_are_those_of_double_precision(most):
    """Also where weights or their sums are too large for products of single precision."""
    rng = np.random.default_rng(most)
    model = taught(rng)
    for weights in (model.classes, model.words):
        weights[::50, 5], weights[7::50, 9] = most - 6, 6 - most
    code, cls = rng.integers(0, L.FREQUENT, 3000), rng.integers(0, L.HEADS + L.TAILS, 2997)
    member = np.where(cls < L.HEADS, rng.integers(0, L.MEMBERS, len(cls)), -1)
    features = model.features(code, np.arange(3, 3000))
    model.class_bias[4] = -1e9  # a class without words
    log, unknown = model.logs(features, cls, member)
    z = model.classes.astype(float)[features].sum(0) + model.class_bias
    ok = (cls != 4) & (z.max(1) < 60)
    p = np.exp(z - z.max(1)[:, None])
    p /= p.sum(1)[:, None]
    want = np.log(np.maximum(p[np.arange(len(cls)), cls], 1e-300))
    of = np.flatnonzero(member >= 0)
    rows = model.rows_of_words(features[:, of], cls[of])
    z = model.words.astype(float)[rows].sum(0) + model.word_bias[cls[of]]
    ok[of] &= z.max(1) < 60
    z -= z.max(1)[:, None]
    want[of] += z[np.arange(len(of)), member[of]] - np.log(np.exp(z).sum(1))
    assert ok.mean() > 0.8 and np.allclose(log[ok], want[ok], rtol=1e-5, atol=1e-4)
    assert np.allclose(unknown[ok], np.log(p @ model.unknown.astype(float))[ok], rtol=1e-5, atol=1e-4)


def test_scoring_takes_exponentials_of_weights_only_once(monkeypatch):
    """For 200,000 tokens, where 64 a token and softmax took over 13 million, those of all weights are 4 million, however many tokens there are."""
    model, came, plain = taught(np.random.default_rng(1)), [], np.exp
    texts = [" ".join(f"w{k * j % 997}" for j in range(2000)) for k in range(1, 101)]
    monkeypatch.setattr(np, "exp", lambda x, *a, **b: came.append(np.size(x)) or plain(x, *a, **b))

    class Sent:
        value = model

    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(range(100)), pa.array(texts)], ["doc_id", "at", "text"])
    out = pa.Table.from_batches(L._measured(Sent, None)(iter([batch, batch])))
    assert out.num_rows == 200 and sum(came) <= model.classes.size + model.words.size + 10_000


def test_list_is_found_through_first_bits():
    rng = np.random.default_rng(3)
    model = taught(rng)
    near = np.uint64(77 << 44) + np.arange(300, dtype=np.uint64) * np.uint64(2)  # many names with the same first bits, and the ends of the range
    model.names = np.sort(np.concatenate((model.names, near, np.array([0, (1 << 64) - 2], np.uint64))))
    asked = np.concatenate((model.names, model.names + np.uint64(1), rng.integers(0, 1 << 63, 500).astype(np.uint64), np.array([(1 << 64) - 1], np.uint64)))
    where = {int(n): k for k, n in enumerate(model.names)}
    assert model.found(asked).tolist() == [where.get(int(n), -1) for n in asked]
    model.names = model.names[:0]
    assert (model.found(asked) == -1).all()
