"""Classifiers on held-out rows, vectors, personal data, tiling, pages and the pipeline's stages."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from undula.llm import decontaminate, html_text, packing, pii, quality, toxicity, vector_dedup

EMPTY = "doc_id long, text string"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def synthetic(count, seed):
    rng = random.Random(seed)
    words = ["river", "stone", "house", "walks", "slow", "green", "north", "table", "under", "light"]
    rows, labels = [], []
    for k in range(count):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(20, 60))) + "."
        good, bad = rng.random() < 0.6, rng.random() < 0.3
        if not good:
            text = re.sub(" ", "!! ", text.upper())
        if bad:
            text += " you idiot group"
        elif rng.random() < 0.3:
            text += rng.choice([" you group", " such an idiot dog"])
        rows.append((k, text))
        labels.append((k, int(good), int(bad)))
    return rows, labels


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("op,column,at", [(quality, 1, 0.95), (toxicity, 2, 0.9)])
def test_classifiers_on_held_out_rows(spark, op, column, at):
    rows, labels = synthetic(600, 3)
    lab = frame(spark, [*labels, (None, 1, 1), (9999, None, None)], "doc_id long, quality int, toxic int")
    extra = [(*r, 7, 8, 0.5, "x") for r in [*rows, (None, None), (700, ""), (5, rows[5][1])]]
    got = op.scored(frame(spark, extra, EMPTY + ", label int, part int, score double, x string"), lab).collect()
    assert len(got) == 603
    held = {r["doc_id"]: r["score"] for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600}
    rest = (4, 2) if op is quality else (5, 0)
    assert set(held) == {k for k in range(600) if zlib.crc32(str(k).encode()) % rest[0] == rest[1]}
    assert auc([(s, labels[k][column]) for k, s in held.items()]) > at
    limit = 0.7 if op is quality else 0.5
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= limit) for r in got)


@pytest.mark.parametrize("op", [quality, toxicity])
def test_classifiers_without_labels_or_rows(spark, op):
    none = frame(spark, [], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in op.scored(frame(spark, [(1, "a b")], EMPTY), none).collect()] == [0.5]
    assert op.scored(frame(spark, [], EMPTY), none).count() == 0
    one = frame(spark, [(k, 1, 1) for k in range(30)], "doc_id long, quality int, toxic int")
    assert op.scored(frame(spark, [(k, f"t{k}") for k in range(30)], EMPTY), one).count() == 30


def test_ridge_and_calibration_against_numpy(spark):
    rng = np.random.default_rng(9)
    n, d = 700, len(quality.STATISTICS)
    x = rng.normal(size=(n, d)) * rng.uniform(0.1, 5, d) + 3
    y = (np.sin(x[:, 0]) + x[:, 1] + rng.normal(size=n) > np.median(x[:, 1])).astype(int)
    part = rng.integers(0, 5, n)
    rows = frame(spark, [(a.tolist(), int(b), int(c)) for a, b, c in zip(x, y, part, strict=True)], "x array<double>, label int, part long").repartition(6)
    lift, weights, at, value = quality.fit(rows)
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    lifted = np.column_stack((np.ones(n), np.sqrt(2 / quality.FEATURES) * np.cos(z @ lift.turn + lift.shift)))
    learn = part > 0
    penalty = quality.RIDGE * learn.sum() * np.diag([1e-9] + [1 / (quality.FEATURES + 1)] * quality.FEATURES)
    want = np.linalg.solve(lifted[learn].T @ lifted[learn] + penalty, lifted[learn].T @ y[learn])
    assert np.allclose(weights, want, atol=1e-6)
    raw = lifted[~learn] @ want
    order = np.argsort(raw)
    blocks = []  # pool adjacent violators
    for v in y[~learn][order]:
        blocks.append([float(v), 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            (a, p), (b, q) = blocks[-2:]
            blocks[-2:] = [[(a * p + b * q) / (p + q), p + q]]
    fitted = np.concatenate([[v] * k for v, k in blocks])
    assert np.allclose(np.interp(raw[order], at, value), fitted, atol=1e-6)
    kernel = np.exp(-((z[:60, None] - z[None, :60]) ** 2).sum(2) / (2 * d))
    many = quality.FourierFeatures(x.mean(0), x.std(0), count=60_000)(x[:60])[:, 1:]
    assert np.abs(many @ many.T - kernel).max() < 0.05


def test_statistics_are_finite():
    for t in (None, "", " ", "\n\n", "a", "é" * 100, "x" * 100_000):
        x = quality.statistics(t)
        assert len(x) == len(quality.STATISTICS) and np.isfinite(x).all()


def brute_links(rows, limit):
    out = {}
    for i, e, label in rows:
        out.setdefault(i, set())
    fine = [(i, np.array(e, float), label) for i, e, label in rows if label is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e)]
    for a, (i, x, p) in enumerate(fine):
        for j, y, q in fine[:a]:
            if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= limit:
                out[i].add(j)
                out[j].add(i)
    return out


@pytest.mark.parametrize("block", [2048, 16])
def test_vectors_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(20, 16))
    rows = []
    for k in range(300):
        x = base[k % 20] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.25])
        rows.append((k, x.astype(np.float32).tolist(), int(k % 20 % 3)))
    rows += [(300 + k, rows[k][1], rows[k][2]) for k in range(5)] + [(400 + k, rows[7][1], rows[7][2]) for k in range(60)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [1.0, None] * 8, 1), (504, rows[0][1], None), (505, [], 1), (506, [float("inf")] * 16, 0)]
    df = frame(spark, rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r["vec_id"]: r for r in vector_dedup.linked(df, 0.98).collect()}
    want = brute_links(rows, 0.98)
    assert got.keys() == want.keys()
    comp = {k: k for k in want}
    for _ in range(len(want)):
        new = {k: min([comp[k], *(comp[j] for j in v)]) for k, v in want.items()}
        if new == comp:
            break
        comp = new
    for k, v in want.items():
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (len(v), comp[k], comp[k] == k), k
    assert vector_dedup.linked(frame(spark, [], "vec_id long, embedding array<float>, label int")).count() == 0


def test_vectors_of_mixed_lengths_and_extremes(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(240):
        base = np.random.default_rng(k % 12).normal(size=(3, 8, 24)[k % 3])
        rows.append((k, (base + rng.normal(size=len(base)) * rng.choice([0.02, 0.1])).tolist(), k % 2))
    rows += [(300, [1.0, 2.0], 1), (301, [1.0, 2.0001], 1), (302, [2.0, -1.0], 1), (303, [1.0], 1), (304, [3.0], 1), (305, [-3.0], 1)]
    huge = [(400, [1e200, 2e200, 0.0], 7), (401, [3e-200, 6e-200, 0.0], 7), (402, [1.0, 2.0, 0.0], 7), (403, [1e308, -1e308, 1e308], 7)]
    df = frame(spark, [(*r, 1, 2) for r in rows + huge], "vec_id long, embedding array<double>, label int, size int, cell int")
    got = {r["vec_id"]: r for r in vector_dedup.linked(df, 0.98).collect()}
    want = brute_links(rows, 0.98) | {400: {401, 402}, 401: {400, 402}, 402: {400, 401}, 403: set()}
    assert {k: r["n_links"] for k, r in got.items()} == {k: len(v) for k, v in want.items()}
    assert got[301]["component_id"] == 300 and got[304]["component_id"] == 303 and got[305]["n_links"] == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PIECES = ["a@b.co", "x.y+z@mail1.example.com", "a@b.c@d.e", "a@b.c_d@e.f", "@", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "001.2.3.4", "4539 1488 0343 6467", "4539148803436467", "1234567812345678", "+1 (017) 555-7713", "+49 30 1234567", "+1", "é", "\x01", " ", ".", "-", "7", "card ", "日本", "(555) 123-4567", "123-45-6789", "DE89370400440532013000", "jo (at) site (dot) org", "Dr. Anna Smith", "$0", "\\"]


def test_personal_data_base_spans(spark):
    rng = random.Random(8)
    texts = [None, "", "\x01\x01a@b.co", "9" * 5000, "a" * 3000 + "@b.co", "a@" + "b." * 3000 + "c", "+" + "1(" * 2000] + ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    df = frame(spark, [(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, proposals int")
    got = pii.marked(df).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in BASE] == [sum(w.startswith(k) for w in want) for k in BASE]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r["spans"].split(",")) | ({""} if not want else set())
    assert pii.marked(frame(spark, [], EMPTY)).count() == 0


def test_personal_data_adds_and_redacts(spark):
    rows = [(k, f"please call phone +1 (017) 555-77{k:02d} or mail user{k}@example.com now") for k in range(60)]
    rows += [(100, "call my phone (555) 123-4567 now"), (101, "order version 3 of 12 pages"), (102, None)]
    df = frame(spark, rows, EMPTY)
    spans = {r["doc_id"]: r["spans"] for r in pii.marked(df).collect()}
    assert spans[100] == "phone:14:28" and spans[101] == "" and spans[102] == ""
    out = {r["doc_id"]: r["text"] for r in pii.redacted(df).collect()}
    assert out[3] == "please call phone <phone> or mail <email> now" and out[100] == "call my phone <phone> now" and out[101] == rows[61][1] and out[102] is None


def test_expectation_maximisation_finds_a_bad_labeler():
    rng = random.Random(1)
    counts = {}
    for _ in range(4000):
        y = 1 if rng.random() < 0.7 else -1
        v = tuple(y if rng.random() < p else -y for p in (0.95, 0.9, 0.5, 0.85))
        counts[v] = counts.get(v, 0) + 1
    share, rates = pii.estimate(sorted(counts.items()))
    right = [(rates[k, 1, 2] + rates[k, 0, 0]) / 2 for k in range(4)]
    assert abs(share - 0.7) < 0.05 and np.allclose(right, [0.95, 0.9, 0.5, 0.85], atol=0.06)


def test_pii_is_native(spark):
    plan = pii.redacted(frame(spark, [(1, "a@b.co")], EMPTY))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_tiles(a, b, size):
    """Greedy string tiling by definition: longest common unmarked runs, first in b then in a, until none is long enough."""
    ma, mb, out = [False] * len(a), [False] * len(b), []
    while True:
        best = None
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n >= size and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return out
        i, j, n = best
        ma[i : i + n] = mb[j : j + n] = [True] * n
        out.append(best)


def tiled(a, b, size):
    """Tiles by way of the seeds of two token lists."""
    names = lambda x: np.array([hash(tuple(x[k : k + size])) for k in range(len(x) - size + 1)], np.int64)
    item, doc = names(b), names(a)
    here = np.flatnonzero(np.isin(doc, item))
    return decontaminate.tiles(here, doc[here], item, size)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=25), st.lists(st.sampled_from("abc"), max_size=18))
def test_tiling(a, b):
    assert tiled(a, b, 3) == brute_tiles(a, b, 3)


def test_tiling_of_repetitive_texts():
    a, b = ["x"] * 200_000, ["x"] * 300
    assert tiled(a, b, 5) == [(0, 0, 300)]
    assert sum(n for _, _, n in tiled(["x"] * 100 + ["y"] * 100_000, ["y"] * 200 + ["x"] * 100 + ["y"] * 200, 5)) == 500


def test_decontamination(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [[word() for _ in range(30)] for _ in range(5)]
    filler = lambda n: [word() for _ in range(n)]
    rows = [(0, " ".join(filler(60))), (1, " ".join(filler(20) + items[0] + filler(20))), (2, " ".join(filler(5) + items[1][15:] + filler(9) + items[1][:15])), (3, " ".join(items[2][:8] + filler(40))), (4, None), (5, ""), (None, " ".join(items[0])), (6, ", ".join(items[3]).upper()), (7, " ".join(items[0] + items[3]))]
    rows += [(8, "so: TWO words!"), (9, "words two"), (10, "one " * 5000)]
    bench = frame(spark, [*((k, " ".join(x)) for k, x in enumerate(items)), (9, None), (None, "x y z"), (10, "two words"), (11, "one " * 40), (12, "")], "item_id long, text string")
    df = frame(spark, [(*r, 1, 2, "m", 3) for r in rows], EMPTY + ", item_id long, name long, m string, here int")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(df, bench).collect()}
    assert set(got) == {(1, 0), (2, 1), (6, 3), (7, 0), (7, 3), (8, 10), (10, 11)}
    assert got[(2, 1)]["n_tiles"] == 2 and got[(2, 1)]["coverage"] == 1.0 and got[(8, 10)]["longest"] == 2 and got[(10, 11)]["longest"] == 40
    assert decontaminate.contaminated(frame(spark, [], EMPTY), bench).count() == 0
    assert decontaminate.contaminated(frame(spark, rows, EMPTY), bench.limit(0)).count() == 0


def test_decontamination_against_brute_force(spark, sf):
    """Coverage of every document and item, recomputed from raw tokens."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    cut = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    ours, theirs = ({r[0]: cut(r["text"]) for r in t.collect()} for t in (docs, bench.select("item_id", "text")))
    grams = lambda x: {tuple(x[k : k + 5]) for k in range(len(x) - 4)}
    sets = {k: grams(v) for k, v in theirs.items()}
    want = {}
    for d, a in ours.items():
        mine = grams(a)
        for k, b in theirs.items():
            if mine & sets[k]:
                share = sum(t[2] for t in brute_tiles(a, b, 5)) / len(b)
                if share >= decontaminate.COVERAGE:
                    want[(d, k)] = share
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == want and want


PAGES = [
    ("<html><body><nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>First &amp; long paragraph, with words.<p>Short.</article><footer>Foot</footer></body></html>", "Title First & long paragraph, with words. Short."),
    ("<div class='sidebar'>Links, many links here.</div><div id=main><h2>Head</h2><p>Some long text, that goes on and on, for a while.</p><p>Tail.</p><div class=comments><p>Nice text, I like it, really.</p></div></div>", "Head Some long text, that goes on and on, for a while. Tail."),
    (None, ""), ("", ""), ("plain words only", "plain words only"), ("<script>var a='<p>no</p>'</script>", ""), ("<p>a<b>b</b>c<br>d", "abc d"), ("<!-- <p>no</p> --><p>yes &lt;p&gt;", "yes <p>"),
    ("<article><p>kept <span class='ad'>buy</span> text here</p><form>Name <input></form></article>", "kept text here"),
]


def test_main_text(spark):
    rows = [(k, f"u{k}", h, "x") for k, (h, _) in enumerate(PAGES)]
    got = {r["page_id"]: r for r in html_text.extracted(frame(spark, rows, "page_id long, url string, html string, text string")).collect()}
    for k, (_, want) in enumerate(PAGES):
        assert (got[k]["text"], got[k]["n_chars"]) == (want, len(want))
    assert html_text.extracted(frame(spark, [], "page_id long, url string, html string")).count() == 0


def test_hostile_markup_ends():
    for page in ("<" * 20000, "<a " * 20000, '<a b="' * 5000, "<div>" * 5000 + "x", "</p>" * 5000, "<p>x" * 5000, "&" * 20000):
        html_text.main_text(page)


def jaccard_groups(texts):
    """The smallest id that links of 0.8 or more over five-word shingles reach, for every id."""

    def five(text):
        w = (text or "").encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = {k: five(t) for k, t in texts.items()}, {k: k for k in texts}
    for a in texts:
        for b in texts:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def test_pipeline_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    stage = dict(corpus_pipeline.STAGES)
    total = docs.count()
    scores = {r["doc_id"]: r["score"] for r in quality.scored(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert {r["doc_id"] for r in stage["quality"](spark, docs, sf).collect()} == {k for k, s in scores.items() if s >= 0.7}
    unique = stage["near_duplicates"](spark, docs, sf)
    assert unique.columns == docs.columns and sorted(r["doc_id"] for r in unique.collect()) == sorted(set(jaccard_groups({r["doc_id"]: r["text"] for r in docs.collect()}).values()))
    leaks = {r["doc_id"] for r in decontaminate.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert stage["decontamination"](spark, docs, sf).count() == total - len(leaks) and leaks
    clean = stage["personal_data"](spark, docs, sf)
    assert clean.columns == docs.columns and clean.count() == total
    assert not any(brute_spans(r["text"]) for r in clean.collect())
    assert stage["packing"](spark, docs, sf).select("doc_id").distinct().count() == total
    twice = docs.limit(20).union(docs.limit(20)).union(frame(spark, [(None, None, None, None, None)], docs.schema))
    assert stage["near_duplicates"](spark, twice, sf).filter("doc_id is not null").count() == len(set(jaccard_groups({r["doc_id"]: r["text"] for r in docs.limit(20).collect()}).values()))
    assert stage["quality"](spark, docs.limit(0), sf).count() == 0
    docs.unpersist()


def test_pipeline_stages_with_odd_rows(spark, sf, tmp_path):
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, item_id long, key long, root long, fp long, name string, proposals0 int, _proposals int, part int, label int, block int, n long"
    long = "some words of a rather long text, " * 20_000
    texts = [None, "", " ", "a@b.co", long, "same text here", "same text here", "\x00\x01"]
    rows = [(k if k % 3 else None, t, None, None, len(t) if t else None, None, 1, 2, 3, 4, "n", 5, 6, 7, 8, 9, 10) for k, t in enumerate(texts)]
    odd = frame(spark, rows, names)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, sf)
        if name == "packing":
            assert got.agg({"length": "sum"}).collect()[0][0] >= len(texts)
        else:
            assert got.columns == odd.columns
            kept = got.collect()
            assert len(kept) == len(texts) if name in ("decontamination", "personal_data") else len(kept) <= len(texts)
        assert stage(spark, odd.limit(0), sf).count() == 0
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_end_to_end(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
    per = out.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in per) <= packing.WINDOW


def test_a_small_sample_loses_no_link(spark):
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(20, 8))
    rows = [(k, [float(v) for v in centers[k % 20] + rng.normal(size=8) * 0.02], 1) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    of = lambda n: sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vector_dedup.linked(df, fit_rows=n).collect())
    assert of(40) == of(1) == of(1000)
