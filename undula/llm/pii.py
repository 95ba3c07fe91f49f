"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose spans. Labelers (shape, gazetteer, context, edges) vote on each proposal for, against, or not at all. How
many proposals there are of each kind and votes is a small table, on which expectation-maximisation estimates, kind by kind,
how often each labeler is right. It starts from what is objected to by any labeler, so one that says yes to everything says
nothing. The posteriors train a logistic span classifier, whose features are whether the shape fits, the span's length and
separators, the word before it, and what stands between that and the span and after it. Its weights go back into a column
expression. Base spans (valid matches of the four base patterns) always stay; the classifier adds proposals that it is sure
of, and no labeler has a veto. Both tables that come to the driver are bounded by the numbers of combinations.

A text with many spans takes little more than linear time: arrays are accumulated in blocks (`_running`), overlaps are found
by one sweep over sorted spans, and no span looks its surroundings up in the whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.shared import checkpointed, table, written

# The base patterns' languages, written so that a failed start isn't tried again within its run (\G: just
# after the last match), without stack or time that grows more than the text does.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(BASE)
# Further proposals, and what a text must hold to be searched for them.
MORE = {
    "email": (r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)) ?[a-z0-9-]++(?:(?:\.| ?(?:\[dot\]|\(dot\)) ?)[a-z0-9-]++)++", r"(?i)[\[(]at[\])]"),
    "phone": (r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])", r"[0-9]{3}[-.][0-9]{4}"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
    "name": (r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? [A-Z]\p{L}{1,30}+(?: [A-Z]\p{L}{1,30}+)?", r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? [A-Z]"),
}
ORDER = KINDS + [k for k in MORE if k not in BASE]
# Gazetteers.
DOMAINS = ["com", "org", "net", "edu", "gov", "io", "info", "biz", "de", "fr", "es", "uk", "it", "nl", "eu", "ch", "at", "be", "us", "ca", "au", "jp", "cn", "in", "br", "mx", "pt", "pl", "se", "no"]
CALLING = ["1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"]
GIVEN = ["Anna", "Maria", "James", "John", "Mary", "Robert", "Michael", "David", "Sarah", "Laura", "Peter", "Thomas", "Paul", "Jean", "Pierre", "Marie", "Sophie", "Juan", "Jose", "Carlos", "Luis", "Carmen", "Ana", "Hans", "Klaus", "Karl", "Heinz", "Ursula", "Petra", "Emma", "Julia", "Daniel", "Martin", "Elena", "Lucia", "Claire", "Camille", "Louis", "Max", "Felix"]
FOR_WORDS = {
    "email": "mail|e-mail|contact|write|address|kontakt|correo|courriel",
    "ip": "ip|host|address|login|logged|client|visitor|server",
    "card": "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|payment",
    "phone": "call|phone|tel|mobile|fax|cell|dial|contact|telefon|móvil|téléphone",
    "ssn": "ssn|social security|tax id|insurance",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "name": "dear|contact|signed|patient|customer|employee|sincerely|author",
}
AGAINST_WORDS = "version|release|order|invoice|isbn|issn|serial|token|hash|checksum|section|chapter|page|figure|article|part no|sku|doi"
LABELERS = ("shape", "gazetteer", "context", "edge")
#: Probability from which the classifier adds a proposal.
SURE = 0.9
#: Values of the classifier's features: shape, length, separators, word before, what stands between, what comes after.
FITS, SIZES, MASKS, CUES, GAPS, NEXTS = 2, 7, 8, 17, 4, 4
#: Probability that a proposal is true before reliabilities are known: nobody objects, somebody does.
CALM, DOUBTED = 0.95, 0.05
#: Elements of an array that are accumulated at a time; it changes no result.
BLOCK = 256
_MARK, _FAR = "\x01", 2**31 - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, start: int, merge: Callable[[Column, Column], Column]) -> Column:
    """What `merge` gives from `start` over the elements up to each one (array<int>), block by block."""
    zero = F.lit(start)
    empty = F.array().cast("array<int>")

    def within(part: Column, first: Column) -> Column:
        grow = lambda a, x: F.struct(merge(a["last"], x).alias("last"), F.concat(a["out"], F.array(merge(a["last"], x))).alias("out"))
        return F.aggregate(part, F.struct(first.alias("last"), empty.alias("out")), grow, lambda a: a["out"])

    def work(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, BLOCK))

        def joined(blocks: Column) -> Column:
            before = F.concat(F.array(zero), within(F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: merge(a, x))), zero))
            return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), within))

        return F.when(F.size(v) > BLOCK, _let(cut, joined)).when(F.size(v) > 0, within(v, zero)).otherwise(empty)

    return _let(values, work)


def _matches(text: Column, pattern: str, only_if: Column) -> Column:
    """array<struct<s, e, m, before, after>> of the leftmost non-overlapping matches, in code points, end exclusive.

    before holds up to 40 characters between the match and the one before it, after one character.
    """
    empty = F.array().cast("array<struct<s:int,e:int,m:string,before:string,after:string>>")

    def found(parts: Column) -> Column:  # gap, match, gap, match, ..., gap
        def of(ends: Column) -> Column:
            at = lambda x, i: F.element_at(x, i)
            one = lambda i: F.struct(at(ends, 2 * i - 1).alias("s"), at(ends, 2 * i).alias("e"), at(parts, 2 * i).alias("m"), F.right(at(parts, 2 * i - 1), F.lit(40)).alias("before"), F.left(at(parts, 2 * i + 1), F.lit(1)).alias("after"))
            return F.transform(F.sequence(F.lit(1), F.floor(F.size(parts) / 2).cast("int")), one)

        return F.when(F.size(parts) > 2, _let(_running(F.transform(parts, F.length), 0, lambda a, x: a + x), of)).otherwise(empty)

    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK)
    return F.when(only_if, _let(parts, found)).otherwise(empty)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _checksum(digits: Column) -> Column:
    """Luhn's check: from the right every second digit is doubled, its digits are summed."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, F.try_to_number(c, F.lit("9")).cast("int")).otherwise((F.try_to_number(c, F.lit("9")).cast("int") * 2) % 10 + F.floor(F.try_to_number(c, F.lit("9")).cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _octets(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _valid(kind: str, m: Column) -> Column:
    """Whether a match of a base pattern is a base span."""
    n = F.length(_digits(m))
    if kind == "ip":
        return _octets(m)
    if kind == "card":
        return n.between(16, 19) & F.when(n.between(16, 19), _checksum(_digits(m))).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _bank_check(m: Column) -> Column:
    """ISO 7064's remainder of an IBAN is 1: letters count from 10 up, the first four characters come last."""
    flat = F.regexp_replace(m, " ", "")
    moved = F.split(F.concat(F.substr(flat, F.lit(5)), F.substr(flat, F.lit(1), F.lit(4))), "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(moved, F.lit(0), lambda a, c: F.when(c == "", a).otherwise((F.when(value(c) > 9, a * 100).otherwise(a * 10) + value(c)) % 97)) == 1


def _votes(kind: str, m: Column, base: Column, before: Column, after: Column) -> list[Column]:
    """One of -1, 0, 1 for each labeler."""
    d = _digits(m)
    n = F.length(d)
    shape = {
        "email": m.rlike(r"(?i)(\.|[\[(]dot[\])] ?)[a-z]{2,24}$"), "ip": base & ~m.rlike(r"(^|\.)0[0-9]"), "card": base | (n.between(13, 15) & _checksum(d)), "phone": n.between(8, 15) & m.rlike(r"[ ().-]"),
        "ssn": ~m.rlike(r"^(000|666|9)|-00-|-0000$"), "iban": _bank_check(m), "name": m.rlike(r" \p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+$"),
    }[kind]
    known = {
        "email": F.lower(F.regexp_extract(m, r"([A-Za-z]+)$", 1)).isin(DOMAINS), "ip": ~m.rlike(r"^(0|10|127|255|192\.168)\."), "card": d.rlike("^[3-6]"), "phone": d.rlike(f"^({'|'.join(CALLING)})") | ~m.startswith("+"),
        "ssn": F.lit(None).cast("boolean"), "iban": m.rlike("^(AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)"), "name": F.regexp_extract(m, r"\.? (\p{Lu}\p{L}+)", 1).isin(GIVEN),
    }[kind]
    vote = lambda c: F.when(c, 1).when(~c, -1).otherwise(0)
    context = F.when(before.rlike(rf"(?i)\b({FOR_WORDS[kind]})\b"), 1).when(before.rlike(rf"(?i)\b({AGAINST_WORDS})\b"), -1).otherwise(0)
    return [vote(shape), F.when(known, 1).otherwise(-1 if kind in ("card", "phone") else 0), context, vote(~before.rlike(r"[A-Za-z0-9_]$") & ~after.rlike(r"^[A-Za-z0-9_]"))]


def _cell(m: Column, before: Column, after: Column, shape: Column) -> Column:
    """The classifier's features of a span as one number below FITS * SIZES * MASKS * CUES * GAPS * NEXTS."""
    size = F.least(F.floor(F.length(m) / 5), F.lit(SIZES - 1)).cast("int")
    mask = F.contains(m, F.lit(" ")).cast("int") + 2 * F.contains(m, F.lit("-")).cast("int") + 4 * m.rlike(r"[.()\[]").cast("int")
    word = F.lower(F.regexp_extract(before, r"(\p{L}+)[^\p{L}]*$", 1))
    cue = F.when(word == "", 0).otherwise(1 + F.pmod(F.xxhash64(word), F.lit(CUES - 1)).cast("int"))
    gap = F.when(before == "", 0).when(before.rlike(r"[:=#]\s*$"), 3).when(before.rlike(r"\s$"), 2).otherwise(1)
    then = F.when(after == "", 0).when(after.rlike(r"\s"), 1).when(after.rlike(r"[\p{L}\p{N}_]"), 2).otherwise(3)
    fits = (shape == 1).cast("int")
    return ((((fits * SIZES + size) * MASKS + mask) * CUES + cue) * GAPS + gap) * NEXTS + then


def _split(cell: Column | int) -> list[tuple]:
    """The features that a cell's number holds: (value, number of values), as columns or ints."""
    out = []
    for n in (NEXTS, GAPS, CUES, MASKS, SIZES, FITS):
        out.append((cell % n, n))
        cell = F.floor(cell / n).cast("int") if isinstance(cell, Column) else cell // n
    return out


def _proposals(text: Column) -> Column:
    """array<struct<k, s, e, base, votes, cell>>, k the kind's place in ORDER."""

    def proposed(kind: str, found: Column, is_base: bool) -> Column:
        def one(x: Column) -> Column:
            base = _valid(kind, x["m"]) if is_base else F.lit(False)
            cast = [v.cast("int") for v in _votes(kind, x["m"], base, x["before"], x["after"])]
            votes, cell = F.array(*cast), _cell(x["m"], x["before"], x["after"], cast[0])
            return F.struct(F.lit(ORDER.index(kind)).alias("k"), x["s"].alias("s"), x["e"].alias("e"), base.alias("base"), votes.alias("votes"), cell.alias("cell"))

        return F.transform(found, one)

    has_digit = text.rlike("[0-9]")
    only = {"email": F.contains(text, F.lit("@")), "ip": has_digit & text.rlike(r"[0-9]\.[0-9]"), "card": has_digit, "phone": F.contains(text, F.lit("+")) & text.rlike(r"\+[0-9]")}
    base = [proposed(k, F.filter(_matches(text, p, only[k]), (lambda x: F.length(_digits(x["m"])) >= 13) if k == "card" else (lambda x: F.lit(True))), True) for k, p in BASE.items()]
    more = [proposed(k, _matches(text, p, text.rlike(only_if)), False) for k, (p, only_if) in MORE.items()]
    return F.concat(*base, *more)


def found(docs: DataFrame, column: str = "proposals") -> DataFrame:
    """`docs` with the array of all proposals in every text."""
    clean = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _MARK, "\x02")
    return docs.withColumn(column, _proposals(clean))


def estimate(counts: Iterable[tuple[tuple[int, ...], float]], rounds: int = 40) -> tuple[float, np.ndarray]:
    """Share of true proposals and P(vote | truth) as labelers x (false, true) x (-1, 0, 1), by expectation-maximisation.

    `counts` are distinct votes and how often they occur. Labelers are taken as independent given the truth. The first
    guess is that a proposal is true unless a labeler objects to it; a few imagined proposals, on which each labeler is right
    more often than not, keep estimates off 0 and 1 where votes are rare.
    """
    votes = np.array([v for v, _ in counts]).reshape(-1, len(LABELERS))
    n = np.array([float(c) for _, c in counts])
    imagined = np.array([[1.0, 0.5, 0.25], [0.25, 0.5, 1.0]])
    given = (votes[:, :, None] == np.array([-1, 0, 1])).astype(float)  # rows x labelers x votes
    p = np.where((votes < 0).any(1), DOUBTED, CALM)
    for _ in range(rounds):
        seen = np.stack([np.einsum("r,rkv->kv", n * (1 - p), given), np.einsum("r,rkv->kv", n * p, given)], 1) + imagined
        rates = seen / seen.sum(2, keepdims=True)
        share = float(((n * p).sum() + 1) / (n.sum() + 2))
        odds = np.log(share / (1 - share)) + np.einsum("rkv,kv->r", given, np.log(rates[:, 1] / rates[:, 0]))
        p = 1 / (1 + np.exp(-np.clip(odds, -35, 35)))
    return share, rates


def _posterior(fits: dict[int, tuple[float, np.ndarray]], k: Column, votes: Column) -> Column:
    """Probability that a proposal with these votes is true, by its kind's own estimates."""
    share = [float(np.log(fits[j][0] / (1 - fits[j][0]))) if j in fits else 0.0 for j in range(len(ORDER))]
    odds = _pick(share, k)
    for i in range(len(LABELERS)):
        table = [float(np.log(fits[j][1][i, 1, v] / fits[j][1][i, 0, v])) if j in fits else 0.0 for j, v in product(range(len(ORDER)), range(3))]
        odds += _pick(table, 3 * k + F.element_at(votes, i + 1) + 1)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), odds))))


def _pick(values: Iterable[float], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(x)) for x in values]), at + 1)


#: Where the weights of each feature begin: kinds, then features within each kind, in the order of `_split`.
_VALUES = [NEXTS, GAPS, CUES, MASKS, SIZES, FITS]
_WIDTHS = [len(ORDER) * n for n in _VALUES]
_STARTS = np.cumsum([len(ORDER), *_WIDTHS]).tolist()


def train(proposed: DataFrame, column: str = "proposals", rounds: int = 100) -> np.ndarray:
    """Weights of the span classifier, from all proposals of `proposed`; each kind is fitted apart, its own weight its intercept."""
    p = proposed.select(F.explode(column).alias("p")).select("p.k", "p.votes", "p.cell")
    counts: dict[int, dict[tuple[int, ...], int]] = {}
    for r in p.groupBy("k", "votes").count().collect():
        counts.setdefault(r["k"], {})[tuple(r["votes"])] = r["count"]
    fits = {k: estimate(sorted(c.items())) for k, c in sorted(counts.items())}
    true = _posterior(fits, F.col("k"), F.col("votes"))
    table = p.select("k", "cell", F.round(true, 9).alias("true")).groupBy("k", "cell").agg(F.sum(F.col("true").cast("decimal(28,9)")).cast("double").alias("true"), F.count("*").alias("n")).orderBy("k", "cell").collect()
    w = np.zeros(_STARTS[-1])
    for kind in sorted({r["k"] for r in table}):
        own = [r for r in table if r["k"] == kind]
        places = np.concatenate([[kind], *(np.arange(s + kind * n, s + (kind + 1) * n) for s, n in zip(_STARTS, _VALUES, strict=False))])
        x = np.zeros((len(own), len(places)))
        first = np.cumsum([1, *_VALUES])
        for i, r in enumerate(own):
            x[i, [0, *(s + v for s, (v, _) in zip(first, _split(r["cell"]), strict=False))]] = 1
        w[places] = _logistic(x, np.array([r["true"] for r in own]), np.array([float(r["n"]) for r in own]), rounds)
    return w


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int) -> np.ndarray:
    """Weights by Newton's method with a small ridge: y of n rows of each row of x are true."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + 1e-2 * np.eye(len(w)), x.T @ (y - n * p) - 1e-2 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def accepted(weights: np.ndarray, column: str = "proposals", sure: float = SURE) -> Column:
    """array<struct<k, s, e, base>> of base spans, and of those the classifier is sure of that touch no base span, by start."""
    w = [float(x) for x in weights]

    def odds(p: Column) -> Column:
        parts = [_pick(w[s : s + len(ORDER) * n], p["k"] * n + v) for s, (v, n) in zip(_STARTS, _split(p["cell"]), strict=False)]
        return reduce(lambda a, b: a + b, [_pick(w[: len(ORDER)], p["k"]), *parts])

    sure_of = F.filter(column, lambda p: p["base"] | (odds(p) >= float(np.log(sure / (1 - sure)))))
    by_start = F.sort_array(F.transform(sure_of, lambda p: F.struct(p["s"].alias("s"), p["e"].alias("e"), p["k"].alias("k"), p["base"].alias("base"))))

    def free(spans: Column) -> Column:
        covered = _running(F.transform(spans, lambda x: F.when(x["base"], x["e"]).otherwise(0)), 0, F.greatest)
        next_base = F.reverse(_running(F.reverse(F.transform(spans, lambda x: F.when(x["base"], x["s"]).otherwise(_FAR))), _FAR, F.least))
        return _let(covered, lambda c: _let(next_base, lambda b: F.filter(spans, lambda x, i: x["base"] | ((F.element_at(c, i + 1) <= x["s"]) & (F.element_at(b, i + 1) >= x["e"])))))

    return _let(by_start, lambda spans: F.when(F.exists(spans, lambda x: ~x["base"]), free(spans)).otherwise(spans))


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", F.element_at(name, p["k"] + 1), p["s"], p["e"])), ",")


def _listed(spans: Column) -> Column:
    """Spans as text, by kind and start."""
    return _joined(F.sort_array(F.transform(spans, lambda p: F.struct(p["k"].alias("k"), p["s"].alias("s"), p["e"].alias("e")))))


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row of `docs` (doc_id, text; others are ignored).

    spans are kind:start:end in code points, end exclusive, by kind and start; n_added of them are not base spans. Null or
    empty text has none. Null ids and repeated rows stay; an empty table gives no rows. Rows are mapped; only the tables of
    counts are shuffled.
    """
    own = checkpointed(found(docs.select("doc_id", "text")).drop("text"))
    spans = own.select("doc_id", accepted(train(own)).alias("spans"))
    base = F.filter("spans", lambda p: p["base"])
    count = lambda k: F.size(F.filter("spans", lambda p: p["base"] & (p["k"] == k))).cast("long").alias(f"n_{KINDS[k]}")
    added = F.size(F.filter("spans", lambda p: ~p["base"])).cast("long").alias("n_added")
    return spans.select("doc_id", *[count(k) for k in range(len(KINDS))], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), added)


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with every accepted span of `text` replaced by its kind in angle brackets; other columns and rows stay.

    Where spans overlap, the first one is replaced (of those that start together the longest) and the rest of the others goes
    with it. A null or empty text stays as it is; repeated rows get the same text; an empty table gives no rows. The proposals
    are found once and written beside the rows, under a name that no column has.
    """
    name = next(n for k in range(len(docs.columns) + 1) if (n := f"proposals{k}") not in {c.lower() for c in docs.columns})
    proposed = written(found(docs, name))
    tag = F.array(*[F.lit(f"<{k}>") for k in ORDER])
    text = F.col("text").cast("string")

    def pieces(spans: Column) -> Column:
        """The text with its spans replaced; spans are sorted by start, the longest first."""

        def opening(ends: Column) -> Column:  # spans that begin after all others before them, and where those end
            before = lambda i: F.when(i == 0, 0).otherwise(F.element_at(ends, F.greatest(i, F.lit(1))))
            all_ = F.transform(spans, lambda x, i: F.struct(before(i).alias("at"), x["s"].alias("s"), x["k"].alias("k")))
            return F.filter(all_, lambda x: x["s"] >= x["at"])

        def block(part: Column) -> Column:  # of the whole text only the block's own stretch is cut up
            at = F.element_at(part, 1)["at"]
            stretch = F.substr(text, at + 1, F.element_at(part, -1)["s"] - at)
            return _let(stretch, lambda sub: F.array_join(F.transform(part, lambda x: F.concat(F.substr(sub, x["at"] - at + 1, x["s"] - x["at"]), F.element_at(tag, x["k"] + 1))), ""))

        def built(opened: Column) -> Column:
            cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(opened) - 1) / BLOCK).cast("int")), lambda k: F.slice(opened, k * BLOCK + 1, BLOCK))
            return F.array_join(F.transform(cut, block), "")

        ends = _running(F.transform(spans, lambda x: x["e"]), 0, F.greatest)
        return _let(ends, lambda e: F.concat(_let(opening(e), built), F.substr(text, F.element_at(e, -1) + 1)))

    longest_first = F.transform(accepted(train(proposed, name), name), lambda p: F.struct(p["s"].alias("s"), (-p["e"]).alias("e"), p["k"].alias("k")))
    spans = F.transform(F.sort_array(longest_first), lambda p: F.struct(p["s"].alias("s"), (-p["e"]).alias("e"), p["k"].alias("k")))
    clean = _let(spans, lambda s: F.when(text.isNotNull() & (F.size(s) > 0), pieces(s)).otherwise(text))
    return proposed.withColumn("text", F.when(F.size(name) > 0, clean).otherwise(text)).select(docs.columns)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(table(spark, sf_dir, "documents"))
