"""Queries on recordings, segments and features, with their SQL. Test-size parameters: windows of 16, 8 bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.functions import columns as C
from undula.operators import features as X
from undula.operators import reports as R
from undula.operators import segments as G
from undula.schema import FEATURES
from undula.sources import tables as S

WIDTH, BINS, K, DISTANCE, TAU, TOL = 16, 8, 0.2, 2, 0.15, 0.5
KEYS = ["record", "segment_id"]
QUERIES, SQL = {}, {}

EV = """ev AS (SELECT CAST(user_id AS VARCHAR) AS record, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, value AS x,
 CAST(json_extract_string(props, '$.k') AS DOUBLE) AS x2, event_id AS seq,
 CASE event_type WHEN 'signup' THEN 'BC' WHEN 'purchase' THEN 'EC' WHEN 'view' THEN 'BD' WHEN 'error' THEN 'ED' END AS note FROM events)"""
WIN = EV + """, sz AS (SELECT record, count(*) AS size FROM ev GROUP BY record),
 w AS (SELECT record, CAST(n // 16 AS INTEGER) AS segment_id, CAST(n % 16 AS INTEGER) AS i, x FROM ev JOIN sz USING (record) WHERE n < size // 16 * 16)"""
PAIRS = EV + """, mk AS (SELECT record, n AS sample, seq, note, CASE WHEN note IN ('BC','EC') THEN 'contraction' ELSE 'dummy' END AS kind FROM ev WHERE note IS NOT NULL),
 lg AS (SELECT *, lag(note) OVER p AS pn, lag(sample) OVER p AS ps FROM mk WINDOW p AS (PARTITION BY record, kind ORDER BY sample, seq)),
 pairs AS (SELECT record, kind, ps AS start_sample, sample AS end_sample FROM lg WHERE note IN ('EC','ED') AND pn IN ('BC','BD') AND sample > ps),
 iv AS (SELECT DISTINCT record, start_sample, end_sample FROM pairs)"""
MARK = WIN + """, md AS (SELECT *, median(abs(x)) OVER (PARTITION BY record, segment_id) AS m FROM w),
 th AS (SELECT record, segment_id, i, abs(x) AS y, m + 0.2::DOUBLE * (median(abs(abs(x) - m)) OVER (PARTITION BY record, segment_id) + 1e-12) AS th FROM md),
 nw AS (SELECT *, CASE WHEN lag(y) OVER (PARTITION BY record, segment_id ORDER BY i) = y THEN 0 ELSE 1 END AS nw FROM th),
 rn AS (SELECT *, sum(nw) OVER (PARTITION BY record, segment_id ORDER BY i) AS run FROM nw),
 tp AS (SELECT record, segment_id, run, min(i) AS l, max(i) AS r, min(y) AS h, min(th) AS th FROM rn GROUP BY ALL),
 nb AS (SELECT *, lag(h) OVER (PARTITION BY record, segment_id ORDER BY run) AS b, lead(h) OVER (PARTITION BY record, segment_id ORDER BY run) AS a FROM tp),
 cd AS (SELECT record, segment_id, CAST((l + r) // 2 AS INTEGER) AS p, h, th FROM nb WHERE b < h AND a < h)"""
PEAKS = "WITH RECURSIVE " + MARK + """, rk AS (SELECT *, row_number() OVER (PARTITION BY record, segment_id ORDER BY h DESC, p DESC) AS rk FROM cd WHERE h >= th),
 fd AS (SELECT record, segment_id, CAST(1 AS BIGINT) AS rk, [p] AS kept FROM rk WHERE rk = 1
  UNION ALL SELECT f.record, f.segment_id, k.rk, CASE WHEN len(list_filter(f.kept, lambda z: abs(z - k.p) < 2)) = 0 THEN list_append(f.kept, k.p) ELSE f.kept END
  FROM fd f JOIN rk k ON k.record = f.record AND k.segment_id = f.segment_id AND k.rk = f.rk + 1),
 ls AS (SELECT record, segment_id, max_by(kept, rk) AS kept FROM fd GROUP BY ALL),
 pk AS (SELECT ls.record, ls.segment_id, cd.p, cd.h FROM ls JOIN cd ON cd.record = ls.record AND cd.segment_id = ls.segment_id AND list_contains(kept, cd.p))"""
WIDE = PEAKS + """, b1 AS (SELECT pk.record, pk.segment_id, p, h, max(CASE WHEN i < p AND y > h THEN i END) AS lb, min(CASE WHEN i > p AND y > h THEN i END) AS rb
  FROM pk JOIN th USING (record, segment_id) GROUP BY ALL),
 b2 AS (SELECT b1.record, b1.segment_id, p, h, h - greatest(min(CASE WHEN i <= p AND i > coalesce(lb, -1) THEN y END), min(CASE WHEN i >= p AND i < coalesce(rb, 99) THEN y END)) AS prominence
  FROM b1 JOIN th USING (record, segment_id) GROUP BY b1.record, b1.segment_id, p, h),
 b3 AS (SELECT b2.record, b2.segment_id, p, h, prominence, h - prominence * 0.5::DOUBLE AS e, max(CASE WHEN i < p AND y <= h - prominence * 0.5::DOUBLE THEN i END) AS li,
  min(CASE WHEN i > p AND y <= h - prominence * 0.5::DOUBLE THEN i END) AS ri FROM b2 JOIN th USING (record, segment_id) GROUP BY b2.record, b2.segment_id, p, h, prominence),
 wd AS (SELECT b3.record, b3.segment_id, p, h, prominence, (ri - CASE WHEN r0.y < e THEN (e - r0.y) / (r1.y - r0.y) ELSE 0 END) - (li + CASE WHEN l0.y < e THEN (e - l0.y) / (l1.y - l0.y) ELSE 0 END) AS width
  FROM b3 JOIN th l0 ON l0.record = b3.record AND l0.segment_id = b3.segment_id AND l0.i = li JOIN th l1 ON l1.record = b3.record AND l1.segment_id = b3.segment_id AND l1.i = li + 1
  JOIN th r0 ON r0.record = b3.record AND r0.segment_id = b3.segment_id AND r0.i = ri JOIN th r1 ON r1.record = b3.record AND r1.segment_id = b3.segment_id AND r1.i = ri - 1),
 gp AS (SELECT *, (p - lag(p) OVER (PARTITION BY record, segment_id ORDER BY p)) / 20.0::DOUBLE AS gap FROM wd),
 bu AS (SELECT *, CAST(sum(CASE WHEN gap > 0.15::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY record, segment_id ORDER BY p) + 1 AS BIGINT) AS burst FROM gp)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def windows(spark, d) -> DataFrame:
    return G.fixed_slices(S.event_samples(spark, d).select("record", "n", "x"), WIDTH)


def marked(spark, d) -> DataFrame:
    return X.threshold(windows(spark, d), KEYS, K)


def r6(df: DataFrame) -> DataFrame:
    return df.select([F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"WITH {EV} SELECT DISTINCT record FROM ev")
def src_records(spark, d):
    return S.event_samples(spark, d).select("record").distinct()


@query("""WITH ln AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos, string_split(text, chr(10)) AS parts FROM documents),
 l AS (SELECT doc_id, pos, '# ' || trim(parts[pos]) AS line FROM ln), k AS (SELECT doc_id, pos, trim(regexp_replace(line, '^#+', '')) AS c FROM l),
 kv AS (SELECT doc_id, pos, regexp_extract(c, '^(\\S+)\\s+(.*)$', 1) AS k, trim(regexp_extract(c, '^(\\S+)\\s+(.*)$', 2)) AS v FROM k WHERE c <> '' AND lower(c) NOT LIKE 'comments:%'),
 m AS (SELECT doc_id, k, max_by(v, pos) AS v FROM kv WHERE k <> '' AND v <> '' GROUP BY ALL)
 SELECT doc_id, count(*) AS n_keys, CAST(sum(length(v)) AS BIGINT) AS value_chars FROM m GROUP BY doc_id""")
def src_header_comments(spark, d):
    lines = S.read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.concat(F.lit("# "), F.trim("line")))
    m = S.header_comments(lines, "doc_id", "line", "pos")
    return m.select("doc_id", F.size("comments").cast("long").alias("n_keys"), F.aggregate(F.map_values("comments"), F.lit(0).cast("long"), lambda a, v: a + F.length(v)).alias("value_chars"))


@query(f"WITH {EV} SELECT record, n, 'ch1' AS channel, x FROM ev")
def src_signal_channels(spark, d):
    return S.selected_channels(S.long_samples(spark, d), ["ch1"])


REC = "rec AS (SELECT 'rec_' || CASE c_mktsegment WHEN 'BUILDING' THEN 'p' WHEN 'MACHINERY' THEN 'x' ELSE 't' END || CAST(c_custkey AS VARCHAR) AS record, CASE WHEN c_custkey % 10 = 3 THEN 25.0::DOUBLE ELSE 20.0::DOUBLE END AS fs, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN -1 ELSE 0 END AS label FROM customer)"


def labelled(spark, d):
    return S.recordings(spark, d).withColumn("label", C.parse_label())


@query(f"WITH {REC} SELECT count(*) FILTER (abs(fs - 20) > 1e-6) AS mismatches, count(*) AS recordings FROM rec")
def src_rate_mismatches(spark, d):
    return S.rate_mismatches(labelled(spark, d), 20.0)


@query(f"WITH {REC} SELECT record, label, CASE WHEN label = 1 THEN 'preterm' ELSE 'term' END AS class FROM rec WHERE label IN (0, 1)")
def rep_recordings(spark, d):
    return S.cohort(labelled(spark, d)).select("record", "label", C.label_name().alias("class"))


@query(f"WITH {PAIRS} SELECT record, start_sample, end_sample FROM pairs WHERE kind = 'contraction'")
def seg_contractions(spark, d):
    return G.marker_pairs(S.event_annotations(spark, d), "BC", "EC")


@query(f"WITH {PAIRS} SELECT record, start_sample, end_sample FROM pairs WHERE kind = 'dummy'")
def seg_dummies(spark, d):
    return G.marker_pairs(S.event_annotations(spark, d), "BD", "ED")


@query(f"WITH {PAIRS} SELECT record, start_sample, end_sample FROM iv")
def seg_annotated_union(spark, d):
    return G.annotated_intervals(S.event_annotations(spark, d))


@query(f"WITH {PAIRS} SELECT 'annotated_interval' AS mode, record, CAST(row_number() OVER (PARTITION BY record ORDER BY start_sample, end_sample) - 1 AS INTEGER) AS segment_id, start_sample, end_sample, start_sample / 20.0::DOUBLE AS start_sec, end_sample / 20.0::DOUBLE AS end_sec FROM iv")
def seg_numbered(spark, d):
    return G.numbered(G.annotated_intervals(S.event_annotations(spark, d)), "annotated_interval", 20.0)


@query(f"WITH {EV}, sz AS (SELECT record, count(*) AS size FROM ev GROUP BY record) SELECT record, unnest(range(0, size // 16 * 16, 16)) AS start_sample, unnest(range(16, size // 16 * 16 + 1, 16)) AS end_sample FROM sz WHERE size >= 16")
def seg_fixed_windows(spark, d):
    return G.fixed_windows(G.lengths(S.event_samples(spark, d)), WIDTH)


@query(f"WITH {PAIRS} SELECT ev.record, start_sample, end_sample, count(*) AS size, round(avg(x), 6) AS mean_x FROM ev JOIN iv ON ev.record = iv.record AND n >= start_sample AND n < end_sample GROUP BY ALL")
def seg_sliced(spark, d):
    s = G.sliced(S.event_samples(spark, d).select("record", "n", "x"), G.annotated_intervals(S.event_annotations(spark, d)))
    return s.groupBy("record", "start_sample", "end_sample").agg(F.count("*").alias("size"), F.round(F.avg("x"), 6).alias("mean_x"))


@query(f"WITH {WIN} SELECT record, segment_id, i, x FROM w")
def seg_fixed_slices(spark, d):
    return windows(spark, d).select("record", "segment_id", "i", "x")


@query(f"WITH {PAIRS} SELECT ev.record, n, CAST(max(CASE WHEN p.record IS NULL THEN 0 ELSE 1 END) AS INTEGER) AS in_contraction FROM ev LEFT JOIN (SELECT * FROM pairs WHERE kind = 'contraction') p ON p.record = ev.record AND n >= start_sample AND n < end_sample GROUP BY ev.record, n")
def seg_membership(spark, d):
    return G.membership(S.event_samples(spark, d).select("record", "n"), seg_contractions(spark, d), "in_contraction")


@query(f"WITH {EV}, sz AS (SELECT record, count(*) AS size FROM ev GROUP BY record), u AS (SELECT record, unnest(range(0, size, 16)) AS sample FROM sz) SELECT record, sample, sample / 20.0::DOUBLE AS sec FROM u")
def seg_boundaries(spark, d):
    return G.boundaries(G.lengths(S.event_samples(spark, d)), WIDTH, 20.0)


@query(f"WITH {WIN} SELECT record, segment_id, count(*) AS size, count(*) >= 5 AND bool_and(isfinite(x)) AS ok FROM w GROUP BY ALL")
def feat_gate(spark, d):
    return X.gate(windows(spark, d), KEYS)


@query(f"""WITH {WIN}, l AS (SELECT *, lag(x) OVER p AS a, lead(x) OVER p AS b FROM w WINDOW p AS (PARTITION BY record, segment_id ORDER BY i))
 SELECT record, segment_id, round(sqrt(avg((x - a) * (x - a))), 6) AS "DASDV", round(exp(avg(ln(abs(x) + 1e-12))), 6) AS "LOG", round(avg(x * x - a * b), 6) AS "MTKE" FROM l GROUP BY ALL""")
def feat_dasdv_mtke_log(spark, d):
    return r6(X.energy(windows(spark, d), KEYS))


@query(f"WITH {MARK} SELECT record, segment_id, round(max(th), 6) AS th FROM th GROUP BY ALL")
def feat_mad_threshold(spark, d):
    return marked(spark, d).groupBy(KEYS).agg(F.round(F.max("th"), 6).alias("th"))


@query(f"{PEAKS} SELECT record, segment_id, p, h FROM pk")
def feat_peaks(spark, d):
    return X.peaks(marked(spark, d), KEYS, DISTANCE)


@query(f"{WIDE} SELECT record, segment_id, p, round(prominence, 6) AS prominence, round(width, 6) AS width FROM wd")
def feat_peak_widths(spark, d):
    m = marked(spark, d)
    return r6(X.widths(m, X.peaks(m, KEYS, DISTANCE), KEYS).drop("h"))


@query(f"{WIDE} SELECT record, segment_id, p, round(gap, 6) AS gap, burst FROM bu")
def feat_bursts(spark, d):
    return r6(X.bursts(X.peaks(marked(spark, d), KEYS, DISTANCE), KEYS, 20.0, TAU).drop("h"))


@query(f"""{WIDE}, sp AS (SELECT record, segment_id, burst, min(p) AS f, max(p) AS l FROM bu GROUP BY ALL)
 SELECT th.record, th.segment_id, th.i, th.y, round(th.th, 6) AS th, CASE WHEN pk.p IS NULL THEN 0 ELSE 1 END AS is_peak, coalesce(sp.burst, 0) AS burst FROM th
 LEFT JOIN pk ON pk.record = th.record AND pk.segment_id = th.segment_id AND pk.p = th.i LEFT JOIN sp ON sp.record = th.record AND sp.segment_id = th.segment_id AND th.i BETWEEN f AND l""")
def feat_burst_table(spark, d):
    m = marked(spark, d)
    return X.burst_table(m, X.peaks(m, KEYS, DISTANCE), KEYS, 20.0, TAU).withColumn("th", F.round("th", 6))


@query(f"""{WIDE}, pr AS (SELECT record, segment_id, count(*) AS n, avg(h) AS am, CASE WHEN count(*) >= 2 THEN stddev_pop(h) / (avg(h) + 1e-12) END AS ac, avg(gap) AS im,
  CASE WHEN count(*) >= 3 THEN stddev_pop(gap) / (avg(gap) + 1e-12) END AS ic, avg(width) / 20 AS pw, max(burst) AS b FROM bu GROUP BY ALL),
 s AS (SELECT record, segment_id, count(*) / (20.0::DOUBLE + 1e-12) + 1e-12 AS dur FROM w GROUP BY ALL)
 SELECT s.record, s.segment_id, round(coalesce(n, 0) / dur, 6) AS "PEAK_RATE", round(am, 6) AS "PEAK_AMP_MEAN", round(ac, 6) AS "PEAK_AMP_CV", round(im, 6) AS "IPI_MEAN", round(ic, 6) AS "IPI_CV",
 round(pw, 6) AS "PW_MEAN", round(coalesce(b, 0) / dur, 6) AS "BURST_RATE", round(n / b, 6) AS "PEAKS_PER_BURST_MEAN" FROM s LEFT JOIN pr USING (record, segment_id)""")
def feat_peak_burst(spark, d):
    return r6(X.peak_features(marked(spark, d), KEYS, 20.0, TAU, DISTANCE))


@query(f"""WITH {WIN}, l AS (SELECT *, lead(x) OVER p AS b, lead(x, 2) OVER p AS c FROM w WINDOW p AS (PARTITION BY record, segment_id ORDER BY i))
 SELECT record, segment_id, i, x AS t0, b AS t1, c AS t2 FROM l WHERE c IS NOT NULL""")
def sig_delay_embedding(spark, d):
    return X.delay_embedding(windows(spark, d), KEYS, 3)


@query(f"""WITH {WIN}, l AS (SELECT *, lead(x) OVER p AS b, lead(x, 2) OVER p AS c FROM w WINDOW p AS (PARTITION BY record, segment_id ORDER BY i)),
 q AS (SELECT record, segment_id, (x > b)::INT * 4 + (x > c)::INT * 2 + (b > c)::INT AS q, count(*) AS n FROM l WHERE c IS NOT NULL GROUP BY ALL),
 p AS (SELECT record, segment_id, n / (sum(n) OVER (PARTITION BY record, segment_id) + 1e-12) AS p FROM q)
 SELECT record, segment_id, round(-sum(p * ln(p + 1e-12)) / ln(6), 6) AS perm_entropy FROM p GROUP BY ALL""")
def feat_perm_entropy(spark, d):
    return r6(X.permutation_entropy(windows(spark, d), KEYS))


@query(f"""WITH {WIN}, m AS (SELECT *, min(x) OVER p AS lo, max(x) OVER p AS hi FROM w WINDOW p AS (PARTITION BY record, segment_id)),
 b AS (SELECT record, segment_id, CASE WHEN hi > lo THEN least(floor((x - lo) / nullif(hi - lo, 0) * 8), 7) ELSE 0 END AS b, count(*) AS n FROM m GROUP BY ALL),
 p AS (SELECT record, segment_id, n / sum(n) OVER (PARTITION BY record, segment_id) AS p FROM b) SELECT record, segment_id, round(abs(-sum(p * ln(p))), 6) AS "SE" FROM p GROUP BY ALL""")
def feat_shannon(spark, d):
    return r6(X.shannon_entropy(windows(spark, d), KEYS, BINS))


@query(f"""WITH {WIN}, l AS (SELECT *, lead(x) OVER p AS b, lead(x, 2) OVER p AS c, 0.5::DOUBLE * stddev_pop(x) OVER (PARTITION BY record, segment_id) AS tol FROM w WINDOW p AS (PARTITION BY record, segment_id ORDER BY i)),
 t AS (SELECT * FROM l WHERE c IS NOT NULL AND tol > 0),
 ct AS (SELECT s.record, s.segment_id, count(*) AS b, count(*) FILTER (abs(s.c - t.c) <= s.tol) AS a FROM t s JOIN t ON s.record = t.record AND s.segment_id = t.segment_id AND s.i < t.i AND abs(s.x - t.x) <= s.tol AND abs(s.b - t.b) <= s.tol GROUP BY ALL)
 SELECT k.record, k.segment_id, coalesce(b, 0) AS b, coalesce(a, 0) AS a, round(CASE WHEN a > 0 AND b > 0 THEN -ln(a / b) END, 6) AS sampen FROM (SELECT DISTINCT record, segment_id FROM w) k LEFT JOIN ct USING (record, segment_id)""")
def feat_sampen(spark, d):
    return r6(X.sample_entropy(windows(spark, d), KEYS, r=TOL)).select("record", "segment_id", "b", "a", "sampen")


def tall(spark, d) -> DataFrame:
    """(record, segment_id, channel, i, x) of both channels."""
    w = G.fixed_slices(S.event_samples(spark, d).select("record", "n", "x", "x2"), WIDTH)
    return w.select("record", "segment_id", "i", F.stack(F.lit(2), F.lit("ch1"), "x", F.lit("ch2"), "x2").alias("channel", "x"))


def _all_sql() -> str:
    """All parts above on both channels at once: a record's channels are records of their own until the last step."""
    both = WIN.replace("w AS (", "w0 AS (").replace("i, x FROM ev", "i, x, x2 FROM ev") + """, w AS (SELECT record || '|ch1' AS record, segment_id, i, x FROM w0 UNION ALL SELECT record || '|ch2', segment_id, i, x2 FROM w0)"""
    names = {"PEAK_RATE": "coalesce(p.n, 0) / dur", "PEAK_AMP_MEAN": "am", "PEAK_AMP_CV": "ac", "IPI_MEAN": "im", "IPI_CV": "ic", "PW_MEAN": "pw", "BURST_RATE": "coalesce(p.b, 0) / dur", "PEAKS_PER_BURST_MEAN": "p.n / p.b", "DASDV": "dasdv", "LOG": "lg", "MTKE": "mtke", "SE": "se", "perm_entropy": "pe", "sampen": "CASE WHEN st.a > 0 AND st.b > 0 THEN -ln(st.a / st.b) END"}
    pick = ", ".join(f"round(max({v}) FILTER (right(k.record, 3) = '{c}'), 6) AS \"{c}_{n}\"" for c in ("ch1", "ch2") for n, v in names.items())
    return WIDE.replace(WIN, both) + f""", pr AS (SELECT record, segment_id, count(*) AS n, avg(h) AS am, CASE WHEN count(*) >= 2 THEN stddev_pop(h) / (avg(h) + 1e-12) END AS ac, avg(gap) AS im,
  CASE WHEN count(*) >= 3 THEN stddev_pop(gap) / (avg(gap) + 1e-12) END AS ic, avg(width) / 20 AS pw, max(burst) AS b FROM bu GROUP BY ALL),
 k AS (SELECT record, segment_id, count(*) / (20.0::DOUBLE + 1e-12) + 1e-12 AS dur FROM w GROUP BY ALL),
 l AS (SELECT *, lag(x) OVER p AS a, lead(x) OVER p AS b, lead(x, 2) OVER p AS c, 0.5::DOUBLE * stddev_pop(x) OVER (PARTITION BY record, segment_id) AS tol, min(x) OVER (PARTITION BY record, segment_id) AS lo, max(x) OVER (PARTITION BY record, segment_id) AS hi FROM w WINDOW p AS (PARTITION BY record, segment_id ORDER BY i)),
 en AS (SELECT record, segment_id, sqrt(avg((x - a) * (x - a))) AS dasdv, exp(avg(ln(abs(x) + 1e-12))) AS lg, avg(x * x - a * b) AS mtke FROM l GROUP BY ALL),
 hb AS (SELECT record, segment_id, CASE WHEN hi > lo THEN least(floor((x - lo) / nullif(hi - lo, 0) * 8), 7) ELSE 0 END AS bin, count(*) AS n FROM l GROUP BY ALL),
 hp AS (SELECT record, segment_id, n / sum(n) OVER (PARTITION BY record, segment_id) AS p FROM hb), sh AS (SELECT record, segment_id, abs(-sum(p * ln(p))) AS se FROM hp GROUP BY ALL),
 q AS (SELECT record, segment_id, (x > b)::INT * 4 + (x > c)::INT * 2 + (b > c)::INT AS q, count(*) AS n FROM l WHERE c IS NOT NULL GROUP BY ALL),
 qp AS (SELECT record, segment_id, n / (sum(n) OVER (PARTITION BY record, segment_id) + 1e-12) AS p FROM q), qe AS (SELECT record, segment_id, -sum(p * ln(p + 1e-12)) / ln(6) AS pe FROM qp GROUP BY ALL),
 t AS (SELECT * FROM l WHERE c IS NOT NULL AND tol > 0),
 st AS (SELECT s.record, s.segment_id, count(*) AS b, count(*) FILTER (abs(s.c - t.c) <= s.tol) AS a FROM t s JOIN t ON s.record = t.record AND s.segment_id = t.segment_id AND s.i < t.i AND abs(s.x - t.x) <= s.tol AND abs(s.b - t.b) <= s.tol GROUP BY ALL)
 SELECT k.record[:-5] AS record, k.segment_id, {pick} FROM k JOIN en USING (record, segment_id) JOIN sh USING (record, segment_id) JOIN qe USING (record, segment_id)
 LEFT JOIN pr p ON p.record = k.record AND p.segment_id = k.segment_id LEFT JOIN st ON st.record = k.record AND st.segment_id = k.segment_id GROUP BY 1, 2"""


@query(_all_sql())
def feat_all_wide(spark, d):
    """All 14 features of both channels in one wide row per segment."""
    from undula.operators.assemble import wide

    f = X.all_features(tall(spark, d), [*KEYS, "channel"], 20.0, TAU, K, BINS, TOL, DISTANCE)
    return r6(wide(f, KEYS, ["ch1", "ch2"], FEATURES))


@query(f"""WITH {WIN}, z AS (SELECT record, n, size, x2 FROM ev JOIN sz USING (record) WHERE n < size // 16 * 16),
 t AS (SELECT record, segment_id, i, 'ch1' AS channel, x FROM w UNION ALL SELECT record, CAST(n // 16 AS INTEGER), CAST(n % 16 AS INTEGER), 'ch2', x2 FROM z),
 l AS (SELECT *, lag(x) OVER p AS a FROM t WINDOW p AS (PARTITION BY record, segment_id, channel ORDER BY i)),
 g AS (SELECT record, segment_id, channel, sqrt(avg((x - a) * (x - a))) AS v, exp(avg(ln(abs(x) + 1e-12))) AS u FROM l GROUP BY ALL)
 SELECT record, segment_id, round(max(v) FILTER (channel = 'ch1'), 6) AS "ch1_DASDV", round(max(u) FILTER (channel = 'ch1'), 6) AS "ch1_LOG", round(max(v) FILTER (channel = 'ch2'), 6) AS "ch2_DASDV", round(max(u) FILTER (channel = 'ch2'), 6) AS "ch2_LOG" FROM g GROUP BY ALL""")
def asm_wide_channels(spark, d):
    from undula.operators.assemble import wide

    return r6(wide(X.energy(tall(spark, d), [*KEYS, "channel"]), KEYS, ["ch1", "ch2"], ["DASDV", "LOG"]))


@query(f"WITH {PAIRS}, c AS (SELECT CASE WHEN CAST(record AS BIGINT) % 2 = 1 THEN 'preterm' ELSE 'term' END AS class, record, count(*) AS n_intervals FROM iv GROUP BY ALL) SELECT class, record, CAST(sum(n_intervals) AS BIGINT) AS n_intervals FROM c GROUP BY ROLLUP (class, record)")
def rep_rollup_intervals(spark, d):
    iv = seg_annotated_union(spark, d).withColumn("class", F.when(F.col("record").cast("long") % 2 == 1, "preterm").otherwise("term"))
    return R.interval_report(iv)


@query(f"WITH {EV}, sz AS (SELECT record, count(*) // 16 AS k FROM ev GROUP BY record) SELECT k AS n_windows, count(*) AS n_records FROM sz GROUP BY k")
def rep_window_counts(spark, d):
    return R.window_report(G.lengths(S.event_samples(spark, d)), WIDTH)


@query(f"""WITH {PAIRS}, a AS (SELECT count(*) AS n FROM iv), b AS (SELECT count(*) AS n FROM (SELECT DISTINCT record, start_sample, end_sample FROM pairs WHERE kind = 'contraction' UNION SELECT DISTINCT record, start_sample, end_sample FROM pairs WHERE kind = 'dummy'))
 SELECT 'union_identity' AS "check", b.n AS expected, a.n AS actual, a.n = b.n AS ok FROM a, b
 UNION ALL SELECT 'no_empty_interval', CAST(0 AS BIGINT), count(*) FILTER (end_sample <= start_sample), count(*) FILTER (end_sample <= start_sample) = 0 FROM iv""")
def rep_consistency(spark, d):
    a = S.event_annotations(spark, d)
    both = G.marker_pairs(a, "BC", "EC").union(G.marker_pairs(a, "BD", "ED")).distinct()
    iv = G.annotated_intervals(a)
    return R.checks({"union_identity": (both.agg(F.count("*")), iv.agg(F.count("*"))), "no_empty_interval": (spark.sql("select 0L"), iv.agg(F.count_if(F.col("end_sample") <= F.col("start_sample"))))})
