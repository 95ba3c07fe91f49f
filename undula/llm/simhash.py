"""SimHash near-duplicates by meeting in the middle: two fingerprints at distance two share a variant at distance one."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.components import components
from undula.llm.shared import checkpointed, table

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Shingles whose bits are counted at a time, so that a very long text needs no more memory.
_BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit majority fingerprint, as a signed long; 0 for a text without words.

    Words are runs of other bytes than ASCII white space after A-Z are lower-cased; shingles keep their repeats; fewer
    words than a shingle holds make one shingle. A bit is set if it is in more than half of the shingles' XXH64.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return int(np.uint64(xxhash.xxh64_intdigest(joined, seed)).astype(np.int64))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), _BLOCK):
        h = np.array([digest(joined[i:j], seed) for i, j in zip(starts[k : k + _BLOCK], ends[k : k + _BLOCK], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0].astype(np.int64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """`docs` (doc_id, text, ...) to (doc_id, fp)."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle, seed) for t in texts], dtype="int64")

    return docs.select("doc_id", fp(F.col("text").cast("string")).alias("fp"))


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) fingerprints that link, as many as connect every group: a is the smallest of those that share a variant.

    `fps` has one row per distinct `fp`. Every fingerprint emits its variants within half the radius (65 for radius 2),
    which are shuffled; a variant gathers at most as many fingerprints, whatever the input. All that share a variant are
    within the radius of each other, so linking them to the smallest keeps every group; the distance is verified again.
    """
    if radius not in (0, 1, 2):
        raise ValueError("a radius of 0, 1 or 2 is supported: half of it is at most one flipped bit")
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    near = F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x)) if radius else F.array().cast("array<bigint>")
    spread = fps.repartition(fps.sparkSession.sparkContext.defaultParallelism * 4, "fp")  # few narrow rows would be put together into few tasks
    emitted = spread.select("fp", F.explode(F.concat(F.array("fp"), near)).alias("variant"))
    met = emitted.groupBy("variant").agg(F.collect_list("fp").alias("all")).filter("size(all) > 1")
    pairs = met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a <> b")
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs` (doc_id, text; others are ignored).

    component_id is the smallest doc_id that links reach. Exact copies share a fingerprint and are joined back at the
    end, so a group of any size costs one fingerprint. Null or empty text: fingerprint zero, linked like any other. Null
    doc_id: a row of its own group's component, null if no row there has an id. Repeated rows stay. Empty table: no rows.
    """
    own = checkpointed(fingerprints(docs, shingle, seed))
    first = checkpointed(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(first.select("fp"), radius), "a", "b")
    rooted = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    low = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(low, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
