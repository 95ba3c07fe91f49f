"""Training-corpus pipeline over `documents`: quality, near-duplicates, benchmark leaks, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns
of `docs`; the last returns pieces of packed sequences. Null texts count as empty, a row with a null id
is judged on its text like any other, and an empty table runs through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm import decontaminate, packing, pii, quality, shingles
from undula.llm.shared import checkpointed, table, written


#: Rows that go to a Python worker at a time.
BATCH_ROWS = 1000


def lean(spark: SparkSession) -> None:
    """Hands texts to Python workers in small batches, so that neither they nor the JVM hold many; a session with smaller ones keeps them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def row_key() -> Column:
    """A row's own key: its id and its text."""
    return F.xxhash64("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")))


def free_name(docs: DataFrame) -> str:
    """A column name that the documents don't have."""
    taken, name = {c.lower() for c in docs.columns}, "_key"
    while name in taken:
        name += "_"
    return name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, each row by its own text; all where no model can be fitted."""
    lean(spark)
    key = free_name(docs)
    keyed = docs.withColumn(key, row_key())
    scores = quality.scored(keyed, table(spark, sf_dir, "labels"), carry=(key,), unfitted=1.0)
    rejected = scores.filter(F.col("score") < quality.KEEP).select(key).distinct()
    return keyed.join(rejected, key, "left_anti").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by links of 0.8 or more of their 5-word shingles, the one with the smallest id; none of an empty table.

    Every row is judged on its text: one without an id goes if another of its group has one, and of rows with one id only
    those that link are alike.
    """
    lean(spark)
    key = free_name(docs)
    keyed = docs.withColumn(key, row_key())
    own = shingles.groups(keyed.select(F.col(key).alias("key"), "text")).select("key", "root")
    named = checkpointed(own.join(keyed.select(F.col(key).alias("key"), "doc_id").distinct(), "key"))
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))["key"].alias("first"))
    others = named.join(first, "root").filter("key <> first").select(F.col("key").alias(key)).distinct()
    kept = keyed.join(others, key, "left_anti")
    if not named.groupBy("key").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates([key])
    return kept.select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is covered, each row by its own text.

    Null, empty and null-id rows are judged like any others (a text without tokens holds nothing); repeated rows stay or go
    together; without documents nothing comes out, without benchmark items everything.
    """
    lean(spark)
    key = free_name(docs)
    keyed = docs.withColumn(key, row_key())
    rows = keyed.select(F.col(key).alias("doc_id"), "text")
    leaks = decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(leaks, key, "left_anti").select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, spans of personal data replaced by their kind; n_chars follows the text where it is given.

    Null texts stay null, null ids and repeated rows stay, equal texts get equal texts; an empty table stays empty.
    """
    out = pii.redacted(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(F.coalesce("text", F.lit("")))).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of all documents; null texts are their end id alone, repeated rows and null ids are packed each."""
    lean(spark)
    return packing.packed(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]
#: Fitted models and tokenizers have no SQL form; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each written as Parquet and read again as the next one's input.

    An empty table, or one of which a stage keeps nothing, gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return pack(spark, docs, sf_dir)
