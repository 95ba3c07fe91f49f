"""Grouped permutation importance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.operators.evaluate import average_precision, record_scores


_BETWEEN = "\x1f"


def permuted(rows: DataFrame, columns: list[str], by: list[str], order: str, seed: str) -> DataFrame:
    """`rows` with `columns` jointly taken from another row of the same group, by a permutation drawn from a hash of `seed`."""
    natural = F.row_number().over(Window.partitionBy(by).orderBy(order))
    drawn = F.row_number().over(Window.partitionBy(by).orderBy(F.md5(F.concat_ws(":", F.lit(seed), *[F.col(b).cast("string") for b in by], F.col(order).cast("string"))), order))
    other = rows.select(*by, drawn.alias("_k"), *[F.col(c).alias(f"_o_{c}") for c in columns])
    j = rows.withColumn("_k", natural).join(other, [*by, "_k"])
    return j.withColumns({c: F.col(f"_o_{c}") for c in columns}).select(rows.columns)


def all_permuted(rows: DataFrame, families: dict[str, list[str]], by: list[str], order: str, permutations: int) -> DataFrame:
    """`rows` once for every (permutation, feature_group), each with that family's columns permuted as `permuted` does."""
    variants = F.array(*[F.struct(F.lit(p).alias("permutation"), F.lit(f).alias("feature_group")) for p in range(permutations) for f in families])
    columns = sorted({c for cs in families.values() for c in cs})
    natural = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    each = rows.withColumn("_k", natural).select("*", F.inline(variants))
    group = [*by, "permutation", "feature_group"]
    seed = F.concat_ws(":", F.col("permutation").cast("string"), "feature_group", *[F.col(b).cast("string") for b in by], F.col(order).cast("string"))
    drawn = F.row_number().over(Window.partitionBy(group).orderBy(F.md5(seed), order))
    other = each.select(*group, drawn.alias("_k"), *[F.col(c).alias(f"_o_{c}") for c in columns])
    held = {c: [f for f, cs in families.items() if c in cs] for c in columns}
    j = each.join(other, [*group, "_k"])
    return j.withColumns({c: F.when(F.col("feature_group").isin(held[c]), F.col(f"_o_{c}")).otherwise(F.col(c)) for c in columns}).select(*rows.columns, "permutation", "feature_group")


def importance(validation: DataFrame, families: dict[str, list[str]], score, order: str, permutations: int = 1, by: tuple[str, ...] = ("repeat", "fold")) -> DataFrame:
    """(repeat, permutation, feature_group, n_features, baseline_ap, permuted_ap, decrease_ap).

    `score` maps rows (of the columns of `validation`) to the same rows with a score; the models behind it are fitted once and
    reused. All permutations of all families are rows of one table, so they are scored in one pass; meanwhile the record's
    name carries which permutation a row belongs to. Records are scored by their largest segment score, folds pooled per repeat.
    """

    base = average_precision(record_scores(score(validation), ["repeat"]), ["repeat"]).withColumnRenamed("average_precision", "baseline_ap")
    each = all_permuted(validation, families, list(by), order, permutations)
    named = each.withColumn("record", F.concat_ws(_BETWEEN, F.col("permutation").cast("string"), "feature_group", F.col("record").cast("string")))
    part = F.split("record", _BETWEEN, 3)
    told = score(named.select(validation.columns)).withColumns({"permutation": part[0].cast("int"), "feature_group": part[1]})
    keys = ["repeat", "permutation", "feature_group"]
    moved = average_precision(record_scores(told, keys), keys).withColumnRenamed("average_precision", "permuted_ap")
    sizes = F.create_map(*[F.lit(x) for f, cs in families.items() for x in (f, len(cs))])
    both = moved.withColumn("n_features", sizes[F.col("feature_group")]).join(base, "repeat")
    return both.withColumn("decrease_ap", F.col("baseline_ap") - F.col("permuted_ap"))


def importance_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("feature_group").agg(F.avg("decrease_ap").alias("mean_decrease_ap"), F.count_distinct("repeat").alias("n_repeats"), F.count_distinct("permutation").alias("n_permutations"), F.count("*").alias("n"), F.first("n_features").alias("n_features"))
