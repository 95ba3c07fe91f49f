"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.schema import DEMOGRAPHICS, EPS


def number(c: Column) -> Column:
    """As double; NaN becomes null, so that aggregates skip it."""
    return F.nullif(c.cast("double"), F.lit(float("nan")))


def parse_label(record: str = "record") -> Column:
    """1 or 0 if the second part of a name begins with p or t, else -1."""
    part = F.lower(F.try_element_at(F.split(record, "_"), F.lit(2)))
    return F.when(part.startswith("p"), 1).when(part.startswith("t"), 0).otherwise(-1)


def label_name(label: str = "label") -> Column:
    return F.when(F.col(label) == 1, "preterm").otherwise("term")


def seconds(n: str, fs: float) -> Column:
    return F.col(n).cast("double") / F.lit(fs)


def safe_cv(mean: Column, std: Column) -> Column:
    return std / (mean + EPS)


def demographics(comments: str = "comments") -> list[Column]:
    return [F.coalesce(F.try_element_at(comments, F.lit(k)), F.lit("")).alias(k) for k in DEMOGRAPHICS]


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Floating-point columns rounded half to even; others untouched."""
    return df.select([F.bround(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def mode_number(components: str, k: int) -> Column:
    """The k-th component (from 1), null if there are fewer."""
    if k < 1:
        raise ValueError("components are counted from 1")
    return F.try_element_at(components, F.lit(k))


def experiment_name(mode: str = "mode", source: str = "feature_source") -> Column:
    return F.concat_ws("_", mode, source)


def nothing_if_zero(c: Column) -> Column:
    return F.nullif(c, F.lit(0))
