"""Scores to metrics. `by` names a group (model, repeat, fold ...); all groups are worked out in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.schema import METRICS


def record_scores(segments: DataFrame, by: list[str], how: str = "max") -> DataFrame:
    """One score per record: the largest, the mean or the upper quartile of its segments'."""
    score = {"max": F.max("score"), "mean": F.avg("score"), "q75": F.percentile("score", F.lit(0.75))}.get(how)
    if score is None:
        raise ValueError(f"unknown aggregation {how!r}")
    return segments.groupBy(*by, "record").agg(F.min("label").alias("label"), score.alias("score"))


def cumulative(scores: DataFrame, by: list[str]) -> DataFrame:
    """(by, score, tp, fp, pos, neg, pos_here) for every distinct score as a threshold, equal scores taken together."""
    g = scores.filter(F.col("score").isNotNull() & ~F.isnan("score")).groupBy(*by, "score").agg(F.count_if(F.col("label") == 1).alias("pos_here"), F.count_if(F.col("label") == 0).alias("_neg"))
    down = Window.partitionBy(*by).orderBy(F.desc("score"))
    whole = Window.partitionBy(*by)
    return g.select(*by, "score", "pos_here", F.sum("pos_here").over(down).alias("tp"), F.sum("_neg").over(down).alias("fp"), F.sum("pos_here").over(whole).alias("pos"), F.sum("_neg").over(whole).alias("neg"))


def matthews(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    d = [c.cast("double") for c in (tp, fp, fn, tn)]
    under = F.sqrt((d[0] + d[1]) * (d[0] + d[2]) * (d[3] + d[1]) * (d[3] + d[2]))
    return F.coalesce((d[0] * d[3] - d[1] * d[2]) / F.nullif(under, F.lit(0.0)), F.lit(0.0))


def thresholds(train: DataFrame, by: list[str], metric: str = "mcc") -> DataFrame:
    """(by, threshold): the score that, as `score >= threshold`, gives the best metric; of equals the lowest.

    0.5 where all labels are alike or no score is finite.
    """
    c = cumulative(train, by)
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("pos") - tp, F.col("neg") - fp
    value = {
        "mcc": matthews(tp, fp, fn, tn),
        "balanced_accuracy": (tp / F.nullif("pos", F.lit(0)) + tn / F.nullif("neg", F.lit(0))) / 2,
        "f1": F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0)),
    }.get(metric)
    if value is None:
        raise ValueError(f"unknown metric {metric!r}")
    best = c.filter("pos > 0 and neg > 0").groupBy(by).agg(F.max_by("score", F.struct(F.round(value, 12), -F.col("score"))).alias("_t"))
    return train.select(by).distinct().join(best, by, "left").select(*by, F.coalesce("_t", F.lit(0.5)).alias("threshold"))


def applied(scores: DataFrame, chosen: DataFrame, by: list[str]) -> DataFrame:
    return scores.join(chosen, by).withColumn("prediction", (F.col("score") >= F.col("threshold")).cast("int"))


def binary_metrics(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Counts and the eight threshold metrics. Undefined: 0 for precision, recall, F1 and MCC, null for the two rates;
    balanced accuracy is the mean over the classes that occur."""
    is_ = lambda label, p: F.count_if((F.col("label") == label) & (F.col("prediction") == p))
    g = predictions.groupBy(by).agg(is_(1, 1).alias("tp"), is_(0, 1).alias("fp"), is_(1, 0).alias("fn"), is_(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    part = lambda a, b: a / F.nullif(b, F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    sens, spec = part(tp, tp + fn), part(tn, tn + fp)
    classes = F.array_compact(F.array(sens, spec))
    return g.withColumns({
        "accuracy": part(tp + tn, tp + tn + fp + fn), "precision": zero(part(tp, tp + fp)), "recall": zero(sens), "specificity": spec, "sensitivity": sens,
        "f1": zero(part(2 * tp, 2 * tp + fp + fn)), "balanced_accuracy": F.aggregate(classes, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(classes), F.lit(0)), "mcc": matthews(tp, fp, fn, tn),
    })


def roc_auc(scores: DataFrame, by: list[str]) -> DataFrame:
    """Area by ranks, ties at their middle; null with one class."""
    c = cumulative(scores, by).withColumn("_neg", F.col("fp") - F.coalesce(F.lag("fp").over(Window.partitionBy(by).orderBy(F.desc("score"))), F.lit(0)))
    area = F.sum(F.col("_neg") * (F.col("tp") - F.col("pos_here") / 2.0)) / F.nullif(F.max("pos") * F.max("neg"), F.lit(0))
    return c.groupBy(by).agg(area.alias("roc_auc"))


def average_precision(scores: DataFrame, by: list[str]) -> DataFrame:
    """Precision summed over steps of recall, equal scores as one step; null with one class."""
    step = F.col("pos_here") / F.nullif("pos", F.lit(0)) * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return cumulative(scores, by).groupBy(by).agg(F.when((F.max("pos") > 0) & (F.max("neg") > 0), F.sum(step)).alias("average_precision"))


def all_metrics(predictions: DataFrame, by: list[str]) -> DataFrame:
    return binary_metrics(predictions, by).join(roc_auc(predictions, by), by, "left").join(average_precision(predictions, by), by, "left")


def repeat_metrics(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Metrics of folds pooled per repeat, with the number of records; a record that counts twice raises."""
    per = predictions.groupBy(*by, "record").agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in ("label", "score", "prediction")])
    once = per.withColumn("label", F.when(F.col("_n") == 1, F.col("label")).otherwise(F.raise_error(F.concat(F.lit("repeated record: "), F.col("record"))).cast("int")))
    sizes = predictions.groupBy(by).agg(F.count_distinct("record").alias("n_records"))
    return all_metrics(once, by).join(sizes, by)


def summary(repeats: DataFrame, by: list[str], metrics: list[str] = METRICS) -> DataFrame:
    return repeats.groupBy(by).agg(*[F.avg(m).alias(f"record_{m}_mean") for m in metrics])


def confusion(predictions: DataFrame, by: list[str]) -> DataFrame:
    """All four cells per group, with their share of the true label's row."""
    spark = predictions.sparkSession
    cells = F.broadcast(spark.createDataFrame([(a, b) for a in (0, 1) for b in (0, 1)], "label int, prediction int"))
    counts = predictions.groupBy(*by, "label", "prediction").agg(F.count("*").alias("n"))
    full = predictions.select(by).distinct().crossJoin(cells).join(counts, [*by, "label", "prediction"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    row = F.sum("n").over(Window.partitionBy(*by, "label"))
    return full.withColumn("share", F.col("n") / F.greatest(row, F.lit(1)))


def curves(scores: DataFrame, by: list[str]) -> DataFrame:
    """(by, curve, threshold, x, y): ROC and precision-recall points of groups with both classes; all points are kept."""
    c = cumulative(scores, by).filter("pos > 0 and neg > 0")
    tp, fp = F.col("tp"), F.col("fp")
    first = c.select(*by).distinct()
    none = F.lit(None).cast("double").alias("threshold")
    return (
        c.select(*by, F.lit("roc").alias("curve"), F.col("score").alias("threshold"), (fp / F.col("neg")).alias("x"), (tp / F.col("pos")).alias("y"))
        .union(c.select(*by, F.lit("pr"), "score", (tp / F.col("pos")), (tp / (tp + fp))))
        .union(first.select(*by, F.lit("roc"), none, F.lit(0.0), F.lit(0.0)))
        .union(first.select(*by, F.lit("pr"), none, F.lit(0.0), F.lit(1.0)))
    )


def best_model(summaries: DataFrame, by: list[str], rank: str = "model") -> DataFrame:
    """The model with the highest mean balanced accuracy; of equals the first by `rank`."""
    w = Window.partitionBy(by).orderBy(F.desc("record_balanced_accuracy_mean"), rank) if by else Window.partitionBy(F.lit(1)).orderBy(F.desc("record_balanced_accuracy_mean"), rank)
    return summaries.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def consensus(predictions: DataFrame, by: list[str], votes: int) -> DataFrame:
    """Majority vote per record over repeats. Another number of votes, an exact tie or two labels raise."""
    g = predictions.groupBy(*by, "record").agg(F.min("label").alias("label"), F.max("label").alias("_l"), F.sum("prediction").alias("_v"), F.count("*").alias("n_votes"), F.avg("score").alias("mean_score"))
    problem = F.when(F.col("label") != F.col("_l"), "labels differ").when(F.col("n_votes") != votes, "wrong number of votes").when(F.col("_v") * 2 == F.col("n_votes"), "tie")
    vote = F.when(problem.isNull(), (F.col("_v") * 2 > F.col("n_votes")).cast("int")).otherwise(F.raise_error(F.concat(problem, F.lit(": "), F.col("record"))).cast("int"))
    return g.select(*by, "record", "label", vote.alias("consensus"), (F.col("_v") / F.col("n_votes")).alias("vote_fraction"), "mean_score", "n_votes")
