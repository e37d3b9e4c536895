"""Evaluation of predictions against known labels, as aggregates."""

from __future__ import annotations

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_matrix(df: DataFrame, actual: str = "true_label", predicted: str = "predicted_label") -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, actual: str = "true_label", predicted: str = "predicted_label") -> DataFrame:
    """class, precision, recall, f1, support for each label seen on either side; 0 on an empty denominator."""
    m = confusion_matrix(df, actual, predicted)
    side = lambda c: m.groupBy(F.col(c).alias("class")).agg(F.sum("n").alias(c), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias(f"hit_{c}"))
    both = side("actual").join(side("predicted"), "class", "full")
    hit = F.coalesce("hit_actual", "hit_predicted", F.lit(0))
    support, given = F.coalesce("actual", F.lit(0)), F.coalesce("predicted", F.lit(0))
    p, r = F.when(given > 0, hit / given).otherwise(0.0), F.when(support > 0, hit / support).otherwise(0.0)
    rows = both.select("class", p.alias("p"), r.alias("r"), support.alias("support"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return rows.select("class", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(f1, 6).alias("f1"), "support").orderBy(F.desc("f1"), "class")


def overall_report(df: DataFrame, actual: str = "true_label", predicted: str = "predicted_label") -> DataFrame:
    """One row: accuracy, macro and weighted F1, number of classes."""
    r = class_report(df, actual, predicted)
    a = df.agg(F.round(F.avg((F.col(actual) == F.col(predicted)).cast("double")), 6).alias("accuracy"))
    b = r.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), 6).alias("weighted_f1"), F.count("*").alias("classes"))
    return a.join(F.broadcast(b))


def topk_accuracy(df: DataFrame, actual: str = "true_label", top: str = "top_labels") -> DataFrame:
    return df.agg(F.round(F.avg(F.array_contains(F.col(top), F.col(actual)).cast("double")), 6).alias("accuracy"))


def cluster_quality(df: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """cluster, size, majority label and purity."""
    n = df.groupBy(cluster, label).agg(F.count("*").alias("n"))
    return n.groupBy(cluster).agg(F.sum("n").alias("size"), F.min_by(label, F.struct(-F.col("n"), label)).alias("majority"), F.round(F.max("n") / F.sum("n"), 6).alias("purity"))


def silhouette(df: DataFrame, features: str = "features", cluster: str = "cluster") -> float:
    return ClusteringEvaluator(featuresCol=features, predictionCol=cluster).evaluate(df)
