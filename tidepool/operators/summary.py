"""Summaries of predictions: distributions, histograms, top lists, report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.taxonomy import or_unknown
from ..schema import RANKS, UNKNOWN

#: Names of the confidence bins, by their limits in percent (fixed values).
BINS = ["0-40", "40-60", "60-80", "80-90", "90-100"]


def distribution(df: DataFrame, column: str, order: str = "sequence_id") -> DataFrame:
    """(taxon, n, first): first is the smallest order key, the tie-breaker of top lists."""
    return df.groupBy(or_unknown(F.col(f"`{column}`")).alias("taxon")).agg(F.count("*").alias("n"), F.min(order).alias("first"))


def rank_distribution(df: DataFrame, rank: str, n: int = 20, order: str = "sequence_id") -> DataFrame:
    """The n most frequent taxa; of equally frequent ones those first seen."""
    return distribution(df, rank, order).orderBy(F.desc("n"), "first").limit(n).select("taxon", "n")


def rank_distribution_by(df: DataFrame, group: str, rank: str, n: int = 20, order: str = "sequence_id") -> DataFrame:
    counts = df.groupBy(group, or_unknown(F.col(f"`{rank}`")).alias("taxon")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    place = F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), "first"))
    return counts.withColumn("place", place).where(F.col("place") <= n).select(group, "taxon", "n", "place")


def confidence_bin(c: Column) -> Column:
    return F.when(c < 40, BINS[0]).when(c < 60, BINS[1]).when(c < 80, BINS[2]).when(c < 90, BINS[3]).otherwise(BINS[4])


def confidence_histogram(df: DataFrame, confidence: str = "confidence") -> DataFrame:
    """(bin, n), empty bins with 0; a null confidence counts as 0, NaN as the last bin."""
    c = F.coalesce(F.col(confidence), F.lit(0.0))
    counts = df.groupBy(confidence_bin(c).alias("bin")).agg(F.count("*").alias("n"))
    bins = df.sparkSession.createDataFrame([(b,) for b in BINS], "bin string")
    return F.broadcast(bins).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def confidence_stats(df: DataFrame, confidence: str = "confidence") -> DataFrame:
    return df.agg(F.count("*").alias("total_classified"), F.round(F.coalesce(F.avg(F.coalesce(F.col(confidence), F.lit(0.0))), F.lit(0.0)), 2).alias("mean_confidence"))


def classification_summary(df: DataFrame, mode: str, classifier: str, n: int = 20) -> DataFrame:
    """One row: totals and four distributions as maps."""
    out = confidence_stats(df).withColumns({"classification_mode": F.lit(mode), "classifier": F.lit(classifier)})
    entry = lambda d, k: d.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, "n")))).alias("m"))
    for rank in ("phylum", "genus", "species"):
        out = out.join(F.broadcast(entry(rank_distribution(df, rank, n), "taxon").withColumnRenamed("m", f"{rank}_distribution")))
    return out.join(F.broadcast(entry(confidence_histogram(df), "bin").withColumnRenamed("m", "confidence_distribution")))


def top_n_other(counts: DataFrame, n: int = 5, name: str = "taxon") -> DataFrame:
    """The n largest and the rest as ``Other``, which is left out when it is 0."""
    top = counts.orderBy(F.desc("n"), name).limit(n)
    rest = counts.join(F.broadcast(top.select(name)), name, "left_anti").agg(F.lit("Other").alias(name), F.sum("n").alias("n")).where(F.col("n") > 0)
    return top.select(name, "n").unionByName(rest)


def top_positive(counts: DataFrame, n: int = 10, name: str = "taxon", value: str = "n") -> DataFrame:
    """The n largest positive values; what isn't a number is left out."""
    v = F.col(value).cast("string").try_cast("double")
    return counts.select(name, v.alias(value)).where(v > 0).orderBy(F.desc(value), name).limit(n)


def preview(df: DataFrame, n: int = 20, *order: str) -> DataFrame:
    return df.orderBy(*(order or ("sequence_id",))).limit(n)


def order_by_list(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows by the place of a category in the list; others last, alphabetically."""
    place = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))
    return df.withColumn("place", F.when(place > 0, place).otherwise(len(values) + 1).cast("int")).orderBy("place", column)


def unpivoted(df: DataFrame, *keep: str) -> DataFrame:
    """(keep, rank, taxon): seven rows for each prediction."""
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), or_unknown(F.col(f"`{r}`")).alias("taxon")) for r in RANKS])).alias("v")).select(*keep, "v.*")


def rank_success(df: DataFrame) -> DataFrame:
    """rank, known, percent: how many predictions name a taxon at each rank."""
    known = F.count_if(F.col("taxon") != UNKNOWN)
    return unpivoted(df).groupBy("rank").agg(known.alias("known"), F.round(100.0 * known / F.count("*"), 2).alias("percent"))


def top_taxa(df: DataFrame, rank: str, n: int = 5, order: str = "sequence_id") -> DataFrame:
    total = df.agg(F.count("*").alias("total"))
    return rank_distribution(df, rank, n, order).join(F.broadcast(total)).select("taxon", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("percent"))


def report_tables(df: DataFrame, mode: str = "supervised", classifier: str = "model") -> dict[str, DataFrame]:
    """The tables of a classification report: cards, four panels, and a preview of 200 rows."""
    panels = {f"{r}_panel": top_positive(rank_distribution(df, r), 12) for r in ("phylum", "genus", "species")}
    return {"cards": confidence_stats(df).withColumns({"mode": F.lit(mode), "classifier": F.lit(classifier)}), **panels, "confidence_panel": confidence_histogram(df), "preview": preview(df, 200)}


def flag_novel(df: DataFrame, threshold: float = 70.0) -> DataFrame:
    """Consensus predictions of low confidence may be new taxa."""
    return df.withColumn("novel", (F.col("confidence") < threshold) & (F.col("method") == "consensus"))
