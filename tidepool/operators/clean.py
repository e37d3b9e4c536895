"""Filters and repairs of sequence tables, and quality control of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..schema import RANKS, UNKNOWN
from .parents import chimeras, denoise, near_pairs, remove_chimeras  # noqa: F401


def filter_iupac(df: DataFrame, seq: str = "seq") -> DataFrame:
    return df.where(S.is_iupac(F.col(seq)))


def filter_length(df: DataFrame, lo: int = 200, hi: int = 2000, seq: str = "seq") -> DataFrame:
    """Both bounds are allowed lengths."""
    return df.where(F.length(seq).between(lo, hi))


def drop_unknown(df: DataFrame, rank: str = "species") -> DataFrame:
    """Rows whose rank is known. Where an empty result is an error, ``require_rows`` says so."""
    return df.where(F.coalesce(F.col(rank), F.lit(UNKNOWN)) != UNKNOWN)


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def fill_ranks(df: DataFrame) -> DataFrame:
    """All seven ranks, missing columns and null values as Unknown."""
    return df.withColumns({r: F.coalesce(F.col(f"`{r}`"), F.lit(UNKNOWN)) if r in df.columns else F.lit(UNKNOWN) for r in RANKS})


def dedup_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in input order. The rows that lose go in the map-side part of an
    aggregate of whole rows, so a key in a third of all rows doesn't meet in one task."""
    rest = [c for c in df.columns if c != key and c not in order]
    return df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_r")).select(key, "_r.*").select(*df.columns)


def cleaning_reasons(df: DataFrame, rank: str = "species", lo: int = 200, hi: int = 2000, seq: str = "seq") -> DataFrame:
    """The first step of the cleaning chain that drops a row, in one pass; null if it stays."""
    s = S.normalize(F.col(seq))
    return df.withColumn("dropped_by", F.when(F.coalesce(F.col(rank), F.lit(UNKNOWN)) == UNKNOWN, "unknown").when(~S.is_iupac(s), "iupac").when(~F.length(s).between(lo, hi), "length"))


def filter_quality(df: DataFrame, least: float = 20, quality: str = "quality", out: str | None = None) -> DataFrame:
    """Rows whose mean score is high enough; ``out`` names a column for the score. Qualities are read and scored once."""
    name = out or "_mean"
    kept = df.withColumn(name, S.mean_quality(F.col(quality))).where(F.col(name) >= least)
    return kept if out else kept.drop(name)


def filter_expected_errors(df: DataFrame, most: float = 2.0, quality: str = "quality") -> DataFrame:
    return df.where(S.expected_errors(F.col(quality)) <= most)


def trim_primer(df: DataFrame, primer: str, seq: str = "seq", quality: str | None = "quality") -> DataFrame:
    """The primer goes from the start of reads that begin with it, and its qualities with it."""
    hit = F.col(seq).rlike(S.primer_pattern(primer))
    cut = {c: F.when(hit, F.substring(c, len(primer) + 1, 1 << 30)).otherwise(F.col(c)) for c in [seq, *([quality] if quality else [])]}
    return df.withColumns(cut | {"trimmed": hit})


def drop_ambiguous(df: DataFrame, seq: str = "seq") -> DataFrame:
    return df.where(F.col(seq).rlike("^[ACGT]+$"))


def merge_pairs(forward: DataFrame, reverse: DataFrame, least: int = 10, keys: tuple[str, ...] = ("sample_id", "read_id")) -> DataFrame:
    """Keys, overlap and merged sequence of read pairs: the longest end of the forward read that
    the reverse complement of the other begins with, of ``least`` bases or more. Unmerged pairs
    stay with a null sequence, so merge statistics are an aggregate of the result. The work grows with
    the reads' lengths, not with their squares."""
    r2 = reverse.select(*keys, S.reverse_complement(F.col("seq")).alias("_b"))
    both = forward.select(*keys, F.col("seq").alias("_a")).join(r2, list(keys))
    both = both.withColumn("overlap", S.longest_overlap(least)("_a", "_b"))
    merged = F.when(F.col("overlap") > 0, F.concat("_a", F.expr("substring(_b, overlap + 1)")))
    return both.select(*keys, "overlap", merged.alias("seq"))


def merge_stats(merged: DataFrame) -> DataFrame:
    """sample_id, pairs, merged, rate (%) and mean_overlap (of the merged ones) of a ``merge_pairs`` result."""
    some = F.col("seq").isNotNull()
    return merged.groupBy("sample_id").agg(F.count("*").alias("pairs"), F.count_if(some).alias("merged"), F.round(100.0 * F.count_if(some) / F.count("*"), 2).alias("rate"), F.round(F.coalesce(F.avg(F.when(some, F.col("overlap"))), F.lit(0.0)), 4).alias("mean_overlap"))


def dereplicate(df: DataFrame, min_size: int = 1, sample: str = "sample_id", seq: str = "seq") -> DataFrame:
    return df.groupBy(sample, seq).agg(F.count("*").alias("n")).where(F.col("n") >= min_size)


def retention_stats(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """stage, rows, uniques and rate (% of the first stage's rows) in the order given."""
    each = [df.agg(F.lit(i).alias("at"), F.lit(name).alias("stage"), F.count("*").alias("n"), F.countDistinct("seq").alias("uniques")) for i, (name, df) in enumerate(stages)]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    first = F.first("n").over(W.orderBy("at"))
    return out.select("stage", "n", "uniques", F.round(F.when(first > 0, 100.0 * F.col("n") / first).otherwise(0.0), 2).alias("rate"))
