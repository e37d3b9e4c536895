"""Writers: predictions, summaries, training metadata, report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import PREDICTION_COLUMNS

__all__ = ["fasta_to_abundance", "training_manifest", "write_predictions", "write_summary"]


def write_predictions(pred: DataFrame, folder: str) -> None:
    """Parquet, CSV with a header and JSON lines, all with the same columns in one order."""
    rows = pred.select(*PREDICTION_COLUMNS)
    rows.write.parquet(f"{folder}/parquet")
    rows.write.option("header", True).option("escape", '"').csv(f"{folder}/csv")
    rows.write.json(f"{folder}/json")


def write_summary(summary: DataFrame, folder: str, sample: str = "sample_id") -> None:
    """One JSON document for each sample, in a folder of its own."""
    body = F.to_json(F.struct(*[c for c in summary.columns if c != sample]))
    summary.select(sample, body.alias("value")).write.partitionBy(sample).text(folder)


def fasta_to_abundance(records: DataFrame) -> DataFrame:
    """Each record counts once: (sequence_id, sequence, n)."""
    return records.select("sequence_id", "sequence", F.lit(1).cast("long").alias("n"))


def training_manifest(splits: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """One row: the sorted class list, its size, and the rows of each split."""
    sizes = splits.groupBy(split).agg(F.count("*").alias("n"))
    classes = splits.select(label).distinct()
    a = classes.agg(F.array_sort(F.collect_list(label)).alias("classes"), F.count("*").alias("n_classes"))
    b = sizes.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(split, "n")))).alias("sizes"), F.sum("n").alias("n_rows"))
    return a.join(F.broadcast(b))
