"""The corpus pipeline: five stages over ``documents``, each on all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes each one's result as
Parquet in the shared folder and reads it again as the next one's docs. Until packing, columns other
than the text come out as they went in, whatever they are called; empty tables give empty ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidepool.llm import decontaminate, jaccard_join, line_dedup, packing, toxicity
from tidepool.llm.common import kept, scratch, sealed, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go; characters and words are learned from docs and
    labels. Null and empty texts have no words and stay; repeated rows are judged alike."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows, back = sealed(docs, "doc_id", "text")
    return back(toxicity.score(rows, model).where("predicted = 0"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated passages are cut from the texts; no document goes, also none
    whose text is null or becomes empty. n_chars stays what it was on input."""
    rows, back = sealed(docs, "doc_id", "text")
    return back(line_dedup.dedup_lines(rows))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id. Null and
    empty texts are nobody's duplicates and stay."""
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go; null and empty texts hold none."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents with their sequences and offsets; a null or empty text
    is one end token. Columns other than doc_id and text end here."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("jaccard_join", keep_one_of_similar),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Scores of a trained model and token ids have no SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch():  # what a stage has written on its way goes with it
            docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
