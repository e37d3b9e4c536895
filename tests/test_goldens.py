"""A known run of 32 reads, clustered into four, and a labelled read: the summaries that belong to them."""

from pyspark.sql import functions as F

from tidepool.functions.taxonomy import parse_taxonomy
from tidepool.operators import models, summary
from tidepool.schema import RANKS

# Cluster and confidence of each read in input order, and the summary of the run.
READS = [
    (2, 30.82), (3, 30.35), (4, 31.16), (1, 33.78), (1, 37.07), (1, 37.3), (1, 37.07), (1, 35.71), (3, 31.9), (3, 31.9), (3, 31.9), (2, 28.23), (4, 31.44), (4, 31.44), (2, 30.94), (2, 29.65),
    (4, 30.8), (4, 31.43), (2, 30.64), (3, 31.46), (2, 31.81), (2, 31.81), (1, 29.94), (2, 29.97), (4, 32.28), (4, 32.28), (4, 32.91), (4, 32.87), (4, 33.07), (4, 30.04), (4, 29.17), (4, 28.97),
]
TAXA = {"OTU-004": 13, "OTU-002": 8, "OTU-001": 6, "OTU-003": 5}
BINS = {"0-40": 32, "40-60": 0, "60-80": 0, "80-90": 0, "90-100": 0}
LABEL = 'Root;Bacteria;"Actinobacteria";Actinobacteria;Actinobacteridae;Actinomycetales;Streptomycineae;Streptomycetaceae;Streptomyces'
LABEL_RANKS = ["Root", "Bacteria", '"Actinobacteria"', "Actinobacteria", "Actinobacteridae", "Actinomycetales", "Streptomycineae"]


def test_summary_of_the_run(spark):
    assigned = spark.createDataFrame([(i, c - 1, x / 100) for i, (c, x) in enumerate(READS)], "sequence_id int, cluster int, confidence double")
    rows = models.otu_rows(assigned, models.FALLBACK)
    assert [r.confidence for r in rows.orderBy("sequence_id").collect()] == [x for _, x in READS]
    assert {(r.kingdom, r.method) for r in rows.collect()} == {("Unknown", "embedding_kmeans_fallback")}
    got = summary.classification_summary(rows, models.FALLBACK, "kmeans").first()
    assert (got.total_classified, got.mean_confidence) == (32, 31.88)
    assert got.phylum_distribution == got.genus_distribution == got.species_distribution == TAXA and got.confidence_distribution == BINS
    assert [(r.taxon, r.n) for r in summary.rank_distribution(rows, "genus").collect()] == list(TAXA.items())
    assert models.cluster_count(32) == 4


def test_ranks_of_a_label_that_begins_with_the_root(spark):
    got = spark.createDataFrame([(LABEL,)], "label string").select(parse_taxonomy(F.col("label")).alias("t")).first().t
    assert [got[r] for r in RANKS] == LABEL_RANKS
