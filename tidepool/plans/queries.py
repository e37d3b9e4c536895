"""All registered queries outside the llm subpackage."""

from . import analysis_queries, column_queries, source_queries  # noqa: F401  they register themselves
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "flagship"]


def flagship(spark, sf_dir):
    """Cluster composition and confidence profile of the embeddings: validated vectors, label means,
    nearest-centroid confidence, OTU labels, distribution and histogram."""
    from pyspark.sql import functions as F

    from ..operators import models, summary
    from . import views

    rows = views.v_rows(spark, sf_dir)
    width = models.validate_embeddings(views.v_emb(spark, sf_dir)).select("width")
    top = summary.rank_distribution(rows, "genus").select(F.lit("genus").alias("panel"), F.col("taxon").alias("name"), "n")
    bins = summary.confidence_histogram(rows).select(F.lit("confidence").alias("panel"), F.col("bin").alias("name"), "n")
    return top.unionByName(bins).join(F.broadcast(width))
