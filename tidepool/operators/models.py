"""Models on tables: clustering, supervised classifiers, embedding jobs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers as N
from ..functions.sequence import truncate
from ..functions.taxonomy import otu_label
from ..schema import RANKS, UNKNOWN
from ..storage import scratch, written
from . import balance, kmeans
from .evaluate import overall_report
from .features import as_vector, kmer_vector
from .lineage import apply_label_taxonomy, mask_low_confidence, with_ranks

#: Confidence of a model that gives no probabilities.
PLAIN_CONFIDENCE = 0.7
#: Method names in prediction rows (fixed values).
SUPERVISED, FALLBACK = "supervised_taxonomy", "embedding_kmeans_fallback"


def validate_embeddings(df: DataFrame, key: str = "sequence_id", vector: str = "embedding") -> DataFrame:
    """One row (rows, ids, width) if every id and vector is there and all vectors are of one width;
    the row can't be read otherwise: it raises the error."""
    a = df.agg(F.count("*").alias("rows"), F.count(key).alias("ids"), F.count(vector).alias("vectors"), F.min(F.size(vector)).alias("least"), F.max(F.size(vector)).alias("width"))
    bad = (F.col("ids") != F.col("rows")) | (F.col("vectors") != F.col("rows")) | (F.col("least") != F.col("width"))
    return a.select("rows", "ids", F.when(bad, F.raise_error(F.lit("embedding table: missing ids or vectors, or vectors of several widths")).cast("int")).otherwise(F.col("width")).alias("width"))


def cluster_count(n: int) -> int:
    return max(2, min(12, int(np.sqrt(max(2, n / 2)))))


def centroid_confidence(df: DataFrame, centroids: DataFrame, key: str = "sequence_id", vector: str = "embedding") -> DataFrame:
    """key, cluster, confidence: nearest centroid (the smallest number of equal ones), and
    exp(-d) / sum of exp(-d) over the distances to all. If every term underflows it is 0.

    centroids: cluster, center; a few rows, kept as one array next to each row.
    """
    table = centroids.agg(F.array_sort(F.collect_list(F.struct("cluster", F.col("center").cast("array<double>").alias("center")))).alias("_c"))
    v = df.select(key, F.col(vector).cast("array<double>").alias("_v")).join(F.broadcast(table))
    distance = lambda c: F.sqrt(F.aggregate(F.zip_with("_v", c["center"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    d = v.select(key, F.transform("_c", lambda c: F.struct(distance(c).alias("d"), c["cluster"].alias("cluster"))).alias("_d"))
    total = F.aggregate("_d", F.lit(0.0), lambda a, x: a + F.exp(-x["d"]))
    best = F.array_min("_d")
    return d.select(key, best["cluster"].alias("cluster"), F.when(total > 0, F.exp(-best["d"]) / total).otherwise(0.0).alias("confidence"))


def label_centroids(df: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(cluster, center): the mean vector of each label."""
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return df.groupBy(F.col(label).alias("cluster")).agg(vector_to_array(mean).alias("center"))


def otu_rows(assigned: DataFrame, method: str) -> DataFrame:
    """Prediction rows of clusters: the OTU name as phylum, genus and species; confidence in percent."""
    name = otu_label(F.col("cluster"))
    ranks = [name.alias(r) if r in ("phylum", "genus", "species") else F.lit(UNKNOWN).alias(r) for r in RANKS]
    return assigned.select("sequence_id", *ranks, N.scale_confidence(F.col("confidence")).alias("confidence"), F.lit(method).alias("method"), name.alias("predicted_label"))


def otu_cluster(df: DataFrame, seed: int = 42, restarts: int = 10) -> DataFrame:
    """Prediction rows from k-means, the best of several starts (fitted in the same scans); clusters are numbered by size,
    then by their first id. One row is OTU-001 with 100; no rows give none. Rows without a vector are left out."""
    df = df.where(F.col("embedding").isNotNull())
    n = df.count()
    if n <= 1:
        return otu_rows(df.select("sequence_id", F.lit(0).alias("cluster"), F.lit(1.0).alias("confidence")), FALLBACK)
    rows = df.select("sequence_id", F.col("embedding").cast("array<double>").alias("_v")).persist()
    try:
        sample, k = kmeans.sample_of(rows, "sequence_id", "_v"), cluster_count(n)
        models = kmeans.fit(rows, np.stack([kmeans.refined(sample, kmeans.plus_plus(sample, k, seed + i)) for i in range(restarts)]))
        centers = min(models, key=lambda m: m.cost).centers
        sizes = kmeans.sizes(rows, centers, "sequence_id").orderBy(F.desc("n"), "first").collect()  # a row a cluster
    finally:
        rows.unpersist()
    order = [r["cluster"] for r in sizes]
    order += [i for i in range(len(centers)) if i not in set(order)]
    table = df.sparkSession.createDataFrame([(i, [float(x) for x in centers[old]]) for i, old in enumerate(order)], "cluster int, center array<double>")
    return otu_rows(centroid_confidence(df, table), FALLBACK)


def fit_rf(df: DataFrame, label: str = "label", features: str = "features", trees: int = 100, seed: int = 42) -> PipelineModel:
    """A scaled random forest. The rows are read several times."""
    stages = [StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc"), StandardScaler(withMean=True, inputCol=features, outputCol="_x"), RandomForestClassifier(featuresCol="_x", labelCol="_y", predictionCol="_p", probabilityCol="_prob", numTrees=trees, seed=seed)]
    indexed = Pipeline(stages=stages).fit(df)
    return PipelineModel([*indexed.stages, IndexToString(inputCol="_p", outputCol="predicted_label", labels=indexed.stages[0].labels)])


def train_rf(df: DataFrame, label: str = "label", features: str = "features", trees: int = 100, seed: int = 42) -> tuple[PipelineModel, float]:
    """A scaled random forest and its accuracy on the rows it was trained on."""
    model = fit_rf(df, label, features, trees, seed)
    accuracy = model.transform(df).agg(F.avg((F.col("predicted_label") == F.col(label)).cast("double"))).first()[0]
    return model, accuracy


def save_model(model: PipelineModel, path: str) -> None:
    """The whole model (scaling, trees, labels) as a folder of any file system that Spark writes to."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


@dataclass(frozen=True)
class Bundle:
    """A classifier and the ranks of its labels: ``taxonomy`` has label and the seven ranks, if any."""

    model: PipelineModel
    taxonomy: DataFrame | None = None


def save_bundle(bundle: Bundle, path: str) -> None:
    """Model and taxonomy as two folders; a bundle that was there is replaced."""
    spark = SparkSession.active()
    save_model(bundle.model, f"{path}/model")
    known = bundle.taxonomy if bundle.taxonomy is not None else spark.createDataFrame([], "label string, " + ", ".join(f"`{r}` string" for r in RANKS))
    known.select("label", *RANKS).write.mode("overwrite").parquet(f"{path}/taxonomy")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    schema = "label string, " + ", ".join(f"`{r}` string" for r in RANKS)
    return Bundle(load_model(f"{path}/model"), spark.read.schema(schema).parquet(f"{path}/taxonomy"))


def classify_bundle(df: DataFrame, bundle: Bundle, threshold: float = 0.0) -> DataFrame:
    """``classify_supervised`` with a bundle's model and taxonomy."""
    return classify_supervised(df, bundle.model, bundle.taxonomy, threshold)


def serving(model: PipelineModel) -> PipelineModel:
    """The model without the stage that needs labels."""
    return PipelineModel([s for s in model.stages if "StringIndexer" not in type(s).__name__])


def classify_supervised(df: DataFrame, model: PipelineModel, known: DataFrame | None = None, threshold: float = 0.0) -> DataFrame:
    """Prediction rows of a saved model: label, largest probability (PLAIN_CONFIDENCE without
    probabilities), ranks of the label, Unknown below the threshold.
    df: sequence_id, features. known: label and ranks that win over parsing."""
    out = serving(model).transform(df)
    confidence = F.array_max(vector_to_array("_prob")) if "_prob" in out.columns else F.lit(PLAIN_CONFIDENCE)
    rows = out.select("sequence_id", "predicted_label", confidence.alias("confidence"))
    rows = apply_label_taxonomy(rows, known) if known is not None else with_ranks(rows)
    return mask_low_confidence(rows, threshold).select("sequence_id", *RANKS, N.scale_confidence(F.col("confidence")).alias("confidence"), F.lit(SUPERVISED).alias("method"), "predicted_label")


def classify(df: DataFrame, model: PipelineModel | None = None, **kw) -> DataFrame:
    """With a model its predictions, without one OTU clusters; ``method`` says which."""
    return classify_supervised(as_vector(df), model, **kw) if model is not None else otu_cluster(df)


def train_eval(df: DataFrame, kind: str = "logistic", test_size: float = 0.2, seed: int = 42) -> tuple[PipelineModel, DataFrame]:
    """A model trained on a stratified part of (id, features, label), and its report on the rest."""
    parts = balance.stratified_split(df, (("train", 1 - test_size), ("test", test_size)), seed)
    train, test = parts.where("split = 'train'"), parts.where("split = 'test'")
    if kind == "forest":
        model, _ = train_rf(train, seed=seed)
    else:
        fitted = Pipeline(stages=[StringIndexer(inputCol="label", outputCol="_y", stringOrderType="alphabetAsc"), LogisticRegression(featuresCol="features", labelCol="_y", predictionCol="_p", probabilityCol="_prob", maxIter=1000)]).fit(train)
        model = PipelineModel([*fitted.stages, IndexToString(inputCol="_p", outputCol="predicted_label", labels=fitted.stages[0].labels)])
    scored = serving(model).transform(test).select(F.col("label").alias("true_label"), "predicted_label")
    return model, overall_report(scored)


def train_kmer_rf(df: DataFrame, k: int = 4, seed: int = 42, trees: int = 50) -> tuple[PipelineModel, dict]:
    """(seq, label) -> model and {accuracy, macro_f1, num_samples}. Sequences are read and counted once; the forest and its
    report read the stored vectors."""
    with scratch():
        rows = written(kmer_vector(df, k).select("label", "features"), "vectors")
        model = fit_rf(rows, trees=trees, seed=seed)
        scored = written(model.transform(rows).select(F.col("label").alias("true_label"), "predicted_label"), "scored")
        accuracy, n = scored.agg(F.avg((F.col("predicted_label") == F.col("true_label")).cast("double")), F.count("*")).first()
        return model, {"accuracy": accuracy, "macro_f1": overall_report(scored).first()["macro_f1"], "num_samples": n}


def predict_kmer_rf(df: DataFrame, model: PipelineModel, k: int = 4) -> DataFrame:
    rows = serving(model).transform(kmer_vector(df, k))
    out = rows.select("sequence_id", "predicted_label", F.array_max(vector_to_array("_prob")).alias("confidence_score"), F.lit("random_forest_kmer").alias("method"))
    return with_ranks(out)


def kmer_encoder(k: int = 4) -> Callable:
    """The default encoder: relative frequencies of the 4^k words, as a batch function."""

    def make():
        code = np.full(256, -1)
        code[[ord(b) for b in "ACGT"]] = range(4)

        def predict(seqs: np.ndarray) -> np.ndarray:
            out = np.zeros((len(seqs), 4**k), np.float32)
            for i, s in enumerate(seqs):
                x = code[np.frombuffer(str(s).encode("latin-1", "replace"), np.uint8)]
                if len(x) >= k:
                    w = np.lib.stride_tricks.sliding_window_view(x, k)
                    w = w[(w >= 0).all(1)] @ (4 ** np.arange(k - 1, -1, -1))
                    out[i] = np.bincount(w, minlength=4**k) / max(1, len(w))
            return out

        return predict

    return make


def embed(df: DataFrame, encoder: Callable | None = None, batch: int = 32, max_length: int = 256, model_name: str = "kmer4", seq: str = "seq", key: str = "sequence_id") -> DataFrame:
    """sequence_id, embedding, model_name, max_length: batches of truncated sequences through any
    encoder (a function that loads a model once a worker and gives its batch function)."""
    udf = predict_batch_udf(encoder or kmer_encoder(), return_type=T.ArrayType(T.FloatType()), batch_size=batch)
    return df.select(F.col(key).alias("sequence_id"), udf(truncate(F.col(seq), max_length)).alias("embedding"), F.lit(model_name).alias("model_name"), F.lit(max_length).alias("max_length"))


def hybrid_route(preds: DataFrame, embeddings: DataFrame, threshold: float = 70.0) -> DataFrame:
    """Predictions of at least the threshold stay; the others are clustered and get OTU rows, with
    the row nearest to each centroid (most confident, then first by id) as representative."""
    sure = preds.where(F.col("confidence") >= threshold).select("sequence_id", *RANKS, "confidence", "method", "predicted_label")
    rest = embeddings.join(preds.where(F.col("confidence") < threshold).select("sequence_id"), "sequence_id", "left_semi")
    otu = otu_cluster(rest)
    chosen = otu.groupBy("predicted_label").agg(F.min_by("sequence_id", F.struct(-F.col("confidence"), "sequence_id")).alias("_s"))
    otu = otu.join(F.broadcast(chosen), "predicted_label").withColumn("representative", F.col("sequence_id") == F.col("_s")).drop("_s")
    return sure.withColumn("representative", F.lit(False)).unionByName(otu.select(*sure.columns, "representative"))


