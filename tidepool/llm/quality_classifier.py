"""Quality classifier: supervised subword embeddings.

A text's features are its words, pairs of adjacent words in their order, and the n-grams of
characters of words (those of three with the blanks around the word), hashed into ``BUCKETS``. Every
bucket has a learned vector; a text is the mean of its vectors, and a softmax over the two labels
follows. Vectors and output weights are trained together by plain stochastic gradient descent in
numpy. As the output is linear in the mean, a trained model scores with one number a bucket, and a
task adds those numbers up for whole batches of texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chars import STEP, char_hashes, code_points, part_hashes, prefix_sums, runs, text_chunks
from .common import NOT_SPACE, held_out, mix, randoms, sealed, table

BITS = 18
BUCKETS = 1 << BITS
GRAMS = (1, 2, 3)
DIM = 8
EPOCHS = 12
RATE = 8.0
#: Longest step of a text's vector, so that one text can't make training diverge.
CLIP = 1.0
#: Labelled rows to learn from, at most; of each, every feature of the whole text.
TRAIN_ROWS = 3000


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of all features of the texts, words first."""
    c, at = code_points(texts)
    word = np.ones(len(c), bool)
    low = c < 256
    word[low] = NOT_SPACE[c[low]]
    starts, ends = runs(word)
    sums = prefix_sums(c, starts, ends)
    one = part_hashes(sums, starts, ends - starts, 1)
    of = np.concatenate([[0], np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(at))])
    mine = of[starts]
    pair = np.flatnonzero(mine[1:] == mine[:-1])
    with np.errstate(over="ignore"):
        two = mix(one[pair] * STEP + one[pair + 1])
    out, owner = [one, two], [mine, mine[pair]]
    coded = np.where(word, char_hashes(c), np.uint64(0))
    blanks = np.concatenate([[0], np.cumsum(~word, dtype=np.int32)])
    for g in GRAMS:
        m = len(c) - g + 1
        if m < 1:
            continue
        if g < 3:
            where = np.flatnonzero(blanks[g:] == blanks[:-g])
        else:  # blanks only at the ends, and not at both ends of nothing
            where = np.flatnonzero((blanks[g - 1 : g - 1 + m] == blanks[1 : m + 1]) & word[1 : m + 1])
        r = randoms(g, 10 + g)
        x = np.zeros(len(where), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(g):
                x += coded[where + j] * r[j]
        out.append(mix(x))
        owner.append(of[where + (g > 2)])  # a first blank may be the one before the text
    return (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int32), np.concatenate(owner)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(a number for each bucket, log-odds of label 1 of a text without features), from the
    (distinct buckets, shares of the text's features) of each text."""
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 1) / (len(labels) + 2)
    prior = float(np.log(share / (1 - share)))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weights, bias = np.zeros((2, DIM), np.float32), np.array([-prior / 2, prior / 2], np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            u, c = rows[i]
            rate = RATE * (1 - done / steps)
            done += 1
            if not len(u):
                continue
            hidden = c @ vectors[u]
            z = weights @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1  # the gradient of the loss by z
            back = weights.T @ p
            back *= min(1.0, CLIP / max(float(np.sqrt(back @ back)), 1e-9))
            weights -= rate * np.outer(p, hidden)
            vectors[u] -= (rate * c)[:, None] * back
    return (vectors @ (weights[1] - weights[0])).astype(np.float32), prior


def labelled(docs: DataFrame, labels: DataFrame, column: str, most: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, label) of the labelled ids whose crc32 mod 5 isn't 0; of more than ``most`` of them
    always the same ones, those with the smallest hashes. A null text is empty; an id with several
    texts gives its smallest one, and one with several labels the larger."""
    use = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    ids = use.groupBy("doc_id").agg(F.max(column).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    ids = ids.select(F.col("doc_id").alias("_id"), "label")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def sample_features(rows: DataFrame) -> DataFrame:
    """(doc_id, label, buckets, counts) of rows (doc_id, text, label): at most BUCKETS numbers a row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in text_chunks(texts):
                f, owner = features(texts[i:j])
                u, n = np.unique(owner.astype(np.int64) << BITS | f, return_counts=True)
                cut = pa.array(np.searchsorted(u >> BITS, np.arange(j - i + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in (u & (BUCKETS - 1), n)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("label").slice(i, j - i), *lists], ["doc_id", "label", "buckets", "counts"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, label int, buckets array<int>, counts array<int>")


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS):
    """A model from labelled rows, ``most`` of them at most (the bound of what reaches the driver);
    tasks turn their texts into features. Without labelled rows every text scores 0.5."""
    import pyarrow.compute as pc

    got = sample_features(labelled(docs, labels, "quality", most)).orderBy("doc_id").toArrow()
    if not got.num_rows:
        return np.zeros(BUCKETS, np.float32), 0.0
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(got["buckets"]).to_numpy())])
    buckets, counts = (pc.list_flatten(got[x]).to_numpy() for x in ("buckets", "counts"))
    cut = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
    rows = [(buckets[i:j], counts[i:j].astype(np.float32) / max(1, int(counts[i:j].sum()))) for i, j in cut]
    return train(rows, got["label"].to_numpy())


def score(docs: DataFrame, model, threshold: float = 0.3) -> DataFrame:
    """All columns of docs with score (of label 1, 0 to 1) and predicted (1 from ``threshold`` on).

    Null and empty texts have no features and get the score of the labels' shares alone; texts of
    any length are taken whole. Repeated rows score alike. Columns of docs named score or predicted
    are replaced, others stay whatever they are called.
    """
    value = docs.sparkSession.sparkContext.broadcast(model)
    docs, back = sealed(docs, "doc_id", "text")

    def run(batches):
        import pyarrow as pa

        weight, prior = value.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            got = np.full(len(texts), prior)
            for i, j in text_chunks(texts):
                f, owner = features(texts[i:j])
                n = np.bincount(owner, minlength=j - i)
                got[i:j] += np.bincount(owner, weights=weight[f], minlength=j - i) / np.maximum(n, 1)
            p = np.round(1 / (1 + np.exp(-np.clip(got, -50, 50))), 6)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, "score"])

    out = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
    return back(out.withColumn("predicted", (F.col("score") >= threshold).cast("int")), "score", "predicted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
