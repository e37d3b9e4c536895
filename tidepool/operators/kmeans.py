"""K-means with all restarts in one scan a round.

A round multiplies each batch of vectors with the centers of all models that still move, so ten restarts
read the table as often as one does. Tasks pass on sums by (model, cluster); the driver sees those, the
centers, and the bounded sample that the models start from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbours import matrix

#: Rows that starting centers are chosen from, at most; vectors that are multiplied at once.
SAMPLE_ROWS, SLICE = 8192, 4096
#: Rounds at most, and how far a center may move in the last one.
ROUNDS, TOLERANCE = 50, 1e-4


@dataclass
class Model:
    centers: np.ndarray
    cost: float
    rounds: int


def sample_of(df: DataFrame, key: str, vector: str, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """A fixed choice of at most so many vectors, those with the smallest hashes of their keys."""
    few = df.select(F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("_v")).where("_v IS NOT NULL").orderBy(F.xxhash64("_k"), "_k").limit(rows).toArrow()
    return matrix(few["_v"].combine_chunks()) if len(few) else np.zeros((0, 0))


def plus_plus(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Starting centers by k-means++: each one drawn by its squared distance to those before."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(sample)))]
    near = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        total = near.sum()
        i = int(np.searchsorted(np.cumsum(near), rng.random() * total, side="right")) if total > 0 else int(rng.integers(len(sample)))
        i = min(i, len(sample) - 1)
        chosen.append(i)
        near = np.minimum(near, ((sample - sample[i]) ** 2).sum(1))
    return sample[chosen]


def nearest_centers(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row and model: the nearest center (the smallest number of equal ones) and its squared
    distance. centers: [model, cluster, place]."""
    models, k, width = centers.shape
    d = ((x * x).sum(1)[:, None] - 2 * (x @ centers.reshape(-1, width).T) + (centers * centers).sum(2).ravel()[None, :]).reshape(len(x), models, k)
    of = d.argmin(2)
    return of, np.maximum(np.take_along_axis(d, of[:, :, None], 2)[:, :, 0], 0)


def scan(rows: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums and counts by (model, cluster), and the cost of each model, in one pass over rows (_v)."""
    models, k, width = centers.shape
    shared = rows.sparkSession.sparkContext.broadcast(centers)

    def run(batches):
        import pyarrow as pa

        sums, n, cost = np.zeros((models * k, width)), np.zeros(models * k, np.int64), np.zeros(models)
        for batch in batches:
            x = matrix(batch.column("_v"))
            for at in range(0, len(x), SLICE):
                part = x[at : at + SLICE]
                of, d = nearest_centers(part, shared.value)
                cost += d.sum(0)
                for m in range(models):
                    each = np.zeros((len(part), k))
                    each[np.arange(len(part)), of[:, m]] = 1
                    sums[m * k : (m + 1) * k] += each.T @ part
                    n[m * k : (m + 1) * k] += each.sum(0).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(models * k, dtype=np.int32)), pa.array(n), pa.array(np.where(np.arange(models * k) % k == 0, np.repeat(cost, k), 0.0)), pa.ListArray.from_arrays(np.arange(0, sums.size + 1, width, dtype=np.int32), pa.array(sums.ravel()))], ["at", "n", "cost", "s"])

    parts = rows.mapInArrow(run, "at int, n long, cost double, s array<double>")
    total = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), Summarizer.sum(array_to_vector("s")).alias("s")).collect()  # a row for each center
    sums, n, cost = np.zeros((models * k, width)), np.zeros(models * k), np.zeros(models)
    for r in total:
        sums[r["at"]], n[r["at"]] = r["s"].toArray(), r["n"]
        cost[r["at"] // k] += r["cost"]
    return sums.reshape(models, k, width), n.reshape(models, k), cost


def fit(rows: DataFrame, starts: np.ndarray, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> list[Model]:
    """Lloyd's rounds of all models at once, from starts [model, cluster, place], over rows (_v, without
    nulls). A model whose centers all moved by the tolerance at most is done; a center without rows
    stays where it is. The cost is that of the centers returned."""
    models = [Model(c, np.inf, 0) for c in starts]
    moving = list(range(len(models)))
    for _ in range(rounds):
        sums, n, _cost = scan(rows, np.stack([models[i].centers for i in moving]))
        still = []
        for i, s, c in zip(moving, sums, n, strict=True):
            old = models[i].centers
            new = np.where(c[:, None] > 0, s / np.maximum(c, 1)[:, None], old)
            models[i].centers, models[i].rounds = new, models[i].rounds + 1
            if ((new - old) ** 2).sum(1).max() > tolerance**2:
                still.append(i)
        moving = still
        if not moving:
            break
    for m, cost in zip(models, scan(rows, np.stack([m.centers for m in models]))[2], strict=True):
        m.cost = float(cost)
    return models


def refined(sample: np.ndarray, start: np.ndarray, rounds: int = 4 * ROUNDS) -> np.ndarray:
    """Centers after Lloyd's rounds over the sample alone, so that few rounds over all rows are left."""
    for _ in range(rounds):
        of, _d = nearest_centers(sample, start[None])
        each = np.zeros((len(sample), len(start)))
        each[np.arange(len(sample)), of[:, 0]] = 1
        n = each.sum(0)
        new = np.where(n[:, None] > 0, each.T @ sample / np.maximum(n, 1)[:, None], start)
        done = ((new - start) ** 2).sum(1).max() <= TOLERANCE**2
        start = new
        if done:
            break
    return start


def sizes(rows: DataFrame, centers: np.ndarray, key: str) -> DataFrame:
    """(cluster, n, first): rows of each center, and the smallest key among them."""
    shared = rows.sparkSession.sparkContext.broadcast(centers[None])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(nearest_centers(matrix(batch.column("_v")), shared.value)[0][:, 0].astype(np.int32)), batch.column(key)], ["cluster", "first"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select("_v", key).mapInArrow(run, f"cluster int, first {kind}").groupBy("cluster").agg(F.count("*").alias("n"), F.min("first").alias("first"))
