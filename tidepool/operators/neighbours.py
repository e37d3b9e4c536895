"""Nearest neighbours by cosine distance: an inverted-file index, and all pairs of blocks.

The index deals the reference to lists by nearest centroid. Centroids come from a bounded sample, but
every row is in a list. As angles obey the triangle inequality, a list whose centroid is farther from a
query than the list's radius and the query's k-th neighbour together has nothing for it. An upper
bound of that k-th distance comes from the same sample, so which lists a query has to visit is known before
the search, and the answer is the exact one. With ``probes`` only so many of them are visited, the nearest
ones, and the answer is approximate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import kept, scratch, written

#: Rows of the reference that centroids and bounds are taken from, at most, and lists for so many.
SAMPLE_ROWS, SAMPLE_ROWS_A_LIST = 8192, 32
#: Reference vectors of one list that a task holds at once; queries that are multiplied with them at once.
BLOCK_ROWS, SLICE = 20_000, 512
#: Rounds of fitting the centroids; what an angle may be wrong by.
ROUNDS, SLACK = 12, 1e-6


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def matrix(column) -> np.ndarray:
    """An Arrow list column without nulls as the rows of a matrix."""
    n = len(column)
    return np.asarray(column.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def vectors_of(df: DataFrame, *columns) -> DataFrame:
    """(id, e, columns): rows without an id or a vector have no neighbours and are none."""
    return df.where(F.col("id").isNotNull() & F.col("embedding").isNotNull()).select("id", F.col("embedding").cast("array<double>").alias("e"), *columns)


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means, beginning at rows that are spread over the
    sample farthest first."""
    chosen = [0]
    near = sample @ sample[0]
    while len(chosen) < min(lists, len(sample)):
        i = int(np.argmin(near))
        if near[i] >= 1 - 1e-12:  # all others are copies of chosen ones
            break
        chosen.append(i)
        near = np.maximum(near, sample @ sample[i])
    centers = sample[chosen]
    for _ in range(rounds):
        of = np.argmax(sample @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, of, sample)
        centers = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 1e-9, unit(sums), centers)
    return centers


@dataclass
class Index:
    """The reference dealt to lists. ``rows``: list, part, id, label, e (unit vectors); ``parts`` and ``radius``
    of each list; the bounded sample's ids and vectors."""

    rows: DataFrame
    id_type: T.DataType
    centers: np.ndarray
    parts: np.ndarray
    radius: np.ndarray
    sample_ids: np.ndarray
    sample: np.ndarray


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def build_index(reference: DataFrame, sample_rows: int = SAMPLE_ROWS, lists: int | None = None, block_rows: int = BLOCK_ROWS) -> Index:
    """reference: id, embedding, label. The sample is a fixed choice of at most ``sample_rows`` rows (those with the
    smallest hashes of their ids), the only ones that the driver sees; ``lists`` is one for SAMPLE_ROWS_A_LIST of
    them if not given. Lists of more than ``block_rows`` rows are dealt to parts by hash. The table of
    rows stays in the shared folder until the ``scratch`` block around it ends.
    """
    rows = vectors_of(reference, F.col("label").cast("string").alias("label"))
    few = rows.select("id", "e").orderBy(F.xxhash64("id"), "id").limit(sample_rows).toArrow()
    sample = unit(matrix(few["e"].combine_chunks())) if len(few) else np.zeros((0, 1))
    centers = fit_centroids(sample, lists or max(1, len(sample) // SAMPLE_ROWS_A_LIST)) if len(sample) else np.zeros((0, 1))
    id_type = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("id", id_type), T.StructField("label", T.StringType()), T.StructField("e", T.ArrayType(T.DoubleType())), T.StructField("angle", T.DoubleType())])
    shared = rows.sparkSession.sparkContext.broadcast(centers)

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                e = unit(matrix(batch.column("e")))
                near = e @ shared.value.T
                of = np.argmax(near, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), batch.column("id"), batch.column("label"), pa.ListArray.from_arrays(np.arange(0, e.size + 1, e.shape[1], dtype=np.int32), pa.array(e.ravel())), pa.array(angles(near[np.arange(len(e)), of]))], schema.names)

    dealt = written(rows.mapInArrow(assign, schema), "lists")
    sizes = {r["list"]: (r["n"], r["far"]) for r in dealt.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("far")).collect()}  # at most sample_rows
    parts = np.array([-(-sizes.get(i, (1, 0.0))[0] // block_rows) for i in range(len(centers))], np.int64)
    radius = np.array([sizes.get(i, (0, -4.0))[1] for i in range(len(centers))])  # nothing is near an empty list
    return Index(dealt, id_type, centers, parts, radius, few["id"].to_numpy(), sample)


def visits(index: Index, ids: np.ndarray, e: np.ndarray, k: int, others: bool, probes: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(query's place, list) of the lists that unit vectors have to visit."""
    if not len(index.centers) or not len(e):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    to = angles(e @ index.sample.T)
    if others:
        to[ids[:, None] == index.sample_ids[None, :]] = np.inf
    bound = np.partition(to, k - 1, axis=1)[:, k - 1] if to.shape[1] >= k else np.full(len(e), np.inf)
    away = angles(e @ index.centers.T)
    needed = away - index.radius[None, :] <= (bound + SLACK)[:, None]
    needed &= index.radius[None, :] > -1
    if probes is not None and probes < len(index.centers):
        first = np.argsort(away, axis=1, kind="stable")[:, :probes]
        some = np.zeros_like(needed)
        np.put_along_axis(some, first, True, axis=1)
        needed &= some
    return np.nonzero(needed)


def search(index: Index, queries: DataFrame, k: int = 5, others: bool = False, probes: int | None = None) -> DataFrame:
    """(query_id, ref_id, label, distance, place): the k nearest rows of the index for each query (id, embedding);
    ties by ref_id. ``others``: a row with the query's id doesn't count.

    Each row of the index is shuffled once, to the task of its (list, part); queries go to the parts of
    the lists that they visit. Tasks read a part's rows first and stream its queries past them.
    """
    spark = queries.sparkSession
    kind = queries.schema["id"].dataType
    side = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("query", kind), T.StructField("id", index.id_type), T.StructField("label", T.StringType()), T.StructField("e", T.ArrayType(T.DoubleType()))])
    parts, small = index.parts, spark.sparkContext.broadcast(Index(None, index.id_type, index.centers, index.parts, index.radius, index.sample_ids, index.sample))

    def ask(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                own = batch.slice(at, SLICE)
                ids, e = own.column("id"), unit(matrix(own.column("e")))
                q, of = visits(small.value, ids.to_numpy(zero_copy_only=False), e, k, others, probes)
                each = small.value.parts[of]
                q, of = np.repeat(q, each), np.repeat(of, each)
                part = np.arange(len(q)) - np.repeat(np.cumsum(each) - each, each)
                wide = e[q]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of.astype(np.int32)), pa.array(part.astype(np.int32)), ids.take(pa.array(q)), pa.nulls(len(q), side_kinds[3]), pa.nulls(len(q), pa.string()), pa.ListArray.from_arrays(np.arange(0, wide.size + 1, max(1, e.shape[1]), dtype=np.int32), pa.array(wide.ravel()))], side.names
                )

    from pyspark.sql.pandas.types import to_arrow_schema

    side_kinds = [f.type for f in to_arrow_schema(side)]
    asked = vectors_of(queries).mapInArrow(ask, side)
    count = F.get(F.array(*[F.lit(int(p)) for p in parts]), F.col("list")) if len(parts) and parts.max() > 1 else F.lit(1)
    rows = index.rows.select("list", F.pmod(F.xxhash64("id", F.lit("part")), count).cast("int").alias("part"), F.lit(None).cast(kind).alias("query"), "id", "label", "e")
    met = rows.unionByName(asked).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "list", "part").sortWithinPartitions("list", "part", F.col("query").isNotNull(), "id")
    result = T.StructType([T.StructField("query_id", kind), T.StructField("ref_id", index.id_type), T.StructField("label", T.StringType()), T.StructField("distance", T.DoubleType())])

    def meet(batches):
        import pyarrow as pa

        now, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            of, part = batch.column("list").to_numpy(), batch.column("part").to_numpy()
            query = np.asarray(batch.column("query").is_valid())
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (part[1:] != part[:-1]) | (query[1:] != query[:-1])
            edges = [*np.flatnonzero(new).tolist(), len(of)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own = batch.slice(a, b - a)
                if (of[a], part[a]) != now:
                    now, held, block = (of[a], part[a]), [], None
                if not query[a]:
                    held.append(own)
                elif held:
                    if block is None:
                        block = pa.Table.from_batches(held).combine_chunks()
                        ids, m = block.column("id").to_numpy(), matrix(block.column("e").combine_chunks())
                    for at in range(0, own.num_rows, SLICE):
                        some = own.slice(at, SLICE)
                        d = np.round(1 - matrix(some.column("e")) @ m.T, 9)
                        if others:
                            d[np.asarray(some.column("query").to_numpy(zero_copy_only=False))[:, None] == ids[None, :]] = np.inf
                        top = np.argsort(d, axis=1, kind="stable")[:, :k]  # rows come in the order of their ids
                        far = np.take_along_axis(d, top, 1).ravel()
                        ok = np.flatnonzero(np.isfinite(far))
                        q, r = pa.array(np.repeat(np.arange(some.num_rows), top.shape[1])[ok]), pa.array(top.ravel()[ok])
                        yield pa.RecordBatch.from_arrays([some.column("query").take(q), block.column("id").combine_chunks().take(r), block.column("label").combine_chunks().take(r), pa.array(far[ok])], result.names)

    place = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "ref_id"))
    return met.mapInArrow(meet, result).withColumn("place", place).where(F.col("place") <= k)


def nearest(queries: DataFrame, reference: DataFrame, k: int = 5, others: bool = False, probes: int | None = None, **how) -> DataFrame:
    """``search`` in an index of the reference that is built for it; ``how`` goes to ``build_index``."""
    with scratch():
        return kept(search(build_index(reference, **how), queries, k, others, probes), "nearest")


def nearest_by_blocks(queries: DataFrame, reference: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS, others: bool = False) -> DataFrame:
    """The rows of ``nearest`` from all pairs: every block of queries meets every block of the reference in
    a cogroup. For vectors that no list tells apart, and to measure an index against."""
    counts = [-(-max(1, df.count()) // block_rows) for df in (queries, reference)]
    kinds = [dict(df.dtypes)["id"] for df in (queries, reference)]

    def dealt(df: DataFrame, own: int, columns: list, seed: str) -> DataFrame:
        """Each row in its block, once for each block of the other side."""
        block = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(counts[own])).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(counts[1 - own] - 1)))
        return vectors_of(df, *columns, *([block.alias("a"), every.alias("b")] if own == 0 else [every.alias("a"), block.alias("b")]))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "ref_id", "label", "distance"]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=names)
        right = right.sort_values("id", kind="stable")
        q, m, ids, labels = unit(np.array(left["e"].tolist())), unit(np.array(right["e"].tolist())), right["id"].to_numpy(), right["label"].to_numpy()
        out = []
        for i in range(0, len(q), SLICE):
            own = left["id"].to_numpy()[i : i + SLICE]
            d = np.round(1 - q[i : i + SLICE] @ m.T, 9)
            if others:
                d[own[:, None] == ids[None, :]] = np.inf
            top = np.argsort(d, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"query_id": np.repeat(own, top.shape[1]), "ref_id": ids[top].ravel(), "label": labels[top].ravel(), "distance": np.take_along_axis(d, top, 1).ravel()}))
        near = pd.concat(out)
        return near[np.isfinite(near["distance"])]

    a, b = dealt(queries, 0, [], "q"), dealt(reference, 1, [F.col("label").cast("string").alias("label")], "r")
    near = a.groupBy("a", "b").cogroup(b.groupBy("a", "b")).applyInPandas(best, f"query_id {kinds[0]}, ref_id {kinds[1]}, label string, distance double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "ref_id"))
    return near.withColumn("place", place).where(F.col("place") <= k)
