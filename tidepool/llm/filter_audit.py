"""Filter interaction audit: what each filter removes in every order that the filters could be applied in.

A document's failures are a mask, one bit a filter. Everything that the audit reports of a part is a
sum over its documents of something that depends on the mask alone, so a part is reduced to one
row of 2^k counts before any order is looked at. Removal steps are a min-plus product: of the
mask matrix (0 where the mask fails a filter, infinite elsewhere) and the inverse permutations (the
position of each filter in each order); the least sum is the position of the first filter that the
mask fails. Counts are then scattered by (order, removal step).
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .quality_rules import words_of

#: The contract's filters: letters and what each of them fails.
FILTERS = "ABCDE"
#: More than any position: the removal step of what no filter removes.
NEVER = 1 << 20
#: Filters at most; there are 64 masks and 720 orders of so many.
MOST_FILTERS = 6


def text_failures(text: Column | str = "text") -> dict[str, Column]:
    """Failure columns of filters that need nothing but the text: under 200 words, under half of them
    different, over 2 % capitals, control signs. The array ``_w`` (words) must be there already."""
    t = F.col(text) if isinstance(text, str) else text
    capitals = F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size("_w") < 200,
        "B": 100 * F.size(F.array_distinct("_w")) < 50 * F.size("_w"),
        "C": 100 * capitals > 2 * F.length(t),
        "D": t.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, A to E, n: how many rows of ``docs`` are alike in all of these.

    part is the source, an empty string for a null one. E holds where the text is that of a smaller
    doc_id; texts are compared by SHA-256. A null text is an empty one, so it fails A and may fail E;
    a null doc_id is smaller or larger than none and never fails E; repeated rows of one id don't
    make each other fail. Long texts are taken whole. Rows are told by (digest, doc_id), so copies
    of one text, however many, don't meet in one task.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), t.alias("_t"))
    rows = rows.withColumn("_w", words_of(F.col("_t"))).withColumns(text_failures("_t"))
    rows = rows.groupBy("doc_id", "part", *"ABCD", F.unhex(F.sha2("_t", 256)).alias("_x")).agg(F.count("*").alias("n"))
    first = rows.where(F.col("doc_id").isNotNull()).groupBy(F.col("_x").alias("_y")).agg(F.min("doc_id").alias("_first"))
    out = rows.join(first, (F.col("_x") == F.col("_y")) & (F.col("doc_id") == F.col("_first")), "left")
    return out.select("doc_id", "part", *"ABCD", (F.col("doc_id").isNotNull() & F.col("_first").isNull()).alias("E"), "n")


def removal_steps(filters: int) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """All orders of so many filters, the step (from 0) at which an order removes a mask (NEVER if no
    filter does) as [mask, order], and the position of a filter in an order as [order, filter]."""
    orders = list(permutations(range(filters)))
    positions = np.argsort(np.array(orders, np.int64).reshape(len(orders), filters), axis=1)
    failed = (np.arange(1 << filters)[:, None] >> np.arange(filters)) & 1
    masks = np.where(failed == 1, 0, NEVER)
    return orders, np.minimum((masks[:, None, :] + positions[None, :, :]).min(axis=2, initial=NEVER), NEVER), positions


def audit(rows: DataFrame, filters: Sequence[str], marks: Sequence[str] = (), part: str = "part", weight: str = "n") -> DataFrame:
    """One row per part, order and step: part, filter_order, step (from 1), kept, removed, redundant,
    unique_fails, shapley and lost_<mark> for each mark.

    rows: part, a boolean column per filter (null: not failed), a long column per mark (of what is lost,
    counted in weighted rows; null: 0) and the weight. ``kept`` after the step and ``removed`` at it,
    ``redundant`` (failing the step's filter, but removed earlier), ``unique_fails`` (failing no other
    filter), ``shapley`` (removed by the filter, summed over all orders). Counts are longs. A table
    without rows has no parts. There are 2^k masks and k! orders of k filters, of which MOST_FILTERS
    are the most; a task holds one part's sums at a time.
    """
    if not 0 < len(filters) <= MOST_FILTERS:
        raise ValueError(f"an audit takes 1 to {MOST_FILTERS} filters")
    k, width = len(filters), 1 << len(filters)
    measures = [F.col(weight), *[F.coalesce(F.col(m).cast("long"), F.lit(0)) * F.col(weight) for m in marks]]
    mask = sum((F.when(F.coalesce(F.col(f), F.lit(False)), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    counts = rows.groupBy(F.col(part).alias("part"), mask.alias("mask")).agg(F.array(*[F.sum(m).cast("long") for m in measures]).alias("v"))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "v")).alias("c"))  # 2^k entries at most
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, shapley long" + "".join(f", lost_{m} long" for m in marks)

    def run(batches):
        import pyarrow as pa

        orders, step, position = removal_steps(k)
        names = ["".join(filters[i] for i in o) for o in orders]
        at = np.array(orders)  # [order, step] -> filter
        failing = (np.arange(width)[:, None] >> np.arange(k)) & 1 == 1
        early = step[:, :, None] < position[None, :, :]  # [mask, order, filter]: removed before it
        order_of = np.broadcast_to(np.arange(len(orders)), step.shape)
        column = np.minimum(step, k)
        for batch in batches:
            for name, c in zip(batch.column("part").to_pylist(), batch.column("c").to_pylist(), strict=True):
                w = np.zeros((1 + len(marks), width), np.int64)
                for x in c:
                    w[:, x["mask"]] += x["v"]
                gone = np.zeros((len(w), len(orders), k + 1), np.int64)
                for out, of in zip(gone, w, strict=True):
                    np.add.at(out, (order_of, column), np.broadcast_to(of[:, None], step.shape))
                removed = gone[:, :, :k]
                kept = w[0].sum() - np.cumsum(removed[0], axis=1)
                redundant = np.einsum("m,mof,mf->of", w[0], early, failing, dtype=np.int64)
                shapley = np.zeros(k, np.int64)
                np.add.at(shapley, at, removed[0])
                alone = w[0][1 << np.arange(k)]
                cols = [kept, removed[0], np.take_along_axis(redundant, at, 1), alone[at], shapley[at], *removed[1:]]
                n = at.size
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array([o for o in names for _ in range(k)]), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders))), *[pa.array(np.ascontiguousarray(x).ravel()) for x in cols]],
                    ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "shapley", *[f"lost_{m}" for m in marks]],
                )

    return parts.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a doc_id with several labels rows, each mark is 1 if one of them says so."""
    labels = table(spark, sf_dir, "labels").where(F.col("doc_id").isNotNull())
    marks = labels.groupBy(F.col("doc_id").alias("_d")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    rows = failures(table(spark, sf_dir, "documents"))
    out = audit(rows.join(marks, F.col("doc_id") == F.col("_d"), "left"), FILTERS, ("good", "toxic"))
    return out.withColumnsRenamed({"lost_good": "good_lost", "lost_toxic": "toxic_lost"})


SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents
), fails AS (
  SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(doc_id > first_id, false) AS e
  FROM words
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), masks AS (
  SELECT part, [a, b, c, d, e] AS f, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM fails LEFT JOIN marks USING (doc_id) GROUP BY ALL
), letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS i)
, orders AS (
  SELECT [p.i, q.i, r.i, s.i, t.i] AS o FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5
), steps AS (
  SELECT m.*, o, list_min(list_filter([1, 2, 3, 4, 5], lambda k: f[o[k]])) AS gone FROM masks m, orders
), counted AS (
  SELECT part, o, k.i AS step, o[k.i] AS letter,
         sum(CASE WHEN gone IS NULL OR gone > k.i THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN gone = k.i THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN f[o[k.i]] AND gone < k.i THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN f[o[k.i]] AND len(list_filter(f, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN gone = k.i THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN gone = k.i THEN toxic ELSE 0 END) AS toxic_lost
  FROM steps, letters k GROUP BY ALL
)
SELECT part, list_aggregate(list_transform(o, lambda i: chr(CAST(64 + i AS INTEGER))), 'string_agg', '') AS filter_order,
       CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counted
"""
