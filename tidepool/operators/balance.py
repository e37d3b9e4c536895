"""Class balancing, splits and label bookkeeping of training tables.

Random choices are orders by md5(seed, id): the same rows on every run and every cluster.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written
from .quantiles import quantiles

#: Hexadecimal digits of a hash that cut a class into stretches (16^3 of them at most).
STRETCH = 3


def shuffled(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def support_floor(counts: DataFrame, least: int = 5, classes: int = 20) -> DataFrame:
    """One row, ``floor``: the given support if enough classes have it, else the first of the smaller
    ones (down to 2) that enough classes have, else the given one."""
    tries = [least, *range(least - 1, 1, -1)]
    enough = F.coalesce(*[F.when(F.count_if(F.col("n") >= t) >= classes, F.lit(t)) for t in tries], F.lit(least))
    return counts.agg(enough.alias("floor"))


def min_support(df: DataFrame, least: int = 5, classes: int = 20, label: str = "label") -> DataFrame:
    """Rows of classes with enough members, and the floor that was used."""
    counts = class_counts(df, label)
    floor = support_floor(counts, least, classes)
    kept = counts.join(F.broadcast(floor)).where(F.col("n") >= F.col("floor")).select(label, "floor")
    return df.join(kept, label)


def top_classes(df: DataFrame, n: int = 2000, label: str = "label", order: str = "id") -> DataFrame:
    """The n largest classes; of equal ones those first seen."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(n).select(label, "n")


def keep_classes(df: DataFrame, classes: DataFrame, label: str = "label") -> DataFrame:
    return df.join(classes.select(label).distinct(), label, "left_semi")


def drop_rare(df: DataFrame, least: int = 3, label: str = "label") -> DataFrame:
    return df.join(class_counts(df, label).where(F.col("n") < least), label, "left_anti")


def label_difference(a: DataFrame, b: DataFrame, label: str = "label") -> DataFrame:
    """Labels of a that b doesn't have."""
    return a.select(label).distinct().join(b.select(label).distinct(), label, "left_anti")


def labels_subset(a: DataFrame, b: DataFrame, label: str = "label") -> bool:
    return label_difference(a, b, label).isEmpty()


def ranked(df: DataFrame, seed: int, label: str, key: str, most: int | None = None) -> DataFrame:
    """``_r``: place of a row in its class by (md5(seed, key), key). The first digits of the hash cut a class
    into stretches that are ranked each by itself, behind the rows of the stretches before. With
    ``most``, places beyond it may be missing: tasks drop rows that can't be among those early."""
    cut = df.withColumn("_h", shuffled(seed, key)).withColumn("_b", F.substring("_h", 1, STRETCH))
    sizes = cut.groupBy(F.col(label).alias("_l"), F.col("_b").alias("_c")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("_l").orderBy("_c").rowsBetween(W.unboundedPreceding, -1))
    base = sizes.select("_l", "_c", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy(label, "_b").orderBy("_h", key))
    inner = cut.withColumn("_r", within)
    inner = inner if most is None else inner.where(F.col("_r") <= most)
    placed = inner.join(base, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_c")))
    return placed.withColumn("_r", F.col("_r") + F.col("_before")).drop("_h", "_b", "_l", "_c", "_before")


def cap_per_class(df: DataFrame, n: int = 200, seed: int = 42, label: str = "label", key: str = "id") -> DataFrame:
    """n rows of each class at most: the first by (md5(seed, key), key)."""
    return ranked(df, seed, label, key, n).where(F.col("_r") <= n).drop("_r")


def subsample_to(df: DataFrame, target: int = 50_000, floor: int = 5, seed: int = 42, label: str = "label", key: str = "id") -> DataFrame:
    """About target rows: of each class max(floor, int(size x target / rows)); all if there are no more."""
    counts = class_counts(df, label)
    total = counts.agg(F.sum("n").alias("total"))
    quota = counts.join(F.broadcast(total)).select(label, F.when(F.col("total") > target, F.greatest(F.lit(floor), F.floor(F.col("n") * target / F.col("total")))).otherwise(F.col("n")).alias("_q"))
    return ranked(df, seed, label, key).join(quota, label).where(F.col("_r") <= F.col("_q")).drop("_r", "_q")


def stratified_split(df: DataFrame, fractions: tuple[tuple[str, float], ...] = (("train", 0.8), ("val", 0.1), ("test", 0.1)), seed: int = 42, label: str = "label", key: str = "id") -> DataFrame:
    """Adds ``split``: of each class, in shuffled order, the first round(n x f) rows and so on."""
    sized = ranked(df, seed, label, key).join(class_counts(df, label), label)
    cut, edges = 0.0, []
    for name, f in fractions[:-1]:
        cut += f
        edges.append((name, cut))
    split = reduce(lambda e, x: e.when(F.col("_r") <= F.floor(F.col("n") * F.lit(round(x[1], 9)) + 0.5), x[0]), edges[1:], F.when(F.col("_r") <= F.floor(F.col("n") * F.lit(edges[0][1]) + 0.5), edges[0][0]))
    return sized.withColumn("split", split.otherwise(fractions[-1][0])).drop("_r", "n")


def fix_unseen(splits: DataFrame, label: str = "label") -> DataFrame:
    """Rows of classes that the training part lacks move there."""
    seen = splits.where(F.col("split") == "train").select(label).distinct().withColumn("_seen", F.lit(True))
    return splits.join(seen, label, "left").withColumn("split", F.when(F.col("_seen"), F.col("split")).otherwise("train")).drop("_seen")


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def encode_labels(df: DataFrame, label: str = "label") -> tuple[DataFrame, StringIndexerModel]:
    """``label_id``: place of the label in alphabetical order."""
    model = StringIndexer(inputCol=label, outputCol="label_id", stringOrderType="alphabetAsc").fit(df)
    return model.transform(df).withColumn("label_id", F.col("label_id").cast("int")), model


def numbered(df: DataFrame, column: str, out: str) -> DataFrame:
    """``out``: place of each row in the order of a column, from 0. Ranges of the column are numbered each by
    itself, behind the rows of the ranges before; only one count a range meets in one task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = written(df.repartitionByRange(parts, column).withColumn("_p", F.spark_partition_id()), "ranges")
    before = F.sum("n").over(W.orderBy("_q").rowsBetween(W.unboundedPreceding, -1))
    base = ranges.groupBy(F.col("_p").alias("_q")).agg(F.count("*").alias("n")).select("_q", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("_p").orderBy(column)) - 1
    rows = ranges.withColumn(out, place).join(F.broadcast(base), F.col("_p") == F.col("_q"))
    return rows.withColumn(out, (F.col(out) + F.col("_before")).cast("int")).drop("_p", "_q", "_before")


def label_codes(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, label_id) as a table, for joins in either direction."""
    return numbered(df.select(label).distinct(), label, "label_id")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """label, n, weight (n / (k n_c), divided by the mean weight), imbalance (largest / smallest class)
    and whether weights should be used (imbalance over 5)."""
    counts = class_counts(df, label)
    all_ = counts.agg(F.count("*").alias("k"), F.sum("n").alias("total"), F.avg(1 / F.col("n")).alias("inverse"), (F.max("n") / F.min("n")).alias("imbalance"))
    raw = (1 / F.col("n")) / F.col("inverse")
    return counts.join(F.broadcast(all_)).select(label, "n", F.round(raw, 6).alias("weight"), F.round("imbalance", 6).alias("imbalance"), (F.col("imbalance") > 5).alias("weighted"))


def support_profile(df: DataFrame, label: str = "label") -> DataFrame:
    n = F.col("n")
    return class_counts(df, label).agg(F.count_if(n == 1).alias("one"), F.count_if(n.between(2, 4)).alias("two_to_four"), F.count_if(n.between(5, 9)).alias("five_to_nine"), F.count_if(n >= 10).alias("ten_or_more"), F.count_if(n >= 50).alias("fifty_or_more"))


def describe(df: DataFrame, value: str) -> DataFrame:
    """count, mean, std, min, quartiles, max: exact. Without a value the count is 0 and the rest null."""
    names = {0.25: "q1", 0.5: "median", 0.75: "q3"}
    plain = df.agg(F.count(value).alias("count"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    found = quantiles(df, value, list(names)).agg(*[F.max(F.when(F.col("share") == s, F.col("value"))).alias(n) for s, n in names.items()])
    return plain.join(F.broadcast(found)).select("count", "mean", "std", "min", *names.values(), "max")  # a row each


def coverage(df: DataFrame, rank: str = "species", taxid: str = "taxid") -> DataFrame:
    known = F.coalesce(F.col(rank), F.lit("Unknown")) != "Unknown"
    return df.agg(F.count("*").alias("rows"), F.count_if(known).alias("known"), F.round(F.coalesce(F.try_divide(100.0 * F.count_if(known), F.count("*")), F.lit(0.0)), 2).alias("known_percent"), F.countDistinct(F.when(known, F.col(rank))).alias("distinct_known"), F.countDistinct(taxid).alias("distinct_taxids"))
