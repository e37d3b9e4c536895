"""Exact quantiles by distributed selection: no task holds all values of a group, nor all different ones."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import kept, scratch, written

#: Ranges that an interval is cut into each round, and rows of an interval that are sorted in one task.
BUCKETS, SORTED_ROWS = 1024, 100_000


def order_statistics(values: DataFrame, ranks: DataFrame, by: Sequence[str], buckets: int = BUCKETS, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """(by, k, v): the value with k smaller or equal ones before it, for each (by, k) of ranks.

    values: by, v (numbers without nulls or NaN), a table that is read each round. Each round counts the values of the intervals that still hold a
    wanted rank in ranges, and goes on with the range that holds it, from its smallest to its largest
    value. Intervals of one value are done; small ones are sorted.
    """
    by = list(by)
    with scratch():
        values = values.select(*by, F.col("v").cast("double").alias("v"))
        ends = values.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
        state = written(ranks.join(ends, by).select(*by, "k", "lo", "hi", F.lit(0).cast("long").alias("below"), "n"), "state")
        wide = (F.col("lo") < F.col("hi")) & (F.col("n") > sorted_rows)

        def inside(some: DataFrame) -> DataFrame:
            return values.join(some.select(*by, "lo", "hi").distinct(), by).where(F.col("v").between(F.col("lo"), F.col("hi")))

        # ranges are equal steps of the size and of the value in turn, so that neither far values nor close ones take many rounds
        magnitude = lambda c: F.signum(c) * F.log1p(F.least(F.abs(F.col(c)), F.lit(1e15)) * 1e290)
        for turn in count():
            open_ = state.where(wide)
            if open_.isEmpty():
                break
            # halves first: the difference of two doubles may be too large for one
            at = magnitude if turn % 2 == 0 else lambda c: F.col(c) / 2
            share = F.try_divide(at("v") - at("lo"), at("hi") - at("lo"))
            bucket = F.coalesce(F.least(F.floor(share * buckets), F.lit(buckets - 1)), F.when(F.col("v") < F.col("hi"), 0).otherwise(1))
            counts = inside(open_).groupBy(*by, "lo", "hi", bucket.alias("_b")).agg(F.count("*").alias("_c"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
            counts = counts.withColumn("_upto", F.sum("_c").over(W.partitionBy(*by, "lo", "hi").orderBy("_b")))
            start = F.col("below") + F.col("_upto") - F.col("_c")
            found = open_.join(counts, [*by, "lo", "hi"]).where((F.col("k") >= start) & (F.col("k") < start + F.col("_c")))
            state = written(state.where(~wide).unionByName(found.select(*by, "k", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), start.alias("below"), F.col("_c").alias("n"))), "state")
        rest = state.where("lo < hi")
        ranked = inside(rest).withColumn("_r", F.row_number().over(W.partitionBy(*by, "lo", "hi").orderBy("v")) - 1)
        near = rest.join(ranked, [*by, "lo", "hi"]).where(F.col("k") == F.col("below") + F.col("_r")).select(*by, "k", "v")
        return kept(state.where("lo = hi").select(*by, "k", F.col("lo").alias("v")).unionByName(near), "ranks")


def quantiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = (), **how) -> DataFrame:
    """(by, share, value): the quantile of each group at each share (0 to 1), between two neighbours in proportion.
    Nulls are left out; a group without a value has no row. ``how`` goes to ``order_statistics``."""
    own = [f"_g{i}" for i in range(len(by))] or ["_g"]
    groups = [F.col(b).alias(g) for b, g in zip(by, own, strict=True)] if by else [F.lit(0).alias("_g")]
    rows = df.select(*groups, F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    rows = rows.withColumns({g: F.coalesce(F.col(g).cast("string"), F.lit("\0")) for g in own}) if by else rows
    with scratch():
        rows = written(rows, "rows")
        at = rows.groupBy(*own).agg(F.count("*").alias("_n")).withColumn("_share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
        at = at.withColumn("_at", F.col("_share") * (F.col("_n") - 1)).withColumns({"_a": F.floor("_at"), "_b": F.ceil("_at")})
        wanted = at.select(*own, F.explode(F.array("_a", "_b")).alias("k")).distinct()
        found = order_statistics(rows, wanted, own, **how)
        low, high = found.withColumnsRenamed({"k": "_a", "v": "_lo"}), found.withColumnsRenamed({"k": "_b", "v": "_hi"})
        both = at.join(low, [*own, "_a"]).join(high, [*own, "_b"])
        out = both.select(*own, F.col("_share").alias("share"), (F.col("_lo") + (F.col("_at") - F.col("_a")) * (F.col("_hi") - F.col("_lo"))).alias("value"))
        out = kept(out, "quantiles")
    kinds = dict(df.dtypes)
    return out.select(*[F.when(F.col(g) != "\0", F.col(g)).cast(kinds[b]).alias(b) for b, g in zip(by, own, strict=True)] if by else [], "share", "value")
