"""Run and batch records: snapshots, recent runs, unique ids, state updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import normalize_status
from ..storage import kept, scratch, written


def with_status(runs: DataFrame) -> DataFrame:
    return runs.withColumn("status", normalize_status(F.col("status"), F.col("success")))


def dashboard_snapshot(runs: DataFrame) -> DataFrame:
    """Totals over all runs; the mean duration leaves out zero ones, the last end is of completed runs."""
    s = F.col("status")
    d = F.col("processing_time")
    return runs.agg(
        F.count("*").alias("total_runs"), F.round(F.coalesce(F.try_divide(100.0 * F.count_if(s == "completed"), F.count("*")), F.lit(0.0)), 2).alias("success_rate"),
        F.floor(F.coalesce(F.avg(F.when(d > 0, d)), F.lit(0.0))).cast("long").alias("avg_processing_time"),
        F.count_if(s == "running").alias("running"), F.count_if(s.isin("queued", "pending")).alias("queued"), F.max(F.when(s == "completed", F.col("end_time"))).alias("last_completed"))


def batch_summary(runs: DataFrame) -> DataFrame:
    """One row a batch: it is completed if no run failed; the average time is its span / samples."""
    ok, bad = F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "failed")
    span = F.max(F.col("end_time").cast("double")) - F.min(F.col("start_time").cast("double"))
    return runs.groupBy("batch_id").agg(F.count("*").alias("samples"), ok.alias("successes"), bad.alias("failures"), F.when(bad == 0, "completed").otherwise("failed").alias("status"), F.round(100.0 * ok / F.count("*"), 2).alias("success_rate"), F.round(F.coalesce(span / F.count("*"), F.lit(0.0)), 3).alias("average_time"))


def recent_runs(runs: DataFrame, n: int = 25) -> DataFrame:
    """Newest first; runs without a start time come last."""
    return runs.orderBy(F.desc_nulls_last("start_time"), "sample_id").limit(n)


def latest_active(runs: DataFrame) -> DataFrame:
    return recent_runs(runs.where(F.col("status").isin("queued", "running", "pending")), 1)


def last_durations(runs: DataFrame, n: int = 8) -> DataFrame:
    return runs.where((F.col("status") == "completed") & F.col("processing_time").isNotNull()).orderBy(F.desc("start_time"), "sample_id").limit(n).select("sample_id", "start_time", "processing_time")


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """df sorted into ranges of the columns, with the number of its range (``_p``), as a table."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()), "ranges")


def carried(ranges: DataFrame, base: str, value: Column, how=F.sum) -> DataFrame:
    """(_n, _q, _before): of each base and range, the sum (or what else) of a value over that base's rows in
    the ranges before. A base has a row a range at most."""
    each = ranges.groupBy(F.col(base).alias("_n"), F.col("_p").alias("_q")).agg(how(value).alias("_v"))
    before = how("_v").over(W.partitionBy("_n").orderBy("_q").rowsBetween(W.unboundedPreceding, -1))
    return each.select("_n", "_q", F.coalesce(before, F.lit(0)).alias("_before"))


def placed(df: DataFrame, base: str, order: str, out: str) -> DataFrame:
    """``out``: place of each row among those of its base, from 0. Ranges are numbered by themselves and go on
    from the ranges before, so that no base has to fit one task."""
    ranges = ranged(df, base, order)
    rows = ranges.withColumn(out, (F.row_number().over(W.partitionBy(base, "_p").orderBy(order)) - 1).cast("long"))
    rows = rows.join(carried(ranges, base, F.lit(1)), F.col(base).eqNullSafe(F.col("_n")) & (F.col("_p") == F.col("_q")))
    return rows.withColumn(out, F.col(out) + F.col("_before")).drop("_p", "_q", "_n", "_before")


def uniquify_ids(df: DataFrame, base: str = "base_id", order: str = "at") -> DataFrame:
    """run_id: the base id for its first row, then base-1, base-2 and so on, without those numbers
    that some base id already has as its own name. A null base id stays null.

    The i-th taken number of a base pushes all rows from the place (number - i + 1) on by i. Rows and
    these places are sorted together into ranges, and a row takes the last push before it: within its range, or
    else the largest of the ranges before.
    """
    split = df.select(F.regexp_extract(F.col(base), "^(.*)-([1-9][0-9]*)$", 1).alias("_b"), F.regexp_extract(F.col(base), "^(.*)-([1-9][0-9]*)$", 2).try_cast("long").alias("_k")).where(F.col("_k").isNotNull()).distinct()
    with scratch():
        taken = placed(split, "_b", "_k", "_i").select(F.col("_b").alias(base), F.col("_i") + 1, (F.col("_k") - F.col("_i")).alias("_r")).toDF(base, "_i", "_r")
        taken = written(taken.join(df.select(base).distinct(), base, "left_semi"), "taken")
        rows = written(placed(df, base, order, "_r"), "rows")
        some = taken.select(base).distinct()
        plain = rows.join(some, base, "left_anti").withColumn("_push", F.lit(0).cast("long"))
        both = ranged(rows.join(some, base, "left_semi").withColumns({"_i": F.lit(0).cast("long"), "_row": F.lit(True)}).unionByName(taken.withColumn("_row", F.lit(False)), allowMissingColumns=True), base, "_r", "_row")
        within = F.max("_i").over(W.partitionBy(base, "_p").orderBy("_r", "_row"))
        pushed = both.withColumn("_push", within).where("_row").join(carried(both, base, F.col("_i"), F.max), (F.col(base) == F.col("_n")) & (F.col("_p") == F.col("_q")))
        pushed = pushed.withColumn("_push", F.greatest("_push", "_before")).select(*rows.columns, "_push")
        out = plain.unionByName(pushed)
        name = F.when(F.col("_r") == 0, F.col(base)).otherwise(F.concat_ws("-", base, (F.col("_r") + F.col("_push")).cast("string")))
        return kept(out.withColumn("run_id", F.when(F.col(base).isNotNull(), name)).drop("_r", "_push"), "unique")


def fold_updates(updates: DataFrame, fields: tuple[str, ...] = ("status", "progress", "message"), first_step: str = "") -> DataFrame:
    """The state of each run after its partial updates in order (ts, seq): a field has its last value
    that was given, progress is clamped, and the end is the time of the last terminal state.

    With columns step and step_status, ``steps`` lists the last status of each step as step=status
    pairs by name; an update that names no step means the first one.
    """
    at = F.struct("ts", "seq")
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields]
    end = F.max(F.when(F.col("status").isin("completed", "failed"), F.col("ts"))).alias("end_time")
    out = updates.groupBy("run_id").agg(*last, end, F.count("*").alias("updates"))
    # greatest and least pass over nulls, but a run without progress has none
    out = out.withColumn("progress", F.when(F.col("progress").isNotNull(), F.least(F.greatest("progress", F.lit(0)), F.lit(100)))) if "progress" in fields else out
    if "step_status" not in updates.columns:
        return out
    each = updates.where(F.col("step_status").isNotNull()).groupBy("run_id", F.coalesce("step", F.lit(first_step)).alias("step")).agg(F.max_by("step_status", at).alias("s"))
    steps = each.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "s"))), lambda x: F.concat_ws("=", x["step"], x["s"])), ",").alias("steps"))
    return out.join(steps, "run_id", "left").withColumn("steps", F.coalesce("steps", F.lit("")))
