"""Abundance tables (sample_id, taxon, n) and diversity measures."""

from __future__ import annotations

import math
from hashlib import md5
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import string_bytes
from ..functions.digests import small_digests
from ..storage import kept, scratch, written
from .quantiles import quantiles


def abundance_by_rank(df: DataFrame, ranks: list[str]) -> DataFrame:
    """sample_id, rank, taxon, n at every level of a rank path."""
    rows = df.select("sample_id", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), F.col(f"`{r}`").cast("string").alias("taxon")) for r in ranks])).alias("v"))
    return rows.groupBy("sample_id", F.col("v.rank").alias("rank"), F.col("v.taxon").alias("taxon")).agg(F.sum("n").alias("n"))


def abundance_rollup(df: DataFrame, ranks: list[str]) -> DataFrame:
    """Counts along the rank path with all subtotals; level is the number of ranks rolled up."""
    return df.rollup("sample_id", *ranks).agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))


def sample_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("sample_id").agg(F.sum("n").alias("total"))


def normalize_relative(df: DataFrame) -> DataFrame:
    return df.join(sample_totals(df), "sample_id").select("sample_id", "taxon", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"))


def normalize_tpm(df: DataFrame, length: str = "length") -> DataFrame:
    """(n / length) / sum of those, per million."""
    rate = F.col("n") / F.col(length)
    total = df.groupBy("sample_id").agg(F.sum(rate).alias("total"))
    return df.join(total, "sample_id").select("sample_id", "taxon", "n", F.round(1e6 * rate / F.col("total"), 3).alias("tpm"))


def normalize_css(df: DataFrame, quantile: float = 0.5, scale: float = 1000.0) -> DataFrame:
    """n x scale / sum of a sample's counts up to its quantile of positive counts."""
    with scratch():
        df = written(df.select("sample_id", "taxon", "n"), "counts")
        q = quantiles(df.where("n > 0"), "n", [quantile], ["sample_id"]).select("sample_id", F.col("value").alias("q"))
        s = df.join(q, "sample_id").where("n > 0 and n <= q").groupBy("sample_id").agg(F.sum("n").alias("s"))
        return kept(df.join(s, "sample_id", "left").select("sample_id", "taxon", "n", F.round(F.col("n") * scale / F.col("s"), 6).alias("css")), "css")


#: Standard deviations that a bound of hashes leaves to spare.
SPARE = 8
#: Individuals that are hashed in one go; the stretches of a large count go to several tasks.
STRETCH = 50_000


#: Rows whose individuals are hashed together, and individuals that come out together.
ROWS = 50_000


def drawn(some: DataFrame, seed: int) -> DataFrame:
    """(sample_id, taxon, i, _h): the individuals of stretches (from number _a on) whose hash is below a share of all hashes.
    Numpy hashes those of many rows at once and tells which may be below; only these are compared in full and come out."""
    kinds = {c: some.schema[c].dataType for c in ("sample_id", "taxon")}
    schema = T.StructType([*[T.StructField(c, k) for c, k in kinds.items()], T.StructField("i", T.LongType()), T.StructField("_h", T.StringType())])
    text = some.select("sample_id", "taxon", F.concat_ws("|", F.lit(str(seed)), F.col("sample_id").cast("string"), F.col("taxon").cast("string"), F.lit("")).alias("_p"), "n", "_share", "_a")

    def below(rows):
        import pyarrow as pa

        raw, at = string_bytes(rows.column("_p"))
        low, share = rows.column("_a").to_numpy(), rows.column("_share").to_numpy()
        high, bound = np.minimum(rows.column("n").to_numpy(), low + STRETCH - 1), (share * (1 << 48)).astype(np.int64)
        part = np.flatnonzero(share < 1)
        of = np.concatenate([[0], np.cumsum(np.diff(at)[part])])
        bytes_of = np.repeat(at[part] - of[:-1], np.diff(of)) + np.arange(of[-1])
        near = ((part[j], i) for j, i in small_digests(raw[bytes_of], of, low[part], high[part], bound[part] >> 16))
        every = ((np.full(high[j] - low[j] + 1, j), np.arange(low[j], high[j] + 1)) for j in np.flatnonzero(share >= 1))
        index, numbers, hashes = [], [], []

        def out():
            taken = rows.select(["sample_id", "taxon"]).take(pa.array(index, pa.int64()))
            return pa.RecordBatch.from_arrays([*taken.columns, pa.array(numbers, pa.int64()), pa.array(hashes, pa.string())], schema.names)

        for js, own in chain(near, every):
            for j, i in zip(js.tolist(), own.tolist(), strict=True):
                h = md5(raw[at[j] : at[j + 1]].tobytes() + b"%d" % i).digest()
                if share[j] >= 1 or h[:6] < int(bound[j]).to_bytes(6, "big"):
                    index.append(j)
                    numbers.append(i)
                    hashes.append(h.hex())
            if len(index) >= ROWS:
                yield out()
                index, numbers, hashes = [], [], []
        yield out()

    def run(batches):
        import pyarrow as pa

        held = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS:
                yield from below(pa.concat_batches(held))
                held = []
        if held:
            yield from below(pa.concat_batches(held))

    return text.mapInArrow(run, schema)


def rarefy(df: DataFrame, depth: int = 10_000, seed: int = 42) -> DataFrame:
    """depth individuals of each sample, drawn without replacement in the order of
    md5(seed, sample, taxon, number); samples with fewer are dropped.

    Hashes spread evenly, so the first ones of a sample lie below a bound that depth and total give,
    with SPARE standard deviations to spare. Only individuals below it are shuffled and sorted; a
    sample that has too few of them nevertheless is sorted as a whole.
    """
    with scratch():
        df = written(df.where("n > 0").select("sample_id", "taxon", F.col("n").cast("long").alias("n")), "counts")
        share = F.greatest((depth + SPARE * math.sqrt(depth) + 64) / F.col("total"), F.lit(0.0))
        big = written(sample_totals(df).where((F.col("total") >= depth) & F.col("sample_id").isNotNull()).select("sample_id", F.least(share, F.lit(1.0)).alias("_share")), "samples")
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many tasks, however few bytes there are
        some = df.join(big, "sample_id").select("sample_id", "taxon", "n", "_share", F.explode(F.sequence(F.lit(1), F.col("n"), F.lit(STRETCH))).alias("_a")).repartition(parts, "sample_id", "taxon", "_a")
        near = written(drawn(some, seed), "near")
        enough = near.groupBy("sample_id").agg(F.count("*").alias("c")).where(F.col("c") >= depth).select("sample_id")
        rest = big.join(enough, "sample_id", "left_anti").select("sample_id")
        rows = near.join(enough, "sample_id", "left_semi")
        if not rest.isEmpty():
            rows = rows.unionByName(drawn(some.join(rest, "sample_id", "left_semi").withColumn("_share", F.lit(1.0)), seed))
        place = F.row_number().over(W.partitionBy("sample_id").orderBy("_h", "taxon", "i"))
        return kept(rows.withColumn("_r", place).where(F.col("_r") <= depth).groupBy("sample_id", "taxon").agg(F.count("*").alias("n")), "rarefied")


def alpha_diversity(df: DataFrame) -> DataFrame:
    """sample_id, total, observed, shannon, simpson, chao1, pielou and ace (rare: 10 or less)."""
    n, total = F.col("n"), F.col("total")
    rows = df.where("n > 0").join(sample_totals(df), "sample_id")
    p = n / total
    rare = n <= 10
    a = rows.groupBy("sample_id").agg(
        F.max("total").alias("total"), F.count("*").alias("observed"), (-F.sum(p * F.log(p))).alias("h"), (1 - F.sum(p * p)).alias("simpson"),
        F.count_if(n == 1).alias("f1"), F.count_if(n == 2).alias("f2"), F.count_if(rare).alias("s_rare"), F.sum(F.when(rare, n).otherwise(0)).alias("n_rare"),
        F.sum(F.when(rare, n * (n - 1)).otherwise(0)).alias("pairs"))
    s, f1, f2 = F.col("observed"), F.col("f1"), F.col("f2")
    chao = s + F.when(f2 > 0, f1 * f1 / (2.0 * f2)).otherwise(f1 * (f1 - 1) / 2.0)
    cover = F.when(F.col("n_rare") > 0, 1 - f1 / F.col("n_rare")).otherwise(1.0)
    gamma = F.greatest(F.lit(0.0), F.when((cover > 0) & (F.col("n_rare") > 1), F.col("s_rare") / cover * F.col("pairs") / (F.col("n_rare") * (F.col("n_rare") - 1)) - 1).otherwise(0.0))
    ace = (s - F.col("s_rare")) + F.when(cover > 0, F.col("s_rare") / cover + f1 / cover * gamma).otherwise(F.col("s_rare"))
    return a.select("sample_id", "total", "observed", F.round("h", 6).alias("shannon"), F.round("simpson", 6).alias("simpson"), F.round(chao, 6).alias("chao1"), F.round(F.when(s > 1, F.col("h") / F.log(s)).otherwise(0.0), 6).alias("pielou"), F.round(ace, 6).alias("ace"))


def bray_curtis(df: DataFrame) -> DataFrame:
    """(a, b, distance) of all pairs of samples, a < b. The smaller counts of shared taxa come from an
    equi-join on taxon; samples that share none have distance 1."""
    t = sample_totals(df)
    left, right = df.select(F.col("sample_id").alias("a"), "taxon", F.col("n").alias("na")), df.select(F.col("sample_id").alias("b"), "taxon", F.col("n").alias("nb"))
    shared = left.join(right, "taxon").where("a < b").groupBy("a", "b").agg(F.sum(F.least("na", "nb")).alias("low"))
    pairs = t.select(F.col("sample_id").alias("a"), F.col("total").alias("ta")).join(t.select(F.col("sample_id").alias("b"), F.col("total").alias("tb")), F.col("a") < F.col("b"))
    return pairs.join(shared, ["a", "b"], "left").select("a", "b", F.round(1 - 2.0 * F.coalesce("low", F.lit(0)) / (F.col("ta") + F.col("tb")), 6).alias("distance"))


#: The series of ln gamma from 8 on, as the C library has it.
SERIES = (4.18938533204672725052e-01, 8.33333333333329678849e-02, -2.77777777728775536470e-03, 7.93650558643019558500e-04, -5.95187557450339963135e-04, 8.36339918996282139126e-04, -1.63092934096575273989e-03)


def log_gamma(x: float) -> float:
    """ln gamma(x) for x >= 1, to the last bit as C's lgamma gives it from 8 on."""
    if x < 8:
        return math.lgamma(x)
    z = 1.0 / x
    y = z * z
    w = SERIES[0] + z * (SERIES[1] + y * (SERIES[2] + y * (SERIES[3] + y * (SERIES[4] + y * (SERIES[5] + y * SERIES[6])))))
    return (x - 0.5) * (math.log(x) - 1.0) + w


def none_of(n: pd.Series, total: pd.Series, depth: pd.Series) -> pd.Series:
    """The chance that none of n among total individuals is among depth, by ln gamma in the order of the SQL: where totals are
    large the differences cancel, and another order or logarithm gives other digits."""
    g = lambda x: log_gamma(float(x))
    rows = zip(n.tolist(), total.tolist(), depth.tolist(), strict=True)
    return pd.Series([math.exp(g(t - k + 1) - g(t - k - x + 1) - g(t + 1) + g(t - x + 1)) if t - k >= x else 0.0 for k, t, x in rows], dtype=float)


def rarefaction_curve(df: DataFrame, depths: list[int]) -> DataFrame:
    """(sample_id, depth, richness): expected number of taxa among depth individuals; depths over a
    sample's total are left out. Taxa with equal counts in a sample are computed once."""
    classes = df.where("n > 0").groupBy("sample_id", "n").agg(F.count("*").alias("taxa")).join(sample_totals(df), "sample_id")
    rows = classes.withColumn("depth", F.explode(F.array(*[F.lit(x).cast("long") for x in depths]))).where(F.col("depth") <= F.col("total"))
    return rows.groupBy("sample_id", "depth").agg(F.round(F.sum(F.col("taxa") * (1 - F.pandas_udf(none_of, "double")("n", "total", "depth"))), 4).alias("richness"))


def trend(df: DataFrame, period: str = "30 days", before: int = 3, limit: float = 2.0) -> DataFrame:
    """site, period start, value, z (against the ``before`` periods before it) and anomaly (|z| > limit)."""
    t = df.groupBy("site", F.window("ts", period).alias("w")).agg(F.sum("value").alias("value")).select("site", F.col("w.start").alias("start"), "value")
    past = W.partitionBy("site").orderBy("start").rowsBetween(-before, -1)
    z = (F.col("value") - F.avg("value").over(past)) / F.nullif(F.stddev_samp("value").over(past), F.lit(0.0))
    return t.select("site", "start", F.round("value", 6).alias("value"), F.round(z, 4).alias("z")).withColumn("anomaly", F.coalesce(F.abs("z") > limit, F.lit(False)))


def abundance_matrix(df: DataFrame, taxa: list[str]) -> DataFrame:
    """A row for each sample and a column for each given taxon; 0 where it is missing."""
    return df.groupBy("sample_id").pivot("taxon", taxa).agg(F.sum("n")).fillna(0)
