"""Quality rules: plain counts of a text, then a hashed n-gram log-likelihood ratio.

Words and runs of other signs are tokens; tokens and pairs of adjacent tokens are hashed into
``buckets``. One pass counts the buckets in the whole corpus (multinomial R) and in its trusted
rows (multinomial T); both are smoothed. A text's ratio is the mean of log T - log R over its
n-grams, so its length doesn't matter, and texts below ``threshold`` are rejected, always the
same ones. Everything is DataFrame functions; the only shuffle is of bucket counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table

SPACE = "[\\x20\\x09-\\x0D]"
BUCKETS = 8192
#: Trusted labelled rows that the target multinomial is counted from, at most.
TRUSTED_ROWS = 20_000
#: Of the mean log ratio (nats an n-gram).
THRESHOLD = -0.25


def base_counts(text: Column | str = "text") -> dict[str, Column]:
    """Columns that need nothing but the text; the array ``_w`` (words) must be there already."""
    t = F.col(text) if isinstance(text, str) else text
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return {
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.regexp_replace(t, f"{SPACE}+", "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def words_of(text: Column) -> Column:
    """Only the first and last piece of a split can be empty."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def repeat_words(df: DataFrame) -> DataFrame:
    """n_repeat_words: words inside windows of three words that occur twice or more in ``_w``.

    Windows are sorted by hash with their places, so equal ones are neighbours; a window counts
    those of its words that the next repeated one doesn't cover. Texts without a repeated window,
    most of them, skip the sort.
    """
    df = df.withColumn("_h", F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))).otherwise(F.array().cast("array<struct<h:bigint,p:int>>")))
    twice = F.filter("_s", lambda x, i: ((i > 0) & (F.get("_s", i - 1)["h"] == x["h"])) | F.coalesce(F.get("_s", i + 1)["h"] == x["h"], F.lit(False)))
    df = df.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["p"])))
    cover = F.aggregate("_p", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    return df.withColumn("n_repeat_words", cover).drop("_h", "_s", "_p")


def tokens_of(text: Column) -> Column:
    """Runs of letters and digits, and runs of other signs, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("([\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]+)"), F.lit(1))


def hashed(tokens: str, buckets: int) -> Column:
    one = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))
    two = F.transform(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t, i: F.pmod(F.xxhash64(F.get(tokens, i), t), F.lit(buckets)).cast("int"))
    return F.concat(one, two)


def ratio_weights(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row, one array: log T - log R of each bucket, from (_t tokens, trusted) rows. Each
    bucket has one added in both counts."""
    grams = rows.select("trusted", F.explode(hashed("_t", buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("r"), F.sum(F.col("trusted").cast("long")).alias("t"))
    every = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counts, "bucket", "left").select("bucket", (F.coalesce("t", F.lit(0)) + 1).alias("t"), (F.coalesce("r", F.lit(0)) + 1).alias("r"))
    one = full.agg(F.sort_array(F.collect_list(F.struct("bucket", F.log("t").alias("t"), F.log("r").alias("r")))).alias("a"), F.log(F.sum("t")).alias("t"), F.log(F.sum("r")).alias("r"))
    return one.select(F.transform("a", lambda x: (x["t"] - F.col("t")) - (x["r"] - F.col("r"))).alias("w"))


def judge_quality(docs: DataFrame, trusted: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio.

    ``trusted``: doc_ids of texts to resemble; if there are more than TRUSTED_ROWS, a fixed choice of
    so many (they are broadcast).
    Null and empty texts have no words and fail; a null doc_id is judged like any other but is never
    trusted; repeated rows are judged each by itself; other columns are not read. Without trusted
    rows the target is uniform, and without rows the result is empty.
    """
    ids = F.broadcast(bounded(trusted.select("doc_id"), TRUSTED_ROWS).withColumnRenamed("doc_id", "_id"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = rows.join(ids, F.col("doc_id") == F.col("_id"), "left").select("text", F.col("_id").isNotNull().alias("trusted"))
    weights = ratio_weights(marked.select(tokens_of(F.col("text")).alias("_t"), "trusted"), buckets).scalar()
    out = rows.withColumns({"_w": words_of(F.col("text")), "_t": tokens_of(F.col("text"))}).withColumns(base_counts())
    out = repeat_words(out).withColumns({"_g": hashed("_t", buckets), "_weights": weights})
    total = F.aggregate("_g", F.lit(0.0), lambda a, b: a + F.get("_weights", b))
    out = out.withColumn("ratio", F.round(F.when(F.size("_g") > 0, total / F.size("_g")).otherwise(0.0), 6))
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= threshold))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")


def bounded(ids: DataFrame, most: int) -> DataFrame:
    """The distinct doc_ids; of more than ``most`` always the same ones, those with the smallest hashes."""
    return ids.where(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def trusted_ids(labels: DataFrame, most: int = TRUSTED_ROWS) -> DataFrame:
    """doc_ids labelled 1 for quality, outside the held-out fifth; a fixed choice of them if there are more."""
    return bounded(labels.where((F.col("quality") == 1) & ~held_out()).select("doc_id"), most)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")))
