"""Line dedup by overlapping windows of three lines.

The lines of a document that hold more than white space are taken in order. Each three that
follow one another are a window, known by a 128-bit hash. A window that occurs more than
once in the corpus keeps its first occurrence, by (doc_id, row hash, place); the others cover the
lines from their first to their last, blank ones between included. Covered stretches of a
document are merged and its other lines stay, in order.

Only window hashes are counted globally, with sums combined before the shuffle. Finding the
later occurrences is an equi-join on (hash, salt) with one row a repeated hash and salt, so that a
window in a third of all documents is spread over SALTS tasks, and more where Spark splits skewed joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, scratch, sealed, table, written

#: Of the join on a window's hash.
SALTS = 16
BLANKS = " \t\r\x0b\x0c"


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, _k, h1, h2, p0, p2): hash and first and last line number of every window."""
    trimmed = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), F.trim(x, F.lit(BLANKS)).alias("s")))
    full = docs.withColumn("_l", F.filter(trimmed, lambda x: x["s"] != "")).where(F.size("_l") >= 3)
    line = lambda i, d: F.get("_l", i + d)
    key = lambda i, seed: F.xxhash64(F.lit(seed), line(i, 0)["s"], line(i, 1)["s"], line(i, 2)["s"])
    w = F.transform(F.sequence(F.lit(0), F.size("_l") - 3), lambda i: F.struct(key(i, 1).alias("h1"), key(i, 2).alias("h2"), line(i, 0)["i"].alias("p0"), line(i, 2)["i"].alias("p2")))
    return full.select("doc_id", "_k", F.explode(w).alias("w")).select("doc_id", "_k", "w.*")


def later_windows(found: DataFrame) -> DataFrame:
    """The windows that an earlier one equals."""
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_k", "p0")
    firsts = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    firsts = firsts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("g3"))
    salted = found.withColumn("_s", F.pmod(F.xxhash64("doc_id", "_k", "p0"), F.lit(SALTS)).cast("int"))
    same = (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("_s") == F.col("g3"))
    return salted.join(firsts, same).where(place > F.col("first")).select("doc_id", "_k", "p0", "p2")


def covered_lines(later: DataFrame) -> DataFrame:
    """(doc_id, _k, cut): the line numbers under the merged windows of each document."""
    each = later.groupBy("doc_id", "_k").agg(F.collect_list(F.sequence("p0", "p2")).alias("c"))
    return each.select("doc_id", "_k", F.array_distinct(F.flatten("c")).alias("cut"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of docs, the text without repeated passages, and n_lines, n_removed (all lines
    of the text, and those cut).

    A null text stays null with 0 lines; a text of fewer than three lines with words is left as it
    is. Rows with equal doc_id and text are one document read twice: they come out alike. A null
    doc_id comes after all others. A text whose every line is cut is empty. Other columns stay as
    they are whatever they are called, but for n_lines and n_removed, which are replaced.
    """
    docs, back = sealed(docs, "doc_id", "text")
    docs = docs.withColumn("_k", F.xxhash64("text"))
    keyed = docs.select("doc_id", "_k", "text").where(F.col("text").isNotNull())
    with scratch():
        found = written(windows(keyed).distinct(), "windows")
        cut = kept(covered_lines(later_windows(found)).select(F.col("doc_id").alias("_d"), F.col("_k").alias("_j"), "cut"), "cut")
    # cut grows with docs, so it isn't broadcast where it happens to be small either
    out = docs.join(cut.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_k") == F.col("_j")), "left")
    out = out.withColumn("_l", F.split("text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_l") - 1), "cut")
    text = F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_l", i)), "\n"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("_l"))
    out = out.withColumns({"n_lines": n.cast("long"), "n_removed": F.coalesce(F.size("cut"), F.lit(0)).cast("long")}).withColumn("text", text)
    return back(out, "n_lines", "n_removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


#: Of documents(doc_id, text); later statements may use the same text on another table.
SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM {documents}),
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM d),
f AS (SELECT doc_id, text, i, trim(s, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS s FROM l),
w AS (
  SELECT doc_id, text, i AS p0, s, lead(s, 1) OVER o AS s1, lead(s, 2) OVER o AS s2, lead(i, 2) OVER o AS p2
  FROM f WHERE s <> '' WINDOW o AS (PARTITION BY doc_id, text ORDER BY i)),
r AS (SELECT *, row_number() OVER (PARTITION BY s, s1, s2 ORDER BY doc_id NULLS LAST, text, p0) AS n FROM w WHERE p2 IS NOT NULL),
c AS (SELECT DISTINCT r.doc_id, r.text, f.i FROM r JOIN f ON r.doc_id IS NOT DISTINCT FROM f.doc_id AND r.text = f.text AND f.i BETWEEN r.p0 AND r.p2 WHERE r.n > 1),
k AS (SELECT l.doc_id, l.text, count(*) AS n_lines, count(c.i) AS n_removed, coalesce(string_agg(l.s, chr(10) ORDER BY l.i) FILTER (c.i IS NULL), '') AS kept
  FROM l LEFT JOIN c ON l.doc_id IS NOT DISTINCT FROM c.doc_id AND l.text = c.text AND l.i = c.i GROUP BY l.doc_id, l.text)
SELECT {columns} FROM {documents} AS x LEFT JOIN k ON x.doc_id IS NOT DISTINCT FROM k.doc_id AND x.text = k.text
""".strip()  # noqa: E501
DEDUP_SQL = SQL
SQL = DEDUP_SQL.format(documents="documents", columns="x.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, k.kept AS text")
