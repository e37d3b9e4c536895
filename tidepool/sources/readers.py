"""File formats as DataFrames. No reader collects a file or depends on its size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import MANIFEST, RUN

__all__ = ["SUFFIXES", "fasta_records", "filter_inputs", "head_n", "label_from_header", "parse_logs", "parse_sequence_tsv", "read_fasta", "read_fastq", "read_manifest", "read_runs", "read_taxdump", "reject_counts", "tail_logs"]

#: Endings of sequence files (fixed values).
SUFFIXES = [".fasta", ".fa", ".fna", ".fasta.gz", ".fa.gz", ".fna.gz"]


def fasta_records(raw: DataFrame) -> DataFrame:
    """(value, file, at) records cut at ``\\n>`` -> id (first word of the header), whole header, and the
    sequence without line ends."""
    text = F.regexp_replace("value", "^>", "")
    header = F.rtrim(F.regexp_replace(F.substring_index(text, "\n", 1), "\r$", ""))
    body = F.when(F.instr(text, "\n") > 0, F.regexp_replace(text, "^[^\n]*\n", "")).otherwise("")
    rows = raw.where(F.trim(F.regexp_replace("value", "[\r\n>]", "")) != "")
    return rows.select("file", "at", F.substring_index(F.substring_index(header, " ", 1), "\t", 1).alias("sequence_id"), header.alias("description"), F.regexp_replace(body, "[\\s]", "").alias("sequence"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, sequence_id, description, sequence); (file, at) is the order of records. Splits
    are at record starts, so a large file is read by many tasks. An empty file gives no rows."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    at = F.col("_metadata.file_block_start") * F.lit(1 << 20) + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return fasta_records(raw.select("value", F.col("_metadata.file_path").alias("file"), at.alias("at")))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, read_id, sequence, quality). Records are four lines by number, as ``@`` may also
    begin a quality line. Lines are numbered within their part of a file, and parts by the counts
    of the parts before them, so no file has to fit in one task."""
    raw = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    # within a block, line numbers follow the id
    counts = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("file", "block", "first", before.alias("before"))
    lines = raw.join(base, ["file", "block"]).withColumn("line", F.col("before") + F.col("id") - F.col("first"))
    k = F.col("line") % 4
    pick = lambda i: F.max(F.when(k == i, F.col("value")))
    rows = lines.groupBy("file", F.floor(F.col("line") / 4).alias("at")).agg(pick(0).alias("head"), pick(1).alias("sequence"), pick(3).alias("quality"))
    return rows.where(F.col("quality").isNotNull()).select("file", "at", F.substring_index(F.regexp_replace("head", "^@", ""), " ", 1).alias("read_id"), "sequence", "quality")


def filter_inputs(df: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path ends in a sequence file's suffix, in any case."""
    return df.where(F.lower(F.col(path)).rlike("\\.(fasta|fa|fna)(\\.gz)?$"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, mate, path): one row for each file; mate is single, forward or reverse."""
    m = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    single = m.select(F.explode("single").alias("s")).select("s.sample_id", F.lit("single").alias("mate"), F.col("s.file").alias("path"))
    pair = m.select(F.explode("paired").alias("s"))
    sides = [pair.select("s.sample_id", F.lit(x).alias("mate"), F.col(f"s.{x}").alias("path")) for x in ("forward", "reverse")]
    return single.unionByName(sides[0]).unionByName(sides[1])


def _dump(spark: SparkSession, path: str) -> DataFrame:
    parts = F.transform(F.split("value", "\\t\\|\\t?"), lambda p: F.trim(p))
    return spark.read.text(path).select(parts.alias("p"))


def read_taxdump(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """nodes (taxid, parent, rank) and scientific names (taxid, name) of a taxonomy dump."""
    get = lambda i: F.get("p", F.lit(i))
    nodes = _dump(spark, f"{folder}/nodes.dmp").select(get(0).cast("int").alias("taxid"), get(1).cast("int").alias("parent"), get(2).alias("rank"))
    names = _dump(spark, f"{folder}/names.dmp").where(F.array_contains("p", "scientific name")).select(get(0).cast("int").alias("taxid"), get(1).alias("name"))
    return nodes, names


def parse_sequence_tsv(lines: DataFrame, line: str = "line", least: int = 50) -> DataFrame:
    """accession, taxid, title, sequence, and the first reason to reject the line (null if accepted)."""
    p = F.split(F.col(line), "\t", 4)
    taxid, seq = F.trim(F.get(p, F.lit(1))).try_cast("int"), F.trim(F.get(p, F.lit(3)))
    # the names of reasons are fixed values
    reason = F.when(F.size(p) < 4, "insufficient_columns").when(taxid.isNull(), "invalid_taxid").when(taxid <= 0, "zero_taxid").when(F.length(seq) < least, "very_short_seq")
    return lines.select("*", F.get(p, F.lit(0)).alias("accession"), taxid.alias("taxid"), F.get(p, F.lit(2)).alias("title"), seq.alias("sequence"), reason.alias("reason"))


def reject_counts(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n"))


def label_from_header(description: Column) -> Column:
    """After the first tab, else after the first space, else the whole header."""
    tab, space = F.instr(description, "\t"), F.instr(description, " ")
    cut = lambda at: F.substring(description, at + 1, F.length(description))
    return F.trim(F.when(tab > 0, cut(tab)).when(space > 0, cut(space)).otherwise(description))


def head_n(df: DataFrame, n: int = 3000, *order: str) -> DataFrame:
    """The first n rows by order; all for n <= 0."""
    return df.orderBy(*order).limit(n) if n > 0 else df


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Run records of a folder of JSON files. Unreadable files are skipped, records without a
    sample_id dropped, and of several with one id the last by file name stays."""
    raw = spark.read.schema(RUN + ", _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(folder)
    rows = raw.select("*", F.col("_metadata.file_path").alias("file")).where(F.col("_bad").isNull() & F.col("sample_id").isNotNull()).drop("_bad")
    last = rows.groupBy("sample_id").agg(F.max_by(F.struct(*rows.columns), "file").alias("r"))
    return last.select("r.*").drop("file")


def parse_logs(lines: DataFrame, line: str = "line") -> DataFrame:
    """timestamp, level, message of ``ts - LEVEL - message`` lines. With fewer parts the whole line is
    timestamp and message, and the level INFO."""
    p = F.split(F.col(line), " - ", 3)
    full = F.size(p) >= 3
    part = lambda i, other: F.when(full, F.get(p, F.lit(i))).otherwise(other)
    return lines.select("*", part(0, F.col(line)).alias("timestamp"), part(1, F.lit("INFO")).alias("level"), part(2, F.col(line)).alias("message"))


def tail_logs(lines: DataFrame, order: str, n: int = 200, line: str = "line") -> DataFrame:
    """The last n lines, parsed, without blank ones."""
    return parse_logs(lines.orderBy(F.desc(order)).limit(n).where(F.trim(line) != ""), line)
