"""Queries over readers and writers: files are written by Spark from the tables and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources as src
from ..operators import models, summary
from ..schema import PREDICTION_COLUMNS
from ..storage import shared_path
from . import views as v
from .registry import query


@query("a1_read_fasta", "SELECT CAST(read_id AS VARCHAR) AS sequence_id, read_id || ' ' || sample_id AS description, seq AS sequence FROM v_reads")
def a1(spark, d):
    path = shared_path(spark, "fasta")
    r = v.v_reads(spark, d)
    r.select(F.concat(F.lit(">"), "read_id", F.lit(" "), "sample_id", F.lit("\n"), F.regexp_replace("seq", "(.{60})", "$1\n"))).write.text(path)
    return src.read_fasta(spark, path).select("sequence_id", "description", "sequence")


@query("a2_read_fastq", "SELECT CAST(read_id AS VARCHAR) AS read_id, seq AS sequence, quality FROM v_reads_q")
def a2(spark, d):
    path = shared_path(spark, "fastq")
    v.v_reads_q(spark, d).select(F.concat(F.lit("@"), "read_id", F.lit("\n"), "seq", F.lit("\n+\n"), "quality")).write.text(path)
    return src.read_fastq(spark, path).select("read_id", "sequence", "quality")


SUFFIX = ["fasta", "FA", "fna.gz", "txt", "fastq", "Fasta.gz"]


@query("a3_filter_inputs", "SELECT path FROM (SELECT source || '/' || doc_id || '.' || (['fasta', 'FA', 'fna.gz', 'txt', 'fastq', 'Fasta.gz'])[1 + doc_id % 6] AS path FROM documents) WHERE regexp_matches(lower(path), '\\.(fasta|fa|fna)(\\.gz)?$')")
def a3(spark, d):
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIX]), (F.col("doc_id") % 6 + 1).cast("int"))
    return src.filter_inputs(v.table(spark, d, "documents").select(F.concat("source", F.lit("/"), "doc_id", F.lit("."), suffix).alias("path")))


@query("a4_read_manifest", "SELECT s_name AS sample_id, 'single' AS mate, s_name || '.fq' AS path FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_name, 'forward', s_name || '_R1.fq' FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT s_name, 'reverse', s_name || '_R2.fq' FROM supplier WHERE s_suppkey % 2 = 1")
def a4(spark, d):
    path = shared_path(spark, "manifest")
    # one document for each nation's suppliers, as one manifest describes one survey
    s = v.table(spark, d, "supplier")
    one = F.struct(F.col("s_name").alias("sample_id"), F.concat("s_name", F.lit(".fq")).alias("file"))
    two = F.struct(F.col("s_name").alias("sample_id"), F.concat("s_name", F.lit("_R1.fq")).alias("forward"), F.concat("s_name", F.lit("_R2.fq")).alias("reverse"))
    even = F.col("s_suppkey") % 2 == 0
    doc = s.groupBy("s_nationkey").agg(F.to_json(F.struct(F.collect_list(F.when(even, one)).alias("single"), F.collect_list(F.when(~even, two)).alias("paired"))).alias("value"))
    doc.write.partitionBy("s_nationkey").text(path)
    return src.read_manifest(spark, f"{path}/*").select("sample_id", "mate", "path")


@query("a5_read_taxdump", "SELECT taxid, parent, rank, name FROM v_nodes LEFT JOIN v_names USING (taxid)")
def a5(spark, d):
    path = shared_path(spark, "taxdump")
    line = lambda *c: F.concat(F.concat_ws("\t|\t", *c), F.lit("\t|"))
    v.v_nodes(spark, d).select(line("taxid", "parent", "rank")).write.text(f"{path}/nodes.dmp")
    n = v.v_names(spark, d)
    n.select(F.explode(F.array(line("taxid", "name", F.lit(""), F.lit("scientific name")), line("taxid", F.upper("name"), F.lit(""), F.lit("synonym"))))).write.text(f"{path}/names.dmp")
    nodes, names = src.read_taxdump(spark, path)
    return nodes.join(names, "taxid", "left")


TSV = """
WITH p AS (SELECT id, string_split(line, chr(9)) AS p FROM v_tsv),
q AS (SELECT id, p[1] AS accession, try_cast(trim(p[2]) AS INT) AS taxid, p[3] AS title, trim(p[4]) AS sequence, len(p) AS k FROM p),
r AS (SELECT *, CASE WHEN k < 4 THEN 'insufficient_columns' WHEN taxid IS NULL THEN 'invalid_taxid' WHEN taxid <= 0 THEN 'zero_taxid' WHEN len(sequence) < 50 THEN 'very_short_seq' END AS reason FROM q)
"""


@query("a6_parse_sequence_tsv", TSV + "SELECT id, accession, taxid, title, sequence, reason FROM r")
def a6(spark, d):
    return src.parse_sequence_tsv(v.v_tsv(spark, d)).select("id", "accession", "taxid", "title", "sequence", "reason")


@query("c12_reject_counts", TSV + "SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason")
def c12(spark, d):
    return src.reject_counts(src.parse_sequence_tsv(v.v_tsv(spark, d)))


@query("a7_label_from_header", "SELECT id, CASE WHEN id % 2 = 0 OR contains(label, ' ') THEN CASE WHEN id % 2 = 0 THEN label ELSE trim(substr(label, strpos(label, ' ') + 1)) END ELSE label END AS label FROM v_tax_labels")
def a7(spark, d):
    rows = v.v_tax_labels(spark, d)
    header = F.when(F.col("id") % 2 == 0, F.concat_ws("\t", "id", "label")).otherwise(F.col("label"))
    return rows.select("id", src.label_from_header(header).alias("label"))


@query("a7_head_n", "SELECT id, label FROM v_tax_labels ORDER BY id LIMIT 3000")
def a7_head(spark, d):
    return src.head_n(v.v_tax_labels(spark, d), 3000, "id")


@query("a8_validate_embeddings", "SELECT count(*) AS rows, count(sequence_id) AS ids, CAST(max(len(embedding)) AS INT) AS width FROM v_emb")
def a8(spark, d):
    return models.validate_embeddings(v.v_emb(spark, d))


@query("a9_read_runs", "SELECT CAST(n_nationkey AS VARCHAR) AS sample_id, n_nationkey * 1.5 AS processing_time, n_regionkey <> 2 AS success, CASE WHEN n_regionkey <> 3 THEN n_name END AS status FROM nation WHERE n_nationkey % 5 <> 4")
def a9(spark, d):
    path = shared_path(spark, "runs")
    n = v.table(spark, d, "nation")
    good = F.to_json(F.struct(F.col("n_nationkey").cast("string").alias("sample_id"), (F.col("n_nationkey") * 1.5).alias("processing_time"), (F.col("n_regionkey") != 2).alias("success"), F.when(F.col("n_regionkey") != 3, F.col("n_name")).alias("status")))
    body = F.when(F.col("n_nationkey") % 10 == 4, F.concat(F.lit("{broken "), "n_name")).when(F.col("n_nationkey") % 10 == 9, F.lit('{"success": true}')).otherwise(good)
    n.select(body.alias("value"), F.col("n_nationkey").alias("k")).write.partitionBy("k").text(path)
    return src.read_runs(spark, f"{path}/*").select("sample_id", "processing_time", "success", "status")


LOGS = "WITH p AS (SELECT event_id, line, string_split(line, ' - ') AS p FROM v_logs), l AS (SELECT event_id, CASE WHEN len(p) >= 3 THEN p[1] ELSE line END AS timestamp, CASE WHEN len(p) >= 3 THEN p[2] ELSE 'INFO' END AS level, CASE WHEN len(p) >= 3 THEN array_to_string(p[3:], ' - ') ELSE line END AS message FROM p) "


@query("a10_parse_logs", LOGS + "SELECT * FROM l")
def a10(spark, d):
    return src.parse_logs(v.v_logs(spark, d)).drop("line")


@query("a10_tail_logs", LOGS + "SELECT * FROM l ORDER BY event_id DESC LIMIT 200")
def a10_tail(spark, d):
    return src.tail_logs(v.v_logs(spark, d), "event_id").drop("line")


@query("a11_fasta_to_abundance", "SELECT CAST(sum(1) AS BIGINT) AS reads, count(DISTINCT seq) AS uniques, count(DISTINCT read_id) AS records FROM v_reads")
def a11(spark, d):
    a = src.fasta_to_abundance(v.v_reads(spark, d).select(F.col("read_id").alias("sequence_id"), F.col("seq").alias("sequence")))
    return a.agg(F.sum("n").alias("reads"), F.countDistinct("sequence").alias("uniques"), F.countDistinct("sequence_id").alias("records"))


@query("a12_write_predictions", "SELECT * FROM v_rows")
def a12(spark, d):
    path = shared_path(spark, "predictions")
    src.write_predictions(v.v_rows(spark, d), path)
    schema = ", ".join(f"`{c}` " + {"sequence_id": "long", "confidence": "double"}.get(c, "string") for c in PREDICTION_COLUMNS)
    return spark.read.option("header", True).schema(schema).csv(f"{path}/csv")


@query("a13_write_summary", "SELECT source AS sample_id, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def a13(spark, d):
    path = shared_path(spark, "summary")
    s = v.table(spark, d, "documents").groupBy(F.col("source").alias("sample_id")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    src.write_summary(s, path)
    return spark.read.schema("sample_id string, n long, chars long").json(path)


@query("a14_training_manifest", "SELECT string_agg(label, ',' ORDER BY label) AS classes, count(*) AS n_classes, any_value(a) AS n_train, any_value(b) AS n_rest FROM (SELECT DISTINCT label FROM v_class), (SELECT count(*) FILTER (id % 5 <> 0) AS a, count(*) FILTER (id % 5 = 0) AS b FROM v_class)")
def a14(spark, d):
    m = src.training_manifest(v.v_class(spark, d).withColumn("split", F.when(F.col("id") % 5 == 0, "rest").otherwise("train")))
    return m.select(F.array_join("classes", ",").alias("classes"), "n_classes", F.element_at("sizes", "train").alias("n_train"), F.element_at("sizes", "rest").alias("n_rest"))


HISTOGRAM = "SELECT bin, count(confidence) AS n FROM (VALUES ('0-40', -1e9, 40.0), ('40-60', 40, 60), ('60-80', 60, 80), ('80-90', 80, 90), ('90-100', 90, 1e9)) AS b(bin, lo, hi) LEFT JOIN v_rows ON confidence >= lo AND confidence < hi GROUP BY bin"


@query("a15_report_tables", f"SELECT 'cards' AS panel, 'total' AS name, CAST(count(*) AS DOUBLE) AS value FROM v_rows UNION ALL SELECT 'confidence', bin, CAST(n AS DOUBLE) FROM ({HISTOGRAM}) UNION ALL SELECT 'genus', genus, CAST(n AS DOUBLE) FROM (SELECT genus, count(*) AS n FROM v_rows GROUP BY genus ORDER BY n DESC, genus LIMIT 12) UNION ALL SELECT 'preview', 'rows', CAST(least(200, count(*)) AS DOUBLE) FROM v_rows")
def a15(spark, d):
    t = summary.report_tables(v.v_rows(spark, d))
    part = lambda name, df, k, x: df.select(F.lit(name).alias("panel"), k.alias("name"), x.cast("double").alias("value"))
    cards = part("cards", t["cards"], F.lit("total"), F.col("total_classified"))
    rows = t["preview"].agg(F.count("*").alias("n"))
    return cards.unionByName(part("confidence", t["confidence_panel"], F.col("bin"), F.col("n"))).unionByName(part("genus", t["genus_panel"], F.col("taxon"), F.col("n"))).unionByName(part("preview", rows, F.lit("rows"), F.col("n")))
