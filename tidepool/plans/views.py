"""Views of the given tables in the shapes that operators take, as DataFrames and as SQL.

Each function has a statement of the same name in SQL; ``with_views`` puts those that a query
needs in front of it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTANRCGTACYGTACGTGA-"
#: Quality characters that stand for each base in v_reads_q (Phred+33: 40 down to 2).
QUALITIES = dict(zip("ACGTNRY-", "IHGF#+5!", strict=True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_reads(spark: SparkSession, d: str) -> DataFrame:
    """Documents as reads: read_id, sample_id, taxon, seq."""
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    return table(spark, d, "documents").select(F.col("doc_id").alias("read_id"), F.col("source").alias("sample_id"), F.col("lang").alias("taxon"), F.translate(letters, LETTERS, BASES).alias("seq"))


def v_reads_q(spark: SparkSession, d: str) -> DataFrame:
    return v_reads(spark, d).withColumn("quality", F.translate("seq", "".join(QUALITIES), "".join(QUALITIES.values())))


def v_words(spark: SparkSession, d: str) -> DataFrame:
    """Long words of documents as short reads, some far more abundant than others: sample_id, seq."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{9,})"), F.lit(1)))
    return table(spark, d, "documents").select(F.col("lang").alias("sample_id"), words.alias("w")).select("sample_id", F.translate("w", LETTERS, BASES).alias("seq"))


def v_emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("sequence_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")


def v_pred(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with its nearest label mean: sequence_id, true_label, cluster, confidence (0 to 1,
    4 digits, so that percentages have no ties)."""
    from ..operators.models import centroid_confidence, label_centroids

    e = v_emb(spark, d)
    near = centroid_confidence(e, label_centroids(e))
    return near.join(e.select("sequence_id", F.col("label").alias("true_label")), "sequence_id").select("sequence_id", "true_label", "cluster", F.round("confidence", 4).alias("confidence"))


def v_rows(spark: SparkSession, d: str) -> DataFrame:
    """v_pred as prediction rows of OTU clusters (confidence in percent)."""
    from ..operators.models import otu_rows

    return otu_rows(v_pred(spark, d), "nearest_centroid")


def v_tax_labels(spark: SparkSession, d: str) -> DataFrame:
    """Customers with a label in three forms by id % 3."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    form, region = F.col("c_custkey") % 3, F.translate("r_name", " ", "_")
    label = F.when(form == 0, F.concat(F.lit("k__"), region, F.lit(";p__"), "n_name", F.lit(";c__"), "c_mktsegment")).when(form == 1, F.concat_ws(";", region, "n_name", "c_mktsegment")).otherwise(F.concat_ws(" ", region, "n_name", "c_mktsegment"))
    return j.select(F.col("c_custkey").alias("id"), label.alias("label"))


def v_nodes(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    node = lambda df, t, p, k: df.select(t.cast("int").alias("taxid"), p.cast("int").alias("parent"), F.lit(k).alias("rank"))
    root = spark.range(1).select(F.lit(1).alias("taxid"), F.lit(1).alias("parent"), F.lit("no rank").alias("rank"))
    return root.unionByName(node(r, 10 + F.col("r_regionkey"), F.lit(1), "superkingdom")).unionByName(node(n, 100 + F.col("n_nationkey"), 10 + F.col("n_regionkey"), "phylum")).unionByName(node(c, 1000 + F.col("c_custkey"), 100 + F.col("c_nationkey"), "species"))


def v_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of nodes; every 50th customer has none."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    name = lambda df, t, x: df.select(t.cast("int").alias("taxid"), F.col(x).alias("name"))
    return name(r, 10 + F.col("r_regionkey"), "r_name").unionByName(name(n, 100 + F.col("n_nationkey"), "n_name")).unionByName(name(c.where("c_custkey % 50 <> 7"), 1000 + F.col("c_custkey"), "c_name"))


def v_abund(spark: SparkSession, d: str) -> DataFrame:
    """Line items as counts: sample = supplier's nation, taxon = part, path = type, brand."""
    li, s, n, p = (table(spark, d, t) for t in ("lineitem", "supplier", "nation", "part"))
    j = li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).join(p, li.l_partkey == p.p_partkey)
    return j.groupBy(F.col("n_name").alias("sample_id"), F.col("p_type").alias("type"), F.col("p_brand").alias("brand"), F.col("p_partkey").cast("string").alias("taxon")).agg(F.sum("l_quantity").cast("long").alias("n"))


def v_counts(spark: SparkSession, d: str) -> DataFrame:
    return v_abund(spark, d).select("sample_id", "taxon", "n")


def v_runs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as runs: F completed, O running, P queued; every 11th completed one failed."""
    o = table(spark, d, "orders")
    status = F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 11 == 0), "failed").when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("queued")
    seconds = F.floor("o_totalprice").cast("long")
    return o.select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("batch_id"), status.alias("status"), (status == "completed").alias("success"), F.col("o_orderdate").cast("timestamp").alias("start_time"), F.timestamp_seconds(F.col("o_orderdate").cast("timestamp").cast("long") + seconds).alias("end_time"), F.when(F.col("o_orderkey") % 13 == 0, F.lit(0.0)).otherwise(F.round("o_totalprice", 2)).alias("processing_time"))


def v_class(spark: SparkSession, d: str) -> DataFrame:
    """Parts as labelled rows of classes of different sizes: id, label, seq_len."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.when(F.col("p_size") % 7 == 0, F.col("p_brand")).otherwise(F.lit("spp"))).alias("label"), (F.col("p_size") * 10 + F.col("p_partkey") % 10).cast("int").alias("seq_len"))


def v_logs(spark: SparkSession, d: str) -> DataFrame:
    """Events as log lines; every 17th has no separators."""
    e = table(spark, d, "events")
    ts = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    line = F.when(F.col("event_id") % 17 == 0, F.concat_ws(" ", "event_type", "props")).otherwise(F.concat_ws(" - ", ts, F.upper("event_type"), "props"))
    return e.select("event_id", line.alias("line"))


def v_updates(spark: SparkSession, d: str) -> DataFrame:
    """Events as partial updates of runs (one run a user)."""
    e = table(spark, d, "events")
    k = F.col("event_id") % 4
    return e.select(F.col("user_id").alias("run_id"), "ts", F.col("event_id").alias("seq"), F.when(k == 0, F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("running")).alias("status"), F.when(k == 1, F.floor("value").cast("int")).alias("progress"), F.when(k == 2, F.col("props")).alias("message"))


def v_tsv(spark: SparkSession, d: str) -> DataFrame:
    """Customers as tab-separated lines, some of them broken."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    taxid = F.when(k % 7 == 1, "x1").when(k % 7 == 2, "0").otherwise(k.cast("string"))
    seq = F.when(k % 11 == 3, "ACGT").otherwise(F.concat(F.repeat(F.lit("ACGTTGCAAC"), 5), F.lit("A")))
    line = F.when(k % 5 == 4, F.concat_ws("\t", "c_name", taxid)).otherwise(F.concat_ws("\t", "c_name", taxid, "c_mktsegment", seq))
    return c.select(k.alias("id"), line.alias("line"))


SQL = {
    "v_reads": f"SELECT doc_id AS read_id, source AS sample_id, lang AS taxon, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{BASES}') AS seq FROM documents",
    "v_reads_q": f"SELECT *, translate(seq, '{''.join(QUALITIES)}', '{''.join(QUALITIES.values())}') AS quality FROM v_reads",
    "v_words": f"SELECT sample_id, translate(w, '{LETTERS}', '{BASES}') AS seq FROM (SELECT lang AS sample_id, unnest(regexp_extract_all(lower(text), '[a-z]{{9,}}')) AS w FROM documents)",
    "v_emb": "SELECT vec_id AS sequence_id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings",
    "v_flat": "SELECT sequence_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM v_emb",
    "v_mean": "SELECT label AS cluster, i, avg(x) AS m FROM v_flat GROUP BY label, i",
    "v_dist": "SELECT f.sequence_id, f.label AS true_label, cluster, sqrt(sum((x - m) * (x - m))) AS d FROM v_flat f JOIN v_mean USING (i) GROUP BY ALL",
    "v_pred": "SELECT sequence_id, true_label, arg_min(cluster, (d, cluster)) AS cluster, round(exp(-min(d)) / sum(exp(-d)), 4) AS confidence FROM v_dist GROUP BY ALL",
    "v_rows": "SELECT sequence_id, 'Unknown' AS kingdom, otu AS phylum, 'Unknown' AS class, 'Unknown' AS \"order\", 'Unknown' AS family, otu AS genus, otu AS species, round(confidence * 100, 2) AS confidence, 'nearest_centroid' AS method, otu AS predicted_label FROM (SELECT *, printf('OTU-%03d', cluster + 1) AS otu FROM v_pred)",
    "v_tax_labels": "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'k__' || replace(r_name, ' ', '_') || ';p__' || n_name || ';c__' || c_mktsegment WHEN 1 THEN replace(r_name, ' ', '_') || ';' || n_name || ';' || c_mktsegment ELSE replace(r_name, ' ', '_') || ' ' || n_name || ' ' || c_mktsegment END AS label FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "v_nodes": "SELECT 1 AS taxid, 1 AS parent, 'no rank' AS rank UNION ALL SELECT 10 + r_regionkey, 1, 'superkingdom' FROM region UNION ALL SELECT 100 + n_nationkey, 10 + n_regionkey, 'phylum' FROM nation UNION ALL SELECT CAST(1000 + c_custkey AS INT), 100 + c_nationkey, 'species' FROM customer",
    "v_names": "SELECT 10 + r_regionkey AS taxid, r_name AS name FROM region UNION ALL SELECT 100 + n_nationkey, n_name FROM nation UNION ALL SELECT CAST(1000 + c_custkey AS INT), c_name FROM customer WHERE c_custkey % 50 <> 7",
    "v_abund": "SELECT n_name AS sample_id, p_type AS type, p_brand AS brand, CAST(p_partkey AS VARCHAR) AS taxon, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "v_counts": "SELECT sample_id, taxon, n FROM v_abund",
    "v_runs": "SELECT o_orderkey AS sample_id, o_custkey AS batch_id, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 11 = 0 THEN 'failed' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'queued' END AS status, o_orderstatus = 'F' AND o_orderkey % 11 <> 0 AS success, o_orderdate AS start_time, o_orderdate + to_seconds(floor(o_totalprice)) AS end_time, CASE WHEN o_orderkey % 13 = 0 THEN 0.0 ELSE round(o_totalprice, 2) END AS processing_time FROM orders",
    "v_class": "SELECT p_partkey AS id, p_name || ' ' || CASE WHEN p_size % 7 = 0 THEN p_brand ELSE 'spp' END AS label, CAST(p_size * 10 + p_partkey % 10 AS INT) AS seq_len FROM part",
    "v_logs": "SELECT event_id, CASE WHEN event_id % 17 = 0 THEN event_type || ' ' || props ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || ' - ' || upper(event_type) || ' - ' || props END AS line FROM events",
    "v_updates": "SELECT user_id AS run_id, ts, event_id AS seq, CASE WHEN event_id % 4 = 0 THEN CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'running' END END AS status, CASE WHEN event_id % 4 = 1 THEN CAST(floor(value) AS INT) END AS progress, CASE WHEN event_id % 4 = 2 THEN props END AS message FROM events",
    "v_tsv": "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 4 THEN concat_ws(chr(9), c_name, t) ELSE concat_ws(chr(9), c_name, t, c_mktsegment, s) END AS line FROM (SELECT *, CASE c_custkey % 7 WHEN 1 THEN 'x1' WHEN 2 THEN '0' ELSE CAST(c_custkey AS VARCHAR) END AS t, CASE WHEN c_custkey % 11 = 3 THEN 'ACGT' ELSE repeat('ACGTTGCAAC', 5) || 'A' END AS s FROM customer)",
}


def with_views(sql: str) -> str:
    """The statement with the views it names, and those that they name, in front."""
    need: list[str] = []

    def add(text: str) -> None:
        for v in SQL:
            if v not in need and re.search(rf"\b{v}\b", text):
                add(SQL[v])
                need.append(v)

    add(sql)
    ctes = [f"{v} AS ({SQL[v]})" for v in need]
    body = sql.strip()
    if not ctes:
        return body
    if m := re.match(r"WITH (RECURSIVE )?", body):
        return f"WITH {m[1] or ''}{', '.join(ctes)}, {body[m.end():]}"
    return f"WITH {', '.join(ctes)} {body}"
