"""Queries over joins, summaries, balancing, diversity, runs, models and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import balance, clean, diversity, evaluate, lineage, models, runs, summary
from ..operators.features import as_vector
from ..schema import RANKS
from ..storage import kept, scratch, shared_path, written
from ..streaming import streams
from . import views as v
from .registry import query
from .source_queries import HISTOGRAM

# -- joins ------------------------------------------------------------------------------------

LINEAGE = """
WITH RECURSIVE walk AS (
  SELECT taxid AS id, taxid, parent, rank, 0 AS depth FROM v_nodes
  UNION ALL SELECT id, n.taxid, n.parent, n.rank, depth + 1 FROM walk w JOIN v_nodes n ON n.taxid = w.parent WHERE w.parent <> w.taxid),
lin AS (SELECT id AS taxid, max(CASE WHEN rank = 'superkingdom' THEN name END) AS kingdom, max(CASE WHEN rank = 'phylum' THEN name END) AS phylum, max(CASE WHEN rank = 'species' THEN name END) AS species FROM walk LEFT JOIN v_names USING (taxid) GROUP BY id)
"""
RANKED = "coalesce(kingdom, 'Unknown') AS kingdom, coalesce(phylum, 'Unknown') AS phylum, coalesce(species, 'Unknown') AS species"


def lineages(spark, d):
    nodes = v.v_nodes(spark, d)
    return lineage.resolve_lineage(nodes, nodes, v.v_names(spark, d))


@query("j1_resolve_lineage", LINEAGE + f"SELECT taxid, {RANKED} FROM lin")
def j1(spark, d):
    return lineages(spark, d).select("taxid", "kingdom", "phylum", "species")


@query("j2_attach_lineage", LINEAGE + f"SELECT o_orderkey AS id, {RANKED} FROM orders LEFT JOIN lin ON taxid = 1000 + o_custkey + CASE WHEN o_orderkey % 9 = 0 THEN 100000000 ELSE 0 END")
def j2(spark, d):
    taxid = (1000 + F.col("o_custkey") + F.when(F.col("o_orderkey") % 9 == 0, 100000000).otherwise(0)).cast("int")
    rows = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), taxid.alias("taxid"))
    return lineage.attach_lineage(rows, lineages(spark, d)).select("id", "kingdom", "phylum", "species")


@query("j3_keep_classes", "SELECT id, label FROM v_class WHERE label IN (SELECT label FROM v_class GROUP BY label ORDER BY count(*) DESC, min(id) LIMIT 10)")
def j3(spark, d):
    rows = v.v_class(spark, d)
    return balance.keep_classes(rows, balance.top_classes(rows, 10)).select("id", "label")


@query("j4_drop_rare", "SELECT id, label FROM v_class WHERE label IN (SELECT label FROM v_class GROUP BY label HAVING count(*) >= 3)")
def j4(spark, d):
    return balance.drop_rare(v.v_class(spark, d)).select("id", "label")


@query("j4_label_difference", "SELECT DISTINCT label FROM v_class WHERE label NOT IN (SELECT label FROM v_class WHERE seq_len > 250)")
def j4b(spark, d):
    rows = v.v_class(spark, d)
    return balance.label_difference(rows, rows.where("seq_len > 250"))


@query("j5_encode_labels", "SELECT id, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INT) AS label_id FROM v_class")
def j5(spark, d):
    return balance.encode_labels(v.v_class(spark, d))[0].select("id", "label", "label_id")


@query("j5_label_codes", "SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS label_id FROM (SELECT DISTINCT label FROM v_class)")
def j5b(spark, d):
    return balance.label_codes(v.v_class(spark, d))


@query("j6_knn_classify", """
WITH c AS (SELECT q.sequence_id, r.label, round(1 - sum(q.x * r.x) / (sqrt(sum(q.x * q.x)) * sqrt(sum(r.x * r.x))), 9) AS d, r.sequence_id AS ref FROM v_flat q JOIN v_flat r ON q.i = r.i AND q.sequence_id % 20 = 0 AND r.sequence_id <> q.sequence_id GROUP BY q.sequence_id, r.sequence_id, r.label),
n AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY d, ref) AS p FROM c),
t AS (SELECT sequence_id, label, count(*) AS k, min(d) AS d FROM n WHERE p <= 5 GROUP BY ALL)
SELECT sequence_id, arg_min(CAST(label AS VARCHAR), (-k, d, CAST(label AS VARCHAR))) AS predicted_label, round(20.0 * max(k), 2) AS confidence, round(min(d), 6) AS closest_distance FROM t GROUP BY sequence_id""")
def j6(spark, d):
    e = v.v_emb(spark, d).withColumnRenamed("sequence_id", "id")
    # the stated query set: ids divisible by 20, against all rows but the query itself
    return lineage.knn_classify(e.where("id % 20 = 0"), e, others=True).select("sequence_id", "predicted_label", "confidence", "closest_distance")


@query("j7_taxonomy_from_hits", LINEAGE + f", h AS (SELECT l_orderkey AS q, l_partkey AS subject, 1000 + l_suppkey AS taxid, 100 - l_discount * 100 AS pident, l_tax AS evalue, row_number() OVER (PARTITION BY l_orderkey ORDER BY 100 - l_discount * 100 DESC, l_tax, l_partkey, l_suppkey) AS r FROM lineitem WHERE 100 - l_discount * 100 >= 94) SELECT q AS query_id, {RANKED} FROM h LEFT JOIN lin USING (taxid) WHERE r = 1")
def j7(spark, d):
    hits = v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.struct("l_partkey", "l_suppkey").alias("subject_id"), F.concat((1000 + F.col("l_suppkey")).cast("string"), F.lit(";9")).alias("staxids"), (100 - F.col("l_discount") * 100).alias("pident"), F.col("l_tax").alias("evalue"))
    return lineage.taxonomy_from_hits(hits, lineages(spark, d), 94).select("query_id", "kingdom", "phylum", "species")


@query("j8_consensus", "SELECT c_custkey AS sequence_id, CASE WHEN c_custkey % 5 = 0 THEN 'Unknown' ELSE r_name END AS kingdom, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 2 = 0 THEN 'Unknown' ELSE n_name END AS phylum, CASE WHEN c_custkey % 5 = 0 THEN 0.5 WHEN c_custkey % 2 = 0 THEN 1.0 ELSE 0.75 END AS share FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j8(spark, d):
    c, n, r = (v.table(spark, d, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    k = F.col("c_custkey")

    def method(name, kingdom, phylum):
        return j.select(k.alias("sequence_id"), F.lit(name).alias("method"), kingdom.alias("kingdom"), phylum.alias("phylum"), *[F.lit(None).cast("string").alias(x) for x in RANKS[2:]])

    a = method("a", F.col("r_name"), F.col("n_name"))
    b = method("b", F.when(k % 5 == 0, "elsewhere").otherwise(F.col("r_name")), F.when(k % 2 == 0, "other").otherwise(F.col("n_name")))
    e = method("c", F.when(k % 5 == 0, "elsewhere").otherwise(F.col("r_name")), F.lit("third"))
    weights = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 1.0)], "method string, weight double")
    return lineage.consensus(a.unionByName(b).unionByName(e), weights).select("sequence_id", "kingdom", "phylum", "share")


@query("j9_hybrid_route")
def j9(spark, d):
    return models.hybrid_route(v.v_rows(spark, d), v.v_emb(spark, d), 12.0)


@query("j10_attach_samples", "SELECT doc_id AS read_id, n_name AS sample_id, 'single' AS mate FROM documents JOIN nation ON source = 'src' || n_nationkey WHERE n_nationkey % 3 > 0")
def j10(spark, d):
    manifest = v.table(spark, d, "nation").where("n_nationkey % 3 > 0").select(F.col("n_name").alias("sample_id"), F.lit("single").alias("mate"), F.concat(F.lit("data/src"), "n_nationkey", F.lit(".fa")).alias("path"))
    reads = v.table(spark, d, "documents").select(F.col("doc_id").alias("read_id"), F.concat(F.lit("file:/in/"), "source", F.lit(".fa")).alias("file"))
    return lineage.attach_samples(reads, manifest).select("read_id", "sample_id", "mate")


# -- summaries --------------------------------------------------------------------------------


@query("c1_rank_distribution", "SELECT genus AS taxon, count(*) AS n FROM v_rows GROUP BY genus ORDER BY n DESC, min(sequence_id) LIMIT 20")
def c1(spark, d):
    return summary.rank_distribution(v.v_rows(spark, d), "genus")


@query("c1_rank_distribution_by_sample", "SELECT sample_id, taxon, n, CAST(place AS INT) AS place FROM (SELECT source AS sample_id, lang AS taxon, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(doc_id)) AS place FROM documents GROUP BY source, lang) WHERE place <= 3")
def c1b(spark, d):
    rows = v.table(spark, d, "documents").select(F.col("source").alias("sample_id"), F.col("lang").alias("genus"), F.col("doc_id").alias("sequence_id"))
    return summary.rank_distribution_by(rows, "sample_id", "genus", 3)


@query("c2_confidence_histogram", HISTOGRAM)
def c2(spark, d):
    return summary.confidence_histogram(v.v_rows(spark, d))


@query("c3_confidence_stats", "SELECT count(*) AS total_classified, round(avg(confidence), 2) AS mean_confidence FROM v_rows")
def c3(spark, d):
    return summary.confidence_stats(v.v_rows(spark, d))


@query("c4_classification_summary", f"SELECT count(*) AS total_classified, round(avg(confidence), 2) AS mean_confidence, 'fallback' AS classification_mode, 'nearest_centroid' AS classifier, (SELECT string_agg(genus || '=' || n, ',' ORDER BY genus) FROM (SELECT genus, count(*) AS n FROM v_rows GROUP BY genus ORDER BY n DESC, min(sequence_id) LIMIT 20)) AS genera, (SELECT string_agg(bin || '=' || n, ',' ORDER BY bin) FROM ({HISTOGRAM})) AS bins FROM v_rows")
def c4(spark, d):
    s = summary.classification_summary(v.v_rows(spark, d), "fallback", "nearest_centroid")
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return s.select("total_classified", "mean_confidence", "classification_mode", "classifier", text("genus_distribution").alias("genera"), text("confidence_distribution").alias("bins"))


@query("c5_top_n_other", "WITH c AS (SELECT p_brand AS taxon, count(*) AS n FROM part GROUP BY p_brand), t AS (SELECT * FROM c ORDER BY n DESC, taxon LIMIT 5) SELECT * FROM t UNION ALL SELECT 'Other', CAST(sum(n) AS BIGINT) FROM c WHERE taxon NOT IN (SELECT taxon FROM t)")
def c5(spark, d):
    return summary.top_n_other(v.table(spark, d, "part").groupBy(F.col("p_brand").alias("taxon")).agg(F.count("*").alias("n")))


@query("c6_top_positive", "SELECT c_name AS taxon, c_acctbal AS n FROM customer WHERE c_custkey % 7 > 0 AND c_acctbal > 0 ORDER BY n DESC, taxon LIMIT 10")
def c6(spark, d):
    rows = v.table(spark, d, "customer").select(F.col("c_name").alias("taxon"), F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("n"))
    return summary.top_positive(rows)


@query("c7_dashboard_snapshot", "SELECT count(*) AS total_runs, round(100.0 * count(*) FILTER (status = 'completed') / count(*), 2) AS success_rate, CAST(floor(avg(processing_time) FILTER (processing_time > 0)) AS BIGINT) AS avg_processing_time, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'queued') AS queued, max(end_time) FILTER (status = 'completed') AS last_completed FROM v_runs")
def c7(spark, d):
    return runs.dashboard_snapshot(v.v_runs(spark, d))


@query("c8_batch_summary", "SELECT batch_id, count(*) AS samples, count(*) FILTER (status = 'completed') AS successes, count(*) FILTER (status = 'failed') AS failures, CASE WHEN count(*) FILTER (status = 'failed') = 0 THEN 'completed' ELSE 'failed' END AS status, round(100.0 * count(*) FILTER (status = 'completed') / count(*), 2) AS success_rate, round((epoch(max(end_time)) - epoch(min(start_time))) / count(*), 3) AS average_time FROM v_runs GROUP BY batch_id")
def c8(spark, d):
    return runs.batch_summary(v.v_runs(spark, d))


@query("c9_support_profile", "SELECT count(*) FILTER (n = 1) AS one, count(*) FILTER (n BETWEEN 2 AND 4) AS two_to_four, count(*) FILTER (n BETWEEN 5 AND 9) AS five_to_nine, count(*) FILTER (n >= 10) AS ten_or_more, count(*) FILTER (n >= 50) AS fifty_or_more FROM (SELECT count(*) AS n FROM v_class GROUP BY label)")
def c9(spark, d):
    return balance.support_profile(v.v_class(spark, d))


@query("c10_describe_lengths", "SELECT count(seq_len) AS count, round(avg(seq_len), 6) AS mean, round(stddev_samp(seq_len), 6) AS std, min(seq_len) AS min, quantile_cont(seq_len, 0.25) AS q1, quantile_cont(seq_len, 0.5) AS median, quantile_cont(seq_len, 0.75) AS q3, max(seq_len) AS max FROM v_class")
def c10(spark, d):
    return balance.describe(v.v_class(spark, d), "seq_len")


@query("c10_class_stats", "SELECT count(n) AS count, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS min, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.75) AS q3, max(n) AS max FROM (SELECT count(*) AS n FROM v_class GROUP BY label)")
def c10b(spark, d):
    return balance.describe(balance.class_counts(v.v_class(spark, d)), "n")


@query("c11_coverage", "SELECT count(*) AS rows, count(*) FILTER (taxon <> 'es') AS known, round(100.0 * count(*) FILTER (taxon <> 'es') / count(*), 2) AS known_percent, count(DISTINCT taxon) FILTER (taxon <> 'es') AS distinct_known, count(DISTINCT sample_id) AS distinct_taxids FROM v_reads")
def c11(spark, d):
    rows = v.v_reads(spark, d).select(F.when(F.col("taxon") == "es", "Unknown").otherwise(F.col("taxon")).alias("species"), F.col("sample_id").alias("taxid"))
    return balance.coverage(rows)


DEPTHS = "SELECT p_partkey AS id, p_size % 8 AS depth FROM part"


@query("c13_rank_success", f"SELECT rank, count(*) FILTER (depth >= k) AS known, round(100.0 * count(*) FILTER (depth >= k) / count(*), 2) AS percent FROM ({DEPTHS}), (VALUES ('kingdom', 1), ('phylum', 2), ('class', 3), ('order', 4), ('family', 5), ('genus', 6), ('species', 7)) AS r(rank, k) GROUP BY rank")
def c13(spark, d):
    # labels that name a part's first p_size % 8 ranks
    names = F.slice(F.array(*[F.lit(x) for x in "abcdefg"]), 1, (F.col("p_size") % 8).cast("int"))
    rows = v.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(names, ";").alias("label"))
    return summary.rank_success(lineage.with_ranks(rows, "label"))


@query("c13_top_taxa", "SELECT n_name AS taxon, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM customer), 2) AS percent FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n DESC, min(c_custkey) LIMIT 5")
def c13b(spark, d):
    return summary.top_taxa(lineage.with_ranks(v.v_tax_labels(spark, d), "label"), "phylum", 5, "id")


REPORT = "WITH m AS (SELECT true_label AS a, cluster AS p, count(*) AS n FROM v_pred GROUP BY ALL), r AS (SELECT c AS class, coalesce((SELECT sum(n) FROM m WHERE a = p AND a = c), 0) AS hit, coalesce((SELECT sum(n) FROM m WHERE a = c), 0) AS support, coalesce((SELECT sum(n) FROM m WHERE p = c), 0) AS given FROM (SELECT a AS c FROM m UNION SELECT p FROM m)), s AS (SELECT class, round(CASE WHEN given > 0 THEN hit / given ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN hit / support ELSE 0 END, 6) AS recall, round(CASE WHEN hit > 0 THEN 2.0 * hit / (given + support) ELSE 0 END, 6) AS f1, CAST(support AS BIGINT) AS support FROM r) "


def judged(spark, d):
    return v.v_pred(spark, d).withColumnRenamed("cluster", "predicted_label")


@query("c14_class_report", REPORT + "SELECT * FROM s")
def c14(spark, d):
    return evaluate.class_report(judged(spark, d))


@query("c14_overall_report", REPORT + "SELECT (SELECT round(avg(CAST(true_label = cluster AS INT)), 6) FROM v_pred) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, count(*) AS classes FROM s")
def c14b(spark, d):
    return evaluate.overall_report(judged(spark, d))


@query("c15_topk_accuracy", "SELECT round(avg(CAST(r <= 3 AS INT)), 6) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY d, cluster) AS r FROM v_dist) WHERE cluster = true_label")
def c15(spark, d):
    e = v.v_emb(spark, d)
    centers = models.label_centroids(e).agg(F.collect_list(F.struct("cluster", "center")).alias("c"))
    far = lambda c: F.aggregate(F.zip_with("embedding", c["center"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    top = F.transform(F.slice(F.sort_array(F.transform("c", lambda c: F.struct(far(c).alias("d"), c["cluster"].alias("cluster")))), 1, 3), lambda x: x["cluster"])
    return evaluate.topk_accuracy(e.join(F.broadcast(centers)).select(F.col("label").alias("true_label"), top.alias("top_labels")))


@query("c16_confusion_matrix", "SELECT true_label AS actual, cluster AS predicted, count(*) AS n FROM v_pred GROUP BY ALL")
def c16(spark, d):
    return evaluate.confusion_matrix(judged(spark, d))


@query("c17_class_weights", "WITH c AS (SELECT label, count(*) AS n FROM v_class GROUP BY label) SELECT label, n, round((1.0 / n) / (SELECT avg(1.0 / n) FROM c), 6) AS weight, round((SELECT max(n) / min(n) FROM c), 6) AS imbalance, (SELECT max(n) / min(n) > 5 FROM c) AS weighted FROM c")
def c17(spark, d):
    return balance.class_weights(v.v_class(spark, d))


@query("c18_abundance_by_rank", "SELECT sample_id, 'type' AS rank, type AS taxon, CAST(sum(n) AS BIGINT) AS n FROM v_abund GROUP BY ALL UNION ALL SELECT sample_id, 'brand', brand, CAST(sum(n) AS BIGINT) FROM v_abund GROUP BY ALL UNION ALL SELECT sample_id, 'taxon', taxon, CAST(sum(n) AS BIGINT) FROM v_abund GROUP BY ALL")
def c18(spark, d):
    return diversity.abundance_by_rank(v.v_abund(spark, d), ["type", "brand", "taxon"])


@query("c18_abundance_rollup", "SELECT sample_id, type, brand, CAST(sum(n) AS BIGINT) AS n, CAST(GROUPING(sample_id, type, brand) AS BIGINT) AS level FROM v_abund GROUP BY ROLLUP (sample_id, type, brand)")
def c18b(spark, d):
    return diversity.abundance_rollup(v.v_abund(spark, d), ["type", "brand"])


@query("c19_cluster_quality", "SELECT cluster, CAST(sum(n) AS BIGINT) AS size, arg_min(label, (-n, label)) AS majority, round(max(n) / sum(n), 6) AS purity FROM (SELECT cluster, true_label AS label, count(*) AS n FROM v_pred GROUP BY ALL) GROUP BY cluster")
def c19(spark, d):
    return evaluate.cluster_quality(v.v_pred(spark, d).withColumnRenamed("true_label", "label"))


@query("c19_silhouette")
def c19b(spark, d):
    e = as_vector(v.v_emb(spark, d)).withColumn("cluster", F.col("label").cast("double"))
    return spark.createDataFrame([(evaluate.silhouette(e),)], "silhouette double")


# -- diversity --------------------------------------------------------------------------------

TOTALS = "WITH t AS (SELECT sample_id, sum(n) AS total FROM v_counts GROUP BY sample_id) "


@query("d1_normalize_relative", TOTALS + "SELECT sample_id, taxon, n, round(n / total, 9) AS share FROM v_counts JOIN t USING (sample_id)")
def d1(spark, d):
    return diversity.normalize_relative(v.v_counts(spark, d))


@query("d2_rarefy", "WITH e AS (SELECT sample_id, taxon, unnest(generate_series(1, n)) AS i, total FROM (SELECT *, sum(n) OVER (PARTITION BY sample_id) AS total FROM v_counts) WHERE total >= 500), r AS (SELECT sample_id, taxon, row_number() OVER (PARTITION BY sample_id ORDER BY md5('42|' || sample_id || '|' || taxon || '|' || i), taxon, i) AS r FROM e) SELECT sample_id, taxon, count(*) AS n FROM r WHERE r <= 500 GROUP BY ALL")
def d2(spark, d):
    return diversity.rarefy(v.v_counts(spark, d), 500)


@query("d3_normalize_tpm", "WITH l AS (SELECT *, CAST(taxon AS BIGINT) % 900 + 100 AS length FROM v_counts) SELECT sample_id, taxon, n, round(1e6 * (n / length) / sum(n / length) OVER (PARTITION BY sample_id), 3) AS tpm FROM l")
def d3(spark, d):
    return diversity.normalize_tpm(v.v_counts(spark, d).withColumn("length", F.col("taxon").cast("long") % 900 + 100))


@query("d4_normalize_css", "WITH q AS (SELECT sample_id, quantile_cont(n, 0.5) AS q FROM v_counts WHERE n > 0 GROUP BY sample_id), s AS (SELECT sample_id, sum(n) AS s FROM v_counts JOIN q USING (sample_id) WHERE n > 0 AND n <= q GROUP BY sample_id) SELECT sample_id, taxon, n, round(n * 1000.0 / s, 6) AS css FROM v_counts LEFT JOIN s USING (sample_id)")
def d4(spark, d):
    return diversity.normalize_css(v.v_counts(spark, d))


@query("d5_alpha_diversity", """
WITH a AS (SELECT sample_id, sum(n) AS total, count(*) AS observed, count(*) FILTER (n = 1) AS f1, count(*) FILTER (n = 2) AS f2, count(*) FILTER (n <= 10) AS sr, coalesce(sum(n) FILTER (n <= 10), 0) AS nr, coalesce(sum(n * (n - 1)) FILTER (n <= 10), 0) AS pairs FROM v_counts WHERE n > 0 GROUP BY sample_id),
h AS (SELECT sample_id, -sum(n / total * ln(n / total)) AS h, 1 - sum((n / total) * (n / total)) AS simpson FROM v_counts JOIN a USING (sample_id) GROUP BY sample_id),
c AS (SELECT *, CASE WHEN nr > 0 THEN 1 - f1 / nr ELSE 1.0 END AS cov FROM a JOIN h USING (sample_id)),
g AS (SELECT *, greatest(0.0, CASE WHEN cov > 0 AND nr > 1 THEN sr / cov * pairs / (nr * (nr - 1)) - 1 ELSE 0 END) AS gam FROM c)
SELECT sample_id, CAST(total AS BIGINT) AS total, observed, round(h, 6) AS shannon, round(simpson, 6) AS simpson, round(observed + CASE WHEN f2 > 0 THEN f1 * f1 / (2.0 * f2) ELSE f1 * (f1 - 1) / 2.0 END, 6) AS chao1, round(CASE WHEN observed > 1 THEN h / ln(observed) ELSE 0 END, 6) AS pielou, round((observed - sr) + CASE WHEN cov > 0 THEN sr / cov + f1 / cov * gam ELSE sr END, 6) AS ace FROM g""")
def d5(spark, d):
    return diversity.alpha_diversity(v.v_counts(spark, d))


@query("d6_bray_curtis", TOTALS + "SELECT x.sample_id AS a, y.sample_id AS b, round(1 - 2.0 * coalesce((SELECT sum(least(p.n, q.n)) FROM v_counts p JOIN v_counts q USING (taxon) WHERE p.sample_id = x.sample_id AND q.sample_id = y.sample_id), 0) / (x.total + y.total), 6) AS distance FROM t x JOIN t y ON x.sample_id < y.sample_id")
def d6(spark, d):
    return diversity.bray_curtis(v.v_counts(spark, d))


@query("d7_rarefaction_curve", TOTALS + ", c AS (SELECT sample_id, n, total, depth FROM v_counts JOIN t USING (sample_id) JOIN (VALUES (10), (100), (400)) AS ds(depth) ON depth <= total WHERE n > 0) SELECT sample_id, CAST(depth AS BIGINT) AS depth, round(sum(1 - CASE WHEN total - n >= depth THEN exp(lgamma(total - n + 1) - lgamma(total - n - depth + 1) - lgamma(total + 1) + lgamma(total - depth + 1)) ELSE 0 END), 4) AS richness FROM c GROUP BY ALL")
def d7(spark, d):
    return diversity.rarefaction_curve(v.v_counts(spark, d), [10, 100, 400])


@query("d8_trend", "WITH t AS (SELECT o_custkey % 10 AS site, CAST(to_timestamp(floor(epoch(o_orderdate) / 2592000) * 2592000) AT TIME ZONE 'UTC' AS TIMESTAMP) AS start, sum(o_totalprice) AS value FROM orders GROUP BY ALL), z AS (SELECT *, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM t WINDOW w AS (PARTITION BY site ORDER BY start ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) SELECT site, start, round(value, 6) AS value, round(z, 4) AS z, coalesce(abs(round(z, 4)) > 2, false) AS anomaly FROM z")
def d8(spark, d):
    rows = v.table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("site"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_totalprice").alias("value"))
    return diversity.trend(rows)


@query("d9_abundance_matrix", "SELECT sample_id, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (brand = 'Brand#{i}'), 0) AS BIGINT) AS \"Brand#{i}\"" for i in range(1, 26)) + " FROM v_abund GROUP BY sample_id")
def d9(spark, d):
    return diversity.abundance_matrix(v.v_abund(spark, d).select("sample_id", F.col("brand").alias("taxon"), "n"), [f"Brand#{i}" for i in range(1, 26)])


# -- windows, limits, sampling, sets ----------------------------------------------------------


@query("w1_recent_runs", "SELECT sample_id, status, start_time FROM v_runs ORDER BY start_time DESC NULLS LAST, sample_id LIMIT 25")
def w1(spark, d):
    return runs.recent_runs(v.v_runs(spark, d)).select("sample_id", "status", "start_time")


@query("w2_latest_active", "SELECT sample_id, status, start_time FROM v_runs WHERE status IN ('queued', 'running', 'pending') ORDER BY start_time DESC, sample_id LIMIT 1")
def w2(spark, d):
    return runs.latest_active(v.v_runs(spark, d)).select("sample_id", "status", "start_time")


@query("w3_preview", "SELECT sequence_id, genus, confidence FROM v_rows ORDER BY sequence_id LIMIT 20")
def w3(spark, d):
    return summary.preview(v.v_rows(spark, d), 20).select("sequence_id", "genus", "confidence")


@query("w3_last_durations", "SELECT sample_id, start_time, processing_time FROM v_runs WHERE status = 'completed' ORDER BY start_time DESC, sample_id LIMIT 8")
def w3b(spark, d):
    return runs.last_durations(v.v_runs(spark, d))


@query("w4_order_by_list", "SELECT p_brand AS brand, count(*) AS n, CAST(coalesce(list_position(['Brand#3', 'Brand#1'], p_brand), 3) AS INT) AS place FROM part GROUP BY ALL")
def w4(spark, d):
    counts = v.table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"))
    return summary.order_by_list(counts, "brand", ["Brand#3", "Brand#1"])


@query("w5_uniquify_ids", "SELECT o_orderkey AS at, o_orderstatus || o_custkey % 50 || CASE WHEN r > 1 THEN '-' || (r - 1) ELSE '' END AS run_id FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus || o_custkey % 50 ORDER BY o_orderkey) AS r FROM orders)")
def w5(spark, d):
    o = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("at"), F.concat("o_orderstatus", (F.col("o_custkey") % 50).cast("string")).alias("base_id"))
    return runs.uniquify_ids(o).select("at", "run_id")


FLOOR = "WITH c AS (SELECT label, count(*) AS n FROM v_class GROUP BY label), f AS (SELECT CASE WHEN count(*) FILTER (n >= 40) >= 20 THEN 40 ELSE coalesce((SELECT max(t) FROM generate_series(2, 39) AS g(t) WHERE (SELECT count(*) FROM c WHERE n >= t) >= 20), 40) END AS floor FROM c) "


@query("w6_min_support", FLOOR + "SELECT id, label, CAST(floor AS INT) AS floor FROM v_class JOIN c USING (label), f WHERE n >= floor")
def w6(spark, d):
    return balance.min_support(v.v_class(spark, d), 40, 20).select("id", "label", "floor")


@query("w7_top_classes", "SELECT label, count(*) AS n FROM v_class GROUP BY label ORDER BY n DESC, min(id) LIMIT 15")
def w7(spark, d):
    return balance.top_classes(v.v_class(spark, d), 15)


SHUFFLED = "SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || id), id) AS r, count(*) OVER (PARTITION BY label) AS n FROM v_class"


@query("w8_cap_per_class", f"SELECT id, label FROM ({SHUFFLED}) WHERE r <= 10")
def w8(spark, d):
    return balance.cap_per_class(v.v_class(spark, d), 10).select("id", "label")


@query("w9_subsample_to", f"SELECT id, label FROM ({SHUFFLED}) WHERE r <= CASE WHEN (SELECT count(*) FROM v_class) > 300 THEN greatest(5, floor(n * 300 / (SELECT count(*) FROM v_class))) ELSE n END")
def w9(spark, d):
    return balance.subsample_to(v.v_class(spark, d), 300).select("id", "label")


SPLIT = f"SELECT id, label, CASE WHEN r <= floor(n * 0.8 + 0.5) THEN 'train' WHEN r <= floor(n * 0.9 + 0.5) THEN 'val' ELSE 'test' END AS split FROM ({SHUFFLED})"


@query("w10_stratified_split", SPLIT)
def w10(spark, d):
    return balance.stratified_split(v.v_class(spark, d)).select("id", "label", "split")


BAD_SPLIT = "SELECT id, label, CASE WHEN seq_len > 300 THEN 'val' ELSE 'train' END AS split FROM v_class"


@query("w11_fix_unseen", f"WITH s AS ({BAD_SPLIT}) SELECT id, label, CASE WHEN label IN (SELECT label FROM s WHERE split = 'train') THEN split ELSE 'train' END AS split FROM s")
def w11(spark, d):
    rows = v.v_class(spark, d).select("id", "label", F.when(F.col("seq_len") > 300, "val").otherwise("train").alias("split"))
    return balance.fix_unseen(rows).select("id", "label", "split")


@query("w12_union_all", "SELECT id, label, seq_len FROM v_class WHERE seq_len > 300 UNION ALL SELECT id, label, NULL FROM v_class WHERE seq_len <= 300")
def w12(spark, d):
    rows = v.v_class(spark, d)
    return balance.union_all([rows.where("seq_len > 300"), rows.where("seq_len <= 300").drop("seq_len")])


@query("w13_labels_subset", f"WITH s AS ({SPLIT}) SELECT NOT EXISTS (SELECT 1 FROM s WHERE split <> 'train' AND label NOT IN (SELECT label FROM s WHERE split = 'train')) AS subset, (SELECT count(DISTINCT label) FROM s WHERE split <> 'train') AS labels")
def w13(spark, d):
    s = balance.stratified_split(v.v_class(spark, d))
    rest, train = s.where("split <> 'train'"), s.where("split = 'train'")
    missing = balance.label_difference(rest, train).agg((F.count("*") == 0).alias("subset"))
    return missing.join(F.broadcast(rest.agg(F.countDistinct("label").alias("labels"))))


# -- models -----------------------------------------------------------------------------------


@query("k1_otu_cluster")
def k1(spark, d):
    return models.otu_cluster(v.v_emb(spark, d))


@query("k2_centroid_confidence", "SELECT sequence_id, cluster, confidence FROM v_pred")
def k2(spark, d):
    return v.v_pred(spark, d).select("sequence_id", "cluster", "confidence")


def labelled_vectors(spark, d):
    return as_vector(v.v_emb(spark, d)).select("sequence_id", F.col("sequence_id").alias("id"), "features", F.concat(F.lit("g__Genus"), "label").alias("label"))


@query("k3_classify_supervised")
def k3(spark, d):
    rows = labelled_vectors(spark, d)
    model, _ = models.train_rf(rows)
    return models.classify_supervised(rows.drop("label"), model, threshold=0.3)


@query("k4_classify")
def k4(spark, d):
    e = v.v_emb(spark, d)
    return models.classify(e.where("label >= 5")).unionByName(models.classify(e.where("label < 5"), models.train_rf(labelled_vectors(spark, d))[0]))


@query("k5_train_rf")
def k5(spark, d):
    rows = labelled_vectors(spark, d)
    model, accuracy = models.train_rf(rows)
    path = shared_path(spark, "forest")
    models.save_model(model, path)
    model = models.load_model(path)
    return model.transform(rows).groupBy("label", "predicted_label").agg(F.count("*").alias("n")).withColumn("accuracy", F.lit(accuracy))


@query("k6_train_eval")
def k6(spark, d):
    rows = labelled_vectors(spark, d)
    out = [models.train_eval(rows, kind)[1].withColumn("kind", F.lit(kind)) for kind in ("logistic", "forest")]
    return out[0].unionByName(out[1])


@query("k7_kmer_rf")
def k7(spark, d):
    rows = clean.filter_iupac(v.v_reads(spark, d)).select(F.col("read_id").alias("sequence_id"), "seq", F.concat(F.lit("k__"), "taxon").alias("label"))
    model, _ = models.train_kmer_rf(rows)
    return models.predict_kmer_rf(rows.drop("label"), model)


WORD4 = "SELECT read_id, kmer, count(*) AS c FROM (SELECT read_id, substr(s, i, 4) AS kmer FROM (SELECT read_id, seq[1:256] AS s, unnest(generate_series(1, least(len(seq), 256) - 3)) AS i FROM v_reads WHERE len(seq) > 3)) WHERE regexp_matches(kmer, '^[ACGT]+$') GROUP BY ALL"
PLACE4 = "CAST(0 {} AS INT)".format(" ".join(f"+ {4 ** (3 - i)} * (strpos('ACGT', kmer[{i + 1}]) - 1)" for i in range(4)))
SHARE4 = f"SELECT read_id, {PLACE4} AS place, CAST(CAST(c / sum(c) OVER (PARTITION BY read_id) AS FLOAT) AS DOUBLE) AS share FROM ({WORD4})"


@query("k8_embed", f"SELECT read_id AS sequence_id, place, round(share, 6) AS share, 'kmer4' AS model_name FROM ({SHARE4})")
def k8(spark, d):
    e = models.embed(v.v_reads(spark, d), key="read_id")
    return e.select("sequence_id", "model_name", F.posexplode("embedding").alias("place", "x")).where("x > 0").select("sequence_id", "place", F.round(F.col("x").cast("double"), 6).alias("share"), "model_name")


BY_CENTROID = f"""
WITH s AS ({SHARE4}), t AS (SELECT taxon, row_number() OVER (ORDER BY taxon) - 1 AS cluster, count(*) AS n FROM v_reads GROUP BY taxon),
m AS (SELECT taxon, place, sum(share) / max(n) AS m FROM s JOIN v_reads USING (read_id) JOIN t USING (taxon) GROUP BY taxon, place),
g AS (SELECT read_id, cluster, taxon FROM v_reads r JOIN t ON true),
d AS (SELECT read_id, g.cluster, sqrt(sum((coalesce(share, 0) - coalesce(m, 0)) ** 2)) AS d FROM (SELECT read_id, r.taxon AS own, t.cluster, t.taxon, CAST(i AS INT) AS place FROM v_reads r, t, generate_series(0, 255) AS x(i)) g LEFT JOIN s USING (read_id, place) LEFT JOIN m ON m.taxon = g.taxon AND m.place = g.place GROUP BY ALL)
SELECT read_id AS sequence_id, 'OTU-' || lpad(CAST(arg_min(cluster, (round(d, 9), cluster)) + 1 AS VARCHAR), 3, '0') AS predicted_label, round(100 * exp(-min(d)) / sum(exp(-d)), 2) AS confidence, 'embedding_centroids' AS method FROM d GROUP BY read_id"""


def taxon_centers(spark, d):
    """The mean vector of each known taxon, numbered by name."""
    reads = v.v_reads(spark, d)
    e = written(models.embed(reads, key="read_id").join(reads.select(F.col("read_id").alias("sequence_id"), "taxon"), "sequence_id"), "embedded")
    codes = balance.label_codes(e, "taxon").withColumnRenamed("taxon", "t")
    return e, models.label_centroids(e, "taxon").join(codes, F.col("cluster") == F.col("t")).select(F.col("label_id").alias("cluster"), "center")


def centroid_rows(e, centers):
    return models.otu_rows(models.centroid_confidence(e, centers), "embedding_centroids").select("sequence_id", "predicted_label", "confidence", "method")


@query("pipeline_read_embed_classify", BY_CENTROID)
def whole(spark, d):
    """Reads -> embeddings -> mean vectors of the known taxa -> prediction rows with a confidence."""
    with scratch():
        return kept(centroid_rows(*taxon_centers(spark, d)), "predictions")


# -- streams ----------------------------------------------------------------------------------


def arriving(spark, d):
    """A folder of sequence files with all reads, and how many of them are a batch: at least three, and enough that there are
    four batches at most, so that batches grow with the table, not their number."""
    path = shared_path(spark, "arriving")
    v.v_reads(spark, d).select(F.concat(F.lit(">"), "read_id", F.lit("\n"), "seq")).write.text(path)
    return path, max(3, -(-len(spark.read.text(path).inputFiles()) // 4))


@query("s1_arriving_files", f"SELECT CAST(sequence_id AS VARCHAR) AS sequence_id, predicted_label, confidence, method FROM ({BY_CENTROID}) JOIN v_reads ON read_id = sequence_id WHERE len(seq) > 0")
def s1(spark, d):
    """Files that arrive are read, embedded and classified by the mean vectors of the known taxa, batch by batch."""
    (path, files), out = arriving(spark, d), shared_path(spark, "classified")
    with scratch():
        centers = written(taxon_centers(spark, d)[1], "centers")
        rows = streams.embed_and_classify(lambda e: centroid_rows(e, centers))
        streams.classify_stream(streams.read_fasta_stream(spark, path, files), rows, out, shared_path(spark, "state"), shared_path(spark, "rejects")).awaitTermination()
    return spark.read.schema("sequence_id string, predicted_label string, confidence double, method string").parquet(f"{out}/batch=*")


@query("s1_supervised_stream")
def s1_bundle(spark, d):
    """The same files through a classifier that was trained, saved as a bundle with its taxonomy, and loaded."""
    (path, files), out, place = arriving(spark, d), shared_path(spark, "classified"), shared_path(spark, "bundle")
    with scratch():
        reads = v.v_reads(spark, d).where("length(seq) > 0")
        e = models.embed(reads, key="read_id").join(reads.select(F.col("read_id").alias("sequence_id"), F.concat(F.lit("k__"), "taxon").alias("label")), "sequence_id")
        model, _ = models.train_rf(written(models.as_vector(e).select("sequence_id", "features", "label"), "training"), trees=20)
        known = reads.select(F.concat(F.lit("k__"), "taxon").alias("label"), F.upper("taxon").alias("kingdom")).distinct()
        models.save_bundle(models.Bundle(model, clean.fill_ranks(known)), place)
        streams.classify_stream(streams.read_fasta_stream(spark, path, files), streams.bundle_classifier(models.load_bundle(spark, place)), out, shared_path(spark, "state"), shared_path(spark, "rejects")).awaitTermination()
    return spark.read.parquet(f"{out}/batch=*")


@query("s2_fold_updates", "SELECT run_id, arg_max(status, (ts, seq)) FILTER (status IS NOT NULL) AS status, CAST(CASE WHEN count(progress) > 0 THEN least(greatest(arg_max(progress, (ts, seq)) FILTER (progress IS NOT NULL), 0), 100) END AS INT) AS progress, arg_max(message, (ts, seq)) FILTER (message IS NOT NULL) AS message, max(ts) FILTER (status IN ('completed', 'failed')) AS end_time, count(*) AS updates FROM v_updates GROUP BY run_id")
def s2(spark, d):
    return runs.fold_updates(v.v_updates(spark, d))


STEP = "CASE WHEN seq % 3 > 0 THEN 'step' || (seq % 3) END AS step, CASE WHEN seq % 5 < 2 THEN 'state' || (seq % 7) END AS step_status"


@query("s2_update_stream", f"WITH u AS (SELECT *, {STEP} FROM v_updates), e AS (SELECT run_id, coalesce(step, 'step0') AS step, arg_max(step_status, (ts, seq)) AS s FROM u WHERE step_status IS NOT NULL GROUP BY ALL), t AS (SELECT run_id, string_agg(step || '=' || s, ',' ORDER BY step) AS steps FROM e GROUP BY run_id) SELECT run_id, arg_max(status, (ts, seq)) FILTER (status IS NOT NULL) AS status, CAST(CASE WHEN count(progress) > 0 THEN least(greatest(arg_max(progress, (ts, seq)) FILTER (progress IS NOT NULL), 0), 100) END AS INT) AS progress, arg_max(message, (ts, seq)) FILTER (message IS NOT NULL) AS message, max(ts) FILTER (status IN ('completed', 'failed')) AS end_time, count(*) AS updates, any_value(coalesce(steps, '')) AS steps FROM u LEFT JOIN t USING (run_id) GROUP BY run_id")
def s2_stream(spark, d):
    """The updates as a stream of four batches, dealt by hash, so that they arrive in no order of time."""
    path, out = shared_path(spark, "updates"), shared_path(spark, "states")
    k = F.col("seq")
    rows = v.v_updates(spark, d).withColumns({"step": F.when(k % 3 > 0, F.concat(F.lit("step"), (k % 3).cast("string"))), "step_status": F.when(k % 5 < 2, F.concat(F.lit("state"), (k % 7).cast("string")))})
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))  # of each batch, so that there are four however large the table is
    for i in range(4):
        rows.where(F.pmod(F.xxhash64("seq"), F.lit(4)) == i).repartition(files).write.mode("append").parquet(path)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)
        streams.drain(streams.fold_stream(stream, "step0"), out, shared_path(spark, "state"), "update")
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    every = spark.read.schema("run_id long, status string, progress int, message string, end_time timestamp, updates long, steps string").parquet(f"{out}/batch=*")
    return every.groupBy("run_id").agg(F.max_by(F.struct(*every.columns), "updates").alias("r")).select("r.*")


@query("s3_log_windows", "SELECT date_trunc('hour', ts) AS start, upper(event_type) AS level, count(*) AS n FROM events WHERE event_id % 17 <> 0 GROUP BY ALL")
def s3(spark, d):
    path, out = shared_path(spark, "logs"), shared_path(spark, "counts")
    # lines in time order, so that none is late; without a separator a line has no time
    v.v_logs(spark, d).orderBy("event_id").select("line").write.text(path)
    lines = spark.readStream.text(path).withColumnRenamed("value", "line")
    streams.drain(streams.log_level_counts(lines, late="400 days"), out, shared_path(spark, "state"), "complete")
    return spark.read.schema("start timestamp, level string, n long").parquet(f"{out}/batch=*")
