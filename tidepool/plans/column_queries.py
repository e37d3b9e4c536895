"""Queries over column functions, filters and quality control."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import sequence as S
from ..functions import taxonomy as X
from ..operators import clean, features, lineage
from ..schema import RANKS
from . import views as v
from .registry import query

IUPAC = "'^[ACGTNRYSWKMBDHV]+$'"
COMPLEMENT = "translate(reverse(seq), 'ACGTRYKMBVDH', 'TGCAYRMKVBHD')"


@query("b1_truncate_seq", "SELECT read_id, seq[1:256] AS seq FROM v_reads")
def b1(spark, d):
    return v.v_reads(spark, d).select("read_id", S.truncate(F.col("seq"), 256).alias("seq"))


@query("b2_normalize_seq", "SELECT doc_id AS read_id, upper(trim(source || ' ' || lang || '  ')) AS seq FROM documents")
def b2(spark, d):
    return v.table(spark, d, "documents").select(F.col("doc_id").alias("read_id"), S.normalize(F.concat("source", F.lit(" "), "lang", F.lit("  "))).alias("seq"))


@query("b3_filter_iupac", f"SELECT read_id FROM v_reads WHERE regexp_matches(seq, {IUPAC})")
def b3(spark, d):
    return clean.filter_iupac(v.v_reads(spark, d)).select("read_id")


@query("b4_mask_ambiguous", "SELECT read_id, regexp_replace(seq, '[^ACGT]', 'N', 'g') AS seq FROM v_reads")
def b4(spark, d):
    return v.v_reads(spark, d).select("read_id", S.mask_ambiguous(F.col("seq")).alias("seq"))


@query("b5_filter_length", "SELECT read_id, len(seq) AS length FROM v_reads WHERE len(seq) BETWEEN 200 AND 2000")
def b5(spark, d):
    return clean.filter_length(v.v_reads(spark, d)).select("read_id", F.length("seq").cast("long").alias("length"))


@query("b6_drop_unknown", "SELECT read_id FROM v_reads WHERE taxon <> 'es'")
def b6(spark, d):
    rows = v.v_reads(spark, d).withColumn("species", F.when(F.col("taxon") == "es", "Unknown").otherwise(F.col("taxon")))
    return clean.drop_unknown(rows).select("read_id")


PARSED = "SELECT c_custkey AS id, replace(r_name, ' ', '_') AS kingdom, n_name AS phylum, c_mktsegment AS class, 'Unknown' AS \"order\", 'Unknown' AS family, 'Unknown' AS genus, 'Unknown' AS species FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query("b7_parse_taxonomy", PARSED)
def b7(spark, d):
    return lineage.with_ranks(v.v_tax_labels(spark, d), "label").select("id", *RANKS)


@query("b8_split_binomial", "SELECT id, split_part(label, ' ', 1) AS genus, split_part(label, ' ', 1) || ' ' || split_part(label, ' ', 2) AS species, 'Bacteria' AS kingdom FROM v_class")
def b8(spark, d):
    return v.v_class(spark, d).select("id", X.split_binomial(F.col("label")).alias("t")).select("id", "t.genus", "t.species", "t.kingdom")


@query("b9_mask_low_confidence", "SELECT sequence_id, confidence, predicted_label, CASE WHEN confidence / 100 < 0.12 THEN 'Unknown' ELSE genus END AS genus FROM v_rows")
def b9(spark, d):
    rows = v.v_rows(spark, d).withColumn("c", F.col("confidence") / 100)
    return lineage.mask_low_confidence(rows, 0.12, "c").select("sequence_id", "confidence", "predicted_label", "genus")


@query("b10_scale_confidence", "SELECT sequence_id, round(confidence * 100, 2) AS confidence FROM v_pred")
def b10(spark, d):
    return v.v_pred(spark, d).select("sequence_id", N.scale_confidence(F.col("confidence")).alias("confidence"))


@query("b11_safe_cast", "SELECT id, coalesce(try_cast(t AS DOUBLE), 0.0) AS as_float, CASE WHEN regexp_matches(t, '^[+-]?[0-9]+$') THEN coalesce(try_cast(t AS BIGINT), 0) ELSE 0 END AS as_int FROM (SELECT id, split_part(line, chr(9), 2) AS t FROM v_tsv)")
def b11(spark, d):
    t = F.get(F.split("line", "\t"), F.lit(1))
    return v.v_tsv(spark, d).select("id", N.safe_float(t).alias("as_float"), N.safe_int(t).alias("as_int"))


@query("b12_apply_label_taxonomy", "SELECT id, CASE WHEN s = 'BUILDING' AND id % 3 = 1 THEN 'Known' ELSE r END AS kingdom FROM (SELECT c_custkey AS id, c_mktsegment AS s, replace(r_name, ' ', '_') AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)")
def b12(spark, d):
    n, r = v.table(spark, d, "nation"), v.table(spark, d, "region")
    known = n.join(r, n.n_regionkey == r.r_regionkey).select(F.concat_ws(";", F.translate("r_name", " ", "_"), "n_name", F.lit("BUILDING")).alias("label"), *[F.lit("Known").alias(x) for x in RANKS])
    return lineage.apply_label_taxonomy(v.v_tax_labels(spark, d), known, "label").select("id", "kingdom")


@query("b13_fill_ranks", "SELECT id, 'Unknown' AS kingdom, coalesce(CASE WHEN id % 3 > 0 THEN label END, 'Unknown') AS genus FROM v_class")
def b13(spark, d):
    rows = v.v_class(spark, d).select("id", F.when(F.col("id") % 3 > 0, F.col("label")).alias("genus"))
    return clean.fill_ranks(rows).select("id", "kingdom", "genus")


@query("b14_otu_label", "SELECT sequence_id, printf('OTU-%03d', cluster + 1) AS otu FROM v_pred")
def b14(spark, d):
    return v.v_pred(spark, d).select("sequence_id", X.otu_label(F.col("cluster")).alias("otu"))


@query("b15_normalize_status", "SELECT sample_id, CASE WHEN sample_id % 4 = 0 THEN CASE WHEN success THEN 'completed' ELSE 'failed' END ELSE status END AS status, CASE WHEN sample_id % 4 = 1 THEN 'failed' ELSE status END AS strict FROM v_runs")
def b15(spark, d):
    k = F.col("sample_id") % 4
    return v.v_runs(spark, d).select("sample_id", N.normalize_status(F.when(k != 0, F.col("status")), F.col("success")).alias("status"), N.strict_status(F.when(k == 1, "odd").otherwise(F.col("status"))).alias("strict"))


@query("b16_progress", "SELECT event_id, CAST(least(greatest(CAST(trunc(value) AS INT), 0), 100) AS INT) AS progress, CAST(least(100, 20 + floor(75 * (event_id % 50) / 50)) AS INT) AS pct FROM events")
def b16(spark, d):
    return v.table(spark, d, "events").select("event_id", N.progress(F.col("value")).alias("progress"), N.progress_pct(F.col("event_id") % 50, F.lit(50)).alias("pct"))


@query("b17_percent_text", "SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN '0.0%' ELSE printf('%.1f', round(p_size * 100.0 / 64, 1)) || '%' END AS percent, CASE WHEN p_size % 5 = 0 THEN 2.0 ELSE least(100.0, greatest(2.0, p_size * 100.0 / 64)) END AS width FROM part")
def b17(spark, d):
    total = F.when(F.col("p_size") % 5 == 0, 0).otherwise(64)
    return v.table(spark, d, "part").select(F.col("p_partkey").alias("id"), N.percent_text(F.col("p_size"), total).alias("percent"), N.bar_width(F.col("p_size"), total).cast("double").alias("width"))


@query("b18_clean_reference_taxonomy", "SELECT id, replace(taxonomy, ' ', '_') AS taxonomy FROM (SELECT c_custkey AS id, CASE WHEN n_name IN ('NATION_3', 'NATION_7') THEN r_name || ';' ELSE r_name || ';' || n_name || ';' END || c_mktsegment || ';' AS taxonomy FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)")
def b18(spark, d):
    c, n, r = (v.table(spark, d, t) for t in ("customer", "nation", "region"))
    raw = F.concat(F.lit("x\t1 Root;"), "r_name", F.lit(';"'), "n_name", F.lit('";'), "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, ";Some incertae sedis").otherwise(""))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("c_custkey").alias("id"), raw.alias("label"))
    levels = n.where(F.col("n_nationkey").isin(3, 7)).select(F.col("n_name").alias("name"))
    return lineage.clean_reference_taxonomy(rows, levels)


@query("b19_reverse_complement", f"SELECT read_id, {COMPLEMENT} AS seq FROM v_reads")
def b19(spark, d):
    return v.v_reads(spark, d).select("read_id", S.reverse_complement(F.col("seq")).alias("seq"))


@query("b20_decode_logits", "SELECT sequence_id, 'class_' || (arg_max(i, (x, -i)) - 1) AS label, round(1 / sum(exp(x - m)), 6) AS p FROM (SELECT *, max(x) OVER (PARTITION BY sequence_id) AS m FROM v_flat) GROUP BY sequence_id")
def b20(spark, d):
    return v.v_emb(spark, d).select("sequence_id", F.concat(F.lit("class_"), N.argmax(F.col("embedding"))).alias("label"), F.round(F.array_max(N.softmax(F.col("embedding"))), 6).alias("p"))


@query("b21_top_k_labels", "SELECT sequence_id, string_agg('class_' || (i - 1), ',' ORDER BY x DESC, i) AS top FROM (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY x DESC, i) AS r FROM v_flat) WHERE r <= 3 GROUP BY sequence_id")
def b21(spark, d):
    labels = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.concat(F.lit("class_"), i))
    return v.v_emb(spark, d).select("sequence_id", labels.alias("l"), "embedding").select("sequence_id", F.array_join(F.transform(N.top_k(F.col("l"), F.col("embedding"), 3), lambda x: x["label"]), ",").alias("top"))


@query("b22_one_hot", "SELECT read_id, len(seq) AS bases, " + ", ".join(f"len(regexp_replace(seq, '[^{x}]', '', 'g')) AS {x.lower()}" for x in "ACGT") + ", md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(seq, 'A', '1000', 'g'), 'C', '0100', 'g'), 'G', '0010', 'g'), 'T', '0001', 'g'), '[^01]', '0000', 'g')) AS bits FROM v_reads")
def b22(spark, d):
    x = v.v_reads(spark, d).select("read_id", S.one_hot_digest()("seq").alias("x"))
    return x.select("read_id", "x.*")


@query("b23_flag_novel", "SELECT sequence_id, sequence_id % 2 = 0 AND confidence < 12 AS novel FROM v_rows")
def b23(spark, d):
    from ..operators.summary import flag_novel

    rows = v.v_rows(spark, d).withColumn("method", F.when(F.col("sequence_id") % 2 == 0, "consensus").otherwise("single"))
    return flag_novel(rows, 12.0).select("sequence_id", "novel")


MEAN_Q = "(40 * len(regexp_replace(seq, '[^A]', '', 'g')) + 39 * len(regexp_replace(seq, '[^C]', '', 'g')) + 38 * len(regexp_replace(seq, '[^G]', '', 'g')) + 37 * len(regexp_replace(seq, '[^T]', '', 'g')) + 2 * len(regexp_replace(seq, '[^N]', '', 'g')) + 10 * len(regexp_replace(seq, '[^R]', '', 'g')) + 20 * len(regexp_replace(seq, '[^Y]', '', 'g')))"


@query("q1_filter_quality", f"SELECT read_id, round(CAST({MEAN_Q} AS DOUBLE) / len(seq), 6) AS q FROM v_reads WHERE len(seq) > 0 AND CAST({MEAN_Q} AS DOUBLE) / len(seq) >= 36")
def q1(spark, d):
    return clean.filter_quality(v.v_reads_q(spark, d), 36, out="q").select("read_id", F.round("q", 6).alias("q"))


@query("q2_filter_expected_errors", "SELECT read_id FROM v_reads WHERE len(regexp_replace(seq, '[^A]', '', 'g')) * pow(10, -4.0) + len(regexp_replace(seq, '[^C]', '', 'g')) * pow(10, -3.9) + len(regexp_replace(seq, '[^G]', '', 'g')) * pow(10, -3.8) + len(regexp_replace(seq, '[^T]', '', 'g')) * pow(10, -3.7) + len(regexp_replace(seq, '[^N]', '', 'g')) * pow(10, -0.2) + len(regexp_replace(seq, '[^R]', '', 'g')) * pow(10, -1.0) + len(regexp_replace(seq, '[^Y]', '', 'g')) * 0.01 + len(regexp_replace(seq, '[^-]', '', 'g')) * 1.0 <= 20.05")
def q2(spark, d):
    return clean.filter_expected_errors(v.v_reads_q(spark, d), 20.05).select("read_id")


@query("q3_trim_primer", "SELECT read_id, regexp_matches(seq, '^[ACGT]T[CT]') AS trimmed, CASE WHEN regexp_matches(seq, '^[ACGT]T[CT]') THEN substr(seq, 4) ELSE seq END AS seq, CASE WHEN regexp_matches(seq, '^[ACGT]T[CT]') THEN substr(quality, 4) ELSE quality END AS quality FROM v_reads_q")
def q3(spark, d):
    return clean.trim_primer(v.v_reads_q(spark, d), "NTY").select("read_id", "trimmed", "seq", "quality")


@query("q4_drop_ambiguous", "SELECT read_id FROM v_reads WHERE regexp_matches(seq, '^[ACGT]+$')")
def q4(spark, d):
    return clean.drop_ambiguous(v.v_reads(spark, d)).select("read_id")


@query("q5_merge_pairs", "WITH h AS (SELECT sample_id, read_id, seq[1 : len(seq) // 2 + 15] AS a, substr(seq, len(seq) // 2 - 14) AS b FROM v_reads WHERE len(seq) >= 90 AND regexp_matches(seq, '^[ACGT]+$')), o AS (SELECT *, CAST(list_max(list_filter(generate_series(10, least(len(a), len(b))), lambda n: right(a, n) = left(b, n))) AS INT) AS overlap FROM h) SELECT sample_id, read_id, overlap, a || substr(b, overlap + 1) AS seq FROM o")
def q5(spark, d):
    reads = clean.drop_ambiguous(v.v_reads(spark, d)).where(F.length("seq") >= 90)
    half = F.floor(F.length("seq") / 2).cast("int") + 15
    forward = reads.select("sample_id", "read_id", F.expr("seq").substr(F.lit(1), half).alias("seq"))
    reverse = reads.select("sample_id", "read_id", S.reverse_complement(F.expr("seq").substr(half - 29, F.length("seq"))).alias("seq"))
    return clean.merge_pairs(forward, reverse, 10)


@query("q6_dereplicate", "SELECT sample_id, seq, count(*) AS n FROM v_reads GROUP BY ALL HAVING count(*) >= 2")
def q6(spark, d):
    return clean.dereplicate(v.v_reads(spark, d), 2)


UNIQUES = "SELECT c_mktsegment AS sample_id, seq, count(*) AS n FROM (SELECT c_mktsegment, translate(c_custkey % 100 || 'abcdefgh' || c_custkey % 3, '0123456789abcdefgh', 'ACGTACGTACGGTTACCA') AS seq FROM customer) GROUP BY ALL"


def uniques(spark, d):
    """Short sequences in which many differ in one place."""
    k = F.col("c_custkey")
    seq = F.translate(F.concat((k % 100).cast("string"), F.lit("abcdefgh"), (k % 3).cast("string")), "0123456789abcdefgh", "ACGTACGTACGGTTACCA")
    return clean.dereplicate(v.table(spark, d, "customer").select(F.col("c_mktsegment").alias("sample_id"), seq.alias("seq")))


@query("q7_denoise", f"""
WITH u AS ({UNIQUES}),
p AS (SELECT a.sample_id, a.seq, b.seq AS parent, b.n AS pn, levenshtein(a.seq, b.seq) AS dist FROM u a JOIN u b ON a.sample_id = b.sample_id AND b.n > a.n AND a.seq <> b.seq WHERE levenshtein(a.seq, b.seq) <= 2 AND a.n / b.n <= pow(2.0, -(levenshtein(a.seq, b.seq) * 0.1 + 0.1))),
best AS (SELECT sample_id, seq, arg_min(parent, (-pn, dist, parent)) AS into_ FROM p GROUP BY ALL)
SELECT u.sample_id, coalesce(into_, u.seq) AS seq, CAST(sum(n) AS BIGINT) AS n FROM u LEFT JOIN best ON u.sample_id = best.sample_id AND u.seq = best.seq GROUP BY ALL""")
def q7(spark, d):
    # gentle skew bounds, so that the small counts of this view have parents
    u = uniques(spark, d)
    return clean.denoise(u, 0.1, 0.1, 2)


@query("q7_denoise_words", """
WITH u AS (SELECT sample_id, seq, count(*) AS n FROM v_words GROUP BY ALL),
p AS (SELECT a.sample_id, a.seq, b.seq AS parent, b.n AS pn, levenshtein(a.seq, b.seq) AS dist, a.n AS n FROM u a JOIN u b ON a.sample_id = b.sample_id AND b.n >= 8 * a.n AND abs(len(a.seq) - len(b.seq)) < log2(b.n / a.n) / 2),
best AS (SELECT sample_id, seq, arg_min(parent, (-pn, dist, parent)) AS into_ FROM p WHERE dist > 0 AND n / pn <= pow(2.0, -(dist * 2 + 1)) GROUP BY ALL)
SELECT u.sample_id, coalesce(into_, u.seq) AS seq, CAST(sum(n) AS BIGINT) AS n FROM u LEFT JOIN best ON u.sample_id = best.sample_id AND u.seq = best.seq GROUP BY ALL""")
def q7b(spark, d):
    return clean.denoise(clean.dereplicate(v.v_words(spark, d)))


@query("q5_merge_stats", "WITH h AS (SELECT sample_id, seq[1 : len(seq) // 2 + 5] AS a, substr(seq, len(seq) // 2 - CASE WHEN read_id % 3 = 0 THEN -9 ELSE 4 END) AS b FROM v_reads WHERE len(seq) >= 90 AND regexp_matches(seq, '^[ACGT]+$')), o AS (SELECT *, coalesce(list_max(list_filter(generate_series(10, least(len(a), len(b))), lambda n: right(a, n) = left(b, n))), 0) AS overlap FROM h) SELECT sample_id, count(*) AS pairs, count(*) FILTER (overlap > 0) AS merged, round(100.0 * count(*) FILTER (overlap > 0) / count(*), 2) AS rate, round(coalesce(avg(overlap) FILTER (overlap > 0), 0), 4) AS mean_overlap FROM o GROUP BY sample_id")
def q5b(spark, d):
    reads = clean.drop_ambiguous(v.v_reads(spark, d)).where(F.length("seq") >= 90)
    half = F.floor(F.length("seq") / 2).cast("int")
    begin = half - F.when(F.col("read_id") % 3 == 0, -9).otherwise(4)  # every third pair doesn't overlap
    forward = reads.select("sample_id", "read_id", F.expr("seq").substr(F.lit(1), half + 5).alias("seq"))
    reverse = reads.select("sample_id", "read_id", S.reverse_complement(F.expr("seq").substr(begin, F.length("seq"))).alias("seq"))
    return clean.merge_stats(clean.merge_pairs(forward, reverse, 10))


@query("q8_chimeras_words", """
WITH u AS (SELECT sample_id, seq, count(*) AS n FROM v_words GROUP BY ALL HAVING count(*) >= 4),
c AS (SELECT a.sample_id, a.seq, list_max(list_filter(generate_series(0, least(len(a.seq), len(b.seq))), lambda x: left(a.seq, x) = left(b.seq, x))) AS lcp, list_max(list_filter(generate_series(0, least(len(a.seq), len(b.seq))), lambda x: right(a.seq, x) = right(b.seq, x))) AS lcs FROM u a JOIN u b ON a.sample_id = b.sample_id AND b.n >= 2 * a.n AND a.seq <> b.seq),
m AS (SELECT sample_id, seq FROM c GROUP BY sample_id, seq HAVING max(lcp) + max(lcs) >= len(seq))
SELECT u.sample_id, u.seq, u.n, m.seq IS NOT NULL AS chimera FROM u LEFT JOIN m ON u.sample_id = m.sample_id AND u.seq = m.seq""")
def q8b(spark, d):
    return clean.chimeras(clean.dereplicate(v.v_words(spark, d), 4))


@query("q8_chimeras", f"""
WITH u AS ({UNIQUES}),
c AS (SELECT a.sample_id, a.seq, a.n, list_max(list_filter(generate_series(0, least(len(a.seq), len(b.seq))), lambda x: left(a.seq, x) = left(b.seq, x))) AS lcp, list_max(list_filter(generate_series(0, least(len(a.seq), len(b.seq))), lambda x: right(a.seq, x) = right(b.seq, x))) AS lcs FROM u a JOIN u b ON a.sample_id = b.sample_id AND b.n >= 1.05 * a.n AND a.seq <> b.seq),
m AS (SELECT sample_id, seq FROM c GROUP BY sample_id, seq HAVING max(lcp) + max(lcs) >= len(seq))
SELECT u.sample_id, u.seq, u.n, m.seq IS NOT NULL AS chimera FROM u LEFT JOIN m ON u.sample_id = m.sample_id AND u.seq = m.seq""")
def q8(spark, d):
    return clean.chimeras(uniques(spark, d), 1.05)


@query("q9_retention_stats", f"WITH s AS (SELECT 'input' AS stage, seq FROM v_reads UNION ALL SELECT 'iupac', seq FROM v_reads WHERE regexp_matches(seq, {IUPAC}) UNION ALL SELECT 'length', seq FROM v_reads WHERE regexp_matches(seq, {IUPAC}) AND len(seq) BETWEEN 200 AND 2000) SELECT stage, count(*) AS n, count(DISTINCT seq) AS uniques, round(100.0 * count(*) / (SELECT count(*) FROM v_reads), 2) AS rate FROM s GROUP BY stage")
def q9(spark, d):
    r = v.v_reads(spark, d)
    a = clean.filter_iupac(r)
    return clean.retention_stats([("input", r), ("iupac", a), ("length", clean.filter_length(a))])


@query("q10_dedup_first", "SELECT min(read_id) AS read_id, seq FROM v_reads GROUP BY seq")
def q10(spark, d):
    return clean.dedup_first(v.v_reads(spark, d).select("read_id", "seq"), "seq", "read_id")


@query("q10_cleaning_reasons", f"SELECT CASE WHEN taxon = 'es' THEN 'unknown' WHEN NOT regexp_matches(seq, {IUPAC}) THEN 'iupac' WHEN len(seq) NOT BETWEEN 200 AND 2000 THEN 'length' ELSE 'kept' END AS step, count(*) AS n FROM v_reads GROUP BY ALL")
def q10b(spark, d):
    rows = v.v_reads(spark, d).withColumn("species", F.when(F.col("taxon") == "es", "Unknown").otherwise(F.col("taxon")))
    return clean.cleaning_reasons(rows).groupBy(F.coalesce("dropped_by", F.lit("kept")).alias("step")).agg(F.count("*").alias("n"))


KMER = "SELECT read_id, sample_id, k, substr(seq, i, k) AS kmer FROM (SELECT *, unnest(generate_series(1, len(seq) - k + 1)) AS i FROM v_reads, (VALUES (3), (4), (5), (6)) AS ks(k) WHERE len(seq) >= k)"


@query("f1_kmer_counts", f"SELECT sample_id, k, kmer, count(*) AS n FROM ({KMER}) WHERE regexp_matches(kmer, '^[ACGT]+$') GROUP BY ALL")
def f1(spark, d):
    return features.kmer_counts(v.v_reads(spark, d), group=("sample_id",))


PLACE = "CAST(0 {} AS INT)".format(" ".join(f"+ {4 ** (2 - i)} * (strpos('ACGT', kmer[{i + 1}]) - 1)" for i in range(3)))


@query("f2_kmer_vector", f"SELECT read_id, {PLACE} AS place, round(count(*) / sum(count(*)) OVER (PARTITION BY read_id), 6) AS share FROM ({KMER}) WHERE k = 3 AND regexp_matches(kmer, '^[ACGT]+$') GROUP BY read_id, kmer")
def f2(spark, d):
    from pyspark.ml.functions import vector_to_array

    x = features.kmer_vector(v.v_reads(spark, d), 3).select("read_id", F.posexplode(vector_to_array("features")).alias("place", "share"))
    return x.where("share > 0").select("read_id", "place", F.round("share", 6).alias("share"))


PAIRS = [a + b for a in "ACGT" for b in "ACGT"]


@query("f3_composition", f"WITH p AS (SELECT read_id, count(*) AS n, {', '.join(f"count(*) FILTER (kmer = '{w}') AS n_{w}" for w in PAIRS)} FROM (SELECT read_id, substr(seq, i, 2) AS kmer FROM (SELECT *, unnest(generate_series(1, len(seq) - 1)) AS i FROM v_reads)) WHERE regexp_matches(kmer, '^[ACGT]+$') GROUP BY read_id) SELECT read_id, len(seq) AS length, round(CASE WHEN len(regexp_replace(seq, '[^ACGT]', '', 'g')) > 0 THEN len(regexp_replace(seq, '[^GC]', '', 'g')) / len(regexp_replace(seq, '[^ACGT]', '', 'g')) ELSE 0 END, 6) AS gc, {', '.join(f'round(coalesce(n_{w} / n, 0), 6) AS f_{w.lower()}' for w in PAIRS)} FROM v_reads LEFT JOIN p USING (read_id)")
def f3(spark, d):
    c = features.composition(v.v_reads(spark, d))
    return c.select("read_id", F.col("length").cast("long").alias("length"), F.round("gc", 6).alias("gc"), *[f"f_{w.lower()}" for w in PAIRS])


@query("f4_kmer_word2vec")
def f4(spark, d):
    from pyspark.ml.functions import vector_to_array

    return features.kmer_word2vec(v.v_reads(spark, d)).select("read_id", vector_to_array("features").alias("embedding"))


@query("f5_scale_features", "SELECT sequence_id, CAST(i - 1 AS INT) AS place, round((x - m) / s, 4) + 0.0 AS scaled FROM v_flat JOIN (SELECT i, avg(x) AS m, stddev_samp(x) AS s FROM v_flat GROUP BY i) USING (i)")
def f5(spark, d):
    from pyspark.ml.functions import vector_to_array

    s = features.scale_features(features.as_vector(v.v_emb(spark, d)))
    return s.select("sequence_id", F.posexplode(vector_to_array("scaled")).alias("place", "x")).select("sequence_id", "place", (F.round("x", 4) + 0.0).alias("scaled"))


@query("f6_select_features")
def f6(spark, d):
    from pyspark.ml.functions import vector_to_array

    s = features.select_features(features.as_vector(v.v_emb(spark, d)), 10)
    return s.select("sequence_id", vector_to_array("selected").alias("selected"))


@query("f7_reduce_dims")
def f7(spark, d):
    from pyspark.ml.functions import vector_to_array

    r = features.reduce_dims(features.as_vector(v.v_emb(spark, d)), 2)
    return r.select("sequence_id", vector_to_array("reduced").alias("xy"))


@query("f8_mean_pool", "SELECT CAST(label AS BIGINT) AS sequence_id, round(avg(x), 6) AS first FROM v_flat WHERE i = 1 AND sequence_id % 3 > 0 GROUP BY label")
def f8(spark, d):
    tokens = v.v_emb(spark, d).select(F.col("label").cast("long").alias("sequence_id"), F.col("embedding").alias("vector"), (F.col("sequence_id") % 3 > 0).alias("mask"))
    return features.mean_pool(tokens).select("sequence_id", F.round(F.get("embedding", F.lit(0)), 6).alias("first"))


@query("f9_augment_revcomp", f"SELECT read_id, seq, false AS reversed FROM v_reads UNION ALL SELECT read_id, {COMPLEMENT}, true FROM v_reads")
def f9(spark, d):
    return features.augment_revcomp(v.v_reads(spark, d).select("read_id", "seq"))
