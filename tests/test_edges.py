"""Hand-made edge tables."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool import storage
from tidepool.functions import numbers as N
from tidepool.functions import sequence as S
from tidepool.functions.taxonomy import parse_taxonomy
from tidepool.operators import balance, clean, diversity, evaluate, features, lineage, models, runs, summary
from tidepool.schema import RANKS, UNKNOWN
from tidepool.sources import filter_inputs, label_from_header, parse_logs, parse_sequence_tsv, read_fasta, read_fastq, read_manifest, read_taxdump


def test_labels(spark):
    cases = {
        "": {}, None: {}, "  ;; ": {}, "k__": {"kingdom": UNKNOWN}, "d__X;p__Y": {"kingdom": "X", "phylum": "Y"}, "A;;B": {"kingdom": "A", "phylum": "B"},
        "a;b;c;d;e;f;g;h;i": dict(zip(RANKS, "abcdefg", strict=True)), "p__X;A": {"kingdom": "A", "phylum": "X"}, "k__X;A": {"kingdom": "A"}, "K__X;S__Y z": {"kingdom": "X", "species": "Y z"},
        "A B\tC": {"kingdom": "A", "phylum": "B", "class": "C"}, "g__A;g__B": {"genus": "B"}, "p__a__b": {"phylum": "a__b"}, "Root;Bacteria;\"Actino\"": {"kingdom": "Root", "phylum": "Bacteria", "class": '"Actino"'},
    }
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, label string")
    got = {r.i: r.t.asDict() for r in rows.select("i", parse_taxonomy(F.col("label")).alias("t")).collect()}
    for i, want in enumerate(cases.values()):
        assert got[i] == {r: want.get(r, UNKNOWN) for r in RANKS}


def test_confidence_bins_and_mask(spark):
    c = [0.0, 39.99, 40.0, 60.0, 80.0, 90.0, 100.0, math.nan, None, -1.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(c)], "sequence_id int, confidence double")
    assert {r.bin: r.n for r in summary.confidence_histogram(df).collect()} == {"0-40": 4, "40-60": 1, "60-80": 1, "80-90": 1, "90-100": 3}
    assert {r.bin: r.n for r in summary.confidence_histogram(df.limit(0)).collect()} == dict.fromkeys(summary.BINS, 0)
    assert summary.confidence_stats(df.limit(0)).first().mean_confidence == 0.0
    row = spark.createDataFrame([(0.5, *"abcdefg"), (0.4999, *"abcdefg")], ["confidence", *RANKS])
    assert [r.kingdom for r in lineage.mask_low_confidence(row, 0.5).orderBy(F.desc("confidence")).collect()] == ["a", UNKNOWN]
    assert lineage.mask_low_confidence(row, 7.0).where(f"species <> '{UNKNOWN}'").isEmpty()


def test_lineage_cycles_and_repeats(spark):
    nodes = spark.createDataFrame([(1, 1, "no rank"), (2, 1, "superkingdom"), (3, 2, "phylum"), (4, 3, "phylum"), (5, 4, "species"), (8, 9, "genus"), (9, 8, "family")], "taxid int, parent int, rank string")
    names = spark.createDataFrame([(2, "Bacteria"), (3, "near root"), (4, "far"), (8, "g"), (9, "f")], "taxid int, name string")
    got = {r.taxid: r for r in lineage.resolve_lineage(spark.createDataFrame([(5,), (8,), (77,), (5,)], "taxid int"), nodes, names).collect()}
    assert (got[5].kingdom, got[5].phylum, got[5].species) == ("Bacteria", "near root", UNKNOWN)
    assert (got[8].genus, got[8].family) == ("g", "f")
    assert got[77].kingdom == UNKNOWN
    assert len(got) == 3


def test_deep_lineages(spark):
    n = 90
    nodes = spark.createDataFrame([(0, 0, "no rank"), (1, 0, "superkingdom"), *[(i, i - 1, "genus" if i == n else "clade") for i in range(2, n + 1)]], "taxid int, parent int, rank string")
    names = spark.createDataFrame([(i, f"n{i}") for i in range(n + 1)], "taxid int, name string")
    r = lineage.resolve_lineage(spark.createDataFrame([(n,)], "taxid int"), nodes, names).first()
    assert (r.kingdom, r.genus, r.species) == ("n1", f"n{n}", UNKNOWN)


def test_farther_parents(spark):
    """A parent at distance 4 counts if it is 2^9 times as abundant; short sequences have parents too."""
    a = "ACGTACGTACGTACGTACGT"
    far, too_far = "TCGTTCGTTCGTTCGTACGT", "TCGTTCGTTCGTTCGTTCGT"
    rows = [("s", a, 600), ("s", far, 1), ("s", too_far, 1), ("s", "AC", 80), ("s", "A", 2), ("t", far, 1)]
    got = {(r.sample_id, r.seq): r.n for r in clean.denoise(spark.createDataFrame(rows, "sample_id string, seq string, n long")).collect()}
    assert got == {("s", a): 601, ("s", too_far): 1, ("s", "AC"): 82, ("t", far): 1}


def test_forest_is_saved_and_loaded(spark, tmp_path):
    """Train, save, load, predict; the same rows from both models."""
    seqs = [("ACGT" * 20, "k__A;p__B"), ("AAAA" * 20, "k__A;p__C")] * 6
    df = spark.createDataFrame([(i, s, x) for i, (s, x) in enumerate(seqs)], "sequence_id int, seq string, label string")
    model, metrics = models.train_kmer_rf(df, 3)
    assert metrics["num_samples"] == 12 and metrics["accuracy"] == 1.0 and metrics["macro_f1"] == 1.0
    models.save_model(model, str(tmp_path / "rf"))
    again = models.load_model(str(tmp_path / "rf"))
    assert again.stages[2].getNumTrees == model.stages[2].getNumTrees == 50
    a, b = (models.predict_kmer_rf(df.drop("label"), m, 3).orderBy("sequence_id").collect() for m in (model, again))
    assert a == b and {r.method for r in a} == {"random_forest_kmer"} and [r.phylum for r in a[:2]] == ["B", "C"] and all(0 <= r.confidence_score <= 1 for r in a)
    rows = models.kmer_vector(df, 3)
    got = models.classify_supervised(rows, again, threshold=0.0).collect()
    assert {(r.sequence_id, r.predicted_label) for r in got} == {(i, x) for i, (_, x) in enumerate(seqs)} and {r.method for r in got} == {"supervised_taxonomy"}


def test_clusters_are_the_best_of_all_restarts(spark):
    """Three far groups come out as they are, by size, with confidences as a loop gives them."""
    rng = np.random.default_rng(5)
    x = np.concatenate([c + 0.05 * rng.normal(size=(n, 2)) for c, n in (((0, 0), 9), ((9, 9), 6), ((0, 9), 3))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sequence_id int, embedding array<double>")
    got = {r.sequence_id: r for r in models.otu_cluster(rows).collect()}
    names = [got[i].genus for i in range(18)]
    assert names == ["OTU-001"] * 9 + ["OTU-002"] * 6 + ["OTU-003"] * 3 and {r.method for r in got.values()} == {"embedding_kmeans_fallback"}
    centers = [x[:9].mean(0), x[9:15].mean(0), x[15:].mean(0)]
    for i in range(18):
        e = [math.exp(-math.dist(x[i], c)) for c in centers]
        assert abs(got[i].confidence - 100 * max(e) / sum(e)) < 0.011


def test_ranks_of_large_classes(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(3000)], "id int, label string")
    got = {(r.label, r._r): r.id for r in balance.ranked(df, 42, "label", "id").collect()}
    for label in "ab":
        own = sorted((hashlib.md5(f"42|{i}".encode()).hexdigest(), i) for i in range(3000) if (i % 3 > 0) == (label == "a"))
        assert [got[label, k + 1] for k in range(len(own))] == [i for _, i in own]


def test_scratch_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_path", lambda spark, tag: f"file://{tmp_path}/{tag}")
    with storage.scratch():
        storage.written(spark.range(3), "gone")
        left = storage.kept(spark.range(5), "left")
        assert len(list(tmp_path.iterdir())) == 2
    assert [p.name for p in tmp_path.iterdir()] == ["left"] and left.count() == 5


def test_shared_folder():
    class Session:
        def __init__(self, master, root=None):
            self.sparkContext, self.conf = type("C", (), {"master": master}), {"spark.checkpoint.dir": root} if root else {}

    assert storage.shared_path(Session("spark://x", "hdfs://shared/"), "t").startswith("hdfs://shared/t-")
    assert storage.shared_path(Session("local[2]"), "t").startswith("file:///")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_path(Session("spark://x"), "t")


def test_samples_of_files(spark):
    reads = spark.createDataFrame([("r1", "file:/a/x.fq"), ("r2", "/b/y.fq"), ("r3", "z.fq")], "read_id string, file string")
    manifest = spark.createDataFrame([("s", "single", "data/x.fq"), ("p", "forward", "y.fq")], "sample_id string, mate string, path string")
    assert sorted((r.read_id, r.sample_id, r.mate) for r in lineage.attach_samples(reads, manifest).collect()) == [("r1", "s", "single"), ("r2", "p", "forward")]


def test_chimera_and_denoise(spark):
    a, b = "A" * 10 + "C" * 10, "G" * 10 + "T" * 10
    rows = [("s", a, 20), ("s", b, 20), ("s", a[:10] + b[10:], 10), ("s", a[:4] + b[4:], 11), ("s", b[:10] + a[10:], 9), ("t", a[:10] + b[10:], 1)]
    got = {(r.sample_id, r.seq): r.chimera for r in clean.chimeras(spark.createDataFrame(rows, "sample_id string, seq string, n long")).collect()}
    assert [got[x, y] for x, y, _ in rows] == [False, False, True, False, True, False]  # 10 is exactly half of 20
    one = a[:5] + "G" + a[6:]
    d = {(r.seq): r.n for r in clean.denoise(spark.createDataFrame([("s", a, 1000), ("s", one, 10), ("s", b, 3)], "sample_id string, seq string, n long")).collect()}
    assert d == {a: 1010, b: 3}


def test_diversity_edges(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("b", "z", 5), ("c", "x", 4), ("c", "y", 2)], "sample_id string, taxon string, n long")
    d = {r.sample_id: r for r in diversity.alpha_diversity(df).collect()}
    assert d["a"].chao1 == 3.0 and d["b"].pielou == 0.0 and d["b"].shannon == 0.0
    assert {(r.a, r.b): r.distance for r in diversity.bray_curtis(df).collect()} == {("a", "b"): 1.0, ("a", "c"): 0.5, ("b", "c"): 1.0}
    assert diversity.rarefy(df, 6).groupBy("sample_id").agg(F.sum("n").alias("n")).collect() == [("c", 6)]
    assert diversity.rarefaction_curve(df, [2]).where("sample_id = 'a'").first().richness == 2.0


def test_rarefying_without_a_bound_is_the_same(spark, monkeypatch):
    df = spark.createDataFrame([("a", f"t{i}", 40 + i) for i in range(20)] + [("b", "x", 700), ("c", "x", 30)], "sample_id string, taxon string, n long")
    got = sorted(map(tuple, diversity.rarefy(df, 300).collect()))
    assert sum(n for s, _, n in got if s == "a") == 300 and ("b", "x", 300) in got and "c" not in {s for s, *_ in got}
    monkeypatch.setattr(diversity, "SPARE", -1000)
    assert sorted(map(tuple, diversity.rarefy(df, 300).collect())) == got


def test_runs(spark):
    none = spark.createDataFrame([], "sample_id string, status string, success boolean, start_time timestamp, end_time timestamp, processing_time double, batch_id int")
    assert runs.dashboard_snapshot(none).first().success_rate == 0.0
    ids = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a-1"), (4, "a"), (5, "a-1"), (6, "b")], "at int, base_id string")
    got = {r.at: r.run_id for r in runs.uniquify_ids(ids).collect()}
    assert got == {1: "a", 2: "a-2", 3: "a-1", 4: "a-3", 5: "a-1-1", 6: "b"}
    status = spark.createDataFrame([(None, True), ("", False), ("queued", True)], "s string, k boolean").select(N.normalize_status(F.col("s"), F.col("k")))
    assert [r[0] for r in status.collect()] == ["completed", "failed", "queued"]


def test_cluster_counts_and_confidence(spark):
    assert [models.cluster_count(n) for n in (3, 25, 32, 14956)] == [2, 3, 4, 12]
    one = spark.createDataFrame([(1, [0.5, 0.5])], "sequence_id int, embedding array<double>")
    assert models.otu_cluster(one).first().asDict()["confidence"] == 100.0
    assert models.otu_cluster(one.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(4)], "cluster int, center array<double>")
    assert models.centroid_confidence(one, same).first().confidence == 0.25
    far = spark.createDataFrame([(i, [1e6, 0.0]) for i in range(4)], "cluster int, center array<double>")
    assert models.centroid_confidence(one, far).first().confidence == 0.0
    with pytest.raises(Exception, match="embedding table"):
        models.validate_embeddings(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "sequence_id int, embedding array<double>")).collect()


def test_files(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one  first\r\nACGT\r\nAC\r\n>two\tx y\nGG\n\n>three\nT")
    (tmp_path / "empty.fasta").write_text("")
    got = [(r.sequence_id, r.description, r.sequence) for r in read_fasta(spark, str(tmp_path / "a.fasta")).orderBy("at").collect()]
    assert got == [("one", "one  first", "ACGTAC"), ("two", "two\tx y", "GG"), ("three", "three", "T")]
    assert read_fasta(spark, str(tmp_path / "empty.fasta")).count() == 0
    (tmp_path / "a.fastq").write_text("@r1 x\r\nACGT\r\n+\r\n@III\r\n@r2\nGG\n+\n@@\n")
    assert [(r.read_id, r.sequence, r.quality) for r in read_fastq(spark, str(tmp_path / "a.fastq")).orderBy("at").collect()] == [("r1", "ACGT", "@III"), ("r2", "GG", "@@")]
    (tmp_path / "m.json").write_text('{"single": [{"sample_id": "s", "file": "f"}], "paired": [{"sample_id": "p", "forward": "a", "reverse": "b"}]}')
    assert sorted(map(tuple, read_manifest(spark, str(tmp_path / "m.json")).collect())) == [("p", "forward", "a"), ("p", "reverse", "b"), ("s", "single", "f")]
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tgenus\t|\n")
    (tmp_path / "names.dmp").write_text("2\t|\tXus\t|\t\t|\tscientific name\t|\n2\t|\tYus\t|\t\t|\tsynonym\t|\n")
    nodes, names = read_taxdump(spark, str(tmp_path))
    assert sorted(map(tuple, nodes.collect())) == [(1, 1, "no rank"), (2, 1, "genus")] and list(map(tuple, names.collect())) == [(2, "Xus")]
    paths = spark.createDataFrame([("a.FASTA",), ("b.fa.gz",), ("c.fq",), ("d.fasta.txt",)], "path string")
    assert filter_inputs(paths).count() == 2


def test_lines(spark):
    logs = spark.createDataFrame([("2024 - INFO - a - b",), ("plain",)], "line string")
    assert [(r.level, r.message) for r in parse_logs(logs).collect()] == [("INFO", "a - b"), ("INFO", "plain")]
    t = parse_sequence_tsv(spark.createDataFrame([("a\t1\tt\t" + "A" * 50,), ("a\t-1\tt\tA",), ("a\tq\tt\tA",), ("a\t1\tt",), ("a\t1\tt\tA\tB",)], "line string"))
    assert [r.reason for r in t.collect()] == [None, "zero_taxid", "invalid_taxid", "insufficient_columns", "very_short_seq"]
    h = spark.createDataFrame([("id\tA;B c",), ("id B c",), ("id",)], "d string").select(label_from_header(F.col("d")))
    assert [r[0] for r in h.collect()] == ["A;B c", "B c", "id"]


def test_sequences(spark):
    row = spark.createDataFrame([("ACGTNAC", "IIII#II"), ("", "")], "seq string, quality string")
    got = row.select(S.kmers(F.col("seq"), 2).alias("k"), S.reverse_complement(F.col("seq")).alias("r"), S.gc_fraction(F.col("seq")).alias("g"), S.mean_quality(F.col("quality")).alias("q")).collect()
    assert got[0].k == ["AC", "CG", "GT", "AC"] and got[0].r == "GTNACGT" and got[0].g == 0.5 and round(got[0].q, 3) == round((6 * 40 + 2) / 7, 3)
    assert got[1].k == [] and got[1].g == 0.0
    m = clean.merge_pairs(spark.createDataFrame([("s", 1, "AAACCCGGGT"), ("s", 2, "AAAA")], "sample_id string, read_id int, seq string"), spark.createDataFrame([("s", 1, "TTTACCCG"), ("s", 2, "CCCC")], "sample_id string, read_id int, seq string"), 4)
    assert sorted((r.read_id, r.overlap, r.seq) for r in m.collect()) == [(1, 5, "AAACCCGGGTAAA"), (2, 0, None)]


def test_balance(spark):
    df = spark.createDataFrame([(i, "a" if i < 30 else "b" if i < 36 else "c") for i in range(37)], "id int, label string")
    s = balance.fix_unseen(balance.stratified_split(balance.drop_rare(df)))
    assert {r.split: r["count"] for r in s.groupBy("split").count().collect()} == {"train": 29, "val": 3 if s.where("split = 'val'").count() == 3 else 4, "test": s.where("split = 'test'").count()}
    assert balance.labels_subset(s.where("split <> 'train'"), s.where("split = 'train'"))
    assert balance.support_floor(balance.class_counts(df), 5, 3).first()[0] == 5
    assert evaluate.class_report(spark.createDataFrame([("a", "a"), ("a", "b")], "true_label string, predicted_label string")).collect()[1].asDict() == {"class": "b", "precision": 0.0, "recall": 0.0, "f1": 0.0, "support": 0}


def test_overlaps_take_time_in_proportion(spark):
    """Reads of one base, or of a short repeat, end in beginnings of the other at every length; 200 000 bases are compared in one pass."""
    def brute(a, b, least):
        return next((n for n in range(min(len(a), len(b)), least - 1, -1) if a.endswith(b[:n])), 0)

    rng = random.Random(5)
    for _ in range(3000):
        a, b = ("".join(rng.choices(rng.choice(["A", "AC", "ACGT", "A\u00e9\U0001f600"]), k=rng.randint(0, 14))) for _ in "ab")
        b = a[rng.randint(0, len(a)) :] + b if rng.random() < 0.5 else b
        least = rng.randint(1, 5)
        assert S.overlap(a, b, least) == brute(a, b, least)
    assert S.overlap(None, "ACGT", 1) == 0
    n = 200_000
    reads = spark.createDataFrame([("s", 1, "A" * n, "A" * (n - 1) + "C"), ("s", 2, "ACGT" * (n // 4), "CGTA" * (n // 4)), ("s", 3, None, "A" * 20), ("s", 4, "A" * n + "C", "A" * n)], "sample_id string, read_id int, a string, b string")
    reverse = reads.select("sample_id", "read_id", S.reverse_complement(F.col("b")).alias("seq"))
    got = {r.read_id: r for r in clean.merge_pairs(reads.select("sample_id", "read_id", F.col("a").alias("seq")), reverse).collect()}
    assert {i: r.overlap for i, r in got.items()} == {1: n - 1, 2: n - 1, 3: 0, 4: 0}
    assert got[1].seq == "A" * n + "C" and got[2].seq == "ACGT" * (n // 4) + "A" and got[3].seq is None and got[4].seq is None


def test_batches_of_sequences_take_little_memory(spark):
    """Eight million bases in one batch: what numpy holds beside the batch doesn't grow with it."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    column = pa.array(["".join(rng.choice(list("ACGTN"), 2000)) for _ in range(4000)] + [None, "", "éA"])
    for f in (features._composition(), features._shares(3)):
        tracemalloc.start()
        got = f.func(column)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(got) == 4003 and peak < 40e6
    assert features._composition().func(column)[-3:].to_pylist() == [{"length": n, "gc": 0.0, "pairs": [0.0] * 16} for n in (0, 0, 2)]


def test_forests_count_words_of_a_sequence_once(spark):
    """Training and its report read each sequence once, and store its vector."""
    seen = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(i, "ACGT" * 5 if i % 2 else "AACC" * 5, "ab"[i % 2]) for i in range(20)], "sequence_id int, seq string, label string")

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    _, metrics = models.train_kmer_rf(rows.mapInArrow(counted, rows.schema), 2, trees=3)
    assert metrics == {"accuracy": 1.0, "macro_f1": 1.0, "num_samples": 20} and seen.value == 20


def test_one_hot_digests_take_no_arrays_of_arrays(spark):
    """The digest is that of the column function; four million bases in one row."""
    rows = spark.createDataFrame([("ACGTNAé",), ("",), (None,)], "seq string")
    x = rows.select(S.one_hot(F.col("seq")).alias("x"), S.one_hot_digest()("seq").alias("d")).collect()
    for r in x[:2]:
        assert r.d.bases == len(r.x) and [r.d.a, r.d.c, r.d.g, r.d.t] == [sum(e[i] for e in r.x) for i in range(4)]
        assert r.d.bits == hashlib.md5("".join(str(i) for e in r.x for i in e).encode()).hexdigest()
    assert x[2].d.bases is None and x[2].d.bits is None
    long = spark.range(1).select(S.one_hot_digest()(F.repeat(F.lit("ACGT"), 1_000_000)).alias("d")).first().d
    assert (long.bases, long.t) == (4_000_000, 1_000_000)


def test_rarefaction_follows_its_sql_at_large_totals(spark):
    """Where totals are large, differences of ln gamma lose digits; the values are the SQL's to the last bit."""
    import duckdb

    x = [float(10**e + 37 * i) for e in range(1, 10) for i in range(200)]
    want = [r[0] for r in duckdb.connect().execute("SELECT lgamma(unnest($1::DOUBLE[]))", [x]).fetchall()]
    assert [diversity.log_gamma(v) for v in x] == want


def test_consensus_moves_each_row_once(spark):
    """One shuffle, by sequence; ties go to the first name, and a rank holds only if all above hold."""
    ranks = ", ".join(f"`{r}` string" for r in RANKS)
    row = lambda i, m, *x: (i, m, *x, *[None] * (7 - len(x)))
    preds = spark.createDataFrame([row(1, "a", "K", "P"), row(1, "b", "K", "Q"), row(1, "c", "K", "Q"), row(2, "a", "L", "P"), row(2, "b", "K", "P"), row(3, "a"), row(3, "b", "K")], f"sequence_id int, method string, {ranks}")
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "method string, weight double")
    got = lineage.consensus(preds, weights)
    assert sorted((r.sequence_id, r.kingdom, r.phylum, r["class"], r.share) for r in got.collect()) == [(1, "K", "Q", UNKNOWN, 0.666667), (2, UNKNOWN, UNKNOWN, UNKNOWN, 0.5), (3, UNKNOWN, UNKNOWN, UNKNOWN, 0.5)]
    plan = lineage.consensus(preds, weights)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
