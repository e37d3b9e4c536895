"""Quantiles by selection, run ids by gaps, k-means in one scan, sparse word counts: against plain code."""

from collections import Counter

import numpy as np
import pytest

from tidepool.operators import balance, diversity, features, kmeans, quantiles, runs

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]


@pytest.mark.parametrize("how", [{}, {"sorted_rows": 5, "buckets": 40}])
def test_quantiles(spark, how):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=500), "b": rng.integers(0, 4, 300).astype(float), "c": np.array([7.0]), "d": np.full(90, -1e308), "e": np.exp(rng.normal(size=200) * 50), None: np.array([1e308, -1e308, 0.0, 5e-324])}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("z", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {(r.g, r.share): r.value for r in quantiles.quantiles(df, "x", SHARES, ["g"], **how).collect()}
    assert set(got) == {(g, s) for g in groups for s in SHARES}
    for g, v in groups.items():
        v = np.sort(v)
        for s in SHARES:
            at = s * (len(v) - 1)
            lo, hi = v[int(np.floor(at))], v[int(np.ceil(at))]
            with np.errstate(over="ignore", invalid="ignore"):
                want = lo + (at - np.floor(at)) * (hi - lo)
            assert got[g, s] == pytest.approx(want, rel=1e-12, nan_ok=True)
    alone = {r.share: r.value for r in quantiles.quantiles(df.where("g = 'a' AND NOT isnan(x)"), "x", SHARES, **how).collect()}
    assert alone == {s: got["a", s] for s in SHARES}


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([], "x long")
    assert quantiles.quantiles(none, "x", [0.5]).count() == 0
    r = balance.describe(none, "x").first()
    assert r["count"] == 0 and r["median"] is None
    plan = balance.describe(spark.range(9), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
    assert [balance.describe(spark.range(9), "id").first()[c] for c in ("q1", "median", "q3", "max")] == [2, 4, 6, 8]


def plain_ids(rows):
    names = {b for b, _ in rows}
    seen, out = Counter(), []
    for b, at in sorted(rows, key=lambda x: (x[0], x[1])):
        if seen[b]:
            k = seen[b]
            while f"{b}-{k}" in names:
                k += 1
            seen[b] = k + 1
            out.append((b, at, f"{b}-{k}"))
        else:
            seen[b] = 1
            out.append((b, at, b))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 17])
def test_ids_skip_taken_numbers(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [("x", i) for i in range(60)] + [(f"x-{k}", 100 + i) for i, k in enumerate(rng.choice(90, 40, replace=False) + 1)] + [("x-3", 300), ("x-3-1", 301), ("x-07", 302), ("y-1", 303), ("y", 304), ("y", 305), ("z", 306), ("q-1", 307)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = runs.uniquify_ids(spark.createDataFrame(rows, "base_id string, at long"))
        assert got.columns == ["base_id", "at", "run_id"]
        assert sorted(map(tuple, got.collect())) == plain_ids(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert runs.uniquify_ids(spark.createDataFrame([(None, 1), (None, 2)], "base_id string, at long")).where("run_id IS NULL").count() == 2


def test_many_rows_and_many_taken_numbers_of_one_base(spark):
    """200 000 rows of one base id, and every second number taken."""
    rows = spark.range(200_000).selectExpr("'b' AS base_id", "id AS at").unionByName(spark.range(1, 200_000, 2).selectExpr("concat('b-', id) AS base_id", "id + 1000000 AS at"))
    got = runs.uniquify_ids(rows)
    assert got.count() == 300_000 and got.select("run_id").distinct().count() == 300_000
    assert {r.at: r.run_id for r in got.where("base_id = 'b' AND at IN (0, 1, 2, 100000, 199999)").collect()} == {0: "b", 1: "b-2", 2: "b-4", 100_000: "b-200000", 199_999: f"b-{199_999 + 100_000}"}


def vectors(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sequence_id long, _v array<double>")


def test_all_models_in_one_scan_end_where_single_ones_do(spark):
    """Costs of ten models from given starts, against the library's own k-means from the same starts."""
    from pyspark.mllib.clustering import KMeans, KMeansModel

    rng = np.random.default_rng(2)
    x = np.concatenate([c + rng.normal(size=(70, 5)) for c in 3 * rng.normal(size=(4, 5))])
    rows = vectors(spark, x)
    starts = np.stack([kmeans.plus_plus(x, 4, s) for s in range(10)])
    models = kmeans.fit(rows, starts, rounds=200, tolerance=1e-9)
    rdd = rows.select("_v").rdd.map(lambda r: r[0]).cache()
    for m, start in zip(models, starts, strict=True):
        other = KMeans.train(rdd, 4, maxIterations=200, initialModel=KMeansModel(list(start)), epsilon=1e-9)
        assert m.cost == pytest.approx(other.computeCost(rdd), rel=1e-6)
        assert np.allclose(np.sort(m.centers, 0), np.sort(np.array(other.clusterCenters), 0))


def test_centers_without_rows_stay(spark):
    x = np.array([[0.0, 0.0]] * 5 + [[1.0, 0.0]] * 5)
    start = np.array([[[0.0, 0.1], [1.0, 0.1], [50.0, 50.0]], [[0.5, 0.0], [0.5, 0.0], [0.5, 0.0]]])
    first, second = kmeans.fit(vectors(spark, x), start)
    assert first.cost == pytest.approx(0) and first.centers[2].tolist() == [50.0, 50.0]
    assert second.cost == pytest.approx(2.5) and second.centers[0].tolist() == [0.5, 0.0]
    assert {r.cluster: (r.n, r["first"]) for r in kmeans.sizes(vectors(spark, x), first.centers, "sequence_id").collect()} == {0: (5, 0), 1: (5, 5)}


def test_many_groups_of_words_stay_sparse(spark, monkeypatch):
    """Groups of one short read each: counts hold what occurs, also when they are passed on often."""
    rng = np.random.default_rng(3)
    reads = [(f"g{i}", "".join(rng.choice(list("ACGTN"), 12))) for i in range(300)] + [("g1", None), (None, "ACGT"), ("g2", "")]
    want = Counter((g, k, s[i : i + k]) for g, s in reads if s for k in (3, 4, 6) for i in range(len(s) - k + 1) if "N" not in s[i : i + k])
    df = spark.createDataFrame(reads, "g string, seq string")
    for held in (features.HELD, 50):
        monkeypatch.setattr(features, "HELD", held)
        got = {(r.g, r.k, r.kmer): r.n for r in features.kmer_counts(df, (3, 4, 6), ("g",)).collect()}
        assert got == want
    all_ = {(r.k, r.kmer): r.n for r in features.kmer_counts(df, (3,)).collect()}
    assert all_ == Counter({(k, w): sum(n for (_, j, v), n in want.items() if (j, v) == (k, w)) for _, k, w in want if k == 3})


@pytest.mark.parametrize("k", [1, 3, 6])
def test_word_vectors(spark, k):
    from pyspark.ml.functions import vector_to_array

    seqs = ["ACGTACGTNACG", "", None, "N" * 9, "AAAAAAAAAA", "AC"]
    got = features.kmer_vector(spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "id int, seq string"), k).select("id", vector_to_array("features").alias("x")).collect()
    words = features.vocabulary(k)
    for r in got:
        s = seqs[r.id] or ""
        n = Counter(s[i : i + k] for i in range(len(s) - k + 1) if "N" not in s[i : i + k])
        assert r.x == pytest.approx([n[w] / max(1, sum(n.values())) for w in words])


def test_rarefying_to_the_default_depth(spark):
    import hashlib

    rows = [("s", "a", 9000), ("s", "b", 70_000), ("s", "c", 1), ("t", "a", 10_000), ("u", "a", 9_999), ("s", "d", 0)]
    got = {(r.sample_id, r.taxon): r.n for r in diversity.rarefy(spark.createDataFrame(rows, "sample_id string, taxon string, n long")).collect()}
    order = sorted((hashlib.md5(f"42|s|{t}|{i}".encode()).hexdigest(), t) for s, t, n in rows if s == "s" for i in range(1, n + 1))[:10_000]
    assert got == {("s", t): n for t, n in Counter(t for _, t in order).items()} | {("t", "a"): 10_000}


def test_small_digests_are_those_of_hashlib():
    """Texts of one block and of several, numbers of one digit and of many, bounds that take none, some and all."""
    import hashlib

    import pyarrow as pa

    from tidepool.functions import batches, digests

    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("é漢Zz9|"), n)) for n in (0, 1, 7, 20, 20, 27, 30, 54, 55, 56, 63, 64, 65, 118, 119, 120, 200)] + ["a" * n for n in (*range(45, 57), 118, 119, 120)]
    low = rng.choice([1, 1, 50_001, 99_995], len(texts))
    high = low + rng.choice([0, 8, 9, 300], len(texts))
    bound = rng.choice([0, 2**29, 2**31, 2**32 - 1], len(texts))
    want = sorted((j, i) for j, t in enumerate(texts) for i in range(low[j], high[j] + 1) if int.from_bytes(hashlib.md5(t.encode() + b"%d" % i).digest()[:4], "big") <= bound[j])
    got = sorted((j, i) for js, own in digests.small_digests(*batches.string_bytes(pa.array(texts)), low, high, bound) for j, i in zip(js.tolist(), own.tolist(), strict=True))
    assert got == want and len(want) > 500


@pytest.mark.parametrize("held", [2, 50_000])
def test_rarefying_long_names_and_large_counts(spark, monkeypatch, held):
    import hashlib

    monkeypatch.setattr(diversity, "ROWS", held)
    rows = [("s" * 70, "é" * 40, 120_000), ("s" * 70, "b", 9), ("t", "a", 60), ("t", "b" * 60, 50_001), ("u", "a", 99), (None, "a", 5000)]
    got = {(r.sample_id, r.taxon): r.n for r in diversity.rarefy(spark.createDataFrame(rows, "sample_id string, taxon string, n long"), 100).collect()}
    want = Counter()
    for s in ("s" * 70, "t"):
        order = sorted((hashlib.md5(f"42|{s}|{t}|{i}".encode()).hexdigest(), t) for x, t, n in rows if x == s for i in range(1, n + 1))
        want.update((s, t) for _, t in order[:100])
    assert got == want


def test_threads_keep_their_own_scratch_tables(spark, tmp_path, monkeypatch):
    from threading import Barrier, Thread

    from tidepool import storage

    monkeypatch.setattr(storage, "shared_path", lambda spark, tag: f"file://{tmp_path}/{tag}")
    meet, counts = Barrier(2), {}

    def first():
        with storage.scratch():
            storage.written(spark.range(2), "one")
            meet.wait(60)
            meet.wait(60)

    def second():
        with storage.scratch():
            meet.wait(60)
            df = storage.written(spark.range(3), "two")
            meet.wait(60)
            threads[0].join(60)
            counts["two"] = df.count()

    threads = [Thread(target=first), Thread(target=second)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert counts == {"two": 3} and list(tmp_path.iterdir()) == []
