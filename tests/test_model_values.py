"""Values of what SQL can't say, against numpy and plain loops."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidepool.operators import evaluate, features, models
from tidepool.schema import RANKS

LABELS = "label string, " + ", ".join(f"`{r}` string" for r in RANKS)


@pytest.fixture(scope="module")
def groups(spark):
    """(vectors, labels, frame): three groups in seven dimensions, of which two tell nothing."""
    rng = np.random.default_rng(11)
    y = np.repeat([0, 1, 2], [30, 24, 18])
    x = rng.normal(size=(len(y), 7))
    x[:, 0] += 4 * y
    x[:, 3] -= 3 * (y == 1)
    x[:, 5] *= 10
    rows = spark.createDataFrame([(i, v.tolist(), f"g__L{k}") for i, (v, k) in enumerate(zip(x, y, strict=True))], "sequence_id long, embedding array<double>, label string")
    return x, y, features.as_vector(rows).withColumn("id", F.col("sequence_id"))


def test_selected_features_have_the_highest_f(groups):
    x, y, rows = groups
    f = []
    for c in x.T:
        own = [c[y == k] for k in range(3)]
        between = sum(len(o) * (o.mean() - c.mean()) ** 2 for o in own) / 2
        within = sum(((o - o.mean()) ** 2).sum() for o in own) / (len(y) - 3)
        f.append(between / within)
    best = sorted(np.argsort(f)[::-1][:3].tolist())
    got = features.select_features(rows.withColumn("label", F.substring("label", 5, 1).cast("double")), 3).select("sequence_id", vector_to_array("selected").alias("s")).collect()
    assert all(r.s == pytest.approx(x[r.sequence_id][best].tolist()) for r in got) and len(got) == len(y)
    assert len(features.select_features(rows.withColumn("label", F.substring("label", 5, 1).cast("double")), 1000).select(vector_to_array("selected")).first()[0]) == 7


def test_reduced_dimensions_are_principal_components(groups):
    x, _, rows = groups
    centered = x - x.mean(0)
    _, _, vt = np.linalg.svd(centered, full_matrices=False)
    want = centered @ vt[:3].T
    got = np.array([r.v for r in features.reduce_dims(rows, 3).orderBy("sequence_id").select(vector_to_array("reduced").alias("v")).collect()])
    signs = np.sign((got * want).sum(0))
    assert np.allclose(got, want * signs, atol=1e-8)


def test_word_embeddings_are_means_of_word_vectors(spark):
    """Sequences of one word have its vector; others the mean over their words, repeated ones included."""
    rows = spark.createDataFrame([(0, "AAA"), (1, "CCC"), (2, "AAAA"), (3, "AAAC"), (4, "AAC"), (5, "N"), (6, "CCCCAAA")], "id int, seq string")
    got = {r.id: np.array(r.v) for r in features.kmer_word2vec(rows, 3, 8, partitions=1).select("id", vector_to_array("features").alias("v")).collect()}
    assert np.abs(got[0]).max() > 0 and not np.allclose(got[0], got[1]) and not got[5].any()
    assert np.allclose(got[2], got[0]) and np.allclose(got[3], (got[0] + got[4]) / 2)
    again = {r.id: np.array(r.v) for r in features.kmer_word2vec(rows, 3, 8, partitions=1).select("id", vector_to_array("features").alias("v")).collect()}
    assert all(np.allclose(got[i], again[i]) for i in got)


def test_word_embeddings_are_fitted_to_all_neighbours(spark):
    """Pairs are those of a plain loop, the vectors don't depend on how rows are dealt, and words with the same neighbours are alike."""
    rng = np.random.default_rng(3)
    seqs = ["".join(rng.choice(list("ACGTN"), n, p=[0.3, 0.2, 0.2, 0.25, 0.05])) for n in (0, 2, 3, 7, 400, 2500)] + ["AC" * 300, None]
    rows = spark.createDataFrame(list(enumerate(seqs)), "id int, seq string")
    want = {}
    for s in seqs:
        w = [x for x in ((s or "")[i : i + 2] for i in range(len(s or "") - 1)) if "N" not in x]
        for i, a in enumerate(w):
            for d, b in enumerate(w[i + 1 : i + 6]):
                p = sum("ACGT".index(c) * 4 ** (3 - j) for j, c in enumerate(a + b))
                want[p] = want.get(p, 0) + 5 - d
    assert {r.pair: r.n for r in features.word_pairs(rows.repartition(3), 2).collect()} == want
    one, more = ({r.id: np.array(r.v) for r in features.kmer_word2vec(df, 2, 8).select("id", vector_to_array("features").alias("v")).collect()} for df in (rows.coalesce(1), rows.repartition(4, "id")))
    assert one.keys() == more.keys() and all(np.allclose(one[i], more[i], atol=1e-6) for i in one) and not one[7].any()
    n = np.array([[0, 0, 8, 1], [0, 0, 8, 1], [8, 8, 0, 0], [1, 1, 0, 0]])  # 0 and 1 have the same neighbours
    x = features.skip_gram(n, 8, 1)
    c = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    assert c[0, 1] > 0.9 > c[0, 2]
    assert not features.kmer_word2vec(rows.where("id < 1"), 2, 8).select(vector_to_array("features").alias("v")).where("exists(v, x -> x <> 0)").count()


def test_silhouette_against_all_pairs(groups):
    x, y, rows = groups
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    s = []
    for i, k in enumerate(y):
        own = d[i, y == k].sum() / ((y == k).sum() - 1)
        other = min(d[i, y == j].mean() for j in range(3) if j != k)
        s.append((other - own) / max(own, other))
    assert evaluate.silhouette(rows.withColumn("cluster", F.substring("label", 5, 1).cast("double"))) == pytest.approx(np.mean(s), abs=1e-9)


def test_supervised_rows_and_mode(spark, groups):
    """Probabilities are shares of the trees' votes; the taxonomy overrides parsing; below the threshold ranks go."""
    x, y, rows = groups
    model, accuracy = models.train_rf(rows, trees=15)
    p = {r.sequence_id: (np.array(r.p), r.l) for r in models.serving(model).transform(rows.drop("label")).select("sequence_id", vector_to_array("_prob").alias("p"), F.col("predicted_label").alias("l")).collect()}
    assert accuracy == pytest.approx(np.mean([p[i][1] == f"g__L{k}" for i, k in enumerate(y)]))
    known = spark.createDataFrame([("g__L1", "K", "P", "C", "O", "F", "G", "S")], LABELS)
    got = {r.sequence_id: r for r in models.classify(rows.drop("label", "features"), model, known=known, threshold=0.8).collect()}
    for i, r in got.items():
        top = p[i][0].max()
        assert r.predicted_label == p[i][1] == f"g__L{int(p[i][0].argmax())}" and r.confidence == pytest.approx(100 * top, abs=0.006) and r.method == "supervised_taxonomy"
        want = ("Unknown", "Unknown") if top < 0.8 else ("K", "G") if r.predicted_label == "g__L1" else ("Unknown", r.predicted_label[3:])
        assert (r.kingdom, r.genus) == want
    plain = models.classify(rows.drop("label", "features"))
    assert {r.method for r in plain.select("method").distinct().collect()} == {"embedding_kmeans_fallback"} and plain.count() == len(y)


@pytest.mark.parametrize("kind", ["logistic", "forest"])
def test_train_eval_reports_the_held_out_part(groups, kind):
    from tidepool.operators import balance

    _, y, rows = groups
    model, report = models.train_eval(rows, kind)
    test = balance.stratified_split(rows, (("train", 0.8), ("test", 0.2)), 42).where("split = 'test'")
    pairs = [(r.label, r.predicted_label) for r in models.serving(model).transform(test).select("label", "predicted_label").collect()]
    names = sorted({a for a, _ in pairs} | {b for _, b in pairs})
    f1 = []
    for n in names:
        tp, fp, fn = (sum(t == n and q == n for t, q in pairs), sum(t != n and q == n for t, q in pairs), sum(t == n and q != n for t, q in pairs))
        f1.append(2 * tp / (2 * tp + fp + fn) if tp else 0.0)
    r = report.first()
    assert r.accuracy == pytest.approx(np.mean([a == b for a, b in pairs]), abs=1e-6) and r.macro_f1 == pytest.approx(np.mean(f1), abs=1e-6) and r.classes == 3
    assert len(pairs) == sum(n - round(0.8 * n) for n in Counter(y.tolist()).values()) or len(pairs) in range(12, 18)
    assert r.accuracy > 0.7


def test_routing_at_the_default_threshold(spark, groups):
    """Rows of 70 and more stay; the others are clustered as ``otu_cluster`` does it, each cluster with its most confident row."""
    x, y, rows = groups
    confidence = {i: 70.0 if i % 9 == 0 else 99.0 if i % 3 == 0 else 69.99 for i in range(len(y))}
    preds = spark.createDataFrame([(i, *["R"] * 7, c, "m", f"p{i}") for i, c in confidence.items()], "sequence_id long, " + ", ".join(f"`{r}` string" for r in RANKS) + ", confidence double, method string, predicted_label string")
    embeddings = rows.select("sequence_id", "embedding")
    got = {r.sequence_id: r for r in models.hybrid_route(preds, embeddings).collect()}
    assert set(got) == set(range(len(y)))
    sure = {i for i, c in confidence.items() if c >= 70}
    assert all(got[i].predicted_label == f"p{i}" and not got[i].representative and got[i].confidence == confidence[i] for i in sure)
    alone = {r.sequence_id: r for r in models.otu_cluster(embeddings.where(F.col("sequence_id").isin([i for i in range(len(y)) if i not in sure]))).collect()}
    members = defaultdict(list)
    for i, r in alone.items():
        assert (got[i].predicted_label, got[i].confidence, got[i].genus) == (r.predicted_label, r.confidence, r.genus)
        members[r.predicted_label].append((-r.confidence, i))
    assert {i for i in got if got[i].representative} == {min(m)[1] for m in members.values()}
    assert not math.isnan(got[1].confidence)
