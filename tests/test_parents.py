"""Parents of uniques against all pairs: chimeras by order, near parents by pieces and deletions."""

import random
import time

import pytest

from tidepool.operators import parents as P

SCHEMA = "sample_id string, seq string, n long"


def shared(a, b):
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return i


def brute_chimeras(rows, ratio):
    out = set()
    for s, q, n in rows:
        if None in (s, q, n) or not q:
            continue
        able = [p for t, p, m in rows if t == s and p is not None and m is not None and m >= ratio * n and p != q]
        if able and max(shared(q, p) for p in able) + max(shared(q[::-1], p[::-1]) for p in able) >= len(q):
            out.add((s, q))
    return out


def flagged(spark, rows, ratio, parts=4):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = P.chimeras(spark.createDataFrame(rows, SCHEMA), ratio).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert sorted(((r.sample_id, r.seq, r.n) for r in got), key=repr) == sorted(rows, key=repr)
    return {(r.sample_id, r.seq) for r in got if r.chimera}


@pytest.mark.parametrize("seed, parts, ratio", [(1, 1, 2.0), (2, 4, 2.0), (3, 13, 1.5), (4, 30, 4.0), (5, 7, 1.05)])
def test_chimeras_are_those_of_all_pairs(spark, seed, parts, ratio):
    """Few letters and many ranges, so that parents are in other ranges than their children; one sample has most rows."""
    r = random.Random(seed)
    seqs = {(r.choice(["a", "a", "a", "b", "c"]), "".join(r.choice("AC") for _ in range(r.randrange(1, 9)))) for _ in range(400)}
    rows = [(s, q, r.choice([1, 2, 3, 5, 8, 40, 200])) for s, q in sorted(seqs)]
    assert flagged(spark, rows, ratio, parts) == brute_chimeras(rows, ratio) != set()


def test_chimeras_of_odd_rows(spark):
    rows = [("s", None, 5), (None, "AC", 9), ("s", "", 7), ("s", "A" * 5000 + "C" * 5000, 1), ("s", "A" * 9000, 9), ("s", "C" * 9000, 9), ("s", "GG", None), ("t", "A", 1), ("u", "AC", 4), ("u", "AG", 8), ("u", "TC", 8)]
    assert flagged(spark, rows, 2.0) == brute_chimeras(rows, 2.0) == {("s", "A" * 5000 + "C" * 5000), ("u", "AC")}
    assert P.chimeras(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_half_that_all_share(spark):
    """100 000 uniques with one common half: a walk in order, no pairs."""
    half = "ACGT" * 10
    rows = spark.range(100_000).selectExpr("'s' AS sample_id", f"concat('{half}', translate(lpad(conv(id, 10, 4), 9, '0'), '0123', 'ACGT')) AS seq", "1 + id % 100 AS n")
    began = time.time()
    got = P.chimeras(rows)
    assert got.count() == 100_000 and got.where("chimera").count() > 0
    assert time.time() - began < 60


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_near(rows, d):
    return sorted((s, a, n, b, m, k) for s, a, n in rows for t, b, m in rows if s == t and m > n and a != b and (k := distance(a, b)) <= d)


def mutated(r, s, edits):
    s = list(s)
    for _ in range(edits):
        i = r.randrange(len(s) + 1)
        kind = r.randrange(3)
        if kind == 0:
            s.insert(i, r.choice("ACGT"))
        elif s and kind == 1:
            s.pop(i % len(s))
        elif s:
            s[i % len(s)] = r.choice("ACGT")
    return "".join(s)


@pytest.mark.parametrize("d, sizes", [(1, (1, 7, 13, 30)), (2, (0, 3, 18, 40)), (4, (2, 6, 25, 70)), (10, (5, 12, 60, 150))])
def test_near_pairs_are_those_of_all_pairs(spark, d, sizes):
    r = random.Random(d)
    rows = set()
    for size in sizes:
        for _ in range(3):
            s = "".join(r.choice("ACGT") for _ in range(size))
            rows |= {("s", s, 50), *[(r.choice("sst"), mutated(r, s, r.randrange(d + 2)), r.randrange(1, 40)) for _ in range(5)]}
    rows = list({(s, q): (s, q, n) for s, q, n in rows}.values())
    df = spark.createDataFrame([*rows, ("s", None, 3)], SCHEMA)
    got = P.near_pairs(df, df, d)
    assert sorted((x.sample_id, x.seq, x.n, x.parent, x.pn, x.d) for x in got.collect()) == brute_near(rows, d) != []


def test_rare_pieces_keep_candidates_few(spark):
    """All share most of their letters; a child is looked up by the piece that is its own."""
    r = random.Random(8)
    common = "".join(r.choice("ACGT") for _ in range(60))
    rows = [("s", "".join(r.choice("ACGT") for _ in range(36)) + common, 1000 - i) for i in range(300)]
    rows += [("s", q[:5] + ("A" if q[5] == "T" else "T") + q[6:], 1) for _, q, _ in rows]
    df = spark.createDataFrame(list({q: (s, q, n) for s, q, n in rows}.values()), SCHEMA)
    got = P.near_pairs(df.where("n = 1"), df.where("n > 1"), 1)
    assert got.count() == len({q for _, q, n in rows if n == 1})


def test_near_pairs_of_a_ratio_leave_out_weaker_parents(spark):
    u = spark.createDataFrame([("s", "ACGTACGTACGT", 1), ("s", "ACGTACGTACGA", 7), ("s", "ACGTACGTACGC", 8)], "sample_id string, seq string, n long")
    got = P.near_pairs(u.where("n = 1"), u, 1, 8.0).collect()
    assert [(r.parent, r.d) for r in got] == [("ACGTACGTACGC", 1)]
