"""Best parents of sequences, by trees of short ones, against all pairs."""

import random
import time

import numpy as np
import pytest
from test_parents import SCHEMA, distance, mutated

from tidepool.operators import parents as P
from tidepool.operators.near_tree import SHORT, best_parents


def brute_parents(rows, most):
    """Of each child: (-pn, d, parent) of the most abundant parent, then the nearest, then the first."""
    out = {}
    for s, a, n in rows:
        near = [(-m, d, b) for t, b, m in rows if s == t and m > n and a != b and 0 < (d := distance(a, b)) < len(most) and n / m <= most[d]]
        if near:
            out[s, a] = min([min(near), *([out[s, a]] if (s, a) in out else [])])
    return out


@pytest.mark.parametrize("seed, letters, size, alpha, base", [(1, "AC", 8, 2, 1), (2, "ACGT", 12, 1, 0.5), (3, "ACGT", 31, 0.1, 0.1), (4, "AéZ\U0001f600", 63, 0.5, 0), (5, "ACGT", 40, 2, 1), (6, "AC", 1, 0.5, 0.5)])
def test_short_parents_are_those_of_all_pairs(seed, letters, size, alpha, base):
    """Empty, repeated and longest sequences, ties of abundance and distance, words of 32 and of 64 bits."""
    r = random.Random(seed)
    seeds = ["".join(r.choice(letters) for _ in range(r.randrange(size + 1))) for _ in range(6)]
    seqs = sorted({q for _ in range(150) if len(q := "".join(r.choice(letters) if x in "CGT" else x for x in mutated(r, r.choice(seeds), r.randrange(6)))) <= SHORT} | {""})
    rows = [("s", q, r.choice([1, 1, 1, 2, 3, 5, 8, 8, 30, 64, 300, 3000, 50000])) for q in [*seqs, *seqs[:20]]]
    most = [2.0 ** -(d * alpha + base) for d in range(min(70, int((15.6 - base) / alpha)) + 1)]
    got = best_parents([q for _, q, _ in rows], [n for _, _, n in rows], [q for _, q, _ in rows], [n for _, _, n in rows], np.array(most))
    assert {("s", rows[i][1]): (-rows[j][2], d, rows[j][1]) for i, j, d in zip(*got, strict=True)} == brute_parents(rows, most) != {}


def test_denoise_joins_the_best_of_all_pairs(spark, monkeypatch):
    """Short and long sequences that are each other's parents, nulls, several trees and deals of parents."""
    monkeypatch.setattr(P, "TREE", 7)
    monkeypatch.setattr(P, "HELD", 11)
    r = random.Random(9)
    near = {}
    for size in (0, 5, 11, 24, 61, 64, 66, 90):
        s = "".join(r.choice("ACGT") for _ in range(size))
        for _ in range(14):
            near[r.choice("sst"), mutated(r, s, r.randrange(5))] = r.choice([1, 1, 2, 3, 9, 40, 200])
    edge = ["".join(r.choice("ACGT") for _ in range(SHORT)) for _ in range(2)]
    near |= {("s", edge[0]): 1, ("s", edge[0] + "A"): 200, ("s", edge[1]): 200, ("s", edge[1] + "A"): 1}
    rows = [(s, q, n) for (s, q), n in near.items()]
    into = brute_parents(rows, [2.0 ** -(2 * d + 1) for d in range(4)])
    assert any(len(q) <= SHORT < len(p) for (_, q), (_, _, p) in into.items()) and any(len(p) <= SHORT < len(q) for (_, q), (_, _, p) in into.items())
    odd = [("s", None, 3), (None, "ACGT", 4), (None, "ACGA", 9000), ("t", "GG" * 20, None)]
    want = {}
    for s, q, n in rows:
        k = s, into[s, q][2] if (s, q) in into else q
        want[k] = want.get(k, 0) + n
    got = P.denoise(spark.createDataFrame([*rows, *odd], SCHEMA)).collect()
    assert {(x.sample_id, x.seq): x.n for x in got} == want | {(s, q): n for s, q, n in odd}
    assert len(got) == len(want) + len(odd)


def test_far_parents_of_many_short_sequences(spark):
    """40 000 words of nine letters under parents at distances up to 7: no pairs are made of them."""
    r = random.Random(10)
    seqs = list({"".join(r.choice("ACGT") for _ in range(9)) for _ in range(40_000)})
    rows = [("s", q, 40_000 if i < 3 else 2_100 if i < 300 else 130 if i < 3_000 else 1) for i, q in enumerate(seqs)]
    df = spark.createDataFrame(rows, SCHEMA)
    began = time.time()
    got = {x.seq: x.n for x in P.denoise(df).collect()}
    took = time.time() - began
    assert sum(got.values()) == sum(n for _, _, n in rows) and len(got) < 3_000
    parents = sorted((-n, q) for _, q, n in rows if n >= 8)
    for q in r.sample(seqs[3_000:], 20):
        own = [m for m, p in parents if 1 / -m <= 2.0 ** -(2 * distance(q, p) + 1)]
        assert (q in got) == (not own)
    assert took < 40
