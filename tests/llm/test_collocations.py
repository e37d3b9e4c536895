"""Collocation mining against plain code, however few or many rounds it takes, and on awkward tables."""

import random
import re
from collections import Counter

import duckdb
import pytest

from tidepool.llm import collocations as C

DIR = "/root/testdata/sf0.01"


def brute(docs, least=10, top=2000):
    """Every phrase of every piece, counted; docs: (text, lang)."""
    f, out = {}, []
    for text, lang in docs:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            c = f.setdefault("und" if lang is None else lang, Counter())
            c.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        n = sum(x for p, x in c.items() if len(p) == 1)
        found = {}
        for p, a in c.items():
            if len(p) > 1 and a >= least:
                cuts = [(1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                found[p] = (a, c[p[:k]], c[p[k:]], n, score)
        longer = [(p, v[0]) for p, v in found.items() if len(p) == 3]
        gone = {q for p, a in longer for q in (p[:2], p[1:]) if 100 * a >= 50 * c[q]}
        rows = sorted((-v[4], -v[0], " ".join(p).encode(), v) for p, v in found.items() if p not in gone)
        out += [(lang, i, p.decode(), *v) for i, (_, _, p, v) in enumerate(rows[:top], 1)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def frame(spark, rows):
    return spark.createDataFrame([(t, g, "x", "y", "z", 1) for t, g in rows], "text string, lang string, a string, phrase string, _lang string, n long")


def test_tables_against_plain_code_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("text", "lang").collect()]
    want = brute(rows)
    assert len(want) > 1000
    found = C.query(spark, DIR)
    assert got(found) == want
    assert got(C.collocations(spark.read.parquet(f"{DIR}/documents.parquet"), 5, 100)) == brute(rows, 5, 100)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    sql = con.sql(C.SQL)
    assert sorted(sql.columns) == sorted(found.columns)
    assert sorted(sql.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").fetchall()) == want


@pytest.mark.parametrize("seed, least, top, growth", [(1, 2, 3, 2), (3, 1, 40, 3)])
def test_rounds_settle_what_they_return(spark, seed, least, top, growth):
    """Few words, so that many phrases cover pairs and equal scores are many; small steps, so that there are several rounds."""
    r = random.Random(seed)
    vocabulary = ["New", "york", "city", "of", "the", "é", "日本", "x9", "a-b"]
    rows = [("".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "\t ", ", ", "\n", ". ", ""]) for _ in range(r.randrange(60))), r.choice(["en", "de", None])) for _ in range(60)]
    assert got(C.collocations(frame(spark, rows), least, top, growth)) == brute(rows, least, top)


def test_several_rounds_are_taken(spark, monkeypatch):
    """Pairs with high scores that longer phrases of low scores cover: the first thresholds leave too few."""
    rows = [(f"p{i} q{i} r{i}. " * 12 + f"p{i} q{i}. q{i} r{i}. " * 10, "en") for i in range(30)] + [(f"s{i} t{i}. s{i} u{i}. s{i}. t{i}. " * 11, "en") for i in range(30)]
    calls = []
    monkeypatch.setattr(C, "frontier", lambda *a, f=C.frontier: calls.append(1) or f(*a))
    assert got(C.collocations(frame(spark, rows), 10, 20, 2)) == brute(rows, 10, 20)
    assert len(calls) > 1


def test_hot_pair_and_odd_rows(spark):
    long = "Alpha beta gamma " * 20_000
    rows = [(None, "en"), ("", None), (" \t\n", "en"), (long, "en"), ("w" * 300_000, "de"), ("one two. " * 10, None), ("one two. " * 9, "und"), ("ONE TWO" + "\r", "und"), ("É é. " * 30, "fr"), ("a,b;c:d!e?f" * 20, "fr")] * 2
    rows += [("of the " * 50, "en")] * 40
    assert got(C.collocations(frame(spark, rows))) == brute(rows)
    assert C.collocations(frame(spark, rows).limit(0)).count() == 0
    assert C.collocations(frame(spark, [("rare words only", "en")])).count() == 0


def test_scores_of_large_counts_are_exact(spark):
    rows = [(10**14 - 1, 10**14 + 7, 10**14 + 11), (3, 7, 9), (10**9, 10**9, 10**9), (123456789012345, 123456789012345, 999999999999999)]
    df = spark.createDataFrame(rows, "n long, l long, r long").select("n", "l", "r", C.cut_score("n", "l", "r").alias("s"))
    assert all(x.s == 1000000 * x.n * x.n // (x.l * x.r) for x in df.collect())


def test_small_buffers_give_the_same_counts(spark, monkeypatch):
    rows = [(f"w{i % 50} w{i % 7} w{i % 11} " * 5, "en") for i in range(400)]
    want = brute(rows, 3, 50)
    monkeypatch.setattr(C, "HELD", 20)
    assert got(C.collocations(frame(spark, rows), 3, 50)) == want
