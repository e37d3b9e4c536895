"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from tidepool.plans.queries import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in Path(DIR).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 5)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def rows(data, cols):
    return sorted(repr([plain(r[c]) for c in cols]) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    want = duck.sql(ORACLE[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert rows([r.asDict() for r in got.collect()], cols) == rows([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], cols)


def test_queries_without_sql_are_few():
    assert sorted(set(QUERIES) - set(ORACLE)) == ["c19_silhouette", "f4_kmer_word2vec", "f6_select_features", "f7_reduce_dims", "j9_hybrid_route", "k1_otu_cluster", "k3_classify_supervised", "k4_classify", "k5_train_rf", "k6_train_eval", "k7_kmer_rf", "s1_supervised_stream"]
