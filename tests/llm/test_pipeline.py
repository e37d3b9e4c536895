"""The pipeline's stages against brute force, each on its own input."""

import re

import pytest
from pyspark.sql import functions as F

from test_llm_operators import MORE as DIR
from test_llm_operators import TOKENIZER, check_packing, groups

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark):
    from tidepool.llm.common import table, written

    out = [table(spark, DIR, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], DIR), name))
    return [x.collect() for x in out]


def test_columns_and_toxicity(spark, stages):
    assert all(r.__fields__ == stages[0][0].__fields__ for r in stages[1])
    gone = {r.doc_id for r in stages[0]} - {r.doc_id for r in stages[1]}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    assert gone and all(labels.get(i, 1) for i in gone)


def test_line_dedup(stages):
    from tidepool.llm.line_dedup import DEDUP_SQL

    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("before", pd.DataFrame([(r.doc_id, r.text) for r in stages[1]], columns=["doc_id", "text"]))
    want = con.sql(DEDUP_SQL.format(documents="before", columns="x.doc_id, k.kept")).fetchall()
    assert sorted(want) == sorted((r.doc_id, r.text) for r in stages[2])


def test_similar_documents(stages):
    want = {c for _, c in groups([(r.doc_id, r.text) for r in stages[2]]).values()}
    assert sorted(want) == sorted(r.doc_id for r in stages[3])


def test_contaminated_documents(spark, stages):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    items = [word.findall(lower(r.text)) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    windows: dict = {}
    for w in items:
        n = min(13, len(w))
        for p in range(len(w) - n + 1) if w else ():
            windows.setdefault(n, set()).add(tuple(w[p : p + n]))
    clean = []
    for r in stages[3]:
        w = word.findall(lower(r.text))
        hit = {p + j for n, own in windows.items() for p in range(len(w) - n + 1) if tuple(w[p : p + n]) in own for j in range(n)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append(r.doc_id)
    assert sorted(clean) == sorted(r.doc_id for r in stages[4])


def test_packed(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    check_packing(stages[5], [(r.doc_id, [*t.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in stages[4]], 1024)


def test_run_is_the_stages_in_a_row(spark, stages):
    key = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df)
    got = corpus_pipeline.run(spark, DIR).select("doc_id", "piece", "length", "ids_crc32", F.col("sequence_id")).collect()
    assert key(got) == key(stages[5])


def test_stages_carry_any_column(spark):
    """Columns with the names of helpers and results, on awkward rows and on none, with nulls in every column."""
    from test_llm_operators import CLASHES

    names = [*CLASHES, "n", "id", "own", "_id", "doc_id_", "sequence_id", "text_"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)
    texts = [None, "", " \n ", "word " * 40_000, "one two three four five six", "one two three four five six", "a\nb\nc\nd", "q\na\nb\nc", "é <|endoftext|>", "x" * 100_000]
    rows = [(i if i != 5 else None, t, None, "s", None, *[None if i == 2 else f"{c}{i}" for c in names]) for i, t in enumerate(texts)]
    rows.append(rows[6])
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        start = {(r.doc_id, *[r[c] for c in names]) for r in docs.collect()}
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DIR)
            if name == "packing":
                assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
                assert {r.doc_id for r in out.collect()} == {x[0] for x in start}
                continue
            got = out.collect()
            assert out.columns == docs.columns
            assert {(r.doc_id, *[r[c] for c in names]) for r in got} <= start
            if name in ("toxicity", "line_dedup", "decontamination"):
                assert len(got) == docs.count()
