"""Streams give the rows of their batch twins."""

import datetime
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidepool.operators import models, runs
from tidepool.schema import RANKS
from tidepool.streaming import streams

T = datetime.datetime(2024, 1, 1)
H = datetime.timedelta(hours=1)
UPDATES = [
    (1, T, 1, "running", 10, None, None, "queued"), (2, T, 2, None, 200, "over", "embed", "running"), (1, T + H, 3, None, None, "half", None, "done"), (2, T + 2 * H, 4, "failed", None, None, "embed", "failed"),
    (1, T + 3 * H, 5, "completed", -5, None, "classify", None), (3, T, 6, None, None, None, None, None), (1, T + 3 * H, 7, None, 40, None, "classify", "running"),
]
SCHEMA = "run_id long, ts timestamp, seq long, status string, progress int, message string, step string, step_status string"


@pytest.mark.parametrize("late", [False, True])
def test_run_states(spark, tmp_path, late):
    """In order, and with the newest updates in the first batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    df = spark.createDataFrame(UPDATES, SCHEMA)
    for i in range(2):  # two files, so two batches
        df.where((F.col("seq") <= 3) if (i == 0) != late else (F.col("seq") > 3)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1)  # files are taken by age
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.drain(streams.fold_stream(stream, "first"), str(tmp_path / "out"), str(tmp_path / "state"), "update")
    every = spark.read.parquet(str(tmp_path / "out" / "batch=*"))
    last = every.groupBy("run_id").agg(F.max_by(F.struct(*every.columns), "updates").alias("r")).select("r.*")
    want = runs.fold_updates(df, first_step="first").select(*last.columns)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))
    got = {r.run_id: r for r in last.collect()}
    assert (got[1].status, got[1].progress, got[1].message, got[1].steps) == ("completed", 40, "half", "classify=running,first=done")
    assert (got[2].status, got[2].progress, got[2].steps, got[3].steps) == ("failed", 100, "embed=failed", "")


def test_log_counts(spark, tmp_path):
    lines = [f"2024-01-01 0{h}:30:00 - {level} - x" for h in (1, 2, 5) for level in ("INFO", "ERROR")] + ["no separators"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(str(tmp_path / "in"))
    stream = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "line")
    streams.drain(streams.log_level_counts(stream), str(tmp_path / "out"), str(tmp_path / "state"), "complete")
    assert sorted((r.start.hour, r.level, r.n) for r in spark.read.parquet(str(tmp_path / "out" / "batch=*")).collect()) == [(h, x, 1) for h in (1, 2, 5) for x in ("ERROR", "INFO")]


def test_late_lines_are_dropped(spark, tmp_path):
    for i, hours in enumerate([(1, 9), (2, 9)]):
        spark.createDataFrame([(f"2024-01-01 0{h}:30:00 - INFO - {i}",) for h in hours], "value string").coalesce(1).write.mode("append").text(str(tmp_path / "in"))
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in")).withColumnRenamed("value", "line")
    streams.drain(streams.log_level_counts(stream, late="1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r.start.hour: r.n for r in spark.read.schema("start timestamp, level string, n long").parquet(str(tmp_path / "out")).collect()}
    assert got in ({1: 1}, {1: 1, 2: 1}) and 9 not in got  # the last window is still open; files may come in either order


def test_arriving_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">a x\nAC\nGT\n>b\nT\n")
    size = lambda batch: batch.select("sequence_id", F.length("sequence").cast("long").alias("length"))
    for _ in range(2):
        streams.classify_stream(streams.read_fasta_stream(spark, str(tmp_path / "in")), size, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        got = sorted(map(tuple, spark.read.schema("sequence_id string, length long").parquet(str(tmp_path / "out" / "batch=*")).collect()))
        (tmp_path / "in" / "b.fa").write_text(">c\nGGG\n")
    assert got == [("a", 4), ("b", 1), ("c", 3)]


def test_bad_records_are_noted_and_others_go_on(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">a x\nAC\nGT\n>empty\n\n>b\nT\n> \nACGT\n")
    (tmp_path / "in" / "b.fa").write_text("{\"json\": [1, 2]}\nnot a sequence: 1, 2, 3\n")
    size = lambda batch: batch.select("sequence_id", F.length("sequence").cast("long").alias("length"))
    for _ in range(2):  # nothing new arrives the second time
        streams.classify_stream(streams.read_fasta_stream(spark, str(tmp_path / "in")), size, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "rejects")).awaitTermination()
    assert sorted(map(tuple, spark.read.schema("sequence_id string, length long").parquet(str(tmp_path / "out" / "batch=*")).collect())) == [("a", 4), ("b", 1)]
    bad = spark.read.schema("file string, sequence_id string, reason string").parquet(str(tmp_path / "rejects" / "batch=*")).collect()
    assert sorted((r.file[-4:], r.reason) for r in bad) == [("a.fa", "empty_sequence"), ("a.fa", "no_id"), ("b.fa", "not_a_sequence")]


def test_a_bundle_classifies_a_stream_as_a_batch(spark, tmp_path):
    """Train, save with the taxonomy, load, and classify files that arrive one by one."""
    seqs = [("ACGT" * 20, "b1"), ("AAAAC" * 16, "b2")] * 6
    train = spark.createDataFrame([(f"t{i}", s, x) for i, (s, x) in enumerate(seqs)], "sequence_id string, seq string, label string")
    e = models.embed(train).join(train.select("sequence_id", "label"), "sequence_id")
    model, accuracy = models.train_rf(models.as_vector(e), trees=9)
    assert accuracy == 1.0
    known = spark.createDataFrame([("b1", *["K", "P", "C", "O", "F", "G", "S"])], "label string, " + ", ".join(f"`{r}` string" for r in RANKS))
    models.save_bundle(models.Bundle(model, known), f"file://{tmp_path}/bundle")
    models.save_bundle(models.Bundle(model, known), f"file://{tmp_path}/bundle")  # replaces itself
    bundle = models.load_bundle(spark, f"file://{tmp_path}/bundle")
    (tmp_path / "in").mkdir()
    for i, (s, _) in enumerate(seqs[:4]):
        (tmp_path / "in" / f"{i}.fa").write_text(f">s{i} some read\n{s[:40]}\n{s[40:]}\n")
    streams.classify_stream(streams.read_fasta_stream(spark, str(tmp_path / "in"), 1), streams.bundle_classifier(bundle, 0.2), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert len(list((tmp_path / "out").iterdir())) == 4
    got = spark.read.parquet(str(tmp_path / "out" / "batch=*"))
    rows = spark.createDataFrame([(f"s{i}", s) for i, (s, _) in enumerate(seqs[:4])], "sequence_id string, seq string")
    want = models.classify_bundle(models.as_vector(models.embed(rows)), bundle, 0.2)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    ranks = {r.sequence_id: (r.predicted_label, r.kingdom, r.species, r.method) for r in got.collect()}
    assert ranks["s0"] == ("b1", "K", "S", "supervised_taxonomy") and ranks["s1"][0] == "b2" and ranks["s1"][1] == "b2"


def test_states_are_read_and_written_once_a_batch():
    class State:
        def __init__(self):
            self.value, self.calls = None, 0

        def getValueState(self, name, schema):  # noqa: N802
            return self

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

    state, run = State(), streams.RunState()
    run.init(state)
    for batch in range(2):
        rows = [Row(run_id=1, ts=batch, seq=100 * batch + i, status="running", progress=i, message=None, step=f"s{i % 3}", step_status=str(i)) for i in range(100)]
        (got,) = run.handleInputRows((1,), iter(rows), None)
    assert state.calls == 4 and (got.updates, got.progress, got.steps) == (200, 99, "s0=99,s1=97,s2=98")


def test_updates_come_in_four_batches(spark, monkeypatch):
    """However many files the table has."""
    from pathlib import Path

    from tidepool.plans import analysis_queries as q
    from tidepool.plans import views

    table = views.v_updates(spark, "/root/testdata/sf0.001").repartition(24).persist()
    monkeypatch.setattr(q.v, "v_updates", lambda s, d: table)
    paths = []
    drain = streams.drain
    monkeypatch.setattr(q.streams, "drain", lambda df, path, *rest: (paths.append(path), drain(df, path, *rest)))
    assert q.s2_stream(spark, "").count() > 0
    assert len(list(Path(paths[0].removeprefix("file://")).glob("batch=*"))) == 4
    table.unpersist()


def test_arriving_batches_are_few(spark, monkeypatch):
    """Forty files are four batches, not fourteen."""
    from tidepool.plans import analysis_queries as q

    reads = q.v.v_reads(spark, "/root/testdata/sf0.001").repartition(40)
    monkeypatch.setattr(q.v, "v_reads", lambda s, d: reads)
    path, files = q.arriving(spark, "")
    n = len(spark.read.text(path).inputFiles())
    assert n > 12 and -(-n // files) <= 4
