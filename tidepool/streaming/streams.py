"""The three streams. Each has a batch twin that gives the same rows on the same input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import models
from ..sources.readers import fasta_records, parse_logs
from ..storage import scratch, written

__all__ = ["RunState", "bundle_classifier", "classify_stream", "drain", "embed_and_classify", "fold_stream", "log_level_counts", "log_windows", "read_fasta_stream", "reject_reason"]


def read_fasta_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Records of new sequence files as they arrive."""
    raw = spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return fasta_records(raw.select("value", F.col("_metadata.file_path").alias("file"), F.lit(0).cast("long").alias("at")))


def reject_reason(records: DataFrame) -> Column:
    """Why a record can't be classified; null if it can: no_id (a record without a name), empty_sequence, or not_a_sequence
    (signs that no sequence has, as in a file of another kind)."""
    s = F.upper("sequence")
    return F.when(F.coalesce(F.trim("sequence_id"), F.lit("")) == "", "no_id").when(F.coalesce(F.length(s), F.lit(0)) == 0, "empty_sequence").when(~s.rlike("^[A-Z*.-]+$"), "not_a_sequence")


def classify_stream(records: DataFrame, classify: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, rejects: str | None = None):
    """A query that classifies each batch of records (a function of a DataFrame) and appends the rows.

    A batch is a folder of its own, which a repeated batch replaces, so that after a failure every record is
    there once. With ``rejects``, records that can't be classified go there by batch as (file, sequence_id,
    reason), and the others of their file and batch go on.
    """

    def each(batch: DataFrame, number: int) -> None:
        with scratch():
            if rejects is not None:
                batch = written(batch.withColumn("reason", reject_reason(batch)), "arrived")
                batch.where("reason IS NOT NULL").select("file", "sequence_id", "reason").write.mode("overwrite").parquet(f"{rejects}/batch={number}")
                batch = batch.where("reason IS NULL").drop("reason")
            classify(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def embed_and_classify(classify: Callable[[DataFrame], DataFrame], encoder: Callable | None = None) -> Callable[[DataFrame], DataFrame]:
    """The function for ``classify_stream`` that turns records into vectors and classifies those: ``classify`` gets
    sequence_id and embedding."""
    return lambda records: classify(models.embed(records, encoder, seq="sequence"))


def bundle_classifier(bundle: models.Bundle, threshold: float = 0.0) -> Callable[[DataFrame], DataFrame]:
    """Prediction rows of a bundle's classifier for a batch of records."""
    return embed_and_classify(lambda e: models.classify_bundle(models.as_vector(e), bundle, threshold))


def log_windows(rows: DataFrame, size: str = "1 hour") -> DataFrame:
    """(start, level, n) of rows (ts, level): tumbling windows."""
    return rows.groupBy(F.window("ts", size).alias("w"), "level").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "level", "n")


def log_level_counts(lines: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of log lines by level and window; lines later than the watermark are dropped."""
    rows = parse_logs(lines).withColumn("ts", F.try_to_timestamp("timestamp")).where(F.col("ts").isNotNull())
    return log_windows(rows.withWatermark("ts", late), size)


#: What a run's updates may give, and what ends a run.
FIELDS = ("status", "progress", "message")
ENDS = ("completed", "failed")


class RunState(StatefulProcessor):
    """The state of one run: of each field, and of each step, the value given last by (ts, seq).

    The order of an update is kept with its value, so that an older one that arrives in a later batch
    doesn't overwrite a newer one. An update of a step that is named changes that step, others the
    first step. The state is read and written once a batch, however many updates a run has in it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        given = "array<struct<name: string, value: string, ts: bigint, seq: bigint>>"
        self.state = handle.getValueState("run", f"fields {given}, steps {given}, updates long, end_time long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        fields, steps, n, end = self.state.get() or ((), (), 0, None)
        fields, steps = ({name: (value, ts, seq) for name, value, ts, seq in given} for given in (fields, steps))

        def newer(given: dict, name: str, value: str, ts, seq) -> None:
            old = given.get(name)
            if old is None or (old[1], old[2]) <= (ts, seq):
                given[name] = (value, ts, seq)

        for r in rows:
            n += 1
            for f in FIELDS:
                if r[f] is not None:
                    newer(fields, f, str(max(0, min(100, r[f]))) if f == "progress" else r[f], r["ts"], r["seq"])
            if r["status"] in ENDS:
                end = r["ts"] if end is None else max(end, r["ts"])
            if r["step_status"] is not None:
                newer(steps, r["step"] or "", r["step_status"], r["ts"], r["seq"])
        self.state.update((*([(name, *x) for name, x in given.items()] for given in (fields, steps)), n, end))
        status, progress, message = (fields[f][0] if f in fields else None for f in FIELDS)
        yield Row(run_id=key[0], status=status, progress=None if progress is None else int(progress), message=message, end_time=end, updates=n, steps=",".join(f"{k}={x[0]}" for k, x in sorted(steps.items())))

    def close(self) -> None:
        pass


def fold_stream(updates: DataFrame, first_step: str = "") -> DataFrame:
    """Every run's state after each batch of updates (run_id, ts, seq, status, progress, message and perhaps
    step, step_status), in whatever order they arrive. ``steps`` lists step=status pairs by name.
    Needs the RocksDB state store."""
    for c in ("step", "step_status"):
        if c not in updates.columns:
            updates = updates.withColumn(c, F.lit(None).cast("string"))
    # an update without a step's name means the first step
    updates = updates.withColumn("step", F.coalesce("step", F.lit(first_step)))
    # times go through Python as microseconds, which no time zone changes
    updates = updates.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))
    schema = "run_id long, status string, progress int, message string, end_time long, updates long, steps string"
    return updates.groupBy("run_id").transformWithState(RunState(), schema, outputMode="Update", timeMode="None").withColumn("end_time", F.timestamp_micros("end_time"))


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that has arrived, into Parquet files, and stop."""
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    else:
        q = stream.writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}")).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
