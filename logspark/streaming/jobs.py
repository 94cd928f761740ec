"""Streaming jobs: pipeline, activity, sessions, dedup, statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..operators.alerts import session_fingerprint
from ..operators.normalize import normalize_logs
from ..operators.specs import Spec
from ..session import new_dir
from ..sinks.files import fan_out
from ..sources.lines import numbered


def start_pipeline(lines: DataFrame, specs: tuple[Spec, ...],
                   sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str,
                   trigger: dict | None = None, year: int | None = None, status: str | None = None) -> StreamingQuery:
    """Raw lines to all sinks (str_pipeline). Sinks get the batch id, so a sink that writes below
    it is idempotent on a replay.

    What became of each sink and batch is written to the table ``status`` (see ``sink_status``), and ``retry_failed`` sends a
    batch again; without that table a batch with a failed sink stops the query, and the checkpoint repeats it.
    """
    def batch(df: DataFrame, batch_id: int) -> None:
        df = df if {"line_no", "raw_offset"} & set(df.columns) else numbered(df)  # files arrive whole in a micro-batch
        done = fan_out(normalize_logs(df, specs, year=year), batch_id, sinks)
        if status is not None:
            rows = [(batch_id, name, got == "ok", None if got == "ok" else got) for name, got in done.items()]
            df.sparkSession.createDataFrame(rows, STATUS).coalesce(1).write.mode("overwrite").parquet(f"{status}/batch={batch_id}")
        elif bad := {name: got for name, got in done.items() if got != "ok"}:
            raise RuntimeError(f"batch {batch_id}: {bad}")

    return (lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 second"})).start())


STATUS = "batch_id bigint, sink string, ok boolean, error string"


def sink_status(spark: SparkSession, status: str) -> DataFrame:
    """One row per micro-batch and sink: whether it took the batch, and the error if not."""
    return spark.read.schema(STATUS).parquet(f"{status}/batch=*")


def retry_failed(spark: SparkSession, status: str, stored: Callable[[int], DataFrame],
                 sinks: dict[str, Callable[[DataFrame, int], None]]) -> int:
    """Sends each batch to the sinks that refused it, from where it is ``stored``; returns how many still fail."""
    failed = [(r.batch_id, r.sink) for r in sink_status(spark, status).filter("NOT ok").collect()]
    left = 0
    for batch_id in sorted({b for b, _ in failed}):
        names = [s for b, s in failed if b == batch_id]
        done = fan_out(stored(batch_id), batch_id, {n: sinks[n] for n in names})
        kept = sink_status(spark, status).filter(F.col("batch_id") == batch_id).collect()
        rows = [(batch_id, r.sink, r.ok or done.get(r.sink) == "ok", None if r.ok or done.get(r.sink) == "ok" else done.get(r.sink))
                for r in kept]
        spark.createDataFrame(rows, STATUS).coalesce(1).write.mode("overwrite").parquet(f"{status}/batch={batch_id}")
        left += sum(not r[2] for r in rows)
    return left


def stream_activity(events: DataFrame, ts: str, window: str = "1 hour", slide: str | None = None,
                    watermark: str = "10 minutes") -> DataFrame:
    """Events per bucket (str_activity); a slide makes the buckets overlap."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return (events.withWatermark(ts, watermark).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("bucket"), "n"))


def stream_sessions(alerts: DataFrame, gap: str = "300 seconds", watermark: str = "10 minutes",
                    ts: str = "created_at") -> DataFrame:
    """Alert sessions per fingerprint (str_sessions)."""
    a = alerts.withColumn("fingerprint", session_fingerprint(alerts)).withWatermark(ts, watermark)
    return (a.groupBy("fingerprint", F.session_window(ts, gap).alias("w"))
            .agg(F.count(F.lit(1)).alias("group_size"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))
            .select("fingerprint", "first_seen", "last_seen", "group_size"))


def stream_dedup(df: DataFrame, key: list[str], ts: str, watermark: str = "1 hour") -> DataFrame:
    """First delivery of a key within the watermark (str_dedup)."""
    return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(key)


def _counters() -> list[Column]:
    return [F.count(F.lit(1)).alias("received"),
            F.count_if(F.col("meta.parse_status") == "parsed").alias("parsed"),
            F.count_if(F.size("meta.warnings") > 0).alias("with_warnings")]


def stream_stats(df: DataFrame, name: str) -> DataFrame:
    """Counters of every micro-batch, readable from the query progress, which keeps the last hundred (str_stats)."""
    return df.observe(name, *_counters())


def run_stats(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Runs a stream over what is there now; a row of counters for every micro-batch, replayed ones once."""
    path = new_dir(spark, "stats")
    query = (stream.writeStream
             .foreachBatch(lambda df, i: df.agg(*_counters()).write.mode("overwrite").parquet(f"{path}/batch={i}"))
             .option("checkpointLocation", new_dir(spark, "stats-checkpoint")).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema("received bigint, parsed bigint, with_warnings bigint").parquet(path)


def run_to_table(stream: DataFrame, spark: SparkSession, label: str,
                 customize: Callable[[DataStreamWriter], DataStreamWriter] | None = None) -> DataFrame:
    """Runs a stream over what is there now and returns the table it wrote."""
    path, checkpoint = new_dir(spark, label), new_dir(spark, f"{label}-checkpoint")
    writer = (stream.writeStream.format("parquet").outputMode("append").option("path", path)
              .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    query = (customize(writer) if customize else writer).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
