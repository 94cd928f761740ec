"""File, topic and fan-out sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.timestamps import iso_ms
from ..session import new_dir, remove

EVENT = ("ues", "meta", "trace", "raw")


def _event(df: DataFrame) -> Column:
    return F.struct(*[F.col(x) for x in EVENT if x in df.columns])


def to_json_lines(events: DataFrame, pretty: bool = False) -> DataFrame:
    """One JSON document per event (snk_stdout)."""
    options = {"pretty": "true"} if pretty else {}
    return events.select(F.to_json(_event(events), options).alias("value"))


def write_jsonl(events: DataFrame, path: str, include_raw: bool = True,
                max_records_per_file: int = 0) -> None:
    """JSON lines by day (snk_jsonl). ``include_raw=False`` blanks the raw text;
    ``max_records_per_file`` rotates."""
    out = events if include_raw else events.withColumn("raw", F.lit(""))
    writer = out.withColumn("dt", F.to_date("ues.event_time")).write.partitionBy("dt")
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    writer.mode("append").json(path)


# --- evidence archive ------------------------------------------------------------------------
def archive_rows(events: DataFrame, slots: int = 16) -> DataFrame:
    """Evidence rows with their block: a day is split by hash slot, so blocks fill in parallel."""
    return events.select(
        iso_ms("ues.ingest_time").alias("ts"), F.col("trace.trace_id").alias("trace_id"),
        F.col("trace.raw_hash").alias("hash"), "raw", F.to_date("ues.ingest_time").alias("dt"),
        F.pmod(F.xxhash64("trace.trace_id"), F.lit(slots)).cast("int").alias("slot"))


def write_archive(events: DataFrame, path: str, slots: int = 16) -> None:
    """Append-only evidence store (snk_raw_archive)."""
    archive_rows(events, slots).write.mode("append").partitionBy("dt", "slot").json(path)


def archive_manifest(rows: DataFrame, block: list[str] | None = None) -> DataFrame:
    """Count, digest and chained hash per block of evidence rows.

    The digest adds up per-row hashes, so a block is reduced on the map side and its hashes are
    never gathered. The chain then runs over the blocks, of which there are few: one per day and
    slot.
    """
    keys = block or ["dt", "slot"]
    h = F.sha2(F.concat_ws("|", "trace_id", "hash"), 256)
    # 60-bit pieces of the row hash, summed in decimals: independent of the row order.
    pieces = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}")
              for i in range(4)]
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *pieces)
    digests = sums.select(*keys, "n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), *[
        F.col(f"s{i}").cast("string") for i in range(4)]), 256).alias("digest"))
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    chain = digests.withColumn("block", name).groupBy().agg(
        F.array_sort(F.collect_list(F.struct("block", "n", "digest"))).alias("b"))
    start = F.array().cast("array<struct<block:string,n:bigint,digest:string,prev:string,chain:string>>")

    def step(acc: Column, x: Column) -> Column:
        prev = F.coalesce(F.try_element_at(acc, F.lit(-1))["chain"], F.lit(""))
        link = F.sha2(F.concat_ws("|", prev, x["block"], x["digest"]), 256)
        return F.concat(acc, F.array(F.struct(
            x["block"].alias("block"), x["n"].alias("n"), x["digest"].alias("digest"),
            prev.alias("prev"), link.alias("chain"))))

    return chain.select(F.explode(F.aggregate("b", start, step)).alias("x")).select("x.*")


def raw_store_rows(events: DataFrame) -> DataFrame:
    """Raw text with year, month, day, source and a safe name (snk_raw_store)."""
    def safe(col: Column) -> Column:
        return F.regexp_replace(F.coalesce(F.when(col != "", col), F.lit("unknown")), r"[^A-Za-z0-9_.-]+", "_")

    t = F.coalesce("meta.received_time", "ues.ingest_time")
    return events.select(
        F.col("raw").alias("value"), safe(F.col("trace.trace_id")).alias("name"),
        F.col("trace.raw_hash").alias("raw_hash"), F.octet_length("raw").cast("bigint").alias("raw_size"),
        F.date_format(t, "yyyy").alias("year"), F.date_format(t, "MM").alias("month"),
        F.date_format(t, "dd").alias("day"), safe(F.col("meta.source_type")).alias("source"))


def write_raw_store(events: DataFrame, path: str) -> None:
    raw_store_rows(events).write.mode("append").partitionBy("year", "month", "day", "source").parquet(path)


def bulk_lines(events: DataFrame, index: str) -> DataFrame:
    """Action line and document line per event (snk_bulk_ndjson)."""
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index")).alias("index")))
    return events.select(F.col("trace.trace_id").alias("trace_id"), F.posexplode(F.array(
        action, F.to_json(_event(events)))).alias("pos", "value"))


def topic_rows(events: DataFrame) -> DataFrame:
    """Key and JSON value of a topic record."""
    return events.select(F.col("trace.trace_id").alias("key"), F.to_json(_event(events)).alias("value"))


def write_topic(events: DataFrame, servers: str, topic: str) -> None:
    """To a Kafka topic (snk_kafka); needs the Kafka connector on the class path."""
    (topic_rows(events).write.format("kafka").option("kafka.bootstrap.servers", servers)
     .option("topic", topic).save())


def write_noop(df: DataFrame) -> None:
    """Compute and discard (snk_null)."""
    df.write.format("noop").mode("overwrite").save()


def fan_out(batch: DataFrame, batch_id: int, sinks: dict[str, Callable[[DataFrame, int], None]]) -> dict:
    """The batch to every sink; a sink that fails is counted and does not stop the others
    (snk_fanout).

    One sink gets the batch as it is. Several read it from the shared folder, where it stays until all are done: computed
    once, and not kept in executors' memory, which a batch of events exceeds.
    """
    counts, path = {}, new_dir(batch.sparkSession, "fan-out") if len(sinks) > 1 else None
    try:
        batch = batch if path is None else _stored(batch, path)
        for name, sink in sinks.items():
            try:
                sink(batch, batch_id)
                counts[name] = "ok"
            except Exception as error:  # the other sinks must still get the batch
                counts[name] = f"failed: {type(error).__name__}: {error}"
    finally:
        if path is not None:
            remove(batch.sparkSession, path)
    return counts


def _stored(batch: DataFrame, path: str) -> DataFrame:
    try:
        batch.write.parquet(path)
    except Exception:  # rows that fail, or a type that Parquet lacks: each sink meets it by itself and is counted
        return batch
    return batch.sparkSession.read.schema(batch.schema).parquet(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "ts string, trace_id string, hash string, raw string, dt date, slot int").json(path)
