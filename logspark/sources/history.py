"""Event history, collector batches and their identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pyspark.sql.types import StringType, StructField, StructType

from ..functions.base import strip
from ..schema import EVENT

ITEM_META = ["source_type", "address", "transport", "received_time", "offset", "agent_id", "agent_name"]


def read_events_jsonl(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Events of JSON lines; lines that do not parse are dropped (src_jsonl).

    ``limit`` keeps the newest ones by a distributed top-k.
    """
    schema = StructType([*EVENT.fields, StructField("_corrupt", StringType())])
    df = (spark.read.schema(schema).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt").json(path))
    good = df.filter(F.col("ues").isNotNull() & F.col("trace.trace_id").isNotNull()).select(*EVENT_COLUMNS)
    if limit is None:
        return good
    return good.orderBy(F.col("ues.event_time").desc(), F.col("trace.trace_id")).limit(limit)


EVENT_COLUMNS = ["ues", "meta", "trace", "raw"]


def fingerprint(df: DataFrame, skip: tuple[str, ...] = ("_spool_id",)) -> Column:
    """SHA-256 of the canonical JSON of an item: its fields by name, the spool id left out."""
    names = sorted(x for x in df.columns if x not in skip)
    return F.sha2(F.to_json(F.struct(*[F.col(x) for x in names])), 256)


def ingest_batch(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Collector items to (accepted, rejected) (src_agent_batch).

    Items without text are rejected; of identical items one is accepted.
    """
    blank = F.coalesce(strip(F.col("raw")), F.lit("")) == ""
    rejected = df.filter(blank)
    marked = df.withColumn("agent_fingerprint", fingerprint(df)).filter(~blank)
    kept = [x for x in ITEM_META if x in df.columns]
    accepted = marked.select("raw", *kept, "agent_fingerprint").dropDuplicates(["agent_fingerprint"])
    return accepted, rejected


def collector_fingerprint(df: DataFrame) -> Column:
    """Queue identity: agent, address and the offset, else the event record id, else the text."""
    parsed = F.try_parse_json(F.col("raw"))
    record = F.coalesce(F.try_variant_get(parsed, "$.Id", "string"),
                        F.try_variant_get(parsed, "$.RecordId", "string"))
    identity = F.coalesce(F.col("offset").cast("string"), record, F.col("raw"))
    return F.sha2(F.concat(F.coalesce(F.col("agent_id"), F.lit("")), F.lit("|"),
                           F.coalesce(F.col("address"), F.lit("")), F.lit("|"), identity), 256)


def collector_dedup(df: DataFrame, order: str) -> DataFrame:
    """First item per queue identity (src_spool_dedup)."""
    named = df.withColumn("fingerprint", collector_fingerprint(df))
    first = named.groupBy("fingerprint").agg(F.min(order).alias(order))
    return named.join(first, ["fingerprint", order], "left_semi").dropDuplicates(["fingerprint"])
