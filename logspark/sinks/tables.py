"""Table projections and keyed writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.base import first_present, present
from ..functions.severity import severity_store, severity_store_label
from ..operators.windows import latest


def flatten_events(events: DataFrame) -> DataFrame:
    """The flat 22-column events table (snk_flat_events)."""
    u = "ues."
    return events.select(
        F.col("trace.trace_id").alias("trace_id"), F.col(u + "event_id").alias("event_id"),
        F.col(u + "ingest_time").alias("ingest_time"), F.col(u + "event_time").alias("event_time"),
        F.col(u + "category").alias("category"), F.col(u + "type").alias("type"),
        F.col(u + "action").alias("action"), F.col(u + "outcome").alias("outcome"),
        F.col(u + "severity").alias("severity"), F.col(u + "severity_label").alias("severity_label"),
        F.col(u + "source.ip").alias("source_ip"), F.col(u + "source.port").alias("source_port"),
        F.col(u + "destination.ip").alias("destination_ip"),
        F.col(u + "destination.port").alias("destination_port"),
        F.col(u + "network.transport").alias("transport"), F.col(u + "user.name").alias("user"),
        F.col(u + "device.host").alias("device_host"), F.col(u + "message").alias("message"),
        F.col("meta.parser").alias("parser"), F.col(u + "threat.score").alias("threat_score"),
        F.when(F.col(u + "threat.matched").isNotNull(), F.to_json(u + "threat")).alias("threat"),
        F.to_json(F.struct("ues", "meta", "trace", "raw")).alias("event_json"))


def _json(col: str) -> Column:
    return F.to_json(F.col(col))


def to_tables(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, raw_events, lineage) rows of the relational store (snk_relational)."""
    sev = severity_store(F.col("ues.severity").cast("string"))
    raw_hash = F.coalesce(present(F.col("trace.raw_hash")), F.sha2(F.coalesce("raw", F.lit("")), 256))
    transport = first_present("meta.source_transport", "ues.network.transport")
    main = events.select(
        F.col("trace.trace_id").alias("trace_id"),
        first_present("ues.event_id", "trace.trace_id").alias("event_id"),
        F.col("meta.agent_fingerprint").alias("idempotency_key"),
        F.col("ues.event_time").alias("event_time"), F.col("ues.ingest_time").alias("ingest_time"),
        F.col("meta.received_time").alias("received_time"), F.col("meta.source_type").alias("source_type"),
        first_present("meta.source_address", "ues.source.ip").alias("source_address"),
        transport.alias("source_transport"), transport.alias("transport"),
        F.col("meta.parser").alias("parser"), F.lit(None).cast("string").alias("parser_version"),
        F.col("meta.pipeline_id").alias("pipeline_id"), F.col("meta.pipeline_version").alias("pipeline_version"),
        F.col("meta.format").alias("format"), F.coalesce("meta.parse_status", F.lit("success")).alias("parse_status"),
        sev.alias("severity"),
        F.coalesce(present(F.col("ues.severity_label")), severity_store_label(sev)).alias("severity_label"),
        F.col("ues.device.vendor").alias("vendor"), F.col("ues.device.product").alias("product"),
        F.col("meta.agent_id").alias("agent_id"), raw_hash.alias("raw_hash"),
        F.coalesce("trace.raw_size", F.octet_length("raw").cast("bigint")).alias("raw_size"),
        F.lit("").alias("raw_path"), F.coalesce("ues.schema_version", F.lit("1.0")).alias("schema_version"),
        F.to_json(F.struct("ues", "meta", "trace", "raw")).alias("event_json"),
        _json("meta").alias("meta_json"), _json("ues").alias("ues_json"))
    raw = events.select(
        F.concat(F.lit("RAW-"), F.substring(raw_hash, 1, 20)).alias("raw_event_id"),
        F.col("trace.trace_id").alias("trace_id"), raw_hash.alias("sha256"),
        F.octet_length("raw").cast("bigint").alias("raw_size"), F.col("raw").alias("raw_payload"),
        F.col("meta.received_time").alias("received_time"))
    rows = events.select(F.col("trace.trace_id").alias("trace_id"), F.explode_outer("trace.lineage").alias("l"))
    return main, raw, rows.filter("l IS NOT NULL").select("trace_id", "l.*")


def replace_lineage(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Lineage of a trace is replaced as a whole when the event comes again."""
    return stored.join(fresh.select("trace_id").distinct(), "trace_id", "left_anti").unionByName(fresh)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: list[str],
           update_cols: list[str] | None = None) -> DataFrame:
    """Insert, or on a known key set the chosen columns (snk_upsert).

    Update columns the target does not have are dropped. ``update_cols=[]`` means do nothing on a
    known key. Within the updates the newest row of a key counts.
    """
    cols = target.columns
    new = latest(updates, keys, order)
    new = new.select(*[x for x in new.columns if x in cols])
    chosen = [x for x in (new.columns if update_cols is None else update_cols)
              if x in new.columns and x not in keys]
    n = new.select(*keys, F.lit(True).alias("_hit"),
                   *[F.col(x).alias(f"_n_{x}") for x in new.columns if x not in keys])
    t = target.withColumn("_old", F.lit(True))
    j = t.join(n, keys, "full_outer")
    old = F.coalesce("_old", F.lit(False))

    def value(x: str) -> Column:
        if x in keys or x not in new.columns:
            return F.col(x)
        if x in chosen:
            return F.when(F.coalesce("_hit", F.lit(False)), F.col(f"_n_{x}")).otherwise(F.col(x)).alias(x)
        return F.when(old, F.col(x)).otherwise(F.col(f"_n_{x}")).alias(x)

    return j.select(*[value(x) for x in cols])


def alert_rows(alerts: DataFrame) -> DataFrame:
    """Alerts as stored: rule, severity number and label, status (snk_alert_rows)."""
    def opt(*names: str) -> Column:
        have = [F.col(n).cast("string") for n in names if n in alerts.columns]
        return first_present(*have) if have else F.lit(None).cast("string")

    sev = severity_store(opt("severity"))
    acknowledged = F.coalesce("acknowledged", F.lit(False)) if "acknowledged" in alerts.columns else F.lit(False)
    return alerts.select(
        "alert_id", opt("trace_id").alias("trace_id"),
        F.coalesce(F.trim(opt("rule_id", "rule")), F.lit("unknown-rule")).alias("rule_id"),
        sev.alias("severity"),
        F.coalesce(opt("severity_label"), F.when(
            ~opt("severity").rlike(r"^\d+$"), F.lower(F.trim(opt("severity")))), severity_store_label(sev)
            ).alias("severity_label"),
        F.coalesce(opt("title"), F.lit("Security Alert")).alias("title"),
        F.coalesce(opt("description"), F.lit("")).alias("description"),
        opt("source_ip", "src_ip").alias("source_ip"), opt("destination_ip", "dst_ip").alias("destination_ip"),
        F.when(acknowledged, "acknowledged").otherwise(F.coalesce(opt("status"), F.lit("open"))).alias("status"))


def case_rows(cases: DataFrame) -> DataFrame:
    """Cases as stored, keyed by correlation_id (snk_case_rows)."""
    return cases.select(
        "correlation_id", "rule_id", F.col("type").alias("case_type"), "title", "description", "severity",
        "risk_score", "source_ip", F.col("user").alias("username"), "event_count", "first_seen", "last_seen",
        F.to_json("trace_ids").alias("trace_ids"), F.to_json("evidence").alias("evidence"),
        F.lit("open").alias("status"))
