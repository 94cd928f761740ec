"""Log lines and normalized events derived from the ``events`` table.

Deterministic column expressions only, so an expected value can be computed from the columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions.timestamps import epoch_ms, ms_precision
from .schema import META, SCHEMA_VERSION, TRACE, UES, build

FORMATS = ["kv", "json", "cef", "leef", "syslog", "csv", "xml"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deals a narrow table out by a key before lines are made of it, in as many parts as a shuffle has; parsing is far
    dearer than moving it."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _by_type(default: str | None, **values: str) -> Column:
    out = None
    for kind, value in values.items():
        cond = F.col("event_type") == kind
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out.otherwise(F.lit(default))


def fields(df: DataFrame) -> DataFrame:
    """The event columns every view is built from."""
    t = ms_precision(F.col("ts").cast("timestamp"))
    error = F.col("event_type") == "error"
    return df.select(
        "event_id", t.alias("t"),
        F.concat(F.lit("T"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("tid"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 16).cast("string")).alias("src"),
        F.concat(F.lit("203.0.113."), (F.col("event_id") % 256).cast("string")).alias("dst"),
        (F.lit(1024) + F.col("event_id") % 60000).cast("int").alias("sport"),
        F.when(error & (F.col("event_id") % 2 == 0), 22).otherwise(443).alias("dport"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("usr"),
        _by_type("allow", error="deny").alias("act"),
        _by_type(None, error="failure", signup="success").alias("outc"),
        _by_type("web", error="authentication", signup="authentication", purchase="privilege",
                 click="discovery").alias("cat"),
        (F.col("value") * 100).cast("bigint").alias("nbytes"),
        F.col("event_type").alias("kind"),
        F.when(error, 70).when(F.col("event_type") == "purchase", 85).otherwise(10).alias("sev"),
    )


def lines(df: DataFrame, fmt: str | None = None) -> DataFrame:
    """Raw lines of the ``events`` rows; the format follows ``event_id % 7`` or is given."""
    f = fields(df)
    iso = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    bsd = F.date_format("t", "MMM d HH:mm:ss")
    o = F.coalesce(F.col("outc"), F.lit(""))
    s = {k: F.col(k).cast("string") for k in ("src", "dst", "sport", "dport", "usr", "act", "cat", "nbytes")}

    def pairs(*items: tuple[str, Column], sep: str = " ", quote: str = "") -> Column:
        return F.concat_ws(sep, *[F.concat(F.lit(f"{k}={quote}"), v, F.lit(quote)) for k, v in items])

    common = [("src", s["src"]), ("dst", s["dst"]), ("spt", s["sport"]), ("dpt", s["dport"]),
              ("act", s["act"]), ("suser", s["usr"]), ("bytes_out", s["nbytes"])]
    said = F.when(F.col("outc").isNotNull(), F.concat(F.lit("outcome="), o))
    texts = {
        "kv": F.concat_ws(" ", F.concat(F.lit("timestamp="), iso), pairs(
            ("srcip", s["src"]), ("dstip", s["dst"]), ("srcport", s["sport"]), ("dstport", s["dport"]),
            ("action", s["act"])), pairs(("user", s["usr"]), quote='"'),
            pairs(("sentbyte", s["nbytes"])), said),
        "json": F.to_json(F.struct(
            iso.alias("timestamp"),
            F.struct(F.col("src").alias("ip"), F.col("sport").alias("port")).alias("source"),
            F.col("dst").alias("dst_ip"), F.col("dport").alias("dst_port"), F.col("act").alias("action"),
            F.col("usr").alias("username"), F.col("nbytes").alias("bytes_out"), F.col("outc").alias("outcome"))),
        "cef": F.concat(F.lit("CEF:0|Acme|Gate|1.0|100|"), F.col("kind"), F.lit("|5|rt="),
                        epoch_ms("t").cast("string"), F.lit(" "), pairs(*common),
                        F.coalesce(F.concat(F.lit(" "), said), F.lit(""))),
        "leef": F.concat(F.lit("LEEF:2.0|Acme|Gate|1.0|"), F.col("kind"), F.lit("|devTime="), iso,
                         F.lit("\t"), pairs(*common, sep="\t"),
                         F.coalesce(F.concat(F.lit("\t"), said), F.lit(""))),
        # Six pairs: with eight the key=value score would beat the syslog envelope.
        "syslog": F.concat(F.lit("<134>"), bsd, F.lit(" gw1 app[42]: "), pairs(
            ("srcip", s["src"]), ("dstip", s["dst"]), ("dstport", s["dport"]), ("action", s["act"]), ("user", s["usr"]), ("sentbyte", s["nbytes"])),
            F.coalesce(F.concat(F.lit(" "), said), F.lit(""))),
        "csv": F.concat_ws(",", F.lit("FLOW"), iso, s["src"], s["sport"], s["dst"], s["dport"], s["act"],
                           F.concat(F.lit('"'), s["usr"], F.lit('"')), s["nbytes"], o),
        "xml": F.concat(F.lit("<event><timestamp>"), iso, F.lit("</timestamp><src>"), s["src"],
                        F.lit("</src><srcport>"), s["sport"], F.lit("</srcport><dst>"), s["dst"],
                        F.lit("</dst><dstport>"), s["dport"], F.lit("</dstport><action>"), s["act"],
                        F.lit("</action><user>"), s["usr"], F.lit("</user><bytes_out>"), s["nbytes"],
                        F.lit("</bytes_out>"),
                        F.coalesce(F.concat(F.lit("<outcome>"), F.col("outc"), F.lit("</outcome>")), F.lit("")),
                        F.lit("</event>")),
    }
    if fmt:
        raw = texts[fmt]
    else:
        raw = None
        for i, name in enumerate(FORMATS):
            cond = F.col("event_id") % 7 == i
            raw = F.when(cond, texts[name]) if raw is None else raw.when(cond, texts[name])
    return f.select(
        F.col("event_id").alias("key_id"), F.col("event_id").alias("line_no"), raw.alias("raw"),
        F.lit("file").alias("source_type"), F.lit("/logs/app.log").alias("address"),
        F.lit("file").alias("transport"), F.col("t").alias("received_time"))


# The CSV view carries no header; this spec names its columns.
FLOW_SPEC = {
    "id": "flow-csv", "format": "csv", "match": {"all": [{"startswith": "FLOW,"}]},
    "format_options": {"delimiter": ",", "columns": [
        "kind", "generated_time", "src_ip", "src_port", "dst_ip", "dst_port", "act", "username",
        "bytes_out", "outcome"]},
    "mapping": {"event_time": {"src": "generated_time", "type": "timestamp"},
                "source.ip": {"src": "src_ip", "type": "ip"}},
    "taxonomy": {"action": {"src": "act", "map": {"deny": "deny", "allow": "allow"}}},
}


def events(df: DataFrame) -> DataFrame:
    """The normalized form of the same rows, built straight from the columns."""
    f = fields(df)
    ues = build(UES, {
        "schema_version": F.lit(SCHEMA_VERSION), "event_id": F.concat(F.lit("E"), F.col("tid")),
        "event_time": F.col("t"), "event_time_epoch_ms": epoch_ms("t"), "ingest_time": F.col("t"),
        "event_kind": F.lit("event"), "category": F.col("cat"), "action": F.col("act"),
        "outcome": F.col("outc"), "severity": F.col("sev"),
        "severity_label": F.when(F.col("sev") >= 85, "critical").when(F.col("sev") >= 65, "high")
        .otherwise("info"),
        "message": F.concat(F.lit("event "), F.col("kind")),
        "source.ip": F.col("src"), "source.port": F.col("sport"), "destination.ip": F.col("dst"),
        "destination.port": F.col("dport"), "user.name": F.col("usr"),
        "network.bytes_out": F.col("nbytes"),
        "device.vendor": F.when(F.col("event_id") % 7 < 5, F.concat(
            F.lit("vendor"), (F.col("event_id") % 7).cast("string"))),
        "tags": F.array(), "labels": F.create_map(),
    })
    fmt = F.get(F.array(*[F.lit(x) for x in FORMATS]), (F.col("event_id") % 7).cast("int"))
    raw = F.concat(F.lit("line "), F.col("event_id").cast("string"), F.lit(" by "), F.col("usr"))
    meta = build(META, {
        "pipeline_id": F.lit("logspark"), "parser": fmt, "format": fmt, "parse_status": F.lit("parsed"),
        "source_type": F.lit("file"), "received_time": F.col("t"), "warnings": F.array()})
    trace = build(TRACE, {
        "trace_id": F.col("tid"), "raw_hash": F.sha2(raw, 256), "raw_size": F.octet_length(raw),
        "algorithm": F.lit("sha256"), "lineage": F.array()})
    return f.select(ues.alias("ues"), meta.alias("meta"), trace.alias("trace"), raw.alias("raw"))
