"""Scalar functions, projections and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import convert as K, ip as I, predicates as P, severity as S, timestamps as T
from ..functions.base import first_present
from ..functions.paths import field_by_suffix, flatten_pairs, get_path, set_path
from .base import event_fields, event_view, line_view, ms, query, table
from ..operators.specs import Spec, spec_condition, spec_score


@query("scl_convert", """WITH {EV} SELECT event_id, CAST(trunc(value) AS BIGINT) AS c_int, value AS c_float,
  event_id % 2 = 0 AS c_bool, src AS c_ip,
  CASE event_id % 3 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' ELSE 'sctp' END AS c_proto, ms AS c_time, act AS c_action,
  CASE kind WHEN 'error' THEN 'high' END AS c_level, upper(kind) AS c_upper, CAST(NULL AS BIGINT) AS c_bad,
  CAST(sport AS BIGINT) AS c_port,
  CASE kind WHEN 'view' THEN 'read' WHEN 'click' THEN 'press' ELSE kind END AS c_map FROM ev""")
def scl_convert(spark, sf):
    f = event_fields(spark, sf).join(table(spark, sf, "events").select("event_id", "value"), "event_id")
    n = F.col("event_id") % 3
    return f.select(
        "event_id", K.convert(F.format_string("%.2f", "value"), "int").alias("c_int"),
        K.convert(F.col("value").cast("string"), "float").alias("c_float"),
        K.convert(F.when(F.col("event_id") % 2 == 0, " YES").otherwise("no"), "bool").alias("c_bool"),
        K.convert(F.concat(F.lit(" "), "src"), "ip").alias("c_ip"),
        K.convert(F.when(n == 0, "6").when(n == 1, "UDP").otherwise("132"), "proto").alias("c_proto"),
        ms(K.convert(T.iso_ms("t"), "timestamp")).alias("c_time"),
        K.convert(F.when(F.col("act") == "deny", "BLOCKED").otherwise("Permit"), "action").alias("c_action"),
        K.convert("kind", "loglevel").alias("c_level"), K.convert("kind", "upper").alias("c_upper"),
        K.convert("kind", "int").alias("c_bad"), K.convert(F.col("sport").cast("string"), "port").alias("c_port"),
        K.convert("kind", "map", {"view": "read", "click": "press"}).alias("c_map"))


@query("scl_parse_ts", """WITH {EV} SELECT event_id,
  CASE WHEN event_id % 12 IN (0,1,2,3,10) THEN ms WHEN event_id % 12 = 11 THEN NULL ELSE ms // 1000 * 1000 END AS ms
  FROM ev""")
def scl_parse_ts(spark, sf):
    f = event_fields(spark, sf)

    def fmt(pattern: str):
        return F.date_format("t", pattern)

    iso = T.iso_ms("t")
    shapes = [
        iso, fmt("yyyy-MM-dd HH:mm:ss,SSS"), ms("t").cast("string"), (ms("t") * 1000).cast("string"),
        fmt("MMM d HH:mm:ss"), fmt("dd/MMM/yyyy:HH:mm:ss +0000"), fmt("yyyy/MM/dd HH:mm:ss"),
        fmt("MMM  d yyyy HH:mm:ss"), fmt("EEE MMM d HH:mm:ss yyyy"), fmt("yyyyMMddHHmmss"),
        fmt("yyyy-MM-dd'T'HH:mm:ss.SSS+00:00"), F.lit("no time at all")]
    text = F.get(F.array(*shapes), (F.col("event_id") % len(shapes)).cast("int"))
    return f.select("event_id", ms(T.parse_ts(text, 2024)).alias("ms"))


@query("scl_iso_ms", "WITH {EV} SELECT event_id, iso, ms FROM ev")
def scl_iso_ms(spark, sf):
    return event_fields(spark, sf).select("event_id", T.iso_ms("t").alias("iso"), T.epoch_ms("t").alias("ms"))


_NUM = """CASE WHEN n <= 3 THEN 'info' WHEN n <= 5 THEN 'low' WHEN n <= 7 THEN 'medium' WHEN n <= 9 THEN 'high'
  WHEN n <= 10 THEN 'critical' WHEN n >= 85 THEN 'critical' WHEN n >= 65 THEN 'high' WHEN n >= 45 THEN 'medium'
  WHEN n >= 20 THEN 'low' ELSE 'info' END"""


@query("scl_severity_num", f"SELECT n, {_NUM} AS label FROM (SELECT event_id % 101 AS n FROM events)")
def scl_severity_num(spark, sf):
    n = F.col("event_id") % 101
    return table(spark, sf, "events").select(n.alias("n"), S.severity_num(n).alias("label"))


@query("scl_severity_ues", f"""SELECT event_id,
  CASE WHEN event_id % 3 = 0 THEN (CASE event_type WHEN 'error' THEN 'high' END)
       WHEN event_id % 3 = 1 THEN {_NUM} ELSE 'medium' END AS label,
  CAST(CASE WHEN event_id % 3 = 0 THEN (CASE event_type WHEN 'error' THEN 70 END)
       WHEN event_id % 3 = 1 THEN n ELSE 50 END AS INTEGER) AS number
  FROM (SELECT *, least(event_id % 140, 100) AS n FROM events)""")
def scl_severity_ues(spark, sf):
    i = F.col("event_id")
    text = F.when(i % 3 == 0, F.col("event_type")).when(i % 3 == 1, (i % 140).cast("string")).otherwise(" WARN ")
    e = table(spark, sf, "events").withColumn("s", S.severity_ues(text))
    return e.select("event_id", "s.label", "s.number")


@query("scl_severity_store", """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 80
  WHEN o_orderkey % 4 = 1 THEN least(o_orderkey % 130, 100) WHEN o_orderkey % 4 = 2 THEN 0 ELSE 90 END AS INTEGER) AS n,
  CASE WHEN o_orderkey % 4 = 0 THEN 'high' WHEN o_orderkey % 4 = 3 THEN 'critical' WHEN o_orderkey % 4 = 2 THEN 'info'
    WHEN least(o_orderkey % 130, 100) >= 90 THEN 'critical' WHEN least(o_orderkey % 130, 100) >= 70 THEN 'high'
    WHEN least(o_orderkey % 130, 100) >= 40 THEN 'medium' WHEN least(o_orderkey % 130, 100) > 0 THEN 'low'
    ELSE 'info' END AS label FROM orders""")
def scl_severity_store(spark, sf):
    k = F.col("o_orderkey")
    text = (F.when(k % 4 == 0, F.lit("High")).when(k % 4 == 1, (k % 130).cast("string"))
            .when(k % 4 == 2, F.col("o_orderpriority")).otherwise("severe"))
    n = S.severity_store(text)
    return table(spark, sf, "orders").select("o_orderkey", n.alias("n"), S.severity_store_label(n).alias("label"))


@query("scl_severity_risk", """SELECT event_id, CASE WHEN event_id % 101 >= 95 THEN 'critical'
  WHEN event_id % 101 >= 80 THEN 'high' WHEN event_id % 101 >= 60 THEN 'medium' ELSE 'low' END AS label FROM events""")
def scl_severity_risk(spark, sf):
    return table(spark, sf, "events").select("event_id", S.severity_risk(F.col("event_id") % 101).alias("label"))


@query("scl_ip", """WITH {EV} SELECT event_id, CASE event_id % 4 WHEN 0 THEN src
  WHEN 1 THEN '2001:db8::' || lower(to_hex(event_id % 65535 + 1)) WHEN 2 THEN '::ffff:a00:' || lower(to_hex(user_id % 16))
  END AS ip, CAST(CASE event_id % 4 WHEN 0 THEN 4 WHEN 3 THEN NULL ELSE 6 END AS INTEGER) AS version,
  CASE WHEN event_id % 4 = 0 THEN 167772160 + user_id % 16 END AS num FROM ev""")
def scl_ip(spark, sf):
    f = event_fields(spark, sf)
    i = F.col("event_id")
    text = (F.when(i % 4 == 0, F.col("src"))
            .when(i % 4 == 1, F.concat(F.lit("2001:0DB8:0:0:0::"), F.hex(i % 65535 + 1)))
            .when(i % 4 == 2, F.concat(F.lit("::ffff:"), "src")).otherwise(F.concat("src", F.lit(".5"))))
    return f.select("event_id", I.ip_canonical(text).alias("ip"), I.ip_version(text).alias("version"),
                    I.ip_v4_num(text).alias("num"))


@query("scl_ip_internal", """WITH {EV} SELECT event_id, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN true
  WHEN 2 THEN false WHEN 3 THEN false END AS internal FROM ev""")
def scl_ip_internal(spark, sf):
    i = F.col("event_id")
    text = (F.when(i % 5 == 0, F.col("src")).when(i % 5 == 1, F.col("dst"))
            .when(i % 5 == 2, F.concat(F.lit("8.8.8."), (i % 256).cast("string")))
            .when(i % 5 == 3, F.concat(F.lit("2606:4700::"), F.hex(i % 60000))).otherwise("none"))
    return event_fields(spark, sf).select("event_id", I.ip_internal(text).alias("internal"))


@query("scl_proto", """SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'icmp' WHEN 6 THEN 'tcp'
  ELSE CAST(l_linenumber AS VARCHAR) END AS proto FROM lineitem""")
def scl_proto(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", K.proto(F.col("l_linenumber").cast("string")).alias("proto"))


@query("scl_action", """WITH {EV} SELECT event_id, CASE kind WHEN 'error' THEN 'deny' WHEN 'view' THEN 'allow'
  WHEN 'click' THEN 'quarantine' ELSE kind END AS action,
  CASE kind WHEN 'error' THEN 'deny' WHEN 'view' THEN 'allow' WHEN 'click' THEN 'isolate' ELSE kind END AS classified
  FROM ev""")
def scl_action(spark, sf):
    k = F.col("event_type")
    word = F.when(k == "error", "BLOCK").when(k == "view", "Permit").when(k == "click", "isolate").otherwise(k)
    return table(spark, sf, "events").select("event_id", K.action(word).alias("action"),
                                             K.classifier_action(word).alias("classified"))


@query("scl_size", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 1024 WHEN 1 THEN p_size * 1048576
  WHEN 2 THEN p_size END AS bytes FROM part""")
def scl_size(spark, sf):
    i = F.col("p_partkey") % 4
    n = F.col("p_size").cast("string")
    text = (F.when(i == 0, F.concat(n, F.lit(" k"))).when(i == 1, F.concat(n, F.lit(".0MiB")))
            .when(i == 2, F.concat(n, F.lit("B"))).otherwise(F.col("p_name")))
    return table(spark, sf, "part").select("p_partkey", K.parse_size(text).alias("bytes"))


@query("scl_base64_like", """SELECT doc_id, true AS a,
  length(lang) % 4 = 0 AND regexp_full_match(lang, '[A-Za-z0-9+/]*={0,2}') AS b FROM documents""")
def scl_base64_like(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", K.base64_like(F.replace(F.base64(F.col("text").cast("binary")), F.lit("\r\n"), F.lit(""))).alias("a"),
        K.base64_like("lang").alias("b"))


@query("scl_url_host", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host FROM pages")
def scl_url_host(spark, sf):
    return table(spark, sf, "pages").select("page_id", K.url_host("url").alias("host"))


@query("scl_guess_type", """SELECT event_id, ['ip','int','float','timestamp','str'][CAST(event_id % 5 AS INTEGER) + 1] AS type
  FROM events""")
def scl_guess_type(spark, sf):
    values = F.array(F.col("src"), F.col("nbytes").cast("string"), F.lit("-12.50"), T.iso_ms("t"), F.col("kind"))
    return event_fields(spark, sf).select("event_id", K.guess_type(
        F.get(values, (F.col("event_id") % 5).cast("int"))).alias("type"))


@query("scl_time_display", """WITH {EV} SELECT event_id, strftime(ts, '%H:%M:%S UTC') AS short,
  strftime(ts, '%Y-%m-%d %H:%M:%S UTC') AS long FROM ev""")
def scl_time_display(spark, sf):
    return event_fields(spark, sf).select("event_id", T.time_display("t").alias("short"),
                                          T.time_display("t", True).alias("long"))


@query("scl_event_text", """WITH {EV} SELECT tid, kind = 'error' AS said_deny, true AS said_raw FROM ev""")
def scl_event_text(spark, sf):
    e = event_view(spark, sf).withColumn("text", P.event_text())
    return e.select(F.col("trace.trace_id").alias("tid"), F.col("text").contains('"action":"deny"').alias("said_deny"),
                    F.col("text").contains('"raw":"line ').alias("said_raw"))


@query("scl_get_set_path", "WITH {EV} SELECT tid, src, 'none' AS zone, upper(usr) AS usr FROM ev")
def scl_get_set_path(spark, sf):
    e = event_view(spark, sf).withColumn("ues", set_path("ues", "user.name", F.upper(F.col("ues.user.name"))))
    return e.select(F.col("trace.trace_id").alias("tid"), get_path("ues", "source.ip").alias("src"),
                    get_path("ues", "source.zone", "none").alias("zone"), get_path("ues", "user.name").alias("usr"))


# --- projections and predicates --------------------------------------------------------------
@query("prj_first_present", "WITH {EV} SELECT tid, coalesce(outc, act) AS v FROM ev")
def prj_first_present(spark, sf):
    return event_view(spark, sf).select(F.col("trace.trace_id").alias("tid"),
                                        first_present("ues.service", "ues.outcome", "ues.action").alias("v"))


@query("prj_entity_keys", """WITH {EV} SELECT tid AS trace_id, src AS source_ip, usr AS user_name, act AS action,
  coalesce(outc, '') AS outcome, cat AS category, dport AS destination_port FROM ev""")
def prj_entity_keys(spark, sf):
    return P.entity_keys(event_view(spark, sf))


@query("prj_flatten", """WITH {EV} SELECT tid, k AS key, v AS value FROM (
  SELECT tid, unnest(['source.ip','source.port','user.name','outcome']) AS k,
    unnest([src, CAST(sport AS VARCHAR), usr, outc]) AS v FROM ev) WHERE v IS NOT NULL""")
def prj_flatten(spark, sf):
    e = event_view(spark, sf).withColumn("tid", F.col("trace.trace_id"))
    return flatten_pairs(e, "ues", "tid").filter(F.col("key").isin("source.ip", "source.port", "user.name", "outcome"))


@query("prj_field_suffix", "WITH {EV} SELECT tid, src AS ip, CAST(dport AS VARCHAR) AS port FROM ev")
def prj_field_suffix(spark, sf):
    e = event_view(spark, sf)
    return e.select(F.col("trace.trace_id").alias("tid"), field_by_suffix(e, ["source.ip", "src_ip"]).alias("ip"),
                    field_by_suffix(e, ["destination.port", "dst_port"]).alias("port"))


@query("flt_spec_condition", """WITH {EV} SELECT event_id, act = 'deny' AS a, act <> 'deny' AS b, true AS c,
  outc IS NOT NULL AND outc = 'failure' AS d, false AS e, sport % 10 = 7 AS f, false AS g FROM ev""")
def flt_spec_condition(spark, sf):
    raw = F.col("raw")
    return line_view(spark, sf, "kv").select(
        F.col("key_id").alias("event_id"), spec_condition(raw, "contains", "action=deny").alias("a"),
        spec_condition(raw, "not_contains", "action=deny").alias("b"),
        spec_condition(raw, "startswith", "timestamp=").alias("c"),
        spec_condition(raw, "endswith", "outcome=failure").alias("d"),
        spec_condition(raw, "equals", "timestamp").alias("e"),
        spec_condition(raw, "regex", r"srcport=\d*7 ").alias("f"), spec_condition(raw, "regex", "(").alias("g"))


@query("flt_spec_match", """WITH {EV} SELECT event_id,
  CASE WHEN (act = 'deny')::INT + (dport = 22)::INT + 1 > 0 THEN round(0.90 + 0.01 * ((act = 'deny')::INT + (dport = 22)::INT + 1), 4) ELSE 0 END AS any_score,
  CASE WHEN act = 'deny' AND dport = 22 THEN 0.92 ELSE 0.0 END AS all_score, 0.9 AS open_score FROM ev""")
def flt_spec_match(spark, sf):
    a, b, t = {"contains": "action=deny"}, {"contains": "dstport=22 "}, {"startswith": "timestamp="}
    raw = F.col("raw")
    return line_view(spark, sf, "kv").select(
        F.col("key_id").alias("event_id"),
        F.round(spec_score(raw, Spec("x", match={"any": [a, b, t]})), 4).alias("any_score"),
        F.round(spec_score(raw, Spec("x", match={"all": [a, b]})), 4).alias("all_score"),
        spec_score(raw, Spec("x")).alias("open_score"))


@query("flt_search", "WITH {EV} SELECT tid FROM ev WHERE usr LIKE 'u1%'")
def flt_search(spark, sf):
    return P.search(event_view(spark, sf), 'BY U1').select(F.col("trace.trace_id").alias("tid"))


@query("flt_suspicious", "WITH {EV} SELECT tid FROM ev WHERE kind = 'error'")
def flt_suspicious(spark, sf):
    return event_view(spark, sf).filter(P.suspicious()).select(F.col("trace.trace_id").alias("tid"))


def _role(name: str, where: str, flag, error_category: str | None = None):
    @query(name, f"WITH {{EV}} SELECT tid FROM ev WHERE {where}")
    def run(spark, sf):
        return event_view(spark, sf, error_category).filter(flag()).select(F.col("trace.trace_id").alias("tid"))


_role("flt_auth_failure", "kind = 'error'", P.auth_failure)
_role("flt_auth_success", "kind = 'signup'", P.auth_success)
_role("flt_priv_escalation", "kind = 'purchase'", P.priv_escalation)
_role("flt_scan", "kind = 'click'", P.scan)
_role("flt_security_failure", "kind = 'error'", P.security_failure, "network")
_role("flt_failed_auth_alert", "kind = 'error'", P.failed_auth_alert)
