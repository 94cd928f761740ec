"""Detection, extraction and normalization of log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import logviews as V
from ..operators import normalize as N
from ..operators.detect import detect_format, looks_like_csv
from ..operators.extract import EXTRACTORS, safe
from ..operators.select import fallback_parser, parse_chain, select_parser
from ..operators.specs import as_specs, load_specs
from ..plans import profile
from .base import FLOW, event_fields, line_view, ms, normalized, query, table


def _id():
    return F.col("key_id").alias("event_id")


@query("det_format", """WITH {EV} SELECT event_id, CASE fmt WHEN 'csv' THEN 'text' ELSE fmt END AS format,
  CASE fmt WHEN 'kv' THEN round(least(0.9, 0.6 + 0.02 * (8 + (outc IS NOT NULL)::INT)), 4) WHEN 'json' THEN 0.95
    WHEN 'cef' THEN 0.98 WHEN 'leef' THEN 0.98 WHEN 'syslog' THEN 0.85 WHEN 'csv' THEN 0.2 ELSE 0.9 END AS confidence
  FROM ev""")
def det_format(spark, sf):
    d = line_view(spark, sf).withColumn("d", detect_format("raw"))
    return d.select(_id(), "d.format", F.round("d.confidence", 4).alias("confidence"))


@query("det_csv_shape", "SELECT event_id, event_id % 3 = 0 AS ok FROM events")
def det_csv_shape(spark, sf):
    i = F.col("event_id")
    f = event_fields(spark, sf)
    head = F.lit("time,src,act\n")
    row = F.concat_ws(",", "kind", "src", F.concat(F.lit('"'), "act", F.lit(', really"')))
    raw = F.when(i % 3 == 0, F.concat(head, row)).when(i % 3 == 1, F.concat(head, row, F.lit(",more"))).otherwise(row)
    return f.select("event_id", looks_like_csv(raw).alias("ok"))


@query("par_select", """WITH {EV} SELECT event_id, CASE fmt WHEN 'csv' THEN 'csv' ELSE fmt END AS parser,
  CASE fmt WHEN 'csv' THEN 'flow-csv' END AS spec FROM ev""")
def par_select(spark, sf):
    return select_parser(line_view(spark, sf), FLOW).select(_id(), "pick.parser", "pick.spec")


@query("par_fallback", "SELECT doc_id, CASE WHEN length(trim(text)) > 0 THEN 1 ELSE 0 END AS n FROM documents")
def par_fallback(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("raw"))
    d = fallback_parser(select_parser(d))
    return d.select("doc_id", F.when(F.col("parser").isNotNull(), 1).otherwise(0).alias("n"))


@query("par_chain", """WITH {EV} SELECT event_id, 'syslog' AS parser, 'kv' AS inner_parser, 'gw1' AS host, 134 AS pri,
  src, usr, act FROM ev""")
def par_chain(spark, sf):
    p = parse_chain(line_view(spark, sf, "syslog"))
    a = F.map_from_entries("parsed.attrs")
    return p.select(_id(), "parser", F.get("parser_chain", 0).alias("inner_parser"), F.col("parsed.host").alias("host"),
                    F.col("parsed.pri").alias("pri"), a["srcip"].alias("src"), a["user"].alias("usr"),
                    a["action"].alias("act"))


@query("par_safe", """WITH {EV} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS kept,
  CASE WHEN event_id % 2 = 0 THEN {KV} ELSE 'ok' END AS message FROM ev""")
def par_safe(spark, sf):
    lines = line_view(spark, sf, "kv")
    fine = EXTRACTORS["plain"](F.lit("ok"))
    out = safe(F.when(F.col("key_id") % 2 == 1, fine), "raw")
    return lines.withColumn("p", out).select(_id(), F.size("p.warnings").alias("kept"), "p.message")


_SIX = "src, dst, CAST(dport AS VARCHAR) AS dport, act, usr"


def _extractor(name: str, fmt: str, names: list[str], sql: str, options: dict | None = None):
    @query(name, f"WITH {{EV}} SELECT event_id, {sql} FROM ev")
    def run(spark, sf):
        p = line_view(spark, sf, fmt).withColumn("p", EXTRACTORS[name[4:]]("raw", options))
        a = F.map_from_entries("p.attrs")
        out = ["src", "dst", "dport", "act", "usr"]
        return p.select(_id(), *[a[n].alias(o) for n, o in zip(names, out)], F.col("p.event_time_raw").alias("t"),
                        F.size("p.warnings").alias("warnings"))


_COMMON = ["src", "dst", "dpt", "act", "suser"]
_extractor("par_kv", "kv", ["srcip", "dstip", "dstport", "action", "user"], _SIX + ", iso AS t, 0 AS warnings")
_extractor("par_json", "json", ["source.ip", "dst_ip", "dst_port", "action", "username"],
           _SIX + ", iso AS t, 0 AS warnings")
_extractor("par_cef", "cef", _COMMON, _SIX + ", CAST(ms AS VARCHAR) AS t, 0 AS warnings")
_extractor("par_leef", "leef", _COMMON, _SIX + ", iso AS t, 0 AS warnings")
_extractor("par_xml", "xml", ["src", "dst", "dstport", "action", "user"], _SIX + ", iso AS t, 0 AS warnings")
_extractor("par_csv", "csv", ["src_ip", "dst_ip", "dst_port", "act", "username"], _SIX + ", iso AS t, 0 AS warnings",
           V.FLOW_SPEC["format_options"])
_extractor("par_regex", "kv", ["src_ip", "dst_ip", "dpt", "verb", "who"], _SIX + ", iso AS t, 0 AS warnings", {
    "patterns": [r'never (?P<x>\d+)', r'^timestamp=(?P<time>\S+) srcip=(?P<src_ip>\S+) dstip=(?P<dst_ip>\S+) '
                 r'srcport=\d+ dstport=(?P<dpt>\d+) action=(?P<verb>\w+) user="(?P<who>[^"]+)"']})


@query("par_syslog", """WITH {EV} SELECT event_id, 'gw1' AS host, 134 AS pri, 'app' AS tag, '42' AS pid,
  strftime(ts, '%b %-d %H:%M:%S') AS t FROM ev""")
def par_syslog(spark, sf):
    p = line_view(spark, sf, "syslog").withColumn("p", EXTRACTORS["syslog"]("raw"))
    a = F.map_from_entries("p.attrs")
    return p.select(_id(), "p.host", "p.pri", a["syslog.tag"].alias("tag"), a["syslog.pid"].alias("pid"),
                    F.col("p.event_time_raw").alias("t"))


@query("par_plain", "SELECT doc_id, md5(trim(text, E' \\t\\r\\n\\x0b\\x0c')) AS h FROM documents")
def par_plain(spark, sf):
    p = table(spark, sf, "documents").withColumn("p", EXTRACTORS["plain"]("text"))
    return p.select("doc_id", F.md5(F.col("p.message").cast("binary")).alias("h"))


@query("par_json_deep", """WITH {EV} SELECT event_id, src, usr, CASE WHEN event_id % 3 = 0 THEN 'a.b.c.d.e.f.srcip' ELSE 'srcip' END AS key FROM ev""")
def par_json_deep(spark, sf):
    """Addresses seven levels deep."""
    f = event_fields(spark, sf)
    leaf = F.concat(F.lit('{"srcip":"'), "src", F.lit('","note":"{{","user":"'), "usr", F.lit('"}'))
    deep = F.concat(F.lit('{"a":{"b":{"c":{"d":{"e":{"f":'), leaf, F.lit("}}}}}}"))
    raw = f.select("event_id", F.when(F.col("event_id") % 3 == 0, deep).otherwise(leaf).alias("raw"))
    p = raw.withColumn("p", EXTRACTORS["json"]("raw"))
    at = lambda end: F.get(F.filter("p.attrs", lambda x: x["key"].endswith(end)), 0)
    return p.select("event_id", at("srcip")["value"].alias("src"), at("user")["value"].alias("usr"), at("srcip")["key"].alias("key"))


@query("par_vendor_specs", """WITH {EV} SELECT event_id,
  ['cisco-asa','fortigate-traffic','nginx-access','paloalto-panos','squid-proxy','sshd-auth'][CAST(event_id % 6 AS INTEGER) + 1] AS parser,
  src, CASE WHEN event_id % 6 NOT IN (2, 4, 5) THEN dst END AS dst, CASE WHEN event_id % 6 > 1 THEN usr END AS usr,
  CASE event_id % 6 WHEN 2 THEN NULL WHEN 4 THEN (CASE act WHEN 'deny' THEN 'deny' ELSE 'allow' END) ELSE act END AS act,
  CASE event_id % 6 WHEN 0 THEN 4000 WHEN 5 THEN 5000 WHEN 2 THEN NULL WHEN 4 THEN NULL ELSE sport END AS sport,
  ms // 1000 * 1000 AS ms FROM ev""")
def par_vendor_specs(spark, sf):
    f = event_fields(spark, sf)
    deny = F.col("act") == "deny"

    def t(p: str):
        return F.date_format("t", p)

    port = F.col("sport").cast("string")
    asa = F.concat(F.lit("<166>"), t("MMM d yyyy HH:mm:ss"), F.lit(" edge : "), F.when(deny, F.concat(
        F.lit("%ASA-4-106023: Deny tcp src outside:"), "src", F.lit("/4000 dst inside:"), "dst", F.lit('/22 by access-group "in" [0x0, 0x0]'))
    ).otherwise(F.concat(F.lit("%ASA-6-302013: Built inbound TCP connection 7 for outside:"), "src", F.lit("/4000 ("), "src",
                         F.lit("/4000) to dmz:"), "dst", F.lit("/443 ("), "dst", F.lit("/443)"))))
    forti = F.concat(t("'date='yyyy-MM-dd' time='HH:mm:ss"), F.lit(' devname="fw1" logid="0000000013" type="traffic" subtype="forward" level="notice" srcip='),
                     "src", F.lit(" srcport="), port, F.lit(" dstip="), "dst", F.lit(" dstport=443 action="), F.when(deny, "deny").otherwise("accept"))
    nginx = F.concat("src", F.lit(" - "), "usr", t("' ['dd/MMM/yyyy:HH:mm:ss' +0000] '"),
                     F.lit('"GET /x HTTP/1.1" 200 12 "-" "curl"'))
    stamp = t("yyyy/MM/dd HH:mm:ss")
    pan = F.concat_ws(",", F.lit("1"), stamp, F.lit("0017,TRAFFIC,end,1"), stamp, "src", "dst", F.lit("0.0.0.0,0.0.0.0,rule1"), "usr",
                      F.lit(",web-browsing,vsys1,trust,untrust,eth1,eth2,default,1,99,1"), port, F.lit("443,0,0,0x0,tcp"), "act",
                      F.lit("300,100,200,4"), stamp, F.lit("2,any"))
    squid = F.concat(F.floor(ms("t") / 1000).cast("string"), F.lit(".000    120 "), "src", F.when(
        deny, " TCP_DENIED/403").otherwise(" TCP_MISS/200"), F.lit(" 512 GET http://a.example/ "), "usr",
        F.lit(" HIER_DIRECT/192.0.2.4 text/html"))
    sshd = F.concat(F.lit("<38>"), t("MMM d HH:mm:ss"), F.lit(" host1 sshd[99]: "), F.when(
        deny, "Failed password for invalid user ").otherwise("Accepted publickey for "), "usr", F.lit(" from "), "src",
        F.lit(" port 5000 ssh2"))
    raw = F.get(F.array(asa, forti, nginx, pan, squid, sshd), (F.col("event_id") % 6).cast("int"))
    lines = V.spread(f.select(F.col("event_id").alias("key_id"), F.col("event_id").alias("line_no"), raw.alias("raw")),
                     "key_id")
    out = N.normalize_logs(lines, load_specs(), year=2024)
    return out.select(_id(), F.col("meta.parser").alias("parser"), F.col("ues.source.ip").alias("src"), F.col("ues.destination.ip").alias("dst"),
                      F.col("ues.user.name").alias("usr"), F.col("ues.action").alias("act"), F.col("ues.source.port").alias("sport"),
                      ms("ues.event_time").alias("ms"))


# --- normalization ---------------------------------------------------------------------------
_SPEC = {
    "id": "kv-flow", "format": "kv", "match": {"all": [{"contains": "srcip="}]},
    "mapping": {
        "event_time": {"src": "timestamp", "type": "timestamp"}, "source.ip": {"src": "srcip", "type": "ip"},
        "destination.port": {"src": "dstport", "type": "int"}, "message": {"template": "{user} from {srcip} {nope}"},
        "network.packets": {"src": "user", "type": "int"}, "user.name": {"src": "user", "type": "upper"},
        "network.direction": {"value": "inbound"}, "file.hash": {"src": "_raw"}},
    "taxonomy": {"type": {"src": "action", "map": {"deny": "refusal"}}},
    "severity": {"src": "action", "map": {"deny": "error"}, "default": "notice"},
    "derived": [
        {"when": r"^(?P<who>\w+) from", "set": {"user.domain": {"value": "who", "type": "lower"}, "category": "flow"}},
        {"when": "action=deny", "field": "raw", "confidence": 0.5, "set": {"outcome": "failure"}},
        {"when": "^flow$", "field": "category", "set": {"process.name": "second"}}],
    "constants": {"device.vendor": "Acme", "vendor": "Acme"},
}
KV_SPEC = as_specs([_SPEC])


def _kv(spark, sf):
    return N.normalize_logs(line_view(spark, sf, "kv"), KV_SPEC, year=2024)


def _nrm(name: str, sql: str, **cols: str):
    @query(name, f"WITH {{EV}} SELECT event_id, {sql} FROM ev")
    def run(spark, sf):
        return _kv(spark, sf).select(_id(), *[F.expr(v).alias(k) for k, v in cols.items()])


_nrm("nrm_mapping", "ms, src, CAST(dport AS INTEGER) AS dport, upper(usr) AS usr, 'inbound' AS way, CAST(NULL AS BIGINT) AS packets, md5({KV}) AS h",
     ms="unix_millis(ues.event_time)", src="ues.source.ip", dport="ues.destination.port", usr="ues.user.name",
     way="ues.network.direction", packets="ues.network.packets", h="md5(ues.file.hash)")
_nrm("nrm_template", "usr || ' from ' || src || ' {nope}' AS message", message="ues.message")
_nrm("nrm_taxonomy", "CASE act WHEN 'deny' THEN 'refusal' ELSE act END AS type", type="ues.type")
_nrm("nrm_severity", "CASE act WHEN 'deny' THEN 'high' ELSE 'info' END AS label, CAST(CASE act WHEN 'deny' THEN 70 ELSE 10 END AS INTEGER) AS n",
     label="ues.severity_label", n="ues.severity")
_nrm("nrm_derived", "usr AS domain, 'flow' AS cat, CASE WHEN act = 'deny' THEN 'failure' ELSE outc END AS outc, 'second' AS seen",
     domain="ues.user.domain", cat="ues.category", outc="ues.outcome", seen="ues.process.name")
_nrm("nrm_constants", "'Acme' AS vendor, 'Acme' AS ext", vendor="ues.device.vendor", ext="ues.ext['vendor']")
_nrm("nrm_warnings", "1 AS n, 'network.packets: cannot convert ''' || usr || ''' to int' AS first",
     n="size(meta.warnings)", first="meta.warnings[0]")


@query("nrm_envelope", """WITH {EV} SELECT event_id, 'gw1' AS host, 'info' AS label, 10 AS n,
  ms // 1000 * 1000 AS ms FROM ev""")
def nrm_envelope(spark, sf):
    n = N.normalize_logs(line_view(spark, sf, "syslog"), (), year=2024)
    return n.select(_id(), F.col("ues.device.host").alias("host"), F.col("ues.severity_label").alias("label"),
                    F.col("ues.severity").alias("n"), ms("ues.event_time").alias("ms"))


@query("nrm_infer", """WITH {EV} SELECT event_id, iso AS t, src, CAST(sport AS VARCHAR) AS sport, act, usr,
  CAST(nbytes AS VARCHAR) AS nbytes, outc FROM ev""")
def nrm_infer(spark, sf):
    p = line_view(spark, sf, "kv").withColumn("parsed", EXTRACTORS["kv"]("raw"))
    i = F.col("inferred")

    def at(key):
        return F.try_element_at(i, F.lit(key))

    return N.infer_fields(p, year=2024).select(
        _id(), at("event_time").alias("t"), at("source.ip").alias("src"), at("source.port").alias("sport"),
        at("action").alias("act"), at("user.name").alias("usr"), at("network.bytes_out").alias("nbytes"),
        at("outcome").alias("outc"))


@query("nrm_defaults", """SELECT doc_id, 'event' AS kind, 10 AS sev, 'info' AS label, 1704067200000 AS ms, true AS warned
  FROM documents WHERE length(trim(text, E' \\t\\r\\n\\x0b\\x0c')) > 0""")
def nrm_defaults(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("key_id"), F.col("doc_id").alias("line_no"), F.concat(F.lit("note "), F.lit("about")).alias("raw"),
        F.lit("2024-01-01T00:00:00Z").cast("timestamp").alias("received_time"), "text").filter(
        F.btrim("text", F.lit(" \t\r\n\x0b\x0c")) != "").drop("text")
    n = N.normalize_logs(d, ())
    return n.select(F.col("key_id").alias("doc_id"), F.col("ues.event_kind").alias("kind"), F.col("ues.severity").alias("sev"),
                    F.col("ues.severity_label").alias("label"), F.col("ues.event_time_epoch_ms").alias("ms"),
                    F.exists("meta.warnings", lambda w: w.startswith("event_time missing")).alias("warned"))


@query("nrm_lineage", """WITH {EV} SELECT event_id, 'srcip' AS source_from, src AS source_value, 1.0 AS source_conf,
  'offline key inference' AS inferred_by, 0.78 AS inferred_conf,
  CASE WHEN act = 'deny' THEN 0.5 END AS derived_conf, CAST(15 AS INTEGER) AS n FROM ev""")
def nrm_lineage(spark, sf):
    def rec(field):
        return F.get(F.filter("trace.lineage", lambda r: r["normalized_field"] == field), 0)

    def derived(r):
        return (r["normalized_field"] == "outcome") & (r["extraction_method"] == "derived regex")

    # Mapping 7, taxonomy 1, derived 3 + 1 for a denial, inference 4 + 1 for an outcome not derived.
    n = F.size("trace.lineage") - F.when(F.col("ues.action") == "deny", 1).otherwise(0) - F.when(
        (F.col("ues.action") != "deny") & F.col("ues.outcome").isNotNull(), 1).otherwise(0)
    return _kv(spark, sf).select(
        _id(), rec("source.ip")["original_field"].alias("source_from"),
        rec("source.ip")["normalized_value"].alias("source_value"), rec("source.ip")["confidence"].alias("source_conf"),
        rec("network.bytes_out")["extraction_method"].alias("inferred_by"),
        rec("network.bytes_out")["confidence"].alias("inferred_conf"),
        F.get(F.filter("trace.lineage", derived), 0)["confidence"].alias("derived_conf"),
        n.cast("int").alias("n"))


@query("nrm_integrity", """SELECT doc_id, sha256(text) AS raw_hash, CAST(strlen(text) AS BIGINT) AS raw_size,
  'sha256' AS algorithm FROM documents""")
def nrm_integrity(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("raw"))
    return N.with_integrity(N.with_source_columns(d)).select("doc_id", "raw_hash", "raw_size", "algorithm")


@query("nrm_failure", """SELECT doc_id, 'failed' AS status, 'none' AS parser, 10 AS sev, sha256(text) AS h,
  'normalization error: bad ' || lang AS warning FROM documents""")
def nrm_failure(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("key_id"), F.col("doc_id").alias("line_no"), F.col("text").alias("raw"), F.concat(F.lit("bad "), "lang").alias("error"),
        F.lit("2024-01-01T00:00:00Z").cast("timestamp").alias("received_time"))
    e = N.failure_events(d, "error")
    return e.select(F.col("key_id").alias("doc_id"), F.col("meta.parse_status").alias("status"),
                    F.col("meta.parser").alias("parser"), F.col("ues.severity").alias("sev"),
                    F.sha2("raw", 256).alias("h"), F.get("meta.warnings", 0).alias("warning"))


_ROUND_TRIP = """WITH {EV} SELECT event_id, CASE fmt WHEN 'csv' THEN 'flow-csv' ELSE fmt END AS parser,
  CASE fmt WHEN 'syslog' THEN ms // 1000 * 1000 ELSE ms END AS ms, src,
  CAST(CASE fmt WHEN 'syslog' THEN NULL ELSE sport END AS INTEGER) AS sport, dst, dport, usr, act, outc, nbytes FROM ev"""


@query("nrm_pipeline", _ROUND_TRIP)
def nrm_pipeline(spark, sf):
    """Lines of seven formats back to the fields they were made of."""
    n = normalized(spark, sf)
    return n.select(_id(), F.col("meta.parser").alias("parser"), ms("ues.event_time").alias("ms"),
                    F.col("ues.source.ip").alias("src"), F.col("ues.source.port").alias("sport"),
                    F.col("ues.destination.ip").alias("dst"), F.col("ues.destination.port").alias("dport"),
                    F.col("ues.user.name").alias("usr"), F.col("ues.action").alias("act"),
                    F.col("ues.outcome").alias("outc"), F.col("ues.network.bytes_out").alias("nbytes"))


# --- profiles and onboarding -----------------------------------------------------------------
@query("agg_profile_formats", """WITH {EV} SELECT CASE fmt WHEN 'csv' THEN 'text' ELSE fmt END AS format, count(*) AS n
  FROM ev GROUP BY 1""")
def agg_profile_formats(spark, sf):
    return profile.profile_formats(line_view(spark, sf))


@query("agg_profile_parsers", """WITH {EV} SELECT CASE fmt WHEN 'csv' THEN 'flow-csv' ELSE fmt END AS parser, count(*) AS n
  FROM ev GROUP BY 1""")
def agg_profile_parsers(spark, sf):
    return profile.profile_parsers(parse_chain(line_view(spark, sf), FLOW))


_KV_FIELDS = """SELECT unnest(['timestamp','srcip','dstip','srcport','dstport','action','user','sentbyte','outcome']) AS key,
  unnest(['event_time','source.ip','destination.ip','source.port','destination.port','action','user.name','network.bytes_out','outcome']) AS target,
  unnest(['timestamp','ip','ip','int','int','str','str','int','str']) AS type"""


@query("agg_profile_fields", f"""WITH {{EV}}, k AS ({_KV_FIELDS}) SELECT key,
  CASE key WHEN 'outcome' THEN (SELECT count(*) FROM ev WHERE outc IS NOT NULL) ELSE (SELECT count(*) FROM ev) END AS n,
  target, type FROM k""")
def agg_profile_fields(spark, sf):
    return profile.profile_fields(parse_chain(line_view(spark, sf, "kv")), 25)


@query("agg_ts_coverage", """WITH {EV} SELECT count(*) FILTER (WHERE fmt <> 'csv') AS timestamps, count(*) AS total FROM ev""")
def agg_ts_coverage(spark, sf):
    return profile.ts_coverage(parse_chain(line_view(spark, sf)), 2024)


@query("jn_alias", """WITH {EV}, k AS (SELECT unnest(regexp_extract_all({KV}, '(?:^| )([a-z]+)=', 1)) AS source FROM ev
    UNION ALL SELECT 'Old_Src' || CASE WHEN event_id % 2 = 0 THEN 'IP' ELSE 'Port' END FROM ev
    UNION ALL SELECT unnest(regexp_extract_all(url, '[?&]([a-z]+)=', 1)) FROM pages)
  SELECT source, count(*) AS n, CASE source WHEN 'srcip' THEN 'source.ip' WHEN 'dstip' THEN 'destination.ip' WHEN 'srcport' THEN 'source.port'
    WHEN 'dstport' THEN 'destination.port' WHEN 'action' THEN 'event.action' WHEN 'user' THEN 'user.name' WHEN 'outcome' THEN 'event.outcome'
    WHEN 'Old_SrcIP' THEN 'source.ip' WHEN 'Old_SrcPort' THEN 'source.port' END AS target,
    CASE WHEN source IN ('srcip', 'dstip', 'srcport', 'dstport', 'action', 'user', 'outcome') THEN 0.96 WHEN source = 'Old_SrcIP' THEN 0.86
      WHEN source = 'Old_SrcPort' THEN 0.84 ELSE 0.0 END AS confidence FROM k GROUP BY 1""")
def jn_alias(spark, sf):
    """Keys of log lines and of addresses: known aliases, name patterns, and names without a target."""
    keys = line_view(spark, sf, "kv").select(F.explode(F.regexp_extract_all("raw", F.lit("(?:^| )([a-z]+)="), F.lit(1))).alias("source"))
    named = table(spark, sf, "events").select(F.concat(F.lit("Old_Src"), F.when(F.col("event_id") % 2 == 0, "IP").otherwise("Port")).alias("source"))
    urls = table(spark, sf, "pages").select(F.explode(F.regexp_extract_all("url", F.lit("[?&]([a-z]+)="), F.lit(1))).alias("source"))
    counted = keys.unionByName(named).unionByName(urls).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return profile.alias_join(counted).select("source", "n", "target", F.col("confidence").cast("double").alias("confidence"))


@query("onb_suggest", """WITH {EV} SELECT source, CASE source WHEN 'outcome' THEN (SELECT count(*) FROM ev WHERE outc IS NOT NULL)
  ELSE (SELECT count(*) FROM ev) END AS n, target, confidence, reason FROM (VALUES
  ('timestamp', NULL, 0.0, 'unmapped field; approval required'), ('srcip', 'source.ip', 0.96, 'known security-log field alias'),
  ('dstip', 'destination.ip', 0.96, 'known security-log field alias'), ('srcport', 'source.port', 0.96, 'known security-log field alias'),
  ('dstport', 'destination.port', 0.96, 'known security-log field alias'), ('action', 'event.action', 0.96, 'known security-log field alias'),
  ('user', 'user.name', 0.96, 'known security-log field alias'), ('sentbyte', NULL, 0.0, 'unmapped field; approval required'),
  ('outcome', 'event.outcome', 0.96, 'known security-log field alias')) t(source, target, confidence, reason)""")
def onb_suggest(spark, sf):
    return profile.suggest_mappings(line_view(spark, sf, "kv")).select("source", "n", "target", "confidence", "reason")


@query("onb_spec", """SELECT unnest(['action','destination.ip','destination.port','outcome','source.ip','source.port','user.name']) AS target,
  unnest(['action','dstip','dstport','outcome','srcip','srcport','user']) AS src,
  unnest(['str','ip','int','str','ip','int','str']) AS type""")
def onb_spec(spark, sf):
    spec = profile.draft_spec(profile.suggest_mappings(line_view(spark, sf, "kv")), "draft", "srcip=")
    rows = [(t, m["src"], m["type"]) for t, m in spec["mapping"].items()]
    return spark.createDataFrame(rows, "target string, src string, type string")


@query("onb_spec_coverage", """WITH {EV} SELECT 'flow-csv' AS spec, count(*) AS lines,
  count(*) FILTER (WHERE fmt = 'csv') AS matched, count(*) FILTER (WHERE fmt = 'csv') AS won,
  count(*) FILTER (WHERE fmt = 'csv') AS extracted, 0 AS with_warnings, 0.91 AS score FROM ev
  UNION ALL SELECT 'kv-flow', count(*), count(*) FILTER (WHERE fmt IN ('kv', 'syslog')), count(*) FILTER (WHERE fmt = 'kv' OR fmt = 'syslog'),
  count(*) FILTER (WHERE fmt IN ('kv', 'syslog')), 0, NULL FROM ev""")
def onb_spec_coverage(spark, sf):
    c = profile.spec_coverage(line_view(spark, sf), (*FLOW, *KV_SPEC))
    return c.withColumn("score", F.when(F.col("spec") == "flow-csv", F.col("score")))


_FIELDS = """['timestamp','srcip','dstip','srcport','dstport','action','user','sentbyte'] WHEN 'json' THEN
    ['timestamp','source.ip','source.port','dst_ip','dst_port','action','username','bytes_out'] WHEN 'cef' THEN
    ['rt','src','dst','spt','dpt','act','suser','bytes_out','cef.version','cef.name','cef.signature_id','device.vendor','device.product','device.version'] WHEN 'leef' THEN
    ['devTime','src','dst','spt','dpt','act','suser','bytes_out','leef.event_id','leef.product_version','leef.version','device.vendor','device.product'] WHEN 'syslog' THEN
    ['srcip','dstip','dstport','action','user','sentbyte','syslog.pid','syslog.tag'] WHEN 'xml' THEN
    ['timestamp','src','dst','srcport','dstport','action','user','bytes_out'] ELSE
    ['kind','generated_time','src_ip','src_port','dst_ip','dst_port','act','username','bytes_out','outcome']"""


@query("onb_inspect", f"""WITH {{EV}}, k AS (SELECT unnest(list_concat(CASE fmt WHEN 'kv' THEN {_FIELDS} END,
    CASE WHEN outc IS NOT NULL AND fmt <> 'csv' THEN ['outcome'] ELSE [] END)) AS item FROM ev)
  SELECT 'field' AS section, item, count(*) AS n FROM k GROUP BY item
  UNION ALL SELECT 'format', CASE fmt WHEN 'csv' THEN 'text' ELSE fmt END, count(*) FROM ev GROUP BY fmt
  UNION ALL SELECT 'parser', CASE fmt WHEN 'csv' THEN 'flow-csv' ELSE fmt END, count(*) FROM ev GROUP BY fmt
  UNION ALL SELECT 'time', 'timestamps', count(*) FROM ev UNION ALL SELECT 'time', 'total', count(*) FROM ev""")
def onb_inspect(spark, sf):
    return profile.inspect(line_view(spark, sf), FLOW, 2024)
