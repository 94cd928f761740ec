"""Feeds, lookups and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich as E
from ..plans import queries as Q
from ..session import new_dir
from ..sources.feeds import geo_ranges, load_geo, load_threat, threat_indicators
from .base import event_view, ms, query, spread_view, table


def _geo_rows(spark, sf):
    """One range of eight addresses per nation; every fifth row has a broken bound."""
    k = F.col("n_nationkey")

    def ip(n):
        return F.concat(F.lit("203.0.113."), n.cast("string"))

    return table(spark, sf, "nation").select(
        F.when(k % 5 == 0, F.lit("bad")).otherwise(ip(k * 8)).alias("start"), ip(k * 8 + 7).alias("end"),
        F.col("n_name").alias("country"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("city"),
        k.alias("ord"))


def _feed_rows(spark, sf):
    """Suppliers as indicators: address, domain, text, and a repeated address."""
    k = F.col("s_suppkey")
    text = (F.when(k % 4 == 0, F.concat(F.lit("203.0.113."), (k % 256).cast("string")))
            .when(k % 4 == 1, F.concat(F.lit(".D"), k.cast("string"), F.lit(".Example")))
            .when(k % 4 == 2, F.concat(F.lit("event "), F.when(k % 8 == 2, "click").otherwise("View")))
            .otherwise(F.concat(F.lit("203.0.113."), ((k - 3) % 256).cast("string"))))
    return table(spark, sf, "supplier").select(
        text.alias("indicator"), F.concat(F.lit("T"), (k % 3).cast("string")).alias("type"),
        F.when(k % 3 == 0, "critical").when(k % 3 == 1, "High").otherwise("odd").alias("severity"),
        F.lit("feed").alias("source"), k.alias("ord"))


_GEO = """geo AS (SELECT n_nationkey * 8 AS lo, n_nationkey * 8 + 7 AS hi, n_name AS country, 'R' || n_regionkey AS city
  FROM nation WHERE n_nationkey % 5 <> 0)"""
_FEED = """f0 AS (SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN '203.0.113.' || (s_suppkey % 256)
    WHEN 1 THEN '.d' || s_suppkey || '.example' WHEN 2 THEN 'event ' || CASE WHEN s_suppkey % 8 = 2 THEN 'click' ELSE 'view' END
    ELSE '203.0.113.' || ((s_suppkey - 3) % 256) END AS indicator, 't' || (s_suppkey % 3) AS type,
    CASE s_suppkey % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'odd' END AS severity,
    ['ip','domain','string','ip'][CAST(s_suppkey % 4 AS INTEGER) + 1] AS kind FROM supplier),
  feed AS (SELECT indicator, kind, min(k) AS ord, arg_max(type, k) AS type, arg_max(severity, k) AS severity
    FROM f0 GROUP BY 1, 2)"""
_SCORE = "CASE {} WHEN 'critical' THEN 90 WHEN 'high' THEN 70 ELSE 50 END"


@query("src_geo_dim", f"""WITH {_GEO} SELECT '203.0.113.' || lo AS start, 3405803776 + lo AS lo, 3405803776 + hi AS hi,
  country, city FROM geo""")
def src_geo_dim(spark, sf):
    path = new_dir(spark, "geo")
    _geo_rows(spark, sf).drop("ord").write.option("header", "true").csv(path)
    return load_geo(spark, path).select("start", "lo", "hi", "country", "city")


@query("src_threat_dim", f"WITH {_FEED} SELECT indicator, kind, type, severity, 'feed' AS feed FROM feed")
def src_threat_dim(spark, sf):
    path = new_dir(spark, "threat")
    _feed_rows(spark, sf).coalesce(1).sortWithinPartitions("ord").drop("ord").write.option("header", "true").csv(path)
    return load_threat(spark, path).select("indicator", "kind", "type", "severity", "feed")


def _geo(spark, sf):
    return geo_ranges(_geo_rows(spark, sf))


def _feed(spark, sf):
    return threat_indicators(_feed_rows(spark, sf), "feed")


@query("jn_geo_range", f"""WITH {{EV}}, {_GEO} SELECT tid, country, city FROM ev LEFT JOIN geo
  ON event_id % 256 BETWEEN lo AND hi""")
def jn_geo_range(spark, sf):
    e = E.geo_join(event_view(spark, sf), _geo(spark, sf), "destination")
    return e.select(F.col("trace.trace_id").alias("tid"), "geo_destination.country", "geo_destination.city")


@query("jn_threat_ip", f"""WITH {{EV}}, {_FEED} SELECT tid, type, severity FROM ev LEFT JOIN feed
  ON kind = 'ip' AND indicator = dst""".replace("kind = 'ip'", "feed.kind = 'ip'"))
def jn_threat_ip(spark, sf):
    e = E.threat_ip(event_view(spark, sf), _feed(spark, sf))
    return e.select(F.col("trace.trace_id").alias("tid"), "hit_destination.type", "hit_destination.severity")


def _page_hosts(spark, sf):
    """Pages as web events; the indicators are the last two labels of every tenth host."""
    p = table(spark, sf, "pages")
    e = p.select(F.struct(F.struct(F.col("url").alias("url"), F.lit(None).cast("string").alias("host")).alias("http"),
                          F.struct(F.lit(None).cast("string").alias("query")).alias("dns")).alias("ues"), "page_id")
    host = F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1)
    feed = p.filter("page_id % 10 = 0").select(
        F.concat(F.lit("."), F.substring_index(host, ".", -2)).alias("indicator"), F.lit("c2").alias("type"),
        F.lit("high").alias("severity"), F.lit("f").alias("source"), F.col("page_id").alias("ord"))
    return e, threat_indicators(feed)


@query("jn_threat_domain", """WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host FROM pages),
  d AS (SELECT DISTINCT array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS dom FROM h WHERE page_id % 10 = 0)
  SELECT page_id, EXISTS (SELECT 1 FROM d WHERE host = dom OR suffix(host, '.' || dom)) AS hit FROM h""")
def jn_threat_domain(spark, sf):
    e, feed = _page_hosts(spark, sf)
    return E.threat_domain(e, feed).select("page_id", F.col("hit_url").isNotNull().alias("hit"))


@query("jn_threat_string", f"""WITH {{EV}}, {_FEED} SELECT tid, type, indicator FROM ev LEFT JOIN feed
  ON feed.kind = 'string' AND indicator = 'event ' || ev.kind""")
def jn_threat_string(spark, sf):
    e = E.threat_string(event_view(spark, sf), _feed(spark, sf))
    return e.select(F.col("trace.trace_id").alias("tid"), "hit_text.type", F.col("hit_text_indicator").alias("indicator"))


@query("enr_time", "WITH {EV} SELECT tid, ms, iso FROM ev")
def enr_time(spark, sf):
    e = event_view(spark, sf).withColumn("ues", F.col("ues").withField("event_time_epoch_ms", F.lit(None).cast("bigint")))
    return E.enr_time(e).select(F.col("trace.trace_id").alias("tid"), F.col("ues.event_time_epoch_ms").alias("ms"),
                                F.date_format("ues.event_time", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"))


@query("enr_ip", """WITH {EV} SELECT tid, CASE WHEN event_id % 2 = 0 THEN src ELSE 'fe80::' || lower(to_hex(event_id)) END AS ip,
  CASE WHEN event_id % 2 = 0 THEN 4 ELSE 6 END AS version FROM ev""")
def enr_ip(spark, sf):
    n = F.regexp_extract("trace.trace_id", r"0*(\d+)$", 1).cast("bigint")
    e = event_view(spark, sf).withColumn("ues", F.col("ues").withField("source.ip", F.when(
        n % 2 == 0, F.concat(F.lit(" "), "ues.source.ip")).otherwise(F.concat(F.lit("FE80:0:0:0:0:0:0:"), F.hex(n)))))
    return E.enr_ip(e).select(F.col("trace.trace_id").alias("tid"), F.col("ues.source.ip").alias("ip"),
                              F.col("ues.source.ip_version").alias("version"))


@query("enr_geo", f"""WITH {{EV}}, {_GEO} SELECT tid, true AS src_internal, true AS dst_internal, country, city FROM ev
  LEFT JOIN geo ON event_id % 256 BETWEEN lo AND hi""")
def enr_geo(spark, sf):
    e = E.enr_geo(event_view(spark, sf), _geo(spark, sf))
    g = "ues.geo."
    return e.select(F.col("trace.trace_id").alias("tid"), F.col(g + "source.internal").alias("src_internal"),
                    F.col(g + "destination.internal").alias("dst_internal"),
                    F.col(g + "destination.country").alias("country"), F.col(g + "destination.city").alias("city"))


_THREAT = f"""WITH {{EV}}, {_FEED}, j AS (SELECT ev.*, i.severity AS s1, s.severity AS s2 FROM ev
    LEFT JOIN feed i ON i.kind = 'ip' AND i.indicator = dst
    LEFT JOIN feed s ON s.kind = 'string' AND s.indicator = 'event ' || ev.kind),
  k AS (SELECT *, greatest(CASE WHEN s1 IS NOT NULL THEN {_SCORE.format('s1')} END,
    CASE WHEN s2 IS NOT NULL THEN {_SCORE.format('s2')} END) AS score FROM j),
  t AS (SELECT tid, CAST((s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT AS INTEGER) AS n, CAST(score AS INTEGER) AS score,
    CAST(CASE WHEN score > (CASE sev WHEN 70 THEN 70 WHEN 85 THEN 90 ELSE 10 END) THEN score ELSE sev END AS INTEGER) AS severity,
    score IS NOT NULL AS tagged, ms, src FROM k)"""


@query("enr_threat", _THREAT + " SELECT tid, n, score, severity, tagged FROM t")
def enr_threat(spark, sf):
    e = E.enr_threat(event_view(spark, sf), _feed(spark, sf))
    return e.select(F.col("trace.trace_id").alias("tid"), F.size(F.coalesce(
        "ues.threat.matched", F.array().cast("array<struct<field:string,indicator:string,type:string,severity:string,feed:string>>")
    )).alias("n"), F.col("ues.threat.score").alias("score"), F.col("ues.severity").alias("severity"),
        F.array_contains("ues.tags", "threat-intel").alias("tagged"))


@query("enr_classify", """WITH {EV} SELECT tid, CASE WHEN kind = 'error' THEN 'deny' ELSE act END AS act,
  CASE kind WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'success' END AS outc,
  CASE WHEN event_id % 2 = 0 THEN cat ELSE 'network' END AS cat,
  CASE WHEN event_id % 2 = 1 THEN 'connection' ELSE CASE cat WHEN 'authentication' THEN 'login' WHEN 'web' THEN 'http'
    ELSE 'event' END END AS type FROM ev""")
def enr_classify(spark, sf):
    n = F.regexp_extract("trace.trace_id", r"0*(\d+)$", 1).cast("bigint")
    e = event_view(spark, sf).withColumn("ues", F.col("ues").withField(
        "category", F.when(n % 2 == 0, F.col("ues.category"))).withField(
        "outcome", F.when(F.col("ues.outcome") == "success", "success")))
    return E.enr_classify(e).select(F.col("trace.trace_id").alias("tid"), F.col("ues.action").alias("act"),
                                    F.col("ues.outcome").alias("outc"), F.col("ues.category").alias("cat"),
                                    F.col("ues.type").alias("type"))


@query("enr_severity", """WITH {EV} SELECT tid, CASE sev WHEN 70 THEN 'high' WHEN 85 THEN 'critical' ELSE 'info' END AS label,
  CAST(CASE sev WHEN 85 THEN 90 ELSE sev END AS INTEGER) AS n FROM ev""")
def enr_severity(spark, sf):
    return E.enr_severity(event_view(spark, sf)).select(
        F.col("trace.trace_id").alias("tid"), F.col("ues.severity_label").alias("label"), F.col("ues.severity").alias("n"))


@query("enr_integrity", "WITH {EV} SELECT tid, CASE WHEN event_id % 10 = 0 THEN 'mismatch' ELSE 'verified' END AS status FROM ev")
def enr_integrity(spark, sf):
    e = event_view(spark, sf).withColumn("raw", F.when(F.col("trace.trace_id").endswith("0"), F.concat(
        "raw", F.lit("!"))).otherwise(F.col("raw")))
    return E.enr_integrity(e).select(F.col("trace.trace_id").alias("tid"), F.col("trace.status").alias("status"))


@query("enr_lookup", f"""WITH {{EV}}, {_GEO}, {_FEED}, v AS (SELECT DISTINCT dst AS value, event_id % 256 AS n FROM ev)
  SELECT value, country, type FROM v LEFT JOIN geo ON n BETWEEN lo AND hi
  LEFT JOIN feed ON feed.kind = 'ip' AND indicator = value""")
def enr_lookup(spark, sf):
    values = event_view(spark, sf).select(F.col("ues.destination.ip").alias("value")).distinct()
    return E.lookup_values(values, _geo(spark, sf), _feed(spark, sf)).select("value", "country", "hit.type")


_WORDS = "(exception|unhandled|stack trace|nullpointer|timeout|crash|out of memory|discarded|gateway)"
# Word boundaries of any script, written out: the SQL engine's own are ASCII.
_NO_WORD = r"[^\p{L}\p{M}\p{Nd}\p{Pc}]"


def _as_word(words: str) -> str:
    return f"(?:^|{_NO_WORD})(?:{words})(?:$|{_NO_WORD})"


@query("enr_classify_text", f"""SELECT doc_id, CASE
  WHEN regexp_matches(text, '(?i)(failed password|accepted password|accepted publickey|authentication|sshd|sudo|logon|logoff|login session|user session|invalid user|credentials)') THEN 'authentication'
  WHEN regexp_matches(text, '(?i)(worm|virus|malware|trojan|ransomware|botnet|{_as_word("c2")}|c&c|command and control|exploit)') THEN 'malware'
  WHEN regexp_matches(text, '(?i)(https?/|wp-login|{_as_word("http")})') THEN 'web'
  WHEN regexp_matches(text, '(?i){_as_word("tcp|udp|icmp|connection|session|firewall|acl")}') THEN 'network'
  WHEN regexp_matches(text, '(?i){_WORDS}') THEN 'application'
  WHEN contains(lower(text), 'port scan') THEN 'network' WHEN contains(lower(text), 'http') THEN 'web' ELSE 'system' END AS category
  FROM documents""")
def enr_classify_text(spark, sf):
    return table(spark, sf, "documents").withColumn("category", E.classify_text("text")).select("doc_id", "category")


@query("jn_geo_ranges_nested", """WITH {EV} SELECT tid, CASE WHEN event_id % 256 BETWEEN 64 AND 95 THEN 'inner' WHEN event_id % 256 < 128 THEN
    (CASE WHEN event_id % 256 < 64 THEN 'outer' END) END AS src_country, false AS src_internal,
  CASE event_id % 4 WHEN 0 THEN 'wide' WHEN 1 THEN 'narrow' WHEN 2 THEN NULL ELSE NULL END AS dst_country, event_id % 4 = 3 AS dst_internal FROM ev""")
def jn_geo_ranges_nested(spark, sf):
    """Nested ranges of both families: the last range that starts at or before the address decides."""
    ranges = geo_ranges(spark.createDataFrame([
        ("8.8.8.0", "8.8.8.127", "outer", ""), ("8.8.8.64", "8.8.8.95", "inner", ""),
        ("2600::", "26ff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "wide", ""), ("2600:1::", "2600:1:ffff:ffff:ffff:ffff:ffff:ffff", "narrow", ""),
    ], "start string, end string, country string, city string"))
    n = F.regexp_extract("trace.trace_id", r"0*(\d+)$", 1).cast("bigint")
    v6 = F.element_at(F.array(*map(F.lit, ("2600:0:5::1", "2600:1:5::1", "2607::1", "fd00::1"))), (n % 4 + 1).cast("int"))
    e = spread_view(spark, sf)
    ues = F.col("ues")
    e = e.withColumn("ues", ues.withField("source", ues["source"].withField("ip", F.concat(F.lit("8.8.8."), (n % 256).cast("string"))))
                     .withField("destination", ues["destination"].withField("ip", v6)))
    g = E.enr_geo(e, ranges)
    return g.select(F.col("trace.trace_id").alias("tid"), F.col("ues.geo.source.country").alias("src_country"),
                    F.col("ues.geo.source.internal").alias("src_internal"), F.col("ues.geo.destination.country").alias("dst_country"),
                    F.col("ues.geo.destination.internal").alias("dst_internal"))


_LONG = """f AS (SELECT 'lot ' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' of ' || lower(p_brand) END AS indicator, p_partkey AS ord FROM part),
  t AS (SELECT tid, 'saw lot ' || p_partkey || ' of ' || lower(p_brand) || ' at ' || src AS text FROM ev JOIN part ON p_partkey = event_id % (SELECT count(*) FROM part))"""


@query("jn_threat_string_long", f"""WITH {{EV}}, {_LONG} SELECT tid, indicator FROM (SELECT tid, min_by(indicator, ord) AS indicator FROM t JOIN f ON contains(text, indicator) GROUP BY tid)""")
def jn_threat_string_long(spark, sf):
    """As many indicators as there are parts."""
    part = table(spark, sf, "part")
    lot = F.concat(F.lit("lot "), F.col("p_partkey").cast("string"))
    name = F.concat(lot, F.lit(" of "), F.lower("p_brand"))
    feed = threat_indicators(part.select(F.when(F.col("p_partkey") % 3 == 0, lot).otherwise(name).alias("indicator"), F.lit("t").alias("type"),
                                         F.lit("high").alias("severity"), F.lit("f").alias("source"), F.col("p_partkey").alias("ord")))
    n = F.regexp_extract("trace.trace_id", r"0*(\d+)$", 1).cast("bigint")
    e = spread_view(spark, sf).withColumn("_k", n % part.count()).join(part.select(F.col("p_partkey").alias("_k"), name.alias("_n")), "_k")
    e = e.withColumn("ues", F.col("ues").withField("message", F.concat(F.lit("Saw "), F.upper("_n"), F.lit(" at "), "ues.source.ip")))
    return E.threat_string(e, feed).filter("hit_text IS NOT NULL").select(F.col("trace.trace_id").alias("tid"), F.col("hit_text_indicator").alias("indicator"))


@query("enr_classify_late", "WITH {EV} SELECT tid, CASE WHEN event_id % 2 = 0 THEN 'failure' ELSE 'success' END AS outc FROM ev")
def enr_classify_late(spark, sf):
    """The word that decides stands after 6 000 characters."""
    n = F.regexp_extract("trace.trace_id", r"0*(\d+)$", 1).cast("bigint")
    message = F.concat(F.repeat(F.lit("lorem "), 1000), F.when(n % 2 == 0, "login failed").otherwise("login succeeded"))
    e = spread_view(spark, sf).withColumn("ues", F.col("ues").withField("outcome", F.lit(None).cast("string")).withField(
        "message", message)).withColumn("raw", message)
    return E.enr_classify(e).select(F.col("trace.trace_id").alias("tid"), F.col("ues.outcome").alias("outc"))


@query("enr_order", _THREAT + f""", {_GEO} SELECT t.tid, score, CAST(CASE WHEN severity = 85 THEN 90 ELSE severity END AS INTEGER) AS severity,
  'verified' AS status, t.ms, country, city, true AS src_internal, 4 AS version, act, cat FROM t JOIN ev USING (tid) LEFT JOIN geo ON event_id % 256 BETWEEN lo AND hi""")
def enr_order(spark, sf):
    e = E.enrich(event_view(spark, sf), _geo(spark, sf), _feed(spark, sf))
    return e.select(F.col("trace.trace_id").alias("tid"), F.col("ues.threat.score").alias("score"),
                    F.col("ues.severity").alias("severity"), F.col("trace.status").alias("status"), ms("ues.event_time").alias("ms"),
                    F.col("ues.geo.destination.country").alias("country"), F.col("ues.geo.destination.city").alias("city"),
                    F.col("ues.geo.source.internal").alias("src_internal"), F.col("ues.source.ip_version").alias("version"),
                    F.col("ues.action").alias("act"), F.col("ues.category").alias("cat"))
