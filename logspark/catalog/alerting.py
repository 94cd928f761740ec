"""Alert rules, grouping, sessions. The view files errors under "network", so that they are
denials and not failed logins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators import dedup as D
from ..plans import queries as Q
from .base import event_fields, event_view, ms, query
from .lookups import _FEED, _SCORE, _feed
from ..operators.enrich import enr_threat

_DENY = "SELECT 'security-failure' AS rule, ms, tid, src, fmt, 'high' AS severity, 'Normalized action=deny, outcome=failure.' AS reason FROM ev WHERE kind = 'error'"
_HIGH = "SELECT 'high-severity' AS rule, ms, tid, src, fmt, 'high' AS severity, 'Normalized event severity is 85/100.' AS reason FROM ev WHERE sev >= 80"


def _fired(cand: str, seconds: int, ctes: str = "") -> str:
    return f"""WITH RECURSIVE {{EV}}, {ctes} c AS ({cand}),
  f AS (SELECT rule, src, min(ms) AS ms FROM c GROUP BY 1, 2 UNION ALL
    SELECT c.rule, c.src, min(c.ms) FROM f JOIN c ON c.rule = f.rule AND c.src = f.src AND c.ms >= f.ms + {seconds * 1000} GROUP BY 1, 2),
  a AS (SELECT c.*, 'AL-' || c.ms || '-' || substr(sha256(c.rule || '|' || tid), 1, 8) AS alert_id
    FROM c JOIN f ON c.rule = f.rule AND c.src = f.src AND c.ms = f.ms)"""


_COLS = " SELECT alert_id, rule, ms, tid AS trace_id, src AS source_ip, fmt AS parser, severity, reason FROM a"


def _cols(a):
    return a.select("alert_id", "rule", ms("created_at").alias("ms"), "trace_id", "source_ip", "parser", "severity", "reason")


def _net(spark, sf):
    return event_view(spark, sf, "network")


SIX = 21_600


def _all(spark, sf, seconds: int = SIX):
    return A.evaluate_alerts(_net(spark, sf), {A.SEVERE: seconds, A.DENIED: seconds}, (A.SEVERE, A.DENIED))


_ALL = _fired(f"{_DENY} UNION ALL {_HIGH}", SIX)


@query("alr_security_failure", _fired(_DENY, SIX) + _COLS)
def alr_security_failure(spark, sf):
    return _cols(A.alr_security_failure(_net(spark, sf), SIX))


@query("alr_high_severity", _fired(_HIGH, 60) + _COLS)
def alr_high_severity(spark, sf):
    return _cols(A.alr_high_severity(event_view(spark, sf)))


_THREAT_CAND = f"""SELECT 'threat-intel-match' AS rule, ms, tid, src, fmt,
    CASE WHEN greatest(CASE WHEN i.severity IS NOT NULL THEN {_SCORE.format('i.severity')} END,
      CASE WHEN s.severity IS NOT NULL THEN {_SCORE.format('s.severity')} END) >= 90 THEN 'critical' ELSE 'high' END AS severity,
    'Local threat-intel feed matched ' || ((i.severity IS NOT NULL)::INT + (s.severity IS NOT NULL)::INT) || ' indicator(s).' AS reason
  FROM ev LEFT JOIN feed i ON i.kind = 'ip' AND i.indicator = dst LEFT JOIN feed s ON s.kind = 'string' AND s.indicator = 'event ' || ev.kind
  WHERE i.severity IS NOT NULL OR s.severity IS NOT NULL"""


@query("alr_threat", _fired(_THREAT_CAND, 300, _FEED + ",") + _COLS)
def alr_threat(spark, sf):
    return _cols(A.alr_threat(enr_threat(event_view(spark, sf), _feed(spark, sf))))


_RAISED = f"""{_FEED}, j AS (SELECT ev.*, i.severity AS s1, s.severity AS s2 FROM ev LEFT JOIN feed i ON i.kind = 'ip' AND i.indicator = dst
    LEFT JOIN feed s ON s.kind = 'string' AND s.indicator = 'event ' || ev.kind),
  k AS (SELECT *, greatest(CASE WHEN s1 IS NOT NULL THEN {_SCORE.format('s1')} END, CASE WHEN s2 IS NOT NULL THEN {_SCORE.format('s2')} END) AS score FROM j),
  v AS (SELECT *, CASE WHEN score > (CASE sev WHEN 70 THEN 70 WHEN 85 THEN 90 ELSE 10 END) THEN score ELSE sev END AS raised FROM k),"""
_HIGH_RAISED = """SELECT 'high-severity' AS rule, ms, tid, src, fmt, CASE WHEN raised >= 90 THEN 'critical' ELSE 'high' END AS severity,
    'Normalized event severity is ' || raised || '/100.' AS reason FROM v WHERE raised >= 80"""


@query("alr_evaluate", _fired(f"{_DENY} UNION ALL {_HIGH_RAISED} UNION ALL {_THREAT_CAND}", SIX, _RAISED) + _COLS)
def alr_evaluate(spark, sf):
    """All three rules over enriched events, whose severity an indicator may have raised."""
    events = enr_threat(_net(spark, sf), _feed(spark, sf))
    return _cols(A.evaluate_alerts(events, dict.fromkeys(A.COOLDOWNS, SIX)))


def _plain(spark, sf):
    """One alert per event, straight from the columns."""
    f = event_fields(spark, sf)
    rule = F.when(F.col("kind") == "error", A.DENIED).when(F.col("kind") == "purchase", A.SEVERE).when(
        F.col("kind") == "signup", "correlation-brute-force-success").otherwise("internal-note")
    return f.select(
        F.concat(F.lit("A"), "tid").alias("alert_id"), rule.alias("rule"), F.col("src").alias("source_ip"),
        F.col("t").alias("created_at"), F.col("tid").alias("trace_id"), F.col("kind").alias("parser"),
        F.when(F.col("dport") == 22, "critical").otherwise("high").alias("severity"), F.lit("Issue").alias("title"),
        F.concat(F.lit("Normalized action="), "act", F.lit(", outcome=n/a.")).alias("reason"),
        (F.col("event_id") % 2 == 0).alias("acknowledged"))


_PLAIN = """p AS (SELECT 'A' || tid AS alert_id, CASE kind WHEN 'error' THEN 'security-failure' WHEN 'purchase' THEN 'high-severity'
  WHEN 'signup' THEN 'correlation-brute-force-success' ELSE 'internal-note' END AS rule, src AS source_ip, ms, tid AS trace_id, kind AS parser,
  CASE WHEN dport = 22 THEN 'critical' ELSE 'high' END AS severity, 'Normalized action=' || act || ', outcome=n/a.' AS reason,
  event_id, act, event_id % 2 = 0 AS acknowledged FROM ev)"""


@query("alr_visible", f"WITH {{EV}}, {_PLAIN} SELECT alert_id, rule FROM p WHERE rule <> 'internal-note'")
def alr_visible(spark, sf):
    return A.visible_alerts(_plain(spark, sf)).select("alert_id", "rule")


@query("alr_ack", f"""WITH {{EV}}, {_PLAIN} SELECT alert_id, CASE WHEN event_id % 3 = 0 THEN event_id % 6 = 0 ELSE acknowledged END AS acknowledged FROM p""")
def alr_ack(spark, sf):
    alerts = _plain(spark, sf)
    n = F.regexp_extract("alert_id", r"0*(\d+)$", 1).cast("bigint")
    log = alerts.filter(n % 3 == 0).select("alert_id", F.explode(F.array(
        F.struct(F.lit(1).alias("acked_at"), (n % 6 != 0).alias("acknowledged")),
        F.struct(F.lit(2).alias("acked_at"), (n % 6 == 0).alias("acknowledged")))).alias("x")).select("alert_id", "x.*")
    return A.acknowledge(alerts, log).select("alert_id", "acknowledged")


@query("agg_unacked", "WITH {EV} SELECT count(*) AS unacknowledged FROM ev WHERE event_id % 2 = 1")
def agg_unacked(spark, sf):
    return Q.count_unacked(_plain(spark, sf))


@query("agg_alert_groups", f"""WITH {{EV}}, {_PLAIN} SELECT rule, source_ip, count(*) AS n_alerts, count(DISTINCT trace_id) AS event_count,
  bool_and(acknowledged) AS acknowledged, max(ms) AS ms,
  CASE WHEN count(*) > 1 THEN 'GROUP-' || rule || '-' || source_ip ELSE max(alert_id) END AS alert_id,
  CASE WHEN count(*) > 1 THEN 'Issue (' || count(*) || ' events)' ELSE 'Issue' END AS title FROM p
  WHERE rule <> 'internal-note' GROUP BY rule, source_ip""")
def agg_alert_groups(spark, sf):
    return A.group_alerts(_plain(spark, sf)).select(
        "rule", "source_ip", "n_alerts", "event_count", "acknowledged", ms("created_at").alias("ms"), "alert_id", "title")


@query("agg_alert_groups_members", f"WITH {{EV}}, {_PLAIN} SELECT rule, source_ip, alert_id, trace_id FROM p WHERE rule <> 'internal-note'")
def agg_alert_groups_members(spark, sf):
    return A.group_members(A.visible_alerts(_plain(spark, sf)))


_SESSIONS = f"""WITH {{EV}}, {_PLAIN}, q AS (SELECT *, rule || '|' || source_ip || '|' || act AS fp FROM p WHERE rule IN ('security-failure', 'high-severity')),
  g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY fp ORDER BY ms) <= {{GAP}} THEN 0 ELSE 1 END AS new FROM q),
  s AS (SELECT *, sum(new) OVER (PARTITION BY fp ORDER BY ms) AS sid FROM g)"""
_GAP = 7_200


@query("win_sessionize_alerts", _SESSIONS.replace("{GAP}", str(_GAP * 1000)) + """ SELECT fp AS fingerprint, min(ms) AS first_ms, max(ms) AS last_ms,
  count(*) AS group_size, (max(ms) - min(ms)) // 1000 AS duration_seconds, CASE WHEN bool_or(severity = 'critical') THEN 'critical' ELSE 'high' END AS severity,
  'GROUP-' || any_value(rule) || '-' || any_value(source_ip) || '-' || arg_min(alert_id, ms) AS alert_id, arg_max(trace_id, ms) AS trace_id,
  bool_and(acknowledged) AS acknowledged FROM s GROUP BY fp, sid""")
def win_sessionize_alerts(spark, sf):
    s = A.sessionize(_plain(spark, sf), _GAP)
    return s.select("fingerprint", ms("first_seen").alias("first_ms"), ms("last_seen").alias("last_ms"), "group_size",
                    "duration_seconds", "severity", "alert_id", "trace_id", "acknowledged")


@query("set_union_alerts", f"WITH {{EV}}, {_PLAIN} SELECT alert_id, CASE WHEN rule = 'high-severity' THEN 1.0 END AS score FROM p WHERE rule IN ('security-failure', 'high-severity')")
def set_union_alerts(spark, sf):
    a = _plain(spark, sf)
    b = a.filter(F.col("rule") == A.SEVERE).withColumn("score", F.lit(1.0))
    return D.union_alerts(a.filter(F.col("rule") == A.DENIED), b).select("alert_id", "score")


@query("jn_alert_events", f"WITH {{EV}}, {_PLAIN} SELECT alert_id, ev.tid AS trace_id, ev.usr FROM p JOIN ev ON ev.tid = p.trace_id WHERE ev.event_id % 3 = 0")
def jn_alert_events(spark, sf):
    flat = event_fields(spark, sf).filter("event_id % 3 = 0").select(F.col("tid").alias("trace_id"), "usr")
    return Q.alert_events(A.alert_members(_plain(spark, sf)), flat).select("alert_id", "trace_id", "usr")


@query("jn_alert_auth_anti", f"WITH {{EV}}, {_PLAIN} SELECT alert_id FROM p WHERE NOT (rule = 'security-failure' AND event_id % 4 <> 0)")
def jn_alert_auth_anti(spark, sf):
    """Events with an id divisible by four are unknown, so their alerts stay."""
    known = event_fields(spark, sf).filter("event_id % 4 <> 0").select(
        F.col("tid").alias("trace_id"), (F.col("kind") == "error").alias("is_auth_failure"))
    return A.drop_auth_only_alerts(_plain(spark, sf), known).select("alert_id")


@query("qry_alerts", f"WITH {{EV}}, {_PLAIN} SELECT alert_id, ms FROM p ORDER BY ms DESC LIMIT 50 OFFSET 50")
def qry_alerts(spark, sf):
    return Q.alerts(_plain(spark, sf), 50, 2).select("alert_id", ms("created_at").alias("ms"))


@query("snk_alert_rows", f"""WITH {{EV}}, {_PLAIN} SELECT alert_id, rule AS rule_id, CAST(CASE severity WHEN 'critical' THEN 100 ELSE 80 END AS INTEGER) AS severity,
  severity AS severity_label, '' AS description, CASE WHEN acknowledged THEN 'acknowledged' ELSE 'open' END AS status FROM p""")
def snk_alert_rows(spark, sf):
    from ..sinks.tables import alert_rows

    return alert_rows(_plain(spark, sf)).select("alert_id", "rule_id", "severity", "severity_label", "description", "status")
