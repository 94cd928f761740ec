"""Windows and correlation patterns. The window is six hours: at the usual five minutes the test
events are too sparse to show anything."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlate as C, windows as W
from ..plans import queries as Q
from .base import event_fields, event_view, ms, query

HOURS6 = 21_600
PARAMS = C.Params(window=HOURS6, brute_window=HOURS6, group_window=HOURS6)
_W = f"PARTITION BY src ORDER BY ms RANGE BETWEEN {HOURS6 * 1000} PRECEDING AND CURRENT ROW"
_WA = f"PARTITION BY src, act ORDER BY ms RANGE BETWEEN {HOURS6 * 1000} PRECEDING AND CURRENT ROW"

# Per event: counts and evidence of the trailing window, the event itself included.
_ROLES = f"""r AS (SELECT *, count(*) FILTER (WHERE kind = 'error') OVER w AS nf, count(*) FILTER (WHERE kind = 'signup') OVER w AS ns,
    count(*) FILTER (WHERE kind = 'click') OVER w AS nc, count(*) FILTER (WHERE dport = 22) OVER w AS nh,
    list(tid) FILTER (WHERE kind = 'error') OVER w AS lf, list(tid) FILTER (WHERE kind = 'signup') OVER w AS ls,
    list(tid) FILTER (WHERE dport = 22) OVER w AS lh, list(tid) FILTER (WHERE kind <> 'view') OVER w AS la
  FROM ev WINDOW w AS ({_W}))"""
_REPEATED = f"""r AS (SELECT *, count(*) OVER w AS n, list(tid) OVER w AS l FROM ev WHERE kind = 'error' WINDOW w AS ({_WA}))"""

_CAND = {
    C.FAILURES: ("kind = 'error' AND nf >= 5", "src", "nf", "lf[-5:]", "least(96, 82 + greatest(0, nf - 5) * 2)"),
    C.SSH: ("dport = 22 AND nh >= 3", "src || ':22'", "nh", "lh[-20:]", "least(95, 78 + greatest(0, nh - 3) * 4)"),
    C.SUCCESS: ("kind = 'signup' AND nf >= 5", "src", "nf", "list_append(lf[-5:], tid)", "least(96, 82 + greatest(0, nf - 5) * 2)"),
    C.PRIVILEGE: ("kind = 'purchase' AND ns > 0", "src || ':' || usr", "ns", "list_append(ls[-1:], tid)", "92"),
    C.CHAIN: ("kind = 'purchase' AND ns > 0 AND nc > 0 AND nf > 0", "src || ':' || usr", "len(la)", "la[-10:]", "98"),
    C.REPEATED: ("n >= 3", "src || ':' || act", "n", "l[-20:]", "least(85, 60 + greatest(0, n - 3) * 4)"),
}


def _candidates(pattern: str) -> str:
    where, fp, n, ids, risk = _CAND[pattern]
    return (f"SELECT '{pattern}' AS type, '{pattern}:' || {fp} AS fp, ms, tid, src, usr, CAST({risk} AS INTEGER) AS risk, "
            f"{ids} AS ids FROM r WHERE {where}")


def _fired(candidates: str, roles: str = _ROLES, seconds: int = 600) -> str:
    """Candidates and the greedy cooldown over them."""
    return f"""WITH RECURSIVE {{EV}}, {roles}, c AS ({candidates}),
  f AS (SELECT fp, min(ms) AS ms FROM c GROUP BY fp UNION ALL
    SELECT c.fp, min(c.ms) FROM f JOIN c ON c.fp = f.fp AND c.ms >= f.ms + {seconds * 1000} GROUP BY c.fp),
  x AS (SELECT c.* FROM c JOIN f ON c.fp = f.fp AND c.ms = f.ms)"""


_CASE = """SELECT 'COR-' || substr(sha256(type || '|' || src || '|' || usr || '|' || array_to_string(ids, '|')), 1, 16) AS correlation_id,
  type, src AS source_ip, usr AS username, ms AS created_ms, risk AS risk_score, CAST(len(ids) AS INTEGER) AS event_count,
  array_to_string(ids, ',') AS trace_ids FROM x"""


def _case_cols(cases):
    return cases.select("correlation_id", "type", "source_ip", F.col("user").alias("username"),
                        ms("created_at").alias("created_ms"), "risk_score", "event_count",
                        F.array_join("trace_ids", ",").alias("trace_ids"))


# Every third error is a denial and no failed login (see ``mixed``), so that all six patterns have something to find.
_LOGIN = "kind = 'error' AND event_id % 3 <> 0"
_MIXED_ROLES = (_ROLES.replace("kind = 'error'", _LOGIN).replace("kind <> 'view'", f"(kind NOT IN ('view', 'error') OR {_LOGIN})")
                + f""", q AS (SELECT *, count(*) OVER w AS n, list(tid) OVER w AS l FROM ev WHERE kind = 'error' WINDOW w AS ({_WA}))""")


def _mixed_candidates() -> str:
    one = {p: _candidates(p) for p in C.PATTERNS}
    one[C.FAILURES] = one[C.FAILURES].replace("kind = 'error'", _LOGIN)
    one[C.REPEATED] = one[C.REPEATED].replace("FROM r WHERE", "FROM q WHERE event_id % 3 = 0 AND")
    return " UNION ALL ".join(one.values())


ALL_SQL = _fired(_mixed_candidates(), _MIXED_ROLES) + " " + _CASE


def mixed(events):
    """Events whose every third error is filed under "network"."""
    n = F.regexp_extract("trace.trace_id", r"0*(\d+)$", 1).cast("bigint")
    network = (F.col("ues.action") == "deny") & (n % 3 == 0)
    return events.withColumn("ues", F.col("ues").withField("category", F.when(network, "network").otherwise(F.col("ues.category"))))


def _pattern(name: str, pattern: str, job, error_category: str | None = None):
    roles = _REPEATED if pattern == C.REPEATED else _ROLES

    @query(name, _fired(_candidates(pattern), roles) + " " + _CASE)
    def run(spark, sf):
        return _case_cols(job(event_view(spark, sf, error_category), PARAMS))


_pattern("cor_bruteforce_failures", C.FAILURES, C.cor_bruteforce_failures)
_pattern("cor_repeated_failures", C.REPEATED, C.cor_repeated_failures, "network")
_pattern("cor_ssh_bruteforce", C.SSH, C.cor_ssh_bruteforce)
_pattern("cor_bruteforce_success", C.SUCCESS, C.cor_bruteforce_success)
_pattern("cor_auth_privilege", C.PRIVILEGE, C.cor_auth_privilege)
_pattern("cor_intrusion_chain", C.CHAIN, C.cor_intrusion_chain)


@query("cor_all", ALL_SQL)
def cor_all(spark, sf):
    return _case_cols(C.correlate(mixed(event_view(spark, sf)), PARAMS)[0])


_ONE = _fired(_candidates(C.SUCCESS))


@query("cor_case", _ONE + """ SELECT 'correlation-brute-force-success' AS rule_id, src AS source_ip, risk AS risk_score,
  CASE WHEN risk >= 95 THEN 'critical' ELSE 'high' END AS severity, CAST(len(ids) AS INTEGER) AS event_count,
  (risk - 82) // 2 + 5 || ' authentication failures from ' || src || ' were followed by a successful authentication within 5 minutes.' AS description,
  (ms - (SELECT e.ms FROM ev e WHERE e.tid = ids[1])) // 1000 AS duration_seconds FROM x""")
def cor_case(spark, sf):
    c = C.cor_bruteforce_success(event_view(spark, sf), PARAMS)
    return c.select("rule_id", "source_ip", "risk_score", "severity", "event_count", "description", "duration_seconds")


@query("cor_case_alert", _ONE + """ SELECT 'COR-' || substr(sha256(type || '|' || src || '|' || usr || '|' || array_to_string(ids, '|')), 1, 16) AS alert_id,
  'correlation-' || type AS rule, tid AS trace_id, false AS acknowledged,
  (SELECT sha256('line ' || e.event_id || ' by ' || e.usr) FROM ev e WHERE e.tid = x.tid) AS raw_hash FROM x""")
def cor_case_alert(spark, sf):
    c = C.cases_to_alerts(C.cor_bruteforce_success(event_view(spark, sf), PARAMS))
    return c.select("alert_id", "rule", "trace_id", "acknowledged", "raw_hash")


@query("cor_risk", """SELECT t AS type, event_id % 15 AS n, CAST(CASE t WHEN 'brute-force-success' THEN least(96, 82 + greatest(0, event_id % 15 - 5) * 2)
  WHEN 'auth-privilege' THEN 92 WHEN 'intrusion-chain' THEN 98 WHEN 'repeated-failures' THEN least(85, 60 + greatest(0, event_id % 15 - 3) * 4)
  ELSE 75 END AS INTEGER) AS risk FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'brute-force-success' WHEN 'view' THEN 'auth-privilege'
  WHEN 'click' THEN 'intrusion-chain' WHEN 'signup' THEN 'repeated-failures' ELSE 'other' END AS t FROM events)""")
def cor_risk(spark, sf):
    k = F.col("kind")
    t = (F.when(k == "error", C.SUCCESS).when(k == "view", C.PRIVILEGE).when(k == "click", C.CHAIN)
         .when(k == "signup", C.REPEATED).otherwise("other"))
    n = F.col("event_id") % 15
    return event_fields(spark, sf).select(t.alias("type"), n.alias("n"), C.risk(t, n).alias("risk"))


@query("cor_rehydrate", _ONE + """ SELECT CASE WHEN ms % 2 = 0 THEN 'stored' ELSE 'replayed' END AS origin, src AS source_ip, ms FROM x""")
def cor_rehydrate(spark, sf):
    """Half of the alerts are stored; the replay adds the cases of the others."""
    e = event_view(spark, sf)
    alerts = C.cases_to_alerts(C.cor_bruteforce_success(e, PARAMS)).filter(ms("created_at") % 2 == 0)
    r = C.rehydrate(alerts, e, PARAMS)
    return r.filter(F.col("type") == C.SUCCESS).select("origin", "source_ip", ms("created_at").alias("ms"))


@query("set_merge_cases", _ONE + " SELECT src AS source_ip, ms FROM x")
def set_merge_cases(spark, sf):
    c = C.cor_bruteforce_success(event_view(spark, sf), PARAMS)
    return C.merge_cases(c.filter(ms("created_at") % 2 == 0), c).select("source_ip", ms("created_at").alias("ms"))


# --- windows ---------------------------------------------------------------------------------
def _flagged(spark, sf):
    return event_fields(spark, sf).select("tid", "t", "src", "kind", (F.col("kind") == "error").alias("bad"))


_RECENT = f"""SELECT tid, least(count(*) FILTER (WHERE kind = 'error') OVER w,
  count(*) FILTER (WHERE kind = 'error') OVER (PARTITION BY src ORDER BY ms ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) AS n
  FROM ev WINDOW w AS (PARTITION BY src ORDER BY ms RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW)"""


@query("win_recent_count", "WITH {EV} " + _RECENT)
def win_recent_count(spark, sf):
    return W.recent_count(_flagged(spark, sf), F.col("bad"), ["src"], "t", "tid", 86_400, cap=20).select("tid", "n")


@query("win_recent_evidence", f"""WITH {{EV}}, r AS (SELECT *, (list(tid) FILTER (WHERE kind = 'error') OVER w)[-5:] AS l FROM ev WINDOW w AS ({_W}))
  SELECT tid AS firing, unnest(l) AS evidence FROM r WHERE kind = 'signup'""")
def win_recent_evidence(spark, sf):
    f = _flagged(spark, sf)
    return W.recent_evidence(f, F.col("kind") == "signup", F.col("bad"), ["src"], "t", "tid", HOURS6, 5).select("firing", "evidence")


@query("win_failed_history", """WITH {EV} SELECT tid, CAST(len(l[-20:]) AS INTEGER) AS n, l[-20:][1] AS first_ms FROM (
  SELECT tid, list(ms) OVER (PARTITION BY src ORDER BY ms RANGE BETWEEN 43200000 PRECEDING AND CURRENT ROW) AS l FROM ev WHERE kind = 'error')""")
def win_failed_history(spark, sf):
    h = W.failed_history(_flagged(spark, sf), F.col("bad"), ["src"], "t", "tid", 43_200, 20)
    return h.select("tid", F.size("history").alias("n"), F.get("history", 0).alias("first_ms"))


@query("win_cooldown", """WITH RECURSIVE {EV}, c AS (SELECT src || ':' || kind AS fp, ms, tid FROM ev),
  f AS (SELECT fp, min(ms) AS ms FROM c GROUP BY fp UNION ALL
    SELECT c.fp, min(c.ms) FROM f JOIN c ON c.fp = f.fp AND c.ms >= f.ms + 21600000 GROUP BY c.fp)
  SELECT c.fp, c.tid FROM c JOIN f ON c.fp = f.fp AND c.ms = f.ms""")
def win_cooldown(spark, sf):
    c = event_fields(spark, sf).select(F.concat_ws(":", "src", "kind").alias("fp"), "t", "tid")
    return W.cooldown(c, "fp", "t", "tid", HOURS6).select("fp", "tid")


@query("win_latest_per_key", "WITH {EV} SELECT usr, max(ms) AS ms, arg_max(tid, ms) AS tid FROM ev GROUP BY usr")
def win_latest_per_key(spark, sf):
    f = event_fields(spark, sf).select("usr", ms("t").alias("ms"), "tid")
    return W.latest(f, ["usr"], ["ms", "tid"])


# --- cases and events ------------------------------------------------------------------------
@query("jn_case_events", _ONE + """ SELECT tid AS fired_by, CAST(i - 1 AS INTEGER) AS pos, ids[i] AS trace_id,
  (SELECT act FROM ev e WHERE e.tid = ids[i]) AS action FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM x)""")
def jn_case_events(spark, sf):
    e = event_view(spark, sf)
    c = C.cor_bruteforce_success(e, PARAMS)
    n = Q.case_events(c, e, 8)
    return n.join(c.select("correlation_id", F.col("trigger_trace_id").alias("fired_by")), "correlation_id").select(
        "fired_by", "pos", "trace_id", "action")


@query("qry_trace_graph", _ONE + """ SELECT ids[i] AS trace_id, ids[i + 1] AS next_trace_id FROM (
  SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM x)""")
def qry_trace_graph(spark, sf):
    e = event_view(spark, sf)
    return Q.trace_graph(C.cor_bruteforce_success(e, PARAMS), e, 8).select("trace_id", "next_trace_id")


@query("qry_cases", _ONE + " SELECT src AS source_ip, ms FROM x ORDER BY ms DESC LIMIT 5")
def qry_cases(spark, sf):
    return Q.recent_cases(C.cor_bruteforce_success(event_view(spark, sf), PARAMS), 5).select(
        "source_ip", ms("created_at").alias("ms"))


@query("srt_cases_recent", _ONE + " SELECT src AS source_ip, ms FROM x ORDER BY ms DESC LIMIT 3 OFFSET 3")
def srt_cases_recent(spark, sf):
    return Q.recent_cases(C.cor_bruteforce_success(event_view(spark, sf), PARAMS), 3, 2).select(
        "source_ip", ms("created_at").alias("ms"))


@query("qry_case_by_id", _ONE + """, y AS (SELECT 'COR-' || substr(sha256(type || '|' || src || '|' || usr || '|' || array_to_string(ids, '|')), 1, 16) AS id, * FROM x)
  SELECT id AS correlation_id, src AS source_ip FROM y WHERE id = (SELECT min(id) FROM y)""")
def qry_case_by_id(spark, sf):
    c = C.cor_bruteforce_success(event_view(spark, sf), PARAMS)
    first = c.agg(F.min("correlation_id")).first()[0] or ""
    return Q.case_by_id(c, first).select("correlation_id", "source_ip")


@query("snk_case_rows", _ONE + " SELECT type AS case_type, src AS source_ip, usr AS username, risk AS risk_score, 'open' AS status FROM x")
def snk_case_rows(spark, sf):
    from ..sinks.tables import case_rows

    return case_rows(C.cor_bruteforce_success(event_view(spark, sf), PARAMS)).select(
        "case_type", "source_ip", "username", "risk_score", "status")


@query("agg_engine_stats", _ONE + """, k AS (SELECT count(DISTINCT src) AS a, count(DISTINCT usr) AS b,
  count(DISTINCT CASE WHEN kind = 'error' THEN src || ':' || act END) AS c, count(*) AS d FROM ev)
  SELECT unnest(['tracked_sources','tracked_users','tracked_failure_keys','events_seen','cases_generated']) AS stat,
    unnest([a, b, c, d, (SELECT count(*) FROM x)]) AS value FROM k""")
def agg_engine_stats(spark, sf):
    e = event_view(spark, sf)
    return Q.correlation_stats(C.flagged(e), C.cor_bruteforce_success(e, PARAMS))


@query("qry_stats", _ONE + """, k AS (SELECT count(DISTINCT src) AS a, count(DISTINCT usr) AS b,
  count(DISTINCT CASE WHEN kind = 'error' THEN src || ':' || act END) AS c, count(*) AS d FROM ev)
  SELECT unnest(['received','parsed','failed','with_warnings','threat_hits','tracked_sources','tracked_users','tracked_failure_keys','events_seen','cases_generated']) AS stat,
    unnest([d, d, 0, 0, 0, a, b, c, d, (SELECT count(*) FROM x)]) AS value FROM k
  UNION ALL SELECT 'parser:' || fmt, count(*) FROM ev GROUP BY 1""")
def qry_stats(spark, sf):
    e = event_view(spark, sf)
    return Q.stats(e, C.flagged(e), C.cor_bruteforce_success(e, PARAMS))



