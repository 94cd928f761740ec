"""Alert rules on normalized events, their cooldown, grouping and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.predicates import event_text, failed_auth_alert, visible_rule
from ..functions.tables import DENY_ACTIONS, VISIBLE_RULES
from ..functions.timestamps import epoch_ms
from .windows import cooldown, session_ids

THREAT, SEVERE, DENIED = "threat-intel-match", "high-severity", "security-failure"
COOLDOWNS = {THREAT: 300, SEVERE: 60, DENIED: 30}
_RULE = "struct<rule:string,title:string,reason:string,severity:string>"


def _rule(name: str, title: str, reason: Column, severity: Column | str, when: Column) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(when, F.struct(F.lit(name).alias("rule"), F.lit(title).alias("title"),
                                 reason.alias("reason"), severity.alias("severity")))


def _rules() -> dict[str, Column]:
    action = F.coalesce(F.lower("ues.action"), F.lit(""))
    outcome = F.coalesce(F.lower("ues.outcome"), F.lit(""))
    severity = F.coalesce(F.col("ues.severity"), F.lit(0))
    matches = F.coalesce(F.size("ues.threat.matched"), F.lit(0))
    other = ~F.col("_failed_auth")

    def shown(v: Column) -> Column:
        return F.when(v == "", "n/a").otherwise(v)

    return {
        THREAT: _rule(THREAT, "Threat intelligence match", F.concat(
            F.lit("Local threat-intel feed matched "), matches.cast("string"), F.lit(" indicator(s).")),
            F.when(F.coalesce(F.col("ues.threat.score"), F.lit(0)) >= 90, "critical").otherwise("high"),
            matches > 0),
        SEVERE: _rule(SEVERE, "High severity event", F.concat(
            F.lit("Normalized event severity is "), severity.cast("string"), F.lit("/100.")),
            F.when(severity >= 90, "critical").otherwise("high"), (severity >= 80) & other),
        DENIED: _rule(DENIED, "Security failure / denied action", F.concat(
            F.lit("Normalized action="), shown(action), F.lit(", outcome="), shown(outcome), F.lit(".")),
            "high", (action.isin(DENY_ACTIONS) | (outcome == "failure")) & other),
    }


def alert_candidates(events: DataFrame, rules: tuple[str, ...] = tuple(COOLDOWNS)) -> DataFrame:
    """One row per (event, rule) that applies."""
    events = events.withColumn("_failed_auth", failed_auth_alert(event_text("ues", "raw")))
    table = _rules()
    hits = F.array_compact(F.array(*[table[r] for r in rules]))
    source = F.coalesce(F.col("ues.source.ip"), F.lit(""))
    out = events.select(
        F.explode(hits).alias("r"), F.col("ues.event_time").alias("created_at"),
        F.col("trace.trace_id").alias("trace_id"), F.when(source != "", source).alias("source_ip"),
        F.col("meta.parser").alias("parser"), F.col("trace.raw_hash").alias("raw_hash"))
    return out.select("r.*", "created_at", "trace_id", "source_ip", "parser", "raw_hash").withColumn(
        "fingerprint", F.concat(F.col("rule"), F.lit(":"), F.coalesce("source_ip", F.lit("unknown"))))


def evaluate_alerts(events: DataFrame, cooldowns: dict[str, int] | None = None,
                    rules: tuple[str, ...] = tuple(COOLDOWNS)) -> DataFrame:
    """Alerts of all rules after the cooldown per rule and source (alr_evaluate)."""
    periods = {**COOLDOWNS, **(cooldowns or {})}
    cand = alert_candidates(events, rules)
    seconds = None
    for rule in rules:
        cond = F.col("rule") == rule
        seconds = F.when(cond, periods[rule]) if seconds is None else seconds.when(cond, periods[rule])
    fired = cooldown(cand, "fingerprint", "created_at", "trace_id", seconds)
    alert_id = F.concat(F.lit("AL-"), epoch_ms("created_at").cast("string"), F.lit("-"),
                        F.substring(F.sha2(F.concat_ws("|", "rule", "trace_id"), 256), 1, 8))
    return fired.select(
        alert_id.alias("alert_id"), "created_at", "rule", "title", "severity", "reason", "trace_id",
        "source_ip", "parser", "raw_hash", F.lit(False).alias("acknowledged"))


def alr_threat(events: DataFrame, seconds: int = 300) -> DataFrame:
    return evaluate_alerts(events, {THREAT: seconds}, (THREAT,))


def alr_high_severity(events: DataFrame, seconds: int = 60) -> DataFrame:
    return evaluate_alerts(events, {SEVERE: seconds}, (SEVERE,))


def alr_security_failure(events: DataFrame, seconds: int = 30) -> DataFrame:
    return evaluate_alerts(events, {DENIED: seconds}, (DENIED,))


def visible_alerts(alerts: DataFrame) -> DataFrame:
    """The three rules and every correlation rule (alr_visible)."""
    return alerts.filter(visible_rule(F.coalesce("rule", F.lit("")), VISIBLE_RULES))


def acknowledge(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Applies an append-only log (alert_id, acknowledged, acked_at): the latest entry counts
    (alr_ack)."""
    state = acks.groupBy("alert_id").agg(F.max_by("acknowledged", "acked_at").alias("_ack"))
    return (alerts.join(state, "alert_id", "left")
            .withColumn("acknowledged", F.coalesce("_ack", "acknowledged")).drop("_ack"))


def acknowledge_group(alerts: DataFrame, group_ids: DataFrame, acked_at: Column) -> DataFrame:
    """Log entries that acknowledge every alert of the given (rule, source_ip) groups."""
    member = alerts.withColumn("_s", F.coalesce("source_ip", F.lit("unknown")))
    wanted = group_ids.select("rule", F.coalesce("source_ip", F.lit("unknown")).alias("_s")).distinct()
    return member.join(wanted, ["rule", "_s"], "left_semi").select(
        "alert_id", F.lit(True).alias("acknowledged"), acked_at.alias("acked_at"))


def evidence_ids(alerts: DataFrame) -> Column:
    """Trace ids an alert rests on."""
    one = F.array_compact(F.array(F.col("trace_id")))
    if "evidence_trace_ids" in alerts.columns:
        return F.when(F.size(F.coalesce("evidence_trace_ids", F.array().cast("array<string>"))) > 0,
                      F.col("evidence_trace_ids")).otherwise(one)
    return one


def alert_members(alerts: DataFrame) -> DataFrame:
    """(alert_id, trace_id) rows."""
    return alerts.select("alert_id", F.explode(evidence_ids(alerts)).alias("trace_id"))


def drop_auth_only_alerts(alerts: DataFrame, auth_events: DataFrame) -> DataFrame:
    """Drops security-failure and high-severity alerts whose every evidence event is known and is
    a failed login (jn_alert_auth_anti). ``auth_events`` has trace_id, is_auth_failure."""
    watched = alerts.filter(F.col("rule").isin(DENIED, SEVERE))
    judged = (alert_members(watched).join(auth_events, "trace_id", "left").groupBy("alert_id")
              .agg(F.bool_and(F.coalesce("is_auth_failure", F.lit(False))).alias("_all")))
    return alerts.join(judged.filter("_all"), "alert_id", "left_anti")


def group_members(alerts: DataFrame) -> DataFrame:
    """Membership of the (rule, source) groups: rule, source_ip, alert_id, trace_id. The lists of
    a group are rows, so a group may be as large as it likes."""
    return alerts.select("rule", F.coalesce("source_ip", F.lit("unknown")).alias("source_ip"), "alert_id",
                         F.explode_outer(evidence_ids(alerts)).alias("trace_id"))


def group_alerts(alerts: DataFrame) -> DataFrame:
    """Visible alerts per (rule, source) (agg_alert_groups).

    Title and reason are rewritten for groups of several alerts; members are in
    ``group_members``.
    """
    a = visible_alerts(alerts).withColumn("source_ip", F.coalesce("source_ip", F.lit("unknown")))
    when = F.struct("created_at", "alert_id")
    heads = a.groupBy("rule", "source_ip").agg(
        F.count(F.lit(1)).alias("n_alerts"), F.max_by("alert_id", when).alias("_last_id"),
        F.max("created_at").alias("created_at"), F.max_by("reason", when).alias("_reason"),
        F.min_by("title", when).alias("_title"), F.min_by("severity", when).alias("severity"),
        F.bool_and("acknowledged").alias("acknowledged"))
    # Two aggregates instead of count(distinct) so that a busy group is reduced before it meets.
    ids = (group_members(a).filter("trace_id IS NOT NULL").select("rule", "source_ip", "trace_id").distinct()
           .groupBy("rule", "source_ip").agg(F.count(F.lit(1)).alias("event_count")))
    g = heads.join(ids, ["rule", "source_ip"], "left").withColumn(
        "event_count", F.coalesce("event_count", F.lit(0)))
    many = F.col("n_alerts") > 1
    n = F.col("event_count").cast("string")
    return g.select(
        F.when(many, F.concat(F.lit("GROUP-"), "rule", F.lit("-"), "source_ip")).otherwise(
            F.col("_last_id")).alias("alert_id"),
        "rule", "source_ip", "n_alerts", "event_count", "severity", "acknowledged", "created_at",
        F.when(many, F.concat("_title", F.lit(" ("), n, F.lit(" events)"))).otherwise(
            F.col("_title")).alias("title"),
        F.when(many, F.concat(n, F.lit(" related events grouped by "), "rule", F.lit(" for source "),
                              "source_ip", F.lit("."))).otherwise(F.col("_reason")).alias("reason"))


def session_fingerprint(alerts: DataFrame) -> Column:
    """rule|source and, when the reason names one, |action."""
    act = F.regexp_extract("reason", r"(?:^|[ ,])action=([^ ,]*)", 1)
    base = F.concat_ws("|", "rule", F.coalesce("source_ip", F.lit("unknown")))
    return F.when(act != "", F.concat(base, F.lit("|"), act)).otherwise(base)


_RANK = ["low", "medium", "high", "critical"]


def sessionize(alerts: DataFrame, gap_seconds: int = 300) -> DataFrame:
    """Alerts of a fingerprint split where the gap exceeds ``gap_seconds``
    (win_sessionize_alerts). Correlation alerts stay out, as single entries they need no session."""
    plain = alerts.filter(F.col("rule").isin(VISIBLE_RULES))
    a = plain.withColumn("fingerprint", session_fingerprint(plain))
    s = session_ids(a, "fingerprint", "created_at", "alert_id", gap_seconds)
    rank = F.array_position(F.array(*[F.lit(x) for x in _RANK]), F.lower("severity"))
    first = F.struct("created_at", "alert_id")
    g = s.groupBy("fingerprint", "session_start").agg(
        F.first("rule").alias("rule"), F.first(F.coalesce("source_ip", F.lit("unknown"))).alias("source_ip"),
        F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"),
        F.count(F.lit(1)).alias("group_size"), F.max(rank).alias("_rank"),
        F.min_by("alert_id", first).alias("_first_id"), F.min_by("title", first).alias("_title"),
        F.min_by("reason", first).alias("_reason"), F.max_by("trace_id", first).alias("trace_id"),
        F.array_sort(F.collect_set("parser")).alias("parsers"), F.bool_and("acknowledged").alias("acknowledged"))
    many = F.col("group_size") > 1
    n = F.col("group_size").cast("string")
    seconds = F.floor((epoch_ms("last_seen") - epoch_ms("first_seen")) / 1000)
    act = F.get(F.split("fingerprint", r"\|"), 2)
    g = g.withColumn("duration_seconds", seconds)
    return g.select(
        F.concat(F.lit("GROUP-"), "rule", F.lit("-"), "source_ip", F.lit("-"), "_first_id").alias("alert_id"),
        "fingerprint", "rule", "source_ip", many.alias("group"), "group_size", "first_seen", "last_seen",
        "duration_seconds",
        F.get(F.array(*[F.lit(x) for x in _RANK]), F.greatest(F.col("_rank"), F.lit(1)).cast("int") - 1
              ).alias("severity"),
        F.when(many, F.concat("_title", F.lit(" ("), n, F.lit(" events)"))).otherwise(F.col("_title")).alias("title"),
        F.when(many, F.concat(
            n, F.lit(" related "), "rule", F.lit(" events from "), "source_ip",
            F.coalesce(F.concat(F.lit(" (action: "), act, F.lit(")")), F.lit("")), F.lit(". Duration: "),
            F.col("duration_seconds").cast("string"), F.lit("s."))).otherwise(F.col("_reason")).alias("reason"),
        "trace_id", "parsers", "acknowledged")
