"""Multi-event patterns per source.

All patterns read one role-flagged table, cut into (source, time slice) partitions, where running
counts answer "how many failures in the last N seconds". Candidates go through one cooldown, and
only what fires fetches its evidence, by running number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import predicates as P
from ..functions.severity import severity_risk
from ..functions.timestamps import time_display
from ..session import materialize
from .windows import HOT_ROWS, cooldown, sliced, with_running


@dataclass(frozen=True)
class Params:
    window: int = 900
    brute_window: int = 300
    group_window: int = 300
    group_threshold: int = 3
    brute_threshold: int = 5
    cooldown: int = 600
    history: int | None = None  # events of a source looked back over; none: all of the window
    hot_rows: int = HOT_ROWS  # events of a source and time slice from which on several tasks count them


FAILURES, REPEATED, SSH = "brute-force-failures", "repeated-failures", "ssh-brute-force"
SUCCESS, PRIVILEGE, CHAIN = "brute-force-success", "auth-privilege", "intrusion-chain"
PATTERNS = (FAILURES, REPEATED, SSH, SUCCESS, PRIVILEGE, CHAIN)
ALERTING = (SSH, SUCCESS, PRIVILEGE, CHAIN)

_FIRE = ("struct<case_type:string,fingerprint:string,n:bigint,role:string,ev_from:bigint,"
         "ev_to:bigint,self:boolean>")


def risk(case_type: Column, n: Column) -> Column:
    """Risk score by pattern and count (cor_risk)."""
    return (
        F.when(case_type.isin(FAILURES, SUCCESS), F.least(F.lit(96), F.lit(82) + F.greatest(F.lit(0), n - 5) * 2))
        .when(case_type == PRIVILEGE, 92).when(case_type == CHAIN, 98)
        .when(case_type == REPEATED, F.least(F.lit(85), F.lit(60) + F.greatest(F.lit(0), n - 3) * 4))
        .when(case_type == "distributed-auth-failures", 88)
        .when(case_type == SSH, F.least(F.lit(95), F.lit(78) + F.greatest(F.lit(0), n - 3) * 4))
        .otherwise(75).cast("int"))


def flagged(events: DataFrame) -> DataFrame:
    """Events with keys and role flags; the event text is built once per row."""
    e = events.withColumn("_text", P.event_text())
    k = P.keys()
    e = e.select("ues", "meta", "trace", "_text", *[v.alias(f"k_{n}") for n, v in k.items()])
    keyed = {n: F.col(f"k_{n}") for n in k}
    text = F.col("_text")
    e = e.withColumns({
        "fail": P.auth_failure(text, keyed), "succ": P.auth_success(text, keyed),
        "priv": P.priv_escalation(text, keyed), "scan": P.scan(text, keyed),
        "sec": P.security_failure(keyed)})
    return e.select(
        F.col("trace.trace_id").alias("trace_id"), F.col("ues.event_time").alias("ts"),
        F.col("k_source_ip").alias("source"), F.col("k_user_name").alias("user"),
        F.col("k_action").alias("action"), F.col("k_outcome").alias("outcome"),
        F.col("k_category").alias("category"), F.col("k_destination_port").alias("dport"),
        F.col("meta.parser").alias("parser"), F.col("meta.source_type").alias("source_type"),
        F.col("ues.severity").alias("severity"), F.col("trace.raw_hash").alias("raw_hash"),
        "fail", "succ", "priv", "scan", "sec",
        (F.col("sec") & F.coalesce(F.col("k_destination_port").isin(22, 2222), F.lit(False))).alias("ssh"),
    ).filter("source <> ''")


def _fire(case_type: str, when: Column, fp: Column, n: Column, role: Column | str, ev_from: Column,
          ev_to: Column, own: bool = False) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.when(when, F.struct(
        F.lit(case_type).alias("case_type"), F.concat(F.lit(f"{case_type}:"), fp).alias("fingerprint"),
        n.alias("n"), role.alias("role"), ev_from.alias("ev_from"), ev_to.alias("ev_to"),
        F.lit(own).alias("self")).cast(_FIRE))


def _source_patterns(base: DataFrame, p: Params, wanted: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(candidates, numbered role rows) of the patterns over one source."""
    keys = ["source"]
    s = sliced(base, "ts", max(p.window, p.brute_window, p.group_window))
    roles = {"fail": F.col("fail"), "succ": F.col("succ"), "scan": F.col("scan"), "ssh": F.col("ssh"),
             "any": F.col("fail") | F.col("succ") | F.col("scan") | F.col("priv")}
    windows = {"fail": p.brute_window, "ssh": p.group_window, "succ": p.window, "scan": p.window, "any": p.window}
    edges = {**{f"w_{n}": (n, sec) for n, sec in windows.items()}, "w_failw": ("fail", p.window)}
    s = with_running(s, roles, keys, "trace_id", edges, p.history, p.hot_rows)

    def r(n: str) -> Column:
        return F.col(f"r_{n}")

    def prefix(n: str, window: str | None = None) -> Column:
        """Running number of the last role row that lies outside window or history."""
        return F.greatest(F.col(f"w_{window or n}"), F.col(f"h_{n}"))

    def earlier(n: str, window: str | None = None) -> Column:
        """Role rows in reach before this one."""
        return r(n) - F.col(n).cast("bigint") - prefix(n, window)

    n_fail, n_ssh = r("fail") - prefix("fail"), r("ssh") - prefix("ssh")
    fails_before, succ_before = earlier("fail"), earlier("succ")
    who = F.concat(F.col("source"), F.lit(":"), F.when(F.col("user") == "", "unknown").otherwise(F.col("user")))
    src, user_last = F.col("source"), r("succ") - F.col("succ").cast("bigint")
    last_fail = r("fail") - F.col("fail").cast("bigint")
    tests = {
        FAILURES: _fire(FAILURES, F.col("fail") & (n_fail >= p.brute_threshold), src, n_fail, "fail",
                        r("fail") - 4, r("fail")),
        SSH: _fire(SSH, F.col("ssh") & (n_ssh >= p.group_threshold),
                   F.concat(src, F.lit(":"), F.col("dport").cast("string")), n_ssh, "ssh",
                   F.greatest(r("ssh") - 19, prefix("ssh") + 1), r("ssh")),
        SUCCESS: _fire(SUCCESS, F.col("succ") & (fails_before >= p.brute_threshold), src, fails_before, "fail",
                       last_fail - 4, last_fail, own=True),
        PRIVILEGE: _fire(PRIVILEGE, F.col("priv") & (succ_before > 0), who, succ_before, "succ",
                         user_last, user_last, own=True),
        CHAIN: _fire(CHAIN, F.col("priv") & (succ_before > 0) & (earlier("scan") > 0)
                     & (earlier("fail", "failw") > 0), who, r("any") - prefix("any"), "any",
                     F.greatest(r("any") - 9, prefix("any") + 1), r("any")),
    }
    fires = F.array_compact(F.array(*[tests[x] for x in wanted]))
    cand = s.filter("_own").select(*base.columns, "_slice", F.explode(fires).alias("f"))
    cand = cand.select(*base.columns, "_slice", "f.*")
    used = [n for n in roles if any(
        {FAILURES: "fail", SSH: "ssh", SUCCESS: "fail", PRIVILEGE: "succ", CHAIN: "any"}[x] == n for x in wanted)]
    numbered = F.array_compact(F.array(*[F.when(roles[n], F.struct(
        F.lit(n).alias("role"), r(n).alias("no"))) for n in used]))
    rows = s.select(*base.columns, "_slice", F.explode(numbered).alias("x")).select(
        *base.columns, "_slice", "x.role", "x.no")
    return cand, rows


def _repeated(base: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """Denied events of one (source, action). The counted history holds failed logins too, the
    triggering event must not be one. The history cap is per (source, action)."""
    keyed = base.filter("sec").withColumn("_fa", F.when(F.col("action") == "", "failure").otherwise(F.col("action")))
    s = sliced(keyed, "ts", p.group_window)
    keys = ["source", "_fa"]
    s = with_running(s, {"sec": F.lit(True)}, keys, "trace_id", {"w": ("sec", p.group_window)}, None, p.hot_rows).withColumnRenamed("r_sec", "r")
    n = F.col("r") - F.col("w")
    n = n if p.history is None else F.least(n, F.lit(p.history))
    role = F.concat(F.lit("sec:"), F.col("_fa"))
    fire = _fire(REPEATED, ~F.col("fail") & (n >= p.group_threshold),
                 F.concat(F.col("source"), F.lit(":"), F.col("_fa")), n, role,
                 F.col("r") - F.least(n, F.lit(20)) + 1, F.col("r"))
    cand = (s.filter("_own").select(*base.columns, "_slice", F.explode(F.array_compact(F.array(fire))).alias("f"))
            .select(*base.columns, "_slice", "f.*"))
    rows = s.select(*base.columns, "_slice", role.alias("role"), F.col("r").alias("no"))
    return cand, rows


def _evidence_item() -> Column:
    return F.struct(
        F.col("ts").alias("ts"), F.col("trace_id").alias("trace_id"),
        time_display("ts").alias("event_time_display"), "parser", "source_type", "action", "outcome",
        "category", "severity", "raw_hash")


def firings(events: DataFrame, params: Params = Params(),
            patterns: tuple[str, ...] = PATTERNS) -> tuple[DataFrame, DataFrame]:
    """(what fires after the cooldown, its evidence rows)."""
    # Read several times below; the flags come from the whole event text, this table does not carry it.
    base = materialize(flagged(events), "flagged")
    over_source = tuple(x for x in patterns if x != REPEATED)
    branches = []
    if over_source:
        branches.append(_source_patterns(base, params, over_source))
    if REPEATED in patterns:
        branches.append(_repeated(base, params))
    cand, rows = branches[0]
    for c2, r2 in branches[1:]:
        cand, rows = cand.unionByName(c2), rows.unionByName(r2)
    # Slices of the two branches have different widths; the role keeps their numbers apart.
    fired = materialize(cooldown(cand, "fingerprint", "ts", "trace_id", params.cooldown), "firings")
    head = fired.select("fingerprint", F.col("trace_id").alias("fired_by"), "source", "_slice", "role",
                        F.explode(F.sequence("ev_from", "ev_to")).alias("no"))
    found = rows.withColumn("ev", _evidence_item()).select("source", "_slice", "role", "no", "ev")
    evidence = head.join(found, ["source", "_slice", "role", "no"]).select("fingerprint", "fired_by", "ev")
    own = fired.filter("self").select("fingerprint", F.col("trace_id").alias("fired_by"), _evidence_item().alias("ev"))
    return fired, evidence.unionByName(own)


def make_cases(fired: DataFrame, evidence: DataFrame, params: Params = Params()) -> DataFrame:
    """Case rows (cor_case). A case has at most 20 evidence events, so its list is bounded."""
    lists = (evidence.groupBy("fingerprint", "fired_by")
             .agg(F.array_sort(F.collect_list("ev")).alias("evidence"))
             .withColumn("trace_ids", F.transform("evidence", lambda e: e["trace_id"])))
    c = fired.join(lists, [fired["fingerprint"] == lists["fingerprint"], fired["trace_id"] == lists["fired_by"]]
                   ).drop(lists["fingerprint"]).drop("fired_by")
    n = F.col("n").cast("string")
    minutes = str(params.group_window // 60)
    act = F.when(F.col("action") == "", "failure").otherwise(F.col("action"))
    port = F.col("dport").cast("string")
    kind = F.col("case_type")

    def say(*parts) -> Column:
        return F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])

    src = F.col("source")
    title = (
        F.when(kind == FAILURES, "Repeated failed logins detected")
        .when(kind == REPEATED, say("Repeated ", act, " events from ", src))
        .when(kind == SSH, "Repeated denied SSH activity detected")
        .when(kind == SUCCESS, "Brute-force attack followed by successful login")
        .when(kind == PRIVILEGE, "Authentication followed by privilege escalation")
        .when(kind == CHAIN, "Multi-stage intrusion chain detected"))
    text = (
        F.when(kind == FAILURES, say(n, " failed authentication attempts from ", src,
                                     " were observed within 5 minutes."))
        .when(kind == REPEATED, say(n, " ", act, " events observed from ", src, f" in the last {minutes} minutes."))
        .when(kind == SSH, say(n, " denied SSH connection attempts from ", src, " to port ", port,
                               f" were observed within {minutes} minutes."))
        .when(kind == SUCCESS, say(n, " authentication failures from ", src,
                                   " were followed by a successful authentication within 5 minutes."))
        .when(kind == PRIVILEGE, say("A successful authentication from ", src,
                                     " was followed by a privilege-sensitive action."))
        .when(kind == CHAIN, say("Observed discovery/scan activity, authentication failures, successful login "
                                 "and privilege-sensitive action associated with ", src, ".")))
    score = risk(kind, F.col("n"))
    first, last = F.array_min(F.transform("evidence", lambda e: e["ts"])), F.array_max(
        F.transform("evidence", lambda e: e["ts"]))
    grouped = kind.isin(REPEATED, SSH)
    return c.select(
        F.concat(F.lit("COR-"), F.substring(F.sha2(F.concat(
            kind, F.lit("|"), src, F.lit("|"), F.col("user"), F.lit("|"), F.array_join("trace_ids", "|")), 256),
            1, 16)).alias("correlation_id"),
        F.col("ts").alias("created_at"), first.alias("first_seen"), last.alias("last_seen"),
        time_display(first, True).alias("first_seen_display"), time_display(last, True).alias("last_seen_display"),
        F.floor((F.unix_millis(last) - F.unix_millis(first)) / 1000).alias("duration_seconds"),
        F.concat(F.lit("correlation-"), kind).alias("rule_id"), kind.alias("type"), title.alias("title"),
        text.alias("description"), score.alias("risk_score"), severity_risk(score).alias("severity"),
        src.alias("source_ip"), F.when(F.col("user") != "", F.col("user")).alias("user"),
        F.size("evidence").alias("event_count"), "trace_ids", "evidence",
        F.struct(F.lit("stateful correlation").alias("engine"), F.lit(params.window).alias("window_seconds"),
                 text.alias("why"), kind.alias("rule")).alias("explanation"),
        F.when(grouped, F.when(kind == SSH, "ssh-deny").otherwise(act)).alias("group_action"),
        F.when(grouped, F.col("n")).alias("group_count"),
        F.when(kind == SSH, F.col("dport")).alias("destination_port"),
        F.col("trace_id").alias("trigger_trace_id"))


def cases_to_alerts(cases: DataFrame) -> DataFrame:
    """Alert rows of the cases that alert (cor_case_alert)."""
    hashes = F.filter(F.transform("evidence", lambda e: e["raw_hash"]), lambda h: h.isNotNull())
    return cases.filter(F.col("type").isin(*ALERTING)).select(
        F.col("correlation_id").alias("alert_id"), "created_at", F.col("rule_id").alias("rule"), "rule_id",
        "title", "description", "severity", F.col("description").alias("reason"),
        F.element_at("trace_ids", -1).alias("trace_id"), "source_ip", "user",
        F.try_element_at(hashes, F.lit(-1)).alias("raw_hash"), hashes.alias("raw_hashes"),
        F.lit(False).alias("acknowledged"), "correlation_id", "risk_score",
        F.col("type").alias("correlation_type"), F.col("trace_ids").alias("evidence_trace_ids"),
        "event_count", "first_seen", "last_seen", "duration_seconds", "explanation")


def cases_of(events: DataFrame, params: Params = Params(), patterns: tuple[str, ...] = PATTERNS) -> DataFrame:
    return make_cases(*firings(events, params, patterns), params)


def correlate(events: DataFrame, params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(cases, alerts) of all patterns (cor_all)."""
    cases = cases_of(events, params)
    return cases, cases_to_alerts(cases)


def _single(pattern: str):
    def job(events: DataFrame, params: Params = Params()) -> DataFrame:
        return cases_of(events, params, (pattern,))

    job.__doc__ = f"Cases of the pattern {pattern}."
    return job


cor_bruteforce_failures = _single(FAILURES)
cor_repeated_failures = _single(REPEATED)
cor_ssh_bruteforce = _single(SSH)
cor_bruteforce_success = _single(SUCCESS)
cor_auth_privilege = _single(PRIVILEGE)
cor_intrusion_chain = _single(CHAIN)


def merge_cases(known: DataFrame, new: DataFrame) -> DataFrame:
    """Known cases and those new ones whose id is not known (set_merge_cases)."""
    return known.unionByName(new.join(known.select("correlation_id"), "correlation_id", "left_anti")
                             .select(*new.columns), allowMissingColumns=True)


def rehydrate(alerts: DataFrame, events: DataFrame, params: Params = Params()) -> DataFrame:
    """Cases rebuilt from stored alert rows, plus those that a replay of the events adds
    (cor_rehydrate)."""
    stored = alerts.filter(F.col("rule").startswith("correlation-")).select(
        F.col("alert_id").alias("correlation_id"), "created_at", F.col("rule").alias("rule_id"),
        F.regexp_replace("rule", "^correlation-", "").alias("type"), "title", "severity", "source_ip",
        F.col("evidence_trace_ids").alias("trace_ids"), F.lit("stored").alias("origin"))
    replayed = cases_of(events, params).select(
        *[x for x in stored.columns if x != "origin"], F.lit("replayed").alias("origin"))
    return merge_cases(stored.dropDuplicates(["correlation_id"]), replayed)
