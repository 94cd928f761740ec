"""Role predicates over normalized events.

The event is serialised once per row into ``event_text``; all word tests run on that text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .base import any_of, contains_any, first_present
from .tables import (
    AUTH_FAILURE_TEXT, AUTH_SUCCESS_TEXT, DENY_ACTIONS, FAILED_RESULTS, LOGIN_ACTIONS,
    PRIVILEGE_ACTIONS, PRIVILEGE_CATEGORIES, PRIVILEGE_TEXT, SCAN_ACTIONS, SCAN_CATEGORIES,
    SCAN_TEXT, SUCCESS_RESULTS, SUSPICIOUS_WORDS,
)


def event_text(*cols: str) -> Column:
    """Lower-case JSON text of an event (scl_event_text)."""
    return F.lower(F.to_json(F.struct(*[F.col(x) for x in (cols or ("ues", "raw"))])))


def _low(col: str) -> Column:
    return F.coalesce(F.lower(F.trim(F.col(col))), F.lit(""))


def keys() -> dict[str, Column]:
    """Entity keys of an event (prj_entity_keys); missing values are empty text."""
    return {
        "source_ip": F.coalesce(first_present("ues.source.ip", "meta.source_address"), F.lit("")),
        "user_name": F.coalesce(first_present("ues.user.name"), F.lit("")),
        "action": _low("ues.action"),
        "outcome": _low("ues.outcome"),
        "category": F.coalesce(F.lower(F.trim(first_present("ues.category"))), F.lit("")),
        "destination_port": F.col("ues.destination.port"),
    }


def entity_keys(events: DataFrame) -> DataFrame:
    return events.select(F.col("trace.trace_id").alias("trace_id"),
                         *[v.alias(k) for k, v in keys().items()])


def _k(keyed: dict[str, Column] | None) -> dict[str, Column]:
    return keyed or keys()


def auth_failure(text: Column | None = None, keyed: dict | None = None) -> Column:
    """flt_auth_failure"""
    text = event_text() if text is None else text
    k = _k(keyed)
    said = contains_any(text, AUTH_FAILURE_TEXT)
    subject = k["category"].contains("auth") | text.contains("authentication") | said
    return subject & (k["outcome"].isin(FAILED_RESULTS) | said)


def auth_success(text: Column | None = None, keyed: dict | None = None) -> Column:
    """flt_auth_success"""
    text = event_text() if text is None else text
    k = _k(keyed)
    subject = (k["category"].contains("auth") | contains_any(text, ["authentication", "login"])
               | k["action"].isin(LOGIN_ACTIONS))
    result = k["outcome"].isin(SUCCESS_RESULTS) | contains_any(text, AUTH_SUCCESS_TEXT)
    return subject & result & ~auth_failure(text, k)


def priv_escalation(text: Column | None = None, keyed: dict | None = None) -> Column:
    """flt_priv_escalation"""
    text = event_text() if text is None else text
    k = _k(keyed)
    return (contains_any(text, PRIVILEGE_TEXT) | k["action"].isin(PRIVILEGE_ACTIONS)
            | k["category"].isin(PRIVILEGE_CATEGORIES))


def scan(text: Column | None = None, keyed: dict | None = None) -> Column:
    """flt_scan"""
    text = event_text() if text is None else text
    k = _k(keyed)
    return (contains_any(text, SCAN_TEXT) | k["action"].isin(SCAN_ACTIONS)
            | k["category"].isin(SCAN_CATEGORIES))


def security_failure(keyed: dict | None = None) -> Column:
    """flt_security_failure: denied, dropped or failed, whatever the subject."""
    k = _k(keyed)
    return k["action"].isin([*DENY_ACTIONS, "failed"]) | k["outcome"].isin(FAILED_RESULTS)


def failed_auth_alert(text: Column | None = None) -> Column:
    """The looser failed-login test of the alert rules (flt_failed_auth_alert)."""
    text = event_text() if text is None else text
    category = F.coalesce(F.lower(F.col("ues.category")), F.lit(""))
    outcome = F.coalesce(F.lower(F.col("ues.outcome")), F.lit(""))
    action = F.coalesce(F.lower(F.col("ues.action")), F.lit(""))
    subject = category.contains("authentication") | contains_any(
        text, ["auth", "failed password", "failed login", "login failed"])
    return subject & (text.contains("failed") | (outcome == "failure") | (action == "deny"))


def suspicious(text: Column | None = None) -> Column:
    """Any of the indicator words anywhere in the event (flt_suspicious)."""
    return contains_any(event_text() if text is None else text, SUSPICIOUS_WORDS)


def search(events: DataFrame, q: str) -> DataFrame:
    """Case-insensitive substring over the whole event (flt_search)."""
    q = q.strip().lower()
    return events if not q else events.filter(
        event_text(*[x for x in ("ues", "meta", "trace", "raw") if x in events.columns]).contains(q))


def visible_rule(rule: Column, rules: list[str]) -> Column:
    return any_of([rule.isin(rules), rule.startswith("correlation-")])
