"""Registry and shared views."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import logviews as V
from ..operators.normalize import normalize_logs
from ..operators.specs import as_specs
from ..session import materialize, utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The columns of logviews.fields, in SQL.
EV = """
ev AS (SELECT *, strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM (
  SELECT event_id, user_id, value, ts, epoch_us(ts) // 1000 AS ms,
    'T' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS tid,
    '10.0.0.' || CAST(user_id % 16 AS VARCHAR) AS src,
    '203.0.113.' || CAST(event_id % 256 AS VARCHAR) AS dst,
    CAST(1024 + event_id % 60000 AS INTEGER) AS sport,
    CAST(CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 22 ELSE 443 END AS INTEGER) AS dport,
    'u' || CAST(user_id AS VARCHAR) AS usr,
    CASE WHEN event_type = 'error' THEN 'deny' ELSE 'allow' END AS act,
    CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'success' END AS outc,
    CASE event_type WHEN 'error' THEN 'authentication' WHEN 'signup' THEN 'authentication'
      WHEN 'purchase' THEN 'privilege' WHEN 'click' THEN 'discovery' ELSE 'web' END AS cat,
    CAST(trunc(value * 100) AS BIGINT) AS nbytes, event_type AS kind,
    CAST(CASE event_type WHEN 'error' THEN 70 WHEN 'purchase' THEN 85 ELSE 10 END AS INTEGER) AS sev,
    ['kv','json','cef','leef','syslog','csv','xml'][CAST(event_id % 7 AS INTEGER) + 1] AS fmt
  FROM events))
"""
KV = ("'timestamp=' || iso || ' srcip=' || src || ' dstip=' || dst || ' srcport=' || sport || ' dstport=' || dport"
      " || ' action=' || act || ' user=\"' || usr || '\" sentbyte=' || nbytes || coalesce(' outcome=' || outc, '')")
RAW = "'line ' || event_id || ' by ' || usr"


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL; ``{EV}`` and ``{KV}`` stand for the shared view."""
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(utc(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = (sql.replace("{EV}", EV.strip()).replace("{KV}", KV).replace("{RAW}", RAW)).strip()
        return run
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return V.read(spark, sf_dir, name)


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def event_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.fields(event_rows(spark, sf_dir))


def event_view(spark: SparkSession, sf_dir: str, error_category: str | None = None) -> DataFrame:
    ev = V.events(event_rows(spark, sf_dir))
    if error_category:
        ev = ev.withColumn("ues", F.col("ues").withField("category", F.when(
            F.col("ues.action") == "deny", error_category).otherwise(F.col("ues.category"))))
    return ev


def spread_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_view`` for dear work on each row, dealt out while the rows are narrow."""
    return V.events(V.spread(event_rows(spark, sf_dir), "event_id"))


def line_view(spark: SparkSession, sf_dir: str, fmt: str | None = None) -> DataFrame:
    """Log lines; parsing is the work here, so a small table is spread over the cores first."""
    return V.lines(V.spread(event_rows(spark, sf_dir), "event_id"), fmt)


FLOW = as_specs([V.FLOW_SPEC])


def normalized(spark: SparkSession, sf_dir: str, fmt: str | None = None, specs=FLOW) -> DataFrame:
    return normalize_logs(line_view(spark, sf_dir, fmt), specs, year=2024)


def stored(spark: SparkSession, sf_dir: str, fmt: str | None = None, specs=FLOW) -> DataFrame:
    """Normalized events as a written table, the usual input of queries over events."""
    return materialize(normalized(spark, sf_dir, fmt, specs), "events")


def ms(col: Column | str) -> Column:
    return F.unix_millis(F.col(col) if isinstance(col, str) else col)
