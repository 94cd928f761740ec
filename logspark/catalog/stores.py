"""Deduplication and queries over stored events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup as D
from ..plans import queries as Q, sketches as K
from ..session import materialize
from ..sinks.tables import flatten_events
from .base import event_fields, event_rows, event_view, ms, query, stored, table


def _tid():
    return F.col("trace.trace_id").alias("tid")


@query("set_dedup_trace", "SELECT DISTINCT user_id % 50 AS k FROM events WHERE user_id % 50 NOT IN (SELECT c_custkey % 7 FROM customer)")
def set_dedup_trace(spark, sf):
    rows = event_rows(spark, sf).select((F.col("user_id") % 50).alias("k"))
    return D.dedup(rows, "k", table(spark, sf, "customer").select((F.col("c_custkey") % 7).alias("k")))


@query("set_dedup_event", """SELECT min(event_id) AS event_id, 'k' || user_id AS k FROM events WHERE user_id % 5 <> 0 GROUP BY 2
  UNION ALL SELECT event_id, '' FROM events WHERE user_id % 5 = 0""")
def set_dedup_event(spark, sf):
    u = F.col("user_id")
    rows = event_rows(spark, sf).select("event_id", F.when(u % 5 == 0, F.lit("")).otherwise(
        F.concat(F.lit("k"), u.cast("string"))).alias("k"))
    return D.keep_first(rows, "k", "event_id")


@query("set_dedup_receipt", """SELECT 'new' AS part, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events WHERE user_id % 2 = 1)
  UNION ALL SELECT 'ledger', count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)""")
def set_dedup_receipt(spark, sf):
    items = event_rows(spark, sf).select(F.col("user_id").alias("agent_id"), F.col("event_type").alias("fingerprint"))
    new, ledger = D.claim_receipts(items, items.filter("agent_id % 2 = 0").distinct())

    def n(df, part):
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")

    return n(new, "new").unionByName(n(ledger, "ledger"))


# --- sorts and pages -------------------------------------------------------------------------
@query("srt_recent_page", "WITH {EV} SELECT tid, ms FROM ev ORDER BY ms DESC, tid LIMIT 5000 OFFSET 5000")
def srt_recent_page(spark, sf):
    e = event_view(spark, sf)
    return Q.page(e, [F.col("ues.event_time").desc(), F.col("trace.trace_id")], 5000, 2).select(_tid(), ms("ues.event_time").alias("ms"))


@query("srt_page_after", "WITH {EV} SELECT tid, ms FROM ev ORDER BY ms DESC, tid LIMIT 300 OFFSET 300")
def srt_page_after(spark, sf):
    """The second page by the last row of the first."""
    e = event_view(spark, sf)
    time, tie = F.col("ues.event_time"), F.col("trace.trace_id")
    last = Q.page_after(e, time, tie, 300).agg(F.min_by(F.struct(time.alias("t"), tie.alias("i")), F.struct(
        time, -F.substring(tie, 2, 12).cast("bigint"))).alias("x")).first().x
    return Q.page_after(e, time, tie, 300, (last.t, last.i)).select(_tid(), ms("ues.event_time").alias("ms"))


@query("srt_default_query", """WITH {EV} SELECT ms, cat AS category, act AS action, src AS source_ip, usr AS "user" FROM ev ORDER BY ms DESC, tid LIMIT 40""")
def srt_default_query(spark, sf):
    return Q.recent(flatten_events(event_view(spark, sf)), 40).select(
        ms("event_time").alias("ms"), "category", "action", "source_ip", "user")


@query("srt_keep_last_n", "WITH {EV} SELECT tid FROM ev ORDER BY ms DESC, tid LIMIT 1000")
def srt_keep_last_n(spark, sf):
    return Q.keep_last(event_view(spark, sf), [F.col("ues.event_time").desc(), F.col("trace.trace_id")], 1000).select(_tid())


@query("srt_top_fields", "SELECT 'user' || user_id AS key, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, key LIMIT 25")
def srt_top_fields(spark, sf):
    n = event_rows(spark, sf).groupBy(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("key")).agg(
        F.count(F.lit(1)).alias("n"))
    return Q.top_k(n, 25)


@query("qry_events", "WITH {EV} SELECT tid FROM ev ORDER BY ms DESC, tid LIMIT 100")
def qry_events(spark, sf):
    return Q.events(event_view(spark, sf)).select(_tid())


@query("qry_event_by_trace", "WITH {EV} SELECT tid, src, {RAW} AS raw FROM ev WHERE event_id = 17")
def qry_event_by_trace(spark, sf):
    return Q.event_by_trace(event_view(spark, sf), "T000000000017").select(_tid(), F.col("ues.source.ip").alias("src"), "raw")


@query("qry_lineage", """WITH {EV} SELECT {KV} AS raw, sha256({KV}) AS hash, unnest(['srcip','user']) AS original_field,
  unnest([src, usr]) AS normalized_value FROM ev""")
def qry_lineage(spark, sf):
    rows = Q.lineage_of(stored(spark, sf, "kv", ()))
    return rows.filter(F.col("original_field").isin("srcip", "user")).select("raw", "hash", "original_field", "normalized_value")


@query("jn_lineage", "WITH {EV} SELECT src, unnest(['srcip','user']) AS original_field FROM ev")
def jn_lineage(spark, sf):
    from ..operators.normalize import lineage

    n = stored(spark, sf, "kv", ())
    flat = n.select(F.col("trace.trace_id").alias("trace_id"), F.col("ues.source.ip").alias("src"))
    rows = lineage(n).filter(F.col("original_field").isin("srcip", "user"))
    return Q.events_with_lineage(flat, rows).select("src", "original_field")


@query("agg_lineage_confidence", "WITH {EV} SELECT event_id, CAST(7 + (outc IS NOT NULL)::INT AS INTEGER) AS mapped_fields, 0.78 AS confidence FROM ev")
def agg_lineage_confidence(spark, sf):
    n = stored(spark, sf, "kv", ())
    c = Q.lineage_confidence(n)
    ids = n.select("key_id", F.col("trace.trace_id").alias("trace_id"))
    return c.join(ids, "trace_id").select(F.col("key_id").alias("event_id"), "mapped_fields", "confidence")


@query("qry_verify", "WITH {EV} SELECT tid AS trace_id, event_id % 10 <> 0 AS verified FROM ev")
def qry_verify(spark, sf):
    e = event_view(spark, sf).withColumn("raw", F.when(F.col("trace.trace_id").endswith("0"), F.lit("x")).otherwise(F.col("raw")))
    return Q.verify(e).select("trace_id", "verified")


@query("qry_export_all", "WITH {EV} SELECT tid, ms FROM ev")
def qry_export_all(spark, sf):
    return Q.export(event_view(spark, sf)).select(_tid(), ms("ues.event_time").alias("ms"))


@query("qry_export", "WITH {EV} SELECT tid FROM ev ORDER BY ms DESC, tid LIMIT 3000")
def qry_export(spark, sf):
    return Q.export(event_view(spark, sf), 3000).select(_tid())


@query("qry_sql", "WITH {EV} SELECT action, count(*) AS n, max(source_port) AS p FROM (SELECT act AS action, sport AS source_port FROM ev WHERE cat = 'web' OR act = 'deny') GROUP BY 1")
def qry_sql(spark, sf):
    sql = "SELECT action, count(*) AS n, max(source_port) AS p FROM flat WHERE category = :cat OR action = 'deny' GROUP BY action"
    return Q.query(spark, flatten_events(event_view(spark, sf)), sql, {"cat": "web"}, view="flat")


@query("agg_counters", """WITH {EV} SELECT unnest(['received','parsed','failed','with_warnings','threat_hits']) AS counter,
  unnest([n, n, 0, 0, 0]) AS n FROM (SELECT count(*) AS n FROM ev) UNION ALL SELECT 'parser:' || fmt, count(*) FROM ev GROUP BY 1""")
def agg_counters(spark, sf):
    return Q.counters(event_view(spark, sf))


@query("agg_vendor", "SELECT CASE WHEN event_id % 7 < 5 THEN 'vendor' || (event_id % 7) ELSE 'Unknown' END AS vendor, count(*) AS n FROM events GROUP BY 1")
def agg_vendor(spark, sf):
    return Q.count_by_vendor(event_view(spark, sf))


@query("agg_format", "WITH {EV} SELECT fmt AS format, count(*) AS n FROM ev GROUP BY 1")
def agg_format(spark, sf):
    return Q.count_by_format(event_view(spark, sf))


@query("agg_suspicious", "SELECT count(*) FILTER (WHERE event_type = 'error') AS suspicious, count(*) AS total FROM events")
def agg_suspicious(spark, sf):
    return Q.count_suspicious(event_view(spark, sf))


@query("agg_shared_source", """WITH {EV} SELECT src AS source_ip, count(*) AS attempts, CAST(least(40 + count(*) * 6, 92) AS INTEGER) AS risk_score,
  CASE WHEN count(*) >= 6 THEN 'high' ELSE 'medium' END AS severity FROM ev GROUP BY src HAVING count(*) > 1 ORDER BY min(ms), src LIMIT 6""")
def agg_shared_source(spark, sf):
    return Q.shared_source(event_view(spark, sf), 6).select("source_ip", "attempts", "risk_score", "severity")


def _beats(spark, sf):
    f = event_fields(spark, sf)
    return f.select(F.col("usr").alias("agent_id"), F.col("t").alias("last_seen"), "tid")


_AGENTS = """WITH {EV}, a AS (SELECT usr AS agent_id, max(ms) AS ms FROM ev GROUP BY 1),
  s AS (SELECT *, CASE WHEN 1706572800000 - ms <= 30000 THEN 'online' WHEN 1706572800000 - ms <= 180000 THEN 'stale' ELSE 'offline' END AS status FROM a)"""
_AS_OF = "2024-01-30T00:00:00Z"


@query("agg_agent_status", _AGENTS + " SELECT status, count(*) AS n FROM s GROUP BY 1")
def agg_agent_status(spark, sf):
    return Q.agent_status(_beats(spark, sf), F.lit(_AS_OF).cast("timestamp")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("qry_agents", _AGENTS + " SELECT agent_id, ms, status FROM s")
def qry_agents(spark, sf):
    return Q.agents(_beats(spark, sf), F.lit(_AS_OF).cast("timestamp")).select("agent_id", ms("last_seen").alias("ms"), "status")


@query("qry_activity", "WITH {EV} SELECT ms // 3600000 * 3600000 AS bucket, count(*) AS n FROM ev GROUP BY 1")
def qry_activity(spark, sf):
    return Q.activity(event_view(spark, sf)).select(ms("bucket").alias("bucket"), "n")


@query("agg_sketch_ranges", """WITH {EV}, m AS (SELECT min(ms) AS lo, max(ms) AS hi FROM ev) SELECT kind, count(*) AS n, true AS sources_close, true AS users_close,
  true AS median_close, true AS returning_close FROM ev GROUP BY kind""")
def agg_sketch_ranges(spark, sf):
    """Hourly sketches merged range by range, and the ranges once more, against exact numbers: within five per cent (and one)."""
    e = event_view(spark, sf).withColumn("kind", F.coalesce("ues.category", F.lit("none")))
    flat = event_fields(spark, sf).select(F.col("kind"), F.col("tid"), F.col("t"))
    e = e.drop("kind").join(flat.select("tid", "kind"), F.col("trace.trace_id") == F.col("tid"))
    stored = materialize(K.hourly(e, F.col("kind"), "kind"), "hours")
    half = stored.agg(F.percentile_approx("hour", 0.5)).first()[0]
    first, second = (K.merged(stored.filter(side), ["kind"]) for side in (F.col("hour") <= F.lit(half), F.col("hour") > F.lit(half)))
    found = K.estimates(K.merged(first.unionByName(second), ["kind"]))
    back = K.returning(first, second, ["kind"])

    early = F.date_trunc("hour", "ues.event_time") <= F.lit(half)
    both = e.groupBy("kind", "ues.user.name").agg(F.bool_or(early).alias("a"), F.bool_or(~early).alias("b")).groupBy("kind").agg(
        F.count_if(F.col("a") & F.col("b")).alias("x_returning"), F.count_if(F.col("name").isNotNull()).alias("x_users"))
    size = F.col("ues.network.bytes_out").cast("bigint")
    exact = e.join(F.broadcast(found.select("kind", F.col("p50").alias("_p"))), "kind").groupBy("kind").agg(
        F.count_distinct("ues.source.ip").alias("x_sources"), F.count_if(size < F.col("_p")).alias("below"), F.count_if(size <= F.col("_p")).alias("upto"),
        F.count(size).alias("sized"))

    def close(a: str, b: str):
        return F.abs(F.col(a) - F.col(b)) <= F.col(b) * 0.05 + 1

    all_of = found.join(exact, "kind").join(both, "kind").join(back, "kind", "left")
    median = (F.col("below") <= 0.53 * F.col("sized") + 1) & (F.col("upto") >= 0.47 * F.col("sized") - 1)
    # An intersection's error goes with the larger sets.
    shared = F.abs(F.coalesce("returning", F.lit(0)) - F.col("x_returning")) <= F.col("x_users") * 0.05 + 1
    return all_of.select("kind", "n", close("sources", "x_sources").alias("sources_close"), close("users", "x_users").alias("users_close"),
                         median.alias("median_close"), shared.alias("returning_close"))
