"""Streaming twins, run over what the tables hold now."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import logviews as V
from ..session import new_dir
from ..sources.lines import stream_lines
from ..streaming import jobs as J, late as L
from ..streaming.correlation import read_cases, stream_correlate
from .alerting import _SESSIONS
from .base import event_rows, line_view, ms, query
from .correlation import ALL_SQL, PARAMS, _case_cols, mixed


def _stream(spark, sf):
    return (spark.readStream.schema(event_rows(spark, sf).schema).option("pathGlobFilter", "events.parquet")
            .parquet(sf))


_CLOSED = "(SELECT max(ms) FROM ev) - 600000"


@query("str_activity", f"WITH {{EV}} SELECT ms // 3600000 * 3600000 AS bucket, count(*) AS n FROM ev GROUP BY 1 HAVING ms // 3600000 * 3600000 + 3600000 <= {_CLOSED}".replace(
    "HAVING ms // 3600000 * 3600000 + 3600000", "HAVING min(ms) // 3600000 * 3600000 + 3600000"))
def str_activity(spark, sf):
    e = V.events(_stream(spark, sf)).select(F.col("ues.event_time").alias("t"))
    return J.run_to_table(J.stream_activity(e, "t"), spark, "activity").select(ms("bucket").alias("bucket"), "n")


@query("str_sessions", _SESSIONS.replace("{GAP}", "7199999") + f""" SELECT fp AS fingerprint, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS group_size
  FROM s GROUP BY fp, sid HAVING max(ms) + 7200000 <= (SELECT max(ms) FROM s) - 600000""")
def str_sessions(spark, sf):
    f = V.fields(_stream(spark, sf)).filter(F.col("kind").isin("error", "purchase"))
    alerts = f.select(
        F.when(F.col("kind") == "error", "security-failure").otherwise("high-severity").alias("rule"),
        F.col("src").alias("source_ip"), F.col("t").alias("created_at"),
        F.concat(F.lit("Normalized action="), "act", F.lit(", outcome=n/a.")).alias("reason"))
    s = J.run_to_table(J.stream_sessions(alerts, "7200 seconds"), spark, "sessions")
    return s.select("fingerprint", ms("first_seen").alias("first_ms"), ms("last_seen").alias("last_ms"), "group_size")


@query("str_dedup", "SELECT count(DISTINCT user_id * 10 + length(event_type)) AS n FROM events")
def str_dedup(spark, sf):
    s = _stream(spark, sf).withColumn("t", F.col("ts").cast("timestamp")).withColumn(
        "k", F.col("user_id") * 10 + F.length("event_type")).select("t", "k")
    return J.run_to_table(J.stream_dedup(s, ["k"], "t", "60 days"), spark, "dedup").agg(F.count(F.lit(1)).alias("n"))


# Every seventh event comes five days late; four runs of the same query, each restarted from the checkpoint.
_ARRIVED = """a AS (SELECT *, ms + CASE WHEN event_id % 7 = 0 THEN 432000000 ELSE 0 END AS came FROM ev),
  r AS (SELECT *, (came - (SELECT min(came) FROM a)) * 4 // ((SELECT max(came) FROM a) - (SELECT min(came) FROM a) + 1) AS run FROM a),
  m AS (SELECT run, max(max(ms)) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3600000 AS mark FROM r GROUP BY run),
  w AS (SELECT r.*, coalesce(ms < mark, false) AS late FROM r JOIN m USING (run))"""


def _arriving(spark, sf, step: L.Step):
    """The tables that four restarted runs leave."""
    ev, path, out, checkpoint = event_rows(spark, sf), new_dir(spark, "arrived"), new_dir(spark, "late"), new_dir(spark, "late-checkpoint")
    came = ms(F.col("ts").cast("timestamp")) + F.when(F.col("event_id") % 7 == 0, 432000000).otherwise(0)
    least, most = ev.agg(F.min(came), F.max(came)).first()
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for run in range(4):
        part = ev.filter(F.floor((came - least) * 4 / (most - least + 1)) == run) if least is not None else ev
        part.repartition(files).write.mode("append").parquet(path)
        rows = V.fields(spark.readStream.schema(ev.schema).parquet(path))
        L.start(rows, out, checkpoint, "t", 3600, step, {"availableNow": True}).awaitTermination()
    return out


@query("str_activity_late", f"""WITH {{EV}}, {_ARRIVED} SELECT kind, ms // 3600000 * 3600000 AS bucket, count(*) AS n, count(*) FILTER (WHERE late) AS n_late
  FROM w GROUP BY 1, 2""")
def str_activity_late(spark, sf):
    """Hourly counts: closed, open and late ones together are all rows."""
    step = L.buckets(3600, ("kind",))
    out = _arriving(spark, sf, step)
    late = step.parts(L.late_rows(spark, out)).withColumnRenamed("n", "n_late")
    return L.corrected_windows(spark, out, step).join(late, ["kind", "bucket_ms"], "left").select(
        "kind", F.col("bucket_ms").alias("bucket"), "n", F.coalesce("n_late", F.lit(0)).alias("n_late"))


@query("str_sessions_late", f"""WITH {{EV}}, {_ARRIVED}, x AS (SELECT *, CASE WHEN ms - lag(ms) OVER k < 7200000 THEN 0 ELSE 1 END AS fresh FROM w WINDOW k AS (PARTITION BY src ORDER BY ms)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY src ORDER BY ms ROWS UNBOUNDED PRECEDING) AS sid FROM x),
  c AS (SELECT src, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS n FROM s GROUP BY src, sid)
  SELECT c.*, (SELECT count(*) FROM w WHERE late) AS all_late FROM c""")
def str_sessions_late(spark, sf):
    """Sessions of sources after late rows were merged into closed ones."""
    step = L.sessions(("src",), 7200)
    out = _arriving(spark, sf, step)
    n = L.late_rows(spark, out).count()
    return L.corrected_windows(spark, out, step).select("src", "first_ms", "last_ms", "n", F.lit(n).alias("all_late"))


@query("str_dedup_late", f"""WITH {{EV}}, {_ARRIVED}, d AS (SELECT usr, kind, ms, tid, late, lag(ms) OVER (PARTITION BY usr, kind ORDER BY ms, tid) AS before FROM w)
  SELECT usr, kind, tid, ms FROM d WHERE before IS NULL OR ms - before >= 86400000""")
def str_dedup_late(spark, sf):
    """First deliveries: a row is a repeat if one of its key came less than a day before it."""
    step = L.sessions(("usr", "kind"), 86400, ("tid",))
    out = _arriving(spark, sf, step)
    return L.corrected_windows(spark, out, step).select("usr", "kind", F.col("first.tid").alias("tid"), F.col("first_ms").alias("ms"))


#: Lines of a file, about.
FILE_LINES = 250_000


def _line_files(spark, sf, n: int = 4, copies: int = 1):
    """Files of lines and how many of them make one of n equal parts: a part has more files where it has more lines."""
    path = new_dir(spark, "lines")
    raw = line_view(spark, sf, "kv").select("raw")
    raw = raw if copies == 1 else raw.select(F.explode(F.array_repeat("raw", copies)).alias("raw"))
    each = event_rows(spark, sf).count() * copies // (n * FILE_LINES) + 1
    raw.repartition(n * each).write.text(path)
    return path, each


@query("str_backpressure", "WITH {EV} SELECT {KV} AS raw FROM ev")
def str_backpressure(spark, sf):
    """A fourth of the files per micro-batch; nothing is dropped."""
    path, each = _line_files(spark, sf)
    return J.run_to_table(stream_lines(spark, path, max_files=each).select("raw"), spark, "slow")


@query("str_pipeline", "WITH {EV} SELECT src, usr, act, ms, sha256({KV}) AS h FROM ev")
def str_pipeline(spark, sf):
    out = new_dir(spark, "pipeline")
    path, each = _line_files(spark, sf)
    q = J.start_pipeline(
        stream_lines(spark, path, max_files=2 * each), (),
        {"events": lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")},
        new_dir(spark, "pipeline-checkpoint"), {"availableNow": True}, 2024)
    q.awaitTermination()
    e = spark.read.parquet(out)
    return e.select(F.col("ues.source.ip").alias("src"), F.col("ues.user.name").alias("usr"), F.col("ues.action").alias("act"),
                    ms("ues.event_time").alias("ms"), F.col("trace.raw_hash").alias("h"))


@query("str_trace_ids", "SELECT 3 * count(*) AS n, 3 * count(*) AS ids FROM events")
def str_trace_ids(spark, sf):
    """Every line three times in a file: each is an event of its own."""
    out = new_dir(spark, "copies")
    path, each = _line_files(spark, sf, copies=3)
    q = J.start_pipeline(stream_lines(spark, path, max_files=2 * each), (), {
        "events": lambda df, i: df.select("trace").write.mode("overwrite").parquet(f"{out}/batch={i}")},
        new_dir(spark, "copies-checkpoint"), {"availableNow": True}, 2024)
    q.awaitTermination()
    return spark.read.parquet(out).agg(F.count("*").alias("n"), F.count_distinct("trace.trace_id").alias("ids"))


@query("str_sink_status", "SELECT 'events' AS sink, true AS ok, 4 AS batches, count(*) AS stored FROM events UNION ALL SELECT 'late', true, 4, count(*) FROM events")
def str_sink_status(spark, sf):
    """A sink that refuses every batch the first time; a retry fills it from what the other one stored."""
    out, status, refuse = new_dir(spark, "sinks"), new_dir(spark, "status"), [True]

    def to(name):
        def sink(df, i):
            if name == "late" and refuse[0]:
                raise OSError("not now")
            df.select("trace").write.mode("overwrite").parquet(f"{out}/{name}/batch={i}")
        return sink

    sinks = {n: to(n) for n in ("events", "late")}
    path, each = _line_files(spark, sf)
    q = J.start_pipeline(stream_lines(spark, path, max_files=each), (), sinks, new_dir(spark, "sinks-checkpoint"),
                         {"availableNow": True}, 2024, status)
    q.awaitTermination()
    assert J.sink_status(spark, status).filter("NOT ok").count() == 4
    refuse[0] = False
    J.retry_failed(spark, status, lambda i: spark.read.parquet(f"{out}/events/batch={i}"), sinks)
    n = [spark.read.parquet(f"{out}/{name}").select(F.lit(name).alias("sink"), "trace.trace_id") for name in sinks]
    stored = n[0].unionByName(n[1]).groupBy("sink").agg(F.count_distinct("trace_id").alias("stored"))
    return J.sink_status(spark, status).groupBy("sink", "ok").agg(F.count("*").alias("batches")).join(stored, "sink").select(
        "sink", "ok", F.col("batches").cast("int").alias("batches"), "stored")


@query("str_stats", "SELECT count(*) AS received, count(*) AS parsed, 0 AS with_warnings FROM events")
def str_stats(spark, sf):
    """The counters of every micro-batch, written to a table and summed."""
    total = [F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in ("received", "parsed", "with_warnings")]
    return J.run_stats(V.events(_stream(spark, sf)), spark).agg(*total)


def _correlated(spark, sf, batches: int = 3):
    """All events in time order, in as many micro-batches of about equal size; each is spread over many files."""
    ev, path = event_rows(spark, sf), new_dir(spark, "ordered")
    out, checkpoint = new_dir(spark, "live"), new_dir(spark, "live-checkpoint")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    least, cuts = ev.agg(F.min(at), F.percentile_approx(at, [i / batches for i in range(1, batches)], 1000)).first()
    cuts = [None, *sorted({c for c in cuts or [] if c > least}), None]
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for a, b in zip(cuts[:-1], cuts[1:]):
        # Rows without a time go first; nothing is left out at either end.
        part = ev.filter(F.lit(True) if a is None else at >= a).filter(F.lit(True) if b is None else F.coalesce(at < b, F.lit(a is None)))
        part.repartitionByRange(files, "ts").write.mode("append").parquet(path)
        # The files since the last run are one micro-batch, in whatever order they were written.
        s = spark.readStream.schema(ev.schema).parquet(path)
        stream_correlate(mixed(V.events(s)), out, checkpoint, PARAMS, trigger={"availableNow": True}).awaitTermination()
    return out


@query("str_state_expiry", f"WITH {{EV}} SELECT tid AS trace_id, src AS source FROM ev WHERE ms >= (SELECT max(ms) FROM ev) - {(PARAMS.window + 600) * 1000}")
def str_state_expiry(spark, sf):
    """What the last micro-batch carries over: the trailing window of every source, as far back as a late event may look, nothing older."""
    state = spark.read.parquet(f"{_correlated(spark, sf)}/state/tail")
    return state.filter(F.col("batch") == state.agg(F.max("batch")).first()[0]).select("trace_id", "source")


@query("str_live_correlate", ALL_SQL)
def str_live_correlate(spark, sf):
    return _case_cols(read_cases(spark, _correlated(spark, sf)))
