"""Sources and sinks. Files are written to the shared folder first."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window, functions as F

from ..session import materialize, new_dir
from ..sinks import archive, files as S, tables as T
from ..sinks.buckets import BucketTable
from ..operators.normalize import with_integrity, with_source_columns
from ..sources import growing, history as H, lines as L
from ..streaming.jobs import run_to_table
from .base import event_fields, event_rows, event_view, line_view, ms, query, stored, table


def _kind_files(spark, sf):
    """One file of lines per event type, in event order, with a blank line now and then."""
    raw = line_view(spark, sf, "kv").join(event_rows(spark, sf).select(
        F.col("event_id").alias("key_id"), F.col("event_type").alias("kind")), "key_id")
    path = new_dir(spark, "lines")
    rows = raw.select("kind", "key_id", F.when(F.col("key_id") % 10 == 0, F.array("raw", F.lit(""))).otherwise(
        F.array("raw")).alias("l"))
    rows = rows.select("kind", "key_id", F.posexplode("l").alias("pos", "value"))
    (rows.repartition("kind").sortWithinPartitions("kind", "key_id", "pos").select("kind", "value")
     .write.partitionBy("kind").text(path))
    return path


def _kind():
    return F.regexp_extract("address", "kind=([a-z]+)", 1)


@query("src_lines", "WITH {EV} SELECT {KV} AS raw FROM ev")
def src_lines(spark, sf):
    return L.read_lines(spark, _kind_files(spark, sf), recursive=True).select("raw")


@query("src_line_ids", "SELECT 2 * count(*) AS n, 2 * count(*) AS ids, 2 * count(*) AS same FROM events")
def src_line_ids(spark, sf):
    """Files with every line twice: as many ids as lines, and the same ones after files were added, read in other splits."""
    path = new_dir(spark, "twice")
    lines = line_view(spark, sf, "kv").select(F.explode(F.array_repeat("raw", 2)).alias("value"))
    lines.write.text(path)

    def ids(read):
        return with_integrity(with_source_columns(L.read_lines(spark, path))).select("trace_id", F.lit(read).alias("read"))

    first = materialize(ids(1), "ids")
    lines.write.mode("append").text(path)
    splits = {"spark.sql.files.maxPartitionBytes": "50k", "spark.sql.files.openCostInBytes": "1k"}
    before = {name: spark.conf.get(name) for name in splits}
    try:
        for name, value in splits.items():
            spark.conf.set(name, value)
        second = materialize(ids(2), "ids")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    seen = first.unionByName(second).groupBy("trace_id").agg(F.count_if(F.col("read") == 1).alias("a"), F.count_if(F.col("read") == 2).alias("b"))
    return seen.filter("a > 0").agg(F.sum("a").alias("n"), F.count("*").alias("ids"), F.sum(F.when(F.col("a") == F.col("b"), F.col("b"))).alias("same"))


@query("src_dir_glob", "WITH {EV} SELECT {KV} AS raw, kind FROM ev")
def src_dir_glob(spark, sf):
    return L.read_lines(spark, _kind_files(spark, sf), pattern="*.txt", recursive=True).select("raw", _kind().alias("kind"))


def _grow(spark, rows, root):
    """Writes rows (kind, key_id, value, ended) to one file a kind below the folder, in place of the one that is there.

    A file is written aside and moved, so that a repeated task changes nothing.
    """
    def write(batches):
        store, folder = growing.open_store(root)
        name = out = None
        done = []

        def close():
            if out is not None:
                out.close()
                store.move(f"{folder}/.{name}", f"{folder}/{name}")

        for batch in batches:
            for kind, value, ended in zip(*(batch.column(c).to_pylist() for c in ("kind", "value", "ended"))):
                if f"{kind}.log" != name:
                    close()
                    name = f"{kind}.log"
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(f"{folder}/.{name}")
                    done.append(name)
                out.write(value.encode() + (b"\n" if ended else b""))
        close()
        yield pa.RecordBatch.from_pydict({"file": pa.array(done, pa.string())})

    rows.repartition("kind").sortWithinPartitions("kind", "key_id").select("kind", "value", "ended").mapInArrow(write, "file string").collect()


@query("src_tail", """WITH {EV}, l AS (SELECT kind, event_id, {KV} AS raw, row_number() OVER (PARTITION BY kind ORDER BY event_id) AS i, count(*) OVER (PARTITION BY kind) AS c FROM ev),
  p AS (SELECT *, kind = 'error' AND i * 10 > c * 7 AS anew FROM l WHERE NOT (kind = 'error' AND i = c * 7 // 10))
  SELECT kind, raw, coalesce(sum(strlen(raw) + 1) OVER (PARTITION BY kind, anew ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS raw_offset FROM p""")
def src_tail(spark, sf):
    """Files grow between three runs of a stream, which goes on from its checkpoint: first four tenths of the lines and half
    of the next one, then seven tenths with the last one's end missing, then all, where one file was cut off and starts
    anew, and a half line that never ends. The line whose end was missing when its file was cut off is never complete."""
    root, path, checkpoint = new_dir(spark, "growing"), new_dir(spark, "tail"), new_dir(spark, "tail-checkpoint")
    lines = line_view(spark, sf, "kv").join(event_rows(spark, sf).select(F.col("event_id").alias("key_id"), F.col("event_type").alias("kind")), "key_id")
    by_kind = Window.partitionBy("kind")
    lines = materialize(lines.select("kind", "key_id", F.col("raw").alias("value"), F.row_number().over(by_kind.orderBy("key_id")).alias("i"),
                                     F.count("*").over(by_kind).alias("c")), "lines")
    tenths, whole = F.col("i") * 10, F.col("c")
    half = F.substring("value", 1, 20).alias("value")
    ends = lines.groupBy("kind").agg(F.max("key_id").alias("key_id"), F.max_by("value", "key_id").alias("value"))
    states = [
        lines.filter(tenths <= whole * 4).withColumn("ended", F.lit(True)).select("kind", "key_id", "value", "ended").unionByName(
            lines.filter((tenths > whole * 4) & (tenths <= whole * 4 + 10)).select("kind", "key_id", half, F.lit(False).alias("ended"))),
        lines.filter(tenths <= whole * 7).select("kind", "key_id", "value", (tenths + 10 <= whole * 7).alias("ended")),
        lines.filter((F.col("kind") != "error") | (tenths > whole * 7)).select("kind", "key_id", "value", F.lit(True).alias("ended")).unionByName(
            ends.select("kind", (F.col("key_id") + 1).alias("key_id"), half, F.lit(False).alias("ended"))),
    ]
    for state in states:
        _grow(spark, state, root)
        stream = growing.tail(spark, root, "*.log", range_bytes=1 << 20)
        (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(path).select(F.regexp_extract("address", r"([a-z]+)\.log$", 1).alias("kind"), "raw", "raw_offset")


@query("src_tail_arrived", "WITH {EV} SELECT {KV} AS raw FROM ev")
def src_tail_arrived(spark, sf):
    stream = L.stream_lines(spark, f"{_kind_files(spark, sf)}/*", max_files=2)
    return run_to_table(stream.select("raw"), spark, "tail")


_OFFSETS = """o AS (SELECT kind, event_id, {KV} AS raw, coalesce(sum(strlen({KV}) + 1 + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END)
  OVER (PARTITION BY kind ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS raw_offset FROM ev)"""


@query("src_byte_offset", f"WITH {{EV}}, {_OFFSETS} SELECT kind, raw, raw_offset FROM o")
def src_byte_offset(spark, sf):
    return L.read_positions(spark, _kind_files(spark, sf), recursive=True).select(_kind().alias("kind"), "raw", "raw_offset")


@query("src_file_tail_n", "WITH {EV} SELECT kind, raw FROM (SELECT kind, {KV} AS raw, row_number() OVER (PARTITION BY kind ORDER BY event_id DESC) AS n FROM ev) WHERE n <= 7")
def src_file_tail_n(spark, sf):
    rows = L.read_positions(spark, _kind_files(spark, sf), recursive=True)
    return L.tail_lines(rows, 7).select(_kind().alias("kind"), "raw")


@query("src_file_tail_long", "WITH {EV} SELECT kind, raw FROM (SELECT kind, {KV} AS raw, row_number() OVER (PARTITION BY kind ORDER BY event_id DESC) AS n FROM ev) WHERE n <= 1500")
def src_file_tail_long(spark, sf):
    rows = L.read_positions(spark, _kind_files(spark, sf), recursive=True)
    return L.tail_lines(rows, 1500).select(_kind().alias("kind"), "raw")


@query("srt_fill_across_files", """WITH {EV}, t AS (SELECT kind, event_id, {KV} AS raw, row_number() OVER (PARTITION BY kind ORDER BY event_id DESC) AS n FROM ev)
  SELECT kind, raw FROM t WHERE n <= 30 ORDER BY kind, event_id LIMIT 30""")
def srt_fill_across_files(spark, sf):
    rows = L.read_positions(spark, _kind_files(spark, sf), recursive=True)
    return L.fill_limit(L.tail_lines(rows, 30), 30).select(_kind().alias("kind"), "raw")


@query("src_payload_lines", """SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, md5(l[i]) AS h FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
  FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS l FROM documents)) WHERE trim(l[i], E' \\t\\r\\n\\x0b\\x0c') <> ''""")
def src_payload_lines(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return L.explode_payload(d, "text").select("doc_id", "line_no", F.md5(F.col("raw").cast("binary")).alias("h"))


@query("src_jsonl", "WITH {EV} SELECT tid, ms, act, src FROM ev ORDER BY ms DESC, tid LIMIT 500")
def src_jsonl(spark, sf):
    path = new_dir(spark, "history")
    event_view(spark, sf).select(F.to_json(F.struct("ues", "meta", "trace", "raw")).alias("value")).unionByName(
        event_rows(spark, sf).filter("event_id % 50 = 0").select(F.lit('{"ues": broken').alias("value"))).write.text(path)
    e = H.read_events_jsonl(spark, path, 500)
    return e.select(F.col("trace.trace_id").alias("tid"), ms("ues.event_time").alias("ms"), F.col("ues.action").alias("act"),
                    F.col("ues.source.ip").alias("src"))


def _items(spark, sf):
    """Collector items: every tenth one twice, every 25th blank."""
    i = F.col("key_id")
    items = line_view(spark, sf, "kv").select(
        F.when(i % 25 == 0, F.lit("  ")).otherwise(F.col("raw")).alias("raw"), "source_type", "address",
        F.concat(F.lit("agent"), (i % 3).cast("string")).alias("agent_id"), i.alias("_spool_id"))
    return items.unionByName(items.filter("_spool_id % 10 = 0").withColumn("_spool_id", -F.col("_spool_id")))


@query("src_agent_batch", """WITH {EV} SELECT 'accepted' AS part, {KV} AS raw FROM ev WHERE event_id % 25 <> 0
  UNION ALL SELECT 'rejected', '  ' FROM (SELECT event_id FROM ev WHERE event_id % 25 = 0 UNION ALL SELECT event_id FROM ev WHERE event_id % 50 = 0)""")
def src_agent_batch(spark, sf):
    accepted, rejected = H.ingest_batch(_items(spark, sf))
    return accepted.select(F.lit("accepted").alias("part"), "raw").unionByName(
        rejected.select(F.lit("rejected").alias("part"), "raw"))


@query("src_spool_dedup", "SELECT min(event_id) AS event_id FROM events GROUP BY event_id // 3")
def src_spool_dedup(spark, sf):
    k = F.floor(F.col("event_id") / 3)
    items = event_rows(spark, sf).select(
        "event_id", F.lit("a").alias("agent_id"), F.lit("win").alias("address"), F.lit(None).cast("bigint").alias("offset"),
        F.to_json(F.struct(k.alias("RecordId"))).alias("raw"))
    return H.collector_dedup(items, "event_id").select("event_id")


@query("src_journal_json", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'event ' || event_type ELSE '{"OTHER":' || event_id || '}' END AS raw
  FROM events WHERE event_id % 3 <> 2""")
def src_journal_json(spark, sf):
    i = F.col("event_id")
    raw = F.when(i % 3 == 0, F.to_json(F.struct(F.concat(F.lit("event "), "event_type").alias("MESSAGE")))).when(
        i % 3 == 1, F.to_json(F.struct(i.alias("OTHER")))).otherwise(F.lit("{not json"))
    return L.from_journal(event_rows(spark, sf).select("event_id", raw.alias("raw")))


# --- sinks -----------------------------------------------------------------------------------
@query("snk_stdout", "WITH {EV} SELECT tid, src, {RAW} AS raw FROM ev")
def snk_stdout(spark, sf):
    j = S.to_json_lines(event_view(spark, sf))
    return j.select(F.get_json_object("value", "$.trace.trace_id").alias("tid"),
                    F.get_json_object("value", "$.ues.source.ip").alias("src"), F.get_json_object("value", "$.raw").alias("raw"))


@query("snk_jsonl", "WITH {EV} SELECT tid, '' AS raw, strftime(ts, '%Y-%m-%d') AS dt FROM ev")
def snk_jsonl(spark, sf):
    path = new_dir(spark, "jsonl")
    S.write_jsonl(event_view(spark, sf), path, include_raw=False, max_records_per_file=1000)
    d = spark.read.schema("trace struct<trace_id:string>, raw string, dt date").json(path)
    return d.select(F.col("trace.trace_id").alias("tid"), "raw", F.col("dt").cast("string").alias("dt"))


@query("snk_raw_archive", "WITH {EV} SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS n, count(DISTINCT sha256({RAW})) AS hashes FROM ev GROUP BY 1")
def snk_raw_archive(spark, sf):
    path = new_dir(spark, "archive")
    S.write_archive(event_view(spark, sf), path)
    rows = S.read_archive(spark, path).filter(F.sha2("raw", 256) == F.col("hash"))
    return rows.groupBy(F.col("dt").cast("string").alias("dt")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("hash").alias("hashes"))


@query("snk_raw_archive_manifest", """WITH {EV} SELECT strftime(ts, '%Y-%m-%d') AS block, count(*) AS n, true AS linked FROM ev GROUP BY 1""")
def snk_raw_archive_manifest(spark, sf):
    m = S.archive_manifest(S.archive_rows(event_view(spark, sf)), ["dt"])
    prev = m.select(F.col("chain").alias("p")).distinct()
    j = m.join(prev, m["prev"] == prev["p"], "left")
    return j.select("block", "n", (F.col("p").isNotNull() | (F.col("prev") == "")).alias("linked"))


def _sealed(spark, sf):
    """Events in three appends: rows, tree, manifest."""
    path = new_dir(spark, "sealed")
    e = event_view(spark, sf)
    for k in range(3):
        archive.append(e.filter(_event_id() % 3 == k), path)
    return archive.stored(spark, path)


def _event_id(col="trace.trace_id"):
    return F.regexp_extract(col, r"0*(\d+)$", 1).cast("bigint")


@query("snk_raw_archive_tree", """WITH {EV}, p AS (SELECT a.tid FROM ev a JOIN ev b ON b.event_id = a.event_id + CASE a.event_id % 100 WHEN 10 THEN 3 ELSE -3 END
    WHERE a.event_id % 100 IN (10, 13))
  SELECT tid, 'changed' AS problem FROM ev WHERE event_id % 100 = 7 UNION ALL SELECT tid, 'changed' FROM p
  UNION ALL SELECT NULL, 'removed' FROM ev WHERE event_id % 100 = 8""")
def snk_raw_archive_tree(spark, sf):
    """What an archive of three appends says when rows were changed, removed and swapped; untouched it has nothing to say."""
    rows, tree, sealed = _sealed(spark, sf)
    assert archive.verify(rows, tree, sealed).isEmpty()
    n = _event_id("trace_id")
    swap = rows.filter((n % 100).isin(10, 13)).select((n + F.when(n % 100 == 10, 3).otherwise(-3)).alias("_id"), F.col("no").alias("_no"))
    other = rows.withColumn("_id", n).join(swap, "_id", "left").withColumn("no", F.coalesce("_no", "no")).drop("_id", "_no")
    other = other.filter(n % 100 != 8).withColumn("raw", F.when(n % 100 == 7, F.concat("raw", F.lit("!"))).otherwise(F.col("raw")))
    return archive.verify(other, tree, sealed).select(F.col("trace_id").alias("tid"), "problem")


@query("snk_raw_archive_proofs", "WITH {EV} SELECT tid, true AS ok FROM ev WHERE event_id % 20 = 0")
def snk_raw_archive_proofs(spark, sf):
    """Proofs that rows belong to the archive."""
    rows, tree, sealed = _sealed(spark, sf)
    wanted = rows.select("trace_id").filter(_event_id("trace_id") % 20 == 0)
    return archive.proved(archive.proofs(rows, tree, wanted), sealed).select(F.col("trace_id").alias("tid"), "ok")


@query("snk_upsert_buckets", """WITH {EV} SELECT tid, CASE WHEN event_id % 1000 = 0 THEN 'reviewed' ELSE act END AS act, nbytes FROM ev
  UNION ALL SELECT 'new ' || tid, 'reviewed', 1 FROM ev WHERE event_id % 1000 = 0""")
def snk_upsert_buckets(spark, sf):
    """An update of a thousandth of the keys, sent twice, rewrites their buckets once."""
    f = event_fields(spark, sf).select("tid", "act", "nbytes", F.col("event_id").alias("version"))
    known = BucketTable(spark, new_dir(spark, "buckets"), ["tid"], ["version"], 256)
    known.write(f, "first")
    some = f.filter("version % 1000 = 0").withColumn("act", F.lit("reviewed"))
    added = some.withColumns({"tid": F.concat(F.lit("new "), "tid"), "nbytes": F.lit(1).cast("bigint")})
    batch = materialize(some.drop("nbytes").withColumn("nbytes", F.lit(None).cast("bigint")).unionByName(added), "batch")
    done = known.write(batch, "second", ["act"])
    touched = batch.select(known.bucket()).distinct().count()
    assert done["written"] == touched and done["read"] <= touched, done
    assert known.write(batch, "second", ["act"])["written"] == 0
    return known.read().select("tid", "act", "nbytes")


@query("snk_flat_events", """WITH {EV} SELECT tid AS trace_id, cat AS category, act AS action, outc AS outcome, sev AS severity, src AS source_ip,
  sport AS source_port, dst AS destination_ip, dport AS destination_port, usr AS "user", fmt AS parser FROM ev""")
def snk_flat_events(spark, sf):
    return T.flatten_events(event_view(spark, sf)).select(
        "trace_id", "category", "action", "outcome", "severity", "source_ip", "source_port", "destination_ip",
        "destination_port", "user", "parser")


@query("snk_raw_store", """WITH {EV} SELECT strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day, 'file' AS source,
  count(*) AS n, sum(strlen({RAW})) AS bytes FROM ev GROUP BY 1, 2, 3""")
def snk_raw_store(spark, sf):
    path = new_dir(spark, "raw")
    S.write_raw_store(event_view(spark, sf), path)
    d = spark.read.schema("value string, name string, raw_hash string, raw_size bigint, year string, month string, day string, source string").parquet(path)
    return d.filter(F.sha2("value", 256) == F.col("raw_hash")).groupBy("year", "month", "day", "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("raw_size").alias("bytes"))


@query("snk_relational", """WITH {EV} SELECT tid AS trace_id, 'E' || tid AS event_id, ms, src AS source_address, fmt AS format, sev AS severity,
  CASE sev WHEN 70 THEN 'high' WHEN 85 THEN 'critical' ELSE 'info' END AS severity_label, sha256({RAW}) AS raw_hash FROM ev""")
def snk_relational(spark, sf):
    main, _, _ = T.to_tables(event_view(spark, sf))
    return main.select("trace_id", "event_id", ms("event_time").alias("ms"), "source_address", "format", "severity",
                       "severity_label", "raw_hash")


@query("snk_relational_raw", "WITH {EV} SELECT tid AS trace_id, 'RAW-' || substr(sha256({RAW}), 1, 20) AS raw_event_id, CAST(strlen({RAW}) AS BIGINT) AS raw_size FROM ev")
def snk_relational_raw(spark, sf):
    return T.to_tables(event_view(spark, sf))[1].select("trace_id", "raw_event_id", "raw_size")


@query("snk_relational_lineage", """WITH {EV} SELECT unnest(['source.ip','source.port','user.name','network.bytes_out']) AS normalized_field,
  unnest([src, CAST(sport AS VARCHAR), usr, CAST(nbytes AS VARCHAR)]) AS normalized_value, sha256({KV}) AS raw_hash FROM ev""")
def snk_relational_lineage(spark, sf):
    rows = T.to_tables(stored(spark, sf, "kv", ()))[2]
    return rows.filter(F.col("normalized_field").isin("source.ip", "source.port", "user.name", "network.bytes_out")).select(
        "normalized_field", "normalized_value", "raw_hash")


@query("snk_upsert", """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice
  FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def snk_upsert(spark, sf):
    """Even orders are stored; updates for every third order change the status only."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    updates = o.filter("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X")).withColumn("seen", F.lit(2))
    older = updates.withColumn("o_orderstatus", F.lit("OLD")).withColumn("seen", F.lit(1))
    return T.upsert(o.filter("o_orderkey % 2 = 0"), updates.unionByName(older), ["o_orderkey"], ["seen"], ["o_orderstatus"])


@query("snk_bulk_ndjson", """WITH {EV} SELECT tid AS trace_id, 0 AS pos, 'logs' AS idx, '{"index":{"_index":"logs"}}' AS line, NULL AS src, NULL AS dst, NULL AS act, NULL AS usr, NULL AS nbytes FROM ev
  UNION ALL SELECT tid, 1, NULL, {RAW}, src, dst, act, usr, CAST(nbytes AS VARCHAR) FROM ev""")
def snk_bulk_ndjson(spark, sf):
    """Both lines of every event: the action as it is, the document read back."""
    at = lambda path: F.get_json_object("value", f"$.{path}")
    lines = S.bulk_lines(event_view(spark, sf), "logs")
    return lines.select(
        F.when(F.col("pos") == 0, F.col("trace_id")).otherwise(at("trace.trace_id")).alias("trace_id"), "pos", at("index._index").alias("idx"),
        F.when(F.col("pos") == 0, F.col("value")).otherwise(at("raw")).alias("line"), at("ues.source.ip").alias("src"),
        at("ues.destination.ip").alias("dst"), at("ues.action").alias("act"), at("ues.user.name").alias("usr"),
        at("ues.network.bytes_out").alias("nbytes"))


@query("snk_kafka", "WITH {EV} SELECT tid AS key, src FROM ev")
def snk_kafka(spark, sf):
    """The records a topic write sends; the connector itself is not part of Spark's core."""
    return S.topic_rows(event_view(spark, sf)).select("key", F.get_json_object("value", "$.ues.source.ip").alias("src"))


@query("snk_null", "SELECT count(*) AS n FROM events")
def snk_null(spark, sf):
    e = event_fields(spark, sf)
    S.write_noop(e)
    return e.agg(F.count(F.lit(1)).alias("n"))


@query("snk_fanout", "SELECT 'a' AS sink, 'ok' AS status, count(*) AS n FROM events UNION ALL SELECT 'b', 'failed: ValueError: sink is down', 0 UNION ALL SELECT 'c', 'ok', count(*) FROM events")
def snk_fanout(spark, sf):
    paths = {n: new_dir(spark, f"fan-{n}") for n in "abc"}

    def fail(df, batch_id):
        raise ValueError("sink is down")

    sinks = {n: (lambda df, i, p=p: df.write.parquet(p)) for n, p in paths.items()}
    said = S.fan_out(event_fields(spark, sf), 0, {**sinks, "b": fail})
    out = None
    for n in "abc":
        rows = spark.read.parquet(paths[n]) if said[n] == "ok" else event_fields(spark, sf).limit(0)
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("sink"), F.lit(said[n]).alias("status"), "n")
        out = one if out is None else out.unionByName(one)
    return out
