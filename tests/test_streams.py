"""Files that grow, line ids, and late rows."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from logspark.catalog import ORACLES, QUERIES, streams
from logspark.operators.normalize import with_integrity, with_source_columns
from logspark.sinks.files import fan_out
from logspark.sources import growing, lines as L
from logspark.streaming import late
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["src_tail", "src_line_ids", "str_activity_late", "str_sessions_late", "str_dedup_late", "snk_fanout"])
def test_named_queries(spark, name):
    assert compare(spark, duck(SF), SF, name, QUERIES[name], ORACLES[name]) == ""


def expected(folder):
    out = set()
    for name in os.listdir(folder):
        at, data = 0, open(f"{folder}/{name}", "rb").read()
        for line in data[:data.rfind(b"\n") + 1].split(b"\n")[:-1]:
            if line.strip(b" \t\r"):
                out.add((name, at, line.rstrip(b"\r").decode("utf-8", "replace")))
            at += len(line) + 1
    return out


def got(df):
    rows = [(r.address.rsplit("/", 1)[1], r.raw_offset, r.raw) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_ranges_of_any_size_give_each_line_once(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\n\ntwo\r\n  \nthree \xff\n" + b"x" * 300 + b"\nlast\nhalf")
    (tmp_path / "b.log").write_bytes(b"\n\n")
    (tmp_path / "c.log").write_bytes(b"no end")
    (tmp_path / "d.log").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"not read\n")
    for size in (1, 2, 3, 7, 64, 1 << 20):
        assert got(growing.read(spark, str(tmp_path), "*.log", range_bytes=size)) == {x for x in expected(tmp_path) if x[0] != "_hidden"}
    assert growing.read(spark, str(tmp_path / "nothing")).collect() == []


def test_blocks_cut_lines(monkeypatch, tmp_path):
    (tmp_path / "a.log").write_bytes(b"".join(b"%d" % i * (i % 17) + b"\n" for i in range(200)) + b"half")
    monkeypatch.setattr(growing, "BLOCK", 5)
    files = growing._Files({"path": str(tmp_path), "range_bytes": "11"})
    rows = [row for part in files.ranges({}, files.now()) for batch in files.read(part) for row in batch.to_pylist()]
    found = {("a.log", r["raw_offset"], r["raw"]) for r in rows if r["raw"].strip()}
    assert found == expected(tmp_path) and len(rows) == 200


def test_a_followed_file_is_cut_off_and_grows_again(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    folder.mkdir()
    log = folder / "a.log"

    def run():
        stream = growing.tail(spark, str(folder), "*.log", range_bytes=9)
        (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
         .awaitTermination())
        rows = spark.read.schema(stream.schema).parquet(out).collect()
        return sorted((r.raw_offset, r.raw) for r in rows)

    log.write_bytes(b"first\nsecond\nthi")
    assert run() == [(0, "first"), (6, "second")]
    assert run() == [(0, "first"), (6, "second")]
    with log.open("ab") as f:
        f.write(b"rd\nfourth")
    assert run() == [(0, "first"), (6, "second"), (13, "third")]
    log.write_bytes(b"new\nshort\n")  # shorter than what was read
    assert run() == [(0, "first"), (0, "new"), (4, "short"), (6, "second"), (13, "third")]
    log.write_bytes(b"another first line\nand more\n")  # longer, but another file
    assert run() == [(0, "another first line"), (0, "first"), (0, "new"), (4, "short"), (6, "second"), (13, "third"), (19, "and more")]


def test_line_ids_do_not_depend_on_splits_and_other_files(spark, tmp_path):
    def ids(**conf):
        before = {k: spark.conf.get(k, None) for k in conf}
        for k, v in conf.items():
            spark.conf.set(k, v)
        try:
            rows = with_integrity(with_source_columns(L.read_lines(spark, str(tmp_path)))).select("address", "line_no", "raw", "trace_id").collect()
        finally:
            for k, v in before.items():
                spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
        return {r.trace_id: (r.address.rsplit("/", 1)[1], r.line_no, r.raw) for r in rows}

    for name in "abc":
        (tmp_path / f"{name}.txt").write_text("".join(f"{name} {i % 50}\n\n" for i in range(300)))
    first = ids()
    assert len(first) == 900 and sorted(v[1] for v in first.values() if v[0] == "b.txt") == list(range(300))
    assert ids(**{"spark.sql.files.maxPartitionBytes": "200b", "spark.sql.files.openCostInBytes": "0"}) == first
    assert ids(**{"spark.sql.files.minPartitionNum": "1"}) == first
    (tmp_path / "0.txt").write_text("0\n" * 100)
    again = ids(**{"spark.sql.files.minPartitionNum": "16"})
    assert len(again) == 1000 and first.items() <= again.items()


def test_sessions_of_one_busy_key_after_late_rows(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    seconds = [[0, 5, 200, 1000, 1005], [4000, 4001, 150, 1500], [300, 9000, 4300, 250]]
    step = late.sessions(("k",), 100, ("id",))
    for run, these in enumerate(seconds):
        rows = [("a", start + dt.timedelta(seconds=s), f"{run}-{s}") for s in these] + [("b", None, f"{run}-none")]
        spark.createDataFrame(rows, "k string, t timestamp, id string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("k string, t timestamp, id string").parquet(f"{tmp_path}/in")
        late.start(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", "t", 600, step, {"availableNow": True}).awaitTermination()
    everything = spark.read.parquet(f"{tmp_path}/out/rows")
    assert everything.count() == 16
    assert sorted((r.id) for r in late.late_rows(spark, f"{tmp_path}/out").collect()) == [
        "0-none", "1-150", "1-none", "2-250", "2-300", "2-none"]
    found = late.corrected_windows(spark, f"{tmp_path}/out", step).filter("k = 'a'").collect()
    base = int((start - dt.datetime(1970, 1, 1)).total_seconds())
    assert sorted((r.first_ms // 1000 - base, r.last_ms // 1000 - base, r.n, r["first"].id) for r in found) == [
        (0, 5, 2, "0-0"), (150, 300, 4, "1-150"), (1000, 1005, 2, "0-1000"), (1500, 1500, 1, "1-1500"),
        (4000, 4001, 2, "1-4000"), (4300, 4300, 1, "2-4300"), (9000, 9000, 1, "2-9000")]
    assert os.listdir(f"{tmp_path}/out/open") and not os.path.exists(f"{tmp_path}/out/open/batch=0")


def test_more_lines_are_more_files(spark, monkeypatch, tmp_path):
    """Files are bounded; the parts they come in stay four."""
    spark.range(400).select(F.col("id").alias("event_id"), F.lit(1).cast("long").alias("user_id"), F.lit("error").alias("event_type"), F.lit(1.0).alias("value"),
                            F.timestamp_seconds("id").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(streams, "FILE_LINES", 30)
    path, each = streams._line_files(spark, str(tmp_path))
    assert each == 4 and spark.read.text(path).select("_metadata.file_path").distinct().count() == 16
    assert streams.str_backpressure(spark, str(tmp_path)).count() == 400


def test_batches_are_not_kept_in_memory(spark):
    """One sink gets the batch as it is; several read one stored result, which goes when they are done. Nothing is cached."""
    got, folders = {}, set()

    def sink(name):
        def take(df, i):
            if name == "bad":
                raise OSError("not now")
            assert not df.storageLevel.useMemory and not df.storageLevel.useDisk
            folders.update(os.path.dirname(f.removeprefix("file:")) for f in df.inputFiles())
            got[name] = sorted(map(tuple, df.collect()))
        return take

    batch = spark.range(50).select("id", F.when(F.col("id") % 2 == 0, F.array(F.struct(F.lit("x").alias("k"), F.lit(None).cast("int").alias("v")))).alias("l"), F.expr("uuid()").alias("u"))
    assert fan_out(batch, 0, {"a": sink("a")}) == {"a": "ok"} and not folders
    said = fan_out(batch, 0, {n: sink(n) for n in ("b", "bad", "c")})
    assert said == {"b": "ok", "bad": "failed: OSError: not now", "c": "ok"}
    assert got["b"] == got["c"] and [r[:2] for r in got["a"]] == [r[:2] for r in got["b"]] and len(got["b"]) == 50
    assert len(folders) == 1 and not os.path.exists(folders.pop())
    # Rows that fail are counted for each sink that reads them; a type that Parquet lacks reaches all.
    said = fan_out(spark.range(5).select(F.raise_error(F.lit("broken row")).cast("int").alias("x")), 0, {n: sink(n) for n in ("d", "e", "bad")})
    assert "broken row" in said["d"] and "broken row" in said["e"] and said["bad"] == "failed: OSError: not now"
    assert fan_out(spark.range(2).withColumn("n", F.lit(None)), 0, {n: sink(n) for n in ("f", "g")}) == {"f": "ok", "g": "ok"}
    assert got["f"] == got["g"] == [(0, None), (1, None)]


def test_lines_are_numbered_where_they_are_read(spark, monkeypatch, tmp_path):
    """Small splits share a task, lines are not moved, and numbers are the same whether the starts of splits are broadcast or not."""
    (tmp_path / "in").mkdir()
    for name, end in (("a", "\n"), ("b", "\r\n"), ("c", "\n\n \n")):
        (tmp_path / "in" / f"{name}.txt").write_text(end.join(f"{name} {i % 7}" for i in range(400)) + end)
    (tmp_path / "in" / "empty.txt").write_text("")
    (tmp_path / "in" / "blank.txt").write_text("\n \n\r\n")
    want = sorted((n, i, f"{n} {i % 7}") for n in "abc" for i in range(400))

    def rows(df):
        return sorted((r.address.rsplit("/", 1)[1][0], r.line_no, r.raw) for r in df.collect())

    small = {"spark.sql.files.maxPartitionBytes": "100b", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        splits = spark.read.text(f"{tmp_path}/in").rdd.getNumPartitions()
        few = L.read_lines(spark, f"{tmp_path}/in")
        monkeypatch.setattr(L, "SPLITS", 0)
        moved = L.read_lines(spark, f"{tmp_path}/in")
        monkeypatch.setattr(L, "TASK_BYTES", 1)
        many = L.read_lines(spark, f"{tmp_path}/in")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert few._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1 and "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    assert few.select(F.spark_partition_id()).distinct().count() <= 4 * spark.sparkContext.defaultParallelism < splits
    assert rows(few) == rows(moved) == rows(many) == want
    out = str(tmp_path / "out")
    (L.stream_lines(spark, f"{tmp_path}/in", max_files=2).writeStream.foreachBatch(lambda df, i: L.numbered(df).write.parquet(f"{out}/batch={i}"))
     .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination())
    assert rows(spark.read.parquet(out)) == want
