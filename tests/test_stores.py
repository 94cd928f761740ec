"""The sealed archive, the bucket table, text indicators and live cooldowns."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logspark.functions.tables import FAILURE_WORDS, SUCCESS_WORDS
from logspark.catalog import ORACLES, QUERIES, lookups
from logspark.catalog.base import event_view
from logspark.operators import enrich as E
from logspark.sinks import archive
from logspark.sinks.buckets import BucketTable
from logspark.sources.feeds import geo_ranges, threat_indicators
from logspark.streaming.correlation import not_silenced
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["snk_raw_archive_tree", "snk_raw_archive_proofs", "snk_upsert_buckets", "snk_bulk_ndjson", "alr_evaluate",
                                  "jn_threat_string_long", "enr_classify_text", "jn_alias", "agg_sketch_ranges"])
def test_named_queries(spark, name):
    assert compare(spark, duck(SF), SF, name, QUERIES[name], ORACLES[name]) == ""


def test_a_broken_chain_is_found(spark, tmp_path):
    path, e = str(tmp_path), event_view(spark, SF)
    for k in range(2):
        assert archive.append(e.filter(F.crc32(F.col("raw")) % 2 == k).limit(300), path) == k
    rows, tree, sealed = archive.stored(spark, path)
    say = lambda *t: sorted({(r.seal, r.level, r.problem) for r in archive.verify(*t).collect()})
    assert say(rows, tree, sealed) == []
    assert say(rows, tree, sealed.withColumn("previous", F.lit("x"))) == [(0, -1, "chain"), (1, -1, "chain")]
    assert say(rows, tree, sealed.filter("seal = 1")) == [(0, -1, "root"), (1, -1, "chain")]
    assert (1, -1, "root") in say(rows, tree, sealed.withColumn("root", F.when(F.col("seal") == 1, "x").otherwise(F.col("root"))))
    wrong = F.when((F.col("level") == 1) & (F.col("no") == 0) & (F.col("seal") == 0), "x").otherwise(F.col("hash"))
    assert {p for s, _, p in say(rows, tree.withColumn("hash", wrong), sealed) if s == 0} == {"node"}
    extra = rows.limit(1).withColumn("no", F.lit(10_000).cast("bigint"))
    assert (extra.first().seal, 0, "added") in say(rows.unionByName(extra), tree, sealed)
    one = archive.proofs(rows, tree, rows.limit(1))
    assert archive.proved(one, sealed).first().ok and not archive.proved(one.withColumn("leaf", F.lit("x")), sealed).first().ok


def test_updates_touch_their_buckets_only(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ["id"], ["v"], 32)
    assert table.read() is None
    df = lambda rows: spark.createDataFrame(rows, "id long, v long, x string")
    table.write(df([(i, 0, "old") for i in range(1000)]), "a")
    done = table.write(df([(7, 1, "new"), (7, 2, "newer"), (5000, 1, "added")]), "b")
    assert done["version"] == 1 and done["written"] <= 2
    assert table.write(df([(8, 9, "again")]), "b") == {"version": 1, "read": 0, "written": 0}
    got = {r.id: r.x for r in table.read().collect()}
    assert len(got) == 1001 and got[7] == "newer" and got[5000] == "added" and got[8] == "old"
    assert table.read(0).count() == 1000
    table.write(df([(9, 1, "third")]), "c")
    table.write(df([(9, 2, "fourth")]), "d", ["v"])
    assert {r.id: r.x for r in table.read().collect()}[9] == "third" and table.read().count() == 1001


def test_long_texts_and_many_indicators(spark):
    """Every indicator that a text holds is found, the earliest shown; long texts cost their length."""
    feed = [(f"needle-{i:05d}-{i * 7919 % 1000}", "t", "high", "f", i) for i in range(3000)] + [("zz", "t", "high", "f", 9000), ("ü€", "t", "low", "f", 9001)]
    ind = threat_indicators(spark.createDataFrame(feed, "indicator string, type string, severity string, source string, ord long"))
    texts = ["lorem ipsum " * 3000 + feed[17][0] + " and " + feed[5][0], "x" * 20_000, "needle-00001-", "fizz buzz", "about ü€ only", "needle-00001-7919"]
    got = {r.text: r.indicator for r in E.text_hits(spark.createDataFrame([(t,) for t in texts], "text string"), ind).collect()}
    assert got == {texts[0]: feed[5][0], texts[3]: "zz", texts[4]: "ü€"} | (
        {texts[5]: feed[1][0]} if feed[1][0] in texts[5] else {})


def test_late_candidates_and_past_firings(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    fired = spark.createDataFrame([("a", at(1000)), ("a", at(1700)), ("b", at(0))], "fingerprint string, ts timestamp")
    cand = spark.createDataFrame([("a", at(s), str(s)) for s in (300, 400, 401, 900, 1599, 1650, 2299, 2300)] + [("b", at(599), "b1"), ("b", at(600), "b2"),
                                 ("c", at(5), "c")], "fingerprint string, ts timestamp, trace_id string")
    assert sorted(r.trace_id for r in not_silenced(cand, fired, 600).collect()) == ["2300", "300", "400", "b2", "c"]


def test_like_indicators_are_listed_apart(spark):
    """Indicators that differ in a number only are told apart by what they are listed under, in few texts and in many."""
    feed = spark.createDataFrame([(f"lot {i} of brand#{i % 7}", i) for i in range(10_000, 14_000)], "indicator string, ord long").withColumn("m", F.lit("x"))
    keyed = E._rarest(feed, spark.createDataFrame([("saw lot 10001 of brand#5",)], "text string"), 16)
    assert keyed.select("_key").distinct().count() == 4_000


def test_many_indicators_by_the_shuffled_join(spark, monkeypatch):
    rows = [(w, "t", "high", "f", i) for i, w in enumerate(["lot 12", "lot 123456", "lot 123456 of brand", "x" * 40, "ab", "12345678"])]
    ind = threat_indicators(spark.createDataFrame(rows, "indicator string, type string, severity string, source string, ord long"))
    texts = [f"saw {w}, and more" for w, *_ in rows] + ["lot 1 of", "y" * 60, "x" * 39]
    want = {t: min(((i, w) for w, *_, i in rows if w in t), default=(None, None))[1] for t in texts}
    monkeypatch.setattr(E, "BROADCAST_INDICATORS", 0)
    monkeypatch.setattr(E, "BITS", 64)
    got = {r.text: r.indicator for r in E.text_hits(spark.createDataFrame([(t,) for t in texts], "text string"), ind).collect()}
    assert got == {t: w for t, w in want.items() if w}


def test_one_block_of_addresses_is_not_shuffled(spark, monkeypatch):
    """All events in one block stay where they are; beyond the bound the join gives the same."""
    ranges = geo_ranges(spark.createDataFrame([("8.8.8.0", "8.8.8.127", "outer", ""), ("2600::", "2600:1::", "six", "")], "start string, end string, country string, city string"))
    e = spark.createDataFrame([(i, "8.8.8.%d" % (i % 256) if i % 2 else "2600::%x" % i) for i in range(1, 400)], "i int, ip string").select(
        "i", F.struct(F.struct("ip").alias("source"), F.struct("ip").alias("destination")).alias("ues"))
    near = E.geo_join_v6(E.geo_join(e, ranges, "source"), ranges, "source").select("i", "geo_source.country")
    assert "SortMergeJoin" not in near._jdf.queryExecution().toString() and "Exchange hashpartitioning" not in near._jdf.queryExecution().toString()
    got = sorted(map(tuple, near.collect()))
    assert got == [(i, "six" if i % 2 == 0 else "outer" if i % 256 < 128 else None) for i in range(1, 400)]
    monkeypatch.setattr(E, "BROADCAST_RANGES", 0)
    assert sorted(map(tuple, E.geo_join_v6(E.geo_join(e, ranges, "source"), ranges, "source").select("i", "geo_source.country").collect())) == got


def test_dear_views_are_dealt_out(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("event_id"), F.lit(1).cast("long").alias("user_id"), F.lit("error").alias("event_type"), F.lit(1.0).alias("value"),
                             F.timestamp_seconds("id").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert lookups.enr_classify_late(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() > 1


def test_proofs_move_groups_not_paths(spark, monkeypatch, tmp_path):
    """Proofs of a deep tree, some of them broken; no path of a row goes through a shuffle."""
    monkeypatch.setattr(archive, "FAN", 3)
    made = spark.range(50).select(
        F.struct(F.timestamp_seconds("id").alias("ingest_time")).alias("ues"),
        F.struct(F.concat(F.lit("t"), F.col("id").cast("string")).alias("trace_id"), F.lit("h").alias("raw_hash")).alias("trace"), F.lit("x").alias("raw"))
    archive.append(made, str(tmp_path))
    archive.append(made.limit(2), str(tmp_path))
    rows, tree, sealed = archive.stored(spark, str(tmp_path))
    assert [r.no for r in rows.filter("seal = 0").orderBy("trace_id").select("no").collect()] == list(range(50))
    for most in (1 << 18, 0):
        monkeypatch.setattr(archive, "BROADCAST", most)
        proof = archive.proofs(rows, tree, rows.select("trace_id"))
        got = {(r.seal, r.no): r for r in archive.proved(proof, sealed).collect()}
        assert len(got) == 52 and all(r.ok for r in got.values())
        assert {s: {len(r.path) for r in got.values() if r.seal == s} for s in (0, 1)} == {0: {4}, 1: {1}}
        assert [(p.level, p.place) for p in got[0, 47].path] == [(0, 2), (1, 0), (2, 2), (3, 1)]
        gone = archive.proofs(rows, tree.filter("NOT (seal = 0 AND level = 0 AND no < 3)"), rows.select("trace_id"))
        assert sorted((r.seal, r.no) for r in archive.proved(gone, sealed).filter("NOT ok").collect()) == [(0, 0), (0, 1), (0, 2)]
    plan = proof._sc._jvm.PythonSQLUtils.explainString(proof._jdf.queryExecution(), "simple")
    assert "place" not in "".join(x for x in plan.splitlines() if "Aggregate" in x) and "ShuffledHashJoin" in plan


def test_whole_words_as_one_pattern_would_find_them(spark):
    """Words searched one by one, and a message that is its own line read once, give what one pattern over both texts gives."""
    words = [*FAILURE_WORDS, *SUCCESS_WORDS]
    texts = [t for w in words for t in (w, w.upper(), f"x{w}", f"{w}s", f"_{w}", f"{w}1 {w}", f"-{w}.", f"a {w.title()}\nb", f"é {w}", f"é{w}", f"{w}é", f"nothing {w[:-1]}")]
    texts += ["ſuccess", "blocKed", "faİled", "faıled", "K refused", "by peer, connection reset", "user x is invalid", "out at last: timed", "reset", "peer reset by", "by peer reset",
              "credentials: bad", " user invalid", "users invalid", "by peers reset", "credentials\tare\tbad", "user\tinvalid", "out of memory", "control\tof command and", "of memory, out", "and control command", "password x failed", "", " "]
    rows = [(t, raw) for t in texts for raw in (t, f"{t} dropped", "error", None, "")] + [(None, t) for t in texts]
    e = spark.createDataFrame(rows, "m string, raw string").select(F.struct(
        F.col("m").alias("message"), *[F.lit(None).cast("string").alias(n) for n in ("action", "outcome", "category", "type")], F.struct(F.lit(None).cast("string").alias("ip")).alias("source"),
        F.struct(F.lit(None).cast("string").alias("ip")).alias("destination"), F.struct(*[F.lit(None).cast("string").alias(n) for n in ("url", "method")]).alias("http"),
        F.struct(F.lit(None).cast("string").alias("query")).alias("dns")).alias("ues"), "raw")
    whole = F.concat_ws(" ", F.when(F.col("ues.message") != "", F.col("ues.message")), F.when(F.col("raw") != "", F.col("raw")))
    said = [whole.rlike(rf"(?iU)\b({'|'.join(w)})\b") for w in (FAILURE_WORDS, SUCCESS_WORDS)]
    want = F.when(said[0], "failure").when(said[1], "success")
    got = E.enr_classify(e.withColumns({"want": want, "kind": F.coalesce(E.category_of(whole), F.lit("system"))})).select("ues.message", "raw", "ues.outcome", "want", "ues.category", "kind")
    assert [r for r in got.collect() if r.outcome != r.want or r.category != r.kind] == []
    assert {r.outcome for r in got.collect()} == {"failure", "success", None}
