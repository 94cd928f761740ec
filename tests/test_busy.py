"""Named queries over events that the given tables don't have, against their SQL."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from logspark import logviews as V
from logspark.catalog import ORACLES, QUERIES
from logspark.streaming import jobs as J
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


def stored(spark, path, rows):
    """rows (time, type, user) as the events table of a folder."""
    types = dict(V.read(spark, SF, "events").dtypes)
    df = spark.createDataFrame([(i, t.isoformat(sep=" "), kind, user, 1.5) for i, (t, kind, user) in enumerate(rows)],
                               "event_id long, ts string, event_type string, user_id long, value double")
    df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in types.items()]).coalesce(1).write.parquet(f"{path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/events.parquet/*.parquet')")
    return con, str(path)


@pytest.fixture(scope="module")
def busy(spark, tmp_path_factory):
    """One source with failures, a scan and two sign-ups over 200 events before a privileged action and another sign-up."""
    kinds = ["error"] * 6 + ["click", "signup"] + ["view"] * 450 + ["purchase", "signup"] + ["view"] * 30
    start = dt.datetime(2024, 1, 5, 6, 0, 1)
    rows = [(start + dt.timedelta(seconds=20 * i), kind, 16) for i, kind in enumerate(kinds)]
    return stored(spark, tmp_path_factory.mktemp("busy"), rows)


@pytest.mark.parametrize("name", ["cor_all", "win_recent_evidence", "str_live_correlate", "str_state_expiry"])
def test_more_than_200_events_of_a_source_in_a_window(spark, busy, name):
    con, path = busy
    assert con.execute(ORACLES[name]).fetchall()
    assert compare(spark, con, path, name, QUERIES[name], ORACLES[name]) == ""


@pytest.mark.parametrize("name", ["str_live_correlate", "str_state_expiry"])
def test_live_events_of_any_date(spark, tmp_path, name):
    rows = [(dt.datetime(year, 6, 1, 9, 0, 1) + dt.timedelta(minutes=i), kind, 16) for year in (2019, 2024, 2027)
            for i, kind in enumerate(["error"] * 6 + ["signup", "click", "purchase"])]
    con, path = stored(spark, tmp_path, rows)
    assert con.execute(ORACLES[name]).fetchall()
    assert compare(spark, con, path, name, QUERIES[name], ORACLES[name]) == ""


def test_counters_of_more_than_100_batches(spark, tmp_path):
    ev = V.read(spark, SF, "events")
    ev.limit(240).repartition(120).write.parquet(str(tmp_path / "many"))
    s = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "many"))
    got = J.run_stats(V.events(s), spark)
    assert got.count() == 120 and got.agg(F.sum("received")).first()[0] == 240


def test_live_events_when_half_have_the_first_time(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 5), "view", 16 * i) for i in range(60)] + [
        (dt.datetime(2024, 1, 5, 9, i), "view", 16) for i in range(1, 50)]
    con, path = stored(spark, tmp_path, rows)
    assert compare(spark, con, path, "str_state_expiry", QUERIES["str_state_expiry"], ORACLES["str_state_expiry"]) == ""
