"""Live correlation.

Each micro-batch is joined with the short history it needs and goes through the batch operators,
so stream and batch give the same cases. What carries over is written per batch id: the trailing
events of each source (as far back as a late event's window reaches, and at most ``history`` if that is set) and the
firings of each fingerprint that may still silence another. A replayed batch reads the same predecessor and
writes the same result; older state is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import correlate as C
from ..operators.windows import cooldown
from ..session import materialize, remove


class LiveCorrelation:
    """``foreachBatch`` target; ``path`` is a shared folder for cases, late rows and state."""

    def __init__(self, path: str, params: C.Params = C.Params(), late_seconds: int = 600, ttl: int = 3):
        self.path, self.params, self.late, self.ttl = path.rstrip("/"), params, late_seconds, ttl

    def _state(self, spark: SparkSession, name: str, batch_id: int) -> DataFrame | None:
        """What batch ``batch_id`` carried over. Only the first batch has no predecessor: any other state that can't be
        read stops the query, else its windows and cooldowns would be forgotten."""
        if batch_id < 0:
            return None
        return spark.read.parquet(f"{self.path}/state/{name}/batch={batch_id}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, p = batch.sparkSession, self.params
        new = materialize(C.flagged(batch).withColumn("_new", F.lit(True)), "live")
        tail = self._state(spark, "tail", batch_id - 1)
        fired_before = self._state(spark, "fired", batch_id - 1)
        if tail is not None:
            newest = F.lit(tail.agg(F.max("ts")).first()[0])
            is_late = F.coalesce(
                F.col("ts") < newest - F.expr(f"INTERVAL {self.late} SECONDS"), F.lit(False))
            late, new = new.filter(is_late), new.filter(~is_late)
            late.write.mode("overwrite").parquet(f"{self.path}/late/batch={batch_id}")
        work = new if tail is None else tail.unionByName(new)
        over = tuple(x for x in C.PATTERNS if x != C.REPEATED)
        cand, rows = C._source_patterns(work, p, over)
        c2, r2 = C._repeated(work, p)
        cand, rows = cand.unionByName(c2).filter("_new"), rows.unionByName(r2)
        if fired_before is not None:
            cand = not_silenced(cand, fired_before, p.cooldown)
        fired = materialize(cooldown(cand, "fingerprint", "ts", "trace_id", p.cooldown), "live-fired")
        head = fired.select("fingerprint", F.col("trace_id").alias("fired_by"), "source", "_slice", "role",
                            F.explode(F.sequence("ev_from", "ev_to")).alias("no"))
        found = rows.withColumn("ev", C._evidence_item()).select("source", "_slice", "role", "no", "ev")
        evidence = head.join(found, ["source", "_slice", "role", "no"]).select("fingerprint", "fired_by", "ev")
        own = fired.filter("self").select("fingerprint", F.col("trace_id").alias("fired_by"),
                                          C._evidence_item().alias("ev"))
        cases = C.make_cases(fired, evidence.unionByName(own), p)
        cases.write.mode("overwrite").parquet(f"{self.path}/cases/batch={batch_id}")
        self._carry(work, fired, fired_before, batch_id)

    def _carry(self, work: DataFrame, fired: DataFrame, fired_before: DataFrame | None, batch_id: int) -> None:
        p = self.params
        top = work.agg(F.max("ts").alias("t")).first()["t"]
        horizon = max(p.window, p.brute_window, p.group_window) + self.late  # a late event looks back over its own window
        fresh = work if top is None else work.filter(
            F.col("ts") >= F.lit(top) - F.expr(f"INTERVAL {horizon} SECONDS"))
        tail = fresh
        if p.history is not None:
            newest = [F.col("ts").desc(), F.col("trace_id").desc()]
            rank = F.row_number().over(Window.partitionBy("source").orderBy(*newest))
            # Denied events keep a history of their own per (source, action).
            rank2 = F.row_number().over(Window.partitionBy("source", "action").orderBy(*newest))
            tail = fresh.withColumn("_rank", rank).filter(F.col("_rank") <= p.history).drop("_rank").unionByName(
                fresh.filter("sec").withColumn("_rank", rank2).filter(F.col("_rank") <= p.history).drop("_rank"))
        tail = tail.dropDuplicates(["trace_id"]).withColumn("_new", F.lit(False))
        tail.write.mode("overwrite").parquet(f"{self.path}/state/tail/batch={batch_id}")
        last = fired.select("fingerprint", "ts")
        last = last if fired_before is None else last.unionByName(fired_before)
        if top is not None:
            reach = max(p.cooldown * self.ttl, p.cooldown + self.late)
            last = last.filter(F.col("ts") >= F.lit(top) - F.expr(f"INTERVAL {reach} SECONDS"))
        last.write.mode("overwrite").parquet(f"{self.path}/state/fired/batch={batch_id}")
        for name in ("tail", "fired"):
            if batch_id > 1:  # the batch before may still be asked for, should this one be repeated
                remove(work.sparkSession, f"{self.path}/state/{name}/batch={batch_id - 2}")


def not_silenced(cand: DataFrame, fired: DataFrame, seconds: int) -> DataFrame:
    """Candidates with no firing of their fingerprint less than the cooldown before or after them.

    A late candidate may lie before a firing that is out already; it fires only if neither would have silenced the other.
    Firings of a fingerprint are a cooldown apart, so a candidate meets four of them at most.
    """
    width = seconds * 1000
    cell = F.floor(F.unix_millis("ts") / width)
    near = fired.select(F.col("fingerprint").alias("_fp"), F.unix_millis("ts").alias("_at"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    hit = (F.col("fingerprint") == F.col("_fp")) & (cell == F.col("_cell")) & (F.abs(F.unix_millis("ts") - F.col("_at")) < width)
    return cand.join(near, hit, "left_anti")


def stream_correlate(events: DataFrame, path: str, checkpoint: str, params: C.Params = C.Params(),
                     late_seconds: int = 600, ttl: int = 3, trigger: dict | None = None) -> StreamingQuery:
    """Cases of a stream of events (str_live_correlate, str_state_expiry)."""
    return (events.writeStream.foreachBatch(LiveCorrelation(path, params, late_seconds, ttl))
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "10 seconds"})).start())


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/cases")
