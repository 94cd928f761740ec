"""Event-time windows that keep their late rows.

Spark's watermark drops a late row without a word. Here the watermark is a stored value by which each micro-batch is
split: rows before it go to a side table, the others are merged with the windows that are still open, and windows that
the new watermark has passed are written as closed. All of it lies in tables by batch id, so a replayed batch reads what
its predecessor left and writes the same again, and late rows can be merged into closed windows whenever that is wanted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import remove


@dataclass(frozen=True)
class Step:
    """Windows as mergeable parts: of rows, of several parts, and the millisecond from which a part can't change."""

    parts: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    closes: Column


def buckets(seconds: int, by: tuple[str, ...] = ()) -> Step:
    """Rows per bucket of time and the columns ``by``: (*by, bucket_ms, n). Rows have their time as ``_ms``."""
    width = seconds * 1000
    key = [*by, "bucket_ms"]
    return Step(
        lambda rows: rows.withColumn("bucket_ms", F.floor(F.col("_ms") / width) * width).groupBy(*key).agg(F.count("*").alias("n")),
        lambda parts: parts.groupBy(*key).agg(F.sum("n").alias("n")),
        F.col("bucket_ms") + width)


def sessions(key: tuple[str, ...], gap_seconds: int, first: tuple[str, ...] = ()) -> Step:
    """Sessions of a key, parted by gaps of ``gap_seconds`` or more: (*key, first_ms, last_ms, n, first), where ``first`` is
    a struct of the earliest row's columns (ties: the least).

    Rows of a key that fall into one stretch of the gap's length belong together in any case; they are merged before
    they move, so a window function meets at most a row for each such stretch of a key.
    """
    gap = gap_seconds * 1000
    head = F.struct(*first, F.lit(0).alias("_")) if first else F.struct(F.lit(0).alias("_"))
    order = F.struct("first_ms", "first")

    def parts(rows: DataFrame) -> DataFrame:
        rows = rows.select(*key, "_ms", head.alias("first"))
        return rows.groupBy(*key, F.floor(F.col("_ms") / gap).alias("_stretch")).agg(
            F.min("_ms").alias("first_ms"), F.max("_ms").alias("last_ms"), F.count("*").alias("n"),
            F.min(F.struct("_ms", "first"))["first"].alias("first")).drop("_stretch")

    def merge(found: DataFrame) -> DataFrame:
        earlier = Window.partitionBy(*key).orderBy("first_ms", "last_ms").rowsBetween(Window.unboundedPreceding, -1)
        upto = Window.partitionBy(*key).orderBy("first_ms", "last_ms").rowsBetween(Window.unboundedPreceding, 0)
        marked = found.withColumn("_end", F.max("last_ms").over(earlier))
        starts = (F.col("_end").isNull() | (F.col("first_ms") >= F.col("_end") + gap)).cast("int")
        marked = marked.withColumn("_new", starts).withColumn("_session", F.sum("_new").over(upto))
        return marked.groupBy(*key, "_session").agg(
            F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.sum("n").alias("n"),
            F.min(order)["first"].alias("first")).drop("_session")

    return Step(parts, merge, F.col("last_ms") + gap)


class LateTables:
    """``foreachBatch`` target and its tables below ``path``: rows (with a flag for late ones), closed, open, marks."""

    def __init__(self, path: str, ts: str, delay_seconds: int, step: Step):
        self.path, self.ts, self.delay, self.step = path.rstrip("/"), ts, delay_seconds * 1000, step

    def _table(self, name: str, batch_id: int) -> str:
        return f"{self.path}/{name}/batch={batch_id}"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Only the first batch has no predecessor; any other that can't be read stops the query.
        mark = None if batch_id == 0 else spark.read.parquet(self._table("marks", batch_id - 1)).first()["mark_ms"]
        rows = batch.withColumn("_ms", F.unix_millis(self.ts))
        late = F.col("_ms").isNull() if mark is None else F.coalesce(F.col("_ms") < mark, F.lit(True))
        rows.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(self._table("rows", batch_id))
        kept = spark.read.schema(rows.withColumn("late", late).schema).parquet(self._table("rows", batch_id)).filter("NOT late").drop("late")
        newest = kept.agg(F.max("_ms")).first()[0]
        after = max((x for x in (mark, None if newest is None else newest - self.delay) if x is not None), default=None)
        parts = self.step.parts(kept)
        if batch_id:
            parts = parts.unionByName(spark.read.parquet(self._table("open", batch_id - 1)))
        merged = self.step.merge(parts)
        done = F.lit(False) if after is None else self.step.closes <= after
        merged.withColumn("_done", done).write.mode("overwrite").partitionBy("_done").parquet(self._table("windows", batch_id))
        windows = spark.read.schema(merged.withColumn("_done", done).schema).parquet(self._table("windows", batch_id))
        windows.filter("_done").drop("_done").write.mode("overwrite").parquet(self._table("closed", batch_id))
        windows.filter("NOT _done").drop("_done").write.mode("overwrite").parquet(self._table("open", batch_id))
        spark.createDataFrame([(after,)], "mark_ms bigint").coalesce(1).write.mode("overwrite").parquet(self._table("marks", batch_id))
        remove(spark, self._table("windows", batch_id))
        if batch_id > 1:  # the batch before may still be asked for, should this one be repeated
            remove(spark, self._table("open", batch_id - 2))
            remove(spark, self._table("marks", batch_id - 2))


def start(rows: DataFrame, path: str, checkpoint: str, ts: str, delay_seconds: int, step: Step,
          trigger: dict | None = None) -> StreamingQuery:
    """Runs the step over a stream; a row is late if it lies more than the delay before the newest row of earlier batches.

    Rows without a time count as late.
    """
    return (rows.writeStream.foreachBatch(LateTables(path, ts, delay_seconds, step)).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "10 seconds"})).start())


def _last_batch(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path.rstrip('/')}/marks").agg(F.max("batch")).first()[0]


def closed_windows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/closed").drop("batch")


def open_windows(spark: SparkSession, path: str) -> DataFrame:
    """The windows that the last batch left open."""
    return spark.read.parquet(f"{path.rstrip('/')}/open/batch={_last_batch(spark, path)}")


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The side table: all rows that came after the watermark, with their batch."""
    return spark.read.parquet(f"{path.rstrip('/')}/rows").filter(F.col("late").cast("boolean")).drop("late")


def corrected_windows(spark: SparkSession, path: str, step: Step) -> DataFrame:
    """Closed and open windows with the late rows merged in: what one run over all rows would give."""
    late = step.parts(late_rows(spark, path).filter("_ms IS NOT NULL"))
    return step.merge(closed_windows(spark, path).unionByName(open_windows(spark, path)).unionByName(late))
