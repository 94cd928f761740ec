"""Helpers shared by the operators: reading tables, batch-wise Python, small fixed patterns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: The white space that separates words, and words as runs of anything else.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Rows that cross to Python at once. Texts are a few kB on average and up to megabytes, so Spark's own ten thousand would
#: take hundreds of MB in every worker.
BATCH_ROWS = 1000


def bounded_batches(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """The same rows, after the session has been told to cross to Python in small batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(key)) > rows:
        df.sparkSession.conf.set(key, str(rows))
    return df


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str | StructType) -> DataFrame:
    """Runs ``make()`` once a task and the function it returns once an Arrow batch.

    The function gets the batch's columns as Arrow arrays by name and returns columns (arrays or lists) by
    name; rows may be fewer or more than it got. A batch is never kept after it is used.
    """
    out = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted, work = to_arrow_schema(out), make()
        for batch in batches:
            if batch.num_rows:
                got = work({n: batch.column(i) for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) and x.type == f.type else
                     x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type)
                     for f, x in ((f, got[f.name]) for f in wanted)], schema=wanted)

    return bounded_batches(df).mapInArrow(run, out)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
