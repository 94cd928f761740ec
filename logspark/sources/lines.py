"""Line sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.base import strip

#: A task reads so many bytes at least, where splits are smaller; opening a file counts as so many.
TASK_BYTES, OPEN_BYTES = 32 << 20, 4 << 20

#: Starts of splits are broadcast up to this number (100 MB, about).
SPLITS = 600_000


def _with_file(df: DataFrame) -> DataFrame:
    """Non-blank lines with their file and the split of it that they were read from."""
    lines = df.select(
        F.rtrim(F.col("value"), F.lit("\r")).alias("raw"), F.lit("file").alias("source_type"),
        F.col("_metadata.file_path").alias("address"), F.lit("file").alias("transport"),
        F.col("_metadata.file_modification_time").alias("received_time"),
        F.col("_metadata.file_block_start").alias("block"))
    return lines.filter(strip(F.col("raw")) != "")


def _before_in_file(df: DataFrame, size: Column, file: str, block: str, order: str) -> DataFrame:
    """Adds ``_before``, the summed sizes of a file's earlier lines: those of its split, and of the splits before it.

    A split's lines are a group of their own, so a huge file stays spread; of a file only its splits' totals meet. Total
    and rows come from two reads, whose splits may differ where the cluster changed between them: the total before a
    split depends on where it starts only, and a start that the other read lacks is an error.
    """
    within = F.coalesce(F.sum(size).over(
        Window.partitionBy(file, block).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = df.groupBy(file, block).agg(F.sum(size).alias("_size"))
    starts = totals.withColumn("_start", F.coalesce(F.sum("_size").over(
        Window.partitionBy(file).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    start = F.coalesce(F.col("_start"), F.raise_error(F.lit("the splits of the files changed while they were read")).cast("bigint"))
    return (df.withColumn("_within", within).join(starts, [file, block], "left")
            .withColumn("_before", start + F.col("_within")).drop("_within", "_start"))


def _pinned(df: DataFrame) -> DataFrame:
    """The rows over the partitions that the plan has now, so that all uses read the same lines in the same tasks."""
    spark, rows = df.sparkSession, df._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, df._jdf.schema(), False), spark)


def _partitions(df: DataFrame) -> int:
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def _fewer_tasks(lines: DataFrame, files: DataFrame) -> tuple[DataFrame, int]:
    """Lines read by tasks of ``TASK_BYTES`` or more, however small their splits are, and how many splits there are at most."""
    size, n = int(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()), len(files.inputFiles())
    tasks = max((size + n * OPEN_BYTES) // TASK_BYTES + 1, 4 * files.sparkSession.sparkContext.defaultParallelism)
    parts = _partitions(lines)
    return (lines.coalesce(tasks) if parts > tasks else lines), parts + n


def numbered(df: DataFrame, splits: int | None = None) -> DataFrame:
    """Adds line_no, a line's place among its file's non-blank lines, from 0; needs its file and split.

    The number depends on the file only, not on splits, their packing or other files, so every read repeats it. Lines stay
    where they are read: a split's lines have running row ids in their task, so its first id and its start in the file give
    each its number. Splits are counted by a read of their own, over the same partitions; an id out of its split's range is
    an error. The starts are broadcast unless there may be more than ``SPLITS``.
    """
    spark, df = df.sparkSession, _pinned(df)
    if splits is None:  # a partition has as many splits at most as files of no length
        bytes_of = spark._jsparkSession.sessionState().conf()
        splits = _partitions(df) * (bytes_of.filesMaxPartitionBytes() // max(bytes_of.filesOpenCostInBytes(), 1) + 1)
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    earlier = Window.partitionBy("address").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy("address", "block").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
              .withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))))
    place = F.col("_row") - F.col("_first")
    changed = F.raise_error(F.lit("the splits of the files changed while they were read")).cast("bigint")
    return (rows.join(F.broadcast(starts) if splits <= SPLITS else starts, ["address", "block"], "left")
            .withColumn("line_no", F.when((place >= 0) & (place < F.col("_n")), F.col("_start") + place).otherwise(changed))
            .drop("_row", "_n", "_first", "_start", "block"))


def read_lines(spark: SparkSession, path: str, pattern: str | None = None,
               recursive: bool = False, positions: bool = True) -> DataFrame:
    """Non-blank lines of text files (src_lines); a folder is filtered by ``pattern``
    (src_dir_glob). Bad UTF-8 becomes the replacement character.

    Lines are numbered in their files (``numbered``), which reads them twice; without ``positions`` they are read once, and
    have no ids to be known by.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.text(path)
    lines = _with_file(files)
    return numbered(*_fewer_tasks(lines, files)) if positions else lines


def stream_lines(spark: SparkSession, path: str, max_files: int = 100, pattern: str | None = None,
                 latest_first: bool = False) -> DataFrame:
    """The streaming form for files that arrive whole. The checkpoint holds what has been read; ``max_files`` bounds
    a micro-batch and nothing is dropped (str_backpressure). A file is in one micro-batch, where its lines are numbered
    (``numbered``). For files that grow see ``growing.tail`` (src_tail)."""
    reader = (spark.readStream.option("maxFilesPerTrigger", max_files)
              .option("latestFirst", str(latest_first).lower()))
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return _with_file(reader.text(path))


def read_positions(spark: SparkSession, path: str, pattern: str | None = None,
                   recursive: bool = False, block_bytes: int | None = None) -> DataFrame:
    """Lines with their byte offset (src_byte_offset).

    The line reader keeps the order inside a split, so a running sum over the row id gives the offset in the split, and
    the splits' totals say where each starts.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("lineSep", "\n")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.text(path).select(
        F.col("value").alias("raw"), F.lit("file").alias("source_type"),
        F.col("_metadata.file_path").alias("address"), F.lit("file").alias("transport"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("rid"))
    return with_byte_offset(rows)


def with_byte_offset(df: DataFrame, file: str = "address", block: str = "block",
                     order: str = "rid") -> DataFrame:
    """Adds raw_offset from the sizes of the earlier lines of the file, blank lines included.

    Blank lines are dropped afterwards.
    """
    out = _before_in_file(df, F.octet_length("raw") + 1, file, block, order)
    return (out.withColumnRenamed("_before", "raw_offset").drop(block, order)
            .withColumn("raw", F.rtrim(F.col("raw"), F.lit("\r"))).filter(strip(F.col("raw")) != ""))


def tail_lines(df: DataFrame, n: int, file: str = "address", order: str = "raw_offset") -> DataFrame:
    """Last n lines of each file (src_file_tail_n).

    The rank filter is applied per input partition before the shuffle, so at most n rows of a
    file leave a task.
    """
    rank = F.row_number().over(Window.partitionBy(file).orderBy(F.col(order).desc()))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def fill_limit(lines: DataFrame, limit: int, file: str = "address", order: str = "raw_offset") -> DataFrame:
    """Files in name order until ``limit`` lines are reached (srt_fill_across_files)."""
    return lines.orderBy(file, order).limit(limit)


def explode_payload(df: DataFrame, col: str) -> DataFrame:
    """Records of a multi-line payload, blank ones left out (src_payload_lines)."""
    return (df.select("*", F.posexplode(F.split(F.col(col), r"\r\n|\r|\n")).alias("line_no", "raw"))
            .drop(col).filter(strip(F.col("raw")) != ""))


def from_journal(df: DataFrame, col: str = "raw") -> DataFrame:
    """MESSAGE of journal JSON lines, the whole line if it has none; bad JSON is dropped
    (src_journal_json)."""
    parsed = F.try_parse_json(F.col(col))
    message = F.try_variant_get(parsed, "$.MESSAGE", "string")
    return (df.filter(parsed.isNotNull()).withColumn(col, F.coalesce(message, F.col(col)))
            .filter(strip(F.col(col)) != ""))
