"""Token ids as flat files of unsigned integers with 64-bit document offsets.

A set of files is a folder with ``<name>.ids`` (ids back to back, little-endian unsigned, 16 or 32 bit),
``<name>.offsets`` (n + 1 little-endian signed 64-bit integers, where each document starts, in ids) and
``<name>.docs`` (n document numbers, 64 bit). The manifest, a Parquet table, names the files in order, with the
number of documents and ids of each; the place of a file among all ids is the prefix sum of the counts before it.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import new_dir
from . import pieces
from .common import bounded_batches, map_batches, text_of

#: A document of no number sorts first, as this one.
NO_DOC = -(1 << 63)


def _store(folder: str):
    """The file system of a folder URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _is_local(store) -> bool:
    from pyarrow import fs

    return isinstance(store, fs.LocalFileSystem)


def write(df: DataFrame, folder: str, path: str, end_id: int | None, doc: str = "doc_id", text: str = "text",
          partition_bytes: int = 64 << 20, width: int = 2) -> DataFrame:
    """Encodes the texts and writes the files in ascending order of ``doc``; returns the manifest.

    The texts are dealt once, by ranges of ``doc``; each task sorts its range on disk if need be, and streams ids
    into its own files. A file's name holds a random part, and the manifest names the files of the attempt that
    succeeded, so a task that runs again after a lost executor leaves at most an unnamed file.

    A null text counts as empty and has only the end id; documents of the same number lie in the order of their
    texts; a null number sorts first. An empty table gives an empty manifest. Other columns are ignored.
    """
    spark = df.sparkSession
    rows = df.select(F.col(doc).cast("long").alias("doc"), text_of(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // partition_bytes + 1)
    store, root = _store(folder)
    store.create_dir(root, recursive=True)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, code = TaskContext.get().partitionId(), {2: "<u2", 4: "<u4"}[width]
        encoder, out = pieces.encoder(path, width), None
        end = b"" if end_id is None else np.array([end_id], code).tobytes()
        n_docs = n_ids = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                name = f"{part:06d}-{uuid.uuid4().hex}"
                store, root = _store(folder)
                out = {k: store.open_output_stream(f"{root}/{name}.{k}") for k in ("ids", "offsets", "docs")}
                out["offsets"].write(np.zeros(1, "<i8").tobytes())
            docs = np.array(batch.column(0).fill_null(NO_DOC), "<i8")
            lengths = np.empty(len(docs), "<i8")
            for i, packed in enumerate(encoder.encode(batch.column(1).to_pylist())):
                lengths[i] = (len(packed) + len(end)) // width
                out["ids"].write(packed + end)
            out["offsets"].write((n_ids + np.cumsum(lengths)).astype("<i8").tobytes())
            out["docs"].write(docs.tobytes())
            n_docs, n_ids = n_docs + len(docs), n_ids + int(lengths.sum())
        if out is not None:
            for f in out.values():
                f.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "width": pa.array(
                [width], pa.int32()), "n_docs": [n_docs], "n_ids": [n_ids]})

    files = (bounded_batches(rows).repartitionByRange(parts, F.col("doc")).sortWithinPartitions("doc", "text")
             .mapInArrow(run, "part int, name string, width int, n_docs long, n_ids long"))
    target = f"{folder.rstrip('/')}/manifest.parquet"
    files.write.parquet(target)
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files in order, each with the number of documents and ids in all files before it.

    One row a file of many megabytes, so the running sums are over a small table.
    """
    files = spark.read.schema("part int, name string, width int, n_docs long, n_ids long").parquet(
        f"{folder.rstrip('/')}/manifest.parquet")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumns({"first_doc": F.coalesce(F.sum("n_docs").over(before), F.lit(0)),
                              "first_id": F.coalesce(F.sum("n_ids").over(before), F.lit(0))})


def _array(store, path: str, code: str):
    """A file as an array: mapped into memory where the store is a file system, else read as a buffer."""
    import numpy as np

    size = store.get_file_info(path).size
    if not size:
        return np.empty(0, code)
    if _is_local(store):
        return np.memmap(path, code, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(size), code)


def documents(spark: SparkSession, folder: str, step: int = 4096) -> DataFrame:
    """Reads the files back: per document its number, where it starts among all ids, its count and a crc32.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers. Each file is one row of work.
    """
    work = manifest(spark, folder)
    n = max(1, work.count())

    def make():
        store, root = _store(folder)

        def one(row):
            import numpy as np

            base = f"{root}/{row['name']}"
            ids = _array(store, f"{base}.ids", {2: "<u2", 4: "<u4"}[row["width"]])
            offsets, docs = _array(store, f"{base}.offsets", "<i8"), _array(store, f"{base}.docs", "<i8")
            assert len(docs) == row["n_docs"] and len(ids) == row["n_ids"] == offsets[-1], f"{base}: wrong size"
            crc = [zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            return docs, offsets[:-1] + row["first_id"], np.diff(offsets), np.array(crc, "i8")

        def run(batch):
            import numpy as np
            import pyarrow as pa

            rows = [dict(zip(batch, values)) for values in zip(*(c.to_pylist() for c in batch.values()))]
            got = [np.concatenate(x) for x in zip(*map(one, rows))]
            out = dict(zip(("doc", "start", "n_tokens", "ids_crc32"), (pa.array(np.asarray(x)) for x in got)))
            return out | {"doc": pa.array(got[0], mask=got[0] == NO_DOC)}
        return run

    return map_batches(work.repartition(n, "part"), make, "doc long, start long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, path: str, end_id: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes a table to new files in the shared folder and reads them back."""
    folder = new_dir(df.sparkSession, "tokens")
    write(df, folder, path, end_id, doc, text)
    return documents(df.sparkSession, folder).withColumnRenamed("doc", doc)
