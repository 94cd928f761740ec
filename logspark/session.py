"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def utc(spark: SparkSession) -> SparkSession:
    """Pin the session to UTC; every timestamp in the event schema is UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the workers once a session, so that they find it from any folder."""
    if getattr(spark.sparkContext, "_logspark_shipped", None) is None:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="logspark-ship-")) / "logspark_package.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for f in sorted(root.rglob("*")):
                if f.suffix in (".py", ".yaml", ".csv"):
                    out.write(f, f"{root.name}/{f.relative_to(root)}")
        spark.sparkContext.addPyFile(str(archive))
        spark.sparkContext._logspark_shipped = str(archive)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may do without that setting (tests, a laptop): a temporary folder is used then. On a cluster
    each machine would have its own, so there the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not named:
        named = getattr(spark.sparkContext, "_logspark_scratch", None)
        if named is None:
            named = tempfile.mkdtemp(prefix="logspark-")
            spark.sparkContext._logspark_scratch = named
    return named


def new_dir(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nobody has used yet."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Used where a result feeds several later jobs: the lineage is cut at durable storage, so a
    lost executor costs a re-read and not a recomputation.
    """
    spark = df.sparkSession
    path = new_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote and nobody reads any more; no error if it is gone."""
    store, target = _files(spark, path)
    store.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    store, target = _files(spark, path)
    return store.exists(target)


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Renames a folder; False if the new name is taken."""
    store, target = _files(spark, to)
    if store.exists(target):
        return False
    store.mkdirs(target.getParent())
    return store.rename(_files(spark, path)[1], target)
