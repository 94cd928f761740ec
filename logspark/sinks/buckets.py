"""A table in buckets of its key's hash, with a manifest: updates rewrite the buckets they touch, and nothing else.

A version of the table is a manifest that names, for each bucket, the folder that holds it. An update writes the touched
buckets to new folders and then a new manifest; readers see the old table until that is there. The manifest also holds the
ids of the batches in it, so a batch that is sent again changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import exists, move, remove
from .tables import upsert

_MANIFEST = "version bigint, bucket int, folder string, batches array<string>"
#: Batch ids that a manifest remembers.
REMEMBERED = 1000


class BucketTable:
    """Table at ``path`` with unique ``keys`` in ``buckets`` buckets; of one batch's rows with equal keys the last in ``order`` counts."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _versions(self) -> list[int]:
        if not exists(self.spark, f"{self.path}/manifest"):
            return []
        found = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/v*").select("version").distinct().collect()
        return sorted(r.version for r in found)

    def _manifest(self, version: int) -> tuple[dict[int, str], list[str]]:
        """One row a bucket: bounded by the number of buckets."""
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/v{version:010d}").collect()
        return {r.bucket: r.folder for r in rows if r.folder}, next(iter(rows)).batches if rows else []

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table as of a version, else the newest; None before the first."""
        versions = self._versions()
        if not versions:
            return None
        folders, _ = self._manifest(versions[-1] if version is None else version)
        return self._of(folders)

    def _of(self, folders: dict[int, str]) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in sorted(folders.items())]
        return self.spark.read.parquet(*paths)

    def write(self, updates: DataFrame, batch: str, update_columns: list[str] | None = None, keep: int = 2) -> dict[str, int]:
        """Inserts rows, or sets the chosen columns (all) of known keys, as ``upsert`` does, in the touched buckets.

        Returns the version, and how many buckets were read and written. All versions but the newest ``keep`` are removed,
        with the folders that only they name.
        """
        versions = self._versions()
        version = versions[-1] if versions else -1
        folders, batches = self._manifest(version) if versions else ({}, [])
        if batch in batches:
            return {"version": version, "read": 0, "written": 0}
        updates = updates.withColumn("bucket", self.bucket())
        touched = sorted(r.bucket for r in updates.select("bucket").distinct().collect())
        before = {b: folders[b] for b in touched if b in folders}
        rows = updates.drop("bucket")
        target = self._of(before) if before else rows.limit(0)
        rows = upsert(target, rows, self.keys, self.order, update_columns)
        folder = uuid.uuid4().hex
        (rows.withColumn("bucket", self.bucket()).repartition(max(1, len(touched)), "bucket").write.partitionBy("bucket")
         .parquet(f"{self.path}/data/{folder}"))
        now = folders | dict.fromkeys(touched, folder)
        named = [(version + 1, b, f, [*batches, batch][-REMEMBERED:]) for b, f in now.items()] or [(version + 1, -1, "", [*batches, batch][-REMEMBERED:])]
        aside, target = f"{self.path}/aside/{folder}", f"{self.path}/manifest/v{version + 1:010d}"
        self.spark.createDataFrame(named, _MANIFEST).coalesce(1).write.parquet(aside)
        if not move(self.spark, aside, target):
            raise RuntimeError(f"another writer made version {version + 1} first")
        self._forget([*versions, version + 1], keep)
        return {"version": version + 1, "read": len(before), "written": len(touched)}

    def _forget(self, versions: list[int], keep: int) -> None:
        kept = {f"{b}/{f}" for v in versions[-keep:] for b, f in self._manifest(v)[0].items()}
        for v in versions[:-keep]:
            for b, f in self._manifest(v)[0].items():
                if f"{b}/{f}" not in kept:
                    remove(self.spark, f"{self.path}/data/{f}/bucket={b}")
            remove(self.spark, f"{self.path}/manifest/v{v:010d}")
