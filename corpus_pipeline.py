"""Documents to token ids: toxic, poor, repeated and leaked ones go, the rest is encoded.

Each stage gets what its predecessor kept and returns the columns of documents, but for the last, which returns token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logspark.llm import bpe, decontaminate, neardup, quality, toxicity
from logspark.llm.catalog import RANKS
from logspark.llm.common import read
from logspark.session import materialize

#: Keys of rejected rows, 8 bytes each, are broadcast up to this number, else shuffled.
BROADCAST_KEYS = 2_000_000


def _without(docs: DataFrame, key: Column, rejected: DataFrame) -> DataFrame:
    """The documents whose key is not among the rejected ones; texts move only if those are too many to broadcast."""
    gone = materialize(rejected.distinct().toDF("_key"), "rejected")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    return docs.withColumn("_key", key).join(gone, "_key", "left_anti").select(docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").filter(~toxicity.held_out()))
    return toxicity.score(docs, model).filter("predicted = 0").select(docs.columns)


def poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or are outliers of their language and source, go."""
    key = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in docs.columns])
    judged = quality.judge(docs.withColumn("_row", key), keep=("_row", "lang", "source"))
    return _without(docs, key, judged.filter("NOT kept").select("_row"))


def repeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: that of the least number, then text hash; rows without number last."""
    judged = materialize(neardup.deduplicate(docs).filter("component IS NOT NULL").select("doc_id", "component", "row_key"), "judged")
    first = judged.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first"))
    best = materialize(first.select("first.row_key"), "best")
    gone = judged.select("row_key").distinct().join(best, "row_key", "left_anti")
    kept = _without(docs, neardup.row_key(), gone)
    # Rows equal in number and text have one key; of those that stay, one row of each does.
    again = materialize(judged.groupBy("row_key").agg(F.count("*").alias("n")).filter("n > 1").join(best, "row_key").select("row_key"), "again")
    n = again.count()
    if not n:
        return kept
    keys = again.toDF("_key")
    keys = F.broadcast(keys) if n <= BROADCAST_KEYS else keys
    once = kept.withColumn("_key", neardup.row_key()).join(keys, "_key", "left_semi").dropDuplicates(["_key"]).select(docs.columns)
    return _without(kept, neardup.row_key(), again).unionByName(once)


def leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any window of a benchmark item go."""
    found = decontaminate.phrase_matches(docs, read(spark, sf_dir, "benchmark"))
    return found.filter("n_hit = 0").select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (32-bit, little-endian), their number, and digests of ids and decoded bytes."""
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    done = bpe.decode(bpe.encode(docs.select("doc_id", "text"), path, pattern), path, pattern)
    return done.select("doc_id", bpe.n_ids(F.col("token_bytes")).alias("n_tokens"), "token_bytes",
                       F.sha2("token_bytes", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxic), ("quality", poor), ("near-dedup", repeated), ("decontamination", leaked), ("encoding", encoded)]

#: The trained toxicity score and the outlier estimates have no SQL; tests hold the pipeline against its stages' plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's result is written and read again, as a table of its own."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
