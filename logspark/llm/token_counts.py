"""Token counts by a two-tier lookup on the map side."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from . import pieces
from .common import bounded_batches, map_batches, text_of


def frequent_pieces(df: DataFrame, path: str, text: str = "text", entries: int = 65_536,
                    sample_docs: int = 4_000) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens, at most ``entries``.

    It is counted on about ``sample_docs`` documents drawn by a hash of the text. The table decides only how fast
    a length is found, never which: what it lacks is encoded. Its size is bounded by ``entries``.
    """
    rows = df.count()
    if not rows:
        return {}
    share = min(1.0, sample_docs / rows)
    some = df.select(text_of(text).alias("t")).filter(
        F.shiftrightunsigned(F.xxhash64("t"), 11) / F.lit(float(1 << 53)) < F.lit(share))

    def make():
        from collections import Counter

        split = pieces.SPLIT.findall

        def work(batch):
            seen = Counter()
            for t in batch["t"].to_pylist():
                seen.update(split(t))
            return {"piece": list(seen), "n": list(seen.values())}
        return work

    top = (map_batches(some, make, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
           .filter("n > 1 and length(piece) <= 64").orderBy(F.desc("n"), "piece").limit(entries))
    found = [r.piece for r in top.collect()]
    return dict(zip(found, pieces.Counter(path, {}).encode(found)))


def count_tokens(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens", entries: int = 65_536) -> DataFrame:
    """Adds the number of tokens of each text, as the tokenizers library counts them without added special tokens.

    Tier one is a broadcast table of frequent pre-token lengths, at most ``entries``; tier two a bounded cache in each
    worker that encodes what the table lacks. The main path has no exchange. A null text counts as empty (0 tokens);
    a special token's string inside a text is that one token; texts of any length are counted whole. Repeated rows
    are counted each, an empty table gives none, a column already named ``out`` is replaced.
    """
    spark = df.sparkSession
    table = spark.sparkContext.broadcast(frequent_pieces(df, path, text, entries))
    tag = uuid.uuid4().hex

    @arrow_udf("long")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = pieces.counter(path, tag, lambda: table.value)
        for texts in batches:
            yield pa.array(list(counter.encode(texts.to_pylist())), pa.int64())

    return bounded_batches(df).withColumn(out, lengths(text_of(text)))
