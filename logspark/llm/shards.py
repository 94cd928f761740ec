"""Sharding by histogram sort: exact byte counts below probed keys, then one exchange."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from ..session import materialize
from .common import map_batches

#: A key has 38 bits of the text's hash, then 24 of the document's: equal texts are neighbours, and a group of
#: equal texts too large for one shard can still be cut between its documents.
TEXT_BITS, DOC_BITS = 38, 24
GROUP = 1 << DOC_BITS
TOP = 1 << (TEXT_BITS + DOC_BITS)


def sort_key(text, doc):
    high = F.shiftright(F.xxhash64(text), 64 - TEXT_BITS).bitwiseAND((1 << TEXT_BITS) - 1)
    return F.shiftleft(high, DOC_BITS) + F.xxhash64(doc).bitwiseAND(GROUP - 1)


def histogram(slim: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows with a key below each probe, over all partitions.

    Each task sums its rows into the cells between the sorted probes, so a row per cell and task is moved; the driver
    gets one row per cell.
    """
    def make():
        def work(batch):
            cell = np.searchsorted(probes, np.asarray(batch["key"]), side="right")
            got = np.unique(cell)
            size = np.bincount(cell, np.asarray(batch["size"]).astype("f8"), len(probes) + 1)
            return {"cell": pa.array(got.astype("i4")), "bytes": pa.array(size[got].astype("i8")),
                    "rows": pa.array(np.bincount(cell, minlength=len(probes) + 1)[got].astype("i8"))}
        return work

    cells = map_batches(slim, make, "cell int, bytes long, rows long").groupBy("cell").agg(
        F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect()
    out = np.zeros((2, len(probes) + 1), "i8")
    for r in cells:
        out[:, r.cell] = r["bytes"], r["rows"]
    return tuple(np.cumsum(out, axis=1)[:, :-1])


def splitters(slim: DataFrame, n: int, pieces: int = 1, tolerance: float = 0.001, group_tolerance: float = 0.01,
              fan: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys that cut all bytes into ``n`` equal shards of ``pieces`` ranges each.

    Returns the lower keys of all ranges but the first, and the exact rows and bytes below each. Every round counts
    ``fan`` keys inside each open interval and narrows it; a splitter is done when its error is within the tolerance
    (a share of a shard; ten per cent of a range for the cuts inside a shard) or no two rows are left to part. A cut
    inside a group of equal texts moves to the group's edge if that stays within ``group_tolerance`` of a shard.
    """
    (total,), (rows,) = (x[-1:] for x in histogram(slim, np.array([TOP], "i8")))
    k = n * pieces
    targets = [total * i / k for i in range(1, k)]
    within = [tolerance * total / n if i % pieces == 0 else 0.1 * total / k for i in range(1, k)]
    low = [(0, 0, 0)] * (k - 1)
    high = [(TOP, int(total), int(rows))] * (k - 1)

    def best(i):
        return min(low[i], high[i], key=lambda x: abs(x[1] - targets[i]))

    def narrow(probes):
        size, count = histogram(slim, probes)
        for i, t in enumerate(targets):
            at = int(np.searchsorted(size, t, side="right"))
            if at and probes[at - 1] > low[i][0]:
                low[i] = (int(probes[at - 1]), int(size[at - 1]), int(count[at - 1]))
            if at < len(probes) and probes[at] < high[i][0]:
                high[i] = (int(probes[at]), int(size[at]), int(count[at]))

    probes = np.unique(np.linspace(0, TOP, max(4096, 8 * k), endpoint=False).astype("i8")[1:])
    while k > 1 and total:
        narrow(probes)
        ask = set()
        for i in range(k - 1):
            if abs(best(i)[1] - targets[i]) > within[i] and high[i][2] - low[i][2] > 1 and high[i][0] - low[i][0] > 1:
                a, b = low[i][0], high[i][0]
                ask.update(range(a + 1, b, max(1, (b - a) // fan)))
                ask.update(x for x in (a - a % GROUP, b - b % GROUP) if a < x < b)
        if not ask:
            break
        probes = np.array(sorted(ask), "i8")
    cuts = [best(i)[0] for i in range(k - 1)]
    edges = np.array(sorted({x for c in cuts for x in (c, c - c % GROUP, c - c % GROUP + GROUP)}), "i8")
    size, count = histogram(slim, edges) if len(edges) else (edges, edges)
    at = {int(key): (int(s), int(c)) for key, s, c in zip(edges, size, count)}
    chosen = []
    for i, c in enumerate(cuts):
        near = min((c - c % GROUP, c - c % GROUP + GROUP), key=lambda x: abs(at[x][0] - targets[i]))
        chosen.append(near if abs(at[near][0] - targets[i]) <= group_tolerance * total / k else c)
    chosen = sorted(chosen)
    return (np.array(chosen, "i8"), np.array([at[c][1] for c in chosen], "i8"), np.array([at[c][0] for c in chosen], "i8"))


def shard(df: DataFrame, n: int = 40, text: str = "text", doc: str = "doc_id", range_bytes: int = 256 << 20,
          **tuning) -> DataFrame:
    """Adds ``shard`` (0 to n - 1), ``slot`` (gapless from 0 in each shard) and ``shard_bytes`` (text bytes plus 16).

    The bytes of the shards are near equal. Only keys and sizes are counted while splitters are sought (a slim written
    table); the rows themselves move once, by range. A shard larger than ``range_bytes`` is several ranges, each sorted by
    its own task; as the rows below each range are known exactly, slots need no further pass.

    A null text has no bytes; null document numbers count as one number. Rows equal in text and number have one key and
    stay together, in any order. Equal texts share a shard unless they alone exceed the tolerance. An empty table gives an
    empty one. Other columns are kept; columns with the names of the added ones are replaced.
    """
    spark = df.sparkSession
    rows = df.withColumns({"shard_bytes": F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 16,
                           "_key": sort_key(F.coalesce(F.col(text), F.lit("")), F.col(doc))})
    slim = materialize(rows.select(F.col("_key").alias("key"), F.col("shard_bytes").alias("size")), "keys")
    total = slim.agg(F.sum("size").alias("n")).first().n or 0
    pieces = max(1, -(-total // (n * range_bytes)))
    cuts, below, _ = splitters(slim, n, pieces, **tuning)
    starts = spark.sparkContext.broadcast((cuts, np.concatenate([[0], below]), pieces))

    @arrow_udf("int")
    def range_of(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(starts.value[0], np.asarray(keys), side="right").astype("i4"))

    @arrow_udf("long")
    def first_slot(ranges: pa.Array) -> pa.Array:
        _, base, m = starts.value
        r = np.asarray(ranges).astype("i8")
        return pa.array(base[r] - base[r - r % m])

    order = Window.partitionBy("_range").orderBy("_key", F.col(doc))
    return (rows.withColumn("_range", range_of("_key")).repartitionById(n * pieces, F.col("_range"))
            .withColumn("_row", F.row_number().over(order))
            .withColumns({"shard": F.floor(F.col("_range") / pieces).cast("int"),
                          "slot": (first_slot("_range") + F.col("_row") - 1).cast("long")})
            .drop("_key", "_range", "_row"))
