"""Set operations and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def union_alerts(a: DataFrame, b: DataFrame) -> DataFrame:
    """set_union_alerts"""
    return a.unionByName(b, allowMissingColumns=True)


def dedup(df: DataFrame, key: str, history: DataFrame | None = None) -> DataFrame:
    """One row per key, none that the history holds already (set_dedup_trace)."""
    if history is not None:
        df = df.join(history.select(key).distinct(), key, "left_anti")
    return df.dropDuplicates([key])


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """First row per non-empty key; rows without a key all stay (set_dedup_event).

    The aggregate keeps one position per key and combines on the map side, so copies of one key
    never meet in one task as whole rows. Of rows equal in key and order any one stays.
    """
    has = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
    first = df.filter(has).groupBy(key).agg(F.min(order).alias(order))
    return (df.filter(has).join(first, [key, order], "left_semi").dropDuplicates([key])
            .unionByName(df.filter(~has)))


def claim_receipts(items: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items claimed now, ledger with their receipts) for (agent_id, fingerprint)
    (set_dedup_receipt)."""
    keys = ["agent_id", "fingerprint"]
    new = items.join(ledger.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)
    return new, ledger.select(*keys).unionByName(new.select(*keys))
