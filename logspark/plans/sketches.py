"""Mergeable summaries per hour and group: stored once, merged for any range of time.

Distinct sources (HyperLogLog), distinct users (theta, so that ranges can also be intersected) and sizes (KLL quantiles) are
binary sketches of bounded size, so a question about a month reads a row an hour and group and no event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: log2 of HyperLogLog's registers (relative error about 1.04 / sqrt(2^12) = 1.6 %) and of theta's entries (about 1.6 %), and
#: KLL's k (rank error about 1.3 %).
HLL_BITS, THETA_BITS, KLL_K = 12, 12, 200


def hourly(events: DataFrame, group: Column, name: str = "grp") -> DataFrame:
    """(hour, name, n, sources, users, sizes): a row for each hour and group that has events; a null group is one."""
    size = F.col("ues.network.bytes_out").cast("bigint")
    return events.groupBy(F.date_trunc("hour", "ues.event_time").alias("hour"), group.alias(name)).agg(
        F.count("*").alias("n"), F.hll_sketch_agg("ues.source.ip", HLL_BITS).alias("sources"),
        F.theta_sketch_agg("ues.user.name", THETA_BITS).alias("users"), F.kll_sketch_agg_bigint(size, KLL_K).alias("sizes"))


def merged(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """The summaries of all rows of a key as one; the result can be merged again."""
    return summaries.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.hll_union_agg("sources").alias("sources"), F.theta_union_agg("users", THETA_BITS).alias("users"),
        F.kll_merge_agg_bigint("sizes").alias("sizes"))


def estimates(summaries: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Numbers in place of sketches: n, sources, users, and a column for each quantile of sizes (p50, p95)."""
    others = [c for c in summaries.columns if c not in ("n", "sources", "users", "sizes")]
    return summaries.select(
        *others, "n", F.hll_sketch_estimate("sources").alias("sources"), F.theta_sketch_estimate("users").alias("users"),
        *[F.kll_sketch_get_quantile_bigint("sizes", F.lit(q)).alias(f"p{round(100 * q)}") for q in quantiles])


def returning(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Users that two summaries of a key share, estimated from their sketches."""
    a, b = before.select(*keys, F.col("users").alias("_a")), after.select(*keys, F.col("users").alias("_b"))
    return a.join(b, keys).select(*keys, F.theta_sketch_estimate(F.theta_intersection("_a", "_b")).alias("returning"))
