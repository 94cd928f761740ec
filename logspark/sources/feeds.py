"""Dimension feeds: IP ranges and threat indicators."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.base import present, strip
from ..functions.ip import ip_canonical, ip_v4_num, ip_v6_hex


def _rows(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """CSV rows with a header of any case; missing trailing fields are NULL."""
    schema = ", ".join(f"{n} string" for n in names)
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path)
    head = F.lower(strip(F.col(names[0])))
    return df.filter(F.col(names[0]).isNotNull() & ~head.isin(names[0], f"#{names[0]}"))


def load_geo(spark: SparkSession, path: str) -> DataFrame:
    """IP ranges: start, end (text), country, city and numeric bounds (src_geo_dim).

    Rows whose bounds are no addresses are skipped.
    """
    return geo_ranges(_rows(spark, path, ["start", "end", "country", "city"]))


def geo_ranges(df: DataFrame) -> DataFrame:
    """Numeric bounds for a table with start, end, country, city."""
    start, end = strip(F.col("start")), strip(F.col("end"))
    out = df.select(
        ip_canonical(start).alias("start"), ip_canonical(end).alias("end"),
        strip(F.col("country")).alias("country"), F.coalesce(strip(F.col("city")), F.lit("")).alias("city"))
    return (out.filter("start IS NOT NULL AND end IS NOT NULL AND country IS NOT NULL")
            .withColumns({"lo": ip_v4_num("start"), "hi": ip_v4_num("end"),
                          "lo6": ip_v6_hex("start"), "hi6": ip_v6_hex("end")}))


def load_threat(spark: SparkSession, path: str) -> DataFrame:
    """Indicators with defaults, kind (ip, domain, string) and feed order (src_threat_dim)."""
    df = _rows(spark, path, ["indicator", "type", "severity", "source"])
    df = df.withColumn("ord", F.monotonically_increasing_id())
    return threat_indicators(df, default_feed=Path(path).name)


def threat_indicators(df: DataFrame, default_feed: str = "feed") -> DataFrame:
    """Classifies a table with indicator, type, severity, source, ord.

    Only a leading dot makes a domain. A repeated indicator keeps its first place and takes its
    last values.
    """
    text = strip(F.col("indicator"))
    kind = F.when(ip_canonical(text).isNotNull(), "ip").when(text.startswith("."), "domain").otherwise("string")
    named = df.filter(text != "").select(
        F.when(kind == "ip", text).otherwise(F.lower(text)).alias("indicator"), kind.alias("kind"),
        F.struct(F.coalesce(F.lower(strip(F.col("type"))), F.lit("unknown")).alias("type"),
                 F.coalesce(F.lower(strip(F.col("severity"))), F.lit("medium")).alias("severity"),
                 F.coalesce(present(strip(F.col("source"))), F.lit(default_feed)).alias("feed")).alias("m"),
        F.col("ord"))
    return (named.groupBy("indicator", "kind")
            .agg(F.min("ord").alias("ord"), F.max_by("m", "ord").alias("m"))
            .select("indicator", "kind", "m.type", "m.severity", "m.feed", "ord"))
