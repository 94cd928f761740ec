"""Dotted paths into nested columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .base import c, lit_map


def get_path(col: Column | str, dotted: str, default=None) -> Column:
    """Value at a dotted path, or a default (scl_get_set_path)."""
    out = c(col)
    for part in dotted.split("."):
        out = out.getField(part)
    return out if default is None else F.coalesce(out, F.lit(default))


def set_path(col: Column | str, dotted: str, value: Column) -> Column:
    """Set a dotted path; a NULL value leaves the field alone."""
    return c(col).withField(dotted, F.coalesce(value, get_path(col, dotted)))


def leaves(dtype: T.DataType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """All (dotted path, type) leaves of a struct type in schema order."""
    out: list[tuple[str, T.DataType]] = []
    for field in dtype.fields:
        path = f"{prefix}.{field.name}" if prefix else field.name
        if isinstance(field.dataType, T.StructType):
            out += leaves(field.dataType, path)
        else:
            out.append((path, field.dataType))
    return out


def as_text(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(col)
    if isinstance(dtype, T.TimestampType):
        return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return col.cast("string")


def leaf_pairs(df: DataFrame, col: str) -> Column:
    """array<struct<key, value>> of the non-NULL leaves of a struct column; lists stay one value."""
    pairs = [
        F.struct(F.lit(path).alias("key"), as_text(get_path(col, path), dtype).alias("value"))
        for path, dtype in leaves(df.schema[col].dataType)
    ]
    return F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())


def flatten_pairs(df: DataFrame, col: str, *keep: str) -> DataFrame:
    """One row per (dotted key, value) of a nested column (prj_flatten)."""
    return (df.select(*keep, F.explode(leaf_pairs(df, col)).alias("p"))
            .select(*keep, F.col("p.key").alias("key"), F.col("p.value").alias("value")))


def field_by_suffix(df: DataFrame, names: list[str], col: str = "ues") -> Column:
    """First non-NULL leaf whose name ends with one of the names, any case (prj_field_suffix).

    The names are known, so the leaves are chosen while the plan is built.
    """
    wanted = [n.lower() for n in names]
    hits = [
        as_text(get_path(col, path), dtype)
        for path, dtype in leaves(df.schema[col].dataType)
        if any(path.lower().endswith(w) for w in wanted)
    ]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


__all__ = ["get_path", "set_path", "leaves", "leaf_pairs", "flatten_pairs", "field_by_suffix",
           "as_text", "lit_map"]
