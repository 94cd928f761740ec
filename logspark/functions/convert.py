"""Typed conversion of extracted text, and the smaller scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .base import c, lookup, strip
from .ip import ip_canonical
from .severity import severity_ues
from .tables import ACTION_SYNONYMS, CLASSIFIER_ACTIONS, PROTOCOLS
from .timestamps import parse_ts

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _double(s: Column) -> Column:
    return F.when(s.rlike(_NUMBER), s.try_cast("double"))


def _int(s: Column) -> Column:
    """Whole numbers as they are, decimal text cut at the point."""
    return F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("bigint")).when(
        s.contains("."), _double(s).try_cast("bigint"))


def proto(col: Column | str) -> Column:
    """Protocol number to name, otherwise lower case (scl_proto)."""
    s = F.lower(strip(c(col).cast("string")))
    plain = F.regexp_replace(s, r"^0+(?=\d)", "")
    return F.when(s.rlike(r"^\d+$"), F.coalesce(lookup(PROTOCOLS, plain), s)).otherwise(s)


def action(col: Column | str) -> Column:
    """Action synonym, otherwise lower case (scl_action)."""
    s = F.lower(strip(c(col).cast("string")))
    return F.coalesce(lookup(ACTION_SYNONYMS, s), s)


def classifier_action(col: Column | str) -> Column:
    """The shorter synonym table of the classifier."""
    s = F.lower(c(col))
    return F.coalesce(lookup(CLASSIFIER_ACTIONS, s), s)


def value_map(col: Column, table: dict) -> Column:
    """Exact key, else lower-case key, else the value itself."""
    table = {str(k): str(v) for k, v in table.items()}
    return F.coalesce(lookup(table, col), lookup(table, F.lower(col)), col)


TYPE_OF = {
    "int": "bigint", "port": "bigint", "bytes": "bigint", "int_or_none": "bigint",
    "float": "double", "duration": "double", "bool": "boolean",
    "epoch": "timestamp", "timestamp": "timestamp", "ts": "timestamp", "datetime": "timestamp",
}


def convert(col: Column | str, ctype: str | None, table: dict | None = None,
            year: int | Column | None = None) -> Column:
    """Text to the named type, NULL where it cannot be converted (scl_convert)."""
    col = c(col)
    s = strip(col.cast("string"))
    if ctype in (None, "", "str"):
        return col.cast("string")
    if ctype in ("int", "port"):
        return _int(s)
    if ctype in ("float", "duration"):
        return _double(s)
    if ctype == "bool":
        return F.lower(s).isin("true", "yes", "1", "on", "enabled")
    if ctype == "ip":
        return ip_canonical(s)
    if ctype == "proto":
        return proto(s)
    if ctype in ("epoch", "timestamp", "ts", "datetime"):
        return parse_ts(s, year)
    if ctype == "bytes":
        return _double(s).try_cast("bigint")
    if ctype == "lower":
        return F.lower(s)
    if ctype == "upper":
        return F.upper(s)
    if ctype == "action":
        return action(s)
    if ctype == "loglevel":
        return severity_ues(s)["label"]
    if ctype == "map":
        return value_map(s, table or {})
    if ctype == "int_or_none":
        return F.when(s.rlike(r"^\d+$"), s.try_cast("bigint"))
    return s


def parse_size(col: Column | str) -> Column:
    """``10MB`` or ``512K`` to bytes, 1024 based (scl_size)."""
    s = F.upper(F.replace(strip(c(col).cast("string")), F.lit(" "), F.lit("")))
    shape = r"^([\d.]+)([KMGT]?)I?B?$"
    unit = F.regexp_extract(s, shape, 2)
    factor = (F.when(unit == "K", 1024.0).when(unit == "M", 1024.0 ** 2)
              .when(unit == "G", 1024.0 ** 3).when(unit == "T", 1024.0 ** 4).otherwise(1.0))
    return F.when(s.rlike(shape), (_double(F.regexp_extract(s, shape, 1)) * factor).try_cast("bigint"))


def base64_like(col: Column | str) -> Column:
    """Looks like base64: alphabet, padding, length a multiple of four (scl_base64_like)."""
    s = c(col)
    return F.coalesce(
        (F.length(s) >= 4) & (F.length(s) % 4 == 0) & s.rlike(r"^[A-Za-z0-9+/]*={0,2}\z"), F.lit(False))


def url_host(col: Column | str) -> Column:
    """Host of an absolute URL, NULL if the text has no ``://`` (scl_url_host)."""
    s = c(col).cast("string")
    return F.when(s.contains("://"), F.regexp_replace(s, r"(?i)^[a-z]+://([^/:]+).*$", "$1"))


def guess_type(col: Column | str) -> Column:
    """ip, int, float, timestamp or str (scl_guess_type)."""
    s = c(col).cast("string")
    return (
        F.when(s.rlike(r"^[\d.]+$") & ip_canonical(s).isNotNull(), "ip")
        .when(s.rlike(r"^\d+$"), "int")
        .when(_double(strip(s)).isNotNull(), "float")
        .when(parse_ts(s).isNotNull(), "timestamp")
        .otherwise("str")
    )
