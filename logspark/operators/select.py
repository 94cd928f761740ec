"""Choosing the parser of a line, and the one-level chain for payloads inside syslog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.base import built, let, strip
from . import attributes as A
from .detect import CEF_HEAD, LEEF_HEAD, detect_format, is_json, is_xml
from .extract import (
    DELIMITERS, EXTRACTORS, IS_3164, IS_5424, PARSED, kv_count, regex_patterns, safe,
)
from .extract import _count
from .specs import BONUS, Spec, spec_score

# --- fixed values: priority of the built-in parsers, in order of registration -----------------
PRIORITY = {"syslog": 10, "json": 15, "cef": 20, "leef": 20, "kv": 30, "csv": 5, "xml": 12}
THRESHOLD = 0.5
FORMAT_NAME = {"plain": "text"}


def format_score(fmt: str, raw: Column, options: dict | None = None, line: Column | None = None,
                 pairs: Column | None = None) -> Column:
    """Confidence of one format for a line, 0 if it does not apply.

    ``line`` (the stripped text) and ``pairs`` (its plain ``kv_count``) are given where they are known already.
    """
    line = strip(raw) if line is None else line
    zero = F.lit(0.0)
    if fmt == "syslog":
        return F.when(line.rlike(IS_5424), 0.95).when(line.rlike(IS_3164), 0.9).otherwise(zero)
    if fmt == "json":
        return F.when(is_json(line), 0.95).otherwise(zero)
    if fmt == "cef":
        return F.when(line.rlike(CEF_HEAD) & line.rlike(r"(?s)^CEF:\d+\|(?:[^|]*\|){5}"), 0.98).otherwise(zero)
    if fmt == "leef":
        return F.when(line.rlike(LEEF_HEAD) & line.rlike(r"(?s)^LEEF:\d+\.\d+\|(?:[^|]*\|){4}"),
                      0.98).otherwise(zero)
    if fmt == "xml":
        return F.when(is_xml(line), 0.9).otherwise(zero)
    if fmt == "kv":
        counted = kv_count(raw, options) if pairs is None or (options or {}).get("pattern") else pairs
        return let(counted, lambda n: F.when(n >= 2, F.least(F.lit(0.9), F.lit(0.5) + n * 0.05)).otherwise(zero))
    if fmt == "csv":
        given = (options or {}).get("delimiter")
        # Without a given one the most frequent delimiter counts.
        n = _count(raw, given) if given else F.greatest(*[_count(raw, d) for d in DELIMITERS])
        return F.when(n >= 2, 0.5).otherwise(zero)
    if fmt == "regex":
        hit = F.lit(False)
        for pattern, _ in regex_patterns(options):
            hit = hit | raw.rlike(pattern)
        return F.when(hit, 0.8).otherwise(zero)
    return F.when(line != "", 0.1).otherwise(zero)


def choose(raw: Column, specs: tuple[Spec, ...], exclude: tuple[str, ...] = ()) -> Column:
    """struct<score, priority, ord, parser, spec> of the best candidate, NULL below the threshold.

    Highest (score, priority) wins and the first registered one among equals. What several candidates look at is
    bound once; without that each use would repeat the search for pairs.
    """
    def candidate(score: Column, priority: int, order: int, parser: str, spec: str | None) -> Column:
        return F.struct(
            score.cast("double").alias("score"), F.lit(priority).alias("priority"),
            F.lit(-order).alias("ord"), F.lit(parser).alias("parser"),
            F.lit(spec).cast("string").alias("spec"))

    def of_spec(s: Spec, line: Column, pairs: Column) -> Column:
        return let(spec_score(raw, s), lambda cond: F.when(cond > 0, F.greatest(
            format_score(s.format, raw, s.options, line, pairs) + BONUS, cond)).otherwise(F.lit(0.0)))

    def best(line: Column, pairs: Column) -> Column:
        rows = [candidate(format_score(f, raw, None, line, pairs), p, i, f, None)
                for i, (f, p) in enumerate(PRIORITY.items()) if f not in exclude]
        rows += [candidate(of_spec(s, line, pairs), s.priority, i, s.format, s.id)
                 for i, s in enumerate(specs, start=len(PRIORITY)) if s.format not in exclude]
        return F.array_max(F.array(*rows))

    seen = F.struct(strip(raw).alias("line"), kv_count(raw).alias("pairs"))
    return let(let(seen, lambda x: best(x["line"], x["pairs"])), lambda b: F.when(b["score"] >= THRESHOLD, b))


def select_parser(df: DataFrame, specs: tuple[Spec, ...] = (), col: str = "raw") -> DataFrame:
    """Adds ``pick`` (par_select)."""
    return df.withColumn("pick", built(("choose", col, repr(specs)), lambda: choose(F.col(col), specs)))


def fallback_parser(df: DataFrame, col: str = "raw") -> DataFrame:
    """Where nothing was picked: the detected format decides, free text goes to plain (par_fallback)."""
    det = built(("detect", col), lambda: F.when(F.col("pick").isNull(), detect_format(F.col(col))))
    return df.withColumn("detection", det).withColumn(
        "parser",
        F.coalesce(F.col("pick.parser"),
                   F.when(F.col("detection.format").isin(list(PRIORITY)), F.col("detection.format")),
                   F.lit("plain")))


def extract_with(raw: Column, parser: Column, spec: Column, specs: tuple[Spec, ...],
                 formats: tuple[str, ...] = tuple(EXTRACTORS)) -> Column:
    """The parsed struct of the chosen parser; only that branch runs for a row."""
    out = F.when(raw.isNull(), F.lit(None).cast(PARSED))
    for s in specs:
        if s.format in EXTRACTORS and s.format in formats:
            out = out.when(spec == s.id, EXTRACTORS[s.format](raw, s.options))
    for fmt in formats:
        if fmt in ("text", "regex", "plain"):
            continue
        out = out.when(parser == fmt, EXTRACTORS[fmt](raw))
    return safe(out.otherwise(EXTRACTORS["plain"](raw)), raw)


def _merge(outer: str, inner: str) -> Column:
    """Inner attributes, message and hints win; time, host and priority fill gaps only."""
    o, i = F.col(outer), F.col(inner)
    fields = [A.dedup(F.concat(o["attrs"], i["attrs"])).alias("attrs"),
              F.coalesce(F.when(i["message"] != "", i["message"]), o["message"]).alias("message")]
    fields += [F.coalesce(o[f], i[f]).alias(f) for f in ("event_time_raw", "host", "pri")]
    fields += [F.coalesce(i[f], o[f]).alias(f)
               for f in ("vendor", "product", "severity_raw", "service")]
    fields += [o["sub_raw"].alias("sub_raw"),
               F.concat(o["warnings"], i["warnings"]).alias("warnings")]
    return F.struct(*fields).cast(PARSED)


def parse_chain(df: DataFrame, specs: tuple[Spec, ...] = (), col: str = "raw") -> DataFrame:
    """Adds parsed, parser, spec, detection and parser_chain (par_chain).

    A syslog body is parsed once more; syslog itself is left out of that second choice.
    """
    df = fallback_parser(select_parser(df, specs, col), col)
    key = (col, repr(specs))
    df = df.withColumn("_outer", built(("outer", *key), lambda: extract_with(
        F.col(col), F.col("parser"), F.col("pick.spec"), specs)))
    # Only the syslog envelope has a body. It is taken without the extraction of the other formats, so that a query which
    # reads no field of theirs has no need of it.
    body = built(("body", col), lambda: F.when(F.col("parser") == "syslog", EXTRACTORS["syslog"](F.col(col))["sub_raw"]))
    df = df.withColumn("_sub", F.when(strip(body) != "", body))
    df = df.withColumn("_pick2", built(("pick2", *key), lambda: F.when(
        F.col("_sub").isNotNull(), choose(F.col("_sub"), specs, ("syslog",)))))
    # An unpicked body falls back by its format; the built-in CSV case needs two lines and
    # everything else that has no pick is free text.
    df = df.withColumn("_det2", built(("detect2",), lambda: F.when(
        F.col("_sub").isNotNull() & F.col("_pick2").isNull(), detect_format(F.col("_sub"))["format"])))
    df = df.withColumn("_parser2", F.when(F.col("_sub").isNotNull(), F.coalesce(
        F.col("_pick2.parser"),
        F.when(F.col("_det2").isin([f for f in PRIORITY if f != "syslog"]), F.col("_det2")),
        F.lit("plain"))))
    inner_formats = tuple(f for f in EXTRACTORS if f != "syslog")
    df = df.withColumn("_inner", built(("inner", *key), lambda: F.when(
        F.col("_sub").isNotNull(), extract_with(
            F.col("_sub"), F.col("_parser2"), F.col("_pick2.spec"), specs, inner_formats))))
    useful = F.col("_inner").isNotNull() & (
        (F.size(F.col("_inner.attrs")) > 0) | (F.coalesce(F.col("_inner.message"), F.lit("")) != ""))
    return (
        df.withColumn("parsed", F.when(useful, _merge("_outer", "_inner")).otherwise(F.col("_outer")))
        .withColumn("spec", F.coalesce(F.when(useful, F.col("_pick2.spec")), F.col("pick.spec")))
        .withColumn("parser_chain", F.when(useful, F.array(F.col("_parser2"))))
        .drop("pick", "_outer", "_sub", "_pick2", "_det2", "_parser2", "_inner")
    )
