"""Format detection as one ordered CASE over the raw line."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.base import c, let, strip

# --- fixed values: line shapes ---------------------------------------------------------------
CEF_HEAD = r"^CEF:\d+\|"
LEEF_HEAD = r"^LEEF:\d+\.\d+\|"
RFC5424_HEAD = r"^<\d{1,3}>\d\s+\S+\s+\S+"
RFC3164_HEAD = r"^(?:<\d{1,3}>)?\s*[A-Z][a-z]{2}\s+\d{1,2}\s+\d{1,2}:\d{2}:\d{2}\s"
ASA_HEAD = r"^%(?:ASA|FTD|PIX)-\d+-\d+:"
PAIR = r"""(?U)(?<![\w])([A-Za-z_][\w.\-]*)\s*=\s*(?:"[^"]*"|[^\s,;]+)"""


def is_json(line: Column) -> Column:
    """A JSON object or array."""
    return F.when(line.rlike(r"^[{\[]"), F.try_parse_json(line).isNotNull()).otherwise(F.lit(False))


def is_xml(line: Column) -> Column:
    """Well-formed XML; the corrupt-record field of the reader is the test. No name starts with a digit, so a syslog
    priority need not be read as XML."""
    parsed = F.from_xml(line, "_corrupt_record string, x string", {"mode": "PERMISSIVE"})
    return F.when(line.rlike(r"(?U)^<(?![0-9])[\w?!]"),
                  let(parsed, lambda x: x.isNotNull() & x["_corrupt_record"].isNull())).otherwise(F.lit(False))


def csv_width(row: Column, delimiter: str = ",") -> Column:
    """Number of fields of one row, separators inside double quotes not counted."""
    bare = F.regexp_replace(row, r'"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit(""))) + 1


def looks_like_csv(raw: Column | str) -> Column:
    """At least two non-empty rows of one width of two or more (det_csv_shape)."""
    raw = c(raw)
    rows = F.filter(F.split(raw, r"\r\n|\r|\n"), lambda r: F.regexp_replace(r, r'[\s,"]', "") != "")
    widths = F.array_distinct(F.transform(rows, lambda r: csv_width(r)))
    return raw.contains(",") & (F.size(rows) >= 2) & (F.size(widths) == 1) & (F.get(widths, 0) >= 2)


def detect_format(raw: Column | str) -> Column:
    """struct<format, confidence, reason> (det_format)."""
    line = strip(raw)
    pairs = F.size(F.regexp_extract_all(line, F.lit(PAIR), F.lit(0)))

    def found(fmt: str, confidence: Column | float, reason: Column | str) -> Column:
        confidence = confidence if isinstance(confidence, Column) else F.lit(confidence)
        reason = reason if isinstance(reason, Column) else F.lit(reason)
        return F.struct(F.lit(fmt).alias("format"), confidence.cast("double").alias("confidence"),
                        reason.alias("reason"))

    return (
        F.when(F.coalesce(line, F.lit("")) == "", found("empty", 0.0, "blank line"))
        .when(is_json(line), found("json", 0.95, "valid JSON document"))
        .when(line.rlike(CEF_HEAD), found("cef", 0.98, "CEF header"))
        .when(line.rlike(LEEF_HEAD), found("leef", 0.98, "LEEF header"))
        .when(line.rlike(RFC5424_HEAD), found("syslog", 0.92, "RFC5424 structured syslog"))
        .when(line.rlike(RFC3164_HEAD), found("syslog", 0.85, "RFC3164 bsd syslog"))
        .when(line.rlike(ASA_HEAD),
              found("text", 0.4, "Cisco ASA-style message (vendor parser recommended)"))
        .when(is_xml(line), found("xml", 0.9, "well-formed XML"))
        .when(pairs >= 3, found("kv", F.least(F.lit(0.9), F.lit(0.6) + pairs * 0.02),
                                F.concat(pairs.cast("string"), F.lit(" key=value pairs"))))
        .when(looks_like_csv(line), found("csv", 0.85, "consistent comma-separated columns"))
        .otherwise(found("text", 0.2, "free text"))
    )
