"""Timestamp parsing and rendering.

Every accepted shape is rewritten to one ISO-8601 text with a zone, so a single ``try_cast``
does the work; no formatter is tried and rejected per row.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .base import c, let_sql, sql_text, strip

_MONTHS = {m: f"{i:02d}" for i, m in enumerate(
    "jan feb mar apr may jun jul aug sep oct nov dec".split(), start=1)}
_MONTH_MAP = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in _MONTHS.items()) + ")"

_DAY = r"\d{4}-\d{2}-\d{2}"
_CLOCK = r"\d{2}:\d{2}:\d{2}"


def _month(i: int) -> str:
    return f"try_element_at({_MONTH_MAP}, lower(p[{i}]))"


def _stamp(year: str, month: str, day: str, clock: int) -> str:
    """ISO text from pieces of the split ``p``."""
    return (f"concat({year}, '-', {month}, '-', lpad({day}, 2, '0'), 'T', lpad(p[{clock}], 2, '0'), ':', "
            f"p[{clock + 1}], ':', p[{clock + 2}])")


def _shapes(year: str) -> list[tuple[str, str]]:
    """(pattern, ISO-8601 text with zone) of every accepted shape; ``s`` is the text, ``p`` its pieces."""
    name = "[A-Za-z]{3}"
    return [
        (rf"{_DAY}[Tt ]{_CLOCK}([.,]\d{{1,9}})?", "concat(replace(s, ',', '.'), 'Z')"),
        (rf"{_DAY}[Tt ]{_CLOCK}([.,]\d{{1,9}})? ?(Z|[+-]\d{{2}}:?\d{{2}})", "replace(s, ',', '.')"),
        (_DAY, "concat(s, 'T00:00:00Z')"),
        (rf"{_DAY}[Tt ]\d{{2}}:\d{{2}}", "concat(s, ':00Z')"),
        (rf"\d{{4}}/\d{{2}}/\d{{2}} {_CLOCK}", "concat(replace(s, '/', '-'), 'Z')"),
        (rf"\d{{1,2}}/{name}/\d{{4}}:{_CLOCK} [+-]\d{{4}}",
         f"concat({_stamp('p[2]', _month(1), 'p[0]', 3)}, right(s, 5))"),
        (rf"{name} \d{{1,2}} \d{{4}} \d{{1,2}}:\d{{2}}:\d{{2}}",
         f"concat({_stamp('p[2]', _month(0), 'p[1]', 3)}, 'Z')"),
        (rf"{name} \d{{1,2}} \d{{4}} \d{{1,2}}:\d{{2}}:\d{{2}}:\d{{1,6}}",
         f"concat({_stamp('p[2]', _month(0), 'p[1]', 3)}, '.', p[6], 'Z')"),
        (rf"{name} \d{{1,2}} \d{{1,2}}:\d{{2}}:\d{{2}}",
         f"concat({_stamp(year, _month(0), 'p[1]', 2)}, 'Z')"),
        (rf"{name} {name} \d{{1,2}} {_CLOCK} \d{{4}}",
         f"concat({_stamp('p[6]', _month(1), 'p[2]', 3)}, 'Z')"),
        (r"\d{14}", "concat(substr(s, 1, 4), '-', substr(s, 5, 2), '-', substr(s, 7, 2), 'T', "
                    "substr(s, 9, 2), ':', substr(s, 11, 2), ':', substr(s, 13, 2), 'Z')"),
        (r"\d{8}(T\d{6}Z?)?", "concat(substr(s, 1, 4), '-', substr(s, 5, 2), '-', substr(s, 7, 2), 'T', "
                              "coalesce(nullif(substr(s, 10, 2), ''), '00'), ':', "
                              "coalesce(nullif(substr(s, 12, 2), ''), '00'), ':', "
                              "coalesce(nullif(substr(s, 14, 2), ''), '00'), 'Z')"),
        (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}",
         f"concat({_stamp('p[2]', 'lpad(p[0], 2, chr(48))', 'p[1]', 3)}, 'Z')"),
        (r"\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{2}:\d{2}",
         f"concat({_stamp('p[2]', 'lpad(p[1], 2, chr(48))', 'p[0]', 3)}, 'Z')"),
    ]


# Epoch text: digits -> factor to microseconds.
_EPOCH = [(r"\d{9,10}(\.\d+)?", "1000000"), (r"\d{13}(\.\d+)?", "1000"), (r"\d{16}", "1"), (r"\d{19}", "0.001")]


def _matches(pattern: str) -> str:
    return f"s RLIKE {sql_text('^' + pattern + '$')}"


def _body(year: str) -> str:
    epoch = " ".join(
        f"WHEN {_matches(p)} THEN timestamp_micros(try_cast(try_cast(s AS decimal(38,9)) * {k} AS bigint))"
        for p, k in _EPOCH)
    iso = " ".join(f"WHEN {_matches(p)} THEN {v}" for p, v in _shapes(year))
    split = "transform(array(split(s, '[ /:\\\\-]')), p -> CASE " + iso + " END)[0]"
    return f"s -> CASE {epoch} WHEN s RLIKE '[0-9]' THEN try_cast({split} AS timestamp) END"


def parse_ts(col: Column | str, year: int | None = None) -> Column:
    """Log timestamp text to TIMESTAMP; garbage gives NULL (scl_parse_ts).

    ``year`` completes syslog times that carry none; without it the current year is taken.
    """
    y = "cast(year(current_timestamp()) AS string)" if year is None else sql_text(str(year))
    s = F.regexp_replace(strip(c(col).cast("string")), r"\s+", " ")
    return let_sql(s, _body(y))


def iso_ms(col: Column | str) -> Column:
    """ISO-8601 UTC text with milliseconds and a Z (scl_iso_ms)."""
    return F.date_format(c(col), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def epoch_ms(col: Column | str) -> Column:
    return F.unix_millis(c(col))


def ms_precision(col: Column | str) -> Column:
    """Cut a timestamp to milliseconds, the precision of the event schema."""
    return F.timestamp_millis(F.unix_millis(c(col)))


def time_display(col: Column | str, full: bool = False) -> Column:
    """``HH:MM:SS UTC``, or the full form with the date (scl_time_display)."""
    fmt = "yyyy-MM-dd HH:mm:ss 'UTC'" if full else "HH:mm:ss 'UTC'"
    return F.coalesce(F.date_format(c(col), fmt), F.lit("—"))
