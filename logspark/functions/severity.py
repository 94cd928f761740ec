"""The three severity scales. They are different on purpose and never mixed."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .base import c, let_sql, lookup, sql_text, strip
from .tables import PRI_LABELS, SEVERITY_ALIAS, SEVERITY_NUMBER, STORE_SEVERITY


def severity_num(col: Column | str) -> Column:
    """Label of a number: 0-10 is the short scale, above that the 0-100 scale (scl_severity_num)."""
    n = c(col)
    return (
        F.when(n.isNull(), None)
        .when(n <= 3, "info").when(n <= 5, "low").when(n <= 7, "medium")
        .when(n <= 9, "high").when(n <= 10, "critical")
        .when(n >= 85, "critical").when(n >= 65, "high").when(n >= 45, "medium")
        .when(n >= 20, "low").otherwise("info")
    )


def _sql_map(table: dict) -> str:
    return "map(" + ", ".join(f"{sql_text(k)}, {sql_text(v)}" for k, v in table.items()) + ")"


_STEPS = [(3, "info"), (5, "low"), (7, "medium"), (9, "high"), (10, "critical"), (19, "info"), (44, "low"),
          (64, "medium"), (84, "high"), (100, "critical")]
_OF_NUMBER = "CASE " + " ".join(f"WHEN n <= {top} THEN '{name}'" for top, name in _STEPS) + " END"
_NAMED = f"coalesce(try_element_at({_sql_map(SEVERITY_ALIAS)}, t), t)"
_UES = (
    "t -> CASE WHEN t RLIKE '^[0-9]+$' THEN transform(array(cast(least(try_cast(t AS double), 100.0D) AS int)), "
    f"n -> named_struct('label', {_OF_NUMBER}, 'number', n))[0] "
    f"ELSE transform(array(try_element_at({_sql_map(SEVERITY_NUMBER)}, {_NAMED})), "
    f"n -> named_struct('label', CASE WHEN n IS NOT NULL THEN {_NAMED} END, 'number', n))[0] END"
)


def severity_ues(col: Column | str) -> Column:
    """struct<label, number> of any severity-like text, both NULL if unknown (scl_severity_ues)."""
    return let_sql(F.lower(strip(c(col).cast("string"))), _UES)


def severity_store(col: Column | str) -> Column:
    """0-100 number on the storage scale (scl_severity_store)."""
    text = F.lower(strip(c(col).cast("string")))
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), text.try_cast("double"))
    # least() and greatest() skip NULL, so text that is no number must not reach them.
    clamped = F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), number)).cast("int"))
    return F.coalesce(lookup(STORE_SEVERITY, text), clamped, F.lit(0))


def severity_store_label(number: Column | str) -> Column:
    n = c(number)
    return (F.when(n >= 90, "critical").when(n >= 70, "high").when(n >= 40, "medium")
            .when(n > 0, "low").otherwise("info"))


def severity_risk(col: Column | str) -> Column:
    """Label of a case risk score (scl_severity_risk)."""
    n = c(col)
    return (F.when(n >= 95, "critical").when(n >= 80, "high").when(n >= 60, "medium")
            .otherwise("low"))


def pri_label(pri: Column | str) -> Column:
    """Syslog priority 0..191 to its severity word."""
    p = c(pri)
    words = F.array(*[F.lit(x) for x in PRI_LABELS])
    return F.when((p >= 0) & (p < 192), F.get(words, p % 8))
