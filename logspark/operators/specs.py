"""Source specs: YAML files that say how one kind of line is matched and mapped.

Specs are read on the driver and become column expressions; nothing interprets them per row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, functions as F

from ..functions.base import c, strip
from .extract import _java

try:
    import yaml
except ImportError:  # specs can still be given as dictionaries
    yaml = None

BONUS, CAP, BASE = 0.01, 0.06, 0.90
PACKAGED = Path(__file__).resolve().parent.parent / "specs"


@dataclass(frozen=True)
class Spec:
    id: str
    format: str = "regex"
    priority: int = 50
    match: dict | None = None
    options: dict = field(default_factory=dict)
    mapping: dict = field(default_factory=dict)
    taxonomy: dict = field(default_factory=dict)
    severity: dict = field(default_factory=dict)
    derived: tuple = ()
    constants: dict = field(default_factory=dict)

    @staticmethod
    def of(cfg: dict) -> "Spec":
        try:
            priority = int(cfg.get("priority", 50))
        except (TypeError, ValueError):
            priority = 50
        return Spec(
            id=str(cfg.get("id") or cfg.get("name") or "unnamed").strip(),
            format=str(cfg.get("format", "regex")).strip().lower(),
            priority=priority,
            match=cfg.get("match"),
            options=cfg.get("format_options") or {},
            mapping=cfg.get("mapping") or {},
            taxonomy=cfg.get("taxonomy") or {},
            severity=cfg.get("severity") or {},
            derived=tuple(cfg.get("derived") or ()),
            constants=cfg.get("constants") or {},
        )

    def lint(self) -> list[str]:
        """Settings that have no effect."""
        notes = [f"taxonomy {t}: needs src, a constant belongs under constants"
                 for t, v in self.taxonomy.items() if not (v or {}).get("src")]
        if self.severity and not self.severity.get("src"):
            notes.append("severity: needs src")
        return notes


def as_specs(configs: list[dict]) -> tuple[Spec, ...]:
    """Specs of dictionaries; an id may occur once only."""
    specs = tuple(Spec.of(x) for x in configs)
    ids = [s.id for s in specs]
    if "unnamed" in ids or len(set(ids)) != len(ids):
        raise ValueError(f"spec ids must be given and unique: {ids}")
    return specs


def load_specs(folder: str | Path = PACKAGED) -> tuple[Spec, ...]:
    """All YAML specs of a folder in name order (par_vendor_specs)."""
    if yaml is None:
        raise RuntimeError("reading YAML specs needs PyYAML; use as_specs() with dictionaries")
    return as_specs([yaml.safe_load(p.read_text()) for p in sorted(Path(folder).glob("*.yaml"))])


def spec_condition(raw: Column | str, op: str, value: str) -> Column:
    """One line predicate (flt_spec_condition); an unknown operator is false."""
    raw, value = c(raw), str(value)
    if op == "contains":
        return raw.contains(value)
    if op == "not_contains":
        return ~raw.contains(value)
    if op == "startswith":
        return strip(raw).startswith(value)
    if op == "endswith":
        return strip(raw).endswith(value)
    if op == "equals":
        return strip(raw) == value
    if op == "regex":
        try:
            return raw.rlike(_java(value)[0])
        except Exception:  # a pattern that does not compile matches nothing
            return F.lit(False)
    return F.lit(False)


def spec_score(raw: Column | str, spec: Spec) -> Column:
    """Match score of a spec: 0 or 0.90 to 0.96 (flt_spec_match)."""
    if not spec.match:
        return F.lit(BASE)
    wants_any = "any" in spec.match
    conditions = spec.match.get("any" if wants_any else "all") or []
    if not conditions:
        return F.lit(0.0)
    hits = [spec_condition(raw, *next(iter(cond.items()))) for cond in conditions]
    matched = sum((h.cast("int") for h in hits), F.lit(0))
    enough = matched > 0 if wants_any else matched == len(hits)
    return F.when(enough, F.lit(BASE) + F.least(F.lit(CAP), F.lit(BONUS) * matched)).otherwise(F.lit(0.0))
