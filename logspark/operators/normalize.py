"""Parsed lines to universal events.

Every field of the event is one ``coalesce`` over the stages that may set it, latest first:
constants, derived rules, severity, taxonomy and mapping of the spec, then the parser envelope,
key inference and defaults.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.base import built, group, let, lit_map, present, strip
from ..functions.convert import TYPE_OF, convert, value_map
from ..functions.paths import as_text
from ..functions.severity import pri_label, severity_ues
from ..functions.tables import INFERENCE, SEVERITY_NUMBER
from ..functions.timestamps import epoch_ms, iso_ms, ms_precision, parse_ts
from ..schema import LINEAGE_STRUCT, META, SCHEMA_VERSION, TRACE, UES, UES_LEAVES, build
from . import attributes as A
from .extract import _java
from .select import FORMAT_NAME, parse_chain
from .specs import Spec

SOURCE_COLUMNS = {
    "source_type": "string", "address": "string", "transport": "string", "raw_offset": "bigint",
    "received_time": "timestamp", "line_no": "bigint", "first_line": "bigint", "agent_id": "string",
    "agent_fingerprint": "string",
}
# One of these must tell lines of the same text apart.
POSITIONS = ("raw_offset", "line_no", "agent_fingerprint")
INFER_CONFIDENCE = 0.78


def with_source_columns(df: DataFrame) -> DataFrame:
    """Adds the source metadata columns that are missing as NULL."""
    missing = {n: F.lit(None).cast(t) for n, t in SOURCE_COLUMNS.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df


def with_integrity(df: DataFrame) -> DataFrame:
    """SHA-256 and byte length of the raw line, and a trace id that a replay repeats
    (nrm_integrity)."""
    spot = F.concat_ws("@", F.coalesce(F.col("raw_offset"), F.col("line_no")).cast("string"), F.col("first_line").cast("string"))
    place = F.concat_ws("|", *[F.coalesce(x, F.lit("")) for x in (
        F.col("source_type"), F.col("address"), spot, F.col("agent_fingerprint"))])
    return df.withColumns({
        "raw_hash": F.sha2(F.col("raw"), 256),
        "raw_size": F.octet_length(F.col("raw")).cast("bigint"),
        "algorithm": F.lit("sha256"),
        "trace_id": F.substring(F.sha2(F.concat_ws("|", place, F.col("raw")), 256), 1, 32),
    })


def positioned(df: DataFrame) -> DataFrame:
    """The lines, if their source says where each one stood; equal lines would share an id otherwise."""
    if not set(POSITIONS) & set(df.columns):
        raise ValueError(f"lines need one of the columns {', '.join(POSITIONS)}")
    return df


def template(text: str, attrs: Column) -> Column:
    """``{name}`` replaced by the attribute; an unknown name stays as it is (nrm_template)."""
    parts = re.split(r"(\{[^{}]+\})", text)
    cols = [F.coalesce(F.try_element_at(attrs, F.lit(p[1:-1])), F.lit(p))
            if p.startswith("{") and p.endswith("}") else F.lit(p) for p in parts if p]
    return F.concat(*cols)


def leaf_type(target: str) -> T.DataType:
    return UES_LEAVES.get(target, T.StringType())


def to_leaf(target: str, value: Column) -> Column:
    """A converted value in the type of its event field."""
    return value.try_cast(leaf_type(target))


# Stages of a spec: texts, their conversions, then two for each derived rule.
GIVEN, DONE, RULES = 0, 1, 2


@dataclass
class Compiled:
    """What one spec contributes: field values, lineage records, warnings.

    Values are used many times, by fields, lineage, warnings and later rules. So each is a field of a column of its
    stage, made once from columns of earlier stages.
    """

    number: int
    spec: str
    stages: dict[int, list[Column]] = field(default_factory=dict)
    values: dict[str, Column] = field(default_factory=dict)
    lineage: list[Column] = field(default_factory=list)
    warnings: list[Column] = field(default_factory=list)

    def put(self, target: str, value: Column) -> None:
        old = self.values.get(target)
        self.values[target] = value if old is None else F.coalesce(value, old)

    def bind(self, stage: int, value: Column) -> Column:
        held = self.stages.setdefault(stage, [])
        held.append(value)
        return F.col(f"_stage{stage}_{self.number}").getField(f"v{len(held) - 1}")

    def columns(self, stage: int) -> dict[str, Column]:
        """The column of a stage; NULL for lines of other specs."""
        held = [v.alias(f"v{i}") for i, v in enumerate(self.stages.get(stage, []))]
        return {f"_stage{stage}_{self.number}": F.when(F.col("spec") == self.spec, F.struct(*held))} if held else {}


def record(target: str, value: Column, source: Column | str, original: Column, method: str,
           confidence: float, rule: Column | str | None = None) -> Column:
    """One lineage record, NULL when the field was not written."""
    source = F.lit(source) if isinstance(source, str) else source
    rule = F.concat(source, F.lit(f" -> {target}")) if rule is None else rule
    return F.when(value.isNotNull(), F.struct(
        F.lit(target).alias("normalized_field"),
        as_text(value, leaf_type(target)).alias("normalized_value"),
        source.alias("original_field"), original.cast("string").alias("original_value"),
        rule.alias("mapping_rule"), F.lit(method).alias("extraction_method"),
        F.lit(float(confidence)).alias("confidence"),
        F.col("_parser_id").alias("parser"), F.col("raw_hash").alias("raw_hash"),
    )).cast(LINEAGE_STRUCT)


def apply_mapping(out: Compiled, spec: Spec, year) -> None:
    """nrm_mapping, with the conversion warnings of nrm_warnings."""
    envelope = {"_raw": F.col("raw"), "_host": F.col("parsed.host"),
                "_pri": F.col("parsed.pri").cast("string"), "_time": F.col("parsed.event_time_raw")}
    for target, m in spec.mapping.items():
        m = m or {}
        src = m.get("src")
        if "template" in m:
            value = template(str(m["template"]), F.col("_attrs"))
            names = re.findall(r"{([^}]+)}", str(m["template"]))
            origin, original = " + ".join(names) or "template", F.lit(None).cast("string")
        elif "value" in m:
            value = F.lit(str(m["value"]))
            origin, original = str(src or "template"), F.lit(str(m["value"]))
        elif src in envelope:
            value = envelope[src]
            origin, original = str(src), F.lit(None).cast("string")
        else:
            value = A.get(F.col("_low"), str(src or ""))
            origin, original = str(src or "template"), value
        given = out.bind(GIVEN, present(value))
        original = given if original is value else original
        ctype = m.get("type")
        done = convert(given, ctype, m.get("map"), year)
        if m.get("map") and ctype not in TYPE_OF:
            done = value_map(done, m["map"])
        done = out.bind(DONE, to_leaf(target, done))
        out.put(target, done)
        out.lineage.append(record(target, done, origin, original,
                                  m.get("method", "parser-field mapping"), m.get("confidence", 1.0)))
        if ctype not in (None, "", "str", "lower", "upper", "action", "map", "proto", "bool"):
            out.warnings.append(F.when(given.isNotNull() & done.isNull(), F.concat(
                F.lit(f"{target}: cannot convert '"), given, F.lit(f"' to {ctype}"))))


def apply_taxonomy(out: Compiled, spec: Spec) -> None:
    """nrm_taxonomy: value map of one attribute, unmapped values pass."""
    for target, t in spec.taxonomy.items():
        src = (t or {}).get("src")
        if not src:
            continue
        given = out.bind(GIVEN, present(A.get(F.col("_low"), str(src))))
        done = out.bind(DONE, to_leaf(target, value_map(given, t["map"]) if t.get("map") else given))
        out.put(target, done)
        out.lineage.append(record(target, done, str(src), given, "taxonomy mapping",
                                  t.get("confidence", 1.0)))


def apply_severity(out: Compiled, spec: Spec) -> None:
    """nrm_severity"""
    sev = spec.severity
    if not sev.get("src"):
        return
    given = out.bind(GIVEN, A.get(F.col("_low"), str(sev["src"])))
    value = given
    if sev.get("map"):
        table = {str(k): str(v) for k, v in sev["map"].items()}
        other = F.lit(str(sev["default"])) if "default" in sev else given
        value = F.when(given.isNotNull(), F.coalesce(
            F.try_element_at(lit_map(table), given), F.try_element_at(lit_map(table), F.lower(given)), other))
    canon = out.bind(DONE, severity_ues(value))
    out.put("severity_label", canon["label"])
    out.put("severity", F.when(canon["label"].isNotNull(), canon["number"]))


def apply_derived(out: Compiled, spec: Spec, year) -> None:
    """nrm_derived: every rule that matches sets constants or captured groups; a later rule sees
    what an earlier one wrote."""
    for i, rule in enumerate(spec.derived):
        if not rule.get("when"):
            continue
        pattern, names = _java(str(rule["when"]))
        src = rule.get("field", "message")
        if src == "raw":
            text = F.col("raw")
        else:
            text = as_text(out.values.get(src, F.lit(None).cast(leaf_type(src))), leaf_type(src))
            if src == "message":
                text = F.coalesce(present(text), F.col("raw"))
        text = out.bind(RULES + 2 * i, F.coalesce(text, F.lit("")))
        hit = text.rlike(pattern)
        for target, sv in (rule.get("set") or {}).items():
            opts = sv if isinstance(sv, dict) else {"const": sv}
            if "value" in opts:
                if opts["value"] not in names:
                    continue
                value = group(text, pattern, names[opts["value"]])
            else:
                if opts.get("const") is None:
                    continue
                value = F.lit(str(opts["const"]))
            done = out.bind(RULES + 2 * i + 1, F.when(hit, to_leaf(
                target, convert(value, opts.get("type"), opts.get("map"), year))))
            out.put(target, done)
            out.lineage.append(record(target, done, str(src), text, "derived regex",
                                      rule.get("confidence", 1.0)))


def apply_constants(out: Compiled, spec: Spec) -> None:
    """nrm_constants: unconditional, and without lineage."""
    for target, value in spec.constants.items():
        if value is not None:
            out.put(target, to_leaf(target, F.lit(str(value))))


def compile_spec(spec: Spec, year, number: int = 0) -> Compiled:
    out = Compiled(number, spec.id)
    apply_mapping(out, spec, year)
    apply_taxonomy(out, spec)
    apply_severity(out, spec)
    apply_derived(out, spec, year)
    apply_constants(out, spec)
    return out


def _field(target: str) -> str:
    return target.replace(".", "__")


def by_spec(df: DataFrame, specs: tuple[Spec, ...], year) -> tuple[DataFrame, list[str]]:
    """Adds ``_m`` (values), ``_spec_lineage`` and ``_spec_warnings`` of the effective spec."""
    stages, targets = built(("by_spec", repr(specs), year), lambda: _by_spec(specs, year))
    for cols in stages:
        df = df.withColumns(cols)
    return df, targets


def _by_spec(specs: tuple[Spec, ...], year) -> tuple[list[dict[str, Column]], list[str]]:
    compiled = {s.id: compile_spec(s, year, i) for i, s in enumerate(specs)}
    targets = sorted({t for x in compiled.values() for t in x.values})

    def pick(branches: dict[str, Column], dtype) -> Column:
        out = None
        for sid, value in branches.items():
            cond = F.col("spec") == sid
            out = F.when(cond, value) if out is None else out.when(cond, value)
        return F.lit(None).cast(dtype) if out is None else out

    values = [pick({sid: x.values[t] for sid, x in compiled.items() if t in x.values},
                   leaf_type(t)).alias(_field(t)) for t in targets]
    lineage = pick({sid: F.filter(F.array(*x.lineage), lambda r: r.isNotNull())
                    for sid, x in compiled.items() if x.lineage}, f"array<{LINEAGE_STRUCT}>")
    warnings = pick({sid: F.array_compact(F.array(*x.warnings))
                     for sid, x in compiled.items() if x.warnings}, "array<string>")
    cols = {"_m": F.struct(*values) if values else F.struct(F.lit(None).alias("none")),
            "_spec_lineage": lineage, "_spec_warnings": warnings}
    numbers = sorted({n for x in compiled.values() for n in x.stages})
    stages = [{k: v for x in compiled.values() for k, v in x.columns(n).items()} for n in numbers]
    return [*stages, cols], targets


# --- inference -------------------------------------------------------------------------------
INFER_TARGETS = list(dict.fromkeys(t for t, _ in INFERENCE.values()))
_TYPE_OF_TARGET = {t: ctype for t, ctype in INFERENCE.values()}


def _target_of(key: Column) -> Column:
    """Inference target of a lower-case key. The table is split by key length, so a key is
    compared with a handful of entries only."""
    by_len: dict[int, dict[str, str]] = {}
    for k, (t, _) in INFERENCE.items():
        by_len.setdefault(len(k), {})[k] = t
    n = F.length(key)
    out = None
    for size, table in sorted(by_len.items()):
        value = F.try_element_at(lit_map(table), key)
        out = F.when(n == size, value) if out is None else out.when(n == size, value)
    return out


def _inferred_text(target: Column, value: Column, year) -> Column:
    """The converted value as text."""
    by_type: dict[str, list[str]] = {}
    for t, ctype in _TYPE_OF_TARGET.items():
        by_type.setdefault(ctype, []).append(t)
    out = F.when(target.isin(by_type.pop("str")), value)
    for ctype, targets in by_type.items():
        done = convert(value, ctype, None, year)
        done = iso_ms(done) if ctype == "timestamp" else done.cast("string")
        out = out.when(target.isin(targets), done)
    return out


def known_attributes(low_bag: Column) -> Column:
    """array<struct<target, key, value>>: the attributes that can fill a target, in order."""
    return F.filter(
        F.transform(low_bag, lambda p: F.struct(
            _target_of(p["key"]).alias("target"), p["key"].alias("key"), p["value"].alias("value"))),
        lambda p: p["target"].isNotNull() & ~F.coalesce(p["value"], F.lit("")).isin("", "-"))


def infer_candidates(known: Column, year) -> Column:
    """array<struct<target, key, value, conv>>: the first known attribute of each target that converts."""
    typed = F.filter(
        F.transform(known, lambda p: p.withField("conv", _inferred_text(p["target"], p["value"], year))),
        lambda p: F.coalesce(p["conv"], F.lit("")) != "")

    def first(found: Column) -> Column:
        return let(F.transform(found, lambda p: p["target"]), lambda targets: F.filter(
            found, lambda p, i: F.array_position(targets, p["target"]) == i + 1))

    return let(typed, first)


def infer_fields(df: DataFrame, col: str = "parsed", year=None) -> DataFrame:
    """Adds ``inferred``: target -> value as text (nrm_infer)."""
    low = A.dedup(A.lowered(F.col(col)["attrs"]))
    df = df.withColumn("_cand", infer_candidates(known_attributes(low), year))
    return df.withColumn("inferred", F.map_from_entries(F.transform(
        F.col("_cand"), lambda p: F.struct(p["target"], p["conv"])))).drop("_cand")


# --- the whole step --------------------------------------------------------------------------
def normalize_parsed(df: DataFrame, specs: tuple[Spec, ...] = (), pipeline_id: str = "logspark",
                     pipeline_version: str = SCHEMA_VERSION, year: int | None = None,
                     strict_reference: bool = False, as_of: Column | None = None) -> DataFrame:
    """Output of ``parse_chain`` to events with columns ues, meta, trace, raw.

    ``strict_reference`` lets a syslog priority replace a severity label that came without a
    number and keeps its word as it is; by default the label decides and is canonical.
    """
    df = with_source_columns(df) if set(SOURCE_COLUMNS) - set(df.columns) else df
    if "raw_hash" not in df.columns:
        df = with_integrity(df)
    now = F.coalesce(as_of if as_of is not None else F.col("received_time"), F.current_timestamp())
    df = df.withColumns({
        "_parser_id": F.coalesce(F.col("spec"), F.col("parser")),
        "_now": ms_precision(now),
        "_attrs": A.as_map(F.col("parsed.attrs")),
        "_low_bag": A.dedup(A.lowered(F.col("parsed.attrs"))),
    })
    df = df.withColumn("_low", A.as_map(F.col("_low_bag")))
    df, spec_targets = by_spec(df, specs, year)

    def m(target: str) -> Column:
        if target in spec_targets:
            return F.col("_m").getField(_field(target))
        return F.lit(None).cast(leaf_type(target))

    # Envelope: what the parser knows outside of the attributes (nrm_envelope).
    pri = F.col("parsed.pri")
    hint = severity_ues(F.col("parsed.severity_raw"))
    word, number = m("severity_label"), m("severity")
    if not strict_reference:
        number = F.coalesce(number, severity_ues(word)["number"])
    from_pri = number.isNull() & pri.between(0, 191)
    pri_word = pri_label(pri) if strict_reference else severity_ues(pri_label(pri))["label"]
    word_2 = F.when(from_pri, pri_word).otherwise(word)
    number_2 = F.when(from_pri, severity_ues(pri_label(pri))["number"]).otherwise(number)
    from_hint = word_2.isNull() & hint["label"].isNotNull()
    pre = {
        "event_time": F.coalesce(m("event_time"), parse_ts(F.col("parsed.event_time_raw"), year)),
        "device.host": F.coalesce(m("device.host"), present(F.col("parsed.host"))),
        "message": F.coalesce(m("message"), present(F.col("parsed.message"))),
        "device.vendor": F.coalesce(m("device.vendor"), present(F.col("parsed.vendor"))),
        "device.product": F.coalesce(m("device.product"), present(F.col("parsed.product"))),
        "service": F.coalesce(m("service"), present(F.col("parsed.service"))),
        "severity_label": F.when(from_hint, hint["label"]).otherwise(word_2),
        "severity": F.when(from_hint, hint["number"]).otherwise(number_2),
    }
    for target in [*INFER_TARGETS, *spec_targets]:
        pre.setdefault(target, m(target))
    df = df.withColumn("_pre", F.struct(*[v.alias(_field(t)) for t, v in pre.items()]))
    df = df.withColumn("_known", built(("known",), lambda: known_attributes(F.col("_low_bag"))))
    taken = F.array_compact(F.array(*[
        F.when(F.col("_pre").getField(_field(t)).isNotNull(), F.lit(t)) for t in INFER_TARGETS]))
    # What the spec or the envelope has filled needs no conversion of its attributes. The names are bound here: as a column
    # they would be moved into the test and made again for each attribute.
    df = df.withColumn("_known", let(taken, lambda names: F.filter(
        F.col("_known"), lambda p: ~F.array_contains(names, p["target"]))))
    df = df.withColumn("_cand", built(("infer", year), lambda: infer_candidates(F.col("_known"), year)))
    df = df.withColumn("_inf", F.map_from_entries(F.transform(
        F.col("_cand"), lambda p: F.struct(p["target"], p["conv"]))))

    values: dict[str, Column] = {}
    for target in pre:
        value = F.col("_pre").getField(_field(target))
        if target in INFER_TARGETS:
            text = F.try_element_at(F.col("_inf"), F.lit(target))
            value = F.coalesce(value, to_leaf(target, text))
        values[target] = value
    # Defaults (nrm_defaults). An inferred label brings its number.
    label_number = F.try_element_at(lit_map(SEVERITY_NUMBER), F.try_element_at(
        F.col("_inf"), F.lit("severity_label")))
    seen_time = values["event_time"]
    values["event_time"] = F.coalesce(ms_precision(seen_time), F.col("_now"))
    values["severity"] = F.coalesce(label_number, values["severity"], F.lit(10))
    values["severity_label"] = F.coalesce(values["severity_label"], F.lit("info"))
    values["event_time_epoch_ms"] = epoch_ms(values["event_time"])
    values["schema_version"] = F.lit(SCHEMA_VERSION)
    values["event_id"] = F.substring(F.sha2(F.concat(F.lit("event|"), F.col("trace_id")), 256), 1, 32)
    values["ingest_time"] = F.col("_now")
    values["event_kind"] = F.coalesce(values.get("event_kind", F.lit(None)), F.lit("event"))
    values["labels"] = F.create_map().cast("map<string,string>")
    values["tags"] = F.array().cast("array<string>")
    undeclared = [t for t in spec_targets if t not in UES_LEAVES and not t.startswith("trace.")]
    if undeclared:
        entries = F.filter(F.array(*[F.struct(F.lit(t).alias("key"), m(t).cast("string").alias("value"))
                                     for t in undeclared]), lambda e: e["value"].isNotNull())
        values["ext"] = F.map_from_entries(entries)
    correlation = values.pop("trace.correlation_id", F.lit(None))

    inferred_lineage = F.transform(F.col("_cand"), lambda p: F.struct(
        p["target"].alias("normalized_field"), p["conv"].alias("normalized_value"),
        p["key"].alias("original_field"), p["value"].alias("original_value"),
        F.concat(p["key"], F.lit(" -> "), p["target"]).alias("mapping_rule"),
        F.lit("offline key inference").alias("extraction_method"),
        F.lit(INFER_CONFIDENCE).alias("confidence"), F.col("_parser_id").alias("parser"),
        F.col("raw_hash").alias("raw_hash"))).cast(f"array<{LINEAGE_STRUCT}>")
    no_time = F.when(seen_time.isNull(), F.array(F.lit("event_time missing; defaulted to ingest time")))
    none = F.array().cast("array<string>")
    ues = build(UES, {t: v for t, v in values.items() if t in UES_LEAVES})
    meta = build(META, {
        "pipeline_id": F.lit(pipeline_id), "pipeline_version": F.lit(pipeline_version),
        "parser": F.col("_parser_id"),
        "format": F.when(F.col("parser") == "plain", F.lit(FORMAT_NAME["plain"])).otherwise(F.col("parser")),
        "parse_status": F.lit("parsed"), "source_type": present(F.col("source_type")),
        "source_address": present(F.col("address")), "source_transport": present(F.col("transport")),
        "parser_chain": F.col("parser_chain"), "detection": F.col("detection"),
        "warnings": F.concat(F.coalesce(F.col("parsed.warnings"), none),
                             F.coalesce(F.col("_spec_warnings"), none), F.coalesce(no_time, none)),
        "received_time": F.coalesce(F.col("received_time"), F.col("_now")),
        "agent_id": F.col("agent_id"), "agent_fingerprint": F.col("agent_fingerprint"),
    })
    trace = build(TRACE, {
        "trace_id": F.col("trace_id"), "correlation_id": correlation, "raw_hash": F.col("raw_hash"),
        "raw_size": F.col("raw_size"), "raw_offset": F.col("raw_offset"), "algorithm": F.col("algorithm"),
        "lineage": F.concat(F.coalesce(F.col("_spec_lineage"), F.array().cast(f"array<{LINEAGE_STRUCT}>")),
                            inferred_lineage),
    })
    kept = [x for x in df.columns if x.startswith("key_")]
    return df.select(*kept, ues.alias("ues"), meta.alias("meta"), trace.alias("trace"), F.col("raw"))


def failure_events(df: DataFrame, error_col: str, pipeline_id: str = "logspark",
                   as_of: Column | None = None) -> DataFrame:
    """Lines that could not be normalized, as events that keep the raw text (nrm_failure)."""
    df = with_integrity(with_source_columns(positioned(df)))
    now = ms_precision(F.coalesce(as_of if as_of is not None else F.col("received_time"),
                                  F.current_timestamp()))
    ues = build(UES, {
        "schema_version": F.lit(SCHEMA_VERSION), "event_kind": F.lit("event"), "event_time": now,
        "event_time_epoch_ms": epoch_ms(now), "ingest_time": now, "severity": F.lit(10),
        "severity_label": F.lit("info"), "tags": F.array(), "labels": F.create_map(),
        "event_id": F.substring(F.sha2(F.concat(F.lit("event|"), F.col("trace_id")), 256), 1, 32)})
    meta = build(META, {
        "pipeline_id": F.lit(pipeline_id), "pipeline_version": F.lit(SCHEMA_VERSION),
        "parser": F.lit("none"), "format": F.lit("unknown"), "parse_status": F.lit("failed"),
        "source_type": present(F.col("source_type")), "source_address": present(F.col("address")),
        "source_transport": present(F.col("transport")),
        "warnings": F.array(F.concat(F.lit("normalization error: "), F.col(error_col))),
        "received_time": F.coalesce(F.col("received_time"), now)})
    trace = build(TRACE, {
        "trace_id": F.col("trace_id"), "raw_hash": F.col("raw_hash"), "raw_size": F.col("raw_size"),
        "raw_offset": F.col("raw_offset"), "algorithm": F.col("algorithm"), "lineage": F.array()})
    kept = [x for x in df.columns if x.startswith("key_")]
    return df.select(*kept, ues.alias("ues"), meta.alias("meta"), trace.alias("trace"), F.col("raw"))


def normalize_logs(df: DataFrame, specs: tuple[Spec, ...] = (), pipeline_id: str = "logspark",
                   year: int | None = None, strict_reference: bool = False) -> DataFrame:
    """Raw lines to events: choose, parse, chain, normalize (nrm_pipeline).

    One row out per non-blank row in, the raw text unchanged. The plan is a chain of projections
    without a shuffle.
    """
    df = with_integrity(with_source_columns(positioned(df).filter(strip(F.col("raw")) != "")))
    return normalize_parsed(parse_chain(df, specs), specs, pipeline_id, year=year,
                            strict_reference=strict_reference)


def lineage(events: DataFrame) -> DataFrame:
    """One row per written field (nrm_lineage)."""
    return (events.select(F.col("trace.trace_id").alias("trace_id"),
                          F.posexplode_outer("trace.lineage").alias("pos", "l"))
            .filter("l IS NOT NULL").select("trace_id", "pos", "l.*"))
