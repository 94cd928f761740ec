"""The universal event: one nested row per raw line."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructType, TimestampType,
)

from .functions.paths import leaves

SCHEMA_VERSION = "1.0.0"

_BASIC = {"string": StringType(), "int": IntegerType(), "bigint": LongType(), "double": DoubleType(),
          "boolean": BooleanType(), "timestamp": TimestampType()}
TEXTS = ArrayType(StringType())
PAIRS = MapType(StringType(), StringType())


def record(text: str = "", **nested) -> StructType:
    """A struct from ``"type: name name; type: name"`` and named nested types."""
    out = StructType()
    for part in filter(None, (p.strip() for p in text.split(";"))):
        kind, names = part.split(":")
        for name in names.split():
            out.add(name, _BASIC[kind.strip()])
    for name, dtype in nested.items():
        out.add(name, dtype)
    return out


_GEO = record("string: country city; boolean: internal")

UES: StructType = record(
    """string: schema_version event_id; timestamp: event_time; bigint: event_time_epoch_ms; timestamp: ingest_time;
    string: event_kind category type action outcome; int: severity; string: severity_label message service""",
    source=record("string: ip; int: port; string: host zone user mac; int: ip_version"),
    destination=record("string: ip; int: port; string: host zone service; int: ip_version"),
    user=record("string: name domain"),
    network=record("string: transport protocol direction session_id application; "
                   "bigint: bytes_in bytes_out packets; double: duration"),
    http=record("string: method url host user_agent referrer; int: status_code; bigint: bytes"),
    dns=record("string: query answer"), file=record("string: name path hash"),
    process=record("string: name command_line; int: pid"),
    device=record("string: host vendor product version zone interface"),
    threat=record(matched=ArrayType(record("string: field indicator type severity feed"))).add("score", IntegerType()),
    geo=record(source=_GEO, destination=_GEO), labels=PAIRS, tags=TEXTS, ext=PAIRS)

META: StructType = record(
    "string: pipeline_id pipeline_version parser format parse_status source_type source_address source_transport",
    parser_chain=TEXTS, detection=record("string: format; double: confidence; string: reason"), warnings=TEXTS,
    received_time=TimestampType(), agent_id=StringType(), agent_fingerprint=StringType())

LINEAGE = record("string: normalized_field normalized_value original_field original_value mapping_rule "
                 "extraction_method; double: confidence; string: parser raw_hash")
LINEAGE_STRUCT = LINEAGE.simpleString()

TRACE: StructType = record(
    "string: trace_id correlation_id raw_hash; bigint: raw_size raw_offset; string: algorithm status",
    lineage=ArrayType(LINEAGE))

EVENT = StructType().add("ues", UES).add("meta", META).add("trace", TRACE).add("raw", "string")

UES_LEAVES = dict(leaves(UES))


def build(dtype: StructType, values: dict[str, Column], prefix: str = "") -> Column:
    """A struct column from {dotted path: column}; paths not given are NULL of their type."""
    fields = []
    for field in dtype.fields:
        path = f"{prefix}.{field.name}" if prefix else field.name
        if isinstance(field.dataType, StructType) and path not in values:
            fields.append(build(field.dataType, values, path).alias(field.name))
        else:
            value = values.get(path, F.lit(None))
            fields.append(value.cast(field.dataType).alias(field.name))
    return F.struct(*fields)
