"""Profiles of unknown sources and drafts of specs for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.base import lookup
from ..functions.convert import guess_type
from ..functions.tables import ALIASES, INFERENCE
from ..functions.timestamps import parse_ts
from ..operators import attributes as A
from ..operators.detect import detect_format
from ..operators.select import choose, extract_with, parse_chain
from ..operators.specs import Spec, spec_score
from .queries import top_k


def _format() -> Column:
    return detect_format("raw")["format"]


def _parser() -> Column:
    return F.coalesce("spec", "parser")


def _timed(year: int | None) -> Column:
    return parse_ts(F.col("parsed.event_time_raw"), year).isNotNull()


def profile_formats(df: DataFrame) -> DataFrame:
    """Lines per detected format, most frequent first (agg_profile_formats)."""
    return (df.groupBy(_format().alias("format")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), "format"))


def profile_parsers(parsed: DataFrame) -> DataFrame:
    """Lines per selected parser or spec (agg_profile_parsers)."""
    return (parsed.groupBy(_parser().alias("parser")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), "parser"))


def profile_fields(parsed: DataFrame, top: int | None = None) -> DataFrame:
    """Fields, all or the ``top`` most frequent, with suggested target and guessed type (agg_profile_fields)."""
    # The outer form: for a plain explode the optimizer derives a filter on the array and pushes a
    # copy of the whole extraction below itself.
    pairs = parsed.select(F.explode_outer("parsed.attrs").alias("a")).select("a.key", "a.value").filter(
        "key IS NOT NULL")
    n = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("sample"))
    targets = {k: t for k, (t, _) in INFERENCE.items()}
    return (n if top is None else top_k(n, top)).select(
        "key", "n", F.coalesce(lookup(targets, F.lower("key")), F.lit("<target.path>")).alias("target"),
        guess_type("sample").alias("type"))


def ts_coverage(parsed: DataFrame, year: int | None = None) -> DataFrame:
    """Lines whose time could be parsed, of all (agg_ts_coverage)."""
    return parsed.agg(F.count_if(_timed(year)).alias("timestamps"), F.count(F.lit(1)).alias("total"))


def inspect(df: DataFrame, specs: tuple[Spec, ...] = (), year: int | None = None) -> DataFrame:
    """The whole profile as (section, item, n) rows (onb_inspect); a line is parsed once for all its sections."""
    judged = parse_chain(df, specs).select(
        _format().alias("format"), _parser().alias("parser"), _timed(year).alias("timed"),
        F.coalesce(F.filter("parsed.attrs", lambda a: a["key"].isNotNull()), A.empty_bag()).alias("attrs"))

    def entry(section: str, item: Column | str, n: Column | int = 1) -> Column:
        item, n = (F.lit(x) if isinstance(x, (str, int)) else x for x in (item, n))
        return F.struct(F.lit(section).alias("section"), item.alias("item"), n.cast("bigint").alias("n"))

    timed = F.col("timed").cast("int")
    found = F.concat(
        F.array(entry("format", F.col("format")), entry("parser", F.col("parser")),
                entry("time", "timestamps", timed), entry("time", "total")),
        F.transform("attrs", lambda a: entry("field", a["key"])))
    # Without lines the times are still there, as zeros.
    none = df.sparkSession.range(1).select(F.array(entry("time", "timestamps", 0), entry("time", "total", 0)).alias("found"))
    return (judged.select(found.alias("found")).unionByName(none).select(F.explode_outer("found").alias("x")).select("x.*")
            .groupBy("section", "item").agg(F.sum("n").alias("n")))


# --- onboarding ------------------------------------------------------------------------------
_PAIR = r"""(?U)(?<![\w.-])([A-Za-z_][\w.-]*)\s*=\s*("(?:\\.|[^"\\])*"|'[^']*'|[^\s]+)"""


def source_pairs(df: DataFrame, col: str = "raw") -> DataFrame:
    """(source, sample, n) of all key=value names of a table of lines."""
    keys = F.regexp_extract_all(col, F.lit(_PAIR), F.lit(1))
    values = F.regexp_extract_all(col, F.lit(_PAIR), F.lit(2))
    pairs = df.select(F.explode(F.arrays_zip(keys.alias("k"), values.alias("v"))).alias("p"))
    value = F.regexp_replace("p.v", r"""^["']+|["']+$""", "")
    return (pairs.select(F.col("p.k").alias("source"), value.alias("sample")).groupBy("source")
            .agg(F.min("sample").alias("sample"), F.count(F.lit(1)).alias("n")))


def alias_join(pairs: DataFrame, col: str = "source") -> DataFrame:
    """Adds target, confidence, reason: known alias, else a name pattern (jn_alias). The alias
    table is a fixed list and is looked up in the plan."""
    low = F.lower(col)
    known = lookup(ALIASES, low)
    src, dst = low.contains("src"), low.contains("dst") | low.contains("dest")
    ip, port = low.endswith("ip"), low.endswith("port")
    pattern = (F.when(ip & src, "source.ip").when(ip & dst, "destination.ip")
               .when(port & src, "source.port").when(port & dst, "destination.port"))
    score = F.when(ip & (src | dst), 0.86).when(port & (src | dst), 0.84).otherwise(0.0)
    return pairs.withColumns({
        "target": F.coalesce(known, pattern),
        "confidence": F.when(known.isNotNull(), 0.96).otherwise(score),
        "reason": F.when(known.isNotNull(), "known security-log field alias")
        .when(pattern.isNotNull(), "name pattern").otherwise("unmapped field; approval required")})


def suggest_mappings(df: DataFrame, col: str = "raw") -> DataFrame:
    """Suggested target of every field name in a table of lines (onb_suggest)."""
    return alias_join(source_pairs(df, col))


_CANONICAL = {"event.action": "action", "event.outcome": "outcome", "host.name": "device.host",
              "service.name": "destination.service"}


def draft_spec(suggestions: DataFrame, spec_id: str, marker: str, fmt: str = "kv") -> dict:
    """A starter spec of suggested mappings (onb_spec).

    One source per target is chosen on Spark; the driver gets one row per target, and targets are
    a fixed short list.
    """
    s = suggestions.filter("target IS NOT NULL").withColumn(
        "target", F.coalesce(lookup(_CANONICAL, F.col("target")), F.col("target"))).filter(
        "target <> 'event_time'")
    best = F.struct(F.col("confidence"), F.col("n"))
    rows = (s.withColumn("type", guess_type("sample")).groupBy("target")
            .agg(F.max_by(F.struct("source", "type"), best).alias("m"))
            .select("target", "m.*").orderBy("target").collect())
    text = " ".join(r["target"] for r in rows)
    category = ("authentication" if "user.name" in text or "authentication" in text
                else "web" if any(w in text for w in ("http", "web", "url"))
                else "system" if any(w in text for w in ("process", "host", "system")) else "network")
    return {
        "id": spec_id, "name": f"{spec_id} source", "priority": 80, "match": {"any": [{"contains": marker}]},
        "format": fmt, "mapping": {r["target"]: {"src": r["source"], "type": r["type"]} for r in rows},
        "constants": {"category": category},
    }


def spec_coverage(df: DataFrame, specs: tuple[Spec, ...]) -> DataFrame:
    """Per spec: lines it matches, wins and extracts something from, and its mean score
    (onb_spec_coverage)."""
    pick = choose(F.col("raw"), specs)
    # What a built-in parser would find in a line that no spec has won is counted nowhere.
    judged = df.select("raw", pick.alias("pick")).withColumn("out", F.when(F.col("pick.spec").isNotNull(), extract_with(
        F.col("raw"), F.col("pick.parser"), F.col("pick.spec"), specs)))
    per = [F.struct(
        F.lit(s.id).alias("spec"), (spec_score(F.col("raw"), s) > 0).alias("matched"),
        F.coalesce(F.col("pick.spec") == s.id, F.lit(False)).alias("won"),
        F.col("pick.score").alias("score")) for s in specs]
    rows = judged.select(F.explode(F.array(*per)).alias("s"), F.size("out.attrs").alias("n_attrs"),
                         F.size("out.warnings").alias("n_warn"))
    won: Column = F.col("s.won")
    return rows.groupBy(F.col("s.spec").alias("spec")).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if("s.matched").alias("matched"),
        F.count_if(won).alias("won"), F.count_if(won & (F.col("n_attrs") > 0)).alias("extracted"),
        F.count_if(won & (F.col("n_warn") > 0)).alias("with_warnings"),
        F.round(F.avg(F.when(won, F.col("s.score"))), 6).alias("score"))
