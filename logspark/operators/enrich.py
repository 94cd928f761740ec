"""Enrichment: address lookups, threat indicators, classification, severity, integrity.

Feeds have one row per join key, so every lookup is a left join that keeps the event rows as they
are. No join is forced to broadcast: the feeds are read as tables and adaptive execution
broadcasts them only when their measured size is small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from ..functions.base import let, lookup, present, says_any, strip
from ..functions.convert import classifier_action, url_host
from ..functions.ip import ip_canonical, ip_internal, ip_v4_num, ip_v6_hex
from ..functions.severity import severity_ues
from ..functions.tables import (
    CATEGORY_WORDS, FAILURE_WORDS, SEVERITY_NUMBER, SUCCESS_WORDS, TYPE_OF_CATEGORY,
)
from ..functions.timestamps import epoch_ms, ms_precision

SIDES = ("source", "destination")
MATCH = "struct<field:string,indicator:string,type:string,severity:string,feed:string>"


# --- IP ranges -------------------------------------------------------------------------------
def disjoint_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges cut where the next one starts.

    The lookup rule is: take the last range that starts at or before the address, then test its
    end. With disjoint ranges an address meets at most one, so the event side needs no grouping.
    Neighbours are found per leading byte; only the 256 group heads are compared globally.
    """
    best = (ranges.filter("lo IS NOT NULL").groupBy("lo")
            .agg(F.max(F.struct("hi", "country", "city")).alias("r")).select("lo", "r.*"))
    best = best.withColumn("top", F.shiftright("lo", 24))
    heads = best.groupBy("top").agg(F.min("lo").alias("head"))
    heads = heads.withColumn("one", F.lit(1)).withColumn(
        "next_head", F.lead("head").over(Window.partitionBy("one").orderBy("top"))).select("top", "next_head")
    nxt = F.lead("lo").over(Window.partitionBy("top").orderBy("lo"))
    return (best.withColumn("_next", nxt).join(heads, "top")
            .withColumn("hi", F.least("hi", F.coalesce("_next", "next_head", F.lit(1 << 33)) - 1))
            .select("lo", "hi", "country", "city"))


#: Ranges as listed are broadcast up to this number; beyond it events are shuffled by block.
BROADCAST_RANGES = 200_000


def _counted(listed: DataFrame) -> DataFrame:
    """Ranges as listed, written and counted: where few enough, no event moves, however many have the same block."""
    listed = materialize(listed, "ranges")
    return F.broadcast(listed) if listed.count() <= BROADCAST_RANGES else listed


def geo_join(events: DataFrame, ranges: DataFrame, side: str, bucket: int = 16) -> DataFrame:
    """Adds ``geo_<side>`` struct<country, city> (jn_geo_range).

    Ranges are listed under each /16 block they touch; the join is on the block, with the bounds
    as extra condition, so it is a hash join and not a nested loop.
    """
    ip = F.col(f"ues.{side}.ip")
    v4 = disjoint_ranges(ranges).withColumn(
        "_b", F.explode(F.sequence(F.shiftright("lo", bucket), F.shiftright("hi", bucket))))
    v4 = v4.select(F.col("_b"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
                   F.struct("country", "city").alias("_g4"))
    v4 = _counted(v4)
    out = events.withColumn("_ip", ip_v4_num(ip))
    out = out.withColumn("_k", F.shiftright("_ip", bucket))
    out = out.join(v4, (F.col("_k") == F.col("_b")) & F.col("_ip").between(F.col("_lo"), F.col("_hi")), "left")
    return out.withColumnRenamed("_g4", f"geo_{side}").drop("_ip", "_k", "_b", "_lo", "_hi")


def disjoint_ranges_v6(ranges: DataFrame) -> DataFrame:
    """The IPv6 form: 32 hex digits compare like numbers. ``_next`` is where the next range starts."""
    best = (ranges.filter("lo6 IS NOT NULL").groupBy("lo6")
            .agg(F.max(F.struct("hi6", "country", "city")).alias("r")).select("lo6", "r.*"))
    best = best.withColumn("top", F.substring("lo6", 1, 8))
    heads = best.groupBy("top").agg(F.min("lo6").alias("head")).withColumn("pre", F.substring("top", 1, 4))
    firsts = heads.groupBy("pre").agg(F.min("head").alias("first"))
    firsts = firsts.withColumn("one", F.lit(1)).withColumn(
        "next_first", F.lead("first").over(Window.partitionBy("one").orderBy("pre"))).select("pre", "next_first")
    heads = heads.join(firsts, "pre").withColumn("next_head", F.coalesce(
        F.lead("head").over(Window.partitionBy("pre").orderBy("top")), "next_first")).select("top", "next_head")
    nxt = F.lead("lo6").over(Window.partitionBy("top").orderBy("lo6"))
    return best.withColumn("_next", nxt).join(heads, "top").select(
        "lo6", "hi6", F.coalesce("_next", "next_head", F.lit("g")).alias("_next"), "country", "city")


def geo_join_v6(events: DataFrame, ranges: DataFrame, side: str) -> DataFrame:
    """The IPv6 form of ``geo_join``: narrow ranges are listed under the 32-bit blocks they touch, wide ones under the
    16-bit blocks. An address meets at most one range."""
    def block(col: str | Column, digits: int) -> Column:
        return F.conv(F.substring(col, 1, digits), 16, 10).cast("bigint")

    cut = disjoint_ranges_v6(ranges).withColumn("_hi", F.least("hi6", "_next"))
    wide = block("_hi", 8) - block("lo6", 8) > 4096
    out = events.withColumn("_ip", ip_v6_hex(F.col(f"ues.{side}.ip")))
    for digits, these in ((8, cut.filter(~wide)), (4, cut.filter(wide))):
        listed = these.withColumn("_hi_block", F.when(F.col("_next") == "g", block("hi6", digits)).otherwise(block("_hi", digits)))
        listed = _counted(listed.select(
            F.explode(F.sequence(block("lo6", digits), "_hi_block")).alias("_b"), F.col("lo6").alias("_lo"),
            F.col("hi6").alias("_end"), F.col("_next").alias("_stop"), F.struct("country", "city").alias("_g6")))
        out = out.withColumn("_k", block("_ip", digits))
        inside = F.col("_ip").between(F.col("_lo"), F.col("_end")) & (F.col("_ip") < F.col("_stop"))
        out = out.join(listed, (F.col("_k") == F.col("_b")) & inside, "left")
        out = out.withColumn(f"geo_{side}", F.coalesce(f"geo_{side}", "_g6")).drop("_k", "_b", "_lo", "_end", "_stop", "_g6")
    return out.drop("_ip")


def enr_geo(events: DataFrame, ranges: DataFrame, ipv6: bool = True) -> DataFrame:
    """Internal flag and country/city of both addresses, of either family."""
    for side in SIDES:
        events = geo_join(events, ranges, side)
        if ipv6:
            events = geo_join_v6(events, ranges, side)
    parts = []
    for side in SIDES:
        ip = F.col(f"ues.{side}.ip")
        known = present(ip).isNotNull()
        parts.append(F.struct(
            F.when(known, F.col(f"geo_{side}.country")).alias("country"),
            F.when(known, F.col(f"geo_{side}.city")).alias("city"),
            F.when(known, F.coalesce(ip_internal(ip), F.lit(False))).alias("internal")).alias(side))
    return events.withColumn("ues", F.col("ues").withField("geo", F.struct(*parts))).drop(
        "geo_source", "geo_destination")


# --- threat indicators -----------------------------------------------------------------------
def _of_kind(feed: DataFrame, kind: str, name: str) -> DataFrame:
    return feed.filter(F.col("kind") == kind).select(
        F.col("indicator").alias("_ind"), F.struct("type", "severity", "feed").alias(name))


def threat_ip(events: DataFrame, feed: DataFrame) -> DataFrame:
    """Adds hit_source and hit_destination (jn_threat_ip)."""
    for side in SIDES:
        hits = _of_kind(feed, "ip", f"hit_{side}")
        events = events.join(hits, F.col(f"ues.{side}.ip") == F.col("_ind"), "left").drop("_ind")
    return events


def host_hits(hosts: DataFrame, feed: DataFrame) -> DataFrame:
    """host -> best indicator, for a table with distinct ``host`` values.

    A host is listed under each of its label suffixes and joined on equality; the earliest
    indicator of the feed wins, an exact string indicator is the last resort.
    """
    labels = F.split("host", r"\.")
    parts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))
    split = hosts.select("host", F.explode(parts).alias("_suffix"))
    meta = F.struct("type", "severity", "feed")
    domains = feed.filter("kind = 'domain'").select(
        F.regexp_replace("indicator", r"^\.+", "").alias("_suffix"), F.col("ord"), meta.alias("m"))
    exact = feed.filter("kind = 'string'").select(
        F.col("indicator").alias("host"), (F.col("ord") + (1 << 60)).alias("ord"), meta.alias("m"))
    found = split.join(domains, "_suffix").select("host", "ord", "m").unionByName(
        hosts.join(exact, "host").select("host", "ord", "m"))
    return found.groupBy("host").agg(F.min_by("m", "ord").alias("m"))


def _host_value() -> Column:
    return F.lower(strip(F.coalesce(present(F.col("ues.http.host")), present(F.col("ues.dns.query")))))


def threat_domain(events: DataFrame, feed: DataFrame) -> DataFrame:
    """Adds hit_host and hit_url (jn_threat_domain). Only distinct hosts are matched."""
    events = events.withColumns({"_host": _host_value(), "_uhost": F.lower(strip(url_host("ues.http.url")))})
    hosts = (events.select(F.explode(F.array("_host", "_uhost")).alias("host"))
             .filter("host IS NOT NULL AND host <> ''").distinct())
    hits = materialize(host_hits(hosts, feed), "hosts")
    # Events without a host are dealt out by their id: as one key they would be one task.
    none = F.concat(F.lit("\0"), F.xxhash64("trace.trace_id").cast("string")) if "trace" in events.columns else F.lit("\0")
    for col, name in (("_host", "hit_host"), ("_uhost", "hit_url")):
        known = hits.select(F.col("host").alias("_known"), F.col("m").alias(name))
        events = events.join(known, F.coalesce(F.col(col), none) == F.col("_known"), "left").drop("_known")
    return events.drop("_host", "_uhost")


#: Lengths of the runs of characters under which indicators are listed; each under the longest that fits it.
GRAMS = (4, 8, 16, 32)
#: Indicators are broadcast up to this number, else the runs that any is listed under are shuffled.
BROADCAST_INDICATORS = 200_000
#: Bits of the table that tells which runs of a text any indicator is listed under; a power of two.
BITS = 1 << 25
#: Texts on which it is counted how rare a gram is; that decides how much is compared, never what is found.
COUNTED_TEXTS = 2_000


def _grams(text: Column, n: int) -> Column:
    """All runs of n characters of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def _rarest(strings: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Each indicator with that of its runs of n characters that the fewest texts hold, and of such that fewest indicators
    share; the run as a hash."""
    seen = texts.limit(COUNTED_TEXTS).select(F.explode(_grams(F.col("text"), n)).alias("_gram")).groupBy("_gram").agg(F.count("*").alias("_f"))
    own = materialize(strings.select("*", F.explode(_grams(F.col("indicator"), n)).alias("_gram")), "own")
    shared = own.groupBy("_gram").agg(F.count("*").alias("_own")).join(seen, "_gram", "left")
    rank = F.struct(F.coalesce("_f", F.lit(0)), F.col("_own"), F.xxhash64("_gram"))
    return own.join(shared, "_gram").groupBy("indicator", "ord", "m").agg(F.xxhash64(F.min_by("_gram", rank)).alias("_key"))


def _listed(runs: DataFrame, keyed: DataFrame) -> DataFrame:
    """The runs (with ``_key``) that some indicator may be listed under, by a table of BITS bits, of which each row holds 64."""
    cell = F.col("_key").bitwiseAND(F.lit(BITS - 1))
    word, bit = F.shiftright(cell, 6), F.call_function("shiftleft", F.lit(1).cast("bigint"), cell.bitwiseAND(F.lit(63)).cast("int"))
    bits = materialize(keyed.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")), "bits")
    return (runs.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(bits), "_word")
            .filter(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).drop("_word", "_bit", "_bits"))


def text_hits(texts: DataFrame, feed: DataFrame) -> DataFrame:
    """text -> earliest string indicator of the feed contained in it: ord, indicator, m; for distinct texts.

    Each indicator is listed under its rarest run of as many characters of GRAMS as it has, shorter ones under themselves: long
    runs tell like indicators apart. Texts are numbered; the hashes of those of their runs that any indicator may be
    listed under go with their numbers to an equality join, and only what meets goes back to the text, once a text, to be
    compared in full. So what is moved grows with what is like an indicator. Feeds of any size work alike.
    """
    strings = materialize(feed.filter("kind = 'string'").select("indicator", "ord", F.struct("type", "severity", "feed").alias("m")), "indicators")
    texts = materialize(texts.select("text", F.monotonically_increasing_id().alias("_text")), "texts")
    size = F.length("indicator")
    listed_by = F.greatest(*[F.when(size >= n, n) for n in GRAMS], F.least(size, F.lit(GRAMS[0])))
    strings = strings.withColumn("_n", listed_by)
    sizes = {r["_n"] for r in strings.select("_n").filter("_n > 0").distinct().collect()}
    met = texts.select("_text", F.lit(None).cast(strings.select(F.struct("ord", "indicator", "m")).schema[0].dataType).alias("x")).limit(0)
    for n in sorted(sizes):
        keyed = materialize(_rarest(strings.filter(F.col("_n") == n).drop("_n"), texts, n), "keyed")
        runs = texts.select("_text", F.explode(_grams(F.col("text"), n)).alias("_gram")).select("_text", F.xxhash64("_gram").alias("_key"))
        if keyed.count() <= BROADCAST_INDICATORS:
            found = runs.join(F.broadcast(keyed), "_key")
        else:
            found = _listed(runs, keyed).join(keyed, "_key")
        met = met.unionByName(found.select("_text", F.struct("ord", "indicator", "m").alias("x")))
    # A text meets at most the indicators of its own runs.
    some = met.groupBy("_text").agg(F.collect_list("x").alias("_met"))
    first = F.array_min(F.filter("_met", lambda x: F.col("text").contains(x["indicator"])))
    return texts.join(some, "_text").withColumn("x", first).filter("x IS NOT NULL").select("text", "x.ord", "x.indicator", "x.m")


def threat_string(events: DataFrame, feed: DataFrame) -> DataFrame:
    """Adds hit_text struct<type, severity, feed> and hit_text_indicator (jn_threat_string).

    The values come from the first text with a hit; the shown indicator is the earliest feed entry
    found in the message, user agent or URL. Only events with a hit are on the side that is joined back.
    """
    fields = ("http.user_agent", "file.name", "message", "http.url")
    texts = events.select(F.col("trace.trace_id").alias("_id"), F.posexplode(F.array(
        *[F.lower(F.col(f"ues.{p}")) for p in fields])).alias("pos", "text")).filter("text <> ''")
    hits = texts.join(text_hits(texts.select("text").distinct(), feed), "text")
    per_event = hits.groupBy("_id").agg(
        F.min_by("m", "pos").alias("hit_text"),
        F.min_by(F.when(F.col("pos") != 1, F.col("indicator")), F.when(F.col("pos") != 1, F.col("ord"))).alias("_shown"))
    return (events.join(per_event, F.col("trace.trace_id") == F.col("_id"), "left")
            .withColumn("hit_text_indicator", F.when(F.col("hit_text").isNotNull(), F.coalesce("_shown", F.lit("unknown"))))
            .drop("_id", "_shown"))


def enr_threat(events: DataFrame, feed: DataFrame) -> DataFrame:
    """Matched indicators in field order, score, tag, and a severity that only rises."""
    events = threat_string(threat_domain(threat_ip(events, feed), feed), feed)

    def entry(field: str, indicator: Column, hit: str) -> Column:
        return F.when(F.col(hit).isNotNull(), F.struct(
            F.lit(field).alias("field"), indicator.alias("indicator"), F.col(f"{hit}.type").alias("type"),
            F.col(f"{hit}.severity").alias("severity"), F.col(f"{hit}.feed").alias("feed")))

    host = F.coalesce(present(F.col("ues.http.host")), present(F.col("ues.dns.query")))
    matched = F.array_compact(F.array(
        entry("source.ip", F.col("ues.source.ip"), "hit_source"),
        entry("destination.ip", F.col("ues.destination.ip"), "hit_destination"),
        entry("http.host", host, "hit_host"),
        entry("http.url", url_host("ues.http.url"), "hit_url"),
        entry("message", F.col("hit_text_indicator"), "hit_text")))
    events = events.withColumn("_matched", matched)
    score = F.array_max(F.transform(F.col("_matched"), lambda m: F.coalesce(
        lookup(SEVERITY_NUMBER, m["severity"]), F.lit(50))))
    events = events.withColumn("_score", score)
    hit = F.size("_matched") > 0
    label = F.col("ues.severity_label")
    raised = hit & (present(label).isNotNull()) & (
        F.coalesce(lookup(SEVERITY_NUMBER, label), F.lit(10)) < F.col("_score"))
    by_number = {n: k for k, n in SEVERITY_NUMBER.items()}
    ues = (F.col("ues")
           .withField("threat", F.when(hit, F.struct(
               F.col("_matched").alias("matched"), F.col("_score").alias("score"))).otherwise(F.col("ues.threat")))
           .withField("tags", F.when(hit, F.concat(F.coalesce(
               F.col("ues.tags"), F.array().cast("array<string>")), F.array(F.lit("threat-intel"))))
               .otherwise(F.col("ues.tags")))
           .withField("severity_label", F.when(raised, F.coalesce(
               lookup(by_number, F.col("_score")), F.lit("medium"))).otherwise(label))
           .withField("severity", F.when(raised, F.col("_score")).otherwise(F.col("ues.severity"))))
    return events.withColumn("ues", ues).drop(
        "_matched", "_score", "hit_source", "hit_destination", "hit_host", "hit_url", "hit_text",
        "hit_text_indicator")


def lookup_values(values: DataFrame, geo: DataFrame, feed: DataFrame, col: str = "value") -> DataFrame:
    """Feeds asked for single values (enr_lookup): country, city and the indicator hit by address,
    then domain, then contained string."""
    v = values.withColumn(col, strip(F.col(col)))
    shaped = v.withColumn("ues", F.struct(F.struct(F.col(col).alias("ip")).alias("source")))
    shaped = geo_join_v6(geo_join(shaped, geo, "source"), geo, "source").drop("ues")
    ips = _of_kind(feed, "ip", "hit_ip")
    shaped = shaped.join(ips, F.col(col) == F.col("_ind"), "left").drop("_ind")
    hosts = shaped.select(F.lower(col).alias("host")).filter("host <> ''").distinct()
    hits = host_hits(hosts, feed).select(F.col("host").alias("_h"), F.col("m").alias("hit_host"))
    shaped = shaped.join(hits, F.lower(col) == F.col("_h"), "left").drop("_h")
    found = text_hits(shaped.select(F.lower(col).alias("text")).filter("text <> ''").distinct(), feed).select(
        F.col("text").alias("_t"), F.col("m").alias("hit_text"))
    shaped = shaped.join(found, F.lower(col) == F.col("_t"), "left").drop("_t")
    hit = F.coalesce("hit_ip", "hit_host", "hit_text")
    return shaped.select(*values.columns, F.col("geo_source.country").alias("country"),
                         F.col("geo_source.city").alias("city"), hit.alias("hit"))


# --- the other enrichers ---------------------------------------------------------------------
def enr_time(events: DataFrame) -> DataFrame:
    t = ms_precision("ues.event_time")
    return events.withColumn("ues", F.col("ues").withField("event_time", t)
                             .withField("event_time_epoch_ms", F.coalesce(
                                 epoch_ms(t), F.col("ues.event_time_epoch_ms"))))


def enr_ip(events: DataFrame) -> DataFrame:
    """Canonical address text and version; text that is no address stays as it is."""
    ues = F.col("ues")
    for side in SIDES:
        ip = F.col(f"ues.{side}.ip")
        canonical = ip_canonical(ip)
        ues = ues.withField(side, F.col(f"ues.{side}").withField("ip", F.coalesce(canonical, ip)).withField(
            "ip_version", let(canonical, lambda a: F.when(a.contains(":"), 6).when(a.isNotNull(), 4))))
    return events.withColumn("ues", ues)


def category_of(text: Column) -> Column:
    out = None
    for name, words in CATEGORY_WORDS:
        out = F.when(text.rlike(words), name) if out is None else out.when(text.rlike(words), name)
    return out


def classify_text(col: Column | str) -> Column:
    """Category of stand-alone text (enr_classify_text)."""
    text = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    low = F.lower(text)
    return (category_of(text).when(low.contains("port scan"), "network")
            .when(low.contains("http"), "web").otherwise("system"))


def enr_classify(events: DataFrame) -> DataFrame:
    """Action synonym, outcome, category and type where they are missing."""
    message, raw = present(F.col("ues.message")), present(F.col("raw"))
    # A plain line is its own message. It is not read twice then: of the second one only its first words, which may go on
    # with what the first one ended with (no phrase has more than two words after one of its blanks).
    raw = F.when(message == raw, F.substring_index(raw, " ", 3)).otherwise(raw)
    # The text is bound in a projection of its own so that the word tests share it.
    events = events.withColumn("_text", F.concat_ws(" ", message, raw))
    events = events.withColumn("_low", F.when(present(F.col("ues.outcome")).isNull(), F.lower("_text")))
    t, low = F.col("_text"), F.col("_low")
    act = F.when(present(F.col("ues.action")).isNotNull(), classifier_action("ues.action"))
    outcome = F.coalesce(present(F.col("ues.outcome")),
                         F.when(says_any(t, low, FAILURE_WORDS), "failure").when(says_any(t, low, SUCCESS_WORDS), "success"))
    web = F.coalesce(present(F.col("ues.http.url")), present(F.col("ues.http.method"))).isNotNull()
    address = F.coalesce(present(F.col("ues.source.ip")), present(F.col("ues.destination.ip"))).isNotNull()
    category = F.coalesce(
        present(F.col("ues.category")), F.when(web, "web"),
        F.when(present(F.col("ues.dns.query")).isNotNull(), "network"), category_of(t),
        F.when(address, "network").otherwise("system"))
    events = events.withColumns({"_act": act, "_outcome": outcome, "_category": category})
    kind = F.coalesce(present(F.col("ues.type")), lookup(TYPE_OF_CATEGORY, F.col("_category")), F.lit("event"))
    act = F.when((F.col("_category") == "authentication") & F.col("_act").isNull(),
                 F.when(F.col("_outcome") == "success", "allow").otherwise("deny")).otherwise(F.col("_act"))
    ues = (F.col("ues").withField("action", act).withField("outcome", F.col("_outcome"))
           .withField("category", F.col("_category")).withField("type", kind))
    return events.withColumn("ues", ues).drop("_text", "_low", "_act", "_outcome", "_category")


def enr_severity(events: DataFrame) -> DataFrame:
    value = F.coalesce(present(F.col("ues.severity_label")), F.col("ues.severity").cast("string"))
    events = events.withColumn("_sev", severity_ues(value))
    known = F.col("_sev.label").isNotNull()
    return events.withColumn("ues", F.col("ues")
                             .withField("severity_label", F.when(known, F.col("_sev.label")).otherwise("info"))
                             .withField("severity", F.when(known, F.col("_sev.number")).otherwise(10))
                             ).drop("_sev")


def enr_integrity(events: DataFrame) -> DataFrame:
    """Status from a real check: the hash is computed again from the raw text."""
    ok = F.sha2(F.col("raw"), 256) == F.col("trace.raw_hash")
    return events.withColumn("trace", F.col("trace").withField("algorithm", F.coalesce(
        F.col("trace.algorithm"), F.lit("sha256"))).withField(
        "status", F.when(ok, "verified").otherwise("mismatch")))


DEFAULT_ORDER = ("time", "ip", "geo", "threat_intel", "classify", "severity", "integrity")


def enrich(events: DataFrame, geo: DataFrame | None = None, feed: DataFrame | None = None,
           order: tuple[str, ...] = DEFAULT_ORDER, enabled: dict[str, bool] | None = None) -> DataFrame:
    """The enrichers in the given order, each with an off switch (enr_order)."""
    steps: dict[str, Callable[[DataFrame], DataFrame]] = {
        "time": enr_time, "ip": enr_ip,
        "geo": (lambda df: enr_geo(df, geo)) if geo is not None else (lambda df: df),
        "threat_intel": (lambda df: enr_threat(df, feed)) if feed is not None else (lambda df: df),
        "classify": enr_classify, "severity": enr_severity, "integrity": enr_integrity,
    }
    for name in order:
        if name in steps and (enabled or {}).get(name, True):
            events = steps[name](events)
    return events
