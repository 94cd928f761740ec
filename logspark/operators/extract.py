"""Extractors: each turns the raw column into one ``parsed`` struct.

All of them are built-in expressions. The struct is the same for every format, so a CASE over
the chosen parser evaluates just one extractor per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ..functions.base import c, first_present, group, let, present, strip
from ..functions.tables import keys_of
from . import attributes as A
from .detect import RFC5424_HEAD, is_json, is_xml

PARSED = (
    f"struct<attrs:{A.BAG},message:string,event_time_raw:string,host:string,pri:int,"
    "vendor:string,product:string,severity_raw:string,service:string,sub_raw:string,"
    "warnings:array<string>>"
)
_FIELDS = ["message", "event_time_raw", "host", "pri", "vendor", "product", "severity_raw",
           "service", "sub_raw"]


def parsed(attrs: Column | None = None, warnings: list[Column] | None = None, **fields: Column) -> Column:
    notes = F.array_compact(F.array(*warnings)) if warnings else F.array()
    return F.struct(
        (A.empty_bag() if attrs is None else attrs).alias("attrs"),
        *[fields.get(f, F.lit(None)).alias(f) for f in _FIELDS],
        notes.alias("warnings"),
    ).cast(PARSED)


def with_lower(bag: Column, body) -> Column:
    """Bind a bag and its lower-case map once."""
    return let(bag, lambda b: let(A.as_map(A.dedup(A.lowered(b))), lambda low: body(b, low)))


def par_plain(raw: Column | str, options: dict | None = None) -> Column:
    """The whole line as message."""
    return parsed(message=strip(raw))


# --- syslog ----------------------------------------------------------------------------------
# The parts of both published shapes: <priority>, then version and five words, or a date without a year.
_PRIORITY = r"<(\d{1,3})>"
_WORD = r"(\S+)"
_HEAD_5424 = r"\s+".join([_PRIORITY + r"(\d{1,2})", *[_WORD] * 5])
# Structured data: elements in square brackets; a quoted value may hold a closing one.
_ELEMENT = r'\[(?:"(?:[^"\\]|\\.)*"|[^\]"])*\]'
_RFC5424 = rf"(?s)^{_HEAD_5424}\s+((?:{_ELEMENT})*)\s*(.*)$"
_DATE = r"[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}(?::\d{2}){2}"
_TAG = r"([\w./-]+)(?:\[(\d+)\])?:"
_RFC3164 = rf"(?s)^(?:{_PRIORITY})?({_DATE})\s+{_WORD}\s+(?:{_TAG}\s*)?(.*)$"
# The message part of both shapes always matches, so the head alone decides.
IS_5424 = "^" + _HEAD_5424.replace("(", "(?:") + r"\s+"
IS_3164 = rf"^(?:<\d{{1,3}}>)?{_DATE}\s+\S+\s+"


def _dash(col: Column) -> Column:
    return F.when(~col.isin("-", "NILVALUE"), col)


def _named(*pairs: tuple[str, Column]) -> Column:
    return F.filter(F.array(*[A.pair(F.lit(k), v) for k, v in pairs]),
                    lambda p: p["value"].isNotNull())


def par_syslog(raw: Column | str, options: dict | None = None) -> Column:
    """RFC5424 and RFC3164 envelopes; the body is kept for a second extraction."""
    return let(strip(raw), _syslog_of)


def _syslog_of(line: Column) -> Column:

    def g(n: int) -> Column:
        return F.regexp_extract(line, _RFC5424, n)

    def h(n: int) -> Column:
        return F.regexp_extract(line, _RFC3164, n)

    new = parsed(
        attrs=_named(("syslog.app", _dash(g(5))), ("syslog.proc", _dash(g(6))),
                     ("syslog.msgid", _dash(g(7))), ("syslog.sdata", present(g(8)))),
        message=g(9), event_time_raw=_dash(g(3)), host=_dash(g(4)),
        pri=g(1).try_cast("int"), sub_raw=g(9))
    old = parsed(
        attrs=_named(("syslog.tag", present(h(4))), ("syslog.pid", present(h(5)))),
        message=h(6), event_time_raw=h(2), host=h(3),
        pri=h(1).try_cast("int"), sub_raw=h(6))
    odd = parsed(message=line, sub_raw=line,
                 warnings=[F.lit("unrecognized syslog envelope")])
    return F.when(line.rlike(IS_5424), new).when(line.rlike(IS_3164), old).otherwise(odd)


# --- JSON ------------------------------------------------------------------------------------
# --- fixed values: well-known keys
_MESSAGE = ["msg", "message", "text", "event", "description", "summary"]
_TIME = ["timestamp", "@timestamp", "time", "eventtime", "event_time", "datetime", "ts", "date"]
_HOST = ["host", "hostname", "computer", "device", "host.name", "devname"]
_LEVEL = ["level", "loglevel", "severity", "sev"]
_SERVICE = ["service", "logger", "appname", "program", "application"]

_VARIANTS = "array<struct<key:string,value:variant>>"


def _is_object(v: Column) -> Column:
    text = v.cast("string")
    return text.startswith("{") & (text != "{}") & F.schema_of_variant(v).startswith("OBJECT")


def _open_objects(entries: Column) -> Column:
    """Replace every object value by its members under dotted keys, one level."""

    def members(p: Column) -> Column:
        inner = F.map_entries(F.when(_is_object(p["value"]), p["value"]).cast("map<string,variant>"))
        opened = F.transform(inner, lambda m: F.struct(
            F.concat(p["key"], F.lit("."), m["key"]).alias("key"), m["value"].alias("value")))
        return F.coalesce(opened, F.array(F.struct(p["key"].alias("key"), p["value"].alias("value"))))

    return F.flatten(F.transform(entries, members))


def _json_entries(raw: Column, depth: int | None = None) -> Column:
    """Keys and values of a JSON object, opened down to ``depth``, or however deep it is.

    A line can't nest deeper than it has opening braces outside its texts; one level is opened a step, and steps with
    nothing left to open leave the entries as they are.
    """
    bare = F.regexp_replace(raw, r'"(?:[^"\\]|\\.)*+"', "")
    levels = let(bare, lambda b: F.length(b) - F.length(F.replace(b, F.lit("{"), F.lit(""))))
    if depth is not None:
        levels = F.least(levels, F.lit(depth + 1))
    first = F.map_entries(F.from_json(raw, "map<string,variant>"))
    step = let(levels, lambda n: F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>")))
    return F.aggregate(step, first.cast(_VARIANTS), lambda e, _: F.when(
        F.exists(e, lambda p: _is_object(p["value"])), _open_objects(e)).otherwise(e))


def _pairs(entries: Column) -> Column:
    return F.transform(entries, lambda p: A.pair(p["key"], p["value"].cast("string")))


def json_bag(raw: Column, depth: int | None = None) -> Column:
    """Flat attributes of a JSON object, however deep, or with objects below ``depth`` as JSON text."""
    return A.dedup(_pairs(_json_entries(raw, depth)))


def par_json(raw: Column | str, options: dict | None = None) -> Column:
    """Flattened JSON object, or the array text under ``items``; message, host and service are texts, never numbers or lists."""
    depth = (options or {}).get("depth")
    names = [*_MESSAGE, *_HOST, *_SERVICE]

    def of(line: Column, entries: Column) -> Column:
        bag = F.when(line.startswith("["), F.array(A.pair(F.lit("items"), line))).otherwise(A.dedup(_pairs(entries)))
        words = F.filter(entries, lambda p: F.lower(p["key"]).isin(names) & (F.schema_of_variant(p["value"]) == "STRING"))
        words = A.as_map(A.dedup(A.lowered(F.coalesce(_pairs(words), A.empty_bag()))))
        return let(words, lambda text: with_lower(F.coalesce(bag, A.empty_bag()), lambda bag, low: parsed(
            attrs=bag, message=A.first_of(text, _MESSAGE), event_time_raw=A.first_of(low, _TIME),
            host=A.first_of(text, _HOST), severity_raw=A.first_of(low, _LEVEL),
            service=A.first_of(text, _SERVICE),
            warnings=[F.when(~is_json(line), F.lit("json decode error"))])))

    return let(strip(raw), lambda line: let(
        F.when(~line.startswith("["), _json_entries(line, depth)), lambda entries: of(line, entries)))


# --- CEF -------------------------------------------------------------------------------------
# A version, six fields between bars, then the extension: keys, each with all up to the next key as its value.
_FIELD = r"\|([^|]*)"
_CEF = r"(?s)^CEF:(\d+)" + _FIELD * 6 + r"\|?(.*)$"
_KEY = r"[\w.]+"
_EXTENSION = rf"(?sU)(?<!\S)({_KEY})=((?:(?!\s{_KEY}=).)*)"


def _unescape(value: Column) -> Column:
    """Backslash escapes: n and r are line ends, any other character stands for itself."""
    marked = F.replace(value, F.lit("\\\\"), F.lit("\x00"))
    marked = F.replace(marked, F.lit("\\n"), F.lit("\n"))
    marked = F.replace(marked, F.lit("\\r"), F.lit("\r"))
    marked = F.regexp_replace(marked, r"\\(.)", "$1")
    return F.when(value.contains("\\"), F.replace(marked, F.lit("\x00"), F.lit("\\"))).otherwise(value)


def par_cef(raw: Column | str, options: dict | None = None) -> Column:
    """Seven-field header and a key=value extension whose values may hold spaces."""
    return let(strip(raw), _cef_of)


def _cef_of(line: Column) -> Column:

    def g(n: int) -> Column:
        return F.regexp_extract(line, _CEF, n)

    ext = let(g(8), lambda x: F.zip_with(
        F.regexp_extract_all(x, F.lit(_EXTENSION), F.lit(1)),
        F.regexp_extract_all(x, F.lit(_EXTENSION), F.lit(2)),
        lambda k, v: A.pair(k, _unescape(strip(v)))))
    head = F.array(
        A.pair(F.lit("cef.version"), g(1)), A.pair(F.lit("device.vendor"), g(2)),
        A.pair(F.lit("device.product"), g(3)), A.pair(F.lit("device.version"), g(4)),
        A.pair(F.lit("cef.signature_id"), g(5)), A.pair(F.lit("cef.name"), g(6)))
    ok = line.rlike(r"(?s)^CEF:\d+\|(?:[^|]*\|){5}")
    return F.when(ok, let(A.dedup(F.concat(head, ext)), lambda bag: parsed(
        attrs=bag, vendor=g(2), product=g(3), severity_raw=g(7),
        message=F.coalesce(_first(bag, "msg"), g(6)),
        event_time_raw=F.coalesce(_first(bag, "rt"), _first(bag, "start")),
    ))).otherwise(parsed(warnings=[F.lit("CEF header not found")]))


def _first(bag: Column, key: str) -> Column:
    """Non-empty value of an exact key."""
    return present(F.get(F.filter(bag, lambda p: p["key"] == key), 0)["value"])


# --- LEEF ------------------------------------------------------------------------------------
# A version, four fields, then attributes, before which their separator may be named: itself or its number.
_LEEF = r"(?s)^LEEF:(\d+\.\d+)" + _FIELD * 4 + r"\|(.*)$"
_SEP = r"^sep=(\S|0x[\da-fA-F]{1,2})\|"


def _hex_unescape(text: Column) -> Column:
    """``\\xHH`` to the character it names."""
    parts = F.split(text, r"\\x(?=[0-9a-fA-F]{2})")
    decoded = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(
        F.char(F.conv(F.substring(p, 1, 2), 16, 10).cast("bigint")), F.substring(p, 3, 1 << 30))))
    return F.array_join(decoded, "")


def par_leef(raw: Column | str, options: dict | None = None) -> Column:
    """Five-field header; pairs separated by a tab or by the separator named in ``sep=``."""
    return let(strip(raw), _leef_of)


def _leef_of(line: Column) -> Column:

    def g(n: int) -> Column:
        return F.regexp_extract(line, _LEEF, n)

    def separator(named: Column) -> Column:
        return (F.when(named == "", F.lit("\t"))
                .when(F.lower(named).startswith("0x"),
                      F.char(F.conv(F.substring(named, 3, 2), 16, 10).cast("bigint")))
                .otherwise(named))

    def split_pairs(body: Column, sep: Column) -> Column:
        body = F.when(~body.contains(sep) & body.rlike(r"\\x[0-9a-fA-F]{2}"),
                      _hex_unescape(body)).otherwise(body)
        parts = F.filter(F.split(F.replace(body, sep, F.lit("\x00")), "\x00"), lambda p: p.contains("="))
        return F.transform(parts, lambda p: A.pair(
            strip(F.substring_index(p, "=", 1)),
            strip(F.substring(p, F.instr(p, "=") + 1, F.length(p)))))

    pairs = let(g(6), lambda rest: let(separator(F.regexp_extract(rest, _SEP, 1)), lambda sep: let(
        F.regexp_replace(rest, _SEP, ""), lambda body: split_pairs(body, sep))))
    head = F.array(
        A.pair(F.lit("leef.version"), g(1)), A.pair(F.lit("device.vendor"), g(2)),
        A.pair(F.lit("device.product"), g(3)), A.pair(F.lit("leef.product_version"), g(4)),
        A.pair(F.lit("leef.event_id"), g(5)))
    return F.when(line.rlike(r"(?s)^LEEF:\d+\.\d+\|(?:[^|]*\|){4}"), let(
        A.dedup(F.concat(head, pairs)), lambda bag: parsed(
            attrs=bag, vendor=g(2), product=g(3), severity_raw=_first(bag, "sev"),
            message=F.coalesce(_first(bag, "msg"), _first(bag, "name"), g(5)),
            event_time_raw=_first(bag, "devTime"),
        ))).otherwise(parsed(warnings=[F.lit("LEEF header not found")]))


# --- key=value -------------------------------------------------------------------------------
_PAIR = r"""(?U)(?<![\w])([A-Za-z_][\w.\-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s,;]+))"""


def _pairs_in(raw: Column) -> Column:
    """All texts of the pair pattern. Classes of all alphabets are slow, and in plain ASCII they match what the short ones do."""
    return F.when(F.octet_length(raw) == F.length(raw), F.regexp_extract_all(raw, F.lit(_PAIR.removeprefix("(?U)")), F.lit(0))).otherwise(
        F.regexp_extract_all(raw, F.lit(_PAIR), F.lit(0)))


def kv_count(raw: Column, options: dict | None = None) -> Column:
    pattern = (options or {}).get("pattern")
    if pattern:
        return F.size(F.regexp_extract_all(raw, F.lit(pattern), F.lit(0)))
    return F.when(raw.contains("="), F.size(_pairs_in(raw))).otherwise(F.lit(0))


def kv_bag(raw: Column, options: dict | None = None) -> Column:
    custom = (options or {}).get("pattern")
    if custom:
        n = re.compile(custom).groups
        cols = [F.regexp_extract_all(raw, F.lit(_java(custom)[0]), F.lit(i)) for i in range(1, n + 1)]
        zipped = F.arrays_zip(*[x.alias(f"g{i}") for i, x in enumerate(cols)])
        pairs = F.transform(zipped, lambda z: A.pair(
            z["g0"], F.coalesce(*[present(z[f"g{i}"]) for i in range(1, n)], F.lit(""))))
        return A.dedup(pairs)

    def split_pair(m: Column) -> Column:
        at = F.instr(m, "=")

        def unquote(v: Column) -> Column:
            quoted = (F.length(v) >= 2) & v.rlike(r"""(?s)^(?:".*"|'.*')$""")
            return F.when(quoted, F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)

        return A.pair(strip(F.substring(m, F.lit(1), at - 1)),
                      let(strip(F.substring(m, at + 1, F.length(m))), unquote))

    return A.dedup(F.transform(_pairs_in(raw), split_pair))


def par_kv(raw: Column | str, options: dict | None = None) -> Column:
    """key=value pairs with double-quoted, single-quoted or bare values."""
    raw = c(raw)
    return with_lower(kv_bag(raw, options), lambda bag, low: parsed(
        attrs=bag,
        message=A.first_of(low, keys_of("message")[::-1]),
        event_time_raw=A.first_of(low, keys_of("event_time")[::-1]),
        warnings=[F.when(F.size(bag) == 0, F.lit("no key=value pairs found"))]))


# --- CSV -------------------------------------------------------------------------------------
DELIMITERS = [",", ";", "\t", "|"]


def _count(raw: Column, mark: str) -> Column:
    return F.length(raw) - F.length(F.replace(raw, F.lit(mark), F.lit("")))


def csv_delimiter(raw: Column) -> Column:
    """The most frequent of the four delimiters, NULL if none occurs."""
    best = F.array_max(F.array(*[
        F.struct(_count(raw, d).alias("n"), F.lit(-i).alias("o"), F.lit(d).alias("d"))
        for i, d in enumerate(DELIMITERS)]))
    return F.when(best["n"] > 0, best["d"])


def csv_row(row: Column, delimiter: Column, quote: str = '"') -> Column:
    """Fields of one row. Even pieces between quotes are bare text, where the separator counts;
    a doubled quote inside a quoted field is one quote."""
    q = F.lit(quote)
    guarded = F.replace(row, F.lit(quote * 2), F.lit("\x01"))
    pieces = F.split(guarded, re.escape(quote))
    marked = F.array_join(F.transform(pieces, lambda p, i: F.when(
        i % 2 == 0, F.replace(p, delimiter, F.lit("\x00"))).otherwise(p)), "")
    fields = F.transform(F.split(marked, "\x00"), lambda f: F.when(
        f == "\x01", F.lit("")).otherwise(F.replace(f, F.lit("\x01"), q)))
    return F.when(row.contains(quote), fields).otherwise(
        F.split(F.replace(row, delimiter, F.lit("\x00")), "\x00"))


def par_csv(raw: Column | str, options: dict | None = None) -> Column:
    """One delimited row with given columns, a header row, or ``col_i`` names."""
    raw = c(raw)
    o = options or {}
    quote = o.get("quotechar") or '"'
    delimiter = F.lit(o["delimiter"]) if o.get("delimiter") else F.coalesce(csv_delimiter(raw), F.lit(","))
    rows = F.filter(F.split(raw, r"\r\n|\r|\n"), lambda r: r != "")
    first = csv_row(F.get(rows, 0), delimiter, quote)
    columns = o.get("columns")
    if columns:
        bag = let(first, lambda row: F.array(*[
            A.pair(F.lit(str(name)), F.coalesce(F.get(row, i), F.lit("")))
            for i, name in enumerate(columns)]))
    else:
        bag = F.transform(first, lambda v, i: A.pair(F.concat(F.lit("col_"), i.cast("string")), v))
    if o.get("has_header"):
        second = csv_row(F.get(rows, 1), delimiter, quote)
        headed = F.filter(F.zip_with(first, second, lambda k, v: A.pair(strip(k), v)),
                          lambda p: p["value"].isNotNull() & p["key"].isNotNull())
        bag = F.when(F.size(rows) > 1, headed).otherwise(bag)
    return with_lower(F.coalesce(A.dedup(bag), A.empty_bag()), lambda bag, low: parsed(
        attrs=bag, message=A.first_of(low, ["msg", "message", "text"]),
        event_time_raw=A.first_of(low, keys_of("event_time")),
        warnings=[F.when(F.size(rows) == 0, F.lit("empty csv row"))]))


# --- XML -------------------------------------------------------------------------------------
_TOKEN = r"(?s)<!\[CDATA\[.*?\]\]>|<!--.*?-->|<\?.*?\?>|<![^>]*>|<[^>]+>|[^<]+"
_ATTRIBUTE = r"""(?s)([^\s=/<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)')"""
_STATE = "struct<path:array<string>,seen:array<struct<key:string,value:string>>>"


def _entities(text: Column) -> Column:
    plain = text
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return F.when(plain.contains("&"), text).otherwise(plain)


def _local(name: Column) -> Column:
    return F.when(name.contains(":"), F.regexp_replace(name, r"^[^:]*:", "")).otherwise(name)


def _tag_attributes(t: Column) -> Column:
    """Local names and values of the attributes of a tag; each pattern runs once."""
    found = F.struct(*[F.regexp_extract_all(t, F.lit(_ATTRIBUTE), F.lit(n)).alias(k)
                       for n, k in enumerate(("name", "double", "simple"), start=1)])
    listed = let(found, lambda x: F.transform(x["name"], lambda n, i: A.pair(
        _local(n), _entities(F.coalesce(present(F.get(x["double"], i)), F.get(x["simple"], i))))))
    return F.when(t.contains("="), listed).otherwise(A.empty_bag())


def _token(t: Column) -> Column:
    """What a tag or text adds to the fold, found before it so that no step searches twice."""
    tag = t.startswith("<")
    opening, closing = tag & ~t.startswith("</") & ~t.startswith("<!"), t.startswith("</")
    cdata = F.regexp_extract(t, r"(?s)^<!\[CDATA\[(.*)\]\]>$", 1)
    text = strip(F.when(t.startswith("<![CDATA["), cdata).otherwise(_entities(t)))
    return F.struct(
        opening.alias("opening"), closing.alias("closing"), t.endswith("/>").alias("single"),
        F.when(opening, _local(F.regexp_extract(t, r"^<([^\s/>]+)", 1))).alias("name"),
        F.when(opening, _tag_attributes(t)).alias("attrs"), F.when(~opening & ~closing, text).alias("text"))


def xml_bag(raw: Column) -> Column:
    """Elements below the root as dotted paths, attributes as ``path@name``.

    One fold over the tags and texts of the document keeps the open element path. A path with
    several texts becomes a JSON list of them.
    """
    tokens = F.transform(F.filter(
        F.regexp_extract_all(raw, F.lit(_TOKEN), F.lit(0)),
        lambda t: F.when(t.startswith("<"), ~t.startswith("<?") & (~t.startswith("<!") | t.startswith("<![CDATA")))
        .otherwise(strip(t) != "")), _token)

    def dotted(path: Column) -> Column:
        below = F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0)))
        return F.when(F.size(path) == 1, F.get(path, 0)).otherwise(F.array_join(below, "."))

    def step(acc: Column, t: Column) -> Column:
        inside = F.concat(acc["path"], F.array(t["name"]))
        attrs = F.filter(F.transform(t["attrs"], lambda p: A.pair(
            F.concat(dotted(inside), F.lit("@"), p["key"]), p["value"])), lambda p: ~p["key"].contains("@xmlns"))
        return F.struct(
            F.when(t["opening"] & ~t["single"], inside)
            .when(t["closing"], F.slice(acc["path"], 1, F.greatest(F.size(acc["path"]) - 1, F.lit(0))))
            .otherwise(acc["path"]).alias("path"),
            F.when(t["opening"] & (F.size(t["attrs"]) > 0), F.concat(acc["seen"], attrs))
            .when(t["opening"] | t["closing"] | (F.size(acc["path"]) < 2) | (t["text"] == ""), acc["seen"])
            .otherwise(F.concat(acc["seen"], F.array(A.pair(dotted(acc["path"]), t["text"])))).alias("seen"),
        )

    start = F.struct(F.array().cast("array<string>").alias("path"), A.empty_bag().alias("seen")).cast(_STATE)

    def listed(seen: Column) -> Column:
        once = F.array_distinct(F.transform(seen, lambda p: p["key"]))

        def merged(k: Column) -> Column:
            values = F.transform(F.filter(seen, lambda p: p["key"] == k), lambda p: p["value"])
            return A.pair(k, let(values, lambda v: F.when(
                F.size(v) == 1, F.get(v, 0)).otherwise(F.to_json(v))))

        return F.when(F.size(once) == F.size(seen), seen).otherwise(F.transform(once, merged))

    return let(F.aggregate(tokens, start, step, lambda acc: acc["seen"]), listed)


def par_xml(raw: Column | str, options: dict | None = None) -> Column:
    """Flattened XML; the message is the first six plain values."""
    line = strip(raw)

    def result(ok: Column, bag: Column, low: Column) -> Column:
        plain = F.filter(bag, lambda p: ~p["value"].startswith('["'))
        words = F.array_join(F.transform(F.slice(plain, 1, 6), lambda p: p["value"]), " ")
        return parsed(
            attrs=bag, message=words,
            event_time_raw=A.first_of(low, ["timestamp", "eventtime", "time", "date", "datetime"]),
            warnings=[F.when(~ok, F.lit("xml parse error"))])

    return let(is_xml(line), lambda ok: with_lower(
        F.when(ok, xml_bag(line)).otherwise(A.empty_bag()), lambda bag, low: result(ok, bag, low)))


# --- configured regex ------------------------------------------------------------------------
_TIME_GROUPS = ["time", "ts", "date", "timestamp", "datetime", "clock"]


def _java(pattern: str, case_insensitive: bool = False) -> tuple[str, dict[str, int]]:
    """A pattern with its named groups numbered; Java names allow no underscore."""
    names = re.compile(pattern).groupindex
    plain = re.sub(r"\(\?P<\w+>", "(", pattern)
    return ("(?i)" if case_insensitive else "") + plain, dict(names)


def regex_patterns(options: dict | None) -> list[tuple[str, dict[str, int]]]:
    o = options or {}
    pats = list(o.get("patterns") or [])
    if o.get("pattern"):
        pats = [o["pattern"], *pats]
    return [_java(p, bool(o.get("case_insensitive"))) for p in pats]


def par_regex(raw: Column | str, options: dict | None = None) -> Column:
    """First pattern that matches; its named groups are the attributes."""
    raw = c(raw)
    out = None
    for pattern, names in regex_patterns(options):
        def g(name: str, pattern=pattern, names=names) -> Column:
            return group(raw, pattern, names[name]) if name in names else F.lit(None).cast("string")

        bag = _named(*[(n, g(n)) for n in names])
        time_group = next((n for n in _TIME_GROUPS if n in names), None)
        extra = [("syslog.tag", g("tag"))] if "tag" in names and "syslog.tag" not in names else []
        bag = _named(*[(n, g(n)) for n in names], *extra) if extra else bag
        value = parsed(
            attrs=bag,
            message=F.coalesce(g("msg"), g("message"), strip(raw)),
            event_time_raw=g(time_group) if time_group else F.lit(None),
            host=F.coalesce(g("host"), g("hostname"), g("devname")),
            pri=F.regexp_replace(g("pri"), r"^[<>]+|[<>]+$", "").try_cast("int"))
        out = F.when(raw.rlike(pattern), value) if out is None else out.when(raw.rlike(pattern), value)
    nothing = parsed(warnings=[F.lit("no configured regex matched")])
    return nothing if out is None else out.otherwise(nothing)


def safe(result: Column, raw: Column | str) -> Column:
    """A failed extraction degrades to the plain line and says so (par_safe).

    Extractors use ``try_`` functions only, so failing means a NULL struct.
    """
    plain = par_plain(raw).withField("warnings", F.array(F.lit("extraction failed, kept as text")))
    return F.coalesce(result, plain)


EXTRACTORS = {
    "syslog": par_syslog, "json": par_json, "cef": par_cef, "leef": par_leef, "kv": par_kv,
    "csv": par_csv, "xml": par_xml, "regex": par_regex, "plain": par_plain, "text": par_plain,
}
__all__ = ["EXTRACTORS", "PARSED", "RFC5424_HEAD", "first_present", "safe", "parsed"]
