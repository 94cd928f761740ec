"""Extraction and normalization of hand-written lines."""

from pyspark.sql import functions as F

from logspark.operators.extract import EXTRACTORS
from logspark.operators.normalize import normalize_logs
from logspark.operators.select import parse_chain, select_parser
from logspark.operators.specs import Spec, as_specs
from logspark.plans import profile
from logspark.plans.profile import inspect, profile_parsers

import pytest


def parse(spark, fmt, line, options=None):
    r = spark.createDataFrame([(line,)], "raw string").select(EXTRACTORS[fmt]("raw", options).alias("p")).first().p
    return r, {a.key: a.value for a in r.attrs}


def test_last_value_first_place(spark):
    r, _ = parse(spark, "kv", "a=1 b=2 a=3")
    assert [(a.key, a.value) for a in r.attrs] == [("a", "3"), ("b", "2")]


def test_json_nesting_and_order(spark):
    r, a = parse(spark, "json", '{"z": 1, "m": {"k": {"d": true}, "l": [1, 2]}, "s": "{\\"q\\":1}", "n": null}')
    assert [x.key for x in r.attrs] == ["z", "m.k.d", "m.l", "s", "n"]
    assert a["m.k.d"] == "true" and a["m.l"] == "[1,2]" and a["s"] == '{"q":1}' and a["n"] is None


def test_json_texts_only_where_texts_are_meant(spark):
    r, _ = parse(spark, "json", '{"Message": 5, "text": "real {{{ text", "host": ["a"], "hostname": "h", "service": {"name": "x"}, "logger": "l", "level": 3}')
    assert (r.message, r.host, r.service, r.severity_raw) == ("real {{{ text", "h", "l", "3")
    r, _ = parse(spark, "json", "[1, 2]")
    assert r.message is None


def test_headers_of_both_syslog_shapes(spark):
    r, _ = parse(spark, "syslog", r'<34>1 2024-01-01T00:00:00Z h app 7 ID [a b="x ] \" y"][c d="e"] the message')
    assert r.host == "h" and r.pri == 34 and r.message == "the message"
    r, _ = parse(spark, "syslog", "Jan  2 03:04:05 gw sshd[42]: hello there")
    assert r.host == "gw" and r.message == "hello there"


def test_cef_spaces_and_escapes(spark):
    r, a = parse(spark, "cef", r"CEF:0|V|P|1|9|name|7|src=1.2.3.4 msg=two words \= yes act=deny")
    assert a["msg"] == "two words = yes" and a["act"] == "deny" and r.message == "two words = yes"


def test_leef_separator(spark):
    _, a = parse(spark, "leef", "LEEF:2.0|V|P|1|9|sep=^|src=1.2.3.4^dst=5.6.7.8^x=a=b")
    assert a["src"] == "1.2.3.4" and a["x"] == "a=b"


def test_csv_quotes(spark):
    _, a = parse(spark, "csv", 'a,"b, ""c""",d')
    assert list(a.values()) == ["a", 'b, "c"', "d"]


def test_xml_nesting(spark):
    _, a = parse(spark, "xml", '<e id="1"><h n="x">A &amp; B</h><g><k>1</k></g><r>1</r><r>2</r></e>')
    assert a["h"] == "A & B" and a["h@n"] == "x" and a["g.k"] == "1" and a["r"] == '["1","2"]'


@pytest.mark.parametrize("fmt", ["syslog", "json", "cef", "leef", "kv", "csv", "xml", "plain"])
def test_bad_input_never_fails(spark, fmt):
    bad = ["", "  ", "\x00", "{", "CEF:0|", "LEEF:1.0|", "<1>", "<a><b>", "=", '"', "a=\"", "é=5"]
    df = spark.createDataFrame([(x,) for x in bad], "raw string")
    assert df.select(EXTRACTORS[fmt]("raw").alias("p")).filter("p IS NULL").count() == 0


def test_lossless_and_spec_order(spark):
    spec = as_specs([{
        "id": "s", "format": "kv", "match": {"any": [{"contains": "k="}]}, "mapping": {"message": {"src": "k"}},
        "derived": [{"when": "^(?P<w>[a-z]+)", "set": {"action": {"value": "w", "type": "upper"}}},
                    {"when": "stop", "set": {"action": "deny"}}], "constants": {"category": "c"}}])
    lines = ["k=go x=1", "k=stop x=1", "free text é \t", "<34>Oct 11 22:14:15 h1 su[3]: user=bob src=10.0.0.1"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no bigint, raw string")
    out = {r.raw: r for r in normalize_logs(df, spec, year=2024).collect()}
    assert sorted(out) == sorted(lines)
    assert out[lines[0]].ues.action == "GO" and out[lines[1]].ues.action == "deny"
    syslog = out[lines[3]]
    assert syslog.meta.parser_chain == ["kv"] and syslog.ues.source.ip == "10.0.0.1" and syslog.ues.user.name == "bob"
    assert syslog.ues.severity_label == "critical" and str(syslog.ues.event_time) == "2024-10-11 22:14:15"


def test_duplicate_spec_ids_are_refused():
    with pytest.raises(ValueError):
        as_specs([{"id": "a"}, {"id": "a"}])
    assert Spec.of({"id": "a", "taxonomy": {"type": {"value": "x"}}}).lint()


def test_inspect_parses_a_line_once(spark):
    lines = ["a=1 b=2 a=3", "free text", None, '{"time": "2024-01-01T00:00:00Z", "k": 1}', "<34>Oct 11 22:14:15 h1 su[3]: user=bob src=10.0.0.1"]
    df = spark.createDataFrame([(x,) for x in lines], "raw string")
    profile = inspect(df, (), 2024)
    # The lines are read by one branch; the other row holds the zeros of an empty table.
    plan = profile._sc._jvm.PythonSQLUtils.explainString(profile._jdf.queryExecution(), "simple")
    assert sum("ExistingRDD" in x for x in plan.splitlines()) == 1
    got = {(r.section, r.item): r.n for r in profile.collect()}
    assert {k: n for k, n in got.items() if k[0] in ("format", "time")} == {
        ("format", "kv"): 1, ("format", "text"): 1, ("format", "empty"): 1, ("format", "json"): 1, ("format", "syslog"): 1,
        ("time", "timestamps"): 2, ("time", "total"): 5}
    assert sum(n for k, n in got.items() if k[0] == "parser") == 5
    assert {k[1]: n for k, n in got.items() if k[0] == "field"} == {
        x: 1 for x in ("a", "b", "time", "k", "syslog.tag", "syslog.pid", "user", "src")}
    assert sorted((r.section, r.item, r.n) for r in inspect(df.limit(0), (), 2024).collect()) == [("time", "timestamps", 0), ("time", "total", 0)]


def test_parser_counts_need_no_extraction_of_other_formats(spark):
    lines = ["<a><b>1</b></a>", '{"k": 1}', "<34>Oct 11 22:14:15 h1 su[3]: user=bob src=10.0.0.1", "<34>Oct 11 22:14:15 h1 su[3]: ", None]
    parsed = parse_chain(spark.createDataFrame([(x,) for x in lines], "raw string"), as_specs([{"id": "s", "format": "syslog", "match": {"any": [{"contains": "su[3]"}]}}]))
    counts = profile_parsers(parsed)
    plan = counts._sc._jvm.PythonSQLUtils.explainString(counts._jdf.queryExecution(), "extended").partition("== Optimized")[2]
    assert plan and "_outer" not in plan
    assert {r.parser: r.n for r in counts.collect()} == {"xml": 1, "json": 1, "s": 2, "plain": 1}
    assert [(r.parsed.sub_raw, r.parser_chain) for r in parsed.collect() if r.spec == "s"][0] == ("user=bob src=10.0.0.1", ["kv"])


# --- what is found once ----------------------------------------------------------------------
_WHO = {"id": "who", "format": "kv", "match": {"any": [{"contains": "who="}]},
        "mapping": {"source.port": {"src": "port", "type": "int"}},
        "derived": [{"when": "^(?P<verb>[a-z]+)ed by", "field": "raw", "set": {"action": {"value": "verb"}, "type": "deed"}}]}


def _plan(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def test_choice_searches_pairs_once(spark):
    """built-in and configured candidates share one search for pairs and one reading as XML."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    df = spark.createDataFrame([("who=a port=7",), ("<a><b>1</b></a>",), (None,), ("",), ("a,b,c",)], "raw string")
    picked = select_parser(df, as_specs([_WHO]))
    assert _plan(picked).count("regexp_extract_all") == 2  # one for ASCII, one for all alphabets
    assert _plan(picked).count("from_xml") == 1
    assert [(r.parser, r.spec) for r in picked.select("pick.parser", "pick.spec").collect()] == [
        ("kv", "who"), ("xml", None), (None, None), (None, None), ("csv", None)]


def test_coverage_extracts_won_lines_only(spark, monkeypatch):
    """a line that no spec has won is not extracted, as nothing counts it."""
    def guarded(raw, parser, spec, specs, real=profile.extract_with):
        return F.when(spec.isNull(), F.raise_error(F.lit("extracted for nothing"))).otherwise(real(raw, parser, spec, specs))

    monkeypatch.setattr(profile, "extract_with", guarded)
    df = spark.createDataFrame([("who=a port=7",), ('{"a": 1}',), ("words",), (None,)], "raw string")
    row = profile.spec_coverage(df, as_specs([_WHO])).first()
    assert (row.lines, row.matched, row.won, row.extracted, row.with_warnings) == (4, 1, 1, 1, 0)


def test_spec_values_are_converted_once(spark):
    """fields, lineage and warnings read one conversion; what the spec has filled is not inferred again."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    df = spark.createDataFrame([("opened by who=a port=7 srcport=9 user=x", 1), ("closed who=b port=y srcport=8", 2)], "raw string, line_no long")
    out = normalize_logs(df, as_specs([_WHO]))
    # Two targets ask whether the rule matches, and one takes its group, if that is not empty.
    assert _plan(out).count("^([a-z]+)ed by") <= 4
    rows = out.orderBy("raw").select("ues.action", "ues.source.port", "ues.user.name", F.size("meta.warnings").alias("w"),
                                     F.transform("trace.lineage", lambda x: x["normalized_field"]).alias("l")).collect()
    assert (rows[1].action, rows[1].port, rows[1].name) == ("open", 7, "x")
    assert sorted(rows[1].l) == ["action", "source.port", "type", "user.name"]
    # The mapped port does not convert, so the next attribute of that target fills it.
    assert (rows[0].action, rows[0].port, rows[0].l) == (None, 8, ["source.port"])
