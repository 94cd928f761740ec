"""Scalar functions against Python's own rules and hand-written cases."""

import ipaddress

from pyspark.sql import functions as F

from logspark.functions import convert as K, ip as I, severity as S, timestamps as T


def rows(spark, values, **cols):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return {r.v: r for r in df.select("v", *[c.alias(n) for n, c in cols.items()]).collect()}


def test_addresses_follow_the_standard_library(spark):
    texts = ["10.0.0.1", "2001:0DB8:0:0:0::1", "::", "::1", "fe80::", "1:2:3:4:5:6:7:8", "1::3:0:0:4:5:6",
             "1:0:0:2:0:0:0:3", "fe80::1%eth0", "10.0.0.01", "1::2::3", "12345::", "x", "1:2:3:4:5:6:7", "256.1.1.1",
             "2606:4700::f", "203.0.113.9", "8.8.8.8", "192.0.0.9", "100.64.0.1", "224.0.0.1", ":::", "1:2:3:4:5:6:7::"]
    got = rows(spark, texts, c=I.ip_canonical("v"), h=I.ip_v6_hex("v"), n=I.ip_v4_num("v"), i=I.ip_internal("v"))
    for text in texts:
        try:
            a = ipaddress.ip_address(text)
        except ValueError:
            assert got[text].c is None and got[text].i is None, text
            continue
        inside = a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_reserved
        assert got[text].c == str(a) and got[text].i == inside, text
        assert (got[text].n == int(a)) if a.version == 4 else (got[text].h == f"{int(a):032x}")


def test_timestamps(spark):
    cases = {
        "1704067200": 1704067200000, "1704067200123": 1704067200123, "1704067200123456": 1704067200123,
        "1704067200123456789": 1704067200123, "2024-01-01T00:00:00.5Z": 1704067200500, "2024-01-01": 1704067200000,
        "2024-01-01 00:00:00,250": 1704067200250, "Jan  1 00:00:00": 1704067200000,
        "01/Jan/2024:01:00:00 +0100": 1704067200000, "20240101000000": 1704067200000, "junk": None, "-": None, "": None}
    got = rows(spark, list(cases), ms=F.unix_millis(T.parse_ts("v", 2024)))
    assert {k: r.ms for k, r in got.items()} == cases


def test_severity_aliases_and_numbers(spark):
    cases = {"emerg": ("critical", 90), "err": ("high", 70), "WARN": ("medium", 50), "notice": ("info", 10),
             "dbg": ("debug", 5), "0": ("info", 0), "3": ("info", 3), "5": ("low", 5), "7": ("medium", 7),
             "9": ("high", 9), "10": ("critical", 10), "11": ("info", 11), "100": ("critical", 100), "junk": (None, None)}
    got = rows(spark, list(cases), s=S.severity_ues("v"))
    assert {k: (r.s.label, r.s.number) for k, r in got.items()} == cases


def test_conversion(spark):
    got = rows(spark, ["12.9", "7", "x", ""], i=K.convert("v", "int"), f=K.convert("v", "float"))
    assert [got[k].i for k in ("12.9", "7", "x", "")] == [12, 7, None, None]
    assert got["x"].f is None
