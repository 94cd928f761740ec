"""IP addresses as plain string expressions; no Python on the data path."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, functions as F

from .base import any_of, c, let, let_sql, sql_text, strip

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"

# --- fixed values: address blocks that do not count as external ------------------------------
INTERNAL_V4 = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
    "224.0.0.0/4", "240.0.0.0/4",
]
EXTERNAL_V4 = ["192.0.0.9/32", "192.0.0.10/32"]
INTERNAL_V6 = [
    "::/8", "64:ff9b:1::/48", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "2001::/23",
    "2001:db8::/32", "2002::/16", "3fff::/20", "4000::/3", "6000::/3", "8000::/3", "a000::/3",
    "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fc00::/7", "fe00::/9", "fe80::/10", "ff00::/8",
]
EXTERNAL_V6 = ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48",
               "2001:20::/28", "2001:30::/28"]


_IS_V4 = f"s RLIKE {sql_text(f'^{_V4}$')}"
# IPv4 text in the lambda variable s to a number.
_V4_NUM = ("transform(array(split(s, '[.]')), p -> try_cast(p[0] AS bigint) * 16777216 + "
           "try_cast(p[1] AS bigint) * 65536 + try_cast(p[2] AS bigint) * 256 + try_cast(p[3] AS bigint))[0]")
_NUM = f"s -> CASE WHEN {_IS_V4} THEN {_V4_NUM} END"

# IPv6: a dotted tail becomes two groups, "::" is filled up, leading zeros go.
_TAIL = f"regexp_extract(b, {sql_text(f'({_V4})$')}, 1)"
_LOW = ("transform(array(" + _TAIL + "), t -> lower(CASE WHEN t = '' THEN b ELSE concat("
        "substr(b, 1, length(b) - length(t)), transform(array(split(t, '[.]')), p -> concat("
        "hex(cast(p[0] AS int) * 256 + cast(p[1] AS int)), ':', hex(cast(p[2] AS int) * 256 + cast(p[3] AS int))))[0]"
        ") END))[0]")


def _side(text: str) -> str:
    return f"transform(array({text}), h -> CASE WHEN h = '' THEN cast(array() AS array<string>) ELSE split(h, ':') END)[0]"


_FILLED = (f"transform(array(named_struct('l', {_side('substr(w, 1, instr(w, chr(58) || chr(58)) - 1)')}, "
           f"'r', {_side('substr(w, instr(w, chr(58) || chr(58)) + 2)')})), q -> CASE WHEN size(q.l) + size(q.r) < 8 "
           "THEN concat(q.l, array_repeat('0', greatest(8 - size(q.l) - size(q.r), 0)), q.r) END)[0]")
_WHOLE = f"transform(array({_LOW}), w -> CASE WHEN instr(w, '::') = 0 THEN split(w, ':') ELSE {_FILLED} END)[0]"
_GROUPS = (f"transform(array({_WHOLE}), g -> CASE WHEN size(g) = 8 AND forall(g, x -> x RLIKE '^[0-9a-f]{{1,4}}$') "
           "THEN transform(g, x -> regexp_replace(x, '^0+(?=.)', '')) END)[0]")
# The first longest run of two or more zero groups becomes "::".
_RUNS = " ".join(
    f"WHEN j RLIKE '^(.*?):0(?::0){{{n - 1}}}:(.*)$' THEN "
    f"regexp_replace(j, '^(.*?):0(?::0){{{n - 1}}}:(.*)$', '$1::$2')" for n in range(8, 1, -1))
_TEXT = (f"regexp_replace(regexp_replace(transform(array(concat(':', array_join({_GROUPS}, ':'), ':')), "
         f"j -> CASE {_RUNS} ELSE j END)[0], '^:(?!:)', ''), '(?<!:):$', '')")
_BARE = "transform(array(regexp_replace(s, '%[^%/]+$', '')), b -> {})[0]"
_CANON = (f"s -> CASE WHEN {_IS_V4} THEN s WHEN contains(s, ':') THEN concat({_BARE.format(_TEXT)}, "
          "regexp_extract(s, '%[^%/]+$', 0)) END")
_HEX32 = (f"s -> CASE WHEN contains(s, ':') THEN {_BARE.format(f'array_join(transform({_GROUPS}, x -> lpad(x, 4, chr(48))), chr(45))')} END")


def ip_v4_num(col: Column | str) -> Column:
    """IPv4 text to a LONG, NULL for anything else."""
    return let_sql(strip(c(col).cast("string")), _NUM)


def ip_canonical(col: Column | str) -> Column:
    """Canonical text of an IPv4 or IPv6 address, NULL if it is none (scl_ip)."""
    return let_sql(strip(c(col).cast("string")), _CANON)


def ip_version(col: Column | str) -> Column:
    return let(ip_canonical(col), lambda a: F.when(a.contains(":"), 6).when(a.isNotNull(), 4))


def ip_v6_hex(col: Column | str) -> Column:
    """IPv6 as 32 hex digits, whose text order is the numeric order; NULL for anything else."""
    return F.replace(let_sql(strip(c(col).cast("string")), _HEX32), F.lit("-"), F.lit(""))


def _in_v4(n: Column, blocks: list[str]) -> Column:
    nets = [ipaddress.ip_network(b) for b in blocks]
    return any_of(n.between(int(x.network_address), int(x.broadcast_address)) for x in nets)


def _in_v6(h: Column, blocks: list[str]) -> Column:
    nets = [ipaddress.ip_network(b) for b in blocks]
    return any_of(
        h.between(f"{int(x.network_address):032x}", f"{int(x.broadcast_address):032x}") for x in nets)


def ip_internal(col: Column | str) -> Column:
    """True for private, loopback, link-local, documentation, multicast and reserved addresses;
    NULL if the text is no address (scl_ip_internal)."""
    col = c(col)

    def v4(n: Column) -> Column:
        return F.when(n.isNotNull(), _in_v4(n, INTERNAL_V4) & ~_in_v4(n, EXTERNAL_V4))

    def v6(h: Column) -> Column:
        return F.when(h.isNotNull(), _in_v6(h, INTERNAL_V6) & ~_in_v6(h, EXTERNAL_V6))

    return F.when(col.contains(":"), let(ip_v6_hex(col), v6)).otherwise(let(ip_v4_num(col), v4))
