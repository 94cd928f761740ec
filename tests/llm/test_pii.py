"""Personal data: plain spans against a plain version, disguised ones against what was hidden."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from logspark.llm import catalog, pii
from tests.llm import odd

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    """The base rules word by word."""
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(map(int, m.group().split("."))) > 255:
                continue
            if kind == "card":
                doubled = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))]
                if not 12 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, kind, m.end()))
    return [(kind, s, e) for s, k, kind, e in sorted(out)]


def soup(draw, n):
    parts = ["a", "b.c", "@", "@d.e", ".", "-", " ", "+", "(", ")", "%", "1", "12", "255", "256", "1.2.3.4", "4111 1111 1111 1111",
             "4111111111111111", "+1 (017) 555-7713", "é", "中", "\n", "x@y.zz", "_", "000", "one", " at ", " dot ", "[at]", "(dot)", "&#64;"]
    return "".join(draw.choice(parts) for _ in range(n))


def test_plain_spans_are_the_base_rules():
    draw, finder = random.Random(5), pii._finder()
    for _ in range(4000):
        text = soup(draw, draw.randint(0, 40))
        assert [s[:3] for s in pii.spans(text, finder) if not s[3]] == plain(text), text


@pytest.mark.parametrize("kind,text", [
    ("email", "mail <john at example dot com> now"), ("email", "x <john [at] example [dot] com>."), ("email", "<jоhn.doe@exаmple.com>"),
    ("email", "<john.smith&#64;example&#46;org>"), ("email", "<j​ohn@exam​ple.com>"), ("email", "é <john_at_example_dot_com>"),
    ("email", "<john(AT)example(DOT)co(dot)uk>"), ("email", "write to <john @ example.com>"), ("email", "<ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ>"),
    ("phone", "call <plus one (four one five) five five five, two six seven one> ok"), ("phone", "<＋1 415 555 2671>"),
    ("phone", "<+1 five five five - 0 1 2 - three four five six>."), ("ip", "<one nine two dot one six eight dot one dot one>."),
    ("ip", "<192[.]168[.]1[.]1>"), ("ip", "host <10 dot 0 dot 0 dot 1>!"), ("card", "中 <４１１１ １１１１ １１１１ １１１１>"),
    ("card", "<four one one one one one one one one one one one one one one one>"), ("card", "<4111–1111–1111–1111>"),
    ("email", "at noon <anne.12 at mail4.example.com>, or"), ("card", "<4l11 1111 11I1 1111>"), ("ip", "<1O.0.0.1>"), ("phone", "<+1 (0l7) 555-77I3>"),
    ("phone", "<plus vier neun drei null eins zwei drei vier fünf sechs>"),
])
def test_disguises(kind, text):
    start, end = text.index("<"), text.index(">") - 1
    clean = text.replace("<", "", 1).replace(">", "", 1)
    assert (kind, start, end, True) in pii.spans(clean)


@pytest.mark.parametrize("text", ["look at google.com", "He is at work. Come", "meet me at example.org now", "size 10 l 5 and 3 I 4", "apples @ 3.50 each", "meet at noon dot", "one two three, four", "point one at two",
                                  "three plus 5", "(at home)", "Ça coûte 4 € à 10 h – d'accord", "null sechs eins sieben"])
def test_clean_texts_stay_clean(text):
    assert pii.spans(text) == []


def test_time_is_linear():
    for unit in ("x", "1", "1.", "@", "a@", "+1 ", "one ", " at a", "at_", "(at)", " ", "é@", "﻿", "1 -"):
        start = time.time()
        pii.spans(unit * (600_000 // len(unit)))
        assert time.time() - start < 10, unit


def test_way_back_through_edits():
    done = pii.Rewritten("aXXbYc", [(1, 3, "-"), (4, 5, "")])
    assert done.text == "a-bc" and done.back(0, 4) == (0, 6) and done.back(1, 2) == (1, 3) and done.back(3, 4) == (5, 6) and done.back(2, 3) == (3, 4)
    assert done.touched(0, 2) and not done.touched(2, 3) and done.touched(2, 4)


def test_query_and_awkward_tables(spark, tmp_path):
    texts = [None, "", "x@y.zz and +1 (017) 555-7713", "john at example dot com", "1.2.3.4 1.2.3.4", "4111 1111 1111 1111", odd.LONG, odd.UNBROKEN]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(2, texts[2], "clash"), (None, "a@b.c", None)]
    spark.createDataFrame(rows, "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.op13_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "a@b.c" if r.doc_id is None else texts[r.doc_id] or ""
        want = plain(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in want) for kind in BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert r.spans == ",".join(f"{k}:{s}:{e}" for k, s, e, _ in pii.spans(text))
    assert pii.find(odd.empty(spark)).count() == 0
    hidden = pii.find(odd.frame(spark, [(1, "é john at example dot com, a@b.cc!", *[None] * 7)])).select(pii.masked(F.col("text"), F.col("spans")).alias("t"))
    assert hidden.first().t == "é <email>, <email>!"
