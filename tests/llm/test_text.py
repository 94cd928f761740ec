"""Decontamination, near duplicates and quality rules against plain Python."""

import math
import random

import numpy as np

from logspark.llm import decontaminate, neardup, quality
from logspark.llm.common import read
from tests.llm import brute, odd

SF = "/root/testdata/sf0.001"


def leaks(docs, bench, **more):
    found = decontaminate.phrase_matches(docs, bench, **more)
    return sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"]), r["items"]) for r in found.collect()), key=str)


def plain(docs, bench, **more):
    import hashlib

    out = brute.contaminated(docs, bench, **more)
    return sorted(((d, w, h, n, s) for d, w, h, n, s, _ in out), key=str), hashlib


def same(spark, docs, bench):
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string, items string"), spark.createDataFrame(bench, "item_id long, text string, hits string"))
    want, hashlib = plain([d[:2] for d in docs], [b[:2] for b in bench])
    assert [(d, w, h, n, hashlib.sha256(",".join(i).encode()).hexdigest()) for d, w, h, n, i in got] == want
    return want


def test_windows_of_random_texts(spark):
    draw = random.Random(5)
    words = ["the", "a", "of", "red", "fox", "Zoë", "7", "x1"]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    bench = [(i, text(draw.choice([0, 1, 2, 3, 5])), "z") for i in range(6)] + [(i, text(draw.choice([10, 11, 14])), "z") for i in range(6, 12)]
    bench += [(None, text(3), "z"), (3, "twice the same", "z"), (3, "twice the same", "z"), (50, None, "z"), (51, "only here once", "z")]
    docs = [(i, text(draw.randint(0, 80)), "y") for i in range(40)]
    docs += [(100, text(30) + ", " + bench[8][1].upper() + "!" + text(5), "y"), (101, bench[9][1] + " " + bench[9][1], "y"), (None, bench[10][1], "y"),
             (None, None, "y"), (100, bench[11][1], "y"), (102, "twice the same", "y"), (102, "twice the same", "y")]
    assert any(n > 0 for _, _, n, _, _ in same(spark, docs, bench))


def test_odd_documents_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs far"), (2, odd.LONG)], "item_id long, text string")
    got = {(r.doc_id, r.n_hit > 0) for r in decontaminate.phrase_matches(odd.frame(spark), bench).collect()}
    assert {(5, True), (6, True), (100, True), (10, True), (None, False), (11, False)} <= got
    assert decontaminate.phrase_matches(odd.empty(spark), bench).count() == 0
    clean = decontaminate.phrase_matches(odd.frame(spark), bench.filter("false"))
    assert clean.filter("n_hit > 0").count() == 0 and clean.count() == len(odd.rows())


def test_proximity(spark):
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliet"
    docs = spark.createDataFrame([(1, item), (2, item.replace("delta", "delta big old")), (3, "alpha " + "z " * 40 + "juliet")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    found = decontaminate.proximity_matches(docs, bench, slop=3)
    keys = {r.k: r.doc_id for r in docs.select(decontaminate.doc_key("doc_id", "text").alias("k"), "doc_id").collect()}
    assert {keys[r.doc] for r in found.collect()} <= {1, 2} and 1 in {keys[r.doc] for r in found.filter("off = 0").collect()}


def linked(df, **more):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.deduplicate(df, **more).collect()), key=str)


def expected(docs):
    want = brute.near(docs)
    return sorted(((d, *want[d], d == want[d][1]) for d, _ in docs), key=str)


def test_near_duplicates_of_the_tables(spark):
    docs = read(spark, SF, "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert linked(docs) == expected(rows)


def test_near_duplicates_in_crowded_buckets(spark):
    """A common passage, a chain of near copies and exact copies, with every bucket of two or more treated as large."""
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join(passage + [word() for _ in range(draw.choice([15, 20, 60]))])) for i in range(60)]
    base = [word() for _ in range(120)]
    for i in range(60, 100):
        base = base[3:] + [word() for _ in range(3)]
        rows.append((i, " ".join(base)))
    rows += [(i, rows[70][1].upper()) for i in range(100, 105)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = expected(rows)
    assert linked(df, bucket=1) == want and linked(df) == want
    assert len({c for _, _, c, _ in want}) < 70


def test_near_duplicates_of_odd_rows(spark):
    got = linked(odd.frame(spark))
    by = [r for r in got if r[0] == 5]
    assert len(by) == 2 and by[0] == by[1] and len(got) == len(odd.rows())
    assert [r for r in got if r[0] in (0, 1, 2)] == [(0, 0, 0, True), (1, 0, 1, True), (2, 0, 2, True)]
    assert next(r for r in got if r[0] == 100)[2:] == (5 if next(r for r in got if r[0] == 6)[2] == 5 else 6, False)
    assert next(r for r in got if r[0] is None)[2:] == (None, True)
    assert neardup.deduplicate(odd.empty(spark)).count() == 0


def test_counts(spark):
    texts = [r[1] for r in odd.rows()] + ["a a a a a a", "a a a a a", "x | y ## <b>\n  \nx | y ## <b>"]
    for t in texts:
        assert quality.counts(t or "") == brute.counts(t)


def test_repeats_with_large_vocabularies():
    draw = random.Random(3)
    words = [str(draw.randint(0, 20_000)) for _ in range(30_000)]
    text = " ".join(words + words[100:140] + words[:7])
    assert quality.counts(text) == brute.counts(text)


def test_outliers_of_a_group(spark):
    """Base columns of odd rows; a few strange documents among many like ones are rejected, the others stay."""
    draw = random.Random(4)
    text = lambda n, sep=" ": sep.join("".join(draw.choice("abcdefg") for _ in range(draw.randint(2, 9))) for _ in range(n))
    good = [(i, text(draw.randint(20, 900)), "en", "s") for i in range(400)]
    bad = [(1000 + i, text(100, " ### $$$ %% "), "en", "s") for i in range(15)]
    few = [(2000 + i, text(60), "fr", "other") for i in range(5)]
    df = spark.createDataFrame(good + bad + few, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.judge(df).filter("kept").collect()}
    assert {r[0] for r in good} <= kept and not kept & {r[0] for r in bad} and {r[0] for r in few} <= kept
    odd_rows = quality.judge(odd.frame(spark)).collect()
    assert len(odd_rows) == len(odd.rows()) and all(not r.kept for r in odd_rows if r.doc_id in (0, 1, 2, 3, 8))
    assert quality.judge(odd.empty(spark)).count() == 0


def test_no_group_is_too_small_to_be_judged(spark):
    """One source or many, a handful of documents each: junk among them goes, prose stays."""
    draw = random.Random(6)
    text = lambda n, sep=" ": sep.join("".join(draw.choice("abcdefg") for _ in range(draw.randint(2, 9))) for _ in range(n))
    for size, sources in ((189, 1), (100, 20)):
        good = [(i, text(draw.randint(30, 500)), "en", f"s{i % sources}") for i in range(size)]
        bad = [(1000 + i, text(100, " ### $$$ %% "), "en", f"s{i % sources}") for i in range(size // 20)]
        df = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")
        kept = {r.doc_id for r in quality.judge(df).filter("kept").collect()}
        assert not kept & {r[0] for r in bad} and len(kept) >= 0.97 * len(good), (size, sources)


def test_near_copies_on_both_sides_of_the_bound(spark):
    """A group whose members are mostly under the similarity to each other, by small buckets, crowded ones, best partners first."""
    draw = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(260):
        words = list(base)
        for _ in range(draw.randint(0, 7)):
            words[draw.randrange(150)] = f"x{draw.randrange(400)}"
        docs.append((i, " ".join(words)))
    want = brute.near(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.deduplicate(df, bucket=3).collect()}
    assert got == want
    assert 5 < len({c for _, c in want.values()}) < 200


def test_symbols_between_words_are_outliers(spark):
    """'word | word | word' is rejected in a group of prose; nearly all the prose stays, one stray symbol included."""
    draw = random.Random(5)
    word = lambda lo, hi: "".join(draw.choice("abcdefg") for _ in range(draw.randint(lo, hi)))
    text = lambda n, sep=" ", lo=2, hi=9: sep.join(word(lo, hi) for _ in range(n))
    size = lambda: int(math.exp(draw.gauss(5.5, 0.8))) + 10
    good = [(i, text(size()) + " #" * (i % 100 == 0), "en", "s") for i in range(600)]
    bad = [(1000 + i, text(size(), " | ", 6, 12), "en", "s") for i in range(30)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.judge(df).filter("kept").collect()}
    assert not kept & {r[0] for r in bad} and len(kept) >= 597 and {i for i in range(0, 600, 100)} <= kept


def test_oracle_of_decontamination(spark):
    from logspark.llm.catalog import ORACLES, QUERIES
    from tests.oracle import compare, duck

    assert compare(spark, duck(SF), SF, "op3_decontaminate", QUERIES["op3_decontaminate"], ORACLES["op3_decontaminate"]) == ""


def test_prefixes_by_counts_in_cells(spark):
    """Every similar pair of different components shares a prefix, however many shingles share a cell; no join over all shingles."""
    draw = np.random.default_rng(5)
    common = draw.integers(0, 1 << 63, 40, "u8")
    sets = []
    for g in range(12):
        base = np.concatenate([common, draw.integers(0, 1 << 63, 60, "u8")])
        sets += [np.unique(np.concatenate([base[draw.random(100) > 0.08], draw.integers(0, 1 << 63, 3, "u8")])) for _ in range(4)]
    df = spark.createDataFrame([(i, len(s), s.tobytes()) for i, s in enumerate(sets)], "cls long, n long, shingles binary")
    comps = spark.createDataFrame([(0, 0), (1, 0)], "node long, comp long")
    want = {(i, j) for i in range(48) for j in range(i + 1, 48) if (i, j) != (0, 1)
            and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    for cells in (1, 8, 1 << 20):
        pairs = neardup.prefix_pairs(df, comps, cells)
        got = set(map(tuple, pairs.collect()))
        assert want and want <= got and (0, 1) not in got
    assert len(got) < 3 * len(want)
