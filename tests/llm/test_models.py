"""Toxicity, language, sharding, transcripts and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logspark.llm import language, shards, toxicity, transcripts
from logspark.llm.common import read
from tests.llm import brute, odd

SF = "/root/testdata/sf0.001"


# --- toxicity ---------------------------------------------------------------------------------
def maximal(values):
    """All maximal scoring segments by definition: split at the best segment, again and again."""
    def find(lo, hi):
        best = None
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += values[b]
                if total > 1e-12 and (best is None or total > best[2] + 1e-9):
                    best = (a, b, total)
        if best is None:
            return []
        return find(lo, best[0]) + [best] + find(best[1] + 1, hi)
    return find(0, len(values))


def test_segments_are_the_maximal_ones():
    draw = random.Random(1)
    for _ in range(300):
        n = draw.randint(1, 24)
        at = sorted(draw.sample(range(n), draw.randint(0, n)))
        score = [draw.choice([1.3, 2.7, 4.1]) + draw.random() / 97 for _ in at]
        other = -draw.choice([0.31, 0.77, 2.03])
        values = [other] * n
        for i, s in zip(at, score):
            values[i] = s
        got, want = toxicity.segments(at, score, other), maximal(values)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for _, _, s in got], [s for _, _, s in want])


def planted(spark, n=600):
    draw = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        ws = [draw.choice(words) for _ in range(draw.randint(20, 200))]
        bad = i % 5 == 0
        for _ in range(3 if bad else 0):
            ws.insert(draw.randint(0, len(ws)), draw.choice(["idiot", "scum", "moron"]))
        rows.append((i, " ".join(ws)))
        labels.append((i, int(bad) if draw.random() > 0.03 else 1 - int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_planted_words_are_learned(spark):
    docs, labels = planted(spark)
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out()))
    assert {"idiot", "scum", "moron"} <= set(model.scores) and len(model.scores) < 8
    got = toxicity.score(docs, model).collect()
    assert all(r.predicted == int(r.doc_id % 5 == 0) for r in got)
    for r in got:
        assert all(r.text[p.start:p.end].split()[0] in model.scores for p in r.passages)


def test_toxicity_of_odd_rows_and_empty_labels(spark):
    docs, labels = planted(spark, 300)
    for model in (toxicity.fit(docs, labels), toxicity.fit(docs, labels.filter("false")), toxicity.fit(docs, labels.withColumn("toxic", F.lit(None).cast("int")))):
        got = toxicity.score(odd.frame(spark), model).collect()
        assert len(got) == len(odd.rows()) and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    assert toxicity.score(odd.empty(spark), model).count() == 0


def test_held_out_documents_of_the_tables(spark):
    """A word list made by hand against the trained score, on documents never learned from."""
    sf = "/root/testdata/sf0.01"
    docs = read(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf, "labels").filter(~toxicity.held_out()))
    bad = "(?i)\\b(idiot|clown|worthless|scum|pathetic|moron|stupid|loser|trash|disgusting)\\b"
    got = toxicity.score(docs.filter(toxicity.held_out()), model).withColumn("bad", F.col("text").rlike(bad))
    hit, n, wrong = got.agg(F.sum(F.col("bad").cast("int") * F.col("predicted")), F.sum(F.col("bad").cast("int")),
                            F.sum((~F.col("bad")).cast("int") * F.col("predicted"))).first()
    assert hit >= 0.8 * n and wrong <= 2


# --- language ---------------------------------------------------------------------------------
def test_languages_of_the_tables(spark):
    docs = read(spark, SF, "documents")
    names, model = language.fit_text(docs)
    rows = docs.select("doc_id", "text", F.col("lang").alias("truth"), F.col("source").alias("host"),
                       F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("suffix"))
    assert language.identify(rows, names, model).filter("lang <> truth").count() <= 2


def test_evidence_besides_the_text(spark):
    """A page whose text says little gets the language of its host; one with enough text keeps its own."""
    docs = spark.createDataFrame([(t, lang) for lang, t in (("en", "the house and the garden with the dog"), ("fr", "la maison et le jardin avec le chien")) for _ in range(30)],
                                 "text string, lang string")
    names, model = language.fit_text(docs)
    page = lambda i, lang, t, host: (i, f"http://{host}/{lang}/{i}", f'<html lang="{lang}"><script>the the</script><p>{t}</p></html>')
    rows = [page(i, "fr", "la maison et le jardin", "a.example.org") for i in range(20)] + [page(100, "fr", "123", "a.example.org"), page(101, "fr", "the house and the garden with the dog", "a.example.org")]
    rows += [page(200 + i, "en", "the house and the dog", "b.example.com") for i in range(20)] + [(300, None, None), (301, "no address", "<p>the dog</p>")]
    got = {r.page_id: r for r in language.identify(language.page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string")), names, model).collect()}
    assert got[100].lang == "fr" and got[101].lang == "en" and got[200].lang == "en" and got[301].lang == "en" and len(got) == len(rows)
    assert got[0].suffix == "org/fr" and got[0].declared == "fr" and got[300].declared is None and 0 < got[300].probability < 1


def test_language_of_odd_rows(spark):
    names, model = language.fit_text(read(spark, SF, "documents"))
    rows = odd.frame(spark).withColumns({c: F.lit(None).cast("string") for c in ("declared", "host", "suffix")})
    assert language.identify(rows, names, model).count() == len(odd.rows())
    assert language.identify(rows.filter("false"), names, model).count() == 0
    with pytest.raises(ValueError):
        language.identify(rows, *language.fit_text(odd.empty(spark)))


# --- shards -----------------------------------------------------------------------------------
def check(rows, n, slack):
    sizes = [0] * n
    for r in rows:
        sizes[r.shard] += r.shard_bytes
    for s in range(n):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert max(sizes) - min(sizes) <= slack, sizes
    return sizes


@pytest.mark.parametrize("pieces", [1, 3])
def test_bytes_are_even_and_a_hot_text_is_cut(spark, pieces):
    draw = random.Random(3)
    rows = [(i, "h" * 400) for i in range(300)] + [(300 + i, "".join(draw.choice("abc") for _ in range(draw.randint(0, 800)))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    total = sum(len(t) + 16 for _, t in rows)
    got = shards.shard(df, 8, range_bytes=total // (8 * pieces) + 1).collect()
    assert len(got) == len(rows)
    check(got, 8, 2 * 816)
    hot = {r.shard for r in got if r.doc_id < 300}
    assert hot == set(range(min(hot), max(hot) + 1)) and len(hot) >= 3
    again = {r.doc_id: (r.shard, r.slot) for r in shards.shard(df.repartition(5), 8).collect()}
    assert len(again) == len(rows)


def test_equal_texts_stay_together(spark):
    rows = [(i, f"text {i % 400} " * 5) for i in range(1200)]
    got = shards.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4, group_tolerance=0.05).collect()
    by = {}
    for r in got:
        by.setdefault(r.text, set()).add(r.shard)
    assert all(len(s) == 1 for s in by.values())


def test_shards_of_odd_rows(spark):
    got = shards.shard(odd.frame(spark), 3).collect()
    assert len(got) == len(odd.rows()) and {r.shard for r in got} <= {0, 1, 2}
    check(got, 3, 2 * (len(odd.LONG) + 16))
    assert shards.shard(odd.empty(spark), 3).count() == 0


# --- transcripts ------------------------------------------------------------------------------
def best(model, seen):
    """Score of the best path, by trying all."""
    import itertools

    scores = {}
    for path in itertools.product(range(transcripts.START), repeat=len(seen)):
        at, total = transcripts.START, 0.0
        for s, o in zip(path, seen):
            total += model.move[at, s] + model.emit[s, o]
            at = s
        scores[path] = total
    return max(scores.values()), scores


def test_path_is_the_best_of_all(spark):
    turns = read(spark, SF, "conversations").select("conv_id", "turn", "role", "text")
    model = transcripts.fit(transcripts.write_up(turns))
    draw = np.random.Generator(np.random.PCG64(1))
    for _ in range(5):
        seen = draw.integers(0, transcripts.SYMBOLS, 5).tolist()
        before = np.full(transcripts.STATES, transcripts.NEVER)
        before[transcripts.START] = 0
        whole = model.matrix(seen)
        last = int(whole[transcripts.START].argmax())
        top, scores = best(model, seen)
        assert np.isclose(scores[tuple(model.path(seen, before, last))], top) and np.isclose(whole[transcripts.START].max(), top)


def test_chunks_do_not_change_the_path(spark):
    turns = read(spark, SF, "conversations").select("conv_id", "turn", "role", "text")
    one = turns.withColumns({"conv_id": F.lit(7).cast("long"), "turn": F.col("conv_id") * 50 + F.col("turn")})
    raw = transcripts.write_up(turns).unionByName(transcripts.write_up(one))
    model = transcripts.fit(transcripts.write_up(turns))
    view = lambda **k: sorted((r.conv_id, r.turn, r.role, tuple(r.roles), r.rendered) for r in transcripts.parse(raw, model, **k).collect())
    assert view(chunk=16, fan=6) == view(chunk=1_000_000)


def test_marked_roles_are_recovered(spark):
    """Held-out conversations with markers: nearly all turns; and the markers are gone."""
    turns = read(spark, "/root/testdata/sf0.01", "conversations").select("conv_id", "turn", "role", "text")
    raw = transcripts.write_up(turns)
    fold = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 5
    model = transcripts.fit(raw.filter(fold != 0))
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(transcripts.STYLES)))
    found = transcripts.parse(raw.filter((fold == 0) & (style < 4)), model).join(turns.withColumnRenamed("role", "truth"), ["conv_id", "turn"])
    right, n, marked = found.agg(F.count_if((F.col("role") == F.col("truth")) & (F.size("roles") == 1)), F.count("*"),
                                 F.count_if(F.col("rendered").rlike("(?m)^(User|Q|A|Assistant): "))).first()
    assert n > 20 and right >= 0.95 * n and marked == 0


def test_transcripts_of_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (None, 0, "user", "hi"), (2, None, None, "User: a"), (2, None, None, "User: a"), (2, 3, "x", "### Answer:\nlong\n" * 300), (2, -7, "user", "User: early")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit("clash"))
    model = transcripts.fit(df)
    got = transcripts.parse(df, model).collect()
    assert len(got) == 7 and all(r.role in transcripts.ROLES for r in got)
    assert transcripts.parse(df.filter("false"), model).count() == 0


def test_repeated_and_crowded_turns_stay(spark):
    """Equal rows, and many rows of one turn number or none, are turns each; null and empty names are kept apart."""
    rows = ([("a", 1, "User: yes")] * 3 + [("", 1, "User: one")] + [(None, 1, "User: two")] * 2
            + [("a", None, f"Assistant: {i % 7}") for i in range(300)] + [("a", 2, "User: again")] * 200)
    df = spark.createDataFrame(rows, "conv_id string, turn long, text string")
    turns = read(spark, SF, "conversations").select("conv_id", "turn", "role", "text")
    model = transcripts.fit(transcripts.write_up(turns))
    got = transcripts.parse(df, model).collect()
    assert len(got) == len(rows)
    assert sorted((r.conv_id or "-", r.conv_id is None, r.turn or 0) for r in got) == sorted((c or "-", c is None, t or 0) for c, t, _ in rows)


# --- the pipeline -----------------------------------------------------------------------------
def test_pipeline_stage_by_stage(spark):
    import public_tokenizers as P

    import corpus_pipeline
    from logspark.llm import bpe, quality

    docs = read(spark, SF, "documents")
    model = toxicity.fit(docs, read(spark, SF, "labels").filter(~toxicity.held_out()))
    left = {r.doc_id: r.text for r in toxicity.score(docs, model).filter("predicted = 0").collect()}
    stage = docs.filter(F.col("doc_id").isin(list(left)))
    judged = {r.doc_id: r.kept for r in quality.judge(stage).collect()}
    assert all(not judged[d] for d, t in left.items() if (c := brute.counts(t))[0] < 10 or 100 * c[4] > 20 * c[0])
    left = {d: t for d, t in left.items() if judged[d]}
    left = {d: left[d] for d, (_, c) in brute.near(list(left.items())).items() if c == d}
    bench = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    left = {d: left[d] for d, *_, bad in brute.contaminated(list(left.items()), bench) if not bad}
    encoding = bpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    want = sorted((d, len(encoding.encode_ordinary(t))) for d, t in left.items())
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, SF).collect()) == want
    assert len(corpus_pipeline.STAGES) == 5


def test_one_row_of_each_component_stays(spark):
    import corpus_pipeline

    words = "the quick brown fox jumps over the lazy dog and runs far away today"
    rows = [(1, words, "x"), (1, words, "x"), (None, words, "x"), (None, words + " b c d e f g h i", "x"), (None, words + " b c d e f g h i", "y"),
            (5, None, "x"), (5, None, "x"), (9, words, "z"), (7, "only one of this kind", "x"), (8, "two of this kind here", "x"), (8, "two of this kind here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    left = [(r.doc_id, r.text) for r in corpus_pipeline.repeated(spark, docs, SF).collect()]
    long = words + " b c d e f g h i"
    want = {(1, words): 1, (None, long): 1, (5, None): 2, (7, "only one of this kind"): 1, (8, "two of this kind here"): 1}
    if dict(brute.near([(1, words), (2, long)]))[2][1] == 1:
        want.pop((None, long))
    assert {x: left.count(x) for x in left} == want


def test_stages_of_empty_tables(spark):
    import corpus_pipeline

    docs = read(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, SF).count() == 0
