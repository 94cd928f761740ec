"""Toxic passages as maximum-scoring segments of token log-odds, judged by their extreme-value distribution."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from ..session import materialize
from .common import bounded_batches, map_batches, text_of

TOKENS = re.compile(r"\w+")
PASSAGE = "struct<start: int, end: int, score: double, p: double>"
RESULT = f"struct<score: double, evidence: double, passages: array<{PASSAGE}>>"
#: Evidence is counted in bins of this width; more than the last bin's counts as that.
BIN, BINS = 0.25, 400


def tokens(text: str) -> list[str]:
    return TOKENS.findall(text.lower())


def segments(at: list[int], score: list[float], other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score) of a text, in one pass.

    Tokens number ``at[i]`` have the positive ``score[i]``, all others the negative ``other``. A segment is maximal if no
    longer one scores more and none inside it scores as much without the rest. Each open segment remembers the nearest
    earlier one that begins at a lower running sum, so every segment is passed over once.
    """
    low: list[float] = []
    high: list[float] = []
    ends: list[tuple[int, int]] = []
    lower: list[int] = []
    total, last = 0.0, -1
    for position, gain in zip(at, score):
        left = total + other * (position - last - 1)
        total, last, first = left + gain, position, position
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= left:
                j = lower[j]
            if j < 0 or high[j] >= total:
                break
            left, first = low[j], ends[j][0]
            del low[j:], high[j:], ends[j:], lower[j:]
        low.append(left)
        high.append(total)
        ends.append((first, position))
        lower.append(j)
    return [(a, b, h - lo) for (a, b), lo, h in zip(ends, low, high)]


@dataclass
class Model:
    """Scores of the words that speak for toxicity, of any other, and the constants of calibration."""

    scores: dict[str, float]
    other: float = -0.05
    rate: float = 1.0
    k: float = 1.0
    slope: float = 1.0
    base: float = -3.0

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """A word's k-th occurrence in a text scores a k-th: one repeated word is no passage."""
        if self.scores.keys().isdisjoint(words):
            return []
        seen: Counter = Counter()
        at, score = [], []
        for i, w in enumerate(words):
            if w in self.scores:
                seen[w] += 1
                at.append(i)
                score.append(self.scores[w] / seen[w])
        return segments(at, score, self.other)

    def bits(self, score: float, n: int) -> float:
        """How far a segment's score is beyond what ``n`` clean tokens are expected to reach once; Gumbel's tail."""
        return self.rate * score - math.log(self.k * n)

    def evidence(self, words: list[str]) -> float:
        return sum(max(0.0, self.bits(s, len(words))) for _, _, s in self.segments(words))

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.base + self.slope * evidence))))

    def passages(self, text: str, words: list[str], alpha: float) -> list[dict]:
        """Significant segments as character offsets, with the chance that a clean text of this length holds one."""
        found = []
        for a, b, s in self.segments(words):
            p = -math.expm1(-math.exp(min(50.0, -self.bits(s, len(words)))))
            if p <= alpha:
                found.append((a, b, s, p))
        if not found:
            return []
        spans = [m.span() for m in TOKENS.finditer(text)] if len(text.lower()) == len(text) else None
        spans = spans if spans is not None and len(spans) == len(words) else [m.span() for m in TOKENS.finditer(text.lower())]
        return [{"start": spans[a][0], "end": spans[b][1], "score": s, "p": p} for a, b, s, p in found]


def family(words: list[str]) -> int:
    """The least hash of a text's word triples: copies and most near copies share it."""
    if len(words) < 3:
        return zlib.crc32(" ".join(words).encode())
    return min(zlib.crc32(f"{a} {b} {c}".encode()) for a, b, c in zip(words, words[1:], words[2:]))


def training(docs: DataFrame, labels: DataFrame, per_class: int, doc: str, text: str, label: str) -> tuple[DataFrame, float]:
    """Labelled texts of about ``per_class`` rows a class at most, one for each family of copies; and toxic's true odds.

    The sample is drawn by a hash of the document number, so the table of its numbers has a bounded size and is broadcast:
    the documents' texts are not moved.
    """
    known = labels.filter(F.col(doc).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc).alias("doc")).agg(
        F.max(F.col(label).cast("int")).alias("toxic"))
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.shiftrightunsigned(F.xxhash64("doc", F.lit("draw")), 11) / F.lit(float(1 << 53))
    share = {c: min(1.0, per_class / max(1, n.get(c, 0))) for c in (0, 1)}
    some = known.filter(draw < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    rows = docs.select(F.col(doc).alias("doc"), text_of(text).alias("text")).join(F.broadcast(some), "doc").select("toxic", "text")

    def make():
        def work(batch):
            return batch | {"family": [family(tokens(t)) for t in batch["text"].to_pylist()]}
        return work

    families = map_batches(rows, make, "toxic int, text string, family long").groupBy("family").agg(
        F.min_by(F.struct("toxic", "text"), F.xxhash64("text", "toxic")).alias("r")).select("r.toxic", "r.text")
    return materialize(families, "training"), n.get(1, 0) / max(1, n.get(0, 0))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 10_000, prior: float = 10.0, doc: str = "doc_id",
        text: str = "text", label: str = "toxic") -> Model:
    """Learns the model from labelled documents, at most about ``per_class`` of each class (a bound on the classifier's fit).

    A word counts once a document. Its log-odds between the classes are smoothed by a Dirichlet prior of ``prior``
    documents with the pooled rates; only words whose likelihood ratio exceeds what the best of all tested words reaches
    by chance are kept. The rate of the extreme-value law solves the moment equation of the clean token scores; its
    constant, and the map from evidence to a probability, are fitted to the same documents. Only counts, kept words and a
    histogram reach the driver. Without toxic or without clean rows all texts get one low score.
    """
    train, odds = training(docs, labels, per_class, doc, text, label)
    n = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Model({})

    def count():
        def work(batch):
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for y, t in zip(batch["toxic"].to_pylist(), batch["text"].to_pylist()):
                seen[1 if y == 1 else 0].update(set(tokens(t)))
            words = list(seen[0].keys() | seen[1].keys())
            return {"word": words, "y1": [seen[1][w] for w in words], "y0": [seen[0][w] for w in words]}
        return work

    words = materialize(map_batches(train, count, "word string, y1 long, y0 long").groupBy("word").agg(
        F.sum("y1").alias("y1"), F.sum("y0").alias("y0")).filter("y1 + y0 >= 3"), "words")
    tested = max(words.count(), 2)
    p = "((y1 + y0) / {n})".format(n=n1 + n0)
    kept = words.withColumn("delta", F.expr(
        f"ln((y1 + {prior} * {p}) / {n1 + prior}) - ln((y0 + {prior} * {p}) / {n0 + prior})")).withColumn("g2", F.expr(
            f"2 * (IF(y1 > 0, y1 * ln(y1 / ({n1} * {p})), 0) + IF(y0 > 0, y0 * ln(y0 / ({n0} * {p})), 0)"
            f" + ({n1} - y1) * ln(greatest({n1} - y1, 0.5) / greatest({n1} * (1 - {p}), 0.5))"
            f" + ({n0} - y0) * ln(greatest({n0} - y0, 0.5) / greatest({n0} * (1 - {p}), 0.5)))"))
    chosen = kept.filter(f"y1 >= 3 AND delta > 0.7 AND g2 >= {2 * math.log(tested)}").collect()
    model = Model({r.word: r.delta for r in chosen})
    if not chosen:
        return model

    def rates():
        def work(batch):
            out: Counter = Counter()
            for y, t in zip(batch["toxic"].to_pylist(), batch["text"].to_pylist()):
                ws = tokens(t)
                hit = Counter(w for w in ws if w in model.scores)
                if y != 1:
                    out.update({f"0 {w}": c for w, c in hit.items()} | {"0": len(ws)})
                elif hit:
                    out.update({"1 ": sum(hit.values()), "1": len(ws)})
            return {"what": list(out), "n": list(out.values())}
        return work

    got = Counter({r.what: r.n for r in map_batches(train, rates, "what string, n long").groupBy("what").agg(
        F.sum("n").alias("n")).collect()})
    clean = got["0"] + 1
    share = {w: (got[f"0 {w}"] + 0.5) / clean for w in model.scores}
    q0 = min(0.5, sum(share.values()))
    q1 = min(0.5, max(2 * q0, (got["1 "] + 0.5) / (got["1"] + 1)))
    model.other = math.log1p(-q1) - math.log1p(-q0)
    model.rate = _root(lambda r: sum(f * math.exp(r * model.scores[w]) for w, f in share.items())
                       + (1 - q0) * math.exp(r * model.other) - 1)

    def tops():
        def work(batch):
            out: Counter = Counter()
            for t in (t for y, t in zip(batch["toxic"].to_pylist(), batch["text"].to_pylist()) if y != 1):
                ws = tokens(t)
                best = max((s for _, _, s in model.segments(ws)), default=0.0)
                out.update({int(best * 10): 1, -1: len(ws)})
            return {"what": list(out), "n": list(out.values())}
        return work

    top = {r.what: r.n for r in map_batches(train, tops, "what long, n long").groupBy("what").agg(F.sum("n").alias("n")).collect()}
    least = min(model.scores.values())
    beyond = sum(c for s, c in top.items() if s >= int(least * 10))
    model.k = max(beyond, 0.5) / (max(1, top.get(-1, 1)) * math.exp(-model.rate * least))
    _calibrate(model, train, odds, n1, n0)
    return model


def _root(f) -> float:
    """The positive zero of a convex function that is negative just above 0."""
    lo, hi = 1e-3, 1.0
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if f(mid) > 0 else (mid, hi)
    return hi


def _calibrate(model: Model, train: DataFrame, odds: float, n1: int, n0: int) -> None:
    """Logistic regression of the label on the evidence, from a histogram, at the classes' true odds."""
    def make():
        def work(batch):
            out = Counter((1 if y == 1 else 0, min(BINS, math.ceil(model.evidence(tokens(t)) / BIN)))
                          for y, t in zip(batch["toxic"].to_pylist(), batch["text"].to_pylist()))
            return {"y": [y for y, _ in out], "bin": [b for _, b in out], "n": list(out.values())}
        return work

    rows = map_batches(train, make, "y int, bin int, n long").groupBy("y", "bin").agg(F.sum("n").alias("n")).collect()
    weight = {1: odds * n0 / n1, 0: 1.0}
    data = [(math.log1p(r.bin * BIN), float(r.y), r.n * weight[r.y]) for r in rows]
    a, b = 1.0, -2.0
    for _ in range(50):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for x, y, w in data:
            q = 1 / (1 + math.exp(-(a * x + b)))
            e, v = w * (q - y), w * max(q * (1 - q), 1e-9)
            g0, g1, h00, h01, h11 = g0 + e, g1 + e * x, h00 + v, h01 + v * x, h11 + v * x * x
        g1, g0, h00, h11 = g1 + 1e-3 * a, g0 + 1e-3 * b, h00 + 1e-3, h11 + 1e-3
        det = h00 * h11 - h01 * h01
        step_b, step_a = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = a - max(-2.0, min(2.0, step_a)), b - max(-2.0, min(2.0, step_b))
    model.slope, model.base = max(a, 0.0), b


def score(df: DataFrame, model: Model, text: str = "text", alpha: float = 0.05) -> DataFrame:
    """Adds ``score`` (0 to 1), ``predicted`` (1 from 0.5 on), ``evidence`` and ``passages`` to each row.

    Passages are all maximal segments whose chance in a clean text of the same length is ``alpha`` or less. Whole texts are
    read, in linear time; null and empty texts have no evidence and get the score of such. No shuffle; the model is bounded
    by the fit. Equal texts get equal scores; columns with the added names are replaced, others kept.
    """
    @arrow_udf(RESULT)
    def judge(batch: pa.Array) -> pa.Array:
        rows = []
        for t in batch.to_pylist():
            words = tokens(t)
            e = model.evidence(words)
            rows.append({"score": model.score(math.log1p(e)), "evidence": e,
                         "passages": model.passages(t, words, alpha) if e > 0 else []})
        return pa.array(rows, pa.struct({"score": pa.float64(), "evidence": pa.float64(), "passages": pa.list_(pa.struct({
            "start": pa.int32(), "end": pa.int32(), "score": pa.float64(), "p": pa.float64()}))}))

    judged = bounded_batches(df).withColumn("_judged", judge(text_of(text)))
    return judged.withColumns({k: F.col(f"_judged.{k}") for k in ("score", "evidence", "passages")}).withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)).drop("_judged")


def held_out(doc: str = "doc_id") -> Column:
    """One document in five, by the crc32 of its number: never learned from."""
    return F.crc32(F.coalesce(F.col(doc).cast("string"), F.lit("")).cast("binary")) % 5 == 0
