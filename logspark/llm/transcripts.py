"""Transcript parsing: a hidden Markov model over lines recovers who speaks, then turns are rendered in one form.

A transcript is rows of text in an order. Its lines are the observations: the kind of speaker marker a line begins with and a few
features of the line. A state is a role and whether the line begins a turn or goes on with it. Viterbi's best path is found in
pieces: each chunk of rows gives a matrix with the best score from any state before it to any state at its end; such matrices
multiply (maximum and sum in place of sum and product), so the states at chunk borders come from a tree of products, and each
chunk then finds its own path. A conversation of any length is never in one task.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from ..session import materialize
from .common import map_batches, text_of
from .prefix_trie import running

ROLES = ("system", "user", "assistant")
#: States: role * 2 + (0 where a line begins a turn, 1 where it goes on); the last is before the first line.
STATES = 2 * len(ROLES) + 1
START = STATES - 1
#: Where rows without a turn number stand.
FIRST = -(1 << 62)
#: Log probability of what can't be.
NEVER = -1e9
#: Words that mark a speaker at the start of a line.
MARKS = {
    "system": ("system", "sys", "context", "instructions"),
    "user": ("user", "human", "customer", "question", "prompter", "you", "q"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "model", "a"),
}
_NAMES = {word: i + 1 for i, role in enumerate(ROLES) for word in MARKS[role]}
MARKER = re.compile(rf"\s*(?:#+\s*|\*+|\[|<\|?)?({'|'.join(sorted(_NAMES, key=len, reverse=True))})(?:\*+|\]|\|?>)?\s*(?::\**|>|(?<=[\]>])|$)\s*", re.I)
#: Observations: marker (none or a role's) * 12 + length (4) * 3 + last character (3).
SYMBOLS = 4 * 12


def observe(line: str) -> int:
    m = MARKER.match(line)
    kind = _NAMES[m.group(1).lower()] if m else 0
    rest = line[m.end():] if m else line
    size = min(3, len(rest) // 40) if rest else 0
    last = rest.rstrip()[-1:]
    return kind * 12 + size * 3 + (1 if last == "?" else 2 if last in ".!" and last else 0)


def unmarked(line: str) -> str:
    m = MARKER.match(line)
    return line[m.end():] if m else line


def lines(text: str) -> list[str]:
    return text.split("\n")


class Model:
    """Log probabilities of moves between states and of what a state emits."""

    def __init__(self, move: np.ndarray, emit: np.ndarray):
        self.move, self.emit = move, emit

    def matrix(self, seen: list[int]) -> np.ndarray:
        """Best scores from the state before the lines to the state of the last."""
        out = None
        for s in seen:
            step = self.move + self.emit[:, s]
            out = step if out is None else (out[:, :, None] + step[None]).max(axis=1)
        return out

    def path(self, seen: list[int], before: np.ndarray, last: int) -> list[int]:
        """The best states of the lines, from scores of the states before them to a known last state."""
        score, back = before, []
        for s in seen:
            step = score[:, None] + self.move + self.emit[None, :, s]
            back.append(step.argmax(axis=0))
            score = step.max(axis=0)
        out = [last]
        for b in back[:0:-1]:
            out.append(int(b[out[-1]]))
        return out[::-1]


def fit(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", prior: float = 0.5) -> Model:
    """Counts starts, moves and observations of labelled turns, by grouped aggregation; a bounded table reaches the driver.

    Moves within a turn and emissions are counted line by line; moves between turns from each turn's role and the next turn
    number's. Rows of unknown roles are not learned from.
    """
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.lower(role).alias("role"),
                        text_of(text).alias("text")).filter(F.col("role").isin(*ROLES))

    def make():
        def work(batch):
            out: Counter = Counter()
            for r, t in zip(batch["role"].to_pylist(), batch["text"].to_pylist()):
                r = ROLES.index(r)
                for i, line in enumerate(lines(t)):
                    out[f"e {2 * r + (i > 0)} {observe(line)}"] += 1
                    out[f"in {2 * r + (i > 1)}" if i else f"end {2 * r}"] += 1
                if "\n" in t:
                    out[f"end {2 * r}"] -= 1
                    out[f"end {2 * r + 1}"] += 1
            return {"what": list(out), "n": list(out.values())}
        return work

    counts = map_batches(rows, make, "what string, n long").groupBy("what").agg(F.sum("n").alias("n"))
    names = rows.select("conv", "turn", "role")
    many = names.groupBy("conv", "turn", "role").agg(F.count("*").alias("n"))
    after = many.select("conv", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"), F.col("n").alias("m"))
    pairs = many.join(after, ["conv", "turn"]).groupBy(F.concat_ws(" ", F.lit("r"), "role", "next").alias("what")).agg(
        F.sum(F.col("n") * F.col("m")).alias("n"))
    first = names.groupBy("conv").agg(F.min_by("role", "turn").alias("role")).groupBy(F.concat_ws(" ", F.lit("s"), "role").alias("what")).agg(
        F.count("*").alias("n"))
    got = Counter({r.what: r.n for r in counts.union(pairs).union(first).collect()})

    emit, move = np.full((STATES, SYMBOLS), NEVER), np.full((STATES, STATES), NEVER)
    opened = np.array([got[f"s {a}"] + prior for a in ROLES])
    move[START, 0:START:2] = np.log(opened / opened.sum())
    for i, a in enumerate(ROLES):
        turned = np.array([got[f"r {a} {b}"] + prior for b in ROLES])
        for s in (2 * i, 2 * i + 1):
            seen = np.array([got[f"e {s} {o}"] + prior / SYMBOLS for o in range(SYMBOLS)])
            emit[s] = np.log(seen / seen.sum())
            stay, leave = got[f"in {s}"] + prior, got[f"end {s}"] + prior
            move[s, 2 * i + 1] = np.log(stay / (stay + leave))
            move[s, 0:START:2] = np.log(leave / (stay + leave) * turned / turned.sum())
    return Model(move, emit)


def _borders(chunks: DataFrame, fan: int) -> DataFrame:
    """For each chunk the scores of the states before it and the state at its end, on the best path of the conversation."""
    first = [NEVER] * START + [0.0]

    @arrow_udf("array<double>")
    def product(parts: pa.Array) -> pa.Array:
        rows = []
        for row in parts.to_pylist():
            out = None
            for p in row:
                m = np.array(p["m"]).reshape(STATES, STATES)
                out = m if out is None else (out[:, :, None] + m[None]).max(axis=1)
            rows.append(out.ravel().tolist())
        return pa.array(rows, pa.list_(pa.float64()))

    @arrow_udf("array<struct<at: long, before: array<double>, last: int>>")
    def descend(parts: pa.Array, before: pa.Array, last: pa.Array) -> pa.Array:
        rows = []
        for row, b, end in zip(parts.to_pylist(), before.to_pylist(), last.to_pylist()):
            ms = [np.array(p["m"]).reshape(STATES, STATES) for p in row]
            scores = [np.array(b)]
            for m in ms:
                scores.append((scores[-1][:, None] + m).max(axis=0))
            ends = [int(scores[-1].argmax()) if end is None else end]
            for m, s in zip(ms[:0:-1], scores[-2:0:-1]):
                ends.append(int((s + m[:, ends[-1]]).argmax()))
            rows.append([{"at": p["at"], "before": (s - s.max()).tolist(), "last": e} for p, s, e in zip(row, scores, ends[::-1])])
        return pa.array(rows, pa.list_(pa.struct({"at": pa.int64(), "before": pa.list_(pa.float64()), "last": pa.int32()})))

    level = materialize(chunks.select("conv", "chunk", F.col("chunk").alias("at"), "m"), "matrices")
    named = level.select("conv", "at", "chunk")
    level = level.drop("chunk")
    levels = []
    while True:
        level = materialize(level.groupBy("conv", F.floor(F.col("at") / fan).alias("up")).agg(
            F.array_sort(F.collect_list(F.struct("at", "m"))).alias("parts")), "level")
        levels.append(level)
        if level.groupBy("conv").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            break
        level = level.select("conv", F.col("up").alias("at"), product("parts").alias("m"))
    known = levels[-1].withColumns({"before": F.array(*map(F.lit, first)), "last": F.lit(None).cast("int")})
    for below in [*levels[-2::-1], None]:
        known = known.select("conv", F.explode(descend("parts", "before", "last")).alias("x")).select("conv", "x.*")
        if below is None:
            return known.join(named, ["conv", "at"]).drop("at")
        known = below.join(known.withColumnRenamed("at", "up"), ["conv", "up"])


def parse(df: DataFrame, model: Model, conv: str = "conv_id", turn: str = "turn", text: str = "text", chunk: int = 64, fan: int = 256) -> DataFrame:
    """Per row: conversation, turn, ``role`` (of its first line), ``roles`` (of the turns it begins) and ``rendered``.

    ``rendered`` has ``<|role|>`` before each turn and its lines without markers; a conversation's rows in order, joined by line
    ends, are its canonical form. Rows are ordered by turn, then text; equal rows are turns of their own. Null conversations are
    one conversation, null turns come first, a null text is one empty line. An empty table gives an empty one.
    """
    key = F.when(F.col(conv).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(conv).cast("string")))
    rows = df.select(key.alias("conv"), F.col(conv).alias("_id"), F.coalesce(F.col(turn).cast("long"), F.lit(FIRST)).alias("turn"), text_of(text).alias("text"))
    equal = rows.groupBy("conv", "turn", "text").agg(F.first("_id").alias("_id"), F.count("*").alias("times"))
    placed = running(equal, ["conv"], ["turn", "text"], {"before": ("sum", "times")})
    placed = placed.withColumn("place", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("times") - 1)))
    chunks = materialize(placed.groupBy("conv", F.floor(F.col("place") / chunk).alias("chunk")).agg(
        F.first("_id").alias("_id"), F.array_sort(F.collect_list(F.struct("place", "turn", "text"))).alias("parts")), "chunks")

    @arrow_udf("array<double>")
    def matrix(parts: pa.Array) -> pa.Array:
        out = [model.matrix([observe(x) for p in row for x in lines(p["text"])]).ravel().tolist() for row in parts.to_pylist()]
        return pa.array(out, pa.list_(pa.float64()))

    @arrow_udf("array<struct<turn: long, role: string, roles: array<string>, rendered: string>>")
    def decode(parts: pa.Array, before: pa.Array, last: pa.Array) -> pa.Array:
        rows = []
        for row, b, end in zip(parts.to_pylist(), before.to_pylist(), last.to_pylist()):
            texts = [lines(p["text"]) for p in row]
            states = iter(model.path([observe(x) for t in texts for x in t], np.array(b), end))
            out = []
            for p, t in zip(row, texts):
                own = [next(states) for _ in t]
                shown = [x for s, line in zip(own, t) for x in (
                    [f"<|{ROLES[s // 2]}|>", unmarked(line)] if s % 2 == 0 else [line])]
                out.append({"turn": p["turn"], "role": ROLES[own[0] // 2], "roles": [ROLES[s // 2] for s in own if s % 2 == 0],
                            "rendered": "\n".join(shown)})
            rows.append(out)
        return pa.array(rows, pa.list_(pa.struct({"turn": pa.int64(), "role": pa.string(), "roles": pa.list_(pa.string()), "rendered": pa.string()})))

    borders = _borders(chunks.select("conv", "chunk", matrix("parts").alias("m")), fan)
    found = chunks.join(borders, ["conv", "chunk"]).select("_id", F.explode(decode("parts", "before", "last")).alias("x"))
    return found.select(F.col("_id").alias(conv), F.expr(f"nullif(x.turn, {FIRST}L)").alias(turn), "x.role", "x.roles", "x.rendered")


#: Ways in which ``write_up`` marks the three roles; the last leaves most markers out.
STYLES = (("System: ", "User: ", "Assistant: "), ("[system] ", "[human] ", "[bot] "), ("### Instructions:\n", "### Question:\n", "### Answer:\n"),
          ("", "Q: ", "A: "), ("", "", ""))


def write_up(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Raw transcripts of labelled turns: each conversation marks its speakers in one of the STYLES, chosen by a hash."""
    style = F.pmod(F.xxhash64(F.col(conv)), F.lit(len(STYLES)))
    mark = F.coalesce(*[F.when((style == i) & (F.lower(role) == r), F.lit(s[j])) for i, s in enumerate(STYLES) for j, r in enumerate(ROLES)], F.lit(""))
    return turns.select(conv, turn, role, F.concat(mark, text_of(text)).alias(text))
