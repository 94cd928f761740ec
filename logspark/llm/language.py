"""Language identification by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..session import materialize
from .common import map_batches, text_of

#: Character triples are counted in so many cells, which bounds the model whatever the texts hold.
CELLS = 1 << 16
#: Neighbouring triples share letters; a text of n triples counts as n / SHARED independent ones.
SHARED = 3.0
BROADCAST_ROWS = 500_000


def cells(text: str) -> np.ndarray:
    """The cells of a lower-cased text's character triples, with a blank at either end."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    if len(c) < 3:
        return np.empty(0, "i8")
    mixed = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9))
    return ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype("i8")


def fit_text(docs: DataFrame, text: str = "text", lang: str = "lang", per_lang: int = 5_000, prior: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Log probabilities of the cells for each language, from about ``per_lang`` labelled texts of each at most.

    Texts are drawn by a hash; counting is a grouped aggregation by language and cell, so at most CELLS rows a language
    reach the driver. Rows without language or text are not learned from.
    """
    known = docs.filter(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    share = {r.lang: min(1.0, per_lang / r.n) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return [], np.zeros((CELLS, 0), "f4")
    limit = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("lang")]
    some = known.filter(F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(float(1 << 53)) < limit)

    def make():
        def work(batch):
            out: dict[str, np.ndarray] = {}
            for name, t in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                out[name] = out.get(name, 0) + np.bincount(cells(t), minlength=CELLS)
            at = {name: np.flatnonzero(n) for name, n in out.items()}
            return {"lang": [name for name, i in at.items() for _ in i], "cell": np.concatenate(list(at.values())).tolist(),
                    "n": np.concatenate([out[name][i] for name, i in at.items()]).tolist()}
        return work

    counted = map_batches(some, make, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    packed = counted.groupBy("lang").agg(F.collect_list(F.struct("cell", "n")).alias("cells")).collect()
    names = sorted(share)
    model = np.full((CELLS, len(names)), prior)
    for r in packed:
        model[[c.cell for c in r.cells], names.index(r.lang)] += [c.n for c in r.cells]
    return names, np.log(model / model.sum(axis=0)).astype("f4")


def page_evidence(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Adds to pages their visible ``text`` and what speaks for a language besides: ``declared``, ``host``, ``suffix``.

    ``declared`` is the language of the html element; ``suffix`` the address's last host label and a two-letter first path
    part. Pages without address or markup have nulls there.
    """
    address, markup = F.lower(F.coalesce(F.col(url), F.lit(""))), F.coalesce(F.col(html), F.lit(""))
    host = F.regexp_extract(address, r"^[a-z][a-z0-9+.-]*://([^/:?#]+)", 1)
    part = F.regexp_extract(address, r"^[a-z][a-z0-9+.-]*://[^/?#]+/([a-z]{2})(?:[/?#]|$)", 1)
    blank = lambda c: F.when(c != "", c)
    return pages.withColumns({
        "text": F.regexp_replace(markup, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " "),
        "declared": blank(F.lower(F.regexp_extract(markup, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))),
        "host": blank(host),
        "suffix": blank(F.concat_ws("/", blank(F.regexp_extract(host, r"\.([a-z]{2,24})$", 1)), blank(part))),
    })


def text_evidence(df: DataFrame, names: list[str], model: np.ndarray) -> DataFrame:
    """Adds ``ll``: each language's log likelihood of the whole ``text``, up to a constant; zeros for an empty one."""
    share = df.sparkSession.sparkContext.broadcast(model)
    rows = df.withColumn("text", text_of())

    def make():
        def work(batch):
            out = []
            for t in batch.pop("text").to_pylist():
                at, ll = cells(t), np.zeros(len(names))
                for i in range(0, len(at), 100_000):
                    ll += share.value[at[i:i + 100_000]].sum(axis=0, dtype="f8")
                out.append(((ll - ll.max()) / SHARED).tolist())
            return batch | {"ll": out}
        return work

    return map_batches(rows, make, rows.drop("text").schema.add("ll", ArrayType(DoubleType())))


def fuse(evidence: DataFrame, names: list[str], weight: float = 5.0, prior: float = 0.5) -> DataFrame:
    """Adds ``lang``, ``probability`` and ``text_lang`` to written rows with ll, declared, suffix and host.

    The texts' posteriors are summed by declared language, suffix, domain and host: the first two give how likely each
    language is to be declared so or to have such an address; the host's prior is its own mean, drawn towards its domain's by
    ``weight`` rows, and that towards the mean of all. A row's own posterior is taken out of the sums it is judged by. Sums are
    aggregated on the map side; the tables of sums are joined back, by broadcast up to BROADCAST_ROWS rows, else by shuffle.
    """
    n = len(names)
    top = F.expr("aggregate(ll, -1e300D, (a, x) -> greatest(a, x))")
    rows = evidence.withColumn("_domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))
    rows = rows.withColumn("_domain", F.when(F.col("_domain") != "", F.col("_domain")).otherwise(F.col("host")))
    rows = rows.withColumn("_e", F.transform("ll", lambda x: F.exp(x - top)))
    rows = rows.withColumn("_q", F.expr("transform(_e, x -> x / aggregate(_e, 0D, (a, y) -> a + y))"))

    def sums(by):
        return rows.filter(F.col(by).isNotNull()).groupBy(F.col(by).alias(f"_k_{by}")).agg(
            F.array(*[F.sum(F.col("_q")[i]) for i in range(n)]).alias(f"_s_{by}"), F.count("*").alias(f"_n_{by}"))

    total = rows.agg(F.array(*[F.sum(F.col("_q")[i]) for i in range(n)]).alias("s"), F.count("*").alias("n")).first()
    every = [(s + prior) / (total.n + n * prior) for s in total.s] if total.n else [1 / n] * n
    out = rows
    for by in ("declared", "suffix", "_domain", "host"):
        table = materialize(sums(by), "sums")
        kinds = table.count()
        table = F.broadcast(table) if kinds <= BROADCAST_ROWS else table
        out = out.join(table, F.col(by) == F.col(f"_k_{by}"), "left")
        if by in ("declared", "suffix"):
            held = table.agg(F.array(*[F.sum(F.col(f"_s_{by}")[i]) for i in range(n)]).alias("s")).first().s
            held = held if held and held[0] is not None else [0.0] * n
            out = out.withColumn(f"_l_{by}", F.array(*[F.when(F.col(by).isNull(), 0.0).otherwise(F.ln(
                (F.greatest(F.col(f"_s_{by}")[i] - F.col("_q")[i], F.lit(0.0)) + prior)
                / (F.greatest(F.lit(held[i]) - F.col("_q")[i], F.lit(0.0)) + prior * (kinds + 1)))) for i in range(n)]))

    def drawn(by, towards):
        own = lambda i: F.greatest(F.col(f"_s_{by}")[i] - F.col("_q")[i], F.lit(0.0))
        return F.array(*[F.when(F.col(by).isNull(), towards(i)).otherwise(
            (own(i) + weight * towards(i)) / (F.col(f"_n_{by}") - 1 + weight)) for i in range(n)])

    out = out.withColumn("_p_domain", drawn("_domain", lambda i: F.lit(every[i])))
    out = out.withColumn("_p_host", drawn("host", lambda i: F.col("_p_domain")[i]))
    out = out.withColumn("_z", F.array(*[F.col("ll")[i] + F.col("_l_declared")[i] + F.col("_l_suffix")[i]
                                         + F.ln(F.col("_p_host")[i]) for i in range(n)]))
    best = lambda c: F.expr(f"element_at(array({', '.join(repr(x) for x in names)}), CAST(array_position({c}, array_max({c})) AS INT))")
    out = out.withColumns({"lang": best("_z"), "text_lang": best("ll"), "probability": F.expr(
        "1 / aggregate(transform(_z, x -> exp(x - array_max(_z))), 0D, (a, x) -> a + x)")})
    return out.select(*[c for c in evidence.columns if c != "ll"], "lang", "text_lang", "probability")


def identify(rows: DataFrame, names: list[str], model: np.ndarray, **tuning) -> DataFrame:
    """Language of every row by all its evidence: columns ``text``, ``declared``, ``host`` and ``suffix``.

    Any of them may be null: that evidence is left out. A row without any gets the commonest language and its share as
    probability. Equal rows get equal results; ties go to the language first by name. Other columns are kept, except that
    ``lang``, ``text_lang`` and ``probability`` are replaced. Without any labelled language an error is raised.
    """
    if not names:
        raise ValueError("no labelled text to learn languages from")
    slim = rows.drop("lang", "text_lang", "probability", "ll")
    return fuse(materialize(text_evidence(slim, names, model), "evidence"), names, **tuning)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
