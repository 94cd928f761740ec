"""Quality rules: fixed rules, and robust multivariate outliers within each language and source."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from ..session import materialize
from .common import WORD, map_batches, text_of

WORDS = re.compile(WORD)
#: Fixed value: characters that count as symbols.
SYMBOLS = "#*$%&|<>"
RUN = 5

#: The vector whose outliers are rejected, from the counts of a document with at least one word.
FEATURES = {
    "x0": "ln(1 + n_words)",
    "x1": "ln(word_chars / n_words)",
    "x2": "sqrt(n_symbols / n_words)",
    "x3": "ln(1 + 100 * n_dup_lines / n_words)",
    "x4": "sqrt(n_repeat_words / n_words)",
}
#: Spread that each feature has at least; a variance is raised to its square only where it is less, so that a feature that
#: is the same in nearly all documents of a group (no symbols at all, say) doesn't make an outlier of the first document with
#: one, nor the error of a mean over ten words. x4's lets a lone repeated run pass in the shortest text that the base rules pass.
LEEWAY = {"x0": 0.8, "x1": 0.12, "x2": 0.12, "x3": 0.5, "x4": 0.088}
DIM = len(FEATURES)
#: Median of the chi-squared distribution with DIM degrees of freedom, and the points below which 97.5 % and 99.99 % lie.
CHI2_MEDIAN, CHI2_975, CHI2_9999 = 4.3515, 12.8325, 25.7448


def repeated(words: list[str]) -> int:
    """Words inside any run of RUN words that the text has twice or more."""
    import numpy as np

    n = len(words)
    if n <= RUN:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), "i8", n)
    if len(number) == n:
        return 0
    size, code = len(number), ids[:n - RUN + 1]
    span = size
    for i in range(1, RUN):
        if span * size >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            span = n
        code, span = code * size + ids[i:n - RUN + 1 + i], span * size
    _, at, times = np.unique(code, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[at] > 1)
    edge = np.zeros(n + 1, "i8")
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + RUN, -1)
    return int((np.cumsum(edge) > 0).sum())


def counts(text: str) -> tuple[int, int, int, int, int]:
    words = WORDS.findall(text)
    lines = [line for line in text.split("\n") if WORDS.search(line)] if "\n" in text else []
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated(words))


def statistics(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The counts of every whole text beside the kept columns; a null text has no words."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = df.select(*keep, text_of(text).alias("_text"))

    def make():
        def work(batch):
            got = list(zip(*(counts(t) for t in batch.pop("_text").to_pylist())))
            return batch | {name: pa.array(values, pa.int64()) for name, values in zip(names, got)}
        return work

    schema = rows.drop("_text").schema
    for name in names:
        schema = schema.add(name, "long")
    return map_batches(rows, make, schema)


def base_failed(repeat_share: int = 20) -> Column:
    return F.expr(f"n_words < 10 OR 100 * n_repeat_words > {repeat_share} * n_words")


def _levels() -> Column:
    """A row's groups: its language and source, its language, all rows. Nulls are groups of their own."""
    return F.array(F.struct(F.lit(2).alias("level"), F.to_json(F.struct("lang", "source", F.lit(2).alias("level"))).alias("grp")),
                   F.struct(F.lit(1).alias("level"), F.to_json(F.struct("lang", F.lit(1).alias("level"))).alias("grp")),
                   F.struct(F.lit(0).alias("level"), F.lit("all").alias("grp")))


#: Share of the least variance that every direction has, so that two or three rows in a line have an inverse too.
LEAST_SHARE = 0.05


def _inverse(cov):
    """The inverse of a covariance whose variances are raised to the least spread."""
    import numpy as np

    least = np.array(list(LEEWAY.values()))
    raised = (cov + np.diag(np.maximum(0, least ** 2 - np.diag(cov)))) / np.outer(least, least)
    values, vectors = np.linalg.eigh(raised)
    return (vectors / np.maximum(values, LEAST_SHARE)) @ vectors.T / np.outer(least, least)


def _estimate():
    """From means and products of the rows chosen: centre, covariance and its inverse."""
    @arrow_udf("struct<mu: array<double>, cov: array<double>, inverse: array<double>>")
    def estimate(mean: pa.Array, product: pa.Array) -> pa.Array:
        import numpy as np

        rows = []
        upper = np.triu_indices(DIM)
        for m, p in zip(mean.to_pylist(), product.to_pylist()):
            m, cov = np.array(m), np.zeros((DIM, DIM))
            cov[upper] = p
            cov = np.triu(cov) + np.triu(cov, 1).T - np.outer(m, m)
            rows.append({"mu": m.tolist(), "cov": cov.ravel().tolist(), "inverse": _inverse(cov).ravel().tolist()})
        return pa.array(rows, pa.struct({n: pa.list_(pa.float64()) for n in ("mu", "cov", "inverse")}))

    return estimate


def _inverted():
    @arrow_udf("array<double>")
    def inverted(covs: pa.Array) -> pa.Array:
        import numpy as np

        return pa.array([_inverse(np.array(c).reshape(DIM, DIM)).ravel().tolist() for c in covs.to_pylist()], pa.list_(pa.float64()))

    return inverted


def shrunk(params: DataFrame, family: DataFrame, weight: int) -> DataFrame:
    """The estimates of languages and sources, drawn towards their language's, and those towards all rows'.

    A group of n rows counts for itself with n / (n + ``weight``), so an estimate from few rows is nearly its parent's
    and one from many its own, with no step between. ``family`` has grp, its number of rows and its parent grp.
    """
    all_of = params.join(family, "grp")

    def drawn(child: DataFrame, parent: DataFrame) -> DataFrame:
        parent = parent.select(F.col("grp").alias("parent"), *[F.col(c).alias(f"p_{c}") for c in ("mu", "cov", "scale")])
        own = F.col("n") / (F.col("n") + F.lit(float(weight)))
        mix = {c: F.zip_with(c, f"p_{c}", lambda x, y: own * x + (1 - own) * y) for c in ("mu", "cov")}
        return child.join(parent, "parent").select("grp", "parent", "n", *[m.alias(c) for c, m in mix.items()],
                                                   (own * F.col("scale") + (1 - own) * F.col("p_scale")).alias("scale"))

    languages = drawn(all_of.filter("level = 1").drop("level"), all_of.filter("level = 0"))
    return drawn(all_of.filter("level = 2").drop("level"), languages).select("grp", "mu", _inverted()("cov").alias("inverse"), "scale")


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. from mu under inverse."""
    off = [f"(x{i} - mu[{i}])" for i in range(DIM)]
    return F.expr(" + ".join(f"{off[i]} * {off[j]} * inverse[{i * DIM + j}]" for i in range(DIM) for j in range(DIM)))


def outliers(stats: DataFrame, share: float = 0.6, steps: int = 4, cutoff: float = CHI2_9999, weight: int = 100,
             broadcast_groups: int = 100_000) -> DataFrame:
    """Adds ``distance`` and ``outlier`` by minimum-covariance-determinant estimates for each language and source.

    ``stats`` is a written table. Base-failed rows are neither estimated from nor judged (null distance). For each group the
    estimate starts from medians and median deviations; a step takes the ``share`` of the group's rows that lie nearest, and
    estimates centre and covariance from them, which never raises the determinant; the last step takes all rows within the
    97.5 % ellipsoid. Distances are scaled so that a group's median is the chi-squared one at most. What lies beyond
    ``cutoff`` is an outlier: of normally distributed features that is one clean row in 10 000. All of it is grouped aggregation
    of partial sums and quantile sketches over narrow rows, so a group that holds a third of all rows is no single task.
    Languages and all rows are estimated likewise, and a group's estimate is drawn towards theirs (see ``shrunk``), so that
    every row is judged, however few its group has.
    """
    clean = stats.filter(~F.col("base_failed")).select("*", *[F.expr(e).alias(x) for x, e in FEATURES.items()])
    xs = list(FEATURES)
    rows = materialize(clean.withColumn("_of", _levels()), "vectors")
    every = rows.select(F.explode("_of").alias("g"), *xs).select("g.grp", *xs)
    of = F.col("_of")
    family = materialize(rows.select(F.explode(F.array(*[F.struct(of[i]["grp"].alias("grp"), of[i]["level"].alias("level"), (
        of[i + 1]["grp"] if i < 2 else F.lit(None).cast("string")).alias("parent")) for i in range(3)])).alias("f")).groupBy("f.grp", "f.level", "f.parent").agg(
        F.count("*").alias("n")), "groups")
    few = family.count() <= broadcast_groups
    side = (lambda t: F.broadcast(t)) if few else (lambda t: t)
    mid = every.groupBy("grp").agg(*[F.percentile_approx(x, 0.5, 1000).alias(f"m_{x}") for x in xs])
    mid = materialize(mid, "centres")
    mad = every.join(side(mid), "grp").groupBy("grp").agg(
        *[F.first(f"m_{x}").alias(f"m_{x}") for x in xs],
        *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{x}")), 0.5, 1000).alias(f"s_{x}") for x in xs])
    var = {x: F.greatest(F.pow(1.4826 * F.col(f"s_{x}"), 2), F.lit(LEEWAY[x] ** 2)) for x in xs}
    params = materialize(mad.select("grp", F.array(*[f"m_{x}" for x in xs]).alias("mu"), F.array(
        *[1 / var[x] if x == y else F.lit(0.0) for x in xs for y in xs]).alias("inverse")), "start")
    pairs = [(a, b) for i, a in enumerate(xs) for b in xs[i:]]
    for step in range(steps + 1):
        far = every.join(side(params), "grp").withColumn("d2", _distance())
        limit = far.groupBy("grp").agg(F.percentile_approx("d2", 0.5, 1000).alias("half"), F.percentile_approx(
            "d2", share, 1000).alias("limit"))
        if step == steps:
            limit = limit.withColumn("limit", F.greatest("limit", F.col("half") / CHI2_MEDIAN * CHI2_975))
        near = far.join(side(materialize(limit, "limits")), "grp").filter("d2 <= limit")
        sums = near.groupBy("grp").agg(F.array(*[F.avg(x) for x in xs]).alias("mean"), F.array(
            *[F.avg(F.col(a) * F.col(b)) for a, b in pairs]).alias("product"))
        params = materialize(sums.select("grp", _estimate()("mean", "product").alias("e")).select("grp", "e.mu", "e.cov", "e.inverse"), "estimate")
    scale = every.join(side(params), "grp").withColumn("d2", _distance()).groupBy("grp").agg(
        F.greatest(F.percentile_approx("d2", 0.5, 1000) / CHI2_MEDIAN, F.lit(1.0)).alias("scale"))
    final = materialize(shrunk(params.join(scale, "grp"), family, weight), "final")
    judged = rows.withColumn("grp", of[0]["grp"]).join(side(final), "grp").withColumn(
        "distance", F.sqrt(_distance() / F.col("scale"))).withColumn("outlier", F.col("distance") > cutoff ** 0.5)
    out = judged.select(*stats.columns, "distance", "outlier")
    return out.unionByName(stats.filter("base_failed").withColumns({
        "distance": F.lit(None).cast("double"), "outlier": F.lit(False)}))


def judge(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source"), **tuning) -> DataFrame:
    """Counts, ``base_failed``, ``distance``, ``outlier`` and ``kept`` for every row, beside the kept columns.

    A null text has no words and fails the base rules; null languages and sources are groups of their own; repeated rows are
    judged each; an empty table gives an empty one. Extra columns are ignored unless named in ``keep``.
    """
    stats = materialize(statistics(df, text, keep).withColumn("base_failed", base_failed()), "statistics")
    return outliers(stats, **tuning).withColumn("kept", ~F.col("base_failed") & ~F.col("outlier"))
