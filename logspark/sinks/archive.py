"""Evidence archive: appends sealed by hash trees whose roots are chained.

Each append writes its rows in a fixed order with their numbers, the nodes of a tree over them (``FAN`` children a node,
built level by level, each node from a bounded group), and a manifest row with the root, linked to the manifest row
before it. So a changed, removed, added or swapped row is found and named, and that a row belongs to the archive can be
proved with one group of hashes a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.windows import in_order
from ..session import materialize
from .files import archive_rows

FAN = 256
BROADCAST = 1 << 18  # nodes above the leaves, some 90 bytes each
MANIFEST = "seal bigint, n bigint, root string, previous string, link string"
_ROW = ("ts", "trace_id", "hash", "raw")


def leaf_hash() -> Column:
    """A row's hash; the text before it keeps rows and inner nodes apart."""
    return F.sha2(F.concat(F.lit("row "), F.to_json(F.struct(*_ROW))), 256)


def _node(children: Column) -> Column:
    return F.sha2(F.concat(F.lit("node "), F.array_join(children, "")), 256)


def _parents(level: DataFrame, keys: list[str]) -> DataFrame:
    """The nodes above (keys, no, hash)."""
    group = level.groupBy(*keys, F.floor(F.col("no") / FAN).alias("up")).agg(F.array_sort(F.collect_list(F.struct("no", "hash"))).alias("c"))
    return group.select(*keys, F.col("up").alias("no"), _node(F.col("c.hash")).alias("hash"))


def _link(previous: Column, seal: Column, n: Column, root: Column) -> Column:
    return F.sha2(F.concat_ws("|", previous, seal.cast("string"), n.cast("string"), root), 256)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row an append: its number, rows, root, the link before it and its own."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/*")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], MANIFEST)


def append(events: DataFrame, path: str) -> int:
    """Seals events as the next append and returns its number; the manifest row is written last, so a broken append has none."""
    spark, path = events.sparkSession, path.rstrip("/")
    last = manifest(spark, path).orderBy(F.desc("seal")).first()
    seal, previous = (0, "") if last is None else (last.seal + 1, last.link)
    rows = archive_rows(events).select(*_ROW)
    rows = in_order(rows.withColumn("hash_of_row", leaf_hash()), ["trace_id", "hash_of_row"], "no")
    rows.write.mode("overwrite").parquet(f"{path}/rows/seal={seal}")
    level = spark.read.parquet(f"{path}/rows/seal={seal}").select("no", F.col("hash_of_row").alias("hash"))
    n, depth = level.count(), 0
    tree = level.withColumn("level", F.lit(0))
    while depth == 0 or size > 1:
        depth += 1
        level = materialize(_parents(level, []), "tree")
        size = level.count()
        tree = tree.unionByName(level.withColumn("level", F.lit(depth)))
    tree.select("level", "no", "hash").write.mode("overwrite").parquet(f"{path}/tree/seal={seal}")
    top = level.first()
    root = top.hash if top else ""
    row = spark.createDataFrame([(seal, n, root, previous)], "seal bigint, n bigint, root string, previous string")
    row.withColumn("link", _link(F.col("previous"), F.col("seal"), F.col("n"), F.col("root"))).coalesce(1).write.parquet(f"{path}/manifest/{seal:08d}")
    return seal


def stored(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (with seal and number), tree and manifest of an archive."""
    path = path.rstrip("/")
    return spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/tree"), manifest(spark, path)


def verify(rows: DataFrame, tree: DataFrame, sealed: DataFrame) -> DataFrame:
    """What does not fit: (seal, level, no, trace_id, problem), no rows if all does.

    Level 0 are rows: ``changed`` (its place holds another hash; two swapped rows are both changed), ``removed``, ``added``. Above
    are nodes that don't follow from the level below, and as level -1 the manifest: ``root``, or a broken ``chain``.
    """
    now = rows.select("seal", "no", "trace_id", leaf_hash().alias("now"))
    leaves = tree.filter("level = 0").select("seal", "no", "hash")
    met = now.join(leaves, ["seal", "no"], "full")
    problem = (F.when(F.col("hash").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("hash"), "changed"))
    bad = met.select("seal", F.lit(0).alias("level"), "no", "trace_id", problem.alias("problem")).filter("problem IS NOT NULL")

    # All levels at once: what the nodes of each level make is compared with the level above.
    made = _parents(tree, ["seal", "level"]).select("seal", (F.col("level") + 1).alias("level"), "no", F.col("hash").alias("made"))
    tops = tree.groupBy("seal").agg(F.max("level").alias("top"))
    inner = made.join(tree.filter("level > 0"), ["seal", "level", "no"], "full").join(tops, "seal").filter("level <= top")
    bad = bad.unionByName(inner.filter(~F.col("made").eqNullSafe(F.col("hash"))).select(
        "seal", "level", "no", F.lit(None).cast("string").alias("trace_id"), F.lit("node").alias("problem")))

    roots = tree.join(tops, "seal").filter("level = top").select("seal", F.col("hash").alias("made"))
    held = leaves.groupBy("seal").agg(F.count("*").alias("held"))
    before = sealed.select((F.col("seal") + 1).alias("seal"), F.col("link").alias("before"))
    chained = sealed.join(roots, "seal", "full").join(before, "seal", "left").join(held, "seal", "left")
    last = F.coalesce("before", F.when(F.col("seal") == 0, ""))
    wrong = (F.when(~F.col("root").eqNullSafe(F.coalesce("made", F.lit(""))) | (F.col("n") != F.coalesce("held", F.lit(0))), "root")
             .when(~F.col("previous").eqNullSafe(last) | (F.col("link") != _link(F.col("previous"), F.col("seal"), F.col("n"), F.col("root"))), "chain"))
    return bad.unionByName(chained.select("seal", F.lit(-1).alias("level"), F.lit(0).cast("bigint").alias("no"),
                                          F.lit(None).cast("string").alias("trace_id"), wrong.alias("problem")).filter("problem IS NOT NULL"))


def proofs(rows: DataFrame, tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """For rows named by ``wanted`` (trace_id): their hash, and from below the groups of hashes that lead to the root:
    (seal, no, trace_id, leaf, path array<struct<level, place, hashes>>).

    A row meets its path in the last join, by the group it is in, so groups are moved and paths of rows are not.
    """
    tops = F.broadcast(tree.groupBy("seal").agg(F.max("level").alias("top")))
    named = rows.join(wanted.select("trace_id").distinct(), "trace_id").select("seal", "no", "trace_id", F.col("hash_of_row").alias("leaf"))
    named = named.distinct().join(tops, "seal").filter("top > 0").drop("top").withColumn("up", F.floor(F.col("no") / FAN))

    def groups(nodes: DataFrame, *keys: str) -> DataFrame:
        sorted_group = F.array_sort(F.collect_list(F.struct("no", "hash")))["hash"]
        return nodes.groupBy(*keys, F.floor(F.col("no") / FAN).alias("up")).agg(sorted_group.alias("hashes"))

    # The steps above the leaves are the same for all leaves below one group of level 1.
    leaves = tree.filter("level = 0")
    above = leaves.select("seal", F.floor(F.col("no") / FAN / FAN).alias("over")).distinct().join(tops, "seal").filter("top > 1")
    above = above.withColumn("level", F.explode(F.sequence(F.lit(1), F.col("top") - 1)))
    above = above.withColumn("up", F.floor(F.col("over") / F.pow(F.lit(float(FAN)), F.col("level") - 1)))
    high = groups(tree.filter("level > 0"), "seal", "level")
    above = above.join(high, ["seal", "level", "up"]).groupBy("seal", "over").agg(
        F.array_sort(F.collect_list(F.struct("level", "hashes"))).alias("above"))
    if tree.filter("level > 0").count() <= BROADCAST:
        above = F.broadcast(above)
    low = groups(leaves, "seal").withColumn("over", F.floor(F.col("up") / FAN)).join(above, ["seal", "over"], "left").drop("over")

    def step(level: Column, hashes: Column) -> Column:
        at = F.floor(F.col("no") / F.pow(F.lit(float(FAN)), level)).cast("bigint")
        return F.struct(level.alias("level"), (at % FAN).cast("int").alias("place"), hashes.alias("hashes"))

    first = F.array(step(F.lit(0), F.col("hashes")))
    later = F.transform("above", lambda s: step(s["level"], s["hashes"]))
    path = F.when(F.col("hashes").isNull(), F.slice(first, 1, 0)).when(F.col("above").isNull(), first).otherwise(F.concat(first, later))
    return named.hint("shuffle_hash").join(low, ["seal", "up"], "left").select("seal", "no", "trace_id", "leaf", path.alias("path"))


def proved(proof: DataFrame, sealed: DataFrame) -> DataFrame:
    """Adds ``ok``: each group holds the hash made below at its place, and the last one makes the sealed root."""
    start = F.struct(F.col("leaf").alias("hash"), F.lit(True).alias("ok"))
    end = F.aggregate("path", start, lambda s, g: F.struct(
        _node(g["hashes"]).alias("hash"), (s["ok"] & (F.get(g["hashes"], g["place"]) == s["hash"])).alias("ok")))
    return proof.join(sealed.select("seal", "root"), "seal").withColumn("_end", end).withColumn(
        "ok", F.col("_end.ok") & (F.col("_end.hash") == F.col("root"))).drop("_end", "root")
