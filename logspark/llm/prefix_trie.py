"""Prefix trie of conversations: ROLLUP over positional turn-id columns.

Turns become ids; each block of ``WIDTH`` turns of a conversation is a row with a column a place, keyed by the node that
the conversation reached before it. GROUP BY block, node, ROLLUP(places) then gives every prefix of every conversation in
one aggregation, whatever their length. A node's key is its depth and the exclusive-or of its turns' ids, each of which
is mixed with its place (two times 64 bits), so that the node before any block comes from a running aggregate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .common import bounded_batches

#: Turns of a block, that is columns of a ROLLUP.
WIDTH = 8
#: Most of an earlier conversation's turns that another may begin with.
MOST_SHARED = 5
#: Conversation numbers that are joined to one text before they are hashed in order.
CHUNK = 1000


def running(df: DataFrame, key: list[str], order: list[str], made: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds exclusive running aggregates over each key's rows in order, however many rows a key has.

    ``made`` gives for each new column ``(sum or bit_xor, column)``. The table is cut into ranges of (key, order); a row's
    value is the total of the key's earlier ranges and of the rows before it in its own. A range is one task's rows; of a
    key only the ranges' totals meet, one row each. No two rows may be equal in key and order; nulls come first.
    """
    aggregate = {"sum": F.sum, "bit_xor": F.bit_xor}
    both = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}
    ranged = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in [*key, *order]])
    ranged = materialize(ranged.withColumn("_range", F.spark_partition_id()), "ranged")
    before = Window.partitionBy("_range", *key).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.select("*", *[aggregate[how](c).over(before).alias(f"_in_{n}") for n, (how, c) in made.items()])
    totals = ranged.groupBy("_range", *key).agg(*[aggregate[how](c).alias(f"_all_{n}") for n, (how, c) in made.items()], F.lit(1).alias("_one"))
    carried = totals.select("_range", *key, F.sum("_one").over(earlier).alias("_ranges"),
                            *[aggregate[how](f"_all_{n}").over(earlier).alias(f"_to_{n}") for n, (how, _) in made.items()])
    joined = own.join(carried.filter("_ranges > 0"), ["_range", *key], "left")
    zero = F.lit(0).cast("long")
    return joined.select(*df.columns, *[both[how](F.coalesce(f"_in_{n}", zero), F.coalesce(f"_to_{n}", zero)).alias(n) for n, (how, _) in made.items()])


def numbered(turns: DataFrame) -> DataFrame:
    """Each turn's conversation, place from 1 and id: two halves of a digest of (role, text), and the text's characters.

    Turns go by number, null first; equal numbers by role, then text. Rows of equal conversation, number, role and text
    are turns of their own. Rows without a conversation are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"),
                                                      role.alias("role"), text.alias("text"))
    equal = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("times"))
    digest = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    half = lambda at: F.conv(F.substring("_digest", at, 15), 16, 10).cast("long")
    equal = equal.withColumn("_digest", digest).select(
        "conv", "turn", "role", "text", "times", half(1).alias("a"), half(16).alias("b"), F.char_length("text").cast("long").alias("chars"))
    placed = running(equal, ["conv"], ["turn", "role", "text"], {"before": ("sum", "times")})
    places = F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("times")))
    return placed.select("conv", places.alias("place"), "a", "b", "chars")


def rebuilt(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of an earlier one: their turns, and all conversations with their lengths.

    Conversation c takes the first h turns of conversation c - c % 100 (all if it has fewer), h being crc32 of c's decimal
    number modulo 6, and goes on with its own turns after its first h. Remainders have their number's sign.
    """
    own = places.groupBy("conv").agg(F.max("place").alias("own"))
    own = own.withColumn("base", F.col("conv") - F.col("conv") % 100).withColumn(
        "h", F.crc32(F.col("conv").cast("string").cast("binary")) % (MOST_SHARED + 1))
    heads = places.filter((F.col("place") <= MOST_SHARED) & (F.col("conv") % 100 == 0)).groupBy("conv").agg(
        *[F.max(F.when(F.col("place") == k, F.struct("a", "b", "chars"))).alias(f"head{k}") for k in range(1, MOST_SHARED + 1)],
        F.max("place").alias("n_heads"))
    every = own.join(heads.withColumnRenamed("conv", "base"), "base", "left").withColumn(
        "given", F.least("h", F.coalesce("n_heads", F.lit(0).cast("long"))))
    every = materialize(every.withColumn("length", F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0).cast("long"))), "rebuilt")
    first = every.select("conv", F.posexplode(F.array(*[f"head{k}" for k in range(1, MOST_SHARED + 1)])).alias("k", "turn"), "given")
    first = first.filter(F.col("k") < F.col("given")).select("conv", (F.col("k") + 1).cast("long").alias("place"), "turn.a", "turn.b", "turn.chars")
    rest = places.join(every.select("conv", "h", "given"), "conv").filter(F.col("place") > F.col("h")).select(
        "conv", (F.col("place") - F.col("h") + F.col("given")).alias("place"), "a", "b", "chars")
    return first.unionByName(rest), every.select("conv", "length")


def blocks(turns: DataFrame, convs: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row for each block of ``width`` turns of a conversation: the node before it, and a column for each place.

    A conversation without turns has one block without any. Columns: conv, length, block, pa, pb (the node before), t1 ...
    """
    mixed = turns.select("conv", F.floor((F.col("place") - 1) / width).cast("long").alias("block"), ((F.col("place") - 1) % width + 1).alias("k"),
                         F.struct(F.xxhash64("place", "a", "b").alias("a"), F.xxhash64("b", "place", "a").alias("b"), "chars").alias("t"))
    wide = mixed.groupBy("conv", "block").agg(*[F.max(F.when(F.col("k") == k, F.col("t"))).alias(f"t{k}") for k in range(1, width + 1)],
                                              F.bit_xor("t.a").alias("xa"), F.bit_xor("t.b").alias("xb"))
    wide = running(wide, ["conv"], ["block"], {"pa": ("bit_xor", "xa"), "pb": ("bit_xor", "xb")})
    whole = convs.join(wide, "conv", "left")
    return whole.select("conv", "length", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("block", "pa", "pb")],
                        *[f"t{k}" for k in range(1, width + 1)])


def rolled_up(table: DataFrame, width: int, **aggregates: str) -> DataFrame:
    """Every prefix as a row: its depth, key (a, b), its parent's key, its last turn's characters, and the aggregates.

    ROLLUP groups by the first k of the block's places for each k; grouping_id says which. Groups whose last place is
    null hold conversations that ended before it, and all but the first block's empty prefix are nodes of an earlier block.
    """
    places = [f"t{k}" for k in range(1, width + 1)]
    grouped = table.sparkSession.sql(
        f"""SELECT block, pa, pb, {', '.join(places)}, grouping_id() AS _id, {', '.join(f'{how} AS {n}' for n, how in aggregates.items())}
        FROM {{blocks}} GROUP BY block, pa, pb, ROLLUP({', '.join(places)})""", blocks=table)
    level = sum((F.when(F.col("_id").bitwiseAND(1 << (width - k)) == 0, 1).otherwise(0) for k in range(1, width + 1)), F.lit(0))
    grouped = grouped.withColumn("_level", level)
    last = F.element_at(F.array(*places), F.greatest(F.col("_level"), F.lit(1)))
    root = (F.col("_level") == 0) & (F.col("block") == 0)
    grouped = grouped.filter(root | ((F.col("_level") > 0) & last.isNotNull()))
    key = _key(width)
    return grouped.select((F.col("block") * width + F.col("_level")).alias("depth"), *[key[h].alias(h) for h in key],
                          *[F.when(F.col("_level") > 0, key[h].bitwiseXOR(last[h])).alias(f"up_{h}") for h in key],
                          F.when(F.col("_level") > 0, last["chars"]).otherwise(F.lit(0).cast("long")).alias("chars"), *aggregates)


def _key(width: int) -> dict[str, Column]:
    """The key of the node after a block row's last place."""
    key = {h: F.col(f"p{h}") for h in ("a", "b")}
    for k in range(1, width + 1):
        key = {h: c.bitwiseXOR(F.coalesce(F.col(f"t{k}.{h}"), F.lit(0).cast("long"))) for h, c in key.items()}
    return key


def ends_digest(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's conversation numbers in ascending order, comma-joined; rows: depth, a, b, conv.

    Numbers are put in order over all tasks and joined to chunks there; a node's digest then reads its chunks in order,
    holding one at a time. A digest is sequential, so a node's chunks go through one task.
    """
    key = ["depth", "a", "b"]
    ranged = ends.repartitionByRange(*key, "conv").withColumn("_range", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("_range", *key).orderBy("conv"))
    chunks = ranged.withColumn("_chunk", F.floor((place - 1) / CHUNK)).groupBy("_range", "_chunk", *key).agg(
        F.min("conv").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("joined"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []

        def done() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({**{n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(key)},
                                                "ends_sha256": pa.array([r[3] for r in out], pa.string())})
            out.clear()
            return batch

        for batch in batches:
            for *node, joined in zip(*(batch.column(n).to_pylist() for n in [*key, "joined"])):
                if node != now:
                    if state:
                        out.append([*now, state.hexdigest()])
                    now, state = node, hashlib.sha256(joined.encode())
                else:
                    state.update(b"," + joined.encode())
            yield done()
        if state:
            out.append([*now, state.hexdigest()])
            yield done()

    dealt = bounded_batches(chunks).repartition(*key).sortWithinPartitions(*key, "first").select(*key, "joined")
    return dealt.mapInArrow(digest, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, width: int = WIDTH) -> DataFrame:
    """The trie of all rebuilt conversations, a row a node.

    Columns: conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Of (conv_id, turn, role, text) a null role or text is empty, a null turn first, a row
    without conversation left out; no rows give no nodes, not even the root.

    Sums over subtrees need no walk: each node belongs to its smallest member, and from the depth at which a conversation
    becomes the smallest it owns all deeper nodes of its path. So a node's subtree sum is the sum of what its members own,
    less what its owner owns above it; the first is a second ROLLUP, the second a running sum over owned nodes.
    """
    turns, convs = rebuilt(materialize(numbered(conversations), "places"))
    table = materialize(blocks(turns, convs, width), "blocks")
    key = ["depth", "a", "b"]
    nodes = materialize(rolled_up(table, width, conv_id="min(conv)", n_convs="count(*)", longest="max(length)"), "nodes")

    saving = (F.col("n_convs") - 1) * F.col("chars")
    leaf = (F.col("longest") == F.col("depth")).cast("long")
    owned = nodes.groupBy("conv_id").agg(F.sum(saving).alias("saved"), F.sum(leaf).alias("leaves")).withColumnRenamed("conv_id", "conv")
    below = rolled_up(table.join(owned, "conv", "left"), width, saved="sum(coalesce(saved, 0L))", leaves="sum(coalesce(leaves, 0L))")
    above = running(nodes.select(*key, F.col("conv_id").alias("owner"), saving.alias("saving")), ["owner"], ["depth"],
                    {"above": ("sum", "saving")})
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(
        F.count("*").alias("n_children"))

    # Each conversation ends at the node after its last block.
    last = table.filter((F.col("length") == 0) | F.col("length").between(F.col("block") * width + 1, F.col("block") * width + width))
    end = _key(width)
    ends = last.select(F.col("length").alias("depth"), end["a"].alias("a"), end["b"].alias("b"), "conv")

    facts = [("conv_id", "long"), ("up_a", "long"), ("up_b", "long"), ("n_convs", "long"), ("saved", "long"), ("leaves", "long"),
             ("above", "long"), ("n_children", "long"), ("ends_sha256", "string")]
    rows = None
    for part in (nodes, below.drop("up_a", "up_b"), above, children, ends_digest(ends)):
        part = part.select(*key, *[(F.col(n) if n in part.columns else F.lit(None).cast(t)).alias(n) for n, t in facts])
        rows = part if rows is None else rows.unionByName(part)
    whole = materialize(rows.groupBy(*key).agg(*[F.max(n).alias(n) for n, _ in facts]), "trie")
    owners = whole.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    none = F.lit(0).cast("long")
    return whole.join(owners, ["depth", "up_a", "up_b"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", none).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") - F.coalesce("above", none)).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
