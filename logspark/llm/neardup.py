"""Near-duplicates: b-bit MinHash signatures, joined by a multi-index for Hamming distance, confirmed on the full sets.

A signature has HASHES symbols of 16 bits. Two sets of similarity 0.75 differ in a quarter of them on average (18 of 72,
standard deviation 3.7); the join finds every pair that differs in at most DISTANCE = 35, which a pair at the very threshold
exceeds about once in 200 000. By the pigeonhole principle such a pair has a chunk of CHUNK symbols with at most one error
(18 chunks with two errors each would make 36), so each signature is entered under each chunk with each one symbol masked.

Nothing is compared within a bucket of the index as a whole:

1. Equal sets are one class. Only classes are entered.
2. Each class is compared with the lead of most of its buckets, the middle of its group. Confirmed links make components.
3. Buckets whose classes are all in one component are done: a large group of near copies ends here, at one comparison a member.
   In the others, pairs of different components are compared, if the bucket has at most ``bucket`` classes.
4. Classes that meet in larger buckets, such as documents around one common passage, are joined among themselves by exact prefix
   filtering: similar sets share one of their rarest shingles, and a common passage has none of those. Full sets are compared
   with the likeliest partner first, until a class is linked or has no partner left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from ..session import materialize
from .common import bounded_batches, map_batches, text_of

HASHES, CHUNK, DISTANCE = 72, 4, 35
CHUNKS = HASHES // CHUNK
SHINGLE = 5
#: Similarity of a link, in per cent: 100 * common >= LEAST * union.
LEAST = 75
#: Sets or rows beyond so many are shuffled, not broadcast.
BROADCAST_ROWS = 500_000
#: Cells in which shingles are counted to tell rare ones from frequent ones; decides how much is compared, never what is linked.
CELLS = 1 << 20
#: Rows that cross to Python at once: a text is there with its words, their hashes and its set.
BATCH = 250

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of n hash functions, from a fixed seed."""
    draw = np.random.Generator(np.random.PCG64(2024)).integers(0, (1 << 64) - 1, (2, n), "u8")
    return draw[0] | np.uint64(1), draw[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _STEP
    return x ^ (x >> np.uint64(32))


class WordHash(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def shingles(text: str, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of five words; of all its words if it has fewer; none without words.

    Words are separated by blanks, tabs and line ends only; A-Z are lower-cased.
    """
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, "u8")
    h = np.fromiter(map(hashes.__getitem__, words), "u8", n)
    width = min(n, SHINGLE)
    out = np.full(n - width + 1, width, "u8")
    for i in range(width):
        out = _mix(out * _STEP + h[i:n - width + 1 + i])
    return np.unique(out)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 1024) -> np.ndarray:
    """The b-bit MinHash symbols of a set."""
    low = None
    for i in range(0, len(s), block):
        part = (s[i:i + block, None] * a + b).min(axis=0)
        low = part if low is None else np.minimum(low, part)
    return (_mix(low) >> np.uint64(48)).astype("<u2")


def row_key(doc: str = "doc_id", text: str = "text") -> Column:
    """A number for a row's document number and text."""
    return F.xxhash64(F.coalesce(F.col(doc).cast("string"), F.lit("null")), text_of(text))


def signed(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Per document: number, row key, set size, class (a hash of the set; null for an empty one), signature."""
    rows = df.select(F.col(doc).cast("long").alias("doc"), row_key(doc, text).alias("key"), text_of(text).alias("text"))

    def make():
        import hashlib

        hashes, (a, b) = WordHash(), _family(HASHES)

        def work(batch):
            sets, out = [], []
            for t in batch["text"].to_pylist():
                s = shingles(t, hashes)
                sets.append(len(s))
                out.append((int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True),
                            signature(s, a, b).tobytes()) if len(s) else (None, None))
            return {"doc": batch["doc"], "key": batch["key"], "n": sets, "cls": [x for x, _ in out], "sig": [x for _, x in out]}
        return work

    return map_batches(rows, make, "doc long, key long, n long, cls long, sig binary")


def index_keys(classes: DataFrame) -> DataFrame:
    """Each class under each chunk with each one symbol masked: bucket, cls, n."""
    def make():
        def work(batch):
            sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), "<u2").reshape(-1, CHUNKS, CHUNK).astype("i8")
            keys = []
            for masked in range(CHUNK):
                rest = [i for i in range(CHUNK) if i != masked]
                value = np.zeros(sig.shape[:2], "i8")
                for i in rest:
                    value = (value << 16) | sig[:, :, i]
                keys.append(value | ((np.arange(CHUNKS, dtype="i8") * CHUNK + masked) << 48))
            per = CHUNKS * CHUNK
            return {"bucket": pa.array(np.stack(keys, 2).ravel()), "cls": pa.array(np.repeat(np.asarray(batch["cls"]), per)),
                    "n": pa.array(np.repeat(np.asarray(batch["n"]), per))}
        return work

    return map_batches(classes.select("cls", "n", "sig"), make, "bucket long, cls long, n long")


def _same(a: str, b: str) -> Column:
    """Symbols that two signatures share."""
    @arrow_udf("int")
    def agree(x: pa.Array, y: pa.Array) -> pa.Array:
        u, v = (np.frombuffer(b"".join(c.to_pylist()), "<u2").reshape(-1, HASHES) for c in (x, y))
        return pa.array((u == v).sum(axis=1).astype("i4"))

    return agree(F.col(a), F.col(b))


def _common(a: str, b: str) -> Column:
    """Shingles that two packed sets share."""
    @arrow_udf("long")
    def common(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([len(np.intersect1d(np.frombuffer(u, "u8"), np.frombuffer(v, "u8"), assume_unique=True))
                         for u, v in zip(x.to_pylist(), y.to_pylist())], pa.int64())

    return common(F.col(a), F.col(b))


def similar_sizes(a: str, b: str) -> Column:
    return F.expr(f"100 * least({a}, {b}) >= {LEAST} * greatest({a}, {b})")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def sets_of(df: DataFrame, classes: DataFrame, wanted: DataFrame, doc: str, text: str) -> DataFrame:
    """The shingle sets of the wanted classes, from the text of one document each: cls, n, shingles (packed)."""
    reps = materialize(classes.join(wanted, "cls", "left_semi").select("key", F.col("cls").alias("want")), "wanted")
    rows = df.select(row_key(doc, text).alias("key"), text_of(text).alias("text")).join(_small(reps), "key").select("want", "text")

    def make():
        import hashlib

        hashes = WordHash()

        def work(batch):
            out = []
            for want, t in zip(batch["want"].to_pylist(), batch["text"].to_pylist()):
                s = shingles(t, hashes)
                if int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) == want:
                    out.append((want, len(s), s.tobytes()))
            return dict(zip(("cls", "n", "shingles"), zip(*out))) if out else {"cls": [], "n": [], "shingles": []}
        return work

    return materialize(map_batches(rows, make, "cls long, n long, shingles binary").dropDuplicates(["cls"]), "sets")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", _common("sa", "sb"))
    return both.filter(F.expr(f"100 * common >= {LEAST} * (na + nb - common)")).select("a", "b")


def near_signatures(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose signatures differ in at most DISTANCE symbols and whose sizes allow the similarity."""
    left = classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    return (pairs.join(left, "a").join(right, "b").filter(similar_sizes("na", "nb"))
            .withColumn("same", _same("sa", "sb")).filter(F.col("same") >= HASHES - DISTANCE).select("a", "b", "same"))


def near_in_buckets(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``near_signatures`` of all pairs (a, b) of different components in each bucket (bucket, cls, comp, n), compared in one place;
    for small buckets."""
    @arrow_udf("array<struct<a: long, b: long>>")
    def near(groups: pa.Array) -> pa.Array:
        out = []
        for group in groups.to_pylist():
            cls, comp, n = (np.array([g[c] for g in group], "i8") for c in ("cls", "comp", "n"))
            sig = np.frombuffer(b"".join(g["sig"] for g in group), "<u2").reshape(-1, HASHES)
            found = []
            for i in range(len(group) - 1):
                close = (comp[i + 1:] != comp[i]) & (100 * np.minimum(n[i + 1:], n[i]) >= LEAST * np.maximum(n[i + 1:], n[i]))
                others = i + 1 + np.flatnonzero(close)
                others = others[(sig[others] == sig[i]).sum(axis=1) >= HASHES - DISTANCE]
                found += [{"a": int(min(cls[i], cls[j])), "b": int(max(cls[i], cls[j]))} for j in others]
            out.append(found)
        return pa.array(out, pa.list_(pa.struct({"a": pa.int64(), "b": pa.int64()})))

    groups = rows.join(classes.select("cls", "sig"), "cls").groupBy("bucket").agg(F.collect_list(F.struct("cls", "comp", "n", "sig")).alias("g"))
    return bounded_batches(groups).select(F.explode(near("g")).alias("x")).select("x.a", "x.b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): node, comp (the least node), by alternating large-star and small-star steps.

    Every step replaces a node's links by links to its least neighbour, with aggregations and joins only; the links are written
    after each round, so a lost executor costs a round's tasks.
    """
    def canonical(e):
        return e.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def stamp(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = materialize(canonical(edges), "edges")
    before = stamp(now)
    while before[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b")
        large = materialize(canonical(large.union(least.select(F.col("m").alias("a"), F.col("a").alias("b")))), "edges")
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        now = materialize(canonical(small.select(F.col("m").alias("a"), F.col("v").alias("b")).union(
            least.select(F.col("m").alias("a"), F.col("u").alias("b")))), "edges")
        after = stamp(now)
        if after == before:
            break
        before = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("comp"))


def with_components(df: DataFrame, comps: DataFrame) -> DataFrame:
    """Adds ``comp`` to rows with ``cls``; a class without links is its own."""
    return df.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))


def shingle_counts(sets: DataFrame, cells: int) -> np.ndarray:
    """How many shingles of the given sets fall into each of so many cells, a power of two: at least as many as hold any one of them."""
    def make():
        def work(batch):
            packed = b"".join(batch["shingles"].to_pylist())
            cell, n = np.unique(np.frombuffer(packed, "u8") & np.uint64(cells - 1), return_counts=True)
            return {"cell": pa.array(cell.astype("i8")), "n": pa.array(n.astype("i8"))}
        return work

    found = map_batches(sets.select("shingles"), make, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells, "i8")
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out


def prefix_pairs(sets: DataFrame, comps: DataFrame, cells: int = CELLS) -> DataFrame:
    """Pairs of different components that share one of their rarest shingles: every similar pair among the given sets.

    In any one order of all shingles, two sets of similarity s share one of the first n - ceil(s n) + 1 of each. The order
    is by the count of a shingle's cell, rarest first, then by the shingle: a shingle of many sets comes late, whatever
    shares its cell, and only prefixes leave the sets. A shingle alone in its cell, and one all whose holders are in
    one component, gives no pairs.
    """
    counts = sets.sparkSession.sparkContext.broadcast(shingle_counts(sets, cells))

    def make():
        known = counts.value

        def work(batch):
            shingle, rank, sizes = [], [], []
            for packed, n in zip(batch["shingles"].to_pylist(), batch["n"].to_pylist()):
                s = np.frombuffer(packed, "u8")
                seen = known[s & np.uint64(cells - 1)]
                first = np.lexsort((s, seen))[:n + LEAST * -n // 100 + 1]
                shared = np.flatnonzero(seen[first] > 1)
                shingle.append(s[first[shared]].view("i8"))
                rank.append(shared + 1)
                sizes.append(len(shared))
            spread = {c: pa.array(np.repeat(batch[c].to_numpy(zero_copy_only=False), sizes)) for c in ("cls", "comp", "n")}
            return spread | {"s": pa.array(np.concatenate(shingle)), "r": pa.array(np.concatenate(rank).astype("i8"))}
        return work

    rows = with_components(sets, comps).select("cls", "comp", "n", "shingles")
    prefix = materialize(map_batches(rows, make, "s long, cls long, comp long, n long, r long"), "prefix")
    mixed = prefix.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("s")
    open_ = prefix.join(mixed, "s", "left_semi")
    x, y = open_.alias("x"), open_.alias("y")
    least = f"({LEAST} * (x.n + y.n) / {100 + LEAST})"
    return x.join(y, F.expr("x.s = y.s AND x.cls < y.cls AND x.comp <> y.comp") & similar_sizes("x.n", "y.n")
                  & F.expr(f"1 + least(x.n - x.r, y.n - y.r) >= {least}")).select(
        F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()


def best_first(pairs: DataFrame, sets: DataFrame, edges: DataFrame, comps: DataFrame, tops: tuple[int, ...] = (4,)) -> DataFrame:
    """Adds the confirmed links among pairs (a, b, same) to the edges.

    Of a pair the class of the smaller component chooses: first each is compared with the few partners whose signatures are
    most like its own, then with all that are left; after each step pairs whose classes have come
    into one component are settled. In a group whose similarities lie on both sides of the bound, where a class has
    hundreds of partners and needs one, few are ever compared.
    """
    for top in (*tops, None):
        sized = comps.join(comps.groupBy("comp").agg(F.count("*").alias("size")), "comp").select("node", "comp", "size")
        left = pairs.join(sized.toDF("a", "ca", "sa"), "a", "left").join(sized.toDF("b", "cb", "sb"), "b", "left").filter(
            F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        smaller = F.when(F.coalesce("sa", F.lit(1)) <= F.coalesce("sb", F.lit(1)), F.col("a")).otherwise(F.col("b"))
        left = materialize(left.select("a", "b", "same", smaller.alias("x")), "left")
        chosen = left.select("a", "b")
        if top is not None:
            rank = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("same"), "a", "b"))
            chosen = materialize(left.withColumn("r", rank).filter(F.col("r") <= top).select("a", "b"), "chosen")
            pairs = left.join(chosen, ["a", "b"], "left_anti").select("a", "b", "same")
        edges = materialize(edges.union(confirm(chosen, sets)), "links")
        if top is not None:
            comps = materialize(components(edges), "components")
    return edges


def star_links(df: DataFrame, shared: DataFrame, classes: DataFrame, doc: str, text: str,
               rounds: int) -> tuple[DataFrame, DataFrame]:
    """Confirmed links between classes and the leads of their buckets; and the components of those links.

    In the first round a bucket's lead is its class that meets most others over all buckets: the middle of a group of near
    copies, which most of them share; in each later round another one. A class is compared with one lead a round, the one
    that leads most of its buckets, and only if that is of another component; no pair is compared twice. So a round
    costs a comparison a class at most, and leaves fewer components to compare in pairs.
    """
    meets = shared.groupBy("cls").agg(F.sum("c").alias("meets"))
    shared = materialize(shared.select("bucket", "cls", "n").join(meets, "cls"), "met")
    edges, done, comps = None, None, None
    for r in range(rounds):
        known = shared.withColumn("comp", F.col("cls")) if comps is None else materialize(with_components(shared, comps), "known")
        rank = F.struct("meets", F.xxhash64("cls")) if r == 0 else F.struct(F.xxhash64("cls", F.lit(r)))
        lead = known.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max_by(
            F.struct("cls", "n", "comp"), rank).alias("lead")).filter("lo < hi")
        led = known.join(lead, "bucket").filter("comp <> lead.comp").filter(similar_sizes("n", "lead.n"))
        led = led.groupBy("cls", F.col("lead.cls").alias("lead")).agg(F.count("*").alias("buckets"))
        if done is not None:
            led = led.join(done.select(F.col("a").alias("cls"), F.col("b").alias("lead")).union(done.select("b", "a")), ["cls", "lead"], "left_anti")
        spokes = led.groupBy("cls").agg(F.max_by("lead", F.struct("buckets", "lead")).alias("lead")).select(
            F.least("cls", "lead").alias("a"), F.greatest("cls", "lead").alias("b")).distinct()
        spokes = materialize(spokes, "spokes")
        star = materialize(near_signatures(spokes, classes).select("a", "b"), "star")
        ends = star.select(F.col("a").alias("cls")).union(star.select("b")).distinct()
        found = confirm(star, sets_of(df, classes, ends, doc, text))
        edges = materialize(found if edges is None else edges.union(found), "links")
        done = spokes if done is None else done.union(spokes)
        comps = materialize(components(edges), "components")
    return edges, comps


def links(df: DataFrame, docs: DataFrame, doc: str = "doc_id", text: str = "text", bucket: int = 64,
          rounds: int = 1) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets, and the component of each class that has a link. ``docs`` is written, from ``signed``."""
    classes = materialize(docs.filter("cls IS NOT NULL").groupBy("cls").agg(
        F.min("key").alias("key"), F.min("n").alias("n"), F.min("sig").alias("sig")), "classes")
    keys = materialize(index_keys(classes), "index")
    buckets = keys.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1")
    shared = materialize(keys.join(buckets, "bucket"), "shared")
    edges, comps = star_links(df, shared, classes, doc, text, rounds)

    known = with_components(shared.select("bucket", "cls", "n", "c"), comps)
    mixed = known.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("bucket")
    open_ = materialize(known.join(mixed, "bucket", "left_semi"), "open")
    more = materialize(near_in_buckets(open_.filter(F.col("c") <= bucket), classes), "pairs")
    crowd = materialize(open_.filter(F.col("c") > bucket).select("cls").distinct(), "crowd")
    ends = more.select(F.col("a").alias("cls")).union(more.select("b")).union(crowd).distinct()
    sets = sets_of(df, classes, ends, doc, text)
    edges = materialize(edges.union(confirm(more, sets)), "links")
    if not crowd.isEmpty():
        comps = materialize(components(edges), "components")
        rest = prefix_pairs(sets.join(crowd, "cls", "left_semi"), comps)
        edges = best_first(materialize(near_signatures(rest, classes), "rest"), sets, edges, comps)
    return classes, components(edges)


def deduplicate(df: DataFrame, doc: str = "doc_id", text: str = "text", bucket: int = 64) -> DataFrame:
    """Per document: its number, ``n_shingles``, ``component_id``, ``kept``, ``row_key`` (see there) and ``component``
    (the same for all that links join, whatever their numbers; null without words).

    Documents are linked if their sets of five-word shingles have 100 * common >= 75 * union; ``component_id`` is the least number
    that links lead to, ``kept`` marks the document of that number. Texts without words have no shingles, are linked with
    nothing and kept. Equal texts are linked through their common class. Documents of the same number are rows of their own;
    a row without a number is kept only if nothing it is linked with has one. Other columns are ignored. An empty table gives
    an empty one.
    """
    docs = materialize(signed(bounded_batches(df, BATCH), doc, text), "signed")
    _, comps = links(df, docs, doc, text, bucket)
    least = with_components(docs.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc").alias("doc")), comps)
    name = least.groupBy("comp").agg(F.min("doc").alias("component_id"))
    named = materialize(least.select("cls", "comp").join(name, "comp").select("cls", "component_id", "comp"), "named")
    full = docs.filter("cls IS NOT NULL").join(named, "cls").select("doc", "n", "component_id", "key", "comp")
    out = full.union(docs.filter("cls IS NULL").select("doc", "n", F.col("doc").alias("component_id"), "key", F.lit(None).cast("long")))
    return out.select(F.col("doc").alias(doc), F.col("n").alias("n_shingles"), "component_id",
                      F.col("doc").eqNullSafe(F.col("component_id")).alias("kept"), F.col("key").alias("row_key"),
                      F.col("comp").alias("component"))
