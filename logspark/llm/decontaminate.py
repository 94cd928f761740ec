"""Benchmark decontamination with a distributed positional inverted index.

DataFrame functions only. The index stores, for every word that occurs in a benchmark, where it stands in the
training documents. A test window is looked up from its rarest words: their lists, shifted by the words' places in the
window, are intersected; the rest is compared with the whole window, by its hash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import ascii_lower, text_of

#: Fixed value: everything that separates words once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A side of at most so many narrow rows is broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def small(df: DataFrame, rows: int = BROADCAST_ROWS, count: int | None = None) -> DataFrame:
    """Marks a written table for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if (df.count() if count is None else count) <= rows else df


def doc_key(doc: str, text: str) -> Column:
    """A number for a row: of its document number or, where that is null, of its text, so nulls are spread."""
    return F.when(F.col(doc).isNotNull(), F.xxhash64(doc)).otherwise(F.xxhash64(F.lit("null"), text))


@dataclass
class Index:
    """Written tables. ``terms``: term, term_id. ``postings``: term_id, doc, pos. ``frequency``: term_id, n."""

    terms: DataFrame
    postings: DataFrame
    frequency: DataFrame


def benchmark_items(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Items with words: number, words and a key; equal rows once."""
    rows = benchmark.select(F.col(item).alias("item_id"), text_of(text).alias("t")).distinct()
    return materialize(rows.select(F.xxhash64("item_id", "t").alias("item"), "item_id", words(F.col("t")).alias("item_words"))
                       .filter(F.size("item_words") > 0), "items")


def build_index(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text") -> Index:
    """Stores the places of the items' words in the documents: one scan, no exchange of words."""
    terms = materialize(items.select(F.explode("item_words").alias("term")).distinct()
                        .withColumn("term_id", F.xxhash64("term")), "terms")
    places = docs.select(doc_key(doc, text).alias("doc"), F.posexplode(words(text_of(text))).alias("pos", "term"))
    postings = materialize(places.join(small(terms), "term").select("term_id", "doc", "pos"), "postings")
    return Index(terms, postings, materialize(postings.groupBy("term_id").agg(F.count("*").alias("n")), "frequency"))


def windows(items: DataFrame, index: Index, length: int = 10, lists: int = 2) -> DataFrame:
    """The different windows that may occur: win (hash of the words), len, items, terms.

    ``items`` are the numbers, as strings, of those that have the window; ``terms`` the window's ``lists`` rarest words as
    (n, o, term_id), rarest first, o their place in it. A window with a word that no document has is left out.
    """
    sized = items.withColumn("len", F.least(F.lit(length), F.size("item_words")))
    at = sized.select(F.col("item_id").cast("string").alias("item"), "len", "item_words", F.explode(
        F.sequence(F.lit(0), F.size("item_words") - F.col("len"))).alias("k"))
    every = at.select("item", "len", F.expr("slice(item_words, k + 1, len)").alias("w")).withColumn("win", F.xxhash64("w"))
    every = every.groupBy("win").agg(F.first("len").alias("len"), F.first("w").alias("w"), F.collect_set("item").alias("items"))
    cells = every.select("win", "len", "items", F.posexplode("w").alias("o", "term"))
    rare = (cells.withColumn("term_id", F.xxhash64("term")).join(index.frequency, "term_id", "left")
            .groupBy("win").agg(F.first("len").alias("len"), F.first("items").alias("items"), F.min(F.coalesce("n", F.lit(0))).alias("least"),
                                F.array_sort(F.collect_list(F.struct("n", "o", "term_id"))).alias("all")))
    return materialize(rare.filter("least > 0").select("win", "len", "items", F.slice("all", 1, lists).alias("terms")), "windows")


def candidates(index: Index, wins: DataFrame) -> DataFrame:
    """Places (doc, start, win, len) where the two rarest words of a window both stand as far apart as in the window."""
    first, second = F.col("terms")[0], F.get("terms", F.lit(1))
    n = wins.count()
    asked = index.postings.join(small(wins.select("win", "len", first["term_id"].alias("term_id"), first["o"].alias("o1"), second["o"].alias("o2"),
                                                  second["term_id"].alias("term2")), count=n), "term_id").select(
        "doc", (F.col("pos") - F.col("o1")).alias("start"), "win", "len", F.col("term2").alias("term_id"),
        (F.col("pos") - F.col("o1") + F.col("o2")).alias("pos")).filter("start >= 0")
    rare = index.postings.join(small(wins.select(second["term_id"].alias("term_id")).distinct(), count=n), "term_id", "left_semi")
    both = asked.filter("term_id IS NOT NULL").join(rare, ["term_id", "doc", "pos"], "left_semi")
    found = ["doc", "start", "win", "len"]
    return both.select(found).union(asked.filter("term_id IS NULL").select(found)).distinct()


def phrase_matches(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id",
                   item_text: str = "text", length: int = 10) -> DataFrame:
    """Adds to each document ``n_words``, ``n_hit``, ``items`` (sorted item numbers as strings) and ``hits``.

    Words are runs of digits, letters a-z (A-Z are lower-cased) and characters beyond ASCII. A window is ``length``
    consecutive words of an item, or the whole item if it has fewer but at least one; ``hits`` has a (start, len, items)
    for each place where a window stands in the document, whole and in order, as the hash of all its words shows; ``n_hit``
    counts the document's words inside any. Null texts have no words; null item numbers hit but are not listed; equal
    benchmark rows count once and equal documents each. An empty benchmark leaves all documents clean. Other columns are
    kept, same-named ones replaced.
    """
    items = benchmark_items(benchmark, item, item_text)
    index = build_index(docs, items, doc, text)
    wins = windows(items, index, length)
    found = candidates(index, wins)
    listed = materialize(found.join(small(wins.select("win", "items")), "win").groupBy("doc").agg(
        F.collect_list(F.struct("start", "len", "items", "win")).alias("_found")).withColumnRenamed("doc", "_doc"), "found")
    n = listed.agg(F.sum(F.size("_found"))).first()[0] or 0
    rows = docs.drop("n_words", "n_hit", "items", "hits").withColumn("_doc", doc_key(doc, text))
    joined = rows.join(small(listed, 200_000, n), "_doc", "left").withColumn("_words", words(text_of(text)))
    hits = F.expr("filter(coalesce(_found, array()), c -> c.start + c.len <= size(_words) AND xxhash64(slice(_words, c.start + 1, c.len)) = c.win)")
    return (joined.withColumn("hits", hits)
            .withColumn("n_words", F.size("_words").cast("long"))
            .withColumn("n_hit", F.size(F.array_distinct(F.flatten(F.expr(
                "transform(hits, h -> sequence(h.start, h.start + h.len - 1))")))).cast("long"))
            .withColumn("items", F.array_sort(F.array_distinct(F.flatten(F.expr("transform(hits, h -> h.items)")))))
            .withColumn("hits", F.expr("transform(hits, h -> struct(h.start, h.len, h.items))"))
            .drop("_doc", "_words", "_found"))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int = 3, doc: str = "doc_id", text: str = "text",
                      item: str = "item_id", item_text: str = "text", length: int = 10) -> DataFrame:
    """Places where a window's two rarest words stand in a document at most ``slop`` words from their distance in the window.

    Returns items (that have the window), win, doc (see ``doc_key``), start (where the window would begin by its rarest word) and
    off (how far the second word is from its place). Finds what was changed by a few words inserted, left out or swapped
    between them. One-word windows have no second word and are not asked.
    """
    items = benchmark_items(benchmark, item, item_text)
    index = build_index(docs, items, doc, text)
    wins = windows(items, index, length).filter(F.size("terms") > 1).select(
        "win", "items", F.col("terms")[0].alias("a"), F.col("terms")[1].alias("b"))
    wide = 2 * slop + 1
    asked = index.postings.join(small(wins), F.col("term_id") == F.col("a.term_id")).select(
        "win", "items", "doc", (F.col("pos") - F.col("a.o")).alias("start"), F.col("b.term_id").alias("term_id"),
        (F.col("pos") - F.col("a.o") + F.col("b.o")).alias("want"))
    asked = asked.withColumn("cell", F.explode(F.array_distinct(F.array(
        F.floor((F.col("want") - slop) / wide), F.floor((F.col("want") + slop) / wide)))))
    rare = index.postings.join(small(wins.select(F.col("b.term_id").alias("term_id")).distinct()), "term_id", "left_semi")
    near = asked.join(rare.withColumn("cell", F.floor(F.col("pos") / wide)), ["term_id", "doc", "cell"]).filter(
        F.abs(F.col("pos") - F.col("want")) <= slop)
    return near.select("items", "win", "doc", "start", (F.col("pos") - F.col("want")).alias("off")).distinct()
