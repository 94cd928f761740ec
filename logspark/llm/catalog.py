"""The operators as named queries over the tables of a folder."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, collocations, decontaminate, language, neardup, pii, prefix_trie, quality, shards, token_counts, token_files, toxicity, transcripts
from .common import read

RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    done = bpe.decode(bpe.encode(docs, path, pattern), path, pattern)
    return done.select("doc_id", bpe.n_ids(F.col("token_bytes")).alias("n_tokens"),
                       F.sha2("token_bytes", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").filter(~toxicity.held_out()))
    judged = toxicity.score(docs, model)
    return judged.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.phrase_matches(docs, read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
  b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
  bs AS (SELECT item_id, w, least(10, len(w)) AS l, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM b WHERE len(w) > 0),
  bw AS (SELECT DISTINCT item_id, l, array_to_string(w[k:k + l - 1], ' ') AS win FROM bs),
  ds AS (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM bw) AS ls WHERE len(w) >= l),
  dw AS (SELECT doc_id, l, s, array_to_string(w[s:s + l - 1], ' ') AS win FROM ds),
  h AS (SELECT doc_id, item_id, s, l FROM dw JOIN bw USING (l, win)),
  p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS pos FROM h) GROUP BY doc_id),
  i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)
""".replace("\\\\", "\\")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page by text, markup, address and host; every document by text and its source in place of a host."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    names, model = language.fit_text(docs)
    pages = language.page_evidence(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    rows = language.union([docs.select("doc_id", "text", F.col("source").alias("host")),
                           pages.select("page_id", "text", "declared", "host", "suffix")])
    found = language.identify(rows, names, model)
    return found.select("doc_id", "page_id", "declared", "host", "suffix", "text_lang", "lang", F.round("probability", 6).alias("probability"),
                        (F.col("probability") >= 0.5).alias("kept"))


def op6_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    raw = transcripts.write_up(turns)
    model = transcripts.fit(raw.filter(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 5 != 0))
    return transcripts.parse(raw, model)


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard(read(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    return placed.select("doc_id", F.col("shard_bytes").alias("size"),
                         F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
                         F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path(TOKENIZER))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                          "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.round_trip(docs, public_tokenizers.path(TOKENIZER), 2)


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(read(spark, sf_dir, "documents")).drop("row_key", "component")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


#: The checksum that says how many turns are shared is computed bit by bit, from its published polynomial.
OP11_SQL = """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, encode(coalesce(role, '')), encode(coalesce(text, ''))) AS p FROM conversations WHERE conv_id IS NOT NULL),
  o AS (SELECT c, max(p) AS own, c - c % 100 AS base, xor(list_reduce(list_concat([4294967295::BIGINT],
    list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda s, x: list_reduce(list_concat([xor(s, x)], range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 6 AS h FROM t GROUP BY c),
  r AS (SELECT o.c, p, role, text FROM o JOIN t ON t.c = o.base AND p <= h
    UNION ALL SELECT o.c, least(o.h, coalesce(b.own, 0)) + p - o.h, role, text FROM o JOIN t ON t.c = o.c AND p > o.h LEFT JOIN o AS b ON b.c = o.base),
  q AS (SELECT o.c, count(p) AS n, coalesce(list({'role': role, 'text': text} ORDER BY p) FILTER (WHERE p IS NOT NULL), []) AS s
    FROM o LEFT JOIN r ON r.c = o.c GROUP BY o.c),
  m AS (SELECT c, n, d, s[1:d] AS s, CASE WHEN d > 0 THEN s[1:d - 1] END AS up FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM q)),
  v AS (SELECT s, d, up, min(c) AS conv_id, count(*) AS n_convs, max(n) = d AS leaf, coalesce(length(s[d].text), 0) * (count(*) - 1) AS saving,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends FROM m GROUP BY s, d, up),
  k AS (SELECT up, d - 1 AS d, count(*) AS n FROM v WHERE d > 0 GROUP BY ALL),
  b AS (SELECT m.s, m.d, sum(v.saving) AS saving, count(*) FILTER (WHERE leaf) AS leaves FROM v JOIN m ON m.c = v.conv_id AND m.d <= v.d GROUP BY m.s, m.d)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n, 0) AS n_children, b.leaves AS n_leaves,
  CAST(b.saving AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
FROM v JOIN b ON b.s = v.s AND b.d = v.d LEFT JOIN k ON k.up = v.s AND k.d = v.d LEFT JOIN v AS u ON u.d = v.d - 1 AND u.s = v.up
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents").select("lang", "text"), top=2000, least=10, longest=3, cover=50)


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
  w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
  s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
  n AS (SELECT lang, count(*) AS n FROM s GROUP BY lang),
  o AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM s, (SELECT unnest([1, 2, 3]) AS size) AS sizes
    WHERE i + size - 1 <= len(w)),
  f AS (SELECT lang, size, phrase, count(*) AS f FROM o GROUP BY ALL HAVING count(*) >= 10),
  c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM f WHERE size > 1),
  t AS (SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, CAST(1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM c
    JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ')
    JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
  b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
  g AS (SELECT lang, part, max(f) AS f FROM (SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '),
    array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS part FROM f WHERE size = 3) GROUP BY ALL),
  k AS (SELECT b.* FROM b LEFT JOIN g ON g.lang = b.lang AND g.part = b.phrase WHERE g.f IS NULL OR 100 * g.f < 50 * b.a),
  r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM k)
SELECT r.lang, rank, phrase, a, l, r.r, n, score FROM r JOIN n USING (lang) WHERE rank <= 2000
""".replace("\\\\", "\\")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    plain = pii.plain_only(F.col("spans"))
    counts = [pii.count_of(plain, kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(plain), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_toxicity, op3_decontaminate, op4_language, op5_shards,
                                  op6_transcripts, op7_token_counts, op8_token_files, op9_neardup, op10_quality,
                                  op11_prefix_trie, op12_collocations, op13_pii)}
ORACLES: dict[str, str] = {"op3_decontaminate": OP3_SQL, "op11_prefix_trie": OP11_SQL, "op12_collocations": OP12_SQL}
