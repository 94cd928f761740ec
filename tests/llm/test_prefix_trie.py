"""The prefix trie against a trie built node by node."""

import hashlib
import random
import zlib

from logspark.llm import catalog, prefix_trie
from tests import oracle


def trie(rows):
    """rows (conv_id, turn, role, text) -> rows of op11."""
    by: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append(((turn is not None, turn or 0), (role or "").encode(), (text or "").encode(), role or "", text or ""))
    own = {c: [(r[3], r[4]) for r in sorted(v, key=lambda r: r[:3])] for c, v in by.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:]
    members: dict[tuple, list] = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids: dict[tuple, list] = {n: [] for n in members}
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids[n]) if kids[n] else 1
        saved[n] = sum(saved[k] for k in kids[n]) + (len(n[-1][1]) * (len(members[n]) - 1) if n else 0)
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(kids[n]), leaves[n], saved[n],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(n)).encode()).hexdigest())
                  for n, m in members.items())


def got(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, depth string, block string")


def test_random_conversations(spark):
    draw = random.Random(3)
    for width in (2, 8):
        rows = [(c, t if draw.random() < 0.9 else None, draw.choice(["user", "assistant", None]), draw.choice(["a", "bé", "", None, "ccc"]))
                for c in [*range(130), 205, 301, -7, 10_000] for t in range(draw.choice([0, 1, 2, 3, 5, 9, 17]))]
        rows += [r for r in rows if draw.random() < 0.1] + [(None, 1, "user", "lost")]
        assert got(prefix_trie.prefix_trie(frame(spark, rows), width)) == trie(rows)


def test_one_very_long_and_one_very_common_conversation(spark):
    rows = [(7, t, "user", f"t{t % 5}") for t in range(6000)] + [(c, t, "user", f"same {t}") for c in range(1000, 2500) for t in range(3)]
    assert got(prefix_trie.prefix_trie(frame(spark, rows))) == trie(rows)


def test_rows_without_numbers_and_empty_tables(spark):
    assert prefix_trie.prefix_trie(frame(spark, [])).collect() == []
    assert prefix_trie.prefix_trie(frame(spark, [(None, 1, "a", "b")])).collect() == []
    rows = [(5, None, None, None)] * 3 + [(105, None, "r", "long " * 50_000)]
    assert got(prefix_trie.prefix_trie(frame(spark, rows))) == trie(rows)


def test_role_and_text_are_kept_apart(spark):
    rows = [(0, 0, "a", "bc"), (1, 0, "ab", "c"), (2, 0, "a:b", "c"), (3, 0, "", "abc"), (200, 0, "a", "bc")]
    assert got(prefix_trie.prefix_trie(frame(spark, rows))) == trie(rows)


def test_the_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert not oracle.compare(spark, oracle.duck(folder), folder, "op11", catalog.op11_prefix_trie, catalog.OP11_SQL)
