"""Encoding, token counts and token files against the libraries."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from logspark.llm import bpe, pieces, token_counts, token_files
from logspark.session import new_dir
from tests.llm import odd

RANKS, TOKENIZER = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
MIX = [chr(c) for c in range(0x250)] + list("   \n\n\t''sstre") * 40 + list("²½中　 ’—") * 3 + ["<|endoftext|>"]


def strings(n: int, seed: int, longest: int = 40) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice(MIX) for _ in range(draw.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def test_blocks_do_not_change_ids():
    encoding = bpe.load(RANKS, P.PATTERN)
    for text in strings(300, 1, 400) + [odd.LONG, odd.UNBROKEN]:
        assert bpe.encode_text(encoding, text, 20) == encoding.encode_ordinary(text)
        assert "".join(bpe.blocks(text, 20)) == text


def test_very_long_runs_of_white_space():
    encoding = bpe.load(RANKS, P.PATTERN)
    for text in ["a" + " " * 60_000 + "b", " " * 60_000, "\t" * 60_000 + "b", "a " + " \n" * 40_000 + "\n b c", "\x1c" * 60_000 + " " * 60_000 + "\x1dz",
                 "x\u00a0" + " " * 60_000 + "\x85y" + " " * 60_000, "x" * 200_000 + "\n" * 70_000]:
        assert bpe.encode_text(encoding, text) == encoding.encode_ordinary(text)
    for n in (1_000_000, 2_000_000, 3_000_000):
        for text in (" " * n + "a", "\n" * n, "\t" * n + "b", "a b" + " " * n + "\nc"):
            assert encoding.decode_bytes(bpe.encode_text(encoding, text)) == text.encode()


def test_bpe_round_trip_of_odd_texts(spark):
    encoding = bpe.load(RANKS, P.PATTERN)
    done = bpe.decode(bpe.encode(odd.frame(spark), RANKS, P.PATTERN, ids="n_tokens", block=1000), RANKS, P.PATTERN, ids="n_tokens")
    got = done.select("text", "decoded", bpe.ids_array(F.col("n_tokens")).alias("ids")).collect()
    assert len(got) == len(odd.rows())
    for r in got:
        assert r.ids == encoding.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(odd.empty(spark), RANKS, P.PATTERN).count() == 0


def test_raw_bytes_need_not_be_text(spark):
    one = np.array([bpe.load(RANKS, P.PATTERN).encode_ordinary("é")[0]], "<u4").tobytes()
    first = bpe.load(RANKS, P.PATTERN).encode_single_token(b"\xc3")
    df = spark.createDataFrame([(bytearray(np.array([first], "<u4").tobytes()),), (None,), (bytearray(one),)], "token_bytes binary")
    got = [bytes(r.decoded) for r in bpe.decode(df, RANKS, P.PATTERN).collect()]
    assert got[0] == b"\xc3" and got[1] == b""


def test_pieces_are_the_library(library):
    texts = strings(4000, 2) + odd.TEXTS[1:]
    e, c = pieces.Encoder(TOKENIZER, 4, room=500), pieces.Counter(TOKENIZER, {" the": 1})
    for t, packed, n in zip(texts, e.encode(texts), c.encode(texts)):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == want and n == len(want)
    assert len(e) < 500 + 20_000


def test_token_counts_of_odd_texts(spark, library):
    got = token_counts.count_tokens(odd.frame(spark), TOKENIZER).select("text", "n_tokens", "score").collect()
    assert len(got) == len(odd.rows())
    assert all(r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids) for r in got)
    assert token_counts.count_tokens(odd.empty(spark), TOKENIZER).count() == 0


def test_token_files_of_odd_texts(spark, library):
    folder = new_dir(spark, "files")
    token_files.write(odd.frame(spark), folder, TOKENIZER, 2)
    got = token_files.documents(spark, folder).orderBy("start").collect()
    order = sorted(odd.rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, row in zip(got, order, strict=True):
        ids = library.encode(row[1] or "", add_special_tokens=False).ids + [2]
        assert (r.doc, r.start, r.n_tokens) == (row[0], at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert token_files.round_trip(odd.empty(spark), TOKENIZER, 2).count() == 0
