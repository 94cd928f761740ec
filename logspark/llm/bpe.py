"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from .common import bounded_batches, text_of

#: A white space after anything that is none: every match of the split pattern ends before it and none looks behind
#: it, so a text may be cut there. Both classes are taken so wide that all regex libraries agree on them.
SAFE_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \n])")
#: Characters of a text that are given to the library at once.
BLOCK = 100_000
#: A run of white space (by the Unicode property) longer than the library's backtracking may hold. The split pattern makes
#: it one piece, less its last character if anything follows.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{50000,}")


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """Cuts a long text at safe boundaries into blocks of about ``size`` characters.

    A stretch without any safe boundary stays whole, so the blocks' ids joined are always the text's ids.
    """
    start = 0
    while len(text) - start > size:
        cut = SAFE_CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def load(path: str, pattern: str):
    """The library's encoding of a rank file; no special tokens."""
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(encoding, text: str, size: int = BLOCK) -> list[int]:
    if len(text) <= size:
        return encoding.encode_ordinary(text)
    ids, at = [], 0
    for run in LONG_SPACE.finditer(text):
        stop = run.end() - (run.end() < len(text))
        for block in blocks(text[at:run.start()], size):
            ids += encoding.encode_ordinary(block)
        ids += encoding._encode_single_piece(text[run.start():stop])
        at = stop
    for block in blocks(text[at:], size):
        ids += encoding.encode_ordinary(block)
    return ids


def _encoder(path: str, pattern: str, size: int):
    @arrow_udf("binary")
    def encode_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        encoding = load(path, pattern)
        for texts in batches:
            yield pa.array([np.asarray(encode_text(encoding, t or "", size), "<u4").tobytes()
                            for t in texts.to_pylist()], pa.binary())

    return encode_ids


def _decoder(path: str, pattern: str):
    @arrow_udf("binary")
    def decode_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        encoding = load(path, pattern)
        for ids in batches:
            yield pa.array([encoding.decode_bytes(np.frombuffer(x or b"", "<u4").tolist())
                            for x in ids.to_pylist()], pa.binary())

    return decode_ids


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_bytes",
           block: int = BLOCK) -> DataFrame:
    """Adds the ids of a text column as little-endian unsigned 32-bit integers.

    Rows are independent: no shuffle, one Arrow batch in memory at a time. A null text counts as empty and gives
    no ids; a very long text goes to the library in blocks cut at safe boundaries, a very long run of white space as the one
    piece that it is. Special tokens do not exist, so
    their strings are ordinary text. Repeated rows give repeated results, an empty table an empty one; a column
    already named ``ids`` is replaced, all others are kept.
    """
    return bounded_batches(df).withColumn(ids, _encoder(path, pattern, block)(text_of(text)))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "token_bytes", out: str = "decoded") -> DataFrame:
    """Adds the raw bytes that the ids stand for; null ids give no bytes. The bytes need not be valid UTF-8."""
    return bounded_batches(df).withColumn(out, _decoder(path, pattern)(F.col(ids)))


def n_ids(ids: Column) -> Column:
    return F.floor(F.octet_length(ids) / 4).cast("long")


def ids_array(ids: Column) -> Column:
    """The packed ids as an array of integers."""
    @arrow_udf("array<int>")
    def unpack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        for packed in batches:
            rows = [np.frombuffer(x or b"", "<u4").astype("i4") for x in packed.to_pylist()]
            ends = np.cumsum([0, *map(len, rows)])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                           pa.array(np.concatenate([*rows, np.empty(0, "i4")])))

    return unpack(ids)
