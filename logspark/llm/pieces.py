"""Encoding by pre-tokens: each distinct pre-token is encoded by the library once and then looked up."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

#: The split of byte-level BPE for texts of settled characters, in terms of Python's own classes.
SPLIT = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
#: The same for texts of ASCII characters alone, where it is faster.
SPLIT_ASCII = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+""", re.ASCII)
#: Any character but those whose class (letter, number, space or none) is the same in all Unicode versions and libraries:
#: Latin, Greek, Cyrillic, punctuation, signs, kana, Han, Hangul, emoji. A text with one is encoded by the library whole.
UNSETTLED = re.compile("[^\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-ɏΑ-ΡΣ-ϿЀ-ҁҊ-ԯ"
                       "‐-‧‰-⁞₠-₿←-⇿ぁ-ゖァ-ヺ"
                       "一-龥가-힣\U0001f300-\U0001f64f]")
#: Texts are worked on in groups of about so many characters.
GROUP = 1 << 20


def _shown_bytes() -> dict[int, str]:
    """The character by which byte-level tokenizers write each byte: itself if it can be seen, else the next one from 256."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder(dict):
    """Maps a pre-token to its packed ids. Those not known yet are encoded and kept, in two generations of ``room`` entries.

    Texts with a special token's string or an unsettled character, and all texts of a tokenizer that is not plain byte-level
    BPE, are encoded by the library whole, so results are always the library's.
    """

    def __init__(self, path: str, width: int = 4, room: int = 700_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.room, self.code = room, {2: "H", 4: "I"}[width]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.plain = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                      and not pre.get("add_prefix_space", True))
        special = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(special) if special else r"(?!)")
        self.shown, self.merge, self.older = _shown_bytes(), self.tokenizer.model.tokenize, {}

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def pack(self, ids: list[int]):
        return array(self.code, ids).tobytes()

    def total(self, packed) -> bytes:
        return b"".join(packed)

    def forget(self) -> None:
        """What was not asked for since the last time goes."""
        self.older = dict(self)
        self.clear()

    def __missing__(self, piece: str):
        got = self[piece] = self.pack(self.whole(piece))
        return got

    def learn(self, pieces: set[str]) -> None:
        """Encodes unknown pre-tokens: the library's model merges the characters that stand for a pre-token's bytes."""
        older, merge, shown = self.older, self.merge, self.shown
        for piece in pieces:
            known = older.get(piece)
            self[piece] = known if known is not None else self.pack(
                [token.id for token in merge(piece.encode().decode("latin-1").translate(shown))])

    def by_pieces(self, text: str) -> bool:
        return self.plain and not self.special.search(text) and not UNSETTLED.search(text)

    def encode(self, texts: list[str]) -> Iterator:
        """Packed ids of each whole text (native byte order)."""
        group, size = [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size >= GROUP:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator:
        split = [(SPLIT_ASCII if t.isascii() else SPLIT).findall(t) if self.by_pieces(t) else None for t in texts]
        wanted = set().union(*[p for p in split if p is not None])
        if len(self) > self.room:
            self.forget()
        self.learn(wanted.difference(self))
        for t, p in zip(texts, split):
            yield self.pack(self.whole(t)) if p is None else self.total(map(self.__getitem__, p))


class Counter(Encoder):
    """Maps a pre-token to its number of tokens; begins with a table of frequent ones, and never gives that up."""

    def __init__(self, path: str, frequent: dict[str, int], room: int = 700_000):
        super().__init__(path, room=room + len(frequent))
        self.frequent = frequent
        self.update(frequent)

    def pack(self, ids: list[int]) -> int:
        return len(ids)

    def total(self, packed) -> int:
        return sum(packed)

    def forget(self) -> None:
        super().forget()
        self.update(self.frequent)


_KEPT: dict = {}


def encoder(path: str, width: int) -> Encoder:
    """The worker process's encoder, kept between its tasks."""
    if (path, width) not in _KEPT:
        _KEPT[path, width] = Encoder(path, width)
    return _KEPT[path, width]


def counter(path: str, tag: str, frequent) -> Counter:
    """The worker process's counter for one broadcast table; the former table's counter is given up."""
    if _KEPT.get("tag") != (path, tag):
        _KEPT["tag"], _KEPT["counter"] = (path, tag), Counter(path, frequent())
    return _KEPT["counter"]
