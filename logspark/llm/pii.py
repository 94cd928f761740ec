"""Personal data, plain or disguised, with spans in characters of the source text.

Three transducers rewrite a text: homoglyphs to ASCII, spelled digits to digits, "at" and "dot" disguises to their signs.
Each keeps its edits, so that a span found in the rewritten text is carried back, edit by edit, to the source. One map
pass over the texts, no shuffle; time is linear in a text's length.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from .common import bounded_batches, text_of

#: The kinds, in the order in which spans of equal start are listed.
KINDS = ("email", "ip", "card", "phone")

# The kinds' patterns, so written that no run of characters is read more than a few times: a run of digits is taken whole
# and never given back, whether an address follows or not; a mail address is searched from its @ on.
_AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_BACKWARDS = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """The check sum of card numbers: from the right, every second digit doubled, cross sums added."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for m in _AT_DOMAIN.finditer(text):
        at = m.start()
        floor = max(end, text.rfind("@", end, at) + 1)
        local = _LOCAL_BACKWARDS.match(text[floor:at][::-1])
        if local:
            end = m.end()
            yield at - local.end(), end


def detect(text: str) -> list[tuple[int, str, int]]:
    """All plain identifiers: (start, kind, end), for each kind leftmost and without overlap."""
    found = [(s, "email", e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if m.group(1) and all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            found.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), "phone", m.end()))
    return found


class Rewritten:
    """A text after edits (start, end, replacement), which must not overlap, with the way back to the source."""

    def __init__(self, source: str, edits: Iterable[tuple[int, int, str]]):
        self.at, self.to, self.new, self.new_end, parts, last, length = [], [], [], [], [], 0, 0
        for start, end, new in edits:
            parts += [source[last:start], new]
            length += start - last
            self.at.append(start)
            self.to.append(end)
            self.new.append(length)
            length += len(new)
            self.new_end.append(length)
            last = end
        self.text = "".join([*parts, source[last:]]) if parts else source

    def touched(self, start: int, end: int) -> bool:
        """Whether an edit lies in this span of the rewritten text; an end where something was removed counts not."""
        k = bisect_right(self.new_end, start)
        return k < len(self.new) and self.new[k] < end

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The source span of a span of the rewritten text; an edit that is cut by the span belongs to it whole."""
        k = bisect_right(self.new, start) - 1
        if k < 0:
            first = start
        elif start < self.new_end[k]:
            first = self.at[k]
        else:
            first = self.to[k] + start - self.new_end[k]
        k = bisect_left(self.new, end) - 1
        if k < 0:
            last = end
        elif end <= self.new_end[k]:
            last = self.to[k]
        else:
            last = self.to[k] + end - self.new_end[k]
        return first, last


# Cyrillic and Greek letters, and a few Latin ones, beside the ASCII letters they look like; signs that stand
# for a dot, an @ or a plus; characters without width.
_LOOKALIKES = dict(zip("аеорсухіѕјԁһԛԝѵɡɑıοαινκρτυχАВЕКМНОРСТУХІЅЈΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
                       "aeopcyxisjdhqwvgaioaivkptuxABEKMHOPCTYXISJABEZHIKMNOPTYX", strict=True))
_SIGNS = {"\ufe6b": "@", "\u3002": ".", "\uff61": ".", "\u2024": ".", "\ufe52": ".", "\u2212": "-", "\ufe62": "+"}
_NO_WIDTH = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"


def _ascii_twins() -> dict[str, str]:
    """Characters that stand for one ASCII letter, digit or sign.

    Digits of all scripts, blanks, dashes and the compatibility forms (full width, mathematical, circled) follow from the
    character database; look-alikes of other scripts are listed above.
    """
    blocks = (range(0x2460, 0x24EA), range(0xFF01, 0xFF5F), range(0x1D400, 0x1D800), range(0x1F130, 0x1F190))
    twins = {}
    for c in (chr(i) for block in blocks for i in block):
        plain = unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and plain.isascii():
            twins[c] = plain
    for c in map(chr, range(0x80, 0x1FBFA)):
        if (digit := unicodedata.digit(c, None)) is not None:
            twins.setdefault(c, str(digit))
        elif (kind := unicodedata.category(c)) in ("Zs", "Pd"):
            twins.setdefault(c, " " if kind == "Zs" else "-")
    return twins | _LOOKALIKES | _SIGNS | dict.fromkeys(_NO_WIDTH, "")


_TWINS = _ascii_twins()

# The digits' names, zero to nine, in English, German, French and Spanish.
_NAMES = ("zero|oh|null|zéro|cero", "one|eins|un|uno", "two|zwei|deux|dos", "three|drei|trois|tres", "four|vier|quatre|cuatro",
          "five|fünf|cinq|cinco", "six|sechs|seis", "seven|sieben|sept|siete", "eight|acht|huit|ocho", "nine|neun|neuf|nueve")
_DIGIT_OF = {name: str(digit) for digit, names in enumerate(_NAMES) for name in names.split("|")}
#: What may stand between two digits' names of one number, and what of that is dropped.
_BETWEEN = re.compile(r"[ ,()+0-9-]{1,24}|[ ]?(?:\.|[\[({<]?(?:dot|point|punkt|punto)[\])}>]?)[ ]?", re.IGNORECASE)
_GAP = re.compile(r"[ ]|[ ]?[,-][ ]?")
#: Names of digits count as a number from this length on.
LEAST_NAMES = 3

_OPEN, _CLOSE = r"[ ]?[\[({<][ ]?", r"[ ]?[\])}>][ ]?"
_AT_NAMES, _DOT_NAMES = "at|arroba|arobase|klammeraffe", "dot|punkt|point|punto"
_LABEL = r"[A-Za-z0-9-]{1,63}"
_SIGN_NAME = re.compile(
    rf"(?P<at>{_OPEN}(?:{_AT_NAMES}|@){_CLOSE}|&#0*64;|&commat;|%40|[ ]@[ ]?|(?<=[A-Za-z0-9])@[ ])"
    rf"|(?P<dot>{_OPEN}(?:{_DOT_NAMES}|\.){_CLOSE}|&#0*46;|&period;|%2E|(?<=[A-Za-z0-9])[ _-](?:{_DOT_NAMES})[ _-](?=[A-Za-z0-9]))"
    rf"|(?P<bare>(?<=[A-Za-z0-9_])[ _-](?:{_AT_NAMES})[ _-](?={_LABEL}(?:\.{_LABEL}){{0,8}}"
    rf"(?:[ _-](?:{_DOT_NAMES})[ _-]|{_OPEN}(?:{_DOT_NAMES}|\.){_CLOSE})[A-Za-z]))"
    rf"|(?P<likely>(?<=[A-Za-z0-9_])[ ](?:{_AT_NAMES})[ ](?={_LABEL}(?:\.{_LABEL}){{0,8}}\.[A-Za-z]{{2,}}(?![A-Za-z0-9@-])))"
    r"|(?P<plus>(?<![A-Za-z0-9])plus[ ](?=\(?[0-9]))", re.IGNORECASE)
_SIGN = {"at": "@", "dot": ".", "bare": "@", "likely": "@", "plus": "+"}
#: What must stand before a bare "at" and a plain domain: a name with a digit or a sign in it, as no word of prose has.
_NAME_BEFORE = re.compile(r"(?<![A-Za-z0-9._%+-])(?=[A-Za-z])(?=[A-Za-z]*[0-9._+])[A-Za-z0-9._%+-]{2,64}\Z")
#: Letters that stand for digits between digits.
_DIGIT_LETTER = re.compile(r"[OoIl]{1,4}(?=[ .-]?[0-9])")
_LETTER_DIGITS = str.maketrans("OoIl", "0011")
_TOP_LABEL = re.compile(r"\.[A-Za-z]{2,}\Z")
#: What a sign's disguise holds somewhere in its first four characters.
_SIGN_CLUES = [*_AT_NAMES.split("|"), *_DOT_NAMES.split("|"), "@", "plus ", "&#", "&commat;", "&period;", "%40", "%2e",
               *(o + "." for o in "[({<"), *(o + " ." for o in "[({<")]
_UPPER = dict(zip(range(65, 91), range(97, 123)))


def _finder():
    """Finds all digits' names and clues of signs in one pass: (last position, (is a name, length))."""
    import ahocorasick

    words = ahocorasick.Automaton()
    for name in _DIGIT_OF:
        words.add_word(name, (True, len(name)))
    for clue in _SIGN_CLUES:
        words.add_word(clue, (False, len(clue)))
    words.make_automaton()
    return words


def _lower(text: str) -> str:
    """Lower case of equal length."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_UPPER)


def _twin_edits(text: str) -> Iterator[tuple[int, int, str]]:
    there = "" if text.isascii() else "".join(_TWINS.keys() & set(text))
    if there:
        for m in re.finditer(f"[{re.escape(there)}]", text):
            yield m.start(), m.end(), _TWINS[m.group()]


def _letter_edits(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _DIGIT_LETTER.finditer(text):
        if m.start() and text[m.start() - 1] in "0123456789":
            yield m.start(), m.end(), m.group().translate(_LETTER_DIGITS)


def _digit_edits(text: str, low: str, names: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """Runs of digits' names become digits; spaces, commas and hyphens between two names go."""
    run: list[tuple[int, int]] = []

    def edits() -> Iterator[tuple[int, int, str]]:
        if len(run) >= LEAST_NAMES:
            for (start, end), following in zip(run, [*run[1:], None]):
                close = following and _GAP.fullmatch(text, end, following[0])
                yield start, following[0] if close else end, _DIGIT_OF[low[start:end]]

    for start, end in names:
        if run and not _BETWEEN.fullmatch(text, run[-1][1], start):
            yield from edits()
            run.clear()
        run.append((start, end))
    yield from edits()


def _sign_edits(text: str, clues: list[int]) -> Iterator[tuple[int, int, str]]:
    last = 0
    for clue in clues:
        for start in range(max(clue - 3, last), clue + 1):
            m = _SIGN_NAME.match(text, start)
            if m and (m.lastgroup != "likely" or _NAME_BEFORE.search(text[max(0, start - 65):start])):
                yield m.start(), m.end(), _SIGN[m.lastgroup]
                last = m.end()
                break


def _clues(low: str, finder) -> tuple[list[tuple[int, int]], list[int]]:
    """Digits' names that are whole words, longest first, and the places of what may disguise a sign."""
    names, clues = [], []
    for last, (is_name, length) in finder.iter(low):
        start = last - length + 1
        before = low[start - 1] if start else " "
        if is_name:
            if not before.isalnum() and not low[last + 1:last + 2].isalnum():
                names.append((start, last + 1))
        elif before in " _-[({<" or not low[start].isalpha():
            clues.append(start)
    return names, sorted(clues)


def spans(text: str, finder=None) -> list[tuple[str, int, int, bool]]:
    """All identifiers of a text: (kind, start, end, disguised), by start, kind and end, in characters of the text.

    Plain ones are found in the text as it is. Of those in the rewritten text only such count as touch an edit; an
    address must then end in a label of letters, so that prices after an @ are none.
    """
    plain, finder = detect(text), finder or _finder()
    passes = [Rewritten(text, _twin_edits(text))]
    passes.append(Rewritten(passes[0].text, _letter_edits(passes[0].text)))
    low = _lower(passes[1].text)
    names, clues = _clues(low, finder)
    if len(names) >= LEAST_NAMES:
        passes.append(Rewritten(passes[-1].text, _digit_edits(passes[-1].text, low, names)))
        if passes[-1].at:
            clues = _clues(_lower(passes[-1].text), finder)[1]
    if clues:
        passes.append(Rewritten(passes[-1].text, _sign_edits(passes[-1].text, clues)))
    current = passes[-1].text
    passes = [done for done in passes if done.at]
    extra = set()
    if passes:
        for start, kind, end in detect(current):
            if kind == "email" and not _TOP_LABEL.search(current, max(start, end - 64), end):
                continue
            s, e, changed = start, end, False
            for done in reversed(passes):
                changed |= done.touched(s, e)
                s, e = done.back(s, e)
            if changed:
                while kind != "email" and text[e - 1] in " ,-":  # a gap that went with the last digit's name
                    e -= 1
                extra.add((s, kind, e))
        extra -= set(plain)
    order = {kind: i for i, kind in enumerate(KINDS)}
    rows = [(s, order[k], e, False) for s, k, e in plain] + [(s, order[k], e, True) for s, k, e in extra]
    return [(KINDS[k], s, e, d) for s, k, e, d in sorted(rows)]


def find(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Adds the identifiers of a text column as array<struct<kind, start, end, disguised>>; offsets are in characters.

    Rows are independent: no shuffle, one Arrow batch at a time, whole texts. A null or empty text has no spans;
    repeated rows give repeated results, an empty table an empty one; a column already named ``out`` is replaced.
    """
    kind = "array<struct<kind:string,start:bigint,end:bigint,disguised:boolean>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_())]))
    names = ("kind", "start", "end", "disguised")

    @arrow_udf(kind)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = _finder()
        for texts in batches:
            yield pa.array([[dict(zip(names, s)) for s in spans(t.as_py() or "", finder)] for t in texts], arrow)

    return bounded_batches(df).withColumn(out, search(text_of(text)))


def listed(found: Column) -> Column:
    """Spans as text, kind:start:end joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def plain_only(found: Column) -> Column:
    return F.filter(found, lambda s: ~s["disguised"])


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def masked(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; a span that begins inside an earlier one is cut there."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("done"))

    def step(state: Column, s: Column) -> Column:
        begin = F.greatest(s["start"].cast("int") + 1, state["at"])
        keep = F.concat(state["done"], F.substring(text, state["at"], begin - state["at"]))
        ends = s["end"].cast("int") + 1
        return (F.when(ends <= state["at"], state)
                .otherwise(F.struct(ends.alias("at"), F.concat(keep, F.lit("<"), s["kind"], F.lit(">")).alias("done"))))

    return F.aggregate(found, start, step, lambda state: F.concat(
        state["done"], F.substring(text, state["at"], F.greatest(F.length(text) - state["at"] + 1, F.lit(0)))))
