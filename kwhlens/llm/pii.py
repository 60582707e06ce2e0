"""Personal data with offset-preserving deobfuscation.

A base pass finds e-mail addresses, IP addresses, card and phone numbers by
their plain forms.  Where a text holds signs of disguise, transducers rewrite it
- homoglyphs and invisible characters, at/dot disguises, spelled digits - and
carry for each written character the span of source characters it stands for.
The same detectors run on the result, and their spans are mapped back.  Added
spans never replace base ones.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Starts at a run of digits only and keeps each run whole: the same matches, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each @ outwards."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _count(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain forms, leftmost and non-overlapping per kind; failing matches are dropped."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _count(m[0])
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_count(m[0])) <= 15]
    return sorted(out, key=_order)


def _order(span: tuple[str, int, int]) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


# ------------------------------------------------------------------ transducers
class Tape:
    """A text and, for each of its characters, the source characters [low, high) that it stands for."""

    def __init__(self, text: str, low: list[int], high: list[int]):
        self.text, self.low, self.high = text, low, high

    @classmethod
    def of(cls, text: str) -> Tape:
        return cls(text, list(range(len(text))), list(range(1, len(text) + 1)))

    def rewrite(self, pattern: re.Pattern, make) -> Tape:
        """Each match replaced by ``make(match)``: pieces that are (start, end) of kept text or new strings.

        A new string stands for the source from the end of the piece before it to
        the start of the piece behind it, within the match.
        """
        text, low, high, done = [], [], [], 0
        for m in pattern.finditer(self.text):
            pieces = make(m)
            if pieces is None:
                continue
            self._keep(text, low, high, done, m.start())
            for i, p in enumerate(pieces):
                if isinstance(p, tuple):
                    self._keep(text, low, high, *p)
                    continue
                a = pieces[i - 1][1] if i and isinstance(pieces[i - 1], tuple) else m.start()
                b = pieces[i + 1][0] if i + 1 < len(pieces) and isinstance(pieces[i + 1], tuple) else m.end()
                if b > a:
                    text.append(p)
                    low += [self.low[a]] * len(p)
                    high += [self.high[b - 1]] * len(p)
            done = m.end()
        if not done:
            return self
        self._keep(text, low, high, done, len(self.text))
        return Tape("".join(text), low, high)

    def _keep(self, text: list, low: list, high: list, a: int, b: int) -> None:
        text.append(self.text[a:b])
        low += self.low[a:b]
        high += self.high[a:b]


# Letters of other scripts that look like the Latin letter they stand for.
_LOOK = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅαοινρτυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
                 "aeopcyxijshdqwABEKMHOPCTYXIJSaoivptukABEZHIKMNOPTYX"))
# Invisible characters.
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Dashes and full stops of other scripts.
_MARKS = {"\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2014": "-", "\u2212": "-",
          "\u3002": ".", "\uff61": ".", "\u2024": "."}
# Digits in words, in English, German, French and Spanish.
_DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
_SPOKEN = {"plus": "+", "dot": ".", "punkt": ".", "punto": "."}
#: Spelled digits and groups of figures in a row that are read together; the detectors' own counts and checks decide.
_LEAST_SPELLED = 4


@functools.lru_cache(maxsize=65536)
def _plain(c: str) -> str:
    """What a disguised character stands for; itself if it isn't one."""
    if c in _INVISIBLE:
        return ""
    if c in _LOOK or c in _MARKS:
        return _LOOK.get(c) or _MARKS[c]
    plain = unicodedata.normalize("NFKC", c)
    return plain if plain.isascii() else c


#: Signs of disguise: look-alikes, and ranges of characters with an ASCII compatibility form.
_GLYPHS = re.compile(
    "[" + "".join(_LOOK) + _INVISIBLE + "".join(_MARKS) + "\u00a0\u2000-\u200a\u202f\u205f\u00b2\u00b3\u00b9"
    "\u2070-\u2089\u2460-\u24ff\uff01-\uff5e\ufe52\ufe6b\U0001d400-\U0001d7ff\U0001fbf0-\U0001fbf9]")
_OPENS, _AT_WORDS, _DOT_WORDS = "[({<", ("at", "ät", "arroba", "arobase", "@"), ("dot", "punkt", "point", "punto", ".")
_OPEN, _CLOSE = rf"\s?[{re.escape(_OPENS)}]\s?", r"\s?[\])}>]\s?"
_AT = re.compile(rf"(?i)(?<=[a-z0-9._%+-]){_OPEN}(?:{'|'.join(_AT_WORDS)}){_CLOSE}(?=[a-z0-9-])")
_DOT = re.compile(rf"(?i)(?<=[a-z0-9-]){_OPEN}(?:{'|'.join(map(re.escape, _DOT_WORDS))}){_CLOSE}(?=[a-z0-9-])")
_SAID = re.compile(
    r"(?i)(?<![a-z0-9._%+@-])([a-z0-9._%+-]{1,64})(?:\sat\s|@)([a-z0-9-]{1,63})((?:\s(?:dot|punkt|punto)\s[a-z0-9-]{1,63})+)"
    r"(?![a-z0-9-])")
_SAID_DOT = re.compile(r"(?i)\s(?:dot|punkt|punto)\s")
#: One of these is in every text with an at/dot disguise: what the patterns above can begin with, and spoken dots.
_SIGNS = ("dot", "punkt", "punto", *(
    o + space + word for o in _OPENS for space in ("", " ", "\t", "\n", "\u00a0") for word in (*_AT_WORDS, *_DOT_WORDS)))
_WORD = "|".join(sorted(_DIGITS, key=len, reverse=True))
_JOIN = r"(?:[ ,-]{1,3}|\s(?:dot|punkt|punto)\s)"
_ITEM = rf"(?:{_WORD}|[0-9]{{1,19}})"
_SPELLED = re.compile(rf"(?<!\w)(?:plus[ ,-]{{1,3}})?{_ITEM}(?:{_JOIN}{_ITEM}){{{_LEAST_SPELLED - 1},}}(?!\w)")
_SPELLED_PART = re.compile(rf"plus|dot|punkt|punto|{_WORD}|[0-9]+")
#: A text without one of these has no spelled number.
_SPELLED_SIGN = re.compile(rf"(?<!\w)(?:{_WORD}|plus|dot|punkt|punto)(?!\w)")


def _said(m: re.Match) -> list:
    pieces = [m.span(1), "@", m.span(2)]
    dots = list(_SAID_DOT.finditer(m.string, m.start(3), m.end(3)))
    for dot, after in zip(dots, [*dots[1:], None]):
        pieces += [".", (dot.end(), after.start() if after else m.end(3))]
    return pieces


def deobfuscate(text: str) -> Tape | None:
    """The normalised text with its source spans; None if it holds no sign of disguise."""
    low = text.lower()
    glyphs = None if text.isascii() else _GLYPHS.search(text)
    said = any(sign in low for sign in _SIGNS)
    spelled = _SPELLED_SIGN.search(low) and _SPELLED.search(low)
    if not (glyphs or said or spelled):
        return None
    tape = Tape.of(text)
    if glyphs:
        tape = tape.rewrite(_GLYPHS, lambda m: None if _plain(m[0]) == m[0] else [_plain(m[0])])
    tape = tape.rewrite(_AT, lambda m: ["@"]).rewrite(_DOT, lambda m: ["."])
    tape = tape.rewrite(_SAID, _said)
    parts = _spell(tape)
    return None if parts.text == text else parts


def _spell(tape: Tape) -> Tape:
    """Spelled digits, each mapped to its own word; figures among them stay, and so does what parts two groups of figures."""
    lower = tape.text.lower()
    if len(lower) != len(tape.text):  # a capital whose small form is longer: only its own case is read
        lower = tape.text
    text, low, high, done = [], [], [], 0
    for m in _SPELLED.finditer(lower):
        items = list(_SPELLED_PART.finditer(lower, m.start(), m.end()))
        figures = [x[0][0].isascii() and x[0][0].isdigit() for x in items]
        if all(figures):
            continue
        tape._keep(text, low, high, done, m.start())
        for i, x in enumerate(items):
            if figures[i]:
                tape._keep(text, low, high, items[i - 1].end() if i and figures[i - 1] else x.start(), x.end())
                continue
            text.append(_SPOKEN.get(x[0]) or _DIGITS[x[0]])
            low.append(tape.low[x.start()])
            high.append(tape.high[x.end() - 1])
        done = m.end()
    if not done:
        return tape
    tape._keep(text, low, high, done, len(tape.text))
    return Tape("".join(text), low, high)


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, added spans) of a text, in code points, each in order."""
    base = detect(text)
    tape = deobfuscate(text)
    if tape is None:
        return base, []
    taken: dict[str, list] = {k: sorted((a, b) for x, a, b in base if x == k) for k in KINDS}
    added = []
    for kind, a, b in detect(tape.text):
        start, end = tape.low[a], tape.high[b - 1]
        if not any(start < y and x < end for x, y in taken[kind]):
            added.append((kind, start, end))
            taken[kind].append((start, end))
    return base, sorted(added, key=_order)


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def _find_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 512):
            part = batch.slice(lo, 512)
            rows = []
            for text in part.column(1).to_pylist():
                base, added = find(text or "")
                spans = [(*s, True) for s in base] + [(*s, False) for s in added]
                spans.sort(key=lambda s: (*_order(s[:3]), not s[3]))
                rows.append([{"kind": k, "start": a, "end": b, "base": own} for k, a, b, own in spans])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, _SPAN)], names=["doc_id", "spans"])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) per row: spans by start, then kind as listed, as structs (kind, start, end, base).

    Offsets are code points of the source text, end exclusive.  Null texts are empty and have
    no spans.  Each row gives a row, repeated or without doc_id; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        _find_map, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")
