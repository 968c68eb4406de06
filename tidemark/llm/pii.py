"""Personal data in texts, found as written and behind disguises.

Plain identifiers are found in the text itself. For disguised ones a chain of transducers rewrites
the text: look-alike letters and foreign digits become ASCII, invisible characters go, spelled digits
become digits, "at" and "dot" become @ and a point. Each transducer keeps, for every character it
writes, the stretch of source characters that it stands for. Identifiers are detected in what comes
out, and spans that hold something rewritten are carried back to the source.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, small_batches

#: Kinds found as written; the same kinds behind a disguise are named with this prefix.
KINDS = ("email", "ip", "card", "phone")
DISGUISED = "disguised_"
NAMES = (*KINDS, *(DISGUISED + k for k in KINDS))

# --- identifiers

# Runs of a class are taken whole and are never given back, so a long run costs its length once.
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int]


def run_before(text: str, end: int, least: int = 0) -> int:
    """Where the run of characters of local parts that ends at ``end`` begins."""
    while end > least and text[end - 1] in _LOCAL:
        end -= 1
    return end


def emails(text: str) -> Iterator[Span]:
    """Leftmost first: from each @ back over the local part, not into the address before."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = run_before(text, at, done)
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            done = host.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.groups()]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 38:  # 19 digits and what lies between them
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGIT.findall(m[0])) <= 15:
            yield m.span()


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain identifiers, by start, then kind: leftmost first, not
    overlapping within a kind."""
    found = []
    for kind, (mark, find) in enumerate((("@", emails), (None, ips), (None, cards), ("+", phones))):
        if mark is None or mark in text:
            found += [(start, kind, end) for start, end in find(text)]
    return sorted(found)


# --- transducers


@dataclass
class Rewritten:
    """A text with the stretch of the source that each of its characters stands for."""

    text: str
    begin: np.ndarray
    end: np.ndarray
    changed: np.ndarray

    @classmethod
    def of(cls, text: str) -> Rewritten:
        place = np.arange(len(text), dtype=np.int64)
        return cls(text, place, place + 1, np.zeros(len(text), bool))

    def edited(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """With the stretches (start, end) of this text replaced; edits in order, not overlapping.
        What is written stands for all that it replaces."""
        texts, at = [], 0
        for start, end, new in edits:
            texts += [self.text[at:start], new]
            at = end
        n = len(self.text)
        first = np.array([start for start, _, _ in edits])
        last = np.array([end for _, end, _ in edits]) - 1
        within = np.zeros(n + 1, np.int64)
        within[first] += 1
        within[last + 1] -= 1
        times = (np.cumsum(within[:-1]) == 0).astype(np.int64)
        times[first] = [len(new) for _, _, new in edits]
        to, changed = np.arange(n), self.changed.copy()
        to[first], changed[first] = last, True
        which = np.repeat(np.arange(n), times)
        return Rewritten("".join([*texts, self.text[at:]]), self.begin[which], self.end[to[which]], changed[which])

    def source(self, start: int, end: int) -> Span | None:
        """The source stretch of a span, None where nothing in it was rewritten: no character
        changed and none left out."""
        begin, stop = int(self.begin[start]), int(self.end[end - 1])
        if self.changed[start:end].any() or stop - begin != end - start:
            return begin, stop
        return None


# Letters and marks of other scripts that look like ASCII ones; compatibility forms
# and digits of all scripts come from the Unicode tables.
LOOKALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H",
    "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "Α": "A", "Β": "B", "Ε": "E",
    "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "Χ": "X", "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "ս": "u", "օ": "o",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-",
    "。": ".", "․": ".",
}
INVISIBLE = "\u00ad\u180e\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"


def _folds() -> dict[str, str]:
    """Characters that are written otherwise, with what they become."""
    folds = {}
    for code in range(0x80, 0x20000):
        c = chr(code)
        if 0xD800 <= code <= 0xDFFF:
            continue
        digit = unicodedata.decimal(c, None)
        plain = str(digit) if digit is not None else unicodedata.normalize("NFKC", c)
        if plain != c and len(plain) == 1 and " " <= plain <= "~":
            folds[c] = plain
    return folds | LOOKALIKES | dict.fromkeys(INVISIBLE, "")


def _class(characters: dict[str, str]) -> re.Pattern:
    codes = sorted(map(ord, characters))
    cuts = [0, *[i + 1 for i, (a, b) in enumerate(pairwise(codes)) if b != a + 1], len(codes)]
    ranges = [(codes[a], codes[b - 1]) for a, b in pairwise(cuts)]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]")


# Digits by name in English, German, French and Spanish.
DIGIT_NAMES = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
    "un": 1, "oh": 0,
}
REPEATED = {"double": 2, "triple": 3}
POINTS = ("dot", "point", "punkt", "punto")
#: What a stretch of spelled digits has at least: digits, and of these as many by name.
LEAST_DIGITS, LEAST_NAMES = 4, 3

_NAMED = "|".join(sorted(DIGIT_NAMES, key=len, reverse=True))
_ITEM = rf"(?:(?:double|triple)[ ]+)?(?:{_NAMED})(?![^\W\d_])|[0-9]++(?![^\W_])"
_BETWEEN = rf"(?:\.|[ ]*+[,-]?+[ ]*+(?:(?:{'|'.join(POINTS)})[ ]++)?+)"
_SPELLED = re.compile(rf"(?i)(?<![\w])(?:(?:plus[ ]++)|\+[ ]*+)?+(?:{_ITEM})(?:{_BETWEEN}(?:{_ITEM}))++")
_PIECE = re.compile(rf"(?i)plus|\+|double|triple|{_NAMED}|[0-9]+|[.]|{'|'.join(POINTS)}")
_NAME = re.compile(rf"(?i)\b(?:{_NAMED})\b")

# Letters for digits inside numbers.
_SMUDGED = re.compile(r"(?<![A-Za-z0-9])[0-9OoIl](?:[ .-]?[0-9OoIl])++")
_LETTER = re.compile(r"[A-Za-z]")
_SMUDGES = str.maketrans("OoIl", "0011")

_BRACKETED = re.compile(
    r"(?i)(?<![ \t])[ \t]*+(?:[\[({<][ \t]*+(?:(?P<at>at|@|arobase|arroba)|dot|point|punkt|punto|\.)[ \t]*+[\])}>])[ \t]*+"
)
_DASHED_AT = re.compile(r"(?<=[A-Za-z0-9])([-_])at\1(?=[A-Za-z0-9]++(?:\1dot\1[A-Za-z0-9]++)++)")
_DASHED_HOST = re.compile(r"[A-Za-z0-9]++(?:[-_]dot[-_][A-Za-z0-9]++)++")
_DASHED_DOT = re.compile(r"[-_]dot[-_]")
_SPOKEN = re.compile(
    r"(?i)(?:(?<=\s)(?:at|@)[ \t]++|@)(?P<host>[A-Za-z0-9-]++(?:(?:[ \t]++dot[ \t]++|\.)[A-Za-z0-9-]++)++)"
)
_SPOKEN_DOT = re.compile(r"(?i)[ \t]++dot[ \t]++")
_SPACED = re.compile(r"(?<=[A-Za-z0-9._%+-])[ \t]++@[ \t]++[A-Za-z0-9-]++(?:[ \t]++\.[ \t]++[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++")
_SPACED_MARK = re.compile(r"[ \t]++([@.])[ \t]++")

#: Top-level names that end a spoken address; two-letter ones that are English words are left out.
TOP_LEVEL = frozenset(
    "com org net edu gov mil int info biz name pro dev app io co ai uk de fr es nl ch se dk fi pl cz"
    " pt br mx ar cl jp cn kr au nz ca ru ua tr gr hu ro ie eu tv cc xyz online site example test".split()
)


Edits = list[tuple[int, int, str]]


def spelled_digits(text: str) -> Edits:
    """Spelled digits in stretches of at least LEAST_DIGITS, with double, triple, plus and points
    between them; nothing else may stand in such a stretch."""
    edits: Edits = []
    for m in _SPELLED.finditer(text) if _NAME.search(text) else ():
        if len(_NAME.findall(m[0])) < LEAST_NAMES:
            continue
        times, out, count = 1, [], 0
        for piece in _PIECE.findall(m[0].lower()):
            if piece in REPEATED:
                times = REPEATED[piece]
            elif piece in DIGIT_NAMES or piece.isdigit():
                new = str(DIGIT_NAMES.get(piece, piece)) * times
                out.append(new)
                times, count = 1, count + len(new)
            else:
                out.append("+" if piece in ("plus", "+") else ".")
        if count >= LEAST_DIGITS:
            edits.append((*m.span(), "".join(out)))
    return edits


def smudged_digits(text: str) -> Edits:
    """O, o, I and l inside numbers that hold at least 3 digits for each of them."""
    edits: Edits = []
    for m in _SMUDGED.finditer(text):
        number = m[0]
        if _LETTER.match(text, m.end()):  # the last piece goes on as a word
            number = number[: max(map(number.rfind, " .-")) + 1]
        letters = sum(map(number.count, "OoIl"))
        if letters and len(_DIGIT.findall(number)) >= 3 * letters:
            at = m.start()
            edits += [(at + i, at + i + 1, c.translate(_SMUDGES)) for i, c in enumerate(number) if c in "OoIl"]
    return edits


def bracketed_marks(text: str) -> Edits:
    """[at], (dot), {.} and the like, with the blanks about them."""
    if not any(c in text for c in "[({<"):
        return []
    return [(*m.span(), "@" if m["at"] else ".") for m in _BRACKETED.finditer(text)]


def dashed_marks(text: str) -> Edits:
    """name-at-host-dot-com, with - or _ throughout."""
    edits, done = [], 0
    for m in _DASHED_AT.finditer(text) if "-at-" in text or "_at_" in text else ():
        if m.start() >= done:
            done = _DASHED_HOST.match(text, m.end()).end()
            edits.append((*m.span(), "@"))
            edits += [(*d.span(), ".") for d in _DASHED_DOT.finditer(text, m.end(), done)]
    return edits


_NO_WORD = re.compile(r"(?=.*[A-Za-z])(?=.*[0-9_%+.])[A-Za-z0-9]++(?:[._%+-]++[A-Za-z0-9]++)*+")


def _spoken_name(text: str, end: int, least: int) -> tuple[Edits, int, int]:
    """Edits of the points spelled in the name before ``end``; where the name begins and ends."""

    def space_before(i: int) -> int:
        while i > least and text[i - 1] in " \t":
            i -= 1
        return i

    stop = space_before(end)
    start, points = run_before(text, stop, least), []
    while start < stop:
        word = space_before(start)
        before = space_before(word - 3)
        first = run_before(text, before, least)
        dot = word < start and before < word - 3 and text[max(least, word - 3) : word].lower() == "dot"
        if not dot or first == before:
            break
        points.append((before, start, "."))
        start = first
    return points[::-1], start, stop


def spoken_marks(text: str) -> Edits:
    """name at host dot com, where points of the name may be spelled as well; name at host.com only
    for names that no word is: letters with digits, points or the like among them."""
    edits, done = [], 0
    for m in _SPOKEN.finditer(text):
        host = m["host"]
        spoken = _SPOKEN_DOT.search(host)
        plain = not spoken and m[0].startswith("@")
        if plain or re.split(r"(?i)[ \t]+dot[ \t]+|\.", host)[-1].lower() not in TOP_LEVEL:
            continue
        points, start, stop = _spoken_name(text, m.start(), done)
        name = text[start:stop]
        if not name or not (spoken or points or _NO_WORD.fullmatch(name)):
            continue
        edits += [*points, (stop, m.start("host"), "@")]
        edits += [(*d.span(), ".") for d in _SPOKEN_DOT.finditer(text, m.start("host"), m.end())]
        done = m.end()
    return edits


def spaced_marks(text: str) -> Edits:
    """name @ host . com"""
    edits: Edits = []
    for m in _SPACED.finditer(text) if "@" in text else ():
        if re.split(r"[ \t.]+", m[0])[-1].lower() in TOP_LEVEL:
            edits += [(*d.span(), d[1]) for d in _SPACED_MARK.finditer(text, *m.span())]
    return edits


class Transducers:
    """The chain, its tables made once for a task."""

    def __init__(self) -> None:
        self.folds = _folds()
        self.foldable = _class(self.folds)

    def folded(self, text: str) -> Edits:
        if text.isascii():
            return []
        return [(*m.span(), self.folds[m[0]]) for m in self.foldable.finditer(text)]

    def __call__(self, text: str) -> Rewritten | None:
        """The text rewritten, None where nothing is."""
        t = None
        for step in (
            self.folded,
            spelled_digits,
            smudged_digits,
            bracketed_marks,
            dashed_marks,
            spoken_marks,
            spaced_marks,
        ):
            if edits := step(t.text if t else text):
                t = (t or Rewritten.of(text)).edited(edits)
        return t


def disguised(text: str, transducers: Transducers) -> list[tuple[int, int, int]]:
    """(start, kind, end) in the source of identifiers that only show once the text is rewritten."""
    t = transducers(text)
    if t is None:
        return []
    found = set()
    for start, kind, end in identifiers(t.text):
        span = t.source(start, end)
        if span and (kind or t.text[start:end].rpartition(".")[2].isalpha()):
            found.add((span[0], len(KINDS) + kind, span[1]))
    return sorted(found)


_SPANS = "array<struct<start:int,kind_no:int,kind:string,stop:int>>"
_ARROW_SPAN = pa.struct([("start", pa.int32()), ("kind_no", pa.int32()), ("kind", pa.string()), ("stop", pa.int32())])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the id and ``spans``, an array of (start, kind_no, kind, stop)
    by start, then kind as listed in NAMES; code points of the source text, stop exclusive.

    Plain kinds are leftmost first and don't overlap within a kind. A disguised kind is given where
    something within its span was rewritten; it may overlap others. Null, empty and white texts have
    no spans; null and repeated ids keep a row each; an empty table gives an empty result; other
    columns are not looked at.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf(_SPANS)
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        transducers = Transducers()
        for texts in batches:
            rows = []
            for value in texts.to_pylist():
                spans = sorted(identifiers(value) + disguised(value, transducers)) if value else []
                rows.append([{"start": s, "kind_no": k, "kind": NAMES[k], "stop": e} for s, k, e in spans])
            yield pa.array(rows, pa.list_(_ARROW_SPAN))

    spans = fresh(docs, "spans")
    return docs.select(F.col(id_col), scanned(F.col(text)).alias(spans)).withColumnRenamed(spans, "spans")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def plain_spans(spans: Column) -> Column:
    """The spans of KINDS alone."""
    return F.filter(spans, lambda s: s["kind_no"] < len(KINDS))


def listed(spans: Column) -> Column:
    """Spans as kind:start:stop, joined by commas."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")),
        ),
        ",",
    )
