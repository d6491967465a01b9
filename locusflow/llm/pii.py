"""Offset-preserving personal-data detection.

Two passes over each whole text. The base pass runs the four plain detectors.
The second pass runs only on texts with a disguise: a chain of transducers
rewrites homoglyphs and digits of other scripts, spelled digits and at/dot
disguises while each output character keeps the source range it came from; the
same detectors run on the rewritten text and their spans are mapped back.

Defined cases: a null text is read as empty; no spans give zero counts, an empty
``spans`` and the SHA-256 of the empty string; repeated rows each get a row; an
empty table gives an empty result. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.llm.common import fresh, prepare

KINDS = ("email", "ip", "card", "phone")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match cannot start inside a run of digits: its tail fails where the whole run failed.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

SPANS = "struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base_sha256:string,spans:string,masked:string>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Only an @ can anchor a match, so each is expanded to both sides."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            yield start, last
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)]
    if "." in text:
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# Letters of other scripts that look like an ASCII letter.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "А": "A", "В": "B", "Е": "E",
    "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "ο": "o", "α": "a",
    "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Ο": "O", "Α": "A", "Β": "B",
    "Ε": "E", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ρ": "P", "Τ": "T", "Χ": "X", "Ζ": "Z",
    "\u2024": ".", "\u3002": ".", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2212": "-", "\u00a0": " ", "\u2007": " ", "\u202f": " ",
}
INVISIBLE = frozenset("\u00ad\u200b\u200c\u200d\u2060\ufeff")
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "une": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "una": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_GAP = r"[\s,.()-]{1,3}"
_SPELLED = re.compile(rf"(?i)(?:(?<![^\W_])(?:plus|más|mas)[\s-]+|\+\s?)?(?<![^\W_])(?:{_WORD}|[0-9]+)(?:{_GAP}(?:{_WORD}|[0-9]+))*{_GAP}(?:{_WORD}|[0-9]+)(?![^\W_])")
_PIECE = re.compile(rf"(?i)plus|más|mas|\+|{_WORD}|[0-9]+")
_AT_WORDS, _DOT_WORDS = "at|arroba|arobase|arrobase", "dot|punkt|point|punto"
_DOTS = frozenset([*_DOT_WORDS.split("|"), "."])
_OCTET = rf"(?:(?:{_WORD}|[0-9])(?:[\s-]{{1,2}}(?:{_WORD}|[0-9])){{0,2}}|[0-9]{{1,3}})"
_SPELLED_IP = re.compile(rf"(?i)(?<![^\W_])(?<![0-9]\.){_OCTET}(?:(?:\s+(?:{_DOT_WORDS})\s+|\.){_OCTET}){{3}}(?![^\W_])")
_IP_DOT = re.compile(rf"(?i)\s+(?:{_DOT_WORDS})\s+|\.")
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
# These begin with what is rare: where white space or words come first, they are extended to the left by hand, or long runs would be read again from each of their characters.
_BRACKET = re.compile(rf"(?i){_OPEN}\s{{0,3}}({_AT_WORDS}|{_DOT_WORDS}|@|\.)\s{{0,3}}{_CLOSE}")
_AT = re.compile(rf"(?i)(?<=\s)({_AT_WORDS})(?=\s)|@")
_HOST = re.compile(rf"(?i)\s*([A-Za-z0-9-]+(?:(?:\s+(?:{_DOT_WORDS})\s+|\.)[A-Za-z0-9-]+)+)")
_DOT_BEFORE = frozenset(_DOT_WORDS.split("|"))
_LOCAL_WORD = _LOCAL_CHARS - {"."}
#: Last labels that a plain word at may lead to; names that are common words are left out.
TOP_LEVEL = frozenset("com org net edu gov mil int info biz io co dev app ai tv uk de fr es nl eu ch ru cn jp br pl se no dk fi pt ca au example test invalid localhost mx kr xyz online site shop cloud tech club cz hu gr tr ua ro sk ie il sg hk tw nz za cl pe cat eus swiss berlin gmbh".split())
#: After a real @, or one in brackets, any name of letters may be last.
_LABEL = re.compile(r"(?i)[a-z]{2,}|xn--[a-z0-9-]+")
_PLAIN_PART = re.compile(rf"(?i)\s+({_AT_WORDS}|{_DOT_WORDS})\s+|\s*(@)\s*")
_DOT_IP = re.compile(rf"(?i)(?<![0-9])[0-9]{{1,3}}(?:\s+(?:{_DOT_WORDS})\s+[0-9]{{1,3}}){{3}}(?![0-9])")
#: So many digit words in a row are rewritten even where no detector takes them by themselves.
MIN_SPELLED = 7

# What each transducer needs at least to change a text; in lower case, without glyphs to rewrite.
_SEEN_SPELLED = re.compile(rf"(?<![^\W_])(?:{_WORD}{_GAP}(?:{_WORD}|[0-9])|[0-9]+{_GAP}{_WORD})")
_SEEN_AT = re.compile(rf"\s(?:{_DOT_WORDS})\s+[a-z0-9_%+-]|\s@|@\s|\s(?:{_AT_WORDS})\s+[a-z0-9-]+(?:\s+(?:{_DOT_WORDS})\s|\.)")


class Mapped:
    """A text whose characters know the source range they stand for."""

    def __init__(self, text: str):
        self.text = text
        self.starts, self.ends = range(len(text)), range(1, len(text) + 1)  # arrays once something is rewritten

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """edits: ascending, disjoint (start, end, replacement)."""
        if not edits:
            return
        text, starts, ends, at = [], array("q"), array("q"), 0
        for a, b, new in edits:
            text.append(self.text[at:a])
            starts.extend(self.starts[at:a])
            ends.extend(self.ends[at:a])
            if b > a:
                text.append(new)
                starts.extend([self.starts[a]] * len(new))
                ends.extend([self.ends[b - 1]] * len(new))
            at = b
        self.text = "".join(text) + self.text[at:]
        starts.extend(self.starts[at:])
        ends.extend(self.ends[at:])
        self.starts, self.ends = starts, ends


def _plain_glyph(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    d = unicodedata.decimal(c, unicodedata.digit(c, None))
    if d is not None:
        return str(d)
    n = unicodedata.normalize("NFKC", c)
    return n if len(n) == 1 and n.isascii() else c


class _Glyphs(dict):
    """What each character met so far is rewritten to."""

    def __missing__(self, c: str) -> str:
        self[c] = n = c if c.isascii() else _plain_glyph(c)
        return n


_PLAIN_OF = _Glyphs()


def _glyphs(m: Mapped) -> None:
    m.rewrite([(i, i + 1, n) for i, c in enumerate(m.text) if (n := _PLAIN_OF[c]) != c])


def _space_before(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1].isspace():
        at -= 1
    return at


def _space_after(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def _brackets(m: Mapped) -> None:
    edits, end = [], 0
    for x in _BRACKET.finditer(m.text):
        start, end = _space_before(m.text, x.start(), end), _space_after(m.text, x.end())
        edits.append((start, end, "." if x[1].lower() in _DOTS else "@"))
    m.rewrite(edits)


def _octets(run: str) -> str | None:
    parts = _IP_DOT.split(run)
    parts = ["".join(DIGIT_WORDS.get(p.lower(), p) for p in _PIECE.findall(x)) for x in parts]
    return ".".join(parts) if all(int(p) <= 255 for p in parts) else None


def _number(run: str) -> tuple[int, int, str] | None:
    """The widest part of a run of digit words and digits, from its first word and to its last one at least, that is a number to the detectors."""
    found = list(_PIECE.finditer(run))
    pieces = [DIGIT_WORDS.get(x[0].lower(), x[0] if x[0].isdigit() else "+") for x in found]
    words = [k for k, x in enumerate(found) if x[0].lower() in DIGIT_WORDS]
    if not words:
        return None
    for a in dict.fromkeys((0, int(pieces[0] == "+"), words[0])):
        for b in dict.fromkeys((len(found), words[-1] + 1)):
            digits = "".join(pieces[a:b])
            if any((s, e) == (0, len(digits)) for _, s, e in detect(digits)):
                return found[a].start(), found[b - 1].end(), digits
    if len(words) >= MIN_SPELLED:
        a = 0 if pieces[0] == "+" or len(pieces[0]) == 1 else words[0]
        return found[a].start(), found[-1].end(), "".join(pieces[a:])
    return None


def _spelled(m: Mapped) -> None:
    m.rewrite([(*x.span(), n) for x in _SPELLED_IP.finditer(m.text) if (n := _octets(x[0])) and n != x[0]])
    m.rewrite([(x.start() + n[0], x.start() + n[1], n[2]) for x in _SPELLED.finditer(m.text) if (n := _number(x[0]))])


def _local_start(text: str, end: int, least: int) -> int:
    """Where a local part that ends at end begins: words, with dot words between them. Only the first may hold dots."""
    at = end
    while True:
        while at > least and text[at - 1] in _LOCAL_WORD:
            at -= 1
        if at > least and text[at - 1] == ".":
            while at > least and text[at - 1] in _LOCAL_CHARS:
                at -= 1
            return at
        if at == end or (dot := _space_before(text, at, least)) == at:
            return at
        word = dot
        while word > least and dot - word < 6 and text[word - 1].isalpha():
            word -= 1
        before = _space_before(text, word, least)
        if text[word:dot].lower() not in _DOT_BEFORE or before == word or before == least or text[before - 1] not in _LOCAL_CHARS:
            return at
        at = end = before


def _at_dot(m: Mapped) -> None:
    edits, last, text = {}, 0, m.text
    for x in _AT.finditer(text):
        if x.start() < last:
            continue
        end = _space_before(text, x.start(), last)
        if end == last or text[end - 1] not in _LOCAL_CHARS or not (host := _HOST.match(text, x.end())):
            continue
        start, last = _local_start(text, end, last), host.end()
        label = re.split(r"\.|\s", host[1])[-1].lower()
        if label not in TOP_LEVEL and (x[1] or not _LABEL.fullmatch(label)):
            continue
        for p in _PLAIN_PART.finditer(text, start, last):
            edits[p.start()] = (*p.span(), "." if (p[1] or "").lower() in _DOTS else "@")
    for x in _DOT_IP.finditer(text):
        for p in _PLAIN_PART.finditer(text, *x.span()):
            edits[p.start()] = (*p.span(), ".")
    m.rewrite([edits[k] for k in sorted(edits)])


def disguised(text: str) -> bool:
    """False only if no transducer would change the text."""
    if not text.isascii() and any(_PLAIN_OF[c] != c for c in set(text)):
        return True
    low = text.lower()
    return bool(_SEEN_AT.search(low) or _SEEN_SPELLED.search(low) or _BRACKET.search(text))


def find(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans. A mapped-back span counts if its source differs
    from what was detected and it overlaps no base span of its kind."""
    text = text or ""
    base = detect(text)
    if not disguised(text):
        return base, base
    m = Mapped(text)
    for step in (_glyphs, _brackets, _spelled, _at_dot):
        step(m)
    if isinstance(m.starts, range):
        return base, base
    taken: dict[int, list[tuple[int, int]]] = {}  # by kind, in order
    for k, a, b in base:
        taken.setdefault(k, []).append((a, b))
    more = []
    for k, a, b in detect(m.text):
        s, e = m.starts[a], m.ends[b - 1]
        own = taken.setdefault(k, [])
        if text[s:e] != m.text[a:b]:
            at = bisect_left(own, (s, e))
            if (at == 0 or own[at - 1][1] <= s) and (at == len(own) or own[at][0] >= e):
                own.insert(at, (s, e))
                more.append((k, s, e))
    return base, sorted([*base, *more])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or union of overlapping spans, replaced by the name of its first kind."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def pii_udf(mask: bool):
    @F.pandas_udf(SPANS)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = []
            for t in texts:
                t = t or ""
                base, spans = find(t)
                n = [0, 0, 0, 0]
                for k, _, _ in spans:
                    n[k] += 1
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), masked(t, spans) if mask and spans else None))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "masked"])

    return run


def detect_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, counts of all spans by kind, digest of the base spans, all spans."""
    prepare(docs.sparkSession)
    found = docs.select(F.col(id_col).alias("doc_id"), pii_udf(False)(F.col(text_col)).alias("x"))
    return found.select("doc_id", "x.n_email", "x.n_ip", "x.n_card", "x.n_phone", "x.base_sha256", "x.spans")


def mask_pii(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents with every found span replaced; a null text stays null, all columns stay."""
    prepare(docs.sparkSession)
    names = docs.columns
    x = fresh(names, "__pii")
    out = docs.withColumn(x, pii_udf(True)(F.col(text_col)))
    made = F.col(f"{x}.masked")
    out = out.withColumn(text_col, F.coalesce(made, F.col(text_col)))
    if length_col in names:
        out = out.withColumn(length_col, F.when(made.isNotNull(), F.length(text_col).cast("long")).otherwise(F.col(length_col)))
    return out.select(*names)
