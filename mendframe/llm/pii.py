"""Personal data in texts, disguised or not, with spans in the source text.

Base spans come from four patterns on the text as it is (emails, IP addresses, card numbers, phone numbers), leftmost
and non-overlapping per kind; matches that fail their test are dropped without a retry.

Deobfuscation adds spans: a transducer rewrites the text (homoglyphs and compatibility forms to ASCII, invisible
characters away, spelled digits to digits, at/dot disguises to signs) and keeps for each piece of its output the piece
of the source that it stands for. The same patterns run over the output, and spans that touch a rewritten piece are
mapped back to the source characters they came from. Spans that overlap a base span of their kind are not added.
Emails and IP addresses are first looked for with the blanks and hyphens between spelled digits left out.

Defined cases: null and empty texts have no spans; texts of any length are scanned whole, in linear time; repeated rows
are separate rows; an empty table gives an empty result; extra columns stay out of the way.
"""
from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.llm.shared import small_batches, tidied

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match begins where its run of digits begins, so the look-behind changes no match and keeps long runs linear
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def find_emails(text: str, chained: bool = True) -> Iterator[Span]:
    """chained: whether a match may end just before another at sign."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found and (chained or not text.startswith("@", found.end())):
            end = found.end()
            yield start, end, "email"
        at = text.find("@", max(at + 1, end))


# what a text with a base span of the kind, or with a disguise, must hold; RE2 scans whole batches for it
MAY_HOLD = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}


def find_ips(text: str) -> Iterator[Span]:
    for m in IP.finditer(text):
        if all(len(p) < 4 and int(p or "0") < 256 for p in (x.lstrip("0") for x in m[0].split("."))):
            yield m.start(), m.end(), "ip"


def find_cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.start(), m.end(), "card"


def find_phones(text: str) -> Iterator[Span]:
    for m in PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.start(), m.end(), "phone"


def base_spans(text: str, kinds: Iterable[str] = KINDS, chained: bool = True) -> list[Span]:
    """All base spans of the kinds by start, ties in the order of KINDS."""
    spans: list[Span] = []
    for kind in kinds:
        spans += find_emails(text, chained) if kind == "email" else FINDERS[kind](text)
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


FINDERS = {"ip": find_ips, "card": find_cards, "phone": find_phones}

# fixed values: letters of other scripts that look like ASCII letters, as pairs of equal length
LOOKALIKES = str.maketrans(
    "аеорсухіјѕԁԛԝһӏАВЕКМНОРСТУХІЈЅԚԜαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧɑɡıօսոհ",
    "aeopcyxijsdqwhlABEKMHOPCTYXIJSQWaeikvoptuxABEZHIKMNOPTYXagiounh",
)
# fixed values: digits as words, by digit
DIGIT_WORDS = {
    "0": "zero oh null cero zéro", "1": "one eins uno un une ein", "2": "two zwei zwo dos deux", "3": "three drei tres trois",
    "4": "four vier cuatro quatre", "5": "five fünf cinco cinq", "6": "six sechs seis six", "7": "seven sieben siete sept",
    "8": "eight acht ocho huit", "9": "nine neun nueve neuf",
}
WORD_DIGIT = {w: d for d, words in DIGIT_WORDS.items() for w in words.split()}
AT_WORDS = "at|arroba|arobase"
DOT_WORDS = "dot|punto|punkt|point|period"
OPEN, CLOSE = r"[\[({<_-]", r"[\])}>_-]"

SPELLED = "|".join(sorted(WORD_DIGIT, key=len, reverse=True))
# blanks are taken from the start of their run or not at all, which keeps long runs linear
BLANKS = r"(?:(?<!\s)\s+|)"
REWRITES = re.compile(
    rf"(?P<at>{BLANKS}{OPEN}\s*(?:{AT_WORDS}|@)\s*{CLOSE}\s*|(?<=\w)(?:\s+@\s*|@\s+)(?=\w))"
    rf"|(?P<bare>(?<=\w)\s+(?:{AT_WORDS})\s+(?=\w))"
    rf"|(?P<dot>{BLANKS}{OPEN}\s*(?:{DOT_WORDS}|\.)\s*{CLOSE}\s*|(?<=\w)\s+(?:{DOT_WORDS}|\.)\s+(?=\w))"
    rf"|(?P<plus>\bplus\s+(?=[0-9]|(?:{SPELLED})\b))"
    rf"|(?P<digit>\b(?:{SPELLED})\b)",
    re.IGNORECASE,
)
BETWEEN = re.compile(r"[\s-]+")
JOINED = re.compile(rf"\b(?:{SPELLED})[\s-]+(?:{SPELLED})\b", re.IGNORECASE)
INVISIBLE = frozenset("\u00ad\u200b\u200c\u200d\u2060\ufeff\u180e\u200e\u200f")
DASHES = frozenset("\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe63\uff0d")
# What a text with a span that touches a rewritten piece must hold: for an email an at sign, a bracketed `at` or, with a
# bare `at`, a disguised dot; for a phone a plus before a digit; for an IP a disguised dot, or a dot beside a spelled digit;
# for a card 14 digits. Written without looking ahead and behind; RE2 knows fewer blanks and only ASCII words, and does
# not take a dotted capital I for an i.
BLANK = r"[\s\x0b\x1c-\x1f]"
DIGIT = rf"(?:[0-9]|\b(?:{SPELLED})\b)"
HINTS = (
    rf"@|{OPEN}{BLANK}*(?:{AT_WORDS}|{DOT_WORDS}|\.){BLANK}*{CLOSE}|{BLANK}(?:{DOT_WORDS}|\.){BLANK}"
    rf"|\+{DIGIT}|\bplus{BLANK}+{DIGIT}|\.(?:{SPELLED})\b|\b(?:{SPELLED})\.|(?:{DIGIT}[\x20-]?){{14}}|İ"
)
HINTED = re.compile(HINTS, re.IGNORECASE)


@lru_cache(maxsize=65536)
def plain(c: str) -> str:
    """What a character of another script, width or style stands for in ASCII; itself if nothing."""
    if c in INVISIBLE:
        return ""
    if c in DASHES:
        return "-"
    if c == "。":
        return "."
    look = c.translate(LOOKALIKES)
    if look != c:
        return look
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    form = unicodedata.normalize("NFKC", c)
    if form != c and form.isascii() and len(form) <= 2:
        return " " if form.isspace() else form
    return " " if c.isspace() and c not in "\n\r" else c


class Rewritten:
    """Output of a transducer in pieces (text, source start, source end, kind of change or "")."""

    def __init__(self) -> None:
        self.pieces: list[tuple[str, int, int, str]] = []

    def add(self, text: str, start: int, end: int, change: str) -> None:
        if end > start:
            self.pieces.append((text, start, end, change))

    def close(self) -> None:
        self.text = "".join(p[0] for p in self.pieces)
        self.at = list(accumulate((len(p[0]) for p in self.pieces), initial=0))[:-1]

    def back(self, start: int, end: int) -> tuple[int, int, set[str]]:
        """The source span of output[start:end] and the kinds of change in it."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        (_, a, _, first), (_, c, d, last) = self.pieces[i], self.pieces[j]
        begin = a if first else a + start - self.at[i]
        stop = d if last else c + end - self.at[j]
        return begin, stop, {p[3] for p in self.pieces[i : j + 1]} - {""}


FOLDABLE = re.compile("[" + "".join(c for c in map(chr, range(0x80, 0x20000)) if not 0xD800 <= ord(c) < 0xE000 and plain(c) != c) + "]")


def fold_characters(text: str) -> Rewritten:
    """Homoglyphs, compatibility forms, foreign digits and invisible characters, one source character at a time."""
    out, start = Rewritten(), 0
    for m in FOLDABLE.finditer(text) if not text.isascii() else ():
        i = m.start()
        out.add(text[start:i], start, i, "")
        out.add(plain(m[0]), i, i + 1, "char")
        start = i + 1
    out.add(text[start:], start, len(text), "")
    out.close()
    return out


def unchanged(text: str) -> Rewritten:
    out = Rewritten()
    out.add(text, 0, len(text), "")
    out.close()
    return out


def fold_words(text: str, join: bool = False) -> Rewritten:
    """Spelled digits, spelled plus and at/dot disguises; join: without the blanks and hyphens between spelled digits."""
    out, start, last = Rewritten(), 0, ""
    for m in REWRITES.finditer(text):
        kind = m.lastgroup or ""
        if join and kind == last == "digit" and BETWEEN.fullmatch(text, start, m.start()):
            out.add("", start, m.start(), kind)
            start = m.start()
        last = kind
        sign = {"at": "@", "bare": "@", "dot": ".", "plus": "+"}.get(kind) or WORD_DIGIT[m[0].lower().replace("\u0307", "")]
        out.add(text[start : m.start()], start, m.start(), "")
        out.add(sign, m.start(), m.end(), kind)
        start = m.end()
    out.add(text[start:], start, len(text), "")
    out.close()
    return out


def added_spans(text: str, base: list[Span], hinted: bool = True, foldable: bool = True) -> list[Span]:
    """Spans that only the rewritten text shows, in source characters; none overlaps a base span of its kind.

    An `at` without brackets or blanks for it counts only before a disguised dot: "look at x.com" holds no email.
    IP addresses and emails hold no blanks, so they are looked for with runs of spelled digits joined first.
    """
    first = fold_characters(text) if foldable else unchanged(text)
    second = fold_words(first.text) if HINTED.search(first.text) else None
    if len(first.pieces) <= 1 and second is None:
        return []
    taken = {k: sorted((a, b) for a, b, kind in base if kind == k) for k in KINDS}
    out = []
    rewritten = [(second, span) for span in base_spans((second or first).text, chained=False)]
    if second and JOINED.search(first.text):
        joined = fold_words(first.text, join=True)
        rewritten = [(joined, span) for span in base_spans(joined.text, ("email", "ip"), chained=False)] + rewritten
    for words, (a, b, kind) in rewritten:
        changes = set()
        if words:
            a, b, changes = words.back(a, b)
        a, b, also = first.back(a, b)
        while b > a and text[b - 1].isspace():
            b -= 1
        while a < b and text[a].isspace():
            a += 1
        if "bare" in changes and "dot" not in changes or not changes | also:
            continue
        if not overlaps(taken[kind], a, b):
            insort(taken[kind], (a, b))
            out.append((a, b, kind))
    return out


def overlaps(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    i = bisect_right(spans, (a, 1 << 62))
    return i > 0 and spans[i - 1][1] > a or i < len(spans) and spans[i][0] < b


Spans = tuple[list[Span], list[Span]]


def find_all(text: str | None, kinds: Iterable[str] = KINDS, hinted: bool = True, foldable: bool = True) -> Spans:
    """Base spans and all spans of a text, by start, ties in the order of KINDS.

    kinds, hinted, foldable: what a scan of the batch has left possible.
    """
    text = text or ""
    base = base_spans(text, kinds)
    more = added_spans(text, base, hinted, foldable) if hinted or foldable else []
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1])) if more else base


def find_in_batch(texts: pa.Array) -> list[Spans]:
    """find_all() of each text, after RE2 has told which texts can hold what."""
    holds = {k: np.asarray(pc.fill_null(pc.match_substring_regex(texts, p), False)) for k, p in MAY_HOLD.items()}
    hinted = np.asarray(pc.fill_null(pc.match_substring_regex(texts, HINTS, ignore_case=True), False))
    foldable = np.asarray(pc.fill_null(pc.match_substring_regex(texts, FOLDABLE.pattern), False))
    out: list[Spans] = [([], [])] * len(texts)
    for i in np.flatnonzero(hinted | foldable | np.logical_or.reduce(list(holds.values()))).tolist():
        out[i] = find_all(texts[i].as_py(), [k for k in KINDS if holds[k][i]], bool(hinted[i]), bool(foldable[i]))
    return out


def shown(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_spans and spans (kind:start:end, comma-joined) of documents."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find_in_batch(batch.column(1))
            counts = [pa.array([sum(s[2] == k for s in spans) for _, spans in found], pa.int64()) for k in KINDS]
            base, spans = (pa.array([shown(f[i]) for f in found], pa.string()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, base, spans], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string"
    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(tidied(run), schema)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """Documents with personal data in text replaced; other columns stay, n_chars follows the text."""
    small_batches(docs.sparkSession)
    where = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column(where), find_in_batch(batch.column(where))
            if any(spans for _, spans in found):
                texts = pa.array([redacted(t.as_py(), f[1]) if f[1] else t.as_py() for t, f in zip(texts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == where else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    out = docs.mapInArrow(tidied(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
