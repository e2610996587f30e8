"""Personal data: fixed patterns, and disguised identifiers found in an offset-preserving normal form."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Kinds in the order that breaks ties between spans with one start.
KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile(r"[0-9]")
# a number that starts inside a run of digits ends as the whole run does, so runs are tried once
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Cyrillic and Greek letters that look like Latin ones.
HOMOGLYPHS = dict(zip("АВЕКМНОРСТХІЈЅаеорсухіјѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανι", "ABEKMHOPCTXIJSaeopcyxijsdhqwABEZHIKMNOPTYXoavi", strict=True))
# Characters without width.
INVISIBLE = frozenset(map(chr, (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)))
# Digits as words in English, German, Spanish and French.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}

_DIGIT_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_AT, _DOT = "at|arroba|ät", "dot|punto|punkt|point"
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
# The signs as character references and in percent code.
_CODED_AT, _CODED_DOT = "&#0*+64;|&#x0*+40;|&commat;|%40", "&#0*+46;|&#x0*+2e;|&period;|%2e"
# no part can be entered at more than one place of a run of white space, so a scan is linear
_PHRASES = re.compile(
    rf"(?P<at>{_OPEN}\s*+(?:{_AT}|@)\s*+{_CLOSE}\s*+)"
    rf"|(?P<dot>{_OPEN}\s*+(?:{_DOT}|\.)\s*+{_CLOSE}\s*+)"
    rf"|(?P<coded_at>{_CODED_AT})|(?P<coded_dot>{_CODED_DOT})"
    rf"|(?P<joined_at>(?<=[A-Za-z0-9])_(?:{_AT})_(?=[A-Za-z0-9-]++_(?:{_DOT})_[A-Za-z0-9]))"
    rf"|(?P<joined_dot>(?<=[A-Za-z0-9])_(?:{_DOT})_(?=[A-Za-z0-9]))"
    rf"|(?P<bare_at>(?<=[A-Za-z0-9])\s++(?:{_AT})\s++(?=[A-Za-z0-9-]++(?:\s++(?:{_DOT})\s++[A-Za-z0-9]|\s*+{_OPEN}\s*+(?:{_DOT})\s*+{_CLOSE}|(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,24}}\b)))"
    rf"|(?P<bare_dot>(?<=[A-Za-z0-9])\s++(?:{_DOT})\s++(?=[A-Za-z0-9]))",
    re.IGNORECASE,
)
_TOKENS = re.compile(
    rf"(?P<plus>\bplus[ -]++(?=(?:{_DIGIT_WORD}|[0-9]++)\b))"
    rf"|(?P<digits>\b(?:{_DIGIT_WORD}|[0-9]++)(?:[ ,-]++(?:{_DIGIT_WORD}|[0-9]++)\b)*+\b)",
    re.IGNORECASE,
)
_PARTS = re.compile(r"[^ ,-]++")
# what all texts have that the normal form changes, but for characters that look like others
_HINT = re.compile(
    rf"{_OPEN}\s*+(?:{_AT}|{_DOT}|@|\.)\s*+{_CLOSE}|{_CODED_AT}|{_CODED_DOT}|_(?:{_DOT})_|\s(?:{_DOT})\s"
    rf"|\s(?:{_AT})\s++[A-Za-z0-9-]++\."
    rf"|\bplus[ -]++(?:{_DIGIT_WORD}|[0-9]++)\b"
    rf"|\.(?:{_DIGIT_WORD})\b|\b(?:{_DIGIT_WORD})\.[A-Za-z0-9]"
    rf"|\b(?:{_DIGIT_WORD})(?:[ ,-]++[0-9]++)*[ ,-]++(?:{_DIGIT_WORD})\b",
    re.IGNORECASE,
)
_SPELLED_ONE = re.compile(rf"\b(?:{_DIGIT_WORD})\b", re.IGNORECASE)
# a spelled digit that other digits, or a plus sign, may share an identifier with
_NEAR = re.compile(rf"(?:[+0-9]|\bplus)[ ().,-]*\b(?:{_DIGIT_WORD})\b|\b(?:{_DIGIT_WORD})[ ().,-]++(?:(?:{_DIGIT_WORD})\b|[0-9])", re.IGNORECASE)


# the parts of _HINT and _NEAR that are looked for by themselves, on lower-cased UTF-8, where they begin with a fixed text
_BRACKETED = re.compile(rf"{_OPEN}\s*+(?:{_AT}|{_DOT}|@|\.)\s*+{_CLOSE}", re.IGNORECASE)
_CODED = re.compile(rf"{_CODED_AT}|{_CODED_DOT}", re.IGNORECASE)
_JOINED_DOTS = [f"_{w}_" for w in _DOT.split("|")]
_BARE_DOT = re.compile(rf"\s(?:{_DOT})\s", re.IGNORECASE)
_BARE_AT = re.compile(rf"\s(?:{_AT})\s++[A-Za-z0-9-]++\.", re.IGNORECASE)
_PLUS = re.compile(rf"\bplus[ -]++(?:{_DIGIT_WORD}|[0-9]++)\b", re.IGNORECASE)
_BETWEEN = re.compile(rb"(?:[ ,-]+[0-9]+)*[ ,-]+")
_NO_LETTER = re.compile(r"[^\x00-\x7F\w]|(?=[^\x00-\x7F])[\d_]")
_TO_SPACE = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))
_SPELLED_TOKENS = [f" {w} ".encode() for w in SPELLED]
_AT_TOKENS, _DOT_TOKENS = ([f" {w} ".encode() for w in words.split("|")] for words in (_AT, _DOT))
_NEAR_MARKS, _LOOK = b" ().,-", 64


def _gates(text: str) -> tuple[bool, bool]:
    """Whether the text has what _HINT and what _NEAR look for; a doubtful case counts.

    Words of the lists are found as whole tokens in a copy whose other ASCII characters are
    spaces, which takes a small part of the time of one pattern over all words.
    """
    low = text.lower()
    if not low.isascii():
        low = _NO_LETTER.sub(" ", low)
    data = low.encode("utf-8", "replace")
    tokens = b" " + data.translate(_TO_SPACE) + b" "
    hint = bool(_BRACKETED.search(text)) or ("&" in text or "%" in text) and bool(_CODED.search(text)) or "_" in text and any(w in low for w in _JOINED_DOTS) or any(t in tokens for t in _DOT_TOKENS) and bool(_BARE_DOT.search(text)) or any(t in tokens for t in _AT_TOKENS) and bool(_BARE_AT.search(text)) or b" plus " in tokens and bool(_PLUS.search(text))
    places: list[tuple[int, int]] = []
    for token in _SPELLED_TOKENS:
        at = tokens.find(token)
        while at >= 0:
            places.append((at, at + len(token) - 2))  # in ``data``, which lacks the first space
            at = tokens.find(token, at + len(token) - 1)
    places.sort()
    near, last = False, -1
    for start, end in places:
        hint = hint or data[start - 1 : start] == b"." or data[end : end + 1] == b"." and data[end + 1 : end + 2].isalnum() or last >= 0 and bool(_BETWEEN.fullmatch(data, last, start))
        before, after = data[max(0, start - _LOOK) : start], data[end : end + _LOOK]
        left, right = before.rstrip(_NEAR_MARKS), after.lstrip(_NEAR_MARKS)
        near = near or left[-1:].isdigit() or left.endswith((b"+", b"plus")) or right[:1].isdigit() or (not left and len(before) == _LOOK) or (not right and len(after) == _LOOK)
        near = near or last >= 0 and start > last and not data[last:start].strip(_NEAR_MARKS)
        last = end
    return hint, near


def _luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            yield start, last
        at = text.find("@", last if found else at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind index) of the fixed patterns, leftmost and non-overlapping within a kind, in order."""
    spans = [(s, e, 0) for s, e in _emails(text)]
    if _DIGIT.search(text):
        spans += [(*m.span(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                spans.append((*m.span(), 2))
        spans += [(*m.span(), 3) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(spans, key=lambda x: (x[0], x[2]))


@lru_cache(maxsize=4096)
def _plain(char: str) -> str:
    """The plain character that one looks like; the empty string for one without width."""
    if char in INVISIBLE:
        return ""
    if char in HOMOGLYPHS:
        return HOMOGLYPHS[char]
    digit = unicodedata.decimal(char, None)
    same = str(digit) if digit is not None else unicodedata.normalize("NFKC", char)
    return same if len(same) == 1 and same.isascii() else char


def _characters(text: str) -> tuple[str, list[int]]:
    """Look-alike characters made plain and characters without width left out, with the place in ``text`` of each that stays."""
    if text.isascii():
        return text, list(range(len(text)))
    chars, origin = [], []
    for i, char in enumerate(text):
        plain = char if char.isascii() else _plain(char)
        if plain:
            chars.append(plain)
            origin.append(i)
    return "".join(chars), origin


def _phrases(text: str) -> tuple[str, list[int]]:
    """At and dot as words, bare, in brackets or between underscores, and as codes, made signs, with the white space around them left out."""
    out, origin, last = [], [], 0
    for m in _PHRASES.finditer(text):
        before = len(text[last : m.start()].rstrip()) + last if m.lastgroup in ("at", "dot") else m.start()
        out += [text[last:before], "@" if m.lastgroup.endswith("at") else "."]
        origin += [*range(last, before), m.start()]
        last = m.end()
    return "".join(out) + text[last:], [*origin, *range(last, len(text))]


def _tokens(text: str, every: bool) -> tuple[str, list[int]]:
    """Runs of digits as words and numbers made one number, and plus as a word made a sign.

    A run needs four digits or more and two words among them, or is one word next to a dot between
    letters or digits, unless ``every`` run with a word counts.
    """
    out, origin, last = [], [], 0
    for m in _TOKENS.finditer(text):
        new, places = "+", [m.start()]
        if m.lastgroup == "digits":
            parts = [(p.start(), p[0], SPELLED.get(p[0].lower())) for p in _PARTS.finditer(text, m.start(), m.end())]
            spelled = sum(digit is not None for _, _, digit in parts)
            if not spelled:
                continue
            new = "".join(digit or part for _, part, digit in parts)
            places = [at + i for at, part, digit in parts for i in range(1 if digit else len(part))]
            start, end = m.span()
            by_dot = len(parts) == 1 and (text[start - 1 : start] == "." and text[start - 2 : start - 1].isalnum() or text[end : end + 1] == "." and text[end + 1 : end + 2].isalnum())
            if not (every or by_dot or (len(new) >= 4 and spelled >= 2)):
                continue
        out += [text[last : m.start()], new]
        origin += [*range(last, m.start()), *places]
        last = m.end()
    return "".join(out) + text[last:], [*origin, *range(last, len(text))]


def normal_form(text: str, *, every: bool = False) -> tuple[str, list[int]]:
    """The text with disguises undone, and for each of its characters the place in the text that it came from.

    Three passes, each with the places of its own output in its input: characters, at and dot
    phrases, digit tokens (``every`` as there). The list has one more entry, the length of the text.
    """
    found, origin = _characters(text)
    for undo in (_phrases, lambda x: _tokens(x, every)):
        found, places = undo(found)
        origin = [origin[i] for i in places]
    return found, [*origin, len(text)]


def _odd(text: str) -> bool:
    return not text.isascii() and any(_plain(c) != c for c in set(text) if not c.isascii())


def _normal_spans(text: str, every: bool) -> list[tuple[int, int, int]]:
    """The fixed patterns of the normal form, as places in the text."""
    normal, origin = normal_form(text, every=every)
    if normal == text:
        return []
    # a span ends where the source of its last character does: before that of the next one, without white space between
    return [(s, s + len(text[s : origin[end]].rstrip(" ,-\t\n\v\f\r")), kind) for start, end, kind in base_spans(normal) for s in [origin[start]]]


class _Spans:
    """Spans in order of their starts, with the furthest end so far, so that what a span meets is found without a look at all of them."""

    def __init__(self, spans=()):
        self.spans, self.starts, self.reach = [], [], []
        for span in spans:
            self.add(span)

    def add(self, span: tuple[int, int, int]) -> None:
        self.spans.append(span)
        self.starts.append(span[0])
        self.reach.append(max(span[1], self.reach[-1] if self.reach else 0))

    def cover(self, s: int, e: int) -> bool:
        """Whether one of the spans holds all of s to e."""
        at = bisect_right(self.starts, s) - 1
        return at >= 0 and self.reach[at] >= e

    def met(self, s: int, e: int):
        """The spans that share a place with s to e."""
        at = bisect_left(self.starts, e) - 1
        while at >= 0 and self.reach[at] > s:
            if self.spans[at][1] > s:
                yield self.spans[at]
            at -= 1


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of identifiers that show only in the normal form and lie in no span of ``base``, as places in the text.

    One may contain a span of ``base``, where that is a part of the identifier that was left plain.
    A short run of spelled digits counts if an identifier that it makes valid overlaps no other,
    or contains one of its kind and has two spelled digits beside it.
    """
    odd = _odd(text)
    taken, added, more = _Spans(base), _Spans(), _Spans()
    hint, near = (True, True) if odd else _gates(text)
    if hint:
        for s, e, kind in _normal_spans(text, False):
            if not taken.cover(s, e) and not added.cover(s, e):
                added.add((s, e, kind))
    if near:
        for s, e, kind in _normal_spans(text, True):
            # one valid without them grows by two spelled digits or more; a single one may be the next word
            grows = lambda a, b, k: k == kind and s <= a and b <= e and len(_SPELLED_ONE.findall(text[s:a] + " " + text[b:e])) >= 2  # noqa: B023, E731
            if not any(more.met(s, e)) and all(grows(*m) for spans in (taken, added) for m in spans.met(s, e)):
                more.add((s, e, kind))
    return sorted(added.spans + more.spans, key=lambda x: (x[0], x[2]))


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The four counts and base_sha256 are of the fixed patterns; ``spans`` lists these and the
    n_added spans of disguised identifiers as kind:start:end by start, then kind, in code points
    of the text with the end exclusive. Disguises are look-alike and full-width characters,
    characters without width, digits as words, at and dot as words, bare, in brackets or between
    underscores, and as signs in brackets, character references or percent codes.

    Null and empty texts give zeros, no spans and the digest of an empty string. Repeated rows
    each give a row; an empty table gives an empty result. Columns beside doc_id and text are not
    read. Work is linear in the length of a text.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                added = added_spans(text or "", base)
                counts = [sum(k == kind for _, _, k in base) for kind in range(4)]
                every = sorted(base + added, key=lambda x: (x[0], x[2]))
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(added)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and ``text`` with every span replaced by its kind in angle brackets; overlapping spans become one, of the first kind."""

    def run(batches):
        for batch in batches:
            texts = []
            for text in batch.column("text").to_pylist():
                if text is not None:
                    base, parts, last = base_spans(text), [], 0
                    for s, e, k in sorted(base + added_spans(text, base), key=lambda x: (x[0], x[2])):
                        if s >= last:
                            parts += [text[last:s], f"<{KINDS[k]}>"]
                        last = max(last, e)
                    text = "".join(parts) + text[last:]
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text string")
