"""Personal data with offset-preserving deobfuscation.

Base spans come from four patterns on the text as it is. Then a chain of transducers rewrites the text and keeps, for every
character it puts out, the source characters it stands for: look-alike letters and digits become ASCII and invisible
characters go; disguised at and dot ("[at]", "(dot)", "name at site dot org") become signs; runs of spelled digits become
digits, runs of fewer than four only beside digits. Addresses of four numbers with disguised dots or spelled digits are
rewritten by themselves, since elsewhere a full stop between spelled digits parts nothing. The same patterns run on the rewritten
text, and what they find is mapped back to source offsets. A found span is added if something in it was rewritten and it
overlaps no base span, or holds all those that it overlaps whole and these are of its kind: a disguise may leave a part of an
identifier as a base span, which stays beside the wider one. The counts take such a pair as one.

Offsets are code points, ends exclusive. Every search is linear in the text's length.

Defined cases: a null or empty text has no spans; spans of one kind never overlap; equal rows give equal results; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._spark import prepare

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Characters that look like ASCII ones (Cyrillic, Greek, full-width and mathematical forms are in the rules below).
_LOOK_ALIKE = dict(
    zip(
        "аеорсухіјѕԁһӏкмтвнАВЕКМНОРСТХУІЈЅοαερτυνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ․。﹒﹫٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९⓪①②③④⑤⑥⑦⑧⑨⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉‐‑‒–—−",
        "aeopcyxijsdhlkmtbhABEKMHOPCTXYIJSoaeptuvikABEZHIKMNOPTYX...@0123456789" + "0123456789" * 2 + "0123456789" * 3 + "------",
        strict=True,
    )
)
_LOOK_ALIKE |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
# mathematical, letterlike and circled forms stand for the ASCII letter or digit they decompose to
_LOOK_ALIKE |= {chr(c): n for c in (*range(0x1D400, 0x1D800), *range(0x2100, 0x2150), *range(0x24B6, 0x24EA)) if len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n.isascii() and n.isalnum()}
_UNSEEN = "­​‌‍⁠﻿"
_ODD_CHARACTERS = frozenset([*_LOOK_ALIKE, *_UNSEEN])
_ASCII_FORMS, _HIDDEN = str.maketrans(_LOOK_ALIKE), re.compile(f"[{_UNSEEN}]+")

# The digits as words in English, German, French and Spanish.
_SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_NUMBER = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + "|[0-9])"
_RUN = re.compile(rf"(?<!\w)(?:(?:plus|más)\x20)?{_NUMBER}(?:[\x20.,-]{{1,2}}{_NUMBER}){{3,}}(?!\w)", re.I)
_RUN_PART = re.compile(_NUMBER + r"|plus|más", re.I)

_AT_SIGN = r"\x20?[\[({<]\x20?(?:at|arroba|@)\x20?[\])}>]\x20?"
_AT_WORD = r"\x20(?:at|arroba)\x20"
_DOT_SIGN = r"\x20?[\[({<]\x20?(?:dot|punkt|punto|point|\.)\x20?[\])}>]\x20?"
_DOT_WORD = r"\x20(?:dot|punkt|punto|point)\x20"
_LOCAL_PART, _LABEL = r"[A-Za-z0-9._%+-]++", r"[A-Za-z0-9-]++"
_SITE = rf"(?:(?:{_AT_SIGN}){_LABEL}(?:(?:{_DOT_SIGN}|{_DOT_WORD}|\.){_LABEL})++|(?:{_AT_WORD}){_LABEL}(?:(?:{_DOT_SIGN}|{_DOT_WORD}){_LABEL})++|@{_LABEL}(?:\.{_LABEL})*+(?:(?:{_DOT_SIGN}|{_DOT_WORD}){_LABEL}(?:\.{_LABEL})*+)++)"
# a chain of parts is taken whole whether or not a site follows, so that none of it is read twice
_DISGUISED = re.compile(rf"(?<![A-Za-z0-9._%+-]){_LOCAL_PART}(?:(?:(?:{_DOT_SIGN}){_LOCAL_PART})++(?P<far>{_SITE})?+|(?P<near>{_SITE}))", re.I)
_BRACKET = re.compile(r"[\[({<]")
# Last labels that a name spelled in plain words must end in.
_TOP_LEVEL = frozenset("com org net edu gov mil int info biz io ai co me tv app dev example test eu uk us de fr es it nl ch at be pl pt se no dk fi ru cn jp in br mx ca au nz".split())
_DISGUISE_PART = re.compile(rf"(?P<at>{_AT_SIGN}|{_AT_WORD})|(?P<dot>{_DOT_SIGN}|{_DOT_WORD})", re.I)
_SIGN_HINT = re.compile(r"[\[({<]\x20?(?:at|arroba|@|dot|punkt|punto|point|\.)\x20?[\])}>]", re.I)
_AT_WORDS, _DOT_WORDS, _TOKEN = frozenset(("at", "arroba")), frozenset(("dot", "punkt", "punto", "point")), re.compile(r"\w+")


_WORDS = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + ")"
_SHORT_RUN = re.compile(rf"(?:(?<=[0-9][\x20.,()-])|(?<=[0-9][\x20.,()-]{{2}})|(?<=\+)){_WORDS}(?:[\x20.,-]{{1,2}}{_WORDS}){{0,2}}(?!\w)|(?<!\w){_WORDS}(?:[\x20.,-]{{1,2}}{_WORDS}){{0,2}}(?=[\x20.,()-]{{1,2}}[0-9])", re.I)
_NUMERAL = rf"(?:(?<![0-9])[0-9]++|(?<!\w){_WORDS}(?:[\x20-]{_WORDS}){{0,9}}(?!\w))"
_IP_DISGUISED = re.compile(rf"{_NUMERAL}(?:(?:{_DOT_SIGN}|{_DOT_WORD}|\.){_NUMERAL}){{3}}", re.I)
_IP_PART = re.compile(rf"(?P<dot>{_DOT_SIGN}|{_DOT_WORD}|\.)|(?P<word>{_WORDS})|(?P<gap>[\x20-])", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost non-overlapping matches of local@domain: for each @ the local part reaches back to the previous match."""
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
            at = text.find("@", floor)
        else:
            floor = at + 1
            at = text.find("@", floor)


def detect(text: str) -> list[tuple[str, int, int]]:
    """Base spans (kind, start, end), by kind and then start. Matches that fail their check are dropped."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return out


class Mapped:
    """A text with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self._starts, self._ends = text, None, None

    @property
    def starts(self) -> np.ndarray:
        return np.arange(len(self.text)) if self._starts is None else self._starts

    @property
    def ends(self) -> np.ndarray:
        return np.arange(1, len(self.text) + 1) if self._ends is None else self._ends

    def copy(self) -> Mapped:
        other = Mapped(self.text)
        other._starts, other._ends = self._starts, self._ends
        return other

    def rewrite(self, found: list[tuple[int, int, str]]) -> None:
        """Put new text in place of spans (start, end, new), in order; each new character stands for its whole span."""
        if not found:
            return
        old_starts, old_ends, text, starts, ends, at = self.starts, self.ends, [], [], [], 0
        for a, b, new in found:
            text += [self.text[at:a], new]
            starts += [old_starts[at:a], np.full(len(new), old_starts[a])]
            ends += [old_ends[at:a], np.full(len(new), old_ends[b - 1])]
            at = b
        text.append(self.text[at:])
        self.text = "".join(text)
        self._starts, self._ends = np.concatenate([*starts, old_starts[at:]]), np.concatenate([*ends, old_ends[at:]])


def _plain_letters(t: Mapped) -> None:
    """Look-alikes stand for one character each, so places stay; only invisible characters move what follows."""
    t.text = t.text.translate(_ASCII_FORMS)
    t.rewrite([(m.start(), m.end(), "") for m in _HIDDEN.finditer(t.text)])


def _signs(t: Mapped) -> None:
    found = []
    for m in _DISGUISED.finditer(t.text):
        if m["far"] is None and m["near"] is None:
            continue
        if not _BRACKET.search(m[0]) and m[0].rpartition(" ")[2].lower() not in _TOP_LEVEL:
            continue  # plain words: "look at the dot on the map" is no address
        for p in _DISGUISE_PART.finditer(t.text, m.start(), m.end()):
            found.append((p.start(), p.end(), "@" if p["at"] else "."))
    t.rewrite(found)


def _digits(t: Mapped) -> None:
    found = []
    for m in _RUN.finditer(t.text):
        parts = list(_RUN_PART.finditer(t.text, m.start(), m.end()))
        at = m.start()
        for p in parts:
            word = p[0].lower()
            found.append((at, p.end(), "+" if word in ("plus", "más") else _SPELLED.get(word, word)))
            at = p.end()
    t.rewrite(found)
    found = []
    for m in _SHORT_RUN.finditer(t.text):
        at = m.start()
        for p in _RUN_PART.finditer(t.text, m.start(), m.end()):
            found.append((at, p.end(), _SPELLED[p[0].lower()]))
            at = p.end()
    t.rewrite(found)


def _addresses(t: Mapped) -> None:
    found = []
    for m in _IP_DISGUISED.finditer(t.text):
        for p in _IP_PART.finditer(t.text, m.start(), m.end()):
            found.append((p.start(), p.end(), "." if p["dot"] else _SPELLED[p["word"].lower()] if p["word"] else ""))
    t.rewrite(found)


def _changed(text: str, t: Mapped, kinds: tuple = KINDS) -> list[tuple[str, int, int]]:
    """Spans of the rewritten text at source offsets, where rewriting took part in them."""
    out = []
    for kind, a, b in detect(t.text):
        start, end = int(t.starts[a]), int(t.ends[b - 1])
        if kind in kinds and text[start:end] != t.text[a:b]:
            out.append((kind, start, end))
    return out


def _apart(spans: list[tuple[str, int, int]], others: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans that overlap none of the others."""
    if not others:
        return spans
    others = sorted((a, b) for _, a, b in others)
    starts, reach = [a for a, _ in others], list(accumulate((b for _, b in others), max))
    free = lambda a, b: not (k := bisect_left(starts, b)) or reach[k - 1] <= a
    return [s for s in spans if free(s[1], s[2])]


def _wider(spans: list[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans that overlap no base span, or hold those that they overlap whole, all of their own kind."""
    if not spans or not base:
        return spans
    others = sorted((a, b, kind) for kind, a, b in base)
    starts, reach, out = [a for a, _, _ in others], list(accumulate((b for _, b, _ in others), max)), []
    for kind, a, b in spans:
        k, fits, inside = bisect_left(starts, b) - 1, True, False
        while k >= 0 and reach[k] > a and fits:
            x, y, other = others[k]
            if y > a:
                fits, inside = other == kind and a <= x and y <= b, True
            k -= 1
        if fits and not (inside and any((x, y) == (a, b) for x, y, _ in others[max(0, k) :] if x <= a)):
            out.append((kind, a, b))
    return out


def _outer(spans: list[tuple[str, int, int]]) -> dict[str, int]:
    """The number of spans of each kind that no other span of it holds."""
    out, last = dict.fromkeys(KINDS, 0), {}
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b > last.get(kind, -1):
            out[kind] += 1
            last[kind] = b
    return out


def _steps(text: str) -> tuple[list, bool]:
    """The transducers that may find something in a text of plain letters, and whether a disguised address may be there.

    Both come from its words: a spelled digit counts beside another number, a dot word before a number or in an address.
    """
    words = _TOKEN.findall(text.lower())
    known = set(words)
    signs = bool(("[" in text or "(" in text or "{" in text or "<" in text) and _SIGN_HINT.search(text))
    dots = not known.isdisjoint(_DOT_WORDS)
    number = lambda w: w[0].isdigit() or w in _SPELLED
    runs = ips = False
    if dots or not known.isdisjoint(_SPELLED):
        for w, after in zip(words, [*words[1:], "_"], strict=True):
            if w in _SPELLED:
                runs = runs or number(after)
            elif w in _DOT_WORDS:
                ips = ips or number(after)
            elif w[-1].isdigit():
                runs = runs or after in _SPELLED
    steps = [_signs] if signs or (dots and ("@" in text or not known.isdisjoint(_AT_WORDS))) else []
    return [*steps, _digits] if runs else steps, signs or ips or runs


def disguised(text: str) -> list[tuple[str, int, int]]:
    """Spans behind a disguise, at source offsets."""
    plain = Mapped(text)
    odd = not text.isascii() and not _ODD_CHARACTERS.isdisjoint(set(text))
    if odd:
        _plain_letters(plain)
    steps, address = _steps(plain.text)
    out, found = [], []
    if address:
        t = plain.copy()
        _addresses(t)
        found = _changed(text, t, ("ip",))
    if odd or steps:
        for f in steps:
            f(plain)
        out = _changed(text, plain)
    ips = [x for x in out if x[0] == "ip"]
    return [x for x in out if x[0] != "ip"] + _apart(ips, found) + found


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: base ones and those behind a disguise that are apart from them or hold them."""
    if not text:
        return [], []
    base = detect(text)
    more = _wider(disguised(text), base)
    if not more:
        return base, base
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone (spans that no other of their kind holds), base_sha256, spans."""

    def look(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo in range(0, len(texts), 1000):
                rows = [find(t) for t in texts[lo : lo + 1000]]
                counts = [_outer(spans) for _, spans in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, len(rows)),
                        *[pa.array([n[kind] for n in counts], pa.int64()) for kind in KINDS],
                        pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows], pa.string()),
                        pa.array([joined(spans) for _, spans in rows], pa.string()),
                    ],
                    names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
                )

    prepare(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(look, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of the text replaced by its kind in angle brackets; overlapping spans become the first one's."""

    def mask(text):
        out, at = [], 0
        for kind, a, b in sorted(find(text)[1], key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += [text[at:a], f"<{kind}>"]
                at = b
        return "".join(out) + text[at:]

    def work(batches):
        for batch in batches:
            i = batch.schema.get_field_index("text")
            texts = [None if t is None else mask(t) for t in batch.column(i).to_pylist()]
            yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))

    prepare(docs.sparkSession)
    return docs.mapInArrow(work, docs.schema)
