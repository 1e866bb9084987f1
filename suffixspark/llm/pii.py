"""Personal data in text, disguised or not, with source offsets.

The base detectors run on the text as it is. A transducer then rewrites disguises: look-alike characters,
compatibility forms and digits of other scripts, spelled digits, written or bracketed at and dot, zero-width
characters. It keeps, for each piece of its output, the code points it came from. The same detectors run
on its output, and what they find through a rewritten piece is mapped back to source code points and added.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Looked for at the start of a run of digits only, where a match must start: else a long run costs its square.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

# Letters of other scripts that look like Latin ones.
_CYRILLIC = dict(zip("абвгеозкмнпрстухіјѕһԁԛԝӏАВЕЗКМНОРСТУХІЈЅ", "a6breo3kmhnpctyxijshdqwlABE3KMHOPCTYXIJS", strict=True))
_GREEK = dict(zip("αεικνορτυχωΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeikvoptuxwABEZHIKMNOPTYX", strict=True))
_ARMENIAN = dict(zip("օսհոռցզՏՕԼՍ", "ouhnngqSOLU", strict=True))
_OTHERS = {"ı": "i", "ȷ": "j"}
_SIGNS = {"。": ".", "․": ".", "‧": ".", "∙": ".", "⋅": ".", "·": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-"}
_SPACES = "              　"
_GONE = "­​‌‍⁠﻿"
# Digits in words.
_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_AT_WORDS, _DOT_WORDS, _PLUS_WORDS = ("at", "ät", "arroba", "arobase", "klammeraffe", "chiocciola", "apenstaartje"), ("dot", "punkt", "punto", "point", "ponto", "period"), ("plus", "más", "mas")

_CIRCLED = {"⓪": "0"} | {chr(0x2460 + i): str(i + 1) for i in range(9)}
_TABLE = _CYRILLIC | _GREEK | _ARMENIAN | _OTHERS | _CIRCLED | _SIGNS | {c: " " for c in _SPACES} | {c: "" for c in _GONE}


def _plain(c: str) -> str | None:
    """What an odd character stands for; None if it isn't odd."""
    if c in _TABLE:
        return _TABLE[c]
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.digit(c))
    x = unicodedata.normalize("NFKC", c)
    return x if len(x) == 1 and x.isascii() and x != c and x not in " " and unicodedata.category(c) not in ("No", "Lm") else None


_words = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
#: Unoneun is read as un one un only: with uno neun too, words run together would have 2^n readings.
_digit = rf"(?:(?:double|triple)[\s-]+)?(?:{_words.replace('|uno|', '|uno(?!neun)|')}|[0-9])"
_at, _dot, _plus = "|".join(_AT_WORDS), "|".join(_DOT_WORDS), "|".join(_PLUS_WORDS)
_open, _close = r"[\[({<]", r"[\])}>]"
_name = r"[A-Za-z0-9-]+"
#: White space from its start, or none: tried from each place in it, a long run would cost its square.
_space = r"(?:(?<!\s)\s++)?"
#: Marks around a word from their start, for the same reason; an underscore is a character of words too.
_mark = r"(?<=[^\W_])[_*~]++"
# Common top-level domains.
_TOP_LEVEL = "com org net edu gov info biz io co uk de fr es it nl be ch at eu us ca au jp".split()
#: A dot between white space, before such a domain: elsewhere it ends a sentence.
_spaced_dot = rf"\s+\.\s+(?=(?-i:{'|'.join(_TOP_LEVEL)})(?!\w))"
_starts: dict[str, str] = {}
for _w in sorted({*_DIGIT_WORDS, "double", "triple", *_PLUS_WORDS}):
    _starts[_w[0]] = _starts.get(_w[0], "") + _w[1]
#: What each alternative of _DISGUISE starts with; elsewhere, none is tried.
_start = rf"(?=[\[({{<&_*~@]|(?<!\s)\s++[\[({{<&@.{''.join(sorted({w[0] for w in _AT_WORDS + _DOT_WORDS}))}]|(?<!\w)(?:[0-9]|{'|'.join(f'{c}[{rest}]' for c, rest in _starts.items())}))"
#: Rewritten in ASCII by now. Groups: at sign, dot, run of digit words.
_DISGUISE = re.compile(
    rf"{_start}(?:(?P<at>{_space}{_open}\s*(?:{_at}|@)\s*{_close}\s*|{_space}&(?:\#64|\#x40|commat);\s*|{_mark}(?:{_at})[_*~]++(?=[^\W_])|(?<=\w)\s+(?:{_at})\s+(?={_name}(?:\s*{_open}\s*(?:{_dot}|\.)\s*{_close}\s*|\s+(?:{_dot})\s+|{_spaced_dot}){_name})|(?<=\w)\s+@\s*(?={_name}\s*\.)|(?<=\w)\s*@\s+(?={_name}\s*\.))"
    rf"|(?P<dot>{_space}{_open}\s*(?:{_dot}|\.)\s*{_close}\s*|{_space}&(?:\#46|\#x2e|period);\s*|{_mark}(?:{_dot})[_*~]++(?=[^\W_])|(?<=\w)\s+(?:{_dot})\s+(?=\w)|(?<=\w){_spaced_dot})"
    rf"|(?P<digits>(?<!\w)(?:(?:{_plus})\s+(?={_digit}))?(?:(?:{_digit})(?:\s*+(?:[-,.]\s*+)?+(?={_digit}(?!\w)))?)+(?!\w)))",
    re.IGNORECASE,
)
_DIGIT_TOKEN = re.compile(rf"(?P<plus>{_plus})\s+|(?:(?P<times>double|triple)[\s-]+)?(?P<one>{_words}|[0-9])", re.IGNORECASE)

#: A run of digits that may be an address, or a part of one, keeps its dots.
_FOUR_PARTS, _DOT_DIGIT = re.compile(r"[^.]+(?:\.[^.]+){3}"), re.compile(r"\.[0-9]")


def _any_of(words: list[str]) -> str:
    """A pattern for any of the words, as a tree of their letters."""
    tree: dict[str, list[str]] = {}
    for w in words:
        if w:
            tree.setdefault(w[0], []).append(w[1:])
    found = "|".join(c + _any_of(rest) for c, rest in tree.items())
    return f"(?:{found})?" if found and "" in words else f"(?:{found})" if found else ""


_trigger = _any_of([*_DIGIT_WORDS, "double", "triple", *_PLUS_WORDS])
#: Each match of _DISGUISE that is rewritten has a match of one of these in it, in lower case: the start of a
#: run's first word in letters, a dot word between white space, or an at or dot that is bracketed, marked, written as an entity or spaced.
_HINTS = tuple(
    re.compile(x)
    for x in (
        rf"\b[0-9]*+{_trigger}(?:\b|[0-9]|{_trigger})",
        rf"\s(?:{_dot}|\.)\s",
        rf"{_open}\s*+(?:{_at}|{_dot}|[@.])",
        rf"[_*~](?:{_at}|{_dot})[_*~]",
        r"&(?:#64|#x40|commat|#46|#x2e|period);",
        r"\s@|@\s",
    )
)
#: Characters that may be odd, which need a look one by one: of the Latin letters below U+0300, only some.
_MAYBE_ODD = re.compile(rf"[{''.join(c for c in map(chr, range(0x80, 0x300)) if _plain(c) is not None)}]|[^\x00-\u02ff]")


def _digits(s: str) -> str:
    return _NOT_DIGIT.sub("", s)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base detectors: leftmost, not overlapping in a kind, failing matches dropped."""
    out = []
    if "@" in text:
        last, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > last and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at and (m := _EMAIL.match(text, start)):
                out.append((start, 0, m.end()))
                last = m.end()
            at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(x) <= 3 and int(x) <= 255 for x in (y.lstrip("0") or "0" for y in m.group().split("."))):
                    out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


class Mapped:
    """A rewritten text and where its pieces come from: piece i starts at ``at[i]`` in it and is source[a:e]."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.at: list[int] = []
        self.source: list[tuple[int, int, bool]] = []
        self.size = 0

    def add(self, part: str, a: int, e: int, same: bool) -> None:
        if part:
            self.parts.append(part)
            self.at.append(self.size)
            self.source.append((a, e, same))
            self.size += len(part)

    def text(self) -> str:
        return "".join(self.parts)

    def back(self, a: int, e: int) -> tuple[int, int, bool]:
        """Source start and end of text()[a:e], and whether a rewritten piece is in it."""
        i, j = bisect_right(self.at, a) - 1, bisect_right(self.at, e - 1) - 1
        s, t = self.source[i], self.source[j]
        start = s[0] + (a - self.at[i]) if s[2] else s[0]
        end = t[0] + (e - self.at[j]) if t[2] else t[1]
        # A character that went away between two pieces counts as rewritten.
        changed = any(not self.source[k][2] for k in range(i, j + 1)) or any(self.source[k][1] != self.source[k + 1][0] for k in range(i, j))
        return start, end, changed


def _look_alikes(text: str) -> Mapped | None:
    out, done = Mapped(), 0
    for m in _MAYBE_ODD.finditer(text):
        plain = _plain(m.group())
        if plain is not None:
            out.add(text[done : m.start()], done, m.start(), True)
            out.add(plain, m.start(), m.end(), False)
            done = m.end()
    if not done:
        return None
    out.add(text[done:], done, len(text), True)
    return out


def _may_hold(text: str) -> bool:
    """Whether _DISGUISE may find something to rewrite; ignoring case, it takes a dotted capital and a dotless i for an i."""
    low = text.replace("İ", "i").replace("ı", "i").lower()
    return any(x.search(low) for x in _HINTS)


def _written(text: str, gated: bool = True) -> Mapped | None:
    if gated and not _may_hold(text):
        return None
    out, done = Mapped(), 0
    for m in _DISGUISE.finditer(text):
        if m.lastgroup == "digits":
            run = m.group()
            if run.isdigit() or not any(c.isalpha() for c in run):
                continue
            if done < m.start():
                out.add(text[done : m.start()], done, m.start(), True)
            dotted, before = out.parts and out.parts[-1].endswith(".") or _FOUR_PARTS.fullmatch(run) or _DOT_DIGIT.match(text, m.end()), 0
            for t in _DIGIT_TOKEN.finditer(run):
                a, e = m.start() + t.start(), m.start() + t.end()
                if dotted and "." in run[before : t.start()]:
                    out.add(".", m.start() + before, a, False)
                before = t.end()
                if t["plus"]:
                    out.add("+", a, e, False)
                else:
                    one = _DIGIT_WORDS.get(t["one"].lower(), t["one"])
                    out.add(one * {"double": 2, "triple": 3}.get((t["times"] or "").lower(), 1), a, e, False)
            done = m.start() + len(run)
        else:
            if done < m.start():
                out.add(text[done : m.start()], done, m.start(), True)
            out.add("@" if m.lastgroup == "at" else ".", m.start(), m.end(), False)
            done = m.end()
    if not done:
        return None
    out.add(text[done:], done, len(text), True)
    return out


def disguised(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans found only after rewriting, in source code points, but for those within a base span of their kind."""
    first = None if text.isascii() else _look_alikes(text)
    middle = first.text() if first else text
    second = _written(middle)
    if not first and not second:
        return []
    out = set()
    for start, kind, end in detect(second.text() if second else middle):
        changed = False
        for step in (second, first):
            if step:
                start, end, here = step.back(start, end)
                changed |= here
        if changed and not any(k == kind and a <= start and end <= e for a, k, e in base):
            out.add((start, kind, end))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in spans)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, spans, values = [[], [], [], []], [], [], []
        for text in batch.column("body").to_pylist():
            base = detect(text)
            more = disguised(text, base)
            for k in range(4):
                counts[k].append(sum(x[1] == k for x in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            every = sorted(base + more)
            spans.append(joined(every))
            values.append([text[a:e] for a, _, e in every])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(values, pa.list_(pa.string()))],
            ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "found"],
        )


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and disguised) and found (their
    texts), a row for each of ``docs`` (doc_id, text).

    Null and empty texts have no spans (the digest of nothing, an empty string); repeated rows each get a row; other
    columns are ignored; an empty table gives no rows. Offsets are code points, ends exclusive.
    """
    return docs.select("doc_id", whole_text().alias("body")).mapInArrow(_rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, found array<string>")
