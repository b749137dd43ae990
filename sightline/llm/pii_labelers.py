"""Personal data in one text: fixed patterns, wider candidates, and labelers that vote on each candidate.

Fixed patterns give the base spans.  Candidates are these and everything that looks like a span of its kind;
five labelers vote on each: the exact form, a gazetteer, cue words before, cue words after, and the shape.
A vote is for (+1), against (-1) or none (0); nothing here decides.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

# Kinds with a fixed pattern come first; the others only come from candidates.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "name", "address", "birth", "identity", "secret")
LABELERS = ("form", "gazetteer", "before", "after", "shape")
FEATURES = 1 << 12
FEATURES_PER_SPAN = 10

# The gazetteers and cue words, all lower case.
GIVEN_NAMES = frozenset(
    "james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara "
    "susan jessica sarah karen daniel matthew anthony mark paul steven andrew emma olivia sophia lucas noah liam hans peter "
    "klaus jürgen wolfgang ursula monika petra sabine heike pierre jean michel philippe marie nathalie isabelle sylvie "
    "françois camille josé juan carlos luis miguel antonio carmen ana maría lucía pedro pablo elena".split())
HONORIFICS = frozenset("mr mrs ms miss dr prof herr frau mme monsieur madame señor señora sr sra".split())
STREETS = frozenset("street avenue road lane boulevard drive court square straße strasse weg platz rue calle plaza avenida".split())
SUFFIXES = frozenset(
    "com org net edu gov io co uk de fr es it nl eu ch at be pl se no dk fi pt ie us ca au jp cn in br mx ar info biz".split())
SECRET_WORDS = frozenset("token password passwd pwd secret apikey api_key access_key auth_token private_key".split())
CUES = {
    "email": frozenset("email e-mail mail contact write reach correo courriel".split()),
    "ip": frozenset("ip host server address login logged client from".split()),
    "card": frozenset("card credit visa mastercard amex payment paid karte carte tarjeta".split()),
    "phone": frozenset("phone call tel telephone mobile cell fax telefon téléphone teléfono whatsapp".split()),
    "name": frozenset("name called dear signed by sincerely regards".split()),
    "address": frozenset("address lives living at resident adresse dirección wohnhaft".split()),
    "birth": frozenset("born birth birthday dob geboren né née nacido nacida".split()),
    "identity": frozenset("ssn social passport identity iban account tax national id".split()),
    "secret": SECRET_WORDS,
}
COUNTER_CUES = frozenset("version section page chapter isbn issn price figure table line order item no number step year total".split())
AFTER_CUES = {
    "email": frozenset("email mail".split()), "ip": frozenset("port connected".split()), "card": frozenset("expires exp cvv cvc".split()),
    "phone": frozenset("ext extension".split()), "name": frozenset("said wrote born lives".split()),
    "address": frozenset("apt floor suite".split()), "birth": frozenset("in at".split()), "identity": frozenset("issued".split()),
    "secret": frozenset(),
}
COUNTER_AFTER = frozenset("kg km mb gb usd eur percent px ms".split())

# Fixed patterns.
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Candidates.
_DIGITS = re.compile(r"[0-9]")
_ZONE = re.compile(r"\(?[0-9](?:[ ().:/\-– ]{0,2}[0-9])+")
_NATIONAL_PHONE = re.compile(r"\(?[0-9]{3}\)?[ .\-–]{1,2}[0-9]{3}[ .\-–][0-9]{4}")
_DATE = re.compile(r"[0-9]{1,4}([-/.])[0-9]{1,2}\1[0-9]{2,4}")
_SOCIAL = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_WIDE_EMAIL = re.compile(r"[^\s@<>\"'(),;:]+@[^\s@<>\"'(),;:]+\.[^\W\d_]{2,}")
_SPELT_EMAIL = re.compile(r"[\w.+-]+\s?[\[(]?\s?at\s?[\])]?\s?[\w-]+\s?[\[(]?\s?dot\s?[\])]?\s?[a-z]{2,}\b")
_NAME = re.compile(r"[^\W\d_][^\W\d_]*(?:[ -][^\W\d_]+){0,2}")
_SECRET = re.compile(r"\w+\s{0,3}[:=]\s{0,3}[\"']?([^\s\"']{8,})")
_NUMBERED = re.compile(r"[0-9]{1,5}[a-z]?,?(?: [^\W\d_][\w'-]*){0,3} ?\Z")
_WORD = re.compile(r"[^\W_]+(?:[-_][^\W_]+)*")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int


@dataclass(frozen=True)
class Candidate:
    span: Span
    votes: tuple[int, ...]
    base: bool
    features: bytes  # FEATURES_PER_SPAN hashed numbers of two bytes


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (2 if i % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _is_address(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _emails(text: str) -> Iterator[Span]:
    """As a search for the whole pattern, but from one @ to the next: the run before it and the host after."""
    done, at = 0, text.find("@")
    while at >= 0:
        host = _HOST.match(text, at + 1)
        if host:
            begin = at
            while begin > done and text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-"):
                begin -= 1
            if begin < at:
                yield Span("email", begin, host.end())
                done = host.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind and start: matches that fail their check are dropped, not tried again."""
    found = list(_emails(text))
    if not _DIGITS.search(text):
        return found
    found += [Span("ip", *m.span()) for m in _IP.finditer(text) if _is_address(m.group())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _only_digits(m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(Span("card", *m.span()))
    found += [Span("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_only_digits(m.group())) <= 15]
    return found


@lru_cache(maxsize=1)
def _triggers():
    """Automaton of the words at which a candidate may begin, in the three usual ways to write them."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for role, words in (("name", GIVEN_NAMES | HONORIFICS), ("address", STREETS), ("secret", SECRET_WORDS), ("email", {"dot"})):
        for word in words:
            for form in {word, word.capitalize(), word.upper()}:
                automaton.add_word(form, (role, len(form)))
    automaton.make_automaton()
    return automaton


def _word_at(text: str, start: int, end: int) -> bool:
    return not (start and (text[start - 1].isalnum() or text[start - 1] == "_")) and not (
        end < len(text) and (text[end].isalnum() or text[end] == "_"))


def _triggered(text: str) -> Iterator[Span]:
    for last, (role, length) in _triggers().iter(text):
        start, end = last + 1 - length, last + 1
        if not _word_at(text, start, end):
            continue
        if role == "name" and text[start].isupper():
            word = text[start:end].lower()
            if word in HONORIFICS:
                start = end + (text[end:end + 1] == ".")
                start += text[start:start + 1] == " "
            m = _NAME.match(text, start)
            if m:
                words = [w.group() for w in re.finditer(r"[^ -]+", m.group())]
                upper = next((i for i, w in enumerate(words) if not w[0].isupper()), len(words))
                if upper > (word not in HONORIFICS):
                    stop = start
                    for w in words[:upper]:
                        stop = text.index(w, stop) + len(w)
                    yield Span("name", start, stop)
        elif role == "address":
            m = _NUMBERED.search(text[max(0, start - 60):start])
            if m:
                yield Span("address", max(0, start - 60) + m.start(), end)
        elif role == "secret":
            m = _SECRET.match(text, start)
            if m:
                yield Span("secret", *m.span(1))
        elif role == "email":
            low = max(0, start - 80)
            m = _SPELT_EMAIL.search(text, low, min(len(text), end + 20))
            if m:
                yield Span("email", *m.span())


def wide_spans(text: str) -> Iterator[Span]:
    """Everything that looks like personal data, with repeats and overlaps."""
    yield from _triggered(text)
    at = text.find("@")
    while at >= 0:
        low = max(0, at - 64)
        m = _WIDE_EMAIL.search(text, low, min(len(text), at + 256))
        if m:
            yield Span("email", *m.span())
        at = text.find("@", at + 1)
    if not _DIGITS.search(text):
        return
    for zone in _ZONE.finditer(text):
        if zone.end() - zone.start() < 6:
            continue
        found = zone.group()
        digits = _only_digits(found)
        for kind, pattern in (("phone", _NATIONAL_PHONE), ("birth", _DATE), ("identity", _SOCIAL)):
            for m in pattern.finditer(found):
                start, end = zone.start() + m.start(), zone.start() + m.end()
                if not (text[start - 1:start].isdigit() or text[end:end + 1].isdigit()):
                    yield Span(kind, start, end)
        if 13 <= len(digits) <= 19:
            yield Span("card", zone.start() + found.startswith("("), zone.end())
    for m in _IBAN.finditer(text):
        yield Span("identity", *m.span())


def _iban(value: str) -> bool:
    value = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _form(kind: str, value: str, base: bool) -> int:
    """The exact form, checksums included."""
    digits = _only_digits(value)
    checks: dict[str, Callable[[], bool]] = {
        "card": lambda: luhn(digits), "phone": lambda: digits[:1] not in "01" or len(digits) > 10,
        "identity": lambda: _iban(value) if value[0].isalpha() else digits[:3] not in ("000", "666") and digits[0] != "9",
        "birth": lambda: _plausible_date(value),
    }
    if base or kind == "secret" and re.fullmatch(r"[0-9a-fA-F]{16,}|[A-Za-z0-9+/=_-]{20,}", value):
        return 1
    if kind not in checks:
        return 0
    return 1 if checks[kind]() else -1


def _plausible_date(value: str) -> bool:
    parts = [int(p) for p in re.findall("[0-9]+", value)]
    year = next((p for p in parts if p > 31), None)
    rest = [p for p in parts if p != year]
    return year is not None and 1900 <= (year if year > 99 else 1900 + year) <= 2025 and len(rest) == 2 and min(rest) >= 1 and min(rest) <= 12 and max(rest) <= 31


def _gazetteer(kind: str, value: str) -> int:
    if kind == "email":
        return 1 if re.split(r"\W|dot", value.lower())[-1].strip() in SUFFIXES else -1
    if kind == "name":
        first = re.split(r"[ -]", value)[0].lower()
        return 1 if first in GIVEN_NAMES else 0
    if kind == "address":
        return 1 if re.search(r"[A-Z]", value) else 0
    if kind == "secret":
        return -1 if value.lower() in SECRET_WORDS else 0
    return 0


def _shape(kind: str, value: str) -> int:
    """Random-looking values are for, filler (one or two characters, plain runs) is against."""
    plain = re.sub(r"[\W_]", "", value)
    kinds = len(set(plain))
    if kind in ("name", "address"):
        return -1 if value.isupper() else 0
    if kinds <= 2 or plain in "01234567890123456789":
        return -1
    if kind == "secret":
        return 1 if kinds >= 8 and any(c.isdigit() for c in plain) and any(c.isalpha() for c in plain) else -1
    return 1 if kinds >= 5 else 0


def _normal(word: str) -> str:
    return re.sub("[0-9]", "0", word.lower())


def _around(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """Up to five words before (nearest last) and three after; words cut by the window's edge are left out."""
    low, high = max(0, start - 60), min(len(text), end + 40)
    before = [_normal(m.group()) for m in _WORD.finditer(text, low, start) if not low or m.start() > low]
    after = [_normal(m.group()) for m in _WORD.finditer(text, end, high) if high == len(text) or m.end() < high]
    return before[-5:], after[:3]


def _features(kind: str, value: str, form: int, before: list[str], after: list[str], left: str, right: str) -> bytes:
    shape = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]+", lambda m: f"9{min(len(m.group()), 20)}", value[:80])))
    named = (
        "", "shape=" + shape, "length=" + str(min(len(value), 40) // 2), "distinct=" + str(min(len(set(value)), 20) // 2),
        "before=" + (before[-1] if before else ""), "before2=" + (before[-2] if len(before) > 1 else ""),
        "after=" + (after[0] if after else ""), "left=" + left, "right=" + right, f"form={form}")
    return b"".join((zlib.crc32(f"{kind}:{n}".encode()) % FEATURES).to_bytes(2, "little") for n in named)


def candidates(text: str, base: list[Span]) -> list[Candidate]:
    """Base spans and wider ones that touch no base span, each once, with votes and features."""
    taken = sorted((s.start, s.end) for s in base)
    reach, longest = [], 0
    for _, end in taken:
        longest = max(longest, end)
        reach.append(longest)
    starts = [s for s, _ in taken]
    wide = {
        s for s in wide_spans(text)
        if s.end > s.start and not ((at := bisect_left(starts, s.end)) and reach[at - 1] > s.start)}
    held = []
    for span, is_base in [*[(s, True) for s in base], *[(s, False) for s in sorted(wide, key=lambda s: (s.start, s.end, s.kind))]]:
        value = text[span.start:span.end]
        before, after = _around(text, span.start, span.end)
        words, next_words = set(before), set(after)
        votes = (
            _form(span.kind, value, is_base), _gazetteer(span.kind, value),
            1 if words & CUES[span.kind] else -1 if words & COUNTER_CUES else 0,
            1 if next_words & AFTER_CUES[span.kind] else -1 if next_words & COUNTER_AFTER else 0,
            _shape(span.kind, value))
        features = _features(span.kind, value, votes[0], before, after, text[span.start - 1:span.start], text[span.end:span.end + 1])
        held.append(Candidate(span, votes, is_base, features))
    return held
