"""Format-preserving Feistel pseudonyms.

Card numbers, IBANs, social security numbers, phone numbers, IPv4 addresses, dates and e-mail addresses are
found in whole texts, validated, and replaced by another value of the same format under a keyed permutation:
punctuation, lengths, check digits and calendar validity are kept.  One key gives one pseudonym to a value
wherever it occurs, and different values of a format never share one.

A date has one pseudonym in all its notations.  It stays on the same side of the 10th, of the 13th and of October,
so that no number gets wider and no month-first date can be read day-first; names of months may change length.  A
North American phone number has one pseudonym with and without +1; other countries' national forms can't be told.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable
from datetime import date, timedelta
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from glyphmeter.llm.shared import map_rows, replaced

#: For tests and examples; a deployment passes its own secret.
KEY = b"glyphmeter example key"
ROUNDS = 8
_FIRST = date(1900, 1, 1).toordinal()
_DAYS = date(2099, 12, 31).toordinal() - _FIRST + 1
#: Texts without any of this hold nothing to replace.
_SP = " \u00a0\u2007\u2009\u202f"
PREFILTER = rf"(?i:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[A-Za-z]*[{_SP}][0-9]|@|[0-9][0-9{_SP}().+/:-]{{4,}}[0-9]|[A-Z]{{2}}[0-9]{{2}}[{_SP}A-Z0-9]{{10}}"

_MONTHS = "January February March April May June July August September October November December".split()
_MONTH = {m[:k].lower(): i + 1 for i, m in enumerate(_MONTHS) for k in (3, len(m))}
_KINDS = {
    kind: re.compile(pattern.replace("MONTHS", "(?i:" + "|".join(f"{m}|{m[:3]}" for m in _MONTHS) + ")").replace("SP", _SP))
    for kind, pattern in {
        "email": r"(?<![\w.+%-])[\w.+%-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
        "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[SP]?[A-Z0-9]{4}){2,7}(?:[SP]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        "iso": r"(?<![\w.-])[0-9]{4}(?P<s1>[-/.])[0-9]{1,2}(?P=s1)[0-9]{1,2}(?!(?!T[0-9]{2}:?[0-9]{2})[\w-]|\.[0-9])",
        "dmy": r"(?<![\w.-])[0-9]{1,2}(?P<s2>[-/.])[0-9]{1,2}(?P=s2)[0-9]{4}(?![\w-]|\.[0-9])",
        "named": r"(?<!\w)[0-9]{1,2}[SP](?:MONTHS)[SP][0-9]{4}(?!\w)|(?<!\w)(?:MONTHS)[SP][0-9]{1,2},[SP][0-9]{4}(?!\w)",
        "ip": r"(?<![\w.-])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w-]|\.[0-9])",
        "phone": r"(?<![\w+])\+[0-9][0-9SP().-]{6,20}[0-9](?![0-9])|(?<![\w+(])\([0-9]{3}\)[SP]?[0-9]{3}[SP-][0-9]{4}(?![\w-])|(?<![\w.+-])[0-9]{3}(?P<s3>[-.])[0-9]{3}(?P=s3)[0-9]{4}(?![\w-]|\.[0-9])",
        "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
        "card": r"(?<![\w.-])[0-9](?:[SP-]?[0-9]){12,18}(?![\w-]|\.[0-9])",
    }.items()
}
_PATTERN = re.compile("|".join(f"(?:{pattern.pattern})" for pattern in _KINDS.values()))
#: Where a shorter reading of a kind may end.
_ENDS = {"iban": re.compile(r"(?![A-Za-z0-9])"), "phone": re.compile(r"(?![0-9])"), "card": re.compile(r"(?!\w|\.[0-9])")}
_IBAN_LENGTHS = """
15 NO 16 BE 18 DK FI FK FO GL NL SD 19 MK SI 20 AT BA EE KZ LT LU MN XK 21 CH HR LI LV 22 BG BH CR DE GB GE IE ME RS VA
23 AE GI IL IQ OM SO TL 24 AD CZ ES MD PK RO SA SE SK TN VG 25 LY PT ST 26 IS TR 27 BI DJ FR GR IT MC MR SM
28 AL AZ BY CY DO GT HN HU LB NI PL SV 29 BR EG PS QA UA 30 JO KW MU YE 31 MT SC 32 LC 33 RU
"""
_IBAN_LENGTH: dict[str, int] = {}
for _word in _IBAN_LENGTHS.split():
    if _word.isdigit():
        _length = int(_word)
    else:
        _IBAN_LENGTH[_word] = _length


class Pseudonyms:
    """The keyed permutations; every method maps a value to one of the same format, one to one."""

    def __init__(self, key: bytes = KEY) -> None:
        self.key = hashlib.sha256(key).digest()
        self.date = lru_cache(1 << 16)(self._date)

    def _round(self, tweak: str, size: int, i: int, half: int) -> int:
        data = f"{tweak}|{size}|{i}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=16).digest(), "big")

    def number(self, value: int, radix: int, length: int, tweak: str) -> int:
        """A permutation of 0 .. radix**length - 1: an alternating Feistel network over both halves of the digits."""
        if length == 1:
            return (value + self._round(tweak, radix, 0, 0)) % radix
        u = length // 2
        a, b = divmod(value, radix ** (length - u))
        m = u
        for i in range(ROUNDS):  # a has m digits, b the others
            a, b = b, (a + self._round(tweak, length * 1000 + radix, i, b)) % radix**m
            m = length - m
        return a * radix ** (length - m) + b  # after an even number of rounds

    def within(self, value: int, radix: int, length: int, tweak: str, valid: Callable[[int], bool]) -> int:
        """The permutation that this one is on the valid values alone: walk on until one is reached."""
        while True:
            value = self.number(value, radix, length, tweak)
            if valid(value):
                return value

    def digits(self, text: str, tweak: str) -> str:
        return str(self.number(int(text), 10, len(text), tweak)).zfill(len(text)) if text else text

    def alike(self, text: str, tweak: str) -> str:
        """Digits among digits, capitals among capitals, small letters among small letters; the rest stays."""
        out = list(text)
        for name, alphabet in (("d", "0123456789"), ("A", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("a", "abcdefghijklmnopqrstuvwxyz")):
            at = [i for i, c in enumerate(text) if c in alphabet]
            if at:
                value = 0
                for i in at:
                    value = value * len(alphabet) + alphabet.index(text[i])
                value = self.number(value, len(alphabet), len(at), f"{tweak}{name}")
                for i in reversed(at):
                    value, k = divmod(value, len(alphabet))
                    out[i] = alphabet[k]
        return "".join(out)

    def card(self, digits: str) -> str:
        head = self.digits(digits[:-1], "card")
        return head + str(-luhn(head + "0") % 10)

    def iban(self, value: str) -> str:
        body = self.alike(value[4:], "iban" + value[:2])
        return value[:2] + f"{98 - _mod97(body + value[:2] + '00'):02d}" + body

    def ssn(self, digits: str) -> str:
        return f"{self.within(int(digits), 10, 9, 'ssn', lambda v: ssn_valid(f'{v:09d}')):09d}"

    def ip(self, octets: list[int]) -> list[int]:
        return list(self.number(int.from_bytes(bytes(octets), "big"), 2, 32, "ip").to_bytes(4, "big"))

    def _date(self, day: date) -> date:
        """Another day with numbers as wide as this one's, and as sure to be no month."""
        days, place = _days_of(_width(day)), day.toordinal() - _FIRST
        at = bisect_left(days, place)
        bits = len(days).bit_length()
        return date.fromordinal(_FIRST + days[self.within(at, 2, bits, f"date{_width(day)}", lambda v: v < len(days))])


def _width(day: date) -> int:
    return (day.day > 9) + (day.day > 12) + 3 * (day.month > 9)


@lru_cache(8)
def _days_of(width: int) -> list[int]:
    """All days of this width, counted from the first."""
    return [k for k in range(_DAYS) if _width(date.fromordinal(_FIRST + k)) == width]


@lru_cache(4)
def _pseudonyms(key: bytes) -> Pseudonyms:
    """One per worker: dates that were met are remembered."""
    return Pseudonyms(key)


def luhn(digits: str) -> int:
    """0 modulo 10 if the last digit is the check digit."""
    odd = [int(c) for c in digits[-1::-2]]
    even = [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
    return (sum(odd) + sum(even)) % 10


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def iban_valid(value: str) -> bool:
    return 15 <= len(value) <= 34 and _mod97(value[4:] + value[:4]) == 1


def ssn_valid(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _day(y: str, m: str | int, d: str) -> date | None:
    try:
        return date(int(y), int(m), int(d)) if 1900 <= int(y) <= 2099 else None
    except ValueError:
        return None


def _refill(shape: str, digits: str) -> str:
    """shape with its digits (and capitals) replaced, one by one."""
    source = iter(digits)
    return "".join(next(source) if c.isalnum() else c for c in shape)


def _pad(old: str, new: int) -> str:
    """Two digits where the old value had two; else as short as it can be."""
    return f"{new:02d}" if len(old) == 2 else str(new)


def pseudonym(kind: str, text: str, p: Pseudonyms) -> str | None:
    """What replaces a text of this kind; None if it isn't valid."""
    digits = re.sub(r"[^0-9]", "", text)
    if kind == "email":
        local, _, host = text.rpartition("@")
        return f"{p.alike(local, 'mail' + host.lower())}@{host}"
    if kind == "iban":
        value = re.sub(f"[{_SP}]", "", text)
        return _refill(text, p.iban(value)) if iban_valid(value) else None
    if kind == "iso":
        y, m, d = re.split(r"[-/.]", text)
        day = _day(y, m, d)
        if day is None:
            return None
        new = p.date(day)
        return text[4].join((f"{new.year}", _pad(m, new.month), _pad(d, new.day)))
    if kind == "dmy":
        a, b, y = re.split(r"[-/.]", text)
        sep = text[len(a)]
        if day := _day(y, b, a):
            new = p.date(day)
            return sep.join((_pad(a, new.day), _pad(b, new.month), f"{new.year}"))
        if day := _day(y, a, b):
            new = p.date(day)
            return sep.join((_pad(a, new.month), _pad(b, new.day), f"{new.year}"))
        return None
    if kind == "named":
        words, seps = re.split(f",?[{_SP}]", text), re.findall(f",?[{_SP}]", text)
        first = words[0].isdigit()
        d, m = (words[0], words[1]) if first else (words[1], words[0])
        day = _day(words[2], _MONTH[m.lower()], d)
        if day is None:
            return None
        new = p.date(day)
        name = _MONTHS[new.month - 1][: 3 if len(m) == 3 and m.lower() != "may" else None]
        name = name.lower() if m.islower() else name.upper() if m.isupper() else name
        return f"{_pad(d, new.day)}{seps[0]}{name}{seps[1]}{new.year}" if first else f"{name}{seps[0]}{_pad(d, new.day)}{seps[1]}{new.year}"
    if kind == "ip":
        octets = [int(x) for x in text.split(".")]
        return ".".join(map(str, p.ip(octets))) if max(octets) < 256 else None
    if kind == "phone":
        if not 7 <= len(digits) <= 15:
            return None
        if text[0] != "+":
            return _refill(text, p.digits(digits, "phone1"))  # as it is with +1
        if digits[0] == "1" and len(digits) == 11:
            code = 1
        else:
            code = len(re.match(r"\+(\d{1,3})?", text)[1] or "") if re.match(rf"\+\d{{1,3}}[{_SP}(.-]", text) else min(2, len(digits) - 6)
        return _refill(text, digits[:code] + p.digits(digits[code:], "phone" + digits[:code]))
    if kind == "ssn":
        return _refill(text, p.ssn(digits)) if ssn_valid(digits) else None
    return _refill(text, p.card(digits)) if luhn(digits) == 0 else None


def _readings(kind: str, text: str, at: int, p: Pseudonyms) -> list[str]:
    """What could be a value of this kind at a position, the best reading first: the longest, unless

    an IBAN has its country's length, or a phone number with a country code has 11 digits after +1, ends at a
    complete number (not inside a date, time or address), has another value right behind it, or closes its brackets.
    """
    first = _KINDS[kind].match(text, at)
    if not first:
        return []
    found = [first[0]]
    if kind in _ENDS:
        ends = (e for e in range(first.end() - 1, at, -1) if _ENDS[kind].match(text, e))
        found += [m[0] for e in ends if (m := _KINDS[kind].fullmatch(text, at, e))]
    if kind == "iban":
        found.sort(key=lambda t: sum(map(str.isalnum, t)) != _IBAN_LENGTH.get(t[:2]))
    if kind == "phone" and len(found) > 1:
        found.sort(key=lambda t: _phone_faults(text, at, t, p))
    return found


def _phone_faults(text: str, at: int, reading: str, p: Pseudonyms) -> tuple[bool, ...]:
    end = at + len(reading)
    behind = re.compile(f"[{_SP},;(]*").match(text, end).end()
    behind -= text[behind - 1] == "(" and behind > end
    followed = behind > end and not text.startswith("+", behind) and value(text, behind, p) is not None
    american = reading[1] == "1" and sum(c.isdigit() for c in reading) == 11
    return (not american, re.compile(r"[./:-][0-9]").match(text, end) is not None, not followed, reading.count("(") != reading.count(")"))


def value(text: str, at: int, p: Pseudonyms) -> tuple[str, int] | None:
    """The pseudonym of the valid value that begins at a position, and where the value ends; None if there is none."""
    for kind in _KINDS:
        for reading in _readings(kind, text, at, p):
            new = pseudonym(kind, reading, p)
            if new is not None:
                return new, at + len(reading)
    return None


def replace(text: str, p: Pseudonyms) -> tuple[str, int]:
    """text with its valid values replaced, and how many.  Where none is valid, the search goes on at the next character."""
    out, kept, at, count = [], 0, 0, 0
    while match := _PATTERN.search(text, at):
        start = match.start()
        found = value(text, start, p)
        if found is None:
            at = start + 1
            continue
        out += text[kept:start], found[0]
        kept = at = found[1]
        count += 1
    return "".join((*out, text[kept:])), count


def pseudonymise(docs: DataFrame, key: bytes = KEY, column: str = "text", count: str | None = "pii_values") -> DataFrame:
    """docs with the values in one text column replaced; `count`, if given, is added: how many were.

    Every other column stays as it is; one that is called like `count` is replaced by it.  A null text stays
    null with count 0, an empty one empty; repeated rows change alike; texts are searched whole, however long; an
    empty table gives no rows.  Where values overlap, the one that begins first counts.  The rows never move: no
    shuffle.
    """
    schema = docs.schema
    if count:
        schema = StructType([f for f in schema if f.name != count] + [StructField(count, LongType())])

    def change(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(column)
        found = pc.fill_null(pc.match_substring_regex(texts, PREFILTER), False)
        p, values, counts = _pseudonyms(key), texts.to_pylist() if pc.any(found).as_py() else None, [0] * batch.num_rows
        if values is not None:
            for i in pc.indices_nonzero(found).to_pylist():
                values[i], counts[i] = replace(values[i], p)
            batch = replaced(batch, column, pa.array(values, pa.string()))
        if not count:
            return batch
        kept = [n for n in batch.schema.names if n != count]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(counts, pa.int64())], [*kept, count])

    return map_rows(docs, change, schema)
