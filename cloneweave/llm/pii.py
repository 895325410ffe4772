"""Format-preserving pseudonyms for personal numbers, addresses and dates.

Values are found by pattern and validated (check digits, octets, calendar).  A
valid value is ranked within its format, and the rank goes through a keyed
permutation: a Feistel network F of eight rounds with cycle walking, used as
F^-1(F(x) + 1), so that no value is its own pseudonym.  Separators, letter
case and character classes stay, check digits are made anew.  The permutation
depends on key and format only, so equal values get equal pseudonyms in all
documents, however they are punctuated.

Numbers of cards and IBANs are looked for in all stretches of whole groups, as
another number may stand beside them; a known issuer's or country's form goes first.
Of an address the whole registered domain goes, only its public suffix stays.
Days are permuted among those whose day and whose month have as many digits, so
that a date keeps its width and is linked with the same day written otherwise.
Phone numbers need an assigned country code after a plus sign, or the shape of
ten digits in groups of 3, 3 and 4.  Secrets follow a name such as ``token``
and have eight characters or more, with a digit, or else capitals after small
letters, or twenty characters; words such as ``password: required`` stay.

Whoever has the key can undo the pseudonyms, so a key must be given.

Defined results: a null text stays null with no findings; an empty text stays
empty; values that fail validation and all other text stay as they are; columns
``n_found``, ``findings`` and ``_pii`` of the input are replaced; repeated rows
and rows of null id are rows like others; texts and values may have any length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FINDINGS = "array<struct<kind:string,start:int,length:int,replacement:string>>"
LIKELY = r"[0-9]|@|[=:]"
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
# English month names.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
# Lengths of IBANs by country, and beginnings and lengths of cards by issuer.
IBAN_LENGTHS = {c: int(n) for n, some in (x.split(":") for x in (
    "15:NO|16:BE|18:DK FO FI FK GL NL SD|19:MK SI|20:AT BA EE KZ XK LT LU MN|21:HR LV LI CH|22:BH BG CR GE DE IE ME RS GB VA|23:GI IL IQ OM SO TL AE|"
    "24:AD CZ MD PK RO SA SK ES SE TN VG|25:LY PT ST|26:IS TR|27:BI DJ FR GR IT MR MC SM|28:AL AZ BY CY DO GT HU LB NI PL SV|29:BR EG PS QA UA|30:JO KW MU YE|31:MT SC|32:LC|33:RU"
).split("|")) for c in some.split()}
SECOND_LEVEL = {"ac", "co", "com", "edu", "gov", "net", "or", "org"}  # below a country's domain
# Assigned calling codes of countries.
CALLING = re.compile(r"21[12368]|2[2-69]\d|3[578]\d|42[013]|5[09]\d|6[78]\d|69[0-2]|80[08]|8[578]\d|9[67]\d|99[2-68]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|1|7")
ISSUED = re.compile(r"4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]|2[2-7]|35|6[0245])\d{14}|3[47]\d{13}|3[0689]\d{12}|6[2-7]\d{14,17}|5[06-8]\d{12,17}")


@dataclass(frozen=True)
class PiiParams:
    """``key``: up to 64 secret bytes; equal keys give equal pseudonyms."""

    key: bytes
    rounds: int = 8

    def __post_init__(self):
        if not 1 <= len(self.key) <= 64:
            raise ValueError("a key of 1 to 64 bytes is needed")


class Permutation:
    """Keyed permutation of 0..size-1 without fixed points (size > 1)."""

    def __init__(self, key: bytes, label: str, size: int, rounds: int = 8):
        self.size, self.rounds = size, rounds
        self.half = max(1, (max(1, (size - 1).bit_length()) + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.bytes = (self.half + 7) // 8
        self.keys = [hashlib.blake2b(f"{label} {size} {i}".encode(), key=key[:64], digest_size=32).digest() for i in range(rounds)]

    def _f(self, i: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(x.to_bytes(self.bytes, "big"), key=self.keys[i], digest_size=min(64, self.bytes)).digest(), "big") & self.mask

    def _walk(self, x: int, order, ahead: bool) -> int:
        while True:
            left, right = x >> self.half, x & self.mask
            for i in order:
                if ahead:
                    left, right = right, left ^ self._f(i, right)
                else:
                    left, right = right ^ self._f(i, left), left
            x = left << self.half | right
            if x < self.size:
                return x

    def ahead(self, x: int) -> int:
        return self._walk(x, range(self.rounds), True)

    def back(self, x: int) -> int:
        return self._walk(x, range(self.rounds - 1, -1, -1), False)

    def __call__(self, x: int) -> int:
        return self.back((self.ahead(x) + 1) % self.size)

    def undo(self, x: int) -> int:
        return self.back((self.ahead(x) - 1) % self.size)


@lru_cache(maxsize=4096)
def permutation(key: bytes, label: str, size: int, rounds: int) -> Permutation:
    return Permutation(key, label, size, rounds)


CLASSES = ((48, 10), (65, 26), (97, 26))  # first code and count of the digits and the letters


def _base(c: str) -> int:
    return 10 if c.isdigit() else 26


def permuted(text: str, label: str, p: PiiParams, fold: bool = False) -> str:
    """The ASCII letters and digits of ``text`` permuted within their classes; the rest stays.

    The longest values are ranked in pieces of at most 64 characters.
    """
    spots = [i for i, c in enumerate(text) if c.isascii() and c.isalnum()]
    out = list(text)
    for at in range(0, len(spots), 64):
        some = spots[at : at + 64]
        rank, size, shape = 0, 1, ""
        for i in some:
            c = text[i]
            base = _base(c)
            rank = rank * base + (ord(c) - 48 if c.isdigit() else ord(c.lower()) - 97)
            size *= base
            shape += "d" if base == 10 else "a"
        rank = permutation(p.key, f"{label} {shape}", size, p.rounds)(rank)
        for i in reversed(some):
            c = text[i]
            rank, d = divmod(rank, _base(c))
            out[i] = chr(48 + d) if c.isdigit() else chr((65 if c.isupper() else 97) + d)
    return "".join(out)


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _pour(template: str, symbols: str) -> str:
    """The template with its letters and digits replaced in order."""
    it = iter(symbols)
    return "".join(next(it) if c.isascii() and c.isalnum() else c for c in template)


def card(m: re.Match, p: PiiParams) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = permuted(digits[:-1], "card", p)
    return _pour(m[0], body + str(luhn(body)))


def card_parts(m: re.Match) -> list[tuple[int, int]]:
    """Spans of whole digit groups with 13 to 19 digits and a valid check digit, longest first."""
    groups = [(g.start(), g.end()) for g in re.finditer(r"\d+", m[0])]
    digits = re.sub(r"\D", "", m[0])
    at, sums = [0], [[0], [0]]  # digits before each group; sums of check values by the parity of the digits that count once
    for a, b in groups:
        at.append(at[-1] + b - a)
    for i, d in enumerate(map(int, digits)):
        twice = d * 2 - 9 * (d > 4)
        sums[i % 2].append(sums[i % 2][-1] + d)
        sums[1 - i % 2].append(sums[1 - i % 2][-1] + twice)
    out = []
    for i in range(len(groups)):
        for j in range(i, len(groups)):
            n = at[j + 1] - at[i]
            if n > 19:
                break
            of = sums[(at[j + 1] - 1) % 2]
            if n >= 13 and (of[at[j + 1]] - of[at[i]]) % 10 == 0:
                out.append((-n, m.start() + groups[i][0], m.start() + groups[j][1]))
    return [(a, b) for _, a, b in sorted(out)]


def issued_parts(m: re.Match) -> list[tuple[int, int]]:
    """Those that begin as an issuer's cards do and are as long."""
    return [(a, b) for a, b in card_parts(m) if ISSUED.fullmatch(re.sub(r"\D", "", m.string[a:b]))]


def iban(m: re.Match, p: PiiParams) -> str | None:
    value = m[0].replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(value) <= 34 or number(value[4:] + value[:4]) % 97 != 1:
        return None
    body = permuted(value[4:], "iban", p)
    return _pour(m[0], value[:2] + f"{98 - number(body + value[:2] + '00') % 97:02d}" + body)


def iban_parts(m: re.Match) -> list[tuple[int, int]]:
    """Spans from the match's start to ends of its groups, longest first."""
    a, text, n, out = m.start(), m[1], 0, []
    for i, c in enumerate(text):
        n += c != " "
        after = m.string[a + i + 1 : a + i + 2]
        if c != " " and 15 <= n <= 34 and not (after.isascii() and after.isalnum()):
            out.append((a, a + i + 1))
    return out[::-1]


def national_parts(m: re.Match) -> list[tuple[int, int]]:
    """That of the country's length."""
    return [(a, b) for a, b in iban_parts(m) if b - a - m.string.count(" ", a, b) == IBAN_LENGTHS.get(m[1][:2])]


def whole(m: re.Match) -> list[tuple[int, int]]:
    return [m.span()]


def ssn(m: re.Match, p: PiiParams) -> str | None:
    area, group, serial = int(m[1]), int(m[2]), int(m[3])
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    rank = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    rank = permutation(p.key, "ssn", 898 * 99 * 9999, p.rounds)(rank)
    rank, serial = divmod(rank, 9999)
    area, group = divmod(rank, 99)
    area += 1 + (area >= 665)
    return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"


def address(m: re.Match, p: PiiParams) -> str | None:
    octets = [int(x) for x in m[0].split(".")]
    if max(octets) > 255:
        return None
    return ".".join(map(str, permutation(p.key, "ip", 1 << 32, p.rounds)(int.from_bytes(bytes(octets), "big")).to_bytes(4, "big")))


def email(m: re.Match, p: PiiParams) -> str:
    labels = m[2].split(".")
    keep = 2 if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2].lower() in SECOND_LEVEL else 1
    text = m[1] + "@" + ".".join(labels[:-keep])
    return permuted(text, "email", p) + "." + ".".join(labels[-keep:])


def phone(m: re.Match, p: PiiParams) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if len(set(re.sub(r"\D", "", m[2]))) == 1 or len(digits) > 15 or m[1] and not CALLING.fullmatch(re.sub(r"\D", "", m[1])):
        return None
    return (m[1] or "") + permuted(m[2], "phone", p)


def international(m: re.Match, p: PiiParams) -> str | None:
    """The country code stays; 7 to 15 digits in all, that of the longest code first."""
    digits = re.sub(r"\D", "", m[0])
    code = CALLING.match(digits)
    if not code or not 7 <= len(digits) <= 15 or len(set(digits[code.end() :])) == 1:
        return None
    at = [i for i, c in enumerate(m[0]) if c.isdigit()][code.end()]
    return m[0][:at] + permuted(m[0][at:], "phone", p)


def international_parts(m: re.Match) -> list[tuple[int, int]]:
    """Spans from the plus sign to ends of digit groups, longest first."""
    return [(m.start(), m.start() + g.end()) for g in re.finditer(r"\d+", m[0])][::-1]


def secret(m: re.Match, p: PiiParams) -> str | None:
    v = m[2]
    plain = not any(c.isdigit() for c in v)
    if len(v) < 8 or plain and (len(set(v)) < 8 or len(v) < 20 and not re.search("[a-z][A-Z]", v)):
        return None
    return m[1] + permuted(m[2], "secret", p)


@lru_cache(maxsize=4)
def _days(wide_month: bool, wide_day: bool) -> list[int]:
    """The days whose month and day have two digits, or one."""
    every = map(date.fromordinal, range(FIRST_DAY, LAST_DAY + 1))
    return [x.toordinal() for x in every if (x.month > 9) == wide_month and (x.day > 9) == wide_day]


def _day(y: int, m: int, d: int, p: PiiParams) -> date | None:
    try:
        day = date(y, m, d).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    days = _days(m > 9, d > 9)
    return date.fromordinal(days[permutation(p.key, f"date {m > 9} {d > 9}", len(days), p.rounds)(bisect_left(days, day))])


def _like(n: int, old: str) -> str:
    return str(n).zfill(len(old))


def iso_date(m: re.Match, p: PiiParams) -> str | None:
    new = _day(int(m[1]), int(m[3]), int(m[4]), p)
    return new and f"{new.year}{m[2]}{_like(new.month, m[3])}{m[2]}{_like(new.day, m[4])}"


def short_date(m: re.Match, p: PiiParams) -> str | None:
    """Day first; month first where day first is no date."""
    a, b, y = int(m[1]), int(m[3]), int(m[4])
    new = _day(y, b, a, p)
    if new:
        return f"{_like(new.day, m[1])}{m[2]}{_like(new.month, m[3])}{m[2]}{new.year}"
    new = _day(y, a, b, p)
    return new and f"{_like(new.month, m[1])}{m[2]}{_like(new.day, m[3])}{m[2]}{new.year}"


def named_date(m: re.Match, p: PiiParams) -> str | None:
    day, month, year = (m[1], m[2], m[3]) if m[1] else (m[5], m[4], m[6])
    new = _day(int(year), MONTHS.index(month) + 1, int(day), p)
    if not new:
        return None
    name = MONTHS[new.month - 1]
    return f"{_like(new.day, day)} {name} {new.year}" if m[1] else f"{name} {_like(new.day, day)}, {new.year}"


_NAMES = "|".join(MONTHS)
_DIGITS = re.compile(r"(?<![\d.])\d(?:[ -]?\d){12,}+")
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}))")
_ALL = re.compile(r"(?s:.+)")
#: (kind, pattern, pseudonym of a match or None if it isn't valid, spans of a match to try); earlier kinds take a stretch of text first.
KINDS: list[tuple[str, re.Pattern, Callable[[re.Match, PiiParams], str | None], Callable[[re.Match], Iterable[tuple[int, int]]]]] = [
    ("email", re.compile(r"(?<![\w.%+-])([\w.%+-]++)@((?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"), email, whole),
    ("secret", re.compile(r"""((?i:(?:token|password|passwd|secret|api[_-]?key)\b)\s{0,3}[=:]\s{0,3}["']?)([A-Za-z0-9_+/-]+(?:\.+[A-Za-z0-9_+/-]+)*)"""), secret, whole),
    ("iban", _IBAN, iban, national_parts),
    ("iban", _IBAN, iban, iban_parts),
    ("ip", re.compile(r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"), address, whole),
    ("date", re.compile(r"(?<![\d/.-])(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?![\d/-]|\.\d)"), iso_date, whole),
    ("date", re.compile(r"(?<![\d/.-])(\d{1,2})([-/.])(\d{1,2})\2(\d{4})(?![\d/-]|\.\d)"), short_date, whole),
    ("date", re.compile(rf"(?<!\d)(?:(\d{{1,2}}) ({_NAMES}) (\d{{4}})|({_NAMES}) (\d{{1,2}}), (\d{{4}}))(?!\d)"), named_date, whole),
    ("ssn", re.compile(r"(?<![\d-])(\d{3})-(\d{2})-(\d{4})(?![\d-])"), ssn, whole),
    ("card", _DIGITS, card, issued_parts),
    ("card", re.compile(r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)"), card, whole),
    ("phone", re.compile(r"(?<![\w.+])(\+\d{1,3}[ .-]?)?(\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\d-])"), phone, whole),
    ("phone", re.compile(r"(?<![\w.+])\+[1-9]\d{0,14}+(?:[ .-]?\(?\d+\)?)*+"), international, international_parts),
    ("card", _DIGITS, card, card_parts),  # after phones: one in ten of any digits has a valid check digit
]


def _meets(found: list[tuple[int, int, str, str]], a: int, b: int) -> bool:
    at = bisect_left(found, (b,))
    return bool(at) and found[at - 1][1] > a


def pseudonymised(text: str, p: PiiParams) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text with its values replaced, and (kind, start, length, replacement) of each, by place in the original."""
    found: list[tuple[int, int, str, str]] = []  # in order and apart, so a match can meet only the two beside it
    for kind, pattern, pseudonym, parts in KINDS:
        more: list[tuple[int, int, str, str]] = []  # likewise
        for m in pattern.finditer(text):
            for a, b in parts(m):
                if _meets(found, a, b) or _meets(more, a, b):
                    continue
                new = pseudonym(m if (a, b) == m.span() else _ALL.fullmatch(text, a, b), p)
                if new is not None:
                    insort(more, (a, b, kind, new))
        found = sorted(found + more)
    out, at = [], 0
    for a, b, _, new in found:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [(kind, a, b - a, new) for a, b, kind, new in found]


def pseudonymise(documents: DataFrame, params: PiiParams, text_col: str = "text") -> DataFrame:
    """All columns, the text replaced, with n_found and findings beside them.

    Texts without a digit, an at sign, = or : can hold no value; they don't leave the JVM.
    """
    p = params
    documents = documents.drop("n_found", "findings", "_pii")
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("found", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("replacement", T.StringType())])))])
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("replacement", pa.string())])

    @F.arrow_udf(kind)
    def replaced(texts: pa.Array) -> pa.Array:
        new, found = [], []
        for t in texts.to_pylist():
            a, b = (None, []) if t is None else pseudonymised(t, p)
            new.append(a)
            found.append([dict(zip(("kind", "start", "length", "replacement"), x)) for x in b])
        return pa.StructArray.from_arrays([pa.array(new, pa.string()), pa.array(found, pa.list_(item))], names=["text", "found"])

    likely = F.when(F.col(text_col).rlike(LIKELY), F.col(text_col))
    rows = documents.withColumn("_pii", replaced(likely))
    found = F.coalesce(F.col("_pii.found"), F.array().cast(FINDINGS))
    return rows.withColumns({text_col: F.coalesce(F.col("_pii.text"), F.col(text_col)), "n_found": F.size(found), "findings": found}).drop("_pii")
