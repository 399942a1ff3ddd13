"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation.

A value is found by its form and checked (checksum, ranges, calendar). Its free parts are read as one number below N, where N is
how many values that format has; the number is permuted below N and written back in the same format. A permutation keeps
different values apart, and as it depends on the key, the kind and the format alone, equal values stay equal in all
documents without any table of values. With the key it can be undone.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Rows worked on together.
SLICE = 256

OUTPUT = "text string, spans array<struct<kind:string,start:int,length:int>>"
_KIND = {"text": pa.string(), "spans": pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))}


class Permutation:
    """A keyed permutation of 0 .. size - 1, different for each size and tweak."""

    def __init__(self, key: bytes, undo: bool = False) -> None:
        self.key, self.undo = hashlib.blake2b(key, digest_size=32).digest(), undo

    def _round(self, tweak: bytes, turn: int, half: int, below: int) -> int:
        data = b"%b\0%d\0%d" % (tweak, turn, half)
        wide = hashlib.blake2b(data, key=self.key, digest_size=max(16, below.bit_length() // 8 + 9)).digest()
        return int.from_bytes(wide, "big") % below

    def _turn(self, x: int, a: int, b: int, tweak: bytes) -> int:
        left, right = divmod(x, b)
        for turn in reversed(range(ROUNDS)) if self.undo else range(ROUNDS):
            sign = -1 if self.undo else 1
            if turn % 2:
                right = (right + sign * self._round(tweak, turn, left, b)) % b
            else:
                left = (left + sign * self._round(tweak, turn, right, a)) % a
        return left * b + right

    def __call__(self, x: int, size: int, tweak: bytes) -> int:
        """Where `x` goes. The halves span a little more than `size`; what falls beyond it is permuted again."""
        a = isqrt(size - 1) + 1 if size > 1 else 1
        b = -(-size // a)
        tweak = b"%b\0%d" % (tweak, size)
        while True:
            x = self._turn(x, a, b, tweak)
            if x < size:
                return x


def _mixed(values: list[int], sizes: list[int], permute: Permutation, tweak: bytes) -> list[int]:
    """Permutes a tuple of numbers, each below its size, as one number."""
    x, size = 0, 1
    for v, n in zip(values, sizes, strict=True):
        x, size = x * n + v, size * n
    x, out = permute(x, size, tweak), []
    for n in reversed(sizes):
        x, v = divmod(x, n)
        out.append(v)
    return out[::-1]


def _spread(shape: str, digits: str) -> str:
    """`shape` with its digits replaced in order."""
    found = iter(digits)
    return "".join(next(found) if c in "0123456789" else c for c in shape)


def luhn_digit(body: str) -> str:
    total = sum(int(c) if i % 2 else int(c) * 2 - 9 * (c > "4") for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def card(value: str, permute: Permutation) -> str | None:
    """Payment card numbers: 13 to 19 digits with a right check digit."""
    digits = re.sub(r"\D", "", value)
    if not 13 <= len(digits) <= 19 or len(set(digits)) == 1 or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    body = str(permute(int(digits[:-1]), 10 ** (len(digits) - 1), b"card")).zfill(len(digits) - 1)
    return _spread(value, body + luhn_digit(body))


def phone(value: str, permute: Permutation) -> str | None:
    """Telephone numbers: the country code stays, the 7 to 12 digits after it are permuted."""
    code, rest = re.fullmatch(r"(\+\d{1,3}(?=[ .(-]))?(.*)", value, re.S).groups()
    digits = re.sub(r"\D", "", rest)
    if not 7 <= len(digits) <= 12:
        return None
    return (code or "") + _spread(rest, str(permute(int(digits), 10 ** len(digits), b"phone")).zfill(len(digits)))


#: How many octets have one, two and three digits, and the least of them.
_OCTETS = {1: (10, 0), 2: (90, 10), 3: (156, 100)}


def address(value: str, permute: Permutation) -> str | None:
    """IPv4 addresses: each octet keeps its number of digits."""
    parts = value.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    sizes, least = zip(*(_OCTETS[len(p)] for p in parts), strict=True)
    found = _mixed([int(p) - n for p, n in zip(parts, least, strict=True)], list(sizes), permute, b"ip")
    return ".".join(str(v + n) for v, n in zip(found, least, strict=True))


def social(value: str, permute: Permutation) -> str | None:
    """US social security numbers AAA-GG-SSSS: area 001-665 or 667-899, group and serial not zero."""
    area, group, serial = (int(p) for p in value.split("-"))
    if not 0 < area < 900 or area == 666 or not group or not serial:
        return None
    area, group, serial = _mixed([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], permute, b"ssn")
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _characters(text: str, permute: Permutation, tweak: bytes) -> str:
    """ASCII letters and digits permuted, each within its own kind; anything else stays."""
    kinds = [("0", 10) if c.isdigit() else ("A", 26) if c.isupper() else ("a", 26) for c in re.findall(r"[A-Za-z0-9]", text)]
    values = [ord(c) - ord(k[0]) for c, k in zip(re.findall(r"[A-Za-z0-9]", text), kinds, strict=True)]
    if not values:
        return text
    shape = re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", text)))
    found = iter(_mixed(values, [n for _, n in kinds], permute, tweak + shape.encode()))
    letters = iter(kinds)
    return re.sub(r"[A-Za-z0-9]", lambda _: chr(ord(next(letters)[0]) + next(found)), text)


def _iban_digits(country_last: str) -> int:
    return int("".join(str(int(c, 36)) for c in country_last)) % 97


def iban(value: str, permute: Permutation) -> str | None:
    """International bank account numbers: the country stays, the check digits are worked out anew."""
    plain = value.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_digits(plain[4:] + plain[:4]) != 1:
        return None
    body = _characters(plain[4:], permute, b"iban" + plain[:2].encode())
    found = iter(plain[:2] + f"{98 - _iban_digits(body + plain[:2] + '00'):02d}" + body)
    return "".join(" " if c == " " else next(found) for c in value)


def mail(value: str, permute: Permutation) -> str | None:
    """E-mail addresses: letters and digits before the last dot; the top-level domain stays."""
    name, dot, top = value.rpartition(".")
    return _characters(name, permute, b"mail") + dot + top


_FIRST, _DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days
#: The forms of a date, tried in this order. The last is for days that can only be read so.
_DATES = [("%Y-%m-%d", False), ("%Y/%m/%d", False), ("%d.%m.%Y", False), ("%d/%m/%Y", False), ("%m/%d/%Y", True)]


def date(value: str, permute: Permutation) -> str | None:
    """Dates from 1900 to 2099 with two-digit days and months."""
    for form, late in _DATES:
        try:
            day = datetime.datetime.strptime(value, form).date()
        except ValueError:
            continue
        x = (day - _FIRST).days
        if not 0 <= x < _DAYS:
            return None
        while True:
            x = permute(x, _DAYS, b"late date" if late else b"date")
            day = _FIRST + datetime.timedelta(days=x)
            if not late or day.day > 12:
                return day.strftime(form)
    return None


#: What each form is checked and replaced by, in the order of trying.
_FORMS: list[tuple[str, str, Callable[[str, Permutation], str | None]]] = [
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![A-Za-z0-9])", mail),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])", iban),
    ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", address),
    ("date", r"(?<![\w./-])(?:\d{4}-\d\d-\d\d|\d{4}/\d\d/\d\d|\d\d\.\d\d\.\d{4}|\d\d/\d\d/\d{4})(?![\w]|[./-]\d)", date),
    ("ssn", r"(?<![\w-])\d{3}-\d\d-\d{4}(?![\w]|-\d)", social),
    ("card", r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w]|[.-]\d)", card),
    ("phone", r"(?<![\w.])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?![\w]|[.-]\d)", phone),
    ("phone", r"(?<![\w.])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\w]|[.-]\d)", phone),
]
_ANY = re.compile("|".join(f"(?P<f{i}>{p})" for i, (_, p, _) in enumerate(_FORMS[1:], 1)), re.ASCII)
_EACH = [re.compile(p, re.ASCII) for _, p, _ in _FORMS]
#: Where a value may begin: nothing is looked for in the text between.
_HINT = re.compile(r"(?:[A-Z]{2})?[+(]?\d[\w+(). /@:-]*", re.ASCII)
_BLANK = re.compile(r"[^A-Za-z0-9]")


def _mails(text: str) -> Iterator[tuple[int, int, int]]:
    """Form, start and end of e-mail addresses, looked for around each @."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        found = _EACH[0].search(text, start, min(len(text), at + 256))
        if found and found.start() < at < found.end():
            yield 0, found.start(), found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _checked(text: str, form: int, start: int, end: int, permute: Permutation) -> tuple[int, int, str] | None:
    """Form, end and pseudonym of the valid value that begins at `start`: as matched, in a later form, or cut short at a blank."""
    if new := _FORMS[form][2](text[start:end], permute):
        return form, end, new
    for other in range(form, len(_FORMS)):
        match = _EACH[other].match(text, start)
        cut = match.end() if match else start
        while cut > start:
            if new := _FORMS[other][2](text[start:cut], permute):
                return other, cut, new
            cut = text.rfind(" ", start, cut) if _FORMS[other][0] == "card" else start
    return None


def _values(text: str, start: int, stop: int, permute: Permutation) -> Iterator[tuple[int, int, int, str]]:
    """Form, start, end and pseudonym of valid values between `start` and `stop`, but for e-mail addresses."""
    for hint in _HINT.finditer(text, start, stop):
        place = hint.start()
        while match := _ANY.search(text, place, min(stop, hint.end() + 1)):
            if found := _checked(text, int(match.lastgroup[1:]), *match.span(), permute):
                yield found[0], match.start(), found[1], found[2]
                place = found[1]
            else:
                blank = _BLANK.search(text, match.start() + 1, match.end())
                place = blank.end() if blank else match.end()


def replace(text: str, permute: Permutation) -> tuple[str, list[dict]]:
    """The text with pseudonyms, and where they are."""
    out, marks, at, size = [], [], 0, 0

    def put(form: int, start: int, end: int, new: str) -> None:
        nonlocal at, size
        out.extend([text[at:start], new])
        marks.append({"kind": _FORMS[form][0], "start": size + start - at, "length": len(new)})
        size, at = size + start - at + len(new), end

    begin = 0
    for form, start, end in _mails(text) if "@" in text else ():
        for value in _values(text, begin, start, permute):
            put(*value)
        put(form, start, end, mail(text[start:end], permute))
        begin = end
    for value in _values(text, begin, len(text), permute):
        put(*value)
    return ("".join(out) + text[at:], marks) if marks else (text, [])


def pseudonyms_of(text: Column, key: str, undo: bool = False) -> Column:
    """A struct of text and spans for a column of texts.

    `text` has each valid e-mail address, IBAN, IPv4 address, date, social security number, card number and telephone number
    replaced; spans tells kind, start and length of each in the new text, in characters. Lengths and everything else stay.
    What does not pass its check stays as it is. Null gives null with no spans; an empty text stays empty.
    """

    @F.arrow_udf(OUTPUT)
    def rewrite(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        permute = Permutation(key.encode(), undo)
        for column in columns:
            found = []
            for at in range(0, len(column), SLICE):
                found += [(None, []) if t is None else replace(t, permute) for t in column.slice(at, SLICE).to_pylist()]
            parts = zip(*found, strict=True) if found else [()] * 2
            yield pa.StructArray.from_arrays([pa.array(p, t) for p, t in zip(parts, _KIND.values(), strict=True)], list(_KIND))

    return rewrite(text)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """`docs` with the text replaced as `pseudonyms_of` does; all other columns stay, whatever they are called."""
    done = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), pseudonyms_of(docs[text], key).alias("new"))
    return done.select(*[F.col("new.text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
