"""Personal data by format-preserving pseudonyms.

Validated numbers (payment cards, phone numbers, social security numbers, IBANs, IP addresses) and dates are taken as an integer
in the domain of their format and permuted by a keyed Feistel network with cycle walking; the letters and digits of e-mail
addresses are permuted alike. Equal values get equal pseudonyms in every document, checks and separators hold again, and the key
alone decides the mapping, so no table of values is kept or shuffled.

The key is a secret of the deployment: set `spark.graphloom.pseudonyms.key`, or pass one. The built-in one is for tests.

Defined results: a null text stays null and has no spans; an empty text stays empty; repeated rows are treated alike; other
columns pass through unchanged, except that a column n_chars that held the text's length holds the new one, and that a column called
like the one for spans is replaced by it.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import ship_package

ROUNDS = 8


@dataclass(frozen=True)
class PiiKey:
    key: bytes = b"graphloom pseudonyms"

    @classmethod
    def of(cls, spark: SparkSession) -> PiiKey:
        """The key that the session's settings give, or the built-in one."""
        given = spark.conf.get("spark.graphloom.pseudonyms.key", None)
        return cls(given.encode()) if given else cls()


class Feistel:
    """A keyed permutation of range(size) for any size, one for each tweak."""

    BOUND = 200_000

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.known: dict[tuple[int, int, bytes], int] = {}

    def _round(self, r: int, half: int, bits: int, tweak: bytes) -> int:
        """As many bits as the half has: the first 256 from one hash, further ones from hashes with a counter."""
        data = b"%d:%d:%d:" % (r, bits, half) + tweak
        made = int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big")
        for block in range(1, -(-bits // 256)):
            more = hashlib.blake2b(b"%d;" % block + data, key=self.key, digest_size=32).digest()
            made = made << 256 | int.from_bytes(more, "big")
        return made & ((1 << bits) - 1)

    def permute(self, value: int, size: int, tweak: bytes) -> int:
        if size < 2:
            return value
        if (at := (value, size, tweak)) in self.known:
            return self.known[at]
        bits = max(1, ((size - 1).bit_length() + 1) // 2)
        x = value
        while True:
            left, right = x >> bits, x & ((1 << bits) - 1)
            for r in range(ROUNDS):
                left, right = right, left ^ self._round(r, right, bits, tweak)
            x = left << bits | right
            if x < size:
                break
        if len(self.known) >= self.BOUND:
            self.known.clear()
        self.known[at] = x
        return x

    def invert(self, value: int, size: int, tweak: bytes) -> int:
        if size < 2:
            return value
        bits = max(1, ((size - 1).bit_length() + 1) // 2)
        x = value
        while True:
            left, right = x >> bits, x & ((1 << bits) - 1)
            for r in reversed(range(ROUNDS)):
                left, right = right ^ self._round(r, left, bits, tweak), left
            x = left << bits | right
            if x < size:
                return x


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_check(country: str, bban: str) -> str:
    digits = "".join(str(int(c, 36)) for c in bban + country + "00")
    return f"{98 - int(digits) % 97:02d}"


def _refill(shape: str, digits: str) -> str:
    """The shape with its ASCII digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def card(shape: str, f: Feistel) -> str | None:
    d = _digits(shape)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    n = len(d) - 2
    body = d[0] + f"{f.permute(int(d[1:-1]), 10**n, b'card%d' % n):0{n}d}"
    return _refill(shape, body + luhn_digit(body))


def _other_one(shape: str, rest: str, f: Feistel) -> str:
    """+1 numbers that aren't North American ones, permuted among themselves: 10**10 less those of 8 x 8 digits in two places."""
    x = int(rest)
    while True:
        x = f.permute(x, 10**10, b"phone+1")
        made = f"{x:010d}"
        if made[0] in "01" or made[3] in "01":
            return _refill(shape, "1" + made)


def phone(shape: str, f: Feistel) -> str | None:
    """North American numbers keep +1; others, and +1 with an area code or exchange that can't be, keep the first two digits after the
    plus sign and stay among those of their form."""
    d = _digits(shape)
    if len(d) == 11 and d[0] == "1" or len(d) == 10 and not shape.startswith("+"):
        lead, rest = d[:-10], d[-10:]
        if rest[0] in "01" or rest[3] in "01":
            return _other_one(shape, rest, f) if shape.startswith("+") else None
        size = 8 * 100 * 8 * 1_000_000
        x = ((int(rest[0]) - 2) * 100 + int(rest[1:3])) * 8 + int(rest[3]) - 2
        y = f.permute(x * 1_000_000 + int(rest[4:]), size, b"phone")
        area, tail = divmod(y, 8_000_000)
        return _refill(shape, f"{lead}{area + 200:03d}{tail + 2_000_000:07d}")
    if not shape.startswith("+") or not 8 <= len(d) <= 15:
        return None
    n = len(d) - 2
    return _refill(shape, d[:2] + f"{f.permute(int(d[2:]), 10**n, b'phone%d' % n):0{n}d}")


def social(shape: str, f: Feistel) -> str | None:
    area, group, serial = (int(x) for x in shape.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    slot = area - 1 - (area > 666)
    y = f.permute((slot * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, b"social")
    y, serial = divmod(y, 9999)
    slot, group = divmod(y, 99)
    return f"{slot + 1 + (slot >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def address(shape: str, f: Feistel) -> str | None:
    parts = shape.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    y = f.permute(int.from_bytes(bytes(int(p) for p in parts)), 1 << 32, b"address")
    return ".".join(str(b) for b in y.to_bytes(4))


def iban(shape: str, f: Feistel) -> str | None:
    flat = shape.replace(" ", "")
    country, check, bban = flat[:2], flat[2:4], flat[4:]
    if not 11 <= len(bban) <= 30 or iban_check(country, bban) != check:
        return None
    new = _letters(bban, f, b"iban" + country.encode())
    it = iter(country + iban_check(country, new) + new)
    return "".join(c if c == " " else next(it) for c in shape)


#: Dates are permuted among the days of 1900 to 2099.
DAYS = (datetime.date(2099, 12, 31) - datetime.date(1900, 1, 1)).days + 1


def date(shape: str, f: Feistel) -> str | None:
    """yyyy-mm-dd and yyyy/mm/dd, dd.mm.yyyy and dd/mm/yyyy; mm/dd/yyyy where only that is a date."""
    sep = next(c for c in shape if not c.isdigit())
    parts = [int(x) for x in shape.split(sep)]
    orders = ((0, 1, 2),) if parts[0] > 31 else ((2, 1, 0), (2, 0, 1))
    for order in orders:
        try:
            day = datetime.date(*(parts[i] for i in order))
        except ValueError:
            continue
        if not 1900 <= day.year <= 2099:
            return None
        new = datetime.date(1900, 1, 1) + datetime.timedelta(f.permute((day - datetime.date(1900, 1, 1)).days, DAYS, b"date"))
        fields: list[str] = [""] * 3
        for i, value, width in zip(order, (new.year, new.month, new.day), (4, 2, 2), strict=True):
            fields[i] = f"{value:0{width}d}"
        return sep.join(fields)
    return None


def _letters(text: str, f: Feistel, tweak: bytes) -> str:
    """ASCII letters and digits permuted together, each staying in its class; other characters stay."""
    bases = [(i, 26, ord("a") if c.islower() else ord("A")) if c.isalpha() else (i, 10, ord("0")) for i, c in enumerate(text) if c.isascii() and c.isalnum()]
    value, size = 0, 1
    for i, base, zero in bases:
        value, size = value * base + ord(text[i]) - zero, size * base
    shape = "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in text)
    value = f.permute(value, size, tweak + shape.encode())
    out = list(text)
    for i, base, zero in reversed(bases):
        value, d = divmod(value, base)
        out[i] = chr(zero + d)
    return "".join(out)


def email(shape: str, f: Feistel) -> str | None:
    """The top-level domain stays."""
    head, dot, top = shape.rpartition(".")
    return _letters(head, f, b"email") + dot + top


#: Kinds in order of precedence, each with its pattern and its pseudonym. A match that doesn't validate, or runs into what is
#: already taken, is tried again with shorter ends, and the search goes on one character after its start; the rest is left to later kinds.
KINDS = {
    "email": (re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), email),
    "iban": (re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"), iban),
    "card": (re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"), card),
    "social": (re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), social),
    "address": (re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"), address),
    "date": (re.compile(r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])"), date),
    "phone": (re.compile(r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"), phone),
}
SEPARATED = re.compile(r"[ .()-]")
DIGIT = re.compile(r"[0-9]")
#: Kinds of variable length, whose match may hold more than the value.
SHORTER = ("iban", "card", "phone")


def _found(kind: str, text: str, taken: list[tuple[int, int, str, str]], f: Feistel) -> Iterator[tuple[int, int, str, str]]:
    """The valid values of a kind outside the taken spans, from the left, each as long as can be."""
    pattern, make = KINDS[kind]
    spans = sorted((x, y) for x, y, _, _ in taken)  # apart from each other
    begins = [x for x, _ in spans]
    at = 0
    while m := pattern.search(text, at):
        a, b = m.span()
        at = a + 1
        after = bisect_right(begins, a)
        if after and a < spans[after - 1][1]:
            at = spans[after - 1][1]
            continue
        stop = begins[after] if after < len(begins) else len(text)
        ends = [b] if b <= stop else []
        if kind in SHORTER:
            ends += [e for e in range(min(b - 1, stop), a, -1) if e == stop or text[e] in " .-"]
        for e in ends:
            if e < b and not pattern.fullmatch(text, a, e):
                continue
            shape = text[a:e]
            if kind == "phone" and not SEPARATED.search(shape) and not shape.startswith("+"):
                continue
            if (new := make(shape, f)) is not None:
                yield a, e, kind, new
                at = e
                break


def pseudonymise(text: str, f: Feistel) -> tuple[str, list[tuple[str, int, int]]]:
    """The new text, and (kind, start, end) of what was replaced in the old one."""
    has_digit, has_at = DIGIT.search(text) is not None, "@" in text
    if not has_digit and not has_at:
        return text, []
    taken: list[tuple[int, int, str, str]] = []
    for kind in KINDS:
        if has_at if kind == "email" else has_digit:
            taken += list(_found(kind, text, taken, f))
    taken.sort()
    out, at = [], 0
    for a, b, _, new in taken:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [(kind, a, b) for a, b, kind, _ in taken]


def mask(docs: DataFrame, key: PiiKey | None = None, text_col: str = "text", spans_col: str | None = "pii_spans") -> DataFrame:
    """docs with pseudonyms in the text; spans_col gets kind:start:end of the old text, comma-joined."""
    ship_package(docs.sparkSession)
    key = key or PiiKey.of(docs.sparkSession)
    docs = docs.select(*[c for c in docs.columns if c != spans_col])
    fields = list(docs.schema.fields) + ([T.StructField(spans_col, T.StringType())] if spans_col else [])
    at = docs.columns.index(text_col)
    length_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key.key)
        for batch in batches:
            old = batch.column(at).to_pylist()
            done = [pseudonymise(t, f) if t else (t, []) for t in old]
            arrays = list(batch.columns)
            arrays[at] = pa.array([t for t, _ in done], batch.schema.field(at).type)
            if length_at is not None:
                held = batch.column(length_at)
                arrays[length_at] = pa.array([len(new) if t is not None and n == len(t) else n for n, t, (new, _) in zip(held.to_pylist(), old, done, strict=True)], held.type)
            if spans_col:
                arrays.append(pa.array([",".join(f"{k}:{a}:{b}" for k, a, b in s) for _, s in done], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=[x.name for x in fields])

    return docs.mapInArrow(work, T.StructType(fields))
