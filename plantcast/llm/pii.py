"""Format-preserving pseudonyms for personal data.

Validated values are replaced by values of the same format: a keyed Feistel network permutes the
domain of the format, and steps again while the result is outside it, so equal values get equal
pseudonyms in every document and different values different ones. Kinds: card numbers (Luhn; the
check digit is computed anew), IBANs (mod 97, likewise), North American phone numbers, US social
security numbers, IPv4 addresses, calendar dates from 1900 to 2099, e-mail addresses (letters and
digits of the local part), and hexadecimal secrets after ``password``, ``token``, ``secret`` or ``key``.
Area codes that start with 0 or 1 count with a country code or parentheses, and stay among themselves.

Defined results: null and empty texts stay as they are with zero counts; values that fail validation
stay; all else in a text stays; repeated rows give repeated results; an empty table gives an empty
table; further columns pass through by name unless they clash with the added count.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import date, timedelta
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROUNDS = 8
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
DAYS = (LAST_DAY - FIRST_DAY).days + 1

NUMBER = re.compile(
    r"(?<![\w.+-])(?:"
    r"(?P<date>\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})"
    r"|(?P<ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})"
    r"|(?P<phone>(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4})"
    r"|(?P<card>\d(?:[ -]?\d){12,18})"
    r")(?!\w|[.-]\d)"
)
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
EMAIL = re.compile(r"(?<![\w.+-])([A-Za-z0-9][A-Za-z0-9._+-]*)(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")
SECRET = re.compile(r"(?i)\b((?:password|passwd|token|secret|api_?key|key)[\"']?\s*[:=]\s*[\"']?)([0-9a-f]{12,})(?![0-9a-z])")
DIGIT = re.compile(r"\d")


class Permuter:
    """Keyed permutations of whole-number domains."""

    def __init__(self, key: bytes) -> None:
        self.key = key
        self.apply = lru_cache(maxsize=65536)(self._apply)

    def _once(self, value: int, half: int, tweak: str) -> int:
        left, right = value >> half, value & ((1 << half) - 1)
        size = (half + 7) // 8
        for k in range(ROUNDS):
            said = f"{tweak}:{half}:{k}:".encode() + right.to_bytes(size, "big")
            out = b"".join(
                hashlib.blake2b(said + bytes([i]), key=self.key, digest_size=64).digest() for i in range((size + 63) // 64)
            )
            left, right = right, left ^ (int.from_bytes(out[:size], "big") & ((1 << half) - 1))
        return (left << half) | right

    def _apply(self, value: int, domain: int, tweak: str) -> int:
        """The value's image in a permutation of range(domain)."""
        half = max(1, ((domain - 1).bit_length() + 1) // 2)
        value = self._once(value, half, tweak)
        while value >= domain:
            value = self._once(value, half, tweak)
        return value

    def digits(self, text: str, tweak: str) -> str:
        return str(self.apply(int(text), 10 ** len(text), f"{tweak}{len(text)}")).zfill(len(text))


def luhn_sum(digits: str) -> int:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total


def _refill(template: str, chars: str) -> str:
    """The letters and digits of ``template`` replaced in order, all else kept."""
    left = iter(chars)
    return "".join(next(left) if c.isalnum() else c for c in template)


def card(text: str, p: Permuter) -> str | None:
    digits = re.sub(r"\D", "", text)
    if luhn_sum(digits) % 10 or len(set(digits)) == 1:
        return None
    body = digits[0] + p.digits(digits[1:-1], f"card{digits[0]}")
    return _refill(text, body + str(-luhn_sum(body + "0") % 10))


def phone(text: str, p: Permuter) -> str | None:
    digits = re.sub(r"\D", "", text)
    country, body = digits[:-10], digits[-10:]
    low = body[0] in "01"
    if low and not country and "(" not in text:
        return None
    new = p.digits(body, "phone")
    while (new[0] in "01") != low:
        new = p.digits(new, "phone")
    return _refill(text, country + new)


def _ssn_valid(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def ssn(text: str, p: Permuter) -> str | None:
    digits = text.replace("-", "")
    if not _ssn_valid(digits):
        return None
    new = p.digits(digits, "ssn")
    while not _ssn_valid(new):
        new = p.digits(new, "ssn")
    return _refill(text, new)


def ip(text: str, p: Permuter) -> str | None:
    parts = text.split(".")
    if any(int(x) > 255 or x != str(int(x)) for x in parts):
        return None
    new = p.apply(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
    return ".".join(map(str, new.to_bytes(4, "big")))


def day(text: str, p: Permuter) -> str | None:
    """ISO dates, day.month.year and month/day/year."""
    parts = re.split(r"[-./]", text)
    y, m, d = parts if "-" in text else (parts[2], parts[1], parts[0]) if "." in text else (parts[2], parts[0], parts[1])
    try:
        value = date(int(y), int(m), int(d))
    except ValueError:
        return None
    if not FIRST_DAY <= value <= LAST_DAY:
        return None
    new = FIRST_DAY + timedelta(days=p.apply((value - FIRST_DAY).days, DAYS, "date"))
    return new.strftime("%Y-%m-%d" if "-" in text else "%d.%m.%Y" if "." in text else "%m/%d/%Y")


def _mixed(text: str, p: Permuter, tweak: str) -> str:
    """Letters stay letters of their case and digits stay digits; one number codes them all."""
    value, domain = 0, 1
    for c in text:
        base = 10 if c.isdigit() else 26 if c.isalpha() else 1
        value = value * base + (int(c) if base == 10 else ord(c.lower()) - 97 if base == 26 else 0)
        domain *= base
    value = p.apply(value, domain, f"{tweak}{re.sub('[a-zA-Z]', 'a', DIGIT.sub('0', text))}") if domain > 1 else value
    out = []
    for c in reversed(text):
        base = 10 if c.isdigit() else 26 if c.isalpha() else 1
        value, rest = divmod(value, base)
        out.append(c if base == 1 else str(rest) if base == 10 else chr((65 if c.isupper() else 97) + rest))
    return "".join(reversed(out))


def iban(text: str, p: Permuter) -> str | None:
    plain = text.replace(" ", "")

    def rest(s: str) -> int:
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97

    if not 15 <= len(plain) <= 34 or rest(plain) != 1:
        return None
    body = _mixed(plain[4:], p, f"iban{plain[:2]}")
    check = 98 - rest(plain[:2] + "00" + body)
    return _refill(text, f"{plain[:2]}{check:02d}{body}")


def secret(text: str, p: Permuter) -> str:
    new = f"{p.apply(int(text, 16), 16 ** len(text), f'hex{len(text)}'):0{len(text)}x}"
    return new.upper() if text.upper() == text and text.lower() != text else new


NUMBERS = {"date": day, "ip": ip, "ssn": ssn, "phone": phone, "card": card}


def pseudonymise(text: str, p: Permuter) -> tuple[str, int]:
    """The text with its personal data replaced, and how many values were."""
    found = 0

    def use(new: str | None, old: str) -> str:
        nonlocal found
        found += new is not None
        return old if new is None else new

    if "@" in text:
        text = EMAIL.sub(lambda m: use(_mixed(m[1], p, "mail") + m[2], m[0]), text)
    if DIGIT.search(text):
        if ":" in text or "=" in text:
            text = SECRET.sub(lambda m: m[1] + use(secret(m[2], p), m[2]), text)
        text = IBAN.sub(lambda m: use(iban(m[0], p), m[0]), text)
        text = NUMBER.sub(lambda m: use(NUMBERS[m.lastgroup](m[0], p), m[0]), text)
    return text, found


def pseudonymise_documents(documents: DataFrame, key: bytes) -> DataFrame:
    """The documents with pseudonyms in ``text``, and the long ``n_replaced``."""
    columns = [c for c in documents.columns if c != "n_replaced"]
    at = columns.index("text")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Permuter(key)
        for batch in batches:
            done = [(None, 0) if t is None else pseudonymise(t, p) for t in batch.column(at).to_pylist()]
            arrays = list(batch.columns)
            arrays[at] = pa.array([t for t, _ in done], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array([n for _, n in done], pa.int64())], [*columns, "n_replaced"]
            )

    schema = T.StructType([*documents.select(*columns).schema.fields, T.StructField("n_replaced", T.LongType())])
    return documents.select(*columns).mapInArrow(replace, schema)
