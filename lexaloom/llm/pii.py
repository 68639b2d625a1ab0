"""Format-preserving pseudonyms for personal data.

Values are found by pattern and validated: card numbers by their check digit,
account numbers by their remainder, dates by the calendar, addresses by their
octets. A valid value is permuted with a keyed Feistel network over exactly the
values of its format: digits stay digits, letters letters of their case, a date
a date, and check digits are made to fit again. Separators stay. A phone number
or an address is replaced by its form alone: numbers that are never given out
(area codes from 0 or 1, reserved octets) are permuted among themselves. The
permutation depends on the key and the format only, so a value has the same
pseudonym in every document and different values have different ones; who has
the key can invert it. The work is one narrow pass.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import batch

ROUNDS = 10


class Feistel:
    """A keyed permutation of the numbers below n * m, as pairs (below n, below m), for each format."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _f(self, tweak: str, k: int, value: int, below: int) -> int:
        made = hashlib.blake2b(f"{tweak}/{k}/{value}".encode(), key=self.key, digest_size=64).digest()
        return int.from_bytes(made, "big") % below

    def pair(self, a: int, b: int, n: int, m: int, tweak: str, back: bool = False) -> tuple[int, int]:
        tweak = f"{tweak}/{n}/{m}"
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if k % 2:
                b = (b + sign * self._f(tweak, k, a, m)) % m
            else:
                a = (a + sign * self._f(tweak, k, b, n)) % n
        return a, b

    def symbols(self, values: list[int], radices: list[int], tweak: str, back: bool = False) -> list[int]:
        """Permute a sequence of symbols, each below its own radix."""
        half = len(values) // 2
        a = b = 0
        n = m = 1
        for v, r in zip(values[:half], radices[:half], strict=True):
            a, n = a * r + v, n * r
        for v, r in zip(values[half:], radices[half:], strict=True):
            b, m = b * r + v, m * r
        a, b = self.pair(a, b, n, m, tweak, back)
        out = []
        for number, own in ((b, radices[half:]), (a, radices[:half])):
            for r in reversed(own):
                number, v = divmod(number, r)
                out.append(v)
        return out[::-1]

    def number(self, value: int, below: int, tweak: str, good: Callable[[int], bool] = lambda v: True, back: bool = False) -> int:
        """Permute the good numbers below a bound: steps that leave them are repeated until they come back."""
        n = m = int(below**0.5) + 1
        while True:
            a, b = self.pair(value // m, value % m, n, m, tweak, back)
            value = a * m + b
            if value < below and good(value):
                return value

    def text(self, value: str, tweak: str, good: Callable[[str], bool] = lambda v: True, back: bool = False) -> str:
        """Permute digits and ASCII letters within their classes; other characters stay."""
        kinds = [("0", 10) if c.isdigit() else ("a", 26) if c.islower() else ("A", 26) if c.isupper() else None for c in value]
        shape = "".join(k[0] if k else c for k, c in zip(kinds, value, strict=True))
        at = [i for i, k in enumerate(kinds) if k]
        radices = [kinds[i][1] for i in at]
        out = list(value)
        while True:
            new = self.symbols([ord(out[i]) - ord(kinds[i][0]) for i in at], radices, f"{tweak}/{shape}", back)
            for i, v in zip(at, new, strict=True):
                out[i] = chr(ord(kinds[i][0]) + v)
            if good("".join(out)):
                return "".join(out)


def luhn(digits: str) -> int:
    """The check digit for the digits before it."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 if k % 2 else 2)
        total += v - 9 if v > 9 else v
    return -total % 10


def _fill(shape: str, digits: str) -> str:
    """shape with its digits replaced, in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def card(f: Feistel, value: str, back: bool) -> str | None:
    digits = re.sub(r"\D", "", value)
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = f.text(digits[:-1], "card", lambda v: v[0] == digits[0] or v[0] in "23456", back) if digits[0] in "23456" else f.text(digits[:-1], "card-other", back=back)
    return _fill(value, body + str(luhn(body)))


def phone(f: Feistel, value: str, back: bool) -> str:
    digits = re.sub(r"\D", "", value)
    if len(digits) == 11 and digits[0] == "1":  # area code and exchange start with 2 to 9, or the number is of the other class
        given = lambda v: v[0] not in "01" and v[3] not in "01"
        if given(digits[1:]):
            return _fill(value, "1" + f.text(digits[1:], "phone-1", given, back))
        return _fill(value, "1" + f.text(digits[1:], "phone-1-other", lambda v: not given(v), back))
    return _fill(value, digits[:2] + f.text(digits[2:], f"phone-{digits[:2]}", back=back))


def ssn(f: Feistel, value: str, back: bool) -> str | None:
    good = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    digits = value.replace("-", "")
    return _fill(value, f.text(digits, "ssn", good, back)) if good(digits) else None


def ipv4(f: Feistel, value: str, back: bool) -> str | None:
    """Addresses of public octets, of each reserved network, and with leading zeros are classes of their own."""
    octets = [int(x) for x in value.split(".")]
    if max(octets) > 255:
        return None
    padded = lambda v: any(len(x) > 1 and x[0] == "0" for x in v.split("."))
    if padded(value):
        return f.text(value, "ipv4-padded", lambda v: padded(v) and max(map(int, v.split("."))) <= 255, back)
    good = lambda v: v >> 24 not in (0, 10, 127) and v >> 24 < 224
    number = int.from_bytes(bytes(octets), "big")
    if good(number):
        new = f.number(number, 1 << 32, "ipv4", good, back)
    elif octets[0] < 224:  # the network's number stays
        new = (octets[0] << 24) + f.number(number & 0xFFFFFF, 1 << 24, f"ipv4-{octets[0]}", back=back)
    else:
        new = (224 << 24) + f.number(number - (224 << 24), 32 << 24, "ipv4-224", back=back)
    return ".".join(map(str, new.to_bytes(4, "big")))


_FIRST, _LAST = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


def day(f: Feistel, value: str, back: bool) -> str | None:
    """Dates as 2024-01-31, 2024/01/31, 31.01.2024 or 01/31/2024, from 1900 to 2099."""
    parts = re.split(r"[-/.]", value)
    order = "ymd" if len(parts[0]) == 4 else "dmy" if "." in value else "mdy"
    at = {k: int(p) for k, p in zip(order, parts, strict=True)}
    try:
        number = date(at["y"], at["m"], at["d"]).toordinal() - _FIRST
    except ValueError:
        return None
    if not 0 <= number <= _LAST - _FIRST:
        return None
    new = date.fromordinal(_FIRST + f.number(number, _LAST - _FIRST + 1, "day", back=back))
    widths = {k: len(p) for k, p in zip(order, parts, strict=True)}
    text = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
    if min(widths.values()) < 2:
        return None
    seps = re.findall(r"[-/.]", value)
    return text[order[0]] + seps[0] + text[order[1]] + seps[1] + text[order[2]]


def _mod97(country: str, checks: str, body: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + checks)) % 97


def iban(f: Feistel, value: str, back: bool) -> str | None:
    plain = value.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain[:2], plain[2:4], plain[4:]) != 1:
        return None
    body = f.text(plain[4:], f"iban-{plain[:2]}", back=back)
    new = iter(f"{plain[:2]}{98 - _mod97(plain[:2], '00', body):02d}{body}")
    return "".join(c if c == " " else next(new) for c in value)


def email(f: Feistel, value: str, back: bool) -> str | None:
    local, _, domain = value.partition("@")
    if not re.search("[A-Za-z0-9]", local):
        return None
    return f"{f.text(local, 'email', back=back)}@{domain}"


def secret(f: Feistel, value: str, back: bool) -> str | None:
    """Access keys and the values of password or token settings; hexadecimal ones stay hexadecimal."""
    if value.startswith("AKIA"):
        alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
        head, body = "AKIA", value[4:]
    elif re.fullmatch("[0-9a-f]+", value):
        alphabet, head, body = "0123456789abcdef", "", value
    else:
        return f.text(value, "secret", back=back)
    new = f.symbols([alphabet.index(c) for c in body], [len(alphabet)] * len(body), f"secret/{head}/{len(body)}", back)
    return head + "".join(alphabet[v] for v in new)


#: Kinds in order of precedence at one place: name, pattern (a named group ends in the part that is replaced), replacement.
KINDS: list[tuple[str, str, Callable]] = [
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}", email),
    ("secret", r"\bAKIA[0-9A-Z]{16}\b|(?i:(?<=password=)|(?<=token=)|(?<=secret=)|(?<=token = \")|(?<=password = \")|(?<=secret = \")|(?<=api_key=))[0-9A-Za-z]{8,}", secret),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", iban),
    ("ipv4", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)", ipv4),
    ("date", r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d/-]|\.\d)", day),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", ssn),
    ("phone", r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+(?!1[ .(-])\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?![\d.]\d|\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)", phone),
    ("card", r"(?<![\d.-])(?:\d{13,19}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-])", card),
]

_ALL = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern, _ in KINDS), re.ASCII)
_REPLACE = {name: replace for name, _, replace in KINDS}
_HINT = re.compile("[0-9@=]|AKIA")


def pseudonymize(text: str, feistel: Feistel, back: bool = False) -> tuple[str, list[str]]:
    """text with every valid value replaced, and the kinds found, in order. Only lines with a hint of any kind are searched."""
    kinds: list[str] = []

    def one(m: re.Match) -> str:
        name = m.lastgroup
        new = _REPLACE[name](feistel, m[0], back)
        if new is None:
            return m[0]
        kinds.append(name)
        return new

    if not _HINT.search(text):
        return text, kinds
    return "\n".join(_ALL.sub(one, line) if _HINT.search(line) else line for line in text.split("\n")), kinds


_OUT = pa.schema([("doc_id", pa.int64()), ("n_found", pa.int64()), ("kinds", pa.string()), ("changed", pa.bool_()), ("text", pa.string())])


def pseudonymize_documents(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """doc_id, n_found, kinds (sorted, distinct, comma-joined), changed and text of each row.

    A null text stays null with nothing found, as does an empty one. Repeated
    rows are treated each; an empty table gives an empty result. Other columns
    are not read. back=True inverts the pseudonyms with the same key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feistel = Feistel(key)
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [(t, []) if t is None else pseudonymize(t, feistel, back) for t in texts]
            yield batch(
                _OUT, b.column(0), [len(k) for _, k in found], [",".join(sorted(set(k))) for _, k in found],
                [t != old for (t, _), old in zip(found, texts, strict=True)], [t for t, _ in found],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_found long, kinds string, changed boolean, text string"
    )
