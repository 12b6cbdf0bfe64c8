"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation.

Card numbers, phone numbers, social security numbers, bank accounts, network
addresses, dates and mail addresses are found by pattern and validated.  Their
free part is a number below some limit; a Feistel network over two mixed-radix
halves permutes that range under the key, walking on until the result is valid
too.  So a value keeps its format and its check digits, equal values get equal
pseudonyms in every document, different ones different pseudonyms, and the key
undoes it.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from cutover.llm.common import with_columns_by_batch

ROUNDS = 8
#: Dates of these years are permuted among themselves.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)

#: Characters of an IBAN by country, for those written in groups of four.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS", 23: "AE GI IL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT"}
_GROUPED = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in _IBAN_LENGTHS.items())
#: A number of ten digits in groups, with or without +1; +1 and ten digits; another country code and groups of two to five digits.
_PHONE = (
    r"(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+1[0-9]{10}"
    r"|\+(?!1)(?=(?:[ .()-]{0,2}[0-9]){8,15}(?![0-9]))[2-9][0-9]{0,2}(?:[ .-]?(?:\([0-9]{1,5}\)|[0-9]{2,5}))+")

#: The formats.
FORMATS = (
    ("email", r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])"),
    ("iban", rf"(?<![A-Za-z0-9])(?:[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}|{_GROUPED})(?![A-Za-z0-9])"),
    ("date", r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-])"),
    ("ip", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", rf"(?<![0-9(+-])(?:{_PHONE})(?![0-9-])"),
    ("card", r"(?<![0-9.-])(?:[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}-[0-9]{6}-[0-9]{4,5}|[0-9]{4} [0-9]{6} [0-9]{4,5}|[0-9]{13,19})(?![0-9-])"),
)
KINDS = tuple(k for k, _ in FORMATS)
_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in FORMATS))
_MAYBE = re.compile("[0-9@]")

FOUND_DDL = "found array<struct<start:long,stop:long,kind:string>>"


class Permutation:
    """Keyed permutation of 0 .. limit - 1 for any limit, and its inverse."""

    def __init__(self, key: bytes):
        self.key = key

    def _step(self, tweak: str, k: int, half: int, radix: int) -> int:
        size = (radix.bit_length() + 7) // 8 + 8
        out, block = b"", 0
        while len(out) < size:
            out += hashlib.blake2b(f"{tweak}|{k}|{half}|{radix}|{block}".encode(), key=self.key).digest()
            block += 1
        return int.from_bytes(out[:size], "big") % radix

    def _once(self, n: int, a: int, b: int, tweak: str) -> int:
        left, right = divmod(n, b)
        for k in range(0, ROUNDS, 2):
            left = (left + self._step(tweak, k, right, a)) % a
            right = (right + self._step(tweak, k + 1, left, b)) % b
        return left * b + right

    def _back(self, n: int, a: int, b: int, tweak: str) -> int:
        left, right = divmod(n, b)
        for k in range(ROUNDS - 2, -2, -2):
            right = (right - self._step(tweak, k + 1, left, b)) % b
            left = (left - self._step(tweak, k, right, a)) % a
        return left * b + right

    def permute(self, n: int, limit: int, tweak: str, valid: Callable[[int], bool] = lambda n: True, inverse: bool = False) -> int:
        """The pseudonym of a valid ``n``; steps over results that aren't valid, as they form its cycle."""
        b = math.isqrt(max(limit - 1, 0)) + 1
        a = -(-limit // b)
        turn = self._back if inverse else self._once
        while True:
            n = turn(n, a, b, tweak)
            if n < limit and valid(n):
                return n


def luhn_digit(payload: str) -> str:
    """The check digit behind a payload."""
    total = 0
    for k, c in enumerate(reversed(payload)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in shape)


def _alphabet(c: str) -> str:
    for name in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        if c in name:
            return name
    return c


def _by_class(p: Permutation, text: str, tweak: str, inverse: bool) -> str:
    """Permute the letters and digits of a text within their classes; other characters stay."""
    sets = [_alphabet(c) for c in text]
    n, limit = 0, 1
    for c, s in zip(text, sets, strict=True):
        n, limit = n * len(s) + s.index(c), limit * len(s)
    n = p.permute(n, limit, f"{tweak}|{'.'.join(f'{s[0]}{len(s)}' for s in sets)}", inverse=inverse)
    out = []
    for s in reversed(sets):
        n, k = divmod(n, len(s))
        out.append(s[k])
    return "".join(reversed(out))


def _ssn_ok(n: int) -> bool:
    area, group, serial = n // 1_000_000, n // 10_000 % 100, n % 10_000
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _day(value: str) -> tuple[datetime.date, str]:
    """A date and how it is written; with slashes the day comes first unless only the month can."""
    if value[4] == "-":
        return datetime.date.fromisoformat(value), "%Y-%m-%d"
    sep = value[2]
    first, second, year = map(int, value.split(sep))
    if sep == "/" and first <= 12 < second:
        return datetime.date(year, first, second), "%m/%d/%Y"
    return datetime.date(year, second, first), f"%d{sep}%m{sep}%Y"


def pseudonym(p: Permutation, kind: str, value: str, inverse: bool = False) -> str | None:
    """What stands for a value; None if the value isn't valid for its kind."""
    digits = re.sub("[^0-9]", "", value)
    if kind == "email":
        local, _, domain = value.partition("@")
        return f"{_by_class(p, local, 'email', inverse)}@{domain}"
    if kind == "iban":
        country, rest = value[:2], value[4:].replace(" ", "")
        if _iban_check(country, rest) != value[2:4]:
            return None
        new = _by_class(p, rest, f"iban|{country}", inverse)
        new = iter(country + _iban_check(country, new) + new)
        return "".join(c if c == " " else next(new) for c in value)
    if kind == "date":
        try:
            day, shape = _day(value)
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        base = FIRST_DAY.toordinal()
        # days above 12 stay above 12, so a pseudonym is read in the order of its original
        late = lambda n: (datetime.date.fromordinal(base + n).day > 12) == (day.day > 12)
        n = p.permute(day.toordinal() - base, LAST_DAY.toordinal() - base + 1, "date", late, inverse)
        return datetime.date.fromordinal(base + n).strftime(shape)
    if kind == "ip":
        parts = value.split(".")
        if any(int(x) > 255 or str(int(x)) != x for x in parts):
            return None
        n = p.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip", inverse=inverse)
        return ".".join(map(str, n.to_bytes(4, "big")))
    if kind == "ssn":
        return _refill(value, f"{p.permute(int(digits), 10**9, 'ssn', _ssn_ok, inverse):09d}") if _ssn_ok(int(digits)) else None
    if kind == "phone":
        home = value[0] != "+" or digits[0] == "1"
        at = len(digits) - 10 if home else 2  # of another country the first two digits stay
        head, own = digits[:at], digits[at:]
        return _refill(value, head + f"{p.permute(int(own), 10 ** len(own), 'phone' if home else f'phone|{head}|{len(own)}', inverse=inverse):0{len(own)}d}")
    if luhn_digit(digits[:-1]) != digits[-1]:
        return None
    free = len(digits) - 2  # the first digit stays, the last one checks
    payload = digits[0] + f"{p.permute(int(digits[1:-1]), 10**free, f'card|{digits[0]}|{free}', inverse=inverse):0{free}d}"
    return _refill(value, payload + luhn_digit(payload))


def replaced(p: Permutation, text: str, inverse: bool = False) -> tuple[str, list[dict]]:
    """The text with pseudonyms, and where in the original what was found."""
    if not _MAYBE.search(text):
        return text, []
    out, found, done = [], [], 0
    for m in _ANY.finditer(text):
        new = pseudonym(p, m.lastgroup, m.group(), inverse)
        if new is not None:
            out += [text[done : m.start()], new]
            done = m.end()
            found.append({"start": m.start(), "stop": m.end(), "kind": m.lastgroup})
    return "".join([*out, text[done:]]), found


def with_pseudonyms(df: DataFrame, key: bytes, text: str = "text", inverse: bool = False) -> DataFrame:
    """Replace ``text`` by its pseudonymised form and append ``found``.

    ``found`` has the spans in the original text, in code points.  Null text
    stays null, with nothing found, and so is text without digits or @.  With
    ``inverse`` the same key restores the originals.  The key is a parameter
    and never stored.
    """

    def rows(texts: list) -> list[tuple]:
        p = Permutation(key)
        return [(None, []) if t is None else replaced(p, t, inverse) for t in texts]

    order = df.columns if "found" in (c.lower() for c in df.columns) else [*df.columns, "found"]
    return with_columns_by_batch(df, f"{text} string, {FOUND_DDL}", rows, (text,)).select(*order)
