"""Keyed permutations over rows of digits with mixed radices, and the formats built on them."""

from __future__ import annotations

import functools
import hashlib
import unicodedata
from collections.abc import Callable, Sequence
from datetime import date

import numpy as np

ROUNDS = 10

# Letters that are permuted among themselves. Those of other scripts are grouped by `classes`.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞŒ"]
HEX = ["0123456789abcdef"]
HEX_UPPER = ["0123456789ABCDEF"]


@functools.cache
def classes() -> dict[str, tuple[str, int]]:
    """Alphabet and place of every letter, digit and combining mark that is in none of ALPHABETS: an alphabet
    holds those of one category in a row of 256 code points; what would stand alone is joined by category."""
    rows: dict[tuple, list[str]] = {}
    listed = set("".join(ALPHABETS))
    for code in range(128, 0x110000):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind[0] in "LNM" and c not in listed:
            rows.setdefault((kind, code >> 8), []).append(c)
    joined: dict[tuple, list[str]] = {}
    for (kind, row), letters in rows.items():
        joined.setdefault((kind, row) if len(letters) > 1 else (kind,), []).extend(letters)
    return {c: (a, i) for a in map("".join, joined.values()) for i, c in enumerate(a)}


@functools.lru_cache(64)
def _places(alphabets: tuple[str, ...]) -> dict[str, tuple[str, int]]:
    return {c: (a, i) for a in reversed(alphabets) for i, c in enumerate(a)}


class Feistel:
    """An unbalanced Feistel network: each turn adds, digit by digit, a keyed stream of one half to the other, so
    the work grows in proportion to the digits."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _stream(self, kind: str, turn: int, total: int, other: np.ndarray, n: int) -> np.ndarray:
        seed = hashlib.blake2b(f"{kind}|{total}|{turn}|".encode() + other.tobytes(), key=self.key, digest_size=64).digest()
        return np.frombuffer(hashlib.shake_256(seed).digest(8 * n), "<u8")

    def digits(self, kind: str, values: Sequence[int], radices: Sequence[int], back: bool = False) -> list[int]:
        """Permute a row of digits, each below its own radix."""
        size = np.asarray(radices, np.uint64)
        now = np.asarray(values, np.uint64).copy()
        n, half = len(now), len(now) // 2
        parts = ((slice(0, half), slice(half, n)), (slice(half, n), slice(0, half)))
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            own, other = parts[turn % 2]
            step = self._stream(kind, turn, n, now[other], len(now[own])) % size[own]
            now[own] = (now[own] + (size[own] - step if back else step)) % size[own]
        return now.tolist()

    def below(self, kind: str, value: int, size: int, back: bool = False) -> int:
        """Permute 0..size-1: walk along the cycle of a slightly larger square until inside."""
        side = 1
        while side * side < size:
            side += 1
        while True:
            a, b = self.digits(kind, [value // side, value % side], [side, side], back)
            value = a * side + b
            if value < size:
                return value

    def text(self, kind: str, text: str, alphabets: Sequence[str] = ALPHABETS, back: bool = False, good: Callable[[str], bool] | None = None) -> str:
        """Permute each character within its alphabet, keeping all others; with good, walk along
        the cycle until good holds (it must hold for text itself). Under ALPHABETS, letters of all scripts have one."""
        known, further = _places(tuple(alphabets)), alphabets is ALPHABETS
        while True:
            spots = [(i, *known[c]) for i, c in enumerate(text) if c in known]
            if further and not text.isascii():
                spots += [(i, *classes()[c]) for i, c in enumerate(text) if c > "\x7f" and c not in known and c in classes()]
            new = list(text)
            found = self.digits(kind, [x[2] for x in spots], [len(x[1]) for x in spots], back) if spots else []
            for (i, a, _), v in zip(spots, found, strict=True):
                new[i] = a[v]
            text = "".join(new)
            if good is None or good(text):
                return text


def luhn_digit(payload: str) -> str:
    """The check digit behind a payload of digits."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_check(country: str, account: str) -> str:
    """The two check digits of an account number (ISO 7064 mod 97-10)."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def like_days(day: date) -> tuple[str, list[int]]:
    """A name for the days that every style writes as it writes day, and their ordinals in order: those of the century whose
    month has as many digits and whose number in the month has as many, and is beyond 12 or not."""
    kind = (day.year // 100, (day.day > 9) + (day.day > 12), day.month > 9)
    return "|".join(map(str, kind)), _days(*kind)


@functools.lru_cache(256)
def _days(century: int, number: int, month: bool) -> list[int]:
    start, end = date(max(1, century * 100), 1, 1).toordinal(), date(century * 100 + 99, 12, 31).toordinal()
    days = map(date.fromordinal, range(start, end + 1))
    return [d.toordinal() for d in days if (d.day > 9) + (d.day > 12) == number and (d.month > 9) == month]
