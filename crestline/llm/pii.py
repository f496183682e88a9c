"""Format-preserving pseudonyms for personal data in texts.

Numbers are accepted only where they validate (Luhn for cards, mod 97 for IBANs,
ranges for addresses and social security numbers, the calendar for dates, and for phones an international
prefix or the ranges of the North American plan). Each is
then permuted by a keyed Feistel network within its own format: check digits, spacing and
letter case stay right, and equal values get equal pseudonyms in every document, a day or a phone number
also where it is written in another style. With the key the permutation can be undone.

Defined results: a null text stays null; an empty text stays empty; repeated rows
and equal values give equal results; overlapping finds go to the first kind in KINDS,
then to the leftmost; values may be of any length, at a cost in proportion to it; letters of
all scripts are replaced by others of their own script and case; an empty table gives an empty result; further columns pass through.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from bisect import bisect_left
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame

from crestline.llm.arrow_text import row_spans
from crestline.llm.feistel import ALPHABETS, HEX, HEX_UPPER, Feistel, iban_check, like_days, luhn_digit

SPAN_BYTES = 4_000_000
#: Values up to this length are remembered with their pseudonyms.
REMEMBERED_CHARS = 256


def _ranges(codes: list[int]) -> str:
    """Code points in ascending order as ranges of a character class."""
    out, start = [], 0
    for i in range(1, len(codes) + 1):
        if i == len(codes) or codes[i] != codes[i - 1] + 1:
            out.append(re.escape(chr(codes[start])) + "-" + re.escape(chr(codes[i - 1])))
            start = i
    return "".join(out)


#: Combining marks, which belong to the words of many scripts.
MARKS = _ranges([c for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "M"])

# What the formats look like.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
PATTERNS = {
    "email": rf"(?<![\w{MARKS}.%+-])[\w{MARKS}.%+-]{{1,64}}@[\w{MARKS}-]+(?:\.[\w{MARKS}-]+)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|auth)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?)(?P<secret>[A-Za-z0-9_/+=-]{8,})",
    "hex": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,})(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}(?!\.?\d)",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "date": r"(?<![\d/.-])(?:\d{4}([/.-])\d{2}\1\d{2}|\d{1,2}([/.-])\d{1,2}\2\d{4})(?![\d/-])|(?<!\w)\d{1,2} (?:%s) \d{4}(?!\d)|(?<!\w)(?:%s) \d{1,2}, \d{4}(?!\d)" % ("|".join(MONTHS), "|".join(MONTHS)),
    "phone": r"(?<![\w./-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])|(?<!\w)\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,5}(?!\d)",
}
KINDS = list(PATTERNS)
FINDERS = {k: re.compile(p) for k, p in PATTERNS.items()}
DIGIT = re.compile(r"\d")


def north_american(digits: str) -> bool:
    """Whether ten digits are a number of the North American plan: neither area nor exchange begins with 0 or 1."""
    return len(digits) == 10 and digits[0] > "1" and digits[3] > "1"


def phone_parts(text: str) -> tuple[str, str]:
    """Country code with its plus, and the rest; the code is empty if nothing sets it apart."""
    code = re.match(r"\+1(?=\d{10}\Z)|\+\d{1,3}(?=[ .(-])|", text)[0]
    return code, text[len(code) :]


def good_ssn(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def bare(text: str) -> str:
    return re.sub(r"[ -]", "", text)


def parse_date(text: str) -> tuple[date, str] | None:
    """The day that a text names and the style it is written in; None if it names no day."""

    def day(y, m, d):
        try:
            return date(int(y), int(m), int(d))
        except ValueError:
            return None

    if (m := re.fullmatch(r"(\d{1,2}) (\w+) (\d{4})", text)) and (found := day(m[3], MONTHS.index(m[2]) + 1, m[1])):
        return found, "words" if m[1] == str(found.day) else "words2"
    if (m := re.fullmatch(r"(\w+) (\d{1,2}), (\d{4})", text)) and (found := day(m[3], MONTHS.index(m[1]) + 1, m[2])):
        return found, "month" if m[2] == str(found.day) else "month2"
    if (m := re.fullmatch(r"(\d{4})([/.-])(\d\d)[/.-](\d\d)", text)) and (found := day(m[1], m[3], m[4])):
        return found, f"{m[2]}ymd2"
    if m := re.fullmatch(r"(\d{1,2})([/.-])(\d{1,2})[/.-](\d{4})", text):
        wide = "2" if len(m[1]) == len(m[3]) == 2 else ""
        if found := day(m[4], m[3], m[1]):
            return found, f"{m[2]}dm{wide}"
        if found := day(m[4], m[1], m[3]):
            return found, f"{m[2]}md{wide}"
    return None


def write_date(day: date, style: str) -> str:
    year, number = f"{day.year:04d}", f"{day.day:02d}" if style.endswith("2") else str(day.day)
    if style.startswith("words"):
        return f"{number} {MONTHS[day.month - 1]} {year}"
    if style.startswith("month"):
        return f"{MONTHS[day.month - 1]} {number}, {year}"
    month = f"{day.month:02d}" if style.endswith("2") else str(day.month)
    parts = {"d": number, "m": month, "y": year}
    return style[0].join(parts[c] for c in (style[1:4] if style[1] == "y" else style[1:3] + "y"))


def valid(kind: str, text: str) -> bool:
    """Whether a find is what its form says."""
    if kind == "card":
        digits = bare(text)
        return luhn_digit(digits[:-1]) == digits[-1] and len(set(digits)) > 1
    if kind == "iban":
        x = bare(text)
        return 15 <= len(x) <= 34 and iban_check(x[:2], x[4:]) == x[2:4]
    if kind == "ssn":
        return good_ssn(text)
    if kind == "date":
        return parse_date(text) is not None
    if kind == "phone":
        digits = "".join(DIGIT.findall(text))
        return 8 <= len(digits) <= 15 and digits[0] != "0" if text[0] == "+" else north_american(digits)
    if kind == "secret":
        return bool(DIGIT.search(text))
    return True


def refill(shape: str, letters: str) -> str:
    """Put letters in the place of the letters and digits of shape."""
    rest = iter(letters)
    return "".join(next(rest) if c.isalnum() else c for c in shape)


def pseudonym(cipher: Feistel, kind: str, text: str, back: bool = False) -> str:
    """Another value of the same format; back undoes it."""
    if kind == "card":
        payload = cipher.text("card", bare(text)[:-1], back=back)
        return refill(text, payload + luhn_digit(payload))
    if kind == "iban":
        x = bare(text)
        account = cipher.text(f"iban{x[:2]}", x[4:], back=back)
        return refill(text, x[:2] + iban_check(x[:2], account) + account)
    if kind == "ssn":
        return cipher.text("ssn", text, back=back, good=good_ssn)
    if kind == "ip":
        octets = text.split(".")
        low = {1: 0, 2: 10, 3: 100}
        size = {1: 10, 2: 90, 3: 156}
        new = cipher.digits("ip", [int(o) - low[len(o)] for o in octets], [size[len(o)] for o in octets], back)
        return ".".join(str(v + low[len(o)]) for v, o in zip(new, octets, strict=True))
    if kind == "date":
        day, style = parse_date(text)
        name, days = like_days(day)
        place = cipher.below(f"date{name}", bisect_left(days, day.toordinal()), len(days), back)
        return write_date(date.fromordinal(days[place]), style)
    if kind == "phone":
        code, rest = phone_parts(text)
        # with the code of the North American plan or none, a number is the same ten digits
        home = code in ("", "+1") and len(DIGIT.findall(rest)) == 10
        plan = north_american("".join(DIGIT.findall(rest)))

        def good(new: str) -> bool:
            return north_american("".join(DIGIT.findall(new))) == plan if home else new[0] != "+" or new[1] != "0"

        return code + cipher.text("phone+1" if home else f"phone{code}", rest, back=back, good=good)
    if kind == "email":
        name, dot, top = text.rpartition(".")
        return cipher.text("email", name, back=back) + dot + top
    if kind == "hex" or FINDERS["hex"].fullmatch(text):
        return cipher.text("hex", text, HEX_UPPER if text.isupper() or text.isdigit() else HEX, back=back)
    if kind == "key":
        head = re.match(r"AKIA|gh._|sk-", text)[0]
        return head + cipher.text("key", text[len(head) :], ALPHABETS, back=back)
    return cipher.text("secret", text, ALPHABETS, back=back)


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the accepted finds, from left to right, none overlapping."""
    has_digit, has_at = DIGIT.search(text) is not None, "@" in text
    taken: list[tuple[int, int, str]] = []
    for kind in KINDS:
        if not (has_at if kind == "email" else has_digit):
            continue
        own = []
        for m in FINDERS[kind].finditer(text):
            a, b = m.span("secret") if kind == "secret" else m.span()
            # a word in capitals behind an account number is not part of it
            while kind == "iban" and not valid(kind, text[a:b]) and (space := text.rfind(" ", a, b)) > a + 14:
                b = space
            k = bisect_left(taken, (a,))
            free = (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or taken[k][0] >= b)
            if free and valid(kind, text[a:b]):
                own.append((a, b, kind))
        taken = sorted(taken + own)
    return taken


@functools.cache
def _cipher(key: bytes) -> Feistel:
    return Feistel(key)


@functools.lru_cache(100_000)
def _remembered(key: bytes, kind: str, text: str, back: bool) -> str:
    return pseudonym(_cipher(key), kind, text, back)


def rewrite(text: str, key: bytes) -> tuple[str, list[str]]:
    """The text with pseudonyms, and the kinds of what was replaced in order."""
    out, at, kinds = [], 0, []
    for a, b, kind in spans(text):
        known = b - a <= REMEMBERED_CHARS
        out += [text[at:a], _remembered(key, kind, text[a:b], False) if known else pseudonym(_cipher(key), kind, text[a:b])]
        kinds.append(kind)
        at = b
    return ("".join(out) + text[at:], kinds) if kinds else (text, kinds)


def pseudonymise(docs: DataFrame, key: bytes, *, text_col: str = "text", kinds_col: str = "pii_kinds") -> DataFrame:
    """All columns of docs with text_col rewritten, and kinds_col, an array with the kind of each replaced value."""
    kept = docs.drop(kinds_col)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept.schema.fields)}, `{kinds_col}` array<string>"
    place = kept.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for start, stop in row_spans(batch.column(place), SPAN_BYTES):
                part = batch.slice(start, stop - start)
                done = [(None, []) if t is None else rewrite(t, key) for t in part.column(place).to_pylist()]
                columns = list(part.columns)
                columns[place] = pa.array([x[0] for x in done], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x[1] for x in done], pa.list_(pa.string()))], [*part.schema.names, kinds_col])

    return kept.mapInArrow(run, schema)
