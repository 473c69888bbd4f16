"""Format-preserving pseudonyms for personal data by keyed Feistel permutations.

Values are found by pattern and then validated (Luhn and mod-97 check digits, ranges of dates, addresses and numbers);
what does not pass stays as it is. Where a card or account number is followed by more groups, its part up to the end of a
group may be the value. A valid value is a number in the set of all valid values of its kind; a Feistel
network with a keyed hash permutes that set (walking on until it is inside again), and the result is written in the same
format: separators, digits, letters and case stay where they are, check digits are right again. Equal values have equal
pseudonyms in every document, different ones different; with the key, ``Pseudonyms(key, inverse=True)`` undoes it.

Equal is what has one canonical form, however it is written: phones by country code and national number (without one:
+1), e-mail and account numbers without regard to case, cards and social security numbers by their digits, dates by the
day. Days keep what their layouts show: whether day and month have one digit or two, and whether the day is above 12.
So a pseudonym can be written in every layout, and it is seen from it whether day or month comes first; where both
could (both up to 12, with slashes), it is the month.

Null texts stay null, empty ones empty. Long texts are scanned once. Repeated rows come out alike; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from opsframe.llm.common import ship

ship(__name__)

ROUNDS = 10


class Feistel:
    """A permutation of range(size) for each tweak."""

    def __init__(self, key: bytes, inverse: bool = False):
        self.key, self.inverse = key, inverse

    def _step(self, tweak: bytes, turn: int, value: int, modulus: int) -> int:
        data = tweak + bytes([turn]) + value.to_bytes((value.bit_length() + 7) // 8, "big")
        size = (modulus.bit_length() + 7) // 8 + 16
        out, part = b"", 0
        while len(out) < size:
            out += hashlib.blake2b(data + b"/" + bytes([part]), key=self.key[:64]).digest()
            part += 1
        return int.from_bytes(out[:size], "big") % modulus

    def _once(self, tweak: bytes, value: int, a: int, b: int) -> int:
        left, right = divmod(value, b)  # left in range(a), right in range(b)
        turns = range(ROUNDS)
        for turn in reversed(turns) if self.inverse else turns:
            sign = -1 if self.inverse else 1
            if turn % 2:
                right = (right + sign * self._step(tweak, turn, left, b)) % b
            else:
                left = (left + sign * self._step(tweak, turn, right, a)) % a
        return left * b + right

    def permute(self, kind: str, value: int, size: int) -> int:
        if size < 2:
            return value
        b = 1
        while b * b < size:  # the root, from above
            b <<= 1
        while (b - 1) ** 2 >= size and b > 2:
            step = max(1, (b * b - size) // (2 * b))
            b = max(b - step, 2)
            if b * b < size:
                b += 1
                break
        a = -(-size // b)
        tweak = f"{kind}/{size}/".encode()
        value = self._once(tweak, value, a, b)
        while value >= size:
            value = self._once(tweak, value, a, b)
        return value


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def iban_rest(country: str, body: str) -> int:
    """The check digits of an account number."""
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


# The formats.
MONTH_NAMES = "January February March April May June July August September October November December".split()
MONTHS = f"(?:{'|'.join(MONTH_NAMES)})"
_KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])(?P<email>[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*)@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "iban": r"\b(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?|[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,4})?)\b",
    "secret": r"(?<![A-Za-z0-9])(?P<secret>[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])",
    "named": r"(?<![\w.:/-])(?P<named>(?i:MONTHS) \d{1,2},? \d{4}|\d{1,2}\.? (?i:MONTHS),? \d{4})(?![\w:/-]|\.\d)".replace("MONTHS", MONTHS),
    "date": r"(?<![\d.:/-])(?P<date>\d{4}-\d{2}-\d{2}|\d{1,2}([./])\d{1,2}\2\d{4})(?![\d:/-]|\.\d)",
    "address": r"(?<![\d.])(?<![vV])(?<![vV] )(?<!ersion )(?<!elease )(?P<address>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?![\d]|\.\d)",
    "person": r"(?<![\d-])(?P<person>\d{3}-\d{2}-\d{4})(?![\d-])",
    "spaced": r"(?i:\bssn|\bsocial security(?: number| no\.?)?)\W{0,5}(?P<spaced>\d{3} \d{2} \d{4})(?![\d-])",
    "phone": r"(?<![\w+])(?P<phone>\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "card": r"(?<![\d.-])(?P<card>\d(?:[ -]?\d){12,18})(?!\d|[.-]\d)",
}
# Lengths of account numbers by country.
_IBAN = {
    country: int(n)
    for n, countries in (x.split(":") for x in (
        "15:NO 16:BE 18:DK,FI,FO,GL,NL,SD,FK 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
        "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
        "28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
    ).split())
    for country in countries.split(",")
}
_CARDS = ([4, 4, 4, 4], [4, 6, 5])  # usual groups of digits
_FIRST_YEAR, _LAST_YEAR = 1900, 2099
# Country codes of one and of two digits; all others have three.
_CODES = {*"17", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86".split()}
_CODES |= set("90 91 92 93 94 95 98".split())


def country_code(digits: str) -> str:
    """The country code that an international number begins with."""
    return next((digits[:n] for n in (1, 2) if digits[:n] in _CODES), digits[:3])


def day_class(day: datetime.date) -> tuple[bool, bool, bool]:
    """What a layout may show of a day beyond its value: digits of day and month, and a day that is no month."""
    return day.day < 10, day.day > 12, day.month < 10


@cache
def _classes() -> tuple[dict, dict]:
    """Days by class, and the place of each day in its class."""
    members: dict[tuple, list[datetime.date]] = {}
    places = {}
    for ordinal in range(datetime.date(_FIRST_YEAR, 1, 1).toordinal(), datetime.date(_LAST_YEAR, 12, 31).toordinal() + 1):
        day = datetime.date.fromordinal(ordinal)
        own = members.setdefault(day_class(day), [])
        places[day] = len(own)
        own.append(day)
    return members, places


def candidates(kind: str, text: str) -> list[int]:
    """Lengths of the parts of a match, from its start to the end of a group, that may be the value; the likeliest first.

    A card or account may be followed by what looks like more of it (expiry, check value, a word). The usual groups of a
    card and the length of a country's accounts go first: they are the same in the pseudonym.
    """
    if kind not in ("card", "iban"):
        return [len(text)]
    groups = re.split("[ -]", text)
    ends = [m.start() for m in re.finditer("[ -]|$", text)]
    if kind == "iban":
        sizes = [len(re.sub("[ -]", "", text[:end])) for end in ends]
        likely = [end for end, n in zip(ends, sizes, strict=True) if n == _IBAN.get(text[:2].upper())]
        # In lower case only what is as long as the country's accounts.
        possible = [end for end, n in zip(ends, sizes, strict=True) if 15 <= n <= 34 and text[:2].isupper()]
    else:
        likely = [ends[len(own) - 1] for own in _CARDS if [len(x) for x in groups[: len(own)]] == own]
        possible = [end for end in ends if 13 <= sum(c.isdigit() for c in text[:end]) <= 19]
    return list(dict.fromkeys([*likely, *reversed(possible)]))


class Pseudonyms:
    def __init__(self, key: bytes, inverse: bool = False):
        self.feistel = Feistel(key, inverse)
        self.replace_one = lru_cache(1 << 16)(self._replace_one)
        self.patterns = [(kind, re.compile(pattern)) for kind, pattern in _KINDS.items()]

    def _mixed(self, kind: str, text: str) -> str:
        """Permutes letters among letters and digits among digits, without regard to case, which stays where it is;
        other characters stay."""
        plain = text.lower()
        sets = ["0123456789" if "0" <= c <= "9" else "abcdefghijklmnopqrstuvwxyz" if "a" <= c <= "z" else c for c in plain]
        value, size = 0, 1
        for c, own in zip(plain, sets, strict=True):
            value, size = value * len(own) + own.index(c), size * len(own)
        shape = "".join("d" if len(s) == 10 else s[0] if len(s) == 26 else s for s in sets)
        value = self.feistel.permute(f"{kind}/{shape}", value, size)
        out = []
        for c, own in zip(reversed(text), reversed(sets), strict=True):
            value, place = divmod(value, len(own))
            out.append(own[place].upper() if c.isupper() else own[place])
        return "".join(reversed(out))

    def _digits(self, text: str, digits: str) -> str:
        """``text`` with its digits, from the last one back, replaced by ``digits``."""
        left, out = list(digits), []
        for c in reversed(text):
            out.append(left.pop() if c.isdigit() and left else c)
        return "".join(reversed(out))

    def _replace_one(self, kind: str, text: str) -> str | None:
        """The pseudonym; None if the value is not valid."""
        permute = self.feistel.permute
        digits = re.sub(r"\D", "", text)
        if kind == "email":
            return self._mixed(kind, text)
        if kind == "secret":
            base = "0123456789abcdef" if text == text.lower() else "0123456789ABCDEF"
            if not (re.search("[0-9]", text) and re.search("[A-Fa-f]", text)):
                return None
            value = permute(kind, int(text, 16), 16 ** len(text))
            return "".join(base[int(c, 16)] for c in f"{value:0{len(text)}x}")
        if kind == "iban":
            plain = text.replace(" ", "").upper()
            country, check, body = plain[:2], plain[2:4], plain[4:]
            if not 11 <= len(body) <= 30 or f"{iban_rest(country, body):02d}" != check:
                return None
            body = self._mixed(f"iban/{country}", body)
            new, out = iter(f"{country}{iban_rest(country, body):02d}{body}"), []
            for c in text:
                out.append(c if c == " " else next(new))
            return "".join(out).lower() if text.islower() else "".join(out)
        if kind == "card":
            if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
                return None
            body = f"{permute(kind, int(digits[:-1]), 10 ** (len(digits) - 1)):0{len(digits) - 1}d}"
            return self._digits(text, body + str(luhn(body)))
        if kind == "phone":
            code = country_code(digits) if text.startswith("+") else "1"
            own = digits[len(code) :] if text.startswith("+") else digits
            trunk = text.startswith("+") and re.search(r"\(0\)", text) and own.startswith("0")  # +44 (0)20 is +44 20
            own = own[1:] if trunk else own
            if not 7 <= len(own) <= 14:
                return None
            new = f"{permute(f'phone/{code}', int(own), 10 ** len(own)):0{len(own)}d}"
            return self._digits(text, (code if text.startswith("+") else "") + ("0" if trunk else "") + new)
        if kind in ("person", "spaced"):
            mark = text[3]
            area, group, serial = (int(x) for x in text.split(mark))
            if area in (0, 666) or area >= 900 or not group or not serial:
                return None
            place = area - 1 - (area > 666)
            value = permute("person", (place * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999)
            rest, serial = divmod(value, 9999)
            place, group = divmod(rest, 99)
            return f"{place + 1 + (place >= 665):03d}{mark}{group + 1:02d}{mark}{serial + 1:04d}"
        if kind == "address":
            parts = [int(x) for x in text.split(".")]
            if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
                return None
            value = permute(kind, int.from_bytes(bytes(parts), "big"), 1 << 32)
            return ".".join(map(str, value.to_bytes(4, "big")))
        return self._named_date(text) if kind == "named" else self._date(text)

    def _day(self, year: int, month: int, day: int) -> datetime.date | None:
        """The pseudonym of a day; None if there is no such day."""
        try:
            day = datetime.date(year, month, day)
        except ValueError:
            return None
        if not _FIRST_YEAR <= day.year <= _LAST_YEAR:
            return None
        members, places = _classes()
        own = members[day_class(day)]
        return own[self.feistel.permute(f"date/{day_class(day)}", places[day], len(own))]

    def _named_date(self, text: str) -> str | None:
        name = re.search("[A-Za-z]+", text)[0]
        numbers = [m for m in re.finditer(r"\d+", text)]
        new = self._day(int(numbers[1][0]), [x.lower() for x in MONTH_NAMES].index(name.lower()) + 1, int(numbers[0][0]))
        if new is None:
            return None
        month = MONTH_NAMES[new.month - 1]
        month = month.upper() if name.isupper() else month.lower() if name.islower() else month
        day = f"{new.day:0{len(numbers[0][0])}d}"
        parts = {numbers[0].start(): (numbers[0][0], day), numbers[1].start(): (numbers[1][0], f"{new.year}"), text.index(name): (name, month)}
        out, at = [], 0
        for begin, (old, put) in sorted(parts.items()):
            out += [text[at:begin], put]
            at = begin + len(old)
        return "".join([*out, text[at:]])

    def _date(self, text: str) -> str | None:
        parts = re.split(r"[./-]", text)
        if len(parts[0]) == 4:
            orders = [(0, 1, 2)]
        else:
            orders = [(2, 1, 0)] if "." in text else [(2, 0, 1), (2, 1, 0)]
        for order in orders:
            new = self._day(*(int(parts[k]) for k in order))
            if new is not None:
                values = dict(zip(order, (new.year, new.month, new.day), strict=True))
                return re.search(r"[./-]", text)[0].join(f"{values[k]:0{len(parts[k])}d}" for k in range(3))
        return None

    def text(self, text: str) -> tuple[str, int]:
        """The text with pseudonyms, and how many values were replaced."""
        spans: list[tuple[int, int, str]] = []
        left = text
        with_digits = re.search("[0-9]", text) is not None
        for kind, pattern in self.patterns:
            if "@" not in text if kind == "email" else not with_digits:
                continue
            at = 0
            while m := pattern.search(left, at):
                begin, end = m.span(kind)
                at = m.end()
                for size in candidates(kind, text[begin:end]):
                    new = self.replace_one(kind, text[begin : begin + size])
                    if new is not None:
                        spans.append((begin, begin + size, new))
                        at = at if begin + size == end else begin + size
                        break
                else:
                    # A value may begin behind the first group.
                    if kind in ("card", "iban") and (border := re.search("[ -]", text[begin:end])):
                        at = begin + border.end()
            # What has been found is no part of anything else.
            for begin, end, _ in spans:
                if left[begin] != "\0":
                    left = left[:begin] + "\0" * (end - begin) + left[end:]
        out, at = [], 0
        for begin, end, new in sorted(spans):
            out += [text[at:begin], new]
            at = end
        return "".join([*out, text[at:]]), len(spans)


def pseudonymise(docs: DataFrame, key: bytes, inverse: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text, n_replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonyms(key, inverse)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = [(None, 0) if t is None else own.text(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())],
                    ["doc_id", "text", "n_replaced"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, n_replaced bigint")
