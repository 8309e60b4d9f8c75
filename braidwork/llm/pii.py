"""PII: format-preserving Feistel pseudonyms.

Card numbers, phone numbers, bank accounts, social security numbers, IP addresses, dates, the local
parts of mail addresses and key material are found and validated in whole texts. Each is read as a
number of a mixed-radix domain that its format spans and is permuted within it by a keyed Feistel
network with cycle walking, so a pseudonym is as valid as the original, equal values get equal
pseudonyms in every document, and the holder of the key can turn them back.

Dates are permuted among the dates of their class: whether the day is below 10, up to 12 or beyond, and
whether the month is below 10. So a date written day first, month first, year first, padded or not keeps
that form and its length, and the forms of one date keep belonging together. Names of months are kept as
names. Domains of mail addresses stay as they are. Long tokens are permuted in parts of ``PART`` characters.

The key comes from the session (``SETTING``) or the caller; without one nothing runs.

The permutation is a keyed rotation, decrypt(encrypt(x) + 1): a bijection without fixed points, so no
value stands for itself.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

#: Names the key; Spark hides settings with such a name in its logs and pages.
SETTING = "spark.braidwork.pii.secret"
#: For the synthetic tables of the queries, where the session has no key. Anyone can turn its pseudonyms back.
EXAMPLE_KEY = b"example key for synthetic tables"
PART = 40
ROUNDS = 8
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), 73049  # up to 2099-12-31
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
DIGITS = "0123456789"


class Feistel:
    """Permutations of 0 .. size-1 for any size, keyed, one for each tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key).digest()[:32]

    def _mix(self, tweak: bytes, i: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        data = tweak + bytes([0, i]) + half.to_bytes(size, "little")
        if size <= 16:
            found = hashlib.blake2b(data, key=self.key, digest_size=16).digest()
        else:
            found = hashlib.shake_256(self.key + data).digest(size)
        return int.from_bytes(found, "little") & ((1 << bits) - 1)

    def _walk(self, x: int, size: int, tweak: bytes, rounds: range) -> int:
        bits = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << bits) - 1
        tweak = tweak + size.to_bytes(max(32, bits // 4 + 1), "little")
        while True:
            a, b = x >> bits, x & mask
            for i in rounds:
                if rounds.step > 0:
                    a, b = b, a ^ self._mix(tweak, i, b, bits)
                else:
                    a, b = b ^ self._mix(tweak, i, a, bits), a
            x = a << bits | b
            if x < size:
                return x

    def permute(self, x: int, size: int, tweak: bytes = b"", back: bool = False) -> int:
        """The pseudonym of ``x``, or with ``back`` what a pseudonym stands for; a domain of 1 stays."""
        if size < 2:
            return x
        y = self._walk(x, size, tweak, range(ROUNDS))
        return self._walk((y + (-1 if back else 1)) % size, size, tweak, range(ROUNDS - 1, -1, -1))

    def characters(self, text: str, kind: str, back: bool = False, first: dict[int, str] | None = None) -> str:
        """Letters and digits permuted together, each within its own class; others stay.

        ``first`` gives the alphabet of single positions.
        """
        if len(text) > PART:
            parts = [text[i : i + PART] for i in range(0, len(text), PART)]
            firsts = [{i: a for i, a in ((j - k * PART, a) for j, a in (first or {}).items()) if 0 <= i < PART} for k in range(len(parts))]
            return "".join(self.characters(p, f"{kind}:{k}", back, f) for k, (p, f) in enumerate(zip(parts, firsts)))
        first, value, size, places = first or {}, 0, 1, []
        for i, c in enumerate(text):
            alphabet = first.get(i) or next((a for a in (DIGITS, LOWER, UPPER) if c in a), None)
            if alphabet and len(alphabet) > 1 and c in alphabet:
                places.append((i, alphabet))
                value, size = value * len(alphabet) + alphabet.index(c), size * len(alphabet)
        value = self.permute(value, size, f"{kind}:{len(places)}".encode(), back)
        out = list(text)
        for i, alphabet in reversed(places):
            value, k = divmod(value, len(alphabet))
            out[i] = alphabet[k]
        return "".join(out)


def luhn(digits: str) -> bool:
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def _fill(form: str, characters: str) -> str:
    """``form`` with its letters and digits replaced in order."""
    left = iter(characters)
    return "".join(next(left) if c.isalnum() else c for c in form)


def _bare(text: str) -> str:
    return "".join(c for c in text if c.isalnum())


def _card(f: Feistel, m: re.Match, back: bool) -> str | None:
    digits = _bare(m[0])
    if digits[0] not in "3456" or not 13 <= len(digits) <= 19 or not luhn(digits):
        return None
    payload = f.characters(digits[1:-1], "card" + str(len(digits)) + digits[0], back)
    start = digits[0] + payload
    return _fill(m[0], start + next(d for d in DIGITS if luhn(start + d)))


def _phone(f: Feistel, m: re.Match, back: bool) -> str | None:
    code, rest = m["code"] or "", m["rest"]
    digits, called = _bare(rest), "".join(c for c in code if c.isdigit())
    if not 7 <= len(called) + len(digits) <= 15 or len(digits) < 6:
        return None
    if called == "1" and len(digits) != 10:
        return None
    if len(digits) == 10 and called in ("", "1"):
        if digits[0] not in "23456789" or digits[3] not in "23456789":
            return None
        first = {0: "23456789", 3: "23456789"}
    else:
        first = {}
    return code + _fill(rest, f.characters(digits, "phone" + str(len(digits)), back, first))


def _address(f: Feistel, m: re.Match, back: bool) -> str | None:
    parts = m[0].split(".")
    values = [int(p) for p in parts]
    if max(values) > 255 or any(p != str(v) for p, v in zip(parts, values)) or values[0] in (0, 127, 255):
        return None
    spans = [{1: (0, 10), 2: (10, 100), 3: (100, 256)}[len(p)] for p in parts]
    spans[0] = {1: (1, 10), 2: (10, 100), 3: (100, 255)}[len(parts[0])]
    skip = len(parts[0]) == 3  # 127 is left out
    value, size = 0, 1
    for k, (v, (a, b)) in enumerate(zip(values, spans)):
        width = b - a - (1 if skip and not k else 0)
        value, size = value * width + (v - a - (1 if skip and not k and v > 127 else 0)), size * width
    value = f.permute(value, size, b"address" + bytes(map(len, parts)), back)
    out = []
    for k in (3, 2, 1, 0):
        a, b = spans[k]
        value, v = divmod(value, b - a - (1 if skip and not k else 0))
        out.append(str(a + v + (1 if skip and not k and a + v >= 127 else 0)))
    return ".".join(reversed(out))


def _social(f: Feistel, m: re.Match, back: bool) -> str | None:
    digits = _bare(m[0])
    area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas, groups, serials = 898, 99, 9999
    value = ((area - 1 - (area > 666)) * groups + group - 1) * serials + serial - 1
    value = f.permute(value, areas * groups * serials, b"social", back)
    value, serial = divmod(value, serials)
    area, group = divmod(value, groups)
    area += 1
    return _fill(m[0], f"{area + (area >= 666):03d}{group + 1:02d}{serial + 1:04d}")


def _check97(country: str, account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def _iban(f: Feistel, m: re.Match, back: bool) -> str | None:
    bare = _bare(m[0])
    country, check, account = bare[:2], bare[2:4], bare[4:]
    if not 15 <= len(bare) <= 34 or int(check) != 98 - _check97(country, account):
        return None
    account = f.characters(account, "iban" + country + str(len(bare)), back)
    return _fill(m[0], f"{country}{98 - _check97(country, account):02d}{account}")


def _class(d: datetime.date) -> tuple[int, int]:
    return (0 if d.day < 10 else 1 if d.day <= 12 else 2), int(d.month >= 10)


@functools.cache
def _dates() -> dict[tuple[int, int], list[int]]:
    """The days of each class, in order."""
    found: dict[tuple[int, int], list[int]] = {}
    for day in range(FIRST_DAY, FIRST_DAY + DAYS):
        found.setdefault(_class(datetime.date.fromordinal(day)), []).append(day)
    return found


def _other_day(f: Feistel, year: int, month: int, day: int, back: bool) -> datetime.date | None:
    """The pseudonym of a date within its class; None for what is no date of 1900 to 2099."""
    try:
        old = datetime.date(year, month, day)
    except ValueError:
        return None
    if not 0 <= old.toordinal() - FIRST_DAY < DAYS:
        return None
    kind = _class(old)
    days = _dates()[kind]
    at = f.permute(bisect.bisect_left(days, old.toordinal()), len(days), b"date%d%d" % kind, back)
    return datetime.date.fromordinal(days[at])


def _date(f: Feistel, m: re.Match, back: bool) -> str | None:
    a, mark, b, c = m["a"], m["mark"], m["b"], m["c"]
    pad = lambda v, like: f"{v:02d}" if len(like) == 2 else str(v)
    if len(a) == 4:
        new = _other_day(f, int(a), int(b), int(c), back)
        return new and f"{new.year}{mark}{pad(new.month, b)}{mark}{pad(new.day, c)}"
    # A second number beyond 12 is a day; where both can be months, the day comes first.
    swapped = int(b) > 12
    new = _other_day(f, int(c), int(a if swapped else b), int(b if swapped else a), back) if len(c) == 4 else None
    if new is None:
        return None
    first, second = (new.month, new.day) if swapped else (new.day, new.month)
    return f"{pad(first, a)}{mark}{pad(second, b)}{mark}{new.year}"


def _named_date(f: Feistel, m: re.Match, back: bool) -> str | None:
    name = m["month"] or m["month2"]
    low = name.lower().rstrip(".")
    whole = len(low) > 3 and low != "sept"
    year, month, day = int(m["year"] or m["year2"]), [n[:3] for n in MONTHS].index(low[:3]) + 1, m["day"] or m["day2"]
    new = _other_day(f, year, month, int(day), back)
    # The fifth name is as long in full as cut, so a date with a name in full doesn't become one of it.
    while new and whole and new.month == 5:
        new = _other_day(f, new.year, new.month, new.day, back)
    if new is None:
        return None
    shown = MONTHS[new.month - 1] if whole else MONTHS[new.month - 1][:3]
    shown = shown.upper() if name.isupper() else shown.capitalize() if name[0].isupper() else shown
    shown += "." * name.endswith(".")
    number = f"{new.day:02d}" if len(day) == 2 else str(new.day)
    if m["day"]:
        return f"{number}{m['gap']}{shown}{m['gap2']}{new.year}"
    return f"{shown}{m['gap3']}{number}{m['gap4']}{new.year}"


def _mail(f: Feistel, m: re.Match, back: bool) -> str | None:
    return f.characters(m["local"], "mail", back) + "@" + m["domain"]


def _secret(f: Feistel, m: re.Match, back: bool) -> str | None:
    if m["named"]:
        value = m["value"]
        if not any(c.isdigit() for c in value) and not m["named"].lower().startswith("passw"):
            return None
        if set(value) <= set("0123456789abcdef") and any(c.isdigit() for c in value):
            new = f.characters(value, "hex", back, {i: "0123456789abcdef" for i in range(len(value))})
            while not any(c.isdigit() for c in new):  # it would be read as another kind
                new = f.characters(new, "hex", back, {i: "0123456789abcdef" for i in range(len(value))})
        else:
            new = f.characters(value, "secret", back)
            while set(new) <= set("0123456789abcdef") and any(c.isdigit() for c in new):  # it would be read as hexadecimal
                new = f.characters(new, "secret", back)
        return m["named"] + new
    return m["akia"][:4] + f.characters(m["akia"][4:], "akia", back, {i: DIGITS + UPPER for i in range(16)})


#: English names of months.
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
)
_MONTH = "(?i:" + "|".join([*MONTHS, r"(?:jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)\.?"]) + ")"
#: In order; at one place the first that matches and is valid counts.
KINDS: list[tuple[str, str, Callable]] = [
    ("mail", r"(?<![\w.%+-])(?P<local>[A-Za-z0-9](?:[\w.%+-]*[A-Za-z0-9])?)@(?P<domain>[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24})(?![\w-])", _mail),
    ("secret", r"(?<![A-Za-z0-9])(?:(?P<akia>AKIA[0-9A-Z]{16})|(?P<named>(?i:token|password|passwd|secret|api_?key)\s?[=:]\s?[\"']?)(?P<value>[A-Za-z0-9](?:[A-Za-z0-9_-]{6,}[A-Za-z0-9])))(?![A-Za-z0-9])", _secret),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("date", r"(?<![\w.,/-])(?:(?P<a>\d{4}|\d{1,2})(?P<mark>[-/.])(?P<b>\d{1,2})(?P=mark)(?P<c>(?<=.)\d{4}|\d{1,2}))(?![\w/-])(?!\.\d)", _date),
    ("date", r"(?<![\w-])(?:(?P<day>\d{1,2})(?P<gap> )(?P<month>" + _MONTH + r")(?P<gap2>,? )(?P<year>\d{4})|(?P<month2>" + _MONTH + r")(?P<gap3> )(?P<day2>\d{1,2})(?P<gap4>,? )(?P<year2>\d{4}))(?![\w-])", _named_date),
    ("social", r"(?<![\w.-])\d{3}(?P<mark>[- ])\d{2}(?P=mark)\d{4}(?![\w-])", _social),
    ("address", r"(?<![\w.-])\d{1,3}(?:\.\d{1,3}){3}(?![\w-])(?!\.\d)", _address),
    ("phone", r"(?<![\w.+-])(?P<code>\+(?:1|[02-9]\d{0,2})[ .-]?)(?P<rest>(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}|\d{6,12})(?![\w-])", _phone),
    ("phone", r"(?<![\w.+-])(?P<code>)(?P<rest>(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}|\d{3} \d{3} \d{4})(?![\w-])", _phone),
    ("phone", r"(?<![\w.+-])(?P<code>(?i:phone|tel|call|mobile|fax|cell)[.:]? {0,2})(?P<rest>\d{10})(?![\w-])", _phone),
    ("card", r"(?<![\w.+-])\d(?:[ .-]?\d){12,18}(?![\w-])", _card),
]
#: With what must not follow a match, for ends that are tried besides the first.
_COMPILED = [
    (kind, re.compile(pattern, re.ASCII), re.compile(pattern[pattern.rindex("(?![") :], re.ASCII), f) for kind, pattern, f in KINDS
]
_HINT = re.compile(r"[0-9@]|AKIA|[Pp][Aa][Ss][Ss][Ww]")


def _ends(pattern: re.Pattern, tail: re.Pattern, text: str, m: re.Match, stop: int):
    """The match and, from its start, those that end sooner, the longest first; none goes beyond ``stop``."""
    if m.end() <= stop:
        yield m
    for end in range(min(m.end() - 1, stop), m.start() + 5, -1):
        if tail.match(text, end) and (shorter := pattern.fullmatch(text, m.start(), end)):
            yield shorter


def _first_valid(ends, f: Callable, feistel: Feistel, back: bool) -> tuple[re.Match, str] | None:
    for m in ends:
        new = f(feistel, m, back)
        if new is not None:
            return m, new
    return None


def pseudonymise(text: str | None, feistel: Feistel, back: bool = False) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The text with every value found replaced, and kind, start and end (in the new text) of each."""
    if not text or not _HINT.search(text):
        return text, []
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))
    for kind, pattern, tail, f in _COMPILED:
        if kind == "mail" and "@" not in text:
            continue
        at = 0
        while m := pattern.search(text, at):
            a, at = m.start(), m.end()
            stop = taken.find(1, a, at)
            stop = at if stop < 0 else stop
            valid = _first_valid(_ends(pattern, tail, text, m, stop), f, feistel, back)
            if valid is None:
                if stop < at:  # on behind the text that is taken
                    at = taken.find(0, stop)
                    if at < 0:
                        break
                continue
            b, new = valid[0].end(), valid[1]
            # A pseudonym that would be read on beyond its end is walked on to one that isn't, so it can be turned back.
            while b < min(m.end(), stop):
                changed = text[:a] + new + text[b:]
                again = pattern.match(changed, a)
                read = again and _first_valid(_ends(pattern, tail, changed, again, stop), f, feistel, back)
                if not read or read[0].end() == b:
                    break
                new = f(feistel, pattern.fullmatch(changed, a, b), back)
            found.append((a, b, kind, new))
            taken[a:b] = b"\1" * (b - a)
            at = b
    if not found:
        return text, []
    out, spans, last, size = [], [], 0, 0
    for a, b, kind, new in sorted(found):
        out += [text[last:a], new]
        size += a - last
        spans.append((kind, size, size + len(new)))
        size += len(new)
        last = b
    return "".join([*out, text[last:]]), spans


def key_of(spark: SparkSession, otherwise: bytes | None = None) -> bytes:
    """The key that the session names; refuses without one unless the caller gives another."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if found:
        return found.encode()
    if otherwise is None:
        raise ValueError(f"no key: set {SETTING}")
    return otherwise


def pseudonyms(docs: DataFrame, key: bytes | None = None, text: str = "text", back: bool = False) -> DataFrame:
    """``docs`` with the text replaced and ``pii``: kind, start and end of every pseudonym.

    Null stays null and empty stays empty; texts without a valid value are unchanged; very long texts are
    read whole; repeated rows change alike; an empty table stays empty; a column named ``pii`` is replaced.
    With ``back`` and the same key, pseudonyms become what they stand for. The key is the session's unless given.
    """
    key = key if key is not None else key_of(docs.sparkSession)
    feistel = Feistel(key)
    kept = [c for c in docs.columns if c not in (text, "pii")]

    def changed(texts: list[str | None]) -> list:
        found = [pseudonymise(t, feistel, back) for t in texts]
        return [[t for t, _ in found], [[{"kind": k, "start": a, "end": b} for k, a, b in s] for _, s in found]]

    out = map_texts(docs, text, changed, "_new string, pii array<struct<kind:string,start:int,end:int>>", kept)
    return out.select(*[F.col("_new").alias(c) if c == text else F.col(c) for c in docs.columns if c != "pii"], "pii")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables are synthetic, so a session without a key runs with the example key."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms(docs, key_of(spark, EXAMPLE_KEY)).select(
        "doc_id", "text", F.size("pii").alias("n_values"), "pii"
    )
