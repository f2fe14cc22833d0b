"""Personal data as format-preserving pseudonyms: a keyed Feistel permutation inside each value's own format."""

from __future__ import annotations

import calendar
import hmac
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_SETTING = "spark.siftwire.pii.key"
ROUNDS = 8
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
HEX = DIGITS + "abcdef"
#: Dates outside these years are left as they are.
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
MONTHS = [m.lower() for m in calendar.month_name]


@dataclass(frozen=True)
class Cipher:
    """Permutations of number ranges under one key."""

    key: bytes

    def _mix(self, kind: str, size: int, step: int, half: int, bits: int) -> int:
        count = (bits + 7) // 8
        seed, out, block = f"{kind}|{size}|{step}|{half}".encode(), b"", 0
        while len(out) < count:
            out += hmac.digest(self.key, seed + b"|%d" % block, "sha256")
            block += 1
        return int.from_bytes(out[:count], "big") & ((1 << bits) - 1)

    def permute(self, kind: str, value: int, size: int, back: bool = False) -> int:
        """Image of ``value`` under the permutation of 0 to size - 1 that belongs to ``kind``; ``back`` inverts.

        A balanced Feistel network permutes the next even number of bits; values that land outside
        the range are sent through again, which they leave after four times on average.
        """
        if size < 2:
            return value
        half = ((size - 1).bit_length() + 1) // 2
        mask = (1 << half) - 1
        while True:
            left, right = value >> half, value & mask
            for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    left, right = right ^ self._mix(kind, size, step, left, half), left
                else:
                    left, right = right, left ^ self._mix(kind, size, step, right, half)
            value = left << half | right
            if value < size:
                return value

    def spelled(self, kind: str, text: str, alphabets: list[str | None], back: bool = False) -> str:
        """``text`` with every character permuted inside its alphabet (None: kept), all as one number."""
        value, size = 0, 1
        for c, alphabet in zip(text, alphabets, strict=True):
            if alphabet:
                value, size = value * len(alphabet) + alphabet.index(c), size * len(alphabet)
        value, out = self.permute(kind, value, size, back), []
        for c, alphabet in zip(reversed(text), reversed(alphabets), strict=True):
            if alphabet:
                value, digit = divmod(value, len(alphabet))
                c = alphabet[digit]
            out.append(c)
        return "".join(reversed(out))


def classes(text: str, hexadecimal: bool = False) -> list[str | None]:
    """The alphabet of each character: its own class, or, where asked for, hexadecimal as a whole; others are kept."""
    if hexadecimal and len(text) >= 16 and all(c in HEX for c in text):
        return [HEX] * len(text)
    return [next((a for a in (DIGITS, LOWER, UPPER) if c in a), None) for c in text]


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits and letters replaced in order."""
    source = iter(digits)
    return "".join(next(source) if c.isalnum() else c for c in shape)


def _card(c: Cipher, m: re.Match, back: bool) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = c.spelled("card", digits[1:-1], [DIGITS] * (len(digits) - 2), back)
    return _refill(m[0], (payload := digits[0] + body) + luhn_digit(payload))


def _iban(c: Cipher, m: re.Match, back: bool) -> str | None:
    compact = m[0].replace(" ", "")
    country, account = compact[:2], compact[4:]
    if not 15 <= len(compact) <= 34 or iban_check(country, account) != compact[2:4]:
        return None
    account = c.spelled(f"iban {country}", account, classes(account), back)
    return _refill(m[0], country + iban_check(country, account) + account)


def _address(c: Cipher, m: re.Match, back: bool) -> str | None:
    parts = m[0].split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    value = c.permute("ip", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, back)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _phone(c: Cipher, m: re.Match, back: bool) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if not 8 <= len(digits) <= 15:
        return None
    national, plus = digits[-10:], m[0].startswith("+")
    if len(digits) == 11 and digits[0] == "1" or len(digits) == 10 and not plus:
        if not plus and (national[0] < "2" or national[3] < "2"):
            return None
        starts = [DIGITS[:2] if national[i] < "2" else DIGITS[2:] for i in (0, 3)]
        alphabets = [starts[0], DIGITS, DIGITS, starts[1], *[DIGITS] * 6]
        return _refill(m[0], digits[:-10] + c.spelled("phone 1", national, alphabets, back))
    if not plus:
        return None
    country = len(re.match(r"\+(\d{1,3}(?=\D)|\d\d)", m[0])[1])
    rest = digits[country:]
    return _refill(m[0], digits[:country] + c.spelled(f"phone {digits[:country]}", rest, [DIGITS] * len(rest), back))


def _social(c: Cipher, m: re.Match, back: bool) -> str | None:
    area, group, serial = map(int, m[0].split("-"))
    areas = [a for a in range(1, 900) if a != 666]
    value = (areas.index(area) * 99 + group - 1) * 9999 + serial - 1
    value, serial = divmod(c.permute("ssn", value, len(areas) * 99 * 9999, back), 9999)
    area, group = divmod(value, 99)
    return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def _moved(c: Cipher, year: int, month: int, day: int, back: bool) -> date | None:
    if not (FIRST_DAY.year <= year <= LAST_DAY.year and 1 <= month <= 12):
        return None
    if not 1 <= day <= calendar.monthrange(year, month)[1]:
        return None
    size = (LAST_DAY - FIRST_DAY).days + 1
    return FIRST_DAY + timedelta(c.permute("date", (date(year, month, day) - FIRST_DAY).days, size, back))


def _date(c: Cipher, m: re.Match, back: bool) -> str | None:
    """Numeric dates: year first; else month first where slashes allow it, day first otherwise."""
    a, b, d = map(int, re.split(r"\D", m[0]))
    mark = re.search(r"\D", m[0])[0]
    if a > 999:
        new = _moved(c, a, b, d, back)
        return new and f"{new.year:04d}{mark}{new.month:02d}{mark}{new.day:02d}"
    month_first = mark == "/" and a <= 12
    month, day = (a, b) if month_first else (b, a)
    new = _moved(c, d, month, day, back)
    if not new:
        return None
    first, second = (new.month, new.day) if month_first else (new.day, new.month)
    return f"{first:02d}{mark}{second:02d}{mark}{new.year:04d}"


def _named_date(c: Cipher, m: re.Match, back: bool) -> str | None:
    word = next(w for w in re.findall(r"[A-Za-z]+", m[0]) if w.lower() in MONTHS)
    day, year = (int(x) for x in re.findall(r"\d+", m[0]))
    new = _moved(c, year, MONTHS.index(word.lower()), day, back)
    if not new:
        return None
    values = iter((str(new.day), f"{new.year:04d}"))
    name = calendar.month_name[new.month]
    return re.sub(r"\d+", lambda _: next(values), m[0]).replace(word, name.upper() if word.isupper() else name)


def _email(c: Cipher, m: re.Match, back: bool) -> str | None:
    """Local part and every domain label but the last, each on its own, so a shared domain stays shared."""
    local, _, domain = m[0].partition("@")
    *labels, top = domain.split(".")
    low = [x.lower() for x in (local, *labels)]
    new = [c.spelled("mail" if not i else "host", x, classes(x), back) for i, x in enumerate(low)]
    cased = "".join(
        n.upper() if o.isupper() else n for n, o in zip("\0".join(new), "\0".join((local, *labels)), strict=True)
    ).split("\0")
    return f"{cased[0]}@{'.'.join([*cased[1:], top])}"


def _secret(c: Cipher, m: re.Match, back: bool) -> str | None:
    value = m["v"]
    at = m.start("v") - m.start()
    new = c.spelled("secret", value, classes(value, hexadecimal=True), back)
    return m[0][:at] + new + m[0][at + len(value) :]


_MONTH = "|".join(n for n in calendar.month_name if n)
#: Kinds in order of precedence: name, pattern, replacement (None where the value does not validate).
KINDS: list[tuple[str, re.Pattern, Callable]] = [
    (name, re.compile(pattern, re.ASCII), replace)
    for name, pattern, replace in (
        ("access_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)(?P<v>[A-Z0-9]{16})(?![A-Za-z0-9])", _secret),
        ("secret", r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?P<v>[^\s\"',;]{6,})", _secret),
        ("secret", r"(?<![0-9A-Za-z])(?P<v>[0-9a-f]{32,128})(?![0-9A-Za-z])", _secret),
        ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])", _email),
        ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
        ("ip", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)", _address),
        ("date", r"(?<![\d./-])(?:\d{4}([-/.])\d\d\1\d\d|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\d/-]|\.\d)", _date),
        ("date", rf"(?i)(?<!\w)(?:\d{{1,2}} (?:{_MONTH}),? \d{{4}}|(?:{_MONTH}) \d{{1,2}},? \d{{4}})(?!\d)", _named_date),
        ("ssn", r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])", _social),
        ("card", r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?!\d)", _card),
        ("phone", r"(?<![\d+])\+?1?[ .-]?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)", _phone),
        ("phone", r"(?<![\d+])\+1\d{10}(?!\d)", _phone),
        ("phone", r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){1,4}(?!\d)", _phone),
    )
]
#: What a text must hold for any of the kinds; tested before a text goes to Python.
GUARD = r"[0-9@]|AKIA|ASIA|(?i:passw|pwd|secret|token|api[_-]?key)"
#: Registered length of the IBANs of a country.
IBAN_LENGTHS = {
    country: length
    for length, countries in (
        (15, "NO"), (16, "BE"), (18, "DK FI FK FO GL NL SD"), (19, "MK SI"), (20, "AT BA EE KZ LT LU MN XK"),
        (21, "CH HR LI LV"), (22, "BG BH CR DE GB GE IE ME RS VA"), (23, "AE GI IL IQ OM SO TL"),
        (24, "AD CZ DZ ES MD PK RO SA SE SK TN VG"), (25, "LY PT ST"), (26, "IS TR"), (27, "BI DJ FR GR IT MC MR SM"),
        (28, "AL AZ BY CY DO GT HU LB NI PL SV"), (29, "BR EG PS QA UA"), (30, "JO KW MU YE"), (31, "MT SC"), (32, "LC"), (33, "RU"),
    )
    for country in countries.split()
}


def _matches(kind: str, pattern: re.Pattern, text: str) -> Iterator[re.Match]:
    """Matches of ``pattern`` in order; of an IBAN, which may have swallowed words that follow, the part that validates.

    The registered length of its country is tried first, then the whole match, and where no length
    is known every shorter end of a group. After one that fails, the search goes on inside it.
    """
    if kind != "iban":
        yield from pattern.finditer(text)
        return
    at = 0
    while m := pattern.search(text, at):
        at = m.start() + 1
        ends = [m.end(), *(i for i in range(m.end() - 1, at, -1) if text[i] == " ")]
        if length := IBAN_LENGTHS.get(m[0][:2]):
            ends = [e for e in ends if len(text[m.start() : e].replace(" ", "")) == length] + ends[:1]
        for end in ends:
            part = pattern.fullmatch(text, m.start(), end)
            compact = part[0].replace(" ", "") if part else ""
            if 15 <= len(compact) <= 34 and iban_check(compact[:2], compact[4:]) == compact[2:4]:
                yield part
                at = end
                break


def replace_values(text: str | None, cipher: Cipher, back: bool = False) -> tuple[str | None, list[tuple[str, str]]]:
    """``text`` with its values replaced, and (kind, new value) of each in order; ``back`` restores them."""
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text or ""))
    for kind, pattern, replace in KINDS:
        for m in _matches(kind, pattern, text or ""):
            first, end = m.span("v") if "v" in pattern.groupindex else m.span()
            if any(taken[first:end]) or (new := replace(cipher, m, back)) is None:
                continue
            taken[first:end] = b"\1" * (end - first)
            shift = first - m.start()
            found.append((first, end, kind, new[shift : len(new) - (m.end() - end)]))
    out, at = [], 0
    for first, end, _, new in sorted(found):
        out += [text[at:first], new]
        at = end
    return (text if not found else "".join([*out, text[at:]])), [(k, v) for _, _, k, v in sorted(found)]


@lru_cache(maxsize=4)
def _cipher(key: bytes) -> Cipher:
    return Cipher(key)


def key_of(spark: SparkSession) -> bytes:
    """The key named by the session; a fixed one, fit for tests only, where it is unset."""
    return spark.conf.get(KEY_SETTING, "not a secret").encode()


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text", values: str | None = "pii", back: bool = False) -> DataFrame:
    """Rows with personal data in ``text`` replaced, and ``values``: the kind and pseudonym of each, in order.

    Cards (Luhn), IBANs (mod 97), dates, IPv4 addresses, social security and phone numbers are
    checked first and stay valid; mail addresses, access keys and named secrets keep their shape.
    Under one key equal values have equal pseudonyms in all documents, whatever their punctuation,
    and different values have different ones. A null text stays null and has no values; repeated
    rows and null ids need no care. One pass, no shuffle; texts without any sign of a value are not
    sent to Python. ``values`` replaces a column of that name; None leaves it out.
    """

    @F.pandas_udf("struct<text:string,pii:array<struct<kind:string,pseudonym:string>>>")
    def replace(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cipher = _cipher(key)
        for texts in batches:
            done = [(None, None) if t is None else replace_values(t, cipher, back) for t in texts]
            lists = [v and [{"kind": k, "pseudonym": p} for k, p in v] for _, v in done]
            yield pd.DataFrame({"text": [t for t, _ in done], "pii": pd.Series(lists, dtype=object)})

    done = docs.withColumn("__done", replace(F.when(F.col(text).rlike(GUARD), F.col(text))))
    done = done.withColumn(text, F.coalesce("__done.text", text))
    if values:
        none = F.expr("cast(array() as array<struct<kind:string,pseudonym:string>>)")
        done = done.withColumn(values, F.coalesce("__done.pii", none))
    return done.drop("__done")


def pseudonym_digest(docs: DataFrame) -> DataFrame:
    """Every document with pseudonyms in place, and which kinds were found."""
    out = pseudonymize(docs.select("doc_id", "text"), key_of(docs.sparkSession))
    return out.select("doc_id", "text", F.size("pii").cast("long").alias("n_values"), "pii")
