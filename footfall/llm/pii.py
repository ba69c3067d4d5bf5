"""Operator 6: format-preserving Feistel pseudonyms for personal numbers, dates, addresses and secrets.

A candidate found by its form is validated (Luhn digit, IBAN remainder, octets, calendar, number areas)
and replaced by its image under a keyed permutation of all values of its format. The permutation is a
Feistel network of eight rounds over the value's number in its format, walked on until it falls back
into the format, so it can be undone with the key, a pseudonym is valid wherever its original was, and
equal values get equal pseudonyms in every document however they are punctuated: a date in any order of
its fields, a number of the country +1 with or without it. (A date keeps its order, marks and two-digit
fields; whether a one-digit field was written without a zero is not kept. Days above 12 are permuted
among themselves, so that a month-first date stays one.)

Kinds: e-mail (its local part), phone (its national number), card (of a known issuer range), IBAN (of its
country's length), social security number, IPv4 (not a version number), date (1900 to 2099), and secrets
in known forms (access key ids, quoted tokens, passwords). A phone's country is read from its digits, so
one number has one pseudonym with separators or without. The key is the caller's: who has it can undo
every pseudonym, so there is no default. The registered query takes ``spark.footfall.pii.key``; where that
is unset it draws a key at random and keeps it in the session, so that values link and nobody can undo them.

A value of over ``BLOCK`` signs is permuted block by block, each under a tag that depends on the block before
(there) and behind (back), so all of it hangs on all of it and the time grows with its length alone.

Cases: a null text stays null and an empty one empty; texts and values of any length are read whole; rows without
a doc_id and repeated rows are treated like others; extra columns are ignored.
"""

from __future__ import annotations

import re
import secrets
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from hashlib import blake2b, shake_256

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.session import table

#: Signs that are permuted as one number.
BLOCK = 200
# Country calling codes of one and two digits; all others have three.
SHORT_CODES = {"1", "7", "20", "27", *map(str, range(30, 35)), "36", "39", "40", "41", *map(str, range(43, 50)), *map(str, range(51, 59)), *map(str, range(60, 67)), "81", "82", "84", "86", *map(str, range(90, 96)), "98"}
# Lengths of an IBAN by country.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
FIRST, DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days

FORMS = re.compile(
    r"""(?P<email>(?<![\w.+%-])[\w.+%-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})
      | (?P<secret>(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?:(?<=password=)|(?<=token\ =\ ")|(?<=token=")|(?<=secret=))[A-Za-z0-9]{12,})
      | (?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\ ?[A-Z0-9]{4}){2,7}(?:\ ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
      | (?P<ymd>(?<![\d./-])\d{4}(?P<s1>[-/.])\d{1,2}(?P=s1)\d{1,2}(?![\d/-]|\.\d))
      | (?P<dmy>(?<![\d./-])\d{1,2}(?P<s2>[-/.])\d{1,2}(?P=s2)\d{4}(?![\d/-]|\.\d))
      | (?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))
      | (?P<ipv4>(?<![\dv])(?<!\d\.)(?<!ersion\ )(?<!uild\ )(?<!elease\ )\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d))
      | (?P<phone>(?<![\d.+-])1[-.]\d{3}[-.]\d{3}[-.]\d{4}(?![\d-])|\+1[\ .-]?\(?\d{3}\)?[\ .-]?\d{3}[\ .-]?\d{4}(?!\d)|\+(?!1[\ .(-])\d{1,3}[\ .-]?\(?\d{2,4}\)?(?:[\ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\)\ ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}[-.]\d{3}[-.]\d{4}(?![\d-]))
      | (?P<card>(?<!\d)(?:\d{13,19}|\d{4}(?P<s3>[\ -])\d{4}(?P=s3)\d{4}(?P=s3)\d{1,7}|\d{4}(?P<s4>[\ -])\d{6}(?P=s4)\d{5})(?!\d))""",
    re.X,
)
#: Every form holds a digit, an @, or one of the signs that a secret follows or begins with.
HINT = re.compile(r"[0-9@=]|AKIA")


def permute(x: int, n: int, key: bytes, tag: str, back: bool = False) -> int:
    """The image of ``x`` under a keyed permutation of 0 .. n - 1 (its original if ``back``)."""
    if n < 2:
        return x
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, size = (1 << half) - 1, (half + 7) // 8
    key = key if len(key) <= 64 else blake2b(key).digest()

    def mix(r: int, side: int) -> int:
        raw, name = side.to_bytes(size, "little"), f"{r}{tag}{half}".encode()
        if size <= 64:
            got = blake2b(raw, key=key, digest_size=size, person=name[:16]).digest()
        else:  # as many bytes as the half has
            got = shake_256(len(key).to_bytes(1, "little") + key + len(name).to_bytes(2, "little") + name + raw).digest(size)
        return int.from_bytes(got, "little") & mask

    while True:
        a, b = x >> half, x & mask
        if back:
            for r in reversed(range(8)):
                a, b = b ^ mix(r, a), a
        else:
            for r in range(8):
                a, b = b, a ^ mix(r, b)
        x = a << half | b
        if x < n:
            return x


def _walk(x: int, n: int, key: bytes, tag: str, back: bool, ok: Callable[[int], bool]) -> int:
    """`permute` walked on until the value is ``ok``: a permutation of the values that are."""
    x = permute(x, n, key, tag, back)
    while not ok(x):
        x = permute(x, n, key, tag, back)
    return x


def _radix(chars: str) -> list[tuple[int, int]]:
    """(size, first code point) of the class of each character; size 1 keeps it."""
    return [(10, 48) if "0" <= c <= "9" else (26, 97) if "a" <= c <= "z" else (26, 65) if "A" <= c <= "Z" else (1, ord(c)) for c in chars]


def _block(chars: str, key: bytes, tag: str, back: bool) -> str:
    radix, x, n = _radix(chars), 0, 1
    for c, (size, first) in zip(chars, radix, strict=True):
        x, n = x * size + ord(c) - first, n * size
    x, out = permute(x, n, key, tag, back), []
    for size, first in reversed(radix):
        x, at = divmod(x, size)
        out.append(chr(first + at))
    return "".join(reversed(out))


def _by_class(chars: str, key: bytes, tag: str, back: bool) -> str:
    """Digits to digits, small letters to small letters, capitals to capitals, as one number in mixed radix; long values in blocks."""
    if len(chars) <= BLOCK:
        return _block(chars, key, tag, back)
    blocks = [chars[i : i + BLOCK] for i in range(0, len(chars), BLOCK)]

    def chained(parts: list[str], way: str) -> list[str]:
        """Each part under a tag of the part before it as it stands after this pass (undone: before it)."""
        out, before = [], str(len(chars))
        for part in parts:
            new = _block(part, key, way + blake2b(f"{tag}:{before}".encode(), key=key[:64], digest_size=5).hexdigest(), back)
            before = part if back else new
            out.append(new)
        return out

    for way in ("b", "f") if back else ("f", "b"):
        blocks = chained(blocks, way) if way == "f" else chained(blocks[::-1], way)[::-1]
    return "".join(blocks)


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def luhn(digits: str) -> int:
    """The remainder that a valid number leaves at 0."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _email(t: str, key: bytes, back: bool) -> str:
    local, _, domain = t.rpartition("@")
    return f"{_by_class(local, key, 'email', back)}@{domain}"


def _issued(x: int, n: int) -> bool:
    """Whether a number of ``n`` digits begins as cards of the large issuers do (3 to 6, or 2221 to 2720)."""
    lead = x // 10 ** (n - 4)
    return 3000 <= lead < 7000 or 2221 <= lead <= 2720


def _card(t: str, key: bytes, back: bool) -> str | None:
    d = re.sub(r"\D", "", t)
    n = len(d) - 1
    if luhn(d) or not _issued(int(d[:-1]), n):
        return None
    body = str(_walk(int(d[:-1]), 10**n, key, "card", back, lambda x: _issued(x, n)))
    return _refill(t, body + str(-luhn(body + "0") % 10))


def _phone(t: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", t)
    if t.startswith("+"):
        code = next((digits[:k] for k in (1, 2) if digits[:k] in SHORT_CODES), digits[:3])
    else:  # a number without a country, or with a bare 1 before it, is one of +1
        code = "1" if len(digits) == 11 else ""
    d = digits[len(code) :]
    if not 6 <= len(d) <= 14:
        return None
    home = code or ("1" if len(d) == 10 else "")
    return _refill(t, code + str(permute(int(d), 10 ** len(d), key, f"tel+{home}", back)).zfill(len(d)))


def _ssn(t: str, key: bytes, back: bool) -> str | None:
    def ok(x: int) -> bool:
        area, rest = divmod(x, 1_000_000)
        return area not in (0, 666) and area < 900 and rest // 10_000 > 0 and rest % 10_000 > 0

    x = int(t.replace("-", ""))
    return _refill(t, str(_walk(x, 10**9, key, "ssn", back, ok)).zfill(9)) if ok(x) else None


def _ipv4(t: str, key: bytes, back: bool) -> str | None:
    parts = t.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    x = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ipv4", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _iban(t: str, key: bytes, back: bool) -> str | None:
    plain = t.replace(" ", "")
    if len(plain) != IBAN_LENGTHS.get(plain[:2], len(plain)) or not 15 <= len(plain) <= 34 or _iban_rest(plain) != 1:
        return None
    body = _by_class(plain[4:], key, "iban" + plain[:2], back)
    check = 98 - _iban_rest(plain[:2] + "00" + body)
    it = iter(f"{plain[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(it) for c in t)


def _date(t: str, key: bytes, back: bool) -> str | None:
    parts = re.split(r"[-/.]", t)
    order = (0, 1, 2) if len(parts[0]) == 4 else (2, 1, 0) if int(parts[1]) <= 12 else (2, 0, 1)
    try:
        was = date(*(int(parts[i]) for i in order))
    except ValueError:
        return None
    if not FIRST <= was < FIRST + timedelta(DAYS):
        return None

    def ok(x: int) -> bool:
        return ((FIRST + timedelta(x)).day > 12) == (was.day > 12)

    new = FIRST + timedelta(_walk((was - FIRST).days, DAYS, key, "date", back, ok))
    fields = {order[0]: f"{new.year}", order[1]: f"{new.month:02d}", order[2]: f"{new.day:02d}"}
    mark = t[len(parts[0])]
    return mark.join(fields[i] if len(parts[i]) >= 2 else str(int(fields[i])) for i in range(3))


RULES: dict[str, Callable[[str, bytes, bool], str | None]] = {
    "email": _email,
    "secret": lambda t, key, back: ("AKIA" + _by_class(t[4:], key, "akia", back)) if t.startswith("AKIA") else _by_class(t, key, "secret", back),
    "iban": _iban,
    "ymd": _date,
    "dmy": _date,
    "ssn": _ssn,
    "ipv4": _ipv4,
    "phone": _phone,
    "card": _card,
}


def pseudonymise(text: str | None, key: bytes, back: bool = False) -> tuple[str | None, list[str]]:
    """The text with pseudonyms, and the kind of each value replaced, in order."""
    if not text or not HINT.search(text):
        return text, []
    kinds: list[str] = []

    def swap(m: re.Match) -> str:
        kind = m.lastgroup if m.lastgroup in RULES else next(k for k in RULES if m[k] is not None)
        new = RULES[kind](m[0], key, back)
        if new is None:
            return m[0]
        kinds.append({"ymd": "date", "dmy": "date"}.get(kind, kind))
        return new

    return FORMS.sub(swap, text), kinds


def pseudonyms(docs: DataFrame, key: bytes) -> DataFrame:
    """``doc_id, text, kinds``: every whole text with its personal values replaced."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [pseudonymise(t, key) for t in pdf["text"].astype(object).where(pdf["text"].notna(), None)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "text": pd.Series([d[0] for d in done], dtype="object"), "kinds": pd.Series([d[1] for d in done], dtype="object")})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, text string, kinds array<string>")


def session_key(spark: SparkSession) -> bytes:
    """The key that ``spark.footfall.pii.key`` holds; where it is unset, one drawn at random and set there for the session."""
    name = "spark.footfall.pii.key"
    if not spark.conf.get(name, ""):
        spark.conf.set(name, secrets.token_hex(32))
    return spark.conf.get(name).encode()


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms in place of personal values."""
    return pseudonyms(table(spark, sf_dir, "documents"), session_key(spark)).select("doc_id", "text", F.size("kinds").alias("replaced"), F.concat_ws(",", F.array_sort(F.array_distinct("kinds"))).alias("kinds"))


QUERIES = {"op6_pii_pseudonyms": op6_pii_pseudonyms}
#: A keyed network has no SQL form; tests/llm/test_pii.py undoes it and checks formats and links.
SQL: dict[str, str] = {}
