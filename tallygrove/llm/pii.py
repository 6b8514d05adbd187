"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Kinds, in the order in which spans are listed: email, ip, card, phone (the base kinds) and iban. Within a kind spans are
leftmost and don't overlap; a proposal of a base kind that its check turns down is dropped with all its characters, without a
retry. Capitals and digits behind an account number look like more of it, so an iban ends where its country's length says, or
for a country that isn't listed, at the last word's end at which the checksum holds; one turned down is tried again from its
next word.
A base span is kept whatever its score; a span of a further kind needs `least` points.

Defined results: a null or empty text has no spans; a null id stays null; repeated rows are answered one by one; other
columns are left behind; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import batch_rows, columns, schema

KINDS = ("email", "ip", "card", "phone", "iban")
BASE_KINDS = KINDS[:4]
SPAN = "struct<kind:string,start:int,end:int,score:double,value:string>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Possessive runs never back up, so a long run of digits costs its length and not the square of it.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_WORD_END = re.compile(r"(?=\x20|\Z)")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: Characters of an account number, by country.
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}

PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.85, "phone": 0.6, "iban": 0.9}
#: Words near a span that speak for its kind, and words that speak against any.
CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "server", "host", "login", "address"),
    "card": ("card", "visa", "credit", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "teléfono"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
}
AGAINST = ("example", "test", "version", "sample", "dummy", "serial", "isbn")
NEAR, FOR_POINTS, AGAINST_POINTS = 48, 0.1, 0.2


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The account number with its head moved to the end, letters as 10 to 35, leaves 1 when divided by 97."""
    left = 0
    for c in iban[4:] + iban[:4]:
        for digit in str(int(c, 36)):
            left = (left * 10 + int(digit)) % 97
    return left == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (domain := _DOMAIN.match(text, at + 1)):
            yield begin, domain.end()
            free = domain.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = [part.lstrip("0") or "0" for part in m[0].split(".")]
        if all(len(part) <= 3 and int(part) <= 255 for part in parts):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while m := _IBAN.search(text, at):
        begin, at = m.start(), m.start() + 1
        length = IBAN_LENGTHS.get(m[0][:2])
        for end in reversed([e.start() for e in _WORD_END.finditer(m[0])]):
            number = m[0][:end].replace(" ", "")
            if (len(number) == length if length else 15 <= len(number) <= 34) and mod97(number):
                yield begin, begin + end
                at = begin + end
                break


def score(text: str, kind: str, begin: int, end: int) -> float:
    """The kind's prior, moved by the words near the span, between 0 and 1."""
    near = set(re.findall(r"\w+", (text[max(0, begin - NEAR) : begin] + " " + text[end : end + NEAR]).lower()))
    points = PRIOR[kind] + FOR_POINTS * len(near.intersection(CONTEXT[kind])) - AGAINST_POINTS * len(near.intersection(AGAINST))
    return round(min(1.0, max(0.0, points)), 6)


def spans(text: str | None, least: float = 0.5) -> list[tuple[str, int, int, float]]:
    if not text:
        return []
    out = [("email", *s) for s in _emails(text)] if "@" in text else []
    out += [("ip", *s) for s in _ips(text)]
    out += [("card", *s) for s in _cards(text)]
    out += [("phone", *s) for s in _phones(text)] if "+" in text else []
    out += [("iban", *s) for s in _ibans(text)]
    scored = [(*s, score(text, *s)) for s in out]
    return [s for s in scored if s[0] in BASE_KINDS or s[3] >= least]


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """A row for each row of df: its id and `spans`, with offsets in code points, end exclusive."""
    batch_rows(df.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("value", pa.string())]))

    def work(batches):
        for batch in batches:
            found = []
            for text in batch.column(1):
                text = text.as_py()
                found.append([{"kind": k, "start": b, "end": e, "score": p, "value": text[b:e]} for k, b, e, p in spans(text, least)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], [id_col, "spans"])

    picked = columns(df, **{id_col: "long", text_col: "string"})
    return picked.mapInArrow(work, schema(f"{id_col} long, spans array<{SPAN}>"))
