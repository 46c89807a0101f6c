"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Four base kinds are always reported: e-mail addresses, IPv4 addresses, payment
cards of 16 to 19 digits that pass Luhn, and international phone numbers. Three
further kinds are reported if their score reaches THRESHOLD: bank account
numbers (iban, of their country's length, mod 97), payment cards of 13 to 15 digits (short_card, Luhn) and
social security numbers (ssn). Their scores start at BASE, and words within
NEAR code points of a span raise or lower them.

Every pattern runs in time linear in the text.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_rows

THRESHOLD = 0.6
NEAR = 48
#: Score of a span that passed its checksum, if it has one, before context.
BASE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "short_card": 0.45, "ssn": 0.4}
FOR, AGAINST = 0.25, -0.3
#: Words that speak for a kind.
HINTS = {
    "email": ("mail", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "credit", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "short_card": ("card", "amex", "visa", "credit", "carte", "karte", "tarjeta"),
    "ssn": ("ssn", "social", "security"),
}
#: Words that speak against any kind.
DOUBTS = ("version", "isbn", "issn", "doi", "example", "order", "serial", "hash", "sha256")

KINDS = ("email", "ip", "card", "phone", "iban", "short_card", "ssn")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?= ?[A-Z0-9])")
#: How many letters and digits the account numbers of each country have.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24,
    "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_WORDS = re.compile(r"[a-z0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def mod97(account: str) -> bool:
    """ISO 7064: the country and check digits go last, letters count 10 to 35."""
    account = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def accounts(text: str) -> Iterator[tuple[int, int]]:
    """International bank account numbers: as long as their country has them, single spaces between groups, passing mod 97."""
    free = 0
    for m in _IBAN.finditer(text):
        left, at = IBAN_LENGTHS.get(m[1], 0) - 4, m.end()
        if left < 0 or m.start() < free:
            continue
        while left and at < len(text):
            if text[at] == " ":
                at += 1
            if not (text[at : at + 1].isascii() and (text[at : at + 1].isdigit() or text[at : at + 1].isupper())):
                break
            at, left = at + 1, left - 1
        after = text[at : at + 1]
        if not left and not (after.isascii() and after.isalnum()) and mod97(text[m.start() : at]):
            free = at
            yield m.start(), at


def emails(text: str) -> Iterator[tuple[int, int]]:
    """What [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ finds, going from each @ to both sides."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            free = m.end()
            yield start, free
        else:
            free = at + 1
        at = text.find("@", free)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """IPv4 addresses: each four numbers in turn of a dotted run."""
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p) <= 3 or not p[:-3].strip("0") for p in four) and all(int(p[-3:]) <= 255 for p in four):
                yield at, end
            at = end + 1


def scored(kind: str, text: str, start: int, end: int) -> float:
    """The score of a span: its kind's, adjusted for words nearby."""
    near = set(_WORDS.findall((text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower()))
    score = BASE[kind] + FOR * any(w in near for w in HINTS[kind]) + AGAINST * any(w in near for w in DOUBTS)
    return min(1.0, max(0.0, score))


def spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans of a text, and those that are added; each by kind, then start."""
    base = [("email", *s) for s in emails(text)] if "@" in text else []
    added: list[tuple[str, int, int]] = []
    if not _DIGIT.search(text):
        return base, added
    base += [("ip", *s) for s in addresses(text)]
    short = []
    for m in _DIGITS.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            (base if len(digits) > 15 else short).append(("card" if len(digits) > 15 else "short_card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            base.append(("phone", *m.span()))
    ibans = [("iban", *s) for s in accounts(text)]
    ssns = [("ssn", *m.span()) for m in _SSN.finditer(text)]
    if proposed := ibans + short + ssns:
        taken = sorted((s, e) for _, s, e in base)
        for kind, s, e in proposed:
            if scored(kind, text, s, e) >= THRESHOLD and not any(a < e and s < b for a, b in taken):
                added.append((kind, s, e))
    return base, added


def written(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"]
    for batch in batches:
        rows = []
        for text in batch.column(1):
            text = text.as_py() or ""
            base, added = spans(text)
            every = base + added
            counts = [sum(k == kind for k, _, _ in base) for kind in KINDS[:4]]
            rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(every), [scored(*x[:1], text, *x[1:]) for x in every]))
        columns = [batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.float64())]))]
        yield pa.RecordBatch.from_arrays(columns, names)


def find(docs: DataFrame) -> DataFrame:
    """Personal data in each row of docs (doc_id, text).

    Returns doc_id, n_email, n_ip, n_card, n_phone (of base spans), base_sha256
    (of the base spans as kind:start:end, comma-joined), spans (all spans
    likewise) and scores (of all spans, in the same order). Offsets are code
    points, the end exclusive. A null or empty text has no spans. Rows are
    independent, so repeated rows get equal results, and an empty table gives an
    empty one. Other columns are ignored.
    """
    long_rows(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, _SCHEMA)
