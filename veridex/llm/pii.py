"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the base patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ACCOUNT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # whole digit runs only, so that a long one is read once
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")  # its start; the country tells how much follows
DIGIT = re.compile(r"[0-9]")
# Characters of an account number (ISO 13616) by length, then country.
IBAN_LENGTHS = {
    code: length
    for length, codes in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for code in codes.split()
}
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban")

#: Score of a confirmed span, and what a word of the kind within REACH characters adds or takes.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.9}
REACH, RAISE, LOWER = 48, 0.2, 0.3
#: Spans below this score are found, but not redacted: only addresses and phone numbers whose context speaks against them.
LEAST_SCORE = 0.35
CONTEXT = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel", "write", "reach"),
    "ip": ("ip", "host", "server", "address", "login", "client"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "appel", "llame"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta", "transfer"),
}
AGAINST = ("version", "release", "isbn", "serial", "order", "invoice", "build")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def octet(digits: str) -> bool:
    """At most 255, with any number of zeros before."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def mod97(iban: str) -> bool:
    if IBAN_LENGTHS.get(iban[:2]) != len(iban):
        return False
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(ch, 36)) for ch in turned)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain, found from the @ signs so that long words cost one pass."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    return found


def ibans(text: str) -> list[tuple[int, int]]:
    """Account numbers: as many characters as the country's have, in groups of four or in one, that pass mod-97 and end there."""
    found, free = [], 0
    for m in IBAN.finditer(text):
        at, got, length = m.end(), m.group(), IBAN_LENGTHS.get(m.group()[:2], 0)
        while len(got) < length and at < len(text):
            at += text[at] == " " and len(got) % 4 == 0
            if text[at : at + 1] not in ACCOUNT or at >= len(text):
                break
            got, at = got + text[at], at + 1
        if m.start() >= free and not text[at : at + 1].isalnum() and mod97(got):
            found.append((m.start(), at))
            free = at
    return found


def propose(text: str) -> list[tuple[str, int, int]]:
    """Confirmed spans by kind as listed, then start; matches that fail their check are dropped without a retry."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", s, e) for s, e in emails(text)]
    if DIGIT.search(text):
        if text.count(".") >= 3:
            out += [("ip", *m.span()) for m in IP.finditer(text) if all(octet(p) for p in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = "".join(DIGIT.findall(m.group())) if 16 <= m.end() - m.start() <= 37 else ""  # 19 digits have at most 18 separators
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m.group())) <= 15]
        out += [("iban", s, e) for s, e in ibans(text)]
    return out


def score(text: str, kind: str, start: int, end: int) -> float:
    near = {w.lower() for w in _WORD.findall(text[max(0, start - REACH) : start] + " " + text[end : end + REACH])}
    up, down = any(w in near for w in CONTEXT[kind]), any(w in near for w in AGAINST)
    return round(min(1.0, max(0.0, SCORE[kind] + RAISE * up - LOWER * down)), 2)


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, overlapping ones together, replaced by [KIND] of the first."""
    keep, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            keep += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(keep) + text[at:]


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[{"kind": k, "start": s, "end": e, "score": score(t, k, s, e)} for k, s, e in propose(t)] for t in batch.column("_t").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _TYPE)], names=["doc_id", "spans"])


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of personal data in every whole text (code points, end exclusive), with a score.

    Defined results: null and empty texts have no spans; null ids and repeated
    rows pass through, one result row each; other columns are ignored. Spans of
    different kinds may overlap; a low score never drops a confirmed span here
    (pii_redact leaves those below its least score). Time is linear in the text,
    whatever it holds.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    return rows.mapInArrow(_spans, f"doc_id long, spans {SPANS}")


def _redacted(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts = [t if t is None else redact(t, [s for s in propose(t) if score(t, *s) >= least]) for t in batch.column(at).to_pylist()]
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))


def pii_redact(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The same rows and columns with personal data of score `least` or more in `text` replaced by [EMAIL], [IP], [CARD], [PHONE] or [IBAN]; null stays null."""
    return docs.mapInArrow(partial(_redacted, least=least), docs.schema)
