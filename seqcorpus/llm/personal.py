"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score.

Kinds with fixed patterns (``email``, ``ip``, ``card``, ``phone``) are always reported; ``iban`` (mod 97)
and ``ssn`` spans are added: an account number unless a fixed span at least as long overlaps it, the others where
they overlap none and score enough. An account number ends where its country's length says (of countries without
one, at the longest group border that mod 97 confirms), whatever words follow. All scans are linear in
the text: an email is looked for around its ``@`` sign, digits are never scanned from their middle.

Edge cases: a null or empty text has no span; spans are in codepoints, end exclusive; spans of different
kinds may overlap; rows are independent, so repeated rows are reported alike.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batches_of, frugal, prepare, query, table, texts_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
THRESHOLD = 0.5
NEAR = 40  # codepoints before a span in which context words count

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
_GROUPED = re.compile(r" ?[A-Z0-9]")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
IBAN_LEAST, IBAN_MOST = 15, 34
#: characters of an account number by country
IBAN_SIZES = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 "
    "FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 "
    "LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 "
    "SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30").split()}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
# score of a confirmed span alone, and the words that raise it
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": ("email", "mail", "contact"), "ip": ("ip", "address", "host", "server"),
    "card": ("card", "credit", "visa", "mastercard", "payment"), "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account"), "ssn": ("ssn", "social", "security"),
}
_WORDS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    """Whether the digits' weighted sum, each second one from the right doubled, is divisible by ten."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether the account number, its head moved to the end and letters read as numbers, leaves one."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost account numbers, each read on from its country and check digits."""
    free = 0
    for m in _IBAN.finditer(text):
        if m.start() < free:
            continue
        number, at, ends = m[0], m.end(), []
        while len(number) < IBAN_MOST and (more := _GROUPED.match(text, at)):
            number, at = number + more[0][-1], more.end()
            if len(number) >= IBAN_LEAST and text[at:at + 1] not in _ALNUM:
                ends.append((len(number), at))
        size = IBAN_SIZES.get(m[0][:2])
        for n, end in reversed(ends):
            if (size is None or n == size) and mod97(number[:n]):
                yield m.start(), end
                free = end
                break


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, sign and domain, found from the sign outwards."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def _part(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, kind number and end of all spans of the fixed kinds, in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_part, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out)


def score(text: str, start: int, kind: str) -> float:
    """A span's score: that of its kind, raised where a context word stands shortly before it."""
    near = set(_WORDS.findall(text[max(0, start - NEAR):start].lower()))
    return min(1.0, SCORES[kind] + 0.3 * bool(near.intersection(CONTEXT[kind])))


def spans(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """Kind, start, end and score of all spans, by start, then by kind."""
    found = base_spans(text)
    if _DIGIT.search(text):
        more = [(i, 4, j) for i, j in ibans(text) if not any(i < b and a < j and j - i <= b - a for a, _, b in found)]
        if "-" in text:
            more += [(i, 5, j) for i, j in map(re.Match.span, _SSN.finditer(text))
                     if score(text, i, "ssn") >= threshold and not any(i < b and a < j for a, _, b in found)]
        found = sorted(found + more)
    return [(KINDS[k], a, b, score(text, a, KINDS[k])) for a, k, b in found]


def redacted(text: str) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    out, done = [], 0
    for kind, start, end, _ in spans(text):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]]) if out else text


FOUND = "doc_id long, spans array<struct<kind: string, start: int, end: int, score: double>>"


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All spans of every text with their scores."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for ids, texts in batches_of(batches):
            rows = [[dict(zip(("kind", "start", "end", "score"), s)) for s in spans(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, kind)], ["doc_id", "spans"])

    return texts_of(docs, id_col, text_col).mapInArrow(find, FOUND)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of its texts replaced; all columns kept, null texts stay null."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [None if t is None else redacted(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string()))

    prepare(docs.sparkSession)
    return docs.mapInArrow(frugal(clean), docs.schema)


def digest(spans_of: list[dict]) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans_of)


DIGEST = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


@query("op8_personal")
def op8_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            base = [[s for s in row if s["kind"] in BASE] for row in rows]
            counts = [pa.array([sum(s["kind"] == k for s in row) for row in base], pa.int64()) for k in BASE]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *counts, pa.array([hashlib.sha256(digest(x).encode()).hexdigest() for x in base], pa.string()),
                pa.array([digest(x) for x in rows], pa.string()),
            ], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return find_personal(table(spark, sf_dir, "documents")).mapInArrow(summed, DIGEST)
