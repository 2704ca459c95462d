"""Personal data: patterns propose spans, checksums confirm them, context scores them.

Kinds ``email``, ``ip``, ``card`` (Luhn) and ``phone`` are the base; ``iban``
(ISO 13616, confirmed by mod-97) is added: it may be followed by words that
look like more of it, so it has its country's length, or where that is not
known ends at the last word border, of 15 to 34 characters, that passes. Each
span has a score: a base per kind, raised where a context word stands within 40
characters before or after it; a word counts whole, as the text has it. The
score never removes a base span. Positions are code points, end exclusive.
Every pattern reads a text in time proportional to its length.

A null or empty text has no spans; repeated rows are judged alike; an empty
table gives no rows; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from . import textvec as tv

KINDS = ["email", "ip", "card", "phone", "iban"]
BASE_KINDS = KINDS[:4]
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match begins where a run of digits does, so runs are read once, however long.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Lengths by country code, from the ISO 13616 registry.
_LENGTHS = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 "
    "LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()}
_DIGIT = re.compile(r"[0-9]")
SCORES = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.9}
CONTEXT = {
    "email": ("mail", "email", "contact", "contacto", "write", "correo", "kontakt"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "karte", "kreditkarte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "telephone", "tel", "call", "mobile", "fax", "telefon", "telefono"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
}
REACH = 40
_NEAR = {kind: re.compile(r"\b(?:" + "|".join(known) + r")\b", re.I) for kind, known in CONTEXT.items()}
_LONGEST = max(len(word) for known in CONTEXT.values() for word in known)


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(ch, 36)) for ch in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern finds them from the left, sought from each at sign: the
    local part is the run of its characters that ends there."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor = m.end()
        at = text.find("@", max(at + 1, floor))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    m = _IBAN.search(text)
    while m:
        at = m.start() + 4
        ends = [k for k in range(m.end() - m.start(), 0, -1) if k == m.end() - m.start() or m[0][k] == " "]
        codes = [(k, m[0][:k].replace(" ", "")) for k in ends]
        known = _LENGTHS.get(m[0][:2])
        for k, code in codes:
            if (len(code) == known if known else 15 <= len(code) <= 34) and mod97(code):
                at = m.start() + k
                yield m.start(), at
                break
        m = _IBAN.search(text, at)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def find_spans(text: str | None) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) by start, then kind in the order of KINDS."""
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    if "@" in text:
        found += [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
        found += [(s, 4, e) for s, e in _ibans(text)]
    out = []
    for s, k, e in sorted(found):
        kind = KINDS[k]
        out.append((s, e, kind, min(1.0, SCORES[kind] + (0.2 if in_context(text, s, e, kind) else 0.0))))
    return out


def in_context(text: str, start: int, end: int, kind: str) -> bool:
    """Whether a context word of the kind stands, whole, within REACH characters before or after the span."""
    find = _NEAR[kind].finditer
    before = any(m.end() <= start for m in find(text, max(0, start - REACH), start + 1))
    return before or any(m.start() < end + REACH for m in find(text, end, end + REACH + _LONGEST + 1))


def redact(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    """Each span replaced by its kind in brackets; overlapping spans count as one."""
    parts, at = [], 0
    for s, e, kind, _ in spans:
        if s >= at:
            parts += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*parts, text[at:]])


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())])


def detect(documents: DataFrame) -> DataFrame:
    """doc_id and its spans as an array of (start, end, kind, score)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tv.slices(batches):
            spans = [[dict(zip(("start", "end", "kind", "score"), x, strict=True)) for x in find_spans(t)] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "found"])

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(scan, "doc_id long, found array<struct<start:long,end:long,kind:string,score:double>>")


def redacted(documents: DataFrame) -> DataFrame:
    """The same rows and columns, spans in ``text`` replaced by their kind."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tv.slices(batches):
            texts = [t and redact(t, find_spans(t)) for t in part.column("text").to_pylist()]
            columns = [pa.array(texts, c.type) if name == "text" else c for name, c in zip(part.schema.names, part.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return documents.mapInArrow(scan, documents.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE_KINDS))
    return detect(read_table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[count(kind) for kind in BASE_KINDS],
        F.sha2(F.array_join(F.transform(base, label), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", label), ",").alias("spans"),
        count("iban"),
        F.array_join(F.transform("found", lambda x: x["score"].cast("string")), ",").alias("scores"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced; ``n_chars`` follows the text."""
    out = redacted(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
