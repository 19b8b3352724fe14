"""Personal data: patterns propose spans, validators confirm them, context adjusts the score.

Base kinds (email, ip, card, phone) are whatever their pattern and validator accept; they always
stay. Further kinds are added by the method: account numbers whose mod-97 checksum holds, and
identity numbers, birth dates and passport numbers, which need a context word within
`CONTEXT` characters to reach the score of `LEAST`.

Every pattern is matched in time linear in the text: quantified runs are possessive, and the part
of an address before the @ is read backwards from it.

Defined results: null texts are empty; texts are scanned whole; spans of different kinds may
overlap; repeated rows and ids are rows like any other; an empty table gives no rows. Masking
replaces overlapping spans once, by the kind that starts first, then by the longer one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "id_number", "birth_date", "passport")
CONTEXT = 40
LEAST = 0.5

#: The patterns of the contract, in forms that need no backtracking.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Fixed values of the added kinds: pattern, score without and with a context word.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
ADDED = {
    "id_number": (re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), 0.3, re.compile(r"(?i)\b(?:ssn|social security|tax id|identity)")),
    "birth_date": (re.compile(r"(?<![0-9/.-])[0-9]{1,4}[/.-][0-9]{1,2}[/.-][0-9]{2,4}(?![0-9/-])"), 0.1, re.compile(r"(?i)\b(?:born|birth|dob)\b")),
    "passport": (re.compile(r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{6,8}(?![A-Za-z0-9])"), 0.1, re.compile(r"(?i)\bpassport")),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(account: str) -> bool:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0  # where the last address ended
    for m in DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            free = m.end()


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() < 38:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
            yield m.span()


def added(text: str) -> Iterator[tuple[str, int, int]]:
    for m in IBAN.finditer(text):
        account = m[0].replace(" ", "")
        if 15 <= len(account) <= 34 and mod97(account):
            yield "iban", *m.span()
    for kind, (pattern, alone, words) in ADDED.items():
        for m in pattern.finditer(text):
            near = text[max(0, m.start() - CONTEXT) : m.start()] + " " + text[m.end() : m.end() + CONTEXT]
            if alone + 0.5 * (words.search(near) is not None) >= LEAST:
                yield kind, *m.span()


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, by kind as listed, then by start."""
    spans = [("email", *s) for s in emails(text)]
    if DIGIT.search(text):
        spans += [("ip", *s) for s in ips(text)] + [("card", *s) for s in cards(text)] + [("phone", *s) for s in phones(text)]
        spans += sorted(added(text), key=lambda s: (KINDS.index(s[0]), s[1]))
    return spans


DIGIT = re.compile("[0-9]")


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with a placeholder for each span."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"<{kind}>"]
        done = max(done, end)
    return "".join(out) + text[done:]


def scan(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) as (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in BASE], ("base_sha256", pa.string()), ("spans", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in common.slices(batch, 1):
                found = [find(t) for t in some.column(1).to_pylist()]
                joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
                counts = [[sum(s[0] == kind for s in spans) for spans in found] for kind in BASE]
                digests = [hashlib.sha256(joined(s for s in spans if s[0] in BASE).encode()).hexdigest() for spans in found]
                columns = [some.column(0), *counts, digests, [joined(s) for s in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(columns, schema)], schema=schema)

    kinds = ", ".join(f"n_{k} bigint" for k in BASE)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(rows, f"doc_id bigint, {kinds}, base_sha256 string, spans string")


def masked(docs: DataFrame) -> DataFrame:
    """`docs` with a placeholder in `text` for each span; null texts stay null."""
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in common.slices(batch, at):
                texts = pa.array([None if t is None else mask(t, find(t)) for t in some.column(at).to_pylist()], batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(some.columns)], schema=batch.schema)

    return docs.mapInArrow(rows, docs.schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
