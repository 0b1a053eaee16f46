"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) follow fixed patterns, leftmost and non-overlapping; a match that fails its check
(octets, Luhn, digit count) is dropped and the search goes on after it. Further kinds (iban by mod 97, ssn) are kept
only where checksum and context words bring the score to ``min_score``.

Edge cases: null text counts as empty and has no spans; positions are code points, the end is exclusive; every row is
judged by itself, so repeated rows give equal results; other columns are ignored. All searches are linear in the text:
long runs of letters or digits are entered once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
EXTRA = ("iban", "ssn")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")

#: Words that speak for a kind when they stand near a span.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "credit", "payment", "carte", "tarjeta", "karte"),
    "phone": ("phone", "call", "tel", "mobile", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.85, "phone": 0.75, "iban": 0.85, "ssn": 0.35}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        if at > done:
            start = at
            while start > done and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "._%+-"):
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                yield start, m.end()
                done = m.end()
        at = text.find("@", max(at + 1, done))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = list(_emails(text))
    if not any(c in text for c in "0123456789"):
        return found
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found["phone"].append(m.span())
    return found


def extra_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if any(c in text for c in "0123456789"):
        for m in _IBAN.finditer(text):
            body = m[0].replace(" ", "")
            if 15 <= len(body) <= 34 and mod97(body):
                out.append(("iban", *m.span()))
        out += [("ssn", *m.span()) for m in _SSN.finditer(text)]
    return out


def score_span(text: str, kind: str, start: int, end: int, width: int = 48) -> float:
    """The kind's prior, moved towards 1 by a context word within ``width`` characters on either side."""
    near = re.findall(r"\w+(?:-\w+)?", (text[max(0, start - width) : start] + " " + text[end : end + width]).lower())
    hits = sum(w in CONTEXT[kind] for w in near)
    return round(1 - (1 - PRIOR[kind]) * 0.5 ** min(hits, 3), 4)


def find_pii(text: str | None, min_score: float = 0.6) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int, float]]]:
    """Base spans by kind, and all spans with scores, by kind and start."""
    text = text or ""
    base = base_spans(text)
    scored = [(k, s, e, score_span(text, k, s, e)) for k in KINDS for s, e in base[k]]
    for kind, s, e in sorted(extra_spans(text), key=lambda x: (EXTRA.index(x[0]), x[1])):
        if (p := score_span(text, kind, s, e)) >= min_score:
            scored.append((kind, s, e, p))
    return base, scored


_SCHEMA = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("max_score", pa.float64())])


def detect_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = 0.6) -> DataFrame:
    """One row a document: counts, a digest of the base spans, all spans, the highest score. Map-only: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, scored = find_pii(text.as_py(), min_score)
                told = [f"{k}:{s}:{e}" for k in KINDS for s, e in base[k]]
                rows.append((*[len(base[k]) for k in KINDS], hashlib.sha256(",".join(told).encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for k, s, e, _ in scored), max((p for *_, p in scored), default=0.0)))
            columns = list(zip(*rows)) if rows else [[] for _ in range(len(_SCHEMA) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, f.type) for c, f in zip(columns, list(_SCHEMA)[1:])]], schema=_SCHEMA)

    ddl = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, max_score double"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)
