"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words adjust the score.

Spans are (kind, start, end, score) in code points, end exclusive. The base kinds email, ip, card and phone are kept
whatever their score; the further kinds are reported from a score of REPORT on. Every search is linear in the text: runs are
entered at their first character only, so a text of a million digits or letters costs no more than any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "national_id", "short_card", "local_phone", "secret")
REPORT = 0.6
#: Code points before a span in which context words count.
WINDOW = 48
#: Words near a span that speak for a kind.
CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "telefon", "fax"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "national_id": ("ssn", "social", "security", "insurance", "identity"),
    "short_card": ("card", "visa", "amex", "credit", "karte", "carte", "tarjeta"),
    "local_phone": ("phone", "call", "tel", "mobile", "telefon", "fax", "dial"),
    "secret": ("key", "login", "user", "credentials"),
}
#: Score of a span whose checksum (if the kind has one) holds, without context.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.8, "iban": 0.9, "national_id": 0.4, "short_card": 0.5, "local_phone": 0.3, "secret": 0.8}
#: What context words nearby add.
BONUS = 0.3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_SECRET = re.compile(r"(?i)(?<![a-z])(?:password|passwd|token|api_?key|secret)\x20?[=:]\x20?[\"']?([A-Za-z0-9_\-]{8,})")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    """The check of payment cards: every second digit from the right doubled, the digit sum divisible by ten."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The check of IBANs (ISO 7064 MOD 97-10): the first four characters moved to the end, letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, (end := m.end())
        else:
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans of every kind that their checks confirm."""
    if "@" in text:
        yield from (("email", *s) for s in _emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37 and 13 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            yield "card" if len(digits) >= 16 else "short_card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdecimal, m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        code = m[0].replace(" ", "")
        if 15 <= len(code) <= 34 and mod97(code):
            yield "iban", m.start(), m.end()
    for kind, pattern in (("national_id", _ID), ("local_phone", _LOCAL_PHONE)):
        yield from ((kind, m.start(), m.end()) for m in pattern.finditer(text))
    yield from (("secret", m.start(1), m.end(1)) for m in _SECRET.finditer(text))


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans of a text, by kind (base kinds first, as listed), then start.

    A further kind's span that meets a base span is left out. Null and empty texts have none.
    """
    if not text:
        return []
    base, more = [], []
    for kind, start, end in _proposals(text):
        near = {w.lower() for w in _WORD.findall(text, max(0, start - WINDOW), start)}
        score = min(1.0, PRIOR[kind] + BONUS * any(w in near for w in CONTEXT[kind]))
        (base if kind in BASE else more).append((kind, start, end, score))
    taken = sorted((s, e) for _, s, e, _ in base)
    kept = []
    for span in sorted(more, key=lambda x: (x[1], x[2])):
        while taken and taken[0][1] <= span[1]:
            taken.pop(0)
        if span[3] >= REPORT and not (taken and taken[0][0] < span[2]):
            kept.append(span)
    order = {k: i for i, k in enumerate(BASE + EXTRA)}
    return sorted(base + kept, key=lambda x: (order[x[0]], x[1]))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))


@F.pandas_udf(SPANS)
def spans_of(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": s, "end": e, "score": x} for k, s, e, x in find_spans(t)] for t in texts], dtype=object)


def masked(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets, overlapping spans as one of the first's kind."""
    spans = sorted((s, -e, k) for k, s, e, _ in find_spans(text))
    if not spans:
        return text
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, -end)
    return "".join(out) + text[at:]


@F.pandas_udf(T.StringType())
def mask_text(texts: pd.Series) -> pd.Series:
    return texts.map(masked, na_action="ignore")


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ``pii``: the spans of each whole text. One narrow pass; repeated rows are searched each by itself."""
    return docs.select(docs[key], spans_of(F.coalesce(docs[text].cast("string"), F.lit(""))).alias("pii"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with masked texts (null stays null) and, if there is one, n_chars brought up to date."""
    out = docs.withColumn(text, mask_text(docs[text].cast("string")))
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the base spans' SHA-256 and all spans as text, from find_pii's result."""
    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    kinds = F.col("pii")["kind"]
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(key, *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))
