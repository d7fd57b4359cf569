"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust their score.

Base kinds are email, ip, card and phone; each is a leftmost, non-overlapping scan of the whole text, and a proposal
that fails its check is dropped without a retry. The method adds iban (mod-97) and ssn (kept only with a context word
nearby). Base spans that pass their check always stay; context words raise their score.

Nulls: a null text is an empty one and has no spans; a null id stays. Rows that repeat are each scanned. Spans are in
code points, end exclusive; spans that begin together come in the order of KINDS. All scans are linear in the text's length, and very
long texts are scanned whole. Only the id and text columns are read, so no other column's name can clash. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_BYTES, batch_bytes, trim

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
#: Scores of a confirmed proposal, what a context word adds, and the least score that is kept.
SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT_BONUS, LEAST, WINDOW = 0.3, 0.5, 60
#: Whole words, in lower case.
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "call", "tel", "telephone", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer"),
    "ssn": ("ssn", "social security", "tax id"),
}
_CONTEXT = {kind: re.compile(rf"(?<!\w)(?:{'|'.join(words)})(?!\w)") for kind, words in CONTEXT.items()}
# Lengths of IBANs by country, from the public registry of ISO 13616.
IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, EG=29, ES=24, FI=18, FO=18, FR=27,
    GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, LY=25, MC=27,
    MD=24, ME=22, MK=19, MR=27, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, SA=24, SC=31, SE=24, SI=19, SK=24, SM=27, ST=25, SV=28, TL=23,
    TN=24, TR=26, UA=29, VA=22, VG=24, XK=20,
)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A scan that fails at the head of a run of digits also fails further on in the run, so runs are tried once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_IBAN_BODY = {n: re.compile(rf"(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in sorted(set(IBAN_LENGTHS.values()))}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    rest = 0
    for c in s[4:] + s[:4]:
        rest = int(f"{rest}{int(c, 36)}") % 97
    return rest == 1


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Spans as long as the country asks, whatever capitals follow."""
    end = 0
    for m in _IBAN.finditer(text):
        body = _IBAN_BODY.get(IBAN_LENGTHS.get(m[0][:2], 0))
        if m.start() >= end and body and (rest := body.match(text, m.end())) and mod97(text[m.start() : rest.end()]):
            end = rest.end()
            yield m.start(), end


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        else:
            end = at + 1  # no local part reaches back over an @
        at = text.find("@", max(end, at + 1))


def _ip_ok(s: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in s.split("."))


def _card_ok(s: str) -> bool:
    return len(s) <= 40 and 14 <= len(d := _digits(s)) <= 19 and luhn(d)


def _phone_ok(s: str) -> bool:
    return 10 <= len(_digits(s)) <= 15


def find_spans(text: str | None) -> list[tuple[int, int, str, float]]:
    """start, end, kind, score of all spans, by start and then kind as listed in KINDS."""
    if not text:
        return []
    found = [(a, b, "email") for a, b in _emails(text)] + [(a, b, "iban") for a, b in _ibans(text)]
    for kind, pattern, ok in (("ip", _IP, _ip_ok), ("card", _CARD, _card_ok), ("phone", _PHONE, _phone_ok), ("ssn", _SSN, None)):
        if kind == "phone" and "+" not in text:
            continue
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if ok is None or ok(m[0])]
    out = []
    for a, b, kind in found:
        near = text[max(0, a - WINDOW) : a] + " " + text[b : b + WINDOW]
        score = min(1.0, SCORE[kind] + CONTEXT_BONUS * (_CONTEXT[kind].search(near.lower()) is not None))
        if score >= LEAST:
            out.append((a, b, kind, score))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def redact(text: str | None, spans: list[tuple[int, int, str, float]]) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    if not text:
        return text
    parts, done = [], 0
    for a, b, kind, _ in spans:
        if a >= done:
            parts += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*parts, text[done:]])


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, spans array<struct<start,end,kind,score>>. Texts stay in their task."""
    batch_bytes(docs.sparkSession, TEXT_BYTES)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans = [[{"start": a, "end": e, "kind": k, "score": s} for a, e, k, s in find_spans(t)] for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "spans": spans})
        trim()

    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].alias("text"))  # as a string: pandas would make floats of long integers beside a null
    found = rows.mapInPandas(scan, "id string, spans array<struct<start:bigint,end:bigint,kind:string,score:double>>")
    return found.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the personal data of its text column replaced; all rows, columns and types stay."""
    batch_bytes(docs.sparkSession, TEXT_BYTES)

    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([redact(x, find_spans(x)) for x in t], dtype=object)
        trim()

    return docs.withColumn(text_col, F.pandas_udf(scan, "string")(docs[text_col]))


def op4(spark, sf_dir: str) -> DataFrame:
    found = pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores")
    digest = [F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")]
    return found.select(F.col("id").alias("doc_id"), *map(count, BASE), *digest, *map(count, KINDS[len(BASE) :]), scores)
