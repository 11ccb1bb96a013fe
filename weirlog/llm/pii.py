"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (email, ip, card, phone) are proposed by fixed patterns and confirmed by length, range
and Luhn tests; a confirmed base span always stays, whatever its score. Two further kinds come from
the method alone: `iban` (mod 97) and `id` (a number of nine digits grouped 3-2-4), which is kept
only if its score, after context words around it, reaches the threshold.

Defined results: a null or empty text has no spans; texts of any length are scanned whole in one
pass whose cost is linear in the length; repeated rows get the same spans each; further columns of
the input are not read, or, in `redact`, come back unchanged.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlog.llm.common import lean, ship, text_or_empty

# Kinds in the order that breaks ties between spans with one start.
KINDS = ("email", "ip", "card", "phone", "iban", "id")

# Patterns. Possessive quantifiers, no retries inside a run: each scan is linear.
LOCAL = "A-Za-z0-9._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL_RUN = re.compile(rf"[{LOCAL}]++")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
NUMBER_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
DIGITS = re.compile(r"[^0-9]+")

# Lengths of an IBAN by country; others pass from 15 to 34.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24,
    "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24,
    "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}

# Score before context, and words that raise or lower it.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "id": 0.4}
RAISES = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "server", "host", "login"),
    "card": ("card", "visa", "credit", "payment", "pay", "karte", "tarjeta", "carte"),
    "phone": ("call", "phone", "tel", "mobile", "fax", "telefon"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
    "id": ("ssn", "social", "security", "id", "number", "tax"),
}
LOWERS = ("version", "order", "isbn", "example", "build", "part")
STEP, WINDOW, KEEP = 0.2, 48, 0.5
_WORDS = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def mod97(code: str) -> bool:
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str):
    """Leftmost, non-overlapping. A local part has no @, so a match can only end its local part at an @."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and (c := text[start - 1]) < "\x80" and (c.isalnum() or c in "._%+-"):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            last = max(last, at + 1)
            at = text.find("@", at + 1)


def _score(kind: str, text: str, start: int, end: int) -> float:
    near = set(_WORDS.findall(text[max(0, start - WINDOW) : start].lower())) | set(_WORDS.findall(text[end : end + WINDOW // 2].lower()))
    up, down = any(w in near for w in RAISES[kind]), any(w in near for w in LOWERS)
    return min(1.0, max(0.0, BASE_SCORE[kind] + STEP * up - STEP * down))


def spans(text: str) -> list[tuple[int, int, int, float]]:
    """(start, kind's place in KINDS, end, score) in order; code points, end exclusive."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := DIGITS.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(DIGITS.sub("", m[0])) <= 15]
    scored = [(a, k, b, _score(KINDS[k], text, a, b)) for a, k, b in out]
    for kind, found in ((4, _ibans(text)), (5, ((m.start(), m.end()) for m in NUMBER_ID.finditer(text)))):
        scored += [(a, kind, b, s) for a, b in found if (s := _score(KINDS[kind], text, a, b)) >= KEEP]
    return sorted(scored)


def _ibans(text: str):
    """The pattern may run on into following words: the country's length says where a number ends, else the shortest that passes at a word's end."""
    for m in IBAN.finditer(text):
        want, seen, ends = IBAN_LENGTH.get(m[0][:2]), 0, []
        for i, c in enumerate(m[0]):
            seen += c != " "
            after = text[m.start() + i + 1 : m.start() + i + 2]
            if c != " " and (seen == want if want else 15 <= seen <= 34) and not (after.isascii() and after.isalnum()):
                ends.append(i + 1)
        end = next((e for e in ends if mod97(m[0][:e].replace(" ", ""))), None)
        if end:
            yield m.start(), m.start() + end


def joined(found, kinds=range(len(KINDS))) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in found if k in kinds)


def redacted(text: str, found, least: float = 0.0) -> str:
    """The text with every span put out; overlapping spans are merged and named by the first."""
    parts, last, previous = [], 0, None
    for a, k, b, s in found:
        if s < least:
            continue
        if previous is not None and a < last:
            last = max(last, b)
            continue
        parts += [text[last:a], f"[{KINDS[k].upper()}]"]
        previous, last = k, b
    return "".join(parts) + text[last:] if parts else text


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_more long, max_score double"


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, digest of base spans, all spans, number of further spans, top score (null: no span)."""
    ship(docs.sparkSession)

    def scan(batches):
        for batch in batches:
            rows = [spans(t) for t in batch.column(1).to_pylist()]
            counts = [[sum(x[1] == k for x in r) for r in rows] for k in range(4)]
            base = [hashlib.sha256(joined(r, range(4)).encode()).hexdigest() for r in rows]
            more = [sum(x[1] > 3 for x in r) for r in rows]
            top = [max((x[3] for x in r), default=None) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array([joined(r) for r in rows], pa.string()), pa.array(more, pa.int64()), pa.array(top, pa.float64())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_more", "max_score"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(lean(scan), _SCHEMA)


def redact(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The same rows and columns with personal data in `text` replaced by the kind's name; null texts stay null."""
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else redacted(t, spans(t), least))

    return docs.withColumn("text", clean(F.col("text").cast("string")))
