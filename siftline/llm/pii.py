"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Proposal and confirmation:

* base kinds: `email`, `ip` (parts at most 255), `card` (14 to 19 digits, Luhn),
  `phone` (international, 10 to 15 digits). What these find always stays.
* added kinds: `iban` (length of its country, ISO 7064 mod-97), `card13` (13 digits, Luhn), `ssn`
  (issued ranges) and `phone_local`. They stay if their score, moved by words
  nearby, reaches `threshold`.

Each span carries a score from 0 to 1: the kind's prior, plus a bonus for a
supporting word within `reach` characters, less a malus for a contrary one.

Defined cases: a null text counts as empty and has no spans; null ids pass
through; repeated rows give repeated results; an empty table gives no rows;
columns other than the two named are ignored, whatever their names. Every
search is linear in the text, so very long texts are read whole.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import bounded_batches, id_and_text

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "card13", "ssn", "phone_local")
ORDER = {k: i for i, k in enumerate(KINDS)}

_DIGIT = re.compile("[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGIT_GROUPS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_IBAN_RUN = re.compile(r"(?:\x20?[A-Z0-9]){11,30}+")
#: lengths of IBANs by country, of the registry of ISO 13616
_IBAN_LENGTHS = {
    code: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for code in codes.split()
}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_PHONE_LOCAL = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")

#: prior, bonus, malus; words in favour; words against
_SCORES = {
    "email": (0.9, 0.08, 0.2, r"e-?mail|contact|mailto|write to", r"example|noreply"),
    "ip": (0.7, 0.2, 0.3, r"\bip\b|host|server|address|login", r"version|release|section|chapter"),
    "card": (0.8, 0.18, 0.2, r"card|visa|master|amex|credit|debit|payment", r"isbn|order|tracking|serial"),
    "phone": (0.8, 0.18, 0.2, r"phone|tel\b|call|mobile|fax|whatsapp", r"isbn|serial"),
    "iban": (0.8, 0.18, 0.2, r"iban|bank|account|konto|compte|cuenta", r"serial|part no"),
    "card13": (0.4, 0.4, 0.3, r"card|visa|credit|debit|payment", r"isbn|ean\b|order|tracking|serial"),
    "ssn": (0.45, 0.45, 0.3, r"ssn|social security|taxpayer", r"part no|serial|order"),
    "phone_local": (0.4, 0.4, 0.3, r"phone|tel\b|call|mobile|fax|whatsapp", r"isbn|serial|order"),
}
_WORDS = {k: (re.compile(v[3], re.IGNORECASE), re.compile(v[4], re.IGNORECASE)) for k, v in _SCORES.items()}


def luhn(digits: str) -> bool:
    """Whether the check digit at the end is right."""
    total = 0
    for i, ch in enumerate(reversed(digits)):
        n = int(ch) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without spaces leaves 1 (ISO 7064)."""
    rest = 0
    for ch in iban[4:] + iban[:4]:
        rest = int(f"{rest}{int(ch, 36)}") % 97
    return rest == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Of each start the prefix that has its country's length, ends where no letter or digit follows and passes mod-97.

    A run also takes in capitals and digits after a space, so its end says nothing of
    the IBAN's. Of codes that the registry lacks, the longest prefix of 15 to 34 characters that passes.
    """
    done = 0
    for m in _IBAN.finditer(text):
        run = _IBAN_RUN.match(text, m.end()) if m.start() >= done else None
        end, fixed = run.end() if run else 0, _IBAN_LENGTHS.get(m.group()[:2])
        while end:
            near = text[m.start() : end].replace(" ", "")
            if len(near) < 15:
                break
            if (not fixed or len(near) == fixed) and not (text[end : end + 1].isascii() and text[end : end + 1].isalnum()) and mod97(near):
                yield m.start(), end
                done = end
                break
            end -= 2 if text[end - 2] == " " else 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping. `@` is in neither class, so one outward walk from each finds them in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        # text between two @ is walked at most twice: an own failed walk never starts before the last @
        elif done <= at:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _checked(text: str) -> list[tuple[int, int, str]]:
    """Whole groups of 13 to 19 digits that pass Luhn."""
    return [(*m.span(), d) for m in _DIGIT_GROUPS.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The four base kinds; a match that fails its check is dropped and not tried again."""
    out = [("email", a, b) for a, b in emails(text)]
    if not _DIGIT.search(text):
        return out
    if "." in text:
        for m in _IP.finditer(text):
            # a part of many digits is over 255 unless it has leading zeros
            if all(int(p.lstrip("0")[:4] or "0") <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
    for a, b, d in _checked(text):
        if len(d) >= 14:
            out.append(("card", a, b))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def added_spans(text: str) -> list[tuple[str, int, int]]:
    """Proposals of the other kinds that pass their check."""
    out = [("iban", a, b) for a, b in ibans(text)]
    out += [("card13", a, b) for a, b, d in _checked(text) if len(d) == 13]
    if "-" in text:
        out += [("ssn", *m.span()) for m in _SSN.finditer(text)]
    out += [("phone_local", *m.span()) for m in _PHONE_LOCAL.finditer(text)]
    return out


def score(text: str, kind: str, start: int, end: int, reach: int) -> float:
    prior, bonus, malus = _SCORES[kind][:3]
    near = text[max(0, start - reach) : start] + " \n " + text[end : end + reach]
    favour, against = _WORDS[kind]
    s = prior + bonus * bool(favour.search(near)) - malus * bool(against.search(near))
    return min(1.0, max(0.0, s))


def find_spans(text: str, reach: int = 50, threshold: float = 0.6) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end, score), by start, then kind as in KINDS. Code points, end exclusive."""
    base = base_spans(text)
    taken: list[list[int]] = []  # what base spans cover, as disjoint stretches
    for _, a, b in sorted(base, key=lambda x: x[1]):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    kept = [(k, a, b, score(text, k, a, b, reach)) for k, a, b in base]
    for k, a, b in added_spans(text) if _DIGIT.search(text) else ():
        i = bisect.bisect_left(taken, [b])
        free = not i or taken[i - 1][1] <= a
        if free and (s := score(text, k, a, b, reach)) >= threshold:
            kept.append((k, a, b, s))
    return sorted(kept, key=lambda x: (x[1], ORDER[x[0]]))


def mask(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """`text` with each span replaced by its kind in brackets; of overlapping spans the first one."""
    out, at = [], 0
    for kind, a, b, _ in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 50, threshold: float = 0.6, with_text: bool = False) -> DataFrame:
    """A row for each document: doc_id, spans (array of kind, start, end, score) and, if asked for, `masked`."""
    bounded_batches(docs.sparkSession)
    narrow = id_and_text(docs, id_col, text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [find_spans(t, reach, threshold) for t in texts]
            spans = pa.array([[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in f] for f in found], pa.list_(_SPAN))
            columns = [batch.column(0), spans]
            if with_text:
                columns.append(pa.array([mask(t, f) if f else t for t, f in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "spans", "masked"][: len(columns)])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(scan, f"doc_id {kind}, spans array<struct<kind string, start bigint, `end` bigint, score double>>" + ", masked string" * with_text)


def masked(docs: DataFrame, text_col: str = "text", reach: int = 50, threshold: float = 0.6) -> DataFrame:
    """All rows and columns of `docs`, with each span in a text replaced by its kind in brackets; null texts stay null."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def hidden(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            texts = ((t, find_spans(t or "", reach, threshold)) for t in columns[at].to_pylist())
            columns[at] = pa.array([mask(t, found) if found else t for t, found in texts], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(hidden, docs.schema)


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans as text."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *map(of, BASE_KINDS), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
