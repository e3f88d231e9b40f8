"""Column builders over a line of text: entropy, tokens, value-likeness, redaction, rounding."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
ENTROPY_THRESHOLD = 4.5
LEAST_TOKEN = 10
DELIMITERS = r"""[\s\x1C-\x1F="',:{}\[\]()]+"""

#: a token of n characters has an entropy of log2(n) at most, so shorter ones can't pass the threshold
LEAST_FLAGGED = 23


def _digits() -> str:
    """All digits, also superscripts, circled ones and others that aren't decimal, as a regex's class; engines differ in the scripts they know."""
    codes = [c for c in range(sys.maxunicode + 1) if chr(c).isdigit()]
    known = set(codes)
    first, last = [c for c in codes if c - 1 not in known], [c for c in codes if c + 1 not in known]
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(first, last, strict=True)) + "]"


DIGIT = _digits()


def entropy(value: Column) -> Column:
    """Shannon entropy in bits of a string's characters; 0 for the empty string, null for null."""
    n = F.length(value).cast("double")
    # splitting at nothing gives characters
    chars = F.array_distinct(F.split(value, ""))
    part = lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n
    total = F.aggregate(chars, F.lit(0.0), lambda a, c: a - F.when(c == "", 0.0).otherwise(part(c) * F.log2(part(c))))
    return F.when(value == "", F.lit(0.0)).otherwise(total)


def tokens(line: Column) -> Column:
    """The parts of a line between runs of white space, quotes, brackets and `= , :`; empty parts stay."""
    return F.split(line, "(?U)" + DELIMITERS, -1)


def looks_like_value(token: Column) -> Column:
    """Neither a path nor a lower-case word, and with a digit or both cases."""
    has = lambda p: F.regexp_like(token, F.lit(p))
    word = has(r"^\p{L}+$") & has(r"\p{IsLowercase}") & ~has(r"\p{IsUppercase}|\p{Lt}")
    digit = has(DIGIT)
    return ~token.contains("/") & ~token.contains("\\") & ~word & (digit | (has(r"\p{IsUppercase}") & has(r"\p{IsLowercase}")))


def half_even(value: Column, places: int = 2) -> Column:
    return F.bround(value, places)


def percent(share: Column) -> Column:
    """A share as a whole percentage, halves to even."""
    return F.concat(F.bround(share * F.lit(100.0)).cast("bigint").cast("string"), F.lit("%"))


def two_places(value: Column) -> Column:
    return F.format_string("%.2f", half_even(value))


def redact_secret(value: Column) -> Column:
    """The first four characters, if there are more."""
    return F.when(F.length(value) <= 4, F.lit("****")).otherwise(F.concat(F.left(value, F.lit(4)), F.lit("****")))


def redact_personal(value: Column, label: str) -> Column:
    """E-mail: the domain; phone and card: the last four digits; others: the label's first word."""
    if "Email" in label:
        return F.when(value.contains("@"), F.concat(F.lit("****@"), F.regexp_extract(value, r"(?s)^[^@]*@(.*)$", 1))).otherwise(F.lit("[REDACTED:EMAIL]"))
    if "Phone" in label or "Credit card" in label:
        digits = F.regexp_replace(value, r"(?U)\D", "")
        return F.when(F.length(digits) >= 4, F.concat(F.lit("****"), F.right(digits, F.lit(4)))).otherwise(F.lit("****"))
    return F.lit(f"[REDACTED:{label.split()[0].upper()}]")
