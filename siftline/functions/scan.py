"""Findings of one line, as array columns: no shuffle, no Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.detectors import PERSONAL, SECRETS, Detector, java
from siftline.functions.text import ENTROPY_THRESHOLD, LEAST_FLAGGED, entropy, half_even, looks_like_value, redact_personal, redact_secret, tokens, two_places
from siftline.operators.routing import env_file

#: what a finding holds besides file and line
FIELDS = ("type", "severity", "match_redacted", "description", "source", "entropy")
FINDING = "struct<type:string,severity:string,match_redacted:string,description:string,source:string,entropy:double>"


def finding(type_: Column, severity: Column, redacted: Column, description: Column, score: Column) -> Column:
    return F.struct(type_.alias("type"), severity.alias("severity"), redacted.alias("match_redacted"), description.alias("description"), F.lit("payload").alias("source"), score.alias("entropy")).cast(FINDING)


def _secret(line: Column, d: Detector) -> Column:
    value = F.regexp_extract(line, java(d.regex), d.group)
    return finding(F.lit(d.type), F.lit(d.severity), redact_secret(value), F.lit(d.description), half_even(entropy(value)))


def folded(line: Column) -> Column:
    """The line in one case, as case-insensitive patterns see it: long s, Kelvin sign, and i with another or no dot are s, k and i."""
    out = F.lower(line)
    for other, plain in (("\u017f", "s"), ("\u0131", "i"), ("\u0307", "")):
        out = F.replace(out, F.lit(other), F.lit(plain))
    return out


def hit(line: Column, d: Detector, fold: Column) -> Column:
    """Whether the pattern matches; cheap searches for what a match must hold come first."""
    match = F.regexp_like(line, F.lit(java(d.regex)))
    return reduce(lambda a, b: a | b, (fold.contains(n) for n in d.needles)) & match if d.needles else match


def may_match(text: Column, detectors: list[Detector]) -> Column:
    """Whether a detector of the registry can match a line of a text: it holds a needle, or the pattern itself matches, if nothing in it ties it to a line."""
    needles = list(dict.fromkeys(n for d in detectors for n in d.needles))
    plain = [F.regexp_like(text, F.lit(java(d.regex))) for d in detectors if not d.needles]
    # the lambda's argument is made once, however often it is searched
    held = F.exists(F.array(folded(text)), lambda f: reduce(lambda a, b: a | b, (f.contains(n) for n in needles)))
    return reduce(lambda a, b: a | b, plain, held)


def can_hold(text: Column, file: Column, personal_route: Column, secrets: list[Detector] = SECRETS, personal: list[Detector] = PERSONAL) -> Column:
    """Whether any line of a text can have a finding: cheap searches of the whole text, so that most texts are never cut into lines.

    Of the registries only; detectors of one's own could look beyond their line, so with them every text can.
    """
    if secrets is not SECRETS or personal is not PERSONAL:
        return F.lit(True)
    run = F.regexp_like(text, F.lit(r"""(?U)[^\s\x1C-\x1F="',:{}\[\]()]{%d}""" % LEAST_FLAGGED))
    digit = text.contains("@") | F.regexp_like(text, F.lit(r"\p{Nd}"))
    return env_file(file) | (personal_route & digit) | may_match(text, [d for d in secrets if d.type != "P-02"]) | run


def scan_secrets(line: Column, in_env: Column | None = None, detectors: list[Detector] = SECRETS, fold: Column | None = None) -> Column:
    """At most one finding of each type, the first in the registry's order. Types P-02 count only where `in_env` holds.

    `fold`: a column that holds `folded(line)`, so that it is made once.
    """
    fold = folded(line) if fold is None else fold
    chains: dict[str, Column] = {}
    for d in detectors:
        found = hit(line, d, fold)
        if d.type == "P-02":
            found = (in_env if in_env is not None else F.lit(False)) & found
        chains[d.type] = chains[d.type].when(found, _secret(line, d)) if d.type in chains else F.when(found, _secret(line, d))
    return F.array_compact(F.array(*chains.values()))


def scan_personal(line: Column, detectors: list[Detector] = PERSONAL) -> Column:
    """A finding for each label that matches, in order."""
    of, digits = [], F.regexp_like(line, F.lit(r"(?U)\d"))
    for d in detectors:
        value = F.regexp_extract(line, java(d.regex), 0)
        # all but e-mail addresses have a digit
        first = F.lit(True) if d not in PERSONAL else line.contains("@") if d is PERSONAL[0] else digits
        of.append(F.when(first & F.regexp_like(line, F.lit(java(d.regex))), finding(F.lit(d.type), F.lit(d.severity), redact_personal(value, d.name), F.lit(d.description), F.lit(0.0))))
    return F.array_compact(F.array(*of))


def scan_entropy(line: Column, type_: Column | None = None) -> Column:
    """An array with a finding for the first token over the threshold, or an empty one."""
    long = F.filter(tokens(line), lambda t: (F.length(t) >= LEAST_FLAGGED) & looks_like_value(t))
    first = F.get(F.filter(long, lambda t: entropy(t) > F.lit(ENTROPY_THRESHOLD)), F.lit(0))
    score = entropy(first)
    said = F.concat(F.lit("High-entropy string detected (entropy score: "), two_places(score), F.lit(f", threshold: {ENTROPY_THRESHOLD}). Likely a hardcoded secret."))
    made = finding(type_ if type_ is not None else F.lit("P-01"), F.lit("HIGH"), F.concat(F.left(first, F.lit(4)), F.lit("****")), said, half_even(score))
    # the array functions run only on lines that have a long run without a delimiter
    can = F.regexp_like(line, F.lit(r"""(?U)[^\s\x1C-\x1F="',:{}\[\]()]{%d,}""" % LEAST_FLAGGED))
    return F.when(can, F.array_compact(F.array(F.when(first.isNotNull(), made)))).otherwise(F.array().cast(f"array<{FINDING}>"))


def first_of_type(findings: Column) -> Column:
    """Of findings of one type only the first."""
    return F.filter(findings, lambda x, i: ~F.exists(F.slice(findings, F.lit(1), i), lambda y: y["type"] == x["type"]))


def retyped(findings: Column, type_: Column) -> Column:
    """The findings with another type."""
    return F.transform(findings, lambda x: x.withField("type", type_))


def prefixed(findings: Column, prefix: Column) -> Column:
    """The findings with `prefix` before each description."""
    return F.transform(findings, lambda x: x.withField("description", F.concat(prefix, x["description"])))
