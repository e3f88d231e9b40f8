"""Findings of lines and files: the line projection, density, escalation, binaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.detectors import PERSONAL, SECRETS, Detector
from siftline.functions.scan import FIELDS, FINDING, first_of_type, folded, prefixed, retyped, scan_entropy, scan_personal, scan_secrets
from siftline.functions.text import percent
from siftline.operators.routing import PERSONAL_ROUTES, env_file, suffix

# Fixed value: from this share of lines with personal data on, MEDIUM becomes HIGH
DENSITY = 0.20

COLUMNS = ("file", "line", *FIELDS)


def split_lines(text: Column) -> Column:
    """Lines at any of the three line ends; one at the very end opens no line, so an empty text has none."""
    parts = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def split_all_lines(text: Column) -> Column:
    """Lines at every line end that Unicode knows, as notebooks have them; one at the very end opens no line."""
    parts = F.split(F.regexp_replace(text, "\r\n|[\r\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n"), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def scan_lines(lines: DataFrame, secrets: list[Detector] = SECRETS, personal: list[Detector] = PERSONAL) -> DataFrame:
    """`lines`: file, route, line, text and, for notebooks, cell ([Cell i/type] ). Adds found, has_pii, kept side by side on the row."""
    text, route = F.col("text"), F.col("route")
    rows = lines.withColumn("fold", folded(text)).withColumn("secret", scan_secrets(text, env_file(F.col("file")), secrets, F.col("fold")))
    rows = rows.withColumn("pii", personal_of(text, route, personal))
    found = line_findings(text, route, F.col("cell"), F.col("secret"), F.col("pii"))
    return rows.select("file", "route", "line", (F.size("pii") > 0).alias("has_pii"), found.alias("found"))


def personal_of(text: Column, route: Column, personal: list[Detector] = PERSONAL) -> Column:
    """A line's personal data, on routes that ask for it."""
    return F.when(route.isin(*PERSONAL_ROUTES), scan_personal(text, personal)).otherwise(F.array().cast(f"array<{FINDING}>"))


def line_findings(text: Column, route: Column, cell: Column, secret: Column, pii: Column) -> Column:
    """All findings of a line, given its secrets and personal data: entropy where no secret is, types and prefixes by the route."""
    notebook = route == "notebook"
    high = F.when(F.size(secret) == 0, scan_entropy(text, F.when(notebook, "P-05").otherwise("P-01"))).otherwise(F.array().cast(f"array<{FINDING}>"))
    typed = F.when(route == "ide", retyped(secret, F.lit("P-08"))).otherwise(secret)
    found = F.concat(typed, high, F.when(notebook, retyped(pii, F.lit("P-05"))).otherwise(pii))
    return F.when(notebook, prefixed(found, cell)).otherwise(found)


def per_file(scanned: DataFrame) -> DataFrame:
    """A row for each file: lines, lines with personal data, and the lines that have findings.

    Lines of a file lie in one partition, so the partial aggregate leaves about
    a row for each file to shuffle, and no text is shuffled.
    """
    some = F.when(F.size("found") > 0, F.struct("line", "found"))
    return scanned.groupBy("file", "route").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("has_pii").cast("long")).alias("n_pii_lines"), F.collect_list(some).alias("some"))


def density(n_pii_lines: Column, n_lines: Column) -> Column:
    return F.when(n_lines > 0, n_pii_lines / n_lines).otherwise(F.lit(0.0))


def escalated(found: Column, share: Column, where: Column) -> Column:
    """MEDIUM findings of personal data and headers become HIGH where much of a file is personal data."""
    up = lambda x: where & (share >= F.lit(DENSITY)) & x["type"].isin("P-04", "P-07") & (x["severity"] == "MEDIUM")
    note = F.concat(F.lit(" [escalated: "), percent(share), F.lit(" of file is PII]"))
    return F.transform(found, lambda x: x.withField("severity", F.when(up(x), "HIGH").otherwise(x["severity"])).withField("description", F.when(up(x), F.concat(x["description"], note)).otherwise(x["description"])))


def findings(files: DataFrame) -> DataFrame:
    """Escalates, keeps the first of each type on a line, and gives a row for each finding."""
    share = density(F.col("n_pii_lines"), F.col("n_lines"))
    rows = files.select("file", F.explode("some").alias("at"), share.alias("share"), F.col("route").isin("vcr", "fixture").alias("where"))
    found = first_of_type(escalated(F.col("at.found"), F.col("share"), F.col("where")))
    return rows.select("file", F.col("at.line").cast("long").alias("line"), F.inline(found)).select(*COLUMNS)


# Fixed values in the descriptions
def binary_findings(paths: DataFrame) -> DataFrame:
    """`paths`: file. A finding for each, contents unread."""
    ext = suffix(F.col("file"))
    said = F.concat(F.lit("Binary build artifact ("), ext, F.lit(") staged for commit. Binary files may contain embedded secrets that are invisible to text scanners. Add this extension to .gitignore."))
    return paths.select("file", F.lit(0).cast("long").alias("line"), F.lit("P-06").alias("type"), F.lit("HIGH").alias("severity"), F.concat(ext, F.lit("****")).alias("match_redacted"), said.alias("description"), F.lit("payload").alias("source"), F.lit(0.0).alias("entropy"))


def deduplicated(found: DataFrame, order: list[str]) -> DataFrame:
    """The first finding, by `order`, of each file, line and type; for findings that don't come from `findings`."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("file", "line", "type").orderBy(*order))
    return found.withColumn("n", n).filter("n = 1").drop("n")
