"""Whole scans: paths or tables in, findings out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.detectors import PERSONAL, SECRETS, Detector
from siftline.functions.scan import can_hold
from siftline.operators.findings import COLUMNS, binary_findings, findings, per_file, scan_lines
from siftline.operators.routing import PERSONAL_ROUTES
from siftline.sources.files import path_table, read_lines, routed
from siftline.sources.tables import cells_of, faulty, lines_of, routed_texts


def scan_files(spark: SparkSession, paths: list[str] | DataFrame, secrets: list[Detector] = SECRETS, personal: list[Detector] = PERSONAL) -> tuple[DataFrame, DataFrame]:
    """Findings (file, line, type, severity, match_redacted, description, source, entropy), and errors (file, stage, message).

    A path counts once; results come in no order, `ordered` gives the order of the paths.
    """
    known = routed(path_table(spark, paths))
    read = read_lines(known.filter(~F.col("route").isin("missing", "binary", "skipped")))
    found = findings(per_file(scan_lines(read.filter("message is null").drop("stage", "message"), secrets, personal)))
    missing = known.filter("route = 'missing'").select("file", F.lit("open").alias("stage"), F.lit("not found").alias("message"))
    faults = read.filter("message is not null").select("file", "stage", "message")
    return found.unionByName(binary_findings(known.filter("route = 'binary'"))), missing.unionByName(faults)


def ordered(found: DataFrame, paths: DataFrame) -> DataFrame:
    """Findings in the order of `paths` (file_ord, file), then of lines and types."""
    return found.join(paths.groupBy("file").agg(F.min("file_ord").alias("file_ord")), "file").orderBy("file_ord", "line", "type").select(*COLUMNS)


def scan_texts(texts: DataFrame, file: Column, text: Column, secrets: list[Detector] = SECRETS, personal: list[Detector] = PERSONAL) -> DataFrame:
    """Findings of a table's rows as files: `file` decides the route; notebooks are unwrapped, binaries found by name and their text not read.

    Notebooks that can't be parsed have no findings; `scan_table` gives them too.
    """
    return scan_table(texts, file, text, secrets, personal)[0]


def scan_table(texts: DataFrame, file: Column, text: Column, secrets: list[Detector] = SECRETS, personal: list[Detector] = PERSONAL) -> tuple[DataFrame, DataFrame]:
    """As `scan_texts`, and the notebooks that can't be parsed: file, stage, message."""
    files = routed_texts(texts, file, text)
    may = can_hold(F.col("text"), F.col("file"), F.col("route").isin(*PERSONAL_ROUTES), secrets, personal)
    found = findings(per_file(scan_lines(lines_of(files, may), secrets, personal)))
    return found.unionByName(binary_findings(files.filter("route = 'binary'").select("file").distinct())), faulty(files)


def scan_cells(cells: DataFrame, file: Column, cell: Column, cell_type: Column, text: Column, **registries: list[Detector]) -> DataFrame:
    """Findings of a table's rows as cells of notebooks."""
    return findings(per_file(scan_lines(cells_of(cells, file, cell, cell_type, text), **registries)))


def any_finding(found: DataFrame) -> bool:
    """For a gate: whether there is a finding; stops at the first."""
    return not found.limit(1).isEmpty()


def rollup(found: DataFrame) -> DataFrame:
    """Findings by type and severity."""
    return found.groupBy("type", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("n_files"))
