"""Added lines of a unified diff as lines of files. After a design, not after code; getting the diff is the caller's task."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.routing import route

_HUNK = re.compile(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@")


def added(diff: str) -> list[tuple[str, int, str]]:
    """(file, line in the new file, text) of each added line."""
    out, file, line, inside = [], None, 0, False
    for row in diff.split("\n"):
        if row.startswith("diff --git "):
            file, inside = None, False
        elif not inside and row.startswith("+++ "):
            file = row[4:].split("\t")[0].removeprefix("b/")
        elif m := _HUNK.match(row):
            line, inside = int(m[1]), True
        elif inside and row[:1] == "+" and file:
            out.append((file, line, row[1:]))
            line += 1
        elif inside and row[:1] in (" ", ""):
            line += 1
    return out


def diff_lines(spark: SparkSession, diff: str) -> DataFrame:
    """file, route, line, text, cell of added lines, for `operators.findings.scan_lines`."""
    rows = spark.createDataFrame(added(diff), "file string, line bigint, text string")
    read = rows.withColumn("route", route(F.col("file"))).filter(F.col("route").isin("ide", "vcr", "fixture", "env", "default"))
    return read.select("file", "route", "line", "text", F.lit(None).cast("string").alias("cell"))
