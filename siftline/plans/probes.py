"""State of the driver's own machine: files present, and detectors over the lines of its files. After a design, not after code.

These look at one machine, so they run on the driver and make a small table.
Commands are not run; their output can be given as text.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.scan import scan_secrets


def present(spark: SparkSession, paths: list[str]) -> DataFrame:
    """probe, target, output: whether each path exists."""
    return spark.createDataFrame([("file-present", p, str(os.path.exists(os.path.expanduser(p))).lower()) for p in paths], "probe string, target string, output string")


def secrets_in(texts: DataFrame) -> DataFrame:
    """`texts`: target, text (a file's content or a command's output). A row for each finding, with its line."""
    lines = texts.select("target", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.select("target", (F.col("pos") + 1).cast("long").alias("line"), F.inline(scan_secrets(F.col("text"), F.lit(True))))
