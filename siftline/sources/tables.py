"""Tables with a path and a text column as files; cells of conversations as notebooks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.operators.findings import split_all_lines, split_lines
from siftline.operators.routing import PLAIN_ROUTES, route
from siftline.sources.files import bounded_batches, notebook_lines

# not as text, which only a running session can parse
_LINE = T.StructType([T.StructField("cell", T.StringType()), T.StructField("text", T.StringType())])
_UNWRAPPED = T.StructType([T.StructField("lines", T.ArrayType(_LINE)), T.StructField("message", T.StringType())])


@F.pandas_udf(_UNWRAPPED)
def unwrapped(texts: pd.Series) -> pd.DataFrame:
    """The lines of notebooks given as JSON, each with its cell's prefix; a message instead for what isn't one."""
    out = []
    for text in texts:
        try:
            out.append(([{"cell": c, "text": x} for c, x in notebook_lines((text or "").encode("utf-8", "surrogatepass"))], None))
        except Exception as fault:  # noqa: BLE001 - whatever a text holds, the others are scanned
            out.append((None, f"{type(fault).__name__}: {fault}"))
    return pd.DataFrame(out, columns=["lines", "message"])


def routed_texts(texts: DataFrame, file: Column, text: Column) -> DataFrame:
    """file, text, route."""
    return texts.select(file.alias("file"), text.alias("text")).withColumn("route", route(F.col("file")))


def lines_of(files: DataFrame, only: Column | None = None) -> DataFrame:
    """file, route, line (from 1), text, cell of each line of `files` (file, text, route), notebooks unwrapped; cell is null for other files.

    Notebooks have a branch of their own, so that no other text goes to Python.
    `only`: which of the others are cut into lines at all.
    """
    bounded_batches(files.sparkSession)
    none = F.lit(None).cast("string").alias("cell")
    read = files.filter(F.col("route").isin(*PLAIN_ROUTES))
    read = read if only is None else read.filter(only)
    plain = read.select("file", "route", F.posexplode(split_lines(F.col("text"))).alias("pos", "text")).select("file", "route", (F.col("pos") + 1).cast("long").alias("line"), "text", none)
    cells = files.filter("route = 'notebook'").select("file", "route", F.posexplode(unwrapped("text")["lines"]).alias("pos", "x"))
    return plain.unionByName(cells.select("file", "route", (F.col("pos") + 1).cast("long").alias("line"), F.col("x.text").alias("text"), F.col("x.cell").alias("cell")))


def faulty(files: DataFrame) -> DataFrame:
    """file, stage, message of notebooks among `files` that can't be parsed."""
    read = files.filter("route = 'notebook'").select("file", unwrapped("text")["message"].alias("message"))
    return read.filter("message is not null").select("file", F.lit("parse").alias("stage"), "message")


def cells_of(cells: DataFrame, file: Column, cell: Column, cell_type: Column, text: Column) -> DataFrame:
    """Rows that are cells as notebooks: lines are numbered through a notebook's cells in order of `cell`."""
    parts = cells.select(file.alias("file"), cell.alias("n"), cell_type.alias("kind"), split_all_lines(text).alias("lines"))
    of = W.partitionBy("file").orderBy("n")
    placed = parts.withColumn("before", F.coalesce(F.sum(F.size("lines")).over(of.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("i", F.row_number().over(of))
    prefix = F.concat(F.lit("[Cell "), F.col("i").cast("string"), F.lit("/"), F.col("kind"), F.lit("] "))
    return placed.select("file", F.lit("notebook").alias("route"), "before", prefix.alias("cell"), F.posexplode("lines").alias("pos", "text")).select("file", "route", (F.col("before") + F.col("pos") + 1).cast("long").alias("line"), "text", "cell")
