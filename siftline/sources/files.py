"""Files by path: Spark's own file sources skip names that begin with a dot, so tasks open the paths themselves.

The path table is filtered and spread before anything is read; binaries and
unsupported files are never opened. A path with a scheme (file:, hdfs:, s3:)
is opened through pyarrow's file systems, another one as a local or mounted
file. Faults stay with their file: they make a row of `errors`.

A task holds one file, and of the lines for Spark at most `BATCH_ROWS` rows or
`BATCH_CHARS` characters and the line that exceeds them, of many small files or
of a part of a large one.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.routing import route

READ = "file string, route string, line bigint, text string, cell string, stage string, message string"
#: rows and characters of lines that a task gathers before it gives them to Spark
BATCH_ROWS, BATCH_CHARS = 5000, 1 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches to Python small in rows and bytes; Spark's own 10,000 rows of whole texts would grow with the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def path_table(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    """file_ord, file: a row for each different path, at its first place."""
    if not isinstance(paths, DataFrame):
        paths = spark.createDataFrame(list(enumerate(paths)), "file_ord bigint, file string")
    return paths.groupBy("file").agg(F.min("file_ord").alias("file_ord"))


def routed(paths: DataFrame) -> DataFrame:
    """Adds `exists` and `route`; whether a file exists is asked by the tasks."""

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(exists=[exists(p) for p in batch["file"]])

    spread = paths.repartition(max(1, paths.sparkSession.sparkContext.defaultParallelism * 4), "file")
    known = spread.mapInPandas(asked, "file string, file_ord bigint, exists boolean")
    return known.withColumn("route", route(F.col("file"), F.col("exists")))


def exists(path: str) -> bool:
    if "://" not in path and not path.startswith("file:"):
        return os.path.exists(path)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.get_file_info(inner).type != fs.FileType.NotFound


def content(path: str) -> bytes:
    if "://" not in path and not path.startswith("file:"):
        with open(path, "rb") as f:
            return f.read()
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_stream(inner) as f:
        return f.read()


def text_lines(data: bytes) -> list[str]:
    """UTF-8, else Latin-1; any of three line ends; none opens a line at the very end."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    parts = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return parts[:-1] if parts[-1] == "" else parts


def notebook_lines(data: bytes) -> list[tuple[str, str]]:
    """(cell prefix, line) of each source and output line of a notebook, in order. Raises on what isn't one.

    A string is split at every line end that Unicode knows; a list's items are lines as they are.
    """
    out = []

    def parts(value) -> list:
        return value.splitlines() if isinstance(value, str) else [json.dumps(value)] if isinstance(value, dict) else value

    def plain(value) -> list:
        return value.splitlines() if isinstance(value, str) else value

    for i, cell in enumerate(json.loads(data.decode("utf-8")).get("cells", []), 1):
        lines = list(plain(cell.get("source", [])))
        for output in cell.get("outputs", []):
            lines.extend(plain(output.get("text", [])))
            rich = output.get("data", {})
            for kind in ("text/plain", "application/json"):
                lines.extend(parts(rich.get(kind, [])))
        prefix = f"[Cell {i}/{cell.get('cell_type', 'unknown')}] "
        out += [(prefix, str(x).rstrip("\n")) for x in lines]
    return out


def read_lines(paths: DataFrame) -> DataFrame:
    """`paths`: file, route. A row for each line, and one with stage and message for each file that can't be read."""

    names = [c.split()[0] for c in READ.split(", ")]
    kinds = [pa.int64() if n == "line" else pa.string() for n in names]

    def rows(file: str, how: str) -> Iterator[tuple]:
        stage = "read"
        try:
            data = content(file)
            stage = "parse"
            lines = notebook_lines(data) if how == "notebook" else text_lines(data)
        except Exception as fault:  # noqa: BLE001 - whatever a file does, the others are scanned
            yield file, how, None, None, None, stage, f"{type(fault).__name__}: {fault}"
            return
        del data
        for i, x in enumerate(lines, 1):
            cell, text = x if how == "notebook" else (None, x)
            yield file, how, i, text, cell, None, None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        arrow = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for file, how in zip(batch.column("file").to_pylist(), batch.column("route").to_pylist(), strict=True):
                for row in rows(file, how):
                    held.append(row)
                    chars += len(row[3] or "")
                    if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
                        yield arrow()
                        held, chars = [], 0
        if held:
            yield arrow()

    return paths.select("file", "route").mapInArrow(read, READ)
