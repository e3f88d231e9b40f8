"""Token counts of documents in flat token files that have separators but no index.

A file is a run of equally wide ids; a separator id ends each document. It is
cut into blocks of `block_tokens` ids, wherever these fall in a document:

1. each block is searched for the separator, vectorised, on its own;
2. a prefix scan over a file's blocks carries two values: documents ended so
   far, and ids since the last separator. Blocks are scanned within lots of
   `LOT`, then the lots' totals, then both are put together, so that no task
   takes more than a lot or a file's lots;
3. a block's first separator ends a document of what was open before and what
   stands before it; between two separators lies a whole document.

Defined cases: an empty document counts 0; ids after the last separator are a
document with `closed` false; a file without ids has no documents; bytes at a
file's end that make no whole id are left out. For tables: null texts count as
empty, null ids pass through, repeated rows are documents of their own, an
empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.llm.bpe import ByteBPE, tokenizer
from siftline.llm.common import bounded_batches, id_and_text, written

BLOCK_TOKENS, LOT = 1 << 18, 4096


class PlainBPE(ByteBPE):
    """Takes special tokens' strings in a text as ordinary text, so that no text holds a separator."""

    def __init__(self, path: str):
        super().__init__(path)
        self.lib.encode_special_tokens = True
        self.special = []


def flat_files(docs: DataFrame, path: str, end: int, width: int = 2, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Encodes `docs` into a flat file for each partition, held as blocks (file, block, data) in the shared folder.

    Second comes which document stands where in a file (file, ordinal, doc_id); the scan doesn't use it.
    """
    bounded_batches(docs.sparkSession)
    narrow = id_and_text(docs, id_col, text_col)
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, file = tokenizer(PlainBPE, path), TaskContext.get().partitionId()
        open_, blocks, ordinal, size = bytearray(), 0, 0, width * block_tokens
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                for ids in bpe.encode_batch(part.column(1).to_pylist()):
                    open_ += np.array([*ids, end], f"<u{width}").tobytes()
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, file, np.int32)), pa.array(np.arange(ordinal, ordinal + n)), pa.nulls(n, pa.binary()), part.column(0)], names=["file", "n", "data", "doc_id"])
                ordinal += n
                while len(open_) >= size:
                    yield block(file, blocks, bytes(open_[:size]), part.column(0).type)
                    del open_[:size]
                    blocks += 1
                id_type = part.column(0).type
        if open_:
            yield block(file, blocks, bytes(open_), id_type)

    def block(file: int, n: int, data: bytes, id_type: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([n], pa.int64()), pa.array([data], pa.binary()), pa.nulls(1, id_type)], names=["file", "n", "data", "doc_id"])

    rows = written(narrow.mapInArrow(encoded, f"file int, n bigint, data binary, doc_id {kind}"), "tokens")
    blocks = rows.filter(F.col("data").isNotNull()).select("file", F.col("n").alias("block"), "data")
    return blocks, rows.filter(F.col("data").isNull()).select("file", F.col("n").alias("ordinal"), "doc_id")


def open_files(spark: SparkSession, paths: str | list[str], width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks (file, block, data) of flat files; `file` is the path. Tasks read their blocks' bytes only."""
    step = width * block_tokens
    listed = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), "length").filter(F.col("length") >= width)
    places = listed.select("file", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - width) / step))).alias("block")).repartition(spark.sparkContext.defaultParallelism * 4)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for file, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, inner = fs.FileSystem.from_uri(file.replace("file:/", "file:///", 1) if file.startswith("file:/") and not file.startswith("file://") else file)
                with store.open_input_file(inner) as f:
                    f.seek(n * step)
                    data = f.read(step)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([n], pa.int64()), pa.array([data[: len(data) // width * width]], pa.binary())], names=["file", "block", "data"])

    return places.mapInArrow(read, "file string, block bigint, data binary")


def separated(blocks: DataFrame, end: int, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per document: file, ordinal, start (its first id's place), n_tokens (without the separator), closed."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(d, f"<u{width}", len(d) // width) for d in batch.column(2).to_pylist()]
            ends = [np.flatnonzero(x == end) for x in ids]
            columns = [batch.column(0), batch.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array(ends, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "n", "ends"])

    kind = blocks.schema["file"].dataType.simpleString()
    found = written(blocks.select("file", "block", "data").mapInArrow(searched, f"file {kind}, block bigint, n bigint, ends array<bigint>"), "ends")
    last = F.element_at("ends", -1)
    one = found.select("file", "block", F.floor(F.col("block") / LOT).alias("lot"), F.size("ends").cast("bigint").alias("k"), F.when(F.size("ends") > 0, F.col("n") - last - 1).otherwise(F.col("n")).alias("rest"))

    def scanned(rows: DataFrame, by: list[str], order: str, k: str, rest: str) -> DataFrame:
        """Adds what comes before a row: separators, and ids since the last of them (as of where the rows of `by` begin)."""
        run = W.partitionBy(*by).orderBy(order)
        ahead = run.rowsBetween(W.unboundedPreceding, -1)
        # rows from one with a separator up to the next such share a number
        rows = rows.withColumn("turn", F.sum((F.col(k) > 0).cast("int")).over(run.rowsBetween(W.unboundedPreceding, 0)))
        rows = rows.withColumn("past", F.coalesce(F.sum(k).over(ahead), F.lit(0)))
        since = F.sum(rest).over(W.partitionBy(*by, "turn").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
        rows = rows.withColumn("since", since)
        return rows.withColumn("open", F.coalesce(F.lag("since").over(run), F.lit(0))).drop("turn", "since")

    within = scanned(one, ["file", "lot"], "block", "k", "rest")
    lots = within.groupBy("file", "lot").agg(F.sum("k").alias("lot_k"), F.max_by(F.when(F.col("k") > 0, F.col("rest")).otherwise(F.col("open") + F.col("rest")), "block").alias("lot_rest"))
    lots = scanned(lots, ["file"], "lot", "lot_k", "lot_rest").select("file", "lot", F.col("past").alias("lot_past"), F.col("open").alias("lot_open"))
    place = within.join(lots, ["file", "lot"]).select("file", "block", (F.col("past") + F.col("lot_past")).alias("past"), (F.col("open") + F.when(F.col("past") > 0, 0).otherwise(F.col("lot_open"))).alias("open"))
    # each document with its block's values first, so that no exploded row carries the block's array
    begun = lambda i: F.when(i > 0, F.get("ends", i - 1) + 1)
    base = F.col("block") * block_tokens
    each = F.transform("ends", lambda at, i: F.struct((F.col("past") + i).alias("ordinal"), F.coalesce(base + begun(i), base - F.col("open")).alias("start"), F.coalesce(at - begun(i), at + F.col("open")).alias("n_tokens")))
    closed = found.join(place, ["file", "block"]).select("file", F.explode(each).alias("x")).select("file", "x.*", F.lit(True).alias("closed"))
    # what follows a file's last separator
    final = place.join(one, ["file", "block"]).groupBy("file").agg(F.max_by(F.struct((F.col("past") + F.col("k")).alias("ordinal"), F.when(F.col("k") > 0, F.col("rest")).otherwise(F.col("open") + F.col("rest")).alias("rest")), "block").alias("x"))
    size = found.groupBy("file").agg(F.sum("n").alias("size"))
    tail = final.filter("x.rest > 0").join(size, "file").select("file", F.col("x.ordinal").alias("ordinal"), (F.col("size") - F.col("x.rest")).alias("start"), F.col("x.rest").alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(tail)


def counts(docs: DataFrame, path: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, file, ordinal, start, n_tokens, from flat files of `docs`."""
    blocks, places = flat_files(docs, path, end, id_col=id_col, text_col=text_col)
    return separated(blocks, end).join(places, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
