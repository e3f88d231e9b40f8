"""A training corpus out of `documents`: toxicity, line dedup, near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before kept; all but the last return the columns of `documents`, `n_chars`
being that of the text as the stage leaves it. An empty table gives an empty one.
Further columns, whatever their names, come along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import lines, packing, pii, simhash, toxicity
from siftline.llm.common import table, written


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. Null and empty texts are judged as empty, null ids and equal rows like any other."""
    return toxicity.kept(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of lines only the first stays, blank lines all stay, and no document goes. Null texts become empty; rows that repeat id and text keep the same lines."""
    return _measured(lines.deduplicated(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays, that of the smallest id. Texts without words are one group; a null id stays only if its group has no other."""
    return simhash.deduplicated(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind; no document goes, and null texts stay null."""
    return _measured(pii.masked(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids. A null or empty text has its end's id alone; rows that repeat an id are packed each."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", drop_copies),
    ("PII", mask_personal_data),
    ("packing", pack_sequences),
]

#: no stage's rules can be said in SQL; tests hold each stage against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
