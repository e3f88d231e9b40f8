"""The queries of this subpackage: name to (spark, sf_dir) -> DataFrame, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import bpe, images, lines, neighbours, packing, pii, sharding, simhash, tokencounts, toxicity
from siftline.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 50256)


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(table(spark, sf_dir, "embeddings"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.pii(table(spark, sf_dir, "documents")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.clusters(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op8_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.copies(images.rendered(table(spark, sf_dir, "embeddings"))).withColumnRenamed("id", "vec_id")


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.classes(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_token_counts": op2_token_counts,
    "op3_neighbours": op3_neighbours,
    "op4_bpe": op4_bpe,
    "op5_pii": op5_pii,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_images": op8_images,
    "op9_lines": op9_lines,
    "op10_sharding": op10_sharding,
}

ORACLES: dict[str, str] = {}
