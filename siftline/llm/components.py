"""Connected components of a graph of links between 64-bit nodes, by alternating large and small stars.

Each round is two aggregations and joins on node, written to the shared
folder; no node's neighbours meet in one row, and joins on a hot hub are
ordinary joins that adaptive execution can split. Rounds end when the links
no longer change: then each links a node to the smallest of its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import alike, cells, discard, runs, written


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(links: DataFrame) -> DataFrame:
    """`links`: two bigint columns (u, v), any order, repeats allowed. Returns node, root for each node but the roots themselves."""
    u, v = (links[c] for c in links.columns[:2])
    now = written(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u > v").distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        # large star: larger neighbours of a node go to its smallest neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours, and the node itself, go to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        last, now = now, written(small, "links")
        before, mark = mark, _mark(now)
        discard(last)
        if before == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def joined(found: DataFrame, held: DataFrame, most: int, prepare, same, forest, keyed: bool = False) -> DataFrame:
    """u, v: links that join what all links between nodes that share a key would join.

    `found` has a row (null, u, v) for each pair under keys of few nodes, and (k, u, v) for each node u of a key of
    many, v being one of them; `held` has id and data of all of these. Pairs, and each node with the v of its key,
    are tested by `same(prepare(data), data)`. Under keys of many that this doesn't join, all pairs are: in cells,
    by `forest(data, labels)`, which gives the places of pairs that join what the labels don't say is joined; if `keyed`, it is given the key, too.
    """
    edges = found.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    first = written(alike(edges, held, 4 * most, prepare, same), "links")
    many = found.filter("k is not null").select("k", F.col("u").alias("id"))
    if many.isEmpty():
        return first
    roots = components(first)
    known = many.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("k", "id", F.coalesce("root", "id").alias("label"))
    mixed = known.groupBy("k").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a < b").select("k")
    dealt = cells(known.join(mixed, "k").join(held, "id"), "id", most, "octet_length(data)").select("k", "cell", "id", "label", "data")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, _, id_, label, data in runs(batches, 2):
            own, at = np.unique(id_, return_index=True)
            if len(own) > 1 and (pairs := list(forest([data[i] for i in at], label[at], *([int(k[0])] if keyed else [])))):
                places = np.array(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(own[places[:, 0]]), pa.array(own[places[:, 1]])], names=["u", "v"])

    more = dealt.repartition("k", "cell").sortWithinPartitions("k", "cell", "id").mapInArrow(compared, "u bigint, v bigint")
    return first.unionByName(more)
