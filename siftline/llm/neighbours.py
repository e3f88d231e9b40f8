"""Approximate nearest neighbours with a hash-prefix forest.

Every row is indexed. Rows are dealt by hash into blocks; a block's forest has
`trees` sorted arrays of 64-bit hash strings, each bit the side of a random
hyperplane through an anchor (midway between two rows of the block, picked
without regard to the planes). A query descends in each tree to the
longest prefix that other strings share with its own, then all trees ascend
together, a shorter prefix each time, and what falls under it is verified by
exact distance. The ascent ends when the block holds `k` verified neighbours
and the chance that one as near as the last of them shares no prefix of this
length in any tree is at most `miss`; in data without structure that may be near
the root, where all rows of the block are candidates: nothing is capped.

That chance is a bound for any rows, whatever their clusters, outliers or
scales: seen from an anchor at distance h of a query, what lies within r < h of
it is at an angle of at most asin(r / h), so a plane through the anchor parts
the two with a chance of at most that angle over pi. Where r reaches an anchor,
its bit promises nothing and the ascent goes on above it.

Queries meet every block, in chunks; each meeting yields at most k + 1 rows of
a query. Equal vectors are one row, which carries its k + 1 smallest ids: more
can't be among the k nearest. So neither a vector that a third of all rows
share nor a query that many share makes one task's work.

Defined cases: vectors that are null or zero, or hold a null or a component
that isn't finite, take no part, nor do rows with a null id; vectors of
different lengths aren't compared; rows that repeat an id and its vector count
once; an id with several vectors has the nearest of them as a candidate, and
as a query each vector asks for itself; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.llm.common import written

#: prefix lengths of the ascent; most hash strings part within the first of their bits
DEPTHS = (64, 48, 32, 24, 20, 17, 15, 13, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0)


class Forest:
    def __init__(self, rows: np.ndarray, trees: int, seed: int = 7):
        self.rows, n = rows, len(rows)
        rng = np.random.default_rng([seed, rows.shape[1]])
        # the products are taken about a place among most rows, so that neither an offset nor a few far rows cost digits
        self.centre = np.median(rows, axis=0)
        self.planes = [rng.standard_normal((rows.shape[1], 64)) for _ in range(trees)]
        self.anchors = rows[rng.integers(0, n, (2, 64))].mean(axis=0)
        self.middle, self.order, self.strings = [], [], []
        for planes in self.planes:
            middle = ((self.anchors - self.centre) * planes.T).sum(axis=1)
            strings = self._packed((rows - self.centre) @ planes > middle)
            order = np.argsort(strings, kind="stable")
            self.middle.append(middle)
            self.order.append(order)
            self.strings.append(strings[order])

    @staticmethod
    def _packed(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=1).view(">u8")[:, 0].astype(np.uint64)

    def nearest(self, queries: np.ndarray, k: int, miss: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the places of the k nearest found, and their distances."""
        own = [self._packed((queries - self.centre) @ p > m) for p, m in zip(self.planes, self.middle, strict=True)]
        n, out = len(self.rows), []
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for depth in DEPTHS:
            rest = np.uint64((1 << (64 - depth)) - 1)
            low = np.stack([np.searchsorted(s, o & ~rest, "left") for s, o in zip(self.strings, own, strict=True)])
            high = np.stack([np.searchsorted(s, o | rest, "right") for s, o in zip(self.strings, own, strict=True)])
            bounds[depth] = low, high
        for i, q in enumerate(queries):
            seen, places, far = np.zeros(n, bool), np.zeros(0, np.int64), np.zeros(0)
            reach = np.linalg.norm(self.anchors - q, axis=1)
            for depth in DEPTHS:
                low, high = bounds[depth][0][:, i], bounds[depth][1][:, i]
                under = np.zeros(n, bool)
                if depth:
                    for t in np.flatnonzero(high > low).tolist():
                        under[self.order[t][low[t] : high[t]]] = True
                else:
                    under[:] = True
                new = np.flatnonzero(under & ~seen)
                if len(new):
                    seen[new] = True
                    gap = self.rows[new] - q
                    places = np.concatenate([places, new])
                    far = np.concatenate([far, np.sqrt((gap * gap).sum(axis=1))])
                    if len(places) > k:
                        # ties at the end stay, the caller decides them by id
                        last = np.partition(far, k - 1)[k - 1]
                        places, far = places[far <= last], far[far <= last]
                if len(places) >= k and depth:
                    r, h = far.max(), reach[:depth]
                    agree = 1 - np.arcsin(r / h) / np.pi if (h > r).all() else np.zeros(1)
                    if (1 - agree.prod()) ** len(self.planes) <= miss:
                        break
            out.append((places, far))
        return out


def neighbours(rows: DataFrame, k: int = 10, every: int = 100, trees: int = 48, block: int = 16_384, chunk: int = 4096, miss: float = 0.05, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by `every`: query_id, rank, vec_id, score (Euclidean distance)."""
    v = F.col("v")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    given = rows.select(rows[id_col].cast("long").alias("id"), rows[vector_col].cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & v.isNotNull()).filter(sound)
    # -0.0 and 0.0 are equal; k + 1 ids of each vector, found before the shuffle in each task and after it
    given = given.select("id", F.transform(v, lambda x: x + F.lit(0.0)).alias("v"))
    few = given.distinct().withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("id"))).filter(F.col("n") <= k + 1)
    classes = written(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("c"), F.size("v").alias("size"), "v", "ids"), "vectors")
    asked = given.filter(F.col("id") % every == 0).distinct()
    asking = written(asked.join(classes.select("c", "v"), "v").select("id", "c"), "asking")
    wanted = written(asking.select("c").distinct().join(classes, "c").select("c", "size", "v"), "queries")
    n = classes.count()
    # blocks of `block` rows; of fewer, as long as that keeps more cores at work
    blocks = max(1, -(-n // block), min(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-n // 256)))
    chunks = max(1, -(-wanted.count() // chunk))
    to = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # ints on both sides: a cogroup doesn't align types, and an int and a bigint hash to different partitions
    held = classes.select("c", "size", "v", F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int").alias("block"), to(chunks).alias("chunk"))
    sent = wanted.select("c", "size", "v", F.pmod(F.xxhash64("c", F.lit(1)), F.lit(chunks)).cast("int").alias("chunk"), to(blocks).alias("block"))

    def met(items: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = {"query": [], "c": [], "score": []}
        if len(items) and len(queries):
            forest = Forest(np.stack(items["v"].tolist()).astype(np.float64), trees)
            ids, asking = items["c"].to_numpy(), queries["c"].to_numpy()
            for q, (places, far) in zip(asking, forest.nearest(np.stack(queries["v"].tolist()).astype(np.float64), k + 1, miss), strict=True):
                order = np.lexsort((ids[places], far))[: k + 1]
                found["query"] += [q] * len(order)
                found["c"] += ids[places[order]].tolist()
                found["score"] += far[order].tolist()
        return pd.DataFrame(found).astype({"query": "int64", "c": "int64", "score": "float64"})

    key = ["block", "chunk", "size"]
    pairs = held.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(met, "query long, c long, score double")
    best = F.row_number().over(W.partitionBy("query").orderBy("score", "c"))
    # k + 1 classes, k + 1 ids of each: enough for k after a query's own id is left out
    near = pairs.withColumn("n", best).filter(F.col("n") <= k + 1).join(classes.select("c", "ids"), "c").select("query", "score", F.explode("ids").alias("vec_id"))
    listed = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near")).withColumnRenamed("query", "c")
    # an id with several vectors counts at its nearest
    answers = asking.join(listed, "c").select(F.col("id").alias("query_id"), F.filter("near", lambda x: x["vec_id"] != F.col("id")).alias("near"))
    first = F.filter("near", lambda x, i: ~F.exists(F.slice("near", 1, i), lambda y: y["vec_id"] == x["vec_id"]))
    return answers.select("query_id", F.posexplode(F.slice(first, 1, k)).alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
