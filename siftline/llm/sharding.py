"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Groups (equal texts) have a vector of bytes, tokens and rows. Each item is
placed in the shard where the dot product of its vector with the shard's
residual capacity is highest, largest first. Items are groups, but for two
steps that bound what the driver packs, whatever the input's size:

* a group of more than a shard's share of any total can't be whole in a
  balanced shard, so it is cut by a hash of the row into parts of about
  `1 / (shards * fine)` of that total; no other group is cut;
* a group of more than that part is an item of its own; there can be at most
  `3 * shards * fine` such. The smaller ones are dealt by hash into `cells`
  cells, which are items. So a small group isn't placed by its own vector but
  by its cell's, and balance is met to within a cell, not a group.

The law that holds is `bytes`: after packing, whole items move from the
largest to the smallest shard while that lowers their difference in bytes.

Defined cases: a null text has no bytes (size 1) and is in the group of empty
texts; a null id is a value like another; repeated rows are rows of their own, each with its
slot; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.llm.common import written


def packed(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item by the dot products alone; `items` has a row of bytes, tokens and rows for each."""
    if not len(items):
        return np.zeros(0, int)
    total = np.maximum(items.sum(axis=0), 1)
    share = items / total * shards
    room, home = np.ones((shards, items.shape[1])), np.zeros(len(items), int)
    for i in np.lexsort((np.arange(len(items)), -share.max(axis=1))):
        fits = (room >= share[i]).all(axis=1)
        gain = room @ share[i]
        home[i] = int(np.argmax(np.where(fits, gain, -np.inf))) if fits.any() else int(np.argmax(gain))
        room[home[i]] -= share[i]
    return home


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item: `packed`, then levelled by bytes."""
    return _levelled(items[:, 0], packed(items, shards), shards)


def _levelled(size: np.ndarray, home: np.ndarray, shards: int) -> np.ndarray:
    """Moves or swaps items between the fullest and the emptiest shard while their difference falls."""
    load = np.bincount(home, size, shards)
    for _ in range(64 * shards):
        top, low = int(load.argmax()), int(load.argmin())
        half = (load[top] - load[low]) / 2
        there, here = np.flatnonzero(home == top), np.flatnonzero(home == low)
        if half < 1 or not len(there):
            break
        other = np.append(size[here], 0)  # the last: nothing comes back
        by_size = np.argsort(other, kind="stable")
        at = np.clip(np.searchsorted(other[by_size], size[there] - half), 0, len(other) - 1)
        best = None
        for k in (at, np.maximum(at - 1, 0)):
            left = np.abs(size[there] - other[by_size[k]] - half)
            j = int(left.argmin())
            if best is None or left[j] < best[0]:
                best = left[j], int(there[j]), int(by_size[k[j]])
        left, i, back = best
        if left >= half:
            break
        home[i] = low
        if back < len(here):
            home[here[back]] = top
        load = np.bincount(home, size, shards)
    return home


def shards(docs: DataFrame, n: int = 8, cells: int = 4096, fine: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = docs[text_col]
    body = F.coalesce(text, F.lit(""))
    base = written(
        docs.select(
            docs[id_col].alias("doc_id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(F.encode(body, "utf-8")).alias("text_crc32"),
            F.regexp_count(body, F.lit(r"[^\x20\t-\r]+")).cast("long").alias("tokens"),
            F.xxhash64(body).alias("h"),
            F.monotonically_increasing_id().alias("row"),  # written with the rows, hence stable
        ),
        "shards",
    )
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    size, tokens, rows = (x or 0 for x in base.agg(*sums).first())
    most = [max(1.0, x / (n * fine)) for x in (size, tokens, rows)]
    groups = base.groupBy("h").agg(*sums)
    shares = F.greatest(*(F.col(c) / F.lit(m) for c, m in zip(("size", "tokens", "rows"), most, strict=True)))
    # at most 3 * n * fine groups are over a limit that so many of them would fill; those of more than a shard are cut
    parts = F.when(shares > fine, F.least(F.ceil(shares), F.col("rows"))).otherwise(1).cast("int")
    hot = [(r["h"], r["parts"]) for r in groups.filter(shares > 1).select("h", parts.alias("parts")).collect()]
    hot = spark.createDataFrame(hot, "h bigint, parts int")
    cell = F.pmod("h", F.lit(cells)).cast("long")
    part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    named = base.join(F.broadcast(hot), "h", "left").select("doc_id", "size", "text_crc32", "tokens", "row", F.when(F.col("parts").isNull(), cell).otherwise(F.col("h")).alias("item"), F.coalesce(part, F.lit(-1)).alias("part"))
    # at most cells, groups of their own, and parts of groups
    items = named.groupBy("item", "part").agg(*sums).orderBy("item", "part").collect()
    home = place(np.array([[r["size"], r["tokens"], r["rows"]] for r in items], float).reshape(-1, 3), n)
    homes = spark.createDataFrame([(r["item"], r["part"], int(s)) for r, s in zip(items, home, strict=True)], "item bigint, part int, shard int")
    # slots: numbers within small lots of a shard, after the rows of the lots before
    lots = max(1, -(-rows // (n * 20_000)))
    placed = named.join(F.broadcast(homes), ["item", "part"]).withColumn("lot", F.pmod(F.xxhash64("row"), F.lit(lots)).cast("int"))
    counts = placed.groupBy("shard", "lot").agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.partitionBy("shard").orderBy("lot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "lot", before.alias("before"))
    number = F.row_number().over(W.partitionBy("shard", "lot").orderBy("doc_id", "row"))
    return placed.withColumn("number", number).join(offsets, ["shard", "lot"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("number") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
