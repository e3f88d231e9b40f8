"""What the operators of this subpackage share: sessions, the shared folder, narrow inputs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: members of a key up to which pairs are named one by one: at most half as many for each member
PAIRS = 32
#: bits of a sieve that rows pass before they are shuffled: 2 MB
SIEVE = 1 << 24
#: most rows of small tables that are broadcast, counted first
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches to Python small in rows and bytes, so that long texts fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, the one that spark.checkpoint.dir names.

    Only where that is unset and all runs on one machine, as in tests, a folder under
    the warehouse is taken; on a cluster that would be a guess, so it is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"


def _own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/siftline/{spark.sparkContext.applicationId}"


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a table in the shared folder, read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    # the shuffles behind it are no longer needed; Spark deletes them once their plan is collected
    spark.sparkContext._jvm.System.gc()
    again = spark.read.schema(df.schema).parquet(path)
    again.siftline_path = path
    return again


def discard(df: DataFrame) -> None:
    """Deletes what `written` wrote for this very frame; nothing may read it any more."""
    _delete(df.sparkSession, df.siftline_path)


def clear_shared(spark: SparkSession) -> None:
    """Deletes all that `written` left in the shared folder for this application. Results not yet written out elsewhere go with it."""
    _delete(spark, _own_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only `doc_id` and `text` (null: empty), so that extra columns of any name can't clash."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sieve(hashes: DataFrame) -> np.ndarray:
    """Bits of the hashes (column h), `SIEVE` in all whatever the input, so what the driver collects and sends has a bound."""
    place = F.pmod("h", F.lit(SIEVE))
    words = hashes.select(F.floor(place / 64).cast("int").alias("w"), (place % 64).cast("int").alias("b")).groupBy("w").agg(F.expr("bit_or(shiftleft(1L, b))").alias("bits"))
    table, out = words.toArrow(), np.zeros(SIEVE // 64, np.int64)
    out[table.column("w").to_numpy()] = table.column("bits").to_numpy()
    return out


def _with_parts(members: DataFrame, key: str, most: int, weight: str | None, heaviest: int) -> DataFrame | None:
    """Adds `parts` to rows whose key has more than `most` rows, or whose `weight` (an expression) adds up to more than `heaviest`; None if no key has."""
    sums = [F.count(F.lit(1)).alias("n"), F.sum(F.expr(weight or "0")).alias("w")]
    parts = F.greatest(F.ceil(F.col("n") / most), F.ceil(F.col("w") / heaviest)).cast("int")
    hot = written(members.groupBy(key).agg(*sums).filter((F.col("n") > most) | (F.col("w") > heaviest)).select(key, parts.alias("parts")), "hot")
    n_hot = hot.count()
    if not n_hot:
        return None
    # a row of 12 bytes each; more of them than fit a broadcast are joined by adaptive execution
    return members.join(F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot, key, "left")


def hot_parts(members: DataFrame, key: str, member: str, most: int) -> DataFrame:
    """Adds `part`: a key's rows dealt by the hash of `member` into parts of about `most`."""
    held = _with_parts(members, key, most, None, 1)
    if held is None:
        return members.withColumn("part", F.lit(0))
    return held.withColumn("part", F.coalesce(F.pmod(F.xxhash64(member), F.col("parts")).cast("int"), F.lit(0))).drop("parts")


def alike(edges: DataFrame, held: DataFrame, most: int, prepare, same) -> DataFrame:
    """Of the edges (u, v, all different) those for which `same(prepare(data of u), data of v)` holds; `held` has id and data.

    The rows of a node u lie behind that node's own, so a task holds one node's data and a batch; a node with many edges is split.
    """
    dealt = hot_parts(written(edges, "edges"), "u", "v", most)
    of = held.select(F.col("id").alias("v"), "data")
    member = dealt.join(of, "v").select("u", "part", F.lit(1).alias("kind"), "v", "data")
    centre = dealt.select(F.col("u").alias("v"), "part").distinct().join(of, "v").select(F.col("v").alias("u"), "part", F.lit(0).alias("kind"), "v", "data")

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out = []
            for u, kind, v, data in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if not kind:
                    now = prepare(data)
                elif same(now, data):
                    out.append((u, v))
            at = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1])], names=["u", "v"])

    both = member.unionByName(centre).repartition("u", "part").sortWithinPartitions("u", "part", "kind")
    return both.mapInArrow(tested, "u bigint, v bigint")


def cells(members: DataFrame, member: str, most: int, weight: str | None = None, heaviest: int = 32 << 20) -> DataFrame:
    """`members`: k, the column `member` and others. Adds `cell`, so that any two members of a key meet in one of its cells.

    A key with more than `most` rows, or whose `weight` adds up to more than `heaviest`, is split: its
    members are dealt by hash into parts, and each pair of parts is a cell. All other keys have one cell.
    """
    held = _with_parts(members, "k", most, weight, heaviest)
    if held is None:
        return members.withColumn("cell", F.lit(0))
    part = F.pmod(F.xxhash64(member), F.col("parts")).cast("int")
    dealt = held.withColumn("part", part).withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    cell = F.coalesce(F.least("part", "other") * F.col("parts") + F.greatest("part", "other"), F.lit(0))
    return dealt.withColumn("cell", cell).drop("parts", "part", "other")


def runs(batches: Iterator[pa.RecordBatch], columns: int, limit: int | None = None) -> Iterator[list[np.ndarray]]:
    """Rows whose first `columns` columns agree, of batches sorted by these; rows that stand alone are left out.

    With a `limit`, a run of more rows comes in parts: the first of more than `limit` rows, others of any size.
    """
    parted: list = [None]
    held: list[np.ndarray] | None = None

    def picked(table: list[np.ndarray], starts: np.ndarray) -> list[int]:
        out = np.flatnonzero(np.diff(starts) > 1).tolist()
        more = len(starts) > 1 and starts[1] == 1 and [c[0] for c in table[:columns]] == parted
        return [0, *out] if more else out  # the single row that ends a run given in parts

    def cut(table: list[np.ndarray], last: bool):
        change = np.zeros(len(table[0]), bool)
        for c in table[:columns]:
            change[1:] |= c[1:] != c[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change), [len(change)]])
        stop = len(starts) - (1 if last else 2)
        found = [[c[starts[k] : starts[k + 1]] for c in table] for k in picked(table, starts[: stop + 1])]
        return found, [c[starts[stop] :] for c in table]

    for batch in batches:
        if batch.num_rows:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            found, held = cut(held, False)
            yield from found
            if limit and len(held[0]) > limit:
                yield held
                held, parted = [c[:0] for c in held], [c[-1] for c in held[:columns]]
    if held is not None and len(held[0]):
        yield from cut(held, True)[0]
