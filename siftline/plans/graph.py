"""Graphs of code and environments: reachability, taint, import chains, patches. After a design, not after code.

Edges have src, dst and edge_type (CALLS, DEPENDS_ON, ASSIGNS, PASSES_ARG).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.plans.shared import written


def reachable(edges: DataFrame, starts: DataFrame, edge_types: list[str] | None = None, max_hops: int | None = None) -> DataFrame:
    """start, node, hops: each other node that directed edges reach from each start, at its least number of hops.

    Breadth first: each round joins the newest (start, node) with the edges and
    drops those seen before, so cycles end and work grows with what is reached,
    not with the number of paths. Rounds are tables in the shared folder. Without
    `max_hops` they end when there is nothing new. Null nodes take no part.
    """
    used = edges.filter(F.col("edge_type").isin(edge_types)) if edge_types else edges
    used = used.select("src", "dst").dropna().distinct()
    newest = written(starts.select(F.col("id").alias("start"), F.col("id").alias("node")).dropna().distinct(), "start")
    seen, rounds, hops = newest, [], 0
    while max_hops is None or hops < max_hops:
        hops += 1
        step = newest.join(used, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        newest = written(step.join(seen, ["start", "node"], "left_anti"), "round")
        if newest.isEmpty():
            break
        rounds.append(newest.withColumn("hops", F.lit(hops).cast("long")))
        # as one table, so that plans don't grow with the rounds
        seen = written(seen.unionByName(newest), "seen") if hops % 8 == 0 else seen.unionByName(newest)
    if not rounds:
        return newest.limit(0).withColumn("hops", F.lit(0).cast("long"))
    return reduce(DataFrame.unionByName, rounds)


def taint(edges: DataFrame, nodes: DataFrame, entry_envs: list[str], sink_envs: list[str], max_hops: int | None = None) -> DataFrame:
    """start, node, hops where a node of an entry environment reaches one of a sink environment."""
    entries = nodes.filter(F.col("env").isin(entry_envs)).select("id")
    sinks = nodes.filter(F.col("env").isin(sink_envs)).select(F.col("id").alias("node"))
    return reachable(edges, entries, None, max_hops).join(sinks, "node", "left_semi").select("start", "node", "hops")


def import_chains(edges: DataFrame, starts: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Reachability over DEPENDS_ON alone."""
    return reachable(edges, starts, ["DEPENDS_ON"], max_hops)


def patched(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """The nodes with those of each changed file replaced by `changed`."""
    return nodes.join(changed.select("file").distinct(), "file", "left_anti").select(*nodes.columns).unionByName(changed.select(*nodes.columns))


def read_graph(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a graph file: JSON with `nodes` and `edges` arrays of objects."""
    graph = spark.read.json(path, multiLine=True)
    return graph.select(F.inline("nodes")), graph.select(F.inline("edges"))
