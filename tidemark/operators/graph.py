"""Graph operators: connected components as DataFrame joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.staging import merged, release, stage

#: Edges that one task solves by itself; more are solved in rounds.
ONE_TASK = 500_000


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component of a bounded list of edges, by union of trees."""
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            if a != b:  # the smaller node stays the root
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for i in range(0, len(nodes), 50_000):
        some = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, kind), pa.array([root(x) for x in some], kind)], names=["node", "component"])


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """node, component: the smallest node of the component that each node is in.

    Alternating large-star and small-star steps: each links the neighbours of a node to the smallest
    node around, and after a number of rounds that grows with the logarithm of the longest path every
    node hangs at the root of its component.  The smallest neighbour is an aggregate with map-side
    combine, so a node with very many edges is no list in one task.  Each round is written to the
    shared folder.  A list of at most one_task edges is solved by one task instead, with the same
    result: rounds over few edges cost more than the edges.  A node linked to itself is a component of one; null ends are dropped; an empty
    edge list gives no rows.  RuntimeError if max_rounds did not suffice.
    """
    e = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stage(e, "cc")
    state = _state(e)
    if state[0] <= one_task:
        kind = e.schema["u"].dataType.simpleString()
        return e.coalesce(1).mapInArrow(_united, f"node {kind}, component {kind}")
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    first = e
    for _ in range(max_rounds):
        # Large star: every larger neighbour of a node goes to the smallest around it.
        both = e.where("u <> v").select("u", "v").union(e.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(merged(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: a node and its smaller neighbours go to the smallest of these.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(merged(low), "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        before, e = e, stage(small, "cc")
        if before is not first:  # the first one holds the nodes
            release(before)
        new = _state(e)
        if new == state:
            return nodes.join(merged(e.select(F.col("u").alias("node"), F.col("v").alias("component"))), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        state = new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
