"""Connected components of a graph of integer nodes, without gathering it anywhere.

Edges are first contracted inside each partition (union-find over that partition alone). Up to ONE_TASK edges are then contracted by one task. Beyond, large-star and small-star
rounds alternate until the edges no longer change: each node learns the smallest neighbour by a pre-aggregated
minimum, and its larger neighbours are linked to that. A hub's edges are joined by a sort-merge join whose hot partition
the adaptive planner can split. Each round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm._common import materialize

MOST_ROUNDS = 60
#: Contracted edges (a forest in each partition) up to which one task, of some ten MB, finishes the work.
ONE_TASK = 200_000
#: Nodes that a task holds; below it, what a task sends is a forest of whole stars.
MOST_HELD = 1_000_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    def flush() -> pa.RecordBatch:
        pairs = [(n, r) for n in parent if (r := root(n)) != n]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                low, high = min(a, b), max(a, b)
                parent[high] = low
        if len(parent) > MOST_HELD:  # bounded memory: a partition may send several contracted pieces
            yield flush()
    yield flush()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (a > b)."""
    if large:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for each node of edges (a long, b long)."""
    now = edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a <> b")
    now = materialize(now.mapInArrow(_contract, "a long, b long").distinct(), "edges")
    if now.count() <= ONE_TASK:
        now = materialize(now.coalesce(1).mapInArrow(_contract, "a long, b long"), "edges")
        return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select("b", "b").distinct())
    state = None
    for _ in range(MOST_ROUNDS):
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == tuple(sums):
            break
        state = tuple(sums)
        if not state[0]:
            break
        now = materialize(_star(_star(now, True), False), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select("b", "b").distinct())
