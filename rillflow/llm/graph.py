"""Connected components of an edge table: in one task while it is small, else by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text as T

#: Distinct edges up to which one task takes all of them (some 30 MB there); a round of joins costs the driver ten stages.
IN_ONE_TASK = 1 << 18


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges (a, b), sorted, and the smallest node of the component of each."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    to = np.arange(len(nodes))
    while len(apart := np.flatnonzero(to[a] != to[b])):
        a, b = a[apart], b[apart]
        x, y = to[a], to[b]
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while (to[to] != to).any():
            to = to[to]
    return nodes, nodes[to]


def components(edges: DataFrame, rounds: int = 60, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """node and comp (the smallest node of its component) of every node in edges (a, b: longs).

    More edges than in_one_task go through rounds: each makes every node's larger neighbours, then
    its smaller ones, point to the smallest; it ends when nothing changes, after about log(nodes) rounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if len(b)]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in least_nodes(*map(np.concatenate, zip(*pairs)))], ["node", "comp"])

    e = T.checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    if e.count() <= in_one_task:
        return e.coalesce(1).mapInArrow(run, "node long, comp long")
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = T.checkpointed(small.unionByName(low.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
