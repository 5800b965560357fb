"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, rows

#: Edges that one task may hold.
ONE_TASK = 1_000_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours (the larger ones, or the smaller ones and itself) to its least neighbour."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _forest(batches):
    """Components of all edges of a task, by union and find."""
    up: dict[int, int] = {}

    def find(i: int) -> int:
        up.setdefault(i, i)
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for us, vs in rows(batches, "u", "v"):
        for u, v in zip(us, vs, strict=True):
            a, b = find(u), find(v)
            up[max(a, b)] = min(a, b)
    ids = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(i) for i in ids], pa.int64())], names=["id", "component"])


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """id, component (its least id) of every node that has an edge. ``edges``: u long, v long, no nulls.

    At most ONE_TASK edges (16 MB, counted first) are one task's union and find; more go round by round.
    Each round is written to the shared folder; it ends when a round changes nothing. Only counts and
    sums come to the driver.
    """
    if edges.limit(ONE_TASK + 1).count() <= ONE_TASK:
        return scratch(map_arrow(edges.select("u", "v").coalesce(1), _forest, "id long, component long"), "components")
    edges = scratch(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "stars")
    size = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).alias("x")
    before = edges.select(size).first()["x"]
    for _ in range(rounds):
        last, edges = edges, scratch(_star(_star(edges, True), False), "stars")
        scratch.drop(last)
        now = edges.select(size).first()["x"]
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = now
    raise RuntimeError("the components did not settle")
