"""Connected components by alternating large-star and small-star steps, each a join and an aggregate.

No neighbour list is ever gathered: a step joins the edges with the least neighbour of their end, so a
hub's edges stay rows that a skewed join can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut, discard

#: Most edges that are taken by one task, 3 MB, as steps over few edges cost more to start than to run.
FEW = 200_000


def _least(sym: DataFrame) -> DataFrame:
    return sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    sym = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return sym.join(_least(sym), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of the ends of all edges of the task but the least of each component, by union of sets."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = top(u), top(v)
            above[max(u, v)] = min(u, v)
    nodes = [x for x, up in above.items() if x != up]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (any direction, repeats allowed). Gives (node, component): the least node reachable.

    A few edges are united by one task. Of more, steps are repeated until one changes nothing; their number grows with the logarithm of a path's length.
    """
    now = cut(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if now.count() <= FEW:
        return now.coalesce(1).mapInArrow(_united, "node long, component long")
    mark = None
    while True:
        told = Observation()
        step = cut(_small_star(_large_star(now)).distinct().observe(told, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        discard(now)
        now, seen = step, told.get
        if seen == mark:
            break
        mark = seen
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
