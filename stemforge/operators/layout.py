"""Centroids, scaling, neighbours, overlaps, fields of height, and refinement of positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import fractal_noise, gaussian, unit_scale
from . import spatial
from .order import numbered
from .ranks import medians
from .spatial import nearest  # noqa: F401
from .store import released, stored

# Pull of each kind of edge, spacing of discs, world side, height range, sea level, spread of an island.
EDGE_WEIGHTS = {"compound": 3.0, "semantic": 0.3, "etymology": 0.5, "field": 0.1}
SPACING = 1.3
WORLD = 400.0
HEIGHTS = 12.0
SEA = -0.3
SIGMA_OF_RADIUS = 2.0


def centroids(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, dim, value, n): mean of each dimension, as long rows; a partial aggregate, no list is held."""
    return rows.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"), F.count("*").alias("n"))


def word_vectors(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vector of each word: of its own form, else of the lower-case, else of the capitalised one."""
    from ..functions.text import capitalised

    tries = words.select("id", F.posexplode(F.array("lemma", F.lower("lemma"), capitalised(F.col("lemma")))).alias("rank", "word"))
    return tries.join(vectors.select("word", "vector"), "word").groupBy("id").agg(F.min_by("vector", "rank").alias("vector"))


def scaled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to 0 to 1 by bounds that one aggregate row carries; a constant column is 0.5."""
    bounds = rows.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    joined = rows.crossJoin(F.broadcast(bounds))  # bounds is one row
    return joined.withColumns({c: unit_scale(F.col(c), F.col(f"__lo_{c}"), F.col(f"__hi_{c}")) for c in columns}).drop(*bounds.columns)


def world_fit(rows: DataFrame, x: str = "x", z: str = "z", size: float = 370.0) -> DataFrame:
    """Centre positions and scale both axes alike, so that the longer side is `size`."""
    b = rows.agg(F.min(x).alias("__x0"), F.max(x).alias("__x1"), F.min(z).alias("__z0"), F.max(z).alias("__z1"))
    scale = F.lit(size) / F.greatest(F.col("__x1") - F.col("__x0"), F.col("__z1") - F.col("__z0"), F.lit(1.0))
    joined = rows.crossJoin(F.broadcast(b))  # one row
    return joined.withColumns({x: (F.col(x) - (F.col("__x0") + F.col("__x1")) / 2) * scale, z: (F.col(z) - (F.col("__z0") + F.col("__z1")) / 2) * scale}).drop(*b.columns)


def overlaps(discs: DataFrame, spacing: float = SPACING, key: str = "id") -> DataFrame:
    """Pairs of discs nearer than their spaced radii, a < b."""
    return spatial.overlaps(discs, spacing, key)


def height_field(grid: DataFrame, islands: DataFrame, base: float = SEA) -> DataFrame:
    """Greatest height that any island leaves at each grid point, and at least the base.

    islands: x, z, height, sigma. An island counts up to 4 sigma, and is met on a grid of cells of that size. A place
    is asked once, however many grid points it has, and of islands that differ in height alone the highest counts.
    """
    highest = islands.groupBy("x", "z", "sigma").agg(F.max("height").alias("height"))
    places = stored(grid.select(F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z")).distinct().where("x is not null and z is not null"))
    met = spatial.in_reach(places, highest.select("x", "z", "height", "sigma", (F.col("sigma") * 4).alias("reach")), "reach")
    dx, dz = F.col("x") - F.col("i_x"), F.col("z") - F.col("i_z")
    lifts = met.select("x", "z", gaussian(F.col("i_height"), dx * dx + dz * dz, F.col("i_sigma")).alias("lift")).where("lift > %r" % base)
    lifted = stored(lifts.groupBy("x", "z").agg(F.max("lift").alias("lift")))
    at = grid.distinct().join(lifted.hint("merge"), ["x", "z"], "left")
    return at.select(*grid.columns, F.coalesce("lift", F.lit(base)).alias("height"))


def terrain(grid: DataFrame, islands: DataFrame, frequency: float = 0.015, above: float = 0.8, below: float = 0.3) -> DataFrame:
    """The height field with fractal noise on it, stronger on land than under water; islands: x, z, height, radius."""
    spread = islands.select("x", "z", "height", (F.col("radius") * SIGMA_OF_RADIUS).alias("sigma"))
    rough = fractal_noise(F.col("x") * frequency, F.col("z") * frequency)
    return height_field(grid, spread).withColumn("height", F.col("height") + rough * F.when(F.col("height") > 0, above).otherwise(below))


def world_place(positions: DataFrame) -> DataFrame:
    """Reduced positions (x, z, height) scaled into the world: sides of WORLD about 0, heights up to HEIGHTS."""
    unit = scaled(positions, ["x", "z", "height"])
    return unit.withColumns({"x": F.col("x") * WORLD - WORLD / 2, "z": F.col("z") * WORLD - WORLD / 2, "height": F.col("height") * HEIGHTS})


def edge_lengths(edges: DataFrame, positions: DataFrame, kind: str = "kind") -> DataFrame:
    a = positions.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("z").alias("az"))
    b = positions.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("z").alias("bz"))
    d = F.hypot(F.col("ax") - F.col("bx"), F.col("az") - F.col("bz"))
    rows = stored(edges.join(a, "a").join(b, "b").select(kind, d.alias("d")))
    middle = medians(rows, kind, "d").select(F.col(kind).alias("__kind"), F.col("median").alias("median_d"))
    found = rows.groupBy(kind).agg(F.count("*").alias("n"), F.avg("d").alias("avg_d"), F.max("d").alias("max_d"))
    return found.join(middle, F.col(kind).eqNullSafe(F.col("__kind"))).select(kind, "n", "avg_d", "median_d", "max_d")


def height_stats(rows: DataFrame, column: str = "height") -> DataFrame:
    return rows.agg(F.min(column).alias("min_h"), F.max(column).alias("max_h"), F.avg(column).alias("avg_h"), F.stddev_pop(column).alias("std_h"))


def nudge(positions: DataFrame, edges: DataFrame, passes: int = 10, weight: Column | None = None) -> DataFrame:
    """Pull the ends of edges together; all pulls of a pass see the same positions, so no order matters.

    edges: a, b, kind. An edge under length 1 pulls nothing and no pull is over 5. Every pass is stored.
    """
    w = weight if weight is not None else F.coalesce(F.create_map(*[F.lit(x) for kv in EDGE_WEIGHTS.items() for x in kv])[F.col("kind")], F.lit(0.1))
    both = edges.select("a", "b", (w * 0.02).alias("w")).union(edges.select(F.col("b"), F.col("a"), (w * 0.02).alias("w")))
    now = positions
    for _ in range(passes):
        p = now.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("z").alias("az"))
        q = now.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("z").alias("bz"))
        d = F.hypot(F.col("bx") - F.col("ax"), F.col("bz") - F.col("az"))
        part = both.join(p, "a").join(q, "b").withColumn("d", d).where("d >= 1").withColumn("pull", F.least(F.col("w") * F.col("d"), F.lit(5.0)) / F.col("d"))
        moves = part.groupBy(F.col("a").alias("id")).agg(F.sum((F.col("bx") - F.col("ax")) * F.col("pull")).alias("mx"), F.sum((F.col("bz") - F.col("az")) * F.col("pull")).alias("mz"))
        now = stored(now.join(moves, "id", "left").select(*[(F.col(c) + F.coalesce(f"m{c}", F.lit(0.0))).alias(c) if c in ("x", "z") else c for c in now.columns]))
    return now


def nudge_in_order(positions: DataFrame, edges: DataFrame, passes: int = 10, weight: Column | None = None, order: str = "ord", most_steps: int = 5_000, at_once: int = 8) -> DataFrame:
    """Pull the ends of edges together one edge after the other, `passes` times over; later pulls see earlier ones.

    edges: a, b, kind and a column that orders them totally. An edge waits for the edges before it at its two ends
    only, so each point carries the list of its own edges and the step that it waits for, and all edges whose
    two ends wait for them are pulled at once: a round is one grouping of the points by step. The result is
    that of the plain loop, digit by digit. Rounds are at least the edges of the busiest point times `passes`,
    which is an error over `most_steps`: `nudge` needs no order. A point that edges name and that is not in
    `positions` drops those edges; an edge under length 1 pulls nothing; no pull is over 5.
    """
    w = weight if weight is not None else F.coalesce(F.create_map(*[F.lit(x) for kv in EDGE_WEIGHTS.items() for x in kv])[F.col("kind")], F.lit(0.1))
    ids = positions.select("id")
    known = edges.where("a <> b").join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    steps = stored(numbered(known.select("a", "b", (F.lit(0.02) * w).alias("w"), order), F.col(order), name="n"))
    m = steps.count()
    ends = steps.select(F.col("a").alias("id"), "n", "w", F.lit(True).alias("first")).unionByName(steps.select(F.col("b").alias("id"), "n", "w", F.lit(False).alias("first")))
    busiest = ends.groupBy("id").count().agg(F.max("count").alias("c")).first()["c"] or 0
    if busiest * passes > most_steps:
        raise ValueError(f"a point has {busiest} edges: over {most_steps} steps one after the other")
    own = ends.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "w", "first"))).alias("own"))
    at = positions.select("id", F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z")).join(own, "id", "left").withColumns({"i": F.lit(0), "turn": F.lit(0).cast("long")})

    def waiting(rows: DataFrame) -> DataFrame:
        return rows.withColumn("s", F.when((F.col("turn") < passes) & (F.size("own") > 0), F.col("turn") * m + F.col("own")[F.col("i")]["n"]))

    now = stored(waiting(at.withColumn("own", F.coalesce("own", F.array().cast(own.schema["own"].dataType)))))
    while not now.where("s is not null").isEmpty():
        before, rows = now, now
        for _ in range(at_once):
            rows = waiting(_pulled(rows))
        now = stored(rows)
        released(before)
    found = now.select("id", F.col("x").alias("__x"), F.col("z").alias("__z"))
    return positions.join(found, "id").select(*[F.col(f"__{c}").alias(c) if c in ("x", "z") else c for c in positions.columns])


def _pulled(rows: DataFrame) -> DataFrame:
    """One round: points that wait for the same step are its edge's two ends (a step has no others)."""
    met = rows.groupBy("s", F.when(F.col("s").isNull(), F.col("id")).alias("alone")).agg(F.collect_list(F.struct("id", "x", "z", "own", "i", "turn")).alias("ends"))
    edge = F.col("ends")[0]["own"][F.col("ends")[0]["i"]]
    a, b = F.when(edge["first"], F.col("ends")[0]).otherwise(F.col("ends")[1]), F.when(edge["first"], F.col("ends")[1]).otherwise(F.col("ends")[0])
    pair = F.size("ends") == 2
    apart = met.select("ends", F.when(pair, edge["w"]).alias("w"), F.when(pair, b["x"] - a["x"]).alias("dx"), F.when(pair, b["z"] - a["z"]).alias("dz"), pair.alias("pair"))
    apart = apart.withColumn("d", F.sqrt(F.col("dx") * F.col("dx") + F.col("dz") * F.col("dz"))).withColumn("pull", F.least(F.col("w") * F.col("d"), F.lit(5.0)))
    one = apart.select(F.explode("ends").alias("e"), "dx", "dz", "d", "pull", "pair").select("e.*", "dx", "dz", "d", "pull", "pair")
    first = F.col("own")[F.col("i")]["first"]

    def moved(c: str) -> Column:
        step = F.col(f"d{c}") / F.col("d") * F.col("pull")
        return F.when(F.col("pair") & (F.col("d") >= 1), F.when(first, F.col(c) + step).otherwise(F.col(c) - step)).otherwise(F.col(c)).alias(c)

    last = F.col("i") + 1 == F.size("own")
    return one.select("id", moved("x"), moved("z"), "own", F.when(~F.col("pair"), F.col("i")).when(last, 0).otherwise(F.col("i") + 1).alias("i"), (F.col("turn") + F.when(F.col("pair") & last, 1).otherwise(0)).alias("turn"))


def separate(discs: DataFrame, passes: int = 500, spacing: float = SPACING) -> DataFrame:
    """Push overlapping discs apart until none overlap, or `passes` are over: a sequential rule over some hundreds
    of discs, in one task. `overlaps` tells what is left.
    """

    def push(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(parts)
        if not got:
            return
        rows = pd.concat(got).sort_values("id", kind="stable").reset_index(drop=True)
        p, r = rows[["x", "z"]].to_numpy(float).copy(), rows["radius"].to_numpy(float)
        rng = np.random.default_rng(42)
        for _ in range(passes):
            calm = True
            for i in range(len(p) - 1):
                d = p[i] - p[i + 1 :]
                near = np.flatnonzero(np.hypot(d[:, 0], d[:, 1]) < (r[i] + r[i + 1 :]) * spacing)
                for j in near + i + 1:
                    v = p[i] - p[j]
                    dist = float(np.hypot(*v))
                    gap = (r[i] + r[j]) * spacing - dist
                    if gap <= 0:
                        continue
                    calm = False
                    if dist < 0.01:
                        angle = rng.uniform(0, 2 * np.pi)
                        v, dist = np.array([np.cos(angle), np.sin(angle)]), 1.0
                    step = v / dist * (gap / 2 + 0.5)
                    p[i] += step
                    p[j] -= step
            if calm:
                break
        rows["x"], rows["z"] = p[:, 0], p[:, 1]
        yield rows

    return discs.coalesce(1).mapInPandas(push, discs.schema)


def reduced(vectors: DataFrame, k: int = 3, vector: str = "vector") -> DataFrame:
    """Principal components of vectors; stands in for a manifold layout, to which it is not equal."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    return PCA(k=k, inputCol="__v", outputCol="__p").fit(rows).transform(rows).withColumn("position", vector_to_array("__p")).drop("__v", "__p")


def fallback_positions(clusters: DataFrame, order: Column, spacing: float = 25.0) -> DataFrame:
    """Grid places for clusters without a position, numbered among themselves in a total order; others keep theirs."""
    from ..functions.geometry import grid_place

    bare = F.col("x").isNull() | F.col("z").isNull()
    total = F.broadcast(clusters.agg(F.count("*").alias("__n")))  # one row
    gx, gz = grid_place(F.col("__i"), F.col("__n"), spacing)
    placed = numbered(clusters.where(bare), order, name="__i").crossJoin(total).withColumn("z", F.coalesce("z", gz)).withColumn("x", F.coalesce("x", gx))
    return clusters.where(~bare).unionByName(placed.select(*clusters.columns))


def attach_positions(clusters: DataFrame, layout: DataFrame, key: str = "cluster") -> DataFrame:
    """Clusters with `position` (x, z, height) from a layout table by root id; null where it has none."""
    place = F.struct("x", "z", F.col("island_height").alias("height"))
    return clusters.join(layout.select(F.col("root_id").alias(key), place.alias("position")), key, "left")


def vector_counts(words: DataFrame, vectors: DataFrame, group: str = "cluster") -> DataFrame:
    """One row: words with and without a vector, groups with any, and groups without one."""
    found = words.select("id", group).join(word_vectors(words, vectors).select("id", F.lit(True).alias("hit")), "id", "left")
    hit = F.coalesce("hit", F.lit(False))
    groups = found.groupBy(group).agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"))
    return groups.agg(
        F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.coalesce(F.sum("misses"), F.lit(0)).alias("misses"),
        F.count_if(F.col("hits") > 0).alias("placed"), F.count_if(F.col("hits") == 0).alias("missing"),
    )
