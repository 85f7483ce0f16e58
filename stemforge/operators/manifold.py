"""Neighbour-graph layout: nearest neighbours by descent, a fuzzy graph of them, and gradient steps along its edges.

Neighbours start from orders along random directions, cut to leaves of a fixed number of points; each round
then compares the neighbours of a point with one another, since a neighbour's neighbour is likely to be one.
Points are dealt into blocks for that: a vector goes to a block once, however many points there have it as a
neighbour, in the numbers of its table and with its length, and a block gives out only each point's best.
Edges get weights from each point's own distances and are made symmetric. Points then move along sampled edges
in blocks: a block takes some epochs over its own points while all others stand still, then blocks exchange.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import numbered
from .store import released, stored

# Neighbours, least distance of points, steps that the layout takes, points that push an edge's end away.
NEIGHBOURS = 15
LEAST_DISTANCE = 0.3
EPOCHS = 200
PUSHES = 5

#: Points whose neighbours are compared in one task; it holds their neighbours' vectors, 2 k + 1 times as many at most.
BLOCK_POINTS = 32_768
#: Pairs found in a block after which only each point's best are kept.
HELD_PAIRS = 2_000_000

_PAIRS = "a long, b long, d double"


def unit_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): vectors of length 1; null ones and those with a null or non-finite component are left out.

    With raw and norm, the components as they are and what they are to be divided by to give v.
    """
    v = F.col("v")
    good = v.isNotNull() & ~F.coalesce(F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(True))
    raw = F.col(vector) if dict(rows.dtypes)[vector] == "array<float>" else F.col(vector).cast("array<double>")
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), raw.alias("raw")).where(good & (F.size("v") > 0))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    unit = F.transform("v", lambda c: F.coalesce(c / F.nullif(norm, F.lit(0.0)), F.lit(0.0)))
    return rows.select("id", unit.alias("v"), "raw", F.coalesce(F.nullif(norm, F.lit(0.0)), F.lit(math.inf)).alias("norm"))


def _units(raw: pa.Array, norm: pa.Array, n: int) -> np.ndarray:
    """Vectors of length 1 of n points."""
    return raw.flatten().to_numpy().reshape(n, -1) / norm.to_numpy()[:, None]


def _nearer(x: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other row, distance): the k nearest others of each row that are nearer than its bound."""
    d = np.maximum(1.0 - x @ x.T, 0.0)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    near = np.take_along_axis(d, order, 1)
    r, c = np.nonzero(near < bound[:, None])
    return r, order[r, c], near[r, c]


def _met(groups: DataFrame, k: int) -> DataFrame:
    """(a, b, d): the k nearest others of each member of a group that are nearer than its bound; groups are small lists."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("members")
            for i in range(batch.num_rows):
                group = lists[i].values
                ids = group.field("id").to_numpy()
                r, c, d = _nearer(_units(group.field("raw"), group.field("norm"), len(ids)), np.full(len(ids), np.inf), k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(ids[c]), pa.array(d)], ["a", "b", "d"])

    return groups.select("members").mapInArrow(run, _PAIRS)


def _kept(pairs: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """Of pairs (a, b, d) each once, and the k of least d of each a."""
    a, b, d = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.lexsort((b, d, a))
    a, b, d = a[order], b[order], d[order]
    # One pair from two groups may differ in the last digit, and another pair stand between: the lesser one stays.
    by = np.lexsort((d, b, a))
    first = np.ones(len(a), bool)
    first[by[1:]] = (a[by[1:]] != a[by[:-1]]) | (b[by[1:]] != b[by[:-1]])
    a, b, d = a[first], b[first], d[first]
    begin = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(begin, np.diff(np.append(begin, len(a))))
    return a[rank < k], b[rank < k], d[rank < k]


def _met_around(around: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(a, b, d): of the k nearest others in each group that are nearer than a member's bound, the k best a block.

    around: (block, pivot, id), the groups; members: (there, point, raw, norm, bound), each point of a block's groups once.
    """

    def compared(groups: pa.Table, points: pa.Table) -> pa.Table:
        ids, norm, bound = (points[c].to_numpy() for c in ("point", "norm", "bound"))
        order = np.argsort(ids)
        ids = ids[order]
        raw = points["raw"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        at, pivot = np.searchsorted(ids, groups["id"].to_numpy()).astype(np.int32), groups["pivot"].to_numpy()
        by = np.lexsort((at, pivot))
        at, pivot = at[by], pivot[by]
        cuts = np.flatnonzero(np.append(True, pivot[1:] != pivot[:-1]))
        found, held = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))], 0
        for i, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(pivot)], strict=True):
            own = at[i:z]
            place = order[own]
            r, c, d = _nearer(raw[place] / norm[place, None], bound[place], k)
            found.append((own[r], own[c], d))
            held += len(r)
            if held >= HELD_PAIRS:
                found, held = [_kept(found, k)], 0
        a, b, d = _kept(found, k)
        return pa.table([pa.array(ids[a]), pa.array(ids[b]), pa.array(d)], names=["a", "b", "d"])

    return around.groupBy("block").cogroup(members.groupBy("there")).applyInArrow(compared, _PAIRS)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    once = pairs.repartition("a").groupBy("a", "b").agg(F.min("d").alias("d"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("rank") <= k)


def neighbour_graph(vectors: DataFrame, k: int = NEIGHBOURS, trees: int = 6, leaf: int = 64, rounds: int = 10, least_change: float = 0.001, seed: int = 42, stats: list[int] | None = None, block: int = BLOCK_POINTS) -> DataFrame:
    """(a, b, d, rank): about the k nearest others of each point by cosine distance; vectors: (id, v, raw, norm) of `unit_vectors`.

    Every step compares lists of at most `leaf`, or 2 k + 1, points; those of some `block` points are in one task.
    A round ends the descent when it changes fewer than `least_change` of the edges. `stats` gets the number of
    changed edges a round.
    """
    points = stored(vectors.select("id", "v", "raw", "norm"))
    n = points.count()
    dims = len((points.select("v").first() or [[]])[0])
    rng = np.random.default_rng(seed)
    lines = F.array(*[F.struct(F.lit(t).alias("tree"), F.array(*[F.lit(float(x)) for x in rng.normal(size=dims)]).alias("line")) for t in range(trees)])
    along = F.aggregate(F.zip_with("v", "l.line", lambda x, y: x * y), F.lit(0.0), lambda s, c: s + c)
    placed = points.withColumn("l", F.explode(lines)).select("l.tree", along.alias("along"), "id")
    leaves = numbered(placed, F.col("tree"), F.col("along"), F.col("id"), name="place").select("tree", F.floor((F.col("place") - F.col("tree") * n) / leaf).alias("leaf"), "id")
    member = F.struct("id", "raw", "norm")
    found = _met(leaves.join(points.drop("v"), "id").groupBy("tree", "leaf").agg(F.collect_list(member).alias("members")), k)
    graph = stored(_best(found, k))
    some = Window.partitionBy("pivot").orderBy(F.xxhash64("pivot", "id"))
    blocks = max(1, -(-n // block))
    for _ in range(rounds):
        back = graph.select(F.col("b").alias("pivot"), F.col("a").alias("id")).withColumn("i", F.row_number().over(some)).where(F.col("i") <= k).drop("i")
        around = graph.select(F.col("a").alias("pivot"), F.col("b").alias("id")).unionByName(back).unionByName(points.select(F.col("id").alias("pivot"), "id")).distinct()
        bounds = graph.groupBy(F.col("a").alias("id")).agg(F.when(F.count("*") >= k, F.max("d")).otherwise(math.inf).alias("bound"))
        around = stored(around.withColumn("block", F.pmod(F.xxhash64("pivot"), F.lit(blocks))))
        bounded = points.select("id", "raw", "norm").join(bounds, "id", "left").select(F.col("id").alias("point"), "raw", "norm", F.coalesce("bound", F.lit(math.inf)).alias("bound"))
        wanted = around.select(F.col("id").alias("point"), F.col("block").alias("there")).groupBy("point").agg(F.collect_set("there").alias("there"))
        members = wanted.join(bounded, "point").select("point", "raw", "norm", "bound", F.explode("there").alias("there"))
        better = stored(_best(graph.select("a", "b", "d").unionByName(_met_around(around, members, k)), k))
        changed = better.join(graph, ["a", "b"], "left_anti").count()
        released(graph, around)
        graph = better
        if stats is not None:
            stats.append(changed)
        if changed <= least_change * k * n:
            break
    return graph


def fuzzy_graph(graph: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(a, b, w), both ways: how much a and b are neighbours, from each point's own scale of distances.

    A point's nearest other point has weight 1; the width makes its weights add up to log2 of the neighbours.
    The two directions are united as independent chances.
    """

    @F.pandas_udf("array<double>")
    def weights(lists: pd.Series) -> pd.Series:
        out = []
        for d in lists:
            d = np.asarray(d, float)
            gap = np.maximum(d - (d[d > 0].min() if (d > 0).any() else 0.0), 0.0)
            target, lo, hi, width = math.log2(max(k, 2)), 0.0, math.inf, 1.0
            for _ in range(64):
                total = np.exp(-gap / width).sum()
                if abs(total - target) < 1e-5:
                    break
                lo, hi = (lo, width) if total > target else (width, hi)
                width = (lo + hi) / 2 if hi < math.inf else width * 2
            out.append(np.exp(-gap / max(width, 1e-3 * d.mean(), 1e-12)))
        return pd.Series(out)

    lists = graph.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("d", "b"))).alias("near"))
    one = lists.select("a", F.explode(F.arrays_zip(F.col("near.b").alias("b"), weights(F.col("near.d")).alias("w"))).alias("e")).select("a", "e.b", "e.w")
    pair = one.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("s"), F.count("*").alias("n"), F.product("w").alias("p"))
    both = pair.select("a", "b", F.when(F.col("n") == 2, F.col("s") - F.col("p")).otherwise(F.col("s")).alias("w"))
    return both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def curve(least_distance: float = LEAST_DISTANCE, spread: float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + a x^(2 b)), fitted to 1 up to the least distance and an exponential fall behind it."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < least_distance, 1.0, np.exp(-(x - least_distance) / spread))
    p, damp = np.array([1.0, 1.0]), 1e-3

    def rest(p):
        return 1 / (1 + p[0] * x ** (2 * p[1])) - y

    for _ in range(200):
        t = x ** (2 * p[1])
        f = 1 / (1 + p[0] * t)
        jac = np.stack([-f * f * t, -f * f * p[0] * t * 2 * np.log(x)], axis=1)
        step = np.linalg.solve(jac.T @ jac + damp * np.eye(2), -jac.T @ rest(p))
        if (rest(p + step) ** 2).sum() < (rest(p) ** 2).sum():
            p, damp = p + step, damp / 3
        else:
            damp *= 3
    return float(p[0]), float(p[1])


def _epochs(place: np.ndarray, head: np.ndarray, tail: np.ndarray, still: np.ndarray, w: np.ndarray, pool: np.ndarray, span: tuple[int, int, int], ab: tuple[float, float], rng) -> np.ndarray:
    """Epochs span[0] to span[1] of span[2] over one block's own points.

    head: own point of each directed edge; tail: its other end, own if under len(place), else a row of `still`.
    """
    a, b = ab
    n = len(place)
    for e in range(span[0], span[1]):
        active = np.floor((e + 1) * w) > np.floor(e * w)  # an edge of weight w (1 at most) takes part w times an epoch
        h, t = head[active], tail[active]
        if not len(h):
            continue
        alpha = 1.0 - e / span[2]
        other = np.where((t < n)[:, None], place[np.minimum(t, n - 1)], still[np.maximum(t - n, 0)] if len(still) else 0.0)
        diff = place[h] - other
        d2 = (diff * diff).sum(1)
        safe = np.maximum(d2, 1e-12)
        pull = np.where(d2 > 0, -2 * a * b * safe ** (b - 1) / (1 + a * safe**b), 0.0)
        move = np.clip(pull[:, None] * diff, -4, 4)
        far = np.repeat(place[h], PUSHES, axis=0) - pool[rng.integers(0, len(pool), len(h) * PUSHES)]
        f2 = (far * far).sum(1)
        push = 2 * b / ((0.001 + f2) * (1 + a * f2**b))
        away = np.where((f2 > 0)[:, None], np.clip(push[:, None] * far, -4, 4), 0.0)
        step = np.zeros_like(place)
        np.add.at(step, h, move + away.reshape(len(h), PUSHES, -1).sum(1))
        place = place + alpha * step / np.maximum(np.bincount(h, minlength=n), 1)[:, None]  # the mean: a sum would throw busy points past their place
    return place


def _mover(pool: np.ndarray, span: tuple[int, int, int], ab: tuple[float, float], seed: int):
    """What a task does with one block: its edges (block, a, b, w) and the positions of their ends (point, p) to (id, p)."""

    def moved(lines: pa.Table, ends: pa.Table) -> pa.Table:
        a, b, w = (lines[c].to_numpy() for c in ("a", "b", "w"))
        by = np.lexsort((b, a))
        a, b, w = a[by], b[by], w[by]
        points = ends["point"].to_numpy()
        order = np.argsort(points)
        points, at = points[order], ends["p"].combine_chunks().flatten().to_numpy().reshape(len(order), -1)[order]
        ids, head = np.unique(a, return_inverse=True)
        tail = np.minimum(np.searchsorted(ids, b), len(ids) - 1)
        still = ids[tail] != b
        tail[still] = len(ids) + np.arange(still.sum())
        rng = np.random.default_rng([seed, span[0], lines["block"][0].as_py()])
        place = _epochs(at[np.searchsorted(points, ids)], head, tail, at[np.searchsorted(points, b[still])], w, pool, span, ab, rng)
        return pa.table({"id": ids, "p": pa.array(list(place), pa.list_(pa.float64()))})

    return moved


def graph_layout(edges: DataFrame, start: DataFrame, epochs: int = EPOCHS, turns: int = 20, block: int = 20_000, pool: int = 1024, least_distance: float = LEAST_DISTANCE, seed: int = 42) -> DataFrame:
    """(id, p): positions after `epochs` of gradient steps; edges: (a, b, w) both ways, start: (id, p).

    Points are dealt into blocks of `block` along the first coordinate. In each of `turns` turns a task moves
    one block's points along their edges, by epochs in which all moves see the same positions; ends in other blocks
    stand still until the turn is over. Points that push are drawn from `pool` ones, drawn anew each turn. A
    task holds a block's points and their edges. Edges know their block; a turn sends it them and the position
    of each point that they end at, once.
    """
    ab = curve(least_distance)
    places = stored(numbered(start.select("id", "p"), F.col("p")[0], F.col("id"), name="n").select("id", F.floor(F.col("n") / block).alias("block"), "p"))
    top = edges.agg(F.max("w").alias("w")).first()["w"]
    if top is None:
        return places.select("id", "p")
    lines = stored(edges.select("a", "b", (F.col("w") / top).alias("w")).join(places.select(F.col("id").alias("a"), "block"), "a").select("block", "a", "b", "w"))
    ends = lines.select(F.col("a").alias("point"), F.col("block").alias("there")).unionByName(lines.select(F.col("b").alias("point"), F.col("block").alias("there")))
    wanted = stored(ends.groupBy("point").agg(F.collect_set("there").alias("there")))
    for turn in range(turns):
        drawn = np.array([r["p"] for r in places.orderBy(F.xxhash64(F.lit(seed), F.lit(turn), "id")).limit(pool).select("p").collect()])
        span = (epochs * turn // turns, epochs * (turn + 1) // turns, epochs)

        sent = wanted.join(places.select(F.col("id").alias("point"), "p"), "point").select("point", "p", F.explode("there").alias("there"))
        new = lines.groupBy("block").cogroup(sent.groupBy("there")).applyInArrow(_mover(drawn, span, ab, seed), "id long, p array<double>")
        before = places
        places = stored(before.select("id", "block", F.col("p").alias("old")).join(new, "id", "left").select("id", "block", F.coalesce("p", "old").alias("p")))
        released(before)
    return places.select("id", "p")


def manifold(rows: DataFrame, key: str = "id", vector: str = "vector", k: int = NEIGHBOURS, components: int = 3, epochs: int = EPOCHS, turns: int = 20, block: int = 20_000, seed: int = 42) -> DataFrame:
    """(id, p): vectors reduced to `components` positions by the graph of their nearest neighbours.

    Starts from principal components. Null vectors and those with a null or non-finite component have no
    position; a single point is the origin.
    """
    from .layout import reduced

    points = stored(unit_vectors(rows, key, vector))
    some = points.select("v").head(2)
    if len(some) < 2:
        return points.select("id", F.transform(F.slice("v", 1, components), lambda c: c * 0).alias("p"))
    first = some[0]
    start = stored(reduced(points.select("id", "v"), min(components, len(first["v"])), "v").select("id", F.col("position").alias("p")))
    widest = start.agg(F.max(F.array_max(F.transform("p", lambda c: F.abs(c)))).alias("w")).first()["w"] or 1.0
    apart = F.transform("p", lambda c, i: c * 10 / widest + (F.pmod(F.xxhash64(F.col("id"), i), F.lit(1000)) / 1e6))  # equal points part
    edges = fuzzy_graph(neighbour_graph(points, k, seed=seed), k)
    return graph_layout(edges, start.select("id", apart.alias("p")), epochs, turns, block, seed=seed)
