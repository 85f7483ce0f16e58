"""Operators whose original is a loop in a fixed order: the same results by rounds that run side by side."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stemforge.operators import layout
from stemforge.operators.adoption import adopt_in_order

WORDS = "lemma string, ord struct<a:int,b:int>, root_key string, derived array<string>"


def plain_adoption(rows):
    key = {w: k for w, _, k, _ in rows if k is not None}
    named = {}
    for w, _, _, ds in rows:
        for d in ds:
            if d != w:
                named.setdefault(d, []).append(w)
    for w, _, k, ds in rows:
        if k is None:
            found = next((key[p] for p in named.get(w, ()) if p in key), None) or next((key[d] for d in ds if d in key), None)
            if found is not None:
                key[w] = found
    return {w: key.get(w) for w, *_ in rows}


def adopted(spark, rows):
    stats = []
    df = spark.createDataFrame([(w, (o // 2, o % 2), k, ds) for w, o, k, ds in rows], WORDS).repartition(3)
    return {r["lemma"]: r["root_key"] for r in adopt_in_order(df, stats).collect()}, stats


@pytest.mark.parametrize("seed", [1, 2])
def test_adoption_equals_the_loop(spark, seed):
    """Random links with cycles, words that name themselves and words that are not there; long chains in one of them."""
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(150)]
    rows = []
    for i, w in enumerate(names):
        ds = [rng.choice([*names, w, "elsewhere"]) for _ in range(rng.choice([0, 0, 1, 1, 2, 3]))]
        if seed == 2 and i and rng.random() < 0.9:
            ds = [names[i - 1], *ds[:1]]
        rows.append((w, i, f"k{i}" if rng.random() < 0.06 else None, ds))
    got, _ = adopted(spark, rows)
    assert got == plain_adoption(rows) and 0 < sum(v is None for v in got.values()) < 150


def test_adoption_halves_chains(spark):
    rows = [(f"w{i}", i, "k" if i == 0 else None, [f"w{i - 1}"] if i else []) for i in range(300)]
    got, stats = adopted(spark, rows)
    assert set(got.values()) == {"k"} and len(stats) <= 10
    assert adopted(spark, [])[0] == {} and adopted(spark, [("a", 0, None, ["a", "b"])])[0] == {"a": None}


def plain_nudge(points, edges, passes):
    at = {i: [x, z] for i, x, z in points}
    for _ in range(passes):
        for a, b, kind in edges:
            if a not in at or b not in at:
                continue
            p, q = at[a], at[b]
            dx, dz = q[0] - p[0], q[1] - p[1]
            d = math.sqrt(dx * dx + dz * dz)
            if d < 1:
                continue
            pull = min(0.02 * layout.EDGE_WEIGHTS.get(kind, 0.1) * d, 5.0)
            nx, nz = dx / d, dz / d
            p[0] += nx * pull
            p[1] += nz * pull
            q[0] -= nx * pull
            q[1] -= nz * pull
    return {i: tuple(v) for i, v in at.items()}


def test_nudge_in_order_equals_the_loop_digit_by_digit(spark):
    rng = random.Random(4)
    points = [(i, rng.uniform(-200, 200), rng.uniform(-200, 200)) for i in range(200)] + [(900, 1.0, 1.0), (901, 1.2, 1.0)]
    edges = [(rng.randrange(210), rng.randrange(200), rng.choice([*layout.EDGE_WEIGHTS, "other"])) for _ in range(260)] + [(900, 901, "compound"), (7, 7, "field")] + [(1, 2, "compound")] * 3
    at = spark.createDataFrame([(i, x, z, "kept") for i, x, z in points], "id int, x double, z double, more string").repartition(3)
    lines = spark.createDataFrame([(n, a, b, k) for n, (a, b, k) in enumerate(edges)], "ord int, a int, b int, kind string").repartition(3)
    got = {r["id"]: (r["x"], r["z"]) for r in layout.nudge_in_order(at, lines, 2).collect()}
    assert got == plain_nudge(points, edges, 2)
    with pytest.raises(ValueError, match="steps one after the other"):
        layout.nudge_in_order(at, lines, 2, most_steps=5)
    assert layout.nudge_in_order(at.where("id < 0"), lines, 2).count() == 0
    assert {r["x"] for r in layout.nudge_in_order(at.where("id >= 900"), lines.where("ord < 0")).collect()} == {1.0, 1.2}
