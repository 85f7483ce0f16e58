"""Closures, percent ranks and medians against plain restatements."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from stemforge.operators import families, graph, ranks


def test_a_chain_of_a_thousand_in_ten_rounds(spark):
    edges = spark.range(1000).select(F.col("id").alias("child"), (F.col("id") + 1).alias("parent"))
    stats = []
    got = families.closure(edges, stats=stats)
    assert len(stats) <= 10 and got.count() == 1000 * 1001 // 2
    assert got.where("ancestor - child <> depth").count() == 0


def test_closure_of_a_graph_with_cycles(spark):
    rng = random.Random(2)
    links = {(rng.randrange(40), rng.randrange(40)) for _ in range(70)}
    edges = spark.createDataFrame(sorted(links), "child int, parent int")
    for most in (3, 64):
        expected = {}
        for s in range(40):
            seen, level = {s: 0}, [s]
            for depth in range(1, most + 1):
                level = sorted({p for c, p in links if c in level and p not in seen})
                seen.update(dict.fromkeys(level, depth))
            expected.update({(s, a): d for a, d in seen.items() if d})
        assert {(r["child"], r["ancestor"]): r["depth"] for r in families.closure(edges, most).collect()} == expected
    walked = graph.ancestors(edges, spark.range(40).select(F.col("id").cast("int").alias("node")), 3).where("depth > 0 and start <> ancestor").groupBy("start", "ancestor").agg(F.min("depth").alias("d"))
    assert {(r["start"], r["ancestor"]): r["d"] for r in walked.collect()} == {(r["child"], r["ancestor"]): r["depth"] for r in families.closure(edges, 3).collect()}
    assert families.closure(edges.limit(0)).count() == 0


def test_percent_ranks_with_ties_over_ranges(spark):
    rows = [(i, 5 if i % 3 == 0 else i % 50) for i in range(1000)] + [(2000, None)]
    got = {r["i"]: r["percent_rank"] for r in ranks.percent_ranked(spark.createDataFrame(rows, "i int, v int").repartition(7), "v").collect()}
    values = sorted(v for _, v in rows if v is not None)
    assert got == {i: None if v is None else values.index(v) / 999 for i, v in rows}
    assert [r["percent_rank"] for r in ranks.percent_ranked(spark.createDataFrame([(1, 3)], "i int, v int"), "v").collect()] == [0.0]


@pytest.mark.parametrize("few", [3, 10_000])
def test_medians_are_exact(spark, few):
    rng = random.Random(3)
    groups = {"big": [rng.lognormvariate(0, 4) for _ in range(2001)], "even": [rng.gauss(0, 1) for _ in range(1000)], "same": [2.5] * 500, "tail": [1e-300 * i for i in range(30)] + [1e300, -1e300], "one": [7.0], None: [1.0, 2.0, float("nan"), None], "none": [None]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    got = {r["g"]: r["median"] for r in ranks.medians(spark.createDataFrame(rows, "g string, v double").repartition(5), "g", "v", buckets=16, few=few).collect()}
    for g, vs in groups.items():
        known = [v for v in vs if v is not None and v == v]
        assert got[g] == (statistics.median(known) if known else None), g


def test_median_of_many_rows(spark):
    """Ten million rows, most of them of one value, without a group's values in a task."""
    rows = spark.range(10_000_000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 5 < 3, 0.5).otherwise(F.col("id") / 10_000_000).alias("v"))
    got = {r["g"]: r["median"] for r in ranks.medians(rows, "g", "v").collect()}
    expected = {r["g"]: r["m"] for r in rows.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert got == expected
