"""Chains, walks, pairs and compound edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import etymology, geometry
from ..operators import graph
from .registry import Tables, query

_STAGES = """
    s AS (SELECT o_orderkey AS id, unnest([concat('region:', r_regionkey), concat('nation:', n_nationkey), concat('customer:', c_custkey), concat('order:', o_orderkey)]) AS node, unnest([1, 2, 3, 4]) AS i
          FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
"""


def _chains(t: Tables):
    """Region, nation, customer, order as stages from the oldest to the newest."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    stage = lambda name, c: F.struct(F.lit(name).alias("stage"), F.col(c).cast("string").alias("form"))
    return rows.select(F.col("o_orderkey").alias("id"), F.array(stage("region", "r_regionkey"), stage("nation", "n_nationkey"), stage("customer", "c_custkey"), stage("order", "o_orderkey")).alias("chain"))


@query(f"""
    WITH {_STAGES}, e AS (SELECT node AS newer, lag(node) OVER (PARTITION BY id ORDER BY i) AS older FROM s)
    SELECT newer, older, CASE WHEN starts_with(older, 'nation:') THEN 'borrowed_from' ELSE 'descends_from' END AS edge_type, count(*) AS n FROM e WHERE older IS NOT NULL AND newer <> older GROUP BY ALL
""")
def chain_edges(spark, sf_dir):
    e = _chains(Tables(spark, sf_dir)).select(F.explode(etymology.chain_edges(F.col("chain"), F.lit("nation"))).alias("e"))
    return e.groupBy("e.newer", "e.older", "e.edge_type").agg(F.count("*").alias("n"))


@query("""
    WITH RECURSIVE e AS (SELECT concat('n', n_nationkey) AS child, concat('r', n_regionkey) AS parent FROM nation UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey) FROM customer),
    walk(start, ancestor, depth) AS (SELECT concat('c', c_custkey), concat('c', c_custkey), 0 FROM customer UNION ALL SELECT w.start, e.parent, w.depth + 1 FROM walk w JOIN e ON w.ancestor = e.child WHERE w.depth < 10)
    SELECT start, ancestor, CAST(depth AS BIGINT) AS depth FROM walk
""")
def ancestor_walk(spark, sf_dir):
    t = Tables(spark, sf_dir)
    key = lambda p, c: F.concat(F.lit(p), F.col(c))
    edges = t.nation.select(key("n", "n_nationkey").alias("child"), key("r", "n_regionkey").alias("parent")).union(t.customer.select(key("c", "c_custkey"), key("n", "c_nationkey")))
    return graph.ancestors(edges, t.customer.select(key("c", "c_custkey").alias("node"))).select("start", "ancestor", F.col("depth").cast("long").alias("depth"))


@query("""
    WITH m AS (SELECT DISTINCT p_brand, p_size, p_name FROM part), k AS (SELECT p_brand, p_size FROM m GROUP BY ALL HAVING count(*) BETWEEN 2 AND 20)
    SELECT DISTINCT a.p_name AS a, b.p_name AS b FROM m a JOIN k USING (p_brand, p_size) JOIN m b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_name < b.p_name
""")
def cooccur_pairs(spark, sf_dir):
    return graph.co_members(Tables(spark, sf_dir).part, ["p_brand", "p_size"], "p_name", 2, 20)


@query("""
    WITH p AS (SELECT l_orderkey, s_nationkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), e AS (SELECT s_nationkey AS x, c_nationkey AS y FROM p JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)
    SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS n FROM e WHERE x <> y GROUP BY 1, 2
""")
def pair_counts(spark, sf_dir):
    """Nations of supplier and customer that meet in an order line, as unordered pairs."""
    t = Tables(spark, sf_dir)
    edges = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return graph.pair_counts(edges, "s_nationkey", "c_nationkey")


@query("SELECT DISTINCT a.n_nationkey AS from_id, b.n_nationkey AS to_id FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def shared_ancestor(spark, sf_dir):
    return graph.shared_target(Tables(spark, sf_dir).nation, "n_nationkey", "n_regionkey")


@query("""
    WITH w AS (SELECT string_split(p_name, ' ')[2] AS word, max(p_partkey) AS k FROM part GROUP BY 1), i AS (SELECT p_partkey AS word_id, p_brand AS island FROM part)
    SELECT p_partkey AS compound, k AS component, a.island AS from_island, b.island AS to_island FROM part JOIN w ON w.word = string_split(p_name, ' ')[2] JOIN i a ON a.word_id = p_partkey JOIN i b ON b.word_id = k WHERE a.island <> b.island
""")
def bridge_edges(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    second = F.split("p_name", " ")[1]
    words = part.groupBy(second.alias("word")).agg(F.max("p_partkey").alias("component"))
    compounds = part.select(F.col("p_partkey").alias("compound"), second.alias("word")).join(words, "word").select("compound", "component")
    return graph.bridges(compounds, part.select(F.col("p_partkey").alias("word_id"), F.col("p_brand").alias("island"))).select("compound", "component", "from_island", "to_island")


@query("""
    SELECT p_brand AS id, count(*) AS size, least(8.0, greatest(3.0, count(*) * 0.8 + 2))::DOUBLE AS radius FROM part GROUP BY p_brand HAVING count(*) >= 2
""")
def island_radius(spark, sf_dir):
    got = Tables(spark, sf_dir).part.groupBy(F.col("p_brand").alias("id")).agg(F.count("*").alias("size")).where("size >= 2")
    return got.withColumn("radius", geometry.radius(F.col("size")))
