"""Root clusters through all four phases, root families and scores, over parts that stand for a vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import LEVELS
from ..operators import clustering
from ..operators.families import closure, families, family_scores, level_scores
from ..operators.ranks import medians
from ..operators.store import stored
from .registry import Tables, query

# A tenth of the words have a chain of three stages, some a root in free text, a sixth is a compound; most words
# name one or two others, so that adoption runs in chains and cycles.
_WORDS = """
    base AS (SELECT p_partkey AS k, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, p_size, count(*) OVER () AS total,
        concat(CASE WHEN p_partkey % 2 = 0 THEN string_split(p_name, ' ')[2] ELSE left(md5(CAST(p_partkey AS VARCHAR)), 5) END, p_partkey) AS lemma FROM part),
    w AS (SELECT *, row_number() OVER (ORDER BY p_size % 3, p_size, k) AS n, CASE WHEN k % 10 = 0 THEN concat('goh:', a) WHEN k % 23 = 0 THEN concat('gem-pro:', b) END AS root FROM base),
    der AS (SELECT k AS parent, (k * 7 + 1) % total AS child, 0 AS i FROM base WHERE k % 4 <> 0 UNION ALL SELECT k, (k * 13 + 5) % total, 1 FROM base WHERE k % 3 = 0),
    met AS (SELECT p.n AS pn, p.root AS proot, c.n AS cn, c.root AS croot, i FROM der JOIN w p ON p.k = parent JOIN w c ON c.k = child WHERE parent <> child),
    cand AS (SELECT cn AS n, 0 AS own, pn AS r, pn AS other, proot AS key FROM met WHERE croot IS NULL AND (proot IS NOT NULL OR pn < cn)
        UNION ALL SELECT pn, 1, i, cn, croot FROM met WHERE proot IS NULL AND (croot IS NOT NULL OR cn < pn)),
    lists AS (SELECT n, list({'other': other, 'key': key} ORDER BY own, r) AS cs FROM cand GROUP BY n),
    adopt(n, keys) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) UNION ALL
        SELECT f.n + 1, list_append(f.keys, coalesce(w.root, list_filter(list_transform(coalesce(cs, []), lambda c: coalesce(c.key, f.keys[c.other])), lambda x: x IS NOT NULL)[1]))
        FROM adopt f JOIN w ON w.n = f.n + 1 LEFT JOIN lists ON lists.n = w.n),
    adopted AS (SELECT w.*, f.keys[w.n] AS key FROM w, (SELECT keys FROM adopt ORDER BY n DESC LIMIT 1) f)
"""
_CLUSTERS = f"""
    {_WORDS}, stems AS (SELECT lower(left(lemma, 4)) AS stem, count(*) AS c FROM adopted WHERE key IS NULL GROUP BY 1),
    grouped AS (SELECT x.*, coalesce(key, CASE WHEN c > 1 THEN concat('nhg:', stem) ELSE concat('nhg:', lower(lemma)) END) AS root_key FROM adopted x LEFT JOIN stems ON x.key IS NULL AND stem = lower(left(lemma, 4))),
    c AS (SELECT root_key, count(*) AS size, min(n) AS first, arg_min(lemma, (least(p_size % 3, 2), CASE WHEN p_size = 0 THEN 99 ELSE p_size END, n)) AS basic_word,
        max(CASE WHEN k % 10 = 0 THEN 3 ELSE 1 END) AS stages, count(*) FILTER (k % 6 = 1) AS compounds FROM grouped GROUP BY root_key)
"""


def _vocabulary(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, templates) of the parts."""
    k, names = F.col("p_partkey"), F.split("p_name", " ")
    lemma = F.concat(F.when(k % 2 == 0, names[1]).otherwise(F.left(F.md5(k.cast("string")), F.lit(5))), k.cast("string"))
    base = t.part.select(k.alias("k"), names[0].alias("a"), names[1].alias("b"), "p_size", lemma.alias("lemma"))
    total = base.agg(F.count("*").alias("total"))  # one row
    wide = base.crossJoin(F.broadcast(total))
    c0, c1 = F.when(F.col("k") % 4 != 0, (F.col("k") * 7 + 1) % F.col("total")), F.when(F.col("k") % 3 == 0, (F.col("k") * 13 + 5) % F.col("total"))
    name = lambda i: base.select(F.col("k").alias(f"c{i}"), F.col("lemma").alias(f"l{i}"))
    listed = wide.withColumns({"c0": c0, "c1": c1}).join(name(0), "c0", "left").join(name(1), "c1", "left")
    entries = listed.select(
        F.col("k").alias("id"), "lemma", F.lit("NOUN").alias("pos"), F.element_at(F.array(F.lit("A1"), F.lit("A2"), F.lit("B1")), F.col("p_size") % 3 + 1).alias("cefr_level"),
        F.col("p_size").alias("frequency_class"), F.when(F.col("k") % 23 == 0, F.concat(F.lit("From Proto-Germanic *"), "b")).alias("etymology"), F.array_compact(F.array("l0", "l1")).alias("derived"), "a", "b",
    )
    vocab = clustering.vocabulary(entries, ["A1", "A2", "B1"], ["NOUN"])

    def template(kind: str, **args):
        return F.struct(F.lit(kind).alias("name"), F.create_map(*[x for key, v in args.items() for x in (F.lit(key[1:]), v if not isinstance(v, str) else F.lit(v))]).alias("args"))

    chain = F.array(template("inh", _2="gmh", _3=F.col("b")), template("inh", _2="goh", _3=F.col("a")))
    none = F.array().cast("array<struct<name:string,args:map<string,string>>>")
    compound = F.array(template("compound", _2=F.col("a"), _3=F.col("b")))
    found = F.concat(F.when(F.col("id") % 10 == 0, chain).otherwise(none), F.when(F.col("id") % 6 == 1, compound).otherwise(none))
    return vocab.drop("a", "b"), entries.select(F.col("lemma").alias("word"), found.alias("etymology_templates"))


def _clusters(t: Tables) -> DataFrame:
    rooted = stored(clustering.rooted(*_vocabulary(t)))
    return clustering.clusters(clustering.stem_groups(clustering.adopt_in_order(rooted)))


@query(f"WITH RECURSIVE {_WORDS} SELECT lemma, root AS own_root, key AS root_key FROM adopted")
def ordered_adoption(spark, sf_dir):
    """Phases A and B: roots of chains and texts, then adoption in vocabulary order."""
    rooted = stored(clustering.rooted(*_vocabulary(Tables(spark, sf_dir))).select("lemma", "ord", "root_key", "derived"))
    own = rooted.select("lemma", F.col("root_key").alias("own_root"))
    return clustering.adopt_in_order(rooted).select("lemma", "root_key").join(own, "lemma")


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT concat('r-', row_number() OVER (ORDER BY size DESC, first) - 1) AS cluster, root_key, size, basic_word, CAST(stages AS INTEGER) AS stages FROM c")
def phase_clusters(spark, sf_dir):
    """All four phases: roots, adoption, stem groups, single words."""
    return _clusters(Tables(spark, sf_dir)).select("cluster", "root_key", "size", "basic_word", F.size("chain").alias("stages"))


@query(f"""
    WITH RECURSIVE {_CLUSTERS} SELECT count(*) AS clusters, count(*) FILTER (size >= 2) AS multi, CAST(sum(size) AS BIGINT) AS words, count(*) FILTER (stages >= 2) AS chained, CAST(sum(compounds) AS BIGINT) AS compounds FROM c
""")
def phase_statistics(spark, sf_dir):
    return clustering.cluster_stats(_clusters(Tables(spark, sf_dir))).drop("segmented")


_TREE = """
    e AS (SELECT p_partkey AS child, CASE WHEN p_partkey % 11 = 4 THEN (p_partkey * 5 + 2) % count(*) OVER () ELSE p_partkey // 3 END AS parent FROM part),
    d AS (SELECT DISTINCT c_custkey AS word, c_custkey * 7 % (SELECT count(*) FROM part) AS root, ['A1', 'A2', 'B1', 'B2', 'C1', 'C2'][(c_custkey % 7 + 1)::INT] AS level, CASE WHEN c_custkey % 13 > 0 THEN c_custkey % 17 END AS frequency FROM customer),
    up(child, ancestor, depth) AS (SELECT child, parent, 1 FROM e WHERE child <> parent UNION SELECT up.child, e.parent, depth + 1 FROM up JOIN e ON e.child = up.ancestor WHERE depth < 16),
    c AS (SELECT child, ancestor, min(depth) AS depth FROM up WHERE child <> ancestor GROUP BY ALL)
"""


def _tree(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(derived words, edges of roots): a tree of parts with some links across, which make cycles too."""
    n = F.broadcast(t.part.agg(F.count("*").alias("n")))  # one row
    key = F.col("p_partkey")
    edges = t.part.crossJoin(n).select(key.alias("child"), F.when(key % 11 == 4, (key * 5 + 2) % F.col("n")).otherwise(F.floor(key / 3)).alias("parent"))
    word = F.col("c_custkey")
    levels = F.array(*[F.lit(v) for v in LEVELS])
    words = t.customer.crossJoin(n).select(word.alias("word"), (word * 7 % F.col("n")).alias("root"), F.get(levels, (word % 7).cast("int")).alias("level"), F.when(word % 13 > 0, word % 17).alias("frequency"))
    return words, edges


@query(f"WITH RECURSIVE {_TREE} SELECT child, ancestor, CAST(depth AS INTEGER) AS depth FROM c")
def ancestor_closure(spark, sf_dir):
    """Every ancestor of every root by its shortest way, by ways that double."""
    return closure(_tree(Tables(spark, sf_dir))[1], 16)


@query(f"""
    WITH RECURSIVE {_TREE}, f AS (SELECT root, word FROM d UNION SELECT ancestor, word FROM d JOIN c ON c.child = d.root),
    g AS (SELECT f.root, count(*) AS family_size, avg(frequency) AS m, {", ".join(f"count(*) FILTER (level = '{v}') AS {v}" for v in ("A1", "A2", "B1", "B2", "C1", "C2"))} FROM f JOIN d USING (word) GROUP BY f.root),
    r AS (SELECT *, percent_rank() OVER (ORDER BY family_size) AS s FROM g), q AS (SELECT root, percent_rank() OVER (ORDER BY m) AS q FROM g WHERE m IS NOT NULL)
    SELECT root, family_size, round(m, 6) AS mean_frequency, A1, A2, B1, B2, C1, C2, round(0.4 * s + 0.4 * coalesce(q, 0) + 0.2 * ((A1 > 0)::INT + (A2 > 0)::INT + (B1 > 0)::INT + (B2 > 0)::INT + (C1 > 0)::INT + (C2 > 0)::INT) / 6, 6) AS root_value FROM r LEFT JOIN q USING (root)
""")
def root_families(spark, sf_dir):
    """Families of shared roots with their sizes, levels and value."""
    words, edges = _tree(Tables(spark, sf_dir))
    got = family_scores(families(words, edges, 16), words.select("word", "level", "frequency"))
    return got.select("root", "family_size", F.round("mean_frequency", 6).alias("mean_frequency"), *LEVELS, F.round("root_value", 6).alias("root_value"))


@query("""
    WITH w AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 19 > 0 THEN o_custkey END AS f, o_orderkey % 6 + 1 AS m, o_orderkey % 3 AS g, (o_orderkey % 10) / 10 AS y FROM orders), r AS (SELECT id, percent_rank() OVER (ORDER BY f) AS p FROM w WHERE f IS NOT NULL)
    SELECT id, round(0.4 * (1 - coalesce(p, 0)) + 0.2 * least((m - 1) / 3, 1) + 0.2 / (1 + g) + 0.2 * (1 - y), 6) AS level_score FROM w LEFT JOIN r USING (id)
""")
def word_level_scores(spark, sf_dir):
    key = F.col("o_orderkey")
    words = Tables(spark, sf_dir).orders.select(key.alias("id"), F.when(key % 19 > 0, F.col("o_custkey")).alias("frequency"), (key % 6 + 1).alias("morphemes"), (key % 3).alias("registers"), (key % 10 / 10).alias("regularity"))
    return level_scores(words).select("id", F.round("level_score", 6).alias("level_score"))


@query("SELECT l_returnflag AS kind, median(CAST(l_extendedprice AS DOUBLE)) AS median FROM lineitem GROUP BY 1 UNION ALL SELECT l_shipdate::VARCHAR, median(CAST(l_quantity AS DOUBLE)) FROM lineitem GROUP BY 1")
def group_medians(spark, sf_dir):
    """Exact medians of few large groups and of many small ones."""
    lines = Tables(spark, sf_dir).lineitem
    large = medians(lines, "l_returnflag", "l_extendedprice", few=100).withColumnRenamed("l_returnflag", "kind")
    return large.unionByName(medians(lines.withColumn("kind", F.col("l_shipdate").cast("string")), "kind", "l_quantity"))
