"""Edge tables and pairs: self joins, co-membership, traversal.

Segments are never empty; they are exploded as outer, so that no filter on their long expression is inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.etymology import chain_edges
from ..functions.morphology import affix_separable, formation_type
from ..functions.text import cognate_key, field_key
from .pairs import meet
from .store import stored


def unordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def pair_counts(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(a, b, n) of unordered pairs; an edge to itself does not count."""
    return edges.where(F.col(source) != F.col(target)).groupBy(*unordered(F.col(source), F.col(target))).agg(F.count("*").alias("n"))


def co_members(rows: DataFrame, group: str | list[str], member: str, low: int = 2, high: int | None = None) -> DataFrame:
    """Distinct unordered pairs of members that share a group whose size is within the band.

    The band is applied before the join. Without an upper bound the pairs of a group are its square: give
    one unless groups are known to be small. Pairs of a large group are made by many tasks, and only members that are
    both in several groups can be a pair twice, so only their pairs are compared with one another.
    """
    keys = [group] if isinstance(group, str) else group
    members = stored(rows.select(*keys, member).distinct())
    sizes = members.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") >= low)
    if high is not None:
        sizes = sizes.where(F.col("__n") <= high)
    kept = stored(members.join(sizes.drop("__n"), keys))
    several = kept.groupBy(member).agg((F.count("*") > 1).alias("__several"))
    kept = stored(kept.join(several, member).select(*keys, F.col(member).alias("a"), F.col("__several").alias("__a")))
    side = lambda found: meet(found, found.withColumnRenamed("a", "b").withColumnRenamed("__a", "__b"), keys, ["a"], ["b"]).where("a < b")
    once = side(kept).where("not (__a and __b)").select("a", "b")
    again = kept.where("__a")
    return once if again.isEmpty() else once.union(side(again).select("a", "b").distinct())


def shared_target(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Distinct ordered pairs of different sources with a common target."""
    e = edges.select(F.col(source).alias("s"), F.col(target).alias("t")).distinct()
    return e.select(F.col("s").alias("from_id"), "t").join(e.select(F.col("s").alias("to_id"), "t"), "t").where("from_id <> to_id").select("from_id", "to_id").distinct()


def cluster_edges(edges: DataFrame, member_of: DataFrame, positioned: DataFrame, source: str, target: str) -> DataFrame:
    """Entry edges as edges of clusters: both ends placed and different; one row an entry edge."""
    m = member_of.join(positioned, "cluster", "left_semi")
    a = m.select(F.col("entry_id").alias(source), F.col("cluster").alias("ca"))
    b = m.select(F.col("entry_id").alias(target), F.col("cluster").alias("cb"))
    return edges.join(a, source).join(b, target).where("ca <> cb")


def layout_edges(member_of: DataFrame, positioned: DataFrame, compound: DataFrame, semantic: DataFrame, fields: DataFrame, derivation: DataFrame, etymology: DataFrame) -> DataFrame:
    """(kind, a, b): cluster pairs by compounds, meaning, shared fields (2 to 20 clusters) and shared roots."""
    m = member_of.join(positioned, "cluster", "left_semi")
    comp = pair_counts(cluster_edges(compound, member_of, positioned, "compound_entry_id", "component_entry_id"), "ca", "cb")
    sem = pair_counts(cluster_edges(semantic, member_of, positioned, "from_entry_id", "to_entry_id"), "ca", "cb")
    field = co_members(fields.join(m, "entry_id"), "field_id", "cluster", 2, 20)
    roots = derivation.where("target_type = 'root'").join(m, "entry_id").select(F.col("target_id").alias("root"), "cluster").distinct()
    direct = co_members(roots, "root", "cluster")
    via = shared_target(etymology, "from_root_id", "to_root_id")
    cross = via.join(roots.select(F.col("root").alias("from_id"), F.col("cluster").alias("x")), "from_id").join(roots.select(F.col("root").alias("to_id"), F.col("cluster").alias("y")), "to_id").where("x <> y").select(*unordered(F.col("x"), F.col("y")))
    etym = direct.union(cross).distinct()
    parts = [t.select(F.lit(k).alias("kind"), "a", "b") for k, t in (("compound", comp), ("semantic", sem), ("field", field), ("etymology", etym))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def etymology_edges(found: DataFrame) -> DataFrame:
    """Distinct newer-older edges of the clusters' chains, and edges from a cluster's modern root to its cognates."""
    chained = found.select(F.explode(chain_edges(F.col("chain"), F.coalesce(F.col("borrowing_info.lang_code"), F.lit("?")))).alias("e")).select(F.col("e.newer").alias("from_root_id"), F.col("e.older").alias("to_root_id"), F.col("e.edge_type").alias("edge_type"))
    cog = found.where(F.size("chain") > 0).select("form", F.explode("cognates").alias("c")).select(F.concat(F.lit("nhg:"), "form").alias("from_root_id"), cognate_key(F.col("c.language"), F.col("c.form")).alias("to_root_id"), F.lit("cognate_of").alias("edge_type"))
    return chained.unionByName(cog).distinct()


def roots(found: DataFrame, words: DataFrame) -> DataFrame:
    """Nodes of the clusters' chains and cognates, and of the words' root segments; the first of each id."""
    stages = found.select(F.explode("chain").alias("s")).select(F.concat_ws(":", "s.stage", "s.form").alias("id"), F.col("s.form").alias("form"), F.col("s.stage").alias("stage"), F.col("s.is_reconstructed").alias("is_reconstructed"))
    cog = found.select(F.explode("cognates").alias("c")).select(cognate_key(F.col("c.language"), F.col("c.form")).alias("id"), F.col("c.form").alias("form"), F.concat(F.lit("cog_"), F.lower("c.language")).alias("stage"), F.lit(False).alias("is_reconstructed"))
    own = words.select(F.explode_outer("segments").alias("s")).where("s.type = 'root'").select(F.concat(F.lit("nhg:"), F.col("s.form")).alias("id"), F.col("s.form").alias("form"), F.lit("nhg").alias("stage"), F.lit(False).alias("is_reconstructed"))
    return stages.unionByName(cog).unionByName(own).dropDuplicates(["id"])


def derivation_edges(words: DataFrame) -> DataFrame:
    segs = words.select(F.col("id").alias("entry_id"), F.posexplode_outer("segments").alias("position", "s"))
    root = F.col("s.type") == "root"
    return segs.select("entry_id", F.concat(F.when(root, "nhg:").otherwise(F.concat(F.col("s.type"), F.lit(":"))), F.col("s.form")).alias("target_id"), F.when(root, "root").otherwise("affix").alias("target_type"), "position").distinct()


def affixes(words: DataFrame) -> DataFrame:
    segs = words.select(F.explode_outer("segments").alias("s")).where("s.type <> 'root'")
    return segs.select(F.concat_ws(":", "s.type", "s.form").alias("id"), F.col("s.form").alias("form"), F.col("s.type").alias("position"), affix_separable(F.col("s.type"), F.col("s.form")).alias("separable")).distinct()


def decompositions(words: DataFrame) -> DataFrame:
    return words.select(F.col("id").alias("entry_id"), "segments", formation_type(F.col("segments")).alias("word_formation_type"), F.col("parts").isNotNull().alias("is_compound"), F.lit(False).alias("verified"))


# The lists of an entry that become edges, with the kind of each.
RELATIONS = {"synonyms": "synonym_of", "antonyms": "antonym_of", "hypernyms": "hypernym_of", "hyponyms": "hyponym_of"}


def semantic_edges(entries: DataFrame, relations: dict[str, str] = RELATIONS, limit: int = 10) -> DataFrame:
    """Edges to the entries of related lemmas: of each list the first `limit`; the last entry of a lemma counts."""
    targets = entries.groupBy("lemma").agg(F.max_by("id", "ord").alias("to_entry_id"))
    parts = [entries.select(F.col("id").alias("from_entry_id"), F.explode(F.slice(c, 1, limit)).alias("lemma")).withColumn("edge_type", F.lit(kind)) for c, kind in relations.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.join(targets, "lemma").where("from_entry_id <> to_entry_id").select("from_entry_id", "to_entry_id", "edge_type").distinct()


def entry_fields(entries: DataFrame, domains: str = "subject_domains", limit: int = 5) -> tuple[DataFrame, DataFrame]:
    """(semantic_fields, entry_fields) of the first domains of each entry."""
    rows = entries.select(F.col("id").alias("entry_id"), F.explode(F.slice(domains, 1, limit)).alias("name")).where("name <> ''")
    fields = rows.select(field_key(F.col("name")).alias("id"), F.col("name").alias("name_en")).dropDuplicates(["id"])
    return fields, rows.select("entry_id", field_key(F.col("name")).alias("field_id")).distinct()


def ancestors(edges: DataFrame, start: DataFrame, max_depth: int = 10) -> DataFrame:
    """(start, ancestor, depth) along child -> parent edges, a level at a time; depth bounds cycles.

    edges: child, parent. start: node. Only the last level's ends are joined with the edges, and levels are
    stored, so no limit of rows and no growing plan bounds the walk. It ends when a level is empty.
    """
    up = edges.select(F.col("child").alias("ancestor"), "parent")
    level = stored(start.select(F.col("node").alias("start"), F.col("node").alias("ancestor")))
    out = level.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        level = stored(level.join(up, "ancestor").select("start", F.col("parent").alias("ancestor")))
        if level.isEmpty():
            break
        out = out.unionByName(level.withColumn("depth", F.lit(depth)))
    return out


def with_ends(edges: DataFrame, nodes: DataFrame, source: str, target: str, key: str = "id", shown: str = "form") -> DataFrame:
    """Edges whose ends are both nodes, with what is shown of each: columns source_shown and target_shown."""
    a = nodes.select(F.col(key).alias(source), F.col(shown).alias("source_shown"))
    b = nodes.select(F.col(key).alias(target), F.col(shown).alias("target_shown"))
    return edges.join(a, source).join(b, target)


def sets_of(rows: DataFrame, key: str, member: str) -> DataFrame:
    """(key, members): the distinct members of each key, in order; meant for keys with few of them."""
    return rows.select(key, member).distinct().groupBy(key).agg(F.array_sort(F.collect_list(member)).alias("members"))


def bridges(compounds: DataFrame, island_of: DataFrame) -> DataFrame:
    """Compound and component in different islands; repeats are kept."""
    a = island_of.select(F.col("word_id").alias("compound"), F.col("island").alias("from_island"))
    b = island_of.select(F.col("word_id").alias("component"), F.col("island").alias("to_island"))
    return compounds.join(a, "compound").join(b, "component").where("from_island <> to_island")
