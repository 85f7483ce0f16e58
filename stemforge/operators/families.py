"""Root families over the closure of derivation, and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import LEVELS
from .ranks import percent_ranked
from .store import released, stored

#: Weights of family size, frequency and breadth of levels in a root's value.
VALUE_WEIGHTS = (0.4, 0.4, 0.2)


def closure(edges: DataFrame, max_depth: int = 1024, stats: list[int] | None = None) -> DataFrame:
    """(child, ancestor, depth): every ancestor of every node once, by its shortest way of at most `max_depth` edges.

    edges: child, parent. Ways double: a round joins the ways of exactly the longest length known with all
    known ones, so a chain of 1,000 takes ten rounds, and nodes that share an ancestor share its ways. Cycles
    end, as a node that is known at a smaller depth is not taken again; a node is no ancestor of its own.
    """
    span, known = 1, stored(edges.where("child <> parent").select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct())
    while span < max_depth:
        last = known.where(F.col("depth") == span)
        further = known.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("beyond"), F.col("depth").alias("more"))
        longer = last.join(further, "ancestor").select("child", F.col("beyond").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth")).where((F.col("child") != F.col("ancestor")) & (F.col("depth") <= max_depth))
        grown = stored(known.unionByName(longer).groupBy("child", "ancestor").agg(F.min("depth").alias("depth")))
        released(known)
        known, span = grown, span * 2
        if stats is not None:
            stats.append(span)
        if known.where(F.col("depth") == span).isEmpty():
            break
    return known


def families(derived: DataFrame, edges: DataFrame, max_depth: int = 1024) -> DataFrame:
    """(root, word): the words derived from a root or from what descends from it, each once.

    derived: word, root; edges: child, parent between roots.
    """
    up = closure(edges, max_depth).select(F.col("child").alias("root"), "ancestor")
    above = derived.select("word", "root").distinct().join(up, "root").select(F.col("ancestor").alias("root"), "word")
    return derived.select("root", "word").union(above).distinct()


def family_scores(family: DataFrame, words: DataFrame, weights: tuple[float, float, float] = VALUE_WEIGHTS) -> DataFrame:
    """One row a root: family_size, words of each level, mean frequency, root_value.

    words: word, level, frequency. The value is a weighted sum of the percent ranks of size and mean frequency
    among all roots, and of the share of levels that the family covers. Words of no known level count in the size.
    """
    rows = family.join(words, "word")
    counts = [F.count_if(F.col("level") == v).alias(v) for v in LEVELS]
    got = rows.groupBy("root").agg(F.count("*").alias("family_size"), F.avg(F.col("frequency").cast("double")).alias("mean_frequency"), *counts)
    ranked = percent_ranked(percent_ranked(got, "family_size", "size_rank"), "mean_frequency", "frequency_rank")
    breadth = sum(F.when(F.col(v) > 0, 1).otherwise(0) for v in LEVELS) / len(LEVELS)
    return ranked.withColumn("root_value", weights[0] * F.col("size_rank") + weights[1] * F.coalesce("frequency_rank", F.lit(0.0)) + weights[2] * breadth)


def level_scores(words: DataFrame, weights: tuple[float, float, float, float] = (0.4, 0.2, 0.2, 0.2)) -> DataFrame:
    """Adds level_score: weighted sum of how rare a word is (one less the percent rank of its frequency), its morphemes
    (0 to 1 at four and more), its registers (1 with none, falling) and its regularity (0 to 1).

    words: frequency, morphemes, registers (counts), regularity. Unknown frequencies count as the rarest.
    """
    ranked = percent_ranked(words, "frequency", "__rank")
    terms = [1 - F.coalesce("__rank", F.lit(0.0)), F.least((F.coalesce("morphemes", F.lit(1)) - 1) / 3, F.lit(1.0)), 1 / (1 + F.coalesce("registers", F.lit(0))), 1 - F.coalesce("regularity", F.lit(1.0))]
    return ranked.withColumn("level_score", sum(w * t for w, t in zip(weights, terms, strict=True))).drop("__rank")
