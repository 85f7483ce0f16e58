"""Adoption of unrooted words in vocabulary order, as rounds of joins.

In order, an unrooted word takes the key of the first word that names it and has one by then, else of the first
word that it names itself. What a word waits for are its candidates: rooted words, and unrooted ones that come
before it (a later one has no key yet). A word is settled as soon as its first candidate left has a key;
candidates that end without one are struck off. A word with one candidate left shares that one's fate, so
whoever waits for it waits for that one instead: chains halve with every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import released, stored


def candidates(words: DataFrame) -> DataFrame:
    """(w, rank, c, key): what each unrooted word may take its key from; key is that of a rooted candidate.

    Words that list w come first, in vocabulary order, then the words of its own list, in that order.
    """
    links = words.select(F.col("lemma").alias("one"), F.col("ord").alias("one_ord"), F.col("root_key").alias("one_key"), F.posexplode("derived").alias("i", "other")).where("one <> other")
    ends = words.select(F.col("lemma").alias("other"), F.col("ord").alias("other_ord"), F.col("root_key").alias("other_key"))
    met = links.join(ends, "other")
    none, first = F.lit(None).cast(words.schema["ord"].dataType), F.lit(0)
    named = met.where("other_key is null").select(F.col("other").alias("w"), F.struct(first.alias("own"), F.col("one_ord").alias("ord"), first.alias("i")).alias("rank"), F.col("one").alias("c"), F.col("one_key").alias("key"), (F.col("one_ord") < F.col("other_ord")).alias("before"))
    own = met.where("one_key is null").select(F.col("one").alias("w"), F.struct(F.lit(1).alias("own"), none.alias("ord"), F.col("i").alias("i")).alias("rank"), F.col("other").alias("c"), F.col("other_key").alias("key"), (F.col("other_ord") < F.col("one_ord")).alias("before"))
    return named.unionByName(own).where("key is not null or before").drop("before")


def _trimmed(edges: DataFrame) -> DataFrame:
    """One row a word and candidate, none behind the first one that has a key."""
    once = edges.groupBy("w", "c").agg(F.min_by(F.struct("rank", "key"), "rank").alias("e")).select("w", "c", "e.*")
    bound = once.where("key is not null").groupBy("w").agg(F.min("rank").alias("bound"))
    return once.join(bound, "w", "left").where("bound is null or rank <= bound").drop("bound")


def adopt_in_order(words: DataFrame, stats: list[int] | None = None) -> DataFrame:
    """`words` (lemma, once each; ord, a total order; root_key; derived) with the keys of adopted words filled in.

    Equal to one pass in order in which an adopted word counts for the words after it; cycles and words that
    name themselves end there too. `stats` gets the number of words open in each round.
    """
    edges = stored(_trimmed(candidates(words)))
    adopted = []
    while True:
        first = F.min_by(F.struct("key", "c"), "rank")
        state = stored(edges.groupBy("w").agg(first.alias("first"), F.count("*").alias("n")).select(F.col("w").alias("c"), F.col("first.key").alias("now"), F.when((F.col("n") == 1) & F.col("first.key").isNull(), F.col("first.c")).alias("alias")))
        counts = state.agg(F.count("*").alias("open"), F.count("now").alias("settled")).first()
        if stats is not None:
            stats.append(counts["open"])
        adopted.append(state.where("now is not null").select(F.col("c").alias("lemma"), F.col("now").alias("adopted_key")))
        if counts["open"] == counts["settled"]:
            break
        waiting = edges.join(state.where("now is not null").select(F.col("c").alias("w")), "w", "left_anti")
        known = waiting.where("key is not null")
        # a candidate, or what it waits for alone, that is not there any more ended without a key
        beyond = state.select(F.col("c").alias("alias"), F.col("now").alias("then"), F.lit(True).alias("there"))
        fate = state.join(beyond, "alias", "left").where("alias is null or there")
        open_ = waiting.where("key is null").join(fate, "c")
        moved = open_.select("w", F.coalesce("alias", "c").alias("c"), "rank", F.coalesce("now", "then").alias("key"))
        before, edges = edges, stored(_trimmed(known.select("w", "c", "rank", "key").unionByName(moved)))
        released(before)
    found = adopted[0]
    for more in adopted[1:]:
        found = found.unionByName(more)
    return words.join(stored(found), "lemma", "left").withColumn("root_key", F.coalesce("root_key", "adopted_key")).drop("adopted_key")
