"""Root clusters: by etymological root, by derivation, by stem, and alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.etymology import borrowing, chain, chain_root, cognates, text_root
from ..functions.morphology import compound_parts, with_segments
from ..functions.text import source_url, stem_key
from .adoption import adopt_in_order  # noqa: F401
from .order import numbered


def vocabulary(entries: DataFrame, levels: list[str], tags: list[str]) -> DataFrame:
    """Entries of the levels and word classes, numbered by level, frequency class (99 if unknown) and id.

    Of entries that share a lemma the last one's values stand in the first one's place.
    """
    rank = F.coalesce(*[F.when(F.col("cefr_level") == v, F.lit(i)) for i, v in enumerate(levels)], F.lit(len(levels)))
    rows = entries.where(F.col("cefr_level").isin(levels) & F.col("pos").isin(tags)).withColumn("ord", F.struct(rank.alias("rank"), F.coalesce("frequency_class", F.lit(99)).alias("freq"), F.col("id").alias("id")))
    rest = [c for c in rows.columns if c not in ("lemma", "ord")]
    best = rows.groupBy("lemma").agg(F.max_by(F.struct(*rest), "ord").alias("r"), F.min("ord").alias("ord"))
    return best.select("lemma", "ord", "r.*")


def rooted(vocab: DataFrame, templates: DataFrame) -> DataFrame:
    """Phase A: chain, cognates, borrowing, root, compound parts and segments of every word.

    A layer: write or cache it, since adoption and grouping read it several times.
    """
    t = F.coalesce("etymology_templates", F.array().cast("array<struct<name:string,args:map<string,string>>>"))
    rows = vocab.join(templates.withColumnRenamed("word", "lemma"), "lemma", "left").withColumn("t", t).withColumn("chain", chain(F.col("t"), F.col("lemma")))
    rows = rows.withColumn("root", F.coalesce(chain_root(F.col("chain")), text_root(F.nullif("etymology", F.lit("")))))
    rows = with_segments(rows)
    return rows.select(
        *vocab.columns, "chain", "root", cognates(F.col("t")).alias("cognates"), borrowing(F.col("t")).alias("borrowing_info"),
        compound_parts(F.col("t"), F.coalesce("etymology", F.lit(""))).alias("parts"), "segments",
        F.concat_ws(":", F.col("root.lang"), F.col("root.form")).alias("root_key"),
    ).withColumn("root_key", F.nullif("root_key", F.lit("")))


def adopt_once(words: DataFrame) -> DataFrame:
    """One level of adoption: unrooted words named in a rooted word's `derived` list (the first in order
    counts), else those whose own list names a rooted word (the first in the list counts).
    """
    known = words.where("root_key is not null").select(F.col("lemma").alias("parent"), F.col("root_key").alias("parent_key"), F.col("ord").alias("parent_ord"), "derived")
    bare = words.where("root_key is null").select("lemma", F.col("derived").alias("own"))
    named = known.select("parent_key", "parent_ord", F.explode("derived").alias("lemma"), "parent").where("parent <> lemma").join(bare.select("lemma"), "lemma")
    by_list = named.groupBy("lemma").agg(F.min_by("parent_key", "parent_ord").alias("listed_key"))
    naming = bare.select("lemma", F.posexplode("own").alias("i", "parent")).join(known.select("parent", "parent_key"), "parent")
    by_own = naming.groupBy("lemma").agg(F.min_by("parent_key", "i").alias("own_key"))
    return words.join(by_list, "lemma", "left").join(by_own, "lemma", "left").withColumn("root_key", F.coalesce("root_key", "listed_key", "own_key")).drop("listed_key", "own_key")


def stem_groups(words: DataFrame, n: int = 4) -> DataFrame:
    """Words without a root group by their first n letters; a word that is alone takes its own lemma."""
    bare = words.where("root_key is null").withColumn("stem", stem_key(F.col("lemma"), n))
    sizes = bare.groupBy("stem").agg(F.count("*").alias("stem_size"))
    alone = F.concat(F.lit("nhg:"), F.lower("lemma"))
    # a stem group's key replaces an equal root's: such words are one cluster either way
    grouped = bare.join(sizes, "stem").withColumn("root_key", F.when(F.col("stem_size") > 1, F.concat(F.lit("nhg:"), F.col("stem"))).otherwise(alone)).drop("stem", "stem_size")
    return words.where("root_key is not null").unionByName(grouped)


def clusters(words: DataFrame, min_size: int = 1) -> DataFrame:
    """One row a root key: size, the most basic word, the longest chain, the words in order.

    `cluster` numbers clusters by size, ties by their first word; it is for display. The number needs a
    total order over clusters, drawn over ranges of narrow rows.
    """
    level = F.when(F.col("cefr_level") == "A1", 0).when(F.col("cefr_level") == "A2", 1).otherwise(2)
    basic = F.struct(level, F.coalesce(F.nullif("frequency_class", F.lit(0)), F.lit(99)), F.col("ord"))
    word = F.struct("ord", "id", "lemma", "pos", "cefr_level", "segments", "parts")
    got = words.groupBy("root_key").agg(
        F.count("*").alias("size"), F.min("ord").alias("first_ord"), F.min_by("lemma", basic).alias("basic_word"),
        F.min_by(F.struct("chain", "cognates", "borrowing_info"), F.struct(-F.size("chain"), F.col("ord"))).alias("best"),
        F.array_sort(F.collect_list(word)).alias("words"),
    )
    got = got.where(F.col("size") >= min_size)
    order = numbered(got.select("root_key", "size", "first_ord"), F.desc("size"), F.col("first_ord")).select("root_key", "n")
    rest = F.substr("root_key", F.locate(":", "root_key") + 1)
    form = F.when((F.col("size") == 1) & F.col("root_key").startswith("nhg:"), F.left(rest, F.lit(5))).otherwise(rest)
    return got.join(order, "root_key").select(F.concat(F.lit("r-"), F.col("n")).alias("cluster"), "root_key", form.alias("form"), "size", "basic_word", "best.*", "words")


def documents(found: DataFrame) -> DataFrame:
    """Nested cluster documents: root, words with urls, links, compounds and, where attached, the position.

    `components` of a cluster, if there, maps its compounds to the words of their parts.
    """
    more = ["position"] if "position" in found.columns else []
    words = F.transform("words", lambda w: F.struct(
        w["id"].alias("id"), w["lemma"].alias("lemma"), w["pos"].alias("pos"), w["cefr_level"].alias("cefr_level"),
        F.when(F.size(w["segments"]) > 1, w["segments"]).alias("segments"),
        F.create_map(F.lit("wiktionary"), source_url("https://de.wiktionary.org/wiki/", w["lemma"]), F.lit("dwds"), source_url("https://www.dwds.de/wb/", w["lemma"])).alias("source_urls"),
    ))
    parts_of = F.col("components") if "components" in found.columns else F.lit(None).cast("map<string,array<string>>")
    compounds = F.transform(F.filter("words", lambda w: w["parts"].isNotNull()), lambda w: F.struct(
        w["id"].alias("compound_wort_id"), F.coalesce(parts_of[w["id"]], F.array().cast("array<string>")).alias("component_wort_ids"), F.array_join(w["parts"], "·").alias("split_display"),
    ))
    root = F.struct(F.col("cluster").alias("id"), "form", F.col("chain").alias("etymology_chain"), "cognates", "borrowing_info", source_url("https://www.dwds.de/wb/etymwb/", F.col("basic_word")).alias("dwds_etymology"))
    return found.select("root_key", root.alias("wurzel"), words.alias("words"), F.transform("words", lambda w: F.struct(F.col("cluster").alias("wurzel_id"), w["id"].alias("wort_id"))).alias("links"), compounds.alias("compounds"), *more)


def cluster_stats(found: DataFrame) -> DataFrame:
    per_word = lambda f: F.aggregate("words", F.lit(0).cast("long"), lambda acc, w: acc + F.when(f(w), 1).otherwise(0))
    return found.agg(
        F.count("*").alias("clusters"), F.count_if(F.col("size") >= 2).alias("multi"), F.sum("size").alias("words"),
        F.count_if(F.size("chain") >= 2).alias("chained"), F.sum(per_word(lambda w: F.size(w["segments"]) > 1)).alias("segmented"),
        F.sum(per_word(lambda w: w["parts"].isNotNull())).alias("compounds"),
    )


def compound_links(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(id, components in order): a part is the word of that lemma, else of the capitalised one."""
    by_lemma = lexicon.groupBy("lemma").agg(F.max_by("id", "ord").alias("part_id"))
    parts = words.where("parts is not null").select("id", F.posexplode("parts").alias("i", "part"))
    exact = parts.join(by_lemma.select(F.col("lemma").alias("part"), F.col("part_id").alias("a")), "part", "left")
    from ..functions.text import capitalised

    both = exact.withColumn("cap", capitalised(F.col("part"))).join(by_lemma.select(F.col("lemma").alias("cap"), F.col("part_id").alias("b")), "cap", "left")
    return both.withColumn("part_id", F.coalesce("a", "b")).where("part_id is not null").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "part_id"))), lambda x: x["part_id"]).alias("components"))


def size_at_least(found: DataFrame, k: int, arr: str = "words") -> DataFrame:
    return found.where(F.size(arr) >= k)


def word_of(arr: Column, value: Column, field: str = "compound_wort_id") -> Column:
    """First compound of a cluster that names the word."""
    return F.try_element_at(F.filter(arr, lambda c: c[field] == value), F.lit(1))


def instance_lists(rows: DataFrame, kind: str, key: str, default: str = "default", size: int = 10_000) -> DataFrame:
    """(kind, batch, keys): keys of each kind in order, in lists of at most `size`; a missing kind is the default one.

    A kind may hold most of all rows, so its rows are numbered over ranges and no list takes them all.
    """
    typed = rows.select(F.coalesce(kind, F.lit(default)).alias("kind"), F.col(key).alias("key"))
    placed = numbered(typed, F.col("kind"), F.col("key"))
    first = placed.groupBy("kind").agg(F.min("n").alias("first"))  # one row a kind
    batch = F.floor((F.col("n") - F.col("first")) / size)
    lists = placed.join(first, "kind").groupBy("kind", batch.alias("batch")).agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("items"))
    return lists.select("kind", "batch", F.transform("items", lambda x: x["key"]).alias("keys"))


def capped(found: DataFrame, k: int, order: str = "first_ord") -> DataFrame:
    """The first k clusters, largest first as they are numbered."""
    return found.orderBy(F.desc("size"), order).limit(k)
