"""Morphology, etymology, roots and clusters over the tokens of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import etymology, morphology, text
from ..operators import clustering
from .registry import Tables, query

_TOKENS = r"""
    tok AS (SELECT unnest(regexp_extract_all(text, '[\p{L}]+')) AS lemma FROM documents WHERE lang = 'de'),
    lex AS (SELECT lemma, count(*) AS n, CASE WHEN left(lemma, 1) <> lower(left(lemma, 1)) THEN 'NOUN' WHEN ends_with(lemma, 'en') THEN 'VERB' ELSE 'ADJ' END AS pos FROM tok GROUP BY lemma)
"""


def lexicon(t: Tables) -> DataFrame:
    """German tokens with counts; the word class follows from spelling."""
    tokens = t.documents.where("lang = 'de'").select(F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}]+)"))).alias("lemma"))
    pos = F.when(F.left("lemma", F.lit(1)) != F.lower(F.left("lemma", F.lit(1))), "NOUN").when(F.col("lemma").endswith("en"), "VERB").otherwise("ADJ")
    return tokens.groupBy("lemma").agg(F.count("*").alias("n")).withColumn("pos", pos)


def _listed(items: list[str]) -> str:
    return ", ".join(f"'{i}'" for i in items)


def _suffix_sql() -> str:
    cases = []
    for tag, table in morphology.SUFFIXES.items():
        for s in morphology.longest_first(table):
            extra = f" AND low NOT IN ({_listed(morphology.KEEP_IG)})" if s == "ig" else ""
            cases.append(f"WHEN pos = '{tag}' AND ends_with(rest, '{s}') AND length(rest) > {len(s) + 1}{extra} THEN '{s}'")
    cases.append(f"WHEN pos = 'NOUN' AND ends_with(rest, 'er') AND length(rest) > 4 AND low NOT IN ({_listed(morphology.KEEP_ER)}) THEN 'er'")
    return "CASE " + " ".join(cases) + " END"


_SEGMENTS = f"""
    a AS (SELECT *, lower(lemma) AS low, CASE {" ".join(f"WHEN starts_with(lower(lemma), '{p}') AND length(lemma) > {len(p) + 2} THEN '{p}'" for p in morphology.PREFIXES)} END AS prefix FROM lex),
    b AS (SELECT *, substr(low, coalesce(length(prefix), 0) + 1) AS rest FROM a),
    c AS (SELECT *, {_suffix_sql()} AS suffix FROM b),
    d AS (SELECT *, CASE WHEN prefix IS NULL AND suffix IS NULL THEN lemma ELSE left(rest, length(rest) - coalesce(length(suffix), 0)) END AS root FROM c)
"""


@query(f"""
    WITH {_TOKENS}, {_SEGMENTS}, s AS (
        SELECT lemma, pos, 0 AS k, prefix AS form, 'prefix' AS type FROM d WHERE prefix IS NOT NULL
        UNION ALL SELECT lemma, pos, 1, root, 'root' FROM d WHERE root <> '' UNION ALL SELECT lemma, pos, 2, suffix, 'suffix' FROM d WHERE suffix IS NOT NULL)
    SELECT lemma, pos, row_number() OVER (PARTITION BY lemma ORDER BY k) - 1 AS position, type, form FROM s
""")
def morph_segments(spark, sf_dir):
    rows = morphology.with_segments(lexicon(Tables(spark, sf_dir))).select("lemma", "pos", F.posexplode_outer("segments").alias("position", "s"))
    return rows.select("lemma", "pos", F.col("position").cast("long").alias("position"), F.col("s.type").alias("type"), F.col("s.form").alias("form"))


@query(f"""
    WITH {_TOKENS}, {_SEGMENTS}
    SELECT CASE WHEN prefix IS NOT NULL AND suffix IS NOT NULL AND root <> '' THEN 'circumfixation' WHEN prefix IS NOT NULL AND suffix IS NOT NULL THEN 'prefixation+suffixation'
                WHEN prefix IS NOT NULL THEN 'prefixation' WHEN suffix IS NOT NULL THEN 'suffixation' ELSE 'simplex' END AS word_formation_type, count(*) AS n FROM d GROUP BY 1
""")
def formation_types(spark, sf_dir):
    words = morphology.with_segments(lexicon(Tables(spark, sf_dir)))
    kinds = words.select(morphology.formation_type(F.col("segments")).alias("word_formation_type"))
    return kinds.groupBy("word_formation_type").agg(F.count("*").alias("n"))


@query(f"""
    WITH {_TOKENS}, {_SEGMENTS}, x AS (SELECT DISTINCT prefix AS form, 'prefix' AS position FROM d WHERE prefix IS NOT NULL UNION SELECT DISTINCT suffix, 'suffix' FROM d WHERE suffix IS NOT NULL)
    SELECT concat(position, ':', form) AS id, CASE WHEN position = 'prefix' AND form IN ({_listed(morphology.AFFIX_SEPARABLE)}) THEN true WHEN position = 'prefix' AND form IN ({_listed(morphology.AFFIX_INSEPARABLE)}) THEN false END AS separable FROM x
""")
def affix_inventory(spark, sf_dir):
    from ..operators import graph

    words = morphology.with_segments(lexicon(Tables(spark, sf_dir)))
    return graph.affixes(words).select("id", "separable")


@query(f"""
    WITH {_TOKENS}, k AS (SELECT lemma, n, lower(left(lemma, 4)) AS stem FROM lex), s AS (SELECT stem, count(*) AS size FROM k GROUP BY stem),
    w AS (SELECT k.lemma, k.n, CASE WHEN size > 1 THEN concat('nhg:', stem) ELSE concat('nhg:', lower(k.lemma)) END AS root_key FROM k JOIN s USING (stem)),
    g AS (SELECT root_key, count(*) AS size, min(lemma) AS first, arg_min(lemma, row(-n, lemma)) AS basic_word FROM w GROUP BY root_key)
    SELECT concat('r-', row_number() OVER (ORDER BY size DESC, first) - 1) AS cluster, root_key, size, basic_word FROM g
""")
def root_clusters(spark, sf_dir):
    """Clusters of all German tokens by stem; the commonest word of each is its basic one."""
    empty = F.array().cast("array<struct<stage:string,form:string>>")
    words = lexicon(Tables(spark, sf_dir)).select(
        "lemma", "pos", F.col("lemma").alias("id"), F.lit("A1").alias("cefr_level"), (-F.col("n")).alias("frequency_class"), F.col("lemma").alias("ord"), F.lit(None).cast("string").alias("root_key"),
        empty.alias("chain"), empty.alias("cognates"), F.lit(None).cast("string").alias("borrowing_info"), F.array().cast("array<string>").alias("segments"), F.lit(None).cast("array<string>").alias("parts"),
    )
    return clustering.clusters(clustering.stem_groups(words)).select("cluster", "root_key", "size", "basic_word")


@query(f"""
    WITH {_TOKENS}, k AS (SELECT lower(left(lemma, 4)) AS stem, count(*) AS size FROM lex GROUP BY 1) SELECT count(*) AS clusters, count(*) FILTER (size >= 2) AS multi, CAST(sum(size) AS BIGINT) AS words FROM k
""")
def stem_statistics(spark, sf_dir):
    k = lexicon(Tables(spark, sf_dir)).groupBy(text.stem_key(F.col("lemma")).alias("stem")).agg(F.count("*").alias("size"))
    return k.agg(F.count("*").alias("clusters"), F.count_if(F.col("size") >= 2).alias("multi"), F.sum("size").alias("words"))


@query("""
    WITH w AS (SELECT p_partkey AS id, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, p_name, p_size % 3 = 0 AS rooted FROM part),
    parent AS (SELECT a AS listed, arg_min(concat('k:', id), id) AS key FROM w WHERE rooted GROUP BY a)
    SELECT w.id, CASE WHEN rooted THEN concat('k:', w.id) ELSE parent.key END AS root_key FROM w LEFT JOIN parent ON w.b = parent.listed
""")
def derived_adoption(spark, sf_dir):
    """One level: a word is adopted by the first rooted word whose list (its first word) names it (its second)."""
    parts = F.split("p_name", " ")
    rows = Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("id"), parts[1].alias("named"), parts[0].alias("lists"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("k:"), "p_partkey")).alias("root_key"))
    keys = rows.where("root_key is not null").select(F.concat(F.lit("parent "), "id").alias("lemma"), F.col("id").alias("ord"), "root_key", F.array("lists").alias("derived"))
    bare = rows.select(F.col("named").alias("lemma")).distinct().select("lemma", F.lit(0).cast("long").alias("ord"), F.lit(None).cast("string").alias("root_key"), F.array().cast("array<string>").alias("derived"))
    adopted = clustering.adopt_once(keys.unionByName(bare)).select(F.col("lemma").alias("named"), F.col("root_key").alias("adopted"))
    return rows.join(adopted, "named", "left").select("id", F.coalesce("root_key", "adopted").alias("root_key"))


_PLANTED = """CASE o_orderkey % 7 WHEN 0 THEN 'From Proto-Germanic *hūsą, dwelling' WHEN 1 THEN 'mittelhochdeutsch hus und althochdeutsch hūs' WHEN 2 THEN 'From Middle High German wazzer'
    WHEN 3 THEN 'Borrowed from Medieval Latin fenestra' WHEN 4 THEN 'urgermanisch *watar' WHEN 5 THEN 'aus lateinisch murus' ELSE concat('order ', o_orderpriority) END"""
_W = r"[\p{L}\p{M}\p{N}_-]+"


@query(f"""
    WITH t AS (SELECT o_orderkey AS id, {_PLANTED} AS s FROM orders),
    r AS (SELECT id, CASE {" ".join(f"WHEN regexp_matches(s, '{p.replace(etymology._W + '+', _W)}') THEN concat('{stage}', ':', trim(regexp_extract(s, '{p.replace(etymology._W + '+', _W)}', 1), '*,. '))" for p, stage in etymology.TEXT_PATTERNS)} END AS root_key FROM t)
    SELECT id, root_key FROM r
""")
def root_text_ladder(spark, sf_dir):
    rows = Tables(spark, sf_dir).orders.select(F.col("o_orderkey").alias("id"), F.expr(_PLANTED).alias("s"))
    root = etymology.text_root(F.col("s"))
    return rows.select("id", F.when(root.isNotNull(), text.stage_key(root["lang"], root["form"])).alias("root_key"))


@query(f"""
    WITH {_TOKENS} SELECT lemma, concat('https://www.dwds.de/wb/', replace(url_encode(lemma), '%2F', '/')) AS url FROM lex
""")
def source_urls(spark, sf_dir):
    return lexicon(Tables(spark, sf_dir)).select("lemma", text.source_url("https://www.dwds.de/wb/", F.col("lemma")).alias("url"))


@query("""
    WITH p AS (SELECT p_partkey AS id, p_name, lower(replace(replace(replace(replace(p_name, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')) AS plain, replace(replace(replace(replace(lower(concat(p_name, ' ', p_brand)), 'ae', 'ä'), 'oe', 'ö'), 'ue', 'ü'), 'ss', 'ß') AS marked FROM part)
    SELECT id, plain, marked, concat(upper(left(p_name, 1)), lower(substr(p_name, 2))) AS capitalised FROM p
""")
def umlaut_forms(spark, sf_dir):
    return Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("id"), text.without_umlauts(F.col("p_name")).alias("plain"), text.with_umlauts(F.concat_ws(" ", "p_name", "p_brand")).alias("marked"), text.capitalised(F.col("p_name")).alias("capitalised"))
