"""Links, edges, fields, lookups and clusters through the operators, over tables that stand for a lexicon."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, morphology, text
from ..operators import clustering, graph, layout, merge, search
from .lexicon_queries import _SEGMENTS, _TOKENS, lexicon
from .registry import Tables, query


@query("""
    WITH w AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN string_split(p_name, ' ')[2] ELSE concat(upper(left(string_split(p_name, ' ')[2], 1)), lower(substr(string_split(p_name, ' ')[2], 2))) END AS lemma FROM part),
    l AS (SELECT lemma, max(k) AS k FROM w GROUP BY lemma), c AS (SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS part, unnest([0, 1]) AS i FROM part),
    f AS (SELECT id, i, coalesce(a.k, b.k) AS k FROM c LEFT JOIN l a ON a.lemma = c.part LEFT JOIN l b ON b.lemma = concat(upper(left(c.part, 1)), lower(substr(c.part, 2))))
    SELECT id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY i) AS components FROM f WHERE k IS NOT NULL GROUP BY id
""")
def compound_parts(spark, sf_dir):
    """Words of a part's name as the parts of a compound; half of the lexicon is capitalised."""
    part = Tables(spark, sf_dir).part
    second = F.split("p_name", " ")[1]
    words = part.select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("parts"))
    known = part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 2 == 0, second).otherwise(text.capitalised(second)).alias("lemma"))
    return clustering.compound_links(words, known).select("id", F.array_join(F.transform("components", lambda x: x.cast("string")), ",").alias("components"))


@query("""
    WITH e AS (SELECT p_partkey AS id, string_split(p_name, ' ')[p_partkey % 2 + 1] AS lemma, [string_split(p_name, ' ')[1], p_brand] AS syn, [string_split(p_name, ' ')[2]] AS hyper FROM part), t AS (SELECT lemma, max(id) AS k FROM e GROUP BY lemma),
    x AS (SELECT id, unnest(syn) AS lemma, 'synonym_of' AS edge_type FROM e UNION ALL SELECT id, unnest(hyper), 'hypernym_of' FROM e)
    SELECT DISTINCT id AS from_entry_id, k AS to_entry_id, edge_type FROM x JOIN t USING (lemma) WHERE id <> k
""")
def semantic_edges(spark, sf_dir):
    """Half of the parts stand for their first word, half for their second; each names both."""
    none, words = F.array().cast("array<string>"), F.split("p_name", " ")
    rows = Tables(spark, sf_dir).part.select(
        F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 2 == 0, words[0]).otherwise(words[1]).alias("lemma"),
        F.array(words[0], F.col("p_brand")).alias("synonyms"), none.alias("antonyms"), F.array(words[1]).alias("hypernyms"), none.alias("hyponyms"),
    )
    return graph.semantic_edges(rows)


_MEMBERS = "m AS (SELECT p_partkey AS e, p_brand AS c FROM part), placed AS (SELECT DISTINCT p_brand AS c FROM part WHERE p_size > 20), pm AS (SELECT m.* FROM m JOIN placed USING (c))"


def _members(part):
    return part.select(F.col("p_partkey").alias("entry_id"), F.col("p_brand").alias("cluster")), part.where("p_size > 20").select(F.col("p_brand").alias("cluster")).distinct()


@query(f"""
    WITH {_MEMBERS}, e AS (SELECT l_partkey AS a, l_partkey % 97 + 1 AS b FROM lineitem)
    SELECT least(x.c, y.c) AS a, greatest(x.c, y.c) AS b, count(*) AS n FROM e JOIN pm x ON x.e = e.a JOIN pm y ON y.e = e.b WHERE x.c <> y.c GROUP BY 1, 2
""")
def cluster_pairs(spark, sf_dir):
    """Entry edges as edges of placed clusters, counted by pair."""
    t = Tables(spark, sf_dir)
    members, placed = _members(t.part)
    edges = t.lineitem.select(F.col("l_partkey").alias("a"), (F.col("l_partkey") % 97 + 1).alias("b"))
    return graph.pair_counts(graph.cluster_edges(edges, members, placed, "a", "b"), "ca", "cb")


@query(f"""
    WITH {_MEMBERS},
    comp AS (SELECT DISTINCT least(x.c, y.c) AS a, greatest(x.c, y.c) AS b FROM pm x JOIN pm y ON y.e = x.e % 31 + 1 WHERE x.c <> y.c),
    sem AS (SELECT DISTINCT least(x.c, y.c) AS a, greatest(x.c, y.c) AS b FROM pm x JOIN pm y ON y.e = x.e % 17 + 1 WHERE x.c <> y.c),
    f AS (SELECT DISTINCT concat(p_size, p_type) AS f, pm.c FROM part JOIN pm ON pm.e = p_partkey), fk AS (SELECT f FROM f GROUP BY f HAVING count(*) BETWEEN 2 AND 20),
    field AS (SELECT DISTINCT x.c AS a, y.c AS b FROM f x JOIN fk USING (f) JOIN f y ON x.f = y.f AND x.c < y.c),
    r AS (SELECT DISTINCT p_type AS r, pm.c FROM part JOIN pm ON pm.e = p_partkey WHERE p_size % 5 = 0),
    direct AS (SELECT x.c AS a, y.c AS b FROM r x JOIN r y ON x.r = y.r AND x.c < y.c),
    via AS (SELECT DISTINCT a.p_type AS x, b.p_type AS y FROM (SELECT DISTINCT p_type, p_brand FROM part) a JOIN (SELECT DISTINCT p_type, p_brand FROM part) b ON a.p_brand = b.p_brand AND a.p_type <> b.p_type),
    xr AS (SELECT least(p.c, q.c) AS a, greatest(p.c, q.c) AS b FROM via JOIN r p ON p.r = via.x JOIN r q ON q.r = via.y WHERE p.c <> q.c)
    SELECT 'compound' AS kind, a, b FROM comp UNION ALL SELECT 'semantic', a, b FROM sem UNION ALL SELECT 'field', a, b FROM field UNION ALL (SELECT 'etymology', a, b FROM direct UNION SELECT 'etymology', a, b FROM xr)
""")
def layout_pairs(spark, sf_dir):
    """All four kinds of edges between clusters."""
    part = Tables(spark, sf_dir).part
    members, placed = _members(part)
    key = F.col("p_partkey")
    return graph.layout_edges(
        members, placed,
        part.select(key.alias("compound_entry_id"), (key % 31 + 1).alias("component_entry_id")), part.select(key.alias("from_entry_id"), (key % 17 + 1).alias("to_entry_id")),
        part.select(key.alias("entry_id"), F.concat("p_size", "p_type").alias("field_id")), part.where("p_size % 5 = 0").select(key.alias("entry_id"), F.col("p_type").alias("target_id"), F.lit("root").alias("target_type")),
        part.select(F.col("p_type").alias("from_root_id"), F.col("p_brand").alias("to_root_id")),
    )


@query("SELECT DISTINCT least(a.s_name, b.s_name) AS a, greatest(a.s_name, b.s_name) AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey % 4 = b.s_suppkey % 4 AND a.s_name < b.s_name")
def neighbour_pairs(spark, sf_dir):
    """Members of one group in pairs, without an upper bound of its size."""
    s = Tables(spark, sf_dir).supplier.withColumn("slot", F.col("s_suppkey") % 4)
    return graph.co_members(s, ["s_nationkey", "slot"], "s_name")


@query(f"""
    WITH {_TOKENS}, {_SEGMENTS}, s AS (
        SELECT lemma, concat('prefix:', prefix) AS target_id, 'affix' AS target_type FROM d WHERE prefix IS NOT NULL
        UNION ALL SELECT lemma, concat('nhg:', root), 'root' FROM d WHERE root <> '' UNION ALL SELECT lemma, concat('suffix:', suffix), 'affix' FROM d WHERE suffix IS NOT NULL)
    SELECT target_id, target_type, count(*) AS n FROM s GROUP BY ALL
""")
def derivation_targets(spark, sf_dir):
    words = morphology.with_segments(lexicon(Tables(spark, sf_dir))).withColumn("id", F.col("lemma"))
    return graph.derivation_edges(words).groupBy("target_id", "target_type").agg(F.count("*").alias("n"))


@query(f"""
    WITH {_TOKENS}, {_SEGMENTS} SELECT lemma AS entry_id, (prefix IS NOT NULL)::INT + (suffix IS NOT NULL)::INT + (root <> '')::INT AS n_segments,
        CASE WHEN prefix IS NOT NULL AND suffix IS NOT NULL AND root <> '' THEN 'circumfixation' WHEN prefix IS NOT NULL AND suffix IS NOT NULL THEN 'prefixation+suffixation'
             WHEN prefix IS NOT NULL THEN 'prefixation' WHEN suffix IS NOT NULL THEN 'suffixation' ELSE 'simplex' END AS word_formation_type, length(lemma) % 3 = 0 AS is_compound, false AS verified FROM d
""")
def decompositions(spark, sf_dir):
    words = morphology.with_segments(lexicon(Tables(spark, sf_dir))).withColumn("id", F.col("lemma")).withColumn("parts", F.when(F.length("lemma") % 3 == 0, F.array(F.left("lemma", F.lit(2)), F.substr("lemma", F.lit(3)))))
    return graph.decompositions(words).select("entry_id", F.size("segments").alias("n_segments"), "word_formation_type", "is_compound", "verified")


@query("""
    WITH d AS (SELECT p_partkey AS entry_id, unnest(list_slice(string_split(p_type, ' '), 1, 5)) AS name FROM part)
    SELECT name AS field, count(DISTINCT entry_id) AS entries FROM d WHERE name <> '' GROUP BY name
""")
def field_sizes(spark, sf_dir):
    """Domains of entries as fields, with the entries of each."""
    rows = Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("id"), F.split("p_type", " ").alias("subject_domains"))
    fields, entry_fields = graph.entry_fields(rows)
    return fields.join(entry_fields, fields["id"] == entry_fields["field_id"]).groupBy(F.col("name_en").alias("field")).agg(F.count("*").alias("entries"))


@query("""
    WITH v AS (SELECT CASE vec_id % 3 WHEN 0 THEN concat('Wort', vec_id) WHEN 1 THEN concat('wort', vec_id) ELSE concat('WORT', vec_id) END AS word, embedding FROM embeddings),
    w AS (SELECT c_custkey AS id, concat('WorT', c_custkey) AS lemma FROM customer),
    f AS (SELECT w.id, coalesce(a.embedding, b.embedding, c.embedding) AS e FROM w LEFT JOIN v a ON a.word = w.lemma LEFT JOIN v b ON b.word = lower(w.lemma) LEFT JOIN v c ON c.word = concat(upper(left(w.lemma, 1)), lower(substr(w.lemma, 2))))
    SELECT id, round(CAST(e[1] AS DOUBLE), 6) AS first_value, len(e) AS dims FROM f WHERE e IS NOT NULL
""")
def vector_lookup(spark, sf_dir):
    """Vectors under a word's own, its lower-case or its capitalised form."""
    t = Tables(spark, sf_dir)
    words = t.customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("WorT"), "c_custkey").alias("lemma"))
    return layout.word_vectors(words, _vectors(t)).select("id", F.round(F.col("vector")[0].cast("double"), 6).alias("first_value"), F.size("vector").cast("long").alias("dims"))


def _vectors(t: Tables):
    form = F.element_at(F.array(F.lit("Wort"), F.lit("wort"), F.lit("WORT")), (F.col("vec_id") % 3 + 1).cast("int"))
    return t.embeddings.select(F.concat(form, "vec_id").alias("word"), F.col("embedding").alias("vector"))


@query("""
    WITH v AS (SELECT DISTINCT lower(CASE vec_id % 3 WHEN 0 THEN concat('Wort', vec_id) WHEN 1 THEN concat('wort', vec_id) END) AS word FROM embeddings WHERE vec_id % 3 < 2),
    h AS (SELECT c_nationkey, v.word IS NOT NULL AS hit FROM customer LEFT JOIN v ON v.word = concat('wort', c_custkey)), g AS (SELECT c_nationkey, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses FROM h GROUP BY 1)
    SELECT CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(misses) AS BIGINT) AS misses, count(*) FILTER (hits > 0) AS placed, count(*) FILTER (hits = 0) AS missing FROM g
""")
def vector_counters(spark, sf_dir):
    t = Tables(spark, sf_dir)
    words = t.customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("WorT"), "c_custkey").alias("lemma"), F.col("c_nationkey").alias("cluster"))
    return layout.vector_counts(words, _vectors(t))


_LINES = "n AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey), o AS (SELECT o_custkey, o_orderkey, coalesce(lines, 0) AS lines, CASE left(o_orderpriority, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 ELSE 2 END AS lv, CASE WHEN o_orderkey % 7 = 0 THEN 99 ELSE o_orderkey % 7 END AS freq FROM orders LEFT JOIN n ON l_orderkey = o_orderkey)"


@query(f"""
    WITH {_LINES}, g AS (SELECT o_custkey AS k, count(*) AS size, min(o_orderkey) AS first, max(o_orderkey) AS last, arg_min(o_orderkey, row(lv, freq, o_orderkey)) AS basic, arg_min(lines, row(-lines, o_orderkey)) AS stages, count(*) FILTER (o_orderkey % 4 = 1) AS compounds, min(o_orderkey) FILTER (o_orderkey % 4 = 1) AS first_compound FROM o GROUP BY 1 HAVING count(*) >= 3)
    SELECT concat('r-', row_number() OVER (ORDER BY size DESC, first) - 1) AS id, CAST(k AS VARCHAR) AS form, CAST(basic AS VARCHAR) AS basic_word, size, stages AS chain_size, CAST(first AS VARCHAR) AS first_word, CAST(last AS VARCHAR) AS last_word, size AS links, compounds, CASE WHEN compounds > 0 THEN concat('o·', first_compound) END AS split FROM g
""")
def cluster_documents(spark, sf_dir):
    """Customers as roots and their orders as words: basic word, longest chain, size filter, nested documents."""
    t = Tables(spark, sf_dir)
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.lit("nhg").alias("stage"), F.col("l_linenumber").cast("string").alias("form"))).alias("chain"))
    none = F.array().cast("array<struct<stage:string,form:string>>")
    key = F.col("o_orderkey")
    words = t.orders.join(n, "o_orderkey", "left").select(
        key.alias("ord"), key.cast("string").alias("id"), key.cast("string").alias("lemma"), F.lit("NOUN").alias("pos"), (key % 7).cast("int").alias("frequency_class"),
        F.when(F.left("o_orderpriority", F.lit(1)) == "1", "A1").when(F.left("o_orderpriority", F.lit(1)) == "2", "A2").otherwise("B1").alias("cefr_level"),
        F.concat(F.lit("la:"), "o_custkey").alias("root_key"), F.coalesce("chain", none).alias("chain"), none.alias("cognates"), F.lit(None).cast("string").alias("borrowing_info"),
        F.array().cast("array<string>").alias("segments"), F.when(key % 4 == 1, F.array(F.lit("o"), key.cast("string"))).alias("parts"),
    )
    found = clustering.clusters(words, min_size=3)
    docs = clustering.size_at_least(clustering.documents(found), 3)
    basic = found.select("root_key", "basic_word")
    return docs.join(basic, "root_key").select(
        "wurzel.id", "wurzel.form", "basic_word", F.size("words").cast("long").alias("size"), F.size("wurzel.etymology_chain").cast("long").alias("chain_size"),
        F.element_at("words", 1)["id"].alias("first_word"), F.element_at("words", -1)["id"].alias("last_word"), F.size("links").cast("long").alias("links"),
        F.size("compounds").cast("long").alias("compounds"), F.try_element_at("compounds", F.lit(1))["split_display"].alias("split"),
    )


@query("""
    WITH w AS (SELECT p_partkey AS id, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, p_size % 3 = 0 AS rooted FROM part),
    k AS (SELECT b AS lemma, min(id) AS id FROM w WHERE rooted GROUP BY b)
    SELECT w.id, coalesce('k:' || x.id, 'k:' || y.id) AS root_key FROM w LEFT JOIN k x ON x.lemma = w.a LEFT JOIN k y ON y.lemma = w.b WHERE NOT rooted
""")
def own_list_adoption(spark, sf_dir):
    """Unrooted words whose own list (both words of their name, in order) names a rooted one."""
    parts = F.split("p_name", " ")
    rows = Tables(spark, sf_dir).part.select("p_partkey", parts.alias("parts"), (F.col("p_size") % 3 == 0).alias("rooted"))
    none = F.array().cast("array<string>")
    keys = rows.where("rooted").groupBy(F.col("parts")[1].alias("lemma")).agg(F.min("p_partkey").alias("ord")).select("lemma", "ord", F.concat(F.lit("k:"), "ord").alias("root_key"), none.alias("derived"))
    bare = rows.where("not rooted").select(F.concat(F.lit("part "), "p_partkey").alias("lemma"), F.col("p_partkey").alias("ord"), F.lit(None).cast("string").alias("root_key"), F.col("parts").alias("derived"))
    adopted = clustering.adopt_once(keys.unionByName(bare)).where("lemma like 'part %'")
    return adopted.select(F.col("ord").alias("id"), "root_key")


@query("""
    WITH n AS (SELECT l_partkey AS id, arg_max(l_returnflag, CAST(l_linenumber AS BIGINT) * 1000000000 + l_orderkey) FILTER (l_returnflag <> 'A') AS mode, arg_max(l_orderkey, CAST(l_linenumber AS BIGINT) * 1000000000 + l_orderkey) FILTER (l_quantity > 25) AS tag FROM lineitem GROUP BY 1)
    SELECT coalesce(p_partkey, id) AS id, coalesce(mode, p_brand) AS name, coalesce(tag, p_size) AS tag FROM part FULL JOIN n ON id = p_partkey
""")
def upsert_arrays(spark, sf_dir):
    """A batch folded by key: the last given name, and the last list that is not empty."""
    t = Tables(spark, sf_dir)
    new = t.lineitem.select(
        F.col("l_partkey").alias("id"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_orderkey")).alias("ord"), F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("name"),
        F.when(F.col("l_quantity") > 25, F.array(F.col("l_orderkey").cast("long"))).otherwise(F.array().cast("array<long>")).alias("tags"),
    )
    old = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.array(F.col("p_size").cast("long")).alias("tags"))
    folded = merge.fold(new, ["id"], "ord", ["name"], ["tags"], [])
    return merge.upsert(old, folded, ["id"], ["name"], ["tags"]).select("id", "name", F.col("tags")[0].alias("tag"))


@query(r"""
    SELECT doc_id, regexp_replace(text, '\s+([.,;:!?])', '\1', 'g') AS tidy, left(text, 10) AS begin FROM documents WHERE text IS NOT NULL
""")
def tidy_texts(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents.where("text is not null")
    return docs.select("doc_id", text.tidy_punctuation(F.col("text")).alias("tidy"), text.date_prefix(F.col("text")).alias("begin"))


@query("""
    SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS shown FROM pages
""")
def escaped_pages(spark, sf_dir):
    return Tables(spark, sf_dir).pages.select("page_id", text.escape_html(F.col("html")).alias("shown"))


@query("""
    WITH u AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('https://a/', c_custkey) END AS a, concat('https://b/', c_nationkey) AS b FROM customer)
    SELECT id, 'Dictionary' AS label, a AS url FROM u WHERE a <> '' UNION ALL SELECT id, 'corpus', b FROM u
""")
def source_labels(spark, sf_dir):
    """Links of an entry without empty ones, under a label where there is one."""
    rows = Tables(spark, sf_dir).customer.select(
        F.col("c_custkey").alias("id"),
        F.create_map(F.lit("dict"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("https://a/"), "c_custkey")), F.lit("corpus"), F.concat(F.lit("https://b/"), "c_nationkey")).alias("urls"),
    )
    return rows.select("id", F.explode(arrays.labelled_urls(F.col("urls"), {"dict": "Dictionary"})).alias("label", "url"))


@query("""
    WITH l AS (SELECT o_custkey AS id, o_orderkey, l_linenumber, concat(l_returnflag, l_linenumber % 3) AS lemma FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
    g AS (SELECT *, row_number() OVER (PARTITION BY id, o_orderkey ORDER BY l_linenumber, lemma) AS i FROM l), f AS (SELECT id, lemma, min(o_orderkey * 100 + i) AS place FROM g WHERE i <= 5 GROUP BY 1, 2)
    SELECT id, lemma, row_number() OVER (PARTITION BY id ORDER BY place) AS rank FROM f
""")
def collocations(spark, sf_dir):
    """Orders of a customer as relation groups, their lines as entries: five of each, once each, in order."""
    t = Tables(spark, sf_dir)
    lines = t.lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat("l_returnflag", F.col("l_linenumber") % 3).alias("lemma")))), lambda x: F.struct(x["lemma"].alias("lemma"))).alias("entries"))
    groups = t.orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "entries"))).alias("groups"))
    return groups.select("id", F.posexplode(arrays.collocations(F.col("groups"))).alias("i", "lemma")).select("id", "lemma", (F.col("i") + 1).cast("long").alias("rank"))


@query("SELECT CASE WHEN p_size % 10 = 0 THEN 'default' ELSE p_brand END AS kind, count(*) AS n, min(p_partkey) AS first_key, max(p_partkey) AS last_key, CAST(ceil(count(*) / 50.0) AS BIGINT) AS batches FROM part GROUP BY 1")
def instance_lists(spark, sf_dir):
    """Parts by brand, some without one, in lists of at most 50, put together again."""
    rows = Tables(spark, sf_dir).part.select(F.when(F.col("p_size") % 10 != 0, F.col("p_brand")).alias("kind"), F.col("p_partkey").alias("key"))
    lists = clustering.instance_lists(rows, "kind", "key", size=50)
    return lists.groupBy("kind").agg(F.sum(F.size("keys")).alias("n"), F.min(F.element_at("keys", 1)).alias("first_key"), F.max(F.element_at("keys", -1)).alias("last_key"), F.count("*").alias("batches"))


@query("SELECT p_brand AS cluster, count(*) AS size FROM part GROUP BY 1 ORDER BY size DESC, cluster LIMIT 10")
def largest_clusters(spark, sf_dir):
    sizes = Tables(spark, sf_dir).part.groupBy(F.col("p_brand").alias("cluster")).agg(F.count("*").alias("size"))
    return search.largest(sizes, "size", 10, "cluster")


@query("""
    WITH b AS (SELECT DISTINCT p_brand AS c, p_size AS s FROM part WHERE p_size > 25), p AS (SELECT c, min(s) AS x, max(s) AS z FROM b GROUP BY c), k AS (SELECT DISTINCT p_brand AS cluster FROM part)
    SELECT cluster, CAST(x AS DOUBLE) AS x, CAST(z AS DOUBLE) AS z, CAST(z - x AS DOUBLE) AS height FROM k LEFT JOIN p ON c = cluster
""")
def attached_positions(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    placed = part.where("p_size > 25").groupBy(F.col("p_brand").alias("root_id")).agg(F.min("p_size").cast("double").alias("x"), F.max("p_size").cast("double").alias("z")).withColumn("island_height", F.col("z") - F.col("x"))
    found = layout.attach_positions(part.select(F.col("p_brand").alias("cluster")).distinct(), placed)
    return found.select("cluster", "position.x", "position.z", "position.height")


@query("""
    SELECT n_name AS source_shown, r_name AS target_shown, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL
""")
def edge_ends(spark, sf_dir):
    """Edges with what is shown of both ends."""
    t = Tables(spark, sf_dir)
    nodes = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("form")).unionByName(t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("form")))
    edges = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("n"), "n_nationkey").alias("from_id"), F.concat(F.lit("r"), "n_regionkey").alias("to_id"))
    return graph.with_ends(edges, nodes, "from_id", "to_id").groupBy("source_shown", "target_shown").agg(F.count("*").alias("n"))


@query("""
    WITH t AS (SELECT doc_id, unnest(string_split_regex(lower(CASE WHEN doc_id % 5 = 1 THEN 'changed text' ELSE text END), '[^\\p{L}\\p{N}]+')) AS token FROM documents WHERE doc_id % 5 <> 0)
    SELECT count(DISTINCT doc_id) AS docs, count(*) FILTER (token = 'changed') AS changed, count(DISTINCT doc_id) FILTER (doc_id % 5 = 0) AS gone FROM t WHERE token <> ''
""")
def index_upkeep(spark, sf_dir):
    """A token index after a fifth of the rows was deleted and a fifth changed."""
    docs = Tables(spark, sf_dir).documents
    touched = docs.where("doc_id % 5 in (0, 1)").select("doc_id")
    now = docs.where("doc_id % 5 = 1").select("doc_id", F.lit("changed text").alias("text"))
    index = search.index_after(search.token_index(docs, "doc_id", "text"), touched, now, "doc_id", "text")
    return index.agg(F.countDistinct("doc_id").alias("docs"), F.coalesce(F.sum(F.when(F.col("token") == "changed", F.col("n"))), F.lit(0)).alias("changed"), F.countDistinct(F.when(F.col("doc_id") % 5 == 0, F.col("doc_id"))).alias("gone"))
