"""Merge, lookup, search, page, count and validation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..operators import merge, search, validate
from ..streaming.streams import evicted, touch_hits
from .registry import Tables, query


@query("SELECT lang AS pos, count(*) AS n FROM documents GROUP BY lang")
def pos_breakdown(spark, sf_dir):
    return Tables(spark, sf_dir).documents.groupBy(F.col("lang").alias("pos")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pos")


@query("""
    SELECT count(*) AS total, count(quality) AS with_quality, count(*) FILTER (length(text) >= 1000) AS long_text, count(*) FILTER (toxic = 1) AS toxic_docs,
           CAST(100 * count(quality) // greatest(1, count(*)) AS BIGINT) AS with_quality_pct, CAST(100 * count(*) FILTER (length(text) >= 1000) // greatest(1, count(*)) AS BIGINT) AS long_text_pct,
           CAST(100 * count(*) FILTER (toxic = 1) // greatest(1, count(*)) AS BIGINT) AS toxic_docs_pct
    FROM documents LEFT JOIN labels USING (doc_id)
""")
def coverage_stats(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.documents.join(t.labels, "doc_id", "left")
    return search.coverage(rows, {"with_quality": F.col("quality").isNotNull(), "long_text": F.length("text") >= 1000, "toxic_docs": F.col("toxic") == 1})


_COUNTED = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _COUNTED))
def multi_table_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return search.counts_of({name: getattr(t, name) for name in _COUNTED})


def _part_lexicon(t: Tables):
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("lemma"), F.col("p_size").alias("rank"))


def _part_forms(t: Tables):
    """Second words of part names stand for inflected forms."""
    return t.part.select(F.col("p_partkey").alias("entry_id"), F.split("p_name", " ")[1].alias("form"))


@query("""
    WITH direct AS (SELECT p_partkey AS id, p_name AS lemma, p_size AS rank FROM part WHERE lower(p_name) LIKE 'r%'
                    ORDER BY CASE WHEN lower(p_name) = 'r' THEN 0 ELSE 1 END, p_size ASC NULLS LAST, p_name, p_partkey LIMIT 20),
         other AS (SELECT p_partkey AS id, p_name AS lemma, p_size AS rank FROM part WHERE lower(string_split(p_name, ' ')[2]) LIKE 'r%' ORDER BY p_name, p_partkey LIMIT 20)
    SELECT *, 'lemma' AS via FROM direct UNION ALL SELECT *, 'form' AS via FROM other WHERE id NOT IN (SELECT id FROM direct)
""")
def prefix_search(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return search.search(_part_lexicon(t), _part_forms(t), "r", 20)


@query("""
    WITH s AS (SELECT p_partkey AS id, p_name AS lemma, lower(p_name) AS low, lower(p_type) AS gloss FROM part),
    b AS (SELECT *, CASE WHEN starts_with(low, 'red r') THEN 200 ELSE 0 END + CASE WHEN contains(low, 'red r') THEN 100 ELSE 0 END AS base,
                 list_reduce(list_prepend({'at': 1, 'hits': 0, 'ch': ''}, list_transform(string_split('red r', ''), lambda c: {'at': 0, 'hits': 0, 'ch': c})),
                     lambda acc, x: CASE WHEN instr(substr(low, acc.at), x.ch) > 0 THEN {'at': CAST(acc.at + instr(substr(low, acc.at), x.ch) AS INTEGER), 'hits': acc.hits + 1, 'ch': ''} ELSE acc END).hits AS greedy
          FROM s)
    SELECT id, lemma, CAST(CASE WHEN low = 'red r' THEN 1000 ELSE CASE WHEN base > 0 THEN base ELSE greedy END + CASE WHEN contains(gloss, 'red r') THEN 20 ELSE 0 END END AS INTEGER) AS score
    FROM b WHERE CASE WHEN base > 0 THEN base ELSE greedy END > 0 ORDER BY score DESC, id LIMIT 8
""")
def scored_search(spark, sf_dir):
    words = Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("lemma"), F.col("p_type").alias("definition_en"))
    return search.scored_search(words, "red r", order="id").select("id", "lemma", F.col("score").cast("int").alias("score"))


_ORDERS_SINCE = "1997-06-01"


@query(f"SELECT o_orderkey AS id, o_orderdate AS updated_at FROM orders WHERE o_orderdate > TIMESTAMP '{_ORDERS_SINCE}' ORDER BY o_orderdate, o_orderkey LIMIT 500")
def sync_page_compat(spark, sf_dir):
    rows = Tables(spark, sf_dir).orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at"))
    return search.sync_page(rows, F.lit(_ORDERS_SINCE).cast(rows.schema["updated_at"].dataType))


@query(f"""
    WITH page AS (SELECT o_orderkey AS id, o_orderdate AS updated_at FROM orders
                  WHERE o_orderdate > TIMESTAMP '{_ORDERS_SINCE}' OR (o_orderdate = TIMESTAMP '{_ORDERS_SINCE}' AND o_orderkey > 100) ORDER BY o_orderdate, o_orderkey LIMIT 300)
    SELECT max(updated_at) AS next_cursor, (SELECT id FROM page ORDER BY updated_at DESC, id DESC LIMIT 1) AS next_key, count(*) AS n_rows, count(*) >= 300 AS has_more FROM page
""")
def sync_page_keyset(spark, sf_dir):
    rows = Tables(spark, sf_dir).orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at"))
    page = search.sync_page(rows, F.lit(_ORDERS_SINCE).cast(rows.schema["updated_at"].dataType), 300, after_key=F.lit(100))
    return search.page_state(page, 300)


@query("""
    WITH k AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS lemma FROM nation), pick AS (SELECT min(n_name) AS v FROM nation)
    SELECT id, lemma FROM k WHERE id = (SELECT v FROM pick) UNION ALL SELECT id, lemma FROM k WHERE lemma = (SELECT v FROM pick) AND NOT EXISTS (SELECT 1 FROM k WHERE id = (SELECT v FROM pick))
""")
def point_lookup_fallback(spark, sf_dir):
    nation = Tables(spark, sf_dir).nation
    name = nation.agg(F.min("n_name")).first()[0]
    return search.lookup(nation.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("lemma")), name)


@query("""
    WITH tokens AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}]+')) AS form FROM documents WHERE text IS NOT NULL),
         first AS (SELECT form, lower(form) AS entry_id, min(doc_id) AS doc_id FROM tokens GROUP BY form),
         k AS (SELECT *, bool_or(form = entry_id) OVER (PARTITION BY entry_id) AS there FROM first)
    SELECT form, entry_id, doc_id FROM k WHERE there AND form <> entry_id
""")
def forms_index(spark, sf_dir):
    """Capitalised tokens as forms of the lower-case token, the first document of each form."""
    tokens = Tables(spark, sf_dir).documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}]+)"))).alias("form"))
    first = merge.first_wins(tokens, ["form"], "doc_id")
    forms = first.where(F.col("form") != F.lower("form")).withColumn("entry_id", F.lower("form"))
    return forms.join(first.select(F.col("form").alias("entry_id")), "entry_id", "left_semi").select("form", "entry_id", "doc_id")


@query("""
    WITH tsv AS (SELECT d.lang AS word, d.source AS ipa, d.doc_id AS ord FROM documents d JOIN labels l USING (doc_id)),
         best AS (SELECT word, arg_min(ipa, ord) AS ipa FROM tsv GROUP BY word)
    SELECT d.doc_id AS id, d.lang AS lemma, coalesce(CASE WHEN d.n_chars % 2 = 0 THEN d.source END, b.ipa) AS ipa FROM documents d LEFT JOIN best b ON d.lang = b.word
""")
def ipa_fill(spark, sf_dir):
    """Fill where null; the first pair of a word counts."""
    t = Tables(spark, sf_dir)
    rows = t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("lemma"), F.when(F.col("n_chars") % 2 == 0, F.col("source")).alias("ipa"))
    pairs = t.documents.join(t.labels, "doc_id").select(F.col("lang").alias("word"), F.col("source").alias("ipa"), F.col("doc_id").alias("ord"))
    return merge.overlay_first(rows, pairs, "ipa").select("id", "lemma", "ipa")


@query("""
    WITH tsv AS (SELECT d.source AS word, CASE WHEN l.quality = 1 THEN 'A1' ELSE 'A2' END AS level, d.doc_id AS ord FROM documents d JOIN labels l USING (doc_id)),
         best AS (SELECT word, arg_max(level, ord) AS level FROM tsv GROUP BY word)
    SELECT d.doc_id AS id, d.source AS lemma, coalesce(b.level, CASE WHEN d.n_chars % 3 = 0 THEN 'B1' END) AS cefr_level FROM documents d LEFT JOIN best b ON d.source = b.word
""")
def level_tag(spark, sf_dir):
    """Set wherever there is a pair; the last pair of a word counts."""
    t = Tables(spark, sf_dir)
    rows = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("lemma"), F.when(F.col("n_chars") % 3 == 0, F.lit("B1")).alias("cefr_level"))
    pairs = t.documents.join(t.labels, "doc_id").select(F.col("source").alias("word"), F.when(F.col("quality") == 1, "A1").otherwise("A2").alias("level"), F.col("doc_id").alias("ord"))
    return merge.overlay_last(rows, pairs, "cefr_level", "level").select("id", "lemma", "cefr_level")


@query("""
    WITH cut AS (SELECT (min(event_id) + max(event_id)) / 2 AS m FROM events),
    e AS (SELECT *, event_id > (SELECT m FROM cut) AS late, CASE WHEN value >= 5 THEN event_type END AS gender FROM events),
    old AS (SELECT user_id, arg_max(gender, event_id) FILTER (gender IS NOT NULL) AS gender, arg_max(value, event_id) AS value FROM e WHERE NOT late GROUP BY user_id),
    new AS (SELECT user_id, arg_max(gender, event_id) FILTER (gender IS NOT NULL) AS gender, arg_max(value, event_id) AS value FROM e WHERE late GROUP BY user_id)
    SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(n.gender, o.gender) AS gender, CASE WHEN n.user_id IS NOT NULL THEN n.value ELSE o.value END AS value,
           CASE WHEN o.user_id IS NOT NULL THEN 1 ELSE 2 END AS created_at, CASE WHEN n.user_id IS NOT NULL THEN 2 ELSE 1 END AS updated_at
    FROM old o FULL JOIN new n ON o.user_id = n.user_id
""")
def upsert_coalesce(spark, sf_dir):
    """The earlier half of the events as the table, the later half as the batch."""
    events = Tables(spark, sf_dir).events.withColumn("gender", F.when(F.col("value") >= 5, F.col("event_type")))
    middle = F.broadcast(events.agg(((F.min("event_id") + F.max("event_id")) / 2).alias("m")))  # one row
    rows = events.crossJoin(middle).withColumn("late", F.col("event_id") > F.col("m"))
    old, new = (merge.fold(rows.where(c), ["user_id"], "event_id", ["gender"], [], ["value"]) for c in ("not late", "late"))
    old = old.withColumn("created_at", F.lit(1)).withColumn("updated_at", F.lit(1))
    return merge.upsert(old, new, ["user_id"], keep_given=["gender"], replace=["value"], now=2)


@query("""
    WITH e AS (SELECT user_id, event_type, json_extract_string(props, '$.k') AS k, event_id FROM events),
         o AS (SELECT user_id, arg_min(k, event_id) AS k, arg_min(event_type, event_id) AS a FROM e GROUP BY user_id), n AS (SELECT user_id, arg_max(k, event_id) AS k, arg_max(event_type, event_id) AS b FROM e GROUP BY user_id)
    SELECT user_id, coalesce(n.k, o.k) AS k, o.a AS a, n.b AS b FROM o JOIN n USING (user_id)
""")
def provenance_union(spark, sf_dir):
    """Shallow union of two maps: k is in both, a and b in one each."""
    e = Tables(spark, sf_dir).events.withColumn("k", F.get_json_object("props", "$.k"))
    got = e.groupBy("user_id").agg(*[f(c, "event_id").alias(f"{n}_{c}") for n, f in (("old", F.min_by), ("new", F.max_by)) for c in ("k", "event_type")])
    union = arrays.merge_maps(F.create_map(F.lit("k"), F.col("old_k"), F.lit("a"), F.col("old_event_type")), F.create_map(F.lit("k"), F.col("new_k"), F.lit("b"), F.col("new_event_type")))
    return got.withColumn("m", union).select("user_id", F.col("m.k").alias("k"), F.col("m.a").alias("a"), F.col("m.b").alias("b"))


@query("""
    SELECT d.doc_id AS id, coalesce(CASE WHEN d.n_chars % 2 = 0 THEN 7 END, l.quality) AS frequency_class, coalesce(CASE WHEN d.n_chars % 3 = 0 THEN d.lang END, CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.toxic = 0 THEN 'clean' END) AS gender,
           (d.n_chars % 2 <> 0 AND l.quality IS NOT NULL) OR (d.n_chars % 3 <> 0 AND l.toxic IS NOT NULL) AS changed
    FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def enrich_missing(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.documents.select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") % 2 == 0, F.lit(7)).alias("frequency_class"), F.when(F.col("n_chars") % 3 == 0, F.col("lang")).alias("gender"))
    found = t.labels.select(F.col("doc_id").alias("id"), "quality", F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean").alias("kind"))
    return merge.fill_missing(rows, found, "id", {"frequency_class": "quality", "gender": "kind"})


@query("SELECT l_orderkey AS id, bool_and(l_returnflag = 'R') AS form_only FROM lineitem GROUP BY l_orderkey")
def form_only_flag(spark, sf_dir):
    """An order is a form-only record if all of its lines were returned."""
    senses = Tables(spark, sf_dir).lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.array(F.when(F.col("l_returnflag") == "R", "form-of").otherwise("plain")).alias("tags"), F.array().cast("array<string>").alias("form_of"))).alias("senses"))
    return senses.select("id", arrays.all_form_of(F.col("senses")).alias("form_only"))


@query("""
    WITH tokens AS (SELECT unnest(string_split_regex(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), ' ')) AS token FROM documents)
    SELECT token, count(*) AS n, length(token) BETWEEN 2 AND 60 AND regexp_matches(token, '^[\\p{L}\\p{No}\\p{Nl}_]') AND NOT regexp_matches(token, '[()\\[\\]{}]') AS ok FROM tokens WHERE token <> '' GROUP BY token
""")
def token_quality(spark, sf_dir):
    words = Tables(spark, sf_dir).documents.select(F.explode(F.split(F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " ")), " ")).alias("token")).where("token <> ''")
    return words.groupBy("token").agg(F.count("*").alias("n")).withColumn("ok", text.token_ok(F.col("token")))


@query("""
    WITH g AS (SELECT doc_id AS id, list_filter(string_split(text, '.')[1:3], lambda x: trim(x, ' ') <> '' AND length(x) < 200 AND NOT contains(lower(x), 'form of') AND NOT contains(lower(x), 'inflection of')) AS good, text FROM documents)
    SELECT id, CASE WHEN len(good) > 0 THEN good[1] ELSE left(text, 100) END AS definition FROM g
""")
def gloss_fallback(spark, sf_dir):
    """The first three sentences are senses of one gloss each; the text itself is the translation."""
    docs = Tables(spark, sf_dir).documents.where("text is not null")
    senses = F.transform(F.slice(F.split("text", r"\."), 1, 3), lambda s: F.struct(F.array(s).alias("glosses")))
    return docs.select(F.col("doc_id").alias("id"), text.definition(senses, F.array("text")).alias("definition"))


@query("""
    WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token, unnest(generate_series(1, len(string_split(text, ' ')))) AS i FROM documents),
         f AS (SELECT doc_id, lower(token) AS low, arg_min(token, i) AS token, min(i) AS i FROM t GROUP BY doc_id, lower(token))
    SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rank FROM f
""")
def ordered_dedup(spark, sf_dir):
    """Tokens of each text in order, the first of those that differ by case only."""
    tokens = arrays.distinct_ci(F.split("text", " "))
    return Tables(spark, sf_dir).documents.select("doc_id", F.posexplode(tokens).alias("i", "token")).select("doc_id", "token", (F.col("i") + 1).cast("long").alias("rank"))


def _ladder_sql(column: str, rules, default: str) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f"contains({column}, '{w}')" for w in words)} THEN '{value}'" for value, words in rules)
    return f"CASE {cases} ELSE {default} END"


_LABEL = "lower(concat(p_type, ' ', CASE p_size % 5 WHEN 0 THEN 'Pronoun' WHEN 1 THEN 'adverb' WHEN 2 THEN 'female, noun' WHEN 3 THEN 'adj neuter' ELSE 'art.' END))"


@query(f"SELECT p_partkey AS id, {_ladder_sql(_LABEL, text.POS_RULES, "''")} AS pos, {_ladder_sql(_LABEL, text.GENDER_RULES, 'NULL')} AS gender FROM part")
def pos_keyword_ladder(spark, sf_dir):
    kinds = F.element_at(F.array(*map(F.lit, ("Pronoun", "adverb", "female, noun", "adj neuter", "art."))), F.col("p_size") % 5 + 1)
    label = F.concat_ws(" ", "p_type", kinds)
    return Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("id"), text.pos_keyword(label).alias("pos"), text.gender_keyword(label).alias("gender"))


@query("""
    SELECT problem, what, count(*) AS n FROM (
        SELECT 'repeated' AS problem, 'orders' AS what FROM orders GROUP BY o_custkey HAVING count(*) > 1
        UNION ALL SELECT 'dangling', 'lineitem.l_partkey' FROM (SELECT DISTINCT l_partkey FROM lineitem) WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)
        UNION ALL SELECT 'missing', 'labels.quality' FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL) GROUP BY ALL
""")
def validation_report(spark, sf_dir):
    """Customers stand for keys that repeat, small parts for targets that are gone, unlabelled documents for gaps."""
    t = Tables(spark, sf_dir)
    problems = validate.report([validate.repeated(t.orders, "o_custkey", "orders"), validate.dangling(t.lineitem, "l_partkey", t.part.where("p_size > 10").withColumnRenamed("p_partkey", "part"), "part", "lineitem.l_partkey"), validate.missing(t.documents.join(t.labels, "doc_id", "left"), "doc_id", "quality", "labels.quality")])
    return validate.summary(problems).select("problem", "what", "n")


@query("""
    WITH h AS (SELECT event_id, user_id, epoch(ts)::BIGINT - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS gap FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events))
    SELECT user_id, count(*) AS n, count(*) FILTER (coalesce(gap <= 3600, false)) AS hits FROM h GROUP BY user_id
""")
def ttl_cache_hits(spark, sf_dir):
    events = Tables(spark, sf_dir).events.select("event_id", "user_id", F.date_trunc("second", "ts").alias("ts"))
    return touch_hits(events, 3600, "user_id", "ts", "event_id").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


@query("""
    WITH l AS (SELECT user_id, max(ts) AS last_used FROM events GROUP BY user_id), k AS (SELECT user_id FROM l ORDER BY last_used DESC, user_id LIMIT 25)
    SELECT user_id, last_used FROM l WHERE user_id NOT IN (SELECT user_id FROM k)
""")
def lru_evicted(spark, sf_dir):
    return evicted(Tables(spark, sf_dir).events, 25, "user_id", "ts")


@query("""
    SELECT p_partkey AS id, p_type AS pos, replace(p_name, ' ', '|') AS translations, CASE WHEN p_size % 2 = 0 THEN concat(p_brand, '|', p_size) ELSE '' END AS examples_de, CASE WHEN p_size % 2 = 0 THEN string_split(p_name, ' ')[1] ELSE '' END AS examples_en FROM part
""")
def html_articles(spark, sf_dir):
    """Dictionary articles made of parts, read by the fragment parser: word class, translations, examples of two languages."""
    words, size = F.split("p_name", " "), F.col("p_size").cast("string")
    examples = F.concat(
        F.format_string('<div class="example"><span lang="de">%s</span></div>', "p_brand"), F.format_string('<div class="example"><span lang="de">%s</span></div>', size), F.format_string('<div class="example"><span lang="en">%s</span></div>', words[0]),
    )
    article = F.concat(F.format_string('<b>%s</b><font color="green">%s</font>', "p_name", "p_type"), F.format_string('<ol><li><span lang="en">%s</span></li><li><span lang="en"> %s </span></li></ol>', words[0], words[1]), F.when(F.col("p_size") % 2 == 0, examples).otherwise(F.lit("")))
    found = Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("id"), text.html_fragment(article).alias("f"))
    return found.select("id", "f.pos", *[F.array_join(f"f.{c}", "|").alias(c) for c in ("translations", "examples_de", "examples_en")])


@query(r"""
    SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages
""")
def html_extract(spark, sf_dir):
    return Tables(spark, sf_dir).pages.select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"),
        F.size(F.regexp_extract_all("html", F.lit("(<p>)"))).cast("long").alias("paragraphs"),
    )


@query("""
    WITH t AS (SELECT doc_id, unnest(string_split_regex(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{L}\\p{N}]+')) AS token FROM documents)
    SELECT token, count(DISTINCT doc_id) AS docs, count(*) AS n FROM t WHERE token <> '' GROUP BY token
""")
def token_postings(spark, sf_dir):
    index = search.token_index(Tables(spark, sf_dir).documents, "doc_id", "text")
    return index.groupBy("token").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))
