"""Dictionary records to entries and forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.arrays import all_form_of, distinct_by, distinct_ci, first, first_given, flat_field, or_empty, usage_labels, words_of, zip_short
from ..functions.text import entry_key, gender_keyword, html_fragment, listed, pos_keyword, scalar, squash_space, token_ok
from ..functions.vocab import REGISTER_TAGS, base_upos, record_upos

_EMPTY_WORDS = "array<struct<word:string>>"


def template_gender(heads: Column) -> Column:
    """First gender of argument 1 (or g): m, f, n, or a value that begins with one."""
    given = F.transform(heads, lambda h: F.left(F.coalesce(F.nullif(h["args"]["1"], F.lit("")), h["args"]["g"]), F.lit(1)))
    return first(F.filter(given, lambda g: g.isin("m", "f", "n")))


def template_auxiliary(heads: Column) -> Column:
    # Fixed value: what a heading says of it.
    pattern = r"(?i)\bauxiliary\s+(haben|sein)\b"

    def one(h: Column) -> Column:
        named = F.nullif(F.regexp_extract(F.coalesce(h["expansion"], F.lit("")), pattern, 1), F.lit(""))
        return F.lower(F.coalesce(named, F.nullif(h["args"]["aux"], F.lit("")), F.nullif(h["args"]["auxiliary"], F.lit(""))))

    return first_given(F.transform(heads, one))


def template_verb_class(heads: Column) -> Column:
    # Fixed value: what a heading says of it.
    pattern = r"(?i)\bclass\s+(\d+)\s+(strong|weak|mixed)\b"

    def one(h: Column) -> Column:
        text = F.coalesce(h["expansion"], F.lit(""))
        given = F.nullif(h["args"]["class"], F.lit(""))
        return (
            F.when(text.rlike(pattern), F.concat_ws("/", F.lower(F.regexp_extract(text, pattern, 2)), F.regexp_extract(text, pattern, 1)))
            .when(F.lower(text).contains("irregular"), "irregular").when(F.lower(text).contains("weak"), "weak")
            .when(given.rlike(r"^\d+$"), F.concat(F.lit("strong/"), given)).otherwise(given)
        )

    return first_given(F.transform(heads, one))


def template_degree(heads: Column, pattern: str, args: list[str]) -> Column:
    def one(h: Column) -> Column:
        found = F.rtrim(F.regexp_extract(F.coalesce(h["expansion"], F.lit("")), pattern, 1), F.lit(",) "))
        return F.coalesce(F.nullif(found, F.lit("")), *[F.nullif(h["args"][a], F.lit("")) for a in args])

    return first_given(F.transform(heads, one))


def comparative(heads: Column) -> Column:
    return template_degree(heads, r"(?i)\bcomparative\s+(\S+)", ["comp", "comparative"])


def superlative(heads: Column) -> Column:
    return template_degree(heads, r"(?i)\bsuperlative\s+((?:am\s+)?\S+)", ["sup", "superlative"])


def _prepared(records: DataFrame) -> DataFrame:
    """Records with a word, their missing lists made empty, key and kind."""
    rows = records.withColumn("word", F.trim("word")).where(F.col("word") != "")
    lists = {c: f for c, f in rows.dtypes if f.startswith("array")}
    rows = rows.withColumns({c: or_empty(F.col(c), kind) for c, kind in lists.items()})
    return rows.withColumn("upos", record_upos(F.coalesce("pos", F.lit("")))).withColumn("id", entry_key(F.col("word"), F.col("upos"))).withColumn("form_only", all_form_of(F.col("senses")))


def forms(records: DataFrame) -> DataFrame:
    """form, entry_id, tags, source: inflected forms with tags, the lemma's own form, links of form-only records.

    A link takes the part of speech of the record that holds it. The first row of a (form, entry) stays.
    """
    rows = _prepared(records)
    inflected = rows.select("ord", F.lit(0).alias("step"), F.posexplode("forms").alias("i", "f"), "word", "id").select("ord", "step", "i", F.trim("f.form").alias("form"), F.col("id").alias("entry_id"), or_empty(F.col("f.tags")).alias("tags"), "word")
    inflected = inflected.where((F.col("form") != "") & (F.col("form") != F.col("word")) & (F.size("tags") > 0)).drop("word")
    own = rows.where((F.size("senses") > 0) & ~F.col("form_only")).select("ord", F.lit(1).alias("step"), F.lit(0).alias("i"), F.col("word").alias("form"), F.col("id").alias("entry_id"), F.array(F.lit("lemma")).alias("tags"))
    senses = rows.where("form_only").select("ord", "word", "upos", F.posexplode("senses").alias("i", "s"))
    links = senses.select("ord", F.lit(2).alias("step"), "i", "word", "upos", or_empty(F.col("s.tags")).alias("tags"), F.explode(or_empty(F.col("s.form_of"), _EMPTY_WORDS)).alias("of"))
    links = links.where(F.trim("of.word") != "").select("ord", "step", "i", F.col("word").alias("form"), entry_key(F.trim("of.word"), F.col("upos")).alias("entry_id"), "tags")
    every = inflected.unionByName(own).unionByName(links)
    best = every.groupBy("form", "entry_id").agg(F.min_by("tags", F.struct("ord", "step", "i")).alias("tags"))
    return best.withColumn("source", F.lit("record"))


def entries(records: DataFrame) -> DataFrame:
    """Lemma entries, one a record that is not form-only; folding records of one key is the upsert's work."""
    rows = _prepared(records).where("not form_only")
    s, heads, sounds = F.col("senses"), F.col("head_templates"), F.col("sounds")
    glosses = F.filter(F.transform(flat_field(s, "glosses"), F.trim), lambda g: (g != "") & (F.length(g) < 200) & (F.lower(g) != "inflection of"))

    def example(x: Column) -> Column:
        return F.struct(F.trim(x["text"]).alias("de"), F.nullif(F.trim(x["english"]), F.lit("")).alias("en"))

    def examples(arr: Column) -> Column:
        return F.filter(F.transform(arr, example), lambda e: e["de"] != "")

    def sense(x: Column) -> Column:
        return F.struct(
            F.slice(or_empty(x["glosses"]), 1, 5).alias("glosses"),
            F.slice(F.filter(or_empty(x["tags"]), lambda t: t != "form-of"), 1, 10).alias("tags"),
            F.coalesce(first(x["topics"]), F.lit("")).alias("domain"),
            F.slice(examples(F.coalesce(x["examples"], F.array().cast("array<struct<text:string,english:string>>"))), 1, 2).alias("examples"),
        )

    def relation(name: str, limit: int, top: str | None = None) -> Column:
        own = flat_field(s, name)
        return words_of(F.concat(own, F.col(top)) if top else own, limit)

    def degree(value: Column, name: str) -> Column:
        return F.when(value.isNotNull(), F.array(F.struct(value.alias("form"), F.array(F.lit(name)).alias("tags")))).otherwise(F.array().cast("array<struct<form:string,tags:array<string>>>"))

    inflected = F.filter(F.transform("forms", lambda f: F.struct(F.trim(f["form"]).alias("form"), or_empty(f["tags"]).alias("tags"))), lambda f: (f["form"] != "") & (F.size(f["tags"]) > 0))
    return rows.select(
        "ord", "id", F.col("word").alias("lemma"), F.col("upos").alias("pos"),
        template_gender(heads).alias("gender"),
        first_given(F.transform(sounds, lambda x: x["ipa"])).alias("ipa"),
        first_given(F.transform(sounds, lambda x: F.coalesce(F.nullif(x["mp3_url"], F.lit("")), x["ogg_url"]))).alias("audio_url"),
        F.nullif(F.array_join(listed(F.col("hyphenation")), "·"), F.lit("")).alias("syllabification"),
        scalar(F.col("etymology_text")).alias("etymology"),
        F.slice(F.array_distinct(glosses), 1, 12).alias("translations"),
        F.transform(s, sense).alias("senses"),
        F.slice(F.array_distinct(examples(flat_field(s, "examples"))), 1, 8).alias("examples"),
        F.concat(degree(comparative(heads), "comparative"), degree(superlative(heads), "superlative"), inflected).alias("inflections"),
        relation("synonyms", 20).alias("synonyms"), relation("antonyms", 10).alias("antonyms"),
        relation("hypernyms", 10).alias("hypernyms"), relation("hyponyms", 20).alias("hyponyms"),
        relation("derived", 30, "derived").alias("derived"), relation("related", 20, "related").alias("related"),
        first_given(F.transform(sounds, lambda x: first(listed(x["rhymes"])))).alias("rhymes"),
        F.slice(F.flatten(F.transform(sounds, lambda x: listed(x["homophones"]))), 1, 5).alias("homophones"),
        words_of(F.col("proverbs"), 5).alias("proverbs"),
        first_given(F.slice("wikidata", 1, 1)).alias("wikidata_id"), first_given(F.slice("wikipedia", 1, 1)).alias("wikipedia"),
        F.nullif("literal_meaning", F.lit("")).alias("compound_parts"),
        template_auxiliary(heads).alias("auxiliary"), template_verb_class(heads).alias("verb_class"),
        F.slice(usage_labels(s, REGISTER_TAGS), 1, 10).alias("usage_labels"),
        F.slice(F.array_distinct(flat_field(s, "topics")), 1, 10).alias("subject_domains"),
    )


def base_entries(articles: DataFrame) -> DataFrame:
    """Entries of a base dictionary (ord, word, html): articles of one word fold into one entry.

    The first part of speech and gender that are given count; translations are distinct whatever their
    case; examples are distinct; a word without translations gives nothing.
    """
    rows = articles.where(token_ok(F.col("word"))).select("ord", "word", html_fragment(F.col("html")).alias("p"))
    clean = F.filter(F.transform("p.translations", squash_space), lambda t: (t != "") & (F.length(t) < 120))
    rows = rows.select("ord", "word", pos_keyword(F.col("p.pos")).alias("pos"), gender_keyword(F.col("p.pos")).alias("gender"), clean.alias("t"), zip_short(F.col("p.examples_de"), F.col("p.examples_en")).alias("e"))
    by_ord = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", c))), lambda x: x[c]))
    folded = rows.groupBy("word").agg(
        F.min_by("pos", F.when(F.col("pos") != "", F.col("ord"))).alias("pos"), F.min_by("gender", F.when(F.col("gender").isNotNull(), F.col("ord"))).alias("gender"),
        by_ord("t").alias("t"), by_ord("e").alias("e"), F.count("*").alias("n"),
    )
    folded = folded.where(F.size("t") > 0).withColumn("upos", base_upos(F.coalesce("pos", F.lit(""))))
    return folded.select(entry_key(F.col("word"), F.col("upos")).alias("id"), F.col("word").alias("lemma"), F.col("upos").alias("pos"), "gender", F.slice(distinct_ci(F.col("t")), 1, 8).alias("translations"), F.slice(F.array_distinct("e"), 1, 5).alias("examples"), F.col("n").alias("senses"))


def response_entries(lines: DataFrame) -> DataFrame:
    """Raw records (ord, value: JSON text) in the form of a service's answer: senses, forms, sounds as they are.

    A synonym may be a word or an object that has one. Lines that are no object go.
    """
    r = F.from_json("value", schemas.RESPONSE)

    def sense(s: Column) -> Column:
        word = lambda v: F.when(F.left(F.trim(v), F.lit(1)) == "{", F.get_json_object(v, "$.word")).otherwise(v)
        lists = {c: F.coalesce(s[c], F.array().cast(t)) for c, t in (("glosses", "array<string>"), ("raw_glosses", "array<string>"), ("tags", "array<string>"), ("links", "array<array<string>>"), ("synonyms", "array<string>"))}
        lists["synonyms"] = F.transform(lists["synonyms"], word)
        return F.struct(*[v.alias(k) for k, v in lists.items()])

    rows = lines.where(F.left(F.trim("value"), F.lit(1)) == "{").select("ord", r.alias("r")).where("r is not null")
    none = lambda c, t: F.coalesce(F.col(f"r.{c}"), F.array().cast(t))
    return rows.select(
        "ord", F.coalesce("r.word", F.lit("")).alias("word"), F.coalesce("r.pos", F.lit("")).alias("pos"), "r.etymology_number", F.transform(F.coalesce("r.senses", F.array()), sense).alias("senses"),
        none("forms", "array<struct<form:string,tags:array<string>>>").alias("forms"), "r.etymology_text", none("sounds", "array<struct<ipa:string,ogg_url:string,mp3_url:string>>").alias("sounds"),
    )


def word_response(entries: DataFrame) -> DataFrame:
    """One answer a word: all senses in order, forms once each, etymologies joined by "; ", null without one."""
    parts = F.array_sort(F.collect_list(F.struct("ord", "senses", "forms", "etymology_text")))
    folded = entries.groupBy("word").agg(parts.alias("p"))
    texts = F.filter(F.transform("p", lambda x: x["etymology_text"]), lambda t: t.isNotNull() & (t != ""))
    return folded.select(
        "word", F.flatten(F.transform("p", lambda x: x["senses"])).alias("senses"),
        distinct_by(F.flatten(F.transform("p", lambda x: x["forms"])), lambda f: f["form"]).alias("forms"), F.nullif(F.array_join(texts, "; "), F.lit("")).alias("etymology"),
    )
