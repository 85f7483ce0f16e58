"""Array, map and record rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import date_prefix, tidy_punctuation


def first(arr: Column) -> Column:
    """First item or null; an index past the end is null as well."""
    return F.try_element_at(arr, F.lit(1))


def first_given(arr: Column) -> Column:
    """First item that is neither null nor empty."""
    return first(F.filter(arr, lambda x: x.isNotNull() & (x != "")))


def or_empty(arr: Column, kind: str = "array<string>") -> Column:
    return F.coalesce(arr, F.array().cast(kind))


def json_length(text: Column) -> Column:
    return F.coalesce(F.json_array_length(text), F.lit(0))


def distinct_by(arr: Column, key: Callable[[Column], Column]) -> Column:
    """Items whose key has not stood before; order is kept, and items without a key go.

    Keys are sorted with their places, so the cost is that of a sort. One-item arrays bind what is computed
    once, as a lambda would compute it again for each item.
    """

    def bound(value: Column, then: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), then), F.lit(0))

    def of(items: Column) -> Column:
        order = F.array_sort(F.filter(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"))), lambda p: p["k"].isNotNull()))

        def firsts(s: Column) -> Column:
            fresh = F.filter(s, lambda p, j: (j == 0) | (F.get(s, j - 1)["k"] != p["k"]))
            return F.transform(F.array_sort(F.transform(fresh, lambda p: p["i"])), lambda i: F.get(items, i))

        return bound(order, firsts)

    return bound(arr, of)


def distinct_ci(arr: Column) -> Column:
    return distinct_by(arr, F.lower)


def zip_short(a: Column, b: Column, left: str = "de", right: str = "en") -> Column:
    """Pairs of both arrays up to the shorter one; pairs with an empty side go."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.struct(F.trim(x).alias(left), F.trim(y).alias(right)))
    return F.filter(pairs, lambda p: (p[left] != "") & (p[right] != ""))


def merge_maps(old: Column, new: Column) -> Column:
    """Shallow union of two string maps; of equal keys the new value stays. Null counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def words_of(items: Column, limit: int) -> Column:
    """Distinct non-empty `word` fields of an array of structs, in order."""
    return F.slice(F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x["word"])), lambda w: w != "")), 1, limit)


def flat_field(senses: Column, field: str) -> Column:
    """One list field of all senses, end to end."""
    return F.flatten(F.filter(F.transform(senses, lambda s: s[field]), lambda x: x.isNotNull()))


def usage_labels(senses: Column, register: list[str]) -> Column:
    """Register tags and qualifiers of all senses, in order, once each."""
    allowed = F.array(*[F.lit(r) for r in register])
    each = F.transform(senses, lambda s: F.concat(F.filter(or_empty(s["tags"]), lambda t: F.array_contains(allowed, t)), or_empty(s["qualifiers"])))
    return F.array_distinct(F.flatten(each))


def all_form_of(senses: Column) -> Column:
    """Whether every sense (of one at least) only refers to another form."""
    return (F.size(senses) > 0) & F.forall(senses, lambda s: (F.coalesce(F.size(s["form_of"]), F.lit(0)) > 0) | F.array_contains(or_empty(s["tags"]), "form-of"))


# --- landed service responses ---------------------------------------------------------------------


#: Landed corpus hits; the items of a context are JSON text: a word, or a list whose second item is one.
HITS = "array<struct<ctx_:array<string>,meta_:struct<date_:string,newspaper:string,title:string,textClass:string,author:string,bibl:string>>>"
#: Hits whose context is a list of text before, marked tokens and text after, as JSON text.
MARKED_HITS = HITS.replace("ctx_:array<string>", "ctx_:string")
_TOKENS = "array<struct<w:string,ws:string>>"


def context_words(items: Column) -> Column:
    """Words of a context whose items are words or lists with the word in second place; other items go."""
    word = lambda t: F.when(F.left(F.trim(t), F.lit(1)) == "[", F.get_json_object(t, "$[1]")).when(F.left(F.trim(t), F.lit(1)) != "{", t)
    return F.filter(F.transform(items, word), lambda w: w.isNotNull())


def corpus_response(hits: Column, corpus: Column, total: Column) -> Column:
    """(examples, stats) of marked hits: sentences with all that is told of them, and how many there are."""

    def example(h: Column) -> Column:
        m = h["meta_"]
        text = lambda c: F.coalesce(m[c], F.lit(""))
        tokens = F.from_json(F.get_json_object(h["ctx_"], "$[1]"), _TOKENS)
        return F.struct(
            F.coalesce(spaced_sentence(tokens), F.lit("")).alias("sentence"), text("title").alias("source"), text("date_").alias("date"), text("author").alias("author"),
            text("newspaper").alias("newspaper"), text("bibl").alias("bibl"), text("textClass").alias("textclass"),
        )

    examples = F.filter(F.transform(hits, example), lambda x: x["sentence"] != "")
    stats = F.struct(F.coalesce(corpus, F.lit("")).alias("corpus"), total.alias("total_occurrences"), F.size(examples).alias("examples_returned"))
    return F.struct(examples.alias("examples"), stats.alias("stats"))


def corpus_examples(hits: Column, limit: int = 8) -> Column:
    """Sentences of the first hits (of type HITS); a hit's source is its newspaper, else its title. Empty ones go."""

    def example(h: Column) -> Column:
        meta = h["meta_"]
        sentence = tidy_punctuation(F.trim(F.array_join(context_words(h["ctx_"]), " ")))
        source = F.coalesce(F.nullif(meta["newspaper"], F.lit("")), F.nullif(meta["title"], F.lit("")))
        return F.struct(sentence.alias("sentence"), source.alias("source"), F.nullif(date_prefix(meta["date_"]), F.lit("")).alias("date"), F.nullif(meta["textClass"], F.lit("")).alias("genre"))

    return F.filter(F.transform(F.slice(hits, 1, limit), example), lambda x: x["sentence"] != "")


def spaced_sentence(tokens: Column) -> Column:
    """Tokens with a flag for the space before them (`ws` = "1"); the first has none."""
    return F.trim(F.array_join(F.transform(tokens, lambda t, i: F.concat(F.when((t["ws"] == "1") & (i > 0), " ").otherwise(""), F.coalesce(t["w"], F.lit("")))), ""))


def merged_corpora(main: Column, second: Column, n_main: int = 10, n_second: int = 5) -> Column:
    return F.concat(F.slice(main, 1, n_main), F.slice(second, 1, n_second))


def frequency_points(points: Column) -> Column:
    """(year, f) of items whose fields are numbers, of years after 1500, f to two places."""
    typed = F.transform(points, lambda p: F.struct(p["year"].try_cast("int").alias("year"), F.round(p["f"].try_cast("double"), 2).alias("f")))
    return F.filter(typed, lambda p: (p["year"] > 1500) & p["f"].isNotNull())


def collocations(groups: Column, each: int = 5, limit: int = 20) -> Column:
    """The first lemmas of every relation group, once each."""
    lemmas = F.flatten(F.transform(groups, lambda g: F.transform(F.slice(g["entries"], 1, each), lambda e: F.trim(e["lemma"]))))
    return F.slice(F.array_distinct(F.filter(lemmas, lambda x: x != "")), 1, limit)


def labelled_urls(urls: Column, labels: dict[str, str]) -> Column:
    """URL map without empty values, keys replaced by labels where there is one."""
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.transform_keys(F.map_filter(urls, lambda _, v: v.isNotNull() & (v != "")), lambda k, _: F.coalesce(names[k], k))
