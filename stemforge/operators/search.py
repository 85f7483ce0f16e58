"""Lookup, ranked search, pages and counts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import match_score, prefix_like


def bounded(value: int, low: int, high: int, name: str) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}")
    return value


def prefix_search(entries: DataFrame, q: str, limit: int = 20, lemma: str = "lemma", rank: str = "rank", key: str = "id") -> DataFrame:
    """Lemmas that begin with q: an exact match first, then by rank (nulls last), lemma and key."""
    bounded(len(q), 1, 100, "length of q")
    bounded(limit, 1, 100, "limit")
    exact = F.when(F.lower(lemma) == q.lower(), 0).otherwise(1)
    return entries.where(prefix_like(F.col(lemma), q)).orderBy(exact, F.asc_nulls_last(rank), F.col(lemma), F.col(key)).limit(limit)


def forms_search(entries: DataFrame, forms: DataFrame, q: str, limit: int = 20, lemma: str = "lemma", key: str = "id") -> DataFrame:
    """Entries with an inflected form that begins with q; a form that is the lemma does not count."""
    hits = forms.where(prefix_like(F.col("form"), q)).join(entries, forms["entry_id"] == entries[key]).where(F.col("form") != F.col(lemma))
    return hits.select(*[entries[c] for c in entries.columns]).distinct().orderBy(lemma, key).limit(limit)


def search(entries: DataFrame, forms: DataFrame, q: str, limit: int = 20, **names: str) -> DataFrame:
    """Lemma hits, then form hits that are not among them."""
    direct = prefix_search(entries, q, limit, **names)
    key = names.get("key", "id")
    other = forms_search(entries, forms, q, limit, names.get("lemma", "lemma"), key)
    return direct.withColumn("via", F.lit("lemma")).unionByName(other.join(direct.select(key), key, "left_anti").withColumn("via", F.lit("form")))


def scored_search(words: DataFrame, q: str, k: int = 8, lemma: str = "lemma", gloss: str = "definition_en", order: str = "ord") -> DataFrame:
    """The k best matches; ties keep their order."""
    scored = words.withColumn("score", match_score(q, F.col(lemma), F.col(gloss)))
    return scored.where("score > 0").orderBy(F.desc("score"), order).limit(k)


def lookup(entries: DataFrame, value: str, key: str = "id", lemma: str = "lemma") -> DataFrame:
    """The entry of this key, or else all entries of this lemma."""
    by_key = entries.where(F.col(key) == value)
    found = by_key.select(F.lit(True).alias("__found")).limit(1)
    by_lemma = entries.where(F.col(lemma) == value).join(F.broadcast(found), F.lit(True), "left_anti")  # one row at most
    return by_key.unionByName(by_lemma)


def sync_page(rows: DataFrame, since: Column, limit: int = 500, stamp: str = "updated_at", key: str = "id", after_key: Column | None = None) -> DataFrame:
    """A page after a cursor. With `after_key` rows that share the cursor's stamp are not lost."""
    bounded(limit, 1, 2000, "limit")
    later = F.col(stamp) > since
    if after_key is not None:
        later = later | ((F.col(stamp) == since) & (F.col(key) > after_key))
    return rows.where(later).orderBy(stamp, key).limit(limit)


def page_state(page: DataFrame, limit: int, stamp: str = "updated_at", key: str = "id") -> DataFrame:
    """next_cursor, next_key and has_more of a page."""
    last = page.agg(F.max(F.struct(stamp, key)).alias("m"), F.count("*").alias("n"))
    return last.select(F.col("m")[stamp].alias("next_cursor"), F.col("m")[key].alias("next_key"), F.col("n").alias("n_rows"), (F.col("n") >= limit).alias("has_more"))


def forms_of(forms: DataFrame, entry_ids: DataFrame, limit: int = 2000) -> DataFrame:
    bounded(limit, 1, 10_000, "limit")
    return forms.join(entry_ids.select(F.col("id").alias("entry_id")).distinct(), "entry_id", "left_semi").orderBy("entry_id", "form").limit(limit)


def counts_of(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n), one row a table."""
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def coverage(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Total, and for each condition its count and integer percentage."""
    got = rows.agg(F.count("*").alias("total"), *[F.count_if(c).alias(name) for name, c in conditions.items()])
    return got.select("*", *[F.floor(100 * F.col(n) / F.greatest(F.lit(1), F.col("total"))).cast("long").alias(f"{n}_pct") for n in conditions])


def _plain_letters() -> tuple[str, str]:
    """Lower-case letters with diacritics, and the letters they stand on, by the decomposition of Unicode."""
    marked, plain = [], []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]):
        parts = [x for x in unicodedata.normalize("NFD", c.lower()) if not unicodedata.combining(x)]
        if len(parts) == 1 and parts[0] != c and c == c.lower():
            marked.append(c)
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


ACCENTS = _plain_letters()


def fold_accents(s: Column) -> Column:
    """Lower case without diacritics: composed letters by table, combining marks dropped."""
    return F.regexp_replace(F.translate(F.lower(s), *ACCENTS), r"\p{Mn}", "")


def token_index(rows: DataFrame, key: str, field: str) -> DataFrame:
    """(token, key, field, n): case and accents folded, split at everything but letters and digits."""
    tokens = rows.select(key, F.explode(F.split(fold_accents(F.col(field)), r"[^\p{L}\p{N}]+")).alias("token")).where("token <> ''")
    return tokens.groupBy("token", key).agg(F.count("*").alias("n")).withColumn("field", F.lit(field))


def index_after(index: DataFrame, touched: DataFrame, rows: DataFrame, key: str, field: str) -> DataFrame:
    """The index after inserts, updates and deletes: entries of touched keys go, those of `rows` come in.

    touched: the keys that were inserted, updated or deleted. rows: their present rows, none for deleted ones.
    """
    kept = index.join(touched.select(key).distinct(), key, "left_anti").select(*index.columns)
    return kept.unionByName(token_index(rows, key, field).select(*index.columns))


def largest(rows: DataFrame, size: str, k: int, *ties: str) -> DataFrame:
    """Spot check: the k rows of greatest size, ties in the order of the given columns."""
    return rows.orderBy(F.desc(size), *ties).limit(k)


def progress(rows: DataFrame, name: str, conditions: dict[str, Column] | None = None) -> tuple[DataFrame, Observation]:
    """`rows`, and counts that fill in as they are processed: all of them, and those that meet each condition.

    Wherever `rows` are written in full, `observation.get` then has the counts; nothing is read twice.
    """
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in (conditions or {}).items()]), seen


def token_search(index: DataFrame, tokens: list[str], key: str) -> DataFrame:
    """Keys that hold every token."""
    wanted = index.where(F.col("token").isin(tokens))
    return wanted.groupBy(key).agg(F.countDistinct("token").alias("hits"), F.sum("n").alias("n")).where(F.col("hits") == len(set(tokens)))
