"""Corpus pipeline: language ID, exact dedup, near dedup, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`docs`. Rows that a stage drops are gone for all later stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemforge.llm import langid
from stemforge.llm.common import BROADCAST_ROWS, cut, ship, table
from stemforge.llm.exact_dedup import exact_dedup
from stemforge.llm.jaccard import near_components
from stemforge.llm.packing import pack
from stemforge.llm.queries import TOKENIZER
from stemforge.llm.substrings import clean_texts


def _without(docs: DataFrame, dropped: DataFrame, text_key) -> DataFrame:
    """`docs` without the rows of `dropped` (id, text_key). The list is broadcast only if it is short."""
    gone = cut(dropped.select(F.col("doc_id").alias("__gone_id"), F.col("__text_key").alias("__gone_key")).distinct())
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__gone_id")) & (text_key == F.col("__gone_key"))
    return docs.join(gone, same, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go; which language the classifier tells never drops a document.

    A null text has no letter and goes; null ids and columns stay as they are; rows that repeat share their
    fate; an empty table stays empty; columns besides text, lang and doc_id are carried through.
    """
    ship(spark)
    return langid.determined(docs, langid.fit(docs, ~langid.held_out(F.col("doc_id"))))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the largest doc_id stays, and one row of rows repeated with id and text.

    Null texts are equal to empty ones. A null doc_id stays only where no row of the text has one. An empty
    table stays empty; other columns are carried through, those of the row that stays.
    """
    ship(spark)
    found = cut(exact_dedup(docs, keep="largest").select("doc_id", "kept", F.col("text_sha256").alias("__text_key")))
    key = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    twice = cut(found.where("kept").groupBy("doc_id", "__text_key").count().where("count > 1"))
    once = _without(docs, found.where("not kept"), key)
    if twice.isEmpty():
        return once
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__twice_id")) & (key == F.col("__twice_key"))
    repeated = docs.join(twice.select(F.col("doc_id").alias("__twice_id"), F.col("__text_key").alias("__twice_key")), same, "left_semi")
    return _without(once, twice, key).unionByName(repeated.dropDuplicates(["doc_id", "text"]))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest doc_id stays, nulls last, then of the least text hash.

    Rows alike in id and text, of which the stage before leaves one, share their fate. Texts without words,
    null ones too, have no near duplicates and stay. An empty table stays empty; other columns are carried through.
    """
    ship(spark)
    found = cut(near_components(docs).where("group is not null").select("group", "doc_id", F.col("text_hash").alias("__text_key")))
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "__text_key")
    first = found.groupBy("group").agg(F.min(place).alias("first"))
    return _without(docs, found.join(first, "group").where(place != F.col("first")), F.xxhash64(docs["text"]))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 200 bytes that stand more than once are taken out of the texts; no row goes.

    All places of a string go, so none is preferred. n_chars is counted anew; a null text stays null; rows
    that repeat repeat each other's strings. An empty table stays empty; other columns are carried through.
    """
    ship(spark)
    return clean_texts(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty, so its piece is the end id alone; null ids and repeated rows are packed as they are;
    pieces of equal length take places in any order; an empty table gives none; other columns are not read.
    """
    ship(spark)
    return pack(docs, TOKENIZER)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("passage_dedup", passages), ("packing", packing)]

#: Language identification cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
