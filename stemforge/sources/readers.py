"""Readers of dictionary files. `ord` numbers rows in reading order wherever later rules depend on it."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.vocab import LEVELS


def text_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Lines with the file's name and their place in reading order: files by name, lines as they stand.

    Line numbers are local to a split; (file, part, line) sorts them, so no row number is drawn over all.
    """
    rows = spark.read.text(paths).select(F.col("value"), F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return rows.withColumn("ord", F.struct("file", "block", "line"))


def read_records(spark: SparkSession, paths: list[str] | str, limit: int | None = None) -> DataFrame:
    """Dictionary records, one JSON object a line; blank lines are skipped, malformed ones dropped.

    `limit` counts lines that are not blank, malformed ones included.
    """
    lines = text_lines(spark, paths).where(F.trim("value") != "")
    if limit is not None:
        lines = lines.orderBy("ord").limit(limit)
    bad = F.col("r._bad")
    parsed = lines.select("ord", F.from_json("value", schemas.RECORD + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where(F.col("r").isNotNull() & bad.isNull()).select("ord", "r.*").drop("_bad")


def read_templates(spark: SparkSession, paths: list[str]) -> DataFrame:
    """word, etymology_templates of the first record of each word; `paths` in order of precedence."""
    parts = []
    for i, p in enumerate(paths):
        rows = spark.read.schema(f"word string, etymology_templates {schemas.TEMPLATES}").option("mode", "FAILFAST").json(p)
        parts.append(rows.withColumn("ord", F.struct(F.lit(i).alias("file"), F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.where(F.col("word") != "").groupBy("word").agg(F.min_by("etymology_templates", "ord").alias("etymology_templates"))


def read_pairs(spark: SparkSession, path: str, value: str, keep: Column | None = None) -> DataFrame:
    """word and a value from tab-separated lines of two columns or more, both given."""
    cols = F.split("value", "\t")
    rows = text_lines(spark, path).where(F.size(cols) >= 2).select("ord", F.trim(cols[0]).alias("word"), F.trim(cols[1]).alias(value))
    return rows.where((F.col("word") != "") & (F.col(value) != ""))


def read_ipa(spark: SparkSession, path: str) -> DataFrame:
    return read_pairs(spark, path, "ipa")


def read_levels(spark: SparkSession, path: str) -> DataFrame:
    return read_pairs(spark, path, "level").withColumn("level", F.upper("level")).where(F.col("level").isin(LEVELS))


def read_vectors(spark: SparkSession, path: str, limit: int | None = 200_000) -> DataFrame:
    """word, vector from the text form of word vectors: a header line, then a word and its numbers."""
    lines = text_lines(spark, path)
    cols = F.split(F.rtrim("value"), " ")
    rows = lines.where(F.size(cols) > 2).select("ord", cols[0].alias("word"), F.transform(F.slice(cols, F.lit(2), F.size(cols) - 1), lambda x: x.cast("float")).alias("vector"))
    return rows if limit is None else rows.orderBy("ord").limit(limit)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ENTRIES).parquet(path)


def read_document(spark: SparkSession, path: str, cluster: str) -> DataFrame:
    """Clusters of an export that `export_document` has written: ord and the fields of `cluster`, a struct type."""
    rows = spark.read.schema(f"ord long, cluster {cluster}").json(path)
    return rows.where("ord is not null").select("ord", "cluster.*")


def read_head(spark: SparkSession, path: str, stats: str, layout: str = "struct<algorithm:string>") -> DataFrame:
    """The head of such an export: version, stats and layout (null without one)."""
    return spark.read.schema(f"version int, stats {stats}, layout {layout}").json(path).where("version is not null")


def read_whole_document(spark: SparkSession, path: str, cluster: str) -> DataFrame:
    """Clusters of a document that is one JSON object, with their place in it."""
    doc = spark.read.schema(f"version int, clusters array<{cluster}>").option("multiLine", True).json(path)
    return doc.select(F.posexplode("clusters").alias("ord", "c")).select(F.col("ord").cast("long").alias("ord"), "c.*")


def read_responses(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Service responses that another process has landed as JSON lines."""
    return spark.read.schema(schema).json(path)


def stardict_rows(index: bytes, articles: bytes) -> Iterator[tuple[int, str, str]]:
    """(ord, word, article) of an index of zero-ended words, each with a big-endian offset and length."""
    pos = n = 0
    while pos < len(index):
        end = index.index(b"\0", pos)
        offset, size = struct.unpack_from(">II", index, end + 1)
        yield n, index[pos:end].decode("utf-8", "replace"), articles[offset : offset + size].decode("utf-8", "replace")
        pos, n = end + 9, n + 1


def read_stardict(spark: SparkSession, index_path: str, dict_path: str) -> DataFrame:
    """ord, word, html of a dictionary pair (gzip). The format is one binary stream, so one task reads a pair."""
    pair = spark.read.format("binaryFile").load(index_path).select(F.col("content").alias("idx")).crossJoin(spark.read.format("binaryFile").load(dict_path).select(F.col("content").alias("dict")))  # one row each

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for idx, articles in zip(b["idx"], b["dict"], strict=True):
                yield pd.DataFrame(list(stardict_rows(gzip.decompress(idx), gzip.decompress(articles))), columns=["ord", "word", "html"])

    return pair.mapInPandas(rows, "ord long, word string, html string")


def first_by_word(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy("word").agg(F.min_by(value, "ord").alias(value))


def last_by_word(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy("word").agg(F.max_by(value, "ord").alias(value))

