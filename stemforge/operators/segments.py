"""A token index kept by sorted segments, and a lexicon in sorted blocks: reads and upkeep in proportion to what they touch."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_fold_case
from .search import token_index


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class SegmentIndex:
    """An inverted index in a folder. Each batch of changes is a segment of its own: postings sorted by token, and a
    tombstone for every key that was touched, which hides the key's postings of earlier segments.

    Readers take the segments together and drop what a later tombstone hides. When `fanout` segments of one
    level stand last, they are merged into one of the next level, without what is hidden by then; a posting is
    so written again once a level. Which segments count is told by the newest whole manifest, a line of JSON, so
    a batch or merge that breaks off changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, key_type: str = "long", fanout: int = 8):
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        self.posting, self.tombstone = f"token string, key {key_type}, n long, seq long", f"key {key_type}, seq long"
        self.rows_written = 0

    def segments(self) -> list[dict]:
        """What the newest manifest names: seq (the last batch in it), level, name, rows; oldest first. A few a level."""
        path, fs = _fs(self.spark, self.path)
        if not fs.exists(path):
            return []
        whole = [s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("manifest-") and fs.exists(_fs(self.spark, f"{s.getPath()}/_SUCCESS")[0])]
        return json.loads(self.spark.read.text(f"{self.path}/{max(whole)}").first()["value"]) if whole else []

    def _write(self, name: str, postings: DataFrame, tombstones: DataFrame) -> int:
        postings.repartitionByRange("token").sortWithinPartitions("token", "key").write.mode("overwrite").parquet(f"{self.path}/{name}/postings")
        tombstones.write.mode("overwrite").parquet(f"{self.path}/{name}/tombstones")
        rows = self._read([name], "postings").count() + self._read([name], "tombstones").count()
        self.rows_written += rows
        return rows

    def _publish(self, seq: int, found: list[dict], step: int) -> None:
        row = self.spark.createDataFrame([(json.dumps(found),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest-{seq:012d}-{step:04d}")

    def _read(self, names: list[str], kind: str) -> DataFrame:
        schema = self.posting if kind == "postings" else self.tombstone
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}/{kind}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def apply(self, touched: DataFrame, rows: DataFrame, key: str, field: str) -> None:
        """Take in a batch. touched: the keys inserted, updated or deleted; rows: their present rows, none for deleted ones."""
        found = self.segments()
        seq = found[-1]["seq"] + 1 if found else 0
        postings = token_index(rows, key, field).select("token", F.col(key).alias("key"), "n", F.lit(seq).cast("long").alias("seq"))
        gone = touched.select(F.col(key).alias("key")).distinct().withColumn("seq", F.lit(seq).cast("long"))
        name = f"segment-{seq:012d}-0"
        found.append({"seq": seq, "level": 0, "name": name, "rows": self._write(name, postings, gone)})
        self._publish(seq, found, 0)
        step = 0
        while len(found) >= self.fanout and len({s["level"] for s in found[-self.fanout :]}) == 1:
            last, found = found[-self.fanout :], found[: -self.fanout]
            level, names, step = last[0]["level"] + 1, [s["name"] for s in last], step + 1
            hidden = self._read(names, "tombstones").groupBy("key").agg(F.max("seq").alias("seq"))
            # nothing is left for a tombstone to hide before the first segment
            name, kept = f"segment-{seq:012d}-{level}", hidden if found else hidden.limit(0)
            found.append({"seq": seq, "level": level, "name": name, "rows": self._write(name, _alive(self._read(names, "postings"), hidden), kept)})
            self._publish(seq, found, step)

    def vacuum(self) -> None:
        """Delete segments and manifests that the newest manifest does not need; no reader may be under way on them."""
        keep = {s["name"] for s in self.segments()}
        path, fs = _fs(self.spark, self.path)
        names = sorted(s.getPath().getName() for s in fs.listStatus(path))
        newest = max(n for n in names if n.startswith("manifest-"))
        for n in names:
            if n not in keep and n != newest:
                fs.delete(_fs(self.spark, f"{self.path}/{n}")[0], True)

    def postings(self, wanted: Column | None = None) -> DataFrame:
        """(token, key, n) that no later tombstone hides; `wanted` is a condition on tokens, pushed to the sorted files."""
        names = [s["name"] for s in self.segments()]
        rows = self._read(names, "postings")
        hidden = self._read(names, "tombstones")
        if wanted is not None:
            rows = rows.where(wanted)
            hidden = hidden.join(rows.select("key").distinct(), "key", "left_semi")
        return _alive(rows, hidden.groupBy("key").agg(F.max("seq").alias("seq"))).select("token", "key", "n")

    def search(self, tokens: list[str]) -> DataFrame:
        """(key, n): keys that hold every token."""
        got = self.postings(F.col("token").isin(tokens)).groupBy("key").agg(F.countDistinct("token").alias("hits"), F.sum("n").alias("n"))
        return got.where(F.col("hits") == len(set(tokens))).select("key", "n")


def _alive(rows: DataFrame, hidden: DataFrame) -> DataFrame:
    return rows.join(hidden.select("key", F.col("seq").alias("gone")), "key", "left").where("gone is null or gone <= seq").select(*rows.columns)


def write_blocks(rows: DataFrame, path: str, column: str = "lemma", per_block: int = 100_000) -> None:
    """A lexicon sorted by its folded column in blocks of about `per_block` rows, with a directory of their first and last keys."""
    spark = rows.sparkSession
    folded = rows.withColumn("folded", ascii_fold_case(F.col(column)))
    blocks = max(1, -(-folded.count() // per_block))
    folded.repartitionByRange(blocks, "folded").sortWithinPartitions("folded").write.mode("overwrite").parquet(f"{path}/blocks")
    named = spark.read.parquet(f"{path}/blocks").groupBy(F.input_file_name().alias("file"))
    named.agg(F.min("folded").alias("first"), F.max("folded").alias("last"), F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{path}/directory")


def read_blocks(spark: SparkSession, path: str, q: str) -> DataFrame:
    """The rows that a prefix search for q may hit: only the blocks of its range are read.

    The range is that of q's letters before its first wildcard. The directory has a row a block, and the
    driver gets those of the range.
    """
    prefix = ascii_fold_case(F.lit(re.split(r"[%_\\]", q, maxsplit=1)[0]))
    found = spark.read.parquet(f"{path}/directory").where((F.col("last") >= prefix) & ((F.col("first") <= prefix) | F.col("first").startswith(prefix))).select("file").collect()
    whole = spark.read.parquet(f"{path}/blocks")
    rows = spark.read.schema(whole.schema).parquet(*[r["file"] for r in found]) if found else whole.limit(0)
    return rows.where(F.col("folded").startswith(prefix)).drop("folded")
