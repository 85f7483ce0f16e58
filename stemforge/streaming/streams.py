"""Structured Streaming forms of the sync cursor and of the expiring cache."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def change_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """Append log of changed rows; the engine's checkpoint is the cursor, so ties are never lost."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def sync_to(changes: DataFrame, path: str, checkpoint: str):
    return changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))


ACCESS = "key string, ts timestamp, hit boolean"


def cache_hits(accesses: DataFrame, ttl_seconds: int, late: str = "10 minutes") -> DataFrame:
    """Streamed hits and misses of a cache whose entries live for a time after they were last stored.

    accesses: key string, ts timestamp. A miss stores the entry; a hit leaves its expiry as it is. When the
    watermark, `late` behind the newest access, passes an entry's expiry, its state is removed.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stored = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values("ts", kind="stable")
        hits = []
        for ts in rows["ts"]:
            now = ts.timestamp()
            hit = stored is not None and now <= stored + ttl_seconds
            stored = stored if hit else now
            hits.append(hit)
        state.update((stored,))
        state.setTimeoutTimestamp(max(int((stored + ttl_seconds) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"].to_numpy(), "hit": hits})

    marked = accesses.withWatermark("ts", late)
    return marked.groupBy("key").applyInPandasWithState(step, ACCESS, "stored double", "append", GroupStateTimeout.EventTimeTimeout)


LRU = "batch long, key string, last_used timestamp"


def evict_stream(accesses: DataFrame, capacity: int, path: str, checkpoint: str):
    """A least-recently-used cache beside a stream: after every batch `path` holds the `capacity` keys used last.

    accesses: key string, ts timestamp. A batch folds its accesses to one row a key, joins them with the keys
    that were held, keeps the newest and writes them under its own number; a batch that runs again writes
    the same. `held_keys` reads the newest one.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("key").agg(F.max("ts").alias("last_used"))
        try:
            old = held_keys(spark, path, number)
        except AnalysisException:  # no batch before this one
            old = new.limit(0)
        last = old.unionByName(new).groupBy("key").agg(F.max("last_used").alias("last_used"))
        kept = last.orderBy(F.desc("last_used"), "key").limit(capacity)
        kept.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return accesses.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def held_keys(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """(key, last_used) of the newest batch of `evict_stream`, or of the newest one before a number."""
    rows = spark.read.schema(LRU).parquet(path)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    newest = rows.agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(newest), "batch").select("key", "last_used")  # one row


def touch_hits(accesses: DataFrame, ttl_seconds: int, key: str, ts: str, order: str) -> DataFrame:
    """Batch form in which every access stores the entry anew: a hit is an access soon enough after the last."""
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(ts, order))
    return accesses.withColumn("hit", F.coalesce(F.unix_timestamp(ts) - F.unix_timestamp(before) <= ttl_seconds, F.lit(False)))


def evicted(accesses: DataFrame, capacity: int, key: str, ts: str) -> DataFrame:
    """Keys that a least-recently-used cache of `capacity` has dropped: all but those used last."""
    last = accesses.groupBy(key).agg(F.max(ts).alias("last_used"))
    kept = last.orderBy(F.desc("last_used"), key).limit(capacity)
    return last.join(kept.select(key), key, "left_anti")
