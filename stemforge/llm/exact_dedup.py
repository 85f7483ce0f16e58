"""Exact dedup by a log-structured merge index of text digests.

Every input task fills memtables and flushes each as a run sorted by digest, one row a digest, so a
group of copies of any size leaves a task as one row a run. Runs are dealt out by digest. Each index
shard sorts what comes in, looks it up in the runs it has by their Bloom filters, settles what is there
already, keeps the rest as a run with a filter of its own, and compacts runs of like size when there are many: the
smallest identifier of a digest stays and its counts add up. Digests that have copies are hits, and the texts of hits are
compared byte for byte with the text that stays; texts that differ are grouped by the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_parts, trimmed

MEMTABLE_ROWS = 65_536
#: Runs of like size in a shard that are merged into one.
FANOUT = 8
#: Rows of runs a shard takes at most, on average; more rows make more shards than the session's shuffle partitions.
SHARD_DIGESTS = 4_000_000
#: Digests of hits that may be broadcast; more are shuffled.
BROADCAST_DIGESTS = 200_000
#: Copies of one text compared in one task.
SALT_ROWS = 512


class Bloom:
    """Bloom filter over 8-byte digest heads, 10 bits a key, 4 probes."""

    def __init__(self, heads: np.ndarray):
        self.bits = max(64, 1 << int(len(heads) * 10 - 1).bit_length()) if len(heads) else 64
        self.words = np.zeros(self.bits // 8, np.uint8)
        for p in self._probes(heads):
            np.bitwise_or.at(self.words, p >> 3, (1 << (p & 7)).astype(np.uint8))

    def _probes(self, heads: np.ndarray) -> Iterator[np.ndarray]:
        a, b = heads >> np.uint64(32), heads | np.uint64(1)
        for i in range(4):
            yield ((a + np.uint64(i) * b) & np.uint64(self.bits - 1)).astype(np.int64)

    def may_have(self, heads: np.ndarray) -> np.ndarray:
        out = np.ones(len(heads), bool)
        for p in self._probes(heads):
            out &= (self.words[p >> 3] >> (p & 7)) & 1 == 1
        return out


class Run:
    """Sorted digests with the smallest identifier and the count of each, and a filter."""

    def __init__(self, digests: np.ndarray, idents: np.ndarray, counts: np.ndarray):
        self.digests, self.idents, self.counts = digests, np.array(idents), np.array(counts)
        self.filter = Bloom(heads(digests))

    def find(self, digests: np.ndarray) -> np.ndarray:
        """Position of each digest in this run, or -1; the filter is asked first."""
        out = np.full(len(digests), -1, np.int64)
        maybe = np.flatnonzero(self.filter.may_have(heads(digests)))
        if len(maybe) and len(self.digests):
            at = np.minimum(np.searchsorted(self.digests, digests[maybe]), len(self.digests) - 1)
            ok = self.digests[at] == digests[maybe]
            out[maybe[ok]] = at[ok]
        return out


def heads(digests: np.ndarray) -> np.ndarray:
    """First 8 digest bytes as numbers."""
    raw = np.zeros((len(digests), 8), np.uint8)
    if len(digests):
        width = digests.dtype.itemsize
        raw[:, : min(8, width)] = np.frombuffer(digests.tobytes(), np.uint8).reshape(len(digests), width)[:, :8]
    return raw.view(np.uint64).ravel()


def merge(runs: list[Run]) -> Run:
    """Compaction: one entry a digest, with the smallest identifier and the sum of counts."""
    d, i, n = (np.concatenate([getattr(r, x) for r in runs]) for x in ("digests", "idents", "counts"))
    order = np.lexsort((i, d))
    d, i, n = d[order], i[order], n[order]
    first = np.flatnonzero(np.append(True, d[1:] != d[:-1])) if len(d) else np.zeros(0, np.int64)
    return Run(d[first], i[first], np.add.reduceat(n, first) if len(first) else n)


class LsmIndex:
    """Runs that share no digest. A new run is first looked up in the others, whose filters are asked: what they
    have is settled there, what is left of the run is kept beside them. `fanout` runs of like size (within a
    factor of `fanout`) are merged into one, so that a digest is merged once a level."""

    def __init__(self, fanout: int = FANOUT):
        self.runs: list[Run] = []
        self.fanout = fanout

    def add(self, run: Run) -> None:
        for old in self.runs:
            at = old.find(run.digests)
            hit = at >= 0
            if hit.any():
                old.idents[at[hit]] = np.minimum(old.idents[at[hit]], run.idents[hit])
                old.counts[at[hit]] += run.counts[hit]
                run = Run(run.digests[~hit], run.idents[~hit], run.counts[~hit])
        while len(run.digests):
            level = self._level(run)
            same = [r for r in self.runs if self._level(r) == level]
            if len(same) + 1 < self.fanout:
                self.runs.append(run)
                break
            self.runs = [r for r in self.runs if self._level(r) != level]
            run = merge([*same, run])

    def _level(self, run: Run) -> int:
        return len(run.digests).bit_length() // max(1, self.fanout.bit_length() - 1)

    def lookup(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(smallest identifier, count) of each digest over all runs; count 0 if absent."""
        ident, count = np.full(len(digests), np.iinfo(np.int64).max), np.zeros(len(digests), np.int64)
        for r in self.runs:
            at = r.find(digests)
            hit = np.flatnonzero(at >= 0)
            ident[hit] = np.minimum(ident[hit], r.idents[at[hit]])
            count[hit] += r.counts[at[hit]]
        return ident, count

    def compact(self) -> Run:
        self.runs = [merge(self.runs)] if self.runs else [Run(np.zeros(0, "S32"), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        return self.runs[0]


SCHEMA = "digest binary, ident long, n long"
_NO_ID = np.iinfo(np.int64).max


def _rows(run: Run, width: int) -> pa.RecordBatch:
    raw = run.digests.astype(f"S{width}").tobytes()
    digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(run.digests), [None, pa.py_buffer(raw)]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([digests, pa.array(run.idents, pa.int64()), pa.array(run.counts, pa.int64())], ["digest", "ident", "n"])


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, int]:
    got = b.column(0).to_pylist()
    width = len(got[0]) if got else 32
    # numpy strips trailing zero bytes of S items alike in all of them, so equality and order hold
    return np.array(got, dtype=f"S{width}"), width


def flush_runs(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Memtable of one task: digest -> smallest identifier and count, flushed sorted when full."""
    table: dict[bytes, list[int]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        if table:
            keys = sorted(table)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([table[k][0] for k in keys], pa.int64()), pa.array([table[k][1] for k in keys], pa.int64())], ["digest", "ident", "n"])
            table.clear()

    for b in rows:
        for d, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            i = _NO_ID if i is None else i
            got = table.get(d)
            if got is None:
                table[d] = [i, 1]
                if len(table) >= MEMTABLE_ROWS:
                    yield from flush()
            else:
                got[0] = min(got[0], i)
                got[1] += 1
    yield from flush()


def compact_shard(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard: takes runs in, merges them as they come, and gives the compacted run."""
    index, width = LsmIndex(), 32
    for b in rows:
        if len(b):
            d, width = _arrays(b)
            order = np.argsort(d, kind="stable")
            index.add(merge([Run(d[order], b.column(1).to_numpy()[order], b.column(2).to_numpy()[order])]))
    run = index.compact()
    for a in range(0, len(run.digests), MEMTABLE_ROWS):
        s = slice(a, a + MEMTABLE_ROWS)
        part = Run.__new__(Run)
        part.digests, part.idents, part.counts = run.digests[s], run.idents[s], run.counts[s]
        yield _rows(part, width)


def build_index(keys: DataFrame) -> DataFrame:
    """keys: digest binary, ident long. One row a digest: digest, smallest ident, n."""
    runs = keys.select("digest", "ident").mapInArrow(trimmed(flush_runs), SCHEMA)
    shards = max(shuffle_parts(keys.sparkSession), -(-keys.count() // SHARD_DIGESTS))
    return runs.repartition(shards, "digest").mapInArrow(trimmed(compact_shard), SCHEMA)


def sha256_bytes(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_dedup(docs: DataFrame, keep: str = "largest", digest: Callable[[Column], Column] = sha256_bytes, broadcast: int = BROADCAST_DIGESTS, hot_rows: int = 1000, salt_rows: int = SALT_ROWS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after no change; a null text counts as empty. Of equal texts the row
    of the largest (or `keep="smallest"`) doc_id stays: the index keeps the smallest identifier, and for
    "largest" an identifier is the bitwise complement of doc_id. A null doc_id never wins against another;
    a group of null ids only has keep_id null. A row is kept when its doc_id is keep_id, so rows that
    repeat the same id and text are all marked alike. Empty tables give an empty result; other columns
    are ignored. `digest` may be any deterministic function of the text, of any width (one other than the
    default is hashed to 32 bytes); a weak one costs time, not truth.
    Up to `broadcast` digests of hits are sent to the tasks; more are joined, those of over `hot_rows` rows
    (or a thousandth of all) apart from the others, and `salt_rows` copies of one text are compared in a task.
    """
    largest = {"largest": True, "smallest": False}[keep]
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", digest(F.col("text")) if digest is sha256_bytes else F.unhex(F.sha2(F.coalesce(digest(F.col("text")).cast("binary"), F.lit(b"")), 256)))
    ident = F.expr("~doc_id") if largest else F.col("doc_id")
    narrow = cut(rows.select("doc_id", "digest", F.unhex(F.sha2("text", 256)).alias("sha"), ident.alias("ident")))
    index = cut(build_index(narrow).select("digest", F.when(F.col("ident") != _NO_ID, F.expr("~ident") if largest else F.col("ident")).alias("keep_id"), F.col("n").alias("group_size")))
    extreme = -1 << 63 if largest else _NO_ID  # the one doc_id whose identifier is also that of a missing one
    edge = narrow.where(F.col("doc_id") == extreme).select("digest").distinct()
    if not edge.isEmpty():
        index = cut(index.join(edge.withColumn("edge", F.lit(extreme)), "digest", "left").select("digest", F.coalesce("keep_id", "edge").alias("keep_id"), "group_size"))
    copies = index.where("group_size > 1")
    total, n_copies = narrow.count(), copies.count()

    # A digest with over a thousandth of all rows is one of a thousand at most: those are broadcast.
    limit = max(hot_rows, total // 1000)
    hot, cold = F.broadcast(copies.where(F.col("group_size") > limit)), F.col("group_size") <= limit

    def with_groups(left: DataFrame, groups: DataFrame) -> DataFrame:
        """`left` joined with the groups of its digests, the hot ones apart."""
        return left.join(hot, "digest").unionByName(left.join(hot.select("digest"), "digest", "left_anti").join(groups.where(cold), "digest"))

    out = with_groups(narrow.drop("ident"), index)
    hits = rows.join(F.broadcast(copies), "digest") if n_copies <= broadcast else with_groups(rows, copies)
    hits = hits.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("group_size") / salt_rows)))
    stays = hits.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.first("text").alias("kept_text"), F.first("group_size").alias("size"))
    stays = stays.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / salt_rows) - 1))).drop("size")
    differ = cut(hits.join(stays, ["digest", "salt"]).where(F.col("text") != F.col("kept_text")).select("digest").distinct())
    if not differ.isEmpty():  # one digest of several texts
        mixed = rows.join(differ, "digest")
        best = (F.max if largest else F.min)("doc_id").alias("keep_id")
        groups = mixed.groupBy("digest", "text").agg(best, F.count("*").alias("group_size"))
        again = mixed.join(groups, ["digest", "text"]).select("digest", "doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size")
        out = out.join(differ, "digest", "left_anti").unionByName(again)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
