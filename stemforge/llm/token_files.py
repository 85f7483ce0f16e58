"""Token-id files: blocks of ids coded by an adaptive context-mixing range coder.

Three predictors look at an id. Orders 2 and 1 each name the id last seen after the same two ids or one,
with a confidence; order 0 knows how often each group of 16 ids has come in the block. The id that order 2
(or, where it has none, order 1) names holds or not: a binary event whose probability is a logistic mix of
order 2's and order 1's adaptive counters and of order 0's odds for that very id, with weights chosen by
confidence and trained as coding goes on. An id that was not named is coded by order 0's distribution,
which is renewed from the counts at growing distances; ids within a group are told apart by 4 flat bits.
Every block begins with fresh models and holds a header, a document table and a checksum, so blocks can
be read alone. All arithmetic is on integers; blocks are coded side by side in numpy, one lane each.

Block layout, little-endian: "SFT2", uint32 documents, uint32 ids, uint32 crc32 of the document table and
the ids; for each document uint8 id is null, int64 doc_id, uint32 ids here, uint64 ids in earlier blocks,
uint32 crc32 of those, uint8 document ends here; then the coded words of 32 bits. Blocks are rows of a
Parquet table (columns part, block, first, n_ids, data), so any store that Spark writes to can hold them.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import encoded_groups
from .common import shared_folder, shuffle_parts, trimmed

END_ID = 2
BLOCK_IDS = 2048
#: Blocks coded side by side.
LANES = 4096
MAGIC = b"SFT2"
DOC = np.dtype([("null", "u1"), ("doc_id", "<i8"), ("n", "<u4"), ("before", "<u8"), ("crc", "<u4"), ("ends", "u1")])

_U = np.uint64
_O1, _O2 = 1 << 10, 1 << 11
_RATE = 4
_SQUASH = np.array([min(4095, max(1, round(4096 / (1 + np.exp(-x / 256))))) for x in range(-2047, 2048)], np.int32)
_STRETCH = np.array([max(-2047, min(2047, round(256 * np.log((p + 0.5) / (4095.5 - p))))) for p in range(4096)], np.int32)
#: Order 0 counts groups of 16 ids; its odds add up to 2**16. A count weighs as much as 8 groups not yet seen.
_GROUPS, _ODDS, _SEEN = 1 << 12, 16, 8
_FLAG_BITS, _ID_BITS = 12, _ODDS + 4
_LOW32 = _U(0xFFFFFFFF)
#: What becomes of a confidence, by (id held) * 4 + confidence; of a low one that did not hold, a new id's first.
_STEP = np.array([0, 0, -1, -1, 1, 1, 1, 0], np.int32)
_WIPE = np.array([True, True, False, False, False, False, False, False])
#: Lanes whose order-0 odds are renewed at once.
_RENEW = 32


def _renewals(n: int) -> list[int]:
    """After how many ids order 0's odds are renewed: twice as many each time, every 1024 in the end."""
    out, t = [], 32
    while t < n:
        out.append(t)
        t += min(t, 1024)
    return out


def _up_to(rows: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Place of the last entry in each sorted row of 16 that is at most the value."""
    found = (rows <= value).view(np.uint64)  # one byte a comparison
    total = found[:, 0] + found[:, 1]
    total *= _U(0x0101010101010101)
    total >>= _U(56)
    total -= _U(1)
    return total.view(np.int64)


class _Lanes:
    """Model state of blocks that are coded side by side. `n` are their ids, longest first.

    Arrays of two rows have order 1 first, then order 2; those of three add order 0. They are read by `take` and
    written by flat places, which numpy does several times as fast as by places in rows.
    """

    def __init__(self, n: np.ndarray):
        k = len(n)
        self.k = k
        lane = np.arange(k)
        self.lane, self.base = lane, lane * _GROUPS  # a lane's first group
        self.table = np.zeros(k * (_O1 + _O2), np.int32)  # id last seen << 2 | confidence
        self.begin = np.stack([lane * _O1, k * _O1 + lane * _O2])
        self.at = self.begin.copy()
        self.mixed = np.zeros(k, np.uint32)
        self.counters = np.full(k * 16, 1024, np.intp)  # 8 of each order
        self.slot = np.stack([lane * 16, lane * 16 + 8])
        self.weights = np.full(k * 12, 22000, np.int32)
        self.gates = lane * 4 + np.arange(3)[:, None] * (4 * k)
        self.counts = np.zeros(k * _GROUPS, np.uint16)
        #: Sum of the odds of the groups before each, modulo 2**16, and those of every 16th and every 256th group.
        self.sums = np.zeros(k * _GROUPS + 1, np.uint16)
        self.middle, self.coarse = np.zeros((k * 16, 16), np.uint16), np.zeros((k, 16), np.uint16)
        self.since: list[np.ndarray] = []
        self.due = _renewals(int(n[0]))[::-1]
        self.t = 0
        self.renew()

    def shrink(self, k: int) -> None:
        """Only the first k lanes go on."""
        self.k = k
        for name in ("lane", "base", "begin", "at", "mixed", "slot", "gates"):
            setattr(self, name, np.ascontiguousarray(getattr(self, name)[..., :k]))

    def renew(self) -> None:
        """Count the groups seen since and derive the odds of all groups anew: whole numbers, none under 1."""
        for at in self.since:
            np.add.at(self.counts, at, np.uint16(1))
        self.since = []
        unit = ((1 << _ODDS) - _GROUPS << 8) // (_SEEN * self.t + _GROUPS)
        each, first = np.uint16(_SEEN * unit >> 8), np.uint16((unit >> 8) + 1)
        for a in range(0, self.k, _RENEW):
            z = min(a + _RENEW, self.k)
            odds = self.counts[a * _GROUPS : z * _GROUPS].reshape(z - a, _GROUPS) * each
            odds += first
            sums = self.sums[a * _GROUPS : z * _GROUPS].reshape(z - a, _GROUPS)
            np.add.accumulate(odds[:, :-1], axis=1, out=sums[:, 1:])
            self.middle[a * 16 : z * 16] = sums[:, ::16].reshape(-1, 16)
            self.coarse[a:z] = sums[:, ::256]

    def find(self, lane: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The group (of all lanes' groups) in whose odds each value falls: of 16 times 16 times 16, three rows are looked through."""
        value = value.astype(np.uint16)[:, None]
        at = lane
        for rows in (self.coarse, self.middle, self.sums[:-1].reshape(-1, 16)):
            at = at * 16 + _up_to(rows.take(at, axis=0), value)
        return at

    def predict(self) -> None:
        """The named id, and the chance (of 4096) that it holds."""
        self.e = self.table.take(self.at)
        self.c = c = (self.e & 3).astype(np.intp)  # places, like those below: `take` converts others
        self.named = self.e >> 2
        self.guess = np.where(c[1] > 0, self.named[1], self.named[0])
        self.slots = c + c
        self.slots += self.slot
        self.slots += self.guess == self.named[0]
        self.odds = self.counters.take(self.slots)
        group = (self.guess >> 4) + self.base
        odds = self.sums[1:].take(group)
        odds -= self.sums.take(group)
        odds >>= 4
        self.x = np.empty((3, self.k), np.int32)
        self.x[:2] = _STRETCH.take(self.odds)
        self.x[2] = _STRETCH.take(odds)
        self.gate = self.gates + c[1]
        self.w = self.weights.take(self.gate)
        dot = np.add.reduce(self.x * self.w, axis=0, dtype=np.int32)
        dot >>= 16
        dot += 2047
        self.p = _SQUASH.take(dot, mode="clip")

    def learn(self, hit: np.ndarray, ids: np.ndarray) -> None:
        err = hit * np.int32(4096)
        goal = err - hit
        err -= self.p
        self.x *= err
        self.x >>= 9
        self.w += self.x
        self.weights[self.gate.ravel()] = self.w.ravel()
        if self.t & 15 == 15:  # no product of a weight and an input overflows in between
            np.clip(self.weights, -(1 << 18), 1 << 18, out=self.weights)
        goal = goal - self.odds
        goal >>= _RATE
        self.odds += goal
        self.counters[self.slots.ravel()] = self.odds.ravel()
        seen = (self.named == ids) * np.int8(4) + self.c
        now = self.e + _STEP.take(seen)
        np.copyto(now, (ids << 2) | 1, where=_WIPE.take(seen))
        self.table[self.at.ravel()] = now.ravel()
        self.since.append(self.base + (ids >> 4))
        mixed = ids.view(np.uint32) * np.uint32(0x9E3779B1)
        np.add(self.begin[0], mixed >> np.uint32(22), out=self.at[0])
        np.add(self.begin[1], ((self.mixed ^ mixed) * np.uint32(0x85EBCA77)) >> np.uint32(21), out=self.at[1])
        self.mixed = (mixed >> np.uint32(13)) | (mixed << np.uint32(19))
        self.t += 1
        if self.due and self.t == self.due[-1]:
            self.due.pop()
            self.renew()


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Code each block of ids (each under 65536)."""
    order = np.argsort([-len(b) for b in blocks], kind="stable")
    n = np.array([len(blocks[i]) for i in order], np.int64)
    if not len(n) or not n[0]:
        return [b""] * len(blocks)
    ids = np.zeros((int(n[0]), len(n)), np.int32)
    for j, i in enumerate(order.tolist()):
        ids[: n[j], j] = blocks[i]
    s = _Lanes(n)
    width = int(n[0]) + 4
    words = np.zeros(len(n) * width, np.uint32)
    fill = np.arange(len(n)) * width  # the next word of each lane
    low, size = np.zeros(len(n), _U), np.full(len(n), (1 << 64) - 1, _U)

    def carry(at: np.ndarray) -> None:
        """Add one to what the lanes have given out."""
        at = fill[at] - 1
        while len(at):
            words[at] += np.uint32(1)
            at = at[words[at] == 0] - 1

    live = np.searchsorted(-n, -np.arange(int(n[0])), "left")  # lanes with more than t ids
    for t in range(int(n[0])):
        k = int(live[t])
        if k < s.k:
            s.shrink(k)
        now = ids[t, :k]
        s.predict()
        hit = s.guess == now
        lo, sz = low[:k], size[:k]
        chance = (sz >> _U(_FLAG_BITS)) * s.p.astype(_U)
        miss = np.flatnonzero(~hit)
        up = lo[miss]
        part = chance[miss]
        rest = sz[miss] - part
        np.copyto(sz, chance)
        if len(miss):
            x = now[miss]
            group = (x >> 4) + s.base[miss]
            begin = s.sums[group]
            odds = (s.sums[group + 1] - begin).astype(np.int32)
            begin = (begin.astype(np.int32) << 4) + (x & 15) * odds
            unit = rest >> _U(_ID_BITS)
            sum_ = up + part
            over = sum_ < up
            up = sum_ + unit * begin.astype(_U)
            over |= up < sum_
            lo[miss] = up
            sz[miss] = unit * odds.astype(_U)
            if over.any():
                carry(miss[over])
        s.learn(hit, now)
        out = np.flatnonzero(sz <= _LOW32)
        if len(out):
            x = lo[out]
            words[fill[out]] = x >> _U(32)
            fill[out] += 1
            lo[out] = x << _U(32)
            sz[out] <<= _U(32)
    words[fill], words[fill + 1] = low >> _U(32), low & _LOW32
    coded: list[bytes] = [b""] * len(blocks)
    for j, i in enumerate(order.tolist()):
        coded[i] = words[j * width : fill[j] + 2].astype("<u4").tobytes() if n[j] else b""
    return coded


def decode_blocks(coded: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    order = np.argsort([-x for x in sizes], kind="stable")
    n = np.array([sizes[i] for i in order], np.int64)
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(coded)
    if not len(n) or not n[0]:
        return out
    ids = np.zeros((int(n[0]), len(n)), np.int32)
    width = max(map(len, coded)) // 4 + 4
    words = np.zeros((len(n), width), _U)
    for j, i in enumerate(order.tolist()):
        own = np.frombuffer(coded[i], "<u4")
        words[j, : len(own)] = own
    s = _Lanes(n)
    code, size = (words[:, 0] << _U(32)) | words[:, 1], np.full(len(n), (1 << 64) - 1, _U)
    fill, last = np.arange(len(n)) * width + 2, np.arange(1, len(n) + 1) * width - 1
    words = words.ravel()
    live = np.searchsorted(-n, -np.arange(int(n[0])), "left")
    for t in range(int(n[0])):
        k = int(live[t])
        if k < s.k:
            s.shrink(k)
        s.predict()
        at, sz = code[:k], size[:k]
        chance = (sz >> _U(_FLAG_BITS)) * s.p.astype(_U)
        hit = at < chance
        now = s.guess.copy()
        miss = np.flatnonzero(~hit)
        part = chance[miss]
        rest = sz[miss] - part
        np.copyto(sz, chance)
        if len(miss):
            left = at[miss] - part
            unit = rest >> _U(_ID_BITS)
            value = np.minimum(left // unit, _U((1 << _ID_BITS) - 1)).astype(np.int32)
            group = s.find(miss, value >> 4)
            begin = s.sums[group]
            odds = (s.sums[group + 1] - begin).astype(np.int32)
            begin = begin.astype(np.int32) << 4
            low4 = (value - begin) // odds
            now[miss] = ((group.astype(np.int32) & (_GROUPS - 1)) << 4) + low4
            at[miss] = left - unit * (begin + low4 * odds).astype(_U)
            sz[miss] = unit * odds.astype(_U)
        s.learn(hit, now)
        ids[t, :k] = now
        more = np.flatnonzero(sz <= _LOW32)
        if len(more):
            place = fill[more]
            at[more] = (at[more] << _U(32)) | words.take(np.minimum(place, last[more]))
            fill[more] = place + 1
            sz[more] <<= _U(32)
    for j, i in enumerate(order.tolist()):
        out[i] = ids[: n[j], j]
    return out


BLOCK_ROWS = "part int, block long, first long, n_ids long, data binary"


def blocks_of(docs: DataFrame, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of the ids of all whole texts (null: empty) with `end_id` after each, in order of doc_id."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        flat: list[np.ndarray] = []  # ids not yet in a block
        table: list[tuple] = []  # their documents: null, doc_id, n, before, crc, ends
        held, number, first = 0, 0, 0

        def cut(final: bool):
            nonlocal flat, table, held, number, first
            ids = np.concatenate(flat) if flat else np.zeros(0, np.int32)
            full = len(ids) // block_ids if not final else -(-len(ids) // block_ids)
            groups, heads = [], []
            k = 0
            rows = [list(x) for x in table]
            pos = 0
            for b in range(full):
                own = ids[b * block_ids : (b + 1) * block_ids]
                docs_here = []
                room = len(own)
                while room and k < len(rows):
                    r = rows[k]
                    n = min(room, r[2])
                    ends = n == r[2]
                    docs_here.append((r[0], r[1], n, r[3], r[4], ends))
                    if ends:
                        k += 1
                    else:
                        r[4] = zlib.crc32(ids[pos : pos + n].astype("<u4").tobytes(), r[4])
                        r[3] += n
                        r[2] -= n
                    pos += n
                    room -= n
                groups.append(own)
                head = np.array(docs_here, DOC)
                listed = head.tobytes()
                heads.append(MAGIC + np.array([len(head), len(own), zlib.crc32(own.astype("<u4").tobytes(), zlib.crc32(listed))], "<u4").tobytes() + listed)
            for a in range(0, len(groups), LANES):
                coded = encode_blocks(groups[a : a + LANES])
                n = [len(g) for g in groups[a : a + LANES]]
                starts = first + np.cumsum([0, *n[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), pa.array(range(number, number + len(n)), pa.int64()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array([h + c for h, c in zip(heads[a : a + LANES], coded, strict=True)], pa.binary())], ["part", "block", "first", "n_ids", "data"])
                number += len(n)
                first += sum(n)
            flat, table = [ids[full * block_ids :]] if not final else [], [tuple(x) for x in rows[k:]]
            held = len(flat[0]) if flat else 0

        for b in batches:
            names = b.column(0).to_pylist()
            for a, z, ids, bound in encoded_groups(b, path):
                sizes = np.diff(bound)
                whole = np.full(len(ids) + (z - a), end_id, np.int32)
                keep = np.ones(len(whole), bool)
                keep[bound[1:] + np.arange(z - a)] = False
                whole[keep] = ids
                flat.append(whole)
                held += len(whole)
                table += [(x is None, x or 0, int(n) + 1, 0, 0, False) for x, n in zip(names[a:z], sizes.tolist(), strict=True)]
                if held >= LANES * block_ids:
                    yield from cut(False)
        yield from cut(True)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.repartitionByRange(shuffle_parts(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id").mapInArrow(trimmed(run), BLOCK_ROWS)


def read_blocks(blocks: DataFrame) -> DataFrame:
    """Decode blocks and check them: (part, doc_id, begin, n_tokens, ids_crc32), one row where a document ends."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, len(b), LANES):
                some = b.slice(a, LANES)
                heads, coded, sizes, crcs = [], [], [], []
                for x in some.column(2).to_pylist():
                    if x[:4] != MAGIC:
                        raise ValueError("not a block of token ids")
                    docs, n, crc = np.frombuffer(x, "<u4", 3, 4).tolist()
                    heads.append(np.frombuffer(x, DOC, docs, 16))
                    coded.append(x[16 + docs * DOC.itemsize :])
                    sizes.append(n)
                    crcs.append(crc)
                out = []
                for part, first, head, ids, crc in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), heads, decode_blocks(coded, sizes), crcs, strict=True):
                    raw = ids.astype("<u4").tobytes()
                    if zlib.crc32(raw, zlib.crc32(head.tobytes())) != crc:
                        raise ValueError("checksum of a block of token ids does not hold")
                    pos = 0
                    for null, doc, n, before, sofar, ends in head.tolist():
                        if ends:
                            out.append((part, None if null else doc, first + pos - before, before + n, zlib.crc32(raw[4 * pos : 4 * (pos + n)], sofar)))
                        pos += n
                cols = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), *[pa.int64()] * 4), strict=True)], ["part", "doc_id", "begin", "n_tokens", "ids_crc32"])

    return blocks.select("part", "first", "data").mapInArrow(trimmed(run), "part int, doc_id long, begin long, n_tokens long, ids_crc32 long")


def write_tokens(docs: DataFrame, path: str, out: str | None = None) -> str:
    """Write the token files to `out`, or a new folder in the shared one; gives the folder."""
    spark: SparkSession = docs.sparkSession
    if out is None:
        out = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    blocks_of(docs, path).write.option("compression", "uncompressed").parquet(out)
    return out


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    Documents are in ascending order of doc_id, a null one first; rows that repeat an id stand one after
    the other. A null text has its end id only. An empty table gives no document.
    """
    blocks = spark.read.schema(BLOCK_ROWS).parquet(folder)
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a file, as many as write tasks
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return read_blocks(blocks).join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")
