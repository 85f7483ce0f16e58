"""Best-fit packing with certified bin counts.

Pieces are dealt out over partitions and each is packed best-fit decreasing. Dual feasible functions
give a lower bound on the bins that a partition's pieces need; a partition that meets it is certified
and done, but for its emptiest bin. A partition with a gap gives up its emptiest bins, an eighth of its pieces
at most; these are dealt out anew over partitions of the same size, and best-fit decreasing runs again, until
no gap is left or one partition's worth remains. Each round has an eighth of the pieces of the one before, and
no task ever takes more than a partition's worth. Only lengths and keys move, never ids or texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoded_groups
from .common import cut, shuffle_parts, trimmed

CAPACITY = 2048
END_ID = 0
#: Pieces that one packing task takes.
PART_PIECES = 50_000
#: One in so many of a partition's pieces goes on to the next round.
EXCHANGED = 8


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Fewest bins that any packing needs, by two families of dual feasible functions.

    f_e: lengths over capacity - e count as whole bins, those under e as nothing. u_k: rounds shares to
    k-ths, leaving exact multiples of 1/(k+1) as they are.
    """
    n = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((n * size).sum()) // capacity)
    mass, count = np.cumsum(n * size), np.cumsum(n)
    e = np.arange(1, capacity // 2 + 1)
    whole = count[-1] - count[capacity - e]
    best = max(best, int((-(-(whole * capacity + mass[capacity - e] - mass[e - 1]) // capacity)).max()))
    for k in range(1, 41):
        exact = size * (k + 1) % capacity == 0
        f = np.where(exact, size * k, (size * (k + 1) // capacity) * capacity)  # times k * capacity
        best = max(best, -(-int((n * f).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset in it) of each piece, and the number of bins."""
    bins, offs = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: an open bin has r left
    used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = some >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some ^= 1 << r
        else:
            b, r, used = used, capacity, used + 1
        bins[i], offs[i] = b, capacity - r
        if r > n:
            room[r - n].append(b)
            some |= 1 << (r - n)
    return bins, offs, used


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of the documents' ids: only documents of more than `capacity` ids (with the end id) are cut."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            out: list[tuple] = []
            for a, _, flat, bound in encoded_groups(b, path):
                raw, bound = flat.astype("<u4"), bound.tolist()
                for j in range(len(bound) - 1):
                    own = raw[bound[j] : bound[j + 1]].tobytes() + b"\0\0\0\0"
                    for p, s in enumerate(range(0, len(own), 4 * capacity)):
                        part = own[s : s + 4 * capacity]
                        out.append((ids[a + j], p, s // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), PIECES)


def given_up(lengths: np.ndarray, bins: np.ndarray, used: int, most: int, capacity: int = CAPACITY) -> np.ndarray:
    """Which bins of a partition go on: the emptiest of at most `most` pieces (one at least); of a certified one, one.

    Full bins stay. One bin of a certified partition goes on, to be filled up with those of others.
    """
    load, n = np.bincount(bins, weights=lengths, minlength=used).astype(np.int64), np.bincount(bins, minlength=used)
    order = np.argsort(load, kind="stable")
    many = 1 if used == lower_bound(lengths, capacity) else max(1, int(np.searchsorted(np.cumsum(n[order]), most, "right")))
    go = np.zeros(used, bool)
    go[order[:many]] = True
    return go & (load < capacity)


def _pack(capacity: int, most: int):
    """Packs rows (row, length, part) sorted by part, one part after the other: adds bin, offset and whether the bin stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the part that is open

        def packed():
            rows = pa.Table.from_batches(held)
            lengths, part = rows["length"].to_numpy(), rows["part"].to_numpy()
            bins, offs, used = best_fit_decreasing(lengths, capacity)
            done = ~given_up(lengths, bins, used, most, capacity)[bins]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (rows["row"].to_numpy(), lengths, part, bins, offs, done)], ["row", "length", "part", "bin", "offset", "done"])

        for b in batches:
            part = b.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if z > a and held and held[-1].column(2)[0].as_py() != part[a]:
                    yield packed()
                    held = []
                if z > a:
                    held.append(b.slice(a, z - a))
        if held:
            yield packed()

    return run


PACKED = "row long, length long, part long, bin long, offset long, done boolean"


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, part_pieces: int = PART_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, one row a piece.

    A document is the ids of its whole text (null: empty) and the end id 0, so every document has a
    piece. Ids equal those of the `tokenizers` library. Repeated rows are packed each; a null doc_id is
    carried through; an empty table gives an empty result; extra columns are ignored.
    """
    cuts = cut(pieces(docs, path, capacity).withColumn("row", F.monotonically_increasing_id()))
    todo = cuts.select("row", "length")
    n = todo.count()
    done = None
    for k in count():
        parts = max(1, -(-n // part_pieces))
        tasks = min(parts, max(1, shuffle_parts(docs.sparkSession)))
        dealt = todo.withColumn("part", F.pmod(F.xxhash64("row", F.lit(k)), F.lit(parts)))
        packed = cut(dealt.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(trimmed(_pack(capacity, part_pieces // EXCHANGED)), PACKED).withColumn("seq", F.lit(k)))
        again = packed.where("not done")
        m = again.count()
        final = parts == 1 or m == 0 or 2 * m > n  # the last where a bin is no small share of a partition
        closed = packed if final else packed.where("done")
        done = closed if done is None else done.unionByName(closed)
        if final:
            break
        todo, n = again.select("row", "length"), m
    seq = F.col("seq") * (1 << 58) + F.col("part") * (1 << 28) + F.col("bin")
    return cuts.join(done.select("row", seq.alias("sequence_id"), "offset"), "row").drop("row").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
