"""Suffix-array dedup of long repeated byte strings by sorted ranks of positions, doubled once.

This departs from prefix doubling: ranks are content hashes, so there are no growing offsets and no reranking
until ranks are unique (README gives the figures). Only positions that can begin a repeat are ranked. Each
200-byte window is named by its least 100-byte gram, a choice that depends on the window's bytes alone, so equal
windows share that gram. The windows of one gram occurrence are consecutive starts; their grams' ranks are
sorted, and those that are unique end there. Occurrences whose whole stretch of windows is equal repeat as a
whole. For the others Spark sorts the pairs (rank of the first 100 bytes, rank of the next 100 bytes) of every
window, and a pair that is not unique is a repeat. Ranks are 64-bit content hashes, pairs hold 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, overlapped, row_key, shuffle_parts, trimmed
from .textkit import prefix_sums, signed, span_hash

LENGTH = 200
#: Text bytes ranked at once, and of a longer text's pieces; the arrays of a slab take about a hundred times as much.
SLAB = 1 << 19


#: A stretch of window starts as one number: the first start, then _BITS bits for how many follow it.
_BITS = 16
_OPEN, _WHOLE = 1, 2


#: Of stretches that repeat in one batch, the first goes on as known to repeat, the others are settled.
_KNOWN, _SETTLED = 1, 2


def settle(g: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram, state): before the shuffle, copies of a stretch in one batch shrink to one row of their gram.

    Settled rows are dealt out by their own number instead of the gram.
    """
    _, first, back, count = np.unique(e, return_index=True, return_inverse=True, return_counts=True)
    state = np.where(count[back] > 1, _SETTLED, 0).astype(np.int8)
    state[first[count > 1]] = _KNOWN
    loose = state == _SETTLED
    g = g.copy()
    g[loose] = e[loose] + np.flatnonzero(loose) * 0x9E3779B1
    return g, state


def packed(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return (lo << _BITS) | (hi - lo)


def unpacked(span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lo = span >> _BITS
    return lo, lo + (span & ((1 << _BITS) - 1))


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over x[i : i + width], by doubling; the last width - 1 entries see what is left."""
    x = x.copy()
    step = 1
    while step < width:
        s = min(step, width - step)
        f(x[:-s], x[s:], out=x[:-s]) if s < len(x) else None
        step += s
    return x


def occurrences(data: np.ndarray, offs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Gram occurrences that windows choose: (document, gram rank, rank of the stretch, first start, last start).

    Starts are relative to the document. A window chooses the least gram in it, the first of equal ones.
    """
    half = length // 2
    n = len(data)
    z = np.zeros(0, np.int64)
    if n < length:
        return z, z, z, z, z
    h = prefix_sums(data)
    starts = np.arange(n - half + 1)
    gram = span_hash(h, starts, starts + half)
    least = _slide(gram, length - half + 1, np.minimum)[: n - length + 1]
    doc_of = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    p = np.flatnonzero(doc_of[: n - length + 1] == doc_of[length - 1 :])
    if not len(p):
        return z, z, z, z, z
    # The chosen gram's place is found by carrying on from start to start: the first match at or after p.
    value = least[p]
    place = np.full(len(p), -1, np.int64)
    change = np.append(True, (value[1:] != value[:-1]) | (p[1:] != p[:-1] + 1))
    at = np.flatnonzero(change)
    run = np.cumsum(change) - 1
    last = np.append(at[1:], len(p)) - 1
    # all places where a run's value stands: within one run a value can repeat (periodic text)
    hit = gram == _slide_back(least, p, n - half + 1, length - half + 1)
    spots = np.flatnonzero(hit)
    order = np.searchsorted(spots, p)
    ok = (order < len(spots))
    place[ok] = spots[order[ok]]
    wrong = np.flatnonzero(~ok | (gram[np.maximum(place, 0)] != value))
    while len(wrong):  # the next spot belongs to another run's value: step on
        order[wrong] += 1
        place[wrong] = spots[order[wrong]]
        wrong = wrong[gram[place[wrong]] != value[wrong]]
    cutp = np.append(True, (place[1:] != place[:-1]) | (p[1:] != p[:-1] + 1))
    a = np.flatnonzero(cutp)
    lo, hi = p[a], p[np.append(a[1:], len(p)) - 1]
    stretch = span_hash(h, lo, hi + length) + np.uint64(0x9E37) * (place[a] - lo).astype(np.uint64)
    d = doc_of[lo]
    del at, run, last
    return d, signed(value[a].copy()), signed(stretch), lo - offs[d], hi - offs[d]


def _slide_back(least: np.ndarray, p: np.ndarray, n: int, width: int) -> np.ndarray:
    """For each gram place the greatest window minimum among the windows that contain it (0: none)."""
    x = np.zeros(n, np.uint64)
    x[width - 1 :][p] = least[p]  # place i + width - 1 holds window i, so sliding from i sees windows i - width + 1 .. i
    return _slide(x, width, np.maximum)


class _Groups:
    """Streams rows sorted by (gram, stretch): which repeat as a whole, and one of each stretch of mixed grams."""

    def __init__(self):
        self.tail = None  # the last row, whose successor is not known yet
        self.before = None  # the row before it
        self.first = None  # first row of the open gram, until it has been given out

    def push(self, c: list[np.ndarray], final: bool) -> Iterator[list[np.ndarray]]:
        settled = c[4] == _SETTLED
        if settled.any():
            yield [c[2][settled], (c[3][settled] << 2) | _WHOLE]
            c = [x[~settled] for x in c]
        if self.tail is not None:
            c = [np.append(t, x) for t, x in zip(self.tail, c, strict=True)]
        if not len(c[0]):
            return
        n = len(c[0]) if final else len(c[0]) - 1
        g, e = c[0], c[1]
        same_prev_g, same_prev_e = np.zeros(len(g), bool), np.zeros(len(g), bool)
        same_prev_g[1:] = g[1:] == g[:-1]
        same_prev_e[1:] = same_prev_g[1:] & (e[1:] == e[:-1])
        if self.before is not None:
            same_prev_g[0] = g[0] == self.before[0]
            same_prev_e[0] = same_prev_g[0] and e[0] == self.before[1]
        same_next_e = np.append(same_prev_e[1:], False)
        whole = (same_prev_e | same_next_e)[:n]
        fresh = ~same_prev_e[:n]  # first row of its stretch
        lead = ~same_prev_g[:n]  # first row of its gram
        # a gram is mixed where a stretch begins that is not the gram's first
        second = fresh & ~lead
        group = np.cumsum(lead)  # 0: goes on from before
        mixed = np.zeros(int(group[-1]) + 1 if n else 1, bool)
        mixed[group[second]] = True
        give = fresh & mixed[group]
        row, span = (x[:n] for x in c[2:4])
        whole |= c[4][:n] == _KNOWN
        if whole.any():
            yield [row[whole], (span[whole] << 2) | _WHOLE]
        rows, spans = row[give], (span[give] << 2) | _OPEN | np.where(whole[give], _WHOLE, 0)
        if mixed[0] and self.first is not None:
            rows, spans = np.append(self.first[0], rows), np.append(self.first[1], spans)
            self.first = None
        if len(rows):
            yield [rows, spans]
        leads = np.flatnonzero(lead)
        if len(leads):
            i = leads[-1]
            self.first = None if mixed[-1] else (int(row[i]), (int(span[i]) << 2) | _OPEN | (_WHOLE if whole[i] else 0))
        self.before = tuple(int(x[n - 1]) for x in c[:2]) if n else self.before
        self.tail = None if final else [x[-1:] for x in c]


def _group(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups = _Groups()
    for b in _with_end(rows):
        c = [np.zeros(0, np.int64)] * 5 if b is None else [b.column(i).to_numpy() for i in range(5)]
        for row, span in groups.push(c, b is None):
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(span)], ["row", "span"])


def _repeated(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (r1, r2): starts (row, lo) of pairs that stand more than once and are still open."""
    tail, before = None, None
    for b in _with_end(rows):
        c = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, bool)] if b is None else [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if tail is not None:
            c = [np.append(t, x) for t, x in zip(tail, c, strict=True)]
        if not len(c[0]):
            continue
        n = len(c[0]) if b is None else len(c[0]) - 1
        same = np.zeros(len(c[0]) + 1, bool)
        same[1:-1] = (c[0][1:] == c[0][:-1]) & (c[1][1:] == c[1][:-1])
        if before is not None:
            same[0] = before == (int(c[0][0]), int(c[1][0]))
        keep = (same[:-1] | same[1:])[:n] & ~c[4][:n].astype(bool)
        before = (int(c[0][n - 1]), int(c[1][n - 1])) if n else before
        tail = [x[-1:] for x in c]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[2][:n][keep]), pa.array(c[3][:n][keep])], ["row", "lo"])


def _with_end(rows):
    for b in rows:
        if len(b):
            yield b
    yield None


def _repeat_spans(rows: DataFrame, length: int, slab: int) -> DataFrame:
    """rows: row (key), text. Gives (row, spans): packed runs of window starts that repeat; not every row is there."""
    spark = rows.sparkSession
    half = length // 2
    parts = shuffle_parts(spark)

    def grams(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for rows_, first, data, offs in overlapped(b, slab, length - 1):
                d, g, e, lo, hi = occurrences(data, offs, length)
                g, state = settle(g, e)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(e), pa.array(ids[rows_][d]), pa.array(packed(lo + first[d], hi + first[d])), pa.array(state)], ["g", "e", "row", "span", "state"])

    ranked = "g long, e long, row long, span long, state byte"
    found = cut(rows.select("row", "text").mapInArrow(trimmed(grams), ranked).repartition(parts, "g").sortWithinPartitions("g", "e").mapInArrow(trimmed(_group), "row long, span long"))
    is_open = F.col("span").bitwiseAND(_OPEN) != 0
    open_ = found.where(is_open).groupBy("row").agg(F.collect_list("span").alias("spans"))

    def pairs(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, ids = b.column(2), b.column(0).to_numpy()
            for rows_, first, data, offs in overlapped(b, slab, length - 1):
                h = prefix_sums(data)
                part = spans.slice(int(rows_[0]), len(rows_))
                own = np.repeat(np.arange(len(rows_)), pa.compute.list_value_length(part).to_numpy())
                flat = part.flatten().to_numpy()
                start = unpacked(flat >> 2)[0]
                here = (start >= first[own]) & (start < first[own] + slab)  # of a text in pieces
                own, flat = own[here], flat[here]
                lo, hi = (x - first[own] + offs[own] for x in unpacked(flat >> 2))
                whole = (flat & _WHOLE) != 0
                n = hi - lo + 1
                p = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                who = np.repeat(own, n)
                r1, r2 = span_hash(h, p, p + half), span_hash(h, p + half, p + length)
                yield pa.RecordBatch.from_arrays([pa.array(signed(r1)), pa.array(signed(r2)), pa.array(ids[rows_][who]), pa.array(p - offs[who] + first[who]), pa.array(np.repeat(whole, n))], ["r1", "r2", "row", "lo", "whole"])

    # A row that stands twice yields its pairs twice; its stretches are `whole` then, so that adds nothing.
    texts = rows.select("row", "text").join(open_, "row").select("row", "text", "spans")
    sorted_pairs = texts.mapInArrow(trimmed(pairs), "r1 long, r2 long, row long, lo long, whole boolean").repartition(parts, "r1", "r2").sortWithinPartitions("r1", "r2")
    single = cut(sorted_pairs.mapInArrow(trimmed(_repeated), "row long, lo long"))
    spans = found.where(~is_open).select("row", F.shiftright("span", 2).alias("span")).union(single.select("row", F.shiftleft("lo", _BITS).alias("span")))
    return spans.groupBy("row").agg(F.collect_list("span").alias("spans"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rest = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c != "text"]
    # The text moves once: the record holds the other columns and whether the text is null.
    rec = F.struct(*[c.alias(f"c{k}") for k, c in enumerate(rest)], F.col("text").isNull().alias("none"))
    return docs.select(row_key(docs, F.col("doc_id").cast("long"), text).alias("row"), text.alias("text"), rec.alias("rec"))


def _runs(spans: pa.ListScalar, length: int) -> tuple[list[int], list[int]]:
    """First bytes and ends of the maximal runs that spans of window starts cover; null and empty lists have none."""
    if not spans.is_valid or not len(spans.values):
        return [], []
    lo, hi = unpacked(np.sort(spans.values.to_numpy()))
    end = np.maximum.accumulate(hi + length)
    fresh = np.flatnonzero(np.append(True, lo[1:] > end[:-1]))
    return lo[fresh].tolist(), end[np.append(fresh[1:] - 1, len(end) - 1)].tolist()


def _without(raw: bytes, begin: list[int], end: list[int]) -> bytes:
    return b"".join(raw[a:z] for a, z in zip([0, *end], [*begin, len(raw)], strict=True))


def remove_repeats(docs: DataFrame, length: int = LENGTH, slab: int = SLAB) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, one row a document.

    Removes each byte covered by a string of `length` bytes that also starts anywhere else, in the same
    or another document, judged on the input. A null text counts as empty; texts under `length` bytes
    stay whole. Repeated rows repeat each other's strings, so their long texts go in all of them. A null
    doc_id is carried through, empty tables give an empty result, extra columns are ignored. A text of more
    than `slab` bytes is ranked in pieces that overlap.
    """
    rows = _keyed(docs.select("doc_id", "text"))

    def digests(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column(1), b.column(2), strict=True):
                raw = text.as_buffer().to_pybytes()
                begin, end = _runs(spans, length)
                gone, runs, left = sum(end) - sum(begin), len(begin), _without(raw, begin, end)
                out.append((len(raw), gone, runs, hashlib.sha256(left).hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = rows.join(_repeat_spans(rows, length, slab), "row", "left").select(F.col("rec.c0").cast("long").alias("doc_id"), "text", "spans")
    return joined.mapInArrow(trimmed(digests), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def clean_texts(docs: DataFrame, length: int = LENGTH, slab: int = SLAB) -> DataFrame:
    """`docs` with the repeats of `remove_repeats` taken out of text; n_chars, if there, is counted anew.

    Bytes of a character that is cut in two go with it. A null text stays null; no row is dropped.
    """
    rows = _keyed(docs)

    def kept(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column(1), b.column(2), strict=True):
                begin, end = _runs(spans, length)
                out.append(_without(text.as_buffer().to_pybytes(), begin, end).decode("utf-8", "ignore") if begin else text.as_py())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["rec", "left"])

    joined = rows.join(_repeat_spans(rows.select("row", "text"), length, slab), "row", "left").select("rec", "text", "spans")
    got = joined.mapInArrow(trimmed(kept), T.StructType([joined.schema["rec"], T.StructField("left", T.StringType())]))
    text = F.when(~F.col("rec.none"), F.col("left"))
    place = {c: f"rec.c{k}" for k, c in enumerate(c for c in docs.columns if c != "text")}
    return got.select(*[text.alias("text") if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(place[c]).alias(c) for c in docs.columns])
