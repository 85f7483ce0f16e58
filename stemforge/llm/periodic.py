"""Periodic runs of words by branching tandem repeats, after Stoye and Gusfield.

The suffix tree of the words is held as a suffix array with the common prefixes of its neighbours: the tree's
inner nodes are the ranges between smaller values. For every node the leaves of its smaller half are walked;
a leaf i whose partner i + depth or i - depth stands in the other half is a tandem repeat that cannot go on
(a branching one). Rotating it to the left as far as the words allow gives its maximal run, and runs of equal
bounds are one run of the smallest period.

Texts are first cut to stretches that could hold a run, which keeps the trees small: a run of period q repeats
a gram of 6 * 2**k words at a distance under twice that length, for the k with 6 * 2**k <= q (k = 0 below 12).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slabs, trimmed
from .textkit import IS_SPACE, mix, rolling, same_bytes, word_bounds, word_keys

#: A run has at least this many words and at least two periods.
MIN_WORDS = 12
#: Words of the shortest gram that a run repeats: MIN_WORDS less the longest period under it that needs no more.
GRAM = MIN_WORDS // 2
#: Leaves walked at once.
LEAVES = 1 << 21

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def stretches(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words may be part of a run; every run lies in one unbroken stretch of such words.

    Level k looks at grams of 6 * 2**k words whose halves both repeat in their text. Two places of a gram at a
    distance under twice its length cover all words between them and the second gram.
    """
    cover = np.zeros(len(keys) + 1, np.int64)
    at, h = rolling(keys, doc, GRAM)
    h = mix(h ^ (doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    size = GRAM
    while len(at):
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        i, j = at[order[:-1][same]], at[order[1:][same]]
        near = j - i < 2 * size
        np.add.at(cover, i[near], 1)
        np.add.at(cover, j[near] + size, -1)
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at, h = at[twice], h[twice]
        after = np.searchsorted(at, at + size)
        whole = (after < len(at)) & (at[np.minimum(after, len(at) - 1)] == at + size) if len(at) else np.zeros(0, bool)
        h = mix(h[whole] + h[after[whole]] * np.uint64(0xD1342543DE82EF95))
        at = at[whole]
        size *= 2
    return np.cumsum(cover[:-1]) > 0


def _ranks(symbols: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(ranks of the substrings of 1, 2, 4, ... symbols from each place, the suffix array).

    Only places whose rank is shared are sorted again. All ends are unique symbols, so no repeat goes past one.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.ones(n, bool)
    new[1:] = symbols[order[1:]] != symbols[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, size = [], 1
    while True:
        shared = np.bincount(rank, minlength=n) > 1
        some = np.flatnonzero(shared[rank])
        if not len(some):
            break
        levels.append(rank.astype(np.int32))
        key = rank[some] * (n + 1) + rank[some + size]  # a shared place is `size` symbols before its text's end at least
        order = np.argsort(key, kind="stable")
        some, key = some[order], key[order]
        old = rank[some]
        place = np.arange(len(some))
        group = np.ones(len(some), bool)
        group[1:] = old[1:] != old[:-1]
        new = np.ones(len(some), bool)
        new[1:] = key[1:] != key[:-1]
        rank = rank.copy()
        rank[some] = old + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        size *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return levels, suffixes


def _common_ahead(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Symbols that the suffixes from i and j share."""
    got = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        got += (levels[k][i + got] == levels[k][j + got]).astype(np.int64) << k
    return got


def _common_behind(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Symbols that stand alike before i and before j, for i < j."""
    got = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i - got - (1 << k), j - got - (1 << k)
        got += ((a >= 0) & (levels[k][np.maximum(a, 0)] == levels[k][np.maximum(b, 0)])).astype(np.int64) << k
    return got


def _nodes(depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each boundary's node: the last smaller depth before it, the first one after it that is not greater.

    Both are found for all boundaries at once by jumps of falling size over least depths of 2**k neighbours.
    """
    n = len(depth)
    least = [depth]
    while 2 << (len(least) - 1) <= n:
        half = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][: len(least[-1]) - half], least[-1][half:]))
    left, right = np.arange(n), np.arange(1, n + 1)
    for k in range(len(least) - 1, -1, -1):
        start = left - (1 << k)
        left = np.where((start >= 0) & (least[k][np.clip(start, 0, len(least[k]) - 1)] >= depth), start, left)
        inside = right + (1 << k) <= n
        right = np.where(inside & (least[k][np.minimum(right, len(least[k]) - 1)] > depth), right + (1 << k), right)
    return np.maximum(left - 1, 0), right


def tandem_repeats(levels: list[np.ndarray], suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every branching tandem repeat: two equal halves after which the first differs.

    A boundary between two neighbours of the suffix array splits its node in two; the leaves of the smaller
    half are walked, at most n log n of them in all.
    """
    n = len(suffixes)
    depth = np.full(n, -1, np.int64)
    depth[1:] = _common_ahead(levels, suffixes[:-1], suffixes[1:])
    left, right = _nodes(depth)
    place = np.empty(n, np.int64)
    place[suffixes] = np.arange(n)
    inner = np.flatnonzero(depth > 0)
    low = inner - left[inner] <= right[inner] - inner  # the left half is the smaller one
    first = np.where(low, left[inner], inner)
    size = np.minimum(inner - left[inner], right[inner] - inner)
    lo, hi = np.where(low, inner, left[inner]), np.where(low, right[inner], inner)
    ends = np.cumsum(size)
    starts, periods = [], []
    a = 0
    while a < len(inner):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + LEAVES, "right")))
        own = np.repeat(np.arange(a, b), size[a:b])
        leaf = suffixes[np.arange(len(own)) - np.repeat(ends[a:b] - size[a:b] - (ends[a - 1] if a else 0), size[a:b]) + first[own]]
        d = depth[inner[own]]
        for other in (leaf + d, leaf - d):
            there = (other >= 0) & (other < n)
            at = place[np.where(there, other, 0)]
            hit = there & (at >= lo[own]) & (at < hi[own])
            starts.append(np.minimum(leaf, other)[hit])
            periods.append(d[hit])
        a = b
    none = [np.zeros(0, np.int64)]
    return np.concatenate(starts or none), np.concatenate(periods or none)


def maximal_runs(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, smallest period) of the runs of a row of symbols, by start and period.

    Symbols under zero end a text, and each of them stands once; the last symbol is one of them.
    """
    levels, suffixes = _ranks(symbols)
    start, period = tandem_repeats(levels, suffixes)
    end = start + 2 * period
    start = start - _common_behind(levels, start, start + period)
    long = end - start >= MIN_WORDS
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))  # the smallest period of equal bounds comes first
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


def _codes(data: np.ndarray, s: np.ndarray, e: np.ndarray, keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Numbers of words, the same for the same bytes in one text; keys only propose what is the same."""
    _, first, code = np.unique(keys, return_index=True, return_inverse=True)
    r = first[code]
    if not (((e - s) == (e - s)[r]).all() and same_bytes(data, s, data, s[r], e - s).all()):
        seen: dict[bytes, int] = {}
        code = np.array([seen.setdefault(data[a:b].tobytes(), len(seen)) for a, b in zip(s.tolist(), e.tolist(), strict=True)], np.int64)
    return np.unique(code.astype(np.int64) * (int(doc[-1]) + 1 if len(doc) else 1) + doc, return_inverse=True)[1]


def word_runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs in a slab of texts: (word starts, word ends, text of each word, text, start, length, period of each run)."""
    s, e, doc = word_bounds(data, offs, ~IS_SPACE)
    none = np.zeros(0, np.int64)
    if len(s) < MIN_WORDS:
        return s, e, doc, none, none, none, none
    keys = word_keys(data, s, e)
    at = np.flatnonzero(stretches(keys, doc))
    if not len(at):
        return s, e, doc, none, none, none, none
    broken = np.ones(len(at), bool)
    broken[1:] = (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])
    piece = np.cumsum(broken) - 1
    symbols = np.empty(len(at) + int(piece[-1]) + 1, np.int64)
    word = np.empty(len(symbols), np.int64)
    own = np.arange(len(at)) + piece  # one end after each piece
    symbols[own], word[own] = _codes(data, s[at], e[at], keys[at], doc[at]), at
    last = np.append(np.flatnonzero(broken)[1:], len(at)) + np.arange(int(piece[-1]) + 1)
    symbols[last] = -1 - np.arange(len(last))
    start, length, period = maximal_runs(symbols)
    start = word[start]
    first = np.searchsorted(doc, doc[start])
    return s, e, doc, doc[start], start - first, length, period


def _collapsed(data: np.ndarray, offs: np.ndarray, s: np.ndarray, e: np.ndarray, doc: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of the texts left, words joined by one space; the byte after a word is made its space."""
    kept = np.flatnonzero(~gone)
    last = np.ones(len(kept), bool)
    last[:-1] = doc[kept[1:]] != doc[kept[:-1]]
    out = np.append(data, np.uint8(32))
    out[e[kept][~last]] = 32
    turn = np.zeros(len(data) + 2, np.int8)
    turn[s[kept]] += 1
    np.add.at(turn, e[kept] + ~last, -1)
    stays = np.cumsum(turn[:-1], dtype=np.int8) > 0
    size = np.zeros(len(offs), np.int64)
    np.add.at(size, doc[kept] + 1, e[kept] - s[kept] + ~last)
    return out[stays], np.cumsum(size)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, runs (start, length, period, by start then period), collapsed.

    A run is a stretch of at least 12 words and two periods, of which every word equals the one a smallest
    period before it, and which no neighbouring word prolongs. `collapsed` holds the words that no run has after
    its first period, joined by one space. Null and empty texts and texts of blanks have no word, no run and
    an empty `collapsed`; repeated rows and null ids give a row each; an empty table gives none; other columns
    are not read. A text is one slab, whose tree takes some 250 bytes a word of its periodic stretches and
    80 a word of the rest.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, data, offs in slabs(b):
                s, e, doc, owner, start, length, period = word_runs(data, offs)
                first = np.searchsorted(doc, np.arange(z - a + 1))
                turn = np.zeros(len(s) + 1, np.int64)
                np.add.at(turn, first[owner] + start + period, 1)
                np.add.at(turn, first[owner] + start + length, -1)
                left, bounds = _collapsed(data, offs, s, e, doc, np.cumsum(turn[:-1]) > 0)
                order = np.argsort(owner, kind="stable")
                runs = pa.StructArray.from_arrays([pa.array(x[order]) for x in (start, length, period)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[order], np.arange(z - a + 1)).astype(np.int32)), runs)
                texts = pa.Array.from_buffers(pa.string(), z - a, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(left)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array(np.diff(first)), lists, texts], ["doc_id", "n_words", "runs", "collapsed"])

    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return narrow.mapInArrow(trimmed(run), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text, or for one id in ten (by checksum) its words with the tail from some word on made periodic."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    n = F.size(words)
    a = (g % F.nullif(n, F.lit(0))).cast("int")
    p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
    tail = F.slice(words, a + 1, p)
    copies = F.flatten(F.array_repeat(tail, F.floor((n - a) / p).cast("int")))
    whole = F.concat(F.slice(words, F.lit(1), a), copies, F.slice(tail, F.lit(1), (n - a) % p))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(whole, " ")).otherwise(text)


def run_report(found: DataFrame) -> DataFrame:
    """Digest columns of `find_runs`: number of runs, the longest one (ties: smallest start, then period), two hashes."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("best.a")
    return rows.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(length * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
