"""Exact Jaccard join on word shingles with adaptive multi-match prefixes.

Sets are put in one global order: rare shingles by hash, then a bounded list of the commonest by
frequency. If two sets of similarity t or more are cut to their first |x| - ceil(t|x|) + l shingles,
they share l of those at least. Each set chooses its own l: a longer prefix is read, and in return as
many shared shingles are asked for before a pair is verified; the choice weighs the postings that the
prefix touches against the candidates that can still have l matches. A pair needs the smaller l of both.

Links only matter by the components they form, and copies of one shingle set are one node. Each round
takes the posting lists whose nodes are not all in one component yet and lets a list's leader, its node of
the least hash that round, stand for it; each node is verified against the few leaders that it shares most
lists with. A round is linear in the lists. When a round links little, the pairs that are left, between a
node outside the largest component of a list and any node of another component there, are enumerated by
their multi-match prefixes, so a group of near copies never becomes all its pairs. Before that, rounds hold
each node against the most alike of another component in a window of each list, which is linear again and
joins most of what is one component but shares no leader. A bitmap of each set, in which every shingle flips
one bit, bounds how much two sets differ: by it the enumeration drops pairs that cannot link before they are
rows, and by one as wide as the set those that it is too narrow for before their sets are moved. Which share of the links a round finds depends on the data; the
enumeration alone would find them all.

Words and shingles are compared by 64-bit keys that no pattern of words can make alike. Of a link each side
needs hundreds of them, and a set is known by two such numbers, 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, cut, discard, shuffle_parts, slabs, trimmed
from .components import components
from .textkit import IS_SPACE, LOWER, mix, rolling, signed, word_bounds, word_keys

SHINGLE_WORDS = 5
PERCENT = 75
MAX_MATCHES = 8
#: Entries of the list of common shingles; the rest count as rare. Affects cost only, never links.
COMMON = 100_000
#: Shingles whose frequencies are counted at once in a task.
COUNTED = 1_500_000
#: A verification costs as much as reading so many postings.
VERIFY_COST = 16
#: Leaders that a node is held against in a round; rounds go on while one of so many of these pairs links.
LEADERS = 4
WORTH = 100
#: Most nodes whose bitmaps are sent to the tasks, some 20 MB; more are joined.
SIGNED_ROWS = 250_000
#: Nodes of a list that are held against each other in a round of the most alike; such rounds go on while one of so
#: many of their pairs links.
WINDOW = 512
NEAREST_WORTH = 10
_IS_WORD = ~IS_SPACE
_CHECK = np.uint64(0x5851F42D4C957F2D)
#: Bytes of a long text that are cut into shingles at once.
PIECE_BYTES = 4 << 20
#: Sets remembered by a task, to give each out once.
SEEN = 100_000


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE_WORDS, piece: int = PIECE_BYTES) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; under k words, the whole sequence is one shingle."""
    if len(offs) == 2 and len(data) > piece:
        return [_long_set(data, k, piece)]
    low = LOWER[data]
    start, end, doc = word_bounds(low, offs, _IS_WORD)
    words = word_keys(low, start, end)
    at, h = rolling(words, doc, k)
    n = len(offs) - 1
    count = np.bincount(doc, minlength=n)
    bound = np.searchsorted(doc[at], np.arange(n + 1))
    first = np.cumsum(count) - count
    return [_set_of(words[first[i] : first[i] + count[i]], h[bound[i] : bound[i + 1]], k) for i in range(n)]


def _set_of(words: np.ndarray, h: np.ndarray, k: int) -> np.ndarray:
    if len(words) >= k or not len(words):
        return np.unique(h)
    return rolling(words, np.zeros(len(words), np.int64), len(words))[1]


def _long_set(data: np.ndarray, k: int, piece: int) -> np.ndarray:
    """The set of one long text, whose words are taken in pieces that end at white space."""
    found, last, at, total = [np.zeros(0, np.uint64)], np.zeros(0, np.uint64), 0, 0
    while at < len(data):
        stop = at + piece
        while stop < len(data) and not IS_SPACE[data[stop]]:
            stop += 1
        low = LOWER[data[at:stop]]
        words = np.concatenate([last, word_keys(low, *word_bounds(low, np.array([0, len(low)]), _IS_WORD)[:2])])
        found.append(np.unique(rolling(words, np.zeros(len(words), np.int64), k)[1]))
        total += len(words) - len(last)
        last, at = words[-(k - 1) :], stop
    return np.unique(np.concatenate(found)) if total >= k else _set_of(last, last[:0], k)


def node_of(s: np.ndarray, renamed: dict[tuple[int, int], int] | None = None) -> tuple[int, int]:
    """(number, check) of a shingle set, by its contents. Numbers that two sets share are told apart by `renamed`."""
    two = np.array([np.add.reduce(mix(s)) + np.uint64(len(s)), np.add.reduce(mix(s ^ _CHECK)) + np.uint64(len(s))], np.uint64)
    node, check = signed(mix(two)).tolist()
    return (renamed or {}).get((node, check), node), check


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


SIGNATURE = tuple(f"g{k}" for k in range(8))


def signature(s: np.ndarray) -> np.ndarray:
    """512 bits as 8 numbers: each shingle flips one, so two sets differ in as many shingles as bits, at least."""
    odd = np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=512).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def wide_bits(s: np.ndarray) -> np.ndarray | None:
    """Such a bitmap of at least as many bits as shingles; none if `signature` has enough. Halves fold to one of half the bits."""
    if len(s) <= 512:
        return None
    bits = 1 << (len(s) - 1).bit_length()
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).view(np.int64)


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """Bits that differ in two wide bitmaps, the longer one folded."""
    x, y = (z.view(np.uint64) for z in sorted((x, y), key=len))  # the bits of a negative number would be those of its opposite
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _nodes_and_tokens(docs: DataFrame) -> DataFrame:
    """One pass over the texts: a row of each document, and rows (token, n) of how often shingles come.

    Documents: doc_id, n_shingles, node, node_check, text_hash, g0 to g7, wide; the other columns of each kind are null.
    """
    names = ["doc_id", "n_shingles", "node", "node_check", "text_hash", *SIGNATURE, "wide", "token", "n"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted():
            t, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= (3 if size >= COUNTED else 2)  # rarer ones of so many shingles are not among the commonest
            none = pa.nulls(int(keep.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([none] * (len(names) - 3) + [pa.nulls(len(none), pa.list_(pa.int64())), pa.array(signed(t[keep])), pa.array(n[keep])], names)

        for b in batches:
            for a, z, data, offs in slabs(b):
                sets = shingle_sets(data, offs)
                named = [node_of(s) if len(s) else (None, None) for s in sets]
                bits = np.stack([signature(s) for s in sets], 1)
                none = pa.nulls(z - a, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*named, strict=True)), b.column(2).slice(a, z - a), *map(pa.array, bits), pa.array(map(wide_bits, sets), pa.list_(pa.int64())), none, none], names)
                held += sets
                size += sum(map(len, sets))
                if size >= COUNTED:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    rows = _texts(docs).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(trimmed(run), ", ".join(f"{c} {'array<long>' if c == 'wide' else 'long'}" for c in names))


def _common(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles (sorted) and the class of each, 1 and up by frequency; COMMON of them at most."""
    found = cut(tokens.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(COMMON))
    got = found.toArrow()
    discard(found)
    token, n = got["token"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(token)
    return token[order], np.ceil(np.log2(np.maximum(n[order], 2))).astype(np.int64)


class Order:
    """The global order of shingles: (class, hash)."""

    def __init__(self, token: np.ndarray, level: np.ndarray):
        self.token, self.level = token, level
        self.bit = np.zeros(1 << 22, bool)
        self.bit[(token >> np.uint64(42)).astype(np.int64)] = True

    def sort(self, s: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.bit[(s >> np.uint64(42)).astype(np.int64)])
        if len(maybe) and len(self.token):
            at = np.minimum(np.searchsorted(self.token, s[maybe]), len(self.token) - 1)
            hit = self.token[at] == s[maybe]
            if hit.any():
                level = np.zeros(len(s), np.int64)
                level[maybe[hit]] = self.level[at[hit]]
                return s[np.argsort(level, kind="stable")]
        return s


def needed(n: int | Column, percent: int) -> int | Column:
    """Least overlap of a set of n shingles with any set it links to."""
    return -(-n * percent // 100) if isinstance(n, int) else F.floor((n * percent + 99) / 100)


def _clashes(base: DataFrame) -> dict[tuple[int, int], int]:
    """New numbers for sets whose number another set has: about one in 10**20 pairs of sets."""
    several = base.where("node is not null").groupBy("node").agg(F.min("node_check").alias("lo"), F.max("node_check").alias("hi")).where("lo <> hi").select("node")
    found = base.join(several, "node", "left_semi").select("node", "node_check").distinct().limit(10_001).collect()
    if len(found) > 10_000:
        raise ValueError("too many shingle sets share their 64-bit number")
    return {(n, c): int(signed(mix(np.array([n, c], np.int64).view(np.uint64)))[0] ^ c) for n, c in found}


def _postings(docs: DataFrame, order, percent: int, renamed: dict) -> DataFrame:
    """(token, node, place) of the longest prefix of each set, once a node and task; place is set size << 32 | position."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        o, seen = Order(*order.value), set()
        for b in batches:
            for _, _, data, offs in slabs(b):
                flat, nodes, places = [], [], []
                for s in shingle_sets(data, offs):
                    node = node_of(s, renamed)[0] if len(s) else None
                    if node is not None and node not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(node)
                        t = needed(len(s), percent)
                        flat.append(o.sort(s)[: len(s) - t + min(MAX_MATCHES, t)])
                        nodes.append(node)
                        places.append((len(s) << 32) + 1 + np.arange(len(flat[-1])))
                if flat:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(flat))), pa.array(np.repeat(np.array(nodes, np.int64), [len(x) for x in flat])), pa.array(np.concatenate(places))], ["token", "node", "place"])

    return _texts(docs).mapInArrow(trimmed(run), "token long, node long, place long")


def _shared(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token and node: those of tokens that several nodes have, each node once.

    A stream: only the first row of the current token is held, however long its list is.
    """
    last, alone = None, None  # token and node of the row before; that row if it is the only one of its token so far
    for b in rows:
        c = [b.column(i).to_numpy() for i in range(3)]
        if not len(c[0]):
            continue
        again = np.zeros(len(c[0]), bool)
        again[1:] = (c[0][1:] == c[0][:-1]) & (c[1][1:] == c[1][:-1])
        again[0] = last == (c[0][0], c[1][0])
        c = [x[~again] for x in c]
        if not len(c[0]):
            continue
        goes_on = np.zeros(len(c[0]), bool)
        goes_on[1:] = c[0][1:] == c[0][:-1]
        goes_on[0] = last is not None and last[0] == c[0][0]
        keep = goes_on | np.append(goes_on[1:], False)
        out = [x[keep] for x in c]
        if goes_on[0] and alone is not None:
            out = [np.append(v, x) for v, x in zip(alone, out, strict=True)]
        alone = None if goes_on[-1] else [x[-1:] for x in c]
        last = (c[0][-1], c[1][-1])
        if len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["token", "node", "place"])


def _sets(docs: DataFrame, kept: DataFrame, renamed: dict) -> DataFrame:
    """(node, set) of the given nodes (node, doc_id, text_hash), from the row that each names.

    Only those rows are cut into shingles. Their list is sent to the tasks if it is short, and else joined.
    """
    rows = _texts(docs).withColumn("text_hash", F.xxhash64("text"))
    named = F.xxhash64("doc_id", "text_hash")
    if kept.count() <= BROADCAST_ROWS:
        some = docs.sparkSession.sparkContext.broadcast(np.sort(kept.select(named.alias("k")).toArrow()["k"].to_numpy()))
    else:
        some = None
        rows = rows.join(kept.select("doc_id", "text_hash"), rows["doc_id"].eqNullSafe(kept["doc_id"]) & (rows["text_hash"] == kept["text_hash"]), "left_semi")

    def run(batches) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            if some is not None and len(b):
                w, k = some.value, b.column(1).to_numpy()
                b = b.filter(pa.array(w[np.minimum(np.searchsorted(w, k), len(w) - 1)] == k if len(w) else np.zeros(len(k), bool)))
            ids, sets = [], []
            for _, _, data, offs in slabs(b):
                for s in shingle_sets(data, offs):
                    node = node_of(s, renamed)[0] if len(s) else None
                    if node is not None and node not in seen:  # rows that repeat id and text
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(node)
                        ids.append(node)
                        sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])

    return rows.select("text", named.alias("k")).mapInArrow(trimmed(run), "node long, shingles binary")


def _only(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sets of the given nodes, before they are shuffled if the list of nodes is short."""
    few = nodes.distinct()
    return sets.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, "node", "left_semi")


def _verify(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of the given (a, b) whose sets link, by exact intersection; a stored table.

    A set may be there twice, from rows that repeat an id and a text: its links are then given twice.
    """
    # Leaders are on side a: many pairs of one leader meet its set as two numbers each, and go on dealt out by b.
    pairs = pairs.select("a", "b")
    a, b = (_only(sets, pairs.select(F.col(side).alias("node"))) for side in ("a", "b"))
    both = pairs.join(a.withColumnsRenamed({"node": "a", "shingles": "x"}), "a").join(b.withColumnsRenamed({"node": "b", "shingles": "y"}), "b")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * same >= percent * (len(x) + len(y) - same))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["u", "v"])

    return cut(both.select("a", "b", "x", "y").mapInArrow(trimmed(run), "u long, v long"))


def _tagged(lists: DataFrame, label: DataFrame | None) -> DataFrame:
    """token, node, idx, size, component of every posting."""
    low = (1 << 32) - 1
    tagged = lists.select("token", "node", F.col("place").bitwiseAND(low).alias("idx"), F.shiftright("place", 32).alias("size"))
    return _labelled(tagged, label)


def _led(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, node, component) with each list's leader first: (a, b) of a leader and every node of another component."""
    token = node = component = None  # of the open list and its leader
    for b in rows:
        t, n, c = (b.column(i).to_numpy() for i in range(3))
        if not len(t):
            continue
        first = np.append(t[0] != token, t[1:] != t[:-1])
        at = np.maximum.accumulate(np.where(first, np.arange(len(t)), -1))
        lead, own = n[at], c[at]  # before the first new list of the batch the open one goes on
        if token is not None:
            lead, own = np.where(at < 0, node, lead), np.where(at < 0, component, own)
        keep = own != c
        token, node, component = t[-1], lead[-1], own[-1]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(lead[keep]), pa.array(n[keep])], ["a", "b"])


def _overlap(percent: int) -> Column:
    """Least overlap of sets of a_size and b_size that link."""
    return F.floor(((F.col("a_size") + F.col("b_size")) * percent + 99 + percent) / (100 + percent))


def _passes(percent: int) -> Column:
    """Lengths and the last shared positions of a and b still allow the overlap that a link needs."""
    return F.col("shared") + F.least(F.col("a_size") - F.col("a_last"), F.col("b_size") - F.col("b_last")) >= _overlap(percent)


def _alike(percent: int) -> Column:
    """Sizes and signatures of a and b (their columns begin with a_ and b_) allow a link."""
    sizes = F.least("a_size", "b_size") * 100 >= F.greatest("a_size", "b_size") * percent
    differ = sum((F.bit_count(F.col(f"a_{g}").bitwiseXOR(F.col(f"b_{g}"))) for g in SIGNATURE[1:]), F.bit_count(F.col(f"a_{SIGNATURE[0]}").bitwiseXOR(F.col(f"b_{SIGNATURE[0]}"))))
    return sizes & (differ <= F.col("a_size") + F.col("b_size") - 2 * _overlap(percent))


def _wide_room(percent: int) -> Column:
    """Wide bitmaps of a and b allow a link; those of different width are left to `_wide_alike`, which folds them."""
    differ = F.aggregate(F.zip_with("a_wide", "b_wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    same = F.col("a_wide").isNotNull() & F.col("b_wide").isNotNull() & (F.size("a_wide") == F.size("b_wide"))
    return F.when(same, differ <= F.col("a_size") + F.col("b_size") - 2 * _overlap(percent)).otherwise(True)


def _sided(nodes: DataFrame, side: str, *more: str) -> DataFrame:
    """Columns of nodes under the names of one side of a pair: a, a_size, a_g0 and so on."""
    return nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("size", *SIGNATURE, *more)])


def _best_leaders(tagged: DataFrame, nodes: DataFrame, tried: DataFrame | None, salt: int, percent: int) -> DataFrame:
    """(a, b, alike): for each node the leaders of other components that it shares most lists with, of those not tried.

    Several, as a passage that many documents share gives a node lists that other documents lead.
    """
    parts = shuffle_parts(tagged.sparkSession)
    dealt = tagged.select("token", "node", "component").repartition(parts, "token").sortWithinPartitions("token", F.xxhash64("node", F.lit(salt)), "node")
    pairs = dealt.mapInArrow(trimmed(_led), "a long, b long").groupBy("a", "b").agg(F.count("*").alias("shared"))
    if tried is not None:
        pairs = pairs.join(tried.union(tried.select("b", "a")), ["a", "b"], "left_anti")
    best = pairs.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("shared", "a")), False), 1, LEADERS).alias("best"))  # as many as the node has lists, at most
    best = best.select(F.explode("best.a").alias("a"), "b")
    return best.join(_sided(nodes, "a"), "a").join(_sided(nodes, "b"), "b").select("a", "b", _alike(percent).alias("alike"))


def _labelled(rows: DataFrame, label: DataFrame | None) -> DataFrame:
    """`rows` of nodes with their component, the node itself without a link."""
    if label is None:
        return rows.withColumn("component", F.col("node"))
    return rows.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _kept(lists: DataFrame, label: DataFrame | None, percent: int) -> DataFrame:
    """`_merged` lists of the nodes that are left between components, each with the prefix length of its own choice."""
    tagged = _tagged(lists, label)
    open_ = tagged.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("df")).where("lo <> hi").select("token", "df")
    live = cut(tagged.join(open_, "token"))
    t = needed(F.col("size"), percent)
    spare = F.col("size") - t
    reads = [F.sum(F.when(F.col("idx") <= spare + k, F.col("df") - 1).otherwise(0)) for k in range(1, MAX_MATCHES + 1)]
    costs = F.array(*[F.struct((r + r * VERIFY_COST / k).alias("cost"), F.lit(k).alias("l")) for k, r in enumerate(reads, 1)])
    chosen = live.groupBy("node", "size").agg(F.array_min(costs)["l"].alias("l")).select("node", F.least("l", t).cast("int").alias("l"))
    kept = cut(_merged(live.join(chosen, "node").where(F.col("idx") <= spare + F.col("l")).select("token", "node", "idx", "component", "l")))
    discard(live)
    return kept


def _open(kept: DataFrame, label: DataFrame | None) -> DataFrame:
    """`kept` with the components of now, those lists that have several, with their `major` one and number of nodes `n`.

    Nodes of different components have all their lists left, as these are in lists of several components.
    """
    now = _labelled(kept.drop("component"), label)
    parts = now.groupBy("s1", "s2", "component").agg(F.count("*").alias("n"))
    major = parts.groupBy("s1", "s2").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    return now.join(major, ["s1", "s2"])


def _cross(kept: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b, shared): the candidate pairs left between components of `_open` lists."""
    return cut(
        _meetings(kept, nodes, percent).groupBy("a", "b")
        .agg(F.sum("many").alias("shared"), F.first("l").alias("l"), *[f(c).alias(c) for f, c in ((F.max, "a_last"), (F.max, "b_last"), (F.first, "a_size"), (F.first, "b_size"))])
        .where((F.col("shared") >= F.col("l")) & _passes(percent)).select("a", "b", "shared")
    )


def _nearest_of(percent: int):
    """Rows (s1, s2, window, node, component, size, g0 to g7), windows together: (a, b) of each node and the most alike of another component in its window."""

    def found(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
        node, component, size = rows[3:6]
        if len(node) < 2 or (component == component[0]).all():
            return None
        room = size[:, None] + size
        limit = room - 2 * ((room * percent + 99 + percent) // (100 + percent))
        differ = sum((np.bitwise_count((g[:, None] ^ g).view(np.uint64)) for g in rows[6:]), np.zeros(limit.shape, np.uint16))
        ok = (differ <= limit) & (component[:, None] != component) & (np.minimum(size[:, None], size) * 100 >= np.maximum(size[:, None], size) * percent)
        score = np.where(ok, differ / room, 2.0)
        best = score.argmin(1)
        at = np.flatnonzero(score[np.arange(len(node)), best] < 2)
        return (np.minimum(node[at], node[best[at]]), np.maximum(node[at], node[best[at]])) if len(at) else None

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # parts of the open window

        def closed(parts):
            rows = [np.concatenate(c) for c in zip(*parts, strict=True)]
            for a in range(0, len(rows[0]), 2 * WINDOW):  # windows are of about WINDOW
                pairs = found([c[a : a + 2 * WINDOW] for c in rows])
                if pairs is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], ["a", "b"])

        for b in batches:
            if not len(b):
                continue
            cols = [b.column(i).to_numpy() for i in range(b.num_columns)]
            bound = np.flatnonzero(np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:3]])))
            for a, z in zip(bound, np.append(bound[1:], len(b)), strict=True):
                if held and any(h[-1] != c[a] for h, c in zip(held[-1][:3], cols, strict=False)):
                    yield from closed(held)
                    held = []
                held.append([c[a:z] for c in cols])
        if held:
            yield from closed(held)

    return run


def _nearest(kept: DataFrame, nodes: DataFrame, salt: int, percent: int) -> DataFrame:
    """(a, b, shared): pairs of components, each node with the most alike in its windows of `_open` lists, and in how many it is.

    A list has windows of about WINDOW nodes, other ones in each round, so the rows grow with the lists only.
    """
    window = F.pmod(F.xxhash64("node", F.lit(salt)), F.ceil(F.col("n") / WINDOW))
    signed_ = F.broadcast(nodes) if nodes.count() <= SIGNED_ROWS else nodes
    rows = kept.select("s1", "s2", window.alias("window"), "node", "component").join(signed_.select("node", "size", *SIGNATURE), "node")
    dealt = rows.select("s1", "s2", "window", "node", "component", "size", *SIGNATURE).repartition(shuffle_parts(kept.sparkSession), "s1", "s2", "window").sortWithinPartitions("s1", "s2", "window")
    return dealt.mapInArrow(trimmed(_nearest_of(percent)), "a long, b long").groupBy("a", "b").agg(F.count("*").alias("shared"))


def _wide_alike(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that the wide bitmaps allow to link; a stored table."""
    wide = nodes.where("wide is not null").select("node", "size", "wide")
    a, b = (wide.select(F.col("node").alias(x), F.col("size").alias(f"{x}_size"), F.col("wide").alias(f"{x}_wide")) for x in ("a", "b"))
    both = pairs.select("a", "b").join(a, "a", "left").join(b, "b", "left")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(len(b), bool)
            limit, x, y = b.column(2).to_pylist(), b.column(3), b.column(4)
            for i in np.flatnonzero(np.asarray(x.is_valid()) & np.asarray(y.is_valid())).tolist():
                keep[i] = differing(x[i].values.to_numpy(), y[i].values.to_numpy()) <= limit[i]
            yield b.select(["a", "b"]).filter(pa.array(keep))

    limit = F.col("a_size") + F.col("b_size") - 2 * _overlap(percent)
    return cut(both.select("a", "b", limit.alias("most"), "a_wide", "b_wide").mapInArrow(trimmed(run), "a long, b long"))


def _merged(kept: DataFrame) -> DataFrame:
    """s1, s2, node, many, idx, component, l: lists of the same nodes as one, with their number and each node's first place.

    A passage or a copy gives all its shingles the same nodes, so that a pair would meet once for each of them. Lists
    are told apart by two hashes of their nodes, 128 bits; those of one component are left out.
    """
    same = kept.groupBy("token").agg(F.bit_xor(F.xxhash64("node")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("s2"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    return kept.join(same.where("lo <> hi").select("token", "s1", "s2"), "token").groupBy("s1", "s2", "node").agg(F.count("*").alias("many"), F.min("idx").alias("idx"), F.first("component").alias("component"), F.first("l").alias("l"))


def _meetings(kept: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """A row for each merged list in which a pair of different components meets, if its first shingle is among their first l and they may link."""
    some = F.broadcast(nodes) if nodes.count() <= SIGNED_ROWS else nodes
    wide = [c for c in nodes.columns if c == "wide"]
    x = kept.where("component <> major").select("s1", "s2", F.col("node").alias("a"), F.col("idx").alias("ai"), F.col("component").alias("ac"), F.col("l").alias("al")).join(_sided(some, "a", *wide), "a")
    y = kept.select("s1", "s2", "many", F.col("node").alias("b"), F.col("idx").alias("bi"), F.col("component").alias("bc"), F.col("l").alias("bl"), "major").join(_sided(some, "b", *wide), "b")
    need, l = _overlap(percent), F.least("al", "bl")
    # Before the l-th shared shingle of a pair that links there are no more others than their difference allows,
    # and after it there is room for the overlap that the pair needs. Shingles have one order in all sets, so those
    # of lists that are left out stand after the first of every list that is kept.
    room = l + F.least(F.col("a_size") - F.col("ai"), F.col("b_size") - F.col("bi")) >= need
    early = F.col("ai") + F.col("bi") <= F.col("a_size") + F.col("b_size") - 2 * need + 2 * l
    once = (F.col("bc") == F.col("major")) | (F.col("a") < F.col("b"))

    def side(low: str, high: str) -> Column:
        return F.when(F.col("a") < F.col("b"), F.col(low)).otherwise(F.col(high))

    return x.join(y, ["s1", "s2"]).where((F.col("ac") != F.col("bc")) & once & room & early & _alike(percent) & (_wide_room(percent) if wide else F.lit(True))).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), l.alias("l"), "many",
        side("ai", "bi").alias("a_last"), side("bi", "ai").alias("b_last"), side("a_size", "b_size").alias("a_size"), side("b_size", "a_size").alias("b_size"),
    )


def _between(pairs: DataFrame, label: DataFrame | None) -> DataFrame:
    """Pairs (a, b, shared) of different components, with these as ac and bc."""
    for side in ("a", "b"):
        if label is not None:
            pairs = pairs.join(label.select(F.col("node").alias(side), F.col("component").alias(f"{side}c")), side, "left")
        pairs = pairs.withColumn(f"{side}c", F.coalesce(f"{side}c", side) if label is not None else F.col(side))
    return pairs.where("ac <> bc")


def _foremost(pairs: DataFrame) -> DataFrame:
    """(a, b): of pairs between components the LEADERS of each component that share most."""
    ends = pairs.select("a", "b", "shared", F.col("ac").alias("own")).union(pairs.select("a", "b", "shared", "bc"))
    rank = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("shared"), "a", "b"))
    return ends.withColumn("rank", rank).where(F.col("rank") <= LEADERS).select("a", "b").distinct()


def _relabelled(links: DataFrame, old: DataFrame | None) -> DataFrame:
    """(node, component) after new links, of which those between components of before count only."""
    if old is None:
        return cut(components(links))
    joined = _between(links.select(F.col("u").alias("a"), F.col("v").alias("b")), old).select(F.col("ac").alias("u"), F.col("bc").alias("v"))
    moved = components(joined)
    ends = old.select("node", F.col("component").alias("was")).union(moved.join(old, "node", "left_anti").select("node", F.col("node").alias("was")))
    label = cut(ends.join(moved.select(F.col("node").alias("was"), "component"), "was", "left").select("node", F.coalesce("component", "was").alias("component")))
    discard(old)
    return label


def near_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links of `percent` or more), text_hash, group.

    `group` tells components apart where ids are repeated or null; it is null without shingles.

    A text without words, or null, has no shingles and stands alone. Copies and texts of equal shingle
    sets are linked if they have a shingle. Repeated rows are returned each; a row whose doc_id is null
    never names a component unless all of its component are null. Empty tables give an empty result, and
    other columns are ignored.
    """
    spark = docs.sparkSession
    seen = cut(_nodes_and_tokens(docs))
    order = spark.sparkContext.broadcast(_common(seen.where("token is not null").select("token", "n")))
    base = seen.where("token is null").drop("token", "n")
    renamed = _clashes(base)
    if renamed:
        again = F.create_map(*[F.lit(x) for (n, c), new in renamed.items() for x in (f"{n} {c}", new)])
        base = base.withColumn("node", F.coalesce(again[F.concat_ws(" ", "node", "node_check")], "node"))
    postings = _postings(docs, order, percent, renamed)
    lists = cut(postings.repartition(shuffle_parts(spark), "token").sortWithinPartitions("token", "node").mapInArrow(trimmed(_shared), "token long, node long, place long"))
    first = F.min(F.struct("doc_id", "text_hash"))  # any row of a node will do
    same = [F.first(c).alias("size" if c == "n_shingles" else c) for c in ("n_shingles", *SIGNATURE, "wide")]
    nodes = cut(base.join(lists.select("node").distinct(), "node").groupBy("node").agg(first.alias("row"), *same).select("node", "size", *SIGNATURE, "wide", "row.*"))
    tried, label = None, None

    def linked_pairs(pairs: DataFrame) -> DataFrame:
        """Those of the given pairs that link. Only the rows of their nodes are cut into sets, which are stored until then."""
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        sets = cut(_sets(docs, nodes.join(ends, "node", "left_semi").select("node", "doc_id", "text_hash"), renamed))
        found = _verify(sets, pairs, percent)
        discard(sets)
        return found

    for salt in count():
        best = cut(_best_leaders(_tagged(lists, label), nodes, tried, salt, percent))
        found = linked_pairs(_wide_alike(best.where("alike"), nodes, percent))
        asked, linked = best.count(), found.count()
        tried = best.drop("alike") if tried is None else tried.unionByName(best.drop("alike"))
        if linked:
            label = _relabelled(found, label)
        if linked * WORTH <= asked:
            break
    kept = _kept(lists, label, percent)
    discard(lists)
    for salt in count():
        # Of the pairs between two components the foremost are held against each other first.
        pairs = cut(_nearest(_open(kept, label), nodes, salt, percent).join(tried.union(tried.select("b", "a")), ["a", "b"], "left_anti"))
        foremost = cut(_foremost(_between(pairs, label)))
        discard(pairs)
        tried = tried.unionByName(foremost)
        likely = _wide_alike(foremost, nodes, percent)
        asked = likely.count()
        found = linked_pairs(likely) if asked else None
        linked = found.count() if asked else 0
        if linked:
            label = _relabelled(found, label)
        if linked * NEAREST_WORTH <= asked:
            break
    cross = cut(_cross(_open(kept, label), nodes, percent).join(tried.union(tried.select("b", "a")), ["a", "b"], "left_anti"))
    discard(kept)
    if not cross.isEmpty():
        label = _relabelled(linked_pairs(_wide_alike(cross, nodes, percent)), label)
    discard(cross, nodes)
    named = base.select("doc_id", "n_shingles", "node", "text_hash")
    named = named.withColumn("component", F.lit(None).cast("long")) if label is None else named.join(label, "node", "left")
    named = named.withColumn("group", F.coalesce("component", "node"))
    least = named.where("node is not null").groupBy("group").agg(F.min("doc_id").alias("least"))
    # Groups may be large: the least doc_id of each is joined back, a skewed join that can be split.
    return named.join(least, "group", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), "text_hash", "group")
