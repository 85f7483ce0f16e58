"""Language-model scores: a unigram base and online logistic context mixing.

The mixing model predicts the bits of a text's tokens (its words with a space after each, then an end byte).
Each predictor takes a context (the last one, three or five bytes of the word, or all of it so far; in all of
them the word's start) with the bits of the present byte already known, and looks up how often that bit was 1
over all training documents. The predictions are mixed in the logistic domain with weights that the bit's
position gates, and the weights are refined after every token. Contexts end where the word begins, so each
distinct word of a block is looked up once, with the number of times it stands there. Counts are kept by
context and byte, as many as the input has: blocks of texts send theirs to shards, which add them up and
send back those along the bits of the keys each block has. Weights are carried through a whole document and
start anew with the next, so scores don't depend on how documents are dealt out.

The base needs the count of every word. Words that make up a 2**-20th of all tokens are a million at
most and are sent to the tasks; counts of rarer ones, which cannot be skewed, are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, row_key, slabs, trimmed
from .textkit import IS_SPACE, LOWER, mix, prefix_sums, signed, span_hash, word_bounds, word_keys

#: A word is common if its count times this is at least the number of training tokens.
COMMON = 1 << 20
#: Bytes in the contexts of the first predictors; the last one has the word so far.
LENGTHS = (1, 3, 5)
ORDERS = len(LENGTHS) + 1
LEARNING_RATE = 0.015
#: The weights of all orders add up to 1.2 at first.
FIRST_WEIGHT = 0.3
#: Text bytes taken apart at once, and documents whose next tokens are scored at once.
SCORE_BYTES = 2 << 20
LANES = 2048
#: Text bytes that ask for context counts together, and those for each shard that answers.
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20
_IS_WORD = ~IS_SPACE
_SPACE, _END = 32, 10


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    low = LOWER[data]
    start, end, doc = word_bounds(low, offs, _IS_WORD)
    return low, start, end, doc


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = row_key(docs, F.col("doc_id").cast("long"), text)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), key.alias("row"), text.alias("text"))


# --- the base -------------------------------------------------------------------------------------


def word_counts(rows: DataFrame) -> DataFrame:
    """(word hash, count) over the texts of `rows`."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted():
            w, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(signed(w)), pa.array(n.astype(np.int64))], ["word", "n"])

        for b in batches:
            for _, _, data, offs in slabs(b):
                low, start, end, _ = _words(data, offs)
                held.append(word_keys(low, start, end))
                size += len(start)
                if size >= 2_000_000:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    return rows.select("text").mapInArrow(trimmed(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


# --- the mixing model -----------------------------------------------------------------------------


class Words:
    """The distinct words of a block of texts, and where its tokens are among them.

    `stream` has each distinct word with a space after it, bounds in `bound`; the last entry is the end byte
    alone. `train` counts each over the training texts. `slabs` has for each slab of rows the batch, first and
    end row, offsets, document of each word and its entry.
    """

    def __init__(self, batches: list[pa.RecordBatch]):
        keys, texts, spans, self.slabs, at = [], [], [], [], 0
        weights = []
        for b in batches:
            for a, z, data, offs in slabs(b, limit=SCORE_BYTES):
                low, start, end, doc = _words(data, offs)
                keys.append(word_keys(low, start, end))
                train = ~np.asarray(b.column("held_out").slice(a, z - a))
                weights.append(train[doc])
                texts.append(low)
                spans.append((start + at, end + at))
                at += len(low)
                self.slabs.append([b, a, z, offs, doc, int(train.sum())])
        key = np.concatenate(keys)
        order = np.argsort(key)
        new = np.append(np.ones(min(len(key), 1), bool), key[order[1:]] != key[order[:-1]])
        first = order[new]  # any place of a word will do
        self.keys, which = key[first], np.empty(len(key), np.int64)
        which[order] = np.cumsum(new) - 1
        start, end = (np.concatenate(x)[first] for x in zip(*spans, strict=True))
        n = len(self.keys)
        self.train = np.append(np.bincount(which, weights=np.concatenate(weights), minlength=n), sum(x[-1] for x in self.slabs)).astype(np.int64)
        self.bound = np.concatenate([[0], np.cumsum(np.append(end - start + 1, 1))])
        self.stream = np.full(int(self.bound[-1]), _SPACE, np.uint8)
        size = end - start
        inner = np.arange(int(size.sum()))
        inner += np.repeat(self.bound[:n] - (np.cumsum(size) - size), size)
        self.stream[inner] = np.concatenate(texts)[inner + np.repeat(start - self.bound[:n], size)]
        self.stream[-1] = _END
        for x, w in zip(self.slabs, np.split(which, np.cumsum([len(k) for k in keys])[:-1]), strict=True):
            x[-1] = w

    def keys_of_bytes(self) -> Iterator[np.ndarray]:
        return keys(self.stream, self.bound)


def keys(s: np.ndarray, bound: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the order, the context and the byte itself of every byte, as one number.

    `bound` has the bounds of the tokens; bytes before a token count as 0. Contexts of bytes are exact, the
    word so far is a hash of 54 bits.
    """
    n = len(s)
    at = np.arange(n) - np.repeat(bound[:-1], np.diff(bound))
    x = s.astype(np.uint64)
    for k in range(max(LENGTHS)):
        x[k + 1 :] |= (s[: n - k - 1] * (at[k + 1 :] > k)).astype(np.uint64) << np.uint64(8 * (k + 1))
        if k + 1 in LENGTHS:
            yield x | np.uint64(LENGTHS.index(k + 1) << 62)
    first = np.arange(n) - at
    x = span_hash(prefix_sums(s), first, np.arange(n)) >> np.uint64(10)
    yield x << np.uint64(8) | s | np.uint64(len(LENGTHS) << 62)


def block_keys(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a block, sorted, how often training texts have them, and the place of each order's and byte's key.

    Where a word is no longer than an order's context, that context is the word so far, and its key is used.
    """
    size = np.diff(words.bound)
    n = np.repeat(words.train, size)
    at = (np.arange(len(words.stream)) - np.repeat(words.bound[:-1], size)).astype(np.int32)
    found, counts, base = [], [], 0
    out = np.empty((ORDERS, len(at)), np.int32)
    orders = words.keys_of_bytes()  # one at a time: each has 8 bytes for every byte of the stream
    for row, k in zip(out, LENGTHS, strict=False):  # keys of a later order are all greater
        far = at >= k
        u, total, place = summed(next(orders)[far], n[far])
        found.append(u)
        counts.append(total)
        row[far] = place + base
        base += len(u)
    u, total, place = summed(next(orders), n)
    out[-1] = place + base
    for row, k in zip(out, LENGTHS, strict=False):
        np.copyto(row, out[-1], where=at < k)
    return np.concatenate([*found, u]), np.concatenate([*counts, total]), out


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sums of their counts, and the place of every key among them."""
    if len(key) and int(key.max()) < 1 << 20:  # few enough to be counted without a sort
        small = key.astype(np.int64)
        there = np.bincount(small) > 0
        rank = np.cumsum(there) - 1
        return np.flatnonzero(there).astype(np.uint64), np.bincount(small, weights=n)[there].astype(np.int64), rank[small]
    if not len(key):
        return key, np.zeros(0, np.int64), np.zeros(0, np.int32)
    order = np.argsort(key)
    rows = key[order]
    first = np.append(True, rows[1:] != rows[:-1])
    u = rows[first]
    del rows
    total = np.add.reduceat(n[order], np.flatnonzero(first), dtype=np.int64)
    place = np.empty(len(key), np.int32)
    place[order] = np.cumsum(first, dtype=np.int32) - 1
    return u, total, place


def dealt(key: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by shard, and bounds of the shards in it; all keys of one context share a shard."""
    shard = (mix(key >> np.uint64(8)) % np.uint64(shards)).astype(np.int64)
    return np.argsort(shard, kind="stable"), np.searchsorted(np.sort(shard), np.arange(shards + 1))


def path_counts(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(keys, 9) for each bit of a key's byte how often its opposite came after the same context and earlier bits, and the key's count.

    Keys are sorted and distinct, so the bytes below one node lie side by side. Numbers have 32 bits if that is enough.
    """
    total = np.concatenate([[0], np.cumsum(n)])
    below = []
    for j in range(9):
        node = key >> np.uint64(8 - j)
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        end = np.append(first[1:], len(key))
        below.append(np.repeat(total[end] - total[first], end - first))
    out = np.stack([below[j] - below[j + 1] for j in range(8)] + [below[8]], 1)
    return out.astype("<u4") if not len(n) or total[-1] < 1 << 32 else out


def path_odds(counts: np.ndarray) -> np.ndarray:
    """(keys, 8) log odds of each bit of a key's byte against its opposite."""
    below = np.cumsum(counts[:, ::-1], axis=1, dtype=np.int64)[:, ::-1]
    return np.log((below[:, 1:] + 0.4) / (counts[:, :8] + 0.4)).astype(np.float32)


def _packed(x: np.ndarray) -> bytes:
    """An array with the first bytes of all numbers before the second ones, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T)
    return pa.compress(planes, codec="zstd", asbytes=True)


def _spread(raw: bytes, kind: str, width: int = 1) -> np.ndarray:
    """The numbers of bytes that `_packed` made, decompressed."""
    planes = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize * width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _unpacked(raw: list[bytes], kind: str) -> list[np.ndarray]:
    return [_spread(pa.CompressedInputStream(pa.BufferReader(x), "zstd").read(), kind) for x in raw]


def texts_of(docs: bytes) -> list[pa.RecordBatch]:
    return list(pa.ipc.open_stream(docs))


def blocks(rows: DataFrame) -> DataFrame:
    """(block, docs): runs of rows with about BLOCK_BYTES of text each, compressed; stored, so that blocks hold."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = n = 0

        def full():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for x in held:
                    out.write_batch(x)
            return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() << 32 | n]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "docs"])

        for b in batches:
            for a, z, data, _ in slabs(b, limit=SCORE_BYTES):
                if size + len(data) > BLOCK_BYTES and held:
                    yield full()
                    held, size, n = [], 0, n + 1
                held.append(b.slice(a, z - a))
                size += len(data)
        if held:
            yield full()

    return cut(rows.mapInArrow(trimmed(run), "block long, docs binary"))


def context_counts(texts: DataFrame, shards: int) -> DataFrame:
    """(block, shard, paths): `path_counts` over all training texts for the keys of each block and shard.

    Blocks send their distinct keys with counts to the shards; a shard adds them up and answers each block
    in the order of its keys. All of it grows with the input, and nothing of it is at one place.
    """

    def ask(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, docs in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                key, n, _ = block_keys(Words(texts_of(docs.as_buffer())))
                order, ends = dealt(key, shards)
                key, n = key[order], n[order].astype("<u4")
                spans = [(i, a, z) for i, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if z > a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(spans), pa.int64()), pa.array([i for i, _, _ in spans], pa.int32())]
                    + [pa.array([_packed(x) for x in col], pa.binary()) for col in ([np.diff(key[a:z], prepend=np.uint64(0)) for _, a, z in spans], [n[a:z] for _, a, z in spans])],
                    ["block", "shard", "keys", "counts"],
                )

    def answer(got: pa.Table) -> pa.Table:
        raw = _unpacked(got.column("keys").to_pylist(), "<u8")
        ends = np.cumsum([0] + [len(x) for x in raw])
        u, n, place = summed(np.concatenate([np.cumsum(x) for x in raw]), np.concatenate(_unpacked(got.column("counts").to_pylist(), "<u4")))
        paths = path_counts(u, n)
        return pa.table([got.column("block"), got.column("shard"), pa.array([_packed(paths[place[a:z]]) for a, z in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["block", "shard", "paths"])

    asks = texts.mapInArrow(trimmed(ask), "block long, shard int, keys binary, counts binary")
    return asks.groupBy("shard").applyInArrow(answer, "block long, shard int, paths binary")


def found_odds(key: np.ndarray, answers: pa.Table, shards: int) -> np.ndarray:
    """The answers of all shards in the order of the block's keys."""
    order, ends = dealt(key, shards)
    out = np.empty((len(key), 8), np.float32)
    asked = np.flatnonzero(np.diff(ends))
    for i, paths in zip(asked.tolist(), answers.sort_by("shard").column("paths"), strict=True):  # one shard's at a time: they have 36 or 72 bytes a key
        raw = pa.CompressedInputStream(pa.BufferReader(paths.as_buffer()), "zstd").read()
        kind = "<u4" if len(raw) == 36 * (ends[i + 1] - ends[i]) else "<i8"
        out[order[ends[i] : ends[i + 1]]] = path_odds(_spread(raw, kind, 9).reshape(-1, 9))
    return out


def log10_scores(token: np.ndarray, bound: np.ndarray, begin: np.ndarray, size: np.ndarray, odds: np.ndarray, place: np.ndarray) -> np.ndarray:
    """log10 probability of each document; documents are scored side by side, token by token.

    `token` has the entries of all documents' tokens, bounds in `bound`. Entry e has `size[e]` bytes, whose
    rows of `odds` (log odds of a byte's bits as they are), one of each order, are in `place` (bytes, orders)
    from `begin[e]` on. Each bit of a byte has weights of its own, so all eight are mixed at once.
    """
    n_docs = len(bound) - 1
    length = np.diff(bound)
    order = np.argsort(-length, kind="stable")
    first, length = bound[:-1][order], length[order]
    place = np.ascontiguousarray(place.T)
    weights = np.full((len(place), n_docs, 8), FIRST_WEIGHT, np.float32)
    total = np.zeros(n_docs, np.float64)
    live = np.searchsorted(-length, -np.arange(int(length[0]) if n_docs else 0), "left")
    rate = np.float32(LEARNING_RATE)
    for t, k in enumerate(live.tolist()):
        for a in range(0, k, LANES):
            e = token[first[a : min(a + LANES, k)] + t]
            n = size[e]
            by = np.argsort(-n, kind="stable")
            e, n, own = e[by], n[by], by + a
            # Longest tokens first; the first bytes of all of them, then the second ones, and so on, lie side by side.
            many = np.searchsorted(-n, -np.arange(n[0]), "left")
            starts = np.cumsum(many) - many
            lane = np.arange(int(starts[-1] + many[-1])) - np.repeat(starts, many)
            rows = begin[e][lane] + np.repeat(np.arange(len(many)), many)
            x = odds.take(place.take(rows, axis=1), axis=0)  # (orders, bytes, 8)
            logit = np.add.reduce(weights.take(own[lane], axis=1) * x, axis=0)
            np.clip(logit, -10, 10, out=logit)
            np.negative(logit, out=logit)
            miss = np.exp(logit, out=logit)
            one = miss + np.float32(1)
            half = one[:, :4] * one[:, 4:]
            half = half[:, :2] * half[:, 2:]
            total[own] -= np.bincount(lane, weights=np.log(half[:, 0] * half[:, 1]), minlength=len(n))  # at most (1 + e**10) ** 8, which a float holds
            miss /= one
            miss *= rate
            x *= miss
            for i, m in zip(starts[1:].tolist(), many[1:].tolist(), strict=True):
                x[:, :m] += x[:, i : i + m]
            weights[:, own] += x[:, : len(n)]
    out = np.empty(n_docs)
    out[order] = total / np.log(10)
    return out


# --- both -----------------------------------------------------------------------------------------


def score(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Trained on the documents that are not held out (a null doc_id never is). A null or empty text is its
    end token alone. Repeated rows count as often as they stand and get equal scores. Without training
    documents all counts are 0. Empty tables give an empty result; extra columns are ignored. bits_per_byte
    is null for an empty text. Words are compared by 64-bit keys; those that make up a `common`-th of all
    tokens are sent to the tasks, the others joined.
    """
    spark = docs.sparkSession
    rows = _rows(docs)
    train = rows.where("not held_out")
    counts = cut(word_counts(train))
    sums = counts.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    ends = train.count()
    n_train = (sums["n"] or 0) + ends
    distinct = sums["v"] + (ends > 0)
    often = counts.where(F.col("n") * common >= n_train).toArrow()  # `common` words at most
    word = often["word"].to_numpy().view(np.uint64)
    by = np.argsort(word)
    shared = spark.sparkContext.broadcast((word[by], often["n"].to_numpy()[by]))
    unit = float(np.log10(n_train + 1.0 * (distinct + 1)))
    shards = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES + 1

    def scored(block: pa.Table, answers: pa.Table) -> pa.Table:
        common_words, n_of = shared.value
        words = Words(texts_of(block.column("docs")[0].as_buffer()))
        key, _, place = block_keys(words)
        odds = found_odds(key, answers, shards)
        log_of = np.zeros(len(words.keys))  # of the common words alone
        hit = np.zeros(len(words.keys), bool)
        if len(common_words):
            at = np.minimum(np.searchsorted(common_words, words.keys), len(common_words) - 1)
            hit = common_words[at] == words.keys
            log_of[hit] = np.log10(n_of[at[hit]] + 1.0)
        out, tokens, sizes = [], [], [np.zeros(1, np.int64)]
        for b, a, z, offs, doc, which in words.slabs:
            n = z - a
            n_words = np.bincount(doc, minlength=n)
            known = np.bincount(doc, weights=hit[which], minlength=n).astype(np.int64)
            base = np.bincount(doc, weights=log_of[which], minlength=n)
            tokens.append(np.insert(which, np.cumsum(n_words), len(words.keys)))  # the end after each document's words
            sizes.append(n_words + 1)
            out.append([b.column(c).slice(a, n) for c in range(3)] + [pa.array(x) for x in (n_words + 1, known, base, np.diff(offs))])
        got = log10_scores(np.concatenate(tokens), np.cumsum(np.concatenate(sizes)), words.bound[:-1], np.diff(words.bound), odds, place.T)
        names = ["doc_id", "held_out", "row", "n_tokens", "common_known", "common_log", "n_bytes"]
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(x, names) for x in out]).append_column("score", pa.array(got))

    def rare(batches) -> Iterator[pa.RecordBatch]:
        words = shared.value[0]
        for b in batches:
            ids = b.column(0).to_numpy()
            for a, z, data, offs in slabs(b):
                low, start, end, doc = _words(data, offs)
                h = word_keys(low, start, end)
                if len(words):
                    miss = words[np.minimum(np.searchsorted(words, h), len(words) - 1)] != h
                    h, doc = h[miss], doc[miss]
                yield pa.RecordBatch.from_arrays([pa.array(signed(h.copy())), pa.array(ids[a:z][doc])], ["word", "row"])

    texts = blocks(rows)
    answered = texts.groupBy("block").cogroup(context_counts(texts, shards).groupBy("block"))
    main = cut(answered.applyInArrow(scored, "doc_id long, held_out boolean, row long, n_tokens long, common_known long, common_log double, n_bytes long, score double"))
    seldom = counts.where(F.col("n") * common < n_train)
    found = rows.select("row", "text").mapInArrow(trimmed(rare), "word long, row long").join(seldom, "word")
    added = found.groupBy("row").agg(F.count("*").alias("known"), F.sum(F.log10(F.col("n") + 1.0)).alias("logs"))
    copies = main.groupBy("row").agg(F.count("*").alias("copies"))  # rows alike have added to one sum
    out = main.join(added, "row", "left").join(copies, "row")
    end_known = F.lit(1 if ends else 0)
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("common_known") + F.coalesce((F.col("known") / F.col("copies")).cast("long"), F.lit(0)) + end_known).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("common_log") + F.coalesce(F.col("logs") / F.col("copies"), F.lit(0.0)) + float(np.log10(ends + 1.0)) - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        "score", "n_bytes", (-F.col("score") * float(np.log2(10)) / F.nullif("n_bytes", F.lit(0))).alias("bits_per_byte"),
    )
