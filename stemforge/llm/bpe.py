"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's adjacent pairs are the leaves of a tree that holds the least key (rank, position) of each
subtree, so the root is the leftmost pair of lowest rank. A merge changes three leaves; each change
walks one path to the root. Many words are merged side by side, one tree a word, in numpy.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import trim, trimmed
from .textkit import same_bytes, word_keys

# The word pattern of the tokenizer file, and the white space that its normaliser collapses.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACES = [9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Characters encoded at once, which take some 25 times as many bytes; a longer single text is a group of its own.
GROUP_CHARS = 1_000_000
#: Distinct words remembered by a worker; all are forgotten when it is full.
KNOWN_WORDS = 1_000_000
#: Words found by one look are so many powers of two at most.
SLOT_BITS = 19


def byte_chars() -> list[str]:
    """The printable stand-in of each byte value in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class PairTable:
    """Open-addressing table of merge pairs: ranks of many pairs at once."""

    def __init__(self, pairs: np.ndarray):
        self.bits = max(4, int(len(pairs) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.zeros(1 << self.bits, np.int64)
        todo = np.arange(len(pairs))
        slot = self._slot(pairs)
        while len(todo):  # the first of those that want a free slot gets it, the others step on
            free = self.keys[slot] < 0
            self.keys[slot[free]] = pairs[todo[free]]
            won = self.keys[slot] == pairs[todo]
            self.ranks[slot[won]] = todo[won]
            todo, slot = todo[~won], (slot[~won] + 1) & (len(self.keys) - 1)

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where no merge exists."""
        pairs = (left.astype(np.int64) << 20) | right
        slot = self._slot(pairs)
        out = np.full(len(pairs), -1, np.int64)
        found = self.keys[slot]
        hit = found == pairs
        out[hit] = self.ranks[slot[hit]]
        todo = np.flatnonzero(~hit & (found >= 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & (len(self.keys) - 1)
            found = self.keys[slot]
            hit = found == pairs[todo]
            out[todo[hit]] = self.ranks[slot[hit]]
            more = ~hit & (found >= 0)
            todo, slot = todo[more], slot[more]
        return out


class SegmentTreeBPE:
    """Encoder and decoder for a word-end BPE file of the `tokenizers` library."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        chars = byte_chars()
        self.first = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + end] for c in chars], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]]
        p = np.array(pairs, np.int64)
        self.merged = p[:, 2].copy()
        self.table = PairTable((p[:, 0] << 20) | p[:, 1])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    # --- merging -------------------------------------------------------------------------------

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, bounds of each word's ids): trees of one size are worked side by side."""
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = np.array([len(w) for w in words], np.int64)
        width = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64))
        for m in np.unique(width):
            at = np.flatnonzero(width == m)
            step = max(1, (1 << 20) // int(m))
            for a in range(0, len(at), step):
                some = at[a : a + step]
                parts.append((some, *self._merge([words[i] for i in some.tolist()], size[some], int(m))))
        count = np.zeros(len(words) + 1, np.int64)
        for some, n, _ in parts:
            count[some + 1] = n
        bound = np.cumsum(count)
        flat = np.empty(int(bound[-1]), np.int32)
        for some, n, ids in parts:
            flat[np.repeat(bound[some] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return flat, bound

    def _merge(self, words: list[bytes], size: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        n, w = len(words), m + 1  # slot m of each row stands for "no neighbour"
        kind = np.int32 if m <= 8192 else np.int64  # a key is rank * m + position
        big = np.iinfo(kind).max
        raw = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        sym = np.full((n, w), -1, np.int32)
        row = np.repeat(np.arange(n), size)
        sym[row, np.arange(len(raw)) - np.repeat(start, size)] = self.first[raw]
        sym[np.arange(n), size - 1] = self.last[raw[start + size - 1]]
        nxt = np.tile(np.minimum(np.arange(1, w + 1, dtype=np.int32), m), (n, 1))
        nxt[np.arange(n), size - 1] = m
        prv = np.tile(np.arange(-1, m, dtype=np.int32), (n, 1))
        prv[:, 0] = m
        tree = np.full((n, 2 * m), big, kind)
        left, right = sym[:, : m - 1], sym[:, 1:m]
        r, c = np.nonzero(right >= 0)
        rank = self.table.rank(left[r, c], right[r, c])
        ok = rank >= 0
        tree[r[ok], m + c[ok]] = rank[ok] * m + c[ok]
        level = m
        while level > 1:
            half = level >> 1
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        symf, nxtf, prvf, tf = sym.ravel(), nxt.ravel(), prv.ravel(), tree.ravel()
        lanes = np.arange(n)
        while True:
            root = tf[lanes * (2 * m) + 1]
            live = root < big
            lanes, root = lanes[live], root[live]
            if not len(lanes):
                break
            i = root % m
            base, tb = lanes * w, lanes * (2 * m)
            j = nxtf[base + i]
            k = nxtf[base + j]
            symf[base + i] = self.merged[root // m]
            symf[base + j] = -1
            nxtf[base + i] = k
            inner = k < m
            prvf[(base + k)[inner]] = i[inner]
            self._update(tf, tb, m, j, np.full(len(j), big, kind))
            self._update(tf, tb, m, i, self._keys(symf, base, i, k, m))
            p = prvf[base + i]
            has = p < m
            self._update(tf, tb[has], m, p[has], self._keys(symf, base[has], p[has], i[has], m))
        keep = sym[:, :m] >= 0
        return keep.sum(1), sym[:, :m][keep]

    def _keys(self, symf: np.ndarray, base: np.ndarray, left: np.ndarray, right: np.ndarray, m: int) -> np.ndarray:
        out = np.full(len(left), np.iinfo(symf.dtype if m <= 8192 else np.int64).max, symf.dtype if m <= 8192 else np.int64)
        ok = np.flatnonzero(right < m)
        rank = self.table.rank(symf[base[ok] + left[ok]], symf[base[ok] + right[ok]])
        good = rank >= 0
        out[ok[good]] = rank[good] * m + left[ok[good]]
        return out

    @staticmethod
    def _update(tf: np.ndarray, tb: np.ndarray, m: int, leaf: np.ndarray, key: np.ndarray) -> None:
        """Point update: set the leaf, then renew the minimum on its path to the root."""
        node = leaf + m
        tf[tb + node] = key
        while m > 1:
            key = np.minimum(key, tf[tb + (node ^ 1)])
            node = node >> 1
            tf[tb + node] = key
            m >>= 1

    # --- text ----------------------------------------------------------------------------------

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.merge_words([w.encode() for w in words])

    def encode_slow(self, text: str) -> list[int]:
        """One text, with special tokens that stand in it."""
        out: list[int] = []
        for part in self.split_special.split(text) if self.split_special else (text,):
            if part in self.special:
                out.append(self.special[part])
            elif words := WORD.findall(normal(part)):
                out += self.word_ids(words)[0].tolist()
        return out

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text's ids)."""
        odd = {i: np.array(self.encode_slow(t), np.int32) for i, t in enumerate(texts) if "<|" in t and self.split_special and self.split_special.search(t)}
        plain = [normal(t).encode("utf-8", "replace") if i not in odd else b"" for i, t in enumerate(texts)]
        size = np.fromiter(map(len, plain), np.int64, len(plain))
        joined = b"\n".join(plain)
        raw = np.frombuffer(joined, np.uint8)
        start, end = pretokens(raw, byte_classes(joined))
        doc_start = np.concatenate([[0], np.cumsum(size + 1)])
        first, n_of = self._lookup(raw, start, end)
        ends = np.concatenate([[0], np.cumsum(n_of)])
        ids_of = np.repeat(first - ends[:-1], n_of)
        ids_of += np.arange(len(ids_of))
        flat = self.pool.take(ids_of)
        bound = ends[np.searchsorted(start, doc_start)]
        for i in sorted(odd, reverse=True):
            flat = np.concatenate([flat[: bound[i]], odd[i], flat[bound[i] :]])
            bound[i + 1 :] += len(odd[i])
        return flat, bound

    pool = np.zeros(0, np.int32)  # ids of all words met
    pool_bound = np.zeros(1, np.int64)
    text = np.zeros(0, np.uint8)  # their bytes
    text_bound = np.zeros(1, np.int64)
    known = np.zeros(0, np.uint64)  # sorted keys, and the words they stand for
    known_at = np.zeros(0, np.int64)

    slot_key = np.zeros(1, np.uint64)  # the word last met of each slot: most words are found here at once
    slot_word = np.zeros(1, np.int32)

    def _lookup(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool each word's ids begin, and how many they are; words not met before are merged and added.

        A key finds a word, and the bytes decide: a word that only shares its key with one in the pool is
        merged on its own.
        """
        if len(self.known) > KNOWN_WORDS or len(self.slot_key) == 1:
            for name in ("pool", "pool_bound", "text", "text_bound", "known", "known_at"):
                setattr(self, name, getattr(SegmentTreeBPE, name))
            self.slot_key, self.slot_word = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int32)
        n = end - start
        key = word_keys(raw, start, end)
        slot = (key >> np.uint64(64 - SLOT_BITS)).view(np.int64)
        which = self.slot_word.take(slot)
        miss = np.flatnonzero(self.slot_key.take(slot) != key)
        if len(miss):
            distinct, first, back = np.unique(key[miss], return_index=True, return_inverse=True)
            at = np.searchsorted(self.known, distinct)
            seen = np.zeros(len(distinct), bool)
            inside = at < len(self.known)
            seen[inside] = self.known[at[inside]] == distinct[inside]
            entry = np.zeros(len(distinct), np.int32)
            entry[seen] = self.known_at[at[seen]]
            new = np.flatnonzero(~seen)
            if len(new):
                entry[new] = self._add(raw, start[miss[first[new]]], n[miss[first[new]]])
                self.known = np.insert(self.known, at[new], distinct[new])
                self.known_at = np.insert(self.known_at, at[new], entry[new])
            which[miss] = entry[back]
            slot = slot[miss[first]]
            self.slot_key[slot], self.slot_word[slot] = distinct, entry
        began = self.text_bound.take(which)
        wrong = self.text_bound.take(which + 1) - began != n
        check = np.flatnonzero((n > 8) & ~wrong)  # shorter words of one length have keys of their own
        wrong[check] = ~same_bytes(raw, start[check], self.text, began[check], n[check])
        if wrong.any():
            which[wrong] = self._add(raw, start[wrong], n[wrong])
        first = self.pool_bound.take(which)
        return first, self.pool_bound.take(which + 1) - first

    def _add(self, raw: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Merge words and put them into the pool; gives their places in it."""
        text = raw[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        cuts = np.cumsum(n).tolist()
        flat = text.tobytes()
        ids, bound = self.merge_words([flat[a:b] for a, b in zip([0, *cuts], cuts, strict=False)])
        place = len(self.pool_bound) - 1 + np.arange(len(n))
        self.pool_bound = np.concatenate([self.pool_bound, bound[1:] + len(self.pool)])
        self.pool = np.concatenate([self.pool, ids])
        self.text_bound = np.concatenate([self.text_bound, np.cumsum(n) + len(self.text)])
        self.text = np.concatenate([self.text, text])
        return place

    def encode(self, text: str) -> list[int]:
        return self.encode_texts([text])[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """As the library decodes without a decoder: token strings with one space between."""
        return " ".join(map(self.token.__getitem__, ids))


def normal(text: str) -> str:
    """NFC, then each character's own lower case (no context rules)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return "".join(c.lower() for c in text) if "\u03a3" in text else text.lower()


# Character classes: 0 white space, 1 letter, 2 number, 3 other.
_class_of = np.zeros(0, np.uint8)


def char_classes() -> np.ndarray:
    """Class of every code point, from the Unicode categories; made once a worker."""
    global _class_of
    if not len(_class_of):
        table = np.full(0x110000, 3, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            if k in "LN":
                table[c] = 1 if k == "L" else 2
        table[SPACES] = 0
        _class_of = table
    return _class_of


def byte_classes(data: bytes) -> np.ndarray:
    """Class of the character that each byte of UTF-8 text belongs to."""
    of = char_classes()
    c = np.frombuffer(data.translate(of[:256].tobytes()), np.uint8).copy()
    raw = np.frombuffer(data, np.uint8)
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        last = len(raw) - 1
        b = [raw[np.minimum(lead + k, last)].astype(np.int32) for k in range(4)]
        tail = [x & 0x3F for x in b]
        three, four = b[0] >= 0xE0, b[0] >= 0xF0
        point = np.where(four, (b[0] & 7) << 18 | tail[1] << 12 | tail[2] << 6 | tail[3], np.where(three, (b[0] & 15) << 12 | tail[1] << 6 | tail[2], (b[0] & 31) << 6 | tail[1]))
        kind = of[np.minimum(point, 0x10FFFF)]
        c[lead] = c[lead + 1] = kind
        c[lead[three] + 2] = kind[three]
        c[lead[four] + 3] = kind[four]
    return c


def pretokens(raw: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds of all words of the pattern: letter runs, single numbers, runs of others, contractions."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.ones(n, bool)
    np.not_equal(c[1:], c[:-1], out=cut[1:])
    cut[1:] |= (c[1:] == 2) & ((raw[1:] & 0xC0) != 0x80)
    start = np.flatnonzero(cut)
    end = np.append(start[1:], n)
    keep = c[start] > 0
    start, end = start[keep], end[keep]
    # A lone apostrophe takes the first letters of the run that follows it.
    ap = np.flatnonzero((raw[start] == 39) & (end - start == 1))
    ap = ap[ap + 1 < len(start)]
    ap = ap[(start[ap + 1] == end[ap]) & (c[end[ap]] == 1)]
    if len(ap):
        a = raw[end[ap]]
        b = raw[np.minimum(end[ap] + 1, n - 1)]
        long = end[ap + 1] - start[ap + 1] > 1
        take = np.where(np.isin(a, [ord(x) for x in "stmd"]), 1, 0)
        for x, y in ("re", "ve", "ll"):
            take[(a == ord(x)) & (b == ord(y)) & long] = 2
        ap, take = ap[take > 0], take[take > 0]
        end[ap] += take
        start[ap + 1] += take
        left = start < end
        start, end = start[left], end[left]
    return start, end


_models: dict[str, SegmentTreeBPE] = {}


def model(path: str) -> SegmentTreeBPE:
    """The encoder of a tokenizer file, once a worker. A bare name is one of the public tokenizers' folder there."""
    if path not in _models:
        where = path
        if not Path(path).is_absolute():
            import public_tokenizers

            where = public_tokenizers.path(path)
        _models[path] = SegmentTreeBPE(where)
        trim()  # the parsed file
    return _models[path]


def encoded_groups(batch: pa.RecordBatch, path: str, column: int = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Groups of rows of bounded size: (first row, end row, ids of their texts, bounds); null counts as empty."""
    m = model(path)
    col = batch.column(column)
    size = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size)
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(total, total[a] - size[a] + GROUP_CHARS, "right")))
        texts = [t or "" for t in col.slice(a, b - a).to_pylist()]
        yield a, min(b, len(col)), *m.encode_texts(texts)
        a = b


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty: no ids, and the digests are those of the empty string. Long texts are
    encoded whole. Rows are independent: repeated rows give repeated results, a null id stays null, an
    empty table gives an empty result, and other columns are ignored whatever their names.
    """

    def run(batches):
        m = model(path)
        shown = np.array([str(i) for i in range(max(m.token) + 1)], object)
        token = np.array([m.token.get(i, "") for i in range(max(m.token) + 1)], object)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for _, _, ids, bound in encoded_groups(b, path):
                for x, y in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
                    own = ids[x:y]
                    n.append(y - x)
                    ids_sha.append(hashlib.sha256(" ".join(shown[own].tolist()).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(" ".join(token[own].tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(trimmed(run), schema)
