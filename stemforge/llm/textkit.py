"""Vectorised text primitives: word bounds and 64-bit content hashes over whole batches of texts."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_SEED = 20240229

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: White space of the word contracts: space and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of the licence words: digits, lower-case letters, and all of a multi-byte character.
IS_TERM = np.zeros(256, bool)
IS_TERM[48:58] = True
IS_TERM[97:123] = True
IS_TERM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) + U(_SEED))
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64, for i < n."""
    global _pow, _inv
    if len(_pow) < n:
        size = 1 << (n - 1).bit_length()
        inverse = U(pow(int(_BASE), -1, 1 << 64))
        for name, b in (("_pow", _BASE), ("_inv", inverse)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            globals()[name] = p
    return _pow, _inv


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums: content hashes of any substring follow by `span_hash`."""
    p, _ = powers(len(data) + 1)
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * p[: len(data)], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes start..end; equal bytes give equal hashes wherever they stand.

    A polynomial modulo 2**64, for spans of a few hundred bytes: from about a thousand on there are
    patterned strings that any such polynomial takes for each other (`word_keys` does not).
    """
    _, inv = powers(len(h))
    x = h[end] - h[start]
    x *= inv[start]
    x += (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93)
    return mix(x)


#: Words of more bytes are keyed by BLAKE2 instead of a loop over their 8-byte pieces.
_LONG_WORD = 256
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def pieces(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number, zeros after the end; a view of overlapping numbers."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def word_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit keys of words. Words of up to 8 bytes of one length have different keys if they differ.

    Longer ones fold in 8 bytes after 8 by a mixing step that is not linear, so no pattern of letters
    makes two of them alike: unlike a polynomial modulo 2**64, which takes some long words for others
    whatever its base.
    """
    at8, n = pieces(data), end - start
    key = mix((at8[start] & _MASK[np.minimum(n, 8)]) + n.astype(np.uint64) * U(0xD6E8FEB86659FD93))
    more = np.flatnonzero(n > 8)
    for i in more[n[more] > _LONG_WORD].tolist():
        key[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    more = more[n[more] <= _LONG_WORD]
    done = 8
    while len(more):
        left = n[more] - done
        key[more] = mix((key[more] ^ (at8[start[more] + done] & _MASK[np.minimum(left, 8)])) * U(0xA0761D6478BD642F) + U(0xE7037ED1A0B428DB))
        more = more[left > 8]
        done += 8
    return key


def same_bytes(x: np.ndarray, xs: np.ndarray, y: np.ndarray, ys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether n bytes of x from xs on are those of y from ys on, for many pairs."""
    same = np.ones(len(n), bool)
    a, b = pieces(x), pieces(y)
    for i in np.flatnonzero(n > _LONG_WORD).tolist():
        same[i] = np.array_equal(x[xs[i] : xs[i] + n[i]], y[ys[i] : ys[i] + n[i]])
    todo, done = np.flatnonzero(n <= _LONG_WORD), 0
    while len(todo):
        left = n[todo] - done
        mask = _MASK[np.clip(left, 0, 8)]
        same[todo] = (a[xs[todo] + done] & mask) == (b[ys[todo] + done] & mask)
        todo = todo[same[todo] & (left > 8)]
        done += 8
    return same


def word_bounds(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document index) of every maximal run of word bytes; runs end at document bounds."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    starts = np.flatnonzero(w & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:]
    ends = np.flatnonzero(w & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def rolling(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k consecutive words of one document: (index of the first word, hash)."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    x = np.zeros(m, np.uint64)
    q = 1
    for j in range(k):
        x += words[j : j + m] * U(q)
        q = q * 0xD1342543DE82EF95 % (1 << 64)
    at = np.flatnonzero(doc[:m] == doc[k - 1 :])
    return at, mix(x[at] + U(k))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
