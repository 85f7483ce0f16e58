"""Small document tables with the odd cases that every operator has to take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, digest int, node double, hits string, part string, word int, label string"
EXTRA = ("r", 1, 0.5, "h", "p", 2, "l")


def frame(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang); further columns have names that operators use inside."""
    full = [(i, t, *(lang or [None]), "s", None if t is None else len(t), *EXTRA) for i, t, *lang in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def words(rng, n, vocab=None):
    vocab = vocab or [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "rt", "sch")]
    return " ".join(rng.choice(vocab) for _ in range(n))


def twin_words(n):
    """A word of n letters and its complement, which every polynomial hash modulo 2**64 takes for each other from 1,024 on."""
    swap = str.maketrans("ab", "ba")
    w = "a"
    while len(w) < n:
        w += w.translate(swap)
    return w, w.translate(swap)


def sample(seed=1):
    """Copies, near copies, shared passages, short, empty, null and odd texts; ids with gaps; repeated rows."""
    rng = random.Random(seed)
    base = [words(rng, rng.randint(1, 120)) for _ in range(25)]
    passage = words(rng, 60)
    rows = [(3 * i, t) for i, t in enumerate(base)]
    rows += [(200 + i, t) for i, t in enumerate(base[:6])]
    rows += [(300 + i, t + " " + words(rng, 3)) for i, t in enumerate(base[6:14])]
    rows += [(400 + i, words(rng, 20) + " " + passage + " " + words(rng, 5)) for i in range(6)]
    rows += [(500, ""), (501, None), (502, "  \n\t "), (503, "a"), (504, "A b"), (505, "a B"), (506, "1234 !!"), (507, "ΑΣ ß ñandú <|endoftext|> don't"), (508, passage), (509, passage + passage)]
    rows += [(600, base[0]), (600, base[0]), (None, base[1]), (None, "nowhere else"), (601, "x" * 3000), (602, "ab" * 1500), (603, words(rng, 3000))]
    rows += [(610 + i, w) for i, w in enumerate((*twin_words(1024), *twin_words(4096)))]
    rows += [(620 + i, w + " one two three four") for i, w in enumerate(twin_words(1024))]
    return rows
