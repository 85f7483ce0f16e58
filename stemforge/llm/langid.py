"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it.

Features are square roots of hashed byte-trigram shares of the whole text. The models are small
matrices, fitted on the driver from a bounded, balanced sample of labelled rows (`sample` rows over all
languages, chosen by a hash of their text); every row is then scored on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, slabs, trimmed

DIMS = 4096
#: Most labelled rows that the classifiers are fitted on.
SAMPLE_ROWS = 3000
UNDETERMINED = "und"

# Language families by ISO 639-1 code; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk",
    "semitic": "ar he am mt",
    "indic": "hi bn mr gu pa ne ur si",
    "iranian": "fa ps ku tg",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def family(lang: str) -> str:
    return _FAMILY_OF.get(lang, f"of {lang}")


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of DIMS a text; rows have length 1, or 0 for an empty text."""
    n = len(offs) - 1
    out = np.zeros((n, DIMS), np.float32)
    x = _CLASS[data].astype(np.uint32)
    if len(x) >= 3:
        y = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
        y = ((y ^ (y >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(20)
    for i in range(n):
        a, b = int(offs[i]), int(offs[i + 1]) - 2
        if b > a:
            out[i] = np.bincount(y[a:b], minlength=DIMS)
        elif offs[i + 1] > a:  # under three bytes: one feature of the bytes there are
            out[i, int(x[a : offs[i + 1]].sum()) % DIMS] = 1
    np.sqrt(out, out=out)
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))
    out /= np.maximum(norm, 1e-9)[:, None]
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 4.0, epochs: int = 12) -> np.ndarray:
    """Linear SVM with squared hinge loss by dual coordinate descent; y is 1 or -1; the bias is last."""
    n, d = x.shape
    w = np.zeros(d + 1, np.float64)
    alpha = np.zeros(n)
    q = np.einsum("ij,ij->i", x, x) + 1 + 1 / (2 * c)
    order = np.arange(n)
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            g = y[i] * (x[i] @ w[:d] + w[d]) - 1 + alpha[i] / (2 * c)
            if alpha[i] == 0 and g >= 0:
                continue
            new = max(alpha[i] - g / q[i], 0)
            step = (new - alpha[i]) * y[i]
            alpha[i] = new
            w[:d] += step * x[i]
            w[d] += step
    return w


class OneVsOne:
    """A linear SVM for each pair of classes; most votes win, then the sum of margins."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.classes = sorted(set(labels.tolist()))
        self.pairs = [(i, j) for i in range(len(self.classes)) for j in range(i + 1, len(self.classes))]
        rows = []
        for i, j in self.pairs:
            at = np.isin(labels, [self.classes[i], self.classes[j]])
            rows.append(fit_svm(x[at], np.where(labels[at] == self.classes[i], 1.0, -1.0)))
        self.w = np.array(rows, np.float32).reshape(len(self.pairs), x.shape[1] + 1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class index, probability-like score of it) of each row."""
        votes = np.zeros((len(x), len(self.classes)))
        least = np.full((len(x), len(self.classes)), np.inf)
        m = x @ self.w[:, :-1].T + self.w[:, -1]
        for k, (i, j) in enumerate(self.pairs):
            s = m[:, k]
            votes[:, i] += (s >= 0) + np.tanh(s) / 1000
            votes[:, j] += (s < 0) - np.tanh(s) / 1000
            least[:, i] = np.minimum(least[:, i], s)
            least[:, j] = np.minimum(least[:, j], -s)
        best = votes.argmax(1)
        margin = least[np.arange(len(x)), best]
        return best, 1 / (1 + np.exp(-2 * np.clip(margin, -30, 30)))


class LanguageModel:
    def __init__(self, x: np.ndarray, langs: list[str]):
        labels = np.array(langs, object)
        fams = np.array([family(v) for v in langs], object)
        self.families = OneVsOne(x, fams) if langs else None
        self.within = {f: OneVsOne(x[fams == f], labels[fams == f]) for f in sorted(set(fams.tolist()))}

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        out, score = [UNDETERMINED] * len(x), np.zeros(len(x))
        if self.families is None or not len(x):
            return out, score
        fam, p = self.families.predict(x)
        for k, f in enumerate(self.families.classes):
            at = np.flatnonzero(fam == k)
            if len(at):
                best, q = self.within[f].predict(x[at])
                score[at] = p[at] * q
                for i, b in zip(at.tolist(), best.tolist(), strict=True):
                    out[i] = self.within[f].classes[b]
        return out, score


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, trainable: Column, sample: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on at most `sample` distinct labelled texts with a letter, the same number of each language if it has as many.

    The texts of least hash are drawn among the distinct ones of their language, so copies and texts without a
    letter change nothing, a quota of q gives q texts wherever there are as many, and no language is lost, but
    for those beyond the `sample` languages of most texts.
    """
    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    rows = docs.where(trainable & F.col("lang").isNotNull()).select(lang.alias("lang"), text.alias("text")).where(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    keys = cut(rows.select("lang", "h").distinct())
    counts = keys.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample)
    each = max(1, sample // max(1, counts.count()))
    first = keys.join(F.broadcast(counts.select("lang")), "lang").withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("i") <= each)
    drawn = rows.join(F.broadcast(first.select("lang", "h")), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))  # `sample` rows at most

    def run(batches):
        for b in batches:
            for a, z, data, offs in slabs(b, "text"):
                x = features(data, offs).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    got = drawn.select("lang", "text").mapInArrow(run, "lang string, x binary").orderBy("lang", "x").toArrow()
    discard(keys)
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(-1, DIMS).astype(np.float32)
    return LanguageModel(x, got.column("lang").to_pylist())


def _predict(m: LanguageModel, b: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, list[str], np.ndarray, np.ndarray]]:
    """Predictions of each slab of a batch: (first row, end row, languages, scores, whether there is a letter)."""
    at = b.schema.get_field_index(column)
    for a, z, data, offs in slabs(b, column):
        langs, score = m.predict(features(data, offs))
        letters = ((data | 32) >= 97) & ((data | 32) <= 122)
        some = np.concatenate([[0], np.cumsum(letters)])[offs]
        lettered = some[1:] > some[:-1]
        for i in np.flatnonzero(~lettered).tolist():
            lettered[i] = has_letter(b.column(at)[a + i].as_py())
            if not lettered[i]:
                langs[i], score[i] = UNDETERMINED, 0.0
        yield a, z, langs, score, lettered


def classify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score: predicted from the text alone.

    A text that is null or has no letter is `und` with score 0, and so is every text if nothing was
    learned. Equal texts get equal predictions; a null doc_id is not held out; empty tables give an
    empty result; columns other than doc_id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, langs, score, _ in _predict(shared.value, b, "text"):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), b.column(1).slice(a, z - a), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(run), "doc_id long, held_out boolean, lang_pred string, score double")


def determined(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of `docs`, all columns as they are, with a letter to tell a language by.

    The operator rejects what has no letter: those rows and null texts go, whatever was learned. A fitted
    model gives every text with letters one of its languages, and none of them is unwanted. Repeated rows
    share their fate; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, _, _, lettered in _predict(shared.value, b, "text"):
                yield b.slice(a, z - a).filter(pa.array(lettered, pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
