"""Each operator against a plain restatement of its contract, on small tables with odd cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from helpers import frame, sample, words
from pyspark.sql import functions as F

from stemforge.llm import bpe, exact_dedup, jaccard, langid, licenses, lm_score, media, packing, substrings, token_files
from stemforge.llm.components import components
from stemforge.llm.queries import TOKENIZER

SPACE = "[^\x20\x09-\x0D]+"


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    return sample()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [(0, "x")]).where("doc_id = 1")


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(TOKENIZER))


def test_media(docs, rows, empty):
    got = media.fingerprint(media.store_wav(docs)).collect()
    assert len(got) == len(rows)
    by_text = collections.defaultdict(set)
    expected = collections.Counter()
    for i, t in rows:
        p = media.pad((t or "").encode())
        assert len(p) % 192 == 0 and len(p) > 0 and media.from_wav(media.to_wav(p)) == p
        expected[(i, len((t or "").encode()), len(p), sha(p), zlib.crc32(p[-16:]), sha(media.to_wav(p)))] += 1
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_sha256"]) for r in got) == expected
    for r in got:
        by_text[r["payload_sha256"]].add(tuple(r["landmarks"]))
    assert all(len(v) == 1 for v in by_text.values()) and any(len(r["landmarks"]) > 3 for r in got)
    assert media.fingerprint(media.store_wav(empty)).count() == 0


def test_landmarks_by_definition():
    """Against a plain restatement: a transform a frame, peaks one by one, pairs one by one."""
    rng = random.Random(11)
    n = media.UNIT
    for size in (1, 30, 400):
        item = media.pad(words(rng, size).encode())
        frames = [item[i * n : (i + 2) * n].ljust(2 * n, bytes([128])) for i in range(len(item) // n)]
        levels, bins = [], []
        for f in frames:
            power = np.abs(np.fft.rfft((np.frombuffer(f, np.uint8).astype(np.float32) - 128) * np.hanning(2 * n).astype(np.float32))) ** 2
            best = [lo + int(power[lo:hi].argmax()) for lo, hi in media.BANDS]
            bins.append(best)
            levels.append([int(math.log2(power[b] + 1) * 16) for b in best])
        peaks = []
        for t in range(len(frames)):
            for k in range(len(media.BANDS)):
                before = [levels[u][k] for u in range(max(0, t - media.NEAR), t)]
                after = [levels[u][k] for u in range(t + 1, min(len(frames), t + media.NEAR + 1))]
                if all(levels[t][k] > x for x in before) and all(levels[t][k] >= x for x in after):
                    peaks.append((t, bins[t][k]))
        pairs = [(t << 24) | (f << 16) | (g << 8) | (u - t) for i, (t, f) in enumerate(peaks) for u, g in peaks[i + 1 : i + 1 + media.FANOUT] if u - t <= media.REACH]
        assert media.landmarks([item])[0].tolist() == sorted(pairs)


def test_landmarks_do_not_depend_on_neighbours():
    rng = random.Random(5)
    items = [media.pad(words(rng, n).encode()) for n in (5, 300, 40, 900)]
    together = media.landmarks(items)
    assert all((a == media.landmarks([x])[0]).all() for a, x in zip(together, items, strict=True))


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize(("weak", "bounds"), [(False, {}), (True, {}), (False, {"broadcast": 0, "hot_rows": 2, "salt_rows": 2}), (True, {"broadcast": 0, "hot_rows": 2, "salt_rows": 2})])
def test_exact_dedup(docs, rows, keep, weak, bounds):
    digest = (lambda t: F.substring(F.unhex(F.sha2(t, 256)), 1, 1)) if weak else exact_dedup.sha256_bytes
    got = collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_dedup(docs, keep, digest, **bounds).collect())
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    expected = collections.Counter()
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        k = (max if keep == "largest" else min)(ids) if ids else None
        expected[(i, k, len(groups[t or ""]), i == k, sha(t or ""))] += 1
    assert got == expected


def test_lsm_index_merges_runs():
    rng = np.random.default_rng(2)
    index, seen = exact_dedup.LsmIndex(fanout=3), {}
    for _ in range(20):
        d = np.array(sorted({bytes(rng.integers(0, 4, 3, dtype=np.uint8)) for _ in range(8)}), "S3")
        ids = rng.integers(0, 100, len(d))
        for k, i in zip(d.tolist(), ids.tolist(), strict=True):
            old = seen.get(k, (10**9, 0))
            seen[k] = (min(old[0], i), old[1] + 1)
        index.add(exact_dedup.Run(d, ids, np.ones(len(d), np.int64)))
        assert sum(len(r.digests) for r in index.runs) == len(seen)  # no digest is in two runs
    ident, count = index.lookup(np.array(sorted(seen), "S3"))
    assert [(int(a), int(b)) for a, b in zip(ident, count, strict=True)] == [seen[k] for k in sorted(seen)]
    assert len(index.compact().digests) == len(seen)


def shingles(t):
    w = re.findall(SPACE, low(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("broadcast", [jaccard.BROADCAST_ROWS, 0])
def test_ngram_jaccard(docs, rows, empty, broadcast, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", broadcast)
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    expected = collections.Counter((i, len(s), least.get(find(a)) if s else i) for a, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_components(docs).collect())
    assert got == expected
    assert jaccard.near_components(empty).count() == 0


def test_long_texts_are_cut_into_shingles_in_pieces():
    rng = random.Random(3)
    for n, piece in ((400, 50), (3, 2), (4, 3), (5, 4), (6, 1), (0, 1)):
        raw = np.frombuffer(("  " + words(rng, n) + " \n" + "é" * 40).encode() if n else b" \t ", np.uint8)
        offs = np.array([0, len(raw)])
        assert (jaccard.shingle_sets(raw, offs, piece=piece)[0] == jaccard.shingle_sets(raw, offs)[0]).all()
        assert len(jaccard.shingle_sets(raw, offs, piece=piece)[0]) == len(shingles(raw.tobytes().decode()))


def test_sets_of_one_number_are_told_apart(spark):
    base = spark.createDataFrame([(1, 7, 70), (2, 7, 71), (3, 8, 80), (4, None, None)], "doc_id long, node long, node_check long")
    renamed = jaccard._clashes(base)
    assert set(renamed) == {(7, 70), (7, 71)} and len({*renamed.values(), 7, 8}) == 4


def test_postings_stream():
    """However rows are cut into batches, a token's nodes come once each, and only where there are several."""
    rng = np.random.default_rng(1)
    for _ in range(60):
        rows = sorted((int(t), int(n), 5) for t, n in rng.integers(0, 6, (int(rng.integers(0, 25)), 2)))
        cuts = sorted(rng.integers(0, len(rows) + 1, 4).tolist())
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[a:z]], pa.int64()) for k in range(3)], ["token", "node", "place"]) for a, z in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        got = [tuple(r.values()) for b in jaccard._shared(iter(batches)) for r in b.to_pylist()]
        nodes = collections.defaultdict(set)
        for t, n, _ in rows:
            nodes[t].add(n)
        assert got == sorted((t, n, 5) for t, ns in nodes.items() if len(ns) > 1 for n in ns)


def test_leaders_of_a_stream():
    """However rows are cut into batches, a list's first node meets all of other components."""
    rng = np.random.default_rng(2)
    for _ in range(60):
        rows = sorted((int(t), i, int(c)) for i, (t, c) in enumerate(rng.integers(0, 4, (int(rng.integers(0, 25)), 2))))
        cuts = sorted(rng.integers(0, len(rows) + 1, 4).tolist())
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[a:z]], pa.int64()) for k in range(3)], ["token", "node", "component"]) for a, z in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        got = [tuple(r.values()) for b in jaccard._led(iter(batches)) for r in b.to_pylist()]
        expected, lead = [], {}
        for t, n, c in rows:
            a, own = lead.setdefault(t, (n, c))
            expected += [(a, n)] if own != c else []
        assert got == expected


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 9), (9, 8), (8, 3)] + [(100, i) for i in range(101, 140)] + [(6, 6)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(n, n) == 1 for n in (2, 3, 7, 8, 9)) and got[5] == 4 and all(got[i] == 100 for i in range(101, 140))


def test_bpe_equals_the_library(docs, rows, library, empty):
    got = collections.Counter(tuple(r) for r in bpe.encode_decode(docs, TOKENIZER).collect())
    expected = collections.Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected[(i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))] += 1
    assert got == expected
    assert bpe.encode_decode(empty, TOKENIZER).count() == 0


def test_bpe_on_odd_text(library):
    rng = random.Random(9)
    pool = "ab'sStTrReEvVlLdDmM 0½²\t\n\x85  ​ 　\x1c\x1fÀéßΣςİǅﬁǺ̧日語😀<|>!?…_-\x00\x7f"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["<|endoftext|>a<|startoftext|>", "x" * 20000, "ab" * 9000]
    model = bpe.model(TOKENIZER)
    ids, bound = model.encode_texts(texts)
    for k, t in enumerate(texts):
        assert ids[bound[k] : bound[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_language_id(spark, empty):
    rng = random.Random(3)
    vocab = {"en": "the and of to that with this from which have".split(), "de": "der die das und nicht mit von auch eine ist".split(), "fr": "le la les des une est pour dans avec sur".split(), "es": "el los las una para con por como más pero".split()}
    rows = [(i, words(rng, rng.randint(8, 40), vocab[v]), v) for i, v in enumerate(rng.choices(list(vocab), k=400))]
    rows += [(900, None, "en"), (901, "12 !?", "en"), (902, "", None), (None, "the and of", None)]
    docs = frame(spark, rows)
    model = langid.fit(docs, ~langid.held_out(F.col("doc_id")))
    got = {r["doc_id"]: r for r in langid.classify(docs, model).collect()}
    for i, t, v in rows:
        r = got[i]
        assert 0 <= r["score"] <= 1 and r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        if not langid.has_letter(t):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    held = [(v, got[i]["lang_pred"]) for i, _, v in rows[:400] if got[i]["held_out"]]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.95 * len(held)
    assert langid.classify(empty, model).count() == 0
    assert langid.classify(docs, langid.fit(empty, F.lit(True))).where("lang_pred <> 'und'").count() == 0
    assert langid.determined(docs, model).columns == docs.columns and langid.determined(docs, model).count() == len(rows) - 3


def learned(model):
    return {c for w in model.within.values() for c in w.classes}


def test_no_language_is_lost(spark):
    """Texts without letters take no place of those with letters, and a quota of one still takes one."""
    rng = random.Random(5)
    rows = [(i, words(rng, 8), "en") for i in range(300)] + [(1000 + i, words(rng, 8), "fr") for i in range(20)] + [(2000 + i, f"{i} 12 !?", "fr") for i in range(3000)]
    assert learned(langid.fit(frame(spark, rows), F.lit(True), sample=60)) == {"en", "fr"}
    many = [(100 * v + i, words(rng, 6), f"x{v:02d}") for v in range(60) for i in range(10)]
    for quota in (60, 70, 200):
        model = langid.fit(frame(spark, many), F.lit(True), sample=quota)
        assert len(learned(model)) == 60


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_digests_of_any_width_and_the_last_ids(spark, keep):
    rows = [(1, "a"), (2, "bbbb"), (3, "bbcc"), (4, "bbbb"), (5, None), (6, ""), (-(1 << 63), "edge"), (None, "edge"), ((1 << 63) - 1, "end"), (None, "end"), (None, "none"), (None, "none")]
    for digest in (lambda t: t, lambda t: F.when(t == "a", F.lit(None)).otherwise(t), exact_dedup.sha256_bytes):
        got = {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(frame(spark, rows), keep, digest).collect()}
        b, e = ((4, 6) if keep == "largest" else (2, 5))
        assert got[(1, sha("a"))] == (1, 1, True) and got[(2, sha("bbbb"))] == (b, 2, b == 2) and got[(3, sha("bbcc"))] == (3, 1, True) and got[(5, sha(""))] == (e, 2, e == 5)
        assert got[(-(1 << 63), sha("edge"))] == (-(1 << 63), 2, True) and got[((1 << 63) - 1, sha("end"))] == ((1 << 63) - 1, 2, True)
        assert got[(None, sha("edge"))] == (-(1 << 63), 2, False) and got[(None, sha("none"))][:2] == (None, 2)


def test_runs_are_merged_by_size():
    """Each digest is merged about once a level, not once for every eight runs."""
    rng, index, work = np.random.default_rng(1), exact_dedup.LsmIndex(8), []
    merge = exact_dedup.merge
    exact_dedup.merge = lambda runs: work.append(sum(len(r.digests) for r in runs)) or merge(runs)
    try:
        for _ in range(256):
            d = np.unique(rng.integers(0, 1 << 62, 64).astype(">u8").view("S8"))
            index.add(exact_dedup.Run(d, np.arange(len(d)), np.ones(len(d), np.int64)))
    finally:
        exact_dedup.merge = merge
    assert sum(work) <= 4 * 256 * 64 and len(index.runs) <= 24


def test_language_of_few_texts_is_learned(spark):
    """A language whose rows are copies of few texts stays a language."""
    rng = random.Random(4)
    few = [words(rng, 30, "le la les des une est pour dans avec sur".split()) for _ in range(3)]
    docs = spark.range(152_000).selectExpr("id as doc_id", "if(id < 2000, 'en', 'fr') as lang")
    text = F.when(F.col("lang") == "fr", F.element_at(F.array(*map(F.lit, few)), (F.col("doc_id") % 3 + 1).cast("int"))).otherwise(F.concat_ws(" ", F.lit("the and of to that with"), F.col("doc_id"), F.lit("which this from have")))
    docs = docs.withColumn("text", text)
    model = langid.fit(docs, F.lit(True))
    assert {c for w in model.within.values() for c in w.classes} == {"en", "fr"}
    got = langid.classify(docs.where("doc_id % 5000 = 0 or doc_id = 1"), model).collect()
    assert {r["lang_pred"] for r in got if r["doc_id"] >= 2000} == {"fr"} and {r["lang_pred"] for r in got if r["doc_id"] < 2000} == {"en"}


def test_a_learned_und_rejects_nothing(spark):
    docs = frame(spark, [(i, "some words here", "und") for i in range(5)] + [(9, "77", "und")])
    model = langid.fit(docs, F.lit(True))
    assert sorted(r["doc_id"] for r in langid.determined(docs, model).collect()) == [0, 1, 2, 3, 4]


def test_license_scan(spark, empty):
    mit = next(x for k, x in licenses.TEMPLATES if k == "mit")
    rows = [(1, "Released under the MIT License, and CC-BY-NC too; under the mit license"), (2, None), (3, "apache license version 2 apache license version 2"), (4, "x " + mit + " y"), (5, " ".join(w for j, w in enumerate(mit.split()) if j % 17 != 9)), (6, "under the mit"), (7, "ccé by nc"), (8, "nothing"), (8, "nothing")]
    long = "y " * 9000 + "under the mit license " + mit + " z" * 20_000
    rows.append((9, long))
    found = [licenses.scan(frame(spark, rows), broadcast=n).collect() for n in (licenses.BROADCAST_ROWS, 0)]
    got = collections.Counter(tuple(r)[:-1] for r in found[0])
    assert got == collections.Counter(tuple(r)[:-1] for r in found[1])
    expected = collections.Counter()
    word = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    for i, t in rows:
        w = re.findall(word, low(t))
        places = [(s, lab) for p, lab in licenses.PHRASES for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]
        base = sorted({x for _, x in places})
        labels = sorted(set(base) | ({"mit"} if i in (4, 5, 9) else set()))
        expected[(i, len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(base), ",".join(labels))] += 1
    assert got == expected
    assert licenses.scan(empty).count() == 0


def test_license_score_by_definition(spark):
    """Against the longest common subsequence of each template and the text around its only passage."""

    def lcs(x, y):
        best = [0] * (len(y) + 1)
        for a in x:
            row = [0]
            for j, b in enumerate(y):
                row.append(best[j] + 1 if a == b else max(best[j + 1], row[-1]))
            best = row
        return best[-1]

    rng = random.Random(6)
    rows = []
    for i, (_, x) in enumerate(licenses.TEMPLATES[:8]):
        w = x.split()
        for j in sorted(rng.sample(range(8, len(w) - 8), 2), reverse=True):  # a word changed, another left out
            w[j : j + 1] = rng.choice((["odd"], []))
        rows.append((i, words(rng, 30) + " " + " ".join(w) + " " + words(rng, 30)))
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, rows)).collect()}
    for i, t in rows:
        y = [v.decode() for v in licenses.shown(t)]
        assert licenses.TEMPLATES[i][0] in got[i]["labels"].split(",")
        own = {k: [v.decode() for v in licenses.shown(s)] for k, s in licenses.TEMPLATES if k in got[i]["labels"].split(",")}
        best = 1 if got[i]["n_base"] else max(lcs(s, y) / len(s) for s in own.values())
        assert abs(got[i]["score"] - best) < 1e-9


def test_gram_hashes_in_cells(spark):
    texts = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b"), (3, None)], "row long, text string")
    whole = {(r["row"], r["k"]): r["hashes"] for r in licenses.gram_hashes(texts, [2, 3]).collect()}
    parts = collections.defaultdict(list)
    for r in sorted(licenses.gram_hashes(texts, [2, 3], cell=3).collect(), key=lambda r: r["first"]):
        assert len(parts[r["row"], r["k"]]) == r["first"]
        parts[r["row"], r["k"]] += r["hashes"]
    assert all(parts[k] == v for k, v in whole.items()) and len(whole[1, 3]) == 6


def test_license_spans_are_verified(spark):
    text = dict((k, x) for k, x in licenses.TEMPLATES)
    mit = text["mit"].split()
    spread = " ".join("changed" if j in (9, 19, 29, 39) else w for j, w in enumerate(mit))
    rows = [(1, "intro. " + text["cc-by"] + ". More"), (2, text["cc-by-sa"]), (3, text["cc-by-nc"]), (4, text["gpl"] + " 3"), (5, text["lgpl"]), (6, spread), (7, " ".join(mit[:20])), (8, "filler " * 300 + text["cc-by-sa"] + " filler" * 300 + " " + text["gpl"]), (9, text["cc-by"].replace("4.0", "really 4.0"))]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(frame(spark, rows)).collect()}
    assert {i: x for i, (x, _) in got.items()} == {1: "cc-by", 2: "cc-by-sa", 3: "cc-by-nc", 4: "gpl", 5: "lgpl", 6: "mit", 7: "", 8: "cc-by-sa,gpl", 9: "cc-by"}
    assert got[6][1] == 45 / 49 and got[7][1] == 20 / 49 and got[9][1] == 1


def test_packing(docs, rows, library, empty):
    got = packing.pack(docs, TOKENIZER, part_pieces=12).collect()
    expected = collections.Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            expected[(i, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    lengths = np.array([r["length"] for r in got])
    assert packing.lower_bound(lengths) <= len(bins) <= packing.lower_bound(lengths) + 2
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_partitions_exchange_their_emptiest_bins(spark):
    """A round has an eighth of the pieces at most, and rounds of small partitions cost hardly a sequence."""
    lengths = np.random.default_rng(5).integers(500, 901, 40_000)
    part = 2_500
    whole = packing.best_fit_decreasing(lengths)[2]
    total, todo, rounds = 0, lengths, []
    while True:
        rounds.append(len(todo))
        parts = -(-len(todo) // part)
        left = []
        for p in range(parts):
            x = todo[p::parts]
            bins, _, used = packing.best_fit_decreasing(x)
            go = packing.given_up(x, bins, used, part // packing.EXCHANGED) if parts > 1 else np.zeros(used, bool)
            load = np.bincount(bins, weights=x)
            assert not go.any() or load[go].max() <= load[~go].min()
            total += used - go.sum()
            left.append(x[go[bins]])
            assert len(left[-1]) <= part // packing.EXCHANGED
        todo = np.concatenate(left)
        if not len(todo):
            break
    assert all(7 * b <= a for a, b in zip(rounds, rounds[1:], strict=False))
    assert total <= whole + 20


def test_lower_bound_is_one():
    rng = np.random.default_rng(4)
    for _ in range(50):
        lengths = rng.integers(1, 21, rng.integers(1, 9))
        best = len(lengths)

        def place(k, bins, lengths=lengths):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(lengths):
                best = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + lengths[k] <= 20:
                    bins[j] += lengths[k]
                    place(k + 1, bins)
                    bins[j] -= lengths[k]
            place(k + 1, [*bins, lengths[k]])

        place(0, [])
        _, _, used = packing.best_fit_decreasing(lengths, 20)
        assert packing.lower_bound(lengths, 20) <= best <= used


def test_token_files(spark, docs, rows, library, tmp_path, empty):
    folder = token_files.write_tokens(docs, TOKENIZER, str(tmp_path / "tokens"))
    got = token_files.read_tokens(spark, folder).collect()
    start = 0
    by_start = sorted((r["start"], r["n_tokens"], r["doc_id"] is not None, r["doc_id"]) for r in got)
    for s, n, _, _ in by_start:
        assert s == start
        start += n
    assert [x[3] for x in by_start] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    expected = collections.Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        expected[(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == expected
    assert token_files.read_tokens(spark, token_files.write_tokens(empty, TOKENIZER, str(tmp_path / "none"))).count() == 0


def test_range_coder_round_trips():
    rng = np.random.default_rng(6)
    blocks = [rng.integers(0, 65536, int(n)) for n in rng.integers(0, 90, 7)] + [np.zeros(300, int), np.tile([1, 2, 3], 80), rng.zipf(1.4, 200) % 65536]
    blocks = [b.astype(np.int32) for b in blocks]
    coded = token_files.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, token_files.decode_blocks(coded, [len(b) for b in blocks]), strict=True))
    assert len(coded[7]) < 150


@pytest.mark.parametrize("common", [lm_score.COMMON, 50, 1])
def test_lm_score(docs, rows, empty, common):
    got = lm_score.score(docs, common).collect()
    tok = [re.findall(SPACE, low(t)) + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = collections.Counter(x for v, h in zip(tok, held, strict=True) if not h for x in v)
    total, distinct = sum(c.values()), len(c)
    expected = collections.Counter((i, h, len(v), sum(c[x] > 0 for x in v), total, round(sum(math.log10((c[x] + 1) / (total + 1 * (distinct + 1))) for x in v), 6)) for (i, _), v, h in zip(rows, tok, held, strict=True))
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == expected
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    bits = [r["bits_per_byte"] for r in got if r["n_bytes"] > 300 and r["held_out"]]
    assert bits and all(b < 8 for b in bits)
    assert lm_score.score(empty).count() == 0
    none = lm_score.score(docs.where("doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")).first()
    assert none is None or none["train_tokens"] == 0


def test_lm_counts_grow_with_the_input(spark):
    """More contexts than a table of 2**17 slots could tell apart; each bit's odds are those of plain counting."""
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(97, 123, 20_000))) for _ in range(30)]
    rows = lm_score.blocks(lm_score._rows(frame(spark, list(enumerate(texts)))))
    docs = {r["block"]: lm_score.texts_of(bytes(r["docs"])) for r in rows.collect()}
    assert len(lm_score.block_keys(lm_score.Words(sum(docs.values(), [])))[0]) > 1 << 19
    got = lm_score.context_counts(rows, 5).toArrow()
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    tails = collections.Counter((t[i - 5 : i], t[i]) for t in train for i in range(5, len(t)))
    after = collections.defaultdict(dict)
    for (c, x), m in tails.items():
        after[c][ord(x)] = m
    assert set(got["block"].to_pylist()) == set(docs)
    for block, mine in docs.items():
        key = lm_score.block_keys(lm_score.Words(mine))[0]
        odds = lm_score.found_odds(key, got.filter(pc.equal(got["block"], block)), 5)
        text = mine[0].column("text").to_pylist()[0]
        for i in range(1000, 1200):
            k = sum(ord(c) << 8 * (5 - j) for j, c in enumerate(text[i - 5 : i + 1])) | lm_score.LENGTHS.index(5) << 62
            seen, x = after[text[i - 5 : i]], ord(text[i])
            for j in range(8):
                below = sum(m for y, m in seen.items() if y >> 8 - j == x >> 8 - j)
                same = sum(m for y, m in seen.items() if y >> 7 - j == x >> 7 - j)
                assert abs(odds[np.searchsorted(key, np.uint64(k)), j] - math.log((same + 0.4) / (below - same + 0.4))) < 1e-5


def test_lm_weights_last_a_whole_document():
    """Against mixing bit after bit, with weights refined after each token and never reset within a document."""
    rng = np.random.default_rng(4)
    size = rng.integers(1, 9, 40)
    begin = np.cumsum(size) - size
    bound = np.array([0, 300, 301, 420])
    token = rng.integers(0, 40, bound[-1])
    odds = rng.normal(size=(50, 8)).astype(np.float32)
    place = rng.integers(0, 50, (int(size.sum()), lm_score.ORDERS)).astype(np.int32)
    expected = []
    for a, z in zip(bound[:-1], bound[1:], strict=True):
        w, total = np.full((lm_score.ORDERS, 8), lm_score.FIRST_WEIGHT), 0.0
        for e in token[a:z]:
            step = np.zeros_like(w)
            for i in range(begin[e], begin[e] + size[e]):
                for j in range(8):
                    x = odds[place[i], j].astype(float)
                    p = 1 / (1 + math.exp(-(w[:, j] @ x)))
                    total += math.log10(p)
                    step[:, j] += lm_score.LEARNING_RATE * (1 - p) * x
            w += step
        expected.append(total)
    assert np.allclose(lm_score.log10_scores(token, bound, begin, size, odds, place), expected, rtol=1e-3)


def test_lm_word_context():
    """The word so far is told from others however long it is; no context reaches back over the word's start."""
    s = np.frombuffer(b"xabcdefg yabcdefg xabcdefh ", np.uint8)
    found = list(lm_score.keys(s, np.array([0, 9, 18, 27])))
    word = found[-1]
    assert word[7] != word[16] and word[0] >> np.uint64(8) == word[9] >> np.uint64(8)
    assert all((k[:7] == k[18:25]).all() and k[7] != k[25] and k[7] >> np.uint64(8) == k[25] >> np.uint64(8) for k in found)


def test_lm_probabilities_sum_to_one():
    """Over all values of a byte, given the same history and the counts of one context for each order."""
    rng = np.random.default_rng(8)
    history = np.frombuffer(b"some history ", np.uint8)
    counts = rng.integers(0, 50, (lm_score.ORDERS, 256))
    key = np.concatenate([(np.uint64(k) << np.uint64(62)) | np.arange(256, dtype=np.uint64) for k in range(lm_score.ORDERS)])
    odds = lm_score.path_odds(lm_score.path_counts(key, counts.ravel()))
    begin, size = np.append(np.arange(256), 256), np.append(np.ones(256, int), len(history))
    place = np.concatenate([np.arange(256)[:, None], history[:, None]]) + 256 * np.arange(lm_score.ORDERS)
    token = np.stack([np.full(256, 256), np.arange(256)], 1).ravel()
    whole = 10 ** lm_score.log10_scores(token, np.arange(257) * 2, begin, size, odds, place.astype(np.int32))
    before = 10 ** lm_score.log10_scores(np.array([256]), np.array([0, 1]), begin, size, odds, place.astype(np.int32))[0]
    assert abs(whole.sum() / before - 1) < 1e-3


def test_lm_score_is_that_of_plain_counting(spark):
    """The whole score on a small table, against one that counts and mixes bit by bit."""
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randint(0, 12))) for i in range(30)] + [(40, None), (41, words(rng, 3) + " " + "q" * 300)]
    got = {r["doc_id"]: r["score"] for r in lm_score.score(frame(spark, rows)).collect()}

    def padded(t, i):
        return [(o, ("\0" * 5 + t[:i])[-k:] if o < 3 else t[:i]) for o, k in enumerate((*lm_score.LENGTHS, 0))]

    tokens = {i: [w + " " for w in re.findall(SPACE, low(t))] + ["\n"] for i, t in rows}
    seen = collections.defaultdict(collections.Counter)
    for i, ts in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for t in ts:
                for k in range(len(t)):
                    for c in padded(t, k):
                        seen[c][ord(t[k])] += 1
    for i, ts in tokens.items():
        w, total = np.full((lm_score.ORDERS, 8), lm_score.FIRST_WEIGHT), 0.0
        for t in ts:
            step = np.zeros_like(w)
            for k in range(len(t)):
                for j in range(8):
                    x = []
                    for c in padded(t, k):
                        same = sum(n for y, n in seen[c].items() if y >> 7 - j == ord(t[k]) >> 7 - j)
                        below = sum(n for y, n in seen[c].items() if y >> 8 - j == ord(t[k]) >> 8 - j)
                        x.append(math.log((same + 0.4) / (below - same + 0.4)))
                    x = np.array(x)
                    p = 1 / (1 + math.exp(-max(-10, min(10, w[:, j] @ x))))
                    total += math.log10(p)
                    step[:, j] += lm_score.LEARNING_RATE * (1 - p) * x
            w += step
        assert abs(got[i] - total) < 1e-3 * max(1, -total), (i, got[i], total)


def covered(texts, n):
    c = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    for t in texts:
        m = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if c[t[i : i + n]] > 1:
                m[i : i + n] = True
        yield m


@pytest.mark.parametrize(("length", "slab"), [(200, 1 << 19), (20, 1 << 19), (200, 700), (20, 64)])
def test_suffix_dedup(docs, rows, length, slab, empty):
    got = collections.Counter(tuple(r) for r in substrings.remove_repeats(docs, length, slab).collect())
    raw = [(t or "").encode() for _, t in rows]
    expected = collections.Counter()
    for (i, _), b, m in zip(rows, raw, covered(raw, length), strict=True):
        runs = int(m[0]) + int((m[1:] & ~m[:-1]).sum()) if len(m) else 0
        expected[(i, len(b), int(m.sum()), runs, sha(np.frombuffer(b, np.uint8)[~m].tobytes()))] += 1
    assert got == expected
    assert substrings.remove_repeats(empty, length).count() == 0


def test_clean_texts_keeps_columns(docs, rows):
    got = substrings.clean_texts(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert by_id[501]["text"] is None and by_id[503]["text"] == "a" and len(by_id[400]["text"]) < len(dict(rows)[400])
    assert by_id[400]["n_chars"] == len(by_id[400]["text"])
