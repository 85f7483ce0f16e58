"""What tasks of the training-data operators hold and move, on inputs of a few megabytes."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from helpers import words
from pyspark.sql import functions as F

from stemforge.llm import bpe, components, jaccard, lm_score, token_files
from stemforge.llm.queries import TOKENIZER


def test_encoder_takes_small_groups():
    rng = random.Random(3)
    texts = [words(rng, 2000) for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(texts)], ["doc_id", "text"])
    whole, _ = bpe.model(TOKENIZER).encode_texts(texts)
    tracemalloc.start()
    got = [len(ids) for _, _, ids, _ in bpe.encoded_groups(batch, TOKENIZER)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(got) == len(whole) and len(got) > 3
    assert peak < 40e6  # 105 MB with groups of 5,000,000 characters


def test_groups_are_found_in_three_short_rows():
    rng = np.random.default_rng(5)
    lanes = token_files._Lanes(np.array([300, 300, 200]))
    for _ in range(64):
        lanes.since.append(lanes.base + rng.zipf(1.3, 3) % 4096)
        lanes.t += 1
    lanes.renew()
    assert lanes.coarse.shape == (3, 16) and lanes.middle.shape == (48, 16)  # one row of 64 and one of 64 before
    lane, value = rng.integers(0, 3, 5000), np.append(rng.integers(0, 1 << 16, 4998), [0, (1 << 16) - 1])
    sums = lanes.sums[:-1].reshape(3, 4096).astype(int)
    expected = [a * 4096 + np.searchsorted(sums[a], v, "right") - 1 for a, v in zip(lane, value, strict=True)]
    assert lanes.find(lane, value).tolist() == expected


def test_answers_are_taken_shard_by_shard():
    rng = np.random.default_rng(4)
    key = np.unique(rng.integers(0, 1 << 40, 200_000).astype(np.uint64))
    n = rng.integers(0, 9, len(key))
    order, ends = lm_score.dealt(key, 40)
    for times in (1, 1 << 32):  # counts of 32 bits and of more
        paths = lm_score.path_counts(key, n * times)
        answers = pa.table({"shard": pa.array(range(40), pa.int32()), "paths": pa.array([lm_score._packed(paths[order[a:z]]) for a, z in zip(ends[:-1], ends[1:], strict=True)], pa.binary())})
        tracemalloc.start()
        got = lm_score.found_odds(key, answers, 40)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert (got == lm_score.path_odds(paths)).all() and paths.itemsize == (4 if times == 1 else 8)
        assert peak < 25e6  # 14 MB of it are the odds and the order; all answers at once took three times 14 MB more


def test_counts_of_keys_are_summed_in_place():
    rng = np.random.default_rng(8)
    key, n = rng.integers(1 << 40, (1 << 40) + 500, 4000).astype(np.uint64), rng.integers(0, 5, 4000)
    u, total, place = lm_score.summed(key, n)
    assert (u[place] == key).all() and (np.diff(u.astype(np.int64)) > 0).all() and total.tolist() == [int(n[key == x].sum()) for x in u]
    assert place.dtype == np.int32 and len(lm_score.summed(key[:0], n[:0])[0]) == 0


def test_lists_of_the_same_nodes_meet_once(spark):
    size, shared = 200, 55  # a passage of 55 shingles in three sets, one shingle more in two of them
    kept = [(t, n, 1 + t, n, 8) for t in range(shared) for n in (1, 2, 3)] + [(99, n, 60, n, 8) for n in (1, 2)] + [(100, n, 70, 4, 8) for n in (4, 5)]
    merged = jaccard._merged(spark.createDataFrame(kept, "token long, node long, idx long, component long, l int"))
    assert sorted((r["node"], r["many"], r["idx"]) for r in merged.collect()) == [(1, 1, 60), (1, 55, 1), (2, 1, 60), (2, 55, 1), (3, 55, 1)]
    nodes = spark.createDataFrame([(n, size, *[0] * 8) for n in (1, 2, 3)], ", ".join(f"{c} long" for c in ("node", "size", *jaccard.SIGNATURE)))
    major = merged.groupBy("s1", "s2").agg(F.max("component").alias("major"))
    got = sorted((r["a"], r["b"], r["many"], r["a_last"]) for r in jaccard._meetings(merged.join(major, ["s1", "s2"]), nodes, 75).collect())
    # by itself, each shingle of the first 36 has room for a link and would give three rows
    assert got == [(1, 2, 55, 1), (1, 3, 55, 1), (2, 3, 55, 1)]


def test_the_foremost_pairs_between_components(spark):
    label = spark.createDataFrame([(n, 1) for n in range(2, 51)], "node long, component long")
    pairs = spark.createDataFrame([(n, 100, n) for n in range(1, 51)] + [(2, 3, 9)], "a long, b long, shared long")
    between = jaccard._between(pairs, label)
    assert between.count() == 50  # the pair within a component goes
    assert sorted(r["a"] for r in jaccard._foremost(between).collect()) == [47, 48, 49, 50]
    more = jaccard._relabelled(spark.createDataFrame([(50, 100), (60, 61)], "u long, v long"), jaccard.cut(label))
    assert sorted(map(tuple, more.collect())) == [(n, 1) for n in range(2, 51)] + [(61, 60), (100, 1)]


def test_wide_bitmaps_bound_what_two_sets_differ_in():
    rng = np.random.default_rng(5)
    for n, other in ((600, 700), (1000, 1100), (4000, 5000), (9000, 7000)):
        x = np.unique(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False))
        y = np.unique(np.append(x[: n // 2], rng.integers(0, 1 << 64, other - n // 2, np.uint64, endpoint=False)))
        a, b = jaccard.wide_bits(x), jaccard.wide_bits(y)
        assert len(a) * 64 >= len(x) and jaccard.differing(a, a) == 0
        apart = len(np.setxor1d(x, y))
        # Over what a link allows, where 512 bits differ in some 256.
        assert 2 * (n + other) // 7 / 2 < jaccard.differing(a, b) <= apart
        assert jaccard.differing(a, b) == jaccard.differing(b, a)
        one = np.delete(x, 7)
        assert jaccard.differing(a, jaccard.wide_bits(one)) <= 1 or len(a) != len(jaccard.wide_bits(one))
    assert jaccard.wide_bits(x[:512]) is None


def test_wide_bitmaps_drop_pairs_before_they_are_rows(spark):
    rng = np.random.default_rng(6)
    own = [np.unique(rng.integers(0, 1 << 64, 4000, np.uint64, endpoint=False)) for _ in range(40)]
    own.append(np.delete(own[0], range(9)))
    nodes = spark.createDataFrame([(i, len(s), *jaccard.signature(s).tolist(), jaccard.wide_bits(s).tolist()) for i, s in enumerate(own)], ", ".join(f"{c} long" for c in ("node", "size", *jaccard.SIGNATURE)) + ", wide array<long>")
    kept = jaccard._open(spark.createDataFrame([(1, 2, i, 1, 1, i, 1) for i in range(41)], "s1 long, s2 long, node long, many long, idx long, component long, l int"), None)
    assert [(r["a"], r["b"]) for r in jaccard._meetings(kept, nodes, 75).collect()] == [(0, 40)]
    assert jaccard._meetings(kept, nodes.drop("wide"), 75).count() > 400
    assert [(r["a"], r["b"]) for r in jaccard._wide_alike(spark.createDataFrame([(0, 40), (1, 2), (3, 40)], "a long, b long"), nodes, 75).collect()] == [(0, 40)]


def test_the_most_alike_of_a_window_are_a_row_a_node(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "WINDOW", 16)
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 64, 200, np.uint64, endpoint=False)
    own = [np.unique(np.append(np.delete(base, rng.choice(200, 10)), rng.integers(0, 1 << 64, 10, np.uint64, endpoint=False))) for _ in range(300)]
    nodes = spark.createDataFrame([(i, len(s), *jaccard.signature(s).tolist()) for i, s in enumerate(own)], ", ".join(f"{c} long" for c in ("node", "size", *jaccard.SIGNATURE)))
    kept = jaccard._open(spark.createDataFrame([(1, 2, i, 1, 1, i, 1) for i in range(300)], "s1 long, s2 long, node long, many long, idx long, component long, l int"), None)
    pairs = jaccard._nearest(kept, nodes, 0, 75).collect()
    assert sum(r["shared"] for r in pairs) == 300 and {i for r in pairs for i in (r["a"], r["b"])} == set(range(300))
    assert jaccard._meetings(kept, nodes, 75).count() > 20_000
    one = jaccard._open(kept.select("s1", "s2", "node", "many", "idx", "component", "l"), spark.createDataFrame([(i, 0) for i in range(300)], "node long, component long"))
    assert one.count() == 0  # a list of one component is left out


def test_few_edges_and_many_have_the_same_components(spark, monkeypatch):
    rng = np.random.default_rng(8)
    edges = spark.createDataFrame([tuple(map(int, e)) for e in rng.integers(-400, 400, (500, 2))], "u long, v long")
    few = sorted(map(tuple, components.components(edges).collect()))
    monkeypatch.setattr(components, "FEW", 0)
    assert few == sorted(map(tuple, components.components(edges).collect())) and len(few) > 300


def test_scores_do_not_depend_on_the_lanes_and_take_no_copy_of_weights_a_byte(monkeypatch):
    rng = np.random.default_rng(9)
    size = rng.integers(1, 12, 60)
    begin = np.cumsum(size) - size
    odds = rng.normal(0, 2, (90, 8)).astype(np.float32)
    place = rng.integers(0, 90, (int(size.sum()), lm_score.ORDERS)).astype(np.int32)
    bound = np.append(0, np.cumsum(rng.integers(1, 40, 300)))
    token = rng.integers(0, 60, int(bound[-1]))
    reduceat = []

    class Add:
        reduce = np.add.reduce

        @staticmethod
        def reduceat(*a, **k):  # sums of 32 numbers a byte, which took a third of the time
            reduceat.append(a)

    whole = lm_score.log10_scores(token, bound, begin, size, odds, place)
    monkeypatch.setattr(lm_score.np, "add", Add)
    for lanes in (1, 7, 300):
        monkeypatch.setattr(lm_score, "LANES", lanes)
        assert (lm_score.log10_scores(token, bound, begin, size, odds, place) == whole).all()
    assert not reduceat and len(lm_score.log10_scores(token[:0], np.zeros(1, np.int64), begin, size, odds, place)) == 0
