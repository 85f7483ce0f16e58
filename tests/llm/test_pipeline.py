"""Stages of the corpus pipeline, each on what its predecessor kept."""

import collections
import re

import numpy as np
import pytest
from helpers import frame, sample
from test_operators_llm import covered, shingles

import corpus_pipeline
from stemforge.llm import bpe
from stemforge.llm.queries import TOKENIZER


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def near_groups(texts):
    """Group of each text by the definition: pairs of sets, one by one."""
    sets, group = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                group[find(a)] = find(b)
    return [find(x) for x in range(len(texts))]


@pytest.mark.parametrize(("columns", "broadcast"), [(COLUMNS, corpus_pipeline.BROADCAST_ROWS), (None, 0)])
def test_stages(spark, tmp_path, columns, broadcast, monkeypatch):
    """Each stage against its definition, on what the stage before kept; with further columns of clashing names too,
    and with lists of dropped rows that are joined by a shuffle.
    """
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_ROWS", broadcast)
    rows = sample(7)
    rows = [(i, t, "de" if i is None or i % 2 else "en") for i, t in rows]
    docs = frame(spark, rows)
    docs = docs.select(*columns) if columns else docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "passage_dedup", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "unused")
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert after.columns == docs.columns
            kept[name] = [(r["doc_id"], r["text"]) for r in after.collect()]
        docs = after
    letters = [(i, t) for i, t, _ in rows if t and re.search(r"[^\W\d_]", t)]
    assert collections.Counter(kept["language_id"]) == collections.Counter(letters)
    last = {}
    for i, t in letters:
        last[t] = max((x for x in (i, last.get(t)) if x is not None), default=None)
    assert sorted(kept["exact_dedup"], key=str) == sorted(((i, t) for t, i in last.items()), key=str)
    groups = collections.defaultdict(list)
    for g, row in zip(near_groups([t for _, t in kept["exact_dedup"]]), kept["exact_dedup"], strict=True):
        groups[g].append(row)
    assert len(kept["near_dedup"]) == len(groups)
    for own in groups.values():
        ids = [i for i, _ in own if i is not None]
        stays = [r for r in own if r in kept["near_dedup"]]
        assert len(stays) == 1 and stays[0][0] == min(ids, default=None)
    texts = [t.encode() for _, t in kept["near_dedup"]]
    cleaned = [(i, np.frombuffer(b, np.uint8)[~m].tobytes().decode("utf-8", "ignore")) for (i, _), b, m in zip(kept["near_dedup"], texts, covered(texts, 200), strict=True)]
    assert collections.Counter(kept["passage_dedup"]) == collections.Counter(cleaned)
    packed, total = docs.collect(), collections.Counter()
    for r in packed:
        total[r["doc_id"]] += r["length"]
    model = bpe.model(TOKENIZER)
    expected = collections.Counter()
    for i, t in cleaned:
        expected[i] += len(model.encode(t)) + 1
    assert total == expected


def test_language_stage_without_labels(spark):
    docs = frame(spark, [(1, "some words"), (2, "12 !!"), (3, None), (4, "Ωδή")]).select("doc_id", "text", "lang", "source", "n_chars")
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "unused").collect()) == [1, 4]


def test_near_stage_keeps_one_of_each_group(spark):
    base = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    rows = [(7, base[0]), (7, base[0] + " more"), (None, base[1]), (None, base[1] + " more"), (None, base[2]), (9, base[2] + " more"), (7, base[3]), (None, None), (None, " ")]
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near(spark, docs, "unused").collect()]
    assert sorted((t or " ")[0] for _, t in got) == [" ", " ", "a", "b", "c", "d"]
    assert (9, base[2] + " more") in got and (7, base[3]) in got


def test_empty_table(spark):
    docs = frame(spark, [(0, "x")]).where("doc_id = 1").select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "unused")
        assert docs.count() == 0
