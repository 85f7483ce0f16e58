"""An index by segments against a rebuild, blocks against a full scan."""

import random

import pytest
from pyspark.sql import functions as F

from stemforge.functions.text import prefix_like
from stemforge.operators import search, segments


def test_index_equals_a_rebuild_after_each_batch(spark, tmp_path):
    rng = random.Random(1)
    vocab = ["Straße", "häuser", "HAUS", "a", "b", "ça", "x1"]
    index = segments.SegmentIndex(spark, str(tmp_path / "i"), fanout=3)
    assert index.postings().count() == 0 and index.segments() == []
    now, written = {}, 0
    for batch in range(11):
        keys = rng.sample(range(60), 40 if batch == 0 else 4)
        for k in keys:
            if k in now and rng.random() < 0.4:
                del now[k]
            else:
                now[k] = " ".join(rng.choice(vocab) for _ in range(5))
        touched = spark.createDataFrame([(k,) for k in keys], "k long")
        index.apply(touched, spark.createDataFrame([(k, now[k]) for k in keys if k in now], "k long, s string"), "k", "s")
        written += len(keys)
        assert all(len([s for s in index.segments() if s["level"] == v]) < 3 for v in range(4))
        if batch in (0, 4, 10):
            rebuilt = search.token_index(spark.createDataFrame(list(now.items()), "k long, s string"), "k", "s")
            assert sorted(map(tuple, index.postings().collect())) == sorted((r["token"], r["k"], r["n"]) for r in rebuilt.collect())
    both = index.search(["haus", "a"]).collect()
    assert {r["key"] for r in both} == {k for k, s in now.items() if "HAUS" in s.split() and "a" in s.split()} and both
    assert index.rows_written <= 4 * 6 * written  # a row of some five postings and a tombstone, once a level
    index.vacuum()
    assert len(list((tmp_path / "i").iterdir())) == len(index.segments()) + 1
    # a batch that broke off before its manifest was whole changes nothing
    before = index.postings().count()
    spark.createDataFrame([("zz", 1, 1, 99)], index.posting).write.parquet(str(tmp_path / "i" / "segment-000000000099-0" / "postings"))
    assert index.postings().count() == before


def test_tombstones_go_with_the_first_segment(spark, tmp_path):
    index = segments.SegmentIndex(spark, str(tmp_path / "i"), fanout=2)
    rows = spark.createDataFrame([(1, "a b"), (2, "a c")], "k long, s string")
    index.apply(rows, rows, "k", "s")
    index.apply(rows.where("k = 1"), rows.limit(0), "k", "s")
    found = index.segments()
    assert [s["level"] for s in found] == [1] and found[0]["rows"] == 2
    assert sorted(map(tuple, index.postings().collect())) == [("a", 2, 1), ("c", 2, 1)]


def test_a_prefix_reads_the_blocks_of_its_range(spark, tmp_path):
    words = [f"{a}{b}{n}" for a in "aBcD" for b in "xyÄ" for n in range(40)] + ["ax", "%x", "a_"]
    rows = spark.createDataFrame([(i, w, i % 7) for i, w in enumerate(words)], "id int, lemma string, rank int")
    path = str(tmp_path / "lex")
    segments.write_blocks(rows, path, per_block=30)
    total = len(spark.read.parquet(f"{path}/blocks").inputFiles())
    assert total >= 10
    for q, most in (("bY", 4), ("a", 7), ("AX1", 3), ("zz", 0), ("%", total), ("cÄ3", 3), ("a_3", 7)):
        found = segments.read_blocks(spark, path, q)
        wanted = prefix_like(F.col("lemma"), q)
        assert sorted(r["lemma"] for r in found.where(wanted).collect()) == sorted(r["lemma"] for r in rows.where(wanted).collect())
        assert len(found.inputFiles()) <= most or most == 0, (q, len(found.inputFiles()))
    plain = search.prefix_search(rows, "bY", 5).collect()
    assert search.prefix_search(segments.read_blocks(spark, path, "bY"), "bY", 5).collect() == plain and len(plain) == 5
    assert segments.read_blocks(spark, path, "ay").where(F.col("rank") >= 0).count() == 40
    segments.write_blocks(rows.limit(0), path)
    assert segments.read_blocks(spark, path, "a").count() == 0
    with pytest.raises(ValueError):
        search.prefix_search(segments.read_blocks(spark, path, ""), "")


def test_rebuild_puts_back_what_a_broken_run_moved_aside(spark, tmp_path):
    from stemforge.sources import sinks

    path = tmp_path / "t"
    sinks.rebuild(spark.range(3), str(path))
    path.rename(tmp_path / "t.old")  # a run that ended between its two moves
    sinks.rebuild(spark.range(5), str(path))
    assert spark.read.parquet(str(path)).count() == 5
    sinks.rebuild(spark.read.parquet(str(path)).where("id < 2"), str(path))
    assert spark.read.parquet(str(path)).count() == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["t"]
