"""Merge rules, records, clusters, layout, sources and streams on small fixtures."""

import gzip
import json
import math
import os
import random
import struct
import time

from pyspark.sql import functions as F

from stemforge.functions import arrays, text
from stemforge.operators import clustering, graph, layout, merge, records, search, validate
from stemforge.sources import readers, sinks
from stemforge.streaming import streams


def test_fold_and_upsert(spark):
    new = spark.createDataFrame([("a", 1, "x", ["p"], ["s"]), ("a", 2, None, [], []), ("b", 3, "y", ["q"], ["t"])], "id string, ord int, g string, t array<string>, r array<string>")
    old = spark.createDataFrame([("a", "old", ["o"], ["o"], 1, 1), ("c", "keep", ["k"], ["k"], 1, 1)], "id string, g string, t array<string>, r array<string>, created_at int, updated_at int")
    folded = merge.fold(new, ["id"], "ord", ["g"], ["t"], ["r"])
    got = {r["id"]: tuple(r)[1:] for r in merge.upsert(old, folded, ["id"], ["g"], ["t"], ["r"], now=9).collect()}
    assert got == {"a": ("x", ["p"], [], 1, 9), "b": ("y", ["q"], ["t"], 9, 9), "c": ("keep", ["k"], ["k"], 1, 1)}


def test_insert_or_ignore(spark):
    old = spark.createDataFrame([("a", "1")], "k string, v string")
    new = spark.createDataFrame([("a", "2", 0), ("b", "3", 2), ("b", "4", 1)], "k string, v string, ord int")
    assert {tuple(r) for r in merge.insert_or_ignore(old, new, ["k"]).collect()} == {("a", "1"), ("b", "4")}


def test_put_keeps_the_last(spark):
    old = spark.createDataFrame([("k", "1"), ("m", "2")], "key string, value string")
    new = spark.createDataFrame([("k", "9", 0), ("k", "10", 1), ("n", "3", 0)], "key string, value string, ord int")
    assert {tuple(r) for r in sinks.put(old, new).collect()} == {("k", "10"), ("m", "2"), ("n", "3")}


def test_rebuild_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    for _ in range(2):
        sinks.rebuild(spark.read.parquet(path).select(F.col("id") + 1, F.lit(1)).toDF("id", "n").select("id"), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [2, 3, 4, 5, 6]
    sinks.dry_run(spark.read.parquet(path))
    sinks.append(spark.range(1), path)
    assert spark.read.parquet(path).count() == 6


def test_document_round_trip(spark, tmp_path):
    clusters = spark.createDataFrame([(i, (f"r-{i}", "hūs"), [(f"w{i}", "Häuser"), ("v", "b")], None if i % 2 else (1.0, 2.0, 3.0)) for i in range(20)], "ord long, wurzel struct<id:string,form:string>, words array<struct<id:string,lemma:string>>, position struct<x:double,z:double,height:double>").repartition(4)
    stats = spark.createDataFrame([(20, 3)], "total_clusters long, multi_word_clusters long")
    path = str(tmp_path / "doc")
    sinks.export_document(clusters, stats, path, {"algorithm": "grid", "world_size": 400})
    kind = clusters.select("wurzel", "words", "position").schema.simpleString()
    assert sorted(map(str, readers.read_document(spark, path, kind).collect())) == sorted(map(str, clusters.collect()))
    head = readers.read_head(spark, path, "struct<total_clusters:long,multi_word_clusters:long>", "struct<algorithm:string,world_size:int>").collect()
    assert [(h["version"], h["stats"]["total_clusters"], h["layout"]["world_size"]) for h in head] == [(3, 20, 400)]
    (tmp_path / "one.json").write_text(json.dumps({"version": 3, "clusters": [{"wurzel": {"id": "r-0", "form": "a"}}, {"wurzel": {"id": "r-1", "form": "b"}}]}))
    assert [(r["ord"], r["wurzel"]["id"]) for r in readers.read_whole_document(spark, str(tmp_path / "one.json"), kind).collect()] == [(0, "r-0"), (1, "r-1")]


RECORDS = [
    {"word": "Haus", "pos": "noun", "senses": [{"glosses": ["house"], "tags": ["colloquial"], "topics": ["building"], "synonyms": [{"word": "Heim"}], "examples": [{"text": "Das Haus", "english": "the house"}]}], "forms": [{"form": "Häuser", "tags": ["plural"]}, {"form": "Haus", "tags": ["x"]}], "head_templates": [{"name": "de-noun", "args": {"1": "n"}, "expansion": ""}], "sounds": [{"rhymes": ["aʊs"]}, {"ipa": "/haʊs/", "homophones": "aus"}], "hyphenation": ["Hau", "s"], "derived": [{"word": "Haustür"}]},
    {"word": "Häuser", "pos": "noun", "senses": [{"form_of": [{"word": "Haus"}], "tags": ["form-of", "plural"]}]},
    {"word": "gehen", "pos": "verb", "senses": [{"glosses": ["go"]}], "head_templates": [{"name": "de-verb", "args": {}, "expansion": "class 7 strong, auxiliary sein"}]},
]


def test_records(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in RECORDS) + "\n\nnot json\n")
    rows = readers.read_records(spark, str(p))
    assert rows.count() == 3
    assert readers.read_records(spark, str(p), limit=1).count() == 1
    got = {r["id"]: r for r in records.entries(rows).collect()}
    assert set(got) == {"Haus|NOUN", "gehen|VERB"}
    h = got["Haus|NOUN"]
    assert (h["gender"], h["ipa"], h["rhymes"], h["syllabification"], h["homophones"], h["translations"], h["synonyms"], h["derived"], h["usage_labels"], h["subject_domains"]) == ("n", "/haʊs/", "aʊs", "Hau·s", ["aus"], ["house"], ["Heim"], ["Haustür"], ["colloquial"], ["building"])
    assert (got["gehen|VERB"]["auxiliary"], got["gehen|VERB"]["verb_class"]) == ("sein", "strong/7")
    forms = {(r["form"], r["entry_id"]): r["tags"] for r in records.forms(rows).collect()}
    assert forms[("Häuser", "Haus|NOUN")] in (["plural"], ["form-of", "plural"]) and forms[("Haus", "Haus|NOUN")] == ["lemma"] and ("gehen", "gehen|VERB") in forms


def test_readers(spark, tmp_path):
    (tmp_path / "ipa.tsv").write_text("Haus\t/haʊs/\nbad\n\t/x/\nMaus\t/maʊs/\textra\n")
    assert sorted(r["word"] for r in readers.read_ipa(spark, str(tmp_path / "ipa.tsv")).collect()) == ["Haus", "Maus"]
    (tmp_path / "l.tsv").write_text("Haus\ta1\nHaus\tb2\nx\tz9\n")
    levels = readers.read_levels(spark, str(tmp_path / "l.tsv"))
    assert readers.last_by_word(levels, "level").collect()[0]["level"] == "B2" and readers.first_by_word(levels, "level").collect()[0]["level"] == "A1"
    (tmp_path / "v.vec").write_text("2 3\nHaus 1 2 3\nMaus 4 5 6\n")
    assert [r["vector"] for r in readers.read_vectors(spark, str(tmp_path / "v.vec"), 1).collect()] == [[1.0, 2.0, 3.0]]
    (tmp_path / "t.jsonl").write_text('{"word":"a","etymology_templates":[{"name":"x","args":{"2":"la"}}]}\n{"word":"a","etymology_templates":[]}\n')
    assert readers.read_templates(spark, [str(tmp_path / "t.jsonl")]).first()["etymology_templates"][0]["args"] == {"2": "la"}
    articles = ["<i>eins</i>", "zwei"]
    index = b"".join(w.encode() + b"\0" + struct.pack(">II", o, s) for w, o, s in (("A", 0, len(articles[0])), ("B", len(articles[0]), len(articles[1]))))
    (tmp_path / "x.idx.gz").write_bytes(gzip.compress(index))
    (tmp_path / "x.dict.dz").write_bytes(gzip.compress("".join(articles).encode()))
    got = readers.read_stardict(spark, str(tmp_path / "x.idx.gz"), str(tmp_path / "x.dict.dz"))
    assert [tuple(r) for r in got.orderBy("ord").collect()] == [(0, "A", "<i>eins</i>"), (1, "B", "zwei")]


def test_base_entries(spark):
    html = '<font color="green">noun</font><span lang="en">{}</span>'
    rows = spark.createDataFrame([(0, "Haus", html.format("house")), (1, "Haus", html.format("House")), (2, "Haus", '<span lang="en">home</span>'), (3, "(x)", html.format("y"))], "ord long, word string, html string")
    got = records.base_entries(rows).collect()
    assert [(r["id"], r["translations"], r["senses"]) for r in got] == [("Haus|NOUN", ["house", "home"], 3)]


def words(spark, rows):
    return spark.createDataFrame(rows, "lemma string, ord int, root_key string, derived array<string>")


def test_adoption_in_order(spark):
    rows = [("A", 0, "r:x", ["B"]), ("B", 1, None, ["C"]), ("C", 2, None, []), ("D", 3, None, ["E"]), ("E", 4, None, [])]
    got = {r["lemma"]: r["root_key"] for r in clustering.adopt_in_order(words(spark, rows).withColumn("ord", F.struct("ord"))).collect()}
    assert got == {"A": "r:x", "B": "r:x", "C": "r:x", "D": None, "E": None}
    back = [("C", 0, None, []), ("B", 1, None, ["C"]), ("A", 2, "r:x", ["B"])]  # C comes before B is adopted
    got = {r["lemma"]: r["root_key"] for r in clustering.adopt_in_order(words(spark, back).withColumn("ord", F.struct("ord"))).collect()}
    assert got == {"A": "r:x", "B": "r:x", "C": None}
    once = {r["lemma"]: r["root_key"] for r in clustering.adopt_once(words(spark, rows)).collect()}
    assert once["B"] == "r:x" and once["C"] is None


def test_clusters_end_to_end(spark):
    t = [("Haus", [{"name": "inh", "args": {"2": "goh", "3": "hūs"}}]), ("Hausen", [{"name": "inh", "args": {"2": "goh", "3": "hūs"}}])]
    templates = spark.createDataFrame(t, "word string, etymology_templates array<struct<name:string,args:map<string,string>>>")
    entries = spark.createDataFrame([("Haus|NOUN", "Haus", "NOUN", "A2", 9, None, []), ("Hausen|NOUN", "Hausen", "NOUN", "A1", None, None, []), ("laufen|VERB", "laufen", "VERB", "A1", 3, "aus lateinisch xy", []), ("x|X", "x", "X", "A1", 1, None, [])], "id string, lemma string, pos string, cefr_level string, frequency_class int, etymology string, derived array<string>")
    vocab = clustering.vocabulary(entries, ["A1", "A2"], ["NOUN", "VERB", "ADJ", "ADV"])
    layer = clustering.rooted(vocab, templates).cache()
    rooted = clustering.stem_groups(clustering.adopt_once(layer)).cache()
    got = {r["root_key"]: r for r in clustering.clusters(rooted).collect()}
    assert set(got) == {"goh:hūs", "la:xy"} and got["goh:hūs"]["cluster"] == "r-0" and got["goh:hūs"]["basic_word"] == "Hausen"
    docs = {r["root_key"]: r for r in clustering.documents(clustering.clusters(rooted)).collect()}
    assert docs["goh:hūs"]["wurzel"]["form"] == "hūs" and len(docs["goh:hūs"]["links"]) == 2
    found = clustering.clusters(rooted)
    edges = {tuple(r) for r in graph.etymology_edges(found).collect()}
    assert ("nhg:Hausen", "goh:hūs", "descends_from") in edges
    assert {"goh:hūs", "nhg:Hausen", "nhg:lauf"} <= {r["id"] for r in graph.roots(found, rooted).collect()}
    assert clustering.cluster_stats(clustering.clusters(rooted)).first()["multi"] == 1


def test_layout_steps(spark):
    p = spark.createDataFrame([("a", 0.0, 0.0, 3.0), ("b", 0.5, 0.0, 3.0), ("c", 100.0, 0.0, 3.0)], "id string, x double, z double, radius double")
    assert [(r["a"], r["b"]) for r in layout.overlaps(p).collect()] == [("a", "b")]
    assert layout.overlaps(layout.separate(p)).count() == 0
    e = spark.createDataFrame([("a", "c", "compound")], "a string, b string, kind string")
    assert {r["id"]: r["x"] for r in layout.nudge(p, e, 1).collect()} == {"a": 5.0, "b": 0.5, "c": 95.0}
    fitted = layout.world_fit(p).agg(F.max("x") - F.min("x")).first()[0]
    assert abs(fitted - 370) < 1e-9


def test_bands_and_checks(spark):
    rows = spark.createDataFrame([("g", i) for i in range(21)] + [("h", 1), ("h", 2)], "g string, m int")
    assert [tuple(r) for r in graph.co_members(rows, "g", "m", 2, 20).collect()] == [(1, 2)]
    assert validate.repeated(rows, "g", "x").count() == 2
    assert layout.scaled(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double"), ["a", "b"]).collect()[0]["b"] == 0.5
    assert search.bounded(5, 1, 10, "n") == 5


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("k", "2024-01-01 00:00:00"), ("k", "2024-01-01 00:00:30"), ("k", "2024-01-01 00:02:00")], "key string, ts string").select("key", F.to_timestamp("ts").alias("ts")).write.parquet(src)
    changes = streams.change_stream(spark, src, "key string, ts timestamp")
    q = streams.sync_to(changes, out, str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(out).count() == 3
    q = streams.cache_hits(streams.change_stream(spark, src, "key string, ts timestamp"), 60).writeStream.format("memory").queryName("hits").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["hit"] for r in spark.sql("SELECT hit FROM hits ORDER BY ts").collect()] == [False, True, False]


def test_without_the_optional_subpackage(tmp_path):
    """The library imports and registers its own queries when the training-data folders are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "stemforge", tmp_path / "stemforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    path = os.pathsep.join([str(tmp_path), *[p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and p != str(root)]])
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": path}, capture_output=True, text=True)
    assert said.returncode == 0 and said.stdout.split()[1] == "False", said.stderr
    shutil.copytree(root / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    ran = subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests/test_functions.py", "tests/test_plans.py::test_entry_runs"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": path}, capture_output=True, text=True)
    assert ran.returncode == 0, ran.stdout[-2000:]


def test_numbers_over_ranges(spark):
    from stemforge.operators.order import numbered

    rows = spark.range(500).select(((F.col("id") * 37) % 501).alias("k")).repartition(7)
    assert [r["n"] for r in numbered(rows, F.desc("k")).orderBy(F.desc("k")).collect()] == list(range(500))


def test_a_walk_of_many_starts(spark):
    """More rows than a recursive query may give by default."""
    edges = spark.range(3).select((F.col("id") + 1).alias("child"), F.col("id").alias("parent"))
    got = graph.ancestors(edges, spark.range(500_000).select((F.col("id") % 3 + 1).alias("node"))).groupBy("depth").count().collect()
    assert {r["depth"]: r["count"] for r in got} == {0: 500_000, 1: 500_000, 2: 333_333, 3: 166_666}
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string")
    assert graph.ancestors(ring, spark.createDataFrame([("a",)], "node string"), 4).count() == 5


def test_nearest_by_definition(spark):
    rng = random.Random(2)
    spots = [(i, rng.random() * 100, rng.random() * 3) for i in range(120)] + [(200 + i, 5.0, 1.0) for i in range(5)] + [(300, 9000.0, -50.0)]
    for points, k in ((spots, 3), (spots[:2], 3), (spots[:1], 3), ([(i, 1.0, 1.0) for i in range(6)], 2)):
        expected = set()
        for a, x, z in points:
            near = sorted((math.hypot(x - u, z - w), b) for b, u, w in points if b != a)[:k]
            expected |= {(a, r + 1, b, round(d, 9)) for r, (d, b) in enumerate(near)}
        got = layout.nearest(spark.createDataFrame(points, "id long, x double, z double"), k).collect()
        assert {(r["a"], r["rank"], r["b"], round(r["d"], 9)) for r in got} == expected
    assert layout.nearest(spark.createDataFrame([], "id long, x double, z double")).count() == 0


def test_distinct_by_is_not_quadratic(spark):
    rows = spark.range(4).select(F.transform(F.sequence(F.lit(0), F.lit(60_000)), lambda i: F.concat(F.when(i % 2 == 0, "W").otherwise("w"), (i % 20_000).cast("string"))).alias("a"))
    began = time.monotonic()
    got = rows.select(arrays.distinct_ci(F.col("a")).alias("d")).select(F.size("d").alias("n"), F.col("d")[0].alias("first")).collect()
    assert {tuple(r) for r in got} == {(20_000, "W0")} and time.monotonic() - began < 30
    odd = spark.createDataFrame([(["b", None, "B", "a", "A", "b"],), ([],), (None,)], "a array<string>")
    assert [r["d"] for r in odd.select(arrays.distinct_ci(F.col("a")).alias("d")).collect()] == [["b", "a"], [], None]


def test_responses(spark, tmp_path):
    hits = [
        {"ctx_": ["Der", [0, "Hund"], [1], {"x": 1}, "bellt", "."], "meta_": {"date_": "2001-02-03T00", "title": "T", "newspaper": "N"}},
        {"ctx_": ["x"], "meta_": {"title": "T", "textClass": "Z"}}, {"ctx_": [], "meta_": {}},
    ]
    (tmp_path / "r.json").write_text(json.dumps({"hits": hits}))
    got = readers.read_responses(spark, str(tmp_path / "r.json"), f"hits {arrays.HITS}").select(arrays.corpus_examples(F.col("hits")).alias("e")).first()["e"]
    assert [tuple(x) for x in got] == [("Der Hund bellt.", "N", "2001-02-03", None), ("x", "T", None, "Z")]
    marked = [{"ctx_": ["", [{"w": "Ein", "ws": "1"}, {"w": "Haus", "ws": "1"}, {"w": ".", "ws": "0"}], ""], "meta_": {"title": "T"}}, {"ctx_": ["a"], "meta_": {}}]
    (tmp_path / "m.json").write_text(json.dumps({"hits": marked, "corpus": "kern", "total": 7}))
    r = readers.read_responses(spark, str(tmp_path / "m.json"), f"hits {arrays.MARKED_HITS}, corpus string, total long").select(arrays.corpus_response(F.col("hits"), F.col("corpus"), F.col("total")).alias("r")).first()["r"]
    assert r["examples"][0]["sentence"] == "Ein Haus." and r["examples"][0]["source"] == "T" and tuple(r["stats"]) == ("kern", 7, 1)
    merged = spark.range(1).select(arrays.merged_corpora(F.sequence(F.lit(1), F.lit(12)), F.sequence(F.lit(21), F.lit(29))).alias("m")).first()["m"]
    assert merged == [*range(1, 11), *range(21, 26)]


def test_response_entries(spark):
    raw = [
        {"word": "Haus", "pos": "noun", "senses": [{"glosses": ["house"], "synonyms": ["Heim", {"word": "Bau"}]}], "forms": [{"form": "Häuser"}], "etymology_text": "A"},
        {"word": "Haus", "senses": [{"glosses": ["home"], "links": [["x", "y"]]}], "forms": [{"form": "Häuser"}, {"form": "Hauses"}], "etymology_text": "B", "sounds": [{"ipa": "haʊs"}]},
        {"word": "x"},
    ]
    lines = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(raw)] + [(9, "not json")], "ord int, value string")
    entries = records.response_entries(lines)
    assert entries.count() == 3 and entries.where("ord = 0").first()["senses"][0]["synonyms"] == ["Heim", "Bau"]
    got = {r["word"]: r for r in records.word_response(entries).collect()}
    assert got["Haus"]["etymology"] == "A; B" and [f["form"] for f in got["Haus"]["forms"]] == ["Häuser", "Hauses"] and len(got["Haus"]["senses"]) == 2 and got["x"]["etymology"] is None


def test_fragments():
    ex = '<div class="example"><span lang="de">Das <b>Haus</b></span> steht <i lang="en">it</i> stands</div>'
    assert text.parse_fragment('<font color="green">noun</font><span lang="en">house</span>') == ("noun", ["house"], [], [])
    # inside an example languages last until it closes, and English goes before German
    assert text.parse_fragment(ex) == ("", [], ["Das", "Haus", "steht"], ["it", "stands"])
    # whatever closes ends a translation
    assert text.parse_fragment('<span lang="en">a<i>b</i>c</span>') == ("", ["a", "b"], [], [])
    # an element without an end shifts what closes an example
    assert text.parse_fragment('<p class="example"><br><span lang="de">x</span></p><u lang="de">y</u>') == ("", [], ["x", "y"], [])
    assert text.parse_fragment(None) == ("", [], [], []) and text.parse_fragment("</b></b>z") == ("", [], [], [])


def test_small_operators(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 5), ("c", 5)], "k string, n int")
    assert [r["k"] for r in search.largest(rows, "n", 2, "k").collect()] == ["b", "c"]
    counted, seen = search.progress(rows, "load", {"big": F.col("n") > 1})
    sinks.dry_run(counted)
    assert seen.get == {"rows": 3, "big": 2}
    assert [r["plain"] for r in spark.createDataFrame([("Łódź Ĝő ǖ e\u0301",)], "s string").select(search.fold_accents(F.col("s")).alias("plain")).collect()] == ["łodz go u e"]
    found = [validate.repeated(rows, "n", "rows"), validate.missing(rows, "k", "k", "rows")]
    problems = validate.report(found)
    hard = problems.where("hard")
    assert hard.count() == 1 and validate.apart_from(problems, hard).count() == 0 and validate.apart_from(problems, hard.limit(0)).count() == 1
    assert {tuple(map(str, r)) for r in graph.sets_of(spark.createDataFrame([("f", "x"), ("f", "x"), ("f", "a")], "k string, m string"), "k", "m").collect()} == {("f", "['a', 'x']")}


def test_index_upkeep(spark):
    docs = spark.createDataFrame([(1, "Ein Haus"), (2, "ein Hof"), (3, "fort")], "id long, t string")
    index = search.token_index(docs, "id", "t")
    after = spark.createDataFrame([(1, "Ein Haus"), (2, "neues Haus"), (4, "Haus Haus")], "id long, t string")
    got = search.index_after(index, spark.createDataFrame([(2,), (3,), (4,)], "id long"), after.where("id in (2, 4)"), "id", "t")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, search.token_index(after, "id", "t").collect()))
    assert [r["id"] for r in search.token_search(got, ["haus", "neues"], "id").collect()] == [2]


def test_cache_stream_forgets(spark, tmp_path):
    """State goes when the watermark passes its expiry; the cache of a stream keeps the keys used last."""
    src = tmp_path / "in"
    for i, rows in enumerate([[("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:10")], [("c", "2024-01-01 05:00:00")], [("c", "2024-01-01 06:00:00"), ("a", "2024-01-01 06:00:01")]]):
        spark.createDataFrame(rows, "key string, ts string").select("key", F.to_timestamp("ts").alias("ts")).coalesce(1).write.mode("append").parquet(str(src))
        q = streams.cache_hits(streams.change_stream(spark, str(src), "key string, ts timestamp"), 60, "1 minute").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        q = streams.evict_stream(streams.change_stream(spark, str(src), "key string, ts timestamp"), 2, str(tmp_path / "lru"), str(tmp_path / "cp2"))
        q.awaitTermination()
        held = sorted(r["key"] for r in streams.held_keys(spark, str(tmp_path / "lru")).collect())
        assert held == [["a", "b"], ["b", "c"], ["a", "c"]][i]
    state = spark.read.format("statestore").load(str(tmp_path / "cp")).select("key.key", "value").collect()
    assert {r["key"] for r in state} <= {"a", "c"}


def test_windowed_counts(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("k", f"2024-01-01 {h}:0{m}:00") for h in ("00", "01", "05") for m in (1, 2)], "key string, ts string").select("key", F.to_timestamp("ts").alias("ts")).write.parquet(src)
    q = streams.windowed_counts(streams.change_stream(spark, src, "key string, ts timestamp"), "ts", "key").writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["n"] for r in spark.sql("SELECT n FROM windows ORDER BY window").collect()] == [2, 2]
