"""Small functions and operators that no registered query needs, each by its rule."""

from pyspark.sql import functions as F

from stemforge.functions import arrays, etymology, text
from stemforge.operators import clustering, graph, layout, records, search
from stemforge.sources import readers


def one(spark, value, **columns):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]) if columns else spark.range(1)
    return row.select(value.alias("v")).first()["v"]


def test_text_rules(spark):
    assert one(spark, text.record_url("https://h", "de", F.col("w")), w="Häuser") == "https://h/de/meaning/H/Hä/H%C3%A4user.jsonl"
    assert one(spark, text.german_pos(F.col("w")), w="Substantiv, Neutrum") == "NOUN" and one(spark, text.german_pos(F.col("w")), w="?") is None
    assert one(spark, text.german_gender(F.col("w")), w="Substantiv, sonst, Neutrum") == "n" and one(spark, text.german_gender(F.col("w")), w="Substantiv") is None
    assert one(spark, text.hyphenated(F.array(F.lit("Hau"), F.lit("ser")))) == "Hau·ser" and one(spark, text.hyphenated(F.array().cast("array<string>"))) is None
    defs = "array<struct<nr:string,text:string,labels:array<string>>>"
    assert one(spark, text.german_definition(F.from_json(F.col("d"), defs)), d='[{"text":"' + "x" * 200 + '"}]') == "x" * 150
    assert one(spark, text.german_definition(F.from_json(F.col("d"), defs)), d="[]") == ""
    assert one(spark, arrays.json_length(F.col("j")), j="[1,2]") == 2 and one(spark, arrays.json_length(F.col("j")), j="no") == 0
    assert one(spark, arrays.spaced_sentence(F.from_json(F.col("t"), "array<struct<w:string,ws:string>>")), t='[{"w":"Ein","ws":"1"},{"w":"Hof","ws":"1"},{"w":"!","ws":"0"}]') == "Ein Hof!"


def test_degrees(spark):
    heads = F.from_json(F.col("h"), "array<struct<name:string,args:map<string,string>,expansion:string>>")
    assert one(spark, records.comparative(heads), h='[{"name":"de-adj","args":{},"expansion":"alt (comparative älter, superlative am ältesten)"}]') == "älter"
    assert one(spark, records.comparative(heads), h='[{"name":"de-adj","args":{"comp":"besser"},"expansion":""}]') == "besser"


def test_chains_and_compounds(spark):
    stages = "array<struct<stage:string,form:string>>"
    assert one(spark, etymology.shown(F.from_json(F.col("s"), stages)), s='[{"stage":"nhg"},{"stage":"goh"}]') is True
    assert one(spark, etymology.shown(F.from_json(F.col("s"), stages)), s='[{"stage":"nhg"}]') is False
    found = F.from_json(F.col("c"), "array<struct<compound_wort_id:string,split_display:string>>")
    assert one(spark, clustering.word_of(found, F.lit("b"))["split_display"], c='[{"compound_wort_id":"a","split_display":"1"},{"compound_wort_id":"b","split_display":"2"}]') == "2"


def test_lookups(spark, tmp_path):
    forms = spark.createDataFrame([("x", "a"), ("y", "a"), ("z", "b")], "form string, entry_id string")
    assert [r["form"] for r in search.forms_of(forms, spark.createDataFrame([("a",), ("a",)], "id string")).collect()] == ["x", "y"]
    spark.createDataFrame([("Haus|NOUN", "Haus")], "id string, lemma string").write.parquet(str(tmp_path / "e"))
    assert readers.read_entries(spark, str(tmp_path / "e")).select("lemma", "synonyms").first() == ("Haus", None)
    rows = spark.createDataFrame([(i, "c" + str(i), i % 3) for i in range(7)], "first_ord int, root_key string, size int")
    assert [r["first_ord"] for r in clustering.capped(rows, 3).collect()] == [2, 5, 1]


def test_graph_tables(spark):
    entries = spark.createDataFrame([("a|X", "a", 0, ["b", "zz"], []), ("b|X", "b", 1, ["b"], ["a"]), ("b|Y", "b", 2, [], [])], "id string, lemma string, ord int, synonyms array<string>, antonyms array<string>").withColumns({"hypernyms": F.array().cast("array<string>"), "hyponyms": F.array().cast("array<string>")})
    assert {tuple(r) for r in graph.semantic_edges(entries).collect()} == {("a|X", "b|Y", "synonym_of"), ("b|X", "b|Y", "synonym_of"), ("b|X", "a|X", "antonym_of")}
    words = spark.createDataFrame([(1, ["Haus", "tür"])], "id long, parts array<string>")
    lexicon = spark.createDataFrame([("Haus", 7, 0), ("Tür", 8, 1), ("Haus", 9, 2)], "lemma string, id long, ord int")
    assert clustering.compound_links(words, lexicon).first()["components"] == [9, 8]


def test_terrain_and_places(spark):
    grid = spark.createDataFrame([(0.0, 0.0), (200.0, 200.0)], "x double, z double")
    islands = spark.createDataFrame([(0.0, 0.0, 10.0, 4.0)], "x double, z double, height double, radius double")
    got = {(r["x"], r["z"]): r["height"] for r in layout.terrain(grid, islands).collect()}
    assert abs(got[(0.0, 0.0)] - 10) <= 0.8 and abs(got[(200.0, 200.0)] + 0.3) <= 0.3
    placed = layout.world_place(spark.createDataFrame([(0.0, 5.0, 1.0), (2.0, 7.0, 3.0)], "x double, z double, height double")).collect()
    assert [(r["x"], r["z"], r["height"]) for r in placed] == [(-200.0, -200.0, 0.0), (200.0, 200.0, 12.0)]
    bare = spark.createDataFrame([(1, 3.0, 4.0), (2, None, None), (3, None, None)], "id int, x double, z double")
    assert {r["id"]: (r["x"], r["z"]) for r in layout.fallback_positions(bare, F.col("id")).collect()}[1] == (3.0, 4.0)
