"""Rules of words, chains and records on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from stemforge.functions import arrays, etymology, geometry, morphology, text, vocab


def one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


@pytest.mark.parametrize(
    ("lemma", "pos", "expected"),
    [
        ("verstehen", "VERB", [("ver", "prefix"), ("steh", "root"), ("en", "suffix")]),
        ("Wasser", "NOUN", [("Wasser", "root")]),
        ("könig", "ADJ", [("könig", "root")]),
        ("freundlich", "ADJ", [("freund", "root"), ("lich", "suffix")]),
        ("Lehrer", "NOUN", [("lehr", "root"), ("er", "suffix")]),
        ("zurückgehen", "VERB", [("zurück", "prefix"), ("geh", "root"), ("en", "suffix")]),
        ("ab", "ADV", [("ab", "root")]),
    ],
)
def test_segments(spark, lemma, pos, expected):
    rows = morphology.with_segments(spark.createDataFrame([(lemma, pos)], "lemma string, pos string")).collect()
    assert [(s["form"], s["type"]) for s in rows[0]["segments"]] == expected


def test_keyword_quirks(spark):
    labels = [("pronoun",), ("Adverb",), ("female, noun",), ("neutrum adj",), ("",)]
    assert one(spark, labels, "s string", text.pos_keyword(F.col("s"))) == ["noun", "verb", "noun", "adjective", ""]
    assert one(spark, labels, "s string", text.gender_keyword(F.col("s"))) == [None, None, "m", "n", None]


def test_match_score(spark):
    rows = [("Haus", ""), ("Haustür", "a house door"), ("Maus", ""), ("xyz", None)]
    assert one(spark, rows, "lemma string, gloss string", text.match_score("haus", F.col("lemma"), F.col("gloss"))) == [1000, 300, 3, 0]
    assert one(spark, [("Größe", "")], "lemma string, gloss string", text.match_score("groesse", F.col("lemma"), F.col("gloss"))) == [1000]


def test_chain_keeps_first_of_a_stage_and_orders_by_depth(spark):
    t = [{"name": "inh", "args": {"2": "goh", "3": "hūs"}}, {"name": "inh", "args": {"2": "goh", "3": "hus"}}, {"name": "der", "args": {"2": "gem-pro", "3": "*hūsą, x"}}, {"name": "bor", "args": {"2": "la", "3": "casa"}}, {"name": "cog", "args": {"2": "en", "3": "house"}}, {"name": "inh", "args": {"2": "gmh", "3": "-"}}]
    df = spark.createDataFrame([("Haus", t)], "lemma string, t array<struct<name:string,args:map<string,string>>>")
    row = df.select(etymology.chain(F.col("t"), F.col("lemma")).alias("c"), etymology.cognates(F.col("t")).alias("g"), etymology.borrowing(F.col("t")).alias("b")).first()
    assert [(s["stage"], s["form"], s["is_reconstructed"]) for s in row["c"]] == [("gem-pro", "*hūsą", True), ("goh", "hūs", False), ("la", "casa", False), ("nhg", "Haus", False)]
    assert row["g"][0]["language"] == "English" and row["b"]["lang_code"] == "la"
    root = df.select(etymology.chain_root(etymology.chain(F.col("t"), F.col("lemma"))).alias("r")).first()["r"]
    assert (root["form"], root["lang"], root["lang_name"]) == ("hūsą", "gem-pro", "Proto-Germanic")


def test_text_root(spark):
    got = one(spark, [("From Proto-Germanic *hūsą",), ("mittelhochdeutsch a",), ("nothing",)], "s string", etymology.text_root(F.col("s")))
    assert (got[0]["form"], got[0]["proto_form"]) == ("hūsą", "*hūsą") and got[1] is None and got[2] is None


def test_arrays(spark):
    assert one(spark, [(["B", "b", "A", "B"],)], "a array<string>", arrays.distinct_ci(F.col("a"))) == [["B", "A"]]
    got = one(spark, [(["x", "", "z"], ["1", "2"])], "a array<string>, b array<string>", arrays.zip_short(F.col("a"), F.col("b")))
    assert [tuple(p) for p in got[0]] == [("x", "1")]
    merged = one(spark, [({"a": "1", "b": "2"}, {"b": "3"})], "a map<string,string>, b map<string,string>", arrays.merge_maps(F.col("a"), F.col("b")))
    assert merged == [{"a": "1", "b": "3"}]
    points = one(spark, [([("1900", "2.345"), ("1400", "1"), ("x", "1"), ("1950", None)],)], "p array<struct<year:string,f:string>>", arrays.frequency_points(F.col("p")))
    assert [tuple(p) for p in points[0]] == [(1900, 2.35)]


def test_strings(spark):
    assert one(spark, [("a b/c~*ä",)], "s string", text.quote_url(F.col("s"))) == ["a%20b/c~%2A%C3%A4"]
    assert one(spark, [("auto bahn-Hof",)], "s string", text.capitalised(F.col("s"))) == ["Auto bahn-hof"]
    assert one(spark, [('["a","b"]',), ('"x"',), ("plain",), (None,)], "s string", text.listed(F.col("s"))) == [["a", "b"], ["x"], ["plain"], []]
    assert one(spark, [("Substantiv, Neutrum",)], "s string", text.german_gender(F.col("s"))) == ["n"]
    assert one(spark, [("x",), ("1x",), ("xy",), ("x(y)",)], "s string", text.token_ok(F.col("s"))) == [False, False, True, False]
    assert one(spark, [("Proper Noun",), ("zzz",)], "s string", vocab.record_upos(F.col("s"))) == ["NOUN", "X"]


def test_html_fragment():
    html = '<font color="green">noun, masculine</font><span lang="en">house</span><div class="example"><span lang="de">im Haus</span><span lang="en">in the house</span></div><span lang="en">home</span>'
    assert text.parse_fragment(html) == ("noun, masculine", ["house", "home"], ["im Haus"], ["in the house"])


def test_noise_is_zero_on_the_lattice(spark):
    got = spark.range(5).select(geometry.noise(F.col("id").cast("double"), F.lit(3.0)).alias("v"), geometry.fractal_noise(F.col("id") * 0.3, F.lit(0.7)).alias("f")).collect()
    assert all(abs(r["v"]) < 1e-12 and abs(r["f"]) <= 1 for r in got)
    assert sorted(geometry.permutation()) == list(range(256))
