"""String rules: keys, keyword ladders, cleaning, matching, definitions."""

from __future__ import annotations

import html.parser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vocab import GERMAN_GENDER, GERMAN_POS, NO_FORMS, lookup

WORD_CHARS = r"[\p{L}\p{M}\p{N}_]"


# --- keys and urls --------------------------------------------------------------------------------


def entry_key(lemma: Column, pos: Column) -> Column:
    return F.concat_ws("|", lemma, pos)


def stage_key(stage: Column, form: Column) -> Column:
    return F.concat_ws(":", stage, form)


def field_key(name: Column) -> Column:
    return F.concat(F.lit("field:"), F.replace(F.lower(name), F.lit(" "), F.lit("_")))


def cognate_key(language: Column, form: Column) -> Column:
    return F.concat_ws(":", F.lit("cog"), F.lower(language), form)


def quote_url(s: Column) -> Column:
    """Percent-encoding that keeps letters, digits and / _ . - ~ as they are."""
    out = F.url_encode(s)
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A"), ("%2F", "/")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def source_url(base: str, s: Column) -> Column:
    return F.concat(F.lit(base), quote_url(s))


def record_url(base: str, lang: str, word: Column) -> Column:
    """Landing path of a word's record: base/lang/meaning/first letter/first two/word.jsonl."""
    return F.concat(F.lit(f"{base}/{lang}/meaning/"), F.left(word, F.lit(1)), F.lit("/"), F.left(word, F.lit(2)), F.lit("/"), quote_url(word), F.lit(".jsonl"))


# --- keyword ladders ------------------------------------------------------------------------------


def _first_of(s: Column, rules: list[tuple[str, list[str]]], default: Column) -> Column:
    out = F.coalesce(*[F.when(F.greatest(*[s.contains(w) for w in words], F.lit(False)), F.lit(value)) for value, words in rules], default)
    return out


# Keywords of each class, in order. Order decides: "pronoun" holds "noun" and "adverb" holds "verb", so both take the earlier value.
POS_RULES = [
    ("noun", ["noun"]), ("verb", ["verb"]), ("adjective", ["adj"]), ("adverb", ["adv"]), ("preposition", ["prep"]),
    ("conjunction", ["conj"]), ("pronoun", ["pron"]), ("article", ["article", "art."]),
]
GENDER_RULES = [("m", ["maskulin", "masculine", "male, noun"]), ("f", ["feminin", "feminine", "female"]), ("n", ["neuter", "neutrum"])]


def pos_keyword(raw: Column) -> Column:
    return _first_of(F.lower(raw), POS_RULES, F.lit(""))


def gender_keyword(raw: Column) -> Column:
    return _first_of(F.lower(raw), GENDER_RULES, F.lit(None).cast("string"))


def german_pos(label: Column) -> Column:
    """Universal tag of "Substantiv, Neutrum"."""
    return lookup(GERMAN_POS, F.trim(F.split(label, ",")[0]))


def german_gender(label: Column, genus: Column | None = None) -> Column:
    """Gender named after the first comma of the label; a separate genus field goes first."""
    after = F.filter(F.transform(F.slice(F.split(label, ","), F.lit(2), F.size(F.split(label, ","))), lambda p: lookup(GERMAN_GENDER, F.trim(p))), lambda g: g.isNotNull())
    found = F.try_element_at(after, F.lit(1))
    return found if genus is None else F.coalesce(lookup(GERMAN_GENDER, genus), found)


# --- cleaning -------------------------------------------------------------------------------------


def squash_space(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def tidy_punctuation(s: Column) -> Column:
    return F.regexp_replace(s, r"\s+([.,;:!?])", "$1")


def date_prefix(s: Column) -> Column:
    return F.left(s, F.lit(10))


def hyphenated(parts: Column) -> Column:
    """Array of syllables as one word with middle dots; null if there are none."""
    return F.when(F.size(parts) > 0, F.array_join(parts, "·"))


def listed(raw_json: Column) -> Column:
    """A JSON text that holds a string or an array of strings, as an array."""
    v = F.trim(raw_json)
    scalar = F.when(v.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")).otherwise(v)
    return F.when(v.isNull() | (v == "null"), F.array().cast("array<string>")).when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(scalar))


def scalar(raw_json: Column) -> Column:
    """A JSON text that holds a string or an array, as one string; null if empty."""
    joined = F.array_join(F.filter(listed(raw_json), lambda x: x != ""), " ")
    return F.nullif(joined, F.lit(""))


def clean_form(raw: Column) -> Column:
    """Form before the first comma, trimmed; null if it stands for no form."""
    form = F.trim(F.split(raw, ",")[0])
    return F.when(~F.coalesce(F.trim(form, F.lit("*. ")), F.lit("")).isin(NO_FORMS), form)


def capitalised(s: Column) -> Column:
    """First letter upper, all others lower; spaces and hyphens start nothing."""
    return F.concat(F.upper(F.left(s, F.lit(1))), F.lower(F.substr(s, F.lit(2))))


def stem_key(s: Column, n: int = 4) -> Column:
    return F.lower(F.left(s, F.lit(n)))


def escape_html(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


# --- predicates -----------------------------------------------------------------------------------


def token_ok(s: Column) -> Column:
    """2 to 60 characters, beginning with a letter or underscore, without brackets."""
    return F.length(s).between(2, 60) & s.rlike(r"^[\p{L}\p{No}\p{Nl}_]") & ~s.rlike(r"[()\[\]{}]")


def gloss_ok(s: Column) -> Column:
    """A gloss that says something: not empty, under 200 characters, not a reference to another form."""
    low = F.lower(F.trim(s))
    return (low != "") & (F.length(s) < 200) & ~low.contains("form of") & ~low.contains("inflection of")


def definition(senses: Column, translations: Column) -> Column:
    """First two good glosses of the first of three senses that has any, else a translation cut to 100."""
    good = F.filter(F.transform(F.slice(senses, 1, 3), lambda s: F.filter(s["glosses"], gloss_ok)), lambda g: F.size(g) > 0)
    chosen = F.try_element_at(good, F.lit(1))
    return F.coalesce(F.array_join(F.slice(chosen, 1, 2), "; "), F.left(F.try_element_at(translations, F.lit(1)), F.lit(100)), F.lit(""))


def german_definition(definitions: Column) -> Column:
    return F.coalesce(F.left(F.try_element_at(definitions, F.lit(1))["text"], F.lit(150)), F.lit(""))


def ascii_fold_case(s: Column) -> Column:
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prefix_like(s: Column, pattern: str) -> Column:
    """`s LIKE pattern%` where only ASCII letters ignore case and the user's wildcards work."""
    return ascii_fold_case(s).like("".join(c.lower() if c.isascii() else c for c in pattern) + "%")


# --- search ---------------------------------------------------------------------------------------

# Digraphs and the letters they stand for.
DIGRAPHS = [("ae", "ä"), ("oe", "ö"), ("ue", "ü"), ("ss", "ß")]


def with_umlauts(s: Column) -> Column:
    s = F.lower(s)
    for a, b in DIGRAPHS:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def without_umlauts(s: Column) -> Column:
    s = F.lower(s)
    for a, b in DIGRAPHS:
        s = F.replace(s, F.lit(b), F.lit(a))
    return s


def match_score(query: str, lemma: Column, gloss: Column) -> Column:
    """Exact 1000; prefix 200 and containment 100; else 1 for each letter found in order; gloss 20 more."""
    q, plain = with_umlauts(F.lit(query)), without_umlauts(F.lit(query))
    low, bare = F.lower(lemma), without_umlauts(lemma)
    base = F.when(low.startswith(q) | bare.startswith(plain), 200).otherwise(0) + F.when(low.contains(q) | bare.contains(plain), 100).otherwise(0)

    def step(acc: Column, ch: Column) -> Column:
        at = F.call_function("locate", ch, low, acc["at"])
        return F.struct(F.when(at > 0, at + 1).otherwise(acc["at"]).alias("at"), (acc["hits"] + (at > 0).cast("int")).alias("hits"))

    letters = F.filter(F.split(q, ""), lambda c: c != "")
    greedy = F.aggregate(letters, F.struct(F.lit(1).alias("at"), F.lit(0).alias("hits")), step, lambda acc: acc["hits"])
    text = F.lower(F.coalesce(gloss, F.lit("")))
    return F.when((low == q) | (bare == plain), F.lit(1000)).otherwise(F.when(base > 0, base).otherwise(greedy) + F.when(text.contains(q) | text.contains(plain), 20).otherwise(0))


# --- html fragments -------------------------------------------------------------------------------


class _Events(html.parser.HTMLParser):
    """The fragment as a list of events: ("open", tag, attributes), ("close",) and ("text", text)."""

    def __init__(self, fragment: str):
        super().__init__()
        self.events: list[tuple] = []
        self.feed(fragment)

    def handle_starttag(self, tag, attrs):
        self.events.append(("open", tag, dict(attrs)))

    def handle_endtag(self, tag):
        self.events.append(("close",))

    def handle_data(self, data):
        self.events.append(("text", data.strip()))


def parse_fragment(text: str | None) -> tuple[str, list[str], list[str], list[str]]:
    """(part of speech, translations, German examples, English examples) of a dictionary article.

    Green type is the part of speech. Inside an example, text belongs to the languages named in it so far,
    English before German; outside, English text is a translation. Elements are a stack: each remembers
    whether it is the example in force. Whatever closes ends a part of speech or a translation; that of the
    example ends its languages.
    """
    found: dict[str, list[str]] = {"pos": [], "en": [], "de": [], "translation": []}
    elements: list[bool] = []
    spoken: list[str] = []  # languages of the example in force
    marks: list[str] = []  # what text is until something closes
    for event in _Events(text or "").events:
        match event:
            case ("open", tag, given):
                if given.get("class") == "example":
                    elements = [False] * len(elements) + [True]
                else:
                    elements.append(False)
                lang = given.get("lang")
                if any(elements):
                    spoken += [lang] if lang in ("en", "de") else []
                elif lang == "en":
                    marks.append("translation")
                if (tag, given.get("color")) == ("font", "green"):
                    marks.append("pos")
            case ("close",):
                if elements and elements.pop():
                    spoken = []
                marks = []
            case ("text", words) if words:
                role = next((r for r in found if r in spoken or r in marks), None)
                if role:
                    found[role].append(words)
    return " ".join(found["pos"]), found["translation"], found["de"], found["en"]


_TEXTS = T.ArrayType(T.StringType())
FRAGMENT = T.StructType([T.StructField("pos", T.StringType()), T.StructField("translations", _TEXTS), T.StructField("examples_de", _TEXTS), T.StructField("examples_en", _TEXTS)])


@F.pandas_udf(FRAGMENT)
def html_fragment(texts: pd.Series) -> pd.DataFrame:
    """Dictionary article in HTML: a nested state machine, so a vectorised Python UDF."""
    return pd.DataFrame([parse_fragment(t) for t in texts], columns=["pos", "translations", "examples_de", "examples_en"])
