"""Closed vocabularies as fixed values, and literal lookups over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Part-of-speech names of the dictionary records and their universal tags.
RECORD_POS = {
    "noun": "NOUN", "name": "NOUN", "proper noun": "NOUN", "verb": "VERB", "adj": "ADJ", "adjective": "ADJ",
    "adv": "ADV", "adverb": "ADV", "prep": "ADP", "preposition": "ADP", "conj": "CONJ", "conjunction": "CONJ",
    "det": "DET", "article": "DET", "num": "NUM", "numeral": "NUM", "pron": "PRON", "pronoun": "PRON",
    "intj": "INTJ", "interjection": "INTJ", "particle": "PART", "affix": "X", "phrase": "X", "proverb": "X",
    "character": "X", "symbol": "X",
}
BASE_POS = {
    "noun": "NOUN", "verb": "VERB", "adjective": "ADJ", "adverb": "ADV", "preposition": "ADP",
    "conjunction": "CONJ", "article": "DET", "pronoun": "PRON", "": "X",
}
GERMAN_POS = {
    "Substantiv": "NOUN", "Verb": "VERB", "Adjektiv": "ADJ", "Adverb": "ADV", "Präposition": "ADP",
    "Konjunktion": "CONJ", "Artikel": "DET", "Pronomen": "PRON", "Numerale": "NUM", "Interjektion": "INTJ",
    "Partikel": "PART",
}
GERMAN_GENDER = {"Maskulinum": "m", "Femininum": "f", "Neutrum": "n"}
LEVELS = ["A1", "A2", "B1", "B2", "C1", "C2"]

# Language stages, those with a depth from oldest to newest, and forms that stand for no form.
STAGE_NAMES = {
    "ine-pro": "PIE", "gem-pro": "Proto-Germanic", "gmw-pro": "Proto-West-Germanic", "got": "Gothic",
    "osx": "Old Saxon", "ang": "Old English", "goh": "OHG", "gmh": "MHG", "nds": "Low German", "non": "Old Norse",
    "la": "Latin", "grc": "Ancient Greek", "fro": "Old French", "fr": "French", "it": "Italian", "es": "Spanish",
    "ar": "Arabic", "hu": "Hungarian", "en": "English", "nl": "Dutch", "sv": "Swedish", "da": "Danish", "yi": "Yiddish",
}
STAGE_DEPTH = ["ine-pro", "gem-pro", "gmw-pro", "got", "osx", "ang", "goh", "gmh", "nds", "non"]
MODERN = "nhg"
MODERN_NAME = "Modern German"
NO_FORMS = ["-", "?", "", "—", "–", ".", ",", "/", "·", "*"]

# Register tags kept as usage labels.
REGISTER_TAGS = ["colloquial", "formal", "archaic", "poetic", "literary", "dialectal", "offensive", "vulgar", "dated", "rare", "technical", "humorous"]


def lookup(table: dict[str, str], key: Column, default: Column | None = None) -> Column:
    """Value of `key` in a small fixed table, else `default` (null if none)."""
    found = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]
    return found if default is None else F.coalesce(found, default)


def record_upos(raw: Column) -> Column:
    return lookup(RECORD_POS, F.trim(F.lower(raw)), F.lit("X"))


def base_upos(raw: Column) -> Column:
    return lookup(BASE_POS, F.trim(F.lower(raw)), F.lit("X"))


def stage_name(code: Column) -> Column:
    return lookup(STAGE_NAMES, code, code)


def stage_depth(code: Column) -> Column:
    """Rank of a stage, oldest first; stages without a depth come last."""
    return lookup({s: str(i) for i, s in enumerate(STAGE_DEPTH)}, code, F.lit(str(len(STAGE_DEPTH)))).cast("int")
