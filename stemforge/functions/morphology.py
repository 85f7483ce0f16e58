"""Prefix and suffix decomposition, compounds, and what follows from segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WORD_CHARS

# Affix inventories.
INSEPARABLE = ["be", "emp", "ent", "er", "ge", "miss", "ver", "zer", "hinter", "wider", "über", "unter", "durch", "um"]
SEPARABLE = [
    "ab", "an", "auf", "aus", "bei", "ein", "mit", "nach", "vor", "weg", "zu", "zurück", "fest", "frei", "her", "hin",
    "los", "ran", "rein", "raus", "rüber", "rum", "runter", "rauf", "hoch",
]
SUFFIXES = {
    "NOUN": {
        "ierung": "→ NOUN (f)", "schaft": "→ NOUN (f)", "heit": "→ NOUN (f)", "keit": "→ NOUN (f)", "ling": "→ NOUN (m)",
        "chen": "→ NOUN (n, diminutive)", "lein": "→ NOUN (n, diminutive)", "ung": "→ NOUN (f)", "nis": "→ NOUN", "tum": "→ NOUN (n)",
    },
    "ADJ": {
        "isch": "→ ADJ", "lich": "→ ADJ", "haft": "→ ADJ", "sam": "→ ADJ", "bar": "→ ADJ (capable of)",
        "voll": "→ ADJ (full of)", "los": "→ ADJ (without)", "ig": "→ ADJ",
    },
    "VERB": {
        "ieren": "infinitive (foreign-origin)", "eln": "infinitive (frequentative)", "ern": "infinitive (frequentative)",
        "en": "infinitive", "n": "infinitive",
    },
}
# The agent suffix with its function, and words that keep what looks like a suffix.
AGENT = ("er", "→ NOUN (m, agent/tool)")
KEEP_ER = [
    "wasser", "fenster", "butter", "winter", "sommer", "wetter", "zimmer", "hammer", "muster", "alter", "kloster",
    "lager", "meter", "bier", "finger", "mutter", "vater", "bruder", "schwester", "leiter", "computer", "theater",
    "charakter", "semester", "register",
]
KEEP_IG = ["könig", "honig", "essig"]


def longest_first(items) -> list[str]:
    return sorted(items, key=len, reverse=True)


PREFIXES = longest_first(INSEPARABLE + SEPARABLE)


def prefix_of(word: Column) -> Column:
    """Longest known prefix that leaves three characters or more, else null."""
    return F.coalesce(*[F.when(word.startswith(p) & (F.length(word) > len(p) + 2), F.lit(p)) for p in PREFIXES])


def suffix_of(rest: Column, lemma: Column, pos: Column) -> Column:
    """Longest suffix of the word class that leaves two characters or more, else null. `rest` has no prefix."""
    low = F.lower(lemma)
    rules = []
    for tag, table in SUFFIXES.items():
        for s in longest_first(table):
            ok = (pos == tag) & rest.endswith(s) & (F.length(rest) > len(s) + 1)
            rules.append(F.when(ok & ~low.isin(KEEP_IG) if s == "ig" else ok, F.lit(s)))
    agent = (pos == "NOUN") & rest.endswith(AGENT[0]) & (F.length(rest) > 4) & ~low.isin(KEEP_ER)
    return F.coalesce(*rules, F.when(agent, F.lit(AGENT[0])))


def suffix_function(suffix: Column, pos: Column) -> Column:
    table = F.create_map(*[F.lit(x) for tag, t in SUFFIXES.items() for s, f in t.items() for x in (f"{tag}:{s}", f)], F.lit(f"NOUN:{AGENT[0]}"), F.lit(AGENT[1]))
    return table[F.concat_ws(":", pos, suffix)]


def _segment(form: Column, kind: str, function: Column) -> Column:
    return F.struct(form.alias("form"), F.lit(kind).alias("type"), function.alias("function"))


def with_segments(rows: DataFrame, lemma: str = "lemma", pos: str = "pos", out: str = "segments") -> DataFrame:
    """Adds [{form, type, function}]: prefix, root, suffix as found; a word that does not split is its own root.

    Each step is a column of its own, so that the long rules are evaluated once a row.
    """
    word, tag = F.col(lemma), F.col(pos)
    rows = rows.withColumn("__prefix", prefix_of(F.lower(word)))
    rows = rows.withColumn("__rest", F.substr(F.lower(word), F.coalesce(F.length("__prefix"), F.lit(0)) + 1))
    rows = rows.withColumn("__suffix", suffix_of(F.col("__rest"), word, tag))
    prefix, rest, suffix = F.col("__prefix"), F.col("__rest"), F.col("__suffix")
    root = F.left(rest, F.length(rest) - F.coalesce(F.length(suffix), F.lit(0)))
    split = F.array_compact(
        F.array(
            F.when(prefix.isNotNull(), _segment(prefix, "prefix", F.when(prefix.isin(SEPARABLE), "separable").otherwise("inseparable"))),
            F.when(root != "", _segment(root, "root", F.lit(""))),
            F.when(suffix.isNotNull(), _segment(suffix, "suffix", suffix_function(suffix, tag))),
        )
    )
    found = F.when(prefix.isNull() & suffix.isNull(), F.array(_segment(word, "root", F.lit("")))).otherwise(split)
    return rows.withColumn(out, found).drop("__prefix", "__rest", "__suffix")


def formation_type(segs: Column) -> Column:
    kinds = F.transform(segs, lambda s: s["type"])
    p, s = F.array_contains(kinds, "prefix"), F.array_contains(kinds, "suffix")
    return F.when(p & s & (F.size(segs) == 3), "circumfixation").when(p & s, "prefixation+suffixation").when(p, "prefixation").when(s, "suffixation").otherwise("simplex")


# Prefixes of the affix table that separate and those that never do.
AFFIX_SEPARABLE = ["ab", "an", "auf", "aus", "bei", "durch", "ein", "mit", "nach", "über", "um", "unter", "vor", "weg", "zu", "zurück"]
AFFIX_INSEPARABLE = ["be", "emp", "ent", "er", "ge", "miss", "ver", "zer", "hinter"]


def affix_separable(kind: Column, form: Column, separable: list[str] = AFFIX_SEPARABLE, inseparable: list[str] = AFFIX_INSEPARABLE) -> Column:
    """True, false, or null for suffixes and prefixes of neither list."""
    return F.when((kind == "prefix") & form.isin(separable), F.lit(True)).when((kind == "prefix") & form.isin(inseparable), F.lit(False))


def compound_parts(templates: Column, etymology_text: Column) -> Column:
    """Arguments 2 to 9 of the first compound template with two parts or more, else `a + b` at the text's start."""

    def parts(t: Column) -> Column:
        return F.filter(F.array(*[F.trim(F.coalesce(t["args"][str(i)], F.lit(""))) for i in range(2, 10)]), lambda p: p != "")

    named = F.filter(F.transform(F.filter(templates, lambda t: t["name"] == "compound"), parts), lambda p: F.size(p) >= 2)
    pattern = rf"^({WORD_CHARS}+)\s*\+\s*({WORD_CHARS}+)"
    text = F.when(etymology_text.rlike(pattern), F.array(F.regexp_extract(etymology_text, pattern, 1), F.regexp_extract(etymology_text, pattern, 2)))
    return F.coalesce(F.try_element_at(named, F.lit(1)), text)
