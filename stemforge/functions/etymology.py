"""Stage chains from template arrays, roots from free text, edges of a chain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import distinct_by, first
from .text import WORD_CHARS, clean_form, stage_key
from .vocab import MODERN, MODERN_NAME, NO_FORMS, STAGE_NAMES, stage_depth, stage_name

# Template names of inheritance and of borrowing.
INHERITED = ["inh", "inh+", "der"]
BORROWED = ["bor", "bor+", "lbor", "slbor"]

# Patterns for a root in free text, tried in this order, with the stage each stands for.
_W = WORD_CHARS[:-1] + "-]"
TEXT_PATTERNS = [
    (rf"(?i)Proto-Germanic\s+\*?({_W}+)", "gem-pro"),
    (rf"(?i)(?:ur|proto-?)?germanisch\s+\*?({_W}+)", "gem-pro"),
    (rf"(?i)Old High German\s+({_W}+)", "goh"),
    (rf"(?i)althochdeutsch\s+({_W}+)", "goh"),
    (rf"(?i)Middle High German\s+({_W}+)", "gmh"),
    (rf"(?i)mittelhochdeutsch\s+({_W}+)", "gmh"),
    (rf"(?i)(?:from\s+(?:Medieval\s+)?)?Latin\s+({_W}+)", "la"),
    (rf"(?i)(?:mittel)?lateinisch\s+({_W}+)", "la"),
]


def _kept(templates: Column) -> Column:
    """Templates with a language and a form that counts: name, stage, form."""

    def one(t: Column) -> Column:
        form = F.coalesce(F.nullif(t["args"]["3"], F.lit("")), F.nullif(t["args"]["alt"], F.lit("")))
        return F.struct(t["name"].alias("name"), F.nullif(t["args"]["2"], F.lit("")).alias("stage"), clean_form(form).alias("form"))

    return F.filter(F.transform(templates, one), lambda t: t["stage"].isNotNull() & t["form"].isNotNull())


def _stage(stage: Column, form: Column, name: Column) -> Column:
    return F.struct(stage.alias("stage"), form.alias("form"), name.alias("lang_name"), form.startswith("*").alias("is_reconstructed"))


def chain(templates: Column, lemma: Column) -> Column:
    """Stages oldest first, the first of each stage, the modern one last; stages without a depth precede it."""
    lines = F.filter(_kept(templates), lambda t: t["name"].isin(INHERITED + BORROWED))
    ranked = F.array_sort(F.transform(lines, lambda t, i: F.struct(stage_depth(t["stage"]).alias("d"), i.alias("i"), t["stage"].alias("stage"), t["form"].alias("form"))))
    old = F.transform(distinct_by(ranked, lambda t: t["stage"]), lambda t: _stage(t["stage"], t["form"], stage_name(t["stage"])))
    modern = F.struct(F.lit(MODERN).alias("stage"), lemma.alias("form"), F.lit(MODERN_NAME).alias("lang_name"), F.lit(False).alias("is_reconstructed"))
    return F.concat(old, F.array(modern))


def cognates(templates: Column, limit: int = 6) -> Column:
    return F.slice(F.transform(F.filter(_kept(templates), lambda t: t["name"] == "cog"), lambda t: F.struct(stage_name(t["stage"]).alias("language"), t["form"].alias("form"))), 1, limit)


def borrowing(templates: Column) -> Column:
    """The last borrowing that is named."""
    found = F.filter(_kept(templates), lambda t: t["name"].isin(BORROWED))
    last = F.try_element_at(found, F.lit(-1))
    return F.when(last.isNotNull(), F.struct(stage_name(last["stage"]).alias("from_lang"), last["form"].alias("form"), last["stage"].alias("lang_code")))


def _root(form: Column, proto: Column, lang: Column) -> Column:
    return F.struct(form.alias("form"), proto.alias("proto_form"), lang.alias("lang"), stage_name(lang).alias("lang_name"))


def chain_root(stages: Column) -> Column:
    """The first stage of a chain that has more than the modern one."""
    deep = first(stages)
    return F.when(F.size(stages) > 1, _root(F.trim(F.ltrim(deep["form"], F.lit("*"))), deep["form"], deep["stage"]))


def text_root(text: Column) -> Column:
    """The first pattern that matches with a form of two characters or more; reconstructed stages get a star."""
    rules = []
    for pattern, stage in TEXT_PATTERNS:
        form = F.trim(F.regexp_extract(text, pattern, 1), F.lit("*,. "))
        proto = F.concat(F.lit("*"), form) if stage in ("gem-pro", "ine-pro") else form
        rules.append(F.when(text.rlike(pattern) & (F.length(form) > 1) & ~form.isin(NO_FORMS), F.struct(form.alias("form"), proto.alias("proto_form"), F.lit(stage).alias("lang"), F.lit(STAGE_NAMES[stage]).alias("lang_name"))))
    return F.coalesce(*rules)


def chain_edges(stages: Column, borrowed_code: Column) -> Column:
    """[{newer, older, edge_type}] of neighbouring stages; equal ids give no edge."""
    ids = F.transform(stages, lambda s: stage_key(s["stage"], s["form"]))
    n = F.size(ids)
    pairs = F.zip_with(F.slice(ids, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(ids, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda new, old: F.struct(new.alias("newer"), old.alias("older"), F.when(old.startswith(F.concat(borrowed_code, F.lit(":"))), "borrowed_from").otherwise("descends_from").alias("edge_type")))
    return F.filter(pairs, lambda p: p["newer"] != p["older"])


def shown(stages: Column) -> Column:
    """Whether a chain is worth showing: some stage is not the modern one."""
    return F.exists(stages, lambda s: s["stage"] != MODERN)
