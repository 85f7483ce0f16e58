"""Canonical schemas of the relational outputs."""

from __future__ import annotations

STRINGS = "array<string>"
TEMPLATES = "array<struct<name:string,args:map<string,string>>>"
EXAMPLE = "struct<de:string,en:string>"
SENSE_IN = (
    "struct<glosses:array<string>,tags:array<string>,topics:array<string>,qualifiers:array<string>,form_of:array<struct<word:string>>,"
    "examples:array<struct<text:string,english:string>>,synonyms:array<struct<word:string>>,antonyms:array<struct<word:string>>,"
    "hypernyms:array<struct<word:string>>,hyponyms:array<struct<word:string>>,derived:array<struct<word:string>>,related:array<struct<word:string>>>"
)
#: A dictionary record; fields that may be a string or a list are kept as JSON text.
RECORD = (
    f"word string, pos string, senses array<{SENSE_IN}>, forms array<struct<form:string,tags:array<string>>>, "
    "sounds array<struct<ipa:string,mp3_url:string,ogg_url:string,rhymes:string,homophones:string>>, "
    "head_templates array<struct<name:string,args:map<string,string>,expansion:string>>, "
    f"etymology_templates {TEMPLATES}, etymology_text string, hyphenation string, wikidata array<string>, wikipedia array<string>, "
    "literal_meaning string, derived array<struct<word:string>>, related array<struct<word:string>>, proverbs array<struct<word:string>>"
)
#: A record as a service answers with it; a synonym that is an object is kept as JSON text.
RESPONSE = (
    "word string, pos string, etymology_number int, "
    "senses array<struct<glosses:array<string>,raw_glosses:array<string>,tags:array<string>,links:array<array<string>>,synonyms:array<string>>>, "
    "forms array<struct<form:string,tags:array<string>>>, etymology_text string, sounds array<struct<ipa:string,ogg_url:string,mp3_url:string>>"
)
ENTRIES = (
    "id string, lemma string, pos string, gender string, ipa string, audio_url string, syllabification string, etymology string, "
    "translations array<string>, definitions_de array<struct<nr:string,text:string,labels:array<string>>>, "
    f"senses array<struct<glosses:array<string>,tags:array<string>,domain:string,examples:array<{EXAMPLE}>>>, examples array<{EXAMPLE}>, "
    "inflections array<struct<form:string,tags:array<string>>>, synonyms array<string>, antonyms array<string>, hypernyms array<string>, "
    "hyponyms array<string>, derived array<string>, related array<string>, collocations array<string>, "
    "corpus_examples array<struct<sentence:string,source:string,date:string,genre:string>>, frequency_class int, frequency_per_m double, "
    "frequency_ts array<struct<year:int,f:double>>, cefr_level string, rhymes string, homophones array<string>, proverbs array<string>, "
    "wikidata_id string, wikipedia string, compound_parts string, case_government string, auxiliary string, verb_class string, "
    "usage_labels array<string>, subject_domains array<string>, sources map<string,string>, created_at long, updated_at long"
)
FORMS = "form string, entry_id string, tags array<string>, source string"
META = "key string, value string"
ROOTS = "id string, form string, stage string, core_meaning string, is_reconstructed boolean, morpheme_type string, sources string, created_at long, updated_at long"
AFFIXES = "id string, form string, position string, separable boolean, semantic_functions array<string>, grammatical_effect string, productivity string, etymology_root_id string"
DECOMPOSITIONS = "entry_id string, segments array<struct<form:string,type:string,function:string>>, word_formation_type string, is_compound boolean, compound_parts array<string>, verified boolean"
ETYMOLOGY_EDGES = "from_root_id string, to_root_id string, edge_type string"
DERIVATION_EDGES = "entry_id string, target_id string, target_type string, position int"
COMPOUND_EDGES = "compound_entry_id string, component_entry_id string, position int"
SEMANTIC_EDGES = "from_entry_id string, to_entry_id string, edge_type string, score double"
SEMANTIC_FIELDS = "id string, name_de string, name_en string, parent_field_id string"
ENTRY_FIELDS = "entry_id string, field_id string"
SPATIAL_LAYOUT = "root_id string, x double, z double, island_radius double, island_height double, layout_version int"
