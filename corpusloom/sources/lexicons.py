"""Lexicons as inline relations.

They are LocalRelations, so the optimizer knows their size and broadcasts
them by itself; a lexicon read from Parquet gets the same treatment from its
file size and falls back to a shuffled join (with AQE skew splitting of the
frequent words) when it is too large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values -----------------------------------------------------------
SENTIMENTS = (
    ("that", "positive"), ("that", "trust"), ("was", "negative"), ("was", "sadness"),
    ("with", "positive"), ("with", "joy"), ("by", "negative"), ("by", "fear"),
    ("this", "positive"), ("this", "anticipation"), ("from", "negative"), ("from", "anger"),
    ("as", "surprise"), ("on", "disgust"), ("for", "positive"),
)
VALENCES = (("that", 2), ("with", 1), ("this", 1), ("was", -2), ("by", -1), ("from", -1))
SHIFTERS = (("is", "amplifier"), ("it", "negator"), ("are", "deamplifier"), ("be", "adversative"))
STOP_WORDS = (
    ("the", "onix"), ("the", "smart"), ("of", "onix"), ("of", "snowball"), ("and", "smart"),
    ("to", "smart"), ("to", "snowball"), ("a", "onix"), ("in", "smart"),
)
DOMAIN_STOP_WORDS = (
    "united", "states", "government", "congress", "citizen", "house", "representatives", "na", "country", "year",
)
EXCLUDED_SENTIMENT_WORDS = ("government", "united")
PARTS_OF_SPEECH = (
    ("anin", "Noun"), ("anin", "Adjective"), ("ing", "Noun"), ("tion", "Noun"), ("tion", "Plural"),
    ("es", "Plural"), ("er", "Noun"), ("er", "Verb"), ("ed", "Verb"), ("st", "Adverb"),
)
TAGGED_TOKENS = (
    ("the", "the", "DET"), ("a", "a", "DET"), ("this", "this", "DET"), ("of", "of", "ADP"),
    ("in", "in", "ADP"), ("to", "to", "ADP"), ("to", "to", "ADP"), ("to", "to", "PART"),
    ("on", "on", "ADP"), ("for", "for", "ADP"), ("with", "with", "ADP"), ("and", "and", "CCONJ"),
    ("it", "it", "PRON"), ("that", "that", "PRON"), ("that", "that", "PRON"), ("that", "that", "SCONJ"),
    ("is", "be", "AUX"), ("was", "be", "AUX"), ("be", "be", "AUX"), ("are", "be", "AUX"),
    ("nation", "nation", "NOUN"), ("station", "station", "NOUN"), ("making", "make", "VERB"),
    ("telling", "tell", "VERB"), ("quickly", "quickly", "ADV"), ("early", "early", "ADV"),
    ("larger", "large", "ADJ"), ("older", "old", "ADJ"), ("greatest", "great", "ADJ"), ("words", "word", "NOUN"),
    ("named", "name", "VERB"), ("house", "house", "NOUN"),
)
# -----------------------------------------------------------------------------

TABLES = {
    "sentiments": (("word", "sentiment"), SENTIMENTS),
    "valences": (("word", "valence"), VALENCES),
    "shifters": (("word", "kind"), SHIFTERS),
    "stop_words": (("word", "lexicon"), STOP_WORDS),
    "parts_of_speech": (("word", "pos"), PARTS_OF_SPEECH),
    "tagged_tokens": (("token", "lemma", "upos"), TAGGED_TOKENS),
}


def values_sql(name: str) -> str:
    """``VALUES`` rows of a lexicon with column names, valid in any SQL engine."""
    columns, rows = TABLES[name]
    literal = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS lex({', '.join(columns)})"


def lexicon(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(values_sql(name))
