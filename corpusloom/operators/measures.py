"""Style measures: readability, formality, lengths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.scalars import ratio
from corpusloom.operators.tokens import CONTEXT_TAGS, FORMAL_TAGS, explode_words, tag_tokens

COUNTS = ("n_sent", "n_words", "n_chars", "n_syll", "n_complex")


def readability_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the five counts the formulas need, inside the row.

    A text is one row, so nothing is exploded or shuffled for per-text scores.
    """
    syllables, complex_words = X.syllable_sums(F.col("__w"))
    return df.withColumn("__w", X.words(text)).withColumns({
        "n_sent": X.n_sentence_ends(text).cast("long"),
        "n_words": F.size("__w").cast("long"),
        "n_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_syll": syllables,
        "n_complex": complex_words,
    }).drop("__w")


def readability_scores() -> dict[str, Column]:
    """The five published grade formulas over the counts, and their mean."""
    words, sents = F.col("n_words").cast("double"), F.col("n_sent").cast("double")
    per_sentence = ratio(words, sents)
    scores = {
        "Flesch_Kincaid": 0.39 * per_sentence + 11.8 * ratio(F.col("n_syll"), words) - 15.59,
        "Gunning_Fog_Index": 0.4 * (per_sentence + 100.0 * ratio(F.col("n_complex"), words)),
        "Coleman_Liau": 0.0588 * ratio(F.col("n_chars") * 100.0, words) - 0.296 * ratio(sents * 100.0, words) - 15.8,
        "SMOG": 1.043 * F.sqrt(ratio(F.col("n_complex") * 30.0, sents)) + 3.1291,
        "Automated_Readability_Index": 4.71 * ratio(F.col("n_chars"), words) + 0.5 * per_sentence - 21.43,
    }
    total = sum(scores.values(), F.lit(0.0))
    return {**scores, "Average_Grade_Level": total / 5.0}


def readability(df: DataFrame, keys: Sequence[str], text: str = "text", unique: bool = False) -> DataFrame:
    """Scores per group of texts; ``unique`` says each key has one text already."""
    counted = readability_counts(df, text).select(*keys, *COUNTS)
    if not unique:
        counted = counted.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS])
    return counted.select(*keys, *COUNTS, *[c.alias(n) for n, c in readability_scores().items()])


def formality(tagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """F measure per group; null when one of the two word classes is missing."""
    weight = F.lit(1)
    totals = tagged.groupBy(*keys).agg(
        F.sum(F.when(F.col("upos").isin(*FORMAL_TAGS), weight)).alias("f"),
        F.sum(F.when(F.col("upos").isin(*CONTEXT_TAGS), weight)).alias("c"),
    )
    either = totals.filter(F.col("f").isNotNull() | F.col("c").isNotNull())
    score = 50.0 * (ratio(F.col("f") - F.col("c"), F.col("f") + F.col("c")) + 1.0)
    return either.select(*keys, "f", "c", score.alias("F_measure"))


def document_formality(docs: DataFrame, model: dict[str, DataFrame], keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Formality straight from text: tokens are tagged where they are, only two sums per text are shuffled."""
    words = explode_words(docs.select(*keys, "text"))
    return formality(tag_tokens(words, model, token="word"), keys)


def lengths(df: DataFrame, text: str = "text") -> DataFrame:
    """Stops, separator runs ("words") and words per stop of each text."""
    counted = df.withColumns({"n_stops": X.n_stops(text), "n_words": X.n_separators(text)})
    return counted.withColumn("mean_sent_length", ratio(F.col("n_words"), F.col("n_stops")))


def split_lengths(df: DataFrame, text: str = "sentence") -> DataFrame:
    """Pieces between single blanks and their mean length."""
    pieces = X.split_blank(text)
    return df.withColumns({"sentence_length": F.size(pieces), "mean_word_length": X.mean_length(pieces)})


def style_table(docs: DataFrame, model: dict[str, DataFrame], dims: Sequence[str]) -> DataFrame:
    """Document style features, every part keyed by doc_id."""
    scores = [c.alias(n) for n, c in readability_scores().items()]
    scored = readability_counts(docs).select("doc_id", *dims, "text", *scores)
    base = lengths(scored).withColumn("n_words", F.col("n_words").cast("long")).drop("text", "n_stops")
    formal = document_formality(docs, model).select("doc_id", "F_measure")
    return base.join(formal, "doc_id", "left")
