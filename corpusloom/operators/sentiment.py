"""Lexicon sentiment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.grouped import share
from corpusloom.operators.tokens import explode_words

POLARITY = "pos|neg"

# --- fixed values of the valence-shift score ---------------------------------
WORDS_BEFORE, WORDS_AFTER = 5, 2
AMPLIFIER_WEIGHT, ADVERSATIVE_WEIGHT = 0.8, 0.25
# -----------------------------------------------------------------------------


def lexicon_counts(docs: DataFrame, lexicon: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, sentiment, n): each token counts once per sentiment it carries.

    The lexicon is small enough to be broadcast, so tokens meet it before any
    shuffle and only (keys, sentiment) sums travel.
    """
    hits = explode_words(docs.select(*keys, "text")).join(lexicon, "word")
    return hits.groupBy(*keys, "sentiment").agg(F.count(F.lit(1)).alias("n"))


def sentiment_shares(docs: DataFrame, lexicon: DataFrame, keys: Sequence[str], polarity: bool) -> DataFrame:
    """Share of each emotion (or of positive and negative) per group."""
    counts = lexicon_counts(docs, lexicon, keys)
    matches = F.col("sentiment").rlike(POLARITY)
    return share(counts.filter(matches if polarity else ~matches), "n", keys)


def positivity(docs: DataFrame, lexicon: DataFrame, keys: Sequence[str]) -> DataFrame:
    """positive / (positive + negative) per text; texts without a positive hit drop out."""
    polar = lexicon.filter(F.col("sentiment").rlike(POLARITY))
    counts = lexicon_counts(docs, polar, keys)
    totals = counts.groupBy(*keys).agg(
        F.sum(F.when(F.col("sentiment") == "positive", F.col("n"))).alias("n"), F.sum("n").alias("sum_n")
    )
    scored = totals.filter(F.col("n").isNotNull())
    return scored.withColumn("prop_positive", F.col("n").cast("double") / F.col("sum_n").cast("double"))


def additive_score(sentences: DataFrame, valences: DataFrame, keys: Sequence[str], text: str = "sentence") -> DataFrame:
    """Sum of word valences per sentence, 0 without a hit."""
    words = sentences.select(*keys, F.explode_outer(X.words(text)).alias("word"))
    joined = words.join(valences, "word", "left")
    return joined.groupBy(*keys).agg(F.coalesce(F.sum("valence"), F.lit(0)).alias("sentiment_score"))


def shifted_score(
    sentences: DataFrame, valences: DataFrame, shifters: DataFrame, keys: Sequence[str], text: str = "sentence"
) -> DataFrame:
    """Valence-shift polarity per sentence over the root of its word count.

    Only words found in a lexicon are shuffled: the 5-before / 2-after window is
    a range over word positions, so the neutral words between them are not
    needed. The word count is taken inside the sentence row. ``sentences`` is
    read twice and should be a stored table.
    """
    counted = sentences.select(*keys, X.words(text).alias("__w")).withColumn("word_count", F.size("__w"))
    words = counted.select(*keys, "word_count", F.posexplode("__w").alias("pos", "word"))
    hits = (
        words.join(valences, "word", "left").join(shifters, "word", "left")
        .filter(F.col("valence").isNotNull() | F.col("kind").isNotNull())
    )
    sentence = Window.partitionBy(*keys).orderBy("pos")
    around = sentence.rangeBetween(-WORDS_BEFORE, WORDS_AFTER)
    before = sentence.rangeBetween(-WORDS_BEFORE, -1)
    after = sentence.rangeBetween(1, WORDS_AFTER)

    def number(kind: str, window):
        return F.coalesce(F.sum((F.col("kind") == kind).cast("int")).over(window), F.lit(0))

    near = hits.withColumns({
        "negated": number("negator", around) % 2,
        "amp": number("amplifier", around),
        "deamp": number("deamplifier", around),
        "adv": number("adversative", before) - number("adversative", after),
    }).filter(F.col("valence").isNotNull())
    amplified = AMPLIFIER_WEIGHT * (1 - F.col("negated")) * F.col("amp")
    damped = F.greatest(F.lit(-1.0), -AMPLIFIER_WEIGHT * (F.col("negated") * F.col("amp") + F.col("deamp")))
    sign = 1 - 2 * F.col("negated")
    value = F.col("valence") * sign * (1 + amplified + damped) * (1 + ADVERSATIVE_WEIGHT * F.col("adv"))
    summed = near.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    score = F.coalesce(F.col("__sum"), F.lit(0.0)) / F.sqrt(F.greatest(F.lit(1), F.col("word_count")).cast("double"))
    base = counted.select(*keys, "word_count")
    return base.join(summed, list(keys), "left").select(*keys, "word_count", score.alias("sentiment"))
