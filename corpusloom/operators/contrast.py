"""Word contrasts between groups: smoothed log ratio and tf-idf."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.grouped import add_one_share, attach, pivot_counts, top_n_ties


def log_ratio(counts: DataFrame, group: str, first: str, second: str, more_than: int, keys: Sequence[str] = ()) -> DataFrame:
    """log2 of the smoothed share of a word in ``second`` over that in ``first``.

    ``counts`` is (group, keys…, word, n). Words must be used more than
    ``more_than`` times in both groups; the shares are over the surviving words.
    """
    wide = pivot_counts(counts, [*keys, "word"], group, "n", (first, second), fill=0)
    frequent = wide.filter((F.col(first) > more_than) & (F.col(second) > more_than))
    shares = add_one_share(frequent, (first, second))
    return shares.withColumn("logratio", F.log2(F.col(second) / F.col(first)))


def log_ratio_top(ratios: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """Strongest words on each side (and per key), ties kept."""
    strength = F.round(F.abs("logratio"), 8)
    return top_n_ties(ratios, [*keys, (F.col("logratio") < 0).alias("side")], F.desc(strength), n)


def tf_idf(counts: DataFrame, group: str) -> DataFrame:
    """Term frequency in the group times ln(groups / groups that use the word)."""
    n_groups = counts.agg(F.count_distinct(group)).scalar().cast("double")
    sized = attach(counts, [group], F.sum("n").alias("__all"))
    spread = attach(sized, ["word"], F.count(F.lit(1)).alias("__groups"))
    return spread.withColumns({
        "tf": F.col("n").cast("double") / F.col("__all").cast("double"),
        "idf": F.ln(n_groups / F.col("__groups").cast("double")),
    }).withColumn("tf_idf", F.col("tf") * F.col("idf")).drop("__all", "__groups")


def top_terms_by(scored: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """Top n words of each group by a score, ties kept; ranked on rounded values."""
    return top_n_ties(scored, [group], F.desc(F.round(value, 10)), n)
