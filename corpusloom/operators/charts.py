"""The tables behind the figures; drawing is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.grouped import attach, null_safe_join
from corpusloom.operators.ordered import exact_quantiles, global_row_number


def box_stats(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """Quartiles, whisker ends within 1.5 IQR and number of outliers per group."""
    quartiles = exact_quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, group)
    fenced = null_safe_join(df.filter(F.col(value).isNotNull()).select(*group, value), quartiles, group)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach)
    return fenced.groupBy(*group).agg(
        F.first("n").alias("n"), *[F.first(q).alias(q) for q in ("q1", "median", "q3")],
        F.min(F.when(inside, F.col(value))).alias("lower"), F.max(F.when(inside, F.col(value))).alias("upper"),
        F.sum((~inside).cast("long")).alias("outliers"),
    )


def reversed_levels(df: DataFrame, key: str, level: str) -> DataFrame:
    """(level, level_value): mean of the reversed key vector over the rows of each level."""
    rows = df.select(key, level)
    forward = global_row_number(rows, key, [key], "__i").select("__i", level)
    negative = rows.select((-F.col(key)).alias("__back"))
    back = global_row_number(negative, "__back", ["__back"], "__i")
    return forward.join(back, "__i").groupBy(level).agg(F.avg(-F.col("__back")).alias("level_value"))


def group_vs_mean(df: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """Each row's value with its group mean, the overall mean and the group's place on the axis."""
    with_mean = attach(df.select(key, group, value), [group], F.avg(value).alias("group_mean"))
    overall = df.select(F.avg(value)).scalar()
    levels = reversed_levels(df, key, group)
    return with_mean.join(levels, group).withColumn("overall_mean", overall)
