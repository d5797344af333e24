"""Grouped helpers: attach group aggregates to rows, ties-keeping top n, reshape."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join where null keys match null keys.

    The keys are packed into one never-null struct, so this stays a plain equi
    join that keeps and reuses hash partitioning. Without keys the right side is
    one row; it is read as a scalar subquery, so no cross product is planned.
    """
    if not keys:
        one = right.select(F.struct(*right.columns).alias("__row")).scalar()
        return left.withColumns({name: one.getField(name) for name in right.columns})
    others = [c for c in right.columns if c not in set(keys)]
    packed = right.select(F.struct(*keys).alias("__k"), *others)
    return left.withColumn("__k", F.struct(*keys)).join(packed, "__k", how).drop("__k")


def attach(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Add group aggregates to every row, like a whole-partition window.

    The aggregate runs with partial sums and is joined back, so a group that
    holds a large share of the rows is never gathered in one task: the group
    table is broadcast when it turns out small, and skew-split otherwise.
    """
    return null_safe_join(df, df.groupBy(*keys).agg(*aggregates), keys)


#: Bytes of a table's most used rows that travel with the tasks in ``join_hot``.
HOT_BYTES = 32 << 20


def join_hot(cells: DataFrame, table: DataFrame, key: str, use: str | Column, limit: int = HOT_BYTES) -> DataFrame:
    """Inner join of stored cells with a stored table of one row per key: the most used keys' rows travel with the tasks, the others are joined.

    ``use`` is how much a key is used, on any scale. Few keys have most of the cells; these are not moved. How many keys are sent
    follows from ``limit`` and the number of columns, so what is sent grows with the table by the
    quantile's error only, half a percent of its rows.
    """
    most = limit // (64 + 8 * len(table.columns))
    rows = table.count()
    if rows <= most:
        return cells.join(F.broadcast(table), key)
    measured = table.withColumn("__use", (F.col(use) if isinstance(use, str) else use).cast("double"))
    cut = measured.approxQuantile("__use", [1 - most / rows], 0.005)[0]
    is_hot = F.coalesce(F.col("__use") > cut, F.lit(False))
    hot, rest = measured.where(is_hot).drop("__use"), measured.where(~is_hot).drop("__use")
    cold = cells.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return cells.join(F.broadcast(hot), key).unionByName(cold)


def add_count(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    return attach(df, keys, F.count(F.lit(1)).alias(out))


def share(df: DataFrame, value: str, keys: Sequence[str], total: str = "sum_n", out: str = "proportion") -> DataFrame:
    """Group total of a count column and each row's share of it."""
    totalled = attach(df, keys, F.sum(value).alias(total))
    return totalled.withColumn(out, F.col(value).cast("double") / F.col(total).cast("double"))


def top_n_ties(df: DataFrame, keys: Sequence[str | Column], order: Column, n: int, out: str = "__rank") -> DataFrame:
    """Rows whose rank in their group is at most n; ties at the cut stay.

    Spark prunes each input partition to its own top n first (WindowGroupLimit).
    """
    ranked = df.withColumn(out, F.rank().over(Window.partitionBy(*keys).orderBy(order)))
    kept = ranked.filter(F.col(out) <= n)
    return kept.drop(out) if out == "__rank" else kept


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the first by ``order``."""
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("__rn") == 1).drop("__rn")


def ordered_concat(df: DataFrame, keys: Sequence[str], order: str, text: str, sep: str = " ", out: str = "text") -> DataFrame:
    """Strings of a group joined in order; nulls are skipped."""
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text))))
    joined = F.concat_ws(sep, F.transform(pieces, lambda p: p.getField(text)))
    return df.groupBy(*keys).agg(joined.alias(out))


def pivot_counts(df: DataFrame, keys: Sequence[str], name: str, value: str, levels: Sequence[str], fill: int | None = None) -> DataFrame:
    """One column per known level. Levels are given, so no extra job finds them."""
    wide = df.groupBy(*keys).pivot(name, list(levels)).agg(F.sum(value))
    return wide if fill is None else wide.na.fill(fill, list(levels))


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def map_numeric(df: DataFrame, change: Callable[[str], Column], exclude: Sequence[str] = ()) -> DataFrame:
    """Apply one expression to every numeric column."""
    return df.withColumns({name: change(name) for name in numeric_columns(df, exclude)})


def mean_numeric(df: DataFrame, keys: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Group means of every numeric column."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in numeric_columns(df, [*keys, *exclude])])


def column_totals(df: DataFrame, values: Sequence[str]) -> Column:
    """All column sums as one scalar struct, usable inside an expression."""
    return df.select(F.struct(*[F.sum(v).alias(v) for v in values]).alias("totals")).scalar()


def add_one_share(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """(x + 1) / sum(x + 1) over the whole column, for several columns at once."""
    totals = column_totals(df.select(*[(F.col(v) + 1).alias(v) for v in values]), values)
    return df.withColumns({v: (F.col(v) + 1).cast("double") / totals.getField(v).cast("double") for v in values})


def natural_join(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on every column name both sides share."""
    return left.join(right, [c for c in left.columns if c in set(right.columns)], how)


def reduce_left_join(frames: Sequence[DataFrame], key: str, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Left join a list of tables; a clashing name gets a suffix on both sides."""

    def step(left: DataFrame, right: DataFrame) -> DataFrame:
        clash = [c for c in left.columns if c in set(right.columns) and c != key]
        left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
        return left.join(right.withColumnsRenamed({c: c + suffixes[1] for c in clash}), key, "left")

    return reduce(step, frames)


def level_order(df: DataFrame, level: str, value: str, out: str = "level_no") -> DataFrame:
    """Levels ranked by the mean of a value: one row per level."""
    means = df.groupBy(level).agg(F.avg(value).alias("level_value"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.round("level_value", 8), level)
    return means.withColumn(out, F.row_number().over(order))
