"""Order-dependent operators that never need one task to see one whole group.

Running counts, ranks and quantiles are defined over a total order. A window
over a whole group would put that group into one task. Here the order is cut
into buckets: each bucket is handled by its own task and starts from the total
of the buckets before it. Only the bucket totals (a small aggregate) meet in
one place.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.grouped import attach, null_safe_join
from corpusloom.session import materialize

SIDE = 16
BINS = SIDE * SIDE


def _offsets(totals: DataFrame, group: Sequence[str], bucket: str, names: Sequence[str]) -> DataFrame:
    """Per bucket the sum of all earlier buckets of the group, plus the group total."""
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*group)
    columns = []
    for name in names:
        columns.append(F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"{name}_before"))
        columns.append(F.sum(name).over(every).alias(f"{name}_all"))
    return totals.select(*group, bucket, *[F.col(n).alias(f"{n}_here") for n in names], *columns)


def prefix_sum(
    df: DataFrame, value: Column | str, order: Sequence[str | Column], bucket: str,
    group: Sequence[str] = (), out: str = "running",
) -> DataFrame:
    """Running sum of ``value`` in (bucket, order) order inside each group.

    ``bucket`` must agree with ``order``: a row of a smaller bucket comes before
    every row of a larger one.
    """
    keyed = df.withColumns({
        "__v": F.col(value) if isinstance(value, str) else value,
        "__k": F.struct(*group, bucket),
    })
    totals = keyed.groupBy("__k").agg(F.sum("__v").alias("__v"))
    offsets = _offsets(totals.select("__k.*", "__v"), group, bucket, ["__v"])
    # Window and join share the key, so the rows are shuffled once.
    inside = Window.partitionBy("__k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = keyed.withColumn("__in", F.sum("__v").over(inside)).drop("__v")
    before = offsets.select(F.struct(*group, bucket).alias("__k"), "__v_before")
    joined = summed.join(before, "__k")
    return joined.withColumn(out, F.col("__in") + F.col("__v_before")).drop("__in", "__v_before", "__k")


def key_bucket(df: DataFrame, key: str, out: str) -> DataFrame:
    """Adds ``out``, the bucket of a numeric order key between its quantiles: any spacing of keys gives buckets of about equal size.

    The quantiles are found once, by a job that reads the key alone: every branch that uses the buckets has the same ones.
    """
    points = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    kind = df.schema[key].dataType
    cuts = df.agg(F.percentile_approx(key, points, F.lit(10000))).first()[0] or []
    return _fine_bucket(df.withColumn("__cuts", F.array(*[F.lit(c).cast(kind) for c in cuts]).cast(T.ArrayType(kind))), key, out)


def stored_items(docs: DataFrame, key: str, items: Column, size: Column, name: str) -> DataFrame:
    """Documents stored once with ``__items`` (an array or what it takes to make one), ``__n`` of them, and ``__row`` to tell rows apart."""
    kept = docs.withColumns({"__items": items, "__n": size, "__row": F.monotonically_increasing_id()})
    return materialize(kept, name)


def item_offsets(stored: DataFrame, key: str) -> DataFrame:
    """(__row, __before): items of all documents before each one, in the order of the key. Only keys and counts are read and moved."""
    narrow = key_bucket(stored.select("__row", key, "__n"), key, "__block")
    running = prefix_sum(narrow, "__n", [key, "__row"], "__block", out="__run")
    return running.select("__row", (F.col("__run") - F.col("__n")).alias("__before"))


def global_row_number(df: DataFrame, key: str, order: Sequence[str | Column], out: str) -> DataFrame:
    """1..n over the whole table, ordered by ``order`` whose first key is ``key``."""
    return prefix_sum(key_bucket(df, key, "__block"), F.lit(1), order, "__block", out=out).drop("__block")


def hash_rank(df: DataFrame, key: str, group: Sequence[str], seed: int, out: str) -> DataFrame:
    """Row number inside each group in the order of a seeded hash of the key.

    The leading hash digits are the buckets; they are uniform whatever the data.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    hashed = df.withColumn("__h", digest).withColumn("__bucket", F.substring("__h", 1, 3))
    return prefix_sum(hashed, F.lit(1), ["__h", key], "__bucket", group, out).drop("__h", "__bucket")


def _with_cuts(df: DataFrame, value: str, group: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """Adds ``__cuts``: approximate quantiles of the group at the given shares (a mergeable sketch)."""
    points = F.array(*[F.lit(s) for s in shares])
    return attach(df, group, F.percentile_approx(value, points, F.lit(10000)).alias("__cuts"))


def _below(value: str, indexes: Sequence[Column | int]) -> Column:
    """How many of the chosen cuts lie below the value; plain comparisons stay in generated code."""
    hits = [(F.get("__cuts", F.lit(i) if isinstance(i, int) else i) < F.col(value)).cast("int") for i in indexes]
    return reduce(lambda a, b: a + b, hits)


def _bucketed(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """Adds ``__b``, one of 256 buckets of about equal size in value order, found in two steps of 16."""
    return _fine_bucket(_with_cuts(df, value, group, [i / BINS for i in range(1, BINS)]), value, "__b")


def _fine_bucket(cut: DataFrame, value: str, out: str) -> DataFrame:
    coarse = cut.withColumn("__c", _below(value, [SIDE * i - 1 for i in range(1, SIDE)]))
    fine = _below(value, [F.col("__c") * SIDE + j for j in range(SIDE - 1)])
    return coarse.withColumn(out, F.col("__c") * SIDE + fine).drop("__cuts", "__c")


def running_total(
    df: DataFrame, value: str, measures: Sequence[str], group: Sequence[str] = ()
) -> DataFrame:
    """Per distinct value of each group: measure sums, their running sums, their totals.

    Output: group, value, and per measure ``m``, ``m_cum`` (values up to and
    including this one) and ``m_all``. Equal values are merged before the
    shuffle, so ties cost nothing.
    """
    merged = df.groupBy(*group, value).agg(*[F.sum(m).alias(m) for m in measures])
    bucketed = _bucketed(merged, value, group).withColumn("__k", F.struct(*group, "__b"))
    totals = bucketed.groupBy("__k").agg(*[F.sum(m).alias(m) for m in measures])
    offsets = _offsets(totals.select("__k.*", *measures), group, "__b", measures)
    inside = Window.partitionBy("__k").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    summed = bucketed.withColumns({f"{m}_in": F.sum(m).over(inside) for m in measures})
    keep = [f"{m}_{s}" for m in measures for s in ("before", "all")]
    joined = summed.join(offsets.select(F.struct(*group, "__b").alias("__k"), *keep), "__k")
    columns = [F.col(c) for c in (*group, value)]
    for m in measures:
        columns += [F.col(m), (F.col(f"{m}_in") + F.col(f"{m}_before")).alias(f"{m}_cum"), F.col(f"{m}_all")]
    return joined.select(*columns)


def value_rank(df: DataFrame, value: str, out: str, group: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """``rank()`` over a numeric column (ties share the lowest rank)."""
    counted = running_total(df.filter(F.col(value).isNotNull()).withColumn("__one", F.lit(1)), value, ["__one"], group)
    below = F.col("__one_cum") - F.col("__one")
    above = F.col("__one_all") - F.col("__one_cum")
    ranks = counted.select(*group, value, ((above if descending else below) + 1).alias(out))
    return null_safe_join(df, ranks, [*group, value])


def cume_dist(df: DataFrame, value: str, out: str, group: Sequence[str] = ()) -> DataFrame:
    """Share of the group's rows with a value up to this one."""
    counted = running_total(df.withColumn("__one", F.lit(1)), value, ["__one"], group)
    shares = counted.select(*group, value, (F.col("__one_cum") / F.col("__one_all")).alias(out))
    return null_safe_join(df, shares, [*group, value])


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], group: Sequence[str] = (), margin: float = 1 / 256
) -> DataFrame:
    """Exact interpolated (type 7) quantiles, one column per entry of ``probs``.

    Approximate quantiles just below and above each wanted share cut the values
    into narrow and wide buckets. Exact bucket counts then tell which buckets
    hold the wanted ranks, normally the narrow ones, and only their rows are
    shuffled and sorted.
    """
    present = df.filter(F.col(value).isNotNull()).select(*group, value)
    shares = sorted({min(max(p + side, 0.0), 1.0) for p in probs.values() for side in (-margin, margin)})
    cut = _with_cuts(present, value, group, shares)
    bucketed = cut.withColumn("__b", _below(value, range(len(shares)))).drop("__cuts").withColumn("__n", F.lit(1))
    totals = bucketed.groupBy(*group, "__b").agg(F.sum("__n").alias("__n"))
    offsets = _offsets(totals, group, "__b", ["__n"])

    position = {name: (F.col("__n_all") - 1) * F.lit(p) for name, p in probs.items()}
    wanted = [f(pos) + 1 for pos in position.values() for f in (F.floor, F.ceil)]
    low, high = F.col("__n_before"), F.col("__n_before") + F.col("__n_here")
    hit = F.exists(F.array(*wanted), lambda r: (r > low) & (r <= high))
    targets = offsets.filter(hit).select(*group, "__b", "__n_before", "__n_all")

    near = null_safe_join(bucketed.select(*group, value, "__b"), targets, [*group, "__b"])
    counted = near.groupBy(*group, "__b", value, "__n_before", "__n_all").agg(F.count("*").alias("__c"))
    inside = Window.partitionBy(*group, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("__cum", F.col("__n_before") + F.sum("__c").over(inside))
    first = F.col("__cum") - F.col("__c") + 1

    picks, results = [], []
    for name, pos in position.items():
        for side, f in (("lo", F.floor), ("hi", F.ceil)):
            rank = f(pos) + 1
            picks.append(F.min(F.when((rank >= first) & (rank <= F.col("__cum")), F.col(value))).alias(f"{name}_{side}"))
        fraction = pos - F.floor(pos)
        results.append((F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * fraction).alias(name))
    picked = ranked.groupBy(*group).agg(F.max("__n_all").alias("__n_all"), *picks)
    return picked.select(*group, F.col("__n_all").alias("n"), *results)
