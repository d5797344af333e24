"""Places of rows inside their groups, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialize


def positions(rows: DataFrame, group: str, order: Sequence[str], out: str = "idx", total: str = "n") -> DataFrame:
    """``rows`` with ``out``, the place from 0 inside the group in the given order (nulls first), and ``total``, the group's rows.

    Rows are range-partitioned by group and order, sorted and stored; a place is the row's own number in its partition, counted
    from the first row of its group there, plus what earlier partitions hold of the group. A hot group lies in many partitions; the
    windows see one row for each partition and group.
    """
    sorted_ = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    stored = materialize(sorted_.withColumn("__at", F.monotonically_increasing_id()), "positions").withColumn("__part", F.shiftright("__at", 33))
    runs = stored.groupBy("__part", group).agg(F.min("__at").alias("__low"), F.count("*").alias("__here"))
    every = Window.partitionBy(group)
    before = F.coalesce(F.sum("__here").over(every.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = runs.select(F.struct("__part", group).alias("__run"), (before - F.col("__low")).alias("__shift"), F.sum("__here").over(every).alias(total))
    joined = stored.withColumn("__run", F.struct("__part", group)).join(placed, "__run")
    return joined.withColumn(out, F.col("__at") + F.col("__shift")).drop("__at", "__part", "__run", "__shift")
