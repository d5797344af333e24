"""What storing a table leaves behind."""

from pyspark.sql import functions as F

from corpusloom.operators import topics
from corpusloom.session import REMOVE_SHUFFLES, materialize


def shuffle_files(spark) -> int:
    """Shuffle files in the session's own folders."""
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(found.apply(i).getName().startswith("shuffle_") for i in range(found.length()))


def test_a_stored_table_leaves_no_shuffles(spark):
    """Ten models' shuffles stayed on disk until the driver collected garbage."""
    before, conf = shuffle_files(spark), spark.conf.get(REMOVE_SHUFFLES, None)
    stored = materialize(spark.range(5_000).repartition(4).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n")), "counted")
    assert shuffle_files(spark) <= before and spark.conf.get(REMOVE_SHUFFLES, None) == conf
    assert stored.count() == 100 and stored.agg(F.sum("n")).first()[0] == 5_000


def test_cells_move_to_their_shares_without_weights(spark):
    """Every cell moved with all its word's weights."""
    counts = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 1), (3, "c", 4)], "doc_id BIGINT, word STRING, n BIGINT")
    weights = spark.createDataFrame([("a", 0.5, 0.1), ("b", 0.5, 0.9)], "word STRING, b1 DOUBLE, b2 DOUBLE")
    shares = spark.createDataFrame([(1, 0.25, 0.75), (2, 1.0, 0.0)], "doc_id BIGINT, g1 DOUBLE, g2 DOUBLE")
    cells = topics.fitted_cells(counts, weights, shares, 2)
    assert sorted(map(tuple, cells.collect())) == [(1, "a", 2, 0.2), (1, "b", 1, 0.8), (2, "a", 1, 0.5)]
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) == 2 and "word" in joins[0] and "doc_id" in joins[1]
