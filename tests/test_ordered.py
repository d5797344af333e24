"""Bucketed order operators against plain single-machine answers, with hot groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import charts, ordered


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    n = 5000
    group = np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abcd"), n))
    value = np.where(rng.random(n) < 0.3, 1.5, np.round(rng.lognormal(size=n), 3))  # a third are one value
    return pd.DataFrame({"id": rng.permutation(n), "g": group, "v": value})


def test_prefix_sum_ignores_partitioning(spark, skewed):
    expected = skewed.sort_values("id").assign(running=lambda d: np.arange(1, len(d) + 1))
    for parts in (1, 8):
        df = spark.createDataFrame(skewed).repartition(parts).withColumn("b", F.floor(F.col("id") / 100))
        got = ordered.prefix_sum(df, F.lit(1), ["id"], "b").toPandas().sort_values("id")
        assert (got["running"].to_numpy() == expected["running"].to_numpy()).all()


def test_running_total(spark, skewed):
    df = spark.createDataFrame(skewed).withColumn("one", F.lit(1))
    got = ordered.running_total(df, "v", ["one"], ["g"]).toPandas()
    for g, part in skewed.groupby("g"):
        counts = part["v"].value_counts().sort_index()
        mine = got[got["g"] == g].sort_values("v")
        assert (mine["v"].to_numpy() == counts.index.to_numpy()).all()
        assert (mine["one_cum"].to_numpy() == counts.cumsum().to_numpy()).all()
        assert (mine["one_all"] == len(part)).all()


def test_exact_quantiles(spark, skewed):
    probs = {"a": 0.0, "q1": 0.25, "m": 0.5, "q3": 0.75, "z": 1.0}
    got = ordered.exact_quantiles(spark.createDataFrame(skewed), "v", probs, ["g"]).toPandas().set_index("g")
    for g, part in skewed.groupby("g"):
        want = np.quantile(part["v"], list(probs.values()))
        assert np.allclose(got.loc[g, list(probs)].to_numpy(dtype=float), want)
    whole = ordered.exact_quantiles(spark.createDataFrame(skewed), "v", probs).first()
    assert np.allclose([whole[p] for p in probs], np.quantile(skewed["v"], list(probs.values())))


def test_single_row_and_null_group(spark):
    df = spark.createDataFrame([(None, 4.0), ("x", 1.0), ("x", None)], "g STRING, v DOUBLE")
    got = {r.g: (r.n, r.m) for r in ordered.exact_quantiles(df, "v", {"m": 0.5}, ["g"]).collect()}
    assert got == {None: (1, 4.0), "x": (1, 1.0)}


def test_value_rank_and_cume_dist(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = ordered.value_rank(df, "v", "r", ["g"], descending=True).toPandas().set_index("id")["r"]
    want = skewed.assign(r=skewed.groupby("g")["v"].rank("min", ascending=False)).set_index("id")["r"]
    assert (got.sort_index() == want.sort_index()).all()
    share = ordered.cume_dist(df, "v", "c", ["g"]).toPandas().set_index("id")["c"]
    want = skewed.assign(c=skewed.groupby("g")["v"].rank("max", pct=True)).set_index("id")["c"]
    assert np.allclose(share.sort_index(), want.sort_index())


def test_hash_rank_is_a_permutation(spark, skewed):
    got = ordered.hash_rank(spark.createDataFrame(skewed), "id", ["g"], 5, "r").toPandas()
    for _, part in got.groupby("g"):
        assert sorted(part["r"]) == list(range(1, len(part) + 1))


def test_box_stats(spark, skewed):
    got = charts.box_stats(spark.createDataFrame(skewed), "v", ["g"]).toPandas().set_index("g")
    for g, part in skewed.groupby("g"):
        q1, m, q3 = np.quantile(part["v"], [0.25, 0.5, 0.75])
        inside = part["v"].between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        row = got.loc[g]
        assert np.allclose([row.q1, row["median"], row.q3], [q1, m, q3])
        assert (row.lower, row.upper) == (part["v"][inside].min(), part["v"][inside].max())
        assert row.outliers == (~inside).sum() and row.n == len(part)


def test_reversed_levels(spark):
    df = spark.createDataFrame([(10, "a"), (20, "b"), (30, "a"), (40, "b")], "k BIGINT, g STRING")
    got = {r.g: r.level_value for r in charts.reversed_levels(df, "k", "g").collect()}
    assert got == {"a": (40 + 20) / 2, "b": (30 + 10) / 2}


@pytest.mark.parametrize("ids", [range(700), [(-1) ** i * (i * 2**53 + i) for i in range(700)]], ids=["dense", "sparse"])
def test_row_numbers_use_many_buckets(spark, ids):
    rows = [(i, j) for i in ids for j in range(1 + abs(i) % 3)]
    df = spark.createDataFrame(rows, "doc BIGINT, line INT").repartition(5)
    got = {(r.doc, r.line): r.n for r in ordered.global_row_number(df, "doc", ["doc", "line"], "n").collect()}
    assert got == {row: n + 1 for n, row in enumerate(sorted(rows))}
    assert ordered.key_bucket(df, "doc", "b").select("b").distinct().count() > 100
