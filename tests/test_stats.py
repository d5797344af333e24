"""Models against direct linear algebra."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.student import _two_sided
from corpusloom.operators import stats
from corpusloom.session import materialize


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    n = 240
    group = rng.integers(0, 12, n)
    x = rng.normal(50, 10, n)
    y = 3 + 0.2 * x + rng.normal(0, 1.5, 12)[group] + rng.normal(0, 1, n)
    return pd.DataFrame({"y": y, "x": x, "group": [f"g{i}" for i in group], "party": np.where(rng.random(n) < 0.3, "B", "A")})


def test_student_p_known_values():
    assert math.isclose(_two_sided(2.228138852, 10), 0.05, rel_tol=1e-7)
    assert math.isclose(_two_sided(12.706204736, 1), 0.05, rel_tol=1e-7)
    assert math.isclose(_two_sided(-1.959963985, 1e7), 0.05, rel_tol=1e-5)
    assert _two_sided(0.0, 5) == 1.0


def test_factor_model_equals_least_squares(spark, data):
    got = stats.factor_model(spark.createDataFrame(data), "y", "party").toPandas().set_index("term")
    x = np.column_stack([np.ones(len(data)), data["party"] == "B"]).astype(float)
    beta, rss = np.linalg.lstsq(x, data["y"], rcond=None)[:2]
    cov = rss[0] / (len(data) - 2) * np.linalg.inv(x.T @ x)
    assert np.allclose(got.loc[["(Intercept)", "B"], "estimate"], beta)
    assert np.allclose(got.loc[["(Intercept)", "B"], "std_error"], np.sqrt(np.diag(cov)))
    total = ((data["y"] - data["y"].mean()) ** 2).sum()
    assert math.isclose(got["r_squared"].iloc[0], 1 - rss[0] / total)


def test_linear_model_and_correlation_tests_agree(spark, data):
    df = spark.createDataFrame(data)
    slope = stats.linear_model(df, "y", ["x"]).filter("term = 'x'").first()
    tested = stats.correlation_tests(df, ["x", "y"]).first()
    assert math.isclose(slope.p, tested.p, rel_tol=1e-6, abs_tol=1e-12)
    assert math.isclose(tested.r, np.corrcoef(data["x"], data["y"])[0, 1])
    weak = stats.correlation_tests(spark.createDataFrame(data.assign(z=np.tile([1.0, -1.0, 2.0], 80))), ["z", "y"]).first()
    assert weak.significant == (weak.p < 0.05)


def _reml(data, lam, x):
    z = pd.get_dummies(data["group"]).to_numpy(float)
    v = np.eye(len(data)) + lam * z @ z.T
    vi = np.linalg.inv(v)
    a = x.T @ vi @ x
    beta = np.linalg.solve(a, x.T @ vi @ data["y"])
    rest = data["y"] - x @ beta
    df = len(data) - x.shape[1]
    s2 = float(rest @ vi @ rest) / df
    return df * np.log(s2) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1], beta, np.sqrt(np.diag(np.linalg.inv(a) * s2)), s2


def test_random_intercept_equals_dense_reml(spark, data):
    fit = stats.random_intercept(spark.createDataFrame(data), "y", {"b": F.col("party") == "B", "x": F.col("x")}, "group")
    x = np.column_stack([np.ones(len(data)), data["party"] == "B", data["x"]]).astype(float)
    lam = fit["group_variance"] / fit["residual_variance"]
    best, beta, errors, s2 = _reml(data, lam, x)
    assert np.allclose(fit["estimate"], beta, rtol=1e-6) and np.allclose(fit["std_error"], errors, rtol=1e-6)
    assert math.isclose(s2, fit["residual_variance"], rel_tol=1e-6)
    for other in (lam * 0.9, lam * 1.1):
        assert best <= _reml(data, other, x)[0] + 1e-6
    assert (fit["n"], fit["groups"]) == (240, 12)


def test_random_intercept_on_balanced_design_is_anova(spark):
    rng = np.random.default_rng(2)
    group = np.repeat(np.arange(10), 6)
    y = rng.normal(0, 2, 10)[group] + rng.normal(0, 1, 60)
    df = pd.DataFrame({"y": y, "group": [f"g{i}" for i in group]})
    fit = stats.random_intercept(spark.createDataFrame(df), "y", {}, "group", rounds=6)
    means = df.groupby("group")["y"].mean()
    within = ((df["y"] - df["group"].map(means)) ** 2).sum() / 50
    between = 6 * means.var(ddof=1)
    assert math.isclose(fit["residual_variance"], within, rel_tol=1e-3)
    assert math.isclose(fit["group_variance"], (between - within) / 6, rel_tol=1e-3)


def test_distances_scale_and_plane(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.normal(size=(9, 3)), columns=["a", "b", "c"]).assign(k=[f"k{i}" for i in range(9)])
    scaled = stats.standardize(spark.createDataFrame(pdf), ["a", "b", "c"])
    z = scaled.toPandas().set_index("k")
    want = (pdf.set_index("k") - pdf.set_index("k").mean()) / pdf.set_index("k").std()
    assert np.allclose(z.loc[want.index, ["a", "b", "c"]], want)
    pairs = stats.distances(scaled, "k", ["a", "b", "c"]).toPandas()
    assert len(pairs) == 36
    for r in pairs.itertuples():
        assert math.isclose(r.distance, float(np.linalg.norm(want.loc[r.a] - want.loc[r.b])))
    plane = stats.principal_plane(scaled, ["a", "b", "c"]).toPandas()
    values = np.linalg.eigvalsh(np.cov(want.to_numpy().T))[::-1]
    assert np.allclose([plane["pc1"].var(), plane["pc2"].var()], values[:2])


def test_kmeans_keeps_the_best_restart(spark):
    points = [(float(x + d), float(x)) for x in (0, 10, 20) for d in (0.0, 0.1, 0.2)]
    df = spark.createDataFrame(points, "x DOUBLE, y DOUBLE")
    one = stats.within_ss(stats.kmeans(df, ["x", "y"], 3, 5, 1), ["x", "y"]).first()
    assert one.n_clusters == 3 and math.isclose(one.within_ss, 0.06, rel_tol=1e-6)
    curve = stats.elbow(df, ["x", "y"], [1, 3], 1, restarts=3).collect()
    assert math.isclose(curve[0].within_ss, curve[0].total_ss)


def test_no_single_transfer_lowers_the_total(spark):
    rng = np.random.default_rng(6)
    points = [(f"p{i:03d}", *map(float, rng.normal(size=3)), int(rng.integers(0, 4))) for i in range(150)]
    df = materialize(spark.createDataFrame(points, "key STRING, x DOUBLE, y DOUBLE, z DOUBLE, cluster INT").repartition(3), "points")
    columns = ["x", "y", "z"]
    moved = materialize(stats.transfers(df, "key", columns), "moved")
    before, after = (stats.within_ss(t, columns).first() for t in (df, moved))
    assert after.within_ss < before.within_ss and math.isclose(after.total_ss, before.total_ss)
    frame = moved.toPandas()
    x, own = frame[columns].to_numpy(), frame["cluster"].to_numpy()

    def total(labels):
        return sum(((x[labels == c] - x[labels == c].mean(axis=0)) ** 2).sum() for c in set(labels))

    least = total(own)
    assert math.isclose(least, after.within_ss)
    for i in range(len(x)):
        for c in set(own) - {own[i]}:
            other = own.copy()
            other[i] = c
            assert total(other) >= least - 1e-6
    assert stats.transfers(moved, "key", columns).exceptAll(moved).count() == 0


def test_mixed_model_meets_its_normal_equations(spark):
    """Dense generalized least squares at the returned variances gives the returned estimates; other ratios are less likely."""
    rng = np.random.default_rng(9)
    group = rng.integers(0, 12, 240)
    shift = rng.normal(0, 1.5, 12)
    x = rng.normal(size=240)
    y = 2 + 0.7 * x + shift[group] + rng.normal(0, 0.8, 240)
    df = spark.createDataFrame([(int(g), float(a), float(b)) for g, a, b in zip(group, x, y)], "g INT, x DOUBLE, y DOUBLE")
    fit = stats.random_intercept(df, "y", {"x": F.col("x")}, "g")
    design = np.stack([np.ones(240), x], axis=1)
    z = (group[:, None] == np.arange(12)).astype(float)

    def dense(ratio):
        v = np.eye(240) + ratio * z @ z.T
        w = np.linalg.inv(v)
        a = design.T @ w @ design
        beta = np.linalg.solve(a, design.T @ w @ y)
        gap = y - design @ beta
        s2 = gap @ w @ gap / 238
        return beta, np.sqrt(np.diag(s2 * np.linalg.inv(a))), s2, 238 * np.log(s2) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1]

    ratio = fit["group_variance"] / fit["residual_variance"]
    beta, error, s2, least = dense(ratio)
    assert np.allclose(fit["estimate"], beta) and np.allclose(fit["std_error"], error) and math.isclose(fit["residual_variance"], s2, rel_tol=1e-6)
    assert all(dense(ratio * f)[3] >= least - 1e-6 for f in (0.5, 0.8, 0.95, 1.05, 1.25, 2.0))
