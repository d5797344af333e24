"""Linear models, correlation, distance, clustering and principal components.

Every model is fitted from aggregates: one pass over the rows gives sums of
fixed size, and only those small sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.scalars import ratio
from corpusloom.functions.student import student_p
from corpusloom.session import materialize


def factor_model(df: DataFrame, y: str, factor: str) -> DataFrame:
    """``y ~ factor``: coefficients against the alphabetically first level.

    With one factor, least squares is the table of level means, so a single
    grouped aggregate replaces the model matrix. One row per level; the base
    level's row is the intercept.
    """
    levels = df.filter(F.col(y).isNotNull() & F.col(factor).isNotNull()).groupBy(factor).agg(
        F.count("*").alias("n"), F.avg(y).alias("mean"), F.var_pop(y).alias("var")
    )
    n = F.col("n").cast("double")
    fit = levels.agg(
        F.sum("n").alias("n"),
        F.count("*").alias("levels"),
        F.sum(n * F.col("var")).alias("within"),
        (F.sum(n * F.col("mean") * F.col("mean")) - F.sum(n * F.col("mean")) * F.sum(n * F.col("mean")) / F.sum(n)).alias("between"),
        F.min_by(F.struct("n", "mean", factor), factor).alias("base"),
    )
    one = fit.select(F.struct("*").alias("fit")).scalar()
    base = one["base"]
    freedom = (one["n"] - one["levels"]).cast("double")
    sigma = F.sqrt(one["within"] / freedom)
    is_base = F.col(factor) == base[factor]
    base_n = base["n"].cast("double")
    table = levels.select(
        F.when(is_base, "(Intercept)").otherwise(F.col(factor)).alias("term"),
        F.when(is_base, F.col("mean")).otherwise(F.col("mean") - base["mean"]).alias("estimate"),
        (sigma * F.when(is_base, F.sqrt(1.0 / base_n)).otherwise(F.sqrt(1.0 / n + 1.0 / base_n))).alias("std_error"),
        freedom.alias("df"),
        (one["between"] / (one["within"] + one["between"])).alias("r_squared"),
    )
    tested = table.withColumn("t", ratio(F.col("estimate"), F.col("std_error")))
    return tested.withColumn("p", student_p("t", "df"))


def linear_model(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Least squares on numeric columns: term, estimate, std_error, t, p."""
    rows = df.select(y, *xs).na.drop()
    assembled = VectorAssembler(inputCols=list(xs), outputCol="features").transform(rows)
    fit = LinearRegression(labelCol=y, solver="normal").fit(assembled)
    summary = fit.summary
    # The summary lists the intercept last.
    names = [*xs, "(Intercept)"]
    values = [*fit.coefficients, fit.intercept]
    stats = zip(names, values, summary.coefficientStandardErrors, summary.tValues, summary.pValues)
    table = [(n, float(v), float(s), float(t), float(p)) for n, v, s, t, p in stats]
    return df.sparkSession.createDataFrame(table, "term STRING, estimate DOUBLE, std_error DOUBLE, t DOUBLE, p DOUBLE")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x, y, n, r) for every pair, over rows complete in all columns; one pass."""
    rows = df.select(*columns).na.drop()
    pairs = list(combinations(sorted(columns), 2))
    wide = rows.agg(F.count("*").alias("n"), *[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    entries = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    return wide.select("n", F.inline(F.array(*entries))).select("x", "y", "n", "r")


def correlation_tests(df: DataFrame, columns: Sequence[str], level: float = 0.05) -> DataFrame:
    """Correlations with their two-sided p-value and a significance flag."""
    freedom = (F.col("n") - 2).cast("double")
    r = F.col("r")
    tested = correlations(df, columns).withColumn("t", r * F.sqrt(ratio(freedom, 1.0 - r * r)))
    with_p = tested.withColumn("p", student_p("t", freedom))
    return with_p.withColumn("significant", F.col("p") < level)


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / sample standard deviation, column by column."""
    parts = [F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in columns]
    one = df.agg(*parts).select(F.struct(*columns).alias("s")).scalar()
    return df.withColumns({c: ratio(F.col(c) - one[c]["m"], one[c]["s"]) for c in columns})


def distances(df: DataFrame, key: str, columns: Sequence[str], blocks: int = 4) -> DataFrame:
    """Euclidean distance of every pair of rows of a profile table (a < b).

    The matrix is cut into blocks x blocks tiles. A row is sent to the tiles it
    takes part in and the tiles are equi-joined, so the work spreads over tasks;
    the result itself is the pair table.
    """
    tile = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    vector = F.array(*[F.col(c).cast("double") for c in columns])
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = df.select(F.col(key).alias("k"), vector.alias("v"), tile.alias("tile"))
    left = rows.select(F.col("k").alias("a"), F.col("v").alias("va"), F.col("tile").alias("i"), others.alias("j"))
    right = rows.select(F.col("k").alias("b"), F.col("v").alias("vb"), F.col("tile").alias("j"), others.alias("i"))
    pairs = left.join(right, ["i", "j"]).filter(F.col("a") < F.col("b"))
    squares = F.aggregate(
        F.zip_with("va", "vb", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, value: acc + value
    )
    return pairs.select("a", "b", F.sqrt(squares).alias("distance"))


# --- random-intercept model -------------------------------------------------------


def _criterion(row, n: int, terms: int) -> tuple[float, np.ndarray, np.ndarray, float]:
    """REML criterion at one variance ratio, with the fixed effects."""
    a = np.zeros((terms, terms))
    for i in range(terms):
        for j in range(i, terms):
            a[i, j] = a[j, i] = row[f"a{i}_{j}"]
    b = np.array([row[f"b{i}"] for i in range(terms)])
    beta = np.linalg.solve(a, b)
    rest = max(row["c"] - float(b @ beta), 1e-300)
    freedom = n - terms
    value = freedom * np.log(rest / freedom) + row["logs"] + np.linalg.slogdet(a)[1]
    return value, beta, a, rest / freedom


def random_intercept(df: DataFrame, y: str, xs: dict[str, Column], group: str, rounds: int = 4) -> dict:
    """``y ~ xs + (1 | group)`` by restricted maximum likelihood.

    Rows are reduced to sums per group in one pass. For a variance ratio the
    likelihood needs only sums over those group rows, so a grid of ratios is one
    small aggregate; the grid is refined around its minimum. Returns term
    estimates, standard errors, both variances and the sizes.
    """
    names = list(xs)
    rows = df.select(F.col(group).alias("g"), F.col(y).cast("double").alias("y"), *[c.cast("double").alias(n) for n, c in xs.items()]).na.drop()
    scale = rows.agg(
        F.count("*").alias("n"), F.avg("y").alias("y_m"),
        *[F.avg(n).alias(f"{n}_m") for n in names], *[F.stddev_pop(n).alias(f"{n}_s") for n in names],
    ).first()
    spread = {n: (scale[f"{n}_s"] or 1.0) for n in names}
    columns = [F.lit(1.0)] + [(F.col(n) - F.lit(scale[f"{n}_m"])) / F.lit(spread[n]) for n in names]
    response = F.col("y") - F.lit(scale["y_m"])
    terms = len(columns)
    sums = [F.count("*").cast("double").alias("n"), F.sum(response).alias("t"), F.sum(response * response).alias("yy")]
    for i in range(terms):
        sums += [F.sum(columns[i]).alias(f"s{i}"), F.sum(columns[i] * response).alias(f"u{i}")]
        sums += [F.sum(columns[i] * columns[j]).alias(f"x{i}_{j}") for j in range(i, terms)]
    groups = materialize(rows.groupBy("g").agg(*sums), "group-sums")

    def evaluate(ratios: Sequence[float]):
        lam = F.col("lam")
        w = lam / (1.0 + F.col("n") * lam)
        cells = [F.sum(F.log1p(F.col("n") * lam)).alias("logs"), F.sum(F.col("yy") - w * F.col("t") * F.col("t")).alias("c"),
                 F.count("*").alias("groups")]
        for i in range(terms):
            cells.append(F.sum(F.col(f"u{i}") - w * F.col(f"s{i}") * F.col("t")).alias(f"b{i}"))
            cells += [
                F.sum(F.col(f"x{i}_{j}") - w * F.col(f"s{i}") * F.col(f"s{j}")).alias(f"a{i}_{j}") for j in range(i, terms)
            ]
        grid = groups.withColumn("lam", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
        return sorted(grid.groupBy("lam").agg(*cells).collect(), key=lambda r: r["lam"])

    ratios = [0.0, *np.geomspace(1e-6, 1e4, 31)]
    for step in range(rounds):
        found = evaluate(ratios)
        values = [_criterion(r, scale["n"], terms)[0] for r in found]
        best = int(np.argmin(values))
        low, high = found[max(best - 1, 0)]["lam"], found[min(best + 1, len(found) - 1)]["lam"]
        if step < rounds - 1:
            ratios = sorted({found[best]["lam"], *np.linspace(low, high, 21)})
    row = found[best]
    _, beta, a, sigma2 = _criterion(row, scale["n"], terms)
    # Back to the original units of the covariates.
    back = np.eye(terms)
    for i, name in enumerate(names, start=1):
        back[i, i] = 1.0 / spread[name]
        back[0, i] = -scale[f"{name}_m"] / spread[name]
    estimate = back @ beta
    estimate[0] += scale["y_m"]
    errors = np.sqrt(np.diag(back @ (sigma2 * np.linalg.inv(a)) @ back.T))
    return {
        "terms": ["(Intercept)", *names], "estimate": estimate.tolist(), "std_error": errors.tolist(),
        "residual_variance": float(sigma2), "group_variance": float(row["lam"] * sigma2),
        "n": int(scale["n"]), "groups": int(row["groups"]), "criterion": float(values[best]),
    }


def mixed_model_table(spark: SparkSession, model: str, fit: dict) -> DataFrame:
    rows = [
        (model, term, float(est), float(err), float(est / err) if err else None, fit["group_variance"], fit["residual_variance"],
         fit["n"], fit["groups"])
        for term, est, err in zip(fit["terms"], fit["estimate"], fit["std_error"])
    ]
    return spark.createDataFrame(
        rows,
        "model STRING, term STRING, estimate DOUBLE, std_error DOUBLE, t DOUBLE, group_variance DOUBLE, residual_variance DOUBLE, "
        "n BIGINT, n_groups BIGINT",
    )


# --- clustering --------------------------------------------------------------------


def kmeans(df: DataFrame, columns: Sequence[str], k: int, restarts: int, seed: int) -> DataFrame:
    """Adds ``cluster`` from the restart with the lowest within sum of squares.

    ``df`` should be a stored table: every restart reads it again.
    """
    points = VectorAssembler(inputCols=list(columns), outputCol="__f").transform(df)
    if k == 1:
        return df.withColumn("cluster", F.lit(0))

    def fit(start: int):
        return KMeans(k=k, seed=seed + start, featuresCol="__f", predictionCol="cluster", maxIter=50).fit(points)

    with ThreadPoolExecutor(max_workers=4) as pool:
        models = list(pool.map(fit, range(restarts)))
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(points).drop("__f")


def transfers(clustered: DataFrame, key: str, columns: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Moves single rows between clusters until no move lowers the within sum of squares (Hartigan and Wong's condition).

    A move counts what both centres change by: n / (n - 1) times the squared distance saved where the row leaves, n / (n + 1) times that
    paid where it goes. Each pass reads the rows once with the live centres and keeps, for every pair of clusters, the row with the
    greatest saving; moves between pairs of clusters that share none add up, so they are made together. Only centres and these rows
    reach the driver. ``clustered`` should be a stored table with ``cluster``; a cluster never loses its last row.
    """
    spark, kind = clustered.sparkSession, clustered.schema[key].dataType.simpleString()
    start = clustered.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in columns]).collect()
    sizes = {r["cluster"]: float(r["n"]) for r in start}
    sums = {r["cluster"]: np.array([r[c] for c in columns], dtype=float) for r in start}
    moved: dict = {}
    while True:
        names = sorted(sizes)
        n, centres = np.array([sizes[c] for c in names]), np.stack([sums[c] / sizes[c] for c in names])

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            place = {c: i for i, c in enumerate(names)}
            for frame in batches:
                own = np.array([place[moved.get(k, c)] for k, c in zip(frame[key], frame["cluster"])], dtype=np.int64)
                gaps = ((frame[list(columns)].to_numpy(dtype=float)[:, None, :] - centres[None]) ** 2).sum(axis=2)
                at = np.arange(len(frame))
                paid = gaps * (n / (n + 1))
                paid[at, own] = np.inf
                to = paid.argmin(axis=1)
                saved = np.where(n[own] > 1, gaps[at, own] * n[own] / np.maximum(n[own] - 1, 1), -np.inf) - paid[at, to]
                out = pd.DataFrame({"a": own, "b": to, "saved": saved, key: frame[key].to_numpy()})
                out["x"] = list(frame[list(columns)].to_numpy(dtype=float))
                out = out[out["saved"] > tolerance]
                yield out.sort_values(["saved", key], ascending=[False, True]).groupby(["a", "b"], as_index=False).first()[["a", "b", "saved", key, "x"]]

        found = clustered.select(key, "cluster", *columns).mapInPandas(best, f"a INT, b INT, saved DOUBLE, `{key}` {kind}, x ARRAY<DOUBLE>")
        rows = found.groupBy("a", "b").agg(F.min(F.struct((-F.col("saved")).alias("o"), key, "x")).alias("m")).collect()
        used: set[int] = set()
        for row in sorted(rows, key=lambda r: (r["m"]["o"], r["a"], r["b"])):
            if not used & {row["a"], row["b"]}:
                used |= {row["a"], row["b"]}
                a, b, x = names[row["a"]], names[row["b"]], np.array(row["m"]["x"])
                moved[row["m"][key]] = b
                sizes[a], sizes[b], sums[a], sums[b] = sizes[a] - 1, sizes[b] + 1, sums[a] - x, sums[b] + x
        if not used:
            break
    if not moved:
        return clustered
    changes = spark.createDataFrame(list(moved.items()), f"`{key}` {kind}, __to INT")
    return clustered.join(changes, key, "left").withColumn("cluster", F.coalesce("__to", "cluster")).drop("__to")


def within_ss(clustered: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: points, clusters, and within, between and total sums of squares."""
    n = F.col("n").cast("double")
    parts = clustered.groupBy("cluster").agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"{c}_m") for c in columns], *[F.var_pop(c).alias(f"{c}_v") for c in columns]
    )
    within = sum((F.sum(n * F.col(f"{c}_v")) for c in columns), F.lit(0.0))
    between = sum(
        (F.sum(n * F.col(f"{c}_m") * F.col(f"{c}_m")) - F.sum(n * F.col(f"{c}_m")) * F.sum(n * F.col(f"{c}_m")) / F.sum(n) for c in columns),
        F.lit(0.0),
    )
    return parts.agg(
        F.sum("n").alias("n_points"), F.count("*").alias("n_clusters"), within.alias("within_ss"), between.alias("between_ss"),
    ).withColumn("total_ss", F.col("within_ss") + F.col("between_ss"))


def elbow(df: DataFrame, columns: Sequence[str], ks: Sequence[int], seed: int, restarts: int = 1, key: str | None = None) -> DataFrame:
    """Within sum of squares for each k, after single transfers where a key is given; k = 1 is the total."""
    tables = []
    for k in ks:
        clustered = kmeans(df, columns, k, restarts, seed)
        if key is not None and k > 1:
            clustered = transfers(materialize(clustered, "clusters"), key, columns)
        tables.append(within_ss(clustered, columns).select(F.lit(k).alias("k"), "*"))
    result = tables[0]
    for other in tables[1:]:
        result = result.unionByName(other)
    return result


def principal_plane(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds ``pc1`` and ``pc2``; the largest loading of each component is positive."""
    points = VectorAssembler(inputCols=list(columns), outputCol="__f").transform(df)
    fit = PCA(k=2, inputCol="__f", outputCol="__p").fit(points)
    loadings = fit.pc.toArray()
    signs = [float(np.sign(loadings[np.argmax(np.abs(loadings[:, i])), i])) for i in range(2)]
    scores = vector_to_array("__p")
    projected = fit.transform(points).withColumns({f"pc{i + 1}": scores[i] * F.lit(signs[i]) for i in range(2)})
    return projected.drop("__f", "__p")
