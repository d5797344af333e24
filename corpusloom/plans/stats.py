"""Statistics and clustering queries."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import grouped, measures, sentiment, stats
from corpusloom.plans.registry import block, query, with_blocks
from corpusloom.plans.text import tagger
from corpusloom.session import materialize
from corpusloom.sources import catalog
from corpusloom.sources.lexicons import lexicon

FEATURES = ("F_measure", "Flesch_Kincaid", "mean_sent_length", "n_words")


def style(spark: SparkSession, folder: str, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, lang, F_measure, Flesch_Kincaid, n_words, mean_sent_length) of all documents or of ``docs``."""
    table = measures.style_table(catalog.documents(spark, folder) if docs is None else docs, tagger(spark), ["source", "lang"])
    return table.select("doc_id", "source", "lang", *FEATURES)


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Standardized feature means per source."""
    means = materialize(grouped.mean_numeric(style(spark, folder), ["source"], exclude=["doc_id"]), "profiles")
    return stats.standardize(means, FEATURES)


block(
    "means", ("style",),
    "SELECT source, " + ", ".join(f"avg({c}) AS {c}" for c in FEATURES) + " FROM style GROUP BY source",
)
block(
    "prof", ("means",),
    "SELECT source, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}" for c in FEATURES) + " FROM means",
)
block("partypos", ("posit", "party"), "SELECT s.doc_id, p.party, s.prop_positive FROM posit s JOIN party p ON s.doc_id = p.doc_id")
block(
    "lmlev", ("partypos",),
    "SELECT party, count(*) AS n, avg(prop_positive) AS m, var_pop(prop_positive) AS v FROM partypos GROUP BY party",
)
block(
    "lmfit", ("lmlev", "partypos"),
    "SELECT (SELECT sum(n) FROM lmlev) AS n, (SELECT count(*) FROM lmlev) AS g, (SELECT sum(n * v) FROM lmlev) AS wss, "
    "(SELECT var_pop(prop_positive) * count(*) FROM partypos) AS tss, (SELECT m FROM lmlev WHERE party = 'A') AS bm, "
    "(SELECT n FROM lmlev WHERE party = 'A') AS bn",
)


@query(
    "stat_lm",
    with_blocks(
        "SELECT CASE WHEN party = 'A' THEN '(Intercept)' ELSE party END AS term, round(est, 6) AS estimate, round(se, 6) AS std_error, "
        "round(est / se, 5) AS t, round(1 - wss / tss, 6) AS r_squared FROM (SELECT l.party, CASE WHEN l.party = 'A' THEN m ELSE m - bm END AS est, "
        "sqrt(wss / (f.n - g)) * CASE WHEN l.party = 'A' THEN sqrt(1.0 / bn) ELSE sqrt(1.0::DOUBLE / l.n + 1.0::DOUBLE / bn) END AS se, wss, tss "
        "FROM lmlev l, lmfit f)",
        "lmlev", "lmfit",
    ),
)
def stat_lm(spark, folder):
    scored = sentiment.positivity(catalog.labelled(spark, folder), lexicon(spark, "sentiments"), ["party", "doc_id"])
    fit = stats.factor_model(scored, "prop_positive", "party")
    return fit.select(
        "term", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"), F.round("t", 5).alias("t"),
        F.round("r_squared", 6).alias("r_squared"),
    )


@query("stat_lmer")
def stat_lmer(spark, folder):
    """The four style measures on party and document number with a random intercept per source."""
    joined = style(spark, folder).join(catalog.parties(spark, folder), "doc_id")
    rows = materialize(joined, "style-party")
    xs = {"party_B": (F.col("party") == "B").cast("double"), "document": F.col("doc_id")}
    models = {"readability": "Flesch_Kincaid", "formality": "F_measure", "sentence_length": "mean_sent_length", "doc_length": "n_words"}

    def fit(name: str) -> DataFrame:
        return stats.mixed_model_table(spark, name, stats.random_intercept(rows, models[name], xs, "source"))

    with ThreadPoolExecutor(max_workers=4) as pool:
        result = reduce(DataFrame.unionByName, pool.map(fit, models))
    return result.select("model", "term", "n", "n_groups", "estimate", "std_error", "t", "group_variance", "residual_variance")


block("complete", ("style",), "SELECT * FROM style WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in FEATURES))
_PAIRS = [(a, b) for i, a in enumerate(sorted(FEATURES)) for b in sorted(FEATURES)[i + 1:]]
block(
    "cors", ("complete",),
    " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, count(*) AS n, corr({a}, {b}) AS r FROM complete" for a, b in _PAIRS),
)


@query("stat_cor", with_blocks("SELECT x, y, CAST(n AS BIGINT) AS n, round(r, 6) AS r FROM cors", "cors"))
def stat_cor(spark, folder):
    return stats.correlations(style(spark, folder), FEATURES).withColumn("r", F.round("r", 6))


# Critical t at 5 % from the normal quantile by the usual expansion in 1/df.
_Z = 1.959963984540054
_CRITICAL = (
    f"({_Z} + ({_Z ** 3 + _Z}) / (4.0 * (n - 2)) + ({5 * _Z ** 5 + 16 * _Z ** 3 + 3 * _Z}) / (96.0 * (n - 2) * (n - 2)))"
)
SIGNIFICANT = f"abs(r) * sqrt((n - 2) / (1 - r * r)) > {_CRITICAL}"


@query(
    "stat_cor_pvalue",
    with_blocks(f"SELECT x, y, round(r, 6) AS r, {SIGNIFICANT} AS significant FROM cors", "cors"),
)
def stat_cor_pvalue(spark, folder):
    tested = stats.correlation_tests(style(spark, folder), FEATURES)
    return tested.select("x", "y", F.round("r", 6).alias("r"), "significant")


@query(
    "stat_scale",
    with_blocks("SELECT source, " + ", ".join(f"round({c}, 6) AS {c}" for c in FEATURES) + " FROM prof", "prof"),
)
def stat_scale(spark, folder):
    return profiles(spark, folder).select("source", *[F.round(c, 6).alias(c) for c in FEATURES])


@query(
    "stat_dist",
    with_blocks(
        "SELECT p.source AS a, q.source AS b, round(sqrt("
        + " + ".join(f"(p.{c} - q.{c}) * (p.{c} - q.{c})" for c in FEATURES)
        + "), 6) AS distance FROM prof p JOIN prof q ON p.source < q.source",
        "prof",
    ),
)
def stat_dist(spark, folder):
    pairs = stats.distances(profiles(spark, folder), "source", FEATURES)
    return pairs.withColumn("distance", F.round("distance", 6))


block(
    "totss", ("prof",),
    "SELECT CAST(count(*) AS BIGINT) AS n_points, " + " + ".join(f"var_pop({c}) * count(*)" for c in FEATURES) + " AS total_ss FROM prof",
)
SEED = 20240


@query("ml_kmeans")
def ml_kmeans(spark, folder):
    """k = 2 and 4 with 25 restarts and single transfers on the source profiles: cluster of each source, its size, centre and within sum of squares."""
    points, rows = materialize(profiles(spark, folder), "points"), None
    for k in (2, 4):
        best = materialize(stats.kmeans(points, FEATURES, k, restarts=25, seed=SEED), "clusters")
        clustered = stats.transfers(best, "source", FEATURES)
        facts = clustered.groupBy("cluster").agg(
            F.min("source").alias("name"), F.count("*").alias("size"), *[F.avg(c).alias(f"center_{c}") for c in FEATURES],
            sum((F.var_pop(c) * F.count("*") for c in FEATURES), F.lit(0.0)).alias("within_ss"))
        # A cluster is named by its first source: numbers differ from start to start.
        part = clustered.select("source", "cluster").join(facts, "cluster").drop("cluster").select(F.lit(k).alias("k"), "source", F.col("name").alias("cluster"), "size", "within_ss", *[f"center_{c}" for c in FEATURES])
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query("ml_kmeans_wss")
def ml_kmeans_wss(spark, folder):
    """The curve of within sums of squares for 1 to 10 clusters, each with restarts and single transfers."""
    points = materialize(profiles(spark, folder), "points")
    curve = stats.elbow(points, FEATURES, range(1, 11), SEED, restarts=5, key="source")
    return curve.select("k", "n_points", "n_clusters", "within_ss", "between_ss", "total_ss")


# Leading eigenvectors of the covariance by repeated squaring: the square of a symmetric matrix, scaled by its trace, tends to the
# projection on the leading one; the second is found after taking the first out.
_N = range(len(FEATURES))
_CELLS = [(i, j) for i in _N for j in _N if i <= j]
SQUARINGS = 30


def _cell(i: int, j: int) -> str:
    return f"m{min(i, j)}{max(i, j)}"


block("pcov", ("prof",), "SELECT " + ", ".join(f"covar_samp({FEATURES[i]}, {FEATURES[j]}) AS {_cell(i, j)}" for i, j in _CELLS) + " FROM prof")


def _squared(first: str, name: str) -> None:
    """Blocks ``name`` (unit vector v0.. with its largest part positive) and ``name`` + "left" (the matrix without it)."""
    last, trace = first, " + ".join(_cell(i, i) for i in _N)
    for step in range(SQUARINGS):
        product = {(i, j): " + ".join(f"{_cell(i, k)} * {_cell(k, j)}" for k in _N) for i, j in _CELLS}
        inner = "SELECT " + ", ".join(f"{product[c]} AS {_cell(*c)}" for c in _CELLS) + f" FROM {last}"
        block(f"{name}{step}", (last,), "SELECT " + ", ".join(f"{_cell(*c)} / ({trace}) AS {_cell(*c)}" for c in _CELLS) + f" FROM ({inner})")
        last = f"{name}{step}"
    top = f"greatest({', '.join(_cell(i, i) for i in _N)})"
    row = "CASE " + " ".join(f"WHEN {_cell(i, i)} = {top} THEN [{', '.join(_cell(i, j) for j in _N)}]" for i in _N) + " END"
    block(name, (last,), f"SELECT list_transform(r, lambda x: x / sqrt(list_inner_product(r, r))) AS v FROM (SELECT {row} AS r FROM {last})")
    value = " + ".join(f"v[{i + 1}] * v[{j + 1}] * {_cell(i, j)}" for i in _N for j in _N)
    block(name + "left", (name, first), "SELECT " + ", ".join(f"{_cell(i, j)} - w * v[{i + 1}] * v[{j + 1}] AS {_cell(i, j)}" for i, j in _CELLS) + f" FROM (SELECT *, {value} AS w FROM {first}, {name})")


_squared("pcov", "pca")
_squared("pcaleft", "pcb")


@query(
    "ml_pca_2d",
    with_blocks(
        "SELECT source, " + ", ".join(
            f"round({' + '.join(f'{c} * {t}.v[{i + 1}]' for i, c in enumerate(FEATURES))}, 5) + 0.0 AS {n}" for t, n in (("pca", "pc1"), ("pcb", "pc2"))
        ) + " FROM prof, pca, pcb",
        "prof", "pca", "pcb",
    ),
)
def ml_pca_2d(spark, folder):
    """The sources on the plane of the first two components."""
    plane = stats.principal_plane(profiles(spark, folder), FEATURES)
    return plane.select("source", *((F.round(c, 5) + 0.0).alias(c) for c in ("pc1", "pc2")))
