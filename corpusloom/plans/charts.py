"""Chart-ready tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import charts, measures, sentiment, stats, topics
from corpusloom.plans.registry import query, with_blocks
from corpusloom.plans.stats import FEATURES, SIGNIFICANT, profiles, style
from corpusloom.plans.topics import OneStep
from corpusloom.session import materialize
from corpusloom.sources import catalog
from corpusloom.sources.lexicons import lexicon


@query(
    "viz_box_stats",
    "SELECT l.l_returnflag, CAST(count(*) AS BIGINT) AS n, round(any_value(q1), 6) AS q1, round(any_value(q2), 6) AS median, round(any_value(q3), 6) AS q3, "
    "min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) AS lower, "
    "max(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) AS upper, "
    "CAST(count(*) FILTER (WHERE NOT (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1))) AS BIGINT) AS outliers FROM "
    "(SELECT l_returnflag, l_extendedprice AS v FROM lineitem) l JOIN (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, "
    "quantile_cont(l_extendedprice, 0.5) AS q2, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY l_returnflag) q "
    "ON l.l_returnflag = q.l_returnflag GROUP BY l.l_returnflag",
)
def viz_box_stats(spark, folder):
    items = catalog.table(spark, folder, "lineitem").select("l_returnflag", "l_extendedprice")
    table = charts.box_stats(items, "l_extendedprice", ["l_returnflag"])
    return table.withColumns({q: F.round(q, 6) for q in ("q1", "median", "q3")})


@query(
    "viz_box_style",
    with_blocks(
        "SELECT p.party, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(r.Flesch_Kincaid, 0.25), 6) AS q1, "
        "round(quantile_cont(r.Flesch_Kincaid, 0.5), 6) AS median, round(quantile_cont(r.Flesch_Kincaid, 0.75), 6) AS q3 FROM readab r "
        "JOIN party p ON r.doc_id = p.doc_id GROUP BY p.party",
        "readab", "party",
    ),
)
def viz_box_style(spark, folder):
    scored = measures.readability(catalog.labelled(spark, folder), ["doc_id", "party"], unique=True).filter("n_words > 0")
    table = charts.box_stats(scored, "Flesch_Kincaid", ["party"])
    return table.select("party", "n", *[F.round(q, 6).alias(q) for q in ("q1", "median", "q3")])


@query(
    "viz_group_vs_mean",
    with_blocks(
        "SELECT r.doc_id, r.source, round(r.Flesch_Kincaid, 6) AS value, round(avg(r.Flesch_Kincaid) OVER (PARTITION BY r.source), 6) AS group_mean, "
        "round(avg(r.Flesch_Kincaid) OVER (), 6) AS overall_mean, round(v.level_value, 6) AS level_value FROM readab r JOIN "
        "(SELECT f.source, avg(b.doc_id) AS level_value FROM (SELECT source, row_number() OVER (ORDER BY doc_id) AS i FROM readab) f JOIN "
        "(SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS i FROM readab) b ON f.i = b.i GROUP BY f.source) v ON r.source = v.source",
        "readab",
    ),
)
def viz_group_vs_mean(spark, folder):
    docs = catalog.documents(spark, folder).select("doc_id", "source", "text")
    scored = measures.readability(docs, ["doc_id", "source"], unique=True).filter("n_words > 0")
    # The scores feed four branches: the rows, two means and the axis order.
    stored = materialize(scored.select("doc_id", "source", F.col("Flesch_Kincaid").alias("value")), "scores")
    table = charts.group_vs_mean(stored, "doc_id", "source", "value")
    return table.withColumns({c: F.round(c, 6) for c in ("value", "group_mean", "overall_mean", "level_value")})


@query(
    "viz_corr_tiles",
    with_blocks(f"SELECT x, y, round(r, 4) AS r, NOT ({SIGNIFICANT}) AS crossed FROM cors WHERE x < y", "cors"),
)
def viz_corr_tiles(spark, folder):
    """Lower triangle of correlations; non-significant ones are crossed out."""
    tested = stats.correlation_tests(style(spark, folder), FEATURES).filter("x < y")
    return tested.select("x", "y", F.round("r", 4).alias("r"), (~F.col("significant")).alias("crossed"))


@query(
    "viz_facet_share",
    with_blocks(
        "SELECT lang, sentiment, round(n::DOUBLE / sum(n) OVER (PARTITION BY lang), 8) AS proportion FROM (SELECT t.lang, s.sentiment, count(*) AS n "
        "FROM tok t JOIN sentiments s ON t.word = s.word WHERE NOT regexp_matches(s.sentiment, 'pos|neg') GROUP BY ALL)",
        "tok", "sentiments",
    ),
)
def viz_facet_share(spark, folder):
    shares = sentiment.sentiment_shares(
        catalog.documents(spark, folder), lexicon(spark, "sentiments"), ["lang"], polarity=False
    )
    return shares.select("lang", "sentiment", F.round("proportion", 8).alias("proportion"))


@query(
    "viz_heatmap",
    with_blocks(
        "SELECT m.source, CAST(m.topic AS INTEGER) AS topic, round(ln(m.mean), 6) AS log_mean, round(v.level_value, 6) AS level_value FROM "
        "(SELECT d.source, g.topic, avg(g.gamma) AS mean FROM gl4 g JOIN documents d ON g.doc_id = d.doc_id GROUP BY ALL) m JOIN "
        "(SELECT f.source, avg(b.doc_id) AS level_value FROM (SELECT source, row_number() OVER (ORDER BY doc_id) AS i FROM documents) f JOIN "
        "(SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS i FROM documents) b ON f.i = b.i GROUP BY f.source) v ON m.source = v.source",
        "gl4",
    ),
)
def viz_heatmap(spark, folder):
    """(source, topic, ln mean share) tiles in axis order."""
    groups = catalog.table(spark, folder, "documents").select("doc_id", "source")
    means = topics.group_means(OneStep(spark, folder, 4).gamma(), groups, "source")
    levels = charts.reversed_levels(groups, "doc_id", "source")
    tiles = means.join(levels, "source")
    return tiles.select("source", "topic", F.round("log_mean", 6).alias("log_mean"), F.round("level_value", 6).alias("level_value"))


@query(
    "viz_heatmap_distance",
    with_blocks(
        "SELECT p.source AS a, q.source AS b, round(sqrt("
        + " + ".join(f"(p.{c} - q.{c}) * (p.{c} - q.{c})" for c in FEATURES)
        + "), 6) AS distance FROM prof p JOIN prof q ON p.source <> q.source",
        "prof",
    ),
)
def viz_heatmap_distance(spark, folder):
    """Distance tiles in both directions."""
    pairs = stats.distances(profiles(spark, folder), "source", FEATURES)
    pairs = pairs.withColumn("distance", F.round("distance", 6))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
