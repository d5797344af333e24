"""Topic queries.

Tables and diagnostics are checked on the one-step model whose topics start
from a known attribute (languages, or sources). The spectral start is checked
up to its anchors. Iterative fits return what they found; SQL has no fit, so
their tables are checked by tests that recompute every figure from them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.scalars import log_factorial
from corpusloom.operators import spectral, topic_grid as grids, topic_model, topics
from corpusloom.plans.registry import block, query, with_blocks
from corpusloom.plans.text import noun_counts, noun_counts_of, noun_totals
from corpusloom.session import discard, materialize
from corpusloom.sources import catalog

N_SOURCES = 20
HELD_SEED = 11


# --- one-step models -------------------------------------------------------------


def lang_topic(k: int):
    """Topic 1..k of a document from its language."""
    column = F.lit(None).cast("int")
    for i, lang in reversed(list(enumerate(catalog.LANGS))):
        column = F.when(F.col("lang") == lang, 1 + i * k // len(catalog.LANGS)).otherwise(column)
    return column


def source_topic(k: int = N_SOURCES):
    """Topic 1..k of a document from the number of its source, consecutive sources together."""
    return F.floor(F.regexp_extract("source", "([0-9]+)", 1).cast("int") * k / N_SOURCES).cast("int") + 1


class OneStep:
    """Counts, weights and shares of a one-step model, with their tidy forms.

    With ``only``, some of the documents, the weights are still those of all; counts and shares are of these, and nothing else is
    counted by document. Their counts then have words without weights, too, which get no share.
    """

    def __init__(
        self, spark: SparkSession, folder: str, k: int, by_source: bool = False, counts: DataFrame | None = None, only: DataFrame | None = None
    ):
        self.k = k
        if only is None:
            # The counts feed several branches of one query; store them once.
            self.counts = materialize(noun_counts(spark, folder), "nouns") if counts is None else counts
            learned = self.counts
        else:
            self.counts = materialize(noun_counts_of(spark, only), "nouns")
            learned = noun_totals(spark, folder, ["source" if by_source else "lang"])
        weights = topics.group_topics(learned, source_topic(k) if by_source else lang_topic(k), k)
        self.weights = materialize(weights, "weights")
        self.shares = topics.one_step_shares(self.counts, self.weights, k)

    def beta(self) -> DataFrame:
        return topics.tidy(self.weights, "word", "b", self.k, "beta", name="term")

    def gamma(self) -> DataFrame:
        return topics.tidy(self.shares, "doc_id", "g", self.k, "gamma")


def _model_blocks(name: str, k: int, topic_sql: str, base: str = "nouns") -> None:
    ks = range(1, k + 1)
    block(
        f"bw{name}", (base,),
        "SELECT word, " + ", ".join(
            f"(c{i} + 0.01::DOUBLE) / (sum(c{i}) OVER () + 0.01::DOUBLE * count(*) OVER ()) AS b{i}" for i in ks
        ) + " FROM (SELECT word, " + ", ".join(
            f"coalesce(sum(n) FILTER (WHERE {topic_sql} = {i}), 0)::DOUBLE AS c{i}" for i in ks
        ) + f" FROM {base} GROUP BY word)",
    )
    total = " + ".join(f"b{i}" for i in ks)
    block(
        f"sh{name}", (base, f"bw{name}"),
        "SELECT doc_id, " + ", ".join(f"sum(n * b{i} / ({total})) / sum(n)::DOUBLE AS g{i}" for i in ks)
        + f" FROM {base} c JOIN bw{name} w ON c.word = w.word GROUP BY doc_id",
    )
    block(f"bl{name}", (f"bw{name}",), " UNION ALL ".join(f"SELECT {i} AS topic, word AS term, b{i} AS beta FROM bw{name}" for i in ks))
    block(f"gl{name}", (f"sh{name}",), " UNION ALL ".join(f"SELECT {i} AS topic, doc_id, g{i} AS gamma FROM sh{name}" for i in ks))
    block(
        f"tt{name}", (f"bl{name}",),
        "SELECT topic, string_agg(term, ', ' ORDER BY round(beta, 12) DESC, term) AS terms FROM (SELECT *, rank() OVER "
        f"(PARTITION BY topic ORDER BY round(beta, 12) DESC) AS rk FROM bl{name}) WHERE rk <= 6 GROUP BY topic",
    )
    block(
        f"rk{name}", (f"bl{name}",),
        "SELECT topic, term, beta, (rank() OVER (PARTITION BY topic ORDER BY ex) + (count(*) OVER (PARTITION BY topic, ex) - 1) / 2.0::DOUBLE) "
        "/ count(*) OVER (PARTITION BY topic) AS rx, (rank() OVER (PARTITION BY topic ORDER BY fr) + (count(*) OVER (PARTITION BY topic, fr) - 1) "
        "/ 2.0::DOUBLE) / count(*) OVER (PARTITION BY topic) AS rf FROM (SELECT topic, term, beta, round(beta / sum(beta) OVER (PARTITION BY term), 12) "
        f"AS ex, round(beta, 15) AS fr FROM bl{name})",
    )
    block(
        f"top{name}", (f"bl{name}",),
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(beta, 12) DESC, term) AS place FROM bl{name}) WHERE place <= 10",
    )
    block(
        f"ex{name}", (f"rk{name}", f"top{name}"),
        "SELECT r.topic, sum(1 / (0.7::DOUBLE / rx + 0.3::DOUBLE / rf)) AS exclusivity FROM "
        f"rk{name} r JOIN top{name} t ON r.topic = t.topic AND r.term = t.term GROUP BY r.topic",
    )
    block(
        f"has{name}", (base, f"top{name}"),
        f"SELECT DISTINCT t.topic, t.place, n.doc_id FROM {base} n JOIN top{name} t ON n.word = t.term",
    )
    block(
        f"co{name}", (f"has{name}", f"top{name}"),
        "SELECT p.topic, sum(ln((coalesce(d.c, 0) + 1)::DOUBLE / s.c)) AS semantic_coherence FROM "
        f"(SELECT a.topic, a.place AS i, b.place AS j FROM top{name} a JOIN top{name} b ON a.topic = b.topic AND b.place < a.place) p "
        f"JOIN (SELECT topic, place, count(*) AS c FROM has{name} GROUP BY ALL) s ON s.topic = p.topic AND s.place = p.j "
        f"LEFT JOIN (SELECT a.topic, a.place AS i, b.place AS j, count(*) AS c FROM has{name} a JOIN has{name} b ON a.topic = b.topic "
        "AND a.doc_id = b.doc_id AND b.place < a.place GROUP BY ALL) d ON d.topic = p.topic AND d.i = p.i AND d.j = p.j GROUP BY p.topic",
    )
    q = " + ".join(f"g{i} * b{i}" for i in ks)
    block(
        f"fit{name}", (base, f"bw{name}", f"sh{name}"),
        f"SELECT c.doc_id, c.word, c.n, {q} AS q FROM {base} c JOIN bw{name} w ON c.word = w.word JOIN sh{name} s ON c.doc_id = s.doc_id",
    )
    block(
        f"ho{name}", ("taken", f"bw{name}", f"sh{name}"),
        f"SELECT count(*) AS docs, sum(n) AS tokens, avg(score) AS expected_heldout FROM (SELECT c.doc_id, sum(n) AS n, sum(n * ln({q})) / sum(n) AS score "
        f"FROM taken c JOIN bw{name} w ON c.word = w.word JOIN sh{name} s ON c.doc_id = s.doc_id GROUP BY c.doc_id)",
    )
    # Every document-word cell: what an absent word contributes, then the exact correction of the seen ones.
    block(
        f"re{name}", (f"fit{name}", f"bw{name}", f"sh{name}"),
        f"SELECT cells, (absent + seen) / (cells - (SELECT count(*) FROM bw{name}) - docs * ({k} - 1)) AS dispersion FROM "
        f"(SELECT count(*) FILTER (WHERE m * q > 0.01::DOUBLE) AS cells, sum(m * q / (1 - q)) AS absent FROM (SELECT m, {q} AS q FROM bw{name}, sh{name} s JOIN "
        f"(SELECT doc_id, sum(n)::DOUBLE AS m FROM fit{name} GROUP BY doc_id) t ON s.doc_id = t.doc_id)), "
        f"(SELECT count(DISTINCT doc_id) AS docs, sum((n * n - 2 * n * m * q) / (m * q * (1 - q))) AS seen FROM "
        f"(SELECT *, (sum(n) OVER (PARTITION BY doc_id))::DOUBLE AS m FROM fit{name}))",
    )


# Half the tokens of a tenth of the documents, in the order of a hash.
_UNIT = f"('0x' || substr(md5('{HELD_SEED}:' || doc_id), 1, 7))::BIGINT / 268435456.0::DOUBLE"
block(
    "taken", ("nouns",),
    "SELECT doc_id, word, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY h, word, j) AS r, count(*) OVER (PARTITION BY doc_id) AS size "
    f"FROM (SELECT doc_id, word, j, md5('{HELD_SEED}:' || doc_id || ':' || word || ':' || j) AS h FROM (SELECT doc_id, word, unnest(range(1, n + 1)) AS j "
    f"FROM nouns WHERE {_UNIT} < 0.1::DOUBLE))) WHERE r <= floor(size * 0.5::DOUBLE) GROUP BY doc_id, word",
)
block(
    "kept", ("nouns", "taken"),
    "SELECT * FROM (SELECT c.doc_id, c.source, c.lang, c.word, c.n - coalesce(t.n, 0) AS n FROM nouns c LEFT JOIN taken t ON c.doc_id = t.doc_id AND c.word = t.word) WHERE n > 0",
)
_LANG_SQL = "(CASE lang " + " ".join(f"WHEN '{x}' THEN {{{i}}}" for i, x in enumerate(catalog.LANGS)) + " END)"
for _k in (2, 4):
    _model_blocks(str(_k), _k, _LANG_SQL.format(*[1 + i * _k // len(catalog.LANGS) for i in range(len(catalog.LANGS))]))
_model_blocks("s", N_SOURCES, "(CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) + 1)")
#: Numbers of topics of the grid.
KS = tuple(range(2, 21, 2))
_SOURCE_SQL = f"(CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) * {{}} // {N_SOURCES} + 1)"
for _k in KS:
    _model_blocks(f"k{_k}", _k, _SOURCE_SQL.format(_k), base="kept")
_model_blocks("h4", 4, _LANG_SQL.format(1, 2, 3, 4), base="kept")


@query(
    "topic_top_terms", with_blocks("SELECT CAST(topic AS INTEGER) AS topic, terms FROM tt4", "tt4")
)
def topic_top_terms(spark, folder):
    return topics.top_terms(OneStep(spark, folder, 4).beta(), 6)


@query(
    "topic_prevalence",
    with_blocks(
        "SELECT 'Topic ' || g.topic AS topic, round(g.gamma, 8) AS gamma, CAST(rank() OVER (ORDER BY round(g.gamma, 10) DESC) AS INTEGER) AS place, t.terms "
        "FROM (SELECT topic, avg(gamma) AS gamma FROM gl4 GROUP BY topic) g LEFT JOIN tt4 t ON g.topic = t.topic",
        "gl4", "tt4",
    ),
)
def topic_prevalence(spark, folder):
    model = OneStep(spark, folder, 4)
    return topics.prevalence(model.gamma(), model.beta()).withColumn("gamma", F.round("gamma", 8))


@query(
    "topic_posterior_export",
    with_blocks(
        "SELECT d.source, d.doc_id, " + ", ".join(f"round(s.g{i}, 8) AS X{i}" for i in range(1, 5))
        + " FROM documents d JOIN sh4 s ON d.doc_id = s.doc_id",
        "sh4",
    ),
)
def topic_posterior_export(spark, folder):
    groups = catalog.table(spark, folder, "documents").select("source", "doc_id")
    wide = topics.posterior_table(OneStep(spark, folder, 4).gamma(), groups, 4)
    return wide.select("source", "doc_id", *[F.round(f"X{i}", 8).alias(f"X{i}") for i in range(1, 5)])


@query(
    "topic_group_mean",
    with_blocks(
        "SELECT d.source, CAST(g.topic AS INTEGER) AS topic, round(avg(g.gamma), 8) AS mean, round(ln(avg(g.gamma)), 6) AS log_mean "
        "FROM gl4 g JOIN documents d ON g.doc_id = d.doc_id GROUP BY ALL",
        "gl4",
    ),
)
def topic_group_mean(spark, folder):
    groups = catalog.table(spark, folder, "documents").select("source", "doc_id")
    means = topics.group_means(OneStep(spark, folder, 4).gamma(), groups, "source")
    return means.select("source", "topic", F.round("mean", 8).alias("mean"), F.round("log_mean", 6).alias("log_mean"))


block(
    "eff", ("gls", "party"),
    "SELECT topic, avg(gamma) FILTER (WHERE party = 'B') - avg(gamma) FILTER (WHERE party = 'A') AS c FROM gls g "
    "JOIN party p ON g.doc_id = p.doc_id GROUP BY topic",
)


@query(
    "topic_effect",
    with_blocks(
        "SELECT side, CAST(topic AS INTEGER) AS topic, round(c, 8) AS coefficient FROM ("
        "SELECT * FROM (SELECT 'low' AS side, topic, c FROM eff ORDER BY round(c, 10), topic LIMIT 3) UNION ALL "
        "SELECT * FROM (SELECT 'high' AS side, topic, c FROM eff ORDER BY round(c, 10) DESC, topic LIMIT 3))",
        "eff",
    ),
)
def topic_effect(spark, folder):
    """Effect of group B against A on each of the source topics; 3 lowest and 3 highest."""
    model = OneStep(spark, folder, N_SOURCES, by_source=True)
    effect = topics.group_effect(model.gamma(), catalog.parties(spark, folder), "party", "A", "B")
    effect = materialize(effect.withColumn("__o", F.round("coefficient", 10)), "effects")
    low = effect.orderBy("__o", "topic").limit(3).withColumn("side", F.lit("low"))
    high = effect.orderBy(F.desc("__o"), "topic").limit(3).withColumn("side", F.lit("high"))
    return low.unionByName(high).select("side", "topic", F.round("coefficient", 8).alias("coefficient"))


def _labels_sql(name: str) -> str:
    value = {"prob": "beta", "frex": "1 / (0.5::DOUBLE / rx + 0.5::DOUBLE / rf)", "lift": "beta / p", "score": "beta * (lb - mlb)"}
    kinds = " UNION ALL ".join(f"SELECT topic, term, '{k}' AS kind, round({v}, 10) AS v FROM sc" for k, v in value.items())
    return with_blocks(
        "SELECT CAST(topic AS INTEGER) AS topic, kind, string_agg(term, ', ' ORDER BY place) AS terms FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY topic, kind ORDER BY v DESC, term) AS place FROM (WITH sc AS MATERIALIZED (SELECT r.*, w.p, ln(beta) AS lb, avg(ln(beta)) OVER "
        f"(PARTITION BY r.term) AS mlb FROM rk{name} r JOIN (SELECT word, sum(n)::DOUBLE / sum(sum(n)) OVER () AS p FROM nouns GROUP BY word) w "
        f"ON r.term = w.word) {kinds})) WHERE place <= 7 GROUP BY topic, kind",
        f"rk{name}", "nouns",
    )


@query("topic_labels", _labels_sql("4"))
def topic_labels(spark, folder):
    model = OneStep(spark, folder, 4)
    words = model.counts.groupBy("word").agg(F.sum("n").alias("n"))
    share = words.withColumn("p", F.col("n").cast("double") / words.select(F.sum("n")).scalar().cast("double"))
    return topics.labels(model.beta(), share)


@query(
    "topic_proportions",
    with_blocks("SELECT CAST(topic AS INTEGER) AS topic, round(avg(gamma), 8) AS proportion FROM gls GROUP BY topic", "gls"),
)
def topic_proportions(spark, folder):
    model = OneStep(spark, folder, N_SOURCES, by_source=True)
    return model.gamma().groupBy("topic").agg(F.round(F.avg("gamma"), 8).alias("proportion"))


CUTS = (0.2, 0.1, 0.05, 0.0, -0.05, -0.1, -1.0)
block(
    "tcor", ("gls",),
    "SELECT a.topic AS a, b.topic AS b, corr(a.gamma, b.gamma) AS r FROM gls a JOIN gls b ON a.doc_id = b.doc_id AND a.topic < b.topic GROUP BY ALL",
)
block("tcut", ("tcor",), "SELECT * FROM tcor, (VALUES " + ", ".join(f"({c}::DOUBLE)" for c in CUTS) + ") v(cut)")
block(
    "tnode", ("tcut",),
    "SELECT cut, topic, min(node) AS node FROM (WITH RECURSIVE reach AS (SELECT cut, a AS topic, a AS node FROM tcut UNION "
    "SELECT cut, b, b FROM tcut UNION SELECT r.cut, r.topic, e.y FROM reach r JOIN (SELECT cut, a AS x, b AS y FROM tcut WHERE r >= cut UNION ALL "
    "SELECT cut, b, a FROM tcut WHERE r >= cut) e ON r.cut = e.cut AND r.node = e.x) SELECT * FROM reach) GROUP BY cut, topic",
)


@query(
    "topic_tree",
    with_blocks(
        "SELECT s.cut, CAST(s.node AS INTEGER) AS node, s.n_topics, round(s.proportion, 8) AS proportion, t.terms FROM "
        "(SELECT n.cut, n.node, CAST(count(*) AS BIGINT) AS n_topics, sum(p.p) AS proportion FROM tnode n JOIN (SELECT topic, avg(gamma) AS p FROM gls "
        "GROUP BY topic) p ON n.topic = p.topic GROUP BY n.cut, n.node) s JOIN "
        "(SELECT cut, node, string_agg(term, ', ' ORDER BY v DESC, term) AS terms FROM (SELECT cut, node, term, v, row_number() OVER (PARTITION BY cut, node "
        "ORDER BY v DESC, term) AS place FROM (SELECT n.cut, n.node, b.term, round(sum(b.beta * p.p), 10) AS v FROM tnode n JOIN bls b ON n.topic = b.topic "
        "JOIN (SELECT topic, avg(gamma) AS p FROM gls GROUP BY topic) p ON n.topic = p.topic GROUP BY ALL)) WHERE place <= 7 GROUP BY cut, node) t "
        "ON s.cut = t.cut AND s.node = t.node",
        "tnode", "bls", "gls",
    ),
)
def topic_tree(spark, folder):
    """Single-link tree of the source topics, cut at several correlation levels, with labelled nodes."""
    model = OneStep(spark, folder, N_SOURCES, by_source=True)
    shares = materialize(model.shares, "shares")
    nodes = topics.topic_tree(topics.topic_correlations(shares, N_SOURCES), CUTS)
    gamma = topics.tidy(shares, "doc_id", "g", N_SOURCES, "gamma")
    return topics.tree_nodes(nodes, model.beta(), gamma)


@query("topic_tree_merges")
def topic_tree_merges(spark, folder):
    """Average-link tree of the source topics with merge heights, shares and words of every node."""
    model = OneStep(spark, folder, N_SOURCES, by_source=True)
    shares = materialize(model.shares, "shares")
    merges = topics.topic_merges(topics.topic_correlations(shares, N_SOURCES), N_SOURCES)
    return topics.merge_nodes(merges, model.beta(), topics.tidy(shares, "doc_id", "g", N_SOURCES, "gamma"))


# --- diagnostics on the one-step models ----------------------------------------------


@query(
    "topic_exclusivity", with_blocks("SELECT CAST(topic AS INTEGER) AS topic, round(exclusivity, 6) AS exclusivity FROM ex4", "ex4")
)
def topic_exclusivity(spark, folder):
    scored = topics.exclusivity(OneStep(spark, folder, 4).beta())
    return scored.withColumn("exclusivity", F.round("exclusivity", 6))


@query(
    "topic_coherence",
    with_blocks("SELECT CAST(topic AS INTEGER) AS topic, round(semantic_coherence, 6) AS semantic_coherence FROM co4", "co4"),
)
def topic_coherence(spark, folder):
    model = OneStep(spark, folder, 4)
    scored = topics.coherence(model.beta(), model.counts)
    return scored.withColumn("semantic_coherence", F.round("semantic_coherence", 6))


@query(
    "topic_heldout",
    with_blocks(
        "SELECT CAST(docs AS BIGINT) AS docs, CAST(tokens AS BIGINT) AS tokens, (SELECT CAST(sum(n) AS BIGINT) FROM kept) AS kept_tokens, "
        "round(expected_heldout, 6) AS expected_heldout FROM hoh4", "hoh4", "kept",
    ),
)
def topic_heldout(spark, folder):
    """Half the tokens of a tenth of the documents are taken out, the model is made of the others and scored on those."""
    kept, taken, model = _held_out_model(spark, folder, 4)
    scored = grids.token_likelihood(topics.fitted_cells(taken, model.weights, model.shares, 4))
    return scored.select("docs", "tokens", kept.select(F.sum("n")).scalar().cast("long").alias("kept_tokens"), F.round("expected_heldout", 6).alias("expected_heldout"))


def _held_out_tokens(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Stored (kept, taken). Kept tokens lie by document, so sums by document are small before they move."""
    counts = materialize(noun_counts(spark, folder), "nouns")
    kept, taken = grids.hold_out(counts, HELD_SEED)
    stored = materialize(kept.repartition("doc_id"), "kept"), materialize(taken, "taken")
    discard(counts)
    return stored


def _held_out_model(spark: SparkSession, folder: str, k: int, by_source: bool = False) -> tuple[DataFrame, DataFrame, OneStep]:
    kept, taken = _held_out_tokens(spark, folder)
    return kept, taken, OneStep(spark, folder, k, by_source, counts=kept)


@query(
    "topic_residuals", with_blocks("SELECT CAST(cells AS BIGINT) AS cells, round(dispersion, 6) AS dispersion FROM re4", "re4")
)
def topic_residuals(spark, folder):
    """Dispersion over all document-word cells, those without a count too."""
    model = OneStep(spark, folder, 4)
    dense = grids.dense_dispersion(model.counts, model.weights, materialize(model.shares, "shares"), 4)
    return dense.withColumn("dispersion", F.round("dispersion", 6))


def one_step_metrics(spark: SparkSession, folder: str, ks: Sequence[int]) -> DataFrame:
    """One row of fit metrics per K, of models made from the kept tokens."""
    kept, taken = _held_out_tokens(spark, folder)
    rows = None
    for k in ks:
        model = OneStep(spark, folder, k, by_source=True, counts=kept)
        shares = materialize(model.shares, "shares")
        score = topics.fitted_cells(kept, model.weights, shares, k).agg(F.sum(F.col("n") * F.ln("q")).alias("bound")).withColumn("K", F.lit(k))
        row = score.withColumn("lbound", F.col("bound") + log_factorial(F.col("K")))
        # Each metric is one row, stored by itself so that what it moves is gone before the next; scalar subqueries put them side by side.
        row = materialize(row, "bound").withColumns({
            "dispersion": materialize(grids.dense_dispersion(kept, model.weights, shares, k), "dispersion").select("dispersion").scalar(),
            "expected_heldout": materialize(grids.token_likelihood(topics.fitted_cells(taken, model.weights, shares, k)), "heldout").select("expected_heldout").scalar(),
            "semantic_coherence": materialize(topics.coherence(model.beta(), kept), "coherence").select(F.avg("semantic_coherence")).scalar(),
        })
        discard(shares)
        discard(model.weights)
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query(
    "topic_diagnostics_long",
    with_blocks(
        " UNION ALL ".join(
            f"SELECT {k} AS K, 'Lower bound' AS \"Metric\", round(sum(n * ln(q)) + lgamma({k} + 1), 3) AS \"Value\" FROM fitk{k} UNION ALL "
            f"SELECT {k}, 'Residuals', round(dispersion, 6) FROM rek{k} UNION ALL "
            f"SELECT {k}, 'Semantic coherence', round(avg(semantic_coherence), 6) FROM cok{k} UNION ALL "
            f"SELECT {k}, 'Held-out likelihood', round(expected_heldout, 6) FROM hok{k}"
            for k in KS
        ),
        *[f"{b}k{k}" for k in KS for b in ("fit", "re", "co", "ho")],
    ),
)
def topic_diagnostics_long(spark, folder):
    long = topics.diagnostics_long(one_step_metrics(spark, folder, KS))
    digits = F.when(F.col("Metric") == "Lower bound", F.round("Value", 3)).otherwise(F.round("Value", 6))
    return long.withColumn("Value", digits)


@query(
    "topic_excl_vs_coh",
    with_blocks(
        " UNION ALL ".join(
            f"SELECT {k} AS K, CAST(e.topic AS INTEGER) AS topic, round(e.exclusivity, 6) AS exclusivity, round(c.semantic_coherence, 6) AS semantic_coherence "
            f"FROM exk{k} e JOIN cok{k} c ON e.topic = c.topic"
            for k in KS[1:5]
        ),
        *[f"{b}k{k}" for k in KS[1:5] for b in ("ex", "co")],
    ),
)
def topic_excl_vs_coh(spark, folder):
    kept, _, _ = _held_out_model(spark, folder, 2)
    rows = None
    for k in KS[1:5]:
        beta = materialize(OneStep(spark, folder, k, by_source=True, counts=kept).beta(), "beta")
        both = topics.exclusivity(beta).join(topics.coherence(beta, kept), "topic")
        part = both.select(
            F.lit(k).alias("K"), "topic", F.round("exclusivity", 6).alias("exclusivity"),
            F.round("semantic_coherence", 6).alias("semantic_coherence"),
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows


# --- spectral start ----------------------------------------------------------------------

GRAM_COLUMNS, ANCHOR_COLUMNS, ANCHORS = 50, 200, 10
block("nsize", ("nouns",), "SELECT doc_id, sum(n)::DOUBLE AS size FROM nouns GROUP BY doc_id HAVING sum(n) > 1")
block("nplace", ("nouns",), "SELECT word, row_number() OVER (ORDER BY sum(n) DESC, word) AS place FROM nouns GROUP BY word")
block(
    "gram", ("nouns", "nsize", "nplace"),
    "SELECT a.word, p.place, p.word AS col, sum(CASE WHEN a.word = b.word THEN a.n * (a.n - 1) ELSE a.n * b.n END / (size * (size - 1))) AS value "
    f"FROM nouns a JOIN nsize s ON a.doc_id = s.doc_id JOIN nouns b ON a.doc_id = b.doc_id JOIN nplace p ON b.word = p.word AND p.place <= {ANCHOR_COLUMNS} GROUP BY ALL",
)
block("gmass", ("nouns", "nsize"), "SELECT word, sum(n / size) AS mass FROM nouns c JOIN nsize s ON c.doc_id = s.doc_id GROUP BY word")


def _gram(spark: SparkSession, folder: str, columns: int, rows=spectral.cooccurrence) -> tuple[DataFrame, DataFrame, list[int]]:
    cells, vocabulary = topic_model.corpus_cells(nouns(spark, folder))
    terms = spectral.column_terms(vocabulary, columns)
    return materialize(rows(topic_model.document_rows(cells), terms), "cooccurrence"), vocabulary, terms


@query(
    "topic_cooccurrence",
    with_blocks(
        f"SELECT g.word, g.col, round(value, 9) AS value, round(mass, 8) AS mass FROM gram g JOIN gmass m ON g.word = m.word WHERE place <= {GRAM_COLUMNS} AND round(value, 9) > 0",
        "gram", "gmass",
    ),
)
def topic_cooccurrence(spark, folder):
    """Co-occurrence of every topic word with the most used ones: what the spectral start is made of."""
    rows, vocabulary, terms = _gram(spark, folder, GRAM_COLUMNS)
    columns = spark.createDataFrame(list(enumerate(terms)), "at INT, __column BIGINT")
    names = columns.join(vocabulary.select(F.col("term").alias("__column"), F.col("word").alias("col")), "__column").select("at", "col")
    cells = rows.select("term", "mass", F.posexplode("row").alias("at", "value")).where(F.round("value", 9) > 0)
    named = cells.join(names, "at").join(vocabulary.select("term", "word"), "term")
    return named.select("word", "col", F.round("value", 9).alias("value"), F.round("mass", 8).alias("mass"))


def _anchor_blocks() -> None:
    block(
        "an0", ("gram", "gmass", "nplace"),
        "SELECT q.word, q.place, list(coalesce(g.value, 0) / m.mass ORDER BY c.place) AS row FROM nplace q JOIN gmass m ON q.word = m.word "
        f"JOIN nplace c ON c.place <= {ANCHOR_COLUMNS} LEFT JOIN gram g ON g.word = q.word AND g.place = c.place WHERE q.place <= {ANCHOR_COLUMNS} GROUP BY q.word, q.place",
    )
    for i in range(ANCHORS):
        block(f"pick{i}", (f"an{i}",), f"SELECT word, row, sqrt(list_inner_product(row, row)) AS size FROM an{i} ORDER BY round(list_inner_product(row, row), 10) DESC, place LIMIT 1")
        block(
            f"an{i + 1}", (f"an{i}", f"pick{i}"),
            "SELECT a.word, a.place, list_transform(list_zip(a.row, p.row), lambda x: x[1] - list_inner_product(a.row, p.row) / (size * size) * x[2]) AS row "
            f"FROM an{i} a, pick{i} p",
        )


_anchor_blocks()


@query(
    "topic_anchors",
    with_blocks(" UNION ALL ".join(f"SELECT {i + 1} AS place, word FROM pick{i}" for i in range(ANCHORS)), *[f"pick{i}" for i in range(ANCHORS)]),
)
def topic_anchors(spark, folder):
    """The words that stand for one topic each, chosen one after another."""
    rows, vocabulary, terms = _gram(spark, folder, ANCHOR_COLUMNS, spectral.column_rows)
    chosen, _ = spectral.anchors(rows, terms, ANCHORS)
    places = spark.createDataFrame([(i + 1, t) for i, t in enumerate(chosen)], "place INT, term BIGINT")
    return places.join(vocabulary.select("term", "word"), "term").select("place", "word")


# --- iterative fit ----------------------------------------------------------------------


TOPICS = 10


def nouns(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(noun_counts(spark, folder).select("doc_id", "word", "n"), "nouns")


def fitted(spark: SparkSession, folder: str, k: int) -> topic_model.TopicModel:
    """A model from the spectral start, to convergence."""
    return topic_model.fit_topics(nouns(spark, folder), k, max_iter=500, start="spectral")


@query("topic_fit")
def topic_fit(spark, folder):
    """Ten topics: the probability of every word in each."""
    return fitted(spark, folder, TOPICS).beta.select("topic", "term", F.round("beta", 8).alias("beta"))


@query("topic_fit_prevalence")
def topic_fit_prevalence(spark, folder):
    """Prevalence of ten topics on group and a spline of the document number, over the labelled documents: coefficients against the last topic."""
    meta = materialize(catalog.parties(spark, folder), "meta")
    counts = materialize(noun_counts(spark, folder).join(meta.select("doc_id"), "doc_id").select("doc_id", "word", "n"), "nouns")
    covariates = topic_model.prevalence_covariates(meta, [F.col("party") == "B"], spline="doc_id")
    model = topic_model.fit_topics(counts, TOPICS, covariates=covariates, max_iter=500, start="spectral")
    names = ["(Intercept)", "party_B", *[f"s{i}" for i in range(1, model.gamma.shape[0] - 1)]]
    rows = [(n, t + 1, float(v)) for n, line in zip(names, model.gamma) for t, v in enumerate(line)]
    return spark.createDataFrame(rows, "covariate STRING, topic INT, coefficient DOUBLE")


@query("topic_beta_tidy")
def topic_beta_tidy(spark, folder):
    """(topic, term, beta) of six topics."""
    return fitted(spark, folder, 6).beta


@query("topic_gamma_tidy")
def topic_gamma_tidy(spark, folder):
    """(doc_id, topic, gamma) of six topics."""
    return topics.tidy_theta(fitted(spark, folder, 6).theta)


def wide_weights(beta: DataFrame, k: int) -> DataFrame:
    wide = beta.groupBy("term").pivot("topic", list(range(1, k + 1))).agg(F.max("beta"))
    return wide.withColumnsRenamed({"term": "word", **{str(i): f"b{i}" for i in range(1, k + 1)}})


def wide_shares(theta: DataFrame, k: int) -> DataFrame:
    return theta.select("doc_id", *[F.col("theta")[i - 1].alias(f"g{i}") for i in range(1, k + 1)])


def grid_metrics(models: dict[int, topic_model.TopicModel], kept: DataFrame, taken: DataFrame) -> DataFrame:
    """One row of diagnostics for each fitted model."""
    spark, rows = kept.sparkSession, None
    for k, model in models.items():
        weights, shares = materialize(wide_weights(model.beta, k), "weights"), wide_shares(model.theta, k)
        row = topics.bound_summary(model.trace_table(spark)).withColumns({
            "exclusivity": topics.exclusivity(model.beta).select(F.avg("exclusivity")).scalar(),
            "semantic_coherence": topics.coherence(model.beta, kept).select(F.avg("semantic_coherence")).scalar(),
            "expected_heldout": grids.token_likelihood(topics.fitted_cells(taken, weights, shares, k)).select("expected_heldout").scalar(),
            "dispersion": grids.dense_dispersion(kept, weights, shares, k).select("dispersion").scalar(),
        })
        # One model after another: the tables that each one's joins broadcast go through the driver.
        row = materialize(row, "metrics")
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query("topic_grid")
def topic_grid(spark, folder):
    """Models of 2 to 20 topics, fitted to the kept tokens in one pass a round, and what they are compared by."""
    kept, taken = grids.hold_out(nouns(spark, folder), HELD_SEED)
    kept, taken = materialize(kept, "kept"), materialize(taken, "taken")
    return grid_metrics(grids.fit_grid(kept, KS), kept, taken)


@query("topic_select")
def topic_select(spark, folder):
    """Topic shares of every document by the model of six topics out of the grid."""
    models = grids.fit_grid(nouns(spark, folder), KS)
    return topics.tidy_theta(models[6].theta).select(F.lit(6).alias("K"), "doc_id", "topic", "gamma")


@query("topic_bound")
def topic_bound(spark, folder):
    """The bound after every round of a fit of ten topics, and the best one with the logarithm of the topics' orders."""
    model = fitted(spark, folder, TOPICS)
    trace = model.trace_table(spark)
    best = topics.bound_summary(trace).select("K", "lfact", "lbound", "iterations")
    return trace.join(best, "K").select("K", "iter", "bound", "lfact", "lbound", "iterations")
