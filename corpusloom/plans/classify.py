"""Classification queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import boosting, classify, grouped, sentiment, tokens
from corpusloom.plans.registry import STOPPED, block, query, with_blocks
from corpusloom.plans.stats import style
from corpusloom.plans.topics import OneStep
from corpusloom.session import materialize
from corpusloom.sources import catalog
from corpusloom.sources.lexicons import lexicon

SEED = 42
STYLE = ("Flesch_Kincaid", "n_words", "mean_sent_length")


def _target():
    return (F.col("party") == "B").cast("double").alias("label")


def grouped_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Whole rows of the documents that carry a group: what joins them to the groups measures no others."""
    return catalog.documents(spark, folder).join(catalog.parties(spark, folder), "doc_id", "left_semi")


def style_features(spark: SparkSession, folder: str) -> DataFrame:
    table = style(spark, folder, grouped_documents(spark, folder)).join(catalog.parties(spark, folder), "doc_id")
    return table.select("doc_id", "party", _target(), *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in STYLE])


def word_features(spark: SparkSession, folder: str) -> DataFrame:
    docs = catalog.labelled(spark, folder).select("doc_id", "party", "text")
    vectors = classify.word_vectors(docs, classify.vocabulary(docs))
    return vectors.select("doc_id", "party", _target(), "words_vec")


def combined_features(spark: SparkSession, folder: str) -> DataFrame:
    return style_features(spark, folder).join(word_features(spark, folder).select("doc_id", "words_vec"), "doc_id")


block(
    "top1000", ("tp",),
    f"SELECT word FROM tp WHERE NOT regexp_matches(word, {STOPPED}) GROUP BY word ORDER BY count(*) DESC, word LIMIT 1000",
)
block(
    "wsum", ("tp", "top1000"),
    "SELECT t.doc_id, count(*) AS n_tokens, count(DISTINCT t.word) AS n_terms FROM tp t JOIN top1000 k ON t.word = k.word GROUP BY t.doc_id",
)
block(
    "sfeat", ("style", "party"),
    "SELECT s.doc_id, p.party, " + ", ".join(f"coalesce(s.{c}, 0)::DOUBLE AS {c}" for c in STYLE)
    + " FROM style s JOIN party p ON s.doc_id = p.doc_id",
)


@query(
    "feat_style",
    with_blocks("SELECT doc_id, party, " + ", ".join(f"round({c}, 8) AS {c}" for c in STYLE) + " FROM sfeat", "sfeat"),
)
def feat_style(spark, folder):
    return style_features(spark, folder).select("doc_id", "party", *[F.round(c, 8).alias(c) for c in STYLE])


def _vector_sums(df: DataFrame) -> list:
    from pyspark.ml.functions import vector_to_array

    values = vector_to_array("words_vec")
    return [
        F.aggregate(values, F.lit(0.0), lambda a, b: a + b).cast("long").alias("n_tokens"),
        F.size(F.filter(values, lambda v: v > 0)).cast("long").alias("n_terms"),
    ]


_WORD_SQL = "SELECT p.doc_id, p.party, {extra}CAST(coalesce(w.n_tokens, 0) AS BIGINT) AS n_tokens, CAST(coalesce(w.n_terms, 0) AS BIGINT) AS n_terms FROM {source} p LEFT JOIN wsum w ON p.doc_id = w.doc_id"


@query("feat_words", with_blocks(_WORD_SQL.format(extra="", source="party"), "party", "wsum"))
def feat_words(spark, folder):
    """Sparse vectors of the 1000 most used words, shown by their sums."""
    df = word_features(spark, folder)
    return df.select("doc_id", "party", *_vector_sums(df))


@query(
    "feat_combined",
    with_blocks(
        _WORD_SQL.format(extra="".join(f"round(p.{c}, 8) AS {c}, " for c in STYLE), source="sfeat"), "sfeat", "wsum"
    ),
)
def feat_combined(spark, folder):
    df = combined_features(spark, folder)
    return df.select("doc_id", "party", *[F.round(c, 8).alias(c) for c in STYLE], *_vector_sums(df))


TABLE = ("F_measure", "Flesch_Kincaid", "n_words", "mean_sent_length", "prop_positive", "X1", "X2", "X3", "X4")


def classification_table(spark: SparkSession, folder: str) -> DataFrame:
    """Style, positivity and topic shares of the grouped documents, joined by key."""
    docs = grouped_documents(spark, folder)
    styled = style(spark, folder, docs).drop("lang", "source").join(catalog.parties(spark, folder), "doc_id")
    scored = sentiment.positivity(docs, lexicon(spark, "sentiments"), ["doc_id"])
    shares = OneStep(spark, folder, 4, only=docs).shares.withColumnsRenamed({f"g{k}": f"X{k}" for k in range(1, 5)})
    return grouped.reduce_left_join([styled, scored.select("doc_id", "prop_positive"), shares], "doc_id")


@query(
    "feat_classification_table",
    with_blocks(
        "SELECT s.doc_id, p.party, "
        + ", ".join(f"round({c}, 8) AS {c}" for c in ("F_measure", "Flesch_Kincaid", "n_words::DOUBLE", "mean_sent_length", "prop_positive")).replace("AS n_words::DOUBLE", "AS n_words")
        + ", " + ", ".join(f"round(h.g{k}, 8) AS X{k}" for k in range(1, 5))
        + ", CAST(coalesce(w.n_tokens, 0) AS BIGINT) AS n_tokens, CAST(coalesce(w.n_terms, 0) AS BIGINT) AS n_terms FROM style s JOIN party p ON s.doc_id = p.doc_id "
        "LEFT JOIN posit q ON s.doc_id = q.doc_id LEFT JOIN sh4 h ON s.doc_id = h.doc_id LEFT JOIN wsum w ON s.doc_id = w.doc_id",
        "style", "party", "posit", "sh4", "wsum",
    ),
)
def feat_classification_table(spark, folder):
    table = classification_table(spark, folder)
    words = word_features(spark, folder).select("doc_id", "words_vec")
    df = table.join(words, "doc_id")
    return df.select("doc_id", "party", *[F.round(F.col(c).cast("double"), 8).alias(c) for c in TABLE], *_vector_sums(df))


# --- splits ------------------------------------------------------------------------

block(
    "hashed", ("party",),
    f"SELECT doc_id, party, row_number() OVER (PARTITION BY party ORDER BY md5('{SEED}:' || doc_id), doc_id) AS r, "
    "count(*) OVER (PARTITION BY party) AS n FROM party",
)


@query(
    "split_stratified",
    with_blocks("SELECT doc_id, party, r <= ceil(0.75::DOUBLE * n) AS is_train FROM hashed", "hashed"),
)
def split_stratified(spark, folder):
    return classify.split_stratified(catalog.parties(spark, folder), "doc_id", "party", 0.75, SEED)


@query(
    "factor_summary",
    with_blocks("SELECT party, r <= ceil(0.7::DOUBLE * n) AS is_train, CAST(count(*) AS BIGINT) AS n FROM hashed GROUP BY ALL", "hashed"),
)
def factor_summary(spark, folder):
    """Class counts in the training and the test part."""
    marked = classify.split_stratified(catalog.parties(spark, folder), "doc_id", "party", 0.7, SEED)
    return marked.groupBy("party", "is_train").agg(F.count("*").alias("n"))


@query(
    "class_balance",
    with_blocks(
        "SELECT party, CAST(count(*) AS BIGINT) AS n, round((SELECT count(*) FROM party)::DOUBLE / (2 * count(*)), 8) AS weight, "
        "round((SELECT count(*) FROM party)::DOUBLE / 2, 4) AS total FROM party GROUP BY party",
        "party",
    ),
)
def class_balance(spark, folder):
    weighted = classify.class_weights(catalog.parties(spark, folder), "party")
    return weighted.groupBy("party").agg(
        F.count("*").alias("n"), F.round(F.max("weight"), 8).alias("weight"), F.round(F.sum("weight"), 4).alias("total")
    )


# --- cross-validation and models ------------------------------------------------------

block(
    "nbcell", ("tp", "top1000"),
    "SELECT t.doc_id, t.party, t.word, count(*) AS n FROM tp t JOIN top1000 k ON t.word = k.word GROUP BY ALL",
)
block(
    "nbword", ("nbcell",),
    "SELECT word, coalesce(sum(n) FILTER (WHERE party = 'A'), 0) AS wa, coalesce(sum(n) FILTER (WHERE party = 'B'), 0) AS wb FROM nbcell GROUP BY word",
)
block("nbtot", ("nbword", "party"), "SELECT sum(wa) AS ta, sum(wb) AS tb, count(*) AS v, (SELECT count(*) FROM party WHERE party = 'A') AS na, (SELECT count(*) FROM party WHERE party = 'B') AS nb FROM nbword")
block(
    "nbscore", ("nbcell", "nbword", "nbtot"),
    "SELECT c.doc_id, sum(c.n * (ln((w.wa - CASE WHEN party = 'A' THEN c.n ELSE 0 END + 1)::DOUBLE) - ln((ta - CASE WHEN party = 'A' THEN size ELSE 0 END + v)::DOUBLE))) AS la, "
    "sum(c.n * (ln((w.wb - CASE WHEN party = 'B' THEN c.n ELSE 0 END + 1)::DOUBLE) - ln((tb - CASE WHEN party = 'B' THEN size ELSE 0 END + v)::DOUBLE))) AS lb "
    "FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS size FROM nbcell) c JOIN nbword w ON c.word = w.word, nbtot GROUP BY c.doc_id",
)


@query(
    "cv_loocv",
    with_blocks(
        "SELECT party, CASE WHEN coalesce(lb, 0) + ln((nb - CASE WHEN party = 'B' THEN 1 ELSE 0 END)::DOUBLE / (na + nb - 1)) >= "
        "coalesce(la, 0) + ln((na - CASE WHEN party = 'A' THEN 1 ELSE 0 END)::DOUBLE / (na + nb - 1)) THEN 'B' ELSE 'A' END AS predicted, "
        "CAST(count(*) AS BIGINT) AS n FROM party p LEFT JOIN nbscore s ON p.doc_id = s.doc_id, nbtot GROUP BY ALL",
        "party", "nbscore", "nbtot",
    ),
)
def cv_loocv(spark, folder):
    """Leave-one-out confusion table over all labelled documents (naive Bayes on word counts)."""
    docs = catalog.labelled(spark, folder).select("doc_id", "text")
    counts = materialize(tokens.term_counts(tokens.explode_words(docs), ["doc_id"]), "counts")
    words = tokens.top_vocabulary(tokens.drop_stop_chars(counts), 1000)
    predicted = classify.loo_naive_bayes(counts, catalog.parties(spark, folder), "doc_id", "party", catalog.GROUPS, words)
    return classify.confusion(predicted, "party", "predicted")


#: The grid of boosted trees: depths, numbers of trees, folds.
DEPTHS, STAGES, FOLDS = (1, 2, 3), (50, 100, 150), 3


@query("cv_repeated")
def cv_repeated(spark, folder):
    """Five repeats of five-fold cross-validation of 100 boosted trees on the style features."""
    base = classify.assemble(style_features(spark, folder), STYLE).select("doc_id", "party", "label", "features")
    base = materialize(base, "style-features")
    folded = base
    for r in range(5):
        folded = classify.fold_numbers(folded, "doc_id", "party", 5, SEED + r, out=f"fold{r}")
    folded = materialize(folded, "folds")
    rows = None
    for r in range(5):
        scores = boosting.staged_grid(folded, "doc_id", "label", f"fold{r}", (2,), (100,), 5, SEED)
        right = ((F.col("margin") > 0) == (F.col("label") > 0.5)).cast("int")
        table = scores.groupBy("fold").agg(F.count("*").alias("n_test"), F.avg(right).alias("accuracy")).select(F.lit(r).alias("repeat"), "fold", "n_test", "accuracy")
        rows = table if rows is None else rows.unionByName(table)
    return rows


def _feature_sets(spark: SparkSession, folder: str) -> DataFrame:
    """One stored table with the three feature vectors, the split mark and fold numbers."""
    both = combined_features(spark, folder)
    ready = classify.assemble(classify.assemble(both, STYLE, "style"), [*STYLE, "words_vec"], "combined")
    marked = classify.split_stratified(
        ready.select("doc_id", "party", "label", "style", F.col("words_vec").alias("words"), "combined"), "doc_id", "party", 0.75, SEED
    )
    return materialize(classify.fold_numbers(marked, "doc_id", "party", FOLDS, SEED + 9), "feature-sets")


block("parts", ("hashed",), "SELECT doc_id, party, r <= ceil(0.75::DOUBLE * n) AS is_train FROM hashed")


def tuned_trees(table: DataFrame, features: str) -> tuple[DataFrame, DataFrame]:
    """(grid, test predictions) of boosted trees tuned over depth and number of trees on the training rows."""
    train, test = table.where("is_train"), table.where("NOT is_train")
    scores = boosting.staged_grid(train, "doc_id", "label", "fold", DEPTHS, STAGES, FOLDS, SEED, features)
    grid = materialize(boosting.grid_accuracy(scores, "label"), "grid")
    best = grid.where("chosen").first()
    model = boosting.fit_trees(train, "label", best["depth"], best["trees"], SEED, features)
    margin = F.col("margins")[0]
    scored = boosting.staged_scores(model, test, ["doc_id", "party", "label"], [best["trees"]], features)
    return grid, scored.select("doc_id", "party", "label", margin.alias("margin"), F.when(margin > 0, "B").otherwise("A").alias("predicted"))


@query("clf_gbm")
def clf_gbm(spark, folder):
    """Boosted trees on the three feature sets: cross-validated accuracy over depth and trees, and the chosen ones' test accuracy."""
    table, rows = _feature_sets(spark, folder), None
    for name in ("words", "style", "combined"):
        grid, predicted = tuned_trees(table, name)
        tested = materialize(predicted, "predicted").select(F.avg((F.col("party") == F.col("predicted")).cast("int"))).scalar()
        part = grid.select(F.lit(name).alias("feature_set"), "depth", "trees", "n", "accuracy", "chosen", F.when(F.col("chosen"), tested).alias("test_accuracy"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query("clf_predict")
def clf_predict(spark, folder):
    """Test predictions of the tuned trees on the style features."""
    features = classify.assemble(style_features(spark, folder), STYLE)
    marked = classify.split_stratified(features, "doc_id", "party", 0.75, SEED)
    folded = classify.fold_numbers(marked.select("doc_id", "party", "label", "features", "is_train"), "doc_id", "party", FOLDS, SEED + 9)
    _, predicted = tuned_trees(materialize(folded, "style-split"), "features")
    return predicted.select("doc_id", "party", "predicted", "margin")


def _board_table(spark: SparkSession, folder: str) -> DataFrame:
    """Stored table of style, positivity, topic shares and words of the grouped documents."""
    words = word_features(spark, folder).select("doc_id", F.col("words_vec").alias("words"))
    table = classification_table(spark, folder).select("doc_id", "party", _target(), *[F.coalesce(c, F.lit(0.0)).cast("double").alias(c) for c in TABLE])
    return materialize(table.join(words, "doc_id"), "board-table")


@query("automl_leaderboard")
def automl_leaderboard(spark, folder):
    """Five model families with balanced classes and their stacked ensemble, ranked by cross-validated AUC."""
    ready = boosting.scaled_features(_board_table(spark, folder), [*TABLE, "words"]).select("doc_id", "party", "label", "features")
    marked = classify.class_weights(classify.split_stratified(ready, "doc_id", "party", 0.7, SEED), "party")
    stored = materialize(classify.fold_numbers(marked, "doc_id", "party", 5, SEED + 9), "leaderboard")
    return boosting.stacked_leaderboard(stored, "doc_id", "label", "weight", "fold", 5, "is_train", SEED)[1]


@query("eval_varimp")
def eval_varimp(spark, folder):
    """Loss of AUC of boosted trees when a column, or all word counts together, is dealt anew."""
    table, columns = _board_table(spark, folder), [*TABLE, "words"]
    model = boosting.fit_trees(materialize(classify.assemble(table, columns), "varimp"), "label", 3, 50, SEED)
    return boosting.permutation_importance(model, table, "doc_id", "label", columns, SEED, lambda rows: classify.assemble(rows, columns))


# --- evaluation ---------------------------------------------------------------------

block("scored", ("partypos",), "SELECT doc_id, party, round(prop_positive, 6) AS score, party = 'B' AS pos FROM partypos")


def scored_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, party, score): positivity of the grouped documents as a ready-made score."""
    scored = sentiment.positivity(catalog.labelled(spark, folder), lexicon(spark, "sentiments"), ["doc_id", "party"])
    return scored.select("doc_id", "party", F.round("prop_positive", 6).alias("score"))


def _called(spark, folder):
    return scored_documents(spark, folder).withColumn("predicted", F.when(F.col("score") >= 0.6, "B").otherwise("A"))


block("called", ("scored",), "SELECT party, CASE WHEN score >= 0.6::DOUBLE THEN 'B' ELSE 'A' END AS predicted FROM scored")


@query(
    "eval_confusion", with_blocks("SELECT party, predicted, CAST(count(*) AS BIGINT) AS n FROM called GROUP BY ALL", "called")
)
def eval_confusion(spark, folder):
    return classify.confusion(_called(spark, folder), "party", "predicted")


@query(
    "eval_mean_class_error",
    with_blocks(
        "SELECT n, round(acc, 8) AS accuracy, round((acc - ch) / (1 - ch), 8) AS kappa, round(err, 8) AS mean_class_error FROM (SELECT CAST(sum(r) AS BIGINT) AS n, "
        "sum(hit)::DOUBLE / sum(r) AS acc, sum(r * col)::DOUBLE / (sum(r)::DOUBLE * sum(r)::DOUBLE) AS ch, avg(1 - hit::DOUBLE / r) AS err FROM "
        "(SELECT c, (SELECT count(*) FROM called WHERE party = c) AS r, (SELECT count(*) FROM called WHERE predicted = c) AS col, "
        "(SELECT count(*) FROM called WHERE party = c AND predicted = c) AS hit FROM (SELECT DISTINCT party AS c FROM called)))",
        "called",
    ),
)
def eval_mean_class_error(spark, folder):
    table = classify.accuracy_table(classify.confusion(_called(spark, folder), "party", "predicted"), "party", "predicted")
    return table.select("n", *[F.round(c, 8).alias(c) for c in ("accuracy", "kappa", "mean_class_error")])


@query(
    "eval_auc",
    with_blocks(
        "SELECT round((sum(CASE WHEN pos THEN mid END) - np * (np + 1) / 2.0::DOUBLE) / (np::DOUBLE * nn), 8) AS auc, CAST(np AS BIGINT) AS n_pos, CAST(nn AS BIGINT) AS n_neg FROM "
        "(SELECT pos, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS mid, count(*) FILTER (WHERE pos) OVER () AS np, "
        "count(*) FILTER (WHERE NOT pos) OVER () AS nn FROM scored) GROUP BY np, nn",
        "scored",
    ),
)
def eval_auc(spark, folder):
    return classify.auc(scored_documents(spark, folder), "score", F.col("party") == "B").withColumn("auc", F.round("auc", 8))


@query(
    "eval_roc",
    with_blocks(
        "SELECT DISTINCT score AS threshold, round((count(*) FILTER (WHERE pos) OVER w)::DOUBLE / count(*) FILTER (WHERE pos) OVER (), 8) AS tpr, "
        "round((count(*) FILTER (WHERE NOT pos) OVER w)::DOUBLE / count(*) FILTER (WHERE NOT pos) OVER (), 8) AS fpr FROM scored "
        "WINDOW w AS (ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
        "scored",
    ),
)
def eval_roc(spark, folder):
    points = classify.roc(scored_documents(spark, folder), "score", F.col("party") == "B")
    return points.select("threshold", F.round("tpr", 8).alias("tpr"), F.round("fpr", 8).alias("fpr"))


@query(
    "eval_gains_lift",
    with_blocks(
        "SELECT grp, CAST(n AS BIGINT) AS n, CAST(p AS BIGINT) AS pos, CAST(cn AS BIGINT) AS cum_n, CAST(cp AS BIGINT) AS cum_pos, round(cp::DOUBLE / ap, 8) AS gain, "
        "round((cp::DOUBLE / ap) / (cn::DOUBLE / an), 8) AS cum_lift FROM (SELECT grp, n, p, sum(n) OVER o AS cn, sum(p) OVER o AS cp, sum(n) OVER () AS an, sum(p) OVER () AS ap "
        "FROM (SELECT grp, count(*) AS n, count(*) FILTER (WHERE pos) AS p FROM (SELECT pos, CAST(ceil(16 * (count(*) OVER (ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING "
        "AND CURRENT ROW))::DOUBLE / count(*) OVER ()) AS INTEGER) AS grp FROM scored) GROUP BY grp) WINDOW o AS (ORDER BY grp))",
        "scored",
    ),
)
def eval_gains_lift(spark, folder):
    table = classify.gains_lift(scored_documents(spark, folder), "score", F.col("party") == "B")
    return table.withColumns({"gain": F.round("gain", 8), "cum_lift": F.round("cum_lift", 8)})
