"""Two-group classification: features, splits, cross-validation, models, evaluation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import CountVectorizerModel, MinMaxScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.grouped import attach
from corpusloom.operators.ordered import hash_rank, running_total
from corpusloom.operators.tokens import drop_stop_chars, explode_words, term_counts, top_vocabulary

# --- features --------------------------------------------------------------------


def vocabulary(docs: DataFrame, size: int = 1000) -> list[str]:
    """The ``size`` most used words without stop characters. At most ``size`` strings reach the driver."""
    counts = drop_stop_chars(term_counts(explode_words(docs.select("text")), []))
    return [r["word"] for r in top_vocabulary(counts, size).collect()]


def word_vectors(docs: DataFrame, words: Sequence[str], out: str = "words_vec") -> DataFrame:
    """Adds a sparse count vector over a fixed vocabulary, inside the row."""
    spark_model = CountVectorizerModel.from_vocabulary(list(words), inputCol="__w", outputCol=out)
    return spark_model.transform(docs.withColumn("__w", X.words("text"))).drop("__w")


def assemble(df: DataFrame, inputs: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(inputs), outputCol=out, handleInvalid="keep").transform(df)


# --- splits ----------------------------------------------------------------------


def split_stratified(df: DataFrame, key: str, label: str, share: float, seed: int, out: str = "is_train") -> DataFrame:
    """Marks ceil(share * n) rows of each label as training rows, in seeded hash order."""
    ranked = hash_rank(df, key, [label], seed, "__r")
    sized = attach(ranked, [label], F.count(F.lit(1)).alias("__n"))
    return sized.withColumn(out, F.col("__r") <= F.ceil(F.lit(share) * F.col("__n"))).drop("__r", "__n")


def fold_numbers(df: DataFrame, key: str, label: str, folds: int, seed: int, out: str = "fold") -> DataFrame:
    """Balanced fold numbers 0..folds-1 inside each label."""
    ranked = hash_rank(df, key, [label], seed, "__r")
    return ranked.withColumn(out, F.pmod(F.col("__r") - 1, F.lit(folds)).cast("int")).drop("__r")


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Adds n / (classes * n_class), so every class weighs the same."""
    counts = df.groupBy(label).agg(F.count("*").alias("__n"))
    one = counts.select(F.struct(F.sum("__n").alias("n"), F.count("*").alias("c")).alias("s")).scalar()
    weighted = counts.select(label, (one["n"].cast("double") / (one["c"] * F.col("__n")).cast("double")).alias(out))
    return df.join(weighted, label)


# --- models ----------------------------------------------------------------------


def fit_gbm(train: DataFrame, label: str, depths: Sequence[int], trees: Sequence[int], folds: int, seed: int, features: str = "features") -> Model:
    """Boosted trees tuned over depth and number of trees by cross-validated accuracy."""
    gbm = GBTClassifier(labelCol=label, featuresCol=features, seed=seed, stepSize=0.1)
    choices = ParamGridBuilder().addGrid(gbm.maxDepth, list(depths)).addGrid(gbm.maxIter, list(trees)).build()
    if len(choices) == 1:
        return gbm.copy(choices[0]).fit(train)
    score = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    tuned = CrossValidator(estimator=gbm, estimatorParamMaps=choices, evaluator=score, numFolds=folds, seed=seed, parallelism=4)
    return tuned.fit(train).bestModel


def cross_validate(
    df: DataFrame, estimator: Estimator, label: str, fold: str, folds: Sequence[int], metric: str = "accuracy", parallelism: int = 4
) -> list[tuple[int, int, float]]:
    """(fold, test rows, score) with each fold held out once.

    ``df`` should be a stored table. With one fold per row this is plain
    leave-one-out; ``loo_naive_bayes`` gives that in a single pass.
    """
    score = MulticlassClassificationEvaluator(labelCol=label, metricName=metric)

    def one(number: int) -> tuple[int, int, float]:
        held = df.filter(F.col(fold) == number)
        predicted = estimator.fit(df.filter(F.col(fold) != number)).transform(held)
        return number, held.count(), float(score.evaluate(predicted))

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return list(pool.map(one, folds))


def loo_naive_bayes(counts: DataFrame, labels: DataFrame, key: str, label: str, classes: Sequence[str], words: DataFrame) -> DataFrame:
    """Leave-one-out prediction of multinomial naive Bayes for every document.

    Leaving a document out only lowers its own class's counts by its own, so
    all n fits follow from one table of class totals: one join on the word and
    one sum per document. Equal scores go to the later label. ``counts`` is
    (key, word, n), ``words`` the vocabulary.
    """
    cells = counts.join(words.select("word"), "word").join(labels.select(key, label), key)
    per_word = cells.groupBy("word").agg(
        *[F.sum(F.when(F.col(label) == c, F.col("n")).otherwise(0)).alias(f"w_{c}") for c in classes]
    )
    totals = per_word.select(F.struct(*[F.sum(f"w_{c}").alias(c) for c in classes], F.count("*").alias("v")).alias("s")).scalar()
    docs = labels.select(F.struct(*[F.sum(F.when(F.col(label) == c, 1).otherwise(0)).alias(c) for c in classes], F.count("*").alias("n")).alias("s")).scalar()
    own = attach(cells, [key], F.sum("n").alias("size")).join(per_word, "word")

    def mine(c: str):
        return (F.col(label) == c).cast("long")

    scored = own.groupBy(key, label).agg(*[
        F.sum(
            F.col("n") * (
                F.ln((F.col(f"w_{c}") - mine(c) * F.col("n") + 1).cast("double"))
                - F.ln((totals[c] - mine(c) * F.col("size") + totals["v"]).cast("double"))
            )
        ).alias(f"l_{c}")
        for c in classes
    ])
    priors = {c: F.ln((docs[c] - mine(c)).cast("double") / (docs["n"] - 1).cast("double")) for c in classes}
    # A document without vocabulary words is decided by the priors.
    every = labels.select(key, label).join(scored.drop(label), key, "left")
    posterior = [F.struct((F.coalesce(f"l_{c}", F.lit(0.0)) + priors[c]).alias("v"), F.lit(c).alias("c")) for c in classes]
    return every.select(key, label, F.array_max(F.array(*posterior))["c"].alias("predicted"))


def candidates(label: str, weight: str, inputs: int, seed: int) -> dict[str, Callable[[], Estimator]]:
    """The fixed model list of the leaderboard."""
    return {
        "logistic": lambda: LogisticRegression(labelCol=label, weightCol=weight, regParam=0.01, maxIter=30),
        "forest": lambda: RandomForestClassifier(labelCol=label, weightCol=weight, numTrees=20, maxDepth=5, seed=seed),
        "boosted": lambda: GBTClassifier(labelCol=label, weightCol=weight, maxIter=10, maxDepth=3, seed=seed),
        "bayes": lambda: NaiveBayes(labelCol=label, weightCol=weight, modelType="gaussian"),
        "perceptron": lambda: MultilayerPerceptronClassifier(labelCol=label, layers=[inputs, 8, 2], maxIter=40, seed=seed),
    }


def leaderboard(
    train: DataFrame, test: DataFrame, inputs: Sequence[str], label: str, key: str, weight: str, seed: int
) -> tuple[DataFrame, Model]:
    """Models ranked by test AUC, and the best one. Both inputs should be stored tables."""
    scaled = Pipeline(stages=[
        VectorAssembler(inputCols=list(inputs), outputCol="raw"), MinMaxScaler(inputCol="raw", outputCol="features"),
    ]).fit(train)
    ready, held = scaled.transform(train), scaled.transform(test)
    scores, fits = [], {}
    for name, make in candidates(label, weight, len(inputs), seed).items():
        fits[name] = make().fit(ready)
        scored = fits[name].transform(held).select(key, F.col(label).alias("actual"), vector_to_array("probability")[1].alias("score"))
        area = auc(scored, "score", F.col("actual") == 1).first()
        scores.append((name, area["auc"], area["n_pos"], area["n_neg"]))
    ranked = sorted(scores, key=lambda r: -(r[1] or 0.0))
    rows = [(i + 1, *row) for i, row in enumerate(ranked)]
    board = train.sparkSession.createDataFrame(rows, "place INT, model STRING, auc DOUBLE, n_pos BIGINT, n_neg BIGINT")
    return board, fits[ranked[0][0]]


def importances(model: Model, names: Sequence[str]) -> list[tuple[str, float]]:
    return [(n, float(v)) for n, v in zip(names, model.featureImportances.toArray())]


# --- evaluation -------------------------------------------------------------------


def confusion(predictions: DataFrame, actual: str, predicted: str) -> DataFrame:
    return predictions.groupBy(actual, predicted).agg(F.count("*").alias("n"))


def accuracy_table(table: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy, Cohen's kappa and mean per-class error of a confusion table."""
    n = F.col("n")
    rows = table.groupBy(F.col(actual).alias("__c")).agg(
        F.sum(n).alias("row"), F.sum(F.when(F.col(actual) == F.col(predicted), n).otherwise(0)).alias("hit")
    )
    columns = table.groupBy(F.col(predicted).alias("__c")).agg(F.sum(n).alias("col"))
    both = rows.join(columns, "__c", "left").na.fill(0, ["col"])
    sums = both.agg(
        F.sum("row").alias("n"), F.sum("hit").alias("hits"), F.sum(F.col("row") * F.col("col")).alias("chance"),
        F.avg(1 - F.col("hit") / F.col("row")).alias("mean_class_error"),
    )
    total = F.col("n").cast("double")
    chance = F.col("chance") / (total * total)
    hit = F.col("hits") / total
    return sums.select("n", hit.alias("accuracy"), F.try_divide(hit - chance, 1 - chance).alias("kappa"), "mean_class_error")


def _score_totals(scored: DataFrame, score: str, positive) -> DataFrame:
    marked = scored.select(F.col(score).alias("s"), positive.cast("long").alias("pos"), (~positive).cast("long").alias("neg"))
    return running_total(marked, "s", ["pos", "neg"])


def auc(scored: DataFrame, score: str, positive) -> DataFrame:
    """Exact area under the ROC curve by mid-ranks, from bucketed running counts."""
    totals = _score_totals(scored, score, positive)
    below = F.col("neg_cum") - F.col("neg") / 2.0
    area = F.sum(F.col("pos") * below) / (F.max("pos_all").cast("double") * F.max("neg_all").cast("double"))
    return totals.agg(area.alias("auc"), F.max("pos_all").alias("n_pos"), F.max("neg_all").alias("n_neg"))


def roc(scored: DataFrame, score: str, positive) -> DataFrame:
    """(threshold, tpr, fpr) at every distinct score, rows scoring at least the threshold called positive."""
    totals = _score_totals(scored, score, positive)

    def rate(m: str):
        return F.try_divide((F.col(f"{m}_all") - F.col(f"{m}_cum") + F.col(m)).cast("double"), F.col(f"{m}_all").cast("double"))

    return totals.select(F.col("s").alias("threshold"), rate("pos").alias("tpr"), rate("neg").alias("fpr"))


def gains_lift(scored: DataFrame, score: str, positive, groups: int = 16) -> DataFrame:
    """Cumulative gain and lift by score group; equal scores stay in one group."""
    marked = scored.select((-F.col(score)).alias("s"), positive.cast("long").alias("pos"), F.lit(1).cast("long").alias("n"))
    totals = running_total(marked, "s", ["pos", "n"])
    number = F.ceil(F.col("n_cum") * F.lit(groups) / F.col("n_all")).cast("int")
    grouped = totals.withColumn("grp", number).groupBy("grp").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.max("n_cum").alias("cum_n"), F.max("pos_cum").alias("cum_pos"),
        F.max("n_all").alias("n_all"), F.max("pos_all").alias("pos_all"),
    )
    gain = F.try_divide(F.col("cum_pos").cast("double"), F.col("pos_all").cast("double"))
    lift = F.try_divide(gain, F.col("cum_n") / F.col("n_all"))
    return grouped.select("grp", "n", "pos", "cum_n", "cum_pos", gain.alias("gain"), lift.alias("cum_lift"))
