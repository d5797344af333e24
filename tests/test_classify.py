"""Splits, leave-one-out, evaluation tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from corpusloom.operators import classify
from corpusloom.sources import files
from corpusloom.session import materialize, scratch_path


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    n = 120
    label = (rng.random(n) < 0.3).astype(float)
    pdf = pd.DataFrame({"doc_id": range(n), "label": label, "x": label + rng.normal(0, 0.8, n), "z": rng.normal(size=n)})
    return spark.createDataFrame(pdf), pdf


def test_split_sizes_and_folds(rows):
    df, pdf = rows
    marked = classify.split_stratified(df, "doc_id", "label", 0.75, 1).toPandas()
    for value, part in marked.groupby("label"):
        assert part["is_train"].sum() == math.ceil(0.75 * len(part))
    folds = classify.fold_numbers(df, "doc_id", "label", 5, 1).toPandas()
    for _, part in folds.groupby("label"):
        sizes = part["fold"].value_counts()
        assert sizes.max() - sizes.min() <= 1


def test_split_ignores_partitioning(rows):
    df, _ = rows
    pick = lambda d: {r.doc_id for r in classify.split_stratified(d, "doc_id", "label", 0.7, 4).filter("is_train").collect()}
    assert pick(df.repartition(1)) == pick(df.repartition(16))


def test_auc_and_roc_equal_brute_force(rows):
    df, pdf = rows
    scored = df.withColumn("s", F.round("x", 1))
    s, y = pdf["x"].round(1).to_numpy(), pdf["label"].to_numpy()
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    got = classify.auc(scored, "s", F.col("label") == 1).first()
    assert math.isclose(got.auc, want) and (got.n_pos, got.n_neg) == (len(pos), len(neg))
    for r in classify.roc(scored, "s", F.col("label") == 1).collect():
        assert math.isclose(r.tpr, (pos >= r.threshold).mean()) and math.isclose(r.fpr, (neg >= r.threshold).mean())


def test_gains_end_at_one(rows):
    df, pdf = rows
    table = classify.gains_lift(df, "x", F.col("label") == 1).toPandas().sort_values("grp")
    assert table["n"].sum() == len(pdf) and math.isclose(table["gain"].iloc[-1], 1.0)
    assert math.isclose(table["cum_lift"].iloc[-1], 1.0)


def test_accuracy_table(spark):
    cells = spark.createDataFrame([("a", "a", 40), ("a", "b", 10), ("b", "a", 5), ("b", "b", 45)], "t STRING, p STRING, n BIGINT")
    row = classify.accuracy_table(cells, "t", "p").first()
    assert math.isclose(row.accuracy, 0.85) and math.isclose(row.kappa, 0.7) and math.isclose(row.mean_class_error, 0.15)


def test_leave_one_out_naive_bayes_equals_refits(spark):
    rng = np.random.default_rng(9)
    cells = [(d, f"w{w}", int(n)) for d in range(12) for w, n in enumerate(rng.poisson(1.0 + (d % 2) * (np.arange(6) < 3), 6)) if n]
    cells += [(12, "other", 3)]
    label = {d: "A" if d % 2 else "B" for d in range(13)}
    vocab = [f"w{i}" for i in range(6)]
    want = {}
    for left in range(13):
        score = {}
        for c in "AB":
            kept = [d for d in label if d != left and label[d] == c]
            totals = {w: sum(n for d, x, n in cells if x == w and d in kept) for w in vocab}
            base = sum(totals.values()) + len(vocab)
            score[c] = math.log(len(kept) / 12) + sum(n * (math.log(totals[x] + 1) - math.log(base)) for d, x, n in cells if d == left and x in totals)
        want[left] = max(score, key=lambda c: (score[c], c))  # equal scores go to the later label
    got = classify.loo_naive_bayes(
        spark.createDataFrame(cells, "doc_id BIGINT, word STRING, n BIGINT"),
        spark.createDataFrame(list(label.items()), "doc_id BIGINT, party STRING"),
        "doc_id", "party", ("A", "B"), spark.createDataFrame([(w,) for w in vocab], "word STRING"),
    )
    assert {r.doc_id: r.predicted for r in got.collect()} == want


def test_cross_validate_one_fold_per_row(spark, rows):
    df, _ = rows
    small = classify.assemble(df.filter("doc_id < 12"), ["x", "z"]).withColumn("fold", F.col("doc_id").cast("int"))
    scores = classify.cross_validate(materialize(small, "small"), LogisticRegression(labelCol="label", maxIter=5), "label", "fold", range(12))
    assert len(scores) == 12 and all(n == 1 and s in (0.0, 1.0) for _, n, s in scores)


def test_leaderboard_weights_and_saved_model(spark, rows):
    df, pdf = rows
    weighted = classify.class_weights(classify.split_stratified(df, "doc_id", "label", 0.7, 2), "label")
    sums = {r.label: r.s for r in weighted.groupBy("label").agg(F.sum("weight").alias("s")).collect()}
    assert all(math.isclose(s, len(pdf) / 2) for s in sums.values())
    stored = materialize(weighted, "weighted")
    board, best = classify.leaderboard(stored.filter("is_train"), stored.filter("not is_train"), ["x", "z"], "label", "doc_id", "weight", 1)
    table = board.toPandas()
    assert len(table) == 5 and table["auc"].is_monotonic_decreasing and table["auc"].iloc[0] > 0.6
    path = scratch_path(spark, "best-model")
    files.save_object(best, path)
    assert files.load_object(spark, path, type(best)).uid == best.uid


def test_word_vectors_keep_whole_vocabulary(spark):
    docs = spark.createDataFrame([(0, "a b a 7 c_1"), (1, "b b d")], "doc_id BIGINT, text STRING")
    words = classify.vocabulary(docs, 3)
    assert words == ["b", "a", "d"]
    rows = {r.doc_id: r.words_vec.toArray().tolist() for r in classify.word_vectors(docs, words).collect()}
    assert rows == {0: [1.0, 2.0, 0.0], 1: [2.0, 0.0, 1.0]}


def test_only_grouped_documents_are_measured(spark, tmp_path, monkeypatch):
    """Style and positivity were measured in all documents; topic weights still come from all of them."""
    from corpusloom.plans import classify as plans
    from corpusloom.plans import topics
    from corpusloom.sources import catalog

    words = ["nation", "freedom", "great", "loss", "station", "terrible"]
    docs = [(d, " ".join(words[(d * i) % 6] for i in range(1, 9)) + ".", ["de", "en", "es", "fr", None][d % 5], f"src_{d % 3}", 1) for d in range(24)]
    docs += [(4, "a nation again", "en", "src_1", 1), (None, "no key", "en", "src_1", 1), (25, None, "en", "src_1", 1)]
    spark.createDataFrame(docs, catalog.SCHEMAS["documents"]).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(d, d % 2, 0) for d in (0, 4, 4, 7, 25, 99)] + [(None, 1, 0)]
    spark.createDataFrame(labels, catalog.SCHEMAS["labels"]).write.parquet(str(tmp_path / "labels.parquet"))
    seen = []
    for module, name in ((plans, "style"), (plans.sentiment, "positivity")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, _f=real, **k: seen.append([x for x in (*a, *k.values()) if "text" in getattr(x, "columns", ())]) or _f(*a, **k))
    table = plans.classification_table(spark, str(tmp_path))
    # Copies of a key stay, keys without a group and null keys do not.
    assert sorted(r.doc_id for r in table.collect()) == [0, 4, 4, 4, 4, 7, 25]
    assert [sorted(r.doc_id for r in frames[0].select("doc_id").collect()) for frames in seen] == [[0, 4, 4, 7, 25]] * 2
    whole = {r.doc_id: tuple(r)[1:] for r in topics.OneStep(spark, str(tmp_path), 4).shares.collect()}
    part = {r.doc_id: tuple(r)[1:] for r in topics.OneStep(spark, str(tmp_path), 4, only=plans.grouped_documents(spark, str(tmp_path))).shares.collect()}
    assert set(part) == {0, 4, 7} & set(whole) and part and all(np.allclose(part[d], whole[d], rtol=1e-12) for d in part)
