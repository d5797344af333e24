"""Topic model: document solution, both term-table paths, covariates, tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import topic_model as tm
from corpusloom.operators import topics


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for doc in range(60):
        p = np.full(30, 0.2)
        p[(doc % 3) * 10:(doc % 3) * 10 + 10] += 5
        for i, n in enumerate(rng.multinomial(80, p / p.sum())):
            if n:
                rows.append((doc, words[i], int(n)))
    return spark.createDataFrame(rows, "doc_id BIGINT, word STRING, n BIGINT")


def test_document_solution_is_a_maximum():
    rng = np.random.default_rng(0)
    k, sizes = 4, [5, 1, 8]
    counts = rng.integers(1, 6, sum(sizes)).astype(float)
    beta = rng.dirichlet(np.ones(k), sum(sizes))
    starts = np.array([0, 5, 6])
    mu = rng.normal(size=(3, k - 1))
    precision = np.linalg.inv(np.eye(k - 1) * 2.0 + 0.3)
    eta, nu, phi, _ = tm.solve_documents(counts, beta, starts, mu, precision, steps=60)

    def value(d, e):
        full = np.append(e, 0.0)
        theta = np.exp(full - full.max())
        theta /= theta.sum()
        cells = slice(starts[d], starts[d] + sizes[d])
        gap = e - mu[d]
        return counts[cells] @ np.log(beta[cells] @ theta) - 0.5 * gap @ precision @ gap

    for d in range(3):
        for j in range(k - 1):
            for step in (1e-3, -1e-3):
                moved = eta[d].copy()
                moved[j] += step
                assert value(d, moved) <= value(d, eta[d]) + 1e-9
        assert np.all(np.linalg.eigvalsh(nu[d]) > 0)
    assert np.allclose(phi.sum(axis=1), counts)


def test_documents_are_solved_by_themselves_and_rest_when_they_are_done(monkeypatch):
    rng = np.random.default_rng(1)
    k, sizes = 10, rng.integers(1, 120, 300)
    counts = rng.integers(1, 6, sizes.sum()).astype(float)
    beta = rng.dirichlet(np.full(k, 0.2), sizes.sum()) + 1e-6
    starts, mu, precision = np.concatenate([[0], np.cumsum(sizes)[:-1]]), rng.normal(size=(300, k - 1)), np.eye(k - 1)
    logged, log = [], np.log
    monkeypatch.setattr(np, "log", lambda x, *a, **b: (logged.append(np.size(x)), log(x, *a, **b))[1])
    together = tm.solve_documents(counts, beta, starts, mu, precision, steps=40)
    monkeypatch.undo()
    # A step looks at a document's cells once, and again only where it went too far.
    assert sum(logged) < 70 * sizes.sum()
    for d in (0, 7, 299):
        cells = slice(starts[d], starts[d] + sizes[d])
        alone = tm.solve_documents(counts[cells], beta[cells], np.array([0]), mu[d : d + 1], precision, steps=40)
        for a, b in zip(together, alone):
            assert np.allclose(a[cells] if len(a) == len(counts) else a[d : d + 1], b, atol=1e-8)


def test_fit_recovers_blocks_and_bound_rises(spark, corpus):
    model = tm.fit_topics(corpus, 3, max_iter=8, seed=3)
    # Rises until the last step, which may be the fall that ends the fit.
    assert all(b > a for a, b in zip(model.trace[:-1], model.trace[1:-1])) and model.trace[-1] > model.trace[0]
    theta = {r.doc_id: np.array(r.theta) for r in model.theta.collect()}
    assert len(theta) == 60 and all(math.isclose(t.sum(), 1.0) for t in theta.values())
    sums = {r.topic: r.s for r in model.beta.groupBy("topic").agg(F.sum("beta").alias("s")).collect()}
    assert set(sums) == {1, 2, 3} and all(math.isclose(s, 1.0, rel_tol=1e-9) for s in sums.values())


def test_joined_term_table_gives_the_same_fit(spark, corpus):
    small = tm.fit_topics(corpus, 3, max_iter=2, seed=3)
    joined = tm.fit_topics(corpus, 3, max_iter=2, seed=3, broadcast_limit=0)
    assert np.allclose(small.trace, joined.trace)
    a = small.beta.toPandas().sort_values(["topic", "term"])["beta"].to_numpy()
    b = joined.beta.toPandas().sort_values(["topic", "term"])["beta"].to_numpy()
    assert np.allclose(a, b)


def test_covariates_and_given_start(spark, corpus):
    meta = corpus.select("doc_id").distinct().withColumn("party", F.when(F.col("doc_id") % 3 == 0, "B").otherwise("A"))
    x = tm.prevalence_covariates(meta, [F.col("party") == "B"], spline="doc_id")
    assert {len(r.x) for r in x.collect()} == {12}
    start = topics.group_topics(corpus.join(meta, "doc_id"), (F.col("doc_id") % 3).cast("int") + 1, 3)
    start = start.select("word", F.array("b1", "b2", "b3").alias("b"))
    model = tm.fit_topics(corpus, 3, covariates=x, start=start, max_iter=4)
    effect = topics.group_effect(topics.tidy_theta(model.theta), meta, "party", "A", "B").toPandas().set_index("topic")
    assert effect["coefficient"].idxmax() == 1 and effect["coefficient"].abs().max() > 0.5
    assert model.gamma.shape == (12, 2)


def test_labels_on_a_literal_table(spark):
    beta = spark.createDataFrame(
        [(1, "a", 0.5), (1, "b", 0.3), (1, "c", 0.1), (1, "d", 0.1), (2, "a", 0.1), (2, "b", 0.1), (2, "c", 0.2), (2, "d", 0.6)],
        "topic INT, term STRING, beta DOUBLE",
    )
    share = spark.createDataFrame([("a", 0.4), ("b", 0.1), ("c", 0.2), ("d", 0.3)], "word STRING, p DOUBLE")
    got = {(r.topic, r.kind): r.terms for r in topics.labels(beta, share, n=2).collect()}
    assert got[1, "prob"] == "a, b" and got[1, "lift"] == "b, a"  # lift 3.0 and 1.25
    # score of a: 0.5 * (ln 0.5 - (ln 0.5 + ln 0.1) / 2) = 0.402; of b: 0.165
    assert got[1, "score"] == "a, b" and got[2, "prob"] == "d, c"


def test_coherence_by_hand(spark):
    beta = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.3), (1, "c", 0.2)], "topic INT, term STRING, beta DOUBLE")
    cells = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1), (3, "c", 1)], "doc_id BIGINT, word STRING, n BIGINT")
    got = topics.coherence(beta, cells, n=3).first().semantic_coherence
    assert math.isclose(got, math.log(2 / 2) + math.log(1 / 2) + math.log(1 / 1))


def test_tree_levels(spark):
    corr = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.2), (2, 3, 0.5), (1, 4, -0.5), (2, 4, -0.5), (3, 4, -0.9)], "a INT, b INT, r DOUBLE")
    got = {}
    for r in topics.topic_tree(corr, [0.8, 0.4, -1.0]).collect():
        got.setdefault(r.cut, {})[r.topic] = r.node
    assert got == {0.8: {1: 1, 2: 1, 3: 3, 4: 4}, 0.4: {1: 1, 2: 1, 3: 1, 4: 4}, -1.0: {1: 1, 2: 1, 3: 1, 4: 1}}


def test_bound_summary_and_heldout(spark):
    trace = spark.createDataFrame([(3, 1, -10.0), (3, 2, -8.0)], "K INT, iter INT, bound DOUBLE")
    row = topics.bound_summary(trace).first()
    assert (row.bound, row.iterations) == (-8.0, 2) and math.isclose(row.lbound, -8.0 + math.log(6))
    fitted = spark.createDataFrame([(d, f"w{w}", 2, 0.25) for d in range(40) for w in range(10)], "doc_id BIGINT, word STRING, n BIGINT, q DOUBLE")
    held = topics.held_out_likelihood(fitted, seed=1, doc_share=0.5).first()
    assert 5 < held.docs < 35 and math.isclose(held.expected_heldout, math.log(0.25))


def test_words_of_left_out_documents_get_no_number(spark, corpus):
    """Terms found only in documents without covariates leave no gaps, on either side of the size limit."""
    lonely = spark.createDataFrame([(1000, f"a{i}", 3) for i in range(5)] + [(1001, f"zz{i}", 2) for i in range(5)], "doc_id BIGINT, word STRING, n BIGINT")
    meta = corpus.select("doc_id").distinct().select("doc_id", F.array(F.lit(1.0), (F.col("doc_id") % 2).cast("double")).alias("x"))
    fits = [tm.fit_topics(corpus.union(lonely), 3, meta, max_iter=4, broadcast_limit=limit) for limit in (tm.BROADCAST_LIMIT, 0)]
    tables = [f.beta.toPandas().sort_values(["topic", "term"]) for f in fits]
    assert [len(t) for t in tables] == [90, 90] and not tables[0]["term"].str.match("a|zz").any()
    assert np.allclose(tables[0]["beta"], tables[1]["beta"], atol=1e-6) and np.allclose(fits[0].trace, fits[1].trace)
    assert np.allclose(tables[0].groupby("topic")["beta"].sum(), 1)


def test_coherence_of_many_terms(spark):
    rng = np.random.default_rng(2)
    terms = [f"t{i:02d}" for i in range(45)]
    docs = [set(rng.choice(terms, size=rng.integers(1, 30), replace=False)) for _ in range(40)]
    beta = spark.createDataFrame([(1, t, 1.0 / (i + 1)) for i, t in enumerate(terms)], "topic INT, term STRING, beta DOUBLE")
    counts = spark.createDataFrame([(d, t, 1) for d, ts in enumerate(docs) for t in ts], "doc_id BIGINT, word STRING, n BIGINT")
    top = terms[:40]
    expected = 0.0
    for i in range(1, 40):
        for j in range(i):
            alone = sum(top[j] in d for d in docs)
            expected += math.log((sum(top[i] in d and top[j] in d for d in docs) + 1) / alone) if alone else 0.0
    assert math.isclose(topics.coherence(beta, counts, n=40).first()["semantic_coherence"], expected, rel_tol=1e-9)
    with pytest.raises(ValueError):
        topics.coherence(beta, counts, n=63)
