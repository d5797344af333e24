"""Merges of topics against the full search for the nearest pair of clusters."""

from itertools import combinations

import numpy as np
import pytest

import __spark_entry__ as entry
from corpusloom.operators import topics

FOLDER = "/root/testdata/sf0.001"
BETWEEN = {"single": np.min, "complete": np.max, "average": np.mean}


def _full_search(distance, linkage):
    clusters, out = [[t] for t in range(len(distance))], []
    while len(clusters) > 1:
        height, a, b = min((BETWEEN[linkage](distance[np.ix_(a, b)]), a, b) for a, b in combinations(clusters, 2))
        out.append((min(a[0], b[0]), max(a[0], b[0]), height))
        clusters = sorted([c for c in clusters if c not in (a, b)] + [sorted(a + b)])
    return out


@pytest.mark.parametrize("linkage", BETWEEN)
@pytest.mark.parametrize("topics_", [1, 2, 3, 9, 30])
def test_merges_of_the_full_search(linkage, topics_):
    rng = np.random.default_rng(topics_)
    half = rng.random((topics_, topics_))
    distance = np.triu(half, 1) + np.triu(half, 1).T
    found, wanted = topics.chain_merges(distance, linkage), _full_search(distance, linkage)
    assert [m[:2] for m in found] == [m[:2] for m in wanted]
    assert np.allclose([m[2] for m in found], [m[2] for m in wanted])


@pytest.mark.parametrize("apart", [1.0, 0.1, 0.7])
def test_equal_distances_give_a_whole_tree(spark, apart):
    found = topics.chain_merges(apart * (np.ones((20, 20)) - np.eye(20)))
    assert len(found) == 19 and np.allclose([m[2] for m in found], apart)
    corr = spark.createDataFrame([(a, b, 1 - apart) for a, b in combinations(range(1, 21), 2)], "a int, b int, r double")
    assert topics.topic_merges(corr, 20).where("merge = 19").count() == 20


def test_single_link_merges_are_the_cuts(spark):
    rng = np.random.default_rng(4)
    rows = [(a, b, float(rng.uniform(-1, 1))) for a, b in combinations(range(1, 9), 2)]
    corr = spark.createDataFrame(rows, "a int, b int, r double")
    merges = topics.topic_merges(corr, 8, "single").collect()
    for cut in (0.7, 0.3, -0.2):
        node = {t: t for t in range(1, 9)}
        for r in sorted((m for m in merges if m.height <= 1 - cut), key=lambda m: m.merge):
            node[r.topic] = r.low
        assert {(r.topic, r.node) for r in topics.topic_tree(corr, [cut]).collect()} == set(node.items())


def test_nodes_have_all_topics_and_words(spark):
    found = sorted(entry.queries()["topic_tree_merges"](spark, FOLDER).collect(), key=lambda r: r.merge)
    top = found[-1]
    assert [r.merge for r in found] == list(range(1, len(found) + 1))
    assert top.n_topics == len(found) + 1 and top.low == 1 and top.proportion == pytest.approx(1)
    assert [r.height for r in found] == sorted(r.height for r in found)
    assert all(len(r.terms.split(", ")) == 7 for r in found)
