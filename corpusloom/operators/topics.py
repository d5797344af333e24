"""Topic tables: tidy forms, diagnostics, labels, effects and the topic tree.

Everything here works on two long tables, (topic, term, beta) and
(doc_id, topic, gamma), whatever model they come from.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.scalars import log_factorial, ratio
from corpusloom.operators.grouped import attach, join_hot, top_n_ties
from corpusloom.operators.ordered import running_total
from corpusloom.session import materialize

SMOOTHING = 0.01


# --- one-step model from known groups --------------------------------------------


def group_topics(counts: DataFrame, topic: Column, topics: int) -> DataFrame:
    """Term weights from a given topic of each document: (word, b1..bK), smoothed."""
    sums = counts.withColumn("__t", topic).groupBy("word").agg(
        *[F.sum(F.when(F.col("__t") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(1, topics + 1)]
    )
    totals = sums.agg(F.count("*").alias("v"), *[F.sum(f"c{k}").alias(f"c{k}") for k in range(1, topics + 1)])
    one = totals.select(F.struct("*").alias("s")).scalar()
    return sums.select(
        "word",
        *[
            ((F.col(f"c{k}") + SMOOTHING) / (one[f"c{k}"] + SMOOTHING * one["v"])).alias(f"b{k}") for k in range(1, topics + 1)
        ],
    )


def one_step_shares(counts: DataFrame, weights: DataFrame, topics: int) -> DataFrame:
    """One expectation step: (doc_id, g1..gK), the mean topic responsibility of a document's tokens."""
    total = reduce(lambda a, b: a + b, [F.col(f"b{k}") for k in range(1, topics + 1)])
    joined = join_hot(counts.select("doc_id", "word", "n"), weights, "word", total)
    return joined.groupBy("doc_id").agg(
        *[
            (F.sum(F.col("n") * F.col(f"b{k}") / total) / F.sum("n").cast("double")).alias(f"g{k}")
            for k in range(1, topics + 1)
        ]
    )


def tidy(wide: DataFrame, key: str, prefix: str, topics: int, value: str, name: str | None = None) -> DataFrame:
    """Wide topic columns to (key, topic, value)."""
    entries = [F.struct(F.lit(k).alias("topic"), F.col(f"{prefix}{k}").alias(value)) for k in range(1, topics + 1)]
    return wide.select(F.col(key).alias(name or key), F.inline(F.array(*entries)))


def tidy_theta(theta: DataFrame) -> DataFrame:
    """(doc_id, theta array) to (doc_id, topic, gamma)."""
    return theta.select("doc_id", F.posexplode("theta").alias("k", "gamma")).select(
        "doc_id", (F.col("k") + 1).alias("topic"), "gamma"
    )


# --- terms and prevalence ------------------------------------------------------------


def top_terms(beta: DataFrame, n: int = 6) -> DataFrame:
    """(topic, terms): the n likeliest terms, ties kept, joined in order."""
    value = F.round("beta", 12)
    top = top_n_ties(beta, ["topic"], F.desc(value), n)
    ordered = F.array_sort(F.collect_list(F.struct((-value).alias("o"), "term")))
    return top.groupBy("topic").agg(F.concat_ws(", ", F.transform(ordered, lambda s: s["term"])).alias("terms"))


def prevalence(gamma: DataFrame, beta: DataFrame, n_terms: int = 6, top: int = 10) -> DataFrame:
    """Mean share per topic with its terms, the ``top`` most prevalent topics."""
    means = gamma.groupBy("topic").agg(F.avg("gamma").alias("gamma"))
    ranked = means.withColumn("place", F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round("gamma", 10)))))
    named = ranked.filter(F.col("place") <= top).join(top_terms(beta, n_terms), "topic", "left")
    return named.withColumn("topic", F.concat(F.lit("Topic "), F.col("topic").cast("string")))


def posterior_table(gamma: DataFrame, groups: DataFrame, topics: int) -> DataFrame:
    """(group columns, doc_id, X1..XK): one row per document, joined by key."""
    wide = gamma.groupBy("doc_id").pivot("topic", list(range(1, topics + 1))).agg(F.max("gamma"))
    named = wide.withColumnsRenamed({str(k): f"X{k}" for k in range(1, topics + 1)})
    return groups.join(named, "doc_id")


def group_means(gamma: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Mean share per (group, topic) and its logarithm."""
    joined = gamma.join(groups.select("doc_id", key), "doc_id")
    means = joined.groupBy(key, "topic").agg(F.avg("gamma").alias("mean"))
    return means.withColumn("log_mean", F.ln("mean"))


def group_effect(gamma: DataFrame, groups: DataFrame, key: str, base: str, other: str) -> DataFrame:
    """Least-squares effect of ``other`` against ``base`` per topic: a difference in means."""
    joined = gamma.join(groups.select("doc_id", key), "doc_id")
    means = joined.groupBy("topic").agg(
        F.avg(F.when(F.col(key) == base, F.col("gamma"))).alias("base_mean"),
        F.avg(F.when(F.col(key) == other, F.col("gamma"))).alias("other_mean"),
    )
    return means.select("topic", (F.col("other_mean") - F.col("base_mean")).alias("coefficient"))


# --- diagnostics ------------------------------------------------------------------------


def _average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """(topic, value, out): average rank share inside the topic, from bucketed running counts."""
    counted = running_total(df.withColumn("__one", F.lit(1)), value, ["__one"], ["topic"])
    middle = F.col("__one_cum") - (F.col("__one") - 1) / 2.0
    return counted.select("topic", value, (middle / F.col("__one_all")).alias(out))


def _ranked_values(beta: DataFrame) -> DataFrame:
    """Stored ``beta`` with the rounded exclusivity and frequency that ranks go by."""
    shared = attach(beta, ["term"], F.sum("beta").alias("__all"))
    scored = shared.withColumns({"__ex": F.round(F.col("beta") / F.col("__all"), 12), "__fr": F.round("beta", 15)}).drop("__all")
    return materialize(scored, "frex")


def _with_frex(rows: DataFrame, stored: DataFrame, weight: float) -> DataFrame:
    """Adds ``frex`` to some rows of a stored table; ranks are over the whole of it."""
    ranked = rows.join(_average_ranks(stored, "__ex", "__rx"), ["topic", "__ex"]).join(_average_ranks(stored, "__fr", "__rf"), ["topic", "__fr"])
    score = 1.0 / (weight / F.col("__rx") + (1.0 - weight) / F.col("__rf"))
    return ranked.withColumn("frex", score).drop("__ex", "__fr", "__rx", "__rf")


def frex(beta: DataFrame, weight: float) -> DataFrame:
    """Adds ``frex``: harmonic mean of frequency and exclusivity ranks.

    The scored table (one row per topic and term) is stored, because both
    ranks and the result read it.
    """
    stored = _ranked_values(beta)
    return _with_frex(stored, stored, weight)


def _likeliest(beta: DataFrame, n: int) -> DataFrame:
    """The n likeliest terms per topic with their place, equal weights by term."""
    w = Window.partitionBy("topic").orderBy(F.desc(F.round("beta", 12)), "term")
    return beta.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def exclusivity(beta: DataFrame, n: int = 10, weight: float = 0.7) -> DataFrame:
    """Sum of frex over the n likeliest terms of each topic.

    Only those terms' rows meet the ranks, so a value that most words of a topic share is no hot key.
    """
    stored = _ranked_values(beta)
    top = _likeliest(stored, n).drop("place")
    return _with_frex(top, stored, weight).groupBy("topic").agg(F.sum("frex").alias("exclusivity"))


def coherence(beta: DataFrame, counts: DataFrame, n: int = 10) -> DataFrame:
    """Semantic coherence: sum over term pairs of ln((D(i, j) + 1) / D(j)).

    Each document is reduced to a bit pattern of the top terms it contains;
    patterns are counted, so pairs are formed from at most 2^n patterns per
    topic, not from documents. ``n`` is at most 62, the places of a pattern.
    """
    if n > 62:
        raise ValueError("coherence takes 62 terms of a topic at most")
    top = _likeliest(beta, n).select("topic", F.col("term").alias("word"), "place")
    present = counts.select("doc_id", "word").join(F.broadcast(top), "word")  # n rows a topic
    masks = present.groupBy("topic", "doc_id").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place") - 1)).alias("mask"))
    patterns = masks.groupBy("topic", "mask").agg(F.count("*").alias("docs"))

    places = F.filter(F.sequence(F.lit(1), F.lit(n)), lambda i: F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), i - 1)) != 0)
    held = patterns.select("topic", "docs", places.alias("places"))
    alone = held.select("topic", "docs", F.explode("places").alias("j")).groupBy("topic", "j").agg(F.sum("docs").alias("d"))
    both = held.select("topic", "docs", "places", F.explode("places").alias("j")).select(
        "topic", "docs", "j", F.explode(F.filter("places", lambda i: i > F.col("j"))).alias("i"))
    together = both.groupBy("topic", "i", "j").agg(F.sum("docs").alias("dd"))
    wanted = alone.where(F.col("j") < n).select("topic", "j", "d", F.explode(F.sequence(F.col("j") + 1, F.lit(n))).alias("i"))
    score = F.ln((F.coalesce("dd", F.lit(0)) + 1) / F.col("d"))
    return wanted.join(together, ["topic", "i", "j"], "left").groupBy("topic").agg(F.sum(score).alias("semantic_coherence"))


def fitted_cells(counts: DataFrame, weights: DataFrame, shares: DataFrame, topics: int) -> DataFrame:
    """Counts with ``q``, the model's probability of the word in the document.

    ``weights`` is (word, b1..bK), ``shares`` is (doc_id, g1..gK).
    """
    used = reduce(lambda a, b: a + b, [F.col(f"b{k}") for k in range(1, topics + 1)])
    # Shares first: a cell is narrow when it moves to its document's, and meets the weights of most words where it is.
    joined = join_hot(counts.select("doc_id", "word", "n").join(shares, "doc_id"), weights, "word", used)
    q = reduce(lambda a, b: a + b, [F.col(f"g{k}") * F.col(f"b{k}") for k in range(1, topics + 1)])
    return joined.select("doc_id", "word", "n", q.alias("q"))


def is_held_out(seed: int, doc_share: float = 0.1, word_share: float = 0.5) -> Column:
    """Whether a cell is held out: hashed documents, then hashed words inside them."""

    def unit(*parts: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
        return F.conv(F.substring(digest, 1, 7), 16, 10).cast("double") / float(16 ** 7)

    doc = F.col("doc_id").cast("string")
    return (unit(doc) < doc_share) & (unit(doc, F.col("word")) < word_share)


def held_out_likelihood(fitted: DataFrame, seed: int, doc_share: float = 0.1, word_share: float = 0.5) -> DataFrame:
    """Mean over documents of the mean log probability of their held-out tokens."""
    held = fitted.filter(is_held_out(seed, doc_share, word_share))
    per_doc = held.groupBy("doc_id").agg((F.sum(F.col("n") * F.ln("q")) / F.sum("n")).alias("score"))
    return per_doc.agg(F.count("*").alias("docs"), F.avg("score").alias("expected_heldout"))


def residual_dispersion(fitted: DataFrame, topics: int) -> DataFrame:
    """Standardized squared residuals of the observed cells over their degrees of freedom."""
    sized = attach(fitted, ["doc_id"], F.sum("n").cast("double").alias("m"))
    expected = F.col("m") * F.col("q")
    square = (F.col("n") - expected) * (F.col("n") - expected) / (expected * (1.0 - F.col("q")))
    sums = sized.agg(F.sum(square).alias("ss"), F.count("*").alias("cells"), F.count_distinct("doc_id").alias("docs"))
    freedom = F.col("cells") - F.col("docs") * (topics - 1)
    return sums.select("cells", (F.col("ss") / freedom).alias("dispersion"))


def bound_summary(trace: DataFrame) -> DataFrame:
    """Per K: best bound, ln K!, their sum and the number of iterations."""
    best = trace.groupBy("K").agg(F.max("bound").alias("bound"), F.count("*").alias("iterations"))
    lfact = best.withColumn("lfact", log_factorial(F.col("K")))
    return lfact.withColumn("lbound", F.col("bound") + F.col("lfact"))


def diagnostics_long(metrics: DataFrame) -> DataFrame:
    """One row of metrics per K to (K, Metric, Value)."""
    named = metrics.select(
        "K",
        F.col("lbound").alias("Lower bound"),
        F.col("dispersion").alias("Residuals"),
        F.col("semantic_coherence").alias("Semantic coherence"),
        F.col("expected_heldout").alias("Held-out likelihood"),
    )
    return named.unpivot("K", [c for c in named.columns if c != "K"], "Metric", "Value")


# --- labels and tree -----------------------------------------------------------------------


def labels(beta: DataFrame, word_share: DataFrame, n: int = 7, weight: float = 0.5) -> DataFrame:
    """(topic, kind, terms): n words by probability, frex, lift and score.

    ``word_share`` is (word, p), the corpus share of each word.
    """
    scored = frex(beta, weight).join(word_share.select(F.col("word").alias("term"), "p"), "term")
    logged = attach(scored.withColumn("__ln", F.ln("beta")), ["term"], F.avg("__ln").alias("__mean_ln"))
    kinds = {
        "prob": F.col("beta"),
        "frex": F.col("frex"),
        "lift": F.col("beta") / F.col("p"),
        "score": F.col("beta") * (F.col("__ln") - F.col("__mean_ln")),
    }
    entries = [F.struct(F.lit(k).alias("kind"), F.round(v, 10).alias("value")) for k, v in kinds.items()]
    long = logged.select("topic", "term", F.inline(F.array(*entries)))
    w = Window.partitionBy("topic", "kind").orderBy(F.desc("value"), "term")
    top = long.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
    ordered = F.array_sort(F.collect_list(F.struct("place", "term")))
    return top.groupBy("topic", "kind").agg(F.concat_ws(", ", F.transform(ordered, lambda s: s["term"])).alias("terms"))


def topic_correlations(shares: DataFrame, topics: int) -> DataFrame:
    """(a, b, r), a < b: correlation of topic shares over documents, in one pass.

    Only the K x K matrix reaches the driver.
    """
    vectors = VectorAssembler(inputCols=[f"g{k}" for k in range(1, topics + 1)], outputCol="v").transform(shares)
    matrix = Correlation.corr(vectors, "v").first()[0].toArray()
    rows = [(a + 1, b + 1, float(matrix[a, b])) for a in range(topics) for b in range(a + 1, topics)]
    return shares.sparkSession.createDataFrame(rows, "a INT, b INT, r DOUBLE")


def topic_tree(correlation: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """(cut, topic, node): single-link clusters of topics at each correlation level.

    A node is named by its smallest topic. The input has K (K - 1) / 2 rows, so
    each cut level is one small group.
    """
    levels = correlation.withColumn("cut", F.explode(F.array(*[F.lit(float(c)) for c in cuts])))

    def components(frame: pd.DataFrame) -> pd.DataFrame:
        node = {int(t): int(t) for t in pd.concat([frame["a"], frame["b"]]).unique()}
        cut = float(frame["cut"].iloc[0])
        for row in frame[frame["r"] >= cut].itertuples():
            low, high = sorted((node[int(row.a)], node[int(row.b)]))
            if low != high:
                node = {t: low if n == high else n for t, n in node.items()}
        return pd.DataFrame({"cut": cut, "topic": list(node), "node": list(node.values())})

    return levels.groupBy("cut").applyInPandas(components, "cut DOUBLE, topic INT, node INT")


def chain_merges(distance: np.ndarray, linkage: str = "average") -> list[tuple[int, int, float]]:
    """The K - 1 merges (low, high, height) of a symmetric distance matrix, lowest first; a cluster is named by its smallest member.

    A chain of nearest neighbours is followed until two clusters are nearest to each other; these are merged, and the distances of
    the new cluster follow from those of its parts. Such merges are those of the full search for all three linkages, in another order.
    """
    d = np.array(distance, dtype=float)
    np.fill_diagonal(d, np.inf)
    size, formed, open_, chain, found = np.ones(len(d)), np.full(len(d), -np.inf), np.ones(len(d), dtype=bool), [], []
    while open_.sum() > 1:
        if not chain:
            chain.append(int(np.flatnonzero(open_)[0]))
        here = chain[-1]
        near = int(d[here].argmin())
        if len(chain) > 1 and d[here, chain[-2]] <= d[here, near]:
            near = chain[-2]
        if len(chain) < 2 or near != chain[-2]:
            chain.append(near)
            continue
        del chain[-2:]
        a, b = min(here, near), max(here, near)
        # Rounding must not put a merge below those of its parts.
        formed[a] = max(d[a, b], formed[a], formed[b])
        found.append((a, b, float(formed[a])))
        joined = {
            "single": np.minimum(d[a], d[b]), "complete": np.maximum(d[a], d[b]), "average": (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b]),
        }[linkage]
        d[a], d[:, a], d[b], d[:, b] = joined, joined, np.inf, np.inf
        d[a, a], size[a], open_[b] = np.inf, size[a] + size[b], False
    return sorted(found, key=lambda m: m[2])


def topic_merges(correlation: DataFrame, topics: int, linkage: str = "average") -> DataFrame:
    """(merge, height, low, high, topic): the agglomerative tree of topics at distance 1 - r, one row for each topic of a merge.

    ``low`` and ``high`` name the two merged nodes by their smallest topics; merges count from 1, lowest first. The input has
    K (K - 1) / 2 rows for K topics, as ``topic_correlations`` gives them; a null correlation (a constant topic) counts as 0.
    """
    distance = np.ones((topics, topics))
    for r in correlation.collect():
        distance[r.a - 1, r.b - 1] = distance[r.b - 1, r.a - 1] = 1.0 if r.r is None or np.isnan(r.r) else 1 - r.r
    members, rows = {t: [t] for t in range(topics)}, []
    for merge, (low, high, height) in enumerate(chain_merges(distance, linkage), 1):
        members[low] = sorted(members[low] + members.pop(high))
        rows += [(merge, height, low + 1, high + 1, t + 1) for t in members[low]]
    return correlation.sparkSession.createDataFrame(rows, "merge INT, height DOUBLE, low INT, high INT, topic INT")


def merge_nodes(merges: DataFrame, beta: DataFrame, gamma: DataFrame, n: int = 7) -> DataFrame:
    """(merge, height, low, high, n_topics, proportion, terms): the merges with the share and the words of each new node."""
    labelled = tree_nodes(merges.select(F.col("merge").cast("double").alias("cut"), "topic", F.col("low").alias("node")), beta, gamma, n)
    named = labelled.select(F.col("cut").cast("int").alias("merge"), "n_topics", "proportion", "terms")
    return merges.select("merge", "height", "low", "high").distinct().join(named, "merge").select("merge", "height", "low", "high", "n_topics", "proportion", "terms")


def tree_nodes(nodes: DataFrame, beta: DataFrame, gamma: DataFrame, n: int = 7) -> DataFrame:
    """Per tree node its topics, corpus share and n likeliest words over its topics.

    A node often survives several cuts; its words are found once per distinct
    set of topics (at most 2 K - 1 of them).
    """
    share = gamma.groupBy("topic").agg(F.avg("gamma").alias("p"))
    members = nodes.join(share, "topic").groupBy("cut", "node").agg(
        F.array_sort(F.collect_list(F.struct("topic", "p"))).alias("parts")
    )
    keyed = members.withColumn("members", F.concat_ws(",", F.transform("parts", lambda t: t["topic"].cast("string"))))
    keyed = materialize(keyed, "tree-nodes")
    distinct = keyed.groupBy("members").agg(F.first("parts").alias("parts")).select("members", F.inline("parts"))
    mixed = beta.join(distinct, "topic").groupBy("members", "term").agg(F.round(F.sum(F.col("beta") * F.col("p")), 10).alias("v"))
    w = Window.partitionBy("members").orderBy(F.desc("v"), "term")
    top = mixed.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
    ordered = F.array_sort(F.collect_list(F.struct("place", "term")))
    terms = top.groupBy("members").agg(F.concat_ws(", ", F.transform(ordered, lambda s: s["term"])).alias("terms"))
    total = F.aggregate("parts", F.lit(0.0), lambda acc, t: acc + t["p"])
    sized = keyed.select("cut", "node", "members", F.size("parts").cast("long").alias("n_topics"), F.round(total, 8).alias("proportion"))
    return sized.join(terms, "members").drop("members")
