"""Toxicity grades by cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import texts as X
from corpusloom.llm.simhash import shingle_hashes
from corpusloom.session import materialize

SHARD_BYTES = 1 << 20
#: The model is fitted on at most this many labelled documents of either class, those with the smallest id hashes.
TOXIC_ROWS, CLEAN_ROWS = 4_000, 8_000
#: Features kept at most; a kept one stands in so many toxic documents and in this part of them, and even one standard error below its
#: estimate its odds are so many times those in clean documents. Rarer ones mostly come from families of copied documents.
FEATURES, LEAST_DOCS, LEAST_PART, LEAST_ODDS = 4_096, 3, 0.01, 8.0
GRADES = 3
PREFIXES = (4, 5, 6)
#: A document is rejected when a grade over 0 is more likely than not.
REJECT = 0.5


@dataclass
class Model:
    """Shared weights, ordered thresholds; grade k or more has probability sigmoid(x.w - threshold[k - 1])."""

    features: np.ndarray  # sorted 64-bit hashes
    weights: np.ndarray  # of the features, then of the buckets
    thresholds: np.ndarray

    def severity(self, score: np.ndarray) -> np.ndarray:
        """Probability of each grade over 0 or more, one column a threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def word_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each word and its prefixes (one column each), the word's text, and the words of each text."""
    data, begin = X.joined(texts)
    data = data.translate(X.LOWER_BYTES)
    start, end = X.spans(np.frombuffer(data, dtype=np.uint8), X.WORD_BYTES)
    first = np.searchsorted(start, begin)
    size = end - start
    columns = [X.hash_spans(data, start, size, 8)] + [X.hash_spans(data, start, np.minimum(size, p), 8 + p) for p in PREFIXES]
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    return np.stack(columns, axis=1), text, np.diff(first)


#: Bucket bounds of how many words of a text carry a kept feature.
COUNTS = np.array([2, 3, 5, 9, 17, 33, 65])


def matched(texts: list[bytes], features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct kept features per text: (text, number), and the share of words that carry one. Buckets of their number count as features."""
    hashes, text, words = word_features(texts)
    place = np.zeros(hashes.shape, dtype=np.int64)
    hit = np.zeros(hashes.shape, dtype=bool)
    if len(features):
        maybe = np.zeros(1 << 20, dtype=bool)
        maybe[features >> np.uint64(44)] = True
        r, c = np.nonzero(maybe[hashes >> np.uint64(44)])
        at = np.minimum(np.searchsorted(features, hashes[r, c]), len(features) - 1)
        good = features[at] == hashes[r, c]
        place[r, c], hit[r, c] = at, good
    carried = np.bincount(text[hit.any(axis=1)], minlength=len(texts))
    share = carried / np.maximum(words, 1)
    r, c = np.nonzero(hit)
    pair = np.unique(text[r] * (len(features) + 1) + place[r, c]) if len(r) else np.zeros(0, dtype=np.int64)
    some = np.flatnonzero(carried)
    bucket = len(features) + np.searchsorted(COUNTS, carried[some], side="right")
    return np.concatenate([pair // (len(features) + 1), some]), np.concatenate([pair % (len(features) + 1), bucket]), share


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either class that hold a feature, summed over a shard."""
    for shard in X.pieces(batches, "text", SHARD_BYTES):
        toxic = shard.column("toxic").to_numpy(zero_copy_only=False) > 0
        hashes, text, _ = word_features(X.raw_texts(shard, "text"))
        pairs = np.unique(np.stack([hashes.ravel(), np.repeat(text, hashes.shape[1]).astype(np.uint64)], axis=1), axis=0)
        feature, at = np.unique(pairs[:, 0], return_inverse=True)
        bad = np.bincount(at, weights=toxic[pairs[:, 1].astype(np.int64)], minlength=len(feature)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(feature.view(np.int64)), pa.array(bad), pa.array(np.bincount(at, minlength=len(feature)).astype(np.int64) - bad)], names=["f", "toxic", "clean"])


_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _least_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three minimum hashes of the five-word shingles of a text."""
    for shard in X.pieces(batches, "text", SHARD_BYTES):
        hashes, sizes = shingle_hashes(X.raw_texts(shard, "text"), 5)
        some, least = np.flatnonzero(sizes), np.zeros((3, len(sizes)), dtype=np.uint64)
        for k, times in enumerate(_SPREAD):
            if some.size:
                least[k, some] = np.minimum.reduceat(hashes * times, (np.cumsum(sizes) - sizes)[some])
        yield pa.RecordBatch.from_arrays([shard.column("_id"), shard.column("toxic"), *(pa.array(x.view(np.int64)) for x in least)], names=["_id", "toxic", "m0", "m1", "m2"])


def one_of_each(rows: DataFrame) -> DataFrame:
    """Sample rows without most near copies, whose words would all look telling: one row for each minimum hash, three times over."""
    kept = rows.mapInArrow(_least_hashes, "_id long, toxic int, m0 long, m1 long, m2 long")
    for m in ("m0", "m1", "m2"):
        kept = kept.groupBy(m, "toxic").agg(F.min(F.struct("_id", "m0", "m1", "m2")).alias("r")).select("toxic", "r.*")
    return rows.join(kept.select("_id").distinct(), "_id", "left_semi").select("text", "toxic")


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """The bounded sample of labelled documents: (text, toxic)."""
    marked = labels.where("toxic IS NOT NULL").select(F.col(doc).alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("_id")
    picked = marked.where("toxic > 0").orderBy(order, "_id").limit(TOXIC_ROWS).union(marked.where("toxic = 0").orderBy(order, "_id").limit(CLEAN_ROWS))
    sample = docs.select(F.col(doc).alias("_id"), F.col(text).alias("text")).join(picked, "_id").select("_id", "text", "toxic")
    return materialize(one_of_each(materialize(sample, "labelled")), "labelled")


def fit_ordinal(row: np.ndarray, feature: np.ndarray, grade: np.ndarray, width: int, grades: int, steps: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative logit model, by Adam on the mean ridge-penalized likelihood."""
    n = len(grade)
    w, base, gaps = np.zeros(width), 1.0, np.zeros(grades - 1)
    moments = np.zeros((2, width + grades))
    for step in range(1, steps + 1):
        theta = base + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        score = np.bincount(row, weights=w[feature], minlength=n)
        above = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -60, 60)))
        padded = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        own = np.maximum(padded[np.arange(n), grade] - padded[np.arange(n), grade + 1], 1e-12)
        slope = np.concatenate([np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))], axis=1)
        upper, lower = slope[np.arange(n), grade] / own, slope[np.arange(n), grade + 1] / own
        d_score = -(upper - lower) / n
        d_theta = np.array([(upper[grade == k].sum() - lower[grade == k - 1].sum()) / n for k in range(1, grades + 1)])
        d_gaps = np.array([d_theta[k:].sum() * np.exp(gaps[k - 1]) for k in range(1, grades)])
        g = np.concatenate([np.bincount(feature, weights=d_score[row], minlength=width) + ridge * w, [d_theta.sum()], d_gaps])
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.99 * moments[1] + 0.01 * g * g
        move = 0.1 * moments[0] / (1 - 0.9**step) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-9)
        w -= move[:width]
        base -= move[width]
        gaps -= move[width + 1 :]
    return w, base + np.concatenate([[0], np.cumsum(np.exp(gaps))])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc: str = "doc_id") -> Model:
    """Fit on the bounded labelled sample.

    The labels know toxic or not; grades 1 to 3 of toxic documents are the thirds of their share of words that carry a toxic
    feature. Features are words and word beginnings, so unseen endings of a known stem count. Those that stand out in the toxic
    sample are kept (counted in Spark), then the sample's few matches come to the driver. Without labels of both classes, or without
    any feature that stands out, nothing is toxic.
    """
    rows = training_rows(docs, labels, text, doc)
    total = {r.toxic > 0: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = total.get(True, 0), total.get(False, 0)
    empty = Model(np.zeros(0, dtype=np.uint64), np.zeros(len(COUNTS) + 1), np.full(GRADES, 60.0))
    if not bad or not good:
        return empty
    counts = rows.mapInArrow(_count_features, "f long, toxic long, clean long").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    held, missed = (F.col("toxic") + 0.5, F.lit(bad) - F.col("toxic") + 0.5), (F.col("clean") + 0.5, F.lit(good) - F.col("clean") + 0.5)
    odds = F.ln(held[0] / held[1]) - F.ln(missed[0] / missed[1])
    error = F.sqrt(sum((1 / c for c in (*held, *missed)), F.lit(0.0)))
    kept = counts.where((F.col("toxic") >= max(LEAST_DOCS, LEAST_PART * bad)) & (odds - error >= float(np.log(LEAST_ODDS)))).orderBy(F.desc("toxic"), "f").limit(FEATURES).select("f").collect()
    if not kept:
        return empty
    features = np.sort(np.array([r.f for r in kept], dtype=np.int64).view(np.uint64))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in X.pieces(batches, "text", SHARD_BYTES):
            row, number, share = matched(X.raw_texts(shard, "text"), features)
            numbers: list[list[int]] = [[] for _ in share]
            for r, f in zip(row.tolist(), number.tolist()):
                numbers[r].append(f)
            yield pa.RecordBatch.from_arrays([shard.column("toxic"), pa.array(share), pa.array(numbers, pa.list_(pa.int32()))], names=["toxic", "share", "features"])

    sample = rows.mapInArrow(match, "toxic int, share double, features array<int>").toArrow()
    share, toxic = sample["share"].to_numpy(), sample["toxic"].to_numpy() > 0
    cuts = np.quantile(share[toxic], [1 / 3, 2 / 3])
    grade = np.where(toxic, 1 + np.searchsorted(cuts, share, side="right"), 0)
    lists = sample["features"].combine_chunks()
    sizes = np.asarray(pa.compute.list_value_length(lists))
    weights, thresholds = fit_ordinal(np.repeat(np.arange(len(grade)), sizes), np.asarray(lists.flatten(), dtype=np.int64), grade, len(features) + len(COUNTS) + 1, GRADES)
    return Model(features, weights, thresholds)


def grade(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``p_toxic`` (grade over 0), ``severity`` (expected grade, 0 to 3) and ``toxic`` (rejected) added.

    Each text is scored whole, nothing is shuffled. A text without features, a null or empty one too, is never rejected, whatever the
    share of toxic labels; repeated rows are kept; columns named like the added ones are replaced; an empty table gives no rows.
    """
    out = docs.drop("p_toxic", "severity", "toxic")
    schema = T.StructType(out.schema.fields + T.StructType.fromDDL("p_toxic double, severity double, toxic boolean").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in X.pieces(batches, text, SHARD_BYTES):
            row, number, _ = matched(X.raw_texts(shard, text), model.features)
            above = model.severity(np.bincount(row, weights=model.weights[number], minlength=shard.num_rows))
            carries = np.bincount(row, minlength=shard.num_rows) > 0
            new = [pa.array(above[:, 0]), pa.array(above.sum(axis=1)), pa.array((above[:, 0] > REJECT) & carries)]
            yield pa.RecordBatch.from_arrays([*shard.columns, *new], names=[*shard.schema.names, "p_toxic", "severity", "toxic"])

    return out.mapInArrow(run, schema)
