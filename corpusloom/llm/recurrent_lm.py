"""Language-model scoring of whole documents: corpus counts for every word, a gated recurrent model for their order."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import gru
from corpusloom.llm import texts as X
from corpusloom.session import materialize, scratch_path

SHARD_BYTES = 4 << 20
#: Size of the model: words with weights of their own, their classes, classes of the other words, units of the state.
WORDS, CLASSES, RARE, HIDDEN = 2_048, 32, 64, 24
#: Counts that travel with the tasks, at most; counts of rarer words are joined.
TABLE = 1 << 20
#: Passes over disjoint parts of the training documents, weights averaged after each; tokens of a group of documents of like length.
ROUNDS, GROUP_TOKENS = 4, 2 << 20
#: Numbers of a row of weights.
SLOT = 1 << 13

_INSIDE = ~X.byte_class((0x20, 0x20), (0x09, 0x0D))


@dataclass
class Words:
    """Words of a batch: distinct ones by hash, with their bytes' place, and which one each token is."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray  # of the distinct words
    rare: np.ndarray
    count: np.ndarray
    token: np.ndarray
    owner: np.ndarray

    def spelled(self, which: np.ndarray) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.start[which].tolist(), self.end[which].tolist())]


def split(texts: list[bytes]) -> Words:
    data, begin = X.joined(texts)
    data = data.translate(X.LOWER_BYTES)
    raw = np.frombuffer(data, dtype=np.uint8)
    start, end = X.spans(raw, _INSIDE)
    owner = np.searchsorted(begin, start, side="right") - 1
    code, found = pd.factorize(X.hash_spans(data, start, end - start))  # in order of first places; only distinct words are sorted
    order = np.argsort(found)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    hashes, token = found[order], place[code]
    first, count = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1))[order], np.bincount(token, minlength=len(order))
    start, end = start[first], end[first]
    return Words(data, start, end, hashes, rare_class(raw, start, end), count, token, owner)


def rare_class(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Class of a word outside the model, by its last two bytes: endings tell languages and kinds of words apart."""
    last, before = raw[end - 1].astype(np.int64), np.where(end - start > 1, raw[np.maximum(end - 2, 0)], 0).astype(np.int64)
    return (last * 37 + before * 101) % RARE


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard in X.pieces(batches, "text", SHARD_BYTES):
        w = split(X.raw_texts(shard, "text"))
        spelled = [b"", *w.spelled(np.arange(len(w.hashes)))]  # the end of a text counts as a word without letters
        yield pa.RecordBatch.from_arrays([pa.array(spelled, pa.binary()), pa.array(np.concatenate([[shard.num_rows], w.count]))], names=["word", "c"])


def _with_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spelled = batch.column("word").to_pylist()
        data, begin = X.joined(spelled)
        start, size = begin[:-1], np.diff(begin) - 1
        kind = rare_class(np.frombuffer(data, dtype=np.uint8), start, np.maximum(start + size, 1))
        kind[size == 0] = -1
        yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(X.hash_spans(data, start, size).view(np.int64)), pa.array(kind, pa.int32())], names=["word", "c", "h", "k"])


@dataclass
class Counts:
    """What scoring takes from the corpus: all training words with their counts (``words``), and for the frequent ones a table by hash."""

    words: DataFrame  # word, c, h, k
    total: int
    distinct: int
    ends: int
    hashes: np.ndarray  # sorted, of the frequent words
    counts: np.ndarray
    ids: np.ndarray  # number in the model, -1 outside
    divisors: np.ndarray  # of each rare class
    layout: gru.Layout
    by_id: np.ndarray  # tokens of each id

    @property
    def divisor(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)


def count_words(docs: DataFrame) -> Counts:
    """Counts of the words of all ``docs`` (training documents). Only the frequent words' hashes and counts, ``TABLE`` at most, reach the driver."""
    summed = docs.select("text").mapInArrow(_count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    words = materialize(summed.mapInArrow(_with_hashes, "word binary, c long, h long, k int"), "word-counts")
    step = F.floor(F.log2("c") * 8).cast("int")
    levels = words.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.sum("c").alias("c")).orderBy(F.desc("step")).collect()
    least, held = (levels[0]["step"] + 1) if levels else 0, 0
    for row in levels:
        if held + row["words"] > TABLE:
            break
        least, held = row["step"], held + row["words"]
    table = words.where((step >= least) & (F.col("k") >= 0)).select("h", "c", "k").toArrow()
    h, c, k = (table.column(n).to_numpy() for n in ("h", "c", "k"))
    ends = words.where("k < 0").agg(F.sum("c")).first()[0] or 0
    classes = words.where("k >= 0").groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    order = np.argsort(h.view(np.uint64), kind="stable")
    h, c, k = h[order], c[order], k[order]
    first = np.lexsort((h, -c))[: WORDS - 1]
    ids = np.full(len(h), -1, dtype=np.int64)
    ids[first] = 1 + np.arange(len(first))
    masses = np.cumsum(c[first]) / max(1, c[first].sum())
    inner = np.unique(np.searchsorted(masses, np.arange(1, CLASSES) / CLASSES) + 2)
    starts = np.concatenate([[0, 1], inner[inner < len(first) + 1], [len(first) + 1]]) if len(first) else np.array([0, 1])
    tokens, kinds = np.zeros(RARE), np.zeros(RARE)
    for row in classes:
        tokens[row["k"]], kinds[row["k"]] = row["c"], row["v"]
    np.subtract.at(tokens, k[first], c[first])
    np.subtract.at(kinds, k[first], 1)
    layout = gru.Layout(np.unique(starts), RARE, HIDDEN)
    return Counts(words, sum(r["c"] for r in levels), sum(r["words"] for r in levels), ends, h.view(np.uint64), c, ids, tokens + 0.5 * (kinds + 1), layout, np.concatenate([[ends], c[first], tokens]))


_ENCODED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, rare double, tail array<struct<word:binary,n:int,k:int>>, ids binary"


def _encode(known: dict):
    """Task function: ids of each text, and the part of its scores that the frequent words' counts give; other words are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, row = known["value"].value, TaskContext.get().partitionId() << 40
        for shard in X.pieces(batches, "text", SHARD_BYTES):
            w, n = split(X.raw_texts(shard, "text")), shard.num_rows
            at = np.minimum(np.searchsorted(t["hashes"], w.hashes), max(0, len(t["hashes"]) - 1))
            found = t["hashes"][at] == w.hashes if len(t["hashes"]) else np.zeros(len(w.hashes), dtype=bool)
            count, ids = np.zeros(len(w.hashes)), np.full(len(w.hashes), -1, dtype=np.int64)
            count[found], ids[found] = t["counts"][at[found]], t["ids"][at[found]]
            base = np.where(found, np.log10((count + 0.5) / t["divisor"]), 0.0)
            rare = np.where(found & (ids < 0), np.log10((count + 0.5) / t["divisors"][w.rare]), 0.0)
            code = np.where(ids < 0, t["words"] + w.rare, ids)
            sums = [np.bincount(w.owner, weights=x[w.token], minlength=n).astype(np.float64) for x in (base, rare, found)]
            size = np.bincount(w.owner, minlength=n) + 1
            coded, ends = np.zeros(int(size.sum()), dtype="<u2"), np.cumsum(size)
            coded[np.arange(len(w.token)) + w.owner] = code[w.token]
            listed = np.flatnonzero(~found)
            place = np.full(len(found), -1)
            place[listed] = np.arange(len(listed))
            unknown = ~found[w.token]
            pairs, times = np.unique(w.owner[unknown] * max(1, len(listed)) + place[w.token[unknown]], return_counts=True)
            owner, which = pairs // max(1, len(listed)), pairs % max(1, len(listed))
            cells = pa.StructArray.from_arrays([pa.array(w.spelled(listed), pa.binary()).take(pa.array(which)), pa.array(times, pa.int32()), pa.array(w.rare[listed][which] if len(listed) else [], pa.int32())], names=["word", "n", "k"])
            tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), cells)
            offsets = np.concatenate([[0], ends * 2]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(coded.tobytes())])
            end = math.log10((t["ends"] + 0.5) / t["divisor"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(n)), shard.column("doc_id"), shard.column("held_out"), pa.array(size), pa.array(sums[2].astype(np.int64) + (t["ends"] > 0)),
                    pa.array(sums[0] + end), pa.array(sums[1]), tail, packed,
                ],
                names=[c.split(" ")[0] for c in _ENCODED.replace("struct<word:binary,n:int,k:int>", "").split(", ")],
            )
            row += n

    return run


def _ids(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<u2").astype(np.int64) for x in batch.column("ids").to_pylist()]


def _learn(layout: gru.Layout, weights: gru.Weights):
    """Task function: weights after the task's documents, in slots, with the tokens they come from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = {k: v.copy() for k, v in weights.items()}
        adam = gru.Optimizer(mine)
        for batch in batches:
            gru.run(layout, mine, _ids(batch), adam)
        if adam.tokens:
            flat = np.concatenate([mine[k].ravel() for k in sorted(mine)]).astype("<f4")
            slots = [flat[i : i + SLOT].tobytes() for i in range(0, len(flat), SLOT)]
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(slots)), pa.int32()), pa.array([task] * len(slots), pa.int32()), pa.array([adam.tokens] * len(slots), pa.int64()), pa.array(slots, pa.binary())], names=["slot", "task", "tokens", "part"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean of each slot over the tasks, by tokens; a slot at a time is held."""
    sums: dict[int, list] = {}
    for batch in batches:
        for slot, tokens, part in zip(*(batch.column(c).to_pylist() for c in ("slot", "tokens", "part"))):
            held = sums.setdefault(slot, [0, 0.0])
            held[0] += tokens
            held[1] = held[1] + tokens * np.frombuffer(part, dtype="<f4").astype(np.float64)
    for slot, (tokens, total) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([(total / tokens).astype("<f4").tobytes()], pa.binary())], names=["slot", "part"])


def train(dealt: DataFrame, counts: Counts) -> gru.Weights:
    """Weights after ``ROUNDS`` passes, each over another part of the training documents and all of them together over each once.

    Every task goes on from the common weights over its own documents; the tasks' weights are then averaged by tokens.
    """
    weights = counts.layout.begin(counts.by_id)
    width = X.shuffle_width(dealt.sparkSession)
    for r in range(ROUNDS):
        part = dealt.where(~F.col("held_out") & (F.col("round") == r)).select("ids").coalesce(width)
        moved = part.mapInArrow(_learn(counts.layout, weights), "slot int, task int, tokens long, part binary")
        slots = moved.repartition("slot").sortWithinPartitions("slot", "task").mapInArrow(_average, "slot int, part binary").collect()
        if not slots:
            continue
        flat, at = np.concatenate([np.frombuffer(s["part"], dtype="<f4") for s in sorted(slots, key=lambda s: s["slot"])]), 0
        for k in sorted(weights):
            size = weights[k].size
            weights[k] = flat[at : at + size].reshape(weights[k].shape).copy()
            at += size
    return weights


def _score(layout: gru.Layout, weights: gru.Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = gru.run(layout, weights, _ids(batch)) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(logs)], names=["row", "log"])

    return run


def _deal(encoded: DataFrame) -> DataFrame:
    """Documents in groups of like length and about ``GROUP_TOKENS`` tokens, a file each, so that those side by side end together.

    Each group belongs to one round of training, whose files lie together.
    """
    length = F.floor(F.log2("n_tokens")).cast("int")
    totals = encoded.groupBy(length.alias("length")).agg(F.sum("n_tokens").alias("tokens")).orderBy("length").collect()
    group, first = F.lit(0), 0
    for row in totals:
        parts = -(-row["tokens"] // GROUP_TOKENS)
        group = F.when(length == row["length"], first + F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")).otherwise(group)
        first += parts
    dealt = encoded.select("row", "held_out", "n_tokens", "ids", group.alias("group")).repartitionById(max(1, first), F.col("group")).sortWithinPartitions("n_tokens", "row")
    path = scratch_path(encoded.sparkSession, "dealt")
    dealt.select("row", "held_out", "ids", (F.col("group") % ROUNDS).alias("round")).write.partitionBy("round").parquet(path)
    return encoded.sparkSession.read.schema("row long, held_out boolean, ids binary, round int").parquet(path)


def score_documents(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row for each row of ``docs``.

    The model learns from the rows for which ``held_out`` is not true. Tokens are the lower-cased words and one end. ``base_score`` is
    the text's log10 probability by smoothed word counts. ``score`` is that of the recurrent model: class of the next word from the
    state, then the word in its class, by the state too for the ``WORDS`` most frequent words, by smoothed counts in the classes of all
    others; the state runs through the whole document.

    Counts of all training words are summed by Spark. The ``TABLE`` most frequent travel with the tasks; words beyond, each rare, are
    listed by document and joined. A null or empty text is one end; a null held-out mark counts as false; repeated rows are scored each
    and learned from each; other columns do not matter. Without training rows every word has the same chance. An empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    counts = count_words(rows.where(~F.col("held_out")))
    spark = docs.sparkSession
    table = {"hashes": counts.hashes, "counts": counts.counts, "ids": counts.ids, "divisors": counts.divisors, "divisor": counts.divisor, "ends": counts.ends, "words": counts.layout.words}
    known = {"value": spark.sparkContext.broadcast(table)}
    encoded = materialize(rows.mapInArrow(_encode(known), _ENCODED), "encoded")
    dealt = _deal(encoded)
    weights = train(dealt, counts)
    logs = dealt.select("row", "ids").mapInArrow(_score(counts.layout, weights), "row long, log double")
    c = F.coalesce("c", F.lit(0)) + 0.5
    divisors = F.array(*[F.lit(float(d)) for d in counts.divisors])
    cells = encoded.select("row", F.inline("tail")).join(counts.words.select("word", "c"), "word", "left")
    tail = cells.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(c / counts.divisor)).alias("tail_base"), F.sum(F.col("n") * F.log10(c / F.get(divisors, F.col("k")))).alias("tail_rare"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known"),
    )
    zero = F.lit(0.0)
    whole = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "rare").join(logs, "row").join(tail, "row", "left")
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(counts.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", zero)).alias("base_score"), (F.col("log") + F.col("rare") + F.coalesce("tail_rare", zero)).alias("score"),
    )
