"""Benchmark decontamination with one FM-index per shard of training text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import texts as X
from corpusloom.llm.fm_index import FMIndex

#: Text bytes of one shard; bounds the memory of a task.
SHARD_BYTES = 8 << 20
#: Benchmark bytes searched at a time, and the most that may be searched at all (it travels with the tasks).
BLOCK_BYTES, BENCHMARK_BYTES = 4 << 20, 256 << 20
#: Occurrences located at a time.
LOCATE_ROWS = 1 << 20

HITS = "array<struct<start:int,end:int>>"


@dataclass
class Phrases:
    """Windows of a block of benchmark items, as word numbers of the block's own vocabulary."""

    vocabulary: np.ndarray  # sorted word hashes; number = place + 1
    maybe: np.ndarray  # whether any word hash has these leading 20 bits
    words: np.ndarray
    end: np.ndarray
    length: np.ndarray
    item: np.ndarray
    items: list[str]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), dtype=np.int64)
        if not len(self.vocabulary):
            return out
        some = np.flatnonzero(self.maybe[hashes >> np.uint64(44)])
        place = np.searchsorted(self.vocabulary, hashes[some])
        place[place == len(self.vocabulary)] = 0
        out[some] = np.where(self.vocabulary[place] == hashes[some], place + 1, 0)
        return out


def word_table(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: word starts and ends in the joined buffer, word hashes, first word of each text (one more at the end).

    Also the texts' own starts are needed to come back to byte offsets; they are ``joined``'s second value.
    """
    data, begin = X.joined(texts)
    data = data.translate(X.LOWER_BYTES)
    start, end = X.spans(np.frombuffer(data, dtype=np.uint8), X.WORD_BYTES)
    return start, end, X.hash_spans(data, start, end - start), np.searchsorted(start, begin)


def phrases(items: list[tuple[str, bytes]], window: int) -> Phrases:
    start, _, hashes, first = word_table([t for _, t in items])
    vocabulary = np.unique(hashes)
    maybe = np.zeros(1 << 20, dtype=bool)
    maybe[vocabulary >> np.uint64(44)] = True
    sizes = np.diff(first)
    length = np.minimum(sizes, window)
    count = np.where(sizes > 0, sizes - length + 1, 0)
    item = np.repeat(np.arange(len(items)), count)
    nth = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    words = np.searchsorted(vocabulary, hashes) + 1
    return Phrases(vocabulary, maybe, words, first[:-1][item] + nth + length[item], length[item], item, [i for i, _ in items])


def known_runs(number: np.ndarray, first: np.ndarray, shortest: int) -> np.ndarray:
    """Words standing in runs of known words, inside one text, that can hold the shortest phrase."""
    known = np.flatnonzero(number > 0)
    if not known.size:
        return known
    text = np.searchsorted(first, known, side="right")
    new = np.concatenate([[True], (np.diff(known) != 1) | (np.diff(text) != 0)])
    run = np.cumsum(new) - 1
    return known[np.bincount(run)[run] >= shortest]


def find(number: np.ndarray, first: np.ndarray, block: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of the block's phrases: (first word, phrase) of each."""
    nothing = np.zeros(0, dtype=np.int64)
    if not len(block.length):
        return nothing, nothing
    kept = known_runs(number, first, int(block.length.min()))
    if not kept.size:
        return nothing, nothing
    text = np.searchsorted(first, kept, side="right")
    gap = np.concatenate([(np.diff(kept) != 1) | (np.diff(text) != 0), [True]])
    place = np.arange(len(kept)) + np.cumsum(gap) - gap
    sequence = np.zeros(len(kept) + int(gap.sum()), dtype=np.int64)
    sequence[place] = number[kept]
    word = np.zeros(len(sequence), dtype=np.int64)
    word[place] = kept
    index = FMIndex(sequence, len(block.vocabulary))
    low, high = index.search(block.words, block.end, block.length)
    count = np.maximum(high - low, 0)
    found, which, upto = [nothing], [nothing], np.cumsum(count)
    begin = 0
    while begin < len(count):
        stop = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + LOCATE_ROWS, side="right")))
        c = count[begin:stop]
        phrase = np.repeat(np.arange(begin, stop), c)
        rows = np.arange(len(phrase)) - np.repeat(np.cumsum(c) - c, c) + low[phrase]
        found.append(word[index.locate(rows)])
        which.append(phrase)
        begin = stop
    return np.concatenate(found), np.concatenate(which)


def shard_hits(texts: list[bytes], block: Phrases) -> tuple[np.ndarray, list[list[tuple[int, int]]], np.ndarray, list[list[str]]]:
    """Per text: words, merged byte spans of hit words, hit words, sorted item ids, each once."""
    start, end, hashes, first = word_table(texts)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    at, phrase = find(block.numbers(hashes), first, block)
    edge = np.zeros(len(start) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + block.length[phrase], -1)
    hit = np.cumsum(edge)[:-1] > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    places: list[list[tuple[int, int]]] = [[] for _ in texts]
    on = np.flatnonzero(hit)
    if on.size:
        text = np.searchsorted(first, on, side="right") - 1
        new = np.concatenate([[True], (np.diff(on) != 1) | (np.diff(text) != 0)])
        heads, tails = on[new], on[np.concatenate([new[1:], [True]])]
        for t, a, b in zip(text[new].tolist(), start[heads].tolist(), end[tails].tolist()):
            places[t].append((a - int(begin[t]), b - int(begin[t])))
    items: list[list[str]] = [[] for _ in texts]
    if at.size:
        pair = np.unique((np.searchsorted(first, at, side="right") - 1) * len(block.items) + block.item[phrase])
        for p in pair.tolist():
            items[p // len(block.items)].append(block.items[p % len(block.items)])
    return np.diff(first), places, total[first[1:]] - total[first[:-1]], [sorted(set(i)) for i in items]


def _benchmark_blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[str, bytes]]]:
    sized = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).cast("binary").alias("text")).where("text IS NOT NULL")
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > BENCHMARK_BYTES:
        raise ValueError(f"the benchmark holds {total} bytes of text; at most {BENCHMARK_BYTES} are searched in one call")
    block, size = [], 0
    for row in sized.toLocalIterator():
        block.append((row.item, bytes(row.text)))
        size += len(row.text)
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item: str = "item_id", prefix: str = "") -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (merged byte spans), ``n_hit`` and ``hit_items`` added.

    Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. Every window of ``window`` consecutive
    words of an item is a phrase; an item with fewer words is one phrase. Each task cuts its rows into shards of bounded size,
    builds an FM-index over the shard's word numbers (words outside the benchmark's vocabulary separate), searches every phrase
    backward and marks all located occurrences. Nothing is shuffled; a lost task is simply run again. The benchmark is searched
    in blocks of bounded size and refused beyond ``BENCHMARK_BYTES``.

    A null or empty text has no words and no hits; a null item text has no phrase; repeated rows are kept; a null item id counts
    as the empty string; rows with one item id count as one item; columns of ``docs`` named like the added ones (``prefix`` is put before these) are replaced.
    """
    added = {f"{prefix}n_words": "bigint", f"{prefix}n_hit": "bigint", f"{prefix}hit_spans": HITS, f"{prefix}hit_items": "array<string>"}
    out = docs.drop(*added)
    blocks = [phrases(b, window) for b in _benchmark_blocks(benchmark, item, text)] or [phrases([], window)]
    schema = T.StructType(out.schema.fields + T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in added.items())).fields)
    arrow = list(zip(added, (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string()))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in X.pieces(batches, text, SHARD_BYTES):
            rows = X.raw_texts(shard, text)
            words, places, hits, items = shard_hits(rows, blocks[0])
            for block in blocks[1:]:
                _, p, _, i = shard_hits(rows, block)
                places = [merge_spans(a + b) for a, b in zip(places, p)]
                items = [sorted({*a, *b}) for a, b in zip(items, i)]
                hits = np.array([words_inside(t, s) for t, s in zip(rows, places)], dtype=np.int64)
            columns = [words, hits, [[{"start": a, "end": b} for a, b in p] for p in places], items]
            yield pa.RecordBatch.from_arrays(
                [*shard.columns, *(pa.array(c, type=t) for c, (_, t) in zip(columns, arrow))], names=[*shard.schema.names, *(n for n, _ in arrow)])

    return out.mapInArrow(search, schema)


def merge_spans(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans; touching ones stay apart only if a gap is between them."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(places):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def words_inside(text: bytes, places: list[tuple[int, int]]) -> int:
    return sum(len(word_table([text[a:b]])[0]) for a, b in places)


def remove_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """``docs`` with every hit span cut out of the text, a line feed in its place; documents that were nothing else go.

    Columns are those of ``docs`` with ``n_cut`` (words cut) added. A clean document, null text included, is returned as it is.
    """
    own = "__overlap_"  # keeps columns of ``docs`` with the plain names
    found = find_overlaps(docs, benchmark, window, text, prefix=own)
    schema = T.StructType(docs.drop("n_cut").schema.fields + [T.StructField("n_cut", T.LongType())])
    names = schema.names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.pieces(batches, text, SHARD_BYTES):
            hits = batch.column(f"{own}n_hit").to_numpy()
            kept = [x for x in batch.column(text).cast(pa.binary()).to_pylist()]
            for row in np.flatnonzero(hits).tolist():
                value, parts, last = kept[row], [], 0
                for place in batch.column(f"{own}hit_spans")[row].as_py():
                    parts.append(value[last : place["start"]])
                    last = place["end"]
                kept[row] = b"\n".join([*parts, value[last:]])
            stays = hits < batch.column(f"{own}n_words").to_numpy()
            stays |= hits == 0
            columns = {n: batch.column(n) for n in names if n not in (text, "n_cut")}
            columns |= {text: pa.array(kept, type=pa.binary()).cast(batch.column(text).type), "n_cut": pa.array(hits)}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names).filter(pa.array(stays))

    return found.mapInArrow(cut, schema)
