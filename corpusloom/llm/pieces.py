"""SentencePiece encoding and decoding; giant documents by a max-plus scan over chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import texts as X
from corpusloom.llm.piece_model import SPACE, WORDS, PieceModel
from corpusloom.session import materialize

SHARD_BYTES = 3 << 20
#: Characters of a chunk; longer documents are encoded chunk by chunk, in tasks of their own.
CHUNK = 1 << 15

ADDED = "n_pieces bigint, n_chunks int, ids binary, decoded string"
_IDS = np.dtype("<u4")
WORD_START = re.compile(f"[^{SPACE}]{SPACE}")


@cache
def load(proto: bytes) -> PieceModel:
    """One model for each Python worker."""
    return PieceModel(proto)


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


# Max-plus matrices of boundary states. A state is (characters that its piece reaches beyond the boundary, the piece).

State = tuple[int, int]
Matrix = dict[State, dict[State, int]]
START: State = (0, -1)


def product(a: Matrix, b: Matrix) -> Matrix:
    """The best weight over all states in between; states that cannot be reached (minus infinity) are left out."""
    out: Matrix = {}
    for entry, row in a.items():
        best: dict[State, int] = {}
        for between, weight in row.items():
            for state, more in b.get(between, {}).items():
                best[state] = max(best.get(state, weight + more), weight + more)
        if best:
            out[entry] = best
    return out


def boundary_states(model: PieceModel, text: str, at: int) -> list[State]:
    """All pieces that stand across or end at ``at``."""
    return [(e - at, t) for e in range(at, min(len(text), at + model.longest - 1) + 1) for s, t in model.ending(text, e, 0) if s < at]


def _word_starts(text: str, begin: int, end: int) -> list[int]:
    """Places in [begin, end] where no piece can stand across: a space behind another character."""
    return [m.end() - 1 for m in WORD_START.finditer(text, max(begin - 1, 0), min(end + 1, len(text))) if m.end() - 1 >= begin]


class Chunk:
    """Characters [begin, end) of a normalized text with up to ``longest`` characters around them."""

    def __init__(self, model: PieceModel, text: str, begin: int, end: int, first: bool, last: bool):
        self.model, self.text, self.begin, self.end, self.first, self.last = model, text, begin, end, first, last
        starts = _word_starts(text, begin, end)
        self.head = starts[0] if starts else None
        self.tail = starts[-1] if starts else None
        self._inner: np.ndarray | None = None

    def entries(self) -> list[State]:
        """At a word start nothing stands across, and the piece before does not matter."""
        return [START] if self.first or self.head == self.begin else boundary_states(self.model, self.text, self.begin)

    def exits(self, last: dict[int, int], lowest: int) -> dict[State, int]:
        """States at the end that the path standing at the places of ``last`` can go to, and the piece's start."""
        if self.tail == self.end:
            return {START: self.end}
        reach = self.end + 1 if self.last else min(len(self.text), self.end + self.model.longest - 1) + 1
        return {
            (e - self.end, t): s for e in range(self.end, reach) for s, t in self.model.ending(self.text, e, lowest)
            if s < self.end and s in last and (last[s] < 0 or self.model.pair(last[s], t))
        }

    def _weight(self, path: list[tuple[int, int]]) -> int:
        return -len(self.model.ids_of(self.text, path))

    def middle(self) -> list[str]:
        return WORDS.findall(self.text[self.head : self.tail]) if self.head is not None else []

    def inner(self) -> np.ndarray:
        """Ids between the first and the last word start, where nothing depends on the entry."""
        if self._inner is None:
            fill(self.model, [self])
        return self._inner

    def matrix(self) -> Matrix:
        """Weight (minus the ids) of the path from each entry state to each exit state.

        Behind a word start nothing depends on the entry any more, so the matrix is then a column times a row.
        """
        out: Matrix = {}
        if self.head is None:
            for entry in self.entries():
                begin = self.begin + entry[0]
                if begin >= self.end:  # a short last chunk, with nothing behind the entry's piece
                    if begin == self.end or not self.last:
                        out[entry] = {(begin - self.end, entry[1]): 0}
                    continue
                last = self.model.forward(self.text, begin, entry[1], self.end - 1)
                row = {x: self._weight([*self.model.trace(last, begin, s), (self.end + x[0], x[1])]) for x, s in self.exits(last, begin).items()}
                if row:
                    out[entry] = row
            return out
        inner = -len(self.inner())
        last = self.model.forward(self.text, self.tail, -1, max(self.tail, self.end - 1))
        row = {x: inner + (self._weight([*self.model.trace(last, self.tail, s), (self.end + x[0], x[1])]) if x != START else 0) for x, s in self.exits(last, self.tail).items()}
        for entry in self.entries():
            begin = self.begin + entry[0]
            if begin > self.head:
                continue
            head = self.model.forward(self.text, begin, entry[1], self.head)
            if self.head in head:
                weight = self._weight(self.model.trace(head, begin, self.head))
                out[entry] = {x: weight + w for x, w in row.items()}
        return out

    def back(self, entry: State, exit_: State) -> np.ndarray:
        """Ids between the two states, the piece of the exit state included."""
        begin = self.begin + entry[0]
        if self.head is None:
            if begin >= self.end:
                return np.zeros(0, dtype=np.int64)
            last = self.model.forward(self.text, begin, entry[1], self.end - 1)
            start = self.exits(last, begin)[exit_]
            return self.model.ids_of(self.text, [*self.model.trace(last, begin, start), (self.end + exit_[0], exit_[1])])
        parts = [self.model.ids_of(self.text, self.model.path(self.text, begin, entry[1], self.head)), self.inner()]
        if exit_ != START:
            last = self.model.forward(self.text, self.tail, -1, max(self.tail, self.end - 1))
            start = self.exits(last, self.tail)[exit_]
            parts.append(self.model.ids_of(self.text, [*self.model.trace(last, self.tail, start), (self.end + exit_[0], exit_[1])]))
        return np.concatenate(parts)


def fill(model: PieceModel, chunks: list[Chunk]) -> None:
    """Encode the middles of several chunks at once, each distinct word once."""
    ids, sizes = model.encode_lists(c.middle() for c in chunks)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    for c, a, b in zip(chunks, bounds[:-1], bounds[1:]):
        c._inner = ids[a:b]


def scan(matrices: list[Matrix]) -> list[tuple[State, State]]:
    """Entry and exit state of each chunk on the best path: prefix products, then states chosen from the last chunk back."""
    prefix = [matrices[0]]
    for m in matrices[1:]:
        prefix.append(product(prefix[-1], m))
    exits = prefix[-1][START]
    state = max(exits, key=exits.get)
    out = []
    for k in range(len(matrices) - 1, -1, -1):
        entries = prefix[k - 1][START] if k else {START: 0}
        entry = max((e for e in entries if state in matrices[k].get(e, {})), key=lambda e: entries[e] + matrices[k][e][state])
        out.append((entry, state))
        state = entry
    return out[::-1]


def _cut(chunk: int, reach: int):
    """A giant text into chunks with the characters around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text = SPACE + batch.column("text")[row].as_buffer().to_pybytes().decode("utf-8", "replace").replace(" ", SPACE)
                n = -(-len(text) // chunk)
                for k in range(n):
                    low, high = max(0, k * chunk - reach), min(len(text), (k + 1) * chunk + reach)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").slice(row, 1), pa.array([k], pa.int32()), pa.array([n], pa.int32()), pa.array([text[low:high]]),
                         pa.array([k * chunk - low], pa.int32()), pa.array([min(len(text), (k + 1) * chunk) - low], pa.int32())],
                        names=["key", "k", "n", "text", "low", "high"])

    return run


def _chunks(batch: pa.RecordBatch, model: PieceModel) -> list[Chunk]:
    out = [Chunk(model, text, low, high, k == 0, k == n - 1) for text, low, high, k, n in zip(*(batch.column(c).to_pylist() for c in ("text", "low", "high", "k", "n")))]
    fill(model, out)
    return out


def encode_giants(giants: DataFrame, proto: bytes, chunk: int) -> DataFrame:
    """(key, n_chunks, ids) of texts over one chunk. ``key`` names a text."""
    cut = materialize(giants.select("key", "text").mapInArrow(_cut(chunk, 64), "key binary, k int, n int, text string, low int, high int"), "chunks")
    spread = cut.repartition(X.shuffle_width(giants.sparkSession), "key", "k")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.pieces(batches, "text", SHARD_BYTES):
            rows = [[(*e, *x, w) for e, r in c.matrix().items() for x, w in r.items()] for c in _chunks(batch, load(proto))]
            cells = [np.array(r, dtype=np.int64).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), pa.array(cells, pa.binary())], names=["key", "k", "cells"])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        tables: list[Matrix] = []
        for cells in pdf.cells:
            m: Matrix = {}
            for a, b, c, d, w in np.frombuffer(cells, dtype=np.int64).reshape(-1, 5).tolist():
                m.setdefault((a, b), {})[c, d] = w
            tables.append(m)
        states = scan(tables)
        return pd.DataFrame({"key": pdf.key, "k": pdf.k, "states": [[*e, *x] for e, x in states]})

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.pieces(batches, "text", SHARD_BYTES):
            ids = [c.back((a, b), (d, e)).astype(_IDS).tobytes() for c, (a, b, d, e) in zip(_chunks(batch, load(proto)), batch.column("states").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), pa.array(ids, pa.binary())], names=["key", "k", "ids"])

    states = spread.mapInArrow(matrices, "key binary, k int, cells binary").groupBy("key").applyInPandas(choose, "key binary, k int, states array<int>")
    traced = cut.join(states, ["key", "k"]).mapInArrow(back, "key binary, k int, ids binary")
    parts = F.array_sort(F.collect_list(F.struct("k", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda all_, x: F.concat(all_, x["ids"]))
    return traced.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("n_chunks"), joined.alias("ids"))


def encode(docs: DataFrame, model_path: str, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``docs`` with ``n_pieces``, ``n_chunks``, ``ids`` (little-endian 32-bit) and ``decoded`` (the text back from the ids) added.

    The ids are those of the model's own encoder without begin and end marks. A text within one chunk is a single matrix and is
    encoded where it is read, each distinct word once a batch. A longer one is cut at any character: each chunk gives the
    transfer matrix of its boundary states, the matrices of a document are multiplied up, and each chunk is then backtraced by
    itself. Chunks are spread over all tasks; a document only gathers its matrices and its ids.

    A null or empty text has no pieces and decodes to the empty string; equal giant texts are encoded once; repeated rows are kept;
    columns of ``docs`` named like the added ones are replaced. A literal U+2581 in a text is a space to the model, as in its library.
    """
    proto = read_model(model_path)
    added = T.StructType.fromDDL(ADDED)
    out = docs.drop(*added.names)
    schema = T.StructType(out.schema.fields + added.fields)
    long_, kept = F.length(text) >= chunk, out.columns

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(proto)
        for shard in X.pieces(batches, text, SHARD_BYTES):
            ids, sizes = model.encode([t.decode("utf-8", "replace") for t in X.raw_texts(shard, text)])
            new = _columns(model, ids, sizes, np.ones(shard.num_rows, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*shard.columns, *new], names=[*shard.schema.names, *added.names])

    def large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(proto)
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                ids = np.frombuffer(one.column("__ids")[0].as_py(), dtype=_IDS).astype(np.int64)
                new = _columns(model, ids, np.array([len(ids)]), one.column("__chunks").to_numpy())
                yield pa.RecordBatch.from_arrays([*one.select(kept).columns, *new], names=[*kept, *added.names])

    short = out.where(~long_ | F.col(text).isNull()).mapInArrow(small, schema)
    giants = out.where(long_).withColumn("__key", F.unhex(F.sha2(text, 256)))
    distinct = giants.select(F.col("__key").alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
    encoded = encode_giants(distinct, proto, chunk).select(F.col("key").alias("__key"), F.col("n_chunks").alias("__chunks"), F.col("ids").alias("__ids"))
    return short.unionByName(giants.join(encoded, "__key").drop("__key").mapInArrow(large, schema))


def _columns(model: PieceModel, ids: np.ndarray, sizes: np.ndarray, chunks: np.ndarray) -> list[pa.Array]:
    bounds = np.concatenate([[0], np.cumsum(sizes)]) * 4
    packed = ids.astype(_IDS).tobytes()
    decoded = [d.decode("utf-8", "replace") for d in model.decode(ids, sizes)]
    return [pa.array(sizes), pa.array(chunks, pa.int32()), pa.array([packed[a:b] for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()), pa.array(decoded, pa.string())]
