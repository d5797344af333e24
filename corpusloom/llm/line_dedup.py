"""Line dedup over the whole corpus that returns keep bitmaps instead of text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import texts as X
from corpusloom.session import materialize

SHARD_BYTES = 2 << 20
SPACE = X.byte_class((0x20, 0x20), (0x09, 0x0D))
NO_ID = 2**63 - 1

_LINES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64()), ("text_id", pa.int64()), ("n_lines", pa.int32()), ("lines", pa.list_(pa.int32()))])


def line_keys(texts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines with a key of at least ``least`` code points: text, line number, two key hashes. Last: lines of each text."""
    data, begin = X.joined(texts)
    raw = np.frombuffer(data, dtype=np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    solid = np.flatnonzero(~SPACE[raw])
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = np.flatnonzero(low < high)
    start, end = solid[low[some]], solid[high[some] - 1] + 1
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32)])
    long_ = points[end] - points[start] >= least
    some, start, size = some[long_], start[long_], (end - start)[long_]
    first = np.searchsorted(ends, begin)  # first line of each text
    text = np.searchsorted(first, some, side="right") - 1
    lower = data.translate(X.LOWER_BYTES)
    return text, some - first[text], X.hash_spans(lower, start, size, 1).view(np.int64), X.hash_spans(lower, start, size, 2).view(np.int64), np.diff(first)


def _groups(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows begin a new combination of values."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _lists(values: np.ndarray, new: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([np.flatnonzero(new), [len(values)]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def _shard_rows(least: int):
    """Per shard: a row for each document with the lines known to be repeats already, and one for each key with its first holder."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in X.pieces(batches, "text", SHARD_BYTES):
            ids, text_ids = (shard.column(c).to_numpy(zero_copy_only=False) for c in ("id", "text_id"))
            text, line, h1, h2, n_lines = line_keys(X.raw_texts(shard, "text"), least)
            order = np.lexsort((line, text, ids[text], h2, h1))
            text, line, h1, h2 = text[order], line[order], h1[order], h2[order]
            key = _groups(h1, h2)
            holder = ids[text]
            repeat = holder != holder[key][np.cumsum(key) - 1] if len(key) else np.zeros(0, dtype=bool)
            again = np.lexsort((line[repeat], text[repeat]))
            dropped_text, dropped_line = text[repeat][again], line[repeat][again]
            bounds = np.searchsorted(dropped_text, np.arange(len(ids) + 1)).astype(np.int32)
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(ids), pa.array(text_ids), pa.array(n_lines.astype(np.int32)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(dropped_line.astype(np.int32)))], schema=_LINES)
            text, line, h1, h2 = text[~repeat], line[~repeat], h1[~repeat], h2[~repeat]
            new = _groups(h1, h2, text)
            t = text[new]
            yield pa.RecordBatch.from_arrays([pa.array(h1[new]), pa.array(h2[new]), pa.array(ids[t]), pa.array(text_ids[t]), pa.nulls(len(t), pa.int32()), _lists(line, new)], schema=_LINES)

    return rows


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, document: those behind the first document of their key."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, ids = (batch.column(c).to_numpy() for c in ("h1", "h2", "id"))
        new = _groups(h1, h2)
        if last and (h1[0], h2[0]) == last[:2]:
            new[0] = False
        group = np.cumsum(new)
        holders = np.concatenate([[last[2] if last else 0], ids[new]])
        later = ids != holders[group]
        last = (h1[-1], h2[-1], holders[group[-1]])
        yield batch.select(["id", "text_id", "n_lines", "lines"]).filter(pa.array(later))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, dropped, keep = batch.column("n_lines").to_numpy(), [], []
        for size, lines in zip(n, batch.column("lines").to_pylist()):
            bits = np.ones(size, dtype=bool)
            bits[lines] = False
            dropped.append(size - int(bits.sum()))
            keep.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_id"), pa.array(n.astype(np.int64)), pa.array(dropped, pa.int64()), pa.array(keep, pa.binary())], names=["id", "text_id", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, least: int = 10, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(id, text_id, n_lines, n_dropped, keep): per document the lines to keep, as compressed packed bits.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least ``least`` code points that more
    than one document holds stay only in the document with the smallest id. Within a shard of bounded size the first holder of a
    key is found before anything is shuffled, so a line of every document is one row per shard. The key hashes (128 bits) are
    range-partitioned and sorted by key, document; one pass streams each key's first holder past the later ones. No text moves.

    Lines split at a line feed; a null or empty text is one empty line. Rows that share an id count as one document and drop
    nothing from each other; ``text_id`` (hash of the text) tells them apart. A null id sorts last; it is given as 2^63 - 1.
    Other columns of ``docs`` play no part. An empty table gives an empty result.
    """
    rows = docs.select(X.id_key(doc).alias("id"), F.xxhash64(text).alias("text_id"), F.col(text).alias("text"))
    known = materialize(rows.mapInArrow(_shard_rows(least), "h1 long, h2 long, id long, text_id long, n_lines int, lines array<int>"), "lines")
    width = X.shuffle_width(docs.sparkSession)
    keys = known.where("h1 IS NOT NULL").repartitionByRange(width, "h1", "h2").sortWithinPartitions("h1", "h2", "id")
    later = keys.mapInArrow(_stream, "id long, text_id long, n_lines int, lines array<int>")
    every = known.where("h1 IS NULL").select("id", "text_id", "n_lines", "lines").unionByName(later)
    merged = every.groupBy("id", "text_id").agg(F.max("n_lines").alias("n_lines"), F.flatten(F.collect_list("lines")).alias("lines"))
    return merged.mapInArrow(_bitmaps, "id long, text_id long, n_lines long, n_dropped long, keep binary")


def kept_text(value: bytes, keep: bytes) -> bytes:
    """The kept lines of a text."""
    lines = value.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8), count=len(lines))
    return value if bits.all() else b"\n".join(lines[i] for i in np.flatnonzero(bits))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """``docs`` with only their kept lines, ``n_lines`` and ``n_dropped`` added. A null text stays null."""
    out = docs.drop("n_lines", "n_dropped")
    right = bitmaps.select(F.col("id").alias("__id"), F.col("text_id").alias("__text_id"), "n_lines", "n_dropped", F.col("keep").alias("__keep"))
    both = out.join(right, (X.id_key(doc) == F.col("__id")) & (F.xxhash64(text) == F.col("__text_id")), "left").drop("__id", "__text_id")
    target = both.drop("__keep").schema
    names = target.names

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.pieces(batches, text, SHARD_BYTES):
            dropped = np.asarray(batch.column("n_dropped"))
            values = batch.column(text).cast(pa.binary()).to_pylist()
            for row in np.flatnonzero(dropped).tolist():
                values[row] = kept_text(values[row], batch.column("__keep")[row].as_py())
            columns = {n: batch.column(n) for n in names} | {text: pa.array(values, pa.binary()).cast(batch.column(text).type)}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return both.mapInArrow(rebuild, target)
