"""Shared helpers of the operators: batches of whole texts as byte buffers, word spans and hashes in NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Membership table of the bytes in the given closed ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes of a word after lower-casing: digits, a-z and everything beyond ASCII.
WORD_BYTES = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def small_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch than Spark's 10,000, where nobody chose otherwise: a batch of whole texts must fit a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_key(column: str = "doc_id"):
    """Sorts a null id behind all others."""
    return F.coalesce(F.col(column), F.lit(2**63 - 1))


def pieces(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one piece hold about ``max_bytes``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
        block = (np.cumsum(sizes) - sizes) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(low, high - low)


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes per row; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """All texts with a line feed behind each, and where each begins (one more at the end)."""
    sizes = np.fromiter((len(x) + 1 for x in texts), dtype=np.int64, count=len(texts))
    return b"".join(y for x in texts for y in (x, b"\n")), np.concatenate([[0], np.cumsum(sizes)])


def spans(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes of a class: starts and ends."""
    member = inside[data]
    edges = np.flatnonzero(member[1:] != member[:-1]) + 1
    if len(member) and member[0]:
        edges = np.concatenate([[0], edges])
    if len(member) and member[-1]:
        edges = np.concatenate([edges, [len(member)]])
    return edges[0::2], edges[1::2]


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S1, _S2 = np.uint64(32), np.uint64(29)


def mix(x: np.ndarray) -> np.ndarray:
    """One invertible scrambling step of 64-bit integers, in place."""
    x *= _P1
    x ^= x >> _S1
    x *= _P2
    x ^= x >> _S2
    return x


def hash_spans(data: bytes, start: np.ndarray, length: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a step for all spans at once."""
    padded = data + b"\0" * 8
    words = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    out = mix(length.astype(np.uint64) + np.uint64(seed << 40))
    chunk = words[start] & _MASKS[np.minimum(length, 8)]
    out = mix(out ^ chunk)
    rest, at = np.flatnonzero(length > 8), 8
    while rest.size:
        left = length[rest] - at
        out[rest] = mix(out[rest] ^ (words[start[rest] + at] & _MASKS[np.minimum(left, 8)]))
        rest, at = rest[left > 8], at + 8
    return out
