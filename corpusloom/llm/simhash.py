"""SimHash near-duplicates: segment bit counts as a grid, Manhattan distance as the lower bound, exact distances at the end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import texts as X
from corpusloom.llm.components import components
from corpusloom.session import materialize

SHARD_BYTES = 4 << 20
RADIUS = 3
#: Rows of a grid cell compared in one task; larger cells are cut into blocks and compared block by block.
CELL_ROWS = 20_000
#: Cells up to this size are compared row against following rows for many cells at once.
SMALL_CELL = 24
SEED = 42

_LANES = np.array([sum(((b >> j) & 1) << (8 * j) for j in range(8)) for b in range(256)], dtype=np.uint64)


def shingles(text: bytes, words: int) -> list[bytes]:
    """Word shingles, repeats included; a shorter text is one shingle, a text without words has none."""
    w = text.translate(X.LOWER_BYTES).split()
    if len(w) <= words:
        return [b" ".join(w)] if w else []
    return [b" ".join(x) for x in zip(*(w[i:] for i in range(words)))]


def shingle_hashes(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles of all texts, and how many each text has."""
    digest, out, sizes = xxhash.xxh64_intdigest, [], []
    for text in texts:
        s = shingles(text, words)
        sizes.append(len(s))
        out.append(np.fromiter((digest(x, SEED) for x in s), dtype=np.uint64, count=len(s)))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64), np.array(sizes, dtype=np.int64)


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive groups of hashes: bits set in over half of them; zero for an empty group.

    Bits are counted eight at a time in the byte lanes of a 64-bit sum, over runs of at most 255 hashes.
    """
    out = np.zeros(len(sizes), dtype=np.uint64)
    some = np.flatnonzero(sizes)
    if not some.size:
        return out
    runs = -(-sizes[some] // 255)
    head = np.cumsum(sizes[some]) - sizes[some]
    first = np.cumsum(runs) - runs
    start = np.repeat(head, runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(first, runs))
    columns = hashes.view(np.uint8).reshape(-1, 8)
    for c in range(8):
        lanes = np.add.reduceat(_LANES[columns[:, c]], start).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
        bits = (2 * counts > sizes[some, None]).astype(np.uint64)
        for j in range(8):
            out[some] |= bits[:, j] << np.uint64(8 * c + j)
    return out


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``fp`` (64-bit fingerprint, as a signed integer) added. Null text has no words: zero."""
    others = [c for c in docs.columns if c not in (text, "fp")]
    fields = docs.select(*others).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in X.pieces(batches, text, SHARD_BYTES):
            fp = majority(*shingle_hashes(X.raw_texts(shard, text), words)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(shard.column(c) for c in others), pa.array(fp)], names=[*others, "fp"])

    return docs.select(*others, text).mapInArrow(run, fields)


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """The embedding: bit counts of the 32 two-bit segments, two bits each."""
    return fp - ((fp >> np.uint64(1)) & np.uint64(0x5555555555555555))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells that a fingerprint stands in or visits.

    At a Manhattan distance of 3 or less, one half of the 32 counts is at a distance of 1 or less: the halves are equal, or one
    is the other with one count raised by one. So each fingerprint stands in two cells and visits those one count up.
    """
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        for half in (0, 1):
            counts = ((segment_counts(fp) >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            keys, home, who = [counts], [np.ones(len(fp), dtype=bool)], [fp]
            for segment in range(16):
                up = np.flatnonzero((counts >> (2 * segment)) & 3 < 2)
                keys.append(counts[up] + (1 << (2 * segment)))
                home.append(np.zeros(len(up), dtype=bool))
                who.append(fp[up])
            key = np.concatenate(keys) | (half << 33)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.concatenate(home)), pa.array(np.concatenate(who).view(np.int64))], names=["cell", "home", "fp"])


def _close(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= radius


def _forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from the smallest member of each connected group to the others, comparing each with those not yet reached."""
    left, right, rest = [], [], np.unique(fp)
    while rest.size > 1:
        reached, rest = [rest[0]], rest[1:]
        for x in reached:
            near = _close(rest, x, radius)
            if near.any():
                reached.extend(rest[near])
                rest = rest[~near]
            if not rest.size:
                break
        left += [reached[0]] * (len(reached) - 1)
        right += reached[1:]
    return np.array(left, dtype=np.uint64), np.array(right, dtype=np.uint64)


def _compare(radius: int):
    """Rows sorted by cell and tile: links between the fingerprints of a cell, few per group."""

    def links(cell: np.ndarray, home: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        size = np.diff(np.concatenate([new, [len(cell)]]))
        member = np.repeat(np.arange(len(new)), size)
        small = (size <= SMALL_CELL)[member]
        left, right = [], []
        for lag in range(1, min(SMALL_CELL, int(size.max()))):
            a = np.flatnonzero(small[:-lag] & (member[lag:] == member[:-lag]) & (home[lag:] | home[:-lag]))
            a = a[_close(fp[a], fp[a + lag], radius) & (fp[a] != fp[a + lag])]
            left.append(fp[a])
            right.append(fp[a + lag])
        for g in np.flatnonzero(size > SMALL_CELL):
            at = slice(new[g], new[g] + size[g])
            if home[at].any():
                a, b = _forest(fp[at], radius)
                left.append(a)
                right.append(b)
        none = np.zeros(0, dtype=np.uint64)
        return np.concatenate([none, *left]), np.concatenate([none, *right])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(cell, home, fp):
            a, b = links(cell, home, fp)
            a, b = a.view(np.int64), b.view(np.int64)
            pair = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column("cell").to_numpy(), np.asarray(batch.column("home")), batch.column("fp").to_numpy().view(np.uint64)))
            if held[0][0][0] != held[-1][0][-1]:  # the last cell may go on in the next batch
                cell, home, fp = (np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(cell, cell[-1]))
                yield out(cell[:cut], home[:cut], fp[:cut])
                held = [(cell[cut:], home[cut:], fp[cut:])]
        if held:
            yield out(*(np.concatenate(x) for x in zip(*held)))

    return run


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that join all fingerprints of ``distinct`` (column fp) at ``radius`` or fewer differing bits.

    Not every close pair is given, but whatever close pairs connect is connected. Radius 3 at most: the grid relies on it.
    Cells over ``CELL_ROWS`` rows are cut into blocks by fingerprint; each pair of blocks is a tile of its own.
    """
    if radius > 3:
        raise ValueError("the grid is built for 3 differing bits at most")
    cells = distinct.select("fp").mapInArrow(_cells, "cell long, home boolean, fp long")
    hot = materialize(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(f"n > {CELL_ROWS}"), "hot-cells")
    if hot.isEmpty():
        tiled = cells.withColumn("tile", F.col("cell"))
    else:
        blocks = F.ceil(F.col("n") / CELL_ROWS).cast("int")
        own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.coalesce(blocks, F.lit(1)) - 1))
        split = cells.join(hot, "cell", "left").select("cell", "home", "fp", own.alias("own"), other.alias("other"))
        tiled = split.withColumn("tile", F.when(F.col("own").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))))
    ordered = tiled.select(F.col("tile").alias("cell"), "home", "fp").repartition(X.shuffle_width(distinct.sparkSession), "cell").sortWithinPartitions("cell")
    return ordered.mapInArrow(_compare(radius), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = RADIUS, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(id column, fp, component_id): the class of each document under chains of close fingerprints.

    Equal fingerprints are folded first, so copies cost one row; only distinct fingerprints enter the grid. ``component_id`` is the
    smallest id reachable, the document's own included. Texts without words (null, empty) share the zero fingerprint and are linked
    like any others. Repeated rows are kept, each with its class; a null id is never the smallest unless all are null. Further
    columns play no part.
    """
    prints = materialize(fingerprints(docs.select(doc, text), words, text), "fingerprints")
    folded = materialize(prints.groupBy("fp").agg(F.min(doc).alias("least")), "folded")
    linked = components(near_links(folded, radius))
    classes = linked.join(folded.withColumnRenamed("fp", "node"), "node").groupBy("component").agg(F.min("least").alias("class"))
    member = linked.join(classes, "component").select(F.col("node").alias("fp"), "class")
    # Stored, so that the join below is between two plain shuffles and a fingerprint of many copies can be split.
    ids = materialize(folded.join(member, "fp", "left").select("fp", F.coalesce("class", "least").alias("component_id")), "classes")
    return prints.join(ids, "fp").select(doc, "fp", "component_id")
