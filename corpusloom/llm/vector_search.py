"""Exact top-k inner products, pruned by segment means and deviations from coarse to fine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import texts as X
from corpusloom.session import materialize

#: Most bytes of the vectors of a block (a task holds one), least bytes of one while there are fewer blocks than tasks, most bytes of
#: the queries of a tile (they stream), and pairs bounded at a time.
BLOCK_BYTES, LEAST_BYTES, QUERY_BYTES, PAIRS = 64 << 20, 4 << 20, 128 << 20, 1 << 21
#: Segments of the coarsest level; each further level has ``FINER`` times as many, the last has segments of two components.
COARSEST, FINER = 4, 4
#: Shares of the finest segments that are opened into their components, one step after the other, before whole products.
OPENED = (0.25, 0.5)
#: Below this share of pairs left, bounds are computed pair by pair and not as a matrix.
SPARSE = 0.1
#: Integers up to this size give exact sums in floating point.
EXACT = 2**22
_LOW, _HIGH = -(2**63), 2**63 - 1


def levels(dimensions: int) -> list[int]:
    """Numbers of segments, coarse to fine."""
    finest, out = -(-dimensions // 2), []
    while (count := COARSEST * FINER ** len(out)) < finest:
        out.append(count)
    return [*out, finest] if finest else []


def segments(vectors: np.ndarray, count: int) -> np.ndarray:
    """Means and deviations of ``count`` segments, scaled so that their squares add up to those of the vector.

    The squared distance of two vectors is at least that of their segments. As the norms are equal, their product is at most that of
    their segments.
    """
    width = -(-vectors.shape[1] // count)
    padded = np.pad(vectors, ((0, 0), (0, width * count - vectors.shape[1]))).reshape(len(vectors), count, width)
    return np.concatenate([padded.mean(axis=2), padded.std(axis=2)], axis=1) * np.sqrt(width)


def resolutions(vectors: np.ndarray, sign: int = 1) -> list[np.ndarray]:
    """One matrix for each level, and for each opening the components it brings and, with ``sign``, the segments it takes away."""
    counts = levels(vectors.shape[1])
    out = [segments(vectors, n) for n in counts]
    cuts = [0, *(round(share * counts[-1]) for share in OPENED)] if counts else []
    for low, high in zip(cuts[:-1], cuts[1:]):
        gone = [out[len(counts) - 1][:, k + low : k + high] for k in (0, counts[-1])]
        out.append(np.concatenate([vectors[:, 2 * low : 2 * high], *(sign * g for g in gone)], axis=1))
    return out


class Block:
    """Vectors of one dimension with their segment statistics. ``verified`` counts the exact products."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, whole = ids[order], vectors[order]
        self.exact = bool((np.abs(whole.astype(np.float64)) <= EXACT).all())
        self.vectors = whole.astype(np.float64)
        self.whole = None if self.exact else whole
        self.largest = float((self.vectors**2).sum(axis=1).max(initial=0.0))
        self.resolutions = resolutions(self.vectors)
        self.coarse = len(levels(vectors.shape[1]))
        self.verified = 0

    def scores(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Inner products of query rows with own rows, pair by pair. Components beyond ``EXACT`` use whole numbers of any size."""
        self.verified += len(rows)
        if self.exact and (np.abs(query.astype(np.float64)) <= EXACT).all():
            return np.einsum("ij,ij->i", query.astype(np.float64), self.vectors[rows]).astype(np.int64)
        own = self.vectors[rows].astype(np.int64) if self.whole is None else self.whole[rows]
        found = [sum(int(a) * int(b) for a, b in zip(q, x)) for q, x in zip(query, own)]
        return np.array([max(_LOW, min(_HIGH, s)) for s in found], dtype=np.int64)

    def top(self, ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query place, row, score): what can be among the best ``k`` of each query, exact scores.

        ``floor`` is a score that ``k`` candidates of a query are known to reach. At each level the rows best by the bound raise it
        by their exact scores; rows whose bound stays below it are dropped. What is left behind the last level is verified.
        """
        step = max(1, PAIRS // max(1, len(self.ids)))
        floor = np.full(len(ids), -np.inf) if floor is None else floor
        parts = [self._best(ids[i : i + step], queries[i : i + step], k, floor[i : i + step], i) for i in range(0, len(ids), step)]
        return tuple(np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, dtype=np.int64),) * 3

    def _best(self, ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q = queries.astype(np.float64)
        slack = 0.5 + 1e-9 * ((q**2).sum(axis=1) + self.largest)
        # Products held at the low end of 64 bits say nothing about what lies below.
        floor = np.where(floor <= _LOW, -np.inf, floor)
        free = self.ids[None, :] != ids[:, None]
        total, bound, pairs = free.size, None, None
        for level, (mine, own) in enumerate(zip(resolutions(q, -1), self.resolutions)):
            opening = level >= self.coarse
            if pairs is None:
                product = mine @ own.T
                bound = bound + product if opening else product
                bound[~free] = -np.inf
                floor = self._raised(queries, bound, free, floor, k)
                left = bound >= (floor - slack)[:, None]
                left &= free
                if left.sum() < SPARSE * total:
                    pairs = np.nonzero(left)
                    bound = bound[pairs]
            else:
                a, b = pairs
                product = np.einsum("ij,ij->i", mine[a], own[b])
                bound = bound + product if opening else product
                good = bound >= (floor - slack)[a]
                pairs, bound = (a[good], b[good]), bound[good]
        a, b = np.nonzero(free if bound is None else (bound >= (floor - slack)[:, None]) & free) if pairs is None else pairs
        score = np.concatenate([self.scores(queries[a[i : i + 65536]], b[i : i + 65536]) for i in range(0, len(a), 65536)] or [np.zeros(0, dtype=np.int64)])
        order = np.lexsort((self.ids[b], ~score, a))
        a, b, score = a[order], b[order], score[order]
        nth = np.arange(len(a)) - np.searchsorted(a, a)
        return a[nth < k] + offset, b[nth < k], score[nth < k]

    def _raised(self, queries: np.ndarray, bound: np.ndarray, free: np.ndarray, floor: np.ndarray, k: int) -> np.ndarray:
        """The floor, raised by the exact scores of the rows with the greatest bounds."""
        few = min(4 * k, bound.shape[1])
        if few < k:
            return floor
        first = np.argpartition(bound, bound.shape[1] - few, axis=1)[:, -few:]
        at = np.repeat(np.arange(len(queries)), few)
        exact = np.where(free[at, first.ravel()], self.scores(queries[at], first.ravel()), -np.inf).reshape(len(queries), few)
        reached = np.partition(exact, few - k, axis=1)[:, few - k]
        # A float may lie above the whole number it stands for.
        reached = np.where(reached <= _LOW, -np.inf, reached - 1e-9 * np.abs(reached))
        return np.maximum(floor, reached)


def _search(k: int):
    def vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        column = batch.column("v")
        return batch.column("id").to_numpy(), np.asarray(column.flatten()).reshape(batch.num_rows, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        block, now = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            place, query = batch.column("tile").to_numpy(), np.asarray(batch.column("query"))
            size = np.asarray(pa.compute.list_value_length(batch.column("v")))
            cuts = np.flatnonzero((np.diff(place) != 0) | (np.diff(query) != 0) | (np.diff(size) != 0)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)]):
                if (key := (place[low], size[low])) != now:
                    held, block, now = [], None, key
                part = batch.slice(low, high - low)
                ids, values = vectors(part)
                if not query[low]:
                    held.append((ids, values))
                    continue
                if block is None and held:
                    block, held = Block(*(np.concatenate(x) for x in zip(*held))), []
                if block is None:
                    continue
                floor = part.column("floor").cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                # A float may lie above the whole number it stands for.
                a, b, score = block.top(ids, values, k, np.where(np.isfinite(floor), floor - 1e-9 * np.abs(floor), floor))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(block.ids[b]), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def top_products(rows: DataFrame, queries: DataFrame, k: int = 5, vector: str = "v", key: str = "vec_id", block_bytes: int = BLOCK_BYTES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the largest inner product of each query, ties to the smaller id.

    Both sides have integer vectors. Rows are dealt into blocks and queries into parts, both of bounded bytes, whatever their ids;
    a tile is a block and a part, and a task holds the block while the part streams by. In a first round each query
    meets one block; the score its best ``k`` reach there is the floor below which the other blocks drop rows by their
    bounds in the second round. Each tile gives at most ``k`` rows for a query; those are ranked over all blocks.

    Rows with a null id, a null vector or a null component take no part; vectors meet only those of their own length, and those
    without components have a product of 0; a row is no candidate for a query of its own id; a query id given twice counts once,
    with its smallest vector; equal rows are candidates each. Fewer than ``k`` candidates give fewer rows, empty tables none. Sums
    beyond 64 bits are held at their ends. Further columns are not read.
    """
    spark = rows.sparkSession
    whole = F.col(vector).isNotNull() & F.col(key).isNotNull() & F.forall(F.coalesce(F.col(vector), F.array()), lambda x: x.isNotNull())
    left = rows.where(whole).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    asked = queries.where(whole).groupBy(F.col(key).alias("id")).agg(F.min(vector).alias("v"))
    size = F.coalesce(F.sum(F.size("v") * 8 + 16), F.lit(0))
    held, wanted = (table.agg(size).first()[0] for table in (left, asked))
    blocks = max(1, -(-held // block_bytes), min(X.shuffle_width(spark), held // LEAST_BYTES))
    parts = max(1, -(-wanted // query_bytes))
    # Dealt by place, as all rows may have one id; stored, as both rounds must find a row in the same block.
    dealt = left.withColumn("block", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    dealt = (materialize(dealt, "blocks") if blocks > 1 else dealt).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    placed = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("home", F.pmod(F.xxhash64(F.lit("home"), "id"), F.lit(blocks)).cast("int"))

    def tiles(now: DataFrame) -> DataFrame:
        place: Column = (F.col("block") * parts + F.col("part")).cast("int").alias("tile")
        both = dealt.select(place, F.lit(False).alias("query"), "id", "v", F.lit(None).cast("long").alias("floor")).union(now.select(place, F.lit(True), "id", "v", "floor"))
        return both.repartitionById(blocks * parts, F.col("tile")).sortWithinPartitions("tile", F.size("v"), "query").mapInArrow(_search(k), "query_id long, vec_id long, score long")

    found = tiles(placed.withColumn("block", F.col("home")).withColumn("floor", F.lit(None).cast("long")))
    if blocks > 1:
        found = materialize(found, "first-blocks")
        floors = found.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        others = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b != F.col("home"))
        found = found.union(tiles(placed.join(floors, "id", "left").withColumn("block", F.explode(others))))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_numbers(vectors: DataFrame, column: str, scale: int = 256) -> DataFrame:
    """``v``: floor(scale * x) of each component as a long; null when the vector is null or has a null or non-finite component."""
    x = F.transform(F.col(column), lambda c: F.floor(c.cast("double") * scale))
    finite = F.forall(F.col(column), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.withColumn("v", F.when(finite, x))
