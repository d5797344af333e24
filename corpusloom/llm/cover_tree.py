"""Hard negatives by inner product: cover trees over vectors lifted to one norm, searched best-first inside score windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.numbering import positions
from corpusloom.llm.texts import shuffle_width
from corpusloom.session import materialize

#: Bytes of the vectors of one tree, which a task holds; between these, a few trees for each task of the session.
LEAST_BYTES, MOST_BYTES = 2 << 20, 32 << 20
#: Members below which a node is a leaf; nodes opened in one step of a descent.
LEAF, OPEN = 8, 32
#: Sums of products up to this size are exact in floating point.
EXACT = 2.0**53

_LOW, _HIGH = -(2**63), 2**63 - 1


class CoverTree:
    """Cover tree over the rows of an integer matrix.

    A row x becomes (x, sqrt(M^2 - |x|^2)) with M the largest norm, so all lie on one sphere and the inner product with a query falls
    with the distance. A node covers its members within its radius; its children's centres, itself among them, are more than half the
    radius apart and cover all members within half the radius, down to leaves of a few rows or of equal rows.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.ids, self.labels, self.rows = ids, labels, rows
        norms = (rows.astype(np.float64) ** 2).sum(axis=1)
        self.norm = float(np.sqrt(max(1.0, norms.max(initial=0.0))))
        self.lifted = np.concatenate([rows.astype(np.float64), np.sqrt(np.maximum(0.0, self.norm**2 - norms))[:, None]], axis=1)
        self.largest = float(np.abs(rows.astype(np.float64)).max(initial=0))
        self._grow()

    def _grow(self) -> None:
        centre, radius, child, member, order = [0], [], [], [], []
        members: list[np.ndarray] = [np.arange(len(self.rows))]
        at = 0
        while at < len(centre):  # breadth first: the children of a node stand together
            mine, c = members[at], centre[at]
            members[at] = None
            gap = np.linalg.norm(self.lifted[mine] - self.lifted[c], axis=1)
            radius.append(float(gap.max(initial=0.0)))
            member.append(len(order))
            if len(mine) <= LEAF or radius[-1] < 0.5:  # different integer rows are at least 1 apart
                order.extend(mine.tolist())
                child.append((0, 0))
            else:
                parts = self._split(mine, c, gap, radius[-1] / 2)
                child.append((len(centre), len(centre) + len(parts)))
                for new, covered in parts:
                    centre.append(new)
                    members.append(covered)
            at += 1
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.child, self.member, self.order = np.array(child), np.array([*member, len(order)]), np.array(order)

    def _split(self, mine: np.ndarray, centre: int, gap: np.ndarray, radius: float) -> list[tuple[int, np.ndarray]]:
        """Children: the node's own centre, and members more than ``radius`` from it and from each other, each with the members nearest to it."""
        near, owner, chosen = gap.copy(), np.zeros(len(mine), dtype=np.int64), [centre]
        for begin in range(0, len(mine), 256):
            far = begin + np.flatnonzero(near[begin : begin + 256] > radius)
            if not len(far):
                continue
            inside = self._gaps(mine[far], mine[far])
            free, new = np.ones(len(far), dtype=bool), []
            for i in range(len(far)):
                if free[i]:
                    new.append(i)
                    free &= inside[i] > radius
            centres = mine[far[new]]
            for low in range(0, len(mine), 4096):
                part = slice(low, low + 4096)
                gaps = self._gaps(mine[part], centres)
                best = gaps.argmin(axis=1)
                value = gaps[np.arange(len(best)), best]
                better = value < near[part]
                near[part][better] = value[better]
                owner[part][better] = len(chosen) + best[better]
            owner[far[new]], near[far[new]] = len(chosen) + np.arange(len(new)), 0.0
            chosen.extend(centres.tolist())
        by = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[by], np.arange(len(chosen) + 1))
        return [(c, mine[by[a:b]]) for c, a, b in zip(chosen, cuts[:-1], cuts[1:])]

    def _gaps(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 * self.norm**2 - 2 * self.lifted[a] @ self.lifted[b].T))

    def products(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products; beyond floating point with whole numbers of any size, held at the ends of 64 bits."""
        if len(query) * self.largest * float(np.abs(query.astype(np.float64)).max(initial=0)) < EXACT:
            return (self.lifted[rows, :-1] @ query.astype(np.float64)).astype(np.int64)
        found = [sum(int(a) * int(b) for a, b in zip(query, self.rows[r])) for r in rows]
        return np.array([max(_LOW, min(_HIGH, s)) for s in found], dtype=np.int64)

    def bounds(self, query: np.ndarray, size: float, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest product of the query (of norm ``size``) with any member of each node."""
        if size == 0:
            return np.zeros(len(nodes)), np.zeros(len(nodes))
        cosine = self.lifted[self.centre[nodes], :-1] @ (query.astype(np.float64) / size) / self.norm
        gap = self.norm * np.sqrt(np.maximum(0.0, 2 - 2 * cosine))
        slack = 1e-6 * size * self.norm + 0.5
        most = size * (self.norm - np.maximum(0.0, gap - self.radius[nodes]) ** 2 / (2 * self.norm)) + slack
        least = size * (self.norm - np.minimum(2 * self.norm, gap + self.radius[nodes]) ** 2 / (2 * self.norm)) - slack
        return least, most

    def search(self, query: np.ndarray, windows: list[tuple[int, int]], allowed: np.ndarray, k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """For each window [low, high] the first ``k`` allowed rows with a product inside, greatest first, ties by id; and the rows verified.

        Nodes wait in the order of their greatest possible product. A node whose products all lie outside the windows, or below what
        a window has ``k`` rows of already, is not opened.
        """
        size = float(np.sqrt((query.astype(np.float64) ** 2).sum()))
        lows, highs = (np.array(x, dtype=np.float64) for x in zip(*windows))
        floors = lows.copy()
        held = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in windows]
        waiting, verified = np.zeros(1, dtype=np.int64), 0
        least, most = self.bounds(query, size, waiting)
        while len(waiting):
            useful = ((most[:, None] >= floors[None, :]) & (least[:, None] <= highs[None, :])).any(axis=1)
            waiting, least, most = waiting[useful], least[useful], most[useful]
            if not len(waiting):
                break
            first = np.argpartition(-most, min(OPEN, len(most)) - 1)[:OPEN]
            opened = waiting[first]
            rest = np.ones(len(waiting), dtype=bool)
            rest[first] = False
            waiting, least, most = waiting[rest], least[rest], most[rest]
            inner = opened[self.child[opened, 1] > 0]
            leaves = opened[self.child[opened, 1] == 0]
            if len(inner):
                new = np.concatenate([np.arange(*self.child[n]) for n in inner])
                low, high = self.bounds(query, size, new)
                waiting, least, most = np.concatenate([waiting, new]), np.concatenate([least, low]), np.concatenate([most, high])
            if len(leaves):
                rows = np.concatenate([self.order[self.member[n] : self.member[n + 1]] for n in leaves])
                rows = rows[allowed[rows]]
                verified += len(rows)
                scores, ids = self.products(query, rows), self.ids[rows]
                for w, (low, high) in enumerate(windows):
                    good = (scores >= low) & (scores <= high)
                    if good.any():
                        s, i = np.concatenate([held[w][0], scores[good]]), np.concatenate([held[w][1], ids[good]])
                        best = np.lexsort((i, ~s))[:k]
                        held[w] = s[best], i[best]
                        if len(best) == k:
                            floors[w] = float(s[best[-1]])
        return held, verified


def _grown(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Trees of rows that stand together, of one dimension and bounded bytes."""
    held, size, dimension, name = [], 0, -1, TaskContext.get().partitionId() << 32

    def packed(held: list[tuple]) -> pa.RecordBatch:
        nonlocal name
        name += 1
        ids, labels, rows = (np.concatenate(x) for x in zip(*held))
        columns = [pa.array([name], pa.int64()), pa.array([rows.shape[1]], pa.int32()), pa.array([np.unique(labels).tolist()], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array([x.tobytes()], pa.binary()) for x in (ids, labels, rows))], names=["name", "dimension", "labels", "ids", "marks", "vectors"])

    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pa.compute.list_value_length(batch.column("v")))
        flat, ends = np.asarray(batch.column("v").flatten()), np.cumsum(lengths)
        ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
        at = 0
        while at < len(ids):
            d = int(lengths[at])
            if held and (d != dimension or size >= most):
                yield packed(held)
                held, size = [], 0
            dimension = d
            same = np.flatnonzero(lengths[at:] != d)
            stop = min(at + (int(same[0]) if len(same) else len(ids) - at), at + max(1, (most - size) // (8 * max(1, d))))
            held.append((ids[at:stop], labels[at:stop], flat[ends[at] - d : ends[stop - 1]].reshape(stop - at, d)))
            size, at = size + 8 * max(1, d) * (stop - at), stop
    if held:
        yield packed(held)


_BLOCKS = "name long, dimension int, labels array<bigint>, ids binary, marks binary, vectors binary"
_FOUND = ["anchor_id", "place", "positive_id", "positive_score", "vec_id", "score"]
_TILE = "block int, dimension int, ids binary, marks binary, vectors binary, id long, label long, v array<bigint>, positives array<struct<score:bigint,id:bigint>>"


def _visit(k: int, windows):
    """Task function: each block's tree is grown once, then the anchors that visit it stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, now, dimension = None, None, -1
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for row in range(batch.num_rows):
                block = batch.column("block")[row].as_py()
                if (ids := batch.column("ids")[row].as_py()) is not None:
                    now, dimension = block, batch.column("dimension")[row].as_py()
                    marks, flat = np.frombuffer(batch.column("marks")[row].as_py(), dtype=np.int64), np.frombuffer(batch.column("vectors")[row].as_py(), dtype=np.int64)
                    tree = CoverTree(np.frombuffer(ids, dtype=np.int64), marks, flat.reshape(len(marks), dimension))
                    continue
                query = np.asarray(batch.column("v")[row].values, dtype=np.int64)
                if block != now or len(query) != dimension:
                    continue
                anchor, label = batch.column("id")[row].as_py(), batch.column("label")[row].as_py()
                wanted, allowed = windows(tree, anchor, label, batch.column("positives")[row].as_py())
                if not wanted or not allowed.any():
                    continue
                found, _ = tree.search(query, [w[3:] for w in wanted], allowed, k)
                for (place, positive, score, _, _), (scores, near) in zip(wanted, found):
                    for column, value in zip(out, (anchor, place, positive, score)):
                        column.extend([value] * len(near))
                    out[4].extend(near.tolist())
                    out[5].extend(scores.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=_FOUND)

    return run


def _same_label(tree: CoverTree, anchor: int, label: int, _):
    return [(0, None, None, _LOW, _HIGH)], (tree.labels == label) & (tree.ids != anchor)


def _other_label(low: int, high: int):
    def windows(tree: CoverTree, anchor: int, label: int, positives: list[dict]):
        # low * positive <= 100 * score <= high * positive, in whole numbers.
        ends = [(i, p["id"], p["score"], -((-low * p["score"]) // 100), (high * p["score"]) // 100) for i, p in enumerate(positives)]
        return [w for w in ends if w[3] <= w[4]], tree.labels != label

    return windows


def _tiles(blocks: DataFrame, visits: DataFrame, count: int, k: int, windows) -> DataFrame:
    rows = blocks.select("block", "dimension", "ids", "marks", "vectors").unionByName(visits, allowMissingColumns=True)
    dealt = rows.repartitionById(max(1, count), F.col("block")).sortWithinPartitions("block", F.col("ids").isNull())
    return dealt.select(*[F.col(c.split(" ")[0]) for c in _TILE.split(", ")]).mapInArrow(_visit(k, windows), ", ".join(f"{c} long" for c in _FOUND))


def hard_negatives(rows: DataFrame, anchors: Column, k: int = 5, positives: int = 5, low: int = 80, high: int = 100, key: str = "vec_id", vector: str = "v", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has integer vectors; ``anchors`` tells the anchors among them. The positives of an anchor are its best rows of its own
    label; the negatives of a positive are the best rows of other labels with ``low`` to ``high`` hundredths of its score. Ties go to
    the smaller id. Rows are sorted by label and dealt into blocks of bounded bytes, one cover tree each; for positives an anchor
    visits the blocks that hold its label, for negatives all blocks. No group of rows meets in one task.

    Rows with a null id, label, vector or component take no part; vectors meet only those of their own length; empty vectors have
    score 0. An anchor id given twice counts once, with its smallest label and vector; rows of an anchor's id are never its positives.
    Equal rows are candidates each. Fewer candidates give fewer rows, a positive of negative score none. Sums beyond 64 bits are held
    at their ends. Empty tables give no rows; other columns do not matter.
    """
    v = F.col(vector).cast("array<bigint>")
    whole = F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & F.forall(F.coalesce(v, F.array().cast("array<bigint>")), lambda x: x.isNotNull())
    whole_rows = rows.where(whole).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    spark = rows.sparkSession
    total = whole_rows.agg(F.sum(F.size("v").cast("long") * 8)).first()[0] or 0
    most = int(max(LEAST_BYTES, min(MOST_BYTES, total / (2 * shuffle_width(spark)))))
    dimension = F.size("v")
    dealt = whole_rows.select("id", "label", "v").repartitionByRange(dimension, "label", F.xxhash64("id")).sortWithinPartitions(dimension, "label", F.xxhash64("id"), "id")
    blocks = materialize(dealt.mapInArrow(lambda batches: _grown(batches, most), _BLOCKS), "blocks")
    # Dense numbers deal one block to one task.
    numbers = positions(blocks.select(F.lit(0).alias("one"), "name"), "one", ["name"]).select("name", F.col("idx").cast("int").alias("block"))
    blocks, count = blocks.join(numbers, "name"), blocks.count()
    asked = whole_rows.where("anchor").groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    asked = materialize(asked, "anchors")
    own = asked.join(blocks.select("block", F.explode("labels").alias("label")), "label").select("id", "label", "v", "block", F.lit(None).cast("array<struct<score:bigint,id:bigint>>").alias("positives"))
    best = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    near = _tiles(blocks, own, count, positives, _same_label).withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= positives)
    # Greatest score first, ties to the smaller id: its complement sorts that way, without overflow.
    ordered = F.array_sort(F.collect_list(F.struct(F.bitwise_not("score").alias("o"), F.col("vec_id").alias("id"), "score")))
    pairs = near.groupBy(F.col("anchor_id").alias("id")).agg(F.transform(ordered, lambda p: F.struct(p["score"].alias("score"), p["id"].alias("id"))).alias("positives"))
    everywhere = asked.join(pairs, "id").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(0, count - 1)))))
    found = _tiles(blocks, everywhere, count, k, _other_label(low, high)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
