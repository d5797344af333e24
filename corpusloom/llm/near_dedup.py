"""One document of each group of near copies, by SimHash candidates and exact similarity of word shingles."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import texts as X
from corpusloom.llm.components import components
from corpusloom.llm.simhash import majority, near_links, shingle_hashes
from corpusloom.session import materialize

SHARD_BYTES = 2 << 20
WORDS, SIMILARITY = 5, 0.8
#: Slices fingerprinted of each text. At a similarity of 0.8 a slice is equal with a chance of 0.25 to 0.5, so 16 of them leave
#: under one pair in a hundred without an equal slice.
SLICES = 16
#: Texts of up to so many distinct shingles have no slices: too few shingles fall in one. They are candidates by shared rare
#: shingles (``_prefixes``), which loses no pair; so are the longer texts that one of them may be similar to.
SHORT = 60
#: Groups of equal slices up to this size are compared pair by pair. Larger ones are first compared with their ends; what that does
#: not connect is compared in tiles, cut from blocks of about so many members and shingles.
SMALL_GROUP, TILE_ROWS, TILE_SHINGLES = 32, 2_000, 1 << 20
#: Shares that the members of a block are dealt in where they are only told apart by class.
DEALS = 16


def text_slices(hashes: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Slices of a text's distinct shingles, cut by hash so that 3 to 6 fall in one: (level and number, hashes).

    Texts of nearly the same size must cut alike, so both levels around the text's size are taken.
    """
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    out = []
    for level in sorted({max(0, int(np.log2(max(1.0, len(hashes) * f / 3)))) for f in (0.894, 1.119)}):
        number = (mixed >> np.uint64(64 - level)).astype(np.int64) if level else np.zeros(len(hashes), dtype=np.int64)
        some = number < SLICES
        for k in np.unique(number[some]).tolist():
            out.append((level << 8 | k, hashes[number == k]))
    return out


def _sketch(words: int, similarity: float):
    longest = int(SHORT / similarity + 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in X.pieces(batches, "text", SHARD_BYTES):
            rows = X.raw_texts(shard, "text")
            hashes, sizes = shingle_hashes(rows, words)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            names, parts, each, n, short, owns = [], [], [], [], [], []
            for a, b in zip(bounds[:-1], bounds[1:]):
                own = np.unique(hashes[a:b])
                n.append(len(own))
                owns.append(own)
                short.append(own.view(np.int64) if len(own) <= longest else [])
                cut = text_slices(own) if len(own) > SHORT else []
                names += [n for n, _ in cut]
                parts += [h for _, h in cut]
                each.append(len(cut))
            # Over distinct shingles, as the similarity: a passage repeated inside a text changes nothing.
            fp = majority(np.concatenate(owns) if owns else hashes, np.array(n, dtype=np.int64)).view(np.int64)
            prints = majority(np.concatenate(parts), np.array([len(p) for p in parts])) if parts else np.zeros(0, dtype=np.uint64)
            keys = X.mix(X.mix(prints ^ np.uint64(0xA5A5A5A5)) + np.array(names, dtype=np.uint64)).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(each)]).astype(np.int32)
            node = pa.array([hashlib.md5(t, usedforsecurity=False).digest() for t in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([node, shard.column("id"), pa.array(fp), pa.array(n, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys)), pa.array(short, pa.list_(pa.int64()))], names=["node", "id", "fp", "n", "slices", "short"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in X.pieces(batches, "text", SHARD_BYTES):
            hashes, sizes = shingle_hashes(X.raw_texts(shard, "text"), words)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            short = (hashes >> np.uint64(32)).astype(np.uint32)
            sets = [np.unique(short[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([shard.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def _similar(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("su"), batch.column("sv")):
                x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint32) for s in (a, b))
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y]))) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                keep.append(common >= similarity * (len(x) + len(y) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _prefixes(distinct: DataFrame, who: Column, similarity: float) -> DataFrame:
    """(key, who): the rarest shingles of each short text, so many that similar texts have one in common.

    Similar texts of n shingles share at least ``similarity`` n, so at most n minus that many are not shared, and one more is enough,
    whatever order both sets are put in; with the rarest first the groups are small.
    """
    each = distinct.select(who, F.explode("short").alias("shingle"))
    counted = each.join(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts")), "shingle")
    order = F.array_sort(F.collect_list(F.struct("texts", "shingle")))
    enough = (F.col("who.n") - F.ceil(F.col("who.n") * similarity - 1e-9) + 1).cast("int")
    return counted.groupBy("who").agg(order.alias("s")).select(F.explode(F.slice("s", 1, enough)).alias("s"), "who").where("s.texts > 1").select(F.xxhash64("s.shingle").alias("key"), "who")


def _group_pairs(members: DataFrame) -> DataFrame:
    """Candidate pairs (p, q) of groups: all pairs of those up to ``SMALL_GROUP``, in larger ones each member with the first and the last."""
    small = members.where(F.col("members") <= SMALL_GROUP).groupBy("key").agg(F.sort_array(F.collect_list("who")).alias("m"))
    each = small.select("m", F.posexplode("m").alias("at", "q")).select("q", F.explode(F.slice("m", F.col("at") + 2, F.size("m"))).alias("p"))
    ends = members.where(F.col("members") > SMALL_GROUP).select("who", F.explode(F.array("first", "last")).alias("other")).where("who != other")
    return each.select("p", "q").union(ends.select(F.greatest("who", "other").alias("p"), F.least("who", "other").alias("q")))


def cross_links(sets: list[np.ndarray], label: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between sets of different labels, until each similar pair is linked or connected by way of others."""
    _, label = np.unique(label, return_inverse=True)
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    start = np.cumsum(size) - size
    open_, waiting, out = np.ones(len(sets), dtype=bool), deque(range(len(sets))), []
    has = np.zeros(len(values), dtype=bool)
    while waiting and (label != label[0]).any():
        x = waiting.popleft()
        if not open_[x]:
            continue
        open_[x] = False
        asked = open_ & (label != label[x]) & (np.minimum(size, size[x]) >= similarity * np.maximum(size, size[x]))
        if not asked.any():
            continue
        own = flat[start[x] : start[x] + size[x]]
        has[own] = True
        common = np.add.reduceat(has[flat], start, dtype=np.int64)
        has[own] = False
        near = np.flatnonzero(asked & (common >= similarity * (size + size[x] - common)))
        reached, first = np.unique(label[near], return_index=True)
        out += [(x, y) for y in near[first].tolist()]
        label[np.isin(label, reached)] = label[x]
        waiting.extendleft(near.tolist())  # those reached are the likeliest to reach further
    return out


def _tiles(similarity: float):
    """Rows sorted by tile: links between the classes of each tile."""

    def links(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = cross_links([r[2] for r in rows], np.array([r[1].hex() for r in rows]), similarity)
        yield pa.RecordBatch.from_arrays([pa.array([rows[k[e]][0] for k in found], pa.binary()) for e in (0, 1)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows = None, []
        for batch in batches:
            for t, node, label, shingles in zip(*(batch.column(c).to_pylist() for c in ("tile", "node", "label", "shingles"))):
                if t != tile and rows:
                    yield from links(rows)
                    rows = []
                tile = t
                rows.append((node, label, np.frombuffer(shingles, dtype=np.uint32)))
        if rows:
            yield from links(rows)

    return run


def _links_left(big: DataFrame, linked: DataFrame, sets: DataFrame, similarity: float) -> DataFrame | None:
    """Links that the ends of the large groups did not show; none if each large group is in one class already.

    Groups are cut into blocks of bounded size; each pair of blocks is a tile of its own, and only tiles of several classes are compared.
    """
    label = F.coalesce("component", "node").alias("label")
    # A group of one block still has up to TILE_ROWS members, so it is dealt by some of them at a time.
    deals = F.col("blocks") * DEALS
    named = big.join(linked, "node", "left").select("key", "node", "blocks", label, F.pmod(F.xxhash64(F.lit("deal"), "node"), deals).cast("int").alias("deal"))
    by_deal = named.groupBy("key", "deal").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.first("blocks").alias("blocks"))
    mixed = by_deal.groupBy("key").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.first("blocks").alias("blocks")).where("a < b")
    mixed = mixed.select("key", F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own")
    split = named.join(mixed, ["key", "deal"], "left_semi").select("key", "node", "label", own, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiled = materialize(split.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), "node", "label"), "tiles")
    several = materialize(tiled.groupBy("tile").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("tile"), "mixed-tiles")
    if several.isEmpty():
        return None
    rows = tiled.join(several, "tile", "left_semi").join(sets, "node").select("tile", "node", "label", "shingles")
    return rows.repartition(X.shuffle_width(big.sparkSession), "tile").sortWithinPartitions("tile").mapInArrow(_tiles(similarity), "u binary, v binary")


def near_copy_classes(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(node, id, class): per distinct text (``node``, its MD5) its smallest id, and the class it is in.

    Texts are linked at a similarity (Jaccard, distinct word shingles) of ``similarity`` or more. Candidates are texts whose
    fingerprints are within 3 bits (the grid), and texts with an equal SimHash of a slice of their shingles; the latter reach
    similarities whose whole fingerprints lie too far apart for any grid. Short texts with a rare shingle in common are candidates
    without any estimate. All pairs of a group of equal slices or a common shingle are compared unless
    other links connect them. Every link is checked on the full shingle sets. Texts without words
    are all alike. Classes are chains of links.
    """
    rows = docs.select(X.id_key(doc).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    all_ = materialize(rows.mapInArrow(_sketch(words, similarity), "node binary, id long, fp long, n int, slices array<long>, short array<long>"), "sketches")
    distinct = materialize(all_.groupBy("node").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("fp", "n", "slices", "short"))), "distinct-texts")
    who = F.struct("node", "n").alias("who")
    # Texts without words form a group of their own: their sets are equal, so its ends link all of it.
    keyed = distinct.select(F.explode(F.when(F.col("n") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.array_append("slices", F.xxhash64("fp")))).alias("key"), who).union(_prefixes(distinct, who, similarity))
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("who.n").alias("shingles"), F.min("who").alias("first"), F.max("who").alias("last"))
    members = materialize(keyed.join(groups.where("members > 1"), "key"), "groups")
    blocks = F.greatest(F.ceil(F.col("members") / TILE_ROWS), F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("int").alias("blocks")
    big = members.where((F.col("members") > SMALL_GROUP) & (F.col("who.n") > 0)).select("key", "who.node", blocks)
    first = distinct.groupBy("fp").agg(F.min(who).alias("who"))
    near = near_links(distinct.select("fp").distinct())
    joined = near.join(first.select(F.col("fp").alias("u"), F.col("who").alias("p")), "u").join(first.select(F.col("fp").alias("v"), F.col("who").alias("q")), "v").select("p", "q")
    pairs = _group_pairs(members).union(joined)
    # A set can be similar only to sets of nearly its size; no other pair is left out.
    pairs = pairs.where(F.least("p.n", "q.n") >= similarity * F.greatest("p.n", "q.n"))
    pairs = materialize(pairs.select(F.col("p.node").alias("u"), F.col("q.node").alias("v")).distinct(), "pairs")
    asked = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).union(big.select("node")).distinct().join(distinct.select("node", "id"), "node")
    # By node and id: of many copies only the one of the smallest id is read, and the others are spread over all tasks.
    texts = rows.withColumn("node", F.unhex(F.md5(F.col("text").cast("binary")))).join(asked, ["node", "id"], "left_semi").dropDuplicates(["node", "id"])
    sets = materialize(texts.select("node", "text").mapInArrow(_sets(words), "node binary, shingles binary"), "shingles")
    left, right = (sets.select(F.col("node").alias(n), F.col("shingles").alias(s)) for n, s in (("u", "su"), ("v", "sv")))
    links = materialize(pairs.join(left, "u").join(right, "v").mapInArrow(_similar(similarity), "u binary, v binary"), "checked")
    linked = materialize(components(links), "linked")
    more = _links_left(big, linked, sets, similarity)
    if more is not None:
        linked = components(links.union(more))
    return distinct.select("node", "id").join(linked, "node", "left").select("node", "id", F.coalesce("component", "node").alias("class"))


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """``docs`` with one row for each class of near copies: that with the smallest id.

    Equal rows count once. A null text is like an empty one; a null id sorts last. Further columns are kept as they are.
    """
    classes = materialize(near_copy_classes(docs, words, similarity, text, doc), "classes")
    chosen = classes.groupBy("class").agg(F.min(F.struct("id", "node")).alias("c")).select(F.col("c.id").alias("__id"), F.col("c.node").alias("__node"))
    keyed = docs.withColumn("__id", X.id_key(doc)).withColumn("__node", F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    return keyed.join(chosen, ["__id", "__node"]).dropDuplicates(["__id", "__node"]).select(*docs.columns)
