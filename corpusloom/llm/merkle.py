"""Merkle manifest of a table: digests by group and over groups, and every row's proof by pointer jumping.

A group's leaves are numbered in order; runs of three consecutive nodes become one node until one is left. The groups' roots, in the
order of the groups, are the leaves of a second tree. A node holds the siblings on its way to an ancestor. At first that is its parent;
each self-join appends the ancestor's own siblings and doubles the distance, so a tree of height h takes log2(h) joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.numbering import positions
from corpusloom.operators.grouped import null_safe_join
from corpusloom.session import discard, materialize

ARITY = 3
#: Levels that one shuffle builds: a task sees ARITY ** LEVELS consecutive nodes of a group at a time.
LEVELS = 6

_SIDES = "array<struct<left:binary,right:binary>>"


def row_digest(columns: Sequence[Column | str]) -> Column:
    """SHA-256 (32 bytes) of the values in turn: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    parts = []
    for c in columns:
        value = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def combined(run: list[bytes]) -> bytes:
    """Digest of a run of nodes, whose digests count as hex text."""
    return hashlib.sha256("".join(d.hex() for d in run).encode()).digest()


def _block_nodes(base: int):
    """Nodes of ``LEVELS`` levels above each block, each with its siblings; ``kind``: 0 a node, 1 a root, 2 a node to go on with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("kind", "level", "idx", "digest", "left", "right", "n", "of", "own")}

            def emit(*values) -> None:
                for column, value in zip(out.values(), values):
                    column.append(value)

            cells = batch.column("cells")
            flat, begin = cells.flatten(), 0
            digests, numbers = flat.field("digest").to_pylist(), flat.field("idx").to_pylist()
            for row, (size, n) in enumerate(zip(pa.compute.list_value_length(cells).to_pylist(), batch.column("n").to_pylist())):
                order = sorted(range(begin, begin + size), key=numbers.__getitem__)
                begin += size
                nodes, first, level, left_over = [digests[i] for i in order], numbers[order[0]], base, n
                while left_over > 1 and level < base + LEVELS:
                    for i, d in enumerate(nodes):
                        low = i - i % ARITY
                        emit(0, level, first + i, d, b"".join(nodes[low:i]), b"".join(nodes[i + 1 : low + ARITY]), n, row, order[i] if level == base else None)
                    nodes = [combined(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)]
                    first, level, left_over = first // ARITY, level + 1, -(-left_over // ARITY)
                emit(1 if left_over == 1 else 2, level, first, nodes[0], None, None, left_over, row, order[0] if level == base else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("grp").take(pa.array(out["of"], pa.int32())), pa.array(out["kind"], pa.int8()), pa.array(out["level"], pa.int32()), pa.array(out["idx"], pa.int64()),
                    pa.array(out["digest"], pa.binary()), pa.array(out["left"], pa.binary()), pa.array(out["right"], pa.binary()), pa.array(out["n"], pa.int64()),
                    flat.field("own").take(pa.array(out["own"], pa.int32())),
                ],
                names=["grp", "kind", "level", "idx", "digest", "left", "right", "n", "own"],
            )

    return run


def _double(nodes: DataFrame, step: int) -> DataFrame:
    """Nodes ``2 * step`` levels apart, their segments reaching twice as far: each takes over the segment of the node it points to.

    A node that points to its root has all its siblings; its key meets nothing and is its own, so that finished nodes do not pile up.
    """
    level, far = F.col("level"), 2 * step
    key = F.when(F.col("at") < F.col("height"), F.struct("grp", F.col("at"), F.floor(F.col("idx") / F.lit(ARITY**step)).alias("idx"))).otherwise(
        F.struct("grp", F.lit(-1).alias("at"), "idx"))
    mine = nodes.where(level % far == 0).withColumn("key", key)
    theirs = nodes.where((level % far == step) & (F.size("sides") > 0)).select(F.struct("grp", F.col("level").alias("at"), "idx").alias("key"), F.col("at").alias("__at"), F.col("sides").alias("__sides"))
    joined = mine.join(theirs, "key", "left")
    none = F.array().cast(_SIDES)
    return joined.select("grp", "level", "idx", "height", "own", F.coalesce("__at", "at").alias("at"), F.concat("sides", F.coalesce("__sides", none)).alias("sides"))


def tree(leaves: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``leaves`` has ``grp``, ``digest`` (32 bytes), a struct ``own`` and the order columns. Returns (grp, own, sides) for each leaf, the
    siblings left and right of its path level by level, and (grp, root)."""
    placed = positions(leaves, "grp", order).select("grp", "idx", "n", "digest", "own")
    out = T.StructType([T.StructField("grp", leaves.schema["grp"].dataType)] + T.StructType.fromDDL(
        "kind tinyint, level int, idx bigint, digest binary, left binary, right binary, n bigint").fields + [T.StructField("own", leaves.schema["own"].dataType)])
    stored, base, most = [], 0, 1
    while True:
        block = F.floor(F.col("idx") / F.lit(ARITY**LEVELS))
        blocks = placed.groupBy("grp", block.alias("block")).agg(F.first("n").alias("n"), F.collect_list(F.struct("idx", "digest", "own")).alias("cells"))
        stored.append(materialize(blocks.mapInArrow(_block_nodes(base), out), "merkle-nodes"))
        found = stored[-1].agg(F.max("n").alias("n"), F.max("kind").alias("kind")).first()
        if base == 0:
            most = found["n"] or 1
        if found["kind"] != 2:
            break
        placed, base = stored[-1].where("kind = 2").select("grp", "idx", "n", "digest", "own"), base + LEVELS
    every = stored[0]
    for more in stored[1:]:
        every = every.unionByName(more)
    roots = every.where("kind = 1").select("grp", F.col("digest").alias("root"), F.col("level").alias("height"))
    steps = _height(most)
    side = F.when(F.col("kind") == 0, F.array(F.struct("left", "right"))).otherwise(F.array().cast(_SIDES)).alias("sides")
    nodes = every.where("kind < 2").select(
        "grp", "level", "idx", _group_height(F.when(F.col("level") < 0, 0).otherwise(F.col("n")), F.col("level"), F.col("kind"), steps).alias("height"), "own",
        F.when(F.col("kind") == 0, F.col("level") + 1).otherwise(F.col("level")).alias("at"), side)
    step, before = 1, None
    while step < steps:
        nodes = _double(nodes, step)
        step *= 2
        if step < steps:
            nodes = materialize(nodes, "merkle-jumps")
            if before is not None:
                discard(before)
            before = nodes
    return nodes.where("level = 0").select("grp", "own", "sides"), roots.select("grp", "root")


def _height(n: int) -> int:
    height = 0
    while n > 1:
        n, height = -(-n // ARITY), height + 1
    return height


def _group_height(n: Column, level: Column, kind: Column, most: int) -> Column:
    """Level of the root of a group: ``n`` counts the nodes at the lowest level that the node's block was built from."""
    base = level - level % LEVELS
    above = sum(((n > ARITY**k).cast("int") for k in range(most)), F.lit(0))
    return F.when(kind == 1, level).otherwise(base + above)


def manifest(table: DataFrame, columns: Sequence[str], group: str, order: str, tampered: Column | None = None) -> DataFrame:
    """(order column, group column, leaf, subroot, root, proof_sha256, folded_root, verified): one row for each row of ``table``.

    A leaf is the digest of ``columns``. ``tampered`` is the digest of a row as it is found later, null where it is as it was; a proof is
    folded from there with the siblings of the manifest, and ``verified`` tells whether it gives the root.

    A null group is a group, before the others; a null order value comes first in its group; rows of one order value are ordered by
    their digests, so repeated rows are leaves each. Empty tables give no rows. Texts are digested where they are read; only digests
    are shuffled. Other columns do not matter, whatever their names.
    """
    after = F.lit(None).cast("binary") if tampered is None else tampered
    digests = table.select(F.col(group).alias("grp"), F.col(order).alias("id"), row_digest(columns).alias("digest"), after.alias("after"))
    leaves = materialize(digests.withColumn("own", F.struct("id", F.col("digest").alias("leaf"), "after")).drop("after"), "merkle-leaves")
    proofs, roots = tree(leaves, ["id", "digest"])
    tops = materialize(roots, "merkle-roots").select(F.lit(0).alias("grp"), F.col("grp").alias("name"), F.col("root").alias("digest"), F.struct(F.col("grp").alias("name"), F.col("root").alias("subroot")).alias("own"))
    above, root = tree(tops, ["name"])
    tails = above.select(F.col("own.name").alias("grp"), F.col("own.subroot").alias("subroot"), F.col("sides").alias("__tail"), root.select("root").scalar().alias("root"))
    whole = null_safe_join(proofs, tails, ["grp"]).withColumn("path", F.concat("sides", "__tail"))
    text = lambda c: F.lower(F.hex(c))
    start = text(F.coalesce("own.after", "own.leaf"))
    folded = F.aggregate("path", start, lambda h, s: F.sha2(F.concat(text(s["left"]), h, text(s["right"])), 256))
    siblings = F.array_join(F.transform("path", lambda s: text(F.concat(s["left"], s["right"]))), "")
    return whole.select(
        F.col("own.id").alias(order), F.col("grp").alias(group), text(F.col("own.leaf")).alias("leaf"), text(F.col("subroot")).alias("subroot"), text(F.col("root")).alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
