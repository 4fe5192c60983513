"""Scoring of tree ensembles: packed blocks of trees, walked where the rows are.

The nodes of a block of trees travel as flat arrays of checked size; every batch of
rows walks all trees of the block at once. No row is exploded by trees and nothing is
shuffled. Trees that are too large for that stay where they are: each piece of a tree, as it
was grown in one task, meets the rows that reach it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .trees import matrix

# Nodes of a tree that may be packed, bytes of a block of trees, and of all blocks: a worker holds them all.
TREE_NODES, BLOCK_BYTES, PACKED_BYTES = 500_000, 32 * 1024 * 1024, 256 * 1024 * 1024
# Bytes of the rows that meet one piece of a tree.
PIECE_BYTES = 64 * 1024 * 1024
# (row, tree) pairs that walk at once in a task.
PAIRS = 200_000


@dataclass
class Block:
    """Trees as arrays over their nodes; ``left`` and ``right`` are positions, -1 at leaves."""

    trees: list[int]
    roots: np.ndarray
    left: np.ndarray
    right: np.ndarray
    fs: np.ndarray
    ws: np.ndarray
    threshold: np.ndarray
    value: np.ndarray


def pack(nodes: pa.Table, wanted: list[int], most: int, root: int = 1) -> Block:
    nodes = nodes.sort_by([("tree", "ascending"), ("node", "ascending")])
    n = len(nodes)
    tree, node = nodes["tree"].to_numpy(), nodes["node"].to_numpy()
    fs, ws = np.zeros((n + 1, most), np.int32), np.zeros((n + 1, most))
    listed = nodes["fs"].combine_chunks()
    sizes = listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(n), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    fs[row, place] = listed.flatten().to_numpy(zero_copy_only=False)
    ws[row, place] = nodes["ws"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    # The last place is a leaf without a value: the root of a tree that no row was drawn for.
    left, right = np.full(n + 1, -1), np.full(n + 1, -1)
    roots = np.full(len(wanted), n)
    inner = nodes["left"].is_valid().to_numpy(zero_copy_only=False)
    down = [nodes[side].fill_null(0).to_numpy() for side in ("left", "right")]
    for i, t in enumerate(wanted):
        a, b = np.searchsorted(tree, [t, t + 1])
        if a == b:
            continue
        roots[i] = a + np.searchsorted(node[a:b], root)
        here = a + np.flatnonzero(inner[a:b])
        left[here], right[here] = (a + np.searchsorted(node[a:b], d[here]) for d in down)
    threshold = np.append(nodes["threshold"].fill_null(0.0).to_numpy(), 0.0)
    value = np.append(nodes["value"].to_numpy(), np.nan)
    return Block(wanted, roots, left, right, fs, ws, threshold, value)


def walk(block: Block, x: np.ndarray) -> np.ndarray:
    """(rows, trees): the leaf values."""
    return block.value[leaves(block, x)]


def leaves(block: Block, x: np.ndarray) -> np.ndarray:
    """(rows, trees): the positions of the leaves."""
    width = len(block.roots)
    out = np.empty((len(x), width), np.int64)
    step = max(1, PAIRS // max(1, width))
    for start in range(0, len(x), step):
        part = x[start:start + step]
        at = np.tile(block.roots, len(part))
        live = np.arange(len(at))
        while True:
            live = live[block.left[at[live]] >= 0]
            if not len(live):
                break
            node, row = at[live], live // width
            v = block.ws[node, 0] * part[row, block.fs[node, 0]]
            for j in range(1, block.fs.shape[1]):
                w = block.ws[node, j]
                v = np.where(w != 0, v + w * part[row, block.fs[node, j]], v)
            at[live] = np.where(v <= block.threshold[node], block.left[node], block.right[node])
        out[start:start + step] = at.reshape(len(part), width)
    return out


def blocks(nodes: DataFrame, most: int, limit: int) -> tuple[list[list[int]], list[int]]:
    """The trees that may be packed, in groups whose arrays stay below ``BLOCK_BYTES``, and the others.

    If all packed trees take over ``PACKED_BYTES``, none is packed."""
    sizes = sorted((r["tree"], r["n"]) for r in nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).collect())
    each = 12 * most + 40
    if sum(n for _, n in sizes) * each > PACKED_BYTES:
        return [], [tree for tree, _ in sizes]
    groups, room, large = [], 0, []
    for tree, n in sizes:
        if n > min(limit, BLOCK_BYTES // each):
            large.append(tree)
            continue
        if n * each > room:
            groups.append([])
            room = BLOCK_BYTES
        groups[-1].append(tree)
        room -= n * each
    return groups, large


def _packed(nodes: DataFrame, group: list[int], most: int):
    part = nodes.where(F.col("tree").between(group[0], group[-1]) & F.col("tree").isin(group) if len(group) < group[-1] - group[0] + 1
                       else F.col("tree").between(group[0], group[-1]))
    table = part.select("tree", "node", "left", "right", "fs", "ws", "threshold", "value").toArrow()
    return nodes.sparkSession.sparkContext.broadcast(pack(table, group, most))


def _listed(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    flat = pa.array(values.ravel(), mask=np.isnan(values.ravel()))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), flat)


def _walker(shared, change=None) -> Column:
    @F.arrow_udf("array<double>")
    def score(x: pa.Array) -> pa.Array:
        rows = matrix(pa.chunked_array([x]))
        found = walk(shared.value, rows)
        return _listed(found if change is None else change(found))

    return score("x")


def votes(rows: DataFrame, nodes: DataFrame, n_trees: int, most: int, limit: int = TREE_NODES, keep_x: bool = False) -> DataFrame:
    """``rows`` with ``votes``, the leaf value of each tree (null for a tree without rows)."""
    groups, large = blocks(nodes, most, limit)
    keep = [c for c in rows.columns if c != "x" or keep_x]
    if large:
        rows = _numbered_rows(rows)
    walked = rows.select("*", *[_walker(_packed(nodes, g, most)).alias(f"_v{i}") for i, g in enumerate(groups)])
    if large:
        place = F.array_position(F.array(*[F.lit(t) for t in large]), F.col("tree"))
        listed = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("i"), "value"))), lambda t: t["value"])
        found = _by_pieces(rows, nodes, large, most).groupBy("_rid").agg(listed.alias("_joined"))
        walked = walked.join(found, "_rid", "left").drop("_rid")
    order = [t for g in groups for t in g] + large
    every = F.concat(*[F.col(f"_v{i}") for i in range(len(groups))], *([F.col("_joined")] if large else []))
    if order != list(range(n_trees)):
        place = {t: i for i, t in enumerate(order)}
        at = F.array(*[F.lit(place.get(t)).cast("int") for t in range(n_trees)])
        every = F.transform(at, lambda i: F.get(every, i))
    return walked.select(*keep, every.alias("votes"))


def tally(
    rows: DataFrame, nodes: DataFrame, groups: list[int], most: int, classes: list[float] | None, name: str, limit: int = TREE_NODES,
) -> DataFrame:
    """Add ``name``: the sum of the votes of each group of trees, or by group the count of each class."""
    packed, large = blocks(nodes, most, limit)
    n = max(groups) + 1

    def change_for(trees: list[int]):
        member = np.zeros((len(trees), n))
        for i, t in enumerate(trees):
            if groups[t] >= 0:
                member[i, groups[t]] = 1.0

        def change(found: np.ndarray) -> np.ndarray:
            if classes is None:
                return np.nan_to_num(found) @ member
            counts = [(found == c).astype(float) @ member for c in classes]
            return np.stack(counts, axis=2).reshape(len(found), -1)

        return change

    columns = [_walker(_packed(nodes, g, most), change_for(g)).alias(f"_p{i}") for i, g in enumerate(packed)]
    numbered = _numbered_rows(rows) if large else rows
    out = numbered.select("*", *columns)
    parts = [F.col(f"_p{i}") for i in range(len(packed))]
    if large:
        of = F.get(F.array(*[F.lit(g) for g in groups]), F.col("tree"))
        value = F.when(F.isnan("value"), F.lit(None)).otherwise(F.col("value"))
        cells = [
            F.coalesce(F.sum(F.when(of == g, value)) if c is None else F.count_if((of == g) & (value == c)).cast("double"), F.lit(0.0))
            for g in range(n) for c in classes or [None]]
        found = _by_pieces(numbered, nodes, large, most).groupBy("_rid").agg(F.array(*cells).alias("_pj"))
        out = out.join(found, "_rid", "left")
        parts.append(F.col("_pj"))
    total = parts[0]
    for part in parts[1:]:
        total = F.zip_with(total, part, lambda a, b: a + b)
    return out.select(*rows.columns, total.alias(name))


def _numbered_rows(rows: DataFrame) -> DataFrame:
    """``rows``, materialised, with a number of their own: keys may repeat."""
    return cut_lineage(rows.withColumn("_rid", F.monotonically_increasing_id()))


def _by_pieces(rows: DataFrame, nodes: DataFrame, trees: list[int], most: int) -> DataFrame:
    """(_rid, tree, value) for large trees: one shuffle brings rows to the pieces that they reach.

    The nodes above all pieces are few, as each piece holds what one task can grow. Rows
    of a piece are dealt over as many tasks as their bytes need, each with the piece's nodes.
    """
    part = nodes.where(F.col("tree").isin(trees))
    upper = part.where((F.col("piece") == 0) | (F.col("piece") == F.col("node")))
    bare = [F.when(F.col("piece") == 0, F.col(c)).alias(c) for c in ("left", "right", "fs", "ws", "threshold")]
    top = upper.select("tree", "node", "piece", "value", *bare).toArrow().sort_by([("tree", "ascending"), ("node", "ascending")])
    block = pack(top, trees, most)
    number = np.where(top["piece"].to_numpy() != 0, top["node"].to_numpy(), 0)
    above = bool((number == 0).any())
    names, number = np.array(trees, np.int32), np.append(number, 0)
    shared = rows.sparkSession.sparkContext.broadcast((block, number, names))
    schema = "_rid bigint, x array<double>, tree int, piece bigint, value double"

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number, names = shared.value
        step = max(1, PAIRS // len(names))
        for batch in batches:
            for start in range(0, len(batch), step):
                some = batch.slice(start, step)
                at = leaves(block, matrix(pa.chunked_array([some["x"]]))).ravel()
                row = np.repeat(np.arange(len(some)), len(names))
                piece = number[at]
                # A row that has come to its leaf leaves its columns behind.
                x = some["x"].take(pa.array(row, mask=piece == 0))
                yield pa.RecordBatch.from_arrays(
                    [some["_rid"].take(pa.array(row)), x, pa.array(np.tile(names, len(some))), pa.array(piece), pa.array(block.value[at])],
                    names=["_rid", "x", "tree", "piece", "value"])

    slots = rows.select("_rid", "x").mapInArrow(route, schema)
    below = slots.where("piece != 0")
    # How many tasks share the rows of a piece.
    if above:
        counted = below.groupBy("tree", "piece").agg(F.count(F.lit(1)).alias("n"))
    else:
        counted = part.where("piece = node").select("tree", "piece", F.lit(rows.count()).alias("n"))
    p = rows.select(F.size("x")).first()
    each = max(1, PIECE_BYTES // (8 * (p[0] if p else 1) + 64))
    shares = cut_lineage(counted.select("tree", "piece", F.ceil(F.col("n") / each).cast("int").alias("tasks")))
    if shares.where("tasks > 1").isEmpty():
        below, pieces = below.withColumn("task", F.lit(0)), part.where("piece != 0").withColumn("task", F.lit(0))
    else:
        below = below.join(F.broadcast(shares), ["tree", "piece"]).withColumn("task", F.pmod(F.xxhash64("_rid"), F.col("tasks")).cast("int"))
        pieces = part.where("piece != 0").join(F.broadcast(shares), ["tree", "piece"]).withColumn(
            "task", F.explode(F.sequence(F.lit(0), F.greatest(F.col("tasks"), F.lit(1)) - 1)))
    keys = ["tree", "piece", "task"]

    def finish(found: pa.Table, piece: pa.Table) -> pa.Table:
        if not len(found) or not len(piece):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.float64())], names=["_rid", "tree", "value"])
        tree, root = piece["tree"][0].as_py(), piece["piece"][0].as_py()
        value = walk(pack(piece, [tree], most, root), matrix(found["x"]))
        return pa.table([found["_rid"], found["tree"], pa.array(value[:, 0])], names=["_rid", "tree", "value"])

    out = below.select("_rid", "x", *keys).groupBy(*keys).cogroup(
        pieces.select(*keys, "node", "left", "right", "fs", "ws", "threshold", "value").groupBy(*keys)).applyInArrow(finish, "_rid bigint, tree int, value double")
    return out.unionByName(slots.where("piece = 0").select("_rid", "tree", "value")) if above else out
