"""Exact splits of nodes that are too large for one task.

The range of every column is cut at values of a sketch: into those single values, and the open intervals
between them, which hold a bounded number of entries. Sums per node and bucket say what lies
below each bucket, so that a bucket finds its best threshold on its own. Only entries of the intervals
are shuffled, once and packed: a value, its node, weight and target.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import trees

# Entries that an interval of a column should have, in all nodes, for up to ten classes.
ENTRIES = 250_000
_BEST = "tree int, at int, j int, f int, v double, share double, n_left bigint, n_right bigint, threshold double"


@dataclass(frozen=True)
class Grid:
    """The class labels (None for numbers), and by column the values its range is cut at."""

    labels: np.ndarray | None
    cuts: list[np.ndarray]

    @property
    def buckets(self) -> int:
        return 2 * max((len(c) for c in self.cuts), default=0) + 1


def grid(rows: DataFrame, classes: bool, p: int, entries: int) -> Grid:
    """Cuts for rows (x, c) that have ``entries`` values a column in all trees."""
    labels = np.array(sorted(r[0] for r in rows.select("c").distinct().collect()), np.int64) if classes else None
    pieces = max(2, math.ceil(entries * max(1.0, (0 if labels is None else len(labels)) / 10) / ENTRIES))
    shares = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    values = rows.select(F.posexplode("x").alias("f", "v")).where("v IS NOT NULL AND NOT isnan(v)")
    found = values.groupBy("f").agg(F.percentile_approx("v", shares, max(1000, 10 * pieces)).alias("cuts")).collect()
    cuts = [np.zeros(0)] * p
    for r in found:
        cuts[r.f] = np.unique(np.array(r.cuts, float))
    return Grid(labels, cuts)


def _entries(batch: pa.RecordBatch, cuts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Row, place, column, value and bucket of each column that a row's node tries: 2i below cut i, 2i + 1 on it, -1 for NaN."""
    n = len(batch)
    x = trees.matrix(pa.chunked_array([batch["x"]]))
    f = batch["fs"].flatten().to_numpy(zero_copy_only=False)
    tried = len(f) // n
    row = np.repeat(np.arange(n), tried)
    v = x[row, f]
    bucket = np.empty(len(v), np.int64)
    order = np.argsort(f.astype(np.uint16), kind="stable")
    ends = np.searchsorted(f[order], np.arange(len(cuts) + 1))
    for i, c in enumerate(cuts):
        here = order[ends[i]:ends[i + 1]]
        part = v[here]
        at = np.searchsorted(c, part)
        on = np.append(c, np.nan)[at] == part
        bucket[here] = 2 * at + on
    bucket[np.isnan(v)] = -1
    return row, np.tile(np.arange(tried), n), f, v, bucket


def _grouped(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, which are below ``size``, and the place of each key among them."""
    if size > 4 * len(key):
        return np.unique(key, return_inverse=True)
    there = np.bincount(key, minlength=size) > 0
    return np.flatnonzero(there), (np.cumsum(there) - 1)[key]


def _nodes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tree and place of the nodes of a batch, and the node of each row."""
    code = (batch["tree"].to_numpy().astype(np.int64) << 32) | batch["at"].to_numpy().astype(np.int64)
    found, node = np.unique(code, return_inverse=True)
    return found >> 32, found & 0xFFFFFFFF, node


def _sums(shared):
    """Per batch the sums of each node, column and bucket, and its least value."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            if not len(batch):
                continue
            tree, at, node = _nodes(batch)
            row, j, f, v, bucket = _entries(batch, found.cuts)
            p, width = len(found.cuts), found.buckets + 1
            keys, place = _grouped((node[row] * p + f) * width + bucket + 1, len(tree) * p * width)
            w = batch["w"].to_numpy().astype(float)
            if found.labels is None:
                y = batch["y"].to_numpy()
                sums = np.stack([np.bincount(place, s[row], len(keys)) for s in (w, w * y, w * y * y)], axis=1)
            else:
                k = len(found.labels)
                code = np.searchsorted(found.labels, batch["c"].to_numpy())
                sums = np.bincount(place * k + code[row], w[row], len(keys) * k).reshape(-1, k)
            low = np.full(len(keys), np.inf)
            np.fmin.at(low, place, v)
            tried = np.zeros(len(keys), int)
            tried[place] = j
            of, rest = np.divmod(keys, p * width)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * sums.shape[1]), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([
                pa.array(tree[of], pa.int32()), pa.array(at[of], pa.int32()), pa.array(tried, pa.int32()), pa.array(rest // width, pa.int32()),
                pa.array(rest % width - 1, pa.int32()), pa.array(low), lists], names=["tree", "at", "j", "f", "bucket", "low", "s"])

    return work


def _packed(shared):
    """Per batch the entries of each open interval, packed."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            if not len(batch):
                continue
            row, _, f, v, bucket = _entries(batch, found.cuts)
            inside = np.flatnonzero((bucket >= 0) & (bucket % 2 == 0))
            key = f[inside] * np.int64(found.buckets) + bucket[inside]
            order = np.argsort(key, kind="stable")
            inside, key = inside[order], key[order]
            if not len(key):
                continue
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            ends = np.append(first, len(key))
            target = batch["y"].to_numpy() if found.labels is None else np.searchsorted(found.labels, batch["c"].to_numpy()).astype(np.int32)
            of = row[inside]
            columns = [batch["tree"].to_numpy()[of].astype(np.int32), batch["at"].to_numpy()[of].astype(np.int32), v[inside],
                       batch["w"].to_numpy()[of].astype(np.int32), target[of]]
            blobs = [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * c.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(c))])
                     for c in columns]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[first] // found.buckets, pa.int32()), pa.array(key[first] % found.buckets, pa.int32()), *blobs], names=["f", "bucket", "tree", "at", "v", "w", "t"])

    return work


def _joined(blobs: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(b.as_buffer() for b in blobs), kind)


def best_cuts(samples: DataFrame, found: Grid, least: int) -> DataFrame:
    """(tree, at, j, f, v, n_left, n_right, share, threshold) of the best threshold of all, between neighbouring values.

    ``samples`` has the rows (tree, at, w, c, y, x) with the columns ``fs`` that their node tries, in
    order. NaN and null go right. The first column tried and the lowest threshold win a tie.
    """
    classes = found.labels is not None
    k = len(found.labels) if classes else 3
    shared = samples.sparkSession.sparkContext.broadcast(found)
    rows = samples.select("tree", "at", "w", "c", "y", "x", "fs")
    keys = ["tree", "at", "j", "f"]
    sums = rows.mapInArrow(_sums(shared), "tree int, at int, j int, f int, bucket int, low double, s array<double>").groupBy(*keys, "bucket").agg(
        F.min("low").alias("low"), *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(k)])
    cells = cut_lineage(sums)
    whole = Window.partitionBy(*keys)
    order = whole.orderBy("bucket")
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    own = [F.when(F.col("bucket") >= 0, F.col(f"s{i}")) for i in range(k)]
    starts = cells.select(
        *keys, "bucket", "low", F.lead("low").over(order).alias("next"), F.array(*[F.col(f"s{i}") for i in range(k)]).alias("own"),
        F.array(*[F.coalesce(F.sum(s).over(below), F.lit(0.0)) for s in own]).alias("below"),
        F.array(*[F.sum(f"s{i}").over(whole) for i in range(k)]).alias("total")).where("bucket >= 0")

    def finish(packed: pa.Table, start: pa.Table) -> pa.Table:
        start = start.sort_by([("tree", "ascending"), ("at", "ascending")])
        tree, at = start["tree"].to_numpy(), start["at"].to_numpy()
        after = start["next"].to_numpy(zero_copy_only=False)
        low, total = trees.matrix(start["below"]), trees.matrix(start["total"])
        if len(packed):
            code = (_joined(packed["tree"], np.int32).astype(np.int64) << 32) | _joined(packed["at"], np.int32)
            node = np.searchsorted((tree.astype(np.int64) << 32) | at, code)
            v, w = _joined(packed["v"], np.float64), _joined(packed["w"], np.int32).astype(float)
            order = np.lexsort((v, node))
            node, v, w = node[order], v[order], w[order]
            if classes:
                stats = np.zeros((len(v), k))
                stats[np.arange(len(v)), _joined(packed["t"], np.int32)[order]] = w
            else:
                y = _joined(packed["t"], np.float64)[order]
                stats = np.stack([w, w * y, w * y * y], axis=1)
            left = np.cumsum(stats, axis=0)
            first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            before = np.vstack([np.zeros((1, k)), left])[first]
            left += np.repeat(low[node[first]] - before, np.diff(np.append(first, len(v))), axis=0)
            # The last of equal values in a node, and the value above it.
            same = node[1:] == node[:-1]
            last = np.append(~same | (v[1:] != v[:-1]), True)
            above = np.where(np.append(same, False), np.append(v[1:], np.nan), after[node])
            node, v, left, above = node[last], v[last], left[last], above[last]
        else:
            node, v, left, above = np.arange(len(tree)), start["low"].to_numpy(), low + trees.matrix(start["own"]), after
        nl, a, _ = trees._impurity(left, classes)
        nr, b, _ = trees._impurity(total[node] - left, classes)
        share = trees._share(a + b, total[node].sum(-1) if classes else total[node, 2])
        usable = np.flatnonzero((nl >= least) & (nr >= least) & (v < above))
        order = usable[np.lexsort((v[usable], share[usable], node[usable]))]
        best = order[np.flatnonzero(np.append(True, node[order][1:] != node[order][:-1]))] if len(order) else order
        below, above = v[best], above[best]
        with np.errstate(invalid="ignore", over="ignore"):
            middle = below + (above - below) / 2
        cut = np.where((middle >= below) & (middle < above), middle, below)
        n = len(best)
        of = node[best]
        return pa.table([
            pa.array(tree[of], pa.int32()), pa.array(at[of], pa.int32()), pa.array(start["j"].to_numpy()[of], pa.int32()),
            pa.array(start["f"].to_numpy()[of], pa.int32()), pa.array(below), pa.array(share[best]),
            pa.array(np.rint(nl[best]).astype(np.int64)), pa.array(np.rint(nr[best]).astype(np.int64)), pa.array(cut)],
            names=["tree", "at", "j", "f", "v", "share", "n_left", "n_right", "threshold"])

    packed = rows.mapInArrow(_packed(shared), "f int, bucket int, tree binary, at binary, v binary, w binary, t binary")
    each = packed.groupBy("f", "bucket").cogroup(starts.groupBy("f", "bucket")).applyInArrow(finish, _BEST)
    return each.groupBy("tree", "at").agg(F.min(F.struct("share", "j", "v", "f", "n_left", "n_right", "threshold")).alias("b")).select("tree", "at", "b.*")
