"""Whole trees and subtrees of bounded size, grown in one task.

A node that fits one task is grown to its leaves here, with numpy over its rows; larger
nodes are split level by level in ``forest``. Draws, ties and thresholds are the same
both ways.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.draws import int_fold, np_fold, np_pick, np_poisson, np_uniform, poisson_table

# Importance a split column needs, embedded sample share and depth,
# rows below which a node rates all columns alike.
ALPHA, SAMPLE_SHARE, LOOKAHEAD, UNIFORM_BELOW = 0.05, 0.85, 3, 10
QUARTILES = (0.25, 0.5, 0.75)
# Digits of a loss or gain, as a share of the node's squares, that decide between splits:
# sums differ in their last bits with the order of the rows.
DIGITS = 9
# Digits of a column's importance: its sums differ likewise.
RATED = 12
# What codes are folded with, by purpose.
TRIAL, PROBE, PICK, CUT = 7, 11, 3, 5
# Cells of the embedded trees' tests, and of the thresholds of plain trees, that are held at once.
CELLS, TESTS = 120_000, 400_000
TINY = 1e-300
# The largest node number whose children are numbered 2n and 2n + 1.
NUMBERED = (1 << 61) - 1

MUTED, RANDOM, EXACT = "muted", "random", "exact"
NODES = ("tree int, node bigint, left bigint, right bigint, depth int, n bigint, value double, loss double, fs array<int>, ws array<double>,"
         " threshold double, importance array<double>, piece bigint")
_ARROW = pa.schema([
    ("tree", pa.int32()), ("node", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("depth", pa.int32()), ("n", pa.int64()),
    ("value", pa.float64()), ("loss", pa.float64()), ("fs", pa.list_(pa.int32())), ("ws", pa.list_(pa.float64())), ("threshold", pa.float64()),
    ("importance", pa.list_(pa.float64())), ("piece", pa.int64())])


@dataclass(frozen=True)
class Rule:
    """How nodes are split.

    ``muted``: columns rated by embedded trees, the weak ones muted, quartile thresholds.
    ``random``: one uniform threshold for each of ``tried`` random columns.
    ``exact``: every threshold of ``tried`` random columns.
    A node is split from ``split_from`` rows on; either side keeps ``least`` rows.
    """

    kind: str
    classes: bool
    p: int
    split_from: int
    least: int
    seed: int
    trials: int = 100
    alpha: float = ALPHA
    tried: int | None = None
    max_depth: int | None = None
    centre: float = 0.0  # taken off the target before; leaf values get it back
    newton: int = 0  # classes of a boosting whose leaves are Newton steps; 0 for means


@dataclass
class Start:
    tree: int
    node: int
    code: int
    depth: int
    k: int
    rate: float
    active: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def protected_columns(p: int) -> int:
    return max(1, int(math.log(p)))


def children(node: int) -> tuple[int, int]:
    """Numbers of the two children: 2n and 2n + 1, or far down a code of the path."""
    if 0 < node <= NUMBERED:
        return 2 * node, 2 * node + 1
    digest = hashlib.md5(str(node).encode()).digest()
    first = int.from_bytes(digest[:8], "big") >> 2
    return -1 - 2 * (first >> 1), -2 - 2 * (first >> 1)


def _impurity(s: np.ndarray, classes: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight, n times impurity and sum of squares of statistics in the last axis."""
    if classes:
        w = s.sum(-1)
        sub, squares = (s * s).sum(-1), w
    else:
        w, sub, squares = s[..., 0], s[..., 1] * s[..., 1], s[..., 2]
    inside = squares - np.divide(sub, w, out=np.zeros_like(w), where=w > 0)
    return w, np.where(w > 0, np.maximum(inside, 0.0), 0.0), squares


def _share(value: np.ndarray, squares: np.ndarray) -> np.ndarray:
    return np.round(np.divide(value, squares, out=np.zeros_like(value), where=squares > 0), DIGITS)


def rate_columns(x, stats, codes, code, active, lo, hi, trials, classes, table) -> np.ndarray | None:
    """Mean share of the impurity drop of each column over random depth-3 trees; None if none splits.

    ``x`` is (columns, rows), ``stats`` (rows, sums). Each embedded tree samples the rows and
    each of its nodes tries the root of the active columns, at one uniform threshold each.
    """
    p, n = x.shape
    m = max(1, math.isqrt(len(active)))
    kind = np.float32 if classes else np.float64  # counts are exact in either
    copies = np_poisson(np_fold(codes, code)[None, :], np_fold(int_fold(code, TRIAL), np.arange(trials))[:, None], table)
    probes = [probes_of(code, depth, trials, active, lo, hi) for depth in range(LOOKAHEAD)]
    # The sums whose squares a gain is made of, and the weights if they are not the sum of those.
    stats = stats.astype(kind)
    sums = stats if classes else np.ascontiguousarray(stats[:, :2])
    drops = np.zeros((trials, p))
    step = max(1, CELLS // (n * m << (LOOKAHEAD - 1)))
    for start in range(0, trials, step):
        drawn = copies[start:start + step]
        size = len(drawn)
        here = np.ones((size, 1, n), bool)
        for depth, (f, cut) in enumerate(probes):
            f, cut, places = f[start:start + step], cut[start:start + step], 1 << depth
            left = np.take(x, f.ravel(), axis=0) <= cut.reshape(-1, 1)
            left = left.reshape(size, places, m, n)
            if depth:
                left &= here[:, :, None, :]
            # One matrix product over all tests: how often a row was drawn is part of the test.
            on_left = ((left.view(np.int8) * drawn[:, None, None, :]).reshape(-1, n).astype(kind) @ sums).reshape(size, places, m, -1).astype(float)
            whole = ((here.view(np.int8) * drawn[:, None, :]).reshape(-1, n).astype(kind) @ stats).reshape(size, places, -1).astype(float)
            squares = whole.sum(-1) if classes else whole[:, :, 2]
            nl, a = _gain(on_left, classes)
            nr, b = _gain(whole[:, :, None, : on_left.shape[-1]] - on_left, classes)
            _, c = _gain(whole, classes)
            drop = a + b - c[:, :, None]
            share = np.round(drop / np.maximum(squares, TINY)[:, :, None], DIGITS)
            share[(nl <= 0) | (nr <= 0)] = -np.inf
            won = share.argmax(-1)
            e, q = np.nonzero(share.max(-1) > -np.inf)
            best = won[e, q]
            np.add.at(drops, (start + e, f[e, q, best]), np.maximum(drop[e, q, best], 0.0))
            if depth < LOOKAHEAD - 1:
                chosen, open_ = left[e, q, best], here[e, q]
                here = np.zeros((size, 2 * places, n), bool)
                here[e, 2 * q] = chosen
                here[e, 2 * q + 1] = open_ & ~chosen
    total = drops.sum(axis=1)
    some = total > 0
    if not some.any():
        return None
    value = (drops[some] / total[some][:, None]).sum(axis=0)
    return np.round(value / value.sum(), RATED)


def probes_of(code, depth, trials, active, lo, hi) -> tuple[np.ndarray, np.ndarray]:
    """(trials, places, tests): the columns and thresholds that the embedded nodes of one depth try."""
    m = max(1, math.isqrt(len(active)))
    base = np_fold(np_fold(int_fold(code, PROBE + depth), np.arange(trials))[:, None], np.arange(1 << depth)[None, :])
    drawn = np_fold(base[:, :, None], np.arange(2 * m))  # a column and a threshold in turn
    f = active[np_pick(drawn[:, :, 0::2], len(active))]
    return f, lo[f] + np_uniform(drawn[:, :, 1::2]) * (hi[f] - lo[f])


def probe_sums(x, stats, codes, code, probes, splits, trials, table) -> tuple[np.ndarray, np.ndarray]:
    """Sums of some rows of a node in the embedded nodes of one depth, and of those left of each test.

    ``splits`` has the columns (-1: none) and thresholds of the embedded nodes above, by depth.
    """
    n, (f, cut) = x.shape[1], probes
    _, places, m = f.shape
    copies = np_poisson(np_fold(codes, code)[None, :], np_fold(int_fold(code, TRIAL), np.arange(trials))[:, None], table)
    whole, on_left = np.empty((trials, places, stats.shape[1])), np.empty((trials, places, m, stats.shape[1]))
    step = max(1, CELLS // (n * m * places))
    every = np.arange(n)[None, :]
    for start in range(0, trials, step):
        drawn = copies[start:start + step]
        size = len(drawn)
        e, q = np.arange(size)[:, None], np.zeros((size, n), np.int64)
        for column, threshold in splits:
            g = column[start:start + step][e, q]
            below = x[g, every] <= threshold[start:start + step][e, q]
            # A leaf of the embedded tree has no place; its rows count as not drawn.
            drawn = np.where(g >= 0, drawn, 0)
            q = 2 * q + ~below
        here = q[:, None, :] == np.arange(places)[None, :, None]
        left = (np.take(x, f[start:start + step].ravel(), axis=0) <= cut[start:start + step].reshape(-1, 1)).reshape(size, places, m, n)
        left &= here[:, :, None, :]
        on_left[start:start + step] = ((left * drawn[:, None, None, :]).reshape(-1, n).astype(float) @ stats).reshape(size, places, m, -1)
        whole[start:start + step] = ((here * drawn[:, None, :]).reshape(-1, n).astype(float) @ stats).reshape(size, places, -1)
    return whole, on_left


def _gain(s: np.ndarray, classes: bool) -> tuple[np.ndarray, np.ndarray]:
    """Weight, and squared sums over it: what a side takes off the node's squares."""
    if classes:
        w = s.sum(-1)
        return w, (s * s).sum(-1) / np.maximum(w, TINY)
    w, wy = s[..., 0], s[..., 1]
    return w, wy * wy / np.maximum(w, TINY)


def muted(active: np.ndarray, importance: np.ndarray, rate: float, p: int) -> np.ndarray:
    weakest = np.lexsort((np.arange(p), importance))[: max(1, math.floor(p * rate))]
    inside = np.zeros(p, bool)
    inside[active] = True
    removable = [i for i in weakest if i >= protected_columns(p) and inside[i]]
    gone = removable[: max(len(active) - max(2, p // 3), 0)]
    return active[~np.isin(active, gone)] if gone else active


def options(active: np.ndarray, importance: np.ndarray, k: int, alpha: float) -> list[tuple[list[int], list[float]]]:
    """The k strongest columns one by one, then their weighted sum if there are several."""
    strong = active[importance[active] >= alpha]
    pool = strong if len(strong) else active
    top = pool[np.lexsort((pool, -importance[pool]))][:k]
    found = [([int(f)], [1.0]) for f in top]
    total = 0.0
    for f in top:
        total += float(importance[f])
    if len(top) > 1 and total > 0:
        found.append(([int(f) for f in top], [float(importance[f]) / total for f in top]))
    return found


def combined(x: np.ndarray, fs: list[int], ws: list[float], rows) -> np.ndarray:
    v = ws[0] * x[fs[0], rows]
    for f, w in zip(fs[1:], ws[1:], strict=True):
        v = v + w * x[f, rows]
    return v


def quartiles(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Interpolated quartiles of values repeated ``w`` times; NaN is left out."""
    order = np.argsort(v, kind="stable")
    v, w = v[order], w[order]
    end = np.cumsum(np.where(np.isnan(v), 0, w))
    total = end[-1] if len(end) else 0
    if not total:
        return np.zeros(0)
    h = (total - 1) * np.array(QUARTILES)
    low, high = (v[np.searchsorted(end, r(h), side="right")] for r in (np.floor, np.ceil))
    same = (low == high) | (np.floor(h) == np.ceil(h))
    return np.where(same, low, (np.ceil(h) - h) * low + (h - np.floor(h)) * high)


class Grower:
    """Grows trees over one set of rows, which has the same order wherever it is grown."""

    def __init__(self, rule: Rule, x: np.ndarray, c: np.ndarray, y: np.ndarray, codes: np.ndarray):
        self.rule, self.x, self.codes = rule, x, codes
        self.y = y
        self.labels, self.code = np.unique(c, return_inverse=True)
        self.table = poisson_table(SAMPLE_SHARE)

    def _stats(self, rows: np.ndarray, w: np.ndarray) -> np.ndarray:
        if self.rule.classes:
            out = np.zeros((len(rows), len(self.labels)))
            out[np.arange(len(rows)), self.code[rows]] = w
            return out
        y = self.y[rows]
        return np.stack([w, w * y, w * y * y], axis=1)

    def table_of(self, start: Start, weights: np.ndarray) -> pa.Table:
        """The node table of one tree, parents before children; its piece is named after its first node."""
        if self.rule.kind == MUTED:
            found = node_table(self.grow(start, weights))
        else:
            found = self._plain(start, weights)
        return found.append_column(_ARROW.field("piece"), pa.array(np.full(len(found), start.node), pa.int64()))

    def grow(self, start: Start, weights: np.ndarray) -> Iterator[tuple]:
        """Rows of the node table of a muted tree, parents before children."""
        rule = self.rule
        waiting = [(start.node, start.code, start.depth, np.flatnonzero(weights > 0), start.active, start.lo, start.hi)]
        while waiting:
            node, code, depth, rows, active, lo, hi = waiting.pop()
            w = weights[rows].astype(float)
            stats = self._stats(rows, w)
            total = stats.sum(axis=0)
            n = total.sum() if rule.classes else total[0]
            value, loss = self._value(rows, w, total), float(_impurity(total, rule.classes)[1])
            importance, best = None, None
            if n >= rule.split_from and (rule.max_depth is None or depth < rule.max_depth):
                importance = self.importance(rows, stats, n, code, active, lo, hi)
                active = muted(active, importance, start.rate, rule.p)
                best = self._quartile_split(rows, w, stats, total, options(active, importance, start.k, rule.alpha))
            shown = importance.tolist() if importance is not None and depth == 0 else None
            if best is None:
                yield start.tree, node, None, None, depth, int(n), value, loss, None, None, None, shown
                continue
            fs, ws, threshold, left = best
            a, b = children(node)
            yield start.tree, node, a, b, depth, int(n), value, loss, fs, ws, float(threshold), shown
            low, high = lo, hi
            if len(fs) == 1:
                low, high = lo.copy(), hi.copy()
                low[fs[0]] = high[fs[0]] = threshold
            waiting.append((b, int_fold(code, 2), depth + 1, rows[~left], active, low, hi))
            waiting.append((a, int_fold(code, 1), depth + 1, rows[left], active, lo, high))

    def _value(self, rows, w, total) -> float:
        if self.rule.classes:
            return float(self.labels[int(total.argmax())])
        return float(total[1] / total[0] + self.rule.centre)

    def importance(self, rows, stats, n, code, active, lo, hi) -> np.ndarray:
        p = self.rule.p
        if n < UNIFORM_BELOW:
            return np.full(p, 1.0 / p)
        found = rate_columns(
            np.ascontiguousarray(self.x[:, rows]), stats, self.codes[rows], code, active, lo, hi, self.rule.trials, self.rule.classes, self.table)
        return np.zeros(p) if found is None else found

    def _losses(self, left: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weight left and right, and the rounded loss, of statistics of left sides."""
        nl, a, _ = _impurity(left, self.rule.classes)
        nr, b, _ = _impurity(total - left, self.rule.classes)
        squares = total.sum(-1) if self.rule.classes else total[..., 2]
        return nl, nr, _share(a + b, np.broadcast_to(squares, a.shape))

    def _quartile_split(self, rows, w, stats, total, found):
        masks, made = [], []
        for fs, ws in found:
            v = combined(self.x, fs, ws, rows)
            for t in quartiles(v, w):
                masks.append(v <= t)
                made.append((fs, ws, t))
        if not made:
            return None
        masks = np.stack(masks)
        nl, nr, loss = self._losses(masks.astype(float) @ stats, total)
        # Either side needs two rows to be tried, and the smallest size to be kept.
        loss = np.where((nl >= 2) & (nr >= 2), loss, np.inf)
        i = int(loss.argmin())
        if not np.isfinite(loss[i]) or min(nl[i], nr[i]) < self.rule.least:
            return None
        return *made[i], masks[i]

    # --- plain trees: all nodes of a level at once ---

    def _plain(self, start: Start, weights: np.ndarray) -> pa.Table:
        """The nodes of a random or exact tree, level by level.

        The rows of a level's nodes lie one node after the other, in their first order. Nodes of
        similar size are split together, as matrices with a row per node.
        """
        rule = self.rule
        rows = np.flatnonzero(weights > 0)
        first, number, code, depth = np.zeros(1, int), np.array([start.node]), np.array([start.code]), start.depth
        levels = []
        while len(number):
            w = weights[rows].astype(float)
            stats = self._stats(rows, w)
            size = np.diff(np.append(first, len(rows)))
            total = np.add.reduceat(stats, first, axis=0) if len(rows) else np.zeros((len(number), stats.shape[1]))
            n, loss, _ = _impurity(total, rule.classes)
            value = self._values(rows, w, total, first)
            k = len(number)
            f, cut, kept = np.zeros(k, int), np.full(k, np.nan), np.zeros(k, bool)
            left = np.zeros(len(rows), bool)
            if rule.max_depth is None or depth < rule.max_depth:
                open_ = np.flatnonzero((n >= rule.split_from) & ~self._pure(rows, first))
                for nodes in _similar(open_, size):
                    self._split_nodes(nodes, rows, stats, total, first, size, code, f, cut, kept, left)
            a, b = _child_numbers(number[kept])
            down = [np.zeros(k, np.int64), np.zeros(k, np.int64)]
            down[0][kept], down[1][kept] = a, b
            levels.append((number, down[0], down[1], np.full(k, depth), n, value, loss, f, cut, kept))
            # The children, left and right in turn; rows of a node keep their order.
            place = np.repeat(np.arange(k), size)
            live = np.flatnonzero(kept[place])
            side = 2 * (np.cumsum(kept) - 1)[place[live]] + ~left[live]
            rows = rows[live[np.argsort(side, kind="stable")]]
            number = np.stack([a, b], axis=1).ravel()
            code = np.stack([np_fold(code[kept], 1), np_fold(code[kept], 2)], axis=1).ravel()
            first = np.searchsorted(np.sort(side), np.arange(len(number)))
            depth += 1
        return self._listed(start.tree, levels)

    def _listed(self, tree: int, levels: list[tuple]) -> pa.Table:
        number, left, right, depth, n, value, loss, f, cut, kept = (np.concatenate(c) for c in zip(*levels, strict=True))
        size, ends = len(number), np.append(0, np.cumsum(kept)).astype(np.int32)
        offsets = pa.array(ends, pa.int32(), mask=np.append(~kept, False))
        columns = [
            pa.array(np.full(size, tree), pa.int32()), pa.array(number, pa.int64()), pa.array(left, pa.int64(), mask=~kept), pa.array(right, pa.int64(), mask=~kept),
            pa.array(depth, pa.int32()), pa.array(n.astype(np.int64)), pa.array(value), pa.array(loss),
            pa.ListArray.from_arrays(offsets, pa.array(f[kept], pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(np.ones(int(kept.sum())))),
            pa.array(cut, mask=~kept), pa.nulls(size, pa.list_(pa.float64()))]
        return pa.table(columns, schema=pa.schema(list(_ARROW)[:-1]))

    def _values(self, rows, w, total, first) -> np.ndarray:
        rule = self.rule
        if rule.classes:
            return self.labels[total.argmax(axis=1)].astype(float)
        if rule.newton:
            r = np.abs(self.y[rows])
            curve = np.add.reduceat(w * r * (1 - r), first) if len(rows) else np.zeros(len(first))
            step = np.divide(total[:, 1], curve, out=np.zeros_like(curve), where=curve > 1e-150)
            return step * (rule.newton - 1) / rule.newton
        return np.divide(total[:, 1], total[:, 0], out=np.full(len(total), np.nan), where=total[:, 0] > 0) + rule.centre

    def _pure(self, rows, first) -> np.ndarray:
        if not len(rows):
            return np.ones(len(first), bool)
        part = self.code[rows] if self.rule.classes else self.y[rows]
        return np.minimum.reduceat(part, first) == np.maximum.reduceat(part, first)

    def _picks(self, code: np.ndarray) -> np.ndarray:
        """(nodes, tried): the columns that each node tries, in order."""
        u = np_fold(np_fold(code, PICK)[:, None], np.arange(self.rule.p)[None, :])
        return np.argsort(u, axis=1, kind="stable")[:, : self.rule.tried]

    def _split_nodes(self, nodes, rows, stats, total, first, size, code, f, cut, kept, left) -> None:
        """Split ``nodes``, of similar size; notes columns, thresholds and the rows that go left."""
        rule, width = self.rule, int(size[nodes].max())
        at = first[nodes][:, None] + np.arange(width)[None, :]
        real = np.arange(width)[None, :] < size[nodes][:, None]
        at = np.where(real, at, first[nodes][:, None])
        own = np.where(real[:, :, None], stats[at], 0.0)
        picks = self._picks(code[nodes])
        best, column, threshold = np.full(len(nodes), np.inf), np.zeros(len(nodes), int), np.zeros(len(nodes))
        # Columns in the order in which they are tried: a later one has to be better.
        each = max(1, TESTS // at.size)
        for start in range(0, picks.shape[1], each):
            fs = picks[:, start:start + each]
            x = np.where(real[:, None, :], self.x[fs[:, :, None], rows[at][:, None, :]], np.nan)
            share, j, t = (self._random_cuts if rule.kind == RANDOM else self._exact_cuts)(x, own, total[nodes], code[nodes], fs)
            better = share < best
            best[better], column[better], threshold[better] = share[better], fs[np.arange(len(nodes)), j][better], t[better]
        found = np.isfinite(best)
        f[nodes[found]], cut[nodes[found]], kept[nodes[found]] = column[found], threshold[found], True
        goes = (self.x[column[:, None], rows[at]] <= threshold[:, None]) & real & found[:, None]
        left[at[goes]] = True

    def _random_cuts(self, x, own, total, code, fs):
        """Per node the loss, place and threshold of its best column of ``fs``, each cut once."""
        # A column that holds only NaN has no range; its comparisons are all false.
        with np.errstate(invalid="ignore"):
            low, high = np.fmin.reduce(x, axis=2), np.fmax.reduce(x, axis=2)
        t = low + np_uniform(np_fold(np_fold(code, CUT)[:, None], fs)) * (high - low)
        nl, nr, loss = self._losses((x <= t[:, :, None]).astype(float) @ own, np.broadcast_to(total[:, None, :], (*fs.shape, total.shape[1])))
        loss = np.where((nl >= self.rule.least) & (nr >= self.rule.least), loss, np.inf)
        j, every = loss.argmin(axis=1), np.arange(len(fs))
        return loss[every, j], j, t[every, j]

    def _exact_cuts(self, x, own, total, code, fs):
        """The same over every threshold between neighbouring values."""
        every = np.arange(len(fs))
        if x.shape[2] < 2:
            return np.full(len(fs), np.inf), np.zeros(len(fs), int), np.zeros(len(fs))
        order = np.argsort(x, axis=2, kind="stable")
        v = np.take_along_axis(x, order, axis=2)
        left = np.cumsum(own[every[:, None, None], order], axis=2)[:, :, :-1]
        nl, nr, loss = self._losses(left, np.broadcast_to(total[:, None, None, :], left.shape))
        usable = (v[:, :, :-1] < v[:, :, 1:]) & (nl >= self.rule.least) & (nr >= self.rule.least)
        loss = np.where(usable, loss, np.inf).reshape(len(fs), -1)
        j, i = np.divmod(loss.argmin(axis=1), x.shape[2] - 1)
        below, above = v[every, j, i], v[every, j, i + 1]
        with np.errstate(invalid="ignore", over="ignore"):
            middle = below + (above - below) / 2
        return loss.min(axis=1), j, np.where((middle >= below) & (middle < above), middle, below)


def _similar(nodes: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """``nodes`` in lists of similar size that hold a bounded number of rows."""
    kind = np.ceil(np.log2(np.maximum(size[nodes], 1))).astype(int)
    for k in np.unique(kind):
        part = nodes[kind == k]
        step = max(1, TESTS >> int(k) >> 2)
        for start in range(0, len(part), step):
            yield part[start:start + step]


def _child_numbers(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = (number > 0) & (number <= NUMBERED)
    a = np.where(near, number, 0) * 2
    b = a + 1
    for i in np.flatnonzero(~near):
        a[i], b[i] = children(int(number[i]))
    return a, b


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of one length as (rows, items); null items are NaN."""
    flat = column.combine_chunks()
    n = len(flat)
    values = pc.cast(flat.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    return values.reshape(n, -1) if n else np.zeros((0, 0))


def grower(rule: Rule, rows: pa.Table) -> tuple[Grower, pa.Table]:
    # One order wherever the rows come from: sums and samples follow it.
    rows = rows.sort_by([(name, "ascending") for name in ("row_id", "c", "y")])
    x = np.ascontiguousarray(matrix(rows["x"]).T)
    return Grower(rule, x, rows["c"].to_numpy(), rows["y"].to_numpy(), rows["code"].to_numpy()), rows


def node_table(found: Iterator[tuple]) -> pa.Table:
    schema = pa.schema(list(_ARROW)[:-1])
    columns = list(zip(*found, strict=True)) or [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
