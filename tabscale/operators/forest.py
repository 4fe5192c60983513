"""Muted forest: trees that drop weak columns as they grow.

Per node a small embedded forest of random depth-3 trees rates the active columns, the
weakest are muted, and the best of the quartile splits of the top columns (or of their
weighted sum) is taken. Extremely randomised trees and trees that try every threshold
are grown the same way.

Nodes of at most ``GATHER`` rows are grown to their leaves in one task, with the rows
of that node only (``trees``). Larger nodes are split level by level, all trees
together: a row is stored once, with one slot (weight, node) per tree, and never moves
while levels are small; every pass explodes the slots in flight and aggregates before
it shuffles. Both ways give the same nodes.

Tables:
* rows    (row_id, x array<double>, c int class or 0, y double)
* state   rows + a code for draws + the arrays w and at with one slot per tree
* level   one row per node of a level, keyed by (tree, at); ``at`` numbers the
          nodes of a tree within the level
* nodes   one row per node of the forest, keyed by (tree, node), with the numbers of
          its children
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.draws import fold, int_fold, pick, poisson, poisson_table, row_code, text_code, uniform
from ..functions.quantiles import grouped_quantiles
from ..functions.rand import poisson_weights
from ..session import cut_lineage, ready_workers
from . import cuts, scoring, trees
from .profile import CLASSIFICATION, REGRESSION, correlations
from .resample import exact_bootstrap
from .trees import ALPHA, DIGITS, EXACT, LOOKAHEAD, MUTED, QUARTILES, RANDOM, SAMPLE_SHARE, UNIFORM_BELOW, Rule, protected_columns

# Fixed value: predicted levels at most.
MAX_LEVELS = 50

# Nodes of one level that may be broadcast, and their bytes; wider levels are joined by shuffle.
NODE_LIMIT, NODE_BYTES = 100_000, 64 * 1024 * 1024
# Rows (of rated trees), and bytes of their columns, up to which a node is grown to its leaves in one task.
GATHER, GATHER_BYTES = 20_000, 64 * 1024 * 1024

# Rows of a node that are rated at once by a pass.
PROBED_ROWS = 10_000

# The nine configurations (columns per combination, muting rate).
GRID = [(k, rate) for k in (1, 2, 5) for rate in (0.0, 0.5, 0.8)]


@dataclass
class Forest:
    task: str
    n_features: int
    trees: list[tuple[int, float]]  # (k, muting rate) of each tree
    table: DataFrame  # the nodes
    most: int  # columns of a split at most

    def nodes(self) -> DataFrame:
        """All nodes of all trees."""
        return self.table.select("tree", "node", "left", "right", "depth", "n", "value", "loss", "fs", "ws", "threshold")

    @property
    def importances(self) -> DataFrame:
        """(tree, feature, importance) at the roots."""
        return self.table.where("depth = 0").select("tree", F.posexplode("importance").alias("feature", "importance"))


def config_name(k: int, rate: float, prefix: str = "MF") -> str:
    return f"{prefix}_k{k}_mute{round(rate * 100)}"


def smallest_node(n_rows: int) -> int:
    return max(2, int(n_rows ** (1 / 3)))


def to_rows(df: DataFrame, key: str, features: list[str], target: str | None, task: str) -> DataFrame:
    """The row table of the grower; class targets must be whole numbers."""
    x = F.array(*[col(f).cast("double") for f in features]).alias("x")
    if target is None:
        return df.select(col(key).alias("row_id"), x)
    if task == CLASSIFICATION:
        return df.select(col(key).alias("row_id"), x, col(target).cast("int").alias("c"), F.lit(1.0).alias("y"))
    return df.select(col(key).alias("row_id"), x, F.lit(0).alias("c"), col(target).cast("double").alias("y"))


# --- building blocks -------------------------------------------------------------------


def combine(x: Column, fs: Column, ws: Column, most: int) -> Column:
    """Weighted sum of the at most ``most`` columns ``fs`` of ``x``; one column has weight 1."""
    total = F.get(ws, F.lit(0)) * F.get(x, F.get(fs, F.lit(0)))
    for i in range(1, most):
        total = total + F.coalesce(F.get(ws, F.lit(i)) * F.get(x, F.get(fs, F.lit(i))), F.lit(0.0))
    return total


def impurity(w: Column, wy_squares: Column, wyy: Column) -> Column:
    """n times variance, or n times Gini with a class as the indicator 1.

    Over classes c: sum(wyy_c) - sum(wy_c^2) / n. One class gives the sum of
    squared deviations, indicators give n - sum(n_c^2) / n.
    """
    return F.greatest(F.sum(wyy) - F.try_divide(F.sum(wy_squares), F.sum(w)), F.lit(0.0))


def leaf_values(samples: DataFrame, keys: list[str], task: str) -> DataFrame:
    """(keys, n, value): weighted mean, or most frequent class (smallest on a tie)."""
    by_class = samples.groupBy(*keys, "c").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"))
    if task == CLASSIFICATION:
        best = F.min(F.struct((-F.col("w")).alias("m"), "c")).alias("b")
        return by_class.groupBy(*keys).agg(F.sum("w").alias("n"), best).select(*keys, "n", F.col("b.c").cast("double").alias("value"))
    return by_class.groupBy(*keys).agg(F.sum("w").alias("n"), F.sum("wy").alias("wy")).select(
        *keys, "n", (F.col("wy") / F.col("n")).alias("value"))


def mute(active: Column, importance: Column, rate: Column, p: int) -> Column:
    """The active columns left after muting the weakest.

    The first ln(p) columns are protected; at least a third of all columns (and
    two) stay. Columns muted earlier still use up the quota.
    """
    quota = F.greatest(F.lit(1), F.floor(F.lit(p) * rate).cast("int"))
    rated = F.array_sort(F.transform(importance, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    weakest = F.transform(F.slice(rated, F.lit(1), quota), lambda s: s["i"])
    removable = F.filter(weakest, lambda i: (i >= protected_columns(p)) & F.array_contains(active, i))
    spare = F.greatest(F.size(active) - max(2, p // 3), F.lit(0))
    return F.array_except(active, F.slice(removable, F.lit(1), spare))


def candidates(active: Column, importance: Column, k: Column, alpha: float = ALPHA) -> Column:
    """Top ``k`` active columns as (f, v): those rated at least ``alpha``, or all if none is."""
    rated = F.transform(active, lambda i: F.struct((-F.get(importance, i)).alias("m"), i.alias("f")))
    strong = F.filter(rated, lambda s: s["m"] <= -alpha)
    pool = F.array_sort(F.when(F.size(strong) > 0, strong).otherwise(rated))
    return F.transform(F.slice(pool, F.lit(1), k), lambda s: F.struct(s["f"].alias("f"), (-s["m"]).alias("v")))


def split_options(chosen: Column) -> Column:
    """Single columns in order, then their weighted sum if there are several."""
    singles = F.transform(chosen, lambda s, j: F.struct(
        j.alias("j"), F.array(s["f"]).alias("fs"), F.array(F.lit(1.0)).alias("ws")))
    total = F.aggregate(chosen, F.lit(0.0), lambda a, s: a + s["v"])
    both = F.struct(
        F.size(chosen).alias("j"),
        F.transform(chosen, lambda s: s["f"]).alias("fs"),
        F.transform(chosen, lambda s: s["v"] / total).alias("ws"))
    return F.when((F.size(chosen) > 1) & (total > 0), F.concat(singles, F.array(both))).otherwise(singles)


def node_thresholds(samples: DataFrame, options: DataFrame, small: bool, most: int, rows: int | None = None) -> DataFrame:
    """(tree, at, j, fs, ws, thresholds): exact weighted quartiles of each option within its node.

    ``rows`` bounds the rows of all options, if it is known.
    """
    values = _attach(samples, options, small).select("tree", "at", "w", "x", F.inline("options"))
    values = values.select("tree", "at", "j", "w", combine(F.col("x"), F.col("fs"), F.col("ws"), most).alias("v"))
    found = grouped_quantiles(values, ["tree", "at", "j"], "v", QUARTILES, "w", rows).withColumnRenamed("q", "thresholds")
    return options.select("tree", "at", F.inline("options")).join(found, ["tree", "at", "j"])


def loss_share(loss: Column, squares: Column) -> Column:
    """The loss as a share of the node's squares, in so many digits that the order of the rows cannot decide."""
    return F.round(F.when(squares > 0, loss / squares).otherwise(F.lit(0.0)), DIGITS)


def best_splits(samples: DataFrame, thresholds: DataFrame, small: bool, most: int, least: int = 2) -> DataFrame:
    """(tree, at, fs, ws, threshold, n_left, n_right, score) of the best option and threshold.

    Either side needs ``least`` rows. The first option and lowest threshold win a tie.
    """
    per_node = thresholds.groupBy("tree", "at").agg(
        F.collect_list(F.struct("j", "fs", "ws", "thresholds")).alias("options"))
    rows = _attach(samples, per_node, small).select("tree", "at", "w", "c", "y", "x", F.inline("options"))
    v = combine(F.col("x"), F.col("fs"), F.col("ws"), most)
    rows = rows.select("tree", "at", "j", "c", "w", "y", v.alias("v"), F.posexplode("thresholds").alias("t", "threshold"))
    left = F.when(F.col("v") <= F.col("threshold"), F.col("w")).otherwise(0)
    w, y = F.col("w"), F.col("y")
    by_class = rows.groupBy("tree", "at", "j", "t", "c").agg(
        F.sum(w).alias("w"), F.sum(w * y).alias("wy"), F.sum(w * y * y).alias("wyy"),
        F.sum(left).alias("lw"), F.sum(left * y).alias("lwy"), F.sum(left * y * y).alias("lwyy"))
    right = {n: F.col(n) - F.col("l" + n) for n in ("w", "wy", "wyy")}
    scored = by_class.groupBy("tree", "at", "j", "t").agg(
        F.sum("lw").alias("n_left"), F.sum(right["w"]).alias("n_right"),
        (impurity(F.col("lw"), F.col("lwy") ** 2, F.col("lwyy"))
         + impurity(right["w"], right["wy"] ** 2, right["wyy"])).alias("loss"), F.sum("wyy").alias("squares"))
    valid = scored.where((F.col("n_left") >= least) & (F.col("n_right") >= least))
    order = F.struct(loss_share(F.col("loss"), F.col("squares")).alias("share"), "j", "t", "loss", "n_left", "n_right")
    best = valid.groupBy("tree", "at").agg(F.min(order).alias("b"))
    best = best.select("tree", "at", "b.*").withColumn("score", -F.col("loss"))
    return best.join(thresholds, ["tree", "at", "j"]).select(
        "tree", "at", "fs", "ws", F.get("thresholds", F.col("t")).alias("threshold"), "n_left", "n_right", "score")


# --- importance by embedded random trees ----------------------------------------------------


def _at_position(q: Column):
    return lambda split: split["q"] == q


def node_importance(samples: DataFrame, nodes: DataFrame, p: int, trials: int, small: bool) -> DataFrame:
    """(tree, at, importance array): mean impurity drop shares over random depth-3 trees.

    ``nodes`` brings (tree, at, code, active, lo, hi). Each embedded tree samples the rows, each of
    its nodes tries the square root of the active columns, each at one uniform threshold. The
    passes draw as ``trees.rate_columns`` does for nodes that fit one task. Nodes that are few
    travel to the rows, and each task adds up its rows; others are joined by shuffle.
    """
    m = F.greatest(F.lit(1), F.floor(F.sqrt(F.size("active"))).cast("int"))
    trial = nodes.select("tree", "at", "code", "active", "lo", "hi", m.alias("m"), F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("e"))
    if small:
        known = nodes.select("tree", "at", "code", "active", "lo", "hi").toArrow().to_pylist()
        splits: list[dict] = []
    else:
        seen = _attach(samples, nodes.select("tree", "at", F.col("code").alias("node_code")), small).withColumn("seen", fold(F.col("code"), F.col("node_code")))
        sample = seen.select("*", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("e"))
        drawn = fold(fold(F.col("node_code"), trees.TRIAL), F.col("e"))
        sample = sample.withColumn("w", F.col("w") * poisson(F.col("seen"), drawn, SAMPLE_SHARE)).where("w > 0").drop("code", "node_code", "seen")
    drops = None
    paths: list[str] = []
    for depth in range(LOOKAHEAD):
        if small:
            by_class = _probed(samples, known, splits, trials, depth)
        else:
            by_class = _probed_by_shuffle(sample, trial, paths, depth)
        right = {n: F.col(n) - F.col("l" + n) for n in ("w", "wy", "wyy")}
        tried = by_class.groupBy("tree", "at", "e", "q", "j", "f", "t").agg(
            F.sum("lw").alias("nl"), F.sum(right["w"]).alias("nr"),
            (impurity(F.col("w"), F.col("wy") ** 2, F.col("wyy"))
             - impurity(F.col("lw"), F.col("lwy") ** 2, F.col("lwyy"))
             - impurity(right["w"], right["wy"] ** 2, right["wyy"])).alias("drop"), F.sum("wyy").alias("squares"))
        won = tried.where("nl > 0 AND nr > 0").groupBy("tree", "at", "e", "q").agg(
            F.max(F.struct(loss_share(F.col("drop"), F.col("squares")).alias("share"), (-F.col("j")).alias("j"), "drop", "f", "t")).alias("b"))
        # Small (one row per embedded node) and read by all that follows.
        won = cut_lineage(won.select(
            "tree", "at", "e", "q", F.greatest("b.drop", F.lit(0.0)).alias("drop"), F.col("b.f").alias("f"), F.col("b.t").alias("t")))
        part = won.select("tree", "at", "e", "f", "drop")
        drops = part if drops is None else drops.unionByName(part)
        if depth < LOOKAHEAD - 1 and small:
            splits.append(_won_splits(won, trials, depth))
        elif depth < LOOKAHEAD - 1:
            path = f"path{depth}"
            found = won.groupBy("tree", "at", "e").agg(F.collect_list(F.struct("q", "f", "t")).alias(path))
            trial = trial.join(found, ["tree", "at", "e"])
            paths.append(path)
    per_column = drops.groupBy("tree", "at", "e", "f").agg(F.sum("drop").alias("drop"))
    shares = per_column.groupBy("tree", "at", "e").agg(
        F.sum("drop").alias("total"), F.collect_list(F.struct("f", "drop")).alias("parts")
    ).where("total > 0").select("tree", "at", "total", F.inline("parts"))
    rated = shares.groupBy("tree", "at", "f").agg(F.sum(F.col("drop") / F.col("total")).alias("v"))
    listed = rated.groupBy("tree", "at").agg(F.collect_list(F.struct("f", "v")).alias("l"), F.sum("v").alias("s"))
    importance = F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: F.coalesce(
        F.round(F.get(F.filter(F.col("l"), lambda s: s["f"] == i), F.lit(0))["v"] / F.col("s"), trees.RATED), F.lit(0.0)))
    return listed.select("tree", "at", importance.alias("importance"))


SUMS = ("w", "wy", "wyy", "lw", "lwy", "lwyy")


def _probed_by_shuffle(sample: DataFrame, trial: DataFrame, paths: list[str], depth: int) -> DataFrame:
    """The sums of ``_probed`` where the nodes are many."""

    def probe(q, j):
        base = fold(fold(fold(F.col("code"), trees.PROBE + depth), F.col("e")), q)
        f = F.get("active", pick(fold(base, 2 * j), F.size("active")))
        lo, hi = F.get("lo", f), F.get("hi", f)
        return F.struct(j.alias("j"), f.alias("f"), (lo + uniform(fold(base, 2 * j + 1)) * (hi - lo)).alias("t"))

    probes = F.transform(
        F.sequence(F.lit(0), F.lit(2**depth - 1)),
        lambda q: F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: probe(q, j)))
    table = trial.select("tree", "at", "e", *paths, probes.alias("probes"))
    rows = _attach(sample, table, False, ["tree", "at", "e"])
    q = F.lit(0)
    for path in paths:
        # The embedded split of the row's position so far; none means the position is a leaf.
        hit = F.get(F.filter(path, _at_position(q)), F.lit(0))
        q = F.when(hit.isNotNull(), 2 * q + F.when(F.get("x", hit["f"]) <= hit["t"], 0).otherwise(1))
    rows = rows.withColumn("q", q).where("q IS NOT NULL")
    rows = rows.select("tree", "at", "e", "q", "c", "w", "y", "x", F.inline(F.get("probes", F.col("q"))))
    w, y = F.col("w"), F.col("y")
    left = F.when(F.get("x", F.col("f")) <= F.col("t"), w).otherwise(0)
    return rows.groupBy("tree", "at", "e", "q", "j", "f", "t", "c").agg(
        F.sum(w).alias("w"), F.sum(w * y).alias("wy"), F.sum(w * y * y).alias("wyy"),
        F.sum(left).alias("lw"), F.sum(left * y).alias("lwy"), F.sum(left * y * y).alias("lwyy"))


def _won_splits(won: DataFrame, trials: int, depth: int) -> dict:
    """By (tree, at): the columns (-1: none) and thresholds of the embedded nodes of one depth."""
    found = {}
    for (tree, at), part in won.select("tree", "at", "e", "q", "f", "t").toPandas().groupby(["tree", "at"]):
        f, t = np.full((trials, 1 << depth), -1), np.zeros((trials, 1 << depth))
        f[part["e"], part["q"]], t[part["e"], part["q"]] = part["f"], part["t"]
        found[tree, at] = f, t
    return found


def _probed(samples: DataFrame, known: list[dict], splits: list[dict], trials: int, depth: int) -> DataFrame:
    """Sums of the drawn rows by embedded node, test and class, also of those left of the test."""
    shared = samples.sparkSession.sparkContext.broadcast(({(r["tree"], r["at"]): r for r in known}, splits))
    cells = ["tree", "at", "e", "q", "j", "f", "t", "c"]
    schema = "tree int, at int, e int, q int, j int, f int, t double, c int, " + ", ".join(f"{n} double" for n in SUMS)

    def add(rows: list[pa.RecordBatch], nodes: dict, splits: list[dict], table: np.ndarray, probes: dict, sums: dict) -> None:
        rows = pa.Table.from_batches(rows)
        x, (tree, at, c, codes, w, y) = trees.matrix(rows["x"]), (rows[n].to_numpy() for n in ("tree", "at", "c", "code", "w", "y"))
        order = np.lexsort((c, at, tree))
        new = np.flatnonzero((np.diff(tree[order]) != 0) | (np.diff(at[order]) != 0) | (np.diff(c[order]) != 0)) + 1
        for group in np.split(order, new):
            node = int(tree[group[0]]), int(at[group[0]])
            if node not in nodes or any(node not in level for level in splits):
                continue
            r = nodes[node]
            if node not in probes:
                probes[node] = trees.probes_of(r["code"], depth, trials, np.array(r["active"], int), np.array(r["lo"], float), np.array(r["hi"], float))
            for start in range(0, len(group), PROBED_ROWS):
                part = group[start:start + PROBED_ROWS]
                stats = np.stack([w[part], w[part] * y[part], w[part] * y[part] ** 2], axis=1).astype(float)
                found = trees.probe_sums(
                    np.ascontiguousarray(x[part].T), stats, codes[part], r["code"], probes[node], [level[node] for level in splits], trials, table)
                key = (*node, int(c[group[0]]))
                sums[key] = [a + b for a, b in zip(sums[key], found, strict=True)] if key in sums else list(found)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, splits = shared.value
        table, probes, sums, waiting, held = poisson_table(SAMPLE_SHARE), {}, {}, [], 0
        for batch in batches:
            waiting.append(batch)
            held += len(batch)
            if held >= 10 * PROBED_ROWS:
                add(waiting, nodes, splits, table, probes, sums)
                waiting, held = [], 0
        if held:
            add(waiting, nodes, splits, table, probes, sums)
        for (tree, at, c), (whole, left) in sums.items():
            f, t = probes[tree, at]
            e, q, j = np.nonzero(np.broadcast_to(whole[:, :, None, 0] > 0, f.shape))
            n = len(e)
            columns = [np.full(n, tree), np.full(n, at), e, q, j, f[e, q, j], t[e, q, j], np.full(n, c)]
            columns += [whole[e, q, i] for i in range(3)] + [left[e, q, j, i] for i in range(3)]
            kinds = [pa.int32()] * 6 + [pa.float64(), pa.int32()] + [pa.float64()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=[*cells, *SUMS])

    found = samples.select("tree", "at", "c", "code", "w", "y", "x").mapInArrow(work, schema)
    return found.groupBy(*cells).agg(*[F.sum(n).alias(n) for n in SUMS])


# --- growing -----------------------------------------------------------------------------------


def _attach(df: DataFrame, table: DataFrame, small: bool, keys=("tree", "at"), how: str = "inner") -> DataFrame:
    """Join node information to rows: broadcast while the level is small, else by shuffle.

    A node may hold a third of the rows: Spark splits such a partition of the rows
    and reads the node's row in each part.
    """
    return df.join(F.broadcast(table) if small else table, list(keys), how)


def _carried(state: DataFrame) -> list[str]:
    return ["x", "c", "y", "code"] + (["ys"] if "ys" in state.columns else [])


def _slots(state: DataFrame) -> DataFrame:
    return state.select("row_id", *_carried(state), F.posexplode(F.arrays_zip("w", "at")).alias("tree", "s")).select(
        "row_id", *_carried(state), "tree", "s.w", "s.at")


def _samples(state: DataFrame) -> DataFrame:
    """The rows in flight; trees with targets of their own get these."""
    found = _slots(state).where("at >= 0 AND w > 0")
    return found.withColumn("y", F.get("ys", F.col("tree"))).drop("ys") if "ys" in state.columns else found


def _descend(slots: DataFrame, level: DataFrame, small: bool, most: int) -> DataFrame:
    """Move each (row, tree) one level down; at a closed node it stops."""
    joined = _attach(slots, level.select("tree", "at", "fs", "ws", "threshold", "left_at"), small, how="left")
    v = combine(F.col("x"), F.col("fs"), F.col("ws"), most)
    down = F.when(v <= F.col("threshold"), F.col("left_at")).otherwise(F.col("left_at") + 1)
    return joined.select(*[c for c in slots.columns if c != "at"], F.when(F.col("fs").isNotNull(), down).otherwise(-1).alias("at"))


def step(state: DataFrame, level: DataFrame, most: int) -> DataFrame:
    """Move every row one level down in every tree by a shuffled join; the slots are put together again."""
    moved = _descend(_slots(state), level, False, most)
    back = moved.groupBy("row_id").agg(
        *[F.first(c).alias(c) for c in _carried(state)], F.array_sort(F.collect_list(F.struct("tree", "w", "at"))).alias("s"))
    return back.select("row_id", *_carried(state), *[F.col(f"s.{n}").alias(n) for n in ("w", "at")])


def _plan(level: DataFrame, most: int) -> dict[int, dict[str, np.ndarray]]:
    """The at most NODE_LIMIT nodes of a level as arrays, by tree."""
    plan: dict[int, dict[str, np.ndarray]] = {}
    rows = level.select("tree", "at", "fs", "ws", "threshold", "left_at").toPandas()
    for tree, part in rows.groupby("tree"):
        size = int(part["at"].max()) + 2  # the last place stands for nodes that are not of the level
        fs, ws, threshold = np.zeros((size, most), int), np.zeros((size, most)), np.zeros(size)
        left = np.full(size, -1)
        for at, f, w, t, down in zip(part["at"], part["fs"], part["ws"], part["threshold"], part["left_at"], strict=True):
            if f is not None:
                fs[at, : len(f)], ws[at, : len(w)], threshold[at], left[at] = f, w, t, down
        plan[int(tree)] = {"fs": fs, "ws": ws, "threshold": threshold, "left": left}
    return plan


def walk(state: DataFrame, plans: list[dict[int, dict[str, np.ndarray]]]) -> DataFrame:
    """Move every row down the levels of ``plans`` in every tree, in one vectorised pass."""
    if not plans:
        return state
    shared = state.sparkSession.sparkContext.broadcast(plans)

    @F.pandas_udf("array<int>")
    def move(x: pd.Series, at: pd.Series) -> pd.Series:
        x, at = np.stack(x), np.stack(at).astype(np.int32)
        for level in shared.value:
            for tree in range(at.shape[1]):
                node, live = level.get(tree), np.flatnonzero(at[:, tree] >= 0)
                if node is None:
                    at[live, tree] = -1
                    continue
                # Nodes that are not of the level were grown to their leaves elsewhere.
                i = np.minimum(at[live, tree], len(node["left"]) - 1)
                v = node["ws"][i, 0] * x[live, node["fs"][i, 0]]
                for j in range(1, node["fs"].shape[1]):
                    used = node["ws"][i, j] != 0  # an infinite value of a column that is not in the sum must not count
                    v = np.where(used, v + node["ws"][i, j] * x[live, node["fs"][i, j]], v)
                at[live, tree] = np.where(node["left"][i] < 0, -1, node["left"][i] + ~(v <= node["threshold"][i]))
        return pd.Series(list(at))

    return state.withColumn("at", move("x", "at"))


def _drawn(rows: DataFrame, seed: str, trees_: int, bootstrap: bool | str) -> DataFrame:
    """``rows`` with the weight of each row in each tree."""
    if bootstrap == "exact":
        return exact_bootstrap(rows, "row_id", trees_, seed)
    return rows.withColumn("w", poisson_weights(seed, trees_, "row_id") if bootstrap else F.array_repeat(F.lit(1), trees_))


def grow(
    rows: DataFrame,
    task: str,
    configs: list[tuple[int, float]],
    nmin: int | None = None,
    trials: int = 100,
    max_depth: int | None = MAX_LEVELS,
    alpha: float = ALPHA,
    seed: int | str = 42,
    limit: int = NODE_LIMIT,
    random_cuts: bool = False,
    gather: int | None = None,
    exact: bool = False,
    tried: int | None = None,
    split_from: int = 2,
    bootstrap: bool | str = True,
) -> tuple[Forest, DataFrame]:
    """Grow one tree per (k, muting rate) in ``configs``.

    Returns the forest and the training rows with their leaf values. ``trials``
    embedded trees rate the columns of each node. ``max_depth`` bounds the levels that are
    grown, far below what nodes of the smallest size reach. ``random_cuts`` grows
    extremely randomised trees instead: no bootstrap, no muting, one uniform
    threshold per column. ``exact`` grows trees that try every threshold of
    ``tried`` columns per split (of all for numbers, of their root for classes).
    Both of these split pure nodes no further, and others from ``split_from`` rows on.
    ``bootstrap`` draws Poisson weights, which need no pass; ``"exact"`` draws exactly n of n rows.
    A node of at most ``gather`` rows is grown to its leaves in one task: ``GATHER`` if not
    given, for trees without rating as many rows as ``GATHER_BYTES`` holds.
    """
    spark = rows.sparkSession
    ready_workers(spark)
    p, n_rows = rows.select(F.size("x")).first()[0], rows.count()
    nmin = smallest_node(n_rows) if nmin is None else nmin
    seed, size = str(seed), len(configs)
    kind = RANDOM if random_cuts else EXACT if exact else MUTED
    if gather is None:
        gather = GATHER if kind == MUTED else GATHER_BYTES
    tried = tried or (p if task == REGRESSION else max(1, math.isqrt(p)))
    # Sums of squares are taken of the centred target, so that they do not cancel.
    centre = rows.agg(F.avg("y")).first()[0] if task == REGRESSION else 0.0
    rows = rows.withColumn("y", F.col("y") - F.lit(centre)) if task == REGRESSION else rows
    rule = Rule(
        kind, task == CLASSIFICATION, p, 2 * nmin if kind == MUTED else split_from, nmin if kind == MUTED else 1, text_code(seed),
        trials, alpha, tried, max_depth, centre)
    # A fixed number of partitions: each row becomes trees x trials rows in flight, so small
    # input must not be coalesced into one task, and large input keeps its parallelism.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    coded = rows.select("row_id", "x", "c", "y", row_code(seed, F.col("row_id")).alias("code"))
    state = cut_lineage(_drawn(coded, seed, size, False if random_cuts else bootstrap).repartition(parts, "row_id"))
    most = max(k for k, _ in configs)
    if n_rows <= gather and n_rows * (8 * p + 64) <= GATHER_BYTES:
        nodes = cut_lineage(_whole_trees(state, configs, rule, parts))
    else:
        nodes = _by_levels(state, configs, rule, parts, limit, gather, n_rows, most)
    forest = Forest(task, p, configs, nodes, most)
    grown = scoring.votes(state.withColumn("at", F.array_repeat(F.lit(-1), size)), nodes, size, most, keep_x=True).drop("code")
    grown = grown.withColumnRenamed("votes", "value")
    return forest, grown.withColumn("y", F.col("y") + F.lit(centre)) if task == REGRESSION else grown


def _ends(rows: DataFrame) -> tuple[list[float], list[float]]:
    """Least and largest value of every column."""
    ends = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("i").collect()
    return [r.lo for r in ends], [r.hi for r in ends]


def _whole_trees(state: DataFrame, configs: list[tuple[int, float]], rule: Rule, parts: int) -> DataFrame:
    """All trees of a table that fits one task, a few trees a task."""
    cores = state.sparkSession.sparkContext.defaultParallelism
    each = max(1, len(configs) // max(64, 8 * cores))
    blocks = math.ceil(len(configs) / each)
    lo = hi = np.zeros(rule.p)
    if rule.kind == MUTED:
        lo, hi = (np.array(e, dtype=float) for e in _ends(state))
    own = ["ys"] if "ys" in state.columns else []
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    dealt = state.select("row_id", "x", "c", "y", "code", "w", *own, block)
    for name in ("w", *own):
        dealt = dealt.withColumn(name, F.slice(name, F.col("block") * each + 1, each))

    def fit(table: pa.Table) -> pa.Table:
        first = table["block"][0].as_py() * each
        grower, table = trees.grower(rule, table)
        weights = trees.matrix(table["w"])
        targets = trees.matrix(table["ys"]) if own else None

        def found():
            for i in range(weights.shape[1]):
                if targets is not None:
                    grower.y = targets[:, i]
                k, rate = configs[first + i]
                code = int_fold(rule.seed, first + i)
                yield grower.table_of(trees.Start(first + i, 1, code, 0, k, rate, np.arange(rule.p), lo, hi), weights[:, i])

        return pa.concat_tables(found())

    return dealt.repartition(blocks, "block").groupBy("block").applyInArrow(fit, trees.NODES)


def _subtrees(samples: DataFrame, nodes: DataFrame, rule: Rule, parts: int, small: bool) -> DataFrame:
    """The nodes below (and with) ``nodes``, each grown in one task from its rows."""
    rows = _attach(samples, nodes.select("tree", "at"), small).repartition(parts, "tree", "at")
    starts = nodes.select("tree", "at", "node", "code", "depth", "k", "rate", "active", "lo", "hi").repartition(parts, "tree", "at")

    def fit(rows: pa.Table, start: pa.Table) -> pa.Table:
        s = start.to_pylist()[0]
        grower, rows = trees.grower(rule, rows)
        begin = trees.Start(
            s["tree"], s["node"], s["code"], s["depth"], s["k"], s["rate"], np.array(s["active"], int), np.array(s["lo"], float), np.array(s["hi"], float))
        return grower.table_of(begin, rows["w"].to_numpy())

    return rows.groupBy("tree", "at").cogroup(starts.groupBy("tree", "at")).applyInArrow(fit, trees.NODES)


def _by_levels(state, configs, rule, parts, limit, gather, n_rows, most, grid=None) -> DataFrame:
    """All nodes, level by level; nodes of at most ``gather`` rows are grown to their leaves as they come up."""
    spark, p, size = state.sparkSession, rule.p, len(configs)
    gather = min(gather, GATHER_BYTES // (8 * p + 64))
    lo, hi = _ends(state)
    roots = [(t, 0, 1, int_fold(rule.seed, t), 0, k, float(rate), list(range(p)), lo, hi) for t, (k, rate) in enumerate(configs)]
    nodes = spark.createDataFrame(
        roots, "tree int, at int, node bigint, code bigint, depth int, k int, rate double, active array<int>, lo array<double>, hi array<double>")
    # The rows are stored once; each pass walks them down the levels grown so far.
    base = state = state.withColumn("at", F.array_repeat(F.lit(0), size))
    if rule.kind == EXACT and grid is None:
        grid = cuts.grid(state, rule.classes, p, n_rows * size)
    plans, found = [], []
    width = 24 * p + 64  # bytes of a node
    probes = 0 if rule.kind != MUTED else rule.trials * 2**LOOKAHEAD * 24 * (math.isqrt(p) + 1)  # and of its embedded nodes
    bound = n_rows * size * (most + 1)
    depth = 0
    while size:
        small = size <= limit and size * (width + probes) <= NODE_BYTES
        samples = _samples(state)
        known = cut_lineage(nodes.join(_node_values(samples, rule), ["tree", "at"]))
        fit = known.where(F.col("n") <= gather)
        if not fit.isEmpty():
            found.append(cut_lineage(_subtrees(samples, fit, rule, parts, small)))
        level = cut_lineage(_level(samples, known.where(F.col("n") > gather), rule, bound, depth == rule.max_depth, small, most, grid))
        found.append(_numbered(level))
        if size <= limit and size * width <= NODE_BYTES:
            plans.append(_plan(level, most))
            state = walk(base, plans)
        else:
            base, plans = cut_lineage(step(state, level, most)), []
            state = base
        nodes = _children(level)
        size = 2 * level.where("fs IS NOT NULL").count()
        depth += 1
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return cut_lineage(out)


def _node_values(samples: DataFrame, rule: Rule) -> DataFrame:
    """(tree, at, n, value, loss) of the nodes in flight."""
    values = leaf_values(samples, ["tree", "at"], CLASSIFICATION if rule.classes else REGRESSION)
    w, y = F.col("w"), F.col("y")
    by_class = samples.groupBy("tree", "at", "c").agg(
        F.sum("w").alias("w"), F.sum(w * y).alias("wy"), F.sum(w * y * y).alias("wyy"), F.sum(w * F.abs(y) * (1 - F.abs(y))).alias("curve"))
    more = by_class.groupBy("tree", "at").agg(
        impurity(w, F.col("wy") ** 2, F.col("wyy")).alias("loss"), F.sum("wy").alias("wy"), F.sum("curve").alias("curve"))
    joined = values.join(more, ["tree", "at"])
    if rule.newton:
        step_ = F.col("wy") / F.col("curve") * ((rule.newton - 1) / rule.newton)
        value = F.when(F.col("curve") > 1e-150, step_).otherwise(F.lit(0.0))
    else:
        value = F.col("value") + F.lit(rule.centre)
    return joined.select("tree", "at", "n", value.alias("value"), "loss")


def _child(side: int) -> Column:
    far = F.pmod(F.xxhash64("node"), F.lit(1 << 60))
    return F.when((F.col("node") > 0) & (F.col("node") <= trees.NUMBERED), 2 * F.col("node") + side).otherwise(-1 - side - 2 * far)


def _numbered(level: DataFrame) -> DataFrame:
    split = F.col("fs").isNotNull()
    return level.select(
        "tree", "node", F.when(split, _child(0)).alias("left"), F.when(split, _child(1)).alias("right"), "depth", "n", "value", "loss", "fs", "ws", "threshold",
        F.when(F.col("depth") == 0, F.col("importance")).alias("importance"), F.lit(0).cast("bigint").alias("piece"))


def _level(samples, known, rule, bound, last, small, most, grid=None) -> DataFrame:
    """Importances and splits of all large nodes of one level."""
    none = {"importance": "array<double>", "fs": "array<int>", "ws": "array<double>", "threshold": "double", "left_at": "int"}
    if last:
        return known.select("*", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    open_ = known.where(F.col("n") >= rule.split_from)
    if rule.kind == MUTED:
        p = rule.p
        found = node_importance(samples, open_.where(F.col("n") >= UNIFORM_BELOW), p, rule.trials, small)
        uniform_ = F.array_repeat(F.lit(1.0 / p), p)
        rated = open_.join(found, ["tree", "at"], "left").withColumn(
            "importance", F.coalesce("importance", F.when(F.col("n") < UNIFORM_BELOW, uniform_), F.array_repeat(F.lit(0.0), p)))
        rated = rated.withColumn("active", mute(F.col("active"), F.col("importance"), F.col("rate"), p))
        chosen = candidates(F.col("active"), F.col("importance"), F.col("k"), rule.alpha)
        # One row per node: the passes below read these tables instead of planning them again.
        rated = cut_lineage(rated.withColumn("chosen", chosen))
        options = rated.select("tree", "at", split_options(F.col("chosen")).alias("options"))
        thresholds = cut_lineage(node_thresholds(samples, options, small, most, bound))
        splits = best_splits(samples, thresholds, small, most)
    else:
        mixed = _attach(samples, open_.select("tree", "at"), small).groupBy("tree", "at").agg(
            (F.min("c") < F.max("c")).alias("_c"), (F.min("y") < F.max("y")).alias("_y"))
        open_ = open_.join(mixed.where("_c OR _y").select("tree", "at"), ["tree", "at"], "left_semi")
        rated = open_.withColumn("importance", F.lit(None).cast("array<double>"))
        picks = cut_lineage(_picks(open_, rule))
        if rule.kind == RANDOM:
            splits = best_splits(samples, cut_lineage(_random_thresholds(samples, picks, small)), small, 1, rule.least)
        else:
            splits = exact_splits(samples, picks, grid, small, rule.least)
    kept = splits.where((F.col("n_left") >= rule.least) & (F.col("n_right") >= rule.least))
    # Left children get even numbers in the order of their parents, right ones the next.
    order = Window.partitionBy("tree").orderBy("at")
    numbered = kept.select("tree", "at", "fs", "ws", "threshold", (2 * (F.row_number().over(order) - 1)).cast("int").alias("left_at"))
    learned = rated.select("tree", "at", F.col("active").alias("left_active"), "importance")
    return known.join(learned, ["tree", "at"], "left").join(numbered, ["tree", "at"], "left").withColumn(
        "active", F.coalesce("left_active", "active")).drop("left_active")


def _picks(nodes: DataFrame, rule: Rule) -> DataFrame:
    """(tree, at, options): the columns tried at each node, with the draw of a threshold."""
    start = fold(F.col("code"), trees.PICK)
    drawn = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(rule.p - 1)), lambda f: F.struct(fold(start, f).alias("u"), f.alias("f"))))
    tried = F.transform(F.slice(drawn, 1, rule.tried), lambda s, j: F.struct(
        j.alias("j"), s["f"].alias("f"), uniform(fold(fold(F.col("code"), trees.CUT), s["f"])).alias("u")))
    return nodes.select("tree", "at", tried.alias("options"))


def _random_thresholds(samples: DataFrame, picks: DataFrame, small: bool) -> DataFrame:
    """One uniform threshold between the ends of each column tried within its node."""
    values = _attach(samples, picks, small).select("tree", "at", "x", F.inline("options")).withColumn("v", F.get("x", F.col("f")))
    ends = values.groupBy("tree", "at", "j", "f", "u").agg(
        F.min(F.when(~F.isnan("v"), F.col("v"))).alias("lo"), F.max(F.when(~F.isnan("v"), F.col("v"))).alias("hi"))
    cut = F.col("lo") + F.col("u") * (F.col("hi") - F.col("lo"))
    return ends.where("lo IS NOT NULL").select(
        "tree", "at", "j", F.array("f").alias("fs"), F.array(F.lit(1.0)).alias("ws"), F.array(cut).alias("thresholds"))


def exact_splits(samples: DataFrame, picks: DataFrame, grid: cuts.Grid, small: bool, least: int = 1) -> DataFrame:
    """(tree, at, fs, ws, threshold, n_left, n_right) of the best threshold of all, between neighbouring values.

    ``picks`` brings (tree, at, options) with structs (j, f). The first column tried and the lowest threshold win a tie.
    """
    tried = picks.select("tree", "at", F.transform("options", lambda o: o["f"]).alias("fs"))
    best = cuts.best_cuts(_attach(samples, tried, small), grid, least)
    return best.select("tree", "at", F.array("f").alias("fs"), F.array(F.lit(1.0)).alias("ws"), "threshold", "n_left", "n_right")


def _children(level: DataFrame) -> DataFrame:
    """The two children of every split node; a single split column narrows their boxes."""
    split = level.where("fs IS NOT NULL")
    f = F.when(F.size("fs") == 1, F.get("fs", F.lit(0)))

    def narrowed(side: str) -> Column:
        return F.transform(side, lambda v, i: F.when(i == f, F.col("threshold")).otherwise(v))

    def child(side: int, lo: Column, hi: Column) -> Column:
        return F.struct(
            (F.col("left_at") + side).alias("at"), _child(side).alias("node"), fold(F.col("code"), side + 1).alias("code"),
            (F.col("depth") + 1).alias("depth"), lo.alias("lo"), hi.alias("hi"))

    both = F.array(child(0, F.col("lo"), narrowed("hi")), child(1, narrowed("lo"), F.col("hi")))
    return split.select("tree", "k", "rate", "active", F.inline(both)).select(
        "tree", "at", "node", "code", "depth", "k", "rate", "active", "lo", "hi")


# --- predicting -----------------------------------------------------------------------------------


def traverse(forest: Forest, rows: DataFrame, limit: int = scoring.TREE_NODES) -> DataFrame:
    """Rows with ``votes``, the leaf value of each tree.

    Trees of at most ``limit`` nodes are packed into arrays and walked where the rows are;
    larger ones are joined level by level.
    """
    return scoring.votes(rows, forest.table, len(forest.trees), forest.most, limit)


def tally(forest: Forest, rows: DataFrame, groups: list[int], name: str, limit: int = scoring.TREE_NODES) -> DataFrame:
    """Add the sum of the votes of each group of trees, or for classes the count of each class by group.

    ``groups`` numbers the group of each tree; trees numbered -1 do not count.
    """
    return scoring.tally(rows, forest.table, groups, forest.most, classes_of(forest) if forest.task == CLASSIFICATION else None, name, limit)


def classes_of(forest: Forest) -> list[float]:
    """The classes that the leaves vote for, in order."""
    return sorted(r[0] for r in forest.table.where("left IS NULL").select("value").distinct().collect())


def mean_vote(votes: Column) -> Column:
    return F.aggregate(votes, F.lit(0.0), lambda a, v: a + v) / F.size(votes)


def majority(votes: Column) -> Column:
    """Most frequent value, the smallest on a tie."""
    counted = F.transform(F.array_distinct(votes), lambda v: F.struct(
        (-F.size(F.filter(votes, lambda o: o == v))).alias("m"), v.alias("v")))
    return F.array_min(counted)["v"]


def class_shares(votes: Column, classes: list[float]) -> list[Column]:
    """Share of the votes for each class."""
    def share(c):
        return F.size(F.filter(votes, lambda v: v == c)) / F.size(votes)

    return [share(c).alias(f"p_{int(c)}") for c in classes]


def predict(forest: Forest, rows: DataFrame, trees: list[int] | None = None, name: str = "prediction") -> DataFrame:
    """Add the forest's prediction, or that of some of its trees."""
    used = set(range(len(forest.trees)) if trees is None else trees)
    groups = [0 if t in used else -1 for t in range(len(forest.trees))]
    counted = tally(forest, rows, groups, "_tally")
    return counted.withColumn(name, _decided(forest, groups)[0]).drop("_tally")


def _decided(forest: Forest, groups: list[int]) -> list[Column]:
    """The prediction of each group, from the column ``_tally``."""
    n = max(groups) + 1
    if forest.task == REGRESSION:
        return [F.get("_tally", F.lit(g)) / groups.count(g) for g in range(n)]
    classes = classes_of(forest)
    names = F.array(*[F.lit(c) for c in classes])
    out = []
    for g in range(n):
        counts = F.slice("_tally", g * len(classes) + 1, len(classes))
        # The first of the largest counts: the smallest class on a tie.
        out.append(F.get(names, (F.array_position(counts, F.array_max(counts)) - 1).cast("int")))
    return out


def predict_proba(forest: Forest, rows: DataFrame, classes: list[float]) -> DataFrame:
    """(row_id, p_<class>...): the share of the trees that vote for each class."""
    known = classes_of(forest)
    counted = tally(forest, rows, [0] * len(forest.trees), "_tally")
    shares = [
        (F.get("_tally", F.lit(known.index(c))) / len(forest.trees) if c in known else F.lit(0.0)).alias(f"p_{int(c)}") for c in classes]
    return counted.select("row_id", *shares)


def predict_grid(forest: Forest, rows: DataFrame, key: str = "row_id") -> DataFrame:
    """(row_id, method, prediction) for each configuration of the forest, in one pass."""
    configs = list(dict.fromkeys(forest.trees))
    groups = [configs.index(c) for c in forest.trees]
    counted = tally(forest, rows, groups, "_tally")
    cells = [
        F.struct(F.lit(config_name(*c)).alias("method"), value.alias("prediction"))
        for c, value in zip(configs, _decided(forest, groups), strict=True)]
    keep = [c for c in rows.columns if c not in ("c", "y", "x")]
    truth = [F.col("y")] if "y" in rows.columns and forest.task == REGRESSION else []
    if "c" in rows.columns and forest.task == CLASSIFICATION:
        truth = [F.col("c").cast("double").alias("y")]
    return counted.select(*keep, *truth, F.inline(F.array(*cells)))


def forest_importance(forest: Forest, per_config: bool = False) -> DataFrame:
    """Mean of the root importances over the trees."""
    rows = forest.importances
    if not per_config:
        return rows.groupBy("feature").agg(F.avg("importance").alias("importance"))
    names = F.array(*[F.lit(config_name(k, rate)) for k, rate in forest.trees])
    return rows.groupBy(F.get(names, F.col("tree")).alias("config"), "feature").agg(F.avg("importance").alias("importance"))


def gain_importance(forest: Forest) -> DataFrame:
    """(feature, importance): mean over the trees of each column's share of the impurity that the splits take off."""
    nodes = forest.table
    child = {s: nodes.select("tree", F.col("node").alias(s), F.col("loss").alias(f"_{s}")) for s in ("left", "right")}
    split = nodes.where("left IS NOT NULL").join(child["left"], ["tree", "left"]).join(child["right"], ["tree", "right"])
    gains = split.select("tree", F.get("fs", F.lit(0)).alias("feature"), F.greatest(F.col("loss") - F.col("_left") - F.col("_right"), F.lit(0.0)).alias("gain"))
    by_tree = gains.groupBy("tree", "feature").agg(F.sum("gain").alias("gain"))
    total = by_tree.groupBy("tree").agg(F.sum("gain").alias("total")).where("total > 0")
    shares = by_tree.join(total, "tree").groupBy("feature").agg((F.sum(F.col("gain") / F.col("total")) / len(forest.trees)).alias("importance"))
    every = forest.table.sparkSession.range(forest.n_features).select(F.col("id").cast("int").alias("feature"))
    return every.join(shares, "feature", "left").select("feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))


def root_importance(rows: DataFrame, task: str, trials: int = 100, seed: int | str = 42) -> DataFrame:
    """(feature, importance) of the whole table, as its root node would rate the columns."""
    forest, _ = grow(rows, task, [(1, 0.0)], trials=trials, max_depth=1, seed=seed)
    return forest_importance(forest)


def marginal_importance(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature number, importance): absolute correlation with the target, 0 where undefined."""
    table = correlations(df.select(*[col(f) for f in features], col(target)), target, features)
    at = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature")) - 1
    return table.select(at.cast("int").alias("feature"), F.coalesce(F.abs("correlation"), F.lit(0.0)).alias("importance"))


def importance_array(importance: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The importances as one array in feature order."""
    listed = F.array_sort(F.collect_list(F.struct("feature", "importance")))
    return importance.groupBy(*keys).agg(F.transform(listed, lambda s: s["importance"]).alias("importance"))


def top_features(importance: DataFrame, n: int = 20) -> DataFrame:
    """The n most important features, the highest number first on a tie."""
    w = Window.orderBy(F.desc("importance"), F.desc("feature"))
    first = importance.orderBy(F.desc("importance"), F.desc("feature")).limit(n)
    return first.withColumn("rank", F.row_number().over(w))


# --- marginal selection ------------------------------------------------------------------------------


def marginal_keep(p: int, rate: float) -> int:
    return max(1, int(p * (1 - rate)))


def naive_subset(p: int, rate: float) -> int:
    """Columns tried per split by the marginal variant."""
    return max(1, min(int(p * (1 - rate)), int(math.sqrt(p))))
