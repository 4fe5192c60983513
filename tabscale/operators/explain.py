"""Explanations: sampled Shapley values, local surrogates, global importance.

A scorer is a function that takes rows with an array column ``x`` and returns
them with a ``prediction`` column, so that any model scores all altered rows of
all instances in one batch.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.rand import DRAWS, hash_uniform, np_normal_grid
from ..session import cut_lineage, ready_workers
from . import forest, switches
from .profile import REGRESSION
from .trees import matrix

Scorer = Callable[[DataFrame], DataFrame]

# Rows of the background, kernel width factor, ridge penalty of the surrogate.
BACKGROUND, KERNEL, PENALTY = 100, 0.75, 1.0
SAMPLES = 5000
MOST_BACKGROUND = 10_000
# Altered rows that a task makes at once, or orders that walk down trees.
ALTERED = 20_000
# Bytes of the packed trees of a task, and instances that meet them there.
TREES_BYTES, MET = 64 * 1024 * 1024, 32_000


def instances(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    return df.select(col(key).alias("instance"), F.array(*[col(f).cast("double") for f in features]).alias("x"))


def linear_scorer(weights: list[float], intercept: float = 0.0) -> Scorer:
    def score(df: DataFrame) -> DataFrame:
        total = F.lit(float(intercept))
        for i, w in enumerate(weights):
            total = total + F.lit(float(w)) * F.col("x")[i]
        return df.withColumn("prediction", total)

    def values(x: list[np.ndarray]) -> np.ndarray:
        total = float(intercept)
        for v, w in zip(x, weights, strict=True):
            total = total + float(w) * v
        return total

    score.values = values
    return score


def ml_scorer(model, label: int | None = None) -> Scorer:
    """Score with a fitted Spark ML model: its prediction, or the probability of class ``label``."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def score(df: DataFrame) -> DataFrame:
        scored = model.transform(df.withColumn("features", array_to_vector("x")))
        value = F.col("prediction") if label is None else F.get(vector_to_array("probability"), F.lit(label))
        return scored.select(*df.columns, value.alias("prediction"))

    return score


def forest_scorer(model: forest.Forest, label: float | None = None) -> Scorer:
    """Score with a grown forest: its prediction, or the share of its trees that vote for class ``label``."""

    def score(df: DataFrame) -> DataFrame:
        kept = df.withColumn("row_id", F.monotonically_increasing_id())
        if label is None:
            return forest.predict(model, kept).select(*df.columns, "prediction")
        known = forest.classes_of(model)
        counted = forest.tally(model, kept, [0] * len(model.trees), "_tally")
        share = F.get("_tally", F.lit(known.index(label))) / len(model.trees) if label in known else F.lit(0.0)
        return counted.select(*df.columns, share.alias("prediction"))

    score.forest, score.label = model, label
    return score


def background(df: DataFrame, key: str, k: int = BACKGROUND, seed=42) -> DataFrame:
    """At most ``k`` random rows, without replacement: the sample is the operator."""
    u = hash_uniform(f"{seed}|background", key)
    return df.orderBy(u, col(key)).limit(k)


# --- Shapley values ----------------------------------------------------------------------


def shapley(scorer: Scorer, rows: DataFrame, back: DataFrame, features: list[str], rounds: int = 1, seed=42) -> DataFrame:
    """(instance, feature, phi) from random feature orders against every background row.

    Along an order the background row turns into the instance one feature at a
    time. Each altered row counts for the feature just switched and against the
    next one, so one sum per (instance, feature) replaces the differences. The trees of a
    forest are walked by intervals of steps instead, each tree for itself.
    """
    ready_workers(rows.sparkSession)
    p = len(features)
    back_x, back_null = _sample(back)
    size = len(back_x)
    # The hash of (seed, instance), which the draws and features are added to.
    start = F.xxhash64(F.lit(str(seed)), F.col("instance")).alias("_h")

    def alter(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x, null = _cells(batch["x"])
        begin = batch["_h"].to_numpy().view(np.uint64)
        for at, d in _pieces(len(x), size * rounds, p + 1):
            order = _orders(begin, at, d, p)
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.arange(p)[None, :], axis=1)
            # A feature that stands before the step has the instance's value.
            own = place[:, None, :] < np.arange(p + 1)[None, :, None]
            b = d % size
            mixed = np.where(own, x[at][:, None, :], back_x[b][:, None, :])
            gone = np.where(own, null[at][:, None, :], back_null[b][:, None, :])
            edge = np.full((len(at), 1), -1)
            steps = np.repeat(at, p + 1)
            yield pa.RecordBatch.from_arrays([
                batch["instance"].take(pa.array(steps)), _lists(mixed, gone, p),
                pa.array(np.hstack([edge, order]).ravel(), pa.int32()), pa.array(np.hstack([order, edge]).ravel(), pa.int32())],
                names=["instance", "x", "_on", "_next"])

    kind = rows.schema["instance"].dataType.simpleString()
    dealt = _dealt(rows.select("instance", "x", start))
    signed = _by_trees(scorer, dealt, kind, back_x, rounds) if size else None
    if signed is None:
        altered = dealt.mapInArrow(_each(alter), f"instance {kind}, x array<double>, _on int, _next int")
        scored = scorer(altered)
        signed = scored.select("instance", F.inline(F.array(
            F.struct(F.col("_on").alias("j"), F.col("prediction").alias("v")),
            F.struct(F.col("_next").alias("j"), (-F.col("prediction")).alias("v")))))
    names = F.array(*[F.lit(f) for f in features])
    return signed.where("j >= 0").groupBy("instance", "j").agg(
        (F.sum("v") / float(size * rounds)).alias("phi")).select("instance", F.get(names, F.col("j")).alias("feature"), "phi")


def _orders(begin: np.ndarray, at: np.ndarray, d: np.ndarray, p: int) -> np.ndarray:
    """The feature orders of draws ``d`` of the rows ``at``, whose hashes begin with ``begin``."""
    h = _hash_int(_hash_int(begin[at], d)[:, None], np.arange(p)).view(np.int64)
    return np.argsort(h, axis=1, kind="stable")


def _by_trees(scorer: Scorer, rows: DataFrame, kind: str, back_x: np.ndarray, rounds: int) -> DataFrame | None:
    """(instance, j, v): what each feature changes in a forest's score, over all orders of the instance.

    None unless the score is a mean over trees that split by one column, each of them small enough for a task.
    Groups of trees meet blocks of instances, so the work is dealt by both; the sums of a block come together again.
    """
    model, label = getattr(scorer, "forest", None), getattr(scorer, "label", None)
    if model is None or model.most != 1 or (label is None and model.task != REGRESSION):
        return None
    sizes = sorted((r["tree"], r["n"]) for r in model.table.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).collect())
    largest = max((n for _, n in sizes), default=0) * switches.NODE_BYTES
    if not sizes or largest > TREES_BYTES:
        return None
    spark, size, n_trees = rows.sparkSession, len(back_x), len(model.trees)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([
                    pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), batch["instance"]),
                    pa.array([_cells(batch["x"])[0].tobytes()], pa.binary()), pa.array([batch["_h"].to_numpy().tobytes()], pa.binary())],
                    names=["block", "instances", "x", "h"])
                number += 1

    blocks = cut_lineage(rows.mapInArrow(block, f"block bigint, instances array<{kind}>, x binary, h binary"))
    met = blocks.agg(F.sum(F.size("instances"))).first()[0] or 0
    # Few instances are dealt by more groups of trees, many by pieces of the instances too.
    pieces = max(1, -(-met // MET))
    most = max(1, min(TREES_BYTES // largest, len(sizes) * pieces // (3 * spark.sparkContext.defaultParallelism)))
    member = F.create_map(*[F.lit(v) for i, (t, _) in enumerate(sizes) for v in (t, i // most)])
    keys, groups_of = ["group", "piece"], -(-len(sizes) // most)
    value = F.col("value") if label is None else (F.col("value") == label).cast("double")
    trees = model.table.select(
        "tree", "node", "left", "right", F.get("fs", F.lit(0)).alias("f"), "threshold", value.alias("value"),
        member[F.col("tree")].alias("group"), F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece"))
    spread = blocks.select("block", "x", "h", F.pmod(F.shiftright("block", 32), F.lit(pieces)).cast("int").alias("piece"),
                           F.explode(F.sequence(F.lit(0), F.lit(groups_of - 1))).alias("group"))
    # The work is far more than the bytes: more partitions than keys, which are not put together again.
    spread, trees = (df.repartition(4 * groups_of * pieces, *keys) for df in (spread, trees))

    def walk(found: pa.Table, nodes: pa.Table) -> pa.Table:
        packed = switches.pack(nodes) if len(found) else []
        sums = []
        for x, h in zip(found["x"], found["h"], strict=True):
            begin = np.frombuffer(h.as_py(), np.uint64)
            x = np.frombuffer(x.as_py(), float).reshape(len(begin), -1)
            total = np.zeros(x.shape)
            step = max(1, ALTERED // (size * rounds))
            for first in range(0, len(x), step):
                some = x[first:first + step]
                for at, d in _pieces(len(some), size * rounds, 1):
                    order = _orders(begin[first:first + step], at, d, x.shape[1])
                    total[first:first + step] += switches.contributions(packed, some, back_x, at, d % size, order)
            sums.append(total.tobytes())
        return pa.table([found["block"], found["group"], pa.array(sums, pa.binary())], names=["block", "group", "sums"])

    def add(parts: pa.Table, held: pa.Table) -> pa.Table:
        instances = held["instances"].combine_chunks().flatten()
        total = sum(np.frombuffer(v.as_py(), float) for v in parts.sort_by("group")["sums"]) / n_trees
        p = len(total) // len(instances)
        return pa.table([
            instances.take(pa.array(np.repeat(np.arange(len(instances)), p))), pa.array(np.tile(np.arange(p), len(instances)), pa.int32()), pa.array(total)],
            names=["instance", "j", "v"])

    sums = spread.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInArrow(walk, "block bigint, group int, sums binary")
    return sums.groupBy("block").cogroup(blocks.select("block", "instances").groupBy("block")).applyInArrow(add, f"instance {kind}, j int, v double")


def _sample(back: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The background's values and nulls, in the order of the rows: a few hundred rows at most, which is checked."""
    found = back.select("x").orderBy("x").limit(MOST_BACKGROUND + 1).toArrow()
    if len(found) > MOST_BACKGROUND:
        raise ValueError(f"a background of over {MOST_BACKGROUND} rows is not a sample; take one with background()")
    return _cells(found["x"].combine_chunks())


def _dealt(rows: DataFrame) -> DataFrame:
    """Few rows that each become many: dealt over all cores, whatever pieces the table lies in."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def _each(alter: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from alter(batch)

    return run


def _pieces(rows: int, draws: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, draw) pairs, row by row, so many at once that ``width`` altered rows each are ``ALTERED`` at most."""
    step = max(1, ALTERED // width)
    for first in range(0, rows * draws, step):
        yield np.divmod(np.arange(first, min(first + step, rows * draws)), draws)


def _cells(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns): the values, and which of them are null."""
    flat = x.flatten()
    shape = (len(x), -1) if len(x) else (0, 0)
    return matrix(pa.chunked_array([x])), flat.is_null().to_numpy(zero_copy_only=False).reshape(shape)


def _lists(values: np.ndarray, null: np.ndarray, p: int) -> pa.Array:
    """A list column of rows of ``p`` values."""
    flat = pa.array(values.ravel(), mask=null.ravel()) if null.any() else pa.array(values.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(values.size // p + 1, dtype=np.int32) * p), flat)


_P1, _P2, _P3, _P5 = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _hash_int(start: np.ndarray, value: np.ndarray) -> np.ndarray:
    """``xxhash64`` of a whole number after what ``start`` is the hash of."""
    h = (start + (_P5 + np.uint64(4))) ^ (value.astype(np.uint64) * _P1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _P2 + _P3
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def coalitions(p: int, most: int, seed=42) -> tuple[np.ndarray, np.ndarray, bool]:
    """(masks, weights, whether all): the proper subsets of ``p`` features for the kernel estimator.

    All of them if they are at most ``most``. Else whole sizes are taken from the outside in, a size
    with its complement, while they fit; the others are drawn by the kernel, each with its complement,
    and share the weight of the sizes that were left.
    """
    share = {k: (p - 1) / (k * (p - k)) for k in range(1, p)}
    total = sum(share.values())
    masks, weights, left = [], [], list(range(1, p))
    while left:
        pair = sorted({left[0], left[-1]})
        subsets = sum(math.comb(p, k) for k in pair)
        if len(masks) + subsets > most:
            break
        for k in pair:
            for chosen in itertools.combinations(range(p), k):
                masks.append([j in chosen for j in range(p)])
                weights.append(share[k] / math.comb(p, k) / total)
            left.remove(k)
    if left:
        rng = np.random.default_rng(seed)
        odds = np.array([share[k] for k in left])
        pairs = max(1, (most - len(masks)) // 2)
        for k in rng.choice(left, pairs, p=odds / odds.sum()):
            mask = np.zeros(p, bool)
            mask[rng.choice(p, k, replace=False)] = True
            for m in (mask, ~mask):
                masks.append(m.tolist())
                weights.append(odds.sum() / total / (2 * pairs))
    return np.array(masks, bool).reshape(-1, p), np.array(weights), not left


def kernel_shapley(scorer: Scorer, rows: DataFrame, back: DataFrame, features: list[str], most: int | None = None, seed=42) -> DataFrame:
    """(instance, feature, phi, error) by weighted least squares over coalitions of features.

    A coalition is worth the mean score of the background with the coalition's features taken from the instance. The
    values add up to the score less the mean score of the background. At most ``most`` coalitions (2048 and
    two per feature by default) are scored, the same for all instances, so the solution is one matrix.
    ``error`` is the standard error of the fit, 0 where every coalition was scored.
    """
    ready_workers(rows.sparkSession)
    p = len(features)
    masks, weights, every = coalitions(p, 2048 + 2 * p if most is None else most, seed)
    back_x, back_null = _sample(back)
    size = len(back_x)
    listed = np.array([[False] * p, *masks.tolist(), [True] * p])

    def alter(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x, null = _cells(batch["x"])
        for at, d in _pieces(len(x), size * len(listed), 1):
            c, b = np.divmod(d, size)
            mixed, gone = np.where(listed[c], x[at], back_x[b]), np.where(listed[c], null[at], back_null[b])
            yield pa.RecordBatch.from_arrays(
                [batch["instance"].take(pa.array(at)), pa.array(c, pa.int32()), _lists(mixed, gone, p)], names=["instance", "_c", "x"])

    kind = rows.schema["instance"].dataType.simpleString()
    altered = _dealt(rows.select("instance", "x")).mapInArrow(_each(alter), f"instance {kind}, _c int, x array<double>")
    worth = scorer(altered).groupBy("instance", "_c").agg(F.avg("prediction").alias("v"))
    # As many numbers per instance as there are coalitions.
    per_row = worth.groupBy("instance").agg(F.transform(F.array_sort(F.collect_list(F.struct("_c", "v"))), lambda s: s["v"]).alias("v"))
    z = masks.astype(float)
    design = z[:, :-1] - z[:, -1:]
    inverse = np.linalg.inv(design.T @ (weights[:, None] * design)) if p > 1 else np.zeros((0, 0))
    solve = (weights[:, None] * design) @ inverse
    spread = np.append(np.diag(inverse), inverse.sum())
    free = max(1, len(masks) - (p - 1))

    @F.arrow_udf("array<struct<phi:double,error:double>>")
    def fit(v: pa.Array) -> pa.Array:
        v = matrix(pa.chunked_array([v]))
        empty, full = v[:, :1], v[:, -1:]
        y = v[:, 1:-1] - empty - z[:, -1] * (full - empty)
        phi = y @ solve
        rest = y - phi @ design.T
        phi = np.column_stack([phi, (full - empty)[:, 0] - phi.sum(axis=1)])
        variance = (rest * rest * weights).sum(axis=1) / free
        error = np.zeros_like(phi) if every else np.sqrt(np.maximum(variance[:, None] * spread[None, :], 0.0))
        flat = pa.StructArray.from_arrays([pa.array(phi.ravel()), pa.array(error.ravel())], names=["phi", "error"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * p), flat)

    names = F.array(*[F.lit(f) for f in features])
    return per_row.select("instance", F.posexplode(fit("v")).alias("j", "s")).select(
        "instance", F.get(names, F.col("j")).alias("feature"), F.col("s.phi").alias("phi"), F.col("s.error").alias("error"))


def shapley_importance(contributions: DataFrame, mean_abs: bool = True) -> DataFrame:
    """Mean absolute (or signed) contribution of each feature, largest first."""
    value = F.avg(F.abs("phi") if mean_abs else F.col("phi"))
    return contributions.groupBy("feature").agg(value.alias("importance")).orderBy(F.desc("importance"), "feature")


def summary_chart(contributions: DataFrame, top: int = 15) -> DataFrame:
    return shapley_importance(contributions).limit(top)


def force_chart(contributions: DataFrame) -> DataFrame:
    """Contributions by side; those that do not raise the score are shown without their sign."""
    rising = F.col("phi") > 0
    return contributions.select(
        "instance", "feature", F.when(rising, "positive").otherwise("negative").alias("side"),
        F.when(rising, F.col("phi")).otherwise(-F.col("phi")).alias("length"))


# --- local surrogates -------------------------------------------------------------------------


def local_surrogate(
    scorer: Scorer, rows: DataFrame, spreads: list[float], features: list[str],
    samples: int = SAMPLES, top: int = 10, seed=42,
) -> DataFrame:
    """(instance, feature, weight) of a weighted ridge fit around each instance.

    Weights are per standard deviation. Every batch of samples collapses to one Gram
    matrix per instance before the shuffle; what is solved per instance is their sum,
    of (features + 2) squared numbers, whatever the number of samples.
    """
    p = len(features)
    width = KERNEL * math.sqrt(p)
    scale = np.array([float(s) for s in spreads])
    starts = [f"{seed}|{j}" for j in range(p)]
    kind = rows.schema["instance"].dataType.simpleString()
    key = F.coalesce(F.concat(F.lit("|"), F.col("instance").cast("string")), F.lit("")).alias("_key")
    values = getattr(scorer, "values", None)

    def drawn(batch: pa.RecordBatch, most: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Some rows, their draws (columns, rows, samples) and the samples' weights, at most ``most`` samples at once."""
        heads = [k.encode() + b"|" for k in batch["_key"].to_pylist()]
        some = min(samples, most)
        for first in range(0, samples, some):
            tails = [b"%d" % s for s in range(first, min(first + some, samples))]
            for at in range(0, len(heads), step := max(1, most // some)):
                z = np_normal_grid(starts, heads[at:at + step], tails)
                if not first:
                    z[:, :, 0] = 0.0  # the first sample is the instance itself
                yield slice(at, at + step), z, np.sqrt(np.exp(-sum(v * v for v in z) / (width * width)))

    def move(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x, null = _cells(batch["x"])
        for rows, z, weight in drawn(batch, ALTERED):
            z, n = np.moveaxis(z, 0, 2).reshape(-1, p), weight.shape[1]
            at = np.repeat(np.arange(len(x))[rows], n)
            # Weight and draws pass the scorer as bytes, which Spark copies whole.
            kept = np.ascontiguousarray(np.column_stack([weight.ravel(), z]))
            places = np.arange(len(at) + 1, dtype=np.int32) * kept.itemsize * (p + 1)
            yield pa.RecordBatch.from_arrays([
                batch["instance"].take(pa.array(at)), pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(places), pa.py_buffer(kept)]),
                _lists(x[at] + z * scale, null[at], p)], names=["instance", "_wz", "x"])

    def gram(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not batch.num_rows:
            return
        code = batch["instance"].dictionary_encode(null_encoding="encode")
        of = code.indices.to_numpy()
        order = np.argsort(of, kind="stable")
        ends = np.searchsorted(of[order], np.arange(len(code.dictionary) + 1))
        kept = np.frombuffer(batch["_wz"].buffers()[2], float, batch.num_rows * (p + 1)).reshape(-1, p + 1)
        u = np.column_stack([np.ones(batch.num_rows), kept[:, 1:], batch["y"].to_numpy(zero_copy_only=False)])[order]
        weighted = u * kept[order, :1]
        sums = np.stack([weighted[a:b].T @ u[a:b] for a, b in itertools.pairwise(ends)])
        yield pa.RecordBatch.from_arrays([code.dictionary, _lists(sums, np.zeros((1, 1), bool), (p + 2) ** 2)], names=["instance", "gram"])

    def scored_gram(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Moved, scored and added up in one go, where a score is plain arithmetic of the columns."""
        x = matrix(pa.chunked_array([batch["x"]]))
        for rows, z, weight in drawn(batch, max(1, DRAWS // p)):
            u = np.empty((p + 2, *weight.shape))
            u[0], u[1:p + 1] = 1.0, z
            u[p + 1] = values([x[rows, j, None] + z[j] * scale[j] for j in range(p)])
            sums = np.matmul((u * weight).transpose(1, 0, 2), u.transpose(1, 2, 0))
            yield pa.RecordBatch.from_arrays(
                [batch["instance"][rows], _lists(sums, np.zeros((1, 1), bool), (p + 2) ** 2)], names=["instance", "gram"])

    dealt, form = _dealt(rows.select("instance", "x", key)), f"instance {kind}, gram array<double>"
    if values is None:
        scored = scorer(dealt.mapInArrow(_each(move), f"instance {kind}, _wz binary, x array<double>"))
        sums = scored.select("instance", "_wz", F.col("prediction").cast("double").alias("y")).mapInArrow(_each(gram), form)
    else:
        sums = dealt.mapInArrow(_each(scored_gram), form)

    def solve(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        penalty = np.diag([0.0] + [PENALTY] * p)
        beta = np.linalg.solve(total[:, : p + 1, : p + 1] + penalty, total[:, : p + 1, p + 1, None])[:, 1:, 0]
        order = np.argsort(-np.abs(beta), axis=1, kind="stable")[:, :top]
        return order, np.take_along_axis(beta, order, axis=1)

    @F.arrow_udf("array<struct<j:int,weight:double>>")
    def fit(sums: pa.Array) -> pa.Array:
        order, weight = solve(matrix(pa.chunked_array([sums])).reshape(-1, p + 2, p + 2))
        flat = pa.StructArray.from_arrays([pa.array(order.ravel(), pa.int32()), pa.array(weight.ravel(), from_pandas=True)], names=["j", "weight"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1, dtype=np.int32) * order.shape[1]), flat)

    total = _added(sums, (p + 2) ** 2)
    names = F.array(*[F.lit(f) for f in features])
    return total.select("instance", F.inline(fit("gram"))).select("instance", F.get(names, F.col("j")).alias("feature"), "weight")


def _added(sums: DataFrame, n: int) -> DataFrame:
    """The element-wise sum of the arrays ``gram`` of ``n`` numbers by instance."""
    if n <= 100:
        return sums.groupBy("instance").agg(F.array(*[F.sum(F.get("gram", F.lit(i))) for i in range(n)]).alias("gram"))
    cells = sums.select("instance", F.posexplode("gram").alias("i", "v")).groupBy("instance", "i").agg(F.sum("v").alias("v"))
    return cells.groupBy("instance").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("gram"))


def surrogate_bars(weights: DataFrame, label: int = 30) -> DataFrame:
    return weights.select(
        "instance", F.substring("feature", 1, label).alias("label"), "weight",
        F.when(F.col("weight") > 0, "positive").otherwise("negative").alias("sign"))


# --- both ------------------------------------------------------------------------------------------


def prediction_errors(scored: DataFrame, task: str) -> DataFrame:
    """(instance, prediction, y, error): absolute for numbers, 0 or 1 for classes."""
    wrong: Column = F.abs(F.col("prediction") - F.col("y")) if task == "regression" else (
        F.col("prediction") != F.col("y")).cast("double")
    return scored.select("instance", "prediction", "y", wrong.alias("error"))


def compare_methods(local: DataFrame, contributions: DataFrame, errors: DataFrame | None = None, top: int = 5) -> DataFrame:
    """Both explanations side by side: the features among the top of either, per instance.

    ``errors`` (instance, prediction, y, error) puts the prediction, the truth and the
    error beside them.
    """
    def first(df, value, rank):
        w = Window.partitionBy("instance").orderBy(F.desc(F.abs(value)), "feature")
        return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= top)

    both = first(local, "weight", "local_rank").join(
        first(contributions, "phi", "shapley_rank"), ["instance", "feature"], "full_outer")
    return both if errors is None else both.join(errors, "instance", "left")


def explain_both(local: DataFrame, contributions: DataFrame) -> DataFrame:
    return contributions.select("instance", "feature", "phi", F.lit("shapley").alias("method")).unionByName(
        local.select("instance", "feature", F.col("weight").alias("phi"), F.lit("local").alias("method")))


def global_importance(scorer: Scorer, rows: DataFrame, back: DataFrame, features: list[str], rounds: int = 1, seed=42) -> DataFrame:
    """Mean absolute contribution over all rows."""
    return shapley_importance(shapley(scorer, rows, back, features, rounds, seed))


def concentration(importance: DataFrame, top: int = 10, original: int = 50) -> DataFrame:
    """Per table: share of the ten largest importances and of the first columns, with a verdict.

    ``importance`` holds (table_name, feature number, importance), one row per feature.
    """
    w = Window.partitionBy("table_name").orderBy(F.desc("importance"), F.desc("feature"))
    ranked = importance.withColumn("_rank", F.row_number().over(w))
    shares = ranked.groupBy("table_name").agg(
        F.sum(F.when(F.col("_rank") <= top, F.col("importance"))).alias("top_share"),
        F.sum(F.when(F.col("feature") < original, F.col("importance"))).alias("original_share"),
        F.count(F.lit(1)).alias("n_features"))
    verdict = F.when(F.col("original_share") > 0.7, "excellent").when(F.col("original_share") > 0.5, "good").otherwise("weak")
    return shares.withColumn("verdict", verdict)


def concentration_means(shares: DataFrame) -> DataFrame:
    return shares.agg(
        F.avg("top_share").alias("mean_top_share"), F.avg("original_share").alias("mean_original_share"),
        F.avg("n_features").alias("mean_features"), F.count(F.lit(1)).alias("n_tables"))


def label_features(importance: DataFrame, top: int = 10, original: int = 50) -> DataFrame:
    """The ten most important features of each table, labelled original or noise by number."""
    w = Window.partitionBy("table_name").orderBy(F.desc("importance"), F.desc("feature"))
    return importance.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).withColumn(
        "kind", F.when(F.col("feature") < original, "original").otherwise("noise"))
