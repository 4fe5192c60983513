"""The grower against a numpy tree, and its invariants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscale.functions.rand import hash_uniform, poisson_weight
from tabscale.operators import forest
from tabscale.plans import fixtures as fx
from tabscale.plans import forest_queries


@pytest.fixture(scope="module")
def surface(spark):
    from tabscale.operators.surfaces import hash_columns, local_surface

    df = hash_columns(spark.range(600).withColumnRenamed("id", "k"), "k", 6)
    df = df.withColumn("t", local_surface(F.col("x1"), F.col("x4"), 1, "k"))
    return forest.to_rows(df, "k", [f"x{j}" for j in range(6)], "t", "regression").cache()


@pytest.fixture(scope="module")
def grown(surface):
    return forest.grow(surface, "regression", [(1, 0.0), (2, 0.8)], max_depth=3, trials=20)


def test_relevant_columns_rank_first(grown):
    rated = forest.forest_importance(grown[0]).orderBy(F.desc("importance")).collect()
    assert {r.feature for r in rated[:2]} == {1, 4}
    assert sum(r.importance for r in rated) == pytest.approx(1)


def test_nodes_add_up(grown):
    nodes = grown[0].nodes().toPandas().set_index(["tree", "node"])
    for (tree, node), row in nodes.iterrows():
        if row.fs is not None:
            assert nodes.loc[(tree, 2 * node), "n"] + nodes.loc[(tree, 2 * node + 1), "n"] == row.n
            assert sum(row.ws) == pytest.approx(1)
    assert (nodes["n"] >= forest.smallest_node(600)).all()


def test_leaves_hold_weighted_means(surface, grown):
    """Every split is a quartile of its node and every leaf the mean of the rows that reach it."""
    model, state = grown
    rows = state.select("row_id", "x", "y", F.posexplode(F.arrays_zip("w", "at")).alias("tree", "s")).select("row_id", "x", "y", "tree", "s.w").toPandas()
    nodes = model.nodes().toPandas().set_index(["tree", "node"])
    for tree, part in rows[rows.w > 0].groupby("tree"):
        x, y, w = np.stack(part.x), part.y.to_numpy(), part.w.to_numpy()
        waiting = [(1, np.ones(len(part), bool))]
        while waiting:
            node, here = waiting.pop()
            row = nodes.loc[(tree, node)]
            assert row.n == w[here].sum()
            assert row.value == pytest.approx(np.average(y[here], weights=w[here]))
            if row.fs is not None:
                v = sum(a * x[:, f] for f, a in zip(row.fs, row.ws))
                cuts = np.percentile(np.repeat(v[here], w[here]), [25, 50, 75])
                assert np.isclose(cuts, row.threshold, rtol=1e-12).any()
                waiting += [(2 * node, here & (v <= row.threshold)), (2 * node + 1, here & (v > row.threshold))]


def test_broadcast_and_shuffled_levels_agree(surface, grown):
    model, _ = grown
    votes = [
        sorted((r.row_id, tuple(r.votes)) for r in forest.traverse(model, surface, limit=n).select("row_id", "votes").collect())
        for n in (100_000, 0)]
    assert votes[0] == votes[1]


def test_growing_by_shuffle_gives_the_same_tree(surface):
    a, b = (forest.grow(surface, "regression", [(2, 0.5)], max_depth=2, trials=5, limit=n, gather=0)[0].nodes().drop("value").toPandas() for n in (100_000, 0))
    key = lambda d: d.sort_values("node").drop(columns=["threshold", "loss"]).astype(str).values.tolist()
    assert key(a) == key(b)


def _as_classes(rows):
    return rows.select("row_id", "x", F.floor(F.get("x", F.lit(1)) * 3).cast("int").alias("c"), F.lit(1.0).alias("y"))


def _nodes(model):
    found = model.table.orderBy("tree", "node").collect()
    return [(r.tree, r.node, r.left, r.right, r.depth, r.n, r.fs, None if r.ws is None else [round(w, 6) for w in r.ws],
             r.threshold and round(r.threshold, 9), round(r.value, 6)) for r in found]


GROWERS = {
    "muted": {"trials": 6},
    "random": {"random_cuts": True},
    "exact": {"exact": True, "tried": 3, "split_from": 12, "bootstrap": True},
}


@pytest.mark.parametrize("task", ["regression", "classification"])
@pytest.mark.parametrize("kind", sorted(GROWERS))
def test_whole_trees_and_levels_with_subtrees_give_the_same_nodes(surface, task, kind):
    """Grown in one task, and by levels until a node fits a task."""
    rows = surface if task == "regression" else _as_classes(surface)
    depth = 2 if task == "regression" else 1
    a, b = (_nodes(forest.grow(rows, task, [(1, 0.5), (2, 0.8)], max_depth=depth, gather=g, **GROWERS[kind])[0]) for g in (20_000, 250))
    assert len(a) >= 6
    assert a == b


def test_exact_trees_equal_a_search_of_every_threshold(surface):
    """A tree on all columns against a plain search, node by node."""
    model, _ = forest.grow(surface, "regression", [(1, 0.0)], exact=True, bootstrap=False, split_from=40, max_depth=None)
    data = surface.toPandas().sort_values("row_id")
    x, y = np.stack(data.x), data.y.to_numpy()
    nodes = {r.node: r for r in model.nodes().collect()}
    waiting, seen = [(1, np.ones(len(y), bool))], 0
    while waiting:
        number, here = waiting.pop()
        node = nodes[number]
        seen += 1
        assert node.n == here.sum() and node.value == pytest.approx(y[here].mean())
        if here.sum() < 40:
            assert node.left is None
            continue
        best = min(
            (round(sum(((p - p.mean()) ** 2).sum() for p in (y[here & (x[:, f] <= t)], y[here & (x[:, f] > t)])), 9), f)
            for f in range(x.shape[1]) for t in np.unique(x[here, f])[:-1])
        left = here & (x[:, node.fs[0]] <= node.threshold)
        right = here & ~left
        got = sum(((y[p] - y[p].mean()) ** 2).sum() for p in (left, right))
        assert got == pytest.approx(best[0], rel=1e-7)
        waiting += [(node.left, left), (node.right, right)]
    assert seen == len(nodes) > 20


def test_unlimited_trees_tell_all_training_rows_apart(surface):
    model, state = forest.grow(surface, "regression", [(1, 0.0)], exact=True, bootstrap=False, max_depth=None)
    assert state.where(F.abs(F.get("value", F.lit(0)) - F.col("y")) > 1e-9).count() == 0


def test_node_numbers_stay_apart_below_sixty_levels():
    from tabscale.operators import trees

    node, seen = 1, set()
    for _ in range(200):
        a, b = trees.children(node)
        assert a != b and not {a, b} & seen and abs(a) < 1 << 63
        seen |= {a, b}
        node = b


def test_scoring_neither_explodes_trees_nor_shuffles(surface, grown):
    model, _ = grown
    for df in (forest.traverse(model, surface), forest.predict(model, surface)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Exchange" not in plan and "ArrowEvalPython" in plan


def test_blocks_of_trees_add_up(surface, grown, monkeypatch):
    from tabscale.operators import scoring

    model, _ = grown
    whole = {r.row_id: r.prediction for r in forest.predict(model, surface).collect()}
    votes = {r.row_id: r.votes for r in forest.traverse(model, surface).collect()}
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 1500)
    assert len(scoring.blocks(model.table, model.most, 10**6)[0]) > 1
    assert {r.row_id: r.votes for r in forest.traverse(model, surface).collect()} == votes
    assert {r.row_id: r.prediction for r in forest.predict(model, surface).collect()} == pytest.approx(whole)
    assert all(whole[i] == pytest.approx(sum(v) / len(v)) for i, v in votes.items())


def test_missing_values_go_right_and_small_tables_grow(spark):
    rows = spark.createDataFrame(
        [(i, [float(i % 7), None if i % 3 == 0 else i / 10], 0, float(i % 5)) for i in range(60)], "row_id int, x array<double>, c int, y double")
    for kind in GROWERS.values():
        model, state = forest.grow(rows, "regression", [(1, 0.5)] * 2, **kind)
        assert state.count() == 60 and forest.predict(model, rows).where("prediction IS NULL").count() == 0
    one = forest.grow(rows.limit(1), "regression", [(1, 0.0)] * 3, trials=3)[0]
    assert one.nodes().where("left IS NOT NULL").count() == 0


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_nodes_are_rated_alike_in_one_task_and_by_passes(spark, surface, task):
    rows = surface
    if task == "classification":
        rows = surface.select("row_id", "x", F.floor(F.get("x", F.lit(1)) * 3).cast("int").alias("c"), F.lit(1.0).alias("y"))
    key = lambda f: sorted((r.tree, r.feature, round(r.importance, 9)) for r in f.importances.collect())
    a, b = (forest.grow(rows, task, [(1, 0.5), (2, 0.0)], max_depth=1, trials=12, gather=g)[0] for g in (20_000, 0))
    assert key(a) == key(b)


def test_repartitioned_rows_give_the_same_tree(surface):
    a, b = (forest.grow(surface.repartition(n), "regression", [(1, 0.5)], max_depth=1, trials=5)[0].nodes().toPandas() for n in (1, 5))
    assert np.allclose(a.sort_values("node").value, b.sort_values("node").value)


def test_class_forest(spark):
    df = spark.range(300).select("id", hash_uniform(1, "id").alias("a"), hash_uniform(2, "id").alias("b"))
    rows = forest.to_rows(df.withColumn("c", F.floor(F.col("a") * 3)), "id", ["a", "b"], "c", "classification")
    model, _ = forest.grow(rows, "classification", [(1, 0.0)] * 2, max_depth=3, trials=5)
    out = forest.predict(model, rows)
    assert out.agg(F.avg((F.col("c") == F.col("prediction")).cast("int"))).first()[0] > 0.85


def test_extra_trees_fit(surface):
    model, state = forest.grow(surface, "regression", [(1, 0.0)] * 3, max_depth=5, random_cuts=True)
    out = forest.predict(model, surface)
    r = out.agg(F.avg((F.col("y") - F.col("prediction")) ** 2), F.var_pop("y")).first()
    assert r[0] < 0.5 * r[1]


def _python_mute(active, importance, rate, p):
    protected, least = max(1, int(np.log(p))), max(2, p // 3)
    left = set(active)
    for i in np.argsort(importance, kind="stable")[: max(1, int(p * rate))]:
        if i >= protected and len(left) > least:
            left.discard(int(i))
    return sorted(left)


@pytest.mark.parametrize("rate", [0.0, 0.3, 0.5, 0.8, 1.0])
def test_muting(spark, rate):
    rng = np.random.default_rng(3)
    p = 20
    for _ in range(3):
        importance = np.round(rng.random(p), 1)
        active = sorted(rng.choice(p, 15, replace=False).tolist())
        df = spark.createDataFrame([(active, importance.tolist(), rate)], "a array<int>, v array<double>, r double")
        got = df.select(forest.mute(F.col("a"), F.col("v"), F.col("r"), p)).first()[0]
        assert sorted(got) == _python_mute(active, importance, rate, p)


def test_candidates(spark):
    df = spark.createDataFrame([([0, 2, 3, 5], [0.1, 0.9, 0.3, 0.3, 0.9, 0.01])], "a array<int>, v array<double>")
    pick = lambda k, alpha=0.05: [s.f for s in df.select(forest.candidates(F.col("a"), F.col("v"), F.lit(k), alpha)).first()[0]]
    assert pick(1) == [2] and pick(2) == [2, 3] and pick(5) == [2, 3, 0]
    assert pick(5, alpha=2.0) == [2, 3, 0, 5]


def test_votes(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0, 1.0, 3.0],)], "v array<double>")
    r = df.select(forest.majority(F.col("v")).alias("m"), forest.mean_vote(F.col("v")).alias("a"), *forest.class_shares(F.col("v"), [1.0, 2.0, 3.0, 4.0])).first()
    assert r.m == 1.0 and r.a == pytest.approx(1.8)
    assert [r.p_1, r.p_2, r.p_3, r.p_4] == [0.4, 0.4, 0.2, 0.0]


def test_names_and_sizes():
    assert forest.config_name(2, 0.8) == "MF_k2_mute80"
    assert forest.smallest_node(150) == 5 and forest.smallest_node(2) == 2
    assert len(forest.GRID) == 9
    assert pd.Series([forest.marginal_keep(10, 0.8), forest.naive_subset(100, 0.5)]).tolist() == [1, 10]


def test_multinomial_boosting_is_the_same_by_levels_and_learns(surface):
    from tabscale.operators import boosting

    rows = _as_classes(surface)
    a, b = (boosting.multinomial(rows, 3, stages=1, depth=2, gather=g) for g in (20_000, 0))
    key = lambda m: sorted((r["tree"], r["node"], r["n"], r["fs"], r["threshold"] and round(r["threshold"], 9), round(r["value"], 7)) for r in m.stages[0].to_pylist())
    assert key(a) == key(b)
    model = boosting.multinomial(rows, 3, stages=6, depth=2)
    out = model.scored(rows).select("c", boosting.class_of(F.col("score")).alias("p"))
    assert out.agg(F.avg((F.col("c") == F.col("p")).cast("int"))).first()[0] > 0.98


def test_boosting_equals_a_plain_loop(surface):
    """Two stages of depth 1 against every threshold tried in numpy."""
    from tabscale.operators import boosting

    data = _as_classes(surface).toPandas().sort_values("row_id")
    x, c = np.stack(data.x), data.c.to_numpy()
    truth = np.eye(3)[c]
    score = np.tile(np.log(truth.mean(0)), (len(c), 1))
    for _ in range(2):
        p = np.exp(score - score.max(1, keepdims=True))
        res = truth - p / p.sum(1, keepdims=True)
        for k in range(3):
            y = res[:, k]
            _, f, t = min((round(sum(((y[m] - y[m].mean()) ** 2).sum() for m in (x[:, f] <= t, x[:, f] > t)), 7), f, t) for f in range(6) for t in np.sort(x[:, f])[:-1])
            for m in (x[:, f] <= t, x[:, f] > t):
                score[m, k] += 0.1 * 2 / 3 * y[m].sum() / (np.abs(y[m]) * (1 - np.abs(y[m]))).sum()
    model = boosting.multinomial(_as_classes(surface), 3, stages=2, depth=1)
    found = {r.row_id: r.score for r in model.scored(_as_classes(surface)).collect()}
    wrong = np.abs(np.array([found[i] for i in data.row_id]) - score).max(axis=1) > 1e-9
    assert not wrong.any()


def test_exact_bootstrap_draws_n_of_n(spark):
    """Totals are exact at any range size, weights look Poisson, and the layout does not matter."""
    from tabscale.operators.resample import exact_bootstrap

    df = spark.range(3000).withColumnRenamed("id", "k")
    for size in (20_000, 100):
        a, b = ({r.k: r.w for r in exact_bootstrap(df.repartition(n), "k", 4, range_rows=size).collect()} for n in (2, 7))
        assert a == b and len(a) == 3000
        w = np.array(list(a.values()))
        assert (w.sum(axis=0) == 3000).all()
        expected = 3000 * np.exp(-1) / np.array([1, 1, 2, 6])
        seen = np.array([[(w[:, t] == k).sum() for k in range(4)] for t in range(4)])
        assert (((seen - expected) ** 2 / expected).sum(axis=1) < 16).all()  # chi-square, three degrees
        assert np.abs(np.corrcoef(w.T) - np.eye(4)).max() < 0.08
    assert exact_bootstrap(df.limit(0), "k", 2).collect() == []


def test_forest_on_exact_bootstraps(surface):
    model, state = forest.grow(surface, "regression", [(1, 0.0)] * 2, exact=True, bootstrap="exact", max_depth=2)
    assert {r.n for r in model.nodes().where("depth = 0").collect()} == {600}


def test_gain_importance_adds_up(surface):
    model, _ = forest.grow(surface, "regression", [(1, 0.0)] * 3, exact=True, max_depth=4)
    rated = {r.feature: r.importance for r in forest.gain_importance(model).collect()}
    assert sum(rated.values()) == pytest.approx(1) and rated[1] + rated[4] > 0.8 and set(rated) == set(range(6))


def test_registered_ensembles_run_at_their_full_size(spark):
    """Whole registered queries on the smallest tables: as many trees as the library's defaults."""
    from tabscale.plans import catalogue, forest_queries

    assert forest_queries.TREES == 100
    votes = catalogue.QUERIES["rf_traverse"](spark, "/root/testdata/sf0.001")
    assert votes.where(F.size("votes") != 100).isEmpty() and not votes.isEmpty()
    found = {r.method for r in catalogue.QUERIES["ml_run_all"](spark, "/root/testdata/sf0.001").where("error IS NULL").collect()}
    assert len(found) == 7


def test_many_tables_are_compared_with_the_muted_forest(monkeypatch):
    from tabscale.operators import models
    from tabscale.plans import model_queries

    seen = []
    monkeypatch.setattr(models, "evaluate_many", lambda tables, fits: seen.extend(map(fits, ("regression", "classification"))))
    model_queries.eval_many(None, "")
    configs = {forest.config_name(k, rate) for k, rate in forest.GRID}
    assert len(configs) == 9
    for task, fits in zip(("regression", "classification"), seen, strict=True):
        assert set(fits) == configs | set(models.baselines(task))


def test_plain_trees_grow_a_level_at_once_whatever_the_sizes():
    """A skewed tree of many levels tells every row apart, and an empty one is a leaf."""
    from tabscale.operators import trees

    n = 400
    x, y = np.arange(n, dtype=float)[None, :], 2.0 ** -np.arange(n)
    for kind in (trees.EXACT, trees.RANDOM):
        grower = trees.Grower(trees.Rule(kind, False, 1, 2, 1, 7, tried=1), x, np.zeros(n, int), y, np.arange(n))
        start = trees.Start(0, 1, 5, 0, 1, 0.0, np.zeros(1, int), np.zeros(1), np.ones(1))
        found = grower.table_of(start, np.ones(n, int)).to_pylist()
        assert len(found) == len({r["node"] for r in found}) and sum(r["n"] for r in found if r["left"] is None) == n
        assert all(r["left"] is None or {r["left"], r["right"]} <= {o["node"] for o in found} for r in found)
        assert len(grower.table_of(start, np.zeros(n, int))) == 1


def test_plain_trees_grow_whole_beyond_the_rows_of_a_rated_node(surface, monkeypatch):
    """Before, a table of over GATHER rows was split by shuffled passes, however small its bytes."""
    monkeypatch.setattr(forest, "GATHER", 100)
    monkeypatch.setattr(forest, "_by_levels", None)
    for kind in ("random", "exact"):
        assert forest.grow(surface, "regression", [(1, 0.0)] * 2, **GROWERS[kind])[0].nodes().where("depth = 0").count() == 2


@pytest.mark.parametrize("gather", [20_000, 100])
@pytest.mark.parametrize("task", ["regression", "classification"])
def test_large_trees_meet_their_rows_in_one_shuffle(surface, task, gather, monkeypatch):
    """Whole trees and trees of pieces give the votes of packed trees, also for keys that repeat and over many tasks."""
    from tabscale.operators import scoring

    rows = surface if task == "regression" else _as_classes(surface)
    model, _ = forest.grow(rows, task, [(1, 0.0)] * 3, exact=True, split_from=30, gather=gather)
    twice = rows.unionByName(rows.limit(50))
    key = lambda df: sorted(tuple(round(v, 9) for v in r.votes) for r in df.select("votes").collect())
    tallied = lambda: sorted((r.row_id, [round(v, 7) for v in r.t]) for r in forest.tally(model, twice, [0, 1, 0], "t").collect())
    votes, sums = key(forest.traverse(model, twice)), tallied()
    monkeypatch.setattr(scoring, "PACKED_BYTES", 0)
    for size in (scoring.PIECE_BYTES, 4000):
        monkeypatch.setattr(scoring, "PIECE_BYTES", size)
        out = forest.traverse(model, twice)
        assert key(out) == votes and len(votes) == 650 and tallied() == sums
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FlatMapCoGroupsInArrow") == 1


def test_few_large_nodes_are_rated_without_a_row_per_trial(surface, monkeypatch):
    """Before, every pass made a row of each drawn row, embedded tree and test."""
    monkeypatch.setattr(forest, "_probed_by_shuffle", None)
    plans = []
    probed = forest._probed
    monkeypatch.setattr(forest, "_probed", lambda *a: plans.append(probed(*a)) or plans[-1])
    forest.grow(surface, "regression", [(1, 0.5)], max_depth=1, trials=4, gather=0)
    assert len(plans) == 3
    for plan in plans:
        text = plan._jdf.queryExecution().analyzed().toString()
        assert text.count("explode") <= 1 and "MapInArrow" in text


def test_samples_draw_each_weight_once(spark, tmp_path):
    """No filter may repeat the formula of a draw, which takes a digest per step of the distribution."""
    rows = [(i, 1 + i % 5, float(i % 50), 0.01 * (i % 9), 0.02, "ANR"[i % 3], "F", 10.0 * i) for i in range(200)]
    names = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_extendedprice"]
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "lineitem.parquet"))
    drawn = forest_queries.samples(spark, str(tmp_path), "regression")
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "md5" in line]
    found = sorted((r.tree, r.row_id, r.w) for r in drawn.collect())
    every = drawn.sparkSession.read.parquet(str(tmp_path / "lineitem.parquet")).select(
        F.expr(fx.LINE_KEY).alias("row_id"), F.explode(F.array(*[F.lit(t) for t in range(3)])).alias("tree")).withColumn("w", poisson_weight(42, "tree", "row_id"))
    assert found == sorted((r.tree, r.row_id, r.w) for r in every.collect() if r.w > 0)


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_exact_splits_of_large_nodes_shuffle_packed_intervals(spark, task, monkeypatch):
    """Before, each tree, column and value was a row, shuffled twice. Values that repeat, NaN, null and infinite ones split alike."""
    from tabscale.operators import cuts

    monkeypatch.setattr(forest, "running_totals", None, raising=False)
    monkeypatch.setattr(cuts, "ENTRIES", 100)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        few, odd = float(rng.integers(0, 4)), [1.0, float("nan"), None, float("inf"), float("-inf")][i % 5]
        wide = float(rng.normal())
        t = 3.0 * (few > 1) + 2.0 * (wide > 0.3) + (0.5 if odd == 1.0 else 0.0)
        rows.append((i, [few, odd, wide], int(t) if task == "classification" else 0, 1.0 if task == "classification" else t + 0.1 * float(rng.normal())))
    df = spark.createDataFrame(rows, "row_id bigint, x array<double>, c int, y double").cache()
    a, b = (_nodes(forest.grow(df, task, [(1, 0.0)] * 2, exact=True, tried=3, max_depth=2, gather=g)[0]) for g in (20_000, 60))
    assert len(a) >= 6 and a == b


def test_columns_of_the_surface_are_drawn_in_many_tasks(spark, tmp_path, monkeypatch):
    """Before, a table of one row group was drawn, kept and boosted in one task."""
    from tabscale.functions import ordering

    names = ["event_id", *forest_queries.SURFACE_COLUMNS, "t"]
    spark.createDataFrame([(i,) for i in [*range(200), 7, None]], "event_id bigint").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    key = lambda df: sorted(map(str, df.select(*names).collect()))
    whole = forest_queries.surface_table(spark, str(tmp_path))
    monkeypatch.setattr(ordering, "PIECE_ROWS", 50)
    many = forest_queries.surface_table(spark, str(tmp_path))
    assert whole.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() == 5
    assert key(many) == key(whole)
