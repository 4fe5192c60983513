"""Shapley values of forests: whole trees walked by intervals of steps equal altered rows that are scored."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscale.operators import explain, forest, scoring, switches
from tabscale.operators.profile import CLASSIFICATION, REGRESSION

FEATURES = ["a", "b", "c"]


def table(spark, n=300, seed=5):
    draws = np.random.default_rng(seed).random((n, 3)).round(2)
    rows = [(i, [float(v) for v in x], int(x[0] * 3), float(x[0] + (x[1] > 0.5) * x[2])) for i, x in enumerate(draws)]
    return spark.createDataFrame(rows, "row_id long, x array<double>, c int, y double").repartition(3)


def instances(spark):
    """Keys that repeat or are null, missing values, values of the background."""
    held = [(1, [0.1, 0.9, 0.4]), (1, [0.8, 0.2, 0.6]), (None, [0.3, 0.3, 0.3]), (2, [None, 0.7, 0.2]), (3, [0.5, None, None])]
    held += [(10 + i, [i / 40, (i * 7 % 40) / 40, (i * 11 % 40) / 40]) for i in range(40)]
    return spark.createDataFrame(held, "instance long, x array<double>")


def found(contributions):
    return sorted((-1 if r.instance is None else r.instance, r.feature, r.phi) for r in contributions.collect())


@pytest.mark.parametrize("task, label, rounds", [(REGRESSION, None, 1), (REGRESSION, None, 3), (CLASSIFICATION, 1.0, 1), (CLASSIFICATION, 9.0, 1)])
def test_walked_trees_equal_scored_rows(spark, monkeypatch, task, label, rounds):
    model = forest.grow(table(spark), task, [(1, 0.0)] * 7, exact=True, split_from=2)[0]
    back = table(spark, 9, 6).select(F.col("row_id").alias("instance"), "x")
    scorer = explain.forest_scorer(model, label)
    want = found(explain.shapley(lambda df: scorer(df), instances(spark), back, FEATURES, rounds))
    assert len(want) == 44 * 3
    for few in (None, 8):  # many instances: dealt by pieces
        if few:
            monkeypatch.setattr(explain, "MET", few)
        with monkeypatch.context() as m:
            m.setattr(scoring, "tally", lambda *a: pytest.fail("an altered row was scored"))
            got = found(explain.shapley(scorer, instances(spark), back, FEATURES, rounds))
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-9, atol=1e-12)


def test_other_forests_are_scored_row_by_row(spark, monkeypatch):
    """Sums of columns, votes for a class, and trees too large for a task."""
    back = table(spark, 5, 6).select(F.col("row_id").alias("instance"), "x")
    rows = instances(spark).where("instance > 30")
    for task, k, most in [(REGRESSION, 2, None), (CLASSIFICATION, 1, None), (REGRESSION, 1, 100)]:
        model = forest.grow(table(spark), task, [(k, 0.0)] * 3, max_depth=3, trials=5)[0]
        if most:
            monkeypatch.setattr(explain, "TREES_BYTES", most)
        scorer = explain.forest_scorer(model)
        assert found(explain.shapley(scorer, rows, back, FEATURES)) == found(explain.shapley(lambda df: scorer(df), rows, back, FEATURES))  # noqa: B023


def test_no_rows_give_no_contributions(spark):
    model = forest.grow(table(spark), REGRESSION, [(1, 0.0)] * 2, exact=True)[0]
    back = table(spark, 5, 6).select(F.col("row_id").alias("instance"), "x")
    scorer = explain.forest_scorer(model)
    assert explain.shapley(scorer, instances(spark).limit(0), back, FEATURES).count() == 0
    assert explain.shapley(scorer, instances(spark), back.limit(0), FEATURES).count() == 0


def test_interval_walk_of_one_leaf():
    leaf = np.zeros(1, switches._NODE)
    leaf["left"] = -1
    order = np.array([[1, 0]])
    assert (switches.contributions([(leaf, np.array([3.0]))], np.zeros((1, 2)), np.ones((1, 2)), np.array([0]), np.array([0]), order) == 0).all()
