"""Branches the given tables do not reach, and known truths."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscale.functions.columns import nan_to_null
from tabscale.operators import explain, metrics, missing, models, outliers, prepare, profile, surfaces
from tabscale.sources import catalog, delimited, sinks


def frame(spark, **columns):
    return nan_to_null(spark.createDataFrame(pd.DataFrame(columns)))


def test_fill_without_another_numeric_column(spark):
    df = frame(spark, a=[1.0, np.nan, 3.0, 8.0], t=["x", None, "y", "y"])
    assert [r.a for r in missing.fill_correlated(df, "a").collect()] == [1.0, 3.0, 3.0, 8.0]
    assert [r.t for r in missing.fill_correlated(df, "t").collect()] == ["x", "y", "y", "y"]


def test_fill_keeps_null_where_the_other_column_is_null(spark):
    df = frame(spark, a=[1.0, np.nan, np.nan, 4.0], b=[2.0, 3.0, np.nan, 8.0])
    assert [r.a for r in missing.fill_correlated(df, "a").collect()] == [1.0, pytest.approx(3.0), None, 4.0]


def test_auto_fill_for_classes_uses_the_median(spark):
    values = [float(i) for i in range(99)] + [np.nan]
    df = frame(spark, a=values, c=["u"] * 100)
    assert missing.strategies(df, "classification").first().strategy == "FILL_MEDIAN"
    assert missing.fill_auto(df, "classification").where("a = 49").count() == 2


def test_sqrt_branch_and_unchanged_columns(spark):
    left = [1.0] + [50.0 + i for i in range(40)]
    df = frame(spark, low=left, neg=[-100.0] + left[1:], plain=[float(i) for i in range(41)])
    out = outliers.transform(df, ["low", "neg", "plain"]).toPandas()
    assert np.allclose(out["low"], np.sqrt(left)) and out["neg"].min() == -100 and out["plain"].max() == 40


def test_modified_z_with_nulls_counts_nothing(spark):
    df = frame(spark, a=[1.0] * 9 + [100.0], b=[1.0] * 8 + [100.0, np.nan])
    got = {r.feature: r["count"] for r in outliers.detect(df, ["a", "b"], ("modified_zscore",)).collect()}
    assert got == {"a": 1, "b": 0}


def test_class_codes_with_missing_class(spark):
    df = frame(spark, c=["b", None, "a", "b"], x=[1.0, 2.0, 3.0, 4.0])
    assert sorted(r.k for r in profile.with_class_code(df, "c", "k").collect()) == [-1.0, 0.0, 1.0, 1.0]


def test_first_appearance_codes(spark):
    df = frame(spark, i=[0, 1, 2, 3], c=["z", "a", "z", "m"])
    got = {r.c: r.k for r in profile.with_class_code(df, "c", "k", order="i").collect()}
    assert got == {"z": 0.0, "a": 1.0, "m": 2.0}


def test_split_sizes_and_paths_agree(spark):
    df = spark.range(3000)
    for n in (1, 150, 3000):
        train, test = prepare.split(df, "id", n)
        assert train.count() == n and test.count() == 3000 - n
    train, test = prepare.split(spark.range(50), "id", 20_000)
    assert train.count() == 50 and test.count() == 0
    by_rank = {r.id for r in prepare.split(spark.range(30_000), "id", 12_000)[0].collect()}
    ordered = spark.range(30_000).orderBy(prepare.hash_uniform(42, "id"), "id").limit(12_000)
    assert by_rank == {r.id for r in ordered.collect()}


def test_unseen_category_gives_zeros(spark):
    train, test = frame(spark, k=[1, 2], c=["a", "b"]), frame(spark, k=[3, 4], c=["z", "a"])
    out = prepare.one_hot(train, test, ["c"])[1].orderBy("k").collect()
    assert [(r.c_a, r.c_b) for r in out] == [(0.0, 0.0), (1.0, 0.0)]


@pytest.mark.parametrize("task", ["regression", "classification"])
@pytest.mark.parametrize("width", [12, 3])
def test_prepared_width(spark, task, width):
    df = spark.range(60).select(
        F.col("id").alias("k"), F.rand(1).alias("a"), (F.col("id") % 3).cast("string").alias("t"), F.col("id").cast("double").alias("y"))
    if task == "classification" and width == 3:  # one number and three indicators
        with pytest.raises(ValueError, match="do not fit"):
            prepare.prepare(df, "y", "k", task, width=width, train_rows=20)
    train, test = prepare.prepare(df, "y", "k", task, width=width, train_rows=20, truncate=True)
    assert len(train.columns) == width + 2 and train.columns == test.columns
    assert train.count() == 20 and test.count() == 40
    assert abs(train.agg(F.avg("a")).first()[0]) < 1e-9


def test_auc_paths_agree(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 800)
    pdf = pd.DataFrame({"row_id": range(800), "method": "m", "split": "test", "y": y, "prediction": np.round(rng.random(800) + 0.3 * y, 2)})
    df = spark.createDataFrame(pdf)
    pos, neg = pdf.prediction[y == 1].to_numpy(), pdf.prediction[y == 0].to_numpy()
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    for small in (None, 5):
        assert metrics.auc(df, small).first().auc == pytest.approx(want)


def test_rows_without_a_score_have_no_place_on_the_curve(spark):
    rows = [(i, "m", "test", i % 2, None if i % 10 == 0 else float("nan") if i % 10 == 5 else (i * 7 % 13) / 13) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id int, method string, split string, y int, prediction double")
    kept = df.where("prediction IS NOT NULL AND NOT isnan(prediction)")
    found = {metrics.auc(d, small).first().auc for d in (df, kept) for small in (None, 5)}
    assert len({round(v, 12) for v in found}) == 1


def test_confusion_refuses_numbers(spark):
    rows = [(i, "m", "test", float(i), float(i) + 0.5) for i in range(1200)]
    with pytest.raises(ValueError, match="too many"):
        metrics.confusion(spark.createDataFrame(rows, "row_id int, method string, split string, y double, prediction double"))


def test_split_of_an_empty_table(spark):
    train, test = prepare.split(spark.range(0), "id")
    assert train.count() == 0 and test.count() == 0


def test_surrogate_of_many_columns(spark):
    p = 500
    df = spark.range(2).select(F.col("id").alias("instance"), F.array_repeat(F.col("id").cast("double"), p).alias("x"))
    weights = [1.0 if j == 7 else 0.0 for j in range(p)]

    def scorer(rows):
        return rows.withColumn("prediction", F.get("x", F.lit(7)))

    out = explain.local_surrogate(scorer, df, [2.0] * p, [f"x{j}" for j in range(p)], samples=900).collect()
    first = {r.instance: max((r2 for r2 in out if r2.instance == r.instance), key=lambda q: abs(q.weight)) for r in out}
    assert {k: v.feature for k, v in first.items()} == {0: "x7", 1: "x7"} and weights[7] == 1


def test_scores_of_a_failed_model_are_null(spark):
    df = spark.range(50).select(F.col("id").alias("k"), F.col("id").cast("double").alias("a"), F.col("id").cast("double").alias("y"))
    table = models.assemble(df, df, "k", ["a"], "y", "regression")

    def broken(_):
        raise ValueError("x" * 500)

    for fits in ({"ok": models._estimator(lambda t: models.ols()), "broken": broken}, {"broken": broken}):
        rows = models.scores(models.run_all(table, fits), table.task).where("method = 'broken'").collect()
        assert len(rows) == 2 and all(r.mse is None and len(r.error) == 500 for r in rows)
        row = models.evaluate(table, fits, "t").where("method = 'broken'").first()
        assert row.mse_test is None and row.table_name == "t" and len(row.error) == 500


def test_logistic_gradient_vanishes(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"k": range(400), "a": x[:, 0], "b": x[:, 1], "y": y}))
    table = models.assemble(df, df, "k", ["a", "b"], "y", "classification")
    m = models.logistic(table.n_rows).setTol(1e-12).fit(table.train)
    w = m.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ w + m.intercept)))
    assert np.abs(w + x.T @ (p - y)).max() < 1e-3


def test_additive_trees_reduce_residuals_from_the_mean(spark):
    df = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 20).cast("double").alias("y"))
    table = models.assemble(df, df, "k", ["a"], "y", "regression")
    fit = models.additive_trees(table, 6)
    assert fit.base == pytest.approx(9.5) and fit.residuals == sorted(fit.residuals, reverse=True)
    out = fit(table.test).agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    assert out == pytest.approx(fit.residuals[-1])


def test_run_all_keeps_errors(spark):
    df = spark.range(50).select(F.col("id").alias("k"), F.col("id").cast("double").alias("a"), F.col("id").cast("double").alias("y"))
    table = models.assemble(df, df, "k", ["a"], "y", "regression")

    def broken(_):
        raise ValueError("no fit")

    run = models.run_all(table, {"ok": models._estimator(lambda t: models.ols()), "broken": broken})
    report = {r.method: r.error for r in run.report.collect()}
    assert report == {"ok": None, "broken": "no fit"}
    assert {r.method for r in run.predictions.select("method").distinct().collect()} == {"ok"}


def test_lasso_finds_the_linear_surface(spark):
    df = spark.range(800).select(F.col("id").alias("k"), surfaces.normal_columns(12, 3, "id").alias("x"))
    df = df.select("k", *[F.col("x")[j].alias(f"x{j}") for j in range(12)], surfaces.linear_surface(F.col("x"), 12, 3, "k").alias("y"))
    table = models.assemble(df, df, "k", [f"x{j}" for j in range(12)], "y", "regression")
    w = models.lasso(0.1).fit(table.train).coefficients.toArray()
    assert set(np.flatnonzero(np.abs(w) > 0.5)) == set(surfaces.linear_columns(12))


def test_correlated_columns(spark):
    df = spark.range(4000).select(surfaces.correlated_columns(5, 9, "id").alias("x"))
    x = np.array([r.x for r in df.collect()])
    want = 0.9 ** np.abs(np.subtract.outer(np.arange(5), np.arange(5)))
    assert np.abs(np.corrcoef(x.T) - want).max() < 0.05


def test_shapley_values_add_up_for_an_interaction(spark):
    def scorer(df):
        return df.withColumn("prediction", F.col("x")[0] * F.col("x")[1] + F.col("x")[2])

    df = spark.createDataFrame([(i, float(i % 5), float(i % 3), float(i)) for i in range(30)], "k int, a double, b double, c double")
    rows = explain.instances(df, "k", ["a", "b", "c"])
    back = explain.instances(explain.background(df, "k", 7), "k", ["a", "b", "c"])
    got = explain.shapley(scorer, rows, back, ["a", "b", "c"], rounds=3).groupBy("instance").agg(F.sum("phi").alias("s"))
    base = scorer(back).agg(F.avg("prediction")).first()[0]
    for r in scorer(rows).join(got, "instance").collect():
        assert r.s == pytest.approx(r.prediction - base)


def test_local_surrogate_recovers_a_linear_score(spark):
    df = spark.range(5).select(F.col("id").alias("k"), F.col("id").cast("double").alias("a"), F.lit(2.0).alias("b"))
    rows = explain.instances(df, "k", ["a", "b"])
    out = explain.local_surrogate(explain.linear_scorer([3.0, -1.0]), rows, [2.0, 1.0], ["a", "b"], samples=800).toPandas()
    assert np.allclose(out[out.feature == "a"].weight, 6.0, rtol=0.05)
    assert np.allclose(out[out.feature == "b"].weight, -1.0, rtol=0.05)


def test_catalogue(spark, tmp_path):
    with pytest.raises(KeyError):
        catalog.find("nothing")
    assert catalog.find("parkinsons_oxford") is catalog.find("parkinson")
    (tmp_path / "auto_mpg").write_text('18.0   8  307.0  130.0  3504.  12.0  70  1  "chevy malibu"\n15.0 8 350.0 ? 3693. 11.5 70 1 "buick"\n')
    df, target = catalog.load(spark, "auto_mpg", str(tmp_path))
    rows = df.orderBy("mpg").collect()
    assert target == "mpg" and rows[1].car_name == "chevy malibu" and rows[0].horsepower == "?"
    assert dict(df.dtypes)["cylinders"] == "bigint" and dict(df.dtypes)["weight"] == "double"
    tables, errors = catalog.load_all(spark, str(tmp_path))
    assert set(tables) == {"auto_mpg"} and errors.count() == len(catalog.SOURCES) - 1


def test_long_rows_are_skipped_and_short_ones_padded(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a;b;c\n1;2;x\n1;2;x;9\n3;4\n?;5;y\n")
    rows = delimited.read_delimited(spark, str(tmp_path / "t.csv"), ";").collect()
    assert [tuple(r) for r in rows] == [("1", 2, "x"), ("3", 4, None), ("?", 5, "y")]


def test_json_round_trip(spark, tmp_path):
    scores = spark.createDataFrame([("s", 2, 0, "m", 1.0), ("s", 2, 1, "m", 3.0), ("s", 2, 0, "n", None)], "scenario string, p int, rep int, method string, score double")
    sinks.write_json(sinks.nested_results(scores), str(tmp_path / "out"))
    cells = spark.read.json(str(tmp_path / "out")).first().cells
    assert [(m.method, m.n_successful) for m in cells[0].methods] == [("m", 2), ("n", 0)]


def test_a_model_past_its_deadline_becomes_an_error_row(spark):
    df = spark.range(40).select(F.col("id").alias("k"), (F.col("id") % 5).cast("double").alias("a"), F.col("id").cast("double").alias("y"))
    table = models.assemble(df, df, "k", ["a"], "y", "regression")

    def endless(t):
        while True:
            spark.range(0, 10**11, 1, 2).selectExpr("sum(hash(id, id + 1))").collect()

    run = models.run_all(table, {"late": endless, "ok": models._estimator(lambda t: models.ols())}, deadline=8)
    rows = {r.method: r for r in run.report.collect()}
    assert rows["late"].error == "not fitted within 8 seconds" and rows["late"].seconds < 60 and rows["ok"].error is None
    assert {r.method for r in run.predictions.select("method").distinct().collect()} == {"ok"}


@pytest.mark.parametrize("classes", [2, 3])
def test_l1_logistic_reaches_the_optimum(spark, classes):
    """No weight can be moved either way, and useless columns have none."""
    from tabscale.operators import logit

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6))
    c = np.digitize(x[:, 0] + 0.5 * x[:, 1] + rng.normal(0, 0.5, 300), [-0.5, 0.5] if classes == 3 else [0.0])
    rows = spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, c))], "row_id int, x array<double>, c int").repartition(3)
    found = logit.fit(rows, classes, c=0.2)
    wide = np.column_stack([x, np.ones(300)])

    def objective(k, w):
        y = np.where(c == k, 1.0, -1.0)
        return np.abs(w).sum() + 0.2 * np.logaddexp(0, -y * (wide @ w)).sum()

    for k, w, value in zip(found.classes, found.w, found.objective, strict=True):
        assert value == pytest.approx(objective(k, w))
        assert all(objective(k, w + s * e) >= value - 1e-7 for e in np.eye(7) for s in (1e-3, -1e-3, 0.1, -0.1))
        assert (w == 0).sum() >= 2
    out = logit.decision(found, rows)
    assert out.agg(F.avg((F.col("c") == F.col("prediction")).cast("int"))).first()[0] > 0.7


def _products(df):
    x = F.col("x")
    return df.withColumn("prediction", x[0] * x[1] + 2 * x[2] - x[3] * x[0] * x[2] + sum(x[j] for j in range(4, 7)))


def test_kernel_values_equal_the_definition_and_add_up(spark):
    """All coalitions against the definition; a sample of them adds up and comes near."""
    from itertools import combinations
    from math import factorial

    rng = np.random.default_rng(0)
    p, names = 7, [f"f{j}" for j in range(7)]
    x, back = rng.normal(size=(4, p)), rng.normal(size=(5, p))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "instance int, x array<double>")
    behind = spark.createDataFrame([(v.tolist(),) for v in back], "x array<double>")
    f = lambda z: z[:, 0] * z[:, 1] + 2 * z[:, 2] - z[:, 3] * z[:, 0] * z[:, 2] + z[:, 4:].sum(1)

    def worth(i, chosen):
        z = back.copy()
        z[:, list(chosen)] = x[i, list(chosen)]
        return f(z).mean()

    def exact(i, j):
        others = [k for k in range(p) if k != j]
        return sum(
            factorial(n) * factorial(p - n - 1) / factorial(p) * (worth(i, (*s, j)) - worth(i, s)) for n in range(p) for s in combinations(others, n))

    whole = {(r.instance, r.feature): r for r in explain.kernel_shapley(_products, rows, behind, names).collect()}
    for i in range(4):
        for j in range(p):
            assert whole[i, names[j]].phi == pytest.approx(exact(i, j), abs=1e-9) and whole[i, names[j]].error == 0
    part = explain.kernel_shapley(_products, rows, behind, names, most=80).collect()
    assert all(r.error > 0 for r in part)
    assert max(abs(r.phi - whole[r.instance, r.feature].phi) / r.error for r in part) < 6
    for i in range(4):
        assert sum(r.phi for r in part if r.instance == i) == pytest.approx(float(f(x[i:i + 1])[0] - f(back).mean()))
