"""Comparison models on Spark ML, all giving long prediction tables.

Training and test rows carry ``row_id``, ``y`` and the assembled ``features``.
"""

from __future__ import annotations

import math
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from . import boosting as boosts
from . import forest, logit
from .profile import CLASSIFICATION, REGRESSION

OUT = ["row_id", "y", "prediction"]

@dataclass
class Table:
    """A training and a test part, assembled once and kept for all models."""

    train: DataFrame
    test: DataFrame
    task: str
    n_rows: int
    n_features: int
    n_classes: int
    y_spread: float


def assemble(train: DataFrame, test: DataFrame, key: str, features: list[str], target: str, task: str) -> Table:
    assembler = VectorAssembler(inputCols=features, outputCol="features")

    def ready(df):
        y = col(target).cast("double").alias("y")
        # Both parts are read by every model and pass of every solver.
        return assembler.transform(df.select(col(key).alias("row_id"), y, *[col(f).cast("double").alias(f) for f in features])).select(
            "row_id", "y", "features").persist()

    fitted = ready(train)
    n, spread, top = fitted.agg(F.count(F.lit(1)), F.stddev_pop("y"), F.max("y")).first()
    return Table(fitted, ready(test), task, n, len(features), int(top) + 1 if task == CLASSIFICATION else 0, spread)


# --- linear models -----------------------------------------------------------------------------


def ols() -> LinearRegression:
    return LinearRegression(labelCol="y", regParam=0.0)


def ridge(alpha: float, n_rows: int, y_spread: float) -> LinearRegression:
    """Penalty alpha |w|^2 on the sum of squares.

    Spark's loss is the mean and it divides the L2 penalty by the label's
    spread, hence the factor.
    """
    return LinearRegression(
        labelCol="y", elasticNetParam=0.0, regParam=alpha * y_spread / n_rows, standardization=False)


def lasso(alpha: float) -> LinearRegression:
    """Penalty alpha |w| on half the mean square."""
    return LinearRegression(labelCol="y", elasticNetParam=1.0, regParam=alpha, standardization=False, maxIter=500, tol=1e-10)


def logistic(n_rows: int, c: float = 1.0) -> LogisticRegression:
    """L2 penalty on the weights against ``c`` times the summed loss; the intercept is free."""
    return LogisticRegression(labelCol="y", regParam=1.0 / (c * n_rows), elasticNetParam=0.0, standardization=False, maxIter=1000)


def l1_logistic(table: Table, c: float = 1.0) -> Callable[[DataFrame], DataFrame]:
    """One class against the rest, the intercept penalised like the weights."""
    weights = logit.fit(_array_rows(table.train, table.task), table.n_classes, c)

    def predict(df: DataFrame) -> DataFrame:
        return logit.decision(weights, _array_rows(df, table.task)).select("row_id", F.col("c").cast("double").alias("y"), "prediction")

    return predict


# --- tree ensembles ------------------------------------------------------------------------------


def boosting(task: str, trees: int = 50, depth: int = 3, step: float = 0.1, seed: int = 42):
    """Boosting of numbers, or of two classes."""
    kind = GBTRegressor if task == REGRESSION else GBTClassifier
    return kind(labelCol="y", maxIter=trees, maxDepth=depth, stepSize=step, seed=seed)


def boosted(table: Table, trees: int = 50, depth: int = 3, step: float = 0.1, seed: int = 42) -> Callable[[DataFrame], DataFrame]:
    """Boosting; several classes share their stages, one tree per class."""
    if table.task == REGRESSION or table.n_classes <= 2:
        return _estimator(lambda t: boosting(t.task, trees, depth, step, seed))(table)
    model = boosts.multinomial(_array_rows(table.train, table.task), table.n_classes, trees, depth, step, seed)

    def predict(df: DataFrame) -> DataFrame:
        scored = model.scored(_array_rows(df, table.task))
        return scored.select("row_id", F.col("c").cast("double").alias("y"), boosts.class_of(F.col("score")).alias("prediction"))

    return predict


def _array_rows(df: DataFrame, task: str, columns: list[int] | None = None) -> DataFrame:
    x = vector_to_array("features")
    if columns is not None:
        x = F.transform(F.array(*[F.lit(i) for i in columns]), lambda i: F.get(x, i))
    if task == CLASSIFICATION:
        return df.select("row_id", x.alias("x"), F.col("y").cast("int").alias("c"), F.lit(1.0).alias("y"))
    return df.select("row_id", x.alias("x"), F.lit(0).alias("c"), "y")


def extra_trees(table: Table, trees: int = 50, depth: int | None = None, seed: int = 42) -> Callable[[DataFrame], DataFrame]:
    """Extremely randomised trees, without bootstrap."""
    grown, _ = forest.grow(
        _array_rows(table.train, table.task), table.task, [(1, 0.0)] * trees, max_depth=depth, seed=seed, random_cuts=True)
    return lambda df: _forest_predictions(grown, df, table.task)


def _forest_predictions(grown: forest.Forest, df: DataFrame, task: str, columns: list[int] | None = None) -> DataFrame:
    out = forest.predict(grown, _array_rows(df, task, columns))
    y = F.col("c").cast("double").alias("y") if task == CLASSIFICATION else F.col("y")
    return out.select("row_id", y, "prediction")


def grow_exact(
    table: Table, trees: int = 50, depth: int | None = None, seed: int | str = 42, tried: int | None = None, split_from: int = 2,
    columns: list[int] | None = None,
) -> forest.Forest:
    """Bootstrapped trees that try every threshold of ``tried`` columns, split from ``split_from`` rows on."""
    return forest.grow(
        _array_rows(table.train, table.task, columns), table.task, [(1, 0.0)] * trees, max_depth=depth, seed=seed, exact=True,
        tried=tried, split_from=split_from)[0]


def random_forest(table: Table, trees: int = 50, depth: int | None = None, seed: int = 42) -> Callable[[DataFrame], DataFrame]:
    grown = grow_exact(table, trees, depth, seed)
    return lambda df: _forest_predictions(grown, df, table.task)


def muted_forest(
    table: Table, trees: int = 100, k: int = 1, rate: float = 0.5, depth: int = forest.MAX_LEVELS, trials: int = 100, seed: int = 42
) -> Callable[[DataFrame], DataFrame]:
    grown, _ = forest.grow(
        _array_rows(table.train, table.task), table.task, [(k, rate)] * trees, max_depth=depth, trials=trials, seed=seed)
    return lambda df: _forest_predictions(grown, df, table.task)


def adapted_width(p: int, kind: str) -> int:
    """Columns kept by the adapted forest: the log or the root of all."""
    if kind == "log_p":
        return max(1, int(math.log(p)))
    if kind == "sqrt_p":
        return max(1, int(math.sqrt(p)))
    raise ValueError(f"unknown adaptation {kind}")


def adapted_forest(table: Table, kind: str, trees: int = 50, depth: int | None = None, seed: int = 42):
    """A forest on the most important columns of a first forest."""
    rated = {r.feature: r.importance for r in forest.gain_importance(grow_exact(table, trees, depth, seed)).collect()}
    keep = sorted(range(table.n_features), key=lambda i: (-rated[i], i))[: adapted_width(table.n_features, kind)]
    second = grow_exact(table, trees, depth, seed + 1, columns=keep)
    return lambda df: _forest_predictions(second, df, table.task, keep)


def naive_forest(table: Table, features_importance: list[float], rate: float, trees: int = 100, depth: int | None = None, seed: int = 42):
    """A forest on the columns with the strongest marginal signal; nodes are split from the smallest size on."""
    p = table.n_features
    keep = sorted(range(p), key=lambda i: (features_importance[i], i))[-forest.marginal_keep(p, rate):]
    grown = grow_exact(
        table, trees, depth, seed, min(forest.naive_subset(p, rate), len(keep)), max(2, forest.smallest_node(table.n_rows)), keep)
    return lambda df: _forest_predictions(grown, df, table.task, keep)


# --- additive trees ---------------------------------------------------------------------------------


def bart_base(mean: Column, task: str) -> Column:
    """Start of the sum: the mean, or the log odds of the positive class."""
    return mean if task == REGRESSION else F.ln(mean / (1 - mean + F.lit(1e-8)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-500.0)), F.lit(500.0))))


@dataclass
class AdditiveTrees:
    task: str
    model: boosts.Boosted
    residuals: list[float]  # mean absolute residual after each tree

    @property
    def base(self) -> float:
        return self.model.base[0]

    def score(self, df: DataFrame) -> DataFrame:
        scored = self.model.scored(_array_rows(df, self.task), "_sums")
        y = F.col("c").cast("double").alias("y") if self.task == CLASSIFICATION else F.col("y")
        return scored.select("row_id", y, F.get("_sums", F.lit(0)).alias("score"))

    def __call__(self, df: DataFrame) -> DataFrame:
        value = F.col("score") if self.task == REGRESSION else (sigmoid(F.col("score")) > 0.5).cast("double")
        return self.score(df).withColumn("prediction", value).select(*OUT)

    def probabilities(self, df: DataFrame) -> DataFrame:
        p = sigmoid(F.col("score"))
        return self.score(df).select("row_id", (1 - p).alias("p_0"), p.alias("p_1"))


def additive_trees(table: Table, trees: int = 20, depth: int = 2, shrinkage: float = 0.1, seed: int = 42) -> AdditiveTrees:
    """Shallow exact trees on the residuals, each added at the shrinkage rate.

    A node is split from a twentieth of the rows on (five at least).
    """
    base = table.train.agg(bart_base(F.avg("y"), table.task)).first()[0]
    regression = table.task == REGRESSION

    def residual(score: np.ndarray, c: np.ndarray, y: np.ndarray) -> np.ndarray:
        if regression:
            return y[:, None] - score
        return c[:, None] - 1 / (1 + np.exp(-np.clip(score, -500.0, 500.0)))

    residuals: list[float] = []
    model = boosts.fit(
        _array_rows(table.train, table.task), [base], residual, trees, depth, shrinkage,
        split_from=max(5, table.n_rows // 20), seed=seed, sizes=residuals)
    return AdditiveTrees(table.task, model, residuals)


# --- running many models ---------------------------------------------------------------------------------

Fit = Callable[[Table], Callable[[DataFrame], DataFrame]]


def _estimator(make: Callable[[Table], object]) -> Fit:
    def fit(table: Table):
        model = make(table).fit(table.train)
        return lambda df: model.transform(df).select(*OUT)

    return fit


def competitors(task: str, trees: int = 50, depth: int | None = None, seed: int = 42) -> dict[str, Fit]:
    """The seven competitors by name."""
    linear = _estimator(lambda t: lasso(1.0)) if task == REGRESSION else l1_logistic
    return {
        "Random_Forest": lambda t: random_forest(t, trees, depth, seed),
        "RF-log(p)": lambda t: adapted_forest(t, "log_p", trees, depth, seed),
        "RF-√p": lambda t: adapted_forest(t, "sqrt_p", trees, depth, seed),
        "GradientBoosting": lambda t: boosted(t, trees, seed=seed),
        "ExtraTrees": lambda t: extra_trees(t, trees, depth, seed),
        "Lasso": linear,
        "BART": lambda t: additive_trees(t, seed=seed),
    }


def baselines(task: str, trees: int = 50, depth: int | None = None, seed: int = 42) -> dict[str, Fit]:
    """Standard models: linear ones and ensembles."""
    ensembles = {
        "Random Forest": lambda t: random_forest(t, trees, depth, seed),
        "Gradient Boosting": lambda t: boosted(t, trees, seed=seed),
        "Extra Trees": lambda t: extra_trees(t, trees, depth, seed),
    }
    if task == REGRESSION:
        return {
            "Linear Regression": _estimator(lambda t: ols()),
            "Ridge (1)": _estimator(lambda t: ridge(1.0, t.n_rows, t.y_spread)),
            "Ridge (10)": _estimator(lambda t: ridge(10.0, t.n_rows, t.y_spread)),
            "Lasso (0.1)": _estimator(lambda t: lasso(0.1)),
            **ensembles,
        }
    return {
        "Logistic Regression": _estimator(lambda t: logistic(t.n_rows)),
        "Logistic Regression (L1)": l1_logistic,
        **ensembles,
    }


@dataclass
class Run:
    predictions: DataFrame | None  # (row_id, method, split, y, prediction)
    report: DataFrame              # (method, seconds, error)


def run_all(table: Table, fits: dict[str, Fit], threads: int = 3, deadline: float | None = None) -> Run:
    """Fit every model, a few at a time; a failure is kept as text.

    Each model has a scheduler pool and a job group of its own, so that in a session with the
    FAIR mode a long fit does not hold up the others. A model that is not fitted
    within ``deadline`` seconds is cancelled with all its jobs and keeps its row as failed.
    """
    context = table.train.sparkSession.sparkContext
    run = uuid.uuid4().hex

    def one(name: str, fit: Fit):
        group, late = f"fit-{run}-{name}", threading.Event()

        def stop() -> None:
            late.set()
            context._jsc.sc().cancelJobGroupAndFutureJobs(group)

        timer = threading.Timer(deadline, stop) if deadline is not None else None
        context.setJobGroup(group, f"fit {name}", interruptOnCancel=True)
        context.setLocalProperty("spark.scheduler.pool", name)
        start = time.time()
        try:
            if timer is not None:
                timer.start()
            model = fit(table)
            return (name, None, time.time() - start, _late(deadline)) if late.is_set() else (name, model, time.time() - start, None)
        except Exception as error:  # one failed model must not lose the others
            return name, None, time.time() - start, _late(deadline) if late.is_set() else str(error)
        finally:
            if timer is not None:
                timer.cancel()
            for key in ("spark.scheduler.pool", "spark.jobGroup.id", "spark.job.description"):
                context.setLocalProperty(key, None)

    with ThreadPoolExecutor(threads) as pool:
        results = list(pool.map(lambda item: one(*item), fits.items()))
    out = None
    for name, model, _, _ in results:
        if model is None:
            continue
        for split, part in (("train", table.train), ("test", table.test)):
            rows = model(part).select("row_id", F.lit(name).alias("method"), F.lit(split).alias("split"), "y", "prediction")
            out = rows if out is None else out.unionByName(rows)
    report = table.train.sparkSession.createDataFrame(
        [(n, s, e) for n, _, s, e in results], "method string, seconds double, error string")
    return Run(out, report)


def _late(deadline: float | None) -> str:
    return f"not fitted within {deadline:g} seconds"


def scores(run: Run, task: str) -> DataFrame:
    """One row per method and split with its metrics, its seconds and, if it failed, null metrics and the error."""
    from .metrics import accuracy, regression_metrics

    names = ["mse", "rmse", "mae", "r2"] if task == REGRESSION else ["accuracy", "error_rate"]
    report = run.report.select("method", F.explode(F.array(F.lit("train"), F.lit("test"))).alias("split"), "seconds", "error")
    if run.predictions is None:
        return report.select("method", "split", *[F.lit(None).cast("double").alias(n) for n in names], "seconds", "error")
    found = regression_metrics(run.predictions) if task == REGRESSION else accuracy(run.predictions).withColumnRenamed("error", "error_rate")
    # The report has two rows per method.
    return report.join(F.broadcast(found), ["method", "split"], "left").select("method", "split", *names, "seconds", "error")


def best_configuration(evaluated: DataFrame, task: str, prefix: str = "MF") -> DataFrame:
    """The muted-forest configuration with the best test metric (the first name on a tie)."""
    metric = "mse_test" if task == REGRESSION else "accuracy_test"
    order = F.asc_nulls_last(metric) if task == REGRESSION else F.desc_nulls_last(metric)
    return evaluated.where(F.col("method").startswith(prefix) & F.col(metric).isNotNull()).orderBy(order, "method").limit(1)


def evaluate(table: Table, fits: dict[str, Fit], name: str = "table") -> DataFrame:
    """One row per method: train and test metric, performance relative to the best, seconds, error.

    A method that fails keeps its row, with null metrics and the whole error text.
    """
    from .compare import relative_performance
    from .metrics import accuracy, regression_metrics

    run = run_all(table, fits)
    regression = table.task == REGRESSION
    metric = "mse" if regression else "accuracy"
    if run.predictions is None:
        return run.report.select(
            "method", "seconds", "error", F.lit(name).alias("table_name"),
            *[F.lit(None).cast("double").alias(c) for c in (f"{metric}_train", f"{metric}_test", "relative_performance")])
    scored = (regression_metrics if regression else accuracy)(run.predictions)
    wide = scored.groupBy("method").pivot("split", ["train", "test"]).agg(F.first(metric))
    wide = wide.select(F.lit(name).alias("table_name"), "method", F.col("train").alias(f"{metric}_train"), F.col("test").alias(f"{metric}_test"))
    # The report has one row per method.
    return run.report.join(relative_performance(wide, table.task), "method", "left").withColumn("table_name", F.lit(name))


def evaluate_many(tables: dict[str, Callable[[], Table]], fits: Callable[[str], dict[str, Fit]]) -> DataFrame:
    """``evaluate`` for several tables; a table that fails is reported by its error."""
    out = None
    for name, make in tables.items():
        try:
            table = make()
            rows = evaluate(table, fits(table.task), name)
            metric = "mse_test" if table.task == REGRESSION else "accuracy_test"
            rows = rows.select(
                F.lit(name).alias("table_name"), F.lit(table.task).alias("task"), "method", F.col(metric).alias("value"),
                "relative_performance", F.col("error"))
        except Exception as error:
            from pyspark.sql import SparkSession

            rows = SparkSession.active().createDataFrame(
                [(name, None, None, None, None, str(error))],
                "table_name string, task string, method string, value double, relative_performance double, error string")
        out = rows if out is None else out.unionByName(rows)
    return out
