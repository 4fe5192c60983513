"""Comparison models on orders joined with customers, and on events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rand import hash_uniform
from ..operators import boosting, forest, logit, models, prepare
from . import fixtures as fx
from .forest_queries import MARGINAL_SQL, SURFACE_COLUMNS, marginal, surface_table
from .profile_queries import union
from .registry import query

TEXTS = ["c_mktsegment", "n_name", "o_orderpriority"]
FEATURES = ["c_acctbal", *TEXTS]


def _split(df, key):
    return prepare.split_fraction(df, key, 0.7, seed=7)


def surface(spark, sf):
    """Events with hash columns; the target depends on columns 2 and 5."""
    return models.assemble(*_split(surface_table(spark, sf), "event_id"), "event_id", SURFACE_COLUMNS, "t", "regression")


def orders(spark, sf):
    df = prepare.encode_missing(fx.joined(spark, sf), TEXTS)
    return models.assemble(*_split(df, "o_orderkey"), "o_orderkey", FEATURES, "o_totalprice", "regression")


def flags(spark, sf):
    """Three classes of the surface by thirds of its relevant column."""
    df = surface_table(spark, sf).withColumn("cls", F.floor(F.col("x2") * F.col("x2") * 3))
    return models.assemble(*_split(df, "event_id"), "event_id", SURFACE_COLUMNS, "cls", "classification")


def halves(spark, sf):
    df = surface_table(spark, sf).withColumn("cls", (F.col("t") > 1).cast("int"))
    return models.assemble(*_split(df, "event_id"), "event_id", SURFACE_COLUMNS, "cls", "classification")


# --- linear models of one feature: closed forms ---------------------------------------------

LINE_FIT = "SELECT regr_slope(l_extendedprice, l_quantity) AS b, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_sxy(l_extendedprice, l_quantity) AS sxy, count(*) AS n FROM lineitem"


def _coefficients(spark, sf, model):
    table = _line(spark, sf)
    fitted = model(table).fit(table.train)
    # One row per model: its two numbers, next to the rows it was fitted on.
    return table.train.agg(
        F.count(F.lit(1)).alias("n"), F.first(F.lit(float(fitted.coefficients[0]))).alias("coefficient"),
        F.first(F.lit(float(fitted.intercept))).alias("intercept"))


def _line(spark, sf):
    df = fx.line(spark, sf)
    return models.assemble(df, df, "row_id", ["l_quantity"], "l_extendedprice", "regression")


@query("ml_ols", f"SELECT n, b AS coefficient, my - b * mx AS intercept FROM ({LINE_FIT})", "coefficient:4 intercept:3")
def ml_ols(spark, sf):
    return _coefficients(spark, sf, lambda t: models.ols())


@query("ml_ridge", f"SELECT n, sxy / (sxx + 10) AS coefficient, my - sxy / (sxx + 10) * mx AS intercept FROM ({LINE_FIT})", "coefficient:4 intercept:3")
def ml_ridge(spark, sf):
    return _coefficients(spark, sf, lambda t: models.ridge(10.0, t.n_rows, t.y_spread))


SOFT = "sign(sxy) * greatest(abs(sxy / n) - 1.0, 0) / (sxx / n)"


@query("ml_lasso", f"SELECT n, {SOFT} AS coefficient, my - {SOFT} * mx AS intercept FROM ({LINE_FIT})", "coefficient:4 intercept:3")
def ml_lasso(spark, sf):
    return _coefficients(spark, sf, lambda t: models.lasso(1.0))


@query("ml_ols_predict", f"""SELECT row_id, l_extendedprice AS y, my + b * (l_quantity - mx) AS prediction FROM ({fx.LINE_SQL}), ({LINE_FIT})""", "prediction:3")
def ml_ols_predict(spark, sf):
    table = _line(spark, sf)
    return models.ols().fit(table.train).transform(table.train).select(*models.OUT)


def _scored(table, fit, name):
    return models.scores(models.run_all(table, {name: fit}), table.task).drop("seconds")


@query("ml_logit")
def ml_logit(spark, sf):
    return _scored(halves(spark, sf), models._estimator(lambda t: models.logistic(t.n_rows)), "Logistic")


@query("ml_logit_l1")
def ml_logit_l1(spark, sf):
    return _scored(flags(spark, sf), models.l1_logistic, "Logistic L1")


@query("ml_logit_l1_optimal", f"""SELECT CAST(c AS INTEGER) AS class, CAST(j AS INTEGER) AS coefficient, true AS holds
FROM range(3) AS t(c), range({len(SURFACE_COLUMNS) + 1}) AS u(j), (SELECT count(*) AS n FROM events) WHERE n > 0""")
def ml_logit_l1_optimal(spark, sf):
    """The conditions that only optimal weights meet, from sums over the training rows: the
    gradient is at most 1 where a weight is zero, and minus the weight's sign elsewhere."""
    table = flags(spark, sf)
    rows = models._array_rows(table.train, table.task)
    weights = logit.fit(rows, table.n_classes)
    cells = []
    for k, w in zip(weights.classes, weights.w, strict=True):
        x = [*[F.get("x", F.lit(i)) for i in range(len(w) - 1)], F.lit(1.0)]
        y = F.when(F.col("c") == k, 1.0).otherwise(-1.0)
        score = sum((F.lit(float(v)) * e for v, e in zip(w, x, strict=True)), F.lit(0.0))
        pull = -y / (1 + F.exp(y * score))
        for j, v in enumerate(w):
            g = F.sum(pull * x[j])
            met = (F.abs(g) <= 1 + 1e-3) if v == 0 else (F.abs(g + (1.0 if v > 0 else -1.0)) <= 1e-3)
            cells.append(F.struct(F.lit(k).alias("class"), F.lit(j).alias("coefficient"), met.alias("holds")))
    return rows.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


@query("ml_rf")
def ml_rf(spark, sf):
    return _scored(orders(spark, sf), models.random_forest, "Random_Forest")


@query("ml_rf_cls")
def ml_rf_cls(spark, sf):
    return _scored(flags(spark, sf), models.random_forest, "Random_Forest")


@query("ml_gbt")
def ml_gbt(spark, sf):
    return _scored(surface(spark, sf), models.boosted, "GradientBoosting")


@query("ml_gbt_cls")
def ml_gbt_cls(spark, sf):
    return _scored(flags(spark, sf), models.boosted, "GradientBoosting")


@query("ml_extra_trees")
def ml_extra_trees(spark, sf):
    return _scored(surface(spark, sf), models.extra_trees, "ExtraTrees")


@query("ml_adapted_rf")
def ml_adapted_rf(spark, sf):
    table = surface(spark, sf)
    run = models.run_all(table, {k: (lambda t, k=k: models.adapted_forest(t, k)) for k in ("log_p", "sqrt_p")})
    return models.scores(run, table.task).drop("seconds")


# --- exact splits and boosting stages: every threshold tried in SQL ---------------------------

LINE_CELLS = union(f"SELECT {j} AS j, {f} AS v, l_extendedprice AS y FROM lineitem" for j, f in enumerate(fx.LINE_FEATURES))


def _split_nodes(model):
    return model.nodes().select("node", "n", "value", F.get("fs", F.lit(0)).alias("feature"), "threshold")


@query("ml_exact_split_reg", f"""WITH cells AS (SELECT j, v, count(*) AS n, sum(y) AS s FROM ({LINE_CELLS}) GROUP BY ALL),
run AS (SELECT j, v, lead(v) OVER o AS above, sum(n) OVER o AS nl, sum(s) OVER o AS sl, sum(n) OVER (PARTITION BY j) AS nt, sum(s) OVER (PARTITION BY j) AS st
  FROM cells WINDOW o AS (PARTITION BY j ORDER BY v)),
best AS (SELECT *, sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) AS gain FROM run WHERE above IS NOT NULL ORDER BY gain DESC, j, v LIMIT 1)
SELECT CAST(1 AS BIGINT) AS node, CAST(nt AS BIGINT) AS n, st / nt AS value, CAST(j AS INTEGER) AS feature, v + (above - v) / 2 AS threshold FROM best
UNION ALL SELECT 2, CAST(nl AS BIGINT), sl / nl, NULL, NULL FROM best UNION ALL SELECT 3, CAST(nt - nl AS BIGINT), (st - sl) / (nt - nl), NULL, NULL FROM best""",
       "value:4 threshold")
def ml_exact_split_reg(spark, sf):
    """The first split of a tree that tries every threshold; more rows than one task takes go by running sums."""
    rows = forest.to_rows(fx.line(spark, sf), "row_id", fx.LINE_FEATURES, "l_extendedprice", "regression")
    model, _ = forest.grow(rows, "regression", [(1, 0.0)], exact=True, bootstrap=False, max_depth=1)
    return _split_nodes(model)


WIDE_CELLS = f"SELECT unnest(range({fx.WIDE_DIM})) AS j, CAST(unnest(embedding) AS DOUBLE) AS v, label AS c FROM embeddings"


@query("ml_exact_split_cls", f"""WITH cells AS (SELECT j, v, c, count(*) AS n FROM ({WIDE_CELLS}) GROUP BY ALL),
grid AS (SELECT j, v, c, coalesce(n, 0) AS n FROM (SELECT DISTINCT j, v FROM cells) CROSS JOIN (SELECT DISTINCT label AS c FROM embeddings) LEFT JOIN cells USING (j, v, c)),
run AS (SELECT j, v, c, sum(n) OVER (PARTITION BY j, c ORDER BY v) AS l, sum(n) OVER (PARTITION BY j, c) AS t FROM grid),
scored AS (SELECT j, v, sum(l) AS nl, sum(t) AS nt, sum(l * l) / sum(l) + sum((t - l) * (t - l)) / nullif(sum(t - l), 0) AS gain, lead(v) OVER (PARTITION BY j ORDER BY v) AS above FROM run GROUP BY j, v),
best AS (SELECT * FROM scored WHERE above IS NOT NULL ORDER BY gain DESC, j, v LIMIT 1),
sides AS (SELECT 1 AS node, c, t AS n FROM run JOIN best USING (j, v) UNION ALL SELECT 2, c, l FROM run JOIN best USING (j, v) UNION ALL SELECT 3, c, t - l FROM run JOIN best USING (j, v))
SELECT CAST(node AS BIGINT) AS node, CAST(sum(n) AS BIGINT) AS n, arg_min(c, (-n, c))::DOUBLE AS value,
  CASE WHEN node = 1 THEN CAST((SELECT j FROM best) AS INTEGER) END AS feature, CASE WHEN node = 1 THEN (SELECT v + (above - v) / 2 FROM best) END AS threshold
FROM sides GROUP BY node""", "value threshold")
def ml_exact_split_cls(spark, sf):
    rows = forest.to_rows(fx.wide(spark, sf), "vec_id", fx.WIDE_FEATURES, "label", "classification")
    model, _ = forest.grow(rows, "classification", [(1, 0.0)], exact=True, bootstrap=False, max_depth=1, tried=fx.WIDE_DIM)
    return _split_nodes(model)


@query("ml_gbt_stage", f"""WITH prior AS (SELECT label AS k, count(*) / (SELECT count(*) FROM embeddings)::DOUBLE AS p, (SELECT count(DISTINCT label) FROM embeddings) AS n_classes FROM embeddings GROUP BY label),
u AS (SELECT k, n_classes, j, v, (c = k)::INTEGER - p AS r FROM ({WIDE_CELLS}) CROSS JOIN prior),
cells AS (SELECT k, any_value(n_classes) AS n_classes, j, v, count(*) AS n, sum(r) AS s, sum(abs(r) * (1 - abs(r))) AS h FROM u GROUP BY k, j, v),
run AS (SELECT k, n_classes, j, v, lead(v) OVER o AS above, sum(n) OVER o AS nl, sum(s) OVER o AS sl, sum(h) OVER o AS hl, sum(n) OVER w AS nt, sum(s) OVER w AS st, sum(h) OVER w AS ht
  FROM cells WINDOW o AS (PARTITION BY k, j ORDER BY v), w AS (PARTITION BY k, j)),
best AS (SELECT *, sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) AS gain FROM run WHERE above IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY gain DESC, j, v) = 1)
SELECT CAST(k AS INTEGER) AS class, ln(p) AS log_prior, CAST(j AS INTEGER) AS feature, v + (above - v) / 2 AS threshold, CAST(nl AS BIGINT) AS n_left,
  (best.n_classes - 1) / best.n_classes::DOUBLE * sl / hl AS value_left, (best.n_classes - 1) / best.n_classes::DOUBLE * (st - sl) / (ht - hl) AS value_right
FROM best JOIN prior USING (k)""", "log_prior threshold value_left value_right")
def ml_gbt_stage(spark, sf):
    """The first stage of boosting for several classes: log priors, and one split per class with Newton leaves."""
    rows = forest.to_rows(fx.wide(spark, sf), "vec_id", fx.WIDE_FEATURES, "label", "classification")
    classes = rows.agg(F.max("c")).first()[0] + 1
    model = boosting.multinomial(rows, classes, stages=1, depth=1)
    priors = spark.createDataFrame(list(enumerate(model.base)), "class int, log_prior double")
    nodes = spark.createDataFrame(model.stages[0])
    side = {s: nodes.select("tree", F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("value").alias(f"value_{s}")) for s in ("left", "right")}
    split = nodes.where("node = 1").join(side["left"], ["tree", "left"]).join(side["right"], ["tree", "right"])
    return split.join(priors, split.tree == priors["class"]).select(
        "class", "log_prior", F.get("fs", F.lit(0)).alias("feature"), "threshold", "n_left", "value_left", "value_right")


@query("ml_adapted_k", union(
    f"SELECT '{kind}' AS kind, CAST(greatest(1, floor({fn}(len(embedding)))) AS INTEGER) AS k, count(*) AS n FROM embeddings GROUP BY ALL"
    for kind, fn in [("log_p", "ln"), ("sqrt_p", "sqrt")]))
def ml_adapted_k(spark, sf):
    df = fx.wide(spark, sf)
    p = len(df.columns) - 2
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.inline(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(models.adapted_width(p, kind)).alias("k"), "n") for kind in ("log_p", "sqrt_p")])))


@query("ml_bart_reg")
def ml_bart_reg(spark, sf):
    fitted = models.additive_trees(surface(spark, sf))
    return spark.createDataFrame(list(enumerate(fitted.residuals)), "stage int, mean_abs_residual double")


@query("ml_bart_cls")
def ml_bart_cls(spark, sf):
    table = halves(spark, sf)
    fitted = models.additive_trees(table)
    return fitted(table.test).join(fitted.probabilities(table.test), "row_id")


@query("bart_base", f"""SELECT avg(l_extendedprice) AS regression, (SELECT ln(avg(quality) / (1 - avg(quality) + 1e-8::DOUBLE)) FROM ({fx.IMBAL_SQL})) AS classification FROM lineitem""",
       "regression:4 classification")
def bart_base(spark, sf):
    reg = fx.table(spark, sf, "lineitem").agg(models.bart_base(F.avg("l_extendedprice"), "regression").alias("regression"), F.first(F.lit(1)).alias("k"))
    cls = fx.imbalanced(spark, sf).agg(models.bart_base(F.avg("quality"), "classification").alias("classification"), F.first(F.lit(1)).alias("k"))
    return reg.join(cls, "k").drop("k")


@query("bart_sigmoid", "SELECT event_id, 1 / (1 + exp(-least(greatest((value - 40) * 2, -500), 500))) AS p FROM events", "p")
def bart_sigmoid(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", models.sigmoid((F.col("value") - 40) * 2).alias("p"))


@query("ml_run_all")
def ml_run_all(spark, sf):
    return models.scores(models.run_all(surface(spark, sf), models.competitors("regression")), "regression").drop("seconds")


@query("ml_run_all_cls")
def ml_run_all_cls(spark, sf):
    return models.scores(models.run_all(halves(spark, sf), models.competitors("classification")), "classification").drop("seconds")


@query("ml_baselines")
def ml_baselines(spark, sf):
    return models.scores(models.run_all(halves(spark, sf), models.baselines("classification")), "classification").drop("seconds")


@query("ml_baselines_reg")
def ml_baselines_reg(spark, sf):
    return models.scores(models.run_all(surface(spark, sf), models.baselines("regression")), "regression").drop("seconds")


@query("rf_naive")
def rf_naive(spark, sf):
    df = fx.wide(spark, sf)
    table = models.assemble(*_split(df, "vec_id"), "vec_id", fx.WIDE_FEATURES, "label", "classification")
    # Columns are rated on the training part alone.
    train = _split(df, "vec_id")[0]
    rated = forest.importance_array(forest.marginal_importance(train, fx.WIDE_FEATURES, "label")).first()[0]
    return _scored(table, lambda t: models.naive_forest(t, rated, 0.5), "naive")


@query("rf_naive_subset", f"""SELECT CAST(feature AS INTEGER) AS feature, importance, CAST(greatest(1, least(floor(n * 0.5), floor(sqrt(n)))) AS INTEGER) AS tried
FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY importance DESC, feature DESC) AS place FROM ({MARGINAL_SQL})) WHERE place <= greatest(1, floor(n * 0.5))""", "importance")
def rf_naive_subset(spark, sf):
    """The columns that the marginal variant keeps, and how many it tries per split."""
    rows = marginal(spark, sf)
    p = rows.count()
    return forest.top_features(rows, forest.marginal_keep(p, 0.5)).select("feature", "importance", F.lit(forest.naive_subset(p, 0.5)).alias("tried"))


def _compared(task):
    """The nine configurations of the muted forest and all standard models."""
    muted = {forest.config_name(k, rate): (lambda t, k=k, rate=rate: models.muted_forest(t, k=k, rate=rate)) for k, rate in forest.GRID}
    return {**muted, **models.baselines(task)}


@query("eval_table")
def eval_table(spark, sf):
    found = models.evaluate(surface(spark, sf), _compared("regression"), "surface").drop("seconds").cache()
    best = models.best_configuration(found, "regression").select(F.col("method").alias("best_config"))
    return found.join(F.broadcast(best), found.method == best.best_config, "left").select(
        "table_name", "method", "mse_train", "mse_test", "relative_performance", "error", F.col("best_config").isNotNull().alias("is_best_config"))


@query("eval_many")
def eval_many(spark, sf):
    return models.evaluate_many(
        {"orders": lambda: orders(spark, sf), "halves": lambda: halves(spark, sf), "broken": lambda: surface(spark, sf + "/none")}, _compared)
