"""Metrics and score analytics on closed-form predictors of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordering import beside
from ..functions.rand import hash_uniform
from ..operators import charts, compare, metrics, prepare
from . import fixtures as fx
from .profile_queries import sql_classes, sql_hist, union
from .registry import query

# --- predictions of the price: mean, group means, line ------------------------------------

U42 = fx.sql_uniform(42, "row_id")
PRICE_BASE = f"SELECT row_id, CASE WHEN {U42} < 0.7 THEN 'train' ELSE 'test' END AS split, l_quantity, l_linestatus, l_returnflag, l_extendedprice AS y FROM ({fx.LINE_SQL})"
PRICE_METHODS = {
    "flag_mean": "(SELECT l_returnflag, avg(y) AS v FROM base WHERE split = 'train' GROUP BY l_returnflag)",
    "status_mean": "(SELECT l_linestatus, avg(y) AS v FROM base WHERE split = 'train' GROUP BY l_linestatus)",
}
PRICE_SQL = f"""WITH base AS ({PRICE_BASE}), fit AS (SELECT avg(y) AS mean, regr_slope(y, l_quantity) AS slope, regr_intercept(y, l_quantity) AS cut FROM base WHERE split = 'train')
SELECT row_id, 'mean' AS method, split, y, mean AS prediction FROM base, fit
UNION ALL SELECT row_id, 'line', split, y, cut + slope * l_quantity FROM base, fit
UNION ALL SELECT row_id, 'flag_mean', split, y, v FROM base JOIN {PRICE_METHODS['flag_mean']} USING (l_returnflag)
UNION ALL SELECT row_id, 'status_mean', split, y, v FROM base JOIN {PRICE_METHODS['status_mean']} USING (l_linestatus)"""


def price_predictions(spark, sf):
    u = hash_uniform(42, "row_id")
    base = fx.line(spark, sf).select(
        "row_id", F.when(u < 0.7, "train").otherwise("test").alias("split"),
        "l_quantity", "l_linestatus", "l_returnflag", F.col("l_extendedprice").alias("y"))
    train = base.where("split = 'train'")
    mean, slope, cut = train.agg(F.avg("y"), F.regr_slope("y", "l_quantity"), F.regr_intercept("y", "l_quantity")).first()
    by_flag = train.groupBy("l_returnflag").agg(F.avg("y").alias("flag_mean"))
    by_status = train.groupBy("l_linestatus").agg(F.avg("y").alias("status_mean"))
    wide = (
        beside(beside(base, by_flag, ["l_returnflag"]), by_status, ["l_linestatus"])
        .withColumn("mean", F.lit(mean)).withColumn("line", F.lit(cut) + F.lit(slope) * F.col("l_quantity")))
    return wide.unpivot(["row_id", "split", "y"], ["mean", "line", "flag_mean", "status_mean"], "method", "prediction")


REG_SQL = f"""SELECT method, split, avg((y - prediction) * (y - prediction)) AS mse, sqrt(avg((y - prediction) * (y - prediction))) AS rmse,
  avg(abs(y - prediction)) AS mae, 1 - sum((y - prediction) * (y - prediction)) / (var_pop(y) * count(*)) AS r2
FROM ({PRICE_SQL}) GROUP BY method, split"""

for _name, _digits in [("mse", 1), ("rmse", 4), ("mae", 4), ("r2", 6)]:
    query(f"met_{_name}", f"SELECT method, split, {_name} FROM ({REG_SQL})", f"{_name}:{_digits}")(
        lambda spark, sf, n=_name: metrics.regression_metrics(price_predictions(spark, sf)).select("method", "split", n))


@query("rf_score", f"""SELECT method, split, CASE WHEN var_pop(y) = 0 THEN CASE WHEN sum((y - prediction) * (y - prediction)) = 0 THEN 1.0 ELSE 0.0 END
  ELSE 1 - sum((y - prediction) * (y - prediction)) / (var_pop(y) * count(*)) END::DOUBLE AS score
FROM (SELECT method, split, y, prediction FROM ({PRICE_SQL}) UNION ALL SELECT 'flat_exact', split, 2.0::DOUBLE, 2.0::DOUBLE FROM ({PRICE_BASE})
  UNION ALL SELECT 'flat_off', split, 2.0::DOUBLE, l_quantity FROM ({PRICE_BASE})) GROUP BY method, split""", "score")
def rf_score(spark, sf):
    base = fx.line(spark, sf).select(F.when(hash_uniform(42, "row_id") < 0.7, "train").otherwise("test").alias("split"), "l_quantity")
    two = F.lit(2.0)
    rows = (
        price_predictions(spark, sf).select("method", "split", "y", "prediction")
        .unionByName(base.select(F.lit("flat_exact").alias("method"), "split", two.alias("y"), two.alias("prediction")))
        .unionByName(base.select(F.lit("flat_off").alias("method"), "split", two.alias("y"), F.col("l_quantity").alias("prediction"))))
    return metrics.regression_metrics(rows, flat_r2="exact").select("method", "split", F.col("r2").alias("score"))


@query("met_residual", f"WITH res AS (SELECT method, split, y - prediction AS residual FROM ({PRICE_SQL}))\n" + union(
    f"SELECT '{m}' AS method, '{s}' AS split, * FROM ({sql_hist(f'''SELECT residual FROM res WHERE method = '{m}' AND split = '{s}' ''', 'residual', 20)})"
    for m in ["mean", "line", "flag_mean", "status_mean"] for s in ["train", "test"]), "bin_start:4 bin_end:4")
def met_residual(spark, sf):
    return metrics.residual_histogram(price_predictions(spark, sf), 20)


def sql_long(sql, names, keys="method, split"):
    return union(f"SELECT {keys}, '{n}' AS metric, CAST({n} AS DOUBLE) AS value FROM ({sql})" for n in names)


REG_LONG = sql_long(REG_SQL, ["mse", "rmse", "mae", "r2"])


@query("met_bundle", REG_LONG, "value:1")
def met_bundle(spark, sf):
    return metrics.bundle(price_predictions(spark, sf), "regression")


# --- class predictions --------------------------------------------------------------------------

CLASS_BASE = f"""SELECT row_id, CASE WHEN {U42} < 0.7 THEN 'train' ELSE 'test' END AS split, l_linestatus, l_linenumber,
  (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)::DOUBLE AS y, {fx.sql_uniform('guess', 'row_id')} AS u FROM ({fx.LINE_SQL})"""
CLASS_SQL = f"""WITH base AS ({CLASS_BASE}),
counts AS (SELECT l_linestatus, y AS c, count(*) AS n FROM base WHERE split = 'train' GROUP BY 1, 2),
best AS (SELECT l_linestatus, c FROM counts QUALIFY row_number() OVER (PARTITION BY l_linestatus ORDER BY n DESC, c) = 1),
major AS (SELECT c FROM (SELECT c, sum(n) AS n FROM counts GROUP BY c) ORDER BY n DESC, c LIMIT 1)
SELECT row_id, 'majority' AS method, split, y, c AS prediction FROM base, major
UNION ALL SELECT row_id, 'status', split, y, c FROM base JOIN best USING (l_linestatus)
UNION ALL SELECT row_id, 'guess', split, y, floor(u * 3)::DOUBLE FROM base
UNION ALL SELECT row_id, 'skewed', split, y, CASE WHEN u < 0.9 THEN y ELSE 3 END::DOUBLE FROM base
UNION ALL SELECT row_id, 'zero', split, y, 0.0::DOUBLE FROM base
UNION ALL SELECT row_id, 'missing', split, y, CAST(NULL AS DOUBLE) FROM base"""
SCORED = "('majority', 'status', 'guess', 'skewed')"


def class_predictions(spark, sf, scored=True):
    flag = F.col("l_returnflag")
    base = fx.line(spark, sf).select(
        "row_id", F.when(hash_uniform(42, "row_id") < 0.7, "train").otherwise("test").alias("split"), "l_linestatus",
        F.when(flag == "A", 0.0).when(flag == "N", 1.0).otherwise(2.0).alias("y"), hash_uniform("guess", "row_id").alias("u"))
    counts = base.where("split = 'train'").groupBy("l_linestatus", F.col("y").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    top = F.min(F.struct((-F.col("n")).alias("n"), "c")).alias("t")
    best = counts.groupBy("l_linestatus").agg(top).select("l_linestatus", F.col("t.c").alias("status"))
    major = counts.groupBy("c").agg(F.sum("n").alias("n")).agg(top).first().t.c
    wide = beside(base, best, ["l_linestatus"]).select(
        "row_id", "split", "y", F.lit(major).alias("majority"), "status", F.floor(F.col("u") * 3).cast("double").alias("guess"),
        F.when(F.col("u") < 0.9, F.col("y")).otherwise(3.0).alias("skewed"), F.lit(0.0).alias("zero"),
        F.lit(None).cast("double").alias("missing"))
    names = ["majority", "status", "guess", "skewed"] + ([] if scored else ["zero", "missing"])
    return wide.unpivot(["row_id", "split", "y"], names, "method", "prediction")


CLASS_SCORED = f"SELECT * FROM ({CLASS_SQL}) WHERE method IN {SCORED}"
ACC_SQL = f"SELECT method, split, avg((y = prediction)::INTEGER) AS accuracy, 1 - avg((y = prediction)::INTEGER) AS error FROM ({CLASS_SCORED}) GROUP BY ALL"


@query("met_accuracy", f"SELECT method, split, accuracy FROM ({ACC_SQL})", "accuracy")
def met_accuracy(spark, sf):
    return metrics.accuracy(class_predictions(spark, sf)).drop("error")


@query("met_error", f"SELECT method, split, error FROM ({ACC_SQL})", "error")
def met_error(spark, sf):
    return metrics.accuracy(class_predictions(spark, sf)).drop("accuracy")


PRF_SQL = f"""WITH p AS ({CLASS_SCORED}), l AS (SELECT method, split, y AS label FROM p UNION SELECT method, split, prediction FROM p),
c AS (SELECT l.method, l.split, label, count(*) FILTER (WHERE y = label) AS t, count(*) FILTER (WHERE prediction = label) AS q,
  count(*) FILTER (WHERE y = label AND prediction = label) AS h FROM l JOIN p ON p.method = l.method AND p.split = l.split GROUP BY ALL)
SELECT method, split, sum(t * coalesce(h::DOUBLE / nullif(q, 0), 0)) / sum(t) AS precision, sum(t * coalesce(h::DOUBLE / nullif(t, 0), 0)) / sum(t) AS recall,
  sum(t * coalesce(2.0 * h::DOUBLE / nullif(q + t, 0), 0)) / sum(t) AS f1 FROM c GROUP BY method, split"""


@query("met_prf_weighted", PRF_SQL, "precision recall f1")
def met_prf_weighted(spark, sf):
    return metrics.weighted_scores(class_predictions(spark, sf))


@query("met_bundle_cls", sql_long(ACC_SQL, ["accuracy", "error"]) + "\nUNION ALL\n" + sql_long(PRF_SQL, ["precision", "recall", "f1"]), "value")
def met_bundle_cls(spark, sf):
    return metrics.bundle(class_predictions(spark, sf), "classification")


@query("met_confusion", f"""WITH p AS ({CLASS_SCORED}), l AS (SELECT method, split, y AS label FROM p UNION SELECT method, split, prediction FROM p)
SELECT a.method, a.split, a.label AS y, b.label AS prediction, (SELECT count(*) FROM p WHERE p.method = a.method AND p.split = a.split AND p.y = a.label AND p.prediction = b.label) AS n
FROM l AS a JOIN l AS b ON a.method = b.method AND a.split = b.split""")
def met_confusion(spark, sf):
    return metrics.confusion(class_predictions(spark, sf))


@query("flt_invalid_predictions", f"""WITH p AS ({CLASS_SQL}) SELECT method, split, count(*) AS n FROM p
WHERE method IN (SELECT method FROM p GROUP BY method HAVING bool_or(prediction <> 0)) GROUP BY ALL""")
def flt_invalid_predictions(spark, sf):
    kept = metrics.drop_invalid(class_predictions(spark, sf, scored=False))
    return kept.groupBy("method", "split").agg(F.count(F.lit(1)).alias("n"))


@query("met_harden_binary", f"SELECT row_id, CASE WHEN u > 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM ({CLASS_BASE})")
def met_harden_binary(spark, sf):
    return fx.line(spark, sf).select("row_id", metrics.harden_binary(hash_uniform("guess", "row_id")).alias("label"))


@query("met_harden_multi", "SELECT event_id, round_even(least(greatest((user_id - 40) / 4.0::DOUBLE, 0), 20), 0)::DOUBLE AS label FROM events")
def met_harden_multi(spark, sf):
    return fx.table(spark, sf, "events").select(
        "event_id", metrics.harden_multiclass((F.col("user_id") - 40) / 4.0, 20).cast("double").alias("label"))


# --- ROC ------------------------------------------------------------------------------------------

ROC_SQL = f"""SELECT row_id, 'coarse' AS method, 'test' AS split, (l_linestatus = 'O')::BIGINT AS y, round({fx.sql_uniform('roc', 'row_id')} * 200) / 200 AS prediction FROM ({fx.LINE_SQL})
UNION ALL SELECT row_id, 'price', 'test', (l_linestatus = 'O')::BIGINT, l_extendedprice FROM ({fx.LINE_SQL})"""


def roc_predictions(spark, sf):
    return fx.line(spark, sf).select(
        "row_id", F.lit("test").alias("split"), (F.col("l_linestatus") == "O").cast("bigint").alias("y"),
        (F.round(hash_uniform("roc", "row_id") * 200) / 200).alias("coarse"), F.col("l_extendedprice").alias("price"),
    ).unpivot(["row_id", "split", "y"], ["coarse", "price"], "method", "prediction")


ROC_POINTS = f"""WITH c AS (SELECT method, split, prediction AS score, sum(y) AS pos, sum(1 - y) AS neg FROM ({ROC_SQL}) GROUP BY ALL),
r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY method, split) AS ap, sum(neg) OVER (PARTITION BY method, split) AS an
  FROM c WINDOW w AS (PARTITION BY method, split ORDER BY score DESC))
SELECT method, split, score, tp::DOUBLE / ap AS tpr, fp::DOUBLE / an AS fpr, pos, neg, tp, ap, an FROM r"""


@query("met_roc", f"SELECT method, split, score, tpr, fpr FROM ({ROC_POINTS})", "tpr fpr")
def met_roc(spark, sf):
    return metrics.roc(roc_predictions(spark, sf)).select("method", "split", "score", "tpr", "fpr")


@query("met_auc", f"SELECT method, split, sum(neg * (2 * tp - pos) / 2.0)::DOUBLE / max(ap::DOUBLE * an) AS auc FROM ({ROC_POINTS}) GROUP BY ALL", "auc")
def met_auc(spark, sf):
    return metrics.auc(roc_predictions(spark, sf))


# --- metric charts ------------------------------------------------------------------------------------


@query("chart_model_bars", f"SELECT * FROM (PIVOT (SELECT * FROM ({REG_LONG}) WHERE metric IN ('rmse', 'r2')) ON split IN ('train', 'test') USING first(value) GROUP BY metric, method)", "train:4 test:4")
def chart_model_bars(spark, sf):
    return charts.metric_bars(metrics.bundle(price_predictions(spark, sf), "regression"), ["rmse", "r2"])


@query("chart_pairs", f"SELECT method, rmse, mae FROM ({REG_SQL}) WHERE split = 'test'", "rmse:4 mae:4")
def chart_pairs(spark, sf):
    return charts.metric_pairs(metrics.bundle(price_predictions(spark, sf), "regression"), "rmse", "mae")


@query("chart_pairs_cls", f"SELECT method, precision, recall FROM ({PRF_SQL}) WHERE split = 'test'", "precision recall")
def chart_pairs_cls(spark, sf):
    return charts.metric_pairs(metrics.bundle(class_predictions(spark, sf), "classification"), "precision", "recall")


def sql_medals(source, order):
    return f"""SELECT method, value, CAST(rank AS INTEGER) AS rank, CASE rank WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' ELSE 'lightcoral' END AS colour
    FROM (SELECT *, row_number() OVER (ORDER BY value {order}, method) AS rank FROM ({source}))"""


@query("chart_rank_bars", sql_medals(f"SELECT method, value FROM ({REG_LONG}) WHERE metric = 'mse' AND split = 'test'", ""), "value:1")
def chart_rank_bars(spark, sf):
    return charts.rank_bars(metrics.bundle(price_predictions(spark, sf), "regression"), "mse", ascending=True)


@query("chart_rank_bars_cls", sql_medals(f"SELECT method, accuracy AS value FROM ({ACC_SQL}) WHERE split = 'test'", "DESC"), "value")
def chart_rank_bars_cls(spark, sf):
    return charts.rank_bars(metrics.bundle(class_predictions(spark, sf), "classification"), "accuracy", ascending=False)


# --- score table: errors of closed-form predictors by flag, line number and supplier group --------------
# Method names follow the configurations and competitors they stand in for.

MEANS = {
    "MF_k1_mute0": ["l_quantity"], "MF_k1_mute50": ["l_quantity", "l_linenumber"], "MF_k2_mute80": ["grp"],
    "Random_Forest": ["l_discount"], "ExtraTrees": ["l_tax"], "GradientBoosting": ["l_linenumber"],
}
METHODS = [*MEANS, "BART", "Lasso", "Ridge", "Broken"]
SCENARIO = {"A": "scenario1", "N": "scenario2", "R": "scenario3"}
CASE_SCENARIO = "CASE WHEN l_returnflag = 'A' THEN 'scenario1' WHEN l_returnflag = 'N' THEN 'scenario2' WHEN l_linestatus = 'F' THEN 'scenario3' ELSE 'scenario4' END"
SCORES_SQL = f"""WITH b AS (SELECT {CASE_SCENARIO} AS scenario, CAST(l_linenumber AS INTEGER) AS p, CAST(l_suppkey % 20 AS INTEGER) AS rep,
  l_quantity, l_linenumber, l_discount, l_tax, l_suppkey % 7 AS grp, l_extendedprice / 1000 AS y FROM lineitem),
fit AS (SELECT avg(y) AS m, regr_slope(y, l_quantity) AS s, regr_intercept(y, l_quantity) AS c FROM b),
w AS (SELECT b.*, {', '.join(f'avg(y) OVER (PARTITION BY {", ".join(k)}) AS "{n}"' for n, k in MEANS.items())},
  m AS "BART", c + s * l_quantity AS "Lasso", c + s * l_quantity AS "Ridge" FROM b, fit),
e AS ({union(f'SELECT scenario, p, rep, {chr(39)}{n}{chr(39)} AS method, avg((y - "{n}") * (y - "{n}")) AS score FROM w GROUP BY ALL' for n in METHODS if n != 'Broken')})
SELECT scenario, p, rep, method, CASE WHEN method = 'ExtraTrees' AND rep % 7 = 3 THEN NULL ELSE score END AS score FROM e
UNION ALL SELECT DISTINCT scenario, p, rep, 'Broken', CAST(NULL AS DOUBLE) FROM b"""


def scores(spark, sf):
    b = fx.table(spark, sf, "lineitem").select(
        F.expr(CASE_SCENARIO).alias("scenario"), F.col("l_linenumber").cast("int").alias("p"),
        (F.col("l_suppkey") % 20).cast("int").alias("rep"), "l_quantity", "l_linenumber", "l_discount", "l_tax",
        (F.col("l_suppkey") % 7).alias("grp"), (F.col("l_extendedprice") / 1000).alias("y"))
    m, s, c = b.agg(F.avg("y"), F.regr_slope("y", "l_quantity"), F.regr_intercept("y", "l_quantity")).first()
    w = b
    for name, keys in MEANS.items():
        w = beside(w, b.groupBy(*keys).agg(F.avg("y").alias(name)), keys)
    line = F.lit(c) + F.lit(s) * F.col("l_quantity")
    w = w.withColumn("BART", F.lit(m)).withColumn("Lasso", line).withColumn("Ridge", line)
    names = [n for n in METHODS if n != "Broken"]
    # One aggregate over the rows, then one row per method and cell.
    errors = w.groupBy("scenario", "p", "rep").agg(*[F.avg((F.col("y") - F.col(n)) ** 2).alias(n) for n in names])
    errors = errors.withColumn("Broken", F.lit(None).cast("double"))
    rows = errors.unpivot(["scenario", "p", "rep"], METHODS, "method", "score")
    failed = (F.col("method") == "ExtraTrees") & (F.col("rep") % 7 == 3)
    return rows.withColumn("score", F.when(~failed, F.col("score")))


STATS_SQL = f"""SELECT scenario, p, method, avg(score) AS mean, stddev_pop(score) AS std, min(score) AS min, max(score) AS max,
  count(score) AS n_successful, count(score)::DOUBLE / count(*) AS success_rate, count(*) AS n FROM ({SCORES_SQL}) GROUP BY scenario, p, method"""


def stats(spark, sf):
    return compare.rep_stats(scores(spark, sf))


@query("cmp_rep_stats", f"SELECT * EXCLUDE (n) FROM ({STATS_SQL})", "mean std min max success_rate")
def cmp_rep_stats(spark, sf):
    return stats(spark, sf)


@query("cmp_flatten", f"""SELECT scenario, p, method, mean AS mean_score, std AS std_score, min AS min_score, max AS max_score, success_rate, n AS n_repetitions FROM ({STATS_SQL})""",
       "mean_score std_score min_score max_score success_rate")
def cmp_flatten(spark, sf):
    return compare.flatten(scores(spark, sf))


def sql_rank(source, keys, value, order):
    return f"SELECT {keys}, method, {value}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY round({value}, 9) {order}, method) AS INTEGER) AS rank FROM ({source}) WHERE {value} IS NOT NULL"


@query("cmp_ranking", sql_rank(STATS_SQL, "scenario, p", "mean", "DESC"), "mean")
def cmp_ranking(spark, sf):
    return compare.ranking(_steady(stats(spark, sf)))


def _steady(df, column="mean"):
    """Means of equal scores agree only up to the order of summing: tie them."""
    return df.withColumn(column, F.round(column, 9))


@query("cmp_top10", f"SELECT * FROM ({sql_rank(STATS_SQL, 'scenario, p', 'mean', 'DESC')}) WHERE rank <= 10", "mean")
def cmp_top10(spark, sf):
    return compare.top_methods(_steady(stats(spark, sf)))


# Tables: one per flag, status and line number; errors over the whole table.
ERRORS_SQL = f"SELECT scenario || '/' || p AS table_name, method, round(avg(score), 9) AS error FROM ({SCORES_SQL}) GROUP BY ALL"


def errors(spark, sf):
    return _steady(stats(spark, sf)).select(F.concat_ws("/", "scenario", "p").alias("table_name"), "method", F.col("mean").alias("error"))


RANKS_SQL = f"""WITH r AS ({sql_rank(ERRORS_SQL, 'table_name', 'error', 'ASC')})
SELECT table_name, arg_min(method, rank) AS winner, arg_min(error, rank) AS winner_error,
  arg_min(method, rank) FILTER (WHERE method LIKE 'MF%') AS best_config, arg_min(error, rank) FILTER (WHERE method LIKE 'MF%') AS best_error,
  min(rank) FILTER (WHERE method LIKE 'MF%') AS best_rank, arg_min(method, rank) LIKE 'MF%' AS we_win,
  min(error) FILTER (WHERE rank = 2) AS second_error, count(*) AS n_methods FROM r GROUP BY table_name"""


def ranks(spark, sf):
    return compare.error_ranking(errors(spark, sf))


@query("cmp_rank_error", RANKS_SQL, "winner_error best_error second_error")
def cmp_rank_error(spark, sf):
    return ranks(spark, sf)


@query("cmp_join_methods", f"""SELECT table_name, CASE WHEN method LIKE 'MF%' THEN 'MF (' || method || ')' ELSE method END AS method, error,
  CASE WHEN method LIKE 'MF%' THEN 0.5 END::DOUBLE AS muting FROM ({ERRORS_SQL})""", "error")
def cmp_join_methods(spark, sf):
    e = errors(spark, sf)
    ours = e.where(compare.is_ours()).withColumn("muting", F.lit(0.5))
    return compare.join_methods(ours, e.where(~compare.is_ours()))


REL_SQL = f"SELECT table_name, method, error AS mse_test, error / min(error) OVER (PARTITION BY table_name) AS relative_performance FROM ({ERRORS_SQL})"


def relative(spark, sf):
    return compare.relative_performance(errors(spark, sf).withColumnRenamed("error", "mse_test"), "regression")


@query("cmp_relative", REL_SQL, "mse_test relative_performance")
def cmp_relative(spark, sf):
    return relative(spark, sf)


@query("cmp_relative_cls", f"SELECT split AS table_name, method, accuracy AS accuracy_test, max(accuracy) OVER (PARTITION BY split) / accuracy AS relative_performance FROM ({ACC_SQL})",
       "accuracy_test relative_performance")
def cmp_relative_cls(spark, sf):
    table = metrics.accuracy(class_predictions(spark, sf)).select(F.col("split").alias("table_name"), "method", F.col("accuracy").alias("accuracy_test"))
    return compare.relative_performance(table, "classification")


@query("cmp_best_config", f"""SELECT table_name, arg_min(method, (error, method)) AS best_config, min(error) AS best_value FROM ({ERRORS_SQL}) WHERE method LIKE 'MF%' GROUP BY table_name""", "best_value")
def cmp_best_config(spark, sf):
    return compare.best_config(errors(spark, sf).where(compare.is_ours()), "error", lower_is_better=True)


@query("cmp_best_config_cls", f"""SELECT split AS table_name, arg_min(method, (-accuracy, method)) AS best_config, max(accuracy) AS best_value FROM ({ACC_SQL}) GROUP BY split""", "best_value")
def cmp_best_config_cls(spark, sf):
    table = metrics.accuracy(class_predictions(spark, sf)).withColumnRenamed("split", "table_name")
    return compare.best_config(table, "accuracy", lower_is_better=False)


@query("cmp_summary", f"""WITH r AS ({REL_SQL}) SELECT table_name,
  arg_min(method, (relative_performance, method)) FILTER (WHERE method LIKE 'MF%') AS best_config,
  min(relative_performance) FILTER (WHERE method LIKE 'MF%') AS best_config_relative,
  arg_min(method, (relative_performance, method)) FILTER (WHERE relative_performance IS NOT NULL) AS best_method, min(relative_performance) AS best_method_relative FROM r GROUP BY table_name""",
       "best_config_relative best_method_relative")
def cmp_summary(spark, sf):
    return compare.table_summary(relative(spark, sf))


ROUNDED_STATS = f"SELECT scenario, p, method, round(mean, 9) AS mean, std FROM ({STATS_SQL}) WHERE mean IS NOT NULL"


def sql_best(sign):
    return f"""WITH s AS ({ROUNDED_STATS}) SELECT scenario, p,
  arg_min(method, ({sign} mean, method)) FILTER (WHERE method LIKE 'MF%') AS best_ours, {sign} min({sign} mean) FILTER (WHERE method LIKE 'MF%') AS our_score,
  arg_min(std, ({sign} mean, method)) FILTER (WHERE method LIKE 'MF%') AS our_std,
  arg_min(method, ({sign} mean, method)) FILTER (WHERE method NOT LIKE 'MF%') AS best_other, {sign} min({sign} mean) FILTER (WHERE method NOT LIKE 'MF%') AS other_score,
  arg_min(std, ({sign} mean, method)) FILTER (WHERE method NOT LIKE 'MF%') AS other_std,
  min({sign} mean) FILTER (WHERE method LIKE 'MF%') < min({sign} mean) FILTER (WHERE method NOT LIKE 'MF%') AS win
FROM s GROUP BY scenario, p"""


LOWER, HIGHER = sql_best("1 *"), sql_best("-1 *")


@query("cmp_best_vs_best", f"SELECT scenario, p, best_ours AS best_config, our_score AS our_error, best_other, other_score AS other_error, CASE WHEN win THEN 'Win' ELSE 'Loss' END AS verdict FROM ({LOWER})",
       "our_error other_error")
def cmp_best_vs_best(spark, sf):
    return compare.verdicts(_steady(stats(spark, sf)))


@query("cmp_advantage", f"SELECT *, our_score - other_score AS advantage FROM ({HIGHER})", "our_score our_std other_score other_std advantage")
def cmp_advantage(spark, sf):
    return compare.advantage(_steady(stats(spark, sf)))


@query("cmp_win_rate", f"""SELECT count(*) AS n_cells, 100.0 * avg(win::INTEGER) AS win_rate, avg(our_score - other_score) AS mean_advantage,
  (SELECT best_ours FROM ({HIGHER}) GROUP BY best_ours ORDER BY count(*) DESC, best_ours LIMIT 1) AS best_config FROM ({HIGHER})""", "win_rate mean_advantage")
def cmp_win_rate(spark, sf):
    return compare.win_rate(compare.best_against_best(_steady(stats(spark, sf)), lower_is_better=False))


@query("cmp_improvement", f"SELECT table_name, we_win, CASE WHEN we_win THEN 100.0 * (second_error - best_error) / second_error END AS improvement FROM ({RANKS_SQL})", "improvement")
def cmp_improvement(spark, sf):
    return compare.improvement(ranks(spark, sf))


SCEN_IMP = f"SELECT scenario, p, 100.0 * (other_score - our_score) / other_score AS improvement FROM ({LOWER}) WHERE other_score > 0 AND our_score <> other_score"


@query("cmp_improvement_scenario", SCEN_IMP, "improvement")
def cmp_improvement_scenario(spark, sf):
    return compare.scenario_improvement(_steady(stats(spark, sf)))


GOAL_ROWS = ", ".join(f"('{s}', {lo if lo is not None else 'NULL'}, {hi if hi is not None else 'NULL'})" for s, (lo, hi) in compare.GOALS.items())


@query("cmp_goal_range", f"""SELECT scenario, mean_improvement, min_improvement, max_improvement, lower::DOUBLE AS lower, upper::DOUBLE AS upper, mean_improvement BETWEEN lower AND upper AS met
FROM (SELECT scenario, avg(improvement) AS mean_improvement, min(improvement) AS min_improvement, max(improvement) AS max_improvement FROM ({SCEN_IMP}) GROUP BY scenario)
JOIN (VALUES {GOAL_ROWS}) AS g(scenario, lower, upper) USING (scenario)""", "mean_improvement min_improvement max_improvement")
def cmp_goal_range(spark, sf):
    return compare.goal_ranges(compare.scenario_improvement(_steady(stats(spark, sf))))


@query("cmp_goal_tables", f"SELECT count(*) FILTER (WHERE we_win) AS wins, count(*) AS n_tables, count(*) FILTER (WHERE we_win) >= 7 AS met FROM ({RANKS_SQL})")
def cmp_goal_tables(spark, sf):
    return compare.goals_of_tables(ranks(spark, sf))


@query("cmp_top3", f"SELECT count(*) AS n_lost, count(*) FILTER (WHERE best_rank <= 3) AS n_top3, count(*) = count(*) FILTER (WHERE best_rank <= 3) AS all_top3 FROM ({RANKS_SQL}) WHERE NOT we_win")
def cmp_top3(spark, sf):
    return compare.top3_of_losers(ranks(spark, sf))


@query("cmp_config_votes", f"SELECT best_config, count(*) AS n FROM ({RANKS_SQL}) WHERE best_config IS NOT NULL GROUP BY best_config")
def cmp_config_votes(spark, sf):
    return compare.config_votes(ranks(spark, sf))


@query("cmp_beats_trees", f"""WITH s AS (SELECT *, min(mean) FILTER (WHERE method LIKE 'MF%') OVER (PARTITION BY scenario, p) AS ours FROM ({ROUNDED_STATS}))
SELECT scenario, p, min(ours) AS our_error, count(*) FILTER (WHERE method IN ('Random_Forest', 'BART', 'ExtraTrees', 'GradientBoosting') AND ours < mean) AS beaten,
  count(*) FILTER (WHERE method IN ('Random_Forest', 'BART', 'ExtraTrees', 'GradientBoosting')) AS n_trees, coalesce(bool_or(mean < ours) FILTER (WHERE method = 'Lasso'), FALSE) AS linear_wins
FROM s GROUP BY scenario, p""", "our_error")
def cmp_beats_trees(spark, sf):
    return compare.beats_trees(_steady(stats(spark, sf)))


@query("cmp_diagnostics", f"""SELECT table_name, count(*) FILTER (WHERE method LIKE 'MF%') AS n_ours, count(*) FILTER (WHERE method NOT LIKE 'MF%') AS n_others,
  count(error) AS n_scored, count(*) FILTER (WHERE method LIKE 'MF%' AND error > 1000) AS n_large FROM ({ERRORS_SQL}) GROUP BY table_name""")
def cmp_diagnostics(spark, sf):
    return compare.diagnostics(errors(spark, sf))


@query("cmp_scenario_summary", f"SELECT scenario, p, avg(score) AS mean_error, stddev_pop(score) AS std_error FROM ({SCORES_SQL}) GROUP BY scenario, p", "mean_error std_error")
def cmp_scenario_summary(spark, sf):
    return compare.scenario_summary(scores(spark, sf))


@query("chart_box", f"""SELECT scenario, p, method, min(score) AS low, quantile_cont(score, 0.25) AS q25, median(score) AS median, quantile_cont(score, 0.75) AS q75, max(score) AS high
FROM ({SCORES_SQL}) GROUP BY ALL""", "low q25 median q75 high")
def chart_box(spark, sf):
    return charts.score_boxes(scores(spark, sf))
