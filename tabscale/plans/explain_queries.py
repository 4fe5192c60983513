"""Response surfaces and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import CDF_BOTTOM, CDF_TOP
from ..operators import explain, forest, models, surfaces
from . import fixtures as fx
from .model_queries import surface
from .profile_queries import sql_corr, sql_poly, union
from .registry import query

# --- surfaces over events ---------------------------------------------------------------


def u(j):
    return fx.sql_uniform(f"surface|{j}", "event_id")


def sql_cdf(x):
    z = f"abs({x})"
    e = f"exp(-{z} * {z} / 2)"
    far = f"{e} / ({z} + 1 / ({z} + 2 / ({z} + 3 / ({z} + 4 / ({z} + 0.65::DOUBLE))))) / sqrt(2 * pi())"
    tail = f"(CASE WHEN {z} > 37 THEN 0 WHEN {z} < 7.07106781186547 THEN {e} * {sql_poly(z, CDF_TOP)} / {sql_poly(z, CDF_BOTTOM)} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def columns(spark, sf, p):
    return surfaces.hash_columns(fx.table(spark, sf, "events").select("event_id"), "event_id", p)


@query("surf_probit", f"""SELECT event_id, CAST({fx.sql_uniform('42|label', 'event_id')} < {sql_cdf('score')} AS INTEGER) AS label, {sql_cdf('score')} AS p
FROM (SELECT event_id, 10 * ({u(0)} - 1) + 20 * abs({u(1)} - 0.5::DOUBLE) AS score FROM events)""", "p")
def surf_probit(spark, sf):
    from ..functions.stats import normal_cdf

    df = columns(spark, sf, 2)
    score = 10 * (F.col("x0") - 1) + 20 * F.abs(F.col("x1") - 0.5)
    return df.select("event_id", surfaces.probit_label(F.col("x0"), F.col("x1"), 42, "event_id").alias("label"), normal_cdf(score).alias("p"))


@query("surf_local", f"""SELECT event_id, 100 * ({u(0)} - 0.5::DOUBLE) * ({u(0)} - 0.5::DOUBLE) * greatest({u(1)} - 0.25::DOUBLE, 0)
  + 0.5 * {fx.sql_normal('42|noise', 'event_id')} AS t FROM events""", "t")
def surf_local(spark, sf):
    df = columns(spark, sf, 2)
    return df.select("event_id", surfaces.local_surface(F.col("x0"), F.col("x1"), 42, "event_id").alias("t"))


def z(j):
    return fx.sql_normal(f"42|z|{j}", "event_id")


def sql_interaction(p):
    a, b, c, d = surfaces.interaction_columns(p)
    return f"2 * {z(a)} * {z(b)} + 2 * {z(c)} * {z(d)} + 0.5 * {fx.sql_normal('42|noise', 'event_id')}"


@query("surf_interaction", f"SELECT event_id, {sql_interaction(200)} AS wide, {sql_interaction(8)} AS narrow FROM events", "wide narrow")
def surf_interaction(spark, sf):
    df = fx.table(spark, sf, "events").select("event_id", surfaces.normal_columns(200, 42, "event_id").alias("x"))
    return df.select("event_id", *[surfaces.interaction_surface(F.col("x"), p, 42, "event_id").alias(n) for p, n in [(200, "wide"), (8, "narrow")]])


def sql_linear(p):
    a, b, c = surfaces.linear_columns(p)
    return f"2 * {z(a)} + 2 * {z(b)} + 4 * {z(c)} + 0.5 * {fx.sql_normal('42|noise', 'event_id')}"


@query("surf_linear", f"SELECT event_id, {sql_linear(150)} AS wide, {sql_linear(8)} AS narrow FROM events", "wide narrow")
def surf_linear(spark, sf):
    df = fx.table(spark, sf, "events").select("event_id", surfaces.normal_columns(150, 42, "event_id").alias("x"))
    return df.select("event_id", *[surfaces.linear_surface(F.col("x"), p, 42, "event_id").alias(n) for p, n in [(150, "wide"), (8, "narrow")]])


def _ar_sql(p):
    cells, before = [], None
    for j in range(p):
        before = z(j) if before is None else f"(0.9::DOUBLE * x{j - 1} + sqrt(1 - 0.9::DOUBLE * 0.9::DOUBLE) * {z(j)})"
        cells.append(f"{before} AS x{j}")
    return "SELECT event_id, " + ", ".join(cells) + " FROM events"


@query("surf_ar1", _ar_sql(6), " ".join(f"x{j}" for j in range(6)))
def surf_ar1(spark, sf):
    df = fx.table(spark, sf, "events").select("event_id", surfaces.correlated_columns(6, 42, "event_id").alias("x"))
    return df.select("event_id", *[F.col("x")[j].alias(f"x{j}") for j in range(6)])


# --- explanations of a linear score of customers ----------------------------------------------

FEATURES = ["c_acctbal", "c_nationkey", "c_group"]
WEIGHTS = [0.05, -2.0, 3.0]
CUST_SQL = "SELECT c_custkey, c_acctbal, c_nationkey::DOUBLE AS c_nationkey, (c_custkey % 7)::DOUBLE AS c_group FROM customer"


def customers(spark, sf):
    return fx.table(spark, sf, "customer").select(
        "c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"), (F.col("c_custkey") % 7).cast("double").alias("c_group"))


def _explained(spark, sf):
    df = customers(spark, sf)
    back = explain.instances(explain.background(df, "c_custkey"), "c_custkey", FEATURES)
    return explain.shapley(explain.linear_scorer(WEIGHTS, 1.0), explain.instances(df, "c_custkey", FEATURES), back, FEATURES)


BACK_SQL = f"SELECT * FROM ({CUST_SQL}) ORDER BY {fx.sql_uniform('42|background', 'c_custkey')}, c_custkey LIMIT 100"
SHAP_SQL = union(
    f"SELECT c_custkey AS instance, '{f}' AS feature, {w}::DOUBLE * ({f} - (SELECT avg({f}) FROM ({BACK_SQL}))) AS phi FROM ({CUST_SQL})"
    for f, w in zip(FEATURES, WEIGHTS, strict=True))


@query("xai_background", f"SELECT c_custkey, c_acctbal FROM ({BACK_SQL})")
def xai_background(spark, sf):
    return explain.background(customers(spark, sf), "c_custkey").select("c_custkey", "c_acctbal")


@query("xai_shap", SHAP_SQL, "phi")
def xai_shap(spark, sf):
    return _explained(spark, sf)


@query("xai_shap_kernel", f"SELECT instance, feature, phi, 0::DOUBLE AS error FROM ({SHAP_SQL})", "phi error")
def xai_shap_kernel(spark, sf):
    """The kernel estimator; for a linear score it gives the closed form."""
    df = customers(spark, sf)
    back = explain.instances(explain.background(df, "c_custkey"), "c_custkey", FEATURES)
    return explain.kernel_shapley(explain.linear_scorer(WEIGHTS, 1.0), explain.instances(df, "c_custkey", FEATURES), back, FEATURES)


@query("xai_shap_importance", f"SELECT feature, avg(abs(phi)) AS importance FROM ({SHAP_SQL}) GROUP BY feature", "importance")
def xai_shap_importance(spark, sf):
    return explain.shapley_importance(_explained(spark, sf))


@query("xai_shap_importance_signed", f"SELECT feature, avg(phi) AS importance FROM ({SHAP_SQL}) GROUP BY feature", "importance")
def xai_shap_importance_signed(spark, sf):
    return explain.shapley_importance(_explained(spark, sf), mean_abs=False)


@query("chart_shap_summary", f"SELECT feature, avg(abs(phi)) AS importance FROM ({SHAP_SQL}) GROUP BY feature ORDER BY importance DESC LIMIT 15", "importance")
def chart_shap_summary(spark, sf):
    return explain.summary_chart(_explained(spark, sf))


@query("chart_shap_force", f"SELECT instance, feature, CASE WHEN phi > 0 THEN 'positive' ELSE 'negative' END AS side, CASE WHEN phi > 0 THEN phi ELSE -phi END AS length FROM ({SHAP_SQL})", "length")
def chart_shap_force(spark, sf):
    return explain.force_chart(_explained(spark, sf))


def _local(spark, sf):
    df = customers(spark, sf)
    spreads = df.agg(*[F.stddev_pop(f) for f in FEATURES]).first()
    return explain.local_surrogate(
        explain.linear_scorer(WEIGHTS, 1.0), explain.instances(df, "c_custkey", FEATURES), list(spreads), FEATURES)


def sql_local():
    """The weighted ridge in closed form: the score is linear in the draws, so with A the
    weighted centred sums of squares the weights solve (A + I) b = A * (weight * spread)."""
    draws = ", ".join(f"CASE WHEN _s = 0 THEN 0 ELSE {fx.sql_normal(f'42|{j}', 'instance, _s')} END AS z{j}" for j in range(3))
    sums = ", ".join([*[f"sum(w * z{a}) AS m{a}" for a in range(3)], *[f"sum(w * z{a} * z{b}) AS s{a}{b}" for a in range(3) for b in range(a, 3)]])
    cell = lambda a, b: f"(s{min(a, b)}{max(a, b)} - m{a} * m{b} / sw)"
    a = ", ".join(f"{cell(i, j)} AS a{i}{j}" for i in range(3) for j in range(3))
    v = ", ".join("(" + " + ".join(f"a{i}{j} * {w}::DOUBLE * sd{j}" for j, w in enumerate(WEIGHTS)) + f") AS v{i}" for i in range(3))
    mat = [[f"(a{i}{j} + {int(i == j)})" for j in range(3)] for i in range(3)]

    def det(m):
        return "(" + " + ".join(
            f"{m[0][i]} * ({m[1][(i + 1) % 3]} * {m[2][(i + 2) % 3]} - {m[1][(i + 2) % 3]} * {m[2][(i + 1) % 3]})" for i in range(3)) + ")"

    def swapped(j):
        return [[f"v{i}" if k == j else mat[i][k] for k in range(3)] for i in range(3)]

    spreads = ", ".join(f"stddev_pop({f}) AS sd{j}" for j, f in enumerate(FEATURES))
    rows = union(f"SELECT instance, '{f}' AS feature, {det(swapped(j))} / {det(mat)} AS weight FROM v" for j, f in enumerate(FEATURES))
    return f"""WITH d AS (SELECT c_custkey AS instance, _s FROM customer, range({explain.SAMPLES}) AS r(_s)), z AS (SELECT instance, _s, {draws} FROM d),
k AS (SELECT *, sqrt(exp(-(z0 * z0 + z1 * z1 + z2 * z2) / ({explain.KERNEL}::DOUBLE * {explain.KERNEL}::DOUBLE * 3))) AS w FROM z),
g AS (SELECT instance, sum(w) AS sw, {sums} FROM k GROUP BY instance), a AS (SELECT instance, {a} FROM g),
v AS (SELECT *, {v} FROM a, (SELECT {spreads} FROM ({CUST_SQL})))
{rows}"""


LOCAL_SQL = sql_local()


@query("xai_lime", LOCAL_SQL, "weight:4")
def xai_lime(spark, sf):
    return _local(spark, sf)


@query("chart_lime_bars", f"SELECT instance, substr(feature, 1, 30) AS label, weight, CASE WHEN weight > 0 THEN 'positive' ELSE 'negative' END AS sign FROM ({LOCAL_SQL})", "weight:4")
def chart_lime_bars(spark, sf):
    return explain.surrogate_bars(_local(spark, sf))


TRUTH = "(c_acctbal / 20 - c_nationkey)"


ERRORS_SQL = f"""SELECT c_custkey AS instance, 1 + 0.05::DOUBLE * c_acctbal - 2 * c_nationkey + 3 * c_group AS prediction, {TRUTH} AS y,
  abs(1 + 0.05::DOUBLE * c_acctbal - 2 * c_nationkey + 3 * c_group - {TRUTH}) AS error FROM ({CUST_SQL})"""


@query("xai_errors", ERRORS_SQL, "prediction y error")
def xai_errors(spark, sf):
    df = customers(spark, sf).withColumn("y", F.expr(TRUTH))
    rows = df.select(F.col("c_custkey").alias("instance"), F.array(*FEATURES).alias("x"), "y")
    return explain.prediction_errors(explain.linear_scorer(WEIGHTS, 1.0)(rows), "regression")


def sql_ranked(source, value, rank):
    return f"SELECT *, CAST(row_number() OVER (PARTITION BY instance ORDER BY abs({value}) DESC, feature) AS INTEGER) AS {rank} FROM ({source})"


@query("xai_compare", f"""SELECT instance, feature, weight, local_rank, phi, shapley_rank, prediction, y, error FROM ({sql_ranked(LOCAL_SQL, 'weight', 'local_rank')})
JOIN ({sql_ranked(SHAP_SQL, 'phi', 'shapley_rank')}) USING (instance, feature) JOIN ({ERRORS_SQL}) USING (instance)""", "weight:4 phi prediction y error")
def xai_compare(spark, sf):
    return explain.compare_methods(_local(spark, sf), _explained(spark, sf), xai_errors(spark, sf))


@query("xai_explain_both", f"SELECT instance, feature, phi, 'shapley' AS method FROM ({SHAP_SQL}) UNION ALL SELECT instance, feature, weight, 'local' FROM ({LOCAL_SQL})", "phi:4")
def xai_explain_both(spark, sf):
    return explain.explain_both(_local(spark, sf), _explained(spark, sf))


@query("xai_global")
def xai_global(spark, sf):
    """Contributions of a fitted forest over its whole test part."""
    from pyspark.ml.functions import vector_to_array

    table = surface(spark, sf)
    model = models.grow_exact(table)
    rows = [d.select(F.col("row_id").alias("instance"), vector_to_array("features").alias("x")) for d in (table.test, table.train)]
    back = explain.background(rows[1], "instance")
    names = [f"x{j}" for j in range(table.n_features)]
    return explain.global_importance(explain.forest_scorer(model), rows[0], back, names)


def sql_normed(name, source):
    return f"SELECT '{name}' AS table_name, feature, importance / (SELECT sum(importance) FROM ({source})) AS importance FROM ({source})"


def sql_marginal(source, features, target):
    numbers = " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(features))
    return f"SELECT CAST(CASE feature {numbers} END AS INTEGER) AS feature, coalesce(abs(correlation), 0) AS importance FROM ({sql_corr(source, features, target)})"


IMP_SQL = union([
    sql_normed("embeddings", sql_marginal(fx.WIDE_SQL, fx.WIDE_FEATURES, "label")),
    sql_normed("line", sql_marginal(fx.LINE_SQL, fx.LINE_FEATURES, "l_extendedprice"))])


def importances(spark, sf):
    out = None
    for name, df, features, target in [
        ("embeddings", fx.wide(spark, sf), fx.WIDE_FEATURES, "label"), ("line", fx.line(spark, sf), fx.LINE_FEATURES, "l_extendedprice")]:
        rated = forest.marginal_importance(df, features, target)
        total = rated.agg(F.sum("importance")).first()[0]
        rows = rated.select(F.lit(name).alias("table_name"), "feature", (F.col("importance") / total).alias("importance"))
        out = rows if out is None else out.unionByName(rows)
    return out


CONC_SQL = f"""SELECT table_name, sum(importance) FILTER (WHERE rk <= 10) AS top_share, sum(importance) FILTER (WHERE feature < 50) AS original_share, count(*) AS n_features,
  CASE WHEN sum(importance) FILTER (WHERE feature < 50) > 0.7 THEN 'excellent' WHEN sum(importance) FILTER (WHERE feature < 50) > 0.5 THEN 'good' ELSE 'weak' END AS verdict
FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY importance DESC, feature DESC) AS rk FROM ({IMP_SQL})) GROUP BY table_name"""


@query("xai_concentration", CONC_SQL, "top_share original_share")
def xai_concentration(spark, sf):
    return explain.concentration(importances(spark, sf))


@query("xai_concentration_mean", f"SELECT avg(top_share) AS mean_top_share, avg(original_share) AS mean_original_share, avg(n_features) AS mean_features, count(*) AS n_tables FROM ({CONC_SQL})",
       "mean_top_share mean_original_share mean_features")
def xai_concentration_mean(spark, sf):
    return explain.concentration_means(explain.concentration(importances(spark, sf)))


@query("xai_top_features", f"""SELECT table_name, feature, importance, CAST(rk AS INTEGER) AS rank, CASE WHEN feature < 50 THEN 'original' ELSE 'noise' END AS kind
FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY importance DESC, feature DESC) AS rk FROM ({IMP_SQL})) WHERE rk <= 10""", "importance")
def xai_top_features(spark, sf):
    return explain.label_features(importances(spark, sf))
