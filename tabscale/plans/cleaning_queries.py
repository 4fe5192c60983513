"""Filters, missing values and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import missing, outliers
from . import fixtures as fx
from .profile_queries import ALL_NUM, sql_corr, sql_missing, union
from .registry import query

N = f"({fx.NULL_SQL})"
ANY_NULL = " OR ".join(f"{c} IS NULL" for c in fx.NULL_COLUMNS)


@query("prj_drop_column", "SELECT event_id, value, user_id, event_type, target FROM " + N, "value user_id target")
def prj_drop_column(spark, sf):
    return fx.nulls(spark, sf).drop("sparse")


@query("prj_first_k", "SELECT " + ", ".join(["vec_id", "label", *fx.WIDE_FEATURES[:48]]) + f" FROM ({fx.WIDE_SQL})")
def prj_first_k(spark, sf):
    from ..operators.prepare import first_columns

    return first_columns(fx.wide(spark, sf), 50)


@query("flt_complete_cases", f"""SELECT event_id, value, user_id, event_type, sparse, target FROM {N} WHERE NOT ({ANY_NULL})""",
       "value user_id sparse target")
def flt_complete_cases(spark, sf):
    return fx.nulls(spark, sf).na.drop()


@query("miss_overview", f"""SELECT CAST(sum({' + '.join(f'CAST({c} IS NULL AS INTEGER)' for c in fx.NULL_COLUMNS)}) AS BIGINT) AS total_missing,
  100.0::DOUBLE * count(*) FILTER (WHERE NOT ({ANY_NULL})) / count(*) AS pct_complete FROM {N}""", "pct_complete")
def miss_overview(spark, sf):
    return missing.overview(fx.nulls(spark, sf).drop("event_id"))


MISS = sql_missing(fx.NULL_SQL, fx.NULL_COLUMNS)


@query("miss_analyze", MISS, "missing_pct")
def miss_analyze(spark, sf):
    from ..operators.profile import missing_counts

    return missing_counts(fx.nulls(spark, sf).drop("event_id"))


def sql_strategy(task):
    simple = "FILL_MEAN" if task == "regression" else "FILL_MEDIAN"
    return f"""SELECT '{task}' AS task, m.*, CASE WHEN missing_pct > 50 THEN 'DROP_COLUMN' WHEN feature = 'event_type' THEN 'FILL_MODE'
      WHEN missing_pct < 5 THEN '{simple}' ELSE 'FILL_KNN' END AS strategy FROM ({MISS}) AS m WHERE missing_count > 0"""


@query("miss_strategy", union([sql_strategy("regression"), sql_strategy("classification")]), "missing_pct")
def miss_strategy(spark, sf):
    df = fx.nulls(spark, sf).drop("event_id")
    out = None
    for task in ("regression", "classification"):
        rows = missing.strategies(df, task).select(F.lit(task).alias("task"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("imp_mean", f"SELECT event_id, coalesce(value, (SELECT avg(value) FROM {N})) AS value FROM {N}", "value")
def imp_mean(spark, sf):
    return missing.fill_mean(fx.nulls(spark, sf).select("event_id", "value"), ["value"])


@query("imp_median", f"""SELECT event_id, coalesce(value, (SELECT median(value) FROM {N})) AS value,
  coalesce(user_id, (SELECT median(user_id) FROM {N})) AS user_id FROM {N}""", "value user_id")
def imp_median(spark, sf):
    return missing.fill_median(fx.nulls(spark, sf).select("event_id", "value", "user_id"), ["value", "user_id"])


MODE_OF = f"(SELECT event_type FROM {N} WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)"


@query("imp_mode", f"""SELECT event_id, coalesce(event_type, {MODE_OF}) AS event_type, 'missing' AS empty FROM {N}""")
def imp_mode(spark, sf):
    df = fx.nulls(spark, sf).select("event_id", "event_type", F.lit(None).cast("string").alias("empty"))
    return missing.fill_mode(df, ["event_type", "empty"])


def sql_best(source, column, others):
    return f"""(SELECT max(abs(correlation)) AS c FROM ({sql_corr(source, others, column)})),
      (SELECT arg_max(feature, abs(correlation)) AS best FROM ({sql_corr(source, others, column)}))"""


def sql_knn(source, column, others, keep):
    pick = "CASE best " + " ".join(f"WHEN '{o}' THEN {o}" for o in others) + " END"
    return f"""SELECT {', '.join(keep)}, coalesce({column}, ({pick}) * c) AS {column} FROM ({source}) AS s, {sql_best(source, column, others)}"""


@query("imp_corr", sql_knn(fx.NULL_SQL, "user_id", ["value", "sparse", "target"], ["event_id", "value", "event_type", "sparse", "target"]),
       "value user_id sparse target")
def imp_corr(spark, sf):
    return missing.fill_correlated(fx.nulls(spark, sf), "user_id", key="event_id")


@query("imp_corr_line", f"""SELECT event_id, coalesce(user_id, s * target + i) AS user_id, target FROM {N},
  (SELECT regr_slope(user_id, target) AS s, regr_intercept(user_id, target) AS i FROM {N})""", "user_id target")
def imp_corr_line(spark, sf):
    df = fx.nulls(spark, sf).select("event_id", "user_id", "target")
    return missing.fill_correlated(df, "user_id", key="event_id", regression=True)


@query("imp_auto", f"""SELECT event_id, coalesce(value, (SELECT avg(value) FROM {N})) AS value, user_id,
  coalesce(event_type, {MODE_OF}) AS event_type, target
FROM ({sql_knn(fx.NULL_SQL, "user_id", ["value", "target"], ["event_id", "value", "event_type", "target"])})""", "value user_id target")
def imp_auto(spark, sf):
    return missing.fill_auto(fx.nulls(spark, sf), "regression", key="event_id")


# --- outliers --------------------------------------------------------------------------


def sql_iqr_report(source, c):
    return f"""SELECT '{c}' AS feature, 'iqr' AS method, count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS count,
      100.0::DOUBLE * count(*) FILTER (WHERE {c} < lo OR {c} > hi) / count(*) AS pct, any_value(lo) AS lower, any_value(hi) AS upper
    FROM ({source}), {sql_fence(source, c)}"""


def sql_fence(source, c):
    return f"""(SELECT q1 - 1.5::DOUBLE * (q3 - q1) AS lo, q3 + 1.5::DOUBLE * (q3 - q1) AS hi FROM
      (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM ({source})))"""


def sql_z_report(source, c):
    return f"""SELECT '{c}' AS feature, 'zscore' AS method,
      count(*) FILTER (WHERE s > 0 AND abs(({c} - m) / s) > 3) AS count,
      100.0::DOUBLE * count(*) FILTER (WHERE s > 0 AND abs(({c} - m) / s) > 3) / count(*) AS pct,
      any_value(m - 3 * s) AS lower, any_value(m + 3 * s) AS upper
    FROM ({source}), (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM ({source}))"""


def sql_modz(source, c):
    """Count of modified z outliers: zero if any null, all but the median if the deviation is zero."""
    return f"""CASE WHEN any_value(holes) > 0 THEN 0 WHEN any_value(mad) = 0 THEN count(*) FILTER (WHERE {c} <> med)
      ELSE count(*) FILTER (WHERE mad > 0 AND abs(0.6745::DOUBLE * ({c} - med) / nullif(mad, 0)) > 3.5) END"""


def sql_mad(source, c):
    return f"""(SELECT median(abs({c} - m)) AS mad, any_value(m) AS med, any_value(h) AS holes FROM ({source}),
      (SELECT median({c}) AS m, count(*) - count({c}) AS h FROM ({source})))"""


def sql_modz_report(source, c):
    n = sql_modz(source, c)
    return f"""SELECT '{c}' AS feature, 'modified_zscore' AS method, CAST({n} AS BIGINT) AS count,
      100.0::DOUBLE * {n} / count(*) AS pct, CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper
    FROM ({source}), {sql_mad(source, c)}"""


def sql_detect(report, sets):
    return union(report(source, c) for source, columns in sets for c in columns)


SETS = [(fx.SKEW_SQL, ["user_id", "value"]), (fx.NULL_SQL, ["value", "sparse"]), (fx.CONST_SQL, ["flat", "mostly"])]


def _detect(spark, sf, method):
    out = None
    for make, columns in [(fx.skew, ["user_id", "value"]), (fx.nulls, ["value", "sparse"]), (fx.const, ["flat", "mostly"])]:
        rows = outliers.detect(make(spark, sf), columns, (method,))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("out_iqr", sql_detect(sql_iqr_report, SETS), "pct lower upper")
def out_iqr(spark, sf):
    return _detect(spark, sf, "iqr")


@query("out_zscore", sql_detect(sql_z_report, SETS), "pct lower upper")
def out_zscore(spark, sf):
    return _detect(spark, sf, "zscore")


@query("out_modz", sql_detect(sql_modz_report, SETS), "pct lower upper")
def out_modz(spark, sf):
    return _detect(spark, sf, "modified_zscore")


def sql_clip(bounds, c):
    return f"SELECT event_id, CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, lo), hi) END AS {c} FROM ({fx.NULL_SQL}), {bounds}"


@query("out_clip", sql_clip(sql_fence(fx.NULL_SQL, "value"), "value"), "value")
def out_clip(spark, sf):
    return outliers.clip(fx.nulls(spark, sf).select("event_id", "value"), ["value"])


@query("out_clip_zscore", sql_clip(f"(SELECT avg(value) - 3 * stddev_samp(value) AS lo, avg(value) + 3 * stddev_samp(value) AS hi FROM {N})", "value"), "value")
def out_clip_zscore(spark, sf):
    return outliers.clip(fx.nulls(spark, sf).select("event_id", "value"), ["value"], "zscore")


@query("out_clip_modz", """SELECT event_id, least(greatest(value, lo), hi) AS value FROM events,
  (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events)""", "value")
def out_clip_modz(spark, sf):
    return outliers.clip(fx.skew(spark, sf).select("event_id", "value"), ["value"], "modified_zscore")


@query("out_clip_none", "SELECT l_extendedprice, l_quantity, l_discount FROM lineitem")
def out_clip_none(spark, sf):
    return outliers.clip(
        fx.table(spark, sf, "lineitem").select("l_extendedprice", "l_quantity", "l_discount"),
        ["l_extendedprice", "l_quantity", "l_discount"])


def sql_remove(keep):
    """Three columns in turn, each with fences from the rows left so far."""
    steps, source = [], f"SELECT event_id, value, user_id, value * user_id AS product FROM ({fx.SKEW_SQL})"
    for i, c in enumerate(["value", "user_id", "product"]):
        steps.append(f"s{i} AS ({source})")
        source = keep(f"s{i}", c)
    return "WITH " + ",\n".join(steps) + "\n" + source


def _products(spark, sf):
    return fx.skew(spark, sf).select("event_id", "value", "user_id", (F.col("value") * F.col("user_id")).alias("product"))


@query("out_remove", sql_remove(lambda t, c: f"""SELECT {t}.* FROM {t}, {sql_fence(f'SELECT * FROM {t}', c)} AS f WHERE {c} BETWEEN lo AND hi"""),
       "value product:4")
def out_remove(spark, sf):
    return outliers.remove(_products(spark, sf), ["value", "user_id", "product"])


@query("out_remove_zscore", sql_remove(lambda t, c: f"""SELECT {t}.* FROM {t}, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM {t}) AS f
  WHERE NOT abs(({c} - m) / s) > 3"""), "value product:4")
def out_remove_zscore(spark, sf):
    return outliers.remove(_products(spark, sf), ["value", "user_id", "product"], "zscore")


@query("flt_outlier_rows", f"""SELECT n.event_id, n.value FROM ({fx.NULL_SQL}) AS n, {sql_fence(fx.NULL_SQL, 'value')} AS f
  WHERE n.value IS NULL OR n.value BETWEEN lo AND hi""", "value")
def flt_outlier_rows(spark, sf):
    return outliers.remove(fx.nulls(spark, sf).select("event_id", "value"), ["value"])


@query("out_transform", f"""SELECT doc_id,
  CASE WHEN hits > 0 AND low > 0 AND skew > 1 THEN ln(1 + n_chars) WHEN hits > 0 AND low >= 0 THEN sqrt(n_chars) ELSE n_chars END AS n_chars
FROM (SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars FROM documents),
  (SELECT count(*) FILTER (WHERE n_chars < lo OR n_chars > hi) AS hits, min(n_chars) AS low, skewness(n_chars) AS skew
   FROM documents, {sql_fence('SELECT * FROM documents', 'n_chars')})""", "n_chars")
def out_transform(spark, sf):
    df = fx.table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"))
    return outliers.transform(df, ["n_chars"])


@query("out_total_gate", f"""SELECT event_id, CASE WHEN total > 20 THEN least(greatest(value, vlo), vhi) ELSE value END AS value,
  CASE WHEN total > 20 THEN least(greatest(user_id, ulo), uhi) ELSE user_id END AS user_id
FROM ({fx.SKEW_SQL}), (SELECT lo AS vlo, hi AS vhi FROM {sql_fence(fx.SKEW_SQL, 'value')}), (SELECT lo AS ulo, hi AS uhi FROM {sql_fence(fx.SKEW_SQL, 'user_id')}),
  (SELECT sum(count) AS total FROM ({union([sql_iqr_report(fx.SKEW_SQL, 'value'), sql_iqr_report(fx.SKEW_SQL, 'user_id')])}))""", "value user_id")
def out_total_gate(spark, sf):
    return outliers.clip_if_many(fx.skew(spark, sf).select("event_id", "value", "user_id"), ["value", "user_id"])


@query("out_all", sql_detect(sql_iqr_report, [(fx.LINE_SQL, ALL_NUM)]) + "\nUNION ALL\n" + sql_detect(sql_z_report, [(fx.LINE_SQL, ALL_NUM)])
       + "\nUNION ALL\n" + sql_detect(sql_modz_report, [(fx.LINE_SQL, ALL_NUM)]), "pct lower:4 upper:4")
def out_all(spark, sf):
    return outliers.detect(fx.line(spark, sf), ALL_NUM)
