"""Projections, profiles and chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import numeric_columns, text_columns
from ..operators import charts, profile
from . import fixtures as fx
from .registry import query

LINE_NUM = fx.LINE_FEATURES
ALL_NUM = [*LINE_NUM, "l_extendedprice"]


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def with_(**ctes) -> str:
    return "WITH " + ",\n".join(f"{name} AS (\n{sql}\n)" for name, sql in ctes.items()) + "\n"


# --- projections -----------------------------------------------------------------


@query("prj_numeric", "SELECT event_id, user_id, value FROM events")
def prj_numeric(spark, sf):
    df = fx.table(spark, sf, "events")
    return df.select(*numeric_columns(df))


@query("prj_categorical", "SELECT event_type, props FROM events")
def prj_categorical(spark, sf):
    df = fx.table(spark, sf, "events")
    return df.select(*text_columns(df))


@query("prj_feature_types", """
SELECT 'numeric' AS kind, CAST(5 AS INTEGER) AS n_features, count(*) AS n_rows FROM lineitem
UNION ALL SELECT 'text', CAST(2 AS INTEGER), count(*) FROM lineitem""")
def prj_feature_types(spark, sf):
    df = fx.line(spark, sf).drop("row_id")
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.select(F.inline(F.array(
        F.struct(F.lit("numeric").alias("kind"), F.lit(len(numeric_columns(df))).alias("n_features"), "n_rows"),
        F.struct(F.lit("text").alias("kind"), F.lit(len(text_columns(df))).alias("n_features"), "n_rows"))))


@query("src_target_split", "SELECT p_partkey, p_size, p_brand, p_type, p_retailprice AS y FROM part")
def src_target_split(spark, sf):
    from ..sources.catalog import split_target

    features, target = split_target(fx.part(spark, sf), "price_not_there")
    df = fx.part(spark, sf)
    return df.select(*features, F.col(target).alias("y"))


# --- profile ------------------------------------------------------------------------


@query("prof_basic", """
SELECT count(*) AS n_rows, CAST(7 AS INTEGER) AS n_columns, CAST(6 AS INTEGER) AS n_features,
  'l_extendedprice' AS target,
  CASE WHEN count(DISTINCT l_extendedprice) < least(20.0, 0.1 * count(*)) THEN 'classification' ELSE 'regression' END AS task
FROM lineitem""")
def prof_basic(spark, sf):
    return profile.basic_info(fx.line(spark, sf).drop("row_id"), "l_extendedprice")


def _rule_a(name, source, column, text):
    test = "count(*) >= 0" if text else f"count(DISTINCT {column}) < least(20.0, 0.1 * count(*))"
    return f"""SELECT '{name}' AS target, CASE WHEN {test} THEN 'classification' ELSE 'regression' END AS task,
      count(DISTINCT {column}) AS n_unique, count(*) AS n_rows FROM ({source})"""


@query("prof_task_rule_a", union([
    _rule_a("price", fx.LINE_SQL, "l_extendedprice", False),
    _rule_a("flag", fx.LINE_SQL, "l_returnflag", True),
    _rule_a("quality", fx.IMBAL_SQL, "quality", False),
    _rule_a("user_id", fx.NULL_SQL, "user_id", False)]))
def prof_task_rule_a(spark, sf):
    cases = [("price", fx.line(spark, sf), "l_extendedprice"), ("flag", fx.line(spark, sf), "l_returnflag"),
             ("quality", fx.imbalanced(spark, sf), "quality"), ("user_id", fx.nulls(spark, sf), "user_id")]
    out = None
    for name, df, target in cases:
        row = profile.task_by_share(df, target).select(F.lit(name).alias("target"), "task", "n_unique", "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


def _rule_b(name, source, column):
    n = f"(count(DISTINCT {column}) + max(CASE WHEN {column} IS NULL THEN 1 ELSE 0 END))"
    return f"""SELECT '{name}' AS target, CASE WHEN {n} <= 20 THEN 'classification' ELSE 'regression' END AS task,
      CAST({n} AS BIGINT) AS n_unique FROM ({source})"""


@query("prof_task_rule_b", union([
    _rule_b("price", fx.LINE_SQL, "l_extendedprice"), _rule_b("label", fx.WIDE_SQL, "label"),
    _rule_b("event_type", fx.NULL_SQL, "event_type")]))
def prof_task_rule_b(spark, sf):
    cases = [("price", fx.line(spark, sf), "l_extendedprice"), ("label", fx.wide(spark, sf), "label"),
             ("event_type", fx.nulls(spark, sf), "event_type")]
    out = None
    for name, df, target in cases:
        row = profile.task_by_count(df, target).select(F.lit(name).alias("target"), "task", "n_unique")
        out = row if out is None else out.unionByName(row)
    return out


def sql_missing(source: str, columns) -> str:
    return union(
        f"SELECT '{c}' AS feature, count(*) - count({c}) AS missing_count, 100.0::DOUBLE * (count(*) - count({c})) / count(*) AS missing_pct FROM ({source})"
        for c in columns)


@query("prof_missing", f"SELECT * FROM ({sql_missing(fx.NULL_SQL, fx.NULL_COLUMNS)}) WHERE missing_count > 0", "missing_pct")
def prof_missing(spark, sf):
    return profile.missing(fx.nulls(spark, sf), fx.NULL_COLUMNS)


def sql_duplicates(source: str, columns: str) -> str:
    return f"""SELECT CAST(sum(n) - count(*) AS BIGINT) AS duplicates,
      100.0::DOUBLE * (sum(n) - count(*)) / sum(n) AS duplicate_pct
    FROM (SELECT {columns}, count(*) AS n FROM ({source}) GROUP BY {columns})"""


@query("prof_duplicates", sql_duplicates("SELECT * FROM lineitem", "l_quantity, l_discount, l_tax"), "duplicate_pct")
def prof_duplicates(spark, sf):
    return profile.duplicates(fx.table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax"))


@query("prof_duplicates_null", sql_duplicates(fx.NULL_SQL, "user_id, event_type"), "duplicate_pct")
def prof_duplicates_null(spark, sf):
    return profile.duplicates(fx.nulls(spark, sf).select("user_id", "event_type"))


@query("prof_target_base", union([
    f"SELECT 'double' AS type, count(*) - count(value) AS missing, count(DISTINCT value) AS n_unique FROM ({fx.NULL_SQL})",
    f"SELECT 'string' AS type, count(*) - count(event_type) AS missing, count(DISTINCT event_type) AS n_unique FROM ({fx.NULL_SQL})"]))
def prof_target_base(spark, sf):
    df = fx.nulls(spark, sf)
    return profile.target_base(df, "value").unionByName(profile.target_base(df, "event_type"))


def sql_target(source: str, c: str) -> str:
    return f"""SELECT avg({c}) AS mean, median({c}) AS median, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max,
      quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.75) AS q75, skewness({c}) AS skewness, kurtosis({c}) AS kurtosis
    FROM ({source})"""


TARGET_DOUBLES = "mean:4 median:4 std:4 min max q25:4 q75:4 skewness kurtosis"


@query("prof_target_reg", sql_target(fx.LINE_SQL, "l_extendedprice"), TARGET_DOUBLES)
def prof_target_reg(spark, sf):
    return profile.target_regression(fx.line(spark, sf), "l_extendedprice")


@query("prof_target_reg_null", sql_target(fx.NULL_SQL, "value"), TARGET_DOUBLES)
def prof_target_reg_null(spark, sf):
    return profile.target_regression(fx.nulls(spark, sf), "value")


def sql_classes(source: str, c: str) -> str:
    return f"""SELECT CAST({c} AS VARCHAR) AS class, count(*) AS n,
      count(*)::DOUBLE / (SELECT count(*) FROM ({source})) AS proportion
    FROM ({source}) WHERE {c} IS NOT NULL GROUP BY {c}"""


@query("prof_target_cls", sql_classes(fx.NULL_SQL, "event_type"), "proportion")
def prof_target_cls(spark, sf):
    return profile.class_distribution(fx.nulls(spark, sf), "event_type")


@query("prof_imbalance", f"""SELECT count(*) AS n_classes, max(n)::DOUBLE / min(n) AS imbalance
FROM ({sql_classes(fx.IMBAL_SQL, 'quality')})""", "imbalance")
def prof_imbalance(spark, sf):
    return profile.class_imbalance(fx.imbalanced(spark, sf), "quality")


def sql_corr(source: str, columns, y: str) -> str:
    return union(
        f"SELECT '{c}' AS feature, covar_samp({c}, {y}) / nullif(stddev_samp({c}) FILTER (WHERE {y} IS NOT NULL) * stddev_samp({y}) FILTER (WHERE {c} IS NOT NULL), 0) AS correlation FROM ({source})"
        for c in columns)


@query("prof_corr_reg", sql_corr(fx.LINE_SQL, LINE_NUM, "l_extendedprice"), "correlation")
def prof_corr_reg(spark, sf):
    return profile.correlations(fx.line(spark, sf).drop("row_id"), "l_extendedprice")


@query("prof_corr_reg_null", sql_corr(fx.NULL_SQL, ["user_id", "sparse", "target"], "value"), "correlation")
def prof_corr_reg_null(spark, sf):
    return profile.correlations(fx.nulls(spark, sf).drop("event_id"), "value")


@query("prof_corr_const", sql_corr(fx.CONST_SQL, ["l_quantity", "flat", "mostly"], "l_extendedprice"), "correlation")
def prof_corr_const(spark, sf):
    return profile.correlations(fx.const(spark, sf), "l_extendedprice")


@query("prof_corr_wide", sql_corr(fx.WIDE_SQL, fx.WIDE_FEATURES, "label"), "correlation")
def prof_corr_wide(spark, sf):
    return profile.correlations(fx.wide(spark, sf).drop("vec_id"), "label")


CODED = f"""SELECT n.*, coalesce(code, -1)::DOUBLE AS code FROM ({fx.NULL_SQL}) AS n LEFT JOIN
  (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM
    (SELECT DISTINCT event_type FROM ({fx.NULL_SQL}) WHERE event_type IS NOT NULL)) AS c USING (event_type)"""


@query("prof_corr_cls", sql_corr(CODED, ["value", "user_id", "sparse", "target"], "code"), "correlation")
def prof_corr_cls(spark, sf):
    return profile.class_correlations(fx.nulls(spark, sf).drop("event_id"), "event_type")


def sql_iqr(source: str, c: str) -> str:
    return f"""(SELECT count(*) FROM ({source}) AS s, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3
      FROM ({source})) AS b WHERE {c} < q1 - 1.5::DOUBLE * (q3 - q1) OR {c} > q3 + 1.5::DOUBLE * (q3 - q1))"""


def sql_distribution(source, columns):
    return union(
        f"SELECT '{c}' AS feature, skewness({c}) AS skewness, kurtosis({c}) AS kurtosis, {sql_iqr(source, c)} AS outliers_iqr FROM ({source})"
        for c in columns)


@query("prof_distribution", union([
    sql_distribution(fx.SKEW_SQL, ["user_id", "value"]), sql_distribution(fx.LINE_SQL, ALL_NUM)]), "skewness kurtosis")
def prof_distribution(spark, sf):
    return profile.distributions(fx.skew(spark, sf), ["user_id", "value"]).unionByName(
        profile.distributions(fx.line(spark, sf), ALL_NUM))


@query("prof_iqr_count", union(f"SELECT '{c}' AS feature, {sql_iqr(fx.WIDE_SQL, c)} AS outliers_iqr" for c in fx.WIDE_FEATURES))
def prof_iqr_count(spark, sf):
    return profile.iqr_outlier_counts(fx.wide(spark, sf), fx.WIDE_FEATURES)


def sql_categorical(source, columns):
    return union(f"""SELECT '{c}' AS feature, (SELECT count(DISTINCT {c}) FROM ({source})) AS n_unique,
      (SELECT {c} FROM ({source}) WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS top_value,
      (SELECT count(*) AS n FROM ({source}) WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC LIMIT 1) AS top_value_freq,
      (SELECT count(*) - count({c}) FROM ({source})) AS missing""" for c in columns)


@query("prof_categorical", union([
    sql_categorical(fx.LINE_SQL, ["l_returnflag", "l_linestatus"]), sql_categorical(fx.NULL_SQL, ["event_type"]),
    sql_categorical(fx.PART_SQL, ["p_brand", "p_type"])]))
def prof_categorical(spark, sf):
    return (
        profile.categorical(fx.line(spark, sf), ["l_returnflag", "l_linestatus"])
        .unionByName(profile.categorical(fx.nulls(spark, sf)))
        .unionByName(profile.categorical(fx.part(spark, sf))))


def sql_cells(section, source, feature, names) -> str:
    return union(f"SELECT '{section}' AS section, {feature} AS feature, '{k}' AS key, CAST({c} AS DOUBLE) AS value FROM ({source})"
                 for k, c in names.items())


def sql_summary(source, target, columns, features, texts):
    t = f"'{target}'"
    stats = ["mean", "median", "std", "min", "max", "q25", "q75", "skewness", "kurtosis"]
    return union([
        sql_cells("basic", f"SELECT count(*) AS n FROM ({source})", t,
                  {"rows": "n", "columns": str(len(columns)), "features": str(len(columns) - 1)}),
        sql_cells("missing", f"SELECT * FROM ({sql_missing(source, columns)}) WHERE missing_count > 0", "feature",
                  {"count": "missing_count", "pct": "missing_pct"}),
        sql_cells("duplicates", sql_duplicates(source, ", ".join(columns)), t, {"count": "duplicates", "pct": "duplicate_pct"}),
        sql_cells("target", f"SELECT count(*) - count({target}) AS m, count(DISTINCT {target}) AS u FROM ({source})", t,
                  {"missing": "m", "n_unique": "u"}),
        sql_cells("target", sql_target(source, target), t, {s: s for s in stats}),
        sql_cells("correlation", sql_corr(source, features, target), "feature", {"correlation": "correlation"}),
        sql_cells("distribution", sql_distribution(source, features), "feature",
                  {"skewness": "skewness", "kurtosis": "kurtosis", "outliers_iqr": "outliers_iqr"}),
        sql_cells("categorical", sql_categorical(source, texts), "feature",
                  {"n_unique": "n_unique", "top_value_freq": "top_value_freq", "missing": "missing"}),
    ])


@query("prof_summary", sql_summary(
    fx.LINE_SQL, "l_extendedprice", [*LINE_NUM, "l_returnflag", "l_linestatus", "l_extendedprice"], LINE_NUM,
    ["l_returnflag", "l_linestatus"]), "value:4")
def prof_summary(spark, sf):
    return profile.summary(fx.line(spark, sf), "l_extendedprice", key="row_id")


@query("prof_summary_null", sql_summary(
    fx.NULL_SQL, "target", fx.NULL_COLUMNS, ["value", "user_id", "sparse"], ["event_type"]), "value:4")
def prof_summary_null(spark, sf):
    return profile.summary(fx.nulls(spark, sf), "target", key="event_id")


# quality is 0 or 1: a number, but classes by the task rule.
CODED_SQL = f"SELECT *, (dense_rank() OVER (ORDER BY quality) - 1)::DOUBLE AS code FROM ({fx.IMBAL_SQL})"


@query("prof_summary_classes", union([
    sql_cells("basic", f"SELECT count(*) AS n FROM ({fx.IMBAL_SQL})", "'quality'", {"rows": "n", "columns": "3", "features": "2"}),
    sql_cells("missing", f"SELECT * FROM ({sql_missing(fx.IMBAL_SQL, ['quality', 'toxic', 'n_chars'])}) WHERE missing_count > 0", "feature", {"count": "missing_count", "pct": "missing_pct"}),
    sql_cells("duplicates", sql_duplicates(fx.IMBAL_SQL, "quality, toxic, n_chars"), "'quality'", {"count": "duplicates", "pct": "duplicate_pct"}),
    sql_cells("target", f"SELECT count(*) - count(quality) AS m, count(DISTINCT quality) AS u FROM ({fx.IMBAL_SQL})", "'quality'", {"missing": "m", "n_unique": "u"}),
    sql_cells("target", f"SELECT max(n)::DOUBLE / min(n) AS r FROM ({sql_classes(fx.IMBAL_SQL, 'quality')})", "'quality'", {"imbalance": "r"}),
    sql_cells("classes", f"SELECT quality::VARCHAR AS c, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS s FROM ({fx.IMBAL_SQL}) GROUP BY quality", "c", {"n": "n", "proportion": "s"}),
    sql_cells("correlation", sql_corr(CODED_SQL, ["toxic", "n_chars"], "code"), "feature", {"correlation": "correlation"}),
    sql_cells("distribution", sql_distribution(fx.IMBAL_SQL, ["toxic", "n_chars"]), "feature", {"skewness": "skewness", "kurtosis": "kurtosis", "outliers_iqr": "outliers_iqr"})]), "value:4")
def prof_summary_classes(spark, sf):
    return profile.summary(fx.imbalanced(spark, sf), "quality", key="doc_id")


@query("prof_insights", union([
    f"""SELECT 'l_extendedprice' AS target, 'simple' AS width,
      CASE WHEN abs(skewness(l_extendedprice)) < 0.5 THEN 'normal' ELSE 'skewed' END AS verdict,
      skewness(l_extendedprice) AS value FROM ({fx.LINE_SQL})""",
    f"""SELECT 'value' AS target, 'simple' AS width, CASE WHEN abs(skewness(value)) < 0.5 THEN 'normal' ELSE 'skewed' END,
      skewness(value) FROM ({fx.SKEW_SQL})""",
    f"""SELECT 'event_type' AS target, 'simple' AS width, CASE WHEN max(n)::DOUBLE / min(n) < 3 THEN 'balanced' ELSE 'imbalanced' END,
      max(n)::DOUBLE / min(n) FROM ({sql_classes(fx.NULL_SQL, 'event_type')})""",
    f"""SELECT 'label' AS target, 'complex' AS width, CASE WHEN few AND ratio < 3 THEN 'balanced' WHEN few THEN 'imbalanced' WHEN abs(skew) < 0.5 THEN 'normal' ELSE 'skewed' END,
      CASE WHEN few THEN ratio ELSE skew END FROM (SELECT count(DISTINCT label) < least(20.0, 0.1 * count(*)) AS few, skewness(label) AS skew FROM ({fx.WIDE_SQL})),
      (SELECT max(n)::DOUBLE / min(n) AS ratio FROM ({sql_classes(fx.WIDE_SQL, 'label')}))""",
    f"""SELECT 'quality' AS target, 'simple' AS width, CASE WHEN max(n)::DOUBLE / min(n) < 3 THEN 'balanced' ELSE 'imbalanced' END, max(n)::DOUBLE / min(n)
      FROM ({sql_classes(fx.IMBAL_SQL, 'quality')})"""]), "value")
def prof_insights(spark, sf):
    parts = [
        profile.insights(fx.line(spark, sf).drop("row_id"), "l_extendedprice"),
        profile.insights(fx.skew(spark, sf).drop("event_id"), "value"),
        profile.insights(fx.nulls(spark, sf).drop("event_id"), "event_type"),
        profile.insights(fx.wide(spark, sf).drop("vec_id"), "label"),
        profile.insights(fx.imbalanced(spark, sf).drop("doc_id"), "quality")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _multi(name, source, target, columns, text):
    test = "count(*) >= 0" if text else f"count(DISTINCT {target}) < least(20.0, 0.1 * count(*))"
    nulls = " + ".join(f"(count(*) - count({c}))" for c in columns)
    cols = ", ".join(columns)
    return f"""SELECT '{name}' AS table_name, '{target}' AS target, (SELECT CASE WHEN {test} THEN 'classification' ELSE 'regression' END FROM ({source})) AS task,
      (SELECT count(*) FROM ({source})) AS n_rows, CAST({len(columns) - 1} AS INTEGER) AS n_features,
      (SELECT CAST({nulls} AS BIGINT) FROM ({source})) AS missing,
      (SELECT duplicates FROM ({sql_duplicates(source, cols)})) AS duplicates"""


@query("prof_multi", union([
    _multi("line", fx.LINE_SQL, "l_extendedprice", [*LINE_NUM, "l_returnflag", "l_linestatus", "l_extendedprice"], False),
    _multi("events", fx.NULL_SQL, "event_type", fx.NULL_COLUMNS, True),
    _multi("part", fx.PART_SQL, "p_retailprice", ["p_size", "p_brand", "p_type", "p_retailprice"], False)]))
def prof_multi(spark, sf):
    return profile.profile_tables({
        "line": (fx.line(spark, sf).drop("row_id"), "l_extendedprice"),
        "events": (fx.nulls(spark, sf).drop("event_id"), "event_type"),
        "part": (fx.part(spark, sf).drop("p_partkey"), "p_retailprice")})


# --- chart tables ----------------------------------------------------------------------


def sql_hist(source: str, c: str, k: int) -> str:
    return f"""SELECT CAST(b.bin AS INTEGER) AS bin, lo + b.bin * ((hi - lo) / {k}) AS bin_start,
      lo + (b.bin + 1) * ((hi - lo) / {k}) AS bin_end, coalesce(n, 0) AS n
    FROM range({k}) AS b(bin) CROSS JOIN (SELECT min({c}) AS lo, max({c}) AS hi FROM ({source})) AS e
    LEFT JOIN (SELECT least(floor(({c} - lo) / (hi - lo) * {k}), {k - 1})::BIGINT AS bin, count(*) AS n
      FROM ({source}), (SELECT min({c}) AS lo, max({c}) AS hi FROM ({source})) GROUP BY 1) AS h ON h.bin = b.bin"""


@query("chart_hist", sql_hist(fx.SKEW_SQL, "value", 30), "bin_start bin_end")
def chart_hist(spark, sf):
    return charts.histogram(fx.skew(spark, sf), "value", 30)


@query("chart_hist20", sql_hist(fx.LINE_SQL, "l_extendedprice", 20), "bin_start bin_end")
def chart_hist20(spark, sf):
    return charts.histogram(fx.line(spark, sf), "l_extendedprice", 20)


def sql_poly(x, coefficients):
    acc = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        acc = f"({acc} * {x} + {c!r}::DOUBLE)"
    return acc


def sql_ppf(p: str) -> str:
    from ..functions.stats import PPF_A, PPF_B, PPF_C, PPF_D, PPF_LOW

    low = f"sqrt(-2.0::DOUBLE * ln({p}))"
    high = f"sqrt(-2.0::DOUBLE * ln(1 - {p}))"
    r = f"(({p} - 0.5::DOUBLE) * ({p} - 0.5::DOUBLE))"
    return f"""CASE WHEN {p} < {PPF_LOW} THEN {sql_poly(low, PPF_C)} / {sql_poly(low, PPF_D)}
      WHEN {p} > 1 - {PPF_LOW} THEN -{sql_poly(high, PPF_C)} / {sql_poly(high, PPF_D)}
      ELSE {sql_poly(r, PPF_A)} * ({p} - 0.5::DOUBLE) / {sql_poly(r, PPF_B)} END"""


@query("chart_qq", f"""WITH r AS (SELECT value, row_number() OVER (ORDER BY value, event_id) AS i, count(*) OVER () AS n FROM ({fx.SKEW_SQL})),
p AS (SELECT i AS rank, value, CASE WHEN i = n THEN pow(0.5::DOUBLE, 1.0::DOUBLE / n) WHEN i = 1 THEN 1 - pow(0.5::DOUBLE, 1.0::DOUBLE / n)
  ELSE (i - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS pr FROM r),
t AS (SELECT rank, {sql_ppf('pr')} AS theoretical, value FROM p)
SELECT t.*, s * theoretical + c AS line FROM t, (SELECT regr_slope(value, theoretical) AS s, regr_intercept(value, theoretical) AS c FROM t)""",
    "theoretical value line:5")
def chart_qq(spark, sf):
    return charts.normal_plot(fx.skew(spark, sf), "value", "event_id")


@query("chart_class_bars", f"SELECT class, n FROM ({sql_classes(fx.NULL_SQL, 'event_type')})")
def chart_class_bars(spark, sf):
    return charts.class_bars(fx.nulls(spark, sf), "event_type")


@query("chart_class_pie", f"SELECT class, 100.0::DOUBLE * n / sum(n) OVER () AS pct FROM ({sql_classes(fx.NULL_SQL, 'event_type')})", "pct")
def chart_class_pie(spark, sf):
    return charts.class_pie(fx.nulls(spark, sf), "event_type")


def sql_matrix(source, columns):
    return union(
        f"SELECT '{a}' AS a, '{b}' AS b, covar_samp({a}, {b}) / nullif(stddev_samp({a}) FILTER (WHERE {b} IS NOT NULL) * stddev_samp({b}) FILTER (WHERE {a} IS NOT NULL), 0) AS correlation FROM ({source})"
        for a in columns for b in columns)


FIRST_CODED = f"""SELECT l.* EXCLUDE (l_returnflag), code::DOUBLE AS l_returnflag FROM ({fx.LINE_SQL}) AS l JOIN
  (SELECT l_returnflag, row_number() OVER (ORDER BY min(row_id)) - 1 AS code FROM ({fx.LINE_SQL}) GROUP BY 1) AS c USING (l_returnflag)"""


@query("chart_corr_matrix", sql_matrix(FIRST_CODED, [*ALL_NUM, "l_returnflag"]), "correlation")
def chart_corr_matrix(spark, sf):
    return charts.target_correlation_matrix(fx.line(spark, sf), "l_returnflag", "row_id", ALL_NUM)


@query("chart_corr_matrix_classes", sql_matrix(f"""SELECT l.* EXCLUDE (quality), code::DOUBLE AS quality FROM ({fx.IMBAL_SQL}) AS l JOIN
  (SELECT quality, row_number() OVER (ORDER BY min(doc_id)) - 1 AS code FROM ({fx.IMBAL_SQL}) GROUP BY 1) AS c USING (quality)""", ["toxic", "n_chars", "quality"]), "correlation")
def chart_corr_matrix_classes(spark, sf):
    return charts.target_correlation_matrix(fx.imbalanced(spark, sf), "quality", "doc_id")


@query("chart_corr_matrix_wide", f"""WITH long AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT 'x' || a.i AS a, 'x' || b.i AS b, corr(a.v, b.v) AS correlation FROM long AS a JOIN long AS b USING (vec_id) GROUP BY a.i, b.i""", "correlation")
def chart_corr_matrix_wide(spark, sf):
    return charts.correlation_matrix(fx.wide(spark, sf), fx.WIDE_FEATURES)


@query("chart_corr_sample", sql_matrix(fx.WIDE_SQL, [f"x{i}" for i in range(8)]), "correlation")
def chart_corr_sample(spark, sf):
    df = fx.wide(spark, sf).drop("vec_id", "label")
    # The chart shows the first eight numeric columns.
    return charts.correlation_matrix(df, numeric_columns(df)[:8])


@query("chart_corr_top", f"""SELECT CASE WHEN length(feature) > 10 THEN substr(feature, 1, 10) || '...' ELSE feature END AS label,
  correlation, CASE WHEN correlation >= 0 THEN 'green' ELSE 'red' END AS colour
FROM ({sql_corr(fx.LINE_SQL, LINE_NUM, 'l_extendedprice')}) ORDER BY correlation DESC NULLS LAST, feature LIMIT 6""", "correlation")
def chart_corr_top(spark, sf):
    return charts.correlation_bars(profile.correlations(fx.line(spark, sf).drop("row_id"), "l_extendedprice"))
