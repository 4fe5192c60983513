"""Feature preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prepare
from . import fixtures as fx
from .profile_queries import union
from .registry import query

L = f"({fx.LINE_SQL})"


@query("prj_modeling_ready", """SELECT event_id, CAST(user_id AS DOUBLE) AS user_id, TRY_CAST(event_type AS DOUBLE) AS event_type,
  TRY_CAST(k AS DOUBLE) AS k, value FROM (SELECT *, regexp_extract(props, '[0-9]+') AS k FROM events)""")
def prj_modeling_ready(spark, sf):
    df = fx.table(spark, sf, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0))
    return prepare.modeling_ready(df, ["user_id", "event_type", "k", "value"], keep=["event_id"])


@query("prj_label_numeric", """SELECT event_id, CASE WHEN label = '1' THEN 1.0 ELSE 0.0 END::DOUBLE AS from_text, flag::DOUBLE AS from_flag, user_id::DOUBLE AS from_number
FROM (SELECT event_id, user_id, CAST(user_id % 3 AS VARCHAR) AS label, CAST(user_id % 2 = 1 AS INTEGER) AS flag FROM events)""")
def prj_label_numeric(spark, sf):
    df = fx.table(spark, sf, "events").select(
        "event_id", "user_id", (F.col("user_id") % 3).cast("string").alias("label"), (F.col("user_id") % 2 == 1).alias("flag"))
    return df.select("event_id", *[prepare.numeric_label(df, c).alias(n) for c, n in
                                   [("label", "from_text"), ("flag", "from_flag"), ("user_id", "from_number")]])


@query("prj_nan_random_label", f"""SELECT event_id, CASE WHEN value IS NULL THEN CASE WHEN {fx.sql_uniform(42, 'event_id')} < 0.5 THEN 0.0 ELSE 1.0 END
  ELSE value END::DOUBLE AS label FROM ({fx.NULL_SQL})""")
def prj_nan_random_label(spark, sf):
    df = fx.nulls(spark, sf)
    # Every second missing value is a NaN, as a failed model would give.
    broken = F.when(F.col("value").isNull() & (F.col("event_id") % 80 == 0), F.lit(float("nan"))).otherwise(F.col("value"))
    return df.select("event_id", prepare.random_label_if_nan(broken, 42, "event_id").alias("label"))


@query("prj_finite_or_zero", f"SELECT event_id, coalesce(value, 0.0)::DOUBLE AS value FROM ({fx.NULL_SQL})")
def prj_finite_or_zero(spark, sf):
    broken = (
        F.when(F.col("value").isNull() & (F.col("event_id") % 80 == 0), F.lit(float("nan")))
        .when(F.col("value").isNull() & (F.col("event_id") % 120 == 0), F.lit(float("-inf")))
        .otherwise(F.col("value")))
    return fx.nulls(spark, sf).select("event_id", prepare.finite_or_zero(broken).alias("value"))


MIX = 12
MIX_PICKS = [fx.LINE_FEATURES[prepare._pick(42, i, 4)] for i in range(MIX)]


@query("prep_noise_mix", "SELECT row_id, " + ", ".join(
    f"({c} - m_{c}) / (s_{c} + 1e-8::DOUBLE) + 2.0 * {fx.sql_normal(f'42|mix|{i}', 'row_id')} AS noise_signal_1to2_{i}"
    for i, c in enumerate(MIX_PICKS)) + f" FROM {L}, (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in fx.LINE_FEATURES) + f" FROM {L})",
    " ".join(f"noise_signal_1to2_{i}" for i in range(MIX)))
def prep_noise_mix(spark, sf):
    mixed = prepare.noise_mix(fx.line(spark, sf), fx.LINE_FEATURES, "row_id", MIX)
    return mixed.select("row_id", *[f"noise_signal_1to2_{i}" for i in range(MIX)])


@query("prep_noise_pad", "SELECT p_partkey, p_size, " + ", ".join(
    f"{fx.sql_normal(f'42|pad|{i}', 'p_partkey')} AS extra_noise_{i}" for i in range(31)) + " FROM part",
    " ".join(f"extra_noise_{i}" for i in range(31)))
def prep_noise_pad(spark, sf):
    return prepare.noise_pad(fx.part(spark, sf).select("p_partkey", "p_size"), ["p_size"], "p_partkey", width=32)


U = fx.sql_uniform(42, "row_id")
SPLIT = f"SELECT *, CASE WHEN row_number() OVER (ORDER BY {U}, row_id) <= 150 THEN 'train' ELSE 'test' END AS split FROM {L}"


def _marked(parts, *columns):
    train, test = parts
    return train.select(F.lit("train").alias("split"), *columns).unionByName(test.select(F.lit("test").alias("split"), *columns))


@query("prep_split", f"SELECT row_id, split FROM ({SPLIT})")
def prep_split(spark, sf):
    return _marked(prepare.split(fx.line(spark, sf), "row_id"), "row_id")


@query("prep_split_large", f"SELECT row_id, CASE WHEN row_number() OVER (ORDER BY {U}, row_id) <= 40000 THEN 'train' ELSE 'test' END AS split FROM {L}")
def prep_split_large(spark, sf):
    return _marked(prepare.split(fx.line(spark, sf), "row_id", train_rows=40000), "row_id")


@query("prep_split_fraction", f"SELECT row_id, CASE WHEN {U} < 0.8 THEN 'train' ELSE 'test' END AS split FROM {L}")
def prep_split_fraction(spark, sf):
    return _marked(prepare.split_fraction(fx.line(spark, sf), "row_id", 0.8), "row_id")


def sql_scaled(columns, spread):
    cells = ", ".join(f"({c} - m_{c}) / {spread(f's_{c}')} AS {c}" for c in columns)
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in columns)
    return f"""WITH s AS (SELECT *, 1.0::DOUBLE AS flat FROM ({SPLIT})) SELECT row_id, split, {cells} FROM s, (SELECT {stats} FROM s WHERE split = 'train')"""


SCALED = ["l_quantity", "l_discount", "l_tax", "flat"]


def _scaled(spark, sf, eps=None):
    df = fx.line(spark, sf).withColumn("flat", F.lit(1.0))
    return _marked(prepare.scale(*prepare.split(df, "row_id"), SCALED, eps), "row_id", *SCALED)


@query("prep_scale", sql_scaled(SCALED, lambda s: f"(CASE WHEN {s} = 0 THEN 1 ELSE {s} END)"), " ".join(SCALED))
def prep_scale(spark, sf):
    return _scaled(spark, sf)


@query("prep_scale_eps", sql_scaled(SCALED, lambda s: f"({s} + 1e-8::DOUBLE)"), " ".join(SCALED))
def prep_scale_eps(spark, sf):
    return _scaled(spark, sf, 1e-8)


EVENT_SPLIT = f"""SELECT *, CASE WHEN row_number() OVER (ORDER BY {fx.sql_uniform(42, 'event_id')}, event_id) <= 150 THEN 'train' ELSE 'test' END AS split FROM ({fx.NULL_SQL})"""


@query("prep_label_encode", f"""SELECT event_id, split, (dense_rank() OVER (ORDER BY coalesce(event_type, 'nan')) - 1)::DOUBLE AS event_type FROM ({EVENT_SPLIT})""")
def prep_label_encode(spark, sf):
    parts = prepare.split(fx.nulls(spark, sf).select("event_id", "event_type"), "event_id")
    return _marked(prepare.label_encode(*parts, ["event_type"]), "event_id", "event_type")


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("prep_onehot", f"SELECT event_id, split, " + ", ".join(
    f"CASE WHEN event_type = '{v}' AND EXISTS (SELECT 1 FROM ({EVENT_SPLIT}) WHERE split = 'train' AND event_type = '{v}') THEN 1.0 ELSE 0.0 END::DOUBLE AS event_type_{v}"
    for v in EVENT_TYPES) + f" FROM ({EVENT_SPLIT})")
def prep_onehot(spark, sf):
    parts = prepare.split(fx.nulls(spark, sf).select("event_id", "event_type"), "event_id")
    return _marked(prepare.one_hot(*parts, ["event_type"]), "event_id", *[f"event_type_{v}" for v in EVENT_TYPES])


PART_SPLIT = f"""SELECT *, row_number() OVER (ORDER BY {fx.sql_uniform(42, 'p_partkey')}, p_partkey) <= 150 AS is_train FROM part"""


@query("prep_onehot_vector", f"""WITH s AS ({PART_SPLIT}), c AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS code FROM (SELECT DISTINCT p_name FROM s WHERE is_train))
SELECT p_partkey, CAST((SELECT count(*) FROM c) AS INTEGER) AS width, CAST(coalesce(code, -1) AS INTEGER) AS hot FROM s LEFT JOIN c USING (p_name)""")
def prep_onehot_vector(spark, sf):
    from pyspark.ml.functions import vector_to_array

    df = fx.table(spark, sf, "part").select("p_partkey", "p_name")
    train, test = prepare.one_hot_vector(*prepare.split(df, "p_partkey"), "p_name")
    cells = vector_to_array("p_name")
    # The position of the one; 0 of array_position means the zero vector.
    return train.unionByName(test).select(
        "p_partkey", F.size(cells).alias("width"), (F.array_position(cells, 1.0) - 1).cast("int").alias("hot"))


@query("prep_encode_missing", f"""SELECT event_id, (dense_rank() OVER (ORDER BY coalesce(event_type, 'missing')) - 1)::DOUBLE AS event_type FROM ({fx.NULL_SQL})""")
def prep_encode_missing(spark, sf):
    return prepare.encode_missing(fx.nulls(spark, sf).select("event_id", "event_type"), ["event_type"])


MAKERS = ["one", "two", "other"]  # first digit of the brand: values that every training part has
MAKER_SQL = "CASE substr(p_brand, 1, 7) WHEN 'Brand#1' THEN 'one' WHEN 'Brand#2' THEN 'two' ELSE 'other' END"


def sql_prepared(target, texts, n):
    """``texts``: (column, SQL) of the encoded text features; one number, ``n`` noise columns mixed with it."""
    noise = [f"noise_signal_1to2_{i}" for i in range(n)]
    raw = ", ".join(f"(p_size - m) / (s + 1e-8::DOUBLE) + 2.0 * {fx.sql_normal(f'42|mix|{i}', 'p_partkey')} AS {c}" for i, c in enumerate(noise))
    scaled = ["p_size", *noise]
    stats = ", ".join(f"avg({c}) FILTER (WHERE is_train) AS m_{c}, stddev_pop({c}) FILTER (WHERE is_train) AS s_{c}" for c in scaled)
    cells = ", ".join(f"({c} - m_{c}) / (CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END) AS {c}" for c in scaled)
    encoded = ", ".join(f'{sql} AS "{c}"' for c, sql in texts)
    return f"""WITH p AS ({PART_SPLIT}), n AS (SELECT p_partkey, {target}, p_brand, p_type, is_train, p_size, {raw} FROM p, (SELECT avg(p_size) AS m, stddev_pop(p_size) AS s FROM p)),
t AS (SELECT {stats} FROM n) SELECT CASE WHEN is_train THEN 'train' ELSE 'test' END AS split, p_partkey, {target}, {encoded}, {cells} FROM n, t"""


REG_TEXTS = [(c, f"(dense_rank() OVER (ORDER BY {c}) - 1)::DOUBLE") for c in ("p_brand", "p_type")]
CLS_TEXTS = [(f"p_brand_{v}", f"CASE WHEN {MAKER_SQL} = '{v}' THEN 1.0 ELSE 0.0 END::DOUBLE") for v in MAKERS]


@query("prep_prepared_table", sql_prepared("p_retailprice", REG_TEXTS, 497), "p_size " + " ".join(f"noise_signal_1to2_{i}" for i in range(497)))
def prep_prepared_table(spark, sf):
    parts = prepare.prepare(fx.part(spark, sf), "p_retailprice", "p_partkey", "regression")
    return _marked(parts, *[f"`{c}`" for c in parts[0].columns])


@query("prep_prepared_table_cls", sql_prepared("p_type", CLS_TEXTS, 496), "p_size " + " ".join(f"noise_signal_1to2_{i}" for i in range(496)))
def prep_prepared_table_cls(spark, sf):
    df = fx.part(spark, sf).drop("p_retailprice").withColumn("p_brand", F.expr(MAKER_SQL))
    parts = prepare.prepare(df, "p_type", "p_partkey", "classification")
    return _marked(parts, *[f"`{c}`" for c in parts[0].columns])


@query("prep_prepared_width", f"""SELECT split, CAST(500 AS INTEGER) AS n_features, count(*) AS n_rows, avg(p_retailprice) AS target_mean
FROM (SELECT p_retailprice, CASE WHEN is_train THEN 'train' ELSE 'test' END AS split FROM ({PART_SPLIT})) GROUP BY split""", "target_mean")
def prep_prepared_width(spark, sf):
    train, test = prepare.prepare(fx.part(spark, sf), "p_retailprice", "p_partkey", "regression")
    rows = prepare.summary(train, test, "p_retailprice", "regression")
    return rows.select("split", F.lit(len(train.columns) - 2).alias("n_features"), F.col("n").alias("n_rows"), "target_mean")


@query("prep_summary", f"SELECT split, count(*) AS n, avg(l_extendedprice) AS target_mean FROM ({SPLIT}) GROUP BY split", "target_mean:4")
def prep_summary(spark, sf):
    return prepare.summary(*prepare.split(fx.line(spark, sf), "row_id"), "l_extendedprice", "regression")


@query("prep_summary_cls", f"SELECT split, l_returnflag AS class, count(*) AS n FROM ({SPLIT}) GROUP BY split, l_returnflag")
def prep_summary_cls(spark, sf):
    return prepare.summary(*prepare.split(fx.line(spark, sf), "row_id"), "l_returnflag", "classification")


@query("prep_report", "SELECT task, count(*) AS n_tables, avg(n_features) AS mean_features, avg(n_noise) AS mean_noise FROM ("
       + union([
           "SELECT CASE WHEN count(DISTINCT l_extendedprice) < least(20.0, 0.1 * count(*)) THEN 'classification' ELSE 'regression' END AS task, 500 AS n_features, 494 AS n_noise FROM lineitem",
           "SELECT CASE WHEN count(DISTINCT p_retailprice) < least(20.0, 0.1 * count(*)) THEN 'classification' ELSE 'regression' END, 500, 497 FROM part",
           "SELECT CASE WHEN count(DISTINCT label) < least(20.0, 0.1 * count(*)) THEN 'classification' ELSE 'regression' END, 500, 436 FROM embeddings"])
       + ") GROUP BY task", "mean_features mean_noise")
def prep_report(spark, sf):
    from ..operators.profile import task_by_share

    out = None
    for df, key, target in [(fx.line(spark, sf), "row_id", "l_extendedprice"), (fx.part(spark, sf), "p_partkey", "p_retailprice"),
                            (fx.wide(spark, sf), "vec_id", "label")]:
        task = task_by_share(df.drop(key), target)
        train, _ = prepare.prepare(df, target, key, task.first().task)
        noise = [c for c in train.columns if "noise" in c]
        row = task.select("task", F.lit(len(train.columns) - 2).alias("n_features"), F.lit(len(noise)).alias("n_noise"))
        out = row if out is None else out.unionByName(row)
    return prepare.report(out)
