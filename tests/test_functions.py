"""Building blocks against numpy and closed forms, on both the small and the large path."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscale.functions import columns, ordering, quantiles, rand, stats


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(0)
    hot = np.where(rng.random(3000) < 0.4, 7.0, np.round(rng.exponential(10, 3000), 2))
    pdf = pd.DataFrame({"k": range(3000), "a": hot, "b": rng.normal(size=3000), "c": np.arange(3000) % 5 * 1.0})
    return pdf, spark.createDataFrame(pdf).repartition(7).cache()


PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("small", [10, 60, 100_000])
def test_quantiles_do_not_depend_on_the_path(skewed, small):
    pdf, df = skewed
    found = quantiles.exact_quantiles(df, ["a", "b", "c"], PROBS, small=small)
    for c in ["a", "b", "c"]:
        assert np.allclose(found[c], pdf[c].quantile(PROBS), rtol=0, atol=1e-12)


def test_quantiles_narrow_in_several_rounds(skewed, monkeypatch):
    pdf, df = skewed
    monkeypatch.setattr(quantiles, "ACCURACY", 10)  # a coarse sketch must still end in the exact value
    found = quantiles.exact_quantiles(df, ["a", "b"], PROBS, small=5)
    for c in ["a", "b"]:
        assert np.allclose(found[c], pdf[c].quantile(PROBS), rtol=0, atol=1e-12)


def test_quantiles_of_nulls_and_many_columns(spark):
    pdf = pd.DataFrame({f"c{i}": [1.0, None, 3.0, 10.0 * i] for i in range(40)})
    df = spark.createDataFrame(pdf).withColumn("none", F.lit(None).cast("double"))
    df = columns.nan_to_null(df)
    found = quantiles.exact_quantiles(df, [*pdf.columns, "none"], [0.5])
    assert found["none"] == [None]
    for c in pdf.columns:
        assert found[c][0] == pytest.approx(pdf[c].median())


@pytest.mark.parametrize("ends", [["-inf"] * 50, ["inf"] * 50, ["-inf"] * 20 + ["inf"] * 20 + ["nan"] * 15])
def test_quantiles_with_infinite_values(spark, ends):
    values = [float(v) for v in ends] + [float(i // 3) for i in range(1000)] + [None] * 7
    df = spark.createDataFrame([(v,) for v in values], "a double").repartition(3)
    probs = [0.0, 0.02, 0.25, 0.5, 0.75, 0.97, 0.99, 1.0]
    one, many = (quantiles.exact_quantiles(df, ["a"], probs, small=s)["a"] for s in (100_000, 20))
    assert np.array_equal(np.array(one), np.array(many), equal_nan=True)
    for rank in (0, 30, 500, 1000):
        a, b = (quantiles.order_statistic(df, "a", rank, small=s) for s in (100_000, 20))
        assert a == b or (np.isnan(a) and np.isnan(b))


def test_grouped_quantiles_do_not_depend_on_the_path(spark):
    rng = np.random.default_rng(4)
    rows = [("hot" if i < 700 else f"g{i % 5}", float(np.round(rng.normal(), 1)), int(rng.integers(0, 4))) for i in range(1000)]
    df = spark.createDataFrame([*rows, ("hot", None, 1), ("hot", float("nan"), 2)], "g string, v double, w int")
    for weight in ("w", None):
        one, many = (
            {r.g: list(r.q) for r in quantiles.grouped_quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.9, 1.0], weight, small=s).collect()} for s in (100_000, 30))
        assert one.keys() == many.keys() and all(np.allclose(one[k], many[k], atol=1e-12) for k in one)


def test_grouped_quantiles_add_up_equal_values_first(spark, monkeypatch):
    """Many rows of few values need no count and no running totals."""
    def fail(*_, **__):
        raise AssertionError("running totals of few values")

    df = spark.range(1000).selectExpr("id % 3 AS g", "CAST(id % 7 AS DOUBLE) AS v", "CAST(id % 2 AS INT) AS w")
    expected = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.9)), F.col("w")).alias("q")).collect()}
    monkeypatch.setattr(quantiles, "running_totals", fail)
    found = quantiles.grouped_quantiles(df, ["g"], "v", [0.25, 0.9], "w", small=50)
    assert {r.g: r.q for r in found.collect()} == expected


def test_order_statistic(skewed):
    pdf, df = skewed
    for rank in (0, 1, 1500, 2999):
        assert quantiles.order_statistic(df, "a", rank, small=20) == sorted(pdf["a"])[rank]


@pytest.mark.parametrize("small", [1, 100_000])
def test_position(skewed, small):
    pdf, df = skewed
    got = ordering.with_position(df, [F.col("a"), F.col("k")], "i", small=small).select("k", "i").toPandas()
    want = pdf.sort_values(["a", "k"])["k"].tolist()
    assert got.sort_values("i")["k"].tolist() == want
    assert sorted(got["i"]) == list(range(3000))


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    pdf = pd.DataFrame({"g": ["x"] * 900 + ["y"] * 100, "v": list(range(900)) + list(range(100)), "n": 1})
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=0))
    for small in (1, 100_000):
        got = ordering.running_totals(df, ["g"], "v", {"t": "n"}, descending, small=small, pieces=9).toPandas()
        got = got.sort_values(["g", "v"], ascending=[True, not descending])
        for _, part in got.groupby("g"):
            assert part["t"].tolist() == list(range(1, len(part) + 1))


def test_lookup_splits_hot_keys(spark):
    keys = ["hot"] * 500 + [None] * 50 + [f"k{i}" for i in range(450)]
    big = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, k string")
    table = big.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("code", F.length("k"))
    outs = [ordering.lookup(big, table, "k", "n", small=s).select("id", "k", "code") for s in (1, 100_000)]
    rows = [sorted((r.id, r.k or "", r.code or 0) for r in o.collect()) for o in outs]
    assert rows[0] == rows[1] and len(rows[0]) == 1000


def test_normal_functions(spark):
    xs = [-38.0, -8.0, -3.0, -1.0, 0.0, 0.3, 2.5, 7.5, 40.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select("x", stats.normal_cdf(F.col("x")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), abs=1e-14)
    ps = [1e-6, 0.01, 0.3, 0.5, 0.9, 0.9999]
    back = spark.createDataFrame([(p,) for p in ps], "p double").select("p", stats.normal_quantile(F.col("p")).alias("x")).collect()
    for r in back:
        assert 0.5 * math.erfc(-r.x / math.sqrt(2)) == pytest.approx(r.p, rel=1e-7)


def test_corrected_moments_and_safe_corr(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 4, 8, 16, np.nan], "b": [2.0, 1, 5, np.nan, 9, 3], "flat": [3.0] * 6})
    df = columns.nan_to_null(spark.createDataFrame(pdf))
    r = df.agg(
        stats.sample_skewness(F.col("a")).alias("s"), stats.sample_kurtosis(F.col("a")).alias("k"),
        stats.safe_corr(F.col("a"), F.col("b")).alias("r"), stats.safe_corr(F.col("a"), F.col("flat")).alias("z")).first()
    assert r.s == pytest.approx(pdf["a"].skew())
    assert r.k == pytest.approx(pdf["a"].kurt())
    assert r.r == pytest.approx(pdf["a"].corr(pdf["b"]))
    assert r.z is None


def test_short_columns_have_no_moments(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "a double")
    r = df.agg(stats.sample_skewness(F.col("a")).alias("s"), stats.sample_kurtosis(F.col("a")).alias("k")).first()
    assert r.s is None and r.k is None


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(500)
    draws = [rand.hash_normal(1, "id").alias("z"), rand.poisson_weight(1, "id").alias("w"), rand.hash_normal_array("1", 3, "id").alias("a")]
    one, many = (sorted(df.repartition(n).select("id", *draws).collect()) for n in (1, 9))
    assert one == many
    first = df.select(rand.hash_normal("1|2", "id").alias("z"), rand.hash_normal_array("1", 3, "id")[2].alias("a")).collect()
    assert all(r.z == r.a for r in first)


def test_draws_have_the_right_shape(spark):
    r = spark.range(20_000).select(rand.hash_normal(1, "id").alias("z"), rand.poisson_weight(2, "id").alias("w")).agg(
        F.avg("z"), F.stddev("z"), F.avg("w"), F.var_pop("w")).first()
    assert abs(r[0]) < 0.03 and abs(r[1] - 1) < 0.03 and abs(r[2] - 1) < 0.03 and abs(r[3] - 1) < 0.05


def test_per_feature_wide_and_long_agree(skewed, monkeypatch):
    _, df = skewed
    run = lambda: sorted(map(tuple, columns.per_feature(
        df, ["a", "b", "c"], {"n": lambda c, p: F.count_if(c > p["t"]), "m": lambda c, p: F.max(c)},
        {c: {"t": 1.0} for c in "abc"}).select("feature", "n", "m").collect()))
    wide = run()
    monkeypatch.setattr(columns, "WIDE_LIMIT", 1)
    assert run() == wide


def test_draws_are_alike_in_sql_and_numpy(spark):
    from tabscale.functions import draws

    rows = [(i * 7919 % draws.PRIME, (i * 104729) % (1 << 30)) for i in range(200)]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    found = df.select(
        "a", "b", draws.fold(F.col("a"), F.col("b")).alias("f"), draws.pick(draws.fold(F.col("a"), F.col("b")), F.lit(7)).alias("k"),
        draws.poisson(F.col("a"), draws.fold(F.col("b"), 3), 0.85).alias("w")).toPandas()
    a, b = found.a.to_numpy(), found.b.to_numpy()
    f = draws.np_fold(a, b)
    assert (found.f == f).all() and f[5] == draws.int_fold(int(a[5]), int(b[5]))
    assert (found.k == draws.np_pick(f, 7)).all() and set(found.k) == set(range(7))
    assert (found.w == draws.np_poisson(a, draws.np_fold(b, 3), draws.poisson_table(0.85))).all()


def test_draws_are_poisson_and_even():
    from tabscale.functions import draws

    rows, trials = draws.np_fold(11, np.arange(20_000)), draws.np_fold(13, np.arange(50))
    w = draws.np_poisson(rows[:, None], trials[None, :], draws.poisson_table(0.85))
    expected = [math.exp(-0.85) * 0.85**k / math.factorial(k) for k in range(5)]
    assert np.allclose([(w == k).mean() for k in range(5)], expected, atol=0.003)
    assert np.abs(np.corrcoef(w.T) - np.eye(50)).max() < 0.05
    u = draws.np_uniform(draws.np_fold(5, np.arange(100_000)))
    assert np.allclose(np.histogram(u, 10, (0, 1))[0], 10_000, atol=500)
