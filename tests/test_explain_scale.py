"""Explanations of tables in one piece: dealt over the cores, with the draws that SQL recomputes."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscale.functions.rand import hash_normal, hash_normal_array, np_normal_grid, np_word_grid, np_words
from tabscale.operators import explain

FEATURES = ["a", "b", "c"]
METHODS = {
    "shapley": lambda s, r, b: explain.shapley(s, r, b, FEATURES),
    "kernel": lambda s, r, b: explain.kernel_shapley(s, r, b, FEATURES),
    "local": lambda s, r, b: explain.local_surrogate(s, r, [1.0, 2.0, 0.5], FEATURES, samples=50),
}


@pytest.mark.parametrize("length", [0, 3, 55, 56, 64, 130])
def test_words_are_those_of_the_digest(length):
    texts = np.random.default_rng(length).integers(0, 256, (50, length)).astype(np.uint8)
    digests = [hashlib.md5(t.tobytes()).digest() for t in texts]
    for i, words in enumerate(np_words(texts)):
        assert words.tolist() == [int.from_bytes(d[4 * i:4 * i + 4], "big") for d in digests]


@pytest.mark.parametrize("size", [0, 3, 4, 12, 53, 60, 66])
@pytest.mark.parametrize("length", [0, 1, 4, 70])
def test_words_of_heads_and_tails_are_those_of_the_digest(size, length, monkeypatch):
    monkeypatch.setattr("tabscale.functions.rand.TEXTS", 30)
    draw = np.random.default_rng(size + length)
    heads, tails = (draw.integers(0, 256, (n, k)).astype(np.uint8) for n, k in ((7, size), (13, length)))
    found = np_word_grid(heads, tails)
    for i, j in np.ndindex(7, 13):
        digest = hashlib.md5(heads[i].tobytes() + tails[j].tobytes()).digest()
        assert [int(w[i, j]) for w in found] == [int.from_bytes(digest[:4], "big"), int.from_bytes(digest[4:8], "big")]


def test_normals_of_heads_and_tails_are_the_single_ones(spark):
    found = np_normal_grid(["7|0", "7|11"], [b"|5|", b"|123456|", b"|"], [b"%d" % s for s in (3, 10, 11, 5, 1234)])
    rows = spark.createDataFrame([(k, s) for k in (5, 123456, None) for s in (3, 10, 11, 5, 1234)], "k long, s long")
    drawn = rows.select(hash_normal("7|0", "k", "s").alias("a"), hash_normal("7|11", "k", "s").alias("b")).toPandas().to_numpy().T
    assert found.reshape(2, -1) == pytest.approx(drawn, abs=1e-12)


@pytest.mark.parametrize("samples", [50, 70])
def test_samples_scored_in_place_give_the_surrogate_of_the_scored_rows(spark, samples, monkeypatch):
    """Also where an instance's samples are more than are made at once; a key that comes twice counts twice."""
    monkeypatch.setattr(explain, "DRAWS", 180)
    monkeypatch.setattr(explain, "ALTERED", 60)
    rows = spark.createDataFrame([(k, [float(k or 0), 2.0, -1.0]) for k in (1, 22, 333, 22, None)], "instance long, x array<double>")
    linear = explain.linear_scorer([1.0, -2.0, 3.0], 0.5)
    here, there = (
        {(r.instance, r.feature): r.weight for r in explain.local_surrogate(s, rows, [1.0, 2.0, 0.5], FEATURES, samples=samples).collect()}
        for s in (linear, lambda df: linear(df)))
    assert len(here) == 12 and here.keys() == there.keys()
    assert all(here[k] == pytest.approx(there[k], rel=1e-9) for k in here)
    plan = explain.local_surrogate(linear, rows, [1.0, 2.0, 0.5], FEATURES, samples=samples)._jdf.queryExecution().toString()
    assert "_wz" not in plan  # altered rows do not leave their task


def test_many_normals_are_the_single_ones(spark):
    rows = spark.createDataFrame([(1, "x"), (12345, None), (None, "é" * 40), (None, None)], "a long, b string")
    found = rows.select(hash_normal_array(7, 40, "a", "b").alias("v"), *[hash_normal(f"7|{i}", "a", "b").alias(f"v{i}") for i in range(40)]).collect()
    for r in found:
        assert r.v == pytest.approx([r[f"v{i}"] for i in range(40)], abs=1e-12)


def test_draws_are_spark_hashes(spark):
    rows = spark.range(-3, 50).select(F.xxhash64(F.lit("42"), "id").alias("h"), *[F.xxhash64(F.lit("42"), "id", F.lit(5), F.lit(j)).alias(f"h{j}") for j in range(4)])
    table = rows.toPandas()
    start = explain._hash_int(table["h"].to_numpy().view(np.uint64), np.full(len(table), 5))
    assert (explain._hash_int(start[:, None], np.arange(4)).view(np.int64) == table[[f"h{j}" for j in range(4)]].to_numpy()).all()


@pytest.mark.parametrize("method", METHODS)
def test_a_table_in_one_piece_is_scored_by_many_tasks(spark, method):
    rows = explain.instances(spark.range(200).select("id", *[(F.col("id") % k).cast("double").alias(f) for f, k in zip(FEATURES, (5, 7, 11))]).coalesce(1), "id", FEATURES)
    pieces = []

    def scorer(df):
        pieces.append(df.select(F.spark_partition_id().alias("p")).distinct().count())
        return explain.linear_scorer([1.0, 2.0, 3.0])(df)

    found = METHODS[method](scorer, rows, explain.background(rows, "instance", 10))
    assert found.count() == 600 and pieces[0] > 1


def test_missing_values_stay_missing(spark):
    """A null feature makes scores null, which sums leave out; it does not become NaN."""
    rows = spark.createDataFrame([(1, [1.0, None]), (2, [1.0, 2.0])], "instance long, x array<double>")
    back = spark.createDataFrame([(3, [0.0, 0.0])], "instance long, x array<double>")
    found = {(r.instance, r.feature): r.phi for r in explain.shapley(explain.linear_scorer([1.0, 1.0]), rows, back, ["a", "b"]).collect()}
    assert found[2, "a"] == 1.0 and found[2, "b"] == 2.0
    assert all(v is None or v == v for v in found.values())


def test_surrogates_of_missing_values_have_no_weights(spark):
    rows = spark.createDataFrame([(1, [1.0, None]), (2, [1.0, 2.0])], "instance long, x array<double>")
    found = explain.local_surrogate(explain.linear_scorer([1.0, 1.0]), rows, [1.0, 1.0], ["a", "b"], samples=50).collect()
    assert len(found) == 4 and all((r.weight is None) == (r.instance == 1) for r in found)
