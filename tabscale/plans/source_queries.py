"""Sources and sinks: tables written as text by Spark and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import compare
from ..session import shared_folder
from ..sources import catalog, delimited, sinks
from . import fixtures as fx
from .registry import query
from .score_queries import SCORES_SQL, STATS_SQL, scores

COLUMNS = ["p_partkey", "p_name", "p_size", "p_retailprice"]


def _folder(spark):
    return f"{shared_folder(spark)}/tabscale-{uuid.uuid4().hex}"


def _lines(df, separator, quoted):
    """Text lines of part: every tenth size has a field too many, the next one a field too few."""
    fields = [F.col(c).cast("string") for c in COLUMNS]
    if quoted:
        fields[1] = F.concat(F.lit('"'), fields[1], F.lit('"'))
    kind = F.col("p_size") % 10
    return df.select(
        F.when(kind == 0, F.concat_ws(separator, *fields, F.lit("extra")))
        .when(kind == 1, F.concat_ws(separator, *fields[:-1])).otherwise(F.concat_ws(separator, *fields)).alias("value"))


PART_READ = """SELECT p_partkey, p_name, p_size::BIGINT AS p_size, CASE WHEN p_size % 10 <> 1 THEN p_retailprice END AS p_retailprice FROM part WHERE p_size % 10 <> 0"""


@query("src_delimited", PART_READ)
def src_delimited(spark, sf):
    path = _folder(spark)
    _lines(fx.table(spark, sf, "part"), ";", False).write.text(path)
    return delimited.read_delimited(spark, path, ";", header=False, columns=COLUMNS)


@query("src_whitespace", PART_READ)
def src_whitespace(spark, sf):
    path = _folder(spark)
    _lines(fx.table(spark, sf, "part"), " \t ", True).write.text(path)
    return delimited.read_whitespace(spark, path, COLUMNS)


@query("src_header", "SELECT p_partkey, p_brand, p_size::BIGINT AS p_size, CASE WHEN p_size = 7 THEN '?' ELSE p_type END AS p_type FROM part")
def src_header(spark, sf):
    path = _folder(spark)
    df = fx.table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", F.when(F.col("p_size") == 7, "?").otherwise(F.col("p_type")).alias("p_type"))
    sinks.write_csv(df, path)
    return delimited.read_delimited(spark, path)


@query("src_catalog", "SELECT p_partkey, p_size::BIGINT AS p_size, p_retailprice AS y FROM part")
def src_catalog(spark, sf):
    """The first location is missing, the second is read; the last column is the target."""
    folder = _folder(spark)
    sinks.write_csv(fx.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), f"{folder}/concrete_mirror")
    df, target = catalog.load(spark, "concrete", folder)
    return df.withColumnRenamed(target, "y")


def _two_sources(spark, sf):
    folder = _folder(spark)
    sinks.write_csv(fx.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), f"{folder}/concrete")
    wine = fx.table(spark, sf, "events").select(F.col("user_id").alias("quality"), "value")
    wine.write.option("header", True).option("sep", ";").csv(f"{folder}/red_wine")
    return catalog.load_all(spark, folder)


UNREAD = ", ".join(f"('{n}', {len(s.locations)})" for n, s in catalog.SOURCES.items() if n not in ("concrete", "red_wine"))


@query("src_load_errors", f"SELECT name, CAST(locations AS INTEGER) AS locations, true AS missing FROM (VALUES {UNREAD}) AS v(name, locations), (SELECT count(*) AS n FROM part) WHERE n > 0")
def src_load_errors(spark, sf):
    """The sources that could not be read: how many locations were tried, and that their paths do not exist."""
    _, errors = _two_sources(spark, sf)
    tried = F.size(F.split("error", "PATH_NOT_FOUND")) - 1
    return errors.select("name", tried.alias("locations"), (tried > 0).alias("missing"))


@query("src_load_all", """SELECT 'concrete' AS name, 'p_retailprice' AS target, count(*) AS n_rows FROM part
UNION ALL SELECT 'red_wine', 'quality', count(*) FROM events""")
def src_load_all(spark, sf):
    tables, _ = _two_sources(spark, sf)
    out = None
    for name, (df, target) in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), F.lit(target).alias("target"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


@query("snk_csv", f"""SELECT scenario, p::BIGINT AS p, method, mean AS mean_score, n AS n_repetitions FROM ({STATS_SQL})""", "mean_score")
def snk_csv(spark, sf):
    prefix = _folder(spark)
    sinks.export_scores(scores(spark, sf), prefix)
    return delimited.read_delimited(spark, f"{prefix}_detailed").select("scenario", "p", "method", "mean_score", "n_repetitions")


@query("snk_json", f"SELECT scenario, p::BIGINT AS p, method, mean, n_successful FROM ({STATS_SQL})", "mean")
def snk_json(spark, sf):
    path = _folder(spark)
    sinks.write_json(sinks.nested_results(scores(spark, sf)), path)
    back = spark.read.json(path).select("scenario", F.inline("cells")).select("scenario", "p", F.inline("methods"))
    return back.select("scenario", "p", "method", "mean", "n_successful")
