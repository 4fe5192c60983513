"""Score-table analytics: repetition statistics, ranks, wins, goals.

Scores are rows of (scenario, p, rep, method, score). Methods whose name starts
with ``OURS`` are the muted forest's configurations, the others its competitors.
All tables after ``rep_stats`` have one row per method and cell, whatever the
size of the data behind them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OURS = "MF"
CELL = ["scenario", "p"]

# Expected error reduction in percent by scenario, none for the linear one.
GOALS = {
    "scenario1": (31.9, 41.5),
    "scenario2": (23.7, 36.4),
    "scenario3": (16.7, 28.8),
    "scenario4": (None, None),
}
# Names of the runners' tree methods, as models.competitors and models.baselines emit them.
TREE_METHODS = ["Random_Forest", "Random Forest", "RF-log(p)", "RF-√p", "BART", "ExtraTrees", "Extra Trees", "GradientBoosting", "Gradient Boosting"]
WINS_WANTED = 7
LARGE_ERROR = 1000.0


def is_ours(prefix: str = OURS) -> Column:
    return F.col("method").startswith(prefix)


def _valid(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def rep_stats(scores: DataFrame) -> DataFrame:
    """Statistics over repetitions; a method without any valid score stays, with nulls."""
    s = _valid("score")
    return scores.groupBy(*CELL, "method").agg(
        F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"),
        F.count(s).alias("n_successful"), (F.count(s) / F.count(F.lit(1))).alias("success_rate"))


def flatten(scores: DataFrame) -> DataFrame:
    """The detail table that is exported."""
    reps = scores.groupBy(*CELL, "method").agg(F.count(F.lit(1)).alias("n_repetitions"))
    return rep_stats(scores).join(reps, [*CELL, "method"]).select(
        *CELL, "method", F.col("mean").alias("mean_score"), F.col("std").alias("std_score"),
        F.col("min").alias("min_score"), F.col("max").alias("max_score"), "success_rate", "n_repetitions")


def ranking(stats: DataFrame, keys: list[str] = CELL, value: str = "mean", lower_is_better: bool = False) -> DataFrame:
    """Rank of each method with a valid score; equal scores by method name."""
    order = F.asc(value) if lower_is_better else F.desc(value)
    w = Window.partitionBy(*keys).orderBy(order, "method")
    return stats.where(_valid(value).isNotNull()).select(*keys, "method", value, F.row_number().over(w).alias("rank"))


def error_ranking(errors: DataFrame, prefix: str = OURS) -> DataFrame:
    """Per table: winner, best configuration of ours, its rank (errors: table_name, method, error)."""
    ranked = ranking(errors, ["table_name"], "error", lower_is_better=True)
    ours = F.when(is_ours(prefix), F.struct("rank", "method", "error"))
    return ranked.groupBy("table_name").agg(
        F.min(F.struct("rank", "method", "error")).alias("w"), F.min(ours).alias("o"),
        F.min(F.when(F.col("rank") == 2, F.col("error"))).alias("second_error"),
        F.count(F.lit(1)).alias("n_methods"),
    ).select(
        "table_name", F.col("w.method").alias("winner"), F.col("w.error").alias("winner_error"),
        F.col("o.method").alias("best_config"), F.col("o.error").alias("best_error"), F.col("o.rank").alias("best_rank"),
        F.col("w.method").startswith(prefix).alias("we_win"), "second_error", "n_methods")


def top_methods(stats: DataFrame, k: int = 10) -> DataFrame:
    """The ten best mean scores of each cell."""
    return ranking(stats).where(F.col("rank") <= k)


def join_methods(ours: DataFrame, others: DataFrame, prefix: str = OURS) -> DataFrame:
    """Rows of our configurations, renamed ``MF (config)``, above those of the other methods."""
    named = ours.withColumn("method", F.concat(F.lit(f"{prefix} ("), "method", F.lit(")")))
    return named.unionByName(others, allowMissingColumns=True)


def relative_performance(table: DataFrame, task: str, keys: list[str] = ("table_name",)) -> DataFrame:
    """Error over the smallest error, or largest accuracy over accuracy; 1 is best."""
    w = Window.partitionBy(*keys)
    if task == "regression":
        relative = F.try_divide("mse_test", F.min("mse_test").over(w))
    else:
        relative = F.try_divide(F.max("accuracy_test").over(w), "accuracy_test")
    return table.withColumn("relative_performance", relative)


def best_config(table: DataFrame, metric: str, lower_is_better: bool, keys: list[str] = ("table_name",)) -> DataFrame:
    value = F.col(metric) if lower_is_better else -F.col(metric)
    best = F.min(F.when(F.col(metric).isNotNull(), F.struct(value.alias("v"), F.col("method").alias("m"))))
    return table.groupBy(*keys).agg(best.alias("b")).select(
        *keys, F.col("b.m").alias("best_config"), (F.col("b.v") if lower_is_better else -F.col("b.v")).alias("best_value"))


def table_summary(relative: DataFrame, prefix: str = OURS) -> DataFrame:
    """Per table: our best configuration and the best method, by relative performance."""
    pair = F.struct("relative_performance", "method")
    known = F.col("relative_performance").isNotNull()
    return relative.groupBy("table_name").agg(
        F.min(F.when(known & is_ours(prefix), pair)).alias("o"), F.min(F.when(known, pair)).alias("b"),
    ).select(
        "table_name", F.col("o.method").alias("best_config"), F.col("o.relative_performance").alias("best_config_relative"),
        F.col("b.method").alias("best_method"), F.col("b.relative_performance").alias("best_method_relative"))


def best_against_best(stats: DataFrame, prefix: str = OURS, lower_is_better: bool = True) -> DataFrame:
    """Per cell our best mean score against the best of the others."""
    sign = 1 if lower_is_better else -1
    pair = F.struct((sign * F.col("mean")).alias("v"), F.col("method").alias("m"), F.col("std").alias("s"))
    known = _valid("mean").isNotNull()
    cells = stats.groupBy(*CELL).agg(
        F.min(F.when(known & is_ours(prefix), pair)).alias("o"), F.min(F.when(known & ~is_ours(prefix), pair)).alias("c"))
    return cells.where("o IS NOT NULL AND c IS NOT NULL").select(
        *CELL, F.col("o.m").alias("best_ours"), (sign * F.col("o.v")).alias("our_score"), F.col("o.s").alias("our_std"),
        F.col("c.m").alias("best_other"), (sign * F.col("c.v")).alias("other_score"), F.col("c.s").alias("other_std"),
        (F.col("o.v") < F.col("c.v")).alias("win"))


def verdicts(stats: DataFrame, prefix: str = OURS) -> DataFrame:
    """Win or Loss by the lower mean error."""
    return best_against_best(stats, prefix).select(
        *CELL, F.col("best_ours").alias("best_config"), F.col("our_score").alias("our_error"), "best_other",
        F.col("other_score").alias("other_error"), F.when(F.col("win"), "Win").otherwise("Loss").alias("verdict"))


def advantage(stats: DataFrame, prefix: str = OURS) -> DataFrame:
    """Difference of the best means where higher is better."""
    return best_against_best(stats, prefix, lower_is_better=False).withColumn(
        "advantage", F.col("our_score") - F.col("other_score"))


def win_rate(best: DataFrame) -> DataFrame:
    """Share of wins in percent, mean advantage, most frequent best configuration."""
    whole = best.agg(
        F.count(F.lit(1)).alias("n_cells"), (100.0 * F.avg(F.col("win").cast("int"))).alias("win_rate"),
        F.avg(F.col("our_score") - F.col("other_score")).alias("mean_advantage"))
    votes = best.groupBy("best_ours").agg(F.count(F.lit(1)).alias("n"))
    top = votes.agg(F.min(F.struct((-F.col("n")).alias("n"), "best_ours")).alias("t")).select(F.col("t.best_ours").alias("best_config"))
    one = F.lit(1).alias("_one")
    return whole.select("*", one).join(top.select("*", one), "_one").drop("_one")


def improvement(ranks: DataFrame) -> DataFrame:
    """Error reduction of a winning configuration against the runner-up, in percent."""
    reduction = 100.0 * F.try_divide(F.col("second_error") - F.col("best_error"), F.col("second_error"))
    return ranks.select("table_name", "we_win", F.when(F.col("we_win"), reduction).alias("improvement"))


def scenario_improvement(stats: DataFrame, prefix: str = OURS) -> DataFrame:
    """Error reduction of our best configuration against the best other method, in percent."""
    best = best_against_best(stats, prefix).where("other_score > 0 AND our_score <> other_score")
    return best.select(*CELL, (100.0 * (F.col("other_score") - F.col("our_score")) / F.col("other_score")).alias("improvement"))


def goal_ranges(improvements: DataFrame, goals: Mapping[str, tuple[float | None, float | None]] = GOALS) -> DataFrame:
    """Mean, smallest and largest improvement per scenario, and whether the mean meets the goal."""
    rows = [(s, lo, hi) for s, (lo, hi) in goals.items()]
    table = improvements.sparkSession.createDataFrame(rows, "scenario string, lower double, upper double")
    means = improvements.groupBy("scenario").agg(
        F.avg("improvement").alias("mean_improvement"), F.min("improvement").alias("min_improvement"),
        F.max("improvement").alias("max_improvement"))
    # The goal table has one row per scenario.
    return means.join(F.broadcast(table), "scenario").withColumn("met", F.col("mean_improvement").between(F.col("lower"), F.col("upper")))


def top3_of_losers(ranks: DataFrame) -> DataFrame:
    """Tables not won: how many, and in how many our best rank is within three."""
    lost = ranks.where(~F.col("we_win"))
    return lost.agg(
        F.count(F.lit(1)).alias("n_lost"), F.count_if(F.col("best_rank") <= 3).alias("n_top3")
    ).withColumn("all_top3", F.col("n_lost") == F.col("n_top3"))


def config_votes(ranks: DataFrame) -> DataFrame:
    """How often each configuration is our best; the first row is the most frequent one."""
    return ranks.where("best_config IS NOT NULL").groupBy("best_config").agg(
        F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "best_config")


def goals_of_tables(ranks: DataFrame, wanted: int = WINS_WANTED) -> DataFrame:
    return ranks.agg(
        F.count_if("we_win").alias("wins"), F.count(F.lit(1)).alias("n_tables")
    ).withColumn("met", F.col("wins") >= wanted)


def beats_trees(stats: DataFrame, trees: list[str] = TREE_METHODS, linear: str = "Lasso", prefix: str = OURS) -> DataFrame:
    """Per cell: tree methods our best configuration beats, and whether the linear method beats it."""
    known = _valid("mean").isNotNull()
    ours = F.min(F.when(known & is_ours(prefix), F.col("mean")))
    w = Window.partitionBy(*CELL)
    marked = stats.withColumn("_ours", F.min(F.when(known & is_ours(prefix), F.col("mean"))).over(w))
    tree = F.col("method").isin(trees) & known
    return marked.groupBy(*CELL).agg(
        ours.alias("our_error"), F.count_if(tree & (F.col("_ours") < F.col("mean"))).alias("beaten"),
        F.count_if(tree).alias("n_trees"),
        F.coalesce(F.max(F.when((F.col("method") == linear) & known, F.col("mean") < F.col("_ours"))), F.lit(False)).alias("linear_wins"))


def diagnostics(errors: DataFrame, prefix: str = OURS, large: float = LARGE_ERROR) -> DataFrame:
    """Per table: methods of either kind, scored ones, very large errors of ours."""
    return errors.groupBy("table_name").agg(
        F.count_if(is_ours(prefix)).alias("n_ours"), F.count_if(~is_ours(prefix)).alias("n_others"),
        F.count(_valid("error")).alias("n_scored"),
        F.count_if(is_ours(prefix) & (F.col("error") > large)).alias("n_large"))


def scenario_summary(scores: DataFrame) -> DataFrame:
    """Mean and spread of the error per scenario and number of features."""
    s = _valid("score")
    return scores.groupBy(*CELL).agg(F.avg(s).alias("mean_error"), F.stddev_pop(s).alias("std_error"))
