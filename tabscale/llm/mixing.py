"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per (source, language, topic). Factors per source, language and topic
are raked until the weighted tokens meet the three target marginals, and every document
is sampled with a probability in proportion to its cell's factors, calibrated so that
the expected tokens meet the budget. A sweep is two small aggregations over one row per
source, so the number of sources may grow; languages and topics are few.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_names, join_uneven, stored

#: Share of all tokens to keep, in expectation.
BUDGET = 0.5
#: Targets are the shares raised to these powers and scaled to one: under 1 evens out.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 1.0}
SWEEPS, CALIBRATIONS = 12, 12
SEED = "mix-1"
NONE = "none"
#: Cells that may be broadcast (about 100 bytes each).
SMALL_CELLS = 100_000


def topic_of(text):
    """The form of a text, as its topic: table, markup, shout, list or prose."""
    size = F.greatest(F.length(text), F.lit(1))

    def share(mark: str):
        return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / size

    return (F.when(share("|") > 0.02, "table").when(share("%") + share("$") + share("&") + share("#") > 0.05, "markup")
            .when(share("!") > 0.05, "shout").when(share("\n") > 0.02, "list").otherwise("prose"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens (words); a null category is ``none``."""
    text = F.coalesce("text", F.lit(""))
    return clear_names(docs, "doc_id", "text", "source", "lang").select(
        "doc_id", F.coalesce("source", F.lit(NONE)).alias("source"), F.coalesce("lang", F.lit(NONE)).alias("lang"),
        topic_of(text).alias("topic"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("n_tokens"))


def _targets(cells: DataFrame, name: str, total: int, given: dict[str, float] | None) -> DataFrame:
    sums = cells.groupBy(name).agg(F.sum("n_tokens").alias("held"))
    if given is None:
        sums = sums.withColumn("wish", F.when(F.col("held") > 0, F.pow(F.col("held") / F.lit(float(total)), F.lit(POWERS[name]))).otherwise(0.0))
    else:
        table = F.create_map(*[x for k, v in given.items() for x in (F.lit(k), F.lit(float(v)))]) if given else None
        sums = sums.withColumn("wish", F.coalesce(F.try_element_at(table, F.col(name)), F.lit(0.0)) if given else F.lit(0.0))
        sums = sums.withColumn("wish", F.when(F.col("held") > 0, F.col("wish")).otherwise(0.0))
    return sums.select(name, "wish")


def _scaled(rows) -> dict[str, float]:
    wishes = {r[0]: r[1] for r in rows}
    whole = sum(wishes[k] for k in sorted(wishes)) or 1.0
    return {k: v / whole for k, v in wishes.items()}


def _lookup(values: dict[str, float], key):
    return F.element_at(F.create_map(*[F.lit(x) for kv in sorted(values.items()) for x in kv]), key)


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, sweeps: int = SWEEPS) -> tuple[DataFrame, dict, dict]:
    """Factors: a table source -> source_factor, and dictionaries of languages and topics.

    After a sweep, the sum over cells of tokens times the three factors has the target
    shares (of a total of 1) where the targets can be met together. ``cells`` has one row
    per source, language and topic.
    """
    given = targets or {}
    total = cells.agg(F.sum("n_tokens")).first()[0] or 0
    lang_goal = _scaled(_targets(cells, "lang", total, given.get("lang")).collect())
    topic_goal = _scaled(_targets(cells, "topic", total, given.get("topic")).collect())
    wishes = _targets(cells, "source", total, given.get("source"))
    whole = wishes.agg(F.sum("wish")).first()[0] or 1.0
    # One row per source with its cells: as many as languages times topics at most.
    rows = stored(
        cells.where("n_tokens > 0").groupBy("source").agg(F.collect_list(F.struct("lang", "topic", "n_tokens")).alias("cells"))
        .join(wishes.select("source", (F.col("wish") / whole).alias("goal")), "source"), "sources")
    if not total:
        return rows.select("source", F.lit(0.0).alias("source_factor")), {k: 0.0 for k in lang_goal} or {NONE: 0.0}, {k: 0.0 for k in topic_goal} or {NONE: 0.0}
    langs, topics = dict.fromkeys(lang_goal, 1.0), dict.fromkeys(topic_goal, 1.0)

    def fitted() -> DataFrame:
        mass = F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["n_tokens"] * _lookup(langs, c["lang"]) * _lookup(topics, c["topic"]))
        return rows.withColumn("mass", mass).withColumn("source_factor", F.when(F.col("mass") > 0, F.col("goal") / F.col("mass")).otherwise(0.0))

    def sums(fixed: DataFrame, name: str, other) -> dict[str, float]:
        each = fixed.select("source_factor", F.explode("cells").alias("c"))
        mass = F.sum(F.col("source_factor") * F.col("c.n_tokens") * other(F.col("c")))
        return {r[0]: r[1] for r in each.groupBy(F.col(f"c.{name}")).agg(mass).collect()}

    for _ in range(sweeps):
        fixed = fitted()  # the sources meet their targets, given languages and topics
        got = sums(fixed, "lang", lambda c: _lookup(topics, c["topic"]))
        langs = {k: goal / got[k] if got.get(k) else 0.0 for k, goal in lang_goal.items()}
        got = sums(fixed, "topic", lambda c: _lookup(langs, c["lang"]))
        topics = {k: goal / got[k] if got.get(k) else 0.0 for k, goal in topic_goal.items()}
    return fitted().select("source", "source_factor"), langs, topics


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, sweeps: int = SWEEPS, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, lang, topic, n_tokens, weight, probability, kept.

    ``targets`` gives shares per source, lang or topic; by default they are the shares
    in the table raised to ``POWERS``. ``weight`` is the cell's raked factor, with mean 1
    over tokens. A probability is at most 1; what that takes away is spread over the other
    cells. Null categories are ``none``. Texts without words have weight 0 tokens and get
    their cell's probability (0 if the cell has no words at all). A digest of the id
    decides, so repeated rows share a decision, and a null id is the id ''.
    An empty table gives no rows; other columns are not read.
    """
    rows = stored(measured(docs), "measured")
    return _with_cells(rows, calibrated(rows, targets, budget, sweeps), {}).select(
        "doc_id", "source", "lang", "topic", "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"),
        F.coalesce("probability", F.lit(0.0)).alias("probability"),
        (_draw(seed) < F.coalesce("probability", F.lit(0.0))).alias("kept"))


def calibrated(rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, sweeps: int = SWEEPS) -> DataFrame:
    """``source, lang, topic, weight, probability`` of every cell of measured rows."""
    cells = stored(rows.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs")), "cells")
    sources, langs, topics = rake(cells, targets, sweeps)
    weighted = stored(cells.join(sources, "source").withColumn(
        "share", F.col("source_factor") * _lookup(langs or {NONE: 0.0}, F.col("lang")) * _lookup(topics or {NONE: 0.0}, F.col("topic"))), "weights")
    total = weighted.agg(F.sum("n_tokens")).first()[0] or 0
    level = budget * total  # tokens kept = sum of n * min(1, level * share)
    for _ in range(CALIBRATIONS):
        full = F.col("share") * F.lit(level) >= 1
        got = weighted.agg(F.sum(F.when(full, F.col("n_tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("n_tokens") * F.col("share")))).first()
        if not got[1]:
            break
        level = max(0.0, budget * total - got[0]) / got[1]
    return weighted.select(
        "source", "lang", "topic", (F.col("share") * F.lit(float(total))).alias("weight"),
        F.least(F.lit(1.0), F.col("share") * F.lit(level)).alias("probability"), "n_docs")


def _with_cells(rows: DataFrame, cells: DataFrame, names: dict[str, str]) -> DataFrame:
    """The rows with their cell's columns. A small table of cells is broadcast, else only its frequent ones."""
    keyed = cells.withColumnsRenamed(names)
    on = [names.get(c, c) for c in ("source", "lang", "topic")]
    if keyed.count() <= SMALL_CELLS:
        return rows.join(F.broadcast(keyed.drop("n_docs")), on, "left")
    return join_uneven(rows, keyed, on, "n_docs", "left")


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, sweeps: int = SWEEPS, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` that ``mix`` keeps, with all their columns; texts are not shuffled while cells are few."""
    names = {c: f"_mix_{c}" for c in ("source", "lang", "topic", "weight", "probability")}
    cells = calibrated(measured(docs), targets, budget, sweeps)
    place = {"_mix_source": F.coalesce("source", F.lit(NONE)), "_mix_lang": F.coalesce("lang", F.lit(NONE)), "_mix_topic": topic_of(F.coalesce("text", F.lit("")))}
    placed = _with_cells(docs.withColumns(place), cells, names)
    return placed.where(_draw(seed) < F.coalesce("_mix_probability", F.lit(0.0))).select(*[F.col(f"`{c}`") for c in docs.columns])


def _draw(seed: str):
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
