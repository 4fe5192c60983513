"""The corpus pipeline: raw documents to shards of training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabscale.llm import decontaminate, langid, mixing, near_dup, shards
from tabscale.llm.common import narrow_join, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; all columns are left as they are.

    Texts that are null or without a letter go. Columns named like those that the prediction adds
    step aside for it and come back unchanged; repeated rows, null ids, very long
    texts and an empty table need nothing special.
    """
    model = langid.fit(docs)
    aside = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c.lower() in ("lang_pred", "score", "rejected")}
    while set(aside.values()) & set(docs.columns):
        aside = {c: f"_{v}" for c, v in aside.items()}
    found = langid.predict(docs.withColumnsRenamed(aside), model).where("NOT rejected").drop("lang_pred", "score", "rejected")
    return found.withColumnsRenamed({v: c for c, v in aside.items()}).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Rows of one id are one document, and the smallest text stays; rows without an id all stay.
    """
    decided = stored(near_dup.dedup(docs).select("doc_id", "kept"), "near-decisions")
    gone = decided.where("NOT kept").select("doc_id").distinct()
    # An anti join keeps rows without an id.
    kept = narrow_join(docs, gone, "doc_id", "left_anti")
    repeated = decided.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    first = Window.partitionBy("doc_id").orderBy("text")
    once = narrow_join(kept, repeated, "doc_id", "left_semi").withColumn("_turn", F.row_number().over(first)).where("_turn = 1").select(*docs.columns)
    return narrow_join(kept, repeated, "doc_id", "left_anti").unionByName(once)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics have their target weights."""
    return mixing.sample(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of token ids in training order; returns what they hold."""
    return shards.materialise(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("decontaminate", benchmarks),
    ("mix_sources", mixture),
    ("token_shards", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs


#: SQL cannot express the trained and randomised stages; the tests hold run() against brute force.
ORACLE_SQL = None
