"""Exact duplicates through an extendible-hash index on files in the shared folder.

Keys are 64-bit hashes of the normalised texts. The directory starts at the depth that
the number of keys asks for and doubles while a bucket holds more keys than ``capacity``;
only overfull buckets split. Index entries lie in one folder per bucket, dealt in key
ranges. Tasks that own a key range chain the entries of one key, and the texts of chains
are compared byte by byte (grouped by the text itself, with partial sums before the
shuffle, so a text that a third of the rows share is one row of each task).
DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_names, join_uneven, narrow_join, new_path, stored

#: Keys of a bucket before it splits.
CAPACITY = 65_536
#: Bits by which the finest slots are deeper than the first directory.
DEEPER = 6
#: Directory slots that may be broadcast (16 bytes each).
SMALL_DIRECTORY = 500_000


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", "")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """``slot -> bucket, depth`` for the distinct values of ``key``, and the bits of a slot.

    A bucket is named by its depth and its leading bits. Slots of the finest depth that
    still hold too many keys stay overfull: their keys differ in later bits only.
    """
    total = keys.count()
    first = max(0, math.ceil(math.log2(max(1, total) / capacity)))
    bits = min(40, first + DEEPER)
    slot = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("bigint")
    slots = stored(keys.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("held")), "slots")
    open_slots = slots
    done = None
    for depth in range(first, bits + 1):  # each turn doubles the directory
        prefix = F.shiftrightunsigned("slot", bits - depth)
        sizes = open_slots.groupBy(prefix.alias("prefix")).agg(F.sum("held").alias("in_bucket"))
        marked = open_slots.withColumn("prefix", prefix).join(sizes, "prefix")
        fits = (F.col("in_bucket") <= capacity) | F.lit(depth == bits)
        settled = marked.where(fits).select(
            "slot", F.format_string("%02d-%d", F.lit(depth), "prefix").alias("bucket"), F.lit(depth).alias("depth"))
        done = settled if done is None else done.unionByName(settled)
        open_slots = marked.where(~fits).select("slot", "held")
        if open_slots.isEmpty():
            break
    return stored(done, "directory"), bits


def build_index(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The index: one entry per row of ``docs`` (doc_id, n_points, key, sha, bucket), in key ranges."""
    spark = docs.sparkSession
    plain = clear_names(docs, "doc_id", "text").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_points"), normalised().alias("norm"))
    entries = stored(plain.select("doc_id", "n_points", F.xxhash64("norm").alias("key"), F.unhex(F.sha2("norm", 256)).alias("sha")), "entries")
    slots, bits = directory(entries.select("key").distinct(), capacity)
    slot = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("bigint")
    n = slots.count()
    small = slots.select("slot", "bucket")
    placed = entries.withColumn("slot", slot).join(F.broadcast(small) if n <= SMALL_DIRECTORY else small, "slot").drop("slot")
    path = new_path(spark, "index")
    # The id spreads a frequent key over several ranges.
    (placed.repartitionByRange("bucket", "key", "doc_id").sortWithinPartitions("bucket", "key", "doc_id")
        .write.option("compression", "zstd").partitionBy("bucket").parquet(path))
    return spark.read.schema(placed.select("doc_id", "n_points", "key", "sha", "bucket").schema).parquet(path)


def byte_classes(docs: DataFrame, index: DataFrame) -> DataFrame:
    """Classes of equal texts with two rows or more: key, sha, group_size, keep_id."""
    chains = stored(index.groupBy("key").agg(F.count(F.lit(1)).alias("chained")).where("chained > 1").select("key"), "chains")
    plain = clear_names(docs, "doc_id", "text").select(
        F.col("doc_id").cast("bigint"), F.length(F.coalesce("text", F.lit(""))).alias("n_points"), normalised().alias("norm"))
    texts = narrow_join(plain.withColumn("key", F.xxhash64("norm")), chains, "key", "left_semi")
    # The longest original, then the smallest id, in one number: sums of this kind combine before the shuffle.
    two_64 = F.lit("18446744073709551616").cast("decimal(20,0)")
    top = F.lit("9223372036854775807").cast("decimal(19,0)")
    order = F.col("n_points").cast("decimal(10,0)") * two_64 + (top - F.col("doc_id").cast("decimal(19,0)"))
    classes = texts.select("key", "norm", order.alias("order")).groupBy("key", "norm").agg(
        F.count(F.lit(1)).alias("group_size"), F.max("order").alias("best"))
    keep = (top - F.col("best") % two_64).cast("bigint")
    return classes.where("group_size > 1").select("key", F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size", keep.alias("keep_id"))


def dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null counts as the empty text, and all empty texts are equal. The longest original
    text stays, then the smallest id. Rows without an id stay only if no equal row has
    one; repeated rows of one id share its decision. An empty table gives no rows; other
    columns are not read.
    """
    index = build_index(docs, capacity)
    classes = stored(byte_classes(docs, index), "classes")
    out = join_uneven(index.drop("bucket"), classes, ["key", "sha"], "group_size", "left", keep_count=True)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).cast("bigint")
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, keep.isNull()).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS original, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(original) DESC, doc_id) AS keep_id
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
