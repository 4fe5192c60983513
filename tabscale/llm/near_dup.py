"""Near duplicates through an inverted join on MinHash signature coordinates.

Each document gets a signature of ``COORDINATES`` minima over its distinct word shingles.
Documents with the same shingle set become one. The others are posted under their
coordinate-value pairs: values in one document alone are left out, the rest are ordered
from rare to frequent, and only the prefix is posted that two documents with ``MATCHES``
common coordinates must share. Pairs that collide there have their collisions counted on
the whole signatures, so the frequent values beyond the prefixes are skipped; pairs with
enough are confirmed on their full shingle sets, read again from the texts.

Two sets at the threshold share each coordinate with probability 0.85; fewer than 32 of
64 happens to one such pair in 10^9.

Lists longer than ``LONG_LIST`` come from large groups of near copies. Their documents
are clustered by the lists they share, and a cluster is confirmed exactly in blocks of
similar size: set sizes at the threshold differ by at most one band, so only blocks of the
same or the next band meet. A block task returns a spanning forest of its links, never
all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_names, hash_words, join_uneven, mix, narrow_join, ready_workers, stored, utf8
from .components import components

WORDS = 5
#: Linked where 100 * intersection >= PERCENT * union.
PERCENT = 85
COORDINATES, MATCHES = 64, 32
#: Posting lists over this length go to the blocks.
LONG_LIST = 48
#: Shingles, and documents, that a block may hold.
BLOCK_SHINGLES, BLOCK_ROWS = 400_000, 512
_RNG = np.random.default_rng(85)
_A = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_STEPS = [np.uint64(pow(0xD6E8FEB86659FD93, i, 1 << 64)) for i in range(WORDS)]


def shingle_sets(data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a short row has its whole sequence as one."""
    words, begin = hash_words(data, at)
    if len(words) >= WORDS:
        runs = sum((words[i : len(words) - WORDS + 1 + i] * _STEPS[i] for i in range(WORDS)), np.uint64(0))
        runs = mix(runs)
    for lo, hi in zip(begin[:-1], begin[1:], strict=True):
        if hi - lo >= WORDS:
            yield np.unique(runs[lo : hi - WORDS + 1])
        elif hi > lo:
            total = np.uint64(hi - lo)
            for w in words[lo:hi]:
                total = mix(np.array([total * _STEPS[1] + w]))[0]
            yield np.array([total], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def signature(items: np.ndarray, piece: int = 2048) -> np.ndarray:
    """The least hash of each coordinate, with the coordinate's number in its last bits."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(items), piece):
        part = items[lo : lo + piece]
        np.minimum(least, (part[None, :] * _A[:, None] + _B[:, None]).min(axis=1), out=least)
    return ((least & ~np.uint64(COORDINATES - 1)) | np.arange(COORDINATES, dtype=np.uint64)).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            sizes, first, second, signs = [], [], [], []
            for items in shingle_sets(*utf8(batch["text"])):
                sizes.append(len(items))
                first.append(int(mix(items).sum(dtype=np.uint64).view(np.int64)))
                second.append(int(mix(items ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)))
                signs.append(signature(items) if len(items) else np.zeros(0, np.int64))
            lengths = np.cumsum([0, *map(len, signs)], dtype=np.int32)
            values = np.concatenate(signs) if signs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(values, pa.int64()))],
                names=["doc_id", "n_shingles", "set_a", "set_b", "items"])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (together the set's digest), items (the signature)."""
    ready_workers(docs.sparkSession)
    plain = clear_names(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    return plain.mapInArrow(_signed, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, items array<bigint>")


def postings(sets: DataFrame) -> DataFrame:
    """``item, held, doc, n`` of every set's prefix; held: how many sets have the item."""
    items = sets.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), F.explode("items").alias("item"))
    held = items.groupBy("item").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    shared = items.join(held, "item")
    # Of 64 items, those that are not shared come first; the prefix is 64 - 32 + 1 long.
    each = shared.groupBy("doc", "n").agg(F.sort_array(F.collect_list(F.struct("held", "item"))).alias("ordered")).where(F.size("ordered") >= MATCHES)
    return each.select("doc", "n", F.explode(F.slice("ordered", F.lit(1), F.size("ordered") - (MATCHES - 1))).alias("p")).select("p.item", "p.held", "doc", "n")


def _sizes_allow(a: str, b: str):
    return (F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT)


def candidate_pairs(posted: DataFrame, sets: DataFrame, clusters: DataFrame) -> DataFrame:
    """Pairs a < b that collide in a short list and whose signatures match often enough."""
    short = posted.where(F.col("held") <= LONG_LIST).select("item", "doc", "n")
    right = short.select("item", F.col("doc").alias("b"), F.col("n").alias("n_b"))
    met = short.withColumnsRenamed({"doc": "a", "n": "n_a"}).join(right, "item").where((F.col("a") < F.col("b")) & _sizes_allow("n_a", "n_b"))
    counted = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("collisions"))
    # Pairs within one cluster are confirmed there.
    one = clusters.select(F.col("node").alias("a"), F.col("component").alias("cluster_a"))
    two = clusters.select(F.col("node").alias("b"), F.col("component").alias("cluster_b"))
    counted = counted.join(one, "a", "left").join(two, "b", "left").where("NOT coalesce(cluster_a = cluster_b, false)")
    sign = sets.select(F.col("doc_id"), "items")
    both = (counted.select("a", "b").join(sign.withColumnsRenamed({"doc_id": "a", "items": "items_a"}), "a")
            .join(sign.withColumnsRenamed({"doc_id": "b", "items": "items_b"}), "b"))
    return both.where(F.size(F.array_intersect("items_a", "items_b")) >= MATCHES).select("a", "b")


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            linked = []
            for x, y in zip(shingle_sets(*utf8(batch["text_a"])), shingle_sets(*utf8(batch["text_b"])), strict=True):
                common = len(x) + len(y) - len(np.union1d(x, y))
                linked.append(bool(common) and 100 * common >= PERCENT * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    plain = clear_names(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    needed = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "pair-ids")
    texts = stored(narrow_join(plain, needed, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "pair-texts")
    return (pairs.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")
            .join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
            .select("a", "b", "text_a", "text_b").mapInArrow(_confirmed, "a bigint, b bigint"))


def _forest(left: np.ndarray, right: np.ndarray, roots: np.ndarray) -> list[tuple[int, int]]:
    """The pairs that join two trees, one after another."""
    out = []

    def root(x: int) -> int:
        while roots[x] != x:
            roots[x] = roots[roots[x]]
            x = roots[x]
        return x

    for x, y in zip(left.tolist(), right.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            roots[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def block_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Spanning forest of the links in a block, or between two blocks, of a cluster."""
    with np.errstate(over="ignore"):
        docs, side = rows["doc"].to_numpy(), rows["side"].to_numpy()
        sets = list(shingle_sets(*utf8(pa.array(rows["text"], pa.string()))))
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(code, minlength=len(values))
    wanted = often[code] > 1
    number = np.cumsum(often > 1) - 1
    owner, code = owner[wanted], number[code[wanted]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    common = np.zeros((n, n), np.float32)
    width = 4096
    edges = np.searchsorted(code, np.arange(0, (code[-1] + 1 if len(code) else 0) + width, width))
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):  # counts under 2^24 are exact
        part = np.zeros((n, width), np.float32)
        part[owner[lo:hi], code[lo:hi] - k * width] = 1
        common += part @ part.T
    total = sizes[:, None] + sizes[None, :] - common
    linked = (100 * common.astype(np.float64) >= PERCENT * total.astype(np.float64)) & (common > 0)
    across = len(set(side.tolist())) > 1
    left, right = np.nonzero(np.triu(linked, 1))
    if across:
        differ = side[left] != side[right]
        left, right = left[differ], right[differ]
    pairs = _forest(left, right, np.arange(n))
    return pd.DataFrame({"a": [int(docs[x]) for x, _ in pairs], "b": [int(docs[y]) for _, y in pairs]}, dtype="int64")


def cluster_links(posted: DataFrame, clusters: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a spanning forest per pair of blocks) between all documents of each cluster."""
    step = math.log(100 / PERCENT)
    member = (clusters.withColumnsRenamed({"node": "doc", "component": "cluster"})
              .join(posted.select("doc", "n").distinct(), "doc").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(step) + F.lit(1e-9))))
    parts = member.groupBy("cluster", "band").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(BLOCK_ROWS), F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("bigint").alias("blocks"))
    here = member.join(parts, ["cluster", "band"]).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")))
    above = parts.select("cluster", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = parts.select("cluster", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    here = here.join(above, ["cluster", "band"], "left").join(below, ["cluster", "band"], "left")

    def upto(count: str):
        return F.when(F.coalesce(count, F.lit(0)) > 0, F.sequence(F.lit(0).cast("bigint"), F.coalesce(count, F.lit(0)).cast("bigint") - 1)).otherwise(
            F.array().cast("array<bigint>"))

    def task(kind: str, band, lo, hi, side):
        return F.struct(F.lit(kind).alias("kind"), band.alias("low_band"), lo.alias("lo"), hi.alias("hi"), side.alias("side"))

    block, band = F.col("block"), F.col("band")
    same = F.transform(upto("blocks"), lambda j: task("same", band, F.least(block, j), F.greatest(block, j), F.when(block > j, 1).otherwise(F.when(block < j, 0).otherwise(0))))
    up = F.transform(upto("above"), lambda j: task("next", band, block, j, F.lit(0)))
    down = F.transform(upto("below"), lambda j: task("next", band - 1, j, block, F.lit(1)))
    plain = clear_names(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc"), "text").where("doc IS NOT NULL")
    texts = stored(narrow_join(plain, clusters.select(F.col("node").alias("doc")), "doc", "left_semi").dropDuplicates(["doc"]), "cluster-texts")
    spread = here.select("cluster", "doc", F.explode(F.concat(same, up, down)).alias("t")).select("cluster", "doc", "t.*")
    return spread.join(texts, "doc").groupBy("cluster", "kind", "low_band", "lo", "hi").applyInPandas(
        lambda rows: block_links(rows), "a bigint, b bigint")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and links that connect what is linked (ids a, b)."""
    sets = stored(signatures(docs), "signatures")
    named = sets.where("doc_id IS NOT NULL AND n_shingles > 0")
    first = named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("doc_id"))
    alone = named.join(first, ["set_a", "set_b", "doc_id"], "left_semi").dropDuplicates(["doc_id"])
    reps = stored(alone.select("doc_id", "n_shingles", "items"), "distinct-sets")
    posted = stored(postings(reps), "postings")
    crowded = posted.where(F.col("held") > LONG_LIST)
    star = crowded.join(crowded.groupBy("item").agg(F.min("doc").alias("least")), "item").select(F.col("doc").alias("a"), F.col("least").alias("b"))
    clusters = stored(components(star), "clusters")
    pairs = stored(candidate_pairs(posted, reps, clusters), "pairs")
    found = confirm(pairs, docs).unionByName(cluster_links(posted, clusters, docs))
    return sets, stored(found, "links")


def dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest id that links reach, the row's own included; one row
    of each component is kept. Texts without words (null and empty ones too) are linked
    with nothing. A row without an id has no component and is kept; repeated rows of one
    id share its component. An empty table gives no rows; other columns are not read.
    """
    sets, found = links(docs)
    merged = stored(components(found), "components")
    named = sets.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("members"))
    placed = classes.join(merged, "node", "left").select("set_a", "set_b", "members", F.coalesce("component", "node").alias("component_id"))
    out = join_uneven(named.drop("items"), stored(placed, "classes"), ["set_a", "set_b"], "members", "left").select("doc_id", "n_shingles", "component_id")
    rest = sets.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
