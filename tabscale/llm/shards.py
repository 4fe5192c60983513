"""Token-ID output in training order: a keyed permutation and fixed-stride shards.

Every document is tokenised whole, closed by an end mark and cut into sequences of equal
length. Sequences are numbered in the order of the stored files, and a keyed Feistel
network with cycle walking turns the number into a slot, a permutation of 0..n-1 that
needs no table. Records of one stride are written in slot order, ``SHARD_SLOTS`` to a
file, by Spark's own committed writer: a slot's shard and place in it follow from its
number, so training reads in order and resumes anywhere.

Texts are tokenised twice, to count and to write: that keeps no second copy of the
tokens, and what a lost executor held is made again from the input. Both passes see the
same file splits; every task checks that against its count and fails otherwise.
"""

from __future__ import annotations

import base64
import contextlib
import functools
import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clear_names, mix, new_path, ready_workers

#: A file of byte-pair ranks, and the pattern that goes with it. The runs are those of the
#: vocabulary's own pattern; taking them possessively only saves the search for shorter ones.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:s|t|re|ve|m|ll|d)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Without two signs of white space in a row there is nothing to look ahead for, and an
#: automaton that never turns back finds the same runs with these.
PLAIN = r"""'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"""
GAP = r"[\t-\r \x{85}\p{Z}]{2}"
#: The free id after the ranks ends a document and fills its last sequence.
END = 50_256
LENGTH = 256
SHARD_SLOTS = 16_384
KEY = 20_260_101
FEISTEL_ROUNDS = 6
#: slot, document, sequence of the document, tokens; then the tokens and a line feed.
HEAD = np.dtype([("slot", "<i8"), ("doc_id", "<i8"), ("seq", "<i4"), ("n", "<i4")])
#: Stands for a null id.
NO_ID = -(1 << 63)


def record_type(length: int = LENGTH) -> np.dtype:
    return np.dtype([*HEAD.descr, ("ids", "<u2", (length,)), ("feed", "u1")])


class Tokens:
    """Token ids of whole texts. ``plain`` stands for ``pattern`` in texts that ``gap`` does not match."""

    def __init__(self, ranks: str = RANKS, pattern: str = PATTERN, plain: str = PLAIN, gap: str = GAP) -> None:
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding, self.plain = (tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=merges, special_tokens={}) for p in (pattern, plain))
        self.gap = gap

    def encode(self, texts: pa.Array) -> Iterator[list[int]]:
        """The ids of each text of a column."""
        whole, plain = self.encoding.encode_ordinary, self.plain.encode_ordinary
        gaps = pc.match_substring_regex(texts, self.gap).to_pylist()
        for text, gap in zip(texts.to_pylist(), gaps, strict=True):
            yield (whole if gap else plain)(text) if text else []

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as bytes."""
        return [array("H", ids).tobytes() for ids in self.encode(pa.array(texts, pa.string()))]


@functools.lru_cache(maxsize=2)
def tokens(ranks: str = RANKS) -> Tokens:
    return Tokens(ranks)


def slots(numbers: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The keyed permutation of 0..n-1 at ``numbers``: a Feistel network over the least even
    number of bits, walked until the value is below n."""
    half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    with np.errstate(over="ignore"):
        keys = mix(np.arange(1, FEISTEL_ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

        def permute(x: np.ndarray) -> np.ndarray:
            left, right = x >> half, x & low
            for k in keys:
                left, right = right, left ^ (mix(right ^ k) & low)
            return (left << half) | right

        x = permute(np.asarray(numbers).astype(np.uint64))
        walking = np.flatnonzero(x >= np.uint64(n))
        while len(walking):
            x[walking] = permute(x[walking])
            walking = walking[x[walking] >= np.uint64(n)]
    return x.astype(np.int64)


def _counted(ranks: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sequences, check = tokens(ranks).encode, 0, 0
        for batch in batches:
            sequences += sum((len(ids) + length) // length for ids in encode(batch["text"]))
            check = zlib.crc32(np.array([NO_ID if i is None else i for i in batch["doc_id"].to_pylist()], "<i8").tobytes(), check)
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([sequences], pa.int64()), pa.array([check], pa.int64())], names=["part", "sequences", "check"])

    return run


def _sequences(fixed, ranks: str, length: int, shard_slots: int, key: int):
    kind = record_type(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, n = fixed.value
        part = TaskContext.get().partitionId()
        start, expected, wanted = starts.get(part, (0, 0, 0))
        encode, number, check = tokens(ranks).encode, start, 0
        for batch in batches:
            docs = np.array([NO_ID if i is None else i for i in batch["doc_id"].to_pylist()], "<i8")
            check = zlib.crc32(docs.tobytes(), check)
            rows = [array("H", ids) for ids in encode(batch["text"])]
            sizes = np.array([len(r) + 1 for r in rows], np.int64)
            counts = (sizes + length - 1) // length
            at = np.concatenate([[0], np.cumsum(counts)])
            out = np.zeros(at[-1], kind)
            flat = np.full(at[-1] * length, END, "<u2")
            for r, lo in zip(rows, at[:-1].tolist(), strict=True):
                flat[lo * length : lo * length + len(r)] = r
            out["ids"] = flat.reshape(-1, length)
            out["doc_id"] = np.repeat(docs, counts)
            seq = np.arange(at[-1]) - np.repeat(at[:-1], counts)
            out["seq"] = seq
            out["n"] = np.minimum(length, np.repeat(sizes, counts) - seq * length)
            out["slot"] = slots(np.arange(number, number + at[-1]), n, key)
            out["feed"] = 10
            number += int(at[-1])
            # The line feed is the writer's.
            body = out.view(np.uint8).reshape(-1, kind.itemsize)[:, :-1]
            offsets = pa.array(np.arange(len(out) + 1) * (kind.itemsize - 1), pa.int32())
            payload = pa.Array.from_buffers(pa.binary(), len(out), [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(body).tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["slot"] // shard_slots, pa.int64()), pa.array(out["slot"].copy(), pa.int64()), payload], names=["shard", "slot", "record"])
        if (number - start, check) != (expected, wanted):
            raise RuntimeError("the documents changed between the two passes; store them first")

    return run


@contextlib.contextmanager
def _fixed_splits(spark: SparkSession):
    """File splits must not depend on how many executors there are just now."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)


def write(docs: DataFrame, path: str, length: int = LENGTH, shard_slots: int = SHARD_SLOTS, key: int = KEY, ranks: str = RANKS) -> dict:
    """Write all documents as shards under ``path`` and return the manifest (also stored there).

    ``docs`` is a table of files (a scan, filters and projections of it); anything else
    should be stored first. A null or empty text is one sequence with the end mark alone;
    repeated rows are written as often as they occur; a null id is ``NO_ID``; an empty
    table gives a manifest with 0 sequences and no shard. Other columns are not read.
    """
    spark = docs.sparkSession
    ready_workers(spark)
    plain = clear_names(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    with _fixed_splits(spark):
        counted = plain.mapInArrow(_counted(ranks, length), "part bigint, sequences bigint, check bigint").collect()
        starts, n = {}, 0
        for row in sorted(counted, key=lambda r: r["part"]):
            starts[row["part"]] = (n, row["sequences"], row["check"])
            n += row["sequences"]
        manifest = {"sequences": n, "length": length, "stride": record_type(length).itemsize, "shard_slots": shard_slots, "key": key,
                    "end": END, "ranks": ranks.rsplit("/", 1)[-1]}
        if n:
            fixed = spark.sparkContext.broadcast((starts, n))
            records = plain.mapInArrow(_sequences(fixed, ranks, length, shard_slots, key), "shard bigint, slot bigint, record binary")
            # A shard is a range of slots and lies in one partition.
            ordered = records.repartition("shard").sortWithinPartitions("shard", "slot")
            ordered.select("shard", F.col("record").cast("string").alias("record")).write.option("compression", "none").partitionBy("shard").text(f"{path}/shards")
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()["value"])


def read(spark: SparkSession, path: str, start: int = 0, stop: int | None = None, with_ids: bool = True) -> DataFrame:
    """The sequences with slots from ``start`` up to ``stop``: slot, shard, place, doc_id, seq, n_tokens, ids_crc32 and ids.

    Only the shards of that range are opened. ``place`` is where the file held the record;
    it is the slot's remainder by the slots of a shard.
    """
    ready_workers(spark)
    manifest = read_manifest(spark, path)
    stop = manifest["sequences"] if stop is None else min(stop, manifest["sequences"])
    schema = "slot bigint, shard bigint, place bigint, doc_id bigint, seq bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    if start >= stop:
        return spark.createDataFrame([], schema)
    kind = record_type(manifest["length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, shard in zip(batch["content"], batch["shard"].to_pylist(), strict=True):
                rows = np.frombuffer(content.as_buffer(), kind)
                place = np.arange(len(rows))
                inside = (rows["slot"] >= start) & (rows["slot"] < stop)
                rows, place = rows[inside], place[inside]
                for lo in range(0, len(rows), 4096):
                    part = rows[lo : lo + 4096]
                    ids, wide = memoryview(np.ascontiguousarray(part["ids"]).tobytes()), 2 * manifest["length"]
                    crc = [zlib.crc32(ids[i * wide : i * wide + 2 * n]) for i, n in enumerate(part["n"].tolist())]
                    columns = [
                        pa.array(part["slot"].copy(), pa.int64()), pa.array([shard] * len(part), pa.int64()), pa.array(place[lo : lo + 4096], pa.int64()),
                        pa.array(part["doc_id"].copy(), pa.int64(), mask=part["doc_id"] == NO_ID), pa.array(part["seq"].astype(np.int64), pa.int64()),
                        pa.array(part["n"].astype(np.int64), pa.int64()), pa.array(crc, pa.int64())]
                    if with_ids:
                        columns.append(pa.array([r["ids"][: r["n"]].astype(np.int32) for r in part], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    size = manifest["shard_slots"]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards")
    wanted = files.where((F.col("shard") >= start // size) & (F.col("shard") <= (stop - 1) // size))
    return wanted.select("content", F.col("shard").cast("bigint").alias("shard")).mapInArrow(run, schema)


def materialise(docs: DataFrame, **settings) -> DataFrame:
    """Write ``docs`` to new shards in the shared folder and return what they hold, without the ids."""
    path = new_path(docs.sparkSession, "shards")
    write(docs, path, **settings)
    return read(docs.sparkSession, path, with_ids=False)

