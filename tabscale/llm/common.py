"""What the corpus operators share: tables in the shared folder, texts as arrays, joins on uneven keys."""

from __future__ import annotations

import functools
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Rows a Python worker gets at once: a bound on its memory even where texts are long.
BATCH_ROWS = 1000
#: Keys that may be broadcast to filter texts.
SMALL_KEYS = 2_000_000
#: Bytes of text that are turned into arrays at once.
WINDOW = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ready_workers(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, and at most ``BATCH_ROWS`` rows at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId not in _SENT:
        folder = tempfile.TemporaryDirectory()  # Spark sends the file from the driver
        package = Path(__file__).resolve().parents[1]
        with zipfile.ZipFile(f"{folder.name}/{package.name}.zip", "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(out.filename)
        _SENT[context.applicationId] = folder


_SENT: dict[str, tempfile.TemporaryDirectory] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it goes when the session's file system closes."""
    path = f"{shared_folder(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: cuts the
    lineage, and a lost executor costs nothing that was done before."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._llm_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_names(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns; a missing one is null. Extra columns cannot clash with helpers."""
    return df.select(*[F.col(f"`{n}`") if n in df.columns else F.lit(None).alias(n) for n in names])


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row starts (one more than rows). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(data: np.ndarray, at: np.ndarray, size: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Cut the bytes at separators or row starts into pieces of about ``size``."""
    lo, end = 0, len(data)
    while lo < end:
        hi = min(end, lo + size)
        while hi < end:  # cut before a separator or a row
            row = at[np.searchsorted(at, hi)]
            near = np.flatnonzero(_SPACE[data[hi : min(row, hi + 4096)]])
            if len(near):
                hi += int(near[0])
                break
            if row <= hi + 4096:
                hi = int(row)
                break
            hi += 4096
        yield lo, hi
        lo = hi


def hash_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without white space, A-Z lower-cased), in order, and
    where each row's words start (one more than rows)."""
    hashes, begins = [], []
    for lo, hi in windows(data, at):
        part = data[lo:hi]
        word = ~_SPACE[part]
        edge = np.zeros(hi - lo + 1, bool)
        edge[at[(at >= lo) & (at <= hi)] - lo] = True
        edge[0] = edge[-1] = True
        before = np.empty_like(word)
        before[0], before[1:] = False, word[:-1]
        start = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.empty_like(word)
        after[-1], after[:-1] = False, word[1:]
        stop = np.flatnonzero(word & (~after | edge[1:])) + 1
        room = 1 << max(16, (hi - lo - 1).bit_length())
        up, down = _powers(room)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[part]] * up[: hi - lo], out=total[1:])
        hashes.append(mix((total[stop] - total[start]) * down[start]))
        begins.append(start + lo)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    begin = np.concatenate(begins)
    return np.concatenate(hashes), np.searchsorted(begin, at)


def join_uneven(
    big: DataFrame, keyed: DataFrame, on: Sequence[str], count: str, how: str = "inner", keep_count: bool = False,
) -> DataFrame:
    """Join ``big`` with one row per key where a few keys may hold most rows.

    ``count`` is the number of rows of ``big`` that have the key. Keys with over a
    thousandth of all rows (so at most a thousand of them) are broadcast; the
    others are shuffled.
    """
    total = keyed.agg(F.sum(count)).first()[0] or 0
    wanted = keyed.columns if keep_count else [c for c in keyed.columns if c != count]
    hot = F.broadcast(keyed.where(F.col(count) * 1000 > total).select(*wanted, F.lit(True).alias("_hot")))
    cold = keyed.where(F.col(count) * 1000 <= total).select(*wanted)
    marked = big.join(hot, list(on), "left")
    extra = [c for c in wanted if c not in on]
    first = marked.where(F.col("_hot")).drop("_hot")
    second = marked.where(F.col("_hot").isNull()).drop("_hot", *extra).join(cold, list(on), how)
    return first.unionByName(second.select(*first.columns))


def narrow_join(big: DataFrame, keys: DataFrame, on: str, how: str, most: int = SMALL_KEYS) -> DataFrame:
    """Semi or anti join of wide rows with one column of distinct long keys.

    Up to ``most`` keys (counted first; about 32 bytes each) are broadcast, so that texts
    stay where they are. Beyond, both sides are shuffled.
    """
    return big.join(F.broadcast(keys) if keys.count() <= most else keys, on, how)


def uniform(seed: str, *keys: str):
    """Uniform [0, 1) from a digest of the keys, the same in any SQL engine."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
