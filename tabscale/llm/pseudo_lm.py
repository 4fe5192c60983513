"""Language-model scoring by masked pseudo-likelihood.

Every word of a text is predicted from the two words on each side by a small network:
position tables of the context words, one hidden layer, and a softmax in two steps (the
class of a word, then the word in its class). A text's score is the sum of the
conditional log-probabilities of all its words.

The vocabulary comes from the counts of all words in the corpus and grows with them;
rarer words share hashed buckets. Such a word's probability is that of its bucket times
its share of the bucket's count, joined from the table of counts. The network is trained in numpy where the texts lie: each task makes
stochastic gradient steps on its texts, from common parameters, and the parameters are averaged by a tree of small groups. So what
is gathered grows with the corpus, and no group or task holds more than a few models.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_names, discard, hash_words, ready_workers, stored, utf8

#: Buckets for words outside the vocabulary, words of a class, ids at least.
OTHERS, CLASS, IDS = 96, 256, 4096
#: Up to so many distinct words all are in the vocabulary; beyond, it grows with a power of their number.
WHOLE, GROWTH = 32_000, 1 / 8
#: Occurrences that unseen words of a bucket count for.
UNSEEN = 0.5
PAD = -1  # the last row of the tables
HIDDEN = 24
OFFSETS = (-2, -1, 1, 2)
#: Passes over the texts, each from averaged parameters. Together they train on every position once.
ROUNDS = 2
#: Words of a step, and its rate.
BATCH, RATE = 8192, 0.6
#: Numbers in a row while models are averaged, and models that one group adds up.
BLOCK, FAN_IN = 16_384, 64


class Vocabulary(NamedTuple):
    """Sorted hashes of the known words and their ids, the id of the first bucket, the
    counts of the buckets, and the stored counts of all words."""

    hashes: np.ndarray
    ids: np.ndarray
    first: int
    buckets: np.ndarray
    counts: DataFrame | None


def _shapes(n_ids: int) -> dict[str, tuple[int, ...]]:
    classes = n_ids // CLASS
    return {"tables": (len(OFFSETS), n_ids + 1, HIDDEN), "hidden": (HIDDEN,), "to_class": (HIDDEN, classes), "class_bias": (classes,),
            "to_word": (classes, HIDDEN, CLASS), "word_bias": (classes, CLASS)}


def _size(n_ids: int) -> int:
    return sum(int(np.prod(s)) for s in _shapes(n_ids).values())


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of a parameter vector."""
    out, at = {}, 0
    fixed = _size(0)
    for name, shape in _shapes((len(flat) - fixed) // (_size(CLASS) - fixed) * CLASS).items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def first_parameters(counts: np.ndarray, seed: int = 11) -> np.ndarray:
    """Small random weights, and biases that say how often each word is."""
    flat = np.random.default_rng(seed).normal(0, 0.1, _size(len(counts))).astype(np.float32)
    p = unpack(flat)
    p["hidden"][:] = 0
    share = (np.maximum(counts, 0) + 1.0).reshape(-1, CLASS)
    p["class_bias"][:] = np.log(share.sum(1) / share.sum())
    p["word_bias"][:] = np.log(share / share.sum(1, keepdims=True))
    return flat


def by_value(x: np.ndarray, top: int) -> np.ndarray:
    """A stable order that puts equal whole numbers up to ``top`` (or PAD) side by side, by radix passes over 16 bits."""
    order = np.argsort(x.astype(np.uint16), kind="stable")
    return order if top < 65_535 else order[np.argsort((x[order] >> 16).astype(np.uint16), kind="stable")]


def _softmax(x: np.ndarray) -> np.ndarray:
    """The softmax of each row, in place."""
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def _log_chosen(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The log of each row's softmax at one column; ``x`` is used up."""
    x -= x.max(axis=1, keepdims=True)
    got = x[np.arange(len(x)), chosen]
    np.exp(x, out=x)
    return got - np.log(x.sum(axis=1))


def _hidden(p: dict[str, np.ndarray], context: np.ndarray) -> np.ndarray:
    h = p["tables"][0][context[0]]
    for k in range(1, len(OFFSETS)):
        h += p["tables"][k][context[k]]
    h += p["hidden"]
    return np.tanh(h, out=h)


def _classes(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """An order of the ids by class, the classes in that order, and (class, from, to) of each that occurs."""
    group = ids // CLASS
    order = by_value(group, n)
    group = group[order]
    cuts = np.searchsorted(group, np.arange(n + 1)).tolist()
    return order, group, [(c, lo, hi) for c, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]


def log_probs(p: dict[str, np.ndarray], context: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Log-probability of each id given its context (one row per offset)."""
    order, group, runs = _classes(ids, len(p["class_bias"]))
    h, word = _hidden(p, context[:, order]), ids[order] % CLASS
    got = _log_chosen(h @ p["to_class"] + p["class_bias"], group).astype(np.float64)
    for c, lo, hi in runs:
        got[lo:hi] += _log_chosen(h[lo:hi] @ p["to_word"][c] + p["word_bias"][c], word[lo:hi])
    out = np.empty(len(ids))
    out[order] = got
    return out


def train_batch(p: dict[str, np.ndarray], squares: dict[str, np.ndarray], context: np.ndarray, ids: np.ndarray, rate: float = RATE) -> None:
    """One step of stochastic gradient descent with per-parameter rates."""
    order, group, runs = _classes(ids, len(p["class_bias"]))
    context, word, n = context[:, order], ids[order] % CLASS, len(ids)
    at = np.arange(n)
    h = _hidden(p, context)

    def step(name: str, where, g: np.ndarray) -> None:
        held = squares[name][where] + g * g
        squares[name][where] = held
        held += 1e-6
        g *= rate
        g /= np.sqrt(held, out=held)
        p[name][where] -= g

    grad = _softmax(h @ p["to_class"] + p["class_bias"])
    grad[at, group] -= 1
    back = grad @ p["to_class"].T
    step("to_class", ..., h.T @ grad / n)
    step("class_bias", ..., grad.mean(0))
    for c, lo, hi in runs:
        part = _softmax(h[lo:hi] @ p["to_word"][c] + p["word_bias"][c])
        part[at[: hi - lo], word[lo:hi]] -= 1
        back[lo:hi] += part @ p["to_word"][c].T
        step("to_word", c, h[lo:hi].T @ part / n)
        step("word_bias", c, part.sum(0) / n)
    back *= 1 - h * h
    back /= n
    step("hidden", ..., back.sum(0))
    for k in range(len(OFFSETS)):
        by = by_value(context[k], p["tables"].shape[1])
        rows = context[k][by]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        step("tables", (k, rows[first]), np.add.reduceat(back[by], first, axis=0))


def bucket(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(17)) % np.uint64(OTHERS)


def numbered(words: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Ids of word hashes: known ones by rank, the others by bucket."""
    known, ids, first = vocabulary[:3]
    out = (first + bucket(words)).astype(np.int32)
    if len(known):
        at = np.minimum(np.searchsorted(known, words), len(known) - 1)
        hit = known[at] == words
        out[hit] = ids[at[hit]]
    return out


def contexts(ids: np.ndarray, begin: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The ids around the wanted places; beyond a text's ends there is PAD."""
    edge = max(map(abs, OFFSETS))
    row = np.searchsorted(begin, np.arange(len(ids)), side="right")  # 1 for the first text
    padded = np.full(len(ids) + edge * (len(begin) + 1), PAD, np.int32)
    place = np.arange(len(ids)) + edge * row
    padded[place] = ids
    return np.stack([padded[place[wanted] + o] for o in OFFSETS])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    types = [pa.int64(), pa.int64()]

    def summed() -> tuple[np.ndarray, np.ndarray]:
        words = np.concatenate([w for w, _ in held])
        found, where = np.unique(words, return_inverse=True)
        return found, np.bincount(where, np.concatenate([c for _, c in held])).astype(np.int64)

    with np.errstate(over="ignore"):
        for batch in batches:
            words, _ = hash_words(*utf8(batch["text"]))
            held.append(tuple(np.unique(words, return_counts=True)))
            size += len(held[-1][0])
            if size > 2_000_000:  # what a task holds is bounded
                held = [summed()]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64), t) for x, t in zip(held[0], types, strict=True)], names=["word", "n"])
                    held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64), t) for x, t in zip(summed(), types, strict=True)], names=["word", "n"])


def known_words(distinct: int) -> int:
    """Places for known words. With the buckets they fill whole classes."""
    wanted = distinct if distinct <= WHOLE else int(WHOLE * (distinct / WHOLE) ** GROWTH)
    return max(IDS, -(-(wanted + OTHERS) // CLASS) * CLASS) - OTHERS


def vocabulary(docs: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """The most frequent words of the whole corpus with ids by rank, and the counts of all ids."""
    ready_workers(docs.sparkSession)
    counts = stored(clear_names(docs, "text").mapInArrow(_counted, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    first = known_words(counts.count())
    top = counts.orderBy(F.desc("n"), "word").limit(first).collect()
    hashes = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    n = np.array([r["n"] for r in top], np.float64)
    order = np.argsort(hashes)
    held = np.zeros(first + OTHERS)
    held[: len(top)] = n
    for r in counts.groupBy((F.shiftrightunsigned("word", 17) % OTHERS).alias("bucket")).agg(F.sum("n").alias("n")).collect():
        held[first + r["bucket"]] = r["n"]
    np.subtract.at(held, first + bucket(hashes).astype(np.int64), n)
    return Vocabulary(hashes[order], order.astype(np.int32), first, held[first:].copy(), counts), held


def targets(begin: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """Places of the words that a pass trains on: of each text those whose position leaves ``turn``."""
    n = int(begin[-1])
    start = np.repeat(begin[:-1], np.diff(begin))
    return np.flatnonzero((np.arange(n) - start) % rounds == turn)


def _trained(fixed, turn: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, start = fixed.value
        flat = start.copy()
        p, squares = unpack(flat), unpack(np.full(len(flat), 1e-4, np.float32))
        seen, waiting, n_waiting = 0, [], 0
        for batch in batches:
            with np.errstate(over="ignore"):
                hashes, begin = hash_words(*utf8(batch["text"]))
            if not len(hashes):
                continue
            ids = numbered(hashes, words)
            wanted = targets(begin, turn, rounds)
            waiting.append((contexts(ids, begin[:-1], wanted), ids[wanted]))
            n_waiting += len(wanted)
            while n_waiting >= BATCH:
                c, y = np.concatenate([w[0] for w in waiting], axis=1), np.concatenate([w[1] for w in waiting])
                whole = n_waiting // BATCH * BATCH
                for lo in range(0, whole, BATCH):
                    train_batch(p, squares, c[:, lo : lo + BATCH], y[lo : lo + BATCH])
                seen += whole
                waiting, n_waiting = [(c[:, whole:], y[whole:])], n_waiting - whole
        if n_waiting:
            train_batch(p, squares, np.concatenate([w[0] for w in waiting], axis=1), np.concatenate([w[1] for w in waiting]))
            seen += n_waiting
        if seen:
            part = TaskContext.get().partitionId()
            starts = range(0, len(flat), BLOCK)
            flat -= start  # what a task never touched is zero, so small when stored
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(starts), pa.int64()), pa.array(range(len(starts)), pa.int64()), pa.array([float(seen)] * len(starts), pa.float64()),
                 pa.array([flat[lo : lo + BLOCK].tobytes() for lo in starts], pa.binary())], names=["part", "block", "seen", "numbers"])

    return run


def _averaged(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    seen = np.array(rows["seen"].to_pylist())
    order = np.argsort(rows["part"].to_numpy(), kind="stable")
    total = None
    for i in order.tolist():
        part = np.frombuffer(rows["numbers"][i].as_py(), np.float32).astype(np.float64) * (seen[i] / seen.sum())
        total = part if total is None else total + part
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "block": pa.array([key[1].as_py()], pa.int64()),
                     "seen": pa.array([float(seen.sum())], pa.float64()), "numbers": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def fit(docs: DataFrame, rounds: int = ROUNDS) -> tuple[Vocabulary, np.ndarray]:
    """Vocabulary and parameters, from all texts."""
    spark = docs.sparkSession
    ready_workers(spark)
    words, counts = vocabulary(docs)
    flat = first_parameters(counts)
    texts = clear_names(docs, "text")
    schema = "part bigint, block bigint, seen double, numbers binary"
    for turn in range(rounds):
        fixed = spark.sparkContext.broadcast((words._replace(counts=None), flat))
        models = stored(texts.mapInArrow(_trained(fixed, turn, rounds), schema), "models")
        most = models.agg(F.max("part")).first()[0]
        if most is None:
            break
        while most > 0:
            most //= FAN_IN
            parts = models
            models = stored(parts.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part", "block").applyInArrow(_averaged, schema), "models")
            discard(parts)
        rows = sorted(models.collect(), key=lambda r: r["block"])
        flat = flat + np.concatenate([np.frombuffer(r["numbers"], np.float32) for r in rows])
        discard(models)
    return words, flat


def score(docs: DataFrame, model: tuple[Vocabulary, np.ndarray]) -> DataFrame:
    """``doc_id, n_tokens, log_prob, mean_log_prob, perplexity`` for every row.

    All words of a whole text count. A text without words (null and empty ones too) has
    0 words, log_prob 0 and null mean and perplexity. Null ids and repeated rows need
    nothing special; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    ready_workers(spark)
    words, flat = model
    fixed = spark.sparkContext.broadcast((words._replace(counts=None), flat))

    def run(batches: Iterator[pa.RecordBatch], piece: int = 1 << 14) -> Iterator[pa.RecordBatch]:
        words, flat = fixed.value
        p = unpack(flat)
        shared = np.log(words.buckets + UNSEEN)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            with np.errstate(over="ignore"):
                hashes, begin = hash_words(*utf8(batch["text"]))
            ids = numbered(hashes, words)
            edge = max(OFFSETS)
            got = np.zeros(len(ids) + 1)
            for lo in range(0, len(ids), piece):
                hi = min(len(ids), lo + piece)
                # The words around the piece belong to its contexts.
                a, b = max(0, lo - edge), min(len(ids), hi + edge)
                inside = begin[:-1][(begin[:-1] > a) & (begin[:-1] < b)] - a
                starts = np.concatenate([[0], inside])
                got[lo + 1 : hi + 1] = log_probs(p, contexts(ids[a:b], starts, np.arange(lo - a, hi - a)), ids[lo:hi])
            rare = np.flatnonzero(ids >= words.first)
            got[rare + 1] -= shared[ids[rare] - words.first]
            total = np.cumsum(got)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, begin), pa.int32()), pa.array(hashes[rare].view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(batch)), pa.int64()), batch["doc_id"], pa.array(np.diff(begin), pa.int64()),
                 pa.array(total[begin[1:]] - total[begin[:-1]], pa.float64()), lists], names=["row", "doc_id", "n_tokens", "part", "rare"])
            row += len(batch)

    plain = clear_names(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    rows = stored(plain.mapInArrow(run, "row bigint, doc_id bigint, n_tokens bigint, part double, rare array<bigint>"), "scores")
    # The counts of words in buckets: their shares, but for the bucket's own count.
    rare = rows.select("row", F.explode("rare").alias("word")).join(words.counts, "word", "left")
    more = rare.groupBy("row").agg(F.sum(F.log(F.coalesce(F.col("n").cast("double"), F.lit(UNSEEN)))).alias("more"))
    whole = rows.drop("rare").join(more, "row", "left").withColumn("log_prob", F.col("part") + F.coalesce("more", F.lit(0.0)))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return whole.select("doc_id", "n_tokens", "log_prob", mean.alias("mean_log_prob"), F.exp(-mean).alias("perplexity"))
