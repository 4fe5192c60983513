"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its subwords (hashed byte n-grams within
words, spaces included); a linear layer and a softmax give the language. The model is
trained by stochastic gradient descent in numpy on a bounded, stratified sample of
labelled rows, and its confidence is calibrated by a temperature on rows held back.
Prediction reads whole texts where they lie: nothing is shuffled.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, clear_names, ready_workers, uniform, utf8

UNKNOWN = "und"
#: Rows that the model is fitted on at most in expectation, spread evenly over languages.
SAMPLE_ROWS = 2400
#: Size of the table of subwords, and of an embedding.
BUCKETS, WIDTH = 1 << 14, 16
ORDERS = (1, 2, 3, 4)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


@dataclasses.dataclass
class Model:
    """``table`` holds each subword's embedding already multiplied by the linear layer."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float  # confidence below which a text is rejected


def subwords(data: np.ndarray) -> np.ndarray:
    """Bucket of every byte n-gram of a text, A-Z lower-cased."""
    low = _LOWER[data].astype(np.uint32)
    out, rolled = [], np.zeros(len(low), np.uint32)
    for n in ORDERS:
        if len(low) < n:
            break
        rolled = rolled[: len(low) - n + 1] * np.uint32(0x01000193) + low[n - 1 :] + np.uint32(n)
        mixed = rolled * np.uint32(0x9E3779B1)
        out.append((mixed ^ (mixed >> np.uint32(15))) >> np.uint32(3) & np.uint32(BUCKETS - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def shares(data: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """Share of each bucket among the text's subwords; long texts go piece by piece."""
    counts = np.zeros(BUCKETS)
    for lo in range(0, len(data), piece):
        counts += np.bincount(subwords(data[lo : lo + piece]), minlength=BUCKETS)
    return counts / max(1.0, counts.sum())


def has_letter(data: np.ndarray) -> bool:
    """Whether the text has a letter of any script."""
    if _LETTER[data].any():
        return True
    return bool((data >= 128).any()) and any(c.isalpha() for c in data.tobytes().decode("utf-8", "replace"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch["text"])
        ids, values, langs, docs, holds = [], [], [], [], []
        for i in range(batch.num_rows):
            text = data[at[i] : at[i + 1]]
            if has_letter(text):
                share = shares(text)
                found = np.flatnonzero(share)
                ids.append(found.astype(np.int16))
                values.append(share[found].astype(np.float32))
                langs.append(batch["lang"][i].as_py())
                docs.append(batch["doc_id"][i].as_py())
                holds.append(batch["calibrates"][i].as_py())
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(docs, pa.int64()), pa.array(holds, pa.bool_()), pa.array(ids, pa.list_(pa.int16())), pa.array(values, pa.list_(pa.float32()))],
            names=["lang", "doc_id", "calibrates", "ids", "values"])


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, epochs: int = 12, seed: int = 7) -> Model:
    """Fit on labelled rows that are not held out.

    ``sample_rows`` bounds the expected number of rows, equally many from each
    language; a digest of the id picks them, so the model is the same at any layout.
    """
    ready_workers(docs.sparkSession)
    labelled = clear_names(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return Model([UNKNOWN], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 1.0, 0.0)
    langs = sorted(sizes)
    wanted = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample_rows / len(langs) / sizes[k])))])
    picked = labelled.where(uniform("langid", "doc_id") < wanted[F.col("lang")])
    rows = picked.select("lang", F.col("doc_id").cast("bigint"), "text", (F.crc32(F.col("doc_id").cast("string")) % 5 == 1).alias("calibrates")).mapInArrow(
        _counted, "lang string, doc_id bigint, calibrates boolean, ids array<smallint>, values array<float>").toArrow()
    rows = rows.sort_by([("lang", "ascending"), ("doc_id", "ascending")]).combine_chunks()
    sparse = []
    for ids, values in zip(rows["ids"].chunks, rows["values"].chunks, strict=True):
        at = ids.offsets.to_numpy()
        ids, values, first = ids.values.to_numpy(), values.values.to_numpy(), values.offsets[0].as_py()
        sparse += [(ids[lo:hi], values[lo - at[0] + first : hi - at[0] + first]) for lo, hi in zip(at[:-1], at[1:], strict=True)]
    y = np.array([langs.index(x) for x in rows["lang"].to_pylist()], int)
    held = np.array(rows["calibrates"].to_pylist(), bool)
    return train(langs, sparse, y, held, epochs, seed)


def train(langs, sparse, y, held, epochs: int = 12, seed: int = 7, rate: float = 4.0) -> Model:
    """Stochastic gradient descent on cross entropy, then temperature and rejection level."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    layer = rng.normal(0, 0.1, (WIDTH, len(langs))).astype(np.float32)
    bias = np.zeros(len(langs), np.float32)
    learn = np.flatnonzero(~held) if (~held).any() else np.arange(len(y))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(learn):
            ids, share = sparse[i]
            mean = share @ embed[ids]
            logit = mean @ layer + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = layer @ p
            layer -= 0.25 * step * np.outer(mean, p)
            bias -= 0.02 * step * p
            embed[ids] -= (step * share)[:, None] * back[None, :]
    table = (embed @ layer).astype(np.float64)
    check = np.flatnonzero(held) if held.any() else learn
    logits = np.array([sparse[i][1] @ table[sparse[i][0]] + bias for i in check]).reshape(len(check), len(langs))
    best, level = 1.0, 0.0
    if len(check) and len(langs) > 1:
        loss = lambda t: float(np.mean(np.log(np.exp((logits - logits.max(1, keepdims=True)) / t).sum(1)) + (logits.max(1) - logits[np.arange(len(check)), y[check]]) / t))
        best = min(np.geomspace(0.25, 8, 41), key=loss)
        scaled = np.exp((logits - logits.max(1, keepdims=True)) / best)
        # A text is rejected if the model is less sure of it than of any row that calibrates it.
        level = float((scaled.max(1) / scaled.sum(1)).min()) * 0.9
    return Model(langs, table, bias.astype(np.float64), float(best), level)


def predict(docs: DataFrame, model: Model, keep: Sequence[str] | None = None) -> DataFrame:
    """Every row's columns ``keep`` (all by default) with ``lang_pred``, ``score``
    (calibrated confidence) and ``rejected``.

    A null text, or one without a letter, is ``und`` with score 0 and rejected. A text
    whose confidence lies below the model's level keeps its best language and is rejected.
    Rows with a null id, repeated rows and an empty table need nothing special.
    """
    ready_workers(docs.sparkSession)
    fixed = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = fixed.value
        for batch in batches:
            data, at = utf8(batch["text"])
            langs, scores, rejected = [], [], []
            for i in range(batch.num_rows):
                text = data[at[i] : at[i + 1]]
                if not has_letter(text):
                    langs.append(UNKNOWN), scores.append(0.0), rejected.append(True)
                    continue
                logit = (shares(text) @ m.table + m.bias) / m.temperature
                p = np.exp(logit - logit.max())
                best = int(logit.argmax())
                score = float(1 / p.sum())
                langs.append(m.langs[best]), scores.append(score), rejected.append(score < m.least)
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*kept, "lang_pred", "score", "rejected"])

    added = ("lang_pred", "score", "rejected")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    plain = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, "text"])])
    schema = ", ".join([*(f"`{c}` {plain.schema[c].dataType.simpleString()}" for c in kept), "lang_pred string, score double, rejected boolean"])
    return plain.mapInArrow(run, schema)
