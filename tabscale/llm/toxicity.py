"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text are the densities of seed insults (plain, spelled around with other
signs, and by stem), of words and word beginnings that the labelled sample ties to toxic
rows, how near second-person words stand to them, capitals, punctuation and obfuscated
words. Trees of a fixed depth are boosted in numpy on the logistic loss; scores are
calibrated on rows held back from the trees. The sample of labelled rows is bounded;
scoring reads whole texts where they lie, without a shuffle.
"""

from __future__ import annotations

import dataclasses
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_names, ready_workers, uniform
from .langid import held_out

#: Labelled rows that the model is fitted on at most in expectation, half of each label where there are enough.
SAMPLE_ROWS = 6000
#: Lengths of the word beginnings that the lexicon may learn.
STEMS = (4, 5, 6, 7)
#: Seed insults, one list for all languages.
SEEDS = frozenset("""
idiot idiots moron morons stupid dumb dumbass clown clowns loser losers scum trash garbage worthless pathetic disgusting
imbecile cretin jerk bastard vermin filth scumbag retard freak creep crap shit bullshit fuck fucking bitch asshole hate kill
idiota imbécil estúpido basura asqueroso payaso perdedor inútil cabrón mierda puta
imbécile stupide connard salaud ordure minable débile crétin merde pute
dummkopf trottel abschaum müll ekelhaft wertlos arschloch scheiße hurensohn versager
""".split())
SECOND = frozenset("you your yours yourself u ur tu te ti tus toi ton ta tes vous votre vos du dich dir dein deine euch ihr usted ustedes".split())
_LEET = str.maketrans("013457@$!|", "oieastasii")
_WORD = re.compile(r"[^\W_]+")
_INNER = re.compile(r"[^\W_][*@$!|.\-_+0-9]+[^\W_]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_SPLIT = re.compile(r"(?<![^\W_])(?:[^\W_][\s.\-_*]){2,}[^\W_](?![^\W_])")
_SIGNS = re.compile(r"[*@$!|.\-_+]")
FEATURES = ("seeds", "seed_any", "learned", "learned_any", "learned_weight", "stems", "stem_weight", "obfuscated", "obfuscated_any",
            "near_you", "you", "capitals", "shouted", "exclaims", "questions", "signs", "mean_word", "repeats", "log_words")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(text: str | None, lexicon: dict[str, float], stems: dict[str, float]) -> list[float]:
    """The dense features of a whole text, in the order of ``FEATURES``; zeros for one without words."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(words)
    seeds = sum(c for w, c in counts.items() if w in SEEDS)
    learned = sum(c for w, c in counts.items() if w in lexicon)
    weight = sum(c * lexicon.get(w, 0.0) for w, c in counts.items())
    stemmed, sharpest = 0, 0.0
    for w, c in counts.items() if stems else ():
        telling = max(stems.get(w[:4], 0.0), stems.get(w[:5], 0.0), stems.get(w[:6], 0.0), stems.get(w[:7], 0.0))
        if telling:
            stemmed += c
            sharpest = max(sharpest, telling)
    masked = 0
    low = text.lower()
    if _INNER.search(low):
        for token in low.split():
            if _INNER.search(token):
                token = token.strip(".,;:!?\"'()")
                plain = {_SIGNS.sub("", token), _SIGNS.sub("", token.translate(_LEET))} - {token}
                masked += any(w in SEEDS or w in lexicon for w in plain)
    for token in _SPLIT.findall(low):
        joined = "".join(_WORD.findall(token))
        masked += joined in SEEDS or joined in lexicon
    you = sum(c for w, c in counts.items() if w in SECOND)
    near = 0
    if you and (seeds or learned):
        bad = [i for i, w in enumerate(words) if w in SEEDS or w in lexicon]
        spot = np.array([i for i, w in enumerate(words) if w in SECOND])
        at = np.searchsorted(spot, bad)
        left = np.abs(np.array(bad) - spot[np.maximum(at - 1, 0)])
        right = np.abs(spot[np.minimum(at, len(spot) - 1)] - np.array(bad))
        near = int((np.minimum(left, right) <= 5).sum())
    letters = sum(map(len, counts)) or 1
    size = len(text)
    upper = size - len(_UPPER.sub("", text))
    return [
        seeds / n, float(seeds > 0), learned / n, float(learned > 0), weight / n, stemmed / n, sharpest, masked / n, float(masked > 0),
        near / n, you / n, upper / size, upper / size if upper > 0.5 * size else 0.0, text.count("!") / size, text.count("?") / size,
        sum(text.count(c) for c in "*@$#%&") / size, letters / len(counts), 1 - len(counts) / n, float(np.log1p(n))]


def learn_lexicon(rows: list[tuple[frozenset[str], int]], least: int = 5, ratio: float = 8.0) -> tuple[dict[str, float], dict[str, float]]:
    """Words and word beginnings, with their log odds, that stand in toxic rows far more often than in others."""
    toxic = sum(y for _, y in rows)
    clean = len(rows) - toxic
    if not toxic or not clean:
        return {}, {}

    def chosen(keys_of) -> dict[str, float]:
        bad, good = Counter(), Counter()
        for words, y in rows:
            (bad if y else good).update(keys_of(words))
        out = {}
        for key, c in bad.items():
            odds = (c + 0.5) / (toxic + 1) / ((good[key] + 0.5) / (clean + 1))
            if c >= least and odds >= ratio:
                out[key] = float(np.log(odds))
        return out

    stems = chosen(lambda words: {w[:k] for w in words for k in STEMS if len(w) > k})
    return chosen(lambda words: words), {s: w for s, w in stems.items() if w >= 1.5 * np.log(ratio)}


@dataclasses.dataclass
class Trees:
    """Complete trees: per tree and inner node a feature and a cut, per leaf a value."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1]))
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (leaf.size - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Gradient boosting with second-order leaves on binned features."""
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    cuts = [np.unique(np.quantile(c[c > c.min()] if (c > c.min()).any() else c, np.linspace(0, 1, bins))) for c in x.T]
    cuts = [np.unique(np.concatenate([[c.min()], k])) for c, k in zip(x.T, cuts, strict=True)]
    code = np.stack([np.searchsorted(k, c, side="left") for k, c in zip(cuts, x.T, strict=True)], 1)  # x <= k[j] iff code <= j
    inner, leaves = 2**depth - 1, 2**depth
    feature, cut, leaf = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    raw = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), int)
        for level in range(depth):
            first = 2**level - 1
            for k in range(first, 2 * first + 1):
                mine = np.flatnonzero(node == k)
                best = (1e-6, 0, np.inf)
                if len(mine) > 10:
                    gs, hs = g[mine].sum(), h[mine].sum()
                    for f, edges in enumerate(cuts):
                        gl = np.cumsum(np.bincount(code[mine, f], g[mine], len(edges) + 1))[: len(edges)]
                        hl = np.cumsum(np.bincount(code[mine, f], h[mine], len(edges) + 1))[: len(edges)]
                        gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                        j = int(gain.argmax())
                        if gain[j] > best[0] + 1e-9:
                            best = (float(gain[j]), f, float(edges[j]))
                feature[t, k], cut[t, k] = best[1], best[2]
                node[mine] = 2 * k + 1 + (x[mine, best[1]] > best[2])
        node -= inner
        leaf[t] = -rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + ridge)
        raw += leaf[t][node]
    return Trees(base, feature, cut, leaf)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and their non-decreasing shares of label 1."""
    knots, where = np.unique(raw, return_inverse=True)
    weight = np.bincount(where).astype(float)
    level = np.bincount(where, y) / weight
    blocks: list[list[float]] = []  # level, weight, knots
    for v, w in zip(level, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]]
    return knots, np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


@dataclasses.dataclass
class Model:
    lexicon: dict[str, float]
    stems: dict[str, float]
    trees: Trees
    knots: np.ndarray
    levels: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.raw(x), self.knots, self.levels) if len(x) else np.zeros(0)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [sorted(set(words_of(t.as_py() or ""))) for t in batch["text"]]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["toxic"], pa.array(words, pa.list_(pa.string()))], names=["doc_id", "toxic", "words"])


def _measured(lexicon, stems):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py(), lexicon, stems) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labelled rows that are not held out.

    ``sample_rows`` bounds the expected number of rows; a digest of the id picks them. Half
    of them teach the lexicon and the other half the trees, so that a learned word is as
    telling to the trees as it will be on new texts; a sixth of those calibrates.
    """
    ready_workers(docs.sparkSession)
    marks = clear_names(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
    marks = marks.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    share = {k: min(1.0, sample_rows / 2 / n) for k, n in sizes.items()}
    spare = sum(max(0, sample_rows / 2 - n) for n in sizes.values())  # what one label lacks, the other may have
    share = {k: min(1.0, s + spare / sizes[k]) for k, s in share.items()}
    wanted = F.create_map(*[F.lit(x) for kv in (share or {0: 0.0}).items() for x in kv])
    marks = marks.where(uniform("toxicity", "doc_id") < wanted[F.col("toxic")])
    texts = clear_names(docs, "doc_id", "text").join(F.broadcast(marks), "doc_id").select("doc_id", "toxic", "text")
    half = uniform("toxicity-half", "doc_id") < 0.5
    teach = texts.where(half).mapInArrow(_sampled, "doc_id bigint, toxic int, words array<string>").toArrow().to_pylist()
    lexicon, stems = learn_lexicon([(frozenset(r["words"]), r["toxic"]) for r in teach])
    rows = texts.where(~half).mapInArrow(_measured(lexicon, stems), "doc_id bigint, toxic int, x array<double>").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    y = np.array([r["toxic"] for r in rows], float)
    check = np.array([r["doc_id"] % 6 == 0 for r in rows], bool)
    return assemble(x, y, check, lexicon, stems)


def assemble(x, y, check, lexicon=None, stems=None) -> Model:
    if not len(y) or y.min() == y.max():
        level = float(y.mean()) if len(y) else 0.0
        return Model(lexicon or {}, stems or {}, Trees(0.0, np.zeros((0, 7), int), np.zeros((0, 7)), np.zeros((0, 8))), np.zeros(1), np.full(1, level))
    learn = ~check if 0 < (~check).sum() and y[~check].min() < y[~check].max() else np.ones(len(y), bool)
    trees = boost(x[learn], y[learn])
    use = check if check.any() and y[check].min() < y[check].max() else learn
    knots, levels = isotonic(trees.raw(x[use]), y[use])
    return Model(lexicon or {}, stems or {}, trees, knots, levels)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` for every row: the calibrated chance of label 1, and 1 from 0.5 on.

    Null and empty texts have all features 0 and get the score that follows from them.
    Null ids and repeated rows need nothing special; an empty table gives no rows. Other
    columns are not read.
    """
    ready_workers(docs.sparkSession)
    fixed = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = fixed.value
        for batch in batches:
            x = np.array([features(t.as_py(), m.lexicon, m.stems) for t in batch["text"]], float).reshape(batch.num_rows, len(FEATURES))
            score = np.clip(m.score(x), 0, 1)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())],
                names=["doc_id", "score", "predicted"])

    plain = clear_names(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    return plain.mapInArrow(run, "doc_id bigint, score double, predicted int")
