"""Phrase collocations from an FM-index per shard over word ids.

A task numbers the words of up to ``SHARD_WORDS`` words of its texts, sorts the suffixes by
their first ``DEPTH`` words and keeps the Burrows-Wheeler transform. Starting from the
interval of each word, every interval is extended to the left by the distinct words of
its part of the transform, which yields the n-grams to that depth with their counts; the
runs of next words within an interval are its extensions to the right.

Most n-grams are rare and need not be spelled out. A first pass sums hashed counts across
the shards, five bytes an n-gram; what may be frequent sets a bit in a map of fixed size.
The second pass extends only intervals whose bit is set and emits their phrases, whose
counts Spark sums across the shards exactly. A bit that two n-grams share costs a few more rows,
nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import clear_names, mix, ready_workers, stored, utf8

#: Words of one index: three word numbers must fit 63 bits.
SHARD_WORDS = 500_000
DEPTH = 3
#: Fixed values of the contract.
LEAST, SHOWN, INSIDE_PERCENT, SCALE = 10, 2000, 50, 1_000_000
#: Bits of the map of n-grams that may be frequent; its size in bytes is an eighth of it.
MAP_BITS = 1 << 27
#: Distinct n-grams that a task gathers before it hands their counts on.
GATHERED = 4_000_000
#: Groups of hashes for each part of the input.
GROUPS_PER_PART = 8
#: An n-gram's hash within its group, and its count as far as it matters.
_HASHED = np.dtype([("hash", "<u4"), ("count", "u1")])
#: Candidates that one task ranks.
RANKED = 100_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_COUNTS = "lang string, phrase string, f bigint"


def words(column: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words in order (A-Z lower-cased), the row of each, and whether it starts a piece."""
    data, at = utf8(column)
    n = len(data)
    inside = ~_GAP[data]
    row_start = np.zeros(n + 1, bool)
    row_start[at] = True
    before = np.concatenate([[False], inside[:-1]])
    start = np.flatnonzero(inside & (~before | row_start[:-1]))
    row = np.searchsorted(at, start, side="right") - 1
    breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])[start]
    first = np.ones(len(start), bool)
    first[1:] = (breaks[1:] != breaks[:-1]) | (row[1:] != row[:-1])
    # The bytes of the words alone stand one after another.
    kept = np.concatenate([[0], np.cumsum(inside)])
    ends = np.append(kept[start], kept[-1]).astype(np.int64)
    buffers = [None, pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(np.ascontiguousarray(_LOWER[data[inside]]))]
    return pa.LargeStringArray.from_buffers(len(start), buffers[1], buffers[2]), row, first


class Index:
    """FM-index over word numbers 1.. with 0 between pieces, exact for patterns of up to ``DEPTH`` words."""

    def __init__(self, numbers: np.ndarray, first: np.ndarray):
        gaps = np.cumsum(first)
        text = np.zeros(len(numbers) + (gaps[-1] if len(gaps) else 0) + DEPTH, np.int64)
        text[np.arange(len(numbers)) + gaps] = numbers  # a piece stands after its mark
        self.size = len(text) - DEPTH + 1
        width = max(1, int(numbers.max()).bit_length()) if len(numbers) else 1
        key = np.zeros(self.size, np.int64)
        for i in range(DEPTH):
            key = (key << width) | text[i : i + self.size]
        order = np.argsort(key, kind="stable")
        self.key, self.width = key[order], width
        self.bwt = text[order - 1]  # the text starts and ends with marks, so it may be read as a circle
        # Where each suffix goes when its left neighbour is put before it.
        by_word = np.argsort(self.bwt, kind="stable")
        self.step = np.empty(self.size, np.int64)
        self.step[by_word] = np.arange(self.size)

    def level_one(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(patterns, low, high) of the single words."""
        head = self.key >> (self.width * (DEPTH - 1))
        low = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
        high = np.append(low[1:], self.size)
        real = head[low] > 0
        return head[low][real][:, None], low[real], high[real]

    def extend_left(self, patterns, low, high) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every pattern with each word that stands before it, and the intervals of these."""
        length = high - low
        which = np.repeat(np.arange(len(low)), length)
        place = np.arange(len(which)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(low, length)
        word = self.bwt[place]
        real = word > 0
        which, place, word = which[real], place[real], word[real]
        pair = (which << self.width) | word
        order = np.argsort(pair, kind="stable")
        pair, place = pair[order], place[order]
        begin = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        count = np.diff(np.append(begin, len(pair)))
        at = self.step[place[begin]]
        found = np.concatenate([(pair[begin] & ((1 << self.width) - 1))[:, None], patterns[pair[begin] >> self.width]], axis=1)
        return found, at, at + count

    def extend_right(self, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For intervals of patterns of ``length`` words: the interval's number and each next word's count, by runs."""
        shift = self.width * (DEPTH - 1 - length)
        which = np.repeat(np.arange(len(low)), high - low)
        place = np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
        word = (self.key[place] >> shift) & ((1 << self.width) - 1)
        new = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (word[1:] != word[:-1])])) if len(which) else np.zeros(0, np.int64)
        count = np.diff(np.append(new, len(which)))
        real = word[new] > 0
        return np.stack([which[new][real], word[new][real]], axis=1), count[real]

    def grams(self, depth: int = DEPTH, wanted=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(patterns, counts) for 1, 2, .. ``depth`` words; ``wanted`` says which patterns are kept and extended."""
        level = self.level_one()
        for size in range(1, depth + 1):
            if size > 1:
                level = self.extend_left(*level)
            if wanted is not None:
                keep = wanted(level[0])
                level = tuple(part[keep] for part in level)
            yield level[0], level[2] - level[1]


class Shard:
    """Some texts' words as numbers by language, with their spelling and hashes."""

    def __init__(self, held: list[tuple[pa.Array, np.ndarray, np.ndarray]], langs: list[str]):
        spelled = pa.chunked_array([w for w, _, _ in held], pa.large_string()).combine_chunks().dictionary_encode()
        self.lang = np.concatenate([c for _, c, _ in held])
        first = np.concatenate([f for _, _, f in held])
        # A word of another language is another symbol.
        wide = max(1, len(spelled.dictionary))
        symbols, numbers = np.unique(self.lang.astype(np.int64) * wide + spelled.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        self.of_lang, of_word = np.divmod(symbols, wide)
        self.words = spelled.dictionary.take(pa.array(of_word)).cast(pa.string())
        self.names = langs
        in_lang = np.array([xxhash.xxh64_intdigest(v.encode()) for v in langs], np.uint64)
        by_word = np.array([xxhash.xxh64_intdigest(w) for w in self.words.cast(pa.binary()).to_pylist()], np.uint64)
        self.hashes = mix(by_word ^ mix(in_lang)[self.of_lang])
        self.index = Index(numbers + 1, first)

    def hash(self, patterns: np.ndarray) -> np.ndarray:
        out = self.hashes[patterns[:, 0] - 1]
        with np.errstate(over="ignore"):
            for i in range(1, patterns.shape[1]):
                out = mix(out * np.uint64(0x9E3779B97F4A7C15) + self.hashes[patterns[:, i] - 1])
        return out

    def spell(self, patterns: np.ndarray) -> pa.Array:
        parts = [self.words.take(pa.array(patterns[:, i] - 1)) for i in range(patterns.shape[1])]
        return parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, " ")


def _shards(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[Shard]:
    held, size, codes = [], 0, {}
    for batch in batches:
        lang = [codes.setdefault("und" if v is None else v, len(codes)) for v in batch["lang"].to_pylist()]
        found, row, first = words(batch["text"])
        lang = np.array(lang, np.int64)[row] if len(row) else np.zeros(0, np.int64)
        for start, stop in _cuts(first, shard_words):
            if size and size + stop - start > shard_words:
                yield Shard(held, list(codes))
                held, size = [], 0
            held.append((found.slice(start, stop - start), lang[start:stop], first[start:stop]))
            size += stop - start
    if size:
        yield Shard(held, list(codes))


def _added(hashes: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and their summed counts up to ``most``."""
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    begin = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[begin], np.minimum(np.add.reduceat(counts, begin), most) if len(begin) else counts


def _hashed(shard_words: int, group_bits: int, least: int):
    """First pass: the counts of hashed n-grams, a run of them for each group of hashes."""

    def rows(held) -> pa.RecordBatch:
        hashes, counts = _added(np.concatenate([h for h, _ in held]), np.concatenate([c for _, c in held]), least)
        group = (hashes >> np.uint64(64 - group_bits)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        data = np.empty(len(hashes), _HASHED)
        data["hash"], data["count"] = (hashes >> np.uint64(32 - group_bits)).astype(np.uint32), counts
        ends = np.append(begin, len(hashes)) * _HASHED.itemsize
        blobs = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(group[begin], pa.int32()), blobs], names=["part", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for shard in _shards(batches, shard_words):
            for patterns, counts in shard.index.grams():
                held.append((shard.hash(patterns), np.minimum(counts, least)))
                size += len(counts)
            if size > GATHERED:
                held = [_added(np.concatenate([h for h, _ in held]), np.concatenate([c for _, c in held]), least)]
                size = len(held[0][0])
                if size > GATHERED // 2:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    return run


def _bit(groups: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return (mix((groups.astype(np.uint64) << np.uint64(32)) | hashes.astype(np.uint64)) & np.uint64(MAP_BITS - 1)).astype(np.int64)


def _maybe_frequent(least: int):
    def run(part: pa.Table) -> pa.Table:
        group = part["part"][0].as_py()
        data = np.concatenate([np.frombuffer(b.as_buffer(), _HASHED) for b in part["data"]])
        hashes, counts = _added(data["hash"], data["count"].astype(np.int64), least)
        keep = hashes[counts >= least]
        return pa.table({"bit": pa.array(_bit(np.full(len(keep), group), keep), pa.int64())})

    return run


def frequent_map(texts: DataFrame, shard_words: int, least: int) -> tuple[np.ndarray, int]:
    """The map of n-grams that may occur ``least`` times, as 64-bit words, and the bits of a hash's group."""
    group_bits = max(1, (GROUPS_PER_PART * texts.rdd.getNumPartitions() - 1).bit_length())
    hashed = texts.mapInArrow(_hashed(shard_words, group_bits, least), "part int, data binary")
    bits = hashed.groupBy("part").applyInArrow(_maybe_frequent(least), "bit bigint")
    set_ = F.expr("bit_or(shiftleft(1L, CAST(bit & 63 AS INT)))")
    found = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(set_.alias("v")).toArrow()
    held = np.zeros(MAP_BITS // 64, np.int64)
    held[found["at"].to_numpy()] = found["v"].to_numpy()
    return held.view(np.uint64), group_bits


def _spelled(shard_words: int, shared, group_bits: int):
    """Second pass: the phrases that may be frequent; an empty phrase has the number of all words."""

    def batch(names, codes, phrases, counts) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(counts), 50_000):
            part = slice(start, start + 50_000)
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(codes[part])), phrases.slice(start, 50_000), pa.array(counts[part], pa.int64())], names=["lang", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for shard in _shards(batches, shard_words):
            names = pa.array(shard.names, pa.string())

            def wanted(patterns: np.ndarray) -> np.ndarray:
                h = shard.hash(patterns)
                bit = _bit((h >> np.uint64(64 - group_bits)), (h >> np.uint64(32 - group_bits)).astype(np.uint32))
                return (known[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) > 0

            totals = np.bincount(shard.lang, minlength=len(shard.names))
            seen = np.flatnonzero(totals)
            yield from batch(names, seen, pa.array([""] * len(seen), pa.string()), totals[seen])
            for patterns, counts in shard.index.grams(wanted=wanted):
                yield from batch(names, shard.of_lang[patterns[:, 0] - 1], shard.spell(patterns), counts)

    return run


def _cuts(first: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of whole pieces of at most ``most`` words; a longer piece makes a run of its own."""
    starts = np.flatnonzero(first)
    begin = 0
    while begin < len(first):
        end = begin + most
        if end >= len(first):
            stop = len(first)
        else:
            i = np.searchsorted(starts, end, side="right") - 1
            stop = int(starts[i]) if starts[i] > begin else int(starts[i + 1]) if i + 1 < len(starts) else len(first)
        yield begin, stop
        begin = stop


def counts(docs: DataFrame, shard_words: int = SHARD_WORDS, least: int = LEAST) -> DataFrame:
    """(lang, phrase, f): all n-grams of up to three words with ``f`` >= ``least``, and the number of all words under ''.

    Null text is empty and null lang is ``und``; rows without words count nothing; repeated rows
    count each; other columns are ignored. Texts of any length are counted whole.
    """
    ready_workers(docs.sparkSession)
    texts = clear_names(docs, "text", "lang").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    known, group_bits = frequent_map(texts, shard_words, least)
    shared = docs.sparkSession.sparkContext.broadcast(known)  # MAP_BITS bits at any input
    found = texts.mapInArrow(_spelled(shard_words, shared, group_bits), _COUNTS)
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == ""))


def score(counted: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, k, score) of phrases of 2 and 3 words by their lowest cut (the shortest first part on a tie)."""
    known = counted.where("phrase <> ''")
    words_ = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")
    cuts = known.select("lang", "phrase", F.col("f").alias("a"), words_.alias("w")).where("size(w) > 1").select("*", cut)
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("right"))
    part = {s: known.select("lang", F.col("phrase").alias(s), F.col("f").alias(n)) for s, n in (("left", "l"), ("right", "r"))}
    joined = cuts.join(part["left"], ["lang", "left"]).join(part["right"], ["lang", "right"])
    big = "CAST({0} AS DECIMAL(15,0)) * CAST({1} AS DECIMAL(15,0))"
    exact = F.expr(f"CAST({SCALE} AS DECIMAL(7,0)) * CAST({big.format('a', 'a')} AS DECIMAL(30,0)) div CAST({big.format('l', 'r')} AS DECIMAL(30,0))")
    scored = joined.withColumn("score", exact.cast("bigint"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("b")
    return scored.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "b.l", "b.r", "b.k", "b.score")


def outermost(scored: DataFrame, percent: int = INSIDE_PERCENT) -> DataFrame:
    """Without the phrases that mostly stand inside a longer one."""
    w = F.split("phrase", " ")
    longer = scored.where(F.size(w) == 3).select("lang", F.col("a").alias("_longer"), F.explode(F.array(
        F.array_join(F.slice(w, 1, 2), " "), F.array_join(F.slice(w, 2, 2), " "))).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    joined = scored.join(most, ["lang", "phrase"], "left")
    return joined.where(F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("a") * percent)).drop("_longer")


def ranked(scored: DataFrame, shown: int = SHOWN, at_once: int = RANKED) -> DataFrame:
    """The first ``shown`` phrases of each language, numbered from 1.

    Long lists are ranked in parts first, each keeping its first ``shown``, until one task can take the rest.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = scored.count()
    while rows > at_once:
        parts = -(-rows // at_once)
        local = Window.partitionBy("lang", "_part").orderBy(*order)
        parted = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts))).withColumn("_rank", F.row_number().over(local))
        scored = stored(parted.where(F.col("_rank") <= shown).drop("_part", "_rank"), "phrases-ranked")
        left = scored.count()
        if left > rows // 2:  # many languages: no list is long
            break
        rows = left
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return scored.withColumn("rank", place.cast("bigint")).where(F.col("rank") <= shown)


def mine(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best collocations of 2 and 3 words of each language.

    ``a``, ``l`` and ``r`` count the phrase and the two parts of its lowest cut, ``n`` the words of the
    language. Null text is empty, null lang is ``und``, an empty table has no phrases; ties are
    ranked by ``a`` and then by the phrase's bytes.
    """
    counted = stored(counts(docs, shard_words), "phrases")
    totals = counted.where("phrase = ''").select("lang", F.col("f").alias("n"))
    scored = stored(outermost(score(counted)), "phrases-scored")
    return ranked(scored).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?' || chr(11) || chr(12) || chr(13) || chr(9),
  'abcdefghijklmnopqrstuvwxyz' || repeat(chr(10), 9) || ' ') AS t FROM documents),
p AS (SELECT row_number() OVER () AS piece_id, lang, piece FROM (SELECT lang, unnest(string_split(t, chr(10))) AS piece FROM d)),
w AS (SELECT piece_id, lang, list_filter(string_split(piece, ' '), lambda x: x <> '') AS ws FROM p),
u AS (SELECT piece_id, lang, unnest(ws) AS w1, generate_subscripts(ws, 1) AS place FROM w),
o AS (SELECT lang, w1, lead(w1) OVER next AS w2, lead(w1, 2) OVER next AS w3 FROM u WINDOW next AS (PARTITION BY piece_id ORDER BY place)),
g AS (SELECT lang, 1 AS k, w1 AS phrase FROM o UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM o WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM o WHERE w3 IS NOT NULL),
c AS (SELECT lang, k, phrase, lang || chr(10) || phrase AS key, count(*) AS f FROM g GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM c WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM c WHERE k > 1 AND f >= {LEAST}),
cuts AS (SELECT lang, k, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS lp, array_to_string(ws[cut + 1:k], ' ') AS rp FROM cand, LATERAL (SELECT unnest(range(1, k)) AS cut)),
s AS (SELECT cuts.*, lc.f AS l, rc.f AS r, {SCALE}::HUGEINT * a * a // (lc.f::HUGEINT * rc.f) AS score
  FROM cuts JOIN c AS lc ON lc.key = cuts.lang || chr(10) || lp JOIN c AS rc ON rc.key = cuts.lang || chr(10) || rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (SELECT lang, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase, a FROM cand WHERE k = 3),
longest AS (SELECT lang, phrase, max(a) AS longer FROM inner_ GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN longest USING (lang, phrase) WHERE b.k = 3 OR longer IS NULL OR 100 * longer < {INSIDE_PERCENT} * a)
SELECT * FROM (SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN total USING (lang)) WHERE rank <= {SHOWN}"""
