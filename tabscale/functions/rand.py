"""Repeatable randomness from hashed row keys.

``rand(seed)`` depends on how rows are partitioned and changes when a lost
task is run again. A digest of (seed, key) does not, and any SQL engine can
recompute it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ready_workers

_WORD = 4294967296.0  # 2^32: one digest holds four 32-bit words


def _digest(seed, keys) -> Column:
    parts = [F.lit(str(seed))]
    parts += [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def _word(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("double") / F.lit(_WORD)


def hash_uniform(seed, *keys) -> Column:
    """Uniform [0, 1) from the seed and key columns."""
    return _word(_digest(seed, keys), 0)


def hash_normal(seed, *keys) -> Column:
    """Standard normal (Box-Muller on two words of one digest)."""
    digest = _digest(seed, keys)
    radius = F.sqrt(F.lit(-2.0) * F.ln(F.greatest(_word(digest, 0), F.lit(1e-12))))
    return radius * F.cos(F.lit(2.0 * math.pi) * _word(digest, 1))


def poisson_steps(mean: float = 1.0) -> list[float]:
    """Cumulative Poisson probabilities, as far as a 32-bit word resolves."""
    steps, term, total, k = [], math.exp(-mean), 0.0, 0
    while 1.0 - total > 1.0 / _WORD:
        total += term
        steps.append(total)
        k += 1
        term *= mean / k
    return steps


def poisson_weight(seed, *keys) -> Column:
    """How often a bootstrap draws the row: Poisson(1) by inverse CDF."""
    u = hash_uniform(seed, *keys)
    # The steps at or below u; the draw is one common subexpression of the sum.
    total = F.lit(0)
    for step in poisson_steps():
        total = total + (u >= step).cast("int")
    return total


def poisson_weights(seed, n: int, *keys) -> Column:
    """``n`` weights per row; element i equals ``poisson_weight(f"{seed}|{i}", *keys)``."""
    parts = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]

    def draw(i: Column) -> Column:
        u = _word(F.md5(F.concat_ws("|", F.lit(str(seed)), i.cast("string"), *parts)), 0)
        return F.get(F.transform(F.array(u), lambda v: sum(((v >= s).cast("int") for s in poisson_steps()), F.lit(0))), F.lit(0))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), draw)


def hash_normal_array(seed, n: int, *keys) -> Column:
    """``n`` standard normals per row; element i equals ``hash_normal(f"{seed}|{i}", *keys)``.

    A few are generated code, many are drawn by batches.
    """
    if n <= 32:
        return F.array(*[hash_normal(f"{seed}|{i}", *keys) for i in range(n)])
    return batch_normals(seed, n, *keys)


def batch_normals(seed, n: int, *keys) -> Column:
    """The normals of ``hash_normal_array``, up to the last bits of a logarithm: digests of a batch of rows are taken together, in numpy."""
    ready_workers(SparkSession.active())
    parts = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]
    # As concat_ws joins them: a null key leaves no separator.
    ends = F.concat(*[F.coalesce(F.concat(F.lit("|"), part), F.lit("")) for part in parts])
    starts = [f"{seed}|{i}" for i in range(n)]

    @F.arrow_udf("array<double>")
    def draw(ends: pa.Array) -> pa.Array:
        texts = pc.cast(ends, pa.binary())
        found = np.empty((len(texts), n))
        size = max(1, DRAWS // max(1, n))
        for at in range(0, len(texts), size):
            found[at:at + size] = np_normals(starts, texts.slice(at, size))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * n), pa.array(found.ravel()))

    return draw(ends)


# --- digests of many texts at once -----------------------------------------------------

# Normals that are drawn at once, and texts whose digests are taken together (few calls, and most of it stays in a core's cache).
DRAWS, TEXTS = 200_000, 65_536
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_ADDED = [int(abs(math.sin(i + 1)) * 4294967296.0) for i in range(64)]


def np_words(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two 32-bit words of the MD5 digests of texts of one length, as a matrix of bytes."""
    first, second = np_word_grid(np.zeros((1, 0), np.uint8), texts)
    return first[0], second[0]


def np_word_grid(heads: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(heads, tails): the first two 32-bit words of the MD5 digests of each head followed by each tail.

    Both are matrices of bytes. Words and steps that all tails of a head share are computed once.
    """
    (m, size), (n, length) = heads.shape, tails.shape
    length += size
    used = length // 4 + 1  # words that hold text or its end mark; the others are the same for all
    padded = [np.zeros((k, 4 * used), np.uint8) for k in (m, n)]
    padded[0][:, :size] = heads
    padded[1][:, size:length] = tails[:, :length - size]
    padded[1][:, length] = 0x80
    of_head, of_tail = (v.view("<u4").T for v in padded)
    out = np.empty((2, m, n), np.uint32)
    wide = max(1, min(n, TEXTS))
    high = max(1, TEXTS // wide)
    for i in range(0, m, high):
        for j in range(0, n, wide):
            own, other = np.ascontiguousarray(of_head[:, i:i + high, None]), np.ascontiguousarray(of_tail[:, None, j:j + wide])
            words = [own[g] if 4 * g + 4 <= size else other[g] if 4 * g >= size else own[g] + other[g] for g in range(used)]
            out[:, i:i + high, j:j + wide] = _digested(words, length)
    return out[0].byteswap(inplace=True), out[1].byteswap(inplace=True)


def _digested(words: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the state, in the shape that ``words`` have together."""
    blocks, shape = (length + 8) // 64 + 1, (1, 1)
    state = [np.full(shape, v, np.uint32) for v in _START]
    for block in range(blocks):
        before = state
        a, b, c, d = (v.copy() for v in state)
        spare, turned = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
        for i in range(64):
            g = 16 * block + (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
            word = words[g] if g < len(words) else None
            if word is not None and (wider := np.broadcast_shapes(shape, word.shape)) != shape:
                shape = wider
                a, b, c, d = (np.broadcast_to(v, shape).copy() for v in (a, b, c, d))
                spare, turned = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
            if i < 16:
                np.bitwise_xor(c, d, out=spare)
                spare &= b
                spare ^= d
            elif i < 32:
                np.bitwise_xor(b, c, out=spare)
                spare &= d
                spare ^= c
            elif i < 48:
                np.bitwise_xor(b, c, out=spare)
                spare ^= d
            else:
                np.invert(d, out=spare)
                spare |= b
                spare ^= c
            spare += a
            same = np.uint32((_ADDED[i] + (8 * length if word is None and g == 16 * blocks - 2 else 0)) & 0xFFFFFFFF)
            if word is None:
                spare += same
            elif word.size < spare.size:
                spare += word + same
            else:
                spare += word
                spare += same
            turn = _TURNS[i // 16][i % 4]
            np.left_shift(spare, np.uint32(turn), out=turned)
            spare >>= np.uint32(32 - turn)
            spare |= turned
            spare += b
            a, b, c, d, spare = d, spare, b, c, a
        state = [v + w for v, w in zip((a, b, c, d), before, strict=True)]
    return state[0], state[1]


def box_muller(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Normals of two words, as ``hash_normal`` makes them, up to their last bits."""
    radius = first / _WORD
    np.maximum(radius, 1e-12, out=radius)
    np.log(radius, out=radius)
    radius *= -2.0
    np.sqrt(radius, out=radius)
    # The cosine by the tangent of half the angle, which numpy takes many at once.
    half = second * (math.pi / _WORD)
    np.tan(half, out=half)
    half *= half
    radius *= 1.0 - half
    half += 1.0
    radius /= half
    return radius


def np_normals(starts: list[str], ends: pa.Array) -> np.ndarray:
    """(ends, starts): the normal drawn for each text, a start followed by an end (binary)."""
    out = np.empty((len(ends), len(starts)))
    lengths = pc.binary_length(ends).to_numpy(zero_copy_only=False)
    heads: dict[int, list[int]] = {}
    encoded = [s.encode() for s in starts]
    for i, s in enumerate(encoded):
        heads.setdefault(len(s), []).append(i)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        tail = np.zeros((len(rows), 0), np.uint8)
        if length:
            tail = np.frombuffer(ends.take(pa.array(rows)).buffers()[2], np.uint8, len(rows) * length).reshape(len(rows), length)
        for size, of in heads.items():
            texts = np.empty((len(of), len(rows), size + length), np.uint8)
            texts[:, :, :size] = np.frombuffer(b"".join(encoded[i] for i in of), np.uint8).reshape(len(of), 1, size)
            texts[:, :, size:] = tail
            drawn = box_muller(*np_words(texts.reshape(-1, size + length)))
            out[np.ix_(rows, of)] = drawn.reshape(len(of), len(rows)).T
    return out


def np_normal_grid(starts: list[str], heads: list[bytes], tails: list[bytes]) -> np.ndarray:
    """(starts, heads, tails): the normal drawn for each text, a start followed by a head and a tail."""
    out = np.empty((len(starts), len(heads), len(tails)))
    whole = [s.encode() + h for s in starts for h in heads]
    flat = out.reshape(len(whole), len(tails))
    ends = list(_by_length(tails))
    for of_head, head in _by_length(whole):
        for of_tail, tail in ends:
            # Texts in a row, such as numbers of one length, are written as one piece.
            place = slice(of_tail[0], of_tail[-1] + 1) if of_tail[-1] - of_tail[0] + 1 == len(of_tail) else of_tail
            step = max(1, TEXTS // len(of_tail))
            for at in range(0, len(of_head), step):
                drawn = box_muller(*np_word_grid(head[at:at + step], tail))
                for row, found in zip(of_head[at:at + step], drawn, strict=True):
                    flat[row, place] = found
    return out


def _by_length(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and bytes of the texts of each length, as a matrix."""
    lengths = np.array([len(t) for t in texts], int)
    for length in np.unique(lengths):
        of = np.flatnonzero(lengths == length)
        yield of, np.frombuffer(b"".join(texts[i] for i in of), np.uint8).reshape(len(of), length)
