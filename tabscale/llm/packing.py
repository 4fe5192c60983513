"""Packing of documents into training sequences by order-preserving dynamic programming.

The documents of a task follow one another as one stream of tokens. Windows may be cut at
the end of a document (free), at the end of a sentence, or, in longer stretches without
one, every few tokens; a cut inside a document costs a penalty and a window costs its
padding. The cheapest cuts are found in one sweep: the best earlier cut within reach is
the front of a monotone queue.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_names, ready_workers
from .shards import RANKS, tokens

LENGTH = 1024
END = 0
#: Cost of a cut after a sentence and of a cut elsewhere within a document, in tokens of padding.
SENTENCE, ELSEWHERE = 4, 24
#: Tokens between the places where a stretch without a sentence end may be cut.
GRID = 16
#: Tokens that are swept at once; what follows the last cut goes on with the next.
SWEPT = 1 << 19
#: The tokenizer as a file; ``RANKS`` holds the same vocabulary.
TOKENIZER = "byte_bpe_50k.json"
#: A text that holds this mark is left to the tokenizer's own search for special tokens.
MARK = "<|endoftext|>"

_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


@functools.lru_cache(maxsize=1)
def _whole_tokenizer(name: str = TOKENIZER):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@functools.lru_cache(maxsize=2)
def _sentence_ends(ranks: str) -> np.ndarray:
    """For each id: whether its text ends a sentence or a line."""
    encoding = tokens(ranks).encoding
    ends = np.zeros(encoding.n_vocab + 1, bool)
    for i in range(encoding.n_vocab):
        piece = encoding.decode_single_token_bytes(i)
        ends[i] = piece[-1:] in (b".", b"!", b"?") or b"\n" in piece
    return ends


def token_ids(text: str | None, ranks: str = RANKS) -> np.ndarray:
    """Ids of a whole text and the end mark. ``ranks`` is the tokenizer's vocabulary, read by a faster library."""
    if not text:
        return np.array([END], np.uint32)
    if MARK in text:
        return np.array([*_whole_tokenizer().encode(text, add_special_tokens=False).ids, END], np.uint32)
    encoding = tokens(ranks).encoding
    found = encoding.encode_to_numpy(text, disallowed_special=()) if hasattr(encoding, "encode_to_numpy") else np.array(encoding.encode_ordinary(text))
    return np.append(found.astype(np.uint32), np.uint32(END))


def places(ids: np.ndarray, ends: np.ndarray, sentence: np.ndarray, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """Where a stream may be cut and what each cut costs; ``ends`` are the ends of its documents."""
    after = np.flatnonzero(sentence[ids]) + 1
    fixed = np.union1d(np.concatenate([[0], after]), np.append(ends, len(ids)))
    gap = np.diff(fixed)
    long = np.flatnonzero(gap > grid)
    inner = (gap[long] - 1) // grid
    first = np.repeat(fixed[long], inner)
    nth = np.arange(len(first)) - np.repeat(np.cumsum(inner) - inner, inner) + 1
    at = np.concatenate([fixed, first + nth * grid])
    cost = np.concatenate([np.full(len(fixed), SENTENCE), np.full(len(first), ELSEWHERE)])
    order = np.argsort(at, kind="stable")
    at, cost = at[order], cost[order]
    cost[np.isin(at, np.append(ends, 0))] = 0
    return at, cost


def cheapest(at: list[int], cost: list[int], length: int = LENGTH) -> list[int]:
    """The cuts from the first to the last place that cost least: padding of all windows and their penalties.

    A window ends at a place and starts at an earlier one within ``length``. best[j] = length - at[j] + cost[j]
    + min(best[i] + at[i]); the minimum over the places in reach is the front of a queue of rising values.
    """
    n = len(at)
    best, back = [0] * n, [0] * n
    queue, value, head = [0], [at[0]], 0
    for j in range(1, n):
        here = at[j]
        while here - at[queue[head]] > length:
            head += 1
        best[j] = value[head] + length - here + cost[j]
        back[j] = queue[head]
        mine = best[j] + here
        while len(queue) > head and value[-1] >= mine:
            queue.pop()
            value.pop()
        queue.append(j)
        value.append(mine)
        if head > 4096:
            del queue[:head], value[:head]
            head = 0
    cuts, j = [at[-1]], n - 1
    while j:
        j = back[j]
        cuts.append(at[j])
    return cuts[::-1]


def tail(size: int, length: int = LENGTH) -> list[int]:
    """The lengths of the sequences that take the last tokens of a task: one padded to ``length``,
    or several that are powers of two, which need no padding."""
    parts = [1 << b for b in range(size.bit_length() - 1, -1, -1) if size >> b & 1]
    return [size] if len(parts) > 1 and (len(parts) - 1) * ELSEWHERE > length - size else parts


class Stream:
    """The tokens of a task that are not in a sequence yet, and the documents they belong to."""

    def __init__(self, length: int, ranks: str, first_sequence: int, with_ids: bool):
        self.length, self.ranks, self.sequence, self.with_ids = length, ranks, first_sequence, with_ids
        self.held: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int, int]] = []  # id, tokens, tokens that are in sequences already
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.docs.append((doc_id, len(ids), 0))
        self.size += len(ids)

    def pieces(self, last: bool) -> Iterator[dict]:
        if not self.size:
            return
        ids = np.concatenate(self.held)
        ends = np.cumsum([n - used for _, n, used in self.docs])
        at, cost = places(ids, ends, _sentence_ends(self.ranks))
        cuts = cheapest(at.tolist(), cost.tolist(), self.length)
        if last:
            rest = tail(cuts[-1] - cuts[-2], self.length)
            cuts = [*cuts[:-1], *(cuts[-2] + np.cumsum(rest)).tolist()]
        else:
            cuts = cuts[:-1]
        yield self._rows(ids, ends, np.array(cuts))
        done = cuts[-1]
        left = int(np.searchsorted(ends, done, side="right"))
        kept = self.docs[left:]
        if kept:
            doc_id, n, used = kept[0]
            kept[0] = (doc_id, n, used + done - (int(ends[left - 1]) if left else 0))
        self.docs, self.held, self.size = kept, [ids[done:]], len(ids) - done

    def _rows(self, ids: np.ndarray, ends: np.ndarray, cuts: np.ndarray) -> dict:
        edges = np.union1d(cuts, ends[ends < cuts[-1]])
        begin, size = edges[:-1], np.diff(edges)
        doc = np.searchsorted(ends, begin, side="right")
        window = np.searchsorted(cuts, begin, side="right") - 1
        doc_begin = np.concatenate([[0], ends[:-1]])
        used = np.array([u for _, _, u in self.docs])
        raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        first = self.sequence
        self.sequence += len(cuts) - 1
        rows = {
            "doc_id": pa.array([self.docs[d][0] for d in doc.tolist()], pa.int64()),
            "start": pa.array(begin - doc_begin[doc] + used[doc], pa.int64()),
            "length": pa.array(size, pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.int64()),
            "doc_tokens": pa.array(np.array([n for _, n, _ in self.docs])[doc], pa.int64()),
            "sequence_id": pa.array(first + window, pa.int64()),
            "offset": pa.array(begin - cuts[window], pa.int64()),
        }
        if self.with_ids:
            rows["ids"] = pa.array([ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.list_(pa.int32()))
        return rows


def _packed(length: int, ranks: str, with_ids: bool, swept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(length, ranks, TaskContext.get().partitionId() << 40, with_ids)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                stream.add(doc_id, token_ids(text.as_py(), ranks))
                if stream.size >= swept:
                    yield from (pa.RecordBatch.from_pydict(r) for r in stream.pieces(last=False))
        yield from (pa.RecordBatch.from_pydict(r) for r in stream.pieces(last=True))

    return run


def pack(docs: DataFrame, length: int = LENGTH, ranks: str = RANKS, with_ids: bool = False, swept: int = SWEPT) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``length`` tokens.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), with ``with_ids`` also the ids. Every
    text is tokenised whole and closed by an end mark; documents keep their order within a task of the
    scan, whose number is in the upper bits of its sequences' ids. Null text is empty, so such a
    document is its end mark; null and repeated ids stay as they are; texts of any length are
    cut into as many pieces as they need; other columns are ignored; an empty table has no pieces.
    """
    ready_workers(docs.sparkSession)
    rows = clear_names(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(_packed(length, ranks, with_ids, swept), _PIECES + (", ids array<int>" if with_ids else ""))
