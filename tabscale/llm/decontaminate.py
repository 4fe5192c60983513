"""Benchmark decontamination: pigeonhole pieces and Myers' bit-parallel distance.

A test item may differ from a passage by an error budget of edits. Cut into one piece
more than the budget, some piece must occur unchanged, so every text is searched once for
the pieces of all items, and the text around a hit is verified with Myers' bit-parallel
algorithm, which finds the least number of edits of the whole item against any part of it.
Items are broadcast in blocks of a fixed number of bytes; a larger benchmark is searched
block by block.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_names, ready_workers

#: Edits allowed for each 100 characters of an item.
ERRORS_PER_100 = 5
#: Characters of items that are broadcast at once.
BLOCK_CHARS = 8_000_000
_GAPS = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    """Lower case, with every run of other characters than letters and digits as one space."""
    return _GAPS.sub(" ", (text or "").lower()).strip()


def budget(item: str, per_100: int = ERRORS_PER_100) -> int:
    return len(item) * per_100 // 100


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly the same length, with their starts."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(lo, item[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        out[c] |= 1 << i
    return dict(out)


def myers(bits: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """Least edits of the item against any part of ``text``, and where that part ends first."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score = full, 0, length
    best, end = length, 0
    for j, c in enumerate(text):
        eq = bits.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (~(xh | plus) & full)
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        # A part may begin anywhere, so no cost enters from above.
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        plus = mh | (~(xv | ph) & full)
        minus = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Block:
    """A searcher for some items: (item_id, normalised text)."""

    def __init__(self, items: list[tuple[int, str]], per_100: int = ERRORS_PER_100) -> None:
        self.items = [(i, t, budget(t, per_100), masks(t)) for i, t in items]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, text, errors, _) in enumerate(self.items):
            for lo, piece in pieces(text, errors):
                places[piece].append((k, lo))
        self.search = ahocorasick.Automaton()
        for piece, found in places.items():
            self.search.add_word(piece, (len(piece), found))
        if places:
            self.search.make_automaton()
        self.empty = not places

    def hits(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item_id, edits, end) of each item within its budget: its closest, then first part."""
        if self.empty:
            return
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        short: dict[int, int] = {}
        for last, (size, found) in self.search.iter(text):
            for k, lo in found:
                _, item, errors, _ = self.items[k]
                begin = last + 1 - size - lo
                if not errors:  # so short that parts of words are met by chance: whole words only
                    if k not in short and text[max(0, begin - 1) : begin] in ("", " ") and text[last + 1 : last + 2] in ("", " "):
                        short[k] = last + 1
                    continue
                window = (max(0, begin - errors), min(len(text), begin + len(item) + errors))
                mine = spans[k]
                if mine and window[0] <= mine[-1][1] and mine[-1][0] <= window[1]:
                    mine[-1] = (min(mine[-1][0], window[0]), max(mine[-1][1], window[1]))
                else:
                    mine.append(window)
        for k, end in short.items():
            yield self.items[k][0], 0, end
        for k, mine in spans.items():
            item_id, item, errors, bits = self.items[k]
            best = None
            for lo, hi in mine:
                if hi - lo >= len(item) - errors:
                    edits, end = myers(bits, len(item), text[lo:hi])
                    if edits <= errors and (best is None or (edits, lo + end) < best):
                        best = (edits, lo + end)
                        if not edits:
                            break
            if best:
                yield item_id, *best


def blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items that hold letters or digits, in id order, in lists of at most ``chars`` characters."""
    held, size = [], 0
    rows = clear_names(benchmark, "item_id", "text").where("text IS NOT NULL").orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        text = normalise(row["text"])
        if not text:
            continue
        if held and size + len(text) > chars:
            yield held
            held, size = [], 0
        held.append((row["item_id"], text))
        size += len(text)
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, per_100: int = ERRORS_PER_100) -> DataFrame:
    """``doc_id, item_id, edits, end`` for every document that holds an item within its budget.

    Texts and items are normalised first; ``end`` is the place in the normalised text where
    the closest part ends. Null and empty texts hold nothing; items that are null or
    hold no letter or digit are not searched, those too short for an edit only as
    whole words without an edit. A document with a null id gives rows with a
    null id, repeated rows give repeated hits, and an empty table on either side gives none.
    """
    spark = docs.sparkSession
    ready_workers(spark)
    schema = "doc_id bigint, item_id bigint, edits bigint, end bigint"
    plain = clear_names(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    out = None
    for items in blocks(benchmark):
        fixed = spark.sparkContext.broadcast((items, per_100))

        def run(batches: Iterator[pa.RecordBatch], fixed=fixed) -> Iterator[pa.RecordBatch]:
            block = Block(*fixed.value)
            for batch in batches:
                rows = []
                for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                    rows += [(doc, *hit) for hit in block.hits(normalise(text.as_py()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["doc_id", "item_id", "edits", "end"])

        found = plain.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, per_100: int = ERRORS_PER_100) -> DataFrame:
    """The documents without a hit, with all their columns; rows without an id stay only if clean."""
    spark = docs.sparkSession
    ready_workers(spark)
    kept = docs
    for items in blocks(benchmark):
        fixed = spark.sparkContext.broadcast((items, per_100))

        def run(batches: Iterator[pa.RecordBatch], fixed=fixed) -> Iterator[pa.RecordBatch]:
            block = Block(*fixed.value)
            for batch in batches:
                clean = [next(block.hits(normalise(t.as_py())), None) is None for t in batch["text"]]
                yield batch.filter(pa.array(clean, pa.bool_()))

        kept = kept.mapInArrow(run, kept.schema)
    return kept
