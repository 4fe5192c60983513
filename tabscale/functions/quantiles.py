"""Exact linear-interpolated quantiles in bounded memory.

``percentile`` keeps every distinct value of a column in one task, which is
right for small tables only. Larger ones are narrowed by mergeable sketches:
each round brackets the wanted ranks, counts what lies below and inside, and
stops when the inside fits one task. No round moves the data. Infinite values
and NaN (the largest value) are counted first and never narrowed, so both ways
give the same quantile.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .columns import WIDE_LIMIT, col, stack
from .ordering import beside, running_totals

# Values one task may hold to read off an order statistic.
SMALL = 2_000_000
ACCURACY = 20_000


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], small: int = SMALL
) -> dict[str, list[float | None]]:
    """``{column: [quantile per prob]}``; None where a column has no value."""
    columns = list(columns)
    data = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    grid = F.array(*[F.lit(float(p)) for p in probs])
    ends = _ends(data, len(columns))
    if sum(e.n for e in ends) <= small:
        if len(columns) > WIDE_LIMIT:
            groups = stack(df, columns).groupBy("feature").agg(F.percentile("value", grid).alias("q"))
            return {r.feature: list(r.q) if r.q is not None else [None] * len(probs) for r in groups.collect()}
        row = data.agg(*[F.percentile(f"c{i}", grid).alias(f"c{i}") for i in range(len(columns))]).first()
        return {c: list(row[i]) if row[i] is not None else [None] * len(probs) for i, c in enumerate(columns)}

    wanted = set()
    for i, e in enumerate(ends):
        if e.n:
            for p in probs:
                h = (e.n - 1) * p
                wanted |= {(i, math.floor(h)), (i, math.ceil(h))}
    found = _at_ranks(data, sorted(wanted), ends, small)
    result: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        values: list[float | None] = []
        for p in probs:
            if not ends[i].n:
                values.append(None)
                continue
            h = (ends[i].n - 1) * p
            low, high = found[i, math.floor(h)], found[i, math.ceil(h)]
            # As ``percentile`` weighs its two neighbours.
            same = low == high or math.floor(h) == math.ceil(h)
            values.append(low if same else (math.ceil(h) - h) * low + (h - math.floor(h)) * high)
        result[c] = values
    return result


def _ends(data: DataFrame, n: int) -> list:
    """Per column: values, and how many are -inf, inf and NaN."""
    def of(c):
        x = F.col(c)
        return F.struct(
            F.count(x).alias("n"), F.count_if(x == -math.inf).alias("low"), F.count_if(x == math.inf).alias("high"),
            F.count_if(F.isnan(x)).alias("nan")).alias(c)

    return list(data.agg(*[of(f"c{i}") for i in range(n)]).first())


def _at_ranks(data: DataFrame, targets, ends, small) -> dict[tuple[int, int], float]:
    """The value at each (column index, 0-based rank) among all values of the column."""
    found, finite = {}, {}
    for i, rank in targets:
        e = ends[i]
        if rank < e.low:
            found[i, rank] = -math.inf
        elif rank >= e.n - e.nan:
            found[i, rank] = math.nan
        elif rank >= e.n - e.nan - e.high:
            found[i, rank] = math.inf
        else:
            finite[i, rank] = (i, rank - e.low)
    counts = [e.n - e.low - e.high - e.nan for e in ends]
    values = _order_statistics(data, sorted(set(finite.values())), counts, small) if finite else {}
    return found | {t: values[f] for t, f in finite.items()}


def _order_statistics(data: DataFrame, targets, counts, small) -> dict[tuple[int, int], float]:
    """The value at each (column index, 0-based rank among the finite values)."""
    found: dict[tuple[int, int], float] = {}
    # Open interval known to hold the rank, values at or below its lower end, values inside.
    state = {t: (-math.inf, math.inf, 0, counts[t[0]]) for t in targets}
    spread = dict.fromkeys(targets, 2.0)

    def inside(t):
        low, high, _, _ = state[t]
        x = F.col(f"c{t[0]}")
        return F.when((x > low) & (x < high), x)

    while pending := [t for t in targets if t not in found and state[t][3] > small]:
        sketches = []
        for t in pending:
            _, _, below, m = state[t]
            p, d = (t[1] - below + 0.5) / m, spread[t] / ACCURACY
            ends = F.array(F.lit(max(0.0, p - d)), F.lit(min(1.0, p + d)))
            sketches.append(F.percentile_approx(inside(t), ends, ACCURACY))
        brackets = dict(zip(pending, data.agg(*sketches).first(), strict=True))
        tallies = []
        for t in pending:
            x, (a, b) = inside(t), brackets[t]
            tallies.append(F.struct(
                F.count_if(x < a), F.count_if(x == a), F.count_if((x > a) & (x < b)), F.count_if(x == b)))
        for t, tally in zip(pending, data.agg(*tallies).first(), strict=True):
            low, high, below, _ = state[t]
            a, b = brackets[t]
            less, at_a, between, at_b = tally
            rank = t[1] - below
            if rank < less:
                state[t] = (low, a, below, less)
            elif rank < less + at_a:
                found[t] = a
            elif rank < less + at_a + between:
                state[t] = (a, b, below + less + at_a, between)
            elif b > a and rank < less + at_a + between + at_b:
                found[t] = b
            else:
                start = below + less + at_a + (between + at_b if b > a else 0)
                state[t] = (b, high, start, state[t][3] - (start - below))

    rest = [t for t in targets if t not in found]
    # A few targets per job, so that the sorted pieces of one job stay within bounds.
    for start in range(0, len(rest), 8):
        part = rest[start:start + 8]
        picks = [
            F.element_at(F.sort_array(F.collect_list(inside(t))), t[1] - state[t][2] + 1) for t in part
        ]
        found.update(zip(part, data.agg(*picks).first(), strict=True))
    return found


def order_statistic(df: DataFrame, column: str, rank: int, small: int = SMALL) -> float:
    """The value at a 0-based rank of the non-null values of ``column``."""
    data = df.select(col(column).cast("double").alias("c0"))
    return _at_ranks(data, [(0, rank)], _ends(data, 1), small)[0, rank]


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], weight: str | None = None,
    rows: int | None = None, small: int = SMALL,
) -> DataFrame:
    """``keys, q``: exact quantiles per group of ``value``, each repeated ``weight`` times.

    Nulls and NaN are left out. ``rows`` bounds the rows of ``df`` if it is known. Beyond ``small``,
    or if it is not known, equal values are added up first, in the only pass over the rows. Few
    values of a group meet in one task; else positions come from running totals, and
    the wanted ranks are read off them.
    """
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    data = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        *keys, F.col(value).cast("double").alias("_v"), w.alias("_w"))
    grid = F.array(*[F.lit(float(p)) for p in probs])

    def within(values: DataFrame) -> DataFrame:
        return values.groupBy(*keys).agg(F.percentile("_v", grid, F.col("_w")).alias("q"))

    if rows is not None and rows <= small:
        return within(data)
    cells = cut_lineage(data.groupBy(*keys, "_v").agg(F.sum("_w").alias("_w")))
    if cells.count() <= small:
        return within(cells)
    cells = cells.where("_w > 0")
    totals = cells.groupBy(*keys).agg(F.sum("_w").alias("_n"))
    placed = beside(running_totals(cells, keys, "_v", {"_end": "_w"}, small=small), totals, keys)
    picks = []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(float(p))
        for name, rank in (("low", F.floor(h)), ("high", F.ceil(h))):
            here = (rank >= F.col("_end") - F.col("_w")) & (rank < F.col("_end"))
            picks.append(F.max(F.when(here, F.col("_v"))).alias(f"_{name}{i}"))
    found = placed.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks)
    cells = []
    for i, p in enumerate(probs):
        h, low, high = (F.col("_n") - 1) * F.lit(float(p)), F.col(f"_low{i}"), F.col(f"_high{i}")
        same = (low == high) | (F.floor(h) == F.ceil(h))
        cells.append(F.when(same, low).otherwise((F.ceil(h) - h) * low + (h - F.floor(h)) * high))
    return found.select(*keys, F.array(*cells).alias("q"))
