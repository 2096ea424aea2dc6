"""Exact quantiles of whole columns, without sorting them and without a column in one buffer.

Each wanted rank has a bracket of values that holds it. Approximate percentiles of the values inside narrow a bracket to
about 4 in ``ACCURACY`` of them, exact counts check it, and when at most ``SMALL`` values are left between its ends, those are
gathered and the rank is picked; a rank that falls on an end, however many values equal it, is known by the counts. A round is two aggregations with partial sums over all partitions, for all ranks and columns at once;
two rounds do for some hundred million rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL = 10_000
ACCURACY = 10_000


def order_statistics(df: DataFrame, ranks: dict[str, set[int]], bounds: dict[str, tuple[float, float]]) -> dict[tuple[str, int], float]:
    """The values of ranks from 0 of columns, nulls left out; ``bounds`` are each column's least and largest value."""
    brackets = {(c, k): bounds[c] for c, ks in ranks.items() for k in ks}
    wide = dict(brackets)  # the last bracket that is known to hold the rank
    found: dict[tuple[str, int], float] = {}
    while brackets:
        distinct = sorted({(c, *b) for (c, _), b in brackets.items()})
        open_ = {d: (F.col(d[0]) > d[1]) & (F.col(d[0]) < d[2]) for d in distinct}
        counts = df.agg(*(F.count_if(f) for d in distinct for f in (F.col(d[0]) < d[1], F.col(d[0]) == d[1], open_[d], (F.col(d[0]) == d[2]) & (d[1] != d[2])))).first()
        sizes = {d: counts[4 * n : 4 * n + 4] for n, d in enumerate(distinct)}
        gather, narrow = {}, {}
        for (c, k), (lo, hi) in list(brackets.items()):
            below, low, inside, high = sizes[c, lo, hi]
            place = k - below
            if place < 0:  # the approximation was off: the rank lies on that side of what was known
                brackets[c, k] = (wide[c, k][0], lo)
            elif place >= low + inside + high:
                brackets[c, k] = (hi, wide[c, k][1])
            elif place < low or place >= low + inside:
                found[c, k] = lo if place < low else hi
                del brackets[c, k]
            else:
                wide[c, k] = lo, hi
                (gather if inside <= SMALL else narrow).setdefault((c, lo, hi), []).append((k, place - low))
        if gather:
            values = df.agg(*(F.array_sort(F.collect_list(F.when(open_[d], F.col(d[0])))) for d in gather)).first()
            for n, (d, ks) in enumerate(gather.items()):
                for k, place in ks:
                    found[d[0], k] = values[n][place]
                    del brackets[d[0], k]
        if narrow:
            near = lambda d, ks: [min(1.0, max(0.0, place / sizes[d][2] + e / ACCURACY)) for _, place in ks for e in (-2, 2)]
            marks = df.agg(*(F.percentile_approx(F.when(open_[d], F.col(d[0])), near(d, ks), ACCURACY) for d, ks in narrow.items())).first()
            for n, (d, ks) in enumerate(narrow.items()):
                for j, (k, _) in enumerate(ks):
                    brackets[d[0], k] = marks[n][2 * j], marks[n][2 * j + 1]
    return found


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """For each column its quantiles, interpolated between neighbours; None for a column without values. Nulls and NaN are no values."""
    df = df.select(*(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns))
    row = df.agg(*(f(c) for c in columns for f in (F.count, F.min, F.max))).first()
    sizes = {c: row[3 * n] for n, c in enumerate(columns)}
    bounds = {c: (row[3 * n + 1], row[3 * n + 2]) for n, c in enumerate(columns) if sizes[c]}
    places = {c: [p * (sizes[c] - 1) for p in shares] for c in bounds}
    found = order_statistics(df, {c: {f(x) for x in ps for f in (math.floor, math.ceil)} for c, ps in places.items()}, bounds)
    between = lambda c, x: found[c, math.floor(x)] + (x - math.floor(x)) * (found[c, math.ceil(x)] - found[c, math.floor(x)])
    return {c: [between(c, x) for x in places[c]] if c in places else [None] * len(shares) for c in columns}
