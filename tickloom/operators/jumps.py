"""A Kalman filter of several columns whose noise is fitted again and again, and which starts over when its surprises pile up.

The state is the columns' level, which moves as a random walk. Its noise ``q`` and that of the observations ``r`` are fitted by
expectation-maximisation (a filter and a smoother pass a round): first on the first ``window`` whole rows, then before every
``every`` rows on the last ``window`` whole rows before them. A sum of scaled surprises that passes a limit is a jump: the next row
is met with as little knowledge as the first.

A symbol's rows pass through one task in order; it holds ``window`` + ``every`` of them. A row that lacks a value moves nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

UNKNOWN = 10.0


def _inverse(m: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(m + 1e-6 * np.eye(len(m)), hermitian=True)


def _positive(m: np.ndarray, least: float = 1e-6) -> np.ndarray:
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return (vectors * np.maximum(values, least)) @ vectors.T


def refitted(rows: np.ndarray, q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The noises after one round on whole rows."""
    n, d = rows.shape
    one = np.eye(d)
    means, spreads, ahead = np.empty((n, d)), np.empty((n, d, d)), np.empty((n, d, d))
    m, p = np.zeros(d), UNKNOWN * one
    for t in range(n):
        ahead[t] = p
        gain = p @ _inverse(p + r)
        m = m + gain @ (rows[t] - m)
        p = (one - gain) @ p
        means[t], spreads[t] = m, p
        p = p + q
    smooth, cover = means[-1], spreads[-1]
    moved, missed = np.zeros((d, d)), np.outer(rows[-1] - smooth, rows[-1] - smooth) + cover
    for t in range(n - 2, -1, -1):
        back = spreads[t] @ _inverse(ahead[t + 1])
        before = means[t] + back @ (smooth - means[t])
        before_cover = spreads[t] + back @ (cover - ahead[t + 1]) @ back.T
        both = cover @ back.T  # of a row's state with the one before
        step = smooth - before
        moved += cover - both - both.T + before_cover + np.outer(step, step)
        smooth, cover = before, before_cover
        missed += np.outer(rows[t] - smooth, rows[t] - smooth) + cover
    return _positive(moved / max(1, n - 1)), _positive(missed / n)


@dataclass
class Filter:
    """The running filter of one symbol."""

    columns: int
    allowance: float = 0.5
    limit: float = 5.0
    warm: int = 30
    q: np.ndarray = field(init=False)
    r: np.ndarray = field(init=False)

    def __post_init__(self):
        d = self.columns
        self.q, self.r = 0.1 * np.eye(d), np.eye(d)
        self.m, self.p = np.zeros(d), UNKNOWN * np.eye(d)
        self.sum = self.squares = self.piled = 0.0
        self.seen = 0

    def fit(self, rows: np.ndarray, rounds: int) -> None:
        for _ in range(rounds):
            self.q, self.r = refitted(rows, self.q, self.r)

    def step(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool, float]:
        """The level, the surprise, whether it is a jump, and the sum of surprises."""
        surprise, jump = np.zeros(self.columns), False
        whole = not np.isnan(x).any()
        if whole:
            gain = self.p @ _inverse(self.p + self.r)
            surprise = x - self.m
            self.m = self.m + gain @ surprise
            self.p = (np.eye(self.columns) - gain) @ self.p
            size = np.abs(surprise).mean()
            self.sum, self.squares = self.sum + size, self.squares + size * size
            n = self.seen + 1
            spread = np.sqrt(max(self.squares / n - (self.sum / n) ** 2, 1e-8))
            if self.seen >= self.warm:
                self.piled = max(0.0, self.piled + size / max(spread, 1e-8) - self.allowance)
                jump = self.piled > self.limit
                self.piled = 0.0 if jump else self.piled
        level = self.m
        self.p = UNKNOWN * np.eye(self.columns) if jump else self.p + self.q
        self.seen += 1
        return level, surprise, jump, self.piled


class Sequence:
    """One symbol's rows, put in one by one; results come out in order once the first fit can be made."""

    def __init__(self, columns: int, window: int, every: int, least: int, **how):
        self.filter, self.window, self.every, self.least = Filter(columns, **how), window, every, least
        self.waiting: list[np.ndarray] = []
        self.past: list[np.ndarray] = []
        self.since: int | None = None  # rows since the last fit, once there was one

    def _next(self, x: np.ndarray) -> tuple:
        if self.since == self.every:
            self.filter.fit(np.array(self.past), 2)
            self.since = 0
        self.since += 1
        if not np.isnan(x).any():
            self.past = [*self.past, x][-self.window :]
        return self.filter.step(x)

    def put(self, x: np.ndarray) -> list[tuple]:
        if self.since is not None:
            return [self._next(x)]
        whole = not np.isnan(x).any()
        if not whole or len(self.past) < self.window:
            self.waiting.append(x)
            self.past += [x] if whole else []
            return []
        return [*self._first(), self._next(x)]

    def _first(self) -> list[tuple]:
        self.filter.fit(np.array(self.past), 5)
        found = [self.filter.step(x) for x in self.waiting]
        self.waiting, self.since = [], self.every
        return found

    def end(self) -> list[tuple]:
        if self.since is not None:
            return []
        if len(self.past) < self.least:
            return [(x, np.zeros(len(x)), False, 0.0) for x in self.waiting]
        return self._first()


def jump_filter(
    df: DataFrame, columns: list[str], window: int = 504, every: int = 63, least: int = 50, key: str = "symbol", order: tuple[str, ...] = ("timestamp_ns", "seq"), **how
) -> DataFrame:
    """``df`` with ``level_<column>`` and ``surprise_<column>``, ``jump`` and ``piled``; with fewer than ``least`` whole rows a symbol's levels are its rows."""
    dealt = df.repartition(key).sortWithinPartitions(key, *order)
    levels, surprises = [f"level_{c}" for c in columns], [f"surprise_{c}" for c in columns]

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, sequence, held = object(), None, []

        def emitted(found: list[tuple]) -> Iterator[pd.DataFrame]:
            """The first of the rows that are held, with what was found for them."""
            if not found:
                return
            frame = pd.concat(held, ignore_index=True)
            held[:] = [frame.iloc[len(found) :]]
            level, surprise = (np.array([f[k] for f in found]).reshape(len(found), -1).T for k in (0, 1))
            named = dict(zip(levels, level, strict=True)) | dict(zip(surprises, surprise, strict=True))
            yield frame.iloc[: len(found)].assign(**named, jump=[bool(f[2]) for f in found], piled=[float(f[3]) for f in found])

        for batch in batches:
            keys = batch[key].to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if keys[a] != current:
                    if sequence is not None:
                        yield from emitted(sequence.end())
                    current, sequence = keys[a], Sequence(len(columns), window, every, least, **how)
                part = batch.iloc[a:b]
                held.append(part)
                yield from emitted([f for x in part[columns].to_numpy(float) for f in sequence.put(x)])
        if sequence is not None:
            yield from emitted(sequence.end())

    ddl = ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), *(f"`{c}` double" for c in levels + surprises), "jump boolean, piled double"])
    return dealt.mapInPandas(go, ddl)
