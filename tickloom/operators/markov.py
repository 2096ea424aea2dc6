"""Hidden Markov models of sequences of any length: fit, filter, posteriors and the likeliest path.

Emissions are mixtures of normal distributions. Moves between states are logistic in drivers of the row that is left; without
drivers they are one matrix. A symbol's rows are one sequence, cut into chunks. What a chunk does to the probabilities of
the states is a small matrix, the product of its rows' matrices, so three steps see a whole sequence without holding it:
chunks give their matrices, in parallel; recurrences run over a symbol's matrices, forwards and backwards, and give each
chunk the state of things at its borders; chunks work on their rows, in parallel again. Within a task many chunks
advance together. The likeliest path goes the same way, with maxima for sums.

A fit repeats this with sums over all chunks of what is expected of states and moves; only those sums, whose number is
that of the parameters, reach the driver. Its log likelihood does not fall: moves with drivers take steps against a bound of the
curvature (half of the centred identity, times the drivers' squares), which cannot overshoot.

A row with a null or NaN in a column says nothing about its state; a null driver counts as 0.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.recurrences import Recurrence, run
from tickloom.operators.splits import numbered_by_day
from tickloom.operators.staging import kept

CHUNK = 512
KEY = ("symbol", "chunk")


@dataclass
class Markov:
    """Parameters: by state S, mixture component K, column D and driver C, of which the first is always 1."""

    columns: tuple[str, ...]
    start: np.ndarray  # S
    weights: np.ndarray  # S, K
    means: np.ndarray  # S, K, D
    covariances: np.ndarray  # S, K, D, D
    moves: np.ndarray  # S, S, C: logits
    drivers: tuple[str, ...] = ()
    diagonal: bool = False

    def components(self, x: np.ndarray) -> np.ndarray:
        """Log densities of rows (..., D) times the weight, by state and component."""
        s, k, d = self.means.shape
        roots = np.linalg.cholesky(self.covariances)
        inverse = np.linalg.inv(roots)
        z = np.einsum("skde,...ske->...skd", inverse, x[..., None, None, :] - self.means)
        scale = np.log(np.diagonal(roots, axis1=2, axis2=3)).sum(-1) + 0.5 * d * np.log(2 * np.pi)
        return np.log(np.maximum(self.weights, 1e-15)) - 0.5 * (z * z).sum(-1) - scale

    def chances(self, c: np.ndarray) -> np.ndarray:
        """Matrices of moves for drivers (..., C)."""
        logits = np.clip(np.einsum("ijc,...c->...ij", self.moves, c), -500, 500)
        odds = np.exp(logits - logits.max(-1, keepdims=True))
        return odds / odds.sum(-1, keepdims=True)

    def ordered(self, column: int = 0) -> Markov:
        """States by the mean of a column in their first component."""
        o = np.argsort(self.means[:, 0, column], kind="stable")
        return replace(self, start=self.start[o], weights=self.weights[o], means=self.means[o], covariances=self.covariances[o], moves=self.moves[o][:, o])


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


class Block:
    """Chunks side by side, padded to one length: densities and moves of their rows."""

    def __init__(self, model: Markov, frame: pd.DataFrame):
        lists = frame["x"].to_list()
        self.sizes = np.array([len(v) // len(model.columns) for v in lists])
        n, longest, d = len(lists), int(self.sizes.max()), len(model.columns)
        self.real = np.arange(longest) < self.sizes[:, None]
        self.x = np.full((n, longest, d), np.nan)
        self.x[self.real] = np.concatenate(lists).reshape(-1, d)
        self.c = np.ones((n, longest, 1 + len(model.drivers)))
        if model.drivers:
            self.c[self.real, 1:] = np.nan_to_num(np.concatenate(frame["c"].to_list()).reshape(-1, len(model.drivers)))
        self.clean = self.real & ~np.isnan(self.x).any(-1)
        self.parts = model.components(np.where(self.clean[..., None], self.x, 0.0))
        self.logs = np.where(self.clean[..., None], log_sum(self.parts, 3), 0.0)
        self.moves = model.chances(self.c)
        self.moves[~self.real] = np.eye(len(model.start))

    def product(self) -> tuple[np.ndarray, np.ndarray]:
        """Each chunk's matrix, and the log of what it is to be multiplied by."""
        n, longest, s = self.logs.shape
        p, scale = np.broadcast_to(np.eye(s), (n, s, s)), np.zeros(n)
        for t in range(longest):
            top = self.logs[:, t].max(1)
            p = p @ (np.exp(self.logs[:, t] - top[:, None])[:, :, None] * self.moves[:, t])
            most = p.max((1, 2))
            p, scale = p / most[:, None, None], scale + top + np.log(most)
        return p, scale

    def filtered(self, before: np.ndarray) -> np.ndarray:
        """Probabilities of the states after each row, given those before the first."""
        out, p = np.empty(self.logs.shape), before
        for t in range(out.shape[1]):
            f = p * np.exp(self.logs[:, t] - self.logs[:, t].max(1, keepdims=True))
            out[:, t] = f = f / f.sum(1, keepdims=True)
            p = np.einsum("ni,nij->nj", f, self.moves[:, t])
        return out

    def smoothed(self, f: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors of the states, and of the moves from each row to the next one."""
        states, both, b = np.empty(f.shape), np.empty((*f.shape, f.shape[2])), after
        for t in range(f.shape[1] - 1, -1, -1):
            pair = f[:, t, :, None] * self.moves[:, t] * b[:, None, :]
            both[:, t] = pair = pair / pair.sum((1, 2), keepdims=True)
            states[:, t] = pair.sum(2)
            b = np.einsum("nij,nj->ni", self.moves[:, t], b) * np.exp(self.logs[:, t] - self.logs[:, t].max(1, keepdims=True))
            b = b / b.sum(1, keepdims=True)
        return states, both

    def longest_paths(self) -> tuple[np.ndarray, np.ndarray]:
        """The best log score from each state in a chunk's first row to each in its last, and the log chances of the moves out of it."""
        n, longest, s = self.logs.shape
        with np.errstate(divide="ignore"):
            logs = np.log(self.moves)
            best = np.log(np.broadcast_to(np.eye(s), (n, s, s))) + self.logs[:, 0, None, :]
        for t in range(1, longest):
            step = (best[..., None] + logs[:, t - 1, None]).max(2) + self.logs[:, t, None, :]
            best = np.where(self.real[:, t, None, None], step, best)
        return best, logs[np.arange(n), self.sizes - 1]

    def path(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The likeliest states of all rows, given the scores before the first and the state of the last."""
        n, longest, s = self.logs.shape
        back = np.zeros((n, longest, s), np.int32)
        with np.errstate(divide="ignore"):
            logs = np.log(self.moves)
        best = before + self.logs[:, 0]
        for t in range(1, longest):
            ways = best[:, :, None] + logs[:, t - 1]
            back[:, t] = ways.argmax(1)
            best = np.where(self.real[:, t, None], ways.max(1) + self.logs[:, t], best)
        out, state = np.zeros((n, longest), np.int32), last.astype(np.int32)
        for t in range(longest - 1, -1, -1):
            out[:, t] = state
            if t:
                state = np.where(self.real[:, t], back[np.arange(n), t, state], state)
        return out


def _square(v: np.ndarray) -> np.ndarray:
    s = int(round(len(v) ** 0.5))
    return np.asarray(v).reshape(s, s)


@dataclass
class Before(Recurrence):
    """Probabilities of the states before each chunk's first row, and what the chunk adds to the log likelihood."""

    first: np.ndarray
    inputs = ("matrix", "scale")
    outputs = "before array<double>, gain double"

    def start(self):
        return {"p": self.first}

    def block(self, state, matrix, scale):
        p, before, gains = state["p"], [], []
        for m, s in zip(matrix, scale, strict=True):
            before.append(p)
            q = p @ _square(m)
            gains.append(np.log(q.sum()) + s)
            p = q / q.sum()
        state["p"] = p
        return before, gains


@dataclass
class After(Recurrence):
    """For rows in descending order: likelihoods of all that follows each chunk, by the state that its next row has; null after the last."""

    inputs = ("matrix",)
    outputs = "after array<double>"

    def start(self):
        return {"b": None}

    def block(self, state, matrix):
        b, out = state["b"], []
        for m in map(_square, matrix):
            out.append(b)
            b = m.sum(1) if b is None else m @ b
            b = b / b.sum()
        state["b"] = b
        return (out,)


@dataclass
class BestBefore(Recurrence):
    """The best scores of paths that end in each state of a chunk's first row, before what that row says."""

    first: np.ndarray
    inputs = ("inner", "out")
    outputs = "before array<double>"

    def start(self):
        return {"p": self.first}

    def block(self, state, inner, out):
        p, before = state["p"], []
        for v, a in zip(inner, out, strict=True):
            before.append(p)
            end = (p[:, None] + _square(v)).max(0)
            p = (end[:, None] + _square(a)).max(0)
            p = p - p.max()
        state["p"] = p
        return (before,)


@dataclass
class LastState(Recurrence):
    """For rows in descending order: the state of each chunk's last row on the likeliest path."""

    inputs = ("inner", "out", "before")
    outputs = "last int"

    def start(self):
        return {"next": None}

    def block(self, state, inner, out, before):
        following, found = state["next"], []
        for v, a, p in zip(inner, out, before, strict=True):
            ways = np.asarray(p)[:, None] + _square(v)
            end = ways.max(0)
            last = int((end if following is None else end + _square(a)[:, following]).argmax())
            found.append(last)
            following = int(ways[:, last].argmax())
        state["next"] = following
        return (np.array(found, np.int32),)


def chunks(df: DataFrame, model: Markov, rows: int = CHUNK, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each chunk of a symbol's rows in time: columns and drivers as flat arrays, and ``carry`` as an array of structs."""
    numbered = numbered_by_day(df).withColumn("chunk", F.floor(F.col("row") / rows))
    item = lambda names: F.array(*(F.col(c).cast("double") for c in names)) if names else F.array().cast("array<double>")
    one = F.struct("row", item(model.columns).alias("x"), item(model.drivers).alias("c"), F.struct(*(carry or ("row",))).alias("keys"))
    gathered = numbered.groupBy(*KEY).agg(F.array_sort(F.collect_list(one)).alias("rows"))  # ``rows`` of them at most
    flat = lambda name: F.flatten(F.transform("rows", lambda r: F.transform(r[name], lambda v: F.coalesce(v, F.lit(float("nan"))))))
    return gathered.select(*KEY, flat("x").alias("x"), flat("c").alias("c"), F.transform("rows", lambda r: r["keys"]).alias("keys"))


def _by_block(df: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` on some chunks at a time."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                yield work(batch.iloc[at : at + 256].reset_index(drop=True))

    return df.mapInPandas(go, schema)


def _borders(packed: DataFrame, model: Markov, backwards: bool = True) -> DataFrame:
    """(symbol, chunk, gain, before, after)."""

    def matrices(frame: pd.DataFrame) -> pd.DataFrame:
        p, scale = Block(model, frame).product()
        return frame[list(KEY)].assign(matrix=list(p.reshape(len(p), -1)), scale=scale)

    found = _by_block(packed.select(*KEY, "x", "c"), matrices, "symbol string, chunk long, matrix array<double>, scale double")
    found = run(found, Before(model.start), order=("chunk",))
    if backwards:
        found = run(found.withColumn("back", -F.col("chunk")), After(), order=("back",)).drop("back")
    return found.drop("matrix", "scale")


def _probabilities(f: np.ndarray, block: Block) -> list[np.ndarray]:
    return [np.ascontiguousarray(v[:n]).ravel() for v, n in zip(f, block.sizes, strict=True)]


def _unpacked(packed: DataFrame, found: DataFrame, states: int) -> DataFrame:
    """Rows of ``keys`` with a column ``p_<state>`` each, from flat arrays of probabilities by chunk."""
    both = packed.select(*KEY, "keys").join(found, list(KEY))
    row = both.select("symbol", F.posexplode("keys").alias("at", "key"), "p")
    at = lambda s: F.get("p", F.col("at") * states + s)
    return row.select("symbol", "key.*", *(at(s).alias(f"p_{s}") for s in range(states)))


def filtered(df: DataFrame, model: Markov, carry: tuple[str, ...] = ("timestamp_ns", "seq"), rows: int = CHUNK) -> DataFrame:
    """(symbol, ``carry``, p_0, ...): the probabilities of the states after each row, given all rows up to it."""
    packed = kept(chunks(df, model, rows, carry))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        block = Block(model, frame)
        return frame[list(KEY)].assign(p=_probabilities(block.filtered(np.stack(frame["before"])), block))

    joined = packed.select(*KEY, "x", "c").join(_borders(packed, model, backwards=False), list(KEY))
    return _unpacked(packed, _by_block(joined, work, "symbol string, chunk long, p array<double>"), len(model.start))


def _after(frame: pd.DataFrame, states: int) -> np.ndarray:
    return np.stack([np.ones(states) if v is None else v for v in frame["after"]])


def smoothed(df: DataFrame, model: Markov, carry: tuple[str, ...] = ("timestamp_ns", "seq"), rows: int = CHUNK) -> DataFrame:
    """(symbol, ``carry``, p_0, ...): the probabilities of the states of each row, given all rows of the sequence."""
    packed = kept(chunks(df, model, rows, carry))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        block = Block(model, frame)
        states, _ = block.smoothed(block.filtered(np.stack(frame["before"])), _after(frame, len(model.start)))
        return frame[list(KEY)].assign(p=_probabilities(states, block))

    joined = packed.select(*KEY, "x", "c").join(_borders(packed, model), list(KEY))
    return _unpacked(packed, _by_block(joined, work, "symbol string, chunk long, p array<double>"), len(model.start))


def decoded(df: DataFrame, model: Markov, carry: tuple[str, ...] = ("timestamp_ns", "seq"), rows: int = CHUNK) -> DataFrame:
    """(symbol, ``carry``, state): the likeliest path of states; of equally likely ones any."""
    packed = kept(chunks(df, model, rows, carry))

    def inner(frame: pd.DataFrame) -> pd.DataFrame:
        best, out = Block(model, frame).longest_paths()
        return frame[list(KEY)].assign(inner=list(best.reshape(len(best), -1)), out=list(out.reshape(len(out), -1)))

    found = _by_block(packed.select(*KEY, "x", "c"), inner, "symbol string, chunk long, inner array<double>, out array<double>")
    with np.errstate(divide="ignore"):
        first = np.log(model.start)
    found = run(found, BestBefore(first), order=("chunk",)).withColumn("back", -F.col("chunk"))
    borders = run(found, LastState(), order=("back",)).select(*KEY, "before", "last")

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        block = Block(model, frame)
        path = block.path(np.stack(frame["before"]), frame["last"].to_numpy())
        return frame[list(KEY)].assign(states=[p[:n] for p, n in zip(path, block.sizes, strict=True)])

    states = _by_block(packed.select(*KEY, "x", "c").join(borders, list(KEY)), work, "symbol string, chunk long, states array<int>")
    both = packed.select(*KEY, "keys").join(states, list(KEY))
    row = both.select("symbol", F.posexplode("keys").alias("at", "key"), "states")
    return row.select("symbol", "key.*", F.get("states", F.col("at")).alias("state"))


class Expected:
    """Sums over rows of what is expected under a model; they add up over blocks."""

    def __init__(self, model: Markov):
        s, k, d = model.means.shape
        c = 1 + len(model.drivers)
        self.shapes = {"start": (s,), "mass": (s, k), "first": (s, k, d), "second": (s, k, d, d), "pairs": (s, s), "slope": (s, s, c), "squares": (s, c, c), "gain": ()}

    @property
    def size(self) -> int:
        return sum(int(np.prod(v)) for v in self.shapes.values())

    def of(self, model: Markov, frame: pd.DataFrame) -> np.ndarray:
        block = Block(model, frame)
        states, both = block.smoothed(block.filtered(np.stack(frame["before"])), _after(frame, len(model.start)))
        share = np.exp(block.parts - log_sum(block.parts, 3)[..., None]) * states[..., None] * block.clean[..., None, None]
        x = np.where(block.clean[..., None], block.x, 0.0)
        left = block.real.copy()
        ends = np.flatnonzero(frame["after"].isna())
        left[ends, block.sizes[ends] - 1] = False  # no move leaves a sequence's last row
        both, stay = both * left[..., None, None], states * left[..., None]
        c = block.c
        sums = {
            "start": states[(frame["chunk"] == 0).to_numpy(), 0].sum(0),
            "mass": share.sum((0, 1)),
            "first": np.einsum("ntsk,ntd->skd", share, x),
            "second": np.einsum("ntsk,ntd,nte->skde", share, x, x),
            "pairs": both.sum((0, 1)),
            "slope": np.einsum("ntij,ntc->ijc", both - stay[..., None] * block.moves, c),
            "squares": np.einsum("nti,ntc,nte->ice", stay, c, c),
            "gain": frame["gain"].sum(),
        }
        return np.concatenate([np.ravel(sums[k]) for k in self.shapes])

    def named(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, shape in self.shapes.items():
            n = int(np.prod(shape))
            out[k], at = flat[at : at + n].reshape(shape), at + n
        return out


def improved(model: Markov, found: dict[str, np.ndarray], floor: float, ridge: float) -> Markov:
    """The parameters that do better on the expected sums. ``floor`` is the least variance, ``ridge`` draws the moves' logits towards 0."""
    s, k, d = model.means.shape
    mass = np.maximum(found["mass"], 1e-10)
    means = found["first"] / mass[..., None]
    cov = found["second"] / mass[..., None, None] - means[..., :, None] * means[..., None, :]
    if model.diagonal:
        cov = np.maximum(np.diagonal(cov, axis1=2, axis2=3), floor)[..., None] * np.eye(d)
    else:
        values, vectors = np.linalg.eigh(cov)
        cov = (vectors * np.maximum(values, floor)[..., None, :]) @ np.swapaxes(vectors, 2, 3)
    empty = found["mass"] < 1e-10
    means, cov = np.where(empty[..., None], model.means, means), np.where(empty[..., None, None], model.covariances, cov)
    weights = np.maximum(found["mass"] / np.maximum(found["mass"].sum(1, keepdims=True), 1e-10), 1e-6)
    if model.drivers:
        c = model.moves.shape[2]
        centred = 0.5 * (np.eye(s) - 1 / s)
        moves = model.moves.copy()
        for i in range(s):
            bound = np.kron(centred, found["squares"][i]) + max(ridge, 1e-9) * np.eye(s * c)
            moves[i] += np.linalg.solve(bound, (found["slope"][i] - ridge * model.moves[i]).ravel()).reshape(s, c)
    else:
        share = np.maximum(found["pairs"], 1e-300) / np.maximum(found["pairs"].sum(1, keepdims=True), 1e-300)
        moves = np.log(np.maximum(share, 1e-15))[..., None]
    return replace(model, start=found["start"] / found["start"].sum(), weights=weights / weights.sum(1, keepdims=True), means=means, covariances=cov, moves=moves)


def fit(df: DataFrame, start: Markov, rounds: int = 50, tolerance: float = 1e-4, floor: float = 1e-3, ridge: float = 1e-3, rows: int = CHUNK) -> tuple[Markov, list[float]]:
    """The model after ``rounds`` rounds from ``start``, or fewer when the log likelihood gains less than ``tolerance``; and the log likelihoods before each."""
    packed = kept(chunks(df, start, rows).drop("keys"))
    model, history = start, []
    for _ in range(rounds):
        expected = Expected(model)
        joined = packed.join(_borders(packed, model), list(KEY))
        work = functools.partial(lambda frame, model, expected: pd.DataFrame({"sums": [expected.of(model, frame)]}), model=model, expected=expected)
        sums = _by_block(joined, work, "sums array<double>").select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
        if not sums:
            break
        flat = np.zeros(expected.size)
        for at, v in sums:
            flat[at] = v
        found = expected.named(flat)
        history.append(float(found["gain"]))
        if len(history) > 1 and history[-1] - history[-2] < tolerance:
            break
        model = improved(model, found, floor, ridge)
    return model, history


def fit_sequence(x: np.ndarray, c: np.ndarray, start: Markov, rounds: int = 50, tolerance: float = 1e-4, floor: float = 1e-3, ridge: float = 1e-3) -> tuple[Markov, list[float]]:
    """``fit`` to one short sequence of rows (n, columns) and drivers (n, drivers), for use inside a task."""
    model, history = start, []
    frame = pd.DataFrame({"chunk": [0], "x": [x.ravel()], "c": [c.ravel()], "after": [None]})
    for _ in range(rounds):
        p, scale = Block(model, frame).product()
        gain = float(np.log((model.start @ p[0]).sum()) + scale[0])
        expected = Expected(model)
        found = expected.named(expected.of(model, frame.assign(before=[model.start], gain=gain)))
        history.append(gain)
        if len(history) > 1 and history[-1] - history[-2] < tolerance:
            break
        model = improved(model, found, floor, ridge)
    return model, history


def best_fit(df: DataFrame, starts: list[Markov], order_by: int = 0, **how) -> tuple[Markov, list[float]]:
    """The fit of the highest likelihood, its states in the order of a column's means."""
    model, history = max((fit(df, s, **how) for s in starts), key=lambda found: found[1][-1] if found[1] else -np.inf)
    return model.ordered(order_by), history


def standard(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Columns less their mean, over their population deviation (1 if it is 0)."""
    row = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return df.withColumns({c: (F.col(c) - float(row[f"m_{c}"] or 0.0)) / float(row[f"s_{c}"] or 1.0) for c in columns})


def spread_start(df: DataFrame, columns: tuple[str, ...], states: int, by: str, components: int = 1, drivers: tuple[str, ...] = (), diagonal: bool = False, stay: float = 0.9) -> Markov:
    """A model to start from: states are equal shares of the rows by the column ``by``, and components a state's shares in turn."""
    n = states * components
    cuts = df.select(F.percentile_approx(by, [k / n for k in range(1, n)], 10_000).alias("cuts")).first()["cuts"] if n > 1 else []
    part = functools.reduce(lambda a, b: a + b, ((F.col(by) > float(c)).cast("int") for c in cuts or []), F.lit(0))
    means = {r["part"]: [r[c] for c in columns] for r in df.where(F.col(by).isNotNull()).groupBy(part.alias("part")).agg(*(F.avg(c).alias(c) for c in columns)).collect()}
    overall = df.agg(*(F.avg(c).alias(c) for c in columns), *(F.var_pop(c).alias(f"v_{c}") for c in columns)).first()
    middle = [overall[c] or 0.0 for c in columns]
    d = len(columns)
    at = np.array([means.get(p, middle) for p in range(n)], float).reshape(states, components, d)
    spread = np.diag([max(overall[f"v_{c}"] or 1.0, 1e-3) for c in columns])
    chances = np.full((states, states), (1 - stay) / max(1, states - 1)) + np.eye(states) * (stay - (1 - stay) / max(1, states - 1))
    moves = np.zeros((states, states, 1 + len(drivers)))
    moves[:, :, 0] = np.log(chances)
    return Markov(columns, np.full(states, 1 / states), np.full((states, components), 1 / components), at, np.broadcast_to(spread, (states, components, d, d)).copy(), moves, drivers, diagonal)
