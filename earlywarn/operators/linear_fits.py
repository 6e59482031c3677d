"""Many logistic fits in one scan (M7 and M11 for all candidates and splits).

A *problem* is (split, C, l1_ratio, random features or none).  One pass over
the encoded table, equal rows as one with their counts, adds up, for every problem that is still open, the loss,
its gradient and its Hessian over the training rows of the problem's split;
each task sends one partial per problem, which a shuffle on the problem adds
up.  The driver then takes a proximal Newton step for each (its state is one
small vector a problem) and the next pass evaluates all steps together.  The
number of passes is that of the slowest problem, not the number of fits.
Wide problems that differ in the split alone start where the first of them
ended, and their last passes, whose steps are short, keep the Hessian.

The objective is that of ``pyspark.ml`` with ``standardization=False``:
sum(w loss) / sum(w) + 1 / (C n) * ((1 - l1) / 2 |b|^2 + l1 |b|_1), w balanced,
the intercept free.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from earlywarn.operators.splits import TEST, Encoded, Plan, arrays, unpacked

MAX_PASSES = 100
TOL = 1e-7  # a step that moves no coefficient by more ends a fit
PASS_BYTES = 24 << 20  # of the partials of one pass; more problems are dealt over several
SEED = 42
TILE = 512  # rows whose features are held at once
WIDE = 64  # features from which a Hessian costs more than the rest of a pass


@dataclass
class Problem:
    split: int
    c: float = 1.0
    l1_ratio: float = 0.0
    gamma: str | float | None = None  # of random Fourier features; None: the features as they are
    components: int = 200
    beta: np.ndarray = field(default_factory=lambda: np.zeros(0))  # intercept last


# cos of a quarter turn times x, by powers of x squared
_QUARTER = [(-1) ** i * (math.pi / 2) ** (2 * i) / math.factorial(2 * i) for i in range(9)]
COSINES = 1 << 15  # done at once


def cosine(z: np.ndarray) -> np.ndarray:
    """cos(z) in place, to a few units of the last place of 1: the series for a quarter of the angle, doubled twice."""
    flat = z.reshape(-1)
    for x in (flat[i : i + COSINES] for i in range(0, len(flat), COSINES)):
        x *= 0.5 / math.pi
        x -= np.rint(x)
        x *= x
        y = np.full(len(x), _QUARTER[-1])
        for c in _QUARTER[-2::-1]:
            y *= x
            y += c
        for _ in range(2):
            y *= y
            y *= 2.0
            y -= 1.0
        x[:] = y
    return z


def _features(plan: Plan, p: Problem):
    """Dimension and map of a problem's features."""
    if p.gamma is None:
        return plan.width, None
    d, var = plan.variance(p.split)
    gamma = 1.0 / d if p.gamma == "auto" else (1.0 / (d * var) if var > 0 else 1.0) if p.gamma == "scale" else float(p.gamma)
    rng = np.random.default_rng(SEED)
    w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(plan.width, p.components))
    b = rng.uniform(0.0, 2.0 * math.pi, size=p.components)

    def fmap(x: np.ndarray) -> np.ndarray:
        z = x @ w
        z += b
        cosine(z)
        z *= math.sqrt(2.0 / p.components)
        return z

    return p.components, fmap


def _groups(problems: Sequence[tuple[int, Problem]]) -> dict[tuple, list[tuple[int, Problem]]]:
    """Problems that share a feature matrix."""
    out: dict[tuple, list] = {}
    for i, p in problems:
        out.setdefault((p.split, str(p.gamma), p.components if p.gamma is not None else 0), []).append((i, p))
    return out


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1))], axis=1)


def _passer(plan: Plan, problems: Sequence[tuple[int, Problem]], beta: dict[int, np.ndarray], bent: set[int] | None = None):
    """Partials (problem, [loss, gradient, upper half of the Hessian]) of a
    task's rows; the Hessian only for the problems in ``bent`` (None: all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[int, np.ndarray] = {}
        bends: dict[int, np.ndarray] = {}
        for g in (g for batch in batches for g in unpacked(batch, plan)):
            for group in _groups(problems).values():
                s = group[0][1].split
                fmap = _features(plan, group[0][1])[1]
                mine = np.flatnonzero(g.n[:, s, 0] + g.n[:, s, 1])
                n = plan.rows[s].sum()
                for some in (mine[i : i + TILE] for i in range(0, len(mine), TILE)):
                    x = plan.design(s, g.codes[some], g.nums[some])
                    x = _with_one(x if fmap is None else fmap(x))
                    ones = g.n[some, s, 1] * (n / (2.0 * max(1, plan.rows[s, 1])))  # their weight
                    w = ones + g.n[some, s, 0] * (n / (2.0 * max(1, plan.rows[s, 0])))
                    z = x @ np.stack([beta[i] for i, _ in group], axis=1)
                    p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
                    loss = (w[:, None] * np.logaddexp(0.0, z) - ones[:, None] * z).sum(axis=0)
                    slope = x.T @ (w[:, None] * p - ones[:, None])
                    same: dict[bytes, np.ndarray] = {}  # Hessians, by coefficients
                    for j, (i, _) in enumerate(group):
                        end = np.concatenate([loss[j : j + 1], slope[:, j]])
                        ends[i] = ends[i] + end if i in ends else end
                        if bent is None or i in bent:
                            at = beta[i].tobytes()
                            if at not in same:
                                v = x * np.sqrt(w * p[:, j] * (1.0 - p[:, j]))[:, None]
                                same[at] = v.T @ v
                            bends[i] = bends[i] + same[at] if i in bends else same[at]
        if ends:
            upper = {i: h[np.triu_indices(len(h))] for i, h in bends.items()}
            parts = [np.concatenate([v, upper[i]]) if i in upper else v for i, v in ends.items()]
            yield pa.RecordBatch.from_arrays([pa.array(list(ends), pa.int32()), pa.array([v.tobytes() for v in parts], pa.binary())], ["p", "part"])

    return run


def _squared(part: np.ndarray, d: int) -> np.ndarray:
    """A partial with the whole Hessian of its upper half, if it brings one."""
    if len(part) == d + 1:
        return part
    h = np.zeros((d, d))
    h[np.triu_indices(d)] = part[d + 1 :]
    return np.concatenate([part[: d + 1], (h + np.triu(h, 1).T).ravel()])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partials of the same problem added up."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, part in zip(batch.column(0).to_pylist(), batch.column(1)):
            v = np.frombuffer(part.as_buffer(), dtype=np.float64)
            sums[i] = sums[i] + v if i in sums else v.copy()
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["p", "part"])


def _newton(g: np.ndarray, h: np.ndarray, beta: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """Minimum of the quadratic model plus the penalty, from ``beta``."""
    d = len(beta)
    free = np.zeros(d)
    free[:-1] = 1.0
    a = h + np.diag(l2 * free + 1e-10)
    c = h @ beta - g + 1e-10 * beta
    if l1 == 0.0:
        return np.linalg.solve(a, c)
    z = _signed(a, c, beta, l1 * free)
    return _descent(a, c, beta, l1) if z is None else z


def _signed(a: np.ndarray, c: np.ndarray, start: np.ndarray, l1: np.ndarray) -> np.ndarray | None:
    """Minimum of z'az/2 - c'z + sum(l1 |z|), exact, by a search over the signs
    (feature-sign search, Lee et al. 2007): one solve a step, however alike the
    columns are.  None if rounding keeps it from ending."""
    value = lambda v: 0.5 * float(v @ a @ v) - float(c @ v) + float(l1 @ np.abs(v))
    z, sign = start.copy(), np.sign(start) * (l1 > 0)
    on = (z != 0) | (l1 == 0)
    slack = 1e-9 * l1.max() + 1e-14 * float(np.abs(c).max())
    for _ in range(50 * len(c)):
        f = np.flatnonzero(on)
        new = np.zeros(len(c))
        new[f] = np.linalg.solve(a[np.ix_(f, f)], c[f] - l1[f] * sign[f])
        flips = f[new[f] * sign[f] < 0]
        if len(flips):  # the best point on the way: the end, or where a coefficient gets to zero
            ends = [(value(new), new)]
            for j in flips:
                v = z + z[j] / (z[j] - new[j]) * (new - z)
                v[j] = 0.0
                ends.append((value(v), v))
            z = min(ends, key=lambda e: e[0])[1]
            on = (z != 0) | (l1 == 0)
            sign = np.sign(z) * (l1 > 0)
            continue
        z = new
        slope = a @ z - c
        over = np.where(on, 0.0, np.abs(slope) - l1)
        j = int(over.argmax())
        if over[j] <= slack:
            return z
        on[j], sign[j] = True, -np.sign(slope[j])
    return None


def _descent(a: np.ndarray, c: np.ndarray, start: np.ndarray, l1: float) -> np.ndarray:
    """The same minimum by coordinate descent with soft thresholds; the last coefficient is free."""
    d = len(c)
    z, r = start.copy(), a @ start
    diag = np.diag(a)
    for _ in range(2000):
        moved = 0.0
        for j in range(d):
            rho = c[j] - r[j] + diag[j] * z[j]
            new = (math.copysign(max(abs(rho) - l1, 0.0), rho) if j < d - 1 else rho) / diag[j]
            if new != z[j]:
                r += a[:, j] * (new - z[j])
                moved = max(moved, abs(new - z[j]))
                z[j] = new
        if moved < TOL / 10:
            break
    return z


class _State:
    """A problem between two passes: best point, last step, step length."""

    def __init__(self, p: Problem, n: float, d: int, start: np.ndarray | None = None):
        lam = 1.0 / (p.c * max(1.0, n))
        self.n, self.l1, self.l2 = max(1.0, n), lam * p.l1_ratio, lam * (1.0 - p.l1_ratio)
        self.best = self.trial = np.zeros(d + 1) if start is None or n <= 0 else start
        self.value, self.step, self.move, self.done = math.inf, 1.0, None, n <= 0
        self.bend, self.bent = None, True  # the last Hessian, and whether the next pass is to bring one

    def take(self, part: np.ndarray) -> None:
        d = len(self.trial)
        b = self.trial[:-1]
        value = part[0] / self.n + self.l2 / 2 * float(b @ b) + self.l1 * float(np.abs(b).sum())
        if value <= self.value + 1e-13 * abs(self.value):
            self.best, self.value = self.trial, value
            fresh, last = len(part) > d + 1, math.inf if self.move is None else float(np.abs(self.move).max())
            if fresh:
                self.bend = part[d + 1 :].reshape(d, d) / self.n
            self.move, self.step = _newton(part[1 : d + 1] / self.n, self.bend, self.best, self.l1, self.l2) - self.best, 1.0
            moved = float(np.abs(self.move).max())
            self.done = moved < TOL
            # after a short step the Hessian is nearly the same; a new one when steps do not shrink with it
            self.bent = d <= WIDE or (moved > 0.05 if fresh else moved > 0.1 * last)
        else:
            self.step /= 2
            self.done, self.bent = self.step < 1e-4, True
        self.trial = self.best + self.step * self.move


def fit(enc: Encoded, problems: Sequence[Problem]) -> list[Problem]:
    """The problems with their coefficients; a split without training rows gets zeros."""
    todo = list(enumerate(problems))
    dims = [_features(enc.plan, p)[0] for p in problems]
    first: dict[tuple, int] = {}  # problems alike but for the split
    alike = [first.setdefault((p.c, p.l1_ratio, str(p.gamma), p.components), i) if dims[i] > WIDE else i for i, p in todo]
    _fit_all(enc, [t for t in todo if alike[t[0]] == t[0]], dims, {})
    _fit_all(enc, [t for t in todo if alike[t[0]] != t[0]], dims, {i: problems[j].beta for i, j in enumerate(alike) if len(problems[j].beta) == dims[i] + 1})
    return list(problems)


def _fit_all(enc: Encoded, todo: list[tuple[int, Problem]], dims: list[int], starts: dict[int, np.ndarray]) -> None:
    i = 0
    while i < len(todo):
        size, j = 0, i
        while j < len(todo) and (j == i or size + 4 * (dims[todo[j][0]] + 3) ** 2 <= PASS_BYTES):
            size += 4 * (dims[todo[j][0]] + 3) ** 2
            j += 1
        _fit_block(enc, todo[i:j], dims, starts)
        i = j


def _fit_block(enc: Encoded, block: list[tuple[int, Problem]], dims: list[int], starts: dict[int, np.ndarray]) -> None:
    states = {i: _State(p, float(enc.plan.rows[p.split].sum()), dims[i], starts.get(i)) for i, p in block}
    tasks = max(1, min(enc.table.sparkSession.sparkContext.defaultParallelism, len(block)))
    for _ in range(MAX_PASSES):
        open_ = [(i, p) for i, p in block if not states[i].done]
        if not open_:
            break
        # only the problem's own settings travel, with its trial point
        bare = [(i, Problem(p.split, p.c, p.l1_ratio, p.gamma, p.components)) for i, p in open_]
        passer = _passer(enc.plan, bare, {i: states[i].trial for i, _ in open_}, {i for i, _ in open_ if states[i].bent})
        rows = enc.groups.mapInArrow(passer, "p int, part binary")
        for r in rows.repartition(tasks, "p").mapInArrow(_added, "p int, part binary").collect():  # one row a problem
            states[r.p].take(_squared(np.frombuffer(bytes(r.part), dtype=np.float64), dims[r.p] + 1))
    for i, p in block:
        p.beta = states[i].best


def predict(enc: Encoded, problems: Sequence[Problem]) -> DataFrame:
    """(problem, key, y_true, y_pred, y_prob) of the test rows of every problem."""
    plan, fitted = enc.plan, list(enumerate(problems))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, y, _, role, codes, nums = arrays(batch, plan)
            for group in _groups(fitted).values():
                s = group[0][1].split
                mine = np.flatnonzero(role[:, s] == TEST)
                if not len(mine):
                    continue
                x = plan.design(s, codes[mine], nums[mine])
                fmap = _features(plan, group[0][1])[1]
                x = _with_one(x if fmap is None else fmap(x))
                keys = key.take(pa.array(mine))
                for i, p in group:
                    prob = 1.0 / (1.0 + np.exp(-np.clip(x @ p.beta, -700, 700)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(mine), i, dtype=np.int32)), keys, pa.array(y[mine].astype(np.int32)),
                         pa.array((prob > 0.5).astype(np.int32)), pa.array(prob)], ["problem", "key", "y_true", "y_pred", "y_prob"])

    kind = enc.table.schema["key"].dataType.simpleString()
    return enc.table.mapInArrow(run, f"problem int, key {kind}, y_true int, y_pred int, y_prob double")


COUNTS = "problem int, tn long, fp long, fn long, tp long"


def outcomes(problem: int, n: np.ndarray, pred: np.ndarray) -> list[int]:
    """[problem, tn, fp, fn, tp] of groups with ``n`` test rows of either class that get ``pred``."""
    return [problem, *(int(n[pred == p, t].sum()) for t in (0, 1) for p in (0, 1))]


def counts_batch(rows: list[list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] + [pa.int64()] * 4)], ["problem", "tn", "fp", "fn", "tp"])


def confusions(enc: Encoded, problems: Sequence[Problem]) -> DataFrame:
    """(problem, tn, fp, fn, tp), to be added up by problem: the outcomes on the test rows."""
    plan, fitted = enc.plan, list(enumerate(problems))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in (g for batch in batches for g in unpacked(batch, plan)):
            rows = []
            for group in _groups(fitted).values():
                s = group[0][1].split
                mine = np.flatnonzero(g.n[:, s, 2] + g.n[:, s, 3])
                if not len(mine):
                    continue
                x = plan.design(s, g.codes[mine], g.nums[mine])
                fmap = _features(plan, group[0][1])[1]
                x = _with_one(x if fmap is None else fmap(x))
                for i, p in group:
                    prob = 1.0 / (1.0 + np.exp(-np.clip(x @ p.beta, -700, 700)))
                    rows.append(outcomes(i, g.n[mine, s, 2:], (prob > 0.5).astype(np.int64)))
            if rows:
                yield counts_batch(rows)

    return enc.groups.mapInArrow(run, COUNTS)
