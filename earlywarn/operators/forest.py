"""Binary classification trees on binned arrays, grown level by level.

All nodes of a level are split at once: one weighted count per (node, column,
bin) gives the gain of every candidate split.  Numbers split at bins, one-hot
slots of a category column each split off one category.  A tree holds the
value of every node, so the same tree cut at a smaller depth is the tree
grown with that depth, and the first trees of a forest or of a boosted
sequence are the smaller model: one growth serves all such candidates.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

_M = np.uint64(0xFF51AFD7ED558CCD)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _M
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


POISSON = np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120, 720, 5040], dtype=np.float64))


def bag(tags: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in a tree's bag: Poisson(1), by a hash of the row."""
    u = mix(tags.view(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return np.searchsorted(POISSON, (u >> np.uint64(11)).astype(np.float64) / (1 << 53), side="right")


@dataclass
class Bins:
    """Rows as bins: one column per category column (its slots; the last bin
    is for none) and per number."""

    z: np.ndarray  # rows x columns
    sizes: list[int]
    cats: int  # leading columns that are categories

    def features(self) -> int:
        return sum(n - 1 for n in self.sizes[: self.cats]) + len(self.sizes) - self.cats


@dataclass
class Tree:
    column: np.ndarray  # -1: leaf
    bin: np.ndarray
    left: np.ndarray  # the right child follows
    value: np.ndarray
    depth: np.ndarray

    def leaves(self, bins: Bins, max_depth: int | None = None, above: np.ndarray | None = None) -> np.ndarray:
        """The node of each row, no deeper than ``max_depth``; ``above``: nodes on the way, if known."""
        at = np.zeros(len(bins.z), dtype=np.int64) if above is None else above.copy()
        flat, width = np.ascontiguousarray(bins.z).ravel(), bins.z.shape[1]
        column = self.column if max_depth is None else np.where(self.depth < max_depth, self.column, -1)
        live, node = np.arange(len(at)), at
        while True:
            col = column.take(node)
            go = np.flatnonzero(col >= 0)
            if len(go) < len(live):
                live, node, col = live.take(go), node.take(go), col.take(go)
            if not len(live):
                break
            v, cut = flat.take(live * width + col), self.bin.take(node)
            node = self.left.take(node) + np.where(col < bins.cats, v != cut, v > cut)
            at[live] = node
        return at


def grow(bins: Bins, target: np.ndarray, weight: np.ndarray, rows: np.ndarray, max_depth: int | None, min_leaf: int,
         tried: int | None = None, seed: int = 0, gini: bool = True, count: np.ndarray | None = None) -> Tree:
    """A tree for ``rows``.  ``gini``: classes 0 and 1, node value the weighted
    share of 1; else squared error, node value the weighted mean.  ``min_leaf``
    counts rows, ``count`` of them in each where equal ones are put together
    (the target is their mean then); ``tried`` features are drawn for every
    node, by a hash.  A column's counts are made only for the nodes that try it."""
    z, t, w = bins.z[rows].T.astype(np.int32), target[rows].astype(np.float64), weight[rows].astype(np.float64)
    many = None if count is None else count[rows].astype(np.float64)
    at = np.zeros(len(rows), dtype=np.int64)
    column, bin_, left, value, depth = [], [], [], [], []
    first, k, level = 0, 1, 0  # first node of the level, its nodes
    base = np.cumsum([0] + [n - 1 if i < bins.cats else 1 for i, n in enumerate(bins.sizes)])
    while True:
        sw = np.bincount(at, w, k)
        st = np.bincount(at, w * t, k)
        n = np.bincount(at, many, k)
        mean = st / np.maximum(sw, 1e-300)
        value.append(mean)
        depth.append(np.full(k, level))
        pure = (mean <= 0) | (mean >= 1) if gini else np.zeros(k, dtype=bool)
        stop = pure | (n < 2 * min_leaf) | (max_depth is not None and level >= max_depth)
        col, cut, gain = np.full(k, -1), np.zeros(k, dtype=np.int64), np.full(k, -1.0)
        if not stop.all():
            keep = ~stop[at]
            z, t, w, at, many = z[:, keep], t[keep], w[keep], at[keep], None if many is None else many[keep]
            drawn = None
            if tried is not None:
                f = bins.features()
                node = (first + np.arange(k)).astype(np.uint64)[:, None] * np.uint64(f) + np.arange(f, dtype=np.uint64)
                draw = mix(node + np.uint64((seed + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
                drawn = draw <= np.partition(draw, min(tried, f) - 1, axis=1)[:, min(tried, f) - 1 :][:, :1]
            parent = st * st / np.maximum(sw, 1e-300)
            for c, size in enumerate(bins.sizes):
                if size < 2:
                    continue
                mine = ~stop if drawn is None else ~stop & drawn[:, base[c] : base[c + 1]].any(axis=1)
                nodes = np.flatnonzero(mine)
                if not len(nodes):
                    continue
                # no split off the none bin, none at the last bin
                lw, lt, ln = (x[:, :-1] for x in _counts(np.cumsum(mine) - 1, mine[at], at, z[c], t, w, many, len(nodes), size, c >= bins.cats))
                rw, rt, rn = sw[nodes, None] - lw, st[nodes, None] - lt, n[nodes, None] - ln
                with np.errstate(divide="ignore", invalid="ignore"):
                    # weighted decrease of impurity, up to a constant factor: the same form for both criteria
                    g = lt * lt / lw + rt * rt / rw - parent[nodes, None]
                ok = (ln >= min_leaf) & (rn >= min_leaf)
                if drawn is not None:
                    ok &= drawn[nodes, base[c] : base[c + 1]]
                g = np.where(ok, g, -1.0)
                best = g.argmax(axis=1)
                top = g[np.arange(len(nodes)), best]
                better = top > gain[nodes]
                gain[nodes[better]], col[nodes[better]], cut[nodes[better]] = top[better], c, best[better]
            col = np.where(gain > 1e-12 * np.maximum(1.0, sw), col, -1)
        split = col >= 0
        kids = np.cumsum(split) * 2 - 2
        column.append(col)
        bin_.append(cut)
        left.append(np.where(split, first + k + kids, -1))
        if not split.any():
            break
        keep = split[at]
        z, t, w, at, many = z[:, keep], t[keep], w[keep], at[keep], None if many is None else many[keep]
        c = col[at]
        v = z[c, np.arange(len(at))]
        right = np.where(c < bins.cats, v != cut[at], v > cut[at])
        at = kids[at] + right
        first, k, level = first + k, int(split.sum()) * 2, level + 1
    return Tree(*[np.concatenate(x) for x in (column, bin_, left, value, depth)])


def _counts(number: np.ndarray, mine: np.ndarray, at: np.ndarray, z: np.ndarray, t: np.ndarray, w: np.ndarray, many: np.ndarray | None,
            k: int, size: int, running: bool) -> list[np.ndarray]:
    """Weight, weighted target and rows by node and bin, of the rows of ``mine``."""
    if mine.all():
        place = number[at] * size + z
    else:
        place, t, w, many = number[at[mine]] * size + z[mine], t[mine], w[mine], None if many is None else many[mine]
    out = [np.bincount(place, x, k * size).reshape(k, size) for x in (w, w * t, many)]
    return [np.cumsum(x, axis=1) for x in out] if running else out


CELLS = 1 << 10  # values of columns put together, at most
FILL = 2  # of these values and nodes, for each row


def grow_counts(bins: Bins, zeros: np.ndarray, ones: np.ndarray, many: np.ndarray, weights: tuple[float, float], rows: np.ndarray,
                max_depth: int | None, min_leaf: int, tried: int | None = None, seed: int = 0) -> Tree:
    """The tree of ``grow_alike`` for one ``min_leaf``."""
    return grow_alike(bins, zeros, ones, many, weights, rows, max_depth, [min_leaf], tried, seed)[min_leaf]


def grow_alike(bins: Bins, zeros: np.ndarray, ones: np.ndarray, many: np.ndarray, weights: tuple[float, float], rows: np.ndarray,
               max_depth: int | None, min_leaves: list[int], tried: int | None = None, seed: int = 0) -> dict[int, Tree]:
    """As ``grow`` (``gini``) for equal rows put together: how often each class
    is drawn, and how many rows were, in whole numbers; a tree for each of
    ``min_leaves``.  The counts of a node and bin are added up as digits of one
    number where they fit; with few nodes a level adds up several columns at
    once (``_few_nodes``), with many it finds gains only where a bin holds
    rows: a level costs a multiple of the rows still in it, however many nodes
    there are.  Trees are one until a level where they split differently."""
    held = [x[rows].astype(np.float64) for x in ((zeros, ones, many) if max(min_leaves) > 1 else (zeros, ones))]  # drawn rows are one at least
    todo = [_Growth(sorted(set(min_leaves)), np.zeros(len(rows), dtype=np.int64), np.ascontiguousarray(bins.z[rows]), held, len(held))]
    out = {}
    while todo:
        g = todo.pop()
        more = g.level(bins, weights, max_depth, tried, seed) if g.nodes else []
        todo += more
        if not more:
            tree = Tree(*[np.concatenate(x) for x in zip(*g.done)])
            out.update(dict.fromkeys(g.min_leaves, tree))
    return out


@dataclass
class _Growth:
    """Trees that were split alike up to here."""

    min_leaves: list[int]
    at: np.ndarray  # node of each row, numbered within the level; rows of leaves come last
    z: np.ndarray  # rows x columns
    held: list[np.ndarray]  # counts, or one number of which they are digits
    parts: int
    digits: int = 0
    joint: Joint | None = None
    sums: list[np.ndarray] | None = None  # of each node, if known
    nodes: int = 1
    first: int = 0  # first node of the level
    depth: int = 0
    done: list[tuple] = field(default_factory=list)  # (column, bin, left, value, depth) of the levels above

    def level(self, bins: Bins, weights: tuple[float, float], max_depth: int | None, tried: int | None, seed: int) -> list[_Growth]:
        """The next level, apart where trees split differently; none at the end, when ``done`` is the whole tree."""
        at, z, held, k, parts = self.at, self.z, self.held, self.nodes, self.parts
        sums = self.sums or _apart([np.bincount(at, x, k)[:k].astype(np.int64) for x in held], parts, self.digits)
        sa, sb, n = sums[0], sums[1], sums[2] if parts > 2 else sums[0] + sums[1]
        st, sw = weights[1] * sb, weights[0] * sa + weights[1] * sb
        value, depths = st / np.maximum(sw, 1e-300), np.full(k, self.depth)
        go = (sa > 0) & (sb > 0) & (n >= 2 * self.min_leaves[0]) & (max_depth is None or self.depth < max_depth)
        nodes = np.flatnonzero(go)
        m = len(nodes)
        if not m:
            self.done.append((np.full(k, -1), np.zeros(k, dtype=np.int64), np.full(k, -1), value, depths))
            return []
        at = np.append(np.where(go, np.cumsum(go) - 1, m), [m, m]).take(at)  # the nodes that go on; rows of the others come last
        joint, digits = self.joint, self.digits
        keep = at < m
        if np.count_nonzero(keep) < 0.8 * len(at):
            keep = np.flatnonzero(keep)
            at, z, held, joint = at.take(keep), z.take(keep, axis=0), [x.take(keep) for x in held], None
        if not digits:
            most = int(max(x[nodes].max() for x in sums)).bit_length()
            if parts * most <= 53 and int(max(x.sum() for x in sums)).bit_length() + (parts - 1) * most <= 62:
                held, digits = [sum(x * 2.0 ** (i * most) for i, x in enumerate(held))], most
        drawn = None
        if tried is not None:
            f = bins.features()
            node = (self.first + nodes).astype(np.uint64)[:, None] * np.uint64(f) + np.arange(f, dtype=np.uint64)
            draw = mix(node + np.uint64((seed + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
            drawn = draw <= np.partition(draw, min(tried, f) - 1, axis=1)[:, min(tried, f) - 1 :][:, :1]
        of = (sa[nodes], sb[nodes], n[nodes])
        cells = min(CELLS, 1 << (FILL * len(at) // m).bit_length())
        if bins.sizes and cells >= max(bins.sizes):
            if joint is None or joint.cells != cells:
                joint = Joint.of(bins, z, cells)
            places = joint.places(at)
            found = _few_nodes(bins, joint, places, held, parts, digits, of, weights, self.min_leaves, drawn)
        else:
            joint = None
            found = [(*_many_nodes(bins, z, at, held, parts, digits, of, weights, x, drawn), None) for x in self.min_leaves]
        alike: dict[tuple, tuple] = {}
        for leaf, (gain, col, cut, lower) in zip(self.min_leaves, found):
            col = np.where(gain > 1e-12 * np.maximum(1.0, sw[nodes]), col, -1)
            cut = np.where(col >= 0, cut, 0)
            alike.setdefault((col.tobytes(), cut.tobytes()), (col, cut, lower, []))[3].append(leaf)
        out = []
        for mine, cuts, lower, leaves in alike.values():
            col, cut = np.full(k, -1), np.zeros(k, dtype=np.int64)
            col[nodes], cut[nodes] = mine, cuts
            split = col >= 0
            kids = np.cumsum(split) * 2 - 2
            done = [*self.done, (col, cut, np.where(split, self.first + k + kids, -1), value, depths)]
            if not split.any():
                out.append(_Growth(leaves, at, z, held, parts, done=done, nodes=0))
                continue
            right = _right_nodes(bins, z, at, mine, cuts) if joint is None else joint.right(bins, places, mine, cuts)
            goes = np.flatnonzero(mine >= 0)
            below = None if lower is None else [np.stack([x[goes], y[goes] - x[goes]], axis=1).ravel() for x, y in zip(lower, of)]
            out.append(_Growth(leaves, np.append(np.where(split, kids, 2 * len(goes))[nodes], 2 * len(goes)).take(at) + right, z, held, parts, digits, joint, below,
                               2 * len(goes), self.first + k, self.depth + 1, done))
        if len(out) == 1 and not out[0].nodes:
            self.done = out[0].done
            return []
        return out


def _right_nodes(bins: Bins, z: np.ndarray, at: np.ndarray, col: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Whether each row goes to the right."""
    c, edge = np.append(col, 0).take(at), np.append(cut, 0).take(at)
    v = z.ravel().take(np.arange(0, z.size, z.shape[1]) + np.maximum(c, 0))
    return np.where(c < bins.cats, v != edge, v > edge)


@dataclass
class Joint:
    """Columns put together as digits of one, of at most ``cells`` values (a column of more is alone)."""

    cells: int
    groups: list[list[int]]  # the columns of each
    sizes: list[int]
    values: list[np.ndarray]  # of the rows
    bins: list[np.ndarray | None]  # whether a value has a bin, value x bins of the columns; None: a column alone
    digits: dict[int, tuple[int, np.ndarray]]  # of each column where it is and its bin in each value

    @classmethod
    def of(cls, bins: Bins, z: np.ndarray, cells: int) -> Joint:
        groups: list[list[int]] = []
        sizes: list[int] = []
        for c in np.argsort([-n for n in bins.sizes], kind="stable").tolist():
            if groups and sizes[-1] * bins.sizes[c] <= cells:
                groups[-1].append(c)
                sizes[-1] *= bins.sizes[c]
            else:
                groups.append([c])
                sizes.append(bins.sizes[c])
        values, held, digit = [], [], {}
        for q, (g, size) in enumerate(zip(groups, sizes)):
            v = z[:, g[0]].astype(np.int64)
            for c in g[1:]:
                v *= bins.sizes[c]
                v += z[:, c]
            values.append(v)
            digits = np.unravel_index(np.arange(size), [bins.sizes[c] for c in g])
            digit.update((c, (q, d)) for c, d in zip(g, digits))
            held.append(np.concatenate([d[:, None] == np.arange(bins.sizes[c]) for c, d in zip(g, digits)], axis=1).astype(np.float64) if len(g) > 1 else None)
        return cls(cells, groups, sizes, values, held, digit)

    def places(self, at: np.ndarray) -> list[np.ndarray]:
        """Of every row, its node and value in one number."""
        return [at * s + v for s, v in zip(self.sizes, self.values)]

    def sums(self, bins: Bins, places: list[np.ndarray], x: np.ndarray, k: int) -> np.ndarray:
        """``x`` by node and bin: all columns side by side, in their order."""
        start = np.cumsum([0, *bins.sizes])
        out = np.empty((k, start[-1]))
        for g, size, place, held in zip(self.groups, self.sizes, places, self.bins):
            s = np.bincount(place, x, k * size)[: k * size].reshape(k, size)
            s, i = s if held is None else s @ held, 0
            for c in g:
                out[:, start[c] : start[c + 1]] = s[:, i : i + bins.sizes[c]]
                i += bins.sizes[c]
        return out


    def right(self, bins: Bins, places: list[np.ndarray], col: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Whether each row goes to the right where nodes are split by ``col`` at ``cut``."""
        tables: dict[int, np.ndarray] = {}
        for c, (q, digit) in self.digits.items():
            nodes = np.flatnonzero(col == c)
            if len(nodes):
                if q not in tables:
                    tables[q] = np.zeros((len(col) + 1, self.sizes[q]), dtype=bool)  # the last one: rows of leaves
                edge = cut[nodes, None]
                tables[q][nodes] = digit != edge if c < bins.cats else digit > edge
        return functools.reduce(np.logical_or, (t.ravel().take(places[q]) for q, t in tables.items()))


def running(bins: Bins, sums: np.ndarray) -> np.ndarray:
    """The sums left of a split at each bin: of the bin itself for categories, up to it for numbers; changed in place."""
    at = np.cumsum([0, *bins.sizes])
    for c in range(bins.cats, len(bins.sizes)):
        np.cumsum(sums[:, at[c] : at[c + 1]], axis=1, out=sums[:, at[c] : at[c + 1]])
    return sums


def _places(bins: Bins) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every column and bin, side by side: the column, the bin, the feature (that of no bin for a last one: -1)."""
    base = np.cumsum([0] + [n - 1 if i < bins.cats else 1 for i, n in enumerate(bins.sizes)])
    col = np.repeat(np.arange(len(bins.sizes)), bins.sizes)
    v = np.concatenate([np.arange(n) for n in bins.sizes])
    feature = np.concatenate([np.append(base[c] + (np.arange(n - 1) if c < bins.cats else np.zeros(n - 1, dtype=np.int64)), -1) for c, n in enumerate(bins.sizes)])
    return col, v, feature.astype(np.int64)


def _few_nodes(bins: Bins, joint: Joint, places: list[np.ndarray], held: list[np.ndarray], parts: int, digits: int, of: tuple, weights: tuple[float, float],
               min_leaves: list[int], drawn: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(gain, column, bin, sums to the left) of the best split of every node, from
    counts of all columns side by side, for each of ``min_leaves``."""
    c0, c1 = weights
    sa, sb, n = (x[:, None] for x in of)
    k = len(sa)
    sums = [running(bins, joint.sums(bins, places, x, k)) for x in held]
    sums = _apart([x.astype(np.int64) for x in sums], parts, digits)
    la, lb, ln = sums[0], sums[1], sums[2] if parts > 2 else sums[0] + sums[1]
    col, v, feature = _places(bins)
    may = (feature >= 0)[None, :] if drawn is None else drawn[:, feature] & (feature >= 0)  # no split off the none bin, none at the last bin
    st, sw = c1 * sb, c0 * sa + c1 * sb
    lt, lw = c1 * lb, c0 * la + c1 * lb
    rt, rw = c1 * (sb - lb), c0 * (sa - la) + c1 * (sb - lb)
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = lt * lt / lw + rt * rt / rw - st * st / np.maximum(sw, 1e-300)
    out = []
    for leaf in min_leaves:
        g = np.where(may & (ln >= leaf) & (n - ln >= leaf), whole, -1.0)
        best = g.argmax(axis=1)
        at = np.arange(k), best
        found = g[at] > -1.0
        out.append((g[at], np.where(found, col[best], -1), np.where(found, v[best], 0), [x[at] for x in sums]))
    return out


def _many_nodes(bins: Bins, z: np.ndarray, at: np.ndarray, held: list[np.ndarray], parts: int, digits: int, of: tuple, weights: tuple[float, float],
                min_leaf: int, drawn: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_few_nodes``, column by column, where a bin holds rows."""
    c0, c1 = weights
    sa, sb, n = of
    k = len(sa)
    col, cut, gain = np.full(k, -1), np.zeros(k, dtype=np.int64), np.full(k, -1.0)
    st, sw = c1 * sb, c0 * sa + c1 * sb
    parent = st * st / np.maximum(sw, 1e-300)
    base = np.cumsum([0] + [n - 1 if i < bins.cats else 1 for i, n in enumerate(bins.sizes)])
    for c, size in enumerate(bins.sizes):
        if size < 2:
            continue
        mine = np.ones(k, dtype=bool) if drawn is None else drawn[:, base[c] : base[c + 1]].any(axis=1)
        nodes = np.flatnonzero(mine)
        if not len(nodes):
            continue
        mine = np.append(mine, False)  # rows of no node
        place, on = np.where(mine, np.cumsum(mine) - 1, len(nodes)) * size, None  # nodes that do not try it come last
        inside = mine[at]
        if np.count_nonzero(inside) < 0.6 * len(at):
            on = np.flatnonzero(inside)
        place = place[at] + z[:, c] if on is None else place[at[on]] + z[on, c]
        sums = [np.bincount(place, x if on is None else x[on], len(nodes) * size)[: len(nodes) * size] for x in held]
        e = np.flatnonzero(sums[0] if len(sums) == 1 else sums[0] + sums[1])  # nodes and bins with rows; every node has some
        of_ = e // size
        v = e - of_ * size
        sums = [x[e].astype(np.int64) for x in sums]
        if c >= bins.cats:
            start = _starts(of_)
            before = [np.cumsum(x) - x for x in sums]
            sums = [x + y - y[start][of_] for x, y in zip(sums, before)]
        sums = _apart(sums, parts, digits)
        node = nodes[of_]
        ln = sums[2] if parts > 2 else sums[0] + sums[1]
        ok = (ln >= min_leaf) & (n[node] - ln >= min_leaf) & (v < size - 1)  # no split off the none bin, none at the last bin
        if drawn is not None and c < bins.cats:
            ok &= drawn[node, base[c] + np.minimum(v, size - 2)]
        ok = np.flatnonzero(ok)
        if not len(ok):
            continue
        node, v, la, lb = node[ok], v[ok], sums[0][ok], sums[1][ok]
        lt, lw = c1 * lb, c0 * la + c1 * lb
        rt, rw = c1 * (sb[node] - lb), c0 * (sa[node] - la) + c1 * (sb[node] - lb)
        g = lt * lt / lw + rt * rt / rw - parent[node]
        start = _starts(node)
        top = np.maximum.reduceat(g, start)
        hit = np.flatnonzero(g == np.repeat(top, np.diff(np.append(start, len(g)))))
        hit = hit[_starts(node[hit])]  # the first best of every node
        hit = hit[top > gain[node[start]]]
        gain[node[hit]], col[node[hit]], cut[node[hit]] = g[hit], c, v[hit]
    return gain, col, cut


def _apart(sums: list[np.ndarray], parts: int, digits: int) -> list[np.ndarray]:
    """The whole numbers that were added up as binary digits of one."""
    return [sums[0] >> i * digits & (1 << digits) - 1 for i in range(parts)] if digits else sums


def _starts(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    new = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return np.flatnonzero(new)


def forest_probabilities(bins: Bins, y: np.ndarray, weight: np.ndarray, tags: np.ndarray, train: np.ndarray, test: np.ndarray,
                         trees: list[int], depths: list[int | None], min_leaf: int, seed: int) -> dict[tuple[int, int | None], np.ndarray]:
    """P(1) of the ``test`` rows by forests of the first ``trees`` trees cut at ``depths``: mean share of the leaves."""
    tried = max(1, int(np.sqrt(bins.features())))
    to = Bins(bins.z[test], bins.sizes, bins.cats)
    deepest = None if None in depths else max(depths)
    sums = {d: np.zeros(len(test)) for d in depths}
    out = {}
    for i in range(max(trees)):
        times = bag(tags[train], i, seed)
        rows = train[times > 0]
        full = np.zeros(len(y))
        full[train] = times
        tree = grow(bins, y, weight * full, rows, deepest, min_leaf, tried, seed * 7919 + i)
        for d in depths:
            sums[d] += tree.value[tree.leaves(to, d)]
        if i + 1 in trees:
            out.update({(i + 1, d): sums[d] / (i + 1) for d in depths})
    return out


def boosted_probabilities(bins: Bins, y: np.ndarray, train: np.ndarray, test: np.ndarray, trees: list[int], rate: float, depth: int,
                          min_leaf: int = 1) -> dict[int, np.ndarray]:
    """P(1) of the ``test`` rows by gradient boosting on the logistic loss
    (Friedman 2001): trees fitted to the residuals by squared error, leaf
    values by one Newton step, from the prior log-odds."""
    to = Bins(bins.z[test], bins.sizes, bins.cats)
    prior = np.clip(y[train].mean() if len(train) else 0.5, 1e-9, 1 - 1e-9)
    f = np.full(len(y), np.log(prior / (1 - prior)))
    g = np.full(len(test), f[0] if len(f) else 0.0)
    one = np.ones(len(y))
    out = {}
    whole = Bins(bins.z[train], bins.sizes, bins.cats)
    for i in range(max(trees)):
        p = 1.0 / (1.0 + np.exp(-f))
        tree = grow(bins, y - p, one, train, depth, min_leaf, gini=False)
        leaf = tree.leaves(whole)
        r = (y - p)[train]
        num = np.bincount(leaf, r, len(tree.value))
        den = np.bincount(leaf, (p * (1 - p))[train], len(tree.value))
        step = np.where(den > 1e-150, num / np.maximum(den, 1e-150), 0.0)
        f[train] += rate * step[leaf]
        g += rate * step[tree.leaves(to)]
        if i + 1 in trees:
            out[i + 1] = 1.0 / (1.0 + np.exp(-g))
    return out


TIMES = np.diff(np.concatenate([[0.0], POISSON, [1.0]]))  # how likely a row is 0, 1, ... 8 times in a bag


def forest_sums(bins: Bins, zeros: np.ndarray, ones: np.ndarray, weights: tuple[float, float], train: np.ndarray, test: np.ndarray,
                wanted: list[tuple[int, int | None, int]], seed: int, part: int = 0, parts: int = 1) -> dict[tuple[int, int | None, int], np.ndarray]:
    """As ``forest_probabilities`` for equal rows put together, ``zeros`` and
    ``ones`` of each class: sums over every ``parts``-th tree for the (trees,
    depth, least rows of a leaf) that are wanted.  Each row is drawn by itself:
    how many of n rows are 0, 1, ... times in the bag is multinomial; forests
    that differ in their leaves have the same bags, drawn once."""
    tried = max(1, int(np.sqrt(bins.features())))
    bins = Bins(bins.z.astype(np.min_scalar_type(max(bins.sizes))), bins.sizes, bins.cats) if bins.sizes else bins
    to = Bins(bins.z[test], bins.sizes, bins.cats)
    sums = {w: np.zeros(len(test)) for w in wanted}
    place = np.arange(len(TIMES), dtype=np.float64)
    held = [(r, c[r]) for c in (zeros, ones) for r in (train[c[train] > 0],)]
    for i in range(part, max(w[0] for w in wanted), parts):
        rng = np.random.default_rng([seed, i])
        a, b, many = (np.zeros(len(zeros), dtype=np.int64) for _ in range(3))
        for into, (r, c) in zip((a, b), held):
            drawn = rng.multinomial(c, TIMES)
            into[r] = drawn.astype(np.float64) @ place  # whole numbers, by BLAS
            many[r] += c - drawn[:, 0]
        deep: dict[int | None, list[int]] = {}  # least rows of a leaf, by the depth that is wanted with them
        for leaf in sorted({w[2] for w in wanted if i < w[0]}):
            most = max((w[1] for w in wanted if i < w[0] and w[2] == leaf), key=lambda d: (d is None, d or 0))
            deep.setdefault(most, []).append(leaf)
        for leaf, tree in (x for most, leaves in deep.items()
                           for x in grow_alike(bins, a, b, many, weights, np.flatnonzero(many), most, leaves, tried, seed * 7919 + i).items()):
            mine = [w for w in wanted if i < w[0] and w[2] == leaf]
            depths = sorted({w[1] for w in mine}, key=lambda d: (d is None, d or 0))
            at = None
            for d in depths:
                at = tree.leaves(to, d, at)
                v = tree.value[at]
                for w in mine:
                    if w[1] == d:
                        sums[w] += v
    return sums


def boosted_groups(bins: Bins, zeros: np.ndarray, ones: np.ndarray, train: np.ndarray, test: np.ndarray, trees: list[int], rate: float, depth: int,
                   min_leaf: int = 1) -> dict[int, np.ndarray]:
    """As ``boosted_probabilities`` for equal rows put together.  All rows go
    down each tree while it grows; those without training rows count nothing.
    Several columns are added up at once, and how many rows a node has in each
    bin once for all trees that come to the same node."""
    n = np.zeros(len(zeros))
    n[train] = zeros[train] + ones[train]
    ones = np.where(n > 0, ones, 0).astype(np.float64)
    prior = np.clip(ones.sum() / n.sum(), 1e-9, 1 - 1e-9)
    f = np.full(len(n), np.log(prior / (1 - prior)))
    joint = Joint.of(bins, bins.z, CELLS)
    col, bin_, feature = _places(bins) if bins.sizes else (np.zeros(0, dtype=np.int64),) * 3
    known: dict[tuple, np.ndarray] = {}
    out = {}
    for i in range(max(trees)):
        p = 1.0 / (1.0 + np.exp(-f))
        np_ = n * p
        r = ones - np_
        at = np.zeros(len(n), dtype=np.int64)
        nodes: list[tuple | None] = [()]  # the way to each node; None: it is a leaf
        for level in range(depth):
            k = len(nodes)
            if not bins.sizes or not any(x is not None for x in nodes):
                break
            places = joint.places(at)
            if any(x is not None and x not in known for x in nodes):
                counts = running(bins, joint.sums(bins, places, n, k))
                known.update((x, counts[j].copy()) for j, x in enumerate(nodes) if x is not None)
            lt = running(bins, joint.sums(bins, places, r, k))
            none = np.zeros(len(col))
            lw = np.stack([none if x is None else known[x] for x in nodes])
            last = len(col) - 1  # all rows of a node are in any column: the sums of the last, up to its end
            whole = slice(last + 1 - bins.sizes[-1], last + 1)
            st, sw = (x[:, whole].sum(axis=1) if len(bins.sizes) <= bins.cats else x[:, last] for x in (lt, lw))
            rw, rt = sw[:, None] - lw, st[:, None] - lt
            with np.errstate(divide="ignore", invalid="ignore"):
                g = lt * lt / lw + rt * rt / rw - (st * st / np.maximum(sw, 1e-300))[:, None]
            ok = (lw >= min_leaf) & (rw >= min_leaf) & (feature >= 0) & np.array([x is not None for x in nodes])[:, None]
            g = np.where(ok, g, -1.0)
            best = g.argmax(axis=1)
            split = (g[np.arange(k), best] > 1e-12 * np.maximum(1.0, sw)) & (sw >= 2 * min_leaf)
            kids: list[tuple | None] = []
            base = np.zeros(k, dtype=np.int64)
            way = np.where(split, best, 0)
            for j, x in enumerate(nodes):
                base[j] = len(kids)
                c, v = int(col[way[j]]), int(bin_[way[j]])
                kids += [(*x, (c, v, 0)), (*x, (c, v, 1))] if split[j] else [None]
            if split.any():
                at = base.take(at) + joint.right(bins, places, np.where(split, col[way], -1), bin_[way])
            else:
                break
            nodes = kids
        num, den = np.bincount(at, r, len(nodes)), np.bincount(at, np_ * (1 - p), len(nodes))
        step = np.where(den > 1e-150, num / np.maximum(den, 1e-150), 0.0)
        f += (rate * step).take(at)
        if i + 1 in trees:
            out[i + 1] = 1.0 / (1.0 + np.exp(-f[test]))
    return out


CELL = 512  # training rows of a cell


def cells(x: np.ndarray, most: int) -> list[np.ndarray]:
    """The rows of ``x`` in cells of at most ``most`` near ones (more only where they are equal), cut at wide gaps."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most or not x.shape[1]:
            out.append(rows)
            continue
        some = np.sort(x[rows[:: max(1, len(rows) // 1024)]], axis=0)
        middle, place = some[len(some) // 2], np.arange(x.shape[1])
        above, below = (some <= middle).sum(axis=0), (some < middle).sum(axis=0)
        up = above < len(some)  # else the middle is the largest value, and the cut is below it
        low = np.where(up, middle, some[np.maximum(below - 1, 0), place])
        high = np.where(up, some[np.minimum(above, len(some) - 1), place], middle)
        score = np.where(high > low, high - low + 0.1 * (some[-1] - some[0]), 0.0)
        c = int(score.argmax())
        cut = low[c]
        if score[c] <= 0:  # equal in the rows looked at
            wide = np.ptp(x[rows], axis=0)
            c = int(wide.argmax())
            cut = x[rows, c].min() + wide[c] / 2
        left = x[rows, c] <= cut
        if left.all() or not left.any():
            out.append(rows)
        else:
            todo += [rows[~left], rows[left]]
    return out


def nearest(b: np.ndarray, q: np.ndarray, most: int, tile: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Exact: by tiles of rows of ``q``, all rows of ``b`` that are no farther
    than the ``most``-th nearest: (the tile's rows, row in the tile, row of
    ``b``, squared distance).  Cells of ``b`` are taken nearest first, until
    the box of the next one is too far for every row."""
    parts = cells(b, CELL)
    low, high = (np.array([f(b[p], axis=0) for p in parts]) for f in (np.min, np.max))
    norm = (b * b).sum(1)
    for at in (mine[i : i + tile] for mine in cells(q, tile) for i in range(0, len(mine), tile)):
        t = q[at]
        own = (t * t).sum(1)
        slack = 2e-9 + 1e-13 * (own.max() + norm.max())
        apart = np.maximum(np.maximum(low - t.max(0), t.min(0) - high), 0.0)
        apart = (apart * apart).sum(1)
        turn = np.argsort(apart, kind="stable")
        best = np.full((len(t), most), np.inf)
        found, j, wanted = [], 0, max(CELL, 2 * most)
        while j < len(turn) and apart[turn[j]] <= best.max() + slack:
            first, n = j, 0
            while j < len(turn) and n < wanted:
                n += len(parts[turn[j]])
                j += 1
            box, wanted = turn[first:j], min(2 * wanted, 8192)
            gap = np.maximum(np.maximum(low[box] - t[:, None], t[:, None] - high[box]), 0.0)
            near = np.flatnonzero(((gap * gap).sum(2) <= best.max(1)[:, None] + slack).any(1))
            if not len(near):
                continue
            some = np.concatenate([parts[c] for c in box])
            # equal distances must tie: rounding of the product is cut off
            d = np.round(np.maximum(own[near, None] + norm[some] - 2.0 * (t[near] @ b[some].T), 0.0), 9)
            best[near] = np.partition(np.concatenate([best[near], d], axis=1), most - 1, axis=1)[:, :most]
            r, c = np.nonzero(d <= best[near].max(1)[:, None])
            found.append((near[r], some[c], d[r, c]))
        row, col, d = (np.concatenate(x) for x in zip(*found))
        ok = d <= best.max(1)[row]
        yield at, row[ok], col[ok], d[ok]


def neighbour_probabilities(x: np.ndarray, y: np.ndarray, train: np.ndarray, test: np.ndarray, wanted: list[tuple[int, str]],
                            voters: tuple[np.ndarray, ...] | None = None) -> dict[tuple[int, str], np.ndarray]:
    """P(1) by the vote of the k nearest training rows (Euclidean; ties to the
    earlier row); neighbours at distance zero, if any, vote alone under
    'distance'.  ``voters``, where equal rows are put together: for every
    training row the first and the number of its voters, and of each voter the
    key, for ties, and the class."""
    first, many, keys, classes = voters or (np.arange(len(train)), np.ones(len(train), dtype=np.int64), np.arange(len(train)), y[train])
    most = max(k for k, _ in wanted)
    out = {w: np.zeros(len(test)) for w in wanted}
    for at, row, col, d in nearest(x[train], x[test], min(most, len(train))):
        n = many[col]
        each = np.repeat(np.arange(len(col)), n)
        voter = first[col][each] + np.arange(len(each)) - (np.cumsum(n) - n)[each]
        order = np.lexsort((keys[voter], d[each], row[each]))
        of = row[each][order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        k_all = min(most, int(many.sum()))
        pick = order[rank < k_all]
        dist = np.sqrt(d[each][pick]).reshape(len(at), k_all)
        vote = classes[voter[pick]].astype(np.float64).reshape(len(at), k_all)
        for k, how in wanted:
            v, s = vote[:, : min(k, k_all)], dist[:, : min(k, k_all)]
            if how == "distance":
                zero = s == 0
                with np.errstate(divide="ignore"):
                    w = np.where(zero.any(1)[:, None], zero.astype(np.float64), 1.0 / np.where(zero, 1.0, s))
            else:
                w = np.ones_like(s)
            out[(k, how)][at] = (w * v).sum(1) / w.sum(1)
    return out
