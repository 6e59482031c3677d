"""Fits of one split in a task: trees, forests, boosting, k-NN.

An encoded table of a few rows is copied to a few blocks (rows times
blocks, by a shuffle; the driver never holds it) and every task fits the units
of its block: a unit is a split with all candidates that share its growth, so
a forest of 200 trees of any depth also answers for 100 trees and for depth
five.  Of a larger table the trees see equal rows as one with their counts
(``Encoded.groups``), as long as these fit in a task (``groups_fit``), and
k-NN also with the few rows of each that may vote (``neighbours_fit``); forests
are then dealt by their trees, k-NN by its test rows.  Otherwise rows are copied
up to ``TASK_BYTES``, and beyond the caller uses the distributed fits of ``pyspark.ml``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earlywarn.operators import forest
from earlywarn.operators.linear_fits import COUNTS, counts_batch, outcomes
from earlywarn.operators.splits import (BLOB_ROWS, GROUPS, HELD_ROWS, TEST, TRAIN, Encoded, Groups, Plan, alike, arrays, collapse, counted,
                                        packed, same_rows, unpacked)

TASK_BYTES = 64 << 20  # of the arrays of one task
FEW_BYTES = 8 << 20  # up to here the rows themselves are copied to the tasks; beyond, equal ones as one are dealt finer
SEED = 42
Task = tuple[int, str, dict]  # split, model, parameters


def _row_bytes(enc: Encoded) -> int:
    return enc.rows * (8 * (len(enc.plan.cats) + len(enc.plan.nums) + 4) + len(enc.plan.rows))


def fits_in_a_task(enc: Encoded) -> bool:
    return _row_bytes(enc) <= TASK_BYTES


def few_rows(enc: Encoded) -> bool:
    return fits_in_a_task(enc) and _row_bytes(enc) <= FEW_BYTES


def groups_fit(enc: Encoded) -> bool:
    """Whether the groups of equal rows fit in a task."""
    per_group = 8 * (len(enc.plan.cats) + len(enc.plan.nums) + 4)
    return TASK_BYTES > 0 and enc.kinds * per_group <= TASK_BYTES


def _bins(plan: Plan, s: int, codes: np.ndarray, nums: np.ndarray) -> forest.Bins:
    codes, nums = plan.filled(s, codes, nums)
    cols, sizes = [], []
    for i in range(len(plan.cats)):
        n = plan.offset[i + 1] - plan.offset[i]
        cols.append(np.where(codes[:, i] < 0, n, codes[:, i] - plan.offset[i]))
        sizes.append(n + 1)
    for j, edges in enumerate(plan.edges):
        cols.append(np.searchsorted(edges, nums[:, j], side="left"))
        sizes.append(len(edges) + 1)
    z = np.stack(cols, axis=1) if cols else np.zeros((len(codes), 0), dtype=np.int64)
    return forest.Bins(z, sizes, len(plan.cats))


def _unit(task: Task) -> tuple:
    """What a task's growth depends on; tasks of one unit share it."""
    s, name, p = task
    if name in ("Decision Tree", "Random Forest"):
        return s, name, int(p.get("min_samples_leaf", 1))
    if name == "Gradient Boosting":
        return s, name, float(p.get("learning_rate", 0.1)), int(p.get("max_depth", 3)), int(p.get("min_samples_leaf", 1))
    return s, name


def _fit_unit(plan: Plan, unit: tuple, tasks: list[tuple[int, Task]], data) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(task, test rows, their P(1)) for the tasks of a unit."""
    key, y, tag, role, codes, nums = data
    s, name = unit[:2]
    train, test = np.flatnonzero(role[:, s] == TRAIN), np.flatnonzero(role[:, s] == TEST)
    if not len(test):
        return
    if not len(train):
        for i, _ in tasks:
            yield i, test, np.zeros(len(test))
        return
    if name == "KNN":
        wanted = [(int(p.get("n_neighbors", 5)), p.get("weights", "uniform")) for _, (_, _, p) in tasks]
        x = plan.design(s, codes, nums)
        got = forest.neighbour_probabilities(x, y, train, test, sorted(set(wanted)))
        for (i, _), w in zip(tasks, wanted):
            yield i, test, got[w]
        return
    bins = _bins(plan, s, codes, nums)
    n = plan.rows[s].sum()
    weight = np.where(y == 1, n / (2.0 * max(1, plan.rows[s, 1])), n / (2.0 * max(1, plan.rows[s, 0])))
    depth = lambda p: None if p.get("max_depth") is None else int(p["max_depth"])
    if name == "Decision Tree":
        depths = [depth(p) for _, (_, _, p) in tasks]
        tree = forest.grow(bins, y, weight, train, None if None in depths else max(depths), unit[2])
        to = forest.Bins(bins.z[test], bins.sizes, bins.cats)
        for (i, _), d in zip(tasks, depths):
            yield i, test, tree.value[tree.leaves(to, d)]
    elif name == "Random Forest":
        wanted = [(int(p.get("n_estimators", 100)), depth(p)) for _, (_, _, p) in tasks]
        got = forest.forest_probabilities(bins, y, weight, tag, train, test, sorted({t for t, _ in wanted}),
                                          sorted({d for _, d in wanted}, key=lambda d: (d is None, d or 0)), unit[2], SEED)
        for (i, _), w in zip(tasks, wanted):
            yield i, test, got[w]
    elif name == "Gradient Boosting":
        wanted = [int(p.get("n_estimators", 100)) for _, (_, _, p) in tasks]
        got = forest.boosted_probabilities(bins, y, train, test, sorted(set(wanted)), *unit[2:])
        for (i, _), w in zip(tasks, wanted):
            yield i, test, got[w]
    else:
        raise ValueError(f"no fit in a task for {name!r}")


def predict(enc: Encoded, tasks: Sequence[Task]) -> DataFrame:
    """(problem, key, y_true, y_pred, y_prob) of the test rows of every task."""
    if not fits_in_a_task(enc):
        raise ValueError("the table is too large for one task")
    units: dict[tuple, list[tuple[int, Task]]] = {}
    for i, t in enumerate(tasks):
        units.setdefault(_unit(t), []).append((i, t))
    # dear units first, dealt round the blocks
    dear = {"Random Forest": 0, "Gradient Boosting": 1}
    order = sorted(units, key=lambda u: (dear.get(u[1], 2), str(u)))
    blocks = max(1, min(len(order), 4 * enc.table.sparkSession.sparkContext.defaultParallelism))
    plan = enc.plan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            block = batch.column(6).to_numpy()
            for b in np.unique(block).tolist():
                mine = batch.filter(pa.array(block == b))
                held.setdefault(b, []).append(arrays(mine, plan))
        for b in sorted(held):
            parts = held.pop(b)
            key = pa.chunked_array([p[0] for p in parts]).combine_chunks()
            data = [key, *[np.concatenate([p[i] for p in parts]) for i in range(1, 6)]]
            at = pc.sort_indices(key).to_numpy()  # the same order of rows whatever the partitions were
            data = [key.take(pa.array(at)), *[x[at] for x in data[1:]]]
            for u in order[b::blocks]:
                for i, test, prob in _fit_unit(plan, u, units[u], data):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(test), i, dtype=np.int32)), data[0].take(pa.array(test)), pa.array(data[1][test].astype(np.int32)),
                         pa.array((prob > 0.5).astype(np.int32)), pa.array(prob)], ["problem", "key", "y_true", "y_pred", "y_prob"])

    copies = enc.table.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kind = enc.table.schema["key"].dataType.simpleString()
    return copies.repartitionByRange(blocks, "block").mapInArrow(run, f"problem int, key {kind}, y_true int, y_pred int, y_prob double")


GROWN = ("Decision Tree", "Random Forest", "Gradient Boosting")  # fits that read groups


def _depth(p: dict) -> int | None:
    return None if p.get("max_depth") is None else int(p["max_depth"])


def _fit_groups(plan: Plan, unit: tuple, part: int, parts: int, tasks: list[tuple[int, Task]], g: Groups,
                on_train: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(task, P(1) of the groups with test rows) for the tasks of a unit; of a
    forest in parts the sums over the part's trees.  ``on_train``: of those with training rows."""
    s, name = unit[:2]
    zeros, ones = g.n[:, 0, 0].astype(np.int64), g.n[:, 0, 1].astype(np.int64)
    train = np.flatnonzero(zeros + ones)
    test = train if on_train else np.flatnonzero(g.n[:, 0, 2] + g.n[:, 0, 3])
    if not len(test):
        return
    if not len(train):
        for i, _ in tasks:
            yield i, np.zeros(len(test))
        return
    bins = _bins(plan, s, g.codes, g.nums)
    n = plan.rows[s].sum()
    weights = tuple(n / (2.0 * max(1, plan.rows[s, c])) for c in (0, 1))
    if name == "Decision Tree":
        depths = [_depth(p) for _, (_, _, p) in tasks]
        weight = zeros * weights[0] + ones * weights[1]
        target = ones * weights[1] / np.maximum(weight, 1e-300)
        tree = forest.grow(bins, target, weight, train, None if None in depths else max(depths), unit[2], count=zeros + ones)
        to = forest.Bins(bins.z[test], bins.sizes, bins.cats)
        for (i, _), d in zip(tasks, depths):
            yield i, tree.value[tree.leaves(to, d)]
        return
    if name == "Random Forest":
        wanted = [(int(p.get("n_estimators", 100)), _depth(p), int(p.get("min_samples_leaf", 1))) for _, (_, _, p) in tasks]
        got = forest.forest_sums(bins, zeros, ones, weights, train, test, sorted(set(wanted), key=str), SEED, part, parts)
    else:
        wanted = [int(p.get("n_estimators", 100)) for _, (_, _, p) in tasks]
        got = forest.boosted_groups(bins, zeros, ones, train, test, sorted(set(wanted)), *unit[2:])
    for (i, _), w in zip(tasks, wanted):
        yield i, got[w]


def _result(i: int, s: int, prob: np.ndarray, g: Groups, counts: bool) -> pa.RecordBatch:
    """The rows of task ``i``, on split ``s``: ``prob`` is P(1) of the groups of ``g`` with test rows."""
    test = np.flatnonzero(g.n[:, 0, 2] + g.n[:, 0, 3])
    if counts:
        return counts_batch([outcomes(i, g.n[test, 0, 2:], (prob > 0.5).astype(np.int64))])
    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(test) + 1, dtype=np.int32) * m.shape[1]), pa.array(m[test].ravel(), t))
             for m, t in ((g.codes, pa.int32()), (g.nums, pa.float64()))]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(test), x, dtype=np.int32)) for x in (i, s)] + [*lists, pa.array(prob)],
                                      ["problem", "split", "codes", "nums", "y_prob"])


PROBABILITIES = "problem int, split int, codes array<int>, nums array<double>, y_prob double"


def from_groups(enc: Encoded, tasks: Sequence[Task], counts: bool, on_train: bool = False) -> DataFrame:
    """Trees, forests and boosting on groups of equal rows.  ``counts``:
    (problem, tn, fp, fn, tp) to be added up by problem; else (problem, split,
    codes, nums, y_prob) of the groups with test rows in the task's split.
    ``on_train``: the training rows are those predicted."""
    cores = enc.table.sparkSession.sparkContext.defaultParallelism
    units: dict[tuple, list[tuple[int, Task]]] = {}
    for i, t in enumerate(tasks):
        u = _unit(t)
        units.setdefault(u[:2] if t[1] == "Random Forest" else u, []).append((i, t))  # forests of one split draw the same bags
    # a forest is dealt by its trees where there are fewer units than cores
    parts = {u: max(1, min(25, -(-6 * cores // len(units)))) if u[1] == "Random Forest" else 1 for u in units}
    dear = {"Random Forest": 0, "Gradient Boosting": 1}
    splits = sorted({u[0] for u in units})
    blocks: list[list[tuple[tuple, int]]] = []  # the (unit, part) of each block, all of one split
    of_split: dict[int, list[int]] = {}
    for s in splits:
        jobs = [(u, p) for u in sorted((u for u in units if u[0] == s), key=lambda u: (dear.get(u[1], 2), str(u))) for p in range(parts[u])]
        k = max(1, min(len(jobs), -(-4 * cores // len(splits))))
        of_split[s] = list(range(len(blocks), len(blocks) + k))
        blocks += [jobs[b::k] for b in range(k)]
    plan = enc.plan
    trees = [float(t[2].get("n_estimators", 100)) if t[1] == "Random Forest" else 1.0 for t in tasks]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in (g for batch in batches for g in unpacked(batch, plan)):
            for s in splits:
                mine = np.flatnonzero(g.n[:, s].any(axis=1))
                if len(mine):
                    one = packed(Groups(g.codes[mine], g.nums[mine], g.n[mine, s : s + 1]))
                    for b in of_split[s]:
                        yield pa.RecordBatch.from_arrays([*one.columns, pa.array([b], pa.int32())], [*one.schema.names, "block"])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Groups]]:
        """(block, its groups in a fixed order)"""
        got: dict[int, list[Groups]] = {}
        for batch in batches:
            for i, b in enumerate(batch.column(4).to_pylist()):
                rows = batch.column(0)[i].as_py()
                codes, nums, n = (np.frombuffer(batch.column(j)[i].as_buffer(), t) for j, t in ((1, np.int32), (2, np.float64), (3, np.int32)))
                got.setdefault(b, []).append(Groups(codes.reshape(rows, len(plan.cats)).astype(np.int64), nums.reshape(rows, len(plan.nums)), n.reshape(rows, 1, 4)))
        for b in sorted(got):
            g = got.pop(b)
            codes, nums, n = (np.concatenate([getattr(x, a) for x in g]) for a in ("codes", "nums", "n"))
            at = same_rows(codes, nums)[0]
            yield b, Groups(codes[at], nums[at], n[at])

    def predicted(g: Groups) -> Groups:
        """The rows that get predictions as test rows."""
        return Groups(g.codes, g.nums, g.n[:, :, [2, 3, 0, 1]]) if on_train else g

    whole = max(parts.values()) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, g in held(batches):
            for u, part in blocks[b]:
                for i, prob in _fit_groups(plan, u, part, parts[u], units[u], g, on_train):
                    if whole:
                        yield _result(i, tasks[i][0], prob / trees[i], predicted(g), counts)
                    else:  # the first part brings the groups along
                        rest = packed(predicted(g)).columns if part == 0 else [pa.nulls(1, t) for t in (pa.int32(), *[pa.binary()] * 3)]
                        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([prob.tobytes()], pa.binary()), *rest],
                                                         ["problem", "sums", "rows", "codes", "nums", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        of: dict[int, Groups] = {}
        for batch in batches:
            for j, i in enumerate(batch.column(0).to_pylist()):
                v = np.frombuffer(batch.column(1)[j].as_buffer(), np.float64)
                sums[i] = sums[i] + v if i in sums else v.copy()
                rows = batch.column(2)[j].as_py()
                if rows is not None:
                    codes, nums, n = (np.frombuffer(batch.column(c)[j].as_buffer(), t).copy() for c, t in ((3, np.int32), (4, np.float64), (5, np.int32)))
                    of[i] = Groups(codes.reshape(rows, len(plan.cats)), nums.reshape(rows, len(plan.nums)), n.reshape(rows, 1, 4))
        for i in sorted(sums):
            yield _result(i, tasks[i][0], sums[i] / trees[i], of[i], counts)

    schema = COUNTS if counts else PROBABILITIES
    dealt = enc.groups.mapInArrow(deal, GROUPS + ", block int").repartitionById(len(blocks), F.col("block"))
    if whole:
        return dealt.mapInArrow(run, schema)
    some = dealt.mapInArrow(run, "problem int, sums binary, " + GROUPS)
    return some.repartition(min(len(tasks), cores), "problem").mapInArrow(add, schema)


def _most(tasks: Sequence[Task]) -> int:
    return max(int(p.get("n_neighbors", 5)) for _, _, p in tasks)


def neighbours_fit(enc: Encoded, tasks: Sequence[Task]) -> bool:
    """Whether the groups of equal rows, as features and with their voters, fit in a task."""
    per_group = 8 * (enc.plan.width + len(enc.plan.cats) + len(enc.plan.nums) + 4) + 9 * _most(tasks)
    whole = enc.table.schema["key"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return whole and TASK_BYTES > 0 and enc.kinds * per_group <= 4 * TASK_BYTES


def _voters(rows: list[tuple[np.ndarray, ...]], splits: Sequence[int], most: int) -> tuple[np.ndarray, ...]:
    """(codes, nums, role, key, y) by group and key: of every group its first row
    and those that are among the ``most`` first training rows of a split."""
    codes, nums, role, key, y = (np.concatenate(c) for c in zip(*rows))
    group = same_rows(codes, nums)[1]
    order = np.lexsort((y, key, group))
    group = group[order]
    start = np.searchsorted(group, group)
    keep = start == np.arange(len(group))
    for s in splits:
        mine = role[order, s] == TRAIN
        before = np.cumsum(mine) - mine
        keep |= mine & (before - before[start] < most)
    return tuple(x[order[keep]] for x in (codes, nums, role, key, y))


def from_neighbours(enc: Encoded, tasks: Sequence[Task], counts: bool) -> DataFrame:
    """k-NN on groups of equal rows, with results as of ``from_groups``.  Of
    equal training rows only the first k, by key, can be among the k nearest of
    any row, so a group carries no more; every task has the training groups of
    one split and a share of its test groups."""
    cores = enc.table.sparkSession.sparkContext.defaultParallelism
    splits = sorted({t[0] for t in tasks})
    shares = max(1, -(-2 * cores // len(splits)))
    most, plan = _most(tasks), enc.plan
    wanted = {s: [(i, (int(p.get("n_neighbors", 5)), p.get("weights", "uniform"))) for i, (f, _, p) in enumerate(tasks) if f == s] for s in splits}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Groups] = []
        rows: list[tuple[np.ndarray, ...]] = []
        grown = 0
        for batch in batches:
            if not len(batch):
                continue
            key, y, _, role, codes, nums = arrays(batch, plan)
            held.append(counted(y, role, codes, nums))
            rows.append((codes, nums, role, pc.fill_null(key.cast(pa.int64()), np.iinfo(np.int64).max).to_numpy(), y.astype(np.int8)))
            if sum(len(r[0]) for r in rows) > max(HELD_ROWS, 2 * grown):
                held, rows = [collapse(held)], [_voters(rows, splits, most)]
                grown = len(rows[0][0])
        if not held:
            return
        g = collapse(held)
        codes, nums, role, key, y = _voters(rows, splits, most)
        group = same_rows(codes, nums)[1]  # numbered as the groups of g: all of them are here
        start = np.searchsorted(group, group)
        for n, s in enumerate(splits):
            votes = role[:, s] == TRAIN
            before = np.cumsum(votes) - votes
            votes &= before - before[start] < most
            many = np.bincount(group[votes], minlength=len(g.codes)).astype(np.int32)
            mine = np.flatnonzero(g.n[:, s].any(axis=1))
            for i in range(0, len(mine), BLOB_ROWS):
                some = mine[i : i + BLOB_ROWS]
                theirs = np.flatnonzero(votes & np.isin(group, some))
                one = packed(Groups(g.codes[some], g.nums[some], g.n[some, s : s + 1]))
                more = [pa.array([x.tobytes()], pa.binary()) for x in (many[some], key[theirs], y[theirs])]
                for b in range(n * shares, (n + 1) * shares):
                    yield pa.RecordBatch.from_arrays([*one.columns, *more, pa.array([b], pa.int32())],
                                                     [*one.schema.names, "many", "keys", "classes", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (np.int32, np.float64, np.int32, np.int32, np.int64, np.int8)
        held: dict[int, list[list[np.ndarray]]] = {}
        for batch in batches:
            for i, b in enumerate(batch.column(7).to_pylist()):
                held.setdefault(b, []).append([np.frombuffer(batch.column(j + 1)[i].as_buffer(), t).copy() for j, t in enumerate(types)])
        for b in sorted(held):
            blobs = held.pop(b)
            codes, nums, n, many, keys, classes = (np.concatenate(c) for c in zip(*blobs))
            codes, nums, n = codes.reshape(len(many), len(plan.cats)).astype(np.int64), nums.reshape(len(many), len(plan.nums)), n.reshape(len(many), 1, 4)
            at = same_rows(codes, nums)[0]
            first, many = (np.cumsum(many, dtype=np.int64) - many)[at], many[at].astype(np.int64)
            g = Groups(codes[at], nums[at], n[at])
            s = splits[b // shares]
            train = np.flatnonzero(many)
            test = np.array_split(np.flatnonzero(g.n[:, 0, 2] + g.n[:, 0, 3]), shares)[b % shares]
            if not len(test):
                continue
            mine = Groups(g.codes[test], g.nums[test], g.n[test])
            got = {w: np.zeros(len(test)) for _, w in wanted[s]}
            if len(train):
                got = forest.neighbour_probabilities(plan.design(s, g.codes, g.nums), None, train, test, sorted(set(got)),
                                                     (first[train], many[train], keys, classes))
            for i, w in wanted[s]:
                yield _result(i, s, got[w], mine, counts)

    dealt = alike(enc).mapInArrow(deal, GROUPS + ", many binary, keys binary, classes binary, block int")
    return dealt.repartitionById(len(splits) * shares, F.col("block")).mapInArrow(run, COUNTS if counts else PROBABILITIES)


def predict_groups(enc: Encoded, tasks: Sequence[Task]) -> DataFrame:
    """(problem, key, y_true, y_pred, y_prob) of the test rows of every task, from fits on groups."""
    prob = (from_neighbours if tasks[0][1] == "KNN" else from_groups)(enc, tasks, counts=False)
    splits = sorted({t[0] for t in tasks})
    tested = F.filter(F.array(*[F.lit(s) for s in splits]), lambda s: F.element_at("role", s + 1) == TEST)
    rows = enc.table.select("key", "y", "codes", "nums", F.explode(tested).alias("split"))
    return rows.join(prob, ["split", "codes", "nums"]).select(
        "problem", "key", F.col("y").cast("int").alias("y_true"), (F.col("y_prob") > 0.5).cast("int").alias("y_pred"), "y_prob")


def design_rows(enc: Encoded, s: int) -> DataFrame:
    """(key, y, role, weight, x) of the rows of split ``s``: its features and balanced weights."""
    plan = enc.plan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, y, _, role, codes, nums = arrays(batch, plan)
            mine = np.flatnonzero(role[:, s] > 0)
            x = plan.design(s, codes[mine], nums[mine])
            n = plan.rows[s].sum()
            weight = np.where(y[mine] == 1, n / (2.0 * max(1, plan.rows[s, 1])), n / (2.0 * max(1, plan.rows[s, 0])))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(mine) + 1, dtype=np.int32) * plan.width), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays(
                [key.take(pa.array(mine)), pa.array(y[mine].astype(np.int32)), pa.array(role[mine, s]), pa.array(weight), rows],
                ["key", "y", "role", "weight", "x"])

    kind = enc.table.schema["key"].dataType.simpleString()
    return enc.table.mapInArrow(run, f"key {kind}, y int, role tinyint, weight double, x array<double>")
