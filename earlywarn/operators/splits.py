"""One encoded table for many fits (M1-M5 for every split at once).

A *split* is a pair of conditions, training rows and test rows.  The rows are
written once, with their role in every split, category slots and numbers;
what the preprocessing learns (fills, means, deviations, which categories
were seen) is learned from the training rows of every split by a few
aggregations over all splits, and is small: it is applied to Arrow batches.
No split is copied and no fit repeats the preprocessing.  What only needs to
know how often a row occurs reads ``Encoded.groups``: equal rows as one.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earlywarn.functions.ranking import exact_quantiles
from earlywarn.session import scratch_path, ship_package

MAX_SLOTS = 200_000  # one-hot slots: a model holds a number for each, so they must fit the driver
BINS = 255  # bins of a number for trees; one per value where there are no more values
ROWS_PER_TASK = 100_000
TRAIN, TEST = 1, 2


@dataclass
class Plan:
    """What preprocessing learned, by split; ``slots`` counts the one-hot columns."""

    cats: list[str]
    nums: list[str]
    offset: list[int]  # first slot of every category column, and the number of slots
    values: list[list[str]]
    seen: np.ndarray  # training rows, split x slot
    fill_slot: np.ndarray  # split x category column
    median: np.ndarray  # split x number
    mean: np.ndarray
    std: np.ndarray
    edges: list[np.ndarray]  # bin edges of every number
    rows: np.ndarray  # training rows of each class, split x 2

    @property
    def slots(self) -> int:
        return self.offset[-1]

    @property
    def width(self) -> int:
        return self.slots + len(self.nums)

    def filled(self, s: int, codes: np.ndarray, nums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots and numbers with the fills of split ``s``."""
        return np.where(codes < 0, self.fill_slot[s], codes), np.where(np.isnan(nums), self.median[s], nums)

    def design(self, s: int, codes: np.ndarray, nums: np.ndarray) -> np.ndarray:
        """The feature matrix of split ``s``: one-hot slots (none for a category
        its training rows have not), then standardised numbers."""
        codes, nums = self.filled(s, codes, nums)
        x = np.zeros((len(codes), self.width))
        known = codes >= 0
        row = np.broadcast_to(np.arange(len(codes))[:, None], codes.shape)[known]
        x[row, codes[known]] = self.seen[s, codes[known]] > 0
        x[:, self.slots :] = (nums - self.mean[s]) / self.std[s]
        return x

    def variance(self, s: int) -> tuple[int, float]:
        """Features with training rows, and the variance of all their entries."""
        n = max(1, int(self.rows[s].sum()))
        d = int((self.seen[s] > 0).sum()) + len(self.nums)
        ones = float(self.seen[s].sum())
        spread = n * float((self.varies[s]).sum())
        return max(1, d), (ones + spread) / (n * max(1, d)) - (ones / (n * max(1, d))) ** 2

    varies: np.ndarray | None = None  # whether a number varies in the training rows, split x number


@dataclass
class Encoded:
    table: DataFrame  # key, y, tag, role array, codes array, nums array
    plan: Plan
    key: str
    rows: int

    @functools.cached_property
    def groups(self) -> DataFrame:
        """Rows of equal codes and numbers as one, with the counts of every
        split (``GROUPS``); written once, whatever fits read it."""
        with self._lock:
            return self._groups

    @functools.cached_property
    def _groups(self) -> DataFrame:
        spark = self.table.sparkSession
        out = alike(self).mapInArrow(_grouper(self.plan), GROUPS)
        path = scratch_path(spark, "split-groups")
        out.write.parquet(path)
        return spark.read.schema(out.schema).parquet(path)

    @functools.cached_property
    def kinds(self) -> int:
        """How many rows of ``groups`` there are."""
        return self.groups.agg(F.sum("rows")).first()[0] or 0

    _lock: threading.RLock = field(default_factory=threading.RLock, repr=False)


GROUPS = "rows int, codes binary, nums binary, n binary"
BLOB_ROWS = 16_384  # groups of one row of the table of groups
HELD_ROWS = 400_000  # rows a task holds before it adds up equal ones


@dataclass
class Groups:
    """Rows of equal codes and numbers: how often they occur in each split."""

    codes: np.ndarray
    nums: np.ndarray
    n: np.ndarray  # group x split x (train 0, train 1, test 0, test 1)


def alike(enc: Encoded) -> DataFrame:
    """The encoded rows, those of equal codes and numbers in one task."""
    tasks = max(4 * enc.table.sparkSession.sparkContext.defaultParallelism, -(-enc.rows // ROWS_PER_TASK))  # files enough for a reading task on each core
    return enc.table.repartition(tasks, "codes", "nums")


def same_rows(codes: np.ndarray, nums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of every group of equal rows, the group of each row), groups in a fixed order."""
    words = np.concatenate([codes.astype(">i8"), (np.where(np.isnan(nums), np.nan, nums) + 0.0).astype(">f8").view(">i8")], axis=1)
    whole = np.ascontiguousarray(words).view(np.dtype((np.void, 8 * words.shape[1]))).ravel() if words.shape[1] else np.zeros(len(codes), dtype=np.int8)
    _, first, group = np.unique(whole, return_index=True, return_inverse=True)
    return first, group.ravel()


def collapse(parts: list[Groups]) -> Groups:
    """Equal groups added up, in a fixed order."""
    codes, nums, n = (np.concatenate([getattr(p, a) for p in parts]) for a in ("codes", "nums", "n"))
    first, group = same_rows(codes, nums)
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(len(first)))
    return Groups(codes[first], nums[first], np.add.reduceat(n[order], starts, axis=0) if len(first) else n)


def counted(y: np.ndarray, role: np.ndarray, codes: np.ndarray, nums: np.ndarray) -> Groups:
    """The groups of some rows."""
    first, group = same_rows(codes, nums)
    n = np.zeros((len(first), role.shape[1], 4), dtype=np.int32)
    for s in range(role.shape[1]):
        mine = np.flatnonzero(role[:, s])
        place = group[mine] * 4 + (role[mine, s] - TRAIN) * 2 + y[mine]
        n[:, s] = np.bincount(place, minlength=4 * len(first)).reshape(-1, 4)
    return Groups(codes[first], nums[first], n)


def _grouper(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Groups] = []
        grown = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(counted(*itemgetter(1, 3, 4, 5)(arrays(batch, plan))))
            if sum(len(g.codes) for g in held) > max(HELD_ROWS, 2 * grown):
                held = [collapse(held)]
                grown = len(held[0].codes)
        if held:
            g = collapse(held)
            for i in range(0, len(g.codes), BLOB_ROWS):
                yield packed(Groups(g.codes[i : i + BLOB_ROWS], g.nums[i : i + BLOB_ROWS], g.n[i : i + BLOB_ROWS]))

    return run


def packed(g: Groups) -> pa.RecordBatch:
    blobs = [pa.array([np.ascontiguousarray(x, t).tobytes()], pa.binary()) for x, t in ((g.codes, np.int32), (g.nums, np.float64), (g.n, np.int32))]
    return pa.RecordBatch.from_arrays([pa.array([len(g.codes)], pa.int32()), *blobs], ["rows", "codes", "nums", "n"])


def unpacked(batch: pa.RecordBatch, plan: Plan) -> Iterator[Groups]:
    """The groups of a batch of the table of groups."""
    for i in range(len(batch)):
        rows = batch.column(0)[i].as_py()
        codes, nums, n = (np.frombuffer(batch.column(j)[i].as_buffer(), t) for j, t in ((1, np.int32), (2, np.float64), (3, np.int32)))
        yield Groups(codes.reshape(rows, len(plan.cats)).astype(np.int64), nums.reshape(rows, len(plan.nums)), n.reshape(rows, len(plan.rows), 4))


def _role(splits: Sequence[tuple[Column, Column]]) -> Column:
    one = [F.when(train, TRAIN).when(test, TEST).otherwise(0) for train, test in splits]
    # a function over the array keeps many splits out of one generated method too long to be compiled
    return F.transform(F.array(*one), lambda x: x.cast("tinyint"))


def _counts(n: int) -> list[Column]:
    return [F.sum((F.col("role")[s] == TRAIN).cast("long")).alias(f"n{s}") for s in range(n)]


def _matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype, copy=False).reshape(len(column), width)


def arrays(batch: pa.RecordBatch, plan: Plan) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, y, tag, role, codes, nums) of a batch of the encoded table."""
    return (
        batch.column(0),
        batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64),
        batch.column(2).to_numpy(zero_copy_only=False),
        _matrix(batch.column(3), len(plan.rows), np.int8),
        _matrix(batch.column(4), len(plan.cats), np.int64),
        _matrix(batch.column(5), len(plan.nums), np.float64),
    )


def encode(df: DataFrame, splits: Sequence[tuple[Column, Column]], cats: Sequence[str], nums: Sequence[str],
           label: str = "target", key: str = "row_id") -> Encoded:
    """The encoded table of ``df`` and the preprocessing of every split.

    A null or other label than 0 and 1 is an error; a missing number (null or
    NaN) takes the training median, a missing category the most frequent one
    (the smallest on ties)."""
    spark = df.sparkSession
    ship_package(spark)
    cats, nums, n = list(cats), list(nums), len(splits)
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    y = F.when(F.col(label).cast("int").isin(0, 1), F.col(label).cast("tinyint")).otherwise(
        F.raise_error(F.concat(F.lit(f"label {label} is neither 0 nor 1: "), F.coalesce(F.col(label).cast("string"), F.lit("null")))).cast("tinyint"))
    path = scratch_path(spark, "split-base")
    base = df.select(F.col(key), y.alias("__y"), F.xxhash64(key).alias("__tag"), _role(splits).alias("role"),
                     *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(cats)],
                     *[number(c).alias(f"x{i}") for i, c in enumerate(nums)])
    base.write.parquet(path)
    base = spark.read.schema(base.schema).parquet(path)

    classes = {r["__y"]: r for r in base.groupBy("__y").agg(*_counts(n), F.count(F.lit(1)).alias("all")).collect()}
    rows = np.array([[classes[c][f"n{s}"] if c in classes else 0 for c in (0, 1)] for s in range(n)], dtype=np.int64)
    total = sum(r["all"] for r in classes.values())

    # categories: one slot per value, and its training rows in every split
    offset, values, seen_parts, fill = [0], [], [], np.full((n, len(cats)), -1, dtype=np.int64)
    if cats:
        long = base.select("role", F.inline(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"c{i}").alias("v")) for i in range(len(cats))])))
        held = long.filter(F.col("v").isNotNull()).groupBy("c", "v").agg(*_counts(n))
        got = held.limit(MAX_SLOTS + 1).collect()
        if len(got) > MAX_SLOTS:
            raise ValueError(f"more than {MAX_SLOTS} categories: group the rare ones first")
        for i in range(len(cats)):
            mine = sorted((r for r in got if r.c == i), key=lambda r: r.v)
            count = np.array([[r[f"n{s}"] for r in mine] for s in range(n)], dtype=np.int64).reshape(n, len(mine))
            if mine:
                fill[:, i] = np.where(count.max(axis=1) > 0, offset[-1] + count.argmax(axis=1), -1)
            values.append([r.v for r in mine])
            seen_parts.append(count)
            offset.append(offset[-1] + len(mine))
    seen = np.concatenate(seen_parts, axis=1) if seen_parts else np.zeros((n, 0), dtype=np.int64)

    shape = (n, len(nums))
    median, mean, std, varies, edges = np.zeros(shape), np.zeros(shape), np.ones(shape), np.zeros(shape, dtype=bool), []
    if nums:
        long = base.select("role", F.inline(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"x{i}").alias("v")) for i in range(len(nums))])))
        hist = long.groupBy("c", "v").agg(*_counts(n))
        hpath = scratch_path(spark, "split-values")
        hist.write.parquet(hpath)
        hist = spark.read.schema(hist.schema).parquet(hpath)
        by_split = hist.select("c", "v", F.inline(F.array(*[F.struct(F.lit(s).alias("s"), F.col(f"n{s}").alias("n")) for s in range(n)])))
        by_split = by_split.filter("n > 0")
        for r in exact_quantiles(by_split, ["c", "s"], "v", [0.5], weight="n").collect():
            median[r.s, r.c] = r.value
        centre = {r.c: r.m for r in hist.filter("v is not null").groupBy("c").agg(F.avg("v").alias("m")).collect()}
        at = F.element_at(F.create_map(*[F.lit(x) for i in range(len(nums)) for x in (i, centre.get(i, 0.0))]), F.col("c"))
        w, d = F.col("n").cast("double"), F.col("v") - at
        sums = by_split.groupBy("c", "s").agg(F.sum(F.when(F.col("v").isNotNull(), w)).alias("n"), F.sum(F.when(F.col("v").isNull(), w)).alias("gaps"),
                                              F.sum(w * d).alias("s1"), F.sum(w * d * d).alias("s2"))
        for r in sums.collect():
            gap = (median[r.s, r.c] - centre.get(r.c, 0.0)) if r.n else 0.0
            gaps, m = r.gaps or 0.0, (r.n or 0.0) + (r.gaps or 0.0)
            s1, s2 = (r.s1 or 0.0) + gaps * gap, (r.s2 or 0.0) + gaps * gap * gap
            mean[r.s, r.c] = centre.get(r.c, 0.0) + s1 / m if r.n else 0.0
            var = max(0.0, s2 / m - (s1 / m) ** 2)
            varies[r.s, r.c] = var > 1e-18 * max(1.0, s2 / m)
            std[r.s, r.c] = var ** 0.5 if varies[r.s, r.c] else 1.0
        sizes = {r.c: r.k for r in hist.filter("v is not null").groupBy("c").agg(F.count(F.lit(1)).alias("k")).collect()}
        for i in range(len(nums)):
            if sizes.get(i, 0) <= BINS:
                edges.append(np.sort([r.v for r in hist.filter((F.col("c") == i) & F.col("v").isNotNull()).select("v").collect()]))
            else:
                probs = [k / BINS for k in range(1, BINS)]
                edges.append(np.unique(base.select(F.percentile_approx(f"x{i}", probs, 10 * BINS)).first()[0]))

    plan = Plan(cats, nums, offset, values, seen, fill, median, mean, std, [np.asarray(e, dtype=np.float64) for e in edges], rows, varies)
    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [pc.add(pc.index_in(b.column(f"c{i}"), value_set=pa.array(values[i], pa.string())).cast(pa.int64()), offset[i]) for i in range(len(cats))]
            codes = np.stack([pc.fill_null(c, -1).to_numpy() for c in codes], axis=1) if cats else np.zeros((len(b), 0), dtype=np.int64)
            x = [pc.fill_null(b.column(f"x{i}"), float("nan")).to_numpy() for i in range(len(nums))]
            x = np.stack(x, axis=1) if nums else np.zeros((len(b), 0))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel(), t))
                     for m, t in ((codes.astype(np.int32), pa.int32()), (x, pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("__y"), b.column("__tag"), b.column("role"), *lists],
                                             ["key", "y", "tag", "role", "codes", "nums"])

    tasks = max(spark.sparkContext.defaultParallelism, -(-total // ROWS_PER_TASK))
    out = base.repartition(tasks, "__tag").mapInArrow(write, f"key {kinds[key]}, y tinyint, tag long, role array<tinyint>, codes array<int>, nums array<double>")
    path = scratch_path(spark, "split-rows")
    out.write.parquet(path)
    return Encoded(spark.read.schema(out.schema).parquet(path), plan, key, total)
