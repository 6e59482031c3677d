"""Running totals, row numbers and exact quantiles without one-task windows.

``Window.partitionBy(g).orderBy(x)`` puts a whole group in one task; with a
handful of groups (a model, a label) that is one task per group at any data
size.  Here every row gets a *slice*: a non-decreasing function of its sort
key, so slices are contiguous ranges of the order.

1. The slice is a pure function of the row and of data-derived bounds: for a
   numeric key, the number of bounds at or below it, where the bounds are
   approximate quantiles computed inside the same plan (a one-row aggregate
   joined by broadcast, so no extra job and no driver round trip); for an md5
   key, an equal range of its first 32 bits.  Re-running any task gives the same slice, so
   the two branches below always agree.
2. A window over ``(group, slice)`` gives the running total inside a slice
   and the slice total.
3. Slice totals (one row per group and slice) are summed over the preceding
   slices of the same group and joined back as offsets.

The result equals the single-window running total exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from earlywarn.functions.frames import join_group_stats, null_safe_join
from earlywarn.session import shared_dir

_SLICE = "_slice"


def _order_cols(order: Sequence) -> list[Column]:
    cols = []
    for o in order:
        if isinstance(o, str) and o.startswith("-"):
            cols.append(F.col(o[1:]).desc())
        else:
            cols.append(F.col(o).asc())
    return cols


def _n_slices(df: DataFrame) -> int:
    """As many slices as shuffle partitions, which are sized for the input
    (``session.cluster_conf``)."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


MD5 = "md5"  # as a slicer: the first order column is an md5 text
SLICE_ROWS = 1 << 18  # rows of an md5 slice, on average, at most


def with_md5_slice(df: DataFrame, col: str, out: str = _SLICE) -> DataFrame:
    """Tag rows with a slice of an md5 text: equal ranges of its first 32 bits,
    as many as the rows need (a one-row count, attached by broadcast) and at
    least the shuffle partitions."""
    rows = df.agg(F.count(F.lit(1)).alias("_rows"))
    n = F.greatest(F.lit(_n_slices(df)).cast("long"), F.ceil(F.col("_rows") / F.lit(SLICE_ROWS)))
    lead = F.conv(F.substring(F.col(col), 1, 8), 16, 10).cast("long")
    return df.crossJoin(F.broadcast(rows)).withColumn(out, F.shiftright(lead * n, 32).cast("int")).drop("_rows")


def bounds_below(bounds: str, x: Column, inclusive: bool) -> Column:
    """How many values of the sorted array ``bounds`` are below ``x`` (or equal
    to it): a binary search in steps that halve, for arrays up to 2^30 long."""
    steps = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])

    def step(at: Column, s: Column) -> Column:
        v = F.get(F.col(bounds), at + s - 1)  # null beyond the end
        return F.when(v <= x if inclusive else v < x, at + s).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def _tag(df: DataFrame, order: Sequence, slicer: Column | str | None, slices: int | None, bounds_from: DataFrame | None = None) -> DataFrame:
    if isinstance(slicer, str):
        return with_md5_slice(df, order[0])
    if slicer is not None:
        return df.withColumn(_SLICE, slicer)
    first = order[0]
    desc = first.startswith("-")
    name = first[1:] if desc else first
    if isinstance(df.schema[name].dataType, NumericType):
        return with_quantile_slice(df, name, slices or _n_slices(df), desc, bounds_from=bounds_from)
    # any other key: the ranges of the whole order, fixed by a checkpoint so
    # that every use of the slices sees the same ones
    shared_dir(df.sparkSession)
    ranges = df.repartitionByRange(slices or _n_slices(df), *_order_cols(order))
    return ranges.withColumn(_SLICE, F.spark_partition_id()).checkpoint()


def with_quantile_slice(df: DataFrame, col: str, slices: int, descending: bool = False, out: str = _SLICE,
                        bounds_from: DataFrame | None = None) -> DataFrame:
    """Tag rows with a slice of the numeric ``col``: approximate quantile bounds
    from a one-row aggregate over ``df`` (or over ``bounds_from``, a smaller
    table with the same column and distribution), attached by broadcast."""
    x = F.col(col).cast("double")
    if slices <= 1:
        return df.withColumn(out, F.lit(0))
    probs = [i / slices for i in range(1, slices)]
    src = bounds_from if bounds_from is not None else df
    b = src.select(F.array_sort(F.array_distinct(F.percentile_approx(x, probs, 4 * slices))).alias("_bounds"))
    j = df.crossJoin(F.broadcast(b))  # one row
    tag = F.size("_bounds") - bounds_below("_bounds", x, True) if descending else bounds_below("_bounds", x, True)
    return j.withColumn(out, F.coalesce(tag, F.lit(0))).drop("_bounds")


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence,
    measures: dict[str, Column | str],
    slices: int | None = None,
    slicer: Column | str | None = None,
    bounds_from: DataFrame | None = None,
) -> DataFrame:
    """Add inclusive running sums ``name = sum(expr)`` over ``order`` within ``by``.

    ``order`` must be unique within ``by`` (aggregate ties first, or add a
    tie-breaker); items are column names, ``-name`` for descending.
    ``slicer`` must be non-decreasing along ``order``; by default it comes
    from quantiles of the first (numeric) order column.
    """
    by = list(by)
    meas = {k: (F.col(v) if isinstance(v, str) else v) for k, v in measures.items()}
    tagged = _tag(df, order, slicer, slices, bounds_from)
    local_w = Window.partitionBy(*by, _SLICE).orderBy(*_order_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged
    for name, expr in meas.items():
        local = local.withColumn(f"_loc_{name}", F.sum(expr).over(local_w))
    totals = tagged.groupBy(*by, _SLICE).agg(*[F.sum(expr).alias(f"_tot_{k}") for k, expr in meas.items()])
    prev_w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(_SLICE) \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, _SLICE, *[F.coalesce(F.sum(f"_tot_{k}").over(prev_w), F.lit(0)).alias(f"_off_{k}") for k in meas]
    )
    out = null_safe_join(local, offsets, [*by, _SLICE])
    for k in meas:
        out = out.withColumn(k, F.col(f"_loc_{k}") + F.col(f"_off_{k}"))
    drop = [_SLICE] + [f"_{p}_{k}" for k in meas for p in ("loc", "off")]
    return out.drop(*drop)


def global_row_number(df: DataFrame, by: Sequence[str], order: Sequence, name: str = "rn", slices: int | None = None,
                      slicer: Column | str | None = None) -> DataFrame:
    """``row_number() over (partition by by order by order)``, computed in slices.

    ``order`` must make rows unique within ``by`` (include a key column).
    """
    out = running_totals(df, by, order, {name: F.lit(1)}, slices=slices, slicer=slicer)
    return out.withColumn(name, F.col(name).cast("bigint"))


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    quantiles: Sequence[float],
    slices: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation (numpy's default method).

    Returns one row per group and quantile: ``(*by, q_index, q, value)``.
    ``weight``: a column with the number of rows that a row stands for.
    Works on the value histogram, so the cost is one pass over the rows plus
    a shuffle of distinct values; no task holds a whole group.
    """
    by = list(by)
    whole = not by
    if whole:  # one group: a constant key, and a one-row size table to broadcast
        df, by = df.withColumn("_all", F.lit(0)), ["_all"]
    hist = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_c"))
    cum = running_totals(hist, by, [value], {"_cum": F.col("_c")}, slices=slices)
    sizes = hist.groupBy(*by).agg(F.sum("_c").alias("_n"))
    qs = F.array(*[F.struct(F.lit(i).alias("q_index"), F.lit(float(q)).alias("q")) for i, q in enumerate(quantiles)])
    # positions are 0-based indices into the sorted values
    pos = (F.col("_n") - 1).cast("double") * F.col("q")
    lo = F.floor(pos)
    hi = F.ceil(pos)
    start = F.col("_cum") - F.col("_c")  # first 0-based index held by this value
    covers = lambda p: (start <= p) & (p < F.col("_cum"))
    joined = cum.crossJoin(F.broadcast(sizes.drop(*by))) if whole else join_group_stats(cum, sizes, by)
    picked = (
        joined.select(*by, value, "_c", "_cum", "_n", F.inline(qs))
        .withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_frac", pos - lo)
        .filter(covers(F.col("_lo")) | covers(F.col("_hi")))
        .withColumn("_is_lo", covers(F.col("_lo")))
        .withColumn("_is_hi", covers(F.col("_hi")))
    )
    agg = picked.groupBy(*by, "q_index", "q").agg(
        F.max(F.when(F.col("_is_lo"), F.col(value))).alias("_vlo"),
        F.max(F.when(F.col("_is_hi"), F.col(value))).alias("_vhi"),
        F.first("_frac").alias("_frac"),
    )
    out = agg.select(
        *by, "q_index", "q",
        (F.col("_vlo") + F.col("_frac") * (F.col("_vhi") - F.col("_vlo"))).alias("value"),
    )
    return out.drop("_all") if whole else out


def running_max(df: DataFrame, by: Sequence[str], order: Sequence, value: str, name: str, slicer: Column | None = None) -> DataFrame:
    """Inclusive running maximum of ``value`` over ``order`` within ``by``, in slices
    (max inside the slice, combined with the max of all earlier slices)."""
    by = list(by)
    tagged = _tag(df, order, slicer, None)
    local_w = Window.partitionBy(*by, _SLICE).orderBy(*_order_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.withColumn("_loc", F.max(value).over(local_w))
    tops = tagged.groupBy(*by, _SLICE).agg(F.max(value).alias("_top"))
    prev_w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offs = tops.select(*by, _SLICE, F.max("_top").over(prev_w).alias("_prev"))
    out = null_safe_join(local, offs, [*by, _SLICE])
    return out.withColumn(name, F.coalesce(F.greatest("_loc", "_prev"), F.col("_loc"))).drop(_SLICE, "_loc", "_prev")
