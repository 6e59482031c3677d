"""Data-quality audit and exploratory aggregates.

Each audit is one aggregation pass (partial aggregation map-side), except
duplicate rows, which shuffle a mark a row and compare rows of repeated marks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegralType, NumericType, StringType, BooleanType

from earlywarn.functions.frames import join_group_stats, join_on, null_safe_join
from earlywarn.functions.ranking import exact_quantiles


def _is_missing(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    col = F.col(f"`{c}`")
    if isinstance(dt, (DoubleType, FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def _column_stats(df: DataFrame) -> DataFrame:
    """One pass: per column missing count and whether it holds at most one value."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in df.columns:
        col = F.col(f"`{c}`")
        aggs += [
            F.sum(_is_missing(df, c).cast("bigint")).alias(f"m|{c}"),
            F.count(col).alias(f"nn|{c}"),
            F.min(col).cast("string").alias(f"lo|{c}"),
            F.max(col).cast("string").alias(f"hi|{c}"),
        ]
    return df.agg(*aggs)


def _long_stats(df: DataFrame) -> DataFrame:
    stats = _column_stats(df)
    items = F.array(*[
        F.struct(
            F.lit(c).alias("feature"), F.lit(i + 1).alias("position"),
            F.col(f"`m|{c}`").alias("missing"), F.col(f"`nn|{c}`").alias("non_null"),
            # a column holds <= 1 value (nulls count as a value) when it is all
            # null, or has no null and min = max
            ((F.col(f"`nn|{c}`") == 0)
             | ((F.col(f"`nn|{c}`") == F.col("_rows")) & (F.col(f"`lo|{c}`") == F.col(f"`hi|{c}`")))).alias("is_constant"),
        )
        for i, c in enumerate(df.columns)
    ])
    return stats.select(F.col("_rows").alias("rows"), F.inline(items))


def row_mark(df: DataFrame) -> Column:
    """128 bits of a row's cells and of which of them are null."""
    cells = [F.col(f"`{c}`") for c in df.columns]
    gaps = F.concat(*[F.isnull(c).cast("int").cast("string") for c in cells])
    return F.struct(F.xxhash64(gaps, *cells).alias("m1"), F.xxhash64(F.lit(1), gaps, *cells).alias("m2"))


FILTER_BITS = 26  # size, as a power of two, of the bitmap that says which marks may repeat
_PAGE = 32768  # bits in one row of that bitmap


def duplicate_rows(df: DataFrame, mark: Column | None = None) -> DataFrame:
    """A4: copies after the first of identical rows (nulls equal).

    Rows are counted by a mark of 128 bits, so the first shuffle carries a mark
    and a count for each distinct row.  Only rows whose mark repeats are then
    compared by all their cells: a bitmap of 2^26 bits over the repeated marks
    (sent to all tasks, 8 MB at most) holds the others back before the shuffle,
    and equal rows are added up in a task before it.  Where repeated marks fill
    the bitmap more rows pass, and the result is the same.
    """
    d = df.withColumn("__mark", row_mark(df) if mark is None else mark)
    repeated = d.groupBy("__mark").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    place = F.col("__mark.m1").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    page, bit = F.shiftright(place, 15), place.bitwiseAND(F.lit(_PAGE - 1))
    # position p of a bitmap is bit p % 8 of byte p / 8
    pages = repeated.select(page.alias("__page"), bit.alias("__bit")).groupBy("__page").agg(F.bitmap_construct_agg("__bit").alias("__map"))
    byte = F.conv(F.hex(F.substring(F.col("__map"), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    may = F.call_function("shiftright", byte, bit.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1
    held = d.withColumn("__page", page).join(F.broadcast(pages), "__page").filter(may)
    same = held.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    return same.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def _row_sum(df: DataFrame, cols: Sequence[str]) -> Column:
    """Exact sum of the 32-bit md5 numbers of the rows (nulls marked), whatever their order."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("∅")) for c in cols]
    return F.sum(F.conv(F.substring(F.md5(F.concat_ws("␟", *cells)), 1, 8), 16, 10).cast("decimal(38,0)"))


def _digest(total: str, rows: str) -> Column:
    text = F.concat_ws("|", F.coalesce(F.col(total).cast("string"), F.lit("0")), F.col(rows).cast("string"))
    return F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint")


def row_fingerprint(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row: the number of rows and the fingerprint of A6."""
    return df.agg(_row_sum(df, list(cols or df.columns)).alias("_s"), F.count(F.lit(1)).alias("rows")).select("rows", _digest("_s", "rows"))


def fingerprint(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Order-free 16-hex dataset fingerprint.

    Each row hashes to a 32-bit integer (md5 of its cells, nulls marked);
    the exact DECIMAL sum of row hashes and the row count are hashed with
    SHA-256.  Unlike a positional hash, it does not depend on row order.
    """
    return row_fingerprint(df, cols).select("fingerprint")


def quality_audit(df: DataFrame) -> DataFrame:
    """A1: (check, value, status) for rows, columns, missing cells, duplicates,
    constant columns and the fingerprint.

    All column checks and the fingerprint are sums over one scan; duplicates
    are counted by row marks (``duplicate_rows``).
    """
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("rows"), _row_sum(df, cols).alias("_s")]
    for i, c in enumerate(cols):
        col = F.col(f"`{c}`")
        aggs += [F.count(F.when(_is_missing(df, c), 1)).alias(f"m{i}"), F.count(col).alias(f"nn{i}"),
                 F.min(col).cast("string").alias(f"lo{i}"), F.max(col).cast("string").alias(f"hi{i}")]
    a = join_on(df.agg(*aggs), duplicate_rows(df), [])
    missing = sum((F.col(f"m{i}") for i in range(len(cols))), F.lit(0)).cast("bigint")
    const = sum((((F.col(f"nn{i}") == 0) | ((F.col(f"nn{i}") == F.col("rows")) & (F.col(f"lo{i}") == F.col(f"hi{i}")))).cast("int")
                 for i in range(len(cols))), F.lit(0)).cast("bigint")
    whole = a.select("rows", F.lit(len(cols)).alias("columns"), missing.alias("missing"), "duplicate_rows", const.alias("constant"),
                     _digest("_s", "rows"))
    rv = lambda check, v, status: F.struct(F.lit(check).alias("check"), v.cast("string").alias("value"), status.alias("status"))
    review = lambda v: F.when(v > 0, F.lit("Review")).otherwise(F.lit("Pass"))
    rows = F.array(
        rv("Rows", F.col("rows"), F.lit("Info")),
        rv("Columns", F.col("columns"), F.lit("Info")),
        rv("Missing cells", F.col("missing"), review(F.col("missing"))),
        rv("Duplicate rows", F.col("duplicate_rows"), review(F.col("duplicate_rows"))),
        rv("Constant columns", F.col("constant"), review(F.col("constant"))),
        rv("Dataset fingerprint", F.col("fingerprint"), F.lit("Reproducibility")),
    )
    return whole.select(F.posexplode(rows).alias("pos", "r")).select((F.col("pos") + 1).alias("position"), "r.*")


def missingness(df: DataFrame) -> DataFrame:
    """A3: missing % per feature, only positive, highest first."""
    s = _long_stats(df)
    out = s.select("feature", (F.col("missing") * F.lit(100.0) / F.col("rows")).alias("missing_pct"))
    return out.filter(F.col("missing_pct") > 0).orderBy(F.col("missing_pct").desc(), "feature")


def constant_columns(df: DataFrame) -> DataFrame:
    """A5: columns with at most one distinct value, nulls counted as a value."""
    return _long_stats(df).filter("is_constant").select("feature", "position")


def class_balance(df: DataFrame, y: str = "target") -> DataFrame:
    """Class counts over the domain {0, 1}, shares, minority share and the
    material-imbalance flag (minority share < 0.25)."""
    counts = complete_counts(df.select(F.col(y).cast("int").alias("cls")), "cls", (0, 1))
    tot = counts.agg(F.sum("count").alias("_t"), F.min("count").alias("_m"))
    j = join_on(counts, tot, [])
    return j.select(
        F.col("cls").alias("class"),
        F.when(F.col("cls") == 0, "Fail").otherwise("Pass").alias("label"),
        F.col("count"),
        F.when(F.col("_t") > 0, F.col("count") / F.col("_t").cast("double")).alias("share"),
        F.when(F.col("_t") > 0, F.col("_m") / F.col("_t").cast("double")).alias("minority_share"),
        F.when(F.col("_t") > 0, (F.col("_m") / F.col("_t").cast("double")) < F.lit(0.25)).alias("material_imbalance"),
    )


def complete_counts(df: DataFrame, col: str, domain: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Counts per value of ``col`` over a fixed domain, 0 where absent.

    The domain is a literal list (size known), expanded per group with an
    ``explode`` rather than a join against the data.
    """
    by = list(by)
    counts = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("count"))
    keys = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    dom = F.array(*[F.lit(v) for v in domain])
    grid = keys.select(*by, F.posexplode(dom).alias("_ord", col))
    out = null_safe_join(grid, counts, [*by, col], "left").select(*by, col, F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"), "_ord")
    return out.drop("_ord")


def histogram(df: DataFrame, col: str, nbins: int) -> DataFrame:
    """Equal-width histogram over [min, max] (the last bin is closed)."""
    x = df.select(F.col(col).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    rng = x.agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(nbins))
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.lit(nbins - 1), F.floor((F.col("x") - F.col("_lo")) / width).cast("int")))
    binned = join_on(x, rng, []).select(b.alias("bin"), "_lo", "_hi")
    out = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("count"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    w = (F.col("_hi") - F.col("_lo")) / F.lit(float(nbins))
    return out.select(
        F.col("bin").cast("int").alias("bin"),
        (F.col("_lo") + F.col("bin") * w).alias("bin_start"),
        (F.col("_lo") + (F.col("bin") + 1) * w).alias("bin_end"),
        "count",
    )


def corr_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every numeric pair (pairwise null removal), one pass."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    agg = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    items = []
    for a, b in pairs:
        v = F.col(f"`{a}|{b}`")
        items.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), v.alias("r")))
        if a != b:
            items.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), v.alias("r")))
    return agg.select(F.inline(F.array(*items)))


def box_stats(df: DataFrame, by: Sequence[str], y: str) -> DataFrame:
    """A10: quartiles (linear interpolation), 1.5 IQR fences, whiskers and outlier count per group."""
    by = list(by)
    d = df.select(*by, F.col(y).cast("double").alias("_y")).filter(F.col("_y").isNotNull())
    q = exact_quantiles(d, by, "_y", [0.25, 0.5, 0.75])
    qw = q.groupBy(*by).agg(
        F.max(F.when(F.col("q_index") == 0, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("q_index") == 1, F.col("value"))).alias("median"),
        F.max(F.when(F.col("q_index") == 2, F.col("value"))).alias("q3"),
    ).withColumn("lower_fence", F.col("q1") - F.lit(1.5) * (F.col("q3") - F.col("q1"))) \
     .withColumn("upper_fence", F.col("q3") + F.lit(1.5) * (F.col("q3") - F.col("q1")))
    j = join_group_stats(d, qw, by)
    inside = (F.col("_y") >= F.col("lower_fence")) & (F.col("_y") <= F.col("upper_fence"))
    return j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("_y").alias("min"),
        F.first("q1").alias("q1"),
        F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.max("_y").alias("max"),
        F.first("lower_fence").alias("lower_fence"),
        F.first("upper_fence").alias("upper_fence"),
        F.min(F.when(inside, F.col("_y"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("_y"))).alias("upper_whisker"),
        F.sum((~inside).cast("bigint")).alias("outliers"),
    )


def profile_by(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Count (non-null), mean, exact median and sample std per group."""
    by = list(by)
    d = df.select(*by, F.col(col).cast("double").alias("_v"))
    base = d.groupBy(*by).agg(F.count("_v").alias("count"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"))
    med = exact_quantiles(d, by, "_v", [0.5]).select(*by, F.col("value").alias("median"))
    return null_safe_join(base, med, by, "left").select(*by, "count", "mean", "median", "std")


def value_shares(df: DataFrame, col: str) -> DataFrame:
    """Value counts and their share of all rows."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    tot = counts.agg(F.sum("count").alias("_t"))
    return join_on(counts, tot, []).select("value", "count", (F.col("count") / F.col("_t").cast("double")).alias("share"))


def column_profile(df: DataFrame, max_listed: int = 20) -> DataFrame:
    """Defaults for a scoring form, per column.

    Categorical: distinct count and mode (ties: smallest value).  Numeric:
    min, max, exact median, whether integral, and the sorted distinct values
    when there are at most ``max_listed``.  Distinct values come from one
    value-count shuffle; no group is ever collected unbounded.
    """
    cat = [f.name for f in df.schema.fields if isinstance(f.dataType, (StringType, BooleanType))]
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    integral = {f.name for f in df.schema.fields if isinstance(f.dataType, IntegralType)}
    parts = []
    if cat:
        long_c = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in cat])))
        vc = long_c.filter(F.col("v").isNotNull()).groupBy("feature", "v").agg(F.count(F.lit(1)).alias("cnt"))
        pc = vc.groupBy("feature").agg(
            F.count(F.lit(1)).alias("n_distinct"),
            F.min_by("v", F.struct((-F.col("cnt")).alias("a"), F.col("v").alias("b"))).alias("mode"),
        )
        parts.append(pc.select("feature", F.lit("categorical").alias("role"), "n_distinct", "mode",
                               *[F.lit(None).cast("double").alias(k) for k in ("min", "max", "median")],
                               F.lit(None).cast("boolean").alias("is_integer"), F.lit(None).cast("string").alias("values")))
    if num:
        long_n = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in num])))
        long_n = long_n.filter(F.col("v").isNotNull() & ~F.isnan("v"))
        vc = long_n.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("cnt"))
        nd = vc.groupBy("feature").agg(F.count(F.lit(1)).alias("n_distinct"), F.min("v").alias("min"), F.max("v").alias("max"))
        few = vc.join(nd.filter(F.col("n_distinct") <= max_listed).select("feature"), on="feature", how="left_semi")
        listed = few.groupBy("feature").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("v")), lambda x: x.cast("string"))).alias("values"))
        med = exact_quantiles(long_n, ["feature"], "v", [0.5]).select("feature", F.col("value").alias("median"))
        ints = F.array(*[F.lit(c) for c in integral]) if integral else F.array().cast("array<string>")
        pn = nd.join(med, "feature", "left").join(listed, "feature", "left").select(
            "feature", F.lit("numeric").alias("role"), "n_distinct", F.lit(None).cast("string").alias("mode"),
            "min", "max", "median", F.array_contains(ints, F.col("feature")).alias("is_integer"), "values")
        parts.append(pn)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
