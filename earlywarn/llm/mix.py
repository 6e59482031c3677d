"""Mixing sources to target weights by hierarchical budgeting (DataFrame only).

Sources form a tree, here domain - language - source.  A token budget is
poured from the root: a node shares what it got among its children by weight,
none above its supply (its tokens times ``max_epochs``); what a short child
cannot take goes to its siblings by weight, and only what a whole subtree
cannot take reaches the siblings of its root.  The share of a child follows
in closed form from running totals along supply / weight, in whole tokens.

A leaf's budget is spent in seeded epochs: as many whole passes over its
documents as fit, then the prefix of one more pass in the order of
md5(seed|epoch|id), as far as its tokens fit.  Rows of the same id (or none)
follow one another by a hash of the text, then by their row number in a
written table, so every row has a key of its own.  The prefix is found by
bucket totals over the first hex digits of the key; while the bucket in which
a leaf's budget ends is large (a hot id, or copies), it is parted again by
the next digits, and only a small one is ordered row by row.  What a document
needs to know is its leaf's whole passes and the last key that is in, so
selecting is a scan.  The prefix ends at the first document that does not
fit; ``report`` gives the tokens that a leaf leaves unspent by that.

Defined results: null texts have no tokens, null keys form the branch
``none``; a leaf without tokens gives nothing; documents with the same id or
without one are in or out row by row; branches without weight get ``default_weight``; weight 0 gets
nothing; an empty table gives an empty result; other columns are kept as
they are by ``mix`` and ignored by ``select``.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earlywarn.llm import util

BUCKET_ROWS = 20_000  # rows of a leaf ordered by one task
ID_DIGITS, TEXT_DIGITS, ROW_DIGITS = 32, 16, 16  # hex digits of a key
NONE = "none"


def count_tokens(text: Column) -> Column:
    """Words: runs of other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(util.NONSPACE)), F.lit(0)).cast("long")


def _weight(path: Sequence[Column], weights: Mapping[tuple, int], default: int) -> Column:
    """Weight of the node at ``path``; an entry may leave out leading levels."""
    out = F.lit(default)
    for key, value in weights.items():
        if len(key) <= len(path):
            tail = path[len(path) - len(key) :]
            hit = F.lit(True)
            for c, k in zip(tail, key):
                hit = hit & (c == F.lit(k))
            out = F.when(hit, F.lit(int(value))).otherwise(out)
    return out.cast("long")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[int, Mapping[tuple, int]], budget: Column, max_epochs: int, default_weight: int = 1) -> DataFrame:
    """``leaves`` (the level columns and ``tokens``) with ``target`` tokens.

    ``weights[i]`` maps paths of level ``i`` to whole-number weights.
    """
    supply = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = supply.agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("cap"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    # one row
    state = total.select(F.least("cap", budget.cast("long")).alias("given"))
    for i in range(len(levels)):
        here, parent = list(levels[: i + 1]), list(levels[:i])
        nodes = supply.groupBy(*here).agg(F.sum("cap").alias("cap"))
        nodes = nodes.withColumn("weight", _weight([F.col(c) for c in here], weights.get(i, {}), default_weight))
        nodes = nodes.join(state, parent) if parent else nodes.crossJoin(F.broadcast(state))
        order = Window.partitionBy(*(parent or [F.lit(0)])).orderBy((F.col("weight") == 0), F.try_divide("cap", "weight"), *here)
        before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ahead = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        nodes = nodes.withColumn("before", before).withColumn("ahead", ahead)
        # filling every child up to this one's supply / weight takes no more than there is
        full = F.col("cap") * F.col("ahead") + F.col("before") * F.col("weight") <= F.col("given") * F.col("weight")
        nodes = nodes.withColumn("full", full & (F.col("weight") > 0))
        # later children share what the full ones leave
        same = Window.partitionBy(*(parent or [F.lit(0)]))
        first = F.min(F.when(~F.col("full") & (F.col("weight") > 0), F.struct("before", "ahead"))).over(same)
        nodes = nodes.withColumn("rest", first)
        share = F.expr("(weight * (given - rest.before)) div rest.ahead")
        state = nodes.select(
            *here,
            F.when(F.col("full"), F.col("cap")).when(F.col("weight") == 0, F.lit(0)).otherwise(F.least(share, "cap")).cast("long").alias("given"),
        )
    return leaves.join(state.withColumnRenamed("given", "target"), list(levels))


def plan(
    rows: DataFrame,
    levels: Sequence[str],
    weights: Mapping[int, Mapping[tuple, int]],
    budget_share: float,
    max_epochs: int,
    seed: int,
) -> DataFrame:
    """One row per leaf: the level columns, ``tokens``, ``target``, ``whole``
    (whole passes), ``last`` (the last key of the next pass that is in) and
    ``unspent`` (tokens of the target that the prefix leaves).

    ``rows`` (written): the level columns, ``id``, ``mark``, ``row`` and ``tokens``.
    """
    levels = list(levels)
    leaves = util.cut(rows.groupBy(*levels).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "mix-leaves")
    whole_table = leaves.agg(F.sum("tokens").alias("t"), F.sum("rows").alias("n")).first()
    budget = F.lit(math.floor((whole_table.t or 0) * budget_share))
    given = budgets(leaves, levels, weights, budget, max_epochs)
    whole = F.when(F.col("tokens") > 0, F.expr("target div tokens")).otherwise(F.lit(0)).cast("long")
    given = given.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("tokens"))
    given = util.cut(given, "mix-targets")

    digits = max(1, math.ceil(math.log(max(1, whole_table.n or 0) / BUCKET_ROWS + 1, 16)) + 1)
    keyed = rows.join(given.select(*levels, "whole", "rest"), levels)
    keyed = keyed.select(*levels, "rest", "tokens", epoch_key("whole", "id", "mark", "row", seed).alias("key"))
    run = Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside, before = keyed, F.lit(0).cast("long")
    text_at = ID_DIGITS + TEXT_DIGITS
    for end in (digits, ID_DIGITS, ID_DIGITS + digits, text_at, text_at + digits):
        sums = inside.withColumn("before", before).groupBy(*levels, "rest", "before", F.substring("key", 1, end).alias("bucket"))
        sums = sums.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
        sums = sums.withColumn("upto", F.col("before") + F.sum("t").over(run))
        # the first bucket that does not fit in whole; none if all do
        edge = sums.filter("upto > rest").groupBy(*levels).agg(F.min(F.struct("bucket", "upto", "t", "n")).alias("e"))
        edge = edge.select(*levels, F.col("e.bucket").alias("edge"), (F.col("e.upto") - F.col("e.t")).alias("before"), F.col("e.n").alias("n"))
        edge = util.cut(edge, "mix-edges")
        inside = keyed.join(edge, levels).filter(F.substring("key", 1, end) == F.col("edge"))
        before = F.col("before")
        if (edge.agg(F.max("n")).first()[0] or 0) <= BUCKET_ROWS:
            break
    peers = Window.partitionBy(*levels).orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(peers)).filter("upto <= rest")
    last = inside.groupBy(*levels).agg(F.max("key").alias("within"), F.max("upto").alias("upto"))
    out = given.join(edge.select(*levels, "edge", "before"), levels, "left").join(last, levels, "left")
    # without a row of its edge bucket a leaf's prefix ends with the bucket before;
    # "" comes before and "g" after every key
    end = F.when(F.col("rest") <= 0, F.lit("")).when(F.col("edge").isNull(), F.lit("g")).otherwise(F.coalesce("within", "edge"))
    unspent = F.when(F.col("rest") > 0, F.col("rest") - F.coalesce("upto", "before", "tokens")).otherwise(F.lit(0))
    return util.cut(out.select(*levels, "tokens", "target", "whole", end.alias("last"), unspent.cast("long").alias("unspent")), "mix-plan")


def epoch_key(epoch: str, id_col: str, mark: str, row: str, seed: int) -> Column:
    """Key of a row in a pass: 32 hex digits of its id, 16 of its text's hash
    (``mark``), 16 of its row number (one to one)."""
    name = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(epoch).cast("string"), F.col(id_col).cast("string")).cast("binary"))
    text = F.xxhash64(F.lit(seed), F.col(epoch).cast("long"), F.col(mark))
    digits = [F.lower(F.lpad(F.hex(h), n, "0")) for h, n in ((text, TEXT_DIGITS), (F.xxhash64(row), ROW_DIGITS))]
    return F.concat(name, *digits)


def select(
    df: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[int, Mapping[tuple, int]],
    budget_share: float,
    max_epochs: int,
    seed: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id, the levels, tokens and copies (1 and up) of every selected row."""
    rows, leaves = _rows_and_plan(df, levels, weights, budget_share, max_epochs, seed, id_col, text_col)
    return with_copies(rows, leaves, list(levels), "id", seed).filter("copies > 0").select("id", *levels, "tokens", "copies")


def with_copies(rows: DataFrame, leaves: DataFrame, levels: list[str], id_col: str, seed: int) -> DataFrame:
    joined = rows.join(leaves.select(*levels, "whole", "last"), levels)
    into = epoch_key("whole", id_col, "mark", "row", seed) <= F.col("last")
    return joined.withColumn("copies", F.col("whole") + F.when(into, 1).otherwise(0)).drop("whole", "last")


def report(
    df: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[int, Mapping[tuple, int]],
    budget_share: float,
    max_epochs: int,
    seed: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per leaf: the levels, its tokens, its target and the tokens of
    the target unspent, because the next document in the order is longer."""
    _, leaves = _rows_and_plan(df, levels, weights, budget_share, max_epochs, seed, id_col, text_col)
    return leaves.select(*levels, "tokens", "target", "unspent")


def _rows_and_plan(df, levels, weights, budget_share, max_epochs, seed, id_col, text_col, row=None):
    util.require(df, id_col, text_col)
    rows = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(text_col).alias("mark"),
        (F.monotonically_increasing_id() if row is None else F.col(row)).alias("row"),
        *[F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for n, c in levels.items()],
        count_tokens(F.col(text_col)).alias("tokens"),
    )
    rows = util.cut(rows, "mix-rows")
    return rows, plan(rows, list(levels), weights, budget_share, max_epochs, seed)


def mix(
    df: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[int, Mapping[tuple, int]],
    budget_share: float,
    max_epochs: int,
    seed: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``df`` that the mix takes, each as often as it takes it."""
    util.require(df, id_col, text_col)
    numbered = util.cut(df.withColumn("__mix_row", F.monotonically_increasing_id()), "mix-numbered")
    _, leaves = _rows_and_plan(numbered, levels, weights, budget_share, max_epochs, seed, id_col, text_col, "__mix_row")
    hidden = {n: f"__mix_{n}" for n in levels}
    leaves = leaves.select(*[F.col(n).alias(h) for n, h in hidden.items()], F.col("whole").alias("whole"), "last")
    leaves = leaves.withColumnsRenamed({"whole": "__mix_whole", "last": "__mix_last"})
    own = {h: F.coalesce(levels[n].cast("string"), F.lit(NONE)) for n, h in hidden.items()}
    rows = numbered.withColumns(own | {"__mix_id": F.col(id_col).cast("long"), "__mix_mark": F.xxhash64(text_col)})
    joined = rows.join(leaves, list(hidden.values()))
    into = epoch_key("__mix_whole", "__mix_id", "__mix_mark", "__mix_row", seed) <= F.col("__mix_last")
    times = (F.col("__mix_whole") + F.when(into, 1).otherwise(0)).cast("int")
    return joined.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(0), times))).select(*df.columns)
