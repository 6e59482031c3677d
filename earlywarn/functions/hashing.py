"""Deterministic hashes used for folds, samples, bootstrap weights and fixtures.

``h(tag, id)`` is the first 8 hex digits of ``md5('tag|id')`` read as an
integer; ``u(tag, id)`` scales it to [0, 1).  The same value is produced in
SQL by ``cast('0x'||substr(md5(k),1,8) as bigint)`` so that an independent
engine can reproduce every draw.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def key(tag: str, *ids) -> Column:
    parts = [F.lit(str(tag))] + [F.col(i).cast("string") if isinstance(i, str) else i.cast("string") for i in ids]
    return F.concat_ws("|", *parts)


def h(tag: str, *ids) -> Column:
    return F.conv(F.substring(F.md5(key(tag, *ids)), 1, 8), 16, 10).cast("bigint")


def u(tag: str, *ids) -> Column:
    return h(tag, *ids) / F.lit(TWO_POW_32)


def md5_order(tag: str, *ids) -> Column:
    """Sort key used to shuffle rows deterministically."""
    return F.md5(key(tag, *ids))


# Integer mixing hash for per-(row, iteration) draws.  md5 -> hex -> integer
# costs ~50x more per draw than plain integer arithmetic, and a bootstrap
# draws iterations x rows times.  All products stay below 2^63 (32-bit state
# times a 27-bit multiplier), so ANSI overflow checks never fire and any SQL
# engine with 64-bit integers and xor/shift reproduces the value exactly.
# Each xor-shift reads its input twice, so every step is its own projection
# (Catalyst keeps a multiply-referenced, non-trivial projection separate).
MASK32 = 0xFFFFFFFF
MIX_MUL = 0x45D9F3B


def mix32_int(x: int) -> int:
    x &= MASK32
    for _ in range(2):
        x = ((x ^ (x >> 16)) * MIX_MUL) & MASK32
    return x ^ (x >> 16)


GOLDEN = 0x9E3779B1  # 2^32 / golden ratio, odd: iteration b's state is ((b + seed * B) * GOLDEN) mod 2^32,
# and a draw is mix(state ^ key_hash) / 2^32 (numpy in the bootstrap tasks, SQL in its oracle)


def _mix_steps(df, col: str):
    c = F.col(col)
    df = df.withColumn(col, c.bitwiseXOR(F.shiftright(c, 16)))
    df = df.withColumn(col, (F.col(col) * F.lit(MIX_MUL)).bitwiseAND(F.lit(MASK32)))
    df = df.withColumn(col, F.col(col).bitwiseXOR(F.shiftright(F.col(col), 16)))
    df = df.withColumn(col, (F.col(col) * F.lit(MIX_MUL)).bitwiseAND(F.lit(MASK32)))
    return df.withColumn(col, F.col(col).bitwiseXOR(F.shiftright(F.col(col), 16)))


def with_key_hash(df, key: str, out: str):
    """32-bit hash of a bigint key (low half mixed, high half folded in, mixed again);
    computed once per row, before any per-iteration expansion."""
    k = F.col(key).cast("bigint")
    df = df.withColumn(out, k.bitwiseAND(F.lit(MASK32)))
    df = _mix_steps(df, out)
    df = df.withColumn(out, F.col(out).bitwiseXOR(F.shiftright(k, 32).bitwiseAND(F.lit(MASK32))))
    return _mix_steps(df, out)
