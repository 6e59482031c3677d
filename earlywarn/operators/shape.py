"""Projections, reshapes and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, NumericType, StringType, StructType

# Readable feature labels of the reference, in its order.
FEATURE_LABELS = {
    "school": "School",
    "sex": "Sex",
    "age": "Age",
    "address": "Home area",
    "famsize": "Family size",
    "Pstatus": "Parents' status",
    "Medu": "Mother's education",
    "Fedu": "Father's education",
    "Mjob": "Mother's job",
    "Fjob": "Father's job",
    "reason": "School choice reason",
    "guardian": "Guardian",
    "traveltime": "Travel time",
    "studytime": "Weekly study time",
    "failures": "Previous class failures",
    "schoolsup": "School support",
    "famsup": "Family support",
    "paid": "Paid classes",
    "activities": "Extra-curricular activities",
    "nursery": "Nursery attendance",
    "higher": "Plans higher education",
    "internet": "Internet access",
    "romantic": "Romantic relationship",
    "famrel": "Family relationship quality",
    "freetime": "Free time",
    "goout": "Going out",
    "Dalc": "Workday alcohol use",
    "Walc": "Weekend alcohol use",
    "health": "Health status",
    "absences": "Absences",
}

# Class code to text.
CLASS_LABELS = {0: "Fail", 1: "Pass"}


def select_existing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Project the listed columns that exist, in list order."""
    return df.select(*[c for c in cols if c in df.columns])


def display_safe(df: DataFrame) -> DataFrame:
    """Text and nested columns as text with null -> ''; numerics untouched."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (ArrayType, MapType, StructType)):
            out.append(F.coalesce(F.to_json(c), F.lit("")).alias(f.name))
        elif isinstance(f.dataType, (StringType, BooleanType)):
            out.append(F.coalesce(c.cast("string"), F.lit("")).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def round_cols(df: DataFrame, cols: Sequence[str], digits: int = 3) -> DataFrame:
    """Round the named columns."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str = "variable", val: str = "value") -> DataFrame:
    """Wide to long (values cast to double)."""
    wide = df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values])
    return wide.unpivot(list(ids), list(values), var, val)


def label_expr(col: Column, mapping: Mapping, default: Column | None = None) -> Column:
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    looked = F.element_at(F.create_map(*pairs), col)
    return F.coalesce(looked, default if default is not None else col.cast("string"))


def map_labels(df: DataFrame, col: str, mapping: Mapping, out: str | None = None) -> DataFrame:
    """Code -> label through a literal map (no join), identity when absent."""
    return df.withColumn(out or col, label_expr(F.col(col), mapping))


def record_audit(df: DataFrame, key: str = "row_id") -> DataFrame:
    """Each record transposed to (key, feature, label, value as text)."""
    feats = [c for c in df.columns if c != key]
    wide = df.select(key, *[F.col(c).cast("string").alias(c) for c in feats])
    long = wide.unpivot([key], feats, "feature", "value")
    return long.select(key, "feature", label_expr(F.col("feature"), FEATURE_LABELS).alias("label"), "value")


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Coercing numeric cast; rows where any listed cell is not a number are dropped."""
    out = df
    for c in cols:
        out = out.withColumn(c, F.expr(f"try_cast(`{c}` as double)"))
    return out.dropna(subset=list(cols))


def clean_params(df: DataFrame, col: str = "params", prefix: str = "clf__") -> DataFrame:
    """Strip a pipeline step prefix from the keys of a parameter map."""
    return df.withColumn(col, F.transform_keys(col, lambda k, v: F.regexp_replace(k, f"^{prefix}", "")))


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of numeric columns."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def append_all(dfs: Sequence[DataFrame]) -> DataFrame:
    """Union by name of same-shaped results."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """U2"""
    return df.select(col).distinct()


def is_subset(df: DataFrame, col: str, domain: Sequence) -> DataFrame:
    """One row, whether every value of ``col`` lies in ``domain``, and the count outside it."""
    outside = df.filter(~F.col(col).isin(*domain) | F.col(col).isNull())
    return outside.agg(F.count(F.lit(1)).alias("outside")).select((F.col("outside") == 0).alias("is_subset"), "outside")


def exclude(df: DataFrame, col: str, value) -> DataFrame:
    """U4: all rows but those with ``col == value``."""
    return df.filter(F.col(col) != F.lit(value))


def preview(df: DataFrame, n: int = 50, key: str = "row_id") -> DataFrame:
    """The first ``n`` rows in key order (a top-n report)."""
    return df.orderBy(key).limit(n)


def seeded_sample(df: DataFrame, n: int, seed: int = 42, key: str = "row_id") -> DataFrame:
    """``n`` rows drawn without replacement, reproducibly (order by a hash of seed and key)."""
    k = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("sample"), F.col(key).cast("string")))
    return df.withColumn("_k", k).orderBy("_k", key).limit(n).drop("_k")
