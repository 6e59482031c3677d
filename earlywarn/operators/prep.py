"""Preprocessing stages fitted on training rows only.

The library defaults differ from the reference in two places, so two stages
are our own: ``Imputer(strategy='median')`` returns an approximate lower
median and rejects strings, and ``StandardScaler`` divides by the sample
standard deviation.  ``MedianImputer`` (exact median, linear interpolation),
``ModeImputer`` (most frequent, smallest on ties) and ``PopulationScaler``
compute their statistics with one aggregation over the training rows (no row
reaches the driver, only one value per column) and transform with plain
column expressions.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earlywarn.functions.ranking import exact_quantiles


SMALL_DISTINCT = 100_000


class _Cols(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns", typeConverter=TypeConverters.toListString)
    stats = Param(Params._dummy(), "stats", "fitted statistics as JSON", typeConverter=TypeConverters.toString)

    def getInputCols(self) -> list[str]:
        return self.getOrDefault(self.inputCols)

    def getStats(self) -> dict:
        return json.loads(self.getOrDefault(self.stats))


class _FillModel(Model, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, stats=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _present(self, c: str):
        """The column with its missing values as nulls."""
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        fill = self.getStats()
        return df.select(*[F.coalesce(self._present(c), F.lit(fill[c])).alias(c) if c in fill and fill[c] is not None
                           else F.col(c) for c in df.columns])


class MedianImputerModel(_FillModel):
    def _present(self, c: str):
        return F.when(~F.isnan(F.col(c).cast("double")), F.col(c))


class ModeImputerModel(_FillModel):
    def _present(self, c: str):
        return F.col(c).cast("string")  # the indexer takes no booleans


class MedianImputer(Estimator, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    """M1: fill numeric nulls with the exact training median."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> MedianImputerModel:
        cols = self.getInputCols()
        dbl = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in cols]
        d = df.select(*dbl)
        # Spark's exact ``percentile`` keeps one count per distinct value and
        # merges partial maps: cheap for low-cardinality columns, but a column
        # with many distinct values would hold them all in one task, so those
        # take the sliced histogram path instead.
        nd = d.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first()
        small = [c for c in cols if nd[c] <= SMALL_DISTINCT]
        large = [c for c in cols if c not in small]
        stats = {c: None for c in cols}
        if small:
            r = d.agg(*[F.percentile(c, 0.5).alias(c) for c in small]).first()
            stats.update({c: r[c] for c in small})
        if large:
            long = d.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in large])))
            med = exact_quantiles(long, ["feature"], "v", [0.5]).collect()  # one row per column
            stats.update({r["feature"]: r["value"] for r in med})
        return MedianImputerModel(inputCols=cols, stats=json.dumps(stats))


class ModeImputer(Estimator, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    """M3: fill text nulls with the most frequent training value (smallest on ties)."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ModeImputerModel:
        cols = self.getInputCols()
        long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in cols])))
        vc = long.filter(F.col("v").isNotNull()).groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n"))
        modes = vc.groupBy("feature").agg(F.min_by("v", F.struct((-F.col("n")).alias("a"), F.col("v").alias("b"))).alias("mode")).collect()
        stats = {c: None for c in cols}
        stats.update({r["feature"]: r["mode"] for r in modes})
        return ModeImputerModel(inputCols=cols, stats=json.dumps(stats))


class PopulationScalerModel(Model, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, stats=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        st = self.getStats()
        out = []
        for c in df.columns:
            if c in st:
                mean, std = st[c]
                scale = std if std else 1.0  # a constant column is centred, not divided by 0
                out.append(((F.col(c).cast("double") - F.lit(mean or 0.0)) / F.lit(scale)).alias(c))
            else:
                out.append(F.col(c))
        return df.select(*out)


class PopulationScaler(Estimator, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    """M2: standardise with the population standard deviation."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PopulationScalerModel:
        cols = self.getInputCols()
        aggs = []
        for c in cols:
            x = F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
            aggs += [F.avg(x).alias(f"m|{c}"), F.stddev_pop(x).alias(f"s|{c}")]
        r = df.agg(*aggs).first()
        stats = {c: [r[f"m|{c}"], r[f"s|{c}"]] for c in cols}
        return PopulationScalerModel(inputCols=cols, stats=json.dumps(stats))


def numeric_stage(cols: Sequence[str]) -> list:
    """M1 + M2: exact-median imputation then population standardisation."""
    return [MedianImputer(inputCols=list(cols)), PopulationScaler(inputCols=list(cols))]


def categorical_stage(cols: Sequence[str]) -> tuple[list, list[str]]:
    """M3 + M4: mode imputation then one-hot; an unseen or null category encodes as all zeros."""
    idx = [f"{c}__idx" for c in cols]
    ohe = [f"{c}__ohe" for c in cols]
    stages = [ModeImputer(inputCols=list(cols))] if cols else []
    if cols:
        stages.append(StringIndexer(inputCols=list(cols), outputCols=idx, handleInvalid="keep", stringOrderType="frequencyDesc"))
        # the indexer keeps an "unknown" bucket as the last index; dropLast removes it,
        # so an unseen category encodes as all zeros and every known one is kept
        stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True))
    return stages, ohe


def preprocessor(cat: Sequence[str], num: Sequence[str], out: str = "features") -> Pipeline:
    """M5: categorical block first, then numeric; every other column is left out of the vector."""
    cstages, ohe = categorical_stage(list(cat))
    stages = cstages + (numeric_stage(list(num)) if num else [])
    stages.append(VectorAssembler(inputCols=[*ohe, *num], outputCol=out, handleInvalid="keep"))
    return Pipeline(stages=stages)


def feature_names(df: DataFrame, col: str = "features") -> DataFrame:
    """M5: (position, feature, source) of an assembled vector from its ML attributes;
    one-hot slots read 'column=value'."""
    attrs = df.schema[col].metadata.get("ml_attr", {}).get("attrs", {})
    rows = []
    for kind in ("binary", "numeric", "nominal"):
        for a in attrs.get(kind, []):
            name = a["name"]
            src, _, val = name.partition("__ohe_")
            rows.append((int(a["idx"]), f"{src}={val}" if val else name, src))
    rows.sort()
    return df.sparkSession.createDataFrame(rows, "position int, feature string, source string")
