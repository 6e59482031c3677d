"""Model zoo on pyspark.ml.

Class 1 = pass.  "Balanced" models train with ``weightCol`` = n / (2 n_class).
sklearn's ``C`` maps to ``regParam = 1 / (C * n)`` (mean loss in Spark, summed
loss in liblinear), so coefficients differ from the reference; metrics are
compared, not weights.  The RBF-kernel SVM has no Spark counterpart and is
re-aimed as random Fourier features (Rahimi & Recht 2007) + logistic
regression, which also gives a probability.  k-NN is a join, see
``earlywarn.operators.knn``.
"""

from __future__ import annotations

import math
from collections import OrderedDict

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42
DEEP_TREE = 30  # "no depth limit": the deepest tree Spark accepts
MAX_ITER = 3000
TOL = 1e-4  # the reference library's default stopping tolerance for logistic regression

# The reference's model names, in its order, and its search
# grids (43 candidates in all), each in the order of sorted parameter names.
GRIDS: "OrderedDict[str, list[dict]]" = OrderedDict()
GRIDS["Dummy Baseline"] = [{}]
GRIDS["Logistic Regression"] = [{"C": c, "l1_ratio": l} for c in (0.01, 0.1, 1.0, 10.0) for l in (0.0, 1.0)]
GRIDS["Decision Tree"] = [{"max_depth": d, "min_samples_leaf": m} for d in (3, 5, None) for m in (1, 3)]
GRIDS["Random Forest"] = [{"n_estimators": n, "max_depth": d, "min_samples_leaf": m} for d in (5, None) for m in (1, 3) for n in (100, 200)]
GRIDS["Gradient Boosting"] = [{"n_estimators": n, "learning_rate": r, "max_depth": d} for r in (0.05, 0.1) for d in (2, 3) for n in (100, 150)]
GRIDS["SVM RBF"] = [{"C": c, "gamma": g} for c in (0.1, 1.0, 10.0) for g in ("scale", "auto")]
GRIDS["KNN"] = [{"n_neighbors": k, "weights": w} for k in (5, 9, 15) for w in ("uniform", "distance")]
BALANCED = {"Logistic Regression", "Decision Tree", "Random Forest", "SVM RBF"}


class MajorityClassModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    majority = Param(Params._dummy(), "majority", "majority class", typeConverter=TypeConverters.toInt)
    share = Param(Params._dummy(), "share", "share of class 1", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, majority=None, share=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        maj = self.getOrDefault(self.majority)
        p1 = float(maj)
        return df.withColumn("prediction", F.lit(float(maj))).withColumn(
            "probability", array_to_vector(F.array(F.lit(1.0 - p1), F.lit(p1))))


class MajorityClass(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """M6: predict the most frequent training class (ties: the smaller class)
    with probability one; ``share`` keeps the training share of class 1."""

    labelCol = Param(Params._dummy(), "labelCol", "label", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, labelCol="target"):
        super().__init__()
        self._set(labelCol=labelCol)

    def _fit(self, df: DataFrame) -> MajorityClassModel:
        y = self.getOrDefault(self.labelCol)
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("double")).alias("ones")).first()
        share = (r["ones"] or 0.0) / r["n"] if r["n"] else 0.0
        return MajorityClassModel(majority=1 if share > 0.5 else 0, share=share)


class RandomFourierFeatures(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """M11 part 1: z(x) = sqrt(2/D) cos(W x + b), W ~ N(0, 2 gamma), b ~ U(0, 2 pi).

    ``gamma`` 'scale' = 1 / (d * var(X)), 'auto' = 1 / d, or a number; the
    variance is one aggregation over the training vectors.
    """

    inputCol = Param(Params._dummy(), "inputCol", "vector column", typeConverter=TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "output", typeConverter=TypeConverters.toString)
    gamma = Param(Params._dummy(), "gamma", "scale, auto or a number", typeConverter=TypeConverters.toString)
    nComponents = Param(Params._dummy(), "nComponents", "D", typeConverter=TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol="features", outputCol="rff", gamma="scale", nComponents=200, seed=SEED):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(inputCol="features", outputCol="rff", gamma="scale", nComponents=200, seed=SEED)

    def _fit(self, df: DataFrame) -> "RandomFourierModel":
        col = self.getOrDefault(self.inputCol)
        arr = vector_to_array(F.col(col))
        first = df.select(F.size(arr).alias("d")).first()
        d = int(first["d"]) if first else 1
        g = self.getOrDefault(self.gamma)
        if g in ("scale", "auto"):
            if g == "auto":
                gamma = 1.0 / d
            else:
                v = df.select(F.explode(arr).alias("x")).agg(F.var_pop("x").alias("v")).first()["v"] or 0.0
                gamma = 1.0 / (d * v) if v > 0 else 1.0
        else:
            gamma = float(g)
        return RandomFourierModel(inputCol=col, outputCol=self.getOrDefault(self.outputCol), gammaValue=gamma,
                                  nComponents=self.getOrDefault(self.nComponents), seed=self.getOrDefault(self.seed), dim=d)


class RandomFourierModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    inputCol = Param(Params._dummy(), "inputCol", "vector column", typeConverter=TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "output", typeConverter=TypeConverters.toString)
    gammaValue = Param(Params._dummy(), "gammaValue", "gamma", typeConverter=TypeConverters.toFloat)
    nComponents = Param(Params._dummy(), "nComponents", "D", typeConverter=TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", typeConverter=TypeConverters.toInt)
    dim = Param(Params._dummy(), "dim", "input size", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, gammaValue=None, nComponents=None, seed=None, dim=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        D = self.getOrDefault(self.nComponents)
        d = self.getOrDefault(self.dim)
        gamma = self.getOrDefault(self.gammaValue)
        rng = np.random.default_rng(self.getOrDefault(self.seed))
        W = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(d, D))
        b = rng.uniform(0.0, 2.0 * math.pi, size=D)
        scale = math.sqrt(2.0 / D)

        @F.pandas_udf("array<double>")
        def rff(xs: pd.Series) -> pd.Series:  # Arrow batches, one matrix product per batch
            if len(xs) == 0:
                return pd.Series([], dtype=object)
            X = np.stack(xs.to_numpy())
            Z = scale * np.cos(X @ W + b)
            return pd.Series(list(Z))

        out = self.getOrDefault(self.outputCol)
        return df.withColumn(out, array_to_vector(rff(vector_to_array(F.col(self.getOrDefault(self.inputCol))))))


def build_estimator(name: str, params: dict, n_train: int, label: str = "target", features: str = "features",
                    weight: str | None = "weight"):
    """A pyspark.ml estimator (or stage list) for a reference model name and parameters."""
    w = weight if name in BALANCED else None
    wkw = {"weightCol": w} if w else {}
    if name == "Dummy Baseline":
        return [MajorityClass(labelCol=label)]
    if name == "Logistic Regression":
        c = float(params.get("C", 1.0))
        return [LogisticRegression(featuresCol=features, labelCol=label, regParam=1.0 / (c * max(1, n_train)),
                                   elasticNetParam=float(params.get("l1_ratio", 0.0)), standardization=False,
                                   maxIter=int(params.get("max_iter", MAX_ITER)), tol=TOL, **wkw)]
    if name == "Decision Tree":
        depth = params.get("max_depth")
        return [DecisionTreeClassifier(featuresCol=features, labelCol=label, maxDepth=DEEP_TREE if depth is None else int(depth),
                                       minInstancesPerNode=int(params.get("min_samples_leaf", 1)), seed=SEED, **wkw)]
    if name == "Random Forest":
        depth = params.get("max_depth")
        return [RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=int(params.get("n_estimators", 100)),
                                       maxDepth=DEEP_TREE if depth is None else int(depth),
                                       minInstancesPerNode=int(params.get("min_samples_leaf", 1)), seed=SEED, **wkw)]
    if name == "Gradient Boosting":
        return [GBTClassifier(featuresCol=features, labelCol=label, maxIter=int(params.get("n_estimators", 100)),
                              stepSize=float(params.get("learning_rate", 0.1)), maxDepth=int(params.get("max_depth", 3)),
                              minInstancesPerNode=int(params.get("min_samples_leaf", 1)), seed=SEED)]
    if name == "SVM RBF":
        c = float(params.get("C", 1.0))
        return [RandomFourierFeatures(inputCol=features, outputCol="rff", gamma=str(params.get("gamma", "scale")),
                                      nComponents=int(params.get("n_components", 200)), seed=SEED),
                LogisticRegression(featuresCol="rff", labelCol=label, regParam=1.0 / (c * max(1, n_train)),
                                   standardization=False, tol=TOL, **wkw)]
    raise ValueError(f"no estimator is known for {name!r}; choose one of {list(GRIDS)}")


def pass_probability(df: DataFrame, prob: str = "probability", raw: str = "rawPrediction") -> Column:
    """P(class 1) from the probability vector, else the sigmoid of the margin."""
    if prob in df.columns:
        return vector_to_array(F.col(prob))[1]
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-vector_to_array(F.col(raw))[1]))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
