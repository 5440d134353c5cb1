"""Trained baselines, and batch scoring with a model the user supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F, types as T

from tinderframe.plans.trees import Settings, TreeModel, fit_trees


def boosted_trees(**overrides) -> Settings:
    """Gradient-boosted trees with the documented default settings: a minimum loss reduction
    per split, a share of the rows per round and of the features per tree, L2 of 1."""
    settings = dict(trees=100, depth=3, rate=0.1, rows=0.8, columns=0.9, least=1.0, least_gain=0.1, l2=1.0, boosted=True)
    return Settings(**(settings | overrides))


def random_forest(**overrides) -> Settings:
    """Bootstrapped regression trees; a share of the features per node."""
    return Settings(**(dict(trees=25, depth=5, columns=0.8, least=1.0, boosted=False) | overrides))


def linear_model(**overrides) -> LinearRegression:
    settings = dict(fitIntercept=True, solver="normal")
    return LinearRegression(featuresCol="features", labelCol="fm", predictionCol="preds", **(settings | overrides))


def feature_matrix(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows of all stations with their features as one vector; rows with a missing value drop out."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    return assembler.transform(df).select(*keep, "features")


def fit(estimator, train: DataFrame, features: Sequence[str], target: str = "fm", weight: str | None = None, key: Sequence[str] = ()):
    """Fit on the selected features, optionally weighting rows.

    Rows with a missing feature cannot be fitted and are left out; for scoring they are kept
    (see :func:`predict`). ``key`` names the columns that tell rows apart when trees draw them.
    """
    if isinstance(estimator, Settings):
        return fit_trees(train, features, target, estimator, key, weight)
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    estimator = estimator.setLabelCol(target)
    if weight is not None:
        estimator = estimator.setWeightCol(weight)
    rows = assembler.transform(train).select("features", target, *([weight] if weight else []))
    return PipelineModel([assembler.copy({assembler.handleInvalid: "keep"}), estimator.fit(rows)])


def predict(model, df: DataFrame) -> DataFrame:
    """``df`` with ``preds``: every row comes out, those with a missing feature with null."""
    if isinstance(model, TreeModel):
        return model.transform(df)
    known = reduce(and_, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in model.stages[0].getInputCols()])
    return model.transform(df).drop("features").withColumn("preds", F.when(known, F.col("preds")))


def fit_line(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Least-squares line with intercept, per group, as plain aggregates."""
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n")
    )


PredictFn = Callable[[np.ndarray], np.ndarray]


def score_windows(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    features: Sequence[str],
    load_model: Callable[[], PredictFn],
    ts: str = "date_time",
    batch_size: int = 1024,
    smallest: int = 32,
    out_of_memory: tuple[type[BaseException], ...] = (MemoryError,),
    fallbacks: Accumulator | None = None,
) -> DataFrame:
    """Score sequences with an external model: ``(batch, steps, features) -> (batch, steps)``.

    ``load_model`` runs once per task, so the model is read on the executors and never sits
    in the plan. Sequences reach it in batches of at most ``batch_size`` of equal length.
    Returns one row per key and step. Works for station windows and for grid cells alike.

    A batch for which the model runs out of memory (``out_of_memory`` names its errors) is
    tried again in halves, down to ``smallest``; the task stays at the size that worked, and
    each step down is counted in ``fallbacks``. At the smallest size the error stands.
    """
    keys, features = list(keys), list(features)
    fields = [f for f in df.schema.fields if f.name in keys]
    schema = T.StructType(
        [*fields, T.StructField("_times", T.ArrayType(T.LongType())), T.StructField("_preds", T.ArrayType(T.DoubleType()))]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, size = load_model(), batch_size
        for pdf in batches:
            for _, same in pdf.groupby(pdf["_times"].map(len)):
                at = 0
                while at < len(same):
                    part = same.iloc[at : at + size]
                    try:
                        x = np.stack([np.vstack(part[f"_x{k}"].to_list()) for k in range(len(features))], axis=-1)
                        y = np.asarray(model(x.astype(float)), dtype=float).reshape(len(part), -1)
                    except out_of_memory:
                        if size <= smallest:
                            raise
                        size = max(smallest, min(size, len(part)) // 2)
                        if fallbacks is not None:
                            fallbacks.add(1)
                        continue
                    yield part[[*keys, "_times"]].assign(_preds=list(y))
                    at += len(part)

    # a field of an array of structs is the array of that field
    inputs = df.select(
        *keys,
        F.transform(F.col(f"{seq}.{ts}"), F.unix_micros).alias("_times"),
        *[F.col(f"{seq}.{f}").cast("array<double>").alias(f"_x{k}") for k, f in enumerate(features)],
    )
    scored = inputs.mapInPandas(run, schema)
    return scored.select(*keys, F.posexplode(F.arrays_zip("_times", "_preds")).alias("step", "z")).select(
        *keys, "step", F.timestamp_micros("z._times").alias(ts), F.col("z._preds").alias("preds")
    )
