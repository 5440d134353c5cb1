"""Feature scaling: statistics from the training rows only, one row, applied as scalars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def fit_standard(train: DataFrame, cols: Sequence[str], weight: str | None = None) -> DataFrame:
    """One row ``{col: (center, spread)}``: mean and population deviation.

    With ``weight`` a row counts as often as the weight says, e.g. once per sequence window
    it takes part in. A constant feature gets spread 1.
    """
    aggs = []
    for c in cols:
        x = F.col(c)
        if weight is None:
            mean, sd = F.avg(x), F.stddev_pop(x)
        else:
            w = F.when(x.isNotNull(), F.col(weight))
            mean = F.try_divide(F.sum(w * x), F.sum(w))
            # one pass; good to ~1e-12 for means up to 1,000 deviations from zero
            var = F.try_divide(F.sum(w * x * x), F.sum(w)) - mean * mean
            sd = F.sqrt(F.greatest(var, F.lit(0.0)))
        aggs.append(F.struct(mean.alias("center"), F.when(sd > 0, sd).otherwise(1.0).alias("spread")).alias(c))
    return train.agg(*aggs)


def fit_minmax(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row ``{col: (center, spread)}``: minimum and range."""
    aggs = []
    for c in cols:
        width = F.max(c) - F.min(c)
        aggs.append(
            F.struct(F.min(c).alias("center"), F.when(width > 0, width).otherwise(1.0).alias("spread")).alias(c)
        )
    return train.agg(*aggs)


def _params(stats: DataFrame, cols: Sequence[str]) -> Column:
    return stats.select(F.struct(*cols).alias("s")).scalar()


def scale(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Apply the fitted statistics. They enter as a scalar subquery: no join, no shuffle."""
    s = _params(stats, cols)
    return df.withColumns({c: (F.col(c) - s[c]["center"]) / s[c]["spread"] for c in cols})


def unscale(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    s = _params(stats, cols)
    return df.withColumns({c: F.col(c) * s[c]["spread"] + s[c]["center"] for c in cols})
