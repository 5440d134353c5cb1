"""Forecast errors: per row, over replications, by group, by class, by lead time.

A prediction table has ``Model, rep, stid, date_time, fm, preds``. All summaries are
aggregates with partial results on the map side, so a model or station that holds most of
the rows costs no single task more. Second-level statistics see one row per replication.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tinderframe.functions.physics import moisture_class
from tinderframe.operators.reshape import exact_median

MOISTURE_CLASSES = ("Low", "Med", "High")


def residuals(df: DataFrame, pred: str = "preds", true: str = "fm") -> DataFrame:
    r = F.col(true) - F.col(pred)
    return df.withColumns({"residual": r, "abs_error": F.abs(r), "squared_error": r * r})


def _two_levels(per_rep: DataFrame, keys: Sequence[str]) -> DataFrame:
    return per_rep.groupBy(*keys).agg(
        F.avg("bias").alias("bias_mean"),
        F.stddev_samp("bias").alias("bias_std"),
        F.sqrt(F.avg("mse")).alias("rmse_mean"),
        # root of the deviation of the MSE, not the deviation of the RMSE
        F.sqrt(F.stddev_samp("mse")).alias("rmse_std"),
    )


def replication_summary(df: DataFrame, keys: Sequence[str], rep: str = "rep") -> DataFrame:
    """Bias and RMSE: means within each replication, then mean and spread over replications."""
    per_rep = residuals(df).groupBy(*keys, rep).agg(F.avg("residual").alias("bias"), F.avg("squared_error").alias("mse"))
    return _two_levels(per_rep, keys)


def error_tables(df: DataFrame, grains: dict[str, Sequence[str]], model: str = "Model", rep: str = "rep") -> DataFrame:
    """:func:`replication_summary` at several grains from one scan.

    ``grains`` names the extra keys of each table. Rows carry their table's name in
    ``grain`` and null in the keys that table does not use.
    """
    extra = list(dict.fromkeys(k for ks in grains.values() for k in ks))
    sets = [[model, rep, *ks] for ks in grains.values()]
    per_rep = (
        residuals(df)
        .groupingSets([[F.col(c) for c in s] for s in sets], model, rep, *extra)
        .agg(
            F.avg("residual").alias("bias"),
            F.avg("squared_error").alias("mse"),
            F.grouping_id(model, rep, *extra).alias("_gid"),
        )
    )
    bit = {c: 1 << (len(extra) - 1 - i) for i, c in enumerate(extra)}
    name = None
    for label, ks in grains.items():
        gid = sum(b for c, b in bit.items() if c not in ks)
        name = F.when(F.col("_gid") == gid, label) if name is None else name.when(F.col("_gid") == gid, label)
    return _two_levels(per_rep.withColumn("grain", name), ["grain", model, *extra])


def named_metrics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, exact median, MAE, MSE and count of the residuals by group."""
    sums = {
        "mean": F.avg("residual"),
        "mae": F.avg("abs_error"),
        "mse": F.avg("squared_error"),
        "count": F.count("residual"),
    }
    found = exact_median(residuals(df), keys, "residual", also=sums)
    return found.select(*keys, "mean", "median", "mae", "mse", "count")


def evaluation_order(df: DataFrame, station: str = "stid", ts: str = "date_time") -> DataFrame:
    """Predictions sorted by station and time, as an export lists them."""
    return df.sort(station, ts)


def mean_squared_error(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """MSE by group, where nothing else is asked for: one aggregate."""
    return residuals(df).groupBy(*keys).agg(F.avg("squared_error").alias("mse"))


def best_config(metrics: DataFrame, config: str, metric: str = "mse") -> DataFrame:
    """The configuration with the smallest metric; ties go to the smallest id."""
    return metrics.agg(F.min(F.struct(metric, config)).alias("_b")).select(f"_b.{config}", f"_b.{metric}")


def mse_rollup(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """MSE per group and over everything, in one pass."""
    return df.rollup(*keys).agg(F.avg(F.pow(F.col("fm") - F.col("preds"), F.lit(2))).alias("mse"))


def variable_summary(df: DataFrame, cols: Sequence[str], spread: dict[str, str] | None = None) -> DataFrame:
    """One row per variable: mean, low, high and optionally a deviation.

    ``spread`` maps a column to ``"sample"`` or ``"population"``.
    """
    spread = spread or {}
    row = []
    for c in cols:
        sd = {"sample": F.stddev_samp(c), "population": F.stddev_pop(c)}.get(spread.get(c), F.lit(None).cast("double"))
        row.append(
            F.struct(
                F.lit(c).alias("variable"),
                F.avg(c).alias("mean"),
                F.min(c).cast("double").alias("low"),
                F.max(c).cast("double").alias("high"),
                sd.alias("std"),
            )
        )
    return df.agg(F.array(*row).alias("_a")).select(F.inline("_a"))


def class_errors(df: DataFrame, model: str = "Model") -> DataFrame:
    """Bias, RMSE and relative error by moisture class; classes without rows stay, as nulls."""
    r = F.col("fm") - F.col("preds")
    one = [
        F.struct(
            F.lit(c).alias("fm_class"),
            F.avg(F.when(moisture_class(F.col("fm")) == c, r)).alias("bias"),
            F.sqrt(F.avg(F.when(moisture_class(F.col("fm")) == c, r * r))).alias("rmse"),
            F.try_divide(
                F.avg(F.when(moisture_class(F.col("fm")) == c, F.abs(r))),
                F.avg(F.when(moisture_class(F.col("fm")) == c, F.col("fm"))),
            ).alias("rel_error"),
        )
        for c in MOISTURE_CLASSES
    ]
    return df.groupBy(model).agg(F.array(*one).alias("_a")).select(model, F.inline("_a"))


def class_bias_over_reps(df: DataFrame, model: str = "Model", rep: str = "rep") -> DataFrame:
    """Bias per replication and class, then mean and spread over replications."""
    rows = df.withColumn("fm_class", moisture_class(F.col("fm"))).where(F.col("fm_class").isNotNull())
    per_rep = rows.groupBy(model, "fm_class", rep).agg(F.avg(F.col("fm") - F.col("preds")).alias("bias"))
    return per_rep.groupBy(model, "fm_class").agg(
        F.avg("bias").alias("bias_mean"), F.stddev_samp("bias").alias("bias_std")
    )


def monthly_summary(per_time: DataFrame, cols: Sequence[str], ts: str = "date_time", model: str = "Model") -> DataFrame:
    """Mean by month of a table with one row per stamp (a mean of means)."""
    return per_time.groupBy(model, F.month(ts).alias("month")).agg(*[F.avg(c).alias(c) for c in cols])


def replication_coverage(df: DataFrame, key: str = "stid", rep: str = "rep") -> DataFrame:
    """In how many replications each station was drawn, and its rows."""
    pairs = df.groupBy(key, rep).agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n_reps"), F.sum("n").alias("n_rows"))


def replication_sizes(df: DataFrame, key: str = "stid", rep: str = "rep") -> DataFrame:
    """Stations and rows of each replication."""
    pairs = df.groupBy(key, rep).agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(rep).agg(F.count(F.lit(1)).alias("n_stations"), F.sum("n").alias("n_rows"))


def ensemble_band(df: DataFrame, keys: Sequence[str] = ("date_time",)) -> DataFrame:
    """Mean forecast and one sample deviation on either side, per stamp."""
    m, s = F.avg("preds"), F.stddev_samp("preds")
    return df.groupBy(*keys).agg(m.alias("mean"), (m - s).alias("low"), (m + s).alias("high"))


def lead_curve(df: DataFrame, lead: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Mean squared error and its standard error by forecast hour."""
    e = F.pow(F.col("fm") - F.col("preds"), F.lit(2))
    return df.groupBy(*keys, lead.alias("lead")).agg(
        F.avg(e).alias("mse"), F.try_divide(F.stddev_samp(e), F.sqrt(F.count(e))).alias("se")
    )


def station_rep_rmse(df: DataFrame, keys: Sequence[str] = ("stid",), rep: str = "rep") -> DataFrame:
    return df.groupBy(*keys, rep).agg(F.sqrt(F.avg(F.pow(F.col("fm") - F.col("preds"), F.lit(2)))).alias("rmse"))


def rmse_range(per_rep: DataFrame, keys: Sequence[str] = ("stid",)) -> DataFrame:
    """Low, median and high RMSE over the replications of a station (a bounded group)."""
    return per_rep.groupBy(*keys).agg(
        F.min("rmse").alias("low"), F.median("rmse").alias("median"), F.max("rmse").alias("high")
    )


def typical_replication(per_rep: DataFrame, keys: Sequence[str] = ("stid",), rep: str = "rep") -> DataFrame:
    """The replication whose RMSE is closest to the station's median; ties by number.

    With an even number of replications the two middle ones tie up to rounding, so the
    distance is rounded before it decides.
    """
    middle = per_rep.groupBy(*keys).agg(F.median("rmse").alias("median"))
    off = F.round(F.abs(F.col("rmse") - F.col("median")), 9)
    return (
        per_rep.join(middle, list(keys))
        .groupBy(*keys)
        .agg(F.min(F.struct(off.alias("off"), F.col(rep), F.col("rmse"))).alias("_b"))
        .select(*keys, f"_b.{rep}", "_b.rmse")
    )


def worst_replication(per_rep: DataFrame, keys: Sequence[str] = ("stid",), rep: str = "rep") -> DataFrame:
    """The replication with the largest RMSE; ties go to the smallest number."""
    worst = F.min(F.struct((-F.col("rmse")).alias("neg"), F.col(rep))).alias("_b")
    return per_rep.groupBy(*keys).agg(worst).select(*keys, f"_b.{rep}", (-F.col("_b.neg")).alias("rmse"))


def translated_ensemble(df: DataFrame, keys: Sequence[str], ts: str = "date_time") -> DataFrame:
    """MSE of the mean forecast before and after shifting it by its error at the first stamp."""
    mean = df.groupBy(*keys, ts).agg(F.avg("preds").alias("p"), F.avg("fm").alias("y"))
    # the group now has one row per stamp; first stamp and sums come from one aggregate:
    # mean((y - p - d)^2) = mean(e^2) - 2 d mean(e) + d^2
    e = F.col("y") - F.col("p")
    stats = mean.groupBy(*keys).agg(
        F.avg(e * e).alias("mse"), F.avg(e).alias("_e"), F.min_by(e, ts).alias("shift")
    )
    moved = F.col("mse") - 2 * F.col("shift") * F.col("_e") + F.col("shift") * F.col("shift")
    return stats.select(*keys, "shift", "mse", moved.alias("mse_shifted"))


def ablation_table(df: DataFrame, config: str, metric: str, baseline) -> DataFrame:
    """Relative difference of each configuration's metric from the baseline's."""
    base = df.where(F.col(config) == baseline).agg(F.max(metric)).scalar()
    return df.withColumn("rel_diff", F.try_divide(F.col(metric) - base, base))


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 40) -> DataFrame:
    """Equal-width counts between each column's minimum and maximum; the last bin is closed.

    Limits come from one aggregate, counts from a second; both combine on the map side.
    """
    limits = df.agg(F.struct(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in cols]).alias("l"))
    lim = limits.scalar()
    item = F.array(
        *[
            F.struct(
                F.lit(c).alias("variable"),
                F.col(c).cast("double").alias("x"),
                lim[c]["lo"].cast("double").alias("lo"),
                lim[c]["hi"].cast("double").alias("hi"),
            )
            for c in cols
        ]
    )
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    place = F.when(hi > lo, F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(0)
    return (
        df.select(F.inline(item))
        .where(x.isNotNull())
        .groupBy("variable", place.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def format_mean_std(mean: Column, std: Column, digits: int = 2) -> Column:
    """``"m +/- s"`` with halves rounded to even."""
    both = [F.format_string(f"%.{digits}f", F.bround(c.cast("double"), digits)) for c in (mean, std)]
    return F.concat(both[0], F.lit(" ± "), both[1])


def join_locations(errors: DataFrame, locations: DataFrame, key: str = "stid") -> DataFrame:
    """Attach station attributes; stations without any keep nulls."""
    return errors.join(locations, key, "left")


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, minimum and maximum of every column, as text."""
    return df.select(*cols).summary("count", "min", "max")
