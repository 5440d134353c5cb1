"""From raw readings and weather to the learning table, and the physics forecast on top."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from tinderframe.functions.physics import (
    MoistureParams,
    drying_equilibrium,
    feet_to_metres,
    to_kelvin,
    wetting_equilibrium,
)
from tinderframe.functions.times import day_of_year, hour_of_day
from tinderframe.operators.clean import SENSOR_NAMES, drop_invalid_intervals, in_range, unit_conflicts
from tinderframe.operators.evaluate import residuals
from tinderframe.operators.scale import fit_standard, scale
from tinderframe.operators.series import (
    drop_linear_runs,
    fill_missing,
    first_difference,
    interpolate_hourly,
    ordered_sequence,
    spinup_periods,
)
from tinderframe.operators.spatial import terrain_join
from tinderframe.plans.learners import PredictFn, score_windows
from tinderframe.plans.moisture import forecast_hours, kalman_forecast
from tinderframe.session import cut_lineage


def add_predictors(weather: DataFrame, ts: str = "date_time") -> DataFrame:
    """Equilibria from humidity and temperature; hour of day and day of year."""
    rh, temp = F.col("rh"), F.col("temp")
    return weather.withColumns(
        {
            "Ed": drying_equilibrium(rh, temp),
            "Ew": wetting_equilibrium(rh, temp),
            "hod": hour_of_day(F.col(ts)),
            "doy": day_of_year(F.col(ts)),
        }
    )


def sensor_series(
    rows: DataFrame,
    variables: Sequence[str],
    start,
    end,
    static: Sequence[str] = ("lat", "lon", "elev"),
    check_units: bool = True,
) -> DataFrame:
    """Hourly station series from sensor rows ``(stid, date_time, variable, value, units, ...)``.

    Variables get their names here, temperature is turned to Kelvin and elevation to metres;
    then every variable is interpolated by itself, equilibria, calendar features and hourly
    rain are added. The rows are never pivoted: each variable is a conditional column of the
    aggregate that reduces them to hours, so raw readings are shuffled only as hourly rows.
    """
    rows = rows.where(F.col("variable").isin(*variables))
    if check_units:
        mixed = [r["variable"] for r in unit_conflicts(rows).collect()]  # at most one row per variable
        if mixed:
            raise ValueError(f"variables without one unit: {', '.join(sorted(mixed))}")
    value = F.when(F.col("variable") == "air_temp", to_kelvin(F.col("value"), F.col("units"))).otherwise(F.col("value"))
    names = {v: SENSOR_NAMES.get(v, v) for v in variables}
    wide = rows.select(
        "stid",
        "date_time",
        *[F.when(F.col("variable") == v, value).alias(n) for v, n in names.items()],
        *[(feet_to_metres(F.col(c)) if c == "elev" else F.col(c)).alias(c) for c in static],
    )
    hourly = interpolate_hourly(wide, ["stid"], "date_time", list(names.values()), start, end, static)
    if {"rh", "temp"} <= set(names.values()):
        hourly = add_predictors(hourly)
    if "precip_accum" in names.values():
        hourly = first_difference(hourly, ["stid"], "date_time", "precip_accum", "rain")
    return hourly


def merge_weather(obs: DataFrame, weather: DataFrame, key: str = "stid", ts: str = "date_time") -> DataFrame:
    """Observations with the weather of the same station and hour; clashing names get ``_atm``.

    Coordinates are not part of the key: they follow from the station.
    """
    clash = {c: f"{c}_atm" for c in weather.columns if c in obs.columns and c not in (key, ts)}
    return obs.join(weather.withColumnsRenamed(clash), [key, ts])


def learning_table(
    readings: DataFrame,
    weather: DataFrame,
    start,
    end,
    invalid: DataFrame | None = None,
    fm_bounds: tuple = (1, 90),
    block_hours: int = 72,
    max_linear: int = 3,
    weather_columns: Sequence[str] = ("rh", "temp", "rain"),
) -> DataFrame:
    """Range check, hourly grid, weather join, removal of straight-line blocks and bad intervals.

    Missing values of the weather columns are interpolated over the station's own hours.
    """
    checked = readings.withColumn("fm", in_range(F.col("fm"), *fm_bounds))
    hourly = interpolate_hourly(checked, ["stid"], "date_time", ["fm"], start, end)
    weather = fill_missing(weather, ["stid"], "date_time", weather_columns)
    merged = merge_weather(hourly, add_predictors(weather))
    kept = drop_linear_runs(merged, ["stid"], "date_time", "fm", n=block_hours, threshold=max_linear)
    return kept if invalid is None else drop_invalid_intervals(kept, invalid)


def physics_forecast(
    table: DataFrame, start, periods: int, params: MoistureParams = MoistureParams()
) -> DataFrame:
    """Filtered physics forecast of every complete (station, period), with row errors.

    It depends on no trained weights, so it is computed once and semi-joined with the test
    stations of each replication afterwards.
    """
    placed = spinup_periods(table, "date_time", start, periods, params.hours - params.spinup, params.spinup)
    return residuals(forecast_hours(kalman_forecast(placed, params=params), params.spinup))


def for_replications(
    forecasts: DataFrame, splits: DataFrame, key: str = "stid", period: str = "period", rep: str = "rep"
) -> DataFrame:
    """Give each replication the forecasts of its test stations, where more than one takes part.

    The forecasts are stored once: the check and all replications read the stored rows.
    """
    forecasts = cut_lineage(forecasts)
    test = splits.where(F.col("split") == "test").select(rep, key)
    pairs = forecasts.select(key, period).distinct().join(test, key)
    shared = (
        pairs.groupBy(rep, period)
        .agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
        .where(F.col("_lo") != F.col("_hi"))
    )
    chosen = pairs.join(shared.select(rep, period), [rep, period], "left_semi")
    return forecasts.join(chosen, [key, period])


def replication_errors(
    forecasts: DataFrame, splits: DataFrame, key: str = "stid", period: str = "period", rep: str = "rep"
) -> DataFrame:
    """Errors by replication over what :func:`for_replications` would give it: n, bias, mse.

    Forecasts are summed per station and period first, so a station that many replications
    test costs each of them a row per period, not all its hours.
    """
    sums = forecasts.groupBy(key, period).agg(
        F.count("residual").alias("n"), F.sum("residual").alias("_e"), F.sum("squared_error").alias("_s")
    )
    test = splits.where(F.col("split") == "test").select(rep, key)
    by_period = sums.join(test, key).groupBy(rep, period).agg(
        F.count(F.lit(1)).alias("_k"), *[F.sum(c).alias(c) for c in ("n", "_e", "_s")]
    )
    several = by_period.where(F.col("_k") > 1).groupBy(rep).agg(*[F.sum(c).alias(c) for c in ("n", "_e", "_s")])
    return several.select(rep, "n", (F.col("_e") / F.col("n")).alias("bias"), (F.col("_s") / F.col("n")).alias("mse"))


def grid_forecast(
    cube: DataFrame,
    terrain: DataFrame,
    stats: DataFrame,
    features: Sequence[str],
    load_model: Callable[[], PredictFn],
    ts: str = "time",
    node: Sequence[str] = ("y", "x"),
    batch_size: int = 1024,
) -> DataFrame:
    """Forecast of every grid cell: terrain joined, features scaled, one sequence per cell scored.

    Returns ``node, step, ts, preds``. A cell's sequence is one forecast run, so its length
    is fixed; cells are spread by Spark and scored in batches.
    """
    scaled = scale(terrain_join(cube, terrain, node), stats, features)
    seqs = ordered_sequence(scaled, list(node), ts, features)
    return score_windows(seqs, list(node), "seq", features, load_model, ts, batch_size)


def forecast_runs(
    cube: DataFrame,
    terrain: DataFrame,
    features: Sequence[str],
    load_model: Callable[[], PredictFn],
    run: str,
    ts: str = "time",
    node: Sequence[str] = ("y", "x"),
    batch_size: int = 1024,
) -> DataFrame:
    """Forecasts of every grid cell and run, next to their inputs and the terrain's columns.

    One sequence is one run of one cell, so its length is the run's, however many runs a
    cell has. The joined cube is stored once; scaling statistics, scoring and the output
    read it from there.
    """
    joined = cut_lineage(terrain_join(cube, terrain, node), "grid-cube")
    keys = [*node, run]
    scaled = scale(joined, fit_standard(joined, features), features)
    preds = score_windows(ordered_sequence(scaled, keys, ts, features), keys, "seq", features, load_model, ts, batch_size)
    return joined.join(preds, [*keys, ts])
