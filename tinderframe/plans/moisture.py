"""Physics forecast: fuel moisture model with a Kalman-filtered start, per station and period."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tinderframe.functions.physics import MoistureParams, moisture_step
from tinderframe.functions.times import whole_hours_between
from tinderframe.operators.series import ordered_sequence


def _filter_batch(fm, ed, ew, rain, p: MoistureParams) -> tuple[np.ndarray, np.ndarray]:
    """Filter many series at once: arrays of shape (series, hours), stepping over hours.

    State: moisture ``m``, equilibrium bias ``c``, covariance ``p11, p12, p22``. The gain
    uses the covariance before the step and the forecast covariance is ``J' P J + Q``.
    """
    n, hours = fm.shape
    m, c = np.full(n, p.m_start), np.zeros(n)
    p11, p12, p22 = np.full(n, p.q), np.zeros(n), np.full(n, p.q)
    ms, cs = np.empty((n, hours)), np.empty((n, hours))
    ms[:, 0], cs[:, 0] = m, c
    for t in range(1, hours):
        d, w = ed[:, t] + c, ew[:, t] + c
        wet = rain[:, t] > p.r0
        low, high = m <= w, m >= d
        rain_rate = (1 - np.exp(-(rain[:, t] - p.r0) / p.rs)) / p.tr
        target = np.where(wet, p.s, np.where(low, w, np.where(high, d, m)))
        a = np.exp(-np.where(wet, rain_rate, np.where(low | high, 1 / p.t, 0.0)))
        b = 1 - a
        m = target + (m - target) * a
        assimilate = t < p.spinup
        noise = p.q if assimilate else 0.0
        f11 = a * a * p11 + noise
        f12 = a * b * p11 + a * p12
        f22 = b * b * p11 + 2 * b * p12 + p22 + noise
        if assimilate:
            k1, k2 = p11 / (p11 + p.r), p12 / (p11 + p.r)
            miss = m - fm[:, t]
            m, c = m - k1 * miss, c - k2 * miss
            f11, f12, f22 = f11 - k1 * p11, f12 - k1 * p12, f22 - k2 * p12
        p11, p12, p22 = f11, f12, f22
        ms[:, t], cs[:, t] = m, c
    return ms, cs


def kalman_forecast(
    df: DataFrame,
    keys: Sequence[str] = ("stid", "period"),
    ts: str = "date_time",
    params: MoistureParams = MoistureParams(),
) -> DataFrame:
    """Run the filter over each complete group of ``params.hours`` hourly rows.

    Needs ``fm, Ed, Ew, rain``. Returns one row per hour: keys, ``ts``, ``step``, ``fm``,
    ``m`` (moisture) and ``c`` (bias); a missing observation during the start leaves the
    rest of the period null. Groups with gaps give nothing. A group is one period, so its size is fixed; Spark
    spreads the groups, and each Arrow batch steps through time for all its series at once.
    """
    keys = list(keys)

    @F.pandas_udf("m array<double>, c array<double>")
    def run(fm: pd.Series, ed: pd.Series, ew: pd.Series, rain: pd.Series) -> pd.DataFrame:
        if len(fm) == 0:
            return pd.DataFrame({"m": [], "c": []})
        ms, cs = _filter_batch(*(np.vstack(s.to_list()).astype(float) for s in (fm, ed, ew, rain)), params)
        return pd.DataFrame({"m": list(ms), "c": list(cs)})

    seqs = ordered_sequence(df, keys, ts, ["fm", "Ed", "Ew", "rain"])
    length = whole_hours_between(F.element_at("seq", -1)[ts], F.element_at("seq", 1)[ts]) + 1
    seqs = seqs.where((F.size("seq") == params.hours) & (length == params.hours))
    state = run("seq.fm", "seq.Ed", "seq.Ew", "seq.rain")
    steps = seqs.select(*keys, "seq", state.alias("state")).select(
        *keys, F.posexplode(F.arrays_zip("seq", "state.m", "state.c")).alias("step", "z")
    )
    m, c = (F.nanvl(F.col(f"z.{x}"), F.lit(None)).alias(x) for x in ("m", "c"))
    return steps.select(*keys, F.col(f"z.seq.{ts}").alias(ts), "step", F.col("z.seq.fm").alias("fm"), m, c)


def forecast_hours(states: DataFrame, spinup: int = 24) -> DataFrame:
    """Forecast part of the filter output, next to the observation."""
    return states.where(F.col("step") >= spinup).withColumnRenamed("m", "preds").drop("c")


def free_run(
    df: DataFrame,
    keys: Sequence[str],
    ts: str = "date_time",
    start: Column | None = None,
    params: MoistureParams = MoistureParams(),
) -> DataFrame:
    """Moisture model without assimilation, from ``start`` (a column of the first row's group).

    A fold over the group's time-ordered array, wholly in built-in functions. Groups are
    periods; the fold appends one number per hour.
    """
    seqs = ordered_sequence(df, list(keys), ts, ["fm", "Ed", "Ew", "rain"])
    first = start if start is not None else F.lit(params.m_start)
    later = F.slice("seq", F.lit(2), F.greatest(F.size("seq") - 1, F.lit(0)))
    folded = F.aggregate(
        later,
        F.array(first.cast("double")),
        lambda acc, s: F.concat(
            acc, F.array(moisture_step(F.element_at(acc, -1), s["Ed"], s["Ew"], s["rain"], params))
        ),
    )
    steps = seqs.select(*keys, "seq", folded.alias("m")).select(
        *keys, F.posexplode(F.arrays_zip("seq", "m")).alias("step", "z")
    )
    return steps.select(*keys, F.col(f"z.seq.{ts}").alias(ts), "step", F.col("z.seq.fm").alias("fm"), "z.m")
