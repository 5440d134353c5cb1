"""Column expressions for fuel moisture physics and fire behaviour."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, functions as F

KELVIN_AT_0C = 273.15
METRES_PER_FOOT = 0.3048


def drying_equilibrium(rh: Column, temp: Column) -> Column:
    """Moisture (%) that fuel dries toward; ``rh`` in %, ``temp`` in K."""
    return (
        0.924 * F.pow(rh, F.lit(0.679))
        + 0.000499 * F.exp(0.1 * rh)
        + 0.18 * (21.1 + KELVIN_AT_0C - temp) * (1 - F.exp(-0.115 * rh))
    )


def wetting_equilibrium(rh: Column, temp: Column) -> Column:
    """Moisture (%) that fuel wets toward; ``rh`` in %, ``temp`` in K."""
    return (
        0.618 * F.pow(rh, F.lit(0.753))
        + 0.000454 * F.exp(0.1 * rh)
        + 0.18 * (21.1 + KELVIN_AT_0C - temp) * (1 - F.exp(-0.115 * rh))
    )


def to_kelvin(temp: Column, unit: Column) -> Column:
    """Add 273.15 where the unit says Celsius; other units are left alone."""
    return F.when(unit.isin("Celsius", "C"), temp + KELVIN_AT_0C).otherwise(temp)


def kelvin_unit(unit: Column) -> Column:
    """Unit label that goes with :func:`to_kelvin`."""
    return F.when(unit.isin("Celsius", "C"), F.lit("Kelvin")).otherwise(unit)


def feet_to_metres(height: Column) -> Column:
    """Null-safe; a height of 0 stays 0."""
    return height * METRES_PER_FOOT


@dataclass(frozen=True)
class MoistureParams:
    """Fixed default values of the fuel moisture model and its filter."""

    r0: float = 0.05  # rain below this wets nothing (mm/h)
    rs: float = 8.0  # rain intensity of saturation (mm/h)
    tr: float = 14.0  # time constant of wetting by rain (h)
    s: float = 250.0  # saturation moisture (%)
    t: float = 10.0  # time constant of drying and wetting (h)
    q: float = 1e-3  # process variance
    r: float = 1e-3  # observation variance
    m_start: float = 0.1  # moisture before the first step
    hours: int = 72
    spinup: int = 24


def moisture_target_and_rate(
    m: Column, ed: Column, ew: Column, rain: Column, p: MoistureParams
) -> tuple[Column, Column]:
    """Equilibrium aimed at during one hour, and the rate (1/h) of approach."""
    raining = rain > p.r0
    target = F.when(raining, F.lit(p.s)).when(m <= ew, ew).when(m >= ed, ed).otherwise(m)
    rate = (
        F.when(raining, (1 - F.exp(-(rain - p.r0) / p.rs)) / p.tr)
        .when((m <= ew) | (m >= ed), F.lit(1 / p.t))
        .otherwise(F.lit(0.0))
    )
    return target, rate


def moisture_step(
    m: Column, ed: Column, ew: Column, rain: Column, p: MoistureParams = MoistureParams()
) -> Column:
    """Fuel moisture one hour later, without assimilation."""
    target, rate = moisture_target_and_rate(m, ed, ew, rain, p)
    return target + (m - target) * F.exp(-rate)


def moisture_class(fm: Column) -> Column:
    """Low [0,10), Med [10,20), High [20,inf); null below 0."""
    return F.when((fm >= 0) & (fm < 10), "Low").when((fm >= 10) & (fm < 20), "Med").when(fm >= 20, "High")


def is_high_elevation(elev: Column, limit: float = 1800.0) -> Column:
    return elev > limit


# Rate-of-spread curves as (fuel moisture %, spread rate m/s) knots.
CALM_MOISTURE = (0, 5, 10, 15, 20, 25, 30, 35)
CALM_SPREAD = (0.0075, 0.0043, 0.0031, 0.0026, 0.0021, 0.0014, 0, 0)
WINDY_MOISTURE = (
    0.00, 0.51, 1.02, 1.53, 2.03, 2.54, 3.05, 3.56, 4.07, 4.58, 5.08, 5.59,
    6.10, 6.61, 7.12, 7.63, 8.14, 8.64, 9.15, 9.66, 10.17, 10.68, 11.19, 11.69,
    12.20, 12.71, 13.22, 13.73, 14.24, 14.75, 15.25, 15.76, 16.27, 16.78, 17.29, 17.80,
    18.30, 18.81, 19.32, 19.83, 20.34, 20.85, 21.36, 21.86, 22.37, 22.88, 23.39, 23.90,
    24.41, 24.92, 25.42, 25.93, 26.44, 26.95, 27.46, 27.97, 28.48, 28.98, 29.49, 30.00, 30.51,
)
WINDY_SPREAD = (
    0.0955, 0.0898, 0.0845, 0.0796, 0.0752, 0.0711, 0.0674, 0.0641, 0.0610, 0.0582, 0.0556, 0.0533,
    0.0512, 0.0493, 0.0475, 0.0459, 0.0445, 0.0432, 0.0421, 0.0410, 0.0401, 0.0392, 0.0384, 0.0377,
    0.0370, 0.0364, 0.0358, 0.0352, 0.0347, 0.0342, 0.0337, 0.0332, 0.0327, 0.0322, 0.0317, 0.0311,
    0.0306, 0.0300, 0.0293, 0.0286, 0.0279, 0.0271, 0.0263, 0.0254, 0.0244, 0.0234, 0.0223, 0.0211,
    0.0199, 0.0185, 0.0171, 0.0156, 0.0140, 0.0123, 0.0105, 0.0086, 0.0066, 0.0045, 0.0023, 0.0, 0.0,
)


def spline_pieces(x, y) -> np.ndarray:
    """Cubic spline through the knots, third derivative continuous at the second and
    last-but-one knot. One row ``(a, b, c, d)`` per interval, in powers of ``x - left``.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    n, h = len(x), np.diff(x)
    slope = np.diff(y) / h
    a, rhs = np.zeros((n, n)), np.zeros(n)  # unknowns: second derivatives at the knots
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        rhs[i] = 6 * (slope[i] - slope[i - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, rhs)
    b = slope - h * (2 * m[:-1] + m[1:]) / 6
    return np.column_stack([y[:-1], b, m[:-1] / 2, np.diff(m) / (6 * h)])


def piecewise_cubic(x: Column, knots, pieces: np.ndarray) -> Column:
    """Evaluate the spline; outside the knots the end pieces are continued.

    The knots are close to evenly spaced, so the interval is guessed by division and
    corrected by one comparison on either side: no search, no join.
    """
    knots = [float(k) for k in knots]
    last = len(knots) - 2
    left = F.array(*[F.lit(k) for k in knots])
    step = (knots[-1] - knots[0]) / (len(knots) - 1)
    guess = F.least(F.greatest(F.floor((x - knots[0]) / step), F.lit(0)), F.lit(last))
    shift = F.when((guess < last) & (x >= F.get(left, guess + 1)), 1).when(
        (guess > 0) & (x < F.get(left, guess)), -1
    ).otherwise(0)
    i = guess + shift
    d = x - F.get(left, i)
    c = [F.get(F.array(*[F.lit(float(v)) for v in pieces[:, k]]), i) for k in range(4)]
    return c[0] + d * (c[1] + d * (c[2] + d * c[3]))


def _spread(fm: Column, knots, values) -> Column:
    return F.when(fm > 30, F.lit(0.0)).otherwise(piecewise_cubic(fm, knots, spline_pieces(knots, values)))


def spread_rate_calm(fm: Column) -> Column:
    """Rate of spread (m/s) against fuel moisture without wind; 0 above 30 %."""
    return _spread(fm, CALM_MOISTURE, CALM_SPREAD)


def spread_rate_windy(fm: Column) -> Column:
    """Rate of spread (m/s) against fuel moisture at 3 m/s wind; 0 above 30 %."""
    return _spread(fm, WINDY_MOISTURE, WINDY_SPREAD)


EARTH_RADIUS_KM = 6371.0


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance."""
    dlat = F.radians(lat2 - lat1)
    dlon = F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(dlon / 2), F.lit(2)
    )
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))
