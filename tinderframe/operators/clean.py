"""Renames, range checks, masks, completeness and validity filters.

Everything but the group filters is a row-wise projection or predicate, so it fuses
into the scan stage and adds no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tinderframe.functions.times import DAY_SECONDS
from tinderframe.session import cut_lineage

# Physical bounds, both ends allowed.
PHYSICAL_BOUNDS = {
    "fm": (1, 90),
    "rain": (0, 100),
    "wind": (0, 35),
    "solar": (0, 1400),
    "temp": (230, 330),
    "soilm": (0, None),
}

# Source column name -> name used here.
SENSOR_NAMES = {
    "air_temp": "temp",
    "relative_humidity": "rh",
    "precip_accum": "precip_accum",
    "fuel_moisture": "fm",
    "wind_speed": "wind",
    "solar_radiation": "solar",
    "pressure": "pressure",
    "soil_moisture": "soilm",
    "soil_temp": "soilt",
    "snow_depth": "snowd",
    "snow_accum": "snow_accum",
    "wind_direction": "wind_direction",
    "latitude": "lat",
    "longitude": "lon",
    "elevation": "elev",
}
ARCHIVE_NAMES = {
    "STID": "stid",
    "datetime": "date_time",
    "fm10": "fm",
    "latitude": "lat",
    "longitude": "lon",
    "elevation": "elev",
}
SOIL_NAMES = {
    "longitude": "lon",
    "latitude": "lat",
    "soil_moisture": "soilw",
    "soil_moisture_error": "soilw_error",
    "soil_moisture_dca": "soilw_dca",
}

# Feature -> source names in order of preference, by weather layer.
GRID_LAYERS = {
    "2m": {"temp": ["t2m"], "rh": ["r2"]},
    "10m": {"wind": ["si10", "max_10si"]},
    "surface": {
        "rain": ["tp"],
        "solar": ["dswrf", "sdswrf"],
        "canopyw": ["cnwat"],
        "gflux": ["gflux"],
        "weasd": ["sdwe"],
        "asnow": ["unknown"],
        "snod": ["sde"],
        "pres": ["sp"],
        "rough": ["fsr"],
        "fricv": ["fricv"],
    },
    "axis": {"lat": ["latitude"], "lon": ["longitude"]},
}
# Derived feature -> what it is computed from.
DERIVED_FROM = {"Ed": ["rh", "temp"], "Ew": ["rh", "temp"], "hod": ["date_time"], "doy": ["date_time"]}
FEATURES = ["Ed", "Ew", "solar", "wind", "elev", "lon", "lat", "rain", "hod", "doy"]
FEATURE_TYPES = {f: "double" for f in FEATURES} | {"hod": "bigint", "doy": "bigint", "fm": "double"}


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename the columns that exist; a name missing from ``df`` is ignored."""
    return df.withColumnsRenamed(dict(names))


def rename_first_match(df: DataFrame, candidates: Mapping[str, Sequence[str]]) -> DataFrame:
    """``{new: [old, old, ...]}``: the first old name present gives the column."""
    found = {}
    for new, olds in candidates.items():
        old = next((o for o in olds if o in df.columns), None)
        if old is not None:
            found[old] = new
    return df.withColumnsRenamed(found)


def required_columns(features: Sequence[str]) -> dict[str, list[str]]:
    """Base columns needed for ``features``, by layer; derived ones bring what they need."""
    wanted: list[str] = []
    for f in features:
        wanted += DERIVED_FROM.get(f, [f])
    layer_of = {name: layer for layer, names in GRID_LAYERS.items() for name in names}
    out: dict[str, list[str]] = {}
    for name in dict.fromkeys(wanted):
        out.setdefault(layer_of.get(name, "table"), []).append(name)
    return out


def dependency_closure(wanted: DataFrame, needs: DataFrame) -> DataFrame:
    """(feature, base): the base columns that each wanted (feature) comes from.

    ``needs`` (feature, needs) lists what derived features are made of, several levels deep.
    A pair of feature and need is followed once, so features that need each other do no harm;
    such a feature has what else it rests on. What needs nothing is a base column, a wanted
    feature without needs its own.
    """
    reached = wanted.select("feature", F.col("feature").alias("base")).distinct()
    links = needs.select(F.col("feature").alias("_f"), F.col("needs").alias("_n")).where("_f is not null and _n is not null").distinct()
    edge = cut_lineage(links, "needs")
    seen = cut_lineage(reached, "closure")
    front = seen
    while True:
        step = front.join(edge, front["base"] == edge["_f"]).select("feature", F.col("_n").alias("base")).distinct()
        front = cut_lineage(step.join(seen, ["feature", "base"], "left_anti"), "closure-front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.join(edge.select(F.col("_f").alias("base")).distinct(), "base", "left_anti").select("feature", "base")


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items() if c in df.columns})


def nan_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing is NULL here; NaN would sort above every number and equal itself."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


def in_range(x: Column, low=None, high=None) -> Column:
    """``x`` if ``low <= x <= high``, else null. NaN is out of every range."""
    ok = ~F.isnan(x)
    if low is not None:
        ok = ok & (x >= low)
    if high is not None:
        ok = ok & (x <= high)
    return F.when(ok, x)


def null_out_of_range(df: DataFrame, bounds: Mapping[str, tuple] = PHYSICAL_BOUNDS) -> DataFrame:
    return df.withColumns({c: in_range(F.col(c), *b) for c, b in bounds.items() if c in df.columns})


def null_fill_value(x: Column, fill: float = -9999.0, tol: float = 0.0) -> Column:
    """Null where ``x`` is within ``tol`` of the fill value."""
    return F.when(F.abs(x - fill) > tol, x)


def land_only(x: Column, land: Column) -> Column:
    return F.when(land > 0, x)


def soil_moisture(x: Column, fill: float = -9999.0, valid_min: float = 0.02) -> Column:
    """Satellite soil moisture: fill value and anything below the valid minimum are null."""
    return F.when((x != fill) & (x >= valid_min), x)


def wrap_longitude(lon: Column) -> Column:
    return F.when(lon > 180, lon - 360).otherwise(lon)


def within_bbox(lat: Column, lon: Column, bbox: Sequence[float], inclusive: bool = True) -> Column:
    """``bbox`` is ``[lat_min, lon_min, lat_max, lon_max]``."""
    lat0, lon0, lat1, lon1 = bbox
    if inclusive:
        return lat.between(lat0, lat1) & lon.between(lon0, lon1)
    return (lat > lat0) & (lat < lat1) & (lon > lon0) & (lon < lon1)


def buffer_bbox(bbox: Sequence[float], degrees: float) -> list[float]:
    """Grow a box by ``degrees`` in longitude and 0.67 of that in latitude."""
    lat0, lon0, lat1, lon1 = bbox
    return [lat0 - 0.67 * degrees, lon0 - degrees, lat1 + 0.67 * degrees, lon1 + degrees]


def value_between(df: DataFrame, col: str, low: float, high: float) -> DataFrame:
    """Rows with ``low <= col < high``."""
    return df.where((F.col(col) >= low) & (F.col(col) < high))


def stations_with_variable(sensor_rows: DataFrame, station: str, variable: str, wanted: str) -> DataFrame:
    """Stations that report the wanted variable at all."""
    return sensor_rows.where(F.col(variable) == wanted).select(station).distinct()


def restrict(
    df: DataFrame, stations: DataFrame | None = None, key: str = "stid", ts: str = "date_time", start=None, end=None
) -> DataFrame:
    """Keep the listed stations and the closed time range."""
    if start is not None:
        df = df.where(F.col(ts) >= start)
    if end is not None:
        df = df.where(F.col(ts) <= end)
    if stations is not None:
        df = df.join(stations.select(key).distinct(), key, "left_semi")
    return df


def unknown_stations(df: DataFrame, stations: DataFrame, key: str = "stid") -> DataFrame:
    """Requested stations that the table does not have."""
    return stations.select(key).distinct().join(df, key, "left_anti")


def keep_complete_groups(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Keep groups of exactly ``n`` rows. For hourly tables, where a group is at most a period."""
    size = F.count(F.lit(1)).over(W.partitionBy(*keys))
    return df.withColumn("_n", size).where(F.col("_n") == n).drop("_n")


def periods_with_several_stations(df: DataFrame, period: Sequence[str], station: str = "stid") -> DataFrame:
    """Keep periods that more than one station takes part in.

    ``min <> max`` says so without a distinct count, and combines on the map side.
    """
    shared = (
        df.groupBy(*period)
        .agg(F.min(station).alias("_lo"), F.max(station).alias("_hi"))
        .where(F.col("_lo") != F.col("_hi"))
        .select(*period)
    )
    return df.join(shared, list(period), "left_semi")


def merge_intervals(intervals: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Union of overlapping closed intervals per key."""
    w = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("_reach") >= F.col(start), 0).otherwise(1)).over(
        w.rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        intervals.withColumn("_reach", reach)
        .withColumn("_island", island)
        .groupBy(*keys, "_island")
        .agg(F.min(start).alias(start), F.max(end).alias(end))
        .drop("_island")
    )


def drop_invalid_intervals(
    df: DataFrame,
    intervals: DataFrame,
    key: str = "stid",
    ts: str = "date_time",
    start: str = "start",
    end: str = "end",
    valid: str = "valid",
) -> DataFrame:
    """Drop rows inside any closed ``[start, end]`` marked ``valid = 0``.

    Intervals are cut at day borders and merged inside each (station, day), so a row meets
    at most the pieces of its own day: no comparison of all rows of a busy station with all
    its intervals, no task that holds a station's intervals, and the day spreads such a
    station over many tasks.
    """
    span = df.agg(F.struct(F.min(ts).alias("lo"), F.max(ts).alias("hi")).alias("s")).scalar()

    def day_of(t: Column) -> Column:
        return F.floor(F.unix_seconds(t) / DAY_SECONDS)

    first = F.greatest(F.col(start), span["lo"])
    last = F.least(F.col(end), span["hi"])
    border = lambda day: F.timestamp_seconds(day * DAY_SECONDS)
    pieces = (
        intervals.where((F.col(valid) == 0) & span["lo"].isNotNull() & (first <= last))
        .select(key, first.alias("_start"), last.alias("_end"), F.explode(F.sequence(day_of(first), day_of(last))).alias("_day"))
        .withColumns({"_start": F.greatest(F.col("_start"), border(F.col("_day"))), "_end": F.least(F.col("_end"), border(F.col("_day") + 1))})
    )
    pieces = merge_intervals(pieces, [key, "_day"], "_start", "_end")
    rows = df.withColumn("_day", day_of(F.col(ts)))
    inside = (
        (rows[key] == pieces[key])
        & (rows["_day"] == pieces["_day"])
        & rows[ts].between(pieces["_start"], pieces["_end"])
    )
    return rows.join(pieces, inside, "left_anti").drop("_day")


def unit_conflicts(sensor_rows: DataFrame, variable: str = "variable", units: str = "units") -> DataFrame:
    """Variables that do not have exactly one unit; an empty result means all is well."""
    return (
        sensor_rows.groupBy(variable)
        .agg(F.count_distinct(units).alias("n_units"))
        .where(F.col("n_units") != 1)
    )
