"""Climatology forecast: the mean of past readings at the same hour and time of year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tinderframe.functions.times import as_timestamp, time_range, yearly_anchors


_BROADCAST_MARKERS = 1_000_000  # counted beforehand; four years of hourly forecasts, some 40 MB


def _day(t: Column) -> Column:
    return F.unix_date(F.to_date(t))


def _edges(first: Column, last: Column) -> Column:
    """Where running totals must be read to get those of the days ``first..last``, by year.

    A total over some days is the running total at their end minus the one on the day
    before their start. A span that reaches into a second calendar year is cut there.
    """
    y0, y1 = (F.year(F.date_from_unix_date(d)) for d in (first, last))
    turn = F.unix_date(F.make_date(y0, F.lit(12), F.lit(31)))

    def edge(day: Column, sign: int, year: Column) -> Column:
        return F.struct(day.alias("_day"), F.lit(sign).alias("_sign"), year.alias("_year"))

    return F.when(y0 == y1, F.array(edge(first - 1, -1, y0), edge(last, 1, y0))).otherwise(
        F.array(edge(first - 1, -1, y0), edge(turn, 1, y0), edge(turn, -1, y1), edge(last, 1, y1))
    )


def climatology(
    obs: DataFrame,
    start,
    end,
    step: str = "1 hour",
    nyears: int = 10,
    ndays: int = 15,
    min_years: int = 6,
    key: str = "stid",
    ts: str = "date_time",
    value: str = "fm10",
) -> DataFrame:
    """Forecasts ``(stid, forecast_time, preds)`` for every stamp of ``[start, end]``.

    A forecast at ``t`` averages the readings whose hour lies ``ndays`` around a yearly
    anchor of ``t`` and before ``t``; it is null if they come from fewer than ``min_years``
    calendar years. Stations without a single forecast drop out.

    Joining readings to all ~325 stamps of each forecast would repeat every reading about
    31 times. Instead readings become one row per (station, hour), running totals are kept
    per (station, hour of day) in order of days, and each forecast reads them at the two
    ends of each anchor's span: 22 markers for ten years, linear in readings plus markers.
    All of it happens in the one partitioning by (station, hour of day), whose groups are
    bounded by the calendar.
    """
    if not 0 < ndays <= 180:
        raise ValueError("ndays must be in 1..180: anchors of different years may not overlap")
    first, last = as_timestamp(start), as_timestamp(end)
    reach = F.make_ym_interval(F.lit(nyears), F.lit(0))
    lookback = F.make_dt_interval(F.lit(ndays + 1))
    known = obs.where((F.col(ts) >= first - reach - lookback) & (F.col(ts) < last))
    number = F.when(~F.isnan(value), F.col(value))
    past = (
        known.groupBy(key, F.date_trunc("hour", ts).alias("_h"))
        .agg(F.sum(number).alias("_sum"), F.count(number).alias("_cnt"), F.count(F.lit(1)).alias("_rows"))
        .select(key, F.hour("_h").alias("_hod"), _day(F.col("_h")).alias("_day"), "_sum", "_cnt", "_rows")
    )
    t, anchor = F.col("forecast_time"), F.col("_a")
    # the span of the forecast's own year ends the day before t
    until = F.when(F.year(anchor) == F.year(t), _day(t) - 1).otherwise(_day(anchor) + ndays)
    calendar = (
        obs.sparkSession.range(1)
        .select(F.explode(time_range(start, end, step)).alias("forecast_time"))
        .select("forecast_time", F.explode(yearly_anchors(t, nyears)).alias("_a"))
        .select(F.hour(t).alias("_hod"), "forecast_time", F.inline(_edges(_day(anchor) - ndays, until)))
    )
    # the calendar is the same for all stations, so it is made once and joined by hour of day
    if calendar.count() <= _BROADCAST_MARKERS:
        calendar = F.broadcast(calendar)
    hours = F.explode(F.sequence(F.lit(0), F.lit(23))).alias("_hod")
    markers = known.select(key).distinct().select(key, hours).join(calendar, "_hod")
    rows = past.unionByName(markers, allowMissingColumns=True)
    # readings of a day (no forecast time, so first) come before the markers of that day
    upto = W.partitionBy(key, "_hod").orderBy("_day", "forecast_time").rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = {c: F.coalesce(F.sum(c).over(upto), F.lit(0)) for c in ("_sum", "_cnt", "_rows")}
    read = rows.withColumns(totals).where(t.isNotNull())
    by_year = read.groupBy(key, "_hod", "forecast_time", "_year").agg(
        *[F.sum(F.col("_sign") * F.col(c)).alias(c) for c in ("_sum", "_cnt", "_rows")]
    )
    mean = F.sum("_sum") / F.nullif(F.sum("_cnt"), F.lit(0))
    out = by_year.groupBy(key, "_hod", "forecast_time").agg(
        F.when(F.count_if(F.col("_rows") > 0) >= min_years, mean).alias("preds")
    )
    has_any = F.max(F.col("preds").isNotNull()).over(W.partitionBy(key))
    return out.withColumn("_any", has_any).where("_any").select(key, "forecast_time", "preds")


def climatology_errors(clim: DataFrame, observed: DataFrame, key: str = "stid", ts: str = "date_time") -> DataFrame:
    """Forecasts next to observations at the same (station, stamp); both must be known."""
    forecasts = clim.withColumnRenamed("forecast_time", ts).where(F.col("preds").isNotNull())
    return observed.where(F.col("fm").isNotNull()).join(forecasts, [key, ts])


def wide_forecasts(clim: DataFrame, times: Sequence, key: str = "stid") -> DataFrame:
    """Report with one column per given forecast time; the long form is the one to compute with."""
    names = F.date_format("forecast_time", "yyyy-MM-dd HH:mm:ss")
    stamps = [str(t) for t in times]
    return clim.withColumn("_t", names).groupBy(key).pivot("_t", stamps).agg(F.max("preds"))
