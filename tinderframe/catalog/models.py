"""Queries on splits, scaling, forecasts, trained models and grids."""

import numpy as np
from pyspark.sql import functions as F

from tinderframe.catalog.inputs import END, START, Inputs, query, r
from tinderframe.functions import physics as P, times as TM
from tinderframe.operators import evaluate as E, scale as SC, series as S, split as SP
from tinderframe.plans import build as B, climatology as CL, learners as L, moisture as M, tuning as TU
from tinderframe.session import stage_path
from tinderframe.sources import tables as TB

T = "date_time"
VAL = ("2024-01-20 00:00:00", "2024-01-20 01:00:00")
TEST = ("2024-01-21 00:00:00", "2024-01-22 23:00:00")
TRAIN = ("2024-01-01 00:00:00", "2024-01-19 23:00:00")


# --- coverage and splits ----------------------------------------------------------------


@query(
    "coverage_all",
    "occupied",
    f"""select stid from occupied where date_time between timestamp '{VAL[0]}' and timestamp '{VAL[1]}'
    group by stid having count(distinct date_time) = 2""",
)
def coverage_all(t: Inputs):
    return SP.stations_with_coverage(t.occupied, VAL)


@query(
    "coverage_any",
    "occupied",
    "select distinct stid from occupied where date_time between timestamp '2024-01-20 00:00' and timestamp '2024-01-20 01:00'",
)
def coverage_any(t: Inputs):
    return SP.stations_with_coverage(t.occupied, VAL, all_times=False)


def _split_sql(reps: int) -> str:
    """Ranks by hash over explicit lists: eligible stations, chosen, the rest."""
    return f"""reps as (select unnest(range({reps})) as rep), ids as (select distinct stid from occupied),
    n as (select cast(round_even(count(*) * 0.1, 0) as bigint) as n from ids),
    in_test as (select distinct stid from occupied where date_time between timestamp '{TEST[0]}' and timestamp '{TEST[1]}'),
    in_val as (select stid from occupied where date_time between timestamp '{VAL[0]}' and timestamp '{VAL[1]}'
      group by stid having count(distinct date_time) = 2),
    te as (select rep, stid from (select rep, stid, row_number() over (partition by rep order by md5(concat(7 + rep, '_', stid)), stid) as k
      from reps, in_test), n where k <= n.n),
    va as (select rep, stid from (select rep, stid, row_number() over (partition by rep order by md5(concat(7 + rep, '_val_', stid)), stid) as k
      from reps, in_val where not exists (select 1 from te where te.rep = reps.rep and te.stid = in_val.stid)), n where k <= n.n),
    splits as (select r0.rep, i.stid, case when te.stid is not null then 'test' when va.stid is not null then 'val' else 'train' end as split
      from reps r0 cross join ids i left join te on te.rep = r0.rep and te.stid = i.stid left join va on va.rep = r0.rep and va.stid = i.stid)"""


def _splits(t: Inputs, reps: int):
    return SP.spatial_split(t.occupied, VAL, TEST, frac=0.1, seed=7, reps=reps)


@query("spatial_split", "occupied", f"with {_split_sql(1)} select cast(rep as int) as rep, stid, split from splits")
def spatial_split(t: Inputs):
    return _splits(t, 1)


@query("rep_splits", "occupied", f"with {_split_sql(25)} select cast(rep as int) as rep, stid, split from splits")
def rep_splits(t: Inputs):
    return _splits(t, 25)


@query(
    "st_split",
    "occupied",
    f"""with {_split_sql(3)} select cast(rep as int) as rep, stid, split, epoch_us(date_time) as date_time, {r('fm')} as fm
    from splits join occupied using (stid)
    where (split = 'train' and date_time between timestamp '{TRAIN[0]}' and timestamp '{TRAIN[1]}')
      or (split = 'val' and date_time between timestamp '{VAL[0]}' and timestamp '{VAL[1]}')
      or (split = 'test' and date_time between timestamp '{TEST[0]}' and timestamp '{TEST[1]}')""",
)
def st_split(t: Inputs):
    return SP.spatiotemporal_split(t.occupied, _splits(t, 3), TRAIN, VAL, TEST).select("rep", "stid", "split", T, "fm")


@query(
    "sampled_keys",
    "pred",
    """select stid, rank from (select stid, row_number() over (order by md5(concat('11_', stid)), stid) as rank
    from (select distinct stid from pred)) where rank <= 5""",
)
def sampled_keys(t: Inputs):
    """Five stations in seeded order: the operator is a sample."""
    return SP.sample_keys(t.pred, 5, 11)


@query(
    "shuffled_batches",
    "",
    """select l_orderkey, l_linenumber, (row_number() over (order by md5(concat('3_', l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey)),
      l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1) // 64 as batch from lineitem""",
)
def shuffled_batches(t: Inputs):
    rows = t.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    b = SP.shuffled_batches(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 64, 3)
    return b.select("l_orderkey", "l_linenumber", "batch")


# --- scaling ------------------------------------------------------------------------------

_FIT_ROWS = "a as (select * from atm), f as (select * from atm where hr < 480)"
_X = ["rh", "temp", "rain"]


def _scaled(center: str, spread: str) -> str:
    cols = ", ".join(
        r(f"({c} - (select {center.format(c=c)} from f)) / (select case when {spread.format(c=c)} > 0 then {spread.format(c=c)} else 1 end from f)")
        + f" as {c}"
        for c in _X
    )
    return f"with {_FIT_ROWS} select stid, hr, {cols} from a"


@query("scale_std", "atm", _scaled("avg({c})", "stddev_pop({c})"))
def scale_std(t: Inputs):
    return SC.scale(t.atm, SC.fit_standard(t.atm.where("hr < 480"), _X), _X)


@query("scale_minmax", "atm", _scaled("min({c})", "(max({c}) - min({c}))"))
def scale_minmax(t: Inputs):
    return SC.scale(t.atm, SC.fit_minmax(t.atm.where("hr < 480"), _X), _X)


@query("inverse_scale", "atm", f"select stid, hr, {r('rh')} as rh, {r('temp')} as temp, {r('rain')} as rain from atm")
def inverse_scale(t: Inputs):
    stats = SC.fit_standard(t.atm.where("hr < 480"), _X)
    return SC.unscale(SC.scale(t.atm, stats, _X), stats, _X)


@query(
    "scale_windows",
    "occupied",
    f"""with s as (select stid, date_time, lead(date_time, 11) over (partition by stid order by date_time) as ends from occupied),
    w as (select * from s where ends = date_time + interval 11 hour),
    x as (select o.fm from w join occupied o on o.stid = w.stid and o.date_time between w.date_time and w.ends)
    select stid, epoch_us(date_time) as date_time, {r('''(fm - (select avg(fm) from x)) / (select stddev_pop(fm) from x)''')} as fm from occupied""",
)
def scale_windows(t: Inputs):
    """Fitted on all sequence windows, where a row counts once per window it is part of."""
    weighted = S.window_coverage(t.occupied, ["stid"], T, 12)
    return SC.scale(t.occupied, SC.fit_standard(weighted, ["fm"], weight="n_windows"), ["fm"])


# --- physics ------------------------------------------------------------------------------

_ED = "0.924 * pow(rh, 0.679) + 0.000499 * exp(0.1 * rh) + 0.18 * (21.1 + 273.15 - temp) * (1 - exp(-0.115 * rh))"
_EW = "0.618 * pow(rh, 0.753) + 0.000454 * exp(0.1 * rh) + 0.18 * (21.1 + 273.15 - temp) * (1 - exp(-0.115 * rh))"


@query(
    "equilibria",
    "weather",
    f"""select stid, epoch_us(date_time) as date_time, {r(_ED)} as "Ed", {r(_EW)} as "Ew",
      cast(hour(date_time) as int) as hod, cast(dayofyear(date_time) as int) as doy from weather""",
)
def equilibria(t: Inputs):
    return B.add_predictors(t.weather).select("stid", T, "Ed", "Ew", "hod", "doy")


def _spline_sql(p: str, knots, values) -> str:
    """Cubic spline solved in SQL: the tridiagonal system of second derivatives by two
    recursions, end rows from equal third derivatives at the second and last-but-one knot."""
    return f"""
    {p}k as (select unnest(range({len(knots)})) as i, unnest({[float(k) for k in knots]}::double[]) as x, unnest({[float(v) for v in values]}::double[]) as y),
    {p}h as (select i, x, y, lead(x) over w - x as h, (lead(y) over w - y) / (lead(x) over w - x) as s,
        x - lag(x) over w as g, (y - lag(y) over w) / (x - lag(x) over w) as q from {p}k window w as (order by i)),
    {p}q as (select i, case when i = {len(knots) - 2} then g - h * h / g else g end as a,
        2 * (g + h) + case when i = 1 then g * (g + h) / h when i = {len(knots) - 2} then h * (h + g) / g else 0 end as b,
        case when i = 1 then h - g * g / h else h end as c, 6 * (s - q) as d from {p}h where i between 1 and {len(knots) - 2}),
    {p}f as (select i, c / b as c, d / b as d from {p}q where i = 1
      union all select q.i, q.c / (q.b - q.a * f.c), (q.d - q.a * f.d) / (q.b - q.a * f.c) from {p}f f join {p}q q on q.i = f.i + 1),
    {p}b as (select i, d as m from {p}f where i = {len(knots) - 2}
      union all select f.i, f.d - f.c * b.m from {p}b b join {p}f f on f.i = b.i - 1),
    {p}m as (select i, m from {p}b
      union all select 0, ((h.g + h.h) * u.m - h.g * v.m) / h.h from {p}h h, {p}b u, {p}b v where h.i = 1 and u.i = 1 and v.i = 2
      union all select {len(knots) - 1}, ((h.g + h.h) * u.m - h.h * v.m) / h.g from {p}h h, {p}b u, {p}b v
        where h.i = {len(knots) - 2} and u.i = {len(knots) - 2} and v.i = {len(knots) - 3}),
    {p} as (select h.i, h.x, h.y, h.s - h.h * (2 * l.m + r.m) / 6 as b, l.m / 2 as c, (r.m - l.m) / (6 * h.h) as d
      from {p}h h join {p}m l on l.i = h.i join {p}m r on r.i = h.i + 1)"""


def _on_spline(p: str) -> str:
    u = f"(fm - {p}.x)"
    return r(f"1000 * case when fm > 30 then 0 else {p}.y + {u} * ({p}.b + {u} * ({p}.c + {u} * {p}.d)) end")


@query(
    "ros_curve",
    "obs",
    f"""with {_spline_sql("calm", P.CALM_MOISTURE, P.CALM_SPREAD)}, {_spline_sql("windy", P.WINDY_MOISTURE, P.WINDY_SPREAD)}
    select stid, epoch_us(date_time) as date_time, {_on_spline("calm")} as calm, {_on_spline("windy")} as windy
    from obs asof join calm on greatest(fm, 0) >= calm.x asof join windy on greatest(fm, 0) >= windy.x""",
)
def ros_curve(t: Inputs):
    fm = F.col("fm")
    return t.obs.select(
        "stid", T, (1000 * P.spread_rate_calm(fm)).alias("calm"), (1000 * P.spread_rate_windy(fm)).alias("windy")
    )


def forced(t: Inputs):
    """Hourly moisture readings with weather; cells without weather get mild defaults."""
    mild = {"rh": 50.0, "temp": 288.15, "rain": 0.0}
    return B.add_predictors(t.hourly.join(t.weather, ["stid", T], "left").na.fill(mild))


# a first hour of 0-based step 0, then one step per recursion
_FORCED = f"""
    forced as (select h.stid, h.date_time, h.fm, {_ED} as ed, {_EW} as ew, rain from (
      select h.stid, h.date_time, h.fm, coalesce(rh, 50) as rh, coalesce(temp, 288.15) as temp, coalesce(rain, 0) as rain
      from hourly h left join weather w on w.stid = h.stid and w.date_time = h.date_time) h),
    steps as (select stid, period, date_diff('hour', timestamp '{START}' + interval 48 hour * period, date_time) as step, date_time, fm, ed, ew, rain
      from forced join (select unnest(range(14)) as period) k on date_time >= timestamp '{START}' + interval 48 hour * period
        and date_time < timestamp '{START}' + interval 48 hour * period + interval 72 hour)
"""
_KALMAN = f"""{_FORCED},
    kf as (
      select stid, period, step, 0.1::double as m, 0.0::double as c, 1e-3::double as p11, 0.0::double as p12, 1e-3::double as p22
      from steps where step = 0
      union all
      select stid, period, step, case when step < 24 then mf - k1 * (mf - fm) else mf end, case when step < 24 then c - k2 * (mf - fm) else c end,
        case when step < 24 then f11 - k1 * p11 else f11 end, case when step < 24 then f12 - k1 * p12 else f12 end,
        case when step < 24 then f22 - k2 * p12 else f22 end
      from (select *, e + (m - e) * a as mf, a * a * p11 + q as f11, a * (1 - a) * p11 + a * p12 as f12,
              (1 - a) * (1 - a) * p11 + 2 * (1 - a) * p12 + p22 + q as f22, p11 / (p11 + 1e-3) as k1, p12 / (p11 + 1e-3) as k2
        from (select *, exp(-rate) as a, case when step < 24 then 1e-3 else 0 end as q
          from (select s.stid, s.period, s.step, s.fm, k.m, k.c, k.p11, k.p12, k.p22,
              case when s.rain > 0.05 then 250.0::double when k.m <= s.ew + k.c then s.ew + k.c when k.m >= s.ed + k.c then s.ed + k.c else k.m end as e,
              case when s.rain > 0.05 then (1 - exp(-(s.rain - 0.05) / 8)) / 14 when k.m <= s.ew + k.c or k.m >= s.ed + k.c then 0.1 else 0 end as rate
            from kf k join steps s on s.stid = k.stid and s.period = k.period and s.step = k.step + 1))))
"""


@query(
    "kalman_forecast",
    "hourly weather",
    f"""with {_KALMAN} select k.stid, k.period, cast(k.step as int) as step, epoch_us(s.date_time) as date_time, {r('fm')} as fm, {r('m')} as m, {r('c')} as c
    from kf k join steps s on s.stid = k.stid and s.period = k.period and s.step = k.step""",
)
def kalman_forecast(t: Inputs):
    return M.kalman_forecast(S.spinup_periods(forced(t), T, "2024-01-02 00:00:00", 14))


@query(
    "physics_errors",
    "hourly weather",
    f"""with {_KALMAN}, e as (select s.stid, s.fm - k.m as e from kf k join steps s on s.stid = k.stid and s.period = k.period and s.step = k.step where k.step >= 24)
    select stid, count(*) as n, {r('avg(e)')} as bias, {r('avg(abs(e))')} as mae, {r('avg(e * e)')} as mse from e group by rollup(stid)""",
)
def physics_errors(t: Inputs):
    """Readings to hourly series to filtered forecasts to errors, by station and overall."""
    errors = B.physics_forecast(forced(t), "2024-01-02 00:00:00", 14)
    return errors.rollup("stid").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("residual").alias("bias"),
        F.avg("abs_error").alias("mae"),
        F.avg("squared_error").alias("mse"),
    )


@query(
    "physics_by_rep",
    "hourly weather occupied",
    f"""with {_split_sql(25)}, {_KALMAN},
    e as (select s.stid, s.period, s.fm - k.m as e from kf k join steps s on s.stid = k.stid and s.period = k.period and s.step = k.step where k.step >= 24),
    several as (select rep, period from (select distinct stid, period from e) p join te using (stid) group by rep, period having count(distinct stid) > 1)
    select cast(te.rep as int) as rep, count(*) as n, {r('avg(e)')} as bias, {r('avg(e * e)')} as mse
    from e join te on te.stid = e.stid join several v on v.rep = te.rep and v.period = e.period group by te.rep""",
)
def physics_by_rep(t: Inputs):
    """One forecast run serves the test stations of all replications."""
    return B.replication_errors(B.physics_forecast(forced(t), "2024-01-02 00:00:00", 14), _splits(t, 25))


@query(
    "moisture_step",
    "hourly weather",
    f"""with {_FORCED}, fr as (select stid, period, step, fm as m from steps where step = 0
      union all select stid, period, step, e + (m - e) * exp(-rate) from (
        select s.stid, s.period, s.step, k.m,
          case when rain > 0.05 then 250.0::double when m <= ew then ew when m >= ed then ed else m end as e,
          case when rain > 0.05 then (1 - exp(-(rain - 0.05) / 8)) / 14 when m <= ew or m >= ed then 0.1 else 0 end as rate
        from fr k join steps s on s.stid = k.stid and s.period = k.period and s.step = k.step + 1))
    select stid, period, cast(step as int) as step, {r('m')} as m from fr""",
)
def moisture_step(t: Inputs):
    """Free run of the model from the first reading of each period."""
    placed = S.spinup_periods(forced(t), T, "2024-01-02 00:00:00", 14)
    start = F.element_at("seq", 1)["fm"]
    return M.free_run(placed, ["stid", "period"], start=start).select("stid", "period", "step", "m")


# --- climatology --------------------------------------------------------------------------


def _climatology_sql(start: str, end: str) -> str:
    return f"""f as (select t from generate_series(timestamp '{start}', timestamp '{end}', interval 1 day) g(t)),
    anchors as (select t, (t - interval 5 year) + interval 1 year * i as a from f, (select unnest(range(6)) as i)),
    stamps as (select distinct t, a + interval 1 day * d as s from anchors, (select unnest(range(-15, 16)) as d) where a + interval 1 day * d < t),
    matched as (select stid, t, date_time, fm10 from hist join stamps on date_trunc('hour', date_time) = date_trunc('hour', s)),
    means as (select stid, t, case when count(distinct year(date_time)) >= 4 then avg(fm10) end as preds from matched group by stid, t),
    clim as (select ids.stid, f.t as forecast_time, m.preds from (select stid from means group by stid having count(preds) > 0) ids cross join f
      left join means m on m.stid = ids.stid and m.t = f.t)"""


@query(
    "climatology",
    "hist",
    f"""with {_climatology_sql('2001-06-01', '2001-06-30')} select stid, epoch_us(forecast_time) as forecast_time, {r('preds')} as preds from clim""",
)
def climatology(t: Inputs):
    return CL.climatology(t.hist, "2001-06-01 00:00:00", "2001-06-30 00:00:00", "1 day", 5, 15, 4)


@query(
    "climatology_leap",
    "hist",
    f"""with {_climatology_sql('2000-02-20', '2000-03-10')} select stid, epoch_us(forecast_time) as forecast_time, {r('preds')} as preds from clim""",
)
def climatology_leap(t: Inputs):
    """Across 29 February, whose anchors are all 28 February."""
    return CL.climatology(t.hist, "2000-02-20 00:00:00", "2000-03-10 00:00:00", "1 day", 5, 15, 4)


@query(
    "clim_eval",
    "hist",
    f"""with {_climatology_sql('2001-06-01', '2001-06-30')}, o as (select stid, date_time, avg(fm10) as fm from hist group by 1, 2)
    select clim.stid, count(*) as n, {r('avg(fm - preds)')} as bias, {r('avg((fm - preds) * (fm - preds))')} as mse
    from clim join o on o.stid = clim.stid and o.date_time = clim.forecast_time where preds is not null and fm is not null group by clim.stid""",
)
def clim_eval(t: Inputs):
    clim = CL.climatology(t.hist, "2001-06-01 00:00:00", "2001-06-30 00:00:00", "1 day", 5, 15, 4)
    seen = t.hist.groupBy("stid", T).agg(F.avg("fm10").alias("fm"))
    return (
        E.residuals(CL.climatology_errors(clim, seen))
        .groupBy("stid")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("residual").alias("bias"), F.avg("squared_error").alias("mse"))
    )


# --- learning table -------------------------------------------------------------------------

_CHECKED = f"""
    ok as (select stid, date_time, fm from obs where fm >= 1 and fm <= 90),
    allm as (select stid, h as date_time from (select distinct stid from ok), generate_series(timestamp '{START}', timestamp '{END}', interval 1 hour) s(h)),
    pl as (select stid, epoch_us(date_time) as us, epoch_us(date_time) as kus, fm, 0 as mark from ok union all select stid, epoch_us(date_time), null, null, 1 from allm),
    br as (select stid, us, mark, last_value(kus ignore nulls) over l as t0, last_value(fm ignore nulls) over l as v0,
        first_value(kus ignore nulls) over f as t1, first_value(fm ignore nulls) over f as v1 from pl
      window l as (partition by stid order by us, mark rows between unbounded preceding and current row),
        f as (partition by stid order by us, mark desc rows between current row and unbounded following)),
    hr as (select stid, make_timestamp(us) as date_time, case when t0 is null then v1 when t1 is null or t1 = t0 then v0
      else v0 + (v1 - v0) / (t1 - t0) * (us - t0) end as fm from br where mark = 1),
    merged as (select hr.stid, hr.date_time, fm, rain, {_ED} as ed, {_EW} as ew from hr join weather w on w.stid = hr.stid and w.date_time = hr.date_time),
    nb as (select *, (row_number() over (partition by stid order by date_time) - 1) // 72 as blk from merged),
    df as (select *, (fm - lag(fm) over w) - (lag(fm) over w - lag(fm, 2) over w) as d from nb window w as (partition by stid, blk order by date_time)),
    zr as (select stid, blk, coalesce(d = 0, false) as z, row_number() over (partition by stid, blk order by date_time) as rn from df),
    bad as (select distinct stid, blk from (select stid, blk, count(*) as len from (
      select stid, blk, rn - row_number() over (partition by stid, blk order by rn) as isl from zr where z) group by stid, blk, isl) where len > 3)
"""


@query(
    "learning_table",
    "obs weather",
    f"""with {_CHECKED} select stid, epoch_us(date_time) as date_time, {r('fm')} as fm, {r('ed')} as "Ed", {r('ew')} as "Ew", {r('rain')} as rain,
      blk as st_period from nb where not exists (select 1 from bad where bad.stid = nb.stid and bad.blk = nb.blk)""",
)
def learning_table(t: Inputs):
    """Range check, hourly grid, weather, straight-line blocks removed: the whole data build."""
    table = B.learning_table(t.obs, t.weather, START, END)
    return table.select("stid", T, "fm", "Ed", "Ew", "rain", "st_period")


@query(
    "weather_filled",
    "weather",
    f"""with g as (select stid, date_time, epoch_us(date_time) as us, case when rh < 60 then rh end as rh, case when rain = 0 then temp end as temp from weather),
    n as (select *, last_value(case when rh is not null then us end ignore nulls) over l as r0, last_value(rh ignore nulls) over l as x0,
        first_value(case when rh is not null then us end ignore nulls) over f as r1, first_value(rh ignore nulls) over f as x1,
        last_value(case when temp is not null then us end ignore nulls) over l as s0, last_value(temp ignore nulls) over l as y0,
        first_value(case when temp is not null then us end ignore nulls) over f as s1, first_value(temp ignore nulls) over f as y1 from g
      window l as (partition by stid order by us rows between unbounded preceding and current row),
        f as (partition by stid order by us rows between current row and unbounded following))
    select stid, us as date_time, {r('case when r0 is null then x1 when r1 is null or r1 = r0 then x0 else x0 + (x1 - x0) / (r1 - r0) * (us - r0) end')} as rh,
      {r('case when s0 is null then y1 when s1 is null or s1 = s0 then y0 else y0 + (y1 - y0) / (s1 - s0) * (us - s0) end')} as temp from n""",
)
def weather_filled(t: Inputs):
    """Missing weather values interpolated over the hours a station has."""
    gaps = t.weather.withColumns(
        {"rh": F.when(F.col("rh") < 60, F.col("rh")), "temp": F.when(F.col("rain") == 0, F.col("temp"))}
    )
    return S.fill_missing(gaps, ["stid"], T, ["rh", "temp"]).select("stid", T, "rh", "temp")


@query(
    "atm_merge",
    "hourly weather",
    f"""select h.stid, epoch_us(h.date_time) as date_time, {r('h.fm')} as fm, {r('w.rh')} as rh, {r('w.temp + 1')} as temp, {r('w.temp')} as temp_atm
    from (select *, 0 as x from hourly) h join weather w on w.stid = h.stid and w.date_time = h.date_time""",
)
def atm_merge(t: Inputs):
    """A column both sides have keeps its name on the station side."""
    station = t.hourly.join(t.weather.select("stid", T, (F.col("temp") + 1).alias("temp")), ["stid", T])
    return B.merge_weather(station, t.weather.drop("rain")).select("stid", T, "fm", "rh", "temp", "temp_atm")


# --- trained models -------------------------------------------------------------------------

FEATURES = ["Ed", "Ew", "rain", "hod"]
CUT = "2024-01-24 00:00:00"


def _train_test(t: Inputs):
    table = forced(t)
    return table.where(F.col(T) < CUT), table.where(F.col(T) >= CUT)


def _evaluated(model, test):
    scored = E.residuals(L.predict(model, test))
    return scored.groupBy("stid").agg(
        F.count(F.lit(1)).alias("n"), F.avg("residual").alias("bias"), F.avg("squared_error").alias("mse")
    )


def _scrambled_sql(x: str) -> str:
    for _ in range(2):
        x = f"((xor(({x}) >> 16, {x}) * 73244475) & 4294967295)"
    return f"xor({x} >> 16, {x})"


def _gain_sql(l2: float) -> str:
    return f"(g * g / (h + {l2}) + (gs - g) * (gs - g) / (hs - h + {l2}) - gs * gs / (hs + {l2})) * 1e-4::double * 1e-4::double"


# rows as integers, their 32-bit keys, and the features as bin numbers
_BINNED = f"""a as materialized (
  select row_number() over (order by stid, date_time) as id, stid, fm, date_time < timestamp '{CUT}' as is_train,
    [round(ed, 6), round(ew, 6), round(rain, 6), hour(date_time)::double] as x, floor(fm / 1e-4::double + 0.5::double)::bigint as y,
    ('0x' || substr(md5(concat(stid, '_', epoch_us(date_time) // 1000000)), 1, 8))::bigint as k from forced),
xs as (select id, is_train, f, x[f] as x from a, (select unnest(range(1, 5)) as f)),
ranked as (select f, x, row_number() over (partition by f order by x) as rn, count(*) over (partition by f) as n from xs where is_train),
edges as (select f, x, row_number() over (partition by f order by x) as b
  from (select distinct f, x from ranked semi join (select f, ceil(i / 256::double * n)::bigint as rn from (select distinct f, n from ranked), (select unnest(range(1, 256)) as i)) q
        on ranked.f = q.f and ranked.rn = q.rn)),
bins as materialized (select xs.id, xs.f, coalesce(edges.b, 0) as bin from xs asof left join edges on xs.f = edges.f and xs.x > edges.x)"""


def _level_sql(level: int, tree: str, l2: float, rate: float, least_gain: float, allowed: str) -> str:
    """One level of splits: from v<level> (tree, id, node, value, w, r) to v<level + 1>."""
    n = level
    return f"""
s{n} as materialized (select v.{tree}, node, f, bin, sum(w)::double as h, sum(w * r)::double as g
  from v{n} v join bins using (id) where w > 0 and node >= {2**n - 1} group by all),
c{n} as (select *, sum(h) over (partition by {tree}, node, f) as hs, sum(g) over (partition by {tree}, node, f) as gs,
    sum(h) over p as hl, sum(g) over p as gl from s{n} window p as (partition by {tree}, node, f order by bin)),
d{n} as (select {tree}, node, f, bin, hl as h, gl as g, hs, gs from c{n}),
e{n} as materialized (select * from (select *, row_number() over (partition by {tree}, node order by gain desc, f, bin) as place
    from (select d.*, {_gain_sql(l2)} as gain from d{n} d where h >= 1 and hs - h >= 1 and {allowed}))
  where place = 1 and gain > 1e-6 and gain >= {least_gain}),
v{n + 1} as materialized (select v.{tree}, v.id, v.w, v.r,
    case when e.f is null then v.node else 2 * v.node + 1 + (b.bin > e.bin)::int end as node,
    case when e.f is null then v.value when b.bin > e.bin then floor({rate}::double * ((e.gs - e.g) / (e.hs - e.h + {l2})) + 0.5::double)::bigint
         else floor({rate}::double * (e.g / (e.h + {l2})) + 0.5::double)::bigint end as value
  from v{n} v left join e{n} e on e.{tree} = v.{tree} and e.node = v.node and v.node >= {2**n - 1} left join bins b on b.id = v.id and b.f = e.f),"""


_ROUNDS = "\n".join(_level_sql(n, "t", 1.0, 0.1, 0.1, "d.f in (select f from cols)") for n in range(3)).rstrip(",")
_BOOSTED_SQL = f"""with {_FORCED}, {_BINNED},
st as (
  select 0::bigint as t, id, (select floor(sum(y)::double / count(*) + 0.5::double)::bigint from a where is_train) as margin from a
  union all (
  with now as (select t, {_scrambled_sql("(42 * 65537 + t)::bigint")} as us, {_scrambled_sql("(43 * 65537 + t * 64)::bigint")} as cs from (select max(t) as t from st)),
  cols as (select f from (select f, row_number() over (order by {_scrambled_sql("xor(cs, f)")}, f) as k from now, (select unnest(range(1, 5)) as f)) where k <= 3),
  w as (select now.t, st.id, st.margin, a.y - st.margin as r, (a.is_train and {_scrambled_sql("xor(us, k)")} < 0.8::double * 4294967296)::int as w
    from st join a on a.id = st.id, now),
  v0 as materialized (select t, id, w, r, 0 as node, (select floor(0.1::double * (sum(w * r)::double / (sum(w)::double + 1)) + 0.5::double)::bigint from w) as value from w),
  {_ROUNDS}
  select st.t + 1, st.id, st.margin + v3.value from st join v3 on v3.id = st.id where st.t < 100))
select stid, count(*) as n, {r('avg(fm - margin * 1e-4::double)')} as bias, {r('avg(pow(fm - margin * 1e-4::double, 2))')} as mse
from st join a on a.id = st.id where t = 100 and not is_train group by stid"""


def _rounded_features(df):
    return df.withColumns({c: F.round(c, 6) for c in ("Ed", "Ew", "rain")})


def _trees_eval(t: Inputs, settings):
    train, test = (_rounded_features(df).withColumn("seconds", F.unix_seconds(T)) for df in _train_test(t))
    return _evaluated(L.fit(settings, train, FEATURES, key=["stid", "seconds"]), test)


@query("gbt_eval", "hourly weather", _BOOSTED_SQL)
def gbt_eval(t: Inputs):
    """Boosted trees with their documented settings, all hundred rounds."""
    return _trees_eval(t, L.boosted_trees())


_TAKEN = " + ".join(f"(u >= floor(4294967296::double * exp(-1) * {c}::double))::int" for c in ("1", "2", "2.5", "(8 / 3)", "(65 / 24)", "(163 / 60)", "(1957 / 720)", "(685 / 252)"))
_ALLOWED = "d.f in (select c.f from cols c where c.t = d.t and c.node = d.node)"
_FOREST_SQL = f"""with {_FORCED}, {_BINNED},
seeds as (select t, {_scrambled_sql("(42 * 65537 + t)::bigint")} as s from (select unnest(range(25)) as t)),
cols as materialized (select t, node, f from (select t, node, f, row_number() over (partition by t, node order by {_scrambled_sql("xor(cs, f)")}, f) as k
  from (select t, node, {_scrambled_sql("43 * 65537 + t * 64 + node")} as cs from (select unnest(range(25)) as t), (select unnest(range(31)) as node)), (select unnest(range(1, 5)) as f)) where k <= 3),
u as (select t, id, y, is_train, {_scrambled_sql("xor(s, k)")} as u from a, seeds),
v0 as materialized (select t, id, case when is_train then {_TAKEN} else 0 end as w, y as r, 0 as node, 0::bigint as value from u),
{"".join(_level_sql(n, "t", 0.0, 1.0, 0.0, _ALLOWED) for n in range(5))}
p as (select id, sum(value) / 25::double * 1e-4::double as preds from v5 group by id)
select stid, count(*) as n, {r('avg(fm - preds)')} as bias, {r('avg(pow(fm - preds, 2))')} as mse from p join a using (id) where not is_train group by stid"""


@query("rf_eval", "hourly weather", _FOREST_SQL)
def rf_eval(t: Inputs):
    """A forest of bootstrapped trees with their documented settings."""
    return _trees_eval(t, L.random_forest())


@query(
    "lm_eval",
    "hourly weather",
    f"""with {_FORCED}, tr as (select * from forced where date_time < timestamp '{CUT}'), te as (select * from forced where date_time >= timestamp '{CUT}'),
    b as (select regr_slope(fm, ed) as s, regr_intercept(fm, ed) as i from tr)
    select stid, count(*) as n, {r('avg(fm - (i + s * ed))')} as bias, {r('avg(pow(fm - (i + s * ed), 2))')} as mse from te, b group by stid""",
)
def lm_eval(t: Inputs):
    """Linear model on one predictor, so that the line is also known in closed form."""
    train, test = _train_test(t)
    return _evaluated(L.fit(L.linear_model(), train, ["Ed"]), test)


@query(
    "null_scoring",
    "hourly weather",
    f"""with {_FORCED}, tr as (select * from forced where date_time < timestamp '{CUT}'),
    te as (select *, case when hour(date_time) % 7 > 0 then ed end as x from forced where date_time >= timestamp '{CUT}'),
    b as (select regr_slope(fm, ed) as s, regr_intercept(fm, ed) as i from tr)
    select stid, count(*) as n, count(x) as scored, {r('avg(i + s * x)')} as preds from te, b group by stid""",
)
def null_scoring(t: Inputs):
    """Rows whose predictor is missing are counted and have no prediction."""
    train, test = _train_test(t)
    test = test.withColumn("Ed", F.when(F.hour(T) % 7 > 0, F.col("Ed")))
    scored = L.predict(L.fit(L.linear_model(), train, ["Ed"]), test)
    return scored.groupBy("stid").agg(F.count(F.lit(1)).alias("n"), F.count("preds").alias("scored"), F.avg("preds").alias("preds"))


@query(
    "lm_weighted",
    "hourly weather",
    f"""with {_FORCED}, tr as (select *, hour(date_time) + 1 as w from forced where date_time < timestamp '{CUT}'),
    te as (select * from forced where date_time >= timestamp '{CUT}'),
    m as (select sum(w * ed) / sum(w) as mx, sum(w * fm) / sum(w) as my from tr),
    b as (select sum(w * (ed - mx) * (fm - my)) / sum(w * (ed - mx) * (ed - mx)) as s, any_value(mx) as mx, any_value(my) as my from tr, m)
    select stid, count(*) as n, {r('avg(fm - (my + s * (ed - mx)))')} as bias, {r('avg(pow(fm - (my + s * (ed - mx)), 2))')} as mse from te, b group by stid""",
)
def lm_weighted(t: Inputs):
    """Rows weighted by hour of day plus one."""
    train, test = _train_test(t)
    train = train.withColumn("w", (F.col("hod") + 1).cast("double"))
    return _evaluated(L.fit(L.linear_model(), train, ["Ed"], weight="w"), test)


@query(
    "linreg_1d",
    "",
    f"""select l_returnflag, {r('regr_slope(l_extendedprice, l_quantity)')} as slope, {r('regr_intercept(l_extendedprice, l_quantity)')} as intercept,
      cast(regr_count(l_extendedprice, l_quantity) as bigint) as n from lineitem group by 1""",
)
def linreg_1d(t: Inputs):
    return L.fit_line(t.table("lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])


@query(
    "feature_matrix",
    "hourly weather",
    f"""with {_FORCED} select stid, epoch_us(date_time) as date_time, {r('fm')} as fm, {r('ed')} as f0, {r('ew')} as f1, {r('rain')} as f2 from forced""",
)
def feature_matrix(t: Inputs):
    from pyspark.ml.functions import vector_to_array

    m = L.feature_matrix(forced(t), ["Ed", "Ew", "rain"], keep=["stid", T, "fm"])
    v = vector_to_array("features")
    return m.select("stid", T, "fm", *[F.get(v, i).alias(f"f{i}") for i in range(3)])


def _toy_model():
    """Stands for a trained sequence network: a weighted sum plus a trace of the last hour."""

    def predict(x: np.ndarray) -> np.ndarray:
        y = x @ np.array([0.5, 0.3, -0.2])
        y[:, 1:] += 0.1 * x[:, :-1, 0]
        return y

    return predict


@query(
    "score_windows",
    "hourly weather",
    f"""with {_FORCED}, p as (select *, date_diff('hour', timestamp '{START}', date_time) // 48 as period from forced),
    q as (select *, row_number() over w - 1 as step, lag(ed) over w as before from p window w as (partition by stid, period order by date_time))
    select stid, period, cast(step as int) as step, epoch_us(date_time) as date_time,
      {r('0.5 * ed + 0.3 * ew - 0.2 * rain + 0.1 * coalesce(before, 0)')} as preds from q""",
)
def score_windows(t: Inputs):
    """An external model scores one 48-hour sequence per station and period."""
    seqs = S.ordered_sequence(S.forecast_periods(forced(t), T, START), ["stid", "period"], T, ["Ed", "Ew", "rain"])
    return L.score_windows(seqs, ["stid", "period"], "seq", ["Ed", "Ew", "rain"], _toy_model)


def _small_model():
    """The toy model on a machine that holds a hundred sequences."""

    def predict(x: np.ndarray) -> np.ndarray:
        if len(x) > 100:
            raise MemoryError(f"no room for {len(x)} sequences")
        return _toy_model()(x)

    return predict


@query(
    "score_fallback",
    "hourly weather",
    f"""with {_FORCED}, p as (select *, date_diff('hour', timestamp '{START}', date_time) // 2 as period from forced),
    q as (select *, row_number() over w - 1 as step, lag(ed) over w as before from p window w as (partition by stid, period order by date_time))
    select stid, period, cast(step as int) as step, epoch_us(date_time) as date_time,
      {r('0.5 * ed + 0.3 * ew - 0.2 * rain + 0.1 * coalesce(before, 0)')} as preds from q""",
)
def score_fallback(t: Inputs):
    """Two-hour sequences, thousands of them, for a model that fails above a hundred."""
    seqs = S.ordered_sequence(S.forecast_periods(forced(t), T, START, 2), ["stid", "period"], T, ["Ed", "Ew", "rain"])
    return L.score_windows(seqs, ["stid", "period"], "seq", ["Ed", "Ew", "rain"], _small_model)


_SENSORS = {"click": "air_temp", "view": "relative_humidity", "purchase": "precip_accum", "signup": "fuel_moisture"}


@query(
    "sensor_series",
    "",
    f"""with ev as (select user_id % 16 as stid, epoch_us(ts) as us, event_type as var,
        case when event_type = 'click' then value / 20 + 273.15 when event_type = 'view' then least(value, 100) else value end as v
      from events where event_type in ('click', 'view', 'purchase', 'signup')),
    hrs as (select stid, var, epoch_us(h) as us from (select distinct stid, var from ev),
      generate_series(timestamp '{START}', timestamp '{END}', interval 1 hour) g(h)),
    u as (select stid, var, us, us as kus, v, 0 as mark from ev union all select stid, var, us, null, null, 1 from hrs),
    b as (select stid, var, us, mark, last_value(kus ignore nulls) over l as t0, last_value(v ignore nulls) over l as v0,
        first_value(kus ignore nulls) over f as t1, first_value(v ignore nulls) over f as v1 from u
      window l as (partition by stid, var order by us, mark rows between unbounded preceding and current row),
        f as (partition by stid, var order by us, mark desc rows between current row and unbounded following)),
    i as (select stid, us, var, case when t0 is null then v1 when t1 is null or t1 = t0 then v0
        else v0 + (v1 - v0) / (t1 - t0) * (us - t0) end as v from b where mark = 1),
    w as (select stid, us, max(v) filter (var = 'click') as temp, max(v) filter (var = 'view') as rh,
        max(v) filter (var = 'purchase') as acc, max(v) filter (var = 'signup') as fm from i group by stid, us)
    select stid, us as date_time, {r('temp')} as temp, {r('rh')} as rh, {r('fm')} as fm, {r('(stid + 3) * 0.3048')} as elev,
      {r(_ED)} as "Ed", {r(_EW)} as "Ew", cast(hour(make_timestamp(us)) as int) as hod,
      {r('coalesce(acc - lag(acc) over (partition by stid order by us), 0)')} as rain from w""",
)
def sensor_series(t: Inputs):
    """Event types as sensors, with units and a station constant."""
    kind, v = F.col("event_type"), F.col("value")
    sensor = F.create_map(*[F.lit(x) for kv in _SENSORS.items() for x in kv])
    rows = t.table("events").select(
        (F.col("user_id") % 16).alias("stid"),
        F.col("ts").alias("date_time"),
        F.try_element_at(sensor, kind).alias("variable"),
        F.when(kind == "click", v / 20).when(kind == "view", F.least(v, F.lit(100.0))).otherwise(v).alias("value"),
        F.when(kind == "click", "Celsius").otherwise("other").alias("units"),
        (F.col("user_id") % 16 + 3).cast("double").alias("elev"),
    )
    made = B.sensor_series(rows, list(_SENSORS.values()), START, END, static=["elev"])
    return made.select("stid", T, "temp", "rh", "fm", "elev", "Ed", "Ew", "hod", "rain")


@query(
    "grid_forecast",
    "grid",
    f"""with cube as (select l_suppkey % 8 as y, l_partkey % 12 as x, timestamp '{START}' + interval 1 hour * (l_orderkey % 48) as time,
        avg(l_quantity) as rh, avg(l_tax) * 100 as rain from lineitem group by 1, 2, 3),
    j as (select c.*, g.elev from cube c join grid g on g.y = c.y and g.x = c.x),
    s as (select y, x, time, (rh - (select avg(rh) from j)) / (select stddev_pop(rh) from j) as rh, (elev - (select avg(elev) from j)) / (select stddev_pop(elev) from j) as elev,
        (rain - (select avg(rain) from j)) / (select stddev_pop(rain) from j) as rain from j),
    o as (select *, row_number() over w - 1 as step, lag(rh) over w as before from s window w as (partition by y, x order by time))
    select y, x, cast(step as int) as step, epoch_us(time) as time, {r('0.5 * rh + 0.3 * elev - 0.2 * rain + 0.1 * coalesce(before, 0)')} as preds from o""",
)
def grid_forecast(t: Inputs):
    """Weather cube and terrain, scaled and scored cell by cell."""
    hour = F.unix_seconds(F.lit(START).cast("timestamp")) + F.col("l_orderkey") % 48 * 3600
    cube = (
        t.table("lineitem")
        .groupBy(
            (F.col("l_suppkey") % 8).alias("y"), (F.col("l_partkey") % 12).alias("x"), F.timestamp_seconds(hour).alias("time")
        )
        .agg(F.avg("l_quantity").alias("rh"), (F.avg("l_tax") * 100).alias("rain"))
    )
    terrain, features = t.grid.select("y", "x", "elev"), ["rh", "elev", "rain"]
    stats = SC.fit_standard(cube.join(terrain, ["y", "x"]), features)
    return B.grid_forecast(cube, terrain, stats, features, _toy_model)


@query(
    "grid_forecast_store",
    "grid",
    f"""with cube as (select l_suppkey % 8 as y, l_partkey % 12 as x, l_linenumber % 3 as run, timestamp '{START}' + interval 1 hour * (l_orderkey % 48) as time,
        avg(l_quantity) as rh, avg(l_tax) * 100 as rain from lineitem group by 1, 2, 3, 4),
    j as (select c.*, g.elev, g.lsm from cube c join grid g on g.y = c.y and g.x = c.x),
    s as (select y, x, run, time, rh as raw, lsm, (rh - (select avg(rh) from j)) / (select stddev_pop(rh) from j) as rh, (elev - (select avg(elev) from j)) / (select stddev_pop(elev) from j) as elev,
        (rain - (select avg(rain) from j)) / (select stddev_pop(rain) from j) as rain from j),
    o as (select *, lag(rh) over (partition by y, x, run order by time) as before from s)
    select y, x, run, epoch_us(time) as time, lsm, {r('raw')} as rh, {r('0.5 * rh + 0.3 * elev - 0.2 * rain + 0.1 * coalesce(before, 0)')} as preds from o""",
)
def grid_forecast_store(t: Inputs):
    """Several runs per cell, stored by day with their inputs and land mask, and read back."""
    hour = F.unix_seconds(F.lit(START).cast("timestamp")) + F.col("l_orderkey") % 48 * 3600
    keys = [(F.col("l_suppkey") % 8).alias("y"), (F.col("l_partkey") % 12).alias("x"), (F.col("l_linenumber") % 3).alias("run")]
    cube = t.table("lineitem").groupBy(*keys, F.timestamp_seconds(hour).alias("time")).agg(
        F.avg("l_quantity").alias("rh"), (F.avg("l_tax") * 100).alias("rain")
    )
    out = B.forecast_runs(cube, t.grid.select("y", "x", "elev", "lsm"), ["rh", "elev", "rain"], _toy_model, "run")
    path = stage_path(t.spark, "grid-forecast")
    TB.write_grid_forecast(out, path)
    return TB.scan_grid(t.spark, path, START, END, "time").select("y", "x", "run", "time", "lsm", "rh", "preds")


# --- grids ------------------------------------------------------------------------------------


@query(
    "param_grid",
    "",
    f"""select a.l_linenumber, {r('b.l_tax')} as l_tax, c.l_returnflag from (select distinct l_linenumber from lineitem) a
    cross join (select distinct l_tax from lineitem) b cross join (select distinct l_returnflag from lineitem) c""",
)
def param_grid(t: Inputs):
    """Settings found in the lines, in every combination."""
    names = ["l_linenumber", "l_tax", "l_returnflag"]
    found = t.table("lineitem").agg(*[F.array_sort(F.collect_set(c)).alias(f"_{c}") for c in names])
    return TU.combine(found, {c: F.col(f"_{c}") for c in names}).select(*names)


@query(
    "numbered_grid",
    "",
    """with a as (select l_linenumber, row_number() over (order by l_linenumber) - 1 as i from (select distinct l_linenumber from lineitem)),
    b as (select l_returnflag, row_number() over (order by l_returnflag) - 1 as j from (select distinct l_returnflag from lineitem))
    select i * (select count(*) from b) + j as config_id, l_linenumber, l_returnflag from a cross join b""",
)
def numbered_grid(t: Inputs):
    """The numbered grid over the few values that two columns hold."""
    lines = t.table("lineitem")
    names = ["l_linenumber", "l_returnflag"]
    return TU.param_grid(t.spark, {c: [r[0] for r in lines.select(c).distinct().sort(c).collect()] for c in names})


@query(
    "funnel_grid",
    "",
    """with u as (select distinct l_linenumber as u from lineitem)
    select cast(a.u as varchar) as units from u a
    union all select a.u || '-' || b.u from u a join u b on b.u <= a.u
    union all select a.u || '-' || b.u || '-' || c.u from u a join u b on b.u <= a.u join u c on c.u <= b.u""",
)
def funnel_grid(t: Inputs):
    """Layer widths that never grow, for one to three layers."""
    found = t.table("lineitem").agg(F.array_sort(F.collect_set("l_linenumber")).alias("u"))
    sizes = found.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3))))
    lists = sizes.select(F.explode(TU.funnel_units(F.col("n"), F.col("u"), 3)).alias("w"))
    return lists.select(F.array_join(F.transform("w", lambda x: x.cast("string")), "-").alias("units"))


_LAYERS_SQL = """with recursive u as (select distinct l_linenumber::int as u from lineitem),
    s as (select a.n as a, b.n as b from (select unnest(range(1, 4)) as n) a, (select unnest(range(0, 4)) as n) b),
    g as (select a, b, [u] as units from s, u
      union all select a, b, list_append(units, u.u) from g, u where len(units) < a + b and u.u <= units[len(units)])
    select repeat('lstm ', a) || repeat('dense ', b) || case when b > 0 then 'dropout ' else '' end as layers,
      array_to_string(units, ' ') as units, repeat('tanh ', a) || repeat('relu ', b) || case when b > 0 then '- ' else '' end as activations
    from g where len(units) = a + b"""


@query("architectures", "", _LAYERS_SQL)
def architectures(t: Inputs):
    """Every layer stack of the published search with widths that a column holds."""
    widths = [r[0] for r in t.table("lineitem").select(F.col("l_linenumber").cast("int")).distinct().collect()]  # a settings list
    grid = TU.model_grid(t.spark, units=sorted(widths))
    spell = lambda c, none: F.concat_ws("", F.transform(c, lambda x: F.concat(F.coalesce(x, F.lit(none)), F.lit(" "))))
    return grid.select(
        spell("hidden_layers", "").alias("layers"),
        F.array_join("hidden_units", " ").alias("units"),
        spell("hidden_activation", "-").alias("activations"),
    )


@query(
    "grid_search",
    "hourly weather",
    f"""with {_FORCED}, tr as (select *, cast(hour(date_time) as double) as hod from forced where date_time < timestamp '{CUT}'),
    te as (select *, cast(hour(date_time) as double) as hod from forced where date_time >= timestamp '{CUT}'),
    b as (select regr_slope(fm, ed) as s0, regr_intercept(fm, ed) as i0, regr_slope(fm, ew) as s1, regr_intercept(fm, ew) as i1,
      regr_slope(fm, rain) as s2, regr_intercept(fm, rain) as i2 from tr),
    e as (select 0 as config_id, fm - (i0 + s0 * ed) as e from te, b union all select 1, fm - (i1 + s1 * ew) from te, b union all select 2, fm - (i2 + s2 * rain) from te, b)
    select config_id, {r('avg(e)')} as mean, {r('median(e)')} as median, {r('avg(abs(e))')} as mae, {r('avg(e * e)')} as mse, count(*) as count from e group by 1""",
)
def grid_search(t: Inputs):
    """Three one-predictor models as configurations of a small search."""
    train, test = _train_test(t)
    configs = [{"features": [f]} for f in ("Ed", "Ew", "rain")]
    metrics, _ = TU.run_grid(configs, train, test, lambda c, rows: L.fit(L.linear_model(), rows, c["features"]))
    return metrics


@query(
    "grid_best",
    "hourly weather",
    f"""with {_FORCED}, tr as (select *, cast(hour(date_time) as double) as hod from forced where date_time < timestamp '{CUT}'),
    te as (select *, cast(hour(date_time) as double) as hod from forced where date_time >= timestamp '{CUT}'),
    b as (select regr_slope(fm, ed) as s0, regr_intercept(fm, ed) as i0, regr_slope(fm, ew) as s1, regr_intercept(fm, ew) as i1,
      regr_slope(fm, rain) as s2, regr_intercept(fm, rain) as i2 from tr),
    e as (select 0 as config_id, fm - (i0 + s0 * ed) as e from te, b union all select 1, fm - (i1 + s1 * ew) from te, b union all select 2, fm - (i2 + s2 * rain) from te, b)
    select config_id, {r('mse')} as mse from (select config_id, avg(e * e) as mse from e group by 1) order by mse, config_id limit 1""",
)
def grid_best(t: Inputs):
    """The configuration of ``grid_search`` with the smallest error (one row is the feature)."""
    train, test = _train_test(t)
    configs = [{"features": [f]} for f in ("Ed", "Ew", "rain")]
    return TU.run_grid(configs, train, test, lambda c, rows: L.fit(L.linear_model(), rows, c["features"]))[1]


@query(
    "climatology_calendar",
    "hist",
    """with a as (select distinct date_time as t from hist),
    s as (select distinct t, (t - interval 3 year) + interval 1 year * i + interval 1 day * d as s
      from a, (select unnest(range(4)) as i), (select unnest(range(-5, 6)) as d))
    select epoch_us(t) as date_time, count(*) as n, epoch_us(min(s)) as first, epoch_us(max(s)) as last from s where s < t group by t""",
)
def climatology_calendar(t: Inputs):
    """Earlier stamps that feed the climatology of every date in the archive."""
    dates = t.hist.select(F.col(T).cast("timestamp").alias(T)).distinct()
    stamps = dates.select(T, F.explode(TM.climatology_times(F.col(T), 3, 5)).alias("s")).distinct()
    return stamps.groupBy(T).agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("first"), F.max("s").alias("last"))
