"""Queries on forecast errors."""

from pyspark.sql import functions as F

from tinderframe.catalog.inputs import Inputs, query, r
from tinderframe.operators import evaluate as E

T = "date_time"


def _two_level(keys: str, select: str | None = None) -> str:
    """SQL of the replication summary by ``keys``."""
    return f"""
    with p as (select *, hour(date_time) as hod, fm - preds as e from pred),
    reps as (select {keys}, rep, avg(e) as bias, avg(e * e) as mse from p group by {keys}, rep)
    select {select or keys}, {r('avg(bias)')} as bias_mean, {r('stddev_samp(bias)')} as bias_std,
      {r('sqrt(avg(mse))')} as rmse_mean, {r('sqrt(stddev_samp(mse))')} as rmse_std
    from reps group by {keys}"""


@query("err_overall", "pred", _two_level('"Model"'))
def err_overall(t: Inputs):
    return E.replication_summary(t.pred, ["Model"])


@query("err_station", "pred", _two_level('"Model", stid'))
def err_station(t: Inputs):
    return E.replication_summary(t.pred, ["Model", "stid"])


@query("err_hod", "pred", _two_level('"Model", hod', '"Model", cast(hod as int) as hod'))
def err_hod(t: Inputs):
    return E.replication_summary(t.pred.withColumn("hod", F.hour(T)), ["Model", "hod"])


@query("err_time", "pred", _two_level('"Model", date_time', '"Model", epoch_us(date_time) as date_time'))
def err_time(t: Inputs):
    return E.replication_summary(t.pred, ["Model", T])


def _grain(name: str, keys: list[str]) -> str:
    cols = {"stid": "cast(null as bigint)", "hod": "cast(null as int)", "date_time": "cast(null as bigint)"}
    cols |= {"stid": "stid"} if "stid" in keys else {}
    cols |= {"hod": "cast(hod as int)"} if "hod" in keys else {}
    cols |= {"date_time": "epoch_us(date_time)"} if "date_time" in keys else {}
    by = ", ".join(['"Model"', *keys])
    shown = ", ".join(f"{v} as {k}" for k, v in cols.items())
    return f"""select '{name}' as grain, "Model", {shown}, {r('avg(bias)')} as bias_mean, {r('stddev_samp(bias)')} as bias_std,
      {r('sqrt(avg(mse))')} as rmse_mean, {r('sqrt(stddev_samp(mse))')} as rmse_std
      from (select {by}, rep, avg(e) as bias, avg(e * e) as mse from p group by {by}, rep) group by {by}"""


@query(
    "err_all_grains",
    "pred",
    "with p as (select *, hour(date_time) as hod, fm - preds as e from pred) "
    + " union all ".join(
        [_grain("overall", []), _grain("station", ["stid"]), _grain("hour", ["hod"]), _grain("time", ["date_time"])]
    ),
)
def err_all_grains(t: Inputs):
    """The four error tables from one scan."""
    grains = {"overall": [], "station": ["stid"], "hour": ["hod"], "time": [T]}
    return E.error_tables(t.pred.withColumn("hod", F.hour(T)), grains)


@query(
    "err_month",
    "pred",
    f"""with reps as (select "Model", date_time, rep, avg(fm - preds) as bias, avg((fm - preds) * (fm - preds)) as mse from pred group by 1, 2, 3),
    times as (select "Model", date_time, avg(bias) as bias_mean, sqrt(avg(mse)) as rmse_mean from reps group by 1, 2)
    select "Model", cast(month(date_time) as int) as month, {r('avg(bias_mean)')} as bias_mean, {r('avg(rmse_mean)')} as rmse_mean
    from times group by 1, 2""",
)
def err_month(t: Inputs):
    per_time = E.replication_summary(t.pred, ["Model", T])
    return E.monthly_summary(per_time, ["bias_mean", "rmse_mean"])


@query(
    "err_rows",
    "pred",
    f"""select "Model", rep, stid, {r('fm - preds')} as residual, {r('abs(fm - preds)')} as abs_error,
      {r('(fm - preds) * (fm - preds)')} as squared_error from pred""",
)
def err_rows(t: Inputs):
    return E.residuals(t.pred).select("Model", "rep", "stid", "residual", "abs_error", "squared_error")


@query(
    "err_metrics",
    "pred",
    f"""with p as (select "Model", fm - preds as e from pred)
    select "Model", {r('avg(e)')} as mean, {r('median(e)')} as median, {r('avg(abs(e))')} as mae, {r('avg(e * e)')} as mse, count(e) as count
    from p group by "Model" """,
)
def err_metrics(t: Inputs):
    return E.named_metrics(t.pred, ["Model"])


@query(
    "best_config",
    "pred",
    f"""select rep, {r('mse')} as mse from (select rep, avg((fm - preds) * (fm - preds)) as mse from pred group by rep) order by mse, rep limit 1""",
)
def best_config(t: Inputs):
    """Replication numbers stand for configurations."""
    return E.best_config(E.mean_squared_error(t.pred, ["rep"]), "rep")


@query("evaluation_order", "pred", f"""select "Model", rep, stid, epoch_us(date_time) as date_time, {r('fm - preds')} as residual from pred""")
def evaluation_order(t: Inputs):
    rows = E.evaluation_order(E.residuals(t.pred))
    return rows.select("Model", "rep", "stid", F.col("date_time").cast("timestamp").alias("date_time"), "residual")


@query(
    "mse_rollup",
    "pred",
    f"""select "Model", stid, {r('avg((fm - preds) * (fm - preds))')} as mse from pred group by rollup("Model", stid)""",
)
def mse_rollup(t: Inputs):
    return E.mse_rollup(t.pred, ["Model", "stid"])


_CLASS = "case when fm >= 0 and fm < 10 then 'Low' when fm >= 10 and fm < 20 then 'Med' when fm >= 20 then 'High' end"


@query(
    "fmc_bins",
    "pred",
    f"""with c as (select unnest(['Low', 'Med', 'High']) as fm_class), m as (select distinct "Model" from pred),
    p as (select "Model", {_CLASS} as fm_class, fm, fm - preds as e from pred)
    select m."Model", c.fm_class, {r('avg(e)')} as bias, {r('sqrt(avg(e * e))')} as rmse, {r('avg(abs(e)) / avg(fm)')} as rel_error
    from m cross join c left join p on p."Model" = m."Model" and p.fm_class = c.fm_class group by 1, 2""",
)
def fmc_bins(t: Inputs):
    return E.class_errors(t.pred)


@query(
    "fmc_bins_rep",
    "pred",
    f"""with reps as (select "Model", {_CLASS} as fm_class, rep, avg(fm - preds) as bias from pred group by 1, 2, 3)
    select "Model", fm_class, {r('avg(bias)')} as bias_mean, {r('stddev_samp(bias)')} as bias_std from reps where fm_class is not null group by 1, 2""",
)
def fmc_bins_rep(t: Inputs):
    return E.class_bias_over_reps(t.pred)


@query(
    "rep_coverage",
    "pred",
    "select stid, count(distinct rep) as n_reps, count(*) as n_rows from pred group by stid",
)
def rep_coverage(t: Inputs):
    return E.replication_coverage(t.pred)


@query("rep_sizes", "pred", "select rep, count(distinct stid) as n_stations, count(*) as n_rows from pred group by rep")
def rep_sizes(t: Inputs):
    return E.replication_sizes(t.pred)


@query(
    "ensemble_band",
    "pred",
    f"""select "Model", epoch_us(date_time) as date_time, {r('avg(preds)')} as mean,
      {r('avg(preds) - stddev_samp(preds)')} as low, {r('avg(preds) + stddev_samp(preds)')} as high from pred group by "Model", date_time""",
)
def ensemble_band(t: Inputs):
    return E.ensemble_band(t.pred, ["Model", T])


@query(
    "lead_curve",
    "pred",
    f"""with p as (select "Model", date_diff('hour', timestamp '1990-01-01', date_time) % 48 as lead, (fm - preds) * (fm - preds) as e from pred)
    select "Model", lead, {r('avg(e)')} as mse, {r('stddev_samp(e) / sqrt(count(e))')} as se from p group by 1, 2""",
)
def lead_curve(t: Inputs):
    from tinderframe.functions.times import as_timestamp, whole_hours_between

    lead = whole_hours_between(F.col(T), as_timestamp("1990-01-01 00:00:00")) % 48
    return E.lead_curve(t.pred, lead, ["Model"])


_RMSE = 'rm as (select "Model", stid, rep, sqrt(avg((fm - preds) * (fm - preds))) as rmse from pred group by 1, 2, 3)'
_KEYS = ["Model", "stid"]


@query(
    "rep_median",
    "pred",
    f"""with {_RMSE} select "Model", stid, {r('min(rmse)')} as low, {r('median(rmse)')} as median, {r('max(rmse)')} as high from rm group by 1, 2""",
)
def rep_median(t: Inputs):
    return E.rmse_range(E.station_rep_rmse(t.pred, _KEYS), _KEYS)


@query(
    "rep_typical",
    "pred",
    f"""with {_RMSE}, d as (select *, round(abs(rmse - median(rmse) over (partition by "Model", stid)), 9) as off from rm)
    select "Model", stid, rep, {r('rmse')} as rmse from (
      select *, row_number() over (partition by "Model", stid order by off, rep) as rn from d) where rn = 1""",
)
def rep_typical(t: Inputs):
    return E.typical_replication(E.station_rep_rmse(t.pred, _KEYS), _KEYS)


@query(
    "rep_worst",
    "pred",
    f"""with {_RMSE} select "Model", stid, rep, {r('rmse')} as rmse from (
      select *, row_number() over (partition by "Model", stid order by rmse desc, rep) as rn from rm) where rn = 1""",
)
def rep_worst(t: Inputs):
    return E.worst_replication(E.station_rep_rmse(t.pred, _KEYS), _KEYS)


@query(
    "translate_t0",
    "pred",
    f"""with m as (select "Model", stid, date_time, avg(fm) - avg(preds) as e from pred group by 1, 2, 3),
    f as (select *, first_value(e) over (partition by "Model", stid order by date_time) as d from m)
    select "Model", stid, {r('any_value(d)')} as shift, {r('avg(e * e)')} as mse, {r('avg((e - d) * (e - d))')} as mse_shifted from f group by 1, 2""",
)
def translate_t0(t: Inputs):
    return E.translated_ensemble(t.pred, _KEYS)


_VARS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "predictor_summary",
    "",
    " union all ".join(
        f"select '{c}' as variable, {r(f'avg({c})')} as mean, {r(f'min({c})')} as low, {r(f'max({c})')} as high, "
        f"{r(('stddev_pop' if c == 'l_quantity' else 'stddev_samp') + f'({c})')} as std from lineitem"
        for c in _VARS
    ),
)
def predictor_summary(t: Inputs):
    spread = {c: "sample" for c in _VARS} | {"l_quantity": "population"}
    return E.variable_summary(t.table("lineitem"), _VARS, spread)


@query(
    "histogram",
    "",
    """with l as (select 'fm' as variable, l_quantity as x from lineitem union all select 'preds', l_extendedprice / 2000 from lineitem
      union all select 'residual', l_quantity - l_extendedprice / 2000 from lineitem),
    b as (select variable, min(x) as lo, max(x) as hi from l group by variable)
    select l.variable, cast(least(floor((x - lo) / (hi - lo) * 40), 39) as int) as bin, count(*) as n from l join b on l.variable = b.variable group by 1, 2""",
)
def histogram(t: Inputs):
    return E.histogram(E.residuals(t.pred), ["fm", "preds", "residual"])


@query(
    "ablation",
    "pred",
    f"""with m as (select "Model", avg((fm - preds) * (fm - preds)) as mse from pred group by 1)
    select "Model", {r('mse')} as mse, {r('''(mse - (select mse from m where "Model" = 'A')) / (select mse from m where "Model" = 'A')''')} as rel_diff from m""",
)
def ablation(t: Inputs):
    per_model = t.pred.groupBy("Model").agg(F.avg(F.pow(F.col("fm") - F.col("preds"), F.lit(2))).alias("mse"))
    return E.ablation_table(per_model, "Model", "mse", "A")


@query(
    "error_report",
    "pred stations",
    f"""with rm as (select stid, rep, sqrt(avg((fm - preds) * (fm - preds))) as rmse from pred group by 1, 2),
    e as (select stid, avg(rmse) as m, stddev_samp(rmse) as s from rm group by stid)
    select e.stid, printf('%.2f', round_even(m, 2)) || ' ± ' || printf('%.2f', round_even(s, 2)) as rmse, {r('lat')} as lat,
      elev > 1800 as high from e left join stations on e.stid = stations.stid""",
)
def error_report(t: Inputs):
    """Formatted station table with its location."""
    from tinderframe.functions.physics import is_high_elevation

    per_rep = E.station_rep_rmse(t.pred)
    by_station = per_rep.groupBy("stid").agg(F.avg("rmse").alias("m"), F.stddev_samp("rmse").alias("s"))
    shown = by_station.select("stid", E.format_mean_std(F.col("m"), F.col("s")).alias("rmse"))
    located = E.join_locations(shown, t.stations)
    return located.select("stid", "rmse", "lat", is_high_elevation(F.col("elev")).alias("high"))
