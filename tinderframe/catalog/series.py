"""Queries on hourly series: interpolation, differences, runs, windows, periods, sequences."""

from pyspark.sql import functions as F

from tinderframe.catalog.inputs import END, START, Inputs, query, r
from tinderframe.functions.times import hour_number
from tinderframe.operators import series as S

K = ["stid"]
T = "date_time"


@query("interp_hourly", "hourly", f"select stid, epoch_us(date_time) as date_time, {r('fm')} as fm from hourly")
def interp_hourly(t: Inputs):
    return t.hourly


@query(
    "interp_multi",
    "obs",
    f"""
    with split as (select stid, date_time, case when event_type in ('click', 'view') then fm end as a,
             case when event_type not in ('click', 'view') then fm end as b
           from (select user_id % 16 as stid, ts as date_time, value as fm, event_type from events)),
    home as (select stid, arg_min(fm, date_time) as home from obs group by stid),
    long as (select stid, 'a' as var, epoch_us(date_time) as us, a as v from split where a is not null
             union all select stid, 'b', epoch_us(date_time), b from split where b is not null),
    hours as (select stid, var, epoch_us(h) as us from (select distinct stid, var from long),
              generate_series(timestamp '{START}', timestamp '{END}', interval 1 hour) g(h)),
    u as (select stid, var, us, us as kus, v, 0 as mark from long union all select stid, var, us, null, null, 1 from hours),
    b as (select stid, var, us, mark, last_value(kus ignore nulls) over l as t0, last_value(v ignore nulls) over l as v0,
             first_value(kus ignore nulls) over f as t1, first_value(v ignore nulls) over f as v1 from u
          window l as (partition by stid, var order by us, mark rows between unbounded preceding and current row),
             f as (partition by stid, var order by us, mark desc rows between current row and unbounded following)),
    i as (select stid, var, us, case when t0 is null then v1 when t1 is null or t1 = t0 then v0
             else v0 + (v1 - v0) / (t1 - t0) * (us - t0) end as v from b where mark = 1)
    select i.stid, us as date_time, {r("max(v) filter (var = 'a')")} as a, {r("max(v) filter (var = 'b')")} as b,
      {r('any_value(home)')} as home
    from i join home on i.stid = home.stid group by i.stid, us
    """,
)
def interp_multi(t: Inputs):
    """Two sensors with their own gaps and one station constant, in a single pass."""
    first = F.col("event_type").isin("click", "view")
    e = t.table("events").select(
        (F.col("user_id") % 16).alias("stid"),
        F.col("ts").alias("date_time"),
        F.when(first, F.col("value")).alias("a"),
        F.when(~first, F.col("value")).alias("b"),
        F.col("value").alias("home"),
    )
    return S.interpolate_hourly(e, K, T, ["a", "b"], START, END, static=["home"])


_ASOF_SQL = f"""
    with asked as (select distinct o_custkey % 16 as stid,
        timestamp '{START}' + interval 1 second * (o_orderkey * 7919 % 2592000) as date_time from orders),
    knots as (select distinct stid, date_time, fm from obs),
    lo as (select a.stid, a.date_time, k.date_time as t_before, k.fm as v_before
           from asked a asof left join knots k on a.stid = k.stid and a.date_time >= k.date_time),
    hi as (select a.stid, a.date_time, k.date_time as t_after, k.fm as v_after
           from asked a asof left join knots k on a.stid = k.stid and a.date_time <= k.date_time)
    select lo.stid, epoch_us(lo.date_time) as date_time, epoch_us(t_before) as t_before, {r('v_before')} as v_before,
      epoch_us(t_after) as t_after, {r('v_after')} as v_after
    from lo join hi on lo.stid = hi.stid and lo.date_time = hi.date_time
    """


@query(
    "asof_bracket",
    "obs",
    _ASOF_SQL,
)
def asof_bracket(t: Inputs):
    """Readings before and after arbitrary stamps taken from the orders."""
    return S.bracket(t.obs, _asked(t), K, T, "fm")


@query("asof_segments", "obs", _ASOF_SQL)
def asof_segments(t: Inputs):
    """The same with every station cut into parts of about a hundred rows."""
    return S.bracket(t.obs, _asked(t), K, T, "fm", segment=100)


def _asked(t: Inputs):
    second = (F.col("o_orderkey") * 7919 % 2592000).cast("long")
    start = F.unix_seconds(F.lit(START).cast("timestamp"))
    stamp = F.timestamp_seconds(start + second).alias("date_time")
    return t.table("orders").select((F.col("o_custkey") % 16).alias("stid"), stamp).distinct()


@query(
    "asof_ties",
    "obs",
    f"""
    with asked as (select distinct o_custkey % 16 as stid,
        timestamp '{START}' + interval 1 minute * (o_orderkey * 7919 % 43200) as date_time from orders),
    knots as (select stid, date_trunc('hour', date_time) as date_time, min(fm) as fm from obs group by 1, 2),
    lo as (select a.stid, a.date_time, k.fm as v_before
           from asked a asof left join knots k on a.stid = k.stid and a.date_time >= k.date_time),
    hi as (select a.stid, a.date_time, k.fm as v_after
           from asked a asof left join knots k on a.stid = k.stid and a.date_time <= k.date_time)
    select lo.stid, epoch_us(lo.date_time) as date_time, {r('v_before')} as v_before, {r('v_after')} as v_after
    from lo join hi on lo.stid = hi.stid and lo.date_time = hi.date_time
    """,
)
def asof_ties(t: Inputs):
    """Stamps cut to the hour, so that several readings share each; the smallest counts."""
    minute = (F.col("o_orderkey") * 7919 % 43200 * 60).cast("long")
    start = F.unix_seconds(F.lit(START).cast("timestamp"))
    asked = (
        t.table("orders")
        .select((F.col("o_custkey") % 16).alias("stid"), F.timestamp_seconds(start + minute).alias("date_time"))
        .distinct()
    )
    cut = t.obs.withColumn(T, F.date_trunc("hour", T))
    return S.bracket(cut, asked, K, T, "fm").select("stid", T, "v_before", "v_after")


@query(
    "interp_ties",
    "obs",
    f"""
    with k as (select stid, date_trunc('hour', date_time) as date_time, min(fm) as fm from obs group by 1, 2),
    h as (select stid, h from (select distinct stid from k), generate_series(timestamp '{START}', timestamp '{END}', interval 1 hour) g(h)),
    b as (select h.stid, h.h, k.date_time as t0, k.fm as v0 from h asof left join k on h.stid = k.stid and h.h >= k.date_time),
    a as (select h.stid, h.h, k.date_time as t1, k.fm as v1 from h asof left join k on h.stid = k.stid and h.h <= k.date_time)
    select b.stid, epoch_us(b.h) as date_time, {r("case when t0 is null then v1 when t1 is null or t0 = t1 then v0 else v0 + (v1 - v0) / (epoch_us(t1) - epoch_us(t0)) * (epoch_us(b.h) - epoch_us(t0)) end")} as fm
    from b join a on a.stid = b.stid and a.h = b.h
    """,
)
def interp_ties(t: Inputs):
    """Hourly series of readings that share their stamps."""
    return S.interpolate_hourly(t.obs.withColumn(T, F.date_trunc("hour", T)), K, T, ["fm"], START, END)


@query(
    "hourly_rain",
    "hourly",
    f"""select stid, epoch_us(date_time) as date_time,
      {r('coalesce(fm - lag(fm) over (partition by stid order by date_time), 0)')} as rain from hourly""",
)
def hourly_rain(t: Inputs):
    return S.first_difference(t.hourly, K, T, "fm", "rain").select("stid", T, "rain")


@query(
    "lead_accumulation",
    "",
    f"""select l_orderkey as run, l_linenumber as lead, {r('''l_quantity - lag(l_quantity)
      over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)''')} as amount
      from lineitem""",
)
def lead_accumulation(t: Inputs):
    """Lines of an order as lead steps of one forecast run."""
    li = t.table("lineitem").withColumn("step", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    d = S.lead_difference(li, [], "l_orderkey", "step", "l_quantity", "amount")
    return d.select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("lead"), "amount")


_BLOCKS = """
    with n as (select stid, date_time, floor(fm / 10) as v,
             (row_number() over (partition by stid order by date_time) - 1) // 72 as blk from hourly),
    d as (select *, v - lag(v) over w as d1, lag(v) over w - lag(v, 2) over w as d0 from n
          window w as (partition by stid, blk order by date_time)),
    z as (select *, {zero} as z, row_number() over (partition by stid, blk order by date_time) as rn from d),
    runs as (select stid, blk, count(*) as len from (select stid, blk, rn - row_number() over (partition by stid, blk order by rn) as isl
             from z where z) group by stid, blk, isl)
    select stid, blk as st_period, coalesce(max(len) > 3, false) as flagged
    from (select distinct stid, blk from n) left join runs using (stid, blk) group by stid, blk
"""


def _flags(t: Inputs, order: int):
    stepped = t.hourly.withColumn("v", F.floor(F.col("fm") / 10).cast("double"))
    flagged = S.flag_linear_runs(stepped, K, T, "v", order=order)
    return flagged.groupBy("stid", "st_period").agg(F.bool_or("flagged").alias("flagged"))


@query("linear_runs", "hourly", _BLOCKS.format(zero="coalesce(d1 - d0 = 0, false)"))
def linear_runs(t: Inputs):
    return _flags(t, 2)


@query("const_runs", "hourly", _BLOCKS.format(zero="coalesce(d1 = 0, false)"))
def const_runs(t: Inputs):
    return _flags(t, 1)


@query(
    "drop_linear_blocks",
    "hourly",
    "with verdict as ("
    + _BLOCKS.format(zero="coalesce(d1 - d0 = 0, false)").strip()
    + f"""), rows as (select stid, date_time, fm, (row_number() over (partition by stid order by date_time) - 1) // 72 as st_period from hourly)
    select rows.stid, epoch_us(date_time) as date_time, {r('fm')} as fm, rows.st_period from rows
    join verdict on rows.stid = verdict.stid and rows.st_period = verdict.st_period where not flagged""",
)
def drop_linear_blocks(t: Inputs):
    stepped = t.hourly.withColumn("v", F.floor(F.col("fm") / 10).cast("double"))
    return S.drop_linear_runs(stepped, K, T, "v").drop("v")


_WINDOWS = """
    with s as (select stid, date_time, fm, lead(date_time, 11) over (partition by stid order by date_time) as ends from occupied)
"""


@query(
    "seq_windows",
    "occupied",
    _WINDOWS
    + f""", w as (select * from s where ends = date_time + interval 11 hour)
    select w.stid, epoch_us(w.date_time) as date_time, cast(date_diff('hour', w.date_time, o.date_time) as int) as step,
      {r('o.fm')} as fm
    from w join occupied o on o.stid = w.stid and o.date_time between w.date_time and w.ends""",
)
def seq_windows(t: Inputs):
    seqs = S.sequence_windows(t.occupied, K, T, ["fm"], 12)
    return seqs.select("stid", T, F.posexplode("seq").alias("step", "s")).select("stid", T, "step", "s.fm")


@query(
    "last_step",
    "occupied",
    _WINDOWS
    + f"""select s.stid, epoch_us(s.date_time) as date_time, {r('o.fm')} as fm
    from s join occupied o on o.stid = s.stid and o.date_time = s.ends where s.ends = s.date_time + interval 11 hour""",
)
def last_step(t: Inputs):
    seqs = S.sequence_windows(t.occupied, K, T, ["fm"], 12)
    return seqs.select("stid", T, S.last_step("seq", "fm").alias("fm"))


@query(
    "window_coverage",
    "occupied",
    _WINDOWS
    + """, w as (select * from s where ends = date_time + interval 11 hour)
    select o.stid, epoch_us(o.date_time) as date_time, count(w.stid) as n_windows
    from occupied o left join w on w.stid = o.stid and o.date_time between w.date_time and w.ends group by o.stid, o.date_time""",
)
def window_coverage(t: Inputs):
    return S.window_coverage(t.occupied, K, T, 12).select("stid", T, "n_windows")


@query(
    "consecutive_hours",
    "occupied",
    """select stid, cast(count(*) as bigint) - 1 = date_diff('hour', min(date_time), max(date_time)) as consecutive
    from occupied group by stid""",
)
def consecutive_hours(t: Inputs):
    return S.is_consecutive(t.occupied, K, T)


@query(
    "forecast_periods",
    "occupied",
    f"""with p as (select stid, date_time, fm, (epoch_us(date_time) - epoch_us(timestamp '2024-01-03')) // 21600000000 as period
             from occupied where date_time >= timestamp '2024-01-03'),
    full_p as (select stid, period from p group by stid, period having count(*) = 6),
    several as (select period from full_p group by period having count(distinct stid) > 1)
    select p.stid, epoch_us(p.date_time) as date_time, {r('fm')} as fm, p.period,
      date_diff('hour', timestamp '2024-01-03' + interval 6 hour * p.period, date_time) as lead
    from p join full_p using (stid, period) join several using (period)""",
)
def forecast_periods(t: Inputs):
    """Complete 6-hour periods in which more than one station takes part."""
    from tinderframe.operators.clean import keep_complete_groups, periods_with_several_stations

    p = S.forecast_periods(t.occupied, T, "2024-01-03 00:00:00", hours=6)
    p = periods_with_several_stations(keep_complete_groups(p, ["stid", "period"], 6), ["period"])
    begin = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-03").cast("timestamp")) + F.col("period") * 6 * 3600)
    return p.withColumn("lead", S.lead_hour(F.col(T), begin))


@query(
    "spinup_periods",
    "hourly",
    f"""with k as (select unnest(range(14)) as period)
    select stid, period, cast(date_diff('hour', timestamp '{START}' + interval 48 hour * period, date_time) as int) as step,
      epoch_us(date_time) as date_time, {r('fm')} as fm
    from hourly join k on date_time >= timestamp '{START}' + interval 48 hour * period
      and date_time < timestamp '{START}' + interval 48 hour * period + interval 72 hour""",
)
def spinup_periods(t: Inputs):
    return S.spinup_periods(t.hourly, T, "2024-01-02 00:00:00", 14).select("stid", "period", "step", T, "fm")


@query(
    "rolling_origins",
    "occupied",
    f"""with k as (select unnest(range(8)) as origin),
    o as (select origin, timestamp '2024-01-08' + interval 72 hour * origin as t0 from k)
    select stid, origin, case when date_time < t0 then 'train' else 'test' end as split,
      count(*) as n_rows, {r('avg(fm)')} as mean_fm
    from occupied join o on date_time >= t0 - interval 168 hour and date_time < t0 + interval 48 hour group by 1, 2, 3""",
)
def rolling_origins(t: Inputs):
    rows = S.rolling_origins(t.occupied, T, "2024-01-08 00:00:00", 72, 8, 168, 48)
    return rows.groupBy("stid", "origin", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("fm").alias("mean_fm")
    )


@query(
    "period_sequences",
    "hourly",
    f"""select stid, period, list_sum(seq) as total, list_first(seq) as head, list_last(seq) as tail, len(seq) as n from (
      select stid, date_diff('hour', timestamp '{START}', date_time) // 48 as period, list(round(fm, 6) order by date_time) as seq
      from hourly group by 1, 2)""".replace("list_sum(seq)", r("list_sum(seq)")).replace("list_first(seq)", r("list_first(seq)")).replace("list_last(seq)", r("list_last(seq)")),
)
def period_sequences(t: Inputs):
    """One time-ordered array per station and 48-hour period."""
    p = S.forecast_periods(t.hourly.withColumn("fm", F.round("fm", 6)), T, START)
    seqs = S.ordered_sequence(p, ["stid", "period"], T, ["fm"])
    total = F.aggregate("seq", F.lit(0.0), lambda acc, s: acc + s["fm"])
    return seqs.select(
        "stid",
        "period",
        total.alias("total"),
        F.element_at("seq", 1)["fm"].alias("head"),
        F.element_at("seq", -1)["fm"].alias("tail"),
        F.size("seq").cast("long").alias("n"),
    )


@query(
    "block_sizes",
    "occupied",
    """select stid, blk as st_period, count(*) as n_rows, epoch_us(min(date_time)) as first_time, epoch_us(max(date_time)) as last_time
    from (select stid, date_time, (row_number() over (partition by stid order by date_time) - 1) // 72 as blk from occupied)
    group by stid, blk""",
)
def block_sizes(t: Inputs):
    """Blocks count rows, so after gaps they span more than 72 hours."""
    b = S.block_number(t.occupied, K, T)
    return b.groupBy("stid", "st_period").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(T).alias("first_time"), F.max(T).alias("last_time")
    )


@query(
    "occupied_hours",
    "obs",
    """select stid, count(distinct epoch_us(date_time) // 3600000000) as n_hours, count(*) as n_rows from obs group by stid""",
)
def occupied_hours(t: Inputs):
    per_hour = t.obs.groupBy("stid", hour_number(F.col(T)).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return per_hour.groupBy("stid").agg(F.count(F.lit(1)).alias("n_hours"), F.sum("n").alias("n_rows"))
