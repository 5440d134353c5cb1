"""Queries on cleaning, selection, reshaping and bookkeeping operators."""

from pyspark.sql import functions as F

from tinderframe.catalog.inputs import BBOX, START, Inputs, query, r
from tinderframe.functions import times as TM
from tinderframe.operators import clean as C, reshape as R
from tinderframe.sources import tables as TB

LAT0, LON0, LAT1, LON1 = BBOX
T = "date_time"


@query(
    "range_filter",
    "obs",
    f"""select stid, epoch_us(date_time) as date_time, {r('case when fm >= 1 and fm <= 90 then fm end')} as fm from obs""",
)
def range_filter(t: Inputs):
    return C.null_out_of_range(t.obs)


@query(
    "bbox_stations",
    "stations",
    f"""select stid, {r('lat')} as lat, {r('lon')} as lon, {r('elev')} as elev from stations
    where lat between {LAT0} and {LAT1} and lon between {LON0} and {LON1}""",
)
def bbox_stations(t: Inputs):
    return TB.read_stations(t.stations, BBOX)


@query(
    "bbox_buffered",
    "stations",
    f"""select stid, {r('lat')} as lat, {r('lon')} as lon from stations
    where lat > {LAT0} - 0.67 * 0.5 and lat < {LAT1} + 0.67 * 0.5 and lon > {LON0} - 0.5 and lon < {LON1} + 0.5""",
)
def bbox_buffered(t: Inputs):
    """Open bounds around a grown box."""
    box = C.buffer_bbox(BBOX, 0.5)
    return t.stations.where(C.within_bbox(F.col("lat"), F.col("lon"), box, inclusive=False)).select("stid", "lat", "lon")


@query(
    "scan_range",
    "obs",
    f"""select stid, epoch_us(date_time) as date_time, {r('fm')} as fm from obs
    where date_time between timestamp '2024-01-09 23:00' and timestamp '2024-01-20 13:00'
      and stid in (select s_suppkey % 16 from supplier where s_acctbal > 5000)""",
)
def scan_range(t: Inputs):
    """Time range reaches the scan; stations come from a semi-join."""
    wanted = t.table("supplier").where("s_acctbal > 5000").select((F.col("s_suppkey") % 16).alias("stid"))
    bounds = [TM.as_timestamp(x) for x in ("2024-01-09 23:00:00", "2024-01-20 13:00:00")]
    return C.restrict(t.obs, wanted, start=bounds[0], end=bounds[1])


@query(
    "unknown_stations",
    "obs",
    "select distinct s_suppkey as stid from supplier where s_suppkey not in (select stid from obs)",
)
def unknown_stations(t: Inputs):
    return C.unknown_stations(t.obs, t.table("supplier").select(F.col("s_suppkey").alias("stid")))


@query(
    "source_dedup",
    "",
    f"""with e as (select user_id % 16 as stid, date_trunc('hour', ts) as date_time, event_id, value as fm, event_type from events),
    files as (select 0 as f, stid, date_time, event_id, fm from e where event_type in ('click', 'view')
      union all select 1, stid, date_time, event_id, fm + 1000 from e)
    select stid, epoch_us(date_time) as date_time, event_id, {r('fm')} as fm from (
      select *, row_number() over (partition by stid, date_time order by f, event_id, fm) as rn from files) where rn = 1""",
)
def source_dedup(t: Inputs):
    """Two overlapping files; the earlier one wins on equal (station, hour)."""
    e = t.table("events").select(
        (F.col("user_id") % 16).alias("stid"),
        F.date_trunc("hour", "ts").alias("date_time"),
        "event_id",
        F.col("value").alias("fm"),
        "event_type",
    )
    first = e.where(F.col("event_type").isin("click", "view")).drop("event_type")
    second = e.drop("event_type").withColumn("fm", F.col("fm") + 1000)
    return R.union_sources([first, second], ["stid", T])


@query(
    "distinct_times",
    "obs weather",
    """select distinct epoch_us(date_time) as date_time from
    (select date_trunc('hour', date_time) as date_time from obs union all select date_time from weather)""",
)
def distinct_times(t: Inputs):
    return R.distinct_times([t.occupied, t.weather])


@query(
    "pivot_vars",
    "",
    f"""select user_id % 16 as stid, epoch_us(date_trunc('hour', ts)) as date_time,
      {r("avg(value) filter (event_type = 'click')")} as click, {r("avg(value) filter (event_type = 'view')")} as view,
      {r("avg(value) filter (event_type = 'purchase')")} as purchase
    from events where event_type in ('click', 'view', 'purchase') group by 1, 2""",
)
def pivot_vars(t: Inputs):
    long = (
        t.table("events")
        .groupBy((F.col("user_id") % 16).alias("stid"), F.date_trunc("hour", "ts").alias("date_time"), "event_type")
        .agg(F.avg("value").alias("value"))
    )
    return R.pivot_variables(long, ["stid", T], "event_type", "value", ["click", "view", "purchase"])


@query(
    "melt_vars",
    "atm",
    f"""select stid, hr, 'rh' as variable, {r('rh')} as value from atm union all
    select stid, hr, 'temp', {r('temp')} from atm union all select stid, hr, 'rain', {r('rain')} from atm""",
)
def melt_vars(t: Inputs):
    return R.melt_variables(t.atm, ["stid", "hr"], ["rh", "temp", "rain"], "variable", "value")


@query(
    "unit_conflicts",
    "",
    """select l_returnflag as variable, count(distinct l_linestatus) as n_units from lineitem group by 1 having n_units <> 1""",
)
def unit_conflicts(t: Inputs):
    rows = t.table("lineitem").select(F.col("l_returnflag").alias("variable"), F.col("l_linestatus").alias("units"))
    return C.unit_conflicts(rows)


@query(
    "target_present",
    "",
    "select distinct user_id as stid from events where event_type = 'purchase'",
)
def target_present(t: Inputs):
    e = t.table("events").withColumnRenamed("user_id", "stid")
    return C.stations_with_variable(e, "stid", "event_type", "purchase")


_INVALID = f"""
    bad as (select o_custkey % 16 as stid, timestamp '{START}' + interval 1 second * (o_orderkey * 7919 % 2592000) as t0,
      timestamp '{START}' + interval 1 second * (o_orderkey * 7919 % 2592000 + length(o_orderpriority) * 60) as t1,
      case when o_orderstatus = 'O' then 1 else 0 end as valid from orders)
"""


@query(
    "interval_antijoin",
    "obs",
    f"""with {_INVALID}
    select stid, epoch_us(date_time) as date_time, {r('fm')} as fm from obs where not exists (
      select 1 from bad where bad.valid = 0 and bad.stid = obs.stid and obs.date_time between t0 and t1)""",
)
def interval_antijoin(t: Inputs):
    """Validity list derived from the orders, with overlapping intervals."""
    begin = F.unix_seconds(F.lit(START).cast("timestamp")) + F.col("o_orderkey") * 7919 % 2592000
    bad = t.table("orders").select(
        (F.col("o_custkey") % 16).alias("stid"),
        F.timestamp_seconds(begin).alias("start"),
        F.timestamp_seconds(begin + F.length("o_orderpriority") * 60).alias("end"),
        F.when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("valid"),
    )
    return C.drop_invalid_intervals(t.obs, bad)


@query(
    "value_subset",
    "pred",
    f"""select "Model", stid, {r('fm')} as fm from pred where fm >= 0 and fm < 10""",
)
def value_subset(t: Inputs):
    return C.value_between(t.pred, "fm", 0, 10).select("Model", "stid", "fm")


@query(
    "typed_columns",
    "weather",
    f"""select stid, cast(hour(date_time) as bigint) as hod, cast(dayofyear(date_time) as bigint) as doy, {r('rain')} as rain from weather""",
)
def typed_columns(t: Inputs):
    w = t.weather.withColumns({"hod": TM.hour_of_day(F.col(T)), "doy": TM.day_of_year(F.col(T))})
    return C.cast_columns(w, C.FEATURE_TYPES).select("stid", "hod", "doy", "rain")


@query(
    "renamed_columns",
    "",
    f"""select s_suppkey as stid, {r('s_acctbal')} as solar from supplier""",
)
def renamed_columns(t: Inputs):
    """Of two candidate source names the first present one gives the column."""
    s = t.table("supplier").withColumnsRenamed({"s_acctbal": "sdswrf", "s_suppkey": "STID"})
    return C.rename_first_match(C.rename_columns(s, C.ARCHIVE_NAMES), C.GRID_LAYERS["surface"]).select("stid", "solar")


@query(
    "soil_mask",
    "obs",
    f"""with s as (select stid, date_time, case when fm > 400 then -9999.0 else fm / 100 - 0.1 end as raw from obs)
    select stid, epoch_us(date_time) as date_time, {r('case when raw <> -9999 and raw >= 0.02 then raw end')} as soilw,
      {r('case when abs(raw + 9999) > 0.1 then raw end')} as unfilled from s""",
)
def soil_mask(t: Inputs):
    raw = F.when(F.col("fm") > 400, -9999.0).otherwise(F.col("fm") / 100 - 0.1)
    return t.obs.select(
        "stid", T, C.soil_moisture(raw).alias("soilw"), C.null_fill_value(raw, tol=0.1).alias("unfilled")
    )


@query(
    "parsed_times",
    "",
    """select o_orderkey, epoch_us(o_orderdate - case when o_orderkey % 5 = 2 then interval 7 hour else interval 0 hour end) as t from orders""",
)
def parsed_times(t: Inputs):
    """Stamps written as text in several forms and read back."""
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    text = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k == 1, F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
        .when(k == 2, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'+07:00'"))
        .when(k == 3, F.date_format(d, "yyyy-MM-dd HH:mm:ss'+0000'"))
        .otherwise(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"))
    )
    return t.table("orders").select("o_orderkey", TM.parse_time(text).alias("t"))


@query(
    "calendar_parts",
    "hist",
    """select stid, cast(year(date_time) as int) as year, cast(month(date_time) as int) as month, cast(day(date_time) as int) as day,
      cast(dayofyear(date_time) as int) as doy, epoch_us(date_time + interval 3 hour) as valid, epoch_us(date_time - interval 7 hour) as shifted
    from hist""",
)
def calendar_parts(t: Inputs):
    d = F.col(T)
    back = d - F.expr("interval 7 hours")
    # a zone without summer time: converting there and back must be exact
    via_zone = TM.local_to_utc(TM.utc_to_local(back, "America/Phoenix"), "America/Phoenix")
    return t.hist.select(
        "stid",
        F.year(d).alias("year"),
        F.month(d).alias("month"),
        F.dayofmonth(d).alias("day"),
        TM.day_of_year(d).alias("doy"),
        TM.valid_time(d, 3).alias("valid"),
        via_zone.alias("shifted"),
    )


@query(
    "name_tokens",
    "",
    """with f as (select 'TILE_L3_SM_P_E_' || strftime(o_orderdate, '%Y%m%d') || '_R' || o_orderkey || '_001.h5' as file from orders)
    select file, split_part(file, '_', 6) as day, cast(substr(split_part(file, '_', 6), 1, 4) as int) as year from f
    where cast(substr(split_part(file, '_', 6), 1, 4) as int) >= 2000
    union all
    select file, split_part(file, '_', 6), null from f where cast(substr(split_part(file, '_', 6), 1, 4) as int) < 2000""",
)
def name_tokens(t: Inputs):
    """Tile names built from the orders, taken apart again; years before 2000 are no years."""
    day = F.date_format("o_orderdate", "yyyyMMdd")
    file = F.concat(F.lit("TILE_L3_SM_P_E_"), day, F.lit("_R"), F.col("o_orderkey"), F.lit("_001.h5"))
    named = t.table("orders").select(file.alias("file"))
    f = F.col("file")
    return named.select("file", TB.file_token(f, 5).alias("day"), TB.tile_year(f).alias("year"))


@query(
    "missing_days",
    "hist",
    """select s.stid, cast(cast(d as date) as varchar) as day from (select distinct stid from hist),
      generate_series(timestamp '1995-01-01', timestamp '1999-12-31', interval 1 day) g(d)
    where not exists (select 1 from (select distinct stid, cast(date_time as date) as day from hist) h
      where h.stid = stid and h.day = cast(d as date))""".replace("h.stid = stid", "h.stid = s.stid").replace("from hist),", "from hist) s,"),
)
def missing_days(t: Inputs):
    """Days on which a station has nothing."""
    gone = TB.missing_days(t.hist, T, "1995-01-01 00:00:00", "1999-12-31 23:00:00", keys=["stid"])
    return gone.select("stid", F.col("day").cast("string"))


@query(
    "required_days",
    "",
    """select cast(cast(d as date) as varchar) as day from
      generate_series(timestamp '2023-12-25', timestamp '2024-02-05', interval 1 day) g(d)
    where cast(d as date) not in (select cast(ts as date) from events)""",
)
def required_days(t: Inputs):
    """Days missing in the whole store."""
    return TB.missing_days(t.obs, T, "2023-12-25 00:00:00", "2024-02-05 23:00:00").select(F.col("day").cast("string"))


@query(
    "time_alignment",
    "occupied weather",
    """with o as (select stid, date_time from occupied), w as (select stid, date_time from weather)
    select (select count(*) from (select * from o intersect select * from w)) as in_both,
      (select count(*) from (select * from o except select * from w)) as only_first,
      (select count(*) from (select * from w except select * from o)) as only_second""",
)
def time_alignment(t: Inputs):
    return R.side_counts(t.occupied, t.weather, ["stid", T])


@query(
    "station_agreement",
    "obs stations",
    """select (select count(*) from (select stid from obs intersect select stid from stations)) as in_both,
      (select count(*) from (select stid from obs except select stid from stations)) as only_first,
      (select count(*) from (select stid from stations except select stid from obs)) as only_second""",
)
def station_agreement(t: Inputs):
    return R.side_counts(t.obs, t.stations, ["stid"])


@query(
    "metadata_conflicts",
    "stations",
    f"""with b as (select stid, case when stid % 4 = 0 then lat + 1 else lat end as lat, case when stid % 6 = 0 then null else elev end as elev from stations)
    select a.stid, 'lat' as field, {r('a.lat')} as first, {r('b.lat')} as second from stations a join b using (stid) where a.lat is distinct from b.lat
    union all select a.stid, 'elev', {r('a.elev')}, {r('b.elev')} from stations a join b using (stid) where a.elev is distinct from b.elev""",
)
def metadata_conflicts(t: Inputs):
    s, k = t.stations, F.col("stid")
    other = s.withColumns(
        {
            "lat": F.when(k % 4 == 0, F.col("lat") + 1).otherwise(F.col("lat")),
            "elev": F.when(k % 6 != 0, F.col("elev")),
        }
    )
    found = R.metadata_conflicts(s, other, "stid", ["lat", "elev"])
    return found.withColumns({c: F.col(c).cast("double") for c in ("first", "second")})


@query(
    "merged_units",
    "",
    """with m as (select o_orderkey, o_orderstatus as a, o_orderpriority as b, o_orderkey % 2 = 0 as twin from orders)
    select o_orderkey, a as fm, b as wind, case when twin then 'x' end as rain, twin and a <> 'P' as conflict from m""",
)
def merged_units(t: Inputs):
    """Two maps of units per row; entries of the first one win."""
    even = F.col("o_orderkey") % 2 == 0
    first = F.create_map(F.lit("fm"), F.col("o_orderstatus"), F.lit("wind"), F.col("o_orderpriority"))
    second = F.when(even, F.create_map(F.lit("fm"), F.lit("P"), F.lit("rain"), F.lit("x"))).otherwise(
        F.create_map(F.lit("wind"), F.col("o_orderpriority"))
    )
    m = R.merge_maps(first, second)
    return t.table("orders").select(
        "o_orderkey",
        *[F.try_element_at(m, F.lit(k)).alias(k) for k in ("fm", "wind", "rain")],
        F.array_contains(R.map_conflicts(first, second), "fm").alias("conflict"),
    )


@query(
    "stations_by_size",
    "obs",
    "select stid, count(*) as n_rows from obs group by stid",
)
def stations_by_size(t: Inputs):
    return R.stations_by_size(t.obs)


@query(
    "top_fires",
    "",
    f"""select o_orderkey, {r('o_totalprice')} as area from orders where o_orderstatus = 'F' order by o_totalprice desc, o_orderkey limit 50""",
)
def top_fires(t: Inputs):
    """The 50 largest of one kind: a report, so the limit is the feature."""
    big = t.table("orders").where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_totalprice").alias("area"))
    return R.top_by(big, 50, [F.desc("area"), F.col("o_orderkey")])


@query(
    "sensor_units",
    "weather",
    f"""select stid, epoch_us(date_time) as date_time, {r('case when stid % 2 = 0 then temp else temp + 273.15 end')} as temp,
      'Kelvin' as unit, {r('rh * 0.3048')} as elev from weather""",
)
def sensor_units(t: Inputs):
    from tinderframe.functions.physics import feet_to_metres, kelvin_unit, to_kelvin

    unit = F.when(F.col("stid") % 2 == 0, "Kelvin").otherwise("Celsius")
    return t.weather.select(
        "stid",
        T,
        to_kelvin(F.col("temp"), unit).alias("temp"),
        kelvin_unit(unit).alias("unit"),
        feet_to_metres(F.col("rh")).alias("elev"),
    )


@query(
    "describe_columns",
    "",
    """select 'count' as summary, cast(count(l_quantity) as varchar) as qty, cast(count(l_linenumber) as varchar) as line from lineitem
    union all select 'min', cast(min(l_quantity) as varchar), cast(min(l_linenumber) as varchar) from lineitem
    union all select 'max', cast(max(l_quantity) as varchar), cast(max(l_linenumber) as varchar) from lineitem""",
)
def describe_columns(t: Inputs):
    from tinderframe.operators.evaluate import describe

    li = t.table("lineitem").withColumnsRenamed({"l_quantity": "qty", "l_linenumber": "line"})
    return describe(li, ["qty", "line"])


@query(
    "data_fingerprint",
    "obs",
    """with h as (select ('0x' || substr(md5(concat_ws('|', stid::varchar, epoch_us(date_time)::varchar, floor(fm * 1e6 + 0.5)::bigint::varchar)), 1, 15))::bigint as h from obs)
    select count(*) as n, bit_xor(h) as hash_xor, sum(h % 2147483647)::bigint as hash_sum from h""",
)
def data_fingerprint(t: Inputs):
    """Order-free hash of all readings."""
    return R.fingerprint(t.obs.withColumn("date_time", F.col("date_time").cast("timestamp")))


@query(
    "dependency_closure",
    "",
    """with recursive links as (
      select 'c' || c_custkey as feature, 'n' || c_nationkey as needs from customer
      union select 's' || s_suppkey, 'n' || s_nationkey from supplier
      union select 'n' || n_nationkey, 'r' || n_regionkey from nation
      union select 'n' || n_nationkey, 'n' || (n_nationkey * 7 % 25) from nation
      union select 'r0', 'n0'),
    reach as (
      select feature, feature as base from links where feature[1] in ('c', 's')
      union select reach.feature, links.needs from reach join links on links.feature = reach.base)
    select feature, base from reach where base not in (select feature from links)""",
)
def dependency_closure(t: Inputs):
    """What customers and suppliers rest on through nations and regions, with nations that
    need each other and a region that needs a nation."""
    name = lambda mark, key: F.concat(F.lit(mark), F.col(key).cast("string") if isinstance(key, str) else key.cast("string"))
    nation = t.table("nation")
    links = [
        t.table("customer").select(name("c", "c_custkey").alias("feature"), name("n", "c_nationkey").alias("needs")),
        t.table("supplier").select(name("s", "s_suppkey"), name("n", "s_nationkey")),
        nation.select(name("n", "n_nationkey"), name("r", "n_regionkey")),
        nation.select(name("n", "n_nationkey"), name("n", F.col("n_nationkey") * 7 % 25)),
        nation.select(F.lit("r0"), F.lit("n0")),
    ]
    needs = links[0].union(links[1]).union(links[2]).union(links[3]).union(links[4])
    wanted = needs.where(F.substring("feature", 1, 1).isin("c", "s")).select("feature")
    return C.dependency_closure(wanted, needs)
