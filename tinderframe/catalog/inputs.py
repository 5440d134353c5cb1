"""The given tables seen as station data, for Spark and (as SQL text) for the oracle.

Nothing here limits, samples or filters the tables: every query sees all their rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tinderframe.operators.series import interpolate_hourly
from tinderframe.sources.tables import read_table

START, END = "2024-01-01 00:00:00", "2024-01-30 23:00:00"  # the hours of the events table
SERIES_HOURS = 720
BBOX = [38.0, -108.0, 44.0, -98.0]


class Inputs:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    @cached_property
    def obs(self) -> DataFrame:
        e = self.table("events")
        return e.select((F.col("user_id") % 16).alias("stid"), F.col("ts").alias("date_time"), F.col("value").alias("fm"))

    @cached_property
    def hourly(self) -> DataFrame:
        return interpolate_hourly(self.obs, ["stid"], "date_time", ["fm"], START, END)

    @cached_property
    def occupied(self) -> DataFrame:
        """One row per occupied hour, gaps left open."""
        return self.obs.groupBy("stid", F.date_trunc("hour", "date_time").alias("date_time")).agg(F.avg("fm").alias("fm"))

    @cached_property
    def stations(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.table("supplier").select(
            k.alias("stid"),
            (37 + (k * 7919 % 900).cast("double") / 100).alias("lat"),
            (-111 + (k * 104729 % 1600).cast("double") / 100).alias("lon"),
            F.col("s_acctbal").alias("elev"),
        )

    @cached_property
    def grid(self) -> DataFrame:
        c = self.table("customer")
        rows = c.agg((F.floor(F.max("c_custkey") / 40) + 1).cast("double").alias("n")).scalar()
        k = F.col("c_custkey")
        y, x = F.floor(k / 40), k % 40
        return c.select(
            y.alias("y"),
            x.alias("x"),
            (37 + 9 * y.cast("double") / rows).alias("lat"),
            (-111 + 16 * x.cast("double") / 40).alias("lon"),
            F.when(k % 97 == 0, -9999.0).otherwise(1000 + F.col("c_acctbal") / 10).alias("elev"),
            F.when(k % 7 == 0, 0).otherwise(1).alias("lsm"),
        )

    @cached_property
    def atm(self) -> DataFrame:
        return (
            self.table("lineitem")
            .groupBy((F.col("l_suppkey") % 16).alias("stid"), (F.col("l_orderkey") % 720).alias("hr"))
            .agg(
                (F.avg("l_quantity") * 2).alias("rh"),
                (270 + F.avg("l_tax") * 500).alias("temp"),
                F.when(F.max("l_discount") > 0.095, F.avg("l_discount") * 40).otherwise(0.0).alias("rain"),
            )
        )

    @cached_property
    def weather(self) -> DataFrame:
        """Weather with its instant in place of the hour number."""
        hour = F.timestamp_seconds(F.unix_seconds(F.lit(START).cast("timestamp")) + F.col("hr") * 3600)
        return self.atm.select("stid", hour.alias("date_time"), "rh", "temp", "rain")

    @cached_property
    def pred(self) -> DataFrame:
        hours = F.make_dt_interval(hours=(F.col("l_orderkey") % 24).cast("int"))
        return self.table("lineitem").select(
            F.col("l_returnflag").alias("Model"),
            F.col("l_linenumber").alias("rep"),
            F.col("l_suppkey").alias("stid"),
            (F.col("l_shipdate") + hours).alias("date_time"),
            F.col("l_quantity").alias("fm"),
            (F.col("l_extendedprice") / 2000).alias("preds"),
        )

    @cached_property
    def hist(self) -> DataFrame:
        return self.table("orders").select(
            (F.col("o_custkey") % 25).alias("stid"),
            F.col("o_orderdate").alias("date_time"),
            (F.col("o_totalprice") / 10000).alias("fm10"),
        )


# The same views as SQL for the oracle. "hourly" is built another way than in Spark: all
# readings and all whole hours in one ordered list, nearest readings by IGNORE NULLS.
VIEW_SQL = {
    "obs": "select user_id % 16 as stid, ts as date_time, value as fm from events",
    "occupied": "select stid, date_trunc('hour', date_time) as date_time, avg(fm) as fm from obs group by all",
    "stations": (
        "select s_suppkey as stid, 37 + cast(s_suppkey * 7919 % 900 as double) / 100 as lat, "
        "-111 + cast(s_suppkey * 104729 % 1600 as double) / 100 as lon, s_acctbal as elev from supplier"
    ),
    "grid": (
        "select y, x, 37 + 9 * cast(y as double) / (select cast(floor(max(c_custkey) / 40) as bigint) + 1 from customer) as lat, "
        "-111 + 16 * cast(x as double) / 40 as lon, "
        "case when id % 97 = 0 then -9999.0e0 else 1000 + bal / 10 end as elev, "
        "case when id % 7 = 0 then 0 else 1 end as lsm "
        "from (select c_custkey as id, cast(floor(c_custkey / 40) as bigint) as y, c_custkey % 40 as x, c_acctbal as bal from customer) c"
    ),
    "atm": (
        "select l_suppkey % 16 as stid, l_orderkey % 720 as hr, avg(l_quantity) * 2 as rh, 270 + avg(l_tax) * 500 as temp, "
        "case when max(l_discount) > 0.095e0 then avg(l_discount) * 40 else 0.0e0 end as rain "
        "from lineitem group by l_suppkey % 16, l_orderkey % 720"
    ),
    "weather": f"select stid, timestamp '{START}' + interval 1 hour * hr as date_time, rh, temp, rain from atm",
    "pred": (
        'select l_returnflag as "Model", l_linenumber as rep, l_suppkey as stid, '
        "l_shipdate + interval '1' hour * cast(l_orderkey % 24 as int) as date_time, "
        "l_quantity as fm, l_extendedprice / 2000 as preds from lineitem"
    ),
    "hist": "select o_custkey % 25 as stid, o_orderdate as date_time, o_totalprice / 10000 as fm10 from orders",
    "marks": (
        f"select stid, h as date_time from (select distinct stid from obs), "
        f"generate_series(timestamp '{START}', timestamp '{END}', interval 1 hour) s(h)"
    ),
    "placed": (
        "select stid, epoch_us(date_time) as us, epoch_us(date_time) as kus, fm, 0 as mark from obs "
        "union all select stid, epoch_us(date_time), null, null, 1 from marks"
    ),
    "bracketed": (
        "select stid, us, mark, last_value(kus ignore nulls) over l as t0, last_value(fm ignore nulls) over l as v0, "
        "first_value(kus ignore nulls) over r as t1, first_value(fm ignore nulls) over r as v1 from placed "
        "window l as (partition by stid order by us, mark rows between unbounded preceding and current row), "
        "r as (partition by stid order by us, mark desc rows between current row and unbounded following)"
    ),
    "hourly": (
        "select stid, make_timestamp(us) as date_time, case when t0 is null then v1 when t1 is null or t1 = t0 then v0 "
        "else v0 + (v1 - v0) / (t1 - t0) * (us - t0) end as fm from bracketed where mark = 1"
    ),
}
NEEDS = {
    "occupied": ["obs"],
    "weather": ["atm"],
    "marks": ["obs"],
    "placed": ["obs", "marks"],
    "bracketed": ["placed"],
    "hourly": ["bracketed"],
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Doubles to six places, stamps as microseconds: comparable between engines.

    Exact halves are common (means of prices), and a last-bit difference would send them
    either way; the small allowance sends all of them up. Zero has no sign afterwards.
    """
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double":
            c = F.floor(c * 1e6 + 0.5001) / 1e6
        elif kind == "timestamp":
            c = F.unix_micros(c)
        cols.append(c.alias(name))
    return df.select(*cols)


def r(expr: str) -> str:
    """SQL counterpart of :func:`plain` for a double."""
    return f"floor(({expr}) * 1e6 + 0.5001) / 1e6"


def with_views(views: str, body: str) -> str:
    names: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in names:
            names.append(name)

    for v in views.split():
        add(v)
    ctes = ", ".join(f"{n} as ({VIEW_SQL[n]})" for n in names)
    body = " ".join(body.split())
    if not ctes:
        return body
    if body.startswith("with "):
        return f"with recursive {ctes}, {body[5:]}"
    return f"with recursive {ctes} {body}"


def query(name: str, views: str = "", sql: str | None = None):
    """Register a query; ``views`` are the adapter views its oracle text uses."""

    def register(build: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, folder: plain(build(Inputs(spark, folder)))
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return build

    return register
