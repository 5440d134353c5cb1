"""Plan shapes that decide whether a query survives large and skewed tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tinderframe.operators import evaluate as E, series as S
from tinderframe.plans import climatology as CL

FOLDER = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


def plan_of(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


@pytest.mark.parametrize(
    "name",
    [
        "interp_hourly", "interp_multi", "sensor_series", "source_dedup", "coverage_any", "missing_days", "pivot_vars",
        "occupied_hours", "err_overall", "err_station", "err_all_grains", "mse_rollup", "fmc_bins", "histogram",
        "ensemble_band", "lead_curve", "rep_coverage", "rep_median", "time_alignment", "stations_by_size", "atm_merge",
        "climatology", "linreg_1d", "predictor_summary", "best_config", "err_metrics",
    ],
)
def test_only_aggregated_rows_are_shuffled(spark, name):
    """Below every hash exchange there is an aggregate: raw rows never move."""
    lines = plan_of(queries()[name](spark, FOLDER))
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" not in line:
            continue
        depth = line.index("Exchange")
        below = []
        for after in lines[i + 1 :]:
            if len(after) - len(after.lstrip(" :+-")) <= depth - 1:
                break
            below.append(after)
        text = "\n".join(below)
        assert "Aggregate(" in text or "Scan" not in text, f"{name}: {line.strip()[:120]}"


@pytest.mark.parametrize("name,column", [("scan_range", "ts"), ("climatology", "o_orderdate")])
def test_time_filters_reach_the_scan(spark, name, column):
    plan = "\n".join(plan_of(queries()[name](spark, FOLDER)))
    assert f"GreaterThanOrEqual({column}" in plan


@pytest.mark.parametrize(
    "name,columns",
    [("err_overall", 4), ("interp_hourly", 3), ("histogram", 2), ("stations_by_size", 1)],
)
def test_scans_read_only_what_is_needed(spark, name, columns):
    text = "\n".join(plan_of(queries()[name](spark, FOLDER)))
    schema = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert len(schema.split(",")) == columns


def test_station_chain_shares_one_exchange(spark):
    """Interpolation, rain, runs and windows ride on one partitioning by station."""
    rows = spark.createDataFrame([("a", T0, 1.0)], "stid string, date_time timestamp, fm double")
    hourly = S.interpolate_hourly(rows, ["stid"], "date_time", ["fm"], str(T0), "2024-01-03 00:00:00")
    chain = S.first_difference(hourly, ["stid"], "date_time", "fm", "rain")
    chain = S.flag_linear_runs(chain, ["stid"], "date_time", "fm")
    chain = S.sequence_windows(chain, ["stid"], "date_time", ["fm", "rain", "flagged"], 12)
    exchanges = [x for x in plan_of(chain) if "Exchange hashpartitioning" in x]
    assert len(exchanges) == 2  # readings to hours, hours to stations


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_results_do_not_depend_on_partitions(spark, partitions):
    """A station with most of the rows, any number of partitions: the same result."""
    rng = random.Random(0)
    rows = [("hot" if rng.random() < 0.7 else f"s{rng.randrange(5)}", T0 + timedelta(seconds=rng.randrange(0, 900_000)), float(i % 90)) for i in range(4000)]
    df = spark.createDataFrame(rows, "stid string, date_time timestamp, fm double").repartition(partitions)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        hourly = S.interpolate_hourly(df, ["stid"], "date_time", ["fm"], str(T0), "2024-01-10 00:00:00")
        runs = S.flag_linear_runs(hourly, ["stid"], "date_time", "fm", n=24)
        pred = runs.withColumns({"Model": F.lit("m"), "rep": F.hour("date_time") % 5, "preds": F.col("fm") + F.hour("date_time")})
        metrics = E.named_metrics(pred, ["stid"])
        clim = CL.climatology(df, "2024-01-08 00:00:00", "2024-01-09 00:00:00", "1 hour", 1, 3, 1, value="fm")
        got = (
            sorted((r["stid"], round(r["median"], 9), r["count"]) for r in metrics.collect()),
            sorted((r["stid"], r["forecast_time"], None if r["preds"] is None else round(r["preds"], 9)) for r in clim.collect()),
        )
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    first = test_results_do_not_depend_on_partitions.__dict__.setdefault("first", got)
    assert got == first and len(got[0]) == 6 and len(got[1]) == 6 * 25
