import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tinderframe.functions import times as TM
from tinderframe.operators import clean as C, reshape as R, spatial as SP
from tinderframe.sources import tables as TB

T0 = datetime(2024, 1, 31, 20)


def obs(spark, n=12, start=T0):
    rows = [(s, start + timedelta(hours=h), float(h)) for s in "ab" for h in range(n)]
    return spark.createDataFrame(rows, "stid string, date_time timestamp, FM double")


def test_observation_store(spark, tmp_path):
    path = str(tmp_path / "obs")
    TB.write_observations(obs(spark), path)
    stations = spark.createDataFrame([("a",), ("zz",)], "stid string")
    got = TB.scan_observations(spark, path, "2024-02-01 00:00:00", "2024-02-01 02:00:00", stations, margin_hours=1)
    assert sorted(r["fm"] for r in got.collect()) == [3.0, 4.0, 5.0, 6.0, 7.0]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan or "PartitionFilters: [" in plan and "year#" in plan.split("PartitionFilters")[1]
    # rewriting some hours keeps the others
    TB.write_observations(obs(spark, 2).withColumn("FM", F.lit(99.0)), path)
    back = spark.read.parquet(path)
    assert back.count() == 24 and back.where("FM = 99").count() == 4


def test_daily_store_adds_only_missing_days(spark, tmp_path):
    path = str(tmp_path / "days")
    TB.write_missing_days(obs(spark, 4), path)
    TB.write_missing_days(obs(spark, 12).withColumn("FM", F.lit(-1.0)), path)
    back = TB.scan_grid(spark, path, "2024-01-31 00:00:00", "2024-02-02 00:00:00")
    assert back.where("FM >= 0").count() == 8 and back.where("FM < 0").count() == 16
    TB.write_missing_days(obs(spark, 12), path)
    assert spark.read.parquet(path).count() == 24
    cut = TB.scan_grid(spark, path, "2024-01-31 22:00:00", "2024-02-01 01:00:00")
    assert cut.count() == 8


def test_required_days(spark):
    df = obs(spark)
    TB.require_days(df, "date_time", "2024-01-31 20:00:00", "2024-02-01 07:00:00")
    with pytest.raises(ValueError, match="2024-01-30, 2024-02-02"):
        TB.require_days(df, "date_time", "2024-01-30 00:00:00", "2024-02-02 00:00:00")
    per = TB.missing_days(df, "date_time", "2024-01-31 00:00:00", "2024-02-02 00:00:00", keys=["stid"]).collect()
    assert sorted((r["stid"], r["day"]) for r in per) == [("a", date(2024, 2, 2)), ("b", date(2024, 2, 2))]


def test_prediction_store(spark, tmp_path):
    path = str(tmp_path / "preds")
    base = obs(spark).withColumnRenamed("FM", "preds")
    both = R.tag_outputs({"ode": base, "clim": base}, 3).unionByName(R.tag_outputs({"ode": base}, 4))
    TB.write_predictions(both, path)
    TB.write_predictions(R.tag_outputs({"ode": base.limit(1)}, 4), path)
    got = {(r["Model"], r["rep"]): r["count"] for r in TB.read_predictions(spark, path).groupBy("Model", "rep").count().collect()}
    assert got == {("ode", 3): 24, ("clim", 3): 24, ("ode", 4): 1}


def test_numbered_outputs(spark, tmp_path):
    for model in ("ode", "clim"):
        for n in (1, 12):
            obs(spark, 2).coalesce(1).write.parquet(str(tmp_path / model / f"out_{n}.parquet"))
    got = TB.read_numbered_outputs(spark, {m: f"{tmp_path}/{m}/*" for m in ("ode", "clim")})
    assert {(r["Model"], r["rep"], r["count"]) for r in got.groupBy("Model", "rep").count().collect()} == {
        (m, n, 4) for m in ("ode", "clim") for n in (1, 12)
    }


def test_files_in_order_of_their_date(spark, tmp_path):
    for day, value in (("20240102", 2.0), ("20240101", 1.0), ("20240103", 3.0)):
        rows = spark.createDataFrame([("a", T0, value), (day, T0, value)], "stid string, date_time timestamp, fm double")
        rows.toPandas().to_parquet(tmp_path / f"day_{day}.parquet", coerce_timestamps="us")
    tagged = TB.with_source_token(TB.read_utc(spark, str(tmp_path)), 1)
    got = {r["stid"]: (r["source"], r["fm"]) for r in R.first_source_wins(tagged, ["stid", "date_time"], "source").collect()}
    assert got["a"] == ("20240101", 1.0) and got["20240103"] == ("20240103", 3.0) and len(got) == 4


def test_csv_list_and_grid_output(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01T00:00:00Z", "2024-01-02 00:00:00", 0)], TB.VALIDITY_SCHEMA)
    TB.write_csv(rows, str(tmp_path / "v"))
    assert TB.read_csv(spark, str(tmp_path / "v"), TB.VALIDITY_SCHEMA).collect() == rows.collect()
    grid = spark.createDataFrame([(T0, 1, 2, 5.0, 1)], "time timestamp, y int, x int, fm_preds double, lsm int")
    TB.write_grid_forecast(grid, str(tmp_path / "g"))
    assert TB.scan_grid(spark, str(tmp_path / "g"), str(T0), str(T0), ts="time").count() == 1


def test_stations_with_text_coordinates(spark):
    s = spark.createDataFrame([("a", "40", "-105"), ("b", "x", "-105"), ("c", "45", "-100"), ("d", "45.1", "-100")], "stid string, lat string, lon string")
    assert [r["stid"] for r in TB.read_stations(s, [40, -105, 45, -100]).orderBy("stid").collect()] == ["a", "c"]


def test_parse_time(spark):
    forms = ["2024-01-01T05:00:00Z", "2024-01-01 05:00:00+00:00", "2024-01-01T05:00:00", "2024-01-01 05:00:00", "2024-01-01T06:00:00+01:00", None]
    df = spark.createDataFrame([(f,) for f in forms], "s string")
    got = [r[0] for r in df.select(TM.parse_time(F.col("s"))).collect()]
    assert got == [datetime(2024, 1, 1, 5)] * 5 + [None]
    bad = spark.createDataFrame([("01/02/2024",)], "s string")
    assert bad.select(TM.parse_time(F.col("s"), strict=False)).first()[0] is None
    with pytest.raises(Exception, match="unsupported time format"):
        bad.select(TM.parse_time(F.col("s"))).collect()


def test_local_time(spark):
    t = TM.as_timestamp("2024-07-01 12:00:00")
    got = spark.range(1).select(TM.local_to_utc(t, "America/Denver"), TM.utc_to_local(t, "America/Denver")).first()
    assert tuple(got) == (datetime(2024, 7, 1, 18), datetime(2024, 7, 1, 6))


def test_required_columns():
    assert C.required_columns(["Ed", "Ew", "wind", "rain", "elev", "lon"]) == {
        "2m": ["rh", "temp"], "10m": ["wind"], "surface": ["rain"], "table": ["elev"], "axis": ["lon"],
    }


def test_first_source_wins(spark):
    a = spark.createDataFrame([("a", T0, 1.0)], "stid string, date_time timestamp, fm double")
    b = spark.createDataFrame([("a", T0, 0.0, "x"), ("b", T0, 2.0, "y")], "stid string, date_time timestamp, fm double, misc string")
    got = {(r["stid"], r["fm"], r["misc"]) for r in R.union_sources([a, b], ["stid", "date_time"]).collect()}
    assert got == {("a", 1.0, None), ("b", 2.0, "y")}


def test_pivot_refuses_duplicates(spark):
    rows = [("a", "fm", 1.0), ("a", "fm", 1.0)]
    df = spark.createDataFrame(rows, "stid string, variable string, value double")
    with pytest.raises(Exception, match="more than one value"):
        R.pivot_variables(df, ["stid"], "variable", "value", ["fm"]).collect()


def test_invalid_intervals_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abbbbb"), T0 + timedelta(minutes=rng.randrange(0, 20_000)), float(i)) for i in range(800)]
    bad = []
    for _ in range(60):
        t = T0 + timedelta(minutes=rng.randrange(-5000, 25_000))
        bad.append((rng.choice("abc"), t, t + timedelta(minutes=rng.choice([0, 30, 3000])), rng.choice([0, 0, 1])))
    bad += [("b", rows[0][1], rows[0][1], 0), ("a", datetime(1900, 1, 1), datetime(1950, 1, 1), 0)]
    df = spark.createDataFrame(rows, "stid string, date_time timestamp, fm double")
    iv = spark.createDataFrame(bad, "stid string, start timestamp, end timestamp, valid int")
    got = {r["fm"] for r in C.drop_invalid_intervals(df, iv).collect()}
    want = {v for s, t, v in rows if not any(s == b[0] and b[1] <= t <= b[2] and b[3] == 0 for b in bad)}
    assert got == want
    forever = spark.createDataFrame([("b", datetime(1, 1, 1), datetime(9999, 12, 31), 0)], iv.schema)
    assert C.drop_invalid_intervals(df, forever).select("stid").distinct().collect() == [("a",)]


def km(lat1, lon1, lat2, lon2):
    from math import asin, cos, radians, sin, sqrt

    a = sin(radians(lat2 - lat1) / 2) ** 2 + cos(radians(lat1)) * cos(radians(lat2)) * sin(radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * asin(sqrt(min(a, 1.0)))


@pytest.mark.parametrize("kind", ["even", "crowded", "globe", "one"])
def test_nearest_node_equals_brute_force(spark, kind):
    rng = random.Random(kind)
    if kind == "one":
        nodes = [(40.0, -100.0)]
    elif kind == "crowded":  # a third of all nodes in a few metres, far from most points
        nodes = [(40 + rng.random() * 1e-4, -100 + rng.random() * 1e-4) for _ in range(400)]
        nodes += [(rng.uniform(30, 50), rng.uniform(-120, -90)) for _ in range(800)] + [nodes[0]] * 20
    elif kind == "globe":
        nodes = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(700)]
    else:
        nodes = [(35 + i * 0.3, -115 + j * 0.3) for i in range(30) for j in range(30)]
    grid = [(i, i % 7, la, lo) for i, (la, lo) in enumerate(nodes)]
    box = (-90, 90, -180, 180) if kind == "globe" else (25, 55, -125, -85)
    points = [(k, rng.uniform(*box[:2]), rng.uniform(*box[2:])) for k in range(150)]
    points += [(1000 + k, nodes[k][0], nodes[k][1]) for k in range(min(20, len(nodes)))]
    g = spark.createDataFrame(grid, "y int, x int, lat double, lon double")
    p = spark.createDataFrame([*points, (9999, None, 1.0)], "stid int, lat double, lon double")
    got = {r["stid"]: (r["dist_km"], r["y"], r["x"]) for r in SP.nearest_join(p, g, leaf=8).collect()}
    want = {s: min((round(km(la, lo, nla, nlo), 6), y, x) for y, x, nla, nlo in grid) for s, la, lo in points}
    assert got.keys() == want.keys()
    for s, w in want.items():
        assert got[s][0] == pytest.approx(w[0], abs=2e-6)
        if got[s] != w:  # only rounding at the sixth place may swap equals
            assert abs(got[s][0] - w[0]) <= 2e-6


def test_nearest_node_of_an_empty_grid(spark):
    g = spark.createDataFrame([], "y int, x int, lat double, lon double")
    p = spark.createDataFrame([(1, 1.0, 1.0)], "stid int, lat double, lon double")
    assert SP.nearest_join(p, g).count() == 0


def test_tight_crop_keeps_the_hull(spark):
    # a sheared grid: the rows and columns of the box hold cells outside it
    g = spark.createDataFrame([(y, x, 40.0 + y, -100.0 + x + 0.5 * y) for y in range(6) for x in range(6)], "y int, x int, lat double, lon double")
    got = SP.tight_crop(g, [41, -99, 43, -98])
    assert {(r["y"], r["x"]) for r in got.collect()} == {(y, x) for y in (1, 2, 3) for x in (0, 1)}


def test_layers_merge_on_all_axes(spark):
    a = spark.createDataFrame([(T0, 0, 0, 1.0)], "time timestamp, y int, x int, a double")
    b = spark.createDataFrame([(T0, 0, 0, 2.0), (T0, 0, 1, 3.0)], "time timestamp, y int, x int, b double")
    got = {(r["x"], r["a"], r["b"]) for r in SP.merge_layers([a, b]).collect()}
    assert got == {(0, 1.0, 2.0), (1, None, 3.0)}
    assert SP.layer_mismatch(a, b, ["time", "y", "x"]).count() == 1


def test_unreadable_files_are_an_error_or_listed(spark, tmp_path):
    rows = [("a", datetime(2024, 1, 1, h), float(h)) for h in range(3)]
    path = str(tmp_path / "store")
    TB.write_observations(spark.createDataFrame(rows, "stid string, date_time timestamp, fm double"), path)
    (tmp_path / "store" / "year=2024" / "doy=1" / "hour=1" / "bad.parquet").write_bytes(b"PAR1 cut off")
    span = ("2024-01-01 00:00:00", "2024-01-01 02:00:00")
    with pytest.raises(Exception):
        TB.scan_observations(spark, path, *span).collect()
    assert TB.scan_observations(spark, path, *span, skip_unreadable=True).count() == 3
    assert [r["file"].rsplit("/", 1)[1] for r in TB.unreadable_files(spark, path).collect()] == ["bad.parquet"]


def test_files_with_a_broken_middle_are_listed(spark, tmp_path):
    """The list is what a tolerant scan leaves out, for the columns in use."""
    path = tmp_path / "store"
    for n in range(3):
        spark.range(n * 50_000, n * 50_000 + 50_000, numPartitions=1).select("id", F.rand(n).alias("v")).write.mode("append").parquet(str(path))
    file = sorted(path.glob("*.parquet"))[1]
    data = file.read_bytes()
    footer = int.from_bytes(data[-8:-4], "little") + 8
    file.write_bytes(data[:4] + bytes(len(data) - 4 - footer) + data[-footer:])
    (path / f".{file.name}.crc").write_bytes(b"")
    lost = TB.unreadable_files(spark, str(path)).collect()
    assert [(r["file"].rsplit("/", 1)[1], r["rows_stored"]) for r in lost] == [(file.name, 50_000)]
    left = spark.read.option("ignoreCorruptFiles", "true").parquet(str(path)).where("v >= 0").count()
    assert left == 150_000 - 50_000 + lost[0]["rows_read"]


def test_a_day_without_a_mark_or_with_a_lost_file_is_written_again(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = [("a", datetime(2024, 1, d, h), float(h)) for d in (1, 2, 3) for h in range(24)]
    df = spark.createDataFrame(rows, "stid string, date_time timestamp, fm double")
    TB.write_days(df.where("day(date_time) = 2 and fm < 5"), path)  # a run that broke off
    assert TB.complete_days(spark, path) is None
    TB.write_missing_days(df, path)
    assert TB.scan_grid(spark, path, "2024-01-01", "2024-01-03 23:00:00").count() == 72
    TB.write_missing_days(df.withColumn("fm", F.lit(-1.0)), path)
    assert TB.scan_grid(spark, path, "2024-01-01", "2024-01-03 23:00:00").where("fm < 0").count() == 0
    for f in (tmp_path / "days" / "year=2024" / "month=1" / "day=3").glob("*.parquet"):
        f.unlink()
    assert sorted(str(r["day"]) for r in TB.complete_days(spark, path).collect()) == ["2024-01-01", "2024-01-02"]
    TB.write_missing_days(df, path)
    assert TB.scan_grid(spark, path, "2024-01-01", "2024-01-03 23:00:00").count() == 72


def test_file_order_survives_a_join(spark, tmp_path):
    for day in ("20240103", "20240101", "20240102"):
        spark.createDataFrame([("a", int(day[-1]))], "stid string, fm int").coalesce(1).write.parquet(f"{tmp_path}/obs_{day}.parquet")
    rows = TB.with_source_token(spark.read.parquet(f"{tmp_path}/*.parquet"), 1).join(spark.createDataFrame([("a",)], "stid string"), "stid")
    got = TB.source_order(rows.repartition(3)).orderBy("file_order").collect()
    assert [(r["source"], r["file_order"], r["fm"]) for r in got] == [("20240101", 1, 1), ("20240102", 2, 2), ("20240103", 3, 3)]


def test_dependency_closure_is_deep_and_safe_against_cycles(spark):
    needs = [("dew", "rh"), ("dew", "temp"), ("Ed", "dew"), ("Ew", "Ed"), ("p", "q"), ("q", "p"), ("q", "x"), ("me", "me"), (None, "y"), ("z", None)]
    needs = spark.createDataFrame(needs, "feature string, needs string")
    wanted = spark.createDataFrame([("Ew",), ("Ew",), ("p",), ("wind",), ("me",)], "feature string")
    got = sorted((r["feature"], r["base"]) for r in C.dependency_closure(wanted, needs).collect())
    assert got == [("Ew", "rh"), ("Ew", "temp"), ("p", "x"), ("wind", "wind")]


def test_stored_days_come_from_folders(spark, tmp_path):
    path = str(tmp_path / "days")
    assert TB.stored_days(spark, path) is None
    rows = [("a", datetime(2024, 1, d), 1.0) for d in (1, 5)]
    TB.write_days(spark.createDataFrame(rows, "stid string, date_time timestamp, fm double"), path)
    days = TB.stored_days(spark, path)
    assert sorted(str(r["day"]) for r in days.collect()) == ["2024-01-01", "2024-01-05"]
    assert "Scan parquet" not in days._jdf.queryExecution().executedPlan().toString()


def test_stage_tables_are_stored_and_dropped(spark):
    from tinderframe.session import cut_lineage, drop_stages

    kept = cut_lineage(spark.range(5), "probe")
    assert kept.count() == 5 and "Scan parquet" in kept._jdf.queryExecution().executedPlan().toString()
    path = kept.inputFiles()[0]
    drop_stages(spark)
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_a_cluster_must_name_its_shared_folder():
    from tinderframe.session import ensure_checkpoint_dir

    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session)
