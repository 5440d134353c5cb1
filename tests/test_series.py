import bisect
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tinderframe.operators import series as S

T0 = datetime(2023, 1, 1)


def frame(spark, rows, schema="stid string, date_time timestamp, fm double"):
    return spark.createDataFrame(rows, schema)


def hours(values, start=T0, stid="a"):
    return [(stid, start + timedelta(hours=i), None if v is None else float(v)) for i, v in values]


def grid_of(spark, rows, start, end):
    out = S.interpolate_hourly(frame(spark, rows), ["stid"], "date_time", ["fm"], start, end)
    return [(r["stid"], r["date_time"], r["fm"]) for r in out.orderBy("stid", "date_time").collect()]


def test_interpolation_clamps_at_both_ends(spark):
    got = grid_of(spark, hours([(0, 10.0), (3, 16.0)]), T0 - timedelta(hours=1), T0 + timedelta(hours=4))
    assert [v for _, _, v in got] == [10, 10, 12, 14, 16, 16]


def test_single_reading_is_held_and_missing_station_gives_nothing(spark):
    rows = [("a", T0 + timedelta(minutes=90), 5.0), ("b", T0, None), ("b", T0, float("nan"))]
    got = grid_of(spark, rows, T0, T0 + timedelta(hours=3))
    assert [(s, v) for s, _, v in got] == [("a", 5.0)] * 4


@pytest.mark.parametrize("seed", range(3))
def test_interpolation_equals_numpy(spark, seed):
    rng = random.Random(seed)
    rows = [
        (s, T0 + timedelta(seconds=rng.randrange(0, 400_000)), rng.choice([None, rng.uniform(0, 50)]))
        for s in "abc"
        for _ in range(rng.choice([1, 5, 60]))
    ]
    rows += [("d", T0 + timedelta(hours=5), 3.0), ("d", T0 + timedelta(hours=9), 4.0)]
    start, end = T0 + timedelta(hours=7), T0 + timedelta(hours=90)
    got = grid_of(spark, rows, start, end)
    marks = [start + timedelta(hours=i) for i in range(84)]
    want = []
    for s in "abcd":
        known = sorted((t.timestamp(), v) for st, t, v in rows if st == s and v is not None)
        if known:
            x, y = zip(*known)
            want += [(s, m, v) for m, v in zip(marks, np.interp([m.timestamp() for m in marks], x, y))]
    assert [g[:2] for g in got] == [w[:2] for w in want]
    np.testing.assert_allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-12)


@pytest.mark.parametrize("most", [1_000_000, 200, 37, 3, 1])
def test_interpolation_at_any_stamp_equals_numpy(spark, most):
    rng = random.Random(5)
    rows = sorted(("a", T0 + timedelta(seconds=rng.randrange(0, 4_000_000)), rng.uniform(0, 50)) for _ in range(70))
    rows = sorted(rows + [("a", T0 + timedelta(days=2, milliseconds=700 * i), float(i)) for i in range(90)])
    asked = sorted({T0 + timedelta(seconds=rng.randrange(-100_000, 4_200_000)) for _ in range(200)} | {rows[3][1]})
    targets = frame(spark, [("a", t) for t in asked], "stid string, date_time timestamp")
    burst = [("a", T0 + timedelta(days=3, microseconds=900 * i), float(i % 7)) for i in range(300)]
    rows = sorted({r[1]: r for r in rows + burst}.values())
    asked = sorted({*asked, *(T0 + timedelta(days=3, microseconds=700 * i) for i in range(100))})
    targets = frame(spark, [("a", t) for t in asked], "stid string, date_time timestamp")
    found = S.interpolate_at(frame(spark, rows), targets, ["stid"], "date_time", "fm", segment=most)
    got = found.orderBy("date_time").collect()
    assert [g["date_time"] for g in got] == asked
    want = np.interp([(t - T0).total_seconds() for t in asked], [(r[1] - T0).total_seconds() for r in rows], [r[2] for r in rows])
    np.testing.assert_allclose([g["fm"] for g in got], want, rtol=1e-6)


def test_parts_are_found_by_halving(spark):
    """A row's part is found without a walk over all cuts of its key, and is the same."""
    rng = random.Random(6)
    lists = [sorted(rng.sample(range(5_000), n)) for n in (0, 1, 2, 3, 511, 512, 1_022, S.MOST_SEGMENTS - 1)]
    asked = [(c, at) for c in lists for at in {-1, 5_000, *c[:2], *c[-2:], *rng.sample(range(5_000), 50)}]
    rows = spark.createDataFrame(asked + [(None, 3), ([1, 2], None)], "cuts array<long>, at long")
    got = rows.select("cuts", "at", S._cut_number(F.col("cuts"), F.col("at")).alias("n")).collect()
    assert all(r["n"] == (bisect.bisect_right(r["cuts"], r["at"]) if r["cuts"] and r["at"] is not None else 0) for r in got)
    readings = frame(spark, [("a", T0 + timedelta(seconds=i), float(i)) for i in range(50)])
    plan = S.bracket(readings, readings, ["stid"], "date_time", "fm", segment=5)._jdf.queryExecution().analyzed().toString()
    assert "_cuts" in plan and "filter(_cuts" not in plan


@pytest.mark.parametrize("partitions", [1, 3, 7, 16])
def test_equal_stamps_give_the_smallest_reading(spark, partitions):
    """Two hundred readings at one stamp, whatever the partitions."""
    rows = [("a", T0, 1.0)] + [("a", T0 + timedelta(minutes=90), float(v)) for v in range(9, 209)]
    df = frame(spark, rows).repartition(partitions)
    got = S.interpolate_hourly(df.withColumn("c", F.col("fm") + 1), ["stid"], "date_time", ["fm"], T0, T0 + timedelta(hours=3), static=["c"])
    values = [(round(r["fm"], 9), r["c"]) for r in got.orderBy("date_time").collect()]
    assert values == [(1.0, 2.0), (round(1 + 8 * 2 / 3, 9), 2.0), (9.0, 2.0), (9.0, 2.0)]
    targets = frame(spark, [("a", T0 + timedelta(minutes=m)) for m in (45, 90, 95)], "stid string, date_time timestamp")
    at = S.interpolate_at(df, targets, ["stid"], "date_time", "fm").orderBy("date_time").collect()
    assert [r["fm"] for r in at] == [5.0, 9.0, 9.0]


def test_first_difference_zeroes_only_the_first_row(spark):
    df = frame(spark, hours([(0, 1.0), (1, 4.0), (2, None), (3, 5.0)]))
    got = S.first_difference(df, ["stid"], "date_time", "fm", "rain").orderBy("date_time").collect()
    assert [g["rain"] for g in got] == [0.0, 3.0, None, None]


def flagged(spark, values, **kw):
    df = S.flag_linear_runs(frame(spark, hours(list(enumerate(values)))), ["stid"], "date_time", "fm", **kw)
    return sorted({(r["st_period"], r["flagged"]) for r in df.collect()})


def test_linear_run_needs_six_points(spark):
    noise = [3.0, 9.0, 1.0]
    assert flagged(spark, noise + [10.0, 11, 12, 13, 14] + [2.0, 7.0]) == [(0, False)]
    assert flagged(spark, noise + [10.0, 11, 12, 13, 14, 15] + [2.0, 7.0]) == [(0, True)]


def test_runs_are_split_at_block_borders(spark):
    values = [1.0, 5.0, 2.0, 10.0, 11.0, 12.0, 13.0, 14.0, 15.0, 2.0, 9.0, 4.0]
    assert flagged(spark, values, n=6) == [(0, False), (1, False)]
    assert flagged(spark, values, n=12) == [(0, True)]


def test_rounding_noise_hides_a_line_unless_tolerated(spark):
    line = list(np.interp(range(10), [0, 9], [7.3, 9.1]))
    assert flagged(spark, line) == [(0, False)]
    assert flagged(spark, line, tol=1e-9) == [(0, True)]


def test_constant_runs(spark):
    assert flagged(spark, [1.0, 2, 2, 2, 2, 3], order=1) == [(0, False)]
    assert flagged(spark, [1.0, 2, 2, 2, 2, 2, 3], order=1) == [(0, True)]


def windows(spark, offsets, n=12):
    df = frame(spark, [("a", T0 + timedelta(hours=h), float(i)) for i, h in enumerate(offsets)])
    return S.sequence_windows(df, ["stid"], "date_time", ["fm"], n).collect()


def test_sequence_windows(spark):
    assert len(windows(spark, range(11))) == 0
    assert len(windows(spark, range(24))) == 13
    assert len(windows(spark, [*range(12), *range(20, 26)])) == 1
    got = windows(spark, range(13))
    assert [[s["fm"] for s in w["seq"]] for w in sorted(got, key=lambda w: w["date_time"])] == [
        [float(i) for i in range(k, k + 12)] for k in (0, 1)
    ]


def test_sequence_windows_over_a_year_gap(spark):
    one = [T0 + timedelta(hours=h) for h in range(30 * 24 + 11)]
    rows = [("a", t, 1.0) for t in one] + [("a", t.replace(year=2024), 1.0) for t in one]
    got = S.sequence_windows(frame(spark, rows), ["stid"], "date_time", ["fm"], 12)
    assert got.count() == 2 * (len(one) - 11)
    assert got.where(F.element_at("seq", -1)["date_time"] != F.col("date_time") + F.expr("interval 11 hours")).count() == 0


def test_hours_are_cut_not_rounded(spark):
    ok = frame(spark, [("a", T0, 1.0), ("a", T0 + timedelta(minutes=110), 1.0), ("b", T0, 1.0), ("b", T0 + timedelta(minutes=59), 1.0)])
    got = {r["stid"]: r["consecutive"] for r in S.is_consecutive(ok, ["stid"], "date_time").collect()}
    assert got == {"a": True, "b": False}


def test_window_coverage_counts_each_window(spark):
    offsets = [*range(5), *range(8, 15)]
    df = frame(spark, [("a", T0 + timedelta(hours=h), float(h)) for h in offsets])
    got = {r["fm"]: r["n_windows"] for r in S.window_coverage(df, ["stid"], "date_time", 3).collect()}
    built = S.sequence_windows(df, ["stid"], "date_time", ["fm"], 3)
    want = {r["fm"]: r["n"] for r in built.select(F.explode("seq.fm").alias("fm")).groupBy("fm").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_spinup_periods_overlap(spark):
    df = frame(spark, [("a", T0 + timedelta(hours=h), float(h)) for h in range(-30, 150)])
    got = S.spinup_periods(df, "date_time", str(T0), 3, 48, 24).collect()
    per = {}
    for r in got:
        per.setdefault(r["period"], []).append((r["step"], r["fm"]))
    assert sorted(per) == [0, 1, 2]
    for k, rows in per.items():
        assert sorted(rows) == [(i, float(48 * k - 24 + i)) for i in range(72)]


def test_rolling_origins(spark):
    df = frame(spark, [("a", T0 + timedelta(hours=h), float(h)) for h in range(-20, 60)])
    got = {(r["origin"], r["split"], r["fm"]) for r in S.rolling_origins(df, "date_time", str(T0), 10, 4, 12, 6).collect()}
    want = {(k, "train" if h < 10 * k else "test", float(h)) for k in range(4) for h in range(10 * k - 12, 10 * k + 6)}
    assert got == want


def test_fingerprint_ignores_partitioning(spark):
    from tinderframe.operators.reshape import fingerprint

    df = frame(spark, [(s, T0 + timedelta(minutes=37 * i), float(i % 17)) for s in "ab" for i in range(300)])
    prints = set()
    for n in (1, 4, 16):
        out = S.interpolate_hourly(df.repartition(n), ["stid"], "date_time", ["fm"], str(T0), "2023-01-10 00:00:00")
        prints.add(tuple(fingerprint(out).first()))
    assert len(prints) == 1 and next(iter(prints))[0] == 2 * 217
