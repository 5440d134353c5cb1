import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from dateutil.relativedelta import relativedelta
from pyspark.sql import functions as F

from tinderframe.functions import physics as P, times as TM
from tinderframe.operators import evaluate as E, reshape as R, scale as SC, split as SP
from tinderframe.plans import build as B, climatology as CL, learners as L, moisture as M, trees as TR, tuning as TU

T0 = datetime(2024, 1, 1)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


# --- physics -----------------------------------------------------------------------------


def test_equilibria(spark):
    rh, temp = F.lit(50.0), F.lit(294.25)
    ed, ew = one(spark, P.drying_equilibrium(rh, temp), P.wetting_equilibrium(rh, temp))
    assert ed == pytest.approx(13.234565, abs=1e-6)
    assert ew == pytest.approx(0.618 * 50**0.753 + 0.000454 * np.exp(5.0), abs=1e-9)


def test_moisture_branches(spark):
    def step(m, ed, ew, rain):
        return one(spark, P.moisture_step(F.lit(m), F.lit(ed), F.lit(ew), F.lit(rain)))[0]

    assert step(10.0, 12.0, 8.0, 5.0) == pytest.approx(17.780507, abs=1e-6)
    assert step(10.0, 12.0, 8.0, 0.05) == 10.0  # between the equilibria nothing happens
    assert step(10.0, 8.0, 6.0, 0.0) == pytest.approx(8 + 2 * np.exp(-0.1))
    assert step(10.0, 14.0, 12.0, 0.0) == pytest.approx(12 - 2 * np.exp(-0.1))


def forcing(spark, fm, ed, ew, rain, stid="a"):
    rows = [(stid, 0, T0 + timedelta(hours=i), *map(float, v)) for i, v in enumerate(zip(fm, ed, ew, rain))]
    return spark.createDataFrame(
        rows, "stid string, period long, date_time timestamp, fm double, Ed double, Ew double, rain double"
    )


def test_filter_on_constant_forcing(spark):
    df = forcing(spark, [10] * 72, [10] * 72, [10] * 72, [0] * 72)
    m = {r["step"]: r for r in M.kalman_forecast(df).collect()}
    for step, want in {0: 0.1, 1: 5.521055, 5: 9.914162, 23: 10.017306, 71: 10.252273}.items():
        assert m[step]["m"] == pytest.approx(want, abs=1e-6)
    assert m[71]["c"] == m[24]["c"] == pytest.approx(0.254223, abs=1e-6)
    assert M.forecast_hours(M.kalman_forecast(df)).count() == 48


def matrix_filter(fm, ed, ew, rain, p=P.MoistureParams()):
    """The same filter with 2x2 matrices, one series."""
    u, cov = np.array([p.m_start, 0.0]), np.eye(2) * p.q
    h, out = np.array([[1.0, 0.0]]), [p.m_start]
    for t in range(1, len(fm)):
        d, w = ed[t] + u[1], ew[t] + u[1]
        if rain[t] > p.r0:
            goal, rate = p.s, (1 - np.exp(-(rain[t] - p.r0) / p.rs)) / p.tr
        elif u[0] <= w:
            goal, rate = w, 1 / p.t
        elif u[0] >= d:
            goal, rate = d, 1 / p.t
        else:
            goal, rate = u[0], 0.0
        a = np.exp(-rate)
        jac = np.array([[a, 1 - a], [0, 1]])
        ahead = np.array([goal + (u[0] - goal) * a, u[1]])
        grown = jac.T @ cov @ jac + (np.eye(2) * p.q if t < p.spinup else 0)
        if t < p.spinup:
            gain = (cov @ h.T) / (h @ cov @ h.T + p.r)
            ahead = ahead - (gain * (ahead[0] - fm[t]))[:, 0]
            grown = grown - gain @ (h @ cov)
        u, cov = ahead, grown
        out.append(u[0])
    return out


def test_filter_equals_matrix_form(spark):
    rng = np.random.default_rng(1)
    ew = rng.uniform(3, 20, (5, 72))
    ed, fm = ew + rng.uniform(0.5, 4, (5, 72)), rng.uniform(2, 40, (5, 72))
    rain = rng.choice([0, 0, 0.04, 3.0, 30.0], (5, 72))
    df = None
    for i in range(5):
        part = forcing(spark, fm[i], ed[i], ew[i], rain[i], f"s{i}")
        df = part if df is None else df.union(part)
    got = {(r["stid"], r["step"]): r["m"] for r in M.kalman_forecast(df.repartition(7)).collect()}
    for i in range(5):
        np.testing.assert_allclose(
            [got[(f"s{i}", t)] for t in range(72)], matrix_filter(fm[i], ed[i], ew[i], rain[i]), rtol=1e-10
        )


def test_incomplete_periods_give_no_forecast(spark):
    assert M.kalman_forecast(forcing(spark, [10] * 71, [10] * 71, [9] * 71, [0] * 71)).count() == 0


def test_gaps_and_missing_observations(spark):
    df = forcing(spark, [10] * 72, [10] * 72, [10] * 72, [0] * 72)
    late = F.when(F.hour("date_time") == 23, F.col("date_time") + F.expr("interval 90 days")).otherwise(F.col("date_time"))
    assert M.kalman_forecast(df.withColumn("date_time", late)).count() == 0
    holed = df.withColumn("fm", F.when(F.col("date_time") != F.lit(T0 + timedelta(hours=5)), F.col("fm")))
    got = {r["step"]: r["m"] for r in M.kalman_forecast(holed).collect()}
    assert got[4] is not None and got[5] is None and got[71] is None


def test_spread_rates(spark):
    x = spark.createDataFrame([(float(v),) for v in (*P.CALM_MOISTURE, 30.01, 50, -1, 12.3)], "fm double")
    got = {r[0]: r[1] for r in x.select("fm", P.spread_rate_calm(F.col("fm"))).collect()}
    for k, v in zip(P.CALM_MOISTURE, P.CALM_SPREAD):
        assert got[float(k)] == pytest.approx(v if k <= 30 else 0.0, abs=1e-15)
    assert got[50.0] == got[30.01] == 0.0 and got[-1.0] > 0.0075
    windy = spark.createDataFrame([(float(v),) for v in P.WINDY_MOISTURE], "fm double")
    rows = windy.select("fm", P.spread_rate_windy(F.col("fm"))).collect()
    want = dict(zip(map(float, P.WINDY_MOISTURE), P.WINDY_SPREAD))
    assert all(r[1] == pytest.approx(want[r[0]], abs=1e-12) for r in rows)


def test_spline_reproduces_a_cubic():
    x = np.array([0.0, 1, 2.5, 4, 7, 9])
    f = lambda v: 1 - 2 * v + 0.5 * v**2 - 0.1 * v**3
    pieces = P.spline_pieces(x, f(x))
    for v in np.linspace(0, 9, 50):
        i = min(np.searchsorted(x, v, side="right") - 1, len(x) - 2)
        a, b, c, d = pieces[i]
        u = v - x[i]
        assert a + b * u + c * u**2 + d * u**3 == pytest.approx(f(v), abs=1e-9)


def test_moisture_classes(spark):
    x = spark.createDataFrame([(0.0,), (9.99,), (10.0,), (20.0,), (-1.0,)], "fm double")
    assert [r[0] for r in x.select(P.moisture_class(F.col("fm"))).collect()] == ["Low", "Low", "Med", "High", None]


# --- climatology ---------------------------------------------------------------------------


def past_times(t, nyears, ndays):
    first = t - relativedelta(years=nyears)
    anchors = [first + relativedelta(years=i) for i in range(nyears + 1)]
    return sorted({a + timedelta(days=d) for a in anchors for d in range(-ndays, ndays + 1) if a + timedelta(days=d) < t})


@pytest.mark.parametrize("t,n", [(datetime(2023, 6, 1, 13), 325), (datetime(2024, 2, 29, 5), 326), (datetime(2024, 3, 1), 325)])
def test_climatology_times(spark, t, n):
    got = one(spark, TM.climatology_times(TM.as_timestamp(t), 10, 15))[0]
    assert sorted(got) == past_times(t, 10, 15) and len(got) == n


def test_climatology_equals_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for s in ("a", "b", "c", "late"):
        first = datetime(2019, 1, 1) if s != "late" else datetime(2023, 11, 1)
        for _ in range(6000):
            t = first + timedelta(minutes=rng.randrange(0, int((datetime(2024, 3, 5) - first).total_seconds() // 60)))
            if t.hour < 3:
                rows.append((s, t, rng.choice([None, rng.uniform(1, 30)])))
    obs = spark.createDataFrame(rows, "stid string, date_time timestamp, fm10 double")
    start, end = datetime(2024, 2, 27), datetime(2024, 3, 2, 2)
    got = {
        (r["stid"], r["forecast_time"]): r["preds"]
        for r in CL.climatology(obs, start, end, "1 hour", 4, 15, 3).collect()
    }
    marks = [start + timedelta(hours=h) for h in range(int((end - start).total_seconds() // 3600) + 1)]
    want = {}
    for m in marks:
        times = {(t.year, t.month, t.day, t.hour) for t in past_times(m, 4, 15)}
        for s in ("a", "b", "c", "late"):
            hit = [(t, v) for st, t, v in rows if st == s and (t.year, t.month, t.day, t.hour) in times]
            known = [v for _, v in hit if v is not None]
            ok = len({t.year for t, _ in hit}) >= 3 and known
            want[(s, m)] = sum(known) / len(known) if ok else None
    some = {s for (s, _), v in want.items() if v is not None}
    assert "late" not in some and len(some) == 3
    assert set(got) == {k for k in want if k[0] in some}
    for k, v in got.items():
        assert v == (pytest.approx(want[k]) if want[k] is not None else None)


def test_wide_forecasts(spark):
    clim = spark.createDataFrame([("a", T0, 1.0), ("b", T0, None), ("b", T0 + timedelta(days=1), 2.0)], "stid string, forecast_time timestamp, preds double")
    got = {tuple(r) for r in CL.wide_forecasts(clim, [T0, T0 + timedelta(days=1)]).collect()}
    assert got == {("a", 1.0, None), ("b", None, 2.0)}


# --- splits ------------------------------------------------------------------------------------


def hourly(spark, n_stations, n_hours, gaps=()):
    rows = [
        (f"s{i:02d}", T0 + timedelta(hours=h), 1.0) for i in range(n_stations) for h in range(n_hours) if (i, h) not in gaps
    ]
    return spark.createDataFrame(rows, "stid string, date_time timestamp, fm double")


def test_split_sizes_and_eligibility(spark):
    gaps = {(i, 30) for i in range(20)} | {(i, h) for i in range(15, 25) for h in range(36, 48)}
    df = hourly(spark, 25, 48, gaps)
    train, val, test = SP.split_spans(str(T0), "2024-01-02 11:00:00", "2024-01-02 12:00:00", "2024-01-02 23:00:00", 12)
    assert (train[1], val[0]) == ("2024-01-01 23:00:00", "2024-01-02 00:00:00")
    splits = SP.spatial_split(df, val, test, 0.1, seed=1, reps=40)
    rows = splits.collect()
    by = {}
    for r in rows:
        by.setdefault(r["rep"], {}).setdefault(r["split"], set()).add(r["stid"])
    assert len(by) == 40 and all(sum(map(len, s.values())) == 25 for s in by.values())
    for s in by.values():
        assert len(s["test"]) == 2 and len(s["val"]) == 2  # 2.5 rounds to even
        assert all(int(x[1:]) < 15 for x in s["test"]) and all(int(x[1:]) >= 20 for x in s["val"])
    assert len({frozenset(s["test"]) for s in by.values()}) > 20
    again = SP.spatial_split(df.repartition(13), val, test, 0.1, seed=1, reps=40).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    cut = SP.spatiotemporal_split(df, splits, train, val, test)
    late = cut.where("split = 'train'").agg(F.max("date_time")).first()[0]
    assert late == datetime(2024, 1, 1, 23)
    assert cut.where("split = 'val'").agg(F.min("date_time")).first()[0] == datetime(2024, 1, 2)


def test_split_without_test_period(spark):
    got = SP.spatial_split(hourly(spark, 10, 6), (str(T0), "2024-01-01 05:00:00"), None, 0.2, seed=3).collect()
    assert sorted(r["split"] for r in got) == ["train"] * 8 + ["val"] * 2


def test_hash_rank_is_a_permutation(spark):
    df = spark.range(5000)
    a = R.hash_rank(df, F.lit(1), ["id"]).collect()
    assert sorted(r["rank"] for r in a) == list(range(1, 5001))
    b = {r["id"]: r["rank"] for r in R.hash_rank(df, F.lit(2), ["id"]).collect()}
    assert sum(b[r["id"]] == r["rank"] for r in a) < 20
    batches = SP.shuffled_batches(df, ["id"], 64, 1).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in batches) == [8] + [64] * 78


# --- scaling, medians, errors -----------------------------------------------------------------


def test_scaling_uses_population_deviation_and_keeps_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    stats = SC.fit_standard(df, ["x", "c"])
    got = [tuple(r) for r in SC.scale(df, stats, ["x", "c"]).collect()]
    assert got == [(-1.0, 0.0), (1.0, 0.0)]
    back = SC.unscale(SC.scale(df, stats, ["x", "c"]), stats, ["x", "c"]).collect()
    assert [tuple(r) for r in back] == [(1.0, 5.0), (3.0, 5.0)]


def test_rows_with_a_missing_feature_are_scored_as_null(spark):
    rows = [(1.0, 2.0, 3.0), (2.0, 4.0, 5.0), (3.0, 7.0, 7.0), (4.0, None, 9.0), (float("nan"), 1.0, 9.0)]
    df = spark.createDataFrame(rows, "x double, z double, fm double")
    got = L.predict(L.fit(L.linear_model(), df, ["x", "z"]), df).collect()
    assert len(got) == 5 and sum(r["preds"] is None for r in got) == 2


def test_grid_scores_all_configurations(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), 2.0 * i + i % 3) for i in range(30)], "a double, b double, fm double")
    metrics, best = TU.run_grid([{"f": ["b"]}, {"f": ["a"]}, {"f": ["a", "b"]}], df, df, lambda c, rows: L.fit(L.linear_model(), rows, c["f"]))
    assert sorted(r["config_id"] for r in metrics.collect()) == [0, 1, 2]
    assert best.first()["config_id"] == 2


@pytest.mark.parametrize("n", [1, 2, 3, 10, 999, 60_000])
def test_exact_median(spark, n):
    rng = random.Random(n)
    rows = [("hot", rng.choice([rng.gauss(0, 1), 0.25])) for _ in range(n)] + [("b", float(i)) for i in range(4)]
    rows += [("same", 7.0)] * 50 + [(None, 1.0), (None, None), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: r["median"] for r in R.exact_median(df, ["k"], "v").collect()}
    assert got["hot"] == np.median([v for k, v in rows if k == "hot"])
    assert (got["b"], got["same"], got[None]) == (1.5, 7.0, 2.5)


def preds(spark, rows):
    return spark.createDataFrame(rows, "Model string, rep int, stid string, date_time timestamp, fm double, preds double")


def test_one_replication_has_no_spread(spark):
    got = E.replication_summary(preds(spark, [("m", 1, "a", T0, 3.0, 1.0), ("m", 1, "a", T0, 5.0, 1.0)]), ["Model"]).first()
    assert got["bias_mean"] == 3.0 and got["rmse_mean"] == pytest.approx(np.sqrt(10))
    assert got["bias_std"] is None and got["rmse_std"] is None


def test_empty_classes_stay(spark):
    got = {r["fm_class"]: r for r in E.class_errors(preds(spark, [("m", 1, "a", T0, 12.0, 10.0)])).collect()}
    assert got["Med"]["bias"] == 2.0 and got["Med"]["rel_error"] == pytest.approx(2 / 12)
    assert got["Low"]["bias"] is None and got["High"]["rmse"] is None


def test_ties_go_to_the_smallest_number(spark):
    rows = [("m", rep, "a", T0, 0.0, e) for rep, e in ((3, 2.0), (1, 2.0), (2, 1.0), (4, 1.0))]
    per_rep = E.station_rep_rmse(preds(spark, rows))
    assert E.worst_replication(per_rep).first()["rep"] == 1
    assert E.typical_replication(per_rep).first()["rep"] == 1  # all are 0.5 away
    metrics = spark.createDataFrame([(7, 1.0), (3, 1.0), (9, 2.0)], "config_id int, mse double")
    assert tuple(E.best_config(metrics, "config_id").first()) == (3, 1.0)


def test_histogram_counts_every_row(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)] + [(None,)], "x double")
    got = {r["bin"]: r["n"] for r in E.histogram(df, ["x"], 40).collect()}
    assert sum(got.values()) == 101 and set(got) == set(range(40)) and got[39] == np.histogram(range(101), 40)[0][39]


def test_half_even_text(spark):
    assert one(spark, E.format_mean_std(F.lit(3.025), F.lit(1.115)))[0] in ("3.02 ± 1.12",)


def test_sensor_rows_with_two_units_are_refused(spark):
    rows = [("a", T0, "air_temp", 1.0, u, 1.0, 2.0, 3.0) for u in ("Celsius", "K")]
    df = spark.createDataFrame(rows, "stid string, date_time timestamp, variable string, value double, units string, lat double, lon double, elev double")
    with pytest.raises(ValueError, match="air_temp"):
        B.sensor_series(df, ["air_temp"], T0, T0)
    got = B.sensor_series(df.limit(1), ["air_temp"], T0, T0 + timedelta(hours=1)).collect()
    assert [r["temp"] for r in got] == [pytest.approx(274.15)] * 2 and got[0]["elev"] == pytest.approx(0.9144)


# --- learners and grids ------------------------------------------------------------------------


def test_trees_learn_a_step(spark):
    df = spark.range(400).select((F.col("id") % 20).cast("double").alias("x"), F.when(F.col("id") % 20 < 10, 1.0).otherwise(9.0).alias("fm"))
    for model in (L.boosted_trees(trees=30), L.random_forest()):
        got = L.predict(L.fit(model, df, ["x"]), df).agg(F.avg(F.abs(F.col("fm") - F.col("preds")))).first()[0]
        assert got < 0.6


def test_default_tree_settings():
    m = L.boosted_trees()
    assert (m.depth, m.rate, m.trees, m.rows, m.columns, m.least_gain) == (3, 0.1, 100, 0.8, 0.9, 0.1)
    f = L.random_forest()
    assert (f.depth, f.trees, f.columns, f.boosted) == (5, 25, 0.8, False)


def test_trees_do_not_depend_on_partitions_or_order(spark, monkeypatch):
    df = spark.range(3000).select(
        "id", F.round(F.sin("id") * 10, 3).alias("a"), (F.col("id") * 7 % 101).cast("double").alias("b"),
        F.when(F.col("id") % 9 > 0, F.cos("id")).alias("c"), (F.sin("id") * 20 + F.col("id") * 7 % 101 / 5).alias("fm"), (F.col("id") % 3).alias("w"),
    )
    for settings in (L.boosted_trees(trees=12), L.random_forest(trees=4)):
        models = []
        for rows, block in ((df, 65_536), (df.orderBy(F.desc("b")).repartition(7), 100)):
            monkeypatch.setattr(TR, "BLOCK", block)
            models.append(L.fit(settings, rows, ["a", "b", "c"], key=["id"], weight="w"))
        one, two = models
        assert one.edges == two.edges and one.base == two.base
        for x, y in zip(one.trees, two.trees):
            assert x.feature.tolist() == y.feature.tolist() and x.bin.tolist() == y.bin.tolist() and x.value.tolist() == y.value.tolist()
        got = L.predict(one, df).agg(F.count_if(F.col("preds").isNull() != F.col("c").isNull()), F.avg(F.abs(F.col("fm") - F.col("preds")))).first()
        assert got[0] == 0 and got[1] < 7


def test_a_split_must_reduce_the_loss(spark):
    """Two groups of 100 rows 0.02 apart lower the squared error by 0.02, less than 0.1."""
    df = spark.range(200).select((F.col("id") % 2).cast("double").alias("x"), (F.col("id") % 2 * 0.02).alias("fm"), "id")
    s = L.boosted_trees(trees=1, rows=1.0, columns=1.0)
    assert (L.fit(s, df, ["x"], key=["id"]).trees[0].feature < 0).all()
    loose = L.fit(L.boosted_trees(trees=1, rows=1.0, columns=1.0, least_gain=0.01), df, ["x"], key=["id"]).trees[0]
    assert loose.feature[0] == 0 and loose.gain[0] == pytest.approx(100 * 100 * 0.01**2 / 101 * 2)


def test_trees_of_no_rows_and_far_values(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 4.0), (2.0, None)], "x double, fm double")
    assert [r["preds"] for r in L.predict(L.fit(L.boosted_trees(trees=2), df.where("false"), ["x"]), df).collect()] == [0.0, None, 0.0]
    assert [r["preds"] for r in L.predict(L.fit(L.boosted_trees(trees=2), df, ["x"]), df).collect()] == [5.0, None, 5.0]


def test_scoring_in_uneven_batches(spark):
    rows = [(f"s{i}", T0 + timedelta(hours=h), float(10 * i + h)) for i in range(7) for h in range(3 + i % 2)]
    df = spark.createDataFrame(rows, "stid string, date_time timestamp, x double")
    from tinderframe.operators.series import ordered_sequence

    def load():
        def predict(x):
            assert x.ndim == 3 and len(x) <= 2
            return x[:, :, 0] * 2

        return predict

    got = L.score_windows(ordered_sequence(df, ["stid"], "date_time", ["x"]), ["stid"], "seq", ["x"], load, batch_size=2)
    assert sorted((r["stid"], r["date_time"], r["preds"]) for r in got.collect()) == sorted((s, t, 2 * x) for s, t, x in rows)


def test_scoring_gives_way_to_memory(spark):
    rows = [(f"s{i}", T0 + timedelta(hours=h), float(i)) for i in range(300) for h in range(2)]
    df = spark.createDataFrame(rows, "stid string, date_time timestamp, x double").coalesce(1)
    from tinderframe.operators.series import ordered_sequence

    class Full(Exception):
        pass

    def load(room):
        def predict(x):
            if len(x) > room:
                raise Full
            return x[:, :, 0] * 2

        return lambda: predict

    seqs = ordered_sequence(df, ["stid"], "date_time", ["x"]).coalesce(1)
    steps = spark.sparkContext.accumulator(0)
    got = L.score_windows(seqs, ["stid"], "seq", ["x"], load(100), out_of_memory=(Full,), fallbacks=steps).collect()
    assert sorted((r["stid"], r["date_time"], r["preds"]) for r in got) == sorted((s, t, 2 * x) for s, t, x in rows)
    assert steps.value == 2  # 300 -> 150 -> 75
    with pytest.raises(Exception, match="Full"):
        L.score_windows(seqs, ["stid"], "seq", ["x"], load(20), out_of_memory=(Full,)).collect()


def test_published_search_space(spark):
    archs = TU.model_grid(spark).collect()
    assert len(archs) == 812
    for a in archs:
        units = [u for u in a["hidden_units"] if u is not None]
        assert units == sorted(units, reverse=True)
        assert (a["hidden_layers"][-1] == "dropout") == ("dense" in a["hidden_layers"])
        assert a["hidden_activation"] == [TU.ACTIVATIONS.get(n) for n in a["hidden_layers"]]
    grid = TU.param_grid(spark, TU.OPTIMIZATION)
    assert grid.count() == 180 and grid.select("config_id").distinct().count() == 180
    first = grid.orderBy("config_id").first()
    assert (first["learning_rate"], first["batch_size"], first["dropout"]) == (0.05, 16, 0.05)


def test_period_gate_needs_two_stations(spark):
    f = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0), ("a", 1, 3.0), ("c", 1, 4.0)], "stid string, period int, preds double")
    s = spark.createDataFrame([(0, "a", "test"), (0, "b", "test"), (0, "c", "train"), (1, "a", "test")], "rep int, stid string, split string")
    got = {(r["rep"], r["period"], r["stid"]) for r in B.for_replications(f, s).collect()}
    assert got == {(0, 0, "a"), (0, 0, "b")}
