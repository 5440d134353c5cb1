"""Queries that go through a store: written, then read back with pruning.

What is stored is derived by Spark from the given tables (hourly rows, error tables), in
the shared folder the session names for checkpoints.
"""

from pyspark.sql import functions as F

from tinderframe.catalog.inputs import Inputs, query, r
from tinderframe.operators import evaluate as E, reshape as R
from tinderframe.plans import climatology as CL
from tinderframe.session import stage_path
from tinderframe.sources import tables as TB

T = "date_time"


@query(
    "daily_store",
    "weather",
    f"""select stid, epoch_us(date_time) as date_time, {r('rh')} as rh, {r('temp')} as temp from weather
    where date_time between timestamp '2024-01-05 03:00' and timestamp '2024-01-19 21:00'""",
)
def daily_store(t: Inputs):
    """Weather by day in two runs, the second one adding what is missing."""
    path = stage_path(t.spark, "weather")
    early = F.col(T) < F.lit("2024-01-11").cast("timestamp")
    TB.write_missing_days(t.weather.where(early), path)
    # rows of stored days are not written again, whatever they hold now
    changed = t.weather.withColumn("rh", F.when(early, -1.0).otherwise(F.col("rh")))
    TB.write_missing_days(changed, path)
    got = TB.scan_grid(t.spark, path, "2024-01-05 03:00:00", "2024-01-19 21:00:00")
    return got.select("stid", T, "rh", "temp")


@query(
    "observation_store",
    "obs",
    f"""select stid, epoch_us(date_time) as date_time, {r('fm')} as fm from obs
    where date_time between timestamp '2024-01-05 02:00' and timestamp '2024-01-19 22:00' and stid in (select s_suppkey from supplier)""",
)
def observation_store(t: Inputs):
    """Readings stored by hour, and a range of them (one hour of margin) scanned for known stations."""
    path = stage_path(t.spark, "observations")
    TB.write_observations(t.obs, path)
    got = TB.scan_observations(t.spark, path, "2024-01-05 03:00:00", "2024-01-19 21:00:00", t.stations)
    return got.select("stid", T, "fm")


@query(
    "numbered_outputs",
    "pred",
    """select m as "Model", rep, count(*) as n, sum(stid)::bigint as stids from pred,
      (select unnest(['clim', 'ode']) as m) group by 1, 2""",
)
def numbered_outputs(t: Inputs):
    """Files ``<model>_<n>.parquet`` of each replication, read back with model and number."""
    paths = {}
    for model in ("clim", "ode"):
        folder = stage_path(t.spark, model)
        for rep in range(1, 8):  # replications of the prediction table
            t.pred.where(F.col("rep") == rep).select("stid", "fm", "preds").write.parquet(f"{folder}/{model}_{rep}.parquet")
        paths[model] = f"{folder}/*.parquet"
    got = TB.read_numbered_outputs(t.spark, paths)
    return got.groupBy("Model", "rep").agg(F.count(F.lit(1)).alias("n"), F.sum("stid").alias("stids"))


_RMSE = 'select "Model", rep, stid, sqrt(avg((fm - preds) * (fm - preds))) as rmse from pred group by 1, 2, 3'


@query("prediction_store", "pred", f'select "Model", cast(rep as int) as rep, stid, {r("rmse")} as rmse from ({_RMSE})')
def prediction_store(t: Inputs):
    """One folder per model and replication, which come back as columns."""
    path = stage_path(t.spark, "predictions")
    TB.write_predictions(E.station_rep_rmse(t.pred, ["Model", "stid"]), path)
    return TB.read_predictions(t.spark, path).select("Model", "rep", "stid", "rmse")


@query("csv_report", "pred", f'select "Model", stid, {r("avg(rmse)")} as rmse from ({_RMSE}) group by 1, 2')
def csv_report(t: Inputs):
    """Error table as CSV with a header, read with its schema."""
    path = stage_path(t.spark, "report")
    per_rep = E.station_rep_rmse(t.pred, ["Model", "stid"])
    TB.write_csv(per_rep.groupBy("Model", "stid").agg(F.avg("rmse").alias("rmse")), path)
    return TB.read_csv(t.spark, path, "Model string, stid bigint, rmse double")


@query(
    "stacked_outputs",
    "pred",
    f"""with s as (select stid, rep, avg(fm) as fm, avg(preds) as preds from pred group by 1, 2)
    select 'ode' as "Model", 3 as rep, stid, {r('fm')} as fm, {r('preds')} as preds from s
    union all select 'clim', 3, stid, {r('fm')}, {r('fm')} from s""",
)
def stacked_outputs(t: Inputs):
    """Outputs of two models of one replication under each other."""
    s = t.pred.groupBy("stid", "rep").agg(F.avg("fm").alias("fm"), F.avg("preds").alias("preds")).drop("rep")
    out = R.tag_outputs({"ode": s, "clim": s.withColumn("preds", F.col("fm"))}, 3)
    return out.select("Model", "rep", "stid", "fm", "preds")


@query(
    "climatology_wide",
    "hist",
    f"""with f as (select unnest([timestamp '2001-06-05', timestamp '2001-06-06']) as t),
    stamps as (select distinct t, (t - interval 5 year) + interval 1 year * i + interval 1 day * d as s
      from f, (select unnest(range(6)) as i), (select unnest(range(-15, 16)) as d)),
    m as (select stid, t, case when count(distinct year(date_time)) >= 4 then avg(fm10) end as p
      from hist join stamps on date_trunc('hour', date_time) = s where s < t group by 1, 2)
    select stid, {r("max(p) filter (t = timestamp '2001-06-05')")} as "2001-06-05 00:00:00",
      {r("max(p) filter (t = timestamp '2001-06-06')")} as "2001-06-06 00:00:00" from m group by stid having count(p) > 0""",
)
def climatology_wide(t: Inputs):
    """Report with a column per forecast time."""
    times = ["2001-06-05 00:00:00", "2001-06-06 00:00:00"]
    clim = CL.climatology(t.hist, times[0], times[1], "1 day", 5, 15, 4)
    return CL.wide_forecasts(clim, times)


def _damage(spark, folder: str, change) -> None:
    """Replace the bytes of every data file in a folder, in whatever file system it is."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/*.parquet")
    fs = path.getFileSystem(conf)
    for f in fs.globStatus(path):
        stream = fs.open(f.getPath())
        data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        stream.close()
        out = fs.create(f.getPath(), True)
        out.write(bytearray(change(data)))
        out.close()


def _hollow(data: bytes) -> bytes:
    """Good ends around a middle of zeros; the footer is as it was."""
    footer = int.from_bytes(data[-8:-4], "little") + 8
    return data[:4] + bytes(len(data) - footer - 4) + data[-footer:]


@query(
    "unreadable_store",
    "obs",
    """select stid, case when stid = 3 then null else count(*) end as rows_stored, 0::bigint as rows_read,
      (select count(*) from obs where stid not in (3, 5)) as left_over
    from obs where stid in (3, 5) group by stid""",
)
def unreadable_store(t: Inputs):
    """A store of a folder per station, one cut off and one hollow: what a tolerant scan leaves out."""
    path = stage_path(t.spark, "damaged")
    t.obs.hint("rebalance", "stid").write.partitionBy("stid").parquet(path)
    _damage(t.spark, f"{path}/stid=3", lambda data: data[: len(data) // 2])
    _damage(t.spark, f"{path}/stid=5", _hollow)
    lost = TB.unreadable_files(t.spark, path)
    stid = F.regexp_extract("file", "stid=([0-9]+)/", 1).cast("long")
    tolerant = t.spark.read.option("ignoreCorruptFiles", "true").parquet(path).where("fm is not null")
    left = tolerant.agg(F.count(F.lit(1))).first()[0]
    return lost.groupBy(stid.alias("stid")).agg(
        F.sum("rows_stored").alias("rows_stored"), F.sum("rows_read").alias("rows_read"), F.lit(left).alias("left_over")
    )


@query(
    "completed_days",
    "weather",
    f"""select stid, epoch_us(date_time) as date_time, {r("case when date_time >= timestamp '2024-01-12' then rh else rh + 1000 end")} as rh
    from weather where date_time between timestamp '2024-01-05' and timestamp '2024-01-19 21:00'""",
)
def completed_days(t: Inputs):
    """A first run that ended half-way is completed, finished days stay as they are.

    Days before the 11th are stored in full (first values); of the 11th and 12th only some
    hours came through before the run broke off, so their folders are there without a mark.
    """
    path = stage_path(t.spark, "weather-days")
    first = t.weather.withColumn("rh", F.col("rh") + 1000)
    TB.write_missing_days(first.where(F.col(T) < F.lit("2024-01-11").cast("timestamp")), path)
    cut_off = (F.to_date(T) >= F.lit("2024-01-11").cast("date")) & (F.to_date(T) <= F.lit("2024-01-12").cast("date"))
    TB.write_days(first.where(cut_off & (F.hour(T) < 9)), path)
    day = F.to_date(T) == F.lit("2024-01-11").cast("date")
    TB.write_missing_days(t.weather.withColumn("rh", F.when(day, F.col("rh") + 1000).otherwise(F.col("rh"))), path)
    return TB.scan_grid(t.spark, path, "2024-01-05 00:00:00", "2024-01-19 21:00:00").select("stid", T, "rh")


@query(
    "dated_files",
    "pred",
    f"""with d as (select *, '2024010' || (8 - rep) as source, dense_rank() over (order by rep desc) as file_order from pred)
    select stid, source, cast(file_order as int) as file_order, {r('fm')} as fm from (
      select *, row_number() over (partition by stid order by file_order, fm) as k from d) where k = 1""",
)
def dated_files(t: Inputs):
    """Files whose dates run against the order they were written in; the earliest date wins,
    also after a join."""
    folder = stage_path(t.spark, "dated")
    for rep in range(1, 8):  # replications of the prediction table
        t.pred.where(F.col("rep") == rep).select("stid", "fm").write.parquet(f"{folder}/obs_2024010{8 - rep}.parquet")
    rows = TB.with_source_token(t.spark.read.parquet(f"{folder}/*.parquet"), 1)
    known = rows.join(t.pred.select("stid").distinct(), "stid")
    ranked = TB.source_order(known).select("stid", "file_order", "fm", "source")
    return R.first_source_wins(ranked, ["stid"], "file_order").select("stid", "source", "file_order", "fm")
