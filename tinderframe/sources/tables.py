"""Reading and writing landed tables: partitioned stores, CSV lists, prediction folders."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from tinderframe.functions.times import as_timestamp
from tinderframe.operators.clean import within_bbox
from tinderframe.session import cut_lineage, use_utc


def read_utc(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with zone-less stamps taken as UTC instants.

    The stored schema is re-read with TIMESTAMP in place of TIMESTAMP_NTZ, not cast, so
    time filters still reach the scan.
    """
    use_utc(spark)
    stored = spark.read.parquet(path).schema
    zoned = [
        T.StructField(f.name, T.TimestampType() if f.dataType == T.TimestampNTZType() else f.dataType, f.nullable)
        for f in stored
    ]
    return spark.read.schema(T.StructType(zoned)).parquet(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_utc(spark, f"{folder}/{name}.parquet")


# --- stations and observations --------------------------------------------------------


def read_stations(stations: DataFrame, bbox, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Stations inside a closed box; text coordinates that are no numbers become null and drop out."""
    located = stations.withColumns({c: F.col(c).try_cast("double") for c in (lat, lon)})
    return located.where(within_bbox(F.col(lat), F.col(lon), bbox))


def _hour_code(year: Column, doy: Column, hour: Column) -> Column:
    return (year * 1000 + doy) * 100 + hour


def write_observations(df: DataFrame, path: str, ts: str = "date_time") -> None:
    """Store by year, day of year and hour. Re-running replaces only the hours written.

    The rebalance hint collects each hour in few files and lets AQE split an hour that is
    too large for one task.
    """
    t = F.col(ts)
    parts = df.withColumns({"year": F.year(t), "doy": F.dayofyear(t), "hour": F.hour(t)})
    (
        parts.hint("rebalance", "year", "doy", "hour")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year", "doy", "hour")
        .parquet(path)
    )


def scan_observations(
    spark: SparkSession,
    path: str,
    start,
    end,
    stations: DataFrame | None = None,
    margin_hours: int = 1,
    skip_unreadable: bool = False,
) -> DataFrame:
    """Observations of ``[start, end]`` plus a margin, of the given stations.

    Hours outside are pruned by partition; column names come out in lower case; the station
    filter is a semi-join right above the scan. An unreadable file is an error, unless
    ``skip_unreadable`` leaves such files out; :func:`unreadable_files` lists them.
    """
    use_utc(spark)
    lo, hi = (_to_datetime(t) + timedelta(hours=s * margin_hours) for t, s in ((start, -1), (end, 1)))
    df = spark.read.option("ignoreCorruptFiles", str(skip_unreadable).lower()).parquet(path)
    code = _hour_code(F.col("year"), F.col("doy"), F.col("hour"))
    bounds = [int(t.strftime("%Y%j%H")) for t in (lo, hi)]
    df = df.where(code.between(*bounds)).toDF(*[c.lower() for c in df.columns])
    df = df.where(F.col("date_time").between(as_timestamp(lo), as_timestamp(hi)))
    if stations is not None:
        df = df.join(stations.select("stid").distinct(), "stid", "left_semi")
    return df


def unreadable_files(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Files of a store from which a scan with ``skip_unreadable`` leaves rows out, as (file,
    rows_stored, rows_read); ``rows_stored`` is null where not even the footer can be read.

    No file is fetched whole. All files are listed without their contents; a scan of no
    columns counts the rows that footers promise and reads nothing else; a scan of
    ``columns`` (default: all) counts the rows that can be decoded, so damage anywhere inside
    the columns in use shows. All three are ordinary scans: distributed, in ranges, and on any
    file system.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    stored = spark.read.option("ignoreCorruptFiles", "true").parquet(path)
    name = F.col("_metadata.file_path")
    counted = lambda df, out: df.groupBy(name.alias("file")).agg(F.count(F.lit(1)).alias(out))
    values = F.xxhash64(*[F.col(c) for c in (columns or stored.columns)])
    # no row fails this, but the optimizer cannot know it, so the scan has to decode the values
    decoded = counted(stored.where(values.bitwiseAND(F.lit(0)) == 0), "rows_read")
    every = listed.select(F.col("path").alias("file"))
    both = every.join(counted(stored, "rows_stored"), "file", "left").join(decoded, "file", "left")
    both = both.withColumn("rows_read", F.coalesce("rows_read", F.lit(0)).cast("long"))
    return both.where(F.col("rows_stored").isNull() | (F.col("rows_read") < F.col("rows_stored")))


def _to_datetime(t) -> datetime:
    return t if isinstance(t, datetime) else datetime.fromisoformat(str(t))


# --- daily stores -----------------------------------------------------------------------


def calendar_days(spark: SparkSession, start, end) -> DataFrame:
    first, last = as_timestamp(start).cast("date"), as_timestamp(end).cast("date")
    return spark.range(1).select(F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias("day"))


def missing_days(df: DataFrame, ts: str, start, end, keys: Sequence[str] = ()) -> DataFrame:
    """Calendar days of the range without any row, over the table or for every key in it.

    Rows shrink to distinct days on the map side before anything is shuffled.
    """
    keys = list(keys)
    first = F.date_trunc("day", as_timestamp(start))
    after = F.date_trunc("day", as_timestamp(end)) + F.expr("interval 1 day")
    have = df.where((F.col(ts) >= first) & (F.col(ts) < after)).select(*keys, F.to_date(ts).alias("day")).distinct()
    wanted = calendar_days(df.sparkSession, start, end)
    if keys:
        days = F.sequence(first.cast("date"), as_timestamp(end).cast("date"), F.expr("interval 1 day"))
        wanted = df.select(*keys).distinct().withColumn("day", F.explode(days))
    return wanted.join(have, [*keys, "day"], "left_anti")


def require_days(df: DataFrame, ts: str, start, end) -> None:
    """Stop with the list of missing days, if any."""
    gone = [str(r["day"]) for r in missing_days(df, ts, start, end).orderBy("day").collect()]
    if gone:
        raise ValueError(f"missing input days: {', '.join(gone)}")


def write_days(df: DataFrame, path: str, ts: str = "date_time") -> None:
    """Store by year, month and day; days in ``df`` replace stored ones, others stay."""
    t = F.col(ts)
    parts = df.withColumns({"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t)})
    (
        parts.hint("rebalance", "year", "month", "day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year", "month", "day")
        .parquet(path)
    )


def stored_days(spark: SparkSession, path: str) -> DataFrame | None:
    """Days a store has, listed from its partition folders (no file is opened); None if there
    is no store yet."""
    jvm = spark._jvm
    folders = jvm.org.apache.hadoop.fs.Path(f"{path}/year=*/month=*/day=*")
    found = folders.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folders) or []
    days = [tuple(int(part.split("=")[1]) for part in f.getPath().toString().split("/")[-3:]) for f in found]
    return spark.createDataFrame([(date(*d),) for d in days], "day date") if days else None


#: Folder of the marks inside a store; scans pass over names with an underscore.
MARKS = "_complete"


def _rows_by_day(spark: SparkSession, path: str) -> DataFrame:
    """Rows a daily store holds per day, from its files' footers."""
    got = spark.read.parquet(path).groupBy("year", "month", "day").agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.make_date("year", "month", "day").alias("day"), "n")


def complete_days(spark: SparkSession, path: str) -> DataFrame | None:
    """Days that were written to their end: marked, and with as many rows as their last mark
    says; None if there is no mark yet. A folder alone proves nothing."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MARKS}")
    if stored_days(spark, path) is None or not marks.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marks):
        return None
    last = spark.read.schema("day date, n long, written timestamp").parquet(f"{path}/{MARKS}")
    last = last.groupBy("day").agg(F.max_by("n", "written").alias("n"))
    return last.join(_rows_by_day(spark, path), ["day", "n"], "left_semi").select("day")


def mark_days(spark: SparkSession, path: str, days: DataFrame) -> None:
    """Mark (day)s as complete, after all their files are in place."""
    if stored_days(spark, path) is None:
        return
    marks = _rows_by_day(spark, path).join(days, "day", "left_semi").withColumn("written", F.current_timestamp())
    marks.coalesce(1).write.mode("append").parquet(f"{path}/{MARKS}")


def write_missing_days(df: DataFrame, path: str, ts: str = "date_time") -> None:
    """Add the days a store does not have in full; a second run writes nothing.

    A day counts once it is marked, and marks are written after the files. A run that ended
    half-way, or a day that lost a file since, is written again by the next run.
    """
    spark = df.sparkSession
    have = complete_days(spark, path)
    if have is not None:
        have = cut_lineage(have, "complete-days")  # the files it was read from are replaced below
        df = df.join(have, F.to_date(ts) == have["day"], "left_anti")
    write_days(df, path, ts)
    mark_days(spark, path, df.select(F.to_date(ts).alias("day")).distinct())


def scan_grid(spark: SparkSession, path: str, start, end, ts: str = "date_time") -> DataFrame:
    """Gridded weather of the closed range ``[start, end]``, other days pruned."""
    use_utc(spark)
    lo, hi = _to_datetime(start), _to_datetime(end)
    code = (F.col("year") * 100 + F.col("month")) * 100 + F.col("day")
    days = code.between(int(lo.strftime("%Y%m%d")), int(hi.strftime("%Y%m%d")))
    return spark.read.parquet(path).where(days & F.col(ts).between(as_timestamp(lo), as_timestamp(hi)))


# --- predictions and lists ---------------------------------------------------------------


def write_predictions(df: DataFrame, path: str) -> None:
    """One folder per model and replication; a rerun of a replication replaces its own."""
    (
        df.hint("rebalance", "Model", "rep")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("Model", "rep")
        .parquet(path)
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(path)


def read_numbered_outputs(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Outputs ``..._<n>.parquet`` of several models, tagged with model and number ``n``."""
    use_utc(spark)
    out = None
    for model, path in paths.items():
        number = F.regexp_extract(F.input_file_name(), r"_(\d+)\.[a-z0-9]+(?:/[^/]*)?$", 1).cast("int")
        df = spark.read.parquet(path).withColumns({"rep": number, "Model": F.lit(model)})
        out = df if out is None else out.unionByName(df)
    return out


def file_token(name: Column, index: int, sep: str = "_") -> Column:
    """Token of a file name, without its extension."""
    return F.get(F.split(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), sep), index)


def with_source_token(df: DataFrame, index: int = 1, out: str = "source") -> DataFrame:
    """Tag rows of a scan with a token of their file's name, e.g. the date that orders the
    files. The name comes with each row from the scan, so joins and splits do not lose it. A
    file written by Spark is a folder of parts; the folder's name counts."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    own = F.element_at(parts, -1)
    return df.withColumn(out, file_token(F.when(own.startswith("part-"), F.element_at(parts, -2)).otherwise(own), index))


def source_order(df: DataFrame, source: str = "source", out: str = "file_order") -> DataFrame:
    """Rank of each source among all of the table (1 is the first), as :func:`first_source_wins`
    takes it. Only the distinct tokens are sorted: one per file."""
    tokens = df.select(source).distinct()
    ranked = tokens.select(F.col(source).alias("_s"), F.row_number().over(W.orderBy(F.asc_nulls_last(source))).alias(out))
    return df.join(F.broadcast(ranked) if tokens.count() <= MOST_FILES else ranked, df[source].eqNullSafe(ranked["_s"])).drop("_s")


def tile_year(name: Column, index: int = 5) -> Column:
    """Year of a satellite tile from the date token of its name; null outside 2000-2100."""
    year = F.substring(file_token(name, index), 1, 4).try_cast("int")
    return F.when(year.between(2000, 2100), year)


#: Files up to which their order is sent to every task.
MOST_FILES = 100_000
VALIDITY_SCHEMA = "stid string, start string, end string, valid int"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_grid_forecast(df: DataFrame, path: str) -> None:
    """Gridded forecast in long form with its inputs and land mask, by day."""
    write_days(df, path, "time")
