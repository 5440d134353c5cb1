"""Leakage-free splits over stations and time, for one or many replications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tinderframe.functions.times import as_timestamp, hour_number
from tinderframe.operators.reshape import hash_rank
from tinderframe.session import cut_lineage

Span = tuple[str, str]  # first and last hour, both included


def _hours_in(span: Span) -> Column:
    return hour_number(as_timestamp(span[1])) - hour_number(as_timestamp(span[0])) + 1


def _inside(ts: Column, span: Span) -> Column:
    return ts.between(as_timestamp(span[0]), as_timestamp(span[1]))


def stations_with_coverage(
    df: DataFrame, span: Span, all_times: bool = True, key: str = "stid", ts: str = "date_time"
) -> DataFrame:
    """Stations that have every hour of the span, or at least one of them."""
    whole = df.where(_inside(F.col(ts), span)).where(F.date_trunc("hour", F.col(ts)) == F.col(ts))
    if not all_times:
        return whole.select(key).distinct()
    n = whole.groupBy(key).agg(F.count_distinct(ts).alias("_n"))
    return n.where(F.col("_n") == _hours_in(span)).select(key)


def _coverage(df: DataFrame, spans: dict[str, Span], key: str, ts: str) -> DataFrame:
    """One row per station with the number of whole hours it has in each span, in one pass.

    (station, hour) pairs are made distinct first, so a station with very many rows is
    reduced on the map side to at most one row per hour.
    """
    stamp = F.when(F.date_trunc("hour", F.col(ts)) == F.col(ts), F.col(ts))
    used = F.lit(False)
    for span in spans.values():
        used = used | _inside(stamp, span)
    pairs = df.select(key, F.when(used, stamp).alias("_t")).distinct()
    return pairs.groupBy(key).agg(
        *[F.count_if(_inside(F.col("_t"), span)).alias(f"n_{name}") for name, span in spans.items()]
    )


def spatial_split(
    df: DataFrame,
    val: Span,
    test: Span | None,
    frac: float = 0.1,
    seed: int = 0,
    reps: int = 1,
    all_test_times: bool = False,
    key: str = "stid",
    ts: str = "date_time",
) -> DataFrame:
    """Assign every station to train, val or test, once per replication.

    ``bround(frac * N)`` test stations come from those with data in the test span, as many
    validation stations from the other stations that cover the whole validation span, the
    rest trains. Replication ``r`` uses the seed ``seed + r``; all replications are one
    table ``(rep, stid, split)``. The readings are scanned once, for the station list; the
    draws only see that list.
    """
    spans = {"val": val} | ({"test": test} if test else {})
    stations = cut_lineage(_coverage(df, spans, key, ts))
    size = stations.agg(F.bround(F.count(F.lit(1)) * frac).cast("long")).scalar()
    every = stations.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    rep_seed = F.lit(seed) + F.col("rep")
    if test:
        enough = (F.col("n_test") == _hours_in(test)) if all_test_times else (F.col("n_test") > 0)
        every = every.withColumn("_fit", enough)
        ranked = hash_rank(every, rep_seed, [key], within=["rep", "_fit"], out="_rank")
        chosen = ranked.withColumn("_test", F.col("_fit") & (F.col("_rank") <= size))
    else:
        chosen = every.withColumn("_test", F.lit(False))
    covers = ~F.col("_test") & (F.col("n_val") == _hours_in(val))
    chosen = chosen.drop("_rank", "_fit").withColumn("_fit", covers)
    ranked = hash_rank(chosen, F.concat_ws("_", rep_seed, F.lit("val")), [key], within=["rep", "_fit"], out="_rank")
    split = F.when(F.col("_test"), "test").when(F.col("_fit") & (F.col("_rank") <= size), "val").otherwise("train")
    return ranked.select("rep", key, split.alias("split"))


def spatiotemporal_split(
    df: DataFrame, stations: DataFrame, train: Span, val: Span, test: Span | None, key: str = "stid", ts: str = "date_time"
) -> DataFrame:
    """Rows of each station inside the period of its own split; all other rows drop out.

    Rows outside every period are dropped before the join, so they never shuffle.
    """
    t = F.col(ts)
    spans = {"train": train, "val": val} | ({"test": test} if test else {})
    used, right = F.lit(False), F.lit(False)
    for name, span in spans.items():
        used = used | _inside(t, span)
        right = right | ((F.col("split") == name) & _inside(t, span))
    return df.where(used).join(stations, key).where(right)


def split_spans(tstart: str, tend: str, fstart: str | None, fend: str | None, val_hours: int = 48):
    """Train, validation and test spans: the last ``val_hours`` hours of training validate."""
    from datetime import datetime, timedelta

    end = datetime.fromisoformat(tend)
    train = (tstart, str(end - timedelta(hours=val_hours)))
    val = (str(end - timedelta(hours=val_hours - 1)), tend)
    return train, val, (fstart, fend) if fstart and fend else None


def shuffled_batches(df: DataFrame, keys: Sequence[str], batch_size: int, seed: int, out: str = "batch") -> DataFrame:
    """Seeded permutation of the rows, cut into batches; the last one may be short."""
    ranked = hash_rank(df, F.lit(seed), keys, out="_rank")
    return ranked.withColumn(out, F.floor((F.col("_rank") - 1) / batch_size)).drop("_rank")


def sample_keys(df: DataFrame, n: int, seed: int, key: str = "stid") -> DataFrame:
    """``n`` keys in seeded random order: the operator's own sample size, not a cap."""
    ranked = hash_rank(df.select(key).distinct(), F.lit(seed), [key], out="rank")
    return ranked.where(F.col("rank") <= n)
