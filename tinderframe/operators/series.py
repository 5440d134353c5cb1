"""Hourly series: interpolation, differences, blocks, runs, windows, periods.

Raw readings of one station are unbounded, so they are first reduced to at most one row
per (station, hour) by a map-side combined aggregate. After that a station is bounded by
the calendar (8,766 rows a year), which is what makes a window per station safe here.
All operators below the first section expect such an hourly table and share one exchange
on the station key when they are chained.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tinderframe.functions.times import (
    HOUR_SECONDS,
    as_timestamp,
    hour_number,
    hour_start,
    micros_between,
    whole_hours_between,
)
from tinderframe.session import cut_lineage

# --- regular grid -------------------------------------------------------------------


def hourly_knots(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """First and last non-null reading of every column in each occupied hour; of readings at
    one stamp the smallest counts.

    Readings between the two can never bracket a whole hour, so nothing else is needed.
    """
    aggs = []
    for c in cols:
        known = F.col(c).isNotNull() & ~F.isnan(c)
        stamp, value = F.unix_micros(F.col(ts)).alias("t"), F.col(c).cast("double")
        aggs += [
            F.min(F.when(known, F.struct(stamp, value.alias("v")))).alias(f"_first_{c}"),
            F.max(F.when(known, F.struct(stamp, (-value).alias("v")))).alias(f"_last_{c}"),
        ]
    any_known = F.coalesce(*[F.when(~F.isnan(c), F.col(c)) for c in cols]).isNotNull()
    found = df.where(any_known).groupBy(*keys, hour_number(F.col(ts)).alias("_hour")).agg(*aggs)
    ends = {}
    for c in cols:
        ends |= {f"_t0_{c}": F.col(f"_first_{c}.t"), f"_v0_{c}": F.col(f"_first_{c}.v")}
        ends |= {f"_t1_{c}": F.col(f"_last_{c}.t"), f"_v1_{c}": -F.col(f"_last_{c}.v")}
    return found.select(*keys, "_hour", *[v.alias(n) for n, v in ends.items()])


def _between(t: Column, t0: Column, v0: Column, t1: Column, v1: Column) -> Column:
    """Linear interpolation at ``t``; one missing side means the other side's value."""
    line = v0 + (v1 - v0) / (t1 - t0) * (t - t0)
    return F.when(t0.isNull() | (t == t1), v1).when(t1.isNull() | (t == t0), v0).otherwise(line)


def interpolate_hourly(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    cols: Sequence[str],
    start,
    end,
    static: Sequence[str] = (),
) -> DataFrame:
    """Every whole hour of ``[start, end]`` for every key, values interpolated linearly.

    Nulls are skipped column by column; before the first and after the last reading the
    nearest value is held. A key without any reading gives no rows. ``static`` columns are
    constants of the key and are repeated (the first reading's value, at equal stamps the
    smallest). Of several readings at one stamp the smallest counts.

    An occupied hour emits the marks from the previous occupied hour up to its own start,
    the last one also the tail, so the grid needs no join. Two exchanges in all: the
    aggregate to hours and the window per key.
    """
    keys = list(keys)
    micros = HOUR_SECONDS * 1_000_000
    knots = hourly_knots(df, keys, ts, cols)
    asc = W.partitionBy(*keys).orderBy("_hour")
    # a growing frame on the reversed order costs O(n); "current to end" would cost O(n^2)
    back = W.partitionBy(*keys).orderBy(F.desc("_hour"))
    upto, here_on = (
        asc.rowsBetween(W.unboundedPreceding, W.currentRow),
        back.rowsBetween(W.unboundedPreceding, W.currentRow),
    )
    before = asc.rowsBetween(W.unboundedPreceding, -1)
    brackets = {}
    for c in cols:
        for side in ("t", "v"):
            left, right = F.col(f"_{side}1_{c}"), F.col(f"_{side}0_{c}")
            if len(cols) == 1:  # every row has a reading: its neighbours are the nearest ones
                found = F.lag(left).over(asc), left, right
            else:
                found = (
                    F.last(left, ignorenulls=True).over(before),
                    F.last(left, ignorenulls=True).over(upto),
                    F.last(right, ignorenulls=True).over(here_on),
                )
            brackets |= {f"_{side}{k}_{c}": col for k, col in zip("ler", found)}
    first_mark, last_mark = hour_number(as_timestamp(start)), hour_number(as_timestamp(end))
    hour = F.col("_hour")
    placed = knots.withColumns(
        brackets
        | {
            "_from": F.coalesce(F.lag("_hour").over(asc) + 1, first_mark),
            "_tail": F.lead("_hour").over(asc).isNull(),
        }
    )
    lo = F.greatest(F.col("_from"), first_mark)
    hi = F.when(F.col("_tail"), last_mark).otherwise(F.least(hour, last_mark))
    marks = placed.where(lo <= hi).withColumn("_mark", F.explode(F.sequence(lo, hi)))
    at, own = F.col("_mark") * micros, F.col("_mark") <= hour
    out = {}
    for c in cols:
        # marks up to the own hour lie between the previous readings and this hour's first;
        # marks of the tail come after this hour's last reading
        inside = _between(at, F.col(f"_tl_{c}"), F.col(f"_vl_{c}"), F.col(f"_tr_{c}"), F.col(f"_vr_{c}"))
        out[c] = F.when(own, inside).otherwise(F.col(f"_ve_{c}"))
    grid = marks.select(*keys, hour_start(F.col("_mark")).alias(ts), *[v.alias(c) for c, v in out.items()])
    if static:
        constants = df.groupBy(*keys).agg(*[F.min(F.when(F.col(s).isNotNull(), F.struct(ts, s)))[s].alias(s) for s in static])
        grid = grid.join(constants, keys).select(*[c for c in df.columns if c in grid.columns or c in static])
    return grid


SEGMENT_ROWS = 1_000_000  # rows of one key that one task sorts
MOST_SEGMENTS = 1_024
SKETCH_ACCURACY = 20_000
_BROADCAST_KEYS = 10_000  # keys with their borders, at most 8 KB each


def _nearest_outside(edges: DataFrame, within: Sequence[str], order: str) -> DataFrame:
    """Add the last reading before and the first after each row's own part of time."""
    ahead = W.partitionBy(*within).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    back = W.partitionBy(*within).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, -1)
    return edges.withColumns(
        {f"_p{c}": F.last(c, ignorenulls=True).over(ahead) for c in ("_lt", "_lv")}
        | {f"_n{c}": F.last(c, ignorenulls=True).over(back) for c in ("_ft", "_fv")}
    )


def _borders(rows: DataFrame, keys: Sequence[str], most: int) -> tuple[DataFrame, int]:
    """Time borders of the keys with more than ``most`` rows, and how many such keys there are.

    Counting shrinks on the map side. Only keys that need borders get a sketch of their
    stamps (mergeable, of bounded size), so ordinary keys cost a counter each.
    """
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    large = cut_lineage(large.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n"), "large-keys")
    n = large.count()
    if not n:
        return large, 0
    side = F.broadcast(large) if n <= _BROADCAST_KEYS else large
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    names = [f"_k{i}" for i in range(len(keys))]
    shares = [i / MOST_SEGMENTS for i in range(1, MOST_SEGMENTS)]
    cuts = rows.join(side, same).groupBy(*names).agg(
        F.percentile_approx("_us", shares, SKETCH_ACCURACY).alias("_q"), F.first("_n").alias("_n")
    )
    # as many of the quantiles as the key has segments
    parts = F.least(F.ceil(F.col("_n") / most), F.lit(MOST_SEGMENTS))
    picked = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.element_at("_q", F.floor(i * MOST_SEGMENTS / parts).cast("int")))
    return cut_lineage(cuts.select(*names, F.array_sort(F.array_distinct(picked)).alias("_cuts")), "borders"), n


def _cut_number(cuts: Column, at: Column) -> Column:
    """How many of up to ``MOST_SEGMENTS`` - 1 ascending cuts are at or below ``at``, found by
    halving: ten looks at most, however many cuts a key has. No cuts count as none."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range((MOST_SEGMENTS - 1).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(cuts, n + step - 1) <= at, n + step).otherwise(n))


def bracket(
    readings: DataFrame, targets: DataFrame, keys: Sequence[str], ts: str, value: str, segment: int = SEGMENT_ROWS
) -> DataFrame:
    """Last reading at or before, and first reading at or after, each target stamp; of
    readings at one stamp the smallest counts.

    Readings and targets of a key share one sort. A key with more than ``segment`` rows is
    cut at quantiles of its own stamps into parts of about equal numbers of rows, so bursts
    are split like quiet times; what lies outside a part is carried in from a table with one
    row per part. All rows of one instant stay together. Any ``segment`` gives the same rows.
    """
    keys = list(keys)
    known = readings.where(F.col(value).isNotNull()).select(
        *keys, F.col(ts).alias("_t"), F.col(value).cast("double").alias("_v"), F.lit(True).alias("_knot")
    )
    asked = targets.select(
        *keys, F.col(ts).alias("_t"), F.lit(None).cast("double").alias("_v"), F.lit(False).alias("_knot")
    )
    rows = known.unionByName(asked).withColumn("_us", F.unix_micros(F.col("_t").cast("timestamp")))
    borders, n_large = _borders(rows, keys, segment)
    knot_t, knot_v = F.when(F.col("_knot"), F.col("_t")), F.col("_v")
    within = [*keys]
    if n_large:
        side = F.broadcast(borders) if n_large <= _BROADCAST_KEYS else borders
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
        part = _cut_number(F.col("_cuts"), F.col("_us"))
        rows = rows.join(side, same, "left").withColumn("_seg", part).drop("_cuts", *[f"_k{i}" for i in range(len(keys))])
        within.append("_seg")
    inner = W.partitionBy(*within)
    # readings come first among equal stamps in both directions: "at or before", "at or after";
    # the smallest of them is the last one seen
    up = inner.orderBy("_t", F.desc("_knot"), F.desc("_v")).rowsBetween(W.unboundedPreceding, W.currentRow)
    down = inner.orderBy(F.desc("_t"), F.desc("_knot"), F.desc("_v")).rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = rows.withColumns(
        {
            "_bt": F.last(knot_t, ignorenulls=True).over(up),
            "_bv": F.last(knot_v, ignorenulls=True).over(up),
            "_at": F.last(knot_t, ignorenulls=True).over(down),
            "_av": F.last(knot_v, ignorenulls=True).over(down),
        }
    ).where(~F.col("_knot"))
    found = {"t_before": F.col("_bt"), "v_before": F.col("_bv"), "t_after": F.col("_at"), "v_after": F.col("_av")}
    if n_large:
        ends = rows.groupBy(*within).agg(
            F.min(F.when(F.col("_knot"), F.struct(F.col("_t").alias("t"), F.col("_v").alias("v")))).alias("_f"),
            F.max(F.when(F.col("_knot"), F.struct(F.col("_t").alias("t"), (-F.col("_v")).alias("v")))).alias("_l"),
        )
        edges = ends.withColumns({"_ft": F.col("_f.t"), "_fv": F.col("_f.v"), "_lt": F.col("_l.t"), "_lv": -F.col("_l.v")}).drop("_f", "_l")
        outside = ["_p_lt", "_p_lv", "_n_ft", "_n_fv"]
        carry = _nearest_outside(edges, keys, "_seg").select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(within)], *outside)
        seen = seen.join(carry, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_c{i}")) for i, c in enumerate(within)]))
        found = {n: F.coalesce(c, o) for (n, c), o in zip(found.items(), outside)}
    return seen.select(*keys, F.col("_t").alias(ts), *[c.alias(n) for n, c in found.items()])


def fill_missing(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """Replace missing values by interpolation between the key's nearest known rows.

    For hourly tables: no rows are added, both ends hold the nearest value.
    """
    keys = list(keys)
    upto = W.partitionBy(*keys).orderBy(ts).rowsBetween(W.unboundedPreceding, W.currentRow)
    from_end = W.partitionBy(*keys).orderBy(F.desc(ts)).rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = {}
    for c in cols:
        known = F.col(c).isNotNull() & ~F.isnan(c)
        stamp, value = F.when(known, F.unix_micros(F.col(ts))), F.when(known, F.col(c))
        left, right = (
            [F.last(x, ignorenulls=True).over(w) for x in (stamp, value)] for w in (upto, from_end)
        )
        filled[c] = F.when(known, F.col(c)).otherwise(_between(F.unix_micros(F.col(ts)), *left, *right))
    return df.withColumns(filled)


def interpolate_at(
    readings: DataFrame, targets: DataFrame, keys: Sequence[str], ts: str, value: str, segment: int = SEGMENT_ROWS
) -> DataFrame:
    """Linear interpolation at arbitrary target stamps, held constant beyond both ends."""
    b = bracket(readings, targets, keys, ts, value, segment)
    t, t0, t1 = (F.unix_micros(F.col(c)) for c in (ts, "t_before", "t_after"))
    v = _between(t, t0, F.col("v_before"), t1, F.col("v_after"))
    return b.select(*keys, ts, v.alias(value)).where(F.col(value).isNotNull())


# --- differences, blocks, runs ------------------------------------------------------


def first_difference(df: DataFrame, keys: Sequence[str], ts: str, col: str, out: str) -> DataFrame:
    """Change since the previous row; only the first row of a key gets 0, later nulls stay."""
    w = W.partitionBy(*keys).orderBy(ts)
    diff = F.when(F.row_number().over(w) == 1, F.lit(0.0)).otherwise(F.col(col) - F.lag(col).over(w))
    return df.withColumn(out, diff)


def lead_difference(df: DataFrame, keys: Sequence[str], init: str, lead: str, col: str, out: str) -> DataFrame:
    """Amount within the last lead step: difference of two accumulations of one forecast run."""
    w = W.partitionBy(*keys, init).orderBy(lead)
    return df.withColumn(out, F.col(col) - F.lag(col).over(w))


def block_number(df: DataFrame, keys: Sequence[str], ts: str, n: int = 72, out: str = "st_period") -> DataFrame:
    """Number blocks of ``n`` consecutive *rows* (not hours) per key, from 0."""
    w = W.partitionBy(*keys).orderBy(ts)
    return df.withColumn(out, F.floor((F.row_number().over(w) - 1) / n))


def flag_linear_runs(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    col: str,
    n: int = 72,
    threshold: int = 3,
    order: int = 2,
    tol: float = 0.0,
    block: str = "st_period",
    flag: str = "flagged",
) -> DataFrame:
    """Flag blocks with more than ``threshold`` zero differences of the given order in a row.

    ``order=2`` finds straight lines, ``order=1`` constants. Differences stay inside a
    block. A run longer than ``threshold`` exists exactly if some ``threshold + 1``
    neighbouring rows are all zero, so one short frame replaces counting islands. Every
    window here is served by the exchange on ``keys``.
    """
    df = block_number(df, keys, ts, n, block)
    inner = W.partitionBy(*keys, block).orderBy(ts)
    x1, x2 = F.lag(col, 1).over(inner), F.lag(col, 2).over(inner)
    diff = (F.col(col) - x1) if order == 1 else (F.col(col) - x1) - (x1 - x2)
    df = df.withColumn("_zero", F.coalesce((F.abs(diff) <= tol).cast("int"), F.lit(0)))
    recent = F.sum("_zero").over(inner.rowsBetween(-threshold, W.currentRow))
    df = df.withColumn("_recent", recent)
    longest = F.max("_recent").over(W.partitionBy(*keys, block))
    return df.withColumn(flag, longest == threshold + 1).drop("_zero", "_recent")


def drop_linear_runs(df: DataFrame, keys: Sequence[str], ts: str, col: str, **options) -> DataFrame:
    """Remove every row of a flagged block; the block number stays as a column."""
    flagged = flag_linear_runs(df, keys, ts, col, **options)
    name = options.get("flag", "flagged")
    return flagged.where(~F.col(name)).drop(name)


# --- windows and periods ------------------------------------------------------------


def _window_starts(df: DataFrame, keys: Sequence[str], ts: str, n: int) -> DataFrame:
    """Mark rows that begin ``n`` rows one (whole) hour apart."""
    w = W.partitionBy(*keys).orderBy(ts)
    gap = whole_hours_between(F.col(ts), F.lag(ts).over(w))
    df = df.withColumn("_break", F.when(gap == 1, 0).otherwise(1))
    ahead = w.rowsBetween(1, n - 1)
    if n == 1:
        return df.withColumn("_start", F.lit(True)).drop("_break")
    whole = F.count(F.lit(1)).over(ahead) == n - 1
    return df.withColumn("_start", whole & (F.sum("_break").over(ahead) == 0)).drop("_break")


def is_consecutive(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Per key: are all neighbouring stamps one (whole) hour apart?"""
    w = W.partitionBy(*keys).orderBy(ts)
    prev = F.lag(ts).over(w)
    ok = prev.isNull() | (whole_hours_between(F.col(ts), prev) == 1)
    return df.select(*keys, ok.alias("_ok")).groupBy(*keys).agg(F.bool_and("_ok").alias("consecutive"))


def sequence_windows(
    df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], n: int, out: str = "seq"
) -> DataFrame:
    """All stretches of ``n`` consecutive hours, stride 1, as an array of structs.

    A row is repeated up to ``n`` times in the output: keep this for the training or
    scoring sink and scale rows beforehand (:func:`window_coverage`).
    """
    marked = _window_starts(df, keys, ts, n)
    ahead = W.partitionBy(*keys).orderBy(ts).rowsBetween(0, n - 1)
    item = F.struct(F.col(ts), *[F.col(c) for c in cols])
    return (
        marked.withColumn(out, F.collect_list(item).over(ahead)).where(F.col("_start")).select(*keys, ts, out)
    )


def last_step(seq: str, field: str) -> Column:
    """A field of the last step of a sequence."""
    return F.element_at(F.col(seq), -1)[field]


def window_coverage(df: DataFrame, keys: Sequence[str], ts: str, n: int, out: str = "n_windows") -> DataFrame:
    """In how many sequence windows each row takes part, without building them."""
    marked = _window_starts(df, keys, ts, n)
    behind = W.partitionBy(*keys).orderBy(ts).rowsBetween(-(n - 1), W.currentRow)
    return marked.withColumn(out, F.sum(F.col("_start").cast("long")).over(behind)).drop("_start")


def forecast_periods(df: DataFrame, ts: str, start, hours: int = 48, out: str = "period") -> DataFrame:
    """Number the back-to-back periods from ``start``; earlier rows are dropped. No shuffle."""
    since = micros_between(F.col(ts), as_timestamp(start)) / (hours * HOUR_SECONDS * 1_000_000)
    return df.withColumn(out, F.floor(since)).where(F.col(out) >= 0)


def spinup_periods(
    df: DataFrame, ts: str, start, periods: int, hours: int = 48, spinup: int = 24, out: str = "period"
) -> DataFrame:
    """Periods that each reach ``spinup`` hours back, so neighbours overlap.

    Hour ``h`` from the first spin-up belongs to period ``k`` if
    ``k*hours <= h < k*hours + spinup + hours``: arithmetic per row, no join. Adds
    ``step``, the hour within the period.
    """
    width = hours + spinup
    h = hour_number(F.col(ts)) - hour_number(as_timestamp(start)) + spinup
    low = F.greatest(F.floor((h - width) / hours) + 1, F.lit(0))
    high = F.least(F.floor(h / hours), F.lit(periods - 1))
    return (
        df.withColumn("_h", h)
        .where(low <= high)
        .withColumn(out, F.explode(F.sequence(low, high)))
        .withColumn("step", (F.col("_h") - F.col(out) * hours).cast("int"))
        .drop("_h")
    )


def rolling_origins(
    df: DataFrame, ts: str, start, every_hours: int, count: int, train_hours: int, test_hours: int
) -> DataFrame:
    """Evaluation with a moving origin: origin ``k`` is ``start + k*every_hours``; the hours
    before it train, the hours from it on test. The origins a row belongs to are found by
    division, so no range join is needed."""
    h = hour_number(F.col(ts)) - hour_number(as_timestamp(start))
    low = F.greatest(F.floor((h - test_hours) / every_hours) + 1, F.lit(0))
    high = F.least(F.floor((h + train_hours) / every_hours), F.lit(count - 1))
    return (
        df.withColumn("_h", h)
        .where(low <= high)
        .withColumn("origin", F.explode(F.sequence(low, high)))
        .withColumn("split", F.when(F.col("_h") < F.col("origin") * every_hours, "train").otherwise("test"))
        .drop("_h")
    )


def lead_hour(ts: Column, period_start: Column) -> Column:
    """Whole hours since the period began."""
    return whole_hours_between(ts, period_start)


def ordered_sequence(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], out: str = "seq") -> DataFrame:
    """One row per key with its rows in time order as an array (a period, or a validation span)."""
    item = F.struct(F.col(ts), *[F.col(c) for c in cols])
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias(out))
