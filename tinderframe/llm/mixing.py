"""Mixing sources to target weights along a curriculum that changes over time.

Each source has a weight schedule: a list of (time, weight) knots on [0, 1], linear between
them. At time t a source asks for its share of the token stream, weight / sum of weights, and
the integral of its share is its cumulative demand. A source's documents are lined up in a
seeded order; the first tokens of a pass over them meet the demand first. A document whose
tokens start at offset c of its source stands where the cumulative demand reaches c: the
inverted demand is its training position. ``mix_sources`` says how much of every document is
taken, ``training_order`` gives the positions and sorts by them.

Only DataFrame functions are used. A source may hold any share of the rows: running totals
are taken within 4,096 slices of a hash of the document, and slice totals are added up
before, so no window holds a whole source. What is handled per source (weights, targets,
demand tables) is as small as the list of sources.

Defined cases: a null text or one of blanks has size 0 and is never taken, but is returned;
a null source is a source of its own, last in order; repeated rows are documents of their
own; of rows equal in id and text it is open which comes first, the set of results is the
same. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tinderframe.llm.common import SPACED
from tinderframe.session import cut_lineage

Knots = Sequence[tuple[float, float]]
SLICE_DIGITS = 3  # hex digits of the seeded order that make a slice: 4,096 of them
STEPS = 64  # pieces of the demand tables


def text_size(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float], total: float, most: float) -> DataFrame:
    """One row per source: source, source_size, weight, target.

    Sources in code-point order (null last) take the weights in turn. Targets share
    ``total`` times all tokens by weight; a target stops at ``most`` times its source's
    size and what it leaves is shared by weight among the others until none is above.
    That fixed point is found in one pass: in the order in which sources fill up, level k
    says what a unit of weight gets if the first k are full; the first source that does not
    fill at its level ends the full ones.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = sums.withColumn("weight", F.get(w, (F.row_number().over(everything) - 1) % len(weights)))
    # A tie in the filling ratio fills both or neither, so its order does not matter.
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.col("source_size") * float(most)
    level = ((F.sum("source_size").over(whole) * float(total) - float(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)).alias("level")
    levels = ranked.select("*", level)
    levels = levels.withColumn("full", F.col("level") * F.col("weight") >= cap)
    levels = levels.withColumn("open_level", F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), "level"))).over(Window.partitionBy())["level"])
    target = F.when(F.col("full"), cap).otherwise(F.col("open_level") * F.col("weight"))
    return levels.select("source", "source_size", "weight", target.alias("target"))


def offsets(sized: DataFrame) -> DataFrame:
    """Adds __offset: tokens of the same source before the row in the seeded order, which
    is the md5 of the id, then of the text."""
    sized = sized.withColumn("__slice", F.substring("__order", 1, SLICE_DIGITS))
    slices = sized.groupBy("source", "__slice").agg(F.sum("size").alias("__sum"))
    w = Window.partitionBy("source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select(F.col("source").alias("__s"), F.col("__slice").alias("__l"), F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("source", "__slice").orderBy("__order", "__order2").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("__within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    on = placed["source"].eqNullSafe(starts["__s"]) & (placed["__slice"] == starts["__l"])
    return placed.join(starts, on).withColumn("__offset", F.col("__start") + F.col("__within")).drop("__s", "__l", "__start", "__within", "__slice")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), total: float = 1.5, most: float = 2.0, doc_id: str = "doc_id") -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, offset and taken.

    Passes over a source follow one another until its target (rounded) is met; the document
    across the target gives its first tokens only, so a source meets its target exactly.
    """
    sized = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col("source"),
        text_size(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")).alias("__order"),
        F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("__order2"),
    )
    sized = cut_lineage(sized, "mix")  # texts are measured once
    targets = source_targets(sized, weights, total, most)
    placed = offsets(sized)
    targets = targets.withColumnRenamed("source", "__s")
    out = placed.join(targets, placed["source"].eqNullSafe(targets["__s"]))
    wanted = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), wanted - passes * F.col("source_size") - F.col("__offset")))
    return out.select("doc_id", "source", "size", "source_size", "weight", "target", F.col("__offset").alias("offset"), (passes * F.col("size") + rest).alias("taken"))


def demand_table(targets: DataFrame, schedules: Sequence[Knots], steps: int = STEPS) -> DataFrame:
    """The integrated schedules: per source and step of time the demand at the step's start
    and its linear rate, scaled so that a source's demand at time 1 is its target.

    ``schedules`` belong to the sources in turn, as the weights do. Each is a list of
    (time, factor) knots; the factor multiplies the source's overall weight.
    """
    at = F.expr(f"transform(sequence(0, {steps} - 1), i -> cast((i + 0.5) / {steps} as double))")
    rank = Window.orderBy(F.col("source").isNull(), F.col("source"))
    rows = targets.withColumn("__k", (F.row_number().over(rank) - 1) % len(schedules))
    rows = rows.select("source", "target", "__k", F.posexplode(at).alias("step", "t"))
    rate = F.lit(0.0)
    for k, knots in enumerate(schedules):
        value = F.lit(float(knots[-1][1]))
        for (a, u), (b, v) in reversed(list(zip(knots, knots[1:]))):
            value = F.when(F.col("t") <= b, F.lit(float(u)) + (F.col("t") - a) * ((v - u) / (b - a))).otherwise(value)
        rate = F.when(F.col("__k") == k, value).otherwise(rate)
    rows = rows.withColumn("rate", rate)
    w = Window.partitionBy("source").orderBy("step")
    before = F.coalesce(F.sum("rate").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    scale = F.col("target") / F.sum("rate").over(Window.partitionBy("source"))
    return rows.select("source", "step", (before * scale).alias("demand"), (F.col("rate") * scale).alias("rate"))


def positions(mixed: DataFrame, schedules: Sequence[Knots], steps: int = STEPS) -> DataFrame:
    """Adds positions: the training position in [0, 1] of each pass over the document,
    empty if none is taken.

    A pass that starts at token c of its source's demand stands at the time at which the
    demand reaches c. Its step is looked up in the demand table, an array per source.
    """
    sources = mixed.groupBy("source").agg(F.first("target").alias("target"))
    table = demand_table(sources, schedules, steps).groupBy(F.col("source").alias("__s"))
    table = table.agg(F.sort_array(F.collect_list(F.struct("step", "demand", "rate"))).alias("__d"))
    rows = mixed.join(table, mixed["source"].eqNullSafe(table["__s"]))

    def position(number: Column) -> Column:
        c = number * F.col("source_size") + F.col("offset")
        step = F.coalesce(F.element_at(F.filter("__d", lambda d: d["demand"] <= c), -1), F.get("__d", F.lit(0)))
        into = F.coalesce(F.try_divide(c - step["demand"], step["rate"]), F.lit(0.0))
        return (step["step"] + F.least(into, F.lit(1.0))) / F.lit(float(steps))

    passes = F.ceil(F.col("taken") / F.col("size")).cast("int")
    numbers = F.when(F.col("taken") > 0, F.sequence(F.lit(0), passes - 1)).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("positions", F.transform(numbers, position)).drop("__s", "__d")


def training_order(mixed: DataFrame, schedules: Sequence[Knots], steps: int = STEPS) -> DataFrame:
    """One row per pass over a taken document, range-sorted by position: doc_id, source,
    position, pass and the number of tokens to take from it."""
    rows = positions(mixed, schedules, steps)
    rows = rows.select(*mixed.columns, F.posexplode("positions").alias("pass", "position"))
    tokens = F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size"))
    return rows.withColumn("tokens", tokens).sort("position", "source", "doc_id", "pass")
