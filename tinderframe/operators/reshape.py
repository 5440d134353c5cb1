"""De-duplication, unions, pivots, agreement checks, fingerprints, exact ranks and medians."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tinderframe.session import cut_lineage

_BROADCAST_GROUPS = 100_000  # rows of a few numbers each


def first_source_wins(df: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """One row per key, taken from the earliest source.

    Copies of one key are reduced on the map side, so a key copied a billion times costs
    one task no more than its partial results. Rows of the same key *and* source are told
    apart by their values, which keeps the outcome independent of the row order.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys and c != source]
    best = F.min(F.struct(source, *rest)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, F.col(f"_best.{source}"), *[F.col(f"_best.{c}") for c in rest])


def union_sources(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of tables in order of precedence, first one wins on equal keys."""
    tagged = None
    for i, s in enumerate(sources):
        s = s.withColumn("_source", F.lit(i))
        tagged = s if tagged is None else tagged.unionByName(s, allowMissingColumns=True)
    return first_source_wins(tagged, keys, "_source").drop("_source")


def distinct_times(tables: Sequence[DataFrame], ts: str = "date_time") -> DataFrame:
    """Every stamp that occurs in any of the tables, once."""
    out = None
    for t in tables:
        out = t.select(ts) if out is None else out.union(t.select(ts))
    return out.distinct()


def tag_outputs(outputs: dict[str, DataFrame], rep: int, model: str = "Model") -> DataFrame:
    """Stack model outputs and label them with model name and replication."""
    stacked = None
    for name, df in outputs.items():
        df = df.withColumn(model, F.lit(name))
        stacked = df if stacked is None else stacked.unionByName(df)
    return stacked.withColumn("rep", F.lit(rep))


def pivot_variables(
    df: DataFrame, index: Sequence[str], variable: str, value: str, variables: Sequence[str]
) -> DataFrame:
    """Long to wide. Two values for one cell are an error, not a silent pick."""
    one = F.when(F.count(value) <= 1, F.max(value)).otherwise(
        F.raise_error(F.lit("more than one value for a pivot cell")).cast("double")
    )
    return df.where(F.col(variable).isin(*variables)).groupBy(*index).pivot(variable, list(variables)).agg(one)


def melt_variables(df: DataFrame, index: Sequence[str], cols: Sequence[str], variable: str, value: str) -> DataFrame:
    return df.unpivot(list(index), list(cols), variable, value)


def side_counts(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many distinct keys are in both tables, and in only one of them.

    One union and one aggregate; equal to a full outer join, but copies of a key meet on
    the map side instead of multiplying.
    """
    keys = list(keys)
    both = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    per_key = both.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return per_key.agg(
        F.count_if((F.col("_a") == 1) & (F.col("_b") == 1)).alias("in_both"),
        F.count_if(F.col("_b") == 0).alias("only_first"),
        F.count_if(F.col("_a") == 0).alias("only_second"),
    )


def metadata_conflicts(a: DataFrame, b: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Columns of the common keys on which two metadata tables disagree, one row each."""
    both = a.select(key, *cols).join(b.select(key, *[F.col(c).alias(f"_b_{c}") for c in cols]), key)
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("field"),
                F.col(c).cast("string").alias("first"),
                F.col(f"_b_{c}").cast("string").alias("second"),
            )
            for c in cols
        ]
    )
    return both.select(key, F.inline(F.filter(pairs, lambda p: ~p["first"].eqNullSafe(p["second"]))))


def merge_maps(first: Column, second: Column) -> Column:
    """Union of two maps; the first one's entry wins."""
    extra = F.map_filter(second, lambda k, v: ~F.map_contains_key(first, k))
    return F.map_concat(first, extra)


def map_conflicts(first: Column, second: Column) -> Column:
    """Keys that both maps have with different values."""
    return F.map_keys(
        F.map_filter(first, lambda k, v: F.map_contains_key(second, k) & ~v.eqNullSafe(F.try_element_at(second, k)))
    )


def fingerprint(df: DataFrame, digits: int = 6) -> DataFrame:
    """Row count and an order-free hash; the same for any partitioning of the same rows, and
    for any engine: a row is hashed as text by MD5, doubles as whole multiples of
    10**-digits, stamps as microseconds."""

    def text(c: str, kind: str) -> Column:
        if kind == "double":
            plain = F.floor(F.col(c) * 10**digits + 0.5)
        else:
            plain = F.unix_micros(c) if kind == "timestamp" else F.col(c)
        return F.coalesce(plain.cast("string"), F.lit("null"))

    whole = F.concat_ws("|", *[text(c, t) for c, t in df.dtypes])
    h = F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")
    # a plain xor would cancel duplicates, so the sum is kept as well
    return df.select(h.alias("_h")).agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor("_h").alias("hash_xor"),
        F.sum(F.col("_h") % (2**31 - 1)).alias("hash_sum"),
    )


def stations_by_size(df: DataFrame, key: str = "stid") -> DataFrame:
    """Row count per station, largest first."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), key)


def top_by(df: DataFrame, n: int, by: Sequence[Column]) -> DataFrame:
    """The report of the ``n`` largest rows: a heap per partition, no full sort."""
    return df.orderBy(*by).limit(n)


def hash_rank(
    df: DataFrame, seed: Column, keys: Sequence[str], within: Sequence[str] = (), out: str = "rank"
) -> DataFrame:
    """Position (from 1) of each row in a seeded pseudo-random order, per ``within`` group.

    The order is that of ``md5(seed_key_key...)``, so it depends on neither partitioning nor
    engine. Ranks are counted in 65,536 slices of the hash: rows are numbered inside their
    slice and shifted by the sizes of the slices before it. No task sees more than a slice
    and no sort is global. ``keys`` must identify a row (copies would share a slice; drop
    them first with :func:`first_source_wins`).
    """
    within = list(within)
    hashed = df.withColumn("_h", F.md5(F.concat_ws("_", seed.cast("string"), *[F.col(k).cast("string") for k in keys])))
    hashed = hashed.withColumn("_slice", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    sizes = hashed.groupBy(*within, "_slice").count()
    earlier = W.partitionBy(*(within or [F.lit(0)])).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(*within, "_slice", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_shift"))
    place = F.row_number().over(W.partitionBy(*within, "_slice").orderBy("_h", *keys))
    return (
        hashed.withColumn("_place", place)
        .join(shifts, [*within, "_slice"])
        .withColumn(out, F.col("_place") + F.col("_shift"))
        .drop("_h", "_slice", "_place", "_shift")
    )


def exact_median(
    df: DataFrame, keys: Sequence[str], col: str, out: str = "median", also: dict[str, Column] | None = None
) -> DataFrame:
    """Exact median per key, also where one key holds most of the rows.

    A mergeable sketch brackets the middle ranks: the bracket is five times as wide as the
    sketch's error, so it cannot miss them. Values below it are only counted; the 0.1 % of
    the rows inside it are counted per distinct value and numbered in 4,096 slices of the
    bracket, like the ranks of :func:`hash_rank`; a rank the bracket missed is an error. Two
    passes over the data, both combined on the map side, the brackets broadcast where their
    stored number is at most ``_BROADCAST_GROUPS``; the plain ``median`` would gather a key's distinct values in one task.
    ``also`` names further aggregates to take along in the first pass.
    """
    keys, also = list(keys), also or {}
    width, accuracy, slices = 0.0005, 10_000, 4096
    v = F.col("_v")
    rows = df.withColumn("_v", F.col(col).cast("double")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    cut = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        *[a.alias(name) for name, a in also.items()],
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", F.array(F.lit(0.5 - width), F.lit(0.5 + width)), accuracy).alias("_cut"),
    )
    cut = cut_lineage(cut, "median-brackets")
    if cut.count() <= _BROADCAST_GROUPS:
        cut = F.broadcast(cut)
    low, high = F.get("_cut", 0), F.get("_cut", 1)
    part = F.floor((v - low) / (high - low) * slices).cast("int")
    inside = (
        rows.select(*keys, "_v")
        .join(cut, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
        .where(v <= high)
        .withColumn("_slice", F.when(v < low, -1).when(high > low, part).otherwise(0))
        .withColumn("_v", F.when(v >= low, v))
        .groupBy(*keys, *also, "_n", "_slice", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    sizes = inside.groupBy(*keys, "_slice").agg(F.sum("_c").alias("_size"))
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_slice").alias("_s"),
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_shift"),
    )
    upto = F.sum("_c").over(
        W.partitionBy(*keys, "_slice").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    ranked = inside.withColumn("_upto", upto).join(shifts, [*same, F.col("_slice") == F.col("_s")])
    last = F.col("_shift") + F.col("_upto")
    first = last - F.col("_c") + 1
    lower, upper = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    middle = [F.max(F.when(r.between(first, last), v)) for r in (lower, upper)]
    taken = [F.first(name).alias(name) for name in also]  # one value per key
    missed = F.raise_error(F.lit("the sketch missed a middle rank")).cast("double")
    return ranked.groupBy(*keys).agg(F.coalesce((middle[0] + middle[1]) / 2, missed).alias(out), *taken)
