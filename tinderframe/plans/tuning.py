"""Hyper-parameter grids as tables, and running them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tinderframe.operators.evaluate import best_config, mean_squared_error, named_metrics
from tinderframe.plans.learners import predict
from tinderframe.session import cut_lineage

# The published search space.
RECURRENT_LAYERS = (["lstm"], ["lstm", "lstm"], ["lstm", "lstm", "lstm"])
DENSE_LAYERS = ([], ["dense"], ["dense", "dense"], ["dense", "dense", "dense"])
LAYER_UNITS = (8, 16, 32, 64, 128)
OPTIMIZATION = {
    "learning_rate": [0.05, 0.01, 0.005, 0.001, 0.0005, 0.0001],
    "batch_size": [16, 32, 64, 128, 256],
    "dropout": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3],
}
ACTIVATIONS = {"lstm": "tanh", "dense": "relu", "conv1d": "relu"}


def combine(base: DataFrame, choices: Mapping[str, Column]) -> DataFrame:
    """Every combination of the values in the given array columns, one row each.

    The arrays are unfolded one after the other inside their own row.
    """
    for name, values in choices.items():
        base = base.withColumn(name, F.explode(values))
    return base


def param_grid(spark: SparkSession, choices: Mapping[str, Sequence]) -> DataFrame:
    """Unrestricted grid with an id, in order of the choices."""
    one = spark.range(1).select(F.lit(0).alias("_"))
    items = {k: F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(vs)]) for k, vs in choices.items()}
    rows = combine(one, items)
    number = F.lit(0).cast("long")
    for k, vs in choices.items():
        number = number * len(vs) + F.col(k)["i"]
    return rows.select(number.alias("config_id"), *[F.col(k)["v"].alias(k) for k in choices])


def funnel_units(n_layers: Column, units: Column, most: int) -> Column:
    """All unit lists of the wanted length that never grow from layer to layer.

    Lists are extended one layer at a time and only by units not above the last one, so
    nothing is generated to be thrown away.
    """
    seeds = F.transform(units, lambda u: F.array(u))
    result = F.when(n_layers == 1, seeds)
    current = seeds
    for k in range(2, most + 1):
        current = F.flatten(
            F.transform(
                current,
                lambda c: F.transform(
                    F.filter(units, lambda u: u <= F.element_at(c, -1)), lambda u: F.concat(c, F.array(u))
                ),
            )
        )
        result = result.when(n_layers == k, current)
    return result


def model_grid(
    spark: SparkSession,
    recurrent: Sequence[Sequence[str]] = RECURRENT_LAYERS,
    dense: Sequence[Sequence[str]] = DENSE_LAYERS,
    units: Sequence[int] = LAYER_UNITS,
) -> DataFrame:
    """Layer stacks with non-increasing units; dropout follows a final dense layer."""

    def lists(stacks):
        return F.array(*[F.array(*[F.lit(s) for s in stack]).cast("array<string>") for stack in stacks])

    most = max(map(len, recurrent)) + max(map(len, dense))
    stacks = combine(spark.range(1), {"_rec": lists(recurrent), "_den": lists(dense)}).select(
        F.concat("_rec", "_den").alias("_layers")
    )
    widths = funnel_units(F.size("_layers"), F.array(*[F.lit(u) for u in units]), most)
    rows = stacks.withColumn("_units", F.explode(widths))
    ends_dense = F.element_at("_layers", -1) == "dense"
    layers = F.when(ends_dense, F.concat("_layers", F.array(F.lit("dropout")))).otherwise(F.col("_layers"))
    sizes = F.when(ends_dense, F.concat("_units", F.array(F.lit(None).cast("int")))).otherwise(F.col("_units"))
    table = F.create_map(*[F.lit(x) for kv in ACTIVATIONS.items() for x in kv])
    return rows.select(layers.alias("hidden_layers"), sizes.alias("hidden_units")).withColumn(
        "hidden_activation", F.transform("hidden_layers", lambda n: F.try_element_at(table, n))
    )


def run_grid(
    configs: Sequence[dict], train: DataFrame, test: DataFrame, fit_one: Callable[[dict, DataFrame], object], config: str = "config_id"
) -> tuple[DataFrame, DataFrame]:
    """Fit and test each configuration as distributed jobs; returns (metrics, best).

    The list of configurations is short by nature (each one is a whole training run); data
    stays in Spark throughout. Train and test rows are stored once; all models score the
    test rows in one pass, a column per configuration, and both results read what it stored.
    """
    train, test = cut_lineage(train, "train"), cut_lineage(test, "test")
    scored = test.select("fm", *[c for c in test.columns if c not in ("fm", "preds")])
    names = [f"_preds{number}" for number in range(len(configs))]
    for name, settings in zip(names, configs):
        scored = predict(fit_one(settings, train), scored).withColumnRenamed("preds", name)
    pairs = F.array(*[F.struct(F.lit(i).alias(config), F.col(n).alias("preds")) for i, n in enumerate(names)])
    outputs = cut_lineage(scored.select("fm", F.inline(pairs)).select(config, "fm", "preds"), "scores")
    return named_metrics(outputs, [config]), best_config(mean_squared_error(outputs, [config]), config)
