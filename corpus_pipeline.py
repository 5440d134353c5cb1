"""From raw documents to a training mix: five stages, each stored before the next reads it.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of ``documents``.

Defined cases: null texts count as empty; rows without an id or with the same one are told
apart by their texts; equal rows are near-duplicates of each other; columns that ``documents``
does not have may bear any name and pass through; empty tables give an empty mix.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tinderframe.llm import decontaminate, mixing, similar, spans, toxicity
from tinderframe.llm.common import share
from tinderframe.llm.queries import CURRICULUM, SPAN_FLOOR, TOXIC_AT
from tinderframe.session import drop_stage, stage_path

#: Near-duplicates: words of a shingle, and the least share of common ones.
SHINGLE, SIMILAR = 5, 0.8
#: Columns that stages know; others wait under neutral names while a stage works.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def passing_others(stage: Stage) -> Stage:
    """The stage with extra columns renamed before and named back after it, so that none
    clashes with its own."""

    @wraps(stage)
    def renamed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in KNOWN else f"other{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).toDF(*docs.columns)

    return renamed


@passing_others
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go. Labels of a third of the ids are left for judging."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(share(F.col("doc_id"), 3) != 1)
    model = toxicity.train(docs, labels)
    return docs.filter(toxicity.score(F.col("text"), model) < TOXIC_AT).select(*docs.columns)


@passing_others
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near-duplicates one document stays: the one with the smallest id,
    then the smallest hash of the text. Documents without words are one class."""
    keep = similar.class_firsts(docs, SHINGLE, SIMILAR).select(F.col("id").alias("__i"), F.col("key").alias("__k"))
    keyed = docs.withColumn("__key", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = keyed.join(keep, keyed["doc_id"].eqNullSafe(keep["__i"]) & (keyed["__key"] == keep["__k"]), "left_semi")
    # rows that agree in id and text
    rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    first = Window.partitionBy("doc_id", "__key").orderBy(*(rest or [F.lit(0)]))
    return kept.withColumn("__n", F.row_number().over(first)).filter("__n = 1").select(*docs.columns)


@passing_others
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages stay in their first document only."""
    return spans.dedup_spans(docs, min_words=SPAN_FLOOR).select(*docs.columns)


@passing_others
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    dirty = found.filter("n_hit > 0").select(F.col("__id").alias("__i"), F.col("__h").alias("__k")).distinct()
    keyed = docs.withColumn("__key", F.xxhash64(F.coalesce("text", F.lit(""))))
    clean = keyed.join(dirty, keyed["doc_id"].eqNullSafe(dirty["__i"]) & (keyed["__key"] == dirty["__k"]), "left_anti")
    return clean.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: one row per pass over a document, sorted by position; documents
    without words have none."""
    docs = docs.select(*[c for c in docs.columns if c in KNOWN])
    order = mixing.training_order(mixing.mix_sources(docs), CURRICULUM)
    return order.select("doc_id", "source", "size", "source_size", "target", "taken", "pass", "tokens", "position")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", one_of_each),
    ("span_dedup", cut_repeats),
    ("decontaminate", drop_benchmark),
    ("mix", mix),
]

#: Scores, fingerprints and sentence runs are not for SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's table is deleted once the next is stored."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = stage_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_stage(spark, before)
        before = path
    return docs
