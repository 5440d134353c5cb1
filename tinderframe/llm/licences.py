"""Licence scan: a trained paragraph classifier whose findings templates must confirm.

Paragraphs are the lines of a text; a line of ``WRAPPED`` characters that does not end a
sentence is taken as wrapped and goes on in the next one. Their features are hashed words and
word pairs, of those that occur in a variant of a template: any other can have no weight for a
family of its own, only that of a bucket it happens to share. A multinomial logistic regression
with an L1 penalty maps them to a licence family or to "unknown". It is trained, until the fit
converges, on all variants of the family templates (words left out by a hash, so that rewordings
are seen) and on every paragraph of the corpus itself that shares no word triple with a template.
A quarter of these paragraphs is held out of the fit and sets the least probability of a family,
which about ``false_rate`` of the held-out ones reach. Paragraphs below it are unknown.

Different paragraphs count once, however often they repeat, and those with the same features are
one weighted training row. Together the unknown ones weigh as much as ``unknown_rows`` rows, or
as many as there are: with all of them at full weight the templates would weigh nothing beside a
large corpus, and the penalty would keep every family at zero. What is called is compared with the
family's templates; the share of the best template's word triples that the paragraph holds
confirms the call or not.

Only DataFrame functions and Spark ML are used; scoring is a narrow step over all paragraphs, and
every paragraph is scored.

Defined cases: null and empty texts and blank lines have no paragraphs; repeated rows and lines
are all reported; a paragraph is classed whole, however long; of equally like templates the
last in name order is named; where no paragraph can stand for "unknown" (licence lines alone, or
all others held out) there is nothing to train on and the templates decide; an empty table gives
an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from tinderframe.llm.common import LETTERS, ascii_lower
from tinderframe.session import cut_lineage

UNKNOWN = "unknown"
#: What ``LETTERS`` leaves out.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Least and most characters of a wrapped line.
WRAPPED = (40, 120)
#: The usual wording of licence notices, by family.
TEMPLATES = {
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "BSD": [
        "Use of this source code is governed by a BSD-style license.",
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    ],
    "LGPL": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Proprietary": ["All rights reserved.", "No part of this work may be reproduced without the written permission of the copyright holder."],
    "Public-Domain": ["This is free and unencumbered software released into the public domain.", "This work is dedicated to the public domain under CC0 1.0."],
}


@dataclass(frozen=True)
class Settings:
    features: int = 1 << 13
    variants: int = 24  # of each template, each leaving out about one word in eight
    unknown_rows: int = 4_000  # most that all unknown paragraphs together weigh in the fit
    reg: float = 5e-4
    iterations: int = 10_000  # a fit that has not converged by then is an error
    false_rate: float = 0.002
    common: float = 0.01  # share of the paragraphs from which on a word is no cue
    like: float = 0.6  # share of a template's word triples that confirms


@dataclass
class Scanner:
    model: LogisticRegressionModel | None
    families: list[str]
    least: float


def plain_words(text: Column) -> Column:
    """Lower-case words, numbers as one sign. Cut at the gaps: finding the words one by one takes
    seven times as long."""
    plain = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), "[0-9]+", "0")
    return F.array_remove(F.split(plain, GAPS), "")


def grams(w: Column, n: int) -> Column:
    """Runs of n words as text."""
    at = F.sequence(F.lit(1), F.size(w) - n + 1)
    runs = F.transform(at, lambda i: F.concat_ws(" ", F.slice(w, i, F.lit(n))))
    return F.when(F.size(w) >= n, runs).otherwise(F.array().cast("array<string>"))


def pairs(w: Column) -> Column:
    """``grams`` of two words, in one walk over the words."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def paragraphs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, paragraph (its number from 0), line (its text) and w (its words) of every
    paragraph with words."""
    least, most = WRAPPED
    # The line end comes first, so that nothing is looked up at other characters.
    border = rf"\n(?:(?<![^\n]{{{least}}}\n)|(?<=[^\n]{{{most + 1}}}\n)|(?<=[.!?:;]\r?\n))"
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, border)).alias("paragraph", "line"))
    return lines.filter(F.col("line").rlike(LETTERS)).select("doc_id", "paragraph", "line", plain_words(F.col("line")).alias("w"))


def template_table(spark: SparkSession) -> DataFrame:
    rows = [Row(family=f, template=f"{f}-{i}", line=t) for f, ts in sorted(TEMPLATES.items()) for i, t in enumerate(ts)]
    return spark.createDataFrame(rows).select("family", "template", plain_words(F.col("line")).alias("w"))


def likeness(w: Column, template: Column) -> Column:
    """Share of a template's word triples (of a shorter one: all its words as one run)."""
    n = F.least(F.lit(3), F.size(template))
    runs = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(x) - n + 1)), lambda i: F.concat_ws(" ", F.slice(x, i, n)))
    return F.size(F.array_intersect(runs(w), runs(template))) / F.size(F.array_distinct(runs(template)))


def variants(spark: SparkSession, s: Settings) -> DataFrame:
    """(family, w): the templates and rewordings that leave words out."""
    variant = template_table(spark).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(s.variants - 1))))
    drop = lambda x, i: (F.col("v") == 0) | (F.pmod(F.xxhash64(x, i, F.col("v")), F.lit(8)) > 0)
    return variant.select("family", F.filter("w", drop).alias("w")).filter(F.size("w") > 0)


def words_and_pairs(w: str) -> Column:
    return F.concat(w, pairs(F.col(w)))


def template_grams(spark: SparkSession, s: Settings) -> list[str]:
    """Words and pairs of the variants."""
    known = variants(spark, s).select(F.explode(words_and_pairs("w")).alias("g")).distinct()
    return sorted(r["g"] for r in known.collect())  # of the fixed templates


def named(rows: DataFrame, s: Settings) -> DataFrame:
    """``rows`` and __grams, the words and pairs of w that a variant holds, __words, which is w
    with null for all other words, and __pairs, its pairs; one with such a word is null as well,
    which saves making them."""
    known = template_grams(rows.sparkSession, s)
    single = [g for g in known if " " not in g]
    rows = rows.withColumn("__words", F.transform("w", lambda x: F.when(x.isin(single), x)))
    rows = rows.withColumn("__pairs", pairs(F.col("__words")))
    return rows.withColumn("__grams", F.filter(F.concat("__words", "__pairs"), lambda g: g.isin(known)))


def hashed(rows: DataFrame, s: Settings) -> DataFrame:
    """``rows`` with __features instead of __grams."""
    tf = HashingTF(inputCol="__grams", outputCol="__features", numFeatures=s.features, binary=True)
    return tf.transform(rows).drop("__grams")


def featured(rows: DataFrame, s: Settings) -> DataFrame:
    return hashed(named(rows, s).drop("__words", "__pairs"), s)


def training_rows(lines: DataFrame, s: Settings) -> DataFrame:
    """(family, w, __grams): variants of the templates and every unlike paragraph of the corpus."""
    spark = lines.sparkSession
    shared = {g for r in template_table(spark).select(grams(F.col("w"), 3).alias("g")).collect() for g in r["g"]}  # of the fixed templates
    n = F.greatest(F.size("w") - 2, F.lit(0))
    triples = F.zip_with(F.slice("__pairs", 1, n), F.slice("__words", 3, n), lambda a, b: F.concat(a, F.lit(" "), b))
    like = F.coalesce(F.exists(triples, lambda g: g.isin(sorted(shared))), F.lit(False))
    rows = named(lines.select("w"), s).select("w", "__grams", like.alias("like"))
    # A generator, not a filter; see ``scan``.
    unlike = F.inline(F.filter(F.array(F.struct("w", "__grams", "like")), lambda r: ~r["like"]))
    known = named(variants(spark, s), s).select("family", "w", "__grams")
    return known.union(rows.select(F.lit(UNKNOWN).alias("family"), unlike).drop("like"))


def training_sets(lines: DataFrame, s: Settings) -> DataFrame:
    """label, held, __features and n (training rows, of the unknown ones different paragraphs) of
    every set of features."""
    names = [UNKNOWN, *sorted(TEMPLATES)]
    label = F.array_position(F.array(*map(F.lit, names)), F.col("family")) - 1
    held = (F.col("family") == UNKNOWN) & (F.pmod(F.xxhash64("w", F.lit("held out")), F.lit(4)) == 0)
    found = F.array_sort(F.array_distinct("__grams"))
    rows = training_rows(lines, s).select(label.cast("double").alias("label"), held.alias("held"), found.alias("__grams"), F.xxhash64("w").alias("h"))
    counts = rows.groupBy("label", "held", "__grams").agg(F.count_distinct("h").alias("different"), F.count("*").alias("all"))
    n = F.when(F.col("label") == 0, F.col("different")).otherwise(F.col("all"))
    return hashed(counts.select("label", "held", "__grams", n.alias("n")), s)


def cue_words(templates: list[list[str]], rows: DataFrame, s: Settings) -> list[str]:
    """Words of the templates that at most ``common`` of the paragraphs of ``rows`` (column w)
    hold, or all words of a template without any. A description of a corpus: ``scan`` leaves no
    paragraph out for want of them, since common words in a rare order can make a notice."""
    named = sorted({w for t in templates for w in t})
    held = rows.select(F.explode(F.array_distinct("w")).alias("x")).filter(F.col("x").isin(named))
    counts = {r["x"]: r["count"] for r in held.groupBy("x").count().collect()}  # words of the templates
    most = s.common * rows.count()
    rare = [[w for w in t if counts.get(w, 0) <= most] or t for t in templates]
    return sorted({w for t in rare for w in t})


def train(lines: DataFrame, s: Settings = Settings()) -> Scanner:
    names = [UNKNOWN, *sorted(TEMPLATES)]
    rows = cut_lineage(training_sets(lines, s), "licence-training")
    unknown = rows.filter("label = 0 and not held").agg(F.sum("n")).first()[0]
    if not unknown:
        return Scanner(None, names, 1.0)
    weight = F.when(F.col("label") == 0, F.col("n") * min(1.0, s.unknown_rows / unknown)).otherwise(F.col("n"))
    lr = LogisticRegression(family="multinomial", featuresCol="__features", weightCol="__weight", probabilityCol="__p", rawPredictionCol="__r", predictionCol="__l", elasticNetParam=1.0, regParam=s.reg, maxIter=s.iterations, standardization=False, aggregationDepth=2)
    model = lr.fit(rows.filter("not held").withColumn("__weight", weight.cast("double")))
    if model.summary.totalIterations >= s.iterations:
        raise RuntimeError(f"the licence model has not converged in {s.iterations} iterations")
    # To four digits, so that the percentile counts a bounded number of values.
    family = F.floor(F.array_max(F.slice(vector_to_array("__p"), 2, len(names) - 1)) * 10_000) / 10_000
    least = model.transform(rows.filter("held")).agg(F.percentile(family, 1 - s.false_rate, F.col("n"))).first()[0]
    return Scanner(model, names, max(0.5, least or 0.0))


def _by_templates(lines: DataFrame, s: Settings) -> DataFrame:
    """Paragraphs that hold enough of a template, in the columns of ``scan``; the likeness
    stands for the probability."""
    rows = sorted(template_table(lines.sparkSession).collect())  # the fixed templates
    every = F.array(*[F.struct(F.lit(r["family"]).alias("family"), F.lit(r["template"]).alias("template"), F.array(*map(F.lit, r["w"])).alias("t")) for r in rows])
    best = F.array_max(F.transform(every, lambda t: F.struct(likeness(F.col("w"), t["t"]).alias("l"), t["template"].alias("template"), t["family"].alias("family"))))
    found = lines.select("doc_id", "paragraph", best.alias("b")).filter(F.col("b.l") >= s.like)
    return found.select("doc_id", "paragraph", F.col("b.family").alias("family"), F.col("b.l").alias("probability"), F.col("b.template").alias("template"), F.col("b.l").alias("likeness"), F.lit(True).alias("confirmed"))


def scan(docs: DataFrame, s: Settings = Settings(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every paragraph that is called a licence: doc_id, paragraph, family, probability,
    template (the likest), likeness, confirmed."""
    lines = paragraphs(docs, text, doc_id)
    scanner = train(lines, s)
    if scanner.model is None:
        return _by_templates(lines, s)
    scored = scanner.model.transform(featured(lines.select("doc_id", "paragraph", "w"), s)).withColumn("p", vector_to_array("__p"))
    families = F.array(*map(F.lit, scanner.families[1:]))
    best = F.array_max(F.transform(F.slice("p", 2, len(scanner.families) - 1), lambda x, i: F.struct(x.alias("p"), i.alias("i"))))
    # A generator, not a filter: that would be pushed below the columns it is made of and compute
    # them anew for each use.
    kept = F.inline(F.filter(F.array(best), lambda b: b["p"] >= scanner.least))
    called = scored.select("doc_id", "paragraph", "w", kept)
    called = called.select("doc_id", "paragraph", "w", F.col("p").alias("probability"), F.get(families, F.col("i")).alias("family"))
    of_family = template_table(docs.sparkSession).groupBy("family").agg(F.sort_array(F.collect_list(F.struct("template", F.col("w").alias("t")))).alias("__t"))
    out = called.join(F.broadcast(of_family), "family")  # as many rows as there are families
    likest = F.array_max(F.transform("__t", lambda t: F.struct(likeness(F.col("w"), t["t"]).alias("l"), t["template"].alias("template"))))
    out = out.withColumn("__l", likest)
    return out.select("doc_id", "paragraph", "family", "probability", F.col("__l.template").alias("template"), F.col("__l.l").alias("likeness"), (F.col("__l.l") >= s.like).alias("confirmed"))
