"""Substring deduplication by sliding spans of sentences.

A text is cut into sentences, which end with ``.``, ``!`` or ``?`` and white space or with a
line; every sentence keeps what follows it, so the sentences put together are the text.
Runs of consecutive sentences slide over it: from each sentence on, and up to each sentence,
the shortest run of at least ``least`` sentences and ``min_words`` words is hashed (case and
white space do not count). Runs are joined over all documents by hash: the first occurrence
of a run, by document id, then text hash, then place, stays; sentences that any later
occurrence covers are removed. The runs depend on nothing but their own sentences, so those
of a repeated passage that is long enough are the same wherever it stands, and together they
cover it to both ends. Texts of fewer sentences than ``least`` may have one run, the whole.

Repeats inside one document need no other document and are found where its text is. Between
documents, a hot span (a passage that a third of all documents share) is reduced to its first
id and text hash by a partial aggregate; the join back is a plain equi-join whose hot partitions Spark may
split. Only (hash, document, number of the run) move; texts move once, to meet their list of
runs to remove.

Defined cases: null and empty texts have no spans and stay as they are; rows that agree in id
and text are one document and get the same result, so a repeated row keeps what its twin keeps;
different texts of one id, or of a null id, are compared like any others; a null id sorts last;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tinderframe.llm.common import slices
from tinderframe.session import cut_lineage

END = re.compile(r"[.!?]\s+|\n\s*")


def sentences(text: str) -> list[str]:
    out, at = [], 0
    for m in END.finditer(text):
        if text[at : m.end()].strip():  # blanks at the start belong to the first sentence
            out.append(text[at : m.end()])
            at = m.end()
    if at < len(text):
        out.append(text[at:])
    return out


def spans(text: str | None, least: int, min_words: int) -> list[tuple[int, int, bytes]]:
    """(first sentence, number of sentences, hash of 128 bits) of each run that counts: from each
    sentence on, and up to each sentence, the shortest run that is long enough."""
    words = [s.lower().split() for s in sentences(text or "")]
    least = min(least, len(words))
    if not words:
        return []
    total = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    at = np.arange(len(words))
    to = np.maximum(np.searchsorted(total, total[:-1] + min_words), at + least)  # total[to] - total[at] >= min_words
    start = np.minimum(np.searchsorted(total, total[1:] - min_words, "right") - 1, at + 1 - least)
    runs = {(int(a), int(b)) for a, b in zip(at, to) if b <= len(words)}
    runs |= {(int(a), int(b) + 1) for a, b in zip(start, at) if a >= 0}
    plain = [" ".join(w) for w in words]
    return [(a, b - a, xxhash.xxh3_128_digest("\n".join(plain[a:b]))) for a, b in sorted(runs)]


def later_runs(runs: list[tuple[int, int, bytes]]) -> tuple[list[int], list[int]]:
    """Numbers of the runs that are the first of their hash in the text, and of the others."""
    seen, first, others = set(), [], []
    for i, (_, _, span) in enumerate(runs):
        (others if span in seen else first).append(i)
        seen.add(span)
    return first, others


def span_table(docs: DataFrame, least: int, min_words: int, text: str = "text") -> DataFrame:
    """One row per distinct span of a document: __id, __h (hash of the text), run, span."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            row, number, span = [], [], []
            for i, t in enumerate(part.column("__text").to_pylist()):
                own = spans(t.decode() if t else None, least, min_words)
                first, _ = later_runs(own)
                row += [i] * len(first)
                number += first
                span += [own[k][2] for k in first]
            ids = [part.column(c).take(pa.array(row, pa.int64())) for c in ("__id", "__h")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(number, pa.int32()), pa.array(span, pa.binary())], ["__id", "__h", "run", "span"])

    rows = docs.select(F.col("__id"), "__h", F.col(text).cast("binary").alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"__id {kind}, __h long, run int, span binary")


def repeated_runs(docs: DataFrame, least: int, min_words: int, text: str = "text") -> DataFrame:
    """Per document with any: __id, __h and the numbers of runs that an earlier document has."""
    found = cut_lineage(span_table(docs, least, min_words, text), "spans")  # read twice, cut once
    place = F.struct(F.col("__id").isNull().alias("last"), F.col("__id").alias("id"), F.col("__h").alias("h"))
    first = found.groupBy("span").agg(F.min(place).alias("__first"), F.count("*").alias("__n")).filter("__n > 1")
    first = first.select(F.col("span").alias("__span"), F.col("__first.id").alias("__i"), F.col("__first.h").alias("__k"))
    same = F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__h") == F.col("__k"))
    later = found.join(first, found["span"] == first["__span"]).filter(~same)
    return later.groupBy("__id", "__h").agg(F.collect_set("run").alias("__gone"))


def _remove(least: int, min_words: int):
    def remove(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, gone in batches:
            out = []
            for t, g in zip(texts, gone):
                own, runs = sentences(t or ""), spans(t, least, min_words)
                drop: set[int] = set()
                for i in [*later_runs(runs)[1], *(g if g is not None else ())]:
                    drop.update(range(runs[i][0], runs[i][0] + runs[i][1]))
                kept = "".join(s for i, s in enumerate(own) if i not in drop) if drop else t
                out.append((kept, len(own), sorted(drop)))
            yield pd.DataFrame(out, columns=["text", "n", "removed"], index=texts.index)

    remove.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(remove, "text string, n int, removed array<int>")


def dedup_spans(docs: DataFrame, least: int = 2, min_words: int = 25, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with repeated spans taken out of the text, plus __removed (numbers of the
    removed sentences, empty if none) and __sentences (number of sentences before)."""
    keyed = docs.withColumns({"__id": F.col(doc_id), "__h": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    gone = repeated_runs(keyed, least, min_words, text).select(F.col("__id").alias("__i"), F.col("__h").alias("__k"), "__gone")
    out = keyed.join(gone, keyed["__id"].eqNullSafe(gone["__i"]) & (keyed["__h"] == gone["__k"]), "left")
    out = out.withColumn("__kept", _remove(least, min_words)(F.col(text), F.col("__gone")))
    new = {text: F.col("__kept.text"), "__removed": F.col("__kept.removed"), "__sentences": F.col("__kept.n")}
    if "n_chars" in docs.columns and text == "text":
        new["n_chars"] = F.when(F.size("__kept.removed") > 0, F.length("__kept.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(new).select(*docs.columns, "__removed", "__sentences")
