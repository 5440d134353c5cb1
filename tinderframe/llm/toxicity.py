"""Toxicity scores from FTRL-proximal logistic regression over hashed word features.

Features of a text are the distinct buckets of its words, word pairs (neighbours),
skip-grams (words two apart) and word stems (the first ``STEM`` bytes, a crude stem for
inflecting languages; one bucket more for each of ``LEVELS`` occurrences it reaches), lower-cased,
hashed to 2**bits. FTRL-proximal keeps a step size
per coordinate and an L1 penalty, so few weights differ from zero and the model is small
enough to send to every worker whatever the corpus holds.

FTRL is an online method: it runs in one task over a sample of labelled texts, drawn and
ordered by a hash of id and text. ``max_rows`` bounds their number and ``max_bytes`` their
expected size; a text that rows repeat under one id counts once. Other tasks turn the texts into
buckets first. A fifth of the sample is kept out
of the passes and fits a logistic calibration of the sum of weights (shrunken weights
understate the odds), which is folded into weights and bias. Scoring is a narrow step over
all texts, whole ones.

Defined cases: null and empty texts score the bias alone; labels that are null are not used;
several labels of one id count as toxic if one of them is; without labelled rows every score
is 0.5; repeated rows are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tinderframe.llm.common import mix
from tinderframe.session import cut_lineage

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
STEM = 6
LEVELS = (1, 2, 4)


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.01
    epochs: int = 3
    max_rows: int = 24_000
    max_bytes: int = 256 << 20
    kept_out: int = 5  # one row in so many calibrates


def features(texts: list[bytes | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word, pair and skip-gram, repeats included, and of every stem
    and level it reaches."""
    found = [WORD.findall(t.lower()) if t else [] for t in texts]
    counts = np.array([len(w) for w in found], dtype=np.int64)
    row = np.repeat(np.arange(len(texts)), counts)
    word = np.fromiter((crc32(w) for ws in found for w in ws), dtype=np.uint64, count=len(row))
    shift = np.uint64(64 - bits)
    rows, grams = [row], [mix(word + np.uint64(1 << 40))]
    for gap in (1, 2):
        if len(row) > gap:
            together = row[:-gap] == row[gap:]
            gram = mix(word[:-gap] * np.uint64(0x9E3779B97F4A7C15) + word[gap:] + np.uint64(gap << 41))
            rows.append(row[:-gap][together])
            grams.append(gram[together])
    stem = np.fromiter((crc32(w[:STEM]) for ws in found for w in ws), dtype=np.uint64, count=len(row))
    stem, times = np.unique(row.astype(np.uint64) << np.uint64(32) | stem, return_counts=True)
    for level in LEVELS:
        often = stem[times >= level]
        rows.append((often >> np.uint64(32)).astype(row.dtype))
        grams.append(mix((often & np.uint64(0xFFFFFFFF)) + np.uint64(level << 44)))
    return np.concatenate(rows), (np.concatenate(grams) >> shift).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal; the last coordinate is the bias, free of L1."""

    def __init__(self, s: Settings):
        self.s, size = s, (1 << s.bits) + 1
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.l1 = np.full(size, s.l1)
        self.l1[-1] = 0.0

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, s = self.z[at], self.s
        shrunk = z - np.sign(z) * self.l1[at]
        return np.where(np.abs(z) <= self.l1[at], 0.0, -shrunk / ((s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2))

    def learn(self, buckets: np.ndarray, label: int) -> None:
        w = self.weights(buckets)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[buckets]
        self.z[buckets] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[buckets] = n + g * g


def calibration(raw: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that map raw sums to log odds: Platt's method, whose smoothed
    targets keep separable rows finite. With one class only, sums stay as they are."""
    ones = int(label.sum())
    if ones in (0, len(label)):
        return 1.0, 0.0
    wanted = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (len(label) - ones + 2))
    raw = raw / (scale := float(np.abs(raw).max()) or 1.0)

    def loss(a: float, b: float) -> float:
        z = a * raw + b
        return float(np.logaddexp(0, z).sum() - (wanted * z).sum() + 5e-4 * a * a)

    a, b = 1.0, 0.0
    for _ in range(100):  # Newton steps on two unknowns, shortened until they help
        p = 1.0 / (1.0 + np.exp(-np.clip(a * raw + b, -35, 35)))
        v = p * (1 - p) + 1e-9
        slope = np.array([((p - wanted) * raw).sum() + 1e-3 * a, (p - wanted).sum()])
        curve = np.array([[(v * raw * raw).sum() + 1e-3, (v * raw).sum()], [(v * raw).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(curve, slope)
        while np.abs(step).max() > 1e-9 and loss(a - step[0], b - step[1]) > loss(a, b):
            step = step / 2
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (float(a / scale), float(b)) if a > 0 else (1.0, 0.0)


def _fit(s: Settings):
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["__order", "__label"], kind="stable")
        model, bias = Ftrl(s), 1 << s.bits
        examples = [np.append(b, bias).astype(np.int32) for b in rows["__buckets"]]
        labels = rows["__label"].to_numpy()
        out = np.arange(len(rows)) % s.kept_out == s.kept_out - 1
        for _ in range(s.epochs):
            for i in np.flatnonzero(~out):
                model.learn(examples[i], int(labels[i]))
        w = model.weights(slice(None))
        a, b = calibration(np.array([w[examples[i]].sum() for i in np.flatnonzero(out)]), labels[out])
        w *= a
        w[bias] += b
        at = np.flatnonzero(w)
        return pd.DataFrame({"bucket": at, "weight": w[at]})

    return fit


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), label: str = "toxic", text: str = "text", doc_id: str = "doc_id") -> pd.DataFrame:
    """Weights of the labelled documents as rows (bucket, weight)."""
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    known = known.groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("int").alias("__label"))
    texts = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__text"))
    texts = texts.withColumn("__h", F.xxhash64("__text"))
    keys = texts.select("__id", "__h", F.length("__text").alias("__n")).join(known, "__id")
    keys = keys.groupBy("__id", "__h").agg(F.max("__n").alias("__n"), F.max("__label").alias("__label"))
    keys = cut_lineage(keys.withColumn("__order", F.xxhash64("__id", "__h", F.lit("order"))), "labelled")
    rows, size = keys.agg(F.count("*"), F.coalesce(F.sum("__n"), F.lit(0))).first()
    kept = min(1.0, s.max_rows / max(rows, 1), s.max_bytes / max(size, 1))
    draw = F.pmod(F.xxhash64("__id", "__h", F.lit("sample")), F.lit(1 << 30))
    sample = keys.filter(draw <= F.lit(int((1 << 30) * kept))).orderBy(draw).limit(s.max_rows).select(F.col("__id").alias("__i"), F.col("__h").alias("__k"), "__label", "__order")
    # at most max_rows keys of a few numbers
    drawn = texts.join(F.broadcast(sample), (F.col("__id") == F.col("__i")) & (F.col("__h") == F.col("__k")))
    once = drawn.groupBy("__id", "__h").agg(F.first("__text").alias("__text"), F.first("__label").alias("__label"), F.first("__order").alias("__order"))

    @F.pandas_udf("array<int>")
    def buckets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.unique(features([t], s.bits)[1]).astype(np.int32) for t in batch], index=batch.index, dtype=object)

    joined = once.select("__label", "__order", buckets("__text").alias("__buckets"))
    model = joined.groupBy(F.lit(0).alias("__all")).applyInPandas(_fit(s), "bucket long, weight double")
    return model.toPandas().sort_values("bucket", ignore_index=True)  # few of 2**bits + 1 coordinates


def score(text: Column, model: pd.DataFrame, s: Settings = Settings()) -> Column:
    """Probability of the label for a column of texts."""
    bias = float(model.loc[model["bucket"] == 1 << s.bits, "weight"].sum())
    kept = model[model["bucket"] < 1 << s.bits]
    at, weight = kept["bucket"].to_numpy(np.int64), kept["weight"].to_numpy(np.float64)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = np.zeros(1 << s.bits)
        table[at] = weight
        for texts in batches:
            yield pd.Series(_scores(list(texts), table, bias, s.bits), index=texts.index)

    scored.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(scored, "double")(text.cast("binary"))


def _scores(texts: list, table: np.ndarray, bias: float, bits: int, most: int = 1 << 20) -> np.ndarray:
    out = np.empty(len(texts))
    ends = np.cumsum([len(t or b"") for t in texts])
    a = 0
    while a < len(texts):  # about ``most`` bytes at a time
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        row, bucket = features(texts[a:b], bits)
        hit = table[bucket] != 0
        pairs = np.unique(np.stack([row[hit], bucket[hit]]), axis=1)
        total = np.bincount(pairs[0], table[pairs[1]], minlength=b - a) + bias
        out[a:b] = 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))
        a = b
    return out
