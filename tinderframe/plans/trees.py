"""Boosted trees and forests grown on histograms of binned features.

A fit bins the features once (borders from mergeable quantile sketches) and stores the rows as
blocks of small integers. Then a pass over the blocks adds up, per tree, node, feature and bin,
the rows' weights and targets (or gradients); the sums of all tasks are merged in a tree of
tasks, and the driver, which sees only these sums (trees x nodes x features x bins, whatever the
number of rows), picks the splits of one level. Boosting takes rounds x depth passes, a forest
``depth`` passes for all its trees together.

Targets, gradients and leaf values are integers in steps of ``step``. Sums are therefore exact
and the same trees come out for any partitioning, order of rows or engine. Which rows and
features a tree sees follows from a hash of (seed, tree, row key), not from a generator.

Passes are RDD jobs: each is a loop over arrays whose plan never changes. Rows in memory can be
lost with an executor; they are read again from the stored blocks and brought up to date by the
trees in the pass itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from tinderframe.session import cut_lineage

#: Rows of a block; a task holds whole blocks.
BLOCK = 65_536
#: Boosting rounds after which the rows' predictions are kept instead of computed anew.
REFRESH = 10
#: Accuracy of the quantile sketches: borders are exact below some tens of thousands of rows.
SKETCH = 100_000
WORD = 0xFFFFFFFF


def scrambled(x):
    """A 32-bit finalizer on integers or arrays of them."""
    for _ in range(2):
        x = ((x >> 16) ^ x) * 73_244_475 & WORD
    return (x >> 16) ^ x


def draw(seed: int, number: int, key):
    """A 32-bit number for (seed, tree or round, key)."""
    return scrambled(scrambled(seed * 65_537 + number & WORD) ^ key)


def poisson(u: np.ndarray) -> np.ndarray:
    """Draws of a Poisson distribution with mean 1: how often a bootstrap takes a row."""
    share = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    return np.searchsorted(np.floor(share * 2.0**32), u, side="right")


def row_key(*columns: Column) -> Column:
    """32 bits of the MD5 of the columns' values as text."""
    text = F.concat_ws("_", *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


@dataclass(frozen=True)
class Settings:
    trees: int
    depth: int
    bins: int = 256
    step: float = 1e-4
    seed: int = 42
    least: float = 1.0  # weight of a child
    l2: float = 0.0
    least_gain: float = 0.0
    columns: float = 1.0  # share of the features a tree (boosting) or a node (forest) may split on
    rows: float = 1.0  # share of the rows a boosting round sees
    rate: float = 1.0
    boosted: bool = True


class Tree:
    """A binary tree in heap order: children of node i are 2i + 1 and 2i + 2."""

    def __init__(self, depth: int, root: int):
        n = 2 ** (depth + 1) - 1
        self.feature, self.bin, self.value = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.gain = np.zeros(n)
        self.value[0] = root

    def nodes(self, x: np.ndarray, levels: int) -> np.ndarray:
        """Node of each column of ``x`` (features x rows of bins) after some levels."""
        node, at = np.zeros(x.shape[1], np.int64), np.arange(x.shape[1])
        for _ in range(levels):
            f = self.feature[node]
            right = x[np.maximum(f, 0), at] > self.bin[node]
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return node


@dataclass
class Block:
    x: np.ndarray  # features x rows
    y: np.ndarray
    key: np.ndarray
    weight: np.ndarray
    margin: np.ndarray


def rounded(x: float) -> int:
    return math.floor(x + 0.5)


def _seen(s: Settings, number: int, node: int, n_features: int) -> np.ndarray:
    """Features a tree (boosting) or node (forest) may split on."""
    n = max(1, int(s.columns * n_features))
    order = sorted((draw(s.seed + 1, number * 64 + node, f + 1), f) for f in range(n_features))
    allowed = np.zeros(n_features, bool)
    allowed[[f for _, f in order[:n]]] = True
    return allowed


def split_level(s: Settings, tree: Tree, number: int, level: int, weight: np.ndarray, total: np.ndarray) -> bool:
    """Split the tree's nodes of a level by sums (nodes x features x bins); whether any was.

    The gain of a split is the drop of the (regularized) squared error. Of equal gains the
    first feature counts, then the lowest bin.
    """
    some = False
    for i in range(2**level):
        node = 2**level - 1 + i
        if level and tree.feature[(node - 1) // 2] < 0:
            continue
        h, g = np.cumsum(weight[i], axis=1).astype(float), np.cumsum(total[i], axis=1).astype(float)
        hs, gs = h[0, -1], g[0, -1]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = g * g / (h + s.l2) + (gs - g) * (gs - g) / (hs - h + s.l2) - gs * gs / (hs + s.l2)
        fits = (h >= s.least) & (hs - h >= s.least) & _seen(s, number, 0 if s.boosted else node, len(h))[:, None]
        gain = np.where(fits, gain * s.step * s.step, -np.inf)
        f, b = np.unravel_index(np.argmax(gain), gain.shape)
        if not (gain[f, b] > 1e-6 and gain[f, b] >= s.least_gain):
            continue
        some = True
        tree.feature[node], tree.bin[node], tree.gain[node] = f, b, gain[f, b]
        for child, gc, hc in ((2 * node + 1, g[f, b], h[f, b]), (2 * node + 2, gs - g[f, b], hs - h[f, b])):
            tree.value[child] = rounded(s.rate * (gc / (hc + s.l2)))
    return some


def _sums(block: Block, s: Settings, trees: Sequence[Tree], first: int, level: int) -> np.ndarray:
    """2 x trees x nodes x features x bins: weights and targets of a block's rows."""
    n_features, out = len(block.x), np.zeros((2, len(trees), 2**level, len(block.x), s.bins), np.int64)
    for t, tree in enumerate(trees):
        u = draw(s.seed, first + t, block.key)
        drawn = (u < s.rows * 2.0**32).astype(np.int64) if s.boosted else poisson(u)
        weight = drawn * block.weight
        target = (block.y - block.margin if s.boosted else block.y) * weight
        node = tree.nodes(block.x, level) - (2**level - 1)
        used = np.flatnonzero((weight > 0) & (node >= 0))
        for f in range(n_features):
            slot = node[used] * s.bins + block.x[f, used]
            for k, w in enumerate((weight, target)):  # exact: a block's sums stay below 2^53
                out[k, t, :, f] += np.bincount(slot, w[used], 2**level * s.bins).astype(np.int64).reshape(-1, s.bins)
    return out


def _advanced(block: Block, trees: Sequence[Tree], depth: int) -> Block:
    margin = block.margin
    for tree in trees:
        margin = margin + tree.value[tree.nodes(block.x, depth)]
    return replace(block, margin=margin)


def _level(blocks, s: Settings, done: Sequence[Tree], growing: Sequence[Tree], first: int, level: int) -> np.ndarray:
    def run(part: Iterator[Block]) -> Iterator[np.ndarray]:
        total = None
        for block in part:
            sums = _sums(_advanced(block, done, s.depth), s, growing, first, level)
            total = sums if total is None else total + sums
        if total is not None:
            yield total

    return blocks.mapPartitions(run).treeReduce(lambda a, b: a + b, depth=2 if blocks.getNumPartitions() < 1000 else 3)


class TreeModel:
    """Fitted trees; ``transform`` adds ``preds`` (null where a feature is missing)."""

    def __init__(self, settings: Settings, features: Sequence[str], edges: list[list[float]], base: int, trees: list[Tree]):
        self.settings, self.features, self.edges, self.base, self.trees = settings, list(features), edges, base, trees

    def score(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """Predictions of rows given as an array per feature."""
        s = self.settings
        x = np.stack([np.searchsorted(np.array(e), c, side="left") for e, c in zip(self.edges, columns)])
        total = sum((t.value[t.nodes(x, s.depth)] for t in self.trees), np.zeros(x.shape[1], np.int64))
        return (self.base + total if s.boosted else total / max(1, len(self.trees))) * s.step

    def transform(self, df: DataFrame) -> DataFrame:
        @F.pandas_udf("double")
        def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for rows in batches:
                values = rows.to_numpy(float).T
                known = ~np.isnan(values).any(axis=0)
                yield pd.Series(self.score(values)).where(known)

        return df.withColumn("preds", scored(F.struct(*[F.col(c).cast("double").alias(c) for c in self.features])))


def _blocks(rows: DataFrame, edges: list[list[float]], features: Sequence[str]):
    """Binned rows as stored blocks, and as an RDD kept in memory."""
    dtype = np.uint16

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def block():
            table = pa.Table.from_batches(waiting)
            x = np.stack([np.searchsorted(np.array(e), table[c].to_numpy(), side="left") for c, e in zip(features, edges)])
            parts = [x.astype(dtype), *[table[c].to_numpy().astype(np.int64) for c in ("__y", "__key", "__w")]]
            return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["x", "y", "key", "weight"])

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                n += batch.num_rows
            if n >= BLOCK:
                yield block()
                waiting, n = [], 0
        if n:
            yield block()

    stored = cut_lineage(rows.mapInArrow(pack, "x binary, y binary, key binary, weight binary"), "blocks")
    n_features = len(features)

    def opened(row) -> Block:
        y, key, weight = (np.frombuffer(row[c], np.int64) for c in ("y", "key", "weight"))
        return Block(np.frombuffer(row["x"], dtype).reshape(n_features, -1), y, key, weight, np.zeros(len(y), np.int64))

    return stored.rdd.map(opened)


def fit_trees(train: DataFrame, features: Sequence[str], target: str, settings: Settings, key: Sequence[str] = (), weight: str | None = None) -> TreeModel:
    """Fit on rows whose features and target are all there. ``key`` names a row for the draws
    (default: its values); ``weight`` is a column of whole, not negative weights."""
    s, features = settings, list(features)
    known = F.lit(True)
    for c in (*features, target):
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = train.where(known).select(
        *[F.col(c).cast("double").alias(c) for c in features],
        F.floor(F.col(target).cast("double") / F.lit(s.step) + 0.5).alias("__y"),
        row_key(*[F.col(c) for c in (key or (*features, target))]).alias("__key"),
        (F.col(weight).cast("long") if weight else F.lit(1).cast("long")).alias("__w"),
    )
    rows = cut_lineage(rows, "tree-rows")
    cuts = F.array(*[F.lit(i / s.bins) for i in range(1, s.bins)])
    got = rows.agg(F.sum(F.col("__y") * F.col("__w")).alias("y"), F.sum("__w").alias("w"), *[F.percentile_approx(c, cuts, SKETCH).alias(f"e{i}") for i, c in enumerate(features)]).first()
    edges = [sorted(set(got[f"e{i}"] or [])) for i in range(len(features))]
    base = rounded(got["y"] / got["w"]) if got["w"] else 0
    trees: list[Tree] = []
    if not got["w"]:
        return TreeModel(s, features, edges, base, trees)
    blocks = _blocks(rows, edges, features).persist(StorageLevel.MEMORY_AND_DISK)
    if s.boosted:
        fresh: list[Tree] = []  # trees the kept predictions do not hold yet
        start = base
        blocks_now = blocks.map(lambda b: replace(b, margin=b.margin + start))
        for number in range(s.trees):
            tree = Tree(s.depth, 0)
            for level in range(s.depth):
                sums = _level(blocks_now, s, fresh, [tree], number, level)
                if not level:
                    tree.value[0] = rounded(s.rate * (float(sums[1, 0, 0, 0].sum()) / (float(sums[0, 0, 0, 0].sum()) + s.l2)))
                if not split_level(s, tree, number, level, sums[0, 0], sums[1, 0]):
                    break
            trees.append(tree)
            fresh.append(tree)
            if len(fresh) == REFRESH:
                before, done = blocks_now, list(fresh)
                blocks_now = before.map(lambda b, done=done: _advanced(b, done, s.depth)).persist(StorageLevel.MEMORY_AND_DISK)
                fresh = []
        return TreeModel(s, features, edges, base, trees)
    trees = [Tree(s.depth, base) for _ in range(s.trees)]
    for level in range(s.depth):
        sums = _level(blocks, s, [], trees, 0, level)
        some = [split_level(s, tree, number, level, sums[0, number], sums[1, number]) for number, tree in enumerate(trees)]
        if not any(some):
            break
    return TreeModel(s, features, edges, base, trees)
