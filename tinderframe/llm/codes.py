"""Vectors as short codes: product quantization with searches through a GNAT.

Vectors of integers are cut into equal parts; each part position has a codebook, and a vector
becomes the numbers of the nearest entries. Codebooks are fitted by rounds over all rows: tasks
assign the parts, add up integer sums and counts per entry in their own memory, and Spark adds
the tasks' sums. Only the codebooks themselves (``entries`` x parts x part length integers,
fixed by the parameters) pass through the driver and go to the tasks.

The nearest entry is found in a GNAT (geometric near-neighbour access tree) per codebook. A node
holds split points; every other entry belongs to the child of its nearest split point, and for
each split point and child the node stores the range of distances between that point and the
child's entries. A query measures the split points; a child whose range lies outside the
query's distance plus and minus its best distance so far cannot hold a nearer entry and goes as
a whole. Ranges and distances are widened by more than their rounding error and a child goes
only if it is strictly out of reach, so an entry at the same distance is never lost. What is
left is compared by exact integer squared distances, ties by the lower index. All queries of a
batch walk the tree together.

Defined cases: rows without a vector (null) drop out; shorter vectors are filled with zeros up to
the longest one, and that to a multiple of the number of parts; the first entries are the parts
of the first rows by id (null ids last), then by vector, so fewer rows give fewer entries;
repeated rows are rows of their own; entries without members stay as they are; components whose
squared distances could leave 64 bits are computed as unbounded integers (distances that do not
fit a long are an error); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Split points of a node; children of fewer entries are leaves.
SPLITS = 5
#: Beyond this size of components sums of squares are not left to 64 bits.
EXACT = 1 << 26


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` (n) to all of ``b`` (m): n x m."""
    d = a[:, None, :] - b[None, :, :]
    return np.einsum("nmd,nmd->nm", d, d) if d.dtype == np.int64 else (d * d).sum(axis=-1)


def root(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64))


class Gnat:
    """The entries of one codebook."""

    def __init__(self, points: np.ndarray, index: np.ndarray | None = None):
        self.points = points
        self.index = np.arange(len(points)) if index is None else index
        self.splits, self.children = self.index, []
        if len(self.index) > 2 * SPLITS:
            self._divide()

    def _divide(self) -> None:
        own = self.points[self.index]
        chosen, away = [0], squares(own, own[:1])[:, 0]
        while len(chosen) < SPLITS and away.max() > 0:  # far from each other
            chosen.append(int(away.argmax()))
            away = np.minimum(away, squares(own, own[chosen[-1:]])[:, 0])
        between = squares(own, own[chosen])
        nearest = between.argmin(axis=1)
        rest = np.ones(len(own), bool)
        rest[chosen] = False
        if len(chosen) < 2:  # all equal
            return
        self.splits = self.index[chosen]
        for c in range(len(chosen)):
            members = np.flatnonzero(rest & (nearest == c))
            if len(members):
                d = root(between[members])
                low, high = d.min(axis=0), d.max(axis=0)
                self.children.append((low * (1 - 1e-9) - 1e-9, high * (1 + 1e-9) + 1e-9, Gnat(self.points, self.index[members])))

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each query's nearest entry, the lower index of equals."""
        index = np.full(len(queries), np.iinfo(np.int64).max)
        best = np.zeros(len(queries), queries.dtype)
        self._search(queries, np.arange(len(queries)), index, best)
        return index, best

    def _search(self, queries, at, index, best) -> None:
        d = squares(queries[at], self.points[self.splits])
        order = np.lexsort([np.broadcast_to(self.splits, d.shape), d], axis=-1)[:, 0] if d.dtype == object else _first(d, self.splits)
        found, place = d[np.arange(len(at)), order], self.splits[order]
        none = index[at] == np.iinfo(np.int64).max
        better = none | (found < best[at]) | ((found == best[at]) & (place < index[at]))
        best[at[better]], index[at[better]] = found[better], place[better]
        if not self.children:
            return
        away = root(d) if self.children else None
        for low, high, child in self.children:
            reach = root(best[at])[:, None]
            slack = 1e-9 * (away + reach) + 1e-9
            near = ((away + reach + slack >= low) & (away - reach - slack <= high)).all(axis=1)
            if near.any():
                child._search(queries, at[near], index, best)


def _first(d: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """Column of the smallest distance, the lowest index of equals."""
    return np.where(d == d.min(axis=1, keepdims=True), splits, np.iinfo(np.int64).max).argmin(axis=1)


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


#: Rows that walk the trees together.
BATCH = 4096


def matrix(vectors: list, length: int) -> np.ndarray:
    """Rows of equal length, zeros at the end of shorter vectors."""
    out = np.zeros((len(vectors), length), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Codebooks:
    """Codebooks (parts x entries x part length) with their trees."""

    def __init__(self, books: np.ndarray):
        self.parts, self.entries, self.width = books.shape
        self.books, self.trees = books, {}

    def __reduce__(self):  # trees are grown again where they are needed
        return Codebooks, (self.books,)

    def _grown(self, dtype) -> list[Gnat]:
        if dtype not in self.trees:
            self.trees[dtype] = [Gnat(b.astype(dtype)) for b in self.books]
        return self.trees[dtype]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entries (rows x parts) and the sum of their squared distances."""
        wide = any(a.size and max(int(a.max()), -int(a.min())) > EXACT for a in (x, self.books))
        x = x.astype(object) if wide else x
        numbers, errors = np.zeros((len(x), self.parts), np.int64), np.zeros(len(x), x.dtype)
        for p, tree in enumerate(self._grown(x.dtype)):
            numbers[:, p], best = tree.nearest(x[:, p * self.width : (p + 1) * self.width])
            errors = errors + best
        return numbers, errors

    def rows(self, batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        """Batches of at most ``BATCH`` rows with their vectors as a matrix."""
        for batch in batches:
            for i in range(0, len(batch), BATCH):
                part = batch.iloc[i : i + BATCH]
                yield part, matrix(part["__v"].to_list(), self.parts * self.width)

    def sums(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Integer sums and counts per entry (numbered over all parts) of a task's rows."""
        slots = self.parts * self.entries
        sums, counts = np.zeros((slots, self.width), object), np.zeros(slots, np.int64)
        for _, x in self.rows(batches):
            numbers, _ = self.assign(x)
            for p in range(self.parts):
                at = numbers[:, p] + p * self.entries
                counts += np.bincount(at, minlength=slots)
                for j in range(self.width):
                    column = x[:, p * self.width + j]
                    low, high = column & 0xFFFFFFFF, column >> 32  # halves stay exact as doubles
                    sums[:, j] += [int(l) + (int(h) << 32) for l, h in zip(*(np.bincount(at, w, slots) for w in (low, high)))]
        used = np.flatnonzero(counts)
        if len(used):
            yield pd.DataFrame({"entry": used, "n": counts[used], "sums": [[Decimal(s) for s in sums[u]] for u in used]})

    def codes(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, x in self.rows(batches):
            numbers, errors = self.assign(x)
            yield part.drop(columns="__v").assign(code=list(numbers), error=[int(e) for e in errors])

    def text(self) -> str:
        """All entries' components, by part, entry and place, joined by commas."""
        return ",".join(map(str, self.books.ravel().tolist()))


def fit(rows: DataFrame, parts: int, entries: int, rounds: int) -> Codebooks:
    """Codebooks of the rows (__id, __v)."""
    longest = rows.agg(F.max(F.size("__v"))).first()[0]
    width = max(1, -(-(longest or 0) // parts))
    first = rows.orderBy(F.asc_nulls_last("__id"), "__v").limit(entries).select("__v").collect()  # one codebook
    start = matrix([r[0] for r in first], parts * width).reshape(len(first), parts, width)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)))
    for _ in range(rounds if len(first) else 0):
        sums = rows.select("__v").mapInPandas(books.sums, "entry int, n long, sums array<decimal(38,0)>")
        total = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
        flat = books.books.reshape(-1, width).copy()
        for r in sums.groupBy("entry").agg(F.sum("n").alias("n"), *total).collect():  # a row an entry
            flat[r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
        books = Codebooks(flat.reshape(books.books.shape))
    return books


def encode(vectors: DataFrame, vector: str, vec_id: str, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, Codebooks]:
    """(rows of ``vectors`` with ``code``: array of entry numbers, ``error``: sum of squared
    distances; codebooks). ``vector`` holds integers; it and rows without one are left out."""
    kept = [c for c in vectors.columns if c not in (vector, "code", "error")]
    rows = vectors.filter(F.col(vector).isNotNull()).select(*kept, F.col(vec_id).alias("__id"), F.col(vector).alias("__v"))
    books = fit(rows.select("__id", "__v"), parts, entries, rounds)
    fields = [f for f in vectors.schema.fields if f.name in kept]
    schema = T.StructType([*fields, T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    return rows.drop("__id").mapInPandas(books.codes, schema), books
