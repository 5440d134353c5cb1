"""Exact top-k by inner product: a dual-tree search over cover trees.

Queries and candidates are indexed together. The top level of the cover tree is a set of
pivots, picked far apart from a bounded sample; every vector belongs to its nearest pivot, and
a pivot's vectors make one node, or several by a hash of the row where they are many (a vector
or an id that a third of the rows share, say). Within a node a task builds a cover tree: a point, the
radius of all points under it, and children that are nets of half the radius.

1. Each node's queries are searched in their own node, which bounds each query's kth score
   from below.
2. A pair of nodes is searched only if the largest possible score between the ball of the
   queries and the ball of the vectors, c*d + r|d| + s|c| + rs, reaches the worst kth score of
   the queries. Nodes are at most ``MOST_NODES`` in number whatever the table holds (they grow
   instead), so the list of balls is small enough for every task.
3. In a pair, both trees are descended together with the same test, best children first.
4. What both steps found is ranked per query.

A pruned pair cannot change a result, ties included: a bound equal to the kth score is still
searched. Scores are integers and exact. Node rows hold packed arrays; a task holds one node
and streams query groups past it.

Defined cases: vectors that are null or hold null or non-finite components take no part, as
query or candidate; shorter vectors count as padded with zeros; a query is a row: it never
finds itself, but does find other rows of its id, and each of several query rows of one id has
a list of its own; repeated candidate rows are ranked one by one; ties go to the smaller id,
null ids last (the largest long counts as null); fewer candidates than k give fewer rows; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tinderframe.session import cut_lineage

PIVOTS = 48
SAMPLE = 2048
NODE = 4096
MOST_NODES = 4096
LEAF = 48
NO_ID = 2**63 - 1  # stands for a null id


def finite(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact in either way."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class CoverTree:
    """Nodes as flat lists: centre, radius, own points, children."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.exact = points.astype(np.float64)
        self.center, self.radius, self.own, self.children = [], [], [], []
        if len(points):
            self._grow(np.arange(len(points)), 0)

    def _away(self, members: np.ndarray, center: int) -> np.ndarray:
        d = self.exact[members] - self.exact[center]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _grow(self, members: np.ndarray, center: int) -> None:
        """Adds the node of ``members`` (its centre among them) and all below it."""
        todo = [(members, center, -1)]
        while todo:
            members, center, parent = todo.pop()
            away = self._away(members, center)
            me = len(self.center)
            self.center.append(center)
            self.radius.append(float(away.max()))
            self.own.append(members)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(me)
            if len(members) <= LEAF or self.radius[me] == 0:
                continue
            # a net of half the radius; groups too small for a node stay as own points
            loose, left, scale = [], members, self.radius[me] / 2
            gap, head = away, center
            while len(left):
                inside = gap <= scale
                if inside.sum() > LEAF // 4:
                    todo.append((left[inside], head, me))
                else:
                    loose.append(left[inside])
                left, away_left = left[~inside], away[~inside]
                if len(left):
                    far = int(away_left.argmax())
                    head, away = int(left[far]), away_left
                    gap = self._away(left, head)
            self.own[me] = np.concatenate(loose) if loose else np.zeros(0, np.int64)


class Best:
    """The k best (score, id) of each query so far; rows are (id, row number) pairs."""

    def __init__(self, queries: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.query, self.k, size = queries, k, len(queries)
        self.score = np.full((size, k), np.iinfo(np.int64).min)
        self.id = np.full((size, k), np.iinfo(np.int64).max)
        self.has = np.zeros((size, k), bool)
        self.floor = np.full(size, np.iinfo(np.int64).min) if floor is None else floor

    def kth(self, at: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[at, -1], self.floor[at])

    def offer(self, at: np.ndarray, scores: np.ndarray, rows: np.ndarray) -> None:
        wanted = (scores >= self.kth(at)[:, None]) & (self.query[at, 1][:, None] != rows[:, 1])
        some = wanted.any(axis=1)
        at, scores, wanted = at[some], scores[some], wanted[some]
        if not len(at):
            return
        low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        score = np.concatenate([self.score[at], np.where(wanted, scores, low)], axis=1)
        ident = np.concatenate([self.id[at], np.where(wanted, rows[:, 0], high)], axis=1)
        has = np.concatenate([self.has[at], wanted], axis=1)
        # of what cannot be told apart by score, the smaller id, real entries first
        order = np.lexsort([ident, -score.astype(np.float64) if np.abs(scores).max(initial=0) < 2**52 else ~score, ~has], axis=-1)[:, : self.k]
        self.score[at], self.id[at], self.has[at] = (np.take_along_axis(x, order, 1) for x in (score, ident, has))

    def found(self) -> np.ndarray:
        """(query row, query id, id, score) of all entries."""
        at, place = np.nonzero(self.has)
        return np.stack([self.query[at, 1], self.query[at, 0], self.id[at, place], self.score[at, place]], axis=1)


def dual_search(queries: CoverTree, data: CoverTree, rows: np.ndarray, best: Best) -> None:
    """Offers every pair that can matter to ``best``; pairs of nodes are pruned together."""
    if not queries.center or not data.center:
        return
    q_size, d_size = (np.sqrt(np.einsum("ij,ij->i", t.exact, t.exact)) for t in (queries, data))
    under = [_under(queries, i) for i in range(len(queries.center))]

    def bound(q: int, centers: np.ndarray, radii: np.ndarray) -> np.ndarray:
        c = queries.center[q]
        top = data.exact[centers] @ queries.exact[c] + queries.radius[q] * d_size[centers] + radii * (q_size[c] + queries.radius[q])
        return top + 1e-9 * np.abs(top) + 1e-6

    centers, radii = np.array(data.center), np.array(data.radius)
    todo = [(0, 0)]
    while todo:
        q, d = todo.pop()
        if bound(q, centers[d : d + 1], radii[d : d + 1])[0] < best.kth(under[q]).min():
            continue
        parts = [*queries.children[q], *([-1] if len(queries.own[q]) else [])] if queries.children[q] else [-1]
        for part in parts:
            if part >= 0 and len(data.own[d]) + len(data.children[d]) > 0:
                todo.append((part, d))
                continue
            at = queries.own[q]
            worst = best.kth(at).min()
            own = data.own[d]
            if len(own):
                own = own[bound(q, own, np.zeros(len(own))) >= worst]
            if len(own):
                best.offer(at, dots(queries.points[at], data.points[own]), rows[own])
            if data.children[d]:
                below = np.array(data.children[d])
                top = bound(q, centers[below], radii[below])
                for i in np.argsort(top):  # the best one is popped first
                    if top[i] >= worst:
                        if queries.children[q]:
                            _descend(queries, q, data, int(below[i]), rows, best, bound, centers, radii)
                        else:
                            todo.append((q, int(below[i])))


def _descend(queries, q, data, d, rows, best, bound, centers, radii) -> None:
    """A query node's own points against all below a data node; its children go apart."""
    at, todo = queries.own[q], [d]
    while todo:
        d = todo.pop()
        if bound(q, centers[d : d + 1], radii[d : d + 1])[0] < best.kth(at).min():
            continue
        if len(own := data.own[d]):
            best.offer(at, dots(queries.points[at], data.points[own]), rows[own])
        todo += data.children[d]


def _under(tree: CoverTree, node: int) -> np.ndarray:
    out, todo = [], [node]
    while todo:
        i = todo.pop()
        out.append(tree.own[i])
        todo += tree.children[i]
    return np.concatenate(out)


def _pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, np.int64).tobytes()


def _open(blob: bytes, dim: int | None = None) -> np.ndarray:
    a = np.frombuffer(blob, np.int64)
    return a if dim is None else a.reshape(-1, dim)


def _padded(rows, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Points far from each other, the farthest from those before first."""
    if not len(sample):
        return sample
    chosen, away = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < most and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


#: ``rows`` and ``qrows`` hold (id, row number) pairs, ``best`` what a node's queries found in it.
NODE_SCHEMA = "node long, rows binary, vecs binary, qrows binary, qvecs binary, kth binary, worst long, qcenter array<double>, qradius double, center array<double>, radius double, best binary"


def _build(dim: int, k: int):
    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["id", "row"])
        rows, vecs, asks = part[["id", "row"]].to_numpy(np.int64), _padded(part["v"].tolist(), dim), part["ask"].to_numpy(bool)
        tree, qrows, qvecs = CoverTree(vecs), rows[asks], vecs[asks]
        best = Best(qrows, k)
        dual_search(CoverTree(qvecs), tree, rows, best)
        ball = lambda v: (c := v.mean(axis=0), float(np.sqrt(((v - c) ** 2).sum(axis=1)).max()))
        qcenter, qradius = ball(qvecs) if len(qvecs) else (np.zeros(dim), 0.0)
        center, radius = ball(vecs)
        kth = best.kth(np.arange(len(qrows)))
        return pd.DataFrame(
            [[part["node"].iloc[0], _pack(rows), _pack(vecs), _pack(qrows), _pack(qvecs), _pack(kth), int(kth.min()) if len(kth) else 0, qcenter.tolist(), qradius, center.tolist(), radius, _pack(best.found())]],
            columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")],
        )

    return build


def _pairs(balls: pd.DataFrame, dim: int):
    center = np.array(balls["center"].tolist()).reshape(-1, dim)
    radius, node, size = balls["radius"].to_numpy(), balls["node"].to_numpy(), np.sqrt((center**2).sum(axis=1))

    def pair(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for own, c, r, worst in zip(part["node"], part["qcenter"], part["qradius"], part["worst"]):
                c = np.array(c)
                top = center @ c + r * size + radius * (np.sqrt(c @ c) + r)
                near = node[(top * (1 + 1e-9 * np.sign(top)) + 1e-6 >= worst) & (node != own)]
                yield pd.DataFrame({"q": own, "d": near})

    return pair


def _batch(found: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in found.T], ["query_row", "query_id", "vec_id", "score"])


def _search(dim: int, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by d, a node's vectors before the query groups that ask it."""
        rows, tree = np.zeros((0, 2), np.int64), None
        for batch in batches:
            for kind, a, b, c in zip(*(batch.column(x).to_pylist() for x in ("kind", "a", "b", "c"))):
                if kind == 0:
                    rows, tree = _open(a, 2), CoverTree(_open(b, dim))
                    continue
                best = Best(_open(a, 2), k, floor=_open(c))
                dual_search(CoverTree(_open(b, dim)), tree, rows, best)
                yield _batch(best.found())

    return search


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("best").to_pylist():
            yield _batch(_open(blob, 4))


FOUND = "query_row long, query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, k: int, is_query: Column, vec_id: str = "vec_id", vector: str = "v") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query row's k best; ``vector`` holds integers."""
    rows = vectors.filter(F.col(vector).isNotNull())
    rows = rows.select(F.coalesce(F.col(vec_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("ask"))
    # stored with the numbers, so that all later stages agree on them
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    count, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dim = max(dim, 1)
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).select("v").toPandas()["v"]
    top = pivots(_padded(sample.tolist(), dim), PIVOTS)

    def nearest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            away = (top.astype(float) ** 2).sum(axis=1) - 2.0 * _padded(part["v"].tolist(), dim).astype(float) @ top.T
            yield part.assign(cell=away.argmin(axis=1) if len(part) else [])

    cells = cut_lineage(rows.mapInPandas(nearest, "id long, v array<bigint>, ask boolean, row long, cell long"), "cells")
    most = max(NODE, -(-count // MOST_NODES))
    parts, base = {}, 0
    for r in cells.groupBy("cell").count().collect():  # one row per pivot
        parts[r["cell"]] = (base, -(-r["count"] // most))
        base += parts[r["cell"]][1]
    first = F.coalesce(*[F.when(F.col("cell") == c, F.lit(b) + F.pmod(F.xxhash64("id", "row"), F.lit(n))) for c, (b, n) in sorted(parts.items())], F.lit(0)).cast("long")
    nodes = cells.select("id", "v", "ask", "row", first.alias("node")).groupBy("node").applyInPandas(_build(dim, k), NODE_SCHEMA)
    nodes = cut_lineage(nodes, "nodes")
    balls = nodes.select("node", "center", "radius").toPandas()  # MOST_NODES + PIVOTS rows at most
    asking = nodes.filter(F.length("qrows") > 0)
    pairs = asking.select("node", "qcenter", "qradius", "worst").mapInPandas(_pairs(balls, dim), "q long, d long")
    groups = asking.select(F.col("node").alias("q"), F.col("qrows").alias("a"), F.col("qvecs").alias("b"), F.col("kth").alias("c"))
    asked = pairs.join(groups, "q").select("d", F.lit(1).alias("kind"), "a", "b", "c")
    data = nodes.select(F.col("node").alias("d"), F.lit(0).alias("kind"), F.col("rows").alias("a"), F.col("vecs").alias("b"), F.lit(None).cast("binary").alias("c"))
    stream = data.union(asked).repartition("d").sortWithinPartitions("d", "kind")
    found = stream.mapInArrow(_search(dim, k), FOUND).union(nodes.select("best").mapInArrow(_unpack, FOUND))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    kept = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    named = {c: F.nullif(F.col(c), F.lit(NO_ID)) for c in ("query_id", "vec_id")}
    return kept.withColumns(named).select("query_id", "rank", "vec_id", "score")
