"""Near-duplicates by SimHash fingerprints, linked through BK-trees.

A text's fingerprint has a bit set where more than half of its word shingles' 64-bit hashes
have it. Two fingerprints are linked if they differ in at most ``radius`` bits, and documents
are classed by the connected components of these links.

Equal fingerprints are one node, so copies are never paired. Fingerprints are dealt to shards
so that every link lies within one: of ``BANDS`` bands of bits, ``radius`` differing bits leave
at least BANDS - radius untouched, so a shard is a choice of that many bands and their value.
In a shard, a BK-tree (children keyed by their Hamming distance to the parent) is searched
with every fingerprint, following only edges within the radius of the query's distance.
A shard above ``BLOCK`` fingerprints is cut into blocks and each pair of blocks is a task of
its own, one block as tree, the other as queries: nothing grows with a hot shard but the
number of tasks. Trees stay with their shards and are not broadcast as a whole, since all of
them together grow with the corpus. A search gives only links that join two groups it has not
joined yet, fewer than it has fingerprints.

Components come from alternating large-star and small-star steps, each stored in the shared
folder. Defined cases: a null text is as one without words, fingerprint zero; repeated rows
and equal texts share a class; a class is named by its smallest id (null if it has none but
null ids); an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_digest

from tinderframe.session import cut_lineage

BANDS = 6
BLOCK = 2048
SEED = 42


def simhash(text: bytes | None, width: int) -> bytes:
    """The fingerprint as 8 bytes, highest first."""
    words = (text or b"").lower().split()
    if not words:
        return bytes(8)
    line = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    width = min(width, len(words))
    cuts = list(zip(start[: len(words) - width + 1].tolist(), end[width - 1 :].tolist()))
    ones = np.zeros(64, np.int64)
    for a in range(0, len(cuts), 1 << 15):
        hashes = b"".join([xxh64_digest(line[s:e], SEED) for s, e in cuts[a : a + (1 << 15)]])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(cuts)).tobytes()


def fingerprint(text: Column, width: int = 4) -> Column:
    """SimHash of each text as a long (its bits; the sign is the highest)."""

    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.frombuffer(b"".join(simhash(t, width) for t in texts), ">i8").astype(np.int64), index=texts.index)

    hashed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(hashed, "long")(text.cast("binary"))


def band_masks(radius: int, bands: int) -> list[int]:
    """Masks of every choice of the bands that ``radius`` differing bits must leave alone."""
    if not 0 <= radius < bands:
        raise ValueError("more bands than differing bits are needed")
    edge = [64 * i // bands for i in range(bands + 1)]
    band = [(1 << b) - (1 << a) for a, b in zip(edge, edge[1:])]
    masks = [sum(c) for c in combinations(band, bands - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def bk_tree(points: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """Nodes as (index of the point, [(distance, node)]); the first node is the root. A
    subtree's root is its first point, as if the points had been inserted in order."""
    nodes: list = [None]
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, members = todo.pop()
        rest = members[1:]
        away = np.bitwise_count(points[rest] ^ points[members[0]])
        children = []
        for d in np.unique(away):
            children.append((int(d), len(nodes)))
            todo.append((len(nodes), rest[away == d]))
            nodes.append(None)
        nodes[at] = (int(members[0]), children)
    return nodes


def follow(points: np.ndarray, nodes: list, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(point, indices of the queries within the radius of it), all queries going down the
    tree together."""
    todo = [(0, np.arange(len(queries)))]
    while todo:
        at, active = todo.pop()
        point, children = nodes[at]
        away = np.bitwise_count(queries[active] ^ points[point]).astype(np.int16)
        near = active[away <= radius]
        if len(near):
            yield point, near
        for d, child in children:
            on = active[np.abs(away - d) <= radius]
            if len(on):
                todo.append((child, on))


def few_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """As ``shard_links`` for a handful of fingerprints: one BK-tree, grown while searching."""
    links, tree = [], {}
    for v in values:
        todo, spot = [tree] if tree else [], None
        while todo:
            node = todo.pop()
            d = (node["v"] ^ v).bit_count()
            if d <= radius:
                links.append((v, node["v"]))
            todo += [child for e, child in node["c"].items() if abs(e - d) <= radius]
        node = tree
        if not tree:
            tree |= {"v": v, "c": {}}
            continue
        while node is not None:
            spot, d = node, (node["v"] ^ v).bit_count()
            node = node["c"].get(d)
        spot["c"][d] = {"v": v, "c": {}}
    return links


def shard_links(tree_points: np.ndarray, queries: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between tree and query fingerprints that connect what they connect, fewer than
    there are fingerprints."""
    values, at = np.unique(np.concatenate([tree_points, queries]), return_inverse=True)
    of_tree, of_query = at[: len(tree_points)], at[len(tree_points) :]
    group = np.arange(len(values))
    links = []
    for point, near in follow(tree_points, bk_tree(tree_points), queries, radius):
        own, others = of_tree[point], of_query[near]
        found, first = np.unique(group[others], return_index=True)
        new = found != group[own]
        if new.any():
            links += [(values[own], values[o]) for o in others[first[new]]]
            group[np.isin(group, found)] = group[own]
    return links


def _search(radius: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by task; a task may go over the end of a batch."""
        held: pd.DataFrame | None = None

        def links(rows: pd.DataFrame) -> pa.RecordBatch:
            key = rows[["choice", "shard", "i", "j"]].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
            fp, block = rows["fp"].to_numpy().view(np.uint64), rows["block"].to_numpy()
            out: list = []
            for a, b in zip(starts, [*starts[1:], len(rows)]):
                if b - a <= 32 and key[a][2] == key[a][3]:
                    out += few_links(fp[a:b].tolist(), radius)
                else:
                    own = block[a:b] == key[a][2]
                    out += shard_links(fp[a:b][own], fp[a:b][~own] if key[a][2] != key[a][3] else fp[a:b], radius)
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            rows = batch.to_pandas()
            if held is not None:
                rows = pd.concat([held, rows], ignore_index=True)
            last = rows[["choice", "shard", "i", "j"]].to_numpy()
            tail = len(rows) - 1 - int((last[::-1] != last[-1]).any(axis=1).argmax()) if (last != last[-1]).any() else -1
            held = rows.iloc[tail + 1 :].reset_index(drop=True)
            if tail >= 0:
                yield links(rows.iloc[: tail + 1])
        if held is not None and len(held):
            yield links(held)

    return search


def near_links(prints: DataFrame, radius: int, bands: int = BANDS) -> DataFrame:
    """Links (a, b) that connect all fingerprints within the radius; ``prints`` has one row
    per distinct fingerprint in column fp."""
    choices = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("shard")) for i, m in enumerate(band_masks(radius, bands))])
    dealt = prints.select("fp", F.inline(choices))
    sizes = dealt.groupBy("choice", "shard").agg(F.count("*").alias("n")).filter("n > 1")
    shared = dealt.join(sizes, ["choice", "shard"])
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    shared = shared.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("fp"), blocks).cast("int")})
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "block").alias("i"), F.greatest(o, "block").alias("j")))
    tasks = shared.select("choice", "shard", "block", "fp", F.inline(others))
    tasks = tasks.repartition("choice", "shard", "i", "j").sortWithinPartitions("choice", "shard", "i", "j")
    return tasks.mapInArrow(_search(radius), "a long, b long")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every linked node but the roots, by large-star and small-star."""
    stars = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    stars = cut_lineage(stars, "links")
    before = None
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.least("w", F.min("v")).alias("m"))
        large = both.join(least, both["u"] == least["w"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut_lineage(large, "large-star")
        low = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        joined = large.join(low, large["u"] == low["w"])
        small = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()
        stars = cut_lineage(small, "small-star")
        now = stars.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, fp (fingerprint as a long), key (hash of the text),
    component_id, the smallest id of its class, and root, a fingerprint that tells classes
    apart where ids are null or shared."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), fingerprint(F.col(text), width).alias("fp"))
    own = cut_lineage(own, "fingerprints")
    prints = cut_lineage(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(near_links(prints.select("fp"), radius))
    linked = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = linked.join(prints, linked["node"] == prints["fp"]).select("node", "root", "first")
    names = linked.groupBy("root").agg(F.min("first").alias("name"))
    named = linked.join(names, "root").select("node", "root", "name")
    name = F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("name"))
    classes = prints.join(named, prints["fp"] == named["node"], "left").select(F.col("fp").alias("f"), name.alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return own.join(classes, own["fp"] == classes["f"]).select("doc_id", "key", "fp", "component_id", "root")
