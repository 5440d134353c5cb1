"""Classes of texts whose sets of word shingles are similar (Jaccard), candidates checked exactly.

Candidates share a band of min-hashes: of ``BANDS`` bands of ``ROWS`` min-hashes each, a pair
at similarity 0.8 shares one with probability 0.99993, texts without common shingles none. In
a shard (the texts of one band value) the BK-tree of SimHash fingerprints is searched with
``RADIUS`` bits, five standard deviations above what a similarity of 0.8 leaves differing, and
each pair that would join two groups is checked on the whole shingle sets. Those lie in files in
the shared folder, of the texts that share a band only, and are read at the places wanted.

Shards above ``BLOCK`` texts are searched within blocks first. What that links in any band is
one component; then only texts outside a shard's largest component meet its other blocks, so a
hot group of near copies costs no pairs of blocks. Every candidate pair is either checked or
connected by checked pairs.

Defined cases: texts with equal shingle sets are one class, so are texts without words; a text
of fewer words than ``width`` is one shingle; a null id sorts last.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest, xxh64_digest

from tinderframe.llm.common import mix, slices
from tinderframe.llm.ngrams import local_path
from tinderframe.llm.simhash import SEED, bk_tree, components, follow
from tinderframe.session import cut_lineage, stage_path

BANDS, ROWS = 24, 5
RADIUS = 24
BLOCK = 1024
SEEDS = mix(np.arange(1, BANDS * ROWS + 1))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Hashes of the distinct word shingles, sorted."""
    words = (text or b"").lower().split()
    width = min(width, len(words))
    found = [xxh64_digest(b" ".join(words[i : i + width]), SEED) for i in range(len(words) - width + 1)] if words else []
    return np.unique(np.frombuffer(b"".join(found), ">u8").astype(np.uint64))


def print_of(own: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for a in range(0, len(own), 1 << 15):
        ones += np.unpackbits(own[a : a + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(own)).tobytes(), "big", signed=True)


def band_values(own: np.ndarray) -> list[int]:
    """One value per band, different bands' values apart; none without shingles."""
    if not len(own):
        return []
    least = np.full(len(SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(own), 1024):
        x = (own[None, a : a + 1024] ^ SEEDS[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        least = np.minimum(least, x.min(axis=1))
    return [xxh3_64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) - (1 << 63) for b in range(BANDS)]


def node_of(own: np.ndarray) -> int:
    return xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def _sign(width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = [shingles(t, width) for t in part.column("text").to_pylist()]
            new = [pa.array([f(s) for s in sets], kind) for f, kind in ((node_of, pa.int64()), (print_of, pa.int64()), (band_values, pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), *new], ["id", "key", "node", "fp", "bands"])

    return sign


def _store(width: int, folder: str):
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, at, seen = uuid.uuid4().int >> 65, 0, set()
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{name}", "wb") as f:
            for part in slices(batches, "text"):
                out = []
                for node, t in zip(part.column("node").to_pylist(), part.column("text").to_pylist()):
                    if node not in seen:
                        own = shingles(t, width)
                        f.write(own.tobytes())
                        out.append((node, name, at, len(own)))
                        at += len(own)
                        seen.add(node)
                f.flush()
                rows = np.array(out, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(4)], ["node", "file", "at", "size"])

    return store


@lru_cache(256)
def _opened(path: str):
    return open(path, "rb", buffering=0)


def _read(folder: str, file: int, at: int, size: int) -> np.ndarray:
    return np.frombuffer(os.pread(_opened(f"{folder}/{file}").fileno(), 8 * size, 8 * at), np.uint64)


def task_links(rows: pd.DataFrame, folder: str, least: float) -> list[tuple[int, int]]:
    """Checked links between the block's texts, or between them and the others' if there are any,
    that connect all its similar pairs."""
    fp, node, size, inner = rows["fp"].to_numpy().view(np.uint64), rows["node"].to_numpy(), rows["size"].to_numpy(), rows["inner"].to_numpy()
    place = rows[["file", "at", "size"]].to_numpy()
    _, group = np.unique(rows["comp"].to_numpy(), return_inverse=True)
    tree = np.flatnonzero(inner)
    asks = tree if inner.all() else np.flatnonzero(~inner)
    links = []
    near_by = follow(fp[tree], bk_tree(fp[tree]), fp[asks], RADIUS) if len(rows) > 16 else ((k, np.arange(len(asks))) for k in range(len(tree)))
    for k, near in near_by:
        p, others = tree[k], asks[near]
        fits = (group[others] != group[p]) & (np.minimum(size[others], size[p]) >= least * np.maximum(size[others], size[p]))
        others = others[fits & (others > p) if asks is tree else fits]
        if not len(others):
            continue
        own = _read(folder, *place[p].tolist())
        for o in others[np.argsort(np.bitwise_count(fp[others] ^ fp[p]), kind="stable")]:
            if group[o] != group[p]:
                other = _read(folder, *place[o].tolist())
                both = int((own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other).sum())
                if both >= least * (len(own) + len(other) - both):
                    links.append((int(node[p]), int(node[o])))
                    group[group == group[o]] = group[p]
    return links


def _search(folder: str, least: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by task; a task may go over the end of a batch."""
        held: pd.DataFrame | None = None

        def links(rows: pd.DataFrame) -> pa.RecordBatch:
            key = rows[["shard", "block"]].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])).tolist()
            out: list = []
            for a, b in zip(starts, [*starts[1:], len(rows)]):
                if b - a > 1:
                    out += task_links(rows.iloc[a:b], folder, least)
            pairs = np.array(out, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            rows = batch.to_pandas()
            if held is not None:
                rows = pd.concat([held, rows], ignore_index=True)
            key = rows[["shard", "block"]].to_numpy()
            tail = int((key != key[-1]).any(axis=1).nonzero()[0].max(initial=-1))
            held = rows.iloc[tail + 1 :].reset_index(drop=True)
            if tail >= 0:
                yield links(rows.iloc[: tail + 1])
        if held is not None and len(held):
            yield links(held)

    return search


def class_firsts(docs: DataFrame, width: int, least: float, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, key) of every class's first document: smallest id, then smallest hash of the text."""
    folder = local_path(stage_path(docs.sparkSession, "shingles"))
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    signed = rows.mapInArrow(_sign(width), f"id {kind}, key long, node long, fp long, bands array<long>")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "key")
    nodes = signed.groupBy("node").agg(F.min(place).alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = cut_lineage(nodes, "shingle-sets")

    dealt = nodes.select("node", F.explode("bands").alias("shard"))
    sizes = dealt.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1").withColumnRenamed("shard", "s")
    shared = cut_lineage(dealt.join(sizes, dealt["shard"] == sizes["s"]).select("node", "shard", "n"), "shared-bands")
    needed = nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "fp", F.col("first.id").alias("i"), F.col("first.key").alias("k"))
    texts = rows.join(needed, rows["id"].eqNullSafe(needed["i"]) & (rows["key"] == needed["k"])).select("node", "text")
    stored = texts.mapInArrow(_store(width, folder), "node long, file long, at long, size long")
    stored = stored.groupBy("node").agg(F.min(F.struct("file", "at", "size")).alias("p")).select("node", "p.*")
    stored = cut_lineage(stored.join(needed.select("node", "fp"), "node"), "stored-shingles")

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = shared.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", "shard"), F.col("blocks")).cast("int"))

    def links(tasks: DataFrame) -> DataFrame:
        whole = tasks.join(stored, "node").select("shard", "block", "node", "inner", "comp", "fp", "file", "at", "size")
        whole = whole.repartition("shard", "block").sortWithinPartitions("shard", "block")
        return cut_lineage(whole.mapInArrow(_search(folder, least), "a long, b long").distinct(), "similar-links")

    found = links(placed.select("node", "shard", "block", F.lit(True).alias("inner"), F.col("node").alias("comp")))
    roots = components(found)
    hot = placed.filter("blocks > 1")
    if not hot.isEmpty():
        hot = cut_lineage(hot.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root", "n"), "hot-bands")
        most = hot.groupBy("shard", "comp").agg(F.count("*").alias("c")).groupBy("shard").agg(F.max(F.struct("c", "comp")).alias("m"), F.count("*").alias("k"))
        most = most.filter("k > 1").select(F.col("shard").alias("s"), F.col("m.comp").alias("most"))
        hot = hot.join(most, hot["shard"] == most["s"])
        outer = hot.filter("comp != most").select("node", "shard", F.col("block").alias("own"), "comp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        outer = outer.filter("block != own").select("node", "shard", "block", F.lit(False).alias("inner"), "comp")
        # a task without outer texts would search its block again
        asked = outer.select("shard", "block").distinct()
        blocks_of = hot.select("node", "shard", "block", F.lit(True).alias("inner"), "comp").join(asked, ["shard", "block"], "left_semi")
        roots = components(found.union(links(blocks_of.unionByName(outer))))
    named = nodes.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("class")).agg(F.min("first").alias("first"))
    return named.select(F.col("first.id").alias("id"), F.col("first.key").alias("key"))
