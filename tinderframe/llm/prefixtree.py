"""Prefix tree of conversations by burst tries.

A turn is a record of 20 bytes: the MD5 of its role and text, and its number of words. A
conversation is the path of its records, and a node of the tree is a distinct beginning of
paths. Equal conversations are counted first and go on as one row, so a conversation that a
third of the table repeats weighs no more than another. Containers hold all paths with one
beginning (their head). A container of more than ``LIMIT`` distinct paths bursts: its paths
move to containers one turn longer, told apart by the id of the next turn, and its head becomes
a node of the trie above them. Bursting goes on until no container is too large. Then Spark
spreads the containers over partitions and sorts each by path, and one sweep over the sorted
paths builds the nodes below a head, with at most ``LIMIT`` paths in memory. What the nodes
above need is summed from the containers' tops.

Sizes: all containers of one level burst in one job, and only paths that still lie in a
container too large are written again. Heads are at most (distinct paths / ``LIMIT``) a level
and are broadcast only behind a count. The members that end at a node are hashed as one text in
the order of their ids; a range sort cuts them into pieces of text, and a second sort feeds the
pieces of a path to its hash one after the other, so memory does not grow with the group.

Defined cases: rows with a null conversation id take no part; null role or text is the empty
one; turns are ordered by number, null first, equal numbers by the MD5 of role and text, and
repeated rows are turns of their own; all turn records of one conversation (20 bytes each) must
fit a row; extra columns are not looked at; no conversation, no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tinderframe.llm.common import SPACED
from tinderframe.session import cut_lineage

RECORD = 20
#: Distinct paths above which a container bursts.
LIMIT = 20_000
#: Heads up to which they are sent to every task; a row is about 60 bytes and its path.
BROADCAST_HEADS = 100_000
#: Members of a path whose ids are joined into one piece of text.
PIECE = 50_000
NOBODY = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """MD5 of role and text as hex digits, the border between them kept."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def turn_records(turns: DataFrame) -> DataFrame:
    """(conv_id, turns: array of records as hex digits) in the order of the turns."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SPACED))
    record = F.concat(turn_id(F.col("role"), F.col("text")), F.lpad(F.hex(n), 8, "0"))
    rows = turns.filter("conv_id is not null").select("conv_id", F.struct("turn", F.lower(record).alias("record")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t"))["record"].alias("turns"))


def begin(path: Column, depth) -> Column:
    return F.substring(path, F.lit(1), F.lit(depth).cast("int") * RECORD)


def node_key(prefix: Column) -> Column:
    return F.unhex(F.md5(prefix))


def ancestors(prefix: Column, depth: Column, upto: int) -> Column:
    """Keys of the beginnings of a path with 0 to ``depth - 1 + upto`` turns."""
    last = depth - 1 + upto
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda d: F.unhex(F.md5(F.substring(prefix, F.lit(1), d * RECORD))))).otherwise(F.array().cast("array<binary>"))


# --- equal conversations ----------------------------------------------------------------------


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a key in ascending order, joined in pieces."""
    key, ids = None, []

    def piece():
        return pa.RecordBatch.from_pylist([{"key": key, "first": ids[0], "ids": ",".join(map(str, ids))}], _PIECES)

    for batch in batches:
        for k, i in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if ids and (k != key or len(ids) >= PIECE):
                yield piece()
                ids = []
            key = k
            ids.append(i)
    if ids:
        yield piece()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a key one after the other through one SHA-256."""
    key, sha = None, None

    def done():
        return pa.RecordBatch.from_pylist([{"key": key, "ends_sha256": sha.hexdigest()}], _HASHES)

    for batch in batches:
        out = []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if k != key:
                if sha is not None:
                    out.append({"key": key, "ends_sha256": sha.hexdigest()})
                key, sha = k, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_pylist(out, _HASHES)
    if sha is not None:
        yield done()


_PIECES = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
_HASHES = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])


def distinct_paths(paths: DataFrame) -> DataFrame:
    """(key, path, n, first, ends_sha256): every different path with its members."""
    keyed = paths.select(node_key(F.col("path")).alias("key"), "conv_id", "path")
    counted = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"), F.first("path").alias("path"))
    counted = cut_lineage(counted, "paths")
    # a path with one member needs no sorting
    alone = counted.filter("n = 1").withColumn("ends_sha256", F.sha2(F.col("first").cast("string"), 256))
    shared = counted.filter("n > 1")
    members = keyed.select("key", "conv_id").join(shared.select("key"), "key")
    pieces = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_pieces, "key binary, first long, ids string")
    hashes = pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashes, "key binary, ends_sha256 string")
    return alone.unionByName(shared.join(hashes, "key"))


# --- bursting ---------------------------------------------------------------------------------


def burst(paths: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(containers, heads, enders).

    containers: key, depth and the columns of ``paths``; heads: key, prefix, depth of the
    containers that burst; enders: paths that end at a head, with the head's key and depth.
    """
    active, depth = paths.withColumn("key", node_key(begin(F.col("path"), 0))), 0
    settled, heads, enders = [], [], []
    while True:
        sizes = active.groupBy("key").agg(F.count("*").alias("size"), F.first(begin(F.col("path"), depth)).alias("prefix"))
        large = cut_lineage(sizes.filter(F.col("size") > limit).select("key", "prefix", F.lit(depth).alias("depth")), "heads")
        n = large.count()
        if not n:
            settled.append(active.withColumn("depth", F.lit(depth)))
            break
        mark = large.select("key", F.lit(True).alias("large"))
        marked = active.join(F.broadcast(mark) if n <= BROADCAST_HEADS else mark, "key", "left")
        marked = cut_lineage(marked.withColumn("large", F.coalesce("large", F.lit(False))), "burst")
        settled.append(marked.filter("not large").drop("large").withColumn("depth", F.lit(depth)))
        heads.append(large)
        ends = F.length("path") == depth * RECORD
        enders.append(marked.filter(F.col("large") & ends).drop("large").withColumn("depth", F.lit(depth)))
        depth += 1
        active = marked.filter(F.col("large") & ~ends).drop("large").withColumn("key", node_key(begin(F.col("path"), depth)))
    together = lambda parts: None if not parts else parts[0] if len(parts) == 1 else together([parts[0].unionByName(parts[1]), *parts[2:]])
    return together(settled), together(heads), together(enders)


# --- sweeping ---------------------------------------------------------------------------------

NODE = "key binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, prefix binary"
_NODE = pa.schema(
    [("key", pa.binary()), ("parent", pa.binary())]
    + [(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string()), ("prefix", pa.binary())]
)


class _Open:
    """A node whose subtree is still being read."""

    __slots__ = ("depth", "first", "n", "leaves", "saved", "ends", "children")

    def __init__(self, depth: int):
        self.depth, self.first, self.n, self.leaves, self.saved, self.ends = depth, None, 0, 0, 0, NOBODY
        self.children: list[dict] = []

    def close(self, path: bytes) -> tuple[dict, list[dict]]:
        """Its row, and its children's rows, which now know their parent."""
        words = int.from_bytes(path[self.depth * RECORD - 4 : self.depth * RECORD]) if self.depth else 0
        prefix = path[: self.depth * RECORD]
        key = hashlib.md5(prefix).digest()
        row = dict(key=key, parent=hashlib.md5(prefix[:-RECORD]).digest() if self.depth else None, conv_id=self.first, depth=self.depth, parent_conv_id=None,
                   n_convs=self.n, n_children=len(self.children), n_leaves=self.leaves + (not self.children),
                   saved_tokens=self.saved + (self.n - 1) * words, ends_sha256=self.ends, prefix=None)
        for child in self.children:
            child["parent_conv_id"] = self.first
        return row, self.children

    def take(self, child: dict) -> None:
        self.children.append(child)
        self.first = child["conv_id"] if self.first is None else min(self.first, child["conv_id"])
        self.n += child["n_convs"]
        self.leaves += child["n_leaves"]
        self.saved += child["saved_tokens"]


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers sorted by path -> their nodes. A top carries its prefix; its parent, a head
    of the trie, is filled in later."""
    container, path, stack, out = None, b"", [], []

    def close(depth: int) -> None:
        """Close all open nodes deeper than ``depth``."""
        while stack and stack[-1].depth > depth:
            row, children = stack.pop().close(path)
            out.extend(children)
            if stack:
                stack[-1].take(row)
            else:
                row["prefix"] = path[: row["depth"] * RECORD]
                out.append(row)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "depth", "path", "n", "first", "ends_sha256")]
        for key, top, new, n, first, ends in zip(*columns):
            if key != container:
                close(-1)
                container, same = key, top
                stack.append(_Open(top))
            else:
                same, most = top, min(len(path), len(new)) // RECORD
                while same < most and path[same * RECORD : (same + 1) * RECORD] == new[same * RECORD : (same + 1) * RECORD]:
                    same += 1
                close(same)
            path = new
            stack += [_Open(d) for d in range(same + 1, len(new) // RECORD + 1)]
            end = stack[-1]  # paths are distinct: this one ends here
            end.n, end.ends, end.first = end.n + n, ends, first if end.first is None else min(end.first, first)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_pylist(out, _NODE)
                out.clear()
    close(-1)
    if out:
        yield pa.RecordBatch.from_pylist(out, _NODE)


def prefix_tree(paths: DataFrame, limit: int = LIMIT) -> DataFrame:
    """All nodes of the paths (conv_id, path: binary records) with

    key, parent: ids of the node and of its parent (null above the root); conv_id: smallest
    member; depth; parent_conv_id; n_convs; n_children; n_leaves; saved_tokens: words of turns
    that need not be stored again, over the subtree; ends_sha256: hash of the members that end
    here, joined by commas.
    """
    containers, heads, enders = burst(distinct_paths(paths), limit)
    sorted_rows = containers.select("key", "depth", "path", "n", "first", "ends_sha256").repartition("key").sortWithinPartitions("key", "path")
    nodes = sorted_rows.mapInArrow(sweep, NODE)
    if heads is None:
        return nodes.drop("prefix")
    nodes = cut_lineage(nodes, "nodes")
    tops = nodes.filter("prefix is not null")
    # what every head holds: the tops below it, and the paths that end at it or below
    from_tops = tops.select(
        F.posexplode(ancestors(F.col("prefix"), F.col("depth"), 0)).alias("at", "head"),
        "conv_id", "n_convs", "n_leaves", "saved_tokens", "depth", F.lit(NOBODY).alias("ends"),
    )
    from_enders = enders.select(
        F.posexplode(ancestors(F.col("path"), F.col("depth"), 1)).alias("at", "head"),
        F.col("first").alias("conv_id"), F.col("n").alias("n_convs"), F.lit(0).alias("n_leaves"), F.lit(0).alias("saved_tokens"), "depth", F.col("ends_sha256").alias("ends"),
    )
    below = F.col("at") == F.col("depth") - 1
    ended = F.col("at") == F.col("depth")
    sums = from_tops.unionByName(from_enders).groupBy("head").agg(
        F.min("conv_id").alias("first"), F.sum("n_convs").alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"),
        F.count_if(below & (F.col("ends") == NOBODY)).alias("tops"), F.coalesce(F.max(F.when(ended, F.col("ends"))), F.lit(NOBODY)).alias("ends"),
    )
    words = F.when(F.col("depth") > 0, F.conv(F.hex(F.substring(F.col("prefix"), F.col("depth") * RECORD - 3, F.lit(4))), 16, 10).cast("long")).otherwise(0)
    known = cut_lineage(heads.join(sums, heads["key"] == sums["head"]).drop("head").withColumn("own", (F.col("n") - 1) * words), "head-sums")
    own = known.select(F.posexplode(ancestors(F.col("prefix"), F.col("depth"), 1)).alias("at", "head"), "own", "depth")
    own = own.groupBy("head").agg(F.sum("own").alias("own_below"), F.count_if(F.col("at") == F.col("depth") - 1).alias("heads"))
    parent = F.when(F.col("depth") > 0, node_key(begin(F.col("prefix"), F.col("depth") - 1)))
    full = known.join(own, known["key"] == own["head"]).select(
        "key", parent.alias("parent"), F.col("first").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("n").alias("n_convs"),
        (F.col("tops") + F.col("heads")).alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("below") + F.col("own_below")).alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )
    firsts = known.select(F.col("key").alias("p"), F.col("first").alias("parent_conv_id"))
    firsts = F.broadcast(firsts) if known.count() <= BROADCAST_HEADS else firsts
    upper = full.unionByName(tops.drop("prefix", "parent_conv_id"))
    upper = upper.join(firsts, upper["parent"] == firsts["p"], "left").drop("p")
    return nodes.filter("prefix is null").drop("prefix").unionByName(upper)


def follow_template(convs: DataFrame, base: Column, shared: Column, most: int) -> DataFrame:
    """(conv_id, path): the first ``shared`` turns of conversation ``base`` (all it has if
    fewer), then a conversation's own turns after as many. ``most`` bounds ``shared``."""
    heads = convs.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    joined = convs.withColumns({"h": shared, "b": base}).join(heads, F.col("b") == F.col("base"), "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h").cast("int"))
    rest = F.slice("turns", F.col("h").cast("int") + 1, F.greatest(F.lit(0), F.size("turns")))
    return joined.select("conv_id", F.unhex(F.array_join(F.concat(head, rest), "")).alias("path"))
