"""Word n-gram language model: interpolated modified Kneser-Ney over word pairs.

    p(w | v) = (c(vw) - D(c(vw))) / c(v)  +  g(v) * p(w)
    p(w)     = (a(w) - E(a(w))) / A       +  g * 1 / (V + 1)

c counts pairs, a(w) is the number of different words seen before w, A its sum, V the number
of different tokens; D and E are the three discounts (for counts of 1, 2, and 3 or more) from
the counts of counts; g(v) and g hand on exactly what the discounts took. An unseen v leaves
p(w). A text is its words and one end token; the first word follows a begin mark, which is
never predicted itself.

Counting is a Spark job: map tasks count what is in a few million tokens and send sorted
arrays; pairs are dealt to shards by their first word, those of very frequent first words by
the whole pair, so no shard grows with one word. The number of shards follows the number of
tokens. A shard's task adds its arrays up and writes the model's file of sorted hashes and
counts into the shared folder (under a name of its own first, then renamed, so a lost or
doubled task leaves one whole file). Workers map the files into memory and look sorted batches
of hashes up; a page that no text needs is not read, and no worker holds the model.

The shared folder must be mounted on the workers under one path, as mapped files need it;
where a shard's file is missing, scoring fails instead of taking its counts as zero.
Words enter by 64-bit hashes; two words of one hash would count as one.

Defined cases: a null text is the empty one, which has its end token only; rows are scored one
by one, repeated ones too; without training rows every token has probability 1 (base and
model alike); an empty table gives an empty result.
"""

from __future__ import annotations

import mmap
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tinderframe.llm.common import mix, slices
from tinderframe.session import cut_lineage, stage_path

BEGIN, END = np.uint64(1), np.uint64(2)  # words hash to other values, but for 1 in 2**63
SHARD_TOKENS = 1 << 20  # training tokens per shard of pairs
HOT_WORD = 1 << 20  # first words above this many tokens are dealt by pair
FLUSH = 1 << 20  # tokens a map task counts before it sends
STEP_BYTES = 1 << 20

_P = 0x9E3779B97F4A7C15 | 1
_PAIR = np.uint64(0xD6E8FEB86659FD93)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z


@lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    up, down = np.full(size, _P, np.uint64), np.full(size, pow(_P, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def token_stream(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(before, token, row): each token's hash with the one before it, end tokens included.

    A word's hash is a polynomial in its bytes, read off running sums over the whole batch.
    """
    data = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    size = 1 << max(16, int(len(data) + 1).bit_length())
    up, down = _powers(size)
    blank = _BLANK[data]
    edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)  # the last byte is blank
    total = np.concatenate([[np.uint64(0)], np.cumsum(_VALUE[data] * up[: len(data)], dtype=np.uint64)])
    word = mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    row = np.searchsorted(ends, start, "right")
    counts = np.bincount(row, minlength=len(texts))
    place = np.arange(len(word)) + row
    token = np.full(len(word) + len(texts), END)
    token[place] = word
    rows = np.repeat(np.arange(len(texts)), counts + 1)
    before = np.concatenate([[BEGIN], token[:-1]])
    before[np.concatenate([[0], np.cumsum(counts + 1)[:-1]])] = BEGIN
    return before, token, rows


def pair_hash(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(before * _PAIR + token)


def shard_of(before: np.ndarray, pair: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    return np.where(np.isin(before, hot), pair, mix(before)) % np.uint64(shards)


def added(key: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the sums of their counts, and a place of each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(counts[order], first) if len(key) else counts, order[first]


def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(before, token) of about ``FLUSH`` tokens at a time."""
    held, size = [], 0
    for part in slices(batches, "text", STEP_BYTES):
        before, token, _ = token_stream(part.column("text").to_pylist())
        held.append((before, token))
        size += len(token)
        if size >= FLUSH:
            yield tuple(map(np.concatenate, zip(*held)))
            held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, token in streams(batches):
        word, n, _ = added(token, np.ones(len(token), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])


def _count_pairs(hot: np.ndarray, shards: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for before, token in streams(batches):
            pair, n, at = added(pair_hash(before, token), np.ones(len(token), np.uint32))
            before, token, n = before[at], token[at], n.astype(np.uint32)
            shard = shard_of(before, pair, hot, shards)
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(cut)):
                o = order[cut[s] : cut[s + 1]]
                blob = [pa.array([x[o].tobytes()], pa.binary()) for x in (before, token, n)]
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *blob], ["shard", "before", "token", "n"])

    return count


def write_arrays(folder: str, name: str, *arrays: np.ndarray) -> None:
    """One file of arrays of equal length, the length first; complete or absent."""
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}.{uuid.uuid4().hex}"
    with open(path, "wb") as f:
        f.write(np.array([len(arrays[0])], np.int64).tobytes())
        for a in arrays:
            f.write(np.ascontiguousarray(a).tobytes())
    os.replace(path, f"{folder}/{name}")


@lru_cache(4096)
def map_arrays(path: str, *kinds: str) -> tuple[np.ndarray, ...]:
    """The arrays of a file, mapped into memory. Every shard has a file, empty or not, so one
    that is missing is lost (or its folder not mounted here) and an error."""
    with open(path, "rb") as f:
        data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
    size, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for k in kinds:
        out.append(np.frombuffer(data, k, size, at))
        at += size * np.dtype(k).itemsize
    return tuple(out)


def _store_pairs(folder: str):
    def store(key: tuple, rows: pa.Table) -> pa.Table:
        whole = lambda c, kind: np.frombuffer(b"".join(rows.column(c).to_pylist()), kind)
        before, token, n = whole("before", np.uint64), whole("token", np.uint64), whole("n", np.uint32)
        pair, n, at = added(pair_hash(before, token), n)
        write_arrays(folder, f"pairs-{key[0].as_py()}", pair, n.astype(np.uint32))
        before, token = before[at], token[at]
        once = [np.bincount(np.minimum(n, 5), minlength=6)[k] for k in (1, 2, 3, 4)]
        v, ones, o = added(before, (n == 1).astype(np.int64))
        twos, more = added(before, (n == 2).astype(np.int64))[1], added(before, (n >= 3).astype(np.int64))[1]
        w, left, _ = added(token, np.ones(len(token), np.int64))
        none = lambda k: np.zeros(k, np.int64)
        return pa.table(
            {
                "word": pa.concat_arrays([pa.array(v.view(np.int64)), pa.array(w.view(np.int64)), pa.array([None], pa.int64())]),
                "n1": np.concatenate([ones, none(len(w)), [once[0]]]),
                "n2": np.concatenate([twos, none(len(w)), [once[1]]]),
                "n3": np.concatenate([more, none(len(w)), [once[2]]]),
                "a": np.concatenate([none(len(v)), left, [once[3]]]),
            }
        )

    return store


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more from the numbers of
    entries with counts 1 to 4; half a count where the numbers do not settle them."""
    if min(n[0], n[1]) == 0:
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 for k in (1, 2, 3)]
    return [min(max(d, 0.0), float(k)) for k, d in zip((1, 2, 3), raw)]


@dataclass(frozen=True)
class Model:
    """What every worker needs besides the files: 100 numbers or so, and the hot words."""

    folder: str
    shards: int
    word_shards: int
    tokens: int
    types: int
    left: int
    pair_discounts: list[float]
    word_discounts: list[float]
    word_rest: float
    hot: np.ndarray


def local_path(folder: str) -> str:
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError(f"the model's files are mapped into memory, so {folder} must be a mounted folder")
    return unquote(url.path)


def train(docs: DataFrame, text: str = "text") -> Model:
    """Counts ``docs`` and stores the model; returns its description."""
    spark = docs.sparkSession
    folder = local_path(stage_path(spark, "ngrams"))
    rows = docs.select(F.col(text).cast("binary").alias("text"))
    vocab = rows.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    vocab = cut_lineage(vocab, "vocabulary")
    end = F.col("word") == F.lit(int(END))
    total = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(end, F.col("n"))), F.lit(0))).first()
    tokens, types, texts = map(int, total)
    shards, word_shards = -(-tokens // SHARD_TOKENS) or 1, -(-types // SHARD_TOKENS) or 1
    often = vocab.filter((F.col("n") > HOT_WORD) & ~end).select("word").toPandas()  # tokens / HOT_WORD at most
    hot = often["word"].to_numpy(np.int64).view(np.uint64)
    if texts > HOT_WORD:
        hot = np.append(hot, BEGIN)
    pairs = rows.mapInArrow(_count_pairs(hot, shards), "shard int, before binary, token binary, n binary")
    nothing = F.lit(b"")  # a row for each shard, so that each has a file
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"), *[nothing.alias(c) for c in ("before", "token", "n")])
    stats = pairs.union(every).groupBy("shard").applyInArrow(_store_pairs(folder), "word long, n1 long, n2 long, n3 long, a long")
    sums = [F.sum(c).alias(c) for c in ("n1", "n2", "n3", "a")]
    stats = cut_lineage(stats.groupBy("word").agg(*sums), "pair-statistics")
    of_pairs = stats.filter("word is null").select("n1", "n2", "n3", "a").first()
    d = discounts(list(of_pairs)) if of_pairs else [0.5] * 3
    known = stats.filter("word is not null")
    by_left = {r["k"]: r["n"] for r in known.filter("a > 0").groupBy(F.least(F.col("a"), F.lit(5)).alias("k")).agg(F.count("*").alias("n")).collect()}
    e = discounts([by_left.get(k, 0) for k in (1, 2, 3, 4)])
    left = int(known.agg(F.coalesce(F.sum("a"), F.lit(0))).first()[0])
    taken = e[0] * by_left.get(1, 0) + e[1] * by_left.get(2, 0) + e[2] * sum(n for k, n in by_left.items() if k > 2)
    words = known.join(vocab, "word", "full")
    shard = F.pmod(F.shiftrightunsigned("word", 1), F.lit(word_shards)).cast("int")
    words = words.select(shard.alias("shard"), "word", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "n1", "n2", "n3", "a")])
    none = [F.lit(None).cast("long").alias(c) for c in words.columns[1:]]
    words = words.union(spark.range(word_shards).select(F.col("id").cast("int").alias("shard"), *none))
    words.groupBy("shard").applyInArrow(_store_words(folder, d, texts), "shard int, n long").agg(F.sum("n")).collect()
    return Model(folder, shards, word_shards, tokens, types, left, d, e, taken / left if left else 1.0, hot)


def _store_words(folder: str, d: list[float], texts: int):
    def store(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.filter(rows.column("word").is_valid())
        word = rows.column("word").to_numpy().view(np.uint64)
        order = np.argsort(word)
        n, n1, n2, n3, a = (rows.column(c).to_numpy()[order] for c in ("n", "n1", "n2", "n3", "a"))
        word = word[order]
        context = np.where(word == BEGIN, texts, np.where(word == END, 0, n))
        rest = (d[0] * n1 + d[1] * n2 + d[2] * n3) / np.maximum(context, 1)
        write_arrays(folder, f"words-{key[0].as_py()}", word, n, a, context, rest)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(word)], pa.int64())})

    return store


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def _grouped(shard: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the keys of each shard, in the order of the keys."""
    order = np.lexsort([key, shard])
    cut = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cut):
        if len(part):
            yield int(shard[part[0]]), part


def look_up(m: Model, before: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count of each token, log10 p(token | before))."""
    words, at = np.unique(np.concatenate([before, token]), return_inverse=True)
    n, a, context, rest = np.zeros(len(words)), np.zeros(len(words)), np.zeros(len(words)), np.ones(len(words))
    for s, part in _grouped((words >> np.uint64(1)) % np.uint64(m.word_shards), words):
        keys, *columns = map_arrays(f"{m.folder}/words-{s}", "<u8", "<i8", "<i8", "<i8", "<f8")
        place, hit = _find(keys, words[part])
        for out, column in zip((n, a, context, rest), columns):
            out[part[hit]] = column[place[hit]]
    rest[context == 0] = 1.0
    v, w = at[: len(before)], at[len(before) :]
    pairs, first, back = np.unique(pair_hash(before, token), return_index=True, return_inverse=True)
    c = np.zeros(len(pairs))
    for s, part in _grouped(shard_of(before[first], pairs, m.hot, m.shards), pairs):
        keys, counts = map_arrays(f"{m.folder}/pairs-{s}", "<u8", "<u4")
        place, hit = _find(keys, pairs[part])
        c[part[hit]] = counts[place[hit]]
    c = c[back]
    off = lambda x, d: np.maximum(x - np.array([0.0, *d])[np.minimum(x, 3).astype(int)], 0)
    single = off(a[w], m.word_discounts) / max(m.left, 1) + m.word_rest / (m.types + 1)
    p = off(c, m.pair_discounts) / np.maximum(context[v], 1) + rest[v] * single
    return n[w], np.log10(p)


def score_texts(docs: DataFrame, m: Model, text: str = "text") -> DataFrame:
    """Columns of ``docs`` other than the text plus n_tokens, n_known, base_score, score;
    input columns of those names are replaced."""
    others = [c for c in docs.columns if c not in (text, "n_tokens", "n_known", "base_score", "score")]
    names = [f"__{i}" for i in range(len(others))]
    rows = docs.select(*[F.col(c).alias(x) for c, x in zip(others, names)], F.col(text).cast("binary").alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.log10(m.tokens + 0.5 * (m.types + 1))
        for part in slices(batches, "text", STEP_BYTES):
            before, token, row = token_stream(part.column("text").to_pylist())
            count, p = look_up(m, before, token)
            add = lambda x: np.bincount(row, x, part.num_rows)
            size = np.bincount(row, minlength=part.num_rows)
            out = [pa.array(size), pa.array(add(count > 0).astype(np.int64)), pa.array(add(np.log10(count + 0.5)) - size * floor), pa.array(add(p))]
            yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), *out], [*names, "n_tokens", "n_known", "base_score", "score"])

    out = rows.mapInArrow(score, f"{kinds}, n_tokens long, n_known long, base_score double, score double")
    return out.select(*[F.col(x).alias(c) for c, x in zip(others, names)], "n_tokens", "n_known", "base_score", "score")


def perplexity(score: Column, n_tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -score / n_tokens)
