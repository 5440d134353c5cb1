"""Pieces, prefix tree and vector codes against the library, plain versions and odd inputs."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tinderframe.llm import codes as CO, pieces as PI, prefixtree as PT, queries as Q

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"


# --- 11 pieces ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


ALPHABET = ["a", "b", "th", "in", " ", "  ", "   ", "▁", "\n", "\t", "é", "ﬁ", "😀", "漢", "字", "ing", "\0", "<s>", "<0x41>", "0", "=-", "...", "́", "the", "ABC", "'s"]


def test_encoding_and_decoding_equal_the_library(library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["", None, "a" * 50_000, " " * 20_001, "漢字" * 9_000]
    vocabulary = PI.opened(MODEL)
    ids, at = PI.encode_all(PI.Words(vocabulary), texts)
    for text, a, b in zip(texts, at, at[1:]):
        got = ids[a:b].tolist()
        assert got == library.encode(text or ""), text
        assert vocabulary.decode(got) == library.decode(got), text


def test_decoding_of_any_ids(library):
    rng = random.Random(6)
    pick = lambda: rng.choice([rng.randrange(32_000), rng.randrange(3, 259), rng.randrange(3), 28705, 259, 3 + 0xE2, 3 + 0x82, 3 + 0xAC])
    for _ in range(3000):
        ids = [pick() for _ in range(rng.randrange(12))]
        assert PI.opened(MODEL).decode(ids) == library.decode(ids)


def test_backtracking_leaves_dead_ends():
    """Greedy longest matches alone would be wrong for some words."""
    v = PI.opened(MODEL)
    rng, behind = random.Random(1), 0
    for _ in range(3000):
        word = "▁" + "".join(rng.choice("aeinorst") for _ in range(12))
        greedy, at, longest = [], 0, v.longest(word)
        while at < len(word):
            greedy.append(longest[at])
            at += len(longest[at])
        assert v.split(word) == v.merge(word)
        behind += v.split(word) != greedy
    assert behind > 100


def test_pieces_of_odd_rows(spark, library):
    long = " ".join(f"word{i % 97}. Other {i}" for i in range(20_000))
    rows = [(1, "Same text", 1), (1, "Same text", 1), (2, None, 2), (None, "no id", 3), (3, "", None), (4, " \n\t ", 5), (5, long, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").withColumn("decoded", F.lit(1)).withColumn("__x", F.lit(2))
    got = PI.encode(docs, MODEL)
    assert got.columns == ["doc_id", "text", "__x", "ids", "decoded"]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        want = library.encode(r["text"] or "")
        assert r["ids"] == want and r["decoded"] == library.decode(want)
    assert PI.encode(docs.filter("false"), MODEL).count() == 0
    assert PI.encode(docs.select(F.col("text").alias("body")), MODEL, "body").count() == len(rows)


def test_unfit_models_are_refused():
    with pytest.raises(Exception):
        PI.Pieces(public_tokenizers.path("byte_bpe_50k.json"))


def test_registered_pieces(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = Q.op11_pieces(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


# --- 12 prefix tree -------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def plain_tree(rows):
    """conv_id, depth, parent's conv_id, members, children, leaves, saved words, ends."""
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            key = hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
            turns.setdefault(c, []).append((turn is not None, turn or 0, key, (role or "", text or "")))
    turns = {c: [t[-1] for t in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    members = {}
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    kids = {p: [] for p in members}
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        words = len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", p[-1][1])]) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * words
        ends = ",".join(str(c) for c in sorted(members[p]) if len(rebuilt[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def spark_tree(spark, tmp_path, rows, limit, monkeypatch, schema=TURNS):
    monkeypatch.setattr(PT.prefix_tree, "__defaults__", (limit,))
    path = str(tmp_path / f"t{limit}")
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/conversations.parquet")
    out = Q.op12_prefix_tree(spark, path)
    assert [t for _, t in out.dtypes] == ["bigint"] * 7 + ["string"]
    return sorted([tuple(r) for r in out.collect()], key=str)


@pytest.mark.parametrize("limit", [1000, 6, 1])
def test_prefix_tree_equals_a_plain_one(spark, tmp_path, monkeypatch, limit):
    rng = random.Random(limit)
    rows = []
    for c in range(120):
        hot = c % 3 == 0  # a third of the conversations are equal
        for turn in range(4 if hot else rng.randrange(1, 7)):
            rows.append((c, turn, "user" if turn % 2 else "system", "same words here" if hot else rng.choice(["a b", "a  b c", "c"])))
    monkeypatch.setattr(PT, "PIECE", 7)
    assert spark_tree(spark, tmp_path, rows, limit, monkeypatch) == plain_tree(rows)


@pytest.mark.parametrize("limit", [100, 1])
def test_prefix_tree_of_odd_rows(spark, tmp_path, monkeypatch, limit):
    rows = [(40, None, "user", "first"), (40, 1, None, "x"), (40, 1, None, "x"), (40, 1, "user", None), (40, 2, None, None), (None, 1, "user", "no id")]
    rows += [(41, 5, "user", ""), (45, 0, "user", "long " * 20_000), (-3, 0, "user", "first"), (0, 0, "ab", "c"), (1, 0, "a", "bc"), (2, 0, "user", " \n "), (60, 3, "", "")]
    assert spark_tree(spark, tmp_path, rows, limit, monkeypatch) == plain_tree(rows)
    assert spark_tree(spark, tmp_path / "none", rows[5:6], limit, monkeypatch) == []


def test_extra_columns_do_not_matter(spark):
    rows = [(1, 0, "user", "hi you", 3, 4)]
    turns = spark.createDataFrame(rows, TURNS + ", key int, path int")
    paths = PT.follow_template(PT.turn_records(turns), F.col("conv_id"), F.lit(0), 3)
    assert sorted((r["depth"], r["n_convs"]) for r in PT.prefix_tree(paths).collect()) == [(0, 1), (1, 1)]


# --- 13 codes -------------------------------------------------------------------------------


def plain_codes(rows, parts, entries, rounds):
    """Rows of (id, vector of integers) -> codes, errors, codebooks; everything in Python."""
    length = -(-max((len(v) for _, v in rows), default=0) // parts) * parts or parts
    rows = [(i, [*v, *[0] * (length - len(v))]) for i, v in rows]
    width = length // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min((dist(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        groups = [[[] for _ in b] for b in books]
        for _, v in rows:
            for p in range(parts):
                groups[p][near(v, p)[1]].append(cut(v, p))
        books = [[[sum(c) // len(g) for c in zip(*g)] if g else e for g, e in zip(groups[p], books[p])] for p in range(parts)]
    out = [(i, [near(v, p)[1] for p in range(parts)], sum(near(v, p)[0] for p in range(parts))) for i, v in rows]
    return sorted(out, key=str), books


@pytest.mark.parametrize("spread,n,entries", [(3, 300, 64), (400, 300, 40), (1, 60, 64), (2**40, 80, 30)])
def test_codes_equal_plain_ones(spark, spread, n, entries):
    """Few different values make ties and equal entries, large ones leave 64 bits' squares."""
    rng = random.Random(spread)
    if spread == 2**40:  # near each other, so that distances fit a long
        rows = [(i, [spread + rng.randrange(-5000, 5000) for _ in range(8)]) for i in range(n)]
    else:
        rows = [(i, [rng.randrange(-spread, spread + 1) for _ in range(8)]) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(5)
    out, books = CO.encode(df, "v", "vec_id", parts=2, entries=entries, rounds=2)
    want, plain = plain_codes(rows, 2, entries, 2)
    assert books.books.tolist() == plain
    assert sorted([(r["vec_id"], r["code"], r["error"]) for r in out.collect()], key=str) == want


def test_whole_subtrees_go():
    rng = np.random.default_rng(0)
    centres = rng.integers(-5000, 5000, (8, 4))
    points = np.concatenate([c + rng.integers(-40, 40, (8, 4)) for c in centres])
    tree, seen = CO.Gnat(points), []
    plain = CO.squares(points, points)
    real = CO.squares
    try:
        CO.squares = lambda a, b: seen.append(len(a) * len(b)) or real(a, b)
        index, best = tree.nearest(points + 3)
    finally:
        CO.squares = real
    assert (best == real(points + 3, points).min(axis=1)).all()
    assert (index == real(points + 3, points).argmin(axis=1)).all()
    assert sum(seen) < 0.5 * plain.size


def test_codes_of_odd_rows(spark):
    rows = [(1, [1, 2, 3, 4], 0), (1, [1, 2, 3, 4], 0), (None, [5, 5, 5, 5], 1), (2, None, 1), (3, [7], None), (4, [], None), (1, [0, 0, 9, 9], 2)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>, error int").withColumns({"code": F.lit(1), "entry": F.lit(2), "__x": F.lit(3)})
    out, books = CO.encode(df, "v", "vec_id", parts=2, entries=3, rounds=2)
    assert out.columns == ["vec_id", "entry", "__x", "code", "error"]
    want, plain = plain_codes([(i, v) for i, v, _ in rows if v is not None], 2, 3, 2)
    assert books.books.tolist() == plain
    assert sorted([(r["vec_id"], r["code"], r["error"]) for r in out.collect()], key=str) == want
    none, books = CO.encode(df.filter("false"), "v", "vec_id")
    assert none.count() == 0 and books.text() == ""
    bad = spark.createDataFrame([([1.0, None],), ([float("nan")],), ([float("inf")],), (None,), ([-0.001],)], "e array<float>")
    assert [r[0] for r in bad.select(CO.finite(F.col("e"))).collect()] == [False, False, False, False, True]
