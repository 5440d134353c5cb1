"""Text operators: brute-force versions, planted cases and odd inputs."""

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tinderframe.llm import decontaminate as D, licences as LI, mixing as MI, ngrams as N, simhash as SH, spans as SP, tokencount as TC, topk as TK, toxicity as TX, urls as U
from tinderframe.llm.common import LETTERS, ascii_lower, words

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty and long texts, repeated rows, clashing extra columns.
LONG = " ".join(f"word{i % 97}. Other {i}" for i in range(20_000))
ODD = [
    (1, "Alpha beta gamma. Delta epsilon zeta eta.", "en", "a", 41),
    (1, "Alpha beta gamma. Delta epsilon zeta eta.", "en", "a", 41),
    (2, None, None, None, None),
    (None, "no id here at all, but words", "en", "b", 3),
    (3, "", "en", "b", 0),
    (4, " \n\t ", "en", None, 4),
    (5, LONG, "en", "a", len(LONG)),
    (5, "another text of the same id", "en", "a", 5),
]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ODD, DOC)
    return docs.withColumns({c: F.lit(7) for c in ("score", "fp", "size", "rule", "pos", "term", "n", "word", "key", "__x")})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


# --- 1 URL filters --------------------------------------------------------------------------

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("block", "", "/ads/"), ("allow", "x.org", "/a*/b/"), ("block", "x.org", "/a")]
URLS = ["http://www.EXAMPLE.com/en/1", "https://notexample.com/en/", "http://example.com", "http://q.net/ads/1?x", "http://y.x.org/abc/b/", "http://x.org/a#b", "x.org/a", "", None, "http://x.org/a"]


def test_urls_match_a_plain_search(spark):
    import re

    df = spark.createDataFrame([(i, u, 5) for i, u in enumerate(URLS)], "page_id long, url string, rule int")
    got = {r["page_id"]: r for r in U.filter_urls(df, RULES).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = []
        for action, h, p in RULES:
            own = (not h or host == h or host.endswith("." + h)) and re.match(".*".join(map(re.escape, p.split("*"))), path)
            if own:
                fits.append((-len(h + p), h + p, action))
        want = (min(fits)[1], min(fits)[2]) if fits else (None, "allow")
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, *want), u


def test_url_rules_are_filed_under_the_rarest_bounded_token(spark, empty):
    assert U.rule_tokens(("block", "a.b.com", "/en/x*y/zz")) == {"a", "b", "com", "en"}
    index = U.index_rules([("block", "b.com", "/en/")], {"com": 9, "b": 3, "en": 5})
    assert list(index) == ["b"]
    many = U.filter_urls(spark.createDataFrame([("http://a.com/x",)], "url string"), RULES, "url")
    assert many.first()["rule"] == "com/"
    assert U.filter_urls(empty.withColumn("url", F.lit("")), RULES).count() == 0
    assert U.filter_urls(spark.createDataFrame([("http://a.com/",)], "url string"), []).first()["verdict"] == "allow"


# --- 2 toxicity -----------------------------------------------------------------------------


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("one two three four five six seven".split()) for _ in range(40)) for _ in range(900)]
    toxic = [i % 5 == 0 for i in range(900)]
    texts = [t.replace("three", rng.choice(["awful", "Horrid!"]), 2) if x else t for t, x in zip(texts, toxic)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(x)) for i, x in enumerate(toxic) if i % 3], "doc_id long, toxic int")
    s = TX.Settings(bits=16)
    model = TX.train(docs, labels, s)
    assert 0 < len(model) < 2000
    got = {r["doc_id"]: r["p"] for r in docs.filter("doc_id % 3 = 0").withColumn("p", TX.score(F.col("text"), model, s)).collect()}
    right = sum((got[i] >= 0.7) == toxic[i] for i in got)
    assert right >= 0.98 * len(got)


def test_the_fit_is_bounded_by_rows_not_ids(spark):
    """3,000 texts under one labelled id: the single task gets ``max_rows`` of them."""
    docs = spark.createDataFrame([(i if i < 60 else 7, f"text number {i} {'bad' if i % 2 else 'good'}") for i in range(3060)] + [(8, "copy")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    seen, fit = spark.sparkContext.accumulator(0), TX._fit
    try:
        TX._fit = lambda s: lambda rows: (seen.add(len(rows)), fit(s)(rows))[1]
        TX.train(docs, labels, TX.Settings(bits=12, max_rows=50))
    finally:
        TX._fit = fit
    assert 0 < seen.value <= 50


def test_calibration_of_separable_sums_stays_finite():
    for scale in (1e-6, 1.0, 500.0):
        raw = np.concatenate([np.full(50, -1.0), np.full(5, 1.0)]) * scale
        a, b = TX.calibration(raw, (raw > 0).astype(int))
        p = 1 / (1 + np.exp(-(a * raw + b)))
        assert (p[:50] < 0.2).all() and (p[50:] > 0.7).all()


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    model = TX.train(odd, labels)
    got = odd.withColumn("p", TX.score(F.col("text"), model)).collect()
    assert len(got) == len(ODD) and all(0 <= r["p"] <= 1 for r in got)
    assert len({r["p"] for r in got if not (r["text"] or "").strip()}) == 1
    none = TX.train(odd, labels.filter("false"))
    assert {r["p"] for r in odd.select(TX.score(F.col("text"), none).alias("p")).collect()} == {0.5}
    assert empty.select(TX.score(F.col("text"), model)).count() == 0


def test_stems_have_a_bucket_for_each_number_of_occurrences_they_reach():
    texts = [b"walking walkings Walkin' walking it", b"", None, b"walked", b"it it walki"]
    row, bucket = TX.features(texts, 20)
    words, _ = TX.features([b"walking"], 20)
    assert len(words) == 2  # the word and its stem, once each

    def of(i):
        return set(bucket[row == i].tolist())

    def stem(word, level):
        return int(TX.mix(np.array([zlib.crc32(word[: TX.STEM]) + (level << 44)], dtype=np.uint64))[0] >> np.uint64(44))

    for i, t in enumerate(texts):
        found = TX.WORD.findall((t or b"").lower())
        times = {w: sum(v[: TX.STEM] == w for v in found) for w in {b"walkin", b"walked", b"it", b"walki"}}
        for w, n in times.items():
            for level in TX.LEVELS:
                assert (stem(w, level) in of(i)) == (n >= level), (i, w, level)


def test_ftrl_equals_a_plain_one():
    s = TX.Settings(bits=6, l1=0.3, alpha=0.4, l2=0.05)
    rng, model, size = np.random.default_rng(5), TX.Ftrl(s), 1 << 6
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(i):
        l1 = 0.0 if i == size else s.l1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    for _ in range(400):
        at = [*sorted(rng.choice(size, 5, replace=False).tolist()), size]
        label = int(at[0] < 6)
        g = 1 / (1 + math.exp(-sum(weight(i) for i in at))) - label
        for i, w in [(i, weight(i)) for i in at]:
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha * w
            n[i] += g * g
        model.learn(np.array(at), label)
    want = [weight(i) for i in range(size + 1)]
    assert 0 < sum(w != 0 for w in want) <= size
    np.testing.assert_allclose(model.weights(slice(None)), want, atol=1e-9)


# --- 3 language model -----------------------------------------------------------------------


def kneser_ney(train, texts):
    c, b = Counter(), Counter()
    for w in train:
        line = ["<s>", *w, "</s>"]
        c.update(line[1:])
        b.update(zip(line, line[1:]))
    total, types = sum(c.values()), len(c)
    context = c | {"<s>": len(train)}
    a, kinds = Counter(y for _, y in b), defaultdict(lambda: [0, 0, 0])
    for (x, _), k in b.items():
        kinds[x][min(k, 3) - 1] += 1
    d = [0, *N.discounts([sum(v == k for v in b.values()) for k in (1, 2, 3, 4)])]
    e = [0, *N.discounts([sum(v == k for v in a.values()) for k in (1, 2, 3, 4)])]
    rest = sum(e[min(v, 3)] for v in a.values()) / sum(a.values())
    out = []
    for w in texts:
        line, s, base = ["<s>", *w, "</s>"], 0.0, 0.0
        for x, y in zip(line, line[1:]):
            p = (a[y] - e[min(a[y], 3)]) / sum(a.values()) + rest / (types + 1)
            if context.get(x, 0) and x != "</s>":
                p = (b[x, y] - d[min(b[x, y], 3)]) / context[x] + sum(d[i + 1] * kinds[x][i] for i in range(3)) / context[x] * p
            s, base = s + math.log10(p), base + math.log10((c[y] + 0.5) / (total + 0.5 * (types + 1)))
        out.append((len(line) - 1, sum(c[y] > 0 for y in line[1:]), base, s))
    return out


@pytest.mark.parametrize("hot", [1 << 20, 50])
def test_language_model_equals_a_plain_one(spark, monkeypatch, hot):
    monkeypatch.setattr(N, "HOT_WORD", hot)
    monkeypatch.setattr(N, "SHARD_TOKENS", 500)
    rng = random.Random(1)
    texts = [" ".join(rng.choice("the The of and ä big small x y".split()) for _ in range(rng.randrange(0, 30))) for _ in range(200)]
    docs = spark.createDataFrame([*enumerate(texts), (999, None)], "doc_id long, text string").repartition(3)
    model = N.train(docs.filter("doc_id % 4 > 0 and doc_id < 999"))
    got = {r["doc_id"]: r for r in N.score_texts(docs, model).collect()}
    lower = [t.encode().lower().decode().split() for t in texts] + [[]]
    want = kneser_ney([w for i, w in enumerate(lower[:-1]) if i % 4], lower)
    for i, w in zip([*range(200), 999], want):
        assert (got[i]["n_tokens"], got[i]["n_known"]) == w[:2]
        assert math.isclose(got[i]["base_score"], w[2], rel_tol=1e-9) and math.isclose(got[i]["score"], w[3], rel_tol=1e-9)


def test_a_lost_model_file_is_an_error(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "b c d")], "doc_id long, text string")
    for name in ("pairs-0", "words-0"):
        model = N.train(docs)
        os.remove(f"{model.folder}/{name}")
        with pytest.raises(Exception, match=name):
            N.score_texts(docs, model).collect()


def test_language_model_on_odd_rows(odd, empty):
    model = N.train(empty)
    got = N.score_texts(odd, model).collect()
    assert len(got) == len(ODD) and all(abs(r["score"]) + abs(r["base_score"]) < 1e-6 and r["n_known"] == 0 for r in got)
    model = N.train(odd)
    got = N.score_texts(odd, model)
    assert got.columns[:-4] == [c for c in odd.columns if c not in ("text", "score")]
    assert all(math.isfinite(r["base_score"]) for r in got.collect())
    assert N.score_texts(empty, model).count() == 0
    with pytest.raises(ValueError):
        N.local_path("hdfs://host/folder")


# --- 4 token counts -------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, lib = TC.TokenCounter(path), Tokenizer.from_file(path)
    rng = random.Random(2)
    letters = "abcdehilnorstuéñßöç'. !?12<|>\n中😂ΣİẞǅÅ̇ "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 300))) for _ in range(600)]
    parts = ["the", "ing", "er", "'s", "an", " ", "tion", "<|endoftext|>", "don't"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 120))) for _ in range(600)]
    texts += ["", "'", "''s", "a" * 3000, "the" * 700, "!" * 500, LONG]
    want = [len(e) for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert own.count(texts).tolist() == want
    got = odd.select("text", TC.token_counts(F.col("text"), path).alias("k")).collect()
    assert [r["k"] for r in got] == [len(lib.encode(r["text"] or "", add_special_tokens=False)) for r in got]
    assert empty.select(TC.token_counts(F.col("text"), path)).count() == 0


def test_token_states_can_start_anew(monkeypatch):
    import public_tokenizers

    own = TC.TokenCounter(public_tokenizers.path("word_bpe_49k.json"))
    before = own.count(["some words here"]).tolist()
    monkeypatch.setattr(TC, "MOST_STATES", 3)
    assert own.count(["some words here"]).tolist() == before


# --- 5 spans --------------------------------------------------------------------------------


def span_words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def test_a_repeated_passage_goes_but_for_its_first_copy(spark):
    rng = random.Random(4)
    passage = " ".join(span_words(rng, 9) + "." for _ in range(7))
    docs = [(i, f"{span_words(rng, 20)}. {passage if i in (3, 5, 6) else span_words(rng, 60)} {span_words(rng, 15)}.") for i in range(10)]
    got = {r["doc_id"]: r for r in SP.dedup_spans(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    for i, text in docs:
        if i in (5, 6):
            assert passage[:40] not in got[i]["text"] and list(got[i]["__removed"]) == [*range(1, 8)]
            assert text.startswith(got[i]["text"][:90]) and text.endswith(got[i]["text"][-60:])
        else:
            assert got[i]["text"] == text and not got[i]["__removed"]


def test_spans_equal_a_plain_version(spark):
    rng = random.Random(5)
    pool = [span_words(rng, rng.randrange(1, 30)) + rng.choice(".!?") + rng.choice([" ", "\n", "  "]) for _ in range(25)]
    docs = [(i, "".join(rng.choice(pool) for _ in range(rng.randrange(0, 12)))) for i in range(120)]
    got = {r["doc_id"]: r for r in SP.dedup_spans(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    seen = set()
    for i, text in docs:
        own, gone = SP.sentences(text), set()
        assert "".join(own) == text
        words = [len(s.split()) for s in own]
        runs = set()
        for a in range(len(own)):
            runs |= {min(((a, b) for b in range(a + min(2, len(own)), len(own) + 1) if sum(words[a:b]) >= 25), default=None)}
            runs |= {max(((b, a + 1) for b in range(0, a + 2 - min(2, len(own))) if sum(words[b : a + 1]) >= 25), default=None)}
        here = set()
        for a, b in sorted(r for r in runs if r):
            key = tuple(" ".join(s.lower().split()) for s in own[a:b])
            if key in seen or key in here:
                gone |= set(range(a, b))
            here.add(key)
        seen |= here
        assert list(got[i]["__removed"]) == sorted(gone), i


def test_repeats_between_texts_of_one_id_or_none_go(spark):
    rng = random.Random(12)
    shared, other = (" ".join(span_words(rng, 9) + "." for _ in range(5)) for _ in range(2))
    rows = [(i, f"{span_words(rng, 20)}. {shared} {span_words(rng, 15)}.") for i in (None, None, 4, 4)]
    rows += [(None, f"{other} {span_words(rng, 15)}.") for _ in range(3)]
    got = SP.dedup_spans(spark.createDataFrame(rows + rows[2:3], "doc_id long, text string").repartition(3)).collect()
    kept = {(r["doc_id"], r["text"]) for r in got}
    assert len(got) == len(rows) + 1 and len(kept) == len(rows)
    assert sum(shared[:40] in t for _, t in kept) == 1 and all(i == 4 for i, t in kept if shared[:40] in t)
    assert sum(other[:40] in t for _, t in kept) == 1


def test_the_query_removes_short_repeated_runs(spark, tmp_path):
    import corpus_pipeline as C

    rng = random.Random(13)
    run = " ".join(span_words(rng, 4) + "." for _ in range(3))  # 3 sentences, 12 words
    trivial = "Read more. Go back. "
    rows = [(i, f"{span_words(rng, 30)}. {run} {span_words(rng, 15)}. {trivial}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for out in (queries()["op5_span_dedup"](spark, str(tmp_path)), C.cut_repeats(spark, docs, str(tmp_path))):
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        assert [run in got[i] for i in range(3)] == [True, False, False]
        assert all(trivial in t for t in got.values())


def test_spans_of_odd_rows(odd, empty):
    got = SP.dedup_spans(odd).collect()
    assert len(got) == len(ODD) and SP.dedup_spans(odd).columns[:-2] == odd.columns
    assert sorted(str(r["text"]) for r in got if not r["__removed"]) == sorted(str(t[1]) for t in ODD)
    assert SP.dedup_spans(empty).count() == 0


# --- 6 decontamination ----------------------------------------------------------------------


def leaks(docs, items, width=10):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower().decode())
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, b in items:
            x = words(b)
            for s in range(max(1, len(x) - width + 1) if x else 0):
                g = x[s : s + width]
                for p in range(len(w) - len(g) + 1):
                    if w[p : p + len(g)] == g:
                        hit |= set(range(p, p + len(g)))
                        found.add(str(i))
        out[d] = (len(w), len(hit), sorted(found))
    return out


def test_contamination_equals_a_plain_search(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: rng.choice(["a", "b", "the", "Zz", "é9", "of"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 11, 14])))) for i in range(12)] + [(50, ""), (51, None), (52, "same same same")]
    docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    docs += [(100 + i, f"x {items[i][1]}, y {items[i][1]}") for i in range(12)] + [(200, None), (201, "same same same same")]
    want = leaks(docs, items)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for most in (200_000, 0):  # with and without broadcasts
        monkeypatch.setattr(D, "BROADCAST_TERMS", most)
        monkeypatch.setattr(D, "BROADCAST_WINDOWS", most)
        monkeypatch.setattr(D, "BROADCAST_DOCUMENTS", most)
        got = {r["__id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in D.contamination(df, bench).collect()}
        assert got == want


def test_proximity_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_TERMS", 0)
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(60))) for _ in range(40)] + ["a b"] * 3
    items = [(0, "a b"), (1, "c d e"), (2, "h g"), (3, "zz a"), (4, "f")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = Counter(tuple(r)[:2] + tuple(r)[3:] for r in D.proximity(docs, spark.createDataFrame(items, "item_id long, text string"), 4).select("item_id", "__id", "__h", "left_pos", "right_pos").collect())
    n = Counter(w for t in texts for w in t.split())
    want = Counter()
    for i, t in items:
        pair = sorted({w for w in t.split() if n[w]}, key=lambda w: (n[w], w))[:2]
        if len(pair) == 2:
            for d, text in enumerate(texts):
                w = text.split()
                want.update((i, d, x, y) for x in range(len(w)) for y in range(len(w)) if w[x] == pair[0] and w[y] == pair[1] and abs(x - y) <= 4)
    assert got == want and sum(want.values()) > 100


def test_proximity_and_odd_rows(spark, odd, empty):
    docs = spark.createDataFrame([(1, "red x x blue x x x x red")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "Blue x, red."), (8, "x x"), (9, None), (10, "red only here")], "item_id long, text string")
    got = D.proximity(docs, asked, 3).collect()
    assert [(r["item_id"], r["__id"], r["left_pos"], r["right_pos"]) for r in got] == [(7, 1, 3, 0)]
    bench = spark.createDataFrame([(1, "delta epsilon"), (None, "delta"), (2, None)], "item_id long, text string")
    got = D.contamination(odd, bench).collect()
    assert len(got) == len(ODD) and sum(r["n_hit"] > 0 for r in got) == 2
    assert D.contamination(empty, bench).count() == 0
    assert {r["n_hit"] for r in D.contamination(odd, bench.filter("false")).collect()} == {0}


# --- 7 top-k --------------------------------------------------------------------------------


@pytest.mark.parametrize("node", [4096, 40])
def test_top_k_equals_brute_force(spark, monkeypatch, node):
    monkeypatch.setattr(TK, "NODE", node)
    monkeypatch.setattr(TK, "PIVOTS", 5)
    rng = np.random.default_rng(7)
    centers = rng.normal(0, 40, (6, 8))
    v = np.round(centers[rng.integers(0, 6, 500)] + rng.normal(0, 6, (500, 8))).astype(int)
    v[100:260] = v[100]  # a hot vector, many ties
    rows = [(i, [int(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (7, [int(x) for x in v[7]]), (901, [1, 2])]
    again = [(11, v[11]), (11, v[300]), (21, v[400]), (21, v[400]), (101, v[5]), (None, v[11]), (None, v[0])]
    rows += [(i, [int(x) for x in r]) for i, r in again]
    df = spark.createDataFrame(rows, "vec_id long, v array<bigint>")
    got = Counter(tuple(r) for r in TK.top_k(df, 9, F.col("vec_id") % 10 == 1).collect())
    ids = np.array([TK.NO_ID if i is None else i for i, r in rows if r])
    flat = np.array([r + [0] * (8 - len(r)) for _, r in rows if r])
    want = []
    for q in np.flatnonzero(ids % 10 == 1):
        s = flat @ flat[q]
        order = [j for j in np.lexsort([ids, -s]) if j != q][:9]  # every row but the query's own
        want += [(int(ids[q]), k + 1, None if ids[j] == TK.NO_ID else int(ids[j]), int(s[j])) for k, j in enumerate(order)]
    assert got == Counter(want)


def test_query_rows_of_one_id_have_lists_of_their_own(spark):
    df = spark.createDataFrame([(0, [1, 0]), (0, [0, 1]), (1, [3, 5])], "vec_id long, v array<bigint>")
    got = Counter(tuple(r) for r in TK.top_k(df, 2, F.col("vec_id") == 0).collect())
    assert got == Counter([(0, 1, 1, 3), (0, 2, 0, 0), (0, 1, 1, 5), (0, 2, 0, 0)])


def test_top_k_ignores_clashing_columns(spark):
    names = ("id", "row", "ask", "cell", "node", "rank", "score", "query_id", "query_row")
    df = spark.createDataFrame([(1, [1, 2]), (2, [3, 0]), (None, [5, 5])], "vec_id long, v array<bigint>")
    got = TK.top_k(df.withColumns({c: F.lit(7) for c in names}), 2, F.col("vec_id") == 1).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(1, 1, None, 15), (1, 2, 2, 3)]


def test_top_k_small_and_empty(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [0, 0])], "vec_id long, v array<bigint>")
    assert [tuple(r) for r in TK.top_k(df, 5, F.lit(True)).orderBy("query_id").collect()] == [(1, 1, 2, 0), (2, 1, 1, 0)]
    assert TK.top_k(df.filter("false"), 5, F.lit(True)).count() == 0
    odd = spark.createDataFrame([(1, [1.0, float("nan")]), (2, None), (3, [None, 1.0]), (4, [1.0]), (5, [])], "id int, e array<double>")
    assert [r["id"] for r in odd.filter(TK.finite(F.col("e"))).collect()] == [4, 5]


# --- 8 SimHash ------------------------------------------------------------------------------


def test_fingerprints_equal_a_plain_version():
    for text in ["", "one", "a b c d e f", "A  b\tC d", "é " * 9, LONG[:5000]]:
        w = text.encode().lower().split()
        k = min(4, len(w))
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)] if w else []
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert int.from_bytes(SH.simhash(text.encode(), 4), "big") == want
    assert SH.simhash(None, 4) == bytes(8)


@pytest.mark.parametrize("block", [2048, 30])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, block):
    monkeypatch.setattr(SH, "BLOCK", block)
    rng = random.Random(8)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for base in list(prints)[:5]:  # dense clusters, and a chain
        for _ in range(40):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4))))
    at = rng.getrandbits(64)
    for step in range(0, 60, 4):
        at ^= 0b1111 << step
        prints.add(at)
    values = sorted(prints)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    roots = SH.components(SH.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4))
    name = {r["node"]: r["root"] for r in roots.collect()}
    own = Counter(name.get(x, x) for x in signed)
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    groups = defaultdict(set)
    for i, x in enumerate(signed):
        groups[find(i)].add(name.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len(own) == len(groups)


def test_classes_of_odd_rows(odd, empty):
    got = SH.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert {r["component_id"] for r in got if r["fp"] == 0} == {2}
    assert [r["component_id"] for r in got if r["doc_id"] == 1] == [1, 1]
    assert SH.near_duplicates(empty).count() == 0


# --- 9 licences -----------------------------------------------------------------------------


def test_licences_are_found_and_prose_is_not(spark):
    rng = random.Random(9)
    rows = [(i, "\n".join(span_words(rng, 12) for _ in range(4))) for i in range(150)]
    known = [(200, "Released under the MIT License.", "MIT"), (201, "Licensed under the Apache License, Version 2.0.", "Apache"), (202, "x\nThis work is licensed under the GNU General Public License, version 2.", "GPL"), (203, "Licensed under CC BY-NC 3.0.", "CC-BY-NC")]
    rows += [(i, t) for i, t, _ in known] + [(300, None), (301, ""), (302, " \n ")]
    got = LI.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["family"]) for r in got} == {(i, f) for i, _, f in known}
    assert all(r["confirmed"] and r["paragraph"] == (r["doc_id"] == 202) for r in got)
    assert LI.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_licence_lines_alone_are_found_by_templates(spark):
    docs = spark.createDataFrame([(i, "Released under the MIT License.") for i in range(50)], "doc_id long, text string")
    got = LI.scan(docs).collect()
    assert len(got) == 50 and {(r["family"], r["likeness"], r["confirmed"]) for r in got} == {("MIT", 1.0, True)}


def test_wrapped_notices_are_one_paragraph(spark):
    rng = random.Random(19)
    rows = [(i, "\n".join(span_words(rng, 12) for _ in range(4))) for i in range(150)]
    notice = LI.TEMPLATES["MIT"][2]
    cut = [notice[:77].rsplit(" ", 1)[0]]
    cut += [notice[len(cut[0]) + 1 :][:70].rsplit(" ", 1)[0]]
    cut += [notice[len(cut[0]) + len(cut[1]) + 2 :]]
    rows += [(200, "\n".join(cut)), (201, "\r\n".join(["A title", *cut, "", "more words"])), (202, "First sentence of an ordinary paragraph here.\n" + notice)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = LI.scan(docs).collect()
    assert {(r["doc_id"], r["paragraph"], r["family"], r["likeness"]) for r in got} == {(200, 0, "MIT", 1.0), (201, 1, "MIT", 1.0), (202, 1, "MIT", 1.0)}
    parts = [r["line"] for r in LI.paragraphs(docs.filter("doc_id = 201")).orderBy("paragraph").collect()]
    assert parts == ["A title\r", "\r\n".join(cut) + "\r", "more words"]
    long = spark.createDataFrame([(1, "a" * 39 + "\nb"), (2, "a" * 40 + "\nb"), (3, "a" * 120 + "\nb"), (4, "a" * 121 + "\nb"), (5, "a" * 40 + ".\nb")], "doc_id long, text string")
    assert {r["doc_id"]: r["count"] for r in LI.paragraphs(long).groupBy("doc_id").count().collect()} == {1: 2, 2: 1, 3: 1, 4: 2, 5: 2}


def test_cues_leave_out_no_call(spark):
    rng = random.Random(29)
    rows = [(i, "\n".join(span_words(rng, 12) for _ in range(3))) for i in range(120)]
    rows += [(500 + i, t) for i, t in enumerate(t for ts in LI.TEMPLATES.values() for t in ts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = LI.paragraphs(docs)
    scanner = LI.train(lines)
    scored = scanner.model.transform(LI.featured(lines, LI.Settings())).collect()
    plain = {(r["doc_id"], r["paragraph"]): r["__p"].toArray()[1:] for r in scored}
    want = {(k, scanner.families[1 + int(p.argmax())]) for k, p in plain.items() if p.max() >= scanner.least}
    assert len(want) > 20 and {((r["doc_id"], r["paragraph"]), r["family"]) for r in LI.scan(docs).collect()} == want
    sample = spark.createDataFrame([(["the", "of"],)] * 9 + [(["license"],)], "w array<string>")
    assert LI.cue_words([["the", "license"], ["of", "the"], ["rights"]], sample, LI.Settings(common=0.2)) == ["license", "of", "rights", "the"]
    assert LI.cue_words([["the", "license"], ["rights"]], sample, LI.Settings(common=0.2)) == ["license", "rights"]


def test_a_notice_of_common_words_alone_is_called(spark):
    """Every word of the notice is common in the corpus, only their order is not."""
    rng = random.Random(39)
    notice = LI.TEMPLATES["MIT"][2].replace(" without restriction", "")
    common = sorted(set(notice.lower().replace(",", "").replace(".", "").split()))
    mixed = lambda: " ".join(rng.sample(span_words(rng, 9).split() + rng.sample(common, 1), 10))
    rows = [(i, "\n".join(mixed() for _ in range(3))) for i in range(150)] + [(500, notice)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = LI.paragraphs(docs)
    held = LI.training_rows(lines, LI.Settings()).filter("family = 'unknown'")
    cues = LI.cue_words([r["w"] for r in LI.template_table(spark).collect()], held, LI.Settings())
    assert not set(cues) & set(common)
    scanner = LI.train(lines)
    scored = scanner.model.transform(LI.featured(lines, LI.Settings())).collect()
    want = {(r["doc_id"], r["paragraph"]) for r in scored if max(r["__p"][1:]) >= scanner.least}
    got = LI.scan(docs).collect()
    assert (500, 0) in want and {(r["doc_id"], r["paragraph"]) for r in got} == want
    assert [(r["family"], r["confirmed"]) for r in got if r["doc_id"] == 500] == [("MIT", True)]


def test_word_pairs_equal_grams(spark):
    rows = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b", "a", "\u00e9"],)], "w array<string>")
    got = rows.select(LI.pairs(F.col("w")).alias("p"), LI.grams(F.col("w"), 2).alias("g")).collect()
    assert all(r["p"] == r["g"] for r in got) and got[3]["p"] == ["a b", "b a", "a \u00e9"]


def test_every_paragraph_trains_until_the_fit_converges(spark):
    """Prose that a draw of 4,000 paragraphs leaves out is learned as unknown all the same."""
    rng = random.Random(49)
    prose = [span_words(rng, 12) for _ in range(6000)]
    odd = [" ".join([span_words(rng, 3), "mit license", span_words(rng, 2), "released", span_words(rng, 3)]) for _ in range(500)]
    draw = F.pmod(F.xxhash64("value", F.lit("unknown")), F.lit(1 << 30)) >= 0.75 * (1 << 30)
    odd = [r["value"] for r in spark.createDataFrame(odd, "string").filter(draw).collect()]
    notice = "Released under the MIT License."
    rows = [*enumerate(prose), *enumerate(odd, 10_000), *enumerate(prose[:50], 20_000), (30_000, notice)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = LI.paragraphs(docs)
    unknown = LI.training_rows(lines, LI.Settings()).filter("family = 'unknown'")
    assert len(odd) > 100 and unknown.select("w").distinct().count() == len({*prose, *odd})
    scanner = LI.train(lines)
    assert scanner.model.summary.totalIterations < LI.Settings().iterations
    assert {r["doc_id"] for r in LI.scan(docs).collect()} == {30_000}
    with pytest.raises(RuntimeError, match="converged"):
        LI.train(lines, LI.Settings(iterations=5))


def test_licence_training_counts_different_paragraphs_once(spark):
    rows = [(i, f"{a} {b} plain") for i, (a, b) in enumerate([("north", "south"), ("east", "west"), ("east", "west")])]
    rows += [(9, "the the plain"), (10, "plain the plain"), (11, "under the terms of nothing")]
    sets = LI.training_sets(LI.paragraphs(spark.createDataFrame(rows, "doc_id long, text string")), LI.Settings())
    assert sets.filter("label = 0").agg(F.sum("n")).first()[0] == 4
    assert sets.filter("label > 0").agg(F.sum("n")).first()[0] == sum(map(len, LI.TEMPLATES.values())) * LI.Settings().variants
    assert sets.filter("label > 0 and held").count() == 0


def test_unknown_paragraphs_all_held_out_leave_the_templates_to_decide(spark):
    lines = [f"river{chr(97 + i)} mountain" for i in range(20)]
    seen = LI.paragraphs(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    line = seen.filter(F.pmod(F.xxhash64("w", F.lit("held out")), F.lit(4)) == 0).first()["line"]
    docs = spark.createDataFrame([(1, line), (2, "Released under the MIT License.")], "doc_id long, text string")
    assert {(r["doc_id"], r["family"]) for r in LI.scan(docs).collect()} == {(2, "MIT")}


def test_licence_words_are_those_of_the_shared_pattern(spark):
    texts = ["", " ", "A", " a-B  c9d 12,5\u00e9\u00c9 ", "\x7fx{y}\u2014z\U0001f600 q\r\n", "\ud55c\uae00 `k` 3.0", "...", None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = words(F.regexp_replace(ascii_lower(F.col("text")), "[0-9]+", "0"), LETTERS)
    got = docs.select(LI.plain_words(F.col("text")).alias("a"), plain.alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got)


def test_licence_scan_of_odd_rows(spark, odd, empty):
    odd = odd.withColumns({c: F.lit(1) for c in ("w", "line", "paragraph", "family", "p")})
    notice = spark.createDataFrame([(9, "Released under the MIT License.\n\nplain words of no kind")], "doc_id long, text string")
    got = LI.scan(odd.unionByName(notice, allowMissingColumns=True)).collect()
    assert {(r["doc_id"], r["paragraph"], r["family"]) for r in got if r["confirmed"]} == {(9, 0, "MIT")}
    assert LI.scan(empty).count() == 0


# --- 10 mixing ------------------------------------------------------------------------------


def test_mix_meets_its_targets(spark, odd, empty):
    rng = random.Random(10)
    rows = [(i, "w " * rng.randrange(0, 50), None if i % 7 == 0 else "hot" if i % 3 else f"s{i % 5}") for i in range(400)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, source string").repartition(4)
    mixed = MI.mix_sources(docs)
    got = mixed.collect()
    assert len(got) == 403 and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    taken, target, size = Counter(), {}, Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 1 and target[s] <= 2 * size[s] + 1e-6 for s in target)
    assert math.isclose(sum(target.values()), 1.5 * sum(size.values()))
    names = sorted((s for s in target if s), key=str) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    open_ = {round(target[s] / weight[s], 6) for s in names if target[s] < 2 * size[s] - 1e-6}
    assert len(open_) == 1 and all(2 * size[s] <= weight[s] * max(open_) + 1e-6 for s in names if target[s] >= 2 * size[s] - 1e-6)
    again = MI.mix_sources(docs.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    order = MI.training_order(mixed, [[(0, 1), (1, 1)], [(0, 2), (1, 0)]]).collect()
    at = [r["position"] for r in order]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    assert sum(r["tokens"] for r in order) == sum(taken.values())
    fading = [r["position"] for r in order if r["source"] == names[1]]
    steady = [r["position"] for r in order if r["source"] == names[0]]
    assert np.mean(fading) < np.mean(steady)
    assert MI.mix_sources(empty).count() == 0 and MI.mix_sources(odd).count() == len(ODD)
    assert MI.mix_sources(spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")).first()["taken"] == 0


# --- pipeline and queries -------------------------------------------------------------------


def test_pipeline_equals_its_plain_parts(spark, tmp_path):
    """Each stage's outcome from plain versions over the rows that its predecessor kept."""
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    kept = {}
    for name, stage in C.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        kept[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "mix":
            assert kept[name].columns == names
        docs = kept[name]
    ids = {n: {r["doc_id"] for r in d.select("doc_id").collect()} for n, d in kept.items()}
    texts = {r["doc_id"]: r["text"] or "" for r in kept["toxicity"].collect()}
    own = {}
    for i, t in texts.items():  # five words, the whole sequence if there are fewer
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
        own[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    group = {i: i for i in own}
    for i in sorted(own):
        for j in sorted(own):
            both = len(own[i] & own[j])
            if j < i and group[i] != group[j] and both >= 0.8 * (len(own[i]) + len(own[j]) - both):
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    assert ids["near_dedup"] == set(group.values())
    assert ids["span_dedup"] == ids["near_dedup"]
    after = [(r["doc_id"], r["text"]) for r in kept["span_dedup"].collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert ids["decontaminate"] == {i for i, v in leaks(after, items).items() if not v[1]}
    sizes = sum(len((r["text"] or "").split()) for r in kept["decontaminate"].collect())
    assert abs(sum(r["tokens"] for r in kept["mix"].collect()) - 1.5 * sizes) <= 20


def test_pipeline_of_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline as C

    clash = ("__key", "__n", "__i", "__k", "__id", "__h", "__gone", "__removed", "__sentences", "__kept", "other0", "node", "shard")
    docs = odd.withColumns({c: F.lit(8) for c in clash})
    # (id, text) rows that stay: without words and equal rows are one class each
    whole = [(i, t) for i, t, *_ in ODD]
    want = {"toxicity": whole, "near_dedup": [r for k, r in enumerate(whole) if k not in (1, 4, 5)], "decontaminate": whole}
    for start in (docs, docs.filter("false")):
        for name, stage in C.STAGES[:-1]:
            out = stage(spark, start, SMALL)
            assert out.columns == start.columns
            rows = out.collect()
            assert all(r["__key"] == 8 and r["score"] == 7 for r in rows)
            if name in want:
                assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(want[name] if start is docs else [])
            else:
                assert len(rows) == (len(ODD) if start is docs else 0)
        assert (C.STAGES[-1][1](spark, start, SMALL).count() > 0) == (start is docs)


def test_whole_run_on_odd_and_empty_tables(spark, odd, tmp_path):
    import corpus_pipeline as C

    for name, docs in (("odd", odd), ("none", odd.filter("false"))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for t in ("labels", "benchmark"):
            part = spark.read.parquet(f"{SMALL}/{t}.parquet")
            (part if name == "odd" else part.filter("false")).write.parquet(f"{tmp_path}/{name}/{t}.parquet")
        rows = C.run(spark, f"{tmp_path}/{name}").collect()
        # the text without words that stays takes no place in the mix
        kept = {(1, 7), (None, 7), (5, 60_000), (5, 6)} if name == "odd" else set()
        assert {(r["doc_id"], r["size"]) for r in rows} == kept


def test_different_texts_stay_whatever_their_ids(spark):
    import corpus_pipeline as C

    rng = random.Random(11)
    texts = [span_words(rng, 60) for _ in range(8)]
    rows = [(None, t) for t in texts[:4]] + [(7, t) for t in texts[4:]] + [(None, texts[0]), (9, texts[1]), (8, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [r["text"] for r in C.one_of_each(spark, docs, SMALL).collect()]
    assert sorted(got) == sorted(texts)


@pytest.mark.parametrize("block", [1024, 8])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    """Of chains, clusters and pairs around similarity 0.8 the classes' smallest ids stay."""
    import corpus_pipeline as C
    from tinderframe.llm import similar

    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(14)
    texts = []
    for _ in range(12):
        base = span_words(rng, rng.randrange(30, 200)).split()
        for edits in range(12):
            copy = list(base)
            for at in rng.sample(range(len(base)), min(edits, len(base))):
                copy[at] = span_words(rng, 1)
            texts.append(" ".join(copy))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]) and group[i] != group[j]:
                x, y = sorted((group[i], group[j]))
                group = [x if g == y else g for g in group]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert 12 < len(set(group)) < len(texts)
    assert {r["doc_id"] for r in C.one_of_each(spark, docs, SMALL).collect()} == set(group)


def test_held_out_accuracy_of_the_registered_query(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = queries()["op2_toxicity"](spark, folder).join(labels, "doc_id").filter("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    toxic = [r for r in rows if r["toxic"]]
    clean = [r for r in rows if not r["toxic"]]
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.01 * len(clean)
