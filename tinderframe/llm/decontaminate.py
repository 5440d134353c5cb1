"""Benchmark decontamination with a distributed positional inverted index.

The training texts are cut into words once, and the index holds postings (document, position)
of every word that occurs in a test item, plus one end posting a document, at the position
after its last word. Every window of ``width`` consecutive item words (an item of fewer words
is one window) is looked for by its two rarest terms: their lists are shifted by the terms'
offsets in the window and intersected on (window, document, start). What is left is looked up
word by word in the lists of the documents concerned, so matches are exact phrases. Since all
item words have postings, the same index answers proximity: ``proximity`` intersects the lists
of each item's two rarest terms within a distance.

Only DataFrame functions are used. Postings of a term are rows of a few numbers, never
collected, and no row carries a text; a term or a document that holds a third of all rows is
dealt over partitions by (window, document, start). Items are broadcast only below
``BROADCAST_TERMS`` distinct terms and are joined by shuffle beyond, by the same plan.

Defined cases: null and empty texts have no words, no hits and no windows; items equal in
text are all reported; rows that agree in id and text are one document and get the same
result; a document whose words overlap several windows counts each word once; an empty
benchmark leaves all documents clean; extra columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tinderframe.llm.common import LOWER, UPPER
from tinderframe.session import cut_lineage

#: Distinct item terms up to which they are sent to every task; a term is about 30 bytes.
BROADCAST_TERMS = 200_000
#: Distinct windows up to which their probes are sent to every task (two, of 10 words each).
BROADCAST_WINDOWS = 100_000
#: Documents with candidates up to which their keys (16 bytes each) are sent to every task.
BROADCAST_DOCUMENTS = 1_000_000
#: Everything in ASCII that is no part of a word.
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: The term of the posting after a document's last word.
END = -1


def item_words(text: Column) -> Column:
    """Runs of letters and digits, A-Z lower-cased, and of anything beyond ASCII."""
    spaced = F.translate(F.coalesce(text, F.lit("")), UPPER + BETWEEN, LOWER + " " * len(BETWEEN))
    return F.array_remove(F.split(spaced, " "), "")


def windows(items: DataFrame, width: int, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Every window of every item: item_id, window (its words), repeats of an item once."""
    rows = items.select(F.col(item_id).alias("item_id"), item_words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1))
    cut = F.transform(starts, lambda s: F.slice("w", s, F.lit(width)))
    return rows.select("item_id", F.explode(cut).alias("window")).distinct()


def sent(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Marks a side of counted size for broadcast."""
    return F.broadcast(df) if rows <= most else df


def keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("__id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__h"), F.col(text).alias("text"))


def of_document(a: DataFrame, b: DataFrame) -> Column:
    """Rows of one document; ``b`` names it i and h."""
    return a["__id"].eqNullSafe(b["i"]) & (a["__h"] == b["h"])


@dataclass(frozen=True)
class Index:
    """postings: __id, __h, pos, no; counts: no, n; terms: term, no."""

    postings: DataFrame
    counts: DataFrame
    terms: DataFrame


def build_index(docs: DataFrame, terms: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Index:
    """Postings of the given (term)s and of the documents' ends, in one pass over the texts."""
    numbered = cut_lineage(terms.select("term").distinct().withColumn("no", F.monotonically_increasing_id()), "terms")
    # an empty string is no word: it stands for the end of a document
    wanted = numbered.unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(END).cast("long").alias("no")))
    own = keyed(docs, text, doc_id)
    tokens = own.select("__id", "__h", F.posexplode(F.concat(item_words(F.col("text")), F.array(F.lit("")))).alias("pos", "term"))
    found = tokens.join(sent(wanted, numbered.count(), BROADCAST_TERMS), "term")
    postings = cut_lineage(found.select("__id", "__h", "pos", "no"), "postings")
    counts = postings.filter(F.col("no") != END).groupBy("no").agg(F.count("*").alias("n"))
    return Index(postings, cut_lineage(counts, "term-counts"), numbered)


def ends(index: Index) -> DataFrame:
    """(__id, __h, n_words) of every document row."""
    return index.postings.filter(F.col("no") == END).select("__id", "__h", F.col("pos").cast("long").alias("n_words"))


def probes(distinct: DataFrame, index: Index) -> DataFrame:
    """Words of each window with their rank by rarity: window_id, length, off, no, rank (1 and
    2 for the two rarest distinct terms at their first place, else null), lists (of these).
    Windows with a term that no document has are left out: they cannot occur."""
    words = distinct.select("window_id", F.size("window").alias("length"), F.posexplode("window").alias("off", "term"))
    counted = words.join(index.terms, "term").join(index.counts, "no", "left")
    by_window = Window.partitionBy("window_id")
    known = counted.withColumn("all", F.count("n").over(by_window)).filter("all = length")
    first = F.row_number().over(Window.partitionBy("window_id", "no").orderBy("off"))
    known = known.withColumn("first", first == 1)
    place = F.row_number().over(by_window.orderBy(F.desc("first"), "n", "off"))
    ranked = known.withColumns({"place": place, "kinds": F.count_if("first").over(by_window)})
    rank = F.when(F.col("first") & (F.col("place") <= 2), F.col("place"))
    return ranked.select("window_id", "length", "off", "no", rank.alias("rank"), F.least(F.lit(2), "kinds").alias("lists"))


def phrase_matches(index: Index, words: DataFrame, n_windows: int) -> DataFrame:
    """Exact occurrences: window_id, __id, __h, start, length.

    Lists of the rarest and the second rarest term, shifted to the window's start, are
    intersected; then every word of a candidate is looked up in its document's postings.
    """
    spot = ["window_id", "__id", "__h", "start"]
    probe = words.filter("rank is not null").select("no", "window_id", "off", "rank")
    shifted = index.postings.join(sent(probe, n_windows, BROADCAST_WINDOWS), "no").withColumn("start", F.col("pos") - F.col("off")).filter("start >= 0")
    both = shifted.groupBy(*spot).agg(F.min("rank").alias("low"), F.max("rank").alias("high"))
    meta = words.select("window_id", "length", "lists").distinct()
    both = both.join(sent(meta, n_windows, BROADCAST_WINDOWS), "window_id").filter("low = 1 and high = lists")
    candidates = cut_lineage(both.select(*spot, "length"), "candidates")
    held = candidates.select(F.col("__id").alias("i"), F.col("__h").alias("h")).distinct()
    n_held = held.count()
    places = candidates.join(sent(words.select("window_id", "off", "no"), n_windows, BROADCAST_WINDOWS // 10), "window_id")
    places = places.select(*spot, "length", F.col("__id").alias("i"), F.col("__h").alias("h"), (F.col("start") + F.col("off")).alias("at"), F.col("no").alias("wanted"))
    near = index.postings.join(sent(held, n_held, BROADCAST_DOCUMENTS), of_document(index.postings, held), "left_semi")
    # rows that agree in id and text repeat their postings
    near = near.select(F.col("__id").alias("d"), F.col("__h").alias("e"), "pos", "no").distinct()
    found = places.join(near, places["i"].eqNullSafe(near["d"]) & (places["h"] == near["e"]) & (places["at"] == near["pos"]) & (places["wanted"] == near["no"]))
    return found.groupBy(*spot, "length").agg(F.count("*").alias("n")).filter("n = length").select(*spot, "length")


def proximity_matches(index: Index, pairs: DataFrame, within: int) -> DataFrame:
    """Places of two terms at most ``within`` words apart: the columns of ``pairs`` (which has
    left and right, term numbers), __id, __h, left_pos, right_pos.

    An equi-join on (pair, document, block of positions); rows that agree in id and text count
    once.
    """
    block = F.floor(F.col("pos") / within)
    own = index.postings.filter(F.col("no") != END).distinct()
    pairs = pairs.withColumn("pair", F.monotonically_increasing_id())
    pairs = cut_lineage(pairs, "pairs")
    some = sent(pairs.select("pair", "left", "right"), pairs.count(), BROADCAST_WINDOWS)
    a = own.join(some, own["no"] == some["left"]).select("pair", "__id", "__h", F.col("pos").alias("left_pos"), F.explode(F.array(*[block + i for i in (-1, 0, 1)])).alias("b"))
    b = own.join(some, own["no"] == some["right"]).select(F.col("pair").alias("p"), F.col("__id").alias("i"), F.col("__h").alias("h"), F.col("pos").alias("right_pos"), block.alias("c"))
    near = a.join(b, of_document(a, b) & (a["pair"] == b["p"]) & (a["b"] == b["c"]))
    near = near.filter((F.abs(F.col("left_pos") - F.col("right_pos")) <= within) & (F.col("left_pos") != F.col("right_pos")))
    return near.join(pairs, "pair").select(*[c for c in pairs.columns if c != "pair"], "__id", "__h", "left_pos", "right_pos")


def item_index(docs: DataFrame, items: DataFrame, width: int = 10, text: str = "text", doc_id: str = "doc_id") -> tuple[Index, DataFrame]:
    """The index of all item words, and the items' windows (item_id, window, window_id)."""
    all_windows = cut_lineage(windows(items, width).withColumn("window_id", F.xxhash64(F.concat_ws(" ", "window"))), "windows")
    return build_index(docs, all_windows.select(F.explode("window").alias("term")), text, doc_id), all_windows


def proximity(docs: DataFrame, items: DataFrame, within: int = 10, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Where an item's two rarest different terms stand at most ``within`` words apart:
    item_id, __id, __h, left_pos, right_pos. Items of one kind of word have no pair."""
    index, all_windows = item_index(docs, items, 1, text, doc_id)
    words = all_windows.select("item_id", F.col("window")[0].alias("term")).distinct().join(index.terms, "term").join(index.counts, "no")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("n", "term"))
    two = words.withColumn("place", place).filter("place <= 2").groupBy("item_id").agg(F.max(F.when(F.col("place") == 1, F.col("no"))).alias("left"), F.max(F.when(F.col("place") == 2, F.col("no"))).alias("right"))
    return proximity_matches(index, two.filter("right is not null"), within).drop("left", "right")


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: __id, __h, n_words, n_hit (words inside any occurrence), item_ids
    (sorted as strings)."""
    index, all_windows = item_index(docs, items, width, text, doc_id)
    distinct = all_windows.select("window_id", "window").distinct()
    words = cut_lineage(probes(distinct, index), "probes")
    found = cut_lineage(phrase_matches(index, words, distinct.count()), "occurrences")
    of_item = all_windows.select("item_id", "window_id").distinct()
    hit = found.select("__id", "__h", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos")).distinct()
    hits = hit.groupBy("__id", "__h").agg(F.count("*").alias("n_hit"))
    whose = found.select("__id", "__h", "window_id").distinct().join(of_item, "window_id").select("__id", "__h", "item_id").distinct()
    listed = whose.groupBy("__id", "__h").agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("item_ids"))
    hits = hits.join(listed, hits["__id"].eqNullSafe(listed["__id"]) & (hits["__h"] == listed["__h"])).select(hits["__id"].alias("i"), hits["__h"].alias("h"), "n_hit", "item_ids")
    sized = ends(index)
    out = sized.join(hits, of_document(sized, hits), "left")
    return out.select("__id", "__h", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
