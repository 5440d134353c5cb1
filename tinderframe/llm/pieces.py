"""Exact SentencePiece encoding (merge type) by backtracking, and decoding.

A merge tokenizer starts from characters and joins, again and again, the two neighbours whose
joined string has the best score, the leftmost pair first among equals. Its result is settled
by neighbours: a sequence of pieces is the result exactly when every piece alone, and every
two adjacent pieces together, merge from their characters into themselves. So the encoder
need not merge whole texts. It walks from left to right and takes the longest piece that fits
the one before it; where none fits it goes back one piece and tries the next shorter one. An
Aho-Corasick automaton over the reversed vocabulary gives the longest piece at every position,
a table gives the next shorter prefix of a piece, compatibility is decided by merging the two
pieces again (remembered per pair), and a bit field marks positions from which no piece led on,
so that none is tried twice and the work is linear in the text.

Texts are normalized as the model asks (spaces become ``▁``, one is put in front) and cut where
a space starts: no piece of the vocabulary reaches over such a border, which is checked when
the model is opened. Encoded words are remembered per worker up to ``MOST_IDS`` ids. Rows go to
Python in Arrow slices of a few MB; no shuffle takes place, and a task that is lost is just run
again.

Built for models of merge type with identity normalization, byte fallback and no pieces of the
user's own; others are refused. Defined cases: null is encoded as the empty text, which has no
ids and decodes to the empty text; characters outside the vocabulary become their bytes;
repeated rows are encoded one by one; input columns named ``ids`` or ``decoded`` are replaced;
an empty table gives an empty result. A text need not decode to itself: ``▁`` in it comes back
as a space, as it does in the library.
"""

from __future__ import annotations

import codecs
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F, types as T

from tinderframe.llm.common import slices

SPACE = "▁"
UNKNOWN = " ⁇ "
#: Ids of remembered words a worker keeps at most before it forgets them.
MOST_IDS = 2_000_000

# a byte that is no part of a character stands for itself alone
codecs.register_error("each-byte", lambda e: ("�", e.start + 1))


class Pieces:
    """A vocabulary with its encoder and decoder."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        self.text = [model.id_to_piece(i) for i in every]
        self.byte = {i: int(self.text[i][3:5], 16) for i in every if model.is_byte(i)}
        self.of_byte = {b: i for i, b in self.byte.items()}
        self.silent = {i for i in every if model.is_control(i)}
        self.unknown = model.unk_id()
        apart = self.silent | self.byte.keys() | {self.unknown}
        self.score = {self.text[i]: model.get_score(i) for i in every if i not in apart}
        self.id = {self.text[i]: i for i in every if i not in apart}
        probe = "A  éﬁ "
        if model.normalize(probe) != normalized(probe) or len(self.of_byte) != 256 or any(model.is_unused(i) for i in every):
            raise ValueError(f"not an identity-normalized model with byte fallback: {path}")
        if any(SPACE in p.lstrip(SPACE) for p in self.score) or model.encode(f"a{SPACE}{SPACE}a") != model.encode("a  a"):
            raise ValueError(f"pieces reach over the start of a space: {path}")
        whole = {p for p in self.score if self.merge(p) == [p]}
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in whole), None) for p in whole}
        self.automaton = ahocorasick.Automaton()
        for p in whole:
            self.automaton.add_word(p[::-1], p)
        self.automaton.make_automaton()
        self.fits = lru_cache(1 << 20)(lambda left, right: self.merge(left + right) == [left, right])
        if self.encode_word(f"{SPACE}{SPACE}{SPACE}Hello,") != model.encode("  Hello,"):
            raise ValueError(f"not a model of merge type: {path}")
        self.surface = [p.replace(SPACE, " ") for p in self.text]
        for i in self.silent:
            self.surface[i] = ""
        self.surface[self.unknown] = UNKNOWN

    def merge(self, text: str) -> list[str]:
        """The tokenizer's own rule: join the best-scored neighbours, the leftmost first."""
        parts, score = list(text), self.score
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(parts) and (joined := parts[a] + parts[b]) in score:
                heapq.heappush(heap, (-score[joined], a, b, joined))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if parts[a] and parts[b] and parts[a] + parts[b] == joined and after[a] == b:
                parts[a], parts[b], after[a] = joined, "", after[b]
                if after[b] < len(parts):
                    before[after[b]] = a
                offer(before[a], a)
                offer(a, after[a])
        return [p for p in parts if p]

    def longest(self, text: str) -> list[str | None]:
        """The longest piece that starts at each position."""
        found: list[str | None] = [None] * len(text)
        last = len(text) - 1
        for end, piece in self.automaton.iter(text[::-1]):
            at = last - end
            if found[at] is None or len(piece) > len(found[at]):
                found[at] = piece
        return found

    def split(self, text: str) -> list[str]:
        """The pieces of a normalized text; a character outside the vocabulary is one."""
        longest, dead = self.longest(text), bytearray(len(text) // 8 + 1)
        out: list[str] = []
        at, piece = 0, longest[0] if text else None
        while at < len(text):
            if piece is None and longest[at] is None:  # nothing can join an unknown character
                out.append(text[at])
                at += 1
                piece = longest[at] if at < len(text) else None
                continue
            left = out[-1] if out else ""
            free = left not in self.shorter
            while piece is not None:
                to = at + len(piece)
                if not dead[to >> 3] >> (to & 7) & 1 and (free or self.fits(left, piece)):
                    break
                piece = self.shorter[piece]
            if piece is not None:
                out.append(piece)
                at = to
                piece = longest[at] if at < len(text) else None
            else:
                dead[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                piece = self.shorter[piece]
                if piece is None:  # the position before is dead as well
                    continue
        return out

    def encode_word(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self.split(text):
            known = self.id.get(piece)
            if known is None:
                ids += [self.of_byte[b] for b in piece.encode()]
            else:
                ids.append(known)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: runs of bytes are read as UTF-8, a first space goes."""
        byte = self.byte
        if byte.keys().isdisjoint(ids):
            text = "".join(map(self.surface.__getitem__, ids))
        else:
            parts, run = [], bytearray()
            for i in ids:
                if i in byte:
                    run.append(byte[i])
                    continue
                if run:
                    parts.append(run.decode("utf-8", "each-byte"))
                    run = bytearray()
                parts.append(self.surface[i])
            text = "".join([*parts, run.decode("utf-8", "each-byte")])
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first is not None and self.text[first].startswith(SPACE) else text


def normalized(text: str) -> str:
    """Spaces shown, and one in front of a text that is not empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


@lru_cache(2)
def opened(path: str) -> Pieces:
    return Pieces(path)


class Words(dict):
    """Numbers of the words seen so far; their ids lie one after the other in ``ids``."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.ids, self.ends = pieces, array("i"), array("q", [0])

    def __missing__(self, word: str) -> int:
        self.ids.extend(self.pieces.encode_word(word))
        self.ends.append(len(self.ids))
        number = self[word] = len(self)
        return number


WORD = re.compile(f"{SPACE}+[^{SPACE}]*")


def encode_all(words: Words, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and where each text begins (and the last ends)."""
    numbers, sizes = [], [0]
    for text in texts:
        numbers += [words[w] for w in WORD.findall(normalized(text or ""))]
        sizes.append(len(numbers))
    number, flat, ends = np.array(numbers, np.int64), np.array(words.ids), np.array(words.ends)
    length = ends[number + 1] - ends[number]
    starts = np.concatenate([[0], np.cumsum(length)])
    place = np.repeat(ends[number] - starts[:-1], length) + np.arange(starts[-1])
    return flat[place], starts[np.array(sizes)]


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``decoded`` (the text of these ids)."""
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    fields = [f for f in docs.schema.fields if f.name in kept]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, words = opened(model), None
        for batch in slices(batches, "__text", 2 << 20):
            if words is None or len(words.ids) > MOST_IDS:
                words = Words(pieces)
            ids, at = encode_all(words, batch.column("__text").to_pylist())
            decoded = [pieces.decode(ids[a:b].tolist()) for a, b in zip(at, at[1:])]
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            columns = [batch.column(c) for c in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(decoded, pa.string())], names=[*kept, "ids", "decoded"])

    return docs.select(*kept, F.col(text).alias("__text")).mapInArrow(run, schema)
