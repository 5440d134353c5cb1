"""Token counts from a byte-pair tokenizer compiled to a deterministic transducer.

A BPE tokenization is settled by its neighbours: a sequence of tokens is the tokenizer's
output if and only if every two adjacent tokens, merged from their symbols alone, come out as
these two. So each prefix of a word has exactly one last token, found among the tokens that
end there, and what the future needs of the past is finite: the starts from which a token can
still grow, the last token before each, and how many tokens ago that was. These are the
states. A transition on a symbol carries the change in the number of tokens; it may be
negative, since a symbol can fuse several tokens into one. A word's last symbol is another
letter of the alphabet than the same one inside a word, so states run one symbol late and
ending a word has its own count.

States are made when a text first needs them and kept per worker (up to ``MOST_STATES``; then
the table starts anew). Texts run through the table in chunks of ``CHUNK`` symbols, all at
once: a chunk maps its entry state to an exit state and a count. From its first word start
on, the map does not depend on the entry state; that part is computed first. The part before
takes the exit state of the chunk to the left, and chunks inside one long word compose their
maps from left to right. Sums over the chunks are the counts.

Built for the layout of ``word_bpe_49k.json``: NFC, lower case, white space dropped, words by
contraction, letters, single digits and others, byte-level symbols, word-end suffix. Other
layouts are refused. Defined cases: null counts 0 bytes and 0 tokens, as the empty text does;
special strings count one each, as the library's default has it; repeated rows are counted
one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, functions as F

CHUNK = 64
MOST_STATES = 240_000
STEP_BYTES = 1 << 20
NO_GAIN = 128
LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: The fixed parts of the layout this module compiles.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTED = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordTransducer:
    """States and transitions over the symbols of one word; lazily grown."""

    def __init__(self, merges: list[tuple[str, str]], vocab: set[str], end: str):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.vocab, self.end = vocab, end
        self.prefixes = {t.removesuffix(end)[:i] for t in vocab for i in range(1, len(t.removesuffix(end)) + 1)}
        self.symbols = byte_symbols()
        self.made = {a + b: (i, a, b) for i, (a, b) in reversed(list(enumerate(merges)))}
        self.fits = lru_cache(1 << 19)(self._fits)
        self.whole = lru_cache(1 << 17)(lambda token: self.merge(self.split(token)) == [token])
        self.reset()

    def reset(self) -> None:
        self.column = np.full(256, -1, np.int32)  # byte -> column of the table; 0 ends a word
        self.bytes: list[int] = [-1]
        self.core: dict = {}  # what is known before the pending symbol -> number
        self.cores: list = []
        self.number: dict = {}
        self.states: list = [None]  # 0: no word is open
        self.begin = np.full(256, -1, np.int32)
        self.shift = 5
        self.table = np.full(1024 << self.shift, -1, np.int32)  # state << 8 | gain + 128
        self.table[0] = NO_GAIN
        self.stepped: dict = {}
        self.start = self._core(("", ((0, None, 0),)))

    def merge(self, parts: list[str]) -> list[str]:
        """Byte-pair merging, lowest rank first, leftmost among equals."""
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def split(self, token: str) -> list[str]:
        if token.endswith(self.end) and token != self.end:
            body = token.removesuffix(self.end)
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _fits(self, left: str | None, right: str) -> bool:
        """Whether the two stay apart when merged from their symbols.

        Told by undoing merges at the border, the latest first: they would have joined if
        two parts that lay side by side make a pair of lower rank than what came next. Of
        equal ranks the left one is merged first.
        """
        if not self.whole(right):
            return False
        before = 1 << 30
        while left is not None:
            if self.rank.get((left, right), before) < before:
                return False
            a, b = self.made.get(left, (-1,)), self.made.get(right, (-1,))
            if a[0] < 0 and b[0] < 0:
                break
            if a[0] > b[0]:
                before, left = a[0], a[2]
            else:
                before, right = b[0] + 1, b[1]
        return True

    def _last(self, core: tuple, symbol: str) -> tuple[str, int]:
        """The one token that ends with ``symbol`` here, and the change in the count."""
        tail, starts = core
        for length, before, ago in starts:
            token = tail[len(tail) - length :] + symbol
            if token in self.vocab and self.fits(before, token):
                return token, 1 - ago
        raise ValueError(f"no token ends with {symbol!r} after {tail!r}")

    def _step(self, core: int, symbol: str) -> tuple[int, int]:
        if (known := self.stepped.get((core, symbol))) is None:
            tail, starts = self.cores[core]
            token, gain = self._last((tail, starts), symbol)
            grown = [(n + 1, before, ago + gain) for n, before, ago in starts if tail[len(tail) - n :] + symbol in self.prefixes]
            longest = max((n for n, _, _ in grown), default=0)
            new = ((tail + symbol)[len(tail) + 1 - longest :], (*grown, (0, token, 0)))
            known = self.stepped[core, symbol] = (self._core(new), gain)
        return known

    def _core(self, core: tuple) -> int:
        if (i := self.core.get(core)) is None:
            i = self.core[core] = len(self.cores)
            self.cores.append(core)
        return i

    def state(self, core: int, byte: int) -> int:
        if (i := self.number.get((core, byte))) is None:
            i = self.number[core, byte] = len(self.states)
            self.states.append((core, byte))
            if len(self.states) << self.shift > len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return i

    def know(self, byte: int) -> None:
        """Gives a byte its column and its start state."""
        self.column[byte] = len(self.bytes)
        self.bytes.append(byte)
        if len(self.bytes) > 1 << self.shift:
            old = self.table.reshape(-1, 1 << self.shift)
            self.table = np.concatenate([old, np.full_like(old, -1)], axis=1).reshape(-1)
            self.shift += 1
        self.table[self.column[byte]] = NO_GAIN  # no word is open: a chunk's unknown head
        self.begin[byte] = self.state(self.start, byte)

    def connect(self, at: int) -> None:
        """Fills one cell of the table."""
        state, column = at >> self.shift, at & ((1 << self.shift) - 1)
        core, pending = self.states[state]
        if column:
            after, gain = self._step(core, self.symbols[pending])
            to = self.state(after, self.bytes[column])
        else:
            to, gain = 0, self._last(self.cores[core], self.symbols[pending] + self.end)[1]
        self.table[at] = to << 8 | gain + NO_GAIN


class TokenCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, form = spec["model"], spec["normalizer"]["normalizers"]
        pre = spec["pre_tokenizer"]["pretokenizers"]
        if (
            model["type"] != "BPE" or not model["end_of_word_suffix"] or model["continuing_subword_prefix"] or model["ignore_merges"]
            or [f["type"] for f in form] != ["NFC", "Replace", "Lowercase"]
            or pre[0]["pattern"]["Regex"] != SPLIT or pre[1]["type"] != "ByteLevel" or pre[1]["add_prefix_space"]
        ):
            raise ValueError("this tokenizer has another layout than the one that is compiled here")
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.words = WordTransducer(pairs, set(model["vocab"]), model["end_of_word_suffix"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.kind = _kinds()

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Normalized parts between special strings, and the number of these."""
        parts = self.special.split(text) if self.special and "<" in text else [text]
        # One letter at a time: a capital sigma has no final form here.
        return [unicodedata.normalize("NFC", p).replace("Σ", "σ").lower() for p in parts], len(parts) - 1

    def count(self, texts: list[str | None]) -> np.ndarray:
        if len(self.words.states) > MOST_STATES:
            self.words.reset()
        out = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, text in enumerate(texts):
            if text:
                found, out[i] = self.pieces(text)
                parts += found
                owner += [i] * len(found)
        if parts:
            joined = " ".join(parts)
            ends = np.cumsum([len(p.encode()) + 1 for p in parts])
            gains, at = self.run(*self.symbols(joined))
            # gains of chunks, split at the part borders by running totals per symbol run
            total = np.concatenate([[0], np.cumsum(gains)])
            cut = np.minimum(np.searchsorted(at, ends, "left"), len(gains))
            np.add.at(out, owner, np.diff(total[np.concatenate([[0], cut])]))
        return out

    def symbols(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of the text, and which of them start a word or are white space."""
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.kind[code]
        before = np.concatenate([[np.uint8(SPACE)], kind[:-1]])
        start = (kind != SPACE) & ((kind != before) | (kind == NUMBER))
        for i in np.flatnonzero((code == 0x27) & (before != OTHER)):
            tail = text[i + 1 : i + 3]
            for c in CONTRACTED:
                if tail.startswith(c):
                    end = i + 1 + len(c)
                    start[i + 1 : end] = False
                    if end < len(code) and kind[end] != SPACE:
                        start[end] = True
                    break
        data = np.frombuffer(text.encode(), np.uint8)
        if len(data) == len(code):
            return data, start, kind == SPACE
        first = (data & 0xC0) != 0x80
        of = np.cumsum(first) - 1
        return data, start[of] & first, (kind == SPACE)[of]

    def run(self, data: np.ndarray, start: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gain in tokens per symbol, booked where it is known: (gains, positions of them).

        A word's last count is booked at the symbol after it; one closing space is added.
        """
        w = self.words
        for b in np.flatnonzero(np.bincount(data, minlength=256)):
            if w.column[b] < 0 and (b > 0x20 or not space[data == b].all()):
                w.know(int(b))
        width = len(data) // CHUNK + 1
        free = np.ones(width * CHUNK, bool)  # the entry state does not matter from here on
        free[: len(data)] = start | space
        sym = np.zeros(width * CHUNK, np.int32)
        sym[: len(data)] = w.column[data]
        sym[free] = 0
        to = np.zeros(width * CHUNK, np.int32)
        to[: len(data)] = w.begin[data]
        to[: len(data)][~start] = 0
        sym, free, to = (x.reshape(width, CHUNK).T.copy() for x in (sym, free, to))
        gains = np.empty((CHUNK, width), np.uint8)
        state = np.zeros(width, np.int32)
        for k in range(CHUNK):
            found = self._look(state, sym[k])
            gains[k] = found & 255
            state = np.where(free[k], to[k], found >> 8)
        head = np.where(free.any(axis=0), free.argmax(axis=0), CHUNK)
        left = np.arange(1, width)
        while len(left):  # heads whose left neighbour is done; more rounds only inside long words
            waits = np.concatenate([[False], (np.diff(left) == 1) & (head[left[:-1]] == CHUNK)])
            now, left = left[~waits], left[waits]
            entry, part = state[now - 1], now
            for k in range(CHUNK):
                found = self._look(entry, sym[k, part])
                gains[k, part] = found & 255
                entry = found >> 8
                live = head[part] > k
                part, entry = part[live], entry[live]
                if not len(part):
                    break
            state[part] = entry  # those without a word start
        flat = gains.T.reshape(-1)
        at = np.flatnonzero(flat != NO_GAIN)
        return flat[at].astype(np.int64) - NO_GAIN, at

    def _look(self, state: np.ndarray, sym: np.ndarray) -> np.ndarray:
        w = self.words
        at = (state << w.shift) + sym
        found = w.table[at]
        while (missing := found < 0).any():
            for cell in np.unique(at[missing]):
                w.connect(int(cell))
            found = w.table[at]
        return found


def _kinds() -> np.ndarray:
    """Class of every code point, by the categories the split pattern names."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for a, b in ((0, 0xD800), (0xE000, sys.maxunicode + 1)):
        every = "".join(map(chr, range(a, b)))
        for kind, form in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(form, every):
                out[a + m.start() : a + m.end()] = kind
    out[0x1C:0x20] = OTHER
    return out


@lru_cache(2)
def counter(path: str) -> TokenCounter:
    """The compiled tokenizer of a file, kept by each worker."""
    return TokenCounter(path)


def token_counts(text: Column, path: str) -> Column:
    """Number of tokens per text. ``path`` names the tokenizer's file on every worker."""

    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(path)
        for texts in batches:
            values, out, run, size = list(texts), [], [], 0
            for v in values:
                run.append(v)
                size += len(v or "")
                if size >= STEP_BYTES:
                    out.append(own.count(run))
                    run, size = [], 0
            out.append(own.count(run))
            yield pd.Series(np.concatenate(out), index=texts.index)

    counted.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(counted, "long")(text)
