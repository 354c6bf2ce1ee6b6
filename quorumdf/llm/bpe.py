"""Encoding of a whole corpus with a byte-level BPE tokenizer, by prefix-sharing trie traversal.

The encoding of a word has a unique last token, and what precedes that token is the encoding
of the word's beginning.  So one state per prefix, its last token, describes the encodings
of all words at once.  The distinct words of a batch are walked in sorted order, which is
a depth-first walk of their trie: the states of the prefix shared with the word before stay
on a stack and are not computed again.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumdf.plans.skew import spread

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: Encodings of words kept by a worker before it starts afresh; only speed depends on it.
KEPT_WORDS = 400_000

# Fixed value: how byte_bpe_50k cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in the vocabulary file: itself if visible in Latin-1, else the next free code from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in visible}
    for k, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + k)
    return table


class PrefixBPE:
    """A byte-level BPE vocabulary, encoding sorted words prefix by prefix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        ids = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # Born: the step of the merge that makes a token; single letters are there from the start.
        self.born = [-1] * (max(ids.values()) + 1)
        self.halves: list[tuple[int, int] | None] = [None] * len(self.born)
        self.joined: dict[tuple[int, int], int] = {}
        for step, (a, b) in enumerate(merges):
            whole, pair = ids[a + b], (ids[a], ids[b])
            self.joined.setdefault(pair, step)
            if self.halves[whole] is None:
                self.born[whole], self.halves[whole] = step, pair
        # Every ending of a token, with the token's id if the ending is one; else -1.
        self.endings: dict[str, int] = {}
        single = set(_byte_letters().values())
        for token, i in ids.items():
            if self.halves[i] is None and token not in single:
                continue  # special tokens are not reached from text
            self.endings[token] = i
            for k in range(1, len(token)):
                self.endings.setdefault(token[k:], -1)
        for token, i in ids.items():
            if token in self.endings and (self.halves[i] is not None or token in single):
                self.endings[token] = i
        self.adjacent: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.pattern = regex.compile(PATTERN)

    def may_touch(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side stay as they are.

        Their merges are undone from the last to the first.  At each moment the pieces at the
        border are ``a`` and ``b``; they would have merged with each other if that merge comes
        before the merge that used one of them up.  Of equal merges the one further left
        goes first.
        """
        key = (left, right)
        kept = self.adjacent.get(key)
        if kept is not None:
            return kept
        a, b, used_up = left, right, 1 << 60
        good = True
        while True:
            step = self.joined.get((a, b))
            if step is not None and step < used_up:
                good = False
                break
            if self.born[a] > self.born[b]:
                used_up = self.born[a]
                a = self.halves[a][1]
            elif self.halves[b] is not None:
                used_up = self.born[b] + 1
                b = self.halves[b][0]
            else:
                break
        if len(self.adjacent) > 2_000_000:
            self.adjacent.clear()
        self.adjacent[key] = good
        return good

    def learn(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Encode words spelled in byte letters; those with a common beginning share its states."""
        endings, may_touch, learned = self.endings, self.may_touch, {}
        before, last, back = "", [-1], [0]
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                fits = []
                start = end - 1
                while start >= 0:
                    i = endings.get(word[start:end])
                    if i is None:
                        break
                    if i >= 0:
                        fits.append((i, start))
                    start -= 1
                for i, start in reversed(fits):
                    if start == 0 or may_touch(last[start], i):
                        last.append(i)
                        back.append(start)
                        break
            out, at = [], len(word)
            while at:
                out.append(last[at])
                at = back[at]
            learned[word] = tuple(out[::-1])
            before = word
        return learned

    def encode_batch(self, texts: Iterable[str | None]) -> list[list[int]]:
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        new = {w for words in cut for w in words if w not in self.known}
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known.clear()
            new = {w for words in cut for w in words}
        names = {w: w.encode("utf-8", "replace").decode("latin-1").translate(self.letters) for w in new}
        learned = self.learn(set(names.values()))
        for w, n in names.items():
            self.known[w] = learned[n]
        known = self.known
        return [[i for w in words for i in known[w]] for words in cut]


_LOADED: dict[str, PrefixBPE] = {}


def tokenizer(name: str = "byte_bpe_50k", directory: str = TOKENIZERS) -> PrefixBPE:
    path = f"{directory}/{name}.json"
    if path not in _LOADED:
        _LOADED[path] = PrefixBPE(path)
    return _LOADED[path]


def _slices(frame: pd.DataFrame, chars: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Cut a batch so that a slice holds about ``chars`` characters, or one text."""
    ends = frame["text"].str.len().fillna(0).cumsum()
    for _, part in frame.groupby((ends // chars).astype(int), sort=True):
        yield part


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", directory: str = TOKENIZERS) -> DataFrame:
    """(``key``, ids): the token ids of every text, special tokens' strings taken as ordinary text.

    A null and an empty text give an empty list.  Nothing is shuffled (unless the input has fewer
    partitions than there are cores); each worker shares prefixes among all it has seen.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(name, directory)
        for frame in frames:
            for part in _slices(frame):
                yield pd.DataFrame({key: part[key], "ids": [np.array(x, np.int32) for x in bpe.encode_batch(part["text"])]})

    rows = spread(df.select(F.col(key), F.col(text).alias("text")), key)
    return rows.mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, ids array<int>")


def lengths(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", directory: str = TOKENIZERS) -> DataFrame:
    """(``key``, tokens): the number of ids of every text, without sending the ids themselves."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(name, directory)
        for frame in frames:
            for part in _slices(frame):
                yield pd.DataFrame({key: part[key], "tokens": [len(x) for x in bpe.encode_batch(part["text"])]})

    rows = spread(df.select(F.col(key), F.col(text).alias("text")), key)
    return rows.mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, tokens int")
