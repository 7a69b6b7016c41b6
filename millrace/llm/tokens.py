"""Whole-text token ids from public tokenizers, with a bounded cache of pre-tokens: the ids are exactly those of the library for the whole text."""

from __future__ import annotations

import collections
import itertools
import os
import re

import numpy as np

# Letters, digits and white space among the characters up to U+017F, as in the tokenizers' own patterns. Texts with any other
# character (or with one of those whose class or lower case is in doubt) are encoded whole by the library.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t-\r "
UNSURE = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-įı-ňŊ-ž]")
_SUFFIX = "'s|'t|'re|'ve|'m|'ll|'d"
PATTERNS = {
    "byte": re.compile(f"{_SUFFIX}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"),
    "word": re.compile(f"{_SUFFIX}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+"),
}
SPECIAL = re.compile(r"<\|\w+\|>")


class WordTokenizer:
    """Encodes texts by their pre-tokens. kind "byte": byte-level BPE. kind "word": word-end BPE over lower-case text without white space.

    A pre-token's ids don't depend on its neighbours, so each is encoded once, many in one string, and kept under a number; a text is a gather over numbers. The cache is emptied at `most` pre-tokens, so memory is bounded by words and not by texts.
    """

    def __init__(self, path: str, kind: str, most: int = 1_100_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t, self.kind, self.most = Tokenizer.from_file(path), kind, most
        self.size = self.t.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.size <= 65_536 else np.dtype("<u4")
        #: Tokens that begin (byte: with a blank) or end (word) a pre-token.
        self.edge = np.zeros(self.size, bool)
        for token, i in self.t.get_vocab().items():
            self.edge[i] = token.startswith("Ġ") if kind == "byte" else token.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = collections.defaultdict(itertools.count().__next__)
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0
        self.start, self.length = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each pre-token."""
        out: list = [None] * len(words)
        if self.kind == "byte":
            joint = [i for i, w in enumerate(words) if w[0] == " " and len(w) > 1 and not w[1].isspace()]
        else:
            joint = list(range(len(words)))
        alone = sorted(set(range(len(words))) - set(joint))
        groups = [joint[i : i + 256] for i in range(0, len(joint), 256)]
        glue = "" if self.kind == "byte" else " "
        for group, ids in zip(groups, self.whole([glue.join(words[i] for i in g) for g in groups])):
            at = np.flatnonzero(self.edge[ids])
            cuts = at[1:] if self.kind == "byte" else at[:-1] + 1
            if len(at) == len(group):
                for i, x in zip(group, np.split(ids, cuts)):
                    out[i] = x
            else:
                alone += group
        for i, x in zip(alone, self.whole([words[i] for i in alone])):
            out[i] = x
        return out

    def _learn(self, known: int) -> None:
        """Encodes the pre-tokens numbered from known on."""
        n = len(self.number)
        words = list(itertools.islice(reversed(self.number), n - known))[::-1]
        parts = self._encoded(words)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        while n > len(self.start):
            self.start, self.length = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.length, np.zeros_like(self.length)])
        total = int(lengths.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = np.concatenate(parts)
        self.length[known:n] = lengths
        self.start[known:n] = self.used + np.cumsum(lengths) - lengths
        self.used += total

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as arrays of self.dtype."""
        find, lower = PATTERNS[self.kind].findall, self.kind == "word"
        out: list = [None] * len(texts)
        sure, parts = [], []
        for i, text in enumerate(texts):
            if UNSURE.search(text) or "<|" in text and SPECIAL.search(text):
                out[i] = self.whole([text])[0]
            else:
                sure.append(i)
                parts.append(find(text.lower() if lower else text))
        if len(self.number) > self.most:
            self.forget()
        known, n = len(self.number), sum(map(len, parts))
        numbers = np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(parts)), np.int64, n)
        if len(self.number) > known:
            self._learn(known)
        lengths = self.length[numbers]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if n else 0
        places = np.arange(total)
        places += np.repeat(self.start[numbers] - ends + lengths, lengths)
        ids = self.flat.take(places)
        at = np.concatenate([[0], ends])[np.cumsum([0, *map(len, parts)])]
        for i, a, b in zip(sure, at[:-1].tolist(), at[1:].tolist()):
            out[i] = ids[a:b]
        return out


_KEPT: dict[tuple[str, str], WordTokenizer] = {}


def tokenizer(path: str, kind: str) -> WordTokenizer:
    """One for each Python worker: its cache serves the tasks that follow."""
    if (path, kind) not in _KEPT:
        _KEPT[path, kind] = WordTokenizer(path, kind)
    return _KEPT[path, kind]


def batches(texts: list, most_chars: int = 1_000_000):
    """Slices of texts of about most_chars characters, so that a batch of long texts takes no more memory than one of short ones."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= most_chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
