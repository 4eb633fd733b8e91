"""Token ids of whole texts, the same as one encode() call a text gives, by way of distinct pre-tokens."""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

KEPT = 500_000  # pre-tokens held at most; more only cost another encode()
GROUP = 256  # pre-tokens of one encode()

_BLANK = "\t\n\x0b\x0c\r \x85\xa0"
#: lower-casing these is one character to one, and composing them changes nothing
_PLAIN = [chr(c) for c in [*range(0x20, 0x7F), *range(0xA1, 0x180)] if c != 0x130] + list(_BLANK)
_of = lambda kind: "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == kind)
_ODD = re.compile(f"[^{''.join(map(re.escape, _PLAIN))}]|<\\|(?:start|end)oftext\\|>")
# the tokenizer file's own splitting pattern, over those characters
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_of('L')}]+|[{_of('N')}]|[^{re.escape(_BLANK)}{_of('L')}{_of('N')}]+")


class Encoder:
    """For a tokenizer that lower-cases, drops white space and splits as _SPLIT does (word_bpe_49k.json).

    Texts with other characters or with special tokens' names go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.closing = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closing[i] = token.endswith("</w>")
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.bounds = np.zeros(1, np.int64)

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has. Words go in groups with blanks between, which the tokenizer drops: each
        ends with the one token that closes a word."""
        groups = [words[i : i + GROUP] for i in range(0, len(words), GROUP)]
        ids, sizes = [], []
        for group, x in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            own = np.array(x.ids, np.uint32)
            last = np.flatnonzero(self.closing[own])
            if len(last) != len(group) or (len(own) and last[-1] != len(own) - 1):
                each = [y.ids for y in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]
                own = np.array([i for y in each for i in y], np.uint32)
                last = np.cumsum(list(map(len, each))) - 1
            ids.append(own)
            sizes.append(np.diff(last, prepend=-1))
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, words: list[str]) -> None:
        ids, sizes = self._ids(words)
        at = len(self.place)
        self.place.update(zip(words, range(at, at + len(words)), strict=True))
        self.flat = np.concatenate([self.flat, ids])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """An array of ids for each text."""
        parts = [None if _ODD.search(t) else _SPLIT.findall(t.lower()) for t in texts]
        new = set().union(*(p for p in parts if p)).difference(self.place)
        if new:
            if len(self.place) + len(new) > KEPT:
                self._clear()
                new = set().union(*(p for p in parts if p))
            self._learn(sorted(new))
        out = []
        for text, words in zip(texts, parts, strict=True):
            if words is None:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
                continue
            at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
            first, size = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
            total = int(size.sum())
            out.append(self.flat[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(total)])
        return out


_held: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each path in a worker, kept between tasks."""
    if path not in _held:
        _held[path] = Encoder(path)
    return _held[path]
