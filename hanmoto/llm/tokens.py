"""Token ids of whole texts by a public tokenizer file, with a bounded cache of words.

A text is cut where the tokenizer's own first step cuts, and equal pieces are encoded once. Texts of Latin letters are cut all the
way, into words, numbers and marks; others only at white space, before the last blank of a run. Before that a text is cut at the strings of
added tokens, which the library gives their own ids wherever they stand. The ids are those of the whole text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np

#: White space as Unicode has it (Python's own class has four more characters).
SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: For byte-level vocabularies blanks belong to tokens; for vocabularies with word ends they are dropped.
PIECES = {"byte": re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"), "word": re.compile(f"[^{SPACE}]+")}
#: Below U+0250 there are these letters, numbers and white space, nothing to compose, and lower case is by character.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN = {
    "byte": re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"),
    "word": re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+"),
}
_OTHER = re.compile("[^\x00-\u024f]|\u0130")
#: Characters of text encoded at a time; words and characters that the cache may hold.
CHUNK, WORDS, CHARS = 1 << 19, 300_000, 1 << 23


def _beyond_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
        return False
    except UnicodeEncodeError:
        return _OTHER.search(text) is not None


class _Codes(dict):
    """Gives every new word the next number and remembers it as not yet encoded."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile(f"({'|'.join(map(re.escape, added))})") if added else None
        self.kind = "word" if self.tokenizer.encode("a  b", add_special_tokens=False).ids == self.tokenizer.encode("a b", add_special_tokens=False).ids else "byte"
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if self.kind == "word":
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
            self.single = LATIN["word"].fullmatch
        else:
            self.ends[self.tokenizer.encode("\n", add_special_tokens=False).ids] = True
            self.single = re.compile(f" ?[^{SPACE}]+").fullmatch
        self._reset()

    def _reset(self) -> None:
        self.codes, self.chars = _Codes(), 0
        self.length, self.start, self.pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def _pieces(self, text: str) -> list[str]:
        if self.added and self.added.search(text):
            parts = self.added.split(text)
            return [p for i, x in enumerate(parts) for p in ([x] if i % 2 else self._ordinary(x))]
        return self._ordinary(text)

    def _ordinary(self, text: str) -> list[str]:
        if _beyond_latin(text):
            return PIECES[self.kind].findall(text)
        return LATIN[self.kind].findall(text.lower() if self.kind == "word" else text)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(length.sum())), length

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for single words, many in one call. The words' ends are seen by word-end ids or by line ends put between them."""
        gap = " " if self.kind == "word" else "\n"
        ids, _ = self._encoded([gap.join(words[i : i + 200]) + gap for i in range(0, len(words), 200)])
        last = np.flatnonzero(self.ends[ids])
        length = np.diff(last, prepend=-1)
        if len(length) != len(words) or (len(last) and last[-1] != len(ids) - 1):
            return self._encoded(words)
        return (ids, length) if self.kind == "word" else (ids[~self.ends[ids]], length - 1)

    def _learn(self) -> None:
        new, self.codes.new = self.codes.new, []
        if not new:
            return
        single = [bool(self.single(w)) and not (self.kind == "word" and _beyond_latin(w)) for w in new]
        start, length, pools, n = np.empty(len(new), np.int64), np.empty(len(new), np.int64), [self.pool], len(self.pool)
        for kind, encode in ((True, self._joined), (False, self._encoded)):
            if at := [i for i, s in enumerate(single) if s is kind]:
                ids, own = encode([new[i] for i in at])
                start[at], length[at] = n + np.cumsum(own) - own, own
                pools.append(ids)
                n += len(ids)
        self.start, self.length, self.pool = np.concatenate([self.start, start]), np.concatenate([self.length, length]), np.concatenate(pools)
        self.chars += sum(map(len, new))

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.codes) > WORDS or self.chars > CHARS:
            self._reset()
        pieces = [self._pieces(t) for t in texts]
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(pieces)), np.int64, int(counts.sum()))
        self._learn()
        length = self.length[codes]
        stop = np.cumsum(length)
        ids = self.pool[np.repeat(self.start[codes] - stop + length, length) + np.arange(int(stop[-1]) if len(stop) else 0)]
        ends = np.concatenate([[0], stop])[np.cumsum(counts)]
        return np.insert(ids, ends, np.uint32(self.end_id)), ends + np.arange(1, len(texts) + 1)

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, with the end id."""
        group, size = [], 0
        for i, t in enumerate(texts):
            group.append(t or "")
            size += len(group[-1])
            if size >= CHUNK or i == len(texts) - 1:
                ids, ends = self._encode(group)
                yield from np.split(ids, ends[:-1])
                group, size = [], 0


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> Encoder:
    """One for each worker process."""
    return Encoder(path, end_id)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
