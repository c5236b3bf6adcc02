"""Batch encoding with the tokenizers library.

A byte-level BPE splits text before it merges, and never across the edge from a character that isn't white space to an
ASCII white space. Text is therefore cut at those edges into chunks; each distinct chunk is encoded once by the library
and its ids are kept in a bounded table by its bytes. The ids equal those of encoding the whole text (tests compare
them); texts with the string of an added token, such as the end of text, are encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

from codeloom.llm.common import KEPT, numbered, utf8

#: Texts with other white space than ASCII are encoded whole, too.
_OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
MOST_CHUNKS, STEP_BYTES, JOINED = 1 << 19, 4 << 20, 256


class Encoder:
    """encode(texts): for each text its ids as an array; a null text has none."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [_OTHER_SPACE.pattern, *(re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values())]
        self.by_itself = re.compile("|".join(added))
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a token of this vocabulary has one letter a byte
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)
        self._reset()

    def _reset(self) -> None:
        """A chunk has length[slot[chunk]] ids from flat[start[slot[chunk]]]."""
        self.slot, self.used = {}, 0
        self.flat, self.start, self.length = np.zeros(1 << 20, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self._ids(texts)]

    def _learn(self, chunks: list[bytes]) -> list[int]:
        """Encode chunks joined into longer texts, which is exact as all but the first start with white space, and cut
        the ids where the bytes of the chunks end. Their places in the table."""
        joins = [bool(c) and _SPACE[c[0]] and bool(c.strip()) for c in chunks]
        by = sorted(range(len(chunks)), key=joins.__getitem__)
        alone = len(by) - sum(joins)
        chunks = [chunks[k] for k in by]
        texts = chunks[:alone] + [b"".join(chunks[k : k + JOINED]) for k in range(alone, len(chunks), JOINED)]
        ids = np.array([i for x in self._ids([t.decode("utf-8", "surrogatepass") for t in texts]) for i in x], np.uint32)
        cuts = np.r_[0, np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))) + 1]
        while self.used + len(ids) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        self.flat[self.used : self.used + len(ids)] = ids
        places = [0] * len(by)
        for at, k in enumerate(by, len(self.start)):
            places[k] = at
        self.slot.update(zip(chunks, range(len(self.start), len(self.start) + len(chunks))))
        self.start, self.length = np.r_[self.start, self.used + cuts[:-1]], np.r_[self.length, np.diff(cuts)]
        self.used += len(ids)
        return places

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        size = begin = 0
        for k, t in enumerate(texts):
            size += len(t or "")
            if size > STEP_BYTES or k == len(texts) - 1:
                out += self._step(texts[begin : k + 1])
                size, begin = 0, k + 1
        return out

    def _step(self, texts: list[str | None]) -> list[np.ndarray]:
        whole = [k for k, t in enumerate(texts) if t and self.by_itself.search(t)]
        own = [utf8(t) for t in texts]
        for k in whole:
            own[k] = b""
        joined = b"".join(own)
        data = np.frombuffer(joined, np.uint8)
        edges = np.cumsum([0, *map(len, own)])
        out = [np.zeros(0, np.uint32)] * len(texts)
        if len(data):
            space = _SPACE[data]
            begins = np.r_[True, space[1:] & ~space[:-1]]
            begins[edges[:-1][edges[:-1] < len(data)]] = True
            start = np.flatnonzero(begins)
            back, chunks = numbered(joined, np.r_[start[1:], len(data)])
            slots = list(map(self.slot.get, chunks))
            new = [k for k, at in enumerate(slots) if at is None]
            if new and len(self.slot) + len(new) > MOST_CHUNKS:
                self._reset()
                new = range(len(chunks))
            if new:
                for k, at in zip(new, self._learn([chunks[k] for k in new])):
                    slots[k] = at
            slot = np.array(slots, np.int64)[back]
            length = self.length[slot]
            ends = np.cumsum(length)
            ids = self.flat[np.repeat(self.start[slot] - ends + length, length) + np.arange(ends[-1])]
            at = np.r_[0, ends][np.searchsorted(start, edges)]
            out = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        for k in whole:
            out[k] = self._whole([texts[k]])[0]
        return out


_ENCODERS: dict[str, Encoder] = KEPT.setdefault("encoders", {})


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
