"""Byte-level BPE ids of many texts: words are split in numpy, each distinct word is encoded once."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

from workweave.llm.words import run_hash

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Texts with code points from here on go through the tokenizer whole.
PLAIN = 0x2E80
#: Distinct words kept by a task's process; then it starts anew.
KEPT = 600_000

# The endings that a byte-level BPE splits off after an apostrophe, and white space.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
         0x202F, 0x205F]


def _alphabet() -> dict[int, str]:
    """Bytes as the visible characters under which a byte-level vocabulary lists them."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(0x100) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


ALPHABET = _alphabet()


def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    found = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(PLAIN)],
                     dtype=np.uint8)
    found[WHITE] = SPACE
    return found


class Tokens:
    """An encoder with the words it has met."""

    _known: dict[str, Tokens] = {}

    @classmethod
    def of(cls, path: str) -> Tokens:
        """The encoder of this process for a tokenizer file."""
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        # names that the tokenizer knows as one token wherever they stand, cut out before words
        self.names = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.classes = _classes()
        self._forget()

    def _forget(self) -> None:
        self.at: dict[int, int] = {}
        self.ids: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)]
        self.first = np.zeros(1, dtype=np.int64)

    def split(self, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words of texts that stand end to end from ``at`` on."""
        n = codes.size
        kind = self.classes[codes]
        opens = np.zeros(n + 1, dtype=bool)
        opens[at] = True
        space = kind == SPACE
        blank = codes == 0x20
        new = opens[:n].copy()
        after = np.zeros(n, dtype=bool)  # the next code point is of the same text and no space
        after[:-1] = ~space[1:] & ~opens[1:n]
        change = np.zeros(n, dtype=bool)
        change[1:] = kind[1:] != kind[:-1]
        led = np.zeros(n, dtype=bool)  # a blank before it belongs to the word
        led[1:] = blank[:-1] & ~opens[1:n]
        new |= ~space & change & ~led
        new |= space & (change | after)
        quotes = np.flatnonzero((codes == 0x27) & new)
        for ending in ENDINGS:
            size = len(ending) + 1
            q = quotes[quotes + size <= n]
            for k, letter in enumerate(ending, 1):
                q = q[(codes[q + k] == ord(letter)) & ~opens[q + k]]
            new[q + 1] = False
            beyond = q + size
            new[beyond[beyond < n]] = True
            # a blank's word begins at the blank: its first letter does not
            quotes = np.setdiff1d(quotes, q, assume_unique=True)
        starts = np.flatnonzero(new)
        return starts, np.append(starts[1:], n)

    def _encode_words(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray
                      ) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has."""
        values, where, back = np.unique(run_hash(codes.astype(np.uint64) + np.uint64(1), starts,
                                                 ends), return_index=True, return_inverse=True)
        if len(self.at) > KEPT:
            self._forget()
        known = self.at
        place = np.array([known.get(v, -1) for v in values.tolist()], dtype=np.int64)
        fresh = np.flatnonzero(place < 0)
        if fresh.size:
            texts = [codes[a:b].tobytes().decode("utf-32-le")
                     for a, b in zip(starts[where[fresh]], ends[where[fresh]], strict=True)]
            merge = self.model.model.tokenize
            found = [[t.id for t in merge(x.encode().decode("latin-1").translate(ALPHABET))]
                     for x in texts]
            base = self.first.size - 1
            place[fresh] = base + np.arange(fresh.size)
            known.update(zip(values[fresh].tolist(), place[fresh].tolist(), strict=True))
            self.ids.append(np.array([i for x in found for i in x], dtype=np.uint32))
            self.first = np.concatenate([
                self.first, self.first[-1] + np.cumsum([len(x) for x in found])])
        if len(self.ids) > 1:
            self.ids = [np.concatenate(self.ids)]
        begin, size = self.first[place][back], np.diff(self.first)[place][back]
        to = np.cumsum(size) - size
        index = np.arange(int(size.sum())) + np.repeat(begin - to, size)
        return self.ids[0][index], size

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with ``end`` after it, and where each begins."""
        strings = [t or "" for t in texts.to_pylist()]
        codes = np.frombuffer("".join(strings).encode("utf-32-le"), dtype=np.uint32)
        at = np.concatenate([[0], np.cumsum([len(t) for t in strings])]).astype(np.int64)
        most = np.zeros(len(strings), dtype=np.uint32)
        full = np.flatnonzero(np.diff(at))
        if full.size:
            most[full] = np.maximum.reduceat(codes, at[:-1][full])
        whole = most >= PLAIN
        for name in self.names:
            whole |= np.array([name in t for t in strings], dtype=bool)
        odd = {int(i): [*self.model.encode(strings[i], add_special_tokens=False).ids, end]
               for i in np.flatnonzero(whole)}
        if odd:  # what goes whole is taken out of the common run
            keep = np.repeat(~whole, np.diff(at))
            codes = codes[keep]
            at = np.concatenate([[0], np.cumsum(np.where(whole, 0, np.diff(at)))])
        starts, ends = self.split(codes, at)
        ids, size = self._encode_words(codes, starts, ends)
        reach = np.concatenate([[0], np.cumsum(size)])
        cuts = reach[np.searchsorted(starts, at)]
        count = np.diff(cuts) + 1
        for i, found in odd.items():
            count[i] = len(found)
        first = np.concatenate([[0], np.cumsum(count)])
        out = np.full(int(first[-1]), end, dtype=np.uint32)
        plain = np.arange(ids.size) + np.repeat(first[:-1] - cuts[:-1], np.diff(cuts))
        out[plain] = ids
        for i, found in odd.items():
            out[first[i]: first[i + 1]] = found
        return out, first
