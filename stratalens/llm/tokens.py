"""Token ids from a public vocabulary through the tokenizers library, fast enough for whole corpora.

Byte-level BPE never merges across pre-tokens, so the ids of a text are the ids of its pre-tokens in order. Most
pre-tokens repeat: each distinct one goes through the library's model once and comes from a bounded table afterwards.
Texts are split here, many at a time in NumPy, only if the classes of all their characters are certain and no apostrophe
could begin a contraction; any other text, and one that holds an added token, goes through the library whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from operator import attrgetter

import numpy as np

#: Outside of these characters, and after an apostrophe, letters, digits and spaces are left to the library.
_UNSURE = re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]|'(?=[stmd]|re|ve|ll)")
_LAST = 0x20C0
_END, _LETTER, _DIGIT, _OTHER, _SPACE = range(5)
#: Characters of texts that are split at a time, and distinct pre-tokens that a worker remembers; then it starts afresh.
CHARS, TABLE_BITS = 1 << 18, 21
#: Longer pre-tokens are not remembered.
LONGEST = 32
_ODD = 0x9E3779B97F4A7C15
_ID = attrgetter("id")


def _classes() -> np.ndarray:
    """The class of each sure character, by its Unicode category; the last entry ends a text."""
    kinds = {"L": _LETTER, "N": _DIGIT}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(_LAST)] + [_END], np.uint8)
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = _SPACE
    return out


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies spell a byte as a printable letter: itself where printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path or default_path())
        #: The library finds added tokens before it splits a text.
        added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.unsure = re.compile("|".join([_UNSURE.pattern, *map(re.escape, added)]))
        self.letters, self.tokenize = _byte_letters(), self.lib.model.tokenize
        self.classes, self.up, self.down = _classes(), _powers(_ODD, 2 * CHARS), _powers(pow(_ODD, -1, 1 << 64), 2 * CHARS)
        self._forget()

    def _forget(self) -> None:
        n = 1 << TABLE_BITS
        self.keys, self.place, self.size = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.pool, self.filled, self.entries = np.zeros(n, np.uint32), 0, 0

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _pretoken(self, part: str) -> list[int]:
        if part.isascii() and part.isprintable():  # only the space is spelled otherwise
            spelled = part.replace(" ", self.letters[32])
        else:
            spelled = part.encode().decode("latin-1").translate(self.letters)
        return list(map(_ID, self.tokenize(spelled)))

    def _keep(self, ids: list[int]) -> int:
        """The place of new ids in the pool."""
        at, end = self.filled, self.filled + len(ids)
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[at:end] = ids
        self.filled = end
        return at

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The table's slot of each hash; -1 where it has none. Slots are probed one after the other."""
        mask = len(self.keys) - 1
        slot = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        got = self.keys[slot]
        out = np.where(got == h, slot, -1)
        open_ = np.flatnonzero((got != h) & (got != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            got = self.keys[slot[open_]]
            hit = got == h[open_]
            out[open_[hit]] = slot[open_[hit]]
            open_ = open_[~hit & (got != 0)]
        return out

    def _learn(self, h: int, part: str) -> None:
        slot, mask = h >> (64 - TABLE_BITS), len(self.keys) - 1
        while self.keys[slot]:
            slot = (slot + 1) & mask
        ids = self._pretoken(part)
        self.keys[slot], self.place[slot], self.size[slot] = h, self._keep(ids), len(ids)
        self.entries += 1

    def _split(self, joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code points, classes, starts of pre-tokens) of texts that each end with chr(_LAST), an end being one of its own.

        A run of spaces gives its last one to a word that follows: as the word's own beginning if it is a plain space,
        else as a pre-token of its own.
        """
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        c = self.classes[cp]
        before, after = np.empty_like(c), np.empty_like(c)
        before[0], before[1:] = _END, c[:-1]
        after[-1], after[:-1] = _END, c[1:]
        plain = np.empty(len(c), bool)
        plain[0], plain[1:] = False, cp[:-1] == 32
        word = (c != before) & ~plain
        last = (before != _SPACE) | (after != _SPACE) & (after != _END)
        start = np.where(c == _SPACE, last, word | (c == _END))
        return cp, c, np.flatnonzero(start)

    def _many(self, texts: list[str]) -> list[np.ndarray]:
        joined = chr(_LAST).join(texts) + chr(_LAST)
        cp, c, at = self._split(joined)
        v = (cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        v ^= v >> np.uint64(32)
        n = len(cp)
        up, down = (self.up, self.down) if n <= len(self.up) else (_powers(_ODD, n), _powers(pow(_ODD, -1, 1 << 64), n))
        v *= up[:n]
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(v, out=total[1:])
        ends = np.append(at[1:], n)
        h = (total[ends] - total[at]) * down[at]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h |= np.uint64(1)  # 0 is an empty slot
        is_end, long = c[at] == _END, ends - at > LONGEST
        if self.entries > len(self.keys) * 5 // 8:
            self._forget()
        slot = self._find(h)
        place, size = self.place[slot], self.size[slot]
        size[is_end] = 0
        new = np.flatnonzero((slot < 0) & ~is_end & ~long)
        if len(new):
            _, first = np.unique(h[new], return_index=True)
            first = new[first]
            for k, s, e in zip(h[first].tolist(), at[first].tolist(), ends[first].tolist()):
                self._learn(k, joined[s:e])
            slot = self._find(h[new])
            place[new], size[new] = self.place[slot], self.size[slot]
        for i in np.flatnonzero(long & ~is_end).tolist():
            ids = self._pretoken(joined[at[i] : ends[i]])
            place[i], size[i] = self._keep(ids), len(ids)
        done = np.cumsum(size)
        ids = self.pool[np.repeat(place - (done - size), size) + np.arange(done[-1])]
        return np.split(ids, done[is_end])[:-1]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as little-endian uint32; none for null or empty."""
        out: list = [np.zeros(0, "<u4")] * len(texts)
        held, chars = [], 0

        def flush():
            nonlocal held, chars
            for i, ids in zip(held, self._many([texts[i] for i in held])):
                out[i] = ids
            held, chars = [], 0

        for i, text in enumerate(texts):
            if not text:
                continue
            if self.unsure.search(text):
                out[i] = np.frombuffer(self._whole([text])[0], "<u4")
                continue
            if held and chars + len(text) > CHARS:
                flush()
            held.append(i)
            chars += len(text) + 1
        if held:
            flush()
        return out
