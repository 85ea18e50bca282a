"""Vectorised cutting of text into units, and a table of their hashes."""

from __future__ import annotations

import numpy as np

# Classes of bytes: blank, letter, digit, sign, and others, which keep the
# chunk they are in whole.
_BLANK, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[[0x20, 0x0A]] = _BLANK
_CLASS[ord("0"):ord("9") + 1] = _DIGIT
_CLASS[ord("a"):ord("z") + 1] = _CLASS[ord("A"):ord("Z") + 1] = _LETTER
_CLASS[ord("'")] = _OTHER  # contractions
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


class HashIndex:
    """Numbers distinct 64-bit hashes in the order of their addition: an open
    hash table with linear probing, in arrays."""

    def __init__(self, slots: int = 1 << 22) -> None:
        self.mask = slots - 1
        self.slot = np.full(slots, -1, dtype=np.int32)
        self.hash = np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.hash)

    def _home(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(self.mask)).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        """Adds distinct hashes that aren't there; fewer than the slots in all."""
        todo = np.arange(len(self.hash), len(self.hash) + len(hashes), dtype=np.int32)
        self.hash = np.concatenate([self.hash, hashes])
        s = self._home(hashes)
        while len(todo):
            free = self.slot[s] < 0
            self.slot[s[free]] = todo[free]
            lost = self.slot[s] != todo
            todo, s = todo[lost], s[lost] + 1 & self.mask

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each hash, -1 where it isn't there."""
        if not len(self.hash):
            return np.full(len(hashes), -1, dtype=np.int32)
        s = self._home(hashes)
        k = self.slot[s]
        at = np.flatnonzero((self.hash[k] != hashes) & (k >= 0))
        while len(at):
            s[at] = s[at] + 1 & self.mask
            k[at] = self.slot[s[at]]
            at = at[(self.hash[k[at]] != hashes[at]) & (k[at] >= 0)]
        return k

    def find_or_learn(self, hashes: np.ndarray, limit: int, learn, clear) -> np.ndarray:
        """Numbers of all hashes.  ``learn(new, at)`` is called with the distinct
        new ones and where each one stands, and must add them; beyond ``limit``
        entries ``clear()`` returns an empty index, which learns this call's."""
        index, k = self, self.find(hashes)
        miss = np.flatnonzero(k < 0)
        if len(miss):
            new, at = np.unique(hashes[miss], return_index=True)
            if len(index) + len(new) > limit:
                index, miss = clear(), np.arange(len(hashes))
                new, at = np.unique(hashes, return_index=True)
            learn(new, miss[at])
            k[miss] = index.find(hashes[miss])
        return k


def units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(bytes, start, end, first unit of each text)``: pieces that the
    tokenizer never joins.

    It lower-cases, drops white space and cuts between letters, single digits
    and runs of signs.  Here that is done for blank-separated chunks of ASCII
    and accented Latin letters; any other chunk is one unit as it stands.
    """
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    kind, low = _CLASS[raw], _LOWER[raw]
    lead = np.flatnonzero(raw == 0xC3)  # U+00C0 to U+00FF
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    big = lead[raw[lead + 1] < 0x9F] + 1
    low[big] += 32
    kind[np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))] = _OTHER  # special tokens' strings
    edge = np.flatnonzero(np.diff((kind != _BLANK).view(np.int8))) + 1
    lo, hi = edge[0::2], edge[1::2]
    odd = np.flatnonzero(kind == _OTHER)
    whole = np.zeros(len(lo), dtype=bool)
    whole[np.searchsorted(lo, odd, side="right") - 1] = True
    cut = np.zeros(len(raw), dtype=bool)
    cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    cut &= kind != _BLANK
    if whole.any():
        lo, size = lo[whole], (hi - lo)[whole]
        inner = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        cut[inner] = False
        low[inner] = raw[inner]
        cut[lo] = True
    start = np.flatnonzero(cut)
    nxt = np.append(start[1:], len(raw))
    gap = np.append(edge[1::2], len(raw))  # a unit ends at the next unit or at the end of its chunk
    end = np.minimum(nxt, gap[np.searchsorted(gap, start, side="right")])
    offset = np.cumsum([0] + [len(t) + 1 for t in texts])
    return low, start, end, np.searchsorted(start, offset + 1)
