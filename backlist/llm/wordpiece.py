"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary's trie gets failure links: from a node, the state reached
after giving out the longest pieces that its string starts with, together
with the number of those pieces.  A word is then counted in one pass over its
bytes; no piece is ever built.  A word that can't be cut into pieces is one
unknown token.

The vocabulary is that of a byte-level BPE file: entries with the leading
blank mark are initial pieces, all others continue a word.  The automaton is
built once from the file, so its size depends on the vocabulary alone.

Defined cases: null and blank texts have no tokens; repeated rows are counted
row by row; words are runs of bytes other than ASCII white space, of any
length, in texts of any length; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backlist.llm.common import blocks, encoded, map_arrow, word_hashes, word_spans
from backlist.llm.text import HashIndex

KNOWN_WORDS = 1_000_000  # words whose counts a worker remembers before it starts anew
_LOADED: dict[str, tuple] = {}


def _byte_of() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for
    themselves, the other bytes for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """``(initial pieces, continuing pieces)`` of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", [])}
    byte = _byte_of()
    pieces = [bytes(byte[c] for c in t) for t in model["model"]["vocab"] if t not in special]
    return [p[1:] for p in pieces if p[:1] == b" " and len(p) > 1], [p for p in pieces if p[:1] != b" "]


class Automaton:
    """States are trie nodes: 0 before a word, 1 within it."""

    def __init__(self, initial: list[bytes], continuing: list[bytes]) -> None:
        self.next: dict[int, int] = {}  # state * 256 + byte -> state
        final, parent = [False, False], [None, None]
        for root, pieces in ((0, initial), (1, continuing)):
            for p in pieces:
                s = root
                for c in p:
                    t = self.next.get(s << 8 | c)
                    if t is None:
                        t = self.next[s << 8 | c] = len(final)
                        final.append(False)
                        parent.append((s, c))
                    s = t
                final[s] = True
        depth = [0, 0]
        for at in parent[2:]:
            depth.append(depth[at[0]] + 1)
        self.fail: list[int] = [-1] * len(final)  # -1: no way on
        self.pops = [0] * len(final)
        for s in sorted(range(2, len(final)), key=depth.__getitem__):
            if final[s]:
                self.fail[s], self.pops[s] = 1, 1
                continue
            p, c = parent[s]
            n, z = self.pops[p], self.fail[p]
            while z >= 0 and (z << 8 | c) not in self.next:
                n, z = n + self.pops[z], self.fail[z]
            if z >= 0:
                self.fail[s], self.pops[s] = self.next[z << 8 | c], n

    def count(self, word: bytes) -> int:
        """Pieces of the word; 0 if it can't be cut."""
        go, fail, pops = self.next, self.fail, self.pops
        s = n = 0
        for c in word:
            t = go.get(s << 8 | c)
            while t is None:
                n += pops[s]
                s = fail[s]
                if s < 0:
                    return 0
                t = go.get(s << 8 | c)
            s = t
        while s > 1:
            n += pops[s]
            s = fail[s]
        return n if s == 1 else 0


class _Counts:
    def __init__(self, path: str) -> None:
        self.automaton = Automaton(*vocabulary(path))
        self.clear()

    def clear(self) -> HashIndex:
        self.known, self.pieces = HashIndex(), np.zeros(0, dtype=np.int64)
        return self.known


def text_counts(texts: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(words, tokens, unknown words)`` of each text."""
    if path not in _LOADED:
        _LOADED[path] = _Counts(path)
    state = _LOADED[path]
    buf, start, end, first = word_spans(texts)
    data = buf.tobytes()

    def learn(new, at):
        n = [state.automaton.count(data[s:e]) for s, e in zip(start[at].tolist(), end[at].tolist())]
        state.pieces = np.concatenate([state.pieces, np.array(n, dtype=np.int64)])
        state.known.add(new)

    k = state.known.find_or_learn(word_hashes(buf, start, end), KNOWN_WORDS, learn, state.clear)
    n = state.pieces[k]
    total = np.append(0, np.cumsum(np.maximum(n, 1)))[first]
    unknown = np.append(0, np.cumsum(n == 0))[first]
    return np.diff(first), np.diff(total), np.diff(unknown)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_words, n_tokens, n_unknown)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            cols = text_counts(encoded(b.column(1)), path)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c.astype(np.int64)) for c in cols]],
                                             ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run,
                     "doc_id long, n_words long, n_tokens long, n_unknown long")
