"""Byte-level BPE ids of many texts at once.

The usual pre-token pattern (contractions, runs of letters, digits or other signs with one leading blank, white space) is found by numpy
over whole Arrow batches; each distinct pre-token is merged once a worker and then looked up by hash. Texts where the pattern needs a
full regular expression (contractions, code points that Unicode versions may class differently) go to the tokenizer whole. The ids are
those of the tokenizer itself; tests/llm compares them.
"""

from __future__ import annotations

import base64
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa

from . import textvec as tv

U = np.uint64
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 1 << 19
_SPACE, _LETTER, _DIGIT, _OTHER, _UNSURE = range(5)
_WHITE = {9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
_RAW = tv._VALUES.copy()
_RAW[0] = U(0x5851F42D4C957F2D)
_CLASSES: np.ndarray | None = None
_ENGINES: dict[int, "Engine"] = {}


def _classes() -> np.ndarray:
    global _CLASSES
    if _CLASSES is None:
        t = np.full(0x110000, _UNSURE, np.uint8)
        for c in range(0x10000):
            kind = unicodedata.category(chr(c))
            if c in _WHITE:
                t[c] = _SPACE
            elif kind != "Cn":
                t[c] = {"L": _LETTER, "N": _DIGIT}.get(kind[0], _OTHER)
        _CLASSES = t
    return _CLASSES


def read_vocabulary(path: str) -> bytes:
    """The vocabulary file, read on the driver; executors get it by broadcast (a few MB whatever the input)."""
    with open(path, "rb") as f:
        return f.read()


def engine(vocabulary: bytes) -> "Engine":
    key = hash(vocabulary)
    if key not in _ENGINES:
        _ENGINES.clear()  # a worker that goes on to another vocabulary is done with the last
        _ENGINES[key] = Engine(vocabulary)
    return _ENGINES[key]


class Engine:
    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(t): int(i) for t, i in (line.split() for line in vocabulary.splitlines() if line)}
        self.size = max(ranks.values()) + 1
        self.encoding = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(2 * CACHE, U)
        self.slots = np.zeros(2 * CACHE, np.int32)
        self.at = np.zeros(CACHE + 1, np.int64)
        self.pool = np.zeros(1 << 20, np.int32)
        self.known = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash in the cache, or -1."""
        mask = len(self.keys) - 1
        slot = (h & U(mask)).astype(np.int64)
        got = np.full(len(h), -1, np.int32)
        here = self.keys[slot]
        hit = here == h
        got[hit] = self.slots[slot[hit]]
        live = np.flatnonzero(~hit & (here != 0))
        while len(live):
            slot[live] = (slot[live] + 1) & mask
            here = self.keys[slot[live]]
            hit = here == h[live]
            got[live[hit]] = self.slots[slot[live[hit]]]
            live = live[~hit & (here != 0)]
        return got

    def _add(self, h: np.ndarray, ids: list[list[int]]) -> None:
        """Put distinct new hashes and their ids into the cache."""
        n, size = self.known, np.fromiter(map(len, ids), np.int64, len(ids))
        self.at[n + 1 : n + 1 + len(h)] = self.at[n] + np.cumsum(size)
        end = int(self.at[n + len(h)])
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(end, len(self.pool)), np.int32)])
        self.pool[self.at[n] : end] = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))
        mask = len(self.keys) - 1
        slot, number = (h & U(mask)).astype(np.int64), np.arange(n, n + len(h), dtype=np.int32)
        while len(h):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.slots[slot[put]] = h[put], number[put]
            left = np.ones(len(h), bool)
            left[put] = False
            h, slot, number = h[left], (slot[left] + 1) & mask, number[left]
        self.known = n + len(size)

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of the texts off[i]:off[i + 1] of buf."""
        n = len(off) - 1
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        at = np.flatnonzero((buf & 0xC0) != 0x80)
        cp = buf[at].astype(np.uint32) if len(at) == len(buf) else np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kind = _classes()[cp]
        first = np.searchsorted(at, off)  # of each text, in code points
        head = np.zeros(len(cp) + 1, bool)
        head[first] = True
        head = head[:-1]
        turn = np.empty(len(cp), bool)
        turn[0] = True
        turn[1:] = kind[1:] != kind[:-1]
        turn |= head
        before = np.empty(len(cp), np.uint32)
        before[0] = 0
        before[1:] = cp[:-1]
        before[head] = 0
        mark = turn & ~((kind != _SPACE) & (before == 32))
        # the last white space before a run of anything else
        follow = np.flatnonzero(turn & ~head & (kind != _SPACE))
        follow = follow[kind[follow - 1] == _SPACE]
        mark[follow - 1] = True
        # texts that need the tokenizer's own pattern
        odd = np.flatnonzero(kind == _UNSURE)
        quote = np.flatnonzero((cp == 39) & mark)
        quote = quote[quote + 1 < len(cp)]
        quote = quote[np.isin(cp[quote + 1], [ord(c) for c in "stmdrvl"]) & ~head[quote + 1]]
        rows = np.unique(np.searchsorted(first, np.concatenate([odd, quote]), "right") - 1)
        for r in rows:
            mark[first[r] : first[r + 1]] = False
            mark[first[r]] = True
        start = np.flatnonzero(mark)
        row = np.searchsorted(start, first)
        s = at[start]
        e = np.append(s[1:], len(buf))
        up, down = tv._powers(len(buf) + 1)
        total = np.zeros(len(buf) + 1, U)
        np.cumsum(_RAW[buf] * up[: len(buf)], out=total[1:])
        h = tv.mix((total[e] - total[s]) * down[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93)) | U(1)
        whole = np.zeros(len(h), bool)
        whole[row[rows]] = True
        h[whole] ^= U(0xA0761D6478BD6420)
        if self.known and self.known + len(h) > CACHE and self.known + (new := len(np.unique(h[self._find(h) < 0]))) > CACHE:
            self._clear()
        number = self._find(h)
        fresh, place = np.unique(h[number < 0], return_index=True)
        if self.known + len(fresh) > CACHE:  # more distinct pre-tokens than the cache holds: halve the work
            half = n // 2
            if not half:
                ids = np.array(self.encoding.encode_ordinary(buf.tobytes().decode()), np.int32)
                return ids, np.array([0, len(ids)])
            a, ao = self.encode(buf[: off[half]], off[: half + 1])
            b, bo = self.encode(buf[off[half] :], off[half:] - off[half])
            return np.concatenate([a, b]), np.concatenate([ao, bo[1:] + ao[-1]])
        if len(fresh):
            places = np.flatnonzero(number < 0)[place]
            single, full = self.encoding._encode_single_piece, self.encoding.encode_ordinary
            raw = buf.tobytes()
            found = [full(raw[i:j].decode()) if w else single(raw[i:j]) for i, j, w in zip(s[places].tolist(), e[places].tolist(), whole[places].tolist())]
            self._add(fresh, found)
            number = self._find(h)
        begin = self.at[number]
        size = self.at[number + 1] - begin
        cum = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=cum[1:])
        ids = self.pool[np.arange(cum[-1]) + np.repeat(begin - cum[:-1], size)]
        return ids, cum[row]


def encode_column(column: pa.Array, vocabulary: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of a string column; null is like empty."""
    e = engine(vocabulary)
    ids, offs, total = [], [np.zeros(1, np.int64)], 0
    for _, buf, off in tv.pieces(column, 1 << 20):
        i, o = e.encode(buf, off)
        ids.append(i)
        offs.append(o[1:] + total)
        total += len(i)
    return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), np.concatenate(offs)
