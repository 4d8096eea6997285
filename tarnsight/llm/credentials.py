"""Secret scans by grammar inference.

Labelled credentials, one set for each format, become prefix trees; statistically compatible states are merged (ALERGIA: Hoeffding tests
on the stopping and every next symbol, checked along both subtrees, red-blue order) into one probabilistic automaton a format. A
candidate is any maximal run of credential characters of at least LEAST; each is scored by every format's automaton, smoothed by SMOOTH
of a uniform symbol, with the format's length distribution, against a background of pairs of characters learnt from other candidates.

Labels: candidates that the text assigns to a credential-like name (`token = "..."`, `password: ...`), the first TRAIN_ROWS of them by a
hash of their place, a documented bound; and generated examples of well-known public formats. The background's counts and all scores
cover all documents.

Output, a row for each candidate: doc_id, start (in characters), length, format (likeliest), format_bits and background_bits (bits a
character under either), log_odds (their difference), is_secret (log_odds of at least THRESHOLD). The text itself is never put out.

Defined results: null, empty and candidate-free texts give no rows; repeated rows and null doc_ids give theirs each. Candidates of any
length are scored whole, those of more than SHORT characters by a walk over the automata's joint states. Shorter runs than LEAST are no
candidates, whatever their name. Ties between formats go to the first name. An empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import random
import re
from collections import deque
from dataclasses import dataclass
from functools import lru_cache
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship, staged
from . import textvec as tv

LEAST = 16
SHORT = 256
TRAIN_ROWS = 600
EXAMPLES = 200
ALPHA = 1e-4
SMOOTH = 0.02
THRESHOLD = 0.5
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-."
_CODE = np.zeros(256, np.uint8)
for _i, _c in enumerate(SYMBOLS):
    _CODE[ord(_c)] = _i + 1
_INDEX = {c: i for i, c in enumerate(SYMBOLS)}
_N = len(SYMBOLS)
_NAME = re.compile(rb"(token|secret|passwd|password|api_?key|access_?key|auth)[a-z_]{0,20}[\"']?\s{0,3}[:=]\s{0,3}[\"']?$", re.I)
_LEADS = np.isin(np.arange(256), np.frombuffer(b"\"'=:", np.uint8))


def public_examples(n: int = EXAMPLES, seed: int = 5) -> dict[str, list[str]]:
    """Generated credentials of public formats."""
    rng = random.Random(seed)
    upper, digit = SYMBOLS[:26], SYMBOLS[52:62]
    word = SYMBOLS[:62]
    pick = lambda a, k: "".join(rng.choice(a) for _ in range(k))
    make = {
        "aws_access_key": lambda: rng.choice(("AKIA", "ASIA")) + pick(upper + "234567", 16),
        "github_token": lambda: rng.choice(("ghp_", "gho_", "ghs_")) + pick(word, 36),
        "google_api_key": lambda: "AIza" + pick(word + "_-", 35),
        "slack_token": lambda: rng.choice(("xoxb-", "xoxp-")) + pick(digit, 11) + "-" + pick(digit, 12) + "-" + pick(word, 24),
        "stripe_key": lambda: rng.choice(("sk_live_", "rk_live_")) + pick(word, 24),
        "jwt": lambda: "eyJ" + pick(word + "_-", rng.randint(20, 40)) + ".eyJ" + pick(word + "_-", rng.randint(40, 80)) + "." + pick(word + "_-", 43),
        "hex": lambda: pick("0123456789abcdef", rng.choice((32, 40, 64))),
        "base64": lambda: pick(word + "+/", 4 * rng.randint(8, 16) - 1),
    }
    return {k: [f() for _ in range(n)] for k, f in make.items()}


class _Tree:
    """A prefix tree of strings with counts, whose states ALERGIA merges in place."""

    def __init__(self, strings: list[str]):
        self.next: list[dict[int, int]] = [{}]
        self.arc: list[dict[int, int]] = [{}]  # how often each symbol follows: once merged, its state is reached by other ways too
        self.through, self.end = [0], [0]
        for s in strings:
            q = 0
            self.through[0] += 1
            for c in s:
                i = _INDEX[c]
                if i not in self.next[q]:
                    self.next[q][i] = len(self.next)
                    self.next.append({})
                    self.arc.append({})
                    self.through.append(0)
                    self.end.append(0)
                self.arc[q][i] = self.arc[q].get(i, 0) + 1
                q = self.next[q][i]
                self.through[q] += 1
            self.end[q] += 1

    def _differs(self, fa: int, na: int, fb: int, nb: int, alpha: float) -> bool:
        return abs(fa / na - fb / nb) > sqrt(0.5 * log(2 / alpha)) * (1 / sqrt(na) + 1 / sqrt(nb))

    def compatible(self, a: int, b: int, alpha: float) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.through[a], self.through[b]
            if 0.5 * log(2 / alpha) >= nb:
                continue  # too few to differ from anything, and below b there are fewer
            if self._differs(self.end[a], na, self.end[b], nb, alpha):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                x, y = self.next[a].get(c), self.next[b].get(c)
                if self._differs(self.arc[a].get(c, 0), na, self.arc[b].get(c, 0), nb, alpha):
                    return False
                if x is not None and y is not None and x != y:
                    todo.append((x, y))
        return True

    def fold(self, a: int, b: int) -> list[tuple[int, int, int]]:
        """Add b's subtree (a tree still) into a; the branches that hang on a new place."""
        todo, hung = [(a, b)], []
        while todo:
            a, b = todo.pop()
            self.through[a] += self.through[b]
            self.end[a] += self.end[b]
            for c, y in self.next[b].items():
                x = self.next[a].get(c)
                self.arc[a][c] = self.arc[a].get(c, 0) + self.arc[b][c]
                if x is None:
                    self.next[a][c] = y
                    hung.append((a, c, y))
                else:
                    todo.append((x, y))
        return hung


@lru_cache(64)
def infer(strings: tuple[str, ...], alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(transitions, log2 probabilities), states by symbols; -1 where a state has no such symbol. State 0 starts."""
    t = _Tree(list(strings))
    red, state_of = [0], {0: 0}
    blue = deque((0, c, y) for c, y in sorted(t.next[0].items()))
    while blue:
        q, c, y = blue.popleft()
        for r in red:
            if t.compatible(r, y, alpha):
                t.next[q][c] = r
                blue.extend(h for h in t.fold(r, y) if h[0] in state_of)
                break
        else:
            state_of[y] = len(red)
            red.append(y)
            blue.extend((y, c, z) for c, z in sorted(t.next[y].items()))
    move = np.full((len(red), _N), -1, np.int32)
    for i, q in enumerate(red):
        for c, y in t.next[q].items():
            move[i, c] = state_of[y]
    count = np.zeros(move.shape)
    for text in strings:
        q = 0
        for c in text:
            count[q, _INDEX[c]] += 1
            q = move[q, _INDEX[c]]
    share = count / np.maximum(count.sum(1, keepdims=True), 1)
    return move, np.log2((1 - SMOOTH) * share + SMOOTH / _N)


def _length_bits(hist: np.ndarray, size: np.ndarray) -> np.ndarray:
    """log2 probability of each length: the histogram, with a share of a law that any length has."""
    n = size.astype(float)
    seen = np.where(size < len(hist), hist[np.minimum(size, len(hist) - 1)], 0) / max(1, hist.sum())
    return np.log2((1 - SMOOTH) * seen + SMOOTH / (n * (n + 1)))


@dataclass
class Grammar:
    """Automata of all formats in one table; its last state is a sink of uniform symbols."""

    names: list[str]
    start: np.ndarray
    move: np.ndarray
    bits: np.ndarray
    lengths: np.ndarray  # format x length
    pairs: np.ndarray  # background: symbol before (the last row: none) x symbol
    other_lengths: np.ndarray

    def _rest(self, codes: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Each format's bits of the rest of a long candidate: one walk over the joint states of all formats, which are few where it goes."""
        joint, number, step = [state], {state.tobytes(): 0}, [[-1] * _N]
        q, path = 0, []
        for c in codes.tolist():
            path.append(q)
            to = step[q][c]
            if to < 0:
                new = self.move[joint[q], c]
                to = number.setdefault(new.tobytes(), len(joint))
                if to == len(joint):
                    joint.append(new)
                    step.append([-1] * _N)
                step[q][c] = to
            q = to
        seen, times = np.unique(np.array(path) * _N + codes, return_counts=True)
        return times @ self.bits[np.stack(joint)[seen // _N], (seen % _N)[:, None]]

    def score(self, codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(format, its bits a character, the background's) of candidates that lie one after another in codes."""
        n, sink = len(size), len(self.move) - 1
        begin = np.cumsum(size) - size
        total = np.stack([_length_bits(h, size) for h in self.lengths], 1)
        state = np.tile(self.start, (n, 1))
        live, i = np.arange(n), 0
        while len(live) and i < SHORT:
            c, q = codes[begin[live] + i][:, None], state[live]
            total[live] += self.bits[q, c]
            state[live] = q = self.move[q, c]
            i += 1
            lost = (q == sink).all(1)
            total[live[lost]] += ((size[live[lost]] - i) * self.bits[sink, 0])[:, None]
            live = live[~lost & (size[live] > i)]
        for k in live:
            total[k] += self._rest(codes[begin[k] + i : begin[k] + size[k]], state[k])
        before = np.empty(len(codes), np.int64)
        before[1:] = codes[:-1]
        before[begin] = _N
        plain = np.add.reduceat(self.pairs[before, codes], begin) + _length_bits(self.other_lengths, size)
        best = total.argmax(1)
        return best, total[np.arange(n), best] / size, plain / size


def build(labelled: dict[str, list[str]], pairs: np.ndarray, other_lengths: np.ndarray) -> Grammar:
    """Automata of labelled credentials by format, against background counts."""
    names = sorted(k for k, v in labelled.items() if v)
    moves, bits, start, lengths, at = [], [], [], [], 0
    for k in names:
        m, b = infer(tuple(sorted(labelled[k])))
        moves.append(np.where(m < 0, -1, m + at))
        bits.append(b)
        start.append(at)
        lengths.append(np.bincount(np.minimum([len(x) for x in labelled[k]], 1023), minlength=1024))
        at += len(m)
    move = np.concatenate([*moves, np.full((1, _N), at, np.int32)])
    move[move < 0] = at
    smooth = pairs + 0.5
    return Grammar(
        names, np.array(start), move, np.concatenate([*bits, np.full((1, _N), np.log2(1 / _N))]), np.stack(lengths), np.log2(smooth / smooth.sum(1, keepdims=True)), other_lengths
    )


def candidates(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, size) of every candidate of the texts."""
    inside = np.concatenate(([False], _CODE[buf] > 0, [False]))
    turn = inside[1:] != inside[:-1]
    heads = off[1:-1]
    heads = heads[(heads > 0) & (heads < len(buf))]
    split = heads[inside[heads] & inside[heads + 1]]  # a run that goes on into the next text
    edge = np.sort(np.concatenate([np.flatnonzero(turn), split, split]))
    start, end = edge[::2], edge[1::2]
    long = end - start >= LEAST
    start, end = start[long], end[long]
    return np.searchsorted(off, start, "right") - 1, start, end - start


def _flat(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    first = np.cumsum(size) - size
    return _CODE[buf[np.arange(size.sum()) + np.repeat(start - first, size)]].astype(np.int64) - 1


def _evidence(batches):
    """Rows (kind, name, value, n): labelled candidates, and counts of pairs and lengths of all others."""
    pairs, lengths = np.zeros((_N + 1) * _N, np.int64), np.zeros(1024, np.int64)
    for b in batches:
        names, values = [], []
        for _, buf, off in tv.pieces(b.column("text")):
            row, start, size = candidates(buf, off)
            if not len(start):
                continue
            lead = np.zeros(len(start), bool)
            for back in (1, 2, 3, 4):  # a quote, or a sign of assignment before some blanks
                lead |= (start - back >= off[row]) & _LEADS[buf[np.maximum(start - back, 0)]]
            named = np.zeros(len(start), bool)
            raw = buf.tobytes()
            for i in np.flatnonzero(lead):
                m = _NAME.search(raw, max(int(off[row[i]]), int(start[i]) - 64), int(start[i]))
                if m:
                    named[i] = True
                    names.append("named_" + m[1].decode().lower().replace("_", ""))
                    values.append(raw[start[i] : start[i] + size[i]].decode())
            start, size = start[~named], size[~named]
            if len(start):
                code = _flat(buf, start, size)
                before = np.empty(len(code), np.int64)
                before[1:] = code[:-1]
                before[np.cumsum(size) - size] = _N
                pairs += np.bincount(before * _N + code, minlength=len(pairs))
                lengths += np.bincount(np.minimum(size, 1023), minlength=1024)
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(["label"] * len(names)), pa.array(names), pa.array(values), pa.array([1] * len(names), pa.int64())], ["kind", "name", "value", "n"])
    for kind, a in (("pair", pairs), ("length", lengths)):
        at = np.flatnonzero(a)
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at), pa.string()), pa.array(at.astype(str), pa.string()), pa.nulls(len(at), pa.string()), pa.array(a[at])], ["kind", "name", "value", "n"])


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Grammar:
    """The grammar from the labelled credentials of docs and of public formats."""
    ship(docs.sparkSession)
    found = staged(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_evidence, "kind string, name string, value string, n long"), "credential-evidence")
    labelled = public_examples()
    distinct = found.where("kind = 'label'").select("name", "value").distinct()
    for r in distinct.orderBy(F.xxhash64("name", "value"), "name", "value").limit(rows).collect():
        labelled.setdefault(r["name"], []).append(r["value"])
    pairs, lengths = np.zeros((_N + 1, _N)), np.zeros(1024)
    for r in found.where("kind <> 'label'").groupBy("kind", "name").agg(F.sum("n").alias("n")).collect():
        (pairs.reshape(-1) if r["kind"] == "pair" else lengths)[int(r["name"])] = r["n"]
    return build(labelled, pairs, lengths)


SCHEMA = "doc_id long, start long, length long, format string, format_bits double, background_bits double, log_odds double, is_secret boolean"


def scan(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """Every candidate of every row, scored."""
    ship(docs.sparkSession)

    def run(batches):
        names = pa.array(grammar.names)
        for b in batches:
            for first, buf, off in tv.pieces(b.column("text")):
                row, start, size = candidates(buf, off)
                if not len(start):
                    continue
                best, own, plain = grammar.score(_flat(buf, start, size), size)
                chars = np.cumsum((buf & 0xC0) != 0x80)
                begin = off[row]
                place = chars[start] - 1 - np.where(begin > 0, chars[np.maximum(begin, 1) - 1], 0)
                cols = [b.column("doc_id").take(pa.array(row + first)), pa.array(place), pa.array(size), names.take(pa.array(best)), pa.array(own), pa.array(plain), pa.array(own - plain), pa.array(own - plain >= threshold)]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
