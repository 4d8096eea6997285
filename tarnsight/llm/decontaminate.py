"""Benchmark decontamination by suffix arrays of the training text.

Texts become streams of words (lower-cased runs of letters and digits), a separator after each document. Every partition cuts its
stream into overlapping shards of SHARD words, builds the suffix array of each shard once by prefix doubling (to the depth of the
shortest match that counts: no comparison looks beyond), and binary-searches every suffix of every benchmark item in it. A match counts from `least` words on, or the whole item where it is shorter; items of fewer than `shortest` words are never matched, as
they are common speech (a documented parameter, 1 turns it off). Each match is followed to its full length; the longest of each document
and item is kept with both places. The training text is never shuffled. Benchmark words go to the executors in blocks of at most `block`
words; up to PASS words of blocks share one pass over the documents, and its suffix arrays; a larger benchmark takes more passes.

Defined results: null, empty or wordless texts match nothing and stay. Null item ids are matched like others and reported as null; so
are null doc_ids. Repeated rows are matched each by itself; `matches` reports a doc_id and item once, with the longest match, ties to
the first place in the document, then in the item. Very long texts are cut into overlapping shards, so nothing in them is missed. Empty
tables give no matches. Removal works on rows, so all columns of documents stay as they are, clashing names too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from . import textvec as tv

U = np.uint64
LEAST = 13
SHORTEST = 5
SHARD = 1 << 19
BLOCK = 1 << 20
PASS = 1 << 23
_PLACE = U(21)
_LOW = U((1 << 21) - 1)
_SEPARATOR = U(2**64 - 1)


def suffix_array(word: np.ndarray, depth: int, done: int = 1) -> np.ndarray:
    """Places of word (uint64) in the order of the suffixes' first `depth` words at least; words compare by their upper 43 bits, which hold
    `done` places' worth. Fewer than 2**21 words."""
    n = len(word)
    if not n:
        return np.zeros(0, np.int64)
    packed = np.sort((word & ~_LOW) | np.arange(n, dtype=U))
    order = (packed & _LOW).astype(np.int64)
    fresh = np.concatenate(([True], (packed[1:] >> _PLACE) != (packed[:-1] >> _PLACE)))
    while done < depth:
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, n))
        tied = np.repeat(size > 1, size)
        if not tied.any():
            break
        rank = np.empty(n + 1, U)
        rank[order] = np.repeat(first, size).astype(U) + U(1)
        rank[n] = 0  # past the end sorts first
        at = order[tied]
        follow = rank[np.minimum(at + done, n)]
        packed = np.sort(((rank[at] - U(1)) << U(42)) | (follow << _PLACE) | at.astype(U))
        order[tied] = (packed & _LOW).astype(np.int64)
        fresh[tied] = np.concatenate(([True], (packed[1:] >> _PLACE) != (packed[:-1] >> _PLACE)))
        done *= 2
    return order


class Block:
    """Words of some benchmark items: every suffix of which at least `need` words are left. Only the words travel to the workers."""

    def __init__(self, items: list[tuple[object, np.ndarray]], least: int):
        self.ids = [i for i, _ in items]
        self.size = np.array([len(w) for _, w in items], np.int64)
        self.word = np.concatenate([w for _, w in items] + [np.zeros(0, U)])
        self.least = least
        self._suffixes()

    def __getstate__(self):
        return self.ids, self.size, self.word, self.least

    def __setstate__(self, state):
        self.ids, self.size, self.word, self.least = state
        self._suffixes()

    def _suffixes(self) -> None:
        first = np.cumsum(self.size) - self.size
        need = np.minimum(self.size, self.least)
        runs = np.maximum(self.size - need + 1, 0)
        item = np.repeat(np.arange(len(self.size)), runs)
        offset = np.arange(len(item)) - np.repeat(np.cumsum(runs) - runs, runs)
        self.item, self.offset, self.need = item, offset, need[item]
        self.at, self.left = first[item] + offset, self.size[item] - offset


def search(word: np.ndarray, order: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(suffix of the block, place) of every match of the suffix's need, by the words' upper bits."""
    lo, hi = np.zeros(len(block.at), np.int64), np.full(len(block.at), len(order), np.int64)
    live = np.arange(len(block.at))
    reach = np.append(word >> _PLACE, U(0))  # past the end sorts first, as in the array
    for d in range(int(block.need.max(initial=0))):
        live = live[(block.need[live] > d) & (hi[live] > lo[live])]
        if not len(live):
            break
        want = block.word[block.at[live] + d] >> _PLACE
        for side, out in ((0, lo), (1, hi)):
            a, b = lo[live].copy(), hi[live].copy()
            if side:
                a = out_lo
            while True:
                open_ = a < b
                if not open_.any():
                    break
                mid = (a + b) // 2
                here = reach[np.minimum(order[np.minimum(mid, len(order) - 1)] + d, len(word))]
                down = open_ & ((here < want) if side == 0 else (here <= want))
                a = np.where(down, mid + 1, a)
                b = np.where(open_ & ~down, mid, b)
            if side == 0:
                out_lo = a
            else:
                lo[live], hi[live] = out_lo, a
    n = np.maximum(hi - lo, 0)
    suffix = np.repeat(np.arange(len(n)), n)
    place = order[np.repeat(lo, n) + np.arange(len(suffix)) - np.repeat(np.cumsum(n) - n, n)] if len(suffix) else np.zeros(0, np.int64)
    return suffix, place


def follow(word: np.ndarray, block: Block, suffix: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, place, length) of the matches, to their full length in the whole stream; those short of the suffix's need are no matches."""
    length = np.zeros(len(suffix), np.int64)
    live, d = np.arange(len(suffix)), 0
    while len(live):
        live = live[(block.left[suffix[live]] > d) & (place[live] + d < len(word))]
        live = live[word[place[live] + d] == block.word[block.at[suffix[live]] + d]]
        length[live] = d + 1
        d += 1
    true = length >= block.need[suffix]
    return suffix[true], place[true], length[true]


def stream_matches(word: np.ndarray, blocks: list[Block]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block, its matches in a stream of words of any length, shard by shard."""
    depth = max((int(b.need.max(initial=0)) for b in blocks), default=0)
    found, step = [[] for _ in blocks], SHARD - 1 - depth
    for s in range(0, max(len(word), 1), step):
        part = word[s : s + step + depth]
        order = suffix_array(part, depth)
        for block, out in zip(blocks, found):
            suffix, place = search(part, order, block)
            own = place < step
            out.append(follow(word, block, suffix[own], place[own] + s))
        if s + len(part) >= len(word):
            break
    return [tuple(np.concatenate(x) for x in zip(*out)) for out in found]


def batch_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased words with a separator after each row, first place of each row)."""
    out, size = [], []
    for _, buf, off in tv.pieces(pc.utf8_lower(column)):
        w = tv.words(buf, off)
        n = np.diff(w.row)
        stream = np.full(len(w.hash) + len(n), _SEPARATOR, U)
        stream[np.arange(len(w.hash)) + w.owner()] = w.hash
        out.append(stream)
        size.append(n + 1)
    if not out:
        return np.zeros(0, U), np.zeros(0, np.int64)
    size = np.concatenate(size)
    return np.concatenate(out), np.cumsum(size) - size


def _sharded(batches, text: int):
    """(batches, words, first places of their rows) of about a shard each; text: the number of the text column."""
    held, stream, first, size = [], [], [], 0
    for b in batches:
        w, f = batch_words(b.column(text))
        held.append(b)
        stream.append(w)
        first.append(f + size)
        size += len(w)
        if size >= SHARD >> 1:
            yield held, np.concatenate(stream), np.concatenate(first)
            held, stream, first, size = [], [], [], 0
    if held:
        yield held, np.concatenate(stream), np.concatenate(first)


def benchmark_blocks(benchmark: DataFrame, least: int = LEAST, block: int = BLOCK, shortest: int = SHORTEST):
    """The benchmark's words in blocks of at most `block` words (a longer item is a block of its own), read piece by piece."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items, size = [], 0
    for r in rows.toLocalIterator():
        w = batch_words(pa.array([r["text"]], pa.string()))[0][:-1]
        if len(w) < max(1, shortest):
            continue
        if items and size + len(w) > block:
            yield Block(items, least)
            items, size = [], 0
        items.append((r["item_id"], w))
        size += len(w)
    if items:
        yield Block(items, least)


def _passes(benchmark: DataFrame, least: int, block: int, shortest: int):
    """Lists of blocks that one pass over the documents takes, broadcast."""
    spark = benchmark.sparkSession
    ship(spark)
    group, size = [], 0
    for b in benchmark_blocks(benchmark, least, block, shortest):
        if group and size + len(b.word) > PASS:
            yield spark.sparkContext.broadcast(group)
            group, size = [], 0
        group.append(b)
        size += len(b.word)
    if group:
        yield spark.sparkContext.broadcast(group)


MATCH = "doc_id long, item_id long, match_words long, doc_word long, item_word long"


def matches(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, block: int = BLOCK, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, item_id, match_words, doc_word, item_word): the longest match of each contaminated document with each item, and its places."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], MATCH)
    for sent in _passes(benchmark, least, block, shortest):

        def run(batches, sent=sent):
            blocks = sent.value
            for held, word, first in _sharded(batches, 1):
                doc = pa.concat_arrays([b.column("doc_id") for b in held])
                del held
                for items, (suffix, place, length) in zip(blocks, stream_matches(word, blocks)):
                    row = np.searchsorted(first, place, "right") - 1
                    order = np.lexsort((items.offset[suffix], place, -length, items.item[suffix], row))
                    suffix, place, length, row = (x[order] for x in (suffix, place, length, row))
                    item = items.item[suffix]
                    new = np.concatenate(([True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])))[: len(row)]
                    cols = [doc.take(pa.array(row[new])), pa.array(items.ids, pa.int64()).take(pa.array(item[new])), pa.array(length[new])]
                    cols += [pa.array((place - first[row])[new] if len(row) else place), pa.array(items.offset[suffix[new]])]
                    yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in MATCH.split(", ")])

        out = out.union(texts.mapInArrow(run, MATCH))
    best = F.max(F.struct("match_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("m")).selectExpr("doc_id", "item_id", "m.match_words", "-m.d as doc_word", "-m.i as item_word")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, block: int = BLOCK, shortest: int = SHORTEST) -> DataFrame:
    """The rows of docs without any match; nothing is shuffled."""
    where = docs.columns.index("text")
    for sent in _passes(benchmark, least, block, shortest):

        def run(batches, sent=sent):
            for held, word, first in _sharded(batches, where):
                clean = np.ones(len(first), bool)
                for _, place, _ in stream_matches(word, sent.value):
                    clean[np.searchsorted(first, place, "right") - 1] = False
                del word
                at = 0
                for b in held:
                    keep = pa.array(clean[at : at + b.num_rows])
                    at += b.num_rows
                    yield b.filter(keep)

        docs = docs.mapInArrow(run, docs.schema)
    return docs
