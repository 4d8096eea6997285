"""Near duplicates: SimHash of 128 bits, random bit-sampling tables, verified Hamming distances, groups as connected components.

A document's fingerprint adds, for each of its distinct words, +1 or -1 to each of 128 counters by the bits of the word's hash,
and keeps the signs. Two documents are near copies when their fingerprints differ in at most `radius` bits; a group is a connected
component of that relation and its smallest doc_id stays.

Candidates: `tables` independent samples of `bits` coordinates each; documents that agree on all sampled bits share a bucket. Both
numbers follow from the number of distinct fingerprints, so that a bucket holds about BUCKET of them and a pair at exactly `radius`
shares one with probability `recall`; closer pairs do more often. In a bucket, a search from unvisited members finds the components
by true distances. Where what is left of an oversized bucket would cost too much, additional sampled bits divide it, in as many
repeated samples as keep a pair at `radius` with probability .99; nothing is dropped.

Defined results: rows with a null doc_id belong to no group and always stay. Rows that share a doc_id are one document (of them, the
smallest text counts, null first). A null or empty text, or one without any letter or digit, has no fingerprint and no copies. Repeated
texts have distance 0. Very long texts are read whole; their fingerprints are as long as any. An empty table gives an empty result. Other
columns are ignored, and stay in `drop_near_duplicates`, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import discard, ship, staged, unused
from . import textvec as tv

U = np.uint64
BITS = 128
RADIUS = 24
RECALL = 0.92
BUCKET = 512
OVERSIZED = 4096


def fingerprints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n x 2 uint64, n bool) fingerprints of texts, and which have any word."""
    out, has = [], []
    for _, buf, off in tv.pieces(column, 1 << 20):
        row, key, _ = tv.distinct_per_row(tv.words(buf, off))
        n = len(off) - 1
        fp = np.zeros((n, 2), U)
        first = np.searchsorted(row, np.arange(n + 1))
        full = np.flatnonzero(np.diff(first))
        if len(full):
            h = np.stack([tv.mix(key + U(0x9E3779B97F4A7C15)), tv.mix(key ^ U(0xC2B2AE3D27D4EB4F))], 1)
            at = first[full]
            sums = np.empty((len(full), BITS), np.int32)
            size = np.diff(np.append(at, len(key)))
            # whole rows, about 2**17 words at a time, so that the unpacked bits stay in cache
            i = 0
            while i < len(full):
                j = max(i + 1, int(np.searchsorted(at, at[i] + (1 << 15), "right")) - 1)
                lo, hi = at[i], at[j] if j < len(full) else len(key)
                bits = np.unpackbits(h[lo:hi].view(np.uint8).reshape(-1, 16), axis=1)
                sums[i:j] = np.add.reduceat(bits, at[i:j] - lo, axis=0, dtype=np.int32)
                i = j
            fp[full] = np.packbits(sums * 2 > size[:, None], axis=1).view(U)
        out.append(fp)
        has.append(np.diff(first) > 0)
    return (np.concatenate(out), np.concatenate(has)) if out else (np.zeros((0, 2), U), np.zeros(0, bool))


def _fingerprint_batches(batches):
    for b in batches:
        fp, has = fingerprints(b.column("text"))
        keep = pa.array(has)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").filter(keep), pa.array(fp[has, 0].view(np.int64)), pa.array(fp[has, 1].view(np.int64))], ["doc_id", "h0", "h1"]
        )


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """(doc_id, h0, h1) of the documents that have words."""
    ship(docs.sparkSession)
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
        .where("doc_id is not null and text is not null")
        .mapInArrow(_fingerprint_batches, "doc_id long, h0 long, h1 long")
    )


def sampling(n: int, radius: int = RADIUS, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for n distinct fingerprints."""
    bits = min(40, max(8, math.ceil(math.log2(max(2, n) / BUCKET))))
    hit = math.prod((BITS - radius - i) / (BITS - i) for i in range(bits))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - hit))


def _bit_columns(fp: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The named bits of each fingerprint, as one uint64 a row."""
    key = np.zeros(len(fp), U)
    for p in where:
        key = (key << U(1)) | ((fp[:, p >> 6] >> U(p & 63)) & U(1))
    return key


def _coordinates(seed: int, tables: int, bits: int, of: np.ndarray | None = None) -> np.ndarray:
    rng = np.random.default_rng(seed)
    of = np.arange(BITS) if of is None else of
    return np.stack([rng.permutation(of)[:bits] for _ in range(tables)])


def distances(fp: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp ^ one).sum(-1, dtype=np.int32)


def bucket_edges(ids: np.ndarray, fp: np.ndarray, radius: int, used: np.ndarray, depth: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that span the components, by distances within the bucket; `used` are the bits that its members share."""
    left, edges = np.arange(len(ids)), []
    spent, limit = 0, OVERSIZED * OVERSIZED // 2
    while len(left) > 1:
        if len(left) > OVERSIZED and spent > limit and depth < 4:
            # The rest has no dense part left: divide it by additional bits. Those taken out before have met everything in `left`.
            free = np.setdiff1d(np.arange(BITS), used)
            bits = min(len(free), max(1, math.ceil(math.log2(len(left) / BUCKET))))
            r = min(radius, len(free) - 1)
            hit = math.prod(max(1, len(free) - r - i) / (len(free) - i) for i in range(bits))
            for where in _coordinates(7919 * (depth + 1), math.ceil(math.log(0.01) / math.log(1 - min(hit, 1 - 1e-9))), bits, free):
                key = _bit_columns(fp[left], where)
                order = np.argsort(key, kind="stable")
                cuts = np.flatnonzero(np.diff(key[order])) + 1
                for part in np.split(left[order], cuts):
                    if len(part) > 1:
                        edges += bucket_edges(ids[part], fp[part], radius, np.union1d(used, where), depth + 1)
            break
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for i in front:
                rest = np.flatnonzero(~near)
                hit = rest[distances(fp[left[rest]], fp[i]) <= radius]
                spent += len(rest)
                if len(hit):
                    near[hit] = True
                    edges.append((np.full(len(hit), ids[i]), ids[left[hit]]))
            front, left = left[near], left[~near]
    return edges


def small_bucket_edges(ids: np.ndarray, fp: np.ndarray, bucket: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All near pairs within buckets (runs of equal `bucket`), by shifted comparison."""
    edges, d = [], 1
    at = np.flatnonzero(bucket[1:] == bucket[:-1])
    while len(at):
        near = at[distances(fp[at], fp[at + d]) <= radius]
        if len(near):
            edges.append((ids[near], ids[near + d]))
        d += 1
        at = at[at + d < len(bucket)]
        at = at[bucket[at] == bucket[at + d]]
    return edges


def _table_rows(seed: int, tables: int, bits: int):
    where = _coordinates(seed, tables, bits)

    def run(batches):
        for b in batches:
            fp = np.stack([b.column("h0").to_numpy().view(U), b.column("h1").to_numpy().view(U)], 1)
            for t in range(tables):
                key = (U(t) << U(48)) | _bit_columns(fp, where[t])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(b.column(c) for c in ("doc_id", "h0", "h1"))], ["bucket", "doc_id", "h0", "h1"])

    return run


def _edge_rows(seed: int, tables: int, bits: int, radius: int):
    where = _coordinates(seed, tables, bits)

    def solve(bucket, ids, fp):
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        size = np.diff(np.append(first, len(bucket)))
        big = size > 4 * BUCKET
        edges = []
        for s, n in zip(first[big], size[big]):
            edges += bucket_edges(ids[s : s + n], fp[s : s + n], radius, where[int(bucket[s]) >> 48])
        small = np.repeat(~big, size)
        edges += small_bucket_edges(ids[small], fp[small], bucket[small], radius)
        a, b = (np.concatenate(x) for x in zip(*edges)) if edges else (np.zeros(0, np.int64),) * 2
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    def run(batches):
        rest, held = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            bucket = b.column("bucket").to_numpy()
            ids = b.column("doc_id").to_numpy()
            fp = np.stack([b.column("h0").to_numpy().view(U), b.column("h1").to_numpy().view(U)], 1)
            cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
            rest.append((bucket[:cut], ids[:cut], fp[:cut]))
            held += cut
            if cut and held >= 1 << 16:
                yield solve(*(np.concatenate(x) for x in zip(*rest)))
                rest, held = [], 0
            rest.append((bucket[cut:], ids[cut:], fp[cut:]))
            held += len(bucket) - cut
        if rest:
            yield solve(*(np.concatenate(x) for x in zip(*rest)))

    return run


def near_edges(prints: DataFrame, radius: int = RADIUS, recall: float = RECALL, seed: int = 20240517) -> DataFrame:
    """Pairs (a, b) of doc_ids that link each fingerprint's documents, and span the groups of near fingerprints found in the buckets."""
    one = prints.groupBy("h0", "h1").agg(F.min("doc_id").alias("doc_id"))
    one = staged(one, "simhash-distinct")
    bits, tables = sampling(one.count(), radius, recall)
    rows = one.mapInArrow(_table_rows(seed, tables, bits), "bucket long, doc_id long, h0 long, h1 long")
    near = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_edge_rows(seed, tables, bits, radius), "a long, b long")
    # the least document of each fingerprint by a partial aggregate, so that a text of very many copies is no task of its own
    same = prints.join(one.withColumnRenamed("doc_id", "a"), ["h0", "h1"]).where("a <> doc_id").select("a", F.col("doc_id").alias("b"))
    return near.union(same).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, root) for every doc_id in a component of two or more but its root, the smallest: large-star and small-star rounds."""
    now = staged(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v <> m").distinct(), "edges")
    state = None
    while True:
        # large star: each node sends its larger neighbours to the smallest of its neighbourhood; minima are aggregated before they are
        # joined, so that a node of very many edges is no task of its own
        both = now.select(F.col("v").alias("u"), F.col("m").alias("w")).union(now.select(F.col("m").alias("u"), F.col("v").alias("w")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("w")).alias("low"))
        large = both.where("w > u").join(low, "u").select(F.col("w").alias("v"), F.col("low").alias("m")).distinct()
        # small star: each node and its smaller neighbours go to the smallest of them
        low = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct("m", "low"), F.struct(F.col("v").alias("m"), "low"))).alias("x"))
        following = staged(small.select(F.col("x.m").alias("v"), F.col("x.low").alias("m")).where("v <> m").distinct(), "edges")
        discard(now)
        now = following
        # decimal sums: exact, so equal states mean that nothing moved
        new = now.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(20,0)")), F.sum(F.xxhash64("m", "v").cast("decimal(20,0)"))).first()
        if new == state:
            return now.select(F.col("v").alias("doc_id"), F.col("m").alias("root"))
        state = new


def near_duplicates(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL, seed: int = 20240517) -> DataFrame:
    """(doc_id, duplicate_of, group_size): every document that is a near copy of another, but the one of its group that stays."""
    spark = docs.sparkSession
    prints = fingerprint_table(docs)
    # rows that share a doc_id are one document
    prints = staged(prints.groupBy("doc_id").agg(F.min(F.struct("h0", "h1")).alias("h")).select("doc_id", "h.h0", "h.h1"), "simhash")
    found = components(near_edges(prints, radius, recall, seed))
    size = found.groupBy("root").agg((F.count("*") + 1).alias("group_size"))
    return found.join(size, "root").select("doc_id", F.col("root").alias("duplicate_of"), "group_size")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL, seed: int = 20240517) -> DataFrame:
    """The rows of docs without near copies: one document of each group stays, and one row of each doc_id (null ids all stay)."""
    gone_id, twice_id, rank = unused(docs, "__gone__", "__twice__", "__rank__")
    gone = near_duplicates(docs, radius, recall, seed).select(F.col("doc_id").alias(gone_id))
    kept = docs.join(gone.hint("shuffle_hash"), F.col("doc_id") == F.col(gone_id), "left_anti")
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(twice_id))
    twice = staged(twice, "repeated-ids")
    if twice.isEmpty():
        return kept
    same = F.col("doc_id") == F.col(twice_id)
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first(), F.xxhash64(F.to_json(F.struct("*")))))
    one = kept.join(twice.hint("shuffle_hash"), same, "left_semi").withColumn(rank, first).where(F.col(rank) == 1).drop(rank)
    return kept.join(twice.hint("shuffle_hash"), same, "left_anti").unionByName(one)
