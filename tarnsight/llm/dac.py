"""Token ids as directly addressable codes: any token of a document is read without decoding its neighbours.

An id is cut into chunks, the lowest first, of `widths` bits. Level k holds the k-th chunks, packed without gaps, of the ids that have
one; a bitmap says which of them go on to the next level, and a rank directory holds, for each 512 bits of it, the ones before them. The
place of an id in level k + 1 is the rank of its bit in level k: one directory entry and at most 64 bytes of bit counts. The last level
needs no bitmap.

One row for each document: doc_id, n_tokens, widths, and for each level chunks_k, and but for the last more_k and rank_k, all binary.

Defined results: a null text gives nulls in all but doc_id and widths; an empty one gives 0 tokens and empty binaries. Texts of any length
are encoded whole. Repeated rows and null doc_ids give a row each; an empty table gives an empty result; other columns are ignored. An id
that the widths can't hold raises an error before anything is written.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from . import bpe
from . import textvec as tv

WIDTHS = (9, 3, 4)
SPAN = 512


def _spread(counts: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of rows padded to `unit`, place of each element in the padded layout)."""
    padded = -(-counts // unit) * unit
    off = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(padded, out=off[1:])
    first = np.cumsum(counts) - counts
    return off, np.arange(counts.sum()) + np.repeat(off[:-1] - first, counts)


def _binary(data: np.ndarray, off: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Rows data[off[i]:off[i + 1]] as an Arrow column, without a loop."""
    bits = pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [bits, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def pack(values: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, byte offsets): each row's values in `width` bits each, highest bit first, from a byte boundary."""
    off, place = _spread(counts, 8)
    kind = np.uint8 if width <= 8 else np.uint16 if width <= 16 else np.uint32
    full = np.zeros(off[-1], kind)
    full[place] = values
    if width == 8:
        return full, off
    bits = np.empty((len(full), width), np.uint8)
    for b in range(width):
        bits[:, b] = (full >> kind(width - 1 - b)) & kind(1)
    return np.packbits(bits.ravel()), off * width // 8


def levels(ids: np.ndarray, counts: np.ndarray, widths: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bytes, byte offsets) of every column after n_tokens, for rows of counts[i] ids."""
    if len(ids) and int(ids.max()) >> sum(widths):
        raise ValueError(f"token id {int(ids.max())} needs more than {widths} bits")
    out, rest, owner = [], ids.astype(np.uint32), np.repeat(np.arange(len(counts)), counts)
    for k, w in enumerate(widths):
        out.append(pack(rest & np.uint32((1 << w) - 1), counts, w))
        rest = rest >> np.uint32(w)
        if k + 1 == len(widths):
            break
        on = rest > 0
        off, place = _spread(counts, 64)
        flags = np.zeros(off[-1], bool)
        flags[place] = on
        data = np.packbits(flags)
        word = np.bitwise_count(data.view(np.uint64)).astype(np.int64) if len(data) else np.zeros(0, np.int64)
        before = np.cumsum(word) - word
        words = np.diff(off) // 64
        entries = -(-words // (SPAN // 64))
        entry_off = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(entries, out=entry_off[1:])
        number = np.arange(entry_off[-1]) - np.repeat(entry_off[:-1], entries)
        first = np.repeat(off[:-1] // 64, entries)
        rank = (before[first + number * (SPAN // 64)] - before[first]).astype("<u4") if len(first) else np.zeros(0, "<u4")
        out += [(data, off // 8), (rank.view(np.uint8), entry_off * 4)]
        rest, owner = rest[on], owner[on]
        counts = np.bincount(owner, minlength=len(counts))
    return out


def columns(widths: tuple[int, ...]) -> list[str]:
    names = []
    for k in range(len(widths)):
        names += [f"chunks_{k}"] + ([f"more_{k}", f"rank_{k}"] if k + 1 < len(widths) else [])
    return names


def schema(widths: tuple[int, ...] = WIDTHS) -> str:
    return "doc_id long, n_tokens long, widths array<int>, " + ", ".join(f"{c} binary" for c in columns(widths))


def encode(docs: DataFrame, vocabulary: str = bpe.VOCABULARY, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """The codes of every document."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(bpe.read_vocabulary(vocabulary))

    def run(batches):
        for b in batches:
            doc, text = b.column("doc_id"), b.column("text")
            valid = ~text.is_null().to_numpy(zero_copy_only=False)
            done = 0
            for first, buf, off in tv.pieces(text, 1 << 20):
                n = len(off) - 1
                ids, at = bpe.engine(sent.value).encode(buf, off)
                count, real = np.diff(at), valid[first : first + n]
                wide = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(widths)), pa.array(np.tile(np.array(widths, np.int32), n)))
                yield pa.RecordBatch.from_arrays(
                    [doc.slice(first, n), pa.array(count, mask=~real), wide, *(_binary(data, o, real) for data, o in levels(ids, count, widths))], ["doc_id", "n_tokens", "widths", *columns(widths)]
                )
                done += n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema(widths))


def _bits(data: bytes, at: int, width: int) -> int:
    lo, hi = at >> 3, (at + width + 7) >> 3
    return (int.from_bytes(data[lo:hi], "big") >> ((hi << 3) - at - width)) & ((1 << width) - 1)


def token_at(row, i: int) -> int | None:
    """Token i of one encoded row (a mapping), from 0; None outside or for a null text. Reads a few bytes of each level."""
    if row["n_tokens"] is None or not 0 <= i < row["n_tokens"]:
        return None
    value, shift, widths = 0, 0, row["widths"]
    for k, w in enumerate(widths):
        value |= _bits(row[f"chunks_{k}"], i * w, w) << shift
        shift += w
        if k + 1 == len(widths):
            break
        more = row[f"more_{k}"]
        if not _bits(more, i, 1):
            break
        span = i // SPAN
        part = int.from_bytes(more[span * SPAN // 8 : (i >> 3) + 1], "big") >> (8 - (i & 7))
        i = int.from_bytes(row[f"rank_{k}"][4 * span : 4 * span + 4], "little") + part.bit_count()
    return value


def decode_row(row) -> list[int] | None:
    """All ids of one encoded row."""
    return None if row["n_tokens"] is None else [token_at(row, i) for i in range(row["n_tokens"])]


def fetch(codes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, position, token) for rows (doc_id, position) of wanted; null where there is no such token. No document is decoded."""
    ship(codes.sparkSession)
    names = [c for c in codes.columns if c != "doc_id"]

    @F.pandas_udf("int")
    def read(s: pd.DataFrame) -> pd.Series:
        rows = s.to_dict("records")
        return pd.Series([None if pd.isna(r["n_tokens"]) or pd.isna(r["position"]) else token_at(r, int(r["position"])) for r in rows], dtype="Int32")

    return wanted.select("doc_id", "position").join(codes, "doc_id").select("doc_id", "position", read(F.struct("position", *names)).alias("token"))
