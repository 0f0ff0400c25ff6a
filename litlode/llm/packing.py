"""Best-fit packing by minimum bin slack.

A bin takes the longest piece left as its seed, and a bitset subset-sum over the lengths
that are left finds the fullest combination that fits beside it; the combination is then
removed. Two bins over the same lengths get the same combination, so the search runs on
the histogram of lengths, which has one entry per length up to the capacity however many
pieces there are: a combination is removed as many times as its scarcest length allows,
and each removal exhausts that length. Only the histogram and the combinations are on the
driver. The executors give each piece a dense rank among the pieces of its length and look
up the place that the rank has among the combinations' places for that length.

Inputs: a null text is empty; every document has at least its end token, so an empty one
is a piece of length 1. A document longer than the capacity is cut into pieces of just the
capacity, and the last may be shorter. Rows that repeat, or have a null doc_id, are
documents of their own. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litlode.llm.bpe import SLICE_BYTES, encoder, text_slices
from litlode.llm.common import cut, map_batches, small_side

CAPACITY = 2048
END_ID = 0
#: Pieces of a length that one task ranks, about.
RANK_ROWS = 100_000


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[({length: copies in a bin}, number of such bins)] that together use up ``counts``."""
    left = {n: c for n, c in counts.items() if c > 0}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("lengths must be from 1 to the capacity")
    bins = []
    while left:
        lengths = sorted(left, reverse=True)
        seed = lengths[0]
        free = capacity - seed
        reach, steps, mask = 1, [], (1 << (free + 1)) - 1
        for n in lengths:
            if n > free:
                continue
            most = min(left[n] - (n == seed), free // n)
            k = 1
            while most > 0 and not reach >> free & 1:
                k = min(k, most)
                steps.append((n, k, reach))
                reach |= (reach << (n * k)) & mask
                most, k = most - k, 2 * k
            if reach >> free & 1:
                break
        at = reach.bit_length() - 1
        chosen = {seed: 1}
        for n, k, before in reversed(steps):
            if not before >> at & 1:
                at -= n * k
                chosen[n] = chosen.get(n, 0) + k
        times = min(left[n] // k for n, k in chosen.items())
        bins.append((chosen, times))
        for n, k in chosen.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return bins


def _places(bins: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, copies, first sequence, offset), sorted by length and rank."""
    rows, used, sequence = [], {}, 0
    for chosen, times in bins:
        offset = 0
        for n, k in chosen.items():
            rows.append((n, used.get(n, 0), k, sequence, offset))
            used[n] = used.get(n, 0) + k * times
            offset += n * k
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (materialised; with ``length``) and where each goes: sequence_id, offset.

    ``order`` are the columns that tell pieces apart; rows that are equal in them are dealt in any order.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # a row for each length up to the capacity
    salts = max(16, -(-max(counts.values(), default=0) // RANK_ROWS))
    places = _places(minimum_bin_slack(counts, capacity))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    before = salted.groupBy("length", "_salt").count()
    before = cut(before.withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))).drop("count"))
    ranked = salted.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1)
    ranked = ranked.join(small_side(before), ["length", "_salt"]).withColumn("rank", F.col("_in") + F.coalesce("_before", F.lit(0))).select(*pieces.columns, F.col("rank").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = places[:, 0] << 44 | places[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(zero_copy_only=False).astype(np.int64), b.column("rank").to_numpy(zero_copy_only=False)
            n, first, copies, sequence, offset = places[np.searchsorted(key, length << 44 | rank, side="right") - 1].T
            bin_no, copy = np.divmod(rank - first, copies)
            columns = [*b.columns[:-1], pa.array(sequence + bin_no), pa.array(offset + copy * n)]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return map_batches(ranked, run, f"{schema}, sequence_id long, offset long")


def token_pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's ids and ``end_id``, cut at the capacity; ids as little-endian 32-bit binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, step = encoder(path, decoding=False, agree=False), np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
        for b in batches:
            for at, _, data, offsets in text_slices(b, 1, slice_bytes):
                rows, starts, parts = [], [], []
                for k, (ids, _) in enumerate(enc.encode(data, offsets)):
                    ids += end
                    for s in range(0, len(ids), step):
                        rows.append(at + k)
                        starts.append(s // 4)
                        parts.append(ids[s : s + step])
                starts = np.array(starts, dtype=np.int64)
                columns = [b.column(0).take(pa.array(rows)), pa.array((starts // capacity).astype(np.int32)), pa.array(starts), pa.array([len(p) // 4 for p in parts], pa.int64()), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def ids_crc32() -> Column:
    return F.crc32("ids").alias("ids_crc32")


def pack_documents(df: DataFrame, path: str, capacity: int = CAPACITY, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Digest of the packing: doc_id, piece, start, length, ids_crc32, sequence_id, offset; ``slice_bytes`` of text are encoded at a time."""
    narrow = cut(token_pieces(df, path, capacity=capacity, slice_bytes=slice_bytes).select("doc_id", "piece", "start", "length", ids_crc32()))
    return pack(narrow, ["doc_id", "piece", "start", "ids_crc32"], capacity)
