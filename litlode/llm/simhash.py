"""SimHash near-duplicates: bit-sliced comparison inside exact candidate buckets.

Every whole text gets a 64-bit fingerprint from its 3-word shingles. Rows are reduced to
distinct fingerprints before anything is compared, so copies cost nothing. Fingerprints at
``radius`` or fewer differing bits agree in at least b - radius of b blocks, so a bucket for
each choice of b - radius blocks holds every such pair: the candidates are complete. b grows
with the number of fingerprints to keep buckets short. A bucket beyond a bound is dealt into
cells in which each two of its members meet once, so no task holds a large bucket.

In a task the fingerprints are stored as 64 vertical bit planes. A tile of query rows is
compared with thousands of rows at once: plane by plane the differing bits go into
carry-save counters (one bitwise add for 64 distances), and the tile is abandoned as soon as
every distance in it is over the radius. Links found in a task are merged there, and only a
spanning forest leaves it; connected components join the forests.

Inputs: a null or empty text, or one of white space, has fingerprint zero and is linked like
any other. A text with fewer than three words is one shingle. Texts are taken whole, a
segment at a time. Equal rows share a fingerprint; a null doc_id takes part in linking, and
a component with only null ids has a null component_id. An empty table gives an empty result.
Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litlode.llm.bpe import text_slices
from litlode.llm.common import cut, grouped_batches, keep_least, map_batches, split_hot_keys
from litlode.llm.components import components, merge_pairs

BITS, RADIUS, WORDS, SEED = 64, 3, 3, 42
#: Bytes of a text that are taken at a time, query rows and member words (of 64 rows) of a tile.
SEGMENT, TILE_ROWS, TILE_WORDS = 1 << 20, 128, 64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _segments(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a segment at a time."""
    at = 0
    while at < len(text):
        to = at + SEGMENT
        while to < len(text) and not text[to : to + 1].isspace():
            to += 1
        yield text[at:to].split()
        at = to


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of a UTF-8 text."""
    ones, total, carried = np.zeros(BITS, dtype=np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for words in _segments(text.translate(_LOWER)):
        words = carried + words
        if len(words) < WORDS:
            carried = words
            continue
        line = b" ".join(words)
        gaps = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
        starts, ends = [0, *(gaps[: len(gaps) - WORDS + 1] + 1).tolist()], [*gaps[WORDS - 1 :].tolist(), len(line)]
        hashes = np.array([digest(line[s:e], SEED) for s, e in zip(starts, ends, strict=True)], dtype="<u8")
        for k in range(0, len(hashes), 8192):
            ones += np.unpackbits(hashes[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
        carried = words[1 - WORDS :]
    if not total:
        return digest(b" ".join(carried), SEED) if carried else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, data, offsets in text_slices(b, 1):
                spans = offsets.tolist()
                fps = np.array([fingerprint(data[s:e]) for s, e in zip(spans, spans[1:], strict=False)], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """A plane for each bit: plane b, word w holds bit b of rows 64 w to 64 w + 63; rows of one 64-bit word or of several."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    padded = np.zeros((bits.shape[1], -(-len(fps) // 64) * 64), dtype=np.uint8)
    padded[:, : len(fps)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def count_plane(counters: list[np.ndarray], over: np.ndarray, carry: np.ndarray, spare: np.ndarray) -> None:
    """Add a plane of differing bits, ``carry``, to 64 distances a word: carry-save counters, least bit first; ``carry`` and ``spare`` are used up."""
    for c in counters:
        np.bitwise_and(c, carry, out=spare)
        np.bitwise_xor(c, carry, out=c)
        carry, spare = spare, carry
    np.bitwise_or(over, carry, out=over)


def sliced_within(differ: np.ndarray, radius: int) -> np.ndarray:
    """Whether each row of differing bits (words of 64) has at most ``radius``; bit-sliced, a tile is left as soon as all of it is beyond."""
    fine, size = np.zeros(len(differ), dtype=bool), radius.bit_length()
    for lo in range(0, len(differ), 64 * TILE_WORDS):
        part = differ[lo : lo + 64 * TILE_WORDS]
        planes = bit_planes(part)
        over, spare = np.zeros_like(planes[0]), np.empty_like(planes[0])
        counters = [np.zeros_like(over) for _ in range(size)]
        for b, plane in enumerate(planes):
            count_plane(counters, over, plane, spare)
            if b % 16 == 15 and (over == np.uint64(0xFFFFFFFFFFFFFFFF)).all():
                break
        near = np.unpackbits((~over).view(np.uint8), bitorder="little")[: len(part)].astype(bool)
        near[near] = np.bitwise_count(part[near]).sum(axis=1) <= radius  # counters tell up to the next power of two
        fine[lo : lo + len(part)] = near
    return fine


def tile_links(planes: np.ndarray, fps: np.ndarray, lo: int, hi: int, w0: int, w1: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of query rows lo..hi and the rows of words w0..w1 within the radius."""
    queries = fps[lo:hi]
    size = radius.bit_length()  # counters of this many bits overflow at 2^size > radius
    counters = [np.zeros((hi - lo, w1 - w0), dtype=np.uint64) for _ in range(size)]
    over = np.zeros_like(counters[0])
    carry, spare = np.empty_like(over), np.empty_like(over)
    for b in range(BITS):
        mask = np.where(queries >> np.uint64(b) & np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
        np.bitwise_xor(planes[b, w0:w1][None, :], mask[:, None], out=carry)
        count_plane(counters, over, carry, spare)
        if b % 8 == 7 and (over == np.uint64(0xFFFFFFFFFFFFFFFF)).all():
            return np.empty(0, np.int64), np.empty(0, np.int64)
    row, word = np.nonzero(~over)
    bits = np.unpackbits((~over[row, word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    k, bit = np.nonzero(bits)
    i, j = lo + row[k], (w0 + word[k]) * 64 + bit
    fine = (j > i) & (j < len(fps))
    i, j = i[fine], j[fine]
    if (1 << size) - 1 > radius:
        near = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        i, j = i[near], j[near]
    return i, j


def forest(fps: np.ndarray, group_ends: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Parents that join rows within the radius; each row is compared up to the end of its group."""
    planes, parent, n = bit_planes(fps), np.arange(len(fps)), len(fps)
    for lo in range(0, n, TILE_ROWS):
        hi = min(n, lo + TILE_ROWS)
        last = -(-int(group_ends[hi - 1]) // 64)
        for w in range(lo // 64, last, TILE_WORDS):
            i, j = tile_links(planes, fps, lo, hi, w, min(last, w + TILE_WORDS), radius)
            if len(i):
                parent = merge_pairs(parent, i, j)
    return parent


def block_masks(n: int, radius: int = RADIUS, bucket: int = 64) -> list[int]:
    """Masks of the agreeing blocks: enough bits for buckets of about ``bucket`` of n random fingerprints."""
    for blocks in range(radius + 1, BITS + 1):
        edges = [BITS * k // blocks for k in range(blocks + 1)]
        agree = blocks - radius
        if n >> (BITS * agree // blocks) <= bucket or blocks == 2 * radius + 1:
            break
    one = [sum(1 << b for b in range(edges[k], edges[k + 1])) for k in range(blocks)]
    return [sum(one[k] for k in chosen) for chosen in combinations(range(blocks), agree)]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that span the links among distinct fingerprints ``fps(fp)``, which is materialised."""
    masks = block_masks(fps.count(), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(signed)]))
    cells = split_hot_keys(fps.select("fp", keys.alias("k")).select("fp", "k.t", "k.key"), ["t", "key"], "fp")
    by = ["t", "key", "cell_a", "cell_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped_batches(batches, by):
            values = group.column("fp").to_numpy().view(np.uint64)
            codes = np.stack([group.column(k).to_numpy().astype(np.int64) for k in by])
            change = np.append(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1, len(values))
            ends = change[np.searchsorted(change, np.arange(len(values)), side="right")]
            parent = forest(values, ends, radius)
            child = np.flatnonzero(parent != np.arange(len(values)))
            signed_values = values.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed_values[child]), pa.array(signed_values[parent[child]])], names=["a", "b"])

    dealt = cells.select("fp", *by).repartition(*by).sortWithinPartitions(*by)
    return map_batches(dealt, run, "a long, b long")


def grouped(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component) for each fingerprint of ``prints(fp)``, which is materialised; a component is named by its least fingerprint."""
    distinct = cut(prints.select("fp").distinct())
    roots = components(links(distinct, radius))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("component"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``df``."""
    docs = cut(fingerprints(df, id_col, text_col))
    firsts = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(firsts.select("fp"), radius))
    known = firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first_id", "root")
    least = known.filter("root is not null").groupBy("root").agg(F.min("first_id").alias("least_id"))
    labelled = known.join(least, "root", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"))
    return docs.join(cut(labelled), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each component of near-duplicates by fingerprints alone: the one with the least id, null ids last.

    Decisions are by id and text, so a row is dropped only for a row that stays: of rows that share an id,
    those with other texts stay or go by themselves. ``similar.keep_first`` is the stage by similarity.
    """
    docs = df.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash")).alias("row"), F.col(text_col).alias("text"))
    prints = cut(fingerprints(docs, "row", "text"))
    told = grouped(prints, radius)
    rows = prints.join(told, "fp").select(F.col("doc_id.id").alias("doc_id"), F.col("doc_id.text_hash").alias("text_hash"), "component")
    return keep_least(df, cut(rows), id_col, text_col)
