"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph (what stands between line feeds) is hashed to a wide vector, and a document's
fingerprint is the sum of its paragraphs' vectors, lane by lane, modulo a power of two. The
sum doesn't depend on the paragraphs' order, and a paragraph is inserted or deleted by adding
or subtracting its vector, without reading the rest. The vector has two parts:

* 4 lanes modulo 2^64, the paragraph's 256-bit BLAKE2b digest: two texts have equal sums
  just when their paragraphs are the same multiset, but for a chance of about 2^-256;
* 256 lanes modulo 2^16, a sum of +1 or -1 in a lane for each shingle of 5 words and each of 2 words of the paragraph
  (of the whole paragraph if it has fewer words): inner products of these sums estimate how
  many shingles two texts share, so fingerprints tell likeness, not only equality. The short shingles
  let texts of a few words be alike.

Documents are dealt by doc_id to buckets of about BUCKET_BYTES of text, a partition each, so that neighbours
meet without a global sort; only the buckets' limits come to the driver. A bucket is read as a
sorted stream, and a long text is hashed a segment at a time, so memory is bounded by a few times BLOCK and the largest text.

Inputs: a null text is empty, which is one empty paragraph. doc_id is a whole number or a string (another type is
refused with ValueError); strings are ordered by code points. Ties of doc_id, and null ids,
which come first, are ordered by a hash of the text; rows of one doc_id are one bucket. Rows may repeat. An empty table gives an empty
result, a single document is its own next one. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litlode.llm.bpe import text_slices
from litlode.llm.common import map_batches

EXACT, LANES, WORDS = 4, 256, (5, 2)
#: Bytes of text in a bucket of neighbours, about; finer ranges of ids that buckets are put together from, for each bucket.
BUCKET_BYTES, FINE = 16 << 20, 8
#: Buckets at most; beyond them buckets grow, and are still read as a sorted stream.
MOST_BUCKETS = 50_000
#: Ids sampled for each range, about.
SAMPLED = 30
#: Bytes that are hashed in one go.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []
_ID_TYPES = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK)
        _POWERS.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            _POWERS.append(np.multiply.accumulate(factors))
    return _POWERS[0][:n], _POWERS[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of bytes."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], ~_SPACE[data], [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)))
    return _mix((sums[ends] - sums[starts]) * down[starts]), starts


def _signs(words: np.ndarray, left: np.ndarray, short: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of each shingle of ``width`` words: those that begin where enough words are ``left``, and at ``short`` words, which open a shorter paragraph."""
    at = np.flatnonzero((left >= width) | short)
    h, padded = np.full(len(at), width, dtype=np.uint64), np.concatenate((words, np.zeros(width, np.uint64)))
    for k in range(width):
        h = h * np.uint64(_BASE) + np.where(left[at] > k, padded[at + k], np.uint64(k))
    return at, _mix(h)


def _add(out: np.ndarray, first: np.ndarray, h: np.ndarray) -> None:
    """Add each hash's sign to its lane; ``first`` is where its text's lanes begin."""
    np.add(out, np.bincount(first + (h & np.uint64(LANES - 1)).astype(np.int64), weights=1.0 - 2.0 * (h >> np.uint64(32) & np.uint64(1)).astype(float), minlength=len(out)), out=out)


def _shingle_lanes(texts: list[bytes]) -> np.ndarray:
    """For each text the lanes that its paragraphs' shingles add up to."""
    data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    out = np.zeros(len(texts) * LANES)
    words, starts = word_hashes(data)
    if len(words):
        paragraph = np.searchsorted(np.flatnonzero(data == 10), starts)
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
        first = np.flatnonzero(np.concatenate(([True], paragraph[1:] != paragraph[:-1])))
        count = np.diff(np.append(first, len(words)))
        left = np.repeat(first + count, count) - np.arange(len(words))  # words from here to the paragraph's end
        for width in WORDS:
            short = np.zeros(len(words), dtype=bool)
            short[first[count < width]] = True
            at, h = _signs(words, left, short, width)
            _add(out, text[at] * LANES, h)
    return out.astype(np.int64).reshape(len(texts), LANES)


def _long_lanes(paragraph: bytes) -> np.ndarray:
    """The lanes of one long paragraph, a segment at a time; a segment takes the words that a shingle may need along to the next."""
    out, carried, n = np.zeros(LANES), np.empty(0, np.uint64), 0
    most, at = max(WORDS) - 1, 0
    while at < len(paragraph):
        to = at + BLOCK
        while to < len(paragraph) and not _SPACE[paragraph[to]]:
            to += 1
        fresh = word_hashes(np.frombuffer(paragraph[at:to], dtype=np.uint8))[0]
        words = np.concatenate((carried, fresh))
        n, at = n + len(fresh), to
        left = len(words) - np.arange(len(words))
        for width in WORDS:
            own = words[max(0, len(carried) - width + 1) :]  # shingles that end in this segment
            _add(out, np.zeros(max(0, len(own) - width + 1), np.int64), _signs(own, left[len(words) - len(own) :], np.zeros(len(own), dtype=bool), width)[1])
        carried = words[-most:]
    for width in WORDS:
        if 0 < n < width:
            short = np.zeros(n, dtype=bool)
            short[0] = True
            _add(out, np.zeros(1, np.int64), _signs(carried, n - np.arange(n), short, width)[1])
    return out.astype(np.int64)


def paragraph_sums(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(exact lanes, shingle lanes) of each text: the sums of its paragraphs' vectors."""
    digests, counts = [], []
    for t in texts:
        parts = t.split(b"\n")
        digests += [hashlib.blake2b(p, digest_size=8 * EXACT).digest() for p in parts]
        counts.append(len(parts))
    vectors = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, EXACT)
    exact = np.add.reduceat(vectors, np.cumsum([0, *counts[:-1]]), axis=0)
    lanes, k = np.zeros((len(texts), LANES), dtype=np.int64), 0
    while k < len(texts):
        to, size = k + 1, len(texts[k])
        while to < len(texts) and size + len(texts[to]) <= BLOCK:
            size += len(texts[to])
            to += 1
        if size > 2 * BLOCK:  # one very long text: its paragraphs in turn
            held: list[bytes] = []
            for p in [*texts[k].split(b"\n"), None]:
                if held and (p is None or sum(map(len, held)) + len(p) > BLOCK):
                    lanes[k] += _shingle_lanes([b"\n".join(held)])[0]
                    held = []
                if p is not None and len(p) > BLOCK:
                    lanes[k] += _long_lanes(p)
                elif p is not None:
                    held.append(p)
        else:
            lanes[k:to] = _shingle_lanes(texts[k:to])
        k = to
    return exact, lanes


def render(exact: np.ndarray, lanes: np.ndarray) -> list[str]:
    """Hexadecimal digits of the lanes, most significant first."""
    wide, narrow = exact.astype(">u8"), (lanes & 0xFFFF).astype(">u2")
    return [a.tobytes().hex() + b.tobytes().hex() for a, b in zip(wide, narrow, strict=True)]


def parse(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    return np.frombuffer(raw[: 8 * EXACT], dtype=">u8").astype(np.uint64), np.frombuffer(raw[8 * EXACT :], dtype=">u2").astype(np.int64)


def combine(fingerprint: str, inserted: str | None = None, deleted: str | None = None) -> str:
    """The fingerprint after paragraphs with the fingerprint ``inserted`` come and ``deleted`` go."""
    exact, lanes = parse(fingerprint)
    for other, sign in ((inserted, 1), (deleted, -1)):
        if other is not None:
            x, y = parse(other)
            exact, lanes = (exact + x if sign > 0 else exact - x), lanes + sign * y
    return render(exact[None], lanes[None])[0]


def likeness(exact_a: np.ndarray, lanes_a: np.ndarray, exact_b: np.ndarray, lanes_b: np.ndarray) -> np.ndarray:
    """2 a.b / (a.a + b.b) of the shingle lanes read as signed numbers, from 0 to 1; 1 for equal fingerprints."""
    a, b = (((x + 0x8000) & 0xFFFF) - 0x8000 for x in (lanes_a, lanes_b))
    both = (a * a).sum(axis=1) + (b * b).sum(axis=1)
    like = np.clip(2.0 * (a * b).sum(axis=1) / np.maximum(both, 1), 0.0, 1.0)
    return np.where((exact_a == exact_b).all(axis=1) & (a == b).all(axis=1), 1.0, like)


def bucket_starts(df: DataFrame) -> tuple[list, object, bool]:
    """(ids that buckets after the first begin at, least id, whether there are null ids), for buckets of about BUCKET_BYTES.

    A bounded sample of ids cuts them into fine ranges, of which the bytes are then summed; as
    many neighbouring ranges as fit make up a bucket. The sample decides where buckets begin and nothing else.
    """
    size = F.octet_length("text")
    told = df.agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    buckets = min(MOST_BUCKETS, -(-(told["bytes"] or 0) // BUCKET_BYTES))
    least, nulls = told["least"], bool(told["nulls"])
    if buckets < 2 or least is None:
        return [], least, nulls
    ranges = FINE * buckets
    some = df.filter("doc_id is not null").select("doc_id")
    share = min(1.0, SAMPLED * ranges / told["n"])
    ids = sorted(r[0] for r in (some if share == 1 else some.sample(share, 5)).toLocalIterator())  # about SAMPLED x ranges
    cuts = sorted({ids[len(ids) * k // ranges] for k in range(1, ranges)} - {least}) if ids else []
    if not cuts:
        return [], least, nulls

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            totals = np.bincount(_placed(b.column(0), cuts), weights=b.column(1).to_numpy(), minlength=len(cuts) + 1)
            used = np.flatnonzero(totals)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(totals[used].astype(np.int64))], names=["place", "bytes"])

    found = map_batches(df.select("doc_id", (size + 64).alias("bytes")), place, "place int, bytes long").groupBy("place").agg(F.sum("bytes").alias("bytes"))
    held = {r["place"]: r["bytes"] for r in found.collect()}  # a row for each range
    limit = max(BUCKET_BYTES, -(-sum(held.values()) // MOST_BUCKETS))
    starts, total = [], held.get(0, 0)
    for k, first in enumerate(cuts, 1):
        if total and total + held.get(k, 0) > limit:
            starts.append(first)
            total = 0
        total += held.get(k, 0)
    return starts, least, nulls


def _placed(ids: pa.Array, starts: list) -> np.ndarray:
    """For each id the number of ``starts`` up to it; 0 for null."""
    if not starts:
        return np.zeros(len(ids), dtype=np.int64)
    if isinstance(starts[0], str):
        at = np.array([0 if x is None else bisect_right(starts, x) for x in ids.to_pylist()], dtype=np.int64)
    else:
        at = np.searchsorted(np.array(starts, dtype=np.int64), ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), side="right")
    at[ids.is_null().to_numpy(zero_copy_only=False)] = 0
    return at


def neighbours(df: DataFrame) -> DataFrame:
    """Rows (doc_id, text) dealt to buckets of consecutive ids; sorted, and compressed for the shuffle.

    (bucket, guest, doc_id, tie, packed): a bucket is a partition and ends with a guest, the first row of the next
    bucket (of the first bucket for the last). Buckets begin at ids that occur; only these, at most MOST_BUCKETS, come to the driver.
    """
    starts, least, nulls = bucket_starts(df)
    last = len(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        firsts = pa.array([least, *starts], type=pa.string() if isinstance(least, str) else pa.int64()) if least is not None else None
        for b in batches:
            lost = b.column(0).is_null().to_numpy(zero_copy_only=False)
            bucket = _placed(b.column(0), starts)
            opens = lost.copy() if nulls else np.zeros(b.num_rows, dtype=bool)  # the first row of all
            if firsts is not None:
                begins = pa.compute.equal(b.column(0).cast(firsts.type), firsts.take(pa.array(bucket))).fill_null(False).to_numpy(zero_copy_only=False)
                opens |= begins & ((bucket > 0) | (not nulls))
            for at, to, data, offsets in text_slices(b, 2):
                packed = pa.array([press(data[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())
                own, visit = bucket[at:to], np.flatnonzero(opens[at:to])
                rows = np.concatenate((np.arange(to - at), visit))
                take = pa.array(rows)
                guest = np.repeat([0, 1], [to - at, len(visit)]).astype(np.int32)
                where = np.concatenate((own, np.where(own[visit] > 0, own[visit] - 1, last))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(guest), b.column(0).slice(at, to - at).take(take), b.column(1).slice(at, to - at).take(take), packed.take(take)], names=["bucket", "guest", "doc_id", "tie", "packed"])

    kind = df.schema["doc_id"].dataType.simpleString()
    dealt = map_batches(df.select("doc_id", F.xxhash64("text").alias("tie"), "text"), run, f"bucket int, guest int, doc_id {kind}, tie long, packed binary")
    return dealt.repartitionById(last + 1, F.col("bucket")).sortWithinPartitions("bucket", "guest", "doc_id", "tie")


def edited_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its edited text and the next document.

    (doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next). The
    last quarter (floor) of the code points is replaced by as many of the first of the next
    document, by ascending doc_id; the last is followed by the first. The edited fingerprint
    comes from the document's: paragraphs touched by the edit are deleted and inserted.
    """

    id_type = df.schema[id_col].dataType
    if id_type.simpleString() not in _ID_TYPES:
        raise ValueError(f"{id_col} must be a whole number or a string, not {id_type.simpleString()}")

    def answer(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        """ids: doc_id of texts[k]; texts[k + 1] is the next document's."""
        edited, gone, came, chars = [], [], [], []
        for t, after in zip(texts, texts[1:], strict=False):
            s = t.decode()
            k = len(s) // 4
            e = s[: len(s) - k] + after[: 4 * k].decode(errors="ignore")[:k]
            at = s.rfind("\n", 0, len(s) - k) + 1  # the paragraphs before are untouched
            chars.append(len(s))
            edited.append(e)
            gone.append(s[at:].encode())
            came.append(e[at:].encode())
        exact, lanes = paragraph_sums(texts)
        gone_exact, gone_lanes = paragraph_sums(gone)
        came_exact, came_lanes = paragraph_sums(came)
        e_exact, e_lanes = exact[:-1] - gone_exact + came_exact, lanes[:-1] - gone_lanes + came_lanes
        columns = [
            pa.array(ids, _ID_TYPES[id_type.simpleString()]),
            pa.array(chars, pa.int64()),
            pa.array(edited, pa.string()),
            pa.array(render(exact[:-1], lanes[:-1])),
            pa.array(render(e_exact, e_lanes)),
            pa.array(likeness(exact[:-1], lanes[:-1], e_exact, e_lanes)),
            pa.array(likeness(exact[:-1], lanes[:-1], exact[1:], lanes[1:])),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        ids: list = []
        texts: list[bytes] = []
        size, ended, bucket = 0, False, None
        for b in batches:
            for at, guest, doc_id, packed in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if at != bucket:
                    ids, texts, size, ended, bucket = [], [], 0, False, at
                if ended:  # a further guest
                    continue
                text = unpack(packed)
                texts.append(text)
                size += len(text)
                if not guest:
                    ids.append(doc_id)
                if guest or size > BLOCK and len(texts) > 1:
                    done = len(texts) - 1
                    if done:
                        yield answer(ids[:done], texts)
                    ids, texts, size, ended = ids[done:], texts[-1:], len(texts[-1]), bool(guest)

    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_batches(neighbours(docs), run, f"doc_id {id_type.simpleString()}, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def edited_digest(df: DataFrame) -> DataFrame:
    out = edited_likeness(df)
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
