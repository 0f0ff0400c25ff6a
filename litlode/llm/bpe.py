"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the UTF-8 bytes cuts every text where its last 16 bytes hash to a
given residue, so a passage that two documents share is cut at the same places in both.
Each distinct chunk a task meets is encoded once and kept in a bounded store of two
generations, in which chunks that come again move to the younger one. A cut can
fall inside a word, and then the two chunks' encodings are wrong at the seam: the seam is
repaired by encoding the bytes between the last white space of the left chunk and the
first of the right one again; where a chunk has no white space at all, the window grows over
further chunks until it reaches one, or the end of the text. White space ends every pre-token
of the vocabularies that this module takes (see ``check``), so beyond those two places the
chunk's own encoding should be the whole text's. Where ``agree`` is set, which is the default,
that is tested at every seam: the seam with the chunks' words on either side is encoded as one
text by the library, and has to give those words' ids and the seam's, one after the other. A text
with a seam that doesn't agree is encoded as a whole.

The store lives in a worker and is not a table that all tasks share: joining encoded
chunks back to their documents through a shuffle would move the ids, about 1.5 bytes a
character, and the token strings, about 1.7, which is several times the text itself.

Inputs: a null text counts as empty and gives no ids and an empty decoded text. Texts of
any length are taken whole, chunk by chunk. Repeated rows and null or repeated doc_id
give a result each. An empty table gives an empty result. Further columns of the input,
whatever their names, are not read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litlode.llm.common import map_batches

WINDOW = 16
MASK = (1 << 9) - 1
LEAST_CHUNK, MOST_CHUNK = 64, 8192
#: Bounds of a worker's stores: words, and bytes of encoded chunks, in each of two generations; seams known to agree.
MOST_WORDS, MOST_STORE, MOST_AGREED = 150_000, 8 << 20, 50_000
#: Bytes of text that are encoded, and sent on, at a time; bytes that are hashed at a time; longest word that is merged here.
SLICE_BYTES, HASHED, PLAIN = 4 << 20, 1 << 17, 40

_GEAR = np.random.default_rng(20240501).integers(0, 1 << 63, 256, dtype=np.uint64)
_BLANK, _ALNUM, _UPPER = (np.array([bytes([c]) in x for c in range(256)]) for x in ([b" ", b"\t", b"\n", b"\v", b"\f", b"\r"], [bytes([c]) for c in range(128) if chr(c).isalnum()], [bytes([c]) for c in range(65, 91)]))
_STEP = 0x9E3779B97F4A7C15


def cut_points(data: np.ndarray) -> np.ndarray:
    """Places of ``data`` after which a chunk ends: the hash of the last WINDOW bytes decides."""
    places = [np.empty(0, dtype=np.int64)]
    for lo in range(0, len(data), HASHED):
        before = min(lo, WINDOW - 1)
        h = _GEAR[data[lo - before : lo + HASHED]]
        span = 1
        while span < WINDOW:  # h[i] covers the span bytes up to i; twice as many in each turn
            wider = h.copy()
            wider[span:] += h[:-span] * np.uint64(pow(_STEP, span, 1 << 64))
            h, span = wider, span * 2
        found = np.flatnonzero((h >> np.uint64(40)) & np.uint64(MASK) == 0)
        places.append(found[found >= WINDOW - 1] + lo - before)
    found = np.concatenate(places)
    if len(found):
        found = found[np.concatenate(([True], np.diff(found) >= LEAST_CHUNK))]
    return found + 1


def chunk_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the chunks of texts laid end to end in ``data``."""
    starts = np.unique(np.concatenate((offsets[:-1], cut_points(data))))
    starts = starts[starts < offsets[-1]]
    if not len(starts):
        return starts, starts, starts
    ends = np.append(starts[1:], offsets[-1])
    if (ends - starts).max() > MOST_CHUNK:
        starts = np.concatenate([np.arange(s, e, MOST_CHUNK) for s, e in zip(starts, ends, strict=True)])
        ends = np.append(starts[1:], offsets[-1])
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def fold(data: bytes, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Fewer different words with the same encoding: capitals up to U+00DE lowered, and a comma or stop set off from its word.

    Letters are lowered where the next character is ASCII or in U+00C0 to U+00FF, which compose
    with no letter before them; a comma or stop between a letter or digit and white space (or an
    end) is a pre-token of its own in any case. Bytes that may hold a special token are left alone.
    """
    if b"<|" in data or len(data) < 2:
        return data, offsets
    d = np.frombuffer(data, dtype=np.uint8)
    after, before = np.append(d[1:], np.uint8(32)), np.insert(d[:-1], 0, 32)
    capital = _UPPER[d] | ((before == 0xC3) & (d >= 0x80) & (d <= 0x9E) & (d != 0x97))  # the second byte of U+00C0 to U+00DE
    lowered = d + (32 * (capital & ((after < 128) | (after == 0xC3)))).astype(np.uint8)
    at = np.flatnonzero(((d == 44) | (d == 46)) & _BLANK[after])
    latin = np.zeros(len(at), dtype=bool)
    late = at >= 2
    latin[late] = (d[at[late] - 2] == 0xC3) & (before[at[late]] != 0x97) & (before[at[late]] != 0xB7)
    at = at[_ALNUM[before[at]] | latin]
    return np.insert(lowered, at, 32).tobytes(), offsets + np.searchsorted(at, offsets)


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Merger:
    """Byte-pair merges for many words at once: words of a length are rows, and each round merges every row's best pair."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, model: dict) -> None:
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], dtype=np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        codes = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        self.bits = int(len(pairs) * 4).bit_length()
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, self.NONE, dtype=np.int32)
        for rank, (slot, code) in enumerate(zip(self._slot(codes).tolist(), codes.tolist(), strict=True)):
            while self.keys[slot] >= 0:
                if self.keys[slot] == code:
                    break
                slot = (slot + 1) & ((1 << self.bits) - 1)
            else:
                self.keys[slot], self.ranks[slot] = code, rank

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) * np.uint64(_STEP)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE for pairs that don't merge."""
        codes = left.astype(np.int64) << 32 | right
        slots = self._slot(codes)
        held = self.keys[slots]
        ranks = np.where(held == codes, self.ranks[slots], self.NONE)
        todo = np.flatnonzero((held != codes) & (held >= 0))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slots[todo]]
            same = held == codes[todo]
            ranks[todo[same]] = self.ranks[slots[todo[same]]]
            todo = todo[~same & (held >= 0)]
        return ranks

    def words(self, words: list[bytes], data: np.ndarray) -> dict[bytes, bytes]:
        """The ids of words of one length, whose bytes are the rows of ``data``; each word is one pre-token."""
        told: dict[bytes, bytes] = {}
        tokens = self.inner[data]
        tokens[:, -1] = self.last[data[:, -1]]
        at = np.arange(len(words))
        ranks = self.rank(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(len(words), -1)
        while len(at):
            width = tokens.shape[1]
            best = ranks.argmin(axis=1) if width > 1 else np.zeros(len(at), dtype=np.int64)
            low = ranks[np.arange(len(at)), best] if width > 1 else np.full(len(at), self.NONE)
            done = low == self.NONE
            if done.any():
                ids, step = tokens[done].astype("<u4").tobytes(), 4 * width
                told.update(zip([words[k] for k in at[done].tolist()], [ids[k : k + step] for k in range(0, len(ids), step)], strict=True))
                live = ~done
                at, tokens, ranks, best, low = at[live], tokens[live], ranks[live], best[live], low[live]
                if not len(at):
                    break
            rows = np.arange(len(at))
            tokens[rows, best] = self.made[low]
            tokens = np.take_along_axis(tokens, np.arange(width - 1) + (np.arange(width - 1) > best[:, None]), axis=1)
            ranks = np.take_along_axis(ranks, np.arange(width - 2) + (np.arange(width - 2) >= best[:, None]), axis=1) if width > 2 else ranks[:, :0]
            for shift in (0, 1):  # the pairs before and after the merged token
                left = best - 1 + shift
                fine = np.flatnonzero((left >= 0) & (left + 1 < width - 1))
                ranks[fine, left[fine]] = self.rank(tokens[fine, left[fine]], tokens[fine, left[fine] + 1])
        return told


def _laid_out(found: list[bytes], which: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids of words ``which`` of those ``found``, end to end, and the byte at which each word's begin (and the end)."""
    sizes = np.array(list(map(len, found)), dtype=np.int64) // 4
    flat = np.frombuffer(b"".join(found), dtype="<u4")
    begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    counts = sizes[which]
    at = np.concatenate(([0], np.cumsum(counts)))
    take = np.arange(at[-1]) + np.repeat(begin[which] - at[:-1], counts)
    return flat[take].tobytes(), 4 * at


class Encoder:
    """Encodes whole texts through chunks; one for each worker and vocabulary file."""

    def __init__(self, path: str, decoding: bool = True, agree: bool = True) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merger = Merger(check(path))
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.names = {i: t.encode() for t, i in vocab.items()}
        self.decoding = decoding
        self.ids: dict[bytes, bytes] = {b"": b""}
        self.toks: dict[bytes, bytes] = {b"": b""}
        self.old: tuple[dict[bytes, bytes], dict[bytes, bytes]] = {}, {}
        self.store: dict[bytes, tuple] = {}
        self.older: dict[bytes, tuple] = {}
        self.stored = 0
        self.agree = agree
        self.agreed: set[tuple[bytes, bytes, bytes]] = set()
        #: Chunks met and met before, texts encoded as a whole for a seam that didn't agree.
        self.met = self.reused = self.widened = 0

    def _ask(self, words: list[bytes]) -> None:
        """The ids of words without white space.

        A word of lower-case letters up to U+00FF is as the normaliser leaves it and one
        pre-token; such words are merged here, many at a time. The library encodes all others.
        """
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        begin = np.concatenate(([0], np.cumsum(lengths)))
        odd = np.concatenate(([0], np.cumsum((data < 97) | (data > 122))))
        fine = (odd[begin[1:]] == odd[begin[:-1]]) & (lengths > 0) & (lengths <= PLAIN)
        other = []
        for k in np.flatnonzero(~fine).tolist():
            w = words[k]
            if 0 < len(w) <= PLAIN and not w.isascii() and (t := w.decode()).isalpha() and t.islower() and max(t) < "\u0100":
                fine[k] = True
            else:
                other.append(w)
        for n in np.unique(lengths[fine]).tolist():
            which = np.flatnonzero(fine & (lengths == n))
            found = self.merger.words([words[k] for k in which.tolist()], data[begin[which][:, None] + np.arange(n)])
            self.ids.update(found)
            if self.decoding:
                for w, ids in found.items():
                    self._put(w, ids)
        for k in range(0, len(other), 4096):
            part = other[k : k + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([x.decode() for x in part], add_special_tokens=False), strict=True):
                self._put(w, np.array(e.ids, dtype="<u4").tobytes())

    def _put(self, word: bytes, ids: bytes) -> None:
        self.ids[word] = ids
        if self.decoding:
            self.toks[word] = b"".join([self.names[i] + b" " for i in np.frombuffer(ids, dtype="<u4").tolist()])

    def learn(self, words: set[bytes]) -> None:
        """Make ids and token strings known of ``words``, which are not."""
        old_ids, old_toks = self.old
        if old_ids:
            for w in [w for w in words if w in old_ids]:
                self.ids[w] = old_ids[w]
                if self.decoding:
                    self.toks[w] = old_toks[w]
                words.discard(w)
        self._ask(list(words))

    def _look_up(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word."""
        ids = self.ids
        found = list(map(ids.get, words))
        if None in found:
            fresh = [k for k, x in enumerate(found) if x is None]
            self.learn({words[k] for k in fresh})
            for k in fresh:
                found[k] = ids[words[k]]
        return found

    def _chunks(self, fresh: list[bytes]) -> None:
        """Encode chunks and store (head, ids, tokens, tail, first, last): what stands between white space, the two ends, and the first and last word between."""
        if not fresh:
            return
        # Chunks are laid end to end with a space between; words at a chunk's ends may be parts of words and stay out.
        sizes = np.array([len(c) for c in fresh])
        begin = np.concatenate(([0], np.cumsum(sizes + 1)))
        data = np.frombuffer(b" ".join(fresh), dtype=np.uint8)
        inside = ~_BLANK[data]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        at, to = (np.searchsorted(starts, x) for x in (begin[:-1], begin[1:]))
        some = at < to
        headed, tailed = some.copy(), some.copy()
        headed[some] = starts[at[some]] == begin[:-1][some]
        tailed[some] = ends[to[some] - 1] == begin[1:][some] - 1
        single = headed & tailed & (to - at == 1)
        outer = np.unique(np.concatenate((at[headed], to[tailed] - 1)))
        for s, e in zip(starts[outer].tolist(), ends[outer].tolist(), strict=True):
            inside[s:e] = False
        lengths = ends - starts
        lengths[outer] = 0  # an outer word is an empty one
        words = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.py_buffer(data[inside])]).dictionary_encode()
        different = words.dictionary.to_pylist()
        which = words.indices.to_numpy()
        found = self._look_up(different)
        ids, at_id = _laid_out(found, which)
        if self.decoding:
            known = list(map(self.toks.__getitem__, different))
            toks = list(map(known.__getitem__, which.tolist()))
        nothing = np.zeros(1, dtype=np.int64)  # for chunks without words
        first_end, last_start = np.append(ends, nothing)[np.minimum(at, len(ends))] - begin[:-1], np.append(starts, nothing)[to - 1] - begin[:-1]
        table = (at, to, at_id[at], at_id[to], single, headed, tailed, first_end, last_start)
        for c, i, j, x, y, one, first, last, e, s in zip(fresh, *(t.tolist() for t in table), strict=True):
            if one:
                entry = (c, None, b"", b"", b"", b"")
            else:
                edge = (i + first, j - 1 - last) if self.agree and j - i > first + last else None
                words = (different[which[edge[0]]], different[which[edge[1]]]) if edge else (b"", b"")
                entry = (c[:e] if first else b"", ids[x:y], b"".join(toks[i:j]) if self.decoding else b"", c[s:] if last else b"", *words)
            self.store[c] = entry
            self.stored += len(c) + (y - x) + len(entry[2]) + 300

    def trim(self) -> None:
        if len(self.ids) > MOST_WORDS:  # words in use come back from the older store
            self.old = self.ids, self.toks
            self.ids, self.toks = {b"": b""}, {b"": b""}
        if self.stored > MOST_STORE:
            self.older, self.store, self.stored = self.store, {}, 0
        if len(self.agreed) > MOST_AGREED:
            self.agreed.clear()

    def _disagreeing(self, seams: dict[tuple[bytes, bytes, bytes], set[int]]) -> set[int]:
        """The texts with a (word before, seam, word after) that the library encodes otherwise than its parts; what agrees is remembered."""
        todo = [s for s in seams if s not in self.agreed]
        self.learn({w for s in todo for w in s if w not in self.ids})
        wrong: set[int] = set()
        for k in range(0, len(todo), 4096):
            part = todo[k : k + 4096]
            whole = self.tokenizer.encode_batch_fast([b" ".join(filter(None, s)).decode() for s in part], add_special_tokens=False)
            for s, e in zip(part, whole, strict=True):
                if np.array(e.ids, dtype="<u4").tobytes() == b"".join([self.ids[w] for w in s]):
                    self.agreed.add(s)
                else:
                    wrong |= seams[s]
        return wrong

    def _whole(self, text: bytes) -> tuple[bytes, bytes]:
        """The ids and decoded text of a text by the library alone."""
        ids = self.tokenizer.encode(text.decode(), add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes(), b" ".join([self.names[i] for i in ids]) if self.decoding else b""

    def encode(self, data: bytes, offsets: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
        """For each text of ``data`` its ids (little-endian, 32 bits each) and its decoded text."""
        self.trim()
        data, offsets = fold(data, offsets)
        starts, ends, docs = chunk_spans(np.frombuffer(data, dtype=np.uint8), offsets)
        chunks = [data[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        store, fresh = self.store, []
        for c in dict.fromkeys(chunks):
            if c not in store:
                entry = self.older.get(c)
                if entry is None:
                    fresh.append(c)
                else:
                    store[c] = entry
                    self.stored += len(c) + len(entry[1] or b"") + len(entry[2]) + 300
        self.met += len(chunks)
        self.reused += len(chunks) - len(fresh)
        self._chunks(fresh)
        first = np.searchsorted(docs, np.arange(len(offsets)), side="left").tolist()
        told: list[list[tuple[bytes, bytes | None]]] = []  # for each text: chunks' ids and tokens, or (word, None) at a seam
        seams: dict[tuple[bytes, bytes, bytes], set[int]] = {}
        for d in range(len(offsets) - 1):
            parts: list[tuple[bytes, bytes | None]] = []
            seam: list[bytes] = []  # bytes since the last white space: they may go on in the next chunk
            before = b""  # the last word of the chunks so far that no seam touches
            for c in chunks[first[d] : first[d + 1]]:
                head, mid, mid_toks, tail, opens, closes = store[c]
                if head:
                    seam.append(head)
                if mid is None:
                    continue
                if seam:
                    parts.append((b"".join(seam), None))
                    if self.agree and (before or opens):
                        seams.setdefault((before, parts[-1][0], opens), set()).add(d)
                parts.append((mid, mid_toks))
                seam, before = [tail] if tail else [], closes
            if seam:
                parts.append((b"".join(seam), None))
                if self.agree and before:
                    seams.setdefault((before, parts[-1][0], b""), set()).add(d)
            told.append(parts)
        self.learn({w for parts in told for w, t in parts if t is None and w not in self.ids})
        wrong = self._disagreeing(seams)
        self.widened += len(wrong)
        known_ids, known_toks, decoding = self.ids, self.toks, self.decoding
        for d, parts in enumerate(told):
            if d in wrong:
                yield self._whole(data[offsets[d] : offsets[d + 1]])
                continue
            ids = b"".join([known_ids[x] if t is None else x for x, t in parts])
            yield ids, b"".join([known_toks[x] if t is None else t for x, t in parts])[:-1] if decoding else b""


def check(path: str) -> dict:
    """Refuse a vocabulary for which white space does not end every pre-token, or that decodes otherwise.

    Taken are files whose normaliser folds white space, whose splitting pattern has no
    alternative that matches white space, and that have no decoder (tokens are then joined by
    spaces), post-processor, or added token that holds or strips white space; and whose model
    is a byte-level BPE with a suffix for a word's end, which is returned.
    """
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    first = ((t.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    pattern = (first.get("pattern") or {}).get("Regex", " ")
    fine = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and " " not in pattern and "\\s" not in pattern.replace("[^\\s", "")
    steps = (t.get("pre_tokenizer") or {}).get("pretokenizers") or []
    fine = fine and [x["type"] for x in steps[1:]] == ["ByteLevel"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
    m = t["model"]
    fine = fine and m.get("end_of_word_suffix") and not any(m.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    fine = fine and not t.get("decoder") and not t.get("post_processor") and t["model"]["type"] == "BPE"
    fine = fine and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] or "<|" not in a["content"] or any(c.isspace() for c in a["content"]) for a in t["added_tokens"])
    if not fine:
        raise ValueError(f"{path}: not a byte-level vocabulary in which white space ends every pre-token")
    return m


_ENCODERS: dict[tuple[str, bool, bool], Encoder] = {}


def encoder(path: str, decoding: bool = True, agree: bool = True) -> Encoder:
    """The worker's encoder for a vocabulary file; without ``decoding`` the decoded texts are empty, without ``agree`` seams aren't tested."""
    if (path, decoding, agree) not in _ENCODERS:
        _ENCODERS[path, decoding, agree] = Encoder(path, decoding, agree)
    return _ENCODERS[path, decoding, agree]


def text_slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(row, next row, bytes, offsets) for runs of rows of about ``most`` bytes of text; null is empty."""
    col = batch.column(column)
    col = col.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    body = col.buffers()[2]
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        to = min(to, len(col))
        lo, hi = int(offsets[at]), int(offsets[to])
        data = body.slice(lo, hi - lo).to_pybytes() if body is not None and hi > lo else b""
        yield at, to, data, offsets[at : to + 1] - lo
        at = to


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) for every row: ids as little-endian unsigned 32-bit integers in a binary.

    ``ids`` is what the tokenizers library gives for the vocabulary file at ``path`` without
    special tokens added, and ``decoded`` its decode() of them with special tokens kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for at, to, data, offsets in text_slices(b, 1):
                ids, decoded = zip(*enc.encode(data, offsets), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), pa.array(ids, pa.binary()), pa.array([x.decode() for x in decoded], pa.string())], names=["doc_id", "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, ids binary, decoded string")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) from binaries of ids; the token strings joined by spaces; null gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = encoder(path).names
        for b in batches:
            texts = [b" ".join([names[i] for i in np.frombuffer(x.as_py() or b"", dtype="<u4").tolist()]).decode() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")), run, f"doc_id {kind}, decoded string")


def encode_digest(df: DataFrame, path: str) -> DataFrame:
    """The digest columns of ``encode``: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    out = encode(df, path)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
