import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from litlode.llm import bpe, packing


@pytest.fixture(scope="module")
def library(vocabulary):
    return Tokenizer.from_file(vocabulary)


def digest(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_as_the_library(documents, plain, library, vocabulary):
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digest(documents, vocabulary).collect())
    assert got == Counter((k, *digest(library, t)) for k, t in plain)


def test_empty(empty, vocabulary):
    assert bpe.encode_digest(empty, vocabulary).count() == 0 and packing.pack_documents(empty, vocabulary).count() == 0


def test_odd_texts_and_chunk_seams(library, vocabulary):
    rnd = random.Random(3)
    pieces = list("aAbB zZ.,'\n\t\r\x0b\x0c\x1c\x85\xa0éÉÄßñİΣςσ̱́HhJj𐐀1२<|>_-—’😀中文 ​﻿") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", " the ", ", ", "x."]
    texts = ["", " ", "a" * 20000, "é" * 9000 + " b"] + ["".join(rnd.choice(pieces) for _ in range(rnd.choice((5, 60, 2500)))) for _ in range(600)]
    encoder = bpe.Encoder(vocabulary)
    raw = [t.encode() for t in texts]
    for (ids, decoded), t in zip(encoder.encode(b"".join(raw), np.cumsum([0] + [len(x) for x in raw])), texts, strict=True):
        expected = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, dtype="<u4").tolist() == expected, ascii(t[:200])
        assert decoded.decode() == library.decode(expected, skip_special_tokens=False)


def made_up_texts(seed=7):
    """Texts that share passages."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghilmnorstu") for _ in range(rnd.randint(1, 9)))
    passages = [" ".join(word() for _ in range(700)) for _ in range(4)]
    return [" ".join([word(), *rnd.sample(passages, 3), word()]) for _ in range(30)]


def test_seams_that_disagree_are_widened(library, vocabulary):
    texts = [t.encode() for t in made_up_texts()]
    offsets = np.cumsum([0] + [len(t) for t in texts])
    expected = [np.array(library.encode(t.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    encoder = bpe.Encoder(vocabulary)
    assert [ids for ids, _ in encoder.encode(b"".join(texts), offsets)] == expected and encoder.widened == 0 and encoder.agreed
    seam = next(s for s in encoder.agreed if s[0] and s[2])
    broken = bpe.Encoder(vocabulary)
    broken._put(seam[1], b"\1\0\0\0" * 3)  # a wrong encoding of the word at a seam
    got = list(broken.encode(b"".join(texts), offsets))
    touched = [k for k, t in enumerate(texts) if (b" " + b" ".join(seam) + b" ") in t]
    assert broken.widened >= len(touched) > 0 and all(got[k] == (expected[k], library.decode(np.frombuffer(expected[k], dtype="<u4").tolist(), skip_special_tokens=False).encode()) for k in touched)


def test_chunks_come_back_from_the_older_generation(library, vocabulary, monkeypatch):
    texts = [t.encode() for t in made_up_texts()]
    monkeypatch.setattr(bpe, "MOST_STORE", 40_000)
    encoder = bpe.Encoder(vocabulary)
    for t in texts:
        ((ids, _),) = encoder.encode(t, np.array([0, len(t)]))
        assert ids == np.array(library.encode(t.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert encoder.stored < 40_000 + 4 * len(t)
    assert encoder.reused > 0.6 * encoder.met  # three of four passages in each text


def test_cut_points_in_blocks(monkeypatch):
    data = np.random.default_rng(3).integers(97, 123, 30_000).astype(np.uint8)
    whole = bpe.cut_points(data).tolist()
    for size in (64, 1000, 4099):
        monkeypatch.setattr(bpe, "HASHED", size)
        assert bpe.cut_points(data).tolist() == whole and len(whole) > 30


def test_chunks_are_shared_and_cover(vocabulary):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    shared = " ".join(word() for _ in range(1500))
    texts = [(word() + " " + shared + " " + word()).encode() for _ in range(2)]
    offsets = np.cumsum([0] + [len(t) for t in texts])
    starts, ends, docs = bpe.chunk_spans(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)
    assert starts[0] == 0 and ends[-1] == offsets[-1] and (starts[1:] == ends[:-1]).all()
    chunks = [b"".join(texts)[s:e] for s, e in zip(starts, ends, strict=True)]
    a, b = ({c for c, d in zip(chunks, docs, strict=True) if d == k} for k in (0, 1))
    assert len(a & b) >= len(a) - 4


def test_decode_round_trip(documents, library, vocabulary):
    encoded = bpe.encode(documents, vocabulary)
    told = {r.doc_id: r.decoded for r in bpe.decode(encoded, vocabulary).collect()}
    assert told == {r.doc_id: r.decoded for r in encoded.collect()}


def test_refuses_other_vocabularies():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing(documents, plain, library, vocabulary):
    rows = packing.pack_documents(documents, vocabulary).collect()
    expected = Counter()
    for k, t in plain:
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        for s in range(0, len(ids), 2048):
            expected[k, s // 2048, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // 2048) + 1


@pytest.mark.parametrize("seed", range(6))
def test_minimum_bin_slack(seed):
    rnd = random.Random(seed)
    counts = Counter(rnd.randint(1, 30) for _ in range(60))
    bins = packing.minimum_bin_slack(dict(counts), 30)
    used = Counter()
    for chosen, times in bins:
        assert sum(n * k for n, k in chosen.items()) <= 30
        for n, k in chosen.items():
            used[n] += k * times
    assert used == counts
    # No bin leaves slack that a combination of what was left could have filled.
    left = Counter(counts)
    for chosen, times in bins:
        free, seed_length = 30 - sum(n * k for n, k in chosen.items()), max(left)
        if free and times:
            pool = sorted((left - Counter({seed_length: 1})).elements())
            sums = {0}
            for n in pool:
                sums |= {s + n for s in sums if s + n <= 30 - seed_length}
            assert max(sums) == sum(n * k for n, k in chosen.items()) - seed_length
        for n, k in chosen.items():
            left[n] -= k * times
        left = +left
    first_fit = []
    for n in sorted(counts.elements(), reverse=True):
        for k, x in enumerate(first_fit):
            if x + n <= 30:
                first_fit[k] += n
                break
        else:
            first_fit.append(n)
    assert sum(t for _, t in bins) <= len(first_fit)


def test_lengths_are_checked():
    with pytest.raises(ValueError):
        packing.minimum_bin_slack({5: 1}, 4)
    assert packing.minimum_bin_slack({}, 4) == []


def test_token_pieces_keep_ids(documents, vocabulary):
    piece = packing.token_pieces(documents, vocabulary).filter(F.col("doc_id") == 100003).first()
    assert np.frombuffer(piece.ids, dtype="<u4")[-1] == 0 and piece.length == len(piece.ids) // 4
