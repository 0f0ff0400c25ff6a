import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from litlode.llm import common, fingerprints, rpforest, simhash
from litlode.llm.components import components, merge_pairs


def simhash_plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], dtype=np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))


def roots(n, pairs):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


def test_simhash_against_brute_force(documents, plain):
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(documents).collect())
    fps = [simhash_plain(t) for _, t in plain]
    group = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = {}
    for g, (k, _) in zip(group, plain, strict=True):
        if k is not None:
            least[g] = min(k, least.get(g, k))
    assert got == sorted((str(k), f"{f:016x}", str(least.get(g))) for (k, _), f, g in zip(plain, fps, group, strict=True))


def test_keep_first(documents, spark):
    kept = simhash.keep_first(documents)
    assert kept.columns == documents.columns
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents).collect()}
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted({k for k, c in found.items() if k is not None and k == c})
    assert ids.count(None) == 1


def test_texts_under_one_id_stay(spark):
    rows = [(1, "alpha beta gamma delta one"), (1, "totally different text about boats here"), (3, "b b b"), (5, "a a a"), (5, "b b b"), (7, "a a a"), (None, "c c c"), (None, "c c c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, simhash.keep_first(df).collect())) == sorted(map(str, spark.createDataFrame([*rows[:3], rows[3], rows[6]], df.schema).collect()))


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0
    assert fingerprints.edited_digest(empty).count() == 0


@pytest.mark.parametrize("radius", [1, 3, 4])
def test_bit_sliced_forest(radius):
    rnd = np.random.default_rng(radius)
    base = rnd.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ np.array([sum(1 << int(b) for b in rnd.choice(64, k, replace=False)) for _ in base], dtype=np.uint64) for k in (1, 2, 3, 4, 5, 3)]))
    parent = simhash.forest(fps, np.full(len(fps), len(fps)), radius)
    n = len(fps)
    assert parent.tolist() == roots(n, [(i, j) for i in range(n) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= radius])


@pytest.mark.parametrize("n", [10, 10**7, 10**10])
def test_block_masks_lose_nothing(n):
    rnd, masks = random.Random(n), simhash.block_masks(n)
    for _ in range(300):
        flips = sum(1 << b for b in rnd.sample(range(64), 3))
        assert any(not flips & m for m in masks)


def test_long_text_by_segments(monkeypatch):
    text = " ".join(f"w{k % 97} x{k % 31}" for k in range(3000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "SEGMENT", 50)
    assert simhash.fingerprint(text.encode()) == whole == simhash_plain(text)


def test_components(spark):
    rnd = random.Random(4)
    pairs = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(330)] + [(k, k + 1) for k in range(500, 560)] + [(7, 7)]
    rows = components(spark.createDataFrame([*pairs, (None, 1), (3, None)], "a long, b long")).collect()
    expected = roots(600, pairs)
    touched = {x for p in pairs if p[0] != p[1] for x in p}
    assert {r.node: r.root for r in rows} == {x: expected[x] for x in touched} and len(rows) == len(touched)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    i, j = (np.array(x) for x in zip(*pairs, strict=True))
    assert merge_pairs(np.arange(600), i, j).tolist() == expected


def test_hot_keys_meet_once(spark):
    df = common.split_hot_keys(spark.range(0, 100).select(F.when(F.col("id") < 90, 1).otherwise(F.col("id")).alias("k"), "id"), ["k"], "id", bound=20)
    met = {}
    for r in df.collect():
        met.setdefault((r.k, r.cell_a, r.cell_b), []).append((r.id, r.part))
    pairs = []
    for (_, a, b), rows in met.items():
        pairs += [(x, y) for x, p in rows for y, q in rows if x < y and (a == b or p != q)]
    assert sorted(pairs) == [(x, y) for x in range(90) for y in range(x + 1, 90)]
    assert max(map(len, met.values())) < 80


@pytest.mark.parametrize("bucket_bytes", [16 << 20, 20_000])
def test_fingerprint_edits(documents, plain, bucket_bytes, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", bucket_bytes)
    rows = fingerprints.edited_digest(documents).orderBy("doc_id").collect()
    distinct = sorted({(k, t) for k, t in plain if k is not None})
    texts = dict(distinct)
    ids = sorted(texts)
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(plain)
    texts[None] = next(t for k, t in plain if k is None)
    for k, after in zip([*ids, None], [*ids[1:], None, ids[0]], strict=True):  # the null id comes first
        if after == 100003 or k == 100003:  # the repeated row
            continue
        t, n = texts[k], len(texts[k]) // 4
        e = t[: len(t) - n] + texts[after][:n]
        r = by[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        exact, lanes = fingerprints.paragraph_sums([t.encode(), e.encode()])
        assert [r.fingerprint, r.edited_fingerprint] == fingerprints.render(exact, lanes)
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    long = [r for r in rows if r.n_chars > 300 and r.doc_id is not None]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.95


def lanes_plain(text):
    """The likeness lanes of a text from their definition, by the module's word hashes."""
    out = np.zeros(fingerprints.LANES, dtype=np.int64)
    for p in text.split(b"\n"):
        words = [int(fingerprints.word_hashes(np.frombuffer(w, dtype=np.uint8))[0][0]) for w in p.split()]
        for width in fingerprints.WORDS:
            shingles = [words[k : k + width] for k in range(max(1, len(words) - width + 1))] if words else []
            for s in shingles:
                h = width
                for k in range(width):
                    h = (h * fingerprints._BASE + (s[k] if k < len(s) else k)) % 2**64
                h = int(fingerprints._mix(np.array([h], dtype=np.uint64))[0])
                out[h % fingerprints.LANES] += 1 - 2 * (h >> 32 & 1)
    return out


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_likeness_lanes_from_the_definition(block, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK", block)
    rnd = random.Random(1)
    texts = ["", " ", "one", "a b c d", "\n\n", " ".join(f"w{rnd.randrange(9)}" for _ in range(300)), "\n".join(" ".join(f"v{rnd.randrange(9)}" for _ in range(rnd.randrange(40))) for _ in range(20))]
    got = fingerprints.paragraph_sums([t.encode() for t in texts])[1]
    for t, lanes in zip(texts, got, strict=True):
        assert lanes.tolist() == lanes_plain(t.encode()).tolist()


def test_short_texts_can_be_alike():
    show = lambda t: fingerprints.paragraph_sums([t])
    (a, x), (b, y), (c, z) = show(b"alpha beta gamma delta"), show(b"alpha beta gamma omega"), show(b"some other words here")
    assert fingerprints.likeness(a, x, b, y)[0] > 0.3 > fingerprints.likeness(a, x, c, z)[0]


@pytest.mark.parametrize("kind", ["int", "string", "smallint"])
def test_other_kinds_of_ids(spark, kind, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", 300)
    rows = [(k, f"text {k} " + "word " * (k % 9)) for k in range(60)]
    df = spark.createDataFrame([*rows, (None, "lost")], "doc_id int, text string").withColumn("doc_id", F.col("doc_id").cast(kind)).repartition(3)
    got = {r.doc_id: r for r in fingerprints.edited_digest(df).collect()}
    texts = {(str(k) if kind == "string" else k): t for k, t in rows}
    order = [None, *sorted(texts)]
    texts[None] = "lost"
    assert set(got) == set(order)
    for k, after in zip(order, [*order[1:], None], strict=True):
        t, n = texts[k], len(texts[k]) // 4
        assert got[k].edited_sha256 == hashlib.sha256((t[: len(t) - n] + texts[after][:n]).encode()).hexdigest()
    with pytest.raises(ValueError, match="double"):
        fingerprints.edited_digest(df.withColumn("doc_id", F.lit(1.5)))


def test_buckets_are_sized_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", 100_000)
    df = spark.range(3000).selectExpr("id as doc_id", "repeat('x', if(id < 1000, 1000, 10)) as text")
    starts, *_ = fingerprints.bucket_starts(df)
    edges = [0, *starts, 3000]
    held = [sum((1000 if k < 1000 else 10) + 64 for k in range(a, b)) for a, b in zip(edges, edges[1:])]
    assert max(held) <= 125_000 and len(held) < 20
    parts = fingerprints.neighbours(df).groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("bucket").alias("n")).collect()
    assert len(parts) == len(held) and {r.n for r in parts} == {1}


def test_fingerprint_is_homomorphic():
    show = lambda t: fingerprints.render(*fingerprints.paragraph_sums([t.encode()]))[0]
    a, b, c = "first paragraph of some words here", "a second one with other words", "and the third"
    assert show(f"{a}\n{b}\n{c}") == show(f"{c}\n{a}\n{b}") != show(f"{a}\n{b}")
    assert fingerprints.combine(show(f"{a}\n{b}"), inserted=show(c)) == show(f"{a}\n{b}\n{c}")
    assert fingerprints.combine(show(f"{a}\n{b}\n{c}"), deleted=show(b)) == show(f"{a}\n{c}")
    assert show(f"{a}\n{a}") != show(a) and show("") != show("\n")


def test_forest_recall(spark):
    rnd = np.random.default_rng(5)
    centers = rnd.standard_normal((60, 24))
    x = np.concatenate([centers[rnd.integers(0, 60, 1200)] + rnd.standard_normal((1200, 24)) * 0.16, np.repeat(centers[:1], 40, axis=0)])
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)]
    odd = [(5000, None), (5001, [0.0] * 24), (5002, [None] + [1.0] * 23), (5003, [float("nan")] * 24), (5004, [float("inf")] + [1.0] * 23), (5005, []), (5006, [1.0, 2.0]), (5007, [2.0, 4.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("node", F.lit(1)).withColumn("size", F.lit("x"))
    old = rpforest.LEAF_ROWS
    rpforest.LEAF_ROWS = 64
    try:
        got = {r.vec_id: r for r in rpforest.near_duplicates(df).collect()}
    finally:
        rpforest.LEAF_ROWS = old
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    found = np.array([got[k].n_links for k in range(len(u))])
    assert (found <= near.sum(axis=1)).all() and found.sum() >= 0.97 * near.sum() > 1000
    for k in range(5000, 5006):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert (got[5006].n_links, got[5007].component_id, got[5007].kept) == (1, 5006, False)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert rpforest.near_duplicates(df.limit(0)).count() == 0


def planted(n, d, seed):
    """Unit vectors: most alone, pairs at cosines from 0.95 to 0.96, and dense clusters."""
    rnd = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    a = unit(rnd.standard_normal((n // 5, d)))
    across = rnd.standard_normal(a.shape)
    across = unit(across - (across * a).sum(axis=1, keepdims=True) * a)
    cosine = rnd.uniform(0.9501, 0.96, (len(a), 1))
    clusters = np.repeat(unit(rnd.standard_normal((20, d))), n // 400, axis=0)
    clusters = unit(clusters + rnd.standard_normal(clusters.shape) * 0.3 / np.sqrt(d))
    rest = unit(rnd.standard_normal((n - 2 * len(a) - len(clusters), d)))
    return np.concatenate([a, cosine * a + np.sqrt(1 - cosine**2) * across, clusters, rest]).astype(np.float32)


@pytest.mark.parametrize("sample", [2_000_000, 40_000])
def test_query_recall_on_fifty_thousand(spark, tmp_path, sample, monkeypatch):
    """The registered query against every pair; with a small sample most leaves are split again on the executors."""
    from litlode.llm import queries

    monkeypatch.setattr(rpforest, "SAMPLE_FLOATS", sample)
    x = planted(50_000, 48, 6)
    table = pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 48).cast(pa.list_(pa.float32())), "label": np.zeros(len(x))})
    pq.write_table(table, tmp_path / "embeddings.parquet", row_group_size=8192)
    got = {r.vec_id: r for r in queries.op8_projection_forest(spark, str(tmp_path)).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    count, pairs = np.zeros(len(u), dtype=int), []
    for lo in range(0, len(u), 2048):
        i, j = np.nonzero(u[lo : lo + 2048].astype(np.float32) @ u.astype(np.float32).T >= 0.95 - 1e-5)
        i += lo
        fine = (i != j) & (np.einsum("ij,ij->i", u[i], u[j]) >= 0.95)
        count += np.bincount(i[fine], minlength=len(u))
        pairs += zip(i[fine].tolist(), j[fine].tolist(), strict=True)
    found = np.array([got[k].n_links for k in range(len(u))])
    assert (found <= count).all() and found.sum() >= 0.99 * count.sum() > 20_000
    least = roots(len(u), pairs)
    assert sum(got[k].component_id == least[k] for k in range(len(u))) > 0.99 * len(u)


@pytest.mark.parametrize("n", [4_000, 16_000])
def test_leaves_stay_bounded(spark, n, monkeypatch):
    monkeypatch.setattr(rpforest, "SAMPLE_FLOATS", 3200)
    monkeypatch.setattr(rpforest, "LEAF_ROWS", 64)
    monkeypatch.setattr(rpforest, "SPLIT_ROWS", 300)
    monkeypatch.setattr(rpforest, "ROUTE_ROWS", 500)
    rnd = np.random.default_rng(n)
    x = rnd.standard_normal((n, 32)).astype("<f4")
    vectors = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in enumerate(x)], "node long, packed binary").repartition(4)
    units = (x / np.linalg.norm(x, axis=1, keepdims=True))[:100].astype(float)
    forest = {32: [rpforest.fit_tree(units, 16, 0.95, np.random.default_rng(t)) for t in range(3)]}
    rows = rpforest.bounded_leaves(vectors, forest, 0.95, False, 1).groupBy("leaf").count().collect()
    assert max(r["count"] for r in rows) <= 128 and sum(r["count"] for r in rows) >= 3 * n
    assert len({r.leaf >> 56 for r in rows}) == 3


def test_vectors_beyond_32_bits(spark):
    rows = [(1, [1.0, 1e-12]), (2, [1.0, 0.1]), (3, [0.1, 1.0]), (4, [1e200, 1e199])]
    got = {r.vec_id: r.n_links for r in rpforest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: 2, 2: 2, 3: 0, 4: 2}


def test_counts_across_trees_are_exact(spark):
    """Without spill or with many trees a pair is counted once: in one leaf everything is found."""
    rnd = np.random.default_rng(8)
    x = rnd.standard_normal((1, 16)) + rnd.standard_normal((300, 16)) * 0.15
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95).sum(axis=1) - 1
    assert [r.n_links for r in rpforest.near_duplicates(df, trees=5).orderBy("vec_id").collect()] == near.tolist()
