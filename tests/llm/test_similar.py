import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from litlode.llm import similar, simhash

SF = "/root/testdata/sf0.1"


def shingles(text):
    words = (text or "").encode().translate(simhash._LOWER).split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def survivors(rows):
    """Ids that stay, by comparing every pair of different sets."""
    sets = [shingles(t) for _, t in rows]
    distinct = sorted(set(sets), key=lambda s: (len(s), sorted(s)))
    parent = {s: s for s in distinct}

    def find(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for k, s in enumerate(distinct):
        for o in distinct[:k]:
            shared = len(s & o) if 5 * len(o) >= 4 * len(s) else 0
            if shared and 5 * shared >= 4 * (len(s) + len(o) - shared):
                a, b = find(s), find(o)
                parent[a] = b
    first = {}
    for (k, _), s in zip(rows, sets, strict=True):
        root = find(parent[s])
        first[root] = min(k, first.get(root, k))
    return sorted(first.values())


def made_up():
    rnd, rows = random.Random(3), []
    for _ in range(40):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([3, 6, 30, 80, 300]))]
        for _ in range(6):
            words = list(base)
            for _ in range(rnd.randrange(4)):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(9000)}"
            rows.append(" ".join([*words, *["a line that very many of these texts share"] * rnd.randrange(2)]))
    return list(enumerate([*rows, None, "", " \n", "One", "one", "a b c d e"]))


@pytest.mark.parametrize("cell_rows", [4096, 3])
def test_stage_against_every_pair(spark, cell_rows, monkeypatch):
    monkeypatch.setattr(similar, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(similar, "BLOCK", 8)
    rows = made_up()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, df, SF)
    assert sorted(r.doc_id for r in kept.collect()) == survivors(rows)


def test_stage_drops_near_copies_of_the_given_table(spark):
    """0 and 7818 differ in more than 3 bits."""
    df = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id in (0, 1, 2465, 5733, 7818)")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, SF).collect()) == survivors(rows)
    assert 5733 not in survivors(rows)


def test_candidates_grow_with_the_rows(spark, monkeypatch):
    """Passages whose families grow with the table: a sample of a fixed number of rows misses them, and each family pairs off."""
    monkeypatch.setattr(similar, "SAMPLE_ROWS", 10)
    rnd = random.Random(8)
    passages = [" ".join(f"p{rnd.randrange(5000)}" for _ in range(40)) for _ in range(10)]
    rows = [(" ".join([*(f"w{rnd.randrange(10**6)}" for _ in range(60)), passages[k % 10]]),) for k in range(600)]
    df = spark.createDataFrame(rows, "text string").repartition(3)
    found = similar.in_cells(similar.prefixes(df, *similar.frequent(df, len(rows)))).withColumn("root", F.col("class"))
    assert similar.candidates(found).count() <= len(rows)


def test_frequent_shingles_are_bounded(spark, monkeypatch):
    df = spark.createDataFrame([("a b c d e",)] * 9 + [("b c d e f",)] * 7 + [("c d e f g",)] * 7 + [("one",)] * 2, "text string")
    for bound, counts in ((9, [7, 7, 9]), (2, [9]), (0, [])):
        monkeypatch.setattr(similar, "FREQUENT", bound)
        h, n = similar.frequent(df, 25)
        assert sorted(n.tolist()) == counts and (np.sort(h) == h).all()


def test_odd_rows(spark, empty):
    assert similar.keep_first(empty).count() == 0
    rows = [(3, "b b b"), (5, "a a a"), (5, "b b b"), (7, "a a a"), (None, "c c c"), (None, "c c c"), (8, "d"), (8, "d"), (None, None), (9, "")]
    kept = similar.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame([(3, "b b b"), (5, "a a a"), (None, "c c c"), (8, "d"), (9, "")], kept.schema).collect()))


def test_long_text_by_segments(monkeypatch):
    text = " ".join(f"w{k % 97} X{k % 31}" for k in range(3000)).encode()
    whole = similar.shingle_sets([text])[0]
    assert len(whole) == len(shingles(text.decode()))
    monkeypatch.setattr(similar, "SEGMENT", 50)
    assert similar.shingle_sets([text])[0].tolist() == whole.tolist()


def test_sliced_counts():
    rnd = np.random.default_rng(2)
    x = rnd.integers(0, 1 << 63, (9000, 2), dtype=np.uint64) & rnd.integers(0, 1 << 63, (9000, 2), dtype=np.uint64) & np.where(rnd.random((9000, 1)) < 0.5, ~np.uint64(0), np.uint64(0xFFFF))
    for radius in (0, 5, 20, 52):
        assert simhash.sliced_within(x, radius).tolist() == (np.bitwise_count(x).sum(axis=1) <= radius).tolist()


def test_prints_of_alike_sets_are_near(monkeypatch):
    """Sets at just 0.8, the smallest included: differing bits stay far within the radius."""
    rnd = np.random.default_rng(4)
    sets = []
    for n in [4] * 400 + [8] * 200 + [80] * 200 + [800] * 20:
        whole = rnd.integers(0, 1 << 63, n + n // 4, dtype=np.uint64)
        sets += [np.sort(whole[:n]), np.sort(whole)]
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    whole = similar.wide_prints(np.concatenate(sets), bounds)
    words = np.ascontiguousarray(whole).view("<u8")
    far = np.bitwise_count(words[::2, :2] ^ words[1::2, :2]).sum(axis=1)
    assert far.max() <= similar.RADIUS - 8
    total = np.array([len(a) + len(b) for a, b in zip(sets[::2], sets[1::2], strict=True)])
    assert similar.may_be_alike(words[::2], words[1::2], total).all()
    other = np.roll(words[1::2], 1, axis=0)[400:]
    assert similar.may_be_alike(words[::2][400:], other, total[400:]).mean() < 0.05
    monkeypatch.setattr(similar, "COUNTED", 7)
    assert similar.wide_prints(np.concatenate(sets), bounds).tolist() == whole.tolist()
