"""Random inputs against plain Python."""

import random
import re

from pyspark.sql import functions as F

from litlode.functions import normalize as N
from litlode.operators import sets
from litlode.schema import RECORD


def doi_plain(x):
    if x is None:
        return None
    x = re.sub(r"(?i)^(https?://)?(www\.)?(dx\.)?doi\.org/", "", x.strip())
    return re.sub(r"(?i)^doi:", "", x).strip() or None


def test_doi_cleaning(spark):
    rnd = random.Random(2)
    parts = ["http://", "HTTPS://", "www.", "dx.", "doi.org/", "DOI.ORG/", "doi:", "Doi: ", " ", "\t", " ", "10.1/aB", "x", ""]
    texts = [None, *("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 6))) for _ in range(800))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", N.clean_doi(F.col("t")).alias("d"))
    assert {r.k: r.d for r in df.collect()} == {k: doi_plain(t) for k, t in enumerate(texts)}


def test_merge_keeps_the_first_of_each_key(spark):
    rnd = random.Random(3)
    frames, plain = [], []
    for s in range(3):
        rows = [(k, rnd.choice([None, "1", "2", "3"]), rnd.choice([None, "10/A", "10/a", "10/b"]), f"{s}-{k}", None, None, None, None, None, None) for k in range(1, 25)]
        frames.append(spark.createDataFrame(rows, RECORD))
        plain += rows
    seen, kept = set(), []
    for n, r in enumerate(plain):
        key = "id:" + r[1] if r[1] else "doi:" + r[2].lower() if r[2] else f"row:{n}"
        if key not in seen:
            seen.add(key)
            kept.append(r[3])
    merged = sets.combine(*frames, dedupe=True)
    assert [r.title for r in merged.df.orderBy("entry_number").collect()] == kept
    assert merged.provenance.combined.n_removed == len(plain) - len(kept)
    assert [r.title for r in sets.combine_frame(frames).orderBy("entry_number").collect()] == [r[3] for r in plain]


def test_diff_is_set_algebra(spark):
    rnd = random.Random(4)
    make = lambda: [rnd.choice([None, "doi:10/A", "10/a", "https://doi.org/10/B", "10/c", "10/D", " "]) for _ in range(6)]
    for _ in range(3):
        old, new = make(), make()
        frames = [spark.createDataFrame([(k, d) for k, d in enumerate(x)], "entry_number int, doi string") for x in (old, new)]
        first = lambda x: {d.lower(): d for d in reversed([doi_plain(d) for d in x]) if d}
        a, b = first(old), first(new)
        expected = [(b[k], "added") for k in b.keys() - a.keys()] + [(a[k], "removed") for k in a.keys() - b.keys()] + [(b[k], "unchanged") for k in a.keys() & b.keys()]
        assert [tuple(r) for r in sets.diff_dois(*frames).collect()] == sorted(expected, key=lambda x: (x[1], x[0]))
