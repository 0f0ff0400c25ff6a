import pytest
from pyspark.sql import functions as F

from litlode.functions import normalize as N
from litlode.operators import export, plotdata, sets
from litlode.operators import records as R
from litlode.schema import RECORD
from litlode.sources.corpus import example_records, read_records_csv, write_records_csv


def records(spark, rows):
    return spark.createDataFrame([dict(zip(("entry_number", "scopus_id", "doi", "title", "authors", "year", "date", "publication", "citations", "query"), r, strict=True)) for r in rows], RECORD)


def rec(k, doi=None, sid=None, authors=None, year=None, title="t", source=None):
    return (k, sid, doi, title, authors, year, None, source, None, "q")


def test_normalise(spark):
    raw = spark.createDataFrame(
        [(0, "2-s2.0-85", "", "c", "2020-01-01", "7", ""), (1, None, "a;b", "c", "20", "0", "k | l"), (2, "x2-s2.0-1-2-s2.0-9", None, None, "n.d.", "", None), (3, "2-s2x0-5", "a", None, None, None, None)],
        "position int, eid string, author_names string, creator string, coverDate string, citedby_count string, authkeywords string",
    )
    got = [(r.entry_number, r.scopus_id, r.authors, r.year, r.citations, r.authkeywords) for r in R.to_records(raw, "q", "COMPLETE").orderBy("entry_number").collect()]
    assert got == [(1, "85", "c", 2020, 7, None), (2, None, "a;b", 20, 0, "k | l"), (3, "9", None, None, None, None), (4, "2-s2x0-5", "a", None, None, None)]
    assert R.to_records(raw.limit(0)).columns == RECORD.fieldNames()


def test_tallies(spark):
    df = records(spark, [rec(1, source="Nature", authors="A;B", year=2020), rec(2, source="Nature", authors="A; ", year=2020), rec(3, source="Cell", authors="C;C", year=2019), rec(4, source="")])
    assert [tuple(r) for r in R.top(df).collect()] == [("Nature", 2), ("", 1), ("Cell", 1)]
    assert [tuple(r) for r in R.top(df, "author", 2**31).collect()] == [("A", 2), ("C", 2), ("B", 1)]
    assert [tuple(r) for r in R.year_counts(df).collect()] == [(2019, 1), (2020, 2)]
    for bad in ({"by": "x"}, {"n": -1}):
        with pytest.raises(ValueError):
            R.top(df, **bad)


def test_doi_cleaning_and_sets(spark):
    df = records(spark, [rec(k, d) for k, d in enumerate([" https://doi.org/10.1/A ", "doi:10.1/a", "http://dx.doi.org/10.1/B", "www.doi.org/10.1/c", "  ", None, "10.1/b"], 1)])
    assert [r.doi for r in sets.extract_dois(df, dedupe=False).orderBy("position").collect()] == ["10.1/A", "10.1/a", "10.1/B", "10.1/c", "10.1/b"]
    assert [r.doi for r in sets.extract_dois(df).orderBy("position").collect()] == ["10.1/A", "10.1/B", "10.1/c"]
    old, new = records(spark, [rec(1, "a"), rec(2, "b")]), records(spark, [rec(1, "B"), rec(2, "c")])
    assert [tuple(r) for r in sets.diff_dois(old, new).collect()] == [("c", "added"), ("a", "removed"), ("B", "unchanged")]
    with pytest.raises(ValueError):
        sets.extract_dois(df.drop("doi"))


def test_combine(spark):
    one = records(spark, [rec(1, "10/a", "1"), rec(2), rec(3, "10/X")])
    two = records(spark, [rec(1, "10/b", "1"), rec(2), rec(3, "10/x")])
    merged = sets.combine(one, two, dedupe=True)
    assert [(r.entry_number, r.doi) for r in merged.df.orderBy("entry_number").collect()] == [(1, "10/a"), (2, None), (3, "10/X"), (4, None)]
    assert (merged.provenance.combined.n_in, merged.provenance.combined.n_out, merged.provenance.combined.n_removed) == (6, 4, 2)
    assert sets.combine_frame([one, two]).count() == 6
    ex = example_records(spark)
    assert (ex.count(), ex.filter("doi is not null").count(), ex.filter("publication is not null").count()) == (138, 127, 136)
    told = sets.combine(ex, ex, dedupe=True).provenance.combined
    assert (told.n_in, told.n_out, told.n_removed) == (276, 149, 127)


def test_csv_round_trip(spark, tmp_path):
    ex = example_records(spark)
    ex.write.csv(str(tmp_path / "c"), header=True, escape='"')
    back = read_records_csv(spark, str(tmp_path / "c"))
    assert back.schema == RECORD and back.exceptAll(ex).count() == 0 and back.count() == 138


def test_csv_quoting(spark, tmp_path):
    (tmp_path / "q.csv").write_text('entry_number,scopus_id,doi,title,authors,year,date,publication,citations,query\n1,0012,10/a,"One, ""two""\nthree",A;B,2020,,J,,q\n')
    (row,) = read_records_csv(spark, str(tmp_path / "q.csv"), line_feeds=True).collect()
    assert (row.scopus_id, row.title, row.year, row.citations) == ("0012", 'One, "two"\nthree', 2020, None)
    write_records_csv(records(spark, [rec(1, "10/a", "007", title='a, "b"')]), str(tmp_path / "w"))
    assert read_records_csv(spark, str(tmp_path / "w")).first().title == 'a, "b"'


def test_callers_columns_stay(spark):
    names = ("_set", "_key", "_rank", "_bucket", "_in", "_before", "_was", "_base", "_use", "_c0")
    df = records(spark, [rec(1, "10/a", authors="A", year=2000), rec(2, "10/A", authors="A", year=2000)]).withColumns({n: F.lit("mine") for n in names})
    for out in (sets.combine_frame(df, df, dedupe=True), R.replay(df, 2000), export.bibtex_keys(df)):
        assert all(row[n] == "mine" for row in out.collect() for n in names)


def test_escape_and_keys(spark):
    df = spark.createDataFrame([("a & b % $ # _ { } ~ ^ \\ z",), (None,)], "x string").select(N.bibtex_escape(F.col("x")).alias("y"))
    assert [r.y for r in df.collect()] == [r"a \& b \% \$ \# \_ \{ \} \textasciitilde{} \textasciicircum{} \textbackslash{} z", None]
    rows = [rec(k, authors="De-Silva, J.;B", year=2020) for k in range(1, 30)] + [rec(30, sid="8-5"), rec(31), rec(32, authors=" ;")]
    keys = [r.key for r in export.bibtex_keys(records(spark, rows)).orderBy("entry_number").collect()]
    assert keys[:3] == ["desilva2020", "desilva2020a", "desilva2020b"] and keys[26:29] == ["desilva2020z", "desilva202027", "desilva202028"]
    assert keys[29:] == ["scopus85", "scopusrecord", "scopusrecorda"]
    full = records(spark, [(1, "8", "10/a_b", "T\n  two", "A; B", 2020, None, "J & K", 3, "q"), rec(2, title=" ")])
    entries = export.bibtex_entries(full)
    assert export.to_text(entries) == "@article{a2020,\n  author = {A and B},\n  title = {T two},\n  journal = {J \\& K},\n  year = {2020},\n  doi = {10/a\\_b},\n  note = {Scopus ID: 8},\n}\n\n@article{scopusrecord,\n\n}"
    assert export.to_text(export.ris_entries(full)) == "TY  - JOUR\nTI  - T two\nAU  - A\nAU  - B\nPY  - 2020\nJO  - J & K\nDO  - 10/a_b\nN1  - Scopus ID: 8\nER  - \n\nTY  - JOUR\nER  - "


def test_positions_and_corner(spark):
    df = spark.createDataFrame([(0, 10.0), (1, 10.1), (2, 10.2)], "position int, value double")
    assert [round(r.spread, 6) for r in plotdata.spread_positions(df, 1.0).orderBy("position").collect()] == [10, 11, 12]
    assert [round(r.spread, 6) for r in plotdata.spread_positions(df, 1.0, top=11.5).orderBy("position").collect()] == [9.5, 10.5, 11.5]
    assert plotdata.labels_fit(8) and not plotdata.labels_fit(9)
    assert plotdata.label_room(spark.createDataFrame([("a", 1234567), ("b", 2)], "value string, n bigint")).first()[0] == pytest.approx(0.04 + 0.024 * 9)
    points = spark.createDataFrame([(0.0, 1.0), (0.1, 0.9)], "x double, y double")
    assert plotdata.free_corner(points, "x", "y", (0, 1), (0, 1)).first()[0] == "lower right"
    assert plotdata.free_corner(points, "x", "y", (0, 0), (0, 1)).first()[0] == "upper left"


def test_replay(spark):
    ex = example_records(spark)
    assert [r.entry_number for r in R.replay(ex, 2016, 4).orderBy("entry_number").collect()] == [1, 2, 3, 4]
    assert R.replay(ex, 1900).count() == 0


def test_numbers_are_dense_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(R, "BUCKET_KEYS", 10)
    df = spark.createDataFrame([(k % 3, (k * 7) % 101) for k in range(101)] + [(1, None), (2, 2**40)], "s int, p long").repartition(5)
    rows = R.number_rows(df, "s", "p", name="n").orderBy("n").collect()
    assert [r.n for r in rows] == list(range(1, 104))
    keys = [(r.s, -1 if r.p is None else r.p) for r in rows]
    assert keys == sorted(keys)
