import warnings
from dataclasses import replace
from datetime import UTC, datetime, timedelta, timezone

import pytest

from litlode.operators import enrich, harvest, report, workbench
from litlode.operators import records as R
from litlode.plans.plan import SearchPlan
from litlode.schema import REFERENCE_FIELDS, Combined, ForbiddenError, Provenance, RecordSet
from litlode.sources.corpus import Corpus, example_records
from litlode.streaming.harvest import harvest_stream

PLAN = SearchPlan("sample", years=[2015, 2016], field="TITLE", partition="year")


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus(example_records(spark).cache())


def test_fetch_and_resume(corpus, tmp_path):
    first = harvest.fetch_plan(corpus, PLAN, str(tmp_path))
    rows = first.df.orderBy("entry_number").collect()
    assert [r.entry_number for r in rows] == list(range(1, 25)) and rows[0].query == "TITLE(sample) AND PUBYEAR IS 2015"
    assert first.provenance.total_results == 24 and first.provenance.retrieved_at and first.provenance.cell_totals == ((1, "2015", 15, 15), (2, "2016", 9, 9))
    again = harvest.fetch_plan(corpus, PLAN, str(tmp_path))
    assert again.df.count() == 24 and again.provenance.total_results is None and again.provenance.retrieved_at is None
    assert harvest.harvest_frame(corpus, PLAN).exceptAll(first.df).count() == 0


def test_foreign_and_damaged_checkpoints(corpus, tmp_path):
    empty = SearchPlan("nothing", years=[2015, 2016], field="TITLE", partition="year")
    assert harvest.fetch_plan(corpus, empty, str(tmp_path)).df.count() == 0
    with pytest.warns(UserWarning, match="another search"):  # an empty cell of another plan isn't taken either
        assert harvest.fetch_plan(corpus, PLAN, str(tmp_path)).df.count() == 24
    for part in (tmp_path / "cell=001" / "rows").glob("*.parquet"):
        part.write_bytes(b"PAR1 no more")
    for crc in (tmp_path / "cell=001" / "rows").glob(".*.crc"):
        crc.unlink()
    with pytest.warns(UserWarning, match="cannot be read"):
        assert harvest.fetch_plan(corpus, PLAN, str(tmp_path)).df.count() == 24
    (tmp_path / "cell=002" / "rows" / "_SUCCESS").unlink()
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert harvest.fetch_plan(corpus, PLAN, str(tmp_path)).df.count() == 24


def test_stop_shortfall_and_unknown_totals(corpus):
    calls = iter([False, True])
    part = harvest.fetch_plan(corpus, PLAN, should_stop=lambda: next(calls))
    assert part.df.count() == 15 and len(part.provenance.cell_totals) == 1
    with pytest.warns(UserWarning, match="15 of 20"):
        short = harvest.fetch_plan(corpus, PLAN, reported=lambda c: 20 if c.cell == 1 else None)
    assert short.provenance.total_results is None
    none = harvest.fetch_plan(corpus, PLAN, should_stop=lambda: True)
    assert none.df.count() == 0 and none.provenance.total_results is None
    with pytest.raises(ValueError):
        harvest.fetch_plan(corpus, "query")


def test_totals(spark, corpus):
    assert harvest.total_results(harvest.cell_totals(corpus, PLAN)).first()[0] == 24
    assert harvest.total_results(harvest.cell_totals(corpus, PLAN, unreported=(1,))).first()[0] is None
    assert harvest.total_results(harvest.totals_frame(spark, Provenance())).first()[0] is None


def test_totals_of_a_source_that_has_more(spark, corpus):
    said = spark.createDataFrame([(2015, 20), (2016, 9)], "year int, n bigint")
    totals = harvest.cell_totals(corpus, PLAN, reported=said)
    assert sorted(map(tuple, totals.collect())) == [(1, "2015", 15, 20), (2, "2016", 9, 9)]
    assert [r.state for r in report.report_cells(harvest.plan_cells(spark, PLAN), totals).orderBy("cell").collect()] == ["incomplete", "complete"]


def test_many_expressions_and_stamps(spark, monkeypatch):
    df = spark.range(1, 1501).selectExpr("id as entry_number", "cast(null as string) as scopus_id", "cast(null as string) as doi", "2000 as year", "concat('q', id) as query")
    assert report.search_report(RecordSet(df)).expressions == tuple(f"q{k}" for k in range(1, 1501))
    monkeypatch.setattr(report, "MOST_EXPRESSIONS", 1499)
    with pytest.raises(ValueError, match="1,500"):
        report.search_report(RecordSet(df))
    late = datetime(2026, 1, 1, 3, 30, tzinfo=timezone(timedelta(hours=9)))
    assert (report.utc_stamp(late), report.long_date(late)) == ("2025-12-31 18:30:00 UTC", "31 December 2025")


def test_report(spark, corpus, tmp_path):
    plan = SearchPlan("sample", years=range(2015, 2025), field="TITLE", partition="year")
    found = harvest.fetch_plan(corpus, plan)
    known = replace(found.provenance, combined=Combined(149, 138, True), retrieved_at=datetime(2026, 7, 22, 9, 15, tzinfo=UTC))
    r = report.search_report(RecordSet(found.df, known), file=str(tmp_path / "r.md"))
    facts = dict(r.pairs())
    assert facts["Records retrieved"] == "138" and facts["Records with a DOI"] == "127 of 138" and facts["Duplicates removed"] == "11 of 149" and facts["Date searched"] == "2026-07-22 09:15:00 UTC"
    assert (r.n_identified, r.n_removed, len(r.cells)) == (149, 11, 10) and all("complete" in line for line in r.cell_lines())
    assert [k for k, _, s in r.prisma if s == "record"] == [1, 8, 9, 13, 15, 16]
    assert "22 July 2026" in r.format("paragraph") and (tmp_path / "r.md").read_bytes().endswith(b"\n")
    with pytest.raises(ValueError):
        r.format("poem")
    with pytest.raises(ValueError):
        report.search_report(found, file=" ")
    unrun = report.search_report(plan)
    assert dict(unrun.pairs())["Records retrieved"] == "not run" and [k for k, _, s in unrun.prisma if s == "record"] == [1, 8, 9]
    other = report.search_report(RecordSet(found.df, Provenance(cell_totals=((1, None, 138, 138),))), plan)
    assert all(c[2] is None for c in other.cells)  # the accounting is of other cells
    code = report._plan_code(plan)
    assert eval(code, {"SearchPlan": SearchPlan}) == plan
    assert report.expression_years(found.df).first()["first"] == 2015


def test_enrichment(spark):
    reference = {f: None for f in REFERENCE_FIELDS} | {"position": "1", "id": "r1"}
    schema = "scopus_id string, doi string, title string, authkeywords string, refcount string, `references` array<struct<" + ",".join(f"`{f}`:string" for f in REFERENCE_FIELDS) + ">>"
    docs = spark.createDataFrame([("1", "10/A", "one", "k1; k2;", "2", [reference]), ("2", "10/b", "two", None, None, None)], schema)
    ids = spark.createDataFrame([(1, "https://doi.org/10/a"), (2, "10/zz"), (3, "10/a"), (4, "10/B")], "position int, id string")
    rows = enrich.lookup_abstracts(ids, docs, include=("keywords", "references")).orderBy("position").collect()
    assert [(r.doi, r.title, r.authkeywords, len(r.references), r.refcount_mismatch) for r in rows] == [("10/A", "one", "k1; k2", 1, True), ("10/zz", None, None, 0, None), ("10/A", "one", "k1; k2", 1, True), ("10/b", "two", None, 0, None)]
    with pytest.raises(ValueError):
        enrich.lookup_abstracts(ids, docs, by="title")
    rec = spark.createDataFrame([(1, None, "none", 2000), (2, "10/a", "own title", 2001)], "entry_number bigint, doi string, title string, year int")
    known = R.number_rows(rec.filter("doi is not null"), "entry_number", name="position").selectExpr("position", "doi as id")
    (row,) = enrich.corpus_table(rec, enrich.lookup_abstracts(known, docs, include=("keywords", "references"))).collect()
    assert (row.id, row.title, row.year, row.keywords) == ("10/a", "own title", 2001, ["k1", "k2"])
    assert tuple(enrich.dropped_ids(rec).first()) == (1, 1)
    pairs = enrich.keyword_pairs(spark.createDataFrame([(1, ["b", "a", "c"]), (2, ["a", "b"]), (3, None), (4, ["x"])], "id int, keywords array<string>"))
    assert sorted(tuple(r) for r in pairs.collect()) == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]


def test_one_row_for_each_id(spark):
    docs = spark.createDataFrame([("2", "10/A", "later"), ("1", "10/a", "first"), (None, "10/a", "none")], "scopus_id string, doi string, title string")
    ids = spark.createDataFrame([(1, "10/a"), (2, "10/A"), (3, None)], "position int, id string")
    assert [(r.position, r.title) for r in enrich.lookup_abstracts(ids, docs).orderBy("position").collect()] == [(1, "first"), (2, "first"), (3, None)]


def test_retrieval_resumes_and_stops(spark, tmp_path):
    docs = spark.createDataFrame([("1", "10/a", "one"), ("2", "10/b", "two"), ("3", "10/c", "three")], "scopus_id string, doi string, title string")
    ids = lambda *x: spark.createDataFrame(list(enumerate(x)), "position int, id string")
    asked = []

    def source(keys):
        asked.append(sorted(r.key for r in keys.collect()))
        return docs

    got = enrich.retrieve_abstracts(ids("10/A", "10/zz", "10/a"), source, cache_dir=str(tmp_path))
    assert [r.title for r in got.df.orderBy("position").collect()] == ["one", None, "one"] and (got.n_requests, got.n_cached, got.n_missing) == (2, 0, 1)
    again = enrich.retrieve_abstracts(ids("10/a", "10/b", "10/zz"), source, cache_dir=str(tmp_path))
    assert [r.title for r in again.df.orderBy("position").collect()] == ["one", "two", None] and (again.n_requests, again.n_cached, again.n_missing) == (2, 1, 1)
    assert asked == [["10/a", "10/zz"], ["10/b", "10/zz"]]
    richer = enrich.retrieve_abstracts(ids("10/a"), source, include=("keywords",), cache_dir=str(tmp_path))
    assert richer.n_requests == 1 and "authkeywords" in richer.df.columns
    fresh = enrich.retrieve_abstracts(ids("10/a"), source, cache_dir=str(tmp_path), resume=False)
    assert fresh.n_requests == 1 and fresh.df.first().title == "one"

    def refuse(keys):
        raise PermissionError("403")

    with pytest.raises(ForbiddenError, match="1 keys are left"):
        enrich.retrieve_abstracts(ids("10/a", "10/c"), refuse, cache_dir=str(tmp_path))
    for part in (tmp_path / "doi").glob("*.parquet"):
        part.write_bytes(b"no Parquet")
    for crc in (tmp_path / "doi").glob(".*.crc"):
        crc.unlink()
    with pytest.warns(UserWarning, match="can't be read"):
        assert enrich._stored(spark, str(tmp_path / "doi")) is None


def test_records_without_ids(spark):
    rec = spark.createDataFrame([(1, None), (2, "10/a")], "entry_number bigint, doi string")
    with pytest.warns(UserWarning, match="1 records without a doi"):
        assert enrich.usable_ids(rec).count() == 1
    with pytest.raises(ValueError, match="no record"):
        enrich.usable_ids(rec.filter("doi is null"))


def test_session_folders_differ():
    assert workbench.session_folder("/x/") != workbench.session_folder("/x") and workbench.session_folder("/x/").startswith("/x/")


def test_workbench(capsys):
    assert [workbench.years_code(y) for y in ([2015, 2016, 2017], [2015], [2015, 2017], None)] == ["range(2015, 2018)", "[2015]", "[2015, 2017]", None]
    code = workbench.mirror_code("x y", [2015, 2016], "TITLE", compare_terms=["a", " "])
    compile(code, "mirror", "exec")
    assert "compare_topics" in code and "compare_topics" not in workbench.mirror_code("x", None, compare_terms=["a"])
    assert workbench.parse_progress("Cell 1/3: a\nCell 2/3: b") == (2, 3) and workbench.parse_progress("Cell 4/3:") is None and workbench.parse_progress("") is None
    assert workbench.request_cost(9, 10) == (100, True)
    assert workbench.main(["--years", "2015-2016", "q"]) == 0 and "SearchPlan" in capsys.readouterr().out


def test_stream(spark, corpus, tmp_path):
    src, target, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    rows = corpus.df
    rows.filter("entry_number <= 50").write.parquet(src)
    assert harvest_stream(spark, src, rows.schema, "TITLE(sample)", target, ck) == 50
    assert spark.read.parquet(target).count() == 50
    rows.filter("entry_number > 40").write.mode("append").parquet(src)
    added = harvest_stream(spark, src, rows.schema, "TITLE(sample)", target, ck)
    assert spark.read.parquet(target).filter("doi is not null").count() == 127 and spark.read.parquet(target).count() == 50 + added
    assert harvest_stream(spark, src, rows.schema, "TITLE(sample)", target, ck) == 0
