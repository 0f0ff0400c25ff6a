import pytest
from pyspark.sql import functions as F

from litlode.functions import stats
from litlode.operators import counts, plotdata
from litlode.plans import adapters
from litlode.sources.corpus import Corpus


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [("red widget", 2015)] * 2 + [("blue widget", 2015)] + [("red widget", 2017)] + [("red gear", 2016)]
    return Corpus(spark.createDataFrame(rows, "title string, year int"))


def test_count_widens_and_trend_does_not(corpus):
    assert counts.count(corpus, "red", [2015, 2017], "title").first()["n"] == 4
    assert [tuple(r) for r in counts.trend(corpus, "red", [2015, 2017, 2018], "TITLE").collect()] == [(2015, 2), (2017, 1), (2018, 0)]


def test_compare(corpus):
    rows = counts.compare_topics(corpus, "widget", ["red", " blue "], [2015, 2016, 2017], "TITLE").collect()
    assert [(r.abridged_query, r.year, r.n, r.reference_n, r.comparison_percentage) for r in rows[:3]] == [("widget", 2015, 3, 3, 100.0), ("widget", 2016, 0, 0, None), ("widget", 2017, 1, 1, 100.0)]
    assert [r.abridged_query for r in rows] == ["widget"] * 3 + ["red"] * 3 + ["blue"] * 3
    assert rows[3].average_comparison_percentage == 75.0
    with pytest.raises(ValueError):
        counts.compare_topics(corpus, "widget", ["red", " "], [2015])


def test_compare_scans_once_without_python(spark, sf_dir):
    df = counts.compare_topics(Corpus(adapters.table(spark, sf_dir, "lineitem").select(F.lit("red widget").alias("title"), F.year("l_shipdate").alias("year"))), "widget", ["red", "blue", "hot"], range(1995, 2000), "TITLE")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Python" not in plan


def test_year_limit_is_pushed_down(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.createDataFrame([("a", "x", 2000), ("b", "y", 2001)], "title string, abstract string, year int").write.parquet(path)
    plan = Corpus.parquet(spark, path).scan("TITLE(a)", (2000, 2000)).select("title")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(year,2000)" in plan and "abstract" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize(("n", "ref", "shares", "average"), [([20, 40], [100, 100], [20, 40], 30), ([100, 500, 300], [1000, None, 2000], [10, None, 15], 400 / 30), ([5], [0], [None], None)])
def test_shares(spark, n, ref, shares, average):
    rows = [("q", "comparison", "t", 2000 + k, a, b) for k, (a, b) in enumerate(zip(n, ref, strict=True))]
    got = counts.shares(spark.createDataFrame(rows, "query string, query_type string, abridged_query string, year int, n bigint, reference_n bigint")).orderBy("year").collect()
    assert [r.comparison_percentage for r in got] == shares
    assert got[0].average_comparison_percentage == (average if average is None else pytest.approx(average))


def test_wilson(spark):
    lo, hi = stats.wilson(F.col("x"), F.col("n"))
    rows = spark.createDataFrame([(20, 100), (0, 10), (5, 0)], "x bigint, n bigint").select(lo, hi).collect()
    assert rows[0][0] < 20 < rows[0][1] and rows[1][0] == 0 and rows[2][0] is None


def test_intersections(corpus):
    concepts = {"r": "red", "w": "TITLE(widget)", "g": "gear"}
    rows = counts.intersections(corpus, concepts, [["r", "w"], ["r", "g"]], {"r": "R"}, field="TITLE").collect()
    assert [(r.label, r.n, r.type, r.size, r.members) for r in rows] == [("r", 4, "concept", 1, "r"), ("w", 4, "concept", 1, "w"), ("g", 1, "concept", 1, "g"), ("R × w", 3, "intersection", 2, "r; w"), ("R × g", 1, "intersection", 2, "r; g")]
    assert rows[3].query == "(TITLE(red)) AND (TITLE(widget))"
    assert counts.intersection_plan(concepts, ["r", "w"])[-1][0] == "r × w"
    for bad in ([["r"]], [["r", "r"]], [["r", "x"]], [["r", "w"], ["r", "w"]]):
        with pytest.raises(ValueError):
            counts.intersection_plan(concepts, bad)
    with pytest.raises(ValueError):
        counts.intersection_plan(concepts, None, {"x": "X"})
    with pytest.raises(ValueError):
        counts.intersection_plan({})


def test_plot_points(spark):
    df = counts.demo_comparison(spark, "ref", ["a", "b"], [2015, 2016])
    points = plotdata.comparison_points(df).orderBy("rank", "year").collect()
    assert [p.rank for p in points] == [1, 1, 2, 2] and points[1].is_last and not points[0].is_last and points[0].label.startswith(points[0].abridged_query + " (n = ")
    assert {p.y_max % 5 for p in points} == {0}
    table = spark.createDataFrame([("a", "q", 10, "concept", 1, "a"), ("b", "q", 0, "concept", 1, "b")], "label string, query string, n bigint, type string, size int, members string")
    assert [r.label for r in plotdata.intersection_points(table).collect()] == ["a"]
