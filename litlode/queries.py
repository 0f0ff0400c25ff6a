"""The library's queries over the driver tables, each with DuckDB SQL for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litlode.functions.normalize import split_list
from litlode.operators import counts, enrich, export, harvest, plotdata, report, sets
from litlode.operators import records as R
from litlode.plans import adapters as A
from litlode.plans.plan import SearchPlan
from litlode.sources.corpus import Corpus
from litlode.streaming import harvest as stream

YEARS = tuple(range(1995, 2002))
TOPICS = ("red", "blue OR hot", '"small widget"')
PLAN = SearchPlan("HOUSEHOLD OR BUILDING", years=YEARS, field="TITLE", partition="year")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its DuckDB SQL."""

    def take(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return take


# DuckDB's side of the adapters.
_BASE = "base AS (SELECT o_orderkey AS k, * FROM orders JOIN customer ON o_custkey = c_custkey)"
_REC = f"""{_BASE}, rec AS (
  SELECT k + 1 AS entry_number, CASE WHEN k % 5 <> 0 THEN CAST(85000000000 + k % 12000 AS VARCHAR) END AS scopus_id,
    CASE k % 4 WHEN 0 THEN 'https://doi.org/10.5555/ORD-' || (k % 9000) WHEN 1 THEN 'doi:10.5555/ord-' || (k % 9000) WHEN 2 THEN '10.5555/ord-' || (k % 9000) END AS doi,
    o_orderpriority || ' & ' || c_mktsegment || ' #' || k AS title, CASE WHEN k % 58 <> 0 THEN c_name || '; Clerk ' || (k % 50) END AS authors,
    CAST(year(o_orderdate) AS INTEGER) AS year, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN k % 101 <> 0 THEN c_mktsegment END AS publication,
    CAST(floor(o_totalprice / 1000) AS INTEGER) AS citations, 'PUBYEAR IS ' || year(o_orderdate) AS query
  FROM base)"""
_CLEAN = r"nullif(trim(regexp_replace(regexp_replace(trim(doi), '^(https?://)?(www\.)?(dx\.)?doi\.org/', '', 'i'), '^doi:', '', 'i')), '')"
_LINES = "lines AS (SELECT p_name AS title, CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _word(w: str, column: str = "title") -> str:
    return rf"coalesce(regexp_matches(lower({column}), '\b{w}\b'), false)"


_RAW_COLUMNS = f"""
  SELECT k + 1 AS entry_number, CASE WHEN k % 5 <> 0 THEN CAST(85000000000 + k % 12000 AS VARCHAR) END AS scopus_id,
    CASE k % 4 WHEN 0 THEN 'https://doi.org/10.5555/ORD-' || (k % 9000) WHEN 1 THEN 'doi:10.5555/ord-' || (k % 9000) WHEN 2 THEN '10.5555/ord-' || (k % 9000) END AS doi,
    o_orderpriority || ' & ' || c_mktsegment || ' #' || k AS title, CASE WHEN k % 7 = 0 OR k % 58 = 0 THEN c_name ELSE c_name || '; Clerk ' || (k % 50) END AS authors,
    CASE WHEN k % 13 <> 0 AND k % 17 <> 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS year, CASE WHEN k % 13 = 0 THEN 'n.d.' WHEN k % 17 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date,
    CASE WHEN k % 101 <> 0 THEN c_mktsegment END AS publication, CASE WHEN k % 11 <> 0 AND k % 19 <> 0 THEN CAST(floor(o_totalprice / 1000) AS INTEGER) END AS citations, 'q' AS query"""


@query(f"WITH {_BASE} {_RAW_COLUMNS} FROM base")
def records_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.to_records(A.raw_results(spark, sf_dir), "q")


@query(f"WITH {_BASE} {_RAW_COLUMNS}, CASE WHEN k % 6 <> 0 THEN lower(c_mktsegment) || ' | ' || lower(o_orderpriority) END AS authkeywords FROM base")
def records_complete_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.to_records(A.raw_results(spark, sf_dir), "q", "COMPLETE")


@query(f"WITH {_REC} SELECT * FROM rec WHERE citations IS NOT NULL ORDER BY citations DESC, entry_number LIMIT 25")
def top_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_cited(A.records(spark, sf_dir), 25)


@query(f"WITH {_REC} SELECT * REPLACE (row_number() OVER (ORDER BY entry_number) AS entry_number) FROM rec WHERE year = 1998")
def demo_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.replay(A.records(spark, sf_dir), 1998)


@query(f"WITH {_REC} SELECT publication AS value, count(*) AS n FROM rec WHERE publication IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def top_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top(A.records(spark, sf_dir), "source")


@query(f"WITH {_REC} SELECT value, count(*) AS n FROM (SELECT trim(unnest(string_split(authors, ';'))) AS value FROM rec) WHERE value <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def top_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top(A.records(spark, sf_dir), "author", 20)


@query(f"WITH {_REC} SELECT year, count(*) AS n FROM rec WHERE year IS NOT NULL GROUP BY 1")
def year_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.year_counts(A.records(spark, sf_dir))


@query(f"WITH {_REC} SELECT query, min(entry_number) AS first_entry FROM rec GROUP BY 1")
def distinct_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.distinct_expressions(A.records(spark, sf_dir))


def _anywhere(w: str, column: str = "t") -> str:
    """A whole word in letters of any script."""
    return rf"regexp_matches({column}, '(^|[^\p{{L}}\p{{M}}\p{{N}}_]){w}([^\p{{L}}\p{{M}}\p{{N}}_]|$)')"


@query(f"""SELECT 'TITLE-ABS-KEY(the AND NOT (von OR "que la")) AND PUBYEAR AFT 1999 AND PUBYEAR BEF 2020' AS query, count(*) AS n FROM (SELECT lower(text) AS t FROM documents)
  WHERE {_anywhere('the')} AND NOT ({_anywhere('von')} OR {_anywhere('que la')})""")
def count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count(Corpus(A.text_corpus(spark, sf_dir)), 'the AND NOT (von OR "que la")', years=[2000, 2019], field="TITLE-ABS-KEY")


@query(f"WITH {_LINES} SELECT CAST(y AS INTEGER) AS year, count(title) AS n FROM range(1993, 2003) g(y) LEFT JOIN lines ON year = y AND {_word('widget')} GROUP BY 1")
def trend_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.trend(Corpus(A.line_titles(spark, sf_dir)), "widget", range(1993, 2003), field="TITLE")


_COMPARED = f"""WITH {_LINES}, topics(o, label, kind, query) AS (VALUES (0, 'widget', 'reference', 'TITLE(widget)'), (1, 'red', 'comparison', 'TITLE(widget) AND TITLE(red)'), (2, 'blue OR hot', 'comparison', 'TITLE(widget) AND TITLE(blue OR hot)'), (3, '"small widget"', 'comparison', 'TITLE(widget) AND TITLE("small widget")')),
  hits AS (SELECT year, o, count(*) AS n FROM lines, topics WHERE {_word('widget')} AND (o = 0 OR o = 1 AND {_word('red')} OR o = 2 AND ({_word('blue')} OR {_word('hot')}) OR o = 3 AND {_word('small widget')}) GROUP BY ALL),
  grid AS (SELECT t.*, CAST(y AS INTEGER) AS year FROM topics t, range(1995, 2002) g(y)),
  filled AS (SELECT g.*, coalesce(h.n, 0) AS n, coalesce(r.n, 0) AS ref FROM grid g LEFT JOIN hits h USING (year, o) LEFT JOIN hits r ON r.year = g.year AND r.o = 0),
  compared AS (SELECT query, kind AS query_type, label AS abridged_query, year, n, ref AS reference_n, CASE WHEN ref > 0 THEN 100.0::DOUBLE * n / ref END AS comparison_percentage,
    CASE WHEN sum(ref) OVER w > 0 THEN 100.0::DOUBLE * CAST(sum(n) OVER w AS DOUBLE) / CAST(sum(ref) OVER w AS DOUBLE) END AS average_comparison_percentage FROM filled WINDOW w AS (PARTITION BY o))"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.compare_topics(Corpus(A.line_titles(spark, sf_dir)), "widget", TOPICS, YEARS, field="TITLE")


@query(f"{_COMPARED} SELECT * REPLACE (round(comparison_percentage, 6) AS comparison_percentage, round(average_comparison_percentage, 6) AS average_comparison_percentage) FROM compared")
def compare_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_compared(spark, sf_dir))


_CONCEPTS = {"red things": "red", "gears": "gear OR bolt", "small": "TITLE(small)"}
_CROSSED = f"""WITH {_LINES}, c AS (SELECT *, {_word('red')} AS a, {_word('gear')} OR {_word('bolt')} AS b, {_word('small')} AS s FROM lines WHERE year BETWEEN 1996 AND 2000),
  told AS (SELECT unnest([
    {{label: 'red things', query: 'TITLE(red)', n: count(*) FILTER (a), type: 'concept', size: 1, members: 'red things'}},
    {{label: 'gears', query: 'TITLE(gear OR bolt)', n: count(*) FILTER (b), type: 'concept', size: 1, members: 'gears'}},
    {{label: 'small', query: 'TITLE(small)', n: count(*) FILTER (s), type: 'concept', size: 1, members: 'small'}},
    {{label: 'R × gears', query: '(TITLE(red)) AND (TITLE(gear OR bolt))', n: count(*) FILTER (a AND b), type: 'intersection', size: 2, members: 'red things; gears'}},
    {{label: 'gears × small', query: '(TITLE(gear OR bolt)) AND (TITLE(small))', n: count(*) FILTER (b AND s), type: 'intersection', size: 2, members: 'gears; small'}},
    {{label: 'R × small', query: '(TITLE(red)) AND (TITLE(small))', n: count(*) FILTER (a AND s), type: 'intersection', size: 2, members: 'red things; small'}}], recursive := true) FROM c)"""


def _crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = [["red things", "gears"], ["gears", "small"], ["red things", "small"]]
    return counts.intersections(Corpus(A.line_titles(spark, sf_dir)), _CONCEPTS, groups, {"red things": "R"}, years=[1996, 2000], field="TITLE")


@query(f"{_CROSSED} SELECT label, query || ' AND PUBYEAR AFT 1995 AND PUBYEAR BEF 2001' AS query, n, type, size, members FROM told")
def intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crossed(spark, sf_dir)


@query("""WITH t(i, label) AS (VALUES (-1, 'graphene'), (0, 'cv'), (1, 'nlp')), g AS (SELECT i, label, CAST(y AS INTEGER) AS year, 1000 + 120 * (y - 2015) AS ref FROM t, range(2015, 2021) r(y)),
  c AS (SELECT *, CASE WHEN i < 0 THEN ref ELSE CAST(floor(ref * (0.06::DOUBLE + 0.07::DOUBLE * i + 0.03::DOUBLE * (i + 1) * (year - 2015) / 5)) AS BIGINT) END AS n FROM g)
  SELECT CASE WHEN i < 0 THEN label ELSE 'graphene AND ' || label END AS query, CASE WHEN i < 0 THEN 'reference' ELSE 'comparison' END AS query_type, label AS abridged_query, year, n, ref AS reference_n,
    round(100.0::DOUBLE * n / ref, 6) AS comparison_percentage, round(100.0::DOUBLE * CAST(sum(n) OVER (PARTITION BY i) AS DOUBLE) / CAST(sum(ref) OVER (PARTITION BY i) AS DOUBLE), 6) AS average_comparison_percentage FROM c""")
def demo_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(counts.demo_comparison(spark, "graphene", ["cv", "nlp"], range(2015, 2021)))


_WILSON = "(n / ref::DOUBLE + 3.8416 / (2 * ref)) / (1 + 3.8416 / ref) {} (1.96 / (1 + 3.8416 / ref)) * sqrt((n / ref::DOUBLE) * (1 - n / ref::DOUBLE) / ref + 3.8416 / (4 * ref::DOUBLE * ref))"
_BAND = f"{_COMPARED}, band AS (SELECT *, least(100.0, greatest(0.0, 100 * ({_WILSON.format('-')}))) AS lower, least(100.0, greatest(0.0, 100 * ({_WILSON.format('+')}))) AS upper FROM (SELECT *, reference_n AS ref FROM compared WHERE reference_n > 0))"


@query(f"{_BAND} SELECT abridged_query, year, round(lower, 6) AS lower, round(upper, 6) AS upper FROM band")
def wilson_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(plotdata.wilson_band(_compared(spark, sf_dir)))


@query(f"""{_BAND}, shown AS (SELECT * FROM band WHERE query_type = 'comparison' AND comparison_percentage IS NOT NULL),
  ranks AS (SELECT abridged_query, row_number() OVER (ORDER BY max(average_comparison_percentage) DESC, abridged_query) AS rank, sum(n) AS total, max(year) AS last FROM shown GROUP BY 1)
  SELECT abridged_query, year, n, reference_n, round(comparison_percentage, 6) AS comparison_percentage, round(lower, 6) AS lower, round(upper, 6) AS upper,
    abridged_query || ' (n = ' || format('{{:,}}', CAST(total AS BIGINT)) || ')' AS label, rank, year = last AS is_last, (SELECT least(100.0, ceil(max(greatest(comparison_percentage, upper)) / 5) * 5) FROM shown) AS y_max FROM shown JOIN ranks USING (abridged_query)""")
def comparison_plot_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(plotdata.comparison_points(_compared(spark, sf_dir)))


@query(f"""{_CROSSED}, p AS (SELECT label, n::DOUBLE AS n, type FROM told WHERE n > 0), s AS (SELECT greatest(1.0, min(n)) * 0.55 AS x_min, max(n) * 4 AS x_max FROM p)
  SELECT label, n, type AS grouping, row_number() OVER (ORDER BY n, label) AS rank, round(x_min, 6) AS x_min, round(x_max, 6) AS x_max, round(pow(10, 0.024 * log10(x_max / x_min)), 6) AS gap_factor FROM p, s""")
def intersection_plot_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(plotdata.intersection_points(_crossed(spark, sf_dir)))


@query(f"""WITH {_REC}, v AS (SELECT year, avg(citations) AS value FROM rec GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY value, year) - 1 AS j FROM v)
  SELECT year, round(value, 6) AS value, round(max(value - j * 2.5::DOUBLE) OVER (ORDER BY j) + j * 2.5::DOUBLE, 6) AS spread FROM r""")
def spread_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = A.records(spark, sf_dir).groupBy("year").agg(F.avg("citations").alias("value"))
    return _rounded(plotdata.spread_positions(means, 2.5, order="year"))


@query(f"""WITH {_REC}, v AS (SELECT (year - 1995) / 6.0 AS x, (citations) / 600.0 AS y FROM rec), d AS (SELECT min(sqrt(x * x + (y - 1) * (y - 1))) AS a, min(sqrt((x - 1) * (x - 1) + (y - 1) * (y - 1))) AS b, min(sqrt(x * x + y * y)) AS c, min(sqrt((x - 1) * (x - 1) + y * y)) AS e FROM v)
  SELECT CASE greatest(a, b, c, e) WHEN a THEN 'upper left' WHEN b THEN 'upper right' WHEN c THEN 'lower left' ELSE 'lower right' END AS corner FROM d""")
def free_corner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plotdata.free_corner(A.records(spark, sf_dir), "year", "citations", (1995.0, 2001.0), (0.0, 600.0))


@query(f"WITH {_REC}, c AS (SELECT entry_number AS position, {_CLEAN} AS doi FROM rec) SELECT position, doi FROM c WHERE doi IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(doi) ORDER BY position) = 1")
def extract_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.extract_dois(A.records(spark, sf_dir))


@query(f"WITH {_REC}, c AS (SELECT entry_number AS position, {_CLEAN} AS doi FROM rec) SELECT position, doi FROM c WHERE doi IS NOT NULL")
def extract_dois_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.extract_dois(A.records(spark, sf_dir), dedupe=False)


_DIFF = f"""WITH {_REC}, c AS (SELECT *, {_CLEAN} AS d FROM rec),
  a AS (SELECT d, lower(d) AS k FROM c WHERE year <= 2000 AND d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(d) ORDER BY entry_number) = 1),
  b AS (SELECT CASE WHEN year > 1996 THEN upper(d) ELSE d END AS d, lower(d) AS k FROM c WHERE (citations > 20 OR year > 2000) AND d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(d) ORDER BY entry_number) = 1),
  diff AS (SELECT coalesce(b.d, a.d) AS doi, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'unchanged' END AS status FROM a FULL JOIN b ON a.k = b.k)"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot of the years up to 2000 against a later one, which has more years, lacks seldom cited records and spells DOIs otherwise."""
    rec = A.records(spark, sf_dir)
    respelt = F.when(F.col("year") > 1996, F.upper("doi")).otherwise(F.col("doi"))
    return sets.diff_dois(rec.filter("year <= 2000"), rec.filter("citations > 20 or year > 2000").withColumn("doi", respelt))


@query(f"{_DIFF} SELECT doi, status FROM diff")
def diff_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir)


@query(f"{_DIFF} SELECT status, count(*) AS n FROM diff GROUP BY 1")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.diff_summary(_diff(spark, sf_dir))


_SETS = f"""WITH {_REC}, both_sets AS (SELECT 0 AS s, * FROM rec UNION ALL SELECT 1 AS s, * REPLACE (CASE WHEN year > 1997 THEN scopus_id END AS scopus_id, upper(doi) AS doi) FROM rec),
  keyed AS (SELECT *, coalesce('id:' || scopus_id, 'doi:' || lower(doi), 'row:' || s || ':' || entry_number) AS key FROM both_sets)"""


def _sets(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """All records, and all of them again from a source that knows ids of later years only and spells DOIs in capitals."""
    rec = A.records(spark, sf_dir)
    return [rec, rec.withColumn("scopus_id", F.when(F.col("year") > 1997, F.col("scopus_id"))).withColumn("doi", F.upper("doi"))]


@query(f"{_SETS} SELECT row_number() OVER (ORDER BY s, entry_number) AS entry_number, * EXCLUDE (s, key, entry_number) FROM keyed")
def combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.combine_frame(*_sets(spark, sf_dir))


@query(f"{_SETS} SELECT row_number() OVER (ORDER BY s, entry_number) AS entry_number, * EXCLUDE (s, key, entry_number) FROM (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY key ORDER BY s, entry_number) = 1)")
def combine_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.combine_frame(*_sets(spark, sf_dir), dedupe=True)


@query(f"{_SETS} SELECT count(*) AS n_in, count(DISTINCT key) AS n_out, count(*) - count(DISTINCT key) AS n_removed, true AS deduplicated FROM keyed")
def combine_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.combine_accounting(*_sets(spark, sf_dir), dedupe=True)


_CELLS = "cells AS (SELECT CAST(y - 1994 AS INTEGER) AS cell, 'TITLE(HOUSEHOLD OR BUILDING) AND PUBYEAR IS ' || y AS query, CAST(y AS VARCHAR) AS date, CAST(y AS INTEGER) AS year, 'STANDARD' AS view, 200 AS page_size FROM range(1995, 2002) g(y))"
_HELD = f"held AS (SELECT * FROM rec WHERE year BETWEEN 1995 AND 2001 AND ({_word('household')} OR {_word('building')}))"


@query(f"WITH {_CELLS} SELECT * FROM cells")
def plan_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harvest.plan_cells(spark, PLAN)


@query(f"WITH {_REC}, {_HELD} SELECT * REPLACE (row_number() OVER (ORDER BY year, entry_number) AS entry_number, 'TITLE(HOUSEHOLD OR BUILDING) AND PUBYEAR IS ' || year AS query) FROM held")
def fetch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harvest.harvest_frame(Corpus(A.records(spark, sf_dir)), PLAN)


_TOTALS = f"WITH {_REC}, {_HELD}, {_CELLS}, totals AS (SELECT cell, c.date, count(held.year) AS n_records, CASE WHEN cell <> {{}} THEN count(held.year) END AS reported_total FROM cells c LEFT JOIN held ON c.year = held.year GROUP BY cell, c.date)"


@query(f"{_TOTALS.format(4)} SELECT * FROM totals")
def cell_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harvest.cell_totals(Corpus(A.records(spark, sf_dir)), PLAN, unreported=(4,))


@query(f"{_TOTALS.format(99)} SELECT CASE WHEN count(*) = count(reported_total) THEN CAST(sum(reported_total) AS BIGINT) END AS total_results FROM totals")
def total_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harvest.total_results(harvest.cell_totals(Corpus(A.records(spark, sf_dir)), PLAN))


_ABS = f"""{_BASE}, per AS (SELECT l_orderkey, string_agg(DISTINCT p_type, '; ' ORDER BY p_type) AS kw, count(*) AS refs FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
  ids AS (SELECT k AS position, 'https://doi.org/10.5555/ord.' || CASE WHEN k % 10 = 3 THEN k + 100000000 ELSE k END AS id FROM base)"""


@query(f"""WITH {_ABS} SELECT position, CASE WHEN k % 7 = 0 THEN 'copy-' ELSE 'ord-' END || k AS scopus_id, coalesce(CASE WHEN k % 7 = 0 THEN '10.5555/ord.' ELSE '10.5555/ORD.' END || k, id) AS doi, CASE WHEN k % 7 = 0 THEN 'Copy of ' ELSE '' END || o_orderpriority || ' & ' || c_mktsegment || ' #' || k AS title, 'About ' || o_orderpriority || ' & ' || c_mktsegment || ' #' || k AS abstract,
    CASE WHEN k % 101 <> 0 THEN c_mktsegment END AS publication, strftime(o_orderdate, '%Y-%m-%d') AS date, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(floor(o_totalprice / 1000) AS INTEGER) AS citations, kw AS authkeywords, coalesce(refs, 0) AS n_references, CASE WHEN k IS NOT NULL THEN k % 9 = 0 END AS refcount_mismatch
  FROM ids LEFT JOIN base ON id = 'https://doi.org/10.5555/ord.' || k LEFT JOIN per ON l_orderkey = k""")
def abstract_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    number = F.when(k % 10 == 3, k + 100000000).otherwise(k)
    ids = A.order_rows(spark, sf_dir).select(k.alias("position"), F.concat(F.lit("https://doi.org/10.5555/ord."), number.cast("string")).alias("id"))
    found = enrich.lookup_abstracts(ids, A.respelt_documents(spark, sf_dir), include=("keywords", "references"))
    return found.select(*[c for c in found.columns if c != "references"], F.size("references").cast("long").alias("n_references"))


@query(f"""WITH {_ABS} SELECT row_number() OVER (ORDER BY k) AS position, '10.5555/ORD.' || k AS id, o_orderpriority || ' & ' || c_mktsegment || ' #' || k AS title, CAST(year(o_orderdate) AS INTEGER) AS year, coalesce(replace(kw, '; ', '|'), '') AS keywords, coalesce(refs, 0) AS n_references
  FROM base LEFT JOIN per ON l_orderkey = k""")
def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = A.abstract_documents(spark, sf_dir)
    rec = documents.select((F.col("k") + 1).alias("entry_number"), "doi", "title", "year")
    ids = R.number_rows(rec.select("entry_number", "doi"), "entry_number", name="position").select("position", F.col("doi").alias("id"))
    nested = enrich.corpus_table(rec, enrich.lookup_abstracts(ids, documents, include=("keywords", "references")))
    return nested.select("position", "id", "title", "year", F.array_join("keywords", "|").alias("keywords"), F.size("references").cast("long").alias("n_references"))


@query("""WITH d AS (SELECT DISTINCT l_orderkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey)
  SELECT a.p_type AS first, b.p_type AS second, count(*) AS n FROM d a JOIN d b ON a.l_orderkey = b.l_orderkey AND a.p_type < b.p_type GROUP BY ALL""")
def keyword_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.keyword_pairs(A.abstract_documents(spark, sf_dir).select(F.col("k").alias("id"), "keywords"))


_KEYS = f"""WITH {_REC}, b AS (SELECT *, coalesce(nullif(lower(regexp_replace(string_split_regex(trim(string_split(authors, ';')[1]), '[ ,]')[1], '[^A-Za-z0-9]', '', 'g')), '') || year, 'scopus' || nullif(scopus_id, ''), 'scopusrecord') AS stem FROM rec),
  keyed AS (SELECT *, stem || CASE WHEN u = 0 THEN '' WHEN u <= 26 THEN chr(CAST(96 + u AS INTEGER)) ELSE CAST(u AS VARCHAR) END AS key FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY entry_number) - 1 AS u FROM b))"""


@query(f"{_KEYS} SELECT entry_number, key FROM keyed")
def bibtex_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.bibtex_keys(A.records(spark, sf_dir)).select("entry_number", "key")


def _sql_escape(c: str) -> str:
    return f"replace(replace(replace({c}, '&', '\\&'), '#', '\\#'), '_', '\\_')"


@query(f"""{_KEYS} SELECT entry_number, key, '@article{{' || key || ',' || chr(10) || concat_ws(chr(10), '  author = {{' || {_sql_escape("replace(authors, '; ', ' and ')")} || '}},', '  title = {{' || {_sql_escape('title')} || '}},', '  journal = {{' || {_sql_escape('publication')} || '}},',
    '  year = {{' || year || '}},', '  doi = {{' || {_sql_escape('doi')} || '}},', '  note = {{Scopus ID: ' || scopus_id || '}},') || chr(10) || '}}' AS entry FROM keyed""")
def to_bibtex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.bibtex_entries(A.records(spark, sf_dir))


@query(f"""WITH {_REC} SELECT entry_number, concat_ws(chr(10), 'TY  - JOUR', 'TI  - ' || title, 'AU  - ' || replace(authors, '; ', chr(10) || 'AU  - '), 'PY  - ' || year, 'JO  - ' || publication, 'DO  - ' || doi, 'N1  - Scopus ID: ' || scopus_id, 'ER  - ') AS entry FROM rec""")
def to_ris(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.ris_entries(A.records(spark, sf_dir))


@query(f"""{_TOTALS.format(4)} SELECT (SELECT count(*) FROM held) AS n_records, (SELECT count(doi) FROM held) AS n_with_doi, (SELECT min(year) FROM held) AS first_year, (SELECT max(year) FROM held) AS last_year, (SELECT count(DISTINCT query) FROM held) AS n_expressions,
    count(*) AS n_cells, count(reported_total) AS n_cells_reported, CASE WHEN count(*) = count(reported_total) THEN CAST(sum(reported_total) AS BIGINT) END AS reported_total FROM totals""")
def report_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = Corpus(A.records(spark, sf_dir))
    return report.report_facts(harvest.harvest_frame(rec, PLAN), harvest.cell_totals(rec, PLAN, unreported=(4,)))


@query(f"""WITH {_REC}, {_HELD}, {_CELLS}, totals AS (SELECT cell, c.date, c.query, count(held.doi) AS n_records, CASE WHEN cell <> 4 THEN count(held.year) END AS reported_total FROM cells c LEFT JOIN held ON c.year = held.year GROUP BY cell, c.date, c.query)
  SELECT *, CASE WHEN reported_total IS NULL THEN 'unknown' WHEN n_records < reported_total THEN 'incomplete' ELSE 'complete' END AS state FROM totals""")
def report_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A harvest of a source that gives out records with a DOI only, held against the source's own counts."""
    whole = Corpus(A.records(spark, sf_dir))
    said = counts.trend(whole, PLAN.query, PLAN.years, PLAN.field)
    totals = harvest.cell_totals(Corpus(whole.df.filter("doi is not null")), PLAN, unreported=(4,), reported=said)
    return report.report_cells(harvest.plan_cells(spark, PLAN), totals)


@query("SELECT CAST(i AS INTEGER) AS item, [" + ", ".join(f"'{n}'" for n in report.PRISMA_S_ITEMS) + "][i] AS name, CASE WHEN i IN (1, 8, 9, 15) THEN 'record' ELSE 'author' END AS source FROM range(1, 17) r(i)")
def prisma_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.prisma_map(spark, has_expression=True, has_plan=True, has_stamp=False, was_run=True, has_dedupe=False)


@query(f"""{_SETS}, kept AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY key ORDER BY s, entry_number) = 1),
  f AS (SELECT format('{{:,}}', (SELECT count(*) FROM keyed)) AS n_in, format('{{:,}}', count(*)) AS n, format('{{:,}}', count(doi)) AS dois, format('{{:,}}', (SELECT count(*) FROM keyed) - count(*)) AS gone FROM kept)
  SELECT unnest([{{label: 'Database', value: 'the corpus'}}, {{label: 'Search expression', value: 'TITLE(HOUSEHOLD OR BUILDING)'}}, {{label: 'Field tag', value: 'TITLE'}}, {{label: 'Years', value: '1995 to 2001'}}, {{label: 'Partition', value: 'year'}}, {{label: 'Cells', value: '7'}},
    {{label: 'View', value: 'STANDARD'}}, {{label: 'Page size', value: '200'}}, {{label: 'Paging', value: 'not recorded'}}, {{label: 'Date searched', value: 'not recorded'}}, {{label: 'Software version', value: 'not recorded'}}, {{label: 'Records retrieved', value: n}}, {{label: 'Records reported', value: 'not recorded'}},
    {{label: 'Completeness', value: 'not recorded'}}, {{label: 'Records with a DOI', value: dois || ' of ' || n}}, {{label: 'Duplicates removed', value: gone || ' of ' || n_in}}], recursive := true) FROM f""")
def report_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = sets.combine(*_sets(spark, sf_dir), dedupe=True)
    return spark.createDataFrame(report.search_report(merged, PLAN).pairs(), "label STRING, value STRING")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.event_counts(A.table(spark, sf_dir, "events"))


@query(f"WITH {_REC} SELECT author, CAST(count(DISTINCT year) AS BIGINT) AS years, min(year) AS first_year, max(year) AS last_year FROM (SELECT year, trim(unnest(string_split(authors, ';'))) AS author FROM rec) WHERE author <> '' GROUP BY 1")
def author_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.records(spark, sf_dir).select("year", F.explode(split_list(F.col("authors"))).alias("author"))
    return rows.groupBy("author").agg(F.count_distinct("year").alias("years"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
