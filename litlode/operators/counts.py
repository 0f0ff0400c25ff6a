"""Count-only analytics: any number of queries and years in one scan of the corpus."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litlode.functions import stats
from litlode.plans.plan import check_years
from litlode.plans.query_lang import predicate, wrap_concept, wrap_field, year_clause
from litlode.sources.corpus import Corpus


def count(corpus: Corpus, query: str, years=None, field: str | None = None) -> DataFrame:
    """(query, n) of one row; several years widen to their span."""
    limits = check_years(years)
    wrapped = wrap_field(query, field)
    shown = wrapped if limits is None else f"{wrapped} AND {year_clause(limits[0], limits[-1])}"
    span = None if limits is None else (limits[0], limits[-1])
    return corpus.scan(wrapped, span).agg(F.count("*").alias("n")).select(F.lit(shown).alias("query"), "n")


def year_grid(spark: SparkSession, years: Sequence[int]) -> DataFrame:
    return spark.createDataFrame([(y,) for y in years], "year int")


def trend(corpus: Corpus, query: str, years, field: str | None = None) -> DataFrame:
    """(year, n) for every year asked for, zeros included."""
    wanted = check_years(years)
    if wanted is None:
        raise ValueError("a trend needs years")
    found = corpus.df.filter(F.col("year").isin(*wanted)).filter(corpus.matches(wrap_field(query, field))).groupBy("year").agg(F.count("*").alias("n"))
    grid = year_grid(corpus.df.sparkSession, wanted)
    return grid.join(F.broadcast(found), "year", "left").select("year", F.coalesce("n", F.lit(0)).cast("long").alias("n")).orderBy("year")  # a row for each year


def comparison_terms(terms: str | Iterable[str]) -> list[str]:
    out = [t.strip() for t in ([terms] if isinstance(terms, str) else terms)]
    if not out or not all(out):
        raise ValueError("comparison terms must be non-empty")
    return out


def shares(counts: DataFrame) -> DataFrame:
    """Adds yearly and whole-period percentages to (query, query_type, abridged_query, year, n, reference_n).

    The period's share takes the years with both counts; a reference of zero counts there, but
    has no share of its own.
    """
    both = F.col("n").isNotNull() & F.col("reference_n").isNotNull()
    topic = Window.partitionBy("query_type", "query", "abridged_query")
    total = lambda c: F.sum(F.when(both, F.col(c))).over(topic)
    return counts.select("*", stats.percentage(F.col("n"), F.col("reference_n")).alias("comparison_percentage"), stats.percentage(total("n"), total("reference_n")).alias("average_comparison_percentage"))


def comparison_order() -> list[Column]:
    return [F.when(F.col("query_type") == "reference", 0).otherwise(1), F.desc_nulls_last("average_comparison_percentage"), F.col("abridged_query"), F.col("year")]


def compare_topics(corpus: Corpus, reference: str, terms: str | Iterable[str], years, field: str | None = None) -> DataFrame:
    """How much of the reference literature each topic takes, by year: one scan, whatever the number of topics."""
    topics = comparison_terms(terms)
    wanted = check_years(years)
    if wanted is None:
        raise ValueError("a comparison needs years")
    whole = wrap_field(reference, field)
    queries = [whole] + [f"{whole} AND {wrap_field(t, field)}" for t in topics]
    labels = [reference, *topics]
    spark = corpus.df.sparkSession
    held = corpus.df.filter(F.col("year").isin(*wanted)).filter(corpus.matches(whole))
    tests = [F.lit(True)] + [predicate(wrap_field(t, field), corpus.df) for t in topics]
    # One pass: a row for each topic that a document is in, summed before the shuffle.
    member = F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in enumerate(tests)]), lambda x: x.isNotNull())
    counted = held.select("year", F.explode(member).alias("topic")).groupBy("year", "topic").agg(F.count("*").alias("n"))
    grid = spark.createDataFrame([(k, q, "comparison" if k else "reference", labels[k], y) for k, q in enumerate(queries) for y in wanted], "topic int, query string, query_type string, abridged_query string, year int")
    filled = grid.join(F.broadcast(counted), ["year", "topic"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))  # a row for each topic and year
    reference_n = F.max(F.when(F.col("topic") == 0, F.col("n"))).over(Window.partitionBy("year"))
    told = shares(filled.select("query", "query_type", "abridged_query", "year", "n", reference_n.alias("reference_n")))
    return told.orderBy(*comparison_order())


def intersection_plan(concepts: Mapping[str, str], intersections=None, abbrev: Mapping[str, str] | None = None, sep: str = " × ", field: str | None = None) -> list[tuple[str, str, str, int, str]]:
    """(label, query, type, size, members): concepts first, then intersections of two or more of them."""
    if not concepts or not all(k.strip() and v.strip() for k, v in concepts.items()):
        raise ValueError("concepts must be a mapping of non-empty names to non-empty queries")
    abbrev = abbrev or {}
    if unknown := set(abbrev) - set(concepts):
        raise ValueError(f"abbrev names unknown concepts: {', '.join(sorted(unknown))}")
    wrapped = {k: wrap_concept(v, field) for k, v in concepts.items()}
    rows = [(k, q, "concept", 1, k) for k, q in wrapped.items()]
    groups = list(intersections or [])
    if groups and all(isinstance(g, str) for g in groups):
        groups = [groups]
    for g in groups:
        members = list(dict.fromkeys([g] if isinstance(g, str) else g))
        if len(members) < 2 or any(m not in concepts for m in members):
            raise ValueError("an intersection needs two or more known concepts")
        rows.append((sep.join(abbrev.get(m, m) for m in members), " AND ".join(f"({wrapped[m]})" for m in members), "intersection", len(members), "; ".join(members)))
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("labels must be unique")
    return rows


def intersections(corpus: Corpus, concepts: Mapping[str, str], intersections=None, abbrev: Mapping[str, str] | None = None, sep: str = " × ", years=None, field: str | None = None) -> DataFrame:
    """(label, query, n, type, size, members) for concepts and intersections, counted in one scan; years widen."""
    plan = intersection_plan(concepts, intersections, abbrev, sep, field)
    limits = check_years(years)
    df = corpus.df if limits is None else corpus.df.filter(F.col("year").between(limits[0], limits[-1]))
    suffix = "" if limits is None else f" AND {year_clause(limits[0], limits[-1])}"
    wide = df.agg(*[F.count_if(predicate(q, df)).alias(f"c{k}") for k, (_, q, *_) in enumerate(plan)])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(label).alias("label"), F.lit(q + suffix).alias("query"), F.col(f"c{k}").alias("n"), F.lit(kind).alias("type"), F.lit(size).alias("size"), F.lit(members).alias("members")) for k, (label, q, kind, size, members) in enumerate(plan)])).alias("r")
    return wide.select(rows).select("r.*").orderBy("ord").drop("ord")


def demo_comparison(spark: SparkSession, reference: str, terms: Sequence[str], years: Sequence[int]) -> DataFrame:
    """Made-up counts for a comparison without a corpus: a growing reference, topics with growing shares."""
    wanted = check_years(years)
    first, span = wanted[0], max(1, wanted[-1] - wanted[0])
    topics = spark.createDataFrame([(k - 1, t, "comparison" if k else "reference") for k, t in enumerate([reference, *terms])], "i int, abridged_query string, query_type string")
    grid = topics.crossJoin(F.broadcast(year_grid(spark, wanted)))  # two small lists of the caller
    base = 1000 + 120 * (F.col("year") - first)
    n = F.floor(base * (0.06 + 0.07 * F.col("i") + 0.03 * (F.col("i") + 1) * (F.col("year") - first) / span))
    whole = F.concat(F.lit(f"{reference} AND "), F.col("abridged_query"))
    rows = grid.select(F.when(F.col("i") < 0, F.lit(reference)).otherwise(whole).alias("query"), "query_type", "abridged_query", "year", F.when(F.col("i") < 0, base).otherwise(n).cast("long").alias("n"), base.cast("long").alias("reference_n"))
    return shares(rows).orderBy(*comparison_order())
