"""Raw results to records, tallies and year counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litlode.functions import normalize as N
from litlode.schema import RECORD_COLUMNS, require_columns

ALL_ROWS = 2**31 - 1


#: Keys of a bucket that is numbered on its own.
BUCKET_KEYS = 100_000


def number_rows(df: DataFrame, *order: str, name: str = "entry_number") -> DataFrame:
    """Dense numbers 1..N by ``order``, without gathering all rows in one partition.

    The last column of ``order`` is a whole number that is about dense, such as an entry number;
    those before it take few values, such as the number of a set. Rows are dealt once, by
    buckets of BUCKET_KEYS keys; they are numbered within their buckets, and the counts of the
    buckets before are added, a row for each bucket. Both the rows and the counts read that one
    exchange: the counts touch every column, so that both sides ask for the same rows and Spark
    computes ``df`` once. Rows equal in the whole key are numbered in any order among themselves.
    """
    *first, key = order
    by = [*first, "__litlode_bucket"]
    dealt = df.withColumn("__litlode_bucket", F.floor(F.col(key) / BUCKET_KEYS)).repartition(*by)
    every = F.xxhash64(*[F.col(f"`{c}`") for c in dealt.columns])
    sizes = dealt.groupBy(*by).agg(F.count("*").alias("__litlode_n"), F.max(every).alias("__litlode_seen")).filter("__litlode_seen is not null")
    earlier = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    keys = [f"__litlode_c{k}" for k in range(len(by))]
    counts = sizes.select(*[F.col(c).alias(k) for k, c in zip(keys, by, strict=True)], F.coalesce(F.sum("__litlode_n").over(earlier), F.lit(0)).alias("__litlode_before"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for k, c in zip(keys, by, strict=True)])
    numbered = dealt.withColumn("__litlode_in", F.row_number().over(Window.partitionBy(*by).orderBy(key))).join(counts, same)
    number = (F.col("__litlode_in") + F.col("__litlode_before")).cast("long")
    return numbered.withColumn(name, number).drop("__litlode_bucket", "__litlode_in", "__litlode_before", *keys)


def to_records(raw: DataFrame, query: str | None = None, view: str | None = None, order: str = "position") -> DataFrame:
    """Raw search results (``order`` tells their sequence) as records; COMPLETE adds authkeywords.

    A raw column that is missing counts as null.
    """
    col = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    columns = [
        N.record_id(col("eid")).alias("scopus_id"),
        col("doi").alias("doi"),
        col("title").alias("title"),
        N.author_names(col("author_names"), col("creator")).alias("authors"),
        N.year_of(col("coverDate")).alias("year"),
        col("coverDate").alias("date"),
        col("publicationName").alias("publication"),
        N.citation_count(col("citedby_count")).alias("citations"),
        F.lit(query).cast("string").alias("query"),
    ]
    if view == "COMPLETE":
        columns.append(F.nullif(col("authkeywords"), F.lit("")).alias("authkeywords"))
    numbered = number_rows(raw.select(F.col(order).alias("__litlode_order"), *columns), "__litlode_order").drop("__litlode_order")
    return numbered.select(*RECORD_COLUMNS, *(["authkeywords"] if view == "COMPLETE" else []))


def top(records: DataFrame, by: str = "source", n: int = 10) -> DataFrame:
    """(value, n): the most frequent sources or authors; ties by value. From 2^31 - 1 on, n means all."""
    if by not in ("source", "author"):
        raise ValueError("by must be source or author")
    if isinstance(n, bool) or n < 0:
        raise ValueError("n must not be negative")
    if by == "source":
        values = records.select(F.col("publication").alias("value")).filter("value is not null")
    else:
        values = records.select(F.explode(N.split_list(F.col("authors"))).alias("value"))
    tally = values.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return tally if n >= ALL_ROWS else tally.limit(n)


def year_counts(records: DataFrame) -> DataFrame:
    """(year, n) of the years present; unreadable years are left out, fractions cut off."""
    year = F.col("year").cast("string").try_cast("double").try_cast("int")
    return records.select(year.alias("year")).filter("year is not null").groupBy("year").agg(F.count("*").alias("n")).orderBy("year")


def top_cited(records: DataFrame, k: int) -> DataFrame:
    return records.filter("citations is not null").orderBy(F.desc("citations"), "entry_number").limit(k)


def distinct_expressions(records: DataFrame) -> DataFrame:
    """(query, first_entry): each expression, in order of first appearance."""
    return records.filter("query is not null").groupBy("query").agg(F.min("entry_number").alias("first_entry")).orderBy("first_entry")


def replay(records: DataFrame, year: int, n: int | None = None) -> DataFrame:
    """Records of one year, up to ``n``, numbered anew; never padded."""
    require_columns(records, ["entry_number", "year"], "a record set")
    rows = records.filter(F.col("year") == year)
    rows = rows if n is None else rows.orderBy("entry_number").limit(n)
    return number_rows(rows.withColumnRenamed("entry_number", "__litlode_was"), "__litlode_was").drop("__litlode_was").select(*records.columns)
