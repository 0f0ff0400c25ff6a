"""The driver's star-schema tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litlode.schema import RECORD_COLUMNS, REFERENCE_FIELDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer: the grain of a record."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).withColumn("k", F.col("o_orderkey"))


# Columns need a session, so these are functions.
def _date() -> Column:
    return F.date_format("o_orderdate", "yyyy-MM-dd")


def _id() -> Column:
    return F.when(F.col("k") % 5 != 0, (F.lit(85000000000) + F.col("k") % 12000).cast("string"))


def _plain() -> Column:
    return (F.col("k") % 9000).cast("string")


def _doi() -> Column:
    return F.when(F.col("k") % 4 == 0, F.concat(F.lit("https://doi.org/10.5555/ORD-"), _plain())).when(F.col("k") % 4 == 1, F.concat(F.lit("doi:10.5555/ord-"), _plain())).when(F.col("k") % 4 == 2, F.concat(F.lit("10.5555/ord-"), _plain()))


def _title() -> Column:
    return F.concat("o_orderpriority", F.lit(" & "), "c_mktsegment", F.lit(" #"), F.col("k").cast("string"))


def _authors() -> Column:
    return F.when(F.col("k") % 58 != 0, F.concat("c_name", F.lit("; Clerk "), (F.col("k") % 50).cast("string")))


def _source() -> Column:
    return F.when(F.col("k") % 101 != 0, F.col("c_mktsegment"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record set of all orders."""
    year = F.year("o_orderdate")
    rows = order_rows(spark, sf_dir).select(
        (F.col("k") + 1).alias("entry_number"),
        _id().alias("scopus_id"),
        _doi().alias("doi"),
        _title().alias("title"),
        _authors().alias("authors"),
        year.alias("year"),
        _date().alias("date"),
        _source().alias("publication"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("citations"),
        F.concat(F.lit("PUBYEAR IS "), year.cast("string")).alias("query"),
    )
    return rows.select(*RECORD_COLUMNS)


def raw_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw search results of all orders, with what sources leave out or misspell."""
    price = F.floor(F.col("o_totalprice") / 1000).cast("int").cast("string")
    return order_rows(spark, sf_dir).select(
        F.col("k").alias("position"),
        F.concat(F.lit("2-s2.0-"), _id()).alias("eid"),
        _doi().alias("doi"),
        _title().alias("title"),
        F.when(F.col("k") % 7 == 0, "").otherwise(_authors()).alias("author_names"),
        F.col("c_name").alias("creator"),
        F.when(F.col("k") % 13 == 0, "n.d.").when(F.col("k") % 17 != 0, _date()).alias("coverDate"),
        _source().alias("publicationName"),
        F.when(F.col("k") % 11 == 0, "").when(F.col("k") % 19 != 0, price).alias("citedby_count"),
        F.when(F.col("k") % 6 == 0, "").otherwise(F.concat(F.lower("c_mktsegment"), F.lit(" | "), F.lower("o_orderpriority"))).alias("authkeywords"),
    )


def line_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(title, year) of all line items: a corpus for counts; it has no key, so nothing here depends on order."""
    lines, parts = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_name").alias("title"), F.year("l_shipdate").alias("year"))


def text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as (title, abstract, publication, year)."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("entry_number"), F.get(F.split("text", "\n"), F.lit(0)).alias("title"), F.col("text").alias("abstract"), F.col("source").alias("publication"), (F.lit(2000) + F.col("doc_id") % 20).cast("int").alias("year"))


def respelt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """abstract_documents, and every seventh of them again under another id, with its DOI in small letters and another title."""
    whole = abstract_documents(spark, sf_dir)
    again = whole.filter(F.col("k") % 7 == 0)
    return whole.union(again.select(*[F.concat(F.lit("copy-"), F.col("k").cast("string")).alias(c) if c == "scopus_id" else F.lower("doi").alias(c) if c == "doi" else F.concat(F.lit("Copy of "), F.col(c)).alias(c) if c == "title" else F.col(c) for c in whole.columns]))


def abstract_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by order: id, doi, keywords (part types), references (part keys), a reference count that is wrong for some."""
    lines, parts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), table(spark, sf_dir, "part").select("p_partkey", "p_type")
    per = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_type")).alias("keywords"), F.array_sort(F.collect_list("l_partkey")).alias("parts"))  # an order's few lines
    reference = F.transform("parts", lambda p, i: F.struct(*[((i + 1).cast("string") if f == "position" else p.cast("string") if f == "id" else F.lit(None).cast("string")).alias(f) for f in REFERENCE_FIELDS]))
    base = order_rows(spark, sf_dir).select("k", F.concat(F.lit("ord-"), F.col("k").cast("string")).alias("scopus_id"), F.concat(F.lit("10.5555/ORD."), F.col("k").cast("string")).alias("doi"), _title().alias("title"), F.concat(F.lit("About "), _title()).alias("abstract"), _source().alias("publication"), _date().alias("date"), F.year("o_orderdate").alias("year"), F.floor(F.col("o_totalprice") / 1000).cast("int").alias("citations"))
    joined = base.join(per, base["k"] == per["l_orderkey"], "left").drop("l_orderkey")
    return joined.withColumn("references", F.when(F.col("parts").isNotNull(), reference)).withColumn("refcount", (F.coalesce(F.size("parts"), F.lit(0)) + F.when(F.col("k") % 9 == 0, 1).otherwise(0)).cast("string")).drop("parts")
