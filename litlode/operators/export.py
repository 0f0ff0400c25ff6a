"""BibTeX and RIS, as one string expression for each record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litlode.functions import normalize as N


def bibtex_keys(records: DataFrame) -> DataFrame:
    """Adds ``key``: unique; later uses of a key get a to z, then numbers, in order of entry."""
    base = N.bibtex_key(F.col("authors"), F.col("year"), F.col("scopus_id"))
    use = F.row_number().over(Window.partitionBy("__litlode_base").orderBy("entry_number")) - 1
    suffix = F.when(F.col("__litlode_use") == 0, "").when(F.col("__litlode_use") <= 26, F.char(F.lit(96) + F.col("__litlode_use"))).otherwise(F.col("__litlode_use").cast("string"))
    return records.withColumn("__litlode_base", base).withColumn("__litlode_use", use).withColumn("key", F.concat("__litlode_base", suffix)).drop("__litlode_base", "__litlode_use")


def _entry(keyed: DataFrame) -> Column:
    authors = F.array_join(F.transform(N.split_list(F.col("authors")), N.bibtex_escape), " and ")
    some = lambda c: N.bibtex_escape(N.blank_to_null(F.col(c)))
    fields = {"author": F.nullif(authors, F.lit("")), "title": some("title"), "journal": some("publication"), "year": F.col("year").cast("int").cast("string"), "doi": some("doi"), "note": N.bibtex_escape(F.concat(F.lit("Scopus ID: "), N.blank_to_null(F.col("scopus_id"))))}
    lines = [F.concat(F.lit(f"  {name} = {{"), value, F.lit("},")) for name, value in fields.items()]
    return F.concat(F.lit("@article{"), F.col("key"), F.lit(",\n"), F.concat_ws("\n", *lines), F.lit("\n}"))


def bibtex_entries(records: DataFrame) -> DataFrame:
    """(entry_number, key, entry)."""
    keyed = bibtex_keys(records)
    return keyed.select("entry_number", "key", _entry(keyed).alias("entry"))


def ris_entries(records: DataFrame) -> DataFrame:
    """(entry_number, entry)."""
    line = lambda tag, c: F.concat(F.lit(f"{tag}  - "), N.fold_space(N.blank_to_null(F.col(c))))
    authors = F.nullif(F.array_join(F.transform(N.split_list(F.col("authors")), lambda a: F.concat(F.lit("AU  - "), N.fold_space(a))), "\n"), F.lit(""))
    note = F.concat(F.lit("N1  - Scopus ID: "), N.fold_space(N.blank_to_null(F.col("scopus_id"))))
    year = F.concat(F.lit("PY  - "), F.col("year").cast("int").cast("string"))
    entry = F.concat_ws("\n", F.lit("TY  - JOUR"), line("TI", "title"), authors, year, line("JO", "publication"), line("DO", "doi"), note, F.lit("ER  - "))
    return records.select("entry_number", entry.alias("entry"))


def write_entries(entries: DataFrame, path: str) -> None:
    """Entries in order as text files, a blank line between; part files follow one another."""
    entries.orderBy("entry_number").select(F.concat("entry", F.lit("\n"))).write.mode("overwrite").text(path)


def to_text(entries: DataFrame) -> str:
    """All entries as one string, for sets that fit on the driver."""
    return "\n\n".join(r["entry"] for r in entries.orderBy("entry_number").select("entry").toLocalIterator())
