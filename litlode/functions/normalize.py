"""Normalisation of raw results and of strings, as Column functions (no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What BibTeX needs escaped, character by character.
BIBTEX_ESCAPES = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def strip(x: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def blank_to_null(x: Column) -> Column:
    """Null for null, empty and white space."""
    return F.when(strip(x.cast("string")) != "", x)


def record_id(eid: Column) -> Column:
    """What follows the last prefix of an electronic id."""
    return F.element_at(F.split(eid, r"2-s2\.0-"), -1)


def citation_count(x: Column) -> Column:
    """An integer; null for missing, blank or unreadable, zero stays."""
    return x.try_cast("int")


def year_of(date: Column) -> Column:
    """The first four characters, if all of them are digits."""
    head = F.substring(date.cast("string"), 1, 4)
    return F.when(head.rlike("^[0-9]{1,4}$"), head.try_cast("int"))


def author_names(names: Column, creator: Column) -> Column:
    return F.coalesce(F.nullif(names, F.lit("")), creator)


def clean_doi(doi: Column) -> Column:
    """Without a resolver or label in front; null if nothing is left. Case stays."""
    bare = F.regexp_replace(strip(doi), r"(?i)^(https?://)?(www\.)?(dx\.)?doi\.org/", "")
    bare = F.regexp_replace(bare, r"(?i)^doi:", "")
    return F.nullif(strip(bare), F.lit(""))


def fold_space(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def split_list(x: Column, keep_blank: bool = False) -> Column:
    """Items between semicolons, trimmed; an empty array for null."""
    items = F.transform(F.split(x, ";"), lambda a: strip(a))
    items = items if keep_blank else F.filter(items, lambda a: a != "")
    return F.coalesce(items, F.array().cast("array<string>"))


def year_text(year: Column) -> Column:
    return F.coalesce(year.cast("int").cast("string"), F.lit(""))


def bibtex_escape(x: Column) -> Column:
    """Every character is looked up once, so braces that an escape brings in are not escaped again."""
    table = F.create_map(*[F.lit(s) for pair in BIBTEX_ESCAPES.items() for s in pair])
    return F.array_join(F.transform(F.split(fold_space(x), ""), lambda c: F.coalesce(table[c], c)), "")


def bibtex_key(authors: Column, year: Column, scopus_id: Column) -> Column:
    """First surname in ASCII letters and digits with the year; else the id; else a constant."""
    first = F.get(split_list(authors), F.lit(0))
    surname = F.lower(F.regexp_replace(F.get(F.split(first, "[ ,]"), F.lit(0)), "[^A-Za-z0-9]", ""))
    own = F.nullif(F.regexp_replace(scopus_id, "[^A-Za-z0-9]", ""), F.lit(""))
    return F.coalesce(F.concat(F.nullif(surname, F.lit("")), year_text(year)), F.concat(F.lit("scopus"), own), F.lit("scopusrecord"))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def four_digit_runs(x: Column) -> Column:
    """Runs of digits that are just four long."""
    return F.regexp_extract_all(x, F.lit("(?<![0-9])([0-9]{4})(?![0-9])"), 1)
