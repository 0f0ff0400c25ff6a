"""Set operations on records: merge with first-wins de-duplication, DOI lists, snapshot differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litlode.functions.normalize import clean_doi
from litlode.operators.records import number_rows
from litlode.schema import Combined, Provenance, RecordSet, require_columns


def _stacked(sets: tuple) -> DataFrame:
    if len(sets) == 1 and isinstance(sets[0], (list, tuple)):
        sets = tuple(sets[0])
    frames = [s.df if isinstance(s, RecordSet) else s for s in sets]
    if not frames or not all(isinstance(f, DataFrame) for f in frames):
        raise ValueError("record sets must be DataFrames")
    for f in frames:
        require_columns(f, ["entry_number", "scopus_id", "doi"], "a record set")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("__litlode_set", F.lit(k)) for k, f in enumerate(frames)])


def merge_key(df: DataFrame) -> DataFrame:
    """Adds ``_key``: the id, else the lowered DOI, else the row's own place, which matches nothing."""
    own = F.concat_ws(":", F.lit("row"), "__litlode_set", "entry_number")
    return df.withColumn("__litlode_key", F.coalesce(F.concat(F.lit("id:"), "scopus_id"), F.concat(F.lit("doi:"), F.lower("doi")), own))


def combine_frame(*sets, dedupe: bool = False) -> DataFrame:
    """All rows in order of set and entry; with ``dedupe`` the first of each key; numbered anew."""
    rows = _stacked(sets)
    columns = [c for c in rows.columns if c not in ("__litlode_set", "entry_number")]
    if dedupe:
        first = F.row_number().over(Window.partitionBy("__litlode_key").orderBy("__litlode_set", "entry_number"))
        rows = merge_key(rows).withColumn("__litlode_rank", first).filter("__litlode_rank = 1").drop("__litlode_key", "__litlode_rank")
    numbered = number_rows(rows.withColumnRenamed("entry_number", "__litlode_was"), "__litlode_set", "__litlode_was")
    return numbered.select("entry_number", *columns)


def combine_accounting(*sets, dedupe: bool = False) -> DataFrame:
    """(n_in, n_out, n_removed, deduplicated) of one row."""
    keyed = merge_key(_stacked(sets))
    n_out = F.count_distinct("__litlode_key") if dedupe else F.count("*")
    return keyed.agg(F.count("*").alias("n_in"), n_out.alias("n_out")).select("n_in", "n_out", (F.col("n_in") - F.col("n_out")).alias("n_removed"), F.lit(dedupe).alias("deduplicated"))


def combine(*sets, dedupe: bool = False) -> RecordSet:
    """The merged set; of provenance it carries what the merge did and nothing else. Runs one counting job."""
    told = combine_accounting(*sets, dedupe=dedupe).first()
    return RecordSet(combine_frame(*sets, dedupe=dedupe), Provenance(combined=Combined(told["n_in"], told["n_out"], dedupe)))


def extract_dois(records: DataFrame, dedupe: bool = True, order: str = "entry_number") -> DataFrame:
    """(position, doi): cleaned DOIs in order; with ``dedupe`` the first spelling of each, whatever its case."""
    require_columns(records, ["doi", order], "a record set")
    rows = records.select(F.col(order).alias("position"), clean_doi(F.col("doi")).alias("doi")).filter("doi is not null")
    if dedupe:
        rows = rows.withColumn("__litlode_rank", F.row_number().over(Window.partitionBy(F.lower("doi")).orderBy("position"))).filter("__litlode_rank = 1").drop("__litlode_rank")
    return rows


def diff_dois(old: DataFrame, new: DataFrame, order: str = "entry_number") -> DataFrame:
    """(doi, status): added, removed or unchanged, compared without case; the new spelling where both have it."""
    a = extract_dois(old, order=order).select(F.lower("doi").alias("k"), F.col("doi").alias("old_doi"))
    b = extract_dois(new, order=order).select(F.lower("doi").alias("k"), F.col("doi").alias("new_doi"))
    status = F.when(F.col("old_doi").isNull(), "added").when(F.col("new_doi").isNull(), "removed").otherwise("unchanged")
    return a.join(b, "k", "full").select(F.coalesce("new_doi", "old_doi").alias("doi"), status.alias("status")).orderBy("status", "doi")


def diff_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count("*").alias("n")).orderBy("status")
