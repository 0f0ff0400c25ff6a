"""Nested enrichment: documents by id, keyword arrays, reference lists, keyword pairs."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litlode.functions import normalize as N
from litlode.operators.records import number_rows
from litlode.schema import REFERENCE, ForbiddenError, require_columns

_NO_REFERENCES = f"array<{REFERENCE.simpleString()}>"
_KEY, _FOUND, _ID = "__litlode_key", "__litlode_found", "__litlode_id"
#: What a document's row shows, besides keywords and references.
SHOWN = ("scopus_id", "doi", "title", "abstract", "publication", "date", "year", "citations")


def _key(c: Column, by: str) -> Column:
    """What ids are compared by: DOIs cleaned and without case, others as they are."""
    return F.lower(N.clean_doi(c)) if by == "doi" else c


def _checked(by: str, include: tuple[str, ...]) -> None:
    if by not in ("doi", "scopus_id"):
        raise ValueError("by must be doi or scopus_id")
    if set(include) - {"keywords", "references"}:
        raise ValueError("include takes keywords and references")


def documents_by_key(documents: DataFrame, by: str = "doi", include: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key among ``documents``: of those that share a key the least by (scopus_id, doi, title, abstract), nulls last."""
    _checked(by, include)
    require_columns(documents, [by], "the documents")
    have = lambda c: F.col(c) if c in documents.columns else F.lit(None).cast("string")
    columns = [have(c).alias(c) for c in SHOWN if c != by]
    if "keywords" in include:
        keywords = have("keywords") if dict(documents.dtypes).get("keywords", "").startswith("array") else N.split_list(have("authkeywords"))
        columns.append(F.nullif(F.array_join(keywords, "; "), F.lit("")).alias("authkeywords"))
    if "references" in include:
        references = F.coalesce(have("references") if "references" in documents.columns else F.lit(None).cast(_NO_REFERENCES), F.array().cast(_NO_REFERENCES))
        columns += [references.alias("references"), (F.size(references) != have("refcount").try_cast("int")).alias("refcount_mismatch")]
    rows = documents.select(_key(F.col(by), by).alias(_KEY), F.col(by).alias(_FOUND), *columns).filter(F.col(_KEY).isNotNull())
    order = [F.asc_nulls_last(_FOUND if c == by else c) for c in ("scopus_id", "doi", "title", "abstract")]
    return rows.withColumn("__litlode_rank", F.row_number().over(Window.partitionBy(_KEY).orderBy(*order))).filter("__litlode_rank = 1").drop("__litlode_rank")


def _answers(ids: DataFrame, known: DataFrame, by: str, id_col: str, order: str) -> DataFrame:
    """A row for each of ``ids``, from ``known``, which has a row for each key."""
    asked = ids.select(F.col(order).alias("position"), F.col(id_col).alias(_ID)).withColumn(_KEY, _key(F.col(_ID), by))
    joined = asked.join(known, _KEY, "left")
    shown = [F.coalesce(_FOUND, _ID).alias(c) if c == by else F.col(c) for c in SHOWN]
    if "references" in known.columns:
        joined = joined.withColumn("references", F.coalesce("references", F.array().cast(_NO_REFERENCES)))
    return joined.select("position", *shown, *[c for c in ("authkeywords", "references", "refcount_mismatch") if c in known.columns])


def lookup_abstracts(ids: DataFrame, documents: DataFrame, by: str = "doi", include: tuple[str, ...] = (), id_col: str = "id", order: str = "position") -> DataFrame:
    """One row for each row of ``ids`` (position, id), repeats too; an id without a document has nulls but its own key.

    ``documents`` are looked up by their ``by`` column (doi or scopus_id), DOIs without case; of
    documents that share a key the first counts (see documents_by_key). The choice and the join
    share one exchange.
    """
    return _answers(ids, documents_by_key(documents, by, include), by, id_col, order)


@dataclass(frozen=True)
class Abstracts:
    """Looked-up rows with what it took: keys asked of the source, taken from the cache, and found by neither."""

    df: DataFrame
    n_requests: int
    n_cached: int
    n_missing: int


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows that earlier runs kept; None if there are none, or they can't be read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    try:
        return spark.read.parquet(path).dropDuplicates([_KEY])
    except (PySparkException, Py4JError) as e:  # what readers raise for a damaged folder: its keys are asked for again
        warnings.warn(f"the abstracts kept under {path} can't be read ({type(e).__name__}); asked for again", stacklevel=3)
        return None


def retrieve_abstracts(ids: DataFrame, source: DataFrame | Callable[[DataFrame], DataFrame], by: str = "doi", include: tuple[str, ...] = (), cache_dir: str | None = None, resume: bool = True, id_col: str = "id", order: str = "position") -> Abstracts:
    """As lookup_abstracts, against a source that costs something, and resumable.

    ``source`` is the documents, or is called with a frame of the keys wanted (column key) and
    returns documents. With ``cache_dir`` what it returns is appended to a folder there, one for each ``by`` and
    ``include``, as both change what a row holds; a later run asks only for keys that the folder lacks. A key
    that the source hasn't got is not kept, so it is asked for again. A source that raises PermissionError
    refuses for good: ForbiddenError says how many keys are left, and nothing more is asked.
    """
    _checked(by, include)
    spark = ids.sparkSession
    keys = ids.select(_key(F.col(id_col), by).alias(_KEY)).filter(F.col(_KEY).isNotNull()).distinct()
    folder = None if cache_dir is None else f"{cache_dir.rstrip('/')}/{'-'.join([by, *sorted(include)])}"
    old = _stored(spark, folder) if folder and resume else None
    wanted = keys if old is None else keys.join(old.select(_KEY), _KEY, "left_anti")
    n, n_wanted = keys.count(), wanted.count()
    try:
        documents = source(wanted.select(F.col(_KEY).alias("key"))) if callable(source) else source
    except PermissionError as e:
        raise ForbiddenError(f"the source refuses; {n_wanted} keys are left and would meet the same refusal: {e}") from e
    fresh = documents_by_key(documents, by, include).join(wanted, _KEY, "left_semi")
    if folder is not None:
        if n_wanted:
            fresh.write.mode("append" if resume else "overwrite").parquet(folder)
        known = spark.read.parquet(folder).dropDuplicates([_KEY]) if n_wanted or old is None else old
    else:
        known = fresh
    n_known = keys.join(known.select(_KEY), _KEY, "left_semi").count()
    return Abstracts(_answers(ids, known, by, id_col, order), n_wanted, n - n_wanted, n - n_known)


def corpus_table(records: DataFrame, abstracts: DataFrame, by: str = "doi") -> DataFrame:
    """(position, id, title, year, keywords, references): records with an id, with what ``abstracts`` has at their position.

    id, title and year come from the records; keywords and references from the abstracts.
    """
    require_columns(records, [by, "title", "year", "entry_number"], "a record set")
    known = number_rows(records.filter(F.col(by).isNotNull()).select(F.col("entry_number").alias("__litlode_e"), F.col(by).alias("id"), "title", "year"), "__litlode_e", name="position").drop("__litlode_e")
    nested = abstracts.select("position", N.split_list(F.col("authkeywords"), keep_blank=True).alias("keywords"), "references")
    return known.join(nested, "position", "left").select("position", "id", "title", "year", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), F.coalesce("references", F.array().cast(_NO_REFERENCES)).alias("references"))


def dropped_ids(records: DataFrame, by: str = "doi") -> DataFrame:
    """(n_kept, n_dropped): how many records have no id to enrich by."""
    return records.agg(F.count(by).alias("n_kept"), F.count_if(F.col(by).isNull()).alias("n_dropped"))


def usable_ids(records: DataFrame, by: str = "doi") -> DataFrame:
    """The records with an id; warns of those without, and refuses a set that has none. Runs one counting job."""
    told = dropped_ids(records, by).first()
    if not told["n_kept"]:
        raise ValueError(f"no record has a {by} to look up")
    if told["n_dropped"]:
        warnings.warn(f"{told['n_dropped']} records without a {by} are left out", stacklevel=2)
    return records.filter(F.col(by).isNotNull())


def keyword_pairs(documents: DataFrame, id_col: str = "id", keywords_col: str = "keywords") -> DataFrame:
    """(first, second, n): unordered pairs of a document's keywords over all documents.

    A document's keywords are bounded by what its authors list; pairs are summed before the shuffle.
    """
    words = documents.select(F.col(id_col), F.array_sort(F.filter(keywords_col, lambda k: k.isNotNull() & (F.trim(k) != ""))).alias("w"))
    firsts = words.select(id_col, "w", F.posexplode("w").alias("p", "first"))
    pairs = firsts.select("first", F.explode(F.slice("w", F.col("p") + 2, F.greatest(F.lit(0), F.size("w")))).alias("second"))
    return pairs.groupBy("first", "second").agg(F.count("*").alias("n"))
