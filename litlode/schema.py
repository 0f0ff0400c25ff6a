"""Schemas, and a record set together with its provenance."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TYPES = {"BIGINT": T.LongType(), "INT": T.IntegerType(), "STRING": T.StringType(), "DOUBLE": T.DoubleType()}


def _struct(columns: str) -> T.StructType:
    """A schema from "name TYPE, ..."; unlike Spark's parser it needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (c.split() for c in columns.split(","))])


RECORD = _struct("entry_number BIGINT, scopus_id STRING, doi STRING, title STRING, authors STRING, year INT, date STRING, publication STRING, citations INT, query STRING")
RECORD_COLUMNS = RECORD.fieldNames()
TREND = _struct("year INT, n BIGINT")
COMPARISON = _struct("query STRING, query_type STRING, abridged_query STRING, year INT, n BIGINT, reference_n BIGINT, comparison_percentage DOUBLE, average_comparison_percentage DOUBLE")
INTERSECTION = _struct("label STRING, query STRING, n BIGINT, type STRING, size INT, members STRING")
DOI_DIFF = _struct("doi STRING, status STRING")
TALLY = _struct("value STRING, n BIGINT")
CELL_TOTALS = _struct("cell INT, date STRING, n_records BIGINT, reported_total BIGINT")

# The fields of a cited reference, in the source's order.
REFERENCE_FIELDS = ["position", "id", "doi", "title", "authors", "authors_auid", "authors_affiliationid", "sourcetitle", "publicationyear", "coverDate", "volume", "issue", "first", "last", "citedbycount", "type", "text", "fulltext"]
REFERENCE = T.StructType([T.StructField(f, T.StringType()) for f in REFERENCE_FIELDS])
ABSTRACT = _struct("scopus_id STRING, doi STRING, title STRING, abstract STRING, publication STRING, date STRING, year INT, citations INT")


@dataclass(frozen=True)
class Combined:
    """What a merge did."""

    n_in: int
    n_out: int
    deduplicated: bool

    @property
    def n_removed(self) -> int:
        return self.n_in - self.n_out


@dataclass(frozen=True)
class Provenance:
    """How a record set came about. Operators build or drop it; it never rides on column metadata."""

    plan: object | None = None
    cell_totals: tuple[tuple[int, str | None, int, int | None], ...] | None = None
    total_results: int | None = None
    paging: str | None = None
    retrieved_at: datetime | None = None
    version: str | None = None
    combined: Combined | None = None


@dataclass(frozen=True)
class RecordSet:
    df: DataFrame
    provenance: Provenance = field(default_factory=Provenance)


class ForbiddenError(PermissionError):
    """The source refuses a request for lack of entitlement; a batch stops."""


def require_columns(df: DataFrame, columns: list[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {', '.join(missing)}")
