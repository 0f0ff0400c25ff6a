"""A corpus that searches run on, in place of a remote search service."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litlode.plans.query_lang import predicate
from litlode.schema import RECORD, require_columns


@dataclass(frozen=True)
class Corpus:
    """Documents with ``year`` and text columns; see query_lang for which tag reads which column."""

    df: DataFrame

    def __post_init__(self) -> None:
        require_columns(self.df, ["year"], "a corpus")

    @classmethod
    def parquet(cls, spark: SparkSession, path: str) -> Corpus:
        """A Parquet corpus; one that is partitioned by year lets year limits prune folders."""
        return cls(spark.read.parquet(path))

    def matches(self, query: str) -> Column:
        return predicate(query, self.df)

    def scan(self, query: str, limits: tuple[int, int] | None = None) -> DataFrame:
        """Documents that match; the year limit reaches the scan as a pushed filter."""
        df = self.df if limits is None else self.df.filter(F.col("year").between(*limits))
        return df.filter(self.matches(query))


def read_records_csv(spark: SparkSession, path: str, line_feeds: bool = False) -> DataFrame:
    """Records from CSV with a header, in the fixed schema, so that ids stay strings.

    Quoted fields may hold commas and doubled quotes; with ``line_feeds`` line feeds too, and then files aren't split.
    """
    return spark.read.csv(path, header=True, schema=RECORD, quote='"', escape='"', mode="FAILFAST", multiLine=line_feeds)


def write_records_csv(records: DataFrame, path: str) -> None:
    """Records as CSV that read_records_csv reads, a folder of part files."""
    records.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


# Records per year, 2015 to 2024, of the example corpus.
_PER_YEAR = (15, 9, 10, 15, 19, 13, 13, 15, 15, 14)


def example_records(spark: SparkSession) -> DataFrame:
    """138 made-up records with the shape of a small harvest: 11 without a DOI, 2 without a source, none with an id."""
    rows = []
    for y, count in enumerate(_PER_YEAR, 2015):
        for _ in range(count):
            k = len(rows) + 1
            source = None if k in (40, 95) else f"Journal of Sample Studies {k % 90}"
            doi = None if k % 12 == 7 and k < 133 else f"10.5555/sample.{k:04d}"
            rows.append((k, None, doi, f"A sample study of topic {k % 17} & its {k % 5} variants", f"Author{k % 60}, A.", y, f"{y}-{1 + k % 12:02d}-15", source, (k * 37) % 211, "TITLE-ABS-KEY(sample)"))
    return spark.createDataFrame(rows, RECORD)
