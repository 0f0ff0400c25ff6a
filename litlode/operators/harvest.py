"""Running a plan cell by cell, with checkpoints, accounting and provenance."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litlode import __version__
from litlode.operators.records import number_rows
from litlode.plans.plan import PlanCell, SearchPlan
from litlode.schema import CELL_TOTALS, RECORD, RECORD_COLUMNS, Provenance, RecordSet
from litlode.sources.corpus import Corpus

_MANIFEST = "cell INT, fingerprint STRING, n_records BIGINT, n_reported BIGINT"


def cell_rows(corpus: Corpus, cell: PlanCell) -> DataFrame:
    """Records of the corpus in the cell, with the cell's query."""
    rows = corpus.scan(cell.query, cell.limits)
    missing = [c for c in RECORD_COLUMNS if c not in rows.columns and c != "query"]
    rows = rows.select("*", *[F.lit(None).cast(RECORD[c].dataType).alias(c) for c in missing]).withColumn("query", F.lit(cell.cell_query))
    return rows.select(*RECORD_COLUMNS, *(["authkeywords"] if cell.view == "COMPLETE" and "authkeywords" in rows.columns else []))


class CellStore:
    """A folder with a Parquet folder and a manifest row for each finished cell.

    A cell counts as finished when both are there, readable, with the record columns, and the
    manifest has the fingerprint of the cell's query and view; so a cell of another plan is
    never taken, not even an empty one. Spark commits a folder as a whole.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _folder(self, cell: PlanCell) -> str:
        return f"{self.path}/cell={cell.cell:03d}"

    def read(self, cell: PlanCell) -> DataFrame | None:
        folder = self._folder(cell)
        if not self._exists(f"{folder}/manifest/_SUCCESS") or not self._exists(f"{folder}/rows/_SUCCESS"):
            return None
        try:
            manifest = self.spark.read.schema(_MANIFEST).json(f"{folder}/manifest").first()
            rows = self.spark.read.parquet(f"{folder}/rows")
            readable = manifest is not None and rows.count() == manifest["n_records"]
        except (PySparkException, Py4JError) as e:  # what readers raise for a damaged file: the cell is fetched again
            warnings.warn(f"cell {cell.cell}: its checkpoint cannot be read ({type(e).__name__}); fetched again", stacklevel=2)
            return None
        if not readable or any(c not in rows.columns for c in RECORD_COLUMNS):
            warnings.warn(f"cell {cell.cell}: its checkpoint is damaged; fetched again", stacklevel=2)
            return None
        if manifest["fingerprint"] != cell.fingerprint():
            warnings.warn(f"cell {cell.cell}: its checkpoint is another search's; fetched again", stacklevel=2)
            return None
        return rows

    def write(self, cell: PlanCell, rows: DataFrame, reported: int | None = None) -> DataFrame:
        folder = self._folder(cell)
        rows.write.mode("overwrite").parquet(f"{folder}/rows")
        kept = self.spark.read.parquet(f"{folder}/rows")
        self.spark.createDataFrame([(cell.cell, cell.fingerprint(), kept.count(), reported)], _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
        return kept


def fetch_plan(corpus: Corpus, plan: SearchPlan, cache_dir: str | None = None, resume: bool = True, should_stop: Callable[[], bool] | None = None, reported: Callable[[PlanCell], int | None] | None = None) -> RecordSet:
    """The records of all cells, in order of cell and entry, numbered anew, with how they came about.

    ``reported`` tells a source's own count for a cell and defaults to the corpus' count; fewer
    records than reported warn. ``should_stop`` is asked before each cell; what is there by then
    is returned. A resumed cell has no reported count, and then no date or version is claimed.
    """
    if not isinstance(plan, SearchPlan):
        raise ValueError("plan must be a SearchPlan")
    spark = corpus.df.sparkSession
    store = None if cache_dir is None else CellStore(spark, cache_dir)
    frames, totals, stamps, resumed = [], [], [], False
    for cell in plan.cells():
        if should_stop is not None and should_stop():
            break
        rows = store.read(cell) if store is not None and resume else None
        if rows is not None:
            resumed = True
            totals.append((cell.cell, cell.date, rows.count(), None))
        else:
            rows = cell_rows(corpus, cell)
            stamps.append(datetime.now(UTC))
            if store is not None:
                rows = store.write(cell, rows)
            n = rows.count()
            total = reported(cell) if reported is not None else n
            if total is not None and n < total:
                warnings.warn(f"cell {cell.cell}: {n} of {total} reported records", stacklevel=2)
            totals.append((cell.cell, cell.date, n, total))
        frames.append(rows.withColumn("__litlode_cell", F.lit(cell.cell)).withColumnRenamed("entry_number", "__litlode_was"))
    if frames:
        stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        df = number_rows(stacked, "__litlode_cell", "__litlode_was").drop("__litlode_cell", "__litlode_was")
        df = df.select(*RECORD_COLUMNS, *[c for c in df.columns if c not in RECORD_COLUMNS])
    else:
        df = spark.createDataFrame([], RECORD)
    known = [t[3] for t in totals]
    whole = sum(known) if known and all(t is not None for t in known) else None
    stamp = min(stamps) if stamps and not resumed else None
    return RecordSet(df, Provenance(plan, tuple(totals), whole, "cursor", stamp, __version__ if stamp else None))


def plan_cells(spark: SparkSession, plan: SearchPlan) -> DataFrame:
    """(cell, query, date, year, view, page_size) of a plan."""
    return spark.createDataFrame([(c.cell, c.cell_query, c.date, c.year, c.view, c.page_size) for c in plan.cells()], "cell INT, query STRING, date STRING, year INT, view STRING, page_size INT")


def harvest_frame(corpus: Corpus, plan: SearchPlan) -> DataFrame:
    """A plan without checkpoints as one lazy plan: one scan of the corpus for a plan by year."""
    cells = plan.cells()
    if plan.partition == "year":
        held = corpus.df.filter(F.col("year").isin(*plan.years)).filter(corpus.matches(plan.wrapped_query))
        shown = F.concat(F.lit(f"{plan.wrapped_query} AND PUBYEAR IS "), F.col("year").cast("string"))
        rows = held.withColumn("query", shown).withColumn("__litlode_cell", F.col("year"))
    else:
        rows = cell_rows(corpus, cells[0]).withColumn("__litlode_cell", F.lit(1))
    return number_rows(rows.withColumnRenamed("entry_number", "__litlode_was"), "__litlode_cell", "__litlode_was").select(*RECORD_COLUMNS)


def cell_totals(corpus: Corpus, plan: SearchPlan, unreported: tuple[int, ...] = (), reported: DataFrame | None = None) -> DataFrame:
    """(cell, date, n_records, reported_total) of a plan by year, in one scan; cells in ``unreported`` have no total.

    ``reported`` (year, n) is what the source itself says that it has, such as a trend over it; by
    default it is what was counted here. A cell that got fewer is incomplete. Both are a row for each year of the plan.
    """
    spark = corpus.df.sparkSession
    held = corpus.df.filter(F.col("year").isin(*plan.years)).filter(corpus.matches(plan.wrapped_query)).groupBy("year").agg(F.count("*").alias("n"))
    cells = spark.createDataFrame([(c.cell, c.date, c.year) for c in plan.cells()], "cell INT, date STRING, year INT")
    rows = cells.join(F.broadcast(held), "year", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    if reported is None:
        rows = rows.withColumn("total", F.col("n"))
    else:
        rows = rows.join(F.broadcast(reported.filter(F.col("year").isin(*plan.years)).select("year", F.col("n").cast("long").alias("total"))), "year", "left")
    total = F.when(~F.col("cell").isin(*unreported) if unreported else F.lit(True), F.col("total"))
    return rows.select("cell", "date", F.col("n").alias("n_records"), total.alias("reported_total"))


def total_results(totals: DataFrame) -> DataFrame:
    """(total_results) of one row: the sum, if every cell reported; else null, as for no cells."""
    return totals.agg(F.when((F.count("*") == F.count("reported_total")) & (F.count("*") > 0), F.sum("reported_total")).alias("total_results"))


def totals_frame(spark: SparkSession, provenance: Provenance) -> DataFrame:
    return spark.createDataFrame(list(provenance.cell_totals or ()), CELL_TOTALS)
