"""The search-strategy record: facts from the records and their provenance, rendered three ways.

Nothing is claimed that the record set does not carry; what is unknown is said to be unknown.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litlode.functions.normalize import four_digit_runs
from litlode.operators.records import distinct_expressions
from litlode.plans.plan import SearchPlan
from litlode.schema import Provenance, RecordSet

# The item names of the PRISMA-S checklist.
PRISMA_S_ITEMS = (
    "Database name", "Multi-database searching", "Study registries", "Online resources and browsing", "Citation searching", "Contacts", "Other methods", "Full search strategies",
    "Limits and restrictions", "Search filters", "Prior work", "Updates", "Dates of searches", "Peer review", "Total records", "Deduplication",
)
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
#: Expressions that a report lists at most; it refuses more rather than leave some out.
MOST_EXPRESSIONS = 100_000
STYLES = ("report", "markdown", "paragraph")


def record_facts(records: DataFrame) -> DataFrame:
    """(n_records, n_with_doi, first_year, last_year, n_expressions) of one row."""
    return records.agg(F.count("*").alias("n_records"), F.count("doi").alias("n_with_doi"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_distinct("query").alias("n_expressions"))


def report_facts(records: DataFrame, totals: DataFrame) -> DataFrame:
    """The record facts with the accounting's: cells, cells that reported, reported total (null unless all did)."""
    told = totals.agg(F.count("*").alias("n_cells"), F.count("reported_total").alias("n_cells_reported"), F.sum("reported_total").alias("s"))
    whole = F.when((F.col("n_cells") > 0) & (F.col("n_cells") == F.col("n_cells_reported")), F.col("s"))
    return record_facts(records).crossJoin(F.broadcast(told)).select("n_records", "n_with_doi", "first_year", "last_year", "n_expressions", "n_cells", "n_cells_reported", whole.alias("reported_total"))  # one row by one row


def cell_state(n: Column, reported: Column) -> Column:
    return F.when(n.isNull() | reported.isNull(), "unknown").when(n >= reported, "complete").otherwise("incomplete")


def report_cells(cells: DataFrame, totals: DataFrame) -> DataFrame:
    """Plan cells with their accounting, if both list the same cells; else without any."""
    wanted = [r["cell"] for r in cells.select("cell").orderBy("cell").collect()]  # cells of one plan
    have = [r["cell"] for r in totals.select("cell").orderBy("cell").collect()]
    own = totals if wanted == have else totals.filter(F.lit(False))
    joined = cells.select("cell", "date", "query").join(own.select("cell", "n_records", "reported_total"), "cell", "left")
    return joined.select("cell", "date", "query", "n_records", "reported_total", cell_state(F.col("n_records"), F.col("reported_total")).alias("state"))


def prisma_map(spark: SparkSession, has_expression: bool, has_plan: bool, has_stamp: bool, was_run: bool, has_dedupe: bool) -> DataFrame:
    """(item, name, source): what the record supplies, and what its author has to."""
    supplied = {1: True, 8: has_expression, 9: has_plan, 13: has_stamp, 15: was_run, 16: has_dedupe}
    rows = [(k, name, "record" if supplied.get(k) else "author") for k, name in enumerate(PRISMA_S_ITEMS, 1)]
    return spark.createDataFrame(rows, "item INT, name STRING, source STRING")


def expression_years(records: DataFrame) -> DataFrame:
    """(first, last): the least and greatest four-digit run in the expressions."""
    runs = records.select("query").filter("query is not null").distinct().select(F.explode(four_digit_runs(F.col("query"))).alias("y"))
    return runs.agg(F.min(F.col("y").cast("int")).alias("first"), F.max(F.col("y").cast("int")).alias("last"))


def _plan_code(plan: SearchPlan) -> str:
    """Code that builds an equal plan."""
    return f"SearchPlan({plan.query!r}, years={plan.years!r}, field={plan.field!r}, view={plan.view!r}, partition={plan.partition!r}, page_size={plan.page_size!r})"


@dataclass(frozen=True)
class SearchReport:
    database: str
    plan: SearchPlan | None
    provenance: Provenance
    n_records: int | None
    n_with_doi: int | None
    expressions: tuple[str, ...]
    cells: tuple[tuple[int, str | None, int | None, int | None], ...]
    prisma: tuple[tuple[int, str, str], ...]

    @property
    def n_identified(self) -> int | None:
        return self.provenance.combined.n_in if self.provenance.combined else self.n_records

    @property
    def n_removed(self) -> int | None:
        c = self.provenance.combined
        return c.n_removed if c and c.deduplicated else None

    def pairs(self) -> list[tuple[str, str]]:
        """(label, value), with "not recorded" for what is not known."""
        p, x, unknown = self.plan, self.provenance, "not recorded"
        number = lambda n: unknown if n is None else f"{n:,}"
        years = unknown if p is None else "no limit" if not p.years else str(p.years[0]) if len(p.years) == 1 else f"{p.years[0]} to {p.years[-1]}"
        complete = unknown
        if self.n_records is not None and x.total_results is not None:
            complete = "all reported records retrieved" if sum(c[2] or 0 for c in self.cells) >= x.total_results else "fewer records than reported"
        return [
            ("Database", self.database),
            ("Search expression", "; ".join(self.expressions) or unknown),
            ("Field tag", unknown if p is None else p.field or "none"),
            ("Years", years),
            ("Partition", unknown if p is None else p.partition),
            ("Cells", str(len(self.cells)) if self.cells else unknown),
            ("View", unknown if p is None else p.view),
            ("Page size", unknown if p is None else str(p.page_size)),
            ("Paging", x.paging or unknown),
            ("Date searched", utc_stamp(x.retrieved_at) if x.retrieved_at else unknown),
            ("Software version", x.version or unknown),
            ("Records retrieved", number(self.n_records) if self.n_records is not None else "not run"),
            ("Records reported", number(x.total_results)),
            ("Completeness", complete),
            ("Records with a DOI", unknown if self.n_with_doi is None else f"{self.n_with_doi:,} of {self.n_records:,}"),
            ("Duplicates removed", "no de-duplication recorded" if self.n_removed is None else f"{self.n_removed:,} of {x.combined.n_in:,}"),
        ]

    def cell_lines(self) -> list[str]:
        show = lambda n: "unknown" if n is None else f"{n:,}"
        state = lambda n, t: "unknown" if n is None or t is None else "complete" if n >= t else "incomplete"
        return [f"{k} ({d or 'all years'}): {show(n)} retrieved, {show(t)} reported, {state(n, t)}" for k, d, n, t in self.cells]

    def format(self, style: str = "report") -> str:
        if style not in STYLES:
            raise ValueError(f"style must be one of {', '.join(STYLES)}")
        supplied = [f"{k} {name}" for k, name, s in self.prisma if s == "record"]
        asked = [f"{k} {name}" for k, name, s in self.prisma if s == "author"]
        if style == "paragraph":
            facts = dict(self.pairs())
            when = f" on {long_date(self.provenance.retrieved_at)}" if self.provenance.retrieved_at else ""
            return f"{self.database} was searched{when} with the expression {facts['Search expression']} (years: {facts['Years']}). Records retrieved: {facts['Records retrieved']}; records reported: {facts['Records reported']}; {facts['Completeness']}. Duplicates removed: {facts['Duplicates removed']}."
        mark = style == "markdown"
        lines = ["# Search strategy" if mark else "Search strategy", ""]
        lines += [f"- **{a}**: {b}" if mark else f"{a}: {b}" for a, b in self.pairs()]
        for title, items in (("Cells", self.cell_lines()), ("Identified", [f"records identified: {self.n_identified if self.n_identified is not None else 'unknown'}", f"removed as duplicates: {self.n_removed if self.n_removed is not None else 'unknown'}"]), ("PRISMA-S items in this record", supplied), ("PRISMA-S items left to the author", asked)):
            lines += ["", f"## {title}" if mark else title, ""] + [f"- {i}" if mark else f"  {i}" for i in items]
        if self.plan is not None:
            lines += ["", "## Plan" if mark else "Plan", "", f"```python\nplan = {_plan_code(self.plan)}\n```" if mark else f"  {_plan_code(self.plan)}"]
        return "\n".join(lines)

    def __str__(self) -> str:
        return self.format()


def utc_stamp(stamp: datetime) -> str:
    return f"{stamp.astimezone(UTC):%Y-%m-%d %H:%M:%S} UTC"


def long_date(stamp: datetime) -> str:
    """The day in UTC, in words whatever the locale."""
    day = stamp.astimezone(UTC)
    return f"{day.day} {MONTHS[day.month - 1]} {day.year}"


def listed_expressions(records: DataFrame, n: int) -> tuple[str, ...]:
    """All ``n`` expressions of a record set, in order of first appearance; refused beyond MOST_EXPRESSIONS."""
    if n > MOST_EXPRESSIONS:
        raise ValueError(f"{n:,} expressions are too many to list; records.distinct_expressions has them as a DataFrame")
    return tuple(r["query"] for r in distinct_expressions(records).collect())


def search_report(x: RecordSet | SearchPlan, plan: SearchPlan | None = None, file: str | None = None, database: str = "the corpus") -> SearchReport:
    """The record of a search: of a record set, or of a plan that has not been run. An explicit plan wins."""
    if file is not None and not str(file).strip():
        raise ValueError("file must be a non-empty path")
    if isinstance(x, SearchPlan):
        plan, source, n, dois, expressions = plan or x, Provenance(), None, None, ((plan or x).wrapped_query,)
    elif isinstance(x, RecordSet):
        source, plan = x.provenance, plan or x.provenance.plan
        facts = record_facts(x.df).first()
        n, dois = facts["n_records"], facts["n_with_doi"]
        expressions = (plan.wrapped_query,) if plan else listed_expressions(x.df, facts["n_expressions"])
    else:
        raise ValueError("a report needs a RecordSet or a SearchPlan")
    totals = {t[0]: t for t in source.cell_totals or ()}
    if plan is not None:
        cells = plan.cells()
        same = [c.cell for c in cells] == sorted(totals)
        listed = tuple((c.cell, c.date, *(totals[c.cell][2:] if same else (None, None))) for c in cells)
    else:
        listed = ((1, None, n, source.total_results),) if n is not None else ()
    supplied = {1: True, 8: bool(expressions), 9: plan is not None, 13: source.retrieved_at is not None, 15: n is not None, 16: source.combined is not None and source.combined.deduplicated}
    prisma = tuple((k, name, "record" if supplied.get(k) else "author") for k, name in enumerate(PRISMA_S_ITEMS, 1))
    report = SearchReport(database, plan, source, n, dois, expressions, listed, prisma)
    if file is not None:
        with Path(file).open("w", encoding="utf-8", newline="\n") as f:
            f.write(report.format("markdown") + "\n")
    return report
