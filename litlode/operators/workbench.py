"""Pure helpers behind an interactive front end: code that mirrors choices, progress, request costs, a command line."""

from __future__ import annotations

import argparse
import uuid
from collections.abc import Iterable

from litlode import __version__

#: Requests of a comparison beyond which fewer topics or years are advised.
MANY_REQUESTS = 80
LINE_WIDTH = 88


def years_code(years: Iterable[int] | None) -> str | None:
    """The years as code: a range where no year between the first and the last is missing, else a list."""
    chosen = sorted({*(years or ())})
    if not chosen:
        return None
    stretch = range(chosen[0], chosen[-1] + 1)
    return repr(stretch if len(stretch) == len(chosen) > 1 else chosen)


def call_code(name: str, arguments: list[str]) -> str:
    """A call, wrapped argument by argument where it would pass the line width."""
    flat = f"{name}({', '.join(arguments)})"
    return flat if len(flat) <= LINE_WIDTH else "\n".join([f"{name}(", *(f"    {a}," for a in arguments), ")"])


def mirror_code(query: str, years=None, field: str | None = None, view: str = "STANDARD", partition: str = "year", by: str = "source", compare_terms: Iterable[str] | None = None, demo: bool = False) -> str:
    """A script that does what the choices do, over a corpus at CORPUS."""
    q, span = (query or "").strip() or "your query", years_code(years)
    arguments = [repr(q)] + [f"{k}={v}" for k, v in (("years", span), ("field", field and repr(field)), ("view", repr(view) if view != "STANDARD" else None), ("partition", repr("year") if partition == "year" and span else None)) if v]
    lines = [f"# litlode {__version__}"]
    if demo:
        lines.append("# Demo: what was shown is the example corpus; this script runs on a corpus of yours.")
    lines += [
        "from litlode.operators import counts, export, harvest, records, report",
        "from litlode.plans.plan import SearchPlan",
        "from litlode.sources.corpus import Corpus, write_records_csv",
        "",
        "corpus = Corpus.parquet(spark, CORPUS)",
        "plan = " + call_code("SearchPlan", arguments),
        'found = harvest.fetch_plan(corpus, plan, cache_dir="harvest")',
        f"records.top(found.df, by={by!r}).show()",
        "records.year_counts(found.df).show()",
        'write_records_csv(found.df, "records")',
        'export.write_entries(export.bibtex_entries(found.df), "records-bib")',
        'report.search_report(found, file="search-record.md")',
    ]
    terms = [t.strip() for t in compare_terms or () if t and t.strip()]
    if terms and span:
        lines += ["", call_code("counts.compare_topics", ["corpus", repr(q), repr(terms), span] + ([f"field={field!r}"] if field else [])) + ".show()"]
    return "\n".join(lines)


def parse_progress(log: str) -> tuple[int, int] | None:
    """(cells done, cells) by the last line that starts "Cell k/N:"; None without one, or where k passes N."""
    for line in reversed(log.splitlines()):
        mark, colon, _ = line.partition(":")
        done, slash, cells = mark.removeprefix("Cell ").partition("/")
        if mark.startswith("Cell ") and colon and slash and done.isdecimal() and cells.isdecimal():
            return (int(done), int(cells)) if int(done) <= int(cells) else None
    return None


def request_cost(n_terms: int, n_years: int) -> tuple[int, bool]:
    """Requests that a comparison would take at a remote service, and whether that is many; here it is one scan."""
    cost = (n_terms + 1) * n_years
    return cost, cost > MANY_REQUESTS


def session_folder(root: str) -> str:
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def main(argv: list[str] | None = None) -> int:
    """litlode [--version] [--years A-B] [--field TAG] QUERY: print the script for a search."""
    parser = argparse.ArgumentParser(prog="litlode")
    parser.add_argument("--version", action="version", version=__version__)
    parser.add_argument("--years")
    parser.add_argument("--field")
    parser.add_argument("query", nargs="?", default="")
    args = parser.parse_args(argv)
    years = None
    if args.years:
        low, _, high = args.years.partition("-")
        years = range(int(low), int(high or low) + 1)
    print(mirror_code(args.query, years, args.field))
    return 0
