"""Secret scans with an incremental ledger of content-addressed blobs; DataFrame operations only.

A text is addressed by its SHA-256, so a version that stands under many paths, or comes back
later, is one blob. The ledger has, per blob, the rule versions that it was scanned with and
the spans found. A scan first joins addresses alone with the ledger; only texts with a pair of
blob and rule version that the ledger lacks are moved and read by the rules. Findings are joined back to every path by the
address. Copies are reduced before the shuffle, and a hot address is split by Spark's skew
join, as the findings are materialised. A history that arrives in parts is scanned part by
part, each against the ledger of all before.

Positions come from the text between matches: split() and regexp_extract_all() with one
pattern cut a text at the same places, so a match starts where the lengths before it add up.
They are running sums over a row for each match, so work grows in line with text and matches;
spans are told in code points, and in bytes, by which redaction cuts texts.

Inputs: a null text counts as empty; an empty one has no spans. Texts are taken whole. Rows
that repeat, or have a null doc_id, get a result each; ties of start go by the order of the
rules. An empty table gives an empty result. Further columns are not read, and stay as they
are where texts are redacted.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litlode.llm.common import BROADCAST_ROWS, cut, small_side


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``; those whose ``group`` has fewer than ``least`` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The kinds as asked for. A run of hex digits, or of capitals and digits after
# AKIA, that is long enough starts where any such run starts, so its length is in the pattern;
# for assignments a match that is too short still takes its place, so there it isn't.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: The method's own: headers of private keys, tokens with a vendor's prefix, signed web tokens.
VENDOR = Rule("vendor", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----|gh[pousr]_[A-Za-z0-9]{36,}|xox[abpr]-[A-Za-z0-9-]{20,}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")
RULES = (*BASE, VENDOR)

#: start and end in code points, at and to in bytes; ends are exclusive.
SPAN = "struct<start: int, rule: int, kind: string, end: int, at: int, to: int>"


def _matches(text: Column, matches: Column, groups: Column, rule: Rule, order: int) -> Column:
    """For each match its rule and place, and the characters and bytes of the text before it, of itself, and of its group."""
    between = F.slice(F.split(text, rule.pattern, -1), 1, F.size(matches))
    sizes = lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m"), F.octet_length(b).alias("bw"), F.octet_length(m).alias("mw"))
    both = F.zip_with(F.zip_with(between, matches, sizes), groups, lambda x, g: F.struct(x.alias("x"), F.length(g).alias("g")))
    told = F.transform(both, lambda x, i: F.struct(F.lit(order).alias("rule"), i.alias("pos"), x["x"]["b"].alias("b"), x["x"]["m"].alias("m"), x["x"]["bw"].alias("bw"), x["x"]["mw"].alias("mw"), x["g"].alias("g")))
    return F.when(F.size(matches) > 0, told).otherwise(F.array().cast("array<struct<rule: int, pos: int, b: int, m: int, bw: int, mw: int, g: int>>"))


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def unseen(docs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame | None:
    """(blob, todo_0, todo_1 ...) of the blobs of ``docs`` with a rule version that ``ledger`` lacks; None if there is no ledger.

    Only addresses are shuffled. The result is materialised.
    """
    if ledger is None:
        return None
    seen = ledger.groupBy("blob").agg(*[F.max(F.array_contains("rules", r.name)).alias(f"seen_{k}") for k, r in enumerate(rules)])
    blobs = docs.select(address(F.col(text_col)).alias("blob")).distinct().join(seen, "blob", "left")
    todo = [~F.coalesce(F.col(f"seen_{k}"), F.lit(False)) for k in range(len(rules))]
    return cut(blobs.filter(reduce(lambda a, b: a | b, todo)).select("blob", *[t.alias(f"todo_{k}") for k, t in enumerate(todo)]))


def scan_blobs(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """New ledger rows (blob, rules, spans): each blob of ``docs`` with the rule versions not yet in ``ledger``.

    Few unseen blobs are picked out of ``docs`` in place, and only their texts are shuffled, one
    copy from each task; many are joined after the copies are reduced.
    """
    named = docs.select(address(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    todo = unseen(docs, ledger, rules, text_col)
    if todo is None:
        blobs = named.groupBy("blob").agg(F.first("text").alias("text")).select("*", *[F.lit(True).alias(f"todo_{k}") for k in range(len(rules))])
    else:
        side = small_side(todo)
        some = named.join(F.broadcast(todo.select("blob")), "blob", "left_semi") if side is not todo else named
        blobs = some.groupBy("blob").agg(F.first("text").alias("text")).join(side, "blob")
    found = blobs.select("*", *[F.when(F.col(f"todo_{k}"), F.regexp_extract_all("text", F.lit(r.pattern), 0)).otherwise(F.array().cast("array<string>")).alias(f"match_{k}") for k, r in enumerate(rules)])
    matches = []
    for k, r in enumerate(rules):
        match = F.col(f"match_{k}")
        groups = F.when(F.size(match) > 0, F.regexp_extract_all("text", F.lit(r.pattern), r.group)).otherwise(match) if r.group else match
        matches.append(_matches(F.col("text"), match, groups, r, k))
    done = F.filter(F.array(*[F.when(F.col(f"todo_{k}"), F.lit(r.name)) for k, r in enumerate(rules)]), lambda x: x.isNotNull())
    rows = found.select("blob", done.alias("rules"), F.explode_outer(F.concat(*matches)).alias("x")).select("blob", "rules", "x.*")
    inside = Window.partitionBy("blob", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("b") + F.col("m")).over(inside)).withColumn("to", F.sum(F.col("bw") + F.col("mw")).over(inside))
    kind = reduce(lambda c, k: c.when(F.col("rule") == k, rules[k].kind), range(1, len(rules)), F.when(F.col("rule") == 0, rules[0].kind))
    long = reduce(lambda a, b: a | b, [(F.col("rule") == k) & (F.col("g") >= r.least) for k, r in enumerate(rules)])
    span = F.struct((F.col("end") - F.col("m")).alias("start"), "rule", kind.alias("kind"), "end", (F.col("to") - F.col("mw")).alias("at"), "to").cast(SPAN)
    return placed.groupBy("blob", "rules").agg(F.collect_list(F.when(long, span)).alias("spans")).select("blob", "rules", F.array_sort("spans").alias("spans"))  # of one text


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of the blobs that have any by the rules' versions; a blob may have rows of several scans."""

    def current(s: Column) -> Column:
        fits = F.lit(False)
        for r in rules:
            fits = fits | ((s["kind"] == r.kind) & F.array_contains("rules", r.name))
        return fits

    now = ledger.select("blob", F.filter("spans", current).alias("spans")).filter(F.size("spans") > 0)
    whole = now.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    # array_distinct compares each two structs; equal ones are neighbours here.
    return whole.select("blob", F.filter("spans", lambda s, i: (i == 0) | (s != F.get(F.col("spans"), i - 1))).alias("spans"))


def scan_history(arrivals: list[DataFrame], ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, blob, spans) for every row of ``arrivals``, scanned one after the other; spans is null where nothing was found.

    Each arrival is scanned against the ledger as the ones before have left it, so a blob that
    comes again is not scanned again. With ``ledger_path`` the ledger is kept there as Parquet, for later
    runs too.
    """
    spark = arrivals[0].sparkSession
    ledger = None
    if ledger_path is not None:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            ledger = spark.read.parquet(ledger_path)
    for docs in arrivals:
        fresh = cut(scan_blobs(docs, ledger, rules, text_col))
        if ledger_path is not None:
            fresh.write.mode("append").parquet(ledger_path)
        ledger = fresh if ledger is None else ledger.unionByName(fresh)
    current = ledger.filter(F.arrays_overlap("rules", F.array(*[F.lit(r.name) for r in rules])))
    result = cut(findings(current, rules))
    paths = reduce(DataFrame.union, [d.select(F.col(id_col).alias("doc_id"), address(F.col(text_col)).alias("blob")) for d in arrivals])
    return paths.join(result, "blob", "left").select("doc_id", "blob", "spans")


def scan_paths(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """scan_history of a single arrival."""
    return scan_history([docs], ledger_path, rules, id_col, text_col)


def halves(docs: DataFrame, id_col: str = "doc_id") -> list[DataFrame]:
    """``docs`` as two arrivals, by the sign of a hash of the id; together they are all rows."""
    early = F.xxhash64(id_col) >= 0
    return [docs.filter(early), docs.filter(~early)]


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    The rows arrive in two halves: the second is scanned for blobs that the first hasn't put into the ledger.
    """
    spans = F.coalesce("spans", F.array().cast(f"array<{SPAN}>"))
    base = [r.kind for r in BASE]

    def of(kinds: list[str]) -> Column:
        return F.filter(spans, lambda s: s["kind"].isin(kinds))

    counts = [F.size(of([k])).cast("long").alias(f"n_{k}") for k in base]
    own = of(base)
    return scan_history(halves(docs)).select("doc_id", *counts, F.sha2(_listed(own).cast("binary"), 256).alias("base_sha256"), _listed(spans).alias("spans"))


def _cuts(result: DataFrame) -> DataFrame:
    """(blob, cuts, last) from (blob, spans): overlapping spans as one, in order, each with the byte that the one before ends at."""
    rows = result.select("blob", F.explode("spans").alias("s")).select("blob", "s.at", "s.to", "s.rule", "s.kind")
    inside = Window.partitionBy("blob").orderBy("at", "rule")
    reached = F.max("to").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    number = F.sum(F.when(F.col("reached").isNull() | (F.col("at") >= F.col("reached")), 1).otherwise(0)).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    merged = rows.withColumn("reached", reached).withColumn("number", number).groupBy("blob", "number").agg(F.min("at").alias("at"), F.max("to").alias("to"), F.min_by("kind", F.struct("at", "rule")).alias("kind"))
    begun = F.coalesce(F.lag("to").over(Window.partitionBy("blob").orderBy("number")), F.lit(0))
    return merged.withColumn("begun", begun).groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("at", "to", "kind", "begun"))).alias("cuts"), F.max("to").alias("last"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span found replaced by its kind in angle brackets, and the length told anew.

    What to cut is broadcast only if blobs and cuts are few, counted first; else texts are shuffled to it.
    """
    cuts = cut(_cuts(findings(cut(scan_blobs(docs, None, rules, text_col)), rules)))
    told = cuts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("cuts")), F.lit(0)).alias("cuts")).first()
    side = cuts.select(F.col("blob").alias("__litlode_blob"), F.col("cuts").alias("__litlode_cuts"), F.col("last").alias("__litlode_last"))
    side = F.broadcast(side) if max(told["n"], told["cuts"]) <= BROADCAST_ROWS else side
    joined = docs.withColumn("__litlode_blob", address(F.col(text_col))).join(side, "__litlode_blob", "left")
    text = F.col(text_col)

    def pieces(whole: Column) -> Column:
        before = lambda c: F.substring(whole, c["begun"] + 1, c["at"] - c["begun"]).cast("string")
        marked = F.transform("__litlode_cuts", lambda c: F.concat(before(c), F.lit("<"), F.upper(c["kind"]), F.lit(">")))
        return F.concat(F.array_join(marked, ""), F.substring(whole, F.col("__litlode_last") + 1, F.length(whole)).cast("string"))

    clean = F.get(F.transform(F.array(text.cast("binary")), pieces), F.lit(0))  # a lambda's variable, as a column's bytes would be copied for each cut
    found = F.col("__litlode_last").isNotNull()
    done = joined.withColumn("__litlode_clean", F.when(found, clean).otherwise(text))
    columns = {text_col: F.col("__litlode_clean")}
    if chars_col in docs.columns:
        columns[chars_col] = F.when(found, F.length("__litlode_clean").cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars_col))
    return done.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns])
