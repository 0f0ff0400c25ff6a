"""What charts show, computed as DataFrames; drawing is left to whoever has a plotting library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litlode.functions import normalize as N
from litlode.functions import stats
from litlode.schema import require_columns


def comparison_points(comparison: DataFrame) -> DataFrame:
    """Comparison rows with a share, with Wilson's band, the topic's label and rank, and the axis cap."""
    require_columns(comparison, ["query_type", "abridged_query", "year", "n", "reference_n", "comparison_percentage", "average_comparison_percentage"], "a comparison")
    rows = comparison.filter("query_type = 'comparison' and comparison_percentage is not null")
    lower, upper = stats.wilson(F.col("n"), F.col("reference_n"))
    topic = Window.partitionBy("abridged_query")
    rows = rows.withColumn("lower", lower).withColumn("upper", upper).withColumn("total", F.sum("n").over(topic)).withColumn("is_last", F.col("year") == F.max("year").over(topic))
    label = F.format_string("%s (n = %s)", F.col("abridged_query"), N.thousands(F.col("total")))
    order = rows.groupBy("abridged_query").agg(F.max("average_comparison_percentage").alias("a"))  # a row for each topic of a chart
    ranked = order.select("abridged_query", F.row_number().over(Window.orderBy(F.desc("a"), "abridged_query")).alias("rank"))
    cap = rows.agg(stats.axis_cap(F.max(F.greatest("comparison_percentage", "upper"))).alias("y_max"))
    joined = rows.join(F.broadcast(ranked), "abridged_query").crossJoin(F.broadcast(cap))  # by one row
    return joined.select("abridged_query", "year", "n", "reference_n", "comparison_percentage", "lower", "upper", label.alias("label"), "rank", "is_last", "y_max")


def wilson_band(comparison: DataFrame) -> DataFrame:
    lower, upper = stats.wilson(F.col("n"), F.col("reference_n"))
    return comparison.filter("reference_n > 0").select("abridged_query", "year", lower.alias("lower"), upper.alias("upper"))


def intersection_points(table: DataFrame, highlight: str | None = None) -> DataFrame:
    """Rows with a positive count in ascending order, with the ends of a log axis and the gap to a label."""
    n = F.col("n").cast("string").try_cast("double")
    rows = table.withColumn("n", n).filter("n > 0")
    span = rows.agg((F.greatest(F.lit(1.0), F.min("n")) * 0.55).alias("x_min"), (F.max("n") * 4).alias("x_max"))
    group = F.col("type") if highlight is None else F.when(F.col("label") == highlight, "highlight").otherwise("other")
    joined = rows.crossJoin(F.broadcast(span))  # by one row
    gap = F.pow(F.lit(10.0), 0.024 * F.log10(F.col("x_max") / F.col("x_min")))
    return joined.select("label", "n", group.alias("grouping"), F.row_number().over(Window.orderBy("n", "label")).alias("rank"), "x_min", "x_max", gap.alias("gap_factor"))


#: Least share of the axis between two labels at line ends, and the labels that lines take at most.
LABEL_GAP, MOST_LABELS = 0.055, 8


def labels_fit(n_topics: int) -> bool:
    """Whether lines are labelled at their ends; otherwise a legend names them."""
    return n_topics <= MOST_LABELS and (n_topics - 1) * LABEL_GAP <= 1


def label_room(tally: DataFrame) -> DataFrame:
    """(margin) of one row: the share of a bar chart's axis to leave for the widest count; refused for an empty tally."""
    widest = tally.agg(F.max(F.length(N.thousands(F.col("n")))).alias("w"))
    return widest.select(F.when(F.col("w").isNull(), F.raise_error("a tally without rows has no chart")).otherwise(0.04 + 0.024 * F.col("w")).alias("margin"))


def spread_positions(labels: DataFrame, gap: float, value: str = "value", order: str = "position", top: float | None = None) -> DataFrame:
    """Adds ``spread``: positions pushed up so that each is at least ``gap`` above the one before; for the labels of a chart.

    The running rule max(own, last + gap) is a running maximum after j x gap is taken from the j-th.
    With ``top`` all move down together by what the highest would pass it by.
    """
    by = Window.orderBy(value, order)
    ranked = labels.withColumn("__litlode_r", F.row_number().over(by) - 1)
    running = F.max(F.col(value) - F.col("__litlode_r") * gap).over(by.rowsBetween(Window.unboundedPreceding, 0))
    spread = ranked.withColumn("spread", running + F.col("__litlode_r") * gap).drop("__litlode_r")
    if top is None:
        return spread
    highest = F.max("spread").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return spread.withColumn("spread", F.col("spread") - F.greatest(F.lit(0.0), highest - F.lit(float(top))))


def free_corner(points: DataFrame, x: str, y: str, xlim: tuple[float, float], ylim: tuple[float, float]) -> DataFrame:
    """(corner) of one row: the corner of the panel whose nearest point is farthest away; ties by reading order."""
    dx, dy = xlim[1] - xlim[0], ylim[1] - ylim[0]
    corners = (("upper left", 0.0, 1.0), ("upper right", 1.0, 1.0), ("lower left", 0.0, 0.0), ("lower right", 1.0, 0.0))
    if dx <= 0 or dy <= 0:
        return points.sparkSession.createDataFrame([("upper left",)], "corner STRING")
    xn, yn = (F.col(x) - xlim[0]) / dx, (F.col(y) - ylim[0]) / dy
    fine = points.filter(xn.isNotNull() & yn.isNotNull() & ~F.isnan(xn) & ~F.isnan(yn) & (F.abs(xn) < float("inf")) & (F.abs(yn) < float("inf")))
    room = fine.agg(*[F.min(F.hypot(xn - cx, yn - cy)).alias(f"d{k}") for k, (_, cx, cy) in enumerate(corners)])
    pick: Column = F.lit("upper left")
    best = F.greatest(*[F.coalesce(F.col(f"d{k}"), F.lit(-1.0)) for k in range(4)])
    for k in (3, 2, 1, 0):
        pick = F.when(F.col(f"d{k}") == best, corners[k][0]).otherwise(pick)
    return room.select(pick.alias("corner"))
