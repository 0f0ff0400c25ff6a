"""A bounded, balanced sample of labelled documents, from which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litlode.llm.common import cut

#: Labelled rows of each class that a classifier is fitted on, at most; a parameter of the operators.
ROWS_PER_CLASS = 4000


def class_counts(labels: DataFrame, label: str) -> dict[int, int]:
    """Rows of each class (0 and 1) over all labels."""
    return {int(r[0]): r[1] for r in labels.filter(F.col(label).isin(0, 1)).groupBy(label).count().collect()}


def sample(documents: DataFrame, labels: DataFrame, label: str, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """(doc_id, y, text) of up to ``rows_per_class`` labelled documents of each class, those of least hash of doc_id.

    Labels that are null or neither 0 nor 1, or of a null doc_id, are left out; of a repeated
    doc_id one label counts, the least. Near copies in the sample, which share the least hash of
    their 5-word shingles, count once, so that a much copied text does not fit its own words. The ids of the sample are broadcast: two classes of
    ``rows_per_class`` rows bound them.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    by_hash = F.xxhash64(F.lit(11), "doc_id")
    chosen = known.filter("y = 0").orderBy(by_hash, "doc_id").limit(rows_per_class).union(known.filter("y = 1").orderBy(by_hash, "doc_id").limit(rows_per_class))
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(cut(chosen)), "doc_id")
    words = F.split("text", r"\s+")
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - 4)), lambda i: F.xxhash64(F.slice("words", i, 5)))
    kept = cut(texts.groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text")))
    sketched = kept.withColumn("words", words).select("doc_id", "y", F.array_min(shingles).alias("sketch"))
    once = sketched.groupBy("y", "sketch").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return cut(kept.join(F.broadcast(cut(once)), "doc_id", "left_semi"))
