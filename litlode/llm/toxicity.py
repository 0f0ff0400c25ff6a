"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

One weight per term serves all thresholds: with the score s of a document, the chance of grade
k or more is logistic(s - threshold_k), thresholds ascending. The expected severity is the sum
of these chances. Terms are words of the text (ASCII lowered) and the first 4, 5 and 6 bytes of
longer words, so that inflected and derived forms count; they are weighed by log(1 + count).

Labels say only whether a document is toxic. Grade 0 is not toxic; toxic documents of the
sample are graded 1 to GRADES by the quantiles of the sum of log(1 + count) of toxic terms: those
significantly more frequent in toxic documents of the other half of the sample, so that no
document has a say in which terms grade it. Severity above grade 1 so means how much toxic
vocabulary a document has, which is all that binary labels can tell. Fitting takes a bounded sample of labelled
rows (labelled.ROWS_PER_CLASS, a parameter), the thresholds are then moved to the classes'
frequencies among all labels. Scoring takes every document and whole texts.

Inputs: a null or empty text has score 0 and only the thresholds speak. With no label of one
of the classes nothing can be learned, and every document has severity 0. Rows that repeat,
or have a null doc_id, get a result each. An empty table gives an empty result. Further
columns are not read by ``severity``, and stay as they are in ``drop_toxic``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litlode.llm import labelled
from litlode.llm.common import cut, map_batches, ship, tidy

GRADES = 3
#: Terms of the model at most, their least document count, the least |z| of their association (more among many terms).
TERMS, LEAST_COUNT, LEAST_Z = 1024, 4, 3.0
L1, ROUNDS, RATE = 1e-4, 1200, 0.02
#: Chance of grade 1 or more from which a document is toxic: to miss one costs more than to lose one.
DECISION = 0.2
SEGMENT = 1 << 20
PREFIXES = (4, 5, 6)
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Model:
    weights: dict[bytes, float]
    thresholds: tuple[float, ...]

    def __post_init__(self) -> None:
        #: What a word with any term of the model starts with, or the whole of a shorter one.
        object.__setattr__(self, "gate", frozenset(t.removesuffix(b"*")[: PREFIXES[0]] for t in self.weights))

    def score(self, text: bytes) -> float:
        weights, gate, total, least = self.weights, self.gate, Counter(), PREFIXES[0]
        at = 0
        while at < len(text):
            to = at + SEGMENT
            while to < len(text) and _WORDS[text[to]] != 32:
                to += 1
            likely = [w for w in text[at:to].translate(_WORDS).split() if w[:least] in gate]
            total.update([t for t in terms_of(likely) if t in weights])
            at = to
        return sum(weights[w] * float(np.log1p(c)) for w, c in sorted(total.items()))


def terms_of(words: list[bytes]) -> Iterator[bytes]:
    """Each word, and its first bytes with a mark."""
    for w in words:
        yield w
        for k in PREFIXES:
            if len(w) > k:
                yield w[:k] + b"*"


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit_cumulative(rows: np.ndarray, terms: np.ndarray, values: np.ndarray, y: np.ndarray, n_terms: int, grades: int = GRADES, l1: float = L1, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the cumulative logit model; entries of the feature matrix as (row, term, value).

    Proximal gradient with momentum on the weights, under an L1 penalty; Adam's steps on the
    thresholds, which ascend by construction, as sums of exponentials. Full batches, so the
    result is deterministic.
    """
    n, each = len(y), np.arange(len(y))
    share = np.clip([(y >= g).mean() for g in range(1, grades + 1)], 1e-4, 1 - 1e-4)
    theta = np.log((1 - share) / share)
    beta, gaps = np.zeros(n_terms), np.concatenate((theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))))
    u, top = np.ones(n_terms), 1.0
    for _ in range(30):  # the greatest eigenvalue of the features' second moments bounds the curvature
        u = np.bincount(terms, weights=values * np.bincount(rows, weights=values * u[terms], minlength=n)[rows], minlength=n_terms)
        top = float(np.linalg.norm(u)) or 1.0
        u /= top
    step, ahead, m, v = 2.0 * n / top, beta, np.zeros(grades), np.zeros(grades)
    for t in range(1, rounds + 1):
        theta = gaps[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps[1:]))))
        z = np.bincount(rows, weights=values * ahead[terms], minlength=n)[:, None] - theta
        up = np.concatenate((np.ones((n, 1)), _logistic(z), np.zeros((n, 1))), axis=1)  # chance of grade >= k
        p = np.maximum(up[each, y] - up[each, y + 1], 1e-9)
        slope = up * (1 - up)
        d_score = -(slope[each, y] - slope[each, y + 1]) / p
        moved = ahead - step * np.bincount(terms, weights=values * d_score[rows], minlength=n_terms) / n
        moved = np.sign(moved) * np.maximum(np.abs(moved) - l1 * step, 0)
        ahead, beta = moved + (t - 1) / (t + 2) * (moved - beta), moved
        d_theta = np.array([((y == g + 1) * slope[:, g + 1] - (y == g) * slope[:, g + 1]) @ (1 / p) for g in range(grades)]) / n
        slopes = np.concatenate(([d_theta.sum()], [d_theta[g:].sum() * np.exp(gaps[g]) for g in range(1, grades)]))
        m, v = 0.9 * m + 0.1 * slopes, 0.999 * v + 0.001 * slopes**2
        gaps = gaps - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        gaps[1:] = np.clip(gaps[1:], -3, 4)
    return beta, gaps[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps[1:]))))


def _terms(df: DataFrame) -> DataFrame:
    """(doc_id, y, term, n) of a sample."""

    def run(batches):
        for b in batches:
            rows, terms, counts = [], [], []
            for k, t in enumerate(b.column("text")):
                found = Counter(terms_of(t.as_py().encode().translate(_WORDS).split()))
                rows += [k] * len(found)
                terms += found.keys()
                counts += found.values()
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("y").take(at), pa.array(terms, pa.binary()), pa.array(counts, pa.int32())], names=["doc_id", "y", "term", "n"])

    return map_batches(df.select("doc_id", "y", "text"), run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, y int, term binary, n int")


def signed_root(d0: np.ndarray, d1: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """For each term, in d0 of n0 and d1 of n1 documents, the signed root of the likelihood ratio; about a standard normal by chance."""
    both, g2 = d0 + d1, np.zeros(len(d0))
    for seen, n in ((d0, n0), (d1, n1)):
        for x, e in ((seen, both * (n / (n0 + n1))), (n - seen, (n0 + n1 - both) * (n / (n0 + n1)))):
            some = x > 0
            g2[some] += 2 * x[some] * np.log(x[some] / e[some])
    return np.sqrt(np.maximum(g2, 0)) * np.where(d1 * n0 >= d0 * n1, 1, -1)


def grades(rows: np.ndarray, terms: np.ndarray, values: np.ndarray, y: np.ndarray, n_terms: int) -> np.ndarray:
    """A grade for each document of the sample, 0 for those that aren't toxic; entries as (row, term, value).

    Toxic terms are told on one half of the documents, every other one, for the other.
    """
    amount, half = np.zeros(len(y)), np.arange(len(y)) % 2
    for own in (0, 1):
        others = half[rows] != own
        n0, n1 = (int(((half != own) & (y == k)).sum()) for k in (0, 1))
        if not n0 or not n1:
            continue
        d0, d1 = (np.bincount(terms[others & (y[rows] == k)], minlength=n_terms).astype(float) for k in (0, 1))
        tell = signed_root(d0, d1, n0, n1) >= LEAST_Z
        amount += np.bincount(rows, weights=values * (tell[terms] & ~others), minlength=len(y))
    limits = np.quantile(amount[y == 1], [g / GRADES for g in range(1, GRADES)])
    return np.where(y == 1, 1 + np.searchsorted(limits, amount, side="right"), 0)


def fit(documents: DataFrame, labels: DataFrame, rows_per_class: int = labelled.ROWS_PER_CLASS) -> Model:
    """The model, from at most 2 x ``rows_per_class`` labelled documents and TERMS terms."""
    everyone = labelled.class_counts(labels, "toxic")
    chosen = labelled.sample(documents, labels, "toxic", rows_per_class)
    n = {int(r["y"]): r["count"] for r in chosen.groupBy("y").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return Model({}, (float("inf"),) * GRADES)
    terms = _terms(chosen)
    d = [F.count_if(F.col("y") == k) for k in (0, 1)]
    both, sizes = d[0] + d[1], (n0, n1)
    cells = [(d[k], both * (sizes[k] / (n0 + n1))) for k in (0, 1)] + [(sizes[k] - d[k], (n0 + n1 - both) * (sizes[k] / (n0 + n1))) for k in (0, 1)]
    g2 = 2 * sum((F.when(x > 0, x * F.log(x / e)).otherwise(0.0) for x, e in cells), F.lit(0.0))
    z = F.sqrt(F.greatest(g2, F.lit(0.0))) * F.when(d[1] * n0 >= d[0] * n1, 1).otherwise(-1)  # signed root of the likelihood ratio
    rated = cut(terms.groupBy("term").agg(F.count("*").alias("docs"), z.alias("z")).filter(F.col("docs") >= LEAST_COUNT))
    least_z = max(LEAST_Z, float(np.sqrt(2 * np.log(max(2, rated.count())))))  # about what chance gives among so many
    rated = rated.filter(F.abs("z") >= least_z)
    vocabulary = {bytes(r["term"]): k for k, r in enumerate(rated.orderBy(F.desc(F.abs("z")), "term").limit(TERMS).collect())}
    if not vocabulary:
        return Model({}, (float("inf"),) * GRADES)
    rows = {r["doc_id"]: k for k, r in enumerate(chosen.select("doc_id").orderBy("doc_id").collect())}
    y = np.zeros(len(rows), dtype=np.int64)
    for r in chosen.select("doc_id", "y").collect():
        y[rows[r["doc_id"]]] = r["y"]
    words = chosen.sparkSession.createDataFrame([(bytearray(t),) for t in vocabulary], "term binary")
    entries = [(rows[r["doc_id"]], vocabulary[bytes(r["term"])], r["n"]) for r in terms.join(F.broadcast(words), "term").select("doc_id", "term", "n").toLocalIterator()]
    entries = np.array(sorted(entries), dtype=np.int64).reshape(-1, 3)
    at, term, value = entries[:, 0], entries[:, 1], np.log1p(entries[:, 2])
    beta, theta = fit_cumulative(at, term, value, grades(at, term, value, y, len(vocabulary)), len(vocabulary))
    theta = theta + np.log((everyone[0] / n0) / (everyone[1] / n1))
    return Model({t: float(beta[k]) for t, k in vocabulary.items() if abs(beta[k]) > 1e-6}, tuple(float(t) for t in theta))


def score_column(spark: SparkSession, model: Model, text: Column) -> Column:
    ship(spark)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        told = pa.array([model.score(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts.cast(pa.binary())], pa.float64())
        tidy()
        return told

    return score(text)


def _chances(model: Model, score: Column) -> list[Column]:
    return [F.lit(0.0) if t == float("inf") else 1 / (1 + F.exp(F.lit(t) - score)) for t in model.thresholds]


def severity(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_severity, grade, p_toxic, toxic): toxic from a chance of DECISION; the grade also counts the higher thresholds passed with a chance of half."""
    scored = df.select(F.col(id_col).alias("doc_id"), score_column(df.sparkSession, model, F.col(text_col)).alias("score"))
    chances = _chances(model, F.col("score"))
    total = sum(chances[1:], chances[0])
    grade = sum((F.when(c >= 0.5, 1).otherwise(0) for c in chances[1:]), F.when(chances[0] >= DECISION, 1).otherwise(0))
    return scored.select("doc_id", total.alias("expected_severity"), grade.alias("grade"), chances[0].alias("p_toxic"), (chances[0] >= DECISION).alias("toxic"))


def drop_toxic(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose chance of any toxic grade is under DECISION."""
    return df.filter(_chances(model, score_column(df.sparkSession, model, F.col(text_col)))[0] < DECISION)
