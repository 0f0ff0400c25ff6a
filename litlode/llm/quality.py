"""Quality by hierarchical empirical Bayes over documents, paths and hosts.

A logistic model over surface features gives each document its own evidence, a log-likelihood
ratio of good against poor. The evidence of all documents is then pooled by grouped sums:
the mean chance of a host is shrunk toward the corpus mean, and that of a path inside the
host toward the host's posterior, each with the strength that the spread between groups calls
for (method of moments), so a host or path with few documents says little. A document's score
adds to its own evidence, as the prior, the log-odds of its path's posterior without the
document itself: its evidence counts once, and the only document of a site has the corpus' prior.

The host of a document is its source and the path its language within the source; both columns
are parameters. The model is fitted on a bounded sample of labelled rows
(labelled.ROWS_PER_CLASS, a parameter); the sums and the scores cover every document, and
whole texts are read. The path table is broadcast only if it has at most
common.BROADCAST_ROWS rows, counted first; beyond that it is joined by a shuffle.

Inputs: a null text is empty and has no evidence (log-ratio 0). A null host or path is a group
of its own. With no label of one of the classes there is no evidence at all, and every
document is kept. Rows that repeat, or have a null doc_id, get a result each. An empty table
gives an empty result. Further columns are not read by ``rate``, and stay as they are in
``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litlode.llm import labelled
from litlode.llm.common import cut, map_batches, ship, small_side, tidy

#: Ridge penalty of the fit, bound of a document's log-ratio, chance from which a document is kept.
RIDGE, MOST_EVIDENCE, DECISION = 1e-3, 12.0, 0.5
SEGMENT = 1 << 20
#: Bounds of the strength (in documents) of a prior.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1e4
FEATURES = ("symbols", "capitals", "repeats", "variety", "digits", "word_length")

_KIND = np.zeros(256, dtype=np.int64)  # 0 other, 1 symbol, 2 capital, 3 small letter, 4 digit, 5 white space, 6 plain mark, 7 beyond ASCII
_KIND[33:127] = 1
_KIND[[ord(c) for c in ",.;:'\"()-?!"]] = 6
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 2, 3, 4, 7
_KIND[[9, 10, 11, 12, 13, 32]] = 5


def features(text: bytes) -> list[float]:
    """Shares, each on a log scale: symbols, capitals, words that repeat the one before, different words, digits; mean word length."""
    kinds, words, repeats, marked, different = np.zeros(8), 0, 0, 0, set()
    at, last = 0, None
    while at < len(text):
        to = at + SEGMENT
        while to < len(text) and _KIND[text[to]] != 5:
            to += 1
        part = text[at:to]
        kinds += np.bincount(_KIND[np.frombuffer(part, dtype=np.uint8)], minlength=8)
        own = part.split()
        repeats += sum(map(bytes.__eq__, own, own[1:])) + bool(own and own[0] == last)
        marked += part.count(b"!!") + part.count(b" |")
        words += len(own)
        different.update(map(hash, own))
        last = own[-1] if own else last
        at = to
    letters, n = kinds[2] + kinds[3], max(1, words)
    scale = lambda share: float(np.log1p(100 * share))
    long = max(1.0, np.log2(n + 1) / 8)  # variety falls with length
    return [scale((kinds[1] + marked) / max(1, len(text))), scale(kinds[2] / max(1, letters)), scale(repeats / n), scale(max(0.0, 1 - long * len(different) / n)), scale(kinds[4] / max(1, len(text))), min(20.0, (len(text) - kinds[5]) / n)]


@dataclass(frozen=True)
class Model:
    center: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]  # the last is the intercept, for equally frequent classes

    def evidence(self, text: bytes) -> float:
        if not text or not self.weights:
            return 0.0
        x = np.clip((np.array(features(text)) - self.center) / self.scale, -8, 8)
        return float(np.clip(x @ self.weights[:-1] + self.weights[-1], -MOST_EVIDENCE, MOST_EVIDENCE))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 50) -> np.ndarray:
    """Weights and intercept by damped Newton steps; both classes weigh the same."""
    x = np.column_stack((x, np.ones(len(x))))
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, penalty = np.zeros(x.shape[1]), ridge * np.append(np.ones(x.shape[1] - 1), 0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty + 1e-8), gradient)
        step *= min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(documents: DataFrame, labels: DataFrame, rows_per_class: int = labelled.ROWS_PER_CLASS) -> Model:
    """The document model, from at most 2 x ``rows_per_class`` labelled documents."""
    chosen = labelled.sample(documents, labels, "quality", rows_per_class)

    def run(batches):
        for b in batches:
            rows = [features(t.as_py().encode()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(rows, pa.list_(pa.float64()))], names=["y", "x"])

    rows = sorted((r["y"], tuple(r["x"])) for r in map_batches(chosen.select("y", "text"), run, "y int, x array<double>").collect())  # bounded by the sample
    y = np.array([r[0] for r in rows])
    if not len(y) or y.min() == y.max():
        return Model((), (), ())
    x = np.array([r[1] for r in rows])
    center, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    return Model(tuple(center.tolist()), tuple(scale.tolist()), tuple(fit_logistic(np.clip((x - center) / scale, -8, 8), y).tolist()))


def evidence_column(spark: SparkSession, model: Model, text: Column) -> Column:
    ship(spark)

    @F.arrow_udf("double")
    def evidence(texts: pa.Array) -> pa.Array:
        told = pa.array([model.evidence(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts.cast(pa.binary())], pa.float64())
        tidy()
        return told

    return evidence.asNondeterministic()(text)  # else the optimizer evaluates it twice, in a filter and in what is selected


def _strength(groups: DataFrame, mean: str, prior: str) -> float:
    """The prior's weight in documents: mean x (1 - mean) over the variance between groups, less one; from sums over all groups."""
    n, p, q = F.col("n"), F.col(mean), F.col(prior)
    told = groups.agg(F.sum(n * (p - q) ** 2).alias("spread"), F.sum(n * q * (1 - q) / n).alias("noise"), F.sum(n).alias("n"), F.sum(n * q * (1 - q)).alias("most")).first()
    if not told["n"]:
        return MOST_STRENGTH
    between = max(0.0, (told["spread"] - told["noise"]) / told["n"])
    return float(np.clip(told["most"] / told["n"] / max(between, 1e-12) - 1, LEAST_STRENGTH, MOST_STRENGTH))


def posteriors(scored: DataFrame) -> DataFrame:
    """A row for each path, from (host, path, evidence) of all documents; materialised.

    (h, p, n, good, host_n, host_good, mean, host_strength, path_strength, host_posterior, path_posterior): documents and
    sums of their chances, the corpus mean, the priors' weights in documents, and the posteriors of all documents.
    """
    chance = 1 / (1 + F.exp(-F.col("evidence")))
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(chance).alias("good")))
    whole = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    mean = min(1 - 1e-3, max(1e-3, (whole["good"] or 0.5) / (whole["n"] or 1)))
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).select("host", "n", "good", (F.col("good") / F.col("n")).alias("own"), F.lit(mean).alias("prior")))
    k = _strength(hosts, "own", "prior")
    known = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("good").alias("host_good"), ((F.col("good") + k * mean) / (F.col("n") + k)).alias("host_posterior"))
    paths = cut(paths.join(known, F.col("host").eqNullSafe(F.col("h"))).drop("h").withColumn("own", F.col("good") / F.col("n")))
    m = _strength(paths, "own", "host_posterior")
    told = [F.lit(mean).alias("mean"), F.lit(k).alias("host_strength"), F.lit(m).alias("path_strength")]
    return cut(paths.select(F.col("host").alias("h"), F.col("path").alias("p"), "n", "good", "host_n", "host_good", *told, "host_posterior", ((F.col("good") + m * F.col("host_posterior")) / (F.col("n") + m)).alias("path_posterior")))


def _judged(scored: DataFrame, prior: DataFrame) -> DataFrame:
    """``scored`` with the posteriors and the score."""
    same = F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p"))
    own = 1 / (1 + F.exp(-F.col("evidence")))
    host = (F.col("host_good") - own + F.col("host_strength") * F.col("mean")) / (F.col("host_n") - 1 + F.col("host_strength"))
    path = (F.col("good") - own + F.col("path_strength") * host) / (F.col("n") - 1 + F.col("path_strength"))
    others = F.least(F.lit(1 - 1e-3), F.greatest(F.lit(1e-3), path))
    joined = scored.join(small_side(prior), same).withColumn("score", 1 / (1 + F.exp(-F.col("evidence")) * (1 - others) / others))
    return joined.drop("h", "p", "n", "good", "host_n", "host_good", "mean", "host_strength", "path_strength")


def rate(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """(doc_id, evidence, host_posterior, path_posterior, score, kept) of every row."""
    scored = cut(df.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), evidence_column(df.sparkSession, model, F.col(text_col)).alias("evidence")))
    return _judged(scored, posteriors(scored)).select("doc_id", "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= DECISION).alias("kept"))


def keep_good(df: DataFrame, model: Model, text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """The rows of ``df`` that are kept; texts are read twice, for the posteriors and for the decisions, rather than shuffled."""
    evidence = evidence_column(df.sparkSession, model, F.col(text_col))
    prior = posteriors(df.select(F.col(host_col).alias("host"), F.col(path_col).alias("path"), evidence.alias("evidence")))
    scored = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), evidence.alias("evidence"))
    return _judged(scored, prior).filter(F.col("score") >= DECISION).select("row.*")
