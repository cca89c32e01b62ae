"""Document quality by hierarchical empirical Bayes.

A logistic classifier over a document's surface statistics, fitted on a bounded
labelled sample, gives each document its evidence.  Hosts and the paths below
them are grouped; a host's mean is shrunk toward the global mean and a path's
mean toward its host's, with strengths estimated from the spread between groups
(method of moments), so that sparse sites hardly move the prior and rich ones
do.  A document's posterior joins its own evidence with its path's posterior
mean, from which its own share is taken out.

Defined results: null and empty texts have all-zero statistics; a null host or
path is a group of its own; null labels are ignored, contradicting labels count
as good if any does; repeated rows each count and are scored each; without
labels of both kinds the evidence is neutral; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import Scratch, text_batches, unused_name

#: At most so many labelled rows are fitted on; chosen by a hash of their id.
SAMPLE = 20_000
THRESHOLD = 0.5
#: Penalty on the squares of the weights of statistics in units of their deviations, and the most passes over the sample that fit them.
PENALTY, PASSES = 1e-4, 60
#: Bounds of the estimated prior strengths, in documents.
WEAKEST, STRONGEST = 2.0, 1000.0

_KINDS = np.zeros(256, dtype=np.intp)
for _kind, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b"|", b"#$%&*@^~+=<>/\\{}[]_", b".,;:", b"\n", b" \t\r\x0b\x0c"), start=1):
    _KINDS[list(_bytes)] = _kind
WIDTH = 28


def statistics(text: bytes | None) -> list[float]:
    """Surface statistics of a whole text; all zero for none."""
    words = text.split() if text else []
    if not words:
        return [0.0] * WIDTH
    kinds = np.bincount(_KINDS[np.frombuffer(text, dtype=np.uint8)], minlength=9) / len(text)
    n, lines = len(words), [x for x in text.split(b"\n") if x.strip()]
    shingles = max(1, n - 4)
    half = [
        math.log1p(n), sum(map(len, words)) / n / 10, *kinds[1:8],
        math.log1p(len(set(words))) / math.log1p(n), len(set(lines)) / len(lines), len(lines) / n,
        sum(len(w) < 4 for w in words) / n, len(set(zip(words, words[1:], words[2:], words[3:], words[4:]))) / shingles if n > 4 else 1.0,
    ]
    return [float(x) for x in half] + [float(x) ** 2 if i in (0, 1) else math.sqrt(x) for i, x in enumerate(half)]


def statistics_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([statistics(t) for t in batch], dtype=object)

    return counted(text)


def _matrix(rows: Iterator[Row]) -> tuple[np.ndarray, np.ndarray]:
    """Labels and features of one task's rows."""
    own = list(rows)
    return np.array([r["label"] for r in own], dtype=float), np.array([r["features"] for r in own], dtype=float).reshape(-1, WIDTH)


def _moments(rows: Iterator[Row]) -> Iterator[tuple]:
    """(rows, sums of the features, sums of their squared distances from the task's means) of one task."""
    _, x = _matrix(rows)
    if len(x):
        yield len(x), x.sum(axis=0), ((x - x.mean(axis=0)) ** 2).sum(axis=0)


def _joined(a: tuple, b: tuple) -> tuple:
    apart = a[1] / a[0] - b[1] / b[0]
    return a[0] + b[0], a[1] + b[1], a[2] + b[2] + apart**2 * (a[0] * b[0] / (a[0] + b[0]))


def _slopes(theta: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> Callable[[Iterator[Row]], Iterator[np.ndarray]]:
    """Sums over one task's rows at theta (weights, intercept): the loss, its gradient and its second derivatives, in one array."""

    def summed(rows: Iterator[Row]) -> Iterator[np.ndarray]:
        y, x = _matrix(rows)
        z = np.column_stack([(x - mean) * scale, np.ones(len(x))])
        margin = z @ theta
        chance = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
        loss = (np.logaddexp(0, margin) - y * margin).sum()
        yield np.concatenate([[loss], z.T @ (chance - y), (z.T @ (z * (chance * (1 - chance))[:, None])).ravel()])

    return summed


def fit_logistic(rows: DataFrame, n: int, good: float) -> tuple[np.ndarray, float]:
    """Weights and intercept of the penalised logistic regression of `label` (0 or 1, both there, `good` of `n`) on `features`.

    Newton's method, which takes some ten passes where a quasi-Newton one takes as many as it may: each task sums up its rows,
    and the driver gets an array of WIDTH squared numbers from each core, solves for the step, and halves it if the loss grew.
    """
    shares = rows.select("label", "features").coalesce(rows.sparkSession.sparkContext.defaultParallelism).rdd
    _, total, squares = shares.mapPartitions(_moments).reduce(_joined)
    mean, deviation = total / n, np.sqrt(squares / max(1, n - 1))
    varies = deviation > 1e-9 * np.maximum(1.0, np.abs(mean))
    scale = np.where(varies, 1 / np.where(varies, deviation, 1.0), 0.0)
    penalty = np.append(np.full(WIDTH, PENALTY), 0.0)
    theta = step = np.zeros(WIDTH + 1)
    theta = np.append(theta[:-1], math.log(good / (n - good)))
    best, promised = math.inf, 0.0
    for _ in range(PASSES):
        trial = theta - step
        sums = shares.mapPartitions(_slopes(trial, mean, scale)).reduce(np.add) / n
        loss = sums[0] + (penalty * trial**2).sum() / 2
        if loss > best - 1e-4 * promised and np.abs(step).max() > 1e-9:
            step, promised = step / 2, promised / 2
            continue
        theta, best = trial, loss
        slope = sums[1 : WIDTH + 2] + penalty * theta
        step = np.linalg.solve(sums[WIDTH + 2 :].reshape(WIDTH + 1, -1) + np.diag(penalty), slope)
        promised = float(slope @ step)
        if promised < 1e-10:
            theta = theta - step
            break
    weights = theta[:-1] * scale
    return weights, float(theta[-1] - weights @ mean)


def fit_evidence(scratch: Scratch, docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, sample: int) -> tuple[np.ndarray, float] | None:
    """Weights and intercept of the log odds that a document is good, less the sample's own log odds; None if labels are of one kind."""
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("double").alias("label"))
    marked = scratch.save(marked.orderBy(F.xxhash64("_key"), "_key").limit(sample))
    rows = docs.select(F.col(key).alias("_doc"), F.col(text).cast("binary").alias("_text")).join(F.broadcast(marked), F.col("_doc") == F.col("_key"))
    rows = scratch.save(rows.select("label", statistics_column(F.col("_text")).alias("features")))
    n, good = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or not 0 < good < n:
        return None
    weights, intercept = fit_logistic(rows, n, good)
    scratch.drop(marked, rows)
    return weights, intercept - math.log(good / (n - good))


def evidence_column(text: Column, model: tuple[np.ndarray, float] | None) -> Column:
    """Log likelihood ratio of good against bad, within ±12."""
    if model is None:
        return F.lit(0.0)
    weights, intercept = model

    @F.pandas_udf("double")
    def ratio(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            x = np.array([statistics(t) for t in batch], dtype=float).reshape(-1, WIDTH)
            yield pd.Series(np.clip(x @ weights + intercept, -12, 12))

    return ratio(text.cast("binary"))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: str) -> float:
    """Prior strength from the between-group variance of group means about `mean`: m(1-m)/variance - 1, bounded."""
    row = groups.agg(
        F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col(mean)) ** 2).alias("spread"),
        F.sum("q").alias("q"), F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("ss"),
        F.count(F.lit(1)).alias("groups"), F.sum(F.col("n") * F.col(mean) * (1 - F.col(mean))).alias("binomial"),
    ).first()
    if not row["n"] or row["n"] <= row["groups"]:
        return STRONGEST
    within = max(0.0, (row["q"] - row["ss"]) / (row["n"] - row["groups"]))
    between = max(0.0, (row["spread"] - row["groups"] * within) / row["n"])
    return min(STRONGEST, max(WEAKEST, row["binomial"] / row["n"] / between - 1 if between > 0 else STRONGEST))


def posteriors(rows: DataFrame, evidence: str, host: str, path: str, prior: str, out: str, scratch: Scratch) -> DataFrame:
    """rows, with evidence, host and path in columns of these names, and added `prior`, the mean of its path without the row's own share,
    and `out`, the posterior probability.

    Only three numbers a path are grouped; the statistics are joined back by
    host and path, how is left to Spark.
    """
    chance = 1 / (1 + F.exp(-F.col(evidence)))
    paths = rows.select(F.col(host).alias("h"), F.col(path).alias("p"), chance.alias("c")).groupBy("h", "p")
    paths = scratch.save(paths.agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q")))
    hosts = paths.groupBy("h").agg(*[F.sum(x).alias(x) for x in ("n", "s", "q")])
    total = hosts.agg(F.sum("s"), F.sum("n")).first()
    mean = total[0] / total[1] if total[1] else 0.5
    k_host = _strength(hosts.withColumn("m", F.lit(mean)), "m")
    hosts = hosts.select(F.col("h").alias("g"), ((k_host * mean + F.col("s")) / (k_host + F.col("n"))).alias("m"))
    joined = paths.join(hosts, F.col("h").eqNullSafe(F.col("g")))
    k_path = _strength(joined, "m")
    priors = joined.select("h", "p", (k_path * F.col("m") + F.col("s")).alias("s"), (k_path + F.col("n")).alias("n"))
    every = F.struct(*rows.columns)  # the rows' own columns may have any names
    found = rows.select(every.alias("row"), F.col(host).alias("own_h"), F.col(path).alias("own_p"), F.col(evidence).alias("e")).join(priors, F.col("own_h").eqNullSafe(F.col("h")) & F.col("own_p").eqNullSafe(F.col("p")))
    rest = (F.col("s") - 1 / (1 + F.exp(-F.col("e")))) / (F.col("n") - 1)
    found = found.withColumn("rest", rest)
    return found.select("row.*", F.col("rest").alias(prior), (1 / (1 + F.exp(-(F.col("e") + _logit(F.col("rest")))))).alias(out))


def judge(docs: DataFrame, labels: DataFrame, host: Column, path: Column, text: str = "text", key: str = "doc_id", label: str = "quality", out: str = "quality_score", sample: int = SAMPLE, keep_text: bool = True) -> DataFrame:
    """docs with `site_prior` and `out`, the posterior probability that the document is good; without the text if keep_text is false.

    Texts go through Python once; what is grouped and joined afterwards is read from the rows written with their evidence.
    """
    text_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "quality")
    model = fit_evidence(scratch, docs, labels, text, key, label, sample)
    e, h, p = (unused_name(docs, x) for x in ("_evidence", "_host", "_path"))
    kept = [c for c in docs.columns if keep_text or c != text]
    rows = docs.select(*[F.col(c) for c in kept], host.cast("string").alias(h), path.cast("string").alias(p), evidence_column(F.col(text), model).alias(e))
    prior, out = unused_name(docs, "site_prior"), unused_name(docs, out)
    return posteriors(scratch.save(rows), e, h, p, prior, out, scratch).select(*kept, prior, out)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    judged = judge(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"), keep_text=False)
    return judged.select("doc_id", "source", "lang", "site_prior", "quality_score", (F.col("quality_score") >= THRESHOLD).alias("keep"))
