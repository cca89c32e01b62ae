"""Toxicity scores by a factorization machine over hashed terms.

Terms of a text are its words and their prefixes of four to six letters (so
that inflected forms share evidence), each hashed into one of 2^18 buckets; no
term is left out.  The machine has a weight for each bucket and, for pairs of
terms, a factor vector.  It is trained in two parts: first the weights, by
follow-the-regularised-leader, whose absolute penalty leaves buckets at zero
that carry no evidence of their own; then the factors too, which learn from
what the weights leave unexplained, so that terms that are neutral alone (an
insult quoted, a group mentioned) still count as a pair.

Labels, language, source and doc_id are never inputs of a score.

Defined results: null and empty texts have no terms and get the base score;
rows with a null doc_id are scored and not held out; labels that are null are
ignored and contradicting labels of one document count as toxic; repeated rows
are scored each; other columns stay; without labelled rows every score is 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, Scratch, text_batches, unused_name

LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
BUCKETS, FACTORS = 1 << 18, 6
#: At most so many labelled rows are fitted on; chosen by a hash of their id.
SAMPLE = 20_000
#: Texts in a training step, passes over the sample, and steps that there are at least.
BATCH, PASSES, STEPS = 64, 4, 750
#: Of the weights: step size, penalties of the absolute value (a pass) and of the square.
RATE, ABSOLUTE, SQUARE = 6.0, 1.25, 0.1
#: Of the factors: spread of their first values, step size and decay a step, and in how many texts a bucket is before pairs of it can be learned.
SPREAD, FACTOR_RATE, DECAY, SUPPORT = 0.1, 3.0, 0.001, 8
THRESHOLD = 0.7
#: Words in each of the two generations that a Python worker remembers.
_REMEMBER = 100_000
_PIECE = 1 << 20


def word_terms(chunk: str) -> bytes:
    """Buckets, as little-endian 32-bit numbers, of the words in a white-space delimited, lower-cased chunk and of their prefixes."""
    found = []
    for word in LETTERS.findall(chunk):
        for term in [word] + ["^" + word[:n] for n in PREFIXES if len(word) >= n]:
            found.append(xxhash.xxh64_intdigest(term) % BUCKETS)
    return np.array(found, dtype="<i4").tobytes()


def term_finder() -> Callable[[str | None], np.ndarray]:
    """A function from text to its distinct buckets, ascending, that remembers chunks."""
    chunks = Recent(_REMEMBER)

    def terms(text: str | None) -> np.ndarray:
        own = set((text or "").lower().split())
        for chunk in chunks.recall(own):
            chunks.young[chunk] = word_terms(chunk)
        found = np.unique(np.frombuffer(b"".join([chunks.young[c] for c in own]), "<i4"))
        chunks.age()
        return found

    return terms


@dataclass
class Machine:
    """score = sigmoid(base + sum of weights + sum over pairs of terms of their factors' dot products / number of terms)"""

    base: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, terms: np.ndarray) -> float:
        z = self.base
        if len(terms):
            v = self.factors[terms].astype(np.float64)
            z += float(self.weights[terms].sum(dtype=np.float64)) + 0.5 * float((v.sum(axis=0) ** 2).sum() - (v**2).sum()) / len(terms)
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def fit_machine(rows: list[np.ndarray], labels: np.ndarray) -> Machine:
    """The machine learned from the buckets of texts and their labels, 0 or 1.  Deterministic.  Empties `rows`."""
    r = np.random.default_rng(7)
    n, rate = len(rows), min(max(float(labels.mean()), 1e-3), 1 - 1e-3) if len(rows) else 1e-3
    base = float(np.log(rate / (1 - rate)))
    flat = np.concatenate([*rows, np.zeros(0, "<i4")])
    sizes = np.array([len(x) for x in rows], dtype=np.int64)
    rows.clear()
    starts = np.concatenate([[0], np.cumsum(sizes)])
    weights, pull, seen = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
    count = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(flat), _PIECE):
        count += np.bincount(flat[at : at + _PIECE], minlength=BUCKETS)
    learnable = count >= SUPPORT
    factors = np.zeros((BUCKETS, FACTORS), np.float32)
    moved = np.zeros(BUCKETS, np.float32)
    passes = max(PASSES, -(-STEPS * BATCH // n)) if n else 0
    for turn in range(passes):
        if turn == passes // 2:
            factors = (r.normal(0, SPREAD, (BUCKETS, FACTORS)) * learnable[:, None]).astype(np.float32)
        order = r.permutation(n)
        for at in range(0, n, BATCH):
            batch = order[at : at + BATCH]
            batch = batch[sizes[batch] > 0]
            if not len(batch):
                continue
            own = np.repeat(np.arange(len(batch)), sizes[batch])
            first = np.concatenate([[0], np.cumsum(sizes[batch])[:-1]])
            terms = flat[np.arange(len(own)) - first[own] + starts[batch][own]]
            unit = (1 / np.sqrt(sizes[batch])).astype(np.float32)[own]
            v = factors[terms] * unit[:, None]
            sums = np.add.reduceat(v, first, axis=0)
            z = base + np.add.reduceat(weights[terms] - 0.5 * (v**2).sum(axis=1), first) + 0.5 * (sums**2).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[batch]).astype(np.float32)
            used, place = np.unique(terms, return_inverse=True)
            slope = np.bincount(place, weights=error[own], minlength=len(used)).astype(np.float32)
            more = seen[used] + slope**2
            pull[used] += slope - (np.sqrt(more) - np.sqrt(seen[used])) / RATE * weights[used]
            seen[used] = more
            beyond = np.sign(pull[used]) * np.maximum(np.abs(pull[used]) - ABSOLUTE * passes, 0)
            weights[used] = -beyond / ((1 + np.sqrt(more)) / RATE + SQUARE)
            if turn >= passes // 2:
                by_term = np.argsort(place, kind="stable")
                cuts = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(used)))[:-1]])
                slopes = np.add.reduceat(((sums[own] - v) * (error[own] * unit)[:, None])[by_term], cuts, axis=0) * learnable[used][:, None]
                moved[used] += (slopes**2).mean(axis=1)
                factors[used] = (factors[used] - FACTOR_RATE * slopes / np.sqrt(1 + moved[used])[:, None]) * (1 - DECAY)
            base -= 0.01 * float(error.mean())
    return Machine(base, weights, factors)


def fit(scratch: Scratch, docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Machine | None:
    """The machine learned from labels (key, label 0 or 1); None without labelled rows.

    Only `sample` labelled rows, the first by a hash of their key, are fitted
    on, so what is broadcast (16 bytes a row) and the task that trains on their
    buckets (four bytes a term) are bounded.
    """
    text_batches(docs.sparkSession)
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    marked = scratch.save(marked.orderBy(F.xxhash64("_key"), "_key").limit(sample))
    rows = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text")).join(F.broadcast(marked), F.col("_doc") == F.col("_key"))

    def found(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = term_finder()
        for batch in it:
            packed = [terms(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["label", "terms"])

    found_rows = scratch.save(rows.select("_label", "_text").mapInArrow(found, "label int, terms binary"))
    fitted = found_rows.coalesce(1).mapInArrow(_fitted, "base double, weights binary, factors binary").collect()  # one row; the sample is bounded
    scratch.drop(marked, found_rows)
    if not fitted:
        return None
    base, weights, factors = fitted[0]
    return Machine(base, np.frombuffer(weights, "<f4"), np.frombuffer(factors, "<f4").reshape(BUCKETS, FACTORS))


def _fitted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The machine learned from all (label, terms) rows, in the order of their values; nothing without rows."""
    sampled = sorted((label, terms.as_py()) for batch in it for label, terms in zip(batch.column(0).to_pylist(), batch.column(1)))
    if sampled:
        marks = np.array([mark > 0 for mark, _ in sampled], dtype=np.float64)
        found = [np.frombuffer(t, "<i4") for _, t in sampled]
        del sampled
        machine = fit_machine(found, marks)
        yield pa.RecordBatch.from_arrays([pa.array([machine.base]), pa.array([machine.weights.astype("<f4").tobytes()]), pa.array([machine.factors.astype("<f4").tobytes()])], ["base", "weights", "factors"])


def score(docs: DataFrame, machine: Machine | None, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the score of each whole text, from 0 to 1, in a column `out`."""
    text_batches(docs.sparkSession)
    if machine is None:
        return docs.withColumn(out, F.lit(0.0))

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = term_finder()
        for batch in texts:
            yield pd.Series([machine.score(terms(t)) for t in batch], dtype="float64")

    return docs.withColumn(out, scored(F.col(text)))


def held_out(key: str = "doc_id") -> F.Column:
    """Rows whose crc32(key as text) leaves 1 when divided by 3; their labels are not learned."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", out: str = "score") -> DataFrame:
    """docs with their toxicity score, learned from the labels that are not held out."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    return score(docs, fit(scratch, docs, labels.where(~held_out(key)), text, key), text, unused_name(docs, out))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return judged.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
