"""Exact top-k inner-product search with block-at-a-time pruning.

Candidates are put in an order that keeps alike vectors together (sign pattern
under fixed random hyperplanes) and cut into document-range blocks.  A block
keeps its forward index (its vectors) and, for each term (component), the
largest and smallest value.  For a query the summed term maxima
    sum over terms of max(q * largest, q * smallest)
bound every score in the block.  A query visits blocks by falling bound, scores
a visited block through its forward index, and stops when the bound falls below
its k-th score so far; equal bounds are still visited, since ties go to the
smaller id.  Shards of blocks meet groups of queries as key pairs, so that no
task holds more than one shard and one group.

Defined results: vectors that are null or hold null or non-finite components,
and rows without an id, take no part; vectors of another length never meet;
rows with repeated ids are rows of their own and meet each other; a query with
fewer than k candidates gets all of them; an empty table gives no rows.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, small_parts

BLOCK, SHARD, GROUP = 128, 8192, 16384
K, SCALE = 5, 256.0
_PLANES = 16
_EXACT = float(1 << 53)


def usable(vector: Column) -> Column:
    """True for a vector that is not null and has only finite components."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def integral(vectors: DataFrame, vector: str, key: str, scale: float) -> DataFrame:
    """(id, dims, place, q): floor(scale * component) of each usable vector as packed doubles, and its place in the order."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in it:
            dims, places, packed = [], [], []
            for v in batch.column(1):
                q = np.floor(np.array(v.as_py(), dtype=np.float64) * scale)
                side = planes.setdefault(len(q), np.random.default_rng(len(q)).normal(size=(_PLANES, len(q))))
                dims.append(len(q))
                places.append(int(np.packbits(side @ q > 0, bitorder="big").view(">u2")[0]))
                packed.append(q.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(dims, pa.int32()), pa.array(places, pa.int32()), pa.array(packed, pa.binary())], ["id", "dims", "place", "q"])

    rows = vectors.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(batches, "id long, dims int, place int, q binary").withColumn("row", F.monotonically_increasing_id())


def _packs(size: int):
    """Consecutive rows of equal dims, packed `size` to a row: their row numbers, ids and vectors.  A pack is named by its first row."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        held_dims = -1

        def pack() -> pa.RecordBatch:
            nonlocal held
            rows, ids, vectors = zip(*held)
            out = pa.RecordBatch.from_arrays(
                [pa.array([rows[0]], pa.int64()), pa.array([held_dims], pa.int32()), pa.array([np.array(rows, "<i8").tobytes()], pa.binary()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([b"".join(vectors)], pa.binary())],
                ["pack", "dims", "rows", "ids", "vectors"],
            )
            held = []
            return out

        for batch in it:
            for dims, row, i, q in zip(*[batch.column(c).to_pylist() for c in range(4)]):
                if held and (dims != held_dims or len(held) >= size):
                    yield pack()
                held_dims = dims
                held.append((row, i, q))
        if held:
            yield pack()

    return batches


_PACK = "pack long, dims int, rows binary, ids binary, vectors binary"


def best_of_shard(q: np.ndarray, q_rows: np.ndarray, v: np.ndarray, v_rows: np.ndarray, v_ids: np.ndarray, k: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query positions, ids, scores) of each query's k best in the shard, and how many (query, block) pairs were scored."""
    largest_score = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1]
    if largest_score >= _EXACT:  # beyond exact doubles: Python integers, clipped to a long
        to = np.vectorize(int, otypes=[object])
        q, v = to(q), to(v)
    starts = np.arange(0, len(v), block)
    largest, smallest = np.maximum.reduceat(v, starts, axis=0), np.minimum.reduceat(v, starts, axis=0)
    bounds = np.maximum(q, 0) @ largest.T + np.minimum(q, 0) @ smallest.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    none = -np.inf if bounds.dtype != object else -(1 << 200)
    scores = np.full((len(q), k), none, dtype=bounds.dtype)
    ids = np.full((len(q), k), np.iinfo(np.int64).max)
    active, visited = np.arange(len(q)), 0
    for step in range(len(starts)):
        at = order[active, step]
        going = bounds[active, at] >= scores[active, k - 1]
        active, at = active[going], at[going]
        if not len(active):
            break
        visited += len(active)
        for b in np.unique(at):
            own = active[at == b]
            span = slice(starts[b], starts[b] + block)
            found = q[own] @ v[span].T
            found[q_rows[own][:, None] == v_rows[span][None, :]] = none
            both = np.concatenate([scores[own], found], axis=1)
            both_ids = np.concatenate([ids[own], np.broadcast_to(v_ids[span], found.shape)], axis=1)
            top = np.lexsort((both_ids, -both), axis=1)[:, :k]
            scores[own], ids[own] = np.take_along_axis(both, top, axis=1), np.take_along_axis(both_ids, top, axis=1)
    there = scores != none
    at = np.nonzero(there)[0]
    limit = (1 << 63) - 1
    return at, ids[there], np.array([max(-limit - 1, min(limit, int(s))) for s in scores[there]], dtype=np.int64), visited


def search(vectors: DataFrame, is_query: Column, vector: str = "embedding", key: str = "vec_id", k: int = K, scale: float = SCALE, shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `is_query` its k rows of largest integer inner product, ties to the smaller id.

    Shards and query groups are counted; each meets each once, keyed by the
    pair, because every query has to be answered from all rows.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    rows = scratch.save(integral(vectors.select(key, vector), vector, key, scale))
    parts = small_parts(vectors.sparkSession)
    kept = rows.select("dims", "row", "id", "q", "place")
    shards = scratch.save(kept.repartitionByRange(parts, "dims", "place", "id", "row").sortWithinPartitions("dims", "place", "id", "row").select("dims", "row", "id", "q").mapInArrow(_packs(shard), _PACK))
    asked = rows.withColumn(key, F.col("id")).where(is_query).select("dims", "row", "id", "q")
    groups = scratch.save(asked.repartitionByRange(max(1, parts // 8), "dims", "id", "row").sortWithinPartitions("dims", "id", "row").mapInArrow(_packs(group), _PACK))
    groups = groups.withColumnRenamed("pack", "asked")
    left = shards.join(groups.select("asked", F.col("dims").alias("_dims")), F.col("dims") == F.col("_dims")).drop("_dims")
    right = groups.join(shards.select("pack", F.col("dims").alias("_dims")), F.col("dims") == F.col("_dims"))
    right = right.select(F.col("pack").alias("to_pack"), F.col("asked").alias("by"), *[F.col(c).alias(c) for c in ("dims", "rows", "ids", "vectors")])

    def meet(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        for c in candidates.itertuples():
            v = np.frombuffer(c.vectors, "<f8").reshape(-1, c.dims)
            for g in queries.itertuples():
                q = np.frombuffer(g.vectors, "<f8").reshape(-1, g.dims)
                rows_of = np.frombuffer(g.rows, "<i8")
                at, ids, scores, _ = best_of_shard(q, rows_of, v, np.frombuffer(c.rows, "<i8"), np.frombuffer(c.ids, "<i8"), k)
                found.append(pd.DataFrame({"row": rows_of[at], "query_id": np.frombuffer(g.ids, "<i8")[at], "vec_id": ids, "score": scores}))
        return pd.concat(found) if found else pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}, dtype="i8")

    met = left.groupBy("pack", "asked").cogroup(right.groupBy("to_pack", "by")).applyInPandas(meet, "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, F.col("vec_id") % 50 == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
