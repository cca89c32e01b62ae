"""Near-duplicate embeddings by NN-descent.

Equal vectors of a label are one node.  A neighbour graph starts from windows
over range-sorted random projections and is refined: a node's neighbours and
some of the nodes it is neighbour of are brought together and compared
(neighbours of neighbours), each node keeps its best K, and rounds go on until
few lists change.  A list that is saturated, all of it above the threshold, is
enlarged to WIDE entries.  Where even those are all links, the node is in a dense
group, and what the group has beyond the lists is found exactly: by triangle
bounds on angles between the pivots of dense components, which tell the few pairs
of components that can have links between them, and in blocks within a
component, without emitting pairs.  A bounded sample of nodes is
compared with everything of its label to audit recall; while it misses the
target, the descent goes on with longer lists and further projections, and a
recall that still misses it is an error.  Only links that the exact cosine confirms are kept.

Defined results: vectors that are null, zero or hold null or non-finite
components, rows with a null label and rows without an id link with nothing
(n_links 0, component_id their own id); vectors of different lengths never link; repeated
rows count as vectors of their own; an empty table gives no rows.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, connected_components, ranked, small_parts
from .topk import usable

THRESHOLD = 0.98
#: Length of a neighbour list, of a saturated one, and how many reverse neighbours join it.
K, WIDE, REVERSE = 12, 32, 12
PROJECTIONS, WINDOW, ROUNDS = 3, 192, 6
#: The descent ends when fewer than this share of list entries is new.
SETTLED = 0.002
#: Nodes audited against all others, the recall of links asked for, and how often the descent is taken up again.
AUDIT, RECALL, AGAIN = 256, 0.99, 3
#: Rounding to bytes moves a cosine by less than this.
MARGIN = 0.03
BLOCK = 1024


def _floats(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


def _nodes(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """Distinct (site, v) with node number, copies, smallest id and the unit vector rounded to bytes."""

    def rounded(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in it:
            out = []
            for v in batch:
                x = np.frombuffer(v, "<f8")
                out.append(np.round(x * (127 / np.abs(x).max())).astype("i1").tobytes())
            yield pd.Series(out, dtype=object)

    rounded.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    distinct = rows.groupBy("site", "v").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    distinct = distinct.withColumn("b", F.pandas_udf(rounded, "binary")("v"))
    return scratch.save(distinct.withColumn("node", F.monotonically_increasing_id()))


def _unit(packed: np.ndarray) -> np.ndarray:
    x = packed.astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _window_edges(nodes: DataFrame, seed: int, k: int) -> DataFrame:
    """(u, v, s): best k of each node among those near it on a random line, within its site."""

    def projected(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at = []
            for b in batch.column(2).to_pylist():
                x = np.frombuffer(b, "i1").astype(np.float32)
                line = np.random.default_rng(seed * 1_000_003 + len(x)).normal(size=len(x))
                at.append(float(x @ line / np.linalg.norm(x)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], ["node", "site", "b", "at"])

    def compared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        site, fresh = None, 0

        def best() -> pa.RecordBatch:
            ids = np.array([i for i, _ in held])
            x = _unit(np.frombuffer(b"".join(b for _, b in held), "i1").reshape(len(held), -1))
            s = x @ x.T
            np.fill_diagonal(s, -2)
            n = min(k, len(held) - 1)
            top = np.argpartition(-s, n - 1, axis=1)[:, :n]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(ids[top].ravel()), pa.array(np.take_along_axis(s, top, axis=1).ravel())], ["u", "v", "s"])

        for batch in it:
            for node, own, b in zip(*[batch.column(c).to_pylist() for c in range(3)]):
                if own != site or len(held) == WINDOW:
                    if fresh and len(held) > 1:
                        yield best()
                    held = held[WINDOW // 2 :] if own == site else []
                    site, fresh = own, 0
                held.append((node, b))
                fresh += 1
        if fresh and len(held) > 1:
            yield best()

    lines = nodes.select("node", "site", "b").mapInArrow(projected, "node long, site string, b binary, at double")
    lines = lines.repartitionByRange(small_parts(nodes.sparkSession), "site", "at", "node").sortWithinPartitions("site", "at", "node")
    return lines.mapInArrow(compared, "u long, v long, s float")


def _best(edges: DataFrame, k: int) -> DataFrame:
    """Each node's best k entries, and up to WIDE where they are above the threshold; fresh ones marked."""
    edges = edges.groupBy("u", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))
    wide = max(k, WIDE)
    return edges.withColumn("place", place).where(f"place <= {wide}").where(f"place <= {k} OR s >= {THRESHOLD - MARGIN}").drop("place")


def _descend(nodes: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """New entries (u, v, s) that neighbours of neighbours propose: better than the worst of u's list."""
    worst = lists.groupBy("u").agg(F.when(F.count(F.lit(1)) >= k, F.min("s")).otherwise(F.lit(-2.0).cast("float")).alias("worst"))
    known = nodes.select("node", "b").join(worst, F.col("node") == F.col("u")).select("node", "b", "worst")
    place = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("fresh"), F.xxhash64("u", "v")))
    back = lists.withColumn("place", place).where(f"place <= {REVERSE}")
    met = lists.select(F.col("u").alias("at"), F.col("v").alias("x"), "fresh").union(back.select(F.col("v").alias("at"), F.col("u").alias("x"), "fresh"))
    met = met.groupBy("at", "x").agg(F.max("fresh").alias("fresh")).join(known, F.col("x") == F.col("node"))
    met = met.groupBy("at").agg(F.collect_list(F.struct("x", "fresh", "worst", "b")).alias("near")).where(F.size("near") > 1)

    def compared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists_, out = batch.column(0), []
            ends, flat = lists_.offsets.to_numpy(), lists_.values
            x, fresh, worst = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            packed = flat.field(3)
            for a, b in zip(ends[:-1], ends[1:]):
                unit = _unit(_floats(packed.slice(a, b - a), "i1").reshape(b - a, -1))
                s = unit @ unit.T
                better = (s > worst[a:b, None]) & ((fresh[a:b, None] | fresh[None, a:b]) > 0)
                np.fill_diagonal(better, False)
                i, j = np.nonzero(better)
                out.append((x[a:b][i], x[a:b][j], s[i, j]))
            u, v, s = (np.concatenate(c) for c in zip(*out)) if out else ([], [], [])
            if len(u):
                _, first = np.unique(np.stack([u, v]), axis=1, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(u[first], pa.int64()), pa.array(v[first], pa.int64()), pa.array(s[first], pa.float32())], ["u", "v", "s"])

    return met.select("near").mapInArrow(compared, "u long, v long, s float")


def _confirmed(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the pairs (u, v) those whose exact cosine reaches the threshold."""
    left = nodes.select(F.col("node").alias("u"), F.col("v").alias("p"))
    right = nodes.select(F.col("node").alias("v"), F.col("v").alias("q"))

    def linked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            p, q = (b"".join(batch.column(c).to_pylist()) for c in (2, 3))
            keep = []
            if batch.num_rows:
                sizes = [len(x) for x in batch.column(2).to_pylist()]
                at = 0
                for n in sizes:
                    keep.append(bool(_cosines(np.frombuffer(p[at : at + n], "<f8")[None], np.frombuffer(q[at : at + n], "<f8")[None])[0, 0] >= THRESHOLD))
                    at += n
            out = batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
            yield out

    return pairs.join(left, "u").join(right, "v").select("u", "v", "p", "q").mapInArrow(linked, "u long, v long")


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)[None, :]


def _counts(scratch: Scratch, nodes: DataFrame, components: DataFrame) -> DataFrame:
    """(node, links): how many other vectors each linked node's vectors link to, by exact cosines within its component, in blocks."""
    members = ranked(scratch, components, ["component"], ["node"], "place")
    members = members.withColumn("block", F.floor(F.col("place") / BLOCK).cast("int"))
    blocks = members.groupBy("component").agg((F.max("block") + 1).alias("blocks")).withColumnRenamed("component", "c")
    members = members.join(blocks, F.col("component") == F.col("c")).join(nodes.select(F.col("node").alias("n"), "v", "copies"), F.col("node") == F.col("n"))
    # each block of a component meets each block of it once: as rows of the pair's first side and of its second
    meets = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meets = meets.select("component", "node", "v", "copies", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def counted(group: pd.DataFrame) -> pd.DataFrame:
        lo, hi = group["lo"].iloc[0], group["hi"].iloc[0]
        one, two = group[group["block"] == lo], group[group["block"] == hi]
        a, b = (np.frombuffer(b"".join(g["v"]), "<f8").reshape(len(g), -1) for g in (one, two))
        near = _cosines(a, b) >= THRESHOLD
        if lo == hi:
            np.fill_diagonal(near, False)
        found = [pd.DataFrame({"node": one["node"].to_numpy(), "links": near @ two["copies"].to_numpy()})]
        if lo != hi:
            found.append(pd.DataFrame({"node": two["node"].to_numpy(), "links": near.T @ one["copies"].to_numpy()}))
        return pd.concat(found)

    return meets.groupBy("component", "lo", "hi").applyInPandas(counted, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def _dense_links(scratch: Scratch, nodes: DataFrame, lists: DataFrame, components: DataFrame) -> DataFrame:
    """Links (a, b) between components that hold a node whose list is full of links: one at least for each pair of blocks of
    such components that are linked.  Members of two components can only be linked if the angle of their pivots is at most
    the sum of the components' widest angles and the threshold's."""
    full = lists.where(f"s >= {THRESHOLD - MARGIN}").groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= WIDE).select("u")
    dense = components.join(full, F.col("node") == F.col("u")).select(F.col("component").alias("c")).distinct()
    members = components.join(dense, F.col("component") == F.col("c")).join(nodes.select(F.col("node").alias("n"), "site", "v"), F.col("node") == F.col("n")).select("site", "c", "node", "v")
    members = ranked(scratch, members, ["c"], ["node"], "place").withColumn("block", F.floor(F.col("place") / BLOCK).cast("int"))
    members = scratch.save(members)
    pivots = members.where("place = 0").select("site", "c", F.col("v").alias("pivot"))

    def widest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            angles = [float(np.arccos(np.clip(_cosines(np.frombuffer(p, "<f8")[None], np.frombuffer(v, "<f8")[None])[0, 0], -1, 1))) for p, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(angles, pa.float64())], ["c", "angle"])

    angles = members.join(pivots.select(F.col("c").alias("of"), "pivot"), F.col("c") == F.col("of")).select("c", "pivot", "v").mapInArrow(widest, "c long, angle double")
    angles = angles.groupBy(F.col("c").alias("of")).agg(F.max("angle").alias("angle"))
    pivots = pivots.join(angles, F.col("c") == F.col("of")).select("site", "c", "pivot", "angle")
    pivots = ranked(scratch, pivots, ["site"], ["c"], "place").withColumn("block", F.floor(F.col("place") / BLOCK).cast("int"))
    blocks = pivots.groupBy(F.col("site").alias("s")).agg((F.max("block") + 1).alias("blocks"))
    pivots = pivots.join(blocks, F.col("site") == F.col("s")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pivots = pivots.select("site", "c", "pivot", "angle", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    reach = float(np.arccos(THRESHOLD)) + 1e-6

    def close(group: pd.DataFrame) -> pd.DataFrame:
        lo, hi = group["lo"].iloc[0], group["hi"].iloc[0]
        one, two = group[group["block"] == lo], group[group["block"] == hi]
        a, b = (np.frombuffer(b"".join(g["pivot"]), "<f8").reshape(len(g), -1) for g in (one, two))
        i, j = np.nonzero(np.arccos(np.clip(_cosines(a, b), -1, 1)) <= one["angle"].to_numpy()[:, None] + two["angle"].to_numpy()[None, :] + reach)
        pairs = pd.DataFrame({"c1": one["c"].to_numpy()[i], "c2": two["c"].to_numpy()[j]})
        return pairs[pairs["c1"] < pairs["c2"]] if lo == hi else pairs

    pairs = pivots.groupBy("site", "lo", "hi").applyInPandas(close, "c1 long, c2 long")
    sizes = members.groupBy(F.col("c").alias("of")).agg((F.max("block") + 1).alias("blocks"))
    one, two = (sizes.select(F.col("of").alias(c), F.col("blocks").alias(n)) for c, n in (("c1", "n1"), ("c2", "n2")))
    meets = pairs.join(one, "c1").join(two, "c2").withColumn("b1", F.explode(F.sequence(F.lit(0), F.col("n1") - 1))).withColumn("b2", F.explode(F.sequence(F.lit(0), F.col("n2") - 1)))
    meets = scratch.save(meets.select("c1", "c2", "b1", "b2"))
    first = meets.join(members.withColumnRenamed("block", "own"), (F.col("c1") == F.col("c")) & (F.col("b1") == F.col("own"))).select("c1", "c2", "b1", "b2", F.lit(1).alias("side"), "node", "v")
    second = meets.join(members.withColumnRenamed("block", "own"), (F.col("c2") == F.col("c")) & (F.col("b2") == F.col("own"))).select("c1", "c2", "b1", "b2", F.lit(2).alias("side"), "node", "v")

    def linked(group: pd.DataFrame) -> pd.DataFrame:
        one, two = group[group["side"] == 1], group[group["side"] == 2]
        a, b = (np.frombuffer(b"".join(g["v"]), "<f8").reshape(len(g), -1) for g in (one, two))
        i, j = np.nonzero(_cosines(a, b) >= THRESHOLD)
        return pd.DataFrame({"a": one["node"].to_numpy()[i[:1]], "b": two["node"].to_numpy()[j[:1]]})

    return first.unionByName(second).groupBy("c1", "c2", "b1", "b2").applyInPandas(linked, "a long, b long")


def _audit(nodes: DataFrame, components: DataFrame, size: int) -> float:
    """Share of the links of `size` sampled nodes, found by comparing them with all, that lie within a component."""
    sample = nodes.orderBy(F.xxhash64("least", "node")).limit(size).select("node", "site", "v").toPandas()  # bounded
    if sample.empty:
        return 1.0
    ids = sample["node"].to_numpy()
    by_site = {s: (np.flatnonzero(sample["site"] == s), np.stack([np.frombuffer(v, "<f8") for v in sample["v"][sample["site"] == s]])) for s in sample["site"].unique()}

    def compared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            frame = batch.to_pandas()
            out = []
            for site, own in frame.groupby("site"):
                if site in by_site:
                    at, x = by_site[site]
                    near = _cosines(x, np.frombuffer(b"".join(own["v"]), "<f8").reshape(len(own), -1)) >= THRESHOLD
                    i, j = np.nonzero(near)
                    out.append((ids[at][i], own["node"].to_numpy()[j]))
            u, v = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, "i8"), np.zeros(0, "i8"))
            yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], ["u", "v"])

    true = nodes.select("node", "site", "v").mapInArrow(compared, "u long, v long")
    one = components.select(F.col("node").alias("u"), F.col("component").alias("cu"))
    two = components.select(F.col("node").alias("v"), F.col("component").alias("cv"))
    row = true.join(one, "u", "left").join(two, "v", "left").agg(F.count(F.lit(1)).alias("n"), F.sum((F.coalesce(F.col("cu") == F.col("cv"), F.lit(False))).cast("int")).alias("found")).first()
    return row["found"] / row["n"] if row["n"] else 1.0


def near_duplicates(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", k: int = K) -> DataFrame:
    """One row per vector: key, n_links, component_id (smallest key reachable by links), kept, and the audited recall."""
    scratch = Scratch(vectors.sparkSession, "nn-descent")

    def packed(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in it:
            yield pd.Series([None if x is None else np.array(x, dtype="<f8").tobytes() for x in batch], dtype=object)

    packed.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    doubles = F.col(vector).cast("array<double>")
    good = usable(doubles) & F.exists(doubles, lambda x: x != 0) & F.col(label).isNotNull() & F.col(key).isNotNull()
    rows = vectors.select(
        F.col(key).alias("id"),
        F.when(good, F.concat_ws("\0", F.size(doubles).cast("string"), F.col(label).cast("string"))).alias("site"),
        F.pandas_udf(packed, "binary")(F.when(good, doubles)).alias("v"),
    )
    rows = scratch.save(rows)
    nodes = _nodes(scratch, rows.where("site IS NOT NULL"))
    n = nodes.count()
    lists, components, recall = None, None, 0.0
    for attempt in range(AGAIN + 1):
        seeds = range(attempt * PROJECTIONS + 1, (attempt + 1) * PROJECTIONS + 1)
        found = [_window_edges(nodes, seed, k).withColumn("fresh", F.lit(1)) for seed in seeds]
        if lists is not None:
            found.append(lists)
        edges = found[0]
        for more in found[1:]:
            edges = edges.unionByName(more)
        old, lists = lists, scratch.save(_best(edges, k))
        scratch.drop(old)
        for _ in range(ROUNDS):
            proposed = _descend(nodes, lists, k).withColumn("fresh", F.lit(1))
            old, lists = lists, scratch.save(_best(lists.withColumn("fresh", F.lit(0)).unionByName(proposed), k))
            scratch.drop(old)
            if lists.where("fresh = 1").count() <= SETTLED * n * k:
                break
        close = lists.where(f"s >= {THRESHOLD - MARGIN}").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        links = _confirmed(nodes, close).toDF("a", "b")
        components = scratch.save(connected_components(scratch, links))
        across = scratch.save(_dense_links(scratch, nodes, lists, components))
        if across.limit(1).count():
            components = scratch.save(connected_components(scratch, across.union(components.toDF("a", "b"))))
        recall = _audit(nodes, components, AUDIT)
        if recall >= RECALL:
            break
        k *= 2
    else:
        raise RuntimeError(f"the neighbour graph has a recall of {recall:.3f}, which is less than {RECALL}")
    links = _counts(scratch, nodes, components)
    least = components.join(nodes.select("node", F.col("least").alias("l")), "node").groupBy("component").agg(F.min("l").alias("component_id"))
    stats = nodes.join(components, "node", "left").join(least, "component", "left").join(links, "node", "left")
    stats = stats.select(F.col("site").alias("s"), F.col("v").alias("w"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component"))
    joined = rows.join(stats, (F.col("site") == F.col("s")) & (F.col("v") == F.col("w")), "left")
    component = F.coalesce("component", "id")
    return joined.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"), F.lit(recall).alias("audited_recall"))


def op5_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return near_duplicates(vectors).select("vec_id", "n_links", "component_id", "kept")


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT a AS vec_id, b AS reached FROM l UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.reached = l.a
), c AS (SELECT vec_id, min(reached) AS least FROM r GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(c.least, e.vec_id)) AS component_id,
  e.vec_id <= coalesce(c.least, e.vec_id) AS kept
FROM embeddings e LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
