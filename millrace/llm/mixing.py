"""Mixing sources to target weights by Pfair scheduling.

Time is cut into slots of one block of documents each.  Block j of a source
with weight w (an exact fraction; weights add up to one) is released at
floor(j / w) and due at ceil((j + 1) / w); in each slot the released block with
the earliest deadline goes.  Every block meets its window, so after any number
of slots a source is less than one block away from its target weight.

Spans of slots are scheduled by tasks of their own.  A task starts its span with
every block done that must be by then, and as many of the blocks under way as
make up the time, earliest deadlines first: from there earliest-deadline-first
meets every window.  It goes on past its end, beside what the next span starts
with, until both have the same blocks done; from that slot on they are one
schedule.  A slot is taken from the earliest span that reaches it, so the spans
together are one schedule that meets all windows, however long it is.

A task holds the sources' weights and its span.  Documents get ranks in their
source; source, rank and the slot's block meet by a join of narrow rows.  The
mix is as long as it takes for each source to be gone through once; sources
that end sooner start over.

Defined results: rows with a null source form a source of their own; sources
that weights do not name, or with weight 0, are left out by request only
(`strict=False`), else refused; repeated rows are mixed each; ties of order go by the listed
columns; an empty table gives no rows; other columns stay, and clashing names keep theirs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ranked, small_table, unused_name

BLOCK = 8
#: Slots of a span, or four for each source if that is more.
SPAN = 1 << 14
#: A source's target weight is its size to this power: large sources a little less, small ones a little more.
TEMPERING = 0.9


def tempered(sizes: dict[str | None, int], power: float = TEMPERING) -> dict[str | None, float]:
    return {s: n**power for s, n in sizes.items()}


def whole(weights: list[float | Fraction]) -> list[int]:
    """Integers in exactly the ratio of the weights."""
    exact = [Fraction(w) for w in weights]
    scale = lcm(*[x.denominator for x in exact])
    return [int(x * scale) for x in exact]


class Trajectory:
    """Earliest-deadline-first from slot `start` on, over weights that are shares of their sum."""

    def __init__(self, shares: list[int], start: int):
        self.shares, self.total, self.slot = shares, sum(shares), start
        self.done = [start * w // self.total for w in shares]
        under_way = [(self.deadline(s), s) for s, w in enumerate(shares) if start * w % self.total]
        for _, s in heapq.nsmallest(start - sum(self.done), under_way):
            self.done[s] += 1
        self.waiting = [(self.release(s), s) for s in range(len(shares))]
        heapq.heapify(self.waiting)
        self.ready: list[tuple[int, int]] = []

    def release(self, s: int) -> int:
        return self.done[s] * self.total // self.shares[s]

    def deadline(self, s: int) -> int:
        return -(-(self.done[s] + 1) * self.total // self.shares[s])

    def step(self) -> tuple[int, int, int, int, int]:
        """(source, block, slot, release, deadline) of the next slot."""
        while self.waiting and self.waiting[0][0] <= self.slot:
            s = heapq.heappop(self.waiting)[1]
            heapq.heappush(self.ready, (self.deadline(s), s))
        due, s = heapq.heappop(self.ready)
        out = (s, self.done[s], self.slot, self.release(s), due)
        self.done[s] += 1
        self.slot += 1
        heapq.heappush(self.waiting, (self.release(s), s))
        return out


def span_schedule(shares: list[int], start: int, end: int, slots: int) -> Iterator[tuple[int, int, int, int, int]]:
    """The span's schedule from start to end, and on until it is the next span's, at most to `slots`."""
    own = Trajectory(shares, start)
    while own.slot < min(end, slots):
        yield own.step()
    if own.slot >= slots:
        return
    following = Trajectory(shares, end)
    apart = {s for s, (a, b) in enumerate(zip(own.done, following.done)) if a != b}
    while apart and own.slot < slots:
        one, two = own.step(), following.step()
        yield one
        for s in (one[0], two[0]):
            (apart.discard if own.done[s] == following.done[s] else apart.add)(s)


def schedule(spark, shares: list[int], slots: int, span: int = SPAN) -> DataFrame:
    """(number, source, block, slot, release, deadline) of every slot below `slots`; spans may hold a slot several times, the least number counts."""
    span = max(span, 4 * len(shares))

    def scheduled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["number", "source", "block", "slot", "release", "deadline"]
        for batch in it:
            for number in batch.column(0).to_pylist():
                rows = span_schedule(shares, number * span, (number + 1) * span, slots)
                while piece := [(number, *row) for _, row in zip(range(10_000), rows)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*piece)], names)

    spans = -(-slots // span)
    return spark.range(0, spans, 1, spans).mapInArrow(scheduled, "number long, source long, block long, slot long, release long, deadline long")


def mix(docs: DataFrame, source: str = "source", order: tuple[str, ...] = ("doc_id",), weights: dict[str | None, float | Fraction] | None = None, block: int = BLOCK, strict: bool = True, ordered: bool = False, span: int = SPAN) -> DataFrame:
    """docs, repeated as the weights ask for, with slot, position, epoch, release and deadline.

    A source's documents are dealt in the given order, block after block; after
    its last document it starts over as the next epoch.  position numbers all
    rows from 0 without gaps.  Without weights the sources' sizes are tempered.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    row = unused_name(docs, "_mixed_row")
    kept = scratch.save(docs.withColumn(row, F.monotonically_increasing_id()))
    narrow = kept.select(F.col(row).alias("row"), F.col(source).cast("string").alias("name"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    sizes = {r["name"]: r["n"] for r in narrow.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy("name").collect()}  # a row a source
    weights = weights if weights is not None else tempered(sizes)
    if strict and (missing := [s for s in sizes if not weights.get(s)]):
        raise ValueError(f"no weight for sources {missing[:10]}")
    names = [s for s in sizes if weights.get(s)]
    added = [unused_name(docs, n) for n in ("slot", "position", "epoch", "release", "deadline")]
    if not names:
        return docs.limit(0).select("*", *[F.lit(0).cast("long").alias(n) for n in added])
    shares = whole([weights[s] for s in names])
    slots = max(-(--(-sizes[s] // block) * sum(shares) // w) for s, w in zip(names, shares))
    sources = small_table(spark, {"name_": pa.string(), "source": pa.int64(), "size": pa.int64()}, [(s, i, sizes[s]) for i, s in enumerate(names)])
    ranks = ranked(scratch, narrow, ["name"], [f"o{i}" for i in range(len(order))], "rank").select("row", "name", "rank")
    ranks = ranks.join(sources, F.col("name").eqNullSafe(F.col("name_"))).select("row", F.col("source").alias("of"), "rank")
    turns = scratch.save(schedule(spark, shares, slots, span))
    turns = turns.groupBy("slot").agg(F.min_by(F.struct("source", "block", "release", "deadline"), "number").alias("turn")).select("slot", "turn.*")
    dealt = turns.join(sources.select(F.col("source").alias("source_"), "size"), F.col("source") == F.col("source_"))
    dealt = dealt.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).withColumn("at", F.col("block") * block + F.col("place"))
    dealt = dealt.select("source", (F.col("at") % F.col("size")).alias("nth"), "slot", (F.col("slot") * block + F.col("place")).alias("position"), F.floor(F.col("at") / F.col("size")).alias("epoch"), "release", "deadline")
    dealt = dealt.join(ranks, (F.col("source") == F.col("of")) & (F.col("nth") == F.col("rank")))
    dealt = dealt.select(F.col("row").alias("row_"), *[F.col(n).cast("long").alias(n) for n in ("slot", "position", "epoch", "release", "deadline")])
    out = kept.select(F.col(row).alias("row"), F.struct(*docs.columns).alias("doc")).join(dealt, F.col("row") == F.col("row_"))
    out = out.select("doc.*", *[F.col(n).alias(a) for n, a in zip(("slot", "position", "epoch", "release", "deadline"), added)])
    return out.sort(added[1]) if ordered else out


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"))
