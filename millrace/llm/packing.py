"""Packing of tokenised documents into sequences of a fixed capacity by best fit, longest pieces first.

`pack_by_size`, for capacities of which the driver can hold a histogram, is exact best-fit decreasing.
Which gap a piece gets depends on sizes alone, and pieces of a size are alike.  So the pieces are
range-sorted and numbered, the driver runs best fit over the counts of sizes, on runs of sequences with equal
gaps, and tasks look up each piece's run by its number.  A plan has some thousand rows, however many pieces there
are: a size cuts two runs at most, and a sequence of 1024 holds 44 different sizes at most.

`pack` is for any capacity, in supersteps.  Pieces longer than half the capacity open a sequence each.  The others are
placed in supersteps, longest lengths first, a class of lengths (the next half)
at a time.  In a superstep the open sequences' gaps and the class's pieces are
range-sorted together by falling size; a sweep down each range hands every piece
its successor, the smallest gap still free that holds it.  Pieces that want the
same gap are served by rank, longest first; those that find none in their range
are matched, by rank again, with gaps that the ranges of larger sizes have left.
Gaps are updated and the next superstep goes on; when too few pieces found a gap,
as many sequences are opened as the class's tokens fill at least.  A gap that
holds several pieces of the class for certain takes part as so many slots.

The driver sees histograms of sizes (at most `capacity` numbers) and two counts
a range in a superstep.  A sweep's task holds one range of the sort, whose ties are cut by row,
so that no size is hot.

Defined results: null text is an empty document of one end token; null doc_ids
and repeated rows are packed each; ties of length go by doc_id, start and row;
an empty table gives no rows; an input column is kept unless this operator makes one
of that name.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter
from typing import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ONE_TASK, Scratch, few, small_parts, small_table, text_batches

CAPACITY, END = 1024, 2
VOCABULARY = "byte_bpe_50k.json"
#: The largest capacity that is packed by size.
MOST_SIZES = 1 << 14
#: Classes end at lengths of this size, below which all go together.
SMALLEST_CLASS = 16
#: Sequences are opened when a sweep places at most this share of its pieces; the next class joins when at most that share is left.
FEW_PLACED, FEW_LEFT = 0.3, 0.2
#: A rest of at most this share of all pieces gets enough new sequences at once.
TAIL = 0.0005


def tokenised_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids) of every document: its ids and the end id, cut into full pieces
    only if longer than the capacity, with the first piece the shorter one.  ids: little-endian unsigned 32-bit."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .byte_words import word_encoder

        encoder, last = word_encoder(vocabulary), np.array([end], dtype="<u4").tobytes()
        for batch in it:
            rows, pieces, starts, lengths, ids = [], [], [], [], []
            for row, data in enumerate(encoder.encode_all(t.as_py() for t in batch.column(1))):
                data += last
                n = len(data) // 4
                first = n % capacity or min(n, capacity)
                for piece, start in enumerate([0, *range(first, n, capacity)]):
                    stop = first if piece == 0 else start + capacity
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(start)
                    lengths.append(stop - start)
                    ids.append(data[4 * start : 4 * stop])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())], ["k", "piece", "start", "length", "ids"])

    text_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(batches, f"k {kind}, piece int, start long, length long, ids binary")
    return rows.withColumnRenamed("k", key)


def sweep(sizes: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """The mate of each row of a range: sizes fall, gaps come before pieces of their size, `pieces` says which is which.

    Walking down, a piece takes the gap passed last that is still free: the
    smallest that holds it.  Gaps and pieces without a mate get -1.
    """
    depth = np.cumsum(np.where(pieces, -1, 1)) + pieces
    order = np.argsort(depth, kind="stable")
    first, second = order[:-1], order[1:]
    met = (depth[first] == depth[second]) & ~pieces[first] & pieces[second]
    mate = np.full(len(sizes), -1)
    mate[first[met]], mate[second[met]] = second[met], first[met]
    return mate


def carried(left: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Which gaps of earlier ranges the pieces left in a range get: (range of pieces, first rank, end, range of gaps, rank of the first piece's gap);
    further pieces take the gaps before it.  left: pieces and gaps that each range has left."""
    free: list[list[int]] = []
    out = []
    for part in sorted(left):
        pieces, gaps = left[part]
        at = 0
        while at < pieces and free:
            source, n = free[-1]
            used = min(n, pieces - at)
            out.append((part, at, at + used, source, n - 1))
            at += used
            free[-1][1] -= used
            if not free[-1][1]:
                free.pop()
        if gaps:
            free.append([part, gaps])
    return out


_SWEPT = "part int, piece boolean, id long, size int, mate long, mate_size int, rank int"


def _swept(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweeps a range of the sorted gaps and pieces: a row for each piece or gap without a mate, and for each pair."""
    batches = list(it)
    none = (np.zeros(0, "i4"), np.zeros(0, bool), np.zeros(0, "i8"))
    sizes, pieces, ids = (np.concatenate([x, *(b.column(i).to_numpy(zero_copy_only=False) for b in batches)]) for i, x in enumerate(none))
    mate = sweep(sizes, pieces)
    shown = np.flatnonzero(pieces | (mate < 0))
    alone = mate[shown] < 0
    rank = np.where(pieces[shown], np.cumsum(pieces[shown] & alone), np.cumsum(~pieces[shown] & alone)) - 1
    other = [pa.array(x[np.maximum(mate[shown], 0)], mask=alone) for x in (ids, sizes)] if len(shown) else [pa.array([], pa.int64()), pa.array([], pa.int32())]
    part = np.full(len(shown), TaskContext.get().partitionId(), dtype="i4")
    out = [pa.array(part), pa.array(pieces[shown]), pa.array(ids[shown]), pa.array(sizes[shown]), *other, pa.array(rank.astype("i4"))]
    yield pa.RecordBatch.from_arrays(out, ["part", "piece", "id", "size", "mate", "mate_size", "rank"])


_PLAN = dict.fromkeys(("p", "from", "to", "source", "top"), pa.int32())


def _superstep(scratch: Scratch, gaps: DataFrame, pieces: DataFrame, shortest: int, longest: int, most: int, rows: int, range_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed, waiting, gaps): pieces (id, size) that got a gap (sequence_id), those that got none, and the gaps (sequence_id, free) left, yet to be grouped.
    A gap takes part with at most `most` slots; rows: how many slots and pieces there are at most."""
    spark = gaps.sparkSession
    slots = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.col("free") / longest).cast("int")))
    each = F.floor(F.col("free") / F.col("slots")).cast("int")
    split = gaps.where(F.col("free") >= shortest).withColumn("slots", slots).withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("slots"))))
    size = F.when(F.col("slot") < F.col("slots"), each).otherwise(F.col("free") - each * (F.col("slots") - 1))
    both = split.select(size.alias("size"), F.lit(False).alias("piece"), F.col("sequence_id").alias("id")).union(pieces.select("size", F.lit(True), "id"))
    order = [F.col("size").desc(), F.col("piece"), F.col("id")]
    both = both.coalesce(1) if rows <= range_rows else both.repartitionByRange(*order)
    swept = scratch.save(both.sortWithinPartitions(*order).mapInArrow(_swept, _SWEPT))
    met, alone = swept.where("mate IS NOT NULL").select("id", "size", "mate", "mate_size"), swept.where("mate IS NULL")
    if rows <= range_rows:
        late = alone.select(F.when(F.col("piece"), F.col("id")).alias("id"), F.when(F.col("piece"), F.col("size")).alias("size"), F.when(~F.col("piece"), F.col("id")).alias("mate"), F.when(~F.col("piece"), F.col("size")).alias("mate_size"))
    else:
        counts = alone.groupBy("part").agg(F.count_if("piece").alias("p"), F.count_if(~F.col("piece")).alias("g")).collect()  # a row a range
        plan = F.broadcast(small_table(spark, _PLAN, carried({r["part"]: (r["p"], r["g"]) for r in counts})))
        wanting = alone.where("piece").join(plan, (F.col("part") == F.col("p")) & (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to")), "left")
        wanting = wanting.select("id", "size", "source", (F.col("top") - (F.col("rank") - F.col("from"))).alias("at"))
        free = alone.where("NOT piece").select(F.col("id").alias("mate"), F.col("size").alias("mate_size"), "part", "rank")
        # every planned piece has its gap; those without a plan stay out of the join, where they would all have one key
        met_late = free.join(wanting.where("source IS NOT NULL"), (F.col("source") == F.col("part")) & (F.col("at") == F.col("rank")), "left").select("id", "size", "mate", "mate_size")
        none = wanting.where("source IS NULL").select("id", "size", F.lit(None).cast("long").alias("mate"), F.lit(None).cast("int").alias("mate_size"))
        late = scratch.save(met_late.union(none))
    met = met.union(late)
    placed = met.where("id IS NOT NULL AND mate IS NOT NULL").select("id", "size", F.col("mate").alias("sequence_id"))
    waiting = late.where("mate IS NULL").select("id", "size")
    rests = met.where("mate IS NOT NULL").select(F.col("mate").alias("sequence_id"), (F.col("mate_size") - F.coalesce("size", F.lit(0))).alias("free"))
    return placed, waiting, rests.union(gaps.where(F.col("free") < shortest).select("sequence_id", "free"))


def _histogram(sizes: DataFrame) -> Counter:
    return Counter({r["size"]: r["n"] for r in sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()})  # capacity rows at most


def _sorted(scratch: Scratch, pieces: DataFrame, length: str, order: tuple[str, ...]) -> DataFrame:
    """(size, row, id) of the pieces, longest first, in ranges; id is monotonically_increasing_id."""
    spark = pieces.sparkSession
    kept = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    rows = pieces.select(F.col(length).cast("int").alias("size"), F.struct(*kept).alias("row")).select("size", "row", *[F.col("row")[c].alias(f"o{i}") for i, c in enumerate(order)])
    drafted = scratch.save(rows)  # a range sort reads its input twice
    by = [F.col("size").desc(), *[F.col(f"o{i}") for i in range(len(order))]]
    rows = drafted.repartitionByRange(small_parts(spark), *by).sortWithinPartitions(*by)
    rows = scratch.save(rows.select("size", "row", F.monotonically_increasing_id().alias("id")))
    scratch.drop(drafted)
    return rows


def _check(counts: Counter, capacity: int) -> None:
    if counts and not (None not in counts and 1 <= min(counts) <= max(counts) <= capacity):
        raise ValueError(f"piece lengths must be from 1 to {capacity}")


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """The plan of best-fit decreasing for so many pieces of each size, numbered from 0, longest first:
    (number of the first piece, size, pieces a sequence, first sequence, offset) of pieces that go to neighbouring
    sequences of one gap, up to the next row's first."""
    runs: dict[int, list[tuple[int, int]]] = {}  # by gap: (first sequence, sequences)
    gaps: list[int] = []  # those of runs, rising
    plan, at, opened = [], 0, 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                runs[gap] = []
                insort(gaps, gap)
            runs[gap].append((first, n))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            i = bisect_left(gaps, size)
            if i == len(gaps):
                new = -(-left // (capacity // size))
                put(capacity, opened, new)
                opened += new
            gap = gaps[i]
            first, n = runs[gap].pop()
            if not runs[gap]:
                del runs[gap], gaps[i]
            each = gap // size
            full = min(n, left // each)
            some = left - full * each if full < n else 0
            placed = full * each + some
            plan.append((at, size, each, first, capacity - gap))
            put(gap - each * size, first, full)
            put(gap - some * size, first + full, 1 if some else 0)
            used = full + (1 if some else 0)
            put(gap, first + used, n - used)
            at, left = at + placed, left - placed
    return plan


def pack_by_size(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", order: tuple[str, ...] = ()) -> DataFrame:
    """As `pack`, by exact best-fit decreasing over the counts of sizes; capacity: MOST_SIZES at most."""
    if capacity > MOST_SIZES:
        raise ValueError(f"a capacity beyond {MOST_SIZES} is for pack()")
    rows = _sorted(Scratch(pieces.sparkSession, "packing"), pieces, length, order)
    counts: Counter = Counter()
    parts: Counter = Counter()
    # sorted rows: sizes and partitions, at most, in sum
    for r in rows.groupBy("size", F.shiftright("id", 33).cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["size"]] += r["n"]
        parts[r["part"]] += r["n"]
    _check(counts, capacity)
    before = np.cumsum([0, *(parts[i] for i in range(max(parts, default=0)))])
    plan = np.array(best_fit(counts, capacity), dtype=np.int64).reshape(-1, 5)

    def places(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = batch.column(1).to_numpy()
            number = before[ids >> 33] + (ids & ((1 << 33) - 1))
            first, size, each, sequence, offset = plan[np.searchsorted(plan[:, 0], number, side="right") - 1].T
            turn, place = np.divmod(number - first, each)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sequence + turn), pa.array(offset + size * place)], ["row", "sequence_id", "offset"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.select("row", "id").mapInArrow(places, f"row {kind}, sequence_id long, offset long").select("row.*", "sequence_id", "offset")


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", order: tuple[str, ...] = (), range_rows: int = ONE_TASK, steps: list | None = None) -> DataFrame:
    """pieces with sequence_id and offset: each piece (1 <= length <= capacity) in one sequence, gapless from offset 0; in supersteps.

    A superstep of at most `range_rows` rows is one range.  A list given as `steps` gets (pieces, gaps, pieces placed) of each superstep.
    """
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    rows = _sorted(scratch, pieces, length, order)
    waiting_for = _histogram(rows)
    _check(waiting_for, capacity)
    total, low = sum(waiting_for.values()), capacity // 2
    narrow = rows.select("id", "size")
    own = narrow.where(F.col("size") > low)
    placed = [own.select("id", "size", (F.col("id") * 2).alias("sequence_id"))]  # even numbers: opened by a piece; odd ones: opened for a class
    gaps = own.where(F.col("size") < capacity).select((F.col("id") * 2).alias("sequence_id"), (capacity - F.col("size")).alias("free"))
    free = Counter({capacity - n: count for n, count in waiting_for.items() if low < n < capacity})
    ahead = Counter({n: count for n, count in waiting_for.items() if n <= low})
    late, late_rows, opened, must_open, high = Counter(), None, 0, False, low
    while ahead or late:
        taken = Counter({n: count for n, count in ahead.items() if n > low}) + late
        if not taken:
            low = math.floor(min(low, max(ahead)) / 2)
            low = low if low >= SMALLEST_CLASS else 0
            continue
        shortest, longest, count = min(taken), max(taken), sum(taken.values())
        open_gaps = sum(n for size, n in free.items() if size >= shortest)
        if must_open or not open_gaps:
            new = -(-sum(n * c for n, c in taken.items()) // capacity)
            if count <= TAIL * total:
                new = -(-count // (capacity // longest))
            gaps = gaps.union(spark.range(opened, opened + new).select((F.col("id") * 2 + 1).alias("sequence_id"), F.lit(capacity).alias("free")))
            opened, open_gaps = opened + new, open_gaps + new
        now = narrow.where((F.col("size") > low) & (F.col("size") <= high))
        now = now.union(late_rows) if late_rows is not None else now
        most = -(-4 * count // open_gaps)
        done, late_rows, rests = _superstep(scratch, gaps, now, shortest, longest, most, count + most * open_gaps, range_rows)
        placed.append(done)
        every = sum(free.values()) + opened
        gaps = scratch.save(few(rests, every * most).groupBy("sequence_id").agg(F.sum("free").cast("int").alias("free")).where("free > 0"))
        ahead, high = Counter({n: c for n, c in ahead.items() if n <= low}), low
        state = late_rows.select(F.lit(True).alias("piece"), "size").union(gaps.select(F.lit(False), F.col("free")))
        late, free = Counter(), Counter()
        for r in few(state, count + every).groupBy("piece", "size").agg(F.count(F.lit(1)).alias("n")).collect():  # twice the capacity at most
            (late if r["piece"] else free)[r["size"]] = r["n"]
        still = sum(late.values())
        if steps is not None:
            steps.append((count, open_gaps, count - still))
        must_open = still > 0 and count - still <= FEW_PLACED * count
        if still <= FEW_LEFT * count and low and not must_open:
            low = low // 2 if low // 2 >= SMALLEST_CLASS else 0
    found = placed[0]
    for more in placed[1:]:
        found = found.union(more)
    # a sequence has at most `capacity` pieces
    before = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "id").rowsBetween(Window.unboundedPreceding, -1)
    found = found.select(F.col("id").alias("of"), "sequence_id", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("offset"))
    return rows.join(found, F.col("id") == F.col("of")).select("row.*", "sequence_id", "offset")


def packed_sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """(sequence_id, length, ids) of each packed sequence, its pieces put together by offset; a sequence is bounded by the capacity."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", F.col(ids).alias("ids")))), lambda x: F.hex(x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.unhex(F.array_join(parts, "")).alias("ids"))


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """The packing of documents with production parameters, each piece's ids given by their crc32."""
    pieces = tokenised_pieces(docs, public_tokenizers.path(VOCABULARY))
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack_by_size(pieces, order=("doc_id", "piece", "ids_crc32"))
