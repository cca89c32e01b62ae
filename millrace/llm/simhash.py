"""Near-duplicates by SimHash fingerprints and a vantage-point tree.

Fingerprints of all documents are reduced to the distinct ones and sent down a
vantage-point tree: at each node a fingerprint goes inside or outside by its
Hamming distance to the node's vantage point.  By the triangle bound two
fingerprints at most `radius` bits apart differ by at most `radius` in that
distance, so it is enough that the two sides overlap in a band of `radius`
distances: whoever lies in the band goes to both.  Every pair to be linked then
meets in at least one shard (leaf), and each shard is split on by the same rule
until its parts are small enough to compare directly.  A shard emits a
spanning forest, never all pairs of a group.

Defined results: null text is an empty text and has fingerprint zero, which
links like any other; a null doc_id keeps its row; repeated rows keep each
their row; other columns, whatever their names, are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import functools
import math
import typing
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, among, connected_components, text_batches, unused_name

SEED = 42
#: Fingerprints that a shard holds on average, and the most shards the driver's tree has.
SHARD, MOST_SHARDS = 4096, 65536
#: Fingerprints sampled for each shard to choose vantage points; the sample is MOST_SHARDS * PER_SHARD * 8 bytes at most.
PER_SHARD = 16
#: Parts of a shard up to this size are compared directly.
DIRECT = 192
#: Direct links of a fingerprint to earlier ones of its part, besides the one it was reached by.
CLOSEST = 4
_PIECE = 1 << 16
#: Texts sampled to learn which shingles are common, and the most of those that are remembered: both set the order of
#: shingles only, under every order the same pairs are found.
COMMON_FROM, MOST_COMMON = 8192, 200_000
#: Texts of a shingle's group that are compared with as many others in one task.
GROUP = 256
#: Candidate pairs that are confirmed at once, without rounds.
FEW_PAIRS = 1 << 16
#: Bits of a sketch of all shingles of a text: each toggles one.
SKETCH = 1024
#: Bits of a folded sketch: the parities of every FOLDED-th bit.
FOLDED = 256


def _shingle_hashes(text: bytes | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles, piece by piece: A-Z lower-cased, words between ASCII white space."""
    words = text.lower().split() if text else []
    if not words:
        return
    shingles = map(b" ".join, zip(*[words[i:] for i in range(width)])) if len(words) >= width else iter([b" ".join(words)])
    one = xxhash.xxh64_intdigest
    while piece := [one(s, SEED) for s in islice(shingles, _PIECE)]:
        yield np.array(piece, dtype="<u8")


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """Second, independent hashes made from the first (splitmix64)."""
    z = hashes + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _majorities(text: bytes | None, width: int, more: int = 0) -> list[int]:
    """The text's fingerprint, and `more` further ones of independent hashes; zero without words."""
    n, ones = 0, np.zeros((1 + more, 64), dtype=np.int64)
    for hashes in _shingle_hashes(text, width):
        n += len(hashes)
        for i in range(1 + more):
            hashes = _mixed(hashes) if i else hashes
            ones[i] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n, axis=1, bitorder="little").view("<u8").ravel().tolist()


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text over its shingles of `width` words, repeats included."""
    return _majorities(text, width)[0]


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3) -> DataFrame:
    """(key, fp) of every row; fp is the fingerprint's bits as a signed long."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], dtype="<u8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view("<i8"))], ["id", "fp"])

    text_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("t")).mapInArrow(batches, f"id {kind}, fp long").toDF(key, "fp")


class VantageTree:
    """Nodes as arrays: a node's vantage point, its median distance, its children; a leaf has a shard number."""

    def __init__(self, sample: np.ndarray, shards: int, radius: int):
        self.radius = radius
        self.vantage, self.middle, self.inside, self.outside, self.leaf = [], [], [], [], []
        self.shards = 0
        self._grow(np.unique(sample), shards)
        for name, kind in (("vantage", np.uint64), ("middle", np.int64), ("inside", np.int64), ("outside", np.int64), ("leaf", np.int64)):
            setattr(self, name, np.array(getattr(self, name), dtype=kind))

    def _grow(self, sample: np.ndarray, shards: int) -> int:
        at = len(self.leaf)
        for column, value in ((self.vantage, 0), (self.middle, 0), (self.inside, -1), (self.outside, -1), (self.leaf, -1)):
            column.append(value)
        cut = best_cut(sample, self.radius) if shards > 1 else None
        if cut is None:
            self.leaf[at] = self.shards
            self.shards += 1
            return at
        self.vantage[at], self.middle[at] = int(cut[0]), cut[1]
        self.inside[at] = self._grow(sample[cut[2]], (shards + 1) // 2)
        self.outside[at] = self._grow(sample[cut[3]], shards // 2)
        return at

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in fps and the shards they go to, the shards at whose boundary they lie included."""
        rows, nodes = np.arange(len(fps)), np.zeros(len(fps), dtype=np.int64)
        out_rows, out_leaves = [], []
        while len(rows):
            done = self.leaf[nodes] >= 0
            out_rows.append(rows[done])
            out_leaves.append(self.leaf[nodes[done]])
            rows, nodes = rows[~done], nodes[~done]
            d = np.bitwise_count(fps[rows] ^ self.vantage[nodes]).astype(np.int64)
            inside, outside = d <= self.middle[nodes] + self.radius - 1, d >= self.middle[nodes]
            rows, nodes = np.concatenate([rows[inside], rows[outside]]), np.concatenate([self.inside[nodes[inside]], self.outside[nodes[outside]]])
        return np.concatenate(out_rows), np.concatenate(out_leaves)


def best_cut(fps: np.ndarray, radius: int) -> tuple | None:
    """A vantage point, its middle distance and the two overlapping sides; None if none of some tried cuts well."""
    best, size = None, 0.9 * len(fps)
    if len(fps) < 4:
        return None
    for i in (0, len(fps) // 2, len(fps) // 3):
        d = np.bitwise_count(fps ^ fps[i]).astype(np.int64)
        middle = int(np.median(d))
        for m in (middle, middle - 1):
            inside, outside = d <= m + radius - 1, d >= m
            if (larger := max(inside.sum(), outside.sum())) < size:
                best, size = (fps[i], m, inside, outside), larger
        if size < 0.65 * len(fps):
            break
    return best


def forest(fps: np.ndarray, radius: int, direct: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (a, b) that connect the distinct fps as all pairs within the radius would.

    If `direct`, only pairs within the radius are links: how a breadth-first
    visit reached each, and its few closest earlier neighbours.
    """
    if len(fps) < 2:
        return []
    if len(fps) > DIRECT and (cut := best_cut(fps, radius)) is not None:
        return forest(fps[cut[2]], radius, direct) + forest(fps[cut[3]], radius, direct)
    if len(fps) <= DIRECT:
        apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
        near = apart <= radius
        if near.sum() == len(fps):
            return []
        if direct:
            return _direct(fps, near, apart)
        labels = np.arange(len(fps))
        while True:
            lower = np.where(near, labels[None, :], len(fps)).min(axis=1)
            if (lower == labels).all():
                break
            labels = lower
    else:  # a dense group that no vantage point divides: visit it breadth first
        labels, rest = np.full(len(fps), -1), np.arange(len(fps))
        while len(rest):
            root, queue = rest[0], [rest[0]]
            labels[root], rest = root, rest[1:]
            while queue and len(rest):
                at = queue.pop()
                hit = np.bitwise_count(fps[rest] ^ fps[at]) <= radius
                labels[rest[hit]] = at if direct else root
                queue += rest[hit].tolist()
                rest = rest[~hit]
    linked = labels != np.arange(len(fps))
    return [(fps[linked], fps[labels[linked]])] if linked.any() else []


def _direct(fps: np.ndarray, near: np.ndarray, apart: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    some = np.flatnonzero(near.sum(axis=1) > 1)
    fps, near, apart = fps[some], near[np.ix_(some, some)], apart[np.ix_(some, some)]
    n = len(fps)
    earlier = np.where(np.tril(near, -1), apart, 255)
    few = np.argsort(earlier, axis=1, kind="stable")[:, :CLOSEST]
    i, j = np.nonzero(np.take_along_axis(earlier, few, axis=1) < 255)
    out, seen = [(fps[i], fps[few[i, j]])], np.zeros(n, dtype=bool)
    for root in range(n):
        queue = [] if seen[root] else [root]
        seen[root] = True
        while queue:
            at = queue.pop()
            hit = np.flatnonzero(near[at] & ~seen)
            seen[hit] = True
            queue += hit.tolist()
            if len(hit):
                out.append((fps[hit], np.full(len(hit), fps[at])))
    return out


def linked_prints(distinct: DataFrame, radius: int = 2, shard: int = SHARD, direct: bool = False) -> DataFrame:
    """Links (t, a, b) that connect the distinct fingerprints (columns t, fp) of each table t as all
    pairs at most `radius` bits apart would."""
    sizes = {r["t"]: r["n"] for r in distinct.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}  # a few tables
    shards = {t: min(MOST_SHARDS, max(1, -(-n // shard))) for t, n in sizes.items()}
    # a bounded sample chooses vantage points only; every fingerprint is routed and compared
    sample = distinct.select("t", "fp").orderBy(F.xxhash64("fp"), "t", "fp").limit(sum(shards.values()) * PER_SHARD if any(n > 1 for n in shards.values()) else 1).toPandas()
    trees = {t: VantageTree(sample["fp"][sample["t"] == t].to_numpy(dtype="i8").view("u8"), n, radius) for t, n in shards.items()}

    def route(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            tables = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False).astype("i8").view("u8")
            for t in np.unique(tables).tolist():
                own = fps[tables == t]
                rows, leaves = trees[t].route(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, dtype="i4")), pa.array(leaves), pa.array(own[rows].view("i8"))], ["t", "leaf", "fp"])

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        links = forest(group["fp"].to_numpy(dtype="i8").view("u8"), radius, direct)
        a, b = ([np.concatenate(x).view("i8") for x in zip(*links)]) if links else ([], [])
        return pd.DataFrame({"t": np.full(len(a), group["t"].iloc[0], dtype="i4"), "a": np.array(a, dtype="i8"), "b": np.array(b, dtype="i8")})

    routed = distinct.select("t", "fp").mapInArrow(route, "t int, leaf long, fp long")
    return routed.groupBy("t", "leaf").applyInPandas(compare, "t int, a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, radius: int = 2, shard: int = SHARD) -> DataFrame:
    """One row per document: key, fp (signed long), component_id (smallest key reachable by links of at most `radius` bits)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprints(docs, text, key, width))
    distinct = scratch.save(prints.groupBy(F.lit(0).alias("t"), "fp").agg(F.min(key).alias("least")))
    components = connected_components(scratch, linked_prints(distinct, radius, shard).select("a", "b"))
    roots = distinct.join(components, distinct.fp == components.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = scratch.save(roots)
    scratch.drop(distinct)
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(named, prints.fp == named._fp).select(key, "fp", "component_id")


def _words_hash(text: bytes | None) -> list[int]:
    """128 bits that tell sequences of words apart, as two numbers."""
    return list(divmod(xxhash.xxh3_128_intdigest(b" ".join((text or b"").lower().split()), SEED), 1 << 64))


def jaccard(a: bytes | None, b: bytes | None, width: int) -> float:
    """Share of two texts' distinct shingles that they have in common; texts without words are alike."""
    x, y = (set(zip(*[w[i:] for i in range(width)])) or {tuple(w)} for w in ((t or b"").lower().split() for t in (a, b)))
    return len(x & y) / len(x | y)


def _shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Hashes of a text's distinct shingles, ascending; those of `jaccard`, up to collisions of 64 bits."""
    words = (text or b"").lower().split()
    one = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([one(b" ".join(words), SEED)], dtype="u8")
    hashes = np.array([one(w, SEED) for w in words], dtype="u8")
    n = len(words) - width + 1
    out = hashes[:n]
    for i in range(1, width):
        out = _mixed(out) ^ hashes[i : n + i]
    return np.unique(_mixed(out))


def similar_candidates(scratch: Scratch, texts: DataFrame, parts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Pairs (u < v, with their components a and b and the shingles `shared` among those looked at) of parts' rows
    (r, c: a long, its component) of different components that hold all whose texts (r, t, binary) have a shingle Jaccard of at least `similarity`.

    Under a fixed order of all shingles, two such texts of m and n shingles
    share one among the first m - ceil(m * similarity) + 1 and n - ceil(n *
    similarity) + 1 of theirs.  Common shingles come last in the order.  Texts
    are grouped by each shingle; only groups of several components are compared,
    block of texts against block, by lengths and by what can still be shared
    behind the shingle.  Sketches of all shingles rule out most pairs that are not similar, and none that is, before any
    text is looked at: folded ones where two texts meet, so that no row is made of a pair that they rule out, whole ones after that.
    """

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(_shingle_set(t.as_py(), shingle).view("i8"))], ["s"])

    share = min(1.0, COMMON_FROM / max(1, parts.count()))
    sample = texts.where(F.pmod(F.xxhash64("r"), F.lit(1 << 32)) < int(share * (1 << 32))).select("t")
    common = sample.mapInArrow(counted, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    common = common.orderBy(F.desc("n"), "s").limit(MOST_COMMON).toPandas().sort_values("s")
    known, times = common["s"].to_numpy("i8"), common["n"].to_numpy("i8")

    def firsts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found, sizes, sketches = [], [], []
            for t in batch.column(1):
                own = _shingle_set(t.as_py(), shingle).view("i8")
                often = np.zeros(len(own), dtype="i8")
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    often = np.where(known[at] == own, times[at], 0)
                found.append(own[np.lexsort((own, often))[: len(own) - math.ceil(len(own) * similarity - 1e-9) + 1]])
                sizes.append(len(own))
                toggled = np.bincount(own.view("u8") % np.uint64(SKETCH), minlength=SKETCH) % 2
                sketches.append(np.packbits(toggled.astype(bool), bitorder="little").view("<i8"))
            ends = np.cumsum([0, *map(len, found)], dtype="i4")
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.array([], dtype="i8")])))
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype="i4") * (SKETCH // 64)), pa.array(np.concatenate([*sketches, np.array([], dtype="i8")])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), lists, bits], ["r", "n", "own", "sketch"])

    prefixes = texts.select(F.col("r").alias("_r"), "t").mapInArrow(firsts, "_r long, n int, own array<long>, sketch array<long>")
    listed = scratch.save(prefixes.join(parts, F.col("_r") == F.col("r")).select("r", "c", "n", "own", "sketch"))
    posted = listed.select(F.posexplode("own").alias("i", "s"), "r", "c", "n")
    groups = posted.groupBy("s").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("m")).where("low < high")
    groups = groups.select(F.col("s").alias("shared"), F.ceil(F.col("m") / GROUP).cast("int").alias("blocks"))
    words = [f"w{j}" for j in range(FOLDED // 64)]
    parity = lambda j: functools.reduce(Column.bitwiseXOR, [F.get("sketch", F.lit(k)) for k in range(j, SKETCH // 64, len(words))])
    folded = listed.select(F.col("r").alias("_r"), *[parity(j).alias(w) for j, w in enumerate(words)])
    several = posted.join(groups, F.col("s") == F.col("shared")).select("s", "r", "c", "n", "i", "blocks")
    several = scratch.save(several.join(folded, F.col("r") == F.col("_r")).drop("_r"))
    block = F.pmod(F.xxhash64("r"), F.col("blocks")).cast("int")
    one = several.select("s", block.alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"), *[F.col(x).alias(x + "1") for x in ("r", "c", "n", "i", *words)])
    two = several.select("s", block.alias("y"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"), *[F.col(x).alias(x + "2") for x in ("r", "c", "n", "i", *words)])
    long_enough = F.least("n1", "n2") >= F.greatest("n1", "n2") * similarity - 1e-6
    enough_left = F.least(F.col("n1") - F.col("i1"), F.col("n2") - F.col("i2")) >= (F.col("n1") + F.col("n2")) * (similarity / (1 + similarity)) - 1e-6
    # a shingle that only one text has toggles one bit, so the bits that differ are at most those shingles
    most_apart = lambda n, m: (F.col(n) + F.col(m)) * ((1 - similarity) / (1 + similarity)) + 1e-6
    unlike = sum(F.bit_count(F.col(w + "1").bitwiseXOR(F.col(w + "2"))) for w in words)
    found = one.join(two, ["s", "x", "y"]).where((F.col("r1") < F.col("r2")) & (F.col("c1") != F.col("c2")) & long_enough & enough_left & (unlike <= most_apart("n1", "n2")))
    found = found.select(F.col("r1").alias("u"), F.col("r2").alias("v"), F.col("c1").alias("a"), F.col("c2").alias("b"))
    found = found.groupBy("u", "v", "a", "b").agg(F.count(F.lit(1)).alias("shared"))
    for node, n, bits in (("u", "n1", "x"), ("v", "n2", "y")):
        found = found.join(listed.select(F.col("r").alias(node), F.col("n").alias(n), F.col("sketch").alias(bits)), node)
    differing = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda a, b: a + b)
    found = found.where(differing <= most_apart("n1", "n2"))
    found = scratch.save(found.select("u", "v", "a", "b", "shared"))
    scratch.drop(listed, several)
    return found


def linked_parts(scratch: Scratch, parts: DataFrame, pairs: DataFrame, links: Callable[[DataFrame], DataFrame], each: int = 1, most: int = 64) -> DataFrame:
    """parts (r, c: its component) after all of `pairs` (u, v, a, b: their components, shared) that `links` confirms; it
    returns (a, b) of those.

    Pairs go in rounds: of each component the likeliest first, four times as many in the next round, at last all.
    A pair whose ends have come together meanwhile says nothing new and is dropped, so a group of near copies costs
    a few pairs a text, not all of them; every other pair is looked at.
    """
    left = pairs.count()
    while left:
        chosen = pairs
        if each < most and left > FEW_PAIRS:
            likeliest = F.max(F.struct("shared", "u", "v")).alias("x")
            ends = pairs.withColumn("end", F.explode(F.array("a", "b")))
            best = ends.groupBy("end", F.pmod(F.xxhash64("u", "v"), F.lit(each))).agg(likeliest).select("x.u", "x.v").distinct()
            chosen = scratch.save(pairs.join(best, ["u", "v"]))
        found = connected_components(scratch, links(chosen))
        found = scratch.save(found)
        parts = scratch.save(parts.join(found, F.col("c") == F.col("node"), "left").select("r", F.coalesce("component", "c").alias("c")))
        if chosen is pairs:
            break
        rest = pairs.join(chosen.select("u", "v"), ["u", "v"], "left_anti")
        for end in ("a", "b"):
            named = found.select(F.col("node").alias(end), F.col("component").alias("_to"))
            rest = rest.join(named, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        rest = scratch.save(rest.where("a <> b").select(*pairs.columns))
        scratch.drop(pairs, chosen)
        pairs, each, left = rest, 4 * each, rest.count()
    scratch.drop(pairs)
    return parts


def without_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = 0.8, shingle: int = 5, width: int = 2, radius: int = 2, prints: int = 3, apart: int = 52) -> DataFrame:
    """docs with one row, of the smallest key, for each group of texts linked by a shingle Jaccard of at least `similarity`.

    A text whose similarity is near 0.8 differs in too many of 64 bits for a
    vantage-point tree to prune anything.  So the tree searches each half of
    `prints` independent fingerprints over pairs of words, where such texts are
    nearly always within `radius` of 32 bits in one of the halves (measured
    recall 0.99).  Candidates at most `apart` of all bits apart are confirmed
    by the exact similarity of their texts, the closest first.  What the tree leaves in different
    components then goes through `similar_candidates`, which misses no pair, and
    the same confirmation, in the rounds of `linked_parts`.  Only rows of the same words in the same order are
    one class without that.  A row without a key comes before those with one.
    """
    text_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    row, bits = (unused_name(docs, x) for x in ("_row", "_prints"))

    def printed(texts: typing.Iterator[pd.Series]) -> typing.Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([np.array(_majorities(t, width, prints - 1) + _words_hash(t), dtype="u8").view("i8") for t in batch], dtype=object)

    printed.__annotations__ = {"texts": typing.Iterator[pd.Series], "return": typing.Iterator[pd.Series]}
    wide = docs.select("*", F.pandas_udf(printed, "array<long>")(F.col(text).cast("binary")).alias(bits))
    wide = scratch.save(wide.withColumn(row, F.monotonically_increasing_id()))
    classes = wide.groupBy(F.col(bits).alias("h")).agg(F.min(F.struct(F.col(key).alias("k"), F.col(row).alias("r"))).alias("least"))
    classes = scratch.save(classes.select("h", "least.k", "least.r"))
    halves = F.flatten(F.transform(F.slice("h", 1, prints), lambda x: F.array(x.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(x, 32))))
    own = classes.select("r", F.posexplode(halves).alias("t", "fp"))
    distinct = scratch.save(own.groupBy("t", "fp").agg(F.min("r").alias("node")))
    one, two = (distinct.select("t", F.col("fp").alias(fp), F.col("node").alias(node)) for fp, node in (("a", "u"), ("b", "v")))
    found = linked_prints(distinct, radius, direct=True).join(one, ["t", "a"]).join(two, ["t", "b"]).select("u", "v")
    found = found.union(own.join(distinct, ["t", "fp"]).where("r <> node").select("r", "node"))
    edges = found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    one, two = (classes.select(F.col("r").alias(node), F.col("h").alias(h)) for node, h in (("u", "g"), ("v", "h")))
    differing = sum(F.bit_count(F.get("g", F.lit(i)).bitwiseXOR(F.get("h", F.lit(i)))) for i in range(prints))
    edges = scratch.save(edges.join(one, "u").join(two, "v").where(differing <= apart).select("u", "v", F.col("u").alias("a"), F.col("v").alias("b"), (-differing).alias("shared")))

    def confirmed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keep = [jaccard(p.as_py(), q.as_py(), shingle) >= similarity for p, q in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = wide.select(F.col(row).alias("r"), F.col(text).cast("binary").alias("t"))

    def links(pairs: DataFrame) -> DataFrame:
        # only texts of some pair are shuffled, once for both sides
        met = among(scratch, texts, "r", pairs.select("u").union(pairs.select("v")))
        one, two = (met.toDF(node, t) for node, t in (("u", "p"), ("v", "q")))
        pairs = pairs.join(one, "u").join(two, "v").select("a", "b", "p", "q")
        return pairs.mapInArrow(confirmed, "a long, b long")

    parts = linked_parts(scratch, scratch.save(classes.select("r", F.col("r").alias("c"))), edges, links)
    parts = linked_parts(scratch, parts, similar_candidates(scratch, texts, parts, similarity, shingle), links)
    grouped = classes.join(parts.withColumnRenamed("r", "node"), F.col("r") == F.col("node"))
    kept = grouped.groupBy("c").agg(F.min(F.struct("k", "r")).alias("least")).select(F.col("least.r").alias("_kept"))
    found = among(scratch, wide, row, kept).select(*docs.columns)
    scratch.drop(classes, distinct, parts)
    return found


def op3_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
