"""A trie of conversation prefixes over range-sorted shards.

Conversations are rows of turn ids (128-bit digests of role and text).  They are range-sorted
by those ids and then by conversation, so that the conversations of a node stand together and a
group of equal ones can be cut anywhere.  A shard sorts its rows with numpy, in bands of a few
turns: padded matrices of turn ids, whose column changes, accumulated by OR along a row, mark
where nodes start; reduceat adds up every depth of a band at once.

A node that holds the first or last row of its shard may go on in other shards.  Of these a
shard emits two rows, its first and last path with what it knows of each node, and the paths of
all shards go through the same steps again, in fewer shards, until one is left.  Each level
keeps at most a quarter of the rows, so there are few levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_parts

#: Cells (turns and roots) that a shard takes on average; turns of a band.
SHARD_CELLS, BAND = 1 << 17, 8
#: Conversation ids in one piece of a node's list of ends.
ENDS_PIECE = 1 << 14
NOBODY = np.iinfo(np.int64).max
EMPTY = hashlib.sha256(b"").hexdigest()

_ROW = "tie long, key binary, lens array<int>, parts binary"
_OUT = f"kind int, level int, shard long, slot long, node binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends string, {_ROW}"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
_SCHEMA = pa.schema([(n, _KINDS[k]) for n, k in (x.split() for x in _OUT.split(", "))])
NODE, SLOT, ENDS, PATH = range(4)


def _batch(**columns) -> pa.RecordBatch:
    n = next(len(v) for v in columns.values() if not np.isscalar(v))
    made = []
    for field in _SCHEMA:
        value = columns.get(field.name)
        if value is None:
            made.append(pa.nulls(n, field.type))
        elif np.isscalar(value):
            made.append(pa.repeat(pa.scalar(value, field.type), n))
        else:
            made.append(value if isinstance(value, pa.Array) else pa.array(value, field.type))
    return pa.RecordBatch.from_arrays(made, schema=_SCHEMA)


def _node_keys(key: bytes) -> list[bytes]:
    """What names the node at each depth of a path, the root first."""
    running, out = hashlib.sha256(), []
    for depth in range(len(key) // 16 + 1):
        if depth:
            running.update(key[16 * depth - 16 : 16 * depth])
        out.append(depth.to_bytes(8, "big") + running.digest()[:16])
    return out


class _Shard:
    """The rows of a shard, from the root down and up again."""

    def __init__(self, table: pa.Table, last: bool):
        self.tie = table["tie"].to_numpy().astype(np.int64)
        self.keys: list[bytes] = table["key"].to_pylist()
        self.n = len(self.keys)
        self.length = np.array([len(k) // 16 for k in self.keys], dtype=np.int64)
        self.lens = np.concatenate([np.zeros(0, np.int64), *[np.asarray(x, dtype=np.int64) for x in table["lens"].to_pylist()]])
        self.turn_at = np.concatenate([[0], np.cumsum(self.length)])
        self.ids = np.frombuffer(b"".join(self.keys), dtype=">u8").reshape(-1, 2)
        cells = int(self.length.sum()) + self.n
        self.cell_at = self.turn_at[:-1] + np.arange(self.n)  # a row's root; its turns follow
        own = np.ones(cells, dtype=np.int64), np.repeat(self.tie, self.length + 1), *[np.zeros(cells, dtype=np.int64)] * 3
        self.ends_here = True
        if (parts := table["parts"])[0].as_py() is not None:
            own = np.concatenate([np.frombuffer(p, dtype="<i8").reshape(5, -1) for p in parts.to_pylist()], axis=1)
            self.ends_here = False
        self.count, self.low, self.kids, self.leaves, self.saved = own
        first = min(range(self.n), key=lambda i: (self.keys[i], self.tie[i]))
        end = max(range(self.n), key=lambda i: (self.keys[i], self.tie[i]))
        self.paths = [] if last else [first] if first == end else [first, end]

    def nodes(self, level: int, shard: int) -> Iterator[pa.RecordBatch]:
        bands = list(self._down())
        n = self.n
        leaf_below, saved_below, kid_starts = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        on_paths: dict[tuple[int, int], tuple] = {}  # (path, depth) to its sums, the deepest first
        for band in reversed(bands):
            yield from self._up(band, leaf_below, saved_below, kid_starts, on_paths, level, shard)
        yield from self._emit_paths(on_paths, level, shard)

    def _down(self) -> Iterator[dict]:
        """From the root: each band's matrix, where its nodes start, and their members."""
        rows, depth = np.arange(self.n), 0
        label = np.zeros(self.n, np.int64)  # a row's node above the band
        parent_low, parent_slot = np.full(self.n, NOBODY), np.full(self.n, -1, np.int64)
        while len(rows):
            here = 1 if depth == 0 else BAND  # the root is a band of its own: depths [depth, depth + here)
            reach = np.minimum(self.length[rows] + 1 - depth, here)
            held = np.arange(here) < reach[:, None]
            cell = (self.cell_at[rows] + depth)[:, None] + np.arange(here)
            ids = np.zeros((len(rows), here, 2), dtype=np.uint64)
            if depth:
                ids[held] = self.ids[((self.turn_at[rows] + depth - 1)[:, None] + np.arange(here))[held]]
            order = np.lexsort((self.tie[rows], *[ids[:, c, x] for c in range(here - 1, -1, -1) for x in (1, 0)], label[rows]))
            rows, ids, held, cell, reach = rows[order], ids[order], held[order], cell[order], reach[order]
            changed = np.ones((len(rows), here), dtype=bool)
            changed[1:] = (ids[1:] != ids[:-1]).any(axis=2)
            changed[1:, 0] |= label[rows[1:]] != label[rows[:-1]]
            starts = np.logical_or.accumulate(changed, axis=1) & held
            at = np.flatnonzero(starts.T)  # depth by depth
            node_of = (np.cumsum(starts.T.ravel()) - 1).reshape(here, -1).T  # a cell's node
            band = {"rows": rows, "depth": depth, "here": here, "held": held, "reach": reach, "at": at, "starts": starts, "node_of": node_of, "cell": cell}
            band["n"] = np.add.reduceat(self._cells(band, self.count, 0), at)
            band["low"] = np.minimum.reduceat(self._cells(band, self.low, NOBODY), at)
            slots = np.full(len(at), -1, np.int64)
            for path in range(len(self.paths) - 1, -1, -1):
                found = np.flatnonzero(rows == self.paths[path])
                if len(found):
                    for c in range(int(reach[found[0]])):
                        slots[node_of[found[0], c]] = 2 * (depth + c) + path
            band["slot"] = slots
            column, row = np.divmod(at, len(rows))
            above = np.where(column > 0, node_of[row, column - 1], 0)
            band["parent_low"] = np.where(column > 0, band["low"][above], parent_low[rows[row]])
            band["parent_slot"] = np.where(column > 0, slots[above], parent_slot[rows[row]])
            yield band
            deeper = rows[self.length[rows] >= depth + here]
            inside = node_of[:, here - 1]
            parent_low[rows], parent_slot[rows] = band["low"][inside], slots[inside]
            label[rows] = inside
            rows, depth = deeper, depth + here

    def _cells(self, band: dict, values: np.ndarray, nothing: int) -> np.ndarray:
        """The band's cells of these values, depth by depth."""
        out = np.full(band["held"].shape, nothing, dtype=np.int64)
        out[band["held"]] = values[band["cell"][band["held"]]]
        return out.T.ravel()

    def _up(self, band: dict, leaf_below, saved_below, kid_starts, on_paths: dict, level: int, shard: int) -> Iterator[pa.RecordBatch]:
        """From the deepest band: what lies below each node; whole nodes are emitted, those on paths noted."""
        rows, depth, here, at, starts = band["rows"], band["depth"], band["here"], band["at"], band["starts"]
        m = len(rows)
        column, row = np.divmod(at, m)
        kid_cells = np.empty((m, here), np.int64)
        kid_cells[:, :-1], kid_cells[:, -1] = starts[:, 1:], kid_starts[rows]
        kids = np.add.reduceat(self._cells(band, self.kids, 0) + kid_cells.T.ravel(), at)
        kid_starts[rows] = starts[:, 0]
        slot, count, low = band["slot"], band["n"], band["low"]
        whole = slot < 0
        depths = depth + column
        if depth:
            text_length = self.lens[self.turn_at[rows[row]] + depths - 1]
        else:
            text_length = np.zeros(len(at), np.int64)
        leaf_cells, saved_cells = self._cells(band, self.leaves, 0), self._cells(band, self.saved, 0)
        leaf_cells[at] += whole & (kids == 0)
        saved_cells[at] += np.where(whole, (count - 1) * text_length, 0)

        def below(cells: np.ndarray, carried: np.ndarray) -> np.ndarray:
            """Sums over each node and all below it."""
            table = cells.reshape(here, m).T
            table[:, -1] += carried[rows]
            table = np.cumsum(table[:, ::-1], axis=1)[:, ::-1]
            carried[rows] = table[:, 0]
            return np.add.reduceat(table.T.ravel(), at)

        leaves, saved = below(leaf_cells, leaf_below), below(saved_cells, saved_below)
        ends = self._ends(band)
        for i in np.flatnonzero(~whole).tolist():
            d, path = divmod(int(slot[i]), 2)
            on_paths[path, d] = (int(count[i]), int(low[i]), int(kids[i]), int(leaves[i]), int(saved[i]), ends.pop(i, None))
        if whole.any():
            digests = [EMPTY] * len(at) if self.ends_here else [None] * len(at)
            for i, ids in ends.items():
                digests[i] = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            keys = None
            if not self.ends_here:
                names = {int(r): _node_keys(self.keys[r]) for r in set(rows[row].tolist())}
                keys = pa.array([names[r][d] for r, d, w in zip(rows[row].tolist(), depths.tolist(), whole) if w], pa.binary())
            parent_slot = band["parent_slot"][whole]
            open_parent = parent_slot >= 0
            parent = pa.array(band["parent_low"][whole], mask=open_parent | (depths[whole] == 0))
            chosen = [x for x, w in zip(digests, whole) if w]
            yield _batch(kind=NODE, level=level, shard=shard, slot=pa.array(parent_slot, mask=~open_parent), node=keys, conv_id=low[whole], depth=depths[whole], parent_conv_id=parent,
                         n_convs=count[whole], n_children=kids[whole], n_leaves=leaves[whole], saved_tokens=saved[whole], ends_sha256=chosen)

    def _ends(self, band: dict) -> dict[int, list[int]]:
        """The conversations that end at each of the band's nodes, ascending."""
        if not self.ends_here:
            return {}
        rows, last = band["rows"], self.length[band["rows"]] - band["depth"]
        ending = np.flatnonzero(last < band["here"])
        if not len(ending):
            return {}
        node, ids = band["node_of"][ending, last[ending]], self.tie[rows[ending]]
        order = np.lexsort((ids, node))
        node, ids = node[order], ids[order]
        cuts = np.append(np.flatnonzero(np.diff(node, prepend=-1)), len(node)).tolist()
        return {int(node[a]): ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])}

    def _emit_paths(self, on_paths: dict, level: int, shard: int) -> Iterator[pa.RecordBatch]:
        """Rows for the next level: of each node on a path only what hangs on it apart from deeper nodes on paths."""
        if not self.paths:
            return
        names = [_node_keys(self.keys[r]) for r in self.paths]
        for p, r in enumerate(self.paths):
            parts = np.zeros((5, int(self.length[r]) + 1), dtype="<i8")
            parts[1] = NOBODY
            for d in range(parts.shape[1]):
                if (p, d) not in on_paths:
                    continue  # the other path's
                n, low, kids, leaves, saved, ids = on_paths[p, d]
                for q in range(len(self.paths)):
                    if (q, d + 1) in on_paths and names[q][d] == names[p][d]:
                        below = on_paths[q, d + 1]
                        kids, leaves, saved = kids - 1, leaves - below[3], saved - below[4]
                parts[:, d] = n, low, kids, leaves, saved
                yield _batch(kind=SLOT, level=level, shard=shard, slot=[2 * d + p], node=[names[p][d]])
                for i in range(0, len(ids or ()), ENDS_PIECE):
                    yield _batch(kind=ENDS, node=[names[p][d]], tie=[ids[i]], ends=[",".join(map(str, ids[i : i + ENDS_PIECE]))])
            lens = self.lens[self.turn_at[r] : self.turn_at[r + 1]]
            yield _batch(kind=PATH, tie=[int(self.tie[r])], key=[self.keys[r]], lens=[lens.tolist()], parts=[parts.tobytes()])


def _shard_nodes(level: int, last: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = [b for b in it if b.num_rows]
        if batches:
            yield from _Shard(pa.Table.from_batches(batches), last).nodes(level, TaskContext.get().partitionId())

    return run


def _hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, digest) of pieces that come sorted by node and place."""
    node, running = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([running.hexdigest()])], ["of", "digest"])

    for batch in it:
        for key, piece in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
            if key != node:
                if node is not None:
                    yield done()
                node, running = key, hashlib.sha256()
            else:
                running.update(b",")
            running.update(piece.encode())
    if node is not None:
        yield done()


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, seq): each conversation's turns, by turn (null first), as structs of a turn id and the text's code points.

    Role and text, null ones taken as empty, make the id; turns of one number come in the order of their ids.
    Rows without a conv_id belong to no conversation and are left out.  Texts are not shuffled."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn_id = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.struct(F.col("turn"), turn_id.alias("id"), F.char_length(text).alias("len")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda x: F.struct(x["id"], x["len"])).alias("seq"))


def rebuilt(seqs: DataFrame, base: Column, taken: Column, most: int) -> DataFrame:
    """Each conversation with its first `taken` turns replaced by those of conversation `base` (none if it is absent).

    most: an upper bound of `taken`; only so many turns of a conversation meet others."""
    heads = seqs.select(F.col("conv_id").alias("_base"), F.slice("seq", 1, most).alias("_head"))
    heads = heads.join(seqs.select(base.alias("_b")).distinct(), F.col("_base") == F.col("_b"), "left_semi")
    joined = seqs.withColumn("_of", base).join(heads, F.col("_of") == F.col("_base"), "left")
    head = F.slice(F.coalesce("_head", F.array().cast(seqs.schema["seq"].dataType)), F.lit(1), taken.cast("int"))
    rest = F.slice("seq", taken.cast("int") + 1, F.greatest(F.size("seq") - taken.cast("int"), F.lit(0)))
    return joined.select("conv_id", F.concat(head, rest).alias("seq"))


def trie(seqs: DataFrame, shard_cells: int = SHARD_CELLS) -> DataFrame:
    """A row for each distinct prefix of the sequences (conv_id, seq), the root included.

    conv_id: the smallest member; parent_conv_id: the parent's, null for the root; n_convs, n_children, n_leaves,
    saved_tokens (code points that members but one repeat, over the subtree) and ends_sha256 (of the members that end here).
    A conversation without turns is a member of the root; an empty table has no nodes.  A conversation's ids, 24 bytes a
    turn, are one record and held by one task."""
    spark = seqs.sparkSession
    scratch = Scratch(spark, "trie")
    rows = scratch.save(seqs.select(
        F.col("conv_id").alias("tie"), F.unhex(F.array_join(F.transform("seq", lambda x: x["id"]), "")).alias("key"),
        F.transform("seq", lambda x: x["len"]).alias("lens"), F.lit(None).cast("binary").alias("parts"),
    ))
    wanted, level, outs = small_parts(spark), 0, []
    while True:
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("lens") + 1), F.lit(0)).alias("cells")).first()
        level += 1
        # a first level in fewer shards than tasks would leave tasks idle; a later one has eight rows a shard at least
        shards = max(wanted, -(-size.cells // shard_cells)) if level == 1 else min(-(-size.cells // shard_cells), max(size.n // 8, 1))
        last = shards <= 1
        dealt = rows.coalesce(1) if last else rows.repartitionByRange(shards, "key", "tie")
        out = scratch.save(dealt.mapInArrow(_shard_nodes(level, last), _OUT))
        outs.append(out)
        if last or size.n == 0:
            break
        rows = out.where(F.col("kind") == PATH).select("tie", "key", "lens", "parts")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = [o.where(F.col("kind") == NODE).select(*columns, "level", "shard", "slot", "node") for o in outs]
    if len(outs) == 1:
        return nodes[0].select(*columns)
    ends = outs[0].where(F.col("kind") == ENDS).select("node", "tie", "ends")
    ended = ends.repartition(small_parts(spark), "node").sortWithinPartitions("node", "tie").select("node", "ends").mapInArrow(_hashed, "of binary, digest string")
    upper = nodes[1]
    for more in nodes[2:]:
        upper = upper.union(more)
    upper = scratch.save(upper.join(ended, F.col("node") == F.col("of"), "left").withColumn("ends_sha256", F.coalesce("digest", F.lit(EMPTY))).drop("of", "digest"))
    slots = outs[0]
    for more in outs[1:]:
        slots = slots.union(more)
    slots = slots.where(F.col("kind") == SLOT).select("level", "shard", "slot", "node")
    names = slots.join(upper.select("node", F.col("conv_id").alias("_parent")), "node").select("level", "shard", "slot", "_parent")
    rows = nodes[0].union(upper)
    known = rows.where("slot is null").select(*columns)
    joined = rows.where("slot is not null").join(names, ["level", "shard", "slot"])
    return known.union(joined.withColumn("parent_conv_id", F.col("_parent")).select(*columns))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    scratch = Scratch(spark, "turns")
    seqs = scratch.save(sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    taken = F.crc32(F.col("conv_id").cast("string")) % 6
    return trie(rebuilt(seqs, F.col("conv_id") - F.col("conv_id") % 100, taken, 5))
