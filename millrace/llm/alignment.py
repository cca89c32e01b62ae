"""Two tokenizers' tokens of the same text, aligned by the bytes where both end, and how
often each pair of ids ends together in the corpus.

Inverted pair bitmaps: in a block of documents, each pair of ids has a bitmap of the documents
that hold it linked, and multiplicity planes: bitmaps of the bits of how many more times than
once.  The bitmaps of document batches are OR-merged into those of their block, compressed
(places, or bits once they are shorter), and written.  Popcounts, weighted by plane, are the
pair's document and link counts; the same rows then carry the pair's score back, as postings, to
the documents of their block.  However common a pair is, it has a few rows a block.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Recent, Scratch, text_batches

#: Documents of a block, and links after which it ends early.
BLOCK_DOCS, BLOCK_LINKS = 8192, 1 << 21
#: Chunks in each of the two generations that a worker remembers.
CACHE_CHUNKS = 250_000
#: Neither vocabulary joins a character to a blank, line feed or tab behind it.
CHUNK = re.compile(r"[ \n\t]*[^ \n\t]+|[ \n\t]+")
#: Characters beside which a cut may change tokens: other white space, and a piece's own sign for a blank.
UNCUT = re.compile("[\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u2581\u3000\ufeff]")
#: Bits of an id in a pair of ids.
ID_BITS = 20
#: Stands before chunks that are encoded together; a chunk begins with white space, so that it is cut off exactly.
GUARD = " |"

_aligners: dict[tuple[str, str], "Aligner"] = {}


def aligner(path_a: str, path_b: str) -> "Aligner":
    """The worker's aligner; kept between tasks of a reused worker."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


#: What a chunk adds to its document: groups as text, links as pairs, tokens of either side.
Aligned = tuple[bytes, bytes, int, int]


class Aligner:
    """A: a byte-level vocabulary file of the tokenizers library.  B: a piece model of sentencepiece, with byte fallback."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        from .bpe import byte_letters

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if max(len(self.bytes_a), len(pieces)) > 1 << ID_BITS:
            raise ValueError(f"vocabularies of at most {1 << ID_BITS} ids can be aligned")
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        #: Whether a chunk's tokens do not depend on what stands around it.
        self.cuts = not any(re.search("[^\u2581]\u2581|.[\n\t]|[\n\t].", p) for p in pieces)
        self.cache = Recent(CACHE_CHUNKS)

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides of a text that begins with a blank, which B adds by itself."""
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(a, dtype=np.int64), np.array(self.b.encode(text[1:]), dtype=np.int64)

    def _exact(self, data: bytes, a: np.ndarray, b: np.ndarray) -> bool:
        return b"".join(map(self.bytes_a.__getitem__, a.tolist())) == data == b"".join(map(self.bytes_b.__getitem__, b.tolist()))

    def _cut(self, lengths: list[int], a: np.ndarray, b: np.ndarray) -> list[Aligned] | None:
        """What each of consecutive chunks of these lengths in bytes adds; None if tokens of both sides do not end where chunks do."""
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        common, wanted = np.intersect1d(ends_a, ends_b), np.cumsum(lengths)
        stops = np.searchsorted(common, wanted, "right")
        if not (common[stops - 1] == wanted).all():
            return None
        # one token of each side ends where a group does
        last_a, last_b = np.searchsorted(ends_a, common, "right"), np.searchsorted(ends_b, common, "right")
        links = ((a[last_a - 1] << ID_BITS) | b[last_b - 1]).astype("<i8").tobytes()
        names_a, names_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        cuts_a, cuts_b = [0, *last_a.tolist()], [0, *last_b.tolist()]
        groups = [",".join(names_a[i:j]) + "|" + ",".join(names_b[k:m]) for i, j, k, m in zip(cuts_a, cuts_a[1:], cuts_b, cuts_b[1:])]
        out, start = [], 0
        for stop in stops.tolist():
            out.append((";".join(groups[start:stop]).encode(), links[8 * start : 8 * stop], cuts_a[stop] - cuts_a[start], cuts_b[stop] - cuts_b[start]))
            start = stop
        return out

    def _fill(self, missing: list[str]) -> None:
        """Aligns chunks together, in halves where that fails; a chunk that fails alone is None.

        A chunk begins with white space; one that is nothing else stands at a text's end and is encoded alone."""
        alone = [[c] for c in missing if c[-1] in " \n\t"]
        for some in [*alone, [c for c in missing if c[-1] not in " \n\t"]]:
            text = GUARD + "".join(some)
            a, b = self._ids(text)
            found = self._cut([len(GUARD), *(len(c.encode()) for c in some)], a, b) if self._exact(text.encode(), a, b) else None
            if found:
                self.cache.young.update(zip(some, found[1:]))
            elif len(some) > 1:
                self._fill(some[: len(some) // 2])
                self._fill(some[len(some) // 2 :])
            else:
                self.cache.young.update(dict.fromkeys(some))

    def align(self, texts: list[str | None]) -> list[list[Aligned]]:
        """Each text's parts, in order; none if either side's bytes are not those of a blank and the text."""
        chunks: list[list[str] | None] = []
        for text in texts:
            if not text:
                chunks.append([])
            elif not self.cuts or UNCUT.search(text):
                chunks.append(None)
            else:
                chunks.append(CHUNK.findall(" " + text))
        if missing := self.cache.recall(set().union(*filter(None, chunks))):
            self._fill(missing)
        out = []
        for text, parts in zip(texts, chunks):
            found = None if parts is None else list(map(self.cache.young.__getitem__, parts))
            out.append(self._whole(text) if found is None or None in found else found)
        self.cache.age()
        return out

    def _whole(self, text: str) -> list[Aligned]:
        text = " " + text
        data = text.encode()
        a, b = self._ids(text)
        return (self._exact(data, a, b) and self._cut([len(data)], a, b)) or []


_DOC = "n_a long, n_b long, n_groups long, n_links long, groups string"
_MAP = "kind int, block long, place int, pair long, plane int, n int, bits binary"
DOC, BITS = 0, 1
_BITS_BYTES = BLOCK_DOCS // 8


def _bitmaps(places: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A bitmap for each run of ascending places: the places as 16-bit numbers, or bits where those are no longer."""
    stops = np.append(starts[1:], len(places))
    if not (dense := (stops - starts) * 2 >= _BITS_BYTES).any():
        offsets = np.append(starts, len(places)) * 2
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(places.astype("<u2"))])
    raw, out = places.astype("<u2").tobytes(), []
    for start, stop, many in zip(starts.tolist(), stops.tolist(), dense.tolist()):
        if many:
            bits = np.zeros(BLOCK_DOCS, dtype=np.uint8)
            bits[places[start:stop]] = 1
            out.append(np.packbits(bits, bitorder="little").tobytes())
        else:
            out.append(raw[2 * start : 2 * stop])
    return pa.array(out, pa.binary())


def _places(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of all bits of binary bitmaps."""
    bitmaps = bitmaps.combine_chunks() if isinstance(bitmaps, pa.ChunkedArray) else bitmaps
    offsets = np.frombuffer(bitmaps.buffers()[1], dtype="<i4")[bitmaps.offset : bitmaps.offset + len(bitmaps) + 1].astype(np.int64)
    data = np.frombuffer(bitmaps.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    lengths = np.diff(offsets)
    dense = np.flatnonzero(lengths == _BITS_BYTES)
    sparse = np.repeat(lengths != _BITS_BYTES, lengths)
    rows, places = [np.repeat(np.arange(len(lengths)), np.where(lengths == _BITS_BYTES, 0, lengths // 2))], [data[sparse].view("<u2").astype(np.int64)]
    for row in dense.tolist():
        found = np.flatnonzero(np.unpackbits(data[offsets[row] : offsets[row + 1]], bitorder="little"))
        rows.append(np.full(len(found), row))
        places.append(found)
    return np.concatenate(rows), np.concatenate(places)


class _Block:
    """Bitmaps of the documents of a block."""

    def __init__(self, most_links: int = BLOCK_LINKS):
        self.docs = self.links = 0
        self.most_links = most_links
        self.held: list[np.ndarray] = []

    def add(self, links: bytes) -> int:
        """Takes a document's links; returns its place."""
        pairs = np.frombuffer(links, dtype="<i8")
        self.held.append(pairs * BLOCK_DOCS + self.docs)
        self.docs += 1
        self.links += len(pairs)
        if len(self.held) >= 512:
            self.held = [np.concatenate(self.held)]
        return self.docs - 1

    @property
    def full(self) -> bool:
        return self.docs == BLOCK_DOCS or self.links >= self.most_links

    def planes(self) -> Iterator[tuple[np.ndarray, int, np.ndarray, pa.Array]]:
        """(pairs, plane, popcounts, bitmaps): plane 0 for the documents that hold a pair, plane k for bit k - 1 of its further links there."""
        keys, times = np.unique(np.concatenate(self.held or [np.zeros(0, np.int64)]), return_counts=True)
        more, plane, chosen = times - 1, 0, np.ones(len(keys), dtype=bool)
        while chosen.any():
            pairs, places = keys[chosen] // BLOCK_DOCS, keys[chosen] % BLOCK_DOCS
            starts = np.flatnonzero(np.diff(pairs, prepend=-1))
            yield pairs[starts], plane, np.diff(np.append(starts, len(pairs))), _bitmaps(places, starts)
            held = more >> plane > 0  # a plane may be empty and a higher one not
            keys, more = keys[held], more[held]
            chosen = (more >> plane) & 1 == 1
            plane += 1
            while len(more) and not chosen.any():
                chosen = (more >> plane) & 1 == 1
                plane += 1


def _aligned(path_a: str, path_b: str, text_at: int, kept: list[str], digest: bool, block_links: int):
    """Document rows and, behind each block, its bitmap rows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        work = aligner(path_a, path_b)
        number, block = TaskContext.get().partitionId() << 32, _Block(block_links)
        kinds: list[pa.DataType] = []

        def bitmap_rows() -> Iterator[pa.RecordBatch]:
            for pairs, plane, n, bits in block.planes():
                rows = len(pairs)
                columns = [pa.nulls(rows, k) for k in kinds] + [pa.nulls(rows, pa.int64())] * 4 + [pa.nulls(rows, pa.string())]
                columns += [pa.repeat(pa.scalar(BITS, pa.int32()), rows), pa.repeat(pa.scalar(number, pa.int64()), rows), pa.nulls(rows, pa.int32()), pa.array(pairs, pa.int64())]
                columns += [pa.repeat(pa.scalar(plane, pa.int32()), rows), pa.array(n, pa.int32()), bits]
                yield pa.RecordBatch.from_arrays(columns, names)

        names = [*kept, *(x.split()[0] for x in f"{_DOC}, {_MAP}".split(", "))]
        for batch in it:
            own = [batch.column(i) for i in range(batch.num_columns) if i != text_at]
            kinds = [c.type for c in own]
            texts, done = batch.column(text_at).to_pylist(), 0
            while done < len(texts):
                size, some = 0, []
                for text in texts[done:]:
                    if some and (size > block_links or block.docs + len(some) == BLOCK_DOCS):
                        break
                    some.append(text)
                    size += len(text or "")
                blocks, places, columns = [], [], [[] for _ in range(5)]
                for parts in work.align(some):
                    links = b"".join(map(itemgetter(1), parts))
                    groups = b";".join(map(itemgetter(0), parts))
                    n = len(links) // 8
                    groups_out = (hashlib.sha256(groups).hexdigest() if parts else "") if digest else groups.decode()
                    for column, value in zip(columns, (sum(map(itemgetter(2), parts)), sum(map(itemgetter(3), parts)), n, n, groups_out)):
                        column.append(value)
                    blocks.append(number)
                    places.append(block.add(links))
                rows = len(some)
                made = [c.slice(done, rows) for c in own] + [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.string())]
                made += [pa.repeat(pa.scalar(DOC, pa.int32()), rows), pa.array(blocks, pa.int64()), pa.array(places, pa.int32()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())]
                yield pa.RecordBatch.from_arrays(made, names)
                done += rows
                if block.full:
                    yield from bitmap_rows()
                    number, block = number + 1, _Block(block_links)
        if block.docs:
            yield from bitmap_rows()

    return run


def _returned(table: pa.Table) -> pa.Table:
    """(block, place, n_best, count_sum) of the documents of one block, from its bitmaps with their pairs' scores."""
    rows, places = _places(table["bits"])
    plane = table["plane"].to_numpy()
    times = np.where(plane == 0, 1, 1 << np.maximum(plane.astype(np.int64) - 1, 0))
    best = np.zeros(BLOCK_DOCS, np.int64)
    total = np.zeros(BLOCK_DOCS, np.int64)
    np.add.at(best, places, np.where(table["best"].to_numpy(zero_copy_only=False), times, 0)[rows])
    np.add.at(total, places, (times * table["links"].to_numpy())[rows])
    found = np.flatnonzero(total)
    return pa.table({"block": pa.repeat(table["block"][0], len(found)), "place": pa.array(found, pa.int32()), "n_best": best[found], "count_sum": total[found]})


def pair_counts(bitmaps: DataFrame) -> DataFrame:
    """(pair, docs, links) of written bitmaps: popcounts, weighted by plane."""
    weight = F.when(F.col("plane") == 0, F.lit(1).cast("long")).otherwise(F.expr("shiftleft(1L, plane - 1)"))
    return bitmaps.groupBy("pair").agg(F.sum(F.when(F.col("plane") == 0, F.col("n"))).alias("docs"), F.sum(F.col("n") * weight).alias("links"))


class Alignment:
    """docs aligned by two tokenizers: `documents()`, a row a document with its groups and scores; `pairs()`, a row a pair of ids.

    A: `path_a` encodes a blank and the text; B: `path_b` encodes the text.  Special tokens' strings are plain text.  Null and
    empty texts, and those whose bytes either side does not give back, have no tokens: zeros and an empty `groups`.  Rows are
    told apart by their place in the input, so null and repeated ids, ties and repeated rows are rows of their own; of
    the input only the columns `keep` come along, so that no other column can clash.  Very long texts are aligned whole."""

    def __init__(self, docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digest: bool = False, block_links: int = BLOCK_LINKS):
        """digest: `groups` holds the SHA-256 of the groups' text in place of the text.  block_links: links after which a block ends early."""
        spark = docs.sparkSession
        text_batches(spark)
        self.scratch, self.keep = Scratch(spark, "alignment"), list(keep)
        self.names = [f"_c{i}" for i in range(len(keep))]
        rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, self.names)], F.col(text).alias("_text"))
        kept = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in self.names)
        schema = f"{kept}, {_DOC}, {_MAP}" if kept else f"{_DOC}, {_MAP}"
        self.rows = self.scratch.save(rows.mapInArrow(_aligned(path_a, path_b, len(keep), self.names, digest, block_links), schema))
        self.bitmaps = self.rows.where(F.col("kind") == BITS).select("pair", "block", "plane", "n", "bits")

    def pairs(self) -> DataFrame:
        """(a, b, docs, links, best): in how many documents and how often the ids end together; best: no A id does so more often with this B id."""
        return self._judged(pair_counts(self.bitmaps)).select(F.shiftright("pair", ID_BITS).alias("a"), "b", "docs", "links", "best")

    def _judged(self, counts: DataFrame) -> DataFrame:
        counts = self.scratch.save(counts.withColumn("b", F.col("pair").bitwiseAND((1 << ID_BITS) - 1)))
        most = counts.groupBy("b").agg(F.max("links").alias("most"))
        return counts.join(most, "b").withColumn("best", F.col("links") == F.col("most"))

    def documents(self) -> DataFrame:
        scores = self._judged(pair_counts(self.bitmaps)).select("pair", "links", "best")
        posted = self.bitmaps.drop("n").join(scores, "pair").select("block", "plane", "bits", "links", "best")
        back = posted.groupBy("block").applyInArrow(_returned, "block long, place int, n_best long, count_sum long")
        docs = self.rows.where(F.col("kind") == DOC)
        docs = docs.join(back, ["block", "place"], "left")
        scored = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
        return docs.select(*[F.col(n).alias(c) for n, c in zip(self.names, self.keep)], "n_a", "n_b", "n_groups", "n_links", *scored, "groups")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, scores and the digest of the groups of each document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = Alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return done.documents().withColumnRenamed("groups", "groups_sha256")
