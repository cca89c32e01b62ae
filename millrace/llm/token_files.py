"""Token ids in binary files of fixed-width packed bits.

Each id takes as many bits as the vocabulary's largest id needs.  A file has

    magic, bits, ids per block, documents, ids          (header, little-endian)
    one byte a document: 1 if it has an id              (null ids have 0)
    document ids                                        (signed 64-bit)
    end of each document, counted in ids                (unsigned 64-bit)
    byte offset of each block in the payload, and its end  (unsigned 64-bit)
    payload: blocks of packed ids

so that any span of ids is found by its block's offset and unpacked with
vectorised numpy.  Files are written in ascending document order by tasks that
each hold a range of documents, are bounded in size and appear whole under
their final name. An attempt of a task writes names of its own, so that two attempts
never meet; the manifest names the files of the attempt that counted, and `tidy` deletes the others.

Defined results: null text is an empty document of one end id; null doc_ids
come first; repeated rows are documents of their own, ordered by text; other
columns are ignored; an empty table writes no files and reads back no rows.
"""

from __future__ import annotations

import struct
import uuid
from typing import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, small_parts, text_batches

VOCABULARY, END = "word_bpe_49k.json", 1
MAGIC, HEADER = b"BITTOKEN", "<8sIIQQ"
#: Ids in a block, and after how many ids a file is closed (a document is never split).
BLOCK_IDS, FILE_IDS = 4096, 1 << 22


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(planes.ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    planes = np.zeros((n, 32), dtype=np.uint8)
    planes[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    return np.packbits(planes, axis=1, bitorder="little").view("<u4").ravel()


def file_bytes(doc_ids: list[int | None], docs: list[bytes], bits: int) -> bytes:
    """A whole file; docs hold ids as little-endian unsigned 32-bit integers."""
    ids = np.frombuffer(b"".join(docs), "<u4")
    ends = np.cumsum([len(d) // 4 for d in docs]).astype("<u8")
    blocks = [pack_bits(ids[a : a + BLOCK_IDS], bits) for a in range(0, len(ids), BLOCK_IDS)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], dtype="<i8")
    return b"".join([struct.pack(HEADER, MAGIC, bits, BLOCK_IDS, len(docs), len(ids)), known.tobytes(), numbers.tobytes(), ends.tobytes(), offsets.tobytes(), *blocks])


class TokenFile:
    """Random access to a file: documents and any span of ids, reading only the blocks it touches."""

    def __init__(self, handle):
        self.handle = handle
        magic, self.bits, self.block, n, self.ids = struct.unpack(HEADER, handle.read(struct.calcsize(HEADER)))
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.known = np.frombuffer(handle.read(n), np.uint8) > 0
        self.doc_ids = np.frombuffer(handle.read(8 * n), "<i8")
        self.ends = np.frombuffer(handle.read(8 * n), "<u8").astype(np.int64)
        blocks = -(-self.ids // self.block)
        self.offsets = np.frombuffer(handle.read(8 * (blocks + 1)), "<u8").astype(np.int64)
        self.payload = handle.tell()

    def span(self, first: int, stop: int) -> np.ndarray:
        if stop <= first:
            return np.zeros(0, dtype="<u4")
        a, b = first // self.block, -(-stop // self.block)
        self.handle.seek(self.payload + int(self.offsets[a]))
        data = self.handle.read(int(self.offsets[b] - self.offsets[a]))
        base = int(self.offsets[a])
        parts = [unpack_bits(data[int(self.offsets[i]) - base : int(self.offsets[i + 1]) - base], min(self.block, self.ids - i * self.block), self.bits) for i in range(a, b)]
        return np.concatenate(parts)[first - a * self.block : stop - a * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.span(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


_MANIFEST = "part int, file int, path string, docs long, ids long"


def write(docs: DataFrame, folder: str, vocabulary: str, end: int = END, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Writes the files below `folder`, a URI that driver and executors share; returns a row for each file."""

    def files(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .encoding import encoder

        code = encoder(vocabulary)
        bits = max(1, (max(code.vocab_size - 1, end)).bit_length())
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, file, held, numbers, size = TaskContext.get().partitionId(), 0, [], [], 0
        last, attempt = np.array([end], dtype="<u4").tobytes(), uuid.uuid4().hex

        def close() -> pa.RecordBatch:
            nonlocal file, held, numbers, size
            path, draft = f"{root}/part-{part:05d}-{file:05d}-{attempt}.bits", f"{root}/_draft-{attempt}"
            with store.open_output_stream(draft) as out:
                out.write(file_bytes(numbers, held, bits))
            store.move(draft, path)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([file], pa.int32()), pa.array([path]), pa.array([len(held)], pa.int64()), pa.array([size], pa.int64())], ["part", "file", "path", "docs", "ids"])
            file, held, numbers, size = file + 1, [], [], 0
            return row

        for batch in it:
            for number, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = code.encode(t.as_py()) + last
                if held and size + len(data) // 4 > FILE_IDS:
                    yield close()
                held.append(data)
                numbers.append(number)
                size += len(data) // 4
        if held:
            yield close()

    text_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    rows = rows.repartitionByRange(small_parts(docs.sparkSession), F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first(), "t")
    return rows.mapInArrow(files, _MANIFEST)


def tidy(manifest: DataFrame, folder: str) -> int:
    """Deletes files that a written manifest does not name, left by attempts that did not count; returns their number.  The names, a row a file, pass through the driver."""
    store, root = fs.FileSystem.from_uri(folder)
    named = {r.path for r in manifest.select("path").collect()}
    left = [f.path for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.path not in named]
    for path in left:
        store.delete_file(path)
    return len(left)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files of a manifest; start counts the ids of all files and documents before it."""
    # the running sum is over one row a file
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.withColumn("base", before).select("path", "base").repartition(small_parts(manifest.sparkSession), "path")

    def documents(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in it:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(path) as handle:
                    file = TokenFile(handle)
                    for a in range(0, len(file.ends), 512):
                        n = min(512, len(file.ends) - a)
                        start = int(file.ends[a - 1]) if a else 0
                        ends = file.ends[a : a + n]
                        ids = file.span(start, int(ends[-1])).tobytes()
                        starts = np.concatenate([[start], ends[:-1]])
                        data = [ids[4 * (s - start) : 4 * (e - start)] for s, e in zip(starts.tolist(), ends.tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids[a : a + n], mask=~file.known[a : a + n]), pa.array(starts + base), pa.array(data, pa.binary())], ["doc_id", "start", "ids"])

    return placed.mapInArrow(documents, "doc_id long, start long, ids binary")


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "token-files")
    folder = scratch.path("files")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    manifest = scratch.save(write(docs, folder, public_tokenizers.path(VOCABULARY)))
    return read(manifest, folder).select("doc_id", "start", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
