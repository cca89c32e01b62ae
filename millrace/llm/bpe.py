"""Byte-pair encoding with word ends, by a segment tree over the ranks of adjacent pairs.

A word's symbols are the leaves' left ends; a leaf holds the rank of the pair that
starts there, and an inner node the smallest of its two.  The root is so the leftmost
pair of lowest rank: it is merged, which changes three leaves and their ancestors, until
the root holds no pair.  A word of n symbols takes n log n steps, however long it is.

Short words go through their trees side by side, as rows of numpy arrays; a long word has
a tree of its own.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Recent, text_batches, unused_name

#: White space of the Unicode standard; Python's own split takes four control characters more.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
CONTROLS = re.compile("[\x1c-\x1f]")
#: Fixed value: the pattern of words in the vocabulary file.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words, and white-space delimited chunks, in each of the two generations that a worker remembers.
CACHE_WORDS, CACHE_CHUNKS = 100_000, 150_000
#: Bytes beyond which a word has a tree of its own.
LONG_WORD = 64
#: Short words whose trees are held at a time; a tree takes some 40 bytes for each byte of its width.
SIDE_BY_SIDE = 8192
#: Texts encoded together, by their length; ids in a batch that goes back to Spark.
TOGETHER, BATCH_IDS = 1 << 20, 1 << 20

_codecs: dict[str, "WordBpe"] = {}


def codec(path: str) -> "WordBpe":
    """The worker's codec for a vocabulary file; kept between tasks of a reused worker."""
    if path not in _codecs:
        _codecs[path] = WordBpe(path)
    return _codecs[path]


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 characters for themselves, the others from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in own}
    for b in range(256):
        letters.setdefault(b, chr(0x100 + len(letters) - len(own)))
    return [letters[b] for b in range(256)]


class PairTree:
    """Ranks of the adjacent pairs of a word; `top()` is the leftmost lowest, changed by `put`."""

    NONE = 1 << 62
    SHIFT = 32

    def __init__(self, ranks: list[int | None]):
        self.size = 1 << max(len(ranks) - 1, 0).bit_length()
        leaves = [self.NONE if r is None else r << self.SHIFT | i for i, r in enumerate(ranks)]
        self.nodes = [self.NONE] * self.size + leaves + [self.NONE] * (self.size - len(leaves))
        nodes = self.nodes
        for i in range(self.size - 1, 0, -1):
            left, right = nodes[2 * i], nodes[2 * i + 1]
            nodes[i] = left if left < right else right

    def put(self, place: int, rank: int | None) -> None:
        nodes, i = self.nodes, self.size + place
        value = self.NONE if rank is None else rank << self.SHIFT | place
        while nodes[i] != value:
            nodes[i] = value
            if i == 1:
                return
            other = nodes[i ^ 1]
            if other < value:
                value = other
            i >>= 1

    def top(self) -> tuple[int, int] | None:
        """(rank, place) of the leftmost pair of lowest rank, or None if no pair can be merged."""
        value = self.nodes[1]
        return None if value == self.NONE else (value >> self.SHIFT, value & ((1 << self.SHIFT) - 1))


class WordBpe:
    """Encodes and decodes as a tokenizer file of this kind says: NFC, lower case letter by letter, words, bytes, merges with a word end."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        model, steps = stated["model"], (stated["pre_tokenizer"] or {}).get("pretokenizers", [])
        kinds = [x["type"] for x in (stated["normalizer"] or {}).get("normalizers", [])]
        self.end = model.get("end_of_word_suffix")
        if model["type"] != "BPE" or not self.end or kinds != ["NFC", "Replace", "Lowercase"] or stated["decoder"] or [x["type"] for x in steps] != ["Split", "ByteLevel"] or steps[0]["pattern"] != {"Regex": WORDS}:
            raise ValueError(f"{path}: not a vocabulary of lower-case words with word ends")
        vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in stated["added_tokens"]}
        self.tokens = [""] * (max(*vocab.values(), *self.specials.values()) + 1)
        for token, i in (vocab | self.specials).items():
            self.tokens[i] = token
        self.base = len(self.tokens)
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(vocab[a] * self.base + vocab[b], rank)
            self.made.append(vocab[a + b])
        letters = byte_letters()
        self.inner, self.last = [vocab[x] for x in letters], [vocab[x + self.end] for x in letters]
        pairs = sorted(self.ranks.items())
        self.pair_keys, self.pair_ranks = np.array([k for k, _ in pairs], dtype=np.int64), np.array([r for _, r in pairs], dtype=np.int64)
        self.made_array, self.inner_array, self.last_array = (np.array(x, dtype=np.int64) for x in (self.made, self.inner, self.last))
        self.find_words = regex.compile(WORDS).findall
        self.cut_specials = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")").split if self.specials else None
        self.words, self.chunks = Recent(CACHE_WORDS), Recent(CACHE_CHUNKS)

    def merged(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges."""
        n, base, rank_of, made = len(symbols), self.base, self.ranks.get, self.made
        if n < 2:
            return symbols
        tree = PairTree([rank_of(a * base + b) for a, b in zip(symbols, symbols[1:])])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        gone = bytearray(n)
        while (top := tree.top()) is not None:
            rank, at = top
            right = after[at]
            following = after[at] = after[right]
            symbols[at] = made[rank]
            gone[right] = 1
            if right < n - 1 or following < n:
                tree.put(right, None)
            if following < n:
                before[following] = at
                tree.put(at, rank_of(symbols[at] * base + symbols[following]))
            else:
                tree.put(at, None)
            if (previous := before[at]) >= 0:
                tree.put(previous, rank_of(symbols[previous] * base + symbols[at]))
        return [s for s, dead in zip(symbols, gone) if not dead]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, -1 for those that do not merge; absent symbols are negative."""
        keys = left * self.base + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), self.pair_ranks[at], -1)

    def merged_rows(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of symbols, padded with -1 behind, after all merges; symbols that are gone are -1.

        Each row has its segment tree in a row of `nodes`: the root at 1, leaf i at size + i."""
        m, width = symbols.shape
        size = 1 << max(width - 1, 0).bit_length()
        place = np.arange(width, dtype=np.int64)
        symbols = np.concatenate([symbols, np.full((m, 1), -1)], axis=1)  # what follows the last symbol
        nodes = np.full((m, 2 * size), PairTree.NONE, dtype=np.int64)
        ranks = self._ranks(symbols[:, :-1], symbols[:, 1:])
        nodes[:, size : size + width] = np.where(ranks >= 0, ranks << PairTree.SHIFT | place, PairTree.NONE)
        level = size >> 1
        while level:
            np.minimum(nodes[:, 2 * level : 4 * level : 2], nodes[:, 2 * level + 1 : 4 * level : 2], out=nodes[:, level : 2 * level])
            level >>= 1
        after = np.tile(np.append(place + 1, width), (m, 1))
        before = np.tile(np.append(place - 1, 0), (m, 1))
        rows = np.arange(m)
        while len(rows := rows[(tops := nodes[rows, 1]) != PairTree.NONE]):
            tops = tops[tops != PairTree.NONE]
            at, made = tops & ((1 << PairTree.SHIFT) - 1), self.made_array[tops >> PairTree.SHIFT]
            right = after[rows, at]
            following = after[rows, right]
            symbols[rows, at] = made
            symbols[rows, right] = -1
            after[rows, at] = following
            before[rows, following] = at
            previous = before[rows, at]
            first = previous < 0
            previous = np.where(first, right, previous)
            leaves = np.stack([right, at, previous])
            own, former = self._ranks(made, symbols[rows, following]), self._ranks(np.where(first, -1, symbols[rows, previous]), made)
            values = np.stack([np.full(len(rows), -1), own, former])
            line = np.broadcast_to(rows, leaves.shape)
            nodes[line, size + leaves] = np.where(values >= 0, values << PairTree.SHIFT | leaves, PairTree.NONE)
            inner = (size + leaves) >> 1
            while inner[0, 0]:
                nodes[line, inner] = np.minimum(nodes[line, 2 * inner], nodes[line, 2 * inner + 1])
                inner >>= 1
        return symbols[:, :-1]

    def _words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each word with its ids."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            data = word.encode()
            if len(data) > LONG_WORD:
                symbols = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
                yield word, np.array(self.merged(symbols), dtype="<u4").tobytes()
            else:
                by_width.setdefault(1 << (len(data) - 1).bit_length(), []).append((word, data))
        for width, group in ((w, g[i : i + SIDE_BY_SIDE]) for w, g in by_width.items() for i in range(0, len(g), SIDE_BY_SIDE)):
            lengths = np.array([len(data) for _, data in group])
            held = np.arange(width) < lengths[:, None]
            symbols = np.full((len(group), width), -1, dtype=np.int64)
            data = np.frombuffer(b"".join(data for _, data in group), dtype=np.uint8)
            symbols[held] = self.inner_array[data]
            ends = np.cumsum(lengths) - 1
            symbols[np.arange(len(group)), lengths - 1] = self.last_array[data[ends]]
            out = self.merged_rows(symbols)
            kept = out >= 0
            flat, cuts = out[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
            for (word, _), start, stop in zip(group, [0, *cuts], cuts):
                yield word, flat[start:stop]

    def _chunks(self, text: str) -> list[str]:
        """White-space delimited pieces of a text after normalisation."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")  # lower case by the letter knows no final sigma
        text = text.lower()
        return list(filter(None, SPACE.split(text))) if CONTROLS.search(text) else text.split()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; null is empty.  A special token's text is that token."""
        parts: list[list[list[str] | int]] = []
        for text in texts:
            cut = self.cut_specials(text) if text and self.cut_specials and "<|" in text else [text or ""]
            parts.append([self.specials[p] if i % 2 else self._chunks(p) for i, p in enumerate(cut)])
        wanted = set().union(*(p for some in parts for p in some if isinstance(p, list)))
        if missing := self.chunks.recall(wanted):
            cut_up = [self.find_words(c) for c in missing]
            known = self.words.young
            known.update(self._words(self.words.recall(set().union(*cut_up))))
            for chunk, words in zip(missing, cut_up):
                self.chunks.young[chunk] = known[words[0]] if len(words) == 1 else b"".join(map(known.__getitem__, words))
        ids = self.chunks.young.__getitem__
        out = [b"".join([b"".join(map(ids, p)) if isinstance(p, list) else np.uint32(p).tobytes() for p in some]) for some in parts]
        self.chunks.age()
        self.words.age()
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The ids' tokens, joined by a blank, special ones too: what a file without a decoder asks for.  Unknown ids are left out."""
        if len(ids) and int(ids.max()) >= self.base:
            ids = ids[ids < self.base]
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


def _column_added(df: DataFrame, source: str, out: str, kind: str, make) -> DataFrame:
    """df with a column that make(column array) gives, batch by batch; batches are cut by the size of what is made."""
    text_batches(df.sparkSession)
    at, place = df.columns.index(source), df.columns.index(out) if out in df.columns else None
    schema = df.drop(out).schema if place is not None else df.schema
    names = schema.fieldNames()

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            kept = [c for i, c in enumerate(batch.columns) if i != place]
            done = 0
            for made in make(batch.column(at)):
                n = len(made)
                yield pa.RecordBatch.from_arrays([c.slice(done, n) for c in kept] + [made], [*names, out])
                done += n

    from pyspark.sql.types import StructType, _parse_datatype_string

    added = _parse_datatype_string(f"`{out}` {kind}")
    return df.mapInArrow(rows, StructType([*schema.fields, *added.fields]))


def _portions(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts in lists of some characters each, so that what is made of them stays small."""
    held, size = [], 0
    for text in texts:
        held.append(text.as_py())
        size += len(held[-1] or "")
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the ids of each whole text as an array of integers.

    A null or empty text has no ids; a text of white space neither.  Rows are taken one by one, so repeated
    rows, ties and extra columns of any name stay as they are; a column named `out` is replaced.  No shuffle."""

    def make(texts: pa.Array) -> Iterator[pa.Array]:
        bpe = codec(path)
        for some in _portions(texts):
            coded = bpe.encode_all(some)
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in coded])]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), dtype="<u4").astype(np.int32)))

    return _column_added(df, text, out, "array<int>", make)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text that each row's ids stand for; null or no ids are an empty text, unknown ids are left out."""

    def make(column: pa.Array) -> Iterator[pa.Array]:
        bpe, held, size = codec(path), [], 0
        for value in column:
            found = value.values
            held.append(bpe.decode(found.to_numpy(zero_copy_only=False)) if found is not None and len(found) else "")
            size += len(held[-1])
            if size >= 8 * BATCH_IDS:
                yield pa.array(held, pa.string())
                held, size = [], 0
        if held:
            yield pa.array(held, pa.string())

    return _column_added(df, ids, out, "string", make)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the text they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = unused_name(docs, "ids")
    coded = decode(encode(docs, path, out=ids).drop("text"), path, ids, "decoded")
    return coded.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
