"""Token ids of whole texts, equal to what the tokenizers library returns for
each text, with a bounded per-worker cache of white-space delimited chunks.

Both public vocabularies used here never merge across the start of a
white-space run, so a text is cut into chunks (white space, then non-space) and
a distinct chunk is encoded once while a Python worker remembers it.  Missing chunks of a
batch are encoded together in one call and cut apart again.  Texts for which
cutting is not provably neutral (unusual white space, special-token strings)
are encoded whole by the library.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .common import Recent

#: White space other than blank, tab, line feed and carriage return: such texts are encoded whole.
UNUSUAL_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
CHUNK = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: Chunks in each of the two generations that a worker remembers (about 220 bytes each).
CACHE_CHUNKS = 500_000

_encoders: dict[str, "ChunkEncoder"] = {}


def encoder(path: str) -> "ChunkEncoder":
    """The worker's encoder for a tokenizer file; kept between tasks of a reused worker."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.vocab_size = max(vocab.values()) + 1
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.word_ends = any(token.endswith("</w>") for token in vocab)
        if self.word_ends:
            #: A one-character word that separates chunks when several are encoded in one call.
            self.bar = self._plain("|")
            if len(self.bar) != 1:
                raise ValueError(f"{path}: no single id for the separator")
        else:
            self.byte_length = np.zeros(self.vocab_size, dtype=np.int64)
            for token, i in vocab.items():
                self.byte_length[i] = len(token)
        self.cache = Recent(CACHE_CHUNKS)

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def encode(self, text: str | None) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers; null is empty."""
        if not text:
            return b""
        if UNUSUAL_SPACE.search(text) or any(s in text for s in self.specials):
            return self._plain(text).tobytes()
        chunks = CHUNK.findall(text)
        if missing := self.cache.recall(set(chunks)):
            self._fill(missing)
        out = b"".join(map(self.cache.young.__getitem__, chunks))
        self.cache.age()
        return out

    def _fill(self, missing: list[str]) -> None:
        cache, together = self.cache.young, []
        for chunk in missing:
            if ("|" in chunk) if self.word_ends else (chunk[0] not in " \n\t\r" or chunk[-1] in " \n\t\r"):
                cache[chunk] = self._plain(chunk).tobytes()
            else:
                together.append(chunk)
        if not together:
            return
        if self.word_ends:
            ids = self._plain(" | ".join(together))
            ends = np.append(np.flatnonzero(ids == self.bar[0]), len(ids))
            starts = np.append(0, ends[:-1] + 1)
        else:
            ids = self._plain("".join(together))
            reached = np.cumsum(self.byte_length[ids])
            wanted = np.cumsum([len(chunk.encode()) for chunk in together])
            ends = np.searchsorted(reached, wanted) + 1
            starts = np.append(0, ends[:-1])
        if len(ends) != len(together):
            raise ValueError("chunks and ids do not line up")
        for chunk, a, b in zip(together, starts.tolist(), ends.tolist()):
            cache[chunk] = ids[a:b].tobytes()
