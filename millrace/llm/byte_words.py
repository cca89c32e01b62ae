"""Token ids of whole texts under a byte-level vocabulary, by numbered words.

A text is cut into the words of the vocabulary's pattern, and a worker gives each distinct word
a number when it first meets it.  The library's model encodes new words, many in a call and written in its
letters for bytes, so that its pattern and alignments are spared; all texts' ids are then
gathered from the words' ids at once.  Texts with characters beyond `PLAIN`, of which Python's patterns
are not sure to judge as the vocabulary's does, and texts with special-token strings go to `encoding`.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

from .bpe import byte_letters
from .encoding import encoder

#: Latin letters: all between U+00C0 and U+024F but the signs for times and division.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: What plain texts hold: printable ASCII, blank, tab, line ends, Latin letters, dashes and quotation marks.
BEYOND = re.compile(f"[^\t\n\r -~{_LATIN}‐-‧]")
#: Fixed value: the vocabulary's pattern of words, on plain texts.
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s0-9{_LATIN}]+|\s+(?!\S)|\s+")
#: Words that a worker remembers (about 200 bytes each); beyond it starts anew.
MOST_WORDS = 800_000
#: Characters of texts whose new words are encoded in one call.
TOGETHER = 1 << 21

_encoders: dict[str, "WordEncoder"] = {}


def word_encoder(path: str) -> "WordEncoder":
    """The worker's encoder for a byte-level tokenizer file; kept between tasks of a reused worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class Numbered(dict):
    """Words by number; a word not met before gets the next one and is noted as new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.rest = encoder(path)
        if self.rest.word_ends:
            raise ValueError(f"{path}: not a byte-level vocabulary")
        #: The same model, without pattern and alignments.
        self.model = Tokenizer(self.rest.tokenizer.model)
        self.letters = dict(enumerate(byte_letters()))
        self.forget()

    def forget(self) -> None:
        self.words = Numbered()
        self.ids, self.ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; null is empty."""
        held, size = [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= TOGETHER:
                yield from self._encoded(held)
                held, size = [], 0
        yield from self._encoded(held)

    def _encoded(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.words) > MOST_WORDS:
            self.forget()
        number, odd, numbers, ends = self.words.__getitem__, set(), [np.zeros(0, np.int64)], [0]
        for i, text in enumerate(texts):
            if BEYOND.search(text) or any(s in text for s in self.rest.specials):
                odd.add(i)
            else:
                numbers.append(np.array([*map(number, WORD.findall(text))], np.int64))
            ends.append(ends[-1] + (0 if i in odd else len(numbers[-1])))
        if self.words.new:
            self._learn()
        numbers = np.concatenate(numbers)
        first, n = self.ends[numbers], self.ends[numbers + 1] - self.ends[numbers]
        reached = np.append(0, np.cumsum(n))
        ids = self.ids[np.repeat(first - reached[:-1], n) + np.arange(reached[-1])]
        bounds = reached[ends].tolist()
        for i, text in enumerate(texts):
            yield self.rest.encode(text) if i in odd else ids[bounds[i] : bounds[i + 1]].tobytes()

    def _learn(self) -> None:
        """Encodes the new words, whose numbers follow those known."""
        spelt = [word.encode().decode("latin-1").translate(self.letters) for word in self.words.new]
        self.words.new.clear()
        ids = np.array(self.model.encode_batch_fast([spelt], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
        reached, wanted = np.cumsum(self.rest.byte_length[ids]), np.cumsum([len(word) for word in spelt])
        ends = np.searchsorted(reached, wanted)
        if len(ids) == 0 or reached[-1] != wanted[-1] or (reached[ends] != wanted).any():
            raise ValueError("words and ids do not line up")
        self.ends = np.append(self.ends, len(self.ids) + ends + 1)
        self.ids = np.append(self.ids, ids)
