"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page's leaf blocks, in page order, are a chain with two labels, article or
not.  Features of a block are its ancestors' tags and class or id words, and
what its text looks like; transitions tie neighbours together.  The field is
trained by stochastic gradient on the log likelihood of PAGES labelled pages
and decoded by Viterbi, inside Spark tasks, page by page.

Defined results: null, empty or textless html gives an empty text; broken markup
is read as browsers do as far as block boundaries go; null urls and page_ids
stay null; repeated rows give a row each; other columns stay.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_batches
from .html_blocks import Block, leaf_blocks
from .html_pages import MAIN, REST, labelled_pages

#: Labelled pages trained on, feature buckets, passes and step size.
PAGES, BUCKETS, PASSES, RATE, DECAY = 500, 1 << 14, 6, 0.25, 1e-5
_SENTENCE = re.compile(r"[.!?…][\"'”»)]*$")


@functools.lru_cache(maxsize=50_000)
def _bucket(name: str) -> int:
    return xxhash.xxh32_intdigest(name) % BUCKETS


def features(blocks: list[Block]) -> list[np.ndarray]:
    out = []
    for i, b in enumerate(blocks):
        n = len(b.text.split())
        density = b.linked / len(b.text)
        names = ["bias", f"words {min(n, 3) if n < 4 else min(n.bit_length(), 8)}", f"linked {int(4 * min(density, 1))}", f"from start {min(i, 3)}", f"from end {min(len(blocks) - 1 - i, 2)}"]
        names += [f"tag {t}" for t in set(b.tags)] + [f"name {x}" for x in b.names]
        inner = b.tags[-1] if b.tags else ""
        names += [f"inner {inner}", f"sentence {bool(_SENTENCE.search(b.text))}", f"{inner} {n > 8}", f"copyright {'©' in b.text}"]
        region = next((t for t in reversed(b.tags) if t in ("article", "main", "nav", "footer", "header", "aside", "form", "section")), "none")
        names += [f"region {region}", f"region {region} {inner}", f"nested {b.tags.count('article')}"]
        out.append(np.array(sorted({_bucket(x) for x in names})))
    return out


@dataclass
class Field:
    emit: np.ndarray  # buckets x 2
    move: np.ndarray  # from, to

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.stack([self.emit[r].sum(axis=0) for r in rows])

    def decode(self, rows: list[np.ndarray]) -> list[int]:
        """The likeliest label sequence, by Viterbi."""
        s = self.scores(rows).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = s[0]
        back = []
        for x, y in s[1:]:
            to0, to1 = b + m10 > a + m00, b + m11 > a + m01
            back.append((to0, to1))
            a, b = x + (b + m10 if to0 else a + m00), y + (b + m11 if to1 else a + m01)
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[np.ndarray], np.ndarray]]) -> Field:
    """Adagrad on the log likelihood of labelled chains; forward and backward sums give the marginals."""
    field = Field(np.zeros((BUCKETS, 2)), np.zeros((2, 2)))
    emit2, move2 = np.full((BUCKETS, 2), 1e-8), np.full((2, 2), 1e-8)
    for turn in range(PASSES):
        for p in np.random.default_rng(turn).permutation(len(pages)):
            rows, labels = pages[p]
            s, n = field.scores(rows), len(rows)
            forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
            forward[0] = s[0]
            for i in range(1, n):
                forward[i] = s[i] + np.logaddexp(forward[i - 1, 0] + field.move[0], forward[i - 1, 1] + field.move[1])
            for i in range(n - 2, -1, -1):
                nxt = s[i + 1] + backward[i + 1]
                backward[i] = np.logaddexp(field.move[:, 0] + nxt[0], field.move[:, 1] + nxt[1])
            total = np.logaddexp(*forward[-1])
            single = np.exp(forward + backward - total)
            single[np.arange(n), labels] -= 1
            grad = np.zeros((2, 2))
            if n > 1:
                pair = forward[:-1, :, None] + field.move[None] + (s + backward)[1:, None, :] - total
                grad = np.exp(pair).sum(axis=0)
                np.add.at(grad, (labels[:-1], labels[1:]), -1)
            at = np.concatenate(rows)
            where, back = np.unique(at, return_inverse=True)
            g = np.zeros((len(where), 2))
            np.add.at(g, back, np.repeat(single, [len(r) for r in rows], axis=0))
            g += DECAY * field.emit[where]
            emit2[where] += g**2
            field.emit[where] -= RATE * g / np.sqrt(emit2[where])
            move2 += grad**2
            field.move -= RATE * grad / np.sqrt(move2)
    return field


def labelled_chain(html: str) -> tuple[list[np.ndarray], np.ndarray] | None:
    """Features and labels of a labelled page; a block is labelled by the mark it begins with."""
    blocks, labels = [], []
    for b in leaf_blocks(html):
        mark = next((c for c in b.text if c in (MAIN, REST)), REST)
        text = " ".join(b.text.replace(MAIN, "").replace(REST, "").split())
        if text:
            blocks.append(Block(text, b.tags, b.names, min(b.linked, len(text))))
            labels.append(int(mark == MAIN))
    return (features(blocks), np.array(labels)) if blocks else None


@functools.lru_cache(maxsize=4)
def trained(pages: int = PAGES, seed: int = 1) -> Field:
    """The field trained on `pages` labelled pages, the bound of what is ever learned from."""
    return train([c for c in map(labelled_chain, labelled_pages(pages, seed)) if c])


def main_text(html: str | None, field: Field) -> str:
    blocks = leaf_blocks(html)
    return "\n".join(b.text for b, label in zip(blocks, field.decode(features(blocks))) if label) if blocks else ""


def extract(html: Column, field: Field | None = None) -> Column:
    """The main text of each page, as a column."""
    model = field or trained()
    if spark := SparkSession.getActiveSession():
        text_batches(spark)

    @F.pandas_udf("string")
    def text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield pd.Series([main_text(p, model) for p in batch], dtype=object)

    return text(html)


def op9_html_main_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return pages.select("page_id", "url", extract(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
