"""Byte-pair encoding, alignment and prefix tries against the libraries and brute force."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import alignment, bpe, prefix_trie
from millrace.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [*"abcdefghij ABC éßÀΣςİı漢字かな👍🏽 0123 '.,!—$%\n\t\r<|>", "\x1c", "\x85", "　", "▁", "\x00", "е́", "</s>", "<s>", "<0x0A>", "<|endoftext|>", "<|startoftext|>", "'s", "'ll", "  ", "the ", "ing ", " of"]


def odd_texts(seed, n, longest):
    r = random.Random(seed)
    return ["".join(r.choices(ODD, k=r.randint(0, longest))) for _ in range(n)]


# byte-pair encoding


def test_pair_tree_gives_the_leftmost_lowest():
    r = random.Random(5)
    for n in range(1, 40):
        ranks = [r.choice([None, *range(6)]) for _ in range(n)]
        tree = bpe.PairTree(ranks)
        for _ in range(30):
            known = [(x, i) for i, x in enumerate(ranks) if x is not None]
            assert tree.top() == (min(known) if known else None)
            at = r.randrange(n)
            ranks[at] = r.choice([None, *range(6)])
            tree.put(at, ranks[at])


def test_ids_and_texts_equal_the_library():
    library, own = Tokenizer.from_file(WORD), bpe.WordBpe(WORD)
    texts = odd_texts(1, 2000, 40) + ["a" * 5000, "ab" * 3000 + "c", "!" * 2000, " \n\t", "x"]
    for text, data in zip(texts, own.encode_all(texts)):
        ids, wanted = np.frombuffer(data, "<u4"), library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == wanted
        assert own.decode(ids) == library.decode(wanted, skip_special_tokens=False)


def test_rows_of_short_words_equal_trees_of_their_own():
    own, r = bpe.WordBpe(WORD), random.Random(2)
    words = ["".join(r.choices("etaoinshr", k=r.randint(1, 60))) for _ in range(400)]
    for word, ids in own._words(words):
        data = word.encode()
        alone = own.merged([own.inner[b] for b in data[:-1]] + [own.last[data[-1]]])
        assert np.frombuffer(ids, "<u4").tolist() == alone


def test_caches_that_forget_change_nothing(monkeypatch):
    texts = odd_texts(7, 300, 30)
    wanted = bpe.WordBpe(WORD).encode_all(texts)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 5)
    own = bpe.WordBpe(WORD)
    assert [own.encode(t) for t in texts] == wanted


def test_encode_and_decode_of_odd_rows(spark, monkeypatch):
    rows = [(0, "A b", "x"), (0, "A b", "x"), (1, None, None), (None, "", "y"), (2, "w " * 40_000, "z"), (3, " \n ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    monkeypatch.setattr(bpe, "TOGETHER", 3)
    out = bpe.decode(bpe.encode(df, WORD), WORD, out="decoded")
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    library = Tokenizer.from_file(WORD)
    got = Counter((r.doc_id, r.text, tuple(r.ids), r.decoded) for r in out.collect())
    ids = [(i, t, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows]
    assert got == Counter((i, t, x, library.decode(list(x), skip_special_tokens=False)) for i, t, x in ids)
    assert bpe.encode(df.limit(0), WORD).count() == 0


def test_a_file_of_another_kind_is_refused():
    with pytest.raises(ValueError):
        bpe.WordBpe(BYTE)


def test_bpe_query(spark):
    library = Tokenizer.from_file(WORD)
    want = set()
    for row in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode(row.text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.add((row.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    out = QUERIES["op11_bpe"](spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {tuple(r) for r in out.collect()} == want


# alignment


class Slow:
    """Alignment of whole texts, token by token, and counts over all of them."""

    def __init__(self):
        self.a = Tokenizer.from_file(BYTE)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECE)
        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            self.bytes_a = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}

    def bytes_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") else piece.replace("▁", " ").encode()

    def one(self, text):
        if not text:
            return None
        whole = (" " + text).encode()
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        parts_a, parts_b = [self.bytes_a[i] for i in a], [self.bytes_b(i) for i in b]
        if not b"".join(parts_a) == b"".join(parts_b) == whole:
            return None
        ends_a, ends_b = (np.cumsum([len(p) for p in parts]).tolist() for parts in (parts_a, parts_b))
        groups, links, i, k = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            j, m = ends_a.index(end, i) + 1, ends_b.index(end, k) + 1
            groups.append(",".join(map(str, a[i:j])) + "|" + ",".join(map(str, b[k:m])))
            links.append((a[j - 1], b[m - 1]))
            i, k = j, m
        return len(a), len(b), groups, links

    def all(self, rows):
        """(rows as the operator's, counts of pairs, documents of pairs)."""
        done = [(i, self.one(t)) for i, t in rows]
        count, docs, best = Counter(), Counter(), defaultdict(int)
        for _, d in done:
            if d:
                count.update(d[3])
                docs.update(set(d[3]))
        for (_, b), n in count.items():
            best[b] = max(best[b], n)
        out = Counter()
        for i, d in done:
            if not d:
                out[i, 0, 0, 0, 0, 0, 0, ""] += 1
            else:
                out[i, d[0], d[1], len(d[2]), len(d[3]), sum(count[x] == best[x[1]] for x in d[3]), sum(count[x] for x in d[3]), ";".join(d[2])] += 1
        return out, count, docs, best


def test_alignment_of_odd_texts(spark):
    rows = list(enumerate(odd_texts(3, 1500, 50))) + [(1, None), (None, "abc the"), (5, ""), (7, " "), (7, "   "), (7, "a\n\n b \n"), (7, "a\n\n b \n"), (8, "the of " * 6000)]
    table = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, pair string, block string").repartition(3)
    done = alignment.Alignment(table, BYTE, PIECE, block_links=3000)  # several blocks a task
    want, count, docs, best = Slow().all(rows)
    assert Counter(tuple(r) for r in done.documents().collect()) == want
    pairs = {(r.a, r.b): (r.docs, r.links, r.best) for r in done.pairs().collect()}
    assert pairs == {p: (docs[p], n, n == best[p[1]]) for p, n in count.items()}
    assert done.rows.where(F.col("kind") == alignment.BITS).select("block").distinct().count() > 3


def test_alignment_keeps_columns_and_takes_empty_tables(spark):
    table = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, n_a string")
    out = alignment.Alignment(table, BYTE, PIECE, keep=("doc_id", "text"), digest=True).documents()
    assert out.columns == ["doc_id", "text", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"] and out.count() == 1
    assert alignment.Alignment(table.limit(0), BYTE, PIECE).documents().count() == 0


def test_bitmaps_hold_what_they_are_made_of():
    block, r, want = alignment._Block(), random.Random(4), Counter()
    for place in range(2500):
        links = [5] * r.choice([0, 1, 1, 2, 3, 9]) + [r.randrange(100, 900) for _ in range(r.randint(0, 4))] + ([77] * 4096 if place == 33 else [])
        assert block.add(np.array(links, dtype="<i8").tobytes()) == place
        want.update((x, place) for x in links)
    got = Counter()
    for pairs, plane, n, bits in block.planes():
        rows, places = alignment._places(bits)
        assert np.bincount(rows, minlength=len(pairs)).tolist() == n.tolist() and (np.diff(pairs) > 0).all()
        for pair, place in zip(pairs[rows].tolist(), places.tolist()):
            got[pair, place] += 1 if plane == 0 else 1 << (plane - 1)
    assert got == want


def test_alignment_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[1] else "") for r in Slow().all(rows)[0]}
    out = QUERIES["op12_alignment"](spark, SF)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {tuple(r) for r in out.collect()} == want


# prefix tries


def slow_trie(sequences):
    """{node rows} of {conv_id: tuple of (role, text)}."""
    members, children = defaultdict(list), defaultdict(set)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                children[s[: d - 1]].add(s[:d])
    leaves, saved, out = {}, {}, Counter()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = (not children[p]) + sum(leaves[k] for k in children[p])
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in children[p])
        ends = ",".join(map(str, sorted(c for c in members[p] if len(sequences[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        out[min(members[p]), len(p), parent, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def slow_rebuilt(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(t, key=lambda y: y[:2])] for c, t in turns.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: tuple(own.get(c - c % 100, [])[: heads[c]] + s[heads[c] :]) for c, s in own.items()}


def built(spark, rows, cells):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    taken = F.crc32(F.col("conv_id").cast("string")) % 6
    seqs = prefix_trie.rebuilt(prefix_trie.sequences(df), F.col("conv_id") - F.col("conv_id") % 100, taken, 5)
    return Counter(tuple(r) for r in prefix_trie.trie(seqs, cells).collect())


@pytest.mark.parametrize("cells", [1 << 17, 40])
def test_trie_of_hot_prefixes_ties_and_nulls(spark, cells):
    r, rows = random.Random(9), []
    for c in range(420):
        if c % 7 == 3:
            continue
        for turn in range(3 if c % 3 == 0 else r.randint(0, 9)):  # a third is equal, turn by turn
            text = "same" if c % 3 == 0 else r.choice(["a", "b", "", None, "é👍"])
            rows.append((c, turn if turn else None, "user" if turn % 2 == 0 else None, text))
    rows += [(777, i, "user", f"t{i % 3}") for i in range(60)] + [(None, 0, "user", "nobody"), (300, 0, "user", "x")]
    assert built(spark, rows, cells) == slow_trie(slow_rebuilt(rows))


def test_trie_of_long_equal_conversations(spark):
    rows = [(c, i, "user", f"t{i}" if i < 35 or c % 2 else f"u{c}") for c in range(40) for i in range(45 if c % 4 else 38)]
    assert built(spark, rows, 60) == slow_trie(slow_rebuilt(rows))


def test_trie_of_nothing_and_of_no_turns(spark):
    empty = spark.createDataFrame([], "conv_id long, seq array<struct<id:string,len:int>>")
    assert prefix_trie.trie(empty).count() == 0
    lone = spark.createDataFrame([(5, []), (3, [])], "conv_id long, seq array<struct<id:string,len:int>>")
    assert [tuple(r) for r in prefix_trie.trie(lone).collect()] == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,5").hexdigest())]


def test_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = QUERIES["op13_prefix_trie"](spark, SF)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(tuple(r) for r in out.collect()) == slow_trie(slow_rebuilt(rows))


def test_trees_of_many_new_words_are_held_some_at_a_time(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    code, sizes = bpe.WordBpe(path), []
    rows = code.merged_rows
    monkeypatch.setattr(code, "merged_rows", lambda symbols: [sizes.append(len(symbols)), rows(symbols)][1])
    text = " ".join("".join(chr(97 + (i >> s) % 26) for s in (0, 3, 6, 9, 12)) for i in range(0, 1 << 17, 3))
    found = np.frombuffer(code.encode(text), "<u4").tolist()
    assert found == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert max(sizes) <= 8192 < sum(sizes)
