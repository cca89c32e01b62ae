"""Small brute-force, round-trip and edge-case tests of the training-data operators."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import byte_words, embedding_dedup, encoding, html_extract, licences, mixing, packing, quality, simhash, token_files, topk, toxicity
from millrace.llm.common import Scratch, among, connected_components, ranked

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, _row string"
LONG = " ".join(f"w{i % 977}" for i in range(70_000))


def docs(spark, texts, start=0):
    """A table with clashing extra columns; None among the texts, ids and sources."""
    return spark.createDataFrame([(start + i, t, "en", f"s{i % 3}", len(t or ""), "x", "y") for i, t in enumerate(texts)], DOCS)


def odd_docs(spark):
    rows = docs(spark, ["a b c d e f", None, "", "  \n", LONG, "a b c d e f", "Ünïcode ß   text"])
    more = spark.createDataFrame([(None, "no id here at all", None, None, None, None, None), (0, "a b c d e f", "en", "s0", 11, "x", "y")], DOCS)
    return rows.union(more)


# components and ranks


@pytest.mark.parametrize("one_task", [1 << 17, 0])
def test_components_of_paths_stars_and_cycles(spark, one_task):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 90)] + [(300, 301), (301, 302), (302, 300), (7, 7)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in connected_components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long"), one_task).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(90)}, **{300 + i: 300 for i in range(3)}}
    assert connected_components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long"), one_task).count() == 0


def test_ranks_of_a_hot_key(spark):
    rows = [("hot" if i % 3 else None, i * 7919 % 1000) for i in range(1000)]
    out = ranked(Scratch(spark, "t"), spark.createDataFrame(rows, "k string, v int"), ["k"], ["v"], "r").collect()
    for key in ("hot", None):
        own = sorted((x.v, x.r) for x in out if x.k == key)
        assert [r for _, r in own] == list(range(len(own)))


# quality


def test_quality_shrinks_sparse_sites_and_separates(spark):
    r = random.Random(3)
    good = [" ".join(r.choice(["the", "river", "of", "stone", "and", "quiet", "morning", "walk"]) + str(r.randint(0, 50)) for _ in range(80)) + "." for _ in range(120)]
    bad = [" ".join(["BUY!!", "NOW!!", "###"] * r.randint(10, 30)) for _ in range(60)]
    table = docs(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(0, 180, 2)], "doc_id long, quality int")
    site = F.when(F.col("doc_id") == 1, "tiny").otherwise(F.col("source"))
    out = {x.doc_id: x for x in quality.judge(table, labels, site, site).collect()}
    assert all((out[i].quality_score >= 0.5) == (i < 120) for i in range(180))
    assert abs(out[1].site_prior - 120 / 180) < 0.15
    found = [quality.statistics(t.encode()) for t in good + bad]
    assert all(len(s) == quality.WIDTH and all(map(math.isfinite, s)) for s in found)


def slow_posteriors(rows):
    """(prior, posterior) of (host, path, evidence) rows, one formula after another."""
    chance = [1 / (1 + math.exp(-e)) for _, _, e in rows]
    mean = sum(chance) / len(rows)

    def by(at):
        out = {}
        for r, c in zip(rows, chance):
            out.setdefault(at(r), []).append(c)
        return out

    def strength(groups, prior):
        n = sum(map(len, groups.values()))
        if n <= len(groups):
            return quality.STRONGEST
        averages = {g: sum(c) / len(c) for g, c in groups.items()}
        within = max(0.0, sum((x - averages[g]) ** 2 for g, c in groups.items() for x in c) / (n - len(groups)))
        spread = sum(len(c) * (averages[g] - prior(g)) ** 2 for g, c in groups.items())
        between = max(0.0, (spread - len(groups) * within) / n)
        binomial = sum(len(c) * prior(g) * (1 - prior(g)) for g, c in groups.items()) / n
        return min(quality.STRONGEST, max(quality.WEAKEST, binomial / between - 1 if between > 0 else quality.STRONGEST))

    hosts, paths = by(lambda r: r[0]), by(lambda r: r[:2])
    k = strength(hosts, lambda g: mean)
    host_mean = {g: (k * mean + sum(c)) / (k + len(c)) for g, c in hosts.items()}
    k = strength(paths, lambda g: host_mean[g[0]])
    out = []
    for (host, path, e), c in zip(rows, chance):
        own = paths[host, path]
        prior = (k * host_mean[host] + sum(own) - c) / (k + len(own) - 1)
        p = min(max(prior, 1e-6), 1 - 1e-6)
        out.append((prior, 1 / (1 + math.exp(-(e + math.log(p / (1 - p)))))))
    return out


def test_posteriors_against_one_formula_after_another(spark):
    r = random.Random(9)
    rows = []
    for host in ["a", "b", "c", None, "rare"]:
        tilt = r.uniform(-3, 3)
        for path in ["x", None, "y"]:
            rows += [(host, path, r.gauss(tilt, 2)) for _ in range(1 if host == "rare" else r.randint(1, 60))]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, host string, path string, e double").repartition(4)
    out = {x.i: x for x in quality.posteriors(df, "e", "host", "path", "prior", "posterior", Scratch(spark, "t")).collect()}
    for i, (prior, posterior) in enumerate(slow_posteriors(rows)):
        assert abs(out[i].prior - prior) < 1e-9 and abs(out[i].posterior - posterior) < 1e-9


def test_quality_fit_is_the_penalised_optimum_in_few_jobs(spark):
    g = np.random.default_rng(4)
    x = g.normal(2.0, 3.0, (400, quality.WIDTH))
    x[:, 5] = 0.25  # says nothing
    x[:, 6] = x[:, 7]
    y = (x[:, 0] - x[:, 1] + g.normal(0, 2.0, 400) > 1).astype(float)
    rows = spark.createDataFrame([(float(b), a.tolist()) for a, b in zip(x, y)], "label double, features array<double>").repartition(5)
    spark.sparkContext.setJobGroup("fit", "")
    try:
        weights, intercept = quality.fit_logistic(rows, len(y), y.sum())
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("fit"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # where it is flat the slope of the mean loss is the penalty's, in units of the deviations
    error = 1 / (1 + np.exp(-(x @ weights + intercept))) - y
    deviation = x.std(axis=0, ddof=1)
    assert abs(error.mean()) < 1e-6
    assert np.abs((error @ x) / len(y) + quality.PENALTY * weights * deviation**2).max() < 1e-5
    assert weights[5] == 0 and abs(weights[6] - weights[7]) < 1e-6 and jobs <= 20


def test_quality_fit_of_separable_rows_ends(spark):
    rows = [(float(i % 2), [float(i % 2)] + [0.0] * (quality.WIDTH - 1)) for i in range(50)]
    weights, intercept = quality.fit_logistic(spark.createDataFrame(rows, "label double, features array<double>"), 50, 25.0)
    assert weights[0] + intercept > 2 and intercept < -2 and not weights[1:].any()


def test_jobs_of_the_quality_fit_are_few(spark):
    r = random.Random(8)
    texts = [" ".join(r.choice(["river", "STONE", "12", "of", "the!"]) for _ in range(r.randint(5, 60))) for _ in range(200)]
    labels = spark.createDataFrame([(i, int(len(t) + r.randint(-60, 60) > 150)) for i, t in enumerate(texts)], "doc_id long, quality int")
    spark.sparkContext.setJobGroup("evidence", "")
    try:
        assert quality.fit_evidence(Scratch(spark, "t"), docs(spark, texts), labels, "text", "doc_id", "quality", 1000) is not None
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("evidence"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs <= 25


def test_quality_of_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.judge(odd_docs(spark), none, F.col("source"), F.col("lang"))
    assert out.count() == 9 and out.where("quality_score IS NULL").count() == 0 and "score" in out.columns
    assert quality.judge(docs(spark, []), none, F.col("source"), F.col("lang")).count() == 0


# top-k


def brute_topk(rows, k=5):
    q = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for a in q:
        if a % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(q[a], q[b])), b) for b in q if b != a and len(q[b]) == len(q[a]))[:k]
            out |= {(a, n + 1, b, -s) for n, (s, b) in enumerate(scores)}
    return out


def test_topk_against_brute_force(spark):
    g = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in g.normal(size=8)]) for i in range(330)]
    rows[50] = (50, rows[0][1])
    rows[60:64] = [(60, None), (61, [float("nan")] * 8), (62, [None] * 8), (63, [float("inf")] * 8)]
    rows += [(400, [1.0, 2.0, 3.0]), (401, [0.5, 0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = topk.search(df, F.col("vec_id") % 50 == 0, shard=64, group=3)
    assert {tuple(r) for r in out.collect()} == brute_topk(rows)
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_prunes_and_breaks_ties(spark):
    v = np.zeros((1024, 4))
    v[:, 0] = np.repeat(np.arange(8), 128)
    at, ids, scores, visited = topk.best_of_shard(np.array([[1.0, 0, 0, 0]]), np.array([-1]), v, np.arange(1024), np.arange(1024), 5)
    assert ids.tolist() == [896, 897, 898, 899, 900] and scores.tolist() == [7] * 5 and visited == 1
    big = np.full((3, 2), 2.0**40)
    assert topk.best_of_shard(big[:1], np.array([-1]), big, np.arange(3), np.arange(3), 2)[2].tolist() == [2**63 - 1] * 2


# simhash


def slow_print(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", None, "One", "One TWO", "a b c", "É ß Ü x y z\x0bq", " \n ", "a b c a b c a b c"])
def test_fingerprints(text):
    assert simhash.fingerprint(text.encode() if text is not None else None) == slow_print(text)


def test_fingerprint_of_a_very_long_text():
    assert simhash.fingerprint(LONG.encode()) == slow_print(LONG)


def near_prints(n, seed=2):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(n)]
    return np.array(sorted({b ^ (1 << r.randrange(64)) ^ (r.randint(0, 1) << r.randrange(64)) for b in base for _ in range(3)} | set(base)), dtype="u8")


def groups(fps, links):
    parent = {int(f): int(f) for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(int(a))] = find(int(b))
    return {frozenset(x for x in parent if find(x) == root) for root in {find(x) for x in parent}}


@pytest.mark.parametrize("direct", [False, True])
def test_vantage_forest_against_all_pairs(direct):
    fps = near_prints(400)
    all_pairs = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ a) <= 2]]
    links = [(x, y) for a, b in simhash.forest(fps, 2, direct) for x, y in zip(a, b)]
    assert groups(fps, links) == groups(fps, all_pairs)
    if direct:
        assert all(bin(int(a) ^ int(b)).count("1") <= 2 for a, b in links)
    dense = np.arange(1 << 10, dtype="u8")
    assert len(groups(dense, [(x, y) for a, b in simhash.forest(dense, 2, direct) for x, y in zip(a, b)])) == 1


def test_tree_brings_near_prints_together():
    fps = near_prints(500, 4)
    tree = simhash.VantageTree(fps[::3], 16, 2)
    rows, leaves = tree.route(fps)
    homes = {}
    for i, leaf in zip(rows.tolist(), leaves.tolist()):
        homes.setdefault(i, set()).add(leaf)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2):
            assert homes[i] & homes[int(j)]


def test_simhash_rows(spark):
    out = simhash.near_duplicates(odd_docs(spark)).collect()
    assert len(out) == 9
    got = {(r.doc_id, r.fp & (2**64 - 1)): r.component_id for r in out}
    assert got[(0, slow_print("a b c d e f"))] == 0 and got[(5, slow_print("a b c d e f"))] == 0
    assert got[(1, 0)] == got[(2, 0)] == got[(3, 0)] == 1 and got[(None, slow_print("no id here at all"))] is None
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_confirmed_near_duplicates(spark):
    r = random.Random(8)
    words = [f"word{i}" for i in range(4000)]
    base = [[r.choice(words) for _ in range(200)] for _ in range(60)]
    texts = [" ".join(b) for b in base]
    for b in base[:20]:
        c = list(b)
        c[r.randrange(200)] = "changed"
        texts.append(" ".join(c))
    for b in base[20:30]:
        texts.append(" ".join(b[:100] + [r.choice(words) for _ in range(100)]))
    kept = {x.doc_id for x in simhash.without_near_duplicates(docs(spark, texts)).collect()}
    assert set(range(60)) <= kept and set(range(80, 90)) <= kept and not kept & set(range(60, 80))
    odd = simhash.without_near_duplicates(odd_docs(spark))
    assert odd.columns == odd_docs(spark).columns
    assert Counter(x.text for x in odd.collect())["a b c d e f"] == 1
    assert simhash.without_near_duplicates(docs(spark, [])).count() == 0


def test_clashing_names(spark):
    """Columns with the names that operators use inside stay, and nothing is ambiguous."""
    names = ["_row", "_prints", "_gone", "_kept", "_h", "_p", "_s", "_n", "_evidence", "_host", "_path", "row", "rank", "h", "p", "e", "rest", "id", "size", "slot", "doc", "score", "_score"]
    table = docs(spark, ["a b c d e f", None, "", "a b c d e f", "x y"]).drop("score", "_row").select("*", *[F.lit(n).alias(n) for n in names])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (
        simhash.without_near_duplicates(table),
        quality.judge(table, none, F.col("source"), F.col("lang")),
        toxicity.judge(table, none),
        mixing.mix(table),
    ):
        rows = out.collect()
        assert out.columns[: len(table.columns)] == table.columns and len(rows) >= 3 and all(r["_gone"] == "_gone" and r["h"] == "h" for r in rows)


def test_equal_prints_of_different_texts_both_stay(spark):
    r = random.Random(5)
    line = " ".join(f"menu{i}" for i in range(9))
    texts = [" ".join([line] * 100 + [f"own{r.randrange(10**6)}" for _ in range(150)]) for _ in range(4)]
    assert len({tuple(simhash._majorities(t.encode(), 2, 2)) for t in texts}) == 1
    kept = [x.doc_id for x in simhash.without_near_duplicates(docs(spark, [*texts, texts[0].replace(" ", "  ").upper()])).collect()]
    assert sorted(kept) == [0, 1, 2, 3]


def kept_by_all_pairs(texts, similarity=0.8):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and simhash.jaccard(texts[i].encode(), texts[j].encode(), 5) >= similarity:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    return set(root)


def test_cut_appended_and_replaced_copies_go(spark):
    r = random.Random(11)
    some = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    texts, line = [], {x: " ".join(f"{x}{i}" for i in range(9)) for x in "ab"}
    for _ in range(40):
        b = some(500)
        at = r.randrange(440)
        texts += [" ".join(x) for x in (b, b[:405], some(500) + some(9))] + [" ".join(some(500))]
        b = some(500)
        texts += [" ".join(x) for x in (b, b + some(115))]
        b = some(500)
        texts += [" ".join(x) for x in (b, b[:at] + some(48) + b[at + 48 :])]
    b = some(400)
    texts += [" ".join(b + [line[x]] * 60) for x in "ab"]
    kept = {x.doc_id for x in simhash.without_near_duplicates(docs(spark, texts)).collect()}
    assert kept == kept_by_all_pairs(texts)


def test_similar_pairs_inside_a_template_are_found(spark, monkeypatch):
    """Documents of one template, of which a few pairs are similar enough; groups of a shingle take several blocks."""
    monkeypatch.setattr(simhash, "GROUP", 16)
    r = random.Random(12)
    template = [f"t{i}" for i in range(170)]
    texts = [" ".join([f"o{r.randrange(10**6)}" for _ in range(24)] + template) for _ in range(300)]
    for i in range(0, 60, 3):
        words = texts[i].split()
        texts.append(" ".join([f"p{r.randrange(10**6)}" for _ in range(14)] + words[14:]))
    want = kept_by_all_pairs(texts)
    assert 300 <= len(want) < 320
    kept = {x.doc_id for x in simhash.without_near_duplicates(docs(spark, texts)).collect()}
    assert kept == want


# token ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    path = public_tokenizers.path(name)
    library, mine = Tokenizer.from_file(path), encoding.encoder(path)
    texts = ["", "  a  b \n\n c|d | e  ", "x", "  ", "\n|", "don't  we'll <|endoftext|> ok", "ünï\tx\r\ny  ", "a | b", " a b", "a\x0bb", "|||", "日本語 text", "İstanbul ΣΑΣ", "é x", LONG[:5000]]
    r = random.Random(4)
    texts += ["".join(r.choice(" \n\t|aB'é7.-<>") for _ in range(60)) for _ in range(200)]
    for t in texts:
        assert mine.encode(t) == np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(t)
    assert mine.encode(None) == b""


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001, dtype=np.uint64).astype("<u4")
    packed = token_files.pack_bits(ids, bits)
    assert len(packed) == -(-1001 * bits // 8) and (token_files.unpack_bits(packed, 1001, bits) == ids).all()


def test_file_random_access(tmp_path):
    r = np.random.default_rng(1)
    parts = [r.integers(0, 49000, n, dtype=np.uint32) for n in (1, 5000, 0, 4096, 9000)]
    path = tmp_path / "f.bits"
    path.write_bytes(token_files.file_bytes([3, None, 4, 5, 6], [p.tobytes() for p in parts], 17))
    with open(path, "rb") as handle:
        file = token_files.TokenFile(handle)
        whole = np.concatenate(parts)
        for i, p in enumerate(parts):
            assert (file.document(i) == p).all()
        for a, b in ((0, 1), (4095, 4097), (5000, 5001), (0, len(whole)), (17000, 18000), (7, 7)):
            assert (file.span(a, b) == whole[a:b]).all()


def test_token_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 500)
    table, scratch = odd_docs(spark), Scratch(spark, "t")
    path = public_tokenizers.path(token_files.VOCABULARY)
    manifest = scratch.save(token_files.write(table, scratch.path("files"), path))
    out = sorted(token_files.read(manifest, scratch.path("files")).collect(), key=lambda r: r.start)
    library, at = Tokenizer.from_file(path), 0
    want = sorted(((r.doc_id, r.text) for r in table.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    assert len(out) == 9
    for r, (i, t) in zip(out, want):
        ids = library.encode(t or "", add_special_tokens=False).ids + [token_files.END]
        assert (r.doc_id, r.start, bytes(r.ids)) == (i, at, np.array(ids, dtype="<u4").tobytes())
        at += len(ids)
    assert scratch.save(token_files.write(docs(spark, []), scratch.path("none"), path)).count() == 0


def test_attempts_of_a_task_write_files_of_their_own(spark):
    table, scratch, path = docs(spark, ["a b", "c"]), Scratch(spark, "t"), public_tokenizers.path(token_files.VOCABULARY)
    folder = scratch.path("files")
    first, second = (scratch.save(token_files.write(table, folder, path)) for _ in range(2))
    names = [{r.path for r in m.collect()} for m in (first, second)]
    assert not names[0] & names[1]
    assert token_files.tidy(second, folder) == len(names[0]) and token_files.tidy(second, folder) == 0
    assert token_files.read(second, folder).count() == 2


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_remembered_chunks_equal_whole_texts(name, monkeypatch):
    monkeypatch.setattr(encoding, "CACHE_CHUNKS", 40)
    library, own, r = Tokenizer.from_file(public_tokenizers.path(name)), encoding.ChunkEncoder(public_tokenizers.path(name)), random.Random(3)
    words = ["the", "|", "a|b", "don't", "Été", "x" * 300, "12", "%%%", "漢字", "\r", "<|endoftext|>", "\u00a0"]
    for _ in range(400):
        text = "".join(r.choice(words) + r.choice(["", " ", "  ", "\n", "\t "]) for _ in range(r.randint(0, 12)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


# packing


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_sweep_gives_each_piece_its_successor():
    r = random.Random(2)
    for _ in range(200):
        rows = sorted(((r.randint(1, 30), r.random() < 0.6) for _ in range(r.randint(0, 60))), key=lambda x: (-x[0], x[1]))
        sizes, pieces = np.array([x[0] for x in rows], dtype=int), np.array([x[1] for x in rows], dtype=bool)
        mate = packing.sweep(sizes, pieces)
        free, want = [], [-1] * len(rows)
        for i, piece in enumerate(pieces):  # one after another: the smallest gap left that holds the piece
            if not piece:
                free.append(i)
            elif free:
                want[i] = free.pop()
                want[want[i]] = i
        assert mate.tolist() == want


def test_what_ranges_leave_is_matched_with_earlier_ranges():
    got = packing.carried({0: (2, 3), 1: (1, 2), 2: (6, 1), 4: (1, 0)})
    # the first range's pieces find nothing; the second takes the first's last gap; the third both of the second's, then what is left
    assert got == [(1, 0, 1, 0, 2), (2, 0, 2, 1, 1), (2, 2, 4, 0, 1), (4, 0, 1, 2, 0)]


@pytest.mark.parametrize("kind, range_rows", [("mixed", 50), ("mixed", 1 << 17), ("small", 90), ("large", 50), ("equal", 50)])
def test_packing_is_as_good_as_best_fit_decreasing(spark, kind, range_rows):
    r = random.Random(kind)
    draw = {"mixed": lambda: r.choice((r.randint(1, 100), r.randint(1, 40), 50, 33)), "small": lambda: r.randint(1, 12), "large": lambda: r.randint(30, 100), "equal": lambda: 26}[kind]
    lengths = [draw() for _ in range(600)]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(lengths)], "id long, length int, offset string").repartition(5)
    steps: list = []
    out = packing.pack(df, 100, order=("id",), range_rows=range_rows, steps=steps).toPandas().sort_values(["sequence_id", "offset"])
    assert sorted(out["id"]) == list(range(600)) and dict(zip(out["id"], out["length"])) == dict(enumerate(lengths))
    before = out.groupby("sequence_id")["length"].cumsum() - out["length"]
    assert (before == out["offset"]).all() and out.groupby("sequence_id")["length"].sum().max() <= 100
    best = best_fit_decreasing(lengths, 100)
    assert best <= out["sequence_id"].nunique() + 1 and out["sequence_id"].nunique() <= best * 1.01 + 1
    assert len(steps) >= 2 or kind == "equal"


@pytest.mark.parametrize("kind", ["mixed", "small", "large", "equal", "many alike"])
def test_packing_by_size_is_best_fit_decreasing(spark, kind):
    r = random.Random(kind)
    draw = {"mixed": lambda: r.choice((r.randint(1, 100), r.randint(1, 40), 50, 33)), "small": lambda: r.randint(1, 12), "large": lambda: r.randint(30, 100), "equal": lambda: 26, "many alike": lambda: r.choice((3, 40, 41))}[kind]
    lengths = [draw() for _ in range(600)]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(lengths)], "id long, length int, offset string").repartition(5)
    out = packing.pack_by_size(df, 100, order=("id",)).toPandas().sort_values(["sequence_id", "offset"])
    assert sorted(out["id"]) == list(range(600)) and dict(zip(out["id"], out["length"])) == dict(enumerate(lengths))
    before = out.groupby("sequence_id")["length"].cumsum() - out["length"]
    assert (before == out["offset"]).all() and out.groupby("sequence_id")["length"].sum().max() <= 100
    assert out["sequence_id"].nunique() == best_fit_decreasing(lengths, 100)


def test_plans_of_best_fit_follow_sizes_not_pieces():
    r = random.Random(8)
    for _ in range(60):
        lengths = [r.randint(1, r.choice((9, 30, 64))) for _ in range(r.randint(0, 300))]
        plan, counts = packing.best_fit(Counter(lengths), 64), sorted(lengths, reverse=True)
        filled = Counter()
        for (first, size, each, sequence, offset), end in zip(plan, [*(p[0] for p in plan[1:]), len(lengths)]):
            assert set(counts[first:end]) == {size}
            for i in range(end - first):
                assert filled[sequence + i // each] == offset + size * (i % each)
                filled[sequence + i // each] += size
        assert max(filled.values(), default=0) <= 64 and len(filled) == best_fit_decreasing(lengths, 64)
    few, many = (packing.best_fit({n: times * (1 + n * 7919 % 5000) for n in range(1, 1025)}, 1024) for times in (1, 10_000))
    assert len(few) < 40_000 and len(many) < 40_000


def test_packing_takes_few_jobs(spark):
    table, seen = docs(spark, [" ".join(f"w{i * j}" for j in range(i % 400)) for i in range(1200)]), []
    spark.sparkContext.setJobGroup("few jobs", "")
    try:
        assert packing.pack_documents(table).count() >= 1200
        seen = spark.sparkContext.statusTracker().getJobIdsForGroup("few jobs")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(seen) <= 10  # with plans and code of each, which the driver keeps; some 6 a superstep before


def test_numbered_words_equal_whole_texts(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own, r = Tokenizer.from_file(path), byte_words.WordEncoder(path), random.Random(4)
    monkeypatch.setattr(byte_words, "MOST_WORDS", 900)
    monkeypatch.setattr(byte_words, "TOGETHER", 500)
    words = ["the", "|", "a|b", "don't", "I'LL'll", "Été", "x" * 300, "12", "3²½", "%%%", "漢字", "\r", "<|endoftext|>", "\u00a0", "\x0b", "\x1c", "\x7f", "“so” – it’s…", "naïve×2", "_a_1_", "ŉǅɏʼn"]
    texts = ["".join(r.choice(words) + r.choice(["", " ", "  ", "\n", "\t ", " \r\n"]) for _ in range(r.randint(0, 12))) for _ in range(600)]
    texts += [None, "", *map(chr, range(0x250)), *(f"a{chr(c)}1 {chr(c)}{chr(c)}." for c in [*range(0x250), *range(0x2000, 0x2070)])]
    for text, ids in zip(texts, own.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_a_word_is_encoded_once_whatever_follows_it():
    own = byte_words.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    list(own.encode_all(["so", " verbena, verbena. verbena! verbena", " verbena; (verbena)"]))
    assert [w for w in own.words if "verbena" in w] == [" verbena", "verbena"]


def test_packing_documents(spark):
    table = odd_docs(spark)
    path = public_tokenizers.path(packing.VOCABULARY)
    pieces = packing.tokenised_pieces(table, path)
    packed = packing.pack(pieces, order=("doc_id", "piece"))
    library = Tokenizer.from_file(path)
    rows = packed.toPandas()
    whole = {t: library.encode(t or "", add_special_tokens=False).ids + [2] for t in [LONG, None]}
    long = rows[rows["doc_id"] == 4].sort_values("piece")
    assert b"".join(map(bytes, long["ids"])) == np.array(whole[LONG], dtype="<u4").tobytes()
    assert set(long["length"].iloc[1:]) == {1024} and long["length"].iloc[0] == len(whole[LONG]) % 1024
    assert rows[rows["doc_id"] == 1]["length"].tolist() == [1]
    sequences = packing.packed_sequences(packed).toPandas()
    assert (sequences["ids"].map(len) == 4 * sequences["length"]).all() and sequences["length"].sum() == rows["length"].sum()
    digest = packing.pack_documents(table).toPandas()
    assert sorted(digest["ids_crc32"]) == sorted(zlib.crc32(bytes(x)) for x in rows["ids"])
    assert packing.pack_documents(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(5,)], "length int"), 4)


# embeddings


def brute_links(rows):
    links = Counter()
    unit = {i: (l, np.array(v, dtype=float)) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    pairs = []
    keys = sorted(unit)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            (la, x), (lb, y) = unit[a], unit[b]
            if la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[a] += 1
                links[b] += 1
                pairs.append((a, b))
    component = {i: i for i, *_ in rows}
    for _ in range(len(rows)):
        for a, b in pairs:
            component[a] = component[b] = min(component[a], component[b])
    return {i: (links[i], component[i], component[i] == i) for i, *_ in rows}


def test_embedding_links_against_brute_force(spark):
    g = np.random.default_rng(11)
    rows = []
    for i in range(400):
        v = g.normal(size=16)
        if i % 4 == 1:
            v = np.array(rows[-1][1]) + g.normal(size=16) * 0.02
        rows.append((i, v.tolist(), i // 4 % 3))
    centre = g.normal(size=16)
    rows += [(400 + i, (centre + g.normal(size=16) * 0.05).tolist(), 1) for i in range(90)]
    rows += [(500, rows[0][1], rows[0][2]), (501, rows[0][1], 2 - rows[0][2]), (502, None, 1), (503, [0.0] * 16, 1), (504, [None] * 16, 1), (505, rows[0][1], None), (506, [float("inf")] * 16, 1), (507, (np.array(rows[0][1]) * 3).tolist(), rows[0][2])]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.collect()} == brute_links(rows)


def test_clumps_whose_lists_are_full_of_their_own_are_linked(spark):
    """Two clumps of more vectors than a list holds, close inside and linked to one another, beside one that is out of reach."""
    g = np.random.default_rng(12)
    unit = lambda x: x / np.linalg.norm(x)
    a = unit(g.normal(size=32))
    aside = unit(g.normal(size=32) - (g.normal(size=32) @ a) * a)
    aside = unit(aside - (aside @ a) * a)
    centres = [a, np.cos(0.17) * a + np.sin(0.17) * aside, np.cos(0.6) * a + np.sin(0.6) * aside]
    rows = [(i, (centres[i % 3] + g.normal(size=32) * 0.002).tolist(), 1) for i in range(240)]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.collect()}
    assert got == brute_links(rows) and len({x[1] for x in got.values()}) == 2


def test_embedding_edge_tables(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    out = embedding_dedup.near_duplicates(spark.createDataFrame([(1, None, 1), (2, [0.0], 1)], kind)).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in out} == {(1, 0, 1, True), (2, 0, 2, True)}


# mixing


def spliced(shares, slots, span):
    """The spans' schedules put together: a slot is the earliest span's that reaches it."""
    out = {}
    for number in range(-(-slots // span)):
        for row in mixing.span_schedule(shares, number * span, (number + 1) * span, slots):
            out.setdefault(row[2], row)
    return [out[slot] for slot in range(slots)]


def test_schedule_keeps_every_window_and_target():
    r = random.Random(3)
    for _ in range(150):
        shares = [r.choice([r.randint(1, 10), r.randint(1, 10**6), 1]) for _ in range(r.randint(1, 25))]
        slots, total, done = r.randint(1, 1500), sum(shares), [0] * len(shares)
        for source, block, slot, release, deadline in spliced(shares, slots, r.choice([1, 7, 64, 500])):
            assert block == done[source]
            assert release == block * total // shares[source] <= slot < deadline == -(-(block + 1) * total // shares[source])
            done[source] += 1
            assert all(abs(done[i] * total - (slot + 1) * w) < total for i, w in enumerate(shares))


def test_schedule_keeps_the_target_over_a_million_slots():
    sizes = [1_500_000] * 3 + [1, 5, 300, 100_000]
    shares = mixing.whole(list(mixing.tempered(dict(enumerate(sizes))).values()))
    total, done, worst = sum(shares), [0] * len(shares), 0
    for source, _, slot, _, _ in spliced(shares, 1_000_000, 1 << 14):
        done[source] += 1
        worst = max(worst, abs(done[source] * total - (slot + 1) * shares[source]))
        if slot % 1000 == 999:
            assert all(abs(n * total - (slot + 1) * w) < total for n, w in zip(done, shares))
    assert worst < total and done[3] <= 1


def slow_mix(rows, weights, block):
    """Mixes (doc, source) rows one slot after another, in exact fractions."""
    from fractions import Fraction

    of = {s: [d for d, own in rows if own == s] for s in weights}
    share = {s: Fraction(w) / sum(map(Fraction, weights.values())) for s, w in weights.items()}
    slots = max(math.ceil(-(-len(of[s]) // block) / share[s]) for s in weights)
    names, done, out = sorted(weights, key=lambda s: (s is not None, s)), Counter(), []
    for slot in range(slots):
        ready = [(math.ceil((done[s] + 1) / share[s]), i, s) for i, s in enumerate(names) if math.floor(done[s] / share[s]) <= slot]
        s = min(ready)[2]
        out += [(of[s][(done[s] * block + i) % len(of[s])], slot) for i in range(block)]
        done[s] += 1
    return out


def test_mix_against_one_slot_after_another(spark):
    rows = [(i, "hot" if i % 3 else None if i % 2 else "rare", "x") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    weights = {"hot": 0.5, "rare": 0.3, None: 0.2}
    out = mixing.mix(df, weights=weights, block=4)
    got = sorted(out.collect(), key=lambda r: r.position)
    assert [(r.doc_id, r["slot_"]) for r in got] == slow_mix([r[:2] for r in rows], weights, 4)
    assert [r.position for r in got] == list(range(len(got))) and {r.doc_id for r in got} == set(range(300))
    assert all(r.release <= r["slot_"] < r.deadline for r in got)
    assert out.columns[:3] == ["doc_id", "source", "slot"] and "slot_" in out.columns
    spans = mixing.mix(df, weights=weights, block=1, span=16)
    tasks = Counter(r.source for r in spans.collect())
    assert all(abs(n - spans.count() * w) < 1 for n, w in ((tasks[s], w) for s, w in weights.items()))
    with pytest.raises(ValueError):
        mixing.mix(df, weights={"hot": 1.0})
    assert mixing.mix(df, weights={"hot": 1.0}, strict=False).where("source <> 'hot'").count() == 0
    assert mixing.mix(df.limit(0)).count() == 0
    assert {r.text for r in mixing.mix(odd_docs(spark)).collect()} == {r.text for r in odd_docs(spark).collect()}


def test_a_tiny_source_is_repeated_as_often_as_its_weight_asks(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3, "tiny").otherwise("large").alias("source"))
    counts = {r["source"]: r["count"] for r in mixing.mix(df).groupBy("source").count().collect()}
    share = 3**0.9 / (3**0.9 + 3997**0.9)
    assert abs(counts["tiny"] - share * sum(counts.values())) < mixing.BLOCK


# toxicity


def slow_score(machine, terms):
    z = machine.base + sum(float(machine.weights[t]) for t in terms)
    for i, a in enumerate(terms):
        z += sum(float(x) * float(y) for b in terms[:i] for x, y in zip(machine.factors[a], machine.factors[b])) / len(terms)
    return 1 / (1 + math.exp(-z))


def test_scores_against_the_sum_over_pairs():
    g = np.random.default_rng(4)
    machine = toxicity.Machine(-1.0, g.normal(size=toxicity.BUCKETS).astype("f4"), g.normal(size=(toxicity.BUCKETS, toxicity.FACTORS)).astype("f4"))
    for n in (0, 1, 2, 30):
        terms = np.unique(g.integers(0, toxicity.BUCKETS, n))
        assert abs(machine.score(terms) - slow_score(machine, terms.tolist())) < 1e-5


def test_terms_are_whole_words_and_prefixes():
    terms, slow = toxicity.term_finder(), set()
    for word in ["insults", "insult", "a"]:
        for term in [word] + ["^" + word[:n] for n in (4, 5, 6) if len(word) >= n]:
            slow.add(xxhash.xxh64_intdigest(term) % toxicity.BUCKETS)
    assert set(terms("Insults, INSULT a?").tolist()) == slow and set(terms("a insult insults").tolist()) == slow
    assert len(terms(None)) == len(terms("12 !")) == 0


def test_pairs_are_learned_of_terms_that_are_neutral_alone(spark):
    """Toxic is the insult with the group and the praise without it: each word is in as many toxic texts as clean ones."""
    r = random.Random(5)
    rows = []
    for i in range(1600):
        insult, group = r.random() < 0.5, r.random() < 0.5
        words = ["vile" if insult else "fine", "they" if group else "none"] + [f"w{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}" for _ in range(20)]
        r.shuffle(words)
        rows.append((i, " ".join(words), int(insult == group)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    learned = table.where("doc_id < 1200").select("doc_id", "toxic")
    machine = toxicity.fit(Scratch(spark, "t"), table, learned)
    terms = toxicity.term_finder()
    right = [(machine.score(terms(t)) >= 0.5) == bool(y) for _, t, y in rows[1200:]]
    assert sum(right) / len(right) > 0.9
    for word in ("vile", "fine", "they", "none"):
        own = [y for _, t, y in rows if word in t.split()]
        assert abs(sum(own) / len(own) - 0.5) < 0.05


def test_toxicity_held_out_accuracy(spark, duck):
    sf = "/root/testdata/sf0.1"
    out = toxicity.op8_toxicity(spark, sf).toPandas().merge(duck("sf0.1", "SELECT doc_id, toxic FROM labels"), on="doc_id")
    held = out[out["held_out"]]
    hits = ((held["predicted"] == 1) & (held["toxic"] == 1)).sum()
    assert hits / held["predicted"].sum() > 0.9 and hits / held["toxic"].sum() > 0.75
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == h for i, h in zip(out["doc_id"], out["held_out"]))


def test_toxicity_of_odd_rows(spark):
    table = odd_docs(spark).union(docs(spark, ["you vile moron"] * 20 + ["a nice day"] * 20, 100))
    labels = spark.createDataFrame([(100 + i, int(i < 20)) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    out = toxicity.judge(table, labels)
    got = {r.doc_id: r["score_"] for r in out.collect()}
    assert out.count() == 49 and got[100] > 0.7 > got[139] and all(0 <= s <= 1 for s in got.values())
    assert toxicity.judge(odd_docs(spark), labels.limit(0)).where("score_ <> 0").count() == 0


# pages


def test_pages_of_other_layouts_are_read():
    field, right, wrong = html_extract.trained(), 0, 0
    for html in html_extract.labelled_pages(120, 99):
        chain = html_extract.labelled_chain(html)
        found = np.array(field.decode(chain[0]))
        right, wrong = right + (found == chain[1]).sum(), wrong + (found != chain[1]).sum()
    assert right / (right + wrong) > 0.99


def test_viterbi_against_all_paths():
    g = np.random.default_rng(3)
    field = html_extract.Field(g.normal(size=(html_extract.BUCKETS, 2)), g.normal(size=(2, 2)))
    rows = [np.array([i, i + 9]) for i in range(8)]
    s = field.scores(rows)
    best = max(range(256), key=lambda p: sum(s[i, p >> i & 1] for i in range(8)) + sum(field.move[p >> i & 1, p >> i + 1 & 1] for i in range(7)))
    assert field.decode(rows) == [best >> i & 1 for i in range(8)]


def test_blocks_and_rows(spark):
    html = "<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p><b>One\n two<br>three.<p>Four &copy; five.</article><footer>&copy; x</footer>"
    df = spark.createDataFrame([(1, "u", html), (2, None, None), (3, "v", ""), (None, "w", "<p"), (1, "u", html)], "page_id long, url string, html string")
    out = df.select("page_id", html_extract.extract(F.col("html")).alias("text")).collect()
    assert [r.text for r in out if r.page_id == 1] == ["A & B\nOne two three.\nFour © five."] * 2
    assert {r.page_id: r.text for r in out}[2] == "" and len(out) == 5
    assert [b.text for b in html_extract.leaf_blocks("<![x <p>a</p><div>" + "deep <b>" * 3000)][0] in ("a", "<![x")


@pytest.mark.parametrize("html, want", [
    ("<p>one <svg/> two</p>", ["one two"]),
    ("<article><p>a</p><math/><p>b</p></article>", ["a", "b"]),
    ("<p>x <svg viewBox='0 0 1 1'><path d='M0'/><text>no</text></svg> y</p>", ["x y"]),
    ("<html><head><title>t</title><meta charset=utf-8><p>first</p><p>second", ["first", "second"]),
    ("<head><title>t</title>plain text", ["plain text"]),
    ("<head><script>var a = '<p>no</p>'</script><style>p {}</style></head><body><div/>text<p/>more", ["text", "more"]),
])
def test_nothing_is_hidden_by_elements_that_end(html, want):
    assert [b.text for b in html_extract.leaf_blocks(html)] == want


def test_op9_on_the_pages(spark, duck):
    import html as entities
    import re

    out = {r.page_id: r for r in html_extract.op9_html_main_text(spark, "/root/testdata/sf0.001").collect()}
    for page_id, html in duck("sf0.001", "SELECT page_id, html FROM pages").itertuples(index=False):
        inside = re.search(r"<article>(.*?)</article>", html, re.S).group(1)
        parts = re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", re.sub(r"</?(p|h1)>", "\x01", inside))).split("\x01")
        want = "\n".join(t for t in (" ".join(entities.unescape(p).split()) for p in parts) if t)
        assert out[page_id].text == want and out[page_id].n_chars == len(want)


# licences


def slow_scan(text):
    import re

    out = set()
    units = [("line", i, u) for i, u in enumerate(text.split("\n"))]
    paragraphs = re.split(r"\n[ \t\r]*\n", text)
    units += [("paragraph", i, u) for i, u in enumerate(paragraphs) if "\n" in u]
    units += [("document", 0, text)] if len(paragraphs) > 1 else []
    pairs = licences.template_sizes(licences.TEMPLATES)
    for scope, i, unit in units:
        words = re.sub(r"[\W_]+", " ", unit.lower()).strip().split(" ")
        own = set(zip(words, words[1:]))
        for name, b in pairs.items():
            b = {tuple(x.split(" ")) for x in b}
            if own and (dice := 2 * len(own & b) / (len(own) + len(b))) >= 0.8:
                out.add((scope, i, name, round(dice, 6)))
    return out


def test_licences_against_brute_force(spark):
    mit = licences.TEMPLATES["mit-text"]
    texts = ["intro\nLicensed under CC BY-NC 4.0.\nend", "Released under the MIT License!!", "under the license", "a\n\n" + mit.replace(", ", ",\n") + "\n\nb", mit, None, "", LONG, "Licensed under the Apache License Version 2.0 today\n \nx", "one"]
    out = licences.scan(docs(spark, texts).union(docs(spark, ["Released under the MIT License."], 1)))
    want = Counter((i, *m) for i, t in [*enumerate(texts), (1, "Released under the MIT License.")] if t for m in slow_scan(t))
    assert Counter(tuple(r) for r in out.collect()) == want and len(want) >= 5
    assert licences.scan(docs(spark, [])).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>a</p><!--><p>b</p>", ["a", "b"]),
        ("<p>a</p><!---><p>b</p>", ["a", "b"]),
        ("<p>a</p><!-- ad slot 12 --!><p>b</p>", ["a", "b"]),
        ("<p>a</p><!-- <b>hidden</b> --><p>b</p>", ["a", "b"]),
        ("<p>a<!-- open <b>c", ["a"]),
        ("<p title='<!--'>a</p><p>b</p>", ["a", "b"]),
        ("<script>var x = '<!--';</script><p>b</p>", ["b"]),
        ("<p>it's <!-- one --> here's</p>", ["it's here's"]),
    ],
)
def test_comments_leave_nothing(html, want):
    assert [b.text for b in html_extract.leaf_blocks(html)] == want


def test_rows_among_numbers_keep_their_place(spark):
    scratch = Scratch(spark, "test")
    rows = spark.range(0, 1000, 1, 7).withColumn("n", F.monotonically_increasing_id())
    some = rows.where("id % 3 = 0 or id > 990").select("n")
    want = {i for i in range(1000) if i % 3 == 0 or i > 990}
    for most in (1 << 20, 1):
        found = among(scratch, rows, "n", some, most=most)
        assert found.columns == ["id", "n"] and {r.id for r in found.collect()} == want
        assert {r.id for r in among(scratch, rows, "n", some, False, most).collect()} == set(range(1000)) - want
    assert "Exchange hashpartitioning" not in among(scratch, rows, "n", some)._jdf.queryExecution().executedPlan().toString()


def test_pairs_in_rounds_give_the_components_of_all(spark, monkeypatch):
    """A group of near copies costs a few pairs a text; pairs that are refuted hide no later one."""
    monkeypatch.setattr(simhash, "FEW_PAIRS", 3)
    true = {(u, v) for u in range(30) for v in range(u + 1, 30)} | {(40, 41), (41, 42), (29, 43)}
    false = {(u, v) for u in range(30, 44) for v in range(u + 1, 44)} - true
    pairs = [(u, v, u, v, 9 if (u, v) in false else 1) for u, v in sorted(true | false)]
    scratch, seen = Scratch(spark, "test"), []

    def links(chosen):
        rows = chosen.select("u", "v", "a", "b").collect()
        seen.extend((r.u, r.v) for r in rows)
        return spark.createDataFrame([(r.a, r.b) for r in rows if (r.u, r.v) in true], "a long, b long")

    parts = scratch.save(spark.range(45).select(F.col("id").alias("r"), F.col("id").alias("c")))
    table = scratch.save(spark.createDataFrame(pairs, "u long, v long, a long, b long, shared long"))
    found = {r.r: r.c for r in simhash.linked_parts(scratch, parts, table, links).collect()}
    assert found == {i: 0 if i < 30 or i == 43 else 40 if 40 <= i < 43 else i for i in range(45)}
    assert len(seen) == len(set(seen)) and len(true & set(seen)) < len(true) / 2


def test_sketches_rule_out_pairs_before_texts_are_read(spark):
    """Pairs that share a first shingle and no more than that are no candidates; all similar ones are."""
    scratch = Scratch(spark, "test")
    r = random.Random(4)
    base = [[f"w{r.randrange(10**6)}" for _ in range(200)] for _ in range(3)]
    near = base[0][:190] + [f"x{i}" for i in range(10)]
    # half of the words in common: every shingle of that half may be among the first
    half = [base[1][:100] + [f"{k}y{i}" for i in range(100)] for k in range(4)]
    texts = [" ".join(t).encode() for t in (*base, near, *half)]
    rows = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "r long, t binary")
    parts = spark.range(len(texts)).select(F.col("id").alias("r"), F.col("id").alias("c"))
    found = simhash.similar_candidates(scratch, rows, parts, 0.8, 5).collect()
    assert {(x.u, x.v) for x in found} == {(0, 3)}


def test_the_trees_candidates_are_confirmed_in_rounds(spark, monkeypatch):
    """In a group of near copies fewer pairs are confirmed than the tree gives, and one text is kept of each group as ever."""
    r = random.Random(6)
    groups = [[f"w{r.randrange(10**6)}" for _ in range(150)] for _ in range(3)]
    texts = [" ".join([*g[:149], f"{n}x{i}"]) for n, g in enumerate(groups) for i in range(25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept, counts = {}, {}
    linked = simhash.linked_parts
    for few in (1 << 16, 20):
        monkeypatch.setattr(simhash, "FEW_PAIRS", few)
        seen = counts[few] = []

        def counting(scratch, parts, pairs, links, seen=seen):
            return linked(scratch, parts, pairs, lambda chosen: [seen.append(chosen.count()), links(chosen)][1])

        monkeypatch.setattr(simhash, "linked_parts", counting)
        kept[few] = sorted(x.doc_id for x in simhash.without_near_duplicates(docs).collect())
    assert kept[20] == kept[1 << 16] == [0, 25, 50]
    assert sum(counts[20]) < sum(counts[1 << 16])
