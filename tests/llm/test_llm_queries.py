"""The registered queries against SQL or brute force over whole tables, and the pipeline."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import mixing, quality, simhash, toxicity
from millrace.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_a_query_for_each_operator():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, same, name):
    same(QUERIES[name](spark, SF).toPandas(), duck("sf0.001", ORACLE_SQL[name]))


def test_simhash_against_all_pairs(spark, duck):
    out = QUERIES["op3_simhash_near_dedup"](spark, SF).toPandas().set_index("doc_id")
    docs = duck("sf0.001", "SELECT doc_id, text FROM documents")
    prints = {i: simhash.fingerprint(t.encode()) for i, t in docs.itertuples(index=False)}
    assert all(out.loc[i, "fingerprint"] == f"{p:016x}" for i, p in prints.items())
    component = {i: i for i in prints}
    pairs = [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2]
    for _ in range(20):
        for a, b in pairs:
            component[a] = component[b] = min(component[a], component[b])
    assert out["component_id"].to_dict() == component


def test_pipeline_stages(spark, duck):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    truth = duck("sf0.001", "SELECT doc_id, quality, toxic FROM labels").set_index("doc_id")
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, SF).persist()
        ids, old = Counter(r.doc_id for r in kept.select("doc_id").collect()), {r.doc_id for r in before.select("doc_id").collect()}
        assert set(ids) <= old
        if name != "packing":
            assert kept.columns == columns
        if name == "toxicity":
            judged = toxicity.judge(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(ids) == {r.doc_id for r in judged.where("score < 0.7").collect()}
        elif name == "quality":
            assert not [i for i in ids if i in truth.index and truth.loc[i, "quality"] == 0]
            assert quality.THRESHOLD == 0.5
        elif name == "near_duplicates":
            texts = {r.doc_id: r.text.encode() for r in before.collect()}
            alike = [(a, b) for a in texts for b in texts if a < b and simhash.jaccard(texts[a], texts[b], 5) >= 0.8]
            component = {i: i for i in texts}
            for _ in range(20):
                for a, b in alike:
                    component[a] = component[b] = min(component[a], component[b])
            assert set(ids) == {i for i, c in component.items() if i == c} and set(ids.values()) == {1}
        elif name == "mixing":
            sizes = Counter(r.source for r in before.collect())
            weights = mixing.tempered(sizes)
            counts, total = Counter(r.source for r in kept.collect()), sum(ids.values())
            assert set(ids) == old and all(abs(counts[s] - total * w / sum(weights.values())) < mixing.BLOCK for s, w in weights.items())
        else:
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            tokens = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in before.collect()}
            rows = kept.toPandas()
            copies = Counter(r.doc_id for r in before.collect())
            assert rows.groupby("doc_id")["length"].sum().to_dict() == {i: n * copies[i] for i, n in tokens.items()}
            used = rows.groupby("sequence_id")["length"].sum()
            assert used.max() <= 1024 and len(used) <= np.ceil(rows["length"].sum() / 1024) * 1.05 + 2
    assert corpus_pipeline.run(spark, SF).count() == kept.count()


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
        docs = docs if "text" in docs.columns else None


def test_pipeline_of_odd_rows(spark):
    """Null texts, ids and sources, empty and very long texts, repeated rows and clashing names, through every stage."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(0, "a b c d e f", "en", "s0", 11), (1, None, "en", "s1", 0), (2, "", "en", None, 0), (3, long, None, "s0", len(long)), (0, "a b c d e f", "en", "s0", 11), (None, "no id here at all", None, None, None), (7, "A  B c\nd e f", "en", "s1", 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("score", "quality_score", "slot", "_row", "_gone", "h", "site_prior", "sequence_id"):
        docs = docs.withColumn(name, F.lit(name))
    columns = docs.columns
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        if name == "quality":
            judged = stage(spark, docs, SF)
            assert judged.columns == columns and {r.text for r in judged.collect()} <= {r[1] for r in rows}
            continue  # short and empty texts are no good ones; the next stages get all rows
        docs = stage(spark, docs, SF).persist()
        found[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns and all(r["slot"] == "slot" for r in found[name])
    assert len(found["toxicity"]) == 7
    assert Counter(r.text for r in found["near_duplicates"]) == {"a b c d e f": 1, None: 1, long: 1, "no id here at all": 1}
    assert {r.text for r in found["mixing"]} == {r.text for r in found["near_duplicates"]}
    whole = Counter(r.doc_id for r in found["mixing"])
    assert Counter(r.doc_id for r in found["packing"] if r.piece == 0) == whole


def test_jobs_of_the_packing_stage_do_not_follow_its_rows(spark):
    jobs = []
    for n in (40, 1500):
        table = spark.createDataFrame([(i, " ".join(f"w{i * j}" for j in range(i * 7 % 300))) for i in range(n)], "doc_id long, text string")
        spark.sparkContext.setJobGroup(f"packing {n}", "")
        try:
            corpus_pipeline.packing_stage(spark, table, "").write.format("noop").mode("overwrite").save()
            jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"packing {n}")))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[0] == jobs[1] <= 10
