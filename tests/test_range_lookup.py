"""The interval index against every pair."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import lookup as L


@pytest.mark.parametrize("n", [3, 40, 700])
def test_best_in_range_equals_all_pairs(spark, n, monkeypatch):
    monkeypatch.setattr(L, "INDEX_BIN", 4)
    r = random.Random(n)
    right = [(r.choice(["a", "a", "a", "b", "", None]), r.choice([None, *range(60)]), r.randrange(9), i, "x") for i in range(n)]
    left = []
    for i in range(150):
        low = r.choice([None, *range(-5, 65)])
        high = r.choice([None, low, r.randrange(-5, 65)])
        left.append((i, r.choice(["a", "b", "c", "", None]), low, high))
    table = spark.createDataFrame(right, "k string, v int, score int, id int, __at string").repartition(3)
    rows = spark.createDataFrame(left, "i int, k string, low int, high int")
    out = L.expand(rows, table, ["k"], {"id": "id", "v": "v"}, ["i"], best=F.struct("__r_score", "__r_id"), between=(F.col("__r_v"), F.col("low"), F.col("high")))
    assert out.columns == ["i", "k", "low", "high", "id", "v"]
    got = {x.i: (x.id, x.v) for x in out.collect()}
    for i, k, low, high in left:
        met = [(s, j, v) for key, v, s, j, _ in right if k and key == k and v is not None and (low is None or v >= low) and (high is None or v <= high)]
        best = max(met, default=None)
        assert got[i] == ((best[1], best[2]) if best else (None, None))


def test_actions_and_open_ends(spark):
    right = spark.createDataFrame([(1, 5, "x"), (1, 9, "y")], "k int, v int, t string")
    left = spark.createDataFrame([(1, 1), (2, 2)], "i int, k int")
    out = L.expand(left, right, ["k"], ["t"], ["i"], best=F.col("__r_v"), between=(F.col("__r_v"), None, None), no_match=L.Action(L.REMOVE))
    assert [tuple(x) for x in out.collect()] == [(1, 1, "y")]
    assert L.expand(left, right.limit(0), ["k"], ["t"], ["i"], best=F.col("__r_v"), between=(F.col("__r_v"), None, None)).where("t is null").count() == 2


def test_hot_key_candidates_are_bounded(spark):
    """A third of the left rows ask for the whole range of one key: each meets a few nodes, not all rows."""
    right = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").alias("v"), (F.col("id") * 7919 % 4000).alias("score"))
    left = spark.range(300).select(F.col("id").alias("i"), F.lit(1).alias("k"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("low"))
    out = L.expand(left, right, ["k"], ["score"], ["i"], best=F.col("__r_score"), between=(F.col("__r_v"), F.col("low"), F.col("low") + 3999))
    assert {x.i: x.score for x in out.collect()} == {i: max(v * 7919 % 4000 for v in range(0 if i % 3 == 0 else i, 4000)) for i in range(300)}


def test_equal_ranges_search_the_index_once(spark, monkeypatch):
    from millrace.operators import lookup

    written, tables = lookup.written, []
    monkeypatch.setattr(lookup, "written", lambda df, name: [tables.append(written(df, name)), tables[-1]][1])
    left = spark.range(300).select("id", F.lit(1).alias("k"), (F.col("id") % 3).alias("low"))
    right = spark.range(200).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    out = lookup.expand(left, right, ["k"], ["v"], ["id"], best=-F.col("__r_v"), between=(F.col("__r_v"), F.col("low"), None))
    assert sorted((r.id, r.v) for r in out.collect()) == [(i, i % 3) for i in range(300)]
    assert len(tables) == 1 and tables[0].count() == 300 and tables[0].select("a", "b").distinct().count() == 3
