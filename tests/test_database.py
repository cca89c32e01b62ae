"""Database loads with a ledger, on the Derby that comes with Spark; counters seen while writing."""

import uuid

import pytest
from pyspark.sql import functions as F

from millrace.errors import StepFailed
from millrace.plans.flow import Flow, last_value
from millrace.sinks import database as D


@pytest.fixture
def db(spark):
    return D.Database(spark, f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true")


def rows_of(db, table="target"):
    return sorted(((r.k, r.v) for r in db.read(table).collect()), key=repr)


def test_a_batch_that_fails_twice_is_neither_lost_nor_doubled(spark, db):
    rows, turns = spark.range(1000).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v")), []

    def failing(batch):
        turns.append(batch)
        return ["INSERT INTO no_such_table VALUES (1)"] if batch == 2 and turns.count(2) <= 2 else []

    assert D.load(db, rows, "target", "one", batch_rows=100, wait=0, before_commit=failing) == 10
    assert turns.count(2) == 3 and len(turns) == 12
    assert rows_of(db) == sorted(((i, f"v{i}") for i in range(1000)), key=repr)
    assert sum(n for b, n in db.done("one").items() if b >= 0) == 1000
    assert D.load(db, rows, "target", "one", batch_rows=100) == 0 and len(rows_of(db)) == 1000
    assert D.load(db, rows.limit(5), "target", "two") == 1 and len(rows_of(db)) == 1005


def test_another_driver_does_what_is_left(spark, db):
    rows = spark.range(300).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    with pytest.raises(Exception, match="(?i)no_such_table"):
        D.load(db, rows, "target", "l", batch_rows=30, retries=0, before_commit=lambda b: ["DELETE FROM no_such_table"] if b == 4 else [])
    assert 0 < len(rows_of(db)) < 300
    assert D.load(db, rows, "target", "l", batch_rows=30) == 6 and rows_of(db) == sorted(((i, "x") for i in range(300)), key=repr)


def test_rows_written_twice_by_a_repeated_task_count_once(spark, db, monkeypatch):
    write = D.Database.write
    monkeypatch.setattr(D.Database, "write", lambda self, rows, table, mode="append", types=None: [write(self, rows, table, mode, types), table.startswith("load_stage") and write(self, rows, table)])
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k long, v string")
    D.load(db, rows, "target", "l")
    assert sorted(map(str, rows_of(db))) == ["(1, 'a')", "(1, 'a')", "(2, None)"]


def test_merged_batches_and_null_keys(spark, db):
    make = lambda rows: spark.createDataFrame(rows, "k long, v string")
    D.load(db, make([(1, "a"), (2, "b"), (None, "n")]), "target", "one")
    D.load(db, make([(2, "B"), (3, "c"), (None, "m")]), "target", "two", ["k"], batch_rows=1)
    assert sorted(map(str, [(r.k, r.v) for r in db.read("target").collect()])) == sorted(map(str, [(1, "a"), (2, "B"), (3, "c"), (None, "n"), (None, "m")]))
    with pytest.raises(StepFailed):
        D.load(db, make([(7, "x"), (7, "y")]), "target", "three", ["k"])
    assert D.load(db, make([]), "empty", "four") == 1 and db.read("empty").count() == 0


def test_counters_are_seen_in_one_job(spark, tmp_path):
    rows = spark.range(1000).withColumn("v", F.col("id") % 7)
    spark.sparkContext.setJobGroup("observed", "")
    try:
        flow = Flow().write_observed(lambda: rows, lambda df: df.write.parquet(str(tmp_path / "t")), {"n": F.count(F.lit(1)), "last": last_value("id", ["v", "id"])})
        assert flow.raise_failures().values == {"n": 1000, "last": max((i % 7, i) for i in range(1000))[1]}
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("observed")) == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert Flow().write_observed(lambda: rows.where("v > 9"), lambda df: df.write.parquet(str(tmp_path / "u")), {"n": F.count(F.lit(1)), "last": last_value("id", ["v"])}).values == {"n": 0, "last": None}


def test_text_keys_with_a_type_that_compares(spark, db):
    make = lambda rows: spark.createDataFrame(rows, "k string, v long")
    D.load(db, make([("a", 1), ("b'", 2)]), "target", "o'ne", types={"k": "VARCHAR(20)"})
    D.load(db, make([("b'", 3), ("c", 4)]), "target", "two", ["k"], types={"k": "VARCHAR(20)"})
    assert rows_of(db) == sorted([("a", 1), ("b'", 3), ("c", 4)], key=repr)
