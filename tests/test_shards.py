"""Loads into a database of files that tasks open: on a cluster, with failing batches, merges and all column types."""

import datetime
import decimal
import os
import subprocess
import sys
import uuid

import pytest
from pyspark.sql import functions as F

from millrace.errors import StepFailed
from millrace.sinks import database as D
from millrace.sinks.shards import Shards

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def db(spark, tmp_path):
    return Shards(spark, f"file://{tmp_path}/db", by={"target": ["k"]}, shards=3)


def rows_of(db, table="target"):
    return sorted(((r.k, r.v) for r in db.read(table).collect()), key=repr)


def test_the_query_runs_where_executors_are_other_processes(tmp_path):
    script = f"""
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "600m").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
print("rows", e.queries()["database_load"](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""
    home = os.path.dirname(__import__("pyspark").__file__)
    out = subprocess.run([sys.executable, "-c", script], cwd=ROOT, env={**os.environ, "PYTHONPATH": ROOT, "SPARK_HOME": home, "PYSPARK_PYTHON": sys.executable}, capture_output=True, text=True, timeout=240)
    assert "rows 100\n" in out.stdout, out.stderr[-2000:]


def test_a_failing_batch_keeps_those_before_and_is_done_later(spark, db):
    rows = spark.range(300).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    with pytest.raises(Exception, match="(?i)no_such_table"):
        D.load(db, rows, "target", "l", batch_rows=30, retries=1, wait=0, before_commit=lambda b: ["DELETE FROM no_such_table"] if b % 4 == 2 else [])
    kept = rows_of(db)
    assert 0 < len(kept) < 300 and len(kept) == len(set(kept))
    assert 0 < D.load(db, rows, "target", "l", batch_rows=7) < 12 and rows_of(db) == sorted(((i, "x") for i in range(300)), key=repr)
    assert D.load(Shards(spark, db.folder), rows, "target", "l") == 0 and len(rows_of(db)) == 300


def test_merged_batches_null_keys_and_equal_rows(spark, db):
    make = lambda rows: spark.createDataFrame(rows, "k long, v string")
    D.load(db, make([(1, "a"), (2, "b"), (None, "n"), (9, "z"), (9, "z")]), "target", "o'ne")
    D.load(db, make([(2, "B"), (3, ""), (None, "m"), (1, None)]), "target", "two", ["k"], batch_rows=1)
    assert sorted(map(str, rows_of(db))) == sorted(map(str, [(1, None), (2, "B"), (3, ""), (None, "n"), (None, "m"), (9, "z"), (9, "z")]))
    with pytest.raises(StepFailed):
        D.load(db, make([(7, "x"), (7, "y")]), "target", "three", ["k"])
    with pytest.raises(Exception, match="dealt by"):
        D.load(db, make([(7, "x")]), "target", "four", ["v"])
    assert D.load(db, make([]), "empty", "five") == 0 and db.read("empty").count() == 0


def test_all_types_come_back(spark, db):
    row = (5, 1.5, 0.1, "a\n\"b'", b"\x00\xff", True, datetime.date(1969, 12, 31), datetime.datetime(2024, 2, 29, 1, 2, 3, 4), decimal.Decimal("12.30"))
    rows = spark.createDataFrame([row, (None,) * len(row)], "k int, f float, d double, s string, b binary, o boolean, t date, z timestamp, n decimal(10,2)")
    D.load(db, rows, f"t{uuid.uuid4().hex}", "one")
    name = f"all types {uuid.uuid4().hex}"
    D.load(db, rows, name, "two")
    found = db.read(name)
    assert found.dtypes == rows.dtypes and sorted(map(str, found.collect())) == sorted(map(str, rows.collect()))
    with pytest.raises(Exception, match="not-a-number"):
        D.load(db, spark.createDataFrame([(1, float("nan"))], "k int, d double"), "nan", "three")
