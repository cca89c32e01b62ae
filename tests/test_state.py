"""State per key over several micro-batches: late rows, evicted keys, restarts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from millrace.errors import InvalidParameter
from millrace.streaming import state, streams

START = 1_700_000_000


def arriving(spark, folder, batches, schema="k string, id long, at long, v double"):
    """A stream for each batch of (k, id, second, value): all that came so far."""
    for rows in batches:
        spark.createDataFrame(rows, schema).withColumn("t", F.timestamp_seconds(F.col("at") + START)).coalesce(1).write.mode("append").parquet(folder)
        yield streams.listen_files(spark, folder, f"{schema}, t timestamp")


def test_sessions_of_late_rows_equal_those_of_all(spark, tmp_path):
    r, rows = random.Random(6), []
    for i in range(400):
        rows.append((r.choice("abcd"), i, r.randrange(0, 40_000) if r.random() < 0.5 else r.randrange(20) * 2000, float(i % 7)))
    rows.sort(key=lambda x: x[2] + r.randrange(0, 500))  # less than the delay
    batches = [rows[i : i + 140] for i in range(0, 400, 140)] + [[("z", 999, 60_000, None)]]
    for stream in arriving(spark, str(tmp_path / "in"), batches):
        out = state.collect_available(state.sessions(stream, ["k"], "t", 300_001, "v", "600 seconds"), str(tmp_path / "out"), str(tmp_path / "state"))
    want = []
    for k in "abcd":
        own = sorted((x[2], x[3]) for x in rows if x[0] == k)
        for at, v in own:
            if want and want[-1][0] == k and at * 1000 - want[-1][2] < 300_001:
                want[-1][2:] = [at * 1000, want[-1][3] + 1, want[-1][4] + v]
            else:
                want.append([k, at * 1000, at * 1000, 1, v])
    got = sorted([x.k, x.start_ms - START * 1000, x.last_ms - START * 1000, x.rows, x.total] for x in out.collect())
    assert got == sorted(want)


def test_firsts_pass_again_when_forgotten(spark, tmp_path):
    batches = [[("a", 1, 0, None), ("a", 2, 50, None), ("b", 3, 10, None)], [("a", 4, 99, None), ("a", 5, 100, None), ("a", 6, 150, None)], [("c", 7, 5000, None)], [("a", 8, 5001, None), ("b", 9, 5002, None), ("b", 10, 5050, None)]]
    for stream in arriving(spark, str(tmp_path / "in"), batches):
        out = state.collect_available(state.first_of_key(stream, ["k"], "t", 100_000, "10 seconds"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert out.columns == ["k", "id", "at", "v", "t"] and sorted(r.id for r in out.collect()) == [1, 3, 5, 7, 8, 9]
    # what is left in the state: the keys of the last batches only
    left = spark.read.format("statestore").option("stateVarName", "until").load(str(tmp_path / "state"))
    assert {r.key.k for r in left.collect()} == {"a", "b", "c"}


def test_evicted_keys_leave_the_state(spark, tmp_path):
    batches = [[(f"k{i}", i, i, None) for i in range(50)], [("last", 99, 100_000, None)]]
    for stream in arriving(spark, str(tmp_path / "in"), batches):
        state.collect_available(state.first_of_key(stream, ["k"], "t", 1000, "1 second"), str(tmp_path / "out"), str(tmp_path / "state"))
    left = spark.read.format("statestore").option("stateVarName", "until").load(str(tmp_path / "state"))
    assert [r.key.k for r in left.collect()] == ["last"]


def test_numbers_go_on_and_time_to_live_starts_them_again(spark, tmp_path):
    batches = [[("a", 2, 0, None), ("a", 1, 0, None), (None, 3, 0, None)], [("a", 5, 0, None), (None, 4, 0, None)]]
    for kind, ttl in (("kept", None), ("short", 1)):
        for stream in arriving(spark, str(tmp_path / f"{kind}_in"), batches):
            out = state.collect_available(state.numbered(stream, ["k"], "n", "id", ttl_ms=ttl), str(tmp_path / kind), str(tmp_path / f"{kind}_state"), idle_batches=ttl is None)
            time.sleep(0.1)
        got = sorted((r.id, r.n) for r in out.collect())
        assert got == [(1, 1), (2, 2), (3, 1), (4, 2 if ttl is None else 1), (5, 3 if ttl is None else 1)]


def test_the_session_keeps_its_state_store(spark):
    before = spark.conf.get(state._PROVIDER)
    with pytest.raises(ZeroDivisionError), state.state_store(spark):
        assert spark.conf.get(state._PROVIDER) == state._ROCKS
        1 / 0
    assert spark.conf.get(state._PROVIDER) == before
    with pytest.raises(InvalidParameter):
        state.sessions(spark.range(1).withColumn("t", F.current_timestamp()), ["id"], "t", 0)


def test_sessions_end_at_the_gap_and_not_before(spark, tmp_path):
    batches = [[("a", 1, 0, 1.0), ("a", 2, 300, None), ("b", 3, 0, 2.0), ("b", 4, 299, 3.0)], [("z", 5, 9000, None)]]
    for stream in arriving(spark, str(tmp_path / "in"), batches):
        made = state.sessions(stream, ["k"], "t", 300_000, "v")
        out = state.collect_available(made, str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted((x.k, (x.last_ms - x.start_ms) // 1000, x.rows, x.total) for x in out.collect()) == [("a", 0, 1, 0.0), ("a", 0, 1, 1.0), ("b", 299, 2, 5.0)]
    # the rows of a key are joined in the JVM, not one by one in Python
    assert "TransformWithState" not in made._jdf.queryExecution().analyzed().toString()
