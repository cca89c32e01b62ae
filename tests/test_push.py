"""The push source: replay after restarts, gaps, heartbeats."""

import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.errors import TAG
from millrace.streaming import push


def segment(*ids):
    return pa.table({"id": pa.array(ids, pa.int64()), "v": [f"v{i}" for i in ids]})


def run(stream, out, state):
    push.without_heartbeats(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    spool, out, state = (str(tmp_path / x) for x in ("spool", "out", "state"))
    for i in range(5):
        push.Spool(spool).push(segment(2 * i, 2 * i + 1))
    run(push.listen(spark, spool, "id long, v string"), out, state)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(10))
    assert push.Spool(spool).push(segment(10)) == 5
    push.Spool(spool).push(segment(99), 7)  # behind a gap
    for _ in range(2):
        run(push.listen(spark, spool, "id long, v string"), out, state)
    assert sorted((r.id, r.v) for r in spark.read.parquet(out).collect()) == [(i, f"v{i}") for i in range(11)]
    push.Spool(spool).push(segment(11), 6)
    run(push.listen(spark, spool, "id long, v string"), out, state)
    run(push.listen(spark, spool, "id long, v string"), out, state)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [*range(12), 99]


def test_a_failed_batch_is_replayed(spark, tmp_path):
    spool, state, seen = str(tmp_path / "spool"), str(tmp_path / "state"), []
    for i in range(3):
        push.Spool(spool).push(segment(i))

    def sink(batch, number):
        ids = sorted(r.id for r in batch.collect())
        seen.append((number, ids))
        if len(seen) == 1:
            raise RuntimeError("once")

    for turn in range(2):
        query = push.without_heartbeats(push.listen(spark, spool, "id long, v string")).writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start()
        if turn == 0:
            with pytest.raises(Exception, match="once"):
                query.awaitTermination()
        else:
            query.awaitTermination()
    assert seen[0] == seen[1] and seen[0][1] == [0, 1, 2]


def test_heartbeats_flush_an_idle_stream(spark, tmp_path):
    spool, waiting, flushed, beats = str(tmp_path / "spool"), [], [], []
    push.Spool(spool).push(segment(1, 2))

    def sink(batch, number):
        """Rows wait until a heartbeat comes."""
        rows = batch.collect()
        waiting.extend(r.id for r in rows if r[TAG] is None)
        found = [r[push.BEAT] for r in rows if r[TAG] == push.HEARTBEAT]
        beats.extend((b["index"], b["row_count"]) for b in found)
        if found and waiting:
            flushed.append(sorted(waiting))
            waiting.clear()

    query = push.listen(spark, spool, "id long, v string", heartbeat_ms=200).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="100 milliseconds").start()
    try:
        for _ in range(300):
            if len(beats) >= 2:
                break
            time.sleep(0.1)
        push.Spool(spool).push(segment(3), 1)
        for _ in range(300):
            if len(flushed) == 2:
                break
            time.sleep(0.1)
    finally:
        query.stop()
    assert flushed == [[1, 2], [3]]
    assert [i for i, _ in beats] == list(range(1, len(beats) + 1)) and beats[0][1] == 2 and beats[-1][1] == 3


def test_a_task_that_runs_twice_adds_nothing(spark, tmp_path):
    spool = str(tmp_path / "spool")
    for _ in range(2):
        push.push_table(spark.range(100).select("id", F.lit("x").alias("v")), spool, 4, 0)
    assert sorted(push.Spool(spool).segments()) == [0, 1, 2, 3] and sum(push.Spool(spool).segments().values()) == 100


def test_all_segments_gone_and_several_a_batch(spark, tmp_path):
    spool, out, state = (str(tmp_path / x) for x in ("spool", "out", "state"))
    for i in range(7):
        push.Spool(spool).push(segment(i))
    for turn in range(2):
        run(push.listen(spark, spool, "id long, v string", max_segments=3), out, state)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(7))
    push.Spool(spool).remove(5)
    run(push.listen(spark, spool, "id long, v string", max_segments=3), out, state)
    push.Spool(spool).push(segment(70), 7)
    for turn in range(2):
        run(push.listen(spark, spool, "id long, v string", max_segments=3), out, state)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [*range(7), 70]


def test_readers_of_their_own(spark, tmp_path):
    spool = str(tmp_path / "spool")
    for turn in range(2):
        push.Spool(spool).push(segment(turn))
        for name in ("one", "two"):
            run(push.listen(spark, spool, "id long, v string", keep=True, reader=name), str(tmp_path / name), str(tmp_path / f"{name}_state"))
    for name in ("one", "two"):
        assert sorted(r.id for r in spark.read.parquet(str(tmp_path / name)).collect()) == [0, 1]
