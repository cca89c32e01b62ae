"""One global order: hot values, ties, scans over ranges."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.errors import InvalidParameter
from millrace.operators import columns as COL
from millrace.operators import generate as GEN
from millrace.operators import ordering as O


def test_a_hot_order_value_takes_several_ranges(spark):
    df = spark.range(8000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).alias("k"), "id")
    r = O.ranged(df, ["k"])
    sizes = {x[r.range]: x["count"] for x in r.rows.groupBy(r.range).count().collect()}
    assert len(sizes) == r.count and max(sizes.values()) < 2 * 8000 / r.count
    assert r.rows.where("k = 7").select(r.range).distinct().count() >= 3
    rows = r.rows.orderBy(r.place).collect()
    assert [x.k for x in rows] == sorted(x.k for x in rows)
    assert [x.n for x in COL.add_incremental_id(df, "n", ["k"]).orderBy("n").collect()] == list(range(8000))


def test_previous_values_cross_ranges_and_nulls(spark):
    rows = [(i, None if i % 4 else i) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(5)
    kept = {r.id: r for r in O.with_previous(df, {"p": F.col("v")}, ["id"], skip_nulls=True).collect()}
    plain = {r.id: r for r in O.with_previous(df, {"p": F.col("v")}, ["id"]).collect()}
    for i in range(1, 200):
        assert kept[i].p == (i - 1) // 4 * 4 and plain[i].p == rows[i - 1][1] and not plain[i]["__first"]
    assert plain[0]["__first"] and plain[0].p is None and kept[0]["__first"]


def test_runs_over_one_hot_key(spark):
    values = [0] * 300 + [1, 1, None, None, 0] + [2] * 300
    df = spark.createDataFrame(list(enumerate(values)), "id long, v int")
    runs = [r["__run"] for r in O.run_ids(df, ["v"], ["id"]).orderBy("id").collect()]
    assert runs == [1] * 300 + [2, 2, 3, 3, 4] + [5] * 300


def test_empty_tables_have_an_order_too(spark):
    df = spark.createDataFrame([], "id long, v long")
    assert O.running_sum(df, F.col("v"), ["id"], "s").count() == 0
    assert O.run_ids(df, ["v"], ["id"]).count() == 0 and O.numbered(df, ["id"], "n").count() == 0


def test_names_that_the_input_has_stay(spark):
    df = spark.createDataFrame([(2, "r", "p"), (1, "s", "q")], "id long, __range string, __place string")
    out = O.numbered(df, ["id"], "n").orderBy("n").collect()
    assert [(r.id, r["__range"], r["__place"], r.n) for r in out] == [(1, "s", "q", 0), (2, "r", "p", 1)]


def affine_scan():
    """x -> p x + q for each row, composed: associative, not commutative; and rows made of x."""
    mod = 1_000_003

    def composed(frames):
        a, b = 1, 0
        for frame in frames:
            for p, q in zip(frame["p"], frame["q"]):
                a, b = a * int(p) % mod, (b * int(p) + int(q)) % mod
        return a, b

    def replayed(state, frames):
        x = (state[0] * 5 + state[1]) % mod
        for frame in frames:
            out = []
            for i, p, q in zip(frame["id"], frame["p"], frame["q"]):
                x = (x * int(p) + int(q)) % mod
                out += [(i, x)] * (x % 3)
            yield pd.DataFrame(out, columns=["id", "x"])

    return GEN.Scan((1, 0), composed, lambda f, g: (f[0] * g[0] % mod, (f[1] * g[0] + g[1]) % mod), replayed)


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_scan_equals_one_pass_in_order(spark, ranges):
    r = random.Random(2)
    rows = [(i, r.randrange(1, 99), r.randrange(99), "x") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, p long, q long, __state string").repartition(6)
    scan = affine_scan()
    out = GEN.explode_whole(df, ["id"], scan, "id long, x long", ranges=ranges)
    want = pd.concat(list(scan.rows((1, 0), iter([pd.DataFrame(rows, columns=["id", "p", "q", "s"])]))))
    assert sorted(tuple(x) for x in out.collect()) == sorted(want.itertuples(index=False, name=None))
    both = GEN.explode_whole(df, ["id"], scan, "id long, x long", keep_original=True, ranges=ranges)
    assert both.count() == 300 + len(want) and both.where("p is not null").count() == 300


def test_scan_of_nothing_and_without_order(spark):
    scan = affine_scan()
    df = spark.createDataFrame([], "id long, p long, q long")
    assert GEN.explode_whole(df, ["id"], scan, "id long, x long").count() == 0
    with pytest.raises(InvalidParameter):
        GEN.explode_whole(df, [], scan, "id long, x long")


def test_the_task_that_carries_states_does_not_sum_up_the_ranges(spark):
    """A range is summed up by a task of its own; else the one task would hold the sorts of all ranges."""
    from pyspark import TaskContext

    def summary(frames):
        return {TaskContext.get().partitionId(): sum(len(f) for f in frames)}

    def rows(before, frames):
        n = sum(len(f) for f in frames)
        yield pd.DataFrame({"id": [n], "x": [len(before)]})

    scan = GEN.Scan({}, summary, lambda a, b: {**a, **b}, rows)
    out = GEN.explode_whole(spark.range(4000).repartition(4), ["id"], scan, "id long, x long", ranges=4).collect()
    assert sorted(r.x for r in out) == [0, 1, 2, 3] and sum(r.id for r in out) == 4000
