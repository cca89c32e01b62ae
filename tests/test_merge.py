"""Merges that touch only what changes, journals that outlive the driver."""

import uuid

import pytest
from pyspark.sql import functions as F

from millrace.errors import InvalidParameter, StepFailed
from millrace.sinks.journal import Journal, Scope
from millrace.sources import tables as T
from millrace.sources.merge import Clause


@pytest.fixture
def name(spark):
    name = f"m_{uuid.uuid4().hex[:10]}"
    yield name
    for t in [t.name for t in spark.catalog.listTables() if t.name.startswith(name)]:
        spark.sql(f"DROP TABLE IF EXISTS {t}")


def files_of(spark, name):
    return {r[0] for r in spark.table(name).select(F.col("_metadata.file_path")).distinct().collect()}


def table_of(spark, name):
    rows = spark.range(100).select("id", (F.col("id") % 4).cast("int").alias("p"), F.concat(F.lit("v"), "id").alias("v"))
    rows.coalesce(1).write.partitionBy("p").saveAsTable(name)
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('owner of' = 'it''s')")
    return files_of(spark, name)


def layout(spark, name):
    partitions = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    return partitions, {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}["owner of"]


def test_untouched_files_keep_their_names(spark, name):
    before, jobs = table_of(spark, name), T.Tables(spark)
    source = spark.createDataFrame([(5, 1, "five"), (9, 1, "nine"), (200, 7, "new"), (None, 1, "null")], "id long, p int, v string")
    jobs.merge_into(name, source, ["id"], [Clause("matched", "update", F.col("t.id") < 9, {"v": F.col("s.v")}), Clause("missing_in_target", "insert")])
    after = files_of(spark, name)
    assert len(before - after) == 1 and all("p=1" in f for f in before - after)
    rows = {r.id: (r.p, r.v) for r in spark.table(name).collect()}
    assert len(rows) == 102 and rows[5] == (1, "five") and rows[9] == (1, "v9") and rows[200] == (7, "new") and rows[None] == (1, "null")
    assert layout(spark, name) == (["p"], "it's")
    jobs.merge(name, source, ["id"])  # null keys match
    assert spark.table(name).count() == 102 and {r.id: r.v for r in spark.table(name).where("p = 1").collect()}[9] == "nine"
    jobs.delete(name, "id = 200")
    assert spark.table(name).count() == 101 and layout(spark, name) == (["p"], "it's")
    jobs.replace(name, spark.table(name).where("id < 10"))
    assert spark.table(name).count() == 10 and layout(spark, name) == (["p"], "it's")


def test_a_change_may_move_a_row_to_another_partition(spark, name):
    table_of(spark, name)
    source = spark.createDataFrame([(4, 2)], "id long, p int")
    T.Tables(spark).merge_into(name, source, ["id"], [Clause("matched", "update"), Clause("missing_in_source", "delete", F.col("t.id") % 2 == 1)])
    rows = {r.id: (r.p, r.v) for r in spark.table(name).collect()}
    assert len(rows) == 50 and rows[4] == (2, "v4") and rows[8] == (0, "v8")


def test_the_first_clause_that_fits_counts(spark, name):
    spark.createDataFrame([(i, "t") for i in range(6)], "id int, v string").write.saveAsTable(name)
    source = spark.createDataFrame([(i, "s") for i in range(3, 9)], "id int, v string")
    clauses = [
        Clause("matched", "delete", F.col("t.id") == 3), Clause("matched", "update", F.col("t.id") <= 4), Clause("matched", "update", set={"v": F.lit("late")}),
        Clause("missing_in_target", "insert", F.col("s.id") == 8, {"id": F.col("s.id")}), Clause("missing_in_target", "insert", F.col("s.id") == 7),
        Clause("missing_in_source", "update", F.col("t.id") == 0, {"v": F.lit("gone")}),
    ]
    T.Tables(spark).merge_into(name, source, ["id"], clauses)
    assert {(r.id, r.v) for r in spark.table(name).collect()} == {(0, "gone"), (1, "t"), (2, "t"), (4, "s"), (5, "late"), (7, "s"), (8, None)}


def test_several_changes_of_one_row_fail_before_anything_is_written(spark, name):
    before = table_of(spark, name)
    source = spark.createDataFrame([(5, "a"), (5, "b"), (300, "x"), (300, "y")], "id long, v string")
    with pytest.raises(StepFailed):
        T.Tables(spark).merge_into(name, source, ["id"], [Clause("matched", "update"), Clause("missing_in_target", "insert")])
    assert files_of(spark, name) == before
    T.Tables(spark).merge_into(name, source, ["id"], [Clause("matched", "update", F.col("s.v") == "c"), Clause("missing_in_target", "insert")])
    assert spark.table(name).count() == 102
    with pytest.raises(InvalidParameter):
        Clause("matched", "insert")


class Death(BaseException):
    """The driver is no more: nothing catches it to tidy up."""


def dying(journal, after):
    """The journal's steps end with the driver's death after so many."""
    do, done = journal.do, []

    def counted(*names):
        if len(done) == after:
            raise Death
        done.append(names)
        do(*names)

    journal.do = counted
    return journal


@pytest.mark.parametrize("after", [0, 1, 2, 3, 4])
def test_a_new_driver_carries_a_merge_through(spark, name, tmp_path, after):
    from millrace.sources.merge import merge_into

    table_of(spark, name)
    source = spark.createDataFrame([(5, "five"), (6, "six")], "id long, v string")
    with pytest.raises(Death):
        merge_into(spark, name, source, ["id"], [Clause("matched", "update")], dying(Journal(spark, str(tmp_path)), after))
    assert Journal(spark, str(tmp_path)).recover() == (1, 0)
    spark.sql(f"REFRESH TABLE {name}")
    rows = {r.id: r.v for r in spark.table(name).collect()}
    assert len(rows) == 100 == spark.table(name).count() and rows[5] == "five" and rows[6] == "six"
    assert Journal(spark, str(tmp_path)).recover() == (0, 0)


@pytest.mark.parametrize("after", range(7))
def test_publishing_that_dies_between_renames(spark, name, tmp_path, after):
    one, two = f"{name}_one", f"{name}_two"
    for t in (one, two):
        spark.createDataFrame([(1,)], "k int").write.saveAsTable(t)
    with pytest.raises(Death) if after < 6 else pytest.MonkeyPatch.context():
        with Scope(spark, journal=dying(Journal(spark, str(tmp_path)), after)) as scope:
            scope.stage(one, spark.createDataFrame([(7,)], "k int"))
            scope.stage(two, scope.staged(one))
    Journal(spark, str(tmp_path)).recover()
    assert [r.k for r in spark.table(one).collect()] == [7] == [r.k for r in spark.table(two).collect()]
    assert {t.name for t in spark.catalog.listTables() if t.name.startswith(name)} == {one, two}


def test_death_before_the_commit_undoes_the_stages(spark, name, tmp_path):
    spark.createDataFrame([(1,)], "k int").write.saveAsTable(name)
    with pytest.raises(Death):
        with Scope(spark, journal=Journal(spark, str(tmp_path))) as scope:
            scope.stage(name, spark.createDataFrame([(2,)], "k int"))
            raise Death
    assert len([t for t in spark.catalog.listTables() if t.name.startswith(name)]) == 2
    assert Journal(spark, str(tmp_path)).recover() == (0, 1)
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith(name)] == [name] and spark.table(name).first().k == 1


def test_kinds_of_nested_scopes(spark, name, tmp_path):
    rows = lambda k: spark.createDataFrame([(k,)], "k int")
    value = lambda t: spark.table(t).first().k if spark.catalog.tableExists(t) else None
    a, b, c = (f"{name}_{x}" for x in "abc")
    with pytest.raises(ZeroDivisionError):
        with Scope(spark, journal=Journal(spark, str(tmp_path))) as outer:
            outer.stage(a, rows(1))
            with Scope(spark, "requires_new", Journal(spark, str(tmp_path))) as own:
                own.stage(b, rows(2))
            with Scope(spark, "suppress", Journal(spark, str(tmp_path))) as free:
                free.stage(c, rows(3))
                assert value(c) == 3
            with Scope(spark) as joined:
                joined.stage(a, rows(4))
                assert joined.staged(a).first().k == 4 and value(a) is None
            1 / 0
    assert (value(a), value(b), value(c)) == (None, 2, 3)
    with Scope(spark, journal=Journal(spark, str(tmp_path))):
        with Scope(spark) as joined:
            joined.stage(a, rows(5))
        assert value(a) is None
    assert value(a) == 5 and Journal(spark, str(tmp_path)).recover() == (0, 0) and not Scope._open
    with pytest.raises(InvalidParameter):
        Scope(spark, "maybe")
