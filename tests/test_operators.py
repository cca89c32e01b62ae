"""Operators on small tables with known results.  Fixed values: the results that belong to the tables of people.py."""

from datetime import datetime as dt

import people
import pytest
from pyspark.sql import functions as F

from millrace.errors import ERRORS, TAG, InvalidParameter
from millrace.operators import aggregate as A
from millrace.operators import columns as COL
from millrace.operators import filters as FIL
from millrace.operators import generate as GEN
from millrace.operators import lookup as L
from millrace.operators import ordering
from millrace.operators import sets as S
from millrace.plans.sequence import Seq


def got(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=repr)


def test_remove_rows_keeps_unknown(spark):
    assert [r.id for r in FIL.remove_rows(people.person(spark), F.col("age") < 10).orderBy("id").collect()] == [0, 2, 3, 5, 6]
    assert FIL.remove_all_rows(people.person(spark)).count() == 0


def test_blank_rows_go(spark):
    df = spark.createDataFrame([(None, ""), (None, "x"), (1, None)], "a int, b string")
    assert got(FIL.remove_blank_rows(df)) == sorted([(None, "x"), (1, None)], key=repr)


def test_conditions_pass_other_rows_and_nest(spark):
    df = people.person(spark).select("id", "age")
    out = Seq(df).when(F.col("age") > 10, lambda s: s.when(F.col("age") > 20, lambda t: t.then(lambda d: d.withColumn("age", F.lit(0))))).result()
    assert dict(got(out)) == {0: 17, 1: 8, 2: 0, 3: 0, 4: -3, 5: 11, 6: None}


def test_errors_are_kept_replaced_and_removed(spark):
    df = FIL.validate(people.person(spark).select("id", "age"), "age", F.col("age") >= 0, "negative")
    bad = {r.id: r[ERRORS] for r in df.collect() if r[ERRORS]}
    assert set(bad) == {4, 6} and bad[4]["age"].original == "-3"
    assert FIL.remove_rows_with_error(df).count() == 5
    fixed = COL.replace_error(df, 0, "age")
    assert fixed.where(F.size(ERRORS) > 0).count() == 0 and dict(got(fixed, "id", "age"))[4] == 0
    with pytest.raises(Exception, match="RowContainsError"):
        FIL.fail_on_error(df).collect()


def test_duplicate_key_fails(spark):
    assert FIL.fail_on_duplicate_key(people.person(spark), ["id"]).count() == 7
    with pytest.raises(Exception, match="DuplicateKey"):
        FIL.fail_on_duplicate_key(people.person(spark), ["name"]).collect()


def test_rename_swaps_and_policies(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "y", "z")], "a int, b string, c string")
    assert got(COL.rename_columns(df, {"b": "c", "c": "b"}), "a", "b", "c") == [(1, None, "x"), (2, "z", "y")]
    assert got(COL.rename_columns(df, {"b": "c"}, "skip")) == [(1, "x"), (2, "z")]
    assert got(COL.rename_columns(df, {"b": "c"}, "overwrite")) == [(1, "x"), (2, "y")]
    assert got(COL.rename_columns(df, {"b": "c"}, "remove_row")) == [(1, "x")]
    with pytest.raises(Exception, match="ColumnRename"):
        COL.rename_columns(df, {"b": "c"}).collect()
    with pytest.raises(InvalidParameter):
        COL.rename_columns(df, {"nope": "c"})


def test_merged_text_separators(spark):
    df = spark.createDataFrame([("a", None), (None, "b"), ("a", "b"), (None, None)], "x string, y string")
    assert sorted(r.t for r in COL.merge_text_columns(df, ["x", "y"], "t", ",").collect()) == ["", "a,", "a,b", "b"]


def test_key_hash(spark):
    out = COL.add_key_hash(people.person(spark), "h", ["height"])
    assert {r.height: r.h[:8] for r in out.collect()}[160] == "a512db27"


def test_hierarchy(spark):
    df = spark.createDataFrame(people.ROLES, people.ROLES_SCHEMA)
    out = COL.resolve_hierarchy(df, "id", ["level1", "level2", "level3"], ["id"], "parent", "name", "level")
    assert [r.parent for r in out.orderBy("id").collect()] == [None, 0, 1, 1, 0, 0]
    assert [(r.name, r.level) for r in out.orderBy("id").collect()][2] == ("CCC", 2)


def test_incremental_id_over_ties_of_nulls(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("k"), "id")
    out = COL.add_incremental_id(df, "n", ["k", "id"], first=5).orderBy("n").collect()
    assert [r.n for r in out] == list(range(5, 1005)) and [r.id for r in out][:3] == [0, 3, 6]


def test_running_sum_and_runs(spark):
    df = spark.range(500).withColumn("v", (F.col("id") / 7).cast("int") % 3)
    sums = ordering.running_sum(df, F.col("v"), ["id"], "s").orderBy("id").collect()
    want, total = [], 0
    for i in range(500):
        total += i // 7 % 3
        want.append(total)
    assert [r.s for r in sums] == want
    runs = ordering.run_ids(df, ["v"], ["id"]).orderBy("id").collect()
    assert [r["__run"] for r in runs] == [i // 7 + 1 for i in range(500)]


def test_unpivot(spark):
    df = spark.createDataFrame(people.ASSETS, people.ASSETS_SCHEMA)
    assert GEN.unpivot(df, "asset", "n", ["cars", "houses", "kids"]).count() == 11
    assert GEN.unpivot(df, "asset", "n", fixed=["id", "personName"]).count() == 12
    with pytest.raises(InvalidParameter):
        GEN.unpivot(df, "asset", "n")


def test_tags_and_explode(spark):
    df = GEN.tagged_versions(people.country(spark).select("id"), "x", "y", keep_original=True)
    assert df.count() == 12 and df.where(F.col(TAG).isNull()).count() == 4
    out = GEN.explode_rows(people.country(spark).select("id"), F.array(F.struct((F.col("id") * 10).alias("id")), F.struct(F.lit(0).alias("id"))), keep_original=True)
    assert out.count() == 12
    frames = GEN.explode_frames(people.country(spark).select("id"), lambda batches: (b.assign(id=b.id + 1) for b in batches), "id int")
    assert got(frames) == [(2,), (3,), (4,), (5,)]


def test_aggregates_take_null_as_zero(spark):
    out = A.aggregate(people.person(spark), ["name"], [A.greatest("age", "hi"), A.least("age", "lo"), A.average("age", "avg"), A.count_not_null("eyeColor", "eyes"), A.count("n"), A.total("age", "sum", "int")])
    rows = {r.name: r for r in out.collect()}
    assert set(rows) == {"A", "B", "C", "D", "E", "fake"}
    assert (rows["fake"].hi, rows["fake"].lo, rows["fake"].sum) == (0, 0, 0)
    assert rows["B"].eyes is None and rows["A"].eyes == 1 and rows["A"].avg == 14.0
    empty = people.person(spark).limit(0)
    assert A.aggregate(empty, [], [A.count("n")]).count() == 0


def test_fixed_columns_come_from_the_first_row(spark):
    out = A.aggregate(people.person(spark), ["name"], [A.count("n")], {"first_id": "id"}, ["id"])
    assert {r.name: r.first_id for r in out.collect()}["A"] == 0


def test_regression_edges(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("b", 1.0, 7.0), ("c", 1.0, None), ("c", 2.0, 3.0), ("d", 2.0, 1.0), ("d", 2.0, 3.0)], "k string, x double, y double")
    rows = {r.k: (r.slope, r.intercept, r.n) for r in A.aggregate(df, ["k"], A.linear_regression("x", "y")).collect()}
    assert rows == {"a": (2.0, 0.0, 2), "b": (0.0, 7.0, 1), "c": (None, None, None), "d": (0.0, 2.0, 2)}


def test_reduce_and_dedup(spark):
    df = people.person(spark)
    assert [r.id for r in A.reduce_groups(df, ["name"], [F.desc("id")]).orderBy("id").collect()] == [1, 2, 3, 4, 5, 6]
    assert A.remove_duplicates(df, ["name"], ["id"]).count() == 6
    assert A.remove_duplicates(df, ["id"], ["id"]).count() == 7
    assert A.remove_duplicates(df, ["eyeColor"], ["id"]).count() == 4


def test_joins(spark):
    left, right = people.person(spark).select("id", "name"), people.eyes(spark)
    keys = {"id": "personId"}
    assert L.join(left, right, keys, ["color"], L.Action(L.REMOVE)).count() == 6
    out = L.join(left, right, keys, ["color"], L.Action(set={"color": F.lit("none")}))
    assert out.count() == 10 and out.where("color = 'none'").count() == 4
    with pytest.raises(Exception, match="NoMatch"):
        L.join(left, right, keys, ["color"], L.Action(L.FAIL)).collect()
    kept = L.join(left, right, keys, {"name": "color"})
    assert {r.name for r in kept.where("id > 2").collect()} == {"D", "E", "A", "fake"}
    two = L.join(left, right, keys, ["color"], L.Action(L.REMOVE), match_limit=2, match_order=["id"])
    assert two.count() == 5
    few = L.join(left, right, keys, ["color"], L.Action(L.REMOVE), match_limit=2, match_order=["id"], too_many=L.Action(L.REMOVE))
    assert {r.id for r in few.collect()} == {1, 2}


def test_null_keys_never_match(spark):
    df = spark.createDataFrame([(None, 1), ("", 2), ("a", 3)], "k string, v int")
    assert got(L.join(df.select("k"), df, ["k"], ["v"], L.Action(L.REMOVE))) == [("a", 3)]
    assert L.key_test(df, df, ["k"], match=L.Action(L.REMOVE)).count() == 2
    assert L.count_by_key(df, ["k"]).count() == 1


def test_compare(spark):
    changed = [(0, "A", 17, 160, "brown", 1, "2010-02-09"), (1, "B", 8, 190, None, 1, "2011-02-01"), (2, "C", 27, 170, "green", 2, "2014-01-21"), (4, "E", -3, 120, None, 1, None), (5, "A", None, 140, None, 3, "2013-05-15"), (6, "fake", 13, 140, None, 5, "2018-01-09")]
    left = people.person(spark).drop("lastChangedTime")
    right = spark.createDataFrame(changed, left.schema)
    out = L.compare_rows(left, right, ["id"], L.equal_all_columns(left, right), ["id"], same=L.Action(L.REMOVE), status="s")
    assert {r.id: r.s for r in out.collect()} == {0: "different", 3: "no_match", 4: "different", 5: "different", 6: "different"}


def test_as_of(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("b", 10, "z"), (None, 1, "n")], "k string, t int, v string")
    assert got(L.as_of(left, right, ["k"], "t", "t", {"v": "v"}), "id", "v") == [(1, "y"), (2, None), (3, None)]


def test_merge_and_split(spark):
    out = S.merge_in_order(people.country(spark).select("id"), people.eyes(spark).select("color"))
    assert out.count() == 11 and out.where("id IS NULL").count() == 7
    assert S.process_in_parallel(people.person(spark), 3, lambda df: df).count() == 7


def test_latest_and_earliest_of_nothing(spark):
    out = A.aggregate(people.person(spark).where("id = 6"), ["id"], [A.latest("lastChangedTime", "hi"), A.earliest("lastChangedTime", "lo")]).first()
    assert out.hi == dt(1, 1, 1) and out.lo.year == 9999


def test_lookups_drop_only_what_they_add(spark):
    left = spark.createDataFrame([(1, "n", 5), (2, "m", 6)], "k int, __key_note string, __input int")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    out = L.join(left, right, ["k"], ["v"])
    assert out.columns == ["k", "__key_note", "__input", "v"] and out.count() == 3
    found = L.expand(left, right, ["k"], ["v"], ["k"], best=F.col("__r_v"))
    assert got(found) == [(1, "n", 5, "b"), (2, "m", 6, None)] and found.columns == ["k", "__key_note", "__input", "v"]
    assert L.key_test(left, right, ["k"], L.Action(set={"__input": F.lit(0)})).columns == left.columns
    assert L.compare_rows(left, right, ["k"], L.equal_columns(["k"]), ["v"]).columns == left.columns


def test_too_many_matches_are_told_on_the_right_side(spark):
    left = spark.createDataFrame([(1,), (2,), (3,), (3,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    out = L.join(left, right, ["k"], ["v"], match_limit=1, match_order=["v"], too_many=L.Action(set={"v": F.lit("many")}))
    assert got(out) == [(1, "a"), (2, "c"), (3, None), (3, None)]


def test_as_of_takes_the_nearest_and_splits_hot_keys(spark):
    left = [(i, "hot" if i % 5 else None if i % 2 else "rare", float(i % 97)) for i in range(400)]
    right = [(j, "hot" if j % 3 else None if j % 2 else "rare", float(j * 7 % 101)) for j in range(90)]
    one, two = spark.createDataFrame(left, "id int, key string, at double"), spark.createDataFrame(right, "id int, key string, from double")
    out = {r.id: r.found for r in L.as_of(one, two, ["key"], "at", "from", {"found": "id"}, ties=["id"]).collect()}
    for i, key, at in left:
        fits = [(f, j) for j, k, f in right if key is not None and k == key and f <= at]
        assert out[i] == (max(fits)[1] if fits else None)
    assert L.as_of(one, two, ["key"], "at", "from", {"found": "id"}, no_match=L.Action(L.REMOVE)).count() == sum(v is not None for v in out.values())


def test_reduced_groups_are_altered(spark):
    df = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (2, 3, 30)], "g int, o int, v int")
    assert got(A.reduce_groups(df, ["g"], ["o"], set={"v": F.sum("v"), "n": F.count(F.lit(1))})) == [(1, 1, 30, 2), (2, 3, 30, 1)]
    assert got(A.reduce_groups(df, ["g"], ["o"], where=F.col("v") > 10, set={"v": F.sum("v")}, keep_single=True)) == [(1, 2, 30), (2, 3, 30)]
    assert got(A.reduce_groups(df, ["g"], ["o"], where=F.col("v") > 100, keep_single=True)) == [(2, 3, 30)]


def test_lookups_keep_columns_of_their_own_names(spark):
    left = spark.createDataFrame([(1, "a", "b", "c", "d"), (2, "e", "f", "g", "h")], "k int, __hit string, __more string, __outcome string, __r_v string")
    right = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    own = lambda df: sorted(tuple(r)[:5] for r in df.select("k", "__hit", "__more", "__outcome", "__r_v").distinct().collect())
    want = sorted(tuple(r) for r in left.collect())
    assert own(L.join(left, right, ["k"], ["v"], match_limit=1, match_order=["v"], too_many=L.Action(set={"n": F.lit(1)}))) == want
    assert own(L.join(left, right, ["k"], ["v"], L.Action(set={"n": F.lit(1)}))) == want
    assert own(L.compare_rows(left, right, ["k"], L.equal_columns(["k"]), ["v"], status="s")) == want
    assert own(L.key_test(left, right, ["k"], match=L.Action(set={"n": F.lit(1)}))) == want
    assert own(L.as_of(left, right, ["k"], "k", "k", {"v": "v"}, ties=["v"])) == want
    assert own(L.expand(left, right, ["k"], ["v"], ["k"], best=F.col("__r_v"))) == want
