"""Files, tables, streams and control flow."""

import uuid

import people
import pytest
from pyspark.sql import functions as F

from millrace.errors import ERRORS, InvalidParameter, StepFailed
from millrace.functions import convert as C
from millrace.operators import aggregate as A
from millrace.plans.flow import Flow
from millrace.sinks import files as sinks
from millrace.sources.custom import read_custom
from millrace.sources import delimited as D
from millrace.sources import json as J
from millrace.sources import tables as T
from millrace.streaming import streams


def test_delimited_quotes_breaks_and_errors(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes('\ufeffId;Name;Value;\r\n1;"a ""q"";b";X;\r\n2;"line\r\nbreak";3;\r\n3;"";;\r\n;;;\r\n'.encode())
    out = D.read_delimited(spark, str(path), [D.ReadColumn("id", C.to_whole, "Id", {"kind": "int"}), D.ReadColumn("name", source="Name"), D.ReadColumn("n", C.to_whole, "Value", {"kind": "int"})])
    rows = {r.id: r for r in out.collect()}
    assert set(rows) == {1, 2, 3}
    assert rows[1].name == 'a "q";b' and rows[1].n is None and rows[1][ERRORS]["n"].original == "X"
    assert rows[2].name == "line\r\nbreak" and rows[2].n == 3 and rows[3].name == ""


def test_delimited_header_modes(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("a;A\r\n1;2\r\n")
    with pytest.raises(InvalidParameter):
        D.read_delimited(spark, str(path))
    assert D.read_delimited(spark, str(path), header="none", names=["x", "y"]).count() == 2
    assert D.read_delimited(spark, str(path), header="ignore", names=["x", "y"]).count() == 1


def test_delimited_golden(spark, tmp_path):
    df = spark.createDataFrame([(1, "apple", "Red"), (2, "", None), (3, None, "")], "Id int, Name string, Color string").coalesce(1)
    sinks.write_delimited(df, str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*"))
    assert part.read_bytes().decode() == 'Id;Name;Color\r\n1;apple;Red\r\n2;"";\r\n3;;""\r\n'
    with pytest.raises(Exception):
        sinks.write_delimited(df, str(tmp_path / "out"))
    sinks.write_delimited(df, str(tmp_path / "out"), if_exists="overwrite", partition_by={"kind": F.col("Id") % 2})
    assert {p.name for p in (tmp_path / "out").glob("kind=*")} == {"kind=0", "kind=1"}


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"k": 1}, {"k": 2}]')
    assert sorted(r.value.k for r in J.read_json_array(spark, str(tmp_path / "a.json"), "k int").collect()) == [1, 2]
    (tmp_path / "b.json").write_text('{"k":\n 3}')
    assert J.read_json_documents(spark, str(tmp_path / "b.json"), "k int").first().value.k == 3


def test_table_jobs(spark):
    jobs, name = T.Tables(spark), f"t_{uuid.uuid4().hex[:8]}"
    try:
        jobs.create(name, people.country(spark))
        jobs.merge(name, spark.createDataFrame([(1, "Magyarország"), (9, "New")], "id int, name string"), ["id"])
        rows = {r.id: r for r in spark.table(name).collect()}
        assert rows[1].name == "Magyarország" and rows[1].abbreviation2 == "HU" and rows[9].abbreviation2 is None
        jobs.delete(name, "id = 9")
        jobs.require_key(name, ["id"])
        assert T.read_table(spark, name, ["id"], "id > 1", ["id"], 2).count() == 2
        jobs.copy_structure(name, f"{name}_b")
        jobs.copy_into_existing(name, f"{name}_b", where="id < 3")
        assert spark.table(f"{name}_b").count() == 2
        with pytest.raises(ZeroDivisionError):
            jobs.load_staged({name: lambda: people.country(spark), f"{name}_b": lambda: 1 / 0})
        assert spark.table(name).count() == 4 and not [t for t in jobs.names() if "__stage_" in t]
        jobs.load_staged({name: lambda: people.country(spark).limit(1)}, {name: lambda old, new: T.merged(old, new, ["id"], "insert_only")})
        assert spark.table(name).count() == 4
        jobs.truncate(name)
        assert spark.table(name).count() == 0
    finally:
        jobs.drop(name, f"{name}_b")


def test_merge_modes_and_null_keys(spark):
    old = spark.createDataFrame([(1, "a"), (None, "n"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(None, "N"), (3, "c")], "k int, v string")
    as_dict = lambda df: {r.k: r.v for r in df.collect()}
    assert as_dict(T.merged(old, new, ["k"])) == {1: "a", None: "N", 2: "b", 3: "c"}
    assert as_dict(T.merged(old, new, ["k"], "update_only")) == {1: "a", None: "N", 2: "b"}
    assert as_dict(T.merged(old, new, ["k"], "insert_only")) == {1: "a", None: "n", 2: "b", 3: "c"}
    assert as_dict(T.merged(old, new, ["k"], when_missing="delete")) == {None: "N", 3: "c"}


def test_streams(spark, tmp_path):
    people.eyes(spark).write.parquet(str(tmp_path / "in"))
    stream = streams.listen_files(spark, str(tmp_path / "in"), people.EYES_SCHEMA, files_per_trigger=1)
    out = streams.collect_available(streams.aggregate(stream, ["personId"], [A.count("n")]), "complete", str(tmp_path / "out"), str(tmp_path / "state"))
    assert {r.personId: r.n for r in out.collect()} == {0: 3, 1: 2, 2: 1, 100: 1}
    seen = []
    streams.write_batches(stream, lambda batch, n: seen.append(batch.count()), str(tmp_path / "state2"), all_available=True).awaitTermination()
    assert sum(seen) == 7


def test_windows(spark, tmp_path):
    spark.createDataFrame([(f"2024-01-01 00:0{i}:00",) for i in (0, 1, 6, 7)], "t string").select(F.col("t").cast("timestamp").alias("t"), F.lit(1).alias("k")).write.parquet(str(tmp_path / "in"))
    stream = streams.listen_files(spark, str(tmp_path / "in"), "t timestamp, k int")
    out = streams.collect_available(streams.aggregate_windows(stream, "t", "5 minutes", [A.count("n")]), "append", str(tmp_path / "out"), str(tmp_path / "state"))
    assert [r.n for r in out.collect()] == [2]


def test_flow():
    seen = []
    flow = Flow().set("x", 1).increment("x").run(lambda: 1 / 0).run(lambda: seen.append("skipped"))
    assert flow.state.failed and flow.values["x"] == 2 and not seen
    flow.handle(lambda failures: seen.append(type(failures[0]).__name__)).run(lambda: seen.append("on"))
    assert seen == ["ZeroDivisionError", "on"]
    flow.for_each([1, 0, 2], lambda i, f: f.run(lambda: seen.append(1 // i)), isolated=True)
    assert seen[2:] == [1, 0] and not flow.state.failed
    flow.when(lambda: True, lambda f: f.set("y", 3)).isolate(lambda f: f.run(lambda: 1 / 0))
    assert flow.values["y"] == 3
    with pytest.raises(StepFailed):
        Flow().run(lambda: 1 / 0).raise_failures()


def test_a_failed_replacement_leaves_the_table(spark, monkeypatch):
    jobs = T.Tables(spark)
    spark.sql("DROP TABLE IF EXISTS kept_one")
    spark.sql("DROP TABLE IF EXISTS kept_two")
    jobs.create("kept_one", spark.createDataFrame([(1,)], "k int"))
    jobs.create("kept_two", spark.createDataFrame([(2,)], "k int"))
    before = set(jobs.names())
    with pytest.raises(Exception, match="broken"):
        jobs.replace("kept_one", spark.table("kept_one").withColumn("k", F.raise_error("broken").cast("int")))
    rename, once = T.Tables._rename, []

    def failing_once(self, old, new):
        if new == "kept_two" and "__stage_" in old and not once:
            once.append(new)
            raise RuntimeError("no rename")
        rename(self, old, new)

    monkeypatch.setattr(T.Tables, "_rename", failing_once)
    with pytest.raises(RuntimeError):
        jobs.replace("kept_two", spark.createDataFrame([(9,)], "k int"))
    once.clear()
    with pytest.raises(RuntimeError):
        jobs.load_staged({"kept_one": lambda: spark.createDataFrame([(7,)], "k int"), "kept_two": lambda: spark.createDataFrame([(8,)], "k int")}, retries=0)
    assert [r.k for r in spark.table("kept_one").collect()] == [1] and [r.k for r in spark.table("kept_two").collect()] == [2]
    once.clear()
    jobs.load_staged({"kept_one": lambda: spark.createDataFrame([(7,)], "k int"), "kept_two": lambda: spark.createDataFrame([(8,)], "k int")}, retries=1)
    assert [r.k for r in spark.table("kept_one").collect()] == [7] and [r.k for r in spark.table("kept_two").collect()] == [8]
    assert set(jobs.names()) == before
    jobs.drop("kept_one", "kept_two")


def test_values_of_the_last_row_become_variables(spark):
    flow = Flow().set_from("last", lambda: spark.createDataFrame([(1, "a"), (3, "c"), (2, "b")], "k int, v string"), "v", ["k"])
    assert flow.raise_failures().values["last"] == "c"


def test_rows_of_a_custom_source(spark):
    out = read_custom(spark, lambda part: [(part, i) for i in range(part)], "part int, i int", 4, "triangle")
    assert sorted(tuple(r) for r in out.collect()) == [(p, i) for p in range(4) for i in range(p)]


def test_delimited_skipped_lines_kept_quotes_and_row_numbers(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_bytes('a comment\r\nof two lines\r\nId;Name;Value1;Value2;\r\n1;A;"te""s""t;test";-1;\r\n2;"tes""t;t""est";;-1;\r\n3;"line\r\nbreak";"";0;\r\n;;;;\r\n'.encode())
    columns = [D.ReadColumn("id", C.to_whole, "Id", {"kind": "int"}), D.ReadColumn("name", source="Name"), D.ReadColumn("text", source="Value1")]
    rows = D.read_delimited(spark, str(path), columns, skip_lines=2, row_column="row", file_column="file")
    assert [(r.row, r.id, r.name, r.text) for r in rows.orderBy("row").collect()] == [(0, 1, "A", 'te"s"t;test'), (1, 2, 'tes"t;t"est', None), (2, 3, "line\r\nbreak", "")]
    assert rows.first()["file"].endswith("q.csv")
    kept = D.read_delimited(spark, str(path), columns, skip_lines=2, keep_quotes=True)
    assert [(r.id, r.name, r.text) for r in kept.orderBy("id").collect()][:2] == [(1, "A", '"te"s"t;test"'), (2, '"tes"t;t"est"', None)]


def test_files_are_split_unless_cells_hold_breaks(spark, tmp_path):
    plain, broken = tmp_path / "plain.csv", tmp_path / "broken.csv"
    plain.write_bytes(b'a;b\r\n1;"x;y"\r\n')
    broken.write_bytes(b'a;b\r\n1;"x\r\ny"\r\n')
    assert [D.cells_hold_breaks(spark, str(p), "\r\n", "utf-8") for p in (plain, broken)] == [False, True]
    assert [D.read_delimited(spark, str(p)).first()["b"] for p in (plain, broken)] == ["x;y", "x\r\ny"]
