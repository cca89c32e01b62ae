"""Workbooks round trip; jobs over single files."""

import zipfile

import people
import pytest
from pyspark.sql import functions as F

from millrace.errors import InvalidParameter
from millrace.sinks import workbooks as out
from millrace.sources import file_jobs as jobs
from millrace.sources import workbooks as W


def test_workbook_round_trip(spark, tmp_path):
    made = out.write_workbooks(people.person(spark), f"file://{tmp_path}", F.col("height"), ["id", "name", "age"], ["id"], "People").collect()
    assert {(r.key, r.rows) for r in made} == {("160", 3), ("190", 1), ("170", 1), ("140", 2)}
    rows = W.read_workbook(spark, f"{tmp_path}/160.xlsx", "People").orderBy("row").collect()
    assert [(r.id, r.name, r.age) for r in rows] == [("0", "A", "17"), ("3", "D", "39"), ("4", "E", "-3")]
    assert W.read_workbook(spark, f"{tmp_path}/140.xlsx").where("age IS NULL").count() == 1
    assert {r.name for r in W.list_sheets(spark, f"{tmp_path}/*.xlsx").collect()} == {"People"}
    with pytest.raises(Exception):
        W.read_workbook(spark, f"{tmp_path}/160.xlsx", "Other")


def book(path, rows, sheet="S"):
    import pandas as pd

    path.write_bytes(out.workbook_bytes(pd.DataFrame(rows[1:], columns=rows[0], dtype=object), sheet))


def test_each_workbook_has_its_own_header(spark, tmp_path):
    book(tmp_path / "a.xlsx", [["id", "name"], ["1", " A "], ["", None], ["2", "B"]])
    book(tmp_path / "b.xlsx", [["NAME", "extra", "id"], ["C", "x", "3"]])
    book(tmp_path / "c.xlsx", [["other"], ["y"]], "T")
    rows = W.read_workbook(spark, f"{tmp_path}/*.xlsx", "S")
    assert rows.columns == ["file", "row", "id", "name", "extra"]
    assert sorted((r.id, r.name, r.extra) for r in rows.collect()) == [("1", "A", None), ("2", "B", None), ("3", "C", "x")]


def test_header_modes_and_repeated_names(spark, tmp_path):
    book(tmp_path / "a.xlsx", [["a", "a", "b", "A"], ["x", "a", "", "z"], ["1", "2", "3", "4"]])
    read = lambda mode: W.read_workbook(spark, f"{tmp_path}/a.xlsx", header_rows=[1, 2], header_mode=mode, join_headers="/")
    assert read("join").columns[2:] == ["a/x", "a", "b", "A/z"]
    assert read("first").columns[2:] == ["a", "a1", "b", "A2"]
    assert read("last").columns[2:] == ["x", "a", "b", "z"]
    assert tuple(read("last").first())[2:] == ("1", "2", "3", "4")
    with pytest.raises(InvalidParameter):
        read("none")


def test_file_jobs(tmp_path):
    jobs.create_folder(str(tmp_path / "a/b"))
    (tmp_path / "x").write_text("1")
    jobs.move_file(str(tmp_path / "x"), str(tmp_path / "a/b/x"))
    (tmp_path / "x").write_text("2")
    with pytest.raises(FileExistsError):
        jobs.move_file(str(tmp_path / "x"), str(tmp_path / "a/b/x"))
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/y", "3")
    assert jobs.extract_archive(str(tmp_path / "z.zip"), str(tmp_path / "u")) == ["in/y"]
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../y", "3")
    with pytest.raises(ValueError):
        jobs.extract_archive(str(tmp_path / "bad.zip"), str(tmp_path / "u"))
    assert jobs.download((tmp_path / "x").as_uri()) == b"2"
    jobs.delete_file(str(tmp_path / "x"))
    jobs.delete_folder(str(tmp_path / "a"))
    assert not (tmp_path / "a").exists()
