"""Files with columns of their own for each partition."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.errors import InvalidParameter
from millrace.sinks.partitioned import write_dynamic
from millrace.sources import delimited as D


def files_below(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names)


def test_partitions_with_headers_of_their_own(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 'x;"y"'), (2, "a", ""), (3, "b/c", " z"), (4, None, "l\nm"), (5, "other", None)], "id int, kind string, t string").repartition(3)
    layouts = {"a": {"Number": "id", "Text": "t"}, "b/c": ["t"], "": ["id", "t"]}
    write_dynamic(rows, str(tmp_path), F.col("kind"), layouts, ["kind", "id"])
    assert {f.split("/")[0] for f in files_below(tmp_path)} == {"a", "b%2Fc", "__empty", "other"}
    read = lambda name: D.read_delimited(spark, str(tmp_path / name))
    assert read("a").columns == ["Number", "Text"] and sorted(tuple(r) for r in read("a").collect()) == [("1", 'x;"y"'), ("2", "")]
    assert read("b%2Fc").columns == ["t"] and read("b%2Fc").first().t == " z"
    assert tuple(read("__empty").first()) == ("4", "l\nm") and tuple(read("other").first()) == ("other", "5")


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    rows = spark.range(100).select("id", F.when(F.col("id") == 77, F.raise_error("broken")).otherwise("k").alias("k")).repartition(4, "id")
    with pytest.raises(Exception, match="broken"):
        write_dynamic(rows, str(tmp_path / "out"), F.lit("p"), {"p": ["id", "k"]})
    assert not (tmp_path / "out").exists() or files_below(tmp_path / "out") == []
    with pytest.raises(Exception, match="no columns are given"):
        write_dynamic(spark.range(3), str(tmp_path / "out"), F.col("id"), {"0": ["id"]})
    assert files_below(tmp_path / "out") == []
    with pytest.raises(InvalidParameter):
        write_dynamic(spark.range(3), str(tmp_path / "out"), F.col("id"), {"0": ["no"]})


def test_a_hot_partition_is_written_by_several_tasks(spark, tmp_path):
    write_dynamic(spark.range(1000).repartition(4), str(tmp_path), F.lit("hot"), {"hot": {"n": "id"}}, header=False)
    assert len(files_below(tmp_path)) == 4
    rows = D.read_delimited(spark, str(tmp_path / "hot"), header="none", names=["n"])
    assert sorted(int(r.n) for r in rows.collect()) == list(range(1000))
