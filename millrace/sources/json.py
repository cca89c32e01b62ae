"""JSON sources: arrays of elements, and whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_array(spark: SparkSession, path: str | list[str], schema: str, column: str = "value", file_column: str | None = None) -> DataFrame:
    """A row for each element of the files' top-level arrays, as a struct in one column."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    files = [F.input_file_name().alias(file_column)] if file_column else []
    return rows.select(F.struct("*").alias(column), *files)


def read_json_documents(spark: SparkSession, path: str | list[str], schema: str, column: str = "value") -> DataFrame:
    """A row for each file; a file that is no such document gives null."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias(column))


def parse_json(df: DataFrame, column: str, schema: str, target: str) -> DataFrame:
    return df.withColumn(target, F.from_json(F.col(column), schema))
