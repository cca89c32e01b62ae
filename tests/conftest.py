import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
os.environ["TZ"] = "UTC"

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", "/tmp/checkpoints/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """Runs SQL over the tables of a scale factor."""
    import duckdb

    opened = {}

    def run(sf: str, sql: str):
        if sf not in opened:
            opened[sf] = duckdb.connect()
            for path in Path(DATA, sf).glob("*.parquet"):
                opened[sf].execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        return opened[sf].execute(sql).df()

    return run


def plain(value):
    """Values of pandas frames in one form: missing is None, whole floats are ints."""
    import datetime
    import decimal

    import pandas as pd

    if value is None or value is pd.NaT or (isinstance(value, float) and value != value) or value is pd.NA:
        return None
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float) and value == int(value):
        return int(value)
    if isinstance(value, (pd.Timestamp, datetime.datetime)):
        return pd.Timestamp(value).to_pydatetime()
    if isinstance(value, datetime.date):
        return datetime.datetime(value.year, value.month, value.day)
    return value.item() if hasattr(value, "item") else value


def rows_of(frame):
    """Rows of a pandas frame, columns by name, in a defined order."""
    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(v) for v in row) for row in frame[columns].itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def same():
    def check(left, right):
        assert rows_of(left) == rows_of(right)

    return check
