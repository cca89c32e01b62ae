"""Converters on texts and values with known results."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.functions import convert as C
from millrace.functions import keys as K
from millrace.functions import text as X
from millrace.operators import columns as COL


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "text, want",
    [("12", 12), (" -7 ", -7), ("1,234", 1234), ("(5)", -5), ("1e3", 1000), ("2.5", 2), ("3.5", 4), ("$9", 9), ("x", None), ("", None), ("2147483648", None), ("7-", -7)],
)
def test_int_texts(spark, text, want):
    assert one(spark, lambda c: C.to_whole(c, "int"), text) == want


def test_whole_ranges(spark):
    assert one(spark, lambda c: C.to_whole(c, "byte"), "256") is None
    assert one(spark, lambda c: C.to_whole(c, "ushort"), "65535") == 65535
    assert one(spark, lambda c: C.to_whole(c, "ulong"), "18446744073709551615") == Decimal(2**64 - 1)
    assert one(spark, lambda c: C.to_whole(c, "int", of="boolean"), True, "boolean") == 1
    assert one(spark, lambda c: C.to_whole(c, "int", of="double"), 2.5, "double") == 2


@pytest.mark.parametrize(
    "text, locale, want",
    [("1.234", "invariant", 1.234), ("1,234", "hu", 1.234), (" +1,234  ", "hu", 1.234), ("+ 1,234", "hu", None), ("1   234 456,2 ", "hu", 1234456.2), ("-1 234 456,2", "hu", -1234456.2), ("1.234", "hu", 1.234)],
)
def test_localised_numbers(spark, text, locale, want):
    found = one(spark, lambda c: C.localised(c, "decimal(20,6)", locale), text)
    assert (None if found is None else float(found)) == want


@pytest.mark.parametrize(
    "text, locale, want",
    [
        ("2020.5.2.", "invariant", datetime.date(2020, 5, 2)),
        ("05.02.2020 13:14:41.410", "gb", datetime.date(2020, 2, 5)),
        ("2020.02.05 13:14:41.410", "gb", datetime.date(2020, 2, 5)),
        ("02.05.2020 13:14:41.410", "us", datetime.date(2020, 2, 5)),
        ("2020.02.05", "hu", datetime.date(2020, 2, 5)),
        ("nonsense", "hu", None),
    ],
)
def test_dates(spark, text, locale, want):
    assert one(spark, lambda c: C.to_date(c, locale=locale), text) == want


def test_epochs(spark):
    assert one(spark, lambda c: C.to_date(c, of="int", epoch="1899-12-30"), 43831, "int") == datetime.date(2020, 1, 1)
    assert one(spark, lambda c: C.to_timestamp(c, of="double", epoch="1899-12-30"), 43831.5, "double") == datetime.datetime(2020, 1, 1, 12)
    assert one(spark, lambda c: C.to_timestamp(c, of="bigint", epoch="1970-01-01"), 86400, "bigint") == datetime.datetime(1970, 1, 2)


def test_flags_guids_bytes_intervals(spark):
    assert one(spark, C.to_bool, " 1 ") is True and one(spark, C.to_bool, "yes") is None
    assert one(spark, C.to_bool_words, "Yes") is True and one(spark, C.to_bool_words, "NO") is False
    assert one(spark, C.to_guid, "{0F8FAD5B-D9CB-469F-A165-70867728950E}") == "0f8fad5b-d9cb-469f-a165-70867728950e"
    assert bytes(one(spark, C.to_bytes, "aGk=")) == b"hi" and one(spark, C.to_bytes, "?") is None
    assert one(spark, C.to_interval, "1.02:03:04") == datetime.timedelta(days=1, hours=2, minutes=3, seconds=4)
    assert one(spark, C.to_interval, "25:00") is None


def test_hungarian_numbers(spark):
    digits = [1, 2, 3, 4, 5, 6, 7]
    check = -sum(d * w for d, w in zip(digits, C.TAX_WEIGHTS)) % 10
    head = "".join(map(str, digits)) + str(check)
    assert one(spark, C.hungarian_tax_number, head + "242") == f"{head}-2-42"
    assert one(spark, C.hungarian_tax_number, head + "642") is None and one(spark, C.hungarian_tax_number, head + "221") is None
    assert one(spark, C.hungarian_bank_account, head + "00000000") == f"{head}-00000000"
    assert one(spark, C.hungarian_bank_account, "12345678" * 2) in (None, "12345678-12345678")


def test_policies(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x"), (3, None)], "id int, v string")
    out = COL.convert(df, ["v"], C.to_whole, kind="int", null="value", null_value=0)
    assert {r.id: (r.v, len(r["__errors"])) for r in out.collect()} == {1: (5, 0), 2: (None, 1), 3: (0, 0)}
    assert COL.convert(df, ["v"], C.to_whole, kind="int", invalid="remove_row", null="remove_row").count() == 1
    with pytest.raises(Exception, match="TypeConversion"):
        COL.convert(df, {"v": "w"}, C.to_whole, kind="int", invalid="fail").collect()


def test_text_helpers(spark):
    assert one(spark, X.trim_all, "\u00a0\t a b \n") == "a b"
    assert one(spark, lambda c: X.replace_text(c, "a.C", "$1", True), "xA.cy") == "x$1y"
    assert X.combine_url("http://a/", "/b/", "c") == "http://a/b/c"
    assert X.friendly_name("C:\\x\\file 1.csv") == "file 1.csv"


def test_schema_fingerprint(spark):
    a = spark.createDataFrame([], "a int, B string").schema
    b = spark.createDataFrame([], "b string, A int").schema
    assert K.schema_fingerprint(a) == K.schema_fingerprint(b) != K.schema_fingerprint(spark.createDataFrame([], "a bigint, b string").schema)


def test_broken_xml_is_null(spark):
    df = spark.createDataFrame([("<r><a>1</a><b>x</b></r>",), ("<r><a>1",), ("no xml",), (None,)], "t string")
    assert [r.x and tuple(r.x) for r in df.select(C.from_xml(F.col("t"), "a int, b string").alias("x")).collect()] == [(1, "x"), None, None, None]
