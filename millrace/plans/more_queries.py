"""Further operators, converters, sources, sinks, streams and flows over the provided tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..errors import ERRORS
from ..functions import convert as C
from ..functions.text import delimited_text
from ..operators import aggregate as A
from ..operators import columns as COL
from ..operators import filters as FIL
from ..operators import generate as GEN
from ..operators import lookup as L
from ..operators import sets as S
from ..sinks import files as sinks
from ..sinks import workbooks as workbook_sinks
from ..sources import custom
from ..sources import delimited as D
from ..sources import json as J
from ..sources import tables as T
from ..sources import workbooks
from ..streaming import streams
from .flow import Flow
from .queries import in_slices
from .registry import query, table, work_path
from .sequence import Seq

# sources


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' END AS status, o_orderstatus = 'O' AS pending FROM orders")
def literal_rows(spark, sf):
    """Orders with the names of their states, which are literal rows."""
    states = spark.createDataFrame([("F", "filled", False), ("O", "open", True), ("P", None, False), (None, "c", None)], "state string, status string, pending boolean")
    return L.join(table(spark, sf, "orders"), states, {"o_orderstatus": "state"}, ["status", "pending"]).select("o_orderkey", "status", "pending")


@query("SELECT c_custkey AS id, c_acctbal AS balance, c_name AS name, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, 0 AS errors FROM customer")
def importer_columns(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").cast("string"), F.format_string("%.2f", "c_acctbal").alias("c_acctbal"), "c_name", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"))
    columns = [
        D.ReadColumn("id", C.to_whole, "c_custkey", {"kind": "long"}),
        D.ReadColumn("balance", C.to_real, "c_acctbal"),
        D.ReadColumn("name", source="c_name"),
        D.ReadColumn("segment", source="seg", on_null="value", null_value="none"),
    ]
    return D.apply_columns(rows, columns).select("id", "balance", "name", "segment", F.size(ERRORS).alias("errors"))


@query("SELECT r_regionkey, r_name, 2 AS uses FROM region")
def cached_sequence(spark, sf):
    rows = Seq(table(spark, sf, "region")).cached()
    both = S.merge(rows.df, rows.df)
    return both.groupBy("r_regionkey", "r_name").agg(F.count(F.lit(1)).cast("int").alias("uses"))


@query("SELECT n_nationkey AS k, n_name AS name FROM nation")
def json_array_elements(spark, sf):
    path = work_path(spark, "json-array")
    array = table(spark, sf, "nation").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("text"))
    sinks.write_text(array, "text", path)
    return J.read_json_array(spark, path, "n_nationkey int, n_name string").select(F.col("value.n_nationkey").alias("k"), F.col("value.n_name").alias("name"))


@query("SELECT r_regionkey AS k, r_name AS name FROM region")
def json_documents(spark, sf):
    """A document for each region, a file for each document."""
    path = work_path(spark, "json-document")
    texts = table(spark, sf, "region").select("r_regionkey", F.to_json(F.struct("*")).alias("text"))
    texts.repartitionById(5, F.col("r_regionkey").cast("int")).select("text").write.text(path)
    return J.read_json_documents(spark, path, "r_regionkey int, r_name string").where("value IS NOT NULL").select(F.col("value.r_regionkey").alias("k"), F.col("value.r_name").alias("name"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def table_scan(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("scanned_orders")
    return T.read_table(spark, "scanned_orders", ["o_orderkey", "o_totalprice"], "o_orderstatus = 'F'", [F.desc("o_totalprice"), "o_orderkey"], 20)


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def query_with_parameters(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("queried_orders")
    return T.read_query(spark, "SELECT o_orderstatus, count(*) AS n FROM queried_orders WHERE o_totalprice > :least GROUP BY 1", least=100000)


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey IN (1, 2, 3, 5, 8, 13, 21, 34) AND o_orderstatus IN ('F', 'O')")
def query_with_list_parameters(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("listed_orders")
    sql = "SELECT o_orderkey, o_orderpriority FROM listed_orders WHERE o_orderkey IN (:ids) AND o_orderstatus IN (:states)"
    return T.read_query(spark, sql, ids=[1, 2, 3, 5, 8, 13, 21, 34], states=["F", "O"])


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN o_totalprice * 0.9 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_totalprice > 200000 THEN o_totalprice END AS before FROM orders")
def set_where(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return FIL.set_where(rows, F.col("o_totalprice") > 200_000, {"o_totalprice": F.col("o_totalprice") * 0.9, "before": F.col("o_totalprice")})


@T.procedure
def customers_of_segment(spark, sf: str, segment: str):
    return table(spark, sf, "customer").where(F.col("c_mktsegment") == segment)


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'MACHINERY'")
def procedure_rows(spark, sf):
    return T.read_procedure(spark, "customers_of_segment", sf=sf, segment="MACHINERY").select("c_custkey", "c_name")


@query(
    """SELECT s.month, count(o_orderkey) AS orders, CAST(sum(CASE WHEN s.month % 4 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS rows_of_part_0
    FROM (SELECT unnest(range(1, 13)) AS month) s LEFT JOIN orders ON month(o_orderdate) = s.month GROUP BY 1"""
)
def custom_source(spark, sf):
    """Orders by month; the months come from a source of one's own, in four parts."""
    months = custom.read_custom(spark, lambda part: ((k, part) for k in range(1, 13) if k % 4 == part), "month long, part int", 4, "months_in_parts")
    orders = table(spark, sf, "orders").select(F.month("o_orderdate").cast("long").alias("of"), "o_orderkey")
    rows = months.join(orders, F.col("month") == F.col("of"), "left")
    return rows.groupBy("month").agg(F.count("o_orderkey").alias("orders"), F.count_if(F.col("part") == 0).alias("rows_of_part_0"))


@query("SELECT n_nationkey, n_name FROM nation")
def workbook_roundtrip(spark, sf):
    folder = work_path(spark, "workbooks")
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name", F.lit("all").alias("book"))
    workbook_sinks.write_workbooks(rows, folder, F.col("book"), ["n_nationkey", "n_name"], ["n_nationkey"]).collect()
    out = workbooks.read_workbook(spark, folder)
    return out.select(F.col("n_nationkey").cast("double").cast("int").alias("n_nationkey"), "n_name")


# filters and columns


@query(
    """SELECT p_partkey, CASE WHEN p_size > 40 AND p_retailprice > 1200 THEN 'dear and large' WHEN p_size > 40 THEN 'large' ELSE p_type END AS p_type, 1 AS seen
    FROM part WHERE NOT (p_size > 40 AND p_partkey % 3 = 0)"""
)
def nested_conditions(spark, sf):
    mark = lambda text: lambda df: df.withColumn("p_type", F.lit(text))
    large = lambda rows: rows.remove_rows(F.col("p_partkey") % 3 == 0).then(mark("large")).when(F.col("p_retailprice") > 1200, lambda r: r.then(mark("dear and large")))
    out = Seq(table(spark, sf, "part")).when(F.col("p_size") > 40, large)
    out = out.if_true(True, lambda rows: rows.then(lambda df: df.withColumn("seen", F.lit(1)))).if_true(False, lambda rows: rows.remove_all_rows())
    return out.result().select("p_partkey", "p_type", "seen")


@query("SELECT * FROM region WHERE false")
def remove_all(spark, sf):
    return FIL.remove_all_rows(table(spark, sf, "region"))


@query("SELECT p_partkey, p_size FROM part WHERE p_size <= 40")
def no_error_left(spark, sf):
    rows = FIL.validate(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", F.col("p_size") <= 40, "too large")
    return FIL.fail_on_error(FIL.remove_rows_with_error(rows)).drop(ERRORS)


@query("SELECT event_id, user_id, event_type FROM events WHERE NOT (event_type IS NULL OR event_type = '')")
def remove_blank(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    blank = F.col("event_type").isNull() | (F.col("event_type") == "")
    return FIL.remove_blank_rows(rows.select(*[F.when(~blank, F.col(c)).alias(c) for c in rows.columns]))


@query("SELECT p_partkey, 'n' || p_size AS raw, CASE WHEN p_size % 2 = 0 THEN p_size END AS size, CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END AS errors FROM part")
def convert_into_new_column(spark, sf):
    digits = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("odd")
    rows = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("n"), "p_size").alias("raw"), digits.alias("digits"))
    return COL.convert(rows, {"digits": "size"}, C.to_whole, kind="int").select("p_partkey", "raw", "size", F.size(ERRORS).alias("errors"))


@query("SELECT p_partkey, p_size * 2 AS doubled FROM part")
def custom_code(spark, sf):
    return Seq(table(spark, sf, "part")).then(lambda df: df.select("p_partkey", (F.col("p_size") * 2).alias("doubled"))).result()


@query("SELECT c_mktsegment, count(DISTINCT c_nationkey) AS checksums, 1 AS equal_rows FROM customer GROUP BY 1")
def row_checksums(spark, sf):
    """Equal rows have equal checksums and different ones different checksums."""
    rows = COL.add_checksum(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), "sum", excluding=["c_custkey"])
    each = rows.groupBy("c_mktsegment", "sum").agg(F.count_distinct(F.col("c_nationkey")).alias("n"))
    return each.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("checksums"), F.max("n").cast("int").alias("equal_rows"))


@query("SELECT r_name AS region, n_name AS nation, NULL AS comment FROM nation JOIN region ON n_regionkey = r_regionkey")
def row_columns(spark, sf):
    """Rows copied with other columns: renamed, set, removed."""
    rows = L.join(table(spark, sf, "nation"), table(spark, sf, "region"), {"n_regionkey": "r_regionkey"}, {"region": "r_name"}, L.Action(L.REMOVE))
    return COL.keep_columns(COL.rename_columns(rows, {"n_name": "nation"}).withColumn("comment", F.lit(None).cast("int")), "region", "nation", "comment")


# aggregation


@query(
    """SELECT o_orderstatus, round(avg(CAST(o_custkey % 1000 AS INTEGER)), 6) AS int_mean, round(avg(o_orderkey), 6) AS long_mean, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18, 2))) / count(*), 6) AS DOUBLE) AS decimal_mean,
    max(o_orderkey) AS long_high, min(o_orderkey) AS long_low, CAST(max(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS decimal_high, CAST(min(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS decimal_low,
    CAST(sum(CAST(o_custkey % 1000 AS INTEGER)) AS INTEGER) AS int_total FROM orders GROUP BY 1"""
)
def typed_averages_and_extremes(spark, sf):
    rows = table(spark, sf, "orders").withColumns({"n": (F.col("o_custkey") % 1000).cast("int"), "d": F.col("o_totalprice").cast("decimal(18,2)")})
    specs = [
        A.custom("int_mean", F.round(A.average("n").column, 6)), A.custom("long_mean", F.round(A.average("o_orderkey").column, 6)), A.custom("decimal_mean", F.round(A.average("d", kind="decimal(28,8)").column, 6).cast("double")),
        A.greatest("o_orderkey", "long_high"), A.least("o_orderkey", "long_low"), A.custom("decimal_high", A.greatest("d").column.cast("double")), A.custom("decimal_low", A.least("d").column.cast("double")), A.total("n", "int_total", "int"),
    ]
    return A.aggregate(rows, ["o_orderstatus"], specs)


@query("SELECT c_mktsegment, count(*) AS n, max(c_acctbal) - min(c_acctbal) AS spread FROM customer GROUP BY 1")
def grouped_python(spark, sf):
    """Whole groups through a Python function; segments are few and their rows bounded here."""

    def spread(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c_mktsegment": rows["c_mktsegment"].iloc[:1], "n": [len(rows)], "spread": [rows["c_acctbal"].max() - rows["c_acctbal"].min()]})

    return A.aggregate_frames(table(spark, sf, "customer").select("c_mktsegment", "c_acctbal"), ["c_mktsegment"], spread, "c_mktsegment string, n long, spread double")


@query("SELECT n_nationkey, CAST(i AS INTEGER) AS i FROM nation, range(0, 3) AS r(i) WHERE i <= n_nationkey % 3")
def python_explode(spark, sf):
    def made(batches):
        for rows in batches:
            yield pd.DataFrame([(k, i) for k in rows["n_nationkey"] for i in range(k % 3 + 1)], columns=["n_nationkey", "i"])

    return GEN.explode_frames(table(spark, sf, "nation").select("n_nationkey"), made, "n_nationkey int, i int")


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, CASE WHEN count(*) = 1 THEN any_value(o_totalprice) ELSE round(sum(o_totalprice), 2) END AS o_totalprice FROM orders GROUP BY 1")
def reduce_group_altered(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    out = A.reduce_groups(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], set={"o_totalprice": F.round(F.sum("o_totalprice"), 2)}, keep_single=True)
    return out.select("o_custkey", F.col("o_orderkey").alias("first_order"), "o_totalprice")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F', o_orderkey) AS rn FROM orders) WHERE rn = 1 AND (n = 1 OR o_orderstatus = 'F')")
def reduce_group_keep_single(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return A.reduce_groups(rows, ["o_custkey"], ["o_orderkey"], where=F.col("o_orderstatus") == "F", keep_single=True).select("o_custkey", "o_orderkey")


# lookups in their batched names: Spark's joins are batched throughout


@query("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def batched_join(spark, sf):
    return L.join(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), table(spark, sf, "orders"), {"l_orderkey": "o_orderkey"}, ["o_orderstatus"], L.Action(L.REMOVE))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%')")
def batched_key_test(spark, sf):
    return L.key_test(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), table(spark, sf, "orders"), {"l_orderkey": "o_orderkey"}, no_match=L.Action(L.REMOVE), match_where=F.col("o_orderpriority").startswith("1"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'different' ELSE 'same' END AS status FROM customer")
def batched_compare(spark, sf):
    left = table(spark, sf, "customer").select("c_custkey", "c_name")
    right = left.withColumn("c_name", F.when(F.col("c_custkey") % 9 == 0, "other").otherwise(F.col("c_name")))
    return L.compare_rows(left, right, ["c_custkey"], L.equal_all_columns(left, right), ["c_name"], status="status").select("c_custkey", "status")


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def join_then_keep(spark, sf):
    return L.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "customer"), {"o_custkey": "c_custkey"}, ["c_name"], match_where=F.col("c_acctbal") > 0).select("o_orderkey", "c_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7")
def rows_of_one_key(spark, sf):
    return L.rows_of_key(table(spark, sf, "orders"), {"o_custkey": 7}).select("o_orderkey", "o_custkey")


@query("SELECT n_name AS name, 'nation' AS kind, n_regionkey AS region FROM nation UNION ALL SELECT r_name, 'region', NULL FROM region")
def merged_inputs(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("kind"), F.col("n_regionkey").alias("region"))
    return S.merge(nations, table(spark, sf, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("kind")))


# sinks


@query("SELECT s_suppkey, s_name, CAST(s_nationkey % 3 AS INTEGER) AS part FROM supplier")
def partitioned_sink(spark, sf):
    path = work_path(spark, "partitioned")
    sinks.write_delimited(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path, {"id": "s_suppkey", "name": "s_name"}, partition_by={"part": F.col("s_nationkey") % 3})
    rows = D.read_delimited(spark, f"{path}/part=*", [D.ReadColumn("id", C.to_whole, options={"kind": "long"}), D.ReadColumn("name")], file_column="file")
    return rows.select(F.col("id").alias("s_suppkey"), F.col("name").alias("s_name"), F.regexp_extract("file", r"part=(\d)", 1).cast("int").alias("part"))


@query("SELECT n_name AS line FROM nation")
def text_sink(spark, sf):
    path = work_path(spark, "text")
    sinks.write_text(table(spark, sf, "nation"), "n_name", path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def json_sink_appends(spark, sf):
    path = work_path(spark, "json-twice")
    for _ in range(2):
        sinks.write_json(table(spark, sf, "region"), path, "continue")
    return spark.read.schema("r_regionkey int, r_name string").json(path)


# converters


@query(
    """SELECT p_partkey, CAST(p_size AS TINYINT) AS tiny, CAST(p_size * 100 AS SMALLINT) AS small, CASE WHEN p_size * 6 <= 255 THEN CAST(p_size * 6 AS SMALLINT) END AS byte, CAST(p_size * 1000 AS INTEGER) AS ushort,
    CAST(p_size AS BIGINT) * 1000000 AS uint, CAST(p_size AS BIGINT) * 10000000000 AS long, CAST(p_size AS BIGINT) * 3 AS ulong, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS of_bool, CAST(round_even(p_size / 2.0, 0) AS INTEGER) AS halves FROM part"""
)
def convert_whole_kinds(spark, sf):
    n = F.col("p_size").cast("long")
    text = lambda c: c.cast("string")
    return table(spark, sf, "part").select(
        "p_partkey", C.to_whole(text(n), "sbyte").alias("tiny"), C.to_whole(text(n * 100), "short").alias("small"), C.to_whole(text(n * 6), "byte").alias("byte"), C.to_whole(text(n * 1000), "ushort").alias("ushort"),
        C.to_whole(text(n * 1000000), "uint").alias("uint"), C.to_whole(text(n * 10000000000), "long").alias("long"), C.to_whole(text(n * 3), "ulong").cast("long").alias("ulong"), C.to_whole(n % 2 == 0, "int", "boolean").alias("of_bool"), C.to_whole(n / 2, "int", "double").alias("halves"),
    )


@query("SELECT p_partkey, CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS single, p_retailprice AS double, CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS DOUBLE) AS exact, -p_retailprice AS negative, p_retailprice AS localised FROM part")
def convert_real_kinds(spark, sf):
    text = F.format_string("%.2f", "p_retailprice")
    return table(spark, sf, "part").select(
        "p_partkey", C.to_real(text, "float").cast("double").alias("single"), C.to_real(F.concat(F.lit(" "), text), "double").alias("double"), C.to_real(text, "decimal(12,2)").cast("double").alias("exact"),
        C.to_real(F.concat(F.lit("("), text, F.lit(")"))).alias("negative"), C.localised(F.translate(text, ".", ","), "double", "hu").alias("localised"),
    )


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS flag, CASE p_partkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN TRUE END AS word FROM part")
def convert_flags(spark, sf):
    turn = F.col("p_partkey") % 4
    return table(spark, sf, "part").select("p_partkey", C.to_bool(F.when(turn == 0, " 1").when(turn == 1, "0").otherwise("x")).alias("flag"), C.to_bool_words(F.when(turn == 0, "YES").when(turn == 1, " false").when(turn == 2, "igen").otherwise("?"), true=("igen",)).alias("word"))


@query(
    """SELECT o_orderkey, epoch(o_orderdate) - 7200 AS zoned, TIMESTAMP '2000-01-01' + to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 60) + to_seconds(30) AS at,
    CAST(o_orderdate AS DATE) AS of_number, strftime(o_orderdate, '%Y/%m/%d') AS text, CAST(o_orderdate AS DATE) AS gb FROM orders"""
)
def convert_times(spark, sf):
    rows = table(spark, sf, "orders").withColumn("k", F.col("o_orderkey").cast("int"))
    clock = F.format_string("%02d:%02d:30", F.col("k") % 24, F.col("k") % 60)
    days = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date"))
    return rows.select(
        "o_orderkey", F.unix_timestamp(C.to_zoned(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))).cast("double").alias("zoned"), (F.lit("2000-01-01").cast("timestamp_ntz") + C.to_interval(clock)).alias("at"),
        C.to_date(days, "int", epoch="1899-12-30").alias("of_number"), C.to_text(F.col("o_orderdate"), "timestamp_ntz", "yyyy/MM/dd").alias("text"), C.to_date(F.date_format("o_orderdate", "dd/MM/yyyy"), locale="gb").alias("gb"),
    )


@query(
    """SELECT p_partkey, regexp_replace(md5(p_name), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS guid, hex(CAST(p_name AS BLOB)) AS bytes, p_size AS xml_size, NULL AS broken, p_partkey * 7 AS version FROM part"""
)
def convert_binary_forms(spark, sf):
    guid = F.upper(F.regexp_replace(F.md5("p_name"), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "{$1-$2-$3-$4-$5}"))
    xml = C.from_xml(C.to_xml(F.struct("p_size", "p_name")), "p_size int, p_name string")
    return table(spark, sf, "part").select(
        "p_partkey", C.to_guid(guid).alias("guid"), F.hex(C.to_bytes(F.base64("p_name"))).alias("bytes"), xml["p_size"].alias("xml_size"), C.from_xml(F.concat(F.lit("<r><p_size>"), "p_name"), "p_size int").cast("string").cast("int").alias("broken"),
        C.row_version(F.unhex(F.lpad(F.hex(F.col("p_partkey") * 7), 16, "0"))).cast("long").alias("version"),
    )


_DIGITS = "lpad(CAST(p_partkey * 37 + 1000000 AS VARCHAR), 7, '0')"
_CHECK = "CAST((10 - (" + " + ".join(f"CAST(substr(d, {i + 1}, 1) AS INTEGER) * {w}" for i, w in enumerate((9, 7, 3, 1, 9, 7, 3))) + ") % 10) % 10 AS VARCHAR)"


@query(
    f"""SELECT p_partkey, CASE WHEN p_partkey % 6 < 5 THEN d || {_CHECK} || '-' || (p_partkey % 6 + 1) || '-42' END AS tax, CASE WHEN p_partkey % 2 = 0 THEN d || {_CHECK} || '-00000000' END AS account
    FROM (SELECT p_partkey, {_DIGITS} AS d FROM part)"""
)
def convert_registered_numbers(spark, sf):
    d = F.lpad((F.col("p_partkey") * 37 + 1000000).cast("string"), 7, "0")
    check = F.pmod(F.lit(10) - F.pmod(sum(F.substring(d, i + 1, 1).cast("int") * w for i, w in enumerate(C.TAX_WEIGHTS)), F.lit(10)), F.lit(10))
    wrong = F.pmod(check + F.col("p_partkey") % 2, F.lit(10)).cast("int")
    tax = F.concat(d, check.cast("string"), (F.col("p_partkey") % 6 + 1).cast("string"), F.lit("42"))
    return table(spark, sf, "part").select("p_partkey", C.hungarian_tax_number(tax).alias("tax"), C.hungarian_bank_account(F.concat(d, wrong.cast("string"), F.lit("00000000"))).alias("account"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y.%m.%d %H:%M:%S') || '.0000000' AS at, regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS VARCHAR), '\\.?0+$', '') AS price FROM orders")
def delimited_texts(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", delimited_text(F.col("o_orderdate"), "timestamp_ntz").alias("at"), delimited_text(F.col("o_totalprice").cast("decimal(12,2)"), "decimal(12,2)").alias("price"))


# streams


@query("SELECT event_id, event_type FROM events WHERE value > 50")
def streaming_sink(spark, sf):
    """Micro-batches flushed to a sink."""
    path = work_path(spark, "flushed")
    stream = streams.listen_files(spark, f"{sf}/event[s].parquet", table(spark, sf, "events").schema).where("value > 50").select("event_id", "event_type")
    streams.write_batches(stream, lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}"), work_path(spark, "flushed-state"), all_available=True).awaitTermination()
    return spark.read.parquet(path).select("event_id", "event_type")


@query("SELECT user_id, CAST(count(*) AS INTEGER) AS n FROM events GROUP BY 1")
def streaming_update(spark, sf):
    """Counts by user, updated by several micro-batches: the events come in slices."""
    out, checkpoint = work_path(spark, "update"), work_path(spark, "update-state")
    for stream in in_slices(spark, sf, F.col("event_id"), 3):
        rows = streams.collect_available(streams.aggregate(stream, ["user_id"], [A.count("n")]), "update", out, checkpoint, ["user_id"])
    return rows


# flows and table jobs


@query("SELECT * FROM (VALUES ('items', 6), ('failed_items', 1), ('rows', 25), ('skipped', 0), ('last', 24), ('branch', 1)) AS v(name, value)")
def flow_steps(spark, sf):
    """Steps, values, branches, loops with isolation, and a failure that is handled."""
    flow = Flow()
    flow.set("items", 0).set("failed_items", 0).set("skipped", 0)

    def body(item, inner):
        inner.increment("items", item)
        inner.run(lambda: 1 // item if item else 1 // 0)

    flow.for_each([1, 2, 3, 0], body, isolated=True)
    flow.execute(lambda: table(spark, sf, "nation"), into="rows")
    flow.set_from("last", lambda: table(spark, sf, "nation"), "n_nationkey", ["n_nationkey"])
    flow.when(lambda: flow.values["rows"] > 10, lambda f: f.set("branch", 1), lambda f: f.set("branch", 2))
    flow.run(lambda: 1 // 0).increment("skipped").handle(lambda failures: flow.values.__setitem__("failed_items", len(failures)))
    flow.raise_failures()
    names = ["items", "failed_items", "rows", "skipped", "last", "branch"]
    return spark.createDataFrame([(n, int(flow.values[n])) for n in names], "name string, value int")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'merged' ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 100, 'new' UNION ALL SELECT 101, 'appended'")
def table_jobs(spark, sf):
    """Tables are created, copied, changed, merged and dropped; the result is written before they go."""
    jobs, mark = T.Tables(spark), uuid.uuid4().hex[:12]
    one, two = f"jobs_one_{mark}", f"jobs_two_{mark}"
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name")
    try:
        jobs.create(one, nations)
        jobs.copy_structure(one, two)
        jobs.copy_into_existing(one, two)
        jobs.truncate(one)
        jobs.delete(two, "n_nationkey = 3")
        jobs.append(one, spark.createDataFrame([(101, "appended")], "n_nationkey int, n_name string"))
        jobs.copy_into_existing(one, two)
        merged = S.merge(nations.where("n_nationkey % 5 = 0").withColumn("n_name", F.lit("merged")), spark.createDataFrame([(100, "new")], "n_nationkey int, n_name string"))
        jobs.merge(two, merged, ["n_nationkey"])
        jobs.require_key(two, ["n_nationkey"])
        path = work_path(spark, "jobs")
        sinks.write_table_files(spark.table(two), path)
    finally:
        jobs.drop(one, two)
    return spark.read.parquet(path)


@query("SELECT r_regionkey, r_name || '!' AS r_name FROM region UNION ALL SELECT 100 + n_nationkey, n_name FROM nation")
def staged_load(spark, sf):
    jobs, mark = T.Tables(spark), uuid.uuid4().hex[:12]
    one, two = f"staged_one_{mark}", f"staged_two_{mark}"
    regions = table(spark, sf, "region")
    try:
        jobs.create(one, regions)
        nations = table(spark, sf, "nation").select((F.col("n_nationkey") + 100).alias("r_regionkey"), F.col("n_name").alias("r_name"))
        jobs.load_staged({one: lambda: regions.withColumn("r_name", F.concat("r_name", F.lit("!"))), two: lambda: nations})
        path = work_path(spark, "staged")
        sinks.write_table_files(S.merge(spark.table(one), spark.table(two)), path)
    finally:
        jobs.drop(one, two)
    return spark.read.parquet(path)
