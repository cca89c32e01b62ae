"""The library's operators over the provided tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..errors import ERRORS, TAG
from ..functions import convert as C
from ..operators import aggregate as A
from ..operators import columns as COL
from ..operators import filters as FIL
from ..operators import generate as GEN
from ..operators import lookup as L
from ..operators import sets as S
from ..sinks import database
from ..sinks import files as sinks
from ..sinks.partitioned import write_dynamic
from ..sinks.shards import Shards
from ..sources import delimited as D
from ..sources import json as J
from ..sources import merge as M
from ..sources import tables as T
from ..streaming import push, state, streams
from .flow import Flow, last_value
from .registry import query, table, work_path
from .sequence import Seq


@query(
    """SELECT o_orderkey, round(sum(coalesce(l_extendedprice * (1 - l_discount), 0)), 4) AS revenue, count(*) AS cnt
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    GROUP BY o_orderkey ORDER BY revenue DESC, o_orderkey LIMIT 10"""
)
def flagship(spark, sf):
    """The ten orders of building-segment customers with the highest revenue."""
    building = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    orders = L.key_test(table(spark, sf, "orders"), building, {"o_custkey": "c_custkey"}, no_match=L.Action(L.REMOVE))
    items = L.join(table(spark, sf, "lineitem"), orders, {"l_orderkey": "o_orderkey"}, ["o_orderkey"], L.Action(L.REMOVE))
    revenue = F.sum(F.coalesce(F.col("l_extendedprice") * (1 - F.col("l_discount")), F.lit(0.0)))
    grouped = A.aggregate(items, ["o_orderkey"], [A.custom("revenue", F.round(revenue, 4)), A.custom("cnt", F.count(F.lit(1)))])
    return S.sort(grouped, F.desc("revenue"), "o_orderkey", limit=10)


@query("SELECT * FROM lineitem WHERE NOT coalesce(l_quantity > 45, false)")
def remove_row(spark, sf):
    return FIL.remove_rows(table(spark, sf, "lineitem"), F.col("l_quantity") > 45)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'done' END AS tag FROM orders")
def if_tag_conditional(spark, sf):
    rows = COL.set_tag(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done"))
    out = Seq(rows).when_tag(lambda t: t == "pending", lambda s: s.then(lambda df: df.withColumn("o_totalprice", F.lit(0.0)))).df
    return out.select("o_orderkey", "o_totalprice", F.col(TAG).alias("tag"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS s_acctbal, CASE WHEN s_acctbal >= 0 THEN 0 ELSE 1 END AS errors FROM supplier")
def validate_and_wrap(spark, sf):
    out = FIL.validate(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", F.col("s_acctbal") >= 0, "negative balance")
    return out.select("s_suppkey", "s_acctbal", F.size(ERRORS).alias("errors"))


@query("SELECT p_partkey, CASE WHEN p_retailprice < 1500 THEN p_retailprice ELSE -1.0 END AS p_retailprice FROM part")
def replace_errors(spark, sf):
    out = FIL.validate(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", F.col("p_retailprice") < 1500, "too dear")
    return COL.replace_error(out, -1.0, "p_retailprice").drop(ERRORS)


@query("SELECT p_partkey, p_size FROM part WHERE p_size <= 25")
def remove_rows_with_error(spark, sf):
    out = FIL.validate(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", F.col("p_size") <= 25, "too large")
    return FIL.remove_rows_with_error(out).drop(ERRORS)


@query("SELECT c_custkey AS customer_id, c_name AS name, c_acctbal AS balance FROM customer")
def rename_remove_columns(spark, sf):
    out = COL.rename_columns(table(spark, sf, "customer"), {"c_custkey": "customer_id", "c_name": "name", "c_acctbal": "balance"})
    return COL.remove_columns(out, "c_nationkey", "c_mktsegment")


@query("SELECT event_id, coalesce(nullif(props, '{\"k\": 30}'), 'none') AS props, coalesce(value, 0) AS value FROM events")
def replace_null(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.nullif("props", F.lit('{"k": 30}')).alias("props"), "value")
    return COL.replace_null(COL.replace_null(rows, "none", "props"), 0.0, "value")


@query("SELECT event_id, nullif(CASE WHEN event_type = 'view' THEN '' ELSE event_type END, '') AS event_type FROM events")
def empty_to_null(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("event_type"))
    return COL.empty_to_null(rows)


_CONVERTED = """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN -1 ELSE p_size END AS n,
  CASE WHEN p_partkey % 7 = 0 THEN 0 WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS errors, CAST(p_retailprice AS DOUBLE) AS price, CAST(p_retailprice AS DOUBLE) AS money FROM part"""


@query(_CONVERTED)
def convert_policies(spark, sf):
    key = F.col("p_partkey")
    raw = F.when(key % 7 == 0, None).when(key % 5 == 0, "x1").otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" ")))
    rows = table(spark, sf, "part").select("p_partkey", raw.alias("n"), F.concat(F.lit("+"), F.format_string("%.2f", "p_retailprice")).alias("price"), F.format_number("p_retailprice", 2).alias("money"))
    rows = COL.convert(rows, ["n"], C.to_whole, kind="int")
    rows = COL.convert(rows, ["price"], C.to_real, invalid="fail")
    rows = COL.convert(rows, ["money"], C.to_real, invalid="fail", kind="decimal(18,2)")
    return rows.select("p_partkey", F.when(FIL._true(FIL.has_error()), -1).otherwise(F.col("n")).alias("n"), F.size(ERRORS).alias("errors"), "price", F.col("money").cast("double").alias("money"))


@query("SELECT n_nationkey, n_name || '/' || r_name || '/' AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def merge_text_columns(spark, sf):
    rows = L.join(table(spark, sf, "nation"), table(spark, sf, "region"), {"n_regionkey": "r_regionkey"}, ["r_name"], L.Action(L.REMOVE)).withColumn("none", F.lit(None).cast("string"))
    return COL.merge_text_columns(rows, ["n_name", "r_name", "none"], "place", "/", drop_source=True).select("n_nationkey", "place")


@query("SELECT event_id, make_timestamp(year(DATE '2020-02-29'), 2, 29, hour(ts), minute(ts), floor(second(ts))) AS at FROM events")
def merge_date_with_time(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.lit("2020-02-29 10:11:12").cast("timestamp_ntz").alias("day"), "ts")
    return COL.merge_date_with_time(rows, "day", "ts", "at").select("event_id", "at")


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) + 99 AS id FROM orders")
def incremental_id(spark, sf):
    return COL.add_incremental_id(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "id", ["o_totalprice", "o_orderkey"], first=100)


@query("SELECT c_custkey, sha256(concat(c_name, chr(0), CAST(c_nationkey AS VARCHAR), chr(0), coalesce(nullif(c_mktsegment, 'BUILDING'), '-'))) AS h, sha256(c_name) AS name_hash FROM customer")
def key_hash(spark, sf):
    rows = table(spark, sf, "customer").withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    rows = COL.add_key_hash(COL.add_key_hash(rows, "h", ["c_name", "c_nationkey", "segment"]), "name_hash", ["c_name"])
    return rows.select("c_custkey", "h", "name_hash")


@query(
    """WITH l AS (SELECT o_orderkey, CAST(o_orderkey % 4 AS INTEGER) AS depth FROM orders), p AS (
      SELECT o_orderkey, depth,
        last_value(CASE WHEN depth = 0 THEN o_orderkey END IGNORE NULLS) OVER w AS l0,
        last_value(CASE WHEN depth = 1 THEN o_orderkey END IGNORE NULLS) OVER w AS l1,
        last_value(CASE WHEN depth = 2 THEN o_orderkey END IGNORE NULLS) OVER w AS l2
      FROM l WINDOW w AS (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT o_orderkey, CASE depth WHEN 1 THEN l0 WHEN 2 THEN l1 WHEN 3 THEN l2 END AS parent, depth AS level FROM p"""
)
def resolve_hierarchy(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", *[F.when(F.col("o_orderkey") % 4 == i, F.concat(F.lit("n"), F.col("o_orderkey"))).alias(f"level{i}") for i in range(4)])
    return COL.resolve_hierarchy(rows, "o_orderkey", [f"level{i}" for i in range(4)], ["o_orderkey"], parent="parent", level="level", drop_levels=True).select("o_orderkey", "parent", "level")


@query("SELECT doc_id, CAST(i AS INTEGER) AS i, w[i + 1] AS word FROM (SELECT doc_id, string_split(text, ' ') AS w, unnest(range(0, len(string_split(text, ' ')))) AS i FROM documents)")
def explode_rows(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("w"))
    return GEN.explode_rows(rows, F.transform("w", lambda x, i: F.struct(i.alias("i"), x.alias("word")))).select("doc_id", "i", "word")


_MEASURES = " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{c}' AS measure, {e} AS amount FROM lineitem" for c, e in (("l_quantity", "nullif(l_quantity, 10)"), ("l_tax", "l_tax"), ("l_discount", "l_discount")))


@query(f"SELECT * FROM ({_MEASURES}) WHERE amount IS NOT NULL")
def unpivot(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("l_quantity", F.nullif("l_quantity", F.lit(10.0)))
    return GEN.unpivot(rows, "measure", "amount", ["l_quantity", "l_tax", "l_discount"], ["l_orderkey", "l_linenumber"])


@query(_MEASURES)
def unpivot_keep_null(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.nullif("l_quantity", F.lit(10.0)).alias("l_quantity"), "l_tax", "l_discount")
    return GEN.unpivot(rows, "measure", "amount", fixed=["l_orderkey", "l_linenumber"])


@query("SELECT r_regionkey, r_name, tag FROM region CROSS JOIN (VALUES (NULL), ('a'), ('b')) AS v(tag)")
def tagged_versions(spark, sf):
    return GEN.tagged_versions(table(spark, sf, "region"), "a", "b", keep_original=True).withColumnRenamed(TAG, "tag")


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value"))).withColumn("n", F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 100 - 50).cast("int")))


_EVENTS = "(SELECT *, CASE WHEN event_id % 3 <> 0 THEN value END AS v, CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 100 - 50 AS INTEGER) END AS n FROM events)"


@query(
    f"""SELECT user_id, CAST(count(*) AS INTEGER) AS rows, CAST(nullif(count(v), 0) AS INTEGER) AS with_value, CAST(nullif(count(*) FILTER (v IS NULL), 0) AS INTEGER) AS without_value,
      CAST(nullif(count(DISTINCT event_type), 0) AS INTEGER) AS types, round(sum(coalesce(v, 0)), 4) AS total, round(avg(coalesce(v, 0)), 6) AS mean, round(avg(v), 6) AS mean_known,
      max(coalesce(v, 0)) AS high, min(coalesce(v, 0)) AS low, max(coalesce(n, 0)) AS n_high, min(coalesce(n, 0)) AS n_low, CAST(sum(coalesce(n, 0)) AS INTEGER) AS n_total,
      max(ts) AS last, min(ts) AS first, round(stddev_samp(v), 6) AS spread, round(stddev_pop(v), 6) AS spread_all
    FROM {_EVENTS} GROUP BY user_id"""
)
def aggregate_continuous(spark, sf):
    specs = [
        A.count("rows"), A.count_not_null("value", "with_value"), A.count_null("value", "without_value"), A.count_distinct("event_type", "types"),
        A.custom("total", F.round(A.total("value").column, 4)), A.custom("mean", F.round(A.average("value").column, 6)), A.custom("mean_known", F.round(A.average_ignoring_null("value").column, 6)),
        A.greatest("value", "high"), A.least("value", "low"), A.greatest("n", "n_high"), A.least("n", "n_low"), A.total("n", "n_total", "int"), A.latest("ts", "last"), A.earliest("ts", "first"),
        A.custom("spread", F.round(A.deviation("value").column, 6)), A.custom("spread_all", F.round(A.deviation("value", population=True).column, 6)),
    ]
    return A.aggregate(_events(spark, sf), ["user_id"], specs)


@query(
    """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS price, CAST(max(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS dearest,
      round(avg(l_discount), 6) AS discount, min(l_shipdate) AS first_ship FROM lineitem GROUP BY ALL"""
)
def aggregate_decimals(spark, sf):
    rows = table(spark, sf, "lineitem").withColumns({"q": F.col("l_quantity").cast("bigint"), "p": F.col("l_extendedprice").cast("decimal(18,2)")})
    specs = [A.total("q", "quantity", "long"), A.custom("price", A.total("p", kind="decimal(28,2)").column.cast("double")), A.custom("dearest", A.greatest("p").column.cast("double")), A.custom("discount", F.round(F.avg("l_discount"), 6)), A.earliest("l_shipdate", "first_ship")]
    return A.aggregate(rows, ["l_returnflag", "l_linestatus"], specs)


@query("SELECT round(sum(coalesce(o_totalprice, 0)), 2) AS total, CAST(count(*) AS INTEGER) AS n FROM orders HAVING count(*) > 0")
def aggregate_all(spark, sf):
    return A.aggregate(table(spark, sf, "orders"), [], [A.custom("total", F.round(A.total("o_totalprice").column, 2)), A.count("n")])


@query(
    """SELECT event_type, arg_min(user_id, (ts, event_id)) AS user_id, arg_min(props, (ts, event_id)) AS first_props, CAST(count(*) AS INTEGER) AS n FROM events GROUP BY event_type"""
)
def aggregate_fixed_columns(spark, sf):
    return A.aggregate(table(spark, sf, "events"), ["event_type"], [A.count("n")], {"user_id": "user_id", "first_props": "props"}, ["ts", "event_id"]).select("event_type", "user_id", "first_props", "n")


@query(
    """WITH s AS (SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS sx, sum(l_extendedprice) AS sy, sum(l_quantity * l_quantity) AS sxx, sum(l_quantity * l_extendedprice) AS sxy FROM lineitem GROUP BY 1)
    SELECT l_returnflag, round((n * sxy - sx * sy) / (n * sxx - sx * sx), 4) AS slope, round((sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n, 2) AS intercept, CAST(n AS INTEGER) AS n FROM s"""
)
def linear_regression(spark, sf):
    out = A.aggregate(table(spark, sf, "lineitem"), ["l_returnflag"], A.linear_regression("l_quantity", "l_extendedprice"))
    return out.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), "n")


_RUNS = """WITH c AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS changed FROM events WINDOW w AS ({0})),
  r AS (SELECT *, sum(changed) OVER ({0}) AS run FROM c)"""


@query(_RUNS.format("PARTITION BY user_id ORDER BY event_id") + " SELECT user_id, event_type, CAST(count(*) AS INTEGER) AS n, min(event_id) AS first FROM r GROUP BY user_id, run, event_type")
def aggregate_runs(spark, sf):
    return A.aggregate_runs(table(spark, sf, "events"), ["event_type"], ["event_id"], [A.count("n"), A.custom("first", F.min("event_id"))], ["user_id"])


@query(_RUNS.format("ORDER BY event_id") + " SELECT event_type, CAST(count(*) AS INTEGER) AS n, min(event_id) AS first FROM r GROUP BY run, event_type")
def aggregate_global_runs(spark, sf):
    return A.aggregate_runs(table(spark, sf, "events"), ["event_type"], ["event_id"], [A.count("n"), A.custom("first", F.min("event_id"))])


@query("SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def reduce_group_latest(spark, sf):
    return A.reduce_groups(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")])


@query(_RUNS.format("PARTITION BY user_id ORDER BY event_id") + " SELECT event_id, ts, user_id, event_type, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY value, event_id) AS rn FROM r) WHERE rn = 1")
def reduce_runs(spark, sf):
    return A.reduce_groups(table(spark, sf, "events"), ["event_type"], ["value", "event_id"], runs=["event_id"], partition_by=["user_id"])


@query("SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1")
def dedup_first(spark, sf):
    return A.remove_duplicates(table(spark, sf, "events"), ["user_id", "event_type"], ["event_id"])


@query("SELECT o_orderkey, o_custkey, c_name, c_acctbal AS balance FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, sf):
    return L.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "customer"), {"o_custkey": "c_custkey"}, {"c_name": "c_name", "balance": "c_acctbal"}, L.Action(L.REMOVE))


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN c_name ELSE o_orderpriority END AS o_orderpriority FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey")
def join_left_keep(spark, sf):
    left = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return L.join(left, table(spark, sf, "customer"), {"o_custkey": "c_custkey"}, {"o_orderpriority": "c_name"}, match_where=F.col("c_mktsegment") == "BUILDING").select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, coalesce(c_name, 'nobody') AS c_name, CASE WHEN c_name IS NOT NULL THEN c_acctbal * 2 END AS twice FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def join_no_match_default(spark, sf):
    left = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    out = L.join(left, table(spark, sf, "customer"), {"o_custkey": "c_custkey"}, ["c_name", "c_acctbal"], L.Action(set={"c_name": F.lit("nobody")}), F.col("c_acctbal") > 0, match_set={"twice": lambda r: r("c_acctbal") * 2})
    return out.select("o_orderkey", "c_name", "twice")


@query("SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) ON c_custkey = o_custkey WHERE rn <= 3")
def join_match_limit(spark, sf):
    return L.join(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders"), {"c_custkey": "o_custkey"}, ["o_orderkey"], L.Action(L.REMOVE), match_limit=3, match_order=["o_orderdate", "o_orderkey"])


@query(
    """SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE coalesce(n, 0) <= 1"""
)
def join_too_many(spark, sf):
    return L.join(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders"), {"c_custkey": "o_custkey"}, ["o_orderkey"], match_limit=1, match_order=["o_orderkey"], too_many=L.Action(L.REMOVE))


@query("SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def key_test_semi(spark, sf):
    return L.key_test(table(spark, sf, "customer"), table(spark, sf, "orders"), {"c_custkey": "o_custkey"}, no_match=L.Action(L.REMOVE))


@query("SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def key_test_anti(spark, sf):
    return L.key_test(table(spark, sf, "customer"), table(spark, sf, "orders"), {"c_custkey": "o_custkey"}, match=L.Action(L.REMOVE), match_where=F.col("o_totalprice") > 450000)


@query("SELECT c_custkey, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS first_order, c_custkey IN (SELECT o_custkey FROM orders) AS buys FROM customer")
def key_test_custom(spark, sf):
    match = L.Action(set={"buys": F.lit(True), "first_order": F.col("__r_o_orderkey")})
    out = L.key_test(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders"), {"c_custkey": "o_custkey"}, match, L.Action(set={"buys": F.lit(False)}), first_by=["o_orderkey"], columns=["o_orderkey"])
    return out.select("c_custkey", "first_order", "buys")


_CHANGED = "(SELECT p_partkey, CASE WHEN p_partkey % 10 = 3 THEN 'new' ELSE p_name END AS p_name, p_brand, p_type, CASE WHEN p_partkey % 11 = 4 THEN NULL ELSE p_size END AS p_size, p_retailprice FROM part WHERE p_partkey % 13 <> 5)"


def _changed_parts(spark, sf):
    key = F.col("p_partkey")
    return table(spark, sf, "part").where(key % 13 != 5).withColumns({"p_name": F.when(key % 10 == 3, "new").otherwise(F.col("p_name")), "p_size": F.when(key % 11 == 4, None).otherwise(F.col("p_size"))})


@query(
    f"""SELECT a.p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'no_match' WHEN a.p_name IS NOT DISTINCT FROM b.p_name AND a.p_size IS NOT DISTINCT FROM b.p_size THEN 'same' ELSE 'different' END AS status,
    CASE WHEN b.p_partkey IS NOT NULL AND NOT (a.p_name IS NOT DISTINCT FROM b.p_name AND a.p_size IS NOT DISTINCT FROM b.p_size) THEN b.p_name ELSE a.p_name END AS p_name FROM part a LEFT JOIN {_CHANGED} b USING (p_partkey)"""
)
def compare_rows(spark, sf):
    left, right = table(spark, sf, "part"), _changed_parts(spark, sf)
    out = L.compare_rows(left, right, ["p_partkey"], L.equal_all_columns(left, right), ["p_name"], different=L.Action(set={"p_name": F.col("__r_p_name")}), status="status")
    return out.select("p_partkey", "status", "p_name")


@query(f"SELECT a.p_partkey FROM part a LEFT JOIN {_CHANGED} b USING (p_partkey) WHERE b.p_partkey IS NULL OR a.p_name IS DISTINCT FROM b.p_name")
def compare_rows_changes(spark, sf):
    return L.compare_rows(table(spark, sf, "part"), _changed_parts(spark, sf), ["p_partkey"], L.equal_columns(["p_name", "p_brand"]), ["p_name"], same=L.Action(L.REMOVE)).select("p_partkey")


@query("SELECT o_orderkey, o_custkey, p_partkey FROM (SELECT o_orderkey, o_custkey, p_partkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY p_retailprice DESC NULLS LAST, p_partkey DESC) AS rn FROM (SELECT *, o_orderkey % 50 + 1 AS size FROM orders) LEFT JOIN part ON p_size = size AND p_retailprice * 100 <= o_totalprice) WHERE rn = 1")
def expand_from_lookup(spark, sf):
    left = table(spark, sf, "orders").withColumn("size", (F.col("o_orderkey") % 50 + 1).cast("int"))
    out = L.as_of(left, table(spark, sf, "part"), {"size": "p_size"}, "o_totalprice", F.col("p_retailprice") * 100, {"p_partkey": "p_partkey"}, ties=["p_partkey"])
    return out.select("o_orderkey", "o_custkey", "p_partkey")


@query("SELECT n_nationkey, s_suppkey FROM (SELECT n_nationkey, s_suppkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_acctbal DESC NULLS LAST, s_suppkey DESC) AS rn FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND length(s_name) + n_nationkey > s_suppkey % 7 + 20) WHERE rn = 1")
def expand_by_condition(spark, sf):
    condition = F.length("__r_s_name") + F.col("n_nationkey") > F.col("__r_s_suppkey") % 7 + 20
    return L.expand(table(spark, sf, "nation"), table(spark, sf, "supplier"), {"n_nationkey": "s_nationkey"}, ["s_suppkey"], ["n_nationkey"], condition, F.struct("__r_s_acctbal", "__r_s_suppkey")).select("n_nationkey", "s_suppkey")


@query(
    """SELECT o_orderkey, p_partkey, p_name FROM (SELECT o_orderkey, p_partkey, p_name, row_number() OVER (PARTITION BY o_orderkey ORDER BY p_name DESC NULLS LAST, p_partkey DESC) AS rn
    FROM (SELECT *, o_orderkey % 3 + 1 AS band FROM orders) LEFT JOIN part ON p_size % 3 + 1 = band AND p_retailprice * 100 BETWEEN o_totalprice * 0.5 AND o_totalprice * 1.5) WHERE rn = 1"""
)
def expand_in_range(spark, sf):
    """The last part, by name, of an order's band among those of half to one and a half times its price."""
    left = table(spark, sf, "orders").withColumn("band", (F.col("o_orderkey") % 3 + 1).cast("int"))
    right = table(spark, sf, "part").withColumn("band", (F.col("p_size") % 3 + 1).cast("int"))
    between = (F.col("__r_p_retailprice") * 100, F.col("o_totalprice") * 0.5, F.col("o_totalprice") * 1.5)
    out = L.expand(left, right, ["band"], ["p_partkey", "p_name"], ["o_orderkey"], best=F.struct("__r_p_name", "__r_p_partkey"), between=between)
    return out.select("o_orderkey", "p_partkey", "p_name")


@query("SELECT e.event_id, p.event_id AS purchase FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def as_of_lookup(spark, sf):
    events = table(spark, sf, "events")
    return L.as_of(events.select("event_id", "user_id", "ts"), events.where("event_type = 'purchase'"), ["user_id"], "ts", "ts", {"purchase": "event_id"}).select("event_id", "purchase")


@query("SELECT o_custkey, count(*) AS count FROM orders GROUP BY 1")
def lookup_counts(spark, sf):
    return L.count_by_key(table(spark, sf, "orders"), ["o_custkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sort_topk(spark, sf):
    return S.sort(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), "o_orderkey", limit=25)


@query("SELECT 0 AS input, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 1, s_name, s_acctbal, NULL FROM supplier")
def sequential_merge(spark, sf):
    customers = COL.rename_columns(table(spark, sf, "customer").select("c_name", "c_acctbal", "c_mktsegment"), {"c_name": "name", "c_acctbal": "balance", "c_mktsegment": "segment"})
    suppliers = COL.rename_columns(table(spark, sf, "supplier").select("s_name", "s_acctbal"), {"s_name": "name", "s_acctbal": "balance"})
    return S.merge_in_order(customers, suppliers, ordinal="input")


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS doubled FROM lineitem")
def split_merge(spark, sf):
    return S.process_in_parallel(table(spark, sf, "lineitem"), 6, lambda df: df.select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("doubled")))


@query("SELECT max(o_totalprice) AS max_value, count(*) AS record_count FROM orders WHERE o_orderstatus = 'O'")
def table_max_and_count(spark, sf):
    return A.max_value(table(spark, sf, "orders"), "o_totalprice", F.col("o_orderstatus") == "O")


_NEW = "(SELECT c_custkey + CASE WHEN c_custkey % 10 = 0 THEN 1000000 ELSE 0 END AS c_custkey, c_name || '!' AS c_name, -c_acctbal AS c_acctbal FROM customer WHERE c_custkey % 5 = 0)"


def _new_customers(spark, sf):
    key = F.col("c_custkey")
    return table(spark, sf, "customer").where(key % 5 == 0).select((key + F.when(key % 10 == 0, 1000000).otherwise(0)).alias("c_custkey"), F.concat("c_name", F.lit("!")).alias("c_name"), (-F.col("c_acctbal")).alias("c_acctbal"))


@query(
    """WITH s AS (SELECT c_custkey + CASE WHEN c_custkey % 8 = 0 THEN 1000000 ELSE 0 END AS c_custkey, c_name || '?' AS c_name, c_acctbal * 2 AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 4 = 0 AND c_custkey < 0.8 * (SELECT max(c_custkey) FROM customer))
    SELECT t.c_custkey, CASE WHEN s.c_custkey IS NOT NULL AND t.c_acctbal < 5000 THEN s.c_name WHEN s.c_custkey IS NULL AND t.c_acctbal > 9000 THEN 'gone?' ELSE t.c_name END AS c_name,
      CASE WHEN s.c_custkey IS NOT NULL AND t.c_acctbal < 5000 THEN t.c_acctbal + s.c_acctbal ELSE t.c_acctbal END AS c_acctbal, t.c_mktsegment
    FROM customer t LEFT JOIN s ON s.c_custkey = t.c_custkey
    WHERE NOT (s.c_custkey IS NOT NULL AND t.c_acctbal < 0) AND NOT (s.c_custkey IS NULL AND t.c_acctbal < -500)
    UNION ALL SELECT c_custkey, c_name, 0, c_mktsegment FROM s WHERE c_custkey NOT IN (SELECT c_custkey FROM customer) AND c_mktsegment = 'BUILDING'
    UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM s WHERE c_custkey NOT IN (SELECT c_custkey FROM customer) AND c_mktsegment <> 'BUILDING' AND c_acctbal > 0"""
)
def merge_clauses(spark, sf):
    """A partitioned table after a merge of six conditional clauses; the result is written before it goes."""
    jobs, name = T.Tables(spark), f"merged_{uuid.uuid4().hex[:12]}"
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    key, most = F.col("c_custkey"), rows.agg(F.max("c_custkey")).first()[0]
    source = rows.where((key % 4 == 0) & (key < 0.8 * most)).select((key + F.when(key % 8 == 0, 1000000).otherwise(0)).alias("c_custkey"), F.concat("c_name", F.lit("?")).alias("c_name"), (F.col("c_acctbal") * 2).alias("c_acctbal"), "c_mktsegment")
    balance = F.col("t.c_acctbal")
    clauses = [
        M.Clause("matched", "delete", balance < 0),
        M.Clause("matched", "update", balance < 5000, {"c_name": F.col("s.c_name"), "c_acctbal": balance + F.col("s.c_acctbal")}),
        M.Clause("missing_in_source", "delete", balance < -500),
        M.Clause("missing_in_source", "update", balance > 9000, {"c_name": F.lit("gone?")}),
        M.Clause("missing_in_target", "insert", F.col("s.c_mktsegment") == "BUILDING", {"c_custkey": F.col("s.c_custkey"), "c_name": F.col("s.c_name"), "c_acctbal": F.lit(0), "c_mktsegment": F.col("s.c_mktsegment")}),
        M.Clause("missing_in_target", "insert", F.col("s.c_acctbal") > 0),
    ]
    try:
        rows.write.partitionBy("c_mktsegment").saveAsTable(name)
        jobs.merge_into(name, source, ["c_custkey"], clauses)
        path = work_path(spark, "merged")
        sinks.write_table_files(spark.table(name), path)
    finally:
        jobs.drop(name)
    return spark.read.parquet(path)


@query(
    f"""SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NOT NULL THEN b.c_name ELSE a.c_name END AS c_name, CASE WHEN b.c_custkey IS NOT NULL THEN b.c_acctbal ELSE a.c_acctbal END AS c_acctbal, a.c_mktsegment
    FROM customer a FULL JOIN {_NEW} b ON a.c_custkey = b.c_custkey"""
)
def upsert_merge(spark, sf):
    return T.merged(table(spark, sf, "customer").drop("c_nationkey"), _new_customers(spark, sf), ["c_custkey"])


@query(f"SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NOT NULL THEN a.c_name ELSE b.c_name END AS c_name FROM customer a FULL JOIN {_NEW} b ON a.c_custkey = b.c_custkey")
def merge_insert_only(spark, sf):
    return T.merged(table(spark, sf, "customer").select("c_custkey", "c_name"), _new_customers(spark, sf), ["c_custkey"], "insert_only")


@query(f"SELECT a.c_custkey, coalesce(b.c_name, a.c_name) AS c_name FROM customer a LEFT JOIN {_NEW} b ON a.c_custkey = b.c_custkey")
def merge_update_only(spark, sf):
    return T.merged(table(spark, sf, "customer").select("c_custkey", "c_name"), _new_customers(spark, sf), ["c_custkey"], "update_only")


@query("SELECT p_partkey, p_name, CASE WHEN p_size > 40 THEN NULL WHEN p_size > 30 THEN '' ELSE p_type END AS p_type, p_size, p_retailprice FROM part")
def delimited_roundtrip(spark, sf):
    path = work_path(spark, "delimited")
    kind = F.when(F.col("p_size") > 40, None).when(F.col("p_size") > 30, "").otherwise(F.col("p_type"))
    sinks.write_delimited(table(spark, sf, "part").select("p_partkey", "p_name", kind.alias("p_type"), "p_size", "p_retailprice"), path)
    columns = [D.ReadColumn("p_partkey", C.to_whole, options={"kind": "long"}), D.ReadColumn("p_name"), D.ReadColumn("p_type"), D.ReadColumn("p_size", C.to_whole, options={"kind": "int"}), D.ReadColumn("p_retailprice", C.to_real)]
    return D.read_delimited(spark, path, columns).drop(ERRORS)


@query("SELECT p_partkey, replace(p_name, ' ', chr(13) || chr(10)) AS p_name, CASE WHEN p_partkey % 3 < 2 THEN p_type END AS p_type, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS p_size FROM part")
def delimited_own_headers(spark, sf):
    """Files of three column orders, with line breaks and quotes in their cells, read as one."""
    parts, paths = table(spark, sf, "part").withColumn("p_name", F.replace("p_name", F.lit(" "), F.lit("\n"))), []
    for i, columns in enumerate((["p_partkey", "p_name", "p_type"], ["p_type", "p_size", "p_partkey", "p_name"], ["p_name", "p_size", "p_partkey"])):
        paths.append(work_path(spark, "delimited"))
        sinks.write_delimited(parts.where(F.col("p_partkey") % 3 == i).select(*columns), paths[-1])
    columns = [D.ReadColumn("p_partkey", C.to_whole, options={"kind": "long"}), D.ReadColumn("p_name"), D.ReadColumn("p_type"), D.ReadColumn("p_size", C.to_whole, options={"kind": "int"})]
    return D.read_delimited(spark, paths, columns).drop(ERRORS)


@query("SELECT * FROM supplier")
def binary_roundtrip(spark, sf):
    path = work_path(spark, "binary")
    sinks.write_table_files(table(spark, sf, "supplier"), path)
    return spark.read.parquet(path)


@query("SELECT n_nationkey AS k, n_name AS name FROM nation")
def json_roundtrip(spark, sf):
    path = work_path(spark, "json")
    sinks.write_json(table(spark, sf, "nation"), path)
    rows = spark.read.schema("n_nationkey int, n_name string").json(path)
    return rows.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark, sf):
    return J.parse_json(table(spark, sf, "events").select("event_id", "props"), "props", "k int", "p").select("event_id", "p.k")


@query("SELECT doc_id, replace(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', ''), 'e', 'E') AS text FROM documents")
def trim_replace(spark, sf):
    return COL.replace_text(COL.trim(table(spark, sf, "documents").select("doc_id", "text"), "text"), "e", "E", "text")


@query("SELECT doc_id, regexp_replace(text, 'the', 'THE', 'gi') AS text FROM documents")
def replace_ignoring_case(spark, sf):
    return COL.replace_text(table(spark, sf, "documents").select("doc_id", "text"), "the", "THE", "text", ignore_case=True)


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderdate AS at, o_totalprice > 100000 AS large FROM orders")
def convert_dates_and_flags(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy.MM.dd").alias("day"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("at"), F.when(F.col("o_totalprice") > 100000, " Yes").otherwise("no").alias("large"))
    rows = COL.convert(rows, ["day"], C.to_date, invalid="fail", locale="hu")
    rows = COL.convert(rows, ["at"], C.to_timestamp, invalid="fail")
    return COL.convert(rows, ["large"], C.to_bool_words, invalid="fail")


@query("SELECT c_custkey FROM customer")
def unique_key(spark, sf):
    return FIL.fail_on_duplicate_key(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"])


@query("SELECT event_type, user_id, min(event_id) >= 0 AS seen FROM events GROUP BY 1, 2")
def streaming_dedup(spark, sf):
    stream = streams.listen_files(spark, f"{sf}/event[s].parquet", table(spark, sf, "events").schema)
    rows = streams.remove_duplicates(stream, ["event_type", "user_id"]).select("event_type", "user_id", (F.col("event_id") >= 0).alias("seen"))
    return streams.collect_available(rows, "append", work_path(spark, "stream"), work_path(spark, "stream-state"))


@query("SELECT event_type, CAST(count(*) AS INTEGER) AS n, round(sum(coalesce(value, 0)), 4) AS total FROM events GROUP BY 1")
def streaming_agg(spark, sf):
    stream = streams.listen_files(spark, f"{sf}/event[s].parquet", table(spark, sf, "events").schema)
    rows = streams.aggregate(stream, ["event_type"], [A.count("n"), A.custom("total", F.round(A.total("value").column, 4))])
    return streams.collect_available(rows, "complete", work_path(spark, "stream"), work_path(spark, "stream-state"))


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 'large' ELSE p_brand || '-' || p_type END AS label FROM part WHERE p_size >= 10")
def fluent_sequence(spark, sf):
    """Several operators chained, with a conditional block."""
    return (
        Seq(table(spark, sf, "part"))
        .remove_rows(F.col("p_size") < 10)
        .merge_text_columns(["p_brand", "p_type"], "label", "-", drop_source=True)
        .when(F.col("p_size") > 40, lambda rows: rows.then(lambda df: df.withColumn("label", F.lit("large"))))
        .keep_columns("p_partkey", "label")
        .result()
    )


@query(
    """WITH e AS (SELECT event_id, ts, CAST(round(coalesce(value, 0) * 100) AS BIGINT) AS cents FROM events),
    r AS (SELECT event_id, ts, cents, CAST(sum(cents) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM e),
    k AS (SELECT event_id, total, unnest(generate_series((total - cents) // 500000 + 1, total // 500000)) AS mark FROM r)
    SELECT event_id, mark, total, count(*) OVER (ORDER BY mark ROWS UNBOUNDED PRECEDING) AS nth FROM k"""
)
def explode_whole(spark, sf):
    """A row for each full 5000 that the values of all events, in time, have come to; one event may complete several."""
    rows = table(spark, sf, "events").select("event_id", "ts", F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("long").alias("cents"))

    def made(before, frames):
        for frame in frames:
            totals = before + frame["cents"].cumsum()
            first, last = (totals - frame["cents"]) // 500_000, totals // 500_000
            out = frame.loc[last > first, ["event_id"]].assign(mark=[list(range(a + 1, b + 1)) for a, b in zip(first, last) if b > a], total=totals[last > first])
            out = out.explode("mark").astype({"mark": "int64"})
            yield out.assign(nth=out["mark"])
            before = int(totals.iloc[-1])

    scan = GEN.Scan(0, lambda frames: sum(int(f["cents"].sum()) for f in frames), lambda a, b: a + b, made)
    return GEN.explode_whole(rows, ["ts", "event_id"], scan, "event_id long, mark long, total long, nth long")


@query("SELECT event_id, ts, user_id, event_type, value FROM events")
def push_source(spark, sf):
    """All events through a push source, in two runs: the second goes on from the first one's checkpoint."""
    spool, out, state = (work_path(spark, x) for x in ("spool", "pushed", "state"))
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    for odd in (0, 1):
        push.push_table(events.where(F.col("event_id") % 2 == odd), spool, 4)
        stream = push.without_heartbeats(push.listen(spark, spool, events.schema, max_segments=3))
        for _ in range(2):
            streams.collect_available(stream, "append", out, state)
    return spark.read.schema(events.schema).parquet(out)


def in_slices(spark, sf, arrival, slices=4):
    """The events in slices by arrival, each to be written before a stream goes on, and where to."""
    events = table(spark, sf, "events").withColumn("__arrival", arrival.cast("double"))
    low, high = events.agg(F.min("__arrival"), F.max("__arrival")).first()
    number = F.least(F.floor((F.col("__arrival") - low) / (high - low) * slices), F.lit(slices - 1))
    path = work_path(spark, "arrived")
    for i in range(slices):
        events.where(number == i).drop("__arrival").write.mode("append").parquet(path)
        yield streams.listen_files(spark, path, events.drop("__arrival").schema)


@query(
    """WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, coalesce(value, 0) AS v FROM events),
    m AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) < 43200000 THEN 0 ELSE 1 END AS s FROM e),
    r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS g FROM m)
    SELECT user_id, min(ms) AS start_ms, max(ms) AS last_ms, count(*) AS rows, round(sum(v), 2) AS total FROM r GROUP BY user_id, g HAVING max(ms) + 43200000 <= (SELECT max(ms) FROM e) - 7200000"""
)
def streaming_sessions(spark, sf):
    """Users' sessions that are over, by state with timers; events come up to two hours late, in four runs of one stream."""
    out, checkpoint = work_path(spark, "sessions"), work_path(spark, "state")
    late = F.pmod(F.hash("event_id"), F.lit(7000))
    for stream in in_slices(spark, sf, F.unix_seconds(F.col("ts").cast("timestamp")) + late):
        rows = state.collect_available(state.sessions(stream, ["user_id"], "ts", 43_200_000, "value", "2 hours"), out, checkpoint)
    return rows.withColumn("total", F.round("total", 2))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events")
def streaming_numbers(spark, sf):
    """Each user's events numbered by state, over four runs of one stream."""
    out, checkpoint = work_path(spark, "numbers"), work_path(spark, "state")
    for stream in in_slices(spark, sf, F.col("event_id")):
        rows = state.collect_available(state.numbered(stream.select("event_id", "user_id"), ["user_id"], "n", "event_id"), out, checkpoint)
    return rows


@query(
    """SELECT count(*) AS orders, count(*) FILTER (WHERE o_totalprice > 100000) AS dear, CAST(sum(round(o_totalprice * 100)) AS BIGINT) AS cents, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS last FROM orders WHERE o_orderstatus = 'O'"""
)
def observed_write(spark, sf):
    """Counters and the last value of a written table, taken while it is written."""
    path = work_path(spark, "observed")
    orders = table(spark, sf, "orders").where("o_orderstatus = 'O'")
    counters = {"orders": F.count(F.lit(1)), "dear": F.count_if(F.col("o_totalprice") > 100_000), "cents": F.sum(F.round(F.col("o_totalprice") * 100).cast("long")), "last": last_value("o_orderkey", ["o_totalprice", "o_orderkey"])}
    values = Flow().write_observed(lambda: orders, lambda df: sinks.write_table_files(df, path), counters).raise_failures().values
    # the counters go beside the rows they count, and both are read back
    marks = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("orders"))
    return marks.select("orders", *[F.lit(values[n]).cast("long").alias(n) for n in ("dear", "cents", "last")])


@query(
    """SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT c_custkey, c_name, c_acctbal * 2 FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 = 0"""
)
def database_load(spark, sf):
    """Customers loaded into a database table, then merged with others, batch by batch.

    The database lies in files of the shared folder, as there is no server; with a server's URL the same calls go by JDBC."""
    db = Shards(spark, work_path(spark, "database"), by={"customers": ["c_custkey"]})
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    key = F.col("c_custkey")
    database.load(db, rows.where(key % 2 == 0), "customers", "first", batch_rows=4000)
    database.load(db, rows.where(key % 3 == 0).withColumn("c_acctbal", F.col("c_acctbal") * 2), "customers", "second", ["c_custkey"], batch_rows=4000)
    return db.read("customers")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price, CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS VARCHAR) END AS customer, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS urgency FROM orders"""
)
def partitions_of_own_columns(spark, sf):
    """Orders written with other columns for each status, and all files read again as one table."""
    path = work_path(spark, "own_columns")
    layouts = {"F": {"price": "o_totalprice", "o_orderkey": "o_orderkey", "customer": "o_custkey"}, "P": {"urgency": "o_orderpriority", "o_orderkey": "o_orderkey"}}
    write_dynamic(table(spark, sf, "orders"), path, F.col("o_orderstatus"), layouts, {"o_orderkey": "o_orderkey", "price": "o_totalprice"})
    columns = [D.ReadColumn("o_orderkey", C.to_whole, options={"kind": "long"}), D.ReadColumn("price", C.to_real), D.ReadColumn("customer"), D.ReadColumn("urgency")]
    return D.read_delimited(spark, f"{path}/*", columns).drop(ERRORS)
