"""Queries over the driver's tables, at least one for each operator and function, with the SQL of each."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.aggregates import avg, composed, count, count_distinct, exact_avg, exact_sum, max_, min_, sum_
from lamina.functions.predicates import all_of, any_of, at, contains, eq, ge, gt, le, lt, ne, not_
from lamina.functions.scalars import byte_len, format_date, format_timestamp, minute_of, parse_date, parse_timestamp, plus, text, trunc_minute, url_host
from lamina.operators import aggregate, first_seen, group_by, order, page, project, top_k, where
from lamina.schema import bind, schema
from lamina.session import scratch
from lamina.sources import describe, export_csv, ingest, read_csv, read_table, tables, write_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, table: str, build: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(tables(spark, sf_dir, table))
    ORACLE[name] = sql


def _multi(t: DataFrame) -> DataFrame:
    return group_by(t, {"k": "l_suppkey"}, s=sum_("l_linenumber"), c=count(), a=avg("l_linenumber"), u=count_distinct("l_partkey"))


def _after_groups(t: DataFrame) -> DataFrame:
    groups = group_by(t, ["event_type"], c=count(), u=count_distinct("user_id"))
    return order(where(groups, gt(at(1, groups.columns), 1)), "event_type")


def _ranked(t: DataFrame) -> DataFrame:
    """With the place of each of its few rows, as they come."""
    return t.coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1)


def _stored(t: DataFrame, **options) -> DataFrame:
    """What a table holds that has been written and is read again."""
    path = scratch(t.sparkSession)
    write_table(t, path, **options)
    return read_table(t.sparkSession, path)


def _as_csv(t: DataFrame) -> str:
    path = scratch(t.sparkSession)
    export_csv(t, path)
    return path


def _from_csv(t: DataFrame, multi_line: bool = False) -> DataFrame:
    """What a table holds that has gone out as CSV and come in with its own types."""
    return read_csv(t.sparkSession, _as_csv(t), bind(t.columns, [k for _, k in describe(t)]), multi_line=multi_line)


def _ingested(t: DataFrame) -> DataFrame:
    """The table that an ingest from CSV makes, with what it reports."""
    path = scratch(t.sparkSession)
    done = ingest(t.sparkSession, _as_csv(t), path, schema(describe(t)), cluster=["o_orderdate"])
    return read_table(t.sparkSession, path).select("o_orderkey", "o_orderdate", F.lit(done.rows).alias("n"), F.lit(done.files > 0 and done.bytes_written > 0 and done.bytes_read > done.rows and done.rate > 0).alias("told"))


def _described(t: DataFrame) -> DataFrame:
    return t.sparkSession.createDataFrame(describe(t), "name string, kind string")


def _dearest(t: DataFrame, key: str, cost: str) -> DataFrame:
    """An operator of a user's own, for :meth:`DataFrame.transform`: the largest ``cost`` of each ``key``."""
    return t.groupBy(key).agg(F.max(cost).alias(cost))


#: Types of DuckDB by the names that :func:`lamina.sources.describe` gives.
KINDS = "CASE column_type WHEN 'BIGINT' THEN 'Int64' WHEN 'INTEGER' THEN 'Int32' WHEN 'SMALLINT' THEN 'Int16' WHEN 'DOUBLE' THEN 'Double' WHEN 'VARCHAR' THEN 'String' WHEN 'DATE' THEN 'Date' WHEN 'FLOAT[]' THEN 'array<float>' ELSE 'Timestamp' END"

DAY = (dt.datetime(1998, 7, 1), dt.datetime(1998, 7, 31))

_add("scan_all", "nation", lambda t: t, "SELECT * FROM nation")
_add("scan_some", "orders", lambda t: project(t, "o_orderkey", "o_orderdate", "o_totalprice"), "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders")
_add("count_all", "events", lambda t: aggregate(t, c=count()), "SELECT count(*) AS c FROM events")
_add("filter_eq", "events", lambda t: project(where(t, eq("user_id", 8)), "user_id"), "SELECT user_id FROM events WHERE user_id = 8")
_add("filter_ne_count", "lineitem", lambda t: aggregate(where(t, ne("l_linenumber", 1)), c=count()), "SELECT count(*) AS c FROM lineitem WHERE l_linenumber <> 1")
_add("filter_lt", "orders", lambda t: project(where(t, lt("o_totalprice", 2000.0)), "o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_totalprice < 2000.0")
_add("filter_le", "part", lambda t: project(where(t, le("p_size", 3)), "p_partkey"), "SELECT p_partkey FROM part WHERE p_size <= 3")
_add("filter_gt", "customer", lambda t: project(where(t, gt("c_acctbal", 9000.0)), "c_custkey"), "SELECT c_custkey FROM customer WHERE c_acctbal > 9000.0")
_add("filter_ge_text", "nation", lambda t: project(where(t, ge("n_name", "M")), "n_name"), "SELECT n_name FROM nation WHERE n_name >= 'M'")
_add("filter_not", "orders", lambda t: aggregate(where(t, not_(eq("o_orderstatus", "F"))), c=count()), "SELECT count(*) AS c FROM orders WHERE NOT o_orderstatus = 'F'")
_add("filter_or", "orders", lambda t: aggregate(where(t, any_of(eq("o_orderstatus", "P"), eq("o_orderstatus", "F"))), c=count()), "SELECT count(*) AS c FROM orders WHERE o_orderstatus = 'P' OR o_orderstatus = 'F'")
_add("filter_contains_number", "orders", lambda t: project(where(t, contains("o_orderkey", "99")), "o_orderkey"), "SELECT o_orderkey FROM orders WHERE contains(CAST(o_orderkey AS VARCHAR), '99')")
_add("filter_contains_literal", "documents", lambda t: aggregate(where(t, contains("text", "%%%")), c=count()), "SELECT count(*) AS c FROM documents WHERE contains(text, '%%%')")
_add("filter_contains_double", "customer", lambda t: project(where(t, contains(text("c_acctbal", double=True), "5.10")), "c_custkey"), "SELECT c_custkey FROM customer WHERE contains(printf('%.6f', c_acctbal), '5.10')")
_add("like_count", "pages", lambda t: aggregate(where(t, contains("url", "/en/")), c=count()), "SELECT count(*) AS c FROM pages WHERE contains(url, '/en/')")
_add("like_text_count", "documents", lambda t: aggregate(where(t, contains("text", "Licensed under")), c=count()), "SELECT count(*) AS c FROM documents WHERE contains(text, 'Licensed under')")
_add("like_and_min", "documents", lambda t: top_k(group_by(where(t, all_of(contains("text", "the"), ne("source", ""))), ["lang"], t=min_("text"), c=count()), 10, "c", then=("lang",)), "SELECT lang, min(text) AS t, count(*) AS c FROM documents WHERE contains(text, 'the') AND source <> '' GROUP BY 1 ORDER BY c DESC, lang LIMIT 10")
_add("notlike_multi", "events", lambda t: top_k(group_by(where(t, all_of(contains("props", "k"), not_(contains("props", "69")), ne("event_type", ""))), ["event_type"], p=min_("props"), c=count(), u=count_distinct("user_id")), 10, "c", then=("event_type",)), "SELECT event_type, min(props) AS p, count(*) AS c, count(DISTINCT user_id) AS u FROM events WHERE contains(props, 'k') AND NOT contains(props, '69') AND event_type <> '' GROUP BY 1 ORDER BY c DESC, 1 LIMIT 10")
_add("global_sum_count_avg", "lineitem", lambda t: aggregate(t, s=sum_("l_linenumber"), c=count(), a=avg("l_linenumber")), "SELECT CAST(sum(l_linenumber) AS BIGINT) AS s, count(*) AS c, avg(l_linenumber) AS a FROM lineitem")
_add("avg_bigint", "events", lambda t: aggregate(t, a=exact_avg("user_id")), "SELECT avg(user_id) AS a FROM events")
_add("cd_int", "events", lambda t: aggregate(t, c=count_distinct("user_id")), "SELECT count(DISTINCT user_id) AS c FROM events")
_add("cd_str", "pages", lambda t: aggregate(t, c=count_distinct("url")), "SELECT count(DISTINCT url) AS c FROM pages")
_add("cd_timestamp", "events", lambda t: aggregate(t, c=count_distinct("ts")), "SELECT count(DISTINCT ts) AS c FROM events")
_add("cd_double", "lineitem", lambda t: aggregate(t, c=count_distinct("l_discount")), "SELECT count(DISTINCT l_discount) AS c FROM lineitem")
_add("cd_date", "lineitem", lambda t: aggregate(t, c=count_distinct(F.col("l_shipdate").cast("date"))), "SELECT count(DISTINCT CAST(l_shipdate AS DATE)) AS c FROM lineitem")
_add("minmax_time", "lineitem", lambda t: aggregate(t, mn=min_("l_shipdate"), mx=max_("l_shipdate")), "SELECT min(l_shipdate) AS mn, max(l_shipdate) AS mx FROM lineitem")
_add("minmax_date", "orders", lambda t: aggregate(t, mn=min_(F.col("o_orderdate").cast("date")), mx=max_(F.col("o_orderdate").cast("date"))), "SELECT min(CAST(o_orderdate AS DATE)) AS mn, max(CAST(o_orderdate AS DATE)) AS mx FROM orders")
_add("minmax_text_double", "customer", lambda t: aggregate(t, a=min_("c_name"), b=max_("c_name"), d=min_("c_acctbal"), e=max_("c_acctbal")), "SELECT min(c_name) AS a, max(c_name) AS b, min(c_acctbal) AS d, max(c_acctbal) AS e FROM customer")
_add("empty_aggregate", "events", lambda t: aggregate(where(t, lt("event_id", -1)), c=count(), s=sum_("user_id"), a=avg("value"), mn=min_("ts")), "SELECT count(*) AS c, CAST(sum(user_id) AS BIGINT) AS s, avg(value) AS a, min(ts) AS mn FROM events WHERE event_id < -1")
_add("empty_groups", "events", lambda t: group_by(where(t, lt("event_id", -1)), ["event_type"], c=count()), "SELECT event_type, count(*) AS c FROM events WHERE event_id < -1 GROUP BY 1")
_add("group_count_sort", "lineitem", lambda t: order(group_by(where(t, ne("l_linenumber", 1)), {"k": "l_linenumber"}, c=count()), "c", desc=True, then=("k",)), "SELECT l_linenumber AS k, count(*) AS c FROM lineitem WHERE l_linenumber <> 1 GROUP BY 1 ORDER BY c DESC, k")
_add("group_cd_topk", "lineitem", lambda t: top_k(group_by(t, {"k": "l_suppkey"}, u=count_distinct("l_partkey")), 10, "u", then=("k",)), "SELECT l_suppkey AS k, count(DISTINCT l_partkey) AS u FROM lineitem GROUP BY 1 ORDER BY u DESC, k LIMIT 10")
_add("group_multi_topk", "lineitem", lambda t: top_k(_multi(t), 10, "c", then=("k",)), "SELECT l_suppkey AS k, CAST(sum(l_linenumber) AS BIGINT) AS s, count(*) AS c, avg(l_linenumber) AS a, count(DISTINCT l_partkey) AS u FROM lineitem GROUP BY 1 ORDER BY c DESC, k LIMIT 10")
_add("group_2key_ne_empty", "lineitem", lambda t: top_k(group_by(where(t, ne("l_returnflag", "")), {"a": "l_returnflag", "b": "l_linestatus"}, u=count_distinct("l_orderkey")), 10, "u", then=("a", "b")), "SELECT l_returnflag AS a, l_linestatus AS b, count(DISTINCT l_orderkey) AS u FROM lineitem WHERE l_returnflag <> '' GROUP BY 1, 2 ORDER BY u DESC, a, b LIMIT 10")
_add("group_minute", "events", lambda t: top_k(group_by(t, {"user_id": "user_id", "m": minute_of("ts"), "event_type": "event_type"}, c=count()), 10, "c", then=("user_id", "m", "event_type")), "SELECT user_id, CAST(extract(minute FROM ts) AS BIGINT) AS m, event_type, count(*) AS c FROM events GROUP BY 1, 2, 3 ORDER BY c DESC, user_id, m, event_type LIMIT 10")
_add("having_ordinal", "events", _after_groups, "SELECT event_type, count(*) AS c, count(DISTINCT user_id) AS u FROM events GROUP BY 1 HAVING count(*) > 1 ORDER BY 1")
_add("avg_len_having", "documents", lambda t: top_k(where(group_by(where(t, ne("text", "")), ["lang"], l=avg(byte_len("text")), c=count()), gt("c", 10)), 25, "l", then=("lang",)), "SELECT lang, avg(strlen(text)) AS l, count(*) AS c FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) > 10 ORDER BY l DESC, lang LIMIT 25")
_add("host_group", "pages", lambda t: top_k(where(group_by(where(t, ne("url", "")), {"h": url_host("url")}, l=avg(byte_len("url")), c=count(), m=min_("url")), gt("c", 1)), 25, "l", then=("h",)), r"SELECT regexp_extract(url, '^(?:https?://)?(?:www\.)?([^/]*)', 1) AS h, avg(strlen(url)) AS l, count(*) AS c, min(url) AS m FROM pages WHERE url <> '' GROUP BY 1 HAVING count(*) > 1 ORDER BY l DESC, h LIMIT 25")
_add("sums90", "lineitem", lambda t: aggregate(t, **{f"s{k}": sum_(plus("l_linenumber", k)) for k in range(90)}), "SELECT " + ", ".join(f"CAST(sum(CAST(l_linenumber AS BIGINT) + {k}) AS BIGINT) AS s{k}" for k in range(90)) + " FROM lineitem")
_add("const_col", "pages", lambda t: project(top_k(group_by(t, ["url"], c=count()), 10, "c", then=("url",)), "url", "c", one=F.lit(1)), "SELECT url, count(*) AS c, 1 AS one FROM pages GROUP BY 1 ORDER BY c DESC, url LIMIT 10")
_add("derived_cols", "events", lambda t: project(top_k(group_by(t, ["user_id"], c=count()), 10, "c", then=("user_id",)), "user_id", "c", a=plus("user_id", -1), b=plus("user_id", -2), e=plus("user_id", -3)), "SELECT user_id, count(*) AS c, user_id - 1 AS a, user_id - 2 AS b, user_id - 3 AS e FROM events GROUP BY user_id ORDER BY c DESC, user_id LIMIT 10")
_add("star_topk_asc", "events", lambda t: top_k(where(t, contains("event_type", "cl")), 10, "ts", desc=False, then=("event_id",)), "SELECT * FROM events WHERE contains(event_type, 'cl') ORDER BY ts, event_id LIMIT 10")
_add("topk_2key", "pages", lambda t: project(top_k(where(t, ne("url", "")), 10, "url", "page_id", desc=False), "url"), "SELECT url FROM (SELECT url, page_id FROM pages WHERE url <> '' ORDER BY url, page_id LIMIT 10) t")
_add("topk_zero", "events", lambda t: top_k(project(t, "event_id"), 0, "event_id"), "SELECT event_id FROM events LIMIT 0")
_add("full_sort", "supplier", lambda t: order(project(t, "s_name", "s_suppkey"), "s_name", "s_suppkey", desc=True), "SELECT s_name, s_suppkey FROM supplier ORDER BY 1 DESC, 2 DESC")
_add("first_seen_groups", "nation", lambda t: _ranked(first_seen(t, ["n_regionkey"], by="n_nationkey", c=count())), "SELECT n_regionkey, count(*) AS c, row_number() OVER (ORDER BY min(n_nationkey)) AS place FROM nation GROUP BY 1")
_add("limit_any", "region", lambda t: aggregate(group_by(t, ["r_name"], c=count()).limit(3), c=count()), "SELECT count(*) AS c FROM (SELECT r_name FROM region GROUP BY 1 LIMIT 3) t")
_add("multi_and_range", "lineitem", lambda t: top_k(group_by(where(t, all_of(eq("l_linenumber", 3), ge("l_shipdate", F.lit(DAY[0]).cast("timestamp_ntz")), le("l_shipdate", F.lit(DAY[1]).cast("timestamp_ntz")), ne("l_quantity", 0))), {"k": "l_suppkey"}, c=count()), 10, "c", then=("k",)), "SELECT l_suppkey AS k, count(*) AS c FROM lineitem WHERE l_linenumber = 3 AND l_shipdate >= TIMESTAMP '1998-07-01 00:00:00' AND l_shipdate <= TIMESTAMP '1998-07-31 00:00:00' AND l_quantity <> 0 GROUP BY 1 ORDER BY c DESC, k LIMIT 10")
_add("offset_page", "lineitem", lambda t: page(group_by(t, {"k": "l_partkey"}, c=count()), 1000, 10, "c", then=("k",)), "SELECT l_partkey AS k, count(*) AS c FROM lineitem GROUP BY 1 ORDER BY c DESC, k LIMIT 10 OFFSET 1000")
_add("or_filter_page", "orders", lambda t: page(group_by(where(t, any_of(eq("o_orderstatus", "P"), eq("o_orderstatus", "F"))), {"k": "o_custkey", "p": "o_orderpriority"}, c=count()), 100, 10, "c", then=("k", "p")), "SELECT o_custkey AS k, o_orderpriority AS p, count(*) AS c FROM orders WHERE o_orderstatus = 'P' OR o_orderstatus = 'F' GROUP BY 1, 2 ORDER BY c DESC, k, p LIMIT 10 OFFSET 100")
_add("minute_trunc_page", "events", lambda t: page(group_by(where(t, ne("event_type", "error")), {"m": trunc_minute("ts")}, c=count()), 1000, 10, "m", desc=False), "SELECT date_trunc('minute', ts) AS m, count(*) AS c FROM events WHERE event_type <> 'error' GROUP BY 1 ORDER BY m LIMIT 10 OFFSET 1000")
_add("sum_double_rounded", "lineitem", lambda t: aggregate(t, s=F.round(sum_("l_extendedprice"), 2), a=F.round(avg("l_extendedprice"), 6)), "SELECT round(sum(l_extendedprice), 2) AS s, round(avg(l_extendedprice), 6) AS a FROM lineitem")
_add("sum_double_exact", "lineitem", lambda t: aggregate(t, s=exact_sum("l_extendedprice")), "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS s FROM lineitem")
_add("group_sum_double", "lineitem", lambda t: group_by(t, {"k": "l_suppkey"}, s=F.round(sum_(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)), "SELECT l_suppkey AS k, round(sum(l_extendedprice * (1 - l_discount)), 2) AS s FROM lineitem GROUP BY 1")
_add("format_dates", "orders", lambda t: project(t, "o_orderkey", d=format_date("o_orderdate"), s=format_timestamp("o_orderdate")), "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS s FROM orders")
_add("parse_dates", "orders", lambda t: project(t, "o_orderkey", d=parse_date(format_date("o_orderdate")), e=parse_date("o_orderpriority"), s=parse_timestamp(format_timestamp("o_orderdate"))), "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, DATE '1970-01-01' AS e, date_trunc('second', o_orderdate) AS s FROM orders")
_add("cell_text", "customer", lambda t: project(t, "c_custkey", n=text("c_nationkey"), b=text("c_acctbal", double=True)), "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS n, printf('%.6f', c_acctbal) AS b FROM customer")
_add("csv_round_trip", "customer", _from_csv, "SELECT * FROM customer")
_add("csv_times", "orders", lambda t: _from_csv(project(t, "o_orderkey", "o_orderdate")), "SELECT o_orderkey, date_trunc('second', o_orderdate) AS o_orderdate FROM orders")
_add("csv_quoted_lines", "documents", lambda t: _from_csv(project(t, "text", "doc_id"), multi_line=True), "SELECT text, doc_id FROM documents")
_add("csv_schema", "part", lambda t: _described(_from_csv(t)), f"SELECT column_name AS name, {KINDS} AS kind FROM (DESCRIBE part)")
_add("ingest_clustered", "orders", _ingested, "SELECT o_orderkey, date_trunc('second', o_orderdate) AS o_orderdate, (SELECT count(*) FROM orders) AS n, true AS told FROM orders")
_add("sink_round_trip", "lineitem", lambda t: _stored(t, cluster=["l_shipdate"]), "SELECT * FROM lineitem")
_add("skip_row_groups", "lineitem", lambda t: project(where(_stored(t, cluster=["l_orderkey"], group_bytes=1 << 16), lt("l_orderkey", 100)), "l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey < 100")
_add("codec_integers", "lineitem", lambda t: _stored(project(t, "l_orderkey", "l_shipdate", n=F.col("l_linenumber").cast("smallint"), p=F.col("l_partkey").cast("int"), d=F.col("l_shipdate").cast("date")), delta=True), "SELECT l_orderkey, l_shipdate, CAST(l_linenumber AS SMALLINT) AS n, CAST(l_partkey AS INT) AS p, CAST(l_shipdate AS DATE) AS d FROM lineitem")
_add("codec_strings", "customer", lambda t: _stored(project(t, "c_custkey", "c_name", "c_mktsegment"), cluster=["c_name"], delta=True), "SELECT c_custkey, c_name, c_mktsegment FROM customer")
_add("codec_doubles", "orders", lambda t: _stored(project(t, "o_orderkey", "o_totalprice"), delta=True), "SELECT o_orderkey, o_totalprice FROM orders")
_add("describe_scalars", "events", _described, f"SELECT column_name AS name, {KINDS} AS kind FROM (DESCRIBE events)")
_add("describe_arrays", "embeddings", _described, f"SELECT column_name AS name, {KINDS} AS kind FROM (DESCRIBE embeddings)")
_add("user_aggregate", "lineitem", lambda t: group_by(t, {"k": "l_returnflag"}, r=F.round(composed(lambda x: F.sqrt(F.avg(x * x)), "l_quantity"), 6)), "SELECT l_returnflag AS k, round(sqrt(avg(l_quantity * l_quantity)), 6) AS r FROM lineitem GROUP BY 1")
_add("user_operator", "orders", lambda t: t.transform(_dearest, "o_custkey", "o_totalprice"), "SELECT o_custkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1")
