"""Queries of joins by time, windows, aggregates, set operations, graphs and streams over whole tables, with their SQL."""

from __future__ import annotations

import math
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from declq.functions import library
from declq.operators import aggregates, ranges, timejoin
from declq.operators.mergeable import Aggregator, aggregate, lateral
from declq.operators.pipeline import Pipeline
from declq.plans import objectql, relax
from declq.checkpoint import scratch
from declq.plans.catalog import Catalog, Entity, Parent
from declq.plans.derive import derive
from declq.registry import ENTITIES, catalog, query
from declq.sources import shards
from declq.sources.tables import parquet, parquet_catalog
from declq.streaming import state
from declq.streaming.events import read_events

# --- joins by time ---------------------------------------------------------------------------------------------------

#: The events' month laid over the years of the orders.
_SHIFTED = "timestampadd(SECOND, CAST((unix_micros(CAST(ts AS TIMESTAMP)) - 1704067200000000) * 80 / 1000000 AS BIGINT), TIMESTAMP '1992-01-01')"
_SHIFTED_SQL = "TIMESTAMP '1992-01-01' + to_seconds(CAST(trunc((epoch_us(ts) - 1704067200000000) * 80 / 1000000) AS BIGINT))"
_LAST_ORDERS_SQL = "(SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL)"


def _shifted_events(spark: SparkSession, folder: str) -> DataFrame:
    return parquet(spark, folder, "events").select("event_id", "user_id", F.expr(_SHIFTED).alias("happened"))


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return parquet(spark, folder, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("o_at"))


@query("j_asof", f"SELECT event_id, o_orderkey FROM (SELECT event_id, user_id, {_SHIFTED_SQL} AS happened FROM events) e ASOF LEFT JOIN {_LAST_ORDERS_SQL} o ON user_id = o_custkey AND happened >= o_orderdate")
def j_asof(spark: SparkSession, folder: str) -> DataFrame:
    """The last order of each event's user at the event's time; of orders of one time that with the greatest key."""
    joined = timejoin.asof_join(_shifted_events(spark, folder), _orders(spark, folder), "happened", "o_at", [("user_id", "o_custkey")], ["o_orderkey"])
    return joined.select("event_id", "o_orderkey")


@query("j_asof_all", f"SELECT event_id, o_orderkey FROM (SELECT event_id, {_SHIFTED_SQL} AS happened FROM events) e ASOF LEFT JOIN (SELECT o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) o ON happened >= o_orderdate")
def j_asof_all(spark: SparkSession, folder: str) -> DataFrame:
    """The last order of anybody at each event's time: one key that has all rows."""
    return timejoin.asof_join(_shifted_events(spark, folder), _orders(spark, folder), "happened", "o_at", ties=["o_orderkey"]).select("event_id", "o_orderkey")


@query("j_asof_within", f"SELECT event_id, o_orderkey FROM (SELECT event_id, user_id, {_SHIFTED_SQL} AS happened FROM events) e ASOF JOIN {_LAST_ORDERS_SQL} o ON user_id = o_custkey AND happened >= o_orderdate WHERE o_orderdate + INTERVAL 100 DAY >= happened")
def j_asof_within(spark: SparkSession, folder: str) -> DataFrame:
    """Only matches of the last hundred days, and only events that have one."""
    joined = timejoin.asof_join(_shifted_events(spark, folder), _orders(spark, folder), "happened", "o_at", [("user_id", "o_custkey")], ["o_orderkey"], F.expr("INTERVAL 100 DAY"), "inner")
    return joined.select("event_id", "o_orderkey")


def _spans(spark: SparkSession, folder: str, kind: str, minutes: float, side: str) -> DataFrame:
    """Events of a kind as spans: from their time on, `minutes` times their value."""
    rows = parquet(spark, folder, "events").where(F.col("event_type") == kind)
    low = F.unix_micros(F.col("ts").cast("timestamp"))
    return rows.select(F.col("event_id").alias(f"{side}_id"), F.col("user_id").alias(f"{side}_user"), low.alias(f"{side}_from"), (low + F.floor(F.col("value") * (minutes * 60_000_000))).alias(f"{side}_to"))


def _spans_sql(kind: str, minutes: float, side: str) -> str:
    return f"(SELECT event_id AS {side}_id, user_id AS {side}_user, epoch_us(ts) AS {side}_from, epoch_us(ts) + CAST(floor(value * {minutes * 60_000_000}) AS BIGINT) AS {side}_to FROM events WHERE event_type = '{kind}')"


@query("j_interval", f"SELECT x_id, y_id FROM {_spans_sql('error', 20.0, 'x')} x JOIN {_spans_sql('view', 3.0, 'y')} y ON x_user = y_user AND x_from < y_to AND y_from < x_to AND x_from < x_to AND y_from < y_to")
def j_interval(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of errors and of views of one user that overlap; lengths differ by orders of magnitude."""
    pairs = timejoin.overlap_join(_spans(spark, folder, "error", 20.0, "x"), _spans(spark, folder, "view", 3.0, "y"), ("x_from", "x_to"), ("y_from", "y_to"), [("x_user", "y_user")])
    return pairs.select("x_id", "y_id")


@query("j_interval_all", f"SELECT x_id, count(*) AS n, max(y_id) AS last FROM {_spans_sql('purchase', 0.3, 'x')} x JOIN {_spans_sql('view', 3.0, 'y')} y ON x_from < y_to AND y_from < x_to AND x_from < x_to AND y_from < y_to GROUP BY x_id")
def j_interval_all(spark: SparkSession, folder: str) -> DataFrame:
    """How many spans of views, of any user, each span of a purchase overlaps."""
    pairs = timejoin.overlap_join(_spans(spark, folder, "purchase", 0.3, "x"), _spans(spark, folder, "view", 3.0, "y"), ("x_from", "x_to"), ("y_from", "y_to"))
    return pairs.groupBy("x_id").agg(F.count(F.lit(1)).alias("n"), F.max("y_id").alias("last"))


# --- windows on hot keys ---------------------------------------------------------------------------------------------


@query("w_rank_hot", "SELECT l_orderkey, l_linenumber, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC) AS rank_desc, count(*) OVER (PARTITION BY l_returnflag) AS total FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity)")
def w_rank_hot(spark: SparkSession, folder: str) -> DataFrame:
    """Ranks of quantities among a return flag's lines: three keys, and fifty values with ties of thousands."""
    ranked = ranges.rank_rows(parquet(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), ["l_returnflag"], ["l_quantity"])
    return ranked.select("l_orderkey", "l_linenumber", "rank", "dense_rank", "rank_desc", "total")


@query("w_row_number", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_linestatus ORDER BY l_shipdate, l_orderkey, l_linenumber) AS number FROM lineitem")
def w_row_number(spark: SparkSession, folder: str) -> DataFrame:
    rows = parquet(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_shipdate")
    return ranges.number_rows(rows, ["l_linestatus"], ["l_shipdate", "l_orderkey", "l_linenumber"], rows_per_range=20_000).select("l_orderkey", "l_linenumber", "number")


@query("w_moving_sum", "SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER w AS total, max(l_quantity) OVER w AS most, count(*) OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def w_moving_sum(spark: SparkSession, folder: str) -> DataFrame:
    """Over a line and the nine before it of its return flag."""
    rows = parquet(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate", "l_quantity", "l_partkey", "l_extendedprice")
    frames = {"total": F.sum("l_quantity"), "most": F.max("l_quantity"), "n": F.count(F.lit(1))}
    out = ranges.moving(rows, ["l_returnflag"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], 9, rows_per_range=20_000, **frames)
    return out.select("l_orderkey", "l_linenumber", "total", "most", "n")


# --- aggregates ------------------------------------------------------------------------------------------------------

_QS = (0.05, 0.5, 0.999)


@query("a_percentile", " UNION ALL ".join(f"SELECT l_returnflag, CAST({q} AS DOUBLE) AS q, quantile_disc(l_extendedprice, {q}) AS value FROM lineitem GROUP BY l_returnflag" for q in _QS))
def a_percentile(spark: SparkSession, folder: str) -> DataFrame:
    return aggregates.percentiles(parquet(spark, folder, "lineitem"), ["l_returnflag"], "l_extendedprice", list(_QS))


@query("a_percentile_all", "SELECT CAST(0.5 AS DOUBLE) AS q, quantile_disc(value, 0.5) AS value FROM events UNION ALL SELECT 0.99, quantile_disc(value, 0.99) FROM events")
def a_percentile_all(spark: SparkSession, folder: str) -> DataFrame:
    return aggregates.percentiles(parquet(spark, folder, "events"), [], "value", [0.5, 0.99])


@query("a_hll_merge", "SELECT event_type, count(*) AS n_rows, count(DISTINCT user_id) AS n_users, true AS near, true AS same FROM events GROUP BY event_type")
def a_hll_merge(spark: SparkSession, folder: str) -> DataFrame:
    """States a day and type, merged to a type: within three standard errors of the exact count, and what one state of all rows says."""
    events = parquet(spark, folder, "events").withColumn("day", F.to_date("ts"))
    merged = aggregates.merge_distinct(aggregates.distinct_states(events, ["day", "event_type"], "user_id"), ["event_type"])
    direct = aggregates.merge_distinct(aggregates.distinct_states(events, ["event_type"], "user_id"), ["event_type"]).select("event_type", F.col("state").alias("other"))
    exact = events.groupBy("event_type").agg(F.countDistinct("user_id").alias("n_users"))
    rows = merged.join(direct, "event_type").join(exact, "event_type")
    guess = aggregates.distinct_estimate(F.col("state"))
    near = F.abs(guess - F.col("n_users")) <= 1 + F.col("n_users") * (3 * 1.04 / math.sqrt(1 << aggregates.LG_K))
    return rows.select("event_type", "n_rows", "n_users", near.alias("near"), (F.abs(guess - aggregates.distinct_estimate(F.col("other"))) <= 1).alias("same"))


@query("a_quantile_merge", "SELECT event_type, count(*) AS n_rows, true AS near FROM events GROUP BY event_type")
def a_quantile_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Quantile states a day and type, merged to a type: the share of values below the estimated median is within the stated error of one half."""
    events = parquet(spark, folder, "events").withColumn("day", F.to_date("ts"))
    merged = aggregates.merge_quantiles(aggregates.quantile_states(events, ["day", "event_type"], "value"), ["event_type"])
    median = merged.select("event_type", "n_rows", aggregates.quantile_estimate(F.col("state"), 0.5).alias("median"))
    counted = events.select(F.col("event_type").alias("type"), "value").join(F.broadcast(median), F.col("type") == F.col("event_type"))  # a row an event type
    low, high = F.avg((F.col("value") < F.col("median")).cast("int")), F.avg((F.col("value") <= F.col("median")).cast("int"))
    near = (low <= 0.5 + aggregates.RANK_ERROR) & (high >= 0.5 - aggregates.RANK_ERROR)
    return counted.groupBy("event_type", "n_rows").agg(near.alias("near"))


_CUBED = "SELECT o_orderstatus, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority, CAST(year(o_orderdate) AS INTEGER) AS y, o_custkey, o_totalprice FROM orders"


def _cubed(spark: SparkSession, folder: str) -> DataFrame:
    orders = parquet(spark, folder, "orders")
    return orders.select("o_orderstatus", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("priority"), F.year("o_orderdate").alias("y"), "o_custkey", F.floor("o_totalprice").alias("price"))


@query("a_cube_distinct", f"SELECT o_orderstatus, priority, y, CAST(grouping_id(o_orderstatus, priority, y) AS INTEGER) AS grouping_id, count(*) AS n_rows, CAST(sum(floor(o_totalprice)) AS BIGINT) AS total, count(DISTINCT o_custkey) AS customers FROM ({_CUBED}) GROUP BY CUBE (o_orderstatus, priority, y)")
def a_cube_distinct(spark: SparkSession, folder: str) -> DataFrame:
    dims = ["o_orderstatus", "priority", "y"]
    return aggregates.grouping_sets(_cubed(spark, folder), dims, aggregates.cube(dims), {"total": "price"}, {"customers": "o_custkey"})


@query("a_rollup_distinct", f"SELECT y, priority, CAST(grouping_id(y, priority) AS INTEGER) AS grouping_id, count(*) AS n_rows, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS states FROM ({_CUBED}) GROUP BY ROLLUP (y, priority)")
def a_rollup_distinct(spark: SparkSession, folder: str) -> DataFrame:
    dims = ["y", "priority"]
    return aggregates.grouping_sets(_cubed(spark, folder), dims, aggregates.rollup(dims), distinct={"customers": "o_custkey", "states": "o_orderstatus"})


def _moments_update(state: tuple, rows: pa.RecordBatch) -> tuple:
    x = rows.column(rows.schema.get_field_index("l_extendedprice"))
    n = len(x) - x.null_count
    if not n:
        return state
    mean = pc.mean(x).as_py()
    return _moments_merge(state, (n, mean, pc.sum(pc.power(pc.subtract(x, mean), 2)).as_py(), pc.max(x).as_py()))


def _moments_merge(a: tuple, b: tuple) -> tuple:
    if not a[0] or not b[0]:
        return a if a[0] else b
    n, step = a[0] + b[0], b[1] - a[1]
    return n, a[1] + step * b[0] / n, a[2] + b[2] + step * step * a[0] * b[0] / n, max(a[3], b[3])


MOMENTS = Aggregator(lambda: (0, 0.0, 0.0, None), _moments_update, _moments_merge, lambda s: {"n": s[0], "spread": math.sqrt(s[2] / s[0]) if s[0] else None, "most": s[3]})


@query("u_udaf_merge", "SELECT l_returnflag, count(l_extendedprice) AS n, stddev_pop(l_extendedprice) AS spread, max(l_extendedprice) AS most FROM lineitem GROUP BY l_returnflag")
def u_udaf_merge(spark: SparkSession, folder: str) -> DataFrame:
    """A user's aggregate: count, mean and squared deviations of Arrow batches, merged pairwise."""
    return aggregate(parquet(spark, folder, "lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], MOMENTS, "n long, spread double, most double")


def _words(batch: pa.RecordBatch) -> Any:
    for i, name in enumerate(batch.column(batch.schema.get_field_index("p_name")).to_pylist()):
        for place, word in enumerate((name or "").split("_")):
            yield i, {"place": place, "word": word}


@query("u_udtf", "SELECT p_partkey, CAST(i - 1 AS INTEGER) AS place, w[i] AS word FROM (SELECT p_partkey, w, unnest(generate_series(1, len(w))) AS i FROM (SELECT p_partkey, string_split(p_name, '_') AS w FROM part))")
def u_udtf(spark: SparkSession, folder: str) -> DataFrame:
    """A user's table function: the words of each part's name with their places."""
    return lateral(parquet(spark, folder, "part").select("p_partkey", "p_name"), _words, "place int, word string").select("p_partkey", "place", "word")


# --- object text -----------------------------------------------------------------------------------------------------

_LOW = "SELECT CASE WHEN l.returnFlag = 'R' THEN NULL ELSE l.quantity END AS q, l.discount AS d FROM LineItem l WHERE l.quantity < 30"
_HIGH = "SELECT CASE WHEN m.returnFlag = 'R' THEN NULL ELSE m.quantity END AS q, m.discount AS d FROM LineItem m WHERE m.quantity > 20 AND m.discount > 0.03"
_LOW_SQL, _HIGH_SQL = (f"SELECT CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END AS q, l_discount AS d FROM lineitem WHERE {c}" for c in ("l_quantity < 30", "l_quantity > 20 AND l_discount > 0.03"))

#: name, text, SQL.
_TEXTS: list[tuple[str, str, str]] = [
    ("q_join_multi_hop", "SELECT l.orderKey AS order_key, l.lineNumber AS line, c.name AS name FROM LineItem l JOIN l.order.customer c WHERE l.quantity >= 49", "SELECT l_orderkey AS order_key, l_linenumber AS line, c_name AS name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity >= 49"),
    ("q_join_multi_hop_left", "SELECT l.orderKey AS order_key, n.name AS nation, l.order.orderStatus AS status FROM LineItem l LEFT JOIN l.order.customer.nation n ON n.nationKey = l.order.customer.nationKey AND n.regionKey = 2 WHERE l.quantity >= 49", "SELECT l_orderkey AS order_key, n_name AS nation, o_orderstatus AS status FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 2 WHERE l_quantity >= 49"),
    ("q_join_on_path", "SELECT o.orderKey AS order_key, c.name AS name FROM Order o LEFT JOIN o.customer c ON o.custKey = c.custKey AND c.nation.region.name = 'ASIA' WHERE o.totalPrice > 200000", "SELECT o_orderkey AS order_key, c_name AS name FROM orders LEFT JOIN (SELECT c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') ON o_custkey = c_custkey WHERE o_totalprice > 200000"),
    ("q_select_subselect", "SELECT c.custKey AS cust_key, (SELECT COUNT(o) FROM Order o WHERE o.custKey = c.custKey AND o.orderStatus = 'F') AS n, (SELECT MAX(p.totalPrice) FROM Order p) - c.balance AS gap FROM Customer c", "SELECT c_custkey AS cust_key, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n, (SELECT max(o_totalprice) FROM orders) - c_acctbal AS gap FROM customer"),
    ("q_subselect_nested", "SELECT n.name AS name, CASE WHEN (SELECT COUNT(c) FROM Customer c WHERE c.nationKey = n.nationKey AND c.balance > (SELECT AVG(d.balance) FROM Customer d)) > 5 THEN 'many' ELSE 'few' END AS rich FROM Nation n", "SELECT n_name AS name, CASE WHEN (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > (SELECT avg(c_acctbal) FROM customer)) > 5 THEN 'many' ELSE 'few' END AS rich FROM nation"),
    ("q_exists_inner_path", "SELECT n.name AS name FROM Nation n WHERE EXISTS (SELECT o FROM Order o WHERE o.customer.nationKey = n.nationKey AND o.totalPrice > 290000)", "SELECT n_name AS name FROM nation WHERE EXISTS (SELECT 1 FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey AND o_totalprice > 290000)"),
    ("q_intersect_all", f"{_LOW} INTERSECT ALL {_HIGH}", f"{_LOW_SQL} INTERSECT ALL {_HIGH_SQL}"),
    ("q_except_all", f"{_LOW} EXCEPT ALL {_HIGH}", f"{_LOW_SQL} EXCEPT ALL {_HIGH_SQL}"),
    ("q_intersect", f"{_LOW} INTERSECT {_HIGH}", f"{_LOW_SQL} INTERSECT {_HIGH_SQL}"),
]


def _text(text: str) -> Any:
    return lambda spark, folder: objectql.run(spark, catalog(spark, folder), text)


for _name, _query, _sql in _TEXTS:
    query(_name, _sql)(_text(_query))


# --- streams ---------------------------------------------------------------------------------------------------------

_SESSIONS_SQL = """
WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e),
g AS (SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n, sum(value) AS total FROM s GROUP BY user_id, session)
SELECT * FROM g WHERE "end" + INTERVAL 30 MINUTE < (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 HOUR FROM events)
"""


@query("st_sessions", _SESSIONS_SQL)
def st_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Replay of the events as a stream: sessions of a user, closed by timers; those that the watermark hasn't passed are still open."""
    state.with_state_store(spark)
    return state.replayed(state.closed_sessions(read_events(spark, folder)))


@query("st_click_after_view", "SELECT v.user_id, v.event_id AS first_id, v.ts AS first_at, c.event_id AS then_id, c.ts AS then_at FROM events v JOIN events c ON v.user_id = c.user_id AND v.event_type = 'view' AND c.event_type = 'click' AND c.ts BETWEEN v.ts AND v.ts + INTERVAL 1 HOUR")
def st_click_after_view(spark: SparkSession, folder: str) -> DataFrame:
    """Replay of the events as two streams: clicks within an hour of a view of the same user."""
    state.with_state_store(spark)
    return state.replayed(state.followed(read_events(spark, folder), "view", "click"))


# --- relaxation, methods, comparators ---------------------------------------------------------------------------------


@query("x_sample_rows", "SELECT * FROM orders WHERE (o_orderstatus, o_orderpriority) IN (SELECT (o_orderstatus, o_orderpriority) FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderkey LIMIT 4)")
def x_sample_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Arguments from four rows of a relaxed query, and all rows that a later call with any of them finds."""
    c = catalog(spark, folder)
    arguments = relax.sample_arguments(c, "Order", "findByOrderStatusAndPriorityAndTotalPriceGreaterThan", "orderKey", rows=4, keep=("totalPrice",), values={"totalPrice": [1000.0]})
    return relax.matching(c, "Order", arguments)


@query("e_list_methods", "SELECT p_partkey, CAST(len(w) AS INTEGER) AS size, w[1] AS first, w[len(w)] AS last, list_contains(w, 'widget') AS has, CAST(coalesce(list_position(w, 'widget'), 0) - 1 AS BIGINT) AS at, array_to_string(w[2:], '+') AS rest, array_to_string(list_append(w, p_brand), '+') AS more, array_to_string(list_reverse(w), '+') AS back FROM (SELECT *, string_split(p_name, '_') AS w FROM part)")
def e_list_methods(spark: SparkSession, folder: str) -> DataFrame:
    words = F.split("p_name", "_")
    of = lambda name, *args: library.call("List", name, words, *args)
    text = lambda c: F.array_join(c, "+")
    columns = {"size": of("size"), "first": of("getFirst"), "last": of("getLast"), "has": of("contains", "widget"), "at": of("indexOf", "widget").cast("long")}
    columns |= {"rest": text(library.call("List", "subList", words, 1, F.size(words))), "more": text(of("add", F.col("p_brand"))), "back": text(of("reversed"))}
    return parquet(spark, folder, "part").select("p_partkey", *[c.alias(n) for n, c in columns.items()])


@query("e_map_methods", "SELECT p_partkey, p_size AS size, CASE WHEN p_brand = 'Brand#11' THEN p_size ELSE -1 END AS chosen, p_brand = 'Brand#11' AS has, CAST(CASE WHEN p_brand = 'Brand#11' THEN 1 ELSE 2 END AS INTEGER) AS n, true AS put FROM part")
def e_map_methods(spark: SparkSession, folder: str) -> DataFrame:
    """A map of one entry a part, by its brand."""
    entry = F.create_map(F.col("p_brand"), F.col("p_size"))
    of = lambda name, *args: library.call("Map", name, entry, *args)
    more = of("put", "Brand#11", F.lit(0))
    columns = {"size": of("get", F.col("p_brand")), "chosen": of("getOrDefault", "Brand#11", -1), "has": of("containsKey", "Brand#11"), "n": library.call("Map", "size", more), "put": library.call("Map", "get", more, "Brand#11") == 0}
    return parquet(spark, folder, "part").select("p_partkey", *[c.alias(n) for n, c in columns.items()])


@query("s_sorted_with", "SELECT CAST(row_number() OVER (ORDER BY p_size % 10, p_size DESC, p_partkey) AS BIGINT) AS number, p_size AS value FROM part")
def s_sorted_with(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes in the order of a comparator: by the last digit, then downwards."""
    compare = lambda a, b: F.when(a % 10 != b % 10, a % 10 - b % 10).otherwise(b - a)
    ordered = Pipeline(parquet(spark, folder, "part"), "p_size", "p_partkey").sorted_with(compare, per_bucket=16)
    return ranges.number_rows(ordered.df, [], ["key"]).select("number", "value")


# --- lists as rows, folds with a combiner -----------------------------------------------------------------------------


@query("s_list_rows", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS place, p_size AS value FROM part")
def s_list_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The list of a stream as rows with their places, of any length."""
    return Pipeline(parquet(spark, folder, "part"), "p_size", "p_partkey").listed()


@query("s_group_rows", "SELECT event_type AS \"group\", row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS place, user_id AS value FROM events")
def s_group_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Users by event type, five groups that hold a fifth of all rows each, as rows with their places."""
    users = Pipeline(parquet(spark, folder, "events"), F.struct("event_type", "user_id"), "event_id")
    return users.grouped(lambda v: v["event_type"]).select("group", "place", F.col("value.user_id").alias("value"))


@query("s_partition_rows", "SELECT p_size > 25 AS \"group\", row_number() OVER (PARTITION BY p_size > 25 ORDER BY p_partkey) - 1 AS place, p_size AS value FROM part")
def s_partition_rows(spark: SparkSession, folder: str) -> DataFrame:
    return Pipeline(parquet(spark, folder, "part"), "p_size", "p_partkey").grouped(lambda v: v > 25)


@query("s_collect_merged", "SELECT CAST(sum(p_size) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n, string_agg(p_size, ',' ORDER BY p_partkey) FILTER (p_size > 49) AS large FROM part")
def s_collect_merged(spark: SparkSession, folder: str) -> DataFrame:
    """A collector with supplier, accumulator and combiner: sum, count and an ordered text of the few large values."""
    state_of = lambda total, n, large: F.struct(total.alias("total"), n.alias("n"), large.alias("large"))
    both = lambda a, b: F.concat(a, F.when((a != "") & (b != ""), ",").otherwise(""), b)
    add = lambda a, x: state_of(a["total"] + x, a["n"] + 1, both(a["large"], F.when(x > 49, x.cast("string")).otherwise("")))
    merge = lambda a, b: state_of(a["total"] + b["total"], a["n"] + b["n"], both(a["large"], b["large"]))
    start = state_of(F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(""))
    return Pipeline(parquet(spark, folder, "part"), "p_size", "p_partkey").collect(start, add, merge).select("collected.total", "collected.n", F.nullif("collected.large", F.lit("")).alias("large"))


# --- sources and inheritance ------------------------------------------------------------------------------------------


@query("io_source", "SELECT page_id, url FROM pages WHERE page_id >= 20 AND url LIKE 'https://%'")
def io_source(spark: SparkSession, folder: str) -> DataFrame:
    """All pages, written as sharded JSON lines and read by the data source, which tests both conditions itself."""
    target = scratch(spark, "pages")
    parquet(spark, folder, "pages").repartition(4).write.json(target)
    shards.with_filters(spark)
    pages = spark.read.format("shards").schema("page_id long, url string").option("split_bytes", 1 << 20).load(target)
    return pages.where((F.col("page_id") >= 20) & F.col("url").startswith("https://"))


def _inherited(spark: SparkSession, folder: str) -> Catalog:
    """Lines as a kind of order: the parent's row is joined by its key."""
    known = [e for e in ENTITIES if e.name in ("Order", "Customer", "Nation", "Region")]
    order = next(e for e in known if e.name == "Order")
    line = Entity("OrderedLine", "lineitem", "l_orderkey", {"lineNumber": "l_linenumber", "quantity": "l_quantity", **order.columns}, dict(order.relations), parent=Parent("Order", "l_orderkey", "o_orderkey"))
    return parquet_catalog(spark, folder, [*known, line])


@query("q_joined_parent", "SELECT l_linenumber AS line, o_orderstatus AS status, c_name AS name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity > 48 AND o_totalprice > 200000")
def q_joined_parent(spark: SparkSession, folder: str) -> DataFrame:
    """An entity whose inherited properties are in its parent's table, in object text."""
    text = "SELECT l.lineNumber AS line, l.orderStatus AS status, l.customer.name AS name FROM OrderedLine l WHERE l.quantity > 48 AND l.totalPrice > 200000"
    return objectql.run(spark, _inherited(spark, folder), text)


@query("d_joined_parent", "SELECT count(*) AS count FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' AND l_quantity > 40")
def d_joined_parent(spark: SparkSession, folder: str) -> DataFrame:
    return derive(_inherited(spark, folder), "OrderedLine", "countByOrderStatusAndQuantityGreaterThan", "P", 40.0)
