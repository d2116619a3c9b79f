"""Queries by name over the driver's tables, and the SQL that gives the same rows on another engine."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from declq.checkpoint import cut
from declq.functions import library, naming, scalar
from declq.operators import graph, report
from declq.operators.pipeline import Pipeline
from declq.operators.ranges import number_rows
from declq.plans import native, objectql, relax, truth
from declq.plans.catalog import Catalog, Entity, Relation
from declq.plans.derive import derive
from declq.sources.tables import entity_rows, optional, parquet, parquet_catalog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


ENTITIES = [
    Entity("Region", "region", "r_regionkey", {"id": "r_regionkey", "regionKey": "r_regionkey", "name": "r_name"}),
    Entity("Nation", "nation", "n_nationkey", {"id": "n_nationkey", "nationKey": "n_nationkey", "name": "n_name", "regionKey": "n_regionkey"}, {"region": Relation("Region", "n_regionkey", "r_regionkey", optional=False)}),
    Entity("Customer", "customer", "c_custkey", {"id": "c_custkey", "custKey": "c_custkey", "name": "c_name", "nationKey": "c_nationkey", "balance": "c_acctbal", "segment": "c_mktsegment"}, {"nation": Relation("Nation", "c_nationkey", "n_nationkey", optional=False), "orders": Relation("Order", "c_custkey", "o_custkey", many=True)}),
    Entity("Order", "orders", "o_orderkey", {"id": "o_orderkey", "orderKey": "o_orderkey", "custKey": "o_custkey", "orderStatus": "o_orderstatus", "totalPrice": "o_totalprice", "orderDate": "o_orderdate", "priority": "o_orderpriority"}, {"customer": Relation("Customer", "o_custkey", "c_custkey", optional=False)}),
    Entity("LineItem", "lineitem", "l_orderkey", {"orderKey": "l_orderkey", "partKey": "l_partkey", "suppKey": "l_suppkey", "lineNumber": "l_linenumber", "quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "shipDate": "l_shipdate", "returnFlag": "l_returnflag"}, {"order": Relation("Order", "l_orderkey", "o_orderkey", optional=False), "part": Relation("Part", "l_partkey", "p_partkey")}),
    Entity("Part", "part", "p_partkey", {"id": "p_partkey", "partKey": "p_partkey", "name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "price": "p_retailprice"}),
    Entity("Event", "events", "event_id", {"id": "event_id", "eventId": "event_id", "eventType": "event_type", "userId": "user_id", "value": "value"}),
]


def catalog(spark: SparkSession, folder: str) -> Catalog:
    return parquet_catalog(spark, folder, ENTITIES)


# --- derived queries -------------------------------------------------------------------------------------------------

_DATE = datetime(1996, 1, 1)
#: name, entity, method, arguments, SQL after "SELECT ", in the order of the operator inventory.
_DERIVED: list[tuple[str, str, str, tuple[Any, ...], str]] = [
    ("d_find_all", "Nation", "findAll", (), "* FROM nation"),
    ("d_find_by_id", "Order", "getOne", (7,), "* FROM orders WHERE o_orderkey = 7"),
    ("d_find_all_by_id", "Order", "findAllById", ([1, 2, 3, 99999999],), "* FROM orders WHERE o_orderkey IN (1, 2, 3, 99999999)"),
    ("d_eq", "Order", "findByOrderStatus", ("F",), "* FROM orders WHERE o_orderstatus = 'F'"),
    ("d_not", "Order", "findByOrderStatusNot", ("F",), "* FROM orders WHERE o_orderstatus <> 'F'"),
    ("d_gt_lt", "Order", "findByTotalPriceGreaterThanAndTotalPriceLessThan", (100000.0, 200000.0), "* FROM orders WHERE o_totalprice > 100000 AND o_totalprice < 200000"),
    ("d_gte_lte", "Part", "findBySizeGreaterThanEqualAndSizeLessThanEqual", (10, 20), "* FROM part WHERE p_size >= 10 AND p_size <= 20"),
    ("d_before_after", "Order", "findByOrderDateBeforeOrOrderDateAfter", (_DATE, datetime(1998, 1, 1)), "* FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' OR o_orderdate > TIMESTAMP '1998-01-01'"),
    ("d_between", "Part", "findBySizeBetween", (5, 9), "* FROM part WHERE p_size BETWEEN 5 AND 9"),
    ("d_in", "Order", "readByOrderStatusIn", (["F", "P"],), "* FROM orders WHERE o_orderstatus IN ('F', 'P')"),
    ("d_in_empty", "Order", "findByOrderStatusIn", ([],), "* FROM orders WHERE false"),
    ("d_not_in", "Order", "queryByOrderStatusNotIn", (["F", "P"],), "* FROM orders WHERE o_orderstatus NOT IN ('F', 'P')"),
    ("d_like", "Part", "findByNameLike", ("%d_w%",), "* FROM part WHERE p_name LIKE '%d_w%'"),
    ("d_not_like", "Part", "findByNameNotLike", ("%d_w%",), "* FROM part WHERE p_name NOT LIKE '%d_w%'"),
    ("d_starts", "Customer", "findBySegmentStartingWith", ("B",), "* FROM customer WHERE starts_with(c_mktsegment, 'B')"),
    ("d_ends", "Customer", "findBySegmentEndingWith", ("Y",), "* FROM customer WHERE c_mktsegment LIKE '%Y'"),
    ("d_contains", "Customer", "findBySegmentContaining", ("UI",), "* FROM customer WHERE contains(c_mktsegment, 'UI')"),
    ("d_not_contains", "Customer", "findBySegmentNotContaining", ("UI",), "* FROM customer WHERE NOT contains(c_mktsegment, 'UI')"),
    ("d_ignore_case", "Customer", "findBySegmentIgnoreCase", ("building",), "* FROM customer WHERE lower(c_mktsegment) = 'building'"),
    ("d_and_or", "Order", "findByOrderStatusAndPriorityOrTotalPriceLessThan", ("F", "1-URGENT", 5000.0), "* FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' OR o_totalprice < 5000"),
    ("d_order_multi", "Customer", "findByBalanceGreaterThanOrderBySegmentDescCustKeyAsc", (0.0,), "* FROM customer WHERE c_acctbal > 0 ORDER BY c_mktsegment DESC, c_custkey"),
    ("d_top_n", "Order", "findTop5ByOrderStatusAndTotalPriceGreaterThanOrderByTotalPriceDescOrderKeyAsc", ("F", 100000.0), "* FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 5"),
    ("d_first", "Order", "findFirstByOrderStatusOrderByOrderKey", ("O",), "* FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 1"),
    ("d_distinct", "Nation", "findDistinctNationByRegionKeyIn", ([1, 2],), "DISTINCT * FROM nation WHERE n_regionkey IN (1, 2)"),
    ("d_count", "Order", "countByOrderStatus", ("F",), "count(*) AS count FROM orders WHERE o_orderstatus = 'F'"),
    ("d_exists", "Order", "existsOrderByTotalPriceGreaterThan", (1e12,), "count(*) > 0 AS exists FROM orders WHERE o_totalprice > 1e12"),
    ("d_exists_some", "Order", "existsOrderByOrderStatus", ("P",), "count(*) > 0 AS exists FROM orders WHERE o_orderstatus = 'P'"),
    ("d_delete_survivors", "Nation", "deleteByRegionKey", (1,), "* FROM nation WHERE n_regionkey <> 1"),
    ("d_delete_by_ids", "Nation", "deleteAllByIdInBatch", ([3, 4],), "* FROM nation WHERE n_nationkey NOT IN (3, 4)"),
    ("d_insert_default", "Region", "saveAndFlush", (), "* FROM region UNION ALL SELECT NULL, NULL"),
    ("d_related_property", "Order", "findByCustomer_SegmentAndCustomer_Nation_NameInOrderByOrderKey", ("BUILDING", ["GERMANY", "FRANCE"]), "orders.* FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND n_name IN ('GERMANY', 'FRANCE')"),
    ("d_related_count", "Customer", "countByNation_Region_Name", ("ASIA",), "count(*) AS count FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    ("d_nested_property", "Order", "findByCustomer_CustKey", (10,), "* FROM orders WHERE o_custkey = 10"),
]


def _derived(entity: str, method: str, args: tuple[Any, ...]) -> Query:
    return lambda spark, folder: derive(catalog(spark, folder), entity, method, *args)


for _name, _entity, _method, _args, _sql in _DERIVED:
    query(_name, f"SELECT {_sql}")(_derived(_entity, _method, _args))


def _orders_with_nulls(spark: SparkSession, folder: str) -> Catalog:
    """Orders whose priority is null where it is 4-NOT SPECIFIED."""
    orders = parquet(spark, folder, "orders").withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")))
    return Catalog([Entity("Order", "orders", "o_orderkey", {"priority": "o_orderpriority"})], lambda _: orders)


@query("d_null", "SELECT * REPLACE (NULL::VARCHAR AS o_orderpriority) FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'")
def d_null(spark: SparkSession, folder: str) -> DataFrame:
    return derive(_orders_with_nulls(spark, folder), "Order", "findByPriorityIsNull")


@query("d_not_null", "SELECT * FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'")
def d_not_null(spark: SparkSession, folder: str) -> DataFrame:
    return derive(_orders_with_nulls(spark, folder), "Order", "findByPriorityIsNotNull")


def _numbered(df: DataFrame) -> DataFrame:
    """Few rows with their place in the order that they come in, so that the order itself is compared."""
    rows = df.select(F.struct(*df.columns).alias("r")).agg(F.collect_list("r").alias("rs"))
    return rows.select(F.posexplode("rs").alias("place", "r")).select("place", "r.*")


@query("d_top_order", "SELECT CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS INTEGER) AS place, o_orderkey, o_totalprice FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 40)")
def d_top_order(spark: SparkSession, folder: str) -> DataFrame:
    return _numbered(derive(catalog(spark, folder), "Order", "findTop40ByOrderStatusOrderByTotalPriceDescOrderKeyAsc", "F").select("o_orderkey", "o_totalprice"))


@query("d_true_false", "SELECT doc_id, quality = 1 AS good, toxic = 1 AS toxic FROM labels WHERE quality = 1 AND toxic <> 1")
def d_true_false(spark: SparkSession, folder: str) -> DataFrame:
    labels = parquet(spark, folder, "labels").select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return derive(Catalog([Entity("Label", "labels", "doc_id")], lambda _: labels), "Label", "findByGoodIsTrueAndToxicIsFalse")


@query("d_unknown_name_logged", "SELECT * FROM region")
def d_unknown_name_logged(spark: SparkSession, folder: str) -> DataFrame:
    return derive(catalog(spark, folder), "Region", "frobnicate", on_error="log")


@query("d_like_compat", "SELECT * FROM customer WHERE c_mktsegment LIKE 'BUI%NG'")
def d_like_compat(spark: SparkSession, folder: str) -> DataFrame:
    return derive(catalog(spark, folder), "Customer", "findBySegmentContaining", "BUI%NG", compat=True)


# --- object and native queries ---------------------------------------------------------------------------------------

#: name, native, text, arguments, SQL.
_TEXTS: list[tuple[str, bool, str, Any, str]] = [
    ("q_path_join_inner", False, "SELECT o.orderKey AS order_key, c.name AS name FROM Order o JOIN o.customer c WHERE o.totalPrice > :low", {"low": 300000.0}, "SELECT o_orderkey AS order_key, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000"),
    ("q_path_join_left", False, "SELECT l.orderKey AS order_key, l.lineNumber AS line, p.brand AS brand FROM LineItem l LEFT JOIN l.part p WHERE l.quantity >= ?1", [50.0], "SELECT l_orderkey AS order_key, l_linenumber AS line, p_brand AS brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 50"),
    ("q_path_join_chain", False, "SELECT l.order.customer.nation.region.name AS region, ROUND(SUM(l.price * (1 - l.discount)), 2) AS revenue FROM LineItem l WHERE l.order.orderDate >= :from GROUP BY l.order.customer.nation.region.name", {"from": _DATE}, "SELECT r_name AS region, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY r_name"),
    ("q_explicit_on", False, "SELECT c.custKey AS cust_key, o.orderKey AS order_key FROM Customer c LEFT JOIN c.orders o ON c.custKey = o.custKey AND o.totalPrice > 250000", {}, "SELECT c_custkey AS cust_key, o_orderkey AS order_key FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000"),
    ("q_group_having", False, "SELECT o.custKey AS cust_key, COUNT(o) AS n FROM Order o GROUP BY o.custKey HAVING COUNT(o) > 15", {}, "SELECT o_custkey AS cust_key, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15"),
    ("q_case", False, "SELECT o.orderKey AS order_key, CASE WHEN o.totalPrice > 200000 THEN 'big' WHEN o.totalPrice > 100000 THEN 'mid' ELSE 'small' END AS class FROM Order o", {}, "SELECT o_orderkey AS order_key, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS class FROM orders"),
    ("q_case_simple", False, "SELECT o.orderKey AS order_key, CASE o.orderStatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM Order o", {}, "SELECT o_orderkey AS order_key, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM orders"),
    ("q_sum_case_dto", False, "SELECT NEW stats.Dto(o.orderStatus AS status, SUM(CASE WHEN o.totalPrice > 150000 THEN 1 ELSE 0 END) AS big, CAST(COUNT(o) AS BIGINT) AS n) FROM Order o GROUP BY o.orderStatus", {}, "SELECT o_orderstatus AS status, CAST(SUM(CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END) AS BIGINT) AS big, count(*) AS n FROM orders GROUP BY o_orderstatus"),
    ("q_count_entity", False, "SELECT COUNT(c) AS n FROM Customer c WHERE c.nation.region.name = 'ASIA'", {}, "SELECT count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    ("q_subselect", False, "SELECT s.status AS status, COUNT(*) AS n FROM (SELECT o.orderStatus AS status, o.custKey AS cust FROM Order o WHERE o.totalPrice > 100000) s GROUP BY s.status", {}, "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus"),
    ("q_exists", False, "SELECT c.custKey AS cust_key FROM Customer c WHERE EXISTS (SELECT o FROM Order o WHERE o.custKey = c.custKey AND o.totalPrice > 280000)", {}, "SELECT c_custkey AS cust_key FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 280000)"),
    ("q_alias_star", False, "SELECT n FROM Nation n WHERE n.regionKey BETWEEN 1 AND 2 AND n.name IS NOT NULL", {}, "SELECT * FROM nation WHERE n_regionkey BETWEEN 1 AND 2"),
    ("q_distinct", False, "SELECT DISTINCT p.brand AS brand FROM Part p WHERE NOT (p.size < 10)", {}, "SELECT DISTINCT p_brand AS brand FROM part WHERE p_size >= 10"),
    ("q_like_wildcards", False, "SELECT p FROM Part p WHERE p.name LIKE %:part%", {"part": "idget"}, "SELECT * FROM part WHERE p_name LIKE '%idget%'"),
    ("q_named_params", False, "SELECT o FROM Order o WHERE o.orderStatus IN (:statuses) AND o.totalPrice < :high", {"statuses": ["F", "P"], "high": 20000.0}, "SELECT * FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice < 20000"),
    ("q_dotted_params", False, "SELECT c FROM Customer c WHERE c.segment = :#{#filter.getSegment()} AND c.balance > :#{#filter.low}", {"filter": {"segment": "BUILDING", "low": 5000.0}}, "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000"),
    ("q_delete_survivors", False, "DELETE FROM Order o WHERE o.orderStatus = :s", {"s": "F"}, "SELECT * FROM orders WHERE NOT coalesce(o_orderstatus = 'F', false)"),
    ("q_update_rows", False, "UPDATE Customer c SET c.balance = c.balance + 10, c.segment = 'NONE' WHERE c.balance < :low", {"low": 0.0}, "SELECT * REPLACE (CASE WHEN c_acctbal < 0 THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'NONE' ELSE c_mktsegment END AS c_mktsegment) FROM customer"),
    ("q_union", False, "SELECT o.custKey AS k FROM Order o WHERE o.totalPrice > 250000 UNION SELECT c.custKey AS k FROM Customer c WHERE c.balance < 0", {}, "SELECT o_custkey AS k FROM orders WHERE o_totalprice > 250000 UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0"),
    ("q_not_in_empty", False, "SELECT o FROM Order o WHERE o.orderStatus NOT IN (:l) AND o.totalPrice < 20000", {"l": []}, "SELECT * FROM orders WHERE o_totalprice < 20000"),
    ("q_in_empty", False, "SELECT o FROM Order o WHERE o.orderStatus IN (:l) OR o.totalPrice < 20000", {"l": []}, "SELECT * FROM orders WHERE o_totalprice < 20000"),
    ("q_join_subselect", False, "SELECT c.custKey AS cust_key, s.n AS n FROM Customer c JOIN (SELECT o.custKey AS k, COUNT(o) AS n FROM Order o GROUP BY o.custKey) s ON s.k = c.custKey WHERE c.balance > 5000", {}, "SELECT c_custkey AS cust_key, n FROM customer JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) ON k = c_custkey WHERE c_acctbal > 5000"),
    ("q_join_table", False, "SELECT c.custKey AS cust_key, n.name AS nation FROM Customer c JOIN nation n ON n.nationKey = c.nationKey WHERE c.balance > 5000", {}, "SELECT c_custkey AS cust_key, n_name AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 5000"),
    ("q_order_by", False, "SELECT c FROM Customer c ORDER BY c.balance DESC, c.custKey", {}, "SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey"),
    ("q_native_positional", True, "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_totalprice BETWEEN ?1 AND ?2 AND o_orderpriority IN (?3) GROUP BY o_orderstatus", [50000.0, 150000.0, ["1-URGENT", "2-HIGH"]], "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 50000 AND 150000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY o_orderstatus"),
    ("q_native_join", True, "SELECT n_name, COUNT(*) AS n FROM customer \\n JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = :segment GROUP BY n_name;", {"segment": "MACHINERY"}, "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'MACHINERY' GROUP BY n_name"),
]


def _text(is_native: bool, text: str, args: Any) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        if not is_native:
            return objectql.run(spark, catalog(spark, folder), text, args)
        tables = ("orders", "customer", "nation")
        for table in tables:
            parquet(spark, folder, table).createOrReplaceTempView(table)
        try:
            return native.run(spark, text, args)  # analysed here, so the views have served
        finally:
            for table in tables:
                spark.catalog.dropTempView(table)

    return run


for _name, _native, _query, _args, _sql in _TEXTS:
    query(_name, _sql)(_text(_native, _query, _args))


@query("q_entity_rows", "SELECT r_regionkey AS id, r_regionkey AS \"regionKey\", r_name AS name FROM region")
def q_entity_rows(spark: SparkSession, folder: str) -> DataFrame:
    c = catalog(spark, folder)
    return entity_rows(c.frame("Region"), c.entity("Region"))


@query("q_optional", "SELECT o_orderkey FROM orders WHERE o_orderkey = 7")
def q_optional(spark: SparkSession, folder: str) -> DataFrame:
    return optional(derive(catalog(spark, folder), "Order", "findByOrderKey", 7))


# --- relaxation ------------------------------------------------------------------------------------------------------

_RELAX = "findByOrderStatusAndPriorityIsNotNullAndTotalPriceGreaterThan"


@query("x_relaxed", "SELECT * FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderstatus = 'P'")
def x_relaxed(spark: SparkSession, folder: str) -> DataFrame:
    return relax.relaxed(catalog(spark, folder), "Order", _RELAX, values={"orderStatus": ["P"]})[0]


@query("x_sample_args", 'SELECT o_orderstatus AS "orderStatus", o_totalprice AS "totalPrice" FROM orders WHERE o_orderpriority IS NOT NULL ORDER BY o_orderkey LIMIT 1')
def x_sample_args(spark: SparkSession, folder: str) -> DataFrame:
    return relax.sample_arguments(catalog(spark, folder), "Order", _RELAX, "orderKey")


@query("x_hit_miss", "SELECT 'present' AS path, least(count(*), 1) AS n FROM orders WHERE o_orderpriority IS NOT NULL UNION ALL SELECT 'empty', count(*) FROM orders WHERE false")
def x_hit_miss(spark: SparkSession, folder: str) -> DataFrame:
    return relax.hit_and_miss(catalog(spark, folder), "Order", _RELAX)


@query("x_keep", "SELECT * FROM orders WHERE o_orderpriority IS NOT NULL AND o_totalprice > 150000")
def x_keep(spark: SparkSession, folder: str) -> DataFrame:
    return relax.relaxed(catalog(spark, folder), "Order", _RELAX, keep=("totalPrice",), values={"totalPrice": [150000.0]})[0]


@query("x_or", "SELECT * FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 250000")
def x_or(spark: SparkSession, folder: str) -> DataFrame:
    return relax.relaxed(catalog(spark, folder), "Order", "findByOrderStatusOrTotalPriceGreaterThan", values={"orderStatus": ["P"], "totalPrice": [250000.0]})[0]


@query("x_between", "SELECT * FROM part WHERE p_size BETWEEN 5 AND 9")
def x_between(spark: SparkSession, folder: str) -> DataFrame:
    return relax.relaxed(catalog(spark, folder), "Part", "findByBrandInAndSizeBetween", values={"size": [5, 9]})[0]


@query("x_dropped", "SELECT * FROM (VALUES ('brand', 'in'), ('size', 'between')) t(prop, op)")
def x_dropped(spark: SparkSession, folder: str) -> DataFrame:
    dropped = relax.relaxed(catalog(spark, folder), "Part", "findByBrandInAndSizeBetween")[1]
    return spark.createDataFrame([(c.prop, c.op) for c in dropped], "prop string, op string")


# --- collection pipelines --------------------------------------------------------------------------------------------


def _events(spark: SparkSession, folder: str) -> Pipeline:
    return Pipeline(parquet(spark, folder, "events"), "event_type", "event_id")


def _sizes(spark: SparkSession, folder: str) -> Pipeline:
    return Pipeline(parquet(spark, folder, "part"), "p_size", "p_partkey")


#: name, query, SQL.
_PIPELINES: list[tuple[str, Query, str | None]] = [
    ("s_filter_map", lambda s, d: _events(s, d).filter(lambda v: v.startswith("c")).map(F.upper).rows(), "SELECT upper(event_type) AS value FROM events WHERE event_type LIKE 'c%'"),
    ("s_flat_map", lambda s, d: Pipeline(parquet(s, d, "customer"), "c_name", "c_custkey").flat_map(lambda v: F.split(v, "#")).rows(), "SELECT unnest(string_split(c_name, '#')) AS value FROM customer"),
    ("s_take_while", lambda s, d: _sizes(s, d).take_while(lambda v: v != 50).rows(), "SELECT p_size AS value FROM part WHERE p_partkey < coalesce((SELECT min(p_partkey) FROM part WHERE p_size = 50), 9e18)"),
    ("s_drop_while", lambda s, d: _sizes(s, d).drop_while(lambda v: v != 50).rows(), "SELECT p_size AS value FROM part WHERE p_partkey >= (SELECT min(p_partkey) FROM part WHERE p_size = 50)"),
    ("s_distinct_first", lambda s, d: _sizes(s, d).distinct().limit(10).rows(), "SELECT p_size AS value FROM (SELECT p_size, min(p_partkey) AS k FROM part GROUP BY p_size ORDER BY k LIMIT 10)"),
    ("s_peek", lambda s, d: _sizes(s, d).peek("seen").filter(lambda v: v > 45).rows(), "SELECT p_size AS value FROM part WHERE p_size > 45"),
    ("s_limit_skip", lambda s, d: _sizes(s, d).skip(5).limit(10).rows(), "SELECT p_size AS value FROM part ORDER BY p_partkey LIMIT 10 OFFSET 5"),
    ("s_find_first", lambda s, d: _events(s, d).filter(lambda v: v != "view").find_first(), "SELECT event_type AS value FROM events WHERE event_type <> 'view' ORDER BY event_id LIMIT 1"),
    ("s_any_match", lambda s, d: _sizes(s, d).any_match(lambda v: v > 49), "SELECT bool_or(p_size > 49) AS any FROM part"),
    ("s_any_match_none", lambda s, d: _sizes(s, d).any_match(lambda v: v > 1000), "SELECT bool_or(p_size > 1000) AS any FROM part"),
    ("s_all_match_yes", lambda s, d: _sizes(s, d).all_match(lambda v: v > 0), "SELECT bool_and(p_size > 0) AS all FROM part"),
    ("s_none_match_some", lambda s, d: _sizes(s, d).none_match(lambda v: v > 45), "SELECT NOT bool_or(p_size > 45) AS none FROM part"),
    ("s_sorted_desc_text", lambda s, d: _numbered(Pipeline(parquet(s, d, "part"), "p_name", "p_partkey").sorted(descending=True).limit(60).rows()), "SELECT CAST(row_number() OVER (ORDER BY p_name DESC, p_partkey) - 1 AS INTEGER) AS place, p_name AS value FROM part ORDER BY p_name DESC, p_partkey LIMIT 60"),
    ("s_skip", lambda s, d: _sizes(s, d).skip(100).rows(), "SELECT p_size AS value FROM part ORDER BY p_partkey OFFSET 100"),
    ("s_reduce_combined", lambda s, d: _events(s, d).reduce(lambda a, x: a + F.length(x), identity=0, combine=lambda a, b: a + b), "SELECT CAST(sum(length(event_type)) AS INTEGER) AS reduced FROM events"),
    ("s_partition_lists", lambda s, d: _sizes(s, d).partition_lists(lambda v: v > 25).select("side", F.array_join("values", ",").alias("values")), "SELECT p_size > 25 AS side, string_agg(p_size, ',' ORDER BY p_partkey) AS values FROM part GROUP BY 1"),
    ("s_all_match", lambda s, d: _sizes(s, d).all_match(lambda v: v > 1), "SELECT bool_and(p_size > 1) AS all FROM part"),
    ("s_none_match", lambda s, d: _sizes(s, d).filter(lambda v: v < 0).none_match(lambda v: v > 1), "SELECT true AS none"),
    ("s_min", lambda s, d: _events(s, d).min(F.length), "SELECT event_type AS min FROM events ORDER BY length(event_type), event_id LIMIT 1"),
    ("s_max", lambda s, d: _sizes(s, d).max(), "SELECT max(p_size) AS max FROM part"),
    ("s_max_tie", lambda s, d: _events(s, d).max(F.length), "SELECT event_type AS max FROM events ORDER BY length(event_type) DESC, event_id DESC LIMIT 1"),
    ("s_count", lambda s, d: _events(s, d).count(), "SELECT count(*) AS count FROM events"),
    ("s_to_set", lambda s, d: _events(s, d).to_set().select(F.array_join("set", ",").alias("set")), "SELECT string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS set FROM events"),
    ("s_group_count", lambda s, d: _events(s, d).group_count(lambda v: v), "SELECT event_type AS group, count(*) AS count FROM events GROUP BY event_type"),
    ("s_partition_by", lambda s, d: _sizes(s, d).partition_by(lambda v: v > 1000), "SELECT false AS side, count(*) AS count FROM part WHERE NOT p_size > 1000 UNION ALL SELECT true, count(*) FROM part WHERE p_size > 1000"),
    ("s_num_sum", lambda s, d: _sizes(s, d).sum(), "SELECT CAST(sum(p_size) AS BIGINT) AS sum FROM part"),
    ("s_num_stats", lambda s, d: _sizes(s, d).summary(), "SELECT count(*) AS count, CAST(sum(p_size) AS BIGINT) AS sum, min(p_size) AS min, max(p_size) AS max, avg(p_size) AS average FROM part"),
    ("s_num_average_empty", lambda s, d: _sizes(s, d).filter(lambda v: v < 0).average(), "SELECT CAST(NULL AS DOUBLE) AS average"),
    ("s_num_casts", lambda s, d: Pipeline(parquet(s, d, "part"), "p_retailprice", "p_partkey").cast("int").cast("bigint").rows(), "SELECT CAST(trunc(p_retailprice) AS BIGINT) AS value FROM part"),
    ("s_sorted", lambda s, d: _sizes(s, d).sorted().rows(), "SELECT p_size AS value FROM part ORDER BY p_size"),
    ("s_sorted_by", lambda s, d: _sizes(s, d).sorted(lambda v: v % 7, descending=True).rows(), "SELECT p_size AS value FROM part ORDER BY p_size % 7 DESC, p_partkey"),
    ("s_to_list", lambda s, d: _sizes(s, d).to_list().select(F.array_join("list", ",").alias("list")), "SELECT string_agg(p_size, ',' ORDER BY p_partkey) AS list FROM part"),
    ("s_reduce", lambda s, d: _sizes(s, d).reduce(lambda a, x: F.greatest(a, x) - F.least(a, x) % 3), None),  # a recursive query is slow; tested by a loop
    ("s_fold_text", lambda s, d: _events(s, d).reduce(lambda a, x: F.concat(a, F.substring(x, 1, 1)), identity="", combine=F.concat), "SELECT string_agg(substr(event_type, 1, 1), '' ORDER BY event_id) AS reduced FROM events"),
    ("s_collect_fold", lambda s, d: _sizes(s, d).collect(F.lit(0), lambda a, x: a + x), "SELECT CAST(sum(p_size) AS INTEGER) AS collected FROM part"),
    ("s_group_by", lambda s, d: _sizes(s, d).group_by(lambda v: v % 5).select("group", F.array_join("values", ",").alias("values")), "SELECT p_size % 5 AS group, string_agg(p_size, ',' ORDER BY p_partkey) AS values FROM part GROUP BY 1"),
    ("s_range", lambda s, d: Pipeline.range(s, 3, parquet(s, d, "part").count()).map(lambda v: v % 7 * v).rows(), "SELECT CAST(x % 7 * x AS INTEGER) AS value FROM range(3, (SELECT count(*) FROM part)) t(x)"),
]
for _name, _run, _sql in _PIPELINES:
    query(_name, _sql)(_run)


# --- scalar expressions ----------------------------------------------------------------------------------------------

#: Small numbers of both signs, zeros and nulls, and short texts, from every part: in both engines' SQL.
_A = "CAST(nullif(p_partkey % 19 - 9, 4) AS INT)"
_B = "CAST(nullif(p_size % 7 - 3, 2) AS INT)"
_S = "CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN CAST(p_size AS VARCHAR(9)) ELSE substr(p_name, 1, CAST(p_partkey % 4 AS INT)) END"
_PAIRS = f"SELECT p_partkey, {_A} AS a, {_B} AS b, {_S} AS s FROM part"


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return parquet(spark, folder, "part").selectExpr("p_partkey", f"{_A} AS a", f"{_B} AS b", f"{_S} AS s")


@query("e_null_safe_eq", f"SELECT a, b, a IS NOT DISTINCT FROM b AS eq, a IS DISTINCT FROM b AS ne FROM ({_PAIRS}) t")
def e_null_safe_eq(spark: SparkSession, folder: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, folder).select("a", "b", scalar.equal(a, b).alias("eq"), scalar.not_equal(a, b).alias("ne"))


@query("e_truthy_logic", f"SELECT a, b, coalesce(a > 0, false) AND coalesce(b > 0, false) AS both, coalesce(a > 0, false) OR coalesce(b > 0, false) AS either, NOT coalesce(a > 0, false) AS neg FROM ({_PAIRS}) t")
def e_truthy_logic(spark: SparkSession, folder: str) -> DataFrame:
    a, b = F.col("a") > 0, F.col("b") > 0
    return _pairs(spark, folder).select("a", "b", scalar.both(a, b).alias("both"), scalar.either(a, b).alias("either"), scalar.negate(a).alias("neg"))


@query("e_int_arith", f"SELECT a, b, a + b AS plus, a - b AS minus, a * b AS times, CASE WHEN b <> 0 THEN a // b END AS quot, CASE WHEN b <> 0 THEN a % b END AS rest FROM ({_PAIRS}) t")
def e_int_arith(spark: SparkSession, folder: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, folder).select("a", "b", *[scalar.arith(op, a, b, ("int", "int")).alias(n) for op, n in (("+", "plus"), ("-", "minus"), ("*", "times"), ("/", "quot"), ("%", "rest"))])


@query("e_mixed_arith", "SELECT p_partkey, p_size * p_retailprice AS times, p_retailprice / p_size AS quot, p_size // 7 AS whole, p_size % 7 AS rest, -p_size AS neg, p_retailprice > p_size AS more FROM part")
def e_mixed_arith(spark: SparkSession, folder: str) -> DataFrame:
    df = parquet(spark, folder, "part")
    size, price, seven = F.col("p_size"), F.col("p_retailprice"), F.lit(7)
    return df.select("p_partkey", scalar.arith_in(df, "*", size, price).alias("times"), scalar.arith_in(df, "/", price, size).alias("quot"), scalar.arith_in(df, "/", size, seven).alias("whole"), scalar.arith_in(df, "%", size, seven).alias("rest"), scalar.minus(size).alias("neg"), scalar.ordered_in(df, ">", price, size).alias("more"))


@query("e_string_methods", "SELECT p_partkey, length(p_name) AS n, substr(p_name, 3, 3) AS part, upper(p_name) AS up, strpos(p_name, 'd') - 1 AS at, replace(p_name, 'old', 'new') AS changed, starts_with(p_name, 'old') AS starts, lower(p_brand) = 'brand#11' AS same, substr(p_name, 1, 1) AS first FROM part")
def e_string_methods(spark: SparkSession, folder: str) -> DataFrame:
    s, c = F.col("p_name"), lambda name, *args: library.call("String", name, *args)
    columns = {"n": c("length", s).cast("long"), "part": c("substring", s, 2, 5), "up": c("toUpperCase", s), "at": c("indexOf", s, "d").cast("long"), "changed": c("replace", s, "old", "new"), "starts": c("startsWith", s, "old"), "same": c("equalsIgnoreCase", F.col("p_brand"), "BRAND#11"), "first": c("charAt", s, 0)}
    return parquet(spark, folder, "part").select("p_partkey", *[x.alias(n) for n, x in columns.items()])


@query("e_math_dates", "SELECT o_orderkey, CAST(floor(o_totalprice + 0.5) AS BIGINT) AS rounded, floor(o_totalprice / 1000) AS low, greatest(o_totalprice, 100000) AS high, CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS due, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(o_orderdate AS DATE) < DATE '1996-01-01' AS early FROM orders")
def e_math_dates(spark: SparkSession, folder: str) -> DataFrame:
    price, day = F.col("o_totalprice"), F.to_date("o_orderdate")
    math, date = (lambda name, *args: library.call("Math", name, *args)), (lambda name, *args: library.call("LocalDate", name, *args))
    columns = {"rounded": math("round", price), "low": math("floor", price / 1000), "high": math("max", price, 100000.0), "due": date("plusDays", day, 30), "y": date("getYear", day), "early": date("isBefore", day, date("of", 1996, 1, 1))}
    return parquet(spark, folder, "orders").select("o_orderkey", *[x.alias(n) for n, x in columns.items()])


@query("e_optional_instance", f"SELECT a, coalesce(a, -1) AS value, a IS NOT NULL AS present, a IS NOT NULL AS whole, false AS text FROM ({_PAIRS}) t")
def e_optional_instance(spark: SparkSession, folder: str) -> DataFrame:
    a = F.col("a")
    return _pairs(spark, folder).select("a", library.call("Optional", "orElse", a, -1).alias("value"), library.call("Optional", "isPresent", a).alias("present"), scalar.instance_of(a, "int").alias("whole"), scalar.instance_of(a, "string").alias("text"))


@query("e_concat_null", f"SELECT coalesce(s, 'null') || coalesce(CAST(a AS VARCHAR), 'null') AS joined FROM ({_PAIRS}) t")
def e_concat_null(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select(scalar.concat(F.col("s"), F.col("a")).alias("joined"))


@query("e_compare", f"SELECT a, b, CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN a < b THEN -1 WHEN a > b THEN 1 WHEN a = b THEN 0 END AS sign FROM ({_PAIRS}) t")
def e_compare(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select("a", "b", scalar.compare(F.col("a"), F.col("b")).alias("sign"))


@query("e_ternary_item", f"SELECT a, CASE WHEN coalesce(a > 1, false) THEN 'yes' ELSE 'no' END AS choice, CASE WHEN a = 1 THEN 20 END AS item FROM ({_PAIRS}) t")
def e_ternary_item(spark: SparkSession, folder: str) -> DataFrame:
    array = F.array(F.lit(10), F.lit(20))
    at = F.when(F.col("a") == 1, F.lit(1)).otherwise(F.lit(9))
    return _pairs(spark, folder).select("a", scalar.choose(F.col("a") > 1, F.lit("yes"), F.lit("no")).alias("choice"), scalar.item(array, at).alias("item"))


@query("e_empty_parse", f"SELECT s, coalesce(length(s) = 0, true) AS empty, try_cast(s AS INTEGER) IS NOT NULL AS number FROM ({_PAIRS}) t")
def e_empty_parse(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select("s", scalar.is_empty(F.col("s"), "string").alias("empty"), scalar.parses_as(F.col("s"), "int").alias("number"))


_CAMEL = "concat('part', upper(substr(p_name, 1, 1)), substr(p_name, 2, 3), CASE p_size % 3 WHEN 0 THEN 'ID' WHEN 1 THEN '2Line' ELSE 'TotalPrice' END)"
_NAMES = f"SELECT p_partkey, {_CAMEL} AS name FROM part"


@query("e_snake_case", f"SELECT name, lower(regexp_replace(name, '([a-z])([A-Z]+)', '\\1_\\2', 'g')) AS snake, lower(regexp_replace(name, '([A-Z])', '_\\1', 'g')) AS each FROM ({_NAMES}) t")
def e_snake_case(spark: SparkSession, folder: str) -> DataFrame:
    names = parquet(spark, folder, "part").selectExpr(f"{_CAMEL} AS name")
    return names.select("name", naming.snake_column(F.col("name")).alias("snake"), naming.snake_each_column(F.col("name")).alias("each"))


# --- truth tables ----------------------------------------------------------------------------------------------------


def _counts(df: DataFrame) -> DataFrame:
    return df.groupBy("result").agg(F.count(F.lit(1)).alias("n"))


#: Variables of conditions as columns of part: digits of its size and key, texts and lists by remainders, in both engines' SQL.
_DIGITS = {"a": "p_size", "b": "p_partkey", "c": "p_size // 10", "d": "p_partkey // 10"}
_CASES = {
    "name": "CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'T' END",
    "letter": "CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'b' ELSE 'c' END",
    "letter or null": "CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'x' WHEN 2 THEN NULL ELSE 'y' END",
    "age": "16 + p_size % 5",
    "status": "CASE WHEN p_size % 2 = 0 THEN 'Status.OPEN' ELSE 'Status.OTHER' END",
}


def _digits_sql(n: int, names: str) -> str:
    """Part with digits to the base n as variables."""
    return "(SELECT p_partkey, " + ", ".join(f"({_DIGITS[x]}) % {n} AS {x}" for x in names) + " FROM part)"


def _located(spark: SparkSession, folder: str, table: DataFrame, base: int = 0, **cases: str) -> DataFrame:
    """Parts with the row of a truth table that each falls in; variables are digits to a base or cases."""
    bindings = {x: F.expr(f"CAST(({_DIGITS[x]}) % {base} AS INT)".replace("//", "div")) for x in table.columns if base and x in _DIGITS}
    bindings |= {x: F.expr(_CASES[c]) for x, c in cases.items()}
    return truth.located(table, parquet(spark, folder, "part").select("p_partkey", "p_size"), bindings)


@query("b_truth_ineq", f"SELECT a > b AND c = d AS result, count(*) AS n FROM {_digits_sql(4, 'abcd')} GROUP BY 1")
def b_truth_ineq(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(_located(spark, folder, truth.table(spark, "a > b && c == d", width=4), 4))


@query("b_truth_chain", f"SELECT a >= b AND b >= c AS result, count(*) AS n FROM {_digits_sql(3, 'abc')} GROUP BY 1")
def b_truth_chain(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(_located(spark, folder, truth.table(spark, "a >= b && b >= c"), 3))


@query("b_truth_strict", f"SELECT p_partkey, a, b, c FROM {_digits_sql(3, 'abc')} WHERE a > b AND b > c")
def b_truth_strict(spark: SparkSession, folder: str) -> DataFrame:
    found = _located(spark, folder, truth.satisfying(truth.table(spark, "a > b && b > c")), 3)
    return found.select("p_partkey", *[F.col(x).cast("long").alias(x) for x in "abc"])


@query("b_truth_mixed", f"SELECT a > b AND b < c AS result, count(*) AS n FROM {_digits_sql(3, 'abc')} GROUP BY 1")
def b_truth_mixed(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(_located(spark, folder, truth.table(spark, "a > b && b < c"), 3))


@query("b_truth_null", f"SELECT p_partkey, a IS NULL AS result FROM (SELECT p_partkey, {_CASES['name']} AS a FROM part)")
def b_truth_null(spark: SparkSession, folder: str) -> DataFrame:
    return _located(spark, folder, truth.table(spark, "a == null"), a="name").select("p_partkey", "result")


@query("b_constrained", f"SELECT p_partkey, a > b AS result FROM {_digits_sql(6, 'ab')} WHERE a >= 2 AND a <> b")
def b_constrained(spark: SparkSession, folder: str) -> DataFrame:
    """Parts outside the constraints are in no row of the table."""
    return _located(spark, folder, truth.table(spark, "a > b", constraints=["a >= 2", "a != b"], width=6), 6).select("p_partkey", "result")


@query("b_truth_equals", f"SELECT p_partkey, a = 'b' AS result FROM (SELECT p_partkey, {_CASES['letter']} AS a FROM part) WHERE a <> 'c'")
def b_truth_equals(spark: SparkSession, folder: str) -> DataFrame:
    return _located(spark, folder, truth.table(spark, 'a.equals("b")'), a="letter").select("p_partkey", "result")


@query("b_truth_calls", f"SELECT p_partkey, n IS NOT NULL AND age > 18 AS result FROM (SELECT p_partkey, {_CASES['name']} AS n, {_CASES['age']} AS age FROM part) WHERE age BETWEEN 17 AND 19")
def b_truth_calls(spark: SparkSession, folder: str) -> DataFrame:
    table = truth.table(spark, "person.getName() != null && person.age > 18L")
    return _located(spark, folder, table, **{"person.getName()": "name", "person.age": "age"}).select("p_partkey", "result")


@query("b_truth_null_or", f"SELECT p_partkey, a IS NULL OR a = 'x' AS result FROM (SELECT p_partkey, {_CASES['letter or null']} AS a FROM part) WHERE a IS NULL OR a <> 'y'")
def b_truth_null_or(spark: SparkSession, folder: str) -> DataFrame:
    return _located(spark, folder, truth.table(spark, 'a == null || a == "x"'), a="letter or null").select("p_partkey", "result")


@query("b_truth_enum_list", f"SELECT p_partkey, s = 'Status.OPEN' AND filled AS result FROM (SELECT p_partkey, {_CASES['status']} AS s, p_size % 3 > 0 AS filled FROM part)")
def b_truth_enum_list(spark: SparkSession, folder: str) -> DataFrame:
    table = truth.table(spark, "status == Status.OPEN && !items.isEmpty()")
    items = F.when(F.col("p_size") % 3 > 0, F.array(F.lit("T"))).otherwise(F.array().cast("array<string>"))
    rows = parquet(spark, folder, "part").select("p_partkey", "p_size")
    return truth.located(table, rows, {"status": F.expr(_CASES["status"]), "items": items}).select("p_partkey", "result")


@query("b_truth_arith", f"SELECT a + 1 > b * 2 AS result, count(*) AS n FROM {_digits_sql(4, 'ab')} GROUP BY 1")
def b_truth_arith(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(_located(spark, folder, truth.table(spark, "a + 1 > b * 2", width=4), 4))


#: Fingerprints of paths that parts stand for; large parts are of paths that are not asked for.
_TRIED = "concat('left=', CASE p_size % 3 WHEN 0 THEN 'T' ELSE 'F' END, '|right=', CASE WHEN p_size > 25 THEN 'X' WHEN p_size % 2 = 0 THEN 'T' ELSE 'F' END)"


@query("b_path_states_reused", f"SELECT 'left=' || l || '|right=T' AS fingerprint, l AS left, 'T' AS right FROM (VALUES ('T'), ('F')) t(l) WHERE 'left=' || l || '|right=T' IN (SELECT {_TRIED} FROM part) ORDER BY fingerprint LIMIT 1")
def b_path_states_reused(spark: SparkSession, folder: str) -> DataFrame:
    """Paths that parts have tried, once all that are asked for are: the first is given again."""
    tried = parquet(spark, folder, "part").selectExpr(f"{_TRIED} AS fingerprint").distinct()
    return truth.path_states(spark, {"left": ["T", "F"], "right": ["T"]}, tried, reuse=True)


#: Branches made of customers' orders: a state by the orders' number, children by their greatest key.
_BRANCHES = "SELECT concat('b', o_custkey) AS branch, CASE count(*) % 4 WHEN 0 THEN 'BOTH' WHEN 1 THEN 'TRUE' WHEN 2 THEN 'FALSE' ELSE 'UNTRAVELLED' END AS state, CAST(max(o_orderkey) % 5 AS INT) AS n_children FROM orders GROUP BY o_custkey"


@query("b_branch_order", f"SELECT row_number() OVER (ORDER BY state = 'BOTH', n_children, CASE state WHEN 'FALSE' THEN 1 WHEN 'TRUE' THEN 2 WHEN 'UNTRAVELLED' THEN 3 ELSE 4 END, branch) AS number, branch, state FROM ({_BRANCHES}) t")
def b_branch_order(spark: SparkSession, folder: str) -> DataFrame:
    orders = parquet(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("k"))
    state = F.when(F.col("n") % 4 == 0, "BOTH").when(F.col("n") % 4 == 1, "TRUE").when(F.col("n") % 4 == 2, "FALSE").otherwise("UNTRAVELLED")
    branches = orders.select(F.concat(F.lit("b"), F.col("o_custkey")).alias("branch"), state.alias("state"), (F.col("k") % 5).cast("int").alias("n_children"))
    return number_rows(branches.withColumns(truth.branch_rank()), [], [*truth.branch_rank(), "branch"]).select("number", "branch", "state")


@query("b_first", f"SELECT p_partkey, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b FROM {_digits_sql(2, 'ab')} WHERE a = 1 AND b = 0")
def b_first(spark: SparkSession, folder: str) -> DataFrame:
    """Parts that fall in the first row that satisfies the condition."""
    return _located(spark, folder, truth.first_satisfying(truth.table(spark, "a > b")), 2).select("p_partkey", "a", "b")


@query("b_path_states", f"SELECT * FROM (SELECT 'left=' || l || '|right=' || r AS fingerprint, l AS left, r AS right FROM (VALUES ('T'), ('F'), ('N')) x(l), (VALUES ('T'), ('F')) y(r)) WHERE fingerprint NOT IN (SELECT {_TRIED} FROM part)")
def b_path_states(spark: SparkSession, folder: str) -> DataFrame:
    """Paths that no part has tried."""
    tried = parquet(spark, folder, "part").selectExpr(f"{_TRIED} AS fingerprint").distinct()
    return truth.path_states(spark, {"left": ["T", "F", "N"], "right": ["T", "F"]}, tried)


# --- graphs ----------------------------------------------------------------------------------------------------------

#: Kind of the edge to a user's event, by its type (the kinds that weights know).
_KIND = "CASE {} WHEN 'view' THEN 'FIELD' WHEN 'click' THEN 'SETTER' WHEN 'purchase' THEN 'CONSTRUCTOR' ELSE 'BEAN_METHOD' END"
_FOLLOWING = "SELECT user_id, event_type, ts, lead(user_id) OVER o AS next_user, lead(event_type) OVER o AS next_type, lead(ts) OVER o AS next_ts FROM events WINDOW o AS (ORDER BY ts, event_id)"
#: Users of whom one's event follows the other's at once: within a sixtieth of the mean time between events, so that a user has about one edge.
_EDGES = f"SELECT DISTINCT 'u' || user_id AS src, 'u' || next_user AS dst, {_KIND.format('next_type')} AS kind FROM ({_FOLLOWING}) WHERE epoch_us(next_ts) - epoch_us(ts) <= (SELECT (max(epoch_us(ts)) - min(epoch_us(ts))) // count(*) // 60 FROM events)"
#: Event types that follow each other.
_TYPES = f"SELECT DISTINCT event_type AS src, next_type AS dst, {_KIND.format('next_type')} AS kind FROM ({_FOLLOWING}) WHERE next_type IS NOT NULL"
_PATHS = f"WITH RECURSIVE e AS (SELECT * FROM ({_EDGES}) t(src, dst, kind)), p AS (SELECT src, dst FROM e UNION SELECT p.src, e.dst FROM p JOIN e ON p.dst = e.src)"


def _following(spark: SparkSession, folder: str) -> DataFrame:
    """Every event with the one that follows it: events are numbered over ranges of time, so that no task holds them all."""
    events = parquet(spark, folder, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    numbered = number_rows(events, [], ["at", "event_id"])
    after = numbered.select((F.col("number") - 1).alias("before"), F.col("user_id").alias("next_user"), F.col("event_type").alias("next_type"), F.col("at").alias("next_at"))
    return numbered.join(after, F.col("number") == F.col("before"))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    gap = parquet(spark, folder, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).agg(F.expr("(max(at) - min(at)) div count(*) div 60"))
    near = _following(spark, folder).where(F.col("next_at") - F.col("at") <= gap.scalar())
    return cut(near.selectExpr("concat('u', user_id) AS src", "concat('u', next_user) AS dst", f"{_KIND.format('next_type')} AS kind").distinct())


def _types(spark: SparkSession, folder: str) -> DataFrame:
    return cut(_following(spark, folder).selectExpr("event_type AS src", "next_type AS dst", f"{_KIND.format('next_type')} AS kind").distinct())


@query("g_reachable", f"{_PATHS} SELECT DISTINCT node FROM (SELECT 'u1' AS node UNION SELECT dst FROM p WHERE src = 'u1')")
def g_reachable(spark: SparkSession, folder: str) -> DataFrame:
    return graph.reachable(_edges(spark, folder), spark.createDataFrame([("u1",)], "node string"))


@query("g_reachable_without", f"{_PATHS} SELECT DISTINCT node FROM (SELECT 'u1' AS node UNION SELECT dst FROM p WHERE src = 'u1') WHERE node NOT IN ('u3', 'u7')")
def g_reachable_without(spark: SparkSession, folder: str) -> DataFrame:
    one = lambda *x: spark.createDataFrame([(v,) for v in x], "node string")
    return graph.reachable_without(_edges(spark, folder), one("u1"), one("u3", "u7"))


@query("g_closure", f"{_PATHS} SELECT src, dst FROM p")
def g_closure(spark: SparkSession, folder: str) -> DataFrame:
    return graph.closure(_edges(spark, folder))


@query("g_scc", f"{_PATHS}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT node, least(node, coalesce((SELECT min(a.dst) FROM p a JOIN p b ON a.src = b.dst AND a.dst = b.src WHERE a.src = node), node)) AS component FROM n")
def g_scc(spark: SparkSession, folder: str) -> DataFrame:
    return graph.strong_components(_edges(spark, folder))


_SCC = "m AS (SELECT a.src AS node, least(a.src, min(a.dst)) AS component FROM p a JOIN p b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src)"


@query("g_has_cycles", f"{_PATHS}, {_SCC} SELECT count(*) > 0 AS has_cycles, count(DISTINCT component) AS n_groups FROM m")
def g_has_cycles(spark: SparkSession, folder: str) -> DataFrame:
    return graph.has_cycles(_edges(spark, folder))


_CYCLES = f"WITH RECURSIVE e AS (SELECT * FROM ({_TYPES}) t(src, dst, kind)), w AS (SELECT src AS s, dst AS cur, [src, dst] AS path FROM e WHERE dst > src UNION ALL SELECT s, e.dst, list_append(path, e.dst) FROM w JOIN e ON cur = e.src WHERE e.dst > s AND NOT list_contains(path, e.dst)), cycles AS (SELECT path FROM w JOIN e ON cur = e.src AND e.dst = s)"


@query("g_cycles", f"{_CYCLES} SELECT array_to_string(path, '>') AS cycle FROM cycles")
def g_cycles(spark: SparkSession, folder: str) -> DataFrame:
    return graph.elementary_cycles(_types(spark, folder)).select(F.array_join("cycle", ">").alias("cycle"))


@query("g_in_degree", f"SELECT dst AS node, count(*) AS in_degree FROM ({_EDGES}) t(src, dst, kind) GROUP BY dst")
def g_in_degree(spark: SparkSession, folder: str) -> DataFrame:
    return graph.in_degrees(_edges(spark, folder))


@query("g_weights", f"WITH e AS (SELECT * FROM ({_EDGES}) t(src, dst, kind)) SELECT src, dst, kind, CASE kind WHEN 'FIELD' THEN 1.0::DOUBLE WHEN 'SETTER' THEN 2 WHEN 'CONSTRUCTOR' THEN 3 ELSE 4 END + 0.5::DOUBLE * (SELECT count(*) FROM e x WHERE x.dst = e.dst) AS weight FROM e")
def g_weights(spark: SparkSession, folder: str) -> DataFrame:
    return graph.edge_weights(_edges(spark, folder))


@query("g_edge_frequency", f"{_CYCLES}, steps AS (SELECT path, unnest(generate_series(1, len(path))) AS i FROM cycles) SELECT path[i] AS src, path[CASE WHEN i = len(path) THEN 1 ELSE i + 1 END] AS dst, count(*) AS n_cycles FROM steps GROUP BY 1, 2")
def g_edge_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return graph.edge_frequency(graph.elementary_cycles(_types(spark, folder)))


@query("g_greedy_cut")
def g_greedy_cut(spark: SparkSession, folder: str) -> DataFrame:
    return graph.greedy_cut(_types(spark, folder))


@query("g_build", f"SELECT DISTINCT src, dst, kind FROM ({_EDGES}) t(src, dst, kind) WHERE kind <> 'SETTER' AND (src <> dst OR kind = 'BEAN_METHOD')")
def g_build(spark: SparkSession, folder: str) -> DataFrame:
    return graph.dependency_edges(_edges(spark, folder).withColumn("lazy", F.col("kind") == "SETTER"))


#: Customers under their nations, nations under their regions.
_PARENTS = "SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"


@query("g_subclasses", f"WITH RECURSIVE p AS (SELECT * FROM ({_PARENTS}) t(src, dst)), d AS (SELECT src AS node FROM p WHERE dst = 'ASIA' UNION SELECT p.src FROM p JOIN d ON p.dst = d.node) SELECT node FROM d")
def g_subclasses(spark: SparkSession, folder: str) -> DataFrame:
    of = lambda name: parquet(spark, folder, name)
    low = of("customer").join(of("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("src"), F.col("n_name").alias("dst"))
    high = of("nation").join(of("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"))
    return graph.subclasses(low.unionByName(high), "ASIA")


#: Parts as members: of an odd size fields, else methods; their brand is the type.
_MEMBER_COLUMNS = ("p_name AS method", "CASE WHEN p_size % 2 = 1 THEN 'field' ELSE 'method' END AS kind", "p_brand AS type")
_MEMBERS = f"SELECT {', '.join(_MEMBER_COLUMNS)} FROM part"


@query("g_references", f"SELECT DISTINCT method FROM ({_MEMBERS}) t(method, kind, type) WHERE kind = 'method' AND type = 'Brand#11'")
def g_references(spark: SparkSession, folder: str) -> DataFrame:
    return graph.references_to(parquet(spark, folder, "part").selectExpr(*_MEMBER_COLUMNS), "Brand#11")


@query("g_members", f"SELECT DISTINCT method AS name FROM ({_MEMBERS}) t(method, kind, type) WHERE kind = 'field'")
def g_members(spark: SparkSession, folder: str) -> DataFrame:
    return graph.members_of(parquet(spark, folder, "part").selectExpr(*_MEMBER_COLUMNS), "field")


#: Orders' priorities as methods, their customers as fields.
_FIELD_USES = "SELECT o_orderpriority, concat('c', o_custkey) FROM orders"


@query("g_fields_used", f"SELECT field, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM ({_FIELD_USES}) t(method, field) WHERE method IN ('1-URGENT', '2-HIGH') GROUP BY field")
def g_fields_used(spark: SparkSession, folder: str) -> DataFrame:
    used = graph.fields_used_by(parquet(spark, folder, "orders").selectExpr("o_orderpriority AS method", "concat('c', o_custkey) AS field"), "1-URGENT", "2-HIGH")
    return used.select("field", F.array_join("methods", ",").alias("methods"))


_PARAMETERS = "CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN '' ELSE replace(p_type, ' ', ',') END"


@query("g_signatures", f"SELECT p_partkey, CASE WHEN p IS NULL THEN p_brand || '.' || p_name ELSE p_brand || '#' || p_name || '(' || p || ')' END AS node FROM (SELECT *, {_PARAMETERS} AS p FROM part)")
def g_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as methods of their brand, the words of their type as parameters; some without any, some as fields."""
    words = F.when(F.col("p_size") % 5 == 0, F.lit(None)).when(F.col("p_size") % 5 == 1, F.array().cast("array<string>")).otherwise(F.split("p_type", " "))
    return parquet(spark, folder, "part").select("p_partkey", graph.signature(F.col("p_brand"), F.col("p_name"), words).alias("node"))


#: An edge's target is injected into a field of its source; all but plain fields are used at once.
_USAGES, _INJECTED = "SELECT src, 'f' || dst FROM e WHERE kind <> 'FIELD'", "SELECT src, 'f' || dst, dst FROM e"


@query("g_used_before_ready", f"{_PATHS}, {_SCC} SELECT DISTINCT bean, field, target FROM ({_USAGES}) u(bean, field) JOIN ({_INJECTED}) i(bean, field, target) USING (bean, field) WHERE bean IN (SELECT node FROM m)")
def g_used_before_ready(spark: SparkSession, folder: str) -> DataFrame:
    edges = _edges(spark, folder)
    usages = edges.where("kind <> 'FIELD'").selectExpr("src AS bean", "concat('f', dst) AS field")
    return graph.used_before_ready(usages, edges.selectExpr("src AS bean", "concat('f', dst) AS field", "dst AS target"), edges)


# --- report ----------------------------------------------------------------------------------------------------------

#: Orders as classes, their lines as methods.
_METHOD_PARTS = (
    "l_orderkey AS class",
    "CASE WHEN l_orderkey % 7 = 0 THEN 'SKIPPED' WHEN l_orderkey % 11 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS class_status",
    "l_linenumber AS method",
    "CASE WHEN l_returnflag = 'R' THEN 'FAILED' WHEN l_returnflag = 'N' AND l_linenumber = 3 THEN 'SKIPPED' ELSE 'SUCCESS' END AS status",
    "CAST(l_quantity AS INT) AS tests",
)
_METHODS = f"SELECT {', '.join(_METHOD_PARTS)} FROM lineitem"


def _report(spark: SparkSession, folder: str) -> DataFrame:
    return report.class_report(parquet(spark, folder, "lineitem").selectExpr(*_METHOD_PARTS))


@query("r_summary", f"WITH m AS (SELECT * FROM ({_METHODS}) t), c AS (SELECT class, bool_or(class_status = 'SKIPPED' OR status = 'SKIPPED') AS s, bool_or(class_status = 'FAILED' OR status = 'FAILED') AS f FROM m GROUP BY class) SELECT (SELECT count(*) FROM c) AS classes, (SELECT count(*) FROM c WHERE s) AS classes_skipped, (SELECT count(*) FROM c WHERE f) AS classes_failed, count(*) AS methods, count(*) FILTER (status = 'SUCCESS') AS methods_ok, count(*) FILTER (status = 'SKIPPED') AS methods_skipped, count(*) FILTER (status = 'FAILED') AS methods_failed, CAST(sum(tests) AS BIGINT) AS tests FROM m")
def r_summary(spark: SparkSession, folder: str) -> DataFrame:
    return report.summary(_report(spark, folder))


@query("r_json")
def r_json(spark: SparkSession, folder: str) -> DataFrame:
    return report.as_json(_report(spark, folder))


_VERSION = "concat(p_size % 3, '.', p_partkey % 23, '.', p_size)"
_VERSIONS = f"SELECT p_brand, {_VERSION} FROM part"


@query("r_version_max", f"SELECT artifact, arg_max(version, list_transform(string_split(version, '.'), lambda x: CAST(x AS INTEGER))) AS latest FROM ({_VERSIONS}) t(artifact, version) GROUP BY artifact")
def r_version_max(spark: SparkSession, folder: str) -> DataFrame:
    return report.latest_version(parquet(spark, folder, "part").selectExpr("p_brand AS artifact", f"{_VERSION} AS version"), "version", "artifact")
