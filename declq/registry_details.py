"""Queries of smaller features over whole tables: declared and rendered texts, actions of pipelines, literals, settings, sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from declq.checkpoint import scratch
from declq.functions import scalar
from declq.operators import pipeline
from declq.operators.pipeline import Pipeline
from declq.plans import native, render, truth
from declq.plans.derive import derive
from declq.plans.spec import QuerySpec
from declq.registry import catalog, query
from declq.sources import settings, tables
from declq.sources.tables import parquet


def _on_views(spark: SparkSession, folder: str, names: list[str], run: Callable[[], DataFrame]) -> DataFrame:
    """A native query with tables as views, which go once it is analysed."""
    tables.register_views(spark, folder, names)
    try:
        return run()
    finally:
        for name in names:
            spark.catalog.dropTempView(name)


# --- declared and rendered texts ---------------------------------------------------------------------------------------


@query("q_declared_native", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 150000 GROUP BY o_orderstatus")
def q_declared_native(spark: SparkSession, folder: str) -> DataFrame:
    """A declared query in pieces with a continuation line; its text tells that it is native."""
    spec = QuerySpec(["SELECT o_orderstatus, COUNT(*) AS n \\n ", "FROM orders WHERE o_totalprice > :low ", "GROUP BY o_orderstatus;"])
    return _on_views(spark, folder, ["orders"], lambda: spec.run(spark, catalog(spark, folder), {"low": 150000.0}))


@query("q_declared_object", "SELECT o_orderkey AS order_key, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 250000")
def q_declared_object(spark: SparkSession, folder: str) -> DataFrame:
    spec = QuerySpec(["SELECT o.orderKey AS order_key, c.name AS name ", "FROM Order o JOIN o.customer c WHERE o.totalPrice > ?1"])
    return spec.run(spark, catalog(spark, folder), [250000.0])


@query("d_longest_keyword", "SELECT * FROM customer WHERE c_acctbal <= 5000 AND c_mktsegment NOT IN ('BUILDING') AND c_name IS NOT NULL AND c_mktsegment NOT LIKE 'H%'")
def d_longest_keyword(spark: SparkSession, folder: str) -> DataFrame:
    """Of keywords that end alike (Equal, LessThanEqual; In, NotIn; NotNull, IsNotNull; Like, NotLike) the longest counts."""
    return derive(catalog(spark, folder), "Customer", "findByBalanceLessThanEqualAndSegmentNotInAndNameIsNotNullAndSegmentNotLike", 5000.0, ["BUILDING"], "H%")


@query("d_rendered_text", "SELECT * FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")
def d_rendered_text(spark: SparkSession, folder: str) -> DataFrame:
    """A method name as SQL text with numbered placeholders and a limit, run as a native query."""
    text = render.numbered(render.to_sql("findTop7ByOOrderstatusInAndOTotalpriceGreaterThanOrderByOTotalpriceDescOOrderkeyAsc", "orders"))
    return _on_views(spark, folder, ["orders"], lambda: native.run(spark, text, [["F", "P"], 100000.0]))


@query("d_rendered_count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'F' OR o_totalprice BETWEEN 1000 AND 50000")
def d_rendered_count(spark: SparkSession, folder: str) -> DataFrame:
    text = render.numbered(render.to_sql("countByOOrderstatusNotOrOTotalpriceBetween", "orders"))
    return _on_views(spark, folder, ["orders"], lambda: native.run(spark, text, ["F", 1000.0, 50000.0]).toDF("n"))


@query("e_dialect", "SELECT p_partkey, p_brand || '/' || p_type AS label FROM part WHERE p_size > 25")
def e_dialect(spark: SparkSession, folder: str) -> DataFrame:
    """A text with the concatenation and the booleans of a dialect."""
    words = render.DIALECTS["postgresql"]
    text = render.for_dialect(f"SELECT p_partkey, p_brand {words['concat']} '/' {words['concat']} p_type AS label FROM part WHERE (p_size > 25) = TRUE", "postgresql")
    return _on_views(spark, folder, ["part"], lambda: native.run(spark, text))


@query("q_tidied_text", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
def q_tidied_text(spark: SparkSession, folder: str) -> DataFrame:
    """A relaxed text without the conditions that are always true."""
    text = render.tidy("SELECT COUNT(*) AS n FROM orders WHERE '1' IN ('1') AND o_orderstatus = 'F' AND 1 = 1 AND o_totalprice > 1000 AND '2' IN '2'")
    return _on_views(spark, folder, ["orders"], lambda: native.run(spark, text))


# --- actions and custom operations of pipelines --------------------------------------------------------------------------


def _sizes(spark: SparkSession, folder: str) -> Pipeline:
    return Pipeline(parquet(spark, folder, "part"), "p_size", "p_partkey")


@query("s_for_each", "SELECT count(*) AS calls, CAST(sum(p_size) AS BIGINT) AS total FROM part")
def s_for_each(spark: SparkSession, folder: str) -> DataFrame:
    """An action on every value: here accumulators count its calls and add the values up."""
    calls, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def act(value: int) -> None:
        calls.add(1)
        total.add(value)

    _sizes(spark, folder).for_each(act)
    return spark.createDataFrame([(calls.value, total.value)], "calls long, total long")


@query("s_for_each_primitive", "SELECT CAST(sum(CAST(trunc(p_retailprice) AS BIGINT)) AS BIGINT) AS total FROM part")
def s_for_each_primitive(spark: SparkSession, folder: str) -> DataFrame:
    total = spark.sparkContext.accumulator(0)
    Pipeline(parquet(spark, folder, "part"), "p_retailprice", "p_partkey").cast("bigint").for_each(lambda v: total.add(v))
    return spark.createDataFrame([(total.value,)], "total long")


pipeline.register("multiples", lambda p, n: p.filter(lambda v: v % n == 0))
pipeline.register("spread", lambda p: p.df.agg((F.max(p.v) - F.min(p.v)).alias("spread")))


@query("s_custom_stage", "SELECT p_size AS value FROM part WHERE p_size % 7 = 0")
def s_custom_stage(spark: SparkSession, folder: str) -> DataFrame:
    return _sizes(spark, folder).apply("multiples", 7).rows()


@query("s_custom_result", "SELECT max(p_size) - min(p_size) AS spread FROM part WHERE p_size % 3 = 0")
def s_custom_result(spark: SparkSession, folder: str) -> DataFrame:
    return _sizes(spark, folder).apply("multiples", 3).apply("spread")


@query("s_boxed", "SELECT 'size ' || p_size AS value FROM part")
def s_boxed(spark: SparkSession, folder: str) -> DataFrame:
    """From a primitive stream to one of objects: the map's result keeps its type."""
    return _sizes(spark, folder).cast("int").boxed().map(lambda v: F.concat(F.lit("size "), v.cast("string"))).rows()


@query("s_narrowed", "SELECT CAST(trunc(p_size / 7) AS INTEGER) AS value FROM part")
def s_narrowed(spark: SparkSession, folder: str) -> DataFrame:
    """A map of a primitive stream is narrowed to the stream's own type."""
    return _sizes(spark, folder).cast("int").map(lambda v: v / 7).rows()


@query("s_find_any", "SELECT event_type AS value FROM events WHERE event_type = 'purchase' ORDER BY event_id LIMIT 1")
def s_find_any(spark: SparkSession, folder: str) -> DataFrame:
    return Pipeline(parquet(spark, folder, "events"), "event_type", "event_id").filter(lambda v: v == "purchase").find_any()


# --- literals, conditions, defaults ---------------------------------------------------------------------------------------


@query("e_literals", "SELECT p_partkey, true AS yes, p_size + 5 AS five, p_size + 1099511627776 AS large, p_size * 1.5::DOUBLE AS half, p_brand || 'x''y' AS quoted, coalesce(NULL, p_type) AS kept, DATE '2020-02-29' AS day FROM part")
def e_literals(spark: SparkSession, folder: str) -> DataFrame:
    size, lit = F.col("p_size"), scalar.literal
    columns = {"yes": lit(True), "five": size + lit(5), "large": size + lit(1 << 40), "half": size * lit(1.5), "quoted": F.concat("p_brand", lit("x'y")), "kept": F.coalesce(lit(None, "string"), F.col("p_type")), "day": lit("2020-02-29", "date")}
    return parquet(spark, folder, "part").select("p_partkey", *[c.alias(n) for n, c in columns.items()])


@query("e_long_precision", "SELECT o_orderkey, o_orderkey + 9007199254740993 AS plus, (o_orderkey + 9007199254740993) // 3 AS quot, (o_orderkey + 9007199254740993) % 1000 AS rest, (o_orderkey + 1) * 9007199254741 AS times FROM orders")
def e_long_precision(spark: SparkSession, folder: str) -> DataFrame:
    """Long arithmetic is exact beyond 2^53, and past 2^63 in decimals (o_orderkey from 1,023,999 on)."""
    orders, key, both = parquet(spark, folder, "orders"), F.col("o_orderkey"), ("bigint", "bigint")
    high = scalar.arith("+", key, F.lit((1 << 53) + 1), both)
    columns = {"plus": high, "quot": scalar.arith("/", high, F.lit(3), both), "rest": scalar.arith("%", high, F.lit(1000), both), "times": scalar.exact_in(orders, "*", key + 1, F.lit(9007199254741))}
    return orders.select("o_orderkey", *[c.alias(n) for n, c in columns.items()])


@query("e_negated", "SELECT p_partkey FROM part WHERE p_size <= 25 AND NOT (p_partkey > 10 AND p_retailprice < 1200)")
def e_negated(spark: SparkSession, folder: str) -> DataFrame:
    """The opposite of a comparison and of a conjunction, as filters."""
    part = parquet(spark, folder, "part")
    for text in ("p_size > 25", "p_partkey > 10 && p_retailprice < 1200"):
        part = part.where(truth.column(truth.negation(text)))
    return part.select("p_partkey")


@query("e_conjunction", "SELECT p_partkey FROM part WHERE p_size > 5 AND p_size < 45 AND p_retailprice > 950 AND p_brand <> 'Brand#11'")
def e_conjunction(spark: SparkSession, folder: str) -> DataFrame:
    """All of some conditions; none at all is true."""
    wanted = [F.col("p_size") > 5, F.col("p_size") < 45, F.col("p_retailprice") > 950, F.col("p_brand") != "Brand#11"]
    return parquet(spark, folder, "part").where(scalar.all_of(wanted)).where(scalar.all_of([])).select("p_partkey")


@query("e_defaults", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 0 ELSE p_size END AS size, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_name END AS name, CASE WHEN p_size % 2 = 0 THEN 0.0 ELSE p_retailprice END AS price, CASE WHEN p_size % 3 = 0 THEN 'sample' ELSE p_brand END AS brand FROM part")
def e_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """Values that are not set hold the default of their type; a sample differs from it."""
    part = parquet(spark, folder, "part")
    kind = {f.name: f.dataType for f in part.schema}
    unset = F.col("p_size") % 2 == 0
    or_default = lambda c: F.when(unset, scalar.default_value(kind[c])).otherwise(F.col(c))
    brand = F.when(F.col("p_size") % 3 == 0, F.lit(scalar.sample_value(kind["p_brand"]))).otherwise(F.col("p_brand"))
    return part.select("p_partkey", or_default("p_size").alias("size"), or_default("p_name").alias("name"), or_default("p_retailprice").alias("price"), brand.alias("brand"))


# --- settings, display, sinks -------------------------------------------------------------------------------------------

_SETTINGS = """
variables:
  floor: 200000
query:
  low: ${floor}
  states:
    - F
    - ${missing_name}P
  run: true
"""


@query("io_settings", "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_orderstatus IN ('F', 'P')")
def io_settings(spark: SparkSession, folder: str) -> DataFrame:
    """A query whose numbers and lists come from settings with variables."""
    wanted = settings.load(_SETTINGS)["query"]
    rows = derive(catalog(spark, folder), "Order", "findByTotalPriceGreaterThanAndOrderStatusIn", float(wanted["low"]), wanted["states"])
    return rows.where(F.lit(wanted["run"])).select("o_orderkey")


@query("io_head", "SELECT line FROM (SELECT -1 AS i, 'n_nationkey' || chr(9) || 'n_name' AS line UNION ALL SELECT * FROM (SELECT n_nationkey, n_nationkey || chr(9) || n_name FROM nation ORDER BY n_nationkey LIMIT 10))")
def io_head(spark: SparkSession, folder: str) -> DataFrame:
    """The display of a result: its header and first ten rows, tab separated."""
    text = tables.head(parquet(spark, folder, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name"))
    return spark.createDataFrame([(x,) for x in text.splitlines()], "line string")


@query("io_append", "SELECT * FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT * FROM orders WHERE o_totalprice > 250000")
def io_append(spark: SparkSession, folder: str) -> DataFrame:
    """Two results appended to one table, which is read again."""
    target = scratch(spark, "appended")
    orders = parquet(spark, folder, "orders")
    for rows in (orders.where("o_orderstatus = 'P'"), orders.where("o_totalprice > 250000")):
        tables.append(rows, target)
    return spark.read.parquet(target)


@query("io_json", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def io_json(spark: SparkSession, folder: str) -> DataFrame:
    """A table written as JSON lines and read again with its schema."""
    target = scratch(spark, "json")
    part = parquet(spark, folder, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    tables.write_json(part, target)
    return spark.read.schema(part.schema).json(target)


@query("io_cached", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'all', count(*) FROM orders")
def io_cached(spark: SparkSession, folder: str) -> DataFrame:
    """One cached result that two queries read."""
    cache: dict = {}
    orders = lambda: tables.cached(parquet(spark, folder, "orders").select("o_orderstatus"), cache, "orders")
    by_state = orders().groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return by_state.unionByName(orders().agg(F.lit("all").alias("o_orderstatus"), F.count(F.lit(1)).alias("n")))
