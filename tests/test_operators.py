"""Pipelines, scalar functions and sources where no SQL compares: errors, orders, folds, JDBC."""

import datetime as dt
import json
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from declq import registry, registry_details  # noqa: F401 - the second adds its queries to the first
from declq.functions import library, scalar
from declq.operators import graph, pipeline, report
from declq.operators.pipeline import Pipeline
from declq.plans.catalog import ConversionError
from declq.sources import tables
from tests.conftest import DATA


def stream(spark, values, kind):
    return Pipeline(spark.createDataFrame(list(enumerate(values)), f"k long, v {kind}").repartition(3), "v", "k")


@pytest.mark.parametrize("kind,values", [
    ("string", ["b", "", "a", "ab", "ba", "é", "ab", "~", "a~"]), ("long", [3, -(2**63), 2**63 - 1, 0, 3]), ("double", [1.5, -2.0, 0.0, 1e300]),
    ("boolean", [True, False, True]), ("date", [dt.date(2020, 1, 1), dt.date(1960, 5, 5), dt.date(2020, 1, 2)]), ("decimal(9,2)", [Decimal("2.50"), Decimal("-1.00"), Decimal("3.00")]),
    ("timestamp", [dt.datetime(2020, 1, 1), dt.datetime(1960, 1, 1, 5), dt.datetime(2020, 1, 1, 1)]), ("tinyint", [-128, 127, 0]),
])
def test_descending_order_of_every_type(spark, kind, values):
    got = [x.value for x in stream(spark, values, kind).sorted(descending=True).rows().collect()]
    key = (lambda x: x.encode()) if kind == "string" else (lambda x: x)
    assert got == sorted(values, key=key, reverse=True)


def test_skip_and_limit(spark):
    p = stream(spark, list(range(20)), "int")
    for n in (0, 1, 7, 20, 99):
        assert [x.value for x in p.skip(n).rows().collect()] == list(range(n, 20))
    assert [x.value for x in p.skip(5).limit(3).skip(1).rows().collect()] == [6, 7]
    assert "Exchange SinglePartition" not in p.skip(7).df._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_functions_of_the_wrong_kind(spark):
    p = stream(spark, [1, 2], "int")
    for call in (lambda: p.filter(lambda v: v + 1), lambda: p.filter("v"), lambda: p.map(lambda v: 3), lambda: p.map(None), lambda: p.sorted(lambda v: 1), lambda: p.any_match(lambda v: v), lambda: p.reduce(lambda a, x: a + x, combine=lambda a, b: a + b)):
        with pytest.raises(TypeError):
            call()
    with pytest.raises(KeyError):
        p.apply("no such operation")


def test_registered_operations(spark):
    from declq.operators import pipeline

    pipeline.register("every_second", lambda p: p.filter(lambda v: v % 2 == 0))
    assert [x.value for x in stream(spark, [1, 2, 3, 4], "int").apply("every_second").rows().collect()] == [2, 4]


def test_primitive_streams_narrow(spark):
    p = stream(spark, [1.9, -1.9], "double").cast("int")
    assert [x.value for x in p.map(lambda v: v * 2.6).rows().collect()] == [2, -2]
    assert [x.value for x in p.map_to_obj(lambda v: v * 2.5).rows().collect()] == [2.5, -2.5]
    assert [x.value for x in p.map_to_obj(F.abs).map(lambda v: F.concat(F.lit("n"), v)).rows().collect()] == ["n1", "n1"]


def test_folds(spark):
    values = [5, 3, 8, 1, 9, 2]
    p = stream(spark, values, "int")
    assert p.reduce(lambda a, x: F.concat(a, x.cast("string")), identity="", combine=F.concat).first().reduced == "538192"
    assert stream(spark, [], "int").reduce(lambda a, x: a + x, identity=7, combine=lambda a, b: a + b).first().reduced == 7
    assert stream(spark, [], "int").reduce(lambda a, x: a + x).first().reduced is None
    assert {x.side: x["values"] for x in p.partition_lists(lambda v: v > 100).collect()} == {False: values, True: []}
    assert {x.side: x["count"] for x in p.partition_by(lambda v: v > 4).collect()} == {False: 3, True: 3}


def test_for_each_and_observed(spark):
    seen = spark.sparkContext.accumulator(0)
    stream(spark, [1, 2, 3], "int").for_each(lambda v: seen.add(v))
    assert seen.value == 6


def test_report_json(spark):
    rows = [("A", "SUCCESS", "m1", "SUCCESS", 3), ("A", "SUCCESS", "m2", "FAILED", 0), ("B", "SKIPPED", "m3", "SUCCESS", 1), ("C", "SUCCESS", "m4", "SKIPPED", 0), ("C", "SUCCESS", "m5", "SUCCESS", 2)]
    df = spark.createDataFrame(rows, "class string, class_status string, method string, status string, tests int")
    got = [json.loads(x.json) for x in report.as_json(report.class_report(df)).collect()]
    assert sorted((x["class"], x["status"], [(m["method"], m["status"], m["tests"]) for m in x["methods"]]) for x in got) == [
        ("A", "SUCCESS", [("m1", "SUCCESS", 3), ("m2", "FAILED", 0)]), ("B", "SKIPPED", [("m3", "SUCCESS", 1)]), ("C", "SUCCESS", [("m4", "SKIPPED", 0), ("m5", "SUCCESS", 2)]),
    ]
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert sum(len(json.loads(x.json)["methods"]) for x in registry.QUERIES["r_json"](spark, DATA).collect()) == lines


def test_greedy_cut_is_brute_force(spark):
    """Step by step with sets: the edge with most cycles per weight, ties by name."""
    cycles = [x.cycle.split(">") for x in registry.QUERIES["g_cycles"](spark, DATA).collect()]
    weights = {}
    for x in graph.edge_weights(registry._types(spark, DATA)).collect():
        weights[x.src, x.dst] = min(x.weight, weights.get((x.src, x.dst), 99))
    left, chosen = [set(zip(c, c[1:] + c[:1])) for c in cycles], []
    while left:
        count = Counter(e for c in left for e in c)
        best = min(count, key=lambda e: (-count[e] / weights[e], e))
        chosen.append(best)
        left = [c for c in left if best not in c]
    got = sorted(registry.QUERIES["g_greedy_cut"](spark, DATA).collect())
    assert [(x.src, x.dst) for x in got] == chosen and chosen


def test_whole_numbers_are_exact_past_the_range_of_longs(spark, tmp_path):
    exact = lambda df, op: [x.v for x in df.select(scalar.exact_in(df, op, F.col("a"), F.col("b")).alias("v")).collect()]
    low, high = -(2**63), 2**63 - 1
    df = spark.createDataFrame([(low, low), (high, low), (high, high), (0, 5), (None, 1)], "a long, b long")
    assert exact(df, "*") == [low * low, high * low, high * high, 0, None] and exact(df, "+") == [2 * low, -1, 2 * high, 5, None]
    assert df.select(scalar.exact_in(df.where("a = 0"), "-", F.col("a"), F.col("b"))).dtypes[0][1] == "bigint"
    keys = [0, 1024020, 8999999]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {x.o_orderkey: x for x in registry.QUERIES["e_long_precision"](spark, str(tmp_path)).collect()}
    assert {k: int(x.times) for k, x in got.items()} == {k: (k + 1) * 9007199254741 for k in keys}
    assert {k: x.plus for k, x in got.items()} == {k: k + 2**53 + 1 for k in keys}


def test_numbers_only(spark):
    df = spark.createDataFrame([(1, "x", 2.5)], "i int, s string, d double")
    with pytest.raises(TypeError):
        scalar.arith_in(df, "+", F.col("i"), F.col("s"))
    with pytest.raises(TypeError):
        scalar.ordered_in(df, "<", F.col("s"), F.col("i"))
    row = df.select(scalar.arith_in(df, "/", F.col("d"), F.col("i")).alias("a"), scalar.minus(F.lit(-(2**31)).cast("int")).alias("b"), scalar.literal(None, "int").alias("c"), scalar.sample_value(df.schema["s"].dataType) and F.lit(1).alias("d"), scalar.default_value(df.schema["i"].dataType).alias("e")).first()
    assert (row.a, row.b, row.c, row.e) == (2.5, None, None, 0)
    with pytest.raises(ConversionError):
        library.call("String", "codePoints", F.col("s"))
    assert df.select(library.call("String", "substring", F.col("s"), 0, 5).alias("x")).first().x is None


def test_prepared_statements():
    sql = tables.prepared("SELECT * FROM t WHERE a = ?1 AND b IN (?2) AND c = ':x' AND d < ?3;", ["it's", [1, 2.5], dt.date(2020, 1, 2)])
    assert sql == "SELECT * FROM t WHERE a = 'it''s' AND b IN (1, 2.5) AND c = ':x' AND d < DATE '2020-01-02'"
    for text, args in (("DELETE FROM t", []), ("", []), ("SELECT 1 WHERE a NOT IN (:l)", {"l": []}), ("SELECT :o", {"o": object()})):
        with pytest.raises(ConversionError):
            tables.prepared(text, args)


def test_jdbc_query_runs_in_the_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = "org.apache.derby.jdbc.EmbeddedDriver"
    try:
        spark.range(10).selectExpr("id", "cast(id % 3 as int) as kind").write.jdbc(url, "APP.ITEMS", properties={"driver": driver})
    except Exception as e:  # no driver in this installation
        pytest.skip(str(e)[:80])
    database = {"url": url, "driver": driver, "schema": "APP", "run_queries": True}
    rows = tables.jdbc_query(spark, database, 'SELECT "id" FROM ITEMS WHERE "kind" = :kind', {"kind": 1}).collect()
    assert sorted(r[0] for r in rows) == [1, 4, 7]
    assert tables.jdbc_query(spark, database | {"run_queries": False}, "SELECT 1") is None


def test_display_and_writes(spark, tmp_path):
    df = spark.range(30)
    assert tables.head(df, 3).splitlines() == ["id", "0", "1", "2"] and len(tables.head(df).splitlines()) == 11
    tables.append(df, f"{tmp_path}/t")
    tables.append(df, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 60
    assert tables.is_write("saveAll") and not tables.is_write("findAll")
    cache = {}
    assert tables.cached(df, cache, "k") is tables.cached(df, cache, "k")
    for k in "ab":
        tables.cached(spark.range(3), cache, k, most=2)
    assert list(cache) == ["a", "b"] and not df.is_cached and tables.cached(df, cache, "k") is df
    cache["k"].unpersist()


def test_sessions(spark):
    from declq.streaming import events

    at = lambda minute: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=minute)
    rows = [(1, at(0)), (1, at(20)), (1, at(45)), (1, at(100)), (2, at(10))]
    got = events.sessions(spark.createDataFrame(rows, "user_id long, ts timestamp")).collect()
    assert sorted((x.user_id, x.start, x.end, x.n) for x in got) == [(1, at(0), at(75), 3), (1, at(100), at(130), 1), (2, at(10), at(40), 1)]


def test_closure_takes_few_rounds_along_a_long_path(spark, monkeypatch):
    rounds, write = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append(1) or write(df))
    n = 70
    path = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(n)], "src string, dst string").coalesce(1)
    assert sorted(tuple(x) for x in graph.closure(path).collect()) == [(f"n{i:02}", f"n{k:02}") for i in range(n + 1) for k in range(i + 1, n + 1)]
    assert len(rounds) <= 9  # 1, 2, 4, ... 128 edges and the last, empty one


@pytest.mark.parametrize("nodes,edges", [(12, 14), (9, 30), (20, 18)])
def test_closure_is_brute_force(spark, nodes, edges):
    r = random.Random(nodes)
    pairs = [(f"n{r.randrange(nodes)}", f"n{r.randrange(nodes)}") for _ in range(edges)]
    known = set(pairs)
    while more := {(a, d) for a, b in known for c, d in pairs if b == c} - known:
        known |= more
    got = [tuple(x) for x in graph.closure(spark.createDataFrame(pairs, "src string, dst string").coalesce(1)).collect()]
    assert sorted(got) == sorted(known)


def test_text_fold_never_holds_all_values(spark, monkeypatch):
    monkeypatch.setattr(Pipeline, "to_list", lambda self: pytest.fail("all values in one row"))
    monkeypatch.setattr(pipeline, "FOLD", 7)
    types = [x.event_type for x in spark.read.parquet(f"{DATA}/events.parquet").orderBy("event_id").select("event_type").collect()]
    assert registry.QUERIES["s_fold_text"](spark, DATA).first().reduced == "".join(t[0] for t in types)


def test_closure_through_a_hub_writes_few_rows(spark, monkeypatch):
    written, write = [], graph.cut

    def counted(df):
        out = write(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    n = 400
    sources, targets = [f"s{i}" for i in range(n)], [f"t{i}" for i in range(n)]
    edges = spark.createDataFrame([*((s, "hub") for s in sources), *(("hub", t) for t in targets)], "src string, dst string").coalesce(1)
    expected = {(s, t) for s in sources for t in targets} | {(s, "hub") for s in sources} | {("hub", t) for t in targets}
    got = [tuple(x) for x in graph.closure(edges).collect()]
    assert len(got) == len(expected) and set(got) == expected
    assert sum(written) < 20 * n  # not the n * n pairs


@pytest.mark.parametrize("nodes,edges,hubs", [(12, 14, 62), (9, 30, 62), (20, 18, 1), (30, 36, 2), (14, 22, 3)])
def test_closure_through_hubs_is_brute_force(spark, monkeypatch, nodes, edges, hubs):
    for name, value in (("LEAST_PATHS", 0), ("PATHS_AN_EDGE", 0), ("HUBS", hubs), ("HUB_LEAVES", 1), ("HUB_BLOCK", 2), ("HUB_PAIRS", 5)):
        monkeypatch.setattr(graph, name, value)
    r = random.Random(nodes + hubs)
    name = lambda: f"n{r.randrange(nodes)}" if r.random() < 0.95 else None
    pairs = [(name(), name()) for _ in range(edges)] + [(None, "n1"), ("n2", None)]
    known = set(pairs)
    while more := {(a, d) for a, b in known for c, d in pairs if b == c and b is not None} - known:
        known |= more
    got = [tuple(x) for x in graph.closure(spark.createDataFrame(pairs, "src string, dst string").coalesce(1)).collect()]
    assert Counter(got) == Counter(known)
