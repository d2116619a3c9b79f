"""The data source of sharded JSON lines, joined inheritance, and the List and Map methods."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from declq.functions import library
from declq.plans.catalog import Catalog, Entity, Parent
from declq.plans.derive import derive
from declq.plans.relax import matching, sample_arguments
from declq.registry import catalog
from declq.sources import shards
from tests.conftest import DATA


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Seven shards, one of them gzipped, with nulls, missing fields, blank lines and lines of very different lengths."""
    where = tmp_path_factory.mktemp("shards")
    r = random.Random(5)
    rows = [{"id": i, "text": "é" * r.choice([0, 3, 5000]) + str(i), "kind": r.choice(["a", "b", None]), "more": {"x": i}} for i in range(700)]
    for row in rows[::50]:
        del row["kind"]
    for k in range(7):
        lines = "".join(json.dumps(x, ensure_ascii=False) + "\n" + "\n" * (x["id"] % 13 == 0) for x in rows[k::7]).encode()
        if k == 3:
            (where / f"part-{k}.json.gz").write_bytes(gzip.compress(lines))
        else:
            (where / f"part-{k}.json").write_bytes(lines.rstrip(b"\n") if k == 5 else lines)
    (where / "_SUCCESS").write_bytes(b"")
    return str(where), rows


def read(spark, path, schema="id long, kind string", **options):
    shards.with_filters(spark)
    return spark.read.format("shards").schema(schema).options(**options).load(path)


@pytest.mark.parametrize("split", [1000, 7777, 1 << 25])
def test_every_line_is_read_once_however_files_are_split(spark, folder, split):
    path, rows = folder
    df = read(spark, path, "id long, text string, kind string", split_bytes=split)
    assert sorted((x.id, x.text, x.kind) for x in df.collect()) == [(x["id"], x["text"], x.get("kind")) for x in rows]
    if split == 1000:
        assert df.rdd.getNumPartitions() > 50


def test_filters_are_tested_in_the_source(spark, folder):
    path, rows = folder
    df = read(spark, path)
    cases = [
        (F.col("id") >= 650, lambda x: x["id"] >= 650),
        ((F.col("kind") == "a") & (F.col("id") < 30), lambda x: x.get("kind") == "a" and x["id"] < 30),
        (F.col("kind").isNull(), lambda x: x.get("kind") is None),
        (F.col("kind") != "a", lambda x: x.get("kind") not in ("a", None)),
        (F.col("id").isin(3, 5, 9999), lambda x: x["id"] in (3, 5)),
        (F.col("kind").startswith("b"), lambda x: (x.get("kind") or "").startswith("b")),
        ((F.col("id") == 1) | (F.col("kind") == "b"), lambda x: x["id"] == 1 or x.get("kind") == "b"),  # Spark's
        (F.col("id") % 7 == 1, lambda x: x["id"] % 7 == 1),
    ]
    for condition, plain in cases:
        assert sorted(x.id for x in df.where(condition).collect()) == sorted(x["id"] for x in rows if plain(x))
    plan = lambda c: df.where(c)._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    assert "Filter" not in plan("id >= 650 and kind = 'a'") and "Filter" in plan("id % 7 = 1")  # nothing is left for Spark to test


def test_reader_takes_the_filters_it_knows(folder):
    from pyspark.sql.datasource import EqualTo, GreaterThan, Not, StringContains
    from pyspark.sql.types import StructType

    path, _ = folder
    reader = shards.ShardReader(StructType.fromDDL("id long, kind string, day date"), {"path": path})
    known = [EqualTo(("kind",), "a"), GreaterThan(("id",), 5), Not(EqualTo(("kind",), "a")), StringContains(("kind",), "x")]
    unknown = [GreaterThan(("day",), "2020-01-01"), EqualTo(("more", "x"), 1), Not(GreaterThan(("id",), 5))]
    assert list(reader.pushFilters([*known, *unknown])) == unknown and len(reader.tests) == 4
    with pytest.raises(ValueError):
        shards.Shards({"path": path}).schema()


def test_joined_inheritance(spark):
    tables = {"vehicle": spark.createDataFrame([(1, "red"), (2, "blue"), (3, "red")], "id long, colour string"), "car": spark.createDataFrame([(1, 4), (3, 2)], "id long, doors int"), "taxi": spark.createDataFrame([(3, "x")], "car_id long, licence string")}
    entities = [Entity("Vehicle"), Entity("Car", parent=Parent("Vehicle", "id", "id")), Entity("Taxi", key="car_id", parent=Parent("Car", "car_id", "id"))]
    c = Catalog(entities, tables.__getitem__)
    assert c.frame("Taxi").columns == ["car_id", "licence", "id", "doors", "colour"]
    assert [tuple(x) for x in c.frame("Taxi").collect()] == [(3, "x", 3, 2, "red")]
    assert [x.id for x in derive(c, "Car", "findByColourAndDoorsLessThan", "red", 3).collect()] == [3]


def test_rows_of_sampled_arguments(spark):
    c = catalog(spark, DATA)
    arguments = sample_arguments(c, "Order", "findByOrderStatusAndPriority", "orderKey", rows=3)
    assert arguments.count() == 3 and arguments.columns == ["orderStatus", "priority"]
    wanted = {tuple(x) for x in arguments.collect()}
    rows = c.frame("Order").collect()
    assert {x.o_orderkey for x in matching(c, "Order", arguments).collect()} == {x.o_orderkey for x in rows if (x.o_orderstatus, x.o_orderpriority) in wanted}


def test_list_and_map_methods(spark):
    df = spark.sql("SELECT array(3, null, 5, 3) AS l, map('a', 1, 'b', null) AS m, cast(array() as array<int>) AS e")
    of = lambda kind, name, c, *args: df.select(library.call(kind, name, F.col(c), *args)).first()[0]
    assert [of("List", n, "l") for n in ("size", "getFirst", "getLast", "isEmpty")] == [4, 3, 3, False]
    assert of("List", "isEmpty", "e") and of("List", "getLast", "e") is None and of("List", "get", "l", 9) is None
    assert of("List", "contains", "l", 5) and not of("List", "contains", "l", 4) and of("List", "contains", "l", F.lit(None))
    assert (of("List", "indexOf", "l", 3), of("List", "lastIndexOf", "l", 3), of("List", "indexOf", "l", 8), of("List", "lastIndexOf", "e", 8)) == (0, 3, -1, -1)
    assert of("List", "subList", "l", 1, 3) == [None, 5] and of("List", "subList", "l", 1, 9) is None
    assert of("List", "add", "l", 7) == [3, None, 5, 3, 7] and of("List", "removeAll", "l", F.array(F.lit(3))) == [None, 5]
    assert of("List", "addAll", "l", F.col("e")) == [3, None, 5, 3] and of("List", "containsAll", "l", F.col("e")) and of("List", "reversed", "l") == [3, 5, None, 3]
    assert (of("Map", "get", "m", "a"), of("Map", "get", "m", "c"), of("Map", "getOrDefault", "m", "c", 9), of("Map", "getOrDefault", "m", "b", 9)) == (1, None, 9, None)
    assert of("Map", "containsKey", "m", "b") and not of("Map", "containsKey", "m", "c") and of("Map", "containsValue", "m", 1) and not of("Map", "isEmpty", "m")
    assert of("Map", "put", "m", "a", 5) == {"a": 5, "b": None} and of("Map", "remove", "m", "a") == {"b": None}
    assert sorted(of("Map", "keySet", "m")) == ["a", "b"] and of("Map", "size", "m") == 2
