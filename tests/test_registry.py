"""Every registered query of the reference's operators against its SQL."""

import pytest

from declq import registry, registry_analytics, registry_details  # noqa: F401 - the others add their queries
from tests.conftest import DATA, same_rows


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(name, spark, duck):
    same_rows(registry.QUERIES[name](spark, DATA), duck, registry.ORACLE_SQL[name])


def test_entry_module():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


def test_greedy_cut_breaks_all_cycles(spark):
    from declq.operators import graph

    edges = registry._types(spark, DATA)
    cut = registry.QUERIES["g_greedy_cut"](spark, DATA)
    left = edges.join(cut, ["src", "dst"], "left_anti")
    assert graph.cycle_groups(left).count() == 0


def test_long_cycle_is_found_and_cut(spark):
    from declq.operators import graph

    ring = [(f"n{i:02}", f"n{(i + 1) % 60:02}", "FIELD") for i in range(60)]
    edges = spark.createDataFrame(ring, "src string, dst string, kind string").coalesce(1)
    cycles = graph.elementary_cycles(edges).collect()
    assert [x.cycle for x in cycles] == [[e[0] for e in ring]]
    assert graph.edge_frequency(spark.createDataFrame(cycles)).count() == 60
    assert graph.greedy_cut(edges).count() == 1


def test_whole_tables_are_folded_and_ordered(spark):
    sizes = [x.p_size for x in spark.read.parquet(f"{DATA}/part.parquet").orderBy("p_partkey").select("p_size").collect()]
    customers = spark.read.parquet(f"{DATA}/customer.parquet").collect()
    run = lambda name: registry.QUERIES[name](spark, DATA).collect()
    folded = sizes[0]
    for x in sizes[1:]:
        folded = max(folded, x) - min(folded, x) % 3
    assert len(sizes) > 100 and run("s_reduce")[0].reduced == folded
    assert [x.value for x in run("s_sorted")] == sorted(sizes)
    assert [x.value for x in run("s_sorted_by")] == sorted(sizes, key=lambda x: -(x % 7))
    assert [x.c_custkey for x in run("q_order_by")] == [x.c_custkey for x in sorted(customers, key=lambda x: (-x.c_acctbal, x.c_custkey))]
    rich = sorted((x for x in customers if x.c_acctbal > 0), key=lambda x: x.c_custkey)
    assert [x.c_custkey for x in run("d_order_multi")] == [x.c_custkey for x in sorted(rich, key=lambda x: x.c_mktsegment, reverse=True)]
