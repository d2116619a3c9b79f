"""Golden tables and error cases of the query languages."""

from types import SimpleNamespace

import pytest

from declq.plans import methodname, native, objectql, params, render, truth
from declq.plans.catalog import Catalog, ConversionError, Entity, Relation
from declq.sources import settings

GOLDEN = [
    ("findAll", "SELECT * FROM users"),
    ("findAllById", "SELECT * FROM users WHERE id IN (?)"),
    ("deleteAllByIdInBatch", "DELETE FROM users WHERE id IN (?)"),
    ("getOne", "SELECT * FROM users WHERE id = ?"),
    ("saveAllAndFlush", "INSERT INTO users DEFAULT VALUES"),
    ("countByActive", "SELECT COUNT(*) FROM users WHERE active = ?"),
    ("existsByEmail", "SELECT EXISTS (SELECT 1 FROM users WHERE email = ?)"),
    ("findByNameNotLike", "SELECT * FROM users WHERE name NOT LIKE ?"),
    ("findByDateBeforeAndTimeAfter", "SELECT * FROM users WHERE date < ? AND time > ?"),
    ("findByStatusIsTrueOrStatusIsFalse", "SELECT * FROM users WHERE status = true OR status = false"),
    ("findByOrderIdAndOrderTypeAndIsActive", "SELECT * FROM users WHERE order_id = ? AND order_type = ? AND is_active = ?"),
    ("findByOrganization", "SELECT * FROM users WHERE organization = ?"),
    ("findByStatusOrderByCreatedAtDescNameAsc", "SELECT * FROM users WHERE status = ? ORDER BY created_at DESC, name ASC"),
    ("existsHarvestRecordByFarmIdAndSeasonAndCropType", "SELECT EXISTS (SELECT 1 FROM users WHERE farm_id = ? AND season = ? AND crop_type = ?)"),
    ("findAllById_HospitalIdAndId_TenantId", "SELECT * FROM users WHERE hospital_id = ? AND tenant_id = ?"),
    ("findTop10ByName", "SELECT * FROM users WHERE name = ? LIMIT 10"),
    ("findFirstByName", "SELECT * FROM users WHERE name = ? LIMIT 1"),
    ("findByAgeBetweenAndNameIsNull", "SELECT * FROM users WHERE age BETWEEN ? AND ? AND name IS NULL"),
]


@pytest.mark.parametrize("name,sql", GOLDEN)
def test_method_name_as_sql(name, sql):
    assert render.to_sql(name, "users") == sql


def test_dialects_and_numbers():
    assert render.to_sql("findByActiveTrue", "t", "oracle") == "SELECT * FROM t WHERE active = 1"
    assert render.to_sql("findFirst5ByNameOrderByName", "t", "oracle") == "SELECT * FROM (SELECT * FROM t WHERE name = ? ORDER BY name ASC) WHERE ROWNUM <= 5"
    assert render.numbered("a = ? AND b = ?") == "a = ?1 AND b = ?2"


@pytest.mark.parametrize("name", ["saveUserByName", "frobnicate", "findSomething"])
def test_names_outside_the_language(name):
    with pytest.raises(ConversionError):
        methodname.parse(name)


def test_arity():
    assert methodname.parse("findByAgeBetweenAndNameIsNullAndX").n_args == 3


def test_parameters():
    sql, values = params.bind("a LIKE %:p% AND b IN (:l) AND c = ':p' AND d = :#{#f.getX()}", {"p": "v", "l": [1, 2], "f": SimpleNamespace(x=3)})
    assert sql == "a LIKE CONCAT('%', :p, '%') AND b IN (:l_0, :l_1) AND c = ':p' AND d = :x"
    assert values == {"p": "v", "l_0": 1, "l_1": 2, "x": 3}
    assert params.bind("x IN (?)", [[]])[0] == "x IN (NULL)"
    with pytest.raises(ConversionError):
        params.bind("a = :missing", {})


def test_object_query_errors():
    catalog = Catalog([Entity("A", "a", "id", {"id": "id"}, {"b": Relation("B")}), Entity("B", "b", "id", {"id": "id"})], lambda t: None)
    assert "LEFT JOIN b b_1 ON a.b_id = b_1.id" in objectql.to_sql(catalog, "SELECT a FROM A a WHERE a.b.id = 1")
    for text, reason in (("SELECT x FROM Nope x", "UNKNOWN_ENTITY"), ("SELECT a.nope FROM A a", "UNKNOWN_PROPERTY"), ("SELECT 1", "PARSE_ERROR")):
        with pytest.raises(ConversionError) as e:
            objectql.to_sql(catalog, text)
        assert e.value.reason == reason


def test_native_or_not():
    assert native.is_native("SELECT COUNT(*) FROM user_roles")
    assert native.is_native("select * from (select a from b) x")
    assert not native.is_native("SELECT u FROM User u WHERE u.name = :n")


def test_truth_parts():
    tree = truth.parse("a > 3 && !(b == null)")
    assert truth.variables(tree) == ["a", "b"] and len(truth.conditions(tree)) == 2
    assert truth.domains(tree) == {"a": [2, 3, 4], "b": [None, "T"]}
    assert truth.negation("a < 1").op == ">="


def test_settings(monkeypatch):
    monkeypatch.setenv("SOME_NAME", "env")
    got = settings.load("variables:\n  base: /x\npath: ${base}/y\nenv: ${SOME_NAME}${NO_SUCH}\nbad: ${open\ndatabase:\n  run_queries: false\n  n: 3\nlist:\n  - a\n  - b\n")
    assert got == {"variables": {"base": "/x"}, "path": "/x/y", "env": "env", "bad": "${open", "database": {"run_queries": False, "n": 3}, "list": ["a", "b"]}


@pytest.mark.parametrize("text", ["a + > b", "a == b c", "a @ b", "(a > 1", "a.equals(", "\"x\".size() > 1", ""])
def test_conditions_outside_the_language(text):
    with pytest.raises(ConversionError):
        truth.parse(text)


def test_conditions_and_domains():
    assert truth.domains(truth.parse("a == null || a == \"x\"")) == {"a": [None, "", "x"]}
    assert truth.domains(truth.parse("a.equals(b)")) == {"a": [True, False], "b": [True, False]}
    assert truth.domains(truth.parse("a > 5 || a.equals(7)")) == {"a": [4, 5, 6, 7, 8]}
    assert truth.domains(truth.parse("s == Kind.A || s == Kind.B"))["s"] == ["Kind.A", "Kind.B", "Kind.OTHER"]
    assert truth.domains(truth.parse("!items.isEmpty()")) == {"items": [[], ["T"]]}
    assert truth.variables(truth.parse("p.getName(1, x).trim() != null && q.r > -2L")) == ["p.getName(1,x).trim()", "q.r"]
    assert truth.parse("a * 2 + 1 > b") == truth.parse("((a * 2) + 1) > b")


def test_first_rows_and_display(spark):
    assert truth.first_satisfying(truth.table(spark, "a > 5 || a.equals(7)")).first().a == 6
    assert truth.first_satisfying(truth.table(spark, "a > 5 && a.equals(7)")).first().a == 7
    assert truth.satisfying(truth.table(spark, "a.equals(b)")).count() == 2
    assert truth.shown(truth.table(spark, "!a")).splitlines() == ["a\tresult", "False\tTrue", "True\tFalse"]


TWO = Catalog([Entity("A", "a", "id", {"id": "id", "name": "nm"}, {"b": Relation("B")}), Entity("B", "b", "id", {"id": "id"})], lambda t: None)


@pytest.mark.parametrize("text,reason", [
    ("INSERT INTO A VALUES (1)", "UNSUPPORTED_CONSTRUCT"), ("MERGE A", "UNSUPPORTED_CONSTRUCT"), ("", "UNSUPPORTED_CONSTRUCT"),
    ("SELECT a FROM A a WHERE a.id = 1)", "PARSE_ERROR"), ("UPDATE A a WHERE a.id = 1", "PARSE_ERROR"),
    ("DELETE FROM A a WHERE a.b.id = 1", "UNSUPPORTED_CONSTRUCT"), ("UPDATE A a SET a.nope = 1", "UNKNOWN_PROPERTY"),
    ("SELECT a FROM A a MINUS SELECT b FROM B b", "UNSUPPORTED_CONSTRUCT"),
])
def test_statements_that_are_errors(text, reason):
    with pytest.raises(ConversionError) as e:
        objectql.to_sql(TWO, text)
    assert e.value.reason == reason


def test_statements():
    assert objectql.to_sql(TWO, "DELETE FROM A x WHERE x.name = 'n'") == "SELECT x.* FROM a x WHERE NOT COALESCE((x.nm = 'n'), false)"
    assert objectql.to_sql(TWO, "SELECT x.id FROM A x UNION ALL SELECT y.id FROM B y") == "SELECT x.id FROM a x UNION ALL SELECT y.id FROM b y"


def test_views_do_not_stay(spark):
    catalog = Catalog([Entity("A", "a", "id", {"id": "id"}), Entity("B", "b", "id", {"id": "id"})], lambda t: spark.range(3) if t == "a" else 1 / 0)
    before = {t.name for t in spark.catalog.listTables()}
    df = objectql.run(spark, catalog, "SELECT a FROM A a WHERE a.id > :low", {"low": 0})  # B's table is never opened
    assert {t.name for t in spark.catalog.listTables()} == before and df.count() == 2
    assert objectql.run(spark, catalog, "SELECT a.nope FROM A a", on_error="log") is None
    assert native.run(spark, "SELECT * FROM no_such_table", on_error="log") is None
    with pytest.raises(ConversionError):
        objectql.run(spark, catalog, "SELECT a FROM A a WHERE a.id = :missing")


def test_not_in_of_an_empty_list():
    assert params.bind("a NOT IN (:l) AND b = 'NOT IN (NULL)'", {"l": []})[0] == "a <=> NULL IS NOT NULL AND b = 'NOT IN (NULL)'"


def test_tidy_texts():
    assert render.placeholders("a = ?1 AND b = '?' AND c IN (?, ?)") == 3
    assert render.unnumbered("a = ?1 AND b = '?2' AND c = ?12") == "a = ? AND b = '?2' AND c = ?"
    assert render.tidy("SELECT * FROM t WHERE '1' IN ('1') AND a = ?1 AND 1 = 1 AND b = ?2") == "SELECT * FROM t WHERE a = ? AND b = ?"
    assert render.tidy("SELECT * FROM t WHERE '1' IN ('1')") == "SELECT * FROM t WHERE '1' IN ('1')"


def test_native_tables_count_together():
    assert native.is_native("SELECT a FROM user_roles r JOIN role_names n ON r.id = n.id")
    assert not native.is_native("SELECT a FROM user_roles")


def test_relaxed_arguments():
    from declq.plans import relax

    class Frame:
        columns = ["id", "nm"]

    catalog = Catalog([Entity("A", "a", "id", {"id": "id", "name": "nm"})], lambda t: Frame())
    with pytest.raises(ConversionError):
        relax.relaxed(catalog, "A", "findByName", keep=("name",))
    with pytest.raises(ConversionError):
        relax.relaxed(catalog, "A", "findByNameOrId", values={"name": ["x"]})
    assert [c.prop for c in relax.relaxed(catalog, "A", "findByNameAndId")[1]] == ["name", "id"]


def test_declared_queries(spark):
    from declq.plans.spec import QuerySpec

    spark.range(4).createOrReplaceTempView("declared_items")
    try:
        assert QuerySpec(["SELECT COUNT(*) AS n ", "FROM declared_items WHERE id > ?1"]).run(spark, TWO, [0]).first().n == 3
    finally:
        spark.catalog.dropTempView("declared_items")
    spec = QuerySpec("SELECT a FROM A a \\\n WHERE a.id = :i")
    assert not spec.native and QuerySpec("SELECT 1", is_native=True).native
    catalog = Catalog([Entity("A", "a", "id", {"id": "id"})], lambda t: spark.range(3))
    assert spec.run(spark, catalog, {"i": 2}).count() == 1
    assert spec.run(spark, catalog, {}, on_error="log") is None


def test_every_reason_of_failure():
    many = Catalog([Entity("Red.Box", "r", "id", {"id": "id"}), Entity("Blue.Box", "b", "id", {"id": "id"})], lambda t: None)
    for reason, call in {
        "PARSE_ERROR": lambda: objectql.to_sql(TWO, "SELECT 1"),
        "UNKNOWN_ENTITY": lambda: objectql.to_sql(TWO, "SELECT x FROM Nope x"),
        "UNKNOWN_PROPERTY": lambda: objectql.to_sql(TWO, "SELECT a.nope FROM A a"),
        "UNSUPPORTED_CONSTRUCT": lambda: objectql.to_sql(TWO, "SELECT a FROM A a WHERE a.id MEMBER OF a.b"),
        "MISSING_PARAMETER": lambda: params.bind("a = ?", []),
        "AMBIGUOUS_NAME": lambda: many.entity("Box"),
    }.items():
        with pytest.raises(ConversionError) as e:
            call()
        assert e.value.reason == reason
