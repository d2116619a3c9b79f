"""Truth tables: domains of variables, their constrained product as a DataFrame, and the value of a condition for each row.

The condition language has || && ! comparisons, + - * / %, literals (numbers with their suffixes, strings, characters, true,
false, null, Enum.CONSTANT), dotted paths and calls. a.equals(b) and a.isEmpty() are operators; any other path or call, such
as person.getName(), is a variable of that name. Text that does not belong to the language is an error.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from declq.operators.ranges import small_side
from declq.plans.catalog import ConversionError

_TOKEN = re.compile(r"""\s*(&&|\|\||==|!=|<=|>=|[<>!()+*/%,.-]|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)'|\d+(?:\.\d+)?[lLfFdD]?|[A-Za-z_$][\w$]*)""")
_ENUM = re.compile(r"[A-Z]\w*\.[A-Z][A-Z0-9_]*")
#: Binary operators from loose to tight.
LEVELS = (("||",), ("&&",), ("==", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%"))
COMPARISONS = (*LEVELS[2], *LEVELS[3], "equals")
ARITHMETIC = (*LEVELS[4], *LEVELS[5])


@dataclass(frozen=True)
class Node:
    """op: var, lit, enum, not, neg, empty, equals or a binary operator."""

    op: str
    args: tuple[Any, ...]


def tokens_of(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ConversionError("PARSE_ERROR", f"{text[at:]!r} in {text!r}")
        out.append(m[1])
        at = m.end()
    return out


def parse(text: str) -> Node:
    """The tree of a condition; all of the text must be used."""
    tokens = [*tokens_of(text), ""]
    at = 0

    def take(expected: str = "") -> str:
        nonlocal at
        if not tokens[at] or (expected and tokens[at] != expected):
            raise ConversionError("PARSE_ERROR", f"{tokens[at] or 'end'} in {text!r}")
        at += 1
        return tokens[at - 1]

    def level(k: int = 0) -> Node:
        if k == len(LEVELS):
            return unary()
        left = level(k + 1)
        while tokens[at] in LEVELS[k]:
            op = take()
            left = Node(op, (left, level(k + 1)))
        return left

    def unary() -> Node:
        if tokens[at] == "!":
            take()
            return Node("not", (unary(),))
        if tokens[at] == "-":
            take()
            inner = unary()
            return Node("lit", (-inner.args[0],)) if inner.op == "lit" and isinstance(inner.args[0], (int, float)) else Node("neg", (inner,))
        node = primary()
        while tokens[at] == ".":
            take()
            node = member(node)
        return Node("enum", node.args) if node.op == "var" and _ENUM.fullmatch(node.args[0]) else node

    def primary() -> Node:
        t = take()
        if t == "(":
            inner = level()
            take(")")
            return inner
        if t in ("true", "false", "null"):
            return Node("lit", ({"true": True, "false": False, "null": None}[t],))
        if t[0] in "\"'":
            return Node("lit", (re.sub(r"\\(.)", r"\1", t[1:-1]),))
        if t[0].isdigit():
            number = t.rstrip("lLfFdD")
            return Node("lit", (float(number) if "." in number or t[-1] in "fFdD" else int(number),))
        if not re.match(r"[A-Za-z_$]", t):
            raise ConversionError("PARSE_ERROR", f"{t} in {text!r}")
        return Node("var", (t + arguments()[1] if tokens[at] == "(" else t,))

    def arguments() -> tuple[list[Node], str]:
        start = at
        take("(")
        nodes: list[Node] = []
        while tokens[at] != ")":
            if nodes:
                take(",")
            nodes.append(level())
        take(")")
        return nodes, "".join(tokens[start:at])

    def member(scope: Node) -> Node:
        name = take()
        if not re.match(r"[A-Za-z_$]", name):
            raise ConversionError("PARSE_ERROR", f".{name} in {text!r}")
        if tokens[at] != "(":
            args, written = None, ""
        else:
            args, written = arguments()
        if name == "equals" and args is not None and len(args) == 1:
            return Node("equals", (scope, args[0]))
        if name == "isEmpty" and args == []:
            return Node("empty", (scope,))
        if scope.op != "var":
            raise ConversionError("UNSUPPORTED_CONSTRUCT", f".{name} in {text!r}")
        return Node("var", (f"{scope.args[0]}.{name}{written}",))

    node = level()
    if tokens[at]:
        raise ConversionError("PARSE_ERROR", f"{tokens[at]} in {text!r}")
    return node


def walk(n: Node) -> list[Node]:
    return [n] + [x for a in n.args if isinstance(a, Node) for x in walk(a)]


def variables(n: Node) -> list[str]:
    return sorted({x.args[0] for x in walk(n) if x.op == "var"})


def conditions(n: Node) -> list[Node]:
    """The comparisons, and the variables that stand for themselves."""
    found = [x for x in walk(n) if x.op in (*COMPARISONS, "empty")]
    compared = {a for x in walk(n) if x.op in (*COMPARISONS, *ARITHMETIC, "neg", "empty") for a in x.args}
    return found + [x for x in walk(n) if x.op == "var" and x not in compared]


def domains(n: Node, width: int | None = None) -> dict[str, list[Any]]:
    """Values of each variable: from the literals it is compared with, else booleans, else integers that can be told apart.

    A variable that is compared with literals of different kinds is an error. Numbers: every literal and its neighbours. Strings: the literals and the empty string. Enums: the constants and another
    one. A variable that is only asked for isEmpty() is an empty or a filled list; one that is compared with null has null
    besides its other values (or a text, if it has none).
    """
    out: dict[str, list[Any]] = {}
    names = variables(n)
    nodes = walk(n)
    compared = [x for x in nodes if x.op in COMPARISONS]
    for name in names:
        var = Node("var", (name,))
        mine = [x for x in compared if var in x.args]
        lits = [a.args[0] for x in mine for a in x.args if a.op == "lit"]
        enums = [a.args[0] for x in mine for a in x.args if a.op == "enum"]
        given = list(dict.fromkeys(v for v in lits if v is not None))
        kinds = {"enum" for _ in enums} | {"text" if isinstance(v, str) else "boolean" if isinstance(v, bool) else "number" for v in given}
        if len(kinds) > 1:
            raise ConversionError("UNSUPPORTED_CONSTRUCT", f"{name} is compared with {' and '.join(sorted(kinds))} literals")
        if enums:
            values: list[Any] = [*dict.fromkeys(enums), enums[0].partition(".")[0] + ".OTHER"]
        elif any(isinstance(v, bool) for v in given):
            values = [True, False]
        elif any(isinstance(v, str) for v in given):
            values = list(dict.fromkeys(["", *map(str, given)]))
        elif given:
            values = sorted({v + d for v in given for d in (-1, 0, 1)})
        elif lits:
            values = ["T"]
        elif any(x.op == "empty" and var in x.args for x in nodes):
            values = [[], ["T"]]
        elif any(x.op in (*ARITHMETIC, "neg") and var in x.args for x in nodes) or any(x.op != "equals" for x in mine):
            values = list(range(width or max(2, len(names))))
        else:
            values = [True, False]
        out[name] = ([None] if None in lits else []) + values
    return out


def narrow(values: Sequence[Any], op: str, bound: Any) -> list[Any]:
    """The values of a domain that satisfy a constraint against a constant."""
    keep = {"<": lambda v: v < bound, "<=": lambda v: v <= bound, ">": lambda v: v > bound, ">=": lambda v: v >= bound, "==": lambda v: v == bound, "!=": lambda v: v != bound}[op]
    return [v for v in values if v is not None and keep(v)]


def column(n: Node, lists: frozenset[str] = frozenset()) -> Column:
    """Null equals null only; a null in a logical place is false; a number there is true unless 0. `lists`: variables of lists."""
    if n.op == "var":
        return F.col(f"`{n.args[0]}`")
    if n.op in ("lit", "enum"):
        return F.lit(n.args[0])
    if n.op == "not":
        return ~_logical(n.args[0], lists)
    if n.op == "empty":
        inner = column(n.args[0], lists)
        return F.coalesce(F.size(inner) == 0 if n.args[0].args[0] in lists else F.length(inner) == 0, F.lit(True))
    if n.op in ("&&", "||"):
        a, b = (_logical(x, lists) for x in n.args)
        return a & b if n.op == "&&" else a | b
    if n.op == "neg":
        return -column(n.args[0], lists)
    a, b = (column(x, lists) for x in n.args)
    if n.op in ("==", "!="):
        return a.eqNullSafe(b) if n.op == "==" else ~a.eqNullSafe(b)
    if n.op in ARITHMETIC:
        return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b), "%": F.try_mod(a, b)}[n.op]
    made = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "equals": a == b}[n.op]  # null.equals(x) counts as false
    return F.coalesce(made, F.lit(False))


def _logical(n: Node, lists: frozenset[str] = frozenset()) -> Column:
    return F.coalesce(column(n, lists).cast("boolean"), F.lit(False))


def table(spark: SparkSession, text: str, given: Mapping[str, Sequence[Any]] | None = None, constraints: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """Every assignment of the variables with column `result`. The product is of literal domains, whose sizes the query fixes.

    Domains are narrowed by constraints against constants before the product; all constraints then filter its rows.
    """
    n = parse(text)
    values = domains(n, width) | {k: list(v) for k, v in (given or {}).items()}
    trees = [parse(c) for c in constraints]
    for c in trees:
        if c.op in COMPARISONS and c.op != "equals" and c.args[0].op == "var" and c.args[1].op == "lit" and c.args[1].args[0] is not None and c.args[0].args[0] in values:
            values[c.args[0].args[0]] = narrow(values[c.args[0].args[0]], c.op, c.args[1].args[0])
    df = spark.range(1).select()
    for name in variables(n):
        cells = [F.lit(v) for v in values[name]]
        df = df.withColumn(name, F.explode(F.array(*cells))) if cells else df.withColumn(name, F.lit(None)).where(F.lit(False))
    lists = frozenset(name for name in variables(n) if any(isinstance(v, list) for v in values[name]))
    for c in trees:
        df = df.where(_logical(c, lists))
    return df.withColumn("result", _logical(n, lists))


def located(df: DataFrame, rows: DataFrame, bindings: Mapping[str, Column]) -> DataFrame:
    """`rows` with the variables, bound to columns, and the `result` of the truth table's row that they fall in.

    Rows whose values are in no row of the table (outside the domains or the constraints) are left out. The table's size is
    fixed by the condition; it is counted and broadcast if small, so the rows are read once, without a shuffle.
    """
    names = [c for c in df.columns if c != "result"]
    if set(names) != set(bindings):
        raise ValueError(f"bindings for {sorted(names)} are needed, not for {sorted(bindings)}")
    cases = df.select(*[F.col(f"`{c}`").alias(f"case {c}") for c in names], "result")
    on: Column = F.lit(True)
    for c in names:
        on &= F.col(f"`{c}`").eqNullSafe(F.col(f"`case {c}`"))
    bound = rows.withColumns({c: bindings[c] for c in names})
    return bound.join(small_side(cases), on).drop(*[f"case {c}" for c in names])


def satisfying(df: DataFrame, value: bool = True) -> DataFrame:
    return df.where(F.col("result") == F.lit(value))


def first_satisfying(df: DataFrame, value: bool = True) -> DataFrame:
    names = [c for c in df.columns if c != "result"]
    return satisfying(df, value).orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in names]).limit(1)


def shown(df: DataFrame) -> str:
    """The table as text, a line a row in the order of its values."""
    names = [c for c in df.columns if c != "result"]
    rows = df.orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in names]).collect()  # its size is fixed by the condition
    return "\n".join(["\t".join(df.columns), *("\t".join(str(v) for v in r) for r in rows)])


def negation(text: str) -> Node:
    """The opposite condition: a comparison is flipped, anything else is negated."""
    n = parse(text)
    flip = {"==": "!=", "!=": "==", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
    return Node(flip[n.op], n.args) if n.op in flip else Node("not", (n,))


def path_states(spark: SparkSession, branches: Mapping[str, Sequence[str]], attempted: DataFrame | None = None, reuse: bool = False) -> DataFrame:
    """Combinations of sibling branches' states that were not attempted yet, with a fingerprint column.

    reuse: if all were attempted, the first of them (by fingerprint) comes back, so that a caller always has a state to try.
    """
    names = sorted(branches)
    df = reduce(lambda d, k: d.withColumn(k, F.explode(F.array(*map(F.lit, branches[k])))), names, spark.range(1).select())
    df = df.withColumn("fingerprint", F.concat_ws("|", *[F.concat_ws("=", F.lit(k), F.col(k)) for k in names]))
    if attempted is None:
        return df
    left = df.join(attempted.select("fingerprint"), "fingerprint", "left_anti")
    if not reuse:
        return left
    n_left = left.agg(F.count(F.lit(1)).alias("n_left"))
    again = df.orderBy("fingerprint").limit(1).join(F.broadcast(n_left), F.col("n_left") == 0, "left_semi")
    return left.unionByName(again)


#: States of a branch from first to last among branches with as many children; one whose both paths were taken comes after all.
BRANCH_STATES = ("FALSE", "TRUE", "UNTRAVELLED", "BOTH")


def branch_rank() -> dict[str, Column]:
    """Columns, from (state, n_children), whose ascending order is that in which branches are tried: fewer children first."""
    rank = F.array_position(F.array(*map(F.lit, BRANCH_STATES)), F.col("state"))
    return {"taken": F.col("state") == "BOTH", "children": F.col("n_children"), "state_rank": F.when(rank > 0, rank).otherwise(len(BRANCH_STATES))}


def branch_order(branches: DataFrame) -> DataFrame:
    """Branches (state, n_children and any other columns) in the order in which they are tried, then by the other columns."""
    return branches.orderBy(*branch_rank().values(), *[c for c in branches.columns if c not in ("state", "n_children")])
