"""A small graph query language compiled to joins.

``MATCH pattern[, pattern] [WHERE conditions] [OPTIONAL MATCH (a)-[:T]->(b)
[WHERE conditions]] [WITH items [WHERE conditions]] RETURN [DISTINCT] items [ORDER
BY items] [SKIP n] [LIMIT n]`` with node patterns ``(n:Label {prop: 'v'})``, edges
``-[:T]->``, ``<-[:T]-``, ``-[:T]-``, ``-[r:T]->`` and ``*1..k``, comparisons ``=``,
``<>``, ``<``, ``>``, ``<=``, ``>=``, ``IN [...]``, ``IS [NOT] NULL``, ``CONTAINS``,
``STARTS WITH``, ``ENDS WITH``, joined by ``AND``, ``OR``, ``NOT`` and parentheses, and
the aggregates count, sum, avg, min, max and collect, each with DISTINCT if wanted,
and ``count(*)``. After WITH only its names are known. Values are bound as literals,
never as text of a query. Anything else raises :class:`QueryError`.

Nodes and edges are tables: a node table has a key column, an edge table from_id
and to_id. Variables become prefixed columns; each edge is one equi-join, so
Catalyst orders and prunes them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class QueryError(ValueError):
    """The text is outside the supported language."""


@dataclass
class Graph:
    """nodes: label -> (table, key column); edges: type -> (table, from label, to label)."""

    nodes: dict[str, tuple[DataFrame, str]]
    edges: dict[str, tuple[DataFrame, str, str]]


_TOKEN = re.compile(r"\s*(?:('(?:[^']|'')*'|\"[^\"]*\")|(\d+(?:\.\d+)?)|([A-Za-z_]\w*)|(<-\[|<-|\]->|\]-|-\[|->|<>|<=|>=|\.\.|[-(){}\[\]:,.=<>*]))")


def tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.strip().rstrip(";")
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            if not text[at:].strip():
                break
            raise QueryError(f"cannot read {text[at : at + 20]!r}")
        out.append(m[0].strip())
        at = m.end()
    return out


class _Reader:
    def __init__(self, text: str):
        self.items, self.at = tokens(text), 0

    def peek(self, n: int = 0) -> str:
        return self.items[self.at + n] if self.at + n < len(self.items) else ""

    def word(self, *wanted: str) -> bool:
        if self.peek().upper() in wanted:
            self.at += 1
            return True
        return False

    def take(self, wanted: str | None = None) -> str:
        token = self.peek()
        if not token or (wanted is not None and token != wanted):
            raise QueryError(f"expected {wanted or 'more'}, found {token or 'the end'}")
        self.at += 1
        return token

    def name(self) -> str:
        token = self.take()
        if not re.fullmatch(r"[A-Za-z_]\w*", token):
            raise QueryError(f"expected a name, found {token}")
        return token

    def value(self):
        token = self.take()
        if token[0] in "'\"":
            return token[1:-1].replace("''", "'")
        if token[0].isdigit():
            return float(token) if "." in token else int(token)
        raise QueryError(f"expected a value, found {token}")


@dataclass
class _Node:
    name: str
    label: str | None
    props: dict


@dataclass
class _Edge:
    name: str | None
    kind: str
    way: str  # out, in or both
    low: int
    high: int


def _node(r: _Reader, made: list[int]) -> _Node:
    r.take("(")
    name = r.name() if re.fullmatch(r"[A-Za-z_]\w*", r.peek()) else None
    label = None
    if r.peek() == ":":
        r.take()
        label = r.name()
    props = {}
    if r.peek() == "{":
        r.take()
        while r.peek() != "}":
            key = r.name()
            r.take(":")
            props[key] = r.value()
            if r.peek() == ",":
                r.take()
        r.take("}")
    r.take(")")
    if name is None:
        made[0] += 1
        name = f"__{made[0]}"
    return _Node(name, label, props)


def _edge(r: _Reader) -> _Edge:
    start = r.take()
    if start not in ("-[", "<-["):
        raise QueryError(f"expected an edge, found {start}")
    name = r.name() if r.peek() != ":" else None
    r.take(":")
    kind, low, high = r.name(), 1, 1
    if r.peek() == "*":
        r.take()
        low = int(r.value())
        r.take("..")
        high = int(r.value())
        if not 1 <= low <= high <= 8:
            raise QueryError("a path has 1 to 8 edges")
    end = r.take()
    ways = {("-[", "]->"): "out", ("<-[", "]-"): "in", ("-[", "]-"): "both"}
    if (start, end) not in ways:
        raise QueryError("an edge points one way or none")
    return _Edge(name, kind, ways[start, end], low, high)


_AGGREGATES = {
    "count": lambda c, only: F.countDistinct(c) if only else F.count(c),
    "sum": lambda c, only: F.sum_distinct(c) if only else F.sum(c),
    "avg": lambda c, only: F.sum_distinct(c) / F.countDistinct(c) if only else F.avg(c),
    "min": lambda c, only: F.min(c),
    "max": lambda c, only: F.max(c),
    "collect": lambda c, only: F.array_sort(F.collect_set(c) if only else F.collect_list(c)),
}


class Compiler:
    """One query over one graph."""

    def __init__(self, graph: Graph):
        self.graph = graph
        self.labels: dict[str, str] = {}
        self.scope: set[str] = set()

    def _table(self, node: _Node) -> DataFrame:
        if node.label not in self.graph.nodes:
            raise QueryError(f"unknown label {node.label}")
        table, key = self.graph.nodes[node.label]
        self.labels[node.name] = node.label
        for prop, value in node.props.items():
            if prop not in table.columns:
                raise QueryError(f"{node.label} has no property {prop}")
            table = table.filter(F.col(prop) == F.lit(value))
        return table.select(*[F.col(c).alias(f"{node.name}.{c}") for c in table.columns])

    def _id(self, name: str) -> Column:
        return F.col(f"`{name}.{self.graph.nodes[self.labels[name]][1]}`")

    def _steps(self, edge: _Edge, left: str | None) -> tuple[DataFrame, str, str]:
        if edge.kind not in self.graph.edges:
            raise QueryError(f"unknown edge {edge.kind}")
        table, a, b = self.graph.edges[edge.kind]
        rows = table.select(F.col("from_id").alias("__x"), F.col("to_id").alias("__y"))
        if edge.way == "in" or (edge.way == "both" and a != b and left == b):
            rows, a, b = rows.select(F.col("__y").alias("__x"), F.col("__x").alias("__y")), b, a
        elif edge.way == "both" and a == b:
            rows = rows.union(rows.select("__y", "__x"))
        if edge.high > 1:
            if a != b:
                raise QueryError("a path of several edges needs one label at both ends")
            rows = rows.distinct()
            reach, out = rows, rows if edge.low == 1 else None
            for n in range(2, edge.high + 1):
                onward = rows.select(F.col("__x").alias("__m"), F.col("__y").alias("__z"))
                reach = reach.join(onward, F.col("__y") == F.col("__m")).select("__x", F.col("__z").alias("__y")).distinct()
                if n >= edge.low:
                    out = reach if out is None else out.union(reach)
            rows = out.distinct()
        return rows, a, b

    def run(self, text: str) -> DataFrame:
        r = _Reader(text)
        if not r.word("MATCH"):
            raise QueryError("a query begins with MATCH")
        made, patterns = [0], []
        while True:
            chain: list = [_node(r, made)]
            while r.peek() in ("-[", "<-["):
                chain += [_edge(r), _node(r, made)]
            patterns.append(chain)
            if r.peek() != ",":
                break
            r.take()
        if len(patterns) == 1 and len(patterns[0]) == 1 and patterns[0][0].label is None:
            return self._any_node(r, patterns[0][0])
        self._infer(patterns)
        rows, bound, counted = None, set(), {}
        for chain in patterns:
            first = chain[0]
            if first.name not in bound:
                table = self._table(first)
                if rows is not None:
                    raise QueryError("patterns after the first begin with a variable that is bound")
                rows = table
                bound.add(first.name)
            at = first
            for edge, node in zip(chain[1::2], chain[2::2]):
                step, _, _ = self._steps(edge, self.labels[at.name])
                step = step.select(F.col("__x").alias("__from"), F.col("__y").alias("__to"))
                rows = rows.join(step, self._id(at.name) == F.col("__from"))
                if node.name in bound:
                    rows = rows.filter(self._id(node.name) == F.col("__to"))
                else:
                    other = self._table(node)
                    rows = rows.join(other, F.col("__to") == self._id(node.name))
                    bound.add(node.name)
                if edge.name:
                    counted[edge.name] = f"__edge_{edge.name}"
                    rows = rows.withColumn(counted[edge.name], F.struct("__from", "__to"))
                rows = rows.drop("__from", "__to")
                at = node
        if r.word("WHERE"):
            rows = rows.filter(self._conditions(r))
        while r.word("OPTIONAL"):
            rows = self._optional(r, rows, bound, made)
        while r.word("WITH"):
            rows = self._with(r, rows, counted)
            counted = {}
        return self._return(r, rows, counted)

    def _optional(self, r: _Reader, rows: DataFrame, bound: set[str], made: list[int]) -> DataFrame:
        """OPTIONAL MATCH of one edge from a bound variable: its other end, or null where there is none."""
        if not r.word("MATCH"):
            raise QueryError("expected MATCH")
        left, edge, right = _node(r, made), _edge(r), _node(r, made)
        if left.name not in bound or right.name in bound or left.props or edge.name:
            raise QueryError("an optional pattern leads by one edge from a bound variable to a new one")
        left.label = self.labels[left.name]
        step, _, other = self._steps(edge, left.label)
        right.label = right.label or other
        ends = self._table(right)
        found = step.select(F.col("__x").alias("__from"), F.col("__y").alias("__to")).distinct().join(ends, F.col("__to") == self._id(right.name))
        if r.word("WHERE"):
            found = found.filter(self._conditions(r))
        bound.add(right.name)
        return rows.join(found, self._id(left.name) == F.col("__from"), "left").drop("__from", "__to")

    def _with(self, r: _Reader, rows: DataFrame, counted: dict[str, str]) -> DataFrame:
        """WITH: named values, aggregated or not, which alone are known from here on; WHERE chooses among them."""
        rows, names = self._items(r, rows, counted)
        self.labels, self.scope = {}, set(names)
        return rows.filter(self._conditions(r)) if r.word("WHERE") else rows

    def _infer(self, patterns: list) -> None:
        """Labels that an edge's type tells."""
        known: dict[str, str] = {n.name: n.label for chain in patterns for n in chain[::2] if n.label}
        for _ in range(4):
            for chain in patterns:
                for left, edge, right in zip(chain[::2], chain[1::2], chain[2::2]):
                    if edge.kind not in self.graph.edges:
                        raise QueryError(f"unknown edge {edge.kind}")
                    _, a, b = self.graph.edges[edge.kind]
                    if edge.way == "in":
                        a, b = b, a
                    if edge.way == "both" and a != b:
                        if known.get(left.name) == b or known.get(right.name) == a:
                            a, b = b, a
                    known.setdefault(left.name, a)
                    known.setdefault(right.name, b)
        for chain in patterns:
            for n in chain[::2]:
                n.label = n.label or known.get(n.name)

    def _any_node(self, r: _Reader, node: _Node) -> DataFrame:
        if not (r.word("RETURN") and r.peek().lower() == "count"):
            raise QueryError("nodes of any label can only be counted")
        name = self._count_all(r, node.name)
        parts = [t.select(F.lit(1).alias("one")) for t, _ in self.graph.nodes.values()]
        return reduce(DataFrame.unionAll, parts).agg(F.count(F.lit(1)).alias(name))

    def _count_all(self, r: _Reader, name: str) -> str:
        for wanted in ("count", "("):
            if r.take().lower() != wanted:
                raise QueryError("nodes of any label can only be counted")
        r.take()
        r.take(")")
        return r.name() if r.word("AS") else "count"

    def _term(self, r: _Reader) -> tuple[Column, str]:
        name = r.name()
        if name in self.scope:
            return F.col(f"`{name}`"), name
        if r.peek() == ".":
            r.take()
            prop = r.name()
            if name not in self.labels or prop not in self.graph.nodes[self.labels[name]][0].columns:
                raise QueryError(f"{name} has no property {prop}")
            return F.col(f"`{name}.{prop}`"), f"{name}.{prop}"
        if name not in self.labels:
            raise QueryError(f"unknown variable {name}")
        return self._id(name), name

    def _conditions(self, r: _Reader) -> Column:
        """OR binds less than AND, AND less than NOT; parentheses bind most."""
        out = self._all_of(r)
        while r.word("OR"):
            out = out | self._all_of(r)
        return out

    def _all_of(self, r: _Reader) -> Column:
        out = self._condition(r)
        while r.word("AND"):
            out = out & self._condition(r)
        return out

    def _condition(self, r: _Reader) -> Column:
        if r.word("NOT"):
            return ~self._condition(r)
        if r.peek() == "(":
            r.take()
            out = self._conditions(r)
            r.take(")")
            return out
        left, _ = self._term(r)
        if r.word("IN"):
            r.take("[")
            values = []
            while r.peek() != "]":
                values.append(r.value())
                if r.peek() == ",":
                    r.take()
            r.take("]")
            return left.isin(*values)
        if r.word("IS"):
            absent = not r.word("NOT")
            if not r.word("NULL"):
                raise QueryError("expected NULL")
            return left.isNull() if absent else left.isNotNull()
        for words, test in ((("CONTAINS",), F.contains), (("STARTS", "WITH"), F.startswith), (("ENDS", "WITH"), F.endswith)):
            if r.word(words[0]):
                if words[1:] and not r.word(words[1]):
                    raise QueryError(f"expected {words[1]}")
                return test(left, F.lit(r.value()) if r.peek()[:1] in ("'", '"') else self._term(r)[0])
        op = r.take()
        right = F.lit(r.value()) if r.peek()[:1] in tuple("'\"0123456789") else self._term(r)[0]
        tests = {"=": lambda: left == right, "<>": lambda: left != right, "<": lambda: left < right, ">": lambda: left > right, "<=": lambda: left <= right, ">=": lambda: left >= right}
        if op not in tests:
            raise QueryError(f"unknown comparison {op}")
        return tests[op]()

    def _items(self, r: _Reader, rows: DataFrame, counted: dict[str, str]) -> tuple[DataFrame, list[str]]:
        """The values of RETURN or WITH, grouped by those that are not aggregated, and their names."""
        distinct = r.word("DISTINCT")
        plain, aggregates, order = [], [], []
        while True:
            if r.peek().lower() in _AGGREGATES and r.peek(1) == "(":
                what = r.take().lower()
                r.take()
                only = r.word("DISTINCT")
                if r.peek() == "*" and what == "count":
                    r.take()
                    column, label = F.count(F.lit(1)), "count(*)"
                else:
                    if r.peek() in counted:
                        inner, label = F.col(counted[r.take()]), what
                    else:
                        inner, label = self._term(r)
                    column = _AGGREGATES[what](inner, only)
                r.take(")")
                name = r.name() if r.word("AS") else label
                aggregates.append(column.alias(name))
            elif r.peek()[:1] in ("'", '"'):
                value = r.value()
                name = r.name() if r.word("AS") else "value"
                plain.append(F.lit(value).alias(name))
            else:
                column, label = self._term(r)
                name = r.name() if r.word("AS") else label.replace(".", "_")
                plain.append(column.alias(name))
            order.append(name)
            if r.peek() != ",":
                break
            r.take()
        if aggregates:
            rows = (rows.groupBy(*plain) if plain else rows.groupBy()).agg(*aggregates).select(*[f"`{n}`" for n in order])
        else:
            rows = rows.select(*plain)
            rows = rows.distinct() if distinct else rows
        return rows, order

    def _return(self, r: _Reader, rows: DataFrame, counted: dict[str, str]) -> DataFrame:
        if not r.word("RETURN"):
            raise QueryError("expected RETURN")
        rows, order = self._items(r, rows, counted)
        if r.word("ORDER"):
            if not r.word("BY"):
                raise QueryError("expected BY")
            keys = []
            while True:
                name = r.name()
                if name not in order:
                    raise QueryError(f"{name} is not returned")
                keys.append(F.desc(name) if r.word("DESC") else F.asc(name) if r.word("ASC") or True else None)
                if r.peek() != ",":
                    break
                r.take()
            rows = rows.orderBy(*keys, *[n for n in order if n in rows.columns])
        if r.word("SKIP"):
            rows = rows.offset(int(r.value()))
        if r.word("LIMIT"):
            rows = rows.limit(int(r.value()))
        if r.peek():
            raise QueryError(f"unexpected {r.peek()}")
        return rows


def run(graph: Graph, text: str) -> DataFrame:
    """The rows of a query."""
    return Compiler(graph).run(text)
