"""The rule and formula language, compiled to Spark columns.

Tokens are separated by white space; parentheses stand alone anywhere. Neighbouring words that are no operators make
one name, so names of several words need no quotes. Words that read as numbers are numbers. Operators, by strength:
``**`` (from the right), ``* / %``, ``+ -``, comparisons with ``IN`` and ``NOTIN``, ``AND``, ``OR``; words of operators
may be in either case. As extensions there are ``NOT``, ``TRUE`` and ``FALSE``.

``a <= b <= c`` means ``a <= b AND b <= c``. With chain_scope "line" only comparisons on one source line are taken as
a chain, and only around a single name or number; others group from the left, so that a truth value is compared with
a number. "expression" takes every chain as it is meant.

Numbers follow floating-point rules: a comparison with NaN is false (``!=`` is true), division by zero gives an
infinity or NaN, ``%`` has the divisor's sign. A null operand gives null.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

STRENGTH = {
    "OR": 1, "AND": 2, "<": 3, "<=": 3, ">": 3, ">=": 3, "==": 3, "!=": 3, "IN": 3, "NOTIN": 3,
    "+": 4, "-": 4, "*": 5, "/": 5, "%": 5, "**": 6,
}
COMPARISONS = {op for op, strength in STRENGTH.items() if strength == 3}
TRUTH = COMPARISONS | {"AND", "OR", "NOT"}


@dataclass(frozen=True)
class Node:
    """op with its operands, or a leaf: op "name" or "number" with value. line: of the operator or leaf."""

    op: str
    args: tuple[Node, ...] = ()
    value: object = None
    line: int = 0

    @property
    def is_truth(self) -> bool:
        return self.op in TRUTH or self.op == "truth"

    def names(self) -> set[str]:
        return {self.value} if self.op == "name" else set().union(*[a.names() for a in self.args])


def tokens(text: str) -> list[tuple[str, object, int]]:
    """(kind, value, line) with kind one of op, number, name, (, )."""
    out: list[tuple[str, object, int]] = []
    for line, source in enumerate(text.splitlines()):
        grows = False  # whether the last name takes the next word
        for word in source.replace("(", " ( ").replace(")", " ) ").split():
            upper = word.upper()
            if word in "()":
                out.append((word, word, line))
            elif upper in STRENGTH or upper == "NOT":
                out.append(("op", upper, line))
            elif grows:
                out[-1] = ("name", f"{out[-1][1]} {word}", line)
                continue
            else:
                try:
                    out.append(("number", float(word), line))
                except ValueError:
                    out.append(("name", word, line))
                    grows = True
                    continue
            grows = False
    return out


class _Parser:
    def __init__(self, text: str, chain_scope: str):
        self.tokens, self.at, self.scope, self.text = tokens(text), 0, chain_scope, text

    def peek(self) -> tuple[str, object, int]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None, -1)

    def take(self) -> tuple[str, object, int]:
        token = self.peek()
        self.at += 1
        return token

    def fail(self) -> ValueError:
        return ValueError(f"malformed expression: {self.text!r}")

    def primary(self) -> Node:
        kind, value, line = self.take()
        if kind == "(":
            inner = self.expression(0)
            if self.take()[0] != ")":
                raise self.fail()
            return inner
        if kind == "op" and value == "NOT":
            return Node("NOT", (self.expression(3),), line=line)
        if kind == "number":
            return Node("number", value=value, line=line)
        if kind == "name":
            if value.upper() in ("TRUE", "FALSE"):
                return Node("truth", value=value.upper() == "TRUE", line=line)
            return Node("name", value=value, line=line)
        raise self.fail()

    def chained(self, left: Node, last: Node | None, line: int) -> bool:
        """Whether the comparison that comes next goes on from last, the right side of the one before."""
        if last is None:
            return False
        if self.scope == "expression":
            return True
        return left.line == line and last.op in ("name", "number", "truth") and not last.args

    def expression(self, least: int) -> Node:
        left, last = self.primary(), None
        while True:
            kind, op, line = self.peek()
            if kind != "op" or op == "NOT" or STRENGTH[op] < least:
                return left
            self.take()
            right = self.expression(STRENGTH[op] if op == "**" else STRENGTH[op] + 1)
            if op in COMPARISONS:
                if self.chained(left, last, line):
                    left = Node("AND", (left, Node(op, (last, right), line=line)), line=line)
                else:
                    left = Node(op, (left, right), line=line)
                last = right
            else:
                left, last = Node(op, (left, right), line=line), None


@lru_cache(maxsize=4096)
def parse(text: str, chain_scope: str = "line") -> Node:
    if chain_scope not in ("line", "expression"):
        raise ValueError(f"unknown chain scope: {chain_scope}")
    parser = _Parser(text, chain_scope)
    tree = parser.expression(0)
    if parser.peek()[0] != "end":
        raise parser.fail()
    return tree


def _number(column: Column, node: Node) -> Column:
    return column.cast("double") if node.is_truth else column


def _divided(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    unbounded = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, F.when(a.isNotNull(), unbounded)).otherwise(F.try_divide(a, b))


def _modulo(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, F.when(a.isNotNull(), F.lit(float("nan")))).otherwise(a - b * F.floor(F.try_divide(a, b)))


def _compared(op: str, a: Column, b: Column, guarded: bool) -> Column:
    found = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op]
    return F.when(F.isnan(a) | F.isnan(b), F.lit(op == "!=")).otherwise(found) if guarded else found


class Compiler:
    """Names are columns of the given types, or constants (a list is an operand of IN)."""

    def __init__(self, types: Mapping[str, str], constants: Mapping[str, object] | None = None, columns: Mapping[str, Column] | None = None):
        self.types, self.constants, self.columns = types, constants or {}, columns or {}

    def may_be_nan(self, node: Node) -> bool:
        if node.op == "name":
            return self.types.get(node.value, "") in ("double", "float") and node.value not in self.constants
        return node.op in ("/", "%", "**") or (node.op in ("+", "-", "*") and any(map(self.may_be_nan, node.args)))

    def text(self, node: Node) -> bool:
        return node.op == "name" and (
            isinstance(self.constants.get(node.value), str) if node.value in self.constants else self.types.get(node.value) == "string"
        )

    def column(self, node: Node) -> Column:
        if node.op in ("number", "truth"):
            return F.lit(node.value)
        if node.op == "name":
            if node.value in self.columns:
                return self.columns[node.value]
            if node.value in self.constants:
                return F.lit(self.constants[node.value])
            if node.value in self.types:
                return F.col(f"`{node.value}`")
            raise ValueError(f"no column or constant named {node.value!r}")
        if node.op == "NOT":
            return ~self.column(node.args[0])
        a, b = node.args
        if node.op in ("AND", "OR"):
            x, y = self.column(a), self.column(b)
            return x & y if node.op == "AND" else x | y
        if node.op in ("IN", "NOTIN"):
            members = self.constants.get(b.value) if b.op == "name" else None
            if members is None or isinstance(members, str):
                raise ValueError("IN needs a list constant")
            found = F.coalesce(self.column(a).isin(list(members)), F.lit(False))
            return found if node.op == "IN" else ~found
        x, y = _number(self.column(a), a), _number(self.column(b), b)
        if node.op in COMPARISONS:
            numbers = not (self.text(a) or self.text(b))
            return _compared(node.op, x, y, numbers and (self.may_be_nan(a) or self.may_be_nan(b)))
        if node.op == "/":
            return _divided(x, y)
        if node.op == "%":
            return _modulo(x, y)
        if node.op == "**":
            return F.pow(x, y)
        x, y = x.cast("double"), y.cast("double")
        return {"+": x + y, "-": x - y, "*": x * y}[node.op]


def compile_expr(
    text: str,
    types: Mapping[str, str],
    constants: Mapping[str, object] | None = None,
    chain_scope: str = "line",
    columns: Mapping[str, Column] | None = None,
) -> Column:
    """The Column of an expression over columns with the given types (dict(df.dtypes)). Unknown names raise ValueError."""
    return Compiler(types, constants, columns).column(parse(text, chain_scope))


def _literal(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        number = float(value)
        return f"double('{number}')" if number != number or number in (float("inf"), float("-inf")) else f"{number!r}D"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class SqlWriter(Compiler):
    """The same meaning as Spark SQL text: hundreds of predicates are then one call to the engine each."""

    def sql(self, node: Node) -> str:
        if node.op in ("number", "truth"):
            return _literal(node.value)
        if node.op == "name":
            if node.value in self.constants:
                return _literal(self.constants[node.value])
            if node.value in self.types:
                return quoted(node.value)
            raise ValueError(f"no column or constant named {node.value!r}")
        if node.op == "NOT":
            return f"(NOT {self.sql(node.args[0])})"
        a, b = node.args
        if node.op in ("AND", "OR"):
            return f"({self.sql(a)} {node.op} {self.sql(b)})"
        if node.op in ("IN", "NOTIN"):
            members = self.constants.get(b.value) if b.op == "name" else None
            if members is None or isinstance(members, str):
                raise ValueError("IN needs a list constant")
            found = f"coalesce({self.sql(a)} IN ({', '.join(map(_literal, members))}), false)" if members else "false"
            return found if node.op == "IN" else f"(NOT {found})"
        x, y = (f"cast({self.sql(n)} AS double)" if n.is_truth else self.sql(n) for n in (a, b))
        if node.op in COMPARISONS:
            op = {"==": "=", "!=": "<>"}.get(node.op, node.op)
            if not (self.text(a) or self.text(b)) and (self.may_be_nan(a) or self.may_be_nan(b)):
                other = "true" if node.op == "!=" else "false"
                return f"(CASE WHEN isnan({x}) OR isnan({y}) THEN {other} ELSE {x} {op} {y} END)"
            return f"({x} {op} {y})"
        x, y = f"cast({x} AS double)", f"cast({y} AS double)"
        if node.op == "/":
            edge = f"CASE WHEN isnan({x}) OR {x} = 0 THEN double('NaN') WHEN {x} > 0 THEN double('Infinity') ELSE double('-Infinity') END"
            return f"(CASE WHEN {y} = 0 THEN CASE WHEN {x} IS NOT NULL THEN {edge} END ELSE try_divide({x}, {y}) END)"
        if node.op == "%":
            return f"(CASE WHEN {y} = 0 THEN CASE WHEN {x} IS NOT NULL THEN double('NaN') END ELSE {x} - {y} * floor(try_divide({x}, {y})) END)"
        return f"pow({x}, {y})" if node.op == "**" else f"({x} {node.op} {y})"


def sql_expr(text: str, types: Mapping[str, str], constants: Mapping[str, object] | None = None, chain_scope: str = "line") -> str:
    """The expression as Spark SQL text; see compile_expr."""
    return SqlWriter(types, constants).sql(parse(text, chain_scope))
