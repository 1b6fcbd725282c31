"""Cleaning, schema and rule validation, row classification and conditional repair.

Every check is a boolean column; a table is validated, classified and repaired in one pass without shuffles (but for
the removal of repeated rows).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions.expr import parse, quoted, sql_expr
from netquarry.functions.scalars import TIMESTAMP_FORMATS, timestamp_sql
from netquarry.operators._columns import col


@dataclass(frozen=True)
class Numeric:
    """What a numeric column may hold. integer: missing is null and judged by allow_nan alone."""

    integer: bool = False
    allow_negative: bool = False
    allow_inf: bool = False
    allow_nan: bool = True
    minimum: float | None = 0
    maximum: float | None = None
    sentinel: tuple[float, ...] = ()


@dataclass(frozen=True)
class Text:
    """What a string column may hold: with formats it must parse as a timestamp under one of them."""

    allow_nan: bool = True
    formats: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    """A predicate that valid rows fulfil. With applies, target must equal the sentinel where that holds."""

    id: str
    expression: str
    target: str | None = None
    applies: str | None = None
    sentinel: float = -1
    constants: Mapping[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class Plan:
    """A table's schema, rules and repairs. formulas: repairable column to its formula, in order of repair."""

    schema: Mapping[str, Numeric | Text]
    rules: Sequence[Rule]
    formulas: Mapping[str, str]
    repairable_rules: frozenset[str]
    non_repairable: frozenset[str]
    chain_scope: str = "line"


def initial_cleanup(df: DataFrame, drop: Sequence[str] = (), strings: Sequence[str] = (), distinct: bool = True) -> DataFrame:
    """Trimmed names, distinct rows, without the dropped columns and repeated header rows; the rest as numbers.

    Rows are distinct over the whole table. A column to drop that is missing raises ValueError.
    """
    df = df.toDF(*[c.strip() for c in df.columns])
    if missing := [c for c in drop if c not in df.columns]:
        raise ValueError(f"columns to drop are missing: {missing}")
    if distinct:
        df = df.dropDuplicates()
    df = df.drop(*drop)
    first = df.columns[0]
    df = df.filter(~col(first).cast("string").eqNullSafe(F.lit(first)))
    return df.select(*[col(c) if c in strings else col(c).try_cast("double").alias(c) for c in df.columns])


def numeric_sql(name: str, check: Numeric) -> dict[str, str]:
    """A numeric column's checks as SQL predicates that are never null."""
    column = quoted(name)
    value = f"cast({column} AS double)"
    missing = f"({column} IS NULL OR isnan({value}))"
    kept = f"{value} IN ({', '.join(f'{float(s)!r}D' for s in check.sentinel)})" if check.sentinel else "false"
    bounds = [f"{value} >= {float(check.minimum)!r}D"] if check.minimum is not None else []
    bounds += [f"{value} <= {float(check.maximum)!r}D"] if check.maximum is not None else []
    inside = " AND ".join(bounds) or "true"
    return {
        "negative": "false" if check.allow_negative else f"(NOT {missing} AND {value} < 0 AND NOT {kept})",
        "infinite": "false" if check.allow_inf else f"(NOT {missing} AND abs({value}) = double('Infinity'))",
        "missing": "false" if check.allow_nan else missing,
        "outside": f"(CASE WHEN {missing} THEN {'false' if check.integer else 'true'} ELSE NOT ({inside}) AND NOT {kept} END)",
    }


def text_sql(name: str, check: Text) -> str:
    if check.allow_nan:
        return "false"
    value = timestamp_sql(f"cast({quoted(name)} AS string)", check.formats) if check.formats else quoted(name)
    return f"({value} IS NULL)"


def schema_sql(columns: Sequence[str], schema: Mapping[str, Numeric | Text]) -> dict[str, str]:
    if absent := [c for c in schema if c not in columns]:
        raise ValueError(f"columns are missing: {absent}")
    return {
        name: text_sql(name, check) if isinstance(check, Text) else f"({' OR '.join(x for x in numeric_sql(name, check).values() if x != 'false')})"
        for name, check in schema.items()
    }


def schema_flags(df: DataFrame, schema: Mapping[str, Numeric | Text]) -> dict[str, Column]:
    """For each column whether its value is invalid. Columns without an entry pass; missing ones raise ValueError."""
    return {name: F.expr(flag) for name, flag in schema_sql(df.columns, schema).items()}


def rule_sql(types: Mapping[str, str], rules: Sequence[Rule], chain_scope: str = "line") -> dict[str, str]:
    out = {}
    for rule in rules:
        valid = sql_expr(rule.expression, types, rule.constants, chain_scope)
        if rule.applies:
            applies = sql_expr(rule.applies, types, rule.constants, chain_scope)
            target = f"cast({quoted(rule.target)} AS double)"
            same = f"({target} = {float(rule.sentinel)!r}D)"
            valid = f"(CASE WHEN coalesce({applies}, false) THEN {same} ELSE {valid} END)"
        out[rule.id] = f"(NOT coalesce({valid}, true))"
    return out


def rule_flags(df: DataFrame, rules: Sequence[Rule], chain_scope: str = "line") -> dict[str, Column]:
    """For each rule whether a row violates it. A null outcome is no violation; a missing column raises ValueError."""
    return {name: F.expr(flag) for name, flag in rule_sql(dict(df.dtypes), rules, chain_scope).items()}


def rule_columns(rule: Rule) -> set[str]:
    return parse(rule.expression).names() - set(rule.constants)


def _any(flags: Sequence[str]) -> str:
    """Whether one of the flags, none of them null, holds.

    A sum and not a disjunction: of hundreds of disjuncts the optimizer would make as many filters and carry them
    through every projection as constraints.
    """
    return f"({' + '.join(f'int{flag}' if flag.startswith('(') else f'int({flag})' for flag in flags) or '0'} > 0)"


def _classes(df: DataFrame, plan: Plan) -> tuple[str, str, dict[str, str]]:
    """(spoilt, touched, rules): rows to drop, rows with something repairable, and each rule's flag."""
    columns, rules = schema_sql(df.columns, plan.schema), rule_sql(dict(df.dtypes), plan.rules, plan.chain_scope)
    spoilt = [columns[c] for c in plan.schema if c in plan.non_repairable] + [rules[r] for r in rules if r not in plan.repairable_rules]
    touched = [columns[c] for c in plan.schema if c in plan.formulas] + [rules[r] for r in rules if r in plan.repairable_rules]
    return _any([x for x in spoilt if x != "false"]), _any([x for x in touched if x != "false"]), rules


def classified(df: DataFrame, plan: Plan, name: str = "row_class") -> DataFrame:
    spoilt, touched, _ = _classes(df, plan)
    return df.withColumn(name, F.expr(f"CASE WHEN {spoilt} THEN 'dropped' WHEN {touched} THEN 'repairable' ELSE 'valid' END"))


def repair(df: DataFrame, plan: Plan) -> DataFrame:
    """df without spoilt rows; in the others the targets of violated repairable rules get their formulas, in order.

    All flags are taken before the first repair; a later formula sees the values earlier ones wrote.
    """
    spoilt, _, rules = _classes(df, plan)
    types = dict(df.dtypes)
    targets = {r.target: r.id for r in plan.rules if r.id in plan.repairable_rules}
    todo = [c for c in plan.formulas if c in targets]
    mark = "_repair_"
    # a violated repairable rule makes a row repairable, so no further flag is needed once spoilt rows are gone
    out = df.withColumns({f"{mark}{i}": F.expr(rules[targets[c]]) for i, c in enumerate(todo)} | {f"{mark}drop": F.expr(spoilt)})
    out = out.filter(f"NOT {mark}drop")
    written: set[str] = set()
    pending: dict[str, Column] = {}
    for i, c in enumerate(todo):
        if pending and parse(plan.formulas[c]).names() & written:
            out, pending = out.withColumns(pending), {}
        fixed = sql_expr(plan.formulas[c], types)
        pending[c] = F.expr(f"CASE WHEN {mark}{i} THEN cast({fixed} AS {types[c]}) ELSE {quoted(c)} END")
        written.add(c)
    return out.withColumns(pending).select(*[col(c) for c in df.columns])


def clean_cycles(df: DataFrame, plan: Plan, cycles: int = 2) -> DataFrame:
    """Validate and repair again and again; every cycle stays in the same plan, with no shuffle."""
    for _ in range(cycles):
        df = repair(df, plan)
    return df


def quality_metrics(df: DataFrame, plan: Plan) -> DataFrame:
    """Rows (kind, name, count): invalid cells by column and check, violations by rule, rows by class, in one pass.

    Each check is made once, as a column; a row's class and all counts are taken from these. With the checks within the
    counts the code of one row is too long to be compiled.
    """
    checks: list[tuple[str, str, str]] = []
    for name, check in plan.schema.items():
        if isinstance(check, Text):
            checks.append(("text", name, text_sql(name, check)))
        else:
            checks += [(kind, name, flag) for kind, flag in numeric_sql(name, check).items()]
    schema_sql(df.columns, plan.schema)  # raises if columns are missing
    checks += [("rule", name, flag) for name, flag in rule_sql(dict(df.dtypes), plan.rules, plan.chain_scope).items()]
    mark = {(kind, name): f"_m{i}" for i, (kind, name, flag) in enumerate(checks) if flag != "false"}
    rules = plan.repairable_rules
    spoilt = [m for (kind, n), m in mark.items() if (n not in rules if kind == "rule" else n in plan.non_repairable)]
    touched = [m for (kind, n), m in mark.items() if (n in rules if kind == "rule" else n in plan.formulas)]
    marked = df.select(*[F.expr(f"int({flag})").alias(mark[kind, name]) for kind, name, flag in checks if flag != "false"])
    some = lambda marks: " + ".join(marks) or "0"
    marked = marked.withColumns({"_spoilt": F.expr(f"int({some(spoilt)} > 0)"), "_touched": F.expr(f"int({some(touched)} > 0)")})
    counts = [(kind, name, mark.get((kind, name), "0")) for kind, name, _ in checks]
    counts += [("row", "dropped", "_spoilt"), ("row", "repairable", "_touched * (1 - _spoilt)"), ("row", "valid", "(1 - _touched) * (1 - _spoilt)")]
    one = marked.agg(*[F.expr(f"coalesce(sum({value}), 0L)").alias(f"c{i}") for i, (_, _, value) in enumerate(counts)])
    entries = [F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name"), F.col(f"c{i}").alias("count")) for i, (k, n, _) in enumerate(counts)]
    return one.select(F.explode(F.array(*entries)).alias("m")).select("m.*")


def safe_integer(column: Column) -> Column:
    """A number as bigint, null kept; one with a fraction raises instead of being cut."""
    value = column.cast("double")
    whole = value.isNull() | (value == F.floor(value))
    return F.when(whole, column.cast("bigint")).otherwise(F.raise_error(F.lit("a value with a fraction in an integer column")))


def typed(df: DataFrame, schema: Mapping[str, Numeric | Text]) -> DataFrame:
    """df's schema columns in their types and order; others are dropped, missing ones raise ValueError."""
    if absent := [c for c in schema if c not in df.columns]:
        raise ValueError(f"columns are missing: {absent}")
    out = []
    for name, check in schema.items():
        if isinstance(check, Text):
            out.append(col(name).cast("string").alias(name))
        else:
            out.append((safe_integer(col(name)) if check.integer else col(name).cast("double")).alias(name))
    return df.select(*out)


TIMESTAMP_TEXT = Text(allow_nan=False, formats=TIMESTAMP_FORMATS)
