"""Plans from YAML or JSON: validation, schedule, trailing features and window states as data instead of code."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import SparkSession

from netquarry.operators.labels import FlowColumns
from netquarry.operators.quality import TIMESTAMP_TEXT, Numeric, Plan, Rule, Text
from netquarry.operators.states import StateColumns
from netquarry.operators.windows import Feature, Stream

try:
    import yaml
except ImportError:  # JSON is still read
    yaml = None


def parse_config(text: str) -> dict:
    """A mapping from JSON or YAML text; anything else raises ValueError."""
    try:
        found = json.loads(text)
    except ValueError:
        if yaml is None:
            raise ValueError("the text is no JSON, and YAML is not installed") from None
        try:
            found = yaml.safe_load(text)
        except yaml.YAMLError as error:
            raise ValueError(f"the text is neither JSON nor YAML: {error}") from error
    if not isinstance(found, dict):
        raise ValueError("the configuration is no mapping")
    return found


def read_config(spark: SparkSession, path: str) -> dict:
    """parse_config of a small file in any store that Spark reads; a missing file raises."""
    return parse_config(spark.read.text(path, wholetext=True).first()[0])


def _known(kind: type, entry: Mapping, what: str) -> dict:
    """entry's items, if the dataclass has fields for all of them; lists become tuples."""
    names = {f.name for f in fields(kind)}
    if unknown := sorted(set(entry) - names):
        raise ValueError(f"unknown entries of {what}: {unknown}")
    return {k: tuple(v) if isinstance(v, list) else v for k, v in entry.items()}


def column_check(name: str, entry: Mapping) -> Numeric | Text:
    """type: numeric (with the fields of Numeric), text or timestamp."""
    entry = dict(entry)
    kind = entry.pop("type", "numeric")
    if kind == "numeric":
        return Numeric(**_known(Numeric, entry, name))
    if kind == "timestamp":
        return Text(**{"allow_nan": False, "formats": TIMESTAMP_TEXT.formats} | _known(Text, entry, name))
    if kind == "text":
        return Text(**_known(Text, entry, name))
    raise ValueError(f"unknown type of {name}: {kind}")


def plan_from(config: Mapping) -> Plan:
    """A validation plan: columns, rules, formulas, repairable_rules, ignored (columns that never make a row invalid)."""
    schema = {name: column_check(name, entry or {}) for name, entry in config["columns"].items()}
    rules = tuple(Rule(**_known(Rule, entry, "a rule")) for entry in config.get("rules", ()))
    formulas = dict(config.get("formulas", {}))
    repairable = frozenset(config.get("repairable_rules", ()))
    if unknown := sorted(repairable - {r.id for r in rules}):
        raise ValueError(f"repairable rules that don't exist: {unknown}")
    spoiling = frozenset(schema) - frozenset(formulas) - frozenset(config.get("ignored", ()))
    return Plan(schema, rules, formulas, repairable, spoiling, config.get("chain_scope", "line"))


def history_from(config: Mapping) -> tuple[dict[str, Stream], list[Feature], dict[str, object], float]:
    """streams, features, constants and window_seconds of behaviour_features."""
    streams = {name: Stream(**_known(Stream, entry, name)) for name, entry in config["streams"].items()}
    features = [Feature(**_known(Feature, entry, "a feature")) for entry in config["features"]]
    if unknown := sorted({f.stream for f in features} - set(streams)):
        raise ValueError(f"unknown streams: {unknown}")
    return streams, features, dict(config.get("constants", {})), float(config.get("window_seconds", 300))


@dataclass(frozen=True)
class Sides:
    """What is aggregated for hosts or edges. At export the hosts' columns have a prefix for either direction."""

    sums: tuple[str, ...] = ()
    means: tuple[str, ...] = ()
    ratios: tuple[str, ...] = ()


@dataclass(frozen=True)
class StatesPlan:
    """The window states of a flow table. delta_global, delta_hosts: features whose change is added; none: no delta."""

    columns: StateColumns = StateColumns()
    window: str = "60 seconds"
    numbers: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    sums: tuple[str, ...] = ()
    means: tuple[str, ...] = ()
    stds: tuple[str, ...] = ()
    maxima: tuple[str, ...] = ()
    protocol_values: tuple[int, ...] = (0, 6, 17)
    hosts: Sides = Sides()
    edges: Sides = Sides()
    undirected: bool = False
    k: int = 50
    select_by: str = "flow_count"
    delta_global: tuple[str, ...] = ()
    delta_hosts: tuple[str, ...] = ()
    attacks: tuple[str, ...] = ()
    benign: str = "Benign"
    train_ratio: float = 0.7
    clip: float = 10.0
    aggregates: tuple[tuple[str, str, str], ...] = field(default=())


def states_from(config: Mapping) -> StatesPlan:
    """A StatesPlan; aggregates is a list of {output_name, column, aggregation}."""
    entry = dict(config)
    entry["columns"] = StateColumns(**_known(StateColumns, entry.get("columns", {}), "columns"))
    for name in ("hosts", "edges"):
        entry[name] = Sides(**_known(Sides, entry.get(name, {}), name))
    made: Sequence[Mapping] = entry.get("aggregates", ())
    entry["aggregates"] = tuple((a["output_name"], a["column"], a["aggregation"]) for a in made)
    return StatesPlan(**_known(StatesPlan, entry, "the states"))


def flow_columns(config: Mapping) -> FlowColumns:
    return FlowColumns(**_known(FlowColumns, config, "the flow columns"))
