"""Schedule labels: time ranges with sets of addresses, ports and conditions, compiled to one column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netquarry.functions.scalars import parsed_timestamp
from netquarry.operators._columns import col
from netquarry.session import settled

PROTOCOLS = {"tcp": 6, "udp": 17, "icmp": 1}


@dataclass(frozen=True)
class AttackRule:
    """Inclusive times; a set that is None matches anything, an empty one nothing. conditions: trees that all hold."""

    label: str
    start: datetime
    finish: datetime
    src_ips: tuple[str, ...] | None = None
    dst_ips: tuple[str, ...] | None = None
    dst_ports: tuple[int, ...] | None = None
    protocol: int | None = None
    payload_filter: bool = False
    conditions: tuple[Mapping, ...] = ()


@dataclass(frozen=True)
class FlowColumns:
    timestamp: str = "Timestamp"
    flow_id: str = "Flow ID"
    src_ip: str = "Source IP"
    dst_ip: str = "Destination IP"
    dst_port: str = "Destination Port"
    protocol: str = "Protocol"
    payload: str = "Total Length of Fwd Packets"


def utc(text: str) -> datetime:
    """An ISO 8601 time as naive UTC."""
    found = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return found.astimezone(timezone.utc).replace(tzinfo=None) if found.tzinfo else found


def protocol_number(value: str | int | None) -> int | None:
    if value is None:
        return None
    return PROTOCOLS[str(value).lower()] if str(value).lower() in PROTOCOLS else int(value)


def load_schedule(schedule: Mapping) -> list[AttackRule]:
    """The rules of days -> attacks -> rules, in order."""
    tup = lambda x: None if x is None else tuple(x)
    return [
        AttackRule(
            rule["label"],
            utc(str(rule["start"])),
            utc(str(rule["finish"])),
            tup(rule.get("src_ips")),
            tup(rule.get("dst_ips")),
            tup(rule.get("dst_ports")),
            protocol_number(rule.get("protocol")),
            bool(rule.get("payload_filter", False)),
            tuple(rule.get("extra_conditions") or ()),
        )
        for day in schedule["days"]
        for attack in day["attacks"]
        for rule in attack["rules"]
    ]


def condition(tree: Mapping) -> Column:
    """A condition tree as a column: any_of, all_of, or feature, op and value.

    A string value compares texts, another compares numbers; where the feature is no number the condition is false,
    whatever its op.
    """
    for key, joined in (("any_of", lambda a, b: a | b), ("all_of", lambda a, b: a & b)):
        if key in tree:
            found = F.lit(key == "all_of")
            for part in tree[key]:
                found = joined(found, condition(part))
            return found
    value, op = tree["value"], tree["op"]
    members = list(value) if op in ("in", "not_in") else [value]
    texts = all(isinstance(v, str) for v in members) and bool(members)
    left = col(tree["feature"]).cast("string") if texts else col(tree["feature"]).try_cast("double")
    right = members if texts else [float(v) for v in members]
    if op in ("in", "not_in"):
        found = left.isin(right) if right else F.lit(False)
        found = ~found if op == "not_in" else found
    else:
        one = F.lit(right[0])
        found = {"eq": left == one, "ne": left != one, "gt": left > one, "gte": left >= one, "lt": left < one, "lte": left <= one}[op]
    return F.coalesce(F.when(left.isNotNull(), found), F.lit(False))


def rule_column(rule: AttackRule, time: Column, columns: FlowColumns = FlowColumns()) -> Column:
    found = time.between(F.lit(rule.start), F.lit(rule.finish))
    for members, name in ((rule.src_ips, columns.src_ip), (rule.dst_ips, columns.dst_ip)):
        if members is not None:
            found = found & (col(name).isin(list(members)) if members else F.lit(False))
    if rule.dst_ports is not None:
        found = found & (col(columns.dst_port).try_cast("int").isin(list(rule.dst_ports)) if rule.dst_ports else F.lit(False))
    if rule.protocol is not None:
        found = found & (col(columns.protocol).try_cast("int") == rule.protocol)
    if rule.payload_filter:
        found = found & (col(columns.payload).try_cast("double") == 0)
    for tree in rule.conditions:
        found = found & condition(tree)
    return F.coalesce(found, F.lit(False))


def label_column(
    rules: Sequence[AttackRule], time: Column, columns: FlowColumns = FlowColumns(), default: str = "Benign", artifacts: Sequence[str] = ()
) -> Column:
    """The label of the last rule that matches, else the default; artifact flow ids always get the default."""
    found = F.coalesce(*[F.when(rule_column(r, time, columns), F.lit(r.label)) for r in reversed(rules)], F.lit(default))
    return F.when(col(columns.flow_id).isin(list(artifacts)), F.lit(default)).otherwise(found) if artifacts else found


def label_flows(
    flows: DataFrame,
    rules: Sequence[AttackRule],
    *,
    columns: FlowColumns = FlowColumns(),
    default: str = "Benign",
    artifacts: Sequence[str] = (),
    protocols: Sequence[str] = ("6", "17"),
    label: str = "Label",
) -> DataFrame:
    """Flows of the given protocols with their label added or replaced. The filter comes first and reaches the scan."""
    kept = flows.filter(col(columns.protocol).cast("string").isin(list(protocols)))
    kind = dict(flows.dtypes)[columns.timestamp]
    time = parsed_timestamp(col(columns.timestamp)) if kind == "string" else col(columns.timestamp)
    return kept.withColumn(label, label_column(rules, time, columns, default, artifacts))


RULES = (
    "ordinal long, label string, start timestamp, finish timestamp, src_ips array<string>, dst_ips array<string>, dst_ports array<int>, "
    "protocol int, payload_filter boolean, conditions array<int>"
)


def rule_table(spark: SparkSession, rules: Sequence[AttackRule]) -> tuple[DataFrame, list[Mapping]]:
    """Rules as a table of RULES, ordinals in their order, and the condition trees that its conditions name by place."""
    trees: list[Mapping] = []
    for rule in rules:
        trees += [t for t in rule.conditions if t not in trees]
    listed = lambda x: None if x is None else list(x)
    utc_time = lambda t: t.replace(tzinfo=timezone.utc)
    rows = [
        (i, r.label, utc_time(r.start), utc_time(r.finish), listed(r.src_ips), listed(r.dst_ips), listed(r.dst_ports), r.protocol, r.payload_filter, [trees.index(t) for t in r.conditions])
        for i, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, RULES), trees


def label_by_table(
    flows: DataFrame,
    rules: DataFrame,
    trees: Sequence[Mapping] = (),
    *,
    columns: FlowColumns = FlowColumns(),
    default: str = "Benign",
    artifacts: Sequence[str] = (),
    protocols: Sequence[str] = ("6", "17"),
    label: str = "Label",
) -> DataFrame:
    """label_flows by a table of rules (RULES), of which there may be very many: the last one that matches, by ordinal, wins.

    No flow is tested against a rule. The rules' starts and ends cut time into pieces, which are numbered in order; a rule
    is a run of pieces and is filed under runs of 1, 2, 4 ... pieces, two of each length at most, with the members of its
    sets, a place for each. A place keeps its last rule, and a flow looks into one place of each length for each kind of
    rule: rules are of one kind if they ask for the same columns and conditions. So the work grows with flows and with
    rules, by the number of bits of the pieces' count and by the kinds. A null set, protocol or list of conditions asks for
    nothing, a rule without an end or label matches nothing.
    """
    kept = flows.filter(col(columns.protocol).cast("string").isin(list(protocols)))
    kind = dict(flows.dtypes)[columns.timestamp]
    time = parsed_timestamp(col(columns.timestamp)) if kind == "string" else col(columns.timestamp)
    ident, best = "_x_id", "_x_best"
    told = settled(kept.withColumns({ident: F.monotonically_increasing_id(), "_x_at": F.unix_micros(time.cast("timestamp"))}), "flows")
    able = rules.filter("start <= finish and label is not null")
    named = F.filter(F.coalesce("conditions", F.array().cast("array<int>")), lambda i: (i >= 0) & (i < len(trees)))
    dims = {"src": "src_ips", "dst": "dst_ips", "port": "dst_ports", "number": "protocol"}
    asks = {f"_ask_{d}": F.col(c).isNotNull() for d, c in dims.items()} | {"_ask_payload": F.coalesce("payload_filter", F.lit(False)), "_ask_trees": F.array_sort(F.array_distinct(named))}
    able = able.withColumns(asks | {"_low": F.unix_micros("start"), "_over": F.unix_micros("finish") + 1})
    # of rules with equal times and demands only the last can win
    demands = [*asks, *dims.values()]
    able = able.groupBy("_low", "_over", *demands).agg(F.max(F.struct("ordinal", "label")).alias(best))
    able = settled(able, "rules")
    kinds = [tuple(r) for r in able.select(*asks).distinct().collect()]  # 32 at most for each set of conditions that rules have

    flow = {
        "src": col(columns.src_ip).cast("string"),
        "dst": col(columns.dst_ip).cast("string"),
        "port": col(columns.dst_port).try_cast("int"),
        "number": col(columns.protocol).try_cast("int"),
    }
    blank = {d: F.lit("" if d in ("src", "dst") else 0) for d in dims}
    payload = col(columns.payload).try_cast("double")

    def place(i: int, asked: tuple) -> Column:
        """Where a flow looks for rules of a kind, null if it can't match any."""
        chosen = {d: flow[d] if asked[k] else blank[d] for k, d in enumerate(dims)}
        fits = F.lit(True)
        for value in chosen.values():
            fits = fits & value.isNotNull()
        fits = fits & (payload == 0) if asked[4] else fits
        for tree in asked[5]:
            fits = fits & condition(trees[tree])
        return F.when(fits, F.struct(F.lit(i).alias("kind"), *[v.alias(d) for d, v in chosen.items()]))

    places = F.array(*[place(i, asked) for i, asked in enumerate(kinds)]) if kinds else F.lit(None).cast("array<struct<kind:int,src:string,dst:string,port:int,number:int>>")
    edges = able.select(F.col("_low").alias("_x_at")).union(able.select("_over")).distinct()
    marks = edges.select("_x_at", F.lit(1).alias("_edge"), F.lit(None).cast("long").alias(ident), F.lit(None).cast("array<struct<kind:int,src:string,dst:string,port:int,number:int>>").alias("_places"))
    marks = marks.unionAll(told.filter("_x_at is not null").select("_x_at", F.lit(0), ident, F.filter(places, lambda p: p.isNotNull())))
    pieces = placed(marks.orderBy("_x_at", F.desc("_edge"), ident), "_piece", "_edge")
    number = pieces.filter("_edge = 1").select("_x_at", "_piece")
    bits = max(1, number.count().bit_length())

    code = F.lit(None).cast("int")
    for i, asked in enumerate(kinds):
        same = F.col("_ask_trees") == F.array(*[F.lit(t) for t in asked[5]]).cast("array<int>")
        for value, name in zip(asked[:5], list(asks)[:5], strict=True):
            same = same & (F.col(name) == value)
        code = F.when(same, i).otherwise(code)
    filed = able.withColumn("kind", code)
    for name, edge in (("_from", "_low"), ("_to", "_over")):
        filed = filed.join(number.select(F.col("_x_at").alias(edge), F.col("_piece").alias(name)), edge)
    for d, c in list(dims.items())[:3]:
        filed = filed.withColumn(d, F.explode(F.when(F.col(c).isNull(), F.array(blank[d])).otherwise(F.col(c)))).filter(F.col(d).isNotNull())
    key = ["kind", *dims]
    filed = filed.withColumn("number", F.coalesce("protocol", blank["number"])).groupBy(*key, "_from", "_to").agg(F.max(best).alias(best))
    runs = filed.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(bits))))
    runs = runs.withColumns({"_from": F.expr("shiftright(_from + shiftleft(1L, _level) - 1, _level)"), "_to": F.expr("shiftright(_to, _level)")}).filter("_from < _to")
    own = F.array(F.when(F.col("_from") % 2 == 1, F.col("_from")), F.when(F.col("_to") % 2 == 1, F.col("_to") - 1))
    runs = runs.select(*key, "_level", best, F.explode(own).alias("_run")).filter("_run is not null")
    runs = settled(runs.groupBy(*key, "_level", "_run").agg(F.max(best).alias(best)), "rule-runs")

    looks = pieces.filter("_edge = 0").select(ident, "_piece", F.explode("_places").alias("_place")).select(ident, "_piece", "_place.*")
    looks = settled(looks.join(runs.select(*key).distinct(), key, "left_semi"), "flow-places")
    once = looks.select(*key, "_piece").distinct().withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(bits))))
    once = once.withColumn("_run", F.expr("shiftright(_piece, _level)")).join(runs, [*key, "_level", "_run"])
    once = once.groupBy(*key, "_piece").agg(F.max(best).alias(best))
    hits = looks.join(once, [*key, "_piece"]).groupBy(ident).agg(F.max(best).alias(best))
    made = F.coalesce(F.col(f"{best}.label"), F.lit(default))
    made = F.when(col(columns.flow_id).isin(list(artifacts)), F.lit(default)).otherwise(made) if artifacts else made
    return told.join(hits, ident, "left").withColumn(label, made).select(*[col(c) for c in flows.columns if c != label], label)


def dropped_count(flows: DataFrame, columns: FlowColumns = FlowColumns(), protocols: Sequence[str] = ("6", "17")) -> DataFrame:
    """How many rows label_flows leaves out for their protocol."""
    kept = col(columns.protocol).cast("string").isin(list(protocols))
    return flows.agg(F.count_if(~F.coalesce(kept, F.lit(False))).alias("dropped"))


def label_counts(flows: DataFrame, label: str = "Label") -> DataFrame:
    return flows.groupBy(label).count()


def sorted_flows(flows: DataFrame, columns: FlowColumns = FlowColumns(), ordinal: str | None = None) -> DataFrame:
    """Flows in total order of time and flow id as texts, in code points; the ordinal keeps equal rows stable."""
    keys = [col(columns.timestamp), col(columns.flow_id), *([col(ordinal)] if ordinal else [])]
    return flows.orderBy(*keys)


def placed_flows(flows: DataFrame, columns: FlowColumns = FlowColumns(), ordinal: str | None = None, name: str = "place") -> DataFrame:
    """Flows with their place from 1 in the total order of sorted_flows.

    The range-sorted rows are written once, with their partition and their place in it; only the row counts of the
    partitions are summed up. A task that runs again can't change a place, as it could in a plan that sorts twice.
    """
    return placed(sorted_flows(flows, columns, ordinal), name)


def placed(ordered: DataFrame, name: str, counted: str | None = None) -> DataFrame:
    """Rows in a total order with their place in it from 1; written once, so places stay.

    counted: a column of 0 and 1; the place is then how many rows with 1 there are up to the row.
    """
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    kept = settled(ordered.withColumns({"_part": F.spark_partition_id(), "_at": within}), "sorted-rows")
    before, starts = 0, []
    total = F.sum(counted) if counted else F.count("*")
    for part, n in sorted(map(tuple, kept.groupBy("_part").agg(total).collect())):  # a row per partition
        starts.append((part, before))
        before += n
    found = kept.join(F.broadcast(kept.sparkSession.createDataFrame(starts, "_part int, _before long")), "_part")
    own = F.sum(counted).over(Window.partitionBy("_part").orderBy("_at")) if counted else F.col("_at") + 1
    return found.withColumn(name, F.col("_before") + own).drop("_part", "_at", "_before")


def renamed(df: DataFrame, sources: Mapping[str, str]) -> DataFrame:
    """Columns target <- source; a source may serve several targets. Missing sources raise, all of them named."""
    if missing := sorted({s for s in sources.values() if s not in df.columns}):
        raise ValueError(f"source columns are missing: {missing}")
    return df.select(*[col(s).alias(t) for t, s in sources.items()])
