"""End-to-end jobs: flow CSV to clean Parquet, to labelled and ordered CSV, and to scaled window states."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.functions.scalars import parsed_timestamp
from netquarry.operators import joins, labels, quality, scaling, states, windows
from netquarry.operators._columns import col
from netquarry.operators.labels import AttackRule, FlowColumns
from netquarry.operators.quality import Plan, Text
from netquarry.plans.config import StatesPlan
from netquarry.session import scratch, settled
from netquarry.sources import pcap, tables


def clean_job(
    spark: SparkSession, source: str | Sequence[str], target: str, plan: Plan, *, drop: Sequence[str] = (), cycles: int = 2, reports: str | None = None
) -> DataFrame:
    """Flow CSV to Parquet of valid rows: names trimmed, repeated rows and headers gone, cycles of check and repair, types.

    reports: a folder for each cycle's counts. A column of the plan that the files lack raises ValueError. Returns the
    written table.
    """
    texts = [name for name, check in plan.schema.items() if isinstance(check, Text)]
    with scratch(spark):
        # each cycle's counts and the result read the cleaned rows, which are made once
        rows = settled(quality.initial_cleanup(tables.read_csv(spark, source), drop, texts), "cleaned")
        for cycle in range(cycles):
            if reports:
                tables.write_report(quality.quality_metrics(rows, plan), reports, cycle)
            # written, since the checks of one cycle upon the repairs of another are too long to be compiled
            rows = settled(quality.repair(rows, plan), "repaired")
        tables.write_parquet(quality.typed(rows, plan.schema), target, level=3)
    return spark.read.parquet(target)


@dataclass(frozen=True)
class Labelled:
    rows: int
    dropped: int
    by_label: dict[str, int]


def label_job(
    spark: SparkSession,
    source: str | Sequence[str],
    target: str,
    rules: Sequence[AttackRule],
    *,
    columns: FlowColumns = FlowColumns(),
    default: str = "Benign",
    artifacts: Sequence[str] = (),
    protocols: Sequence[str] = ("6", "17"),
    label: str = "Label",
) -> Labelled:
    """Flow CSV to labelled CSV in total order of time and flow id; the counts of rows, of those left out, and by label."""
    flows = tables.read_csv(spark, source)
    marked = labels.label_flows(flows, rules, columns=columns, default=default, artifacts=artifacts, protocols=protocols, label=label)
    rows = tables.write_csv(labels.sorted_flows(marked, columns), target)
    written = tables.read_csv(spark, target, marked.columns)
    counts = {r[label]: r["count"] for r in labels.label_counts(written, label).collect()}  # a row per label
    return Labelled(rows, labels.dropped_count(flows, columns, protocols).first()[0], counts)


@dataclass(frozen=True)
class States:
    """Tables of a flow table's windows, sparse: a row per window, window and host, window and edge."""

    windows: DataFrame
    hosts: DataFrame
    edges: DataFrame
    labels: DataFrame | None


def build_states(flows: DataFrame, plan: StatesPlan) -> States:
    """The states of flows (any column types; times may be text). Raises ValueError if no time can be read.

    Deltas stand beside the features they are of, as delta_ columns, where the plan asks for them.
    """
    c = plan.columns
    time = col(c.timestamp)
    if dict(flows.dtypes)[c.timestamp] == "string":
        time = parsed_timestamp(time)
    keep = [c.src, c.dst, c.label, "_time"]
    held = states.clean_numbers(flows.withColumn("_time", time).select(*keep, c.dst_port, c.protocol, *plan.numbers), keep)
    held = settled(states.with_window(held, "_time", plan.window), "flows")
    if held.isEmpty() and not flows.isEmpty():
        raise ValueError("no time of the flows can be read")
    found = states.global_state(
        held, unique=plan.unique, sums=plan.sums, means=plan.means, stds=plan.stds, maxima=plan.maxima, protocol=c.protocol, protocol_values=plan.protocol_values
    )
    if plan.aggregates:
        found = found.join(states.declared_aggregates(held, plan.aggregates), "window_start")
    found = settled(found, "window-states")
    if plan.delta_global:
        found = found.join(states.delta_global(found, plan.delta_global), "window_start")
    hosts = states.host_features(held, columns=c, sums=plan.hosts.sums, means=plan.hosts.means, ratios=plan.hosts.ratios)
    hosts = settled(states.top_hosts(hosts, plan.k, plan.select_by), "host-states")
    edges = states.edge_table(held, columns=c, sums=plan.edges.sums, means=plan.edges.means, ratios=plan.edges.ratios)
    edges = states.edges_between(edges, hosts)
    if plan.undirected:
        edges = states.undirected(edges, extra=("i", "j"))
    if plan.delta_hosts:
        hosts = hosts.join(states.delta_host(hosts, plan.delta_hosts), ["window_start", "host", "place"])
    marks = states.window_labels(held, plan.attacks, plan.benign, c.label) if plan.attacks else None
    return States(found, hosts, edges, marks)


def feature_names(table: DataFrame) -> list[str]:
    """What a state table has beside its keys."""
    return [c for c in table.columns if c not in ("window_start", "host", "place", "src", "dst", "i", "j")]


def scale_states(found: States, plan: StatesPlan) -> tuple[States, dict[str, DataFrame]]:
    """The states scaled by the training windows' population statistics, and the scalers by table."""
    train = settled(scaling.training_windows(found.windows, plan.train_ratio).filter("train").select("window_start"), "training")
    scaled, scalers = {}, {}
    for name in ("windows", "hosts", "edges"):
        table = getattr(found, name)
        names = feature_names(table)
        scalers[name] = settled(scaling.fit_scaler(table.join(train, "window_start", "left_semi"), names), f"scaler-{name}")
        scaled[name] = scaling.apply_scaler(table, scalers[name], names, plan.clip)
    return States(scaled["windows"], scaled["hosts"], scaled["edges"], found.labels), scalers


def states_job(spark: SparkSession, source: str | Sequence[str], target: str, plan: StatesPlan) -> DataFrame:
    """Flow CSV to scaled tensors per window, with their feature names, labels and scalers; returns the written tensors."""
    scaled, scalers = scale_states(build_states(tables.read_csv(spark, source), plan), plan)
    names = {"global": feature_names(scaled.windows), "host": feature_names(scaled.hosts), "edge": feature_names(scaled.edges)}
    tensors = states.window_tensors(
        scaled.windows, scaled.hosts, scaled.edges, global_columns=names["global"], host_columns=names["host"], edge_columns=names["edge"], k=plan.k
    )
    if scaled.labels is not None:
        tensors = tensors.join(scaled.labels, "window_start", "left")
    tables.save_arrays(tensors, names, target)
    for name, scaler in scalers.items():
        scaling.save_scaler(scaler, f"{target}/scaler-{name}")
    return tables.load_arrays(spark, target)[0]


def extract_job(
    spark: SparkSession,
    captures: str,
    flows: DataFrame,
    fields: Mapping[str, str],
    protocols: Mapping[int, str],
    keys: Sequence[str],
    *,
    history: Mapping | None = None,
    last_packet: Column | None = None,
    file_complete: bool = True,
) -> DataFrame:
    """Flows with the packet features of their captures and, with history, their trailing features.

    fields: as in flow_windows. history: the keyword arguments of behaviour_features; its operands src_ip, dst_ip,
    dst_port and protocol are those of the flow, and capture is a partition if flows have it. Flows that can't be read
    are left out. keys tell flows apart.
    """
    ready = joins.flow_windows(flows, dict(fields), dict(protocols))
    packets = pcap.parse_packets(pcap.read_pcap(spark, captures)).withColumn("at", F.unix_micros("timestamp"))
    packets = settled(packets.drop("timestamp"), "packets")
    if last_packet is None:
        last_packet = F.lit(packets.agg(F.max("at")).first()[0]).cast("long")
    out = joins.packet_features(ready, packets, keys, last_packet=last_packet, file_complete=file_complete)
    if history is None:
        return out.select(*flows.columns, *[c for c in out.columns if c not in ready.columns])
    operands = {
        "src_ip": F.col("flow_src.ip"), "dst_ip": F.col("flow_dst.ip"), "dst_port": F.col("flow_dst.port"), "protocol": F.col("flow_protocol"),
        "micros": F.col("flow_start"), "ordinal": F.struct(*[col(k) for k in keys]),
    }
    slim = ready.select(*[col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *[c.alias(n) for n, c in operands.items()], *(["capture"] if "capture" in ready.columns else []))
    partition = ("capture",) if "capture" in slim.columns else ()
    trailing = windows.behaviour_features(slim, partition=partition, **history)
    names = [c for c in trailing.columns if c not in slim.columns]
    trailing = trailing.select(*[F.col(f"_key{i}").alias(k) for i, k in enumerate(keys)], *names)
    found = out.select(*flows.columns, *[c for c in out.columns if c not in ready.columns])
    return found.join(trailing, list(keys), "left")
