"""Network state per time window: global, host, edge, delta and label tables, all in long form until export."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.operators._columns import col


@dataclass(frozen=True)
class StateColumns:
    src: str = "src"
    dst: str = "dst"
    dst_port: str = "dst_port"
    protocol: str = "protocol"
    timestamp: str = "ts"
    label: str = "label"


def clean_numbers(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Every column but those of keep as a finite double: text that is no number, NaN, infinities and nulls become 0."""
    out = []
    for c in df.columns:
        value = col(c).try_cast("double") if c not in keep else col(c)
        if c not in keep:
            value = F.when(value.isNull() | F.isnan(value) | value.isin(float("inf"), float("-inf")), 0.0).otherwise(value)
        out.append(value.alias(c))
    return df.select(*out)


def with_window(df: DataFrame, timestamp: str = "ts", length: str = "60 seconds", name: str = "window_start") -> DataFrame:
    """df with the start of each row's tumbling window; rows without a time go. Windows without rows don't exist."""
    return df.filter(col(timestamp).isNotNull()).withColumn(name, F.window(col(timestamp), length)["start"])


def _sum(c: str) -> Column:
    return F.sum(col(c)).alias(f"{c}_sum")


def global_state(
    df: DataFrame,
    *,
    unique: Sequence[str],
    sums: Sequence[str] = (),
    means: Sequence[str] = (),
    stds: Sequence[str] = (),
    maxima: Sequence[str] = (),
    protocol: str | None = "protocol",
    protocol_values: Sequence[int] = (0, 6, 17),
    window: str = "window_start",
) -> DataFrame:
    """One row per window: flow count, distinct counts, shares of protocols, sums, means, sample deviations, maxima."""
    shares = [
        F.avg(F.when(col(protocol) == v, 1.0).otherwise(0.0)).alias(f"protocol_{v}_ratio") for v in (protocol_values if protocol else ())
    ]
    return df.groupBy(window).agg(
        F.count("*").alias("flow_count"),
        *[F.count_distinct(col(c)).alias(f"{c}_unique") for c in unique],
        *shares,
        *[_sum(c) for c in sums],
        *[F.avg(col(c)).alias(f"{c}_mean") for c in means],
        *[F.coalesce(F.stddev_samp(col(c)), F.lit(0.0)).alias(f"{c}_std") for c in stds],
        *[F.max(col(c)).alias(f"{c}_max") for c in maxima],
    )


def host_features(
    df: DataFrame,
    *,
    columns: StateColumns = StateColumns(),
    sums: Sequence[str] = (),
    means: Sequence[str] = (),
    ratios: Sequence[str] = (),
    window: str = "window_start",
) -> DataFrame:
    """One row per window and host with out_ and in_ features, 0 where it had no such flow.

    Each flow gives two rows for either end, for its peer and for its port. They are summed up by window, host, way
    and peer or port first, with map-side partials, so that distinct peers and ports are plain counts in the second
    aggregation; a host with very many flows is dealt over its peers and ports.
    """
    carried = list(dict.fromkeys([*sums, *means, *ratios]))
    text = lambda c: col(c).cast("string")

    def end(host: str, way: str, peer: bool, value: str) -> Column:
        return F.struct(col(host).alias("host"), F.lit(way).alias("way"), F.lit(peer).alias("peer"), text(value).alias("value"))

    four = F.array(
        end(columns.src, "out", True, columns.dst), end(columns.src, "out", False, columns.dst_port),
        end(columns.dst, "in", True, columns.src), end(columns.dst, "in", False, columns.dst_port),
    )
    ends = df.select(window, F.explode(four).alias("_end"), *[col(c).alias(f"_{c}") for c in carried])
    ends = ends.filter("_end.host is not null").withColumn("host", F.col("_end.host"))
    is_peer = F.col("_end.peer")
    # what is summed up counts with the peer's row only
    first = ends.groupBy(window, "host", F.col("_end.way").alias("_way"), is_peer.alias("_peer"), F.col("_end.value").alias("_value")).agg(
        F.count_if(is_peer).alias("_n"),
        *[F.sum(F.when(is_peer, F.col(f"_{c}"))).alias(f"_sum_{c}") for c in carried],
        *[F.count(F.when(is_peer, F.col(f"_{c}"))).alias(f"_with_{c}") for c in carried],
    )
    out = []
    for way in ("out", "in"):
        mine = F.col("_way") == way
        total = lambda name: F.sum(F.when(mine, F.col(name)))  # noqa: B023, E731
        n = F.coalesce(total("_n"), F.lit(0))
        out.append(n.alias(f"{way}_flow_count"))
        out += [F.coalesce(total(f"_sum_{c}"), F.lit(0.0)).alias(f"{way}_{c}_sum") for c in sums]
        out += [F.coalesce(F.try_divide(total(f"_sum_{c}"), total(f"_with_{c}")), F.lit(0.0)).alias(f"{way}_{c}_mean") for c in means]
        out += [F.coalesce(F.try_divide(total(f"_sum_{c}"), n), F.lit(0.0)).alias(f"{way}_{c}_ratio") for c in ratios]
        there = mine & F.col("_value").isNotNull()
        out.append(F.count_if(there & F.col("_peer")).alias(f"{way}_unique_peers"))
        out.append(F.count_if(there & ~F.col("_peer")).alias(f"{way}_unique_dst_ports"))
    return first.groupBy(window, "host").agg(*out)


def top_hosts(hosts: DataFrame, k: int = 50, by: str = "flow_count", window: str = "window_start") -> DataFrame:
    """The k hosts of each window with the largest out + in score, ties by host, with their place from 0."""
    score = F.col(f"out_{by}") + F.col(f"in_{by}")
    rank = F.row_number().over(Window.partitionBy(window).orderBy(score.desc(), F.col("host").asc()))
    return hosts.withColumn("place", rank - 1).filter(F.col("place") < k)


def padded_hosts(top: DataFrame, k: int = 50, pad: float = 0.0, window: str = "window_start") -> DataFrame:
    """Exactly k rows per window: missing places get a host pad_i, the pad value and mask 0."""
    features = [c for c in top.columns if c not in (window, "host", "place")]
    places = top.select(window).distinct().select(window, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("place"))
    filled = places.join(top.withColumn("_there", F.lit(1)), [window, "place"], "left")
    first = F.coalesce(F.max("_there").over(Window.partitionBy(window).orderBy("place").rowsBetween(0, 0)), F.lit(0))
    missing = F.col("_there").isNull()
    n = F.count("_there").over(Window.partitionBy(window))
    name = F.when(missing, F.concat(F.lit("pad_"), (F.col("place") - n).cast("string"))).otherwise(F.col("host").cast("string"))
    return filled.select(
        window, "place", name.alias("host"), first.alias("mask"), *[F.when(missing, F.lit(pad)).otherwise(F.col(c)).alias(c) for c in features]
    )


def edge_table(
    df: DataFrame,
    *,
    columns: StateColumns = StateColumns(),
    sums: Sequence[str] = (),
    means: Sequence[str] = (),
    ratios: Sequence[str] = (),
    window: str = "window_start",
) -> DataFrame:
    """One row per window and pair of hosts: flow count, sums, means, ratios to the flow count."""
    ends = df.filter(col(columns.src).isNotNull() & col(columns.dst).isNotNull())
    return ends.groupBy(window, col(columns.src).alias("src"), col(columns.dst).alias("dst")).agg(
        F.count("*").alias("flow_count"),
        *[_sum(c) for c in sums],
        *[F.avg(col(c)).alias(f"{c}_mean") for c in means],
        *[F.try_divide(F.sum(col(c)), F.count("*")).alias(f"{c}_ratio") for c in ratios],
    )


def edges_between(edges: DataFrame, top: DataFrame, window: str = "window_start") -> DataFrame:
    """Edges with both ends among the chosen hosts, with the ends' places i and j."""
    nodes = top.select(window, "host", "place")
    a = nodes.select(window, F.col("host").alias("src"), F.col("place").alias("i"))
    b = nodes.select(window, F.col("host").alias("dst"), F.col("place").alias("j"))
    return edges.join(a, [window, "src"]).join(b, [window, "dst"])


def undirected(edges: DataFrame, window: str = "window_start", ends: tuple[str, str] = ("src", "dst"), extra: tuple[str, str] | None = None) -> DataFrame:
    """Edges and the reverse of each whose reverse isn't there; existing pairs stay as they are."""
    a, b = ends
    swap = {a: b, b: a} | ({extra[0]: extra[1], extra[1]: extra[0]} if extra else {})
    back = edges.select(*[F.col(swap.get(c, c)).alias(c) for c in edges.columns])
    return edges.unionByName(back.join(edges.select(window, a, b), [window, a, b], "left_anti").select(*edges.columns))


def delta_global(states: DataFrame, columns: Sequence[str], window: str = "window_start", fill: float = 0.0) -> DataFrame:
    """Each window's change against the one before that had rows; the first has the fill. One row per window only."""
    before = Window.orderBy(window)
    return states.select(
        window, *[F.coalesce(col(c).cast("double") - F.lag(col(c).cast("double")).over(before), F.lit(fill)).alias(f"delta_{c}") for c in columns]
    )


def delta_host(top: DataFrame, columns: Sequence[str], window: str = "window_start", fill: float = 0.0) -> DataFrame:
    """Each chosen host's change against itself among the hosts chosen in the window before, absent as 0.

    Hosts of the first window have the fill. Windows are paired by their order among the (few) windows.
    """
    before = Window.orderBy(window)
    order = top.select(window).distinct().withColumns({"_first": F.lag(window).over(before).isNull(), "_before": F.lag(window).over(before)})
    # a host's last row is of the window before, or it wasn't chosen there
    own = Window.partitionBy("host").orderBy(window)
    ranked = top.join(order, window).withColumn("_there", F.coalesce(F.lag(window).over(own) == F.col("_before"), F.lit(False)))

    def change(c: str) -> Column:
        value = col(c).cast("double")
        return F.when(F.col("_first"), F.lit(fill)).otherwise(value - F.coalesce(F.when(F.col("_there"), F.lag(value).over(own)), F.lit(0.0)))

    return ranked.select(window, "host", "place", *[change(c).alias(f"delta_{c}") for c in columns])


def window_labels(df: DataFrame, attacks: Sequence[str], benign: str = "Benign", label: str = "label", window: str = "window_start") -> DataFrame:
    """attack_presence and a 0/1 array over attacks for each window. A label that is neither raises when computed."""
    value = col(label)
    known = F.when(value.isin([benign, *attacks]), value).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(value, F.lit("null")))))
    checked = df.select(window, known.alias("_label"))
    return checked.groupBy(window).agg(
        F.max((F.col("_label") != benign).cast("int")).alias("attack_presence"),
        F.array(*[F.max(F.when(F.col("_label") == a, 1).otherwise(0)) for a in attacks]).alias("attack_types_present"),
    )


def declared_aggregates(df: DataFrame, spec: Sequence[tuple[str, str, str]], window: str = "window_start") -> DataFrame:
    """One row per window from (output name, column, sum | mean | min | max | std) entries."""
    made = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp}
    if unknown := sorted({how for _, _, how in spec if how not in made}):
        raise ValueError(f"unknown aggregations: {unknown}")
    return df.groupBy(window).agg(*[made[how](col(c)).alias(name) for name, c, how in spec])


def window_tensors(
    states: DataFrame, hosts: DataFrame, edges: DataFrame, *, global_columns: Sequence[str], host_columns: Sequence[str], edge_columns: Sequence[str], k: int = 50, window: str = "window_start"
) -> DataFrame:
    """Dense float arrays per window: global, host (k x H), host_mask, adjacency (k x k), edge (k x k x E).

    states: a row per window; hosts: top_hosts; edges: edges_between. Sparse rows are gathered per window, at most k
    and k x k of them, and only here made dense.
    """
    f = lambda cs: F.array(*[col(c).cast("float") for c in cs])
    g = states.select(window, f(global_columns).alias("global"))
    h = hosts.groupBy(window).agg(F.map_from_entries(F.collect_list(F.struct("place", f(host_columns)))).alias("_h"))
    e = edges.groupBy(window).agg(F.map_from_entries(F.collect_list(F.struct((F.col("i") * k + F.col("j")).alias("at"), f(edge_columns)))).alias("_e"))
    places = F.sequence(F.lit(0), F.lit(k - 1))
    zeros = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n)
    at = lambda m, key, n: F.coalesce(F.try_element_at(m, key), zeros(n))
    there = lambda m, key: F.when(F.map_contains_key(m, key), 1.0).otherwise(0.0).cast("float")
    out = g.join(h, window, "left").join(e, window, "left")
    empty = F.create_map().cast(f"map<int,array<float>>")
    out = out.withColumn("_h", F.coalesce("_h", empty)).withColumn("_e", F.coalesce("_e", empty))
    return out.select(
        window,
        "global",
        F.transform(places, lambda i: at(F.col("_h"), i, len(host_columns))).alias("host"),
        F.transform(places, lambda i: there(F.col("_h"), i)).alias("host_mask"),
        F.transform(places, lambda i: F.transform(places, lambda j: there(F.col("_e"), i * k + j))).alias("adjacency"),
        F.transform(places, lambda i: F.transform(places, lambda j: at(F.col("_e"), i * k + j, len(edge_columns)))).alias("edge"),
    )
