"""Joins of flows with packets, ordered merge of feature levels, multi-provider upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.operators._columns import col
from netquarry.operators.labels import placed
from netquarry.session import settled

NAN = float("nan")


def endpoints(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column) -> tuple[Column, Column]:
    """The two ends (ip, port) in one order for either direction."""
    a, b = F.struct(src_ip.alias("ip"), src_port.alias("port")), F.struct(dst_ip.alias("ip"), dst_port.alias("port"))
    return F.least(a, b), F.greatest(a, b)


def interval_join(
    intervals: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    at: str,
    *,
    bucket: int | None = None,
    how: str = "inner",
) -> DataFrame:
    """Rows of intervals with the points of equal keys that lie in [start, end], both ends included; whole numbers.

    Without bucket the keys alone are the join keys. With it, a key that very many rows share is dealt over time: an
    interval is filed by its length, in the class of the least power of two above it (that of bucket at least), under the
    one or two buckets of that length it touches, and a point looks into its own bucket of every class that there is. So
    neither side grows with an interval's length, however wrong that may be; which classes there are, one pass over
    intervals tells. points must not have columns named like those of intervals, but for the keys. how: inner or left; an
    interval that ends before it starts, or lacks an end, has no points.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"an interval join is inner or left, not {how}")
    inside = F.col(at).between(F.col(start), F.col(end))
    if bucket is None:
        right = points.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in points.columns if c not in keys])
        on = inside
        for k in keys:
            on = on & (F.col(k) == F.col(f"_{k}"))
        return intervals.join(right, on, how).drop(*[f"_{k}" for k in keys])
    if how == "left":
        told = settled(intervals.withColumn("_interval", F.monotonically_increasing_id()), "intervals")
        met = settled(interval_join(told, points, keys, start, end, at, bucket=bucket), "intervals-met")
        return met.unionByName(told.join(met.select("_interval").distinct(), "_interval", "left_anti"), allowMissingColumns=True).drop("_interval")
    length = F.try_subtract(F.col(end), F.col(start))
    bits = F.greatest(F.length(F.bin(F.coalesce(length, F.lit((1 << 63) - 1)))), F.lit(max(1, (bucket - 1).bit_length())))
    left = intervals.filter(F.col(start) <= F.col(end)).withColumn("_class", F.least(bits, F.lit(63)))
    there = left.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_class")))).first()[0] or 0
    classes = [F.lit(k) for k in range(64) if there >> k & 1]
    of = lambda c: F.call_function("shiftright", F.col(c).cast("bigint"), F.col("_class"))
    left = left.withColumn("_bucket", F.explode(F.array_distinct(F.array(of(start), of(end)))))
    right = points.withColumn("_class", F.explode(F.array(*classes) if classes else F.array().cast("array<int>"))).withColumn("_bucket", of(at))
    return left.join(right, [*keys, "_class", "_bucket"]).filter(inside).select(*[col(c) for c in intervals.columns], *[col(c) for c in points.columns if c not in keys])


def interval_extremes(intervals: DataFrame, points: DataFrame, keys: Sequence[str], start: str, end: str, at: str, value: str) -> DataFrame:
    """intervals with points, first and last: how many points of interval_join each has, their least and greatest value.

    No pair is made. Ends and points are put in one order, in which an interval is a run of places. Points are summed up by
    runs of 1, 2, 4 ... places, twice as many runs as places, and an interval is put together of two of each length at
    most. So the work grows with the rows, by the number of bits of their count, however long or frequent intervals are.
    """
    told = settled(intervals.withColumn("_interval", F.monotonically_increasing_id()), "intervals")
    able = told.filter(F.col(start) <= F.col(end))
    mark = lambda df, t, side, interval, v: df.select(*[col(k) for k in keys], F.col(t).alias("_t"), F.lit(side).alias("_side"), interval.alias("_interval"), v.alias("_value"))
    none, nothing = F.lit(None).cast("long"), F.lit(None).cast(points.schema[value].dataType)
    marks = mark(able, start, 0, F.col("_interval"), nothing).unionAll(mark(points, at, 1, none, F.col(value))).unionAll(mark(able, end, 2, F.col("_interval"), nothing))
    for c in (*keys, "_t"):
        marks = marks.filter(col(c).isNotNull())
    order = placed(marks.orderBy(*[col(k) for k in keys], "_t", "_side", "_value", "_interval").select("_side", "_interval", "_value"), "_place")
    bits = max(1, order.count().bit_length())
    run = F.call_function("shiftright", F.col("_place"), F.col("_level")).alias("_run")
    runs = order.filter("_side = 1").select("_place", "_value", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("_level"))
    runs = runs.groupBy("_level", run).agg(F.count("*").alias("_n"), F.min("_value").alias("_least"), F.max("_value").alias("_most"))
    ends = order.filter("_side <> 1").groupBy("_interval").agg(F.min("_place").alias("_low"), (F.max("_place") + 1).alias("_high"))
    parts = ends.select("*", F.explode(F.sequence(F.lit(0), F.length(F.bin(F.col("_high") - F.col("_low"))))).alias("_level"))
    parts = parts.withColumns(
        # the first run of this length that begins within the interval, and the first that doesn't end there
        {"_from": F.expr("shiftright(_low + shiftleft(1L, _level) - 1, _level)"), "_to": F.expr("shiftright(_high, _level)")}
    )
    own = F.array(F.when(F.col("_from") % 2 == 1, F.col("_from")), F.when(F.col("_to") % 2 == 1, F.col("_to") - 1))
    parts = parts.filter("_from < _to").select("_interval", "_level", F.explode(own).alias("_run")).filter("_run is not null")
    found = parts.join(runs, ["_level", "_run"]).groupBy("_interval")
    found = found.agg(F.sum("_n").alias("points"), F.min("_least").alias("first"), F.max("_most").alias("last"))
    return told.join(found, "_interval", "left").drop("_interval").fillna(0, ["points"])


def flow_windows(flows: DataFrame, fields: dict[str, str], protocols: dict[int, str]) -> DataFrame:
    """Flows ready to be joined: ends, label of the protocol, start and end in microseconds; unreadable rows go.

    fields: src_ip, src_port, dst_ip, dst_port, protocol, timestamp, duration (microseconds) to column names.
    """
    number = {k: F.col(f"`{fields[k]}`").try_cast("bigint") for k in ("src_port", "dst_port", "protocol", "duration")}
    label = F.lit(None).cast("string")
    for value, name in protocols.items():
        label = F.when(number["protocol"] == value, name).otherwise(label)
    stamp = F.unix_micros(F.try_to_timestamp(col(fields["timestamp"]).cast("string")))
    low, high = endpoints(col(fields["src_ip"]), number["src_port"], col(fields["dst_ip"]), number["dst_port"])
    out = flows.withColumns(
        {
            "flow_low": low,
            "flow_high": high,
            "flow_src": F.struct(col(fields["src_ip"]).alias("ip"), number["src_port"].alias("port")),
            "flow_dst": F.struct(col(fields["dst_ip"]).alias("ip"), number["dst_port"].alias("port")),
            "flow_protocol": label,
            "flow_start": stamp,
            "flow_end": F.try_add(stamp, number["duration"]),
        }
    )
    return out.filter(
        F.col("flow_protocol").isNotNull() & F.col("flow_end").isNotNull() & F.col("flow_src.port").isNotNull() & F.col("flow_dst.port").isNotNull()
    )


def direction(packet_src: Column, flow_src: Column, flow_dst: Column) -> Column:
    """fwd, bwd or null; fwd where both ends are equal."""
    return F.when(packet_src == flow_src, "fwd").when(packet_src == flow_dst, "bwd")


def spread(value: Column, chosen: Column, prefix: str, stats: Sequence[str] = ("mean", "std", "min", "max")) -> list[Column]:
    """Statistics of value where chosen holds: sample deviation with 0 for a single value, exact percentiles."""
    v = F.when(chosen, value.cast("double"))
    made = {
        "mean": F.avg(v),
        "std": F.coalesce(F.stddev_samp(v), F.when(F.count(v) > 0, 0.0)),
        "min": F.min(v),
        "max": F.max(v),
        "median": F.percentile(v, 0.5),
        "p25": F.percentile(v, 0.25),
        "p75": F.percentile(v, 0.75),
    }
    if unknown := [s for s in stats if s not in made]:
        raise ValueError(f"unknown statistics: {unknown}")
    return [made[s].alias(f"{prefix}_{s}") for s in stats]


PAYLOAD_STATS = ("mean", "std", "min", "max", "median", "p25", "p75")


def packet_features(
    flows: DataFrame, packets: DataFrame, keys: Sequence[str], *, last_packet: Column, file_complete: bool = True, bucket: int = 60_000_000
) -> DataFrame:
    """A row of packet statistics for every flow of flow_windows, also for those without packets.

    packets: src_ip, src_port, dst_ip, dst_port, protocol, at (microseconds), ttl, tcp_window, is_fragmented,
    fragment_offset, payload_length. keys identify a flow. last_packet: time of the capture's last packet.
    A direction without packets gives -1; an incomplete flow gives NaN; a TCP window of another protocol gives -1
    even so. Packets are aggregated per flow with map-side partials, after an interval join dealt over time buckets.
    """
    low, high = endpoints(F.col("src_ip"), F.col("src_port").cast("bigint"), F.col("dst_ip"), F.col("dst_port").cast("bigint"))
    points = packets.select(
        low.alias("flow_low"),
        high.alias("flow_high"),
        F.col("protocol").alias("flow_protocol"),
        F.struct(F.col("src_ip").alias("ip"), F.col("src_port").cast("bigint").alias("port")).alias("packet_src"),
        "at",
        "ttl",
        "tcp_window",
        "is_fragmented",
        "fragment_offset",
        "payload_length",
    )
    slim = flows.select(*keys, "flow_low", "flow_high", "flow_protocol", "flow_src", "flow_dst", "flow_start", "flow_end")
    met = interval_join(slim, points, ["flow_low", "flow_high", "flow_protocol"], "flow_start", "flow_end", "at", bucket=bucket)
    met = met.withColumn("way", direction(F.col("packet_src"), F.col("flow_src"), F.col("flow_dst"))).filter("way is not null")
    fwd, bwd = F.col("way") == "fwd", F.col("way") == "bwd"
    fragment = F.coalesce(F.col("is_fragmented"), F.lit(False))
    found = met.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(fwd).alias("n_fwd"),
        F.count_if(bwd).alias("n_bwd"),
        *spread(F.col("ttl"), fwd, "ttl_fwd"),
        *spread(F.col("ttl"), bwd, "ttl_bwd"),
        *spread(F.col("tcp_window"), fwd, "tcp_window_fwd"),
        *spread(F.col("tcp_window"), bwd, "tcp_window_bwd"),
        F.count_if(fragment).cast("double").alias("fragmentation_count"),
        F.avg(F.when(fragment, F.col("fragment_offset"))).alias("fragmentation_offset_mean"),
        F.max(F.when(fragment, F.col("fragment_offset"))).cast("double").alias("fragmentation_offset_max"),
        *spread(F.col("payload_length"), F.lit(True), "payload", PAYLOAD_STATS),
    )
    out = flows.join(found, list(keys), "left")
    complete = F.lit(file_complete) | (F.col("flow_end") <= last_packet)
    incomplete = ~F.coalesce(complete, F.lit(False)) | F.col("n").isNull()
    columns = []
    for name in found.columns:
        if name in (*keys, "n", "n_fwd", "n_bwd"):
            continue
        value = F.when(incomplete, F.lit(NAN)).otherwise(F.coalesce(F.col(name), F.lit(-1.0)))
        if name.startswith("tcp_window"):
            value = F.when(F.col("flow_protocol") != "TCP", F.lit(-1.0)).otherwise(value)
        columns.append(value.alias(name))
    return out.select(*flows.columns, *columns)


def with_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """df with the place of each row among the rows of equal keys, from 1."""
    from pyspark.sql import Window

    return df.withColumn(name, F.row_number().over(Window.partitionBy(*[col(k) for k in keys]).orderBy(*order)))


def merge_levels(flow: DataFrame, cross: DataFrame, packet: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Flow rows with their cross-flow row (one each) and, where there is one, their packet row.

    Rows of equal keys pair up in the order of the column `order` that each table has. Columns other than keys must
    differ in name. Cross-flow rows that are missing or left over, and packet rows left over, raise when the result
    is computed.
    """
    own = lambda df: [c for c in df.columns if c not in (*keys, order)]
    names = [*own(flow), *own(cross), *own(packet)]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"columns appear twice: {twice}")
    on = [*keys, "_ordinal"]
    left = with_ordinal(flow, keys, [col(order)], "_ordinal").withColumn("_f", F.lit(True))
    middle = with_ordinal(cross, keys, [col(order)], "_ordinal").drop(order).withColumn("_c", F.lit(True))
    right = with_ordinal(packet, keys, [col(order)], "_ordinal").drop(order).withColumn("_p", F.lit(True))
    both = left.join(middle, on, "full").join(right, on, "full")
    problem = (
        F.when(F.col("_f").isNull(), "a row without its flow").when(F.col("_c").isNull(), "a flow without its cross-flow row")
    )
    return both.filter(F.when(problem.isNotNull(), F.raise_error(problem).cast("boolean")).otherwise(True)).drop("_ordinal", "_f", "_c", "_p")


def aligned(left: DataFrame, right: DataFrame, place: str, same: Sequence[str] = ()) -> DataFrame:
    """Rows of two tables side by side, by the place that each table's rows have (1, 2 ...).

    A place that one table lacks, so tables of different lengths too, and rows that differ in a column of `same` raise
    when the result is computed. Other columns must differ in name; those of `same` come once.
    """
    twice = sorted(set(left.columns) & set(right.columns) - {place, *same})
    if twice:
        raise ValueError(f"columns appear twice: {twice}")
    a = left.withColumn("_l", F.lit(True))
    b = right.select(place, *[col(c).alias(f"_{c}") for c in same], *[col(c) for c in right.columns if c != place and c not in same], F.lit(True).alias("_r"))
    both = a.join(b, place, "full")
    differs = F.lit(False)
    for c in same:
        differs = differs | ~col(c).eqNullSafe(col(f"_{c}"))
    problem = F.when(F.col("_l").isNull() | F.col("_r").isNull(), "the tables differ in length").when(differs, "rows at one place differ")
    checked = both.filter(F.when(problem.isNotNull(), F.raise_error(problem).cast("boolean")).otherwise(True))
    return checked.drop("_l", "_r", *[f"_{c}" for c in same])


def upsert_providers(providers: Sequence[DataFrame], keys: Sequence[str], columns: Sequence[str], fill: object = "") -> DataFrame:
    """All rows of all providers by key; a later provider's columns win over earlier ones, missing values are filled.

    A key that one provider has twice raises when the result is computed.
    """
    out = None
    for k, df in enumerate(providers):
        mine = [c for c in df.columns if c in columns and c not in keys]
        once = df.groupBy(*[col(c) for c in keys]).agg(F.count("*").alias("_n"), F.first(F.struct(*[col(c) for c in mine])).alias(f"_v{k}"))
        once = once.filter(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"provider {k} has a key twice")).cast("boolean")).otherwise(True)).drop("_n")
        out = once if out is None else out.join(once, list(keys), "full")
    picked = []
    for c in columns:
        if c in keys:
            continue
        holders = [k for k, df in enumerate(providers) if c in df.columns]
        value = F.lit(None)
        for k in holders:  # the last provider that has the row supplies its column, an empty one included
            value = F.when(F.col(f"_v{k}").isNotNull(), F.col(f"_v{k}")[c]).otherwise(value)
        picked.append(F.coalesce(value, F.lit(fill)).alias(c))
    return out.select(*[col(k) for k in keys], *picked)
