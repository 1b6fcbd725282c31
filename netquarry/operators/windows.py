"""Trailing event-time features: what happened to the same source before now, within a number of seconds.

The frame of a row at time t holds the rows of its group with t - window <= time < t: rows of the same instant don't
see each other. What a row contributes is settled by the stream's eligibility, what it sees is not. Groups are
partitioned by capture as well, so history starts anew with each capture.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.functions.expr import compile_expr
from netquarry.functions.scalars import parsed_timestamp
from netquarry.operators._columns import col

LEAST_MICROS = 1000


@dataclass(frozen=True)
class Stream:
    """A history: rows of equal group_by that fulfil eligible contribute value. All operands must be present."""

    group_by: tuple[str, ...]
    eligible: str
    value: str | None = None
    requires: tuple[str, ...] = ()


@dataclass(frozen=True)
class Feature:
    """statistic: unique_count, span_rate_unique, span_rate_raw, entropy or sequentiality. formula is over its names."""

    name: str
    stream: str
    statistic: str
    formula: str
    missing: float = 0.0


STREAMS = {
    "ports": Stream(
        ("src_ip",), "( protocol == tcp or protocol == udp ) and dst_port == dst_port and src_ip == src_ip", "dst_port", ("protocol", "dst_port", "src_ip")
    ),
    "pairs": Stream(("src_ip", "dst_ip"), "src_ip == src_ip and dst_ip == dst_ip", None, ("src_ip", "dst_ip")),
}
FEATURES = (
    Feature("dst_port_unique_cnt", "ports", "unique_count", "count"),
    Feature("dst_port_scan_rate", "ports", "span_rate_unique", "N / duration"),
    Feature("dst_port_sequentiality", "ports", "sequentiality", "run_length / total_transitions"),
    Feature("dst_port_entropy", "ports", "entropy", "-1 * entropy_sum"),
    Feature("src_dst_pair_flow_rate", "pairs", "span_rate_raw", "N / duration"),
)
CONSTANTS = {"tcp": "TCP", "udp": "UDP"}


#: Resolution of the sums of c log2 c, which are kept as integers: adding and taking away leaves no error behind.
SCALE = 1 << 28
#: Members at either end of an instant that are kept where steps are counted: steps beyond an end reach three members in.
EDGE = 8


def behaviour_features(
    rows: DataFrame,
    *,
    streams: dict[str, Stream] = STREAMS,
    features: Sequence[Feature] = FEATURES,
    constants: dict[str, object] = CONSTANTS,
    window_seconds: float = 300,
    micros: str = "micros",
    ordinal: str = "ordinal",
    partition: Sequence[str] = (),
    chunk_windows: int = 8,
) -> DataFrame:
    """rows with one column per feature. micros: time in microseconds; ordinal: order among rows of one instant.

    Only what the features need is computed. A feature whose history is empty or undefined has its missing value, as
    has a row without a time. No frame is read anew for a row: what enters and leaves it is summed up, and first and
    last members come from running minima and maxima, so the work is a constant number of sorts. Rows are first put
    together by group and instant, at most 2 EDGE members and one row for each value of an instant; these are dealt by
    group and by time chunk of chunk_windows windows, and a chunk gets the eligible ones of the window before it as well.
    So a group that holds most of the rows is dealt over its instants and its chunks.
    """
    known = {"unique_count", "span_rate_unique", "span_rate_raw", "entropy", "sequentiality"}
    for feature in features:
        if feature.statistic not in known:
            raise ValueError(f"unknown statistic: {feature.statistic}")
    out, span = rows, int(window_seconds * 1_000_000)
    for name in dict.fromkeys(f.stream for f in features):
        mine = [f for f in features if f.stream == name]
        found = _with_stream(rows, streams[name], mine, constants, span, micros, ordinal, partition, chunk_windows * span)
        out = _looked_up(out, found, [*partition, *streams[name].group_by, micros], [f.name for f in mine])
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *[f.name for f in features])


def flow_behaviour(
    flows: DataFrame, fields: dict[str, str], protocols: dict[int, str], *, ordinal: str, **options: object
) -> DataFrame:
    """flows with the features of behaviour_features; rows keep their columns, and `ordinal` restores their order.

    fields: src_ip, dst_ip, dst_port, protocol, timestamp to column names. A protocol's number becomes its label, an
    unknown one its number as text; times may be text. options: those of behaviour_features.
    """
    number = col(fields["protocol"]).try_cast("bigint")
    label = number.cast("string")
    for value, name in protocols.items():
        label = F.when(number == value, name).otherwise(label)
    time = col(fields["timestamp"])
    if dict(flows.dtypes)[fields["timestamp"]] == "string":
        time = parsed_timestamp(time)
    operands = {
        "src_ip": col(fields["src_ip"]), "dst_ip": col(fields["dst_ip"]), "dst_port": col(fields["dst_port"]).try_cast("bigint"), "protocol": label,
        "micros": F.unix_micros(time.cast("timestamp")), "ordinal": col(ordinal),
    }
    whole = F.struct(*[col(c) for c in flows.columns]).alias("_flow")
    partition = options.get("partition", ())
    found = behaviour_features(flows.select(whole, *[c.alias(n) for n, c in operands.items()], *[col(c) for c in partition]), **options)
    names = [c for c in found.columns if c not in ("_flow", *operands, *partition)]
    return found.select("_flow.*", *names)


def longest_history(rows: DataFrame, streams: dict[str, Stream] = STREAMS, **options: object) -> DataFrame:
    """(stream, members): the most members that a row's frame of each stream has. options: those of behaviour_features."""
    counts = [Feature(f"_members_{i}", name, "span_rate_raw", "N") for i, name in enumerate(streams)]
    found = behaviour_features(rows, streams=streams, features=counts, **options)
    one = found.agg(*[F.max(f.name).cast("long").alias(f.name) for f in counts])
    entries = F.array(*[F.struct(F.lit(f.stream).alias("stream"), F.col(f.name).alias("members")) for f in counts])
    return one.select(F.explode(entries).alias("e")).select("e.*")


def _with_stream(
    rows: DataFrame,
    stream: Stream,
    features: Sequence[Feature],
    constants: dict[str, object],
    span: int,
    micros: str,
    ordinal: str,
    partition: Sequence[str],
    chunk: int,
) -> DataFrame:
    """One row (_x_key0, _x_key1, ..., features) for each group and instant of rows; see instant_key.

    All rows of a group and instant have the same history, so histories are made of instants: of the members of one only
    their number, the number of each value and, for steps, the first and last EDGE ones and sums of the others are kept.
    """
    kinds = {f.statistic for f in features}
    types = dict(rows.dtypes)
    present = F.col(micros).isNotNull()
    for name in (*stream.requires, *stream.group_by):
        present = present & F.col(name).isNotNull()
    eligible = F.coalesce(compile_expr(stream.eligible, types, constants), F.lit(False)) & present
    value = compile_expr(stream.value, types, constants) if stream.value else F.lit(1)
    group = [*partition, *stream.group_by]
    steps, moving = "sequentiality" in kinds, kinds & {"unique_count", "span_rate_unique", "entropy"}
    slim = rows.select(*[F.col(c) for c in dict.fromkeys([*group, micros, ordinal])], (eligible & value.isNotNull()).alias("_x_ok"), value.alias("_x_value"))
    instant = [*group, micros]
    # values of an instant with their numbers; how they follow each other plays no part
    counted = slim.groupBy(*instant, "_x_ok", F.when(F.col("_x_ok"), F.col("_x_value")).alias("_x_value")).agg(F.count("*").alias("_x_weight")) if moving else None
    if steps:
        ends = _edges(slim, instant, ordinal)
    else:
        ends = (slim if counted is None else counted).groupBy(*instant, "_x_ok").agg(F.count("*").alias("_x_weight") if counted is None else F.sum("_x_weight").alias("_x_weight"))
        ends = ends.withColumn(ordinal, F.lit(0))
    ends, key = _dealt(ends, group, micros, span, chunk)
    ends = _at_home(_with_ends(ends, key, span, micros, ordinal, steps), instant, ["_x_first", "_x_last"])
    if moving:
        moves, key = _dealt(counted.withColumn(ordinal, F.lit(0)), group, micros, span, chunk)
        sums = [c for c, asked in (("_x_kinds", kinds != {"entropy"}), ("_x_inner", "entropy" in kinds)) if asked]
        moves = _at_home(_with_moves(moves, key, span, micros, ordinal, "entropy" in kinds, "_x_kinds" in sums), instant, sums)
        ends = _looked_up(ends, moves, [f"_x_key{i}" for i in range(len(instant))], sums)
    at = F.col(f"_x_key{len(group)}")
    some = F.coalesce(F.col("_x_last.at") >= at - span, F.lit(False))
    count = F.col("_x_last.n") - F.col("_x_first.n") + F.col("_x_first.weight")
    for feature in features:
        kinds_here = F.col("_x_kinds") if "_x_kinds" in ends.columns else F.lit(None)
        inner = F.col("_x_inner") if "_x_inner" in ends.columns else F.lit(None)
        run, total = sequentiality_parts(F.col("_x_first"), F.col("_x_last"), count) if steps else (F.lit(None), F.lit(None))
        made = feature_value(feature, some, count, kinds_here, F.col("_x_first.at"), F.col("_x_last.at"), inner, run, total)
        ends = ends.withColumn(feature.name, made)
    return ends.select(*[f"_x_key{i}" for i in range(len(instant))], *[f.name for f in features])


def _dealt(rows: DataFrame, group: Sequence[str], micros: str, span: int, chunk: int) -> tuple[DataFrame, list[str]]:
    """rows dealt by group and time chunk, with the eligible ones of the window before a chunk, and the columns of both."""
    follows = F.col("_x_ok") & (F.col(micros) >= (F.col("_x_home") + 1) * chunk - span)
    key = [*group, "_x_chunk"]
    out = rows.withColumn("_x_home", F.floor(F.col(micros) / F.lit(chunk)))
    out = out.withColumn("_x_chunk", F.explode(F.when(follows, F.array("_x_home", F.col("_x_home") + 1)).otherwise(F.array("_x_home"))))
    return out.repartition(*key), key


def _at_home(rows: DataFrame, instant: Sequence[str], found: Sequence[str]) -> DataFrame:
    """What was found for each group and instant, which is the same for all its rows, by _x_key0, _x_key1 ..."""
    home = rows.filter(F.col("_x_chunk").eqNullSafe(F.col("_x_home")))
    return home.groupBy(*[F.col(c).alias(f"_x_key{i}") for i, c in enumerate(instant)]).agg(*[F.max(c).alias(c) for c in found])


def _looked_up(rows: DataFrame, found: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """rows with columns of found, whose rows are told by _x_key0, _x_key1 ...; key: the columns of rows that these name."""
    other = found.select(*[F.col(f"_x_key{i}").alias(f"_x_of{i}") for i in range(len(key))], *columns)
    same = F.lit(True)
    for i, c in enumerate(key):
        same = same & F.col(c).eqNullSafe(F.col(f"_x_of{i}"))
    return rows.join(other, same, "left").drop(*[f"_x_of{i}" for i in range(len(key))])


def _edges(rows: DataFrame, instant: Sequence[str], ordinal: str) -> DataFrame:
    """The first and the last EDGE members of each instant, and one row of those that are none.

    A member has _x_weight, how many members it stands for: the last of the first ones stands for those that were left
    out, too. Members with two others of their instant on either side know whether they touch a right or a strong step
    (_x_touched_in, _x_held_in; see _with_ends), others have null there; _x_touched_more and _x_held_more: how many of
    those left out do.
    """
    apart = Window.partitionBy(*instant, "_x_ok")
    order = apart.orderBy(ordinal)
    v = F.col("_x_value").cast("double")
    out = rows.withColumns({"_x_rank": F.row_number().over(order), "_x_n": F.count("*").over(apart), "_x_in": v - F.lag(v, 1).over(order)})
    into, after = F.col("_x_in"), F.lead("_x_in", 1).over(order)
    right = F.abs(into) == 1
    out = out.withColumns({"_x_right": _flag(right), "_x_strong": _flag(right & ((F.lag("_x_in", 1).over(order) == into) | (after == into)))})
    deep = (F.col("_x_rank") > 3) & (F.col("_x_rank") <= F.col("_x_n") - 3)
    touch = lambda c: F.when(deep, F.greatest(F.col(c), F.lead(c, 1).over(order)))
    out = out.withColumns({"_x_touched_in": touch("_x_right"), "_x_held_in": touch("_x_strong")})
    gone = (F.col("_x_rank") > EDGE) & (F.col("_x_rank") <= F.col("_x_n") - EDGE)
    stands = (F.col("_x_rank") == EDGE) & F.col("_x_ok")
    out = out.withColumns({f"_x_{c}_more": F.when(stands, F.sum(F.when(gone, F.col(f"_x_{c}_in")).otherwise(0)).over(apart)).otherwise(0) for c in ("touched", "held")})
    out = out.withColumn("_x_weight", F.when(stands, F.greatest(F.col("_x_n") - 2 * EDGE, F.lit(0)) + 1).otherwise(1).cast("long"))
    return out.filter(F.when(F.col("_x_ok"), ~gone).otherwise(F.col("_x_rank") == 1)).drop("_x_rank", "_x_n", "_x_in", "_x_right", "_x_strong")


def feature_value(
    feature: Feature, some: Column, count: Column, kinds: Column, first: Column, last: Column, inner: Column, run: Column, total: Column
) -> Column:
    """A feature by its formula. some: whether its history has members; count and kinds: members and distinct values.

    first, last: their times; inner: SCALE times the entropy's inner sum; run, total: as in sequentiality_parts.
    """
    duration = F.greatest(last - first, F.lit(LEAST_MICROS)) / 1e6
    if feature.statistic == "unique_count":
        names, defined = {"count": kinds.cast("double")}, some
    elif feature.statistic in ("span_rate_unique", "span_rate_raw"):
        many = kinds if feature.statistic == "span_rate_unique" else count
        names, defined = {"N": many.cast("double"), "duration": duration}, some
    elif feature.statistic == "entropy":
        names, defined = {"entropy_sum": F.least(inner.cast("double") / SCALE / count - F.log2(count.cast("double")), F.lit(0.0))}, some
    else:
        names, defined = {"run_length": run.cast("double"), "total_transitions": total.cast("double")}, some & (total > 0)
    return F.coalesce(F.when(defined, compile_expr(feature.formula, {}, columns=names)), F.lit(float(feature.missing)))


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def _with_ends(rows: DataFrame, key: Sequence[str], span: int, micros: str, ordinal: str, steps: bool) -> DataFrame:
    """rows with _x_first and _x_last, the first member of the group since span before a row, and the last one before it.

    A member stands for _x_weight ones (of an instant); n: how many there are up to it. With steps they also say what sequentiality_parts asks: a step
    is the difference of two members that follow each other, right if it is +1 or -1, strong if a step beside it
    equals it. right_in and right_out: of the steps to and from a member; strong_in and strong_out: the same, seen
    without what lies beyond the member; touched and held: members so far that touch a right or a strong step.
    """
    members = Window.partitionBy(*key, "_x_ok").orderBy(micros, ordinal)
    so_far = members.rowsBetween(Window.unboundedPreceding, 0)
    out, weight = rows, F.col("_x_weight")
    fields = {"at": F.col(micros), "order": F.col(ordinal), "n": F.sum(weight).over(so_far), "weight": weight}
    if steps:
        v = F.col("_x_value").cast("double")
        out = out.withColumns({"_x_in": v - F.lag(v, 1).over(members)})
        into, after = F.col("_x_in"), F.lead("_x_in", 1).over(members)
        right = F.abs(into) == 1
        backward = _flag(right & (F.lag("_x_in", 1).over(members) == into))
        forward = _flag(right & (after == into))
        # of the step that leads to each member
        out = out.withColumns({"_x_right": _flag(right), "_x_back": backward, "_x_fore": forward})
        strong = F.greatest("_x_back", "_x_fore")
        out = out.withColumns({"_x_strong": strong})
        ahead = lambda c, k=1: F.coalesce(F.lead(c, k).over(members), F.lit(0))
        out = out.withColumns(
            {
                "_x_touched": F.coalesce("_x_touched_in", F.greatest(F.col("_x_right"), ahead("_x_right"))),
                "_x_held": F.coalesce("_x_held_in", F.greatest(F.col("_x_strong"), ahead("_x_strong"))),
            }
        )
        summed = lambda c: F.sum(F.col(f"_x_{c}") + F.col(f"_x_{c}_more")).over(so_far)
        out = out.withColumns({"_x_touched_sum": summed("touched"), "_x_held_sum": summed("held")})
        fields |= {
            "touches": F.col("_x_touched"),
            "right_in": F.col("_x_right"),
            "right_out": ahead("_x_right"),
            "strong_in": F.col("_x_back"),
            "strong_out": ahead("_x_fore"),
            "touched": F.col("_x_touched_sum"),
            # of the member after the first, and of the second before the last: those inside both ends' reach
            "next_strong": ahead("_x_strong", 2),
            "next_held": F.coalesce(F.lead("_x_held_sum", 1).over(members), F.col("_x_held_sum")),
            "former_strong": F.coalesce(F.lag("_x_strong", 1).over(members), F.lit(0)),
            "former_held": F.coalesce(F.lag("_x_held_sum", 2).over(members), F.lit(0).cast("long")),
        }
    out = out.withColumn("_x_member", F.when(F.col("_x_ok"), F.struct(*[c.alias(n) for n, c in fields.items()])))
    before = Window.partitionBy(*key).orderBy(micros).rangeBetween(Window.unboundedPreceding, -1)
    since = Window.partitionBy(*key).orderBy(-F.col(micros)).rangeBetween(Window.unboundedPreceding, span)
    return out.withColumns({"_x_last": F.max("_x_member").over(before), "_x_first": F.min("_x_member").over(since)})


def _with_moves(rows: DataFrame, key: Sequence[str], span: int, micros: str, ordinal: str, entropy: bool, kinds: bool) -> DataFrame:
    """rows with _x_kinds, the distinct values in a row's frame, and _x_inner, SCALE times the sum of c log2 c over their counts c.

    rows: members of one value and instant as one row, _x_weight their number. They enter the frames of the rows after
    them and leave those more than span later: a second row stands for their leaving. The changes that these moves make are summed up to the row.
    """
    alike = Window.partitionBy(*key, "_x_ok", "_x_value").orderBy(micros, ordinal)
    before, after = F.lag(micros, 1).over(alike), F.lead(micros, 1).over(alike)
    at, ok = F.col(micros), F.col("_x_ok")
    out = rows.withColumns(
        {
            "_x_comes": _flag(ok & (before.isNull() | (at - before > span))),
            "_x_goes": _flag(ok & (after.isNull() | (after - at > span))),
        }
    )
    own = F.struct(at.alias("at"), F.col("_x_weight").alias("by"), F.col("_x_comes").alias("kinds"))
    leaves = F.struct((at + span).alias("at"), (-F.col("_x_weight")).alias("by"), (-F.col("_x_goes")).alias("kinds"))
    doubled = ok if entropy else F.col("_x_goes") == 1
    out = out.withColumn("_x_move", F.explode(F.when(doubled, F.array(own, leaves)).otherwise(F.array(own))))
    out = out.withColumns({"_x_at": F.col("_x_move.at"), "_x_by": F.when(ok, F.col("_x_move.by")).otherwise(0)})
    sums = {"_x_kinds": F.col("_x_move.kinds")} if kinds else {}
    if entropy:
        counted = Window.partitionBy(*key, "_x_ok", "_x_value").orderBy("_x_at", F.desc("_x_by"), ordinal)
        c = F.sum("_x_by").over(counted.rowsBetween(Window.unboundedPreceding, 0))
        part = lambda x: F.when(x > 1, F.round(x * F.log2(x.cast("double")) * SCALE).cast("long")).otherwise(0)
        out = out.withColumn("_x_count", c)
        change = part(F.col("_x_count")) - part(F.col("_x_count") - F.col("_x_by"))
        sums["_x_inner"] = F.when(ok, change).otherwise(0)
    frame = Window.partitionBy(*key).orderBy("_x_at").rangeBetween(Window.unboundedPreceding, -1)
    out = out.withColumns({n: F.coalesce(F.sum(c).over(frame), F.lit(0)) for n, c in sums.items()})
    return out.filter(F.col("_x_move.by") > 0)


def sequentiality_parts(first: Column, last: Column, n: Column) -> tuple[Column, Column]:
    """(run_length, total_transitions) of the n members from first to last, in order.

    total_transitions counts the members that touch a right step, run_length those that touch a strong one (see
    _with_ends), steps beyond the frame left out: sums between the ends, put right where an end's steps reach out.
    """
    total = (
        last["touched"] - first["touched"] + first["touches"]
        - F.when((first["right_in"] == 1) & (first["right_out"] == 0), 1).otherwise(0)
        - F.when((last["right_out"] == 1) & (last["right_in"] == 0), 1).otherwise(0)
    )
    inside = last["former_held"] - first["next_held"]
    edges = (
        first["strong_out"]
        + F.greatest(first["strong_out"], first["next_strong"])
        + F.greatest(last["former_strong"], last["strong_in"])
        + last["strong_in"]
    )
    run = F.when(n < 3, 0).when(n == 3, 3 * first["strong_out"]).otherwise(inside + edges)
    return run.cast("double"), F.when(n < 2, 0).otherwise(total).cast("double")
