"""Flows from packets: both directions of a five-tuple, cut by a flow's length and by what ends a connection.

Where a flow begins depends on where the one before it began, so a conversation's packets have to be walked in order.
They are sorted by range once, over (conversation, time), and written with the number of their part of that order; a
part is walked in one task, in batches, and a conversation with very many packets is dealt over as many parts as it
fills. Each part first tells the state in which it leaves its last conversation, a row for each part. Where a conversation
goes on in the next part, that state is where its walk there begins; parts that were walked from another state are walked
again, until nothing changes. That takes one more round for each whole part that one conversation fills without a break.

What a packet needs of its neighbours (gaps, direction, runs of activity) comes from the walk; the statistics of flows are
plain aggregates with partial sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.operators.joins import endpoints
from netquarry.session import settled

FIN, SYN, RST, PSH, ACK, URG, ECE, CWR = (1, 2, 4, 8, 16, 32, 64, 128)
#: The walk's state: the flow's first packet, the times of the last packet and of the last in each direction, where the
#: last run of activity began, and whether the flow has ended.
STATE = ("start", "tie", "low_first", "last", "last_fwd", "last_bwd", "run", "ended")
_STATE_FIELDS = "conversation string, start long, tie long, low_first boolean, last long, last_fwd long, last_bwd long, run long, ended boolean"


class Walk:
    """Packets in order of (conversation, at, tie) to what each needs of the others of its flow."""

    def __init__(self, limit: int, pause: int, conversation: str | None = None, state: tuple | None = None):
        self.limit, self.pause, self.conversation, self.state = limit, pause, conversation, state

    def step(self, conversation: str, at: int, tie: int, from_low: bool, ends: bool) -> tuple:
        """(flow_start, flow_tie, forward, gap, own_gap, idle, run) of the next packet."""
        state = self.state if conversation == self.conversation else None
        if state is None or state[7] or at - state[0] > self.limit:
            self.conversation = conversation
            self.state = (at, tie, from_low, at, at, None, at, ends)
            return at, tie, True, None, None, None, at
        start, first, low_first, last, last_fwd, last_bwd, run, _ = state
        forward, gap = from_low == low_first, at - last
        before = last_fwd if forward else last_bwd
        idle = gap if gap > self.pause else None
        run = at if idle is not None else run
        self.state = (start, first, low_first, at, at if forward else last_fwd, last_bwd if forward else at, run, ends)
        return start, first, forward, gap, at - before if before is not None else None, idle, run


WALKED = "flow_start long, flow_tie long, forward boolean, gap long, own_gap long, idle long, run long"


def _walked(placed: DataFrame, begins: dict, limit: int, pause: int, only_ends: bool) -> DataFrame:
    """placed (part, conversation, at, tie, from_low, ends, values) after the walk of each part from its state in begins.

    only_ends: instead a row (part, opens, conversation, state) for each part: its first conversation, its last one, and
    the state in which it leaves that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, walk, opens = None, None, None

        def left() -> pa.RecordBatch:
            row = {"part": part, "opens": opens, "conversation": walk.conversation, **dict(zip(STATE, walk.state, strict=True))}
            return pa.RecordBatch.from_pylist([row], schema=ends)

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if row[0] != part:
                    if only_ends and walk is not None:
                        yield left()
                    part, opens = row[0], row[1]
                    walk = Walk(limit, pause, *begins.get(part, (None, None)))
                found = walk.step(*row[1:])
                if not only_ends:
                    out.append(found)
            if not only_ends and out:
                made = [pa.array(c, pa.bool_() if k == 2 else pa.int64()) for k, c in enumerate(zip(*out, strict=True))]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:4], *made, batch.column(6)], names=shown)
        if only_ends and walk is not None:
            yield left()

    shown = ["conversation", "at", "tie", *[f.split()[0] for f in WALKED.split(", ")], "packet"]
    ends = pa.schema([("part", pa.int32()), ("opens", pa.string()), ("conversation", pa.string())] + [(n, pa.bool_() if n in ("low_first", "ended") else pa.int64()) for n in STATE])
    sorted_parts = placed.repartition("part").sortWithinPartitions("part", "conversation", "at", "tie")
    if only_ends:
        return sorted_parts.drop("packet").mapInArrow(run, f"part int, opens string, {_STATE_FIELDS}")
    packet = placed.schema["packet"].dataType.simpleString()
    return sorted_parts.mapInArrow(run, f"conversation string, at long, tie long, {WALKED}, packet {packet}")


def _states(placed: DataFrame, limit: int, pause: int) -> dict:
    """The conversation and state in which each part begins, for those that go on with one of the part before."""
    slim = placed.drop("packet")
    ends = {r["part"]: r for r in _walked(slim, {}, limit, pause, True).collect()}  # a row for each part
    begins: dict = {}
    while True:
        again, before = {}, None
        for part in sorted(ends):
            if before is not None and ends[part]["opens"] == before["conversation"]:
                state = (before["conversation"], tuple(before[n] for n in STATE))
                if begins.get(part) != state:
                    again[part] = state
            before = ends[part]
        if not again:
            return begins
        begins |= again
        for r in _walked(slim.filter(F.col("part").isin(list(again))), again, limit, pause, True).collect():
            ends[r["part"]] = r


def flow_packets(packets: DataFrame, *, limit_seconds: float = 120, pause_seconds: float = 5, tie: str | None = None, within: Sequence[str] = ()) -> DataFrame:
    """TCP and UDP packets (parse_packets, with `at` in microseconds) with their flow and what they need of its others.

    A flow is one conversation of two ends, in both directions: a packet more than limit_seconds after the flow's first
    one begins another, and so does the packet after one with FIN or RST. Columns: packet (the row), conversation,
    flow_start and flow_tie, which name the flow within it; forward (as the flow's first packet; packets from an end to
    itself are), gap since the flow's last packet, own_gap since its last one in that direction, idle (the gap, if over
    pause_seconds), run (when the current run of activity began). tie: a whole number that orders packets of one instant,
    without it their place in the input does. within: columns that keep conversations apart, such as the capture.
    Packets without ends or time are left out.
    """
    low, high = endpoints(F.col("src_ip"), F.col("src_port").cast("bigint"), F.col("dst_ip"), F.col("dst_port").cast("bigint"))
    mine = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").cast("bigint").alias("port"))
    flags = F.coalesce(F.col("tcp_flags"), F.lit(0))
    able = F.col("protocol").isin("TCP", "UDP") & F.col("at").isNotNull()
    for c in ("src_ip", "src_port", "dst_ip", "dst_port"):
        able = able & F.col(c).isNotNull()
    name = F.to_json(F.array(low["ip"], low["port"].cast("string"), high["ip"], high["port"].cast("string"), F.col("protocol"), *[F.col(c).cast("string") for c in within]), {"ignoreNullFields": "false"})
    rows = packets.filter(able).select(
        name.alias("conversation"),
        "at",
        (F.col(tie).cast("long") if tie else F.monotonically_increasing_id()).alias("tie"),
        (mine == low).alias("from_low"),
        ((F.col("protocol") == "TCP") & (flags.bitwiseAND(F.lit(FIN | RST)) != 0)).alias("ends"),
        F.struct(*[F.col(f"`{c}`") for c in packets.columns]).alias("packet"),
    )
    order = ["conversation", "at", "tie"]
    dealt = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    placed = settled(dealt.select("part", *order, "from_low", "ends", "packet"), "flow-packets")
    limit, pause = int(limit_seconds * 1_000_000), int(pause_seconds * 1_000_000)
    return _walked(placed, _states(placed, limit, pause), limit, pause, False)


def _four(value: Column, name: str, stats: Sequence[str] = ("Mean", "Std", "Max", "Min")) -> list[Column]:
    made = {
        "Total": F.sum(value),
        "Mean": F.avg(value),
        "Std": F.stddev_samp(value),
        "Max": F.max(value),
        "Min": F.min(value),
    }
    return [F.coalesce(made[s].cast("double"), F.lit(0.0)).alias(f"{name} {s}") for s in stats]


def assemble_flows(packets: DataFrame, *, within: Sequence[str] = (), **options: object) -> DataFrame:
    """The flow table of packets: a row for each flow of flow_packets, by the names that the flow table has.

    Times and gaps are in microseconds, lengths are those of payloads. Of no gaps, runs or packets the statistics are 0, as
    is the sample deviation of one value; rates are null where a flow lasts no time. Runs of activity of no length don't
    count as active. Init_Win_bytes_*: the window of the first packet in that direction, -1 where there is none. options:
    those of flow_packets.
    """
    walked = flow_packets(packets, within=within, **options)
    p = lambda c: F.col(f"packet.{c}")
    fwd, bwd = F.col("forward"), ~F.col("forward")
    length, flags = F.coalesce(p("payload_length"), F.lit(0)), F.coalesce(p("tcp_flags"), F.lit(0))
    has = lambda bit: flags.bitwiseAND(F.lit(bit)) != 0
    window = lambda way: F.min_by(F.when(way, p("tcp_window")), F.when(way & p("tcp_window").isNotNull(), F.struct("at", "tie")))
    flow = ["conversation", "flow_start", "flow_tie"]
    first = lambda c: F.max(F.when(F.col("gap").isNull(), p(c)))
    found = walked.groupBy(*flow).agg(
        first("src_ip").alias("Source IP"), first("src_port").alias("Source Port"), first("dst_ip").alias("Destination IP"),
        first("dst_port").alias("Destination Port"), first("protocol").alias("_label"), *[first(c).alias(c) for c in within],
        (F.max("at") - F.min("at")).alias("Flow Duration"),
        F.count_if(fwd).alias("Total Fwd Packets"), F.count_if(bwd).alias("Total Bwd Packets"),
        F.coalesce(F.sum(F.when(fwd, length)), F.lit(0)).cast("bigint").alias("Total Length of Fwd Packets"),
        F.coalesce(F.sum(F.when(bwd, length)), F.lit(0)).cast("bigint").alias("Total Length of Bwd Packets"),
        *_four(F.when(fwd, length), "Fwd Packet Length"), *_four(F.when(bwd, length), "Bwd Packet Length"), *_four(length, "Packet Length"),
        *_four(F.col("gap"), "Flow IAT"), *_four(F.when(fwd, F.col("own_gap")), "Fwd IAT", ("Total", "Mean", "Std", "Max", "Min")),
        *_four(F.when(bwd, F.col("own_gap")), "Bwd IAT", ("Total", "Mean", "Std", "Max", "Min")), *_four(F.col("idle"), "Idle"),
        *[F.count_if(way & has(bit)).alias(f"{name} {kind} Flags") for name, way in (("Fwd", fwd), ("Bwd", bwd)) for kind, bit in (("PSH", PSH), ("URG", URG))],
        *[F.count_if(has(bit)).alias(f"{n} Flag Count") for n, bit in (("FIN", FIN), ("SYN", SYN), ("RST", RST), ("PSH", PSH), ("ACK", ACK), ("URG", URG), ("CWE", CWR), ("ECE", ECE))],
        F.coalesce(window(fwd), F.lit(-1)).alias("Init_Win_bytes_forward"), F.coalesce(window(bwd), F.lit(-1)).alias("Init_Win_bytes_backward"),
        F.count_if(fwd & (length > 0)).alias("act_data_pkt_fwd"),
    )
    runs = walked.groupBy(*flow, "run").agg((F.max("at") - F.col("run")).alias("active")).filter("active > 0")
    runs = runs.groupBy(*flow).agg(*_four(F.col("active"), "Active"))
    both = found.join(runs, flow, "left").fillna(0.0, [f"Active {s}" for s in ("Mean", "Std", "Max", "Min")])
    seconds = F.col("Flow Duration") / 1e6
    rate = lambda value: F.when(F.col("Flow Duration") > 0, value / seconds)
    packets_fwd, packets_bwd = F.col("Total Fwd Packets"), F.col("Total Bwd Packets")
    sent = F.col("Total Length of Fwd Packets") + F.col("Total Length of Bwd Packets")
    number = F.when(F.col("_label") == "TCP", 6).otherwise(17)
    made = {
        "Protocol": number,
        "Timestamp": F.timestamp_micros("flow_start"),
        "Flow ID": F.concat_ws("-", "Source IP", "Destination IP", "Source Port", "Destination Port", number),
        "Packet Length Variance": F.col("Packet Length Std") * F.col("Packet Length Std"),
        "Flow Bytes/s": rate(sent),
        "Flow Packets/s": rate(packets_fwd + packets_bwd),
        "Fwd Packets/s": rate(packets_fwd),
        "Bwd Packets/s": rate(packets_bwd),
        "Down/Up Ratio": F.floor(packets_bwd / packets_fwd),
    }
    return both.withColumns(made).drop("conversation", "flow_tie", "_label")
