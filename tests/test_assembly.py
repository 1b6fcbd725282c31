import random
import statistics
import struct
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from netquarry.operators import assembly, joins
from netquarry.sources import pcap

KIND = "at long, tie long, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, payload_length int, tcp_window int, tcp_flags int"


def brute(rows, limit=120_000_000, pause=5_000_000):
    """Packets one after the other; a flow is a list of (packet, forward)."""
    flows, open_flow = [], {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        if r[0] is None or None in r[2:6] or r[6] not in ("TCP", "UDP"):
            continue
        key = (frozenset([(r[2], r[3]), (r[4], r[5])]), r[6])
        flow = open_flow.get(key)
        if flow is None or r[0] - flow[0][0] > limit or (r[6] == "TCP" and (flow[-1][9] or 0) & 5):
            flow = open_flow[key] = []
            flows.append(flow)
        flow.append(r)
    out = []
    for flow in flows:
        first = flow[0]
        fwd = [p for p in flow if (p[2], p[3]) == (first[2], first[3])]
        bwd = [p for p in flow if (p[2], p[3]) != (first[2], first[3])]
        times = [p[0] for p in flow]
        gaps = [b - a for a, b in zip(times, times[1:], strict=False)]
        runs, begin = [], times[0]
        for a, b in zip(times, times[1:], strict=False):
            if b - a > pause:
                runs.append(a - begin)
                begin = b
        runs = [x for x in [*runs, times[-1] - begin] if x > 0]
        back = [b[0] - a[0] for a, b in zip(bwd, bwd[1:], strict=False)]
        lengths = [p[7] or 0 for p in fwd]
        mean = lambda v: round(statistics.fmean(v), 6) if v else 0.0
        std = lambda v: round(statistics.stdev(v), 6) if len(v) > 1 else 0.0
        windows = [p[8] for p in bwd if p[8] is not None]
        out.append((
            *first[2:6], first[0], times[-1] - times[0], len(fwd), len(bwd), sum(lengths), mean(gaps), std(gaps), float(max(gaps, default=0)),
            float(sum(back)), mean(runs), std(runs), mean([g for g in gaps if g > pause]), sum((p[9] or 0) & 2 > 0 for p in flow), windows[0] if windows else -1,
        ))
    return sorted(out)


SHOWN = (
    "Source IP", "Source Port", "Destination IP", "Destination Port", "start", "Flow Duration", "Total Fwd Packets", "Total Bwd Packets", "Total Length of Fwd Packets",
    "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Bwd IAT Total", "Active Mean", "Active Std", "Idle Mean", "SYN Flag Count", "Init_Win_bytes_backward",
)


def found(flows):
    rows = flows.withColumn("start", F.unix_micros("Timestamp")).select(*[F.col(f"`{c}`") for c in SHOWN]).collect()
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)


def traffic(rng, n, hosts=3):
    out, at = [], 1_700_000_000_000_000
    for i in range(n):
        at += rng.choice((0, 100, 900_000, 4_000_000, 5_000_000, 5_000_001, 30_000_000))
        ends = [(f"10.0.0.{rng.randrange(hosts)}", 1000), ("10.0.1.1", 80)]
        (a, b), (c, d) = ends if rng.random() < 0.6 else ends[::-1]
        protocol = rng.choice(("TCP", "TCP", "TCP", "UDP", None))
        flags = rng.choice((16, 16, 16, 16, 24, 2, 17, 4)) if protocol == "TCP" else None
        out.append((at if i % 50 else None, i, a, b, c, d, protocol, rng.choice((None, 0, 10, 1400)), rng.randrange(1000) if protocol == "TCP" else None, flags))
    out.append((at, n, "10.0.0.9", 7, "10.0.0.9", 7, "UDP", 5, None, None))
    return out


def test_against_a_walk_packet_by_packet(spark):
    rows = traffic(random.Random(4), 1500)
    flows = assembly.assemble_flows(spark.createDataFrame(rows, KIND).repartition(5), tie="tie")
    assert found(flows) == brute(rows)


@pytest.mark.parametrize("parts", [2, 9])
def test_one_conversation_over_many_parts(spark, parts):
    """Most packets are of one conversation without a break, so each part begins where the one before it left off."""
    rng = random.Random(parts)
    rows = [(1_000_000 * i + rng.randrange(1000), i, "a", 1, "b", 2, "UDP", 10, None, None) if i % 3 else (1_000_000 * i, i, "b", 2, "a", 1, "UDP", 20, None, None) for i in range(900)]
    rows += [(1_000_000 * i, 1000 + i, "c", 1, "b", 2, "TCP", 1, 5, 17) for i in range(20)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = assembly.flow_packets(spark.createDataFrame(rows, KIND), tie="tie")
        assert found(assembly.assemble_flows(spark.createDataFrame(rows, KIND), tie="tie")) == brute(rows)
        assert made.count() == len(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert assembly.assemble_flows(spark.createDataFrame([], KIND), tie="tie").count() == 0


def frame(src, dst, flags, payload):
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 40 + len(payload), 0, 0, 64, 6, 0, bytes(src[0]), bytes(dst[0]))
    tcp = struct.pack(">HHIIBBHHH", src[1], dst[1], 1, 0, 0x50, flags, 500, 0, 0)
    return b"\0" * 12 + b"\x08\x00" + ip + tcp + payload


def test_capture_to_flows_to_packet_features(spark, tmp_path):
    client, server = ([10, 0, 0, 1], 1234), ([10, 0, 0, 2], 80)
    packets, at = [], 1_700_000_000_000_000
    for flags, back, payload in ((2, False, b""), (18, True, b""), (24, False, b"get"), (24, True, b"answer"), (17, False, b""), (2, False, b""), (24, False, b"more")):
        data = frame(*((server, client) if back else (client, server)), flags, payload)
        packets.append((at, len(data), len(data), data))
        at += 1_000_000
    (tmp_path / "a.pcap").write_bytes(pcap.classic_bytes(iter(packets)))
    parsed = pcap.parse_packets(pcap.read_pcap(spark, str(tmp_path), 100)).withColumn("at", F.unix_micros("timestamp"))
    flows = assembly.assemble_flows(parsed, within=["capture"])
    rows = {r["Flow Duration"]: r for r in flows.collect()}
    assert set(rows) == {4_000_000, 1_000_000} and rows[4_000_000]["Total Bwd Packets"] == 2 and rows[4_000_000]["FIN Flag Count"] == 1
    assert rows[4_000_000]["Flow ID"] == "10.0.0.1-10.0.0.2-1234-80-6" and rows[4_000_000]["Protocol"] == 6
    fields = {"src_ip": "Source IP", "src_port": "Source Port", "dst_ip": "Destination IP", "dst_port": "Destination Port", "protocol": "Protocol", "timestamp": "Timestamp", "duration": "Flow Duration"}
    ready = joins.flow_windows(flows, fields, {6: "TCP", 17: "UDP"})
    got = joins.packet_features(ready, parsed, ["Flow ID", "Timestamp"], last_packet=F.lit(at))
    assert {r["Flow Duration"]: (r["payload_max"], r["ttl_fwd_mean"], r["ttl_bwd_mean"]) for r in got.collect()} == {4_000_000: (6.0, 64.0, 64.0), 1_000_000: (4.0, 64.0, -1.0)}
    counted = defaultdict(int)
    for r in assembly.flow_packets(parsed).collect():
        counted[r.flow_start] += 1
    assert sorted(counted.values()) == [2, 5]
