import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from netquarry.sources import archive, pcap, tables


def ether(ip, kind=0x0800):
    return b"\0" * 12 + struct.pack(">H", kind) + ip


def ipv4(payload, proto, flags=0, src=(10, 0, 0, 1), dst=(10, 0, 0, 2)):
    return struct.pack(">BBHHHBBH4B4B", 0x45, 0, 20 + len(payload), 1, flags, 64, proto, 0, *src, *dst) + payload


def tcp(data=b"hello", sport=1234, dport=80):
    return struct.pack(">HHIIBBHHH", sport, dport, 0xFFFFFFFF, 7, 5 << 4, 0x18, 512, 0, 0) + data


def udp(data=b"abc"):
    return struct.pack(">HHHH", 53, 5353, 8 + len(data), 0) + data


def ipv6(payload, proto):
    return struct.pack(">IHBB", 6 << 28, len(payload), proto, 55) + bytes(range(16)) + bytes(range(16, 32)) + payload


FRAMES = [
    ether(ipv4(tcp(), 6)), ether(ipv4(udp(), 17)), ether(ipv6(tcp(b""), 6), 0x86DD), ether(ipv4(b"x" * 30, 1, 0x2001)), ether(ipv4(tcp()[:10], 6)), b"short", ether(b"arp", 0x0806),
]


def capture(order="<", nano=False, frames=FRAMES, snap=65535):
    out = struct.pack(f"{order}IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, snap, 1)
    for i, f in enumerate(frames):
        out += struct.pack(f"{order}IIII", 1_500_000_000 + i, 5_999 if nano else 5, len(f), len(f)) + f
    return out


@pytest.mark.parametrize(("order", "nano"), [("<", False), (">", False), ("<", True), (">", True)])
def test_four_magics(spark, tmp_path, order, nano):
    (tmp_path / "x.pcap").write_bytes(capture(order, nano))
    df = pcap.read_pcap(spark, str(tmp_path))
    rows = df.orderBy("timestamp").collect()
    assert len(rows) == len(FRAMES) and bytes(rows[0].data) == FRAMES[0]
    assert df.agg(F.min(F.unix_micros("timestamp"))).first()[0] == 1_500_000_000_000_005


def test_frames_are_parsed(spark):
    rows = [(None, len(f), len(f), bytearray(f), i) for i, f in enumerate(FRAMES)]
    df = spark.createDataFrame(rows, pcap.PACKET + ", i int")
    got = {r.i: r for r in pcap.parse_packets(df).collect()}
    a = got[0]
    assert (a.src_ip, a.dst_ip, a.src_port, a.dst_port, a.protocol, a.ip_version, a.ttl) == ("10.0.0.1", "10.0.0.2", 1234, 80, "TCP", 4, 64)
    assert (a.is_fragmented, a.fragment_offset, a.payload_length, a.tcp_window, a.tcp_seq, a.tcp_ack, a.tcp_flags) == (False, 0, 5, 512, 2**32 - 1, 7, 0x18)
    assert (got[1].protocol, got[1].src_port, got[1].payload_length, got[1].tcp_window) == ("UDP", 53, 3, None)
    assert (got[2].ip_version, got[2].ttl, got[2].is_fragmented, got[2].payload_length) == (6, 55, None, 0)
    assert got[2].src_ip == "0001:0203:0405:0607:0809:0a0b:0c0d:0e0f"
    assert (got[3].is_fragmented, got[3].fragment_offset, got[3].protocol, got[3].src_ip) == (True, 1, None, "10.0.0.1")
    assert (got[4].protocol, got[4].src_port, got[4].payload_length) == ("TCP", None, None)
    assert got[5].src_ip is None and got[6].src_ip is None
    assert pcap.parse_packets(df, light=True).columns == ["timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "i"]


def test_damaged_captures():
    good = capture()
    with pytest.raises(ValueError, match="record"):
        list(pcap.classic_packets(good[:-1]))
    with pytest.raises(ValueError, match="magic"):
        list(pcap.classic_packets(b"\0" * 24))
    with pytest.raises(ValueError, match="header"):
        list(pcap.classic_packets(b"\xa1\xb2"))
    big = good + struct.pack("<IIII", 1, 1, 300_000, 300_000)
    assert len(list(pcap.classic_packets(big))) == len(FRAMES)
    late = good + struct.pack("<IIII", 4_200_000_000, 1, 2, 2) + b"zz"
    assert len(list(pcap.classic_packets(late))) == len(FRAMES)


def block(kind, body):
    body += b"\0" * (-len(body) % 4)
    return struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))


def test_pcapng_and_conversion():
    idb = block(1, struct.pack("<HHI", 1, 0, 0) + struct.pack("<HHB3x", 9, 1, 9) + struct.pack("<HH", 0, 0))
    ns = 1_500_000_000_123_456_789
    epb = block(6, struct.pack("<IIIII", 0, ns >> 32, ns & 0xFFFFFFFF, 3, 3) + b"abc")
    spb = block(3, struct.pack("<I", 2) + b"xy")
    data = block(pcap.PCAPNG, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + idb + epb + spb
    got = list(pcap.packets_of(data))
    assert got == [(1_500_000_000_123_456, 3, 3, b"abc"), (0, 2, 2, b"xy")]
    assert list(pcap.classic_packets(pcap.classic_bytes(iter(got)))) == got


def test_split():
    data = capture()
    pieces = pcap.split_capture(data, 200)
    assert len(pieces) > 1 and [p for x in pieces for p in pcap.classic_packets(x)] == list(pcap.classic_packets(data))


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), content)
    return out.getvalue()


def test_archives(spark, tmp_path):
    inner = zipped(pcap__a_DOT_pcap=b"one", pcap__b_DOT_txt=b"two")
    (tmp_path / "day.zip").write_bytes(zipped(inner_DOT_zip=inner, pcap__c=b"three"))
    entries = archive.inventory(spark, str(tmp_path))
    assert {r.entry for r in entries.collect()} == {"inner.zip", "inner.zip!pcap/a.pcap", "inner.zip!pcap/b.txt", "pcap/c"}
    assert {r.entry for r in archive.captures(entries).collect()} == {"inner.zip!pcap/a.pcap", "pcap/c"}
    target = tmp_path / "out"
    assert archive.extract_entry((tmp_path / "day.zip").read_bytes(), "inner.zip!pcap/a.pcap", str(target)) == 3 and target.read_bytes() == b"one"
    archive.write_inventory(entries.withColumn("day", F.lit("d1")), f"{tmp_path}/lists")
    assert archive.day_rows(spark, f"{tmp_path}/lists", "d1").count() == 4


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("1", "x"), ("2", None)], "`a b` string, c string")
    path = f"{tmp_path}/csv"
    assert tables.write_csv(df, path) == 2 and tables.write_csv(df, path, append=True) == 2
    assert tables.read_csv(spark, path).count() == 4 and tables.csv_header(spark, path) == ["a b", "c"]
    with pytest.raises(ValueError, match="header"):
        tables.write_csv(df.select("c"), path, append=True)
    tables.write_parquet(df.select(F.col("c")), f"{tmp_path}/p")
    assert [c for batch in tables.parquet_batches(spark, f"{tmp_path}/p", ["c"], size=2) for c in batch.column("c").to_pylist()].count("x") == 1
    spark.range(1001).repartition(5).write.parquet(f"{tmp_path}/many")
    for size in (1, 7, 400, 5000):
        batches = list(tables.parquet_batches(spark, f"{tmp_path}/many", size=size))
        assert [b.num_rows for b in batches[:-1]] == [size] * (1001 // size - (1001 % size == 0)) and sum(b.num_rows for b in batches) == 1001
        assert sorted(i for b in batches for i in b.column("id").to_pylist()) == list(range(1001))
    tensors = spark.range(2).select("id", F.array(F.lit(1.0)).alias("global"))
    tables.save_arrays(tensors, {"global": ["n"]}, f"{tmp_path}/t")
    back, names = tables.load_arrays(spark, f"{tmp_path}/t")
    assert back.count() == 2 and names == {"global": ["n"]}
    df.select("c").coalesce(1).write.csv(f"{tmp_path}/days/02-03-2018")


def test_pcapng_errors_and_round_trip():
    packets = [(1_700_000_000_123_456, 3, 9, b"abc"), (5, 4, 4, b"abcd")]
    data = pcap.pcapng_bytes(iter(packets))
    assert list(pcap.pcapng_packets(data)) == packets
    with pytest.raises(ValueError, match="byte-order"):
        list(pcap.pcapng_packets(data[:8] + b"\x00\x01\x02\x03" + data[12:]))
    with pytest.raises(ValueError, match="block"):
        list(pcap.pcapng_packets(data + b"\x06\x00\x00\x00"))


def test_split_file_and_extract_in_pieces(tmp_path):
    packets = [(i * 1_000_000, 40, 60, bytes([i]) * 40) for i in range(50)]
    whole = tmp_path / "day.pcap"
    whole.write_bytes(pcap.classic_bytes(iter(packets)))
    parts = pcap.split_capture_file(str(whole), str(tmp_path), 500)
    assert len(parts) > 3 and [p for part in parts for p in pcap.packets_of(open(part, "rb").read())] == packets
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("pcap/day.pcap", whole.read_bytes() * 40)
    outer = tmp_path / "outer.zip"
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("in.zip", inner.getvalue())
    target = tmp_path / "got.pcap"
    for source in (str(outer), outer.read_bytes()):
        assert archive.extract_entry(source, "in.zip!pcap/day.pcap", str(target)) == len(whole.read_bytes()) * 40
        assert target.read_bytes() == whole.read_bytes() * 40 and not (tmp_path / "got.pcap.part").exists()


def test_windows_in_order_and_by_number(spark, tmp_path):
    times = [*range(100, 160), 130, None]
    made = spark.createDataFrame([(t, [float(t or 0)]) for t in times], "window_start int, global array<double>").repartition(7)
    path = f"{tmp_path}/w"
    assert tables.save_windows(made, {"global": ["n"]}, path) == 62
    rows = sorted(tables.load_windows(spark, path, 0, 61).collect(), key=lambda r: r.number)
    assert [r.number for r in rows] == list(range(62)) and [r.window_start for r in rows] == [None, *sorted(t for t in times if t)]
    some = tables.load_windows(spark, path, 10, 14)
    assert sorted((r.number, r.window_start) for r in some.collect()) == [(i, 99 + i) for i in range(10, 15)]
    assert tables.load_windows(spark, path, 70, 80).count() == 0
    assert tables.save_windows(made.limit(0), {}, f"{tmp_path}/none") == 0
