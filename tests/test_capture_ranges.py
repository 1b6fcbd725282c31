import os
import random
import struct

import pytest

from netquarry.sources import capture_ranges, pcap


def packets(n, rng, largest=90, micros=1_700_000_000_000_000):
    out = []
    for i in range(n):
        data = rng.randbytes(rng.randint(0, largest))
        out.append((micros + i * 1000 + rng.randint(0, 999), len(data), len(data) + rng.randint(0, 9), data))
    return out


def rows(df):
    found = [(int(r.timestamp.timestamp() * 1e6 + 0.5), r.captured_length, r.original_length, bytes(r.data)) for r in df.collect()]
    return sorted(found)


@pytest.mark.parametrize("step", [64, 300, 1000, 1 << 20])
def test_ranges_read_what_one_pass_reads(spark, tmp_path, step):
    """Random frames, a record longer than a range, runs of zeros, and payloads that are captures themselves."""
    rng = random.Random(step)
    some = packets(60, rng)
    inner = pcap.classic_bytes(iter(packets(40, rng, 20, 1_600_000_000_000_000)))
    some += [(1_700_000_001_000_000, len(inner), len(inner), inner), (1_700_000_001_000_001, 2000, 2000, bytes(2000)), *packets(40, rng, 30, 1_700_000_002_000_000)]
    (tmp_path / "a.pcap").write_bytes(pcap.classic_bytes(iter(some)))
    (tmp_path / "b.pcap").write_bytes(pcap.classic_bytes(iter([])))
    (tmp_path / "c.pcapng").write_bytes(pcap.pcapng_bytes(iter(some[:9])))
    read = pcap.read_pcap(spark, str(tmp_path), step)
    assert rows(read) == sorted([*some, *some[:9]])
    assert read.rdd.getNumPartitions() >= 2000 // step
    assert rows(pcap.read_pcap(spark, f"{tmp_path}/*.pcapng", step)) == sorted(some[:9])


def test_oversized_impossible_and_cut_off_records(spark, tmp_path):
    rng = random.Random(2)
    some = packets(50, rng)
    head = pcap.classic_bytes(iter(some))
    skipped = struct.pack("<IIII", 4_200_000_000, 5, 4, 4) + b"late"
    oversized = struct.pack("<IIII", 5, 5, 900_000, 4)
    tail = pcap.classic_bytes(iter(packets(50, rng)))[24:]
    (tmp_path / "a.pcap").write_bytes(head + skipped + tail[:400])
    for data, want in ((head + skipped + tail, 100), (head + oversized + tail, 50), (head + skipped + oversized + tail, 50)):
        (tmp_path / "a.pcap").write_bytes(data)
        assert sorted(pcap.classic_packets(data)) == rows(pcap.read_pcap(spark, str(tmp_path), 128))
        assert len(list(pcap.classic_packets(data))) == want
    (tmp_path / "a.pcap").write_bytes(head[:-3] if some[-1][1] > 3 else head[:-8])
    with pytest.raises(Exception, match="ends inside a record"):
        pcap.read_pcap(spark, str(tmp_path), 128).collect()
    with pytest.raises(Exception, match="No such file|NotFound|not"):
        pcap.read_pcap(spark, f"{tmp_path}/none").collect()


def test_long_sparse_capture_is_dealt_over_tasks(spark, tmp_path):
    """A file of 3 GB, sparse on disk: records of zeros, each with its header, in many ranges."""
    length, n = 250_000, 12_900
    path = tmp_path / "long.pcap"
    with open(path, "wb") as handle:
        handle.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262_144, 1))
        for i in range(n):
            handle.write(struct.pack("<IIII", 1_700_000_000 + i, i, length, length))
            handle.seek(length, os.SEEK_CUR)
        handle.truncate()
    assert path.stat().st_size > 3 << 30
    ranges = capture_ranges.capture_ranges(spark, str(path), 256 << 20)
    assert len(ranges) == 13 and [r.number for r in ranges] == list(range(13))
    sizes = [capture_ranges.bounds(r) for r in ranges]
    assert all(a[1] == b[0] for a, b in zip(sizes, sizes[1:], strict=False)) and sizes[-1][1] == path.stat().st_size


def test_same_for_every_byte_order_and_resolution(spark, tmp_path):
    rng = random.Random(5)
    for order in "<>":
        for magic, units in pcap.MAGICS.items():
            some = packets(40, rng)
            data = struct.pack(f"{order}IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
            for micros, captured, original, frame in some:
                data += struct.pack(f"{order}IIII", micros // 10**6, micros % 10**6 * (units // 10**6), captured, original) + frame
            (tmp_path / "x.pcap").write_bytes(data)
            assert rows(pcap.read_pcap(spark, str(tmp_path), 200)) == sorted(some)
