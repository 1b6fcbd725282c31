import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from netquarry.plans import ledger
from netquarry.sources import archive, pcap


class Counted(io.BytesIO):
    """A file that counts what is read of it."""

    total = 0

    def read(self, n=-1):
        data = super().read(n)
        self.total += len(data)
        return data

    def readinto(self, buffer):
        n = super().readinto(buffer)
        self.total += n
        return n


def zipped(files, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, content in files.items():
            z.writestr(name, content)
    return out.getvalue()


def big(seed, n=300_000):
    return random.Random(seed).randbytes(n)


@pytest.mark.parametrize("inner_method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_only_directory_and_member_are_read(tmp_path, inner_method):
    inner = zipped({f"pcap/{i}": big(i) for i in range(4)}, inner_method)
    data = zipped({"a": big(10), "in.zip": inner, "b": big(11)}, zipfile.ZIP_STORED)
    file = Counted(data)
    found = {e[0]: e for e in archive.zip_entries(file)}
    assert set(found) == {"a", "in.zip", "b", *(f"in.zip!pcap/{i}" for i in range(4))} and file.total < 20_000
    file = Counted(data)
    size = archive.extract_entry(file, "in.zip!pcap/2", f"{tmp_path}/got")
    assert size == 300_000 and (tmp_path / "got").read_bytes() == big(2) and file.total < 400_000


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_broken_extraction_goes_on(tmp_path, method):
    content = big(3, 3_000_000)
    data, target = zipped({"pcap/x": content}, method), tmp_path / "sub" / "x"
    target.parent.mkdir()
    (target.parent / "x.part").write_bytes(content[:1_500_000])
    file = Counted(data)
    assert archive.extract_entry(file, "pcap/x", str(target)) == 3_000_000 and target.read_bytes() == content
    if method == zipfile.ZIP_STORED:
        assert file.total < 1_600_000
    for wrong in (b"other" * 1000, content + b"longer"):
        target.unlink()
        (target.parent / "x.part").write_bytes(wrong)
        if len(wrong) < len(content):
            with pytest.raises(ValueError, match="checksum"):
                archive.extract_entry(data, "pcap/x", str(target))
            assert not target.exists() and not (target.parent / "x.part").exists()
        assert archive.extract_entry(data, "pcap/x", str(target)) == 3_000_000
    damaged = bytearray(data)
    damaged[2_000_000] ^= 1
    with pytest.raises(Exception, match="(?i)checksum|crc"):
        archive.extract_entry(bytes(damaged), "pcap/x", f"{tmp_path}/y")
    assert not (tmp_path / "y").exists()


def make_days(folder, days=2, captures=3):
    rng, every = random.Random(7), []
    for day in range(days):
        files = {}
        for k in range(captures):
            packets = [(1_700_000_000_000_000 + rng.randrange(10**9), 10, 10, rng.randbytes(10)) for _ in range(40)]
            every += [(f"d{day}", *p) for p in packets]
            files[f"pcap/cap {k}"] = pcap.classic_bytes(iter(packets))
        (folder / f"d{day}.zip").write_bytes(zipped({"in.zip": zipped(files), "note.txt": b"x"}))
    return sorted(every)


def run(spark, tmp_path, step=lambda what: None):
    process = lambda folder: pcap.read_pcap(spark, folder).select("timestamp", "captured_length", "original_length", "data")
    return ledger.archive_job(spark, f"{tmp_path}/in", f"{tmp_path}/work", f"{tmp_path}/out", process, batch_bytes=1500, reserve=0, step=step)


def rows(spark, tmp_path):
    found = spark.read.parquet(f"{tmp_path}/out").withColumn("at", F.unix_micros("timestamp"))
    return sorted((r.day, r["at"], r.captured_length, r.original_length, bytes(r.data)) for r in found.collect())


class Killed(Exception):
    pass


def test_a_job_killed_after_every_step_leaves_the_same_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    want = make_days(tmp_path / "in", days=1, captures=2)
    kills, done, last = 0, False, ""
    seen = set()
    while not done:
        count = 0

        def step(what):
            nonlocal count, last
            count += 1
            seen.add(what)
            if count == (3 if last == "rows" else 2):  # each run gets a step further; rows are written anew until they are committed
                last = what
                raise Killed

        try:
            total = run(spark, tmp_path, step)
            done = True
        except Killed:
            kills += 1
    assert kills >= 6 and seen == {"planned", "captures", "extracted", "rows", "committed"}
    assert rows(spark, tmp_path) == want and total == {"d0": 80}
    assert not list((tmp_path / "work").glob("*/captures/*"))
    assert run(spark, tmp_path) == total and rows(spark, tmp_path) == want


def test_gaps_lost_rows_and_full_disks_raise(spark, tmp_path):
    (tmp_path / "in").mkdir()
    make_days(tmp_path / "in", days=1)
    run(spark, tmp_path)
    state = tmp_path / "work" / "d0" / "ledger.json"
    batches = json.loads(state.read_text())
    assert len(batches) == 3 and [b["rows"] for b in batches] == [40, 40, 40]
    (tmp_path / "out" / "day=d0" / "batch=1").rename(tmp_path / "elsewhere")
    with pytest.raises(ValueError, match="rows are gone"):
        run(spark, tmp_path)
    state.write_text(json.dumps([batches[0] | {"state": "planned"}, *batches[1:]]))
    with pytest.raises(ValueError, match="batch 0 isn't committed"):
        run(spark, tmp_path)
    with pytest.raises(OSError, match="bytes free"):
        ledger.free_space_for(str(tmp_path), 1 << 60)


def test_archives_of_days_are_made_in_tasks(spark, monkeypatch):
    import os

    from pyspark.sql import DataFrame

    from netquarry.plans import job_queries

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the supplied tables are absent")

    def refused(*_, **__):
        raise AssertionError("rows go to the driver")

    for name in ("toLocalIterator", "collect", "toPandas"):
        monkeypatch.setattr(DataFrame, name, refused)
    folder = job_queries._day_archives(spark, "/root/testdata/sf0.001")
    monkeypatch.undo()
    found = archive.inventory(spark, folder)
    assert found.filter("entry like 'captures.zip!pcap/day-%'").count() == 30 and found.filter("entry like 'captures.zip!%' and uncompressed_size <= 24").count() == 0
