"""Registered queries of whole jobs, run from YAML plans over CSV files that are made of the supplied tables."""

from __future__ import annotations

import contextlib
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.functions.scalars import is_capture
from netquarry.operators import labels, quality
from netquarry.plans import config, flow_plan, jobs, ledger
from netquarry.plans.registry import CHECKED, HOSTS, LABELLED, PACKET_SQL, WINDOWED, capture_head, capture_records, flows, items, register, shown_tensors
from netquarry.session import fresh_path, settled, table
from netquarry.sources import archive, pcap, tables
from netquarry.sources.capture_ranges import opened

CLEAN = """
columns:
  l_orderkey: {integer: true}
  l_linenumber: {integer: true}
  l_quantity: {minimum: 0, maximum: 45}
  l_extendedprice: {}
  l_discount: {minimum: 0, maximum: 0.1, allow_nan: false}
  l_tax: {allow_negative: true, minimum: 0, maximum: 1, sentinel: [-1]}
  rate: {minimum: 0}
  stamp: {type: timestamp}
  l_returnflag: {type: text}
ignored: [l_orderkey, l_linenumber, l_extendedprice, l_tax, l_returnflag]
rules:
  - {id: price, expression: l_extendedprice > 1000}
  - {id: range, expression: 0 <= l_discount <= 0.09}
  - {id: flag, expression: l_returnflag IN FLAGS, constants: {FLAGS: [A, N, R]}}
  - {id: rate, target: rate, expression: l_extendedprice / l_quantity - 0.000001 <= rate AND rate <= l_extendedprice / l_quantity + 0.000001}
  - {id: tax, target: l_tax, expression: l_tax != -1, applies: l_linenumber == 1}
formulas: {rate: l_extendedprice / l_quantity}
repairable_rules: [rate]
"""


@register(
    "job_clean",
    f"""WITH {CHECKED} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_quantity, 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice,
    round(l_discount, 6) AS l_discount, round(l_tax, 6) AS l_tax, round(CASE WHEN r_rate THEN l_extendedprice / l_quantity ELSE rate END, 8) AS rate,
    stamp, l_returnflag FROM classed WHERE NOT bad""",
)
def job_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV with a column too many and repeated rows to clean Parquet, by a YAML plan."""
    source = fresh_path(spark, "raw-items")
    rows = items(spark, sf_dir).withColumn("junk", F.lit("x"))
    tables.write_csv(rows, source)
    tables.write_csv(rows.filter("l_linenumber = 2"), source, append=True)
    plan = config.plan_from(config.parse_config(CLEAN))
    out = jobs.clean_job(spark, source, fresh_path(spark, "clean-items"), plan, drop=["junk"], reports=fresh_path(spark, "reports"))
    return out.select(*[F.round(c, 8 if c == "rate" else 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


SCHEDULE = """
columns: {timestamp: o_orderdate, flow_id: o_orderkey, src_ip: o_orderpriority, dst_ip: o_orderstatus, dst_port: o_custkey, protocol: protocol, payload: o_totalprice}
days:
  - attacks:
      - rules:
          - {label: old, start: "1995-01-01T00:00:00Z", finish: "1997-06-30T00:00:00Z"}
          - {label: urgent, start: "1996-01-01T00:00:00Z", finish: "2000-01-01T00:00:00Z", src_ips: [1-URGENT, 2-HIGH]}
          - {label: ports, start: "1995-01-01T00:00:00Z", finish: "2005-01-01T00:00:00Z", dst_ports: [7, 8, 9]}
          - {label: never, start: "1995-01-01T00:00:00Z", finish: "2005-01-01T00:00:00Z", dst_ips: []}
          - label: tree
            start: "1998-01-01T00:00:00Z"
            finish: "1999-01-01T00:00:00Z"
            protocol: tcp
            extra_conditions:
              - any_of:
                  - {feature: o_totalprice, op: gte, value: 300000}
                  - {feature: o_orderstatus, op: eq, value: P}
"""


@register("job_label", f"WITH {LABELLED} SELECT o_orderkey, label, (SELECT count(*) FROM orders WHERE o_custkey % 3 = 2) AS left_out FROM labelled")
def job_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV to labelled, ordered CSV by a YAML schedule; left_out: the rows of other protocols."""
    source, target = fresh_path(spark, "raw-orders"), fresh_path(spark, "labelled-orders")
    parity = F.when(F.col("o_custkey") % 3 == 2, 1).when(F.col("o_custkey") % 2 == 0, 6).otherwise(17)
    day = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_custkey", "o_totalprice", day.alias("o_orderdate"), parity.alias("protocol"))
    tables.write_csv(orders, source)
    schedule = config.parse_config(SCHEDULE)
    done = jobs.label_job(
        spark, source, target, labels.load_schedule(schedule), columns=config.flow_columns(schedule["columns"]), default="none", artifacts=("3", "7"), label="label"
    )
    return tables.read_csv(spark, target).select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "label", F.lit(done.dropped).cast("bigint").alias("left_out"))


STATES = """
columns: {timestamp: ts, src: src, dst: dst, dst_port: dst_port, protocol: protocol, label: label}
window: 6 hours
numbers: [bytes]
unique: [src]
protocol_values: [6]
sums: [bytes]
hosts: {sums: [bytes]}
edges: {sums: [bytes]}
k: 10
delta_global: [flow_count]
attacks: [error, signup]
benign: ok
"""
_SCALE = """round(CAST(CAST(greatest(least(({0} - m_{0}) / CASE WHEN s_{0} < 1e-8 THEN 1 ELSE s_{0} END, 10), -10) AS FLOAT) AS DOUBLE), 2)"""
_GLOBAL = ("flow_count", "src_unique", "protocol_6_ratio", "bytes_sum", "delta_flow_count")
_HOST = ("out_flow_count", "out_bytes_sum", "out_unique_peers", "out_unique_dst_ports", "in_flow_count", "in_bytes_sum", "in_unique_peers", "in_unique_dst_ports")


def _moments(columns: tuple[str, ...], source: str) -> str:
    return "SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in columns) + f" FROM {source} JOIN train USING (window_start)"


def _cells(part: str, columns: tuple[str, ...], source: str, i: str) -> str:
    return " UNION ALL ".join(f"SELECT window_start, '{part}' AS part, {i} AS i, {j} AS j, {_SCALE.format(c)} AS value FROM {source}" for j, c in enumerate(columns))


@register(
    "job_states",
    f"""WITH {HOSTS.replace(WINDOWED, WINDOWED.replace('event_id % 20 AS dst', "CAST(event_id % 20 AS VARCHAR) AS dst").replace('user_id AS src', "CAST(user_id AS VARCHAR) AS src"))},
    g0 AS (SELECT window_start, count(*) AS flow_count, count(DISTINCT src) AS src_unique, avg(CASE WHEN protocol = 6 THEN 1.0 ELSE 0.0 END) AS protocol_6_ratio, sum(bytes) AS bytes_sum
      FROM windowed GROUP BY 1),
    g AS (SELECT *, coalesce(flow_count - lag(flow_count) OVER (ORDER BY window_start), 0) AS delta_flow_count FROM g0),
    train AS (SELECT window_start FROM (SELECT window_start, row_number() OVER (ORDER BY window_start) AS n, count(*) OVER () AS c FROM g) WHERE n <= floor(c * 0.7)),
    gs AS (SELECT * FROM g, ({_moments(_GLOBAL, 'g')})), hs AS (SELECT * FROM top, ({_moments(_HOST, 'top')})),
    cells AS ({_cells('global', _GLOBAL, 'gs', '0')} UNION ALL {_cells('host', _HOST, 'hs', 'place')}
      UNION ALL SELECT window_start, 'mask', place, 0, 1 FROM top
      UNION ALL SELECT window_start, 'label', 0, 0, max(CASE WHEN label IN ('error', 'signup') THEN 1 ELSE 0 END) FROM windowed GROUP BY 1)
    SELECT window_start, part, CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(value AS DOUBLE) AS value FROM cells WHERE value <> 0""",
)
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV to scaled tensors by a YAML plan; the places of the windows' and hosts' arrays that aren't 0."""
    source = fresh_path(spark, "raw-flows")
    known = F.when(F.col("label").isin("error", "signup"), F.col("label")).otherwise("ok")
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    tables.write_csv(flows(spark, sf_dir).withColumns({"label": known, "ts": text}), source)
    made = jobs.states_job(spark, source, fresh_path(spark, "states"), config.states_from(config.parse_config(STATES)))
    shown = shown_tensors(made).filter("part IN ('global', 'host', 'mask')").filter("value <> 0")
    marks = made.select("window_start", F.lit("label").alias("part"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("attack_presence").cast("double").alias("value"))
    return shown.unionByName(marks.filter("value <> 0"))


@register(
    "flow_table",
    """SELECT l_orderkey || '-' || l_linenumber AS "Flow ID", CASE WHEN l_linenumber = 1 THEN 65436.0 ELSE 1.0 END AS "TCP Window Fwd Mean",
    CAST(CASE WHEN l_linenumber = 2 THEN 0 ELSE 1 END AS BIGINT) AS "Payload Min", 'Benign' AS "Label", 109 AS columns
    FROM lineitem WHERE l_returnflag <> 'A' AND l_orderkey % 5 <> 0 AND l_quantity <= 40""",
)
def flow_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan of the flow table over 109 columns: unknown labels, no duration and an impossible flag count go, two columns are mended."""
    lines = table(spark, sf_dir, "lineitem")
    row = {c: F.lit(1.0) for c in flow_plan.SCHEMA if c not in flow_plan.TEXTS} | {c: F.lit("x") for c in flow_plan.TEXTS}
    row |= {"Flow Bytes/s": F.lit(2.0), "Flow Packets/s": F.lit(2.0), "Protocol": F.lit(6.0), "Timestamp": F.lit("2018-02-14 14:00:00")}
    row |= {
        "Flow ID": F.concat_ws("-", "l_orderkey", "l_linenumber"),
        "Label": F.when(F.col("l_returnflag") == "A", "no such attack").otherwise("Benign"),
        "Flow Duration": F.when(F.col("l_orderkey") % 5 == 0, 0.0).otherwise(1_000_000.0),
        "FIN Flag Count": F.when(F.col("l_quantity") > 40, -2.0).otherwise(1.0),
        "TCP Window Fwd Mean": F.when(F.col("l_linenumber") == 1, -100.0).otherwise(1.0),
        "Payload Min": F.when(F.col("l_linenumber") == 2, -1.0).otherwise(1.0),
    }
    wide = lines.select(*[c.alias(n) for n, c in row.items()])
    out = quality.typed(quality.clean_cycles(wide, flow_plan.flow_plan()), flow_plan.SCHEMA)
    return out.select("Flow ID", "TCP Window Fwd Mean", "Payload Min", "Label", F.lit(len(out.columns)).alias("columns"))


def _day_archives(spark: SparkSession, sf_dir: str) -> str:
    """Two zip archives, each with an archive of captures within it: even days stored, odd days deflated. Their folder.

    Tasks write pieces of the days' captures, then a task for each archive puts its pieces together as a stream; nothing of
    them reaches the driver.
    """
    folder, held = fresh_path(spark, "archives"), fresh_path(spark, "archive-pieces")
    for path in (folder, held):
        system, inner = opened(path)
        system.create_dir(inner)
    records = capture_records(spark, sf_dir, F.dayofmonth(F.to_date("ts")) % 2 == 0)
    shown = records.select(F.col("day").cast("string").alias("day"), "n", F.unhex(capture_head(F.col("nano"))).alias("head"), F.unhex("record").alias("record"))
    dealt = shown.repartitionByRange("day", "n").sortWithinPartitions("day", "n").withColumn("part", F.spark_partition_id())

    def pieces(frames):
        import pandas as pd
        from netquarry.sources.capture_ranges import opened

        system, inner = opened(held)
        out, open_day = None, None
        for frame in frames:
            for day, rows in frame.groupby("day", sort=True):
                if day != open_day:
                    if out is not None:
                        out.close()
                    part, open_day = int(rows["part"].iloc[0]), day
                    out = system.open_output_stream(f"{inner}/_{day}-{part:05}")
                    yield pd.DataFrame({"day": [day], "part": [part], "head": [rows["head"].iloc[0]]})
                out.write(b"".join(rows["record"]))
        if out is not None:
            out.close()

    def archived(key, found):
        import pandas as pd
        from netquarry.sources.capture_ranges import opened

        (target, here), (system, inner) = opened(folder), opened(held)
        with contextlib.ExitStack() as stack:
            outer = stack.enter_context(zipfile.ZipFile(stack.enter_context(target.open_output_stream(f"{here}/set{key[0]}.zip")), "w"))
            outer.writestr("readme.txt", "captures")
            method = zipfile.ZIP_DEFLATED if key[0] else zipfile.ZIP_STORED
            kept = stack.enter_context(zipfile.ZipFile(stack.enter_context(outer.open("captures.zip", "w", force_zip64=True)), "w", method))
            for day, rows in found.sort_values(["day", "part"]).groupby("day", sort=True):
                with kept.open(f"pcap/day-{day}", "w", force_zip64=True) as member:
                    member.write(bytes(rows["head"].iloc[0]))
                    for part in rows["part"].astype(int):
                        with system.open_input_stream(f"{inner}/_{day}-{part:05}") as piece:
                            while data := piece.read(1 << 20):
                                member.write(data)
        return pd.DataFrame({"archive": [int(key[0])]})

    listed = settled(dealt.mapInPandas(pieces, "day string, part int, head binary"), "archive-list")  # a row for each day and part
    both = spark.range(2).select(F.col("id").cast("int").alias("k"), F.lit(None).cast("string").alias("day"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("head"))
    listed = listed.select((F.substring("day", -1, 1).cast("int") % 2).alias("k"), "day", "part", "head").unionAll(both)  # an archive without days is written too
    listed.groupBy("k").applyInPandas(archived, "archive int").write.format("noop").mode("overwrite").save()
    return folder


@register(
    "archive_days",
    f"WITH p AS ({PACKET_SQL}), d AS (SELECT *, 'set' || (day(epoch_ms(\"at\" // 1000)) % 2) AS day FROM p) SELECT day, src_ip, dst_ip, protocol, count(*) AS packets, min(\"at\") AS first, max(ttl) AS ttl FROM d GROUP BY ALL",
)
def archive_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From archives to packets: listed and extracted by ranges, batch by batch over a ledger, and run again, which changes nothing."""
    source, work, out = _day_archives(spark, sf_dir), fresh_path(spark, "archive-work"), fresh_path(spark, "archive-rows")
    process = lambda folder: pcap.parse_packets(pcap.read_pcap(spark, folder)).withColumn("at", F.unix_micros("timestamp"))
    for _ in range(2):
        ledger.archive_job(spark, source, work, out, process, batch_bytes=1 << 20, reserve=0)
    rows = spark.read.parquet(out)
    return rows.groupBy("day", "src_ip", "dst_ip", "protocol").agg(F.count("*").alias("packets"), F.min("at").alias("first"), F.max("ttl").cast("bigint").alias("ttl"))


@register(
    "inventory_days",
    """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)
    SELECT 'set' || (day(d) % 2) AS day, 'captures.zip!pcap/day-' || CAST(d AS VARCHAR) AS entry, true AS is_capture FROM d
    UNION ALL SELECT 'set' || k, e, false FROM range(2) AS r(k), (VALUES ('captures.zip'), ('readme.txt')) AS v(e)""",
)
def inventory_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives' entries written by day and read back a day at a time."""
    path = fresh_path(spark, "inventory")
    entries = archive.inventory(spark, _day_archives(spark, sf_dir))
    archive.write_inventory(entries.withColumn("day", F.regexp_extract("archive", r"(set\d)\.zip$", 1)), path)
    days = [archive.day_rows(spark, path, f"set{k}") for k in range(2)]
    return days[0].unionByName(days[1]).select("day", "entry", is_capture(F.col("entry")).alias("is_capture"))
