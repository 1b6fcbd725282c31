"""The operators on streams: windowed state with watermarks, trailing history as keyed state, resumable batches."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netquarry.operators import states
from netquarry.operators.states import StateColumns


def windowed_state(flows: DataFrame, *, timestamp: str = "ts", length: str = "60 seconds", late: str = "2 minutes", sums: Sequence[str] = ()) -> DataFrame:
    """Flow count, sums and means per tumbling window; a window closes when the watermark has passed its end."""
    return (
        flows.withWatermark(timestamp, late)
        .groupBy(F.window(timestamp, length))
        .agg(F.count("*").alias("flow_count"), *[F.sum(c).alias(f"{c}_sum") for c in sums], *[F.avg(c).alias(f"{c}_mean") for c in sums])
        .select(F.col("window.start").alias("window_start"), "flow_count", *[f"{c}_{how}" for how in ("sum", "mean") for c in sums])
    )


def _windowed(flows: DataFrame, timestamp: str, length: str, late: str) -> DataFrame:
    return flows.withWatermark(timestamp, late).withColumn("window", F.window(timestamp, length))


def _from_start(found: DataFrame) -> DataFrame:
    return found.select(F.col("window.start").alias("window_start"), *[c for c in found.columns if c != "window"])


def host_state(flows: DataFrame, *, columns: StateColumns = StateColumns(), length: str = "60 seconds", late: str = "2 minutes", **features: Sequence[str]) -> DataFrame:
    """host_features of a stream, in append mode: a window's hosts come when the watermark has passed its end.

    features: sums, means and ratios as in host_features.
    """
    return _from_start(states.host_features(_windowed(flows, columns.timestamp, length, late), columns=columns, window="window", **features))


def edge_state(flows: DataFrame, *, columns: StateColumns = StateColumns(), length: str = "60 seconds", late: str = "2 minutes", **features: Sequence[str]) -> DataFrame:
    """edge_table of a stream, in append mode."""
    return _from_start(states.edge_table(_windowed(flows, columns.timestamp, length, late), columns=columns, window="window", **features))


def trailing_ports(flows: DataFrame, window_seconds: float = 300, idle: str = "1 hour", late: str = "2 minutes") -> DataFrame:
    """Distinct ports each source used in the seconds before a flow, not counting flows of the same instant.

    flows: src_ip, dst_port, ts. State is the source's recent (micros, port) pairs; it goes after `idle` without flows.
    A flow earlier than the last one of its source in an earlier batch raises: order is part of the meaning.
    """
    span = int(window_seconds * 1_000_000)
    patience = pd.Timedelta(idle).value // 1_000_000

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = deque(zip(*state.get, strict=True)) if state.exists else deque()
        rows = pd.concat(list(parts)).sort_values("ts", kind="stable")
        micros = rows["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        if held and len(micros) and micros[0] < held[-1][0]:
            raise ValueError(f"flows of {key[0]} are out of order")
        counts: dict = {}
        for _, port in held:
            counts[port] = counts.get(port, 0) + 1
        waiting: list[tuple[int, int]] = []
        found = []
        for at, port in zip(micros, rows["dst_port"], strict=True):
            if waiting and waiting[-1][0] < at:
                for pair in waiting:
                    held.append(pair)
                    counts[pair[1]] = counts.get(pair[1], 0) + 1
                waiting = []
            while held and held[0][0] < at - span:
                _, gone = held.popleft()
                counts[gone] -= 1
                if not counts[gone]:
                    del counts[gone]
            found.append(len(counts))
            if not pd.isna(port):
                waiting.append((int(at), int(port)))
        held.extend(waiting)
        state.update(([at for at, _ in held], [port for _, port in held]))
        state.setTimeoutTimestamp(max(int(micros[-1]) // 1000, state.getCurrentWatermarkMs()) + patience)
        yield rows.assign(dst_port_unique_cnt=found)[["src_ip", "ts", "dst_port", "dst_port_unique_cnt"]]

    return (
        flows.withWatermark("ts", late)
        .groupBy("src_ip")
        .applyInPandasWithState(
            update, "src_ip string, ts timestamp, dst_port long, dst_port_unique_cnt long", "micros array<long>, ports array<long>", "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def resumable_append(path: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that writes each batch to its own partition: a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        out = transform(batch) if transform else batch
        (
            out.withColumn("batch", F.lit(number))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(path)
        )

    return write
