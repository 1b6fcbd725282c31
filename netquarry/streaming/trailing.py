"""Trailing features of a stream: the features of operators.windows as keyed state that is kept up row by row.

One stateful operator serves all histories: its key is what their groups have in common, and what they have beyond it
tells their histories apart within the key's state. A history is a queue of members in chunks of a bounded length. What
a row brings in and what leaves the window change sums (members, distinct values and their counts, the entropy's inner
sum, members that touch a run), so a row costs the same however long the window, and a batch rewrites the chunks at the
queue's ends only. Timers drop the state of keys whose window has passed.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from netquarry.functions.expr import compile_expr
from netquarry.operators.windows import CONSTANTS, FEATURES, SCALE, STREAMS, Feature, Stream, feature_value

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Members in a chunk of a history's queue.
CHUNK = 256
MEMBER = struct.Struct("<qd")
STATS = StructType([StructField(n, LongType()) for n in ("n", "kinds", "inner", "first", "last", "run", "total")])
SUMS = "head long, added long, next long, kinds long, inner long, touched long, held long"


def _part(count: int) -> int:
    """SCALE times count log2 count, as a whole number."""
    return math.floor(count * math.log2(count) * SCALE + 0.5) if count > 1 else 0


class History:
    """One history while a batch is worked on: reads of the state what it needs, writes back what it changed.

    Members have numbers; [head, added) are those in the window, and those in [added, next) wait, since they are of the
    last instant, which its own rows don't see.
    """

    def __init__(self, name: str, sums, chunks, counts):
        self.name, self.sums, self.chunks, self.counts = name, sums, chunks, counts
        held = sums.getValue((name,))
        self.head, self.added, self.next, self.kinds, self.inner, self.touched, self.held = held or (0,) * 7
        self.loaded: dict[int, list] = {}
        self.changed: set[int] = set()
        self.gone: set[int] = set()
        self.count: dict[float, int] = {}

    def member(self, i: int) -> tuple[int, float]:
        k = i // CHUNK
        if k not in self.loaded:
            self.loaded[k] = list(MEMBER.iter_unpack(bytes(self.chunks.getValue((self.name, k))[0])))
        return self.loaded[k][i % CHUNK]

    def append(self, at: int, value: float) -> None:
        k = self.next // CHUNK
        if self.next % CHUNK == 0:
            self.loaded[k] = []
        elif k not in self.loaded:
            self.member(self.next - 1)
        self.loaded[k].append((at, value))
        self.changed.add(k)
        self.next += 1

    def _step(self, i: int, low: int, high: int) -> float:
        """The difference of two members that follow each other; 0, which is no right step, at the window's ends."""
        return self.member(i)[1] - self.member(i - 1)[1] if low < i < high else 0.0

    def _touching(self, begin: int, end: int, low: int, high: int) -> tuple[int, int]:
        """How many of the members [begin, end) touch a right step, and a strong one, in the window [low, high).

        A step is right if it is +1 or -1, and strong if a step beside it equals it.
        """
        steps = {i: self._step(i, low, high) for i in range(begin - 1, end + 2)}
        right = {i: abs(s) == 1 for i, s in steps.items()}
        strong = {i: right[i] and (steps[i - 1] == steps[i] or steps[i + 1] == steps[i]) for i in range(begin, end + 1)}
        pairs = range(begin, end)
        return sum(right[i] or right[i + 1] for i in pairs), sum(strong[i] or strong[i + 1] for i in pairs)

    def _counted(self, value: float, by: int) -> None:
        if value not in self.count:
            self.count[value] = (self.counts.getValue((self.name, value)) or (0,))[0]
        before, after = self.count[value], self.count[value] + by
        self.kinds += (after > 0) - (before > 0)
        self.inner += _part(after) - _part(before)
        self.count[value] = after

    def _moved(self, low: int, high: int, begin: int, end: int) -> None:
        """The window becomes [low, high); only members in [begin, end) see the difference."""
        old = self._touching(max(begin, self.head), min(end, self.added), self.head, self.added)
        new = self._touching(max(begin, low), min(end, high), low, high)
        self.touched += new[0] - old[0]
        self.held += new[1] - old[1]
        self.head, self.added = low, high

    def advance(self, at: int, since: int) -> None:
        """What lies before `at` comes in, what lies before `since` leaves."""
        while self.added < self.next and self.member(self.added)[0] < at:
            self._counted(self.member(self.added)[1], 1)
            self._moved(self.head, self.added + 1, self.added - 3, self.added + 1)
        while self.head < self.added and self.member(self.head)[0] < since:
            self._counted(self.member(self.head)[1], -1)
            self._moved(self.head + 1, self.added, self.head, self.head + 4)
            if self.head % CHUNK == 0:
                self.gone.add(self.head // CHUNK - 1)

    def stats(self) -> Row:
        n = self.added - self.head
        ends = (self.member(self.head)[0], self.member(self.added - 1)[0]) if n else (None, None)
        return Row(*STATS.names)(n, self.kinds, self.inner, *ends, self.held, self.touched)

    def write(self) -> None:
        for k in self.gone:
            self.chunks.removeKey((self.name, k))
        for k in self.changed - self.gone:
            self.chunks.updateValue((self.name, k), (b"".join(MEMBER.pack(*m) for m in self.loaded[k]),))
        for value, n in self.count.items():
            if n:
                self.counts.updateValue((self.name, value), (n,))
            else:
                self.counts.removeKey((self.name, value))
        self.sums.updateValue((self.name,), (self.head, self.added, self.next, self.kinds, self.inner, self.touched, self.held))


class TrailingProcessor(StatefulProcessor):
    """Rows (columns, then for each stream _x_ok, _x_value, _x_sub, then _x_micros and _x_ordinal) with STATS for each stream."""

    def __init__(self, columns: list[str], streams: int, span: int, patience: int):
        self.width, self.streams, self.span, self.patience = len(columns), streams, span, patience
        self.names = [*columns, *[f"_x_{k}" for k in range(streams)]]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "at long, timer long")
        self.sums = handle.getMapState("sums", "name string", SUMS)
        self.chunks = handle.getMapState("chunks", "name string, number long", "members binary")
        self.counts = handle.getMapState("counts", "name string, value double", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, timer = self.clock.get() if self.clock.exists() else (None, None)
        histories: dict[str, History] = {}
        timed, shown = [], Row(*self.names)
        for row in rows:
            if row[-2] is None:
                yield shown(*row[: self.width], *[None] * self.streams)
            else:
                timed.append(row)
        timed.sort(key=lambda r: (r[-2], r[-1]))
        if not timed:
            return
        if last is not None and timed[0][-2] < last:
            raise ValueError(f"rows of {key} are out of order: {timed[0][-2]} follows {last}")
        for row in timed:
            at, stats = row[-2], []
            for k in range(self.streams):
                ok, value, sub = row[self.width + 3 * k : self.width + 3 * k + 3]
                name = f"{k}{sub}"
                if name not in histories:
                    histories[name] = History(name, self.sums, self.chunks, self.counts)
                history = histories[name]
                history.advance(at, at - self.span)
                stats.append(history.stats())
                if ok:
                    history.append(at, value)
            yield shown(*row[: self.width], *stats)
        for history in histories.values():
            history.write()
        last = timed[-1][-2]
        due = (last + self.span) // 1000 + self.patience
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)
        self.clock.update((last, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for state in (self.clock, self.sums, self.chunks, self.counts):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def trailing_features(
    flows: DataFrame,
    *,
    timestamp: str = "ts",
    ordinal: str = "ordinal",
    streams: dict[str, Stream] = STREAMS,
    features: Sequence[Feature] = FEATURES,
    constants: dict[str, object] = CONSTANTS,
    window_seconds: float = 300,
    partition: Sequence[str] = (),
    late: str = "2 minutes",
    idle_seconds: float = 3600,
) -> DataFrame:
    """The rows of a stream with one column per feature, the same as behaviour_features gives for them at once.

    flows: the columns of the streams, timestamp and ordinal (order among rows of one instant, also across batches). The
    streams' groups must have a column in common, which deals the state. Values of streams are numbers. A row earlier
    than its key's last one in a former batch raises ValueError, since order is part of the meaning; rows behind the
    watermark (late) are dropped, as by every operator with one. A key's state goes when the watermark has passed its last
    window by idle_seconds. Rows without a time have missing values. Needs the RocksDB state store.
    """
    spark = flows.sparkSession
    if not spark.conf.get(PROVIDER, "").endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"set {PROVIDER} to {ROCKS_DB}")
    used = list(dict.fromkeys(f.stream for f in features))
    common = [c for c in streams[used[0]].group_by if all(c in streams[n].group_by for n in used)]
    if not common:
        raise ValueError("the streams' groups have no column in common")
    types = dict(flows.dtypes)
    made: dict = {}
    for k, name in enumerate(used):
        stream = streams[name]
        value = compile_expr(stream.value, types, constants) if stream.value else F.lit(1)
        ok = F.coalesce(compile_expr(stream.eligible, types, constants), F.lit(False)) & value.isNotNull()
        for c in (*stream.requires, *stream.group_by):
            ok = ok & F.col(c).isNotNull()
        rest = [c for c in stream.group_by if c not in common]
        made |= {f"_x_ok{k}": ok, f"_x_value{k}": value.cast("double"), f"_x_sub{k}": F.to_json(F.array(*[F.col(c).cast("string") for c in rest])) if rest else F.lit("")}
    rows = flows.withWatermark(timestamp, late).select(
        *[F.col(f"`{c}`") for c in flows.columns], *[c.alias(n) for n, c in made.items()], F.unix_micros(timestamp).alias("_x_micros"), F.col(ordinal).alias("_x_ordinal")
    )
    shown = StructType([*flows.schema.fields, *[StructField(f"_x_{k}", STATS) for k in range(len(used))]])
    processor = TrailingProcessor(flows.columns, len(used), int(window_seconds * 1_000_000), int(idle_seconds * 1000))
    found = rows.groupBy(*partition, *common).transformWithState(processor, shown, "Append", "EventTime")
    out = [F.col(f"`{c}`") for c in flows.columns]
    for feature in features:
        s = F.col(f"_x_{used.index(feature.stream)}")
        some = F.coalesce(s["n"] > 0, F.lit(False))
        out.append(feature_value(feature, some, s["n"], s["kinds"], s["first"], s["last"], s["inner"], s["run"], s["total"]).alias(feature.name))
    return found.select(*out)
