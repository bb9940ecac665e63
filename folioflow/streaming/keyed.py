"""Keyed state with event-time timers: waiting for inputs, handing units over, versions of ledger items."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions import fixed
from ..session import cut_lineage

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: a run's units are dealt over so many states, so that a large run is not one task
LANES = 32


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which named states and timers need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def with_closing(stream: DataFrame, ts: str, last: DataFrame, wait: str) -> DataFrame:
    """The stream and one more row, of the time ``wait`` behind the latest ``ts`` of the table ``last``, null elsewhere.

    It says that a source has ended: the watermark passes all that waits, so timers fire and windows close.
    ``wait`` must be longer than the longest wait, window or gap and the delay of the watermark together.
    """
    row = last.agg((F.coalesce(F.max(ts), F.lit("1970-01-01").cast("timestamp")) + F.expr(f"INTERVAL {wait}")).cast("timestamp").alias(ts))
    cols = [F.col(ts) if c == ts else F.lit(None).cast(stream.schema[c].dataType).alias(c) for c in stream.columns]
    stored = cut_lineage(row.select(*cols), "closing")
    path = stored.inputFiles()[0].rsplit("/", 1)[0]
    return stream.unionByName(stream.sparkSession.readStream.schema(stored.schema).parquet(path))


@dataclass
class Wait:
    """Something a segment waits for: ``rows`` with key and time, for at most ``minutes``. Without a ``needed`` one
    the segment has failed and waits for nothing more."""

    name: str
    rows: DataFrame
    ts: str
    minutes: int
    needed: bool = False


class _Waiting(StatefulProcessor):
    """State of a key: the earliest time of each kind of input, and the segments still waiting."""

    def __init__(self, waits: list[tuple[int, bool]], kinds: tuple[str, str], names: list[str]):
        self.waits, self.kinds, self.row = waits, kinds, Row("k", "id", "ts", *names)

    def init(self, handle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", ", ".join(f"t{i} long" for i in range(len(self.waits))))
        self.open = handle.getListState("open", f"id {self.kinds[1]}, ts long")

    def look(self, ts: int, first: list[int | None], now: int) -> tuple[list[int | None] | None, int]:
        """What a segment of this time has got, or None and when to look again."""
        got: list[int | None] = []
        for (wait, needed), at in zip(self.waits, first):
            if at is not None and at <= ts + wait:
                if at > now:  # an earlier one may still come
                    return None, at
                got.append(at)
                ts = max(ts, at)
            elif now < ts + wait:
                return None, ts + wait
            else:
                got.append(None)
                ts += wait
                if needed:
                    break
        return got + [None] * (len(self.waits) - len(got)), 0

    def settle(self, key, first: list[int | None], segments: list[tuple], now: int, was: int) -> Iterator[Row]:
        left, times = [], set()
        for segment in segments:
            got, again = self.look(segment[1], first, now)
            if got is None:
                left.append(segment)
                times.add(-(-again // 1000))
            else:
                yield self.row(*key, *segment, *got)
        if left:
            self.open.put(left)
            self.handle.registerTimer(min(times))
        elif was:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = list(self.first.get() if self.first.exists() else [None] * len(self.waits))
        segments = list(self.open.get())
        was, before = len(segments), list(first)
        for r in rows:
            if r.kind is None:
                continue
            if r.kind < 0:
                segments.append((r.id, r.ts))
            elif first[r.kind] is None or r.ts < first[r.kind]:
                first[r.kind] = r.ts
        if first != before:
            self.first.update(tuple(first))
        yield from self.settle(key, first, segments, timerValues.getCurrentWatermarkInMs() * 1000, was)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        first = list(self.first.get() if self.first.exists() else [None] * len(self.waits))
        segments = list(self.open.get())
        yield from self.settle(key, first, segments, timerValues.getCurrentWatermarkInMs() * 1000, len(segments))

    def close(self) -> None:
        pass


def wait_for(segments: DataFrame, waits: list[Wait], key: str, seg_id: str, seg_ts: str, delay: str = "10 minutes", ended: tuple[DataFrame, str] | None = None) -> DataFrame:
    """Each segment once, with the earliest input of each kind that was there already or came in time.

    The inputs are waited for one after the other: the wait for the next begins when the one before has come (or
    its wait is over). Returns ``key``, ``seg_id``, ``seg_ts`` and the time of each input under its name, null if it did
    not come in time. A row is given out when no earlier input can come any more, or when the wait is over, by
    event time, so the result does not depend on the order of arrival; rows later than ``delay`` are left out.
    ``ended`` (a table and its time column that hold the latest times) closes the streams; otherwise the last segments keep waiting.

    A null key matches no input, a null time leaves the row out. Several segments of a key and repeated rows each count.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    kinds = [segments.schema[c].dataType.simpleString() for c in (key, seg_id)]
    cols = lambda df, k, ident, ts, kind: df.where(F.col(ts).isNotNull()).select(
        F.col(k).cast(kinds[0]).alias("k"), ident.cast(kinds[1]).alias("id"), us(ts).alias("ts"), F.lit(kind).alias("kind"), F.col(ts).cast("timestamp").alias("at"))
    rows = cols(segments, key, F.col(seg_id), seg_ts, -1)
    for i, w in enumerate(waits):
        rows = rows.unionByName(cols(w.rows.where(F.col(key).isNotNull()), key, F.lit(None), w.ts, i))
    if ended:
        latest = ended[0].select(F.col(ended[1]).cast("timestamp").alias("at"))
        span = sum(w.minutes for w in waits) + 1
        rows = with_closing(rows, "at", latest, f"{span} minutes + INTERVAL {delay}")
    names = [w.name for w in waits]
    shape = f"k {kinds[0]}, id {kinds[1]}, ts long, " + ", ".join(f"`{n}` long" for n in names)
    machine = _Waiting([(w.minutes * 60_000_000, w.needed) for w in waits], tuple(kinds), names)
    out = rows.withWatermark("at", delay).groupBy("k").transformWithState(machine, shape, "Append", "EventTime")
    return out.select(F.col("k").alias(key), F.col("id").alias(seg_id), *[F.timestamp_micros(a).alias(b) for a, b in [("ts", seg_ts), *[(f"`{n}`", n) for n in names]]])


class _HandOver(StatefulProcessor):
    """State of some units of a run: those seen (lines, handed on), and whether the run has ended."""

    def __init__(self, unit: str):
        self.unit, self.row = unit, Row("run", "unit", "lines", "swept")

    def init(self, handle) -> None:
        self.units = handle.getMapState("units", f"unit {self.unit}", "lines long, handed boolean")
        self.ended = handle.getValueState("ended", "ended boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ended = was = self.ended.exists()
        known: dict = {}
        for r in sorted(rows, key=lambda r: (r.ts is None, r.ts)):
            if r.unit is None:
                ended = True
                continue
            at = (r.unit,)
            if at not in known:
                known[at] = self.units.getValue(at) or (None, False)
            lines, handed = known[at]
            lines = r.lines if r.lines is not None else lines
            if r.final and not handed:
                handed = True
                yield self.row(key[0], r.unit, lines, False)
            known[at] = (lines, handed)
        if ended:
            if not was:
                self.ended.update((True,))
                # all earlier units are read once, when the run ends
                known = {**{k: v for k, v in self.units.iterator() if k not in known}, **known}
            for at, (lines, handed) in known.items():
                if not handed:
                    yield self.row(key[0], at[0], lines, True)
                    known[at] = (lines, True)
        for at, value in known.items():
            self.units.updateValue(at, value)

    def close(self) -> None:
        pass


def hand_over(ledger: DataFrame, run: str, unit: str, status: str, lines: str, ts: str) -> DataFrame:
    """Units as they become final, each once: ``run``, ``unit``, ``lines``, ``action``, ``swept``.

    A row of the ledger without a unit tells of the run itself; completed or failed, it ends the run, and all units seen
    that never became final are swept up; units that come later are handed on at once. ``action`` is
    ``complete`` for a unit without lines (zero or null), which needs no work, else ``process``.
    The state holds one entry per unit; units of a run lie in 32 states by hash, and the row that ends a run goes to each.
    """
    final = F.coalesce(F.col(status).isin(*fixed.FINAL_STATES), F.lit(False))
    over = F.col(unit).isNull() & F.coalesce(F.col(status).isin("completed", "failed"), F.lit(False))
    d = ledger.where(F.col(unit).isNotNull() | over).select(
        F.col(run).alias("run"), F.col(unit).alias("unit"), F.col(lines).cast("bigint").alias("lines"), final.alias("final"), F.unix_micros(F.col(ts).cast("timestamp")).alias("ts"),
        F.explode(F.when(F.col(unit).isNull(), F.sequence(F.lit(0), F.lit(LANES - 1))).otherwise(F.array(F.pmod(F.xxhash64(unit), F.lit(LANES)).cast("int")))).alias("lane"))
    kinds = [d.schema[c].dataType.simpleString() for c in ("run", "unit")]
    out = d.groupBy("run", "lane").transformWithState(_HandOver(kinds[1]), f"run {kinds[0]}, unit {kinds[1]}, lines long, swept boolean", "Append", "None")
    action = F.when(F.coalesce("lines", F.lit(0)) == 0, "complete").otherwise("process")
    return out.select(F.col("run").alias(run), F.col("unit").alias(unit), F.col("lines").alias(lines), action.alias("action"), "swept")


class _Latest(StatefulProcessor):
    """State of a key: its version, and the order and values of the last write."""

    def __init__(self, state: str, keys: list[str], cols: list[str], n_order: int):
        self.schema, self.cols, self.n, self.row = state, cols, n_order, Row(*keys, *cols, "version")

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.last.get() if self.last.exists() else None
        rank = lambda row: [(x is not None, x) if x is not None else (False,) for x in row[:self.n]]
        best = max((tuple(r[c] for c in self.cols) for r in rows), key=rank)
        if last is None or rank(best) > rank(last[:-1]):
            version = 1 if last is None else last[-1] + 1
            self.last.update((*best, version))
            yield self.row(*key, *best, version)

    def close(self) -> None:
        pass


def latest_writes(updates: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Change log of a ledger under last write wins: a row per key and batch in which its last write changed.

    A write wins if its ``order`` columns (time first, then what breaks ties) are greater than those of the last one kept,
    whatever the order of arrival; an older or repeated write changes nothing. ``version`` counts up per key, so that
    ``current_writes`` finds the ledger. Nulls in ``order`` are the oldest. The state is one write per key, as the ledger is.
    """
    cols = [*order, *values]
    types = {c: updates.schema[c].dataType.simpleString() for c in [*keys, *cols]}
    times = [c for c, kind in types.items() if kind.startswith("timestamp")]  # as numbers in the state
    kept = {**types, **{c: "bigint" for c in times}}
    kind = lambda cs: ", ".join(f"`{c}` {kept[c]}" for c in cs)
    d = updates.select(*keys, *cols).withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in times})
    machine = _Latest(f"{kind(cols)}, version long", keys, cols, len(order))
    log = d.groupBy(*keys).transformWithState(machine, f"{kind([*keys, *cols])}, version long", "Append", "None")
    return log.withColumns({c: F.timestamp_micros(c).cast(types[c]) for c in times})


def current_writes(log: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of each key of a change log."""
    rest = [c for c in log.columns if c not in keys and c != "version"]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("_l")).select(*keys, *[F.col("_l")[c].alias(c) for c in rest])
