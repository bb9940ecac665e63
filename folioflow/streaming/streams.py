"""Unit hand-over, matching, retries, telemetry and sessions on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions import fixed
from ..session import scratch_folder
from . import keyed

#: groups of units whose retries are kept together
RETRY_LANES = 4096


def stream_units(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Unit files as they appear; at most ``max_files`` per trigger."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def run_to_table(stream: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Process what is there, into parquet below the shared folder (or in ``folder``, to go on from an earlier run), and read it back."""
    folder = folder or scratch_folder(stream.sparkSession, name)
    with keyed.state_store(stream.sparkSession):
        q = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out")
             .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def stream_final_units(
    ledger: DataFrame, run: str, unit: str, status: str, lines: str, ts: str, sink: str, state: str, handle: Callable[[DataFrame], DataFrame] = lambda d: d
):
    """Hand each unit on once, when it reaches a final state or its run ends (``keyed.hand_over``). Returns the started query.

    Which units were handed on lies in the keyed state, the sink is never read. Each batch writes its own
    partition of the sink, so a repeated batch replaces itself.
    """
    def batch(df: DataFrame, batch_id: int) -> None:
        out = handle(df).withColumn("batch", F.lit(batch_id).cast("bigint"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(sink)

    units = keyed.hand_over(ledger, run, unit, status, lines, ts)
    with keyed.state_store(ledger.sparkSession):
        return units.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()


def match_inputs(
    segments: DataFrame, prompts: DataFrame, frames: DataFrame, key: str, seg_id: str, seg_ts: str, prompt_ts: str, frame_ts: str,
    prompt_wait: int = 60, frame_wait: int = 30, delay: str = "10 minutes", ended: tuple[DataFrame, str] | None = None,
) -> DataFrame:
    """Segment with its prompt, and from then on its first frame: failed without a prompt, text only without a frame.

    Prompts and frames may have come before the segment; see ``keyed.wait_for``.
    """
    waits = [keyed.Wait("prompt_ts", prompts, prompt_ts, prompt_wait, True), keyed.Wait("frame_ts", frames, frame_ts, frame_wait)]
    d = keyed.wait_for(segments, waits, key, seg_id, seg_ts, delay, ended)
    status = F.when(F.col("prompt_ts").isNull(), "failed").otherwise("ready")
    mode = F.when(status == "failed", None).when(F.col("frame_ts").isNull(), "t2va").otherwise("i2va")
    return d.withColumns({"status": status, "mode": mode})


def match_frames(
    segments: DataFrame, frames: DataFrame, key: str, seg_id: str, seg_ts: str, frame_ts: str, wait: int = 30, delay: str = "10 minutes",
    ended: tuple[DataFrame, str] | None = None,
) -> DataFrame:
    """Segment with its first frame if that was there or comes within the wait, else downgraded to text only."""
    d = keyed.wait_for(segments, [keyed.Wait("frame_ts", frames, frame_ts, wait)], key, seg_id, seg_ts, delay, ended)
    return d.withColumn("mode", F.when(F.col("frame_ts").isNull(), "t2va").otherwise("i2va"))


def match_prompts(
    segments: DataFrame, prompts: DataFrame, key: str, seg_id: str, seg_ts: str, prompt_ts: str, wait: int = 60, delay: str = "10 minutes",
    ended: tuple[DataFrame, str] | None = None,
) -> DataFrame:
    """Segment with its prompt if that was there or comes within the wait, else failed."""
    d = keyed.wait_for(segments, [keyed.Wait("prompt_ts", prompts, prompt_ts, wait, True)], key, seg_id, seg_ts, delay, ended)
    return d.withColumn("status", F.when(F.col("prompt_ts").isNull(), "failed").otherwise("ready"))


def retry_machine(verdicts: DataFrame, unit: str, attempt: str, passed: str, points: str, infra: str) -> DataFrame:
    """What to do after each verdict: accept, retry (next attempt), needs_review or failed.

    ``points`` is a clean integer score. The state of a unit is the number of attempts used and
    whether it is closed; later verdicts of a closed unit are ignored. Units are dealt into ``RETRY_LANES`` groups by
    hash, and the state of a group holds its units, as a call per unit costs far more than the step itself.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    top, need = fixed.MAX_ATTEMPTS, fixed.PASS_SCORE

    def step(key, batches, state):
        known = {}
        if state.exists:
            known = {u: (used, closed) for u, used, closed in zip(*state.get)}
        rows: dict = {}
        for b in batches:
            for u, *row in zip(b["unit"], b[attempt], b[passed], b[points], b[infra]):
                rows.setdefault(u, []).append(row)
        out = []
        for u, verdicts in rows.items():
            used, closed = known.get(u, (0, False))
            for a, ok, pts, broke in sorted(verdicts):
                if closed:
                    break
                if broke:
                    action, closed = "failed", True
                else:
                    used += 1
                    if ok and pts >= need:
                        action, closed = "completed", True
                    elif used >= top:
                        action, closed = "needs_review", True
                    else:
                        action = "retry"
                out.append((u, int(a), int(used), action))
            known[u] = (used, closed)
        state.update((list(known), [int(used) for used, _ in known.values()], [bool(closed) for _, closed in known.values()]))
        yield pd.DataFrame(out, columns=["unit", "attempt", "used", "action"])

    kind = verdicts.schema[unit].dataType
    lane = F.pmod(F.xxhash64(unit), F.lit(RETRY_LANES)).alias("lane")
    dealt = verdicts.select(lane, F.col(unit).cast("string").alias("unit"), attempt, passed, points, infra)
    done = dealt.groupBy("lane").applyInPandasWithState(
        step, "unit string, attempt int, used int, action string", "unit array<string>, used array<int>, closed array<boolean>", "append", GroupStateTimeout.NoTimeout)
    return done.select(F.col("unit").cast(kind).alias(unit), F.col("attempt").alias(attempt), "used", "action")


def telemetry_windows(events: DataFrame, ts: str, busy: Column, capacity: int, size: str = "10 seconds", slide: str | None = None, delay: str = "1 minute") -> DataFrame:
    """Busy share of the capacity per time window."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    d = events.withWatermark(ts, delay).groupBy(w).agg(F.count_if(busy).alias("busy"), F.count(F.lit(1)).alias("total"))
    return d.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "busy", "total",
                    (F.least(F.col("busy"), F.lit(capacity)) * F.lit(100.0) / capacity).alias("utilisation_pct"))


def slow_sessions(calls: DataFrame, ts: str, keys: list[str], seconds: str, slow: float, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Episodes of slow calls, apart by at least ``gap`` without one. A row without keys and seconds closes the last ones."""
    closing = F.coalesce(*[F.col(c).cast("string") for c in (seconds, *keys)]).isNull()
    d = calls.where((F.col(seconds) >= slow) | closing).withWatermark(ts, delay).groupBy(*keys, F.session_window(ts, gap).alias("s"))
    return d.agg(F.count(F.lit(1)).alias("calls"), F.max(seconds).alias("slowest")).select(
        *keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "calls", "slowest")


def dedupe_updates(updates: DataFrame, ts: str, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """Repeated updates within the delay count once, the first that comes; the state stays bounded by the watermark.

    ``keyed.latest_writes`` keeps the last write instead.
    """
    return updates.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
